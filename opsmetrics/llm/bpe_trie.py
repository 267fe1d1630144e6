"""BPE encoding and decoding by a prefix-sharing trie traversal (operator 7).

A BPE encoding of a string is fixed by its last token and the encoding of what stands before
it, and a token sequence is the encoding of its string exactly when each token encodes alone
as itself and each adjacent pair is stable (merging the joined string gives the pair back).
So the encoding of every prefix of a word is described by one state, its last token:

    last(w[:i]) = the longest vocabulary string t ending at i that is stable after
                  last(w[:i - len(t)])

Distinct words, sorted, are a trie in depth-first order: the common prefix with the word
before is the path from the root that both share, and its states are kept on a stack and
never computed again. Candidate strings ending at a position come from a suffix automaton
over the vocabulary that is filled as it is visited, so a step costs one table look-up.

Splitting a text: no pre-token crosses from a non-space to a space character, so
``text.split(" ")`` cuts only at pre-token borders as long as no piece is empty or begins or
ends with white space; other texts go through the pattern as a whole.

Cases: null text counts as empty (0 tokens, digests of the empty string). Special strings in
the text become their special id, as in the library's default. Repeated rows are encoded each;
extra columns of the input are ignored; an empty table gives no rows. Word tables hold at most ``cache_words`` entries and
start again when full, so memory doesn't grow with the corpus.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.common import KEPT_CHARS, cut, held

# The byte-level BPE pre-token pattern.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters that every Unicode version since 6 puts in the same class; text with others is
#: split by the library's own pre-tokenizer.
SETTLED = regex.compile("[\x00-\u052f\u1e00-\u1eff\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f320]*")

#: Entries of a worker's word table before it starts again (about 150 bytes each).
CACHE_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [s for _, s in sorted([(b, chr(b)) for b in plain] + [(b, chr(256 + k)) for k, b in enumerate(rest)])]


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE file, over byte symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.symbols = byte_symbols()
        self.table = {b: s for b, s in enumerate(self.symbols)}

    def spell(self, word: str) -> str:
        """The byte symbols of a word."""
        if word.isascii():
            return word.translate(self.table)
        return word.encode("utf-8").decode("latin-1").translate(self.table)

    def start(self, spelled: str) -> list[str]:
        s = list(spelled)
        if self.end and s:
            s[-1] += self.end
        return s

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain merging: the lowest-ranked pair first, the leftmost of equals."""
        rank = self.rank
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                r = rank.get((symbols[k], symbols[k + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols


class TrieEncoder:
    """Encodes batches of distinct words (spelled in byte symbols), sharing their prefixes."""

    def __init__(self, merges: Merges):
        self.m = merges
        rank, end = merges.rank, merges.end
        made: dict[str, tuple[int, str, str]] = {}
        for (a, b), r in rank.items():
            made.setdefault(a + b, (r, a, b))
        self._made = made
        self._spines: dict[tuple[str, bool], list] = {}
        self._stable: dict[int, bool] = {}
        self._name = {i: s for s, i in merges.vocab.items()}
        # vocabulary strings that encode alone as themselves: only those occur in encodings
        base = set(merges.symbols) | ({s + end for s in merges.symbols} if end else set())
        self.alone = {s for s in merges.vocab if s in base or (s in made and self._keeps(s))}
        self._prefixes = {""}
        for s in self.alone:
            if end and s.endswith(end):
                s = s[:-len(end)]
            self._prefixes.update(s[:k] for k in range(1, len(s) + 1))
        # the automaton: node 0 is the empty string; nodes, edges and candidates made on demand
        self._node = {"": 0}
        self._text = [""]
        self._edges: list[dict[str, int]] = [{}]
        self._cands: list[list] = [[]]
        self._final: list[list | None] = [None]

    def _keeps(self, s: str) -> bool:
        _, a, b = self._made[s]
        if a not in self.m.vocab or b not in self.m.vocab:
            return False
        end = self.m.end
        if end and s.endswith(end):
            return self.m.merge(self.m.start(s[:-len(end)])) == [s]
        return self.m.merge(list(s)) == [s]

    def _spine(self, t: str, right: bool) -> list:
        """(symbol, rank that made it, rank that uses it up) down one edge of t's merge tree."""
        got = self._spines.get((t, right))
        if got is None:
            got, dies = [], len(self.m.rank)
            while True:
                r, a, b = self._made.get(t, (-1, "", ""))
                got.append((t, r, dies))
                if r < 0:
                    break
                t, dies = (b if right else a), r
            self._spines[(got[0][0], right)] = got
        return got

    def stable(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' joined string gives the two tokens back.

        A merge across the seam needs a symbol ending the left token and one beginning the
        right token that exist at the same time, and a rank that comes before the merge using
        up either; of equal ranks the leftmost merge comes first.
        """
        key = (left << 20) | right
        got = self._stable.get(key)
        if got is None:
            rank, got = self.m.rank, True
            ls, rs = self._spine(self._name[left], True), self._spine(self._name[right], False)
            for a, born_a, dies_a in ls:
                for b, born_b, dies_b in rs:
                    r = rank.get((a, b))
                    if r is not None and r < dies_a and r <= dies_b and born_a <= dies_b and born_b < dies_a:
                        got = False
                        break
                if not got:
                    break
            if len(self._stable) > 2_000_000:
                self._stable.clear()
            self._stable[key] = got
        return got

    def _step(self, node: int, c: str) -> int:
        s = self._text[node] + c
        while s not in self._prefixes:
            s = s[1:]
        k = self._node.get(s)
        if k is None:
            k = self._node[s] = len(self._text)
            self._text.append(s)
            self._edges.append({})
            self._final.append(None)
            vocab, alone = self.m.vocab, self.alone
            self._cands.append([(vocab[x], len(x)) for j in range(len(s)) if (x := s[j:]) in alone])
        self._edges[node][c] = k
        return k

    def _last(self, node: int, c: str) -> list:
        """Candidates that end a word: strings with the end-of-word mark."""
        got = self._final[node]
        if got is None:
            got = self._final[node] = {}
        out = got.get(c)
        if out is None:
            s, end = self._text[node] + c, self.m.end
            out = got[c] = [(self.m.vocab[x + end], len(x)) for j in range(len(s)) if (x := s[j:]) + end in self.alone]
        return out

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each word; the words are distinct, sorted and spelled in byte symbols."""
        nodes, last, size = [0], [-1], [0]
        before = ""
        edges, cands, known, stable, end = self._edges, self._cands, self._stable, self.stable, self.m.end
        for w in words:
            n = len(w)
            k, m = 0, min(len(before), n)
            if before[:m] == w[:m]:
                k = m
            else:
                while before[k] == w[k]:
                    k += 1
            if end:
                k = min(k, n - 1) if n else 0
            del nodes[k + 1:], last[k + 1:], size[k + 1:]
            stop = n - 1 if end and n else n
            for i in range(k + 1, n + 1):
                c = w[i - 1]
                node = nodes[-1]
                if i <= stop:
                    nxt = edges[node].get(c)
                    if nxt is None:
                        nxt = self._step(node, c)
                    found = cands[nxt]
                else:
                    nxt, found = 0, self._last(node, c)
                for t, length in found:
                    if length == i:
                        break
                    p = last[i - length]
                    ok = known.get((p << 20) | t)
                    if ok or (ok is None and stable(p, t)):
                        break
                else:
                    raise ValueError(f"no encoding for {w[:i]!r}")
                nodes.append(nxt)
                last.append(t)
                size.append(length)
            out, i = [], n
            while i:
                out.append(last[i])
                i -= size[i]
            out.reverse()
            yield out
            if end and n:   # the final state belongs to the marked symbol only
                nodes.pop(), last.pop(), size.pop()
                before = w[:-1]
            else:
                before = w


class Splitter:
    """The pre-tokens of a text, by the pattern or, for unsettled characters, by the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.find = regex.compile(BYTE_PATTERN).findall
        self.library = Tokenizer.from_file(path).pre_tokenizer

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or SETTLED.fullmatch(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def piece(self, piece: str) -> list[str]:
        """Of a piece between two spaces, with the space before it."""
        if piece.isalpha() and (piece.isascii() or SETTLED.fullmatch(piece)):
            return [" " + piece]
        return self(" " + piece)


class WordCoder:
    """Texts to ids by a table of pieces; new pieces of a batch are encoded together in the trie."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.merges = Merges(path)
        self.trie = TrieEncoder(self.merges)
        self.split = Splitter(path)
        self.special = self.merges.special
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.cache_words = cache_words
        self.width = "<u2" if max([*self.merges.vocab.values(), *self.special.values()]) < 65536 else "<u4"
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _encode_words(self, words: Iterable[str]) -> None:
        """Adds the pre-tokens to the word table, each shared prefix once."""
        table = self.words
        todo = sorted((self.merges.spell(w), w) for w in words if w not in table)
        for (_, w), ids in zip(todo, self.trie.encode_sorted([s for s, _ in todo])):
            table[w] = np.array(ids, self.width).tobytes() if len(ids) > 1 else ids[0].to_bytes(int(self.width[-1]), "little")

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian integers of ``width``."""
        if len(self.pieces) > self.cache_words:
            self.pieces = {}
        if len(self.words) > self.cache_words:
            self.words = {}
        whole: dict[int, list] = {}
        split: list[list[str]] = []
        for k, t in enumerate(texts):
            t = t or ""
            if self.split_special is not None and self.split_special.search(t):
                whole[k] = self._with_special(t)
                split.append([])
                continue
            p = t.split(" ")
            split.append(p)
        fresh = set().union(*split) - self.pieces.keys() if split else set()
        odd = {p for p in fresh if not p or p[0].isspace() or p[-1].isspace()}
        # a text's first piece has no space before it: it is looked up as a pre-token of its own
        for k, p in enumerate(split):
            if k not in whole and (not odd.isdisjoint(p) if odd else False):
                whole[k] = [self.split(texts[k] or "")]
        fresh -= odd
        parts = {p: self.split.piece(p) for p in fresh}
        need = {w for ws in parts.values() for w in ws}
        firsts = {p[0]: self.split(p[0]) for k, p in enumerate(split) if k not in whole and p}
        for ws in firsts.values():
            need.update(ws)
        for runs in whole.values():
            for ws in runs:
                if isinstance(ws, list):
                    need.update(ws)
        self._encode_words(need)
        words, pieces = self.words, self.pieces
        for p, ws in parts.items():
            pieces[p] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
        out = []
        size = int(self.width[-1])
        for k, p in enumerate(split):
            if k in whole:
                out.append(b"".join(ws.to_bytes(size, "little") if isinstance(ws, int) else b"".join([words[w] for w in ws]) for ws in whole[k]))
            else:
                head = b"".join([words[w] for w in firsts[p[0]]])
                out.append(head + b"".join(map(pieces.__getitem__, p[1:])))
        for table, keys in ((words, need), (pieces, fresh)):      # long ones don't stay
            for x in keys:
                if len(x) > KEPT_CHARS:
                    table.pop(x, None)
        return out

    def _with_special(self, t: str) -> list:
        """Runs of pre-tokens, and the ids of special strings between them."""
        runs, at = [], 0
        for m in self.split_special.finditer(t):
            runs += [self.split(t[at:m.start()]), self.special[m[0]]]
            at = m.end()
        return [*runs, self.split(t[at:])]

    def decoder(self):
        """A function from ids to text: the bytes of the tokens, broken sequences replaced."""
        back = {s: b for b, s in enumerate(self.merges.symbols)}
        n = max([*self.merges.vocab.values(), *self.special.values()]) + 1
        names: list[bytes] = [b""] * n
        for s, i in self.merges.vocab.items():
            names[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        for s, i in self.special.items():
            names[i] = s.encode()

        def decode(ids) -> str:
            return b"".join([names[i] for i in ids]).decode("utf-8", "replace")
        return decode


def coder(path: str) -> WordCoder:
    """The worker's coder of a vocabulary file."""
    return held(("trie", path), lambda: WordCoder(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids array<int>) of every whole text."""
    key = docs.schema[id_col].dataType

    def run(it):
        c = coder(path)
        for b in cut(it):
            got = [np.frombuffer(x, c.width) for x in c.batch(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([len(x) for x in got], pa.int64()), pa.array([x.astype(np.int32) for x in got], pa.list_(pa.int32()))],
                names=["id", "n_tokens", "ids"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(run, f"id {key.simpleString()}, n_tokens bigint, ids array<int>").withColumnRenamed("id", id_col)


def decode(ids: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, text) from rows (id, ids array<int>); null ids give the empty text."""
    key = ids.schema[id_col].dataType

    def run(it):
        back = coder(path).decoder()
        for b in it:
            texts = [back(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return (ids.select(F.col(id_col).alias("id"), "ids")
            .mapInArrow(run, f"id {key.simpleString()}, text string").withColumnRenamed("id", id_col))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids (little-endian 32 bit) and of the decoded text."""
    def run(it):
        c = coder(path)
        back = c.decoder()
        for b in cut(it):
            n, h, d = [], [], []
            for x in c.batch(b.column("text").to_pylist()):
                ids = np.frombuffer(x, c.width)
                n.append(len(ids))
                h.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                d.append(hashlib.sha256(back(ids.tolist()).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    key = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return out.mapInArrow(run, f"doc_id {key}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
