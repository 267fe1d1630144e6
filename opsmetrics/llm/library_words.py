"""Ids of whole texts by the tokenizers library, each distinct word once.

No pre-token of the two supported kinds of vocabulary crosses from a non-space to a space
character, so a text is encoded piece by piece between single spaces and the ids are looked up
in a bounded table. What the fast way doesn't cover goes to the library as it is: rare
characters piece by piece, special strings and runs of white space as whole texts.
"""

from __future__ import annotations

import array
import itertools
import re
import struct
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from opsmetrics.llm.bpe_trie import BYTE_PATTERN, Merges
from opsmetrics.llm.common import KEPT_CHARS, held

# The pre-token pattern of the lower-casing word vocabulary.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

#: Characters whose normal form, case and class need no look at their neighbours.
_PLAIN = re.compile(r"[\n!-~¡-¬®-įĲ-ňŊ-žƀ-ǃ]*")


#: Marks that are a pre-token of their own behind a word.
MARKS = frozenset(".,!?;:")


class LibraryWords(dict):
    """Piece -> ids as little-endian 16-bit integers; None for a piece that can't be cut out."""

    def __init__(self, path: str, limit: int = 900_000, word_limit: int = 1_000_000):
        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.limit, self.word_limit = limit, word_limit
        m = Merges(path)
        if max([*m.vocab.values(), *m.special.values()]) >= 65536:
            raise ValueError("ids over 16 bits")
        self.spell = m.spell
        self.space = m.spell(" ")
        self.packed = [k.to_bytes(2, "little") for k in range(max([*m.vocab.values(), *m.special.values()]) + 1)]
        m.vocab, m.rank = {}, {}           # the library has them too
        self.lower = bool(m.end)           # the word vocabulary lower-cases and drops white space
        self.find = regex.compile(WORD_PATTERN if self.lower else BYTE_PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, m.special))) if m.special else None
        self.apart: dict[str, bytes] = {}
        self.model = self.tok.model

    @property
    def words(self) -> dict[str, bytes]:
        """Pre-token -> ids. In the lower-casing vocabulary a pre-token has its own ids as a piece too, so one entry does for both."""
        return self if self.lower else self.apart

    def word(self, w: str) -> bytes:
        got = self.words.get(w)
        if got is None:
            packed = self.packed
            got = b"".join([packed[t.id] for t in self.model.tokenize(self.spell(w))])
            if len(w) <= KEPT_CHARS:
                if len(self.words) > self.word_limit:
                    self.words.clear()
                self.words[w] = got
        return got

    def whole(self, text: str) -> bytes:
        return pack(self.tok.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> bytes | None:
        return self.learned([piece])[0]

    def learned(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of pieces that the table doesn't have."""
        out = list(map(self.lower_piece, pieces)) if self.lower else self.byte_pieces(pieces)
        if len(self) + len(pieces) > self.limit:
            self.clear()
        short = max(map(len, pieces), default=0) <= KEPT_CHARS
        self.update(zip(pieces, out) if short else [x for x in zip(pieces, out) if len(x[0]) <= KEPT_CHARS])
        return out

    def lower_piece(self, piece: str) -> bytes:
        plain = piece.isascii() or _PLAIN.fullmatch(piece)
        mark = piece[-1:]
        word = piece[:-1] if mark in MARKS else piece
        if plain and word.isalpha():      # a word, perhaps with one mark behind it
            got = self.words.get(word.lower()) or self.word(word.lower())
            return got + (self.words.get(mark) or self.word(mark)) if word is not piece else got
        return b"".join(map(self.word, self.find(piece.lower()))) if plain else self.whole(piece)

    def byte_pieces(self, pieces: list[str]) -> list[bytes | None]:
        """One loop over all pieces: most of the time goes into pieces that are seen first."""
        words, packed, plain, spell, tokenize, space = self.apart, self.packed, _PLAIN.fullmatch, self.spell, self.model.tokenize, self.space
        if len(words) + len(pieces) > self.word_limit:
            words.clear()
        out = []
        for piece in pieces:
            mark = piece[-1:]
            word = piece[:-1] if mark in MARKS else piece
            simple = piece.isascii()
            if word.isalpha() and (simple or plain(piece)):      # a word, perhaps with one mark behind it
                key = " " + word
                got = words.get(key)
                if got is None:
                    # letters of ASCII are spelled as they are
                    got = b"".join([packed[t.id] for t in tokenize(space + word if simple else spell(key))])
                    if len(key) <= KEPT_CHARS:
                        words[key] = got
                if word is not piece:
                    got += words.get(mark) or self.word(mark)
            elif not piece or piece[0].isspace() or piece[-1].isspace():
                got = None
            elif simple or plain(piece):
                got = b"".join([words.get(w) or self.word(w) for w in self.find(" " + piece)])
            else:
                got = self.whole(" " + piece)
            out.append(got)
        return out

    def head(self, first: str) -> bytes:
        """Ids of a text's first piece, which has no space before it."""
        if first.isascii() or _PLAIN.fullmatch(first):
            return b"".join(map(self.word, self.find(first)))
        return self.whole(first)

    def text(self, text: str | None) -> bytes:
        """The ids of a whole text, without added special tokens."""
        if not text:
            return b""
        if self.special is not None and self.special.search(text):
            return self.whole(text)
        pieces = text.split(" ")
        if self.lower:
            return b"".join(map(self.__getitem__, pieces))
        first = pieces.pop(0)
        if not first or first[0].isspace() or first[-1].isspace():
            return self.whole(text)
        try:
            return self.head(first) + b"".join(map(self.__getitem__, pieces))
        except TypeError:      # a None among the pieces
            return self.whole(text)


    def texts(self, column: pa.Array) -> list[bytes]:
        """``text`` of each value of a string column.

        Each different piece is looked up once, and the ids of all pieces are gathered by their numbers.
        """
        if not len(column):
            return []
        lists = pc.split_pattern(column, " ")
        coded = lists.values.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.get, pieces, itertools.repeat(False)))
        new = [k for k, got in enumerate(ids) if got is False]
        for k, got in zip(new, self.learned([pieces[k] for k in new])):
            ids[k] = got
        ids = [x or b"" for x in ids]
        flat = np.frombuffer(b"".join(ids), "<u2")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        odd = sizes == 0                       # a piece of the byte vocabulary that can be cut out has an id
        firsts = np.cumsum(sizes) - sizes
        starts = lists.offsets.to_numpy().astype(np.int64)
        number = coded.indices.to_numpy()
        each = sizes[number]
        if not self.lower:                     # a text's first piece has no space before it and is looked up apart
            each[starts[:-1][np.diff(starts) > 0]] = 0
            odd_before = np.concatenate([[0], np.cumsum(odd[number])])
            some_odd = odd_before[starts[1:]] > odd_before[np.minimum(starts[:-1] + 1, starts[1:])]
        else:
            some_odd = np.zeros(len(column), bool)
        ends = np.cumsum(each)
        gathered = flat[np.repeat(firsts[number] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        ends = np.concatenate([[0], ends])[starts]
        out = []
        for text, a, b, whole in zip(column.to_pylist(), (2 * ends[:-1]).tolist(), (2 * ends[1:]).tolist(), some_odd.tolist()):
            if not text:
                out.append(b"")
            elif whole or self.special is not None and self.special.search(text):
                out.append(self.text(text))
            elif self.lower:
                out.append(gathered[a:b])
            else:
                first = text[:text.find(" ")] if " " in text else text
                fits = first and not first[0].isspace() and not first[-1].isspace()
                out.append(self.head(first) + gathered[a:b] if fits else self.whole(text))
        return out


def pack(ids: list[int]) -> bytes:
    return array.array("H", ids).tobytes() if sys.byteorder == "little" else struct.pack(f"<{len(ids)}H", *ids)


def words(path: str, **limits: int) -> LibraryWords:
    """The worker's table for a vocabulary file."""
    return held(("words", path, *limits.items()), lambda: LibraryWords(path, **limits))
