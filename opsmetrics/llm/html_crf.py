"""Main text of web pages by a linear-chain conditional random field (operator 6).

A page is cut into DOM leaf blocks: runs of text between block-level tags, in page order. Each
block has features of its place (the tags around it, the words in their class, id and role
attributes, its own tag) and of its text (length, share of text inside links, marks at its end, what
it begins with). A conditional random field with two labels, main text and the rest, scores
the features of each block and the step from one label to the next, so a short paragraph between
two long ones is read in their light. Viterbi's algorithm finds the best labelling, and the blocks
labelled main text are joined.

The model is trained on labelled pages: ``training_pages`` writes them by rule from the parts that pages
have (menus, headers, notices, adverts, forms, sidebars, comments, footers, articles in various
containers, inline markup, character references, tags left open), with the label of each text
in a ``data-main`` attribute that is read in training only. A caller may bring other labelled pages.

Text: character references are decoded, white space inside a block becomes one space, blocks are
joined by a blank line. Scripts, styles, comments of the markup, buttons, and what isn't shown (head, template,
noscript, option lists, svg, frames, fallbacks of media, elements with the attribute ``hidden`` or a style without
display or visibility) are no blocks; what isn't shown ends at
its end tag, at a "/" at the end of its tag, or where the element around it ends. The head ends
at the first text or tag that can't stand in it. The text of formulas is kept. Nothing is cut off or dropped for its length.

Cases: null or empty html, and pages without main text, give the empty text (0 characters). Tags
left open or closed twice, a missing body or end of the page, and plain text without tags are
read as browsers do, roughly: an end tag closes the nearest open tag of its name. A page of a million
characters is read in one pass, whatever it holds. Repeated rows are extracted
each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.common import cut

# Element names of HTML.
RAW = frozenset("script style iframe textarea title".split())       # no tags inside; without an end tag they reach to the end of the page
HIDDEN = frozenset("noscript template svg object select button datalist canvas audio video annotation annotation-xml".split())
HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr "
                   "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover "
                   "munderover mmultiscripts mprescripts mtable mtr mtd mlabeledtr mspace maction none semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open tag of these names that stands innermost among the blocks.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_MARKUP = re.compile(r"<(?:(!--)|[!?])")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/]|$)", re.I)


class Block:
    __slots__ = ("text", "path", "marks", "tag", "linked", "label")

    def __init__(self, text: str, path: tuple, marks: tuple, tag: str, linked: float, label: int):
        self.text, self.path, self.marks, self.tag, self.linked, self.label = text, path, marks, tag, linked, label


class Scanner:
    """Finds the tags of a page from left to right, in linear time whatever the page holds.

    A quote delimits an attribute's value behind a "=" only; one that is never closed is an ordinary character. So a
    tag name with a ">" anywhere behind it always gives a tag, and what was looked at is never looked at again.
    """

    def __init__(self, page: str):
        self.page = page
        self.no_more: set[str] = set()           # quotes that don't occur any further

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """Start, end, whether it closes, name in lower case (None for comments and the like) and attributes of the next tag."""
        page, n = self.page, len(self.page)
        m = _OPEN.search(page, at)
        if m and m[4]:
            end = self.end(m.end())
            if end < 0:                          # no ">" any more: no tags, but markup may still hide the rest
                m = _MARKUP.search(page, m.end())
            else:
                return m.start(), end, bool(m[3]), m[4].lower(), page[m.end():end - 1]
        if not m:
            return None
        k = page.find("-->" if m[1] else ">", m.end())
        return m.start(), n if k < 0 else k + (3 if m[1] else 1), False, None, ""

    def end(self, at: int) -> int:
        """Behind the ">" that ends a tag whose name ends at ``at``; -1 if there is none."""
        page = self.page
        while m := _STOP.search(page, at):
            k, c = m.start(), m[0]
            if c == ">":
                return k + 1
            back = k - 1
            while back >= at and page[back].isspace():
                back -= 1
            at = k + 1
            if back >= 0 and page[back] == "=" and c not in self.no_more:
                close = page.find(c, k + 1)
                if close < 0:
                    self.no_more.add(c)
                else:
                    at = close + 1
        return -1

    def behind(self, name: str, at: int) -> int:
        """Behind the end tag of a raw element, or the end of the page."""
        close = re.compile(rf"</{re.escape(name)}\b", re.I).search(self.page, at)
        k = self.page.find(">", close.end()) if close else -1
        return k + 1 if k >= 0 else len(self.page)


_TOP: tuple = ((), (), "", 0)


def inside(state: tuple, name: str, words: list[str], label: int) -> tuple:
    """Names and words of attributes around a block, its own tag and label, one element further in."""
    names, marks, _, above = state
    if name not in names:
        names = (*names, name)
    if words:
        marks = tuple(dict.fromkeys((*marks, *words)))
    return names, marks, name, max(above, label)


def not_shown(attributes: str, found: list[tuple]) -> bool:
    """Whether an element's attributes hide it: ``hidden``, or a style without display or visibility."""
    for key, *values in found:
        if key.lower() == "style" and _NOT_SHOWN.search("".join(values)):
            return True
    return "hidden" in attributes.lower() and bool(_HIDDEN.search(_ATTRIBUTE.sub(lambda m: " hidden " if m[1].lower() == "hidden" else " ", attributes)))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; label is 1 below an element with a data-main attribute."""
    out: list[Block] = []
    stack: list[tuple[str, tuple, list, int]] = []     # name, state inside, words of its attributes, label
    opened: dict[str, int] = {}                  # how often a name is on the stack
    parts: list[str] = []
    in_link = ""
    link_chars = 0
    state: tuple = _TOP
    n = len(page)
    scan = Scanner(page)

    def flush():
        nonlocal parts, link_chars, in_link
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path, marks, tag, label = state
                out.append(Block(text, path, marks, tag, min(1.0, link_chars / len(text)), label))
            parts = []
        link_chars, in_link = 0, ""

    def push(name: str, words: list[str] = [], label: int = 0):  # noqa: B006
        stack.append((name, inside(stack[-1][1] if stack else _TOP, name, words, label), words, label))
        opened[name] = opened.get(name, 0) + 1

    def cut_to(k: int):
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]

    def innermost(name: str) -> int:
        """Its place on the stack, -1 if it isn't open."""
        if not opened.get(name):
            return -1
        return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)

    def settle():
        nonlocal state
        state = stack[-1][1] if stack else _TOP

    at = 0
    in_head = False
    hidden = -1                                  # place in the stack of the outermost element that isn't shown

    def leave_head():
        nonlocal in_head
        if opened.get("head"):
            rest = [x for x in stack if x[0] != "head"]
            cut_to(0)
            for name, _, words, label in rest:
                push(name, words, label)
        in_head = False

    while at < n:
        tag = scan.next(at)
        end = tag[0] if tag else n
        if end > at and hidden < 0:
            piece = page[at:end]
            if in_head and piece.strip():
                leave_head()
            if not in_head:
                parts.append(piece)
                if in_link:
                    link_chars += len(piece)
        if not tag:
            break
        _, at, closing, name, attributes = tag
        if name is None:
            continue
        empty = attributes.rstrip().endswith("/")
        if in_head and hidden < 0 and not closing and name not in HEAD:
            leave_head()
            settle()
        if not closing and name in RAW:
            if not (empty and opened.get("svg")):
                at = scan.behind(name, at)
            continue
        found = _ATTRIBUTE.findall(attributes) if not closing and "=" in attributes else []
        unseen = name in HIDDEN or not closing and bool(attributes) and not_shown(attributes, found)
        if hidden >= 0 or unseen:                # no block begins or ends, unless the element around ends
            if closing:
                k = innermost(name)
                if hidden >= 0 and k >= hidden:
                    cut_to(k)
                    hidden = hidden if k > hidden else -1
                if hidden < 0 or k < 0 or k >= hidden:
                    continue
            else:
                if name not in VOID and not empty and (name not in INLINE or unseen):
                    if hidden < 0:
                        hidden = len(stack)
                    push(name)
                continue
        if name in INLINE:
            if name == "a":
                in_link = "" if closing else "a"
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID and name != "hr":
            continue
        flush()
        if closing:
            if (k := innermost(name)) >= 0:
                cut_to(k)
            hidden = hidden if hidden < len(stack) else -1
            in_head = in_head and bool(opened.get("head"))
        elif name != "hr":
            while stack and stack[-1][0] in CLOSES.get(name, ()):
                cut_to(len(stack) - 1)
            if stack and stack[-1][0] == "p":
                cut_to(len(stack) - 1)           # a block ends an open paragraph
            if name == "body":
                leave_head()
            words: list[str] = []
            label = 0
            for key, *values in found:
                key = key.lower()
                if key in ("class", "id", "role", "aria-label"):
                    words += _WORD.findall("".join(values).lower())
                elif key == "data-main":
                    label = 1
            if not empty:
                push(name, words, label)
                in_head = in_head or name == "head"
        settle()
    flush()
    return out


PARTS = frozenset("article aside nav footer header main form section".split())
_BUCKETS = (15, 30, 60, 120, 240, 480)


def features(b: Block) -> tuple[str, ...]:
    """Names of what holds for a block."""
    text = b.text
    size = sum(len(text) > x for x in _BUCKETS)
    found = [f"in {x}" for x in b.path] + [f"mark {x}" for x in b.marks]
    # the innermost part of the page that the block stands in, and the innermost words of attributes
    found.append("part " + next((x for x in reversed(b.path) if x in PARTS), ""))
    if b.marks:
        found.append(f"nearest {b.marks[-1]}")
    found += [f"tag {b.tag}", f"size {size}", f"linked {0 if b.linked == 0 else 1 if b.linked < 0.5 else 2}"]
    found.append("ends " + ("sentence" if text[-1] in ".!?…。\"”»" else "colon" if text[-1] in ":," else "word"))
    found.append("begins " + ("copyright" if text[0] in "©®" else "digit" if text[0].isdigit() else "letter" if text[0].isalpha() else "other"))
    return tuple(found)


def train(pages: list[str], steps: int = 250, rate: float = 0.1, decay: float = 3e-4) -> dict:
    """Weights of the field, by gradient ascent on the likelihood of the pages' labels."""
    seqs = [s for s in (blocks(p) for p in pages) if s]
    names = sorted({f for s in seqs for b in s for f in features(b)})
    index = {f: k for k, f in enumerate(names)}
    n, longest = len(seqs), max(map(len, seqs))
    at, row = [], []
    y = np.zeros((n, longest), int)
    on = np.zeros((n, longest), bool)
    for i, s in enumerate(seqs):
        for j, b in enumerate(s):
            f = [index[x] for x in features(b)]
            at += f
            row += [i * longest + j] * len(f)
            y[i, j], on[i, j] = b.label, True
    at, row = np.array(at), np.array(row)
    rows = n * longest
    w, step, start = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    m = [np.zeros_like(x) for x in (w, step, start)]
    v = [np.zeros_like(x) for x in (w, step, start)]
    truth = np.zeros((n, longest, 2))
    np.put_along_axis(truth, y[:, :, None], 1.0, 2)
    truth *= on[:, :, None]
    pairs = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
    for t in range(1, steps + 1):
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = np.bincount(row, w[at], rows).reshape(n, longest)
        a = np.zeros((n, longest, 2))
        a[:, 0] = e[:, 0] + start
        for j in range(1, longest):
            nxt = np.logaddexp(a[:, j - 1, :1] + step[0], a[:, j - 1, 1:] + step[1]) + e[:, j]
            a[:, j] = np.where(on[:, j, None], nxt, a[:, j - 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        back = np.zeros((n, 2))
        seen = np.zeros((n, longest, 2))
        moved = np.zeros((2, 2))
        for j in range(longest - 1, -1, -1):
            seen[:, j] = np.exp(a[:, j] + back - z[:, None]) * on[:, j, None]
            if j:
                ahead = e[:, j] + back
                both = np.exp(a[:, j - 1, :, None] + step[None] + ahead[:, None, :] - z[:, None, None]) * on[:, j, None, None]
                moved += both.sum(0)
                nxt = np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:])
                back = np.where(on[:, j, None], nxt, back)
        g = [np.bincount(at, (truth - seen)[:, :, 1].reshape(-1)[row], len(names)) / n - decay * w,
             (pairs - moved) / n - decay * step, (truth[:, 0] - seen[:, 0]).sum(0) / n]
        for k, x in enumerate((w, step, start)):
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            x += rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-6)
    return {"weights": dict(zip(names, w.tolist())), "step": step.tolist(), "start": start.tolist()}


class Extractor:
    def __init__(self, model: dict):
        self.weights, self.step, self.start = model["weights"], model["step"], model["start"]
        self.seen: dict[tuple, float] = {}

    def emission(self, b: Block) -> float:
        f = features(b)
        got = self.seen.get(f)
        if got is None:
            if len(self.seen) > 50_000:
                self.seen.clear()
            got = self.seen[f] = sum(self.weights.get(x, 0.0) for x in f)
        return got

    def labels(self, seq: list[Block]) -> list[int]:
        """Viterbi's best labelling."""
        if not seq:
            return []
        (s00, s01), (s10, s11) = self.step
        a, b = self.start[0], self.start[1] + self.emission(seq[0])
        back: list[tuple[int, int]] = []
        for x in seq[1:]:
            from0, from1 = int(b + s10 > a + s00), int(b + s11 > a + s01)
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + self.emission(x)
            back.append((from0, from1))
        out = [int(b > a)]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]

    def text(self, page: str | None) -> str:
        seq = blocks(page or "")
        return "\n\n".join(b.text for b, y in zip(seq, self.labels(seq)) if y)


def training_pages(n: int = 600, seed: int = 7) -> list[str]:
    """Labelled pages written by rule: parts of pages in many arrangements, pseudo-words as text."""
    r = random.Random(seed)
    syllables = "ka lo mi ren ta su vel dor an es ti ou qua ber sen ü é ñ ß ch gra pol".split()

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.choice((1, 2, 2, 3, 4))))

    def words(low: int, high: int) -> str:
        out = [word() for _ in range(r.randint(low, high))]
        if r.random() < 0.15:
            out[r.randrange(len(out))] = r.choice(("&amp;", "&lt;x&gt;", "&quot;ta&quot;", "***", "###", "a|b", "&#233;te", "%%%"))
        if r.random() < 0.1:
            k = r.randrange(len(out))
            out[k] = f"<{(t := r.choice(('b', 'em', 'i', 'span', 'code')))}>{out[k]}</{t}>"
        return " ".join(out)

    def sentences(low: int, high: int) -> str:
        return " ".join(words(3, 14).capitalize() + r.choice("...!?") for _ in range(r.randint(low, high)))

    def link() -> str:
        return f'<a href="/{word()}">{words(1, 3)}</a>'

    def listing(low: int, high: int, sep: str = "") -> str:
        return "<ul>" + "".join(f"<li>{link()}{sep}</li>" for _ in range(r.randint(low, high))) + "</ul>"

    def div(names: str, inner: str, tag: str = "div") -> str:
        return f'<{tag} {r.choice(("class", "id", "class"))}="{r.choice(names.split())}">{inner}</{tag}>'

    def notice() -> str:
        return div("cookie-notice cookies notice cookie-banner consent gdpr alert banner-notice newsletter-notice",
                   r.choice((f"<p>{sentences(1, 3)}</p>", sentences(1, 2)) ) + r.choice(("<button>OK</button>", "<a href='#'>OK</a>", "")), r.choice(("div", "div", "section")))

    def advert() -> str:
        return div("ad ads advert advertisement ad-banner sponsored promo ad-slot sponsor", r.choice((sentences(1, 2), f"<p>{sentences(1, 2)}</p>", link())), r.choice(("div", "div", "aside", "section")))

    def menu() -> str:
        return r.choice((f"<nav>{listing(3, 9)}</nav>", div("menu nav navbar navigation breadcrumb topnav", listing(3, 9)),
                         f"<nav>{link()} | {link()} | {link()}</nav>", div("breadcrumbs menu", f"{link()} &gt; {link()}")))

    def header() -> str:
        inner = r.choice((f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 6)}</p>", words(1, 4), f"<div class=logo>{link()}</div>"))
        return r.choice((f"<header>{inner}</header>", f"<header>{inner}{menu()}</header>", div("header masthead top site-header", inner)))

    def sidebar() -> str:
        inner = r.choice(("", f"<h3>{words(1, 3)}</h3>")) + r.choice((listing(3, 8), f"<p>{sentences(1, 3)}</p>", f"<p>{words(3, 9)}</p>" + listing(2, 4)))
        return r.choice((f"<aside>{inner}</aside>", div("sidebar side widget related related-posts sidebar-right", inner, r.choice(("div", "aside", "section")))))

    def form() -> str:
        return r.choice((f"<form><label>{words(1, 3)}</label><input name=q><button>{word()}</button></form>",
                         f"<form class=search><p>{words(2, 8)}</p><input type=text></form>",
                         div("subscribe newsletter signup search login", f"<form><p>{sentences(1, 2)}</p><input><button>{word()}</button></form>")))

    def comments() -> str:
        one = lambda: div("comment comment-body reply", f"<p>{sentences(1, 4)}</p>" if r.random() < 0.7 else sentences(1, 3), r.choice(("div", "li", "article")))
        return div("comments comment-list responses discussion comments-area", r.choice(("", f"<h3>{words(1, 2)}</h3>")) + "".join(one() for _ in range(r.randint(1, 5))), r.choice(("div", "section", "section")))

    def footer() -> str:
        inner = r.choice((f"&copy; {word()}.example &middot; {sentences(1, 3)}", f"<p>&copy; 2020 {words(1, 4)}</p>{listing(2, 4)}", f"<p>{sentences(1, 3)}</p>", words(3, 9)))
        return r.choice((f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", div("footer site-footer copyright bottom legal", inner)))

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.62:
            return f"<p data-main=1>{sentences(1, 7)}</p>"
        if kind < 0.72:
            return f"<p data-main=1>{words(1, 4).capitalize()}.</p>"
        if kind < 0.78:
            return f"<p data-main=1><b>{sentences(1, 3)}<br>"       # tags left open
        if kind < 0.84:
            return f"<h2 data-main=1>{words(1, 6)}</h2>"
        if kind < 0.89:
            return "<ul data-main=1>" + "".join(f"<li>{words(2, 12)}{r.choice(('', '.'))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.93:
            return f"<blockquote data-main=1><p>{sentences(1, 3)}</p></blockquote>"
        if kind < 0.96:
            return f"<p data-main=1>{sentences(1, 2)} {link()} {sentences(1, 2)}</p>"
        return f"<p data-main=1>{words(2, 9)}</p>"

    def plain() -> str:
        """An article without names or paragraphs: text in bare elements, broken by line breaks."""
        one = lambda: "<div data-main=1>" + "<br><br>".join(sentences(2, 7) for _ in range(r.randint(1, 4))) + "</div>"
        inner = "".join(one() for _ in range(r.randint(1, 5)))
        if r.random() < 0.5:
            inner = f"<h1 data-main=1>{words(2, 9)}</h1>" + inner
        return r.choice((f"<div>{inner}</div>", f"<div><div>{inner}</div></div>", inner, f"<table><tr><td>{inner}</td></tr></table>"))

    def article() -> str:
        if r.random() < 0.15:
            return plain()
        parts = [f"<h1 data-main=1>{words(1, 14)}</h1>"] if r.random() < 0.9 else []
        parts += [paragraph() for _ in range(r.choice((0, 1, 2, 3, 5, 8, 12, 20)) + (not parts))]
        for extra, chance in ((advert, 0.3), (sidebar, 0.12), (form, 0.1), (comments, 0.1), (notice, 0.06)):
            if r.random() < chance:
                parts.insert(r.randint(1, len(parts)), extra())
        inner = "".join(parts)
        return r.choice((f"<article>{inner}</article>",) * 4 + (f"<main>{inner}</main>", f"<main><article>{inner}</article></main>",
                        div("content post entry article main-content post-body story", inner), f"<div id=main><div class=content>{inner}</div></div>"))

    def page() -> str:
        some = lambda part, chance: part() if r.random() < chance else ""
        body = (some(notice, 0.35) + some(header, 0.45) + some(menu, 0.8) + some(notice, 0.1) + some(advert, 0.5) + some(sidebar, 0.2) + some(form, 0.15)
                + article() + some(advert, 0.2) + some(comments, 0.45) + some(sidebar, 0.35) + some(form, 0.2) + some(notice, 0.1) + some(footer, 0.9))
        return f"<!DOCTYPE html><html><head><title>{words(1, 9)}</title><style>p{{}}</style></head><body>{body}" + r.choice(("</body></html>", ""))

    return [page() for _ in range(n)]


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train(training_pages()))
    key = pages.schema["page_id"].dataType.simpleString()

    def run(it):
        x = Extractor(shared.value)
        for b in cut(it, "html"):
            texts = [x.text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return (pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
            .mapInArrow(run, f"page_id {key}, url string, text string, n_chars bigint"))
