"""HTML main text: a linear-chain conditional random field over the leaf blocks of the DOM.

A scan of the markup keeps the stack of open elements and cuts the text into leaf blocks (text between boundaries of
block elements). Each block has features of its ancestors (tags, words of their class, id and role) and of its text
(length, share of link text, sentence ends, capitals and the like). The field has two labels, article or not, with
weights for features and for neighbouring labels; training maximises the likelihood of labelled pages (forward-
backward, page_samples.py), and Viterbi decoding labels the blocks of a page together. The blocks of the article are
joined by line feeds; nothing of them is dropped or cut.

White space inside a block, line breaks (br) included, becomes one space; character references are decoded. Scripts, styles,
templates, comments and the head hold no blocks.

Defined results: null or empty html: empty text. Broken markup: end tags without a start are skipped, elements left open
end with the page, a `<` that starts no tag is text. Elements nested deeper than DEEPEST count as children of the last one
above (their text stays). The scan takes time in proportion to the page, however broken it is. Repeated rows: one result each. Extra columns are kept, unless named
text or n_chars, which the results replace. Empty table: empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.llm.bpe import slices
from docaudit.llm.common import table
from docaudit.llm.page_samples import labelled_page

TRAINING_PAGES = 900
DEEPEST = 512
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
_COMMENT_END, _STOP = re.compile(r"--!?>"), re.compile(r"""[>"']""")
_NAMED = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_PART = re.compile(r"[A-Za-z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}
INVISIBLE = frozenset("script style noscript template head title svg iframe object canvas".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup tt u var wbr br acronym time data".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
#: A start tag ends open elements of these kinds, up to the nearest of the kinds behind the bar.
IMPLIED = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "td": ({"td", "th", "p"}, {"table"}), "th": ({"td", "th", "p"}, {"table"}), "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "option": ({"option"}, {"select"}),
}
_ENDS_P = frozenset("p div ul ol dl table section article aside header footer nav main form h1 h2 h3 h4 h5 h6 blockquote pre figure hr address fieldset".split())


@dataclass(frozen=True)
class Block:
    text: str
    path: tuple[tuple[str, frozenset[str]], ...]
    linked: int


def _names(attributes: str) -> frozenset[str]:
    found: set[str] = set()
    for m in _NAMED.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower():
            found.add("hidden!")
        elif key != "style":
            found.update(x.lower() for x in _PART.findall(value))
    return frozenset(found)


_NONE: frozenset[str] = frozenset()


class Markup:
    """Finds the tags of a page. A tag ends at the first `>` outside quotes; what is learnt of quotes that never close is
    kept, so no stretch of the page is read more than a few times."""

    def __init__(self, page: str) -> None:
        self.page, self.hopeless = page, set()
        self.stop_from, self.stop = 0, -2  # the first of > " ' at or after stop_from; -1: none

    def _next_stop(self, at: int) -> int:
        if self.stop == -2 or at < self.stop_from or -1 < self.stop < at:
            m = _STOP.search(self.page, at)
            self.stop_from, self.stop = at, m.start() if m else -1
        return self.stop

    def _tag_end(self, at: int) -> int:
        """Place behind the `>` that ends the tag whose attributes start here; -1: it never ends."""
        page, opened = self.page, []
        while True:
            at = self._next_stop(at)
            if at < 0 or at in self.hopeless:
                break
            if page[at] == ">":
                return at + 1
            opened.append(at)
            at = page.find(page[at], at + 1) + 1
            if not at:
                break
        self.hopeless.update(opened)
        return -1

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """start, end, name, whether it is an end tag, attributes. Comments and declarations have no name. The caller may
        send a place to go on from."""
        page, at, closes = self.page, 0, True
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("<!--", start):
                m = _COMMENT_END.search(page, start + 4)
                at = m.end() if m else len(page)
                yield start, at, "", False, ""
            elif page[at : at + 1] in ("!", "?"):
                end = page.find(">", at) if closes else -1
                closes = end >= 0
                if closes:
                    at = end + 1
                    yield start, at, "", False, ""
            else:
                ends = page[at : at + 1] == "/"
                name = _NAME.match(page, at + ends)
                end = self._tag_end(name.end()) if name else -1
                if end >= 0:
                    at = (yield start, end, name[0].lower(), ends, page[name.end() : end - 1]) or end


def blocks(page: str | None) -> list[Block]:
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    deeper: dict[str, int] = {}
    pieces: list[str] = []
    linked, links, hidden, done = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(_html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, tuple(stack), linked))
            pieces.clear()
        linked = 0

    def close(keep: int) -> None:
        nonlocal hidden
        for tag, _ in stack[keep:]:
            hidden -= tag in INVISIBLE
        del stack[keep:]

    def say(piece: str) -> None:
        nonlocal linked
        if piece and not hidden:
            pieces.append(piece)
            if links:
                linked += len(piece.strip())

    tags, go_on = Markup(page).tags(), None
    while True:
        try:
            start, end, tag, ends, attributes = tags.send(go_on)
        except StopIteration:
            break
        go_on = None
        say(page[done:start])
        done = end
        if not tag:
            continue
        if ends:
            if tag in INLINE:
                links -= tag == "a" and links > 0
            elif deeper.get(tag):
                deeper[tag] -= 1
                flush()
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        if tag not in INVISIBLE:
                            flush()
                        close(i)
                        break
            continue
        if tag in INLINE:
            links += tag == "a"
            if tag == "br":
                pieces.append(" ")
            continue
        if tag in ("script", "style"):  # their content is no markup
            m = _RAW_END[tag].search(page, end)
            go_on = done = m.end() if m else len(page)
            continue
        if tag not in INVISIBLE:
            flush()
            links = 0
        if tag in _ENDS_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in IMPLIED:
            ended, upto = IMPLIED[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in upto:
                    break
                if stack[i][0] in ended:
                    close(i)
        elif tag == "body":
            close(next((i for i, (t, _) in enumerate(stack) if t == "head"), len(stack)))
        if tag in VOID or attributes.endswith("/"):
            continue
        if len(stack) >= DEEPEST and tag not in INVISIBLE:
            deeper[tag] = deeper.get(tag, 0) + 1
            continue
        stack.append((tag, _names(attributes) if attributes else _NONE))
        hidden += tag in INVISIBLE
    say(page[done:])
    flush()
    return out


@lru_cache(maxsize=50_000)
def _path_features(path: tuple[tuple[str, frozenset[str]], ...]) -> tuple[str, ...]:
    found: list[str] = []
    tags = [t for t, _ in path]
    found += ["in:" + t for t in set(tags[:-1])]
    found.append("tag:" + (tags[-1] if tags else "none"))
    for t, names in path:
        if t not in ("html", "body"):
            found += ["name:" + n for n in names]
    for outer in ("article", "main"):
        if outer in tags:
            inner = tags[tags.index(outer) + 1 :]
            found += [f"{outer}>{t}" for t in set(inner) if t in ("header", "footer", "aside", "nav", "form", "section", "div", "article", "ul", "table")]
    if tags and tags[-1] in ("body", "html"):
        found.append("bare")
    return tuple(dict.fromkeys(found))


def features(page: list[Block]) -> list[list[str]]:
    n = len(page)
    structured = any(t in ("article", "main") for b in page for t, _ in b.path)
    headed = False
    out = []
    for i, b in enumerate(page):
        text, f = b.text, ["bias", *_path_features(b.path)]
        size = len(text)
        f.append(f"size:{min(8, size.bit_length())}")
        share = b.linked / size
        f.append("links:all" if share > 0.9 else "links:many" if share > 0.4 else "links:some" if share > 0 else "links:none")
        f.append("ends" if text[-1] in ".!?\"”" else "open")
        tags = {t for t, _ in b.path}
        if structured:
            f.append("outside" if not tags & {"article", "main"} else "inside")
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("last")
        f.append("headed" if headed else "unheaded")
        headed = headed or any(t == "h1" for t in tags)
        out.append(f)
    return out


@dataclass(frozen=True)
class Field:
    """weights: feature -> weight of 'article' over 'not'; moves[a][b]: weight of label b after a; start: of label 1 first."""

    weights: dict[str, float]
    moves: tuple[tuple[float, float], tuple[float, float]]
    start: float

    def decode(self, page: list[Block]) -> list[int]:
        """Labels of the best sequence (Viterbi)."""
        get, ((m00, m01), (m10, m11)) = self.weights.get, self.moves
        back: list[tuple[int, int]] = []
        low, high = 0.0, self.start
        for i, f in enumerate(features(page)):
            s = sum(get(x, 0.0) for x in f)
            if i:
                back.append((int(high + m10 > low + m00), int(high + m11 >= low + m01)))
                low, high = max(low + m00, high + m10), max(low + m01, high + m11) + s
            else:
                high += s
        if not page:
            return []
        label = int(high > low)
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, main in zip(found, self.decode(found), strict=True) if main)


def train(pages: list[tuple[list[Block], list[int]]], *, steps: int = 200, rate: float = 0.1, ridge: float = 0.02) -> Field:
    """Maximum likelihood by forward-backward and Adam; pages of equal place are advanced together."""
    pages = [p for p in pages if p[0]]
    index: dict[str, int] = {}
    rows, cols, most = [], [], max(len(b) for b, _ in pages)
    gold = np.full((len(pages), most), -1)
    for i, (found, labels) in enumerate(pages):
        gold[i, : len(labels)] = labels
        for t, f in enumerate(features(found)):
            for x in f:
                rows.append(i * most + t)
                cols.append(index.setdefault(x, len(index)))
    rows, cols = np.array(rows), np.array(cols)
    live = gold >= 0
    theta = np.zeros(len(index) + 5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    pair_gold = np.zeros(4)
    for a in (0, 1):
        for b in (0, 1):
            pair_gold[2 * a + b] = ((gold[:, :-1] == a) & (gold[:, 1:] == b)).sum()
    up = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for step in range(1, steps + 1):
        w, moves, start = theta[:-5], theta[-5:-1].reshape(2, 2), theta[-1]
        s = np.bincount(rows, w[cols], len(pages) * most).reshape(len(pages), most)
        emit = np.stack([np.zeros_like(s), s], axis=2)
        alpha, beta = np.zeros((len(pages), most, 2)), np.zeros((len(pages), most, 2))
        alpha[:, 0] = emit[:, 0] + np.array([0.0, start])
        for t in range(1, most):
            new = up(alpha[:, t - 1, :, None] + moves, 1) + emit[:, t]
            alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            new = up(moves + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], new, 0.0)
        total = up(alpha[:, -1], 1)
        p1 = np.where(live, np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None]), 0.0)
        wrong = np.where(live, (gold == 1) - p1, 0.0)
        gradient = np.zeros_like(theta)
        gradient[:-5] = np.bincount(cols, wrong.ravel()[rows], len(index))
        pair = np.exp(alpha[:, :-1, :, None] + moves + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
        gradient[-5:-1] = pair_gold - np.where(live[:, 1:, None, None], pair, 0.0).sum(axis=(0, 1)).ravel()
        gradient[-1] = wrong[:, 0].sum()
        gradient = gradient - ridge * len(pages) / 10 * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    m = theta[-5:-1].reshape(2, 2).tolist()
    return Field(dict(zip(index, theta[:-5].tolist(), strict=True)), (tuple(m[0]), tuple(m[1])), float(theta[-1]))


def training_pages(n: int = TRAINING_PAGES, seed: int = 0) -> list[tuple[list[Block], list[int]]]:
    out = []
    for i in range(n):
        page, labels = labelled_page(seed + i)
        found = blocks(page)
        if len(found) == len(labels):
            out.append((found, labels))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(training_pages())


def extract(pages: DataFrame, field: Field | None = None, *, html_col: str = "html") -> DataFrame:
    """pages with text, and n_chars in code points."""
    field = field or default_field()
    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    at = rest.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, 1 << 22):
                texts = [field.text(x.as_py()) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    schema = T.StructType([pages.schema[c] for c in rest] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
