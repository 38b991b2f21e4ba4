"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import LAYOUTS, PAGES, SEED, labelled_pages
from .scratch import small_batches
from .tables import table

#: A tag behind its "<": closing or not, name, attributes. Possessive, so that it never looks back.
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>")
_STOP = re.compile(r"[>\"']")
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Elements whose content is no text of the page.
_SILENT = {"script", "style", "noscript", "template", "title", "textarea", "head", "svg", "iframe", "select", "object", "canvas"}
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that stay within a block.
_INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening one of these ends an open one of the same group.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What may stand in a head; anything else ends it, as its end tag may be left out.
_IN_HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: Elements that end an open select or svg, and an object or canvas without an end tag.
_BREAKS = set("address article aside blockquote body center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table ul".split())
_FOREIGN_TEXT = ("foreignobject", "desc")


@dataclass(slots=True)
class Block:
    """A leaf block: text between two block boundaries, its ancestors' features, and the share of linked text."""

    text: str
    path: tuple[str, ...]
    leaf: str
    linked: float


def _tag_end(page: str, at: int) -> int:
    """Position behind the tag that starts before ``at``; a quote without its partner is an ordinary character."""
    while m := _STOP.search(page, at):
        if m.group() == ">":
            return m.end()
        partner = page.find(m.group(), m.end())
        at = m.end() if partner < 0 else partner + 1
    return len(page)


def blocks(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks of a page in order; texts are decoded, white space is one space each, empty ones are left out.

    Ancestor features are held to ``known`` ones, if given. Time grows with the length of the page
    whatever its markup. A head ends where something begins that can't stand in it, a select and a drawing at a block element, and so do
    object and canvas if no end tag of theirs follows in the page. A tag, comment or script without an end reaches to the end of the page, and what
    a block needs of its ancestors is kept with the open elements.
    """
    page = page or ""
    found: list[Block] = []
    #: Open elements: name, ancestor features, innermost block element; and how many are open of each name.
    stack: list[tuple[str, tuple[str, ...], str]] = [("", (), "")]
    count: dict[str, int] = {}
    silent = 0
    parts: list[str] = []
    linked = 0
    at, end = 0, len(page)

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                found.append(Block(text, stack[-1][1], stack[-1][2], min(1.0, linked / len(text))))
            parts, linked = [], 0

    def said(raw: str) -> None:
        nonlocal linked
        if stack[-1][0] == "head" and raw.strip():
            pop()
        if raw and not silent:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if count.get("a"):
                linked += len(text)

    def pop() -> None:
        nonlocal silent
        tag = stack.pop()[0]
        count[tag] -= 1
        silent -= tag in _SILENT

    last_end: dict[str, int] = {}

    def left_open(tag: str) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)), default=-1)
        return last_end[tag] < at

    def leave(tag: str) -> None:
        while count.get(tag):
            pop()

    while at < end:
        less = page.find("<", at)
        if less < 0:
            said(page[at:])
            break
        said(page[at:less])
        mark = page[less + 1 : less + 2]
        if mark in ("!", "?"):
            comment = page.startswith("!--", less + 1)
            stop = page.find("-->" if comment else ">", less + 2 + 2 * comment)
            at = end if stop < 0 else stop + (3 if comment else 1)
            continue
        if not (mark.isascii() and (mark.isalpha() or (mark == "/" and page[less + 2 : less + 3].isalpha()))):
            said("<")
            at = less + 1
            continue
        if m := _TAG.match(page, less + 1):
            closing, tag, rest = m.groups()
            at = m.end()
        else:
            closing, rest = mark == "/", ""
            tag = re.match(r"/?([^\s/>]*)", page[less + 1 : less + 64]).group(1)
            at = _tag_end(page, less + 1 + len(tag))
        tag = tag.lower()
        if not closing:
            if tag == "body":
                leave("head")
            elif stack[-1][0] == "head" and tag not in _IN_HEAD:
                pop()
            if tag in _BREAKS and silent:
                leave("select")
                if not any(count.get(t) for t in _FOREIGN_TEXT):
                    leave("svg")
                for t in ("object", "canvas"):
                    if count.get(t) and left_open(t):
                        leave(t)
        if tag == "br":
            said(" ")
            continue
        if tag not in _INLINE:
            close()
        if closing:
            if count.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _VOID or rest.endswith("/"):
            continue
        if tag in _CLOSES:
            k = len(stack) - 1
            while k > 0 and stack[k][0] in _INLINE:
                k -= 1
            if stack[k][0] in _CLOSES[tag]:
                while len(stack) > k:
                    pop()
        names = [f"tag={tag}"]
        for n in _NAME.findall(rest):
            names += [f"name={p}" for p in _PART.findall("".join(n).lower())]
        path = stack[-1][1]
        if new := [n for n in dict.fromkeys(names) if n not in path and (known is None or n in known)]:
            path = (*path, *new)
        stack.append((tag, path, stack[-1][2] if tag in _INLINE else tag))
        count[tag] = count.get(tag, 0) + 1
        silent += tag in _SILENT
        if tag in _RAW:
            stop = _RAW[tag].search(page, at)
            at = stop.start() if stop else end
    close()
    return found


def features(block: Block) -> list[str]:
    """Ancestor and text features of a block."""
    words = block.text.count(" ") + 1
    out = ["bias", *block.path, f"leaf={block.leaf}", f"words={min(6, int(math.log2(words)))}", f"linked={int(block.linked * 3)}"]
    if block.text[-1] in ".!?":
        out.append("ends")
    if "©" in block.text or "·" in block.text:
        out.append("legal")
    return list(dict.fromkeys(out))


def _size(words: float) -> int:
    return min(6, int(math.log2(words + 1)))


def page_features(page: list[Block]) -> list[list[str]]:
    """Features of all blocks of a page: their own, and what carries over to layouts with other elements and names: length and links of
    the blocks around, and the place in the page."""
    words = [b.text.count(" ") + 1 for b in page]
    upto, linked = [0], [0.0]
    for n, b in zip(words, page, strict=True):
        upto.append(upto[-1] + n)
        linked.append(linked[-1] + n * b.linked)
    out = []
    for k, b in enumerate(page):
        lo, hi = max(0, k - 2), min(len(page), k + 3)
        around = upto[hi] - upto[lo]
        more = [f"around={_size(around / (hi - lo))}", f"around_linked={int((linked[hi] - linked[lo]) / around * 3)}", f"place={k * 5 // len(page)}"]
        if k:
            more.append(f"before={_size(words[k - 1])}")
        if k + 1 < len(page):
            more.append(f"after={_size(words[k + 1])}")
        out.append([*features(b), *more])
    return out


@dataclass(frozen=True)
class Field:
    """Weights of label 1 by feature; moves[a, b] and first[b] weigh label b after label a and at the start."""

    weights: dict[str, float]
    moves: np.ndarray
    first: np.ndarray
    known: frozenset[str]

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not page:
            return []
        weight = self.weights.get
        (m00, m01), (m10, m11) = self.moves.tolist()
        back = []
        emit = [sum(weight(f, 0.0) for f in own) for own in page_features(page)]
        s0, s1 = float(self.first[0]), float(self.first[1]) + emit[0]
        for e in emit[1:]:
            from0, from1 = s1 + m10 > s0 + m00, s1 + m11 > s0 + m01
            back.append((from0, from1))
            s0, s1 = (s1 + m10 if from0 else s0 + m00), (s1 + m11 if from1 else s0 + m01) + e
        label = int(s1 > s0)
        out = [label]
        for from0, from1 in reversed(back):
            label = int(from1 if label else from0)
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[str, list[tuple[str, int]]]], rounds: int = 200, rate: float = 0.1, decay: float = 1e-4) -> Field:
    """Maximum likelihood by forward and backward sums over all pages at once, Adam steps, weight decay.

    Every page is a list of blocks with labels; blocks() must find the same texts.
    """
    seen = [blocks(h) for h, _ in pages]
    names = sorted({f for page in seen for own in page_features(page) for f in own})
    place = {f: k for k, f in enumerate(names)}
    n, length = len(seen), max(map(len, seen))
    x = np.zeros((n, length, len(names)), np.float32)
    y, there = np.zeros((n, length), int), np.zeros((n, length), bool)
    for p, (page, (_, labels)) in enumerate(zip(seen, pages, strict=True)):
        clean = [(_SPACE.sub(" ", t).strip(), k) for t, k in labels]
        if [b.text for b in page] != [t for t, _ in clean]:
            raise ValueError("blocks of a labelled page don't agree with its labels")
        for t, (own, (_, k)) in enumerate(zip(page_features(page), clean, strict=True)):
            x[p, t, [place[f] for f in own]] = 1
            y[p, t], there[p, t] = k, True
    flat = x[there]
    theta = np.zeros(len(names) + 6)
    first_m, second_m = np.zeros_like(theta), np.zeros_like(theta)
    log_add = np.logaddexp
    truth_moves = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & there[:, 1:]).sum() for b in (0, 1)] for a in (0, 1)])
    truth_first = np.array([(y[:, 0] == b).sum() for b in (0, 1)])
    for step in range(1, rounds + 1):
        w, moves, first = theta[: len(names)], theta[len(names) : -2].reshape(2, 2), theta[-2:]
        emit = np.zeros((n, length, 2))
        emit[there, 1] = flat @ w
        ahead, behind = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        ahead[:, 0] = first + emit[:, 0]
        for t in range(1, length):
            after = log_add(ahead[:, t - 1, :1] + moves[0], ahead[:, t - 1, 1:] + moves[1]) + emit[:, t]
            ahead[:, t] = np.where(there[:, t, None], after, ahead[:, t - 1])
        total = log_add(ahead[:, -1, 0], ahead[:, -1, 1])
        for t in range(length - 2, -1, -1):
            nxt = emit[:, t + 1] + behind[:, t + 1]
            before = log_add(moves[:, 0] + nxt[:, :1], moves[:, 1] + nxt[:, 1:])
            behind[:, t] = np.where(there[:, t + 1, None], before, 0.0)
        here = np.exp(ahead + behind - total[:, None, None])
        pair = ahead[:, :-1, :, None] + moves + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]
        expected = np.exp(pair)[there[:, 1:]].sum(0)
        grad = np.concatenate([flat.T @ (y[there] - here[there][:, 1]), (truth_moves - expected).ravel(), truth_first - here[:, 0].sum(0)]) / n - decay * theta
        first_m, second_m = 0.9 * first_m + 0.1 * grad, 0.999 * second_m + 0.001 * grad**2
        theta = theta + rate * (first_m / (1 - 0.9**step)) / (np.sqrt(second_m / (1 - 0.999**step)) + 1e-8)
    k = len(names)
    return Field(dict(zip(names, theta[:k].tolist(), strict=True)), theta[k:-2].reshape(2, 2), theta[-2:], frozenset(names))


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page, field.known)
    return "\n".join(b.text for b, k in zip(found, field.decode(found), strict=True) if k)


def extracted(pages: DataFrame, field: Field) -> DataFrame:
    """``pages`` (with a string column html) without it, plus text: its main blocks joined by line breaks.

    A null or empty page, or one without main blocks, gives an empty text. A column text of ``pages`` is replaced.
    """
    small_batches(pages.sparkSession)
    pages = pages.drop("text").withColumn("html", F.col("html").cast("string"))
    kept = [c for c in pages.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(h.as_py(), field) for h in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), text], names=[*kept, "text"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema if f.name != "html")
    return pages.mapInArrow(run, f"{schema}text string")


@lru_cache(maxsize=1)
def standard_field() -> Field:
    """The field trained on PAGES labelled pages of all LAYOUTS, once per process."""
    return train(labelled_pages(PAGES, SEED, LAYOUTS))


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages, by a field trained on a fixed number of labelled pages."""
    out = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"), standard_field())
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
