"""Benchmark decontamination with an Aho-Corasick automaton over the benchmark's words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches
from .shingles import mixed, word_hashes
from .tables import table

#: Words in a window, and characters of benchmark text in one automaton, which takes some 30 bytes a character.
WINDOW, AUTOMATON_CHARS = 10, 4_000_000
#: Automata at most, which all workers hold at once; a larger benchmark is joined by hashes of windows instead.
AUTOMATA = 4

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A-Z to a-z; what isn't a word's byte to space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


def rolled(values: np.ndarray, starts: np.ndarray, size: int, odd: int) -> np.ndarray:
    """64-bit hashes of the ``size`` values from each start on."""
    power = np.cumprod(np.full(len(values) + 1, odd, np.uint64)) * np.uint64(pow(odd, -1, 1 << 64))
    back = np.cumprod(np.full(len(values) + 1, pow(odd, -1, 1 << 64), np.uint64)) * np.uint64(odd)
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * power[:-1])])
    return mixed((total[starts + size] - total[starts]) * back[starts] + np.uint64(size))


class Windows:
    """The windows of a block of items, found in texts by one automaton over numbers of words.

    A window of ``size`` words holds, wherever it lies in its item, one whole part of half its length that starts at a multiple of it. The automaton has these parts only, so as many
    nodes as words, and items of fewer words as wholes. Where a part is found, the windows of the text around it are looked up by a hash among those of the items, and compared word by word.
    """

    def __init__(self, items: tuple[tuple[str, str], ...], size: int) -> None:
        self.size, self.part = size, (size + 1) // 2
        self.names = sorted({item for item, _ in items})
        name_of = {item: k for k, item in enumerate(self.names)}
        self.number: dict[bytes, int] = {}
        keys: dict[tuple[int, ...], set[int] | None] = {}
        flat: list[np.ndarray] = []
        starts, owners, at = [], [], 0
        for item, text in sorted(set(items)):
            w = np.array([self.number.setdefault(x, len(self.number) + 1) for x in words_of(text)], np.int64)
            if len(w) >= size:
                starts.append(np.arange(at, at + len(w) - size + 1))
                owners.append(np.full(len(w) - size + 1, name_of[item]))
                for k in range(0, len(w) - self.part + 1, self.part):
                    keys.setdefault(tuple(w[k : k + self.part].tolist()), set())
            elif len(w):
                keys.setdefault(tuple(w.tolist()), set()).add(name_of[item])
            flat.append(w)
            at += len(w)
        self.flat = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        places, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, owners))
        h = rolled(mixed(self.flat.astype(np.uint64)), places, size, _ODD[0])
        order = np.lexsort((owner, h))
        h, places, owner = h[order], places[order], owner[order]
        #: Distinct hashes, where a window of each begins, and the items of each, one after the other.
        self.hashes, first = np.unique(h, return_index=True)
        self.places, self.owner, self.bounds = places[first], owner, np.append(first, len(h))
        self.long = len(h) > 0
        self.automaton = None
        if keys:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, short in keys.items():
                self.automaton.add_word(key, (len(key), tuple(sorted(short))))
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(first word and size of each window found, items found) in the words of a text."""
        if self.automaton is None:
            return [], set()
        get = self.number.get
        numbers = [get(w, 0) for w in words]
        hits, seen, near = [], set(), set()
        for end, (n, short) in self.automaton.iter(tuple(numbers)):
            if short:
                hits.append((end - n + 1, n))
                seen.update(short)
            if n == self.part and self.long:
                near.update(range(max(0, end - self.size + 1), min(end - n + 1, len(words) - self.size) + 1))
        if near:
            own, starts = np.array(numbers, np.int64), np.array(sorted(near), np.int64)
            h = rolled(mixed(own.astype(np.uint64)), starts, self.size, _ODD[0])
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            starts, at = starts[self.hashes[at] == h], at[self.hashes[at] == h]
            step = np.arange(self.size)
            same = (own[starts[:, None] + step] == self.flat[self.places[at][:, None] + step]).all(1)
            hits += [(int(k), self.size) for k in starts[same]]
            for k in np.unique(at[same]):
                seen.update(self.owner[self.bounds[k] : self.bounds[k + 1]].tolist())
        return hits, {self.names[k] for k in seen}


@lru_cache(maxsize=AUTOMATA)
def _windows(items: tuple[tuple[str, str], ...], size: int) -> Windows:
    return Windows(items, size)


def marked_words(text: str | None, n_words: int, hits: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """(words hit, hit stretches as code points of the original text) of windows by first word and size."""
    if not hits:
        return 0, []
    edge = np.zeros(n_words + 1, np.int64)
    for first, n in hits:
        edge[first] += 1
        edge[first + n] -= 1
    hit = np.cumsum(edge[:-1]) > 0
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(_PLAIN))]
    step = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    spans = [(places[a][0], places[b - 1][1]) for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # code points up to and with each byte
    return int(hit.sum()), [(int(char[a]) - 1, int(char[b - 1])) for a, b in spans]


def _found(batch: pa.RecordBatch, names: list[str], rows: list[tuple[int, int, list[str], list[tuple[int, int]]]]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([r[1] for r in rows], pa.int64()),
        pa.array([r[2] for r in rows], pa.list_(pa.string())),
        pa.array([[{"start": a, "end": b} for a, b in r[3]] for r in rows], span),
    ]
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), *out], names=[*names, "n_words", "n_hit", "hit_items", "hit_spans"])


def _scanned(blocks: list, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_windows(tuple(b.value), size) for b in blocks]
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words, hits, seen = words_of(text), [], set()
                for block in known:
                    more, items = block.find(words)
                    hits += more
                    seen |= items
                rows.append((len(words), *marked_words(text, len(words), hits)))
                rows[-1] = (rows[-1][0], rows[-1][1], sorted(seen), rows[-1][2])
            yield _found(batch, batch.schema.names, rows)

    return run


def _hashed(size: int, sizes: list[int] | None, extra: list[str]):
    """Texts -> (columns of ``extra``, pos, size, h, g) of their windows: with ``sizes``, all windows of these sizes; else an item's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [b" ".join(words_of(t)).decode("latin-1") for t in batch.column("text").to_pylist()]
            h, begin = word_hashes(pa.array(plain, pa.string()))
            counts = np.diff(begin)
            for n in sizes or range(1, size + 1):
                fit = np.maximum(counts - n + 1, 0) if sizes or n == size else (counts == n).astype(np.int64)
                row = np.repeat(np.arange(len(counts)), fit)
                pos = np.arange(fit.sum()) - np.repeat(np.cumsum(fit) - fit, fit)
                starts = begin[:-1][row] + pos
                marks = [pa.array(rolled(h, starts, n, odd).view(np.int64)) for odd in _ODD]
                own = [batch.column(c).take(pa.array(row)) for c in extra]
                yield pa.RecordBatch.from_arrays([*own, pa.array(pos.astype(np.int64)), pa.array(np.full(len(row), n)), *marks], names=[*extra, "pos", "size", "h", "g"])

    return run


def _placed(names: list[str]):
    """Rows with the places of their windows and their items, or nulls -> rows with results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, places, items in zip(*(batch.column(c).to_pylist() for c in ("text", "_places", "_items")), strict=True):
                n = len(words_of(text))
                hit, spans = marked_words(text, n, [(p["pos"], p["size"]) for p in places or []])
                rows.append((n, hit, sorted(items or []), spans))
            yield _found(batch, names, rows)

    return run


def joined_windows(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """``contaminated`` for a benchmark of any size: windows of items and of texts, as 128 bits of hash, are joined by Spark.

    No worker holds the benchmark. Texts send one row per word and size of window; what is found of a text is gathered by two hashes of the text, so equal
    texts are looked up once.
    """
    spark = docs.sparkSession
    schema = "pos long, size long, h long, g long"
    own = Scratch(spark, "benchmark").table(items.mapInArrow(_hashed(size, None, ["item"]), f"item string, {schema}").select("item", "size", "h", "g").distinct(), "windows")
    sizes = sorted(r[0] for r in own.select("size").distinct().collect())  # at most ``size`` of them
    keys = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]
    texts = docs.where("text is not null").select("text").distinct().select(*keys, "text")
    theirs = texts.mapInArrow(_hashed(size, sizes or [size], ["k1", "k2"]), f"k1 long, k2 long, {schema}")
    hits = theirs.join(own.select("size", "h", "g").distinct(), ["size", "h", "g"], "left_semi")
    hits = Scratch(spark, "benchmark").table(hits, "hits")
    places = hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "size")).alias("_places"))
    named = hits.select("k1", "k2", "size", "h", "g").distinct().join(own, ["size", "h", "g"]).groupBy("k1", "k2").agg(F.collect_set("item").alias("_items"))
    names = docs.columns
    out = docs.select("*", *[k.alias(f"_{n}") for k, n in zip(keys, ("k1", "k2"), strict=True)])
    for found in (places, named):
        out = out.join(found.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), ["_k1", "_k2"], "left")
    return out.select(*names, "_places", "_items").mapInArrow(_placed(names), _schema(docs))


def _schema(docs: DataFrame) -> str:
    added = "n_words long, n_hit long, hit_items array<string>, hit_spans array<struct<start: long, end: long>>"
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), added])


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` (with a string column text) plus n_words, n_hit, hit_items, hit_spans.

    Words are letters, digits and all characters beyond ASCII, A-Z as a-z. A window is ``size``
    consecutive words of a benchmark text, or a whole text of fewer words; texts without words have none.
    A document's word inside any occurrence of a window is hit: n_hit counts them, hit_items lists the
    items with occurring windows (item_id as string, sorted), hit_spans gives the stretches of consecutive hit words in
    code points of the original text. A null text has no words. Repeated items count once; items of a
    null id are found under the name "null". Columns of ``docs`` with a name of the four new ones are replaced.

    The benchmark is the stated query set. Up to AUTOMATA times AUTOMATON_CHARS characters of it are sent to the executors, in blocks of
    AUTOMATON_CHARS, one automaton each, and every text passes each automaton once; the driver reads it row by row. A larger one never reaches the driver or a worker as a whole: see
    ``joined_windows``. Both give the same rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("n_words", "n_hit", "hit_items", "hit_spans").withColumn("text", F.col("text").cast("string"))
    items = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text")).distinct()
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > AUTOMATA * AUTOMATON_CHARS:
        return joined_windows(docs, items, size)
    blocks, block, chars = [], [], 0
    for item, text in items.toLocalIterator():
        block.append((item, text))
        chars += len(text)
        if chars >= AUTOMATON_CHARS:
            blocks.append(spark.sparkContext.broadcast(block))
            block, chars = [], 0
    if block:
        blocks.append(spark.sparkContext.broadcast(block))
    return docs.mapInArrow(_scanned(blocks, size), _schema(docs))


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents against windows of ten words of the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"), WINDOW)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
with item as (
  select cast(item_id as varchar) as item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null),
win as (
  select distinct item, least(len(w), 10) as size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as key
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item where len(w) > 0)),
doc as (
  select doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
place as (
  select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as key
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from doc, (select distinct size from win) where len(w) >= size)),
found as (select doc_id, place.size, i, item from place join win using (key) where place.size = win.size),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from found) group by doc_id),
own as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from found) group by doc_id)
select doc.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit on doc.doc_id = hit.doc_id left join own on doc.doc_id = own.doc_id
"""
