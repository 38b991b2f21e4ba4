"""Substring dedup: runs of consecutive sentences that repeat anywhere in the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches
from .shingles import mixed, text_buffer, word_hashes
from .tables import table

#: Sentences in a run at least, and words in a run at least.
SENTENCES, WORDS = 3, 12
#: A sentence of more words is cut behind each of its words whose hash is divisible by the second number,
#: so that text without full stops has sentences too, the same ones wherever it stands.
LONG, CUT = 12, 6
#: What is still of so many words or more is cut behind the least hash of each of its windows of so many words. So from any word on
#: the first cut that doesn't depend on what stands before follows within NEAR words, and three more units end within 4 * NEAR words.
NEAR = 12
#: The run at such a unit counts if no run of sentences lies within so many words behind its start. In a passage of 50 words the
#: first sure cut stands at word 12 at most; these and 13 more, which tell whether the last sentence is long, fit behind it.
DENSE = 25
_PIECE = 1 << 16
#: Stands for a missing doc_id, ahead of all others.
NO_ID = -(2**63)

_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True
_CLOSER = np.zeros(256, bool)
_CLOSER[[ord(c) for c in "\"')]"]] = True


def _least(h: np.ndarray, first: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether a word has the least hash (the last of equal ones) of a window of NEAR words of one unit of a long sentence."""
    out = np.zeros(len(h), bool)
    left = np.repeat(np.append(first[1:], len(h)), np.diff(np.append(first, len(h)))) - np.arange(len(h))
    starts = np.flatnonzero(long & (left >= NEAR))
    if len(starts):
        windows = np.lib.stride_tricks.sliding_window_view(h, NEAR)[:, ::-1]
        for k in range(0, len(starts), _PIECE):
            own = starts[k : k + _PIECE]
            out[own + NEAR - 1 - windows[own].argmin(1)] = True
    return out


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each unit, position of each row's first unit, first byte of each unit, whether each unit begins a sentence).

    Positions have one more entry at the end; bytes count from the column's first one. A sentence ends with a word
    that ends in a full stop, exclamation or question mark (closing quotes and brackets may follow), with a line break behind it, or with the text; long ones are
    cut (LONG, CUT). Units are sentences, and what is left of long stretches of them after further cuts (NEAR). One pass over the text yields both.
    """
    h, begin = word_hashes(column)
    data, offsets = text_buffer(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = len(h)
    if not n:
        zero = np.zeros(len(offsets), np.int64)
        return h, zero[:0], zero, zero[:0], np.zeros(0, bool)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    row_starts = np.zeros(len(data) + 1, bool)
    row_starts[offsets] = True
    starts = ~space
    starts[1:] &= space[:-1] | row_starts[1 : len(data)]
    first_byte = np.flatnonzero(starts)
    ends = ~space
    ends[:-1] &= space[1:] | row_starts[1 : len(data)]
    last_byte = np.flatnonzero(ends)
    last = data[last_byte]
    before = data[np.maximum(last_byte - 1, first_byte)]
    stop = _END[last] | (_CLOSER[last] & _END[before])
    feeds = np.searchsorted(np.flatnonzero(data == 10), first_byte)
    stop[:-1] |= np.diff(feeds) > 0
    stop[-1] = True
    stop[begin[1:][begin[1:] > 0] - 1] = True
    first = np.flatnonzero(np.concatenate([[True], stop[:-1]]))
    size = np.diff(np.append(first, n))
    long = np.repeat(size > LONG, size)
    stop |= long & (h % np.uint64(CUT) == 0)
    whole = np.concatenate([[True], stop[:-1]])
    stop |= _least(h, np.flatnonzero(whole), long)
    first = np.flatnonzero(np.concatenate([[True], stop[:-1]]))
    return h, first, np.searchsorted(first, begin), first_byte[first], whole[first]


def _ends(edge: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit, end unit) of the shortest run of SENTENCES units and WORDS words at each unit that has one; edge has where units begin, and the end."""
    n = len(edge) - 1
    end = np.maximum(np.arange(n) + SENTENCES, np.searchsorted(edge, edge[:-1] + WORDS))
    ok = end <= np.repeat(row_of[1:], np.diff(row_of))
    return np.flatnonzero(ok), end[ok]


def runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first unit, end unit, 64-bit hash, 32-bit check) of the run at each sentence, and at other units where those are too rare (DENSE), in order.

    A run is the shortest one of SENTENCES of them and WORDS words at least; units are numbered through the column.
    """
    return runs_of(*units(column))


def runs_of(h: np.ndarray, first: np.ndarray, row_of: np.ndarray, _: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``runs`` of what ``units`` gives."""
    if not len(first):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty.astype(np.int32)
    row = np.repeat(np.arange(len(row_of) - 1), np.diff(row_of))
    edge = np.append(first, len(h))
    of = np.append(np.flatnonzero(whole), len(first))
    s, e = (of[x] for x in _ends(edge[of], np.searchsorted(of, row_of)))
    if len(of) <= len(first):
        more_s, more_e = _ends(edge, row_of)
        after = np.searchsorted(s, more_s)
        dense = (np.append(edge[e], len(h) + DENSE + 1)[after] - edge[more_s] <= DENSE) & (row[np.append(s, 0)[after]] == row[more_s])
        both = np.concatenate([np.column_stack([s, e]), np.column_stack([more_s, more_e])[~dense]])
        s, e = np.unique(both, axis=0).T
    marks = []
    for odd in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        power = np.cumprod(np.full(len(h) + 1, odd, np.uint64)) * np.uint64(pow(odd, -1, 1 << 64))
        back = np.cumprod(np.full(len(h) + 1, pow(odd, -1, 1 << 64), np.uint64)) * np.uint64(odd)
        total = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:-1])])
        value = (total[edge[e]] - total[edge[s]]) * back[edge[s]]
        marks.append(mixed(value + (edge[e] - edge[s]).astype(np.uint64)).view(np.int64))
    return row[s], s, e, marks[0], (marks[1] >> 32).astype(np.int32)


def _later(row: np.ndarray, h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Whether an equal run stands earlier in the same row."""
    order = np.lexsort((check, h, row))
    same = (np.diff(row[order]) == 0) & (np.diff(h[order]) == 0) & (np.diff(check[order]) == 0)
    out = np.zeros(len(row), bool)
    out[order[1:][same]] = True
    return out


def _runs(extra: list[str]):
    """(h, check, and the columns of ``extra``) of the distinct runs of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, _, h, check = runs(batch.column("text"))
            new = ~_later(row, h, check)
            at = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(check[new]), *(batch.column(c).take(at) for c in extra)], names=["h", "check", *extra])

    return run


def _cut(names: list[str]):
    """Rows with the hashes of runs that stand in an earlier document -> rows with those runs, and repeats within the row, cut out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            data, offsets = text_buffer(column)
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            found = units(column)
            words, first, row_of, byte, whole = found
            row, s, e, h, check = runs_of(*found)
            known = _later(row, h, check)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for k, some in enumerate(batch.column("known").to_pylist()):
                if some:
                    known[at[k] : at[k + 1]] |= np.isin(h[at[k] : at[k + 1]], np.array(some, np.int64))
            depth = np.zeros(len(first) + 1, np.int64)
            np.add.at(depth, s[known], 1)
            np.add.at(depth, e[known], -1)
            gone = np.cumsum(depth[:-1]) > 0
            size = np.diff(np.append(first, len(words)))
            count = lambda x, of: np.diff(np.concatenate([[0], np.cumsum(x)])[of])
            words_removed, texts = count(gone * size, row_of), column.to_pylist()
            begin = np.flatnonzero(whole)
            hit = np.logical_or.reduceat(gone, begin) if len(begin) else gone
            whole_of = np.searchsorted(begin, row_of)
            for k in np.flatnonzero(words_removed):
                lo, hi = row_of[k], row_of[k + 1]
                edge = np.concatenate([[offsets[k]], byte[lo + 1 : hi], [offsets[k + 1]]])
                texts[k] = b"".join(data[a:b].tobytes() for a, b, x in zip(edge[:-1], edge[1:], gone[lo:hi], strict=True) if not x).decode()
            out = [*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(np.diff(whole_of)), pa.array(count(hit, whole_of)), pa.array(words_removed)]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "text", "n_sentences", "n_removed", "words_removed"])

    return run


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with repeated passages cut out of text, plus n_sentences, n_removed, words_removed.

    The run at a sentence is it and what follows, up to SENTENCES sentences and WORDS words; where a long sentence is cut further
    (NEAR), the run at each of its units counts too, unless there are runs of sentences enough (DENSE). Whatever surrounds a passage of 50 words, one run of it at least is the same everywhere.
    Of equal runs the first one stays: that of the smallest doc_id (null first), and there the earliest. Every unit that any
    other one covers is removed, with the white space behind it; the rest of a text stays as it is. Words are compared
    with A-Z as a-z. Rows of one doc_id, and rows without one, are documents of their own too, in the order of a hash of their text; of rows equal in that too, one counts as the first.
    n_removed counts sentences that lost words. A null text stays null; columns of the new names are replaced.

    Runs carry 96 bits of hash. Repeats within a row are found there, so each run of a row is sent once, as its hash and doc_id; hashes
    are reduced to smallest and largest doc_id with partial sums, and those of several documents are joined back. Only rows that share their doc_id are numbered, stored, and
    compared with each other in a second, equal step. A passage of a third of all documents costs one row per task in the first step, and the join may split its rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "spans")
    docs = docs.drop("n_sentences", "n_removed", "words_removed", "known", "_doc", "_row", "_hash").withColumn("text", F.col("text").cast("string"))
    names = [c for c in docs.columns if c != "text"]
    docs = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    repeated = docs.groupBy("_doc").agg(F.count("*").alias("rows")).where(F.col("rows") > 1).select("_doc")
    repeated = scratch.table(repeated, "repeated")
    # numbers of rows hold only where they are stored
    alike = docs.join(repeated, "_doc", "left_semi").withColumns({"_row": F.monotonically_increasing_id() + 1, "_hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    alike = scratch.table(alike, "alike")
    alone = docs.join(repeated, "_doc", "left_anti").withColumn("_row", F.lit(0).cast("long"))
    docs = alone.select(*names, "text", "_doc", "_row").unionByName(alike.select(*names, "text", "_doc", "_row"))

    found = docs.select("text", F.col("_doc").alias("doc"), F.col("_row").alias("row")).mapInArrow(_runs(["doc", "row"]), "h long, check int, doc long, row long")
    several = found.groupBy("h", "check").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").drop("high")
    later = found.join(several, ["h", "check"]).where("doc > low").select("doc", "row", "h")

    own = alike.select("text", F.col("_doc").alias("doc"), F.col("_row").alias("row"), F.col("_hash").alias("hash"))
    own = own.mapInArrow(_runs(["doc", "row", "hash"]), "h long, check int, doc long, row long, hash long").withColumn("place", F.struct("hash", "row"))
    first = own.groupBy("doc", "h", "check").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").drop("last")
    behind = own.join(first, ["doc", "h", "check"]).where("place > first").select("doc", "row", "h")

    known = scratch.table(later.unionByName(behind).groupBy("doc", "row").agg(F.collect_set("h").alias("known")), "known")
    joined = docs.join(known.withColumnsRenamed({"doc": "_doc", "row": "_row"}), ["_doc", "_row"], "left")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in names)
    return joined.select(*names, "text", "known").mapInArrow(_cut(names), f"{schema}text string, n_sentences long, n_removed long, words_removed long")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier place of the corpus has."""
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
