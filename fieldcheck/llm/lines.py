"""Line dedup: hashes of lines in range partitions, sorted by document and position, first occurrences streamed into keep bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import dealt, whole_groups
from .scratch import Scratch, small_batches
from .shingles import mixed, text_buffer
from .tables import table

#: Code points of a key at least.
LEAST = 10
#: Letters that count as their small ones.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Values of bytes, and of their first 1024 places in a line, for two hashes.
_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LETTER[65:91] = _LETTER[97:123]
_PLACES = [mixed(np.arange(first, first + 1024, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1) for first in (5001, 9001)]
_PIECE = 1 << 20
#: Stands for a missing doc_id; such rows come behind all others.
NO_ID = 2**63 - 1
#: Kinds of rows of a scan: sure to go, undecided, and the first row of a run at the edge of a partition.
_GONE, _OPEN, _EDGE = 0, 1, 2
_RUN = ("h", "check")
_COLUMNS = ("kind", "h", "check", "doc", "rid", "pos", "n_lines")


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with _doc (doc_id, NO_ID for none) and _rid, a hash of the text. Rows equal in both lose the same lines."""
    return docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_rid", F.xxhash64(F.coalesce("text", F.lit(""))))


def _factors(place: np.ndarray, which: int) -> np.ndarray:
    """An odd factor for each place of a byte in its line; ``which`` of two independent sets."""
    out = _PLACES[which][place & 1023]
    far = place >> 10
    if len(far) and far.max():
        out = out + (mixed(far.astype(np.uint64) + np.uint64(which << 40)) * (far > 0)) * np.uint64(2)
    return out


def hashed_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash, check, lines of the row) of each line of a string column whose key has LEAST code points, in order."""
    data, offsets = text_buffer(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    feeds = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, feeds, side="right") - 1
    counts = 1 + np.bincount(row, minlength=len(column)).astype(np.int64)
    base = np.cumsum(counts) - counts
    after = np.arange(len(feeds)) + row + 1  # the line behind each line feed: every row before has one line more than line feeds
    start, end = np.empty(counts.sum(), np.int64), np.empty(counts.sum(), np.int64)
    start[base], start[after] = offsets[:-1], feeds + 1
    end[base + counts - 1], end[after - 1] = offsets[1:], feeds
    inked = np.flatnonzero(~((data == 32) | ((data >= 9) & (data <= 13))))
    lo, hi = np.searchsorted(inked, start), np.searchsorted(inked, end)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    some = np.flatnonzero(hi > lo)
    s, e = inked[lo[some]], inked[hi[some] - 1] + 1
    long = points[e] - points[s] >= LEAST
    some, s, e = some[long], s[long], e[long]
    hashes = np.zeros((2, len(some)), np.uint64)
    sums = np.cumsum(e - s)
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + _PIECE)))
        size = e[at:to] - s[at:to]
        begin = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(begin, size)
        letters = _LETTER[data[np.repeat(s[at:to], size) + place]]
        for which in (0, 1):
            hashes[which, at:to] = mixed(np.add.reduceat(letters * _factors(place, which), begin) + size.astype(np.uint64))
        at = to
    of = np.repeat(np.arange(len(column)), counts)[some]
    return of, (some - base[of]).astype(np.int32), hashes[0].view(np.int64), (hashes[1] >> np.uint64(33)).astype(np.int32), counts[of].astype(np.int32)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of, pos, h, check, n_lines = hashed_lines(batch.column("text"))
        at = pa.array(of)
        out = [pa.array(h), pa.array(check), batch.column("doc").take(at), batch.column("rid").take(at), pa.array(pos), pa.array(n_lines)]
        yield pa.RecordBatch.from_arrays(out, names=list(_COLUMNS[1:]))


def line_hashes(docs: DataFrame) -> DataFrame:
    """(h, check, doc, rid, pos, n_lines) of every line whose key has LEAST code points; keys carry 95 bits of hash."""
    rows = identified(docs).select(F.col("_doc").alias("doc"), F.col("_rid").alias("rid"), "text")
    return rows.mapInArrow(_hashes, "h long, check int, doc long, rid long, pos int, n_lines int")


def _behind(doc: np.ndarray, rid: np.ndarray, first_doc: np.ndarray, first_rid: np.ndarray) -> np.ndarray:
    return (doc > first_doc) | ((doc == NO_ID) & (first_doc == NO_ID) & (rid != first_rid))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lines of one partition -> lines that go; of the first run, which may have begun in a partition before, all lines; first rows of both end runs."""
    run = first = None  # the run that the last batch ended in, and (doc, rid) of its first row
    in_first_run = True
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {name: batch.column(name).to_numpy() for name in batch.schema.names}
        new = np.ones(batch.num_rows, bool)
        new[1:] = (np.diff(c["h"]) != 0) | (np.diff(c["check"]) != 0)
        if run is None:
            yield _rows(c, np.array([0]), _EDGE)
        new[0] = run != (c["h"][0], c["check"][0])
        starts = np.flatnonzero(new)
        in_first_run = in_first_run and (run is None or not new[0])
        if run is None or new[0]:
            heads = starts
            first_doc, first_rid = c["doc"][heads], c["rid"][heads]
            of = np.cumsum(new) - 1
        else:
            first_doc = np.append(np.int64(first[0]), c["doc"][starts])
            first_rid = np.append(np.int64(first[1]), c["rid"][starts])
            of = np.cumsum(new)
        gone = _behind(c["doc"], c["rid"], first_doc[of], first_rid[of])
        if in_first_run:
            undecided = of == 0
            yield _rows(c, np.flatnonzero(undecided), _OPEN)
            gone &= ~undecided
            in_first_run = not (of > 0).any()
        yield _rows(c, np.flatnonzero(gone), _GONE)
        run, first = (c["h"][-1], c["check"][-1]), (first_doc[of[-1]], first_rid[of[-1]])
    if run is not None:
        zero = np.zeros(1, np.int32)
        one = {"h": np.array([run[0]]), "check": np.array([run[1]], np.int32), "doc": np.array([first[0]], np.int64), "rid": np.array([first[1]], np.int64)}
        yield _rows({**one, "pos": zero, "n_lines": zero}, np.array([0]), _EDGE)


def _rows(c: dict[str, np.ndarray], at: np.ndarray, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), *(pa.array(c[name][at]) for name in _COLUMNS[1:])], names=list(_COLUMNS))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that go, those of a document next to each other -> one bitmap per document."""
    for rows, starts in whole_groups(batches, ["doc", "rid"]):
        c = {name: rows.column(name).to_numpy() for name in ("doc", "rid", "pos", "n_lines")}
        keeps, counts = [], []
        for lo, hi in zip(starts, np.append(starts[1:], rows.num_rows), strict=True):
            keep = np.ones(c["n_lines"][lo], bool)
            keep[c["pos"][lo:hi]] = False
            keeps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            counts.append(int((~keep).sum()))
        out = [pa.array(c["doc"][starts]), pa.array(c["rid"][starts]), pa.array(counts, pa.int64()), pa.array(keeps, pa.binary())]
        yield pa.RecordBatch.from_arrays(out, names=["_doc", "_rid", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(_doc, _rid, n_dropped, keep) of every document of ``docs`` (doc_id, text) that loses lines.

    keep is a zlib stream of one bit per line, from the highest bit of the first byte on, set where the line stays. _doc and _rid are those of ``identified``.

    Hashes of lines are stored, dealt out by ranges of (hash, document, position) and sorted, so the lines of one key are next to each other
    with its first document ahead, and a key of a third of all lines spreads over many partitions. A task streams its rows and
    holds one batch. Where a key goes on from one partition to the next, its first document comes from the first rows of the
    runs at the edges, two per partition, which are broadcast.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    lines = scratch.table(line_hashes(docs), "hashes")
    order = [F.col(name) for name in (*_RUN, "doc", "rid", "pos")]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    found = scratch.table(ranged.mapInArrow(_scan, "kind int, h long, check int, doc long, rid long, pos int, n_lines int"), "scanned")
    first = F.min(F.struct("doc", "rid"))
    edges = found.where(F.col("kind") == _EDGE).groupBy(*_RUN).agg(first.alias("first"))
    open_ = found.where(F.col("kind") == _OPEN).join(F.broadcast(edges), list(_RUN))
    behind = (F.col("doc") > F.col("first.doc")) | ((F.col("doc") == NO_ID) & (F.col("first.doc") == NO_ID) & (F.col("rid") != F.col("first.rid")))
    columns = ["doc", "rid", "pos", "n_lines"]
    gone = found.where(F.col("kind") == _GONE).select(*columns).unionByName(open_.where(behind).select(*columns))
    return dealt(gone, "doc", "rid").mapInArrow(_bitmaps, "_doc long, _rid long, n_dropped long, keep binary")


def _kept(names: list[str]):
    """Rows with their bitmap, or null for none -> rows with the lines that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = batch.column("text").to_pylist(), []
            for k, keep in enumerate(batch.column("keep").to_pylist()):
                counts.append(1 + (texts[k] or "").count("\n"))
                if keep is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=counts[-1])
                    split = texts[k].split("\n")
                    texts[k] = "\n".join([split[i] for i in np.flatnonzero(bits)])
            out = [*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), batch.column("n_dropped")]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "text", "n_lines", "n_dropped"])

    return run


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with lines of earlier documents cut out of text, plus n_lines (before) and n_dropped.

    A text is split at line feeds; a null or empty one is one empty line. The key of a line is the line without white space (space and the
    control characters 9 to 13) at both ends, A-Z as a-z. Lines whose key has LEAST code points and stands in
    several documents go, but for those of the document of the smallest doc_id, which keeps all its lines; the lines left are joined
    by line feeds. Rows of one doc_id count as one document, whatever their texts. Rows without a doc_id are documents of their own behind all others, in an
    order by a hash of their text; equal texts among them count as one document. A null text stays null. Columns of the new names are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped", "keep", "_doc", "_rid").withColumn("text", F.col("text").cast("string"))
    names = [c for c in docs.columns if c != "text"]
    joined = identified(docs).join(keep_bitmaps(docs.select("doc_id", "text")), ["_doc", "_rid"], "left")
    joined = joined.select(*names, "text", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    return joined.mapInArrow(_kept(names), f"{schema}text string, n_lines long, n_dropped long")


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Documents without lines that a document of a smaller doc_id has."""
    found = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP11_SQL = f"""
with l as (
  select doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)),
k as (select key, min(doc_id) as first_doc from l where length(key) >= {LEAST} group by key having count(distinct doc_id) > 1),
j as (select l.doc_id, line, pos, coalesce(l.doc_id > first_doc, false) as gone from l left join k on k.key = l.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from j group by doc_id"""
