"""Token ids in length-delimited binary records, with an index of offsets for shuffled reads.

A data file is a sequence of records; little-endian throughout:

    uint64  length of the payload
    uint32  masked checksum of those eight bytes
    bytes   payload
    uint32  masked checksum of the payload

A payload is one serialized sequence: int64 document, uint32 number of ids, uint8 bytes per id (2 or 4),
uint8 1 if what follows is compressed with zstandard, then the ids. A masked checksum is the CRC-32 rotated right by 15
bits plus a constant, so that checksums of data that hold checksums stay sound.

The index file beside it has one entry of 28 bytes per record: uint64 offset, uint64 length of the whole
record, int64 document, uint32 number of ids.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches
from .tables import table
from .vocabulary import default_path, encode_column, gathered

#: Added to rotated checksums; stands for a null document.
MASK, NO_ID = 0xA282EAD8, -(2**63)
_HEAD, _META, _ENTRY = struct.Struct("<QI"), struct.Struct("<qIBB"), struct.Struct("<QQqI")
_ENTRY_TYPE = np.dtype([("offset", "<u8"), ("length", "<u8"), ("doc_id", "<i8"), ("n_ids", "<u4")])
#: Bytes of a data file that a shuffled read asks for at once.
CHUNK = 4 << 20
#: Pieces of text whose ids a worker remembers, twice: the latest ones and those before them.
REMEMBERED = 400_000
#: Marks that may follow a word.
MARKS = b".,;:!?"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def payload(doc_id: int | None, ids: np.ndarray, packer: zstandard.ZstdCompressor | None) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    data = ids.astype("<u2" if width == 2 else "<u4").tobytes()
    return _META.pack(NO_ID if doc_id is None else doc_id, len(ids), width, packer is not None) + (packer.compress(data) if packer else data)


def index_entry(offset: int, length: int, doc_id: int | None, n_ids: int) -> bytes:
    return _ENTRY.pack(offset, length, NO_ID if doc_id is None else doc_id, n_ids)


def unpacked(data: bytes) -> tuple[int, np.ndarray]:
    doc_id, n, width, packed = _META.unpack_from(data)
    body = data[_META.size :]
    if packed:
        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=n * width)
    return doc_id, np.frombuffer(body, "<u2" if width == 2 else "<u4", n).astype("<u4")


def read_record(stream) -> bytes | None:
    """The next payload, None at the end; raises ValueError if a checksum or a length is wrong."""
    head = stream.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size:
        raise ValueError("record cut off in its length")
    length, check = _HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("wrong checksum of a length")
    data = stream.read(length)
    tail = stream.read(4)
    if len(data) < length or len(tail) < 4 or masked(data) != struct.unpack("<I", tail)[0]:
        raise ValueError("wrong checksum of a record")
    return data


def read_index(path: str) -> list[tuple[int, int, int, int]]:
    """(offset, length, document, ids) of every record of the data file."""
    files, at = opened(path)
    with files.open_input_stream(f"{at}.idx") as stream:
        return list(_ENTRY.iter_unpack(stream.read()))


def read_at(path: str, offset: int) -> tuple[int, np.ndarray]:
    """(document, ids) of the record at an offset of the index."""
    files, at = opened(path)
    with files.open_input_file(f"{at}.rec") as stream:
        stream.seek(offset)
        return unpacked(read_record(stream))


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path with a scheme, and the path in it."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


class Encoder:
    """The tokenizers library, piece by piece; ids of common pieces are remembered."""

    def __init__(self, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        #: Ids of known pieces: the recent ones and those before them. When the recent ones are full they become the old ones.
        self.recent: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks = {m: self._library([bytes([m])])[0] for m in MARKS}

    def _library(self, pieces: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        if len(self.recent) > REMEMBERED:
            self.recent, self.old = {}, self.recent
        recent, old, marks = self.recent, self.old.get, self.marks
        found = list(map(recent.get, pieces))
        new: dict[bytes, list[int]] = {}
        for k in [k for k, ids in enumerate(found) if ids is None]:
            p = pieces[k]
            if ids := old(p):
                recent[p] = found[k] = ids
                continue
            # the pre-tokenizer cuts between a letter and a mark; a single last mark is a token of its own
            if p[-1] in marks and p[-2:-1].isalpha():
                core = p[:-1]
                if ids := recent.get(core) or old(core):
                    recent[p] = found[k] = ids + marks[p[-1]]
                    continue
            else:
                core = p
            if core in new:
                new[core].append(k)
            else:
                new[core] = [k]
        todo = list(new)
        for at in range(0, len(todo), 4096):
            part = todo[at : at + 4096]
            for core, ids in zip(part, self._library(part), strict=True):
                recent[core] = ids
                for k in new[core]:
                    if len(pieces[k]) == len(core):
                        found[k] = ids
                    else:
                        recent[pieces[k]] = found[k] = ids + marks[pieces[k][-1]]
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, equal to those of the library for the whole text."""
        return list(encode_column(pa.array(texts, pa.string()), self.pieces))


@lru_cache(maxsize=2)
def encoder(content: str) -> Encoder:
    return Encoder(content)


def write_records(docs: DataFrame, folder: str, content, end_id: int = 2, compress: bool = True) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order below ``folder``; returns the manifest.

    ``content`` broadcasts the tokenizer's JSON text. Documents are dealt out by ranges of doc_id, sorted, and
    each task writes one data file and one index; null ids come first, a null text counts as empty, and every sequence ends with ``end_id``.
    A task attempt writes files of its own name and reports them when it ends, so a repeated
    attempt never touches files of another; only files of the manifest count. The manifest (part, path, docs, ids)
    must be kept (written or checkpointed) before use: it names the files of the run that made it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(content.value), TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        packer = zstandard.ZstdCompressor(level=1) if compress else None
        files, at = opened(path)
        files.create_dir(os.path.dirname(at), recursive=True)
        offset = n_docs = n_ids = 0
        with files.open_output_stream(f"{at}.rec") as data, files.open_output_stream(f"{at}.idx") as index:
            for batch in gathered(batches, "text"):
                rows = encode_column(batch.column("text"), own.pieces)
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), rows, strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    record = frame(payload(doc_id, ids, packer))
                    data.write(record)
                    index.write(index_entry(offset, len(record), doc_id, len(ids)))
                    offset, n_docs, n_ids = offset + len(record), n_docs + 1, n_ids + len(ids)
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([path]), pa.array([n_docs]), pa.array([n_ids])], names=["part", "path", "docs", "ids"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "part long, path string, docs long, ids long")


def shuffled(path: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(number in the file, document, ids) of all records of a data file, found through its index, in a shuffled order that the path decides.

    Stretches of about CHUNK bytes are read in shuffled order, each with one request, and its records taken from it in shuffled order, by their
    offsets. A record that isn't where the index has it, or isn't the one that the index tells of, is a ValueError.
    """
    files, at = opened(path)
    with files.open_input_stream(f"{at}.idx") as stream:
        index = np.frombuffer(stream.read(), _ENTRY_TYPE)
    if not len(index):
        return
    order = np.random.default_rng(zlib.crc32(path.rsplit("/", 1)[-1].encode()))
    chunk = ((index["offset"] - index["offset"][0]) // CHUNK).astype(np.int64)
    parts = np.split(np.arange(len(index)), np.flatnonzero(np.diff(chunk)) + 1)
    with files.open_input_file(f"{at}.rec") as data:
        for k in order.permutation(len(parts)):
            part = parts[k]
            low, high = int(index["offset"][part[0]]), int(index["offset"][part[-1]] + index["length"][part[-1]])
            stretch = memoryview(data.read_at(high - low, low))
            for n in order.permutation(part):
                offset, length, doc_id, n_ids = index[n].item()
                record = read_record(io.BytesIO(stretch[offset - low : offset - low + length]))
                if record is None:
                    raise ValueError("no record where the index has one")
                found, ids = unpacked(record)
                if (found, len(ids)) != (doc_id, n_ids):
                    raise ValueError("a record that the index doesn't have")
                yield int(n), doc_id, ids


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            sizes = np.array([n for *_, n in read_index(path)], np.int64)
            start = base + np.cumsum(sizes) - sizes
            rows: list[tuple] = []
            for n, doc_id, ids in shuffled(path):
                rows.append((None if doc_id == NO_ID else doc_id, int(start[n]), len(ids), zlib.crc32(ids.tobytes())))
                if len(rows) == 4096:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=names)


def read_records(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of the manifest's files, read through their indexes in shuffled order, checksums verified.

    start counts the ids of all records before it. Only the number of ids of each file is summed up
    across files.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("part", "path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_records(spark, sf_dir: str) -> DataFrame:
    """Documents as records of token ids ending with id 2, read back from their files."""
    small_batches(spark)
    scratch = Scratch(spark, "records")
    with open(default_path(), encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    manifest = write_records(table(spark, sf_dir, "documents"), f"{scratch.path}/files", content)
    return read_records(scratch.table(manifest, "manifest"))
