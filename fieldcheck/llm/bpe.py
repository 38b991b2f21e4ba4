"""Byte-level BPE: a heap of merge ranks over a doubly linked list of symbols."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches
from .tables import table
from .vocabulary import default_path, encode_column, gathered

#: Fixed value: the pattern by which the byte-level pre-tokenizer cuts texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of text whose ids a worker remembers, twice: the latest ones and those before them.
REMEMBERED = 80_000
#: Bits that hold an id of the vocabulary.
BITS = 20
MASK = (1 << BITS) - 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary strings: printable ones for themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file (JSON text of the tokenizers library)."""

    def __init__(self, content: str) -> None:
        file = json.loads(content)
        vocabulary = file["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocabulary[c] for c in letters]
        merges = (m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"])
        self.merges = {
            vocabulary[a] << BITS | vocabulary[b]: (rank + 1) << BITS | vocabulary[a + b] for rank, (a, b) in enumerate(merges)
        }
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for token, i in vocabulary.items():
            self.strings[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        #: Ids of known pre-tokens, and of known pieces of text, as unsigned 32-bit integers: the recent ones and those before them.
        self.recent: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.recent_pieces: dict[bytes, bytes] = {}
        self.old_pieces: dict[bytes, bytes] = {}

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token: the pair of lowest rank, leftmost first, is merged until none is left."""
        merge = self.merges.get
        ids = [self.first[b] for b in word.encode()]
        n = len(ids)
        # an entry of the queue is (rank, merged id, position) as one number
        queue = [found * n + i for i in range(n - 1) if (found := merge(ids[i] << BITS | ids[i + 1]))]
        if not queue:
            return tuple(ids)
        heapify(queue)
        after = list(range(1, n + 1))  # n: none
        before = list(range(-1, n - 1))
        while queue:
            entry, i = divmod(heappop(queue), n)
            j = after[i]
            if j >= n or merge(ids[i] << BITS | ids[j]) != entry:  # stale: one of the two has been merged meanwhile
                continue
            ids[i] = merged = entry & MASK
            ids[j] = -1
            after[j], after[i] = n, (k := after[j])
            if k < n:
                before[k] = i
                if found := merge(merged << BITS | ids[k]):
                    heappush(queue, found * n + i)
            if (h := before[i]) >= 0 and (found := merge(ids[h] << BITS | merged)):
                heappush(queue, found * n + h)
        return tuple([x for x in ids if x >= 0])

    def _plain(self, text: str) -> bytes:
        recent, old = self.recent, self.old.get
        ids: list[bytes] = []
        for word in self.pattern.findall(text):
            found = recent.get(word)
            if found is None:
                found = recent[word] = old(word) or array("I", self.word(word)).tobytes()
            ids.append(found)
        return ids[0] if len(ids) == 1 else b"".join(ids)

    def piece(self, text: str) -> bytes:
        """Ids of a text; the strings of special tokens in it get their ids."""
        if not self.specials or not self.specials.search(text):
            return self._plain(text)
        ids: list[bytes] = []
        at = 0
        for m in self.specials.finditer(text):
            ids += (self._plain(text[at : m.start()]), array("I", [self.special[m.group()]]).tobytes())
            at = m.end()
        return b"".join([*ids, self._plain(text[at:])])

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as unsigned 32-bit integers."""
        if len(self.recent) > REMEMBERED:
            self.recent, self.old = {}, self.recent
        if len(self.recent_pieces) > REMEMBERED:
            self.recent_pieces, self.old_pieces = {}, self.recent_pieces
        recent, old = self.recent_pieces, self.old_pieces.get
        found = list(map(recent.get, pieces))
        for k in [k for k, ids in enumerate(found) if ids is None]:
            p = pieces[k]
            recent[p] = found[k] = old(p) or self.piece(p.decode())
        return found

    def encode(self, text: str) -> list[int]:
        return next(encode_column(pa.array([text]), self.pieces)).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(content: str) -> Codec:
    """One per worker and vocabulary; it remembers the ids of common pieces."""
    return Codec(content)


def encoded(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """``docs`` (with a string column text) plus n_tokens, ids (array<int>), ids_sha256, decoded_sha256.

    Ids are those of the tokenizers library for the vocabulary file at ``path``, without special tokens
    around the text; a null text counts as empty and has no ids. ids_sha256 is the hex digest of the decimal ids joined by commas,
    decoded_sha256 that of the UTF-8 text decoded from the ids. Columns of ``docs`` with these names are
    replaced. Without ``with_ids`` the ids stay on the executors.

    The vocabulary is read on the driver and broadcast; its size doesn't depend on the data.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("n_tokens", "ids", "ids_sha256", "decoded_sha256").withColumn("text", F.col("text").cast("string"))
    with open(path or default_path(), encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value)
        for batch in gathered(batches, "text"):
            counts, listed, ids_sha, text_sha = [], [], [], []
            for found in encode_column(batch.column("text"), own.pieces):
                ids = found.tolist()
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                if with_ids:
                    listed.append(pa.array(found.astype("<i4")))
            added = [pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            names = [*batch.schema.names, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = pa.array([0, *_running(counts)], pa.int32())
                added.append(pa.ListArray.from_arrays(ends, pa.concat_arrays(listed)))
                names.append("ids")
            yield from pa.Table.from_arrays([*batch.columns, *added], names=names).to_batches()

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def _running(counts: list[int]) -> Iterator[int]:
    total = 0
    for n in counts:
        total += n
        yield total


def op8_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    """Whole documents encoded and decoded with the byte-level vocabulary of about 50,000 ids."""
    found = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
