"""Token ids in wavelet matrix files: one compressed file per shard, read without unpacking it.

A file holds the ids of whole documents, one after another, as bit planes over the shard's own
alphabet: plane k has the k-th highest bit of every id, after the ids have been sorted, stably, by
the bits above. A directory of ones before every 512 bits answers rank in constant time, so single
tokens, counts of a token in a range and the places of a token come straight from the planes.

File: ``WMTX1``; then little-endian uint64 numbers of tokens, documents, symbols and planes; the
symbols (uint32), the document starts (int64, one more than documents), the document ids (int64) and
whether each is known (uint8); the number of zeros in each plane (uint64); for each plane its words
(uint8, padded to 64 bytes) and its directory (uint32). The file is stored in rows of a Parquet table, the only store
that every executor can write and read in one way on any file system.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphrecon.llm.bpe import Pieces, load, word_pieces, worker_cache
from graphrecon.session import ensure_checkpoint_dir, task_slots

MAGIC = b"WMTX1"
#: Tokens of a shard; a single longer document has a shard of its own.
SHARD_TOKENS = 1 << 20
#: Texts that are cut into pieces at a time.
LOT = 250
BLOCK = 512  # bits between two entries of the rank directory
_ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


def write_matrix(ids: np.ndarray, starts: np.ndarray, doc_ids: list) -> bytes:
    """The file of one shard. ``starts``: the first token of each document, and the end."""
    n = len(ids)
    used = np.bincount(ids, minlength=1) > 0 if n else np.zeros(1, bool)
    symbols = np.flatnonzero(used).astype("<u4")
    planes = max(1, int(len(symbols) - 1).bit_length()) if len(symbols) else 0
    kind = np.uint16 if len(symbols) <= 1 << 16 else np.uint32
    codes = (np.cumsum(used) - 1).astype(kind)[ids] if n else np.zeros(0, kind)
    zeros, body = [], []
    for k in reversed(range(planes)):
        bit = (codes >> kind(k)) & kind(1) != 0
        packed = np.packbits(bit)
        packed = np.concatenate([packed, np.zeros(-len(packed) % 64, np.uint8)])
        ones = _ONES[packed].reshape(-1, 64).sum(axis=1, dtype=np.uint32)
        body += [packed.tobytes(), np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes()]
        zeros.append(n - int(bit.sum()))
        codes = np.concatenate([codes.compress(~bit), codes.compress(bit)])
    head = np.array([n, len(doc_ids), len(symbols), planes], dtype="<u8")
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    named = np.array([d if d is not None else 0 for d in doc_ids], dtype="<i8")
    parts = [MAGIC, head, symbols, np.asarray(starts, "<i8"), named, known, np.array(zeros, "<u8"), *body]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class WaveletMatrix:
    """Reads a shard's file: tokens, counts and places, by rank and select on its planes."""

    def __init__(self, file: bytes):
        if file[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self._file, self._at = file, len(MAGIC)
        self.n, docs, symbols, planes = map(int, self._take("<u8", 4))
        self.symbols = self._take("<u4", symbols)
        self.starts = self._take("<i8", docs + 1)
        ids, known = self._take("<i8", docs), self._take("u1", docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.zeros = [int(z) for z in self._take("<u8", planes)]
        size = -(-self.n // BLOCK)
        self.planes = [(self._take("u1", size * 64), self._take("<u4", size + 1)) for _ in self.zeros]

    def _take(self, kind: str, count: int) -> np.ndarray:
        found = np.frombuffer(self._file, kind, count, self._at)
        self._at += found.nbytes
        return found

    def _rank(self, plane: int, at: int) -> int:
        """Ones before place ``at``."""
        words, before = self.planes[plane]
        block, byte = at // BLOCK, at // 8
        found = int(before[block]) + int(_ONES[words[block * 64 : byte]].sum())
        return found + (int(_ONES[words[byte] >> (8 - at % 8)]) if at % 8 else 0)

    def _select(self, plane: int, bit: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) such bit, by bisection over rank."""
        low, high = 0, self.n
        while high - low > 1:
            mid = (low + high) // 2
            ones = self._rank(plane, mid)
            if (ones if bit else mid - ones) <= nth:
                low = mid
            else:
                high = mid
        return low

    def access(self, at: int) -> int:
        """The token at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        code = 0
        for k, (words, _) in enumerate(self.planes):
            bit = int(words[at // 8] >> (7 - at % 8)) & 1
            ones = self._rank(k, at)
            at = self.zeros[k] + ones if bit else at - ones
            code = code << 1 | bit
        return int(self.symbols[code])

    def _descend(self, token: int, low: int, high: int) -> tuple[int, int, int] | None:
        code = int(np.searchsorted(self.symbols, token))
        if code == len(self.symbols) or self.symbols[code] != token:
            return None
        for k in range(len(self.planes)):
            a, b = self._rank(k, low), self._rank(k, high)
            if code >> (len(self.planes) - 1 - k) & 1:
                low, high = self.zeros[k] + a, self.zeros[k] + b
            else:
                low, high = low - a, high - b
        return code, low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often a token stands in places ``low`` to ``high`` (exclusive)."""
        found = self._descend(token, low, self.n if high is None else high)
        return found[2] - found[1] if found else 0

    def find(self, token: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) occurrence of a token; -1 if there are fewer."""
        found = self._descend(token, 0, self.n)
        if not found or not 0 <= nth < found[2] - found[1]:
            return -1
        code, at = found[0], found[1] + nth
        for k in reversed(range(len(self.planes))):
            bit = code >> (len(self.planes) - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All ids in order (uint32): the sorts undone from the last plane to the first."""
        kind = np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32
        codes = np.zeros(self.n, kind)
        for k in reversed(range(len(self.planes))):
            bit = np.unpackbits(self.planes[k][0], count=self.n).view(bool)
            before = np.empty_like(codes)
            np.place(before, ~bit, codes[: self.zeros[k]])
            np.place(before, bit, codes[self.zeros[k] :] | kind(1 << (len(self.planes) - 1 - k)))
            codes = before
        return self.symbols[codes]


@contextmanager
def small_batches(spark: SparkSession, rows: int = LOT):
    """What is run inside sends at most so many rows at once to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_shards(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode every text, append ``end_id``, and write shards in ascending order of ``doc_id``.

    Equal ids are ordered by a hash of the text, then arbitrarily (they are then the same row);
    null ids come last. A null text is encoded as an empty one. Rows written: ``part`` and ``seq``
    order the shards, ``n_tokens``, ``file``. One shuffle, of the texts, by ranges of the id; the tie-breaker splits
    ranges of one id. An empty table writes no shard.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_cache(tokenizer_path, lambda: load(tokenizer_path))
        pieces = worker_cache(tokenizer_path + "#ids", lambda: Pieces(tokenizer, as_ids=True, cased=False))
        kind = pieces.kind
        part = TaskContext.get().partitionId()
        end, seq = np.array([end_id], kind).tobytes(), itertools.count()
        names, encoded, held = [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(encoded), kind)
            starts = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]) // kind.itemsize
            file = write_matrix(ids, starts, names)
            values = [pa.array([part], pa.int32()), pa.array([next(seq)], pa.int32()), pa.array([len(ids)], pa.int64())]
            return pa.RecordBatch.from_arrays([*values, pa.array([file], pa.binary())], ["part", "seq", "n_tokens", "file"])

        for batch in batches:
            for at in range(0, batch.num_rows, LOT):
                some = batch.slice(at, LOT)
                known = pieces.known.__getitem__
                for x, name in zip(some.column(1).to_pylist(), some.column(0).to_pylist()):
                    x = x or ""
                    c = word_pieces(x)
                    ids = (
                        np.array(tokenizer.encode(x, add_special_tokens=False).ids, kind).tobytes()
                        if c is None
                        else b"".join(map(known, c))
                    )
                    encoded.append(ids + end)
                    names.append(name)
                    held += len(ids) // kind.itemsize + 1
                    if held >= shard_tokens:
                        yield flush()
                        names, encoded, held = [], [], 0
        if names:
            yield flush()

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
        F.col(text).alias("text"),
    )
    order = [F.asc_nulls_last("doc_id"), "tie", "row"]
    parts = task_slots(docs.sparkSession)
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    with small_batches(docs.sparkSession):
        ranged.mapInArrow(shards, "part int, seq int, n_tokens long, file binary").write.mode("overwrite").parquet(path)


def read_shards(docs_path: str, spark) -> DataFrame:
    """Per document of the shards: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, from the files alone."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                part, seq, file = (c[at].as_py() for c in batch.columns)
                matrix = WaveletMatrix(file)
                ids, starts = matrix.tokens().astype("<u4", copy=False), matrix.starts
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1], starts[1:])]
                many = len(sums)
                columns = [
                    pa.array([part] * many, pa.int32()),
                    pa.array([seq] * many, pa.int32()),
                    pa.array(matrix.doc_ids, pa.int64()),
                    pa.array(starts[:-1].astype(np.int64)),
                    pa.array(np.diff(starts).astype(np.int64)),
                    pa.array(sums, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    files = spark.read.parquet(docs_path)
    # Two steps of running totals: over the shards of a part, and over the parts, one row each.
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = parts.select("part", F.coalesce(F.sum("n").over(above), zero).alias("above"))
    shards = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), zero).alias("inside"))
    rows = files.select("part", "seq", "file").mapInArrow(
        decode, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long"
    )
    starts = shards.join(bases, "part").select("part", "seq", (F.col("above") + F.col("inside")).alias("base"))
    return rows.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


def shard_folder(spark, name: str) -> str:
    """A new folder for shards below the shared one."""
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
