"""Removal of byte strings that stand anywhere else too, by distributed prefix doubling.

Prefix doubling ranks every position by ever longer strings: a rank is paired with that of what follows, the pairs
are sorted and ranked anew, until a position is alone with its rank or its string is as long as the threshold. Here
the positions are anchors: a window of ``LENGTH`` bytes belongs to the first least hash of ``GRAM`` bytes among
its ``SPREAD`` first ones, so equal windows have their anchors at equal offsets, and one anchor in some 130
bytes stands for all windows between. What all windows of an anchor share, the ``LENGTH - SPREAD + 1`` bytes from it on,
is ranked first. Anchors whose rank no other place has are done: none of their windows is repeated. If the stretch over all
windows of an anchor has a twin, all are. The rest is split into windows of ``STEP`` offsets each, whose shared bytes
grow to ``LENGTH - STEP + 1``: the old rank is paired with the hash of the bytes that came in, and places are
ranked anew. What is still open is split into single windows, whose strings have the full length.

Ranks are the least place of their class. Ranking shuffles numbers, classes are counted inside tasks first, and texts
move only where they hold open places. 64-bit hashes stand for texts, and pairs of a rank and a 64-bit hash for strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrecon.llm.batches import add_columns
from graphrecon.llm.ngram_join import _bit_filter, _may_hold
from graphrecon.session import ensure_checkpoint_dir, materialize

LENGTH = 400
SPREAD, STEP, GRAM = 256, 16, 16
CORE, NODE = LENGTH - SPREAD + 1, LENGTH - STEP + 1
#: Bytes of texts that are looked at together; longer texts go in parts.
PART = 1 << 20
_POSITION = np.uint64((1 << 24) - 1)
_ROW = "text_id long, at long, lo int, hi int, rank long, core long, full long"


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows inside the texts ``data[start:end]``, and each one's least and largest offset of a window."""
    n = len(data)
    padded = data + bytes(GRAM)
    first, second = (np.ndarray((n,), "<u8", padded, at, (1,)) for at in (0, 8))
    key = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    # A place behind the hash: the first of equal ones is the least.
    key = (key & ~_POSITION) | np.arange(n, dtype=np.uint64)
    width = 1
    while width < SPREAD:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(edges[:-1]))
    at = (key[windows] & _POSITION).astype(np.int64)
    new = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(new[1:], len(at)) - 1
    return at[new], at[new] - windows[last], at[new] - windows[new]


def _texts(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """A string column's bytes, and where each text starts (and the last ends)."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    return memoryview(data or b""), np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def _parts(offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First byte of a part, its texts' numbers, first bytes and ends; a text longer than a part goes in several."""
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    group: list[int] = []
    for i in [*long.tolist(), -1]:
        if group and (i < 0 or offsets[i + 1] - offsets[group[0]] > PART):
            some = np.array(group)
            yield offsets[group[0]], some, offsets[some], offsets[some + 1]
            group = []
        if i >= 0 and offsets[i + 1] - offsets[i] > PART:
            for begin in range(offsets[i], offsets[i + 1] - LENGTH + 1, PART):
                end = min(begin + PART + LENGTH - 1, offsets[i + 1])
                yield begin, np.array([i]), np.array([begin]), np.array([end])
        elif i >= 0:
            group.append(i)


def first_places(texts: DataFrame) -> DataFrame:
    """The anchors of ``texts`` (``text_id``, ``text``): ``_ROW``, with the hashes of their shared and of all their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for batch in batches:
            data, offsets = _texts(batch.column(1))
            ids = batch.column(0).to_numpy()
            for begin, some, starts, ends in _parts(offsets):
                part = bytes(data[begin : ends[-1]])
                at, lo, hi = anchors(part, starts - begin, ends - begin)
                owner = some[np.searchsorted(starts - begin, at, "right") - 1]
                places = list(zip(at.tolist(), lo.tolist(), hi.tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[owner], pa.int64()),
                        pa.array(at + begin - offsets[owner], pa.int64()),
                        pa.array(lo.astype(np.int32)),
                        pa.array(hi.astype(np.int32)),
                        pa.array(np.zeros(len(at), np.int64)),
                        _signed([digest(part[a : a + CORE]) for a, _, _ in places]),
                        _signed([digest(part[a - y : a - x + LENGTH], x << 8 | y) for a, x, y in places]),
                    ],
                    ["text_id", "at", "lo", "hi", "rank", "core", "full"],
                )

    return texts.mapInArrow(run, _ROW)


def _split(text: bytes, at: int, lo: int, hi: int, fine: bool) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Parts of an open place's offsets, each with the bytes that come in for its shared and for all its bytes."""
    if fine:
        left = at - lo // STEP * STEP  # of the bytes that the part's windows share, NODE long
        for o in range(lo, hi + 1):
            window = text[at - o : left] + text[left + NODE : at - o + LENGTH]
            yield o, o, window, window
        return
    for j in range(lo // STEP * STEP, hi + 1, STEP):
        x, y = max(lo, j), min(hi, j + STEP - 1)
        shared = text[at - j : at] + text[at + CORE : at - j + NODE]
        yield x, y, shared, text[at - y : at] + text[at + CORE : at - x + LENGTH]


def next_places(texts: DataFrame, places: DataFrame, fine: bool) -> DataFrame:
    """``_ROW`` of the parts of open places (``text_id``, ``at``, ``lo``, ``hi``, ``rank``): ``STEP`` offsets each, or single ones.

    Only texts that the bit filter lets through are shuffled; equal texts give their places once.
    """
    by_text = materialize(places.groupBy("text_id").agg(F.collect_set(F.struct("at", "lo", "hi", "rank")).alias("places")))
    held = _may_hold(texts, _bit_filter(by_text, "text_id"), "text_id").where("__maybe").select("text_id", "text")
    met = held.dropDuplicates(["text_id"]).join(by_text, "text_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for batch in batches:
            for text_id, text, some in zip(*(batch.column(i) for i in range(3))):
                rows, text = [], text.as_py().encode("utf-8", "surrogatepass")
                for p in some.as_py():
                    for x, y, core, full in _split(text, p["at"], p["lo"], p["hi"], fine):
                        name = x if fine else x // STEP
                        rows.append((p["at"], x, y, p["rank"], digest(core, name), digest(full, x << 8 | y)))
                at, lo, hi, rank, core, full = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([text_id.as_py()] * len(rows), pa.int64()),
                        pa.array(at, pa.int64()),
                        pa.array(lo, pa.int32()),
                        pa.array(hi, pa.int32()),
                        pa.array(rank, pa.int64()),
                        _signed(core),
                        _signed(full),
                    ],
                    ["text_id", "at", "lo", "hi", "rank", "core", "full"],
                )

    return met.select("text_id", "text", "places").mapInArrow(run, _ROW)


def _place() -> Column:
    return F.xxhash64("text_id", "at", "lo", "hi")


def _classes(places: DataFrame, key: str) -> DataFrame:
    """Pairs of rank and hash that more than one place has, with the new rank ``least``."""
    classes = places.groupBy("rank", key).agg(F.min(_place()).alias("least"), F.max(_place()).alias("most"))
    return materialize(classes.where("least < most").drop("most"))


def _written(df: DataFrame) -> DataFrame:
    """``df``, computed once, as a compressed table in the shared folder."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/places-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _ranked(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeated places (all their windows have a twin), and those that go on, with new ranks.

    Places of a rank of their own are done. Of repeated ones that share a rank with open ones, one of each string
    goes on, for the others to meet.
    """
    shared = places.join(_classes(places, "core"), ["rank", "core"]).select("text_id", "at", "lo", "hi", F.col("least").alias("rank"), "full")
    shared = _written(shared)
    marked = _written(shared.join(_classes(shared, "full"), ["rank", "full"], "left").select("text_id", "at", "lo", "hi", "rank", "least"))
    open_places = marked.where("least is null").drop("least")
    first = marked.where(F.col("least") == _place()).drop("least")
    return marked.where("least is not null").drop("least"), open_places.union(first.join(open_places.select("rank").distinct(), "rank", "left_semi").select(open_places.columns))


def repeated_stretches(texts: DataFrame) -> DataFrame:
    """``text_id`` and ``spans`` (``a`` to ``b``, in bytes, in no order) that windows standing elsewhere too cover.

    ``texts``: ``text_id`` (a hash of the text), ``text``, ``n_bytes``. Texts that the table holds twice are covered whole.
    """
    long = texts.where(F.col("n_bytes") >= LENGTH)
    copied = long.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.first("n_bytes").alias("b")).where("n > 1")
    whole = materialize(copied.select("text_id", F.lit(0).cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    repeated, open_places = _ranked(_written(first_places(long.select("text_id", "text"))))
    found = [repeated]
    for fine in (False, True):
        repeated, open_places = _ranked(_written(next_places(long.select("text_id", "text"), open_places, fine)))
        found.append(repeated)
    spans = [f.select("text_id", (F.col("at") - F.col("hi")).alias("a"), (F.col("at") - F.col("lo") + LENGTH).alias("b")) for f in found]
    single = spans[0].union(spans[1]).union(spans[2]).join(whole.select("text_id"), "text_id", "left_anti").distinct()
    return single.union(whole).groupBy("text_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if runs and a <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(runs[-1][1], b)
        else:
            runs.append((a, b))
    return runs


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the bytes left) of each document.

    Bytes covered by any ``LENGTH``-byte string of the table that also starts anywhere else, same document included, go;
    cuts may fall inside characters, so ``kept`` is binary. Null is empty, texts below ``LENGTH`` bytes stay as they are,
    repeated rows are copies of each other, an empty table gives an empty result. Other columns aren't read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"), whole.alias("text"), F.xxhash64(whole).alias("text_id"), F.octet_length(whole).cast("long").alias("n_bytes")
    )
    spans = materialize(repeated_stretches(rows.select("text_id", "text", "n_bytes")))
    held = _may_hold(rows, _bit_filter(spans, "text_id"), "text_id")
    zero = F.lit(0).cast("long")
    clear = held.where("not __maybe").select("key", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.lit(None).cast("binary").alias("kept"), "text")

    def cut(texts, found):
        removed, count, kept = [], [], []
        for x, some in zip(texts, found):
            runs, data = merged(some or []), x.encode("utf-8", "surrogatepass")
            removed.append(sum(b - a for a, b in runs))
            count.append(len(runs))
            edges = [0, *[e for run in runs for e in run], len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else None)
        return removed, count, kept

    touched = held.where("__maybe").join(spans, "text_id", "left").select("key", "n_bytes", "text", "spans")
    added = add_columns(touched, ["text", "spans"], {"n_removed": "long", "n_spans": "long", "kept": "binary"}, cut, ["spans"])
    every = clear.unionByName(added)
    return every.select(
        F.col("key").alias(key), "n_bytes", "n_removed", "n_spans", F.coalesce("kept", F.col("text").cast("binary")).alias("kept")
    )
