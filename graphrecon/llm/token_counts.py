"""Token counts of texts of any length by overlap resynchronisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrecon.llm.bpe import Pieces, load, space_pieces, worker_cache

#: Characters of a chunk, and of the first overlap of two chunks.
CHUNK, OVERLAP = 65_536, 512
#: Longer than any special string of the vocabulary: nearer to an end, one may have been cut.
MARGIN = 64
#: Texts that are taken from a batch at a time.
LOT = 500


def _edges(encoding) -> dict[int, int]:
    """Offsets at which a pretoken (or special string) starts, with the number of tokens before."""
    found, last = {}, object()
    for at, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word != last or word is None:
            found.setdefault(start, at)
        last = word
    return found


def chunked_ids(
    text: str, encode: Callable, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN
) -> Iterator[list[int]]:
    """Token ids of ``text``, a spliced run for each chunk.

    A chunk starts at a proven place: the start of the text, or an offset where both the chunk
    before and an encoding begun ``overlap`` characters earlier start a pretoken. Pretokens are
    found from left to right without looking back, so from such a place on both agree for ever;
    up to ``margin`` characters before the end of a chunk they agree with the whole text's. Where
    the overlap has no common start, it is doubled, up to the whole chunk; after that the chunk
    itself is doubled, up to the rest of the text, which needs no splice.
    """
    at, size = 0, chunk
    while at < len(text):
        end = at + size
        here = encode(text[at:end])
        if end >= len(text):
            yield here.ids
            return
        edges, wide, splice = _edges(here), overlap, None
        while splice is None and wide <= size:
            begin = end - wide
            there = _edges(encode(text[begin : end + wide]))
            common = [
                at + e
                for e in edges
                if at + e - begin in there and begin + margin <= at + e <= end - margin and e > 0
            ]
            splice = max(common, default=None)
            wide *= 2
        if splice is None:
            size *= 2
            continue
        yield here.ids[: edges[splice - at]]
        at, size = splice, chunk


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    limit: int = 1024,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``keep`` columns with ``n_bytes``, ``n_tokens`` and ``over_limit`` of each text.

    A null or empty text has no bytes and no tokens. Repeated rows are counted each; other columns
    are not read; an empty table gives an empty result. No shuffle: a task holds one batch of
    texts, and of a long text one chunk's encoding at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_cache(tokenizer_path, lambda: load(tokenizer_path))
        pieces = worker_cache(tokenizer_path + "#counts", lambda: Pieces(tokenizer, as_ids=False, cased=True))

        def encode(part):
            return tokenizer.encode(part, add_special_tokens=False)

        for batch in batches:
            totals, column = [], batch.column(batch.num_columns - 1)
            for at in range(0, len(column), LOT):
                texts = [x or "" for x in column.slice(at, LOT).to_pylist()]
                short = {i: space_pieces(x) for i, x in enumerate(texts) if len(x) <= chunk}
                pieces.learn(set().union(*[p for p in short.values() if p]))
                known = pieces.known.__getitem__
                for i, x in enumerate(texts):
                    if i not in short:
                        totals.append(sum(map(len, chunked_ids(x, encode, chunk, overlap))))
                    elif short[i] is None:
                        totals.append(len(encode(x).ids))
                    else:
                        totals.append(sum(map(known, short[i])))
            columns = [*batch.columns[:-1], pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_tokens"])

    kept = [F.col(c) for c in keep]
    texts = docs.select(
        *kept,
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text).alias("__text"),
    )
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields]
        + ["n_bytes long", "n_tokens long"]
    )
    return texts.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
