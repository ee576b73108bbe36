"""Language of texts by a convolutional network over bytes, trained here in numpy.

A text's bytes, with ASCII letters lowered and all that is no letter made a space, are cut into
windows of fixed length. Filters of several widths look at each place of a window, the largest answer
of each filter is kept, and a softmax over languages follows. A filter over one-hot bytes is a table
of weights by byte and place, so that answers are sums of table rows and need no products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrecon.llm.batches import add_columns

WIDTHS, FILTERS, LENGTH = (2, 3, 4), 16, 256
#: About the rows that training looks at: so many of all languages together, or so many of each language where that is more.
TRAIN_ROWS, LEAST_ROWS = 4_000, 32
#: The most characters of a row.
TRAIN_CHARS = 2_000
UNKNOWN = "und"
#: Windows that go through the network at once.
WORK = 64

_BYTES = bytes(
    b + 32
    if 0x41 <= b <= 0x5A or 0x80 <= b <= 0x9E  # also the second byte of Latin capitals
    else b
    if 0x61 <= b <= 0x7A or b >= 0x80
    else 0x20
    for b in range(256)
)


def windows_of(text: str | None, length: int = LENGTH) -> np.ndarray:
    """All windows of a text, zero-padded; none if nothing but spaces is left."""
    data = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split())
    if not data:
        return np.zeros((0, length), np.uint8)
    data = b" " + data + b" "
    return np.frombuffer(data + bytes(-len(data) % length), np.uint8).reshape(-1, length)


@dataclass
class ByteNet:
    languages: list[str]
    tables: list[np.ndarray]  # for each width: width x 256 x filters
    bias: np.ndarray
    dense: np.ndarray  # all filters x languages
    shift: np.ndarray

    def pooled(self, windows: np.ndarray, places: bool = False):
        """Largest answer of each filter, and on request the place where it was."""
        best, where, at = [], [], 0
        for table in self.tables:
            width, _, filters = table.shape
            last = windows.shape[1] - width + 1
            answer = table[0][windows[:, :last]]
            for j in range(1, width):
                answer += table[j][windows[:, j : j + last]]
            if places:
                where.append(answer.argmax(axis=1))
            best.append(answer.max(axis=1) + self.bias[at : at + filters])
            at += filters
        found = np.concatenate(best, axis=1)
        return (found, where) if places else found

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        scores = np.maximum(self.pooled(windows), 0) @ self.dense + self.shift
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)


def train_net(
    texts: list[str],
    labels: list[str],
    seed: int = 7,
    epochs: int = 6,
    batch: int = 64,
    rate: float = 0.01,
    per_text: int = 3,
) -> ByteNet:
    """Fit by Adam on windows cut at random places and lengths; each language has the same weight."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    where = {x: i for i, x in enumerate(languages)}
    rows, truth = [], []
    for text, label in zip(texts, labels):
        flat = windows_of(text).reshape(-1)
        flat = flat[: np.flatnonzero(flat)[-1] + 1] if len(flat) else flat
        for _ in range(per_text if len(flat) else 0):
            size = min(len(flat), int(np.exp(rng.uniform(np.log(12), np.log(LENGTH + 1)))))
            start = int(rng.integers(0, len(flat) - size + 1))
            rows.append(np.concatenate([flat[start : start + size], np.zeros(LENGTH - size, np.uint8)]))
            truth.append(where[label])
    total = FILTERS * len(WIDTHS)
    net = ByteNet(
        languages,
        [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(total, np.float32),
        rng.normal(0, 0.1, (total, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    for table in net.tables:
        table[:, 0] = 0  # padding says nothing
    if not rows or len(languages) < 2:
        return net
    x, y = np.stack(rows), np.array(truth)
    weight = (len(y) / len(languages) / np.maximum(1, np.bincount(y, minlength=len(languages))))[y].astype(np.float32)
    values = [*net.tables, net.bias, net.dense, net.shift]
    first = [np.zeros_like(v) for v in values]
    second = [np.zeros_like(v) for v in values]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for some in np.array_split(order, max(1, len(y) // batch)):
            windows = x[some]
            found, places = net.pooled(windows, places=True)
            active = np.maximum(found, 0)
            scores = active @ net.dense + net.shift
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p *= weight[some][:, None] / len(some)
            back = (p @ net.dense.T) * (found > 0)
            slopes, at = [], 0
            for table, place in zip(net.tables, places):
                slope, part = np.zeros_like(table), back[:, at : at + FILTERS]
                for j in range(table.shape[0]):
                    seen = np.take_along_axis(windows, place + j, axis=1)
                    np.add.at(slope[j], (seen, np.broadcast_to(np.arange(FILTERS), seen.shape)), part)
                slope[:, 0] = 0
                slopes.append(slope)
                at += FILTERS
            slopes += [back.sum(axis=0), active.T @ p + 1e-4 * net.dense, p.sum(axis=0)]
            step += 1
            for v, g, m, s in zip(values, slopes, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def training_rows(
    docs: DataFrame, key: str, label: str, text: str, most: int = TRAIN_ROWS, least: int = LEAST_ROWS
) -> DataFrame:
    """About ``most`` rows, as many of each language, or ``least`` of each; drawn by a hash of key and text.

    All rows of a rare language are taken, at least one of any, and equal rows once. Of each text a stretch from a
    drawn place, ``TRAIN_CHARS`` characters or less where there are more rows. One row per language reaches the driver.
    """
    found = F.xxhash64(key, text)
    rows = docs.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(label).alias("label"), F.col(text).alias("text"), found.alias("found"), F.pmod(found, F.lit(1 << 30)).alias("draw")
    )
    counts = rows.groupBy("label").agg(F.count(F.lit(1)), F.min("draw")).collect()
    share = max(least, most / max(1, len(counts)))
    upto = [(name, max(first + 1, int(min(1.0, share / count) * (1 << 30)))) for name, count, first in counts]
    bounds = docs.sparkSession.createDataFrame(upto, f"label {docs.schema[label].dataType.simpleString()}, upto long")
    chars = max(LENGTH, int(TRAIN_CHARS * min(1.0, most / (share * max(1, len(counts))))))
    room = F.greatest(F.length("text") - chars, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("text"), room.cast("long")).cast("int") + 1
    return (
        rows.join(F.broadcast(bounds), "label")
        .where(F.col("draw") < F.col("upto"))
        .select("label", "found", F.substring("text", start, F.lit(chars)).alias("text"))
        .dropDuplicates(["label", "found"])
        .select("label", "text")
    )


def train_language_net(docs: DataFrame, key: str = "doc_id", label: str = "lang", text: str = "text", **options) -> ByteNet:
    """Train on a sample of the labelled ``docs``, bounded for each label; every label with a letter in a text is learned."""
    rows = sorted((r["label"], r["text"]) for r in training_rows(docs, key, label, text).collect())
    return train_net([t for _, t in rows], [x for x, _ in rows], **options)


def predict_language(
    docs: DataFrame, net: ByteNet, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``, the mean probability over all windows.

    A null text and one without a letter is ``und`` with score 0; so is every text if no language was
    learned. Repeated rows are judged each; no other column is read; an empty table gives an
    empty result. No shuffle; a task holds a batch of texts and some hundred windows.
    """

    def predict(texts, letters):
        sums = np.zeros((len(texts), max(1, len(net.languages))))
        waiting, owners, held = [], [], 0

        def work():
            windows = np.concatenate(waiting)
            found = net.probabilities(windows) * (windows != 0).sum(axis=1, keepdims=True)
            np.add.at(sums, np.repeat([o for o, _ in owners], [n for _, n in owners]), found)
            waiting.clear()
            owners.clear()

        for i, (own, has) in enumerate(zip(texts, letters)):
            windows = windows_of(own) if has and net.languages else ()
            for at in range(0, len(windows), WORK):
                part = windows[at : at + WORK]
                waiting.append(part)
                owners.append((i, len(part)))
                held += len(part)
                if held >= WORK:
                    work()
                    held = 0
        if waiting:
            work()
        total, best = sums.sum(axis=1), sums.argmax(axis=1)
        known = total > 0
        languages = [net.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return languages, np.where(known, sums.max(axis=1) / np.where(known, total, 1), 0.0).clip(0, 1)

    has = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letters")
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"), has)
    return add_columns(
        rows, ["__text", "__letters"], {"lang_pred": "string", "score": "double"}, predict, ["__text", "__letters"]
    )
