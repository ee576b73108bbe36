"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features scores a text; ordered thresholds cut the score into
grades: P(grade <= k) = logistic(threshold_k - score). So all grades share the weights, and the model gives an
expected grade and the probability of each grade or better.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrecon.llm.batches import add_columns

BITS = 18
#: The most labelled rows, of each grade, that the fit looks at.
TRAIN_ROWS = 4_000
MOST_GRADES = 100

_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_SHARES = (("upper", range(0x41, 0x5B)), ("digit", range(0x30, 0x3A)), *[(c, (ord(c),)) for c in "!?#*$%&|<>.,"])


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct hashed features of a whole text: its words, and buckets of a few shares and sizes.

    A null or empty text has the buckets alone.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.translate(_WORDS).split()
    distinct = set(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    whole = max(1, len(data))
    notes = [f"\x00{n}{int(np.log2(1 + 1000 * counts[list(b)].sum() / whole))}".encode() for n, b in _SHARES]
    notes.append(f"\x00size{len(words).bit_length()}".encode())
    notes.append(f"\x00same{int(10 * len(distinct) / max(1, len(words)))}:{len(words).bit_length()}".encode())
    mask = (1 << bits) - 1
    return np.unique(np.fromiter((zlib.crc32(w) & mask for w in (*distinct, *notes)), np.int32))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1; a column each."""
        return _logistic(scores[:, None] - self.thresholds[None, :])

    def score(self, text: str | None, bits: int = BITS) -> float:
        return float(self.weights[features(text, bits)].sum())


def telling(
    rows: list[np.ndarray], grades: np.ndarray, count: int, least: float, rows_with: int, bits: int = BITS
) -> np.ndarray:
    """Which features go with the grade: those in ``rows_with`` rows whose G statistic reaches ``least``.

    The others, nearly all of them rare words, would only be learned by heart.
    """
    at, sizes = np.concatenate(rows), [len(x) for x in rows]
    n, having = len(rows), np.bincount(at, minlength=1 << bits)
    total = np.zeros(1 << bits)
    for k in range(count):
        own = grades == k
        seen = np.bincount(at, np.repeat(own.astype(float), sizes), 1 << bits)
        for found, expected in ((seen, having * own.sum() / n), (own.sum() - seen, (n - having) * own.sum() / n)):
            some = (found > 0) & (expected > 0)
            total[some] += 2 * found[some] * np.log(found[some] / expected[some])
    return (total >= least) & (having >= rows_with)


def fit(
    rows: list[np.ndarray],
    grades: np.ndarray,
    count: int,
    weight: np.ndarray | None = None,
    epochs: int = 20,
    batch: int = 256,
    rate: float = 0.1,
    shrink: float = 1e-4,
    association: float = 24.0,
    rows_with: int = 5,
    seed: int = 5,
    bits: int = BITS,
) -> OrdinalModel:
    """Fit by AdaGrad on the features that ``telling`` leaves. ``weight``: of each row.

    Thresholds stay in order as sums of exponentials.
    """
    rng = np.random.default_rng(seed)
    weights = np.zeros(1 << bits)
    first, gaps = -2.0, np.zeros(max(0, count - 2))
    if not rows or count < 2:
        return OrdinalModel(weights, np.full(max(1, count - 1), -40.0))
    told = telling(rows, grades, count, association, rows_with, bits)
    rows = [x[told[x]] for x in rows]
    weight = np.ones(len(rows)) if weight is None else weight
    past, past_cut = np.full(1 << bits, 1e-8), np.full(count - 1, 1e-8)
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            sizes = np.array([len(rows[i]) for i in some])
            at = np.concatenate([rows[i] for i in some])
            ends = np.cumsum(sizes)
            sums = np.concatenate([[0.0], np.cumsum(weights[at])])
            scores = sums[ends] - sums[ends - sizes]
            y, w = grades[some], weight[some] / len(some)
            # With F_k = logistic(cut_k - score): slopes of -log(F_y - F_{y-1}).
            upper = np.where(y < count - 1, _logistic(np.append(cuts, 40.0)[y] - scores), 1.0)
            lower = np.where(y > 0, _logistic(np.append(cuts, 40.0)[y - 1] - scores), 0.0)
            p = np.maximum(upper - lower, 1e-12)
            up, down = upper * (1 - upper) / p, lower * (1 - lower) / p
            slope = w * (up - down)  # of the loss by the score
            by_cut = np.zeros(count - 1)
            np.add.at(by_cut, y[y < count - 1], -(w * up)[y < count - 1])
            np.add.at(by_cut, y[y > 0] - 1, (w * down)[y > 0])
            by_weight = np.bincount(at, np.repeat(slope, sizes), 1 << bits)
            touched = np.flatnonzero(by_weight)
            g = by_weight[touched] + shrink * weights[touched]
            past[touched] += g * g
            weights[touched] -= rate * g / np.sqrt(past[touched])
            by_own = np.append(by_cut.sum(), [by_cut[k + 1 :].sum() * np.exp(gaps[k]) for k in range(count - 2)])
            past_cut += by_own**2
            move = rate * by_own / np.sqrt(past_cut)
            first -= move[0]
            gaps = np.clip(gaps - move[1:], -6, 6)
    return OrdinalModel(weights, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def train(
    docs: DataFrame,
    ratings: DataFrame,
    key: str = "doc_id",
    grade: str = "grade",
    text: str = "text",
    most: int = TRAIN_ROWS,
    **options,
) -> OrdinalModel:
    """Fit on at most ``most`` rated rows of each grade, drawn by a hash of the key.

    ``ratings``: a key and an integer grade from 0, ``MOST_GRADES`` different ones or an error is raised;
    a key rated more than once takes its lowest grade, a null grade counts as not given. Rows weigh as much as their grade has in all ratings.
    Only drawn keys (a bounded number) are sent to the tasks, and only features come back.
    """
    lowest = ratings.groupBy(F.col(key)).agg(F.min(grade).cast("int").alias("__grade")).where("__grade >= 0")
    counts = dict(map(tuple, lowest.groupBy("__grade").count().orderBy("__grade").limit(MOST_GRADES + 1).collect()))
    if len(counts) > MOST_GRADES:
        raise ValueError(f"ratings have more than {MOST_GRADES} grades: merge grades before training")
    draw, wanted = F.pmod(F.xxhash64(key), F.lit(1 << 30)), F.lit(False)
    for g, n in counts.items():
        wanted = wanted | ((F.col("__grade") == g) & (draw < int(min(1.0, most / n) * (1 << 30))))
    drawn = lowest.where(wanted).limit(2 * most * max(1, len(counts)))
    grades = sorted(counts)

    def run(texts):
        return [[features(x).astype("<i4").tobytes() for x in texts]]

    texts = docs.select(F.col(key), F.col(text).alias("__text")).join(F.broadcast(drawn), key)
    found = add_columns(texts.select("__grade", "__text"), ["__text"], {"features": "binary"}, run, ["__text"])
    got = sorted((r["__grade"], bytes(r["features"])) for r in found.limit(2 * most * max(1, len(counts))).collect())
    place = {g: i for i, g in enumerate(grades)}
    y = np.array([place[g] for g, _ in got], dtype=int)
    rows = [np.frombuffer(x, "<i4") for _, x in got]
    have = np.bincount(y, minlength=len(grades)) if len(y) else np.zeros(len(grades))
    total = max(1, sum(counts.values()))
    weight = np.array([counts[g] / total * len(y) / max(1, have[place[g]]) for g, _ in got])
    return fit(rows, y, len(grades), weight, **options)


def grade_texts(
    docs: DataFrame,
    model: OrdinalModel,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    names: tuple[str, str] = ("expected_grade", "p_best"),
) -> DataFrame:
    """``keep`` columns with ``expected_grade`` and ``p_best``, the probability of the best grade.

    A null or empty text is graded by its sizes alone. Without rated rows every text has the best
    grade. Repeated rows are graded each; columns of the two ``names`` are replaced;
    an empty table gives an empty result. No shuffle; tasks hold the weights and one batch.
    """
    weights, thresholds = model.weights.astype(np.float32), model.thresholds

    def run(texts):
        scores = np.array([float(weights[features(x)].sum()) for x in texts])
        tails = OrdinalModel(weights, thresholds).tails(scores)
        return tails.sum(axis=1), tails[:, -1]

    if text in keep:
        return add_columns(docs.select(*[F.col(c) for c in keep]), [text], dict.fromkeys(names, "double"), run)
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    return add_columns(rows, ["__text"], dict.fromkeys(names, "double"), run, ["__text"])


def label_grades(labels: DataFrame) -> DataFrame:
    """Ratings from the two given labels: 0 toxic, 1 of low quality, 2 good; null if both are null."""
    toxic, quality = F.col("toxic"), F.col("quality")
    grade = F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def accepted(p_best: Column, least: float = 0.5) -> Column:
    return p_best >= least
