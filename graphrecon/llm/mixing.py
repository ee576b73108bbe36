"""Mixing sources to target weights by entropy balancing.

Among all document rates that give each source its target number of words, take those nearest to one
copy of every document, by relative entropy and with no rate above ``most``. The convex dual has one
number per source, and the rates are exponentially tilted by size: rate = min(most, exp(tilt x size / mean size)).
Newton's method finds all tilts at once; each step is one aggregate over the table of (source, size)
counts, whose rows are bounded by sources times sizes, not by documents. Rates then become whole copies by running
totals, so that each source's words stay within half its longest document of the
target; a few single copies more or less take up most of that rest.

All steps are DataFrame operations; only the sums over all sources come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrecon.operators.prefix import global_index, running_totals
from graphrecon.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Newton steps at most; four to eight are usual. Each keeps a bracket and halves it where a step leaves it.
STEPS, TOLERANCE = 40, 1e-7
#: Single copies that each source adds or gives back after the rounding.
CORRECTIONS = 3
_UNIT = 1 << 30  # fractions of copies are whole numbers of this, so that sums don't depend on order


def word_count(text: Column) -> Column:
    """Words between spaces and the controls 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from rows of ``source`` and ``source_size``, one per source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all words; a target stops
    at ``most`` times its source's words, and the excess goes to the others by weight. That is target =
    min(most x size, level x weight) for the level that makes the sum right; level by level, sources that reach their
    cap leave the sum, until none does.
    """
    # Spark orders strings by their bytes, so by code points.
    order = [F.col("source").isNull().alias("absent"), F.coalesce("source", F.lit("")).alias("named")]
    placed = global_index(sizes.select("*", *order), ["absent", "named"], "place")
    at = F.pmod("place", F.lit(len(weights))).cast("int")
    weighed = materialize(
        placed.select(
            "source",
            "source_size",
            F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at + 1).alias("weight"),
            (F.col("source_size") * most).alias("cap"),
        )
    )
    total = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("cap")
        row = weighed.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("caps"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weights"),
            F.coalesce(F.sum(full.cast("long")), F.lit(0)).alias("n"),
        ).first()
        if row["n"] == capped or not row["weights"]:
            break
        level, capped = (total - row["caps"]) / row["weights"], row["n"]
    return weighed.select(
        "source", "source_size", F.least("cap", F.col("weight") * level).alias("target")
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def tilts(counts: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """``source``, ``tilt`` and ``mean``: the dual solution for each source with words.

    ``counts``: ``source``, ``size``, ``n`` documents. A target at the cap has no finite tilt and gets a null one:
    every rate is ``most``.
    """
    filled = counts.where("size > 0")
    means = filled.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    # A tilt in either direction beyond 700 mean sizes is beyond what doubles tell apart.
    state = materialize(
        targets.alias("t")
        .join(means.alias("m"), _same(F.col("t.source"), F.col("m.source")))
        .select(
            "t.source",
            "target",
            "mean",
            (F.col("target") >= F.col("source_size") * most * (1 - 1e-12)).alias("full"),
            F.log(F.col("target") / F.col("source_size")).alias("tilt"),  # right if all sizes are equal
            F.lit(float("-inf")).alias("low"),
            F.lit(float("inf")).alias("high"),
            F.lit(False).alias("done"),
        )
    )
    names = ["source", "target", "mean", "full", "tilt", "low", "high", "done"]
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        sums = (
            filled.alias("c")
            .join(state.where("not full and not done").alias("s"), _same(F.col("c.source"), F.col("s.source")))
            .groupBy("s.source")
            .agg(
                F.sum(words * F.least(rate, F.lit(most))).alias("got"),
                F.sum(F.when(rate < most, words * rate * x).otherwise(0.0)).alias("slope"),
            )
        )
        miss = F.col("got") - F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        # Newton on log(got) = log(target): for one size it is exact in one step.
        step = F.col("tilt") - F.log(F.col("got") / F.col("target")) * F.col("got") / F.col("slope")
        wide = F.lit(float("inf"))
        middle = (
            F.when((F.col("high") < wide) & (F.col("low") > -wide), (F.col("low") + F.col("high")) / 2)
            .when(F.col("low") > -wide, F.greatest(F.col("low") * 2, F.col("low") + 1))
            .otherwise(F.least(F.col("high") * 2, F.col("high") - 1))
        )
        fits = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        met = F.abs(miss) <= F.col("target") * TOLERANCE
        moved = (
            state.alias("s")
            .join(sums.alias("g"), _same(F.col("s.source"), F.col("g.source")), "left")
            .select(
                "s.source", "target", "mean", "full", "tilt", low.alias("low"), high.alias("high"),
                "got", "slope", (F.col("done") | F.coalesce(met, F.lit(False))).alias("done"),
            )
        )
        state = materialize(
            moved.withColumn(
                "tilt", F.when(F.col("full") | F.col("done"), F.col("tilt")).otherwise(F.when(fits, step).otherwise(middle))
            ).select(*names)
        )
        if state.where("not full and not done").isEmpty():
            break
    else:
        raise RuntimeError(f"a source's rates did not meet its target in {STEPS} Newton steps")
    return state.select("source", F.when(~F.col("full"), F.round("tilt", 9)).alias("tilt"), "mean")


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """``key``, ``source``, ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` of each document.

    Sizes are words; a null or empty text has none, a rate of 1 and one copy, which adds no word.
    A null source is a source of its own. Repeated documents get rates and copies each. A source of
    no words has target 0. An empty table gives an empty result. Reruns agree: fractions are whole
    numbers of 2^-30, ties are ordered by the key and a hash of the text, and what is left then is the
    same row.
    """
    rows = materialize(
        docs.select(
            F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            F.xxhash64(text).alias("tie"), F.xxhash64(key).alias("draw"),
        )
    )
    counts = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, most))
    solved = tilts(counts, targets, most)
    rate = (
        F.when(F.col("size") == 0, 1.0)
        .when(F.col("tilt").isNull(), F.lit(most))
        .otherwise(F.least(F.lit(most), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    )
    # Fractions run on from size to size and from source to source, largest first in each, so the
    # number of extra copies is right to half a copy at every point: by partial summation the words are
    # right to half the longest document. The running totals need one row per source and size.
    ruled = (
        counts.alias("c")
        .join(targets.alias("t"), _same(F.col("c.source"), F.col("t.source")))
        .join(solved.alias("s"), _same(F.col("c.source"), F.col("s.source")), "left")
        .select("c.source", "size", "n", "source_size", "target", rate.alias("rate"))
        .withColumn("whole", F.floor("rate"))
        .withColumn("parts", F.round((F.col("rate") - F.floor("rate")) * _UNIT).cast("long") * F.col("n"))
        .withColumn("absent", F.col("source").isNull())
        .withColumn("named", F.coalesce("source", F.lit("")))
        .withColumn("fall", -F.col("size"))
    )
    ruled = running_totals(ruled, ["absent", "named", "fall"], ["parts"])
    upto, half = F.col("parts_upto"), _UNIT // 2
    extra = F.floor((upto + half) / _UNIT) - F.floor((upto - F.col("parts") + half) / _UNIT)
    ruled = ruled.withColumn("extra", F.least(F.greatest(extra, F.lit(0)), F.col("n")))
    ruled = materialize(ruled.select("source", "size", "n", "source_size", "target", "rate", "whole", "extra"))
    for _ in range(CORRECTIONS):
        ruled = materialize(_corrected(ruled, most))
    # Documents of one source and size are alike; which get the extra copies is settled by number.
    numbered = _numbers(rows, ["source", "size"], ["draw", "key", "tie"])
    return (
        numbered.alias("d")
        .join(ruled.alias("r"), _same(F.col("d.source"), F.col("r.source")) & (F.col("d.size") == F.col("r.size")))
        .select(
            F.col("key").alias(key),
            F.col("d.source").alias(source),
            "d.size",
            "source_size",
            "target",
            "rate",
            (
                F.col("whole")
                + (F.col("number") < F.col("extra")).cast("long")
                - (F.col("number") < -F.col("extra")).cast("long")
            ).alias("copies"),
        )
    )


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs``, each as often as ``mix_sources`` takes it; all columns pass through, whatever their names.

    Documents of one key, text and source are alike and share their copies. Of such rows the first ones, by any
    order, take what doesn't go evenly.
    """
    row = F.xxhash64(key, text, source)
    rows = docs.select(row.alias("row"), F.struct("*").alias("doc"))
    mixed = mix_sources(docs.select(row.alias("row"), F.col(source).alias("source"), F.col(text).alias("text")), "row", "source", "text")
    copies = mixed.groupBy("row").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    ranked = rows.join(copies, "row")
    share = F.floor(F.col("copies") / F.col("rows")).cast("int")
    single = ranked.where("copies % rows = 0").select("doc", share.alias("times"))
    uneven = ranked.where("copies % rows <> 0").groupBy("row").agg(F.first("doc").alias("doc"), F.first("copies").cast("int").alias("times"))
    times = single.union(uneven.select("doc", "times")).where("times > 0")
    return times.select("doc", F.explode(F.sequence(F.lit(1), "times"))).select("doc.*")


def _corrected(ruled: DataFrame, most: float) -> DataFrame:
    """One copy of one document more or less in each source, where that brings it nearer to its target."""
    taken = F.sum(F.col("size") * (F.col("n") * F.col("whole") + F.col("extra")))
    miss = ruled.groupBy("source").agg((F.first("target") - taken).alias("miss"))
    with_miss = (
        ruled.alias("r")
        .join(miss.alias("m"), _same(F.col("r.source"), F.col("m.source")))
        .select("r.*", "miss")
        .withColumn("left", F.abs(F.abs("miss") - F.col("size")))
    )
    more = (F.col("miss") > 0) & (F.col("extra") < F.col("n")) & (F.col("whole") + 1 <= most)
    fewer = (F.col("miss") < 0) & (F.col("extra") > -F.col("n") * F.signum("whole"))
    useful = (more | fewer) & (F.col("left") < F.abs("miss"))
    best = with_miss.where(useful).groupBy("source").agg(F.min(F.struct("left", "size")).alias("best"))
    move = F.when(F.col("size") == F.col("best.size"), F.signum("miss")).otherwise(0)
    return (
        with_miss.alias("r")
        .join(best.alias("b"), _same(F.col("r.source"), F.col("b.source")), "left")
        .select(
            "r.source", "size", "n", "source_size", "target", "rate", "whole",
            (F.col("extra") + F.coalesce(move, F.lit(0))).cast("long").alias("extra"),
        )
    )


def _numbers(rows: DataFrame, groups: list[str], ties: list[str]) -> DataFrame:
    """``number``: 0-based, inside each group, ordered by ``ties``; groups of any size."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c == "source" else F.col(c) for c in groups]
    named = rows.withColumn("absent", F.col("source").isNull())
    for at, c in enumerate(columns):
        named = named.withColumn(f"__g{at}", c)
    order = ["absent", *[f"__g{at}" for at in range(len(groups))], *ties]
    placed = global_index(named.withColumn("__row", F.monotonically_increasing_id()), [*order, "__row"], "place")
    first = placed.groupBy(*groups).agg(F.min("place").alias("first"))
    both = [_same(F.col(f"p.{c}"), F.col(f"f.{c}")) for c in groups]
    condition = both[0]
    for extra in both[1:]:
        condition = condition & extra
    return placed.alias("p").join(first.alias("f"), condition).select("p.*", (F.col("place") - F.col("first")).alias("number"))
