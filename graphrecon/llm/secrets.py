"""Secret scans: fixed patterns, and character Markov models for what no pattern names.

Two first-order Markov models give the probability of a run of characters, as a random string and as an
ordinary identifier. Their log-likelihood ratio, summed over the run's transitions, says which it is. Both are
trained from labelled samples by counting transitions; that is one aggregate, whose result has at most a
row for each pair of characters. Everything is column expressions: texts stay in the JVM and aren't
shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed patterns, in the order in which kinds are listed. Letters of the names are in either case.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Least characters of what each kind has to have.
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

#: Runs of these characters are what the models judge; shorter ones are never called secret.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
RUN_LEAST = 20
#: Ordinary identifiers are learned from runs as short as this.
LEARN = r"[A-Za-z0-9+/_=-]{12,}"
#: A run is secret if each transition is, on average, e times likelier in a random string.
LEAST_RATIO = 1.0
SMOOTHING, BACKOFF = 0.5, 8.0


def _pairs(run: Column) -> Column:
    """Transitions of a run of ASCII characters, as ``128 x first + second``."""
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c))
    return F.zip_with(codes, F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: a * 128 + b)


def generated_strings(spark: SparkSession, count: int = 4096) -> DataFrame:
    """Labelled samples of random strings in the alphabets that keys come in: hex, base 64 and capitals with digits.

    Made from digests of whole numbers, so the same every time; ``count`` of each alphabet.
    """
    digest = F.sha2(F.col("id").cast("string"), 256)
    capitals = F.upper(F.conv(F.substring(digest, 1, 15), 16, 36))
    return spark.range(count).select(
        F.explode(F.array(F.substring(digest, 1, 40), F.base64(F.unhex(digest)), capitals)).alias("run"),
        F.lit(True).alias("random"),
    )


def corpus_samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """Labelled samples from all texts: values that the fixed patterns find are labelled random, and
    runs without digits, but for up to three at the end, ordinary identifiers."""
    value = F.col("text")
    texts = docs.select(F.col(text).alias("text"))
    words = F.filter(F.regexp_extract_all(value, F.lit(LEARN), F.lit(0)), lambda r: r.rlike("^[^0-9]*[0-9]{0,3}$"))
    named = F.filter(
        _only(value, ASSIGN, F.regexp_extract_all(value, F.lit(ASSIGN), F.lit(1))),
        lambda r: F.length(r) >= ASSIGN_LEAST,
    )
    keys = _only(value, _least(ACCESS, ACCESS_LEAST - 4), F.regexp_extract_all(value, F.lit(_least(ACCESS, ACCESS_LEAST - 4)), F.lit(0)))
    labelled = lambda runs, is_random: F.transform(runs, lambda r: F.struct(r.alias("run"), F.lit(is_random).alias("random")))
    every = F.concat(labelled(words, False), labelled(named, True), labelled(keys, True))
    return texts.where(value.isNotNull()).select(F.inline(every))


def transition_ratios(samples: DataFrame, smoothing: float = BACKOFF) -> str:
    """Log-likelihood ratios of all transitions, random over ordinary, comma-joined by transition.

    A transition's count is smoothed by ``smoothing`` times how often its second character stands anywhere.

    ``samples``: ``run`` and ``random``. Repeated runs count as often as they stand, but a run is taken apart
    once. At most 128 x 128 rows come back, whatever the samples' number.
    """
    distinct = samples.groupBy("run", "random").agg(F.count(F.lit(1)).alias("times"))
    pairs = distinct.select("random", "times", F.explode(_pairs(F.col("run"))).alias("pair"))
    counts = pairs.groupBy("random", "pair").agg(F.sum("times").alias("n")).collect()
    seen: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for random, pair, n in counts:
        if pair is not None:
            seen[random][pair] = n
    letters = {c for own in seen.values() for p in own for c in divmod(p, 128)}
    logs = {}
    for random, own in seen.items():
        begun, ended = [0] * 128, [0] * 128
        for pair, n in own.items():
            begun[pair // 128] += n
            ended[pair % 128] += n
        total = sum(ended) + SMOOTHING * len(letters)
        alone = [(n + SMOOTHING) / total if total else 1.0 for n in ended]
        logs[random] = [
            math.log((own.get(p, 0) + smoothing * alone[p % 128]) / (begun[p // 128] + smoothing))
            for p in range(128 * 128)
        ]
    known = [p // 128 in letters and p % 128 in letters for p in range(128 * 128)]
    return ",".join(f"{a - b:.4f}" if k else "0" for k, a, b in zip(known, logs[True], logs[False]))


def mean_ratio(run: Column, ratios: str) -> Column:
    """Mean log-likelihood ratio of a run's transitions; characters beyond ASCII can't be in it."""
    table = F.split(F.lit(ratios), ",").cast("array<double>")
    total = F.aggregate(
        _pairs(run), F.lit(0.0), lambda s, p: s + F.coalesce(F.try_element_at(table, p.cast("int") + 1), F.lit(0.0))
    )
    return total / F.greatest(F.length(run) - 1, F.lit(1))


def _least(pattern: str, count: int) -> str:
    """The pattern with at least ``count`` characters in its last run: a maximal run either fits or never does."""
    return pattern[:-1] + "{%d,}" % count


def _only(text: Column, pattern: str, value: Column) -> Column:
    """``value`` where the pattern is found at all, or else an empty array: most texts stop at the test."""
    return F.when(text.rlike(pattern), value).otherwise(F.array().cast("array<string>"))


def pattern_spans(text: Column, kind: str, pattern: str, fits, value: int = 0) -> Column:
    """Spans (start, end, kind) of a pattern's matches from left to right, if ``fits`` of group ``value`` holds.

    Between two matches stand the parts of the text split by the pattern; so lengths of parts and
    matches, summed up, are the places, in code points.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("size"), group.alias("group"))
    none = "struct<at:int,spans:array<struct<start:int,end:int,kind:string>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("spans"))

    def step(state, x):
        low = state["at"] + x["gap"]
        high = low + x["size"]
        span = F.struct(low.alias("start"), high.alias("end"), F.lit(kind).alias("kind"))
        kept = F.when(fits(x["group"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(F.coalesce(high, low).alias("at"), kept.alias("spans"))

    found = F.aggregate(steps, start.cast(none), step)["spans"]
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return F.when(text.rlike(pattern), found).otherwise(empty)


def found_spans(docs: DataFrame, ratios: str, text: str = "text", least: float = LEAST_RATIO) -> DataFrame:
    """``docs`` with ``base_spans`` (of the fixed patterns) and ``all_spans`` (with the models' own), in order.

    A span is (start, end, kind); order is by start, then assign, access, hex, random. Fixed spans stay
    whatever the models say; a random span has a letter and a digit and touches no fixed one. A null or
    empty text has no spans. Repeated rows are scanned each; columns of the two names are replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rank = {"assign": 0, "access": 1, "hex": 2, "random": 3}

    def ordered(spans: Column) -> Column:
        place = F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]), s["kind"]).alias("rank"),
                s["end"].alias("end"),
                s["kind"].alias("kind"),
            ),
        )
        return F.transform(
            F.array_sort(place),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
        )

    assign = pattern_spans(value, "assign", ASSIGN, lambda g: F.length(g) >= ASSIGN_LEAST, 1)
    access = pattern_spans(value, "access", _least(ACCESS, ACCESS_LEAST - 4), lambda g: g.isNotNull())
    hexes = pattern_spans(value, "hex", _least(HEX, HEX_LEAST), lambda g: g.isNotNull())
    secret = lambda g: g.rlike("[0-9]") & g.rlike("[A-Za-z]") & (mean_ratio(g, ratios) >= least)
    runs = pattern_spans(value, "random", RUN, secret)
    base = docs.withColumn("base_spans", ordered(F.concat(assign, access, hexes)))
    free = F.filter(
        runs,
        lambda r: ~F.exists("base_spans", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])),
    )
    return base.withColumn("all_spans", ordered(F.concat(F.col("base_spans"), free)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, spans: str = "all_spans", text: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with each of the given spans replaced by ``mark``; overlapping ones become one."""
    t = F.col(text)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    # Spans are in order of their starts; one that begins inside another only moves the end.

    def step(s, x):
        gap = F.substring(t, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        parts = F.when(x["start"] >= s["at"], F.concat(s["parts"], F.array(gap, F.lit(mark)))).otherwise(s["parts"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), parts.alias("parts"))

    done = F.aggregate(spans, state, step)
    rest = F.substring(t, done["at"] + 1, F.length(t))
    return docs.withColumn(text, F.when(F.size(spans) == 0, t).otherwise(F.concat(F.array_join(done["parts"], ""), rest)))
