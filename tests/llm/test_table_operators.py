"""Operators across documents, against brute force."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from graphrecon.llm import decontaminate as dc
from graphrecon.llm import mixing, ngram_join
from graphrecon.llm.queries import QUERIES


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- decontamination -----------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_match(text, items, window):
    words, hit, met = plain_words(text), set(), set()
    for name, item in items:
        own = plain_words(item)
        size = min(window, len(own))
        wanted = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in wanted:
                hit |= set(range(i, i + size))
                if name is not None:
                    met.add(str(name))
    return len(words), hit, met


@pytest.mark.parametrize("window", [2, 4, 13])
@pytest.mark.parametrize("block_words", [dc.BLOCK_WORDS, 20])
def test_matches_equal_brute_force(spark, documents, window, block_words):
    draw = random.Random(window)
    some = lambda n: " ".join(draw.choices(["a", "b", "C", "d-e", "é", "f", "gg"], k=n))
    items = [(i, some(draw.choice([0, 1, 2, 3, 4, 6, 15, 20]))) for i in range(12)] + [(12, None), (None, "a b a b"), (0, "b b b")]
    texts = [some(draw.randint(0, 60)) for _ in range(60)] + [None, "", "...", items[5][1], "a\nb, a; b"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.benchmark_matches(documents(*texts), bench, window=window, block_words=block_words).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, met = brute_match(r["text"], items, window)
        assert r["n_words"] == n and set(r["items_met"]) == met
        assert {i for s in r["spans"] for i in range(s["a"], s["b"])} == hit
        assert all(x["b"] < y["a"] or x["b"] <= y["a"] for x, y in zip(r["spans"], r["spans"][1:]))


def test_decontamination_keeps_and_cuts(spark, odd_documents, documents):
    passage = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = documents(passage, "start, " + passage + "! end " * 600, "clean text", "w1 w2 w3")
    kept = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs, bench, longest=15).collect()}
    assert set(kept) == {1, 2, 3} and kept[1] == "start, " + "! end " * 600 and kept[3] == "w1 w2 w3"
    assert dc.decontaminate(docs, bench).where("doc_id = 1").first()["text"].startswith("start, w0")
    same = dc.decontaminate(odd_documents, bench)
    assert same.columns == odd_documents.columns and same.count() == 10
    assert sorted(map(str, same.collect())) == sorted(map(str, odd_documents.collect()))
    assert dc.decontaminate(odd_documents, bench.where("false")).count() == 10
    assert dc.decontaminate(odd_documents.where("false"), bench).count() == 0


# --- near duplicates -----------------------------------------------------------------------


def shingle_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_groups(docs):
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, own in enumerate(sets):
        shared = collections.Counter(j for g in own for j in holders[g])
        for j, both in shared.items():
            if 100 * both >= 80 * (len(own) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for g in own:
            holders[g].append(i)
    groups = collections.defaultdict(list)
    for i, (key, _) in enumerate(docs):
        groups[find(i)].append(key)
    return [(docs[i][0], len(sets[i]), min((k for k in groups[find(i)] if k is not None), default=None)) for i in range(len(docs))]


def test_near_duplicates_equal_brute_force(spark, sf):
    got = QUERIES["op6_ngram_jaccard"](spark, sf).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, got)) == sorted(brute_groups(docs))


@pytest.mark.parametrize("tile", [ngram_join.TILE, 7])
def test_families_passages_and_chains(documents, tile, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    draw = random.Random(2)
    word = lambda: "w%d" % draw.randint(0, 400)
    passage = " ".join(word() for _ in range(30))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(30):  # a family, some members beyond the similarity of others
        own = list(base)
        for _ in range(draw.randint(0, 5)):
            own[draw.randrange(len(own))] = word()
        texts.append(" ".join(own))
    texts += [" ".join(word() for _ in range(60)) + " " + passage for _ in range(30)]  # a passage in common
    chain = [word() for _ in range(100)]
    for _ in range(12):  # each like the one before only
        chain = [*chain[5:], *[word() for _ in range(5)]]
        texts.append(" ".join(chain))
    texts += ["A b c d", "a B c D", "a b c", "", None, " ", texts[0].upper(), texts[0]]
    docs = documents(*texts)
    got = sorted(map(tuple, ngram_join.near_duplicates(docs).collect()))
    assert got == sorted(brute_groups([(i, t) for i, t in enumerate(texts)]))


def test_tree_pairs_are_a_superset_of_links():
    import numpy as np

    draw = np.random.default_rng(5)
    sets = [draw.integers(0, 1 << 62, draw.integers(20, 60)).astype(np.uint64) for _ in range(80)]
    for i in range(40):
        own = sets[i].copy()
        own[: len(own) // 12] = draw.integers(0, 1 << 62, len(own) // 12)
        sets.append(own)
    sets = [np.unique(s) for s in sets]
    sizes = np.array([len(s) for s in sets])
    data = [ngram_join.point(s) for s in sets]
    names = np.arange(len(sets))
    found = ngram_join.block_pairs(names, names, np.zeros(len(sets), int), (0, 0), sizes, data, [None] * len(sets), [[]] * len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert (j, i) in found
    assert len(found) < len(sets) * (len(sets) - 1) / 2 / 4


def test_keep_one(spark, odd_documents, documents):
    kept = ngram_join.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    # Of the equal texts 0 and 5 the first stays, of the repeated row one; texts without words all stay.
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (0, 1, 2, 3, 4, 6, 7)] + [(True, 0)]
    assert ngram_join.keep_one(odd_documents.where("false")).count() == 0
    assert ngram_join.near_duplicates(odd_documents.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = ngram_join.components(links).collect()
    assert len(rows) == 301 and {r["part"] for r in rows} == {0}


# --- mixing ------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """The excess over the caps reshared by weight until there is none."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free = dict.fromkeys(order, 0.0), set(order)
    rest = share * sum(sizes.values())
    while free and rest > 1e-9:
        whole = sum(weight[s] for s in free)
        for s in free:
            target[s] += rest * weight[s] / whole
        rest = sum(max(0, target[s] - most * sizes[s]) for s in free)
        for s in list(free):
            if target[s] >= most * sizes[s]:
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def test_mix_meets_targets(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sizes, by = collections.Counter(), {}
    for r in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += n
        by[r["doc_id"]] = (r["source"], n)
    want, taken = brute_targets(sizes), collections.Counter()
    rows = QUERIES["op3_mix_sources"](spark, sf).collect()
    assert len(rows) == len(docs)
    rates = collections.defaultdict(list)
    for r in rows:
        source, n = by[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source]) and 0 <= r["taken"] <= 2 * n
        taken[source] += r["taken"]
        rates[source].append((n, r["rate"]))
    for source, target in want.items():
        assert abs(taken[source] - target) < 0.005 * target
        # Rates are exponential in the size below the cap, and meet the target as they are.
        own = [(n, rate) for n, rate in rates[source] if n and rate < 1.999]
        if own:
            slopes = [math.log(rate) / n for n, rate in own]
            assert max(slopes) - min(slopes) < 1e-6
        assert sum(n * rate for n, rate in rates[source]) == pytest.approx(target, rel=1e-4)
    again = QUERIES["op3_mix_sources"](spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_odd_rows(spark, odd_documents):
    rows = mixing.mix_sources(odd_documents).collect()
    assert len(rows) == 10
    want = brute_targets({"a": 22, "b": 14, "c": 25, None: 30_000})
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 2
    assert mixing.mix_sources(odd_documents.where("false")).count() == 0
    blank = mixing.mix_sources(odd_documents.where("doc_id in (1, 2, 3)")).collect()
    assert [r["copies"] * r["size"] for r in blank] == [0, 0, 0]


# --- pipeline --------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, seen[-1], sf)
        assert out.columns == columns, name
        seen.append(out.checkpoint())
    rows = [s.collect() for s in seen]
    texts = {r["doc_id"]: r["text"] for r in rows[0]}
    assert all(r["text"] == texts[r["doc_id"]] for some in rows for r in some)
    # Near duplicates: one of each group of what the classifier kept.
    groups = brute_groups([(r["doc_id"], r["text"]) for r in rows[1]])
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(k for k, n, part in groups if n == 0 or k == part)
    # Contaminated documents go, all others stay.
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = []
    for r in rows[2]:
        n, hit, _ = brute_match(r["text"], items, 13)
        if not (hit and 20 * len(hit) >= n):
            clean.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in rows[3]) == sorted(clean)
    # The mix has each document as often as its rate was rounded to.
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(seen[3]).collect()}
    times = collections.Counter(r["doc_id"] for r in rows[4])
    assert max(times.values()) <= 2 and set(times) <= set(copies)
    size = lambda some: sum(len((r["text"] or "").split()) for r in some)
    assert size(rows[4]) == pytest.approx(1.5 * size(rows[3]), rel=0.01)
    last = p.STAGES[-1][1](spark, seen[4], sf).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(times.elements())
    assert sum(r["n_tokens"] for r in last) == max(r["start"] + r["n_tokens"] for r in last)


def test_pipeline_sends_texts_once_and_in_light_batches(spark, documents):
    import corpus_pipeline as p
    from graphrecon.llm.batches import light_batches

    docs = documents(*[f"{i} " + "word " * 4000 for i in range(200)])  # 20 kB each
    rows = p.packed(docs)
    assert rows.schema["doc"].dataType.names == [c for c in docs.columns if c != "text"]
    assert sorted(p.unpacked(rows, docs).collect()) == sorted(docs.collect())

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    with light_batches(spark, 200_000):
        found = [r["size"] for r in rows.coalesce(1).mapInArrow(sizes, "size long").collect()]
    assert max(found) < 300_000 and sum(found) < 200 * 25_000


def test_columns_of_any_name_pass_through(spark, odd_documents):
    import corpus_pipeline as p

    names = ["__row", "a.b", "row", "doc", "key", "node", "copies", "times", "stays", "part", "grade", "p_best", "n_words", "spans", "__text", "size"]
    odd = odd_documents.drop("spans").select("*", *[F.concat(F.lit(n), F.col("lang")).alias(n) for n in names])
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, odd, "/root/testdata/sf0.001")
        assert out.columns == odd.columns, name
        for r in out.collect():
            assert all(r[n] == (None if r["lang"] is None else n + r["lang"]) for n in names), name


def test_pipeline_odd_rows(spark, odd_documents):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    for name, stage in p.STAGES:
        for some in (odd_documents, odd_documents.where("false")):
            out = stage(spark, some, sf)
            rows = out.collect()
            assert name == p.STAGES[-1][0] or out.columns == some.columns
            assert len(rows) <= 2 * some.count()


