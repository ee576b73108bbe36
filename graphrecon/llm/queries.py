"""The numbered queries over the given tables, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrecon.llm.conversations import repair
from graphrecon.llm.decontaminate import benchmark_matches, contaminated, hit_words, item_digest
from graphrecon.llm.html_text import extract_text
from graphrecon.llm.language import predict_language, train_language_net
from graphrecon.llm.merkle import document_manifest, fold, proof_digest
from graphrecon.llm.mixing import mix_sources
from graphrecon.llm.ngram_join import near_duplicates
from graphrecon.llm.ordinal import accepted, grade_texts, label_grades, train
from graphrecon.llm.quality_rules import judge
from graphrecon.llm.secrets import (
    corpus_samples,
    count_of,
    found_spans,
    generated_strings,
    joined,
    transition_ratios,
)
from graphrecon.llm.suffix_dedup import remove_repeats
from graphrecon.llm.token_counts import count_tokens
from graphrecon.llm.wavelet import read_shards, shard_folder, write_shards

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shard_folder(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_shards(folder, spark)


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_matches(docs, table(spark, sf_dir, "benchmark"))
    n_hit = hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items_met").cast("long").alias("n_items"),
        item_digest(F.col("items_met")).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


_WORDS = r"""[x for x in regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> '']"""

ORACLES["op2_decontaminate"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(13, len(w)) AS k FROM b WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
),
grams AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)
),
met AS (SELECT r, i, grams.k, item_id FROM grams JOIN wins ON grams.k = wins.k AND grams.g = wins.g),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM met) GROUP BY r),
its AS (
  SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM met WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    net = train_language_net(docs.where(~held_out))
    return predict_language(docs.withColumn("held_out", held_out), net, keep=("doc_id", "held_out"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return judged.select(*names, F.array_join("failed_rules", ",").alias("failed_rules"))


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, label_grades(table(spark, sf_dir, "labels")))
    graded = grade_texts(docs, model)
    return graded.withColumn("kept", accepted(F.col("p_best")))


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate"
    )


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = transition_ratios(corpus_samples(docs).union(generated_strings(spark)))
    found = found_spans(docs, ratios)
    return found.select(
        "doc_id",
        *[count_of(F.col("base_spans"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.col("all_spans")).alias("spans"),
    )


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = document_manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    folded = rows.withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("siblings")))
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("siblings")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII text, bit by bit."""
    bit = "lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"lambda crc, b: list_reduce([0,0,0,0,0,0,0,0]::BIGINT[], {bit}, xor(crc, b))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce({codes}, {byte}, 4294967295), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf_sql(n_chars: str) -> str:
    values = ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")
    return f"sha256({' || '.join(map(_field, values))})"


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs for all levels (``k``) of the trees ``g`` over ``leaves`` (g, p, h); ``n``: nodes of the level."""
    return f"""{name}_up AS (
  SELECT g, 0 AS k, p, h FROM ({leaves})
  UNION ALL
  SELECT g, k + 1, p // 2, sha256(string_agg(h, '' ORDER BY p))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}_up) WHERE n > 1 GROUP BY g, k, p // 2
),
{name} AS (SELECT *, count(*) OVER (PARTITION BY g, k) AS n FROM {name}_up)"""


def _walk_sql(name: str, tree: str, start: str) -> str:
    """CTE that takes rows (r, g, q, acc, proof) of ``start`` to the roots of their trees."""
    return f"""{name} AS (
  SELECT r, g, 0 AS k, q, acc, proof FROM ({start})
  UNION ALL
  SELECT w.r, w.g, w.k + 1, w.q // 2, sha256(CASE WHEN w.q % 2 = 1 THEN coalesce(s.h, '') || acc ELSE acc || coalesce(s.h, '') END),
    proof || coalesce(s.h, '')
  FROM {name} w JOIN {tree} t ON t.g = w.g AND t.k = w.k AND t.p = w.q AND t.n > 1
  LEFT JOIN {tree} s ON s.g = w.g AND s.k = w.k AND s.p = xor(w.q, 1)
)"""


ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT *, coalesce('=' || lang, '') AS g, {_leaf_sql("n_chars")} AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("(n_chars + (n_chars IS NOT NULL)::INT)")} END AS altered
  FROM documents
),
f AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, row_number() OVER () AS r FROM leaves
),
{_tree_sql("low", "SELECT g, p, leaf AS h FROM f")},
subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS p FROM low WHERE n = 1),
{_tree_sql("high", "SELECT '' AS g, p, h FROM subroots")},
{_walk_sql("first", "low", "SELECT r, g, p AS q, coalesce(altered, leaf) AS acc, '' AS proof FROM f")},
met AS (SELECT r, acc, proof, subroots.p AS q, subroots.h AS subroot FROM first JOIN low USING (g, k) JOIN subroots USING (g) WHERE low.n = 1),
{_walk_sql("second", "high", "SELECT r, '' AS g, q, acc, proof FROM met")},
ends AS (SELECT second.r, acc, proof, high.h AS root FROM second JOIN high ON high.k = second.k AND high.n = 1)
SELECT doc_id, leaf, subroot, root, sha256(ends.proof) AS proof_sha256, ends.acc AS folded_root, ends.acc = root AS verified
FROM f JOIN met USING (r) JOIN ends USING (r)"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


# Forward over the rows of each conversation with the least (cost, audit, repaired text) of each of the four states; a state that
# can't be reached has no value. Of equal costs no audit is the start of another, so the least of one state stays the least.
def _edit(way: str, cost: str, letter: str, role: str | None, text: str = "''") -> str:
    said = f"{way}.r" if role is None else f"{way}.r || chr(10) || {role} || ':' || {text}"
    return f"CASE WHEN {way} IS NOT NULL THEN {{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}', 'r': {said}}} END"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _insert_sql(source: str) -> str:
    """Rows of ``source`` with at most two turns inserted."""
    once = f"SELECT * REPLACE ({_least('u', *[_edit(w, '5', 'I', chr(39) + 'user' + chr(39)) for w in 'nsa'])} AS u) FROM ({source})"
    return f"SELECT * REPLACE ({_least('a', _edit('u', '5', 'I', chr(39) + 'assistant' + chr(39)))} AS a) FROM ({once})"


def _row_sql(to: str) -> str:
    ways = [_edit(to, "2", "D", None)]
    before = {"n": (), "s": ("n",), "u": ("n", "s", "a"), "a": ("u",)}[to]
    for w in before:
        ways.append(f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND left(role, 1) = '{to}' THEN {_edit(w, 'extra', 'K', 'role', 'text')} END")
        if to in "ua":
            name = "'user'" if to == "u" else "'assistant'"
            ways.append(f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {_edit(w, '1 + extra', 'R', name, 'text')} END")
    return _least(*ways)


_STRIP = "rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_STATE = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"

ORACLES["op13_conversation_repair"] = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, coalesce('=' || conv_id, '') AS conv, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate
  FROM conversations
),
rows AS (
  SELECT conv, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM named WHERE fate <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text)) AS i FROM rows
),
judged AS (
  SELECT *, CASE WHEN {_STRIP} = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right({_STRIP}, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) || left(role, 1) AS pair
  FROM placed
),
sums AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv
),
walk AS (
  SELECT conv, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': '', 'r': ''}} AS {_STATE}) AS n, CAST(NULL AS {_STATE}) AS s,
    CAST(NULL AS {_STATE}) AS u, CAST(NULL AS {_STATE}) AS a
  FROM sums
  UNION ALL
  SELECT conv, i + 1, {", ".join(map(_row_sql, "nsua"))}
  FROM (
    SELECT w.*, j.role, j.text, j.fault, CASE WHEN j.fault = 'truncated' THEN 5 ELSE 0 END AS extra
    FROM ({_insert_sql("SELECT * FROM walk")}) w JOIN judged j ON j.conv = w.conv AND j.i = w.i + 1
  )
),
ends AS (
  SELECT conv, {_least("n", "a")} AS best
  FROM ({_insert_sql("SELECT walk.* FROM walk JOIN sums ON sums.conv = walk.conv AND sums.n = walk.i")})
)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(best.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM named) ids LEFT JOIN sums USING (conv) LEFT JOIN ends USING (conv)"""
