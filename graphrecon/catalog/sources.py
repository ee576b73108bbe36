"""Readers and text functions over text that Spark writes from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphrecon.catalog import tables as T
from graphrecon.catalog.graphs import node_split
from graphrecon.catalog.registry import query
from graphrecon.functions import parsing as X
from graphrecon.operators import graph as G
from graphrecon.sources import pairs as R
from graphrecon.sources import runlogs as L
from graphrecon.sources import sequences as Q

_LINES = f"WITH {T.pair_lines_sql()} "
_NUMBER = "try_cast(trim(f[3]) AS DOUBLE)"


@query(
    "s1a_pair_scan_lenient",
    _LINES + f"""SELECT a, b, label, count(*) AS lines FROM (SELECT f[1] AS a, f[2] AS b,
  CASE WHEN len(f) < 3 OR f[3] = '' THEN 1 ELSE trunc({_NUMBER})::INT END AS label
  FROM fields WHERE len(f) >= 2 AND f[1] <> '' AND f[2] <> '') WHERE label IS NOT NULL GROUP BY ALL""",
)
def s1a(spark, sf):
    rows = R.parse_pairs(T.pair_lines(spark, sf), "lenient")
    return rows.groupBy("a", "b", "label").agg(F.count(F.lit(1)).alias("lines"))


_STRICT = f"""strict AS (SELECT f[1] AS a, f[2] AS b, trunc({_NUMBER})::INT AS label FROM fields
  WHERE len(f) >= 3 AND f[1] <> '' AND f[2] <> '' AND f[3] <> '' AND {_NUMBER} IS NOT NULL)"""


@query(
    "s1b_pair_scan_supervision",
    f"WITH {T.pair_lines_sql()}, {_STRICT} SELECT DISTINCT least(a,b) AS u, greatest(a,b) AS v "
    "FROM strict WHERE label > 0",
)
def s1b(spark, sf):
    rows = R.parse_pairs(T.pair_lines(spark, sf), "supervision")
    return G.edges_from_pairs(rows.filter("label > 0"))


@query(
    "s1c_pair_scan_negatives",
    f"WITH {T.pair_lines_sql()}, {_STRICT} SELECT a, b, label, count(*) AS lines FROM strict "
    "WHERE label <= 0 GROUP BY ALL",
)
def s1c(spark, sf):
    rows = R.parse_pairs(T.pair_lines(spark, sf), "negatives")
    return rows.groupBy("a", "b", "label").agg(F.count(F.lit(1)).alias("lines"))


_RATIO = f"""ratio AS (SELECT least(g[1],g[2]) AS u, greatest(g[1],g[2]) AS v,
  trunc(try_cast(trim(g[3]) AS DOUBLE))::INT AS label FROM fields WHERE len(g) >= 3)"""


@query(
    "s1d_pair_scan_ratio",
    f"WITH {T.pair_lines_sql(False)}, {_RATIO} SELECT u, v, 1 AS label, count(*) AS lines FROM ratio "
    "WHERE label > 0 GROUP BY u, v UNION ALL SELECT u, v, 0, 1 FROM ratio WHERE label = 0 GROUP BY u, v",
)
def s1d(spark, sf):
    rows = R.parse_pairs(T.pair_lines(spark, sf, bad_labels=False), "ratio")
    positives = R.ratio_positives(rows).withColumn("label", F.lit(1))
    negatives = R.ratio_negatives_known(rows).withColumn("label", F.lit(0))
    return positives.unionByName(negatives).groupBy("u", "v", "label").agg(
        F.count(F.lit(1)).alias("lines")
    )


@query(
    "s1e_known_positives",
    f"WITH {T.pair_lines_sql()}, w AS (SELECT regexp_split_to_array(trim(value), '\\s+') AS w FROM lines) "
    "SELECT DISTINCT least(w[1],w[2]) AS u, greatest(w[1],w[2]) AS v FROM w WHERE len(w) >= 2",
)
def s1e(spark, sf):
    return R.parse_known_positives(T.pair_lines(spark, sf))


@query(
    "s5_required_ids",
    _LINES + "SELECT DISTINCT unnest([f[1], f[2]]) AS id FROM fields WHERE len(f) >= 2 AND f[1] <> '' AND f[2] <> ''",
)
def s5(spark, sf):
    return R.required_ids(T.pair_lines(spark, sf))


@query(
    "s6_observed_nodes",
    _LINES + "SELECT DISTINCT id FROM (SELECT unnest([g[1], g[2]]) AS id FROM fields WHERE len(g) >= 2) WHERE id <> ''",
)
def s6(spark, sf):
    return R.observed_nodes(T.pair_lines(spark, sf))


@query(
    "p2_label_coercion",
    """SELECT coalesce(label::VARCHAR, 'none') AS label, count(*) AS lines FROM (SELECT trunc(try_cast(CASE WHEN l_tax = 0 THEN 'none'
  WHEN l_returnflag = 'R' THEN ' -'||l_quantity ELSE (l_discount*100-l_quantity)::VARCHAR END AS DOUBLE))::INT AS label
  FROM lineitem) GROUP BY label""",
)
def p2(spark, sf):
    text = (
        F.when(F.col("l_tax") == 0, "none")
        .when(F.col("l_returnflag") == "R", F.concat(F.lit(" -"), F.col("l_quantity").cast("string")))
        .otherwise((F.col("l_discount") * 100 - F.col("l_quantity")).cast("string"))
    )
    label = F.coalesce(X.label_value(text).cast("string"), F.lit("none"))
    lines = T.table(spark, sf, "lineitem")
    return lines.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("lines"))


# ---- sequences: documents as records, tables and one named file ------------------------------

# DuckDB keeps one capital sharp s where Unicode upper case has two letters.
_CLEAN = r"regexp_replace(replace(upper({0}), 'ẞ', 'SS'), '[-.*\s]', '', 'g')"


@query(
    "p3_clean_sequence",
    "SELECT doc_id, md5(" + _CLEAN.format("text") + ") AS digest, length(" + _CLEAN.format("text")
    + ")::INT AS letters FROM documents",
)
def p3(spark, sf):
    seq = X.clean_sequence(F.col("text"))
    return T.table(spark, sf, "documents").select(
        "doc_id", F.md5(seq).alias("digest"), F.length(seq).alias("letters")
    )


@query(
    "p5_truncate_sequence",
    "SELECT doc_id, length(nullif(left(" + _CLEAN.format("text") + ", 1000), ''))::INT AS letters FROM documents",
)
def p5(spark, sf):
    """The reference's own length limit, here 1000 letters."""
    kept = X.truncated_sequence(X.clean_sequence(F.col("text")), 1000)
    return T.table(spark, sf, "documents").select("doc_id", F.length(kept).alias("letters"))


@query("p6_content_key", "SELECT doc_id, sha256('D'||doc_id) AS key FROM documents")
def p6(spark, sf):
    name = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    return T.table(spark, sf, "documents").select("doc_id", X.content_key(name).alias("key"))


def _headers(spark, sf):
    """Headers of two kinds: between pipes for English, first word for the others."""
    tag = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    piped = F.concat(F.lit("sp|"), tag, F.lit(" |"), F.col("source"), F.lit(" x"))
    plain = F.concat(F.lit("  "), tag, F.lit(" "), F.col("source"))
    return T.table(spark, sf, "documents").withColumn(
        "header", F.when(F.col("lang") == "en", piped).otherwise(plain)
    )


@query("p4_header_id", "SELECT doc_id, 'D'||doc_id AS id FROM documents")
def p4(spark, sf):
    return _headers(spark, sf).select("doc_id", X.header_id(F.col("header")).alias("id"))


@query(
    "s2_fasta_records",
    "SELECT 'D'||doc_id AS id, md5(" + _CLEAN.format("text") + ") AS digest FROM documents",
)
def s2(spark, sf):
    """Documents written as records to text files, and read back whatever way they are split."""
    folder = T.scratch(spark)
    body = F.regexp_replace("text", r"\n>", "\n")  # a quoted line must not look like a header
    record = F.concat(F.lit(">"), F.col("header"), F.lit("\n"), body)
    _headers(spark, sf).select(record.alias("value")).write.text(folder)
    found = Q.read_fasta(spark, folder)
    return found.select("id", F.md5("seq").alias("digest"))


@query(
    "s3_sequence_table",
    "SELECT 'D'||doc_id AS id, md5(" + _CLEAN.format("text") + ") AS digest FROM documents",
)
def s3(spark, sf):
    """A table whose columns are spelt ``Accession`` and ``SEQ``."""
    table = T.table(spark, sf, "documents").select(
        F.concat(F.lit(" D"), F.col("doc_id").cast("string")).alias("Accession"),
        F.col("text").alias("SEQ"),
        "lang",
    )
    return Q.table_sequences(table).select("id", F.md5("seq").alias("digest"))


_DISCOVER_SQL = f"""
cand AS (SELECT lang AS id, {_CLEAN.format("text")} AS seq, 1 AS priority, source AS path, doc_id AS place FROM documents
  UNION ALL SELECT role, {_CLEAN.format("text")}, 2, 'talk', conv_id*1000+turn FROM conversations
  UNION ALL SELECT 'user', {_CLEAN.format("text")}, 0, 'bench', item_id FROM benchmark),
firsts AS (SELECT id, seq, path FROM (SELECT *, row_number() OVER (PARTITION BY id
  ORDER BY priority, len(string_split(path,'/')), path, place) AS r FROM cand WHERE seq <> '') WHERE r = 1)
"""


def _candidates(spark, sf):
    """Sequences by language from documents, by role from conversations, one file named first."""
    docs = T.table(spark, sf, "documents").select(
        F.col("lang").alias("id"), "text", F.lit(Q.TABLE).alias("priority"), F.col("source").alias("path"),
        F.col("doc_id").alias("at"),
    )
    talk = T.table(spark, sf, "conversations").select(
        F.col("role").alias("id"), "text", F.lit(Q.RECORDS).alias("priority"), F.lit("talk").alias("path"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("at"),
    )
    named = T.table(spark, sf, "benchmark").select(
        F.lit("user").alias("id"), "text", F.lit(Q.EXPLICIT).alias("priority"), F.lit("bench").alias("path"),
        F.col("item_id").alias("at"),
    )
    whole = Q.union_candidates([docs, talk, named])
    return whole.select("id", X.clean_sequence(F.col("text")).alias("seq"), "priority", "path", "at")


def _wanted(spark, sf):
    docs = T.table(spark, sf, "documents").select(F.col("lang").alias("id"))
    talk = T.table(spark, sf, "conversations").select(F.col("role").alias("id"))
    sources = T.table(spark, sf, "documents").select(F.col("source").alias("id"))
    return docs.unionByName(talk).unionByName(sources).distinct()


@query(
    "s4_sequence_discovery",
    f"WITH {_DISCOVER_SQL} SELECT id, md5(seq) AS digest, path FROM firsts",
)
def s4(spark, sf):
    found = Q.discover(_wanted(spark, sf), _candidates(spark, sf))
    return found.select("id", F.md5("seq").alias("digest"), "path")


@query(
    "s4_missing_sequences",
    f"WITH {_DISCOVER_SQL} SELECT DISTINCT source AS id FROM documents WHERE source NOT IN (SELECT id FROM firsts)",
)
def s4_missing(spark, sf):
    wanted = _wanted(spark, sf)
    return Q.missing_sequences(wanted, Q.discover(wanted, _candidates(spark, sf)))


@query(
    "w6_first_wins",
    f"WITH {_DISCOVER_SQL} SELECT id, path, length(seq)::INT AS letters FROM firsts",
)
def w6(spark, sf):
    candidates = _candidates(spark, sf)
    found = Q.discover(candidates.select("id"), candidates)
    return found.select("id", "path", F.length("seq").alias("letters"))


@query(
    "s7_node_split",
    f"WITH {T.TRADE_SQL} SELECT id FROM nodes WHERE {T.hash_sql(11, 'split', 'id')} < {int(0.7 * 2**60)}",
)
def s7(spark, sf):
    return R.split_nodes(node_split(spark, sf), "train")


@query("s9_sample_set", f"WITH {T.SAMPLES_SQL} SELECT node_size, sample_id, pos, id FROM samples")
def s9(spark, sf):
    """Sample sets written as a table and loaded again."""
    folder = T.scratch(spark)
    T.vector_samples(spark, sf).write.partitionBy("node_size").parquet(folder)
    return spark.read.parquet(folder).select("node_size", "sample_id", "pos", "id")


# ---- run logs --------------------------------------------------------------------------------


@query(
    "s11_step_tables",
    f"""WITH {T.SERIES_SQL} SELECT run, epoch, CASE run WHEN 'click' THEN NULL ELSE value END AS "Val loss",
  CASE run WHEN 'click' THEN n::DOUBLE WHEN 'view' THEN n::DOUBLE END AS "Count" FROM series""",
)
def s11(spark, sf):
    """Step files of each run in a folder of its own, with different columns, read back together.

    Clicks lack the loss, only clicks and views have a count.
    """
    series = T.daily_series(spark, sf)
    value, count = F.col("value").alias("Val loss"), F.col("n").cast("double").alias("Count")
    names = [r["event_type"] for r in T.table(spark, sf, "events").select("event_type").distinct().orderBy("event_type").collect()]
    folder, paths = T.scratch(spark), []
    for name in names:
        columns = {"click": [count], "view": [value, count]}.get(name, [value])
        paths.append(f"{folder}/m/train/{name}")
        series.filter(F.col("run") == name).select("epoch", *columns).write.csv(paths[-1], header=True)
    rows = L.read_steps(spark, paths)
    numbers = [F.col(c).cast("double").alias(c) for c in ("Val loss", "Count")]
    return rows.select(F.col("run_id").alias("run"), F.col("epoch").cast("int"), *numbers)


def stage_lines(spark, sf):
    """Every event as a log line: event name, then user and value as fields."""
    fields = F.create_map(
        F.lit("user_id"), F.col("user_id").cast("string"), F.lit("lr"), X.printed_float(F.col("value"))
    )
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = F.concat(stamp, F.lit(" INFO "), X.log_event(F.col("event_type"), fields))
    return T.table(spark, sf, "events").select("event_id", line.alias("value"))


_EVENT_LABEL = "upper(left(event_type,1))||substr(event_type,2)"


@query(
    "p18_log_lines",
    f"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S')||' INFO '||{_EVENT_LABEL}||' | LR: '
  ||printf('%.4f', value)||' | User Id: '||user_id AS value FROM events""",
)
def p18(spark, sf):
    return stage_lines(spark, sf)


@query(
    "s12_stage_log",
    f"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 'INFO' AS level, {_EVENT_LABEL} AS event,
  user_id::VARCHAR AS user_id, printf('%.4f', value) AS lr FROM events""",
)
def s12(spark, sf):
    rows = L.parse_stage_log(stage_lines(spark, sf))
    return rows.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        "level",
        "event",
        F.col("fields")["User Id"].alias("user_id"),
        F.col("fields")["LR"].alias("lr"),
    )


@query(
    "s13_latest_per_strategy",
    """WITH s AS (SELECT CASE event_type WHEN 'click' THEN 'BFS' WHEN 'view' THEN 'DFS' WHEN 'error' THEN 'RANDOM_WALK' END
  AS strategy, event_id, ts, props FROM events)
SELECT strategy, arg_max(props, event_id) AS payload FROM s WHERE strategy IS NOT NULL GROUP BY strategy""",
)
def s13(spark, sf):
    kind = F.col("event_type")
    strategy = (
        F.when(kind == "click", "bfs")
        .when(kind == "view", "DFS")
        .when(kind == "error", "Random_Walk")
        .otherwise(kind)
    )
    files = T.table(spark, sf, "events").select(
        strategy.alias("strategy"), F.col("event_id").alias("modified"), F.col("props").alias("payload")
    )
    return L.latest_per_strategy(files).select("strategy", "payload")


@query(
    "l7_stage_timing",
    """SELECT user_id AS run, (epoch(max(CASE WHEN event_type='purchase' THEN date_trunc('second', ts) END)) -
  epoch(min(CASE WHEN event_type='signup' THEN date_trunc('second', ts) END)))::BIGINT AS seconds FROM events GROUP BY user_id""",
)
def l7(spark, sf):
    from graphrecon.operators.curves import stage_timing

    lines = stage_lines(spark, sf)
    parsed = L.parse_stage_log(lines).withColumn(
        "run", F.col("fields")["User Id"].cast("bigint")
    )
    return stage_timing(parsed, "Signup", "Purchase")
