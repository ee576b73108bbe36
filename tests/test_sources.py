import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphrecon.functions import parsing as X
from graphrecon.operators import graph as G
from graphrecon.sources import pairs as R
from graphrecon.sources import runlogs as L
from graphrecon.sources import sequences as Q
from graphrecon.sources import sinks as K

LINES = [
    "P1\tP2\t1",
    "  P2 \t P3 \t 1.0 ",
    "P1\tP3\t0",
    "P3\tP9\t1",
    "P2\tP4\t-1",
    "P4\tP1",
    "P4\tP2\t",
    "P5\t\t1",
    "only",
    "",
    "P6\tP7\tnan",
    "P6\tP7\tx",
    "P7\tP6\t2.9",
]


@pytest.fixture
def lines(spark):
    return spark.createDataFrame([(x,) for x in LINES], "value string")


def triples(df):
    return sorted(tuple(r) for r in df.collect())


def test_lenient_reading(lines):
    assert triples(R.parse_pairs(lines, "lenient")) == [
        ("P1", "P2", 1),
        ("P1", "P3", 0),
        ("P2", "P3", 1),
        ("P2", "P4", -1),
        ("P3", "P9", 1),
        ("P4", "P1", 1),
        ("P4", "P2", 1),
        ("P7", "P6", 2),
    ]


def test_supervision_and_negative_readings(lines):
    assert ("P4", "P1", 1) not in triples(R.parse_pairs(lines, "supervision"))
    # a label of -1 counts as negative here, but is no negative for the ratio builder
    assert triples(R.parse_pairs(lines, "negatives")) == [("P1", "P3", 0), ("P2", "P4", -1)]


def test_ratio_reading_keeps_repeats_and_raises_on_bad_labels(spark, lines):
    good = spark.createDataFrame(
        [("B\tA\t1",), ("A\tB\t1",), ("A\tC\t0",), ("C\tA\t0.4",), ("A\tD\t-1",)], "value string"
    )
    rows = R.parse_pairs(good, "ratio")
    assert triples(R.ratio_positives(rows)) == [("A", "B"), ("A", "B")]
    assert triples(R.ratio_negatives_known(rows)) == [("A", "C")]
    with pytest.raises(PySparkException):
        R.parse_pairs(lines, "ratio").collect()


def test_ids_of_pair_files(lines):
    required = {r["id"] for r in R.required_ids(lines).collect()}
    assert "P5" not in required and "P9" in required
    assert "P5" in {r["id"] for r in R.observed_nodes(lines).collect()}


def test_known_positives_split_on_any_blank(spark):
    lines = spark.createDataFrame([("B A  9",), ("A\tB",), ("C",)], "value string")
    assert triples(R.parse_known_positives(lines)) == [("A", "B")]


def test_empty_pair_file_is_an_error(spark, tmp_path):
    (tmp_path / "pairs.txt").write_text("a\n\n")
    with pytest.raises(ValueError):
        R.read_pairs(spark, str(tmp_path / "pairs.txt"))


def test_supervision_graph_and_negatives(spark, ids):
    rows = spark.createDataFrame(
        [("P1", "P2", 1), ("P2", "P3", 1), ("P3", "P5", 1), ("P6", "P1", 1), ("P1", "P3", 0), ("P4", "P2", 0), ("P4", "P8", 0)],
        "a string, b string, label int",
    )
    split = ids(["P1", "P2", "P3", "P4"])
    nodes, edges = G.supervision_graph(rows, split)
    assert nodes.count() == 4
    assert triples(edges) == [("P1", "P2"), ("P2", "P3")]
    negatives = G.explicit_negatives(rows, split)
    assert triples(negatives) == [("P1", "P3"), ("P2", "P4")]
    assert triples(G.partners(negatives)) == [("P1", "P3"), ("P2", "P4"), ("P3", "P1"), ("P4", "P2")]


def test_label_text(spark):
    rows = spark.createDataFrame([("2.9",), ("-0.5",), ("nan",), ("inf",), ("",), (" 1 ",)], "t string")
    got = [r[0] for r in rows.select(X.label_value(F.col("t"))).collect()]
    assert got == [2, 0, None, None, None, 1]


def test_fasta_split_over_many_tasks(spark, tmp_path):
    body = "".join(f">sp|P{i}|x name\nacd-e\n\nF.g*{i % 7}\n" for i in range(3000))
    (tmp_path / "a.fasta").write_text(body + ">Q1 second\r\nMK\n>Q1\nLL\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = Q.read_fasta(spark, str(tmp_path / "a.fasta"))
        assert rows.rdd.getNumPartitions() > 3
        got = rows.select("id", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3002
    assert {(r["id"], r["seq"]) for r in got} >= {("P0", "ACDEFG0"), ("P2999", "ACDEFG3"), ("Q1", "MK"), ("Q1", "LL")}


def test_sequence_priority_and_missing(spark, ids, tmp_path):
    (tmp_path / "s.csv").write_text("Uniprot_ID,sequence\nP1,aa\nP2,\n")
    (tmp_path / "s.fasta").write_text(">P1\nCC\n>P2 x\nDD\n>P2\nEE\n")
    table = Q.read_sequence_csv(spark, str(tmp_path / "s.csv")).select(
        "id", "seq", F.lit(Q.TABLE).alias("priority"), F.lit("s.csv").alias("path"), F.lit(0).alias("at")
    )
    fasta = Q.read_fasta(spark, str(tmp_path / "s.fasta")).select(
        "id", "seq", F.lit(Q.RECORDS).alias("priority"), "path", F.col("at.row").alias("at")
    )
    found = Q.discover(ids(["P1", "P2", "P3"]), table.unionByName(fasta))
    assert {(r["id"], r["seq"]) for r in found.collect()} == {("P1", "AA"), ("P2", "DD")}
    with pytest.raises(ValueError, match="P3"):
        Q.require_sequences(ids(["P1", "P3"]), found)
    with pytest.raises(ValueError):
        Q.read_sequence_csv(spark, str(tmp_path / "s.csv"), id_column="nope")


def test_stage_log_round_trip(spark):
    lines = spark.createDataFrame(
        [
            ("2026-04-11 13:37:29 INFO Data Ready | Test: 54126 | Val AUPRC: 0.5000",),
            ("2026-04-11 13:38:00 WARNING Done",),
            ("Traceback (most recent call last):",),
        ],
        "value string",
    )
    rows = L.parse_stage_log(lines).orderBy("ts").collect()
    assert [(r["event"], r["fields"]) for r in rows] == [
        ("Data Ready", {"Test": "54126", "Val AUPRC": "0.5000"}),
        ("Done", {}),
    ]
    event = X.log_event(F.lit("data_ready"), F.create_map(F.lit("val_auprc"), X.printed_float(F.lit(0.5)), F.lit("test"), F.lit("54126")))
    assert spark.range(1).select(event).first()[0] == "Data Ready | Test: 54126 | Val AUPRC: 0.5000"


def test_printed_numbers_round_half_way_to_even(spark):
    values = [0.53125, 0.59375, -0.53125, 2.0, 0.00004, 1234.56789]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in rows.select(X.printed_float(F.col("v"))).collect()]
    assert got == [f"{v:.4f}" for v in values]


def test_latest_metrics_need_all_strategies(spark):
    rows = [("bfs", 1, "a"), ("BFS", 3, "b"), ("DFS", 2, "c"), ("other", 9, "d")]
    partial = spark.createDataFrame(rows, "strategy string, modified int, payload string")
    assert L.latest_per_strategy(partial).count() == 0
    whole = partial.unionByName(
        spark.createDataFrame([("random_walk", 1, "e")], "strategy string, modified int, payload string")
    )
    got = {r["strategy"]: r["payload"] for r in L.latest_per_strategy(whole).collect()}
    assert got == {"BFS": "b", "DFS": "c", "RANDOM_WALK": "e"}


def test_latest_metrics_from_files(spark, tmp_path):
    for run, strategy in (("r1", "BFS"), ("r2", "DFS"), ("r3", "RANDOM_WALK")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "topology_metrics.json").write_text(
            '{"split_strategy": "%s", "summary": {"graph_sim": 0.5}}' % strategy
        )
    rows = L.read_latest_metrics(spark, str(tmp_path))
    assert rows.count() == 3


def test_step_csv_with_different_headers(spark, tmp_path):
    for run, text in (("run1", "Epoch,Val auprc\n1,0.45\n2,0.61\n3,\n"), ("run2", "Epoch,Val Loss\n1,2.5\n")):
        folder = tmp_path / "v3" / "train" / run
        folder.mkdir(parents=True)
        (folder / "training_step.csv").write_text(text)
    paths = [str(tmp_path / "v3/train" / r / "training_step.csv") for r in ("run1", "run2")]
    steps = L.read_steps(spark, paths)
    history = L.objective_history(steps, "Val AUPRC", ["run_id"], "Epoch")
    assert [(r["run_id"], r["value"]) for r in history.orderBy("Epoch").collect()] == [("run1", 0.45), ("run1", 0.61)]
    with pytest.raises(ValueError):
        L.objective_history(steps, "Val f1", ["run_id"], "Epoch")


def test_predictions_keep_order_and_must_match(spark, tmp_path):
    pairs = spark.createDataFrame([(i, f"a{i}", f"b{i}") for i in range(50)], "pair_index long, a string, b string")
    preds = spark.createDataFrame([(i, i % 2) for i in range(50)], "pair_index long, pred int")
    K.write_predictions(pairs, preds, str(tmp_path / "out"))
    text = "".join(
        p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))
    ).splitlines()
    assert text == [f"a{i}\tb{i}\t{i % 2}" for i in range(50)]
    with pytest.raises(ValueError):
        K.write_predictions(pairs, preds.filter("pair_index > 3"), str(tmp_path / "bad"))


def test_vector_store_and_trials(spark, tmp_path):
    trials = spark.createDataFrame(
        [(0, "COMPLETE", 0.5, "p_t0000", {"lr": "1", "b": "2"}), (1, "FAIL", None, None, {})],
        "trial_number int, state string, value double, run_id string, params map<string,string>",
    )
    rows = [tuple(r) for r in K.trial_rows(trials).orderBy("trial_number").collect()]
    assert rows == [(0, "COMPLETE", "0.50000000", "p_t0000", '{"b":"2","lr":"1"}'), (1, "FAIL", "", "", "{}")]


def test_text_before_the_first_header_is_no_record(spark, tmp_path):
    (tmp_path / "a.fa").write_text("; a comment line\nmore text\n>P1 x\nACD\n>P2\nEF\n")
    (tmp_path / "b.fa").write_text("\n>P3\nGH\n")
    rows = Q.read_fasta(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa")]).select("id", "seq").collect()
    assert sorted(map(tuple, rows)) == [("P1", "ACD"), ("P2", "EF"), ("P3", "GH")]


def test_find_sequences_over_roots(spark, tmp_path):
    (tmp_path / "r" / "deep").mkdir(parents=True)
    (tmp_path / "r" / "a.csv").write_text("id,sequence\nP1,aaa\nP2,\n")
    (tmp_path / "r" / "deep" / "b.csv").write_text("id,sequence\nP1,bbb\nP2,ccc\n")
    (tmp_path / "r" / "deep" / "c.csv").write_text("name,other\nP3,x\n")
    (tmp_path / "r" / "d.fasta").write_text(">P3\nddd\n>P1\neee\n")
    (tmp_path / "own.fa").write_text(">P4\nfff\n")
    wanted = spark.createDataFrame([("P1",), ("P2",), ("P3",), ("P4",)], "id string")
    got = Q.find_sequences(spark, wanted, [str(tmp_path / "r")], str(tmp_path / "own.fa"))
    assert {r["id"]: r["seq"] for r in got.collect()} == {"P1": "AAA", "P2": "CCC", "P3": "DDD", "P4": "FFF"}
    with pytest.raises(ValueError, match="P4"):
        Q.find_sequences(spark, wanted, [str(tmp_path / "r")])
    with pytest.raises(ValueError, match="extension"):
        Q.find_sequences(spark, wanted, [], str(tmp_path / "own.txt"))


def test_steps_take_one_read_per_header(spark, tmp_path):
    for i in range(6):
        folder = tmp_path / "v3" / "train" / f"run{i}"
        folder.mkdir(parents=True)
        (folder / "s.csv").write_text(("Epoch,A\n" if i % 2 else "Epoch,B\n") + f"{i},{i}.5\n")
    paths = [str(p) for p in tmp_path.rglob("s.csv")]
    assert [len(g) for _, g in L.paths_by_header(spark, paths)] == [3, 3]
    steps = L.read_steps(spark, paths)
    assert steps.count() == 6 and {"A", "B"} <= set(steps.columns)
    with pytest.raises(ValueError):
        L.objective_history(steps.filter("Epoch = '0'"), "A", ["run_id"], "Epoch")
