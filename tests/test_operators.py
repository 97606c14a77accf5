"""Boundary cases of single operators on small frames."""

from pyspark.sql import functions as F

from tablewarden.functions import rules, text, urn
from tablewarden.operators import coverage, history, quality, score, tables, walk

HOUR = 3_600_000
NOW = 1_800_000_000_000


def test_exactly_at_the_limit_is_fresh(spark):
    lags = [0.5, 2.0, 5.5, 6.0, 6.5, 72.0]
    rows = spark.createDataFrame([(h, int(NOW - h * HOUR)) for h in lags] + [(None, None)], "h double, ms long")
    got = {r["h"]: r["s"] for r in rows.select("h", rules.is_stale("ms", NOW, 6.0).alias("s")).collect()}
    assert got == {0.5: False, 2.0: False, 5.5: False, 6.0: False, 6.5: True, 72.0: True, None: None}


def test_walks_stop_at_first_mark_and_survive_cycles(spark):
    lineage = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c"), ("c", "d"), ("d", "b"), ("z", "a")], "upstream_column_urn string, downstream_column_urn string")
    columns = spark.createDataFrame([("c",), ("a",)], "column_urn string")
    marks = spark.createDataFrame([("a", "m"), ("z", "m"), ("x", "m")], "column_urn string, marker_urn string")
    got = {(r["root"], tuple(r["path"])) for r in walk.marked_ancestors(columns, lineage, marks, 6).collect()}
    assert got == {("c", ("c", "b", "a")), ("c", ("c", "x")), ("a", ("a",))}
    capped = {(r["root"], tuple(r["path"])) for r in walk.marked_ancestors(columns, lineage, marks, 1).collect()}
    assert capped == {("c", ("c", "x")), ("a", ("a",))}


def test_hop_cap_is_seen(spark):
    lineage = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(5)], "upstream_column_urn string, downstream_column_urn string")
    columns = spark.createDataFrame([("n0",), ("n3",)], "column_urn string")
    got = {r["root"]: (r["cone"], r["truncated"], r["hop_capped"]) for r in walk.walk_limits(columns, lineage, 3, 4).collect()}
    assert got == {"n0": (4, True, True), "n3": (2, False, False)}


def test_empty_snapshot_counts_and_missing_does_not(spark):
    runs = spark.createDataFrame([("m", "r1"), ("m", "r2")], "model_urn string, run_urn string")
    inputs = spark.createDataFrame([("r1", "d"), ("r2", "d")], "run_urn string, dataset_urn string")
    snaps = spark.createDataFrame([("r1", "d")], "run_urn string, dataset_urn string")
    none = spark.createDataFrame([], "run_urn string, dataset_urn string, field_path string, native_type string")
    now = spark.createDataFrame([("d", "a", "INT")], "dataset_urn string, field_path string, native_type string")
    got = [(r["run_urn"], r["field_path"], r["kind"]) for r in tables.schema_changes(runs, inputs, snaps, none, now).collect()]
    assert got == [("r1", "a", "added")]


def test_scores_round_half_to_even_and_cap_the_band(spark):
    fields = "model_urn string, upstream_failure boolean, leakage boolean, schema_drift boolean, sensitive_source boolean, deprecated_input boolean, missing_owner boolean, lag_ratio double, worst int"
    rows = spark.createDataFrame([("a", False, True, False, False, False, False, 0.0, 0), ("b", True, True, True, True, True, True, 1.0, 0), ("c", False, False, False, False, True, False, 0.0, 2), ("d", False, False, False, False, False, False, 1 / 30, 2)], fields)
    got = {r["model_urn"]: (r["score"], r["band"]) for r in score.trust_scores(rows).collect()}
    assert got == {"a": (80, "watch"), "b": (0, "at_risk"), "c": (95, "healthy"), "d": (100, "healthy")}


def test_text_helpers(spark):
    row = spark.createDataFrame([("30.0h, 1,204 of v3 LLM01 in loans_2024 (see urn:li:mlModel:(urn:li:dataPlatform:mlflow,x,PROD)).",)], "t string")
    got = row.select(text.numbers_in("t").alias("n"), text.urns_in("t").alias("u")).first()
    assert got["n"] == [30.0, 1204.0]
    assert got["u"] == ["urn:li:mlModel:(urn:li:dataPlatform:mlflow,x,PROD)"]
    path = row.select(text.path_text(F.array(*[F.lit(x) for x in "xxyx"])).alias("p")).first()["p"]
    assert path == "x <- y <- x"
    bad = spark.createDataFrame([("urn:li:schemaField:(broken",), (None,)], "u string").select(urn.field_parent("u").alias("p")).collect()
    assert [r["p"] for r in bad] == [None, None]


def test_marks_of_evidence_are_taken_out(spark):
    cases = {"a<evidence>b": "a[removed]b", "</Evidence >": "[removed]", "< /\t\nEVIDENCE>": "[removed]", "<<evidence>>": "<[removed]>", "<evidence": "<evidence", "<//evidence>": "<//evidence>", "<ev idence>": "<ev idence>", "x > y < z": "x > y < z", "": "", "<evidence></evidence>": "[removed][removed]", "<evidence/>": "<evidence/>"}
    rows = spark.createDataFrame([*cases.items(), (None, None)], "t string, want string")
    assert [r for r in rows.select("want", text.neutralize("t").alias("got")).collect() if r["want"] != r["got"]] == []


def test_runs_are_named_by_the_last_word(spark):
    cases = {"seen. tablewarden-run=r1": "r1", "tablewarden-run=a.b \n": "a.b", "tablewarden-run=": None, "tablewarden-run=r1 later": None, "xtablewarden-run=r1": None, "": None}
    rows = spark.createDataFrame([*cases.items(), (None, None)], "t string, want string")
    assert [r for r in rows.select("want", text.run_id("t").alias("got")).collect() if r["want"] != r["got"]] == []


def test_rates_are_null_when_not_measured(spark):
    pairs = spark.createDataFrame([("g", False, False)], "g string, expected boolean, observed boolean")
    row = quality.confusion(pairs, "g").first()
    assert (row["precision"], row["recall"], row["false_positive_rate"]) == (None, None, 0.0)
    assert quality.roc_auc(spark.createDataFrame([(1.0, 1), (0.0, 0), (1.0, 0)], "s double, y int"), "s", "y").first()["auc"] == 0.75


def test_coverage_without_models_is_zero(spark):
    gaps = spark.createDataFrame([], "model_urn string, check string, reason string")
    rows = coverage.guard_coverage(gaps, spark.createDataFrame([], "model_urn string")).collect()
    assert len(rows) == 6 and {r["rate"] for r in rows} == {0.0}


def test_a_run_replaces_its_history_entry(spark):
    rows = spark.createDataFrame([("m", "r1", 1, 5), ("m", "r2", 2, 6), ("m", "r1", 3, 7)], "model_urn string, run_id string, recorded_at long, score int")
    got = [(r["run_id"], r["score"], r["age"]) for r in history.capped_history(rows, 1).collect()]
    assert got == [("r1", 7, 1)]


def test_a_changed_catalog_gets_a_new_audit(spark, tmp_path):
    from tablewarden.plans.scoring import audit_of

    spark.range(3).write.parquet(str(tmp_path / "part.parquet"))
    first = audit_of(spark, str(tmp_path))
    assert audit_of(spark, str(tmp_path)) is first
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "part.parquet"))
    second = audit_of(spark, str(tmp_path))
    assert second is not first and second.t.part.count() == 4
