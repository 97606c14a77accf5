"""Counts of findings against the findings themselves, and limits of walks against the walks."""

import os
import random

from pyspark.sql import functions as F

from tablewarden.operators import coverage, tables, tally, walk
from tablewarden.plans.fixture import Fixture
from tablewarden.plans.scoring import Scored

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def counted(df):
    return {(r["model_urn"], r["finding_type"]): r["n"] for r in df.collect()}


def test_gaps_make_no_findings(spark):
    a = Scored(Fixture(spark, SF))
    assert a.gaps.count() > 0
    made = set(vars(a))
    assert not made & {"_findings", "label_matches", "class_matches", "stale", "edges", "reached", "linked"}


def test_counts_of_checks_are_those_of_the_findings(spark):
    a = Scored(Fixture(spark, SF))
    want = counted(a.findings.where(F.col("finding_type").isin(*coverage.FOUND_AS)).groupBy("model_urn", "finding_type").agg(F.count(F.lit(1)).alias("n")))
    assert counted(a.check_tally) == want and len({kind for _, kind in want}) == 5


def test_model_facts_count_findings_without_them(spark):
    a = Scored(Fixture(spark, SF))
    got, made = counted(a.model_tally), set(vars(a))
    points = {r["model_urn"]: r["score"] for r in a.points.collect()}
    assert not made & {"_findings", "label_matches", "class_matches", "edges", "reached", "linked"}
    assert got == counted(a.findings.groupBy("model_urn", "finding_type").agg(F.count(F.lit(1)).alias("n")))
    assert points == {r["model_urn"]: r["score"] for r in a.scores.collect()} and len(set(points.values())) > 3


def test_limits_are_those_of_the_walks(spark):
    draw = random.Random(7)
    edges = {(f"n{draw.randrange(60)}", f"n{draw.randrange(60)}") for _ in range(45)} | {(f"c{i + 1}", f"c{i}") for i in range(6)} | {(f"u{i}", "c0") for i in range(5)}
    lineage = spark.createDataFrame(sorted(edges), "upstream_column_urn string, downstream_column_urn string")
    columns = spark.createDataFrame([(n,) for n in sorted({x for e in edges for x in e} | {"alone"})], "column_urn string")
    for hops, cap in ((3, 4), (1, 2), (5, 50)):
        want = {tuple(r) for r in walk.walk_limits(columns, lineage, hops, cap).where("truncated or hop_capped").select("root", "truncated", "hop_capped").collect()}
        assert {tuple(r) for r in walk.limited(columns, lineage, hops, cap).collect()} == want and want


def test_drifts_are_counted_as_they_are_found(spark):
    runs = spark.createDataFrame([("m", "r1"), ("m", "r1"), ("m", "r2"), ("k", "r3")], "model_urn string, run_urn string")
    inputs = spark.createDataFrame([("r1", "d"), ("r1", "e"), ("r2", "d"), ("r3", "d"), ("r3", "gone")], "run_urn string, dataset_urn string")
    snaps = spark.createDataFrame([("r1", "d"), ("r1", "e"), ("r3", "d"), ("r3", "gone")], "run_urn string, dataset_urn string")
    taken = spark.createDataFrame([("r1", "e", "b", "INT"), ("r1", "e", "a", None), ("r3", "d", "a", "INT"), ("r3", "d", "x", None)], "run_urn string, dataset_urn string, field_path string, native_type string")
    now = spark.createDataFrame([("d", "a", "INT"), ("d", "y", None), ("e", "b", "TEXT")], "dataset_urn string, field_path string, native_type string")
    want = {(r["model_urn"], r["n"]) for r in tables.schema_changes(runs, inputs, snaps, taken, now).select("model_urn", "run_urn", "dataset_urn").distinct().groupBy("model_urn").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {tuple(r) for r in tally.drifts(runs, inputs, snaps, taken, now).collect()} == want == {("m", 2)}


def test_marked_ends_are_those_of_the_paths(spark):
    draw = random.Random(11)
    edges = {(f"n{draw.randrange(30)}", f"n{draw.randrange(30)}") for _ in range(45)}
    lineage = spark.createDataFrame(sorted(edges), "upstream_column_urn string, downstream_column_urn string")
    columns = spark.createDataFrame([(f"n{i}",) for i in range(24)] + [("alone",)], "column_urn string")
    marks = spark.createDataFrame([("n3", "a"), ("n8", "b"), ("n21", "a"), ("n27", "a"), ("lone", "b")], "column_urn string, marker_urn string")
    for hops in (1, 2, 4):
        near = walk.below({"class": marks}, lineage, hops)
        want = {tuple(r) for r in walk.marked_ancestors(columns, lineage, marks, hops).select("root", "ancestor", "marker_urn").collect()}
        assert {tuple(r) for r in walk.first_marked(columns, lineage, marks, near, hops).select("root", "node", "marker_urn").collect()} == want and want
        assert {r["root"] for r in near.join(columns, F.col("node") == F.col("column_urn")).select(F.col("node").alias("root")).collect()} == {r for r, _, _ in want}


def test_provenance_makes_no_findings(spark):
    from tablewarden.plans import facts

    a = Scored(Fixture(spark, SF))
    rows = facts.feature_provenance(a)
    assert rows.where("findings <> '' and chains > 0").count() > 0
    assert not set(vars(a)) & {"_findings", "label_matches", "class_matches", "edges", "reached", "linked"}
