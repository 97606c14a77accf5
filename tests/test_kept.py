"""What-if walks, counted chains, bounded cones, and what is kept between scans, against brute force on small graphs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import facts, quality, upkeep, walk, whatif
from tablewarden.sources.state import KeyedState

LINEAGE = "upstream_column_urn string, downstream_column_urn string"


def graph(rng, n, m):
    return sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)})


def simple_paths(edges, start, hops):
    out, front = [], [[start]]
    for _ in range(hops):
        front = [p + [d] for p in front for s, d in edges if s == p[-1] and d not in p]
        out += front
    return out


def upstream(spark, edges):
    """edges run from a column to what it derives from."""
    return spark.createDataFrame([(d, s) for s, d in edges], LINEAGE)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_are_counted_as_if_listed(spark, seed):
    rng = random.Random(seed)
    edges = graph(rng, 9, 30)  # cycles, loops and edges to and fro
    got = {r["column_urn"]: r["chains"] for r in facts.chain_counts(spark.createDataFrame([(f"n{i}",) for i in range(10)], "column_urn string"), upstream(spark, edges)).collect()}
    assert got == {f"n{i}": len(simple_paths(edges, f"n{i}", 3)) for i in range(10)}


def remedies_by_hand(edges, root, marks, after, hops):
    """Paths to the first mark, with what each scenario leaves."""

    def matches(without=(), lifted=None):
        out, front = [], [[root]]
        for hop in range(hops + 1):
            stop = {tuple(p): (p[-1] in after) if p[-1] == lifted else p[-1] in marks for p in front}
            out += [p for p in front if stop[tuple(p)]]
            front = [p + [d] for p in front if not stop[tuple(p)] and hop < hops for s, d in edges if s == p[-1] and d not in p and (s, d) not in without]
        return out

    found = matches()
    want = {("remove_mark", p[-1]): len(matches(lifted=p[-1])) for p in found}
    if found and all(len(p) > 1 for p in found):
        first = {(p[0], p[1]) for p in found}
        want |= {("cut_edge", f"{s}<-{d}"): len(matches({(s, d)})) for s, d in first} | {("cut_all", "*"): len(matches(first))}
    return len(found), want


@pytest.mark.parametrize("seed", [4, 5])
def test_remedies_are_walked_again(spark, seed):
    rng = random.Random(seed)
    edges = [e for e in graph(rng, 10, 24) if e[0] != e[1]]
    marks, after = {"n7", "n8", "n9"}, {"n8"}
    linked = spark.createDataFrame([("m", f"f{i}", f"n{i}") for i in range(10)] + [("m", "twin", "n1"), ("other", "f1", "n1")], "model_urn string, feature_urn string, source string")
    named = lambda cols: spark.createDataFrame([("t", c) for c in cols], "finding_type string, column_urn string")
    marked = spark.createDataFrame([(c, "mark") for c in marks], "column_urn string, marker_urn string")
    lineage = upstream(spark, edges)
    matches = walk.marked_ancestors(linked.select(F.col("source").alias("column_urn")).distinct(), lineage, marked, 4).withColumn("finding_type", F.lit("t"))
    rows = whatif.column_remedies(linked, matches, lineage, named(marks), named(after), 4).collect()
    for model, feature, source in [tuple(r) for r in linked.collect()]:
        paths, want = remedies_by_hand(edges, source, marks, after, 4)
        if paths:
            want[("drop_feature", feature)] = paths if (model, source) == ("m", "n1") else 0
        got = {(r["remedy"], r["target"]): r["paths_left"] for r in rows if (r["model_urn"], r["feature_urn"]) == (model, feature)}
        assert got == want
        assert all(r["paths"] == paths and r["cleared"] == (r["paths_left"] == 0) for r in rows if (r["model_urn"], r["feature_urn"]) == (model, feature))


def test_half_a_fix_clears_nothing_and_a_lifted_mark_shows_the_next(spark):
    edges = [("f", "a"), ("f", "b"), ("a", "x"), ("b", "x"), ("x", "y")]
    _, want = remedies_by_hand(edges, "f", {"x", "y"}, set(), 6)
    assert want == {("cut_edge", "f<-a"): 1, ("cut_edge", "f<-b"): 1, ("cut_all", "*"): 0, ("remove_mark", "x"): 2}
    linked = spark.createDataFrame([("m", "feat", "f")], "model_urn string, feature_urn string, source string")
    marked = spark.createDataFrame([("x", "k"), ("y", "k")], "column_urn string, marker_urn string")
    lineage = upstream(spark, edges)
    matches = walk.marked_ancestors(linked.select(F.col("source").alias("column_urn")), lineage, marked, 6).withColumn("finding_type", F.lit("t"))
    marks = marked.select(F.lit("t").alias("finding_type"), "column_urn")
    rows = whatif.column_remedies(linked, matches, lineage, marks, marks.where("false"), 6).collect()
    assert {(r["remedy"], r["target"]): r["paths_left"] for r in rows} == want | {("drop_feature", "feat"): 0}


def by_distance(edges, root, hops):
    seen, front = {root: 0}, {root}
    for hop in range(1, hops + 1):
        front = {d for s, d in edges if s in front} - set(seen)
        seen |= {d: hop for d in front}
    return sorted((h, n) for n, h in seen.items() if h)


@pytest.mark.parametrize("cap", [1, 3, 8, 100])
def test_bounded_walks_have_the_nearest_nodes(spark, cap):
    edges = graph(random.Random(cap), 30, 90)
    frame, starts = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(f"n{i}", f"n{i}") for i in range(30)], "root string, node string")
    got = {}
    for r in walk.bounded_reach(starts, frame, 4, cap).collect():
        got.setdefault(r["root"], []).append((r["hops"], r["node"]))
    assert {k: sorted(v) for k, v in got.items()} == {f"n{i}": found for i in range(30) if (found := by_distance(edges, f"n{i}", 4)[:cap])}


def test_bounded_walks_do_not_build_what_they_cut(spark, monkeypatch):
    """A hub with 5,000 parents, each of which has 5 more: 20 roots keep 10 nodes each and nothing else."""
    hub = spark.range(5000).selectExpr("'hub' AS src", "'p' || id AS dst").union(spark.range(25000).selectExpr("'p' || (id % 5000) AS src", "'q' || id AS dst"))
    roots = spark.range(20).selectExpr("'r' || id AS root", "'r' || id AS node")
    edges, built, cut = hub.union(roots.selectExpr("root AS src", "'hub' AS dst")), [], walk.cut

    def counted(df):
        out = cut(df)
        if "held" in out.columns:
            built.append(out.count())
        return out

    monkeypatch.setattr(walk, "cut", counted)
    assert walk.bounded_reach(roots, edges, 6, 10).count() == 200
    assert sum(built) <= 20 * 10
    columns = roots.select(F.col("root").alias("column_urn"))
    limits = walk.walk_limits(columns, edges.select(F.col("dst").alias("upstream_column_urn"), F.col("src").alias("downstream_column_urn")), 6, 10).collect()
    assert {(r["cone"], r["truncated"], r["hop_capped"]) for r in limits} == {(10, True, False)}


def test_metrics_add_up_in_any_order(spark):
    rng = random.Random(9)
    bad = ["", None, "started", '{"findings":3}', '{"detect_ms":"soon"}', '{"detect_ms":-4}', "[1]"]
    lines = [json.dumps({"dry_run": rng.random() < 0.4, "findings": rng.randrange(9), "detect_ms": rng.choice([0, 5, 6, 10_000, 10_001, rng.randrange(20_000)])}) for _ in range(400)]
    lines += bad + ['{"detect_ms":7}', '{"detect_ms":8,"dry_run":"true","findings":"x"}']
    rng.shuffle(lines)
    scans = quality.scan_records(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string"))
    assert scans.count() == 402
    whole = sorted(map(tuple, quality.partial_metrics(scans, "dry_run").collect()))
    split = scans.withColumn("part", F.col("detect_ms") % 7)
    for order in (F.col("part"), F.col("part").desc()):
        parts = quality.partial_metrics(split, "part", "dry_run").orderBy(order)
        half = quality.merge_metrics(parts.where("part < 3"), "dry_run").unionByName(quality.merge_metrics(parts.where("part >= 3"), "dry_run"))
        assert sorted(map(tuple, quality.merge_metrics(half, "dry_run").collect())) == whole
    for dry, n, *_, buckets in whole:
        values = [r["detect_ms"] for r in scans.where(F.col("dry_run") == dry).collect()]
        ends = [float("-inf"), *quality.BOUNDS_MS, float("inf")]
        assert n == len(values) and list(buckets) == [sum(lo < v <= hi for v in values) for lo, hi in zip(ends, ends[1:])]


def test_auc_of_continuous_scores(spark):
    rng = random.Random(5)
    rows = [(round(rng.gauss(y, 1), 3 if i % 2 else 12), y) for i in range(3000) for y in [int(rng.random() < 0.3)]]
    frame = spark.createDataFrame(rows, "s double, y int")
    found = quality.roc_auc(frame, "s", "y")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(found.first()["auc"] - want) < 1e-9
    plan = found._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("], [part#" in line for line in windows)  # no window over all rows
    assert quality.roc_auc(frame.where("y = 1"), "s", "y").first()["auc"] is None
    assert quality.roc_auc(frame.where("false"), "s", "y").first()["auc"] is None


def test_single_members_come_and_go(spark):
    current = spark.createDataFrame([("a", ["x", "y", "z"]), ("b", ["x"]), ("c", []), ("d", None)], "entity_urn string, members array<string>")
    intents = spark.createDataFrame([("a", "y", "remove", 1), ("b", "y", "remove", 1), ("b", "x", "add", 1), ("c", "q", "add", 1), ("c", "p", "add", 2), ("c", "r", "add", 1), ("c", "r", "remove", 2), ("d", None, "add", 1), ("e", "n", "add", 1), ("f", "n", "remove", 1)], "entity_urn string, member string, op string, seq int")
    got = {r["entity_urn"]: (r["members"], r["changed"]) for r in upkeep.change_members(current, intents).collect()}
    assert got == {"a": (["x", "z"], True), "b": (["x"], False), "c": (["p", "q"], True), "d": ([], False), "e": (["n"], True), "f": ([], False)}


def test_an_incident_on_a_dropped_column_closes(spark, tmp_path):
    strings = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    memory = KeyedState(spark, str(tmp_path), spark.createDataFrame([], "model_urn string, columns array<string>, run long").schema, ["model_urn"], "run")
    models = strings([("m1",), ("m2",)], "model_urn")
    leaks = strings([("m1", "gone"), ("m1", "kept"), ("m2", "far")], "model_urn resource_urn")
    memory.add(upkeep.leak_columns(leaks, models, F.lit(1).cast("long")))
    incidents = strings([(c, c, f"Target leakage: {c}", "ACTIVE") for c in ("gone", "kept", "far")], "incident_urn resource_urn title state")
    scanned, resources = models.where("model_urn = 'm1'"), strings([("m1", "kept")], "model_urn resource_urn")
    findings = strings([("kept", "target_leakage", "Target leakage: another end")], "resource_urn finding_type title")
    closed = upkeep.resolved_incidents(incidents, findings, upkeep.incident_candidates(resources, memory.rows(), scanned))
    assert [r["incident_urn"] for r in closed.collect()] == ["gone"]
    memory.add(upkeep.leak_columns(leaks.where("false"), scanned, F.lit(2).cast("long")))
    assert {r["model_urn"]: r["columns"] for r in memory.rows().collect()} == {"m1": [], "m2": ["far"]}


def test_reports_replace_what_was_scanned(spark, tmp_path):
    made = lambda word: spark.createDataFrame([(t, f"{word} {t}") for t in "abc"], "target string, report string")
    facts.keep_reports(made("old"), str(tmp_path), "one")
    rows = facts.keep_reports(made("new"), str(tmp_path), "two", spark.createDataFrame([("b",)], "target string"))
    assert sorted((r["target"], r["run"], r["report"]) for r in rows.collect()) == [("a", "one", "old a"), ("b", "two", "new b"), ("c", "one", "old c")]
