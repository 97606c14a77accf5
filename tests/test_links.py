"""Inferred links with their reasons, faithfulness of texts, and cautions, on small frames."""

from pyspark.sql import functions as F

from tablewarden.operators import linking, quality, score


def strings(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))


def test_routes_to_a_feature_table(spark):
    models = [(m, m) for m in ("one_input", "param", "lineage", "ambiguous", "named credit risk", "unknown")]
    runs = spark.createDataFrame([("one_input", "r1", 0), ("param", "r2", 0), ("param", "r3", 1), ("ambiguous", "r4", 0)], "model_urn string, run_urn string, pos int")
    inputs = strings(spark, [("r1", "d.a"), ("r2", "d.a"), ("r2", "d.b"), ("r4", "d.a"), ("r4", "d.b")], "run_urn dataset_urn")
    properties = strings(spark, [("r1", "dataset", "s3://x/b"), ("r2", "Dataset", "nowhere"), ("r3", "dataset", "d.a"), ("r3", "TABLE", " /lake/b/ "), ("r2", "table", None), ("r4", "other", "b")], "run_urn key value")
    above = strings(spark, [("lineage", "d.c"), ("ambiguous", "d.c"), ("ambiguous", "d.d"), ("one_input", "d.c")], "model_urn dataset_urn")
    datasets = strings(spark, [(f"d.{n}", name) for n, name in zip("abcdefghi", ["wh.a", "wh.b", "c", "d", "credit.x1", "credit.x2", "risk_x3", "credit", "credit.risk"])], "dataset_urn name")
    got = {r["model_urn"]: (r["dataset_urn"], r["route"], r["key"], r["candidates"]) for r in linking.infer_feature_table(strings(spark, models, "model_urn name"), runs, inputs, properties, above, datasets).collect()}
    assert got == {
        "one_input": ("d.a", "run input", None, []),
        "param": ("d.b", "run parameter", "table", []),  # the first run's `dataset` names nothing, and the second's is not asked
        "lineage": ("d.c", "lineage", None, []),
        "ambiguous": (None, "ambiguous", None, ["d.a", "d.b"]),
        "named credit risk": (None, "none", None, ["d.e", "d.f", "d.g", "d.h", "d.i"]),
        "unknown": (None, "none", None, []),
    }


def test_proposals_say_why(spark):
    found = spark.createDataFrame([("m1", "t1", "run parameter", "table", []), ("m2", None, "ambiguous", None, ["t1", "t2"]), ("m3", "t3", "lineage", None, [])], "model_urn string, dataset_urn string, route string, key string, candidates array<string>")
    labels = strings(spark, [("t1", "t1.y", "marked"), ("t2", "t2.y", "name")], "dataset_urn column_urn reason")
    got = {r["model_urn"]: r for r in linking.propose_links(found, labels, strings(spark, [("t1", "t1.y"), ("t1", "t1.id")], "dataset_urn column_urn")).collect()}
    assert (got["m1"]["label_column_urn"], got["m1"]["excluded"], got["m1"]["complete"], got["m1"]["candidates"]) == ("t1.y", ["t1.id", "t1.y"], True, [])
    assert got["m1"]["reasons"][0].endswith("table") and got["m1"]["reasons"][1] == "label: marked"
    assert (got["m2"]["label_column_urn"], got["m2"]["excluded"], got["m2"]["complete"], got["m2"]["candidates"]) == (None, [], False, ["t1", "t2"])
    assert got["m2"]["reasons"][1:] == ["label: not inferred without a table", "excluded: not inferred without a table"]
    assert not got["m3"]["complete"] and all(len(r["reasons"]) == 3 for r in got.values())


def test_texts_are_held_against_facts_and_entities(spark):
    rows = [("a", "llm", "lag 30.0 of 6", "30 hours, limit 6h, see urn:li:x:known."), ("b", "llm", "lag 3", "3 or 4.5 or 4.5 (urn:li:x:lost, urn:li:x:lost)."), ("c", "template", None, None), ("d", "template", "", "nothing said")]
    texts = strings(spark, rows, "id provider facts prose")
    known = strings(spark, [("urn:li:x:known",)], "urn")
    checks = quality.faithfulness(texts.where("prose is not null"), known)
    got = {r["id"]: (r["numbers_checked"], r["urns_checked"], [tuple(v) for v in r["violations"]], r["faithful"]) for r in checks.collect()}
    assert got == {"a": (2, 1, [], True), "b": (3, 2, [("number", "4.5"), ("urn", "urn:li:x:lost")], False), "d": (0, 0, [], True)}
    rates = {r["provider"]: (r["narratives"], r["violations"], r["rate"]) for r in quality.faithfulness_rates(checks).collect()}
    assert rates == {"llm": (2, 2, 0.5), "template": (1, 0, 1.0), "all": (3, 2, 2 / 3)}
    none = quality.faithfulness_rates(checks.where("false")).collect()
    assert [(r["provider"], r["narratives"], r["rate"]) for r in none] == [("all", 0, None)]
    unchecked = quality.faithfulness(texts.where("id = 'b'")).first()
    assert unchecked["urns_checked"] == 0 and len(unchecked["violations"]) == 1


def test_only_a_policy_by_score_alone_is_cautioned():
    assert score.policy_caution(None, 40)
    assert [score.policy_caution(*p) for p in ((None, None), ("high", None), ("high", 40))] == [None] * 3
