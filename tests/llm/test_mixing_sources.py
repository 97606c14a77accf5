"""More sources than are scheduled by themselves."""

from collections import Counter

from pyspark.sql import functions as F

from tablewarden.llm import mixing


def test_four_hundred_sources(spark):
    """Every row has a place of its own, ties and repeated rows too, and light sources share their group by weight."""
    rows = [(i % 500, f"s{i % 400}", "x", i) for i in range(12_000)] + [(7, None, "x", 1)] * 40 + [(None, "s1", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, `a.b` string, place long")
    weights = {f"s{i}": 1000.0 if i < 5 else 4.0 if i < 200 else 1.0 for i in range(400)}
    got = mixing.mix_sources(df, weights, block=4, frame=60, alone=10).collect()
    assert Counter((r["doc_id"], r["source"], r["a.b"], r["place"]) for r in got) == Counter(rows)
    assert len({(r["mix_slot"], r["mix_row"]) for r in got}) == len(rows)
    light = sorted((r["mix_slot"], r["mix_row"], r["source"]) for r in got if r["source"] and int(r["source"][1:]) >= 10)
    half = Counter(int(s[1:]) < 200 for *_, s in light[: len(light) // 4])
    assert 3 < half[True] / half[False] < 5  # 190 sources of weight 4 beside 200 of weight 1


def test_a_slow_source_does_not_fill_one_bucket(spark):
    """One source of a tiny weight: the others' rows are ranked in many windows all the same."""
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, "slow").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("source"))
    weights = {"slow": 1e-6} | {f"s{i}": 1.0 for i in range(40)}
    got = mixing.mix_sources(rows, weights, block=8, frame=60, alone=4)
    last = got.where("source <> 'slow'").agg(F.max("mix_slot")).first()[0]
    assert got.where(f"source = 'slow' and mix_slot < {last} - 100").count() <= 1
    assert got.count() == 60_000
