"""Cutoffs of groups of any size come from one formula."""

from pyspark.sql import functions as F

from tablewarden.llm import quality


def cutoffs(spark, rows):
    """A group of `rows` documents with words of 9 characters beside a large one with words of 5."""
    big = spark.range(5000).select(F.lit("=big").alias("source_key"), F.lit(500).alias("word_length"))
    own = spark.range(rows).select(F.lit("=own").alias("source_key"), F.lit(1800).alias("word_length"))
    made = big.unionByName(own).select("source_key", F.lit("=en").alias("lang_key"), "word_length", *[F.lit(0).cast("long").alias(c) for c in ("symbol_rate", "line_rate", "repeat_rate", "n_repeat_words")], F.lit(100).cast("long").alias("n_words"))
    made = made.withColumn("word_length", F.col("word_length").cast("long"))
    return {r["source_key"]: r["word_length_upper"] for r in quality.thresholds(quality.sketches(made)).collect()}


def test_no_number_of_rows_switches(spark):
    """One row more moves a cutoff by less than a hundredth; few rows leave it to the language, many have their own."""
    own = {n: cutoffs(spark, n)["=own"] for n in (1, 199, 200, 499, 500, 20_000)}
    assert abs(own[200] - own[199]) < 12 and abs(own[500] - own[499]) < 12
    assert own[1] < 1210 and own[1] < own[199] < own[499] and own[20_000] > 1700


def test_columns_of_any_name_pass(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "en", "s", 0, "x", 5), (2, "too short", "en", "s", 0, "y", 5), (3, None, None, None, 0, None, 5)], "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, n_words int")
    kept = quality.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [(1, text, "en", "s", 0, "x", 5)]
