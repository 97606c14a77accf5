"""The pipeline's stages: decisions take effect, tables go, odd tables pass."""

from pyspark.sql import functions as F

import corpus_pipeline
from tablewarden.llm import common, mixing, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def batches(spark, docs, name):
    return {(r["doc_id"], r["piece"]): (r["bucket_length"], r["batch"]) for r in packing.stage(spark, common.save(docs, name), "").collect()}


def test_batches_follow_the_mix(spark):
    """Without the mixing stage documents meet in other batches; with it a full batch holds more than one source."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("w"), (F.col("id") * i) % 97)))
    docs = spark.range(0, 6000, 1, 4).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 5000, "big").otherwise("small").alias("source"), F.length(words).cast("long").alias("n_chars"))
    plain, mixed = batches(spark, docs, "plain"), batches(spark, mixing.stage(spark, docs, ""), "mixed")
    assert plain.keys() == mixed.keys()
    members = {}
    for (doc, _), batch in mixed.items():
        members.setdefault(batch, set()).add(doc)
    other = {}
    for (doc, _), batch in plain.items():
        other.setdefault(batch, set()).add(doc)
    assert set(map(frozenset, members.values())) != set(map(frozenset, other.values()))
    both = lambda groups: sum(min(g) < 5000 <= max(g) for g in groups.values()) / len(groups)
    assert both(members) > both(other)


def test_a_stage_leaves_its_tables_to_its_reader_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(i, f"one two three four line {i}\nanother line of words {i % 3}", "en", f"s{i % 2}", 40) for i in range(60)], DOCS)
    docs.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "in"))
    left = {p.name.partition("-")[0] for p in tmp_path.iterdir() if p.is_dir() and "-" in p.name}
    assert left and left <= {"stage", "pieces"}
    assert rows.count() >= 0


def test_an_empty_corpus_passes_all_stages(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
