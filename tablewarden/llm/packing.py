"""Optimal length buckets and token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, stage_of, two_level_rank

MAX_LENGTH, BUCKETS, BUDGET = 2048, 16, 65_536


def best_boundaries(histogram: np.ndarray, buckets: int) -> list[int]:
    """Boundaries that minimise padding; histogram[i] counts rows of length i.

    Dynamic programming: cost(i, j) pads all lengths in (i, j] to j. O(buckets * L^2) steps in numpy, whatever the
    number of rows.
    """
    top = len(histogram) - 1
    rows, tokens = np.cumsum(histogram).astype(float), np.cumsum(histogram * np.arange(top + 1)).astype(float)
    best = np.where(np.arange(top + 1) == 0, 0.0, np.inf)
    back = []
    for _ in range(buckets):
        after, from_ = best.copy(), np.arange(top + 1)
        for j in range(1, top + 1):
            cost = best[:j] + j * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            i = int(np.argmin(cost))
            if cost[i] < after[j]:
                after[j], from_[j] = cost[i], i
        back.append(from_)
        best = after
    ends, j = [], top
    for from_ in reversed(back):
        if j and from_[j] != j:
            ends.append(j)
            j = int(from_[j])
    return sorted(ends)


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET, doc_id: str = "doc_id", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """Cut documents into pieces of at most `max_length` tokens and batch pieces of like length.

    A token is a run of non-space characters, and one more ends the document (so null and empty texts have length
    1). The histogram of piece lengths has `max_length` entries at most and is all that reaches the driver. Pieces
    of a bucket fill batches of budget // boundary rows. Returns a row for each piece: doc_id, piece, length,
    bucket_length, batch, place, padding; the pieces of a document cover it wholly. Batches are filled in hashed order,
    or along `order`: two columns of docs, a part of bounded size and the place in it. Ties take any order; columns of
    docs other than these are not read.
    """
    # split() gives an empty string before a leading and after a trailing space
    words = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    n = F.size(words) - F.when(F.element_at(words, 1) == "", 1).otherwise(0) - F.when((F.element_at(words, -1) == "") & (F.size(words) > 1), 1).otherwise(0)
    along = [F.col(c).alias(a) for c, a in zip(order or [], ("part", "at"))]
    lengths = docs.select(F.col(doc_id).alias("doc_id"), *along, (n + 1).cast("long").alias("tokens"))
    keep = ["doc_id", *(["part", "at"] if order else [])]
    pieces = lengths.select(*keep, "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / max_length))).alias("piece"))
    pieces = save(pieces.select(*keep, "piece", F.least(F.lit(max_length).cast("long"), F.col("tokens") - F.col("piece") * max_length).alias("length")), "pieces")
    histogram = np.zeros(max_length + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most max_length rows
        histogram[row["length"]] = row["count"]
    longest = int(np.flatnonzero(histogram)[-1]) if histogram.any() else 1
    ends = best_boundaries(histogram[: longest + 1], buckets) or [1]
    index = sum((F.when(F.col("length") > e, 1).otherwise(0) for e in ends), F.lit(0))
    placed = pieces.withColumn("bucket_length", F.element_at(F.array(*[F.lit(int(e)) for e in ends]), (index + 1).cast("int")).cast("long"))
    if order:
        ranked = two_level_rank(placed, ["bucket_length"], [F.col("at"), F.col("piece")], None, 0, "rank", "part")
    else:
        ranked = two_level_rank(placed, ["bucket_length"], [F.col("doc_id"), F.col("piece")], F.xxhash64("doc_id", "piece"), int(histogram.sum()), "rank")
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length")))
    return ranked.select("doc_id", "piece", "length", "bucket_length", F.floor(F.col("rank") / size).alias("batch"), (F.col("rank") % size).alias("place"), (F.col("bucket_length") - F.col("length")).alias("padding"))


def op4(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@stage_of
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches filled along the files and rows of docs, which lie in the order of the mix, so that they follow its weights."""
    rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return pack(rows, order=["file", "row"])
