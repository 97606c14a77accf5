"""Names to entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_names(requests: DataFrame, datasets: DataFrame) -> DataFrame:
    """Datasets whose name is the request or ends with it after a dot: (request, n_matches, dataset_urn, matches).

    Every dotted ending of every name becomes a row, so the match is an equality join. dataset_urn is null unless
    there is one match; all matches are listed.
    """
    parts = F.split("name", r"\.")
    endings = datasets.select("dataset_urn", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("request"))
    found = requests.join(endings, "request", "left").groupBy("request").agg(F.count("dataset_urn").alias("n_matches"), F.max("dataset_urn").alias("one"), F.sort_array(F.collect_list("dataset_urn")).alias("matches"))
    return found.select("request", "n_matches", F.when(F.col("n_matches") == 1, F.col("one")).alias("dataset_urn"), "matches")
