"""Measures of the checks themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .steps import cut


def confusion(pairs: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of (expected, observed) by group; a rate with nothing to divide by is null."""
    e, o = F.col("expected"), F.col("observed")
    counts = pairs.groupBy(*by).agg(F.count_if(e & o).alias("tp"), F.count_if(~e & o).alias("fp"), F.count_if(~e & ~o).alias("tn"), F.count_if(e & ~o).alias("fn"))
    over = lambda a, b: F.try_divide(a, b)
    rows = counts.withColumn("precision", over(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", over(F.col("tp"), F.col("tp") + F.col("fn")))
    rows = rows.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return rows.withColumn("false_positive_rate", over(F.col("fp"), F.col("fp") + F.col("tn")))


def latency(samples: DataFrame, value: str, *by: str) -> DataFrame:
    return samples.groupBy(*by).agg(F.count(value).alias("n"), F.percentile(value, 0.5).alias("median"), F.max(value).alias("worst"))


def verdict(value: str, target: float, higher: bool = True):
    """meets or misses a target; at the target it meets; null is not measured."""
    good = F.col(value) >= target if higher else F.col(value) <= target
    return F.when(F.col(value).isNull(), "not measured").when(good, "meets").otherwise("misses")


#: Ranges that the distinct scores of roc_auc() are dealt to.
RANGES = 200


def roc_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by ranks, equal scores sharing theirs; one row.

    Counts by score first. Distinct scores are then dealt to RANGES ranges in order; each range is summed up by itself
    and moved by the sum of the ranges below, so no task sees more than a range, whatever the number of scores.
    """
    by = rows.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    by = cut(by.repartitionByRange(RANGES, score).withColumn("part", F.spark_partition_id()))
    sums = by.groupBy("part").agg(F.sum("n").alias("n")).agg(F.collect_list(F.struct("part", "n")).alias("sums"))  # RANGES at most
    within = Window.partitionBy("part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    lower = F.aggregate(F.filter("sums", lambda s: s["part"] < F.col("part")), F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    ranked = by.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).crossJoin(F.broadcast(sums))
    totals = ranked.withColumn("w", F.col("p") * (F.col("inside") + lower + F.col("n") / 2)).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return totals.select(F.try_divide("w", F.col("p") * F.col("n")).alias("auc"), "p", "n")


#: Upper ends of the buckets of a histogram of milliseconds, the end itself included; above all is one more.
BOUNDS_MS = [0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000]


def scan_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """(dry_run, findings, detect_ms) of log lines that tell of a finished scan: those with a whole detect_ms.

    Other lines and unreadable ones are passed over. A scan that doesn't say whether it was a dry run was none, one that
    doesn't count findings has none.
    """
    told = F.from_json(line, "dry_run string, findings string, detect_ms string")
    rows = lines.select(told.alias("j")).select(F.coalesce(F.lower("j.dry_run") == "true", F.lit(False)).alias("dry_run"), F.coalesce(F.try_to_number("j.findings", F.lit("999999999999")), F.lit(0)).cast("long").alias("findings"), F.col("j.detect_ms").alias("ms"))
    return rows.where(F.rlike("ms", F.lit("^[0-9]{1,18}$"))).select("dry_run", "findings", F.col("ms").cast("long").alias("detect_ms"))


def partial_metrics(scans: DataFrame, *by: str, bounds: list[int] = BOUNDS_MS) -> DataFrame:
    """Counts and sums of scans by group that merge_metrics() can add up: scans, findings, sum_ms, least_ms, most_ms, buckets."""
    over = [F.count_if((F.col("detect_ms") > low) & (F.col("detect_ms") <= high)) for low, high in zip(bounds, bounds[1:])]
    buckets = F.array(F.count_if(F.col("detect_ms") <= bounds[0]), *over, F.count_if(F.col("detect_ms") > bounds[-1]))
    return scans.groupBy(*by).agg(F.count(F.lit(1)).alias("scans"), F.sum("findings").alias("findings"), F.sum("detect_ms").alias("sum_ms"), F.min("detect_ms").alias("least_ms"), F.max("detect_ms").alias("most_ms"), buckets.alias("buckets"))


def merge_metrics(parts: DataFrame, *by: str, bounds: list[int] = BOUNDS_MS) -> DataFrame:
    """Partial metrics of any number of batches as one; the order does not matter."""
    buckets = F.array(*[F.sum(F.get("buckets", F.lit(i))) for i in range(len(bounds) + 1)])
    return parts.groupBy(*by).agg(F.sum("scans").alias("scans"), F.sum("findings").alias("findings"), F.sum("sum_ms").alias("sum_ms"), F.min("least_ms").alias("least_ms"), F.max("most_ms").alias("most_ms"), buckets.alias("buckets"))


def faithfulness(narratives: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(id, provider, numbers_checked, urns_checked, violations, faithful) of narratives (id, provider, facts, prose).

    A figure of the prose that the facts don't hold is a violation, and so is a URN that no entity (urn) has. Without
    entities no URN is checked, and the count says so. violations: (kind, token), figures first, each token once.
    """
    from ..functions.text import numbers_in, urns_in

    urns = urns_in("prose") if entities is not None else F.array().cast("array<string>")
    rows = narratives.select("id", "provider", numbers_in("prose").alias("said"), numbers_in("facts").alias("held"), urns.alias("urns"))
    invented = F.array_sort(F.array_except("said", "held"))
    figure = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    told = rows.withColumn("figures", F.transform(invented, lambda x: F.struct(F.lit("number").alias("kind"), figure(x).alias("token"))))
    if entities is None:
        told = told.withColumn("lost", F.array().cast("array<struct<kind:string,token:string>>"))
    else:
        asked = rows.select("id", F.explode(F.array_distinct("urns")).alias("urn"))
        gone = asked.join(entities.select("urn").distinct(), "urn", "left_anti").groupBy("id").agg(F.array_sort(F.collect_set(F.struct(F.lit("urn").alias("kind"), F.col("urn").alias("token")))).alias("lost"))
        told = told.join(gone, "id", "left").withColumn("lost", F.coalesce("lost", F.array().cast("array<struct<kind:string,token:string>>")))
    told = told.withColumn("violations", F.concat("figures", "lost"))
    return told.select("id", "provider", F.size("said").alias("numbers_checked"), F.size("urns").alias("urns_checked"), "violations", (F.size("violations") == 0).alias("faithful"))


def faithfulness_rates(checks: DataFrame) -> DataFrame:
    """(provider, narratives, numbers_checked, urns_checked, violations, rate): a row for each provider and one, `all`, for all.

    The rate is the share of faithful narratives; where none was checked it is null and not one.
    """
    over = [F.count("faithful").alias("narratives"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("numbers_checked", "urns_checked")], F.coalesce(F.sum(F.size("violations")), F.lit(0)).alias("violations"), F.try_divide(F.count_if("faithful"), F.count("faithful")).alias("rate")]
    return checks.groupBy("provider").agg(*over).unionByName(checks.agg(*over).withColumn("provider", F.lit("all")))


def trial_summary(trials: DataFrame) -> DataFrame:
    """Per family of trials (family, settled, boundary, expected, observed): counts; unsettled ones count apart."""
    ok = F.col("settled")
    return trials.groupBy("family").agg(
        F.count_if(ok).alias("trials"), F.count_if(~ok).alias("unsettled"), F.count_if(ok & F.col("boundary")).alias("boundaries"),
        F.count_if(ok & F.col("expected") & F.col("observed")).alias("tp"), F.count_if(ok & ~F.col("expected") & F.col("observed")).alias("fp"),
        (F.count_if(ok & F.col("expected")) * F.count_if(ok & ~F.col("expected")) > 0).alias("could_fail"),
    )


def rerun_duplicates(first: DataFrame, second: DataFrame) -> DataFrame:
    """(resource_urn, before, after, duplicates): incidents on a resource after each of two runs."""
    a = first.groupBy("resource_urn").agg(F.count(F.lit(1)).alias("before"))
    b = second.groupBy("resource_urn").agg(F.count(F.lit(1)).alias("after"))
    rows = a.join(b, "resource_urn", "full_outer").na.fill(0, ["before", "after"])
    return rows.withColumn("duplicates", F.col("after") - F.col("before"))
