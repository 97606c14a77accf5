"""Balanced label propagation: documents move to the shards of their copies while every shard keeps its quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RANK_ROWS, save, two_level_rank

KEY = ["k1", "k2", "k3"]


def _unit(*cols: Column | str) -> Column:
    """A hash in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 20)) / F.lit(float(1 << 20))


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal documents to shards whose row counts differ by one at most, keeping equal texts together.

    Links join documents with equal texts, held as a star (document to text key), never as pairs. Each round counts
    the copies of a text by shard, names the fullest shards as the text's targets (as many as its copies need), and
    moves copies there; when more want to enter a shard than its quota leaves room for, a hashed fraction enters,
    whole texts at a time unless the text needs several shards. Rounds end when nobody wants to move. What still is
    above a quota, and all documents without a copy, fill the room that is left, so counts end exactly even.

    Null texts have size 8, checksum 0 and no links; empty texts are equal to each other. Null or repeated ids are
    rows of their own. An empty table gives an empty result. Returns doc_id, size, text_crc32, shard, slot.
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")
    crc = F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
    nodes = docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(text).alias("k1"), F.when(F.col(text).isNotNull(), crc).alias("k2"), size.alias("k3"))
    nodes = save(nodes.withColumn("rid", F.monotonically_increasing_id()), "nodes")
    rows = nodes.count()
    caps = [rows // shards + (j < rows % shards) for j in range(shards)]
    groups = nodes.where("k2 is not null").groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    linked = nodes.join(groups, KEY, "left").withColumn("shard", F.when(F.col("copies").isNotNull(), F.pmod(F.xxhash64("doc_id", "rid"), F.lit(shards)).cast("int")))
    base = save(linked, "linked")
    state = base.where("shard is not null")
    room = max(1, rows // shards)
    for turn in range(rounds):
        counts = state.groupBy(*KEY, "shard").agg(F.count(F.lit(1)).alias("n"), F.first("copies").alias("copies"))
        occupied = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        free = [max(0, caps[j] - occupied.get(j, 0)) for j in range(shards)]
        is_open = F.element_at(F.array(*[F.lit(f > 0) for f in free]), F.col("shard") + 1)
        # a text that fills shards already stays there: the fullest come first, full or not
        order = Window.partitionBy(*KEY).orderBy(F.desc(F.col("n") * F.when(is_open | (F.col("n") * 2 > room), 1).otherwise(0)), F.xxhash64(*KEY, "shard"))
        targets = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.ceil(F.col("copies") / F.lit(room))).groupBy(*KEY).agg(F.array_sort(F.collect_list("shard")).alias("targets"))
        wish = F.when(F.array_contains("targets", F.col("shard")), F.col("shard")).otherwise(F.element_at("targets", (F.pmod(F.xxhash64("rid", F.lit(turn)), F.size("targets")) + 1).cast("int")))
        moving = save(state.join(targets, KEY).withColumn("wish", wish), "moving")
        wants = {r["wish"]: r["n"] for r in moving.where("wish <> shard").groupBy("wish").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not wants:
            break
        share = F.element_at(F.array(*[F.lit(min(1.0, free[j] / max(1, wants.get(j, 0)))) for j in range(shards)]), F.col("wish") + 1)
        draw = F.when(F.size("targets") > 1, _unit("rid", F.lit(turn + 100))).otherwise(_unit(*KEY, F.lit(turn + 100)))
        state = moving.withColumn("shard", F.when(draw < share, F.col("wish")).otherwise(F.col("shard"))).drop("wish", "targets")
    state = save(state.select("rid", "doc_id", "size", "text_crc32", "shard", "copies", *KEY), "state")
    # copies of a text lie together, unless they are too many for one bucket
    salt = F.xxhash64(*KEY, F.when(F.col("copies") > RANK_ROWS, F.col("rid")))
    place = two_level_rank(state, ["shard"], [*KEY, F.col("rid")], salt, rows // shards, "slot")
    limit = F.element_at(F.array(*[F.lit(c) for c in caps]), F.col("shard") + 1)
    place = save(place.withColumn("kept", F.col("slot") < limit), "place")
    columns = ["doc_id", "size", "text_crc32", "rid"]
    rest = save(place.where("not kept").select(*columns).unionByName(base.where("shard is null").select(*columns)), "rest")
    held = {r["shard"]: r["n"] for r in place.where("kept").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for j in range(shards):
        starts.append(total)
        total += caps[j] - held.get(j, 0)
    filled = two_level_rank(rest, [], [F.col("rid")], F.xxhash64("rid"), total, "rank")
    ends = [*starts[1:], total]
    index = sum((F.when(F.col("rank") >= e, 1).otherwise(0) for e in ends), F.lit(0)).cast("int")
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("shard") + 1)
    filled = filled.withColumn("shard", index).withColumn("slot", (F.col("rank") - at(starts) + at([held.get(j, 0) for j in range(shards)])).cast("long"))
    out = ["doc_id", "size", "text_crc32", "shard", "slot"]
    return place.where("kept").select(*out).unionByName(filled.select(*out))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = shard_documents(docs)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
