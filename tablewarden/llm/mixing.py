"""Mixing sources to target weights with Pfair windows and earliest deadline first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, save, stage_of, two_level_rank, unpacked

#: Slots of a frame: target weights are whole numbers of blocks out of so many.
FRAME = 240
#: Sources that are scheduled by themselves; the lighter ones beyond them are scheduled as one, see bundled().
ALONE = 120
#: Documents of a block.
BLOCK = 32
#: Most rows of places that are broadcast to the documents.
BROADCAST_ROWS = 400_000


def quantised_shares(sizes: DataFrame, frame: int = FRAME) -> DataFrame:
    """(source, n, share): whole shares that sum to the frame, by largest remainder, each at least 1.

    Targets of 0 get the smallest share. `sizes` (source, n, raw) has ALONE + 1 rows at most, raw being the target.
    """
    every = Window.partitionBy(F.lit(0))
    table = sizes.withColumn("s", F.count(F.lit(1)).over(every))
    table = table.withColumn("exact", F.when(F.sum("raw").over(every) > 0, F.col("raw") / F.sum("raw").over(every)).otherwise(0.0) * (F.lit(frame) - F.col("s")))
    table = table.withColumn("low", F.floor("exact"))
    left = F.lit(frame) - F.col("s") - F.sum("low").over(every)
    rank = F.row_number().over(every.orderBy(F.desc(F.col("exact") - F.col("low")), "source"))
    table = table.withColumn("rank", rank).withColumn("left", left)
    return table.select("source", "n", (1 + F.col("low") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("long").alias("share"))


def frame_orders(shares: DataFrame) -> DataFrame:
    """(phase, source, r, rank): the order of blocks in a frame, for each set of sources that are not used up.

    Block r of a source with share a of a frame of D slots has the Pfair window [floor(r D / a), ceil((r + 1) D / a)).
    One slot after the other takes the released block with the earliest deadline. In phase p the p sources that
    end first have ended, and D is the sum of the other shares.
    """
    table = shares.withColumn("frames", F.ceil(F.col("n") / F.col("share")).cast("long"))
    lives = table.agg(F.sort_array(F.collect_list(F.struct("source", "share", "frames"))).alias("all"), F.array_distinct(F.sort_array(F.collect_list("frames"))).alias("ends"))
    phases = lives.select("all", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "ends")).alias("phase", "begin")).withColumn("act", F.expr("filter(all, x -> x.frames > begin)")).where("size(act) > 0")
    phases = phases.withColumn("d", F.expr("aggregate(act, 0L, (s, x) -> s + x.share)"))
    step = """
        transform(array(array_min(transform(s.k, (k, i) -> struct(
            if(k < act[i].share and floor(k * d / act[i].share) <= t, ceil((k + 1) * d / act[i].share), 1000000000L) as due, i as i)))),
          pick -> named_struct(
            'k', transform(s.k, (k, i) -> if(i = pick.i, k + 1, k)),
            'out', concat(s.out, array(named_struct('source', act[pick.i].source, 'r', s.k[pick.i], 'rank', t)))))[0]
    """
    start = "named_struct('k', transform(act, x -> 0L), 'out', cast(array() as array<struct<source:string,r:bigint,rank:bigint>>))"
    orders = phases.select("begin", F.expr(f"aggregate(sequence(0L, d - 1), {start}, (s, t) -> {step}, s -> s.out)").alias("out"))
    return orders.select("begin", F.explode("out").alias("e")).select("begin", "e.*")


def targets(sizes: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """Add raw: the weight of a source, or without weights the square root of its documents; 0 for sources without one."""
    if weights is None:
        return sizes.withColumn("raw", F.sqrt("rows"))
    named = {"null" if k is None else f"={k}": float(v) for k, v in weights.items()}
    return sizes.withColumn("raw", F.coalesce(*[F.when(F.col("source") == k, F.lit(v)) for k, v in named.items()], F.lit(0.0)))


def bundled(ids: DataFrame, sizes: DataFrame, alone: int, rows: int) -> DataFrame:
    """ids (rid, doc_id, src) with group, and the place of a row in its group.

    The `alone` heaviest sources are groups of their own. All others are one group, whose rows are ordered by virtual
    time: row r of a source of weight w comes at (r + 1/2) / w, so the group's sources share it by their weights,
    however many they are; those of weight 0 share it by their rows.
    """
    heavy = sizes.orderBy(F.desc("raw"), "source").limit(alone).select(F.col("source").alias("src"), F.lit(True).alias("heavy"))
    known = ids.join(F.broadcast(heavy), "src", "left")
    first = two_level_rank(known.select("rid", "src", "doc_id", "heavy"), ["src"], [F.col("doc_id"), F.col("rid")], F.xxhash64("doc_id"), rows, "place")
    own = first.where("heavy").select("rid", F.col("src").alias("group"), "place")
    rate = sizes.select(F.col("source").alias("src"), F.when(F.col("raw") > 0, F.col("raw")).otherwise(F.col("rows") * 1e-9).alias("rate"), "rows")
    light = first.where("heavy is null").join(rate, "src").withColumn("time", (F.col("place") + 0.5) / F.col("rate")).drop("place")
    light = save(light.select("rid", "src", "doc_id", "time"), "light")
    # buckets of rank follow the time, cut at its quantiles, so that one slow source does not crowd the others, and
    # evenly between two of them
    wanted = max(1, -(-rows // 10_000))
    parts = min(1000, wanted)
    each = -(-wanted // parts)
    cuts = light.agg(F.percentile_approx("time", [k / parts for k in range(1, parts)] or [0.5], 10_000).alias("cuts"))
    light = light.crossJoin(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("time"))))  # one row
    low, high = F.coalesce(F.get("cuts", F.col("part") - 1), F.lit(0.0)), F.get("cuts", F.col("part"))
    within = F.when(high.isNull(), 1 - low / F.col("time")).when(high > low, (F.col("time") - low) / (high - low)).otherwise(0.0)
    light = light.withColumn("step", F.col("part") * each + F.least(F.lit(each - 1), F.floor(within * each))).drop("cuts", "part")
    rest = two_level_rank(light, [], [F.col("time"), F.col("src"), F.col("rid")], None, rows, "place", bucket="step")
    return own.unionByName(rest.select("rid", F.lit("rest").alias("group"), "place"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, frame: int = FRAME, source: str = "source", doc_id: str = "doc_id", alone: int = ALONE) -> DataFrame:
    """Add mix_block, mix_slot and mix_row: the interleaving of sources by target weight.

    Documents of a source form blocks of `block` rows in hashed order. In each frame a source with share a of D
    schedules a blocks by Pfair windows and earliest deadline first, so after any number of slots it is less than
    one block from its target. A source that is used up leaves the frames after; the rest go on by their own
    weights. Every row is kept, and ordering by (mix_slot, mix_row) gives the mix; a slot whose source ended within
    the frame stays empty. A null source is a source of its own, null ids come first, rows that tie keep any order.
    Sources beyond the `alone` heaviest are scheduled as one that holds them all, interleaved by virtual time inside
    (see bundled()), so any number of sources is mixed; for these the bound of one block holds for the whole they form.
    The schedule has at most alone + 1 sources and is all that is broadcast. Columns of docs pass through whatever
    their names, but for mix_block, mix_slot and mix_row, which would clash and are an error.
    """
    if taken := {"mix_block", "mix_slot", "mix_row"} & set(docs.columns):
        raise ValueError(f"the result has columns of its own named {sorted(taken)}")
    named = docs.select(packed(docs).alias("d"), F.col(doc_id).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")).alias("src"))
    named = save(named.withColumn("rid", F.monotonically_increasing_id()), "mix")
    sizes = targets(named.groupBy(F.col("src").alias("source")).agg(F.count(F.lit(1)).alias("rows")), weights)
    sizes = save(sizes, "sources")
    found = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    if found[0] <= alone + 1:
        ranked = two_level_rank(named, ["src"], [F.col("doc_id"), F.col("rid")], F.xxhash64("doc_id"), found[2], "place").withColumnRenamed("src", "group")
        grouped = sizes.withColumnRenamed("source", "group")
    else:
        ranked = save(bundled(named.select("rid", "doc_id", "src"), sizes, alone, found[1]), "ranked")
        heavy = sizes.orderBy(F.desc("raw"), "source").limit(alone)
        light = sizes.join(F.broadcast(heavy.select("source")), "source", "left_anti").agg(F.lit("rest").alias("group"), F.sum("rows").alias("rows"), F.sum("raw").alias("raw"))
        grouped = heavy.select(F.col("source").alias("group"), "rows", "raw").unionByName(light)
        ranked = named.select("rid", "d").join(ranked, "rid")
    grouped = grouped.select(F.col("group").alias("source"), F.ceil(F.col("rows") / F.lit(block)).cast("long").alias("n"), "raw")
    shares = save(quantised_shares(grouped, frame), "shares")
    orders = save(frame_orders(shares), "orders")
    ranked = ranked.join(F.broadcast(shares.select(F.col("source").alias("group"), "share")), "group")
    ranked = ranked.withColumn("mix_block", F.floor(F.col("place") / block)).withColumn("mix_row", F.col("place") % block)
    ranked = ranked.withColumn("frame", F.floor(F.col("mix_block") / F.col("share"))).withColumn("r", F.col("mix_block") % F.col("share"))
    life = shares.agg(F.collect_list(F.struct(F.col("share").alias("a"), F.ceil(F.col("n") / F.col("share")).cast("long").alias("f"))).alias("lives"))
    ranked = ranked.crossJoin(F.broadcast(life))  # one row
    ranked = ranked.withColumn("begin", F.expr("array_max(transform(lives, x -> if(x.f <= frame, x.f, 0L)))"))
    ranked = ranked.withColumn("start", F.expr("aggregate(lives, 0L, (s, x) -> s + x.a * least(frame, x.f))"))
    # (alone + 1) phases of `frame` slots at most
    joined = ranked.join(F.broadcast(orders.withColumnRenamed("source", "group")), ["begin", "group", "r"])
    return joined.select(*unpacked(docs, "d"), "mix_block", (F.col("start") + F.col("rank")).alias("mix_slot"), "mix_row")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix_sources(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_row")


@stage_of
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix: files hold ranges of slots, rows lie in order.

    Only ids and sources are scheduled; texts move once, to their range. Rows of equal id and text share a place.
    """
    ids = docs.select("doc_id", "source", F.xxhash64("text").alias("tkey"), F.xxhash64("doc_id").alias("ikey"))
    places = mix_sources(ids).groupBy("ikey", "tkey").agg(F.min(F.col("mix_slot") * BLOCK + F.col("mix_row")).alias("place"))
    places = save(places, "places")
    places = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
    rows = docs.select(packed(docs).alias("d"), F.xxhash64("text").alias("tkey"), F.xxhash64("doc_id").alias("ikey"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.join(places, ["ikey", "tkey"]).repartitionByRange(parts, "place").sortWithinPartitions("place").select(*unpacked(docs, "d"))
