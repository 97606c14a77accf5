"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one window partition of two_level_rank() holds, about.
RANK_ROWS = 10_000
#: Edges that one task contracts without a shuffle; more are shuffled.
ONE_TASK_EDGES = 50_000


#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a local session (one process) gets a folder of its own; on a cluster that would lose data, so
    there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _own.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="tablewarden-")
        _own[spark.sparkContext.applicationId] = found
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    for made in _running:
        made.append(out)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete saved tables that nothing reads any more."""
    for table in tables:
        if table is not None and (path := getattr(table, "saved_at", None)):
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Lists of the tables that the stages that run now have saved, and those that an ended stage left for the reader of its result.
_running: list[list[DataFrame]] = []
_left: list[DataFrame] = []


def stage_of(f):
    """A stage of a pipeline, whose result is written before the next stage begins.

    What a stage saves for itself is read until its result is written, so it is deleted when the next stage of the
    application begins; what that one's own docs read stays.
    """

    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left:
            read = "\n".join(docs.inputFiles())
            discard(*[t for t in _left if t.saved_at.rpartition("/")[2] not in read])
            _left.clear()
        _running.append([])
        try:
            return f(spark, docs, sf_dir)
        finally:
            _left.extend(_running.pop())

    return stage


def quoted(column: str) -> str:
    """A column's name as one name, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def packed(docs: DataFrame) -> Column:
    """All columns as one struct, which keeps their names away from an operator's own."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def unpacked(docs: DataFrame, struct: str) -> list[Column]:
    """The columns of docs out of packed() under the name `struct`."""
    return [F.col(f"{struct}.{quoted(c)}").alias(c) for c in docs.columns]


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def two_level_rank(df: DataFrame, keys: list[str], order: list[Column], salt: Column | None, rows: int, name: str, bucket: str | None = None) -> DataFrame:
    """Add the 0-based, gapless rank of each row within its keys.

    Keys are dealt over hash buckets of `salt` (about RANK_ROWS rows each), ranked within each bucket, and moved by
    the count of the buckets before: no window sees a whole hot key. `rows` is the row count of `df`, which should
    be a saved table as it is read twice. Rows that tie in salt and order rank in any order. With `bucket`, a column,
    its values are the buckets, in their order.
    """
    buckets = max(1, -(-rows // RANK_ROWS))
    df = df.withColumn("_b", F.col(bucket) if bucket else F.pmod(salt, F.lit(buckets)).cast("int"))
    sizes = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    joined = ranked.join(starts, same(ranked, starts, [*keys, "_b"]), "left")
    return joined.select(*[ranked[c] for c in df.columns if c != "_b"], (F.col(name) - 1 + starts["_start"]).alias(name))


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """Smallest reachable node of each node that has an edge, from edges (a, b) of longs.

    Alternating large-star and small-star contractions: each round sends neighbours to the smallest one, so a hub's
    edges are replaced by edges to its label and the rounds grow as the logarithm of the longest chain. Up to
    ONE_TASK_EDGES edges, counted first, are contracted in one task, which spares their shuffles. Returns
    (node, component).
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, before = mark, now
        if mark[0] <= ONE_TASK_EDGES:
            now = now.coalesce(1)
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = now_large(both, low)
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low2, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        )
        now = save(small, "edges")
        discard(before)
    roots = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())


def now_large(both: DataFrame, low: DataFrame) -> DataFrame:
    """Large star: each larger neighbour of a node gets an edge to the node's smallest neighbour."""
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
