"""State that a stream keeps in files: hash buckets, small additions, and a pointer that names what is valid."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """Small texts and folders of a shared store, by the store's own client."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def stamp(self, folder: str) -> tuple:
        """Names, sizes and times of all files under a folder."""
        where, found = self.path(folder), []
        if self.fs.exists(where):
            every = self.fs.listFiles(where, True)
            while every.hasNext():
                s = every.next()
                found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return tuple(sorted(found))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The whole text under a new name, or nothing: written aside, then renamed."""
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(aside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.rename(self.path(aside), self.path(name)):
            self.fs.delete(self.path(aside), False)
            raise OSError(f"{name} is there already")

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class KeyedState:
    """Rows of which the one with the greatest `order` counts for each key, kept under a root folder.

    A batch adds one part to each bucket that it touches: what is written follows the batch. A bucket of MOST_PARTS
    parts is merged into one, so a row is rewritten once in MOST_PARTS batches of its bucket at most, and only buckets
    that the batch touches are. `pointer-N` lists the parts that are valid after batch N and is published last and
    atomically. A restart goes on from the greatest N; a batch that is delivered again adds nothing, and parts of a
    batch that failed are never listed. Older pointers than the one before the last, and what only they list, are dropped.
    """

    BUCKETS, MOST_PARTS = 64, 8

    def __init__(self, spark: SparkSession, root: str, schema, keys: list[str], order: str, buckets: int = BUCKETS, most_parts: int = MOST_PARTS) -> None:
        self.spark, self.root, self.schema, self.keys, self.order, self.buckets, self.most_parts = spark, root.rstrip("/"), schema, keys, order, buckets, most_parts
        self.files = Files(spark, root)

    def _numbers(self) -> list[int]:
        names = self.files.names(f"{self.root}/pointers")
        return sorted(int(n.removeprefix("pointer-")) for n in names if n.startswith("pointer-") and n.removeprefix("pointer-").isdigit())

    def pointer(self) -> dict:
        """{"epoch": last batch, "buckets": number, "parts": {bucket: [folders]}}; epoch -1 before the first batch."""
        numbers = self._numbers()
        return json.loads(self.files.read(f"{self.root}/pointers/pointer-{numbers[-1]}")) if numbers else {"epoch": -1, "buckets": self.buckets, "parts": {}}

    def _latest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in self.schema.names if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), self.order).alias("r")).select(*self.keys, "r.*").select(*self.schema.names)

    def _read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """The row of each key as the last published pointer has it."""
        return self._latest(self._read([p for parts in self.pointer()["parts"].values() for p in parts]))

    def merge(self, batch: DataFrame, epoch: int) -> None:
        """Take in the rows of a batch; its number tells whether it has been taken in before."""
        held = self.pointer()
        if epoch <= held["epoch"]:
            return
        bucket: Column = F.pmod(F.xxhash64(*self.keys), F.lit(held["buckets"]))
        added = f"{self.root}/data/{epoch}-{uuid.uuid4().hex}"
        self._latest(batch).withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(added)
        parts = {k: list(v) for k, v in held["parts"].items()}
        touched = [n.removeprefix("_bucket=") for n in self.files.names(added) if n.startswith("_bucket=")]
        for b in touched:
            parts.setdefault(b, []).append(f"{added}/_bucket={b}")
        full = [b for b in touched if len(parts[b]) >= self.most_parts]
        if full:
            whole = f"{self.root}/data/{epoch}-{uuid.uuid4().hex}"
            named = [self._read(parts[b]).withColumn("_bucket", F.lit(int(b))) for b in full]
            last = reduce(DataFrame.unionByName, named)
            others = [c for c in self.schema.names if c not in self.keys]
            last = last.groupBy("_bucket", *self.keys).agg(F.max_by(F.struct(*others), self.order).alias("r")).select("_bucket", *self.keys, "r.*")
            last.repartition("_bucket").write.partitionBy("_bucket").parquet(whole)
            parts |= {b: [f"{whole}/_bucket={b}"] for b in full}
        self.files.publish(f"{self.root}/pointers/pointer-{epoch}", json.dumps({"epoch": epoch, "buckets": held["buckets"], "parts": parts}))
        self._tidy()

    def add(self, rows: DataFrame) -> None:
        """Take in rows as the batch after the last one."""
        self.merge(rows, self.pointer()["epoch"] + 1)

    def _tidy(self) -> None:
        """Readers of the last two pointers keep their parts."""
        numbers = self._numbers()
        read = lambda n: {p for parts in json.loads(self.files.read(f"{self.root}/pointers/pointer-{n}"))["parts"].values() for p in parts}
        if len(numbers) > 2:
            kept = read(numbers[-1]) | read(numbers[-2])
            for n in numbers[:-2]:
                for part in read(n) - kept:
                    self.files.drop(part)
                self.files.drop(f"{self.root}/pointers/pointer-{n}")
