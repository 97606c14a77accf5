"""Structured Streaming jobs over the change log."""

from __future__ import annotations

import json
import os
import sys
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urn
from ..operators.steps import shared_dir
from ..sources import log
from ..sources.state import KeyedState

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now; what it wrote."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, "stream")
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def relink(events: DataFrame, links: DataFrame, columns: DataFrame) -> DataFrame:
    """Replays for whole writes of model properties that hold no features: (seq, model_urn, n_features, reason).

    A model with a recorded link gets the features of its table's current schema without the excluded columns; others
    a refusal. links: (model_urn, dataset_urn, excluded). Partial writes and other aspects are ignored.
    """
    hit = log.decode_change_events(events).where((F.col("entity_type") == "mlModel") & (F.col("aspect_name") == "mlModelProperties") & F.col("change_type").isin(*log.REPLACING))
    hit = hit.where(F.coalesce(F.try_element_at("aspect", F.lit("mlFeatures")), F.lit("")) == "").select("seq", F.col("entity_urn").alias("model_urn"))
    fields = links.join(columns.select("dataset_urn", "field_path"), "dataset_urn").where(~F.array_contains(F.split("excluded", ","), F.col("field_path")))
    ready = fields.groupBy("model_urn").agg(F.count(F.lit(1)).alias("n_features"))
    return hit.join(ready, "model_urn", "left").select("seq", "model_urn", F.coalesce("n_features", F.lit(0)).alias("n_features"), F.when(F.col("n_features").isNull(), "no recorded link").alias("reason"))


def touches(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Events about watched entities (target), column events counting for their table."""
    named = events.withColumn("target", F.explode(F.array_distinct(F.array_compact(F.array("entity_urn", urn.field_parent("entity_urn"))))))
    return named.join(targets, "target", "left_semi").select("seq", "target")


#: Times that a handler is tried on an event.
ATTEMPTS = 2
HANDLED = "seq long, sink string, result string, reason string"


def handled(events: DataFrame, handler: Callable[[dict], str | None], attempts: int = ATTEMPTS) -> DataFrame:
    """(seq, sink, result, reason): each event through a handler of its own call.

    handler takes an event (entity_type, entity_urn, aspect_name, change_type, aspect as a dict) and gives a text or
    null. An event that cannot be decoded, or whose handler fails `attempts` times, goes to the sink `dead` with the
    reason; the others go to `handled` with the result. No event stops the others.
    """
    ready = F.col("entity_urn").isNotNull() & F.col("aspect_name").isNotNull() & F.try_parse_json("aspect_json").isNotNull()
    rows = events.select("seq", "entity_type", "entity_urn", "aspect_name", "change_type", "aspect_json", F.coalesce(ready, F.lit(False)).alias("ready"))

    def one(row) -> tuple[str, str | None, str | None]:
        if not row.ready:
            missing = "no entity" if pd.isna(row.entity_urn) else "no aspect" if pd.isna(row.aspect_name) else "unreadable aspect"
            return "dead", None, missing
        event = {"seq": row.seq, "entity_type": row.entity_type, "entity_urn": row.entity_urn, "aspect_name": row.aspect_name, "change_type": row.change_type, "aspect": json.loads(row.aspect_json)}
        for left in reversed(range(attempts)):
            try:
                return "handled", handler(event), None
            except Exception as failure:  # whatever a handler raises concerns its event alone
                if not left:
                    return "dead", None, f"handler: {type(failure).__name__}"
        return "dead", None, "not tried"

    def each(batches):
        for batch in batches:
            out = [(row.seq, *one(row)) for row in batch.itertuples()]
            yield pd.DataFrame(out, columns=["seq", "sink", "result", "reason"])

    return rows.mapInPandas(each, HANDLED)


def isolate(stream: DataFrame, handler: Callable[[dict], str | None], root: str | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """Run a stream's events through a handler into two sinks, handled and dead; what both hold, with the batch.

    A batch is one write to `batch=N` with a folder for each sink, which takes the place of what an earlier attempt at
    the batch left: a batch that is delivered again after a failure is there once. Under the same root a later call goes on
    where the one before stopped.
    """
    spark, root = stream.sparkSession, root or scratch(stream.sparkSession, "letters")

    def write(batch: DataFrame, number: int) -> None:
        handled(batch, handler, attempts).write.mode("overwrite").partitionBy("sink").parquet(f"{root}/letters/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return letters(spark, root)


def letters(spark: SparkSession, root: str) -> DataFrame:
    """(seq, result, reason, batch, sink): what isolate() has written under a root."""
    return spark.read.schema("seq long, result string, reason string, batch long, sink string").option("basePath", f"{root}/letters").parquet(f"{root}/letters")


def once(events: DataFrame) -> DataFrame:
    """One event for each message id: redelivery is harmless."""
    return events.dropDuplicates(["message_id"])


def transitions(polls: DataFrame) -> DataFrame:
    """(target, seq, transition, write) of polls (target, seq, sig, muted); a null signature is clean.

    State per target: its last signature, and whether a write is owed. The first poll always writes; later ones write
    on a change. A muted poll writes nothing and owes its change to the next one that is not muted.
    """

    def step(key, batches, state):
        last, owed, begun = state.get if state.exists else (None, False, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, sig, muted in zip(rows["seq"], rows["sig"], rows["muted"]):
            sig = None if pd.isna(sig) else sig
            kind = ("clean" if sig is None else "detected") if not begun else "no change" if sig == last else "recovered" if sig is None else "changed" if last is not None else "detected"
            owed = owed or kind != "no change" or not begun
            out.append((key[0], seq, kind, owed and not muted))
            owed, last, begun = owed and bool(muted), sig, True
        state.update((last, owed, begun))
        yield pd.DataFrame(out, columns=["target", "seq", "transition", "write"])

    return polls.groupBy("target").applyInPandasWithState(step, "target long, seq long, transition string, write boolean", "last string, owed boolean, begun boolean", "append", "NoTimeout")


def latest_state(stream: DataFrame, root: str | None = None, **sizes: int) -> DataFrame:
    """The aspect snapshot (sources.log) of all that a stream has delivered so far, kept up to date batch by batch.

    Rows of deleted aspects stay in the state, so an older write that comes late does not bring them back. Under the same
    root a later call goes on where the one before stopped.
    """
    spark, root = stream.sparkSession, root or scratch(stream.sparkSession, "state")
    held = KeyedState(spark, root, stream.schema, ["entity_urn", "aspect_name"], "seq", **sizes)
    whole = F.col("entity_urn").isNotNull() & F.col("aspect_name").isNotNull() & F.col("change_type").isin(*log.REPLACING, "DELETE")
    query = stream.writeStream.foreachBatch(lambda batch, epoch: held.merge(batch.where(whole), epoch)).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return log.aspect_snapshot(held.rows())
