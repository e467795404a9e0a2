"""Message streams into series: specifications from the graph, payload decoding, fan-out and last-write-wins batches.

The source is anything with ``topic`` and ``payload`` (and optionally ``arrived``) columns, so brokers Spark can read
plug in unchanged. There is no watermark: samples are accepted whatever their time, and a later write wins.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import parsed_time
from ..operators.series import SeriesStore
from ..vocab import Vocabulary


def specifications(triples: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``point_uri, ref, broker, port, topic, time_key, value_key`` of stream references; those without a topic are left out."""
    t = triples
    refs = t.where(F.col("p") == vocab.external_reference).select(F.col("s").alias("point_uri"), F.col("o").alias("ref"))
    out = refs.join(t.where((F.col("p") == vocab.type) & (F.col("o") == vocab.term("MQTTReference"))).select(F.col("s").alias("ref")), "ref", "left_semi")
    for name, alias in (("Broker", "broker"), ("Port", "port"), ("Topic", "topic"), ("time_key", "time_key"), ("value_key", "value_key")):
        own = t.where(F.col("p") == vocab.term(name)).groupBy(F.col("s").alias("ref")).agg(F.min("o").alias(alias))
        out = out.join(own, "ref", "left")
    text = lambda c, d: F.coalesce(F.nullif(F.btrim(c, F.lit('" ')), F.lit("")), F.lit(d))
    return out.where(F.btrim("topic", F.lit('" ')) != "").select("point_uri", "ref", text("broker", "localhost").alias("broker"), text("port", "1883").cast("int").alias("port"), F.btrim("topic", F.lit('" ')).alias("topic"), text("time_key", "Timestamp").alias("time_key"), text("value_key", "Value").alias("value_key"))


@F.udf(T.MapType(T.StringType(), T.StringType()), useArrow=True)
def _literal(payload: str | None) -> dict | None:
    try:
        found = ast.literal_eval(payload)
    except (ValueError, SyntaxError, TypeError):
        return None
    return {str(k): None if v is None else str(v) for k, v in found.items()} if isinstance(found, dict) else None


def with_payload(messages: DataFrame, payload: str = "payload", out: str = "_map", literals: bool = True) -> DataFrame:
    """``messages`` with each payload as a map, null if it can't be read.

    JSON objects are read in the JVM. Only rows that aren't JSON go to Python, in a branch of their own.
    """
    json = F.from_json(payload, "map<string,string>")
    known = messages.withColumn(out, json)
    if not literals:
        return known
    return known.where(F.col(out).isNotNull()).unionByName(messages.where(json.isNull()).withColumn(out, _literal(F.col(payload))))


def samples(messages: DataFrame, specs: DataFrame, literals: bool = True) -> tuple[DataFrame, DataFrame]:
    """``point_uri, ts, value`` of every message for every point on its topic, and the messages that can't be decoded."""
    arrived = F.col("arrived") if "arrived" in messages.columns else F.current_timestamp()
    known = with_payload(messages.withColumn("_at", arrived), "payload", "_map", literals)
    good = known.where(F.col("_map").isNotNull()).join(specs.select("topic", "point_uri", "time_key", "value_key"), "topic")
    at = F.element_at("_map", F.col("time_key"))
    return good.select("point_uri", F.when(at.isNull(), F.col("_at")).otherwise(parsed_time(at)).alias("ts"), F.element_at("_map", F.col("value_key")).alias("value")).where("ts is not null"), known.where(F.col("_map").isNull()).select("topic", "payload")


def start(messages: DataFrame, specs: DataFrame, series: SeriesStore, checkpoint: str, dead_letters: str | None = None, trigger: dict | None = None):
    """Run the stream: each micro-batch is merged into the series, undecodable messages go to ``dead_letters``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        good, bad = samples(batch, specs)
        series.merge(good)
        if dead_letters:
            bad.withColumn("batch", F.lit(batch_id)).write.mode("append").json(dead_letters)
        batch.unpersist()

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def complete_rows(stream: DataFrame, points: list[str], watermark: str = "1 hour") -> DataFrame:
    """One row for each time at which all points have reported, as wide columns."""
    cols = [F.max(F.when(F.col("point_uri") == p, F.col("value"))).alias(p) for p in points]
    rows = stream.withWatermark("ts", watermark) if stream.isStreaming else stream
    return rows.where(F.col("point_uri").isin(points)).groupBy("ts").agg(*cols).where(" and ".join(f"`{p}` is not null" for p in points))
