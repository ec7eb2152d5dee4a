"""Alerts over streams: from scored rows to the outbox, and throttling of ready signal rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from packetloom.operators.alerts import COOLDOWN_SECONDS, LISTED_SOURCES, MIN_ATTACKS, outbox, should_emit
from packetloom.session import remove_path
from packetloom.streaming.sinks import write_batch

SIGNAL_SCHEMA = T.StructType(
    [
        T.StructField("tenant", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("now", T.DoubleType()),
        T.StructField("attacks", T.LongType()),
        T.StructField("anomalies", T.LongType()),
        T.StructField("worst_score", T.DoubleType()),
        T.StructField("worst_src", T.StringType()),
    ]
)
THROTTLED_SCHEMA = T.StructType(
    SIGNAL_SCHEMA.fields + [T.StructField("alert_no", T.LongType()), T.StructField("emits", T.BooleanType())]
)
STATE_SCHEMA = T.StructType(
    [
        T.StructField("alert_no", T.LongType()),
        T.StructField("last", T.DoubleType()),
        T.StructField("attacks", T.LongType()),
        T.StructField("anomalies", T.LongType()),
    ]
)


class Throttle(StatefulProcessor):
    """Counters of one tenant: number of the pending alert, last send time, pending signals."""

    def __init__(self, cooldown: float, min_attacks: int):
        self.cooldown, self.min_attacks = cooldown, min_attacks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pending", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, last, attacks, anomalies = self.state.get() if self.state.exists() else (1, 0.0, 0, 0)
        batch = pd.concat(list(rows)).sort_values(["now", "batch_id"], ignore_index=True)
        numbers, emits = [], []
        for now, more_attacks, more_anomalies in zip(batch["now"], batch["attacks"], batch["anomalies"]):
            attacks, anomalies = attacks + max(int(more_attacks), 0), anomalies + int(more_anomalies)
            emit = should_emit((attacks, anomalies), now, last, self.cooldown, self.min_attacks)
            numbers.append(number)
            emits.append(emit)
            if emit:
                number, last, attacks, anomalies = number + 1, float(now), 0, 0
        self.state.update((number, last, attacks, anomalies))
        yield batch.assign(alert_no=numbers, emits=emits)[THROTTLED_SCHEMA.names]

    def close(self) -> None:
        pass


def stream_throttle(
    signals: DataFrame, cooldown: float = COOLDOWN_SECONDS, min_attacks: int = MIN_ATTACKS
) -> DataFrame:
    """``throttle`` over a stream: one small row per tenant and batch goes in and comes out."""
    return signals.groupBy("tenant").transformWithStateInPandas(
        statefulProcessor=Throttle(cooldown, min_attacks),
        outputStructType=THROTTLED_SCHEMA,
        outputMode="Append",
        timeMode="None",
    )


EVENT_SIGNALS = ["tenant", "now", "seq", "src_ip", "is_attack", "is_anomaly", "score"]
_PENDING = "tenant string, alert_no long, last double, attacks long, anomalies long, worst_score double, worst_src string"
_SOURCES = "tenant string, src_ip string"


def signals(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Scored events (tenant, now, seq, src_ip, is_attack) and scored windows (tenant, now, seq, src_ip, is_anomaly,
    anomaly_score) as one stream of what can raise an alert."""
    no = F.lit(False)
    flows = events.select("tenant", "now", "seq", "src_ip", "is_attack", no.alias("is_anomaly"), F.lit(0.0).alias("score"))
    scored = windows.select("tenant", "now", "seq", "src_ip", no.alias("is_attack"), "is_anomaly", F.col("anomaly_score").alias("score"))
    return flows.unionByName(scored)


def live_alerts(
    stream: DataFrame,
    checkpoint: str,
    outbox_path: str,
    carry_path: str,
    kinds: list[str] | None = None,
    cooldown: float = COOLDOWN_SECONDS,
    min_attacks: int = MIN_ATTACKS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the outbox rows of every alert that a micro-batch of ``signals`` makes due.

    What is pending (one row per tenant, and its distinct sources) is carried from batch to batch in tables; a
    replayed batch reads the carry of the batch before it again and replaces its own output.  Older carries go.
    """
    spark = stream.sparkSession

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        old, old_sources = (
            spark.read.schema(schema).parquet(f"{carry_path}/{name}/batch_id={batch_id - 1}")
            if batch_id
            else spark.createDataFrame([], schema)
            for name, schema in (("pending", _PENDING), ("sources", _SOURCES))
        )
        batch = batch.persist()
        named = F.col("is_attack") | F.col("is_anomaly")
        fresh = batch.where(named & (F.col("src_ip") != "")).select("tenant", "src_ip")
        sources = old_sources.unionByName(fresh).distinct()
        worst = F.when(F.col("is_anomaly") & (F.col("score") > 0), F.struct("score", -F.col("seq")))
        new = batch.groupBy("tenant").agg(
            F.max("now").alias("now"),
            F.count_if("is_attack").alias("more_attacks"),
            F.count_if("is_anomaly").alias("more_anomalies"),
            F.max(F.when(F.col("is_anomaly"), F.col("score"))).alias("more_score"),
            F.max_by("src_ip", worst).alias("more_src"),
        )
        both = old.join(new, "tenant", "full")
        zero = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        higher = F.coalesce(F.col("more_score"), F.lit(0.0)) > F.coalesce(F.col("worst_score"), F.lit(0.0))
        total = both.select(
            "tenant",
            F.coalesce("alert_no", F.lit(1)).cast("long").alias("alert_no"),
            F.coalesce("last", F.lit(0.0)).alias("last"),
            "now",
            zero(F.col("attacks"), F.col("more_attacks")).cast("long").alias("attacks"),
            zero(F.col("anomalies"), F.col("more_anomalies")).cast("long").alias("anomalies"),
            F.when(higher, F.col("more_score")).otherwise(F.coalesce("worst_score", F.lit(0.0))).alias("worst_score"),
            F.when(higher, F.col("more_src")).otherwise(F.col("worst_src")).alias("worst_src"),
        )
        due = F.col("now").isNotNull() & ((F.col("anomalies") > 0) | (F.col("attacks") >= min_attacks))
        due = due & (F.col("now") - F.col("last") >= cooldown)
        total = total.withColumn("emits", due).persist()
        emitted = total.where("emits")
        of_due = sources.join(emitted.select("tenant"), "tenant", "left_semi")
        rank = F.row_number().over(Window.partitionBy("tenant").orderBy("src_ip"))
        first = of_due.withColumn("r", rank).where(F.col("r") <= LISTED_SOURCES)
        listed = first.groupBy("tenant").agg(F.array_sort(F.collect_list("src_ip")).alias("listed"))
        counts = of_due.groupBy("tenant").agg(F.count(F.lit(1)).alias("n_sources"))
        rows = emitted.join(listed, "tenant", "left").join(counts, "tenant", "left").withColumns(
            {
                "n_sources": F.coalesce("n_sources", F.lit(0)),
                "listed": F.coalesce("listed", F.array().cast("array<string>")),
            }
        )
        write_batch(outbox(rows, kinds), outbox_path, batch_id)
        kept = lambda c, empty: F.when(F.col("emits"), empty).otherwise(F.col(c)).alias(c)
        pending = total.select(
            "tenant",
            (F.col("alert_no") + F.col("emits").cast("long")).alias("alert_no"),
            F.when(F.col("emits"), F.col("now")).otherwise(F.col("last")).alias("last"),
            kept("attacks", F.lit(0).cast("long")),
            kept("anomalies", F.lit(0).cast("long")),
            kept("worst_score", F.lit(0.0)),
            kept("worst_src", F.lit(None).cast("string")),
        )
        write_batch(pending, f"{carry_path}/pending", batch_id)
        write_batch(sources.join(emitted.select("tenant"), "tenant", "left_anti"), f"{carry_path}/sources", batch_id)
        for name in ("pending", "sources"):
            remove_path(spark, f"{carry_path}/{name}/batch_id={batch_id - 2}")
        total.unpersist()
        batch.unpersist()

    writer = stream.select(*EVENT_SIGNALS).writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
