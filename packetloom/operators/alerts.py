"""Throttled attack alerts.

Per micro-batch rows carry the signals; an alert is due when something is
pending and the cooldown has passed.  When alerts fire depends on counts only,
so the ordered pass sees one small row per tenant and batch; source addresses
are grouped afterwards, spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.rounding import round_ratio
from packetloom.operators.layout import small_side
from packetloom.session import materialize

# Throttle defaults, listed sources, channel kinds.
COOLDOWN_SECONDS = 60.0
MIN_ATTACKS = 5
LISTED_SOURCES = 3
CHANNEL_KINDS = ["ntfy", "discord", "slack", "generic", "email"]
TITLE = "Network attack alert"

BATCH_KEYS = ["tenant", "batch_id"]


def attack_inputs(events: DataFrame, sets: bool = False) -> DataFrame:
    """Per (tenant, batch): time, attack count and number of distinct attack sources.

    ``events``: tenant, batch_id, now (double), src_ip, is_attack.
    """
    attack = F.col("is_attack")
    source = F.when(attack & (F.col("src_ip") != ""), F.col("src_ip"))
    columns = [
        F.max("now").alias("now"),
        F.count_if(attack).alias("attacks"),
        F.count_distinct(source).alias("n_sources"),
    ]
    if sets:
        # For small batches only; the alert path itself never builds this set.
        columns.append(F.array_sort(F.collect_set(source)).alias("sources"))
    return events.groupBy(*BATCH_KEYS).agg(*columns)


def anomaly_inputs(scored: DataFrame) -> DataFrame:
    """Per (tenant, batch): anomaly count, worst score and its source.

    Among equal scores the earliest row wins; scores must exceed 0 to count as
    worst.  ``scored``: tenant, batch_id, now, seq, src_ip, anomaly_score.
    """
    positive = F.when(F.col("anomaly_score") > 0, F.col("anomaly_score"))
    order = F.when(F.col("anomaly_score") > 0, F.struct(F.col("anomaly_score"), -F.col("seq")))
    return scored.groupBy(*BATCH_KEYS).agg(
        F.max("now").alias("now"),
        F.count(F.lit(1)).alias("anomalies"),
        F.coalesce(F.max(positive), F.lit(0.0)).alias("worst_score"),
        F.max_by("src_ip", order).alias("worst_src"),
    )


def alert_batches(attacks: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row per tenant and batch with both kinds of signal."""
    joined = attacks.drop("sources").join(anomalies.withColumnRenamed("now", "now_a"), BATCH_KEYS, "full")
    return joined.select(
        *BATCH_KEYS,
        F.coalesce("now", "now_a").alias("now"),
        F.coalesce("attacks", F.lit(0)).cast("bigint").alias("attacks"),
        F.coalesce("anomalies", F.lit(0)).cast("bigint").alias("anomalies"),
        F.coalesce("worst_score", F.lit(0.0)).alias("worst_score"),
        "worst_src",
    )


def should_emit(pending: tuple[int, int], now: float, last: float, cooldown: float, min_attacks: int) -> bool:
    attacks, anomalies = pending
    return (anomalies > 0 or attacks >= min_attacks) and now - last >= cooldown


def throttle(
    batches: DataFrame,
    cooldown: float = COOLDOWN_SECONDS,
    min_attacks: int = MIN_ATTACKS,
    enabled: bool = True,
) -> DataFrame:
    """Add ``alert_no`` (the alert that a batch's signals belong to) and ``emits``.

    Batches after the last alert carry the number of an alert still pending.
    Rows stream through in (tenant, time) order; only counters are kept.
    Without a configured channel (``enabled=False``) nothing is ever emitted.
    """

    def follow(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant, alert, last, attacks, anomalies = None, 0, 0.0, 0, 0
        for batch in stream:
            numbers, emits = [], []
            columns = [batch.column(c).to_pylist() for c in ("tenant", "now", "attacks", "anomalies")]
            for who, now, more_attacks, more_anomalies in zip(*columns):
                if who != tenant:
                    tenant, alert, last, attacks, anomalies = who, 1, 0.0, 0, 0
                attacks, anomalies = attacks + max(more_attacks, 0), anomalies + more_anomalies
                emit = enabled and should_emit((attacks, anomalies), now, last, cooldown, min_attacks)
                numbers.append(alert)
                emits.append(emit)
                if emit:
                    alert, last, attacks, anomalies = alert + 1, now, 0, 0
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array(numbers, pa.int64()), pa.array(emits, pa.bool_())],
                names=batch.schema.names + ["alert_no", "emits"],
            )

    schema = batches.schema.add("alert_no", "long").add("emits", "boolean")
    ordered = batches.repartition("tenant").sortWithinPartitions("tenant", "now", "batch_id")
    return ordered.mapInArrow(follow, schema)


def alerts(throttled: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per emitted alert.

    ``sources``: tenant, batch_id, src_ip of every attack flow and anomaly.
    Distinct sources are counted and the first three picked after a shuffle by
    source, so an attack from very many addresses stays spread out.
    """
    keys = ["tenant", "alert_no"]
    throttled = materialize(throttled, "throttled")
    order = F.struct("worst_score", (-F.col("batch_id")).alias("b"))
    totals = throttled.groupBy(*keys).agg(
        F.max(F.when(F.col("emits"), F.col("now"))).alias("now"),
        F.sum("attacks").alias("attacks"),
        F.sum("anomalies").alias("anomalies"),
        F.max("worst_score").alias("worst_score"),
        F.max_by("worst_src", F.when(F.col("worst_score") > 0, order)).alias("worst_src"),
    )
    emitted = totals.where(F.col("now").isNotNull())
    numbers = small_side(throttled).select(*BATCH_KEYS, "alert_no")
    # Beyond the broadcast bound a shuffle join serves; adaptive execution splits its large batches.
    named = sources.where(F.col("src_ip") != "").distinct().join(numbers, BATCH_KEYS)
    distinct = named.select(*keys, "src_ip").distinct()
    counts = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sources"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("src_ip"))
    first = distinct.withColumn("r", rank).where(F.col("r") <= LISTED_SOURCES)
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list("src_ip")).alias("listed"))
    return (
        emitted.join(counts, keys, "left")
        .join(listed, keys, "left")
        .withColumns(
            {
                "n_sources": F.coalesce("n_sources", F.lit(0)),
                "listed": F.coalesce("listed", F.array().cast("array<string>")),
            }
        )
    )


def alert_message() -> Column:
    """Summary text over attacks, anomalies, worst_src, worst_score, listed, n_sources."""
    more = F.when(
        F.col("n_sources") > LISTED_SOURCES,
        F.concat(F.lit(" (+"), (F.col("n_sources") - LISTED_SOURCES).cast("string"), F.lit(" more)")),
    ).otherwise("")
    # Scores have four places; halves go to the even digit of the binary value.
    two_places = round_ratio(F.round(F.col("worst_score") * 10_000), F.lit(10_000), 2)
    worst = F.when(
        F.col("worst_src") != "",
        F.format_string(" (worst: %s score %.2f)", F.col("worst_src"), two_places),
    ).otherwise("")
    text = F.concat_ws(
        "; ",
        F.when(F.col("attacks") > 0, F.format_string("%d attack flows flagged", F.col("attacks"))),
        F.when(
            F.col("anomalies") > 0,
            F.concat(F.format_string("%d anomalous source-window(s)", F.col("anomalies")), F.coalesce(worst, F.lit(""))),
        ),
    )
    sources = F.concat(F.lit(" — sources: "), F.array_join("listed", ", "), more)
    return F.concat(text, F.when(F.size("listed") > 0, sources).otherwise(""))


def alert_payload(kind: str, title: str = TITLE) -> Column:
    """Body that a channel of this kind takes, from the column ``message``."""
    if kind not in CHANNEL_KINDS:
        raise ValueError(f"unknown kind {kind!r}; expected one of {CHANNEL_KINDS}")
    message = F.col("message")
    if kind == "ntfy" or kind == "email":
        return message
    if kind == "discord":
        return F.to_json(F.struct(F.concat(F.lit(f"**{title}**\n"), message).alias("content")))
    if kind == "slack":
        return F.to_json(F.struct(F.concat(F.lit(f"*{title}*\n"), message).alias("text")))
    return F.to_json(F.struct(F.lit(title).alias("title"), message.alias("message")))


def outbox(alert_rows: DataFrame, kinds: list[str] | None = None, title: str = TITLE) -> DataFrame:
    """One payload row per alert and channel; ``delivered`` is set by whoever sends it."""
    kinds = kinds or ["ntfy"]
    bodies = F.array(*[F.struct(F.lit(k).alias("kind"), alert_payload(k, title).alias("payload")) for k in kinds])
    texts = alert_rows.withColumn("message", alert_message())
    return texts.withColumn("body", F.explode(bodies)).select(
        "tenant", "alert_no", "now", "body.kind", F.lit(title).alias("title"), "message", "body.payload",
        F.lit(None).cast("boolean").alias("delivered"),
    )


def alert_status(
    box: DataFrame, enabled: bool = True, cooldown: float = COOLDOWN_SECONDS, min_attacks: int = MIN_ATTACKS
) -> DataFrame:
    """Per kind: the throttle's settings, alerts sent and failed deliveries (a failed one still starts the cooldown)."""
    return box.groupBy("kind").agg(
        F.lit(enabled).alias("enabled"),
        F.lit(float(cooldown)).alias("cooldown_seconds"),
        F.lit(min_attacks).alias("min_attacks"),
        F.count_if(F.coalesce("delivered", F.lit(True))).alias("alerts_sent"),
        F.count_if(~F.coalesce("delivered", F.lit(True))).alias("dispatch_failures"),
    )
