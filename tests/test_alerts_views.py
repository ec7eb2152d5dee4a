import json

import pytest
from pyspark.sql import functions as F

from packetloom.operators import alerts, views
from packetloom.operators.records import attack_log_rows, live_events

BATCH = "tenant string, batch_id long, now double, attacks long, anomalies long, worst_score double, worst_src string"


def run(spark, rows, sources=(), **kw):
    """rows: (now, attacks, anomalies, worst_score, worst_src)."""
    full = [("t", i, float(n), a, x, s, w) for i, (n, a, x, s, w) in enumerate(rows)]
    batches = spark.createDataFrame(full, BATCH)
    named = spark.createDataFrame([("t", b, s) for b, s in sources], "tenant string, batch_id long, src_ip string")
    fired = alerts.alerts(alerts.throttle(batches, **kw), named).withColumn("message", alerts.alert_message())
    return fired.orderBy("alert_no").collect()


def test_threshold_adds_up(spark):
    (a,) = run(spark, [(100, 3, 0, 0.0, None), (101, 4, 0, 0.0, None)], [(0, "10.0.0.1"), (1, "10.0.0.1")])
    assert (a.now, a.attacks) == (101.0, 7)
    assert a.message == "7 attack flows flagged — sources: 10.0.0.1"


def test_cooldown(spark):
    got = run(spark, [(100, 9, 0, 0.0, None), (130, 9, 0, 0.0, None), (161, 0, 0, 0.0, None)])
    assert [(a.now, a.attacks) for a in got] == [(100.0, 9), (161.0, 9)]
    assert run(spark, [(59, 9, 0, 0.0, None)]) == []


def test_anomaly_passes_the_threshold(spark):
    (a,) = run(spark, [(100, 2, 1, 0.1251, "10.0.0.8")], [(0, "10.0.0.8")], min_attacks=100)
    assert a.message == (
        "2 attack flows flagged; 1 anomalous source-window(s) (worst: 10.0.0.8 score 0.13) — sources: 10.0.0.8"
    )


def test_sources_are_listed_to_three(spark):
    (a,) = run(spark, [(100, 9, 0, 0.0, None)], [(0, f"10.0.0.{i}") for i in (6, 2, 4, 1, 5, 3, 3)] + [(0, ""), (0, None)])
    assert a.message.endswith("— sources: 10.0.0.1, 10.0.0.2, 10.0.0.3 (+3 more)") and a.n_sources == 6


def test_nothing_without_channel_or_signal(spark):
    rows = [(100, 9, 1, 0.5, "s")]
    assert run(spark, rows, enabled=False) == []
    assert run(spark, [(100, 4, 0, 0.0, None), (500, 0, 0, 0.0, None)]) == []


@pytest.mark.parametrize("score, text", [(0.125, "0.12"), (0.375, "0.38"), (0.615, "0.61"), (0.2449, "0.24"), (1.0, "1.00")])
def test_score_text(spark, score, text):
    assert text == f"{score:.2f}"
    (a,) = run(spark, [(100, 0, 1, score, "s")])
    assert f"score {text})" in a.message


def test_worst_is_the_first_of_equals(spark):
    rows = [("t", 0, 1.0, i, s, v) for i, (s, v) in enumerate([("a", 0.2), ("b", 0.5), ("c", 0.5), ("d", -1.0)])]
    scored = spark.createDataFrame(rows, "tenant string, batch_id long, now double, seq long, src_ip string, anomaly_score double")
    w = alerts.anomaly_inputs(scored).first()
    assert (w.anomalies, w.worst_score, w.worst_src) == (4, 0.5, "b")
    low = alerts.anomaly_inputs(scored.where("anomaly_score < 0")).first()
    assert (low.worst_score, low.worst_src) == (0.0, None)


def test_payloads_and_status(spark):
    rows = spark.createDataFrame(
        [("t", 1, 100.0, 9, 0, 0.0, None, 1, ["10.0.0.1"])],
        "tenant string, alert_no long, now double, attacks long, anomalies long, worst_score double, worst_src string,"
        " n_sources long, listed array<string>",
    )
    box = {r.kind: r.payload for r in alerts.outbox(rows, alerts.CHANNEL_KINDS, "Title").collect()}
    text = "9 attack flows flagged — sources: 10.0.0.1"
    assert box["ntfy"] == box["email"] == text
    assert json.loads(box["discord"]) == {"content": f"**Title**\n{text}"}
    assert json.loads(box["slack"]) == {"text": f"*Title*\n{text}"}
    assert json.loads(box["generic"]) == {"title": "Title", "message": text}
    sent = alerts.outbox(rows, ["ntfy", "slack"]).withColumn("delivered", F.col("kind") == "ntfy")
    status = {r.kind: (r.alerts_sent, r.dispatch_failures) for r in alerts.alert_status(sent).collect()}
    assert status == {"ntfy": (1, 0), "slack": (0, 1)}
    with pytest.raises(ValueError, match="unknown kind"):
        alerts.alert_payload("pager")


def test_views(spark):
    rows = spark.range(500).select(
        F.col("id").alias("seq"), (F.col("id") % 50 == 0).alias("has_file_activity"), (F.col("id") % 10 == 0).alias("is_anomaly")
    )
    assert [r.seq for r in views.live_recent(rows, 3).collect()] == [499, 498, 497]
    assert [r.seq for r in views.attack_log(rows, 2, files_only=True).collect()] == [450, 400]
    assert [r.seq for r in views.anomalies_recent(rows, 30, anomalies_only=True).collect()][-1] == 200
    counted = views.view_counts(views.anomalies_recent(rows, 30), "is_anomaly", "anomalies").first()
    assert (counted["count"], counted.anomalies) == (30, 3)
    with pytest.raises(ValueError, match="one row at least"):
        views.live_recent(rows, 0)
    # A view reaches as far back as it is asked to.
    assert views.live_recent(rows, 450).count() == 450
    assert views.anomalies_recent(rows, 40, anomalies_only=True).count() == 40


def test_events_and_log(spark):
    rows = spark.createDataFrame([(1, "tcp", 0, None, 1), (2, "udp", None, 3, 0)], "seq long, protocol_type string, num_file_creations int, num_access_files int, prediction int")
    got = live_events(rows, "nsl", ["normal", "attack"], ["seq"]).orderBy("seq").collect()
    assert [(r.has_file_activity, r.label, r.is_attack, r.service) for r in got] == [
        (False, "attack", True, None), (True, "normal", False, None),
    ]
    (logged,) = attack_log_rows(live_events(rows, "nsl", ["normal", "attack"], ["seq"])).collect()
    assert logged.seq == 1 and logged.logged_at.endswith("+00:00") and logged.logged_at[:10] == str(logged.log_date)
