import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import iforest
from packetloom.operators.encode import NotFittedError
from packetloom.schemas import WINDOW_FEATURES


def window(i, flows, ports, hosts, failed, total):
    return dict(
        window_id=i, src_ip=f"10.0.0.{i % 9}", window_start=60.0 * i, flow_count=flows, distinct_dst_ports=ports,
        distinct_dst_hosts=hosts, failed_ratio=failed, ports_per_host=ports / hosts, total_bytes=float(total),
        mean_bytes=total / flows,
    )


def calm(spark, n):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        flows = rng.randint(1, 3)
        rows.append(window(i, flows, rng.randint(1, 2), 1, 0.0, rng.randint(1000, 7999)))
    return spark.createDataFrame(rows)


@pytest.fixture(scope="module")
def model(spark):
    return iforest.WindowAnomalyModel.fit(calm(spark, 200))


def scored(spark, model):
    rows = [window(0, 999, 999, 1, 1.0, 0), window(1, 2, 1, 1, 0.0, 4000)]
    return model.score(spark.createDataFrame(rows)).orderBy("window_id").collect()


def test_scan_is_flagged(spark, model):
    scan, normal = scored(spark, model)
    assert scan.is_anomaly and not normal.is_anomaly
    assert scan.anomaly_score > normal.anomaly_score
    assert model.baseline_rows == 200 and model.sample_rows == 200


def test_needs_a_baseline(spark):
    with pytest.raises(ValueError, match="baseline of 10 windows"):
        iforest.WindowAnomalyModel.fit(calm(spark, 10))
    with pytest.raises(NotFittedError):
        iforest.WindowAnomalyModel().score(calm(spark, 1))
    with pytest.raises(NotFittedError):
        iforest.WindowAnomalyModel().save("/nowhere")


def test_round_trip(spark, model, tmp_path):
    model.save(str(tmp_path))
    again = iforest.WindowAnomalyModel.load(spark, str(tmp_path))
    assert scored(spark, again) == scored(spark, model)
    assert again.baseline_rows == 200


def test_share_of_baseline_flagged(spark, model):
    flagged = model.score(calm(spark, 200)).where("is_anomaly").count()
    assert 1 <= flagged <= 8


def test_same_seed_same_forest(spark, model):
    again = iforest.WindowAnomalyModel.fit(calm(spark, 200).repartition(5))
    a, b = (m.nodes.orderBy("tree", "node").collect() for m in (again, model))
    # Means add up in no fixed order, hence the last digits of thresholds may differ.
    shape = lambda rows: [(r.tree, r.node, r.feature, r.left, r.right, r["size"], r.depth) for r in rows]
    assert shape(a) == shape(b) and again.offset == pytest.approx(model.offset)
    assert [r.threshold for r in a] == pytest.approx([r.threshold for r in b])


def test_tree_samples_are_exact(spark):
    rows = spark.range(20_000).select(F.col("id").alias("window_id"), *[F.rand(1).alias(c) for c in WINDOW_FEATURES])
    picked = iforest.tree_samples(rows, "window_id", 20_000, 20, 256, 42)
    sizes = picked.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("window_id").alias("d")).collect()
    assert len(sizes) == 20 and all((r.n, r.d) == (256, 256) for r in sizes)


def test_path_length_of_leaves():
    assert iforest.average_path([1, 2]).tolist() == [0.0, 1.0]
    assert iforest.average_path([256])[0] == pytest.approx(10.2448, abs=1e-3)
