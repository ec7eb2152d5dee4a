"""The batch jobs end to end on small files."""

import pytest
from test_models import connections
from test_sources import daily_csv, window_line, write

from packetloom.functions.labels import UnknownLabelError
from packetloom.operators.models import predict
from packetloom.plans import training
from packetloom.schemas import CONNECTION_FEATURES
from packetloom.sources.artifacts import ArtifactStore


def connection_file(spark, path, n, seed):
    rows = connections(spark, n, seed).collect()
    write(path, "\n".join(",".join(str(r[c]) for c in [*CONNECTION_FEATURES, "label"]) + ",1" for r in rows) + "\n")
    return str(path)


def test_connection_jobs(spark, tmp_path):
    train = connection_file(spark, tmp_path / "train.txt", 160, 1)
    test = connection_file(spark, tmp_path / "test.txt", 60, 2)
    store = ArtifactStore(spark, str(tmp_path / "store"))
    scores = training.train_connection_models(spark, train, test, store, models=("nb", "dt"), depth=5)
    best = {(r.phase, r.model): r.accuracy for r in scores.collect()}
    assert len(best) == 4 and best["binary", "dt"] > 0.9
    got = predict(training.read_connections(spark, test), store.load_encoder(), store.load_model("dt", "binary"), "nsl", "binary")
    assert got.count() == 60
    assert training.sweep_clusters(spark, train, store, ks=range(2, 4), restarts=1) in (2, 3)
    assert store.load_sweep().count() == 2
    rules = training.build_rules(spark, train, store).collect()
    assert ("flag=SF", 1.0) in {(r.antecedents, r.confidence) for r in rules}


def test_flow_job(spark, tmp_path):
    kinds = ["BENIGN", "DoS Hulk", "PortScan", "SSH-Patator"]
    rows = [(kinds[i % 4], {"syn_flag_cnt": i % 4 * 5 + i % 3, "flow_duration": i}) for i in range(80)]
    write(tmp_path / "raw" / "day.csv", daily_csv(rows))
    store = ArtifactStore(spark, str(tmp_path / "store"))
    scores = training.train_flow_models(spark, str(tmp_path / "raw"), store, models=("dt",), depth=5)
    assert {r.phase: r.accuracy for r in scores.collect()} == {"binary": 1.0, "multiclass": 1.0}
    write(tmp_path / "bad" / "day.csv", daily_csv([*rows, ("Novel", {})]))
    with pytest.raises(UnknownLabelError, match="Novel"):
        training.train_flow_models(spark, str(tmp_path / "bad"), store)


def test_anomaly_job(spark, tmp_path):
    write(tmp_path / "base" / "part.json", "\n".join(window_line(i) for i in range(60)) + "\n")
    model = training.train_anomaly_model(spark, str(tmp_path / "base"), str(tmp_path / "model"), trees=10)
    assert model.baseline_rows == 60
    again = type(model).load(spark, str(tmp_path / "model"))
    assert again.score(training.read_baseline(spark, str(tmp_path / "base"))).count() == 60
    write(tmp_path / "few" / "part.json", window_line(1) + "\n")
    with pytest.raises(ValueError, match="50 are needed"):
        training.train_anomaly_model(spark, str(tmp_path / "few"), str(tmp_path / "none"))
