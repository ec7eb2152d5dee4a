import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from packetloom.operators import clusters, encode, evaluate, models, sampling, trees
from packetloom.schemas import CATEGORICAL_FEATURES, CONNECTION_FEATURES, FLOW_FEATURES, NUMERIC_FEATURES
from packetloom.sources.artifacts import ArtifactStore, MissingArtifactError

ATTACKS = ["neptune", "satan", "guess_passwd", "rootkit"]


def connections(spark, n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        bad = i % 2 == 1
        row = {c: rng.random() for c in NUMERIC_FEATURES}
        for c in ("count", "srv_count", "serror_rate"):
            row[c] += 2.0 * bad
        row["protocol_type"] = "tcp" if bad else rng.choice(["udp", "icmp"])
        row["service"] = "private" if bad else rng.choice(["http", "smtp"])
        row["flag"] = rng.choice(["S0", "RSTR"]) if bad else "SF"
        row["label"] = ATTACKS[i // 2 % 4] if bad else "normal"
        rows.append({c: row[c] for c in [*CONNECTION_FEATURES, "label"]} | {"id": i})
    return spark.createDataFrame(rows)


@pytest.fixture(scope="module")
def train(spark):
    return connections(spark, 300, 1).cache()


@pytest.fixture(scope="module")
def test(spark):
    return connections(spark, 100, 2).cache()


@pytest.fixture(scope="module")
def encoder(train):
    return encode.connection_encoder().fit(train)


def vectors(df):
    return [r.v for r in df.select(vector_to_array("vector").alias("v")).collect()]


def test_encoding(train, encoder):
    names = encoder.feature_names
    rows = vectors(encoder.transform(train))
    assert len(names) == len(rows[0]) and names[-38:] == [f"num__{c}" for c in NUMERIC_FEATURES]
    assert names[:3] == ["cat__protocol_type_icmp", "cat__protocol_type_tcp", "cat__protocol_type_udp"]
    for i in range(len(names) - 38, len(names)):
        values = [r[i] for r in rows]
        mean = sum(values) / len(values)
        assert mean == pytest.approx(0, abs=1e-9)
        assert math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)) == pytest.approx(1)


def test_unknown_category_is_all_zero(train, encoder):
    width = len(encoder.feature_names) - 38
    known, odd = (vectors(encoder.transform(d.limit(1)))[0] for d in (train, train.withColumn("service", F.lit("novel"))))
    assert sum(known[:width]) == 3 and sum(odd[:width]) == 2


def test_constant_column_is_divided_by_one(spark):
    rows = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "a double, b double")
    got = encode.scale(rows, encode.scaling_parameters(rows, ["a", "b"])).collect()
    assert [tuple(r) for r in got] == [(0.0, -1.0), (0.0, 1.0)]


def test_fit_comes_first(train, tmp_path):
    fresh = encode.connection_encoder()
    for use in (lambda: fresh.transform(train), lambda: fresh.save(str(tmp_path)), lambda: fresh.feature_names):
        with pytest.raises(encode.NotFittedError):
            use()


def test_encoder_round_trip(spark, train, encoder, tmp_path):
    store = ArtifactStore(spark, str(tmp_path))
    with pytest.raises(MissingArtifactError):
        store.load_encoder()
    store.save_encoder(encoder)
    assert vectors(store.load_encoder().transform(train)) == vectors(encoder.transform(train))


def test_training_and_lookup(spark, train, test, encoder, tmp_path):
    store = ArtifactStore(spark, str(tmp_path))
    sizes = {"trees": 5, "rounds": 3, "depth": 6, "boost_depth": 3}
    scores = models.train_models(train, test, encoder, "nsl", store.save_model, **sizes)
    store.save_metrics(scores, "nsl")
    binary = {r.model: r for r in store.load_metrics("nsl", "binary").collect()}
    assert set(binary) == set(models.MODEL_NAMES) and binary["dt"].accuracy > 0.9
    assert store.load_metrics("nsl", "multiclass").count() == 4
    assert len(store.available()) == 8
    got = models.predict(test, encoder, store.load_model("dt", "binary"), "nsl", "binary")
    assert {(r.label, r.is_attack) for r in got.collect()} == {("normal", False), ("attack", True)}
    many = models.predict(test, encoder, store.load_model("gbt", "multiclass"), "nsl", "multiclass")
    assert many.where("label = 'normal' and is_attack").count() == 0 and many.count() == 100
    with pytest.raises(MissingArtifactError):
        store.load_model("dt", "binary", "cic")
    with pytest.raises(ValueError, match="unknown model"):
        store.model_path("svm", "binary")


def test_flow_models(spark, tmp_path):
    rng = random.Random(3)
    kinds, rows = ["BENIGN", "DoS Hulk", "PortScan", "SSH-Patator"], []
    for i in range(200):
        kind = kinds[i % 4]
        row = {c: rng.random() for c in FLOW_FEATURES} | {"label": kind, "id": i}
        for c in ("flow_pkts_per_s", "syn_flag_cnt", "tot_fwd_pkts"):
            row[c] += 2.0 * (kind != "BENIGN")
        rows.append(row)
    df = spark.createDataFrame(rows)
    train, test = sampling.stratified_split(df, "label", "id")
    assert (train.count(), test.count()) == (140, 60)
    assert test.select("label").distinct().count() == 4
    assert train.join(test, "id").count() == 0
    encoder = encode.flow_encoder()
    scores = models.train_models(train, test, encoder, "cic", models=("dt",), phases=("binary",), depth=5)
    assert scores.first().accuracy > 0.9


def test_split_is_exact_per_class(spark):
    rows = spark.range(1000).select(
        F.col("id"), F.when(F.col("id") < 700, "a").when(F.col("id") < 993, "b").otherwise("c").alias("label")
    )
    marked = sampling.with_split(rows, "label", "id").where("taken").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in marked} == {"a": 210, "b": 88, "c": 2}
    again = sampling.with_split(rows.repartition(7), "label", "id").where("taken")
    assert again.count() == 300 and again.exceptAll(sampling.with_split(rows, "label", "id").where("taken")).count() == 0


def test_fixed_sample(spark):
    rows = spark.range(5000)
    assert sampling.fixed_sample(rows, 777, "id").distinct().count() == 777
    assert sampling.fixed_sample(rows, 9999, "id").count() == 5000


@pytest.mark.parametrize("q", [0.0, 0.02, 0.5, 0.977, 1.0])
def test_exact_quantile(spark, q):
    rows = spark.range(3001).select(F.when(F.col("id") % 3 == 0, 0.25).otherwise((F.col("id") * 7919 % 3001) ** 2 / 77.0).alias("v"))
    expected = rows.agg(F.percentile("v", q)).first()[0]
    for most in (100_000, 50):
        assert sampling.exact_quantile(rows, "v", q, max_rows=most) == pytest.approx(expected, rel=1e-12)


def frame(spark, truth, predicted):
    return spark.createDataFrame(list(zip(truth, predicted)), "label int, prediction int")


def test_metrics(spark):
    m = evaluate.metrics(frame(spark, [0, 0, 1, 1], [0, 1, 1, 1]), "binary").first()
    assert (m.accuracy, m.precision, m.recall) == (0.75, pytest.approx(2 / 3), 1.0)
    none = evaluate.metrics(frame(spark, [1, 1], [0, 0]), "binary").first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)
    # Class 3 is only predicted, class 2 never is: both count in the means.
    macro = evaluate.metrics(frame(spark, [0, 0, 1, 2], [0, 1, 1, 3]), "multiclass").first()
    assert macro.accuracy == 0.5
    assert macro.precision == pytest.approx((1 + 0.5 + 0 + 0) / 4) and macro.recall == pytest.approx((0.5 + 1) / 4)
    with pytest.raises(ValueError, match="unknown phase"):
        evaluate.metrics(frame(spark, [0], [0]), "other")


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(5)
    rows = [(i, [c + rng.gauss(0, 0.5) for _ in range(5)], c // 10) for i, c in enumerate([0, 10, 20] * 40)]
    df = spark.createDataFrame(rows, "id long, point array<double>, cluster int")
    return df.withColumn("vector", array_to_vector("point")).cache()


def test_kmeans_sweep(spark, blobs, tmp_path):
    sweep, best, final = clusters.kmeans_sweep(blobs, "id", ks=range(2, 6), restarts=2)
    rows = sweep.orderBy("k").collect()
    assert best == 3 and final.getK() == 3
    assert [r.k for r in rows] == [2, 3, 4, 5]
    assert all(a.inertia > b.inertia for a, b in zip(rows, rows[1:]))
    store = ArtifactStore(spark, str(tmp_path))
    store.save_sweep(sweep)
    assert store.load_sweep().count() == 4


def test_silhouette_matches_definition(blobs):
    points = [(r.id, r.point, r.cluster) for r in blobs.collect()]
    got = {r.id: r.silhouette for r in clusters.silhouette_rows(blobs, "id").collect()}
    for i, p, c in points[:15]:
        means = {
            k: sum(math.dist(p, q) for j, q, d in points if d == k and j != i) / sum(d == k and j != i for j, _, d in points)
            for k in range(3)
        }
        a, b = means.pop(c), min(means.values())
        assert got[i] == pytest.approx((b - a) / max(a, b))
    cut = {r.id: r.silhouette for r in clusters.silhouette_rows(blobs, "id", block_rows=11).collect()}
    assert cut == pytest.approx(got)


def test_quantile_leaves_out_nan_and_survives_wide_ranges(spark):
    rows = spark.createDataFrame([(v,) for v in [float("nan"), None, -1.7e308, 0.0, 1.0, 2.0, 1.7e308] + [3.0] * 50], "v double")
    values = sorted([-1.7e308, 0.0, 1.0, 2.0, 1.7e308] + [3.0] * 50)
    for q in (0.0, 0.05, 0.5, 1.0):
        assert sampling.exact_quantile(rows, "v", q, max_rows=2) == pytest.approx(float(np.quantile(values, q)))
    with pytest.raises(ValueError, match="infinite"):
        sampling.exact_quantile(spark.createDataFrame([(float("inf"),)], "v double"), "v", 0.5)


def test_null_class_gets_its_share_of_test_rows(spark):
    rows = spark.range(100).selectExpr("id", "case when id % 2 = 0 then 'a' end as label")
    train, test = sampling.stratified_split(rows, "label", "id")
    assert test.where("label is null").count() == 15 and train.where("label is null").count() == 35


def test_all_fits_share_one_table(spark, train, test, encoder, monkeypatch):
    cuts, whole, order = [], [], []
    of = {name: getattr(trees, name) for name in ("cut_points", "_whole")}
    monkeypatch.setattr(trees, "cut_points", lambda *a, **b: cuts.append(1) or of["cut_points"](*a, **b))
    monkeypatch.setattr(trees, "_whole", lambda *a, **b: whole.append(1) or of["_whole"](*a, **b))
    sizes = {"trees": 2, "rounds": 2, "boost_depth": 2}
    scores = models.train_models(train, test, encoder, "nsl", lambda model, name, phase: order.append((phase, name)), **sizes)
    assert len(cuts) == 1  # six fits of trees
    assert len(whole) == 4  # of each boosted model's rounds: few rows are not shuffled
    assert order == [(phase, name) for phase in models.PHASES for name in models.MODEL_NAMES]
    assert [(r.phase, r.model) for r in scores.collect()] == order
    # Each as fitted by itself.
    rows = models.labelled(train, "nsl", "multiclass")
    alone = models.make_classifier("gbt", "multiclass", **sizes).fit(encoder.transform(rows))
    tested = alone.transform(encoder.transform(models.labelled(test, "nsl", "multiclass")))
    want = evaluate.metrics(tested.select("label", F.col("prediction").cast("int")), "multiclass").first()
    got = scores.where("phase = 'multiclass' and model = 'gbt'").first()
    assert np.allclose([got[c] for c in ("accuracy", "precision", "recall", "f1")], list(want))


def test_split_is_written_once(spark, monkeypatch):
    names, write = [], sampling.materialize
    monkeypatch.setattr(sampling, "materialize", lambda df, name: names.append(name) or write(df, name))
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("label"))
    train, test = sampling.stratified_split(rows, "label", "id")
    assert "split" in names and (train.count(), test.count()) == (70, 30)
