import random
import zlib

from pyspark.sql import functions as F

from packetloom.llm import quality
from packetloom.llm.queries import QUERIES


def test_held_out_accuracy(spark, medium):
    labels = spark.read.parquet(f"{medium}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    rows = QUERIES["op2_quality"](spark, medium).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    good = [r for r in held if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.97


def test_edges(spark):
    rng = random.Random(3)
    vocabulary = lambda letters: ["".join(rng.choice(letters) for _ in range(7)) for _ in range(40)]
    fine, junk = vocabulary("aeioulmn"), vocabulary("%&$#0123")
    good = [" ".join(rng.choice(fine) for _ in range(60)) for _ in range(30)]
    bad = [" ".join(rng.choice(junk) for _ in range(60)) for _ in range(30)]
    rows = [(i, t, 7.0, "x") for i, t in enumerate(good + bad)] + [(100, None, 0.0, None), (101, "", 0.0, None), (None, good[0], 0.0, "x"), (0, good[0], 0.0, "x"), (102, "aeiou " * 300_000, 0.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)] + [(None, 1), (100, None), (101, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert quality.fit(docs.repartition(7), labels) == model
    out = quality.score(docs, model)
    assert out.columns == ["doc_id", "text", "label", "score"] and out.count() == len(rows)
    got = {r.doc_id: r.score for r in out.collect()}
    assert all((got[i] >= 0.5) == (i < 30) for i in range(60)) and got[None] == got[0] and 0 <= got[100] == got[101] <= 1
    assert out.where(F.col("score").isNull()).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, none)).first().score == 0.5
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), none)).count() == 0
