from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_minhash import plain_classes
from test_packing import check
from test_secrets import plain_base
from test_words import plain

import corpus_pipeline
from packetloom.llm import packing, quality


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """Documents before and after every stage; odd rows are added to the table."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = docs.orderBy("doc_id").limit(5)
    odd = first.withColumn("doc_id", F.lit(None).cast("long")).unionByName(first)
    long = first.limit(1).withColumn("doc_id", F.lit(10_000).cast("long")).withColumn("text", F.repeat("text", 300))
    docs = docs.unionByName(odd).unionByName(long)
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], folder).write.parquet(f"{folder}/out{i}")
        out.append(spark.read.parquet(f"{folder}/out{i}"))
    return folder, out, [[r.asDict() for r in df.collect()] for df in out]


def key(r):
    return repr(r["doc_id"]), r["text"], r["lang"], r["source"], r["n_chars"]


def test_columns(stages):
    _, frames, _ = stages
    assert all(df.columns == frames[0].columns for df in frames[:-1])


def test_quality(spark, stages):
    folder, frames, rows = stages
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(frames[0], labels.where(~quality.held_out(F.col("doc_id"), 3, 1)))
    want = Counter(key(r) for r in rows[0] if quality.scores(model, [r["text"]])[0] >= 0.5)
    assert Counter(map(key, rows[1])) == want and 0 < len(rows[1]) < len(rows[0])


def test_near_duplicates(stages):
    _, _, rows = stages
    docs = [(r["doc_id"], r["text"]) for r in rows[1]]
    by_id = defaultdict(set)
    for i, c in plain_classes(docs):
        by_id[c].add(i)
    assert Counter(repr(r["doc_id"]) for r in rows[2]) == Counter(repr(c) for c in by_id)
    assert {key(r) for r in rows[2]} <= {key(r) for r in rows[1]}


def test_decontamination(spark, stages):
    folder, _, rows = stages
    items = [" ".join(plain(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    holds = lambda t: any(f" {i} " in f" {' '.join(plain(t))} " for i in items)
    want = [key(r) for r in rows[2] if not holds(r["text"])]
    assert sorted(map(key, rows[3])) == sorted(want)


def test_secrets(stages):
    _, _, rows = stages
    before = {repr(r["doc_id"]): r["text"] for r in rows[3]}
    assert len(before) == len(rows[3]) == len(rows[4])
    for r in rows[4]:
        text = before[repr(r["doc_id"])]
        assert r["n_chars"] == len(r["text"])
        found = plain_base(text)
        if not found:
            assert r["text"] == text or "[SECRET]" in r["text"]
        for a, _, b, _ in found:
            assert text[a:b] not in r["text"]


def test_packing(stages):
    _, frames, rows = stages
    check(frames[5].collect(), {r["doc_id"]: len(r["text"].split()) + 1 for r in rows[4]}, list(packing.SIZES))


def test_run(spark, stages):
    folder, _, rows = stages
    out = corpus_pipeline.run(spark, folder)
    lengths = lambda found: Counter((r["doc_id"], r["piece_start"], r["piece_length"]) for r in found)
    assert lengths([r.asDict() for r in out.collect()]) == lengths(rows[5])


ODD = [
    (1, None, "en", "a", None, "x", 1, 0.5), (2, "", "en", "a", 0, "x", 1, 0.5), (None, None, None, None, None, None, None, None),
    (3, "few words", "en", "b", 9, "y", 2, 0.1), (3, "few words", "en", "b", 9, "y", 2, 0.1),
    (4, "token=abcdefgh and more", "en", "b", 23, "y", 2, 0.1), (5, "long words " * 40_000, "en", "b", 440_000, "y", 2, 0.1),
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_odd_rows_and_clashing_columns(spark, small, rows):
    """Null and empty texts, repeated rows, no rows at all; columns named like what the stages add."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, spans string, key int, score double"
    docs = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        got = out.collect()
        assert len(got) <= 40 * len(rows)
        if name == "best-fit packing":
            assert not rows or {r.doc_id for r in got} == {r[0] for r in rows}
            continue
        assert out.columns == docs.columns
        kept = {(r.doc_id, r.source, r.spans, r.key, r.score) for r in got}
        assert kept <= {(r[0], r[3], *r[5:]) for r in rows}
        if name in ("benchmark decontamination", "secret scans"):
            assert len(got) == len(rows) and kept == {(r[0], r[3], *r[5:]) for r in rows}
        if name == "secret scans" and rows:
            assert {r.text for r in got if r.doc_id == 4} == {"[SECRET] and more"}
