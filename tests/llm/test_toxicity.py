import random
import zlib

import numpy as np
import pytest

from packetloom.llm import toxicity, words
from packetloom.llm.queries import QUERIES


def test_held_out_accuracy(spark, medium):
    labels = spark.read.parquet(f"{medium}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = QUERIES["op4_toxicity"](spark, medium).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.9


def test_gradients_are_those_of_the_loss():
    found = words.words_of(["one two three four", "five six", "two five two nine ten"])
    vocabulary = toxicity.Vocabulary(found)
    windows = [(vocabulary, vocabulary.number[a:b]) for a, b in zip(found.first[:-1], found.first[1:])]
    labels, weights = np.array([1.0, 0.0, 1.0], np.float32), np.array([1.0, 2.0, 0.5], np.float32)

    class Recorder(toxicity.Trainer):
        def _learn(self, g):
            self.found = g

        def _learn_rows(self, name, at, grad):
            self.found[name] = np.zeros(self.p[name].shape)
            np.add.at(self.found[name], at, grad)

    trainer = Recorder(3)
    trainer.rng = type("All", (), {"random": staticmethod(lambda n: np.ones(n))})()  # hides no words
    trainer.p = {k: (v.astype(np.float64) + (0.1 if k == "word" else 0)) for k, v in trainer.p.items()}
    trainer.step(windows, labels, weights)
    found_grads = trainer.found
    rng = np.random.default_rng(1)
    for name, grad in found_grads.items():
        hot = np.argwhere(np.abs(grad) > 1e-5)
        for at in hot[rng.permutation(len(hot))[:6]]:
            at, eps = tuple(at), 1e-2
            kept = trainer.p[name][at]
            losses = []
            for sign in (1, -1):
                trainer.p[name][at] = kept + sign * eps
                losses.append(trainer.step(windows, labels, weights))
            trainer.p[name][at] = kept
            slope = (losses[0] - losses[1]) / (2 * eps)
            assert slope == pytest.approx(grad[at], rel=0.05, abs=2e-4), name


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 72, 73, 500, 2401):
        spans = toxicity.windows(n)
        assert sorted({i for a, b in spans for i in range(a, b)}) == list(range(n))
        assert all(b - a == min(n, toxicity.WINDOW) for a, b in spans)


def test_batches_do_not_change_scores():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (0, 1, 5, 30, 48, 49, 700)]
    p = toxicity._start(np.random.default_rng(5))
    p["word"] += np.random.default_rng(6).normal(0, 0.3, p["word"].shape).astype(np.float32)
    together = toxicity.text_features(p, texts)
    alone = np.concatenate([toxicity.text_features(p, [t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-4)
    # A score needs its whole text: a word at the very end moves it.
    assert abs(toxicity.text_features(p, [texts[-1] + " zzzzz"])[0] - together[-1]).max() > 0


def test_edges(spark):
    rng = random.Random(3)
    plain = lambda: " ".join("".join(rng.choice("aeioulmn") for _ in range(4)) for _ in range(80))
    rude = lambda: plain() + " grumpfh " + plain()
    texts = [rude() for _ in range(40)] + [plain() for _ in range(40)]
    rows = [(i, t, 3.0, "x") for i, t in enumerate(texts)] + [(100, None, 0.0, None), (101, "", 0.0, None), (None, texts[0], 0.0, "x"), (0, texts[0], 0.0, "x"), (102, plain() * 500, 0.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, toxic string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)] + [(None, 1), (100, 0), (101, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "toxic", "score"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert all((by_id[i] >= 0.5) == (i < 40) for i in range(80)) and by_id[None] == by_id[0] and by_id[100] == by_id[101] < 0.5
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs.limit(3), toxicity.fit(docs, none)).where("score = 0.5").count() == 3
    assert toxicity.score(docs.limit(0), model).count() == 0
