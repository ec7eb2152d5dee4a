import random
import re

import numpy as np
import pyarrow as pa
import pytest

from packetloom.llm import substring

SCHEMA = "doc_id long, text string, n_words string, first string, places int"


def plain(rows, window=50):
    """(doc_id, kept text, n_words, n_removed) by the definition."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            if i is not None:
                least[tuple(w[k : k + window])] = min(i, least.get(tuple(w[k : k + window]), i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, " ".join(kept), len(w), len(gone)))
    return sorted(out, key=repr)


def removed(spark, rows, window=50):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    out = substring.remove_repeats(df, window=window)
    assert sorted(out.columns) == sorted(df.columns + ["n_removed"])
    got = out.collect()
    assert all(r.first == "y" and r.places == 1 for r in got)
    return sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in got), key=repr)


def corpus(n, seed=1):
    """Passages that many documents share, exact and near copies, repeats inside one text."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    text = lambda k: [word() for _ in range(k)]
    passages = [text(k) for k in (49, 50, 51, 70, 120)]
    base, rows = text(160), []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            w = list(base)
            w[rng.randrange(160)] = word()
        elif kind == 1:
            w = text(rng.randrange(80)) + rng.choice(passages) + text(rng.randrange(80))
        elif kind == 2:
            w = list(base)
        elif kind == 3:
            w = text(30) + passages[3] + text(5) + passages[3]
        else:
            w = text(rng.randrange(0, 120))
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n", "\t ", " \x0b"]).join(w) + rng.choice(["", " ", "\n\n"])))
    return rows


def test_equals_the_definition(spark):
    rows = corpus(150)
    want = plain(rows)
    assert sum(r[3] for r in want) > 3000
    assert removed(spark, rows) == want


@pytest.mark.parametrize("window", [2, 3, 7])
def test_other_windows(spark, window):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(30)))) for i in range(60)]
    assert removed(spark, rows, window) == plain(rows, window)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring, "LEAST_BITS", 6)
    monkeypatch.setattr(substring, "MOST_BITS", 6)  # every counter is hit many times
    rows = corpus(60, 2)
    assert removed(spark, rows) == plain(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " nbsp is a word " + " ".join(f"é{i}" for i in range(55))
    huge = "x" * (1 << 20)
    rows = [
        (5, long), (7, long + " "), (7, "new " + long), (7, "new " + long), (None, long), (None, "p\tq  r " + other), (3, None), (4, ""),
        (4, "\n \t"), (1, other), (2, other + " tail"), (8, f"{huge} {long}"), (6, f"{huge} {other}"), (9, f"{huge} {long}"), (10, "few words"),
        (11, "few words"),
    ]
    assert removed(spark, rows) == plain(rows)
    assert removed(spark, []) == []


def test_words_in_stretches(monkeypatch):
    """Hashes of words do not depend on what stands around them."""
    rng = random.Random(4)
    words = ["".join(rng.choice("aé b") for _ in range(rng.randrange(1, 9))).replace(" ", "_") for _ in range(4000)]
    text = " ".join(words)
    at_once = substring.tokens(pa.array([text]))
    singly = substring.tokens(pa.array(words))
    monkeypatch.setattr(substring, "_STRETCH", 100)
    in_parts = substring.tokens(pa.array([text, None, text]))
    for a, b, c in zip(at_once.hashes, singly.hashes, in_parts.hashes):
        assert np.array_equal(a, b) and np.array_equal(np.concatenate([a, a]), c)
        assert len(set(a.tolist())) == len(set(words))


def test_estimates_are_never_too_low(spark):
    rows = [r for r in corpus(80, 5)]
    df = spark.createDataFrame(rows, "id long, text string").dropDuplicates(["text"])
    texts = [r.text for r in df.collect()]
    bits = 8
    flags = substring.sketch(df, bits)
    found = substring.windows(pa.array(texts))
    known = substring._repeated(flags, found.anchor, bits)
    keys = found.keys(np.arange(len(found.start)))
    in_texts = {}
    for key, text in zip(zip(*(k.tolist() for k in keys)), found.text.tolist()):
        in_texts.setdefault(key, set()).add(text)
    repeated = [len(in_texts[k]) > 1 for k in zip(*(k.tolist() for k in keys))]
    assert any(repeated) and all(k for k, r in zip(known, repeated) if r)
