import random
from collections import Counter

import numpy as np
import pytest
from test_words import plain

from packetloom.llm import decontam, words
from packetloom.llm.queries import QUERIES


def make_index(texts):
    found = [set(plain(t)) for t in texts]

    def frequency(hashes):
        counts = Counter(int(h) for ws in found for h in words.words_of([" ".join(ws)]).hashes)
        return np.array([counts[int(h)] for h in hashes], float)

    n = [len(plain(t)) for t in texts]
    return decontam.build_index(list(enumerate(texts)), frequency, len(texts), sum(n) / len(n))


def plain_scores(index, terms):
    """Summed impacts by item, over all postings."""
    out = Counter()
    for t in terms:
        for p in range(index.first[t], index.first[t + 1]):
            out[int(index.items[p])] += float(index.impacts[p])
    return out


@pytest.mark.parametrize("seed", range(12))
def test_wand_finds_what_a_full_scan_finds(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(5, 30))) for _ in range(150)]
    index = make_index(texts)
    for _ in range(25):
        passage = " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60)))
        terms = sorted({int(t) for t in index.numbers(words.words_of([passage]).hashes) if t >= 0})
        for threshold in (0.3, 0.6, 0.95):
            want = {i: s for i, s in plain_scores(index, terms).items() if s >= threshold}
            got = dict(decontam.search(index, terms, threshold))
            assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-6 for i in got)


def test_promising_windows_are_all_that_can_reach_it():
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(80)]
    index = make_index([" ".join(rng.choices(vocabulary, k=12)) for _ in range(40)])
    numbers = index.numbers(words.words_of([" ".join(rng.choices([*vocabulary, *["other"] * 200], k=700))]).hashes)
    got = dict(decontam.promising(index, numbers, 64, 0.5))
    for k in range(max(1, -(-700 // 64) - 1)):
        terms = sorted({int(t) for t in numbers[k * 64 : (k + 2) * 64] if t >= 0})
        reach = Counter()
        for t in terms:
            best = Counter()
            for p in range(index.first[t], index.first[t + 1]):
                block = index.items[p] // decontam.BLOCK
                best[block] = max(best[block], index.impacts[p])
            reach.update(best)
        assert (k in got) == (max(reach.values()) >= 0.5 - 1e-9)
        assert k not in got or got[k] == terms


def test_planted_items(spark, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "the", "of", "and", "dolor"]) for _ in range(n))
    rows, want = [], set()
    for i, (item, text) in enumerate(items[:20]):
        changed = text.upper() if i % 2 else text.replace(",", " ;")
        rows.append((i, f"{filler(rng.randint(0, 400))} {changed} {filler(rng.randint(0, 400))}", "x"))
        want.add((i, item))
        rows.append((100 + i, " ".join(rng.sample(text.split(), len(text.split()))), "x"))  # same words, no runs
        rows.append((200 + i, filler(2000), "x"))
        half = text.split()
        rows.append((300 + i, " ".join(half[: len(half) // 2]), "x"))
    rows += [(None, items[0][1], "x"), (900, None, "x"), (901, "", "x"), (0, rows[0][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(4)
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    out = decontam.find(docs, bench)
    got = [(r.doc_id, r.item_id) for r in out.where("verified").collect()]
    assert set(got) == want | {(None, items[0][0])} and got.count((0, items[0][0])) == 2
    parts = decontam.find(docs, bench, part_bytes=1000).where("verified").collect()
    assert sorted((repr(r.doc_id), r.item_id) for r in parts) == sorted((repr(a), b) for a, b in got)
    assert decontam.find(docs.limit(0), bench).count() == 0 and decontam.find(docs, bench.limit(0)).count() == 0


def test_real_tables_hold_exactly_the_verbatim_items(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").collect()
    items = spark.read.parquet(f"{medium}/benchmark.parquet").collect()
    joined = [(i.item_id, " ".join(plain(i.text))) for i in items]
    want = set()
    for d in docs:
        body = f" {' '.join(plain(d.text))} "
        want |= {(d.doc_id, i) for i, t in joined if f" {t} " in body}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontaminate"](spark, medium).collect()}
    assert want <= got and len(got - want) <= 0.05 * len(want)


def searched(spark, docs, items, **options):
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.find(rows, bench, **options).where("verified")
    return sorted((r.doc_id, r.item_id, r.first_word, r.n_words) for r in out.collect())


def test_short_items_are_found_as_they_stand(spark):
    items = [(1, "the last green door"), (2, "Forty two!"), (3, "yes"), (4, "***"), (5, None), (6, "forty, TWO")]
    docs = [
        (1, "we saw the last green door there"), (2, "the green last door"), (3, "forty-two and forty two"), (4, "yes yes"),
        (5, "the last green"), (6, ""), (7, "*** yes"),
    ]
    want = [(1, 1, 2, 4), (3, 2, 0, 2), (3, 6, 0, 2), (4, 3, 0, 1), (7, 3, 0, 1)]
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, part_bytes=8) == want
    kept = decontam.remove(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6]


def test_a_side_without_words_counts_as_found(spark):
    text = "which of these rivers runs through the old town of the north\n***"
    assert decontam.question_and_answer(text)[1] == "***"
    assert [r[:2] for r in searched(spark, [(1, f"so {text} it is"), (2, "which of these rivers")], [(7, text)])] == [(1, 7)]


def test_results_of_an_item_do_not_depend_on_the_others(spark):
    rng = random.Random(6)
    word = lambda: f"q{rng.randrange(4000)}"
    short = [(i, " ".join(word() for _ in range(12)) + ". answer " + word()) for i in range(8)]
    long = [(100 + i, " ".join(word() for _ in range(n))) for i, n in enumerate((70, 130, 700))]
    docs = [(i, " ".join(word() for _ in range(300)) + " " + t + " " + " ".join(word() for _ in range(300))) for i, t in [*short, *long]]
    alone = searched(spark, docs, short)
    both = searched(spark, docs, [*short, *long])
    assert [(d, i) for d, i, *_ in both] == sorted((i, i) for i, _ in [*short, *long])
    assert [r for r in both if r[1] < 100] == alone and all(r[3] <= 2 * decontam.STRIDE for r in alone)
