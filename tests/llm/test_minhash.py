import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from packetloom.llm import minhash, sketch, words
from packetloom.llm.queries import QUERIES

RNG = random.Random(9)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]


def prose(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def edited(w, share):
    return [RNG.choice(VOCABULARY) if RNG.random() < share else x for x in w]


def corpus():
    base, other = prose(150), prose(400)
    docs = [" ".join(prose(RNG.randint(1, 300))) for _ in range(60)]
    docs += [" ".join(edited(base, 0.02)) for _ in range(40)] + [" ".join(base)]
    docs += [" ".join(edited(other, 0.005)) for _ in range(10)]
    shared = " ".join(prose(40))
    docs += [" ".join(prose(200)) + " " + shared for _ in range(30)]
    docs += [docs[0]] * 20 + [docs[61].upper().replace(" ", " - ")]
    docs += [None, "", "", "...", "!!!", "one two", "one two", "One, two", "three"]
    docs += [" ".join(prose(30_000))] * 2
    RNG.shuffle(docs)
    return list(enumerate(docs)) + [(None, docs[0]), (3, docs[3]), (5, "another text under a known id, five words")]


def plain_classes(docs):
    """Brute force: exact weighted similarities of all pairs, then connected components."""
    texts = sorted({t or "" for _, t in docs})
    tokens = [words.words_of([t]).hashes for t in texts]
    grams = [Counter(words.shingles(h, 5).tolist()) for h in tokens]
    df = Counter(g for c, t in zip(grams, texts) for g in c for _ in range(sum((x or "") == t for _, x in docs)))
    n = np.log1p(len(docs))
    weights = [{g: k * (1 + minhash.IDF_STRENGTH * (n - np.log1p(df[g])) / n) for g, k in c.items()} for c in grams]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    similar = {}
    for i in range(len(texts)):
        for j in range(i):
            common = weights[i].keys() & weights[j].keys()
            if common:
                m = sum(min(weights[i][g], weights[j][g]) for g in common)
                similar[i, j] = m / (sum(weights[i].values()) + sum(weights[j].values()) - m)
                if similar[i, j] >= 0.8:
                    parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, t in docs:
        least[root(texts.index(t or ""))].append(i)
    return sorted((repr(i), min((x for x in least[root(texts.index(t or ""))] if x is not None), default=None)) for i, t in docs)


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, node string, keys int").repartition(5)


def test_classes_equal_brute_force(spark):
    docs = corpus()
    got = minhash.classes(frame(spark, docs)).collect()
    assert sorted((repr(r.doc_id), r.class_id) for r in got) == plain_classes(docs)


def test_blocks_find_links_that_pivots_miss(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 4)
    base = prose(120)
    docs = list(enumerate(" ".join(edited(base, 0.03)) for _ in range(60)))
    got = minhash.classes(frame(spark, docs)).collect()
    assert sorted((repr(r.doc_id), r.class_id) for r in got) == plain_classes(docs)


@pytest.mark.parametrize("block", [16, 256])
def test_links_of_blocks_are_fewer_than_their_texts(spark, monkeypatch, block):
    """A large class outside its pivot's class: every pair is similar, few links come out, none between classes is lost."""
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", block)
    base = prose(150)
    texts = {f"n{i:03d}": " ".join(edited(base, 0.005)) for i in range(200)} | {"pivot": " ".join(prose(150))}
    texts |= {f"other{i}": " ".join(edited(base, 0.7)) for i in range(5)}
    nodes = spark.createDataFrame(list(texts.items()), "node string, text string")
    pairs = nodes.where("node <> 'pivot'").selectExpr("node as a", "'pivot' as b")
    known = sketch.Frequencies(np.zeros((2, 1 << 17), np.float32), 1000, 17)
    apart = spark.createDataFrame([], "node string, label string")
    links = minhash.rest_links(pairs, apart, nodes, known, 0.8).collect()
    cells = -(-205 // block) * -(-206 // block)
    features = {n: minhash.weighted_shingles(words.words_of([t]).hashes, known) for n, t in texts.items()}
    names = sorted(texts)
    similar = [(a, b) for a in names for b in names if a < b and minhash.weighted_jaccard(features[a], features[b]) >= 0.8]
    assert len(similar) > 10_000 and len(links) < min(len(similar) / 2, cells * 2 * 206)
    assert {tuple(sorted((r.a, r.b))) for r in links} <= set(similar)

    def partition(edges):
        up = {n: n for n in names}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            up[root(a)] = root(b)
        groups = defaultdict(list)
        for n in names:
            groups[root(n)].append(n)
        return sorted(groups.values())

    assert partition((r.a, r.b) for r in links) == partition(similar)
    if block == 256:
        assert len(links) == len(names) - len(partition(similar))


def links_kept(spark, folder):
    """(found, all) pairs of different texts that are similar by exact weights, among all rows; found: in one class."""
    table = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    docs = [(r.doc_id, r.text or "") for r in table.collect()]
    known = minhash.frequencies(table)
    of = {r.doc_id: r.class_id for r in QUERIES["op5_minhash"](spark, folder).collect()}
    features = [minhash.weighted_shingles(words.words_of([t]).hashes, known) for _, t in docs]
    holders, found, total = defaultdict(list), 0, 0
    for x, (shingles, _) in enumerate(features):
        common = {y for s in shingles.tolist() for y in holders[s]}
        for y in common:
            if docs[x][1] != docs[y][1] and minhash.weighted_jaccard(features[x], features[y]) >= 0.8:
                total += 1
                found += of[docs[x][0]] == of[docs[y][0]]
        for s in shingles.tolist():
            holders[s].append(x)
    return found, total


def test_recall_on_whole_table(spark, medium):
    found, total = links_kept(spark, medium)
    assert total and found >= 0.9 * total


def test_samples_agree_as_often_as_similar():
    sampler = minhash.Sampler(4096)
    known = sketch.Frequencies(np.zeros((2, 1 << 17), np.float32), 1000, 17)
    w = prose(300)
    a = " ".join(w + w[:50])
    b = " ".join(w[:250] + prose(50) + w[:50])
    fa, fb = (minhash.weighted_shingles(words.words_of([t]).hashes, known) for t in (a, b))
    want = minhash.weighted_jaccard(fa, fb)
    assert abs((sampler(*fa) == sampler(*fb)).mean() - want) < 0.05
    assert (sampler(*fa) == sampler(*fa)).all()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b c d e f"), (None, "a b c d e f")]])
def test_small_tables(spark, rows):
    got = minhash.classes(frame(spark, rows)).collect()
    assert sorted((repr(r.doc_id), r.class_id) for r in got) == sorted((repr(i), i) for i, _ in rows)


def test_real_tables(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = QUERIES["op5_minhash"](spark, small).collect()
    assert sorted((repr(r.doc_id), r.class_id) for r in got) == plain_classes(docs)


def test_components(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("900", f"{i}") for i in range(901, 930)]
    RNG.shuffle(edges)
    got = {r.node: r.label for r in minhash.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: "000" if x < "500" else "900" for e in edges for x in e}
