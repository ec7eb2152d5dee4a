import hashlib

import numpy as np
import pytest
from test_words import plain

from packetloom.llm import imatch, sketch, words
from packetloom.llm.queries import QUERIES

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
DOCS = [
    (5, "alpha beta gamma delta epsilon"),
    (3, None),
    (9, ""),
    (9, "tie é😀 second"),
    (9, "tie é😀 first"),
    (1, LONG),
    (2, LONG),
    (None, "no id"),
    (7, "..."),
    (5, "alpha beta gamma delta epsilon"),
]


def expected(docs):
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        out.append((repr(i), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, bucket int, fingerprint string")


@pytest.mark.parametrize("buckets", [1, 4, 300])
def test_edits_follow_the_order(spark, buckets):
    df = frame(spark, DOCS).repartition(3)
    out = imatch.compare_with_next(df, imatch.frequencies(df), buckets=buckets).collect()
    assert sorted((repr(r.doc_id), r.n_chars, r.edited_sha256) for r in out) == expected(DOCS)
    by_text = {}
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text[1, len(LONG)] == by_text[2, len(LONG)]
    assert next(r for r in out if r.doc_id == 1).near_next == 1.0


def test_one_document_and_none(spark):
    one = frame(spark, [(4, "abcd")])
    assert imatch.compare_with_next(one, imatch.frequencies(one)).first().n_chars == 4
    assert imatch.compare_with_next(one.limit(0), imatch.frequencies(one.limit(0))).count() == 0


def test_real_tables(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    out = QUERIES["op9_imatch"](spark, small).collect()
    assert sorted((repr(r.doc_id), r.n_chars, r.edited_sha256) for r in out) == expected(docs)
    assert np.mean([r.near_edited for r in out]) > np.mean([r.near_next for r in out]) + 0.15
    texts = dict(docs)
    prints = {}
    for r in out:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_plain_version_of_a_fingerprint():
    """Family by family over Python sets."""
    terms = np.unique(words.words_of([" ".join(f"t{i}" for i in range(5000))]).hashes)
    text = imatch.fingerprint(terms, "")
    for f in range(imatch.FAMILIES):
        low = {}
        for t in terms.tolist():
            m = int(words.mix(np.array([t], np.uint64) ^ imatch._SEEDS[f])[0])
            low.setdefault((m & -m).bit_length() - 1, []).append(t)
        best = max(low)
        total = np.array([sum(low[best]) % (1 << 64)], np.uint64)
        want = f"{min(best, 14):x}{int(words.mix(total)[0]) >> 48:04x}"
        assert text[16 + 5 * f : 21 + 5 * f] == want
    assert imatch.likeness(text, text) == 1.0
    half = imatch.likeness(text, imatch.fingerprint(terms[::2], ""))
    assert 0.25 < half < 0.75


def test_frequencies_are_exact_on_few_terms(spark):
    texts = ["a b c", "a b", "a a a", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    found = sketch.document_frequencies(df, "text", lambda h: h)
    assert found.documents == 5
    hashes = words.words_of(["a b c"]).hashes
    assert np.allclose(found.of(hashes), [sum(w in plain(t) for t in texts) for w in "abc"], atol=0.01)


def exact_fingerprint(text, documents):
    """By sets of terms of every document; a term of no document counts as one of a single document."""
    terms = np.unique(words.words_of([text]).hashes)
    n = np.array([max(1, sum(t in d for d in documents)) for t in terms.tolist()])
    rarity = np.log(len(documents) / n) / np.log(len(documents))
    kept = terms[(rarity >= imatch.LOW) & (rarity <= imatch.HIGH)]
    return imatch.fingerprint(kept if len(kept) else terms, text)


@pytest.mark.parametrize("buckets", [1, 7])
def test_band_by_exact_counts(spark, buckets):
    """Words of two documents stay in the band, however many different words there are."""
    docs = []
    for i in range(240):
        rare = " ".join(f"r{i // 2}x{j}" for j in range(1200))
        docs.append((i, f"the of {rare} m{i % 6} only{i} r{i // 2} " + "ab" * (i % 3)))
    df = frame(spark, docs).repartition(3)
    known = imatch.frequencies(df)
    out = sorted(imatch.compare_with_next(df, known, buckets=buckets).collect(), key=lambda r: r.doc_id)
    documents = [set(words.words_of([t]).hashes.tolist()) for _, t in docs]
    for i in range(0, len(docs), 37):
        text, following = docs[i][1], docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        assert out[i].fingerprint == exact_fingerprint(text, documents)
        assert out[i].edited_fingerprint == exact_fingerprint(text[: len(text) - half] + following[:half], documents)


def test_words_cut_by_an_edit_are_counted(spark):
    """'the|rest' is cut to 'the', a word of two other documents; a cut that is no word is as rare as can be."""
    docs = [(1, "aa bb therest qqqqq"), (2, "xx yy zz"), (3, "the xx aa"), (4, "the yy aa"), (5, "zz bb")]
    df = frame(spark, docs)
    documents = [set(words.words_of([t]).hashes.tolist()) for _, t in docs]
    out = {r.doc_id: r for r in imatch.compare_with_next(df, imatch.frequencies(df)).collect()}
    for (i, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        assert out[i].edited_fingerprint == exact_fingerprint(text[: len(text) - half] + following[:half], documents)


def test_fingerprints_of_rows(spark):
    df = frame(spark, DOCS).repartition(3)
    known = imatch.frequencies(df)
    want = {r.fingerprint for r in imatch.compare_with_next(df, known).collect()}
    rows = imatch.fingerprints(df, known).collect()
    assert len(rows) == len(DOCS) and {r.fingerprint for r in rows} == want


@pytest.mark.parametrize("buckets", [1, 5])
def test_own_counts_equal_given_ones(spark, monkeypatch, buckets):
    """Counted by ranges or looked up in a table, also where a range hands its terms on early."""
    rng = np.random.default_rng(8)
    docs = [(int(i), " ".join(f"w{int(k)}" for k in rng.zipf(1.4, rng.integers(0, 60)) % 400)) for i in rng.permutation(90)]
    docs += [(3, "w1 w2 again"), (None, "w1 nothing else"), (None, None), (3, "w1 w2 again")]
    df = frame(spark, docs).repartition(3)
    given = sorted(map(str, imatch.compare_with_next(df, imatch.frequencies(df), buckets=buckets).collect()))
    assert sorted(map(str, imatch.compare_with_next(df, buckets=buckets).collect())) == given
    documents = [set(words.words_of([t or ""]).hashes.tolist()) for _, t in docs]
    prints = {exact_fingerprint(t or "", documents) for _, t in docs}
    assert {r.fingerprint for r in imatch.compare_with_next(df, buckets=buckets).collect()} == prints


def test_likeness_of_rows_is_that_of_plain_fingerprints(spark):
    docs = [(i, f"a{i % 3} b{i % 5} c{i % 7} d{i} shared words of all e{i // 2}") for i in range(40)]
    out = {r.doc_id: r for r in imatch.compare_with_next(frame(spark, docs)).collect()}
    documents = [set(words.words_of([t]).hashes.tolist()) for _, t in docs]
    families = lambda p: [p[k : k + 5] for k in range(16, len(p), 5)]
    for (i, text), (j, following) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = exact_fingerprint(text[: len(text) - half] + following[:half], documents)
        own, after = exact_fingerprint(text, documents), exact_fingerprint(following, documents)
        for got, other in ((out[i].near_edited, edited), (out[i].near_next, after)):
            same = sum(x == y for x, y in zip(families(own), families(other))) / imatch.FAMILIES
            assert got == (1.0 if own[:16] == other[:16] else same)
