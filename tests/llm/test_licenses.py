import random

import duckdb
import pytest
from oracle_check import compare
from test_words import plain

from packetloom.llm import licenses
from packetloom.llm.queries import ORACLES, QUERIES

MIT = licenses.TEXTS["mit-text"]
DOCS = [
    (1, "Released under the MIT License. The MIT\nlicense again, apache licenses, Apache-LICENSE."),
    (2, "see GNU General Public License and general public  LICENSE general public license"),
    (3, None),
    (4, ""),
    (5, "clean words only " * 2000),
    (6, "intro " * 50 + MIT + " outro"),
    (7, " ".join(w for i, w in enumerate(MIT.split()) if i % 17)),
    (8, MIT[: len(MIT) // 4]),
    (9, "K mité license mİt license mit lıcense"),
    (1, "Released under the MIT License. The MIT\nlicense again, apache licenses, Apache-LICENSE."),
    (None, "mit license"),
    (10, " ".join(["mit license"] * 500)),
]


def plain_scan(text):
    w = plain(text)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    from packetloom.llm.queries import QUERIES

    folder = str(tmp_path_factory.mktemp("docs"))
    df = spark.createDataFrame([(*d, 1, "x") for d in DOCS], "doc_id long, text string, key int, w string")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return QUERIES["op10_license_scan"](spark, folder).collect()


def test_base_places_equal_a_plain_scan(rows):
    got = sorted((repr(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows)
    assert got == sorted((repr(i), *plain_scan(t)) for i, t in DOCS)


def test_quoted_texts_are_labelled(rows):
    by_id = {r.doc_id: r for r in rows}
    assert "mit-text" in by_id[6].labels and by_id[6].score == 1.0
    assert "mit-text" in by_id[7].labels and 0.5 <= by_id[7].score < 1  # words left out: diagonals merge
    assert by_id[8].labels == "" and by_id[5].labels == "" and by_id[3].score == 0
    assert "mit-statement" in by_id[1].labels and "gpl" in by_id[2].labels


def test_real_tables_equal_a_plain_scan(spark, small):
    from packetloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op10_license_scan"](spark, small).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(d.text)


def test_a_repeated_gram_does_not_part_a_text(spark):
    """Some 3-grams of bsd-text occur twice in it; their stray votes lie between the true diagonals."""
    w = licenses.TEXTS["bsd-text"].split()
    put_in = lambda *places: " ".join(x for i, v in enumerate(w) for x in (["extra"] * (i in places) + [v]))
    places = [(32, 50), (30, 48), (29, 33, 51), (10, 47)]
    docs = spark.createDataFrame([(i, put_in(*p)) for i, p in enumerate(places)], "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        assert "bsd-text" in r.labels and r.score > 0.8


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql_states_the_same_rule(spark, tmp_path):
    """Whole texts with words put in at several places: diagonals part, stray votes lie between them."""
    rng = random.Random(11)
    texts = []
    for name, text in licenses.TEXTS.items():
        for k in range(14):
            w = text.split()
            for at in sorted(rng.sample(range(1, len(w)), 1 + k % 4), reverse=True):
                w[at:at] = [f"extra{j}" for j in range(1 + k % 3)]
            texts.append(" ".join(["before"] * (k % 5) + w + ["after"]))
        cut = text.split()
        texts.append(" ".join(cut[:31] + ["one"] + cut[31:49] + ["two"] + cut[49:]))
    texts += [" ".join(texts[:3]), "mit license " * 3, None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    out = QUERIES["op10_license_scan"](spark, str(tmp_path))
    assert compare(out, con, ORACLES["op10_license_scan"]) is None
    assert out.where("labels <> ''").count() > 0.8 * len(texts)
