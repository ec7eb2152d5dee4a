import hashlib
import re

import pytest

from packetloom.llm import secrets
from packetloom.llm.queries import QUERIES

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
PLAIN = {"assign": ASSIGN, "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
RANDOM = "Zk9+aB3dE5fG7hI9jK1LmN0pQ"
DOCS = [
    (1, 'héllo😀 PASSWORD = "abc123" token:token: abcdefgh; secret=short token=token=abcdef'),
    (2, "AKIA" + "A1" * 8 + " AKIA12 AKIAAKIA" + "B" * 12 + " " + "ab12" * 6 + " " + "ab12" * 5),
    (3, None),
    (4, ""),
    (5, "word " * 20_000 + "api_key='k" + "9" * 20 + "'"),
    (6, f"user: alice pw {RANDOM} at https://db.example.com/x"),
    (7, f"{RANDOM} alone"),
    (8, "user: alice alone"),
    (9, "https://db.example.com alone"),
    (10, "user: alice" + " x" * 200 + f" {RANDOM}"),
    (11, 'toKen: "' + "q" * 9),
    (1, 'héllo😀 PASSWORD = "abc123" token:token: abcdefgh; secret=short token=token=abcdef'),
    (None, "passwd=abcdef"),
    (12, "token=abcdef " * 3000),
]


def plain_base(text):
    text, out = text or "", []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            value, least = (m.group(2), 6) if kind == "assign" else (m.group(), {"access": 20, "hex": 24}[kind])
            if len(value) >= least:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in found).encode()).hexdigest()


def want(doc_id, text):
    found = plain_base(text)
    counts = [sum(f[3] == kind for f in found) for kind in PLAIN]
    return repr(doc_id), *counts, digest(found)


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("docs"))
    df = spark.createDataFrame([(*d, 1, "x") for d in DOCS], "doc_id long, text string, key int, spans string")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return QUERIES["op8_secret_scan"](spark, folder).collect()


def test_base_equals_a_plain_scan(rows):
    got = sorted((repr(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows)
    assert got == sorted(want(*d) for d in DOCS)


def test_weak_parts_need_their_complements(rows):
    by_id = {r.doc_id: r.spans for r in rows}
    assert [s.split(":")[0] for s in by_id[6].split(",")] == ["account", "random", "address"]
    assert all(by_id[i] == "" for i in (3, 4, 7, 8, 9, 10))


def test_real_tables_equal_a_plain_scan(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op8_secret_scan"](spark, small).collect()
    assert sorted((repr(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == sorted(want(*d) for d in docs)


def test_redaction(spark):
    df = spark.createDataFrame([DOCS[0], DOCS[4], (20, None), (21, "clean")], "doc_id long, text string")
    out = secrets.scan(df, keep=("text",))
    got = {r.doc_id: r.t for r in out.select("doc_id", secrets.redact(out["text"], out["spans"]).alias("t")).collect()}
    assert got[1] == 'héllo😀 [SECRET]" token:token: abcdefgh; secret=short [SECRET]'.replace("secret=short", "secret=short")
    assert got[5] == "word " * 20_000 + "[SECRET]'" and got[20] is None and got[21] == "clean"


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def scanned(spark, text, doc_id=1):
    df = spark.createDataFrame([(doc_id, text)], "doc_id long, text string")
    return [(s.kind, text[s.start : s.end]) for s in secrets.scan(df).first().spans]


def test_parts_inside_an_address(spark):
    key = "AKIA" + "Q7" * 8
    url = f"https://host/?access_key_id={key}&secret=abcdefgh"
    found = dict(scanned(spark, f"see {url} now"))
    assert found["address"] == url and {"access", "assign"} <= set(found)
    inside = f"https://host/{'p' * 700}?key={RANDOM}&{'z' * 700}"  # far from both ends
    assert {k for k, _ in scanned(spark, inside)} == {"random"}
    assert scanned(spark, "https://host/?page=2") == []
    # One word is no evidence for itself.
    assert scanned(spark, f"user={RANDOM}") == []


def test_rows_are_told_apart_by_id_and_text(spark):
    rows = [("a b", "token=abcdefgh"), ("a", "b token=abcdefgh"), (None, "token=abcdefgh"), ("-", "token=abcdefgh"), ("1:a", "x"), ("1", ":a x")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r.doc_id, r.text): [(s.start, s.end) for s in r.spans] for r in secrets.scan(df, keep=("text",)).collect()}
    assert got == {r: [(m.start(), m.end()) for m in ASSIGN.finditer(r[1])] for r in rows}


def test_redacted_rows_keep_all_columns(spark):
    rows = [(1, "a token=abcdefgh z", "s", 2, "k", 5), (1, "a token=abcdefgh z", "s", 2, "k", 5), (None, None, None, None, None, None), (2, "", "", 0, "", 0), (3, "clean", "s", 1, "k", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, start int, key string, __row int")
    out = secrets.redact_rows(df)
    assert out.columns == df.columns
    want = [(d, t and t.replace("token=abcdefgh", "[SECRET]"), *rest) for d, t, *rest in rows]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert secrets.redact_rows(df.limit(0)).count() == 0


def test_many_spans(spark):
    text = "token=abcdefgh " * 5000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.redact_rows(df).first().text == "[SECRET] " * 5000
