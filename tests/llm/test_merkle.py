import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm import merkle

KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("text", T.StringType())])


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climbed(nodes, proofs):
    """The root of ``nodes``; each list in ``proofs`` gets the siblings of its node."""
    owners = [[p] for p in proofs]
    while len(nodes) > 1:
        ups, up_owners = [], []
        for i in range(0, len(nodes), 3):
            run = nodes[i : i + 3]
            for j in range(len(run)):
                for proof in owners[i + j] if isinstance(owners[i + j], list) else []:
                    proof.append(("".join(run[:j]), "".join(run[j + 1 :])))
            ups.append(sha(*run))
            up_owners.append([p for o in owners[i : i + 3] for p in o])
        nodes, owners = ups, up_owners
    return nodes[0]


def plain(rows):
    """(doc_id, leaf, subroot, root, proof) by the definition."""
    groups = {}
    for doc_id, source, text in rows:
        groups.setdefault(source, []).append((doc_id, sha(field(doc_id), field(source), field(text))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found, subroots = [], []
    for source in order:
        leaves = sorted(groups[source], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        proofs = [[] for _ in leaves]
        subroots.append(climbed([x[1] for x in leaves], proofs))
        found.append([(doc_id, leaf, subroots[-1], proof) for (doc_id, leaf), proof in zip(leaves, proofs)])
    tops = [[] for _ in order]
    root = climbed(subroots, tops)
    return sorted(
        ((d, leaf, sub, root, proof + top) for part, top in zip(found, tops) for d, leaf, sub, proof in part), key=repr
    )


def built(spark, rows):
    df = spark.createDataFrame(rows, KIND).withColumn("leaf", F.lit("mine")).withColumn("pos", F.lit(3))
    leaf = merkle.digest(*(merkle.field(F.col(c)) for c in ("doc_id", "source", "text")))
    return merkle.build(df, leaf, F.col("source"), F.col("doc_id"), df.columns)


def read(out):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.proof]) for r in out.collect()), key=repr)


ODD = [(1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (None, "a", None), (None, "a", ""), (2, None, "x"), (3, "", "\n"), (4, "ä", "long " * 9000)]


@pytest.mark.parametrize("n", [0, 1, 3, 30])
def test_odd_rows_equal_the_definition(spark, n):
    rows = ODD + [(100 + i, random.Random(i).choice(["a", "b", None, "é"]), f"text {i % 7}") for i in range(n)]
    assert read(merkle.prove(built(spark, rows), block=8)) == plain(rows)


def test_one_leaf_and_none(spark):
    leaf = sha(field(7), field(None), field("only"))
    assert read(merkle.prove(built(spark, [(7, None, "only")]))) == [(7, leaf, leaf, leaf, [])]
    empty = built(spark, [])
    assert empty.root is None and merkle.prove(empty).count() == 0


def test_many_levels_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", str(i)) for i in range(700)]
    made = built(spark, rows)
    assert read(merkle.prove(made, block=50)) == plain(rows)
    # Any subset of the leaves can be proven, from fewer nodes than all of its proofs hold.
    few = merkle.prove(made, made.leaves.where("pos % 11 = 0"), block=100)
    want = {r[1]: r for r in plain(rows)}
    got = read(few)
    assert got and all(want[r[1]] == r for r in got)
    assert few.select("pos").distinct().collect() == [(3,)]  # the caller's own column


def test_multiproof_is_minimal():
    rng = np.random.default_rng(1)
    for n in [1, 2, 3, 4, 9, 10, 28, 100]:
        known = np.sort(rng.choice(n, min(n, 5), replace=False))
        asked = {(level, p) for level, places in merkle.missing(known, n) for p in places.tolist()}
        level, size, have = 0, n, set(known.tolist())
        while size > 1:
            up = set()
            for parent in {p // 3 for p in have}:
                run = range(parent * 3, min(size, parent * 3 + 3))
                assert all(p in have or (level, p) in asked for p in run)  # enough
                up.add(parent)
            assert not {(level, p) for p in have} & asked  # nothing that it has or can derive
            assert {p for lv, p in asked if lv == level} <= {p for q in up for p in range(3 * q, 3 * q + 3)}
            level, have, size = level + 1, up, -(-size // 3)


def test_query_finds_exactly_the_changed_texts(spark, small):
    from packetloom.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    out = QUERIES["op13_merkle_manifest"](spark, small).collect()
    assert len(out) == len(texts)
    for r in out:
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (texts[r.doc_id] or "")
        assert r.verified != changed and (r.folded_root == r.root) == r.verified
