import random
from collections import Counter
from itertools import combinations
from math import comb

import pytest
from pyspark.sql import functions as F

from packetloom.operators import patterns
from packetloom.plans.views import connection_view
from packetloom.sources.artifacts import ArtifactStore, MissingArtifactError

ROW = "protocol_type string, service string, flag string, logged_in int, is_guest_login int, label string"


def planted(spark):
    rows = [("tcp", "private", "S0", 0, 0, "neptune")] * 60 + [("udp", "http", "SF", 1, 0, "normal")] * 80
    rows += [("tcp", "smtp", "SF", 1, i % 2, "normal") for i in range(50)] + [("tcp", "private", "RSTR", 0, 0, "satan")] * 10
    return spark.createDataFrame(rows, ROW)


def test_one_item_per_column_and_label(spark):
    (r,) = patterns.transactions(planted(spark).limit(1)).collect()
    assert r["items"] == [
        "protocol_type=tcp", "service=private", "flag=S0", "logged_in=0", "is_guest_login=0", "label=dos",
    ]


def test_null_and_unmapped(spark):
    row = spark.createDataFrame([("tcp", None, "SF", 1, 0, "novel")], ROW)
    (r,) = patterns.transactions(row).collect()
    assert r["items"] == ["protocol_type=tcp", "service=nan", "flag=SF", "logged_in=1", "is_guest_login=0"]


def test_planted_rule(spark):
    rules = patterns.mine_rules(planted(spark)).collect()
    assert 0 < len(rules) <= 50
    assert [r.lift for r in rules] == sorted((r.lift for r in rules), reverse=True)
    (found,) = [r for r in rules if r.antecedents == "flag=SF" and r.consequents == "label=normal"]
    assert found.confidence == 1.0 and found.support == pytest.approx(130 / 200) and found.lift == pytest.approx(200 / 130)
    (probe,) = [r for r in rules if r.antecedents == "flag=RSTR, service=private"]
    assert (probe.confidence, probe.lift) == (1.0, 20.0)
    assert all("label=" not in r.antecedents and "," not in r.consequents for r in rules)


def test_grouping_sets_equal_fp_growth(spark, small):
    rows = connection_view(spark, small).withColumn("label", F.when(F.col("seq") % 10 == 0, "novel").otherwise(F.col("label")))
    key = lambda df: sorted((tuple(r["items"]), r["rows"], round(r["support"], 12)) for r in df.collect())
    a = key(patterns.frequent_itemsets(rows))
    assert a and a == key(patterns.frequent_itemsets_general(patterns.transactions(rows)))


def test_rules_round_trip(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path))
    with pytest.raises(MissingArtifactError):
        store.load_rules()
    rules = patterns.mine_rules(planted(spark))
    store.save_rules(rules)
    top = store.load_rules()
    assert top.collect() == rules.limit(20).collect() and top.count() <= 20


def plain_itemsets(baskets, min_support, most):
    counts = Counter()
    for b in baskets:
        items = sorted({i for i in b or [] if i is not None})
        for size in range(1, most + 1):
            counts.update(combinations(items, size))
    return sorted((list(c), n) for c, n in counts.items() if n / len(baskets) >= min_support)


@pytest.mark.parametrize("chunk", [1_000_000, 7])
def test_general_itemsets_equal_counting_all(spark, monkeypatch, chunk):
    monkeypatch.setattr(patterns, "MOST_CANDIDATES", chunk)
    rng = random.Random(1)
    baskets = [[rng.choice("abcdefghij") for _ in range(rng.randrange(9))] for _ in range(150)]
    baskets += [None, [], [None], [None, "a", "a"], ["a"]]
    df = spark.createDataFrame([(b, 1) for b in baskets], "items array<string>, rows int")
    for support, most in ((0.05, 4), (0.2, 2), (0.1, 1), (0.9, 3)):
        got = patterns.frequent_itemsets_general(df, support, most).collect()
        assert sorted((r["items"], r.rows) for r in got) == plain_itemsets(baskets, support, most)
        assert all(r.support == r.rows / len(baskets) for r in got)
    assert patterns.frequent_itemsets_general(df.limit(0)).count() == 0


def test_long_baskets_end(spark):
    """Forty items that all go together: mining every length would give 2 ** 40 sets."""
    items = [f"i{k:02d}" for k in range(40)]
    df = spark.range(500).select(F.array(*map(F.lit, items)).alias("items"))
    got = patterns.frequent_itemsets_general(df, 0.5, 4)
    assert got.groupBy(F.size("items").alias("n")).count().orderBy("n").collect() == [(k, comb(40, k)) for k in range(1, 5)]
    assert got.where("rows != 500").count() == 0
