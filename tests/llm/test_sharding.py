from collections import Counter

import pytest

from packetloom.llm import sharding


def plain_table(weights, slots):
    """The filling rule, shard by shard with whole preference lists."""
    names = sorted(weights)
    prefs = {n: [int(x) for x in sharding.preference(n, slots)] for n in names}
    credit, owner = dict.fromkeys(names, 0.0), [None] * slots
    while None in owner:
        for n in names:
            credit[n] += weights[n] / max(weights.values())
            if credit[n] >= 1 and None in owner:
                credit[n] -= 1
                owner[next(s for s in prefs[n] if owner[s] is None)] = n
    return owner


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 2.0, "b": 1.0, "c": 0.5}])
def test_table_follows_the_rule(weights):
    assert sharding.fill_table(weights, 101) == plain_table(weights, 101)


def test_shares_and_moves():
    names = [f"s{i}" for i in range(20)]
    table = sharding.fill_table(names, 2003)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.fill_table(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(table, fewer) if a != "s19")
    assert moved < 0.2 * 2003
    with pytest.raises(ValueError):
        sharding.fill_table(names, 2004)


def test_placement(spark):
    rows = [(i % 50 if i % 3 else None, i, "x") for i in range(3000)] + [(7, 1, "x")] * 2
    df = spark.createDataFrame(rows, "k long, i long, slot string").repartition(3)
    shards = ["a", "b", "c", "d"]
    table = sharding.fill_table(shards, 101)
    got = sharding.place(df, "k", shards, slots=101).collect()
    assert len(got) == len(rows) and all(table[r.slot] == r.shard for r in got)
    assert all(len({r.shard for r in got if r.k == k}) == 1 for k in [None, *range(50)])
    spread = sharding.place(df, "k", shards, spread_by="i", slots=101).collect()
    assert len(spread) == len(rows)
    assert len({r.slot for r in spread if r.k is None}) == 2  # a third of the rows on 4 shards: two parts
    assert {(r.k, r.i, r.shard) for r in spread if r.k is not None} == {(r.k, r.i, r.shard) for r in got if r.k is not None}
    assert sharding.place(df.limit(0), "k", shards, spread_by="i", slots=101).count() == 0
