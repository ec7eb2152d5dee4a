import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from packetloom.llm import packing
from packetloom.llm.queries import QUERIES


def one_by_one(lengths, openable, costs):
    """Room left in each bin after best fit over single pieces and single bins."""
    bins = []
    ordered = sorted(lengths, reverse=True)
    for i, length in enumerate(ordered):
        fits = [b for b in bins if b["room"] >= length]
        if fits:
            b = min(fits, key=lambda b: b["room"])
        else:
            left = sum(x == length for x in ordered[i:])
            size = min(
                (s for s in openable if s >= length), key=lambda s: (costs[s] / (min(left, s // length) * length), s)
            )
            b = {"room": size}
            bins.append(b)
        b["room"] -= length
    return Counter(b["room"] for b in bins)


@pytest.mark.parametrize("seed", range(30))
def test_classes_equal_single_pieces(seed):
    rng = random.Random(seed)
    sizes = sorted(rng.sample([4, 7, 8, 16, 25, 32, 40], 3))
    costs = {s: s * (1 + s / 50) + 1 for s in sizes}
    lengths = [rng.randint(1, rng.choice([3, sizes[-1]])) for _ in range(rng.randint(0, 120))]
    openable = sorted({sizes[-1], rng.choice(sizes)})
    # Which of several bins with equal room takes a piece is open, so rooms are compared, not contents.
    packed = packing.pack_classes(Counter(lengths), openable, costs)
    rooms, used = Counter(), Counter()
    for b in packed:
        rooms[b.room] += b.count
        for length, n in b.contents:
            used[length] += n * b.count
    assert used == Counter(lengths)
    assert rooms == one_by_one(lengths, openable, costs)


def test_joint_choice_is_the_cheapest():
    counts = {3: 50, 9: 20, 17: 5}
    costs = {8: 8.5, 16: 18.0, 32: 40.0}
    cost = lambda some: packing.total_cost(packing.shrink(packing.pack_classes(counts, some, costs), [8, 16, 32]), costs)
    best = packing.choose_openable(counts, costs)
    assert cost(best) == min(cost(s) for s in ([32], [8, 32], [16, 32], [8, 16, 32]))


def check(rows, lengths, sizes):
    """Every token of every row is in one bin, bins do not overlap or overflow, and none could be smaller."""
    tokens, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        tokens[r.doc_id].append((r.piece_start, r.piece_length))
        if r.piece_length:
            bins[r.bin_id].append((r.bin_offset, r.piece_length, r.bin_size))
        else:
            assert r.bin_id is None
    assert {k: sum(n for _, n in v) for k, v in tokens.items()} == lengths
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(parts, parts[1:]))
        used = parts[-1][0] + parts[-1][1]
        assert {p[2] for p in parts} == {min(s for s in sizes if s >= used)}


def test_rows(spark):
    rng = random.Random(5)
    given = [(i, rng.choice([rng.randint(0, 60), 7]), "x") for i in range(900)] + [(1000, None, "x"), (1001, -3, "x"), (1002, 10_000, None)]
    df = spark.createDataFrame(given, "doc_id long, n int, piece_start string").repartition(5)
    costs = {8: 8.5, 16: 18.0, 32: 40.0}
    out = packing.pack(df, F.col("n"), costs=costs, shard_rows=200).collect()
    check(out, {i: max(0, n or 0) for i, n, _ in given}, [8, 16, 32])
    twice = packing.pack(df.unionByName(df), F.col("n"), costs=costs).groupBy("doc_id").agg(F.sum("piece_length").alias("n"))
    assert {r.doc_id: r.n for r in twice.collect()} == {i: 2 * max(0, n or 0) for i, n, _ in given}
    assert packing.pack(df.limit(0), F.col("n")).count() == 0


def test_real_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    out = QUERIES["op3_best_fit"](spark, small).collect()
    check(out, {d.doc_id: len(d.text.split()) + 1 for d in docs}, list(packing.SIZES))
    filled = sum(r.piece_length for r in out) / sum({r.bin_id: r.bin_size for r in out}.values())
    assert filled > 0.97
