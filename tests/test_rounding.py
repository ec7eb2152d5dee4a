import pytest
from pyspark.sql import functions as F

from packetloom.functions.rounding import round_ratio, round_share


@pytest.fixture(scope="module")
def pairs(spark):
    """All shares k/n with n <= 260."""
    n = spark.range(1, 261).withColumnRenamed("id", "n")
    return n.select("n", F.explode(F.sequence(F.lit(0), "n")).alias("k"))


@pytest.mark.parametrize("digits, fn", [(2, round_share), (2, round_ratio), (4, round_ratio), (1, round_share)])
def test_shares_round_like_binary_half_even(pairs, digits, fn):
    rows = pairs.select("k", "n", fn(F.col("k"), F.col("n"), digits).alias("r")).collect()
    assert [(r.k, r.n, r.r) for r in rows if r.r != round(r.k / r.n, digits)] == []


def test_large_means(spark):
    rows = spark.range(1, 4000).select(
        (F.col("id") * 7919 % 100003 * F.pow(F.lit(10), F.col("id") % 6).cast("bigint")).alias("k"),
        F.pow(F.lit(2), F.col("id") % 9).cast("bigint").alias("n"),
        F.lit(5).alias("five"),
    )
    rows = rows.withColumn("n", F.col("n") * F.when(F.col("k") % 2 == 0, F.col("five")).otherwise(1))
    out = rows.select("k", "n", round_ratio(F.col("k"), F.col("n"), 2).alias("r")).collect()
    assert [(r.k, r.n, r.r) for r in out if r.r != round(r.k / r.n, 2)] == []


def test_empty_denominator(spark):
    row = spark.range(1).select(
        round_ratio(F.lit(3), F.lit(0), 2).alias("a"), round_share(F.lit(0), F.lit(0), 2).alias("b")
    ).first()
    assert (row.a, row.b) == (0.0, 0.0)
