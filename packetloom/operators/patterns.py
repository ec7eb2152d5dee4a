"""Association rules "traffic pattern -> class"."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.labels import attack_category
from packetloom.session import materialize

# Item columns, thresholds and report sizes.
ITEM_COLUMNS = ["protocol_type", "service", "flag", "logged_in", "is_guest_login"]
LABEL_PREFIX = "label="
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.7
MAX_ITEMS = 4
TOP_RULES = 50
REPORTED_RULES = 20
# Candidates that are counted in one scan (16 bytes each for four items).
MOST_CANDIDATES = 1_000_000


def _item(name: str) -> Column:
    return F.concat(F.lit(f"{name}="), F.coalesce(F.col(name).cast("string"), F.lit("nan")))


def _label_item() -> Column:
    # Labels outside the vocabulary give no item.
    return F.concat(F.lit(LABEL_PREFIX), attack_category(F.col("label")))


def transactions(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One array of ``column=value`` items per row, the class item last."""
    items = F.array_compact(F.array(*[_item(c) for c in ITEM_COLUMNS], _label_item()))
    return df.select(*(keep or []), items.alias("items"))


def row_patterns(df: DataFrame) -> DataFrame:
    """Distinct item combinations with their row counts.

    Each column gives one item per row, so the table reduces to a few thousand
    combinations while it is scanned; all mining runs on those.
    """
    named = df.select(*[_item(c).alias(c) for c in ITEM_COLUMNS], _label_item().alias("label"))
    return named.groupBy(*ITEM_COLUMNS, "label").agg(F.count(F.lit(1)).alias("rows"))


def itemset_counts(patterns: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """items (sorted array), rows for every item combination of up to ``max_items``."""
    columns = [*ITEM_COLUMNS, "label"]
    sets = [list(c) for size in range(1, max_items + 1) for c in combinations(columns, size)]
    grouped = patterns.groupingSets(sets, *columns).agg(F.sum("rows").alias("rows"), F.grouping_id().alias("gid"))
    # A grouping set that includes the class says nothing about rows without one.
    label_used = F.col("gid").bitwiseAND(1) == 0
    full = grouped.where(~label_used | F.col("label").isNotNull())
    return full.select(F.array_sort(F.array_compact(F.array(*columns))).alias("items"), "rows")


def frequent_itemsets(df: DataFrame, min_support: float = MIN_SUPPORT, max_items: int = MAX_ITEMS) -> DataFrame:
    """items, rows, support of the itemsets that reach ``min_support``."""
    patterns = materialize(row_patterns(df), "patterns")
    return _frequent(itemset_counts(patterns, max_items), patterns.agg(F.sum("rows").alias("total")), min_support)


def _frequent(counts: DataFrame, total: DataFrame, min_support: float) -> DataFrame:
    at = F.lit(0).alias("at")
    joined = counts.select("*", at).join(F.broadcast(total.select("total", at)), "at").drop("at")
    supported = joined.withColumn("support", F.col("rows") / F.col("total"))
    return supported.where(F.col("support") >= min_support).select("items", "rows", "support")


def frequent_itemsets_general(
    baskets: DataFrame, min_support: float = MIN_SUPPORT, max_items: int = MAX_ITEMS
) -> DataFrame:
    """The same for arbitrary baskets (``items`` arrays), one size of itemsets after the other, up to ``max_items``.

    Sets of k items are candidates only if all their subsets of k - 1 items are frequent.  Candidates form a prefix
    trie that goes to all tasks, at most ``MOST_CANDIDATES`` at a time; more take further scans, not more memory.
    Tasks count whole batches of baskets at once and hand on one number for each candidate.  Null items and repeats in
    a basket do not count.  The frequent items and sets of one size are on the driver.
    """
    items = F.array_distinct(F.array_compact("items"))
    named = baskets.select(F.coalesce(items, F.array().cast(baskets.schema["items"].dataType)).alias("items"))
    total = named.count()
    singles = named.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("rows"))
    known = [tuple(r) for r in singles.where(F.col("rows") / F.lit(max(total, 1)) >= min_support).orderBy("item").collect()]
    spark = baskets.sparkSession
    kind = f"items {named.schema['items'].dataType.simpleString()}, rows long"
    names = [name for name, _ in known]
    found = [([name], rows) for name, rows in known]
    sets = np.arange(len(names), dtype=np.int32)[:, None]
    # Only frequent items, as numbers; the same for every size.
    coded = materialize(_coded(named, names), "coded-baskets") if max_items > 1 and len(names) > 1 else None
    while coded is not None and len(sets) > 1 and sets.shape[1] < max_items:
        frequent = []
        for trie in _candidates(sets):
            counts = _counted(coded, trie, len(names)).where(F.col("rows") / F.lit(total) >= min_support).toArrow()
            at, rows = counts.column("candidate").to_numpy(), counts.column("rows").to_numpy()
            order = np.argsort(at)
            frequent.append(trie[at[order]])
            found += [([names[i] for i in c], int(n)) for c, n in zip(frequent[-1].tolist(), rows[order].tolist())]
        sets = np.concatenate(frequent) if frequent else sets[:0]
    counts = spark.createDataFrame(found, kind).select(F.array_sort("items").alias("items"), "rows")
    return counts.withColumn("support", F.col("rows") / F.lit(total))


def _candidates(sets: np.ndarray) -> Iterator[np.ndarray]:
    """Sets of one more item in lexicographic order, in chunks; ``sets`` are the frequent ones (rows, ascending)."""
    have = {s.tobytes() for s in sets}
    size = sets.shape[1]
    held: list[np.ndarray] = []
    count = 0
    begin = 0
    while begin < len(sets):
        # Sets that differ in their last item only.
        same = (sets[begin:, :-1] == sets[begin, :-1]).all(1)
        end = begin + (int(np.argmin(same)) if not same.all() else len(same))
        for i in range(begin, end - 1):
            more = np.hstack([np.repeat(sets[i : i + 1], end - i - 1, 0), sets[i + 1 : end, -1:]])
            for left_out in range(size - 1):
                rest = np.ascontiguousarray(np.delete(more, left_out, 1))
                more = more[[r.tobytes() in have for r in rest]]
            held.append(more)
            count += len(more)
            if count >= MOST_CANDIDATES:
                yield np.concatenate(held)
                held, count = [], 0
        begin = end
    if count:
        yield np.concatenate(held)


def _coded(baskets: DataFrame, names: list) -> DataFrame:
    """Baskets as ascending numbers of the given items; baskets with fewer than two of them cannot count again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            value = pc.index_in(lists.flatten(), pa.array(names, lists.type.value_type))
            row = pc.list_parent_indices(lists)
            known = pc.is_valid(value)
            row, value = (np.asarray(x.filter(known)).astype(np.int64) for x in (row, value))
            order = np.lexsort((value, row))
            sizes = np.bincount(row, minlength=batch.num_rows)
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(value[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([out.filter(pa.array(sizes > 1))], ["items"])

    return baskets.select("items").mapInArrow(run, "items array<int>")


def _counted(coded: DataFrame, trie: np.ndarray, items: int) -> DataFrame:
    """(candidate, rows): in how many baskets each row of ``trie`` lies."""
    heads = np.flatnonzero(np.concatenate([[True], (trie[1:, :-1] != trie[:-1, :-1]).any(1)]))
    ends = np.append(heads[1:], len(trie))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(trie), np.int64)
        for batch in batches:
            lists, n = batch.column(0), batch.num_rows
            if n == 0:
                continue
            # One row of bits for each item: in which baskets of the batch it is.
            bits = np.zeros((items, (n + 63) // 64 * 64), bool)
            bits[np.asarray(lists.flatten()), np.asarray(pc.list_parent_indices(lists))] = True
            bits = np.packbits(bits, axis=1).view(np.uint64)
            stack: list[np.ndarray] = []
            path: list[int] = []
            for begin, end in zip(heads.tolist(), ends.tolist()):
                prefix = trie[begin, :-1].tolist()
                shared = next((k for k, (a, b) in enumerate(zip(prefix, path)) if a != b), min(len(prefix), len(path)))
                del stack[shared:]
                for item in prefix[shared:]:
                    stack.append(bits[item] & stack[-1] if stack else bits[item])
                path = prefix
                counts[begin:end] += np.bitwise_count(bits[trie[begin:end, -1]] & stack[-1]).sum(1, dtype=np.int64)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["candidate", "n"])

    return coded.mapInArrow(run, "candidate long, n long").groupBy("candidate").agg(F.sum("n").alias("rows"))


def association_rules(itemsets: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules with a single class item as consequent and no class item before it.

    Itemsets are few (bounded by item combinations, not rows), so both
    self-joins are joins of small aggregates.
    """
    is_label = lambda item: item.startswith(LABEL_PREFIX)
    split = itemsets.select(
        "rows",
        "support",
        F.filter("items", lambda i: ~is_label(i)).alias("left"),
        F.filter("items", is_label).alias("right"),
    )
    whole = split.where((F.size("right") == 1) & (F.size("left") > 0))
    left = split.where(F.size("right") == 0).select("left", F.col("rows").alias("left_rows"))
    right = split.where(F.size("left") == 0).select("right", F.col("support").alias("right_support"))
    confidence = F.col("rows") / F.col("left_rows")
    return (
        whole.join(left, "left")
        .join(right, "right")
        .withColumn("confidence", confidence)
        .where(F.col("confidence") >= min_confidence)
        .select(
            F.array_join("left", ", ").alias("antecedents"),
            F.array_join("right", ", ").alias("consequents"),
            "support",
            "confidence",
            (F.col("confidence") / F.col("right_support")).alias("lift"),
        )
    )


def top_rules(rules: DataFrame, n: int = TOP_RULES) -> DataFrame:
    """Best rules by lift; ties by confidence, then text."""
    order = [F.desc("lift"), F.desc("confidence"), F.asc("antecedents"), F.asc("consequents")]
    return rules.orderBy(*order).limit(n)


def mine_rules(df: DataFrame, n: int = TOP_RULES) -> DataFrame:
    return top_rules(association_rules(frequent_itemsets(df)), n)
