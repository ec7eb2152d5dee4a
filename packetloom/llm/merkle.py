"""Merkle manifest of a dataset: a tree of digests for each group, a tree over the groups' roots, octopus multiproofs.

Rows become leaves, leaves of a group stand in order, and every three consecutive nodes (the last run may be shorter,
even a single node) become the digest of their concatenated digests until one is left.  The groups' roots, in order of
the groups, are the leaves of one more tree, whose root stands for the whole table.

``prove`` deals the leaves to be proven into blocks.  A block first names the least set of nodes that it cannot derive
from its own leaves: at each level the children of the parents it can reach, less those it has.  These coordinates are
fetched with one join for all blocks; a block then derives the inner nodes its leaves share once, and spells out the
proof of each leaf from them.

Odd rows: a null value is the field ``-`` and differs from an empty text; groups may be null, they come first; rows with
a null order come first in their group; rows with equal order stand in order of their digests, so repeated rows are
leaves of their own with their own proofs; an empty table has no rows and the root ``None``.  Columns of the input that
share names with the results are replaced, no others are touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.layout import dense_sequence, small_side
from packetloom.session import materialize

ARITY = 3
# Levels that one group builds: 3 ** 7 = 2187 digests, 140 KB.
LEVELS = 7
# Leaves that are proven together.
BLOCK = 1024
# Name of the tree over the groups' roots; groups are "n" (null) and "s" + their text.
TOP = "t"


def field(value: Column) -> Column:
    """A value so that fields can follow each other: ``-`` for null, else its length in bytes, a colon and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts).cast("binary"), 256)


@dataclass(frozen=True)
class Manifest:
    leaves: DataFrame  # tree, pos, leaf, n (leaves of the tree), top (the tree's place), trees (how many), row
    nodes: DataFrame  # tree, level (0: leaves), place, digest, n (nodes of that level)
    root: str | None


def build(df: DataFrame, leaf: Column, group: Column, order: Column, carry: list[str]) -> Manifest:
    """The trees over all rows; ``carry`` are the columns that proofs bring along.

    Digests are shuffled, never the columns they are made of.
    """
    tree = F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit("n"))
    rows = df.select(tree.alias("tree"), order.alias("rank"), leaf.alias("leaf"), F.struct(*carry).alias("row"))
    placed = dense_sequence(rows, ["rank", "leaf"], by=["tree"], name="pos").drop("rank")
    counts = materialize(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "merkle-groups")
    groups = materialize(dense_sequence(counts, ["tree"], name="top").withColumn("trees", F.lit(counts.count())), "merkle-trees")
    leaves = materialize(placed.join(small_side(groups), "tree"), "merkle-leaves")
    low = _grown(leaves.select("tree", "n", F.col("pos").alias("place"), F.col("leaf").alias("digest")))
    roots = low.where("n = 1").select("tree", "digest").join(small_side(groups.drop("n")), "tree")
    high = _grown(roots.select(F.lit(TOP).alias("tree"), F.col("trees").alias("n"), F.col("top").alias("place"), "digest"))
    root = high.where("n = 1").first()
    return Manifest(leaves, low.unionByName(high), root["digest"] if root else None)


def _grown(leaves: DataFrame) -> DataFrame:
    """All nodes over the leaves (tree, n, place, digest); seven levels in each round, so a few rounds for any size."""
    base = leaves.withColumn("level", F.lit(0))
    found = None
    while True:
        # The lowest level of a later round is the highest of the round before.
        grown = materialize(_levels(base).where("step > 0" if found is not None else "true"), "merkle-nodes")
        found = grown if found is None else found.unionByName(grown)
        base = grown.where((F.col("step") == LEVELS) & (F.col("n") > 1)).drop("step")
        if base.isEmpty():
            return found.drop("step")


def _levels(base: DataFrame) -> DataFrame:
    """Nodes of the levels above (tree, n, level, place, digest) up to a tree's root or seven levels."""
    span = ARITY**LEVELS
    block = F.call_function("div", F.col("place"), F.lit(span))
    runs = base.groupBy("tree", "n", "level", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("nodes")  # span of them at most
    )

    def parents(nodes: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(nodes), F.lit(ARITY))
        return F.transform(firsts, lambda i: F.sha2(F.concat_ws("", F.slice(nodes, i, ARITY)).cast("binary"), 256))

    left = lambda step: F.ceil(F.col("n") / F.pow(F.lit(float(ARITY)), step))  # noqa: E731  nodes of the tree after so many levels
    levels = F.aggregate(
        F.sequence(F.lit(1), F.lit(LEVELS)),
        F.array(F.transform("nodes", lambda x: x["digest"])),
        lambda done, step: F.when(left(step - 1) > 1, F.concat(done, F.array(parents(F.element_at(done, -1))))).otherwise(done),
    )
    each = runs.select("tree", "n", "level", "block", F.posexplode(levels).alias("step", "digests"))
    nodes = each.select("*", F.posexplode("digests").alias("at", "digest"))
    first = F.col("block") * F.pow(F.lit(float(ARITY)), LEVELS - F.col("step")).cast("long")
    return nodes.select(
        "tree",
        (F.col("level") + F.col("step")).alias("level"),
        (first + F.col("at")).alias("place"),
        "digest",
        left(F.col("step")).cast("long").alias("n"),
        "step",
    )


def missing(known: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """By level, the places that the root needs besides what follows from ``known`` places of n leaves."""
    level, known = 0, np.unique(known)
    while n > 1:
        parents = np.unique(known // ARITY)
        children = (parents[:, None] * ARITY + np.arange(ARITY)).ravel()
        yield level, np.setdiff1d(children[children < n], known)
        level, known, n = level + 1, parents, -(-n // ARITY)


def prove(manifest: Manifest, leaves: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The proofs of ``leaves`` (rows of ``manifest.leaves``; default: all).

    Gives the carried columns, leaf, subroot, root and proof: from the leaf up, the digests that stand before and after
    the own node in its run.  At most ``block`` leaves and some 3 nodes per leaf and level are in memory.
    """
    chosen = manifest.leaves if leaves is None else leaves
    chosen = chosen.withColumn("block", F.call_function("div", F.col("pos"), F.lit(block)))

    def ask(table: pa.Table) -> pa.Table:
        tree, n, top, trees, at = (table.column(c)[0].as_py() for c in ("tree", "n", "top", "trees", "block"))
        own = list(missing(table.column("pos").to_numpy(), n))
        above = list(missing(np.array([top]), trees))
        of = [name for name, found in ((tree, own), (TOP, above)) for _, places in found for _ in places]
        levels = [level for level, places in own + above for _ in places]
        places = np.concatenate([np.zeros(0, np.int64), *(p for _, p in own + above)])
        return pa.table(
            {
                "tree": pa.array([tree] * len(of), pa.string()),
                "block": pa.array([at] * len(of), pa.int64()),
                "of": pa.array(of, pa.string()),
                "level": pa.array(levels, pa.int32()),
                "place": pa.array(places, pa.int64()),
            }
        )

    wanted = chosen.select("tree", "block", "pos", "n", "top", "trees").groupBy("tree", "block").applyInArrow(
        ask, "tree string, block long, of string, level int, place long"
    )
    nodes = manifest.nodes.select(F.col("tree").alias("of"), "level", "place", "digest")
    fetched = wanted.join(nodes, ["of", "level", "place"]).select("tree", "block", "of", "level", "place", "digest")

    row = manifest.leaves.schema["row"].dataType
    texts = [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root")]
    step = T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])
    kind = T.StructType([T.StructField("row", row), *texts, T.StructField("proof", T.ArrayType(step))])
    both = chosen.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block"))
    out = both.applyInArrow(_expand, kind)
    results = ["leaf", "subroot", "root", "proof"]
    return out.select(*[F.col("row")[c].alias(c) for c in row.names if c not in results], *results)


def _expand(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
    """The leaves of one block with their proofs, from the fetched nodes."""
    given: dict[tuple[bool, int], dict[int, str]] = {}
    for of, level, place, value in zip(*(fetched.column(c).to_pylist() for c in ("of", "level", "place", "digest"))):
        given.setdefault((of == TOP, level), {})[place] = value
    n, top, trees = (leaves.column(c)[0].as_py() for c in ("n", "top", "trees"))
    places, digests = leaves.column("pos").to_numpy(), leaves.column("leaf").to_pylist()
    known = dict(zip(places.tolist(), digests))
    befores, afters = [], []  # by level one text for each leaf

    def climb(known: dict[int, str], own: np.ndarray, n: int, above: bool) -> str:
        level = 0
        while n > 1:
            known = known | given.get((above, level), {})
            runs: dict[int, str] = {}
            sides: dict[int, tuple[str, str]] = {}
            for parent in np.unique(own // ARITY).tolist():
                run = [known[p] for p in range(parent * ARITY, min(n, (parent + 1) * ARITY))]
                runs[parent] = hashlib.sha256("".join(run).encode()).hexdigest()
                for i in range(len(run)):
                    sides[parent * ARITY + i] = ("".join(run[:i]), "".join(run[i + 1 :]))
            mine = [sides[p] for p in own.tolist()]
            befores.append(pa.array([s[0] for s in mine], pa.string()))
            afters.append(pa.array([s[1] for s in mine], pa.string()))
            level, known, own, n = level + 1, runs, own // ARITY, -(-n // ARITY)
        return known[0]

    subroot = climb(known, places, n, False)
    root = climb({top: subroot}, np.full(len(places), top), trees, True)
    count, steps = len(places), len(befores)
    # Level by level to leaf by leaf.
    turn = pa.array(np.arange(count * steps).reshape(steps, count).T.ravel())
    flat = [pa.concat_arrays(side).take(turn) if steps else pa.array([], pa.string()) for side in (befores, afters)]
    proof = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * steps, pa.int32()), pa.StructArray.from_arrays(flat, ["before", "after"]))
    columns = [leaves.column("row").combine_chunks(), pa.array(digests), *(pa.array([x] * count) for x in (subroot, root)), proof]
    return pa.table(dict(zip(["row", "leaf", "subroot", "root", "proof"], columns)))


def siblings(proof: Column) -> Column:
    """All digests of a proof in one text, from the leaf up, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and a proof."""
    return F.aggregate(proof, leaf, lambda own, s: digest(s["before"], own, s["after"]))
