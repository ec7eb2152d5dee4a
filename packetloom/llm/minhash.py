"""Near duplicates by consistent weighted sampling of TF-IDF weighted word shingles.

1. Shingles of five words are weighted by their count in the text and a damped inverse document frequency.  Document
   frequencies of all texts are counted by a sketch of fixed size.
2. Improved consistent weighted sampling draws ``BANDS * BAND_ROWS`` samples per text; two texts agree in a sample
   with a probability of their weighted Jaccard similarity.  Bands of samples are bucket keys.
3. In every bucket each text is compared with one pivot: the text that shares most and largest buckets, which in a
   group of edited copies is the original.  Comparisons are exact, on whole texts.
4. Linked texts form classes.  Where a text of a bucket is not yet in the class of its pivot, it is compared with all
   texts of that pivot, block by block, so no link between texts that share a bucket is missed.

Equal texts are one node throughout; their rows come together again at the end.

The damping (``IDF_STRENGTH``) keeps weights between 1 and 1 + strength.  With plain IDF the words that a group of
copies shares would weigh less the larger the group is, and its edited words most: large groups would fall apart.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import words as W
from packetloom.llm.sketch import Frequencies, document_frequencies
from packetloom.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 20, 6
IDF_STRENGTH = 0.1
# Random draws come from a table of this many entries, picked by bits of the shingle's hash.
_DRAW_BITS = 14
# Sampling rounds log weights to this step; comparisons use exact weights.
_STEP, _LEVELS = 0.05, 256
# Texts of a block in the comparison of whole groups.
BLOCK_TEXTS = 256
# Partners' shingles that a comparing task remembers (32 MB), apart from those of the text in hand.
_KEPT_SHINGLES = 1 << 21
# Cells of 64 bits of the filter that leaves out texts of no interest before texts are shuffled (1 MB).
_FILTER_CELLS = 1 << 17


def frequencies(df: DataFrame, text: str = "text") -> Frequencies:
    return document_frequencies(df, text, lambda hashes: W.shingles(hashes, SHINGLE))


def weighted_shingles(hashes: np.ndarray, known: Frequencies) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text's word hashes, ascending, and their weights."""
    shingles, tf = np.unique(W.shingles(hashes, SHINGLE), return_counts=True)
    if len(shingles) == 0:
        return shingles, np.zeros(0)
    n = np.log1p(known.documents)
    return shingles, tf * (1 + IDF_STRENGTH * (n - np.log1p(known.of(shingles))) / n)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    union = a[1].sum() + b[1].sum() - common
    return float(common / union) if union else 0.0


class Sampler:
    """Improved consistent weighted sampling.

    For a shingle of weight w and each sample: with r, c ~ Gamma(2, 1) and b ~ U(0, 1) drawn by the shingle's hash,
    t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the shingle with the least a is drawn, together with t.
    """

    def __init__(self, samples: int = BANDS * BAND_ROWS):
        rng = np.random.Generator(np.random.PCG64(20_260))
        n = 1 << _DRAW_BITS
        r, c, b = rng.gamma(2, 1, n), rng.gamma(2, 1, n), rng.random(n)
        log_w = np.arange(_LEVELS)[:, None] * _STEP
        t = np.floor(log_w / r + b)
        self.log_a = (np.log(c) - r * (t - b + 1)).astype(np.float32).ravel()
        self.t = t.astype(np.int32).ravel()
        self.seeds = W.mix(np.arange(1, samples + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One code per sample; none for a text without shingles."""
        level = np.clip(np.rint(np.log(weights) / _STEP), 0, _LEVELS - 1).astype(np.int64) << _DRAW_BITS
        best = np.full(len(self.seeds), np.inf, np.float32)
        code = np.zeros(len(self.seeds), np.uint64)
        columns = np.arange(len(self.seeds))
        for begin in range(0, len(shingles), 1024):
            block = shingles[begin : begin + 1024, None]
            at = (block * self.seeds >> np.uint64(64 - _DRAW_BITS)).astype(np.int64) + level[begin : begin + 1024, None]
            a = self.log_a[at]
            row = a.argmin(0)
            least = a[row, columns]
            new = least < best
            best[new] = least[new]
            drawn = block[row[new], 0] + self.t[at[row[new], columns[new]]].astype(np.uint64)
            code[new] = drawn
        return W.mix(code)


@functools.cache
def _sampler() -> Sampler:
    """One per Python worker, which serves many tasks."""
    return Sampler()


def band_keys(codes: np.ndarray) -> np.ndarray:
    keys = W.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for column in codes.reshape(BANDS, BAND_ROWS).T:
        keys = W.mix(keys ^ column)
    return keys.view(np.int64)


def _node(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def signatures(df: DataFrame, known: Frequencies, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, node, keys) of every row: the hash of its text and its bucket keys (none without words)."""
    given = df.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler()
        for batch in W.chunks(batches, "text"):
            found = W.words_of(batch.column(1))
            nodes = [_node(t) for t in batch.column(1).to_pylist()]
            keys = []
            for a, b in zip(found.first[:-1], found.first[1:]):
                shingles, weights = weighted_shingles(found.hashes[a:b], known)
                keys.append(band_keys(sampler(shingles, weights)) if len(shingles) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes), pa.array(keys, pa.list_(pa.int64()))], ["id", "node", "keys"]
            )

    return given.mapInArrow(run, "id long, node string, keys array<long>")


def _bits(node):
    return F.conv(F.substring(node, 1, 8), 16, 10).cast("long")


def texts_of(df: DataFrame, wanted: DataFrame, id_column: str, text: str) -> DataFrame:
    """(node, text) for the wanted (node, rep), from the row whose id is rep.

    Texts that are surely not wanted are left out before the shuffle by a bit per hash of wanted nodes.
    """
    v = _bits(F.col("node"))
    cell, bit = F.pmod(v, F.lit(_FILTER_CELLS)), F.floor(v / _FILTER_CELLS) % 64
    rows = (
        wanted.select(cell.alias("cell"), F.expr("1L").alias("one"), bit.cast("int").alias("bit"))
        .select("cell", F.call_function("shiftleft", "one", "bit").alias("bits"))
        .groupBy("cell")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()  # at most _FILTER_CELLS rows
    )
    table = np.zeros(_FILTER_CELLS, np.int64)
    table[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy()
    table = table.view(np.uint64)
    given = df.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [_node(t) for t in batch.column(1).to_pylist()]
            v = np.array([int(x[:8], 16) for x in nodes], np.uint64)
            kept = (table[(v % _FILTER_CELLS).astype(np.int64)] >> (v // _FILTER_CELLS % np.uint64(64))) & np.uint64(1)
            full = pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.string()), batch.column(1)], ["id", "node", "text"])
            yield full.filter(pa.array(kept.astype(bool)))

    found = given.mapInArrow(run, "id long, node string, text string").alias("d")
    same = (F.col("d.node") == F.col("w.node")) & F.col("d.id").eqNullSafe(F.col("w.rep"))
    found = found.join(wanted.alias("w"), same, "left_semi")
    return found.groupBy("node").agg(F.first("text").alias("text"))


def compare_pairs(pairs: DataFrame, texts: DataFrame, known: Frequencies) -> DataFrame:
    """(a, b, similarity) for given pairs of nodes."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "text_a", "b", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, text_a, b, text_b = batch.columns
            known_b: dict[str, tuple] = {}
            kept, found = 0, []
            words = W.words_of(text_a)
            for i, node in enumerate(b.to_pylist()):
                if node not in known_b:
                    if kept > _KEPT_SHINGLES:
                        known_b.clear()
                        kept = 0
                    known_b[node] = weighted_shingles(W.words_of(text_b.slice(i, 1)).hashes, known)
                    kept += len(known_b[node][0])
                own = weighted_shingles(words.hashes[words.first[i] : words.first[i + 1]], known)
                found.append(weighted_jaccard(own, known_b[node]))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(found, pa.float64())], ["a", "b", "similarity"])

    return both.mapInArrow(run, "a string, b string, similarity double")


def star_pairs(nodes: DataFrame) -> DataFrame:
    """Distinct (a, b): every node of a bucket with the bucket's pivot b."""
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(buckets.join(sizes, "key"), "near-members")
    reach = members.groupBy("node").agg(F.sum("n").alias("reach"))
    pivots = members.join(reach, "node").groupBy("key").agg(F.max(F.struct("reach", "node"))["node"].alias("b"))
    pairs = members.join(pivots, "key").where("node <> b")
    return pairs.select(F.col("node").alias("a"), "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all ends of the edges (a, b); nodes of a component share its least node as label.

    Each round a node takes the least label around it and then its label's label, until nothing changes.  Labels are
    written each round; a hot node's many edges meet only in minima, which combine on the map side.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node")
    labels = materialize(labels, "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        best = labels.join(around, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("near"))
        upper = labels.select(F.col("node").alias("top"), F.col("label").alias("up"))
        step = best.join(upper, F.col("near") == F.col("top")).select("node", F.col("label").alias("old"), F.least("near", "up").alias("label"))
        step = materialize(step, "labels")
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels


def join_roots(up: np.ndarray, x: int, y: int) -> bool:
    """Unite the sets of two places in a forest of parents; False if they were one already."""
    ends = []
    for k in (x, y):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        ends.append(k)
    up[ends[0]] = ends[1]
    return ends[0] != ends[1]


def rest_links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, known: Frequencies, least: float) -> DataFrame | None:
    """(a, b) links that join nodes outside their pivot's class with nodes of that pivot; None if there are no such nodes.

    Both sides of a pivot's nodes are dealt into blocks of about ``BLOCK_TEXTS`` by hash; every pair of blocks is one
    task's group.  No pairs are listed: of the links that a group finds, those come out that join two of its classes so
    far, which span the same classes as all of them and are fewer than its texts.
    """
    members = pairs.select(F.col("b").alias("pivot"), F.col("a").alias("node"))
    members = members.unionByName(members.select("pivot", F.col("pivot").alias("node")).distinct())
    named = members.join(classes, "node", "left").select("pivot", "node", F.coalesce("label", "node").alias("label"))
    own = classes.select(F.col("node").alias("pivot"), F.col("label").alias("home"))
    named = named.join(own, "pivot", "left").withColumn("out", F.col("label") != F.coalesce("home", "pivot"))
    # Written, so that the join with the sizes below may split a pivot with many nodes over tasks.
    named = materialize(named.select("pivot", "node", "out"), "near-named")
    sizes = named.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.count_if("out").alias("n_out")).where("n_out > 0 and n > 2")
    sizes = sizes.select(
        "pivot",
        F.ceil(F.col("n") / BLOCK_TEXTS).cast("int").alias("cols"),
        F.ceil(F.col("n_out") / BLOCK_TEXTS).cast("int").alias("rows"),
    )
    left = materialize(named.join(materialize(sizes, "near-sizes"), "pivot"), "near-rest")
    if left.isEmpty():
        return None
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = left.where("out").select("pivot", "node", F.lit(True).alias("asks"), place("rows").alias("i"), across("cols").alias("j"))
    gives = left.select("pivot", "node", F.lit(False).alias("asks"), across("rows").alias("i"), place("cols").alias("j"))
    cells = asks.unionByName(gives).join(texts, "node")

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        features = [weighted_shingles(W.words_of([t]).hashes, known) for t in cell["text"]]
        ask = np.flatnonzero(cell["asks"].to_numpy(bool))
        give = np.flatnonzero(~cell["asks"].to_numpy(bool))
        nodes = cell["node"].to_numpy()
        totals = np.array([f[1].sum() for f in features])
        sizes = [len(features[g][0]) for g in give]
        pool = np.concatenate([features[g][0] for g in give]) if len(give) else np.zeros(0, np.uint64)
        weight = np.concatenate([features[g][1] for g in give]) if len(give) else np.zeros(0)
        owner = np.repeat(np.arange(len(give)), sizes)
        found, up = [], np.arange(len(nodes))
        by_node: dict[str, int] = {}
        for k, node in enumerate(nodes):
            up[k] = by_node.setdefault(node, k)
        for x in ask:
            shingles, weights = features[x]
            at = np.minimum(np.searchsorted(shingles, pool), len(shingles) - 1)
            hit = shingles[at] == pool
            common = np.bincount(owner[hit], np.minimum(weights[at[hit]], weight[hit]), minlength=len(give))
            similarity = common / (totals[x] + totals[give] - common)
            for y in give[similarity >= least]:
                if join_roots(up, x, y):
                    found.append((nodes[x], nodes[y]))
        return pd.DataFrame(found, columns=["a", "b"])

    return cells.groupBy("pivot", "i", "j").applyInPandas(compare, "a string, b string")


def _labelled(
    df: DataFrame, id_column: str, text: str, similarity: float
) -> tuple[DataFrame, DataFrame]:
    """(id, node) of every row, and (node, rep, label): each distinct text, its least id and its class."""
    known = frequencies(df, text)
    rows = materialize(signatures(df, known, id_column, text), "near-signatures")
    nodes = materialize(rows.groupBy("node").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")), "near-nodes")
    pairs = materialize(star_pairs(nodes), "near-pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = materialize(texts_of(df, nodes.select("node", "rep").join(ends, "node"), id_column, text), "near-texts")
    links = materialize(compare_pairs(pairs, texts, known).where(F.col("similarity") >= similarity).select("a", "b"), "near-links")
    found = components(links)
    more = rest_links(pairs, found, texts, known, similarity)
    if more is not None:
        more = materialize(more.distinct(), "near-more")
        if not more.isEmpty():
            found = components(links.unionByName(more))
    labelled = nodes.select("node", "rep").join(found, "node", "left")
    return rows.select("id", "node"), labelled.select("node", "rep", F.coalesce("label", "node").alias("label"))


def classes(df: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Every row's id with its ``class_id``: the least id of its class of near duplicates.

    Null texts count as empty; rows of equal text share a class, also without any word.  A null id belongs to its
    text's class, which is null if no row of it has an id.  Repeated rows come out as often as they came in.
    """
    rows, labelled = _labelled(df, id_column, text, similarity)
    least = labelled.groupBy("label").agg(F.min("rep").alias("class_id"))
    named = materialize(labelled.join(least, "label").select("node", "class_id"), "near-classes")
    return rows.join(named, "node").select(F.col("id").alias(id_column), "class_id")


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, with all its columns: that of the least id (a null id only where there is no other).

    Repeated rows fold into one.  Rows move once, by id and text, so copies of one text spread over tasks.
    """
    _, labelled = _labelled(df, id_column, text, similarity)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node"))
    kept = materialize(labelled.groupBy("label").agg(first.alias("k")).select("k.*"), "near-kept")
    number = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    kept = kept.select("node", F.col("none").alias("__none"), number(F.col("rep")).alias("__rep")).withColumnRenamed("node", "__node")
    given = df.withColumns(
        {
            "__node": F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")),
            "__none": F.col(id_column).isNull(),
            "__rep": number(F.col(id_column).cast("long")),
        }
    )
    keys = ["__node", "__none", "__rep"]
    return given.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)
