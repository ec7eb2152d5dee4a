"""I-Match fingerprints: a text is known by its distinct terms from a band of inverse document frequency.

The first part of a fingerprint is the hash of all sorted band terms.  The rest are hashes of randomised subsets of
the lexicon: each of ``FAMILIES`` random families halves the lexicon again and again, and a text is hashed by its
terms in the smallest lexicon of the family that still holds one of them.  Two texts agree in a family when these
terms are the same, so the share of agreeing families (``likeness``) follows the overlap of their terms.

Document frequencies are exact: every range of texts counts its own, one row per range and term is summed by term, and
what lies outside the band goes back to the ranges that hold it.  So the band means the same at every size.
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

from packetloom.llm import words as W
from packetloom.operators.layout import cuts_below

# The band, as ln(documents / frequency) over ln(documents).
LOW, HIGH = 0.2, 0.98
FAMILIES = 32
_SEEDS = W.mix(np.arange(1, FAMILIES + 1, dtype=np.uint64))
_HEAD, _PART = 16, 5
# Terms of a bucket that are held before they are handed on, and rows of a batch of them.
_HELD, _ROWS = 1 << 22, 1 << 17
# Text of a bucket: larger tables have more buckets, without a ceiling.  Small ones have some for all tasks.
BUCKET_BYTES, SMALL_BUCKETS = 64 << 20, 32


@dataclass(frozen=True)
class Frequencies:
    table: DataFrame  # term, n: the number of documents with each term
    documents: int


def frequencies(df: DataFrame, text: str = "text") -> Frequencies:
    """How many rows hold each term, exactly; null texts count as documents without terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, text):
            found = W.words_of(batch.column(0))
            each = [np.unique(found.hashes[a:b]) for a, b in zip(found.first[:-1], found.first[1:])]
            terms, n = np.unique(np.concatenate(each), return_counts=True)
            yield from _slices([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    counts = df.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return Frequencies(counts, df.count())


def _slices(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names)
    for begin in range(0, whole.num_rows, _ROWS):
        yield whole.slice(begin, _ROWS)


def outside(n: Column, documents: int, low: float = LOW, high: float = HIGH) -> Column:
    """Whether a term of so many documents (null: of none, which counts as one) lies outside the band."""
    if documents < 2:
        return F.lit(False)
    n = F.least(F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)), F.lit(documents))
    rarity = F.log(F.lit(float(documents)) / n) / F.log(F.lit(float(documents)))
    return (rarity < low) | (rarity > high)


def band_terms(hashes: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    """The sorted distinct terms that are not in ``left_out`` (ascending); all of them where none is left."""
    terms = np.unique(hashes)
    if len(terms) == 0 or len(left_out) == 0:
        return terms
    at = np.minimum(np.searchsorted(left_out, terms), len(left_out) - 1)
    kept = terms[left_out[at] != terms]
    return kept if len(kept) else terms


def fingerprint(terms: np.ndarray, text: str) -> str:
    """16 hex digits for all terms, then 5 for each family (the lexicon's rank, the hash of the terms in it).

    A text without terms is known by its characters.
    """
    if len(terms) == 0:
        whole = hashlib.sha256(b"no terms" + text.encode()).hexdigest()
        return whole[:_HEAD] + ("f" + whole[_HEAD : _HEAD + _PART - 1]) * FAMILIES
    head = hashlib.blake2b(np.sort(terms).tobytes(), digest_size=_HEAD // 2).hexdigest()
    most = np.zeros(FAMILIES, np.uint64)
    sums = np.zeros(FAMILIES, np.uint64)
    for begin in range(0, len(terms), 4096):
        block = terms[begin : begin + 4096, None]
        drawn = W.mix(block ^ _SEEDS)
        lexicon = drawn & (~drawn + np.uint64(1))  # the lowest set bit: how often the term stayed
        best = np.maximum(most, lexicon.max(0))
        sums = np.where(best > most, np.uint64(0), sums) + np.where(lexicon == best, block, np.uint64(0)).sum(0)
        most = best
    ranks = np.minimum(np.log2(most.astype(np.float64)), 14).astype(int)
    codes = W.mix(sums) >> np.uint64(48)
    return head + "".join(f"{r:x}{c:04x}" for r, c in zip(ranks.tolist(), codes.tolist()))


def likeness(a: str, b: str) -> float:
    """Share of agreeing families; 1 for equal fingerprints."""
    if a[:_HEAD] == b[:_HEAD]:
        return 1.0
    same = sum(a[i : i + _PART] == b[i : i + _PART] for i in range(_HEAD, len(a), _PART))
    return same / FAMILIES


def fingerprints_of(texts: list[str], left_out: np.ndarray) -> list[str]:
    found = W.words_of(texts)
    return [
        fingerprint(band_terms(found.hashes[found.first[i] : found.first[i + 1]], left_out), text) for i, text in enumerate(texts)
    ]


def fingerprints(df: DataFrame, known: Frequencies, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """All rows and columns with the fingerprint of the text (null: of the empty text); replaces such a column.

    Each distinct text meets the counts of its terms once, whatever the number of its copies.
    """
    df = df.drop(out)
    key = lambda c: F.unhex(F.md5(F.coalesce(c, F.lit("")).cast("binary")))
    texts = df.select(key(df[text]).alias("__key"), F.coalesce(df[text], F.lit("")).alias("text")).dropDuplicates(["__key"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, "text"):
            found = W.words_of(batch.column(1))
            each = [np.unique(found.hashes[a:b]) for a, b in zip(found.first[:-1], found.first[1:])]
            of = pa.array(np.repeat(np.arange(len(each)), [len(t) for t in each]))
            yield from _slices([batch.column(0).take(of), pa.array(np.concatenate(each).view(np.int64))], ["__key", "term"])

    terms = texts.mapInArrow(split, "__key binary, term long").join(known.table, "term", "left")
    listed = terms.where(outside(F.col("n"), known.documents)).groupBy("__key").agg(F.collect_list("term").alias("left_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, "text"):
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            prints = [fingerprints_of([t], np.sort(np.array(left or [], np.int64).view(np.uint64)))[0] for t, left in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["__key", out])

    kind = T.StructType([T.StructField("__key", T.BinaryType()), T.StructField(out, T.StringType())])
    prints = texts.join(listed, "__key", "left").select("__key", "text", "left_out").mapInArrow(run, kind)
    return df.withColumn("__key", key(df[text])).join(prints, "__key").select(*df.columns, out)


def in_order(df: DataFrame, id_column: str, text: str, buckets: int) -> DataFrame:
    """(bucket, borrowed, id, text): each bucket's rows are in one partition, with the row after them.

    Sorted by all columns, a bucket opens with a row without values but its number, then come its rows in order, then
    the row after them.

    Buckets are ranges of ids cut at quantiles.  The first row of a bucket is also lent to the bucket before, the
    first of all to the last, so every row finds its successor in its own partition and texts move once.  Order is
    by id (nulls first), then text.
    """
    ids = df.select(F.col(id_column).cast("long").alias("id"))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = ids.agg(F.percentile_approx("id", shares, 100 * buckets).alias("c")).first()["c"] if shares else []
    cuts = sorted(set(cuts or []))
    place = cuts_below(F.array(*map(F.lit, cuts)).cast("array<bigint>"), F.col("id"), len(cuts) + 1)
    heads = ids.withColumn("b", place).groupBy("b").agg(F.min("id").alias("low"), F.max(F.col("id").isNull()).alias("null"))
    heads = sorted((r["b"], None if r["null"] else r["low"]) for r in heads.collect())  # one row per bucket
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("b", place)
    before = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}
    lent = df.sparkSession.createDataFrame([(b, low, before[b]) for b, low in heads], "b int, low long, target int")
    # One row per bucket.
    rows = rows.join(F.broadcast(lent), "b")
    own = F.struct(F.col("b").alias("bucket"), F.lit(False).alias("borrowed"))
    loan = F.struct(F.col("target").alias("bucket"), F.lit(True).alias("borrowed"))
    goes = F.when(F.col("id").eqNullSafe(F.col("low")), F.array(own, loan)).otherwise(F.array(own))
    placed = rows.select(F.explode(goes).alias("g"), "id", "text").select("g.bucket", "g.borrowed", "id", "text")
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("borrowed", "boolean"), ("id", "long"), ("text", "string"))]
    return placed.unionByName(lent.select(F.col("b").alias("bucket"), *nothing)).repartition("bucket")


def compare_with_next(df: DataFrame, known: Frequencies | None = None, id_column: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited form, and how like they and the next text's are.

    The edited form keeps all but the last floor(n / 2) code points and goes on with as many of the next text (fewer
    if it is shorter).  Gives id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for
    every row, repeated ones too.  ``known`` are frequencies of another corpus; by default those of ``df`` are counted.
    ``buckets`` (default: by ``BUCKET_BYTES``) sets how many ranges the texts are sorted in; a range is sorted on disk
    and streamed.  Only its distinct terms are held in memory, 8 bytes each.

    The texts are read twice from one exchange: first for the terms of each range, also those that an edit makes by
    cutting words (they count in no text, but their counts are needed); then for the fingerprints.
    """
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text)).alias("bytes")).first()
    if buckets is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(1, min(partitions, SMALL_BUCKETS), -(-(size["bytes"] or 0) // BUCKET_BYTES))
    placed = in_order(df, id_column, text, buckets)
    order = ["bucket", "borrowed", "id", "text"]

    terms = placed.sortWithinPartitions(*order).mapInArrow(_bucket_terms, "bucket int, term long, n long")
    if known is None:
        # A term comes about once from each bucket, hot ones too, so its list is no longer than there are buckets.
        counts = terms.groupBy("term").agg(F.sum("n").alias("n"), F.collect_list("bucket").alias("buckets"))
        rows = counts.where(outside(F.col("n"), size["rows"])).select("term", F.explode("buckets").alias("bucket"))
    else:
        rows = terms.drop("n").join(known.table, "term", "left").where(outside(F.col("n"), known.documents))
    lists = rows.groupBy(F.col("bucket").alias("of")).agg(F.collect_list("term").alias("left_out"))
    ordered = placed.join(lists, (F.col("bucket") == F.col("of")) & F.col("borrowed").isNull(), "left")
    ordered = ordered.select(*order, "left_out").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, left_out = None, np.zeros(0, np.uint64)
        for held in _neighbours(batches):
            begin = 0
            for i, row in enumerate(held):
                if row[1] is None:
                    yield _compared(held[begin:i], left_out)
                    bucket, begin = row[0], i + 1
                    left_out = np.unique(np.array(row[4] or [], np.int64).view(np.uint64))
                elif row[0] != bucket:
                    raise RuntimeError("a bucket's rows are not in one partition or not in order")
            yield _compared(held[begin:], left_out)

    out = ordered.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )
    return out.withColumnRenamed("doc_id", id_column)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows in runs; each begins with the last row of the run before, whose successor was not known there."""
    held: list[tuple] = []
    for batch in W.chunks(batches, "text"):
        held += zip(*(c.to_pylist() for c in batch.columns))
        if len(held) > 1:
            yield held
            held = held[-1:]


def _edits(rows: list[tuple]) -> tuple[list[int], list[str]]:
    """Places of the rows that are their bucket's own and have their successor behind them, and their edited texts."""
    pairs = [i for i in range(len(rows) - 1) if rows[i][1] is False and rows[i][0] == rows[i + 1][0]]
    texts = [(rows[i][3], rows[i + 1][3]) for i in pairs]
    return pairs, [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in texts]


def _bucket_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, term, n): how many of a bucket's texts hold each term; 0 for terms of the row after them and of edited
    texts only.

    A bucket with more than ``_HELD`` of them may repeat some.
    """
    bucket, terms, counts = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def given() -> Iterator[pa.RecordBatch]:
        return _slices([pa.array(np.full(len(terms), bucket, np.int32)), pa.array(terms.view(np.int64)), pa.array(counts)], ["bucket", "term", "n"])

    for rows in _neighbours(batches):
        pairs, edited = _edits(rows)
        for b in sorted({rows[i][0] for i in pairs}):
            if b != bucket or len(terms) > _HELD:
                if len(terms):
                    yield from given()
                bucket, terms, counts = b, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            # Each row of a bucket is in one pair, so it counts once.
            mine = [(rows[i], rows[i + 1], e) for i, e in zip(pairs, edited) if rows[i][0] == b]
            asked = [e for _, _, e in mine] + [after[3] for _, after, _ in mine if after[1]]
            found = W.words_of([own[3] for own, _, _ in mine] + asked)
            each = [np.unique(found.hashes[x:y]) for x, y in zip(found.first[:-1], found.first[1:])]
            weight = np.repeat(np.arange(len(each)) < len(mine), list(map(len, each))).astype(np.int64)
            terms, at = np.unique(np.concatenate([terms, *each]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, weight]), len(terms)).astype(np.int64)
    if len(terms):
        yield from given()


def _compared(rows: list[tuple], left_out: np.ndarray) -> pa.RecordBatch:
    """Results of each row that is its bucket's own and has its successor behind it."""
    pairs, edited = _edits(rows)
    texts = [r[3] for r in rows]
    prints = fingerprints_of(texts, left_out)
    changed = fingerprints_of(edited, left_out)
    columns = [
        pa.array([rows[i][2] for i in pairs], pa.int64()),
        pa.array([len(texts[i]) for i in pairs], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array([prints[i] for i in pairs], pa.string()),
        pa.array(changed, pa.string()),
        pa.array([likeness(prints[i], e) for i, e in zip(pairs, changed)], pa.float64()),
        pa.array([likeness(prints[i], prints[i + 1]) for i in pairs], pa.float64()),
    ]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays(columns, names)
