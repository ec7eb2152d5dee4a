"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Passages are overlapping windows of words, wide enough to hold any item whole.  A passage's score for an item is
BM25 over the passage's distinct words, divided by the score the item gets from its own words, so one threshold
serves items of any length.  Retrieval is block-max WAND: the largest impact of each term bounds what a passage can
reach at all, the largest impacts of its terms in each block of items what it can reach there.  Both bounds are
tested for all passages of a text at once; passages that pass are walked through the posting lists, skipping blocks
that cannot reach the threshold.  What is retrieved is verified word for word: enough runs of three words of the
item's question and of its answer must stand around the passage.

The last sentence of an item counts as its answer, what stands before it as its question; a side without words counts
as found.  An item of fewer than five words is found where its words stand one after the other.  Items are searched by
classes of length (up to 64 words, up to 128, ...), each with passages of twice that width, so what is found of an item
does not depend on the other items.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import words as W
from packetloom.llm.sketch import document_frequencies

K1, B = 1.2, 0.75
THRESHOLD = 0.6
QUESTION, ANSWER = 0.6, 0.5
GRAM = 3
STRIDE = 64
# Items in a block.  Small ones keep the bounds tight enough to spare nearly all walks.
BLOCK = 4
# Window by block bounds held at a time.
MOST_BOUNDS = 1 << 22
# Items with fewer words are searched for as they stand.
LEAST_WORDS = 5
# An index part holds items of about this many bytes; larger benchmarks are searched part by part.
PART_BYTES = 16 << 20


def question_and_answer(text: str) -> tuple[str, str]:
    """Cuts an item before its last sentence; a single sentence is cut before its last quarter of words."""
    sentences = [s for s in re.split(r"(?<=[.?!:])\s+|\n+", text.strip()) if s.strip()]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    parts = text.split()
    cut = len(parts) - max(1, len(parts) // 4)
    return " ".join(parts[:cut]), " ".join(parts[cut:])


@dataclass
class Index:
    """Posting lists by term: items (positions in ``ids``, ascending) with impacts.

    ``blocks`` and ``block_max`` are the same lists by block of items, with the largest impact in each.
    """

    ids: list[int]
    lengths: np.ndarray
    grams: list[tuple[np.ndarray, int, np.ndarray, int]]  # question grams and their size, answer grams and theirs
    terms: np.ndarray
    first: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    largest: np.ndarray
    block_first: np.ndarray
    blocks: np.ndarray
    block_max: np.ndarray

    @property
    def stride(self) -> int:
        return width_class(int(self.lengths.max(initial=0)))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The position of each hash among the terms, -1 for others."""
        if len(self.terms) == 0:
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)


def width_class(words: int) -> int:
    """The least power of two times ``STRIDE`` that holds so many words."""
    width = STRIDE
    while width < words:
        width *= 2
    return width


@dataclass
class Phrases:
    """Items of fewer than ``LEAST_WORDS`` words: by number of words, their hashes (ascending) and the items."""

    runs: dict[int, tuple[np.ndarray, list[int]]]

    def find(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first word, words) of each item that stands in a text, at its first place."""
        for size, (runs, ids) in self.runs.items():
            if len(hashes) < size:
                continue
            found, first = np.unique(W.shingles(hashes, size), return_index=True)
            at = np.minimum(np.searchsorted(found, runs), len(found) - 1)
            for k in np.flatnonzero(found[at] == runs).tolist():
                yield ids[k], int(first[at[k]]), size


@dataclass
class Searcher:
    """One part of the benchmark: an index for each class of length, and the short items."""

    indexes: list[Index]
    phrases: Phrases

    def find(self, hashes: np.ndarray, threshold: float) -> list[tuple]:
        """(item id, score, first word, words, question and answer overlap) of each item retrieved from a text."""
        out = [(i, 1.0, first, n, 1.0, 1.0) for i, first, n in self.phrases.find(hashes)]
        for index in self.indexes:
            out += [(index.ids[item], *found) for item, found in sorted(search_text(index, hashes, threshold).items())]
        return out


def build_searcher(items: list[tuple[int, str]], frequency: Callable[[np.ndarray], np.ndarray], documents: int, mean_length: float) -> Searcher:
    found = W.words_of([t for _, t in items])
    sizes = np.diff(found.first).tolist()
    short: dict[int, list[tuple[int, int]]] = {}
    classes: dict[int, list[tuple[int, str]]] = {}
    for i, size in enumerate(sizes):
        if size >= LEAST_WORDS:
            classes.setdefault(width_class(size), []).append(items[i])
        elif size:
            run = W.shingles(found.hashes[found.first[i] : found.first[i + 1]], size)
            short.setdefault(size, []).append((int(run[0]), i))
    runs = {n: (np.array([r for r, _ in sorted(s)], np.uint64), [items[i][0] for _, i in sorted(s)]) for n, s in short.items()}
    return Searcher([build_index(classes[w], frequency, documents, mean_length) for w in sorted(classes)], Phrases(runs))


def build_index(items: list[tuple[int, str]], frequency: Callable[[np.ndarray], np.ndarray], documents: int, mean_length: float) -> Index:
    """An index of these items (shorter ones are left out); term statistics are those of the whole benchmark."""
    found = W.words_of([t for _, t in items])
    sizes = np.diff(found.first)
    kept = [i for i in range(len(items)) if sizes[i] >= LEAST_WORDS]
    terms, owner, weight, grams = [], [], [], []
    for k, i in enumerate(kept):
        own, tf = np.unique(found.hashes[found.first[i] : found.first[i + 1]], return_counts=True)
        df = frequency(own)
        idf = np.log1p((documents - df + 0.5) / (df + 0.5))
        impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[i] / mean_length))
        terms.append(own)
        owner.append(np.full(len(own), k))
        weight.append(impact / impact.sum())
        pair = []
        for part in question_and_answer(items[i][1]):
            h = W.words_of([part]).hashes
            pair += [np.unique(W.shingles(h, GRAM)), max(1, min(GRAM, len(h)))]
        grams.append(tuple(pair))
    terms = np.concatenate(terms) if kept else np.zeros(0, np.uint64)
    owner = np.concatenate(owner) if kept else np.zeros(0, np.int64)
    weight = np.concatenate(weight) if kept else np.zeros(0)
    order = np.lexsort((owner, terms))
    distinct, first = np.unique(terms[order], return_index=True)
    first = np.append(first, len(order))
    owner, weight = owner[order], weight[order]
    largest = np.maximum.reduceat(weight, first[:-1]) if len(distinct) else np.zeros(0)
    number = np.repeat(np.arange(len(distinct)), np.diff(first))
    opens = np.flatnonzero(np.diff(number, prepend=-1) | np.diff(owner // BLOCK, prepend=-1))
    blocks = owner[opens] // BLOCK
    block_max = np.maximum.reduceat(weight, opens) if len(opens) else np.zeros(0)
    block_first = np.searchsorted(number[opens], np.arange(len(distinct) + 1))
    ids = [items[i][0] for i in kept]
    return Index(ids, sizes[kept], grams, distinct, first, owner, weight, largest, block_first, blocks, block_max)


def search(index: Index, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
    """All items whose summed impacts over ``terms`` (distinct) reach the threshold, by block-max WAND."""
    slack = threshold - 1e-9
    first, items, largest = index.first, index.items, index.largest
    cursors = [[int(items[first[t]]), t, int(first[t])] for t in terms]
    found = []

    def move(cursor: list, least: int) -> None:
        end = first[cursor[1] + 1]
        at = cursor[2] + int(np.searchsorted(items[cursor[2] : end], least))
        cursor[2] = at
        cursor[0] = int(items[at]) if at < end else -1

    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            bound += largest[c[1]]
            if bound >= slack:
                pivot = i
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        ahead = cursors[: pivot + 1]
        block = item // BLOCK
        bound = 0.0
        for c in ahead:
            begin, end = int(index.block_first[c[1]]), int(index.block_first[c[1] + 1])
            at = begin + int(np.searchsorted(index.blocks[begin:end], block))
            if at < end and index.blocks[at] == block:
                bound += index.block_max[at]
        if bound < slack:
            # No item of this block can reach it, as far as no further term joins in.
            until = (block + 1) * BLOCK
            if pivot + 1 < len(cursors):
                until = min(until, cursors[pivot + 1][0])
            for c in ahead:
                move(c, until)
        elif cursors[0][0] == item:
            score = float(sum(index.impacts[c[2]] for c in ahead))
            if score >= slack:
                found.append((item, score))
            for c in ahead:
                move(c, item + 1)
        else:
            for c in ahead:
                if c[0] < item:
                    move(c, item)
        cursors = [c for c in cursors if c[0] >= 0]
    return found


def promising(index: Index, numbers: np.ndarray, stride: int, threshold: float = THRESHOLD) -> list[tuple[int, list[int]]]:
    """The windows of a text (by number) whose distinct terms could reach the threshold in some block, with those terms.

    Window k holds the words k * stride to (k + 2) * stride.
    """
    at = np.flatnonzero(numbers >= 0)
    if len(at) == 0:
        return []
    terms = numbers[at]
    order = np.lexsort((at, terms))
    before = np.full(len(at), -1)
    same = terms[order[1:]] == terms[order[:-1]]
    before[order[1:][same]] = at[order[:-1][same]]  # where the same term stood last
    windows = max(1, -(-len(numbers) // stride) - 1)
    bound = np.zeros(windows)
    weight = index.largest[terms]
    for shift in (0, 1):
        k = at // stride - shift
        new = (k >= 0) & (k < windows) & (before < k * stride)
        bound += np.bincount(k[new], weight[new], minlength=windows)
    left = np.flatnonzero(bound >= threshold - 1e-9)
    out = []
    blocks = -(-len(index.ids) // BLOCK)
    step = max(1, MOST_BOUNDS // max(1, blocks))
    for some in (left[i : i + step] for i in range(0, len(left), step)):
        own = [np.unique(terms[a:b]) for a, b in zip(*np.searchsorted(at, (some * stride, (some + 2) * stride)))]
        listed = np.concatenate(own)
        n = index.block_first[listed + 1] - index.block_first[listed]
        # The places of all block entries of all listed terms, one after the other.
        places = np.repeat(index.block_first[listed] - np.cumsum(n) + n, n) + np.arange(n.sum())
        row = np.repeat(np.repeat(np.arange(len(some)), list(map(len, own))), n)
        reach = np.bincount(row * blocks + index.blocks[places], index.block_max[places], minlength=len(some) * blocks)
        reach = reach.reshape(len(some), blocks).max(1)
        out += [(int(some[i]), own[i].tolist()) for i in np.flatnonzero(reach >= threshold - 1e-9)]
    return out


def overlaps(index: Index, item: int, hashes: np.ndarray) -> tuple[float, float]:
    """Shares of the question's and of the answer's runs of words that stand among these words."""
    question, q_size, answer, a_size = index.grams[item]

    def share(grams: np.ndarray, size: int) -> float:
        if len(grams) == 0:
            return 1.0  # a side without words
        return float(np.isin(grams, W.shingles(hashes, size)).mean()) if len(hashes) >= size else 0.0

    return share(question, q_size), share(answer, a_size)


def search_text(index: Index, hashes: np.ndarray, threshold: float = THRESHOLD) -> dict[int, tuple]:
    """Best passage for each retrieved item: item -> (score, first word, words, question and answer overlap)."""
    stride = index.stride
    best: dict[int, tuple] = {}
    for k, terms in promising(index, index.numbers(hashes), stride, threshold):
        begin, end = k * stride, min(len(hashes), (k + 2) * stride)
        for item, score in search(index, terms, threshold):
            around = hashes[max(0, begin - stride) : end + stride]
            found = (score, begin, end - begin, *overlaps(index, item, around))
            old = best.get(item)
            if old is None or (min(found[3:]), found[0], -begin) > (min(old[3:]), old[0], -old[1]):
                best[item] = found
    return best


def indexes(benchmark: DataFrame, id_column: str = "item_id", text: str = "text", part_bytes: int = PART_BYTES) -> Iterator[Searcher]:
    """Searchers over all items, each of about ``part_bytes`` of text, one after the other.

    Repeated items stay; null texts have no words and match nothing.
    """
    items = benchmark.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    known = document_frequencies(items, "text", lambda hashes: hashes)
    words = items.mapInArrow(_count_words, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-int(total) // part_bytes))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part) if parts > 1 else items
        rows = sorted((r["id"] is not None, r["id"] or 0, r["text"], r["id"]) for r in own.collect())
        yield build_searcher([(r[3], r[2]) for r in rows], known.of, known.documents, max(1.0, words / max(1, known.documents)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.chunks(batches, "text"):
        found = W.words_of(batch.column(batch.schema.get_field_index("text")))
        yield pa.RecordBatch.from_arrays([pa.array([len(found.hashes)])], ["n"])


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
    threshold: float = THRESHOLD,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One row per text and item retrieved from it.

    Gives the id, ``item_id``, ``bm25`` (share of the item's own score), ``first_word``, ``n_words`` of the best
    passage, ``question_overlap``, ``answer_overlap`` and ``verified``.  Texts are scanned where they lie; nothing is
    shuffled.  Null and empty texts give no rows, repeated rows give theirs each, a null id is kept.  Items without any
    word match nothing; repeated items and items of equal words give a row each.
    """
    given = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ["id", "item_id", "bm25", "first_word", "n_words", "question_overlap", "answer_overlap", "verified"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
    schema = (
        "id long, item_id long, bm25 double, first_word long, n_words long, question_overlap double,"
        " answer_overlap double, verified boolean"
    )

    def scan(searcher: Searcher) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in W.chunks(batches, "text"):
                found = W.words_of(batch.column(1))
                rows = []
                for i, doc in enumerate(batch.column(0).to_pylist()):
                    for item, score, begin, n, q, a in searcher.find(found.hashes[found.first[i] : found.first[i + 1]], threshold):
                        rows.append((doc, item, score, begin, n, q, a, q >= QUESTION and a >= ANSWER))
                columns = zip(*rows) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

        return run

    out = None
    for searcher in indexes(benchmark, item_column, text, part_bytes):
        part = given.mapInArrow(scan(searcher), schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_column)


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows without a verified benchmark item, with all their columns (whatever their names), chosen inside the scan.

    Rows with a null or empty text stay, repeated rows are treated alike, ids are not read.
    """
    at = docs.columns.index(text)

    def clean(searcher: Searcher) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in W.chunks(batches, text):
                found = W.words_of(batch.column(at))
                kept = [
                    not any(q >= QUESTION and a >= ANSWER for *_, q, a in searcher.find(found.hashes[i:j], threshold))
                    for i, j in zip(found.first[:-1], found.first[1:])
                ]
                yield batch.filter(pa.array(kept, pa.bool_()))

        return run

    for searcher in indexes(benchmark):
        docs = docs.mapInArrow(clean(searcher), docs.schema)
    return docs
