"""How many documents hold a term, for any number of terms in fixed memory.

Every document adds each of its distinct terms once to a few rows of counters; the counters of all documents are
summed on the map side and then by cell, so what is shuffled and kept depends on the sketch's width only.  An
estimate is the least counter of a term less the mean of the other cells: terms that are common stand out, terms rarer than that mean's spread look rare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import words as W

BITS, ROWS = 17, 2
_SEEDS = np.array([0x8F14E45FCEEA167A, 0xC9F0F895FB98AB91, 0x45C48CCE2E2D7FBD], np.uint64)


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (W.mix(hashes ^ _SEEDS[row]) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Frequencies:
    counts: np.ndarray  # rows x cells, less the mean of the other cells
    documents: int
    bits: int

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Estimated number of documents with each term, from 1 to all."""
        found = self.counts[0][_cells(hashes, 0, self.bits)]
        for row in range(1, len(self.counts)):
            found = np.minimum(found, self.counts[row][_cells(hashes, row, self.bits)])
        return np.clip(found, 1, max(1, self.documents))


def document_frequencies(
    df: DataFrame, text: str, terms: Callable[[np.ndarray], np.ndarray], bits: int = BITS, rows: int = ROWS
) -> Frequencies:
    """Counts over all rows; ``terms`` makes the term hashes of a text from its word hashes.

    At most rows x 2**bits counters come to the driver (4 MB by default), whatever the size of the table.
    """
    width = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros(rows * width, np.int64), 0
        for batch in W.chunks(batches, text):
            found = W.words_of(batch.column(0))
            each = [np.unique(terms(found.hashes[a:b])) for a, b in zip(found.first[:-1], found.first[1:])]
            seen += batch.num_rows
            if sum(map(len, each)):
                hashes = np.concatenate(each)
                for row in range(rows):
                    sums[row * width : (row + 1) * width] += np.bincount(_cells(hashes, row, bits), minlength=width)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(sums[at], seen))], ["cell", "n"])

    parts = df.select(text).mapInArrow(count, "cell long, n long")
    merged = parts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells, n = merged.column("cell").to_numpy(), merged.column("n").to_numpy()
    documents = int(n[cells < 0].sum())
    sums = np.zeros(rows * width)
    sums[cells[cells >= 0]] = n[cells >= 0]
    sums = sums.reshape(rows, width)
    total = sums.sum(1, keepdims=True)
    return Frequencies((sums - (total - sums) / (width - 1)).astype(np.float32), documents, bits)
