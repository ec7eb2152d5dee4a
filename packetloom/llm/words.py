"""Words, word hashes and shingles of whole Arrow batches of texts, without a Python step per word.

A word is a run of ASCII letters, ASCII digits and non-ASCII characters; A-Z count as a-z.  Hashes depend on the
word's bytes only, so they agree between tasks, sessions and machines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
# Words are hashed in spans of at most this many bytes; a longer single word is hashed on its own.
_SPAN = 1 << 19

_FOLD = np.zeros(256, np.uint8)
for _code in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _FOLD[_code] = _code
for _code in range(0x41, 0x5B):
    _FOLD[_code] = _code + 32


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(_SPAN + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSES = _powers(_BASE), _powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts in order; ``first[i]:first[i + 1]`` are those of text i.

    ``starts`` and ``ends`` are byte positions in ``folded``, the lower-cased bytes of all texts.
    """

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    folded: np.ndarray

    def word(self, k: int) -> str:
        return self.folded[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace")


def words_of(texts: pa.Array | list) -> Words:
    """The words of each text; null counts as empty."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.large_string())
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(1, np.int64), np.zeros(0, np.uint8))
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    folded = _FOLD[raw]
    inside = folded != 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    heads = bounds[:-1][bounds[:-1] < len(raw)]
    opens[heads] = inside[heads]
    tails = bounds[1:][bounds[1:] > 0] - 1
    closes[tails] = inside[tails]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        stop = int(np.searchsorted(ends, starts[k] + _SPAN, "right"))
        if stop <= k:
            digest = hashlib.blake2b(folded[starts[k] : ends[k]].tobytes(), digest_size=8).digest()
            hashes[k] = int.from_bytes(digest, "little")
            k += 1
            continue
        low = starts[k]
        span = folded[low : ends[stop - 1]]
        sums = np.zeros(len(span) + 1, np.uint64)
        np.cumsum(span * _POWERS[: len(span)], out=sums[1:])
        a, b = starts[k:stop] - low, ends[k:stop] - low
        hashes[k:stop] = (sums[b] - sums[a]) * _INVERSES[a]
        k = stop
    return Words(mix(hashes), starts, ends, np.searchsorted(starts, bounds), folded)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words of one text; a shorter text is one run, an empty one has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = out * _BASE + hashes[j : n - width + 1 + j]
    return mix(out)


def chunks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows again in batches of about ``most_bytes`` of text (a longer text comes alone)."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
        begin = 0
        while begin < batch.num_rows:
            upto = np.cumsum(sizes[begin:])
            n = max(1, int(np.searchsorted(upto, most_bytes, "right")))
            yield batch.slice(begin, n)
            begin += n


def row_key(id_value: Column, text: Column) -> Column:
    """16 bytes that are equal for rows of equal id and text only; a null text counts as empty, a null id is an id.

    Copies of a text under different ids get different keys, so they spread over tasks.
    """
    name = id_value.cast("string")
    head = F.coalesce(F.concat(F.octet_length(name).cast("string"), F.lit(":"), name), F.lit("-"))
    return F.unhex(F.md5(F.concat(head, F.lit(" "), F.coalesce(text, F.lit(""))).cast("binary")))
