"""Quality scores from compression with two dictionaries.

One zstandard dictionary is trained on good labelled text and one on bad.  A text is cut into short chunks (so that a
long text cannot serve as its own dictionary) and every chunk is compressed with both.  The difference of the
compressed sizes over their larger one says which kind of text it is like; together with the plain compression ratio
(endless repetition looks like neither) a logistic regression, fitted on labelled texts that its dictionaries have not
seen, turns it into a probability.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.words import chunks

CHUNK = 2048
DICTIONARY = 65_536
LEVEL = 3
# Compressed sizes are smoothed by this many bytes, so that a few words prove little.
SMOOTH = 64
# At most this many texts of each class are used for fitting.  Of each text so many chunks, picked by hash over its
# whole length, go into a dictionary, so that a few very long texts do not make it up.
PER_CLASS = 1500
CHUNKS_PER_TEXT = 16


@dataclass(frozen=True)
class Model:
    """Two dictionaries (empty: none could be made) and the weights of the calibrated score."""

    good: bytes
    bad: bytes
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def chunks_of(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[i : i + CHUNK] for i in range(0, max(1, len(data)), CHUNK)]


def train_dictionary(texts: list[str]) -> bytes:
    """A dictionary for texts like these; too few texts for training serve as the dictionary themselves."""
    samples = [c for t in texts for c in picked(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sorted(samples, key=zlib.crc32))[:DICTIONARY]


def picked(text: str | None) -> list[bytes]:
    """The chunks of a text that go into a dictionary, in their order: all of a text of up to ``CHUNKS_PER_TEXT``."""
    parts = [c for c in chunks_of(text) if c]
    if len(parts) <= CHUNKS_PER_TEXT:
        return parts
    best = sorted(range(len(parts)), key=lambda i: (zlib.crc32(parts[i]), i))[:CHUNKS_PER_TEXT]
    return [parts[i] for i in sorted(best)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    plain = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(compression_params=plain)
    return zstandard.ZstdCompressor(compression_params=plain, dict_data=zstandard.ZstdCompressionDict(dictionary))


class Measure:
    """The features of a text under two dictionaries: difference, log ratio and its square."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = _compressor(good), _compressor(bad)

    def __call__(self, text: str | None) -> tuple[float, float, float]:
        parts = chunks_of(text)
        good = sum(len(self.good.compress(c)) for c in parts)
        bad = sum(len(self.bad.compress(c)) for c in parts)
        ratio = math.log((min(good, bad) + SMOOTH) / (sum(map(len, parts)) + SMOOTH))
        return (bad - good) / (max(good, bad) + SMOOTH), ratio, ratio * ratio


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Center, scale and weights (the last one constant) by Newton steps."""
    center, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - center) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + ridge * w
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), slope)
    return center, scale, w


def fit_texts(good: list[str], bad: list[str]) -> Model:
    """Fits on texts in memory.

    The weights come from two turns in which the dictionaries are made of one half and measure the other.  Without
    texts of both classes the score is the share of good ones, a half without any.
    """
    if len(good) < 2 or len(bad) < 2:
        share = (len(good) + 1) / (len(good) + len(bad) + 2)
        return Model(b"", b"", (0.0,) * 3, (1.0,) * 3, (0.0, 0.0, 0.0, math.log(share / (1 - share))))
    x, y = [], []
    for half in (0, 1):
        measure = Measure(train_dictionary(good[half::2]), train_dictionary(bad[half::2]))
        for label, texts in ((1.0, good[1 - half :: 2]), (0.0, bad[1 - half :: 2])):
            x += [measure(t) for t in texts]
            y += [label] * len(texts)
    center, scale, weights = fit_logistic(np.array(x), np.array(y))
    return Model(train_dictionary(good), train_dictionary(bad), *(tuple(map(float, v)) for v in (center, scale, weights)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_column: str, text: str) -> dict[int, list[str]]:
    """Texts by class: the ``per_class`` labelled ids of each class that come first by hash, so reruns agree.

    Only ids are ordered; the texts of the few chosen ones are then looked up.  Unlabelled and null ids are left out.
    """
    ids = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull()).select(
        F.col(id_column).alias("__id"), F.col(label).cast("int").alias("__label")
    )
    ids = ids.groupBy("__id").agg(F.min("__label").alias("__label")).withColumn("__at", F.xxhash64("__id"))
    # One row per chosen id: 2 x per_class rows, whatever the table's size.
    chosen = [r for c in (0, 1) for r in ids.where(F.col("__label") == c).orderBy("__at", "__id").limit(per_class).collect()]
    if not chosen:
        return {0: [], 1: []}
    wanted = docs.sparkSession.createDataFrame(chosen, ids.schema)
    texts = docs.select(F.col(id_column).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(wanted), "__id")
    rows = texts.groupBy("__id").agg(F.max(F.struct("__at", "__label", "__text")).alias("r")).select("r.*", "__id").collect()
    rows.sort(key=lambda r: (r["__at"], r["__id"]))
    return {c: [r["__text"] or "" for r in rows if r["__label"] == c] for c in (0, 1)}


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, id_column: str = "doc_id", text: str = "text"
) -> Model:
    """Fits on at most ``per_class`` labelled texts of each class (label 1 is good).

    Of labels that repeat an id the least counts, of rows that repeat one the greatest text; equal hashes are ordered by
    id.  Labelled texts come to the driver whole.
    """
    found = labelled_sample(docs, labels, label, per_class, id_column, text)
    return fit_texts(found[1], found[0])


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    measure = Measure(model.good, model.bad)
    x = np.array([measure(t) for t in texts], float).reshape(len(texts), 3)
    z = (x - np.array(model.center)) / np.array(model.scale)
    w = np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns with the probability of good quality (a column of that name is replaced).

    Every whole text is scored inside the scan, without a shuffle; the model (some 130 KB) goes along with the task.
    Null and empty texts get the score of no evidence; a score depends on the text alone, so repeated rows and copies
    get the same.
    """
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    at, names = df.columns.index(text), [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            found = scores(model, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names)

    return df.mapInArrow(run, schema)


def held_out(id_value: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_value.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
