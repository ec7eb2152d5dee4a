"""Toxicity scores of a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of two learned vectors side by side: one for the word itself (hashed) and the mean of those
of its character trigrams, so that unseen spellings are read by their parts.  Windows of ``WINDOW`` words, each
overlapping the next by half, are read in both directions; attention pools the states, a logistic unit gives the
window's score.  A text's score comes from its worst and its mean window and their number, calibrated on labelled texts
that the network was not trained on.

Labels are for whole texts, so training looks for the window to blame: first the one with the words that speak most
for the label, later the one the network itself scores highest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from packetloom.llm import words as W
from packetloom.llm.quality import fit_logistic, labelled_sample

WINDOW = 48
WORD_BITS, GRAM_BITS = 16, 16
VECTOR, HIDDEN, ATTENTION = 12, 16, 12
# At most this many labelled texts of each class are used for fitting.
PER_CLASS = 1200
FEW = 200
EPOCHS = 10
BATCH = 64
# Windows scored at a time.
ROWS = 1024
# Window scores beyond this tell no more.
CLIP = 12.0


@dataclass(frozen=True)
class Model:
    """Parameters by name (float32) and the calibration of a text's features."""

    arrays: dict[str, np.ndarray]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    two, wide = 2 * VECTOR, 2 * HIDDEN
    uniform = lambda *shape: rng.uniform(-1, 1, shape) * np.sqrt(3 / shape[0])
    p = {
        "word": np.zeros((1 << WORD_BITS, VECTOR)),
        "gram": rng.normal(0, 0.02, (1 << GRAM_BITS, VECTOR)),
        "attend": uniform(wide, ATTENTION),
        "attend_bias": np.zeros(ATTENTION),
        "attend_to": uniform(ATTENTION),
        "out": uniform(wide),
        "out_bias": np.zeros(1),
    }
    for d in ("f", "b"):
        p |= {f"in_{d}": uniform(two, 3 * HIDDEN), f"in_bias_{d}": np.zeros(3 * HIDDEN), f"state_{d}": uniform(HIDDEN, 3 * HIDDEN)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Vocabulary:
    """The distinct words of some texts: ``number[k]`` is the distinct word at place k; grams of a word are a range."""

    def __init__(self, found: W.Words):
        hashes, first, self.number = np.unique(found.hashes, return_index=True, return_inverse=True)
        self.word_rows = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        starts, ends = found.starts[first], found.ends[first]
        sizes = ends - starts
        # Every byte of a word opens a run of three and one of six bytes; a byte past the word's end reads as 0.
        self.gram_first = 2 * np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        owner = np.repeat(np.arange(len(hashes)), sizes)
        at = np.arange(len(owner)) - self.gram_first[owner] // 2 + starts[owner]
        left = ends[owner] - at
        data = np.append(found.folded, np.zeros(6, np.uint8)).astype(np.uint32)
        code = np.where(at == starts[owner], np.uint32(0x51ED27), np.uint32(0))
        self.gram_rows = np.empty(2 * len(at), np.int64)
        for j in range(6):
            code = (code ^ np.where(left > j, data[at + j], np.uint32(0))) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
            if j in (2, 5):
                self.gram_rows[j // 3 :: 2] = (code * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - GRAM_BITS)

    def vectors(self, p: dict[str, np.ndarray], some: np.ndarray | None = None) -> np.ndarray:
        """The input vectors of the distinct words."""
        sizes = np.diff(self.gram_first)
        out = np.empty((len(sizes), 2 * VECTOR), np.float32)
        out[:, :VECTOR] = p["word"][self.word_rows]
        for begin in range(0, len(sizes), 8192):
            a, b = self.gram_first[begin], self.gram_first[min(len(sizes), begin + 8192)]
            part = self.gram_first[begin : begin + 8192] - a
            sums = np.add.reduceat(p["gram"][self.gram_rows[a:b]], part[: min(8192, len(sizes) - begin)], axis=0)
            out[begin : begin + 8192, VECTOR:] = sums / np.sqrt(sizes[begin : begin + 8192, None])
        return out


def windows(n: int) -> list[tuple[int, int]]:
    """Ranges of words: every WINDOW / 2 words, the last one ending with the text.  An empty text has none."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = list(range(0, n - WINDOW, WINDOW // 2)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def _read(gx: np.ndarray, mask: np.ndarray | None, state: np.ndarray, keep: list | None) -> np.ndarray:
    """States after each step; gx is steps x windows x gates (already with the inputs' share)."""
    steps, rows, _ = gx.shape
    h = np.zeros((rows, HIDDEN), np.float32)
    out = np.empty((steps, rows, HIDDEN), np.float32)
    for t in range(steps):
        own = h @ state
        gates = own[:, : 2 * HIDDEN] + gx[t, :, : 2 * HIDDEN]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = r * own[:, 2 * HIDDEN :]
        new += gx[t, :, 2 * HIDDEN :]
        np.tanh(new, out=new)
        after = new + z * (h - new)
        if mask is not None:
            after = np.where(mask[t][:, None], after, h)
        if keep is not None:
            keep.append((h, z, r, new, own[:, 2 * HIDDEN :]))
        h = after
        out[t] = h
    return out


def _pool(p: dict[str, np.ndarray], states: np.ndarray, mask: np.ndarray | None):
    u = np.tanh(states @ p["attend"] + p["attend_bias"])
    e = u @ p["attend_to"]
    if mask is not None:
        e = np.where(mask, e, -1e9)
    e = np.exp(e - e.max(0))
    share = e / e.sum(0)
    pooled = np.einsum("tr,trh->rh", share, states)
    return u, share, pooled, pooled @ p["out"] + p["out_bias"][0]


def _logits(p: dict[str, np.ndarray], inputs: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """Scores of windows; index is steps x windows into the rows of ``inputs`` (gate inputs of distinct words)."""
    forward = _read(inputs["f"][index], mask, p["state_f"], None)
    backward = _read(inputs["b"][index[::-1]], None if mask is None else mask[::-1], p["state_b"], None)[::-1]
    return _pool(p, np.concatenate([forward, backward], 2), mask)[3]


def _gate_inputs(p: dict[str, np.ndarray], vectors: np.ndarray) -> dict[str, np.ndarray]:
    return {d: vectors @ p[f"in_{d}"] + p[f"in_bias_{d}"] for d in ("f", "b")}


def window_logits(p: dict[str, np.ndarray], found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """The score of every window of every text, and the text it belongs to."""
    vocabulary = Vocabulary(found)
    inputs = _gate_inputs(p, vocabulary.vectors(p))
    spans = [(i, a + s, a + e) for i, a in enumerate(found.first[:-1]) for s, e in windows(int(found.first[i + 1] - a))]
    owner = np.array([s[0] for s in spans], np.int64)
    begin = np.array([s[1] for s in spans], np.int64)
    size = np.array([s[2] - s[1] for s in spans], np.int64)
    out = np.empty(len(spans), np.float32)
    steps = np.arange(WINDOW)[:, None]
    full = np.flatnonzero(size == WINDOW)
    for some in (full[i : i + ROWS] for i in range(0, len(full), ROWS)):
        out[some] = _logits(p, inputs, vocabulary.number[begin[some] + steps], None)
    short = np.flatnonzero(size < WINDOW)
    short = short[np.argsort(size[short], kind="stable")]
    for some in (short[i : i + ROWS] for i in range(0, len(short), ROWS)):
        upto = steps[: size[some].max()]
        mask = upto < size[some]
        at = np.where(mask, begin[some] + upto, begin[some])
        out[some] = _logits(p, inputs, vocabulary.number[at], mask)
    return out, owner


def text_features(p: dict[str, np.ndarray], texts: list[str | None] | pa.Array) -> np.ndarray:
    """Of each text: its worst window's score, the mean score, and the log of the number of windows.

    A text without words counts as one window of the least score.
    """
    found = W.words_of(texts)
    logits, owner = window_logits(p, found)
    logits = np.clip(logits, -CLIP, CLIP).astype(float)
    n = np.bincount(owner, minlength=len(found.first) - 1)
    worst = np.full(len(n), -CLIP)
    np.maximum.at(worst, owner, logits)
    mean = np.where(n > 0, np.bincount(owner, logits, minlength=len(n)) / np.maximum(n, 1), -CLIP)
    return np.c_[worst, mean, np.log(np.maximum(n, 1))]


class Trainer:
    """Gradient steps on windows; tables learn by the rows they touch."""

    def __init__(self, seed: int = 7):
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.p = _start(self.rng)
        self.seen = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.mean = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "gram")}
        self.steps = 0

    def step(self, words: list[tuple[Vocabulary, np.ndarray]], labels: np.ndarray, weights: np.ndarray) -> float:
        """One step on windows given as (vocabulary, distinct word numbers)."""
        p, rows = self.p, len(words)
        sizes = np.array([len(w) for _, w in words])
        steps = int(sizes.max())
        mask = np.arange(steps)[:, None] < sizes
        x = np.zeros((steps, rows, 2 * VECTOR), np.float32)
        word_at, gram_at, gram_count = [], [], []
        for j, (v, numbers) in enumerate(words):
            word_at.append(v.word_rows[numbers])
            first, n = v.gram_first[numbers], np.diff(v.gram_first)[numbers]
            gram_at.append(v.gram_rows[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())])
            gram_count.append(n)
        cells = np.concatenate([np.arange(len(w)) * rows + j for j, (_, w) in enumerate(words)])
        word_at, gram_at, n = map(np.concatenate, (word_at, gram_at, gram_count))
        gram_of = np.repeat(np.arange(len(n)), n)  # the word of each gram
        gram_share = (1 / np.sqrt(n)).astype(np.float32)[:, None]
        flat = x.reshape(-1, 2 * VECTOR)
        # Hiding some words' own vectors makes the network read spellings, too.
        shown = (self.rng.random(len(word_at)) > 0.2).astype(np.float32)[:, None]
        flat[cells, :VECTOR] = p["word"][word_at] * shown
        flat[cells, VECTOR:] = np.add.reduceat(p["gram"][gram_at], np.cumsum(n) - n, axis=0) * gram_share

        kept: dict[str, list] = {"f": [], "b": []}
        gx = {d: x @ p[f"in_{d}"] + p[f"in_bias_{d}"] for d in ("f", "b")}
        forward = _read(gx["f"], mask, p["state_f"], kept["f"])
        backward = _read(gx["b"][::-1], mask[::-1], p["state_b"], kept["b"])[::-1]
        states = np.concatenate([forward, backward], 2)
        u, share, pooled, logit = _pool(p, states, mask)
        chance = _sigmoid(logit)
        loss = -float((weights * np.log(np.clip(np.where(labels == 1, chance, 1 - chance), 1e-7, 1))).mean())

        g: dict[str, np.ndarray] = {}
        d_logit = (weights * (chance - labels) / rows).astype(np.float32)
        g["out"], g["out_bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["out"]
        d_states = share[:, :, None] * d_pooled
        d_share = np.einsum("trh,rh->tr", states, d_pooled)
        d_e = share * (d_share - (share * d_share).sum(0))
        g["attend_to"] = np.einsum("tra,tr->a", u, d_e)
        d_u = d_e[:, :, None] * p["attend_to"] * (1 - u * u)
        g["attend_bias"] = d_u.sum((0, 1))
        g["attend"] = states.reshape(-1, 2 * HIDDEN).T @ d_u.reshape(-1, ATTENTION)
        d_states = d_states + d_u @ p["attend"].T
        d_x = np.zeros_like(x)
        for d, part in (("f", d_states[:, :, :HIDDEN]), ("b", d_states[::-1, :, HIDDEN:])):
            d_gates, g[f"state_{d}"] = self._back(part, mask if d == "f" else mask[::-1], p[f"state_{d}"], kept[d])
            if d == "b":
                d_gates = d_gates[::-1]
            g[f"in_bias_{d}"] = d_gates.sum((0, 1))
            g[f"in_{d}"] = x.reshape(-1, 2 * VECTOR).T @ d_gates.reshape(-1, 3 * HIDDEN)
            d_x += d_gates @ p[f"in_{d}"].T
        d_flat = d_x.reshape(-1, 2 * VECTOR)
        self._learn(g)
        self._learn_rows("word", word_at, d_flat[cells, :VECTOR] * shown)
        self._learn_rows("gram", gram_at, (d_flat[cells, VECTOR:] * gram_share)[gram_of])
        return loss

    @staticmethod
    def _back(d_out: np.ndarray, mask: np.ndarray, state: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the gate inputs and of the state matrix."""
        steps, rows, _ = d_out.shape
        d_gates = np.zeros((steps, rows, 3 * HIDDEN), np.float32)
        d_state = np.zeros_like(state)
        d_h = np.zeros((rows, HIDDEN), np.float32)
        for t in reversed(range(steps)):
            h, z, r, new, own = kept[t]
            total = d_h + d_out[t]
            live = total * mask[t][:, None]
            d_new = live * (1 - z) * (1 - new * new)
            d_z = live * (h - new) * z * (1 - z)
            d_r = d_new * own * r * (1 - r)
            d_own = np.concatenate([d_z, d_r, d_new * r], 1)
            d_gates[t] = np.concatenate([d_z, d_r, d_new], 1)
            d_state += h.T @ d_own
            d_h = total - live + live * z + d_own @ state.T
        return d_gates, d_state

    def _learn(self, g: dict[str, np.ndarray], rate: float = 0.004) -> None:
        self.steps += 1
        for k, v in g.items():
            v = np.clip(v, -1, 1)
            self.mean[k] += 0.1 * (v - self.mean[k])
            self.seen[k] += 0.001 * (v * v - self.seen[k])
            mean = self.mean[k] / (1 - 0.9**self.steps)
            size = self.seen[k] / (1 - 0.999**self.steps)
            self.p[k] -= (rate * mean / (np.sqrt(size) + 1e-8)).astype(np.float32)

    def _learn_rows(self, name: str, at: np.ndarray, grad: np.ndarray, rate: float = 0.05) -> None:
        order = np.argsort(at, kind="stable")
        rows, first = np.unique(at[order], return_index=True)
        sums = np.add.reduceat(grad[order], first, axis=0)
        self.seen[name][rows] += sums * sums
        self.p[name][rows] -= rate * sums / (np.sqrt(self.seen[name][rows]) + 1e-6)


def fit_texts(toxic: list[str], clean: list[str], seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Fits on texts in memory.

    The calibration sees only scores of texts that the scoring network was not trained on: every fifth text is kept
    for it, or, where a class has fewer than ``FEW`` texts, three networks each score the third they were not shown.
    Without two texts of each class the score is a constant.
    """
    toxic, clean = [t for t in toxic if t], [t for t in clean if t]
    if len(toxic) < 2 or len(clean) < 2:
        share = (len(toxic) + 1) / (len(toxic) + len(clean) + 2)
        start = _start(np.random.Generator(np.random.PCG64(seed)))
        return Model(start, (0.0,) * 3, (1.0,) * 3, (0.0, 0.0, 0.0, float(np.log(share / (1 - share)))))
    few = min(len(toxic), len(clean)) < FEW
    folds = 3 if few else 5
    features, truth = [], []
    for fold in range(3) if few else (4,):
        shown = [[t for i, t in enumerate(texts) if i % folds != fold] for texts in (toxic, clean)]
        p = train(*shown, seed, epochs)
        for label, texts in ((1.0, toxic), (0.0, clean)):
            features.append(text_features(p, texts[fold::folds]))
            truth += [label] * len(features[-1])
    if few:
        p = train(toxic, clean, seed, epochs)
    calibration = fit_logistic(np.concatenate(features), np.array(truth), ridge=1.0)
    return Model(p, *(tuple(map(float, v)) for v in calibration))


def train(toxic: list[str], clean: list[str], seed: int = 7, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """The parameters of a network trained on texts of both classes."""
    trainer = Trainer(seed)
    texts = toxic + clean
    labels = np.array([1.0] * len(toxic) + [0.0] * len(clean), np.float32)
    found = W.words_of(texts)
    vocabulary = Vocabulary(found)
    spans = [[(a + s, a + e) for s, e in windows(int(found.first[i + 1] - a))] for i, a in enumerate(found.first[:-1])]
    kept = [i for i, s in enumerate(spans) if s]
    positive = sum(labels[i] for i in kept)
    weight = np.where(labels == 1, 0.5 * len(kept) / max(1, positive), 0.5 * len(kept) / max(1, len(kept) - positive))
    weight = np.sqrt(weight).astype(np.float32)

    # How much each word speaks for the label, by the texts it stands in.
    n_words = len(vocabulary.word_rows)
    counts = np.zeros((2, n_words))
    for i in kept:
        counts[int(labels[i])][np.unique(vocabulary.number[found.first[i] : found.first[i + 1]])] += 1
    totals = np.maximum(1, [len(kept) - positive, positive])
    odds = np.log((counts[1] + 0.2) / (totals[1] + 0.4)) - np.log((counts[0] + 0.2) / (totals[0] + 0.4))
    odds = np.where(counts[1] > 1, np.maximum(odds, 0), 0)

    rng = np.random.Generator(np.random.PCG64(seed))
    for epoch in range(epochs):
        if epoch < 3:
            of = lambda i: [float(odds[vocabulary.number[a:b]].max()) for a, b in spans[i]]
        else:
            logits, owner = window_logits(trainer.p, found)
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            of = lambda i, logits=logits, bounds=bounds: logits[bounds[i] : bounds[i + 1]]
        chosen = []
        for i in kept:
            worst = spans[i][int(np.argmax(of(i)))]
            chosen.append((i, worst))
            if labels[i] == 0:  # every window of a clean text is clean
                chosen += [(i, spans[i][k]) for k in rng.integers(0, len(spans[i]), 2)]
        rng.shuffle(chosen)
        for begin in range(0, len(chosen), BATCH):
            some = chosen[begin : begin + BATCH]
            picked = [(vocabulary, vocabulary.number[a:b]) for _, (a, b) in some]
            at = np.array([i for i, _ in some])
            trainer.step(picked, labels[at], weight[at])

    return trainer.p


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, id_column: str = "doc_id", text: str = "text"
) -> Model:
    """Trains on at most ``per_class`` labelled texts of each class (label 1 is toxic)."""
    found = labelled_sample(docs, labels, label, per_class, id_column, text)
    return fit_texts(found[1], found[0])


def scores(model: Model, texts: list[str | None] | pa.Array) -> np.ndarray:
    """Probabilities of toxicity."""
    z = (text_features(model.arrays, texts) - np.array(model.center)) / np.array(model.scale)
    w = np.array(model.weights)
    # Rounding hides that sums differ in their last bits with the batch a text stands in.
    return np.round(1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30))), 6)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns with the probability of toxicity (a column of that name is replaced).

    Whole texts are scored inside the scan, about 1 MB at a time, without a shuffle; the model (2 MB) goes along.
    """
    df = df.drop(out)
    at, names = df.columns.index(text), [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, text, 1 << 20):
            found = scores(model, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))
