"""Quality rules: base rules on counts, and a calibrated logistic regression over hashed n-grams.

The counts (words, symbols, repeated lines, repeated windows of words) come from every whole text. The verdict of
a text that passes the base rules is a logistic regression over hashed words, word pairs and character 3- and
4-grams (relative frequencies), trained on labelled quality rows and calibrated (Platt) on a part of them that the
fit has not seen, held against a fixed threshold. Scoring runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import HashedWords, mix, slices
from groundwork.llm.toxicity import sample

SYMBOLS = "#*$%&|<>"
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_STARTS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Settings:
    rows: int = 2500  #: labelled rows that the model is fitted and calibrated on, at most
    bits: int = 16  #: coordinates of each of the four feature groups
    steps: int = 80
    rate: float = 0.5
    l2: float = 1e-4
    least: float = 0.4  #: calibrated probability from which a text is kept
    fold: int = 5


@dataclass(frozen=True)
class Model:
    bits: int
    weights: np.ndarray  #: float32, four groups of 2**bits
    bias: float
    slope: float  #: of the calibration
    offset: float


def counts(data: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text, given in UTF-8."""
    raw = np.frombuffer(data, np.uint8)
    histogram = np.bincount(raw, minlength=256)
    word_chars = int(histogram[_STARTS & ~_SPACES].sum())
    symbols = int(histogram[_SYMBOL].sum())
    lines = [line for line in data.split(b"\n") if line.split(None, 1)]
    repeat = 0
    if len(words) >= 6:
        window = mix(hashes[:-4])
        for k in range(1, 5):
            window = mix(window + hashes[k : len(hashes) - 4 + k])
        _, back, often = np.unique(window, return_inverse=True, return_counts=True)
        again = often[back] > 1
        if again.any():
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(again)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 5, -1)
            repeat = int((np.cumsum(edge[:-1]) > 0).sum())
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeat


def frequencies(data: bytes, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of a text's features: each group's relative frequencies, by their square roots' scale."""
    shift = np.uint64(64 - bits)
    groups = [mix(hashes) >> shift]
    groups.append(mix(hashes[:-1] * np.uint64(3) + hashes[1:]) >> shift)
    raw = _LOWER[np.frombuffer(data, np.uint8)].astype(np.uint32)
    if len(raw) >= 4:
        three = raw[:-3] | (raw[1:-2] << np.uint32(8)) | (raw[2:-1] << np.uint32(16))
        four = three | (raw[3:] << np.uint32(24))
        for gram, odd in ((three, 0x9E3779B1), (four, 0x85EBCA6B)):
            x = gram * np.uint32(odd)
            groups.append((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - bits))
    at, value = [], []
    for k, group in enumerate(groups):
        if len(group):
            n = np.bincount(group.astype(np.int64), minlength=1 << bits)
            hit = np.flatnonzero(n)
            x = np.sqrt(n[hit])
            at.append(hit + (k << bits))
            value.append(x / np.sqrt(np.dot(x, x)))
    return (np.concatenate(at), np.concatenate(value)) if at else (np.empty(0, np.int64), np.empty(0))


def fit(rows: list[tuple[str, int]], settings: Settings = Settings()) -> Model:
    """Full-batch Adam on three quarters of the rows, calibration on the rest; without both labels every text passes."""
    size = 4 << settings.bits
    ys = np.array([y for _, y in rows], np.float64)
    if not len(rows) or ys.min() == ys.max():
        return Model(settings.bits, np.zeros(size, np.float32), 0.0, 1.0, 5.0)
    memo, features = HashedWords(), []
    for text, _ in rows:
        data = (text or "").encode(errors="replace")
        features.append(frequencies(data, memo.of(data.lower().split()), settings.bits))
    length = np.array([len(a) for a, _ in features])
    at = np.concatenate([a for a, _ in features]).astype(np.int32)
    value = np.concatenate([v for _, v in features]).astype(np.float32)
    owner = np.repeat(np.arange(len(rows)), length)
    learn = np.arange(len(rows)) % 4 != 0
    use = learn[owner]
    a, v, o = at[use], value[use], owner[use]
    # Both labels weigh the same in the fit; the calibration puts the true shares back.
    share = ys[learn].mean()
    weight = np.where(ys == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) * learn / learn.sum()
    w, bias = np.zeros(size), 0.0
    m1, m2, b1, b2 = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, settings.steps + 1):
        margin = np.bincount(o, w[a] * v, minlength=len(rows)) + bias
        g = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - ys) * weight
        grad = np.bincount(a, v * g[o], minlength=size) + settings.l2 * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= settings.rate * 0.1 * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-6)
        gb = g.sum()
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        bias -= settings.rate * 0.1 * (b1 / c1) / (np.sqrt(b2 / c2) + 1e-6)
    margin = np.bincount(owner, w[at] * value, minlength=len(rows)) + bias
    slope, offset = _platt(margin[~learn], ys[~learn])
    return Model(settings.bits, w.astype(np.float32), float(bias), slope, offset)


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, by Newton's method on smoothed targets."""
    ones, zeros = y.sum(), len(y) - y.sum()
    if not ones or not zeros:
        return 1.0, 0.0
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * margin + ab[1], -35, 35)))
        r, s = p - target, p * (1 - p)
        grad = np.array([np.dot(r, margin), r.sum()])
        hess = np.array([[np.dot(s, margin * margin), np.dot(s, margin)], [np.dot(s, margin), s.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        ab -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(ab[0], 1e-3)), float(ab[1])


def judge(documents: DataFrame, model: Model, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality.

    Null text counts as empty: no words, failed by the base rules, not kept. Texts of any length are counted whole.
    Repeated rows are judged alike; an empty table gives an empty one; columns already called like the new ones are
    replaced. ``quality`` is the calibrated probability, null where the base rules fail.
    """
    added = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean", "quality": "double"}
    kept = [c for c in documents.columns if c.lower() not in added]
    source = documents.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), *(f"{k} {v}" for k, v in added.items())])
    shared = documents.sparkSession.sparkContext.broadcast(model)
    least = settings.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, memo, plain = shared.value, HashedWords(), HashedWords()
        weights = fitted.weights
        for batch in slices(batches, 1024, text):
            told: list[tuple] = []
            for x in batch.column(batch.schema.get_field_index(text)):
                data = (x.as_py() or "").encode(errors="replace")
                words = data.split()
                n, chars, symbols, lines, repeat = counts(data, words, plain.of(words))
                failed = n < 10 or 100 * repeat > 20 * n
                p = None
                if not failed:
                    at, value = frequencies(data, memo.of(data.lower().split()), fitted.bits)
                    margin = float(np.dot(weights[at], value)) + fitted.bias
                    p = float(1 / (1 + np.exp(-np.clip(fitted.slope * margin + fitted.offset, -35, 35))))
                told.append((n, chars, symbols, lines, repeat, failed, not failed and p >= least, p))
            columns = zip(*told, strict=True)
            types = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*batch.schema.names, *added])

    return source.mapInArrow(run, schema)


def judged(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """judge() with a model fitted on the labels of these documents.

    Texts of equal scores are judged alike; labelled rows of equal hash are taken in the order of their ids and texts.
    """
    return judge(documents, fit(sample(documents, labels, "quality", settings), settings), settings)
