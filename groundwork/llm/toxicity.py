"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, pairs of neighbours, and pairs with one or two words between them, and words cut to their first
four and five letters (a crude stem, for languages that inflect), each hashed into a fixed number of coordinates and
counted once a text. FTRL-proximal gives each coordinate its own learning rate and an L1
penalty, so that most weights are exactly 0 and what is broadcast is small and of bounded size. Some more passes
over the chosen coordinates, without the penalty, let their weights grow to what the labels ask for.

The model is fitted on a bounded sample of labelled rows (``Settings.rows``, taken in hash order of the id), by a
task: the driver gets the weights alone. Every text is scored whole, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import MEMO_ENTRIES, HashedWords, slices, tidied

#: Lower case for A-Z; ASCII punctuation, digits and control characters end words.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32) for b in range(256))

#: Letters of the crude stems.
STEMS = (4, 5)

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass(frozen=True)
class Settings:
    rows: int = 6000  #: labelled rows that the model is fitted on, at most
    bits: int = 20
    passes: int = 5  #: over the rows with the L1 penalty, which choose the coordinates
    more: int = 8  #: over the rows with the chosen coordinates alone, without it
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.14  #: times the square root of the number of rows, as the noise in a coordinate's sum grows
    l2: float = 0.001
    fold: int = 5  #: rows whose crc32(id) is divisible by it are held out


@dataclass(frozen=True)
class Weights:
    bits: int
    bias: float
    at: np.ndarray
    value: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float64)
        out[self.at] = self.value
        return out


def words_of(text: str | None) -> list[bytes]:
    return text.encode(errors="replace").translate(_TABLE).split() if text else []


class _Stems(HashedWords):
    """Word to the hash of its first letters."""

    def __init__(self, letters: int) -> None:
        super().__init__()
        self.letters = letters

    def __missing__(self, word: bytes) -> int:
        stem = word.decode(errors="ignore")[: self.letters].encode()
        value = xxhash.xxh3_64_intdigest(stem, seed=self.letters)
        if len(self) < MEMO_ENTRIES // 4:
            self[word] = value
        return value


class Featurizer:
    """Coordinates of texts' features; remembers hashes of a bounded number of words."""

    def __init__(self, bits: int) -> None:
        self.bits, self.words, self.stems = bits, HashedWords(), [_Stems(n) for n in STEMS]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Coordinate and number of the text, for every feature (repeats stay)."""
        words = [words_of(t) for t in texts]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        flat = [w for ws in words for w in ws]
        at, whose = coordinates(self.words.of(flat), owner, self.bits)
        stems = [(s.of(flat) >> np.uint64(64 - self.bits)).astype(np.int64) for s in self.stems]
        return np.concatenate([at, *stems]), np.concatenate([whose, *[owner] * len(stems)])


def coordinates(hashes: np.ndarray, owner: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all features of many texts, with the number of the text (repeats stay)."""
    shift = np.uint64(64 - bits)
    at, whose = [(hashes * _MULTIPLIERS[0]) >> shift], [owner]
    for gap in (1, 2, 3):
        if len(hashes) <= gap:
            break
        same = owner[:-gap] == owner[gap:]
        pair = (hashes[:-gap] * _MULTIPLIERS[gap] + (hashes[gap:] ^ (hashes[gap:] >> np.uint64(29))) * _MULTIPLIERS[0]) >> shift
        at.append(pair[same])
        whose.append(owner[:-gap][same])
    return np.concatenate(at).astype(np.int64), np.concatenate(whose)


def held_out(id_column: Column, fold: int = Settings.fold) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % fold == 0


def examples(documents: DataFrame, labels: DataFrame, label: str, settings: Settings, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """_text, _label of at most settings.rows labelled rows outside the held-out fold, texts whole; one partition, in order.

    The bound holds before any text moves. A label that stands on several rows of one id counts as its largest; of
    several texts under one id the first ones in order are taken. Null ids and labels and null texts are no examples.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~held_out(F.col(id_column), settings.fold)).groupBy(F.col(id_column).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(settings.rows)
    told = documents.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text}`").alias("_text")).filter(F.col("_text").isNotNull())
    found = told.join(F.broadcast(picked), "_id").orderBy(F.xxhash64("_id"), "_id", "_text").limit(settings.rows)
    return found.select("_text", "_label")


def sample(documents: DataFrame, labels: DataFrame, label: str, settings: Settings, id_column: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """The rows of ``examples``."""
    return [(r["_text"], r["_label"]) for r in examples(documents, labels, label, settings, id_column, text).toLocalIterator()]


def fit(rows: Iterable[tuple[str, int]], settings: Settings = Settings()) -> Weights:
    """FTRL-proximal over the rows; without rows of both labels, weights of 0 and the bias of their share.

    Of each row only its coordinates and its label are kept.
    """
    of, size = Featurizer(settings.bits), 1 << settings.bits
    features, told = [], []
    for text, y in rows:
        features.append(np.unique(of([text])[0]).astype(np.int32))
        told.append(y)
    del of
    z, n = np.zeros(size), np.zeros(size)
    ones = sum(told)
    share = (ones + 0.5) / (len(told) + 1)
    bias, bias_n = float(np.log(share / (1 - share))), 1.0
    if not 0 < ones < len(told):
        return Weights(settings.bits, bias, np.empty(0, np.int64), np.empty(0))

    def weights(at: np.ndarray, l1: float) -> np.ndarray:
        zi = z[at]
        rate = (settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / rate)

    order, l1 = np.random.default_rng(7), settings.l1 * np.sqrt(len(told))
    for turn in range(settings.passes + settings.more):
        if turn == settings.passes:
            chosen = np.abs(z) > l1
            features = [at[chosen[at]] for at in features]
            z[:], n[:], l1 = 0.0, 0.0, 0.0
        for k in order.permutation(len(told)):
            at, y = features[k], told[k]
            w = weights(at, l1)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha
            z[at] += g - sigma * w
            n[at] += g * g
            bias_n += g * g
            bias -= 0.1 * g / np.sqrt(bias_n)
    at = np.flatnonzero(z)
    return Weights(settings.bits, float(bias), at, weights(at, 0.0))


def fitted(rows: DataFrame, settings: Settings = Settings()) -> Weights:
    """``fit`` over ``examples`` by the task that holds them: neither texts nor their features come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = fit((row for batch in slices(batches, 256, "_text") for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), settings)
        columns = [pa.array([found.bias]), pa.array([found.at.astype("<i8").tobytes()]), pa.array([found.value.astype("<f8").tobytes()])]
        yield pa.RecordBatch.from_arrays(columns, names=["bias", "at", "value"])

    told = rows.mapInArrow(tidied(run), "bias double, at binary, value binary").collect()
    # A table without partitions has no task.
    return Weights(settings.bits, told[0]["bias"], np.frombuffer(told[0]["at"], "<i8"), np.frombuffer(told[0]["value"], "<f8")) if told else fit([], settings)


def score(documents: DataFrame, weights: Weights, text: str = "text", name: str = "score") -> DataFrame:
    """documents with a score from 0 to 1.

    Null and empty texts, and texts without a word, score as the bias says; very long ones are scored whole. Repeated rows score alike; an empty
    table gives an empty one; a column already called like the score is replaced.
    """
    kept = [c for c in documents.columns if c.lower() != name.lower()]
    source = documents.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), f"`{name}` double"])
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        dense, of = model.dense(), Featurizer(model.bits)
        # The features of texts take many times their memory.
        for batch in slices(batches, 256, text, most=500_000):
            at, whose = of(batch.column(batch.schema.get_field_index(text)).to_pylist())
            hit = dense[at] != 0
            pairs = np.unique((whose[hit] << model.bits) | at[hit])
            total = model.bias + np.bincount(pairs >> model.bits, dense[pairs & ((1 << model.bits) - 1)], minlength=batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, name])

    return source.mapInArrow(tidied(run), schema)


def scored(documents: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """documents with held_out, score and predicted; learnt from the labels of corpus (documents itself if not given).

    Null ids are rows like any other (their remainder is that of the empty text); see ``score`` for odd texts. Texts of equal
    scores are predicted alike; labelled rows of equal hash are taken in the order of their ids and texts.
    """
    weights = fitted(examples(documents if corpus is None else corpus, labels, "toxic", settings), settings)
    kept = [c for c in documents.columns if c.lower() not in ("held_out", "score", "predicted")]
    out = score(documents.select(*[F.col(f"`{c}`") for c in kept]), weights)
    told = [held_out(F.col("doc_id"), settings.fold).alias("held_out"), F.col("score"), (F.col("score") >= 0.5).cast("int").alias("predicted")]
    return out.select(*[F.col(f"`{c}`") for c in kept], *told)
