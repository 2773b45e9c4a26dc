"""Byte-level BPE over a table of distinct words.

Spark splits the texts: a task gathers slices of whole texts, and of each slice keeps its distinct words and, word by
word, their numbers. Only distinct words travel, packed by bucket of their hash; a bucket is where a word's rows from
all slices meet, so each distinct word of the corpus stands in one row of the word table and is encoded once. Its ids
are decoded through a join with the table of pieces. Ids and bytes go back to the slices that asked, where the numbers
tell the place of each word.

Within a slice a word is counted once, so even a word that is in every text is a tiny share of what meets in a bucket.

A slice travels as many small rows, none near its size, and a worker gives back what it has freed when a task ends: an
executor's workers live on, and those that wait would hold a slice's memory beside those that work.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.common import give_back, partitions, slices, tidied

SLICE_BYTES = 16_000_000  #: of texts in a slice; a longer text is a slice of its own
ROW_BYTES = 16  #: that a row counts beside its text, so that slices of empty texts end too
CHUNK = 250_000  #: words of a slice's texts in a row
BUCKETS = 2  #: for each shuffle partition, against memory
FLUSH = 100_000  #: words whose answers are packed at a time
FLUSH_USES = 1_000_000  #: and uses of words
BITS = 24  #: of an id within a number that holds two
LATIN = 0x250  #: characters below are looked at when a worker starts, others when they turn up

#: What splits a text into words before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_GAP = b"\xff"  # in no UTF-8 text


def _byte_names() -> list[str]:
    """The character that stands for each byte in pieces: printable ones for themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    later = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(later)) for b in range(256)]


class Differs(ValueError):
    """The merges and the library disagree on a word."""


class Encoder:
    """Splitter and merges of one tokenizer file."""

    def __init__(self, path: str) -> None:
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        before, model = told.get("pre_tokenizer") or {}, told["model"]
        odd = told.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)
        if odd or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(t.get(c) for t in told.get("added_tokens", []) for c in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"{path} has added tokens that change the text about them")
        self.added = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.added_split = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")").split if self.added else None
        names = _byte_names()
        self.byte_of = {c: b for b, c in enumerate(names)}
        self.bytes_of = {v: bytes(self.byte_of[c] for c in p) for p, v in model["vocab"].items()} | {v: c.encode() for c, v in self.added.items()}
        vocab = {self.bytes_of[v]: v for v in model["vocab"].values()}
        self.single = [vocab[bytes([b])] for b in range(256)]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        as_bytes = lambda p: bytes(self.byte_of[c] for c in p)
        #: left id and right id, as one number, to rank and merged id, as one number
        self.merges = {vocab[a] << BITS | vocab[b]: k << BITS | vocab[a + b] for k, (a, b) in enumerate((as_bytes(x), as_bytes(y)) for x, y in merges)}
        self.find = regex.compile(PATTERN).findall
        self.beyond = re.compile(f"[^\\x00-{chr(LATIN - 1)}]").search
        self.agreed: set[str] = set()
        self.disputed: set[str] = set()
        self._look(map(chr, range(LATIN)))

    def _look(self, chars) -> None:
        """Sort characters by whether the pattern and the library (with another version of Unicode) class them alike."""
        kinds = [("a", r"\p{L}"), ("1", r"\p{N}"), ("!", r"[^\s\p{L}\p{N}]")]
        joins = self.library.pre_tokenizer.pre_tokenize_str
        for c in chars:
            alike = all((len(joins(x + c)) == 1) == bool(regex.fullmatch(kind, c)) for x, kind in kinds)
            (self.agreed if alike else self.disputed).add(c)

    def words(self, text: str) -> list[str]:
        """The words of a text; joined they are the text."""
        if not self.added_split:
            return self._words(text)
        out: list[str] = []
        for k, part in enumerate(self.added_split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out += self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if self.beyond(text):
            chars = set(text)
            self._look(chars - self.agreed - self.disputed)
            if not self.disputed.isdisjoint(chars):
                return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def encode(self, word: str) -> list[int]:
        """The ids of one word: again and again the pair of lowest rank is merged, wherever it stands."""
        if (own := self.added.get(word)) is not None:
            return [own]
        ids = [self.single[b] for b in word.encode()]
        merge, none = self.merges.get, 1 << 62
        found = [merge(a << BITS | b, none) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) < none:
            out, k, last, made = [], 0, len(found), best & (1 << BITS) - 1
            while k <= last:
                if k < last and found[k] == best:
                    out.append(made)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
            found = [merge(a << BITS | b, none) for a, b in zip(ids, ids[1:])]
        return ids

    def encode_all(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words, held against the library: where they differ the job fails."""
        own = [self.encode(w) for w in words]
        for w, ids, told in zip(words, own, self.library.encode_batch_fast(words, add_special_tokens=False), strict=True):
            if told.ids != ids:
                raise Differs(f"the merges and the library differ on {w[:200]!r}")
        return own


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """id, piece (its bytes): the whole vocabulary, whose size the file fixes."""
    return spark.createDataFrame(sorted(encoder_of(path).bytes_of.items()), "id int, piece binary")


# Packing: what repeats lies together, and is compressed.


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as planes of bytes, the plane of the highest bytes first; they come back as unsigned ones of 32 bits."""
    planes = np.ascontiguousarray(numbers.astype(">u4")).view(np.uint8).reshape(-1, 4).T
    return b"".join(len(z).to_bytes(4, "little") + z for z in (_pack(x.tobytes()) for x in planes))


def _unpack_numbers(raw: bytes) -> np.ndarray:
    planes, at = [], 0
    for _ in range(4):
        n = int.from_bytes(raw[at : at + 4], "little")
        planes.append(np.frombuffer(_unpack(raw[at + 4 : at + 4 + n]), np.uint8))
        at += 4 + n
    return np.ascontiguousarray(np.stack(planes, axis=1)).view(">u4").ravel().astype(np.uint32)


class Numbered(dict):
    """Word to its number, in the order of first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


SLICED = "slice long, bucket int, first int, packed binary, keys array<long>, counts array<int>"


def _sliced_rows(number: int, bucket: list, first: list, packed: list, keys: list | None = None, counts: list | None = None) -> pa.RecordBatch:
    n = len(first)
    columns = [[number] * n, bucket, first, packed, [keys] * n, [counts] * n]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["slice", "bucket", "first", "packed", "keys", "counts"])


def _sliced(path: str, buckets: int, most: int):
    """Texts to slices. A slice is several rows: its distinct words, a row for each bucket (first: the number of the first of
    them); and what stays behind, without a bucket: at first 0 the ids of its rows and the count of words of each, from -1
    down the numbers of its words by rank and from 1 up the ranks of all words of its texts, CHUNK in a row.

    Words are numbered by bucket, and within a bucket from the most frequent on.
    """

    def parts(number: int, keys: list, counts: list, codes: list, seen: Numbered) -> Iterator[pa.RecordBatch]:
        code, distinct = np.concatenate(codes), list(seen)
        codes.clear()
        seen.clear()
        chunks = [code[a : a + CHUNK] for a in range(0, len(code), CHUNK)]
        often = np.zeros(len(distinct), np.int64)
        for x in chunks:
            often += np.bincount(x, minlength=len(distinct))
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in distinct), np.int64, len(distinct))
        order = np.lexsort((-often, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        held = [(k, a, b) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        blobs = [_pack(_GAP.join([distinct[k].encode() for k in order[a:b].tolist()])) for _, a, b in held]
        del distinct
        if held:
            yield _sliced_rows(number, [k for k, _, _ in held], [a for _, a, _ in held], blobs)
        # Frequent words have small numbers in what is stored, whichever their bucket.
        by_rank = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[by_rank] = np.arange(len(order))
        yield _sliced_rows(number, [None], [0], [None], keys, counts)
        for k, a in enumerate(range(0, len(order), CHUNK), 1):
            yield _sliced_rows(number, [None], [-k], [_pack_numbers(place[by_rank[a : a + CHUNK]])])
        for k, x in enumerate(chunks, 1):
            yield _sliced_rows(number, [None], [k], [_pack_numbers(rank[x])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        number = TaskContext.get().partitionId() << 32
        keys, counts, codes, seen, size = [], [], [], Numbered(), 0
        for batch in slices(batches, 1024):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = encoder.words(text) if text else []
                n = ROW_BYTES + len(text or "")
                if keys and size + n > most:
                    yield from parts(number, keys, counts, codes, seen)
                    keys, counts, codes, seen, size = [], [], [], Numbered(), 0
                    number += 1
                keys.append(key)
                counts.append(len(found))
                codes.append(np.fromiter(map(seen.__getitem__, found), np.uint32, len(found)))
                size += n
        if keys:
            yield from parts(number, keys, counts, codes, seen)

    return tidied(run), SLICED


@tidied
def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of slices those with words."""
    for batch in batches:
        yield batch.filter(batch.column("bucket").is_valid()).select(["bucket", "slice", "first", "packed"])


ASKED = "bucket int, slice long, first int, packed binary"
_USE = np.dtype([("slice", "<i8"), ("number", "<u4")])


def _distinct(path: str):
    """The distinct words of each bucket with their uses (which slices hold one, and its number there) and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Spark deals the words out; the library's threads, one for each core of the machine, would each hold on to memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(path)
        for batch in batches:
            for k in range(batch.num_rows):
                seen, which, uses = Numbered(), [], []
                for row in batch.column(0)[k].as_py():
                    found = _unpack(row["packed"]).split(_GAP)
                    which.append(np.fromiter(map(seen.__getitem__, found), np.int64, len(found)))
                    uses.append(np.empty(len(found), _USE))
                    uses[-1]["slice"], uses[-1]["number"] = row["slice"], np.arange(row["first"], row["first"] + len(found))
                whose = np.concatenate(which)
                held = np.concatenate(uses)[np.argsort(whose, kind="stable")].tobytes()
                ends = [0, *(np.cumsum(np.bincount(whose)) * _USE.itemsize).tolist()]
                words = [word.decode() for word in seen]
                del seen, which, uses, whose
                for a in range(0, len(words), 10_000):
                    some = words[a : a + 10_000]
                    own = [held[x:y] for x, y in zip(ends[a:], ends[a + 1 : a + 1 + len(some)])]
                    columns = [pa.array(some, pa.string()), pa.array(own, pa.binary()), pa.array(encoder.encode_all(some), pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["word", "uses", "ids"])

    return tidied(run), "word string, uses binary, ids array<int>"


def word_table(asked: DataFrame, path: str) -> DataFrame:
    """word, uses (with the first id alone), at, id, piece: the ids of each distinct word of the corpus, in their order.

    ids come from the merges, and each meets its piece in a join. A word's rows follow each other in one task: explode
    and a broadcast join keep the order of rows, so no shuffle has to bring them together again.
    """
    met = asked.groupBy("bucket").agg(F.collect_list(F.struct("slice", "first", "packed")).alias("asked")).select("asked")
    each = met.mapInArrow(*_distinct(path)).select("word", "uses", F.posexplode("ids").alias("at", "id"))
    return each.join(F.broadcast(pieces(asked.sparkSession, path)), "id").select("word", F.when(F.col("at") == 0, F.col("uses")).alias("uses"), "at", "id", "piece")


ANSWERED = "slice long, answer binary"


@tidied
def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and bytes of words, packed for each slice that holds them."""

    def packed(uses: list[bytes], of: list[int], ids: list[list[int]], texts: list[bytes]) -> pa.RecordBatch:
        use = np.frombuffer(b"".join(uses), _USE)
        word = np.repeat(np.arange(len(ids)), of)
        order = np.lexsort((use["number"], use["slice"]))
        use, word = use[order], word[order]
        edges = np.flatnonzero(np.r_[True, use["slice"][1:] != use["slice"][:-1]]).tolist()
        blobs = []
        for a, b in zip(edges, [*edges[1:], len(use)], strict=True):
            some = word[a:b].tolist()
            parts = [
                _pack_numbers(use["number"][a:b]), _pack_numbers(np.array([len(ids[k]) for k in some])), _pack_numbers(np.array([i for k in some for i in ids[k]])),
                _pack_numbers(np.array([len(texts[k]) for k in some])), _pack(b"".join([texts[k] for k in some])),
            ]
            blobs.append(b"".join(len(x).to_bytes(8, "little") + x for x in parts))
        return pa.RecordBatch.from_arrays([pa.array(use["slice"][edges]), pa.array(blobs, pa.binary())], names=["slice", "answer"])

    uses, of, ids, texts, many = [], [], [], [], 0
    for batch in batches:
        column = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        for use, at, own, made in zip(column["uses"], column["at"], column["id"], column["piece"], strict=True):
            if at:
                if not ids or len(ids[-1]) != at:
                    raise RuntimeError("a word's ids do not follow each other")
                ids[-1].append(own)
                texts[-1] += made
                continue
            if len(uses) > FLUSH or many > FLUSH_USES:
                yield packed(uses, of, ids, texts)
                uses, of, ids, texts, many = [], [], [], [], 0
            uses.append(use)
            of.append(len(use) // _USE.itemsize)
            many += of[-1]
            ids.append([own])
            texts.append(made)
    if uses:
        yield packed(uses, of, ids, texts)


def _answered(raw: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """Of a packed answer: number, ids as little-endian 32-bit integers, and bytes of each word."""
    parts, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        parts.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    numbers, many, ids, sizes = map(_unpack_numbers, parts[:4])
    flat, text = ids.astype("<u4").tobytes(), _unpack(parts[4])
    ends, stops = (4 * np.cumsum(many, dtype=np.int64)).tolist(), np.cumsum(sizes, dtype=np.int64).tolist()
    for number, a, b, c, d in zip(numbers.tolist(), [0, *ends], ends, [0, *stops], stops):
        yield number, flat[a:b], text[c:d]


def _gathered(digests: bool):
    """The ids and the decoded text of each row of a slice, from the words' places; or their digests."""

    def gathered(held: pa.Table, answers: pa.Table) -> pa.Table:
        held = held.filter(held.column("bucket").is_null())
        first, packed = held.column("first").to_pylist(), held.column("packed").to_pylist()
        keys, counts = (held.column(c)[first.index(0)].as_py() for c in ("keys", "counts"))
        parts, none = dict(zip(first, packed, strict=True)), np.empty(0, np.uint32)
        number, ranks = (np.concatenate([none, *(_unpack_numbers(parts[k]) for k in sorted(parts, key=abs) if k * sign > 0)]) for sign in (-1, 1))
        if len(ranks) != sum(counts):
            raise RuntimeError("a slice lacks a part")
        del held, packed, parts
        ids_of: list[bytes | None] = [None] * len(number)
        text_of: list[bytes | None] = [None] * len(number)
        for raw in answers.column("answer"):
            for k, ids, text in _answered(raw.as_py()):
                ids_of[k], text_of[k] = ids, text
        out, at = [], 0
        for key, count in zip(keys, counts, strict=True):
            own = number[ranks[at : at + count]].tolist()
            at += count
            ids = b"".join([ids_of[k] for k in own])
            text = b"".join([text_of[k] for k in own]).decode(errors="replace")
            if digests:
                out.append((key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            else:
                out.append((key, np.frombuffer(ids, "<i4"), text))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] if digests else [pa.int64(), pa.list_(pa.int32()), pa.string()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", *(["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])])

    def run(held: pa.Table, answers: pa.Table) -> pa.Table:
        try:
            return gathered(held, answers)
        finally:
            give_back()

    return run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "key long, ids array<int>, decoded string"


def _encoded(documents: DataFrame, path: str, id_column: str, text: str, digests: bool, slice_bytes: int) -> DataFrame:
    buckets = BUCKETS * partitions(documents.sparkSession)
    rows = documents.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    # Both uses of a slice, its words and its numbers, read one shuffle: it is computed and written once.
    dealt = rows.mapInArrow(*_sliced(path, buckets, slice_bytes)).repartition("slice")
    answers = word_table(dealt.mapInArrow(_asked, ASKED), path).drop("word").mapInArrow(_answers, ANSWERED)
    told = dealt.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(*_gathered(digests))
    return told.withColumnRenamed("key", id_column)


def encode_decode(documents: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Of each row: its id, n_tokens, ids_sha256 and decoded_sha256 (of the ids as little-endian 32-bit integers, and of the
    text that they decode to).

    The file's path must be readable on the driver and every executor. Null text counts as empty: no ids. The string of
    an added token is that token, as the library has it. Very long texts are encoded whole, in slices of their own.
    Pairs of one rank are merged from the left; repeated rows and ids each get their row, null ids too; an empty table
    gives an empty result; other columns are left out, whatever they are called.
    """
    return _encoded(documents, path, id_column, text, True, slice_bytes)


def ids_and_text(documents: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Of each row: its id, ids (array<int>) and the decoded text; empty cases as in encode_decode."""
    return _encoded(documents, path, id_column, text, False, slice_bytes)
