"""Substring dedup: content-defined chunks of a gear rolling hash, deduplicated by their digests, to exact ends.

A gear hash rolls over the words. Of every few neighbouring places the one with the least hash is a border, so borders
depend on the words about them alone and come back behind an insertion; a chunk reaches from one border to the next,
with the words that the next one's hash has seen. Wherever two documents share as many words as make a passage, they
share a whole chunk (see ``shape``). Chunks are dealt by their digests, and those of one document alone are dropped.

To find the exact ends of what is shared, a chunk carries a short digest of each window of ``size`` words about it: every
window belongs to the first chunk in it, which its own words decide. Within a chunk that several documents hold, the
windows that occur in two or more of them are repeated, and repeated windows that touch are one passage. So a passage is
found whenever it is long enough, with its exact first and last word. Words end at ASCII white space; how much of it lies
between two words makes no difference. The first document (the smallest id) keeps a passage, the others are told what
to remove.

Each batch first settles what it can alone: of a window that it sees in several documents only those of the first go
on as candidates, so a chunk that a third of all documents share meets in one task at most once for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import mix, partitions, slices

WORDS = 20  #: words from which a run is a passage
GEAR_WORDS = 4  #: words that the gear hash remembers, at most
TAIL = 5  #: bytes of a window's digest that travel, beside its chunk's
TASKS = 2  #: tasks for each shuffle partition, against memory

_BYTES = np.random.default_rng(20240502).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  #: of the polynomials over bytes and over words
_WINDOW = np.dtype([("chunk", "<u8"), ("tail", "<u8"), ("doc", "<i8"), ("word", "<i4"), ("start", "<i4"), ("size", "<i4"), ("seen", "u1")])
_NO_ID = -(1 << 63)


def shape(size: int) -> tuple[int, int]:
    """Words that the gear hash remembers (g), and places of which the least is a border (w).

    Of a run of ``size`` words all borders are known that its own groups of w places choose. There are two of them if the
    run has more than w such groups, that is 2w + g - 1 words: a border stays the least in w groups at most, and a group
    that reaches out of the run chooses none between the first and the last of them (leftmost of equals).
    """
    if size < 2:
        raise ValueError("a passage has two words at least")
    g = min(GEAR_WORDS, max(1, size // 5))
    return g, (size - g + 1) // 2


def gear(words: np.ndarray, g: int) -> np.ndarray:
    """The rolling hash of each g neighbouring words: shifted on with each word, it forgets what is g words back."""
    n = len(words) - g + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(g):
        out = (out << np.uint64(64 // g if g > 1 else 0)) + words[k : k + n]
    return out


def borders(words: np.ndarray, size: int) -> np.ndarray:
    """For each group of w places (by its first): the place of the leftmost least gear hash."""
    g, w = shape(size)
    if len(words) < w + g - 1:
        return np.empty(0, np.int64)
    h = mix(gear(words, g)) >> np.uint64(32)
    return (_sliding_least(h << np.uint64(32) | np.arange(len(h), dtype=np.uint64), w) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _polynomials(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[begin:end] for each pair of places: sums of base**k * value, by differences of one sum."""
    sums = np.r_[np.uint64(0), np.cumsum(values * _powers(pow(base, -1, 1 << 64), len(values)), dtype=np.uint64)]
    return mix((sums[ends] - sums[begins]) * _powers(base, len(values) + 1)[begins] + (ends - begins).astype(np.uint64))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    done, n = 1, len(values) - width + 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[:n], values[width - done : width - done + n])


def windows(texts: list[str], size: int = WORDS) -> tuple[np.ndarray, ...]:
    """Of each window of ``size`` words within a text: text, first word, start, end (code points), digests of its chunk and
    of itself."""
    data = [x.encode(errors="replace") for x in texts]
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    at = np.cumsum([0, *[len(x) + 1 for x in data]])[:-1]
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    turns = np.flatnonzero(np.diff(np.r_[True, space].view(np.int8)))
    begins, ends = turns[::2], turns[1::2]
    if len(begins) < size:
        none = np.empty(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    g, w = shape(size)
    words = _polynomials(_BYTES[raw], begins, ends, _BASES[0])
    text = np.searchsorted(at, begins, "right") - 1
    border = borders(words, size)
    group = np.arange(len(border))
    chosen = np.unique(border[text[group] == text[group + w + g - 2]])
    first = np.arange(len(begins) - size + 1)
    first = first[text[first] == text[first + size - 1]]
    if not len(first):
        none = np.empty(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    # The chunk from a window's first border to the next, with the words that the next one's hash has seen.
    begin = border[first]
    end = chosen[np.searchsorted(chosen, begin, "right")] + g
    chunk = _polynomials(words, begin, end, _BASES[1])
    digest = _polynomials(words, first, first + size, _BASES[1])
    points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    text_of = text[first]
    zero = points[at[text_of]]
    return text_of, first - np.searchsorted(begins, at)[text_of], points[begins[first]] - zero, points[ends[first + size - 1]] - zero, chunk, digest


def _planes(values: np.ndarray, most: int | None = None) -> bytes:
    """Byte by byte: all lowest bytes first; of the first ``most`` bytes of each value."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T[:most]).tobytes()


def _unplaned(raw: memoryview, kind: np.dtype, n: int, width: int | None = None) -> np.ndarray:
    width = width or kind.itemsize
    whole = np.zeros((kind.itemsize, n), np.uint8)
    whole[:width] = np.frombuffer(raw, np.uint8, width * n).reshape(width, n)
    return np.ascontiguousarray(whole.T).view(kind).ravel()


def _packed(part: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """Windows by part number: chunk, document and place once for each run of neighbours in one chunk, the rest for each."""
    order = np.argsort(part, kind="stable")
    part, records = part[order], records[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    squeeze = zstandard.ZstdCompressor(level=1).compress
    made = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True):
        some = records[a:b]
        head = np.r_[True, (some["chunk"][1:] != some["chunk"][:-1]) | (some["doc"][1:] != some["doc"][:-1]) | (np.diff(some["word"]) != 1)]
        heads = some[head]
        exact = b"".join([_planes(heads["chunk"]), _planes(some["tail"], TAIL)]) if some["tail"].any() else b""
        rest = [_planes(np.diff(heads[c], prepend=heads[c].dtype.type(0))) for c in ("doc", "word")]
        rest += [_planes(np.diff(some[c], prepend=np.int32(0))) for c in ("start", "size")] + [_planes(some["seen"]), np.packbits(head).tobytes()]
        loose = squeeze(b"".join(rest))
        made.append(np.array([len(some), len(heads), len(exact)], "<u4").tobytes() + exact + loose)
    return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(made, pa.binary())], names=["part", "blob"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    found = []
    for blob in (x.as_py() for batch in batches for x in batch.column("blob")):
        n, m, size = np.frombuffer(blob, "<u4", 3).tolist()
        out, raw = np.zeros(n, _WINDOW), memoryview(blob)
        rest = memoryview(zstandard.ZstdDecompressor().decompress(raw[12 + size :]))
        at = {}
        for name, width, count in (("doc", 8, m), ("word", 4, m), ("start", 4, n), ("size", 4, n), ("seen", 1, n)):
            at[name], rest = _unplaned(rest, _WINDOW[name], count), rest[width * count :]
            if name != "seen":
                at[name] = np.cumsum(at[name], dtype=_WINDOW[name])
        head = np.unpackbits(np.frombuffer(rest, np.uint8), count=n).astype(bool)
        of = np.cumsum(head) - 1
        out["doc"] = at["doc"][of]
        out["word"] = at["word"][of] + (np.arange(n) - np.flatnonzero(head)[of])
        for name in ("start", "size", "seen"):
            out[name] = at[name]
        if size:
            out["chunk"] = _unplaned(raw[12:], _WINDOW["chunk"], m)[of]
            out["tail"] = _unplaned(raw[12 + 8 * m :], _WINDOW["tail"], n, TAIL)
        found.append(out)
    return np.concatenate(found) if found else np.empty(0, _WINDOW)


def _by_doc(found: np.ndarray) -> np.ndarray:
    return found["doc"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _dealt(parts: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            ids = np.array([_NO_ID if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            place = np.argsort(ids, kind="stable")
            texts = batch.column(1)
            text, word, start, end, chunk, digest = windows([texts[int(k)].as_py() or "" for k in place], size)
            if not len(text):
                continue
            found = np.empty(len(text), _WINDOW)
            found["chunk"], found["tail"], found["doc"], found["word"], found["start"], found["size"] = chunk, digest >> np.uint64(64 - 8 * TAIL), ids[place][text], word, start, end - start
            found["seen"] = 0
            order = np.argsort(digest, kind="stable")
            doc = found["doc"][order]
            begins = np.flatnonzero(np.r_[True, np.diff(digest[order]) != 0])
            count = np.diff(np.r_[begins, len(doc)])
            several = np.repeat(doc[np.r_[begins[1:], len(doc)] - 1] != doc[begins], count)
            found["seen"][order] = np.where(several, np.where(doc == np.repeat(doc[begins], count), 1, 2), 0)
            # What is settled goes to its document; the rest meets by its chunk's digest.
            settled = found["seen"] == 2
            found["chunk"][settled] = found["tail"][settled] = 0
            key = np.where(settled, _by_doc(found), mix(found["chunk"]))
            yield _packed((key >> np.uint64(33)) % np.uint64(parts), found)

    return run, "part int, blob binary"


def _shared(rows: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows, of which a new group begins at each turn: whether the group is of several documents (some of which
    a batch may have settled), and whether the row is of the first one."""
    if not len(rows):
        return np.zeros(0, bool), np.zeros(0, bool)
    begins = np.flatnonzero(np.r_[True, turns])
    count = np.diff(np.r_[begins, len(rows)])
    low, high = np.minimum.reduceat(rows["doc"], begins), np.maximum.reduceat(rows["doc"], begins)
    several = np.repeat((low != high) | (np.maximum.reduceat(rows["seen"], begins) > 0), count)
    return several, rows["doc"] == np.repeat(low, count)


def _settled(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The repeated windows, dealt by document; seen tells whether an earlier document holds one."""
        found = _unpacked(batches)
        done, open_ = found[found["seen"] == 2], found[found["seen"] != 2]
        # Chunks by their digests: what one document alone holds goes.
        open_ = open_[np.argsort(open_["chunk"], kind="stable")]
        open_ = open_[_shared(open_, open_["chunk"][1:] != open_["chunk"][:-1])[0]]
        # Windows of the chunks that are left, to exact ends.
        open_ = open_[np.lexsort((open_["tail"], open_["chunk"]))]
        several, first = _shared(open_, (open_["chunk"][1:] != open_["chunk"][:-1]) | (open_["tail"][1:] != open_["tail"][:-1]))
        open_["seen"] = np.where(first, 1, 2)
        found = np.concatenate([done, open_[several]])
        found["chunk"] = found["tail"] = 0
        if len(found):
            found = found[np.lexsort((found["word"], found["doc"]))]
            yield _packed((_by_doc(found) >> np.uint64(33)) % np.uint64(parts), found)

    return run, "part int, blob binary"


def _joined(found: np.ndarray, size: int) -> tuple[np.ndarray, pa.Array]:
    """Windows (sorted by doc and word) that touch joined: doc, and struct<start, end, words> of each passage."""
    new_doc = np.r_[True, found["doc"][1:] != found["doc"][:-1]]
    begins = np.flatnonzero(np.r_[True, new_doc[1:] | (np.diff(found["word"]) > size)])
    lasts = np.r_[begins[1:], len(found)] - 1
    if not len(found):
        begins, lasts = begins[:0], lasts[:0]
    end = np.maximum.reduceat(found["start"] + found["size"], begins) if len(begins) else np.empty(0, np.int32)
    words = found["word"][lasts] - found["word"][begins] + size
    return found["doc"][begins], pa.StructArray.from_arrays([pa.array(found["start"][begins], pa.int32()), pa.array(end, pa.int32()), pa.array(words, pa.int32())], names=["start", "end", "words"])


def _gathered(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _unpacked(batches)
        found = found[np.lexsort((found["start"], found["word"], found["doc"]))]
        docs = np.unique(found["doc"])
        lists = []
        for some in (found, found[found["seen"] == 2]):
            doc, items = _joined(some, size)
            lists.append(pa.ListArray.from_arrays(pa.array(np.r_[np.searchsorted(doc, docs), len(doc)], pa.int32()), items))
        whole = pa.RecordBatch.from_arrays([pa.array(docs), *lists], names=["doc", "passages", "removed"])
        for a in range(0, len(docs), 10_000):
            yield whole.slice(a, 10_000)

    item = "array<struct<start:int,end:int,words:int>>"
    return run, f"doc long, passages {item}, removed {item}"


def passages(documents: DataFrame, id_column: str = "doc_id", text: str = "text", least_words: int = WORDS) -> DataFrame:
    """One row for each document that holds a repeated passage: doc_id, passages, removed.

    Both are array<struct<start, end, words>> in code points: all repeated passages, and those parts that an earlier
    document (by id) holds too. Documents without a repeated passage have no row, so null and empty texts have none,
    nor does an empty table. Very long texts are cut into chunks whole. Rows with one id are one document; rows without
    an id are together one document, told as null. Of documents with the same passage the one with the smallest id is
    the first. Other columns are not read, whatever they are called. Passages that only one document holds, however often, are no business of this operator.
    """
    spark = documents.sparkSession
    parts = TASKS * partitions(spark)
    rows = documents.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    # A part is a task, where hashed part numbers would bring several parts into one.
    met = rows.mapInArrow(*_dealt(parts, least_words)).repartitionById(parts, F.col("part")).mapInArrow(*_settled(parts))
    told = met.repartitionById(parts, F.col("part")).mapInArrow(*_gathered(least_words))
    return told.select(F.when(F.col("doc") != _NO_ID, F.col("doc")).alias(id_column), "passages", "removed")


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    def line(name: str) -> Column:
        return F.array_join(F.transform(name, lambda x: F.concat_ws(":", x["start"], x["end"])), ",")

    def words(name: str) -> Column:
        return F.aggregate(name, F.lit(0).cast("long"), lambda acc, x: acc + x["words"])

    return found.select(id_column, F.size("passages").cast("long").alias("n_passages"), words("passages").alias("n_words"), words("removed").alias("n_removed_words"), line("passages").alias("spans"), line("removed").alias("removed_spans"))


#: The same rows in SQL: every window of 20 words as text, without chunks.
PASSAGES_SQL = rf"""
WITH s AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS s FROM documents),
u AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM s),
v AS (SELECT doc_id, x, i, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM u),
w AS (SELECT doc_id, x, e - length(x) AS b, e, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM v WHERE regexp_matches(x, '^[^\x20\x09-\x0D]')),
l AS (SELECT doc_id, list(x ORDER BY k) AS xs FROM w GROUP BY doc_id HAVING count(*) >= {WORDS}),
h AS (SELECT doc_id, k, md5(array_to_string(xs[k : k + {WORDS - 1}], ' ')) AS h FROM (SELECT doc_id, xs, unnest(range(1, len(xs) - {WORDS - 2})) AS k FROM l)),
g AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h HAVING min(doc_id) <> max(doc_id)),
r AS (SELECT h.doc_id, h.k, a.b, z.e, h.doc_id <> first AS late FROM h JOIN g USING (h) JOIN w a ON a.doc_id = h.doc_id AND a.k = h.k JOIN w z ON z.doc_id = h.doc_id AND z.k = h.k + {WORDS - 1}),
b AS (SELECT doc_id, k, b, e, FALSE AS late FROM r UNION ALL SELECT doc_id, k, b, e, TRUE FROM r WHERE late),
t AS (SELECT *, coalesce(k - lag(k) OVER (PARTITION BY doc_id, late ORDER BY k) > {WORDS}, TRUE) AS new FROM b),
n AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, late ORDER BY k) AS run FROM t),
p AS (SELECT doc_id, late, run, min(b) AS b, max(e) AS e, max(k) - min(k) + {WORDS} AS words FROM n GROUP BY ALL)
SELECT doc_id, count(*) FILTER (NOT late) AS n_passages, coalesce(sum(words) FILTER (NOT late), 0)::BIGINT AS n_words, coalesce(sum(words) FILTER (late), 0)::BIGINT AS n_removed_words,
  coalesce(string_agg(b || ':' || e, ',' ORDER BY b) FILTER (NOT late), '') AS spans, coalesce(string_agg(b || ':' || e, ',' ORDER BY b) FILTER (late), '') AS removed_spans FROM p GROUP BY doc_id
"""
