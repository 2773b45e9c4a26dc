"""N-gram Jaccard join: documents whose sets of 5-word shingles have a similarity of at least 0.75.

1. Shingle sets. Each text becomes a set of 64-bit shingle hashes; equal sets are one set. Sets are dealt out by
   shingle as packed blobs. A shingle that only one set holds takes no part in any overlap, so only the others
   come back, with the number of sets that hold them, and only sets of which at least three quarters came back go
   on: no other can be linked with anything.
2. Lists. Shingles are ordered from rare to frequent. Two linked sets have a shingle in common among the first
   quarter (and one) of each in this order: the sets with one such shingle are its list.
3. Links to hubs, a head start. Each set is held against one hub of its lists, not against all members, so large
   groups of near copies cost one comparison a member. Lists whose members are then in one component are settled.
4. T-occurrence search (DivideSkip). Sets of open lists form blocks of bounded size, by size and the most frequent shingle that
   they are listed under; two blocks meet in one task if an open list has members in both, and of each the sets of such
   lists are sent there. A task holds the inverted lists of one block and takes the sets of the other as queries: short lists are merged by a heap, which keeps
   candidates that reach T less the number of long lists; the long lists are probed by binary search; what reaches the
   required overlap is a link. No pair of sets is ever a row: a task tells at most one link for each of its sets.
5. Connected components of the links.

Nothing is capped: lists, groups and candidates of any size go through. Sets are named by 96-bit digests (two of 10**13
sets share one with a chance of 1 in 1,000). Packed shingles carry 80 bits of a name, since names are most of what is
sent once a set has few shingles in a part; names that differ in the other bits alone fail the job and are never taken
for one set (among 5 * 10**10 sets, a chance of 1 in 1,000). Shingles are told apart by 48 bits and the number of the
part that they fall in (modulo 4,096).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import HashedWords, cut, few, mix, partitions, release, slices, tidied
from groundwork.llm.components import components

SHINGLE = 5
#: Sets, and shingles, that a block of the search holds about.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 800_000
#: Candidates that are held against a hub at once.
HUB_BLOCK = 256
#: Rounds over hubs at most; they end when one links fewer than GAIN of what the first did. Each set brings so many
#: shingles to them.
HUB_ROUNDS, GAIN, HEAD = 6, 0.1, 8
#: Sets that a task remembers so as not to send the shingles of copies again.
SEEN = 200_000
#: Bytes of a set's name, and of the name and the count that stand before its packed shingles.
NAME = 12
HEAD_BYTES = 11
#: Shingles that one such count holds.
COUNT = 255
#: Documents with one set from which the lookup of their component is dealt over several tasks.
HOT = 100_000
#: The published constant of DivideSkip: how much longer a probe of the long lists takes than a step of the merge.
MU = 0.0085

_MASK = np.uint64((1 << 48) - 1)
#: What of a name stands before its packed shingles.
_SENT = np.array([(1 << 64) - 1, (1 << 16) - 1], np.uint64)
_SET = "part int, kind int, doc_id long, row long, ident binary, n int, blob binary"
_NEVER = 1 << 40


def required(n: np.ndarray | int, m: np.ndarray | int):
    """Least overlap of sets of n and m with 100 * intersection >= 75 * union: 7 * overlap >= 3 * (n + m)."""
    return -(-3 * (n + m) // 7)


def shingle_sets(texts: list[str | None], memo: HashedWords) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle has are one shingle, no words none."""
    words = [x.encode(errors="replace").lower().split() if x else [] for x in texts]
    length = np.array([len(w) for w in words], np.int64)
    flat = memo.of([w for ws in words for w in ws])
    rolled = flat[: max(len(flat) - SHINGLE + 1, 0)].copy()
    for k in range(1, SHINGLE):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + flat[k : len(flat) - SHINGLE + 1 + k])
    out, begin = [], 0
    for w, n in zip(words, length.tolist(), strict=True):
        if n >= SHINGLE:
            out.append(np.unique(rolled[begin : begin + n - SHINGLE + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=n)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        begin += n
    return out


def _batch(part: list, kind: int, ident: pa.Array | None = None, n: list | None = None, blob: list | None = None, doc: pa.Array | None = None, row: pa.Array | None = None) -> pa.RecordBatch:
    size = len(part)
    columns = [
        pa.array(part, pa.int32()),
        pa.array([kind] * size, pa.int32()),
        pa.nulls(size, pa.int64()) if doc is None else doc,
        pa.nulls(size, pa.int64()) if row is None else row,
        pa.nulls(size, pa.binary()) if ident is None else ident,
        pa.nulls(size, pa.int32()) if n is None else pa.array(n, pa.int32()),
        pa.nulls(size, pa.binary()) if blob is None else pa.array(blob, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["part", "kind", "doc_id", "row", "ident", "n", "blob"])


def _pack(part: np.ndarray, owner: np.ndarray, ident: np.ndarray, token: np.ndarray, extra: np.ndarray | None, parts: int) -> Iterator[tuple[int, bytes]]:
    """Tokens (48 bits, with 16 extra bits or none) grouped by part and set: head, idents, counts, tokens.

    owner is a token's place in ident; tokens of one set must come one after another. Part numbers that fit are
    sorted as short integers, by radix. A set with more tokens in a part than a count holds stands there repeatedly.
    Names are cut to 10 bytes.
    """
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    part, owner, token = part[order], owner[order], token[order]
    new = np.r_[True, (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])]
    starts = np.flatnonzero(new)
    count = np.diff(np.r_[starts, len(part)])
    if count.max() > COUNT:
        new[(np.arange(len(part)) - np.repeat(starts, count)) % COUNT == 0] = True
        starts = np.flatnonzero(new)
        count = np.diff(np.r_[starts, len(part)])
    count = count.astype("u1")
    edges = np.searchsorted(part[starts], np.arange(parts + 1))
    places = np.r_[starts, len(part)]
    name = ident[owner[starts]]
    name, rest = name[:, 0].astype("<u8"), name[:, 1].astype("<u2")
    low, high = token.astype("<u4"), (token >> np.uint64(32)).astype("<u2")
    more = extra[order].astype("<u2") if extra is not None else None
    for p in np.unique(part).tolist():
        a, b = edges[p], edges[p + 1]
        at = slice(places[a], places[b])
        yield p, b"".join([np.array([b - a], "<u8").tobytes(), name[a:b].tobytes(), rest[a:b].tobytes(), count[a:b].tobytes(), low[at].tobytes(), high[at].tobytes(), *([more[at].tobytes()] if more is not None else [])])


def _unpack(data: list[tuple[int, bytes]], extra: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names (10 bytes) of the sets of many blobs, and of each token its set's place among them and the token.

    Above a token's 48 bits stand the number of its part, or the extra bits. The blobs are let go one by one.
    """
    heads, total = [], 0
    for _, blob in data:
        k = int(np.frombuffer(blob, "<u8", 1)[0])
        heads.append((k, int(np.frombuffer(blob, "u1", k, 8 + 10 * k).sum(dtype=np.int64))))
        total += heads[-1][1]
    sets = sum(k for k, _ in heads)
    ident = np.empty((sets, 2), np.uint64)
    owner, token = np.empty(total, np.uint32), np.empty(total, np.uint64)
    s, t = sets, total
    while data:
        (part, blob), (k, m) = data.pop(), heads.pop()
        s, t, at = s - k, t - m, 8 + HEAD_BYTES * k
        ident[s : s + k, 0], ident[s : s + k, 1] = np.frombuffer(blob, "<u8", k, 8), np.frombuffer(blob, "<u2", k, 8 + 8 * k)
        owner[t : t + m] = np.repeat(np.arange(s, s + k, dtype=np.uint32), np.frombuffer(blob, "u1", k, 8 + 10 * k))
        token[t : t + m] = np.frombuffer(blob, "<u2", m, at + 6 * m) if extra else part & 4095
        token[t : t + m] <<= np.uint64(16)
        token[t : t + m] |= np.frombuffer(blob, "<u2", m, at + 4 * m)
        token[t : t + m] <<= np.uint64(32)
        token[t : t + m] |= np.frombuffer(blob, "<u4", m, at)
    return ident, owner, token


def _home(ident: np.ndarray, parts: int) -> np.ndarray:
    """The part where what belongs to a set comes together."""
    return (mix(ident[:, 0]) % np.uint64(parts)).astype(np.int64)


def _numbered(ident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each set, equal where names are equal, and for each number a place in ident."""
    order = np.lexsort((ident[:, 1], ident[:, 0]))
    new = np.r_[True, (ident[order[1:]] != ident[order[:-1]]).any(axis=1)]
    number = np.empty(len(ident), np.uint32)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _names(ident: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()[:NAME] for x in ident.astype("<u8")], pa.binary())


#: Kinds of rows: packed shingles; documents; names and sizes of the sets of a part.
_PACKED, _DOCUMENT, _SIZES, _GOOD = 0, 1, 3, 2
_ENTRY = np.dtype([("ident", "<u8", 2), ("n", "<u4")])


def _shingled(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = HashedWords(), set()
        for batch in slices(batches, 4096, most=4_000_000):
            sets = shingle_sets(batch.column(1).to_pylist(), memo)
            # The digest of the set names it; an empty set has no name.
            names = [xxhash.xxh3_128_digest(x.tobytes())[:NAME] if len(x) else None for x in sets]
            # Rows of documents are dealt by themselves, so copies of one set are not together.
            spread = mix(batch.column(0).fill_null(0).to_numpy().astype(np.uint64) ^ batch.column(2).to_numpy().astype(np.uint64)) % np.uint64(parts)
            yield _batch(spread.tolist(), _DOCUMENT, pa.array(names, pa.binary()), [len(x) for x in sets], None, batch.column(0), batch.column(2))
            fresh = []
            for k, y in enumerate(names):
                if y is not None and y not in seen:
                    seen.add(y)
                    fresh.append(k)
            if len(seen) > SEEN:
                seen.clear()
            if fresh:
                token = np.concatenate([sets[k] for k in fresh])
                size = np.array([len(sets[k]) for k in fresh])
                ident = np.frombuffer(b"".join([names[k].ljust(16, b"\0") for k in fresh]), "<u8").reshape(-1, 2)
                part = ((token >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.int64)
                packed = list(_pack(part, np.repeat(np.arange(len(fresh)), size), ident, token & _MASK, None, parts))
                yield _batch([p for p, _ in packed], _PACKED, blob=[x for _, x in packed])
                home, entries = _home(ident, parts), np.empty(len(fresh), _ENTRY)
                entries["ident"], entries["n"] = ident, size
                homes = np.unique(home).tolist()
                yield _batch(homes, _SIZES, blob=[entries[home == p].tobytes() for p in homes])

    return run


def _split(batches: Iterator[pa.RecordBatch], data: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Packed shingles go into data, with the numbers of their parts; other rows straight on."""
    for batch in batches:
        kinds = batch.column("kind").to_numpy(zero_copy_only=False)
        part, blob = batch.column("part"), batch.column("blob")
        data += [(part[k].as_py(), blob[k].as_py()) for k in np.flatnonzero(kinds == _PACKED).tolist()]
        if (kinds != _PACKED).any():
            yield batch.filter(pa.array(kinds != _PACKED))


def _class(often: np.ndarray) -> np.ndarray:
    """How frequent a shingle is, in half powers of two: 0 for 2 sets to 15 for 362 and more."""
    return np.clip(np.floor(2 * np.log2(often)) - 2, 0, 15).astype(np.uint64)


def _shared(parts: int):
    """Of each shingle that several sets hold: set, shingle and how frequent it is, dealt out by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: list[tuple[int, bytes]] = []
        yield from _split(batches, data)
        idents, owner, token = _unpack(data, False)
        if not len(token):
            return
        order = np.argsort(token, kind="stable")
        number, first = _numbered(idents)
        token, owner = token[order], number[owner[order]]
        del order
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[starts, len(token)])
        several = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
        hit = np.repeat(several, size)
        often = np.repeat(_class(size[several]), size[several])
        owner, token = owner[hit], token[hit]
        del starts, size, several, hit
        if len(token):
            order = np.argsort(owner, kind="stable")
            owner, token, often = owner[order], token[order], often[order]
            ident = idents[first]
            packed = list(_pack(_home(ident, parts)[owner], owner, ident, token & _MASK, (often << np.uint64(12)) | (token >> np.uint64(48)), parts))
            yield _batch([p for p, _ in packed], _PACKED, blob=[x for _, x in packed])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of which three quarters are shared: their shared shingles from rare to frequent."""
    data: list[tuple[int, bytes]] = []
    told = []
    for batch in _split(batches, data):
        kinds = batch.column("kind").to_numpy(zero_copy_only=False)
        told += [np.frombuffer(x.as_py(), _ENTRY) for x in batch.column("blob").filter(pa.array(kinds == _SIZES))]
        if (kinds == _DOCUMENT).any():
            yield batch.filter(pa.array(kinds == _DOCUMENT))
    # How frequent a shingle is stands above it: one integer sorts from rare to frequent.
    idents, owner, key = _unpack(data, True)
    if not len(key):
        return
    # Sets and their sizes are numbered together, by what packed shingles tell of a name.
    sizes = np.concatenate(told)
    full = sizes["ident"]
    number, first = _numbered(np.concatenate([idents, full & _SENT]))
    whose = number[len(idents) :]
    n, named = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    n[whose], named[whose] = sizes["n"], np.arange(len(full))
    if (full[named[whose]] != full).any():
        raise ValueError("two sets have names that agree in 80 bits of 96")
    owner = number[owner]
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])]
    owner, key = owner[fresh], key[fresh]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    ends = np.r_[starts[1:], len(owner)]
    mine = owner[starts]
    good = 4 * (ends - starts) >= 3 * n[mine]
    starts, ends, mine = starts[good], ends[good], mine[good]
    for a in range(0, len(starts), 2000):
        some = slice(a, a + 2000)
        names = full[named[mine[some]]]
        yield _batch([0] * len(names), _GOOD, _names(names), n[mine[some]].tolist(), [key[x:y].tobytes() for x, y in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles among a set's rarest that other sets hold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.column("n").to_numpy().astype(np.int64)
        keys = [np.frombuffer(x.as_py(), "<u8") for x in batch.column("blob")]
        take = np.array([min(len(k), len(k) + 1 - -(-3 * int(m) // 4)) for k, m in zip(keys, n, strict=True)])
        token = np.concatenate([k[:t] for k, t in zip(keys, take, strict=True)])
        place = np.concatenate([np.arange(t, dtype=np.int32) for t in take])
        whose = np.repeat(np.arange(batch.num_rows), take)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), batch.column("ident").take(pa.array(whose)), pa.array(n[whose].astype(np.int32)), pa.array(place)], names=["token", "ident", "n", "place"])


class Inverted:
    """The inverted lists of some sets of shingles, for T-occurrence searches."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.count = len(sets)
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, np.int64)
        self.token, self.edges = flat[starts], np.r_[starts, len(flat)]

    def lists(self, query: np.ndarray) -> list[np.ndarray]:
        """The lists of the query's shingles, those that are not empty."""
        if not len(self.token):
            return []
        at = np.minimum(np.searchsorted(self.token, query), len(self.token) - 1)
        at = at[self.token[at] == query]
        return [self.owner[a:b] for a, b in zip(self.edges[at].tolist(), self.edges[at + 1].tolist(), strict=True)]

    def search(self, query: np.ndarray, need: np.ndarray) -> np.ndarray:
        """DivideSkip: the sets i, by place, that share at least need[i] shingles with the query."""
        least = int(need.min()) if len(need) else 1
        lists = sorted(self.lists(query), key=len)
        if least < 1 or len(lists) < least:
            return np.empty(0, np.int64)
        # The published choice of how many lists are long, of which T - 1 may be at most.
        long = min(least - 1, int(least / (MU * np.log2(max(len(lists[-1]), 2)) + 1)))
        bar = least - long
        pool, count = [], []
        last, seen = -1, 0
        for x in heapq.merge(*(one.tolist() for one in lists[: len(lists) - long])):
            if x == last:
                seen += 1
                continue
            if seen >= bar:
                pool.append(last)
                count.append(seen)
            last, seen = x, 1
        if seen >= bar:
            pool.append(last)
            count.append(seen)
        at, found = np.array(pool, np.int64), np.array(count, np.int64)
        # The long lists, the shorter ones first; a candidate that cannot reach its number any more is let go.
        for left, one in zip(range(long, 0, -1), lists[len(lists) - long :], strict=True):
            alive = found + left >= need[at]
            at, found = at[alive], found[alive]
            if not len(at):
                break
            place = np.searchsorted(one, at)
            found += one[np.minimum(place, len(one) - 1)] == at
        return at[found >= need[at]]


def divide_skip(query: np.ndarray, candidates: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """T-occurrence search: which candidates share at least need[i] shingles with the query."""
    out = np.zeros(len(candidates), bool)
    out[Inverted(candidates).search(query, need)] = True
    return out


_LINKS = "a binary, b binary, la binary, lb binary, link boolean"


def _against_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, la, lb, size of a, size of b, shingles of a, shingles of b) with link, where b is the hub and the query."""
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True))
        rows.sort(key=lambda x: x[1])
        good: list[bool] = []
        begin = 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or rows[k][1] != rows[begin][1] or k - begin >= HUB_BLOCK:
                block = rows[begin:k]
                need = np.array([required(x[4], x[5]) for x in block])
                good += divide_skip(np.frombuffer(block[0][7], "<u8"), [np.frombuffer(x[6], "<u8") for x in block], need).tolist()
                begin = k
        yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in rows], pa.binary()) for c in range(4)), pa.array(good, pa.bool_())], names=["a", "b", "la", "lb", "link"])


def search_blocks(one: list[tuple[bytes, int, np.ndarray]], two: list[tuple[bytes, int, np.ndarray]] | None) -> Iterator[tuple[bytes, bytes]]:
    """Links among labelled sets (label, size, shingles) of two blocks, or of one: pairs of labels.

    Labels that are linked are one from then on, and a set is searched for only among sets of other labels, so at most
    one link is told for each label.
    """
    both = one + (two or [])
    number = {label: k for k, label in enumerate(dict.fromkeys(x[0] for x in both))}
    names, root = list(number), np.arange(len(number))
    mine = np.array([number[x[0]] for x in both])
    held = both if two is None else two
    whose, size = mine[len(both) - len(held) :], np.array([x[1] for x in held])
    inverted = Inverted([x[2] for x in held])
    for k, (_, n, query) in enumerate(one):
        own = root[mine[k]]
        fit = (root[whose] != own) & (4 * np.minimum(size, n) >= 3 * np.maximum(size, n))
        if two is None:
            fit[: k + 1] = False
        if not fit.any():
            continue
        for other in np.unique(root[whose[inverted.search(query, np.where(fit, required(size, n), _NEVER))]]).tolist():
            yield names[own], names[other]
            root[root == other] = own


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block_a, block_b, block, label, size, shingles), all of a pair of blocks one after another: their links."""

    def settle(key: tuple[int, int], sides: dict[int, list]) -> pa.RecordBatch:
        found = list(search_blocks(sides.get(key[0], []), None if key[0] == key[1] else sides.get(key[1], [])))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    key, sides = None, {}
    for batch in batches:
        for a, b, block, label, n, blob in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if (a, b) != key:
                if key is not None:
                    yield settle(key, sides)
                key, sides = (a, b), {}
            sides.setdefault(block, []).append((label, n, np.frombuffer(blob, "<u8")))
    if key is not None:
        yield settle(key, sides)


def _fits(na: Column, nb: Column) -> Column:
    return 4 * F.least(na, nb) >= 3 * F.greatest(na, nb)


def _open_lists(lists: DataFrame, labels: DataFrame | None, rows: int, hubs: bool = True) -> DataFrame:
    """token, ident, n, label, m: entries of the lists whose members are in several components; with low and high for hubs."""
    if labels is None:
        listed = lists.withColumn("label", F.col("ident"))
    else:
        listed = lists.join(labels, lists["ident"] == labels["node"], "left").select("token", "ident", "n", F.coalesce("label", "ident").alias("label"))
    if hubs:
        of = F.struct("label", "ident", "n")
        ends = listed.groupBy("token").agg(F.count("*").alias("m"), F.min(of).alias("low"), F.max(of).alias("high")).filter(F.col("low.label") != F.col("high.label"))
    else:
        ends = listed.groupBy("token").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high")).filter(F.col("low") != F.col("high")).drop("low", "high")
    return cut(few(listed.join(ends, "token"), rows))


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, label), after links between labels (a, b): only these are searched for components."""
    more = components(links)
    if labels is None:
        return more
    new = more.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    moved = labels.join(new, labels["label"] == new["_node"], "left").select("node", F.coalesce("_label", "label").alias("label"))
    fresh = new.join(labels.select("node"), new["_node"] == labels["node"], "left_anti").select(F.col("_node").alias("node"), F.col("_label").alias("label"))
    out = cut(moved.union(fresh))
    release(labels, more)
    return out


def _blocks(mixed: DataFrame) -> DataFrame:
    """ident, n, label, band, block of the sets of open lists: blocks of bounded size that hold much the same shingles.

    A set belongs to the most frequent shingle that it is listed under and to a band of sizes; only sets of one band or
    of neighbouring bands can be linked.
    """
    # A little more than 4/3, so that no rounding brings linked sets two bands apart.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.334)))
    sets = mixed.groupBy("ident").agg(F.max(F.struct("m", "token")).alias("_top"), F.first("n").alias("n"), F.first("label").alias("label")).select("ident", "n", "label", F.col("_top.token").alias("lead"), band.alias("band"))
    size = sets.groupBy(F.col("lead").alias("_lead"), F.col("band").alias("_band")).agg(F.count("*").alias("_sets"), F.sum("n").alias("_shingles"))
    of = lambda c, n: F.ceil(F.greatest(c / BLOCK_SETS, n / BLOCK_SHINGLES))
    size = size.withColumn("_of", of(F.col("_sets"), F.col("_shingles")))
    # Sets of frequent shingles fill blocks of their own; those of the others share blocks by band, of which there are a hundred at most.
    small = size.filter("_of = 1").groupBy(F.col("_band").alias("_small")).agg(of(F.sum("_sets"), F.sum("_shingles")).alias("_share"))
    size = size.join(F.broadcast(small), F.col("_band") == F.col("_small"), "left")
    own = F.xxhash64("lead", "band", F.pmod(F.xxhash64("ident"), F.col("_of")))
    shared = F.xxhash64("band", F.pmod(F.xxhash64("lead"), F.col("_share")))
    dealt = sets.join(size, (F.col("lead") == F.col("_lead")) & (F.col("band") == F.col("_band")))
    return dealt.select("ident", "n", "label", "band", F.when(F.col("_of") > 1, own).otherwise(shared).alias("block"))


def _search(rare: DataFrame, labels: DataFrame | None, sets: DataFrame, count: int, rows: int) -> DataFrame:
    """Links between labels (a, b): every two blocks of which an open list has members are held against each other."""
    mixed = _open_lists(rare, labels, rows, hubs=False)
    placed = cut(few(_blocks(mixed), count))
    entries = cut(few(mixed.select("token", "ident", "label").join(placed.select("ident", "band", "block"), "ident"), rows))
    met = cut(few(entries.groupBy("token", "band", "block").agg(F.min("label").alias("low"), F.max("label").alias("high")), rows))
    one, two = (met.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("band", "block", "low", "high")]) for s in "ab")
    near = one.join(two, "token").filter((F.col("block_a") <= F.col("block_b")) & (F.abs(F.col("band_a") - F.col("band_b")) <= 1))
    pairs = near.filter((F.least("low_a", "low_b") != F.greatest("high_a", "high_b"))).select("token", "block_a", "block_b")
    # Of two blocks only the sets go that stand in an open list with members in both: linked sets share such a list.
    sides = pairs.select("token", "block_a", "block_b", F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))
    wanted = sides.join(entries, ["token", "block"]).select("block_a", "block_b", "block", "ident", "label").distinct()
    brought = wanted.join(sets, "ident").select("block_a", "block_b", "block", "label", "n", "blob")
    dealt = brought.repartition(partitions(rare.sparkSession), "block_a", "block_b").sortWithinPartitions("block_a", "block_b")
    found = cut(dealt.mapInArrow(tidied(_searched), "a binary, b binary"))
    release(mixed, placed, entries, met)
    return found


def link_sets(sets: DataFrame) -> DataFrame | None:
    """node, label for every set (ident, n, blob) that is linked with another: the components of all links; None without links."""
    rare = cut(sets.select("ident", "n", "blob").mapInArrow(tidied(_prefixes), "token long, ident binary, n int, place int"))
    tried, labels, gained, passed = None, None, [], []
    # Numbers that tell how many tasks are worth while.
    count, rows = sets.count(), rare.count()
    # Hubs, over the few rarest shingles of each set: large groups come together at one comparison a member. This is
    # only a head start; the search below misses nothing whatever was linked here.
    lists = rare.filter(F.col("place") < HEAD).select("token", "ident", "n")
    while len(gained) < HUB_ROUNDS and (len(gained) < 2 or gained[-1] >= GAIN * gained[0]) and (not gained or gained[-1]):
        mixed = _open_lists(lists, labels, min(rows, HEAD * count))
        # A list that is settled stays so.
        lists = mixed.select("token", "ident", "n")
        # A hub of another component than the set's own: of the lowest label, or for its own members of the highest.
        hub = F.when(F.col("label") != F.col("low.label"), F.col("low")).otherwise(F.col("high"))
        both = mixed.select(F.col("ident").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), hub["ident"].alias("b"), hub["n"].alias("nb"), hub["label"].alias("lb"))
        common = both.filter(_fits(F.col("na"), F.col("nb"))).groupBy("a", "b", "la", "lb").agg(F.count("*").alias("c"))
        if tried is not None:
            common = common.join(tried, ["a", "b"], "left_anti")
        best = common.groupBy("a").agg(F.max_by(F.struct("b", "la", "lb"), F.struct("c", "b")).alias("x")).select("a", "x.*")
        left = best.join(sets.select(F.col("ident").alias("a"), F.col("n").alias("na"), F.col("blob").alias("sa")), "a")
        brought = left.join(sets.select(F.col("ident").alias("b"), F.col("n").alias("nb"), F.col("blob").alias("sb")), "b")
        compared = cut(few(brought.select("a", "b", "la", "lb", "na", "nb", "sa", "sb"), count, 1000).mapInArrow(tidied(_against_hubs), _LINKS))
        tried = compared.select("a", "b") if tried is None else tried.union(compared.select("a", "b"))
        good = compared.filter("link").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        gained.append(good.count())
        passed += [mixed, compared]
        if gained[-1]:
            labels = _relabelled(labels, good)
    links = _search(rare.select("token", "ident", "n"), labels, sets, count, rows)
    if not links.isEmpty():
        labels = _relabelled(labels, links)
    release(rare, links, *passed)
    return labels


def _classed(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    """doc_id, row (a digest of the text), ident, n, component and label: a row for each document.

    label is the component's own name: two components may have one doc_id if it stands on rows of both.
    """
    # Every part that a set has shingles in is sent its name, so there are no more of them than memory asks for.
    spark = documents.sparkSession
    parts = max(min(partitions(spark), spark.sparkContext.defaultParallelism), partitions(spark) // 2)
    body = F.col(f"`{text}`").cast("string")
    rows = documents.select(F.col(f"`{id_column}`").cast("long").alias("id"), body.alias("text"), F.xxhash64(body).alias("row"))
    # A part is a task, where hashed part numbers would bring several parts into one.
    dealt = rows.mapInArrow(tidied(_shingled(parts)), _SET).repartitionById(parts, F.col("part"))
    shared = dealt.mapInArrow(tidied(_shared(parts)), _SET).repartitionById(parts, F.col("part"))
    found = cut(shared.mapInArrow(tidied(_gathered), _SET))
    sets = found.filter(F.col("kind") == _GOOD).select("ident", "n", "blob")
    members = found.filter(F.col("kind") == _DOCUMENT).select("doc_id", "row", "ident", "n")
    labels = link_sets(sets)
    least = members.filter("ident is not null").groupBy("ident").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    if labels is None:
        by_set = least.select(F.col("ident").alias("_ident"), F.col("first").alias("component"), F.col("ident").alias("label"), "rows")
    else:
        named = least.join(labels, least["ident"] == labels["node"], "left").select("ident", "first", "rows", F.coalesce("label", "ident").alias("label"))
        lowest = named.groupBy("label").agg(F.min("first").alias("component"))
        by_set = named.join(lowest, "label").select(F.col("ident").alias("_ident"), "component", "label", "rows")
    by_set = cut(by_set)
    # The many documents of one set are dealt over several tasks. Such sets are one for HOT documents at most.
    pieces = F.ceil(F.col("rows") / HOT).cast("int")
    hot = by_set.filter(F.col("rows") > HOT).select(F.col("_ident").alias("_hot"), pieces.alias("_pieces"))
    salted = members.join(F.broadcast(hot), members["ident"] == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "row"), F.coalesce("_pieces", F.lit(1))).cast("int"))
    copied = by_set.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    out = salted.join(copied, (salted["ident"] == copied["_ident"]) & (salted["_salt"] == copied["_piece"]), "left")
    return out.select("doc_id", "row", "ident", "n", F.coalesce("component", "doc_id").alias("component"), "label")


def join(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id.

    A to Z are lower-cased; words end at ASCII white space. The set of a text holds its distinct 5-word shingles; with
    fewer words the whole sequence is one. Null and empty texts have no shingle and are components of their own.
    Very long texts are whole sets, sent in parts. Repeated rows and equal sets are linked; the component's id is its
    smallest doc_id. A null doc_id never names a component that holds another. An empty table gives an empty result;
    other columns are left out, so their names cannot clash.
    """
    out = _classed(documents, id_column, text)
    return out.select(F.col("doc_id").alias(id_column), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def first_of_each(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of which each is the first of its component, with all their columns; of repeated rows one stays.

    The first is the one of the smallest id and, where that id stands on several of the component's texts, of one of
    them chosen by digest. An id on texts of several components stands for each of them by itself. Rows without an id
    cannot stand for a component and stay as they are, null and empty texts stay once for each id; an empty table gives
    an empty one.
    """
    classed = _classed(documents, id_column, text)
    first = classed.filter("doc_id is not null and ident is not null").groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("x")).select("x.*")
    alone = classed.filter("doc_id is not null and ident is null").select("doc_id", "row")
    kept = first.union(alone).select(F.col("doc_id").alias("_groundwork_kept"), F.col("row").alias("_groundwork_row")).distinct()
    # Both sides are dealt out by id, once; the texts are not sorted for it.
    body, own = F.col(f"`{text}`").cast("string"), F.col(f"`{id_column}`")
    marked = documents.filter(own.isNotNull()).withColumn("_groundwork_digest", F.xxhash64(body))
    known = marked.join(kept.hint("shuffle_hash"), (own.cast("long") == F.col("_groundwork_kept")) & (F.col("_groundwork_digest") == F.col("_groundwork_row")), "left_semi")
    known = known.dropDuplicates([id_column, "_groundwork_digest"]).drop("_groundwork_digest")
    return known.unionByName(documents.filter(own.isNull()))


#: The same classes in SQL over the view documents: all pairs that share a shingle are counted.
JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
SELECT node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY node
"""
