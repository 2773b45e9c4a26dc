"""SentencePiece encoding and decoding: a score-ordered agenda of adjacent symbol pairs.

A vocabulary of the merge type gives each piece a score. Encoding starts with single characters; an agenda
(a heap) holds every adjacent pair whose concatenation is a piece, best score first and leftmost first among
equals. The best pair is merged, its new neighbours enter the agenda, and so on until it is empty. A character
that is no piece becomes its UTF-8 bytes.

No merge crosses a place where a piece ends for certain: before a run of word marks (if no piece holds a mark
after another character), around a line feed (if no piece holds one), and between a Latin letter and a
punctuation character that no piece holds after such a letter. Texts are cut there, and a worker
remembers the outcome for a bounded number of segments. Short segments run side by side: in each step every one
of them merges the best entry of its own agenda. Every segment that enters the memo is held against the
sentencepiece library, in one call for each Arrow batch, and so are the ids and the decoded text of one whole text of
each batch. Nothing is mended: where the two differ, the job fails with an error that names the text.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import slices, tidied

MARK = "▁"

#: Segments that either half of a worker's memo holds; the older half is dropped when the newer one is full.
MEMO_SEGMENTS = 200_000

#: Letters after which texts may be cut, as a character class.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"

#: Characters of a segment up to which it runs side by side with others; longer ones have a heap each.
SHORT = 40

#: Texts that the model's normaliser must leave as they are, but for the marks.
PROBES = ("a  b ", "\u00c5A\u030a\ufb01", "\uff21\u200b\ttab\r\n line", "\u00bd\u2460\u3000x")


class Differs(ValueError):
    """The agenda and the library disagree on a text."""


class Agenda:
    """Encoder and decoder for one model file."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        self.special = {i for i in range(size) if self.library.is_control(i) or self.library.is_unknown(i)}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(size) if self.library.is_byte(i)}
        self.of_byte = {v: k for k, v in self.byte.items()}
        plain = [i for i in range(size) if i not in self.special and i not in self.of_byte]
        self.ids = {self.pieces[i]: i for i in plain}
        self.rank = {self.pieces[i]: -self.library.get_score(i) for i in plain}
        self.end = self.library.eos_id()
        for probe in PROBES:
            if self.library.normalize(probe) != MARK + probe.replace(" ", MARK):
                raise ValueError(f"the model changes {probe!r} before it is cut up: only models that take texts as they are can be used")
        self.lead = self.library.encode("\n")
        self.line = self.library.encode("\n\n")[len(self.lead) :]
        marks = all(MARK not in p.lstrip(MARK) for p in self.ids)
        lines = all("\n" not in p for p in self.ids)
        follow = {b for p in self.ids for b in re.findall(f"(?<=[{LETTERS}])[^{LETTERS}]", p)}
        stops = re.escape("".join(sorted(set(string.punctuation) - follow)))
        whole = rf"\n|{MARK}*[{LETTERS}]+(?=[{MARK}\n{stops}]|\Z)|{MARK}*[^{MARK}\n]+|{MARK}+"
        self.cut = re.compile({(True, True): whole, (True, False): rf"{MARK}*[^{MARK}]+|{MARK}+", (False, True): r"\n|[^\n]+", (False, False): r"(?s).+"}[marks, lines]).findall
        # Segment to its ids, written out, and to its decoded text: what was used lately, and before that.
        self.known: tuple[dict[str, str], dict[str, str]] = ({}, {})
        self.before: tuple[dict[str, str], dict[str, str]] = ({}, {})
        self.of_char = -1 - np.arange(0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.decimal = [str(i) for i in range(size)]
        # Every way to make a piece of two pieces, as one sorted key, with the piece and its place in the order of scores.
        order = {r: k for k, r in enumerate(sorted(set(self.rank.values())))}
        made = sorted((self.ids[p[:k]] * size + self.ids[p[k:]], i, order[self.rank[p]]) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.size = size
        self.pair, self.pair_id, self.pair_order = (np.array(x, np.int64) for x in (zip(*made, strict=True) if made else ([], [], [])))

    def _orders(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For adjacent symbols: the merged piece and its order; an order over all others where there is none."""
        none = np.int64(1 << 40)
        if not len(self.pair):
            return np.zeros(len(left), np.int64), np.full(len(left), none)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return self.pair_id[at], np.where(hit, self.pair_order[at], none)

    def merge_all(self, segments: list[str]) -> list[list[int]]:
        """Ids of many short segments at once; a character that is no piece is given as -1 - its code point."""
        if not segments:
            return []
        flat = self.of_char[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)].astype(np.int64)
        owner = np.repeat(np.arange(len(segments)), np.fromiter(map(len, segments), np.int64, len(segments)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.int64(1 << 40)

        def looked_up(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            right = np.minimum(at + 1, len(flat) - 1)
            made, order = self._orders(flat[at], flat[right])
            return made, np.where((right > at) & (owner[at] == owner[right]), order, none)

        made, order = looked_up(np.arange(len(flat)))
        while len(flat):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            key = order * SHORT + np.arange(len(flat)) - np.repeat(starts, np.diff(np.r_[starts, len(flat)]))
            best = np.minimum.reduceat(key, starts)
            live = best < none * SHORT
            if not live.all():
                rest = np.repeat(live, np.diff(np.r_[starts, len(flat)]))
                done.append((owner[~rest], flat[~rest]))
                flat, owner, made, order = flat[rest], owner[rest], made[rest], order[rest]
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(flat) else np.empty(0, np.int64)
                best = best[live]
            if not len(flat):
                break
            at = starts + best % SHORT
            flat[at] = made[at]
            stay = np.ones(len(flat), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            flat, owner, made, order = flat[stay], owner[stay], made[stay], order[stay]
            near = np.zeros(len(flat), bool)
            near[moved[at]] = near[np.maximum(moved[at] - 1, 0)] = True
            touched = np.flatnonzero(near)
            made[touched], order[touched] = looked_up(touched)
        owner, flat = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
        by = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(segments))).tolist()
        ids = flat[by].tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def segments(self, text: str) -> list[str]:
        return self.cut(MARK + text.replace(" ", MARK)) if text else []

    def merge(self, segment: str) -> list[str]:
        """The pieces of one segment, by the agenda."""
        rank = self.rank.get
        symbols: list[str] = list(segment)
        last = len(symbols) - 1
        before, after = list(range(-1, last)), list(range(1, last + 2))
        agenda = [(r, i, i + 1, 2) for i in range(last) if (r := rank(segment[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, length = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j]
            if not left or not right or len(left) + len(right) != length:
                continue
            symbols[i], symbols[j] = joined, _ = left + right, ""
            k = after[i] = after[j]
            if k <= last:
                before[k] = i
                if (r := rank(joined + symbols[k])) is not None:
                    heapq.heappush(agenda, (r, i, k, length + len(symbols[k])))
            if (h := before[i]) >= 0 and (r := rank(symbols[h] + joined)) is not None:
                heapq.heappush(agenda, (r, h, i, len(symbols[h]) + length))
        return [s for s in symbols if s]

    def encode_segment(self, segment: str) -> list[int]:
        out: list[int] = []
        for piece in self.merge(segment):
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            else:
                out += [self.byte[b] for b in piece.encode()]
        return out

    def decode_pieces(self, ids: list[int]) -> str:
        """Text of the ids with marks as spaces, before the first space is dropped."""
        if self.of_byte.keys().isdisjoint(ids) and self.special.isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out, run = [], bytearray()
        for i in ids:
            if (b := self.of_byte.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            if i not in self.special:
                out.append(self.pieces[i])
        out.append(run.decode(errors="replace"))
        return "".join(out).replace(MARK, " ")

    def _bytes(self, ids: list[int]) -> list[int]:
        """Ids, with the bytes of the characters that are no piece (given as -1 - code point)."""
        return [i for x in ids for i in ([x] if x >= 0 else [self.byte[b] for b in chr(-1 - x).encode()])]

    def learn(self, new: list[str]) -> None:
        """Enter segments into the memo, held against the library as the lines of one text."""
        short, long = [], []
        for s in new:
            (short if len(s) <= SHORT else long).append(s)
        merged = self.merge_all(short)
        for k, ids in enumerate(merged):
            if min(ids) < 0:
                merged[k] = self._bytes(ids)
        own = [*merged, *map(self.encode_segment, long)]
        segments = [*short, *long]
        if not segments:
            return
        told = self.library.encode("\n".join(["", *segments]).replace(MARK, " "), num_threads=1)
        line, expected = self.line, self.lead[: len(self.lead) - len(self.line)]
        for ids in own:
            expected += line
            expected += ids
        if told != expected:
            self._differing(segments, own)
        (ids_of, text_of), decimal = self.known, self.decimal.__getitem__
        for s, ids in zip(segments, own, strict=True):
            ids_of[s] = " ".join(map(decimal, ids))
            text_of[s] = self.decode_pieces(ids)

    def _differing(self, segments: list[str], own: list[list[int]]) -> None:
        for s, ids in zip(segments, own, strict=True):
            if ids != self.library.encode(f"\n{s}".replace(MARK, " "))[len(self.lead) :]:
                raise Differs(f"the agenda and the library differ on {s[:200]!r}")
        raise Differs(f"the agenda and the library differ on segments side by side, from {segments[0][:200]!r}")

    def hold(self, text: str, ids: list[int], decoded: str) -> None:
        """Raise if the library encodes the text to other ids or decodes them to another text."""
        told = self.library.encode(text, add_eos=True)
        if told != ids or self.library.decode(told) != decoded:
            raise Differs(f"the agenda and the library differ on the text that begins with {text[:200]!r}")

    def recall(self, segments: set[str]) -> None:
        """See that the memo holds the segments."""
        if len(self.known[0]) + len(segments) > MEMO_SEGMENTS:
            self.before, self.known = self.known, ({}, {})
        segments.difference_update(self.known[0])
        for s in segments.intersection(self.before[0]):
            for now, then in zip(self.known, self.before, strict=True):
                now[s] = then[s]
        segments.difference_update(self.known[0])
        self.learn(list(segments))

    def encode(self, text: str) -> list[int]:
        """All ids of a text, the end id included."""
        return [i for s in self.segments(text) for i in self.encode_segment(s)] + [self.end]

    def decode(self, ids: list[int]) -> str:
        text = self.decode_pieces(ids)
        return text[1:] if text.startswith(" ") else text

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: the number of ids, and the SHA-256 of its ids and of its decoded text."""
        cut = [self.segments(t) for t in texts]
        self.recall(set().union(*cut))
        ids_of, text_of = (x.__getitem__ for x in self.known)
        end = str(self.end)
        for k, segments in enumerate(cut):
            ids = " ".join([*map(ids_of, segments), end])
            decoded = "".join(map(text_of, segments))
            decoded = decoded[1:] if decoded.startswith(" ") else decoded
            if not k:
                self.hold(texts[k], [int(x) for x in ids.split(" ")], decoded)
            yield ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@functools.cache
def agenda_of(model: str) -> Agenda:
    """One for each worker process and model, so that tasks share its memo."""
    return Agenda(model)


def encode_decode(documents: DataFrame, model: str, text: str = "text") -> DataFrame:
    """documents, with n_tokens, ids_sha256 and decoded_sha256 after the other columns.

    The model's path must be readable on every executor. Null text counts as empty: the end id alone, decoded to
    the empty text. Very long texts are encoded whole, a batch of their own. Repeated rows each get their result; pairs
    of one score are merged leftmost first; an empty table gives an empty one; columns that are already called like
    the new ones are replaced. A text on which the agenda and the library differ fails the job (``Differs``).
    """
    added = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in documents.columns if c.lower() not in added]
    source = documents.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), "n_tokens bigint, ids_sha256 string, decoded_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = agenda_of(model)
        for batch in slices(batches, 512, text):
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            n, ids, decoded = zip(*agenda.digests(texts), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[*batch.schema.names, *added])

    return source.mapInArrow(tidied(run), schema)


def ids_and_text(documents: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """documents with the ids themselves (array of int) and the decoded text; empty cases as in encode_decode."""
    kept = [c for c in documents.columns if c.lower() not in (ids.lower(), decoded.lower())]
    source = documents.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), f"`{ids}` array<int>, `{decoded}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = agenda_of(model)
        for batch in slices(batches, 512, text):
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            found = [agenda.encode(x) for x in texts]
            for x, y in zip(texts, found, strict=True):
                agenda.hold(x, y, agenda.decode(y))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32())), pa.array([agenda.decode(x) for x in found], pa.string())], names=[*batch.schema.names, ids, decoded])

    return source.mapInArrow(tidied(run), schema)
