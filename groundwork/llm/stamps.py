"""Mixed timestamp normalisation: a recursive-descent scanner, votes by source, and offsets by bisection.

Each stamp is scanned once, in ``mapPartitions``, to a tuple of its wall time (both of them, where day and month could
change places) and its offset. Stamps that can be read in one order only vote for it in their source; ``reduceByKey``
counts, so that a source sends at most one pair of numbers for each task. Sources whose votes decide (a verdict) are
broadcast as a map while they stay under a checked size; beyond it, open stamps meet their source's verdict in a join
whose keys are salted. Wall times become UTC by bisection over the changes of offset of their zone.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import cut, partitions

SPACE = " \t\n\v\f\r"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SECOND = 1_000_000

#: Verdicts are broadcast up to so many bytes of names and entries; more of them are joined.
VERDICT_BYTES = 8_000_000
ENTRY_BYTES = 100

#: Tasks that one source's open stamps are dealt to where verdicts are joined.
SALTS = 64

#: What a scanned stamp is. VOTE_DAY and VOTE_MONTH can be read in one order only, OPEN in both with different dates.
BAD, EPOCH, PLAIN, VOTE_DAY, VOTE_MONTH, OPEN = range(6)

SCANNED = "stamp_id long, source string, zone string, kind int, first long, second long, offset int"
FINISHED = "stamp_id long, utc_us long, rule string, ambiguous boolean"

Scanned = tuple[int | None, str | None, str | None, int, int | None, int | None, int | None]


class Bad(Exception):
    """The text is no stamp."""


class Scanner:
    """Recursive descent over one text: each method reads one part of the grammar and moves ``at`` behind it."""

    __slots__ = ("text", "at")

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def ahead(self, by: int = 0) -> str:
        return self.text[self.at + by : self.at + by + 1]

    def take(self, char: str) -> bool:
        if self.ahead() != char:
            return False
        self.at += 1
        return True

    def need(self, char: str) -> None:
        if not self.take(char):
            raise Bad

    def two(self, low: int = 0, high: int = 99) -> int:
        part = self.text[self.at : self.at + 2]
        if len(part) != 2 or not (part.isascii() and part.isdigit() and low <= int(part) <= high):
            raise Bad
        self.at += 2
        return int(part)

    def year(self) -> int:
        self.two(20, 20)
        return 2000 + self.two()

    def month_name(self) -> int:
        part = self.text[self.at : self.at + 3]
        if part not in MONTHS:
            raise Bad
        self.at += 3
        return MONTHS.index(part) + 1

    def date(self) -> tuple[int | None, int | None]:
        """Days of the month-first and of the day-first reading; equal where the form leaves no choice."""
        a = self.two()
        if self.take("/"):
            b = self.two()
            self.need("/")
            year = self.year()
            return day_number(year, a, b), day_number(year, b, a)
        if self.take("."):
            month = self.two()
            self.need(".")
            day = day_number(self.year(), month, a)
        elif self.take(" "):
            month = self.month_name()
            self.need(" ")
            day = day_number(self.year(), month, a)
        else:
            self.at -= 2
            year = self.year()
            if self.take("-"):
                month = self.two()
                self.need("-")
            else:
                month = self.two()
            day = day_number(year, month, self.two())
        return day, day

    def clock(self) -> int:
        """Seconds since midnight, with the half of the day if there is one."""
        hour = self.two()
        self.need(":")
        seconds = 60 * self.two(0, 59)
        if self.take(":"):
            seconds += self.two(0, 59)
        space = self.ahead() == " "
        if (half := self.ahead(space)) in ("A", "P") and self.ahead(space + 1) == "M":
            self.at += space + 2
            if not 1 <= hour <= 12:
                raise Bad
            hour = hour % 12 + 12 * (half == "P")
        if hour > 23:
            raise Bad
        return 3600 * hour + seconds

    def offset(self) -> int | None:
        """Seconds ahead of UTC; None at the end of the text."""
        if self.at == len(self.text):
            return None
        self.take(" ")
        if self.take("Z"):
            return 0
        sign = -1 if self.take("-") else 1 if self.take("+") else 0
        if not sign:
            raise Bad
        hours = self.two(0, 14)
        self.take(":")
        return sign * (3600 * hours + 60 * self.two(0, 59))

    def dated(self) -> tuple[int | None, int | None, int | None]:
        """Wall time of the month-first and of the day-first reading in microseconds (None: no such date), and offset."""
        first, second = self.date()
        seconds, offset = 0, None
        if self.at < len(self.text):
            if not (self.take("T") or self.take(" ")):
                raise Bad
            seconds = self.clock()
            offset = self.offset()
        if self.at != len(self.text):
            raise Bad
        return *(None if x is None else (86400 * x + seconds) * SECOND for x in (first, second)), offset


def day_number(year: int, month: int, day: int) -> int | None:
    """Days since 1970-01-01; None if there is no such day."""
    if not (1 <= month <= 12 and 1 <= day <= 31):
        return None
    try:
        return datetime(year, month, day).toordinal() - 719163
    except ValueError:
        return None


def scan(text: str | None, zone: str | None) -> tuple[int, int | None, int | None, int | None]:
    """kind, first (UTC of an epoch, else the month-first or only wall time), second (the day-first one), offset."""
    text = (text or "").strip(SPACE)
    if len(text) in (10, 13) and text.isascii() and text.isdigit():
        return EPOCH, int(text) * (SECOND if len(text) == 10 else 1000), None, None
    try:
        first, second, offset = Scanner(text).dated()
    except Bad:
        return BAD, None, None, None
    if (first is None and second is None) or (offset is None and changes(zone) is None):
        return BAD, None, None, None
    if first is None:
        return VOTE_DAY, second, None, offset
    if second is None:
        return VOTE_MONTH, first, None, offset
    if first == second:
        return PLAIN, first, None, offset
    return OPEN, first, second, offset


@functools.lru_cache(4096)
def changes(zone: str | None) -> tuple[list[int], list[int], list[int]] | None:
    """Of a zone in the years that stamps can have: begins and ends of the wall times that its changes of offset skip or
    repeat, and the offsets before, between and after them, all in seconds; None if there is no such zone.

    Two changes that cancel each other within a day would be missed; there is no such pair.
    """
    try:
        known = ZoneInfo(zone or "")
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None

    def offset(at: int) -> int:
        there = (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=at)).astimezone(known)
        return round(there.utcoffset().total_seconds())

    at, end = 86400 * day_number(2000, 1, 1) - 2 * 86400, 86400 * (day_number(2099, 12, 31) + 3)
    begins, ends, offsets = [], [], [offset(at)]
    while at < end:
        if (later := offset(at + 86400)) != offsets[-1]:
            low, high = at, at + 86400  # the offset is the old one at low, the new one at high
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == offsets[-1] else (low, middle)
            begins.append(high + min(offsets[-1], later))
            ends.append(high + max(offsets[-1], later))
            offsets.append(later)
        at += 86400
    return begins, ends, offsets


def to_utc(wall: int, zone: str) -> tuple[int, bool]:
    """UTC of a wall time (both in microseconds), and whether its zone skips or repeats it: then the offset before counts."""
    begins, ends, offsets = changes(zone)
    seconds = wall // SECOND
    k = bisect_right(ends, seconds)
    return wall - offsets[k] * SECOND, k < len(begins) and seconds >= begins[k]


def verdict(votes: tuple[int, int]) -> bool | None:
    """Day first (True), month first (False) or neither, from the votes for day first and for month first."""
    day, month = votes
    return True if day > 3 * month else False if month > 3 * day else None


def finish(row: Scanned, decided: bool | None) -> tuple[int | None, int | None, str, bool]:
    """The result of a scanned stamp, given its source's verdict (of use for an open one only)."""
    stamp_id, _, zone, kind, wall, second, offset = row
    if kind == BAD:
        return stamp_id, None, "bad", False
    if kind == EPOCH:
        return stamp_id, wall, "epoch", False
    rule = "plain"
    if kind == OPEN:
        rule = "default" if decided is None else "votes"
        wall = second if decided else wall
    if offset is not None:
        return stamp_id, wall - offset * SECOND, rule, kind == OPEN
    utc, odd = to_utc(wall, zone)
    return stamp_id, utc, rule, odd or kind == OPEN


def _scan_all(rows: Iterable[tuple]) -> Iterator[Scanned]:
    for stamp_id, source, zone, raw in rows:
        yield stamp_id, source, zone, *scan(raw, zone)


def verdicts(scanned: DataFrame) -> RDD:
    """(source, whether day first) for each source whose votes decide; a task sends one pair of numbers for a source."""
    votes = scanned.filter(F.col("kind").isin(VOTE_DAY, VOTE_MONTH)).select("source", F.col("kind") == VOTE_DAY).rdd
    counted = votes.map(lambda row: (row[0], (int(row[1]), int(not row[1])))).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), partitions(scanned.sparkSession))
    return counted.mapValues(verdict).filter(lambda x: x[1] is not None)


def _with_verdicts(scanned: DataFrame, decided: RDD) -> RDD:
    """Rows of scanned, with their source's verdict joined to the open ones, whose keys are salted: no source is one task's."""
    spark = scanned.sparkSession
    found = spark.createDataFrame(decided, "source string, day_first boolean", verifySchema=False).select("source", "day_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asked = scanned.filter(F.col("kind") == OPEN).withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    told = asked.join(found, asked["source"].eqNullSafe(found["source"]) & (asked["salt"] == found["salt"]), "left").select(*[asked[c] for c in scanned.columns], "day_first")
    return scanned.filter(F.col("kind") != OPEN).withColumn("day_first", F.lit(None).cast("boolean")).union(told).rdd


def normalised(stamps: DataFrame, verdict_bytes: int = VERDICT_BYTES) -> DataFrame:
    """One row for each stamp (stamp_id, source, zone, raw): stamp_id, utc_us, rule, ambiguous.

    Null, empty, impossible and very long texts are bad. So are dates without an offset whose zone is null or unknown;
    a zone is not needed for others. Stamps without a source vote together, as one source. Equal numbers of votes (and
    none) decide nothing: month first. Repeated rows vote and are told each for itself; null ids are kept. An empty
    table gives an empty result; other columns are left out, whatever they are called.
    """
    spark = stamps.sparkSession
    rows = stamps.select(F.col("stamp_id").cast("long"), F.col("source").cast("string"), F.col("zone").cast("string"), F.col("raw").cast("string"))
    # Nulls are settled without the scanner, and in the plan of the result.
    nulls = rows.filter(F.col("raw").isNull()).select("stamp_id", F.lit(None).cast("long").alias("utc_us"), F.lit("bad").alias("rule"), F.lit(False).alias("ambiguous"))
    scanned = cut(spark.createDataFrame(rows.filter(F.col("raw").isNotNull()).rdd.mapPartitions(_scan_all), SCANNED, verifySchema=False))
    decided = verdicts(scanned)
    if decided.map(lambda x: 4 * len(x[0] or "") + ENTRY_BYTES).sum() > verdict_bytes:
        done = _with_verdicts(scanned, decided).map(lambda row: finish(row[:7], row[7]))
    else:
        known = spark.sparkContext.broadcast(decided.collectAsMap())
        done = scanned.rdd.mapPartitions(lambda part: (finish(row, known.value.get(row[1])) for row in part))
    return spark.createDataFrame(done, FINISHED, verifySchema=False).union(nulls)


#: The same rows in SQL: forms by one pattern each, offsets from a zone's half hours.
STAMPS_SQL = r"""
WITH RECURSIVE s0 AS (SELECT row_number() OVER () AS n, stamp_id, source, zone, regexp_replace(regexp_replace(raw, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS t FROM stamps),
s1 AS (SELECT *, regexp_full_match(t, '[0-9]{10}|[0-9]{13}') AS epoch,
  regexp_extract(t, '^(20[0-9][0-9]-[0-9]{2}-[0-9]{2}|20[0-9]{6}|[0-9]{2}[.][0-9]{2}[.]20[0-9][0-9]|[0-9]{2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) 20[0-9][0-9]|[0-9]{2}/[0-9]{2}/20[0-9][0-9])([T ]([0-9]{2}):([0-9]{2})(:[0-9]{2})?( ?[AP]M)?( ?(?:Z|[+-][0-9]{2}:?[0-9]{2}))?)?$', ['d', 'c', 'h', 'mi', 'sec', 'half', 'off']) AS g FROM s0),
s2 AS (SELECT n, stamp_id, source, zone, t, epoch, g.d AS d,
  coalesce(TRY_CAST(g.h AS INT), 0) AS h, coalesce(TRY_CAST(g.mi AS INT), 0) AS mi, coalesce(TRY_CAST(g.sec[2:] AS INT), 0) AS sec, trim(g.half) AS half, replace(trim(g.off), ':', '') AS off FROM s1),
s3 AS (SELECT *, CASE WHEN half = '' THEN h <= 23 ELSE h BETWEEN 1 AND 12 END AND mi <= 59 AND sec <= 59 AND (off IN ('', 'Z') OR (TRY_CAST(off[2:3] AS INT) <= 14 AND TRY_CAST(off[4:5] AS INT) <= 59)) AS fine,
  CASE WHEN off = '' THEN NULL WHEN off = 'Z' THEN 0 ELSE (TRY_CAST(off[2:3] AS INT) * 3600 + TRY_CAST(off[4:5] AS INT) * 60) * CASE WHEN off[1] = '-' THEN -1 ELSE 1 END END AS offset_s,
  (CASE WHEN half = '' THEN h ELSE h % 12 + CASE half WHEN 'PM' THEN 12 ELSE 0 END END) * 3600 + mi * 60 + sec AS clock,
  CASE WHEN contains(d, '/') THEN d[7:10] || d[1:2] || d[4:5] WHEN contains(d, '.') THEN d[7:10] || d[4:5] || d[1:2] WHEN contains(d, ' ') THEN d[8:11] || lpad((1 + (position(d[4:6] IN 'JanFebMarAprMayJunJulAugSepOctNovDec') - 1) // 3)::VARCHAR, 2, '0') || d[1:2] ELSE replace(d, '-', '') END AS first_day,
  CASE WHEN contains(d, '/') THEN d[7:10] || d[4:5] || d[1:2] END AS second_day FROM s2),
s4 AS (SELECT *, epoch_us(try_strptime(first_day, '%Y%m%d')) + clock::BIGINT * 1000000 AS first_us, epoch_us(try_strptime(second_day, '%Y%m%d')) + clock::BIGINT * 1000000 AS second_us,
  zone IN (SELECT name FROM pg_timezone_names()) AS known FROM s3),
s5 AS (SELECT *, CASE WHEN t IS NULL THEN 'bad' WHEN epoch THEN 'epoch' WHEN d = '' OR NOT fine OR (offset_s IS NULL AND known IS NOT TRUE) OR (first_us IS NULL AND second_us IS NULL) THEN 'bad'
  WHEN second_day IS NULL OR first_us = second_us THEN 'plain' WHEN first_us IS NULL THEN 'day' WHEN second_us IS NULL THEN 'month' ELSE 'open' END AS kind FROM s4),
v AS (SELECT source, count(*) FILTER (kind = 'day') AS dd, count(*) FILTER (kind = 'month') AS mm FROM s5 GROUP BY source),
s6 AS (SELECT s5.*, CASE WHEN kind = 'day' OR (kind = 'open' AND dd > 3 * mm) THEN second_us ELSE first_us END AS wall,
  CASE WHEN kind IN ('bad', 'epoch') THEN kind WHEN kind <> 'open' THEN 'plain' WHEN dd > 3 * mm OR mm > 3 * dd THEN 'votes' ELSE 'default' END AS rule FROM s5 JOIN v ON s5.source IS NOT DISTINCT FROM v.source),
zones AS (SELECT DISTINCT zone FROM s6 WHERE rule NOT IN ('bad', 'epoch') AND offset_s IS NULL),
half_hours AS (SELECT zone, u, (epoch_us(timezone(zone, make_timestamptz(u * 1000000))) // 1000000 - u) AS o FROM zones, range(946512000, 4102617600, 1800) r(u)),
steps AS (SELECT * FROM (SELECT zone, u, o, lag(o) OVER (PARTITION BY zone ORDER BY u) AS before FROM half_hours) WHERE before IS NULL OR before <> o),
spans AS (SELECT zone, coalesce(u + greatest(o, before), -99999999999) AS from_wall, o, lead(u + least(o, before)) OVER (PARTITION BY zone ORDER BY u) AS odd_from FROM steps)
SELECT stamp_id, CASE rule WHEN 'bad' THEN NULL WHEN 'epoch' THEN TRY_CAST(t AS BIGINT) * CASE WHEN length(t) = 10 THEN 1000000 ELSE 1000 END ELSE (wall - coalesce(offset_s, o)::BIGINT * 1000000)::BIGINT END AS utc_us, rule,
  rule IN ('votes', 'default') OR (rule NOT IN ('bad', 'epoch') AND offset_s IS NULL AND coalesce(wall // 1000000 >= odd_from, FALSE)) AS ambiguous
FROM s6 ASOF LEFT JOIN spans ON s6.zone = spans.zone AND s6.wall // 1000000 >= spans.from_wall
"""
