"""Byte-level BPE, the Merkle manifest and the timestamps against the library and plain versions."""

import functools
import hashlib
import random
import zlib
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
import regex
import tokenizers
from pyspark.sql import functions as F

from groundwork.llm import merkle, stamps, words
from groundwork.llm.queries import byte_pairs

FOLDER = "/root/testdata/sf0.001"

# Words.

ODD_TEXTS = [
    None, "", " ", "\n", "a", "it's I'LL we've", "a<|endoftext|> b  <|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext |>", "x  y   z \n\n w", "12 ⅷ ٣ ½",
    "tab\tcr\r\nnul\x00 nbsp em  zwsp​", "日本語 텍스트 🙂🙂", "ՠ ౜ aՠb⹝", " " * 3000 + "x" * 3000, "ab" * 5000, "the " * 2000, "same", "same",
]


@functools.cache
def the_library():
    return tokenizers.Tokenizer.from_file(byte_pairs())


def told_by_library(text):
    library = the_library()
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_words_equal_the_library(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()] + ODD_TEXTS
    rows = spark.createDataFrame([(k // 2 if k % 7 else None, t, "clash", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids_sha256 string, slice int")
    got = words.encode_decode(rows, byte_pairs(), slice_bytes=200_000)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    expected = []
    for k, t in enumerate(texts):
        ids, decoded = told_by_library(t)
        expected.append((k // 2 if k % 7 else None, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_ids_and_text_and_slices_of_any_size(spark):
    rows = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string").repartition(3)
    for size in (1, 10_000_000):
        got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in words.ids_and_text(rows, byte_pairs(), slice_bytes=size).collect()}
        assert got == {k: told_by_library(t) for k, t in enumerate(ODD_TEXTS)}
    assert words.ids_and_text(rows.limit(0), byte_pairs()).collect() == []


def test_each_distinct_word_is_encoded_once(spark):
    rows = spark.createDataFrame([(k, "one two one two three") for k in range(40)], "doc_id long, text string").repartition(8)
    asked = rows.mapInArrow(*words._sliced(byte_pairs(), 4, 10)).mapInArrow(words._asked, words.ASKED)
    table = words.word_table(asked, byte_pairs()).collect()
    assert sorted(r["word"] for r in table if r["at"] == 0) == [" one", " three", " two", "one"]
    assert sum(len(r["uses"]) // words._USE.itemsize for r in table if r["at"] == 0) == 40 * 4


def test_a_slice_travels_in_small_rows(spark):
    """One row for a whole slice filled executors; texts without characters end a slice too."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**5)}" for _ in range(60_000)) for _ in range(10)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    parts = rows.mapInArrow(*words._sliced(byte_pairs(), 64, 10**9)).withColumn("bytes", F.expr("octet_length(packed)"))
    assert parts.select("slice").distinct().count() == 1
    assert parts.agg(F.max("bytes")).first()[0] * 3 < parts.agg(F.sum("bytes")).first()[0]
    empty = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")).coalesce(1)
    assert empty.mapInArrow(*words._sliced(byte_pairs(), 4, 20 * words.ROW_BYTES)).select("slice").distinct().count() == 5


def test_workers_keep_no_memory_of_words_that_they_encoded(spark):
    """The library's threads, one for each core of the machine, kept ever more; what is freed goes back to the system."""

    def now():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("Pss_Anon")) / 1024

    def measured(batches):
        import os

        import pyarrow as pa

        words.encoder_of(path)
        words.give_back()
        before, threads = now(), len(os.listdir("/proc/self/task"))
        n = sum(b.num_rows for b in run(batches))
        yield pa.RecordBatch.from_pydict({"n": [n], "mb": [now() - before], "threads": [len(os.listdir("/proc/self/task")) - threads]})

    path = byte_pairs()
    run, _ = words._distinct(path)
    texts = [" ".join(f"w{a * 10_000 + k} x{k}y{a}" for k in range(10_000)) for a in range(8)]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).mapInArrow(*words._sliced(path, 1, 10**9)).mapInArrow(words._asked, words.ASKED)
    met = asked.groupBy("bucket").agg(F.collect_list(F.struct("slice", "first", *[c for c in asked.columns if c not in ("bucket", "slice", "first")])).alias("asked")).select("asked")
    told = met.coalesce(1).mapInArrow(measured, "n long, mb double, threads long").first()
    assert told["n"] >= 1 and told["threads"] == 0 and told["mb"] < 50, told


def test_no_shuffle_but_those_by_slice_and_bucket(spark):
    rows = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    got = words.encode_decode(rows, byte_pairs())
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("ENSURE_REQUIREMENTS") == 2, plan


def test_characters_that_unicode_versions_class_differently():
    encoder = words.Encoder(byte_pairs())
    odd = [chr(c) for c in (0x558, 0x58B, 0x88F, 0x2E5D, 0x1F6DC, 0x1FAE8, 0x31350)]
    for c in odd + ["é", "ß", "ı", "٣", "　", "漢"]:
        text = f"ab{c}cd 12{c}3 !{c}? {c} x"
        parts = encoder.words(text)
        assert "".join(parts) == text
        assert [i for p in parts for i in encoder.encode(p)] == told_by_library(text)[0], hex(ord(c))


def test_broken_merges_fail(monkeypatch):
    encoder = words.Encoder(byte_pairs())
    first = next(iter(encoder.merges))
    del encoder.merges[first]
    word = (encoder.bytes_of[first >> words.BITS] + encoder.bytes_of[first & (1 << words.BITS) - 1]).decode()
    with pytest.raises(words.Differs):
        encoder.encode_all([word])


@pytest.mark.parametrize("n", [0, 1, 255, 256, 70_000])
def test_packed_numbers_come_back(n):
    numbers = np.random.default_rng(n).integers(0, 1 << 32, n)
    assert n == 0 or (words._unpack_numbers(words._pack_numbers(numbers)) == numbers).all()


def test_the_pattern_is_the_public_one():
    import public_tokenizers

    assert regex.compile(words.PATTERN).pattern == public_tokenizers.PATTERN


# Manifest.


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def plain_tree(nodes):
    """Levels of a tree, the nodes first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def plain_path(tree, at):
    path = []
    for level in tree[:-1]:
        run, k = level[at // 8 * 8 : at // 8 * 8 + 8], at % 8
        path.append((run[:k], run[k + 1 :]))
        at //= 8
    return path


def plain_manifest(rows):
    by = {}
    for row in rows:
        by.setdefault(row[2], []).append(row)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[lang] = plain_tree([plain_leaf(r) for r in by[lang]])
    top = plain_tree([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for at, row in enumerate(by[lang]):
            path = plain_path(trees[lang], at) + plain_path(top, k)
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = plain_leaf((*row[:4], text))
            for before, after in path:
                node = h(*before, node, *after)
            out.append((row[0], plain_leaf(row), trees[lang][-1][0], top[-1][0], h(*[x for b, a in path for x in b + a]), node, node == top[-1][0]))
    return out


def documents(n, seed=1):
    r = random.Random(seed)
    langs = [None, "", "de", "en", "é", "zz", "Z"]
    rows = [(k if k % 11 else None, r.choice([None, "web", "Büro"]), r.choice(langs[:2] + ["en"] * 9), r.choice([None, 5]), r.choice(["Abc É", "x", "", None, "LONG" * 20000])) for k in range(n)]
    rows += rows[:5] + [(1, "a", "q", 1, "only one")] + [(7, "hot", "hot", 1, "SAME")] * (n // 3)
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def manifest(df, **more):
    return merkle.digest(merkle.manifest(df, merkle.tampered(F.col("doc_id"), F.col("text")), **more))


@pytest.mark.parametrize(("n", "deep"), [(150, 1), (150, 2), (9, 4), (700, 2)])
def test_manifest_equals_a_plain_version(spark, n, deep):
    rows = documents(n)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("grp", F.lit("clash")).withColumn("leaf", F.lit("clash")).withColumn("path", F.lit(0))
    got = manifest(df.repartition(5), deep=deep)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_manifest(rows), key=repr)


def test_manifest_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert manifest(empty).collect() == []
    for rows in ([(1, None, None, None, None)], [(k, "a", str(k), 1, "X") for k in range(70)]):
        assert sorted(map(tuple, manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == sorted(plain_manifest(rows), key=repr)


def test_a_proof_holds_for_its_own_leaf_alone(spark):
    df = spark.createDataFrame(documents(60), SCHEMA)
    found = merkle.manifest(df, deep=1)
    assert found.filter(F.col("altered_leaf").isNotNull()).isEmpty()
    for start, same in ((F.col("leaf"), True), (F.lit("0" * 64), False)):
        assert found.select((merkle.folded(start, F.col("path")) == F.col("root")).alias("ok")).filter(F.col("ok") != F.lit(same)).isEmpty()


# Stamps.

PLAIN = r"""(?x)(?:(?P<y1>20[0-9][0-9])-(?P<m1>[0-9]{2})-(?P<d1>[0-9]{2})|(?P<y2>20[0-9][0-9])(?P<m2>[0-9]{2})(?P<d2>[0-9]{2})|(?P<d3>[0-9]{2})[.](?P<m3>[0-9]{2})[.](?P<y3>20[0-9][0-9])
|(?P<d4>[0-9]{2})\x20(?P<b4>Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\x20(?P<y4>20[0-9][0-9])|(?P<a5>[0-9]{2})/(?P<c5>[0-9]{2})/(?P<y5>20[0-9][0-9]))
(?:[T\x20](?P<h>[0-9]{2}):(?P<mi>[0-9]{2})(?::(?P<s>[0-9]{2}))?(?:\x20?(?P<half>[AP]M))?(?:\x20?(?:(?P<z>Z)|(?P<sign>[+-])(?P<oh>[0-9]{2}):?(?P<om>[0-9]{2})))?)?"""


def plain_scan(raw, zone):
    """None (bad), ('epoch', us), or [month-first, day-first] dates with (hour, minute, second), offset and whether slashed."""
    text = (raw or "").strip(" \t\n\v\f\r")
    if regex.fullmatch("[0-9]{10}|[0-9]{13}", text):
        return "epoch", int(text) * (10**6 if len(text) == 10 else 10**3)
    m = regex.fullmatch(PLAIN, text)
    if not m:
        return None
    g = m.groupdict()
    h, mi, s = int(g["h"] or 0), int(g["mi"] or 0), int(g["s"] or 0)
    if g["half"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if g["half"] == "PM" else 0)
    offset = None
    if g["z"]:
        offset = timedelta(0)
    elif g["sign"]:
        if int(g["oh"]) > 14 or int(g["om"]) > 59:
            return None
        offset = (1 if g["sign"] == "+" else -1) * timedelta(hours=int(g["oh"]), minutes=int(g["om"]))

    def made(y, mo, d):
        try:
            return datetime(int(y), int(mo), int(d), h, mi, s)
        except ValueError:
            return None

    if g["y5"]:
        pair = [made(g["y5"], g["a5"], g["c5"]), made(g["y5"], g["c5"], g["a5"])]
    else:
        k = next(k for k in "1234" if g[f"y{k}"])
        month = g.get(f"m{k}") or 1 + "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split().index(g["b4"])
        pair = [made(g[f"y{k}"], month, g[f"d{k}"])] * 2
    if pair == [None, None]:
        return None
    if offset is None:
        try:
            ZoneInfo(zone or "")
        except (KeyError, ValueError, OSError):
            return None
    return pair, offset


def plain_stamps(rows):
    scanned = [plain_scan(raw, zone) for _, _, zone, raw in rows]
    votes = {}
    for (_, source, _, _), x in zip(rows, scanned, strict=True):
        if x and x[0] != "epoch" and None in x[0]:
            votes.setdefault(source, [0, 0])[x[0][0] is None] += 1
    out = []
    for (i, source, zone, _), x in zip(rows, scanned, strict=True):
        if x is None:
            out.append((i, None, "bad", False))
        elif x[0] == "epoch":
            out.append((i, x[1], "epoch", False))
        else:
            (first, second), offset = x
            rule, odd = "plain", False
            if first is None or second is None:
                wall = first or second
            elif first == second:
                wall = first
            else:
                month, day = votes.get(source, [0, 0])
                rule, odd = ("votes" if day > 3 * month or month > 3 * day else "default"), True
                wall = second if day > 3 * month else first
            if offset is not None:
                utc = wall - offset
            else:
                there = wall.replace(tzinfo=ZoneInfo(zone))
                utc = (there - there.utcoffset()).replace(tzinfo=None)
                odd = odd or there.utcoffset() != there.replace(fold=1).utcoffset()
            out.append((i, round((utc.replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)), rule, odd))
    return out


def odd_stamps():
    r = random.Random(5)
    texts = [
        None, "", " ", "\t2024-01-02\r\n", " 2024-01-02", "2024-02-30", "2023-02-29", "20240229", "2024-1-2", "1999-01-01", "2024-01-01T24:00", "2024-01-01 23:60", "2024-01-01 10:00:60", "2024-01-01T10:00:59",
        "2024-01-01 00:10 AM", "2024-01-01 12:10 AM", "2024-01-01 12:10PM", "2024-01-01 13:10 PM", "2024-01-01 01:10 PM+05:30", "2024-01-01 01:10 PM  Z", "2024-01-01 01:10 Z", "2024-01-01 01:10  Z", "2024-01-01T01:10-1400",
        "2024-01-01T01:10+15:00", "2024-01-01T01:10+1460", "2024-01-01T01:10+14:59", "2024-01-01 01:10 am", "2024-01-01t01:10", "2024-01-01Z", "1700000000", "17000000001", "1700000000123", "٣٣٣٣٣٣٣٣٣٣", "٢٠٢٤-01-01",
        "31.12.2099 23:59:59", "01.01.2000", "05 Nov 2024 02:48", "05 nov 2024", "31 Apr 2024", "05/05/2024", "31/01/2024", "01/31/2024", "03/04/2024 10:00 +0200", "13/13/2024", "31/04/2024", "04/31/2024", "x" * 100_000, "2024-01-01 10:00x", "2024-01-01 10:00 A", "2024-01-01 10:00 AM PM",
    ]
    zones = ["UTC", "Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Lord_Howe", "Africa/Casablanca", "No/Where", "", None, "../x"]
    rows = [(k, f"s{k % 4}", z, t) for k, (t, z) in enumerate((t, z) for t in texts for z in zones)]
    for zone in zones[:6]:
        for year in (2000, 2024, 2037, 2099):
            for month, day in ((3, 31), (3, 10), (4, 7), (10, 6), (10, 27), (11, 3), (3, 8), (11, 1), (3, 29), (10, 25)):
                for minute in (0, 59, 60, 90, 119, 120, 149, 150, 179, 180):
                    rows.append((len(rows), "wall", zone, f"{year}-{month:02}-{day:02} {minute // 60:02}:{minute % 60:02}"))
    for source, day, month in (("days", 4, 1), ("even", 3, 1), ("months", 0, 1), (None, 1, 0), ("none", 0, 0)):
        some = ["25/12/2024"] * day + ["12/25/2024"] * month + ["31/12/2024 25:00"] * 9 + [f"{r.randint(1, 12):02}/{r.randint(1, 12):02}/2024 10:00" for _ in range(6)]
        rows += [(len(rows) + k, source, "UTC", t) for k, t in enumerate(some)]
    return rows + rows[:3] + [(None, None, None, None)]


@pytest.mark.parametrize("verdict_bytes", [stamps.VERDICT_BYTES, 0])
def test_stamps_equal_a_plain_version(spark, verdict_bytes):
    rows = odd_stamps()
    df = spark.createDataFrame(rows, "stamp_id long, source string, zone string, raw string").withColumn("kind", F.lit("clash")).withColumn("day_first", F.lit(1)).withColumn("utc_us", F.lit(0))
    got = stamps.normalised(df.repartition(3), verdict_bytes)
    assert got.columns == ["stamp_id", "utc_us", "rule", "ambiguous"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_stamps(rows), key=repr)


def test_stamps_of_an_empty_table(spark):
    assert stamps.normalised(spark.createDataFrame([], "stamp_id long, source string, zone string, raw string")).collect() == []
