"""The pipeline, stage by stage, against plain versions."""

import hashlib
import math
import re
import tracemalloc

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from groundwork.llm import toxicity
from groundwork.llm.queries import piece_model, queries
from tests.llm.test_set_operators import brute_components
from tests.llm.test_text_operators import base_spans

FOLDER = "/root/testdata/sf0.001"


def poisson(rate, u):
    """How often P(X <= k) is at most u: the draw of one document."""
    p = total = math.exp(-rate)
    k = 0
    while total <= u and k < 1000:
        k += 1
        p *= rate / k
        total += p
    return k


def plain_copies(docs):
    n = {}
    for d in docs:
        n[d["source"] or ""] = n.get(d["source"] or "", 0) + 1
    weight = {s: c**0.7 for s, c in n.items()}
    out = []
    for d in docs:
        s = d["source"] or ""
        rate = len(docs) * weight[s] / sum(weight.values()) / n[s]
        u = int(hashlib.md5(f"17:{'' if d['doc_id'] is None else d['doc_id']}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out += [d["doc_id"]] * poisson(rate, u)
    return sorted(out, key=repr)


def plain_score(weights, text):
    value = dict(zip(weights.at.tolist(), weights.value.tolist(), strict=True))
    at = set(toxicity.Featurizer(weights.bits)([text])[0].tolist())
    return 1 / (1 + math.exp(-(weights.bias + sum(value.get(k, 0.0) for k in at))))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    before = [r.asDict() for r in docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = [r.asDict() for r in docs.collect()]
        if k < 4:
            assert out.columns == columns
        by = {d["doc_id"]: d for d in before}
        if k == 0:
            weights = toxicity.fit(toxicity.sample(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"), "toxic", toxicity.Settings()))
            assert sorted(d["doc_id"] for d in now) == sorted(i for i, d in by.items() if plain_score(weights, d["text"]) < 0.5)
        elif k == 1:
            classes = brute_components({i: d["text"] for i, d in by.items()})
            assert sorted(d["doc_id"] for d in now) == sorted(i for i, (_, c) in classes.items() if c == i)
        elif k == 2:
            assert len(now) == len(before)
            for d in now:
                assert d["n_chars"] == len(d["text"]) and not base_spans(d["text"])
                # What stays between the masks stands in the text in this order.
                at = 0
                for piece in d["text"].split("[SECRET]"):
                    found = by[d["doc_id"]]["text"].find(piece, at)
                    assert found >= 0
                    at = found + len(piece)
                if not base_spans(by[d["doc_id"]]["text"]) and not re.search(r"[A-Za-z0-9+/_=-]{20,}", by[d["doc_id"]]["text"]):
                    assert d["text"] == by[d["doc_id"]]["text"]
        elif k == 3:
            assert sorted((d["doc_id"] for d in now), key=repr) == plain_copies(before)
            assert all(d == by[d["doc_id"]] for d in now)
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
            assert len(now) == len(before)
            for d in now:
                ids = library.encode(by[d["doc_id"]]["text"], add_eos=True)
                assert d["n_tokens"] == len(ids) and d["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        before = now


def test_odd_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, `label` string, score int"
    rows = [(1, None, None, None, None, 1, "x", 2), (2, "", "en", "a", 0, 1, None, 2), (2, "", "en", "a", 0, 1, None, 2), (None, "a few words", "en", "a", 11, 1, "x", None), (3, "word " * 50_000 + "password=hunter22", "en", "b", 1, 1, "x", 2), (4, "a b c d e f", "en", "b", 1, 1, "x", 2), (5, "A b c d e f", "en", "b", 1, 1, "x", 2), (5, "something else entirely here now", "en", "b", 1, 1, "x", 2)]
    docs, empty = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    ids = [lambda: (1, 2, 2, None, 3, 4, 5, 5), lambda: (1, 2, None, 3, 4, 5), lambda: (1, 2, None, 3, 4, 5)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        assert stage(spark, empty, FOLDER).count() == 0
        told = out.collect()
        if k < 4:
            assert out.columns == docs.columns
        if k < 3:
            assert sorted((r["doc_id"] for r in told), key=repr) == sorted(ids[k](), key=repr)
            docs = spark.createDataFrame(told, schema)
    long = next(r["text"] for r in docs.collect() if r["doc_id"] == 3)
    assert long.endswith("[SECRET]") and len(long) == 250_000 + len("[SECRET]")


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() > 0


@pytest.mark.parametrize(("name", "columns"), [("op4_quality", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"), ("op8_toxicity", "doc_id held_out score predicted"), ("op6_sharding", "doc_id size text_crc32 law shard slot grown_shard"), ("op2_jaccard", "doc_id n_shingles component_id"), ("op5_neighbours", "query_id rank vec_id score")])
def test_columns_stand_as_agreed(spark, name, columns):
    rows = queries()[name](spark, FOLDER)
    assert rows.columns[: len(columns.split())] == columns.split()
    if name == "op6_sharding":
        assert rows.filter(F.col("law") != "bytes").count() == 0


def test_the_driver_gets_no_more_of_the_fit_than_its_weights(spark):
    documents, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    settings = toxicity.Settings()
    here = toxicity.fit(toxicity.sample(documents, labels, "toxic", settings), settings)
    tracemalloc.start()
    try:
        told = toxicity.scored(documents, labels)
        # The coordinates alone would take 16 MB.
        assert tracemalloc.get_traced_memory()[1] < 6_000_000
    finally:
        tracemalloc.stop()
    assert told.count() == documents.count()
    there = toxicity.fitted(toxicity.examples(documents, labels, "toxic", settings), settings)
    assert there.bias == here.bias and len(here.at) and there.at.tolist() == here.at.tolist() and there.value.tolist() == here.value.tolist()
    nothing = toxicity.fitted(spark.createDataFrame([], "_text string, _label int"), settings)
    assert nothing.bias == 0 and not len(nothing.at)
