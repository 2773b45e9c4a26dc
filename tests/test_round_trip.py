"""Sources with models, resume and entry point; lookups, hints and answers on small cases."""

import http.server
import json
import re
import threading

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from groundwork import cli
from groundwork.functions import lexicon as L
from groundwork.functions import text as T
from groundwork.operators import chunking, evaluation, knowledge, paragraphs, retrieval
from groundwork.sources import files

EDGES = [("e1", "coal plant", "x", "EMITS", "co2", "y"), ("e2", "co2", "y", "CAUSES", "warming", "z"), ("e3", "solar farm", "x", "REDUCES", "co2", "y"), ("e4", "ice", "z", "MELTS", "ice", "z")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "eid string, subject string, subject_label string, relation string, object string, object_label string")


def test_run_summary(spark):
    answers = ["data", "No information found in the graph", "Error: timeout", "", None, "error: no error", "No information found. Error: both", "no information found"]
    row = evaluation.run_summary(spark.createDataFrame([(a,) for a in answers], "answer string")).first()
    assert row.asDict() == {"total": 8, "answered": 3, "no_info": 2, "errors": 2}


def test_weak_and_missing_evidence(spark):
    questions = spark.createDataFrame([(k, "coal causes warming") for k in range(4)], "question_id int, question string")
    shown = [(0, "kg", "coal plant", 1), (0, "text", " coal causes warming ", 2), (1, "text", " \n", 1), (1, "kg", None, 2)]
    evidence = spark.createDataFrame(shown, "question_id int, source string, display string, rank int")
    got = {r["question_id"]: r["answer"] for r in retrieval.extractive_answers(questions, evidence).collect()}
    assert got[0] == "For 'coal causes warming', retrieved evidence indicates: coal causes warming. Additional supporting evidence: coal plant.\nSources: TEXT:1, KG:entity_name"
    assert got[1] == L.WEAK_EVIDENCE and got[2] == got[3] == L.NO_EVIDENCE
    raw = retrieval.raw_evidence(
        spark.createDataFrame([(2, "coal", "fuel", k) for k in range(1, 4)], "question_id int, text string, canonical_label string, rank int"),
        spark.createDataFrame([(2, "coal", "CAUSES", "warming", 1)], "question_id int, subject string, relation string, object string, rank int"),
        spark.createDataFrame([(0, "never used", 1), (2, "coal " * 100, 1)], "question_id int, text string, rank int"),
    )
    assert raw.filter("question_id = 2").count() == 4 and raw.agg(F.max(F.length("display"))).first()[0] == 220
    told = {r["question_id"]: r["answer"] for r in retrieval.extractive_answers(questions, evidence, raw=raw).collect()}
    assert told[0] == got[0] and told[3] == L.NO_EVIDENCE and "coal --[CAUSES]--> warming." in told[2]


def test_extractive_answer_as_its_sql(spark, tmp_path):
    """Lines cut at 300 characters may end in a line end or a blank; some are blank, some null."""
    bodies = ["coal causes warming", "coal\n", "\u3000coal causes\t", "x" * 298 + "\n coal", " ", "\n", None, "\xa0", "a coal plant\r\n "]
    rows = [(c, t, role, bodies[(c * 5 + t * (c % 4 + 1)) % len(bodies)] if t else ("coal causes" if c % 7 else None)) for c in range(36) for t, role in enumerate(("user", "assistant", "user", "assistant", "system", "assistant")[: c % 6 + 1])]
    spark.createDataFrame([(90, 0, "user", "coal"), (90, 1, "assistant", " "), (91, 0, "user", None), (91, 1, "user", "coal"), *rows], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    told = con.sql(entry.oracle_sql()["extractive_answer"]).fetchall()
    got = [(r["question_id"], r["answer"]) for r in entry.queries()["extractive_answer"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(told) and any(".\n\nSources" in a or "\n." in a for _, a in told)


def test_fallback_lookup(spark, edges):
    asked = spark.createDataFrame([(0, "What is the coal plant?"), (1, "how is it"), (2, "solar, coal or lunar?"), (3, "unknown thing")], "question_id int, question string")
    got = {}
    for r in knowledge.fallback_lookup(asked, edges, limit=3).orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append(r["entity"])
    assert got == {0: ["coal plant"], 1: ["co2", "coal plant", "ice"], 2: ["coal plant", "solar farm"]}


def test_cascade_with_synonyms_and_written_results(spark, edges):
    asked = spark.createDataFrame([(0, "nothing here", ["permafrost"]), (1, "co2", ["co2"])], "question_id int, phrase string, keywords array<string>")
    assert {(r["question_id"], r["tier"]) for r in knowledge.cascade(asked, edges).collect()} == {(1, 0)}
    words = spark.createDataFrame([(0, "thawing, melting of permafrost: solar")], "question_id int, synonyms string")
    # Rows that synonyms bring are relevant only if they hold a keyword of the question itself.
    more = edges.union(spark.createDataFrame([("e9", "solar heat", "x", "THAWS", "permafrost", "y")], edges.schema))
    got = knowledge.cascade(asked, edges, synonyms=words).collect()
    assert {(r["question_id"], r["tier"]) for r in got} == {(1, 0)}
    for synonyms, entities in ((None, {"solar heat", "permafrost"}), (words, {"solar heat", "permafrost", "solar farm", "co2"})):
        got = [r for r in knowledge.cascade(asked, more, synonyms=synonyms).collect() if r["question_id"] == 0]
        assert {r["tier"] for r in got} == {8} and {r["entity"] for r in got} == entities
    written = spark.createDataFrame([(1, "a", "b", "co2 again", 1)], "question_id int, entity string, relationship string, related_entity string, rank int")
    assert [(r["tier"], r["related_entity"]) for r in knowledge.cascade(asked, edges, written=written).collect()] == [(-1, "co2 again")]


def test_hints(spark):
    chunks = spark.createDataFrame([("c1", "Acme met Bonn"), ("c2", None), ("c3", "none")], "chunk_id string, text string")
    kinds = {"Acme": "ORG", "Bonn": "GPE", "met": "PERSON"}
    hints = knowledge.recognised(chunks, lambda: lambda texts: [[(w, kinds[w]) for w in t.split() if w in kinds] for t in texts])
    got = {r["chunk_id"]: (len(r["hints"]), r["hint_lines"]) for r in knowledge.with_hints(chunks, hints).collect()}
    assert got == {"c1": (2, "Acme (ORG) — from c1\nBonn (GPE) — from c1"), "c2": (0, "None found."), "c3": (0, "None found.")}


def test_answers_are_continued(spark):
    rows = spark.createDataFrame([(0, "q", "Whole."), (1, "q", "It breaks off because"), (2, "q", "endless"), (3, "q", "silent"), (4, "q", None)], "k int, prompt string, answer string")

    def client():
        def ask(prompts):
            assert all(p.startswith("q\n\nCurrent answer:\n") for p in prompts)
            return ["it can." if "because" in p else "" if "silent" in p else "and" for p in prompts]

        return ask

    got = {r["k"]: r["answer"] for r in files.continued(rows, client).collect()}
    assert got == {0: "Whole.", 1: "It breaks off because it can.", 2: "endless and and", 3: "silent", 4: None}


def test_client_tries_again_and_times_out(spark):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
            seen.append(asked)
            self.send_response(500 if seen.count(asked) == 1 else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": asked.upper()}}]}).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        connect = files.http_client(f"http://127.0.0.1:{server.server_port}/", wait=0.01, timeout=5)
        assert connect()(["a", "b"]) == ["A", "B"] and seen == ["a", "a", "b", "b"]
        rows = spark.createDataFrame([("c",), ("d",)], "prompt string").coalesce(1)
        assert {(r["prompt"], r["answer"], r["error"]) for r in files.generate(rows, connect).collect()} == {("c", "C", None), ("d", "D", None)}
    finally:
        server.shutdown()
    with pytest.raises(OSError):
        files.http_client("http://127.0.0.1:9/", tries=2, wait=0.01, timeout=0.2)()(["x"])


def test_results_are_saved_as_they_come_and_a_row_is_worked_on_once(spark, tmp_path):
    log, broken = tmp_path / "calls", tmp_path / "broken"
    log.mkdir()
    broken.touch()

    def client():
        def ask(prompts):
            import os
            import uuid

            for p in prompts:
                (log / f"{p}-{uuid.uuid4().hex}").touch()
                if p == "p57" and broken.exists():
                    os.unlink(broken)
                    raise KeyboardInterrupt("the model went away")
            return [p.upper() for p in prompts]

        return ask

    rows = spark.createDataFrame([(k, f"p{k}") for k in range(100)], "k int, prompt string").coalesce(1)
    path, work = str(tmp_path / "out"), lambda df: files.generate(df, client)
    with pytest.raises(Exception, match="(?s)."):
        files.write_every(rows, path, 10, work)
    saved = {r["k"] for r in spark.read.schema("k int").parquet(f"{path}/rows").collect()}
    assert 57 not in saved and len(saved) % 10 == 0
    for _ in range(2):  # the second call has nothing left to do
        got = files.write_every(rows, path, 10, work)
        assert sorted((r["k"], r["answer"], r["error"]) for r in got.collect()) == [(k, f"P{k}", None) for k in range(100)]
    calls = [p.name.split("-")[0] for p in log.iterdir()]
    assert set(calls) == {f"p{k}" for k in range(100)} and all(calls.count(f"p{k}") == 1 for k in saved)
    assert {p for p in calls if calls.count(p) > 1} <= {f"p{k}" for k in range(50, 60)}
    assert files.write_every(rows.limit(0), str(tmp_path / "none"), 10, work).collect() == []
    assert files.write_every(spark.range(25), str(tmp_path / "plain"), 10, files=3).count() == 25


def test_client_errors_are_not_tried_again():
    seen = []

    class Refuses(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(self.path)
            self.send_error(int(self.path[1:]))

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Refuses)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        for code, tries in ((404, 1), (429, 2), (503, 2)):
            seen.clear()
            with pytest.raises(OSError):
                files.http_client(f"http://127.0.0.1:{server.server_port}/{code}", tries=2, wait=0.01)()(["x"])
            assert len(seen) == tries, code
    finally:
        server.shutdown()


def brute_top_k(vectors, queries, k, metric):
    out = []
    for name, q in queries:
        near = []
        for i, v in vectors:
            if i is None or v is None or len(v) != len(q) or any(x is None or not np.isfinite(x) for x in v) or (metric == "cosine" and not any(v)):
                continue
            x, y = np.array(v, float), np.array(q, float)
            near.append(((x - y) @ (x - y), i) if metric == "l2" else (-(x @ y) / np.sqrt(x @ x) / np.sqrt(y @ y), i))
        out += [(name, r, i, round(abs(d) if metric == "l2" else -d, 9)) for r, (d, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("query_bytes", [retrieval.QUERY_BYTES, 0])
def test_vectors_that_are_no_use_take_no_part(spark, monkeypatch, metric, query_bytes):
    monkeypatch.setattr(retrieval, "CELL_QUERIES", 100)
    monkeypatch.setattr(retrieval, "CELL_VECTORS", 1000)
    r = np.random.default_rng(3)
    vectors = [(k, r.integers(-3, 4, 5).astype(float).tolist()) for k in range(200)]
    vectors += [(900, [float("nan"), 1.0, 1.0, 1.0, 1.0]), (901, [float("inf")] * 5), (902, [0.0] * 5), (903, None), (904, [1.0]), (905, [1.0, None, 1.0, 1.0, 1.0]), (None, [1.0] * 5)]
    queries = [(k, r.integers(-3, 4, 5).astype(float).tolist()) for k in range(20)]
    queries = [(k, q if any(q) else [1.0] * 5) for k, q in queries]
    v, q = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3), spark.createDataFrame(queries, "query_id long, query array<double>")
    got = retrieval.vector_top_k(v, q, 7, metric=metric, query_bytes=query_bytes)
    assert sorted((x["query_id"], x["rank"], x["vec_id"], round(x["distance"], 9)) for x in got.collect()) == brute_top_k(vectors, queries, 7, metric)
    three = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [float("nan"), 0.0]), (3, [0.0, 0.0])]
    small = retrieval.vector_top_k(spark.createDataFrame(three, "vec_id long, embedding array<double>"), spark.createDataFrame([(0, [1.0, 1.0])], "query_id long, query array<double>"), 3, metric=metric, query_bytes=query_bytes)
    assert {x["vec_id"] for x in small.collect()} == ({0, 1, 3} if metric == "l2" else {0, 1})
    for bad in ([float("nan"), 1.0], [float("inf"), 1.0], None, [1.0, None]):
        with pytest.raises(ValueError):
            retrieval.vector_top_k(v, spark.createDataFrame([(0, [1.0] * 5), (1, bad)], "query_id long, query array<double>"), 3)
    assert retrieval.vector_top_k(v, q.limit(0), 3, query_bytes=query_bytes).collect() == []


def test_weak_questions_alone_are_retrieved_again(spark):
    questions = spark.createDataFrame([(k, "coal causes warming") for k in range(4)], "question_id int, question string")
    rows = spark.createDataFrame([(0, "kg", "entity", 0, 1.0), (0, "text", "chunk", 0, 1.0), (1, "text", "chunk", 2, 1.0), (2, "kg", "triple", 0, 1.0), (2, "kg", "triple", 5, 2.0)], "question_id int, source string, kind string, idx int, score_raw double").withColumn("display", F.lit("x"))
    asked = []

    def retrieve(some, kg_k, text_k):
        asked.append((kg_k, text_k, sorted(r["question_id"] for r in some.collect())))
        return rows.join(some.select("question_id"), "question_id").filter(((F.col("source") == "kg") & (F.col("idx") < kg_k)) | ((F.col("source") == "text") & (F.col("idx") < text_k)))

    got = {}
    for r in retrieval.adaptive(questions, retrieve, 2, 1, fuse=lambda x: retrieval.fused(x, alpha=0.2)).collect():
        got.setdefault(r["question_id"], set()).add((r["fetched"], r["source"], r["idx"]))
    assert asked == [(2, 1, [0, 1, 2, 3]), (6, 3, [1, 2, 3])]
    # Of question 2 the graph alone weighs 0.2 at most; the second retrieval's two triples replace the one of the first.
    assert got == {0: {(1, "kg", 0), (1, "text", 0)}, 1: {(2, "text", 2)}, 2: {(2, "kg", 5)}}


def test_safe_rows(spark):
    run = lambda spec: spark.sql(spec)
    assert [r["n"] for r in files.safe_rows(spark, "SELECT 1 AS n, 2 AS m", run, "n long").collect()] == [1]
    for bad in (None, "", "SELECT 1", "SELECT nonsense FROM nowhere", "SELECT assert_true(id > 5) AS n FROM range(9)", "SELECT CAST('x' AS INT) AS n, 1"):
        found = files.safe_rows(spark, bad, run, "n long")
        assert found.count() == 0 and found.columns == ["n"]


def test_entry_point(spark, tmp_path, capsys):
    assert cli.main([]) == 0 and "filter_stats" in capsys.readouterr().out
    assert cli.main(["no_such_query", "--data", "x"]) == 2 and cli.main(["first_documents"]) == 2
    assert cli.main(["first_documents", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path), "--format", "json"]) == 0
    assert spark.read.json(str(tmp_path / "first_documents")).count() == 10


def test_scores_have_their_names(spark):
    text = "Rising CO2 causes warming of 3 % (Smith et al., 2020) (Lee, 2019) [3] which impacts the department of health"
    row = paragraphs.scored(spark.createDataFrame([(text,)], "text string")).first()
    assert set(row["breakdown"]) == {"base", "climate_keywords", "causal_language", "quantitative_data", "impact_language", "heavy_citations", "author_affiliation", "proper_length"}
    assert row["score"] == max(0, min(100, sum(row["breakdown"].values()))) and row["breakdown"]["base"] == 50


def test_written_patterns_are_cleaned(spark):
    cases = {"```cypher\nMATCH (n) RETURN n LIMIT 5\n``` bye": "MATCH (n) RETURN n LIMIT 5", "match (n) where n = “x” return n limit 7 and": "match (n) where n = 'x' return n limit 7", "no pattern": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.spec_cleaned(F.col("t")).alias("c"))
    assert {r["t"]: r["c"] for r in df.collect()} == cases


def plain_spans(text, size, overlap, least):
    """The windows by looking at every character."""
    end_here = lambda k: text[k] in ".!?" and (k + 1 == len(text) or text[k + 1].isspace()) and not (k >= 2 and text[k - 1].isupper() and text[k - 2].isspace())
    begin, taken, out = 0, -1, []
    while begin < len(text):
        finish = min(begin + size, len(text))
        if finish < len(text):
            finish = max([k + 1 for k in range(begin + size // 2, finish) if end_here(k)], default=finish)
        if len(text[begin:finish].strip()) >= least:
            out.append((begin, finish))
            taken = begin
        back = finish - overlap
        if back <= begin:
            begin = finish
            continue
        near = back
        blank = text.find("\n\n", back)
        found = re.search(r"[.!?]\s+([A-Z])", text[back : back + overlap + 50])
        if 0 <= blank - back < overlap:
            near = blank + 2
        elif found:
            near = back + found.start(1)
        begin = near if near > taken else finish
    return out


def test_sentence_windows_equal_a_plain_version():
    import random

    r = random.Random(4)
    for _ in range(150):
        text = "".join(r.choice("abc .!?\n\nAB  ") for _ in range(r.randrange(1500)))
        for size, overlap, least in ((500, 50, 100), (80, 20, 5), (60, 30, 1)):
            assert list(chunking.SentenceChunker(size, overlap, least).spans(text)) == plain_spans(text, size, overlap, least)


def test_vector_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    x = np.random.default_rng(3).normal(size=(200, 6))
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(500, None), (501, [1.0]), (502, [None] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(20)], "query_id long, query array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.vector_top_k(vectors, queries, 3).collect()}
    for q in range(20):
        assert [got[q, k] for k in (1, 2, 3)] == np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[:3].tolist()
    for bad in ([(0, [1.0]), (1, [1.0, 2.0])], [(0, [None])]):
        with pytest.raises(ValueError, match="one length"):
            retrieval.vector_top_k(vectors, spark.createDataFrame(bad, "query_id long, query array<double>"))


def test_a_model_is_loaded_once_a_task(spark):
    class Scorer:
        def load(self):
            import pandas as pd

            calls = iter([1.0])  # a second load in one task would start anew
            first = next(calls)
            return lambda query, text: pd.Series(first * text.str.len())

    rows = spark.createDataFrame([(0, "q", "a" * k, k) for k in range(1, 6)], "query_id int, query string, text string, rank int")
    got = retrieval.reranked(rows, Scorer(), 2).orderBy("new_rank").collect()
    assert [r["text"] for r in got] == ["aaaaa", "aaaa"]


def test_factual_metrics(spark):
    rows = spark.createDataFrame([("m", "a b c", "a b c", "correct"), ("m", "a b c", "x y z", "partial"), ("n", "a b", "a b", "correct")], "model_config string, reference string, answer string, tag string")
    got = {r["model_config"]: r for r in evaluation.factual_metrics(rows).collect()}
    assert got["m"]["rouge_l"] == pytest.approx(0.5) and got["m"]["accuracy"] == 0.5 and got["n"]["rouge_l"] == pytest.approx(1.0)
    row = evaluation.similarity_summary(rows, retrieval.hash_encoder()).first()
    assert row["median"] == pytest.approx(1.0) and row["mean"] < 1


def test_over_fetch():
    assert [retrieval.over_fetch(5, True, 100), retrieval.over_fetch(5, False, 100), retrieval.over_fetch(5, True, 12), retrieval.over_fetch(50, False, 12)] == [20, 5, 12, 12]
