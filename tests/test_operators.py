import json

import pytest
from pyspark.sql import functions as F

from groundwork.operators import evaluation as E
from groundwork.operators import knowledge as K
from groundwork.operators import retrieval as R
from groundwork.sources import files
from groundwork.streaming import ingest


def test_first_entities(spark):
    rows = spark.createDataFrame([(1, "CO2 ", "L", "c1"), (2, "co2", "L", "c1"), (3, "co2", "L", "c2"), (4, " ", "L", "c1")], "seq long, text string, canonical_label string, chunk_id string")
    assert sorted(r["seq"] for r in K.first_entities(rows).collect()) == [1, 3]
    assert sorted(r["seq"] for r in K.first_entities(rows.repartition(4)).collect()) == [1, 3]


def test_relation_matrix(spark):
    labels = spark.createDataFrame([("emission_source",), ("greenhouse_gas",), ("quantity",), ("other",)], "canonical_label string")
    model = spark.createDataFrame([("other", "greenhouse_gas", "acts on"), ("other", "quantity", "x")], "label_a string, label_b string, relation string")
    got = {(r["label_a"], r["label_b"]): r["relation"] for r in K.relation_matrix(labels, model).collect()}
    assert len(got) == 12
    assert got["emission_source", "greenhouse_gas"] == "EMITS"
    assert got["greenhouse_gas", "quantity"] == got["other", "quantity"] == "NONE"
    assert got["other", "greenhouse_gas"] == "ACTS_ON"


def test_two_hops_and_triples(spark):
    edges = spark.createDataFrame([("1", "a", "x", "R1", "b", "x"), ("2", "b", "x", "R2", "c", "x"), ("3", "a", "x", "R3", "a", "x")], "eid string, subject string, subject_label string, relation string, object string, object_label string")
    q = spark.createDataFrame([(1, "a", ["a"])], "question_id long, phrase string, keywords array<string>")
    paths = K.two_hop(q, edges)
    assert {(r["relationship"], r["second_relationship"]) for r in paths.collect()} == {("R1", "R2"), ("R3", "R1")}
    assert {(r["subject"], r["relation"], r["object"]) for r in K.shown_triples(paths).collect()} == {("a", "R1", "b"), ("b", "R2", "c"), ("a", "R3", "a")}
    both = [(r["entity"], r["relationship"]) for r in K.undirected(q, edges).collect()]
    assert sorted(both) == [("a", "R1"), ("a", "R3"), ("b", "R1")]


def test_fusion(spark):
    q = spark.createDataFrame([(1, "zz")], "question_id long, question string")
    kg = spark.createDataFrame([(1, "entity", 0, "x", "x"), (1, "entity", 1, "y", "y")], "question_id long, kind string, idx int, shown string, body string")
    texts = spark.createDataFrame([], "question_id long, idx int, text string, score double, rerank_score double")
    rows = R.fused(R.candidates(q, kg, texts), least=0.0).orderBy("rank").collect()
    assert [(r["score_raw"], r["score_norm"], r["combined_score"]) for r in rows] == [(1.0, 1.0, 0.4), (0.5, 0.0, 0.0)]
    assert R.extractive_answers(q, R.fused(R.candidates(q, kg, texts))).first()["answer"] == R.WEAK
    assert R.needs_more(q, R.fused(R.candidates(q, kg, texts)).limit(0)).first()["refetch"]


def test_vector_top_k_is_exact(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(300, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([("a", x[0].tolist()), ("b", [0.0] * 8)], "query_id string, query array<double>")
    got = R.vector_top_k(rows, q, 7).collect()
    for name, y in (("a", x[0]), ("b", np.zeros(8))):
        order = np.argsort(((x - y) ** 2).sum(axis=1))[:7]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == name] == order.tolist()


def test_rates_and_agreement(spark):
    rows = spark.createDataFrame([("correct", "correct"), ("hallucinated", "correct"), ("partial", "hallucinated")], "tag string, b_tag string")
    r = E.rates(rows).first()
    assert (r["correct"], r["total"], r["hallucinated_pct"]) == (1, 3, 33.3)
    got = {r["kind"]: (r["n"], r["pct"]) for r in E.agreement(rows, "tag", "b_tag").collect()}
    assert got["both_correct"] == (1, 33.3) and got["b_only"] == (1, 33.3) and got["any_disagreement"] == (2, 66.7)
    assert E.rates(rows.limit(0)).first()["correct_pct"] is None


def test_json_sources(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"id": 1, "q": "a"}, {"id": 2}]))
    (tmp_path / "chunks.json").write_text(json.dumps({"metadata": {"n": 1}, "chunks": [{"id": 3}]}))
    (tmp_path / "labels.json").write_text(json.dumps({"canonical_labels": []}))
    assert files.read_records(spark, str(tmp_path / "list.json"), "id long, q string").count() == 2
    with pytest.raises(ValueError, match="list"):
        files.read_records(spark, str(tmp_path / "chunks.json"), "id long")
    for name, expected in (("list.json", [1, 2]), ("chunks.json", [3])):
        assert [r["id"] for r in files.read_list_or_object(spark, str(tmp_path / name), "struct<id:long>").collect()] == expected
    with pytest.raises(ValueError, match="labels"):
        files.read_labels(spark, str(tmp_path / "labels.json"))


def test_documents_cache_and_sinks(spark, tmp_path):
    folder = tmp_path / "pdf"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"x" * 200)
    (folder / "b.pdf").write_bytes(b"short")
    (folder / "c.pdf").write_bytes(b"broken")

    def pages(data):
        if data == b"broken":
            raise ValueError("no pages")
        return [data.decode()]

    docs = files.read_documents(spark, str(folder), pages=pages)
    assert {r["filename"]: r["extraction_status"] for r in docs.collect()} == {"a.pdf": "success", "b.pdf": "warning", "c.pdf": "error"}
    assert files.usable(docs).count() == 2
    assert files.load_or_build(spark, str(tmp_path / "matrix"), lambda: spark.range(2)).count() == 2
    assert files.load_or_build(spark, str(tmp_path / "matrix"), lambda: spark.range(9)).count() == 2
    files.write_records(spark.range(2), str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    assert files.preflight(spark, [str(tmp_path), str(tmp_path / "none")], {str(tmp_path): 1}) == [f"missing: {tmp_path / 'none'}"]
    assert files.write_with_fallback(spark.range(1), str(tmp_path / "out"), str(tmp_path / "alt")).endswith("out")


def test_generate_survives_errors(spark):
    def client():
        def ask(prompts):
            if "bad" in prompts:
                raise RuntimeError("quota")
            return [p.upper() for p in prompts]

        return ask

    rows = spark.createDataFrame([("a",), ("bad",)], "prompt string")
    got = {r["prompt"]: (r["answer"], r["error"]) for r in files.generate(rows, client, batch=1).collect()}
    assert got == {"a": ("A", None), "bad": (None, "quota")}


def test_stream_stores_each_file_once(spark, tmp_path):
    text = "Methane and carbon emission causes warming of 2 % a century and affects the ecosystem ."
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(source)
    for _ in range(2):
        ingest.stored_paragraphs(ingest.stream_documents(spark, source), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter(F.col("score") >= 50).count() == 1


def test_an_index_builds_changed_files_alone(spark, tmp_path):
    folder, cache, parsed = tmp_path / "files", str(tmp_path / "cache"), []
    folder.mkdir()
    for k in range(10):
        (folder / f"{k}.txt").write_text(f"text {k}")

    def build(some):
        parsed.append(sorted(r["path"].rsplit("/", 1)[1] for r in some.collect()))
        texts = spark.read.text(str(folder), wholetext=True).withColumn("path", F.col("_metadata.file_path"))
        return some.select("path").join(texts, "path").select("path", F.col("value").alias("text"))

    index = lambda model="m": {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.cached_index(spark, str(folder), model, cache, build).collect()}
    first = index()
    assert len(first) == 10 and index() == first and len(parsed) == 1
    (folder / "3.txt").write_text("a new text")
    assert index() == first | {"3.txt": "a new text"} and parsed[1:] == [["3.txt"]]
    (folder / "4.txt").unlink()
    (folder / "x.txt").write_text("one more")
    assert set(index()) == set(first) - {"4.txt"} | {"x.txt"} and parsed[2:] == [["x.txt"]]
    (folder / "5.txt").unlink()
    assert "5.txt" not in index() and parsed[3:] == [[]]
    assert len(index("other")) == 9 and len(parsed[-1]) == 9
    # A version without its marks does not count.
    newest = sorted(p.name for p in (tmp_path / "cache").iterdir())[-1]
    (tmp_path / "cache" / newest / "index" / "_SUCCESS").unlink()
    assert len(index("other")) == 9 and len(parsed[-1]) == 9
    assert files.cached_index(spark, str(folder), "m", str(tmp_path / "none"), lambda some: some.select("path"), "*.none").count() == 0


def test_small_lookups_and_labels(spark):
    entities = spark.createDataFrame([(3, "c", "A"), (1, "a", "A"), (2, "b", "B")], "seq long, text string, canonical_label string")
    assert [r["seq"] for r in K.by_label(entities, "A", 1).collect()] == [1] and K.by_label(entities, "Z").count() == 0
    edges = spark.createDataFrame([("e2", "R"), ("e1", "R"), ("e3", "S")], "eid string, relation string")
    assert [r["eid"] for r in K.by_relation(edges, "R", 5).collect()] == ["e1", "e2"]
    assert [(r["canonical_label"], r["n"]) for r in K.frequent(entities, 2).collect()] == [("A", 2)] and K.frequent(entities, 1, 1).count() == 1
    chunks = spark.createDataFrame([(1, ["a", "b", "a", "z"]), (2, None), (3, []), (4, ["b"])], "chunk_id int, labels array<string>")
    assert [tuple(r) for r in K.labels_of(chunks).orderBy("chunk_id", "place").collect()] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (4, 0, "b")]
    assert K.label_run(chunks).first().asDict() == {"chunks": 4, "errors": 1, "labels": 4, "per_chunk": 1.0, "unique": 2}
    assert K.label_run(chunks.limit(0)).first().asDict() == {"chunks": 0, "errors": 0, "labels": 0, "per_chunk": None, "unique": 0}


def test_tables_of_configurations(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "a"))
    paths = {"one": str(tmp_path / "a"), "two": str(tmp_path / "none")}
    with pytest.warns(UserWarning, match="two"):
        got = E.union_of_files(paths, spark.read.parquet, lambda p: files.exists(spark, p))
    assert {(r["id"], r["model_config"]) for r in got.collect()} == {(0, "one"), (1, "one")}
    rows = spark.createDataFrame([("factual",), ("Factual",), (None,), ("Explanatory",)], "type string")
    assert E.of_type(rows, "factual").count() == 1 and E.of_type(rows, "factual", folded=True).count() == 2 and E.of_type(rows, "explanatory", folded=True).count() == 1


def test_empty_questions_have_empty_results(spark):
    questions = spark.createDataFrame([(1, " coal? "), (2, "  "), (3, None), (4, "ice")], "question_id int, question string")
    found = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "never")], "question_id int, rank int, text string")
    triples = spark.createDataFrame([(1, 1, "s", "r", "o")], "question_id int, rank int, subject string, relation string, object string")
    got = {r["question_id"]: r for r in R.gathered(questions, found, triples, found).collect()}
    assert got[1]["question"] == "coal?" and got[1]["error"] is None and [e["text"] for e in got[1]["kg_results"]["entities"]] == ["a", "b"]
    assert (got[1]["kg_results"]["num_entities"], got[1]["kg_results"]["num_triples"]) == (2, 1) and [c["text"] for c in got[1]["text_results"]] == ["a", "b"]
    for k, error in ((2, True), (3, True), (4, False)):
        assert (got[k]["error"] is not None) == error and got[k]["kg_results"]["entities"] == [] and got[k]["text_results"] == [] and got[k]["kg_results"]["num_triples"] == 0
    alias = spark.createDataFrame([("qwen",), ("org/x",), ("what",), (None,)], "a string").select(R.resolved(F.col("a"), {"qwen": "Q/7b"}, "d/d").alias("m"))
    assert [r["m"] for r in alias.collect()] == ["Q/7b", "org/x", "d/d", "d/d"]
