import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundwork.functions import metrics as M
from groundwork.functions import text as T
from groundwork.operators import chunking, paragraphs


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "text", "expected"),
    [
        (T.printable, "a\x00b\tc\n​d e f", "ab\tc\nde f"),
        (T.join_hyphenated, "exam-\n  ple and é-\nté", "example and été"),
        (T.normal_space, "a\tb   c \n\n\n\n d ", "a b c\n\nd"),
        (T.normal_space, "a\n \n \n \nb", "a\n\n\n\nb"),
        (T.without_page_numbers, "x\n 12 - 3 \nPage  4\npage x\n", "x\npage x\n"),
        (T.without_contacts, "a@b.c d\nsee http://x\nDOI:1\nkept", "kept"),
        (T.without_contents, "Short line here\n\none two three four five\nfive words and then..... 7\nTable 1 a b c d e\nList of a b c d e", "one two three four five"),
        (T.paragraphs, "a\n \nb\nC d\n\n\n", ["a", "b", "C d"]),
        (T.word_count, " a  b c\n", 3),
        (T.citations, "(Smith et al., 2020) (Jones, 1999) [3] [x] (lower, 2000)", 3),
        (T.has_quantity, "rose 1.5 °c", True),
        (T.has_quantity, "rose 15 degrees", False),
        (T.dedup_key, "  CO2 \n Rise ", "co2 rise"),
        (T.label, "Climate Policy-2!", "climate_policy_2"),
        (T.from_first_capital, "of the end. The rest", "The rest"),
        (T.from_first_capital, "The rest", "The rest"),
        (T.keywords, "What causes the Greenhouse-effect?", ["causes", "greenhouseeffect"]),
        (T.tokens, "CO2-Rise, été", ["co2", "rise", "t"]),
        (T.relation, " caused-by x", "CAUSED_BY_X"),
        (T.relation, " ", "NONE"),
        (T.complete, 'He said "so."  ', True),
        (T.complete, "He said", False),
        (T.to_sentence_end, "One. Two three", "One."),
        (T.to_sentence_end, "one two three four five six seven, eight", "one two three four five six seven."),
        (T.to_sentence_end, "short words", "short words."),
        (T.cited, "[TEXT:2] a [KG:x] b [TEXT:2]", ["TEXT:2", "KG:x"]),
        (T.postprocessed, "Answer: It is so [TEXT:1]. It is so. Do not make up information. More [KG:co2].", "It is so. More.\nSources: TEXT:1, KG:co2"),
        (T.sanitized, "Answer: Rewritten answer - Use proper grammar and spelling. Yes. Write a response now", "Yes."),
        (T.without_log, "Loading schema\n yes \n\nso", "yes so"),
        (T.without_log, "Sadly, No information found here", "No information found in the knowledge graph."),
        (T.without_filler, "Based on the knowledge graph, it is.", "It is."),
        (T.without_filler, "I don't know that", "No information found in the knowledge graph."),
        (T.after, "Answer: a Answer: b ", "b"),
        (T.fallback_labels, "a_b x c_d_e f_1 g_h", ["a_b", "c_d_e", "f_1"]),
        (T.human_bytes, None, None),
    ],
)
def test_functions(spark, f, text, expected):
    if text is None:
        assert spark.range(1).select(T.human_bytes(F.lit(1536)).alias("x")).first()["x"] == "1.5 KB"
    else:
        assert one(spark, text, f) == expected


@pytest.mark.parametrize(("text", "expected"), [("12 %", False), ("2015", False), ("CO", False), ("12 million t", False), ("methane", True)])
def test_meaningful(spark, text, expected):
    assert one(spark, text, T.meaningful) is expected


def test_limited_keeps_the_sentence_that_crosses(spark):
    sentence = lambda n: " ".join(["w"] * (n - 1) + ["end."])
    text = " ".join(sentence(n) for n in (20, 15, 5))
    assert one(spark, text, T.limited) == " ".join(sentence(n) for n in (20, 15))


@pytest.mark.parametrize(("variant", "text", "expected"), [("exact", "Incorrect", "unknown"), ("partial_first", "Incorrect", "correct"), ("correct_first", "Incorrect", "correct"), *[(v, "Partially Correct", "partial") for v in ("exact", "partial_first", "correct_first")]])
def test_tags(spark, variant, text, expected):
    assert one(spark, text, lambda c: T.tag(c, variant)) == expected


def test_json_list_in_fences_or_under_a_key(spark):
    for text, expected in [('```json\n[{"a": "1"}]\n```', ["1"]), ('{"entities": [{"a": "2"}]}', ["2"]), ("nonsense", None)]:
        got = one(spark, text, lambda c: T.json_list(c, "struct<a:string>"))
        assert (None if got is None else [r["a"] for r in got]) == expected


def test_lexical(spark):
    df = spark.createDataFrame([("co2 rise", "CO2 levels"), ("", "x")], "q string, t string")
    assert [r[0] for r in df.select(T.lexical(F.col("q"), F.col("t"))).collect()] == [0.5, 0.0]


def test_scores(spark):
    good = "Methane and carbon emission causes warming of 2 % a century and affects the ecosystem ."
    bad = "this chapter is organized as follows"
    rows = spark.createDataFrame([(good,), (bad,)], "text string")
    a, b = paragraphs.scored(rows).collect()
    assert a["score"] == 100 and a["word_count"] == 16
    assert a["breakdown"] == {"base": 50, "climate_keywords": 30, "causal_language": 15, "quantitative_data": 15, "impact_language": 10, "proper_length": 5}
    assert b["score"] == 20 and b["breakdown"] == {"base": 50, "meta_organizational": -20, "wrong_length": -10}


def test_filter_keeps_empty_documents(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_paragraphs"], r["retention"]) for r in paragraphs.filtered(df).collect()} == {1: (0, 0.0), 2: (0, 0.0)}


def test_word_windows_keep_the_tail(spark):
    df = spark.createDataFrame([("a b c d e f g",), ("",), (None,)], "text string")
    assert [r["text"] for r in chunking.word_windows(df, 4, 1).orderBy("idx").collect()] == ["a b c d", "d e f g", "g"]


@given(st.text(alphabet="aB .!?\n", max_size=900))
@settings(max_examples=60, deadline=None)
def test_sentence_chunks_hold_their_bounds(text):
    spans = list(chunking.SentenceChunker(120, 20, 30).spans(text))
    assert all(b - a <= 120 and len(text[a:b].strip()) >= 30 for a, b in spans)
    assert all(x[0] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_sentence_chunks_are_numbered(spark):
    text = " ".join(["This is a sentence of some words."] * 40)
    rows = chunking.sentence_chunks(spark.createDataFrame([(7, text), (8, None), (9, "short")], "doc_id long, text string")).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == [f"7_{i:03d}" for i in range(len(rows))]
    assert all(r["text"] == text[r["char_start"] : r["char_end"]].strip() and r["text"].startswith("This") for r in rows)


def test_sentence_chunks_come_in_bounded_batches():
    """A worker holds neither all chunks of a batch nor all those of one text."""
    texts = ["Some words make a sentence here. " * 40] * 3000 + [None, "", "One long text has very many chunks. " * 60_000]
    chunker = chunking.SentenceChunker(500, 50, 100)
    some = pa.RecordBatch.from_pydict({"source": [str(k) for k in range(len(texts))], "text": texts})
    got = list(chunking._chunked(iter([some, some.slice(0, 0), some.slice(5, 1)]), chunker))
    assert all(b.num_rows <= 1000 and b.nbytes < 1_500_000 for b in got)
    rows = [(r["source_file"], r["char_start"], r["char_end"]) for b in got for r in b.to_pylist()]
    assert rows == [(str(k), *x) for k, t in [*enumerate(texts), (5, texts[5])] for x in chunker.spans(t or "")]


def test_metrics():
    assert M.rouge_l_of("the cat sat", "the cat sat") == 1
    assert M.rouge_l_of("the cat sat on the mat", "the cat lay on a mat") == pytest.approx(4 / 6)
    assert M.rouge_l_of("", "a") == 0
    assert [M.stemmer(w) for w in ("caresses", "ponies", "relational", "hopping", "falling", "happy", "controlling", "rate")] == ["caress", "poni", "relat", "hop", "fall", "happi", "control", "rate"]
    assert M.meteor_of("a b c", "a b c") == pytest.approx(1 - 0.5 / 27)
    assert M.meteor_of("running fast", "runs fast") > 0.8
    assert M.meteor_of("a", "b") == 0


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_lcs_against_the_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert M.lcs(a, b) == table[-1][-1]
