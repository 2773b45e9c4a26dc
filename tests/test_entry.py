import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"
CHECKED = ["clean_paragraphs", "filter_stats", "word_chunks", "entity_dedup", "triples", "kg_lookup_2hop", "kg_cascade", "vector_topk", "score_fusion", "agreement_matrix"]


def test_registry():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and len(known) > 70


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    rows = entry.queries()[name](spark, FOLDER)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    told = con.sql(entry.oracle_sql()[name])
    names = sorted(rows.columns)
    assert names == sorted(told.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    a = sorted((tuple(plain(r[c]) for c in names) for r in rows.collect()), key=repr)
    place = [told.columns.index(c) for c in names]
    b = sorted((tuple(plain(r[i]) for i in place) for r in told.fetchall()), key=repr)
    assert a == b
