"""Written patterns against a plain walk over the edges."""

import itertools

import pytest

from groundwork.operators import knowledge, patterns

EDGES = [
    ("e1", "Coal plant", "EMITS", "CO2"), ("e2", "CO2", "CAUSES", "Warming"), ("e3", "Solar farm", "REDUCES", "CO2"), ("e4", "ice", "MELTS", "ice"), ("e5", "Warming", "MELTS", "ice"),
    ("e6", "coal mine", "EMITS", "Methane"), ("e7", "Methane", "CAUSES", "Warming"), ("e8", "it's, AND or", "CAUSES", "Warming"), ("e9", "CO2", "CAUSES", "Acid"), ("e10", None, "CAUSES", "x"),
]
SHOW = "RETURN a.name AS entity, type(r) AS relationship, b.name AS related_entity"
TWO = "MATCH (a:Entity)-[r:CAUSES]->(b:Entity)-[s]->(c:Entity)"


def has(text):
    return lambda x: x is not None and text in x.lower()


#: pattern; then what it asks in plain words: hops, directed, relations, condition over (a, b, c), order, columns, limit
ONE_ = dict(hops=1, directed=True, first=None, second=None, keep=lambda a, b, c: True, by=None, down=False, show={"entity": 0, "relationship": 1, "related_entity": 2}, most=10)
CASES = [
    (f"MATCH (a)-[r:EMITS]->(b) {SHOW} LIMIT 10", ONE_ | dict(first="EMITS")),
    (f"match (a:Entity) -[ r ]-> (b) where toLower(a.name) contains 'coal' {SHOW} limit 10;", ONE_ | dict(keep=lambda a, b, c: has("coal")(a))),
    (f"MATCH (a)-[r]->(b) WHERE a.name CONTAINS 'coal' {SHOW} LIMIT 10", ONE_ | dict(keep=lambda a, b, c: a is not None and "coal" in a)),
    (f"MATCH (a)-[r]->(b) WHERE b.name = \"CO2\" {SHOW} LIMIT 10", ONE_ | dict(keep=lambda a, b, c: b == "CO2")),
    (f"MATCH (a)-[r]->(b) WHERE toLower(b.name) CONTAINS toLower('WARM') OR toLower(a.name) = 'coal mine' {SHOW} LIMIT 10", ONE_ | dict(keep=lambda a, b, c: has("warm")(b) or (a or "").lower() == "coal mine")),
    (f"MATCH (a)-[r]->(b) WHERE toLower(b.name) CONTAINS 'warm' AND a.name CONTAINS 'CO' {SHOW} LIMIT 10", ONE_ | dict(keep=lambda a, b, c: has("warm")(b) and a is not None and "CO" in a)),
    (f"MATCH (a)-[r]-(b) WHERE a.name = 'CO2' {SHOW} LIMIT 10", ONE_ | dict(directed=False, keep=lambda a, b, c: a == "CO2")),
    (f"MATCH (a)-[r:MELTS]-(b) {SHOW} LIMIT 10", ONE_ | dict(directed=False, first="MELTS")),
    (f"MATCH (a)-[r]->(b) {SHOW} ORDER BY b.name DESC LIMIT 4", ONE_ | dict(by=2, down=True, most=4)),
    (f"MATCH (a)-[r]->(b) WHERE a.name = \"it's, AND or\" {SHOW} LIMIT 3", ONE_ | dict(keep=lambda a, b, c: a == "it's, AND or", most=3)),
    (f"MATCH (a)-[r]->(b) WHERE toLower(a.name) CONTAINS '' {SHOW} LIMIT 20", ONE_ | dict(keep=lambda a, b, c: a is not None, most=20)),
    (f"{TWO} WHERE toLower(a.name) CONTAINS 'co' RETURN a.name, s AS via, c.name AS last LIMIT 10", ONE_ | dict(hops=2, first="CAUSES", keep=lambda a, b, c: has("co")(a), show={"a.name": 0, "via": 3, "last": 4})),
    (f"{TWO} WHERE c.name = 'ice' RETURN a.name AS x, c.name AS z ORDER BY a.name LIMIT 2", ONE_ | dict(hops=2, first="CAUSES", keep=lambda a, b, c: c == "ice", by=0, show={"x": 0, "z": 4}, most=2)),
    ("MATCH (a)-[r]->(b)-[s:MELTS]->(c) RETURN b.name AS m LIMIT 50", ONE_ | dict(hops=2, second="MELTS", show={"m": 2}, most=50)),
]
BAD = [
    None, "", "RETURN 1", "MATCH (a) RETURN a LIMIT 5", f"MATCH (a)-[r]->(b) {SHOW}", f"MATCH (a)-[r]->(b) WHERE a.name > 'x' {SHOW} LIMIT 5", f"MATCH (a)-[r]->(b) WHERE q.name = 'x' {SHOW} LIMIT 5", "MATCH (a)-[r]->(b) RETURN q.name LIMIT 5",
    f"MATCH (a)-[r]->(b) WHERE a.name = 'x' AND b.name = 'y' OR a.name = 'z' {SHOW} LIMIT 5", f"MATCH (a)-[r]->(b) {SHOW} ORDER BY q.name LIMIT 5", "MATCH (a)-[r]->(b) RETURN count(a) LIMIT 5", "MATCH (a)-[r]->(b) DELETE r RETURN a.name LIMIT 5", "MATCH (a)-[r]-(b)-[s]->(c) RETURN a.name LIMIT 5",
    "MATCH (a)-[r]->(b) RETURN a.name AS x, b.name AS x LIMIT 5", f"MATCH (a)-[r]->(b) WHERE {SHOW} LIMIT 5",
]


def plain(case):
    sides = [(e, s, r, o, False) for e, s, r, o in EDGES] + ([] if case["directed"] else [(e, o, r, s, True) for e, s, r, o in EDGES if s is not None and s != o])
    rows = []
    for e, s, r, o, back in sides:
        if case["first"] in (None, r):
            ends = [(None, None, None)] if case["hops"] == 1 else [(e2, r2, o2) for e2, s2, r2, o2 in EDGES if s2 == o and e2 != e and case["second"] in (None, r2)]
            rows += [((s, r, o, r2, o2), (s or "", r, o, e, r2 or "", o2 or "", e2 or "", back), s is None) for e2, r2, o2 in ends if case["keep"](s, o, o2)]
    rows.sort(key=lambda x: (not x[2], x[1]))
    if case["by"] is not None:
        rows.sort(key=lambda x: x[0][case["by"]] or "", reverse=case["down"])
        rows.sort(key=lambda x: x[0][case["by"]] is None)
    return [(n, {k: x[0][p] for k, p in case["show"].items()}) for n, x in enumerate(rows[: case["most"]], 1)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "eid string, subject string, relation string, object string")


def test_patterns_equal_a_plain_walk(spark, edges):
    texts = [p for p, _ in CASES] + BAD
    asked = spark.createDataFrame(list(enumerate(texts)), "pattern_id long, pattern string")
    got = {}
    for r in patterns.results(asked, edges).orderBy("pattern_id", "rank").collect():
        got.setdefault(r["pattern_id"], []).append((r["rank"], r["row"]))
    for k, (text, case) in enumerate(CASES):
        # Rows that the order does not tell apart may only differ in what is not shown.
        assert got.get(k, []) == plain(case), text
    assert set(got) <= set(range(len(CASES))), [texts[k] for k in got if k >= len(CASES)]


def test_results_of_patterns_lead_the_cascade(spark, edges):
    asked = spark.createDataFrame([(1, "nothing", ["coal"]), (2, "methane", ["methane"])], "question_id long, phrase string, keywords array<string>")
    told = spark.createDataFrame([(1, f"MATCH (a)-[r:EMITS]->(b) WHERE toLower(a.name) CONTAINS 'coal' {SHOW} LIMIT 1"), (2, "nonsense")], "pattern_id long, pattern string")
    got = sorted(map(tuple, knowledge.cascade(asked, edges, written=patterns.written(patterns.results(told, edges))).collect()))
    assert got == [(1, -1, "Coal plant", "EMITS", "CO2", 1), (2, 0, "Methane", "CAUSES", "Warming", 1)]


def test_no_patterns_and_no_edges(spark, edges):
    none = spark.createDataFrame([], "pattern_id long, pattern string")
    some = spark.createDataFrame([(1, CASES[0][0])], "pattern_id long, pattern string")
    assert patterns.results(none, edges).collect() == [] and patterns.results(some, edges.limit(0)).collect() == []
    assert len(list(itertools.chain(CASES, BAD))) == len(CASES) + len(BAD)
