"""Documents by pages, from a source that cuts large files."""

from groundwork.sources import paged

PARSER = "tests.paged_fake:LineParser"


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "large.txt").write_text("\n".join(f"page {k}" for k in range(10_000)))
    for k in range(6):
        (tmp_path / f"small{k}.txt").write_text(f"one {k}\ntwo")
    rows = paged.read_pages(spark, str(tmp_path), pattern="*.txt", bytes="20000", parser=PARSER)
    assert rows.rdd.getNumPartitions() >= 5
    got = rows.collect()
    large = sorted((r["page"], r["text"]) for r in got if r["path"].endswith("large.txt"))
    assert large == [(k, f"page {k}") for k in range(10_000)] and {r["pages"] for r in got if r["path"].endswith("large.txt")} == {10_000}
    assert sum(not r["path"].endswith("large.txt") for r in got) == 12
    ranges = {tuple(map(int, p.name.split("-")[1:3])) for p in (tmp_path / "log").iterdir() if p.name.startswith("large")}
    assert len(ranges) >= 5 and sum(b - a for a, b in ranges) == 10_000
    docs = {r["filename"]: r for r in paged.documents_of(rows).collect()}
    assert docs["large.txt"]["total_pages"] == 10_000 and docs["large.txt"]["extracted_text"].startswith("page 0\n\npage 1\n\n") and docs["large.txt"]["extraction_status"] == "success"
    assert docs["small3.txt"]["extracted_text"] == "one 3\n\ntwo" and docs["small3.txt"]["extraction_status"] == "warning"


def test_broken_and_empty_files(spark, tmp_path):
    for name, text in {"a.txt": "broken", "b.txt": "", "c.txt": "fine\ntorn\nlost", "d.other": "never"}.items():
        (tmp_path / name).write_text(text)
    docs = {r["filename"]: r for r in paged.documents_of(paged.read_pages(spark, str(tmp_path), pattern="*.txt", parser=PARSER)).collect()}
    assert set(docs) == {"a.txt", "b.txt", "c.txt"}
    assert docs["a.txt"]["extraction_status"] == "error" and "no pages" in docs["a.txt"]["error_message"] and docs["c.txt"]["extraction_status"] == "error" and docs["c.txt"]["extracted_text"] == ""
    assert (docs["b.txt"]["extraction_status"], docs["b.txt"]["total_pages"], docs["b.txt"]["error_message"]) == ("warning", 0, None)
    assert paged.read_pages(spark, str(tmp_path), pattern="*.none", parser=PARSER).count() == 0


def test_a_stream_takes_new_files_once(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    source.mkdir()
    spark.dataSource.register(paged.PagedDocuments)

    def run():
        rows = spark.readStream.format("paged").option("pattern", "*.txt").option("parser", PARSER).load(str(source))
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r["text"] for r in spark.read.parquet(out).collect())

    (source / "a.txt").write_text("one\ntwo")
    assert run() == ["one", "two"]
    (source / "b.txt").write_text("three")
    assert run() == ["one", "three", "two"] and run() == ["one", "three", "two"]
