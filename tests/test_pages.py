import json

import pytest
from pyspark.sql import functions as F

from lexmill import cli
from lexmill.errors import PdfSupportError
from lexmill.operators import chunks, pages, trace
from lexmill.sources import files
from lexmill.streaming import batches


@pytest.fixture
def book(spark):
    return lambda *raw: spark.createDataFrame([(1, i, r) for i, r in enumerate(raw, 1)], "doc_id long, page_number int, raw string")


def test_rulebook_pages(book):
    """A page of contents goes, the regulator's mail line too; numerals go and letters join the headings after them."""
    mail = "desk@port.example | Harbour Board\n"
    contents = mail + "Contents\nII.\nPart II - Berths and moorings .......... 4\nC.\nAllocation of berths .......... 5\n"
    body = mail + "Preface\nThe Board keeps these terms.\nII.\nPart II - Berths and moorings\nC.\nAllocation of berths\nA berth goes to the first vessel that asks.\nD.\nDues and deposits\nDues are paid before a vessel leaves.\n"
    found = chunks.chunks(pages.document_text(book(contents, body), "ae"), "ae", "primary_legislation").orderBy("order").collect()
    assert [c.section_title for c in found] == ["Document", "Part II. Berths and moorings", "Section C. Allocation of berths", "Section D. Dues and deposits"]


def test_page_states(book):
    """Lines are decided on after merging; a heading or a list item opens the body, contents close it."""
    raw = "Some words first\n1) an item of a list\nmore words here\nList of berths .......... 7\nand words again"
    told = trace.page_events(book(raw, "A.\nGeneral terms\nIV.\nPart IV Delivery\nbody of it"), "generic").where("type = 'pdf_line_decided'").orderBy("position")
    found = [(r.position >> 32, r.data["text"], r.data["state_from"], r.data["state_to"]) for r in told.collect()]
    assert found == [
        (1, "Some words first", "front_matter", "front_matter"), (1, "1) an item of a list", "front_matter", "body"), (1, "more words here", "body", "body"), (1, "and words again", "body", "body"),
        (2, "A. General terms", "front_matter", "front_matter"), (2, "Part IV Delivery", "front_matter", "body"), (2, "body of it", "body", "body"),
    ]


def test_repeated_lines_go(book):
    found = pages.clean_pages(book(*(f"Official Gazette\nText of page number {n}\ncontinued here.\n{n}" for n in "123"))).orderBy("page_number").collect()
    assert [p.text for p in found] == [f"Text of page number {n}" for n in "123"]
    assert pages.clean_pages(book("", None, "  ")).collect() == []


def test_wrapped_lines(book):
    raw = "Body text that is bro-\nken up and\ngoes on.\nNew sentence\n- item one\nfree text"
    assert pages.clean_pages(book(raw)).head().text == "Body text that is broken up and goes on.\nNew sentence\n- item one\nfree text"


def test_federal_rules(book):
    start = "RULES OF CIVIL PROCEDURE\nFOR THE\nUNITED STATES DISTRICT COURTS\nRule 1. Scope and Purpose\nThese rules govern."
    found = pages.clean_pages(book("Foreword of the book.", "12\nfree words\n" + start), "us").collect()
    assert [p.page_number for p in found] == [2] and found[0].text.startswith("RULES OF CIVIL PROCEDURE")


def test_fingerprints(spark):
    lines = [["v سُلطة تنظيم", "1"], ["x سلطة تنظيم", "2"], ["z سلطة تنظيم", "3"]]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, page_number int, lines array<string>")
    assert [r.fingerprint for r in pages.repeated_fingerprints(df).collect()] == ["سلطة تنظيم"]


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["chunk", "--text", "Article 1. One\nbody"], spark) == 0
    assert json.loads(capsys.readouterr().out)["chunks"][0]["section_title"] == "Article 1. One"
    path = tmp_path / "law.txt"
    path.write_text("Article 1. One\nbody\nArticle 2. Two\nbody", encoding="utf-8")
    out = tmp_path / "new" / "out.txt"
    assert cli.main(["review", "--path", str(path), "--limit", "1", "--output", str(out)], spark) == 0
    assert "Source: law.txt" in out.read_text() and "... 2 more sections" in out.read_text() and capsys.readouterr().out == ""
    cli.main(["structure", "--path", str(path)], spark)
    assert len(json.loads(capsys.readouterr().out)["sections"]) == 3
    cli.main(["explain", "--text", "x"], spark)
    assert json.loads(capsys.readouterr().out)["trace"]["events"]


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a law.txt").write_text("Article 1. One\nbody", encoding="utf-8")
    read = files.text_files(spark, str(tmp_path / "in"))
    assert [r.source_name for r in read.collect()] == ["a law.txt"]
    with pytest.raises(PdfSupportError):
        files.pdf_pages(spark, str(tmp_path))
    files.write_parquet(chunks.chunks(read), str(tmp_path / "chunks"), ["chunk_method"])
    files.write_json(chunks.chunks(read), str(tmp_path / "json"))
    read.write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(read.schema).parquet(str(tmp_path / "docs"))
    batches.process(stream, chunks.chunks, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(str(tmp_path / "chunks")).count() == 1


def test_header_fingerprints_of_all_alphabets(spark):
    lines = ["", "A.", "1234", "12345", "Title Page", "x yz", "A ﻻ قانون", "Ｆｕｌｌ width", "é", "Закон О"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", pages.header_fingerprint(F.col("line")).alias("own")).collect()
    assert {r["line"]: r["own"] for r in rows} == {x: pages.fingerprint(x) for x in lines}
