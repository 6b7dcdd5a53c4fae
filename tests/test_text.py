import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions import rx, text
from lexmill.functions.headings import detect_heading


def test_extracted_text_keeps_paragraphs(one):
    raw = "a\r\nb  -  c d­‑e\x0c\n\n\n\n  f \t g\n"
    assert one(text.normalize_extracted(F.lit(raw))) == "a\nb-c d-e\n\nf g"
    assert one(text.normalize_extracted(F.lit(None).cast("string"))) == ""


def test_chunk_text_and_hashes(one):
    assert one(text.normalize_chunk(F.lit(" a \n b c "))) == "a b c"
    assert one(text.semantic_hash(F.lit("a  b"))) == one(text.semantic_hash(F.lit(" a b ")))
    assert one(text.identity_hash(F.lit("a"), "ru")) != one(text.identity_hash(F.lit("a"), "us"))


def test_numbers(one):
    assert one(text.normalize_numeric_scripts(F.lit("171² and 10₄"))) == "171.2 and 104"
    for raw, fixed in ((" 159¹ ", "159.1"), ("229_5", "229.5"), ("229(5)", "229.5"), ("229-5", "229.5"), ("1(5)", "1(5)"), ("", None), (None, None)):
        assert one(text.normalize_article_number(F.lit(raw).cast("string"))) == fixed
    assert one(text.extract_number(F.lit("п. 3.2.1"))) == "3.2"


def test_preview(one):
    assert one(text.preview(F.lit(" abc   defg"), 5)) == "abc…"
    assert one(text.preview(F.lit("abc"), 5)) == "abc"


def test_guidance_text(one):
    raw = "Первая строка 7.\nТекст пункта\n\n\n12\n1 Далее — закон\nконец"
    assert one(text.normalize_guidance(F.lit(raw))) == "Первая строка\n7. Текст пункта\n\nконец"


def test_spans_count_characters(one):
    found = one(rx.spans(F.lit("ab12😀c3"), r"\d+"))
    assert [tuple(m) for m in found] == [(2, 4, "12"), (6, 7, "3")]
    assert one(rx.replaced(F.lit("a1b22"), r"\d+", lambda m: F.concat(F.lit("<"), m["text"], F.lit(">")))) == "a<1>b<22>"


HEADINGS = [
    ("Статья 12. Порядок рассмотрения", "ru", "default", ("article", "Article 12. Порядок рассмотрения", "12", None)),
    ("1.2 Scope and purpose", "generic", "default", ("article", "Section 1.2. Scope and purpose", "1.2", None)),
    ("1. Scope and purpose", "generic", "default", ("section", "Section 1. Scope and purpose", None, None)),
    ("1.2.3 Scope and purpose", "generic", "default", ("clause", "Section 1.2.3. Scope and purpose", None, "1.2.3")),
    ("IV General provisions", "generic", "default", ("section", "Section IV. General provisions", None, None)),
    ("Статья 1, 2. Общие положения", "ru", "default", ("article", "Article 1, 2. Общие положения", "1, 2", None)),
    ("Пункты 1, 2. Общие правила", "ru", "default", ("clause", "Clause 1, 2. Общие правила", None, "1, 2")),
    ("Schedule A. Definitions", "generic", "default", ("other", "Schedule A. Definitions", None, None)),
    ("Schedule No. 1 Definitions", "generic", "default", ("other", "Schedule 1. Definitions", None, None)),
    ("I. Part I-Compliance Management", "ae", "default", ("part", "Part I. Compliance Management", None, None)),
    ("A. General principles", "ae", "statute", ("section", "Section A. General principles", None, None)),
    ("B.-Scope", "ae", "statute", ("section", "Section B. Scope", None, None)),
    ("Article\u00a05", "generic", "default", ("article", "Article 5", "5", None)),
    ("Rule 4. Summons", "us", "statute", ("article", "Rule 4. Summons", "4", None)),
    ("Exhibits", "generic", "default", ("other", "Schedule s", None, None)),
    ("Article 5", "generic", "default", ("article", "Article 5", "5", None)),
    ("1 this line should stay body text", "generic", "default", None),
    ("2024 Revenue increased across the portfolio", "generic", "default", None),
    ("Article 5. Review standard", "generic", "guidance", None),
    ("1.2 Scope and purpose", "generic", "guidance", None),
    ("Article 263 TFEU", "eu", "default", None),
    ("J. SMITH", "eu", "default", None),
    ("mix foo", "generic", "default", None),
    ("1.", "generic", "default", None),
    ("", "generic", "default", None),
]


@pytest.mark.parametrize("line, profile, policy, wanted", HEADINGS)
def test_headings(one, line, profile, policy, wanted):
    found = one(detect_heading(F.lit(line), profile, policy))
    assert (tuple(found) if found else None) == wanted


def test_ends_of_texts_and_lines(spark):
    """trimmed() is strip(); lines lose white space at their ends wherever it stands."""
    texts = ["", " ", "a", " a", "a ", "　é\x85", "é a", "a é ", "\n", "a \n b\n\x0b\nc", " a\t\n", "a\n \n \n\nb", "x\n y"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", rx.trimmed(F.col("t")).alias("a"), text.normalize_extracted("t").alias("b")).collect()
    assert {r["t"]: r["a"] for r in rows} == {None: None} | {t: t.strip() for t in texts}
    for r in rows:
        lines = [re.sub(r"[ \t\x0b]+", " ", x).strip() for x in (r["t"] or "").split("\n")]
        assert r["b"] == re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
