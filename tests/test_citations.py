import pytest
from pyspark.sql import functions as F

from lexmill.operators import citations, numbering

REPAIRS = [
    ("пункт 3 1 статьи 3 АПК РФ", "пункт 3.1 статьи 3 АПК РФ"), ("статья 2295 АПК РФ", "статья 229.5 АПК РФ"), ("Статья 229⁵ ГПК РФ", "Статья 229.5 ГПК РФ"), ("Статья 229_5 ГПК РФ", "Статья 229.5 ГПК РФ"),
    ("Статья 229(5) ГПК РФ", "Статья 229.5 ГПК РФ"), ("Статья 229-5 ГПК РФ", "Статья 229.5 ГПК РФ"), ("статья 443[1] ГК РФ", "статья 443 ГК РФ"), ("Условие договора¹", "Условие договора"), ("Комментарий[12]", "Комментарий"),
    ("пункт 1-20 статьи 5 АПК РФ", "пункт 1-20 статьи 5 АПК РФ"), ("пунктов 1–61 статьи 101 НК РФ", "пунктов 1–6.1 статьи 101 НК РФ"), ("100 АПК РФ", "100 АПК РФ"), ("291 АПК РФ", "29.1 АПК РФ"), ("229⁵", "229⁵"),
    ("статьи 10-20 ГК РФ", "статьи 10-20 ГК РФ"), ("глава 100 АПК РФ", "глава 100 АПК РФ"), ("статья 2290 АПК РФ", "статья 2290 АПК РФ"), ("", ""),
]


@pytest.mark.parametrize("raw, fixed", REPAIRS)
def test_repairs(one, raw, fixed):
    assert one(numbering.normalize_legal(F.lit(raw), "ru")) == fixed


def test_contexts(one):
    for raw, family in (("Статья 229⁵ ГПК РФ", "article_like"), ("разд 3 ГК РФ", "section_like"), ("по ГК РФ", "article_like"), ("Условие договора¹", "unknown")):
        assert one(numbering.reference_context(F.lit(raw), "ru")) == family


CITED = [
    ("ru", None, "пункт 3 статьи 450 ГК РФ", [("ru_article", "450", "3", None, "gk_rf")]),
    ("ru", None, "часть 2 пункта 3 статьи 5 ГК РФ", [("ru_article", "5", "3", "2", "gk_rf"), ("ru_article", "5", "3", None, "gk_rf")]),
    ("ru", None, "ст.5 ГК РФ и ст.10 НК РФ", [("ru_article", "5", None, None, "gk_rf"), ("ru_article", "10", None, None, "nk_rf")]),
    ("ru", None, "ГОСТ.5 ГК РФ", []),
    ("us", "usc", "15 U.S.C. § 78j and 17 C.F.R. § 240.10b-5", [("section", "78j", None, None, "usc")]),
    ("us", None, "15 U.S.C. § 78j and 17 C.F.R. § 240.10b-5", [("section", "78j", None, None, "usc"), ("section", "240.10b-5", None, None, "cfr")]),
    ("us", None, "sec.5 CFR", [("section", "5", None, None, "cfr")]),
    ("eu", None, "Recital 10 applies here.", []),
    ("eu", None, "Recital (12) GDPR", [("recital", "12", None, None, "gdpr")]),
    ("eu", None, "art.5 GDPR, art. 5 GDPR", [("article", "5", None, None, "gdpr")]),
    ("ae", None, "Article 5 VARA applies here.", [("article", "5", None, None, "vara")]),
    ("generic", None, "see Article 5 and Section 7.2", [("article", "5", None, None, None), ("section", "7.2", None, None, None)]),
    ("generic", None, None, []),
]


@pytest.mark.parametrize("profile, family, text, wanted", CITED)
def test_references(docs, profile, family, text, wanted):
    found = citations.references(docs(text), profile, family).orderBy("ordinal").collect()
    assert [tuple(r)[3:] for r in found] == wanted


def test_canonical(docs):
    found = citations.canonical_parts(citations.references(docs("пункт 3¹ статьи 171² ГК РФ"), "ru"), "россия").head()
    assert found.canonical == {"jurisdiction": "ru", "scheme": "ru_article", "article_number": "171.2", "doc_family": "gk_rf", "paragraph_number": "3.1"}


def test_family(one):
    assert one(citations.doc_family(F.lit("Under the U.S. Bankruptcy Code and USC"), "us")) == "bankruptcy_code"
    assert one(citations.doc_family(F.lit("nothing"), "us")) is None
