import re

import pytest
from pyspark.sql import functions as F

from lexmill.errors import ConfigError, UnknownProfileError
from lexmill.functions import rx
from lexmill.operators import chunks, guidance, sections, trace
from lexmill.plans import profiles


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("doc_id", "order").select(*columns).collect()]


def test_profiles_and_policies(one):
    assert profiles.resolve("U.A.E.").code == "ae" and profiles.resolve(None).code == "generic"
    with pytest.raises(UnknownProfileError):
        profiles.resolve("mars")
    with pytest.raises(ConfigError):
        profiles.Limits(10, 10)
    assert profiles.chunk_policy("us", "court_guidance") == "default" and profiles.chunk_policy("eu", "court_guidance") == "guidance"
    assert profiles.chunk_policy("us") == "statute" and profiles.chunk_policy("ru", "regulation") == "default"
    assert one(profiles.chunk_policy_column("us", F.lit("procedure_rules"))) == "statute"
    with pytest.raises(Exception, match="unknown profile"):
        one(profiles.profile_code(F.lit("mars")))


def test_sections(docs):
    text = "Part 1. One\nChapter 2. Two\nArticle 1. Same\nbody\n\n\n\nmore\nArticle 1. Same\nPart 2. Three\nArticle 1. Same"
    found = rows(sections.sections(docs("Plain text.", text, "", None), "generic", "statute"), "doc_id", "order", "kind", F.array_join("path", "/"), "text")
    assert found[0] == (0, 0, "document_root", "Document", "Plain text.")
    assert [r[2] for r in found[1:]] == ["document_root", "part", "chapter", "article", "article", "part", "article"]
    assert found[4][3:] == ("Document/Part 1. One/Chapter 2. Two/Article 1. Same", "Article 1. Same\nbody\n\nmore")
    ids = [r[0] for r in sections.sections(docs(text), "generic", "statute").select("section_id").collect()]
    assert len(set(ids)) == 7
    parents = {r.title: r.parent_section_id for r in sections.sections(docs(text), "generic", "statute").collect()}
    assert parents["Document"] is None and parents["Part 2. Three"] is not None


def test_ids_follow_the_formula(docs):
    import hashlib

    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    (c,) = chunks.chunks(docs("Plain  text."), "generic").collect()
    section = "sec-" + digest("<memory>::Document::1")[:12]
    assert c.section_id == section and c.semantic_hash == digest("Plain text.")
    assert c.chunk_id == "chunk-" + digest(f"<memory>:{section}:1:statute_unit:" + digest("generic:Plain text."))[:12]


def test_packing_and_windows(docs):
    paragraphs = "\n\n".join(["a" * 500, "b" * 500, "c" * 500, "d" * 1305, "e"])
    found = rows(chunks.chunks(docs(paragraphs), "generic", "other"), "chunk_method", F.length("text"))
    assert found == [("by_section", 1001), ("by_section", 500), ("char_fallback", 1200), ("char_fallback", 225), ("by_section", 1)]
    assert rows(chunks.chunks(docs(paragraphs), "generic", "case_law"), "chunk_method")[0] == ("case_law_paragraph",)


def test_brute_force_packing(docs):
    import random

    rng = random.Random(5)
    texts = ["\n\n".join("x" * rng.choice([1, 5, 9, 10, 11, 25, 40]) for _ in range(rng.randrange(1, 8))) for _ in range(40)]
    limits = profiles.Limits(10, 3)

    def expected(text):
        out, held = [], None
        for p in text.split("\n\n"):
            if len(p) > 10:
                out += [held] * (held is not None)
                held, start = None, 0
                while True:
                    out.append(p[start : start + 10])
                    if start + 10 >= len(p):
                        break
                    start += 7
            elif held is not None and len(held) + 2 + len(p) <= 10:
                held += "\n\n" + p
            else:
                out += [held] * (held is not None)
                held = p
        return [" ".join(x.split()) for x in out + [held] * (held is not None)]

    found = {}
    for r in chunks.chunks(docs(*texts), "generic", "other", limits).orderBy("doc_id", "order").collect():
        found.setdefault(r.doc_id, []).append(r.text)
    assert [found[i] for i in range(40)] == [expected(t) for t in texts]


def test_review_points(docs):
    review = "Преамбула.\n\n17. Текст. Определение Судебной коллегии Верховного Суда РФ от 12 декабря 2023 г. № 18-КГ23-155-К4.\n18. Второй. № \n19. Нет\nСм. также 20. Определение судебной коллегии"
    found = sections.sections(chunks.normalized(docs(review)), "ru", "guidance", "court_guidance").orderBy("order").collect()
    assert [s.title for s in found] == ["Document", "Point 17", "Point 18"]
    m = found[1].metadata
    assert (m.source_case_number, m.source_case_date, m.source_case_court) == ("18-КГ23-155-К4", "12 декабря 2023 г.", "Верховный Суд РФ")
    plain = "Нет пунктов.\n\nСовсем."
    assert rows(chunks.chunks(docs(plain), "ru", "court_guidance"), "chunk_method", "text") == [("guidance_preamble", "Нет пунктов."), ("guidance_preamble", "Совсем.")]


def test_strict_points(one):
    get = lambda t, **o: [(b.method, b.number) for b in one(guidance.split_blocks(F.lit(t), **o))]
    assert get("1. A\n2. B\n3. C", any_start=False, min_points=3) == [("guidance_point", "1"), ("guidance_point", "2"), ("guidance_point", "3")]
    assert get("2. A\n3. B\n4. C", any_start=False, min_points=3) == [("guidance_paragraph", None)]
    assert get("1. A\n5. B\n9. C\n\nX", any_start=False, min_points=3) == [("guidance_paragraph", None)] * 2


def test_splitters(docs):
    book = "A. General principles\nIntro text.\n1.\n" + "Rule one text. " * 50 + "\n2.\n" + "Rule two text. " * 50
    found = rows(chunks.chunks(docs(book), "ae", "primary_legislation"), "chunk_method", "metadata.legal_unit_number", F.substring("text", 1, 45))
    assert found == [("statute_rule", "1", "Section A. General principles 1. Intro text. "), ("statute_rule", "2", "Section A. General principles 2. Rule two tex")]
    terms = 'Schedule 1. Definitions\nTerm Definition\n"Act" means the Act. "Bank" or "Banker" has the meaning ascribed to the term in law.'
    assert rows(chunks.chunks(docs(terms), "ae", "primary_legislation"), "chunk_method", "text") == [("definition_entry", "Act: means the Act."), ("definition_entry", "Bank / Banker: has the meaning ascribed to the term in law.")]
    rule = "Rule 4. Summons\n(a) " + "Contents; " * 80 + ".\n(1) " + "More words. " * 60
    assert len(rows(chunks.chunks(docs(rule), "us", "procedure_rules"), "order")) == 2
    assert rows(chunks.chunks(docs("Short preamble only."), "eu", "code"), "order") == []
    preamble = "CAPITAL MARKETS LAW\n\n" + "Intro: " + "• first item; " * 60 + "• second item " * 60
    assert rows(chunks.chunks(docs(preamble), "ae", "code"), "text")[0][0].startswith("Intro:")


def test_adjacency_and_nesting(docs):
    text = "Article 1. One\nbody\nArticle 2. Two\nbody"
    made = chunks.chunks(docs(text), "generic").orderBy("order").collect()
    assert made[0].next_chunk_id == made[1].chunk_id and made[1].prev_chunk_id == made[0].chunk_id and made[0].prev_chunk_id is None
    (d,) = chunks.documents(docs(text), "generic").collect()
    assert [c.order for c in d.chunks] == [1, 2] and len(d.sections) == 3 and d.chunk_policy == "statute"


def test_trace(docs):
    events = trace.events(docs("Schedule 1. Definitions\n\"Act\" means it."), "generic").collect()
    assert {e.type for e in events} == {"chunk_policy_selected", "document_normalized", "section_line_classified", "heading_detected", "definition_schedule_split"}


def test_points_and_places_in_linear_work(spark):
    """Thousands of points and matches in one text: blocks and places are those of a plain scan."""
    body = "Start.\n" + "\n".join(f"{n % 900 + 1}. Point\nbody № {n}\n12. Not one" if n % 7 == 0 else f"{n % 900 + 1}. Point {n}" for n in range(6000))
    df = spark.createDataFrame([(body,)], "t string")
    blocks = df.select(guidance.split_blocks(F.col("t")).alias("b")).head().b
    plain = [m.start() for m in re.finditer(r"(?m)^\d{1,3}\. (?=[A-Z])", body)]
    assert [b.start for b in blocks] == [0, *plain] and all(body[b.start :].startswith(b.text) for b in blocks)
    assert "".join(b.text for b in blocks).replace("\n", "") == body.replace("\n", "")
    spans = df.select(rx.spans(F.col("t"), r"\d+").alias("s")).head().s
    assert [(x.start, x.past, x.text) for x in spans] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+", body)]


def test_trace_of_a_statute_tells_each_line_and_cut(docs):
    body = "Part 1. Goods\n\nArticle 1. Terms\nThey bind.\nSchedule 1. Definitions\n\"Act\" means it.\n\"Law\" means that."
    told = trace.events(docs(body, " ", "no heading"), "generic", "code").collect()
    lines = sorted((e["doc_id"], e["position"], e["data"]["kind"]) for e in told if e["type"] == "section_line_classified")
    kinds = ["heading", "blank", "heading", "text", "heading", "text", "text"]
    assert lines == [(0, i, k) for i, k in enumerate(kinds)] + [(2, 0, "text")]
    assert sorted(e["position"] for e in told if e["type"] == "heading_detected") == [0, 2, 4]
    assert [(e["doc_id"], e["position"], e["data"]) for e in told if e["type"] == "definition_schedule_split"] == [(0, 3, {"section": "Schedule 1. Definitions", "count": "2"})]
    assert sum(e["type"] == "document_normalized" for e in told) == 3
