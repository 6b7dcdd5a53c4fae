"""Chunks: sections cut on legal boundaries, with stable ids.

Each section becomes an array of splits, told by Columns only; chunks are those that aren't blank, numbered
through their document. Paragraph arrays stay per section, so nothing grows beyond one section's text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rx, text
from ..plans.profiles import Limits, Profile, chunk_policy, resolve
from .sections import METADATA, sections

SPLIT = "struct<method:string,text:string,unit_type:string,unit_number:string,term:string>"
NONE = f"array<{SPLIT}>"


def split(method: str | Column, body: Column, unit_type: str | None = None, number: Column | None = None, term: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    own = F.lit(method) if isinstance(method, str) else method
    return F.struct(own.alias("method"), body.alias("text"), F.lit(unit_type).cast("string").alias("unit_type"), (null if number is None else number).alias("unit_number"), (null if term is None else term).alias("term"))


def _nothing() -> Column:
    return F.array().cast(NONE)


def paragraphs(body: Column) -> Column:
    """Stripped paragraphs that aren't empty."""
    return F.filter(F.transform(F.split(body, r"\n{2,}"), rx.strip), lambda p: p != "")


def char_windows(body: Column, limits: Limits) -> Column:
    """Overlapping windows of one text; the last one ends with it."""
    step = limits.max_chars - limits.overlap
    n = F.length(body)
    last = F.when(n <= limits.max_chars, 0).otherwise(F.ceil((n - limits.max_chars) / F.lit(step)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: rx.strip(F.substring(body, i * step + 1, F.lit(limits.max_chars))))
    return F.transform(F.filter(cut, lambda p: p != ""), lambda p: split("char_fallback", p))


def packed(units: Column, limits: Limits, method: str) -> Column:
    """Paragraphs joined while they fit into a chunk; longer ones become windows of their own."""
    empty = F.struct(F.lit(None).cast("string").alias("held"), _nothing().alias("out"))

    def flushed(s: Column) -> Column:
        return F.concat(s["out"], F.when(s["held"].isNotNull(), F.array(split(method, s["held"]))).otherwise(_nothing()))

    def add(s: Column, p: Column) -> Column:
        joined = F.when(s["held"].isNull(), p).otherwise(F.concat(s["held"], F.lit("\n\n"), p))
        over, fits = F.length(p) > limits.max_chars, F.length(joined) <= limits.max_chars
        held = F.when(over, F.lit(None).cast("string")).when(fits, joined).otherwise(p)
        out = F.when(over, F.concat(flushed(s), char_windows(p, limits))).when(fits, s["out"]).otherwise(flushed(s))
        return F.struct(held.alias("held"), out.alias("out"))

    return F.aggregate(units, empty, add, flushed)


def joined_units(units: Column, limits: Limits) -> Column:
    """Units joined by a space while they fit; a longer one stays whole."""
    empty = F.struct(F.lit(None).cast("string").alias("held"), F.array().cast("array<string>").alias("out"))
    flushed = lambda s: F.concat(s["out"], F.when(s["held"].isNotNull(), F.array(s["held"])).otherwise(F.array().cast("array<string>")))

    def add(s: Column, p: Column) -> Column:
        joined = F.when(s["held"].isNull(), p).otherwise(F.concat(s["held"], F.lit(" "), p))
        fits = F.length(joined) <= limits.max_chars
        return F.struct(F.when(fits, joined).otherwise(p).alias("held"), F.when(fits, s["out"]).otherwise(flushed(s)).alias("out"))

    return F.aggregate(units, empty, add, flushed)


def one_each(units: Column, limits: Limits, method: str) -> Column:
    """A chunk for each paragraph, windows for those that are too long."""
    return F.flatten(F.transform(units, lambda p: F.when(F.length(p) > limits.max_chars, char_windows(p, limits)).otherwise(F.array(split(method, p)))))


def subdivisions(body: Column, label: str) -> Column:
    """A stripped text cut before each label that follows the start, a sentence end or a line end."""
    cut = rx.PREFIX + rf"(?:(?<=^)|(?<=[.!?;:\n]))\s*{label}\s+"

    def parts(found: Column) -> Column:
        head = rx.strip(F.substring(body, F.lit(1), F.get(found, F.lit(0))["start"]))
        cuts = F.transform(found, lambda m, i: rx.strip(F.substring(body, m["start"] + 1, F.coalesce(F.get(found, i + 1)["start"], F.length(body)) - m["start"])))
        return F.filter(F.concat(F.array(head), cuts), lambda p: p != "")

    return F.when(body.rlike(cut), rx.let(rx.spans(body, cut), parts)).otherwise(F.array().cast("array<string>"))


US_LABEL, EU_LABEL = r"\((?:[a-z]|\d+|[A-Z])\)", r"(?:\d+\.|\((?:[a-z]|\d+)\))"
ARTICLE_LABELS = {"us_rule": US_LABEL, "eu_article": EU_LABEL}


def subdivided(body: Column, label: str, limits: Limits) -> Column:
    """Subdivisions of a text longer than a chunk, joined; empty unless that makes at least two."""

    def made(units: Column) -> Column:
        return F.when(F.size(units) >= 2, F.transform(units, lambda p: split("statute_unit", p))).otherwise(_nothing())

    def cut(own: Column) -> Column:
        joined = rx.let(subdivisions(own, label), lambda parts: F.when(F.size(parts) >= 2, joined_units(parts, limits)).otherwise(F.array().cast("array<string>")))
        return F.when(F.length(own) > limits.max_chars, rx.let(joined, made)).otherwise(_nothing())

    return rx.let(rx.strip(body), cut)


def _title_only(p: Column) -> Column:
    """A paragraph that only names the document."""
    words = F.split(p, rx.WHITE + "+")
    letters, capitals = (F.regexp_count(p, F.lit(x)) for x in (r"\p{IsAlphabetic}", r"\p{IsUppercase}"))
    titled = F.size(F.filter(words, lambda w: w.rlike(r"^\p{IsUppercase}|(?U)\d")))
    plain = ~p.contains("\n") & (F.length(p) <= 120) & ~p.rlike("[.!?;:]") & F.size(words).between(3, 12)
    return plain & (F.lower(p).contains("rulebook") | ((letters > 0) & ((capitals >= letters * 0.55) | (titled >= F.size(words) * 0.8))))


def title_preamble(body: Column, limits: Limits) -> Column:
    """Paragraphs of a preamble without its title; long ones by bullets or sentences, else windows."""

    def untitled(units: Column) -> Column:
        return F.when((F.size(units) >= 2) & _title_only(F.get(units, F.lit(0))), F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0)))).otherwise(units)

    def good(parts: Column) -> Column:
        return F.when((F.size(parts) >= 2) & F.forall(parts, lambda b: F.length(b) <= limits.max_chars), parts)

    def cut(p: Column) -> Column:
        bits = F.filter(F.transform(F.split(p, rx.PREFIX + r"\s*•\s*"), lambda b: F.regexp_replace(b, r"\A[ ;]+|[ ;]+\z", "")), lambda b: b != "")
        bullets = F.transform(bits, lambda b, i: F.when(i == 0, b).otherwise(F.concat(F.lit("• "), b)))
        sentences = joined_units(F.filter(F.transform(F.split(p, rx.PREFIX + r'(?<=[.!?;:])\s+(?=[A-Z"(•])'), rx.strip), lambda b: b != ""), limits)
        parts = F.coalesce(F.when(p.contains("•"), rx.let(bullets, good)), rx.let(sentences, good))
        return F.coalesce(F.transform(parts, lambda b: split("statute_unit", b)), char_windows(p, limits))

    units = rx.let(paragraphs(body), untitled)
    return F.flatten(F.transform(units, lambda p: F.when(F.length(p) <= limits.max_chars, F.array(split("statute_unit", p))).otherwise(cut(p))))


RULE = rx.PREFIX + r"^(\d+)\.(?:\s+(.*))?$"


def rule_blocks(body: Column) -> Column:
    """array of struct(number, text): rules numbered 1, 2, 3 ... by lines that start so; empty if they aren't."""
    none = F.array().cast("array<struct<number:string,text:string>>")
    strings = F.array().cast("array<string>")

    def untitled(own: Column) -> Column:
        return F.when(F.get(own, F.lit(0)).rlike(rx.PREFIX + r"^[A-Z]\.\s+"), F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0)))).otherwise(own)

    def started(own: Column) -> Column:
        at = F.transform(own, lambda s, i: F.when(s.rlike(RULE), F.struct(i.alias("at"), F.regexp_extract(s, RULE, 1).alias("number"), rx.strip(F.regexp_extract(s, RULE, 2)).alias("rest"))))
        return F.struct(own.alias("lines"), F.filter(at, lambda x: x.isNotNull()).alias("starts"))

    def blocks(x: Column) -> Column:
        own, starts = x["lines"], x["starts"]
        in_order = F.forall(F.transform(starts, lambda s, i: s["number"].cast("decimal(38,0)") == i + 1), lambda ok: ok)

        def block(s: Column, i: Column) -> Column:
            past = F.coalesce(F.get(starts, i + 1)["at"], F.size(own))
            after = F.slice(own, s["at"] + 2, F.greatest(past - s["at"] - 1, F.lit(0)))
            rest = F.when(s["rest"] != "", F.array(s["rest"])).otherwise(strings)
            intro = F.when(i == 0, F.slice(own, F.lit(1), s["at"])).otherwise(strings)
            return F.struct(s["number"].alias("number"), F.array_join(F.concat(rest, intro, after), "\n").alias("text"))

        good = (F.size(starts) >= 2) & (F.get(starts, F.lit(0))["number"] == "1") & in_order
        return F.when(good, F.filter(F.transform(starts, block), lambda b: b["text"] != "")).otherwise(none)

    all_lines = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), rx.LINE_ENDS), rx.strip), lambda s: s != "")
    found = rx.let(all_lines, lambda a: F.when(F.size(a) >= 3, rx.let(rx.let(untitled(a), started), blocks)).otherwise(none))
    return rx.let(found, lambda f: F.when(F.size(f) >= 2, f).otherwise(none))


ENTRY = rx.CASELESS + r'"[^"\n]{1,200}"(?:\s+or\s+"[^"\n]{1,200}")*\s+(?:means\b|has\s+the\s+meaning\s+ascribed\s+to\s+the\s+term\b|has\s+the\s+meaning\s+ascribed\s+to\s+it\s+in\b|has\s+the\s+meaning\s+ascribed\s+to\s+it\b|has\s+the\s+meaning\s+ascribed\s+to\b)'
HEADER = rx.CASELESS + r'\A"[^"\n]{1,200}"(?:\s+or\s+"[^"\n]{1,200}")*'


def definitions(body: Column) -> Column:
    """array of struct(term, definition) of entries like "Term" or "Other" means ..."""
    t = rx.strip(F.coalesce(body, F.lit("")))
    t = F.regexp_replace(t, r"(?dimuU)^\s*term\s+definition\s*$", "")
    t = F.regexp_replace(t, rx.CASELESS + r"\bterm\s+definition\b", "")

    def entries(x: Column) -> Column:
        t, found = x["text"], x["found"]

        def entry(m: Column, i: Column) -> Column:
            header = F.regexp_extract(m["text"], HEADER, 0)
            names = F.filter(F.transform(F.regexp_extract_all(header, F.lit(r'"([^"\n]{1,200})"'), F.lit(1)), rx.strip), lambda n: n != "")
            at = m["start"] + F.length(header)
            own = rx.strip(F.substring(t, at + 1, F.coalesce(F.get(found, i + 1)["start"], F.length(t)) - at))
            own = rx.strip(F.regexp_replace(own, rx.PREFIX + r'(?<!\b[A-Z])[.](?:\s+|\n+)(?=")', ". "))
            return F.struct(F.array_join(names, " / ").alias("term"), own.alias("definition"))

        return F.filter(F.transform(found, entry), lambda e: (e["term"] != "") & (e["definition"] != ""))

    return rx.let(rx.let(t, lambda own: F.struct(own.alias("text"), rx.spans(own, ENTRY).alias("found"))), entries)


def special(own: Profile, limits: Limits, body: Column) -> list[tuple[str, Column, Column]]:
    """How sections under the statute policy are cut by what they hold: (name, which sections, splits), tried in order.

    body: the section's stripped text. Splits are empty where the text has no such structure.
    """
    kind, long = F.coalesce("section_type", F.lit("")), F.length(body) > limits.max_chars
    entries = F.transform(definitions(body), lambda e: split("definition_entry", F.concat(e["term"], F.lit(": "), e["definition"]), "definition_entry", e["term"], e["term"]))
    ways = [("definition_schedule_split", (kind == "other") & F.lower("title").contains("definition"), entries)]
    if style := own.switch("article_splitter"):
        ways.append((f"{style}_subdivision_split", (kind == "article") & long, subdivided(body, ARTICLE_LABELS[style], limits)))
    if own.switch("oversized_splitter") == "rulebook":
        rules = F.transform(rule_blocks(body), lambda b: split("statute_rule", F.concat(F.col("title"), F.lit("\n"), b["number"], F.lit(". "), b["text"]), "rule_block", b["number"]))
        ways.append(("rule_block_split", (kind == "section") & long, rules))
    return ways


def splits(profile: Profile | str, policy: str, limits: Limits | None = None) -> Column:
    """The splits of a section row (kind, title, section_type, metadata, text), as an array."""
    own, limits = resolve(profile), limits or resolve(profile).limits
    kind, root = F.coalesce("section_type", F.lit("")), F.col("kind") == "document_root"

    def some(found: Column) -> Column:
        return rx.let(found, lambda f: F.when(F.size(f) > 0, f))

    def cut(body: Column) -> Column:
        if policy == "guidance":
            point = F.col("metadata.legal_unit_type").eqNullSafe("guidance_point") | (kind == "review_point")
            return F.when(point, F.array(split("guidance_point", body))).when(root, one_each(paragraphs(body), limits, "guidance_preamble")).otherwise(one_each(paragraphs(body), limits, "guidance_block"))
        if policy == "case_law":
            return one_each(paragraphs(body), limits, "case_law_paragraph")
        if policy != "statute":
            return packed(paragraphs(body), limits, "by_section")
        tried = []
        if own.switch("root_splitter") == "title_preamble":
            tried.append(F.when(root, title_preamble(body, limits)))
        elif own.switch("root_splitter") == "eu_recitals":  # a short preamble gives no chunk
            tried.append(F.when(root, subdivided(body, EU_LABEL, limits)))
        tried += [F.when(fits, some(found)) for _, fits, found in special(own, limits, body)]
        return F.coalesce(*tried, packed(paragraphs(body), limits, "statute_unit"))

    return rx.let(rx.strip(F.col("text")), cut)


def _pieces(found: DataFrame, own: Profile, policy: str, limits: Limits | None, explode: Callable) -> DataFrame:
    """Section rows, one for each split, with piece: the text of a chunk, empty where there is none."""
    cut = found.withColumn("splits", F.when(rx.strip(F.col("text")) != "", splits(own, policy, limits)))
    flat = cut.select(*found.columns, explode("splits").alias("split_no", "e"))
    return flat.withColumn("piece", rx.once(text.normalize_chunk("e.text")))


def _columns(order: Column, code: str) -> dict[str, Column]:
    """The columns of a chunk from a row of _pieces() and its number in the document."""
    chunk_id = text.short_id("chunk-", F.col("source_name"), F.lit(":"), F.col("section_id"), F.lit(":"), order.cast("string"), F.lit(":"), F.col("e.method"), F.lit(":"), text.identity_hash("piece", code))
    known = {"legal_unit_type": "e.unit_type", "legal_unit_number": "e.unit_number", "definition_term": "e.term"}
    merged = F.struct(*((F.coalesce(F.nullif(F.col(known[n]), F.lit("")), F.col(f"metadata.{n}")) if n in known else F.col(f"metadata.{n}")).alias(n) for n in METADATA))
    return {
        "chunk_id": chunk_id, "text": F.col("piece"), "order": order, "chunk_method": F.col("e.method"), "page": F.lit(None).cast("int"), "section_id": F.col("section_id"), "section_title": F.col("title"),
        "section_type": F.coalesce(F.nullif(F.col("section_type"), F.lit("")), F.col("kind")), "metadata": merged, "semantic_hash": text.semantic_hash("piece"),
    }


def chunks_of(found: DataFrame, profile: Profile | str, policy: str, limits: Limits | None = None) -> DataFrame:
    """Chunks of section rows, numbered from 1 in each document, with their neighbours' ids."""
    own = resolve(profile)
    flat = _pieces(found, own, policy, limits, F.posexplode).where("piece <> ''")
    numbered = flat.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("order", "split_no")))
    made = numbered.select("doc_id", "source_name", *(c.alias(n) for n, c in _columns(F.col("number"), own.code).items()))
    next_to = Window.partitionBy("doc_id").orderBy("order")
    return made.withColumns({"prev_chunk_id": F.lag("chunk_id").over(next_to), "next_chunk_id": F.lead("chunk_id").over(next_to)})


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to spark.sql.shuffle.partitions by the keys. Work on text costs far more than its bytes tell, and
    adaptive execution would put small texts into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def normalized(docs: DataFrame) -> DataFrame:
    """doc_id, source_name, text as the pipeline sees them, dealt by doc_id: the one shuffle of all that follows."""
    name = F.coalesce("source_name", F.lit("<memory>")) if "source_name" in docs.columns else F.lit("<memory>")
    own = spread(docs.select("doc_id", name.alias("source_name"), "text"), "doc_id")
    return own.select("doc_id", "source_name", rx.once(text.normalize_extracted("text")).alias("text"))


def chunks(docs: DataFrame, profile: Profile | str = "generic", doc_kind: str | None = None, limits: Limits | None = None) -> DataFrame:
    """From documents (doc_id, text and perhaps source_name) to chunks: normalised, sectioned, cut."""
    policy = chunk_policy(profile, doc_kind)
    return chunks_of(sections(normalized(docs), profile, policy, doc_kind), profile, policy, limits)


def documents(docs: DataFrame, profile: Profile | str = "generic", doc_kind: str | None = None, limits: Limits | None = None) -> DataFrame:
    """One row per document with its sections and chunks nested, in order. Sections are found once for both."""
    own, policy = resolve(profile), chunk_policy(profile, doc_kind)
    base = normalized(docs)
    found = sections(base, own, policy, doc_kind)
    fields = [c for c in found.columns if c not in ("doc_id", "source_name", "order")]
    flat = _pieces(found, own, policy, limits, F.posexplode_outer)
    so_far = F.sum((F.col("piece") != "").cast("int")).over(Window.partitionBy("doc_id").orderBy("order", "split_no")).cast("int")
    columns = _columns(F.col("number"), own.code)
    chunk = F.struct(columns.pop("order").alias("order"), *(c.alias(n) for n, c in columns.items()))
    section = F.when(F.coalesce("split_no", F.lit(0)) == 0, F.struct("order", *fields))
    both = flat.withColumn("number", so_far).select("doc_id", section.alias("section"), F.when(F.col("piece") != "", chunk).alias("chunk"))
    nested = both.groupBy("doc_id").agg(F.array_sort(F.collect_list("section")).alias("sections"), F.array_sort(F.collect_list("chunk")).alias("own"))
    beside = lambda c, i, step: F.get(F.col("own"), i + step)["chunk_id"]
    linked = F.transform("own", lambda c, i: c.withField("prev_chunk_id", F.when(i > 0, beside(c, i, -1))).withField("next_chunk_id", beside(c, i, 1)))
    joined = base.join(nested.select("doc_id", "sections", F.when(F.size("own") > 0, linked).alias("chunks")), "doc_id", "left")
    return joined.select("doc_id", "source_name", F.lit(own.code).alias("profile"), F.lit(own.language).cast("string").alias("language"), "text", F.lit(policy).alias("chunk_policy"), "sections", "chunks")
