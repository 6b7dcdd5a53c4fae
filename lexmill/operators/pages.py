"""Text of documents from the raw text of their pages: noise out, wrapped lines joined.

Pages are (doc_id, page_number, raw). What repeats over a document's pages is counted by aggregation; the rest
happens page by page on arrays of lines, which no page makes longer than itself.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rx, text
from ..functions.headings import detect_heading
from ..plans.profiles import Profile, resolve
from .chunks import spread

LEADING, TRAILING, REPEATED, HEADER_LINES = 8, 4, 3, 4
# Signs of lines that aren't content, and words with which headings start.
PAGE_NUMBER, TOC, LIST = r"(?U)\A\d{1,4}\z", rx.PREFIX + r"\.{5,}\s*\d+\s*$", rx.CASELESS + r"\A(?:[-*•]|[0-9]+[.)]|[а-яa-z]\))\s+"
EMAIL = rx.PREFIX + r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
ARABIC_HEADERS = ["صندوق بريد", "العربية المتحدة"]
HEADING_WORDS = ["part ", "chapter ", "section ", "article ", "schedule ", "annex ", "appendix "]
RULES_TITLE = r"RULES OF CIVIL PROCEDURE\s+FOR THE\s+UNITED STATES DISTRICT COURTS"
DROPPED = ["blank", "page_number", "toc_leader", "running_header", "profile_noise"]


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, lines: normalised lines of pages that aren't blank; empty lines are left out."""
    own = pages.select("doc_id", "page_number", rx.strip(F.coalesce("raw", F.lit(""))).alias("raw")).where("raw <> ''")
    split = F.transform(F.split(F.regexp_replace("raw", "\r", "\n"), "\n"), text.normalize_line)
    return own.select("doc_id", "page_number", F.filter(split, lambda s: s != "").alias("lines"))


def fingerprint(line: str | None) -> str:
    """What stays of a page's header line when marks, case and a stray letter before Arabic are ignored."""
    own = "".join(c for c in unicodedata.normalize("NFKC", (line or "").strip()) if not unicodedata.combining(c))
    own = re.sub(r"[ \t]+", " ", own).strip()
    rest = own[2:].strip()
    if re.match(r"[A-Za-z]\s", own) and any("؀" <= c <= "ۿ" for c in rest):
        own = rest
    return "" if len(own) < 4 or re.fullmatch(r"\d{1,4}", own) else own.lower()


@F.pandas_udf(T.StringType())
def _folded(lines: pd.Series) -> pd.Series:
    return lines.map(fingerprint, na_action="ignore")


def header_fingerprint(line: Column) -> Column:
    """fingerprint() of a normalised line. Only lines beyond ASCII are folded in Python."""
    plain = ~line.rlike(r"[^\x00-\x7F]")
    own = F.when((F.length(line) < 4) | line.rlike(r"\A\d{1,4}\z"), F.lit("")).otherwise(F.lower(line))
    return F.when(plain, own).otherwise(_folded(F.when(~plain, line)))


def is_noise_candidate(line: Column) -> Column:
    s = rx.trimmed(line)
    letter = s.rlike(r"\A\p{IsAlphabetic}\z")
    return letter | ((F.length(s) >= 8) & ~s.rlike(PAGE_NUMBER) & ~s.rlike(LIST) & ~s.rlike(TOC))


def repeated_noise(lines: DataFrame) -> DataFrame:
    """doc_id, line: lines at the top or the bottom of at least REPEATED pages of their document."""
    n = F.size("lines")
    ends = F.concat(F.slice("lines", 1, LEADING), F.slice("lines", F.greatest(F.lit(1), n - TRAILING + 1), F.lit(TRAILING)))
    seen = lines.select("doc_id", "page_number", F.explode_outer(F.array_distinct(ends)).alias("line")).where(is_noise_candidate(F.col("line")))
    return seen.groupBy("doc_id", "line").agg(F.count_distinct("page_number").alias("n_pages")).where(F.col("n_pages") >= REPEATED).select("doc_id", "line")


def repeated_fingerprints(lines: DataFrame) -> DataFrame:
    """doc_id, fingerprint: of lines at the top of at least REPEATED pages of their document."""
    seen = lines.select("doc_id", "page_number", F.explode_outer(F.slice("lines", 1, LEADING)).alias("line")).select("doc_id", "page_number", header_fingerprint(F.col("line")).alias("fingerprint")).where("fingerprint <> ''")
    return seen.groupBy("doc_id", "fingerprint").agg(F.count_distinct("page_number").alias("n_pages")).where(F.col("n_pages") >= REPEATED).select("doc_id", "fingerprint")


def _any_of(choices: list[Column]) -> Column:
    out = F.lit(False)
    for c in choices:
        out = out | c
    return out


def is_profile_noise(line: Column, profile: Profile) -> Column:
    equal = [F.lower(line) == x.lower() for x in profile.switch("drop_lines") or []]
    return _any_of([*equal, *(line.rlike(rx.CASELESS + p) for p in profile.switch("drop_patterns") or [])])


def is_structural(line: Column, profile: Profile) -> Column:
    """A heading, or a short line in capitals."""
    # without a capital nothing needs to be counted
    letters, capitals = (F.regexp_count(line, F.lit(p)) for p in (r"\p{IsAlphabetic}", r"\p{IsUppercase}"))
    shouted = (F.length(line) <= 120) & line.rlike(r"\p{IsUppercase}") & rx.let(letters, lambda n: (n > 0) & (capitals >= n * 0.85))
    return shouted | detect_heading(line, profile).isNotNull()


def is_running_header(line: Column) -> Column:
    arabic = _any_of([line.contains(x) for x in ARABIC_HEADERS])  # has no case
    email = line.contains("@") & F.lower(line).rlike(EMAIL)
    titled = lambda low: (low == "contents") | (low.contains("po box") & low.contains("authority"))
    return arabic | email | rx.let(F.lower(line), titled)


def line_kind(line: Column, profile: Profile | str) -> Column:
    """blank, page_number, toc_leader, running_header, profile_noise, structural_heading, enumerated_content or body_text."""
    own = resolve(profile)
    return (
        F.when(line == "", "blank").when(line.rlike(PAGE_NUMBER), "page_number").when(line.rlike(TOC), "toc_leader").when(is_running_header(line), "running_header")
        .when(is_profile_noise(line, own), "profile_noise").when(is_structural(line, own), "structural_heading").when(line.rlike(LIST), "enumerated_content").otherwise("body_text")
    )


def _kinds(lines: Column, profile: Profile) -> Column:
    return F.transform(lines, lambda s: F.struct(s.alias("text"), line_kind(s, profile).alias("kind")))


def merge_markers(lines: Column) -> Column:
    """A numeral on a line of its own goes if a heading follows; a letter moves to the line after it."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"))
    roman, letter = r"\A[IVXLCDM]+\.\z", r"\A[A-Z]\.\z"

    def add(s: Column, line: Column) -> Column:
        held = s["held"]
        starts = _any_of([F.lower(line).startswith(w) for w in HEADING_WORDS])
        used = held.isNotNull() & ((held.rlike(roman) & starts) | held.rlike(letter))
        merged = F.when(held.rlike(roman) & starts, line).otherwise(F.concat(held, F.lit(" "), line))
        out = F.when(used, F.concat(s["out"], F.array(merged))).when(held.isNotNull(), F.concat(s["out"], F.array(held))).otherwise(s["out"])
        waits = ~F.coalesce(used, F.lit(False)) & line.rlike(rf"{roman}|{letter}")
        return F.struct(F.when(F.coalesce(used, F.lit(False)) | waits, out).otherwise(F.concat(out, F.array(line))).alias("out"), F.when(waits, line).alias("held"))

    return F.aggregate(lines, empty, add, lambda s: F.when(s["held"].isNotNull(), F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]))


def _last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def _but_last(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


TERMINAL, SMALL = r"[.!?:;]\z", r"\A\p{IsLowercase}"


def merge_wrapped(lines: Column, profile: Profile) -> Column:
    """Headings take on the lines into which they were wrapped."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("open"))

    def add(s: Column, x: Column) -> Column:
        line, last = x["text"], _last(s["out"])
        barred = x["structural"] | line.rlike(PAGE_NUMBER) | line.rlike(TOC) | is_profile_noise(line, profile) | line.rlike(LIST)
        goes_on = s["open"] & ~barred & (last.endswith("-") | (~last.rlike(TERMINAL) & line.rlike(SMALL)))
        joined = F.when(last.endswith("-"), F.concat(F.regexp_replace(last, r"-\z", ""), line)).otherwise(F.concat(last, F.lit(" "), line))
        return F.when(goes_on, F.struct(F.concat(_but_last(s["out"]), F.array(joined)).alias("out"), F.lit(True).alias("open"))).otherwise(F.struct(F.concat(s["out"], F.array(line)).alias("out"), x["structural"].alias("open")))

    marked = F.transform(lines, lambda t: F.struct(t.alias("text"), is_structural(t, profile).alias("structural")))
    return F.aggregate(marked, empty, add, lambda s: s["out"])


def assemble(kinds: Column) -> Column:
    """Lines (text, kind) as paragraphs: headings and list items alone, body text joined up to a sentence's end."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("open"))

    def add(s: Column, x: Column) -> Column:
        line, last = x["text"], _last(s["out"])
        body = x["kind"] == "body_text"
        continues = line.rlike(r'\A(?:\p{IsLowercase}|["«(\[])')
        hyphen = last.endswith("-") & line.rlike(SMALL)
        joins = s["open"] & body & (hyphen | ~last.rlike(TERMINAL) | continues)
        joined = F.when(hyphen, F.concat(F.regexp_replace(last, r"-\z", ""), line)).otherwise(F.concat(last, F.lit(" "), line))
        return F.struct(F.when(joins, F.concat(_but_last(s["out"]), F.array(joined))).otherwise(F.concat(s["out"], F.array(line))).alias("out"), body.alias("open"))

    return F.aggregate(kinds, empty, add, lambda s: F.array_join(s["out"], "\n"))


def _from(lines: Column, start: Column) -> Column:
    return F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))


def trim_header(lines: Column) -> Column:
    """lines (text, header) without the header lines they start with; a stray letter before those goes too."""
    flag = lambda i: F.coalesce(F.get(lines, F.lit(i))["header"], F.lit(False))
    stray = F.get(lines, F.lit(0))["text"].rlike(r"\A\p{IsAlphabetic}\z") & flag(1)
    run = lambda first: F.coalesce(F.array_min(F.filter(F.sequence(F.lit(first), F.lit(HEADER_LINES)), lambda i: (i == HEADER_LINES) | ~F.coalesce(F.get(lines, i)["header"], F.lit(False)))), F.lit(HEADER_LINES))
    return F.transform(_from(lines, F.when(stray, run(1)).otherwise(run(0))), lambda x: x["text"])


def trim_rule_header(lines: Column) -> Column:
    """lines without the running header of the federal rules."""
    number = lambda s: s.rlike(PAGE_NUMBER)
    title = lambda s: F.upper(s) == "FEDERAL RULES OF CIVIL PROCEDURE"
    lead = lambda a, test: F.coalesce(F.array_min(F.filter(F.transform(a, lambda s, i: F.when(~test(s), i)), lambda i: i.isNotNull())), F.size(a))
    cut = rx.let(lines, lambda a: _from(a, lead(a, number)))
    cut = rx.let(cut, lambda a: _from(a, lead(a, title)))

    def rule(a: Column) -> Column:
        second = F.coalesce(F.get(a, F.lit(1)), F.lit(""))
        goes = F.get(a, F.lit(0)).rlike(rx.CASELESS + r"\ARule\s+\d+(?:\.\d+)?\z") & ((second == "") | second.rlike(r"(?U)\A[(\[\"'\p{IsLowercase}\d]"))
        return F.when(F.size(a) == 0, lines).when(goes, _from(a, F.lit(1))).otherwise(a)

    return F.when(F.size(lines) < 2, lines).otherwise(rx.let(cut, rule))


def classified(lines: Column, profile: Profile | str) -> Column:
    """array of struct(text, kind) from a page's lines (struct(text, header)), running headers already off."""
    own = resolve(profile)
    trimmed = rx.let(lines, trim_header)
    return _kinds(rx.let(trimmed, trim_rule_header) if own.switch("trim_running_headers") else trimmed, own)


def refined(kinds: Column, profile: Profile | str) -> Column:
    """Lines that stay, with markers and wrapped headings merged, classified again; null for a page of contents."""
    own = resolve(profile)
    merged = merge_markers(F.transform(F.filter(kinds, lambda x: ~x["kind"].isin(DROPPED)), lambda x: x["text"]))
    if own.switch("merge_wrapped"):
        merged = rx.let(merged, lambda a: merge_wrapped(a, own))
    return F.when(F.size(F.filter(kinds, lambda x: x["kind"] == "toc_leader")) < 2, _kinds(merged, own))


def page_text(kinds: Column) -> Column:
    """The text of a page from its refined lines."""
    return text.normalize_extracted(assemble(F.filter(F.coalesce(kinds, F.array().cast("array<struct<text:string,kind:string>>")), lambda x: ~x["kind"].isin(DROPPED))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def header_fingerprints(lines: pd.Series) -> pd.Series:
    return lines.map(lambda own: [fingerprint(x) for x in own])


def cleaned_lines(pages: DataFrame, profile: Profile | str) -> DataFrame:
    """doc_id, page_number, lines: array of struct(text, header) without repeated and profile noise.

    What repeats in a document is one small row, so whole lines are never dealt out by themselves. Pages are then
    dealt by their numbers: a document with very many doesn't stay in one task.
    """
    # the three uses of this exchange have one plan, so Spark writes it once: lines are made once
    own, base = resolve(profile), spread(page_lines(pages), "doc_id", "page_number")
    noise = repeated_noise(base).groupBy("doc_id").agg(F.collect_set("line").alias("noise"))
    prints = repeated_fingerprints(base).groupBy("doc_id").agg(F.collect_set("fingerprint").alias("prints"))
    known = noise.join(prints, "doc_id", "full_outer")
    joined = spread(base.join(known, "doc_id", "left"), "doc_id", "page_number")
    repeated = lambda s: F.coalesce(F.array_contains("noise", s), F.lit(False))
    left = joined.select("doc_id", "page_number", "prints", rx.once(F.filter("lines", lambda s: ~repeated(s) & ~is_profile_noise(s, own))).alias("lines"))
    # fingerprints are told in Python: of the lines in which a header can stand, where the document has any headers
    asked = F.when(F.col("prints").isNotNull(), F.slice("lines", 1, HEADER_LINES + 1)).otherwise(F.array().cast("array<string>"))
    told = left.where(F.size("lines") > 0).withColumn("own", header_fingerprints(asked))
    header = lambda i: F.coalesce(F.array_contains("prints", F.get(F.col("own"), i)), F.lit(False))
    return told.select("doc_id", "page_number", rx.once(F.transform("lines", lambda s, i: F.struct(s.alias("text"), header(i).alias("header")))).alias("lines"))


def clean_pages(pages: DataFrame, profile: Profile | str = "generic") -> DataFrame:
    """doc_id, page_number, text of the pages that have any."""
    own = resolve(profile)
    kinds = cleaned_lines(pages, own).select("doc_id", "page_number", rx.once(classified(F.col("lines"), own)).alias("kinds"))
    lines = kinds.select("doc_id", "page_number", rx.once(refined(F.col("kinds"), own)).alias("lines"))
    found = lines.select("doc_id", "page_number", rx.once(page_text(F.col("lines"))).alias("text")).where("text <> ''")
    return trim_rules_body(found) if own.switch("trim_rules_body") else found


def trim_rules_body(pages: DataFrame) -> DataFrame:
    """Pages from the one on which the federal rules begin, with what stands before their title cut off."""
    title = rx.CASELESS + RULES_TITLE
    begins = ~F.col("text").rlike(rx.CASELESS + r"\bTABLE OF CONTENTS\b") & F.col("text").rlike(title) & F.col("text").contains("Rule 1. Scope and Purpose")
    document = Window.partitionBy("doc_id")
    first = F.coalesce(F.min(F.when(begins, F.col("page_number"))).over(document), F.min("page_number").over(document))
    cut = rx.strip(F.regexp_replace("text", r"(?s)\A.*?(?=(?iuU)" + RULES_TITLE + ")", ""))
    kept = pages.withColumn("first", first).where("page_number >= first")
    return kept.select("doc_id", "page_number", F.when((F.col("page_number") == F.col("first")) & F.col("text").rlike(title), cut).otherwise(F.col("text")).alias("text"))


def document_text(pages: DataFrame, profile: Profile | str = "generic") -> DataFrame:
    """doc_id, text: the cleaned pages of each document, an empty line between them."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"])
    return clean_pages(pages, profile).groupBy("doc_id").agg(rx.strip(F.array_join(parts, "\n\n")).alias("text"))
