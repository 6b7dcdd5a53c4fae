"""Section trees: from documents (doc_id, source_name, text) to one row per section.

All steps share one shuffle by doc_id: lines stay in their document's partition through every window. Points of
court reviews go the way of headings, so every document is read once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headings, rx, text
from ..plans.profiles import Profile, resolve

METADATA = ["article_number", "paragraph_number", "point_number", "legal_unit_type", "legal_unit_number", "source_case_reference", "source_case_number", "source_case_date", "source_case_court", "definition_term"]
ROOT = "Document"


def metadata(**known: Column) -> Column:
    """The struct of a section's or a chunk's legal metadata; what isn't given is null."""
    return F.struct(*(known.get(n, F.lit(None)).cast("string").alias(n) for n in METADATA))


def lines(docs: DataFrame, profile: Profile | str = "generic", policy: str = "default") -> DataFrame:
    """doc_id, source_name, line_no, start, past, text, heading, point: every line of every stripped text that isn't empty.

    Each line is classified once. start and past count characters of the stripped text. doc_id identifies a document:
    the lines of rows that share one would be mixed.

    Under the guidance policy a document with numbered points has a row for its preamble and one for each point (point:
    its number, else null), which count characters of the guidance-normalised text; block is true for those rows.
    """
    own = docs.select("doc_id", "source_name", "text", rx.once(rx.strip(F.coalesce("text", F.lit("")))).alias("body")).where("body <> ''")
    ends = F.transform(F.regexp_extract_all("body", F.lit(rx.LINE_ENDS), F.lit(0)), F.length)
    cut = F.arrays_zip(F.split("body", rx.LINE_ENDS, -1).alias("raw"), ends.alias("gap"))
    none = F.lit(None)
    if policy == "guidance":
        from . import guidance

        own = own.withColumn("view", rx.once(text.normalize_guidance("text"))).where("view <> ''")
        own = own.withColumn("blocks", rx.once(guidance.split_blocks(F.col("view")))).withColumn("block", rx.once(guidance.is_pointed(F.col("blocks"))))
        entry = lambda raw, gap, at, point: F.struct(raw.alias("raw"), gap.cast("int").alias("gap"), at.cast("int").alias("at"), point.cast("string").alias("point"))
        blocks = F.transform("blocks", lambda b: entry(b["text"], F.lit(0), b["start"], b["number"]))
        found = own.select("doc_id", "source_name", "block", F.when(F.col("block"), F.length("view")).otherwise(F.length("body")).alias("total"), F.posexplode(F.when(F.col("block"), blocks).otherwise(F.transform(cut, lambda e: entry(e["raw"], e["gap"], none, none)))).alias("line_no", "e"))
    else:
        found = own.select("doc_id", "source_name", F.lit(False).alias("block"), F.length("body").alias("total"), F.posexplode(cut).alias("line_no", "e")).withColumns({"at": none.cast("int"), "point": none.cast("string")})
        found = found.select("doc_id", "source_name", "block", "total", "line_no", F.struct("e.raw", "e.gap", "at", "point").alias("e"))
    found = found.select("doc_id", "source_name", "block", "total", "line_no", "e.raw", F.coalesce("e.gap", F.lit(0)).alias("gap"), "e.at", "e.point")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    so_far = F.sum(F.length("raw") + F.col("gap")).over(order) - F.length("raw") - F.col("gap")
    placed = found.withColumn("start", F.coalesce("at", so_far.cast("int")))
    heading = headings.detect_heading(F.col("raw"), profile, policy)
    if policy == "guidance":
        point = F.struct(F.lit("clause").alias("kind"), F.concat(F.lit("Point "), F.col("point")).alias("label"), none.cast("string").alias("article_number"), none.cast("string").alias("paragraph_number"))
        heading = F.when(~F.col("block"), heading).when(F.col("point").isNotNull(), point)
    return placed.select("doc_id", "source_name", "total", "line_no", "start", (F.col("start") + F.length("raw")).alias("past"), rx.trimmed(F.col("raw")).alias("text"), rx.once(heading).alias("heading"), "point", "block")


def line_kind(heading: Column, line: Column) -> Column:
    return F.when(line == "", "blank").when(heading.isNotNull(), "heading").otherwise("text")


def tree(lines_: DataFrame, case: Callable[[Column], Column] | None = None, with_lines: bool = False) -> DataFrame:
    """Sections of the given lines. Every document has a root, in front of its headings.

    case: from a point's text to the struct of what is known of the decision it cites. with_lines: add lines, each
    section's array of struct(line_no, text, start, heading); the root's starts with an empty line numbered -1.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    # an empty line before the first one stands for the root, so each line is classified in one pass only
    copies = F.when(F.col("line_no") == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    both = lines_.withColumn("root", F.explode(copies))
    both = both.select("doc_id", "source_name", "total", F.when(F.col("root"), -1).otherwise(F.col("line_no")).alias("line_no"), "start", "past", F.when(F.col("root"), "").otherwise(F.col("text")).alias("text"), F.when(~F.col("root"), F.col("heading")).alias("heading"), F.when(~F.col("root"), F.col("point")).alias("point"))
    numbered = both.withColumn("section", F.sum(F.col("heading").isNotNull().cast("int")).over(order).cast("int"))
    kept = ["line_no", "text", "start", "heading"] if with_lines else ["line_no", "text"]
    bodies = numbered.groupBy("doc_id", "section").agg(
        F.first("source_name").alias("source_name"), F.first("total").alias("total"), F.max("heading").alias("heading"), F.max("point").alias("point"), F.min("line_no").alias("line_no"),
        F.min(F.when(F.col("heading").isNotNull(), F.col("start"))).alias("start"), F.max(F.when(F.col("text") != "", F.col("past"))).alias("past"),
        F.sort_array(F.collect_list(F.struct(*kept))).alias("lines"),
    )
    bodies = bodies.withColumn("joined", F.array_join("lines.text", "\n")).withColumn("text", rx.strip(F.regexp_replace("joined", r"\n{3,}", "\n\n"))).withColumn("depth", F.when(F.col("section") > 0, headings.level(F.col("heading.kind"))))
    before = Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    titled = bodies.withColumn("label", F.coalesce("heading.label", F.lit(ROOT)))

    def ancestors(value: str) -> list[Column]:
        """At each depth the last section no deeper, if it has that depth and stands above this one."""
        last = [F.last(F.when(F.col("depth") <= d, F.struct("depth", value)), True).over(before) for d in range(1, 6)]
        return [F.when((x["depth"] == d) & (F.col("depth") > d), x[value]) for d, x in enumerate(last, 1)]

    pathed = titled.withColumn("path", F.when(F.col("section") == 0, F.array(F.lit(ROOT))).otherwise(F.concat(F.array(F.lit(ROOT)), F.filter(F.array(*ancestors("label")), lambda t: t.isNotNull()), F.array("label"))))
    same = Window.partitionBy("doc_id", "path").orderBy("section")
    named = pathed.withColumn("section_id", text.section_id(F.col("source_name"), F.col("path"), F.row_number().over(same)))
    root_id = text.section_id(F.col("source_name"), F.array(F.lit(ROOT)), F.lit(1))
    full = named.withColumn("parent_section_id", F.when(F.col("section") > 0, F.coalesce(*reversed(ancestors("section_id")), root_id)))
    known = {"article_number": F.col("heading.article_number"), "paragraph_number": F.col("heading.paragraph_number")}
    if case is not None:
        full = full.withColumn("case", rx.once(F.when(F.col("point").isNotNull(), case(F.col("text")))))
        known |= {n: F.col(f"case.{n}") for n in METADATA if n.startswith("source_case_")}
        known |= {"point_number": F.col("point"), "legal_unit_type": F.when(F.col("point").isNotNull(), "guidance_point"), "legal_unit_number": F.col("point")}
    kind = F.when(F.col("section") == 0, "document_root").otherwise(F.col("heading.kind"))
    return full.select(
        "doc_id", "source_name", "section_id", kind.alias("kind"), F.col("label").alias("title"), F.col("section").alias("order"), "parent_section_id", "path",
        F.when(F.col("point").isNotNull(), "review_point").otherwise(kind).alias("section_type"), metadata(**known).alias("metadata"),
        F.coalesce("start", F.lit(0)).alias("start_offset"), F.greatest(F.coalesce("start", F.lit(0)), F.coalesce("past", "total")).alias("end_offset"), "text",
        *(["lines"] if with_lines else []),
    )


def sections(docs: DataFrame, profile: Profile | str = "generic", policy: str = "default", doc_kind: str | None = None) -> DataFrame:
    """One row per section of each document (doc_id, source_name, text) whose text isn't blank.

    Documents under the guidance policy that have numbered points become a root and its points.
    """
    from . import guidance

    own = resolve(profile)
    case = partial(guidance.case_metadata, profile=own, doc_kind=doc_kind) if policy == "guidance" else None
    return tree(lines(docs, own, policy), case)
