"""Why a document was cut as it was: every decision as a row (doc_id, stage, type, position, data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rx
from ..plans.profiles import Profile, chunk_policy, resolve
from . import chunks as cut
from . import guidance
from . import pages as paged
from . import sections as tree


def _event(stage: str, type_: str, position: Column, /, **data: Column) -> Column:
    pairs = [x for name, value in data.items() for x in (F.lit(name), value.cast("string"))]
    return F.struct(F.lit(stage).alias("stage"), F.lit(type_).alias("type"), position.cast("long").alias("position"), F.create_map(*pairs).alias("data"))


def _told(df: DataFrame, *found: Column) -> DataFrame:
    """Each row's events that aren't null, as rows; one pass over df whatever their number."""
    return df.select("doc_id", F.explode(F.filter(F.array(*found), lambda e: e.isNotNull())).alias("e")).select("doc_id", "e.*")


def events(docs: DataFrame, profile: Profile | str = "generic", doc_kind: str | None = None) -> DataFrame:
    """Events of documents (doc_id, text). position: of the line, point or section in its document."""
    own, policy = resolve(profile), chunk_policy(profile, doc_kind)
    base = cut.normalized(docs)
    whole = _told(
        base,
        _event("chunk", "chunk_policy_selected", F.lit(0), profile=F.lit(own.code), doc_kind=F.lit(doc_kind), policy=F.lit(policy)),
        _event("normalize", "document_normalized", F.lit(0), source_name=F.col("source_name"), char_length=F.length("text")),
    )
    lines = tree.lines(base, own, policy)
    if policy == "statute":
        return whole.unionByName(_of_sections(tree.tree(lines, with_lines=True), own))
    found = list(_line_events(F.struct("line_no", "text", "start", "heading")))
    if policy == "guidance":
        found = [F.when(~F.col("block"), e) for e in found]
        case = guidance.case_metadata(F.col("text"), own, doc_kind)["source_case_reference"]
        point = _event("assemble", "guidance_point_detected", F.col("line_no"), point_number=F.col("point"), has_case_reference=case.isNotNull())
        preamble = _event("assemble", "guidance_preamble_detected", F.col("line_no"), char_length=F.length("text"))
        found += [F.when(F.col("point").isNotNull(), point), F.when(F.col("block") & F.col("point").isNull(), preamble)]
    return whole.unionByName(_told(lines, *found))


def _line_events(line: Column) -> tuple[Column, Column]:
    """What a line (line_no, text, start, heading) was taken for; and its heading, null where it is none."""
    heading = line["heading"]
    kind = tree.line_kind(heading, line["text"])
    taken = _event("detect", "section_line_classified", line["line_no"], rule_id=F.concat(F.lit("section.line."), kind), kind=kind, offset=line["start"], text=line["text"])
    found = _event("detect", "heading_detected", line["line_no"], kind=heading["kind"], label=heading["label"], offset=line["start"])
    return taken, F.when(heading.isNotNull(), found)


def _of_sections(sections: DataFrame, own: Profile) -> DataFrame:
    """Events of sections under the statute policy: of their lines, and of texts cut in a way of their own."""
    lines = F.filter("lines", lambda x: x["line_no"] >= 0)
    of_lines = F.flatten(F.transform(lines, lambda x: F.array(*_line_events(x))))

    def split(name: str, parts: Column) -> Column:
        made = lambda n: F.when(n > 0, _event("chunk", name, F.col("order"), section=F.col("title"), count=n))
        return rx.let(F.size(parts), made)

    splits = [F.when(fits, split(name, parts)) for name, fits, parts in cut.special(own, own.limits, rx.strip(F.col("text")))]
    every = F.filter(F.concat(of_lines, F.array(F.coalesce(*splits))), lambda e: e.isNotNull())
    return sections.select("doc_id", F.explode(every).alias("e")).select("doc_id", "e.*")


def _of_line(line: Column, profile: Profile) -> dict[str, Column]:
    kind = line["kind"]
    rule = F.concat(F.lit("pdf.line."), F.when(kind == "profile_noise", f"profile_noise.{profile.code}").otherwise(kind))
    target = F.when(kind == "toc_leader", F.regexp_extract(line["text"], r"(\d{1,4})\s*$", 1))
    return {"rule_id": rule, "kind": kind, "text": line["text"], "drop": kind.isin(paged.DROPPED), "target_page": target}


def page_events(pages: DataFrame, profile: Profile | str = "generic") -> DataFrame:
    """Events of pages' lines. What each was taken for; then, for lines as merged, whether they stay and in which state.

    Every page starts as front matter. A heading or a list item makes it body, a line of contents makes it contents;
    text after contents is body. Pages of contents (two lines or more) have no decisions. position: the page's number
    times 2^32, and the line's.
    """
    own = resolve(profile)
    kinds = paged.cleaned_lines(pages, own).select("doc_id", "page_number", rx.once(paged.classified(F.col("lines"), own)).alias("kinds"))
    both = kinds.withColumn("merged", rx.once(paged.refined(F.col("kinds"), own)))
    marked = lambda name, merged: F.transform(name, lambda x, i: F.struct(i.alias("line_no"), F.lit(merged).alias("merged"), x["text"].alias("text"), x["kind"].alias("kind")))
    lines = both.select("doc_id", "page_number", F.explode(F.concat(marked("kinds", False), F.coalesce(marked("merged", True), F.array()))).alias("line"))
    kind, drop = F.col("line.kind"), F.col("line.kind").isin(paged.DROPPED)
    so_far = Window.partitionBy("doc_id", "page_number", "line.merged").orderBy("line.line_no")
    left = F.max((kind.isin("structural_heading", "enumerated_content", "toc_leader")).cast("int")).over(so_far) == 1
    # lines that go, but for those of contents, leave the state as it was
    state = F.when(kind == "toc_leader", "table_of_contents").when(~drop, F.when(left, "body").otherwise("front_matter"))
    told = lines.withColumn("state", state).withColumn("state", F.coalesce(F.last("state", True).over(so_far), F.lit("front_matter")))
    told = told.withColumn("before", F.coalesce(F.lag("state").over(so_far), F.lit("front_matter")))
    position = F.col("page_number").cast("long") * (1 << 32) + F.col("line.line_no")
    data = _of_line(F.col("line"), own)
    decided = _event("extract", "pdf_line_decided", position, state_from=F.col("before"), state_to=F.col("state"), keep=~drop, **data)
    return _told(told, F.when(~F.col("line.merged"), _event("extract", "pdf_line_classified", position, **data)), F.when(F.col("line.merged"), decided))
