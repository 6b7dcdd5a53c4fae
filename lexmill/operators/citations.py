"""Citations of articles, sections and recitals, with the law or code that each belongs to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rx, text
from ..plans import vocabulary as v
from ..plans.profiles import Profile, numbering_words, resolve
from . import numbering
from .chunks import spread

HIT = "array<struct<start:int,past:int,size:int,seq:int,family:string>>"


@dataclass(frozen=True)
class Pattern:
    """groups: which groups of the pattern hold article, paragraph and part (0: none)."""

    scheme: str
    pattern: str
    article: int
    paragraph: int = 0
    part: int = 0
    family: str | None = None


def _marker(profile: Profile, family: str) -> tuple[str, str]:
    """Numbering words that end in a sign (a number may follow at once) and others, as alternatives."""
    words = [w for w in numbering_words(profile, family) if any(c.isalpha() for c in w)]
    return tuple(rx.alternatives(own) if own else "" for own in ([w for w in words if not w[-1].isalnum()], [w for w in words if w[-1].isalnum()]))


def _prefix(profile: Profile, family: str) -> str:
    compact, spaced = _marker(profile, family)
    return "(?:" + "|".join([rf"(?<!\w){spaced}\s+"] * bool(spaced) + [rf"(?<!\w){compact}\s*"] * bool(compact)) + ")"


def patterns(profile: Profile | str, doc_family: str | None = None) -> list[Pattern]:
    """In the order in which they are tried."""
    own = resolve(profile)
    if own.code == "ru":
        part, point = (f"(?:({_prefix(own, f)}{n})\\s*)?" for f, n in (("part_like", r"\d+"), ("point_like", r"\d+(?:\.\d+)*")))
        article = _prefix(own, "article_like") + r"(\d+(?:\.\d+)*)"
        return [Pattern("ru_article", rx.CASELESS + part + point + article, 3, 2, 1), Pattern("ru_article", rx.CASELESS + point + part + article, 3, 1, 2)]
    found = []
    for family, scheme in (("article_like", "article"), ("section_like", "section")):
        compact, spaced = _marker(own, family)
        found += [Pattern(scheme, rx.CASELESS + rf"(?<!\w){w}\s{n}({v.TOKEN})", 1) for w, n in ((compact, "*"), (spaced, "+")) if w]
    given = (doc_family or "").strip().lower()
    for scheme, pattern, family in v.CITATIONS.get(own.code, []):
        if not (own.code == "us" and given and family != given):
            found.append(Pattern(scheme, rx.CASELESS + pattern, 1, family=family))
    return found


def family_hits(body: Column, profile: Profile | str) -> Column:
    """Where a lower-cased text names a family of documents: array of struct(start, past, size, seq, family).

    Names go through one expression as values, so the plan doesn't grow with their number.
    """
    names = [(family, name) for family, _, own in resolve(profile).families for name in own]
    if not names:
        return F.array().cast(HIT)
    known = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(rx.escape(name)).alias("pattern"), F.lit(len(name)).alias("size"), F.lit(seq).alias("seq"), F.lit(family).alias("family")) for seq, (family, name) in enumerate(names)))

    def places(n: Column) -> Column:
        gaps = F.split(body, n["pattern"], -1)
        at = rx.before(F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda g: F.length(g) + n["size"]), F.transform(gaps, F.length))
        return F.transform(at, lambda start: F.struct(start.alias("start"), (start + n["size"]).alias("past"), n["size"].alias("size"), n["seq"].alias("seq"), n["family"].alias("family")))

    return F.flatten(F.transform(F.filter(known, lambda n: body.contains(n["name"])), places))


def doc_family(body: Column, profile: Profile | str) -> Column:
    """The family with the longest name in the text; of equally long ones the first."""
    lowered = F.lower(rx.strip(F.coalesce(body, F.lit(""))))
    best = rx.let(lowered, lambda t: F.array_min(F.transform(family_hits(t, profile), lambda h: F.struct((-h["size"]).alias("a"), h["start"].alias("b"), h["seq"].alias("c"), h["family"].alias("family")))))
    return best["family"]


def nearest_family(hits: Column, start: Column, past: Column) -> Column:
    """The family named nearest to a span; of equally near names the longest, then the first."""
    gap = lambda h: F.when(h["past"] <= start, start - h["past"]).when(h["start"] >= past, h["start"] - past).otherwise(0)
    return F.array_min(F.transform(hits, lambda h: F.struct(gap(h).alias("a"), (-h["size"]).alias("b"), h["start"].alias("c"), h["seq"].alias("d"), h["family"].alias("family"))))["family"]


def references(docs: DataFrame, profile: Profile | str = "generic", doc_family: str | None = None) -> DataFrame:
    """From documents (doc_id, text) to one row per distinct citation, ordinal counting from 1 in each document.

    Citations stand in the order of patterns, then of places. With profiles that know families, those that no
    family can be told for are left out.
    """
    own = resolve(profile)
    tried = patterns(own, doc_family)
    docs = spread(docs.select("doc_id", "text"), "doc_id")
    base = docs.select("doc_id", rx.once(numbering.normalize_reference("text", own)).alias("body")).where("body <> ''")

    def matches(p: Pattern, number: int) -> Column:
        def one(raw: Column, gap: Column) -> Column:
            group = lambda g: F.regexp_extract(raw, p.pattern, g) if g else F.lit(None).cast("string")
            return F.struct(F.lit(number).alias("pattern"), F.length(gap).alias("gap"), raw.alias("raw"), F.lit(p.scheme).alias("scheme"), group(p.article).alias("article"), group(p.paragraph).alias("paragraph"), group(p.part).alias("part"), F.lit(p.family or doc_family).cast("string").alias("family"))

        found = F.regexp_extract_all("body", F.lit(p.pattern), F.lit(0))
        return F.when(F.col("body").rlike(p.pattern), F.zip_with(found, F.slice(rx.between(F.col("body"), p.pattern), F.lit(1), F.size(found)), one))

    some = F.flatten(F.filter(F.array(*(matches(p, i) for i, p in enumerate(tried))), lambda a: a.isNotNull()))
    flat = base.select("doc_id", rx.once(family_hits(F.lower("body"), own)).alias("hits"), F.col("body")).select("doc_id", "hits", F.posexplode(some).alias("i", "m"))
    # a match starts after all gaps and matches of its pattern that stand before it
    past = F.sum(F.col("m.gap") + F.length("m.raw")).over(Window.partitionBy("doc_id", "m.pattern").orderBy("i"))
    flat = flat.withColumn("past", past.cast("int")).withColumn("start", F.col("past") - F.length("m.raw"))
    found = flat.select(
        "doc_id", "m.pattern", "start", "m.raw", "m.scheme", rx.once(text.normalize_article_number(F.col("m.article"))).alias("article_number"), F.col("m.paragraph").alias("paragraph"), F.col("m.part").alias("part"),
        F.coalesce("m.family", nearest_family(F.col("hits"), F.col("start"), F.col("past"))).alias("doc_family"),
    ).where("article_number is not null")
    if own.requires_family:
        found = found.where("doc_family is not null")
    number = lambda c: text.extract_number(F.col(c)) if own.code == "ru" else F.lit(None).cast("string")
    found = found.select("*", F.explode(F.array(F.struct(number("paragraph").alias("paragraph_number"), number("part").alias("part_number")))).alias("x")).select("*", "x.*")
    key = ["scheme", "article_number", "paragraph_number", "part_number", "doc_family"]
    first = Window.partitionBy("doc_id", *key).orderBy("pattern", "start")
    order = Window.partitionBy("doc_id").orderBy("pattern", "start")
    kept = found.withColumn("n", F.row_number().over(first)).where("n = 1")
    return kept.select("doc_id", F.row_number().over(order).alias("ordinal"), "raw", *key)


def canonical_parts(refs: DataFrame, jurisdiction: Profile | str) -> DataFrame:
    """refs with canonical, a map of the parts that identify what is cited; null without an article number."""
    number = text.normalize_article_number
    parts = F.create_map(
        F.lit("jurisdiction"), F.lit(resolve(jurisdiction).code), F.lit("scheme"), F.lower(F.coalesce(F.nullif("scheme", F.lit("")), F.lit("article"))), F.lit("article_number"), number(F.col("article_number")), F.lit("doc_family"), F.nullif("doc_family", F.lit("")),
        F.lit("paragraph_number"), F.coalesce(number(F.col("paragraph_number")), F.nullif("paragraph_number", F.lit(""))), F.lit("part_number"), F.coalesce(number(F.col("part_number")), F.nullif("part_number", F.lit(""))),
    )
    return refs.withColumn("canonical", F.when(number(F.col("article_number")).isNotNull(), F.map_filter(parts, lambda _, x: x.isNotNull())))
