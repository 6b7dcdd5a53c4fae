"""Court reviews and other guidance: numbered points, and the decisions that they cite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rx
from ..plans import vocabulary as v
from ..plans.profiles import Profile, resolve

POINT = r"(?dUm)^(?:(?iu:пункт)\s+)?\d{1,3}\.\s+(?=[A-ZА-ЯЁ])"
CITED = rx.CASELESS + r"\A(?:определение\s+судебной\s+коллегии|см\.\s+также)\b"


def split_blocks(body: Column, any_start: bool = True, min_points: int = 1) -> Column:
    """array of struct(method, text, number, start): guidance_preamble, guidance_point or guidance_paragraph.

    A start after № isn't one, nor is one whose first line only cites a decision. Each test looks at the gaps beside
    a start only, and blocks are put together from gaps, so the work grows with the text. start (of preamble and
    points) counts characters of the stripped text.
    """
    block = lambda m, t, n=None, at=None: F.struct(F.lit(m).alias("method"), t.alias("text"), F.lit(n).cast("string").alias("number"), F.lit(at).cast("int").alias("start"))

    def found(text: Column) -> Column:
        return F.struct(text.alias("body"), F.regexp_extract_all(text, F.lit(POINT), F.lit(0)).alias("starts"), rx.between(text, POINT).alias("gaps"))

    def kept(x: Column) -> Column:
        starts, gaps = x["starts"], x["gaps"]
        first = lambda i: F.substring_index(F.get(gaps, i + 1), "\n", 1)
        good = lambda i: ~F.rtrim(F.get(gaps, i), F.lit(rx.WHITE_CHARS)).endswith("№") & ~first(i).rlike(CITED)
        at = F.filter(F.transform(starts, lambda _, i: F.when(good(i), i)), lambda i: i.isNotNull())
        pieces = F.transform(starts, lambda s, i: F.concat(s, F.get(gaps, i + 1)))
        return F.struct(x["body"].alias("body"), F.get(gaps, F.lit(0)).alias("first"), starts.alias("starts"), pieces.alias("pieces"), at.alias("at"))

    def placed(x: Column) -> Column:
        sizes = F.concat(F.array(F.length(x["first"])), F.transform(x["pieces"], F.length))
        numbers = F.transform(x["at"], lambda i: F.regexp_extract(F.get(x["starts"], i), r"\d{1,3}", 0))
        return F.struct(x["body"].alias("body"), x["first"].alias("first"), x["pieces"].alias("pieces"), x["at"].alias("at"), numbers.alias("numbers"), rx.before(sizes).alias("offsets"))

    def cut(x: Column) -> Column:
        body, at, numbers = x["body"], x["at"], x["numbers"]
        whole = F.array(block("guidance_paragraph", body))
        nothing = F.filter(whole, lambda _: F.lit(False))
        paragraphs = F.transform(F.filter(F.transform(F.split(body, r"\n{2,}"), rx.strip), lambda p: p != ""), lambda p: block("guidance_paragraph", p))
        joined = lambda first, past: F.array_join(F.slice(x["pieces"], first + 1, past - first), "")
        preamble = rx.strip(F.concat(x["first"], joined(F.lit(0), F.coalesce(F.get(at, F.lit(0)), F.lit(0)))))
        own = F.transform(at, lambda i, k: block("guidance_point", rx.strip(joined(i, F.coalesce(F.get(at, k + 1), F.size(x["pieces"])))), F.get(numbers, k), F.get(x["offsets"], i + 1)))
        pointed = F.concat(F.when(preamble != "", F.array(block("guidance_preamble", preamble, None, 0))).otherwise(nothing), F.filter(own, lambda b: b["text"] != ""))
        few = F.size(at) < max(1, min_points)
        if not any_start:
            few = few | (F.get(numbers, F.lit(0)).cast("int") != 1)
        pairs = F.size(F.filter(F.transform(numbers, lambda n, k: F.get(numbers, k + 1).cast("int") == n.cast("int") + 1), lambda ok: F.coalesce(ok, F.lit(False))))
        return F.when(body == "", nothing).when(few, whole).when(pairs < max(0, min_points - 1), paragraphs).otherwise(pointed)

    own = rx.let(rx.strip(F.coalesce(body, F.lit(""))), found)
    for step in (kept, placed, cut):
        own = rx.let(own, step)
    return own


def is_pointed(blocks: Column) -> Column:
    return F.exists(blocks, lambda b: b["method"] == "guidance_point")


CASE = ["source_case_reference", "source_case_number", "source_case_date", "source_case_court"]


def case_metadata(body: Column, profile: Profile | str, doc_kind: str | None = None, scope: str = "review_point") -> Column:
    """struct of CASE: the decision that a point cites (Russian reviews)."""
    if resolve(profile).code != "ru":
        return F.struct(*(F.lit(None).cast("string").alias(n) for n in CASE))
    view = rx.strip(F.coalesce(body, F.lit("")))
    if (doc_kind or "").strip().lower() == "court_guidance" and scope == "review_point":
        view = rx.strip(F.regexp_replace(view, rx.CASELESS + v.CASE_STRIP, ""))

    def cited(text: Column) -> Column:
        tails = F.regexp_extract_all(text, F.lit(rx.CASELESS + v.CASE_TAIL), F.lit(1))
        first = F.get(F.regexp_extract_all(text, F.lit(rx.CASELESS + v.CASE_PREFIXED), F.lit(1)), F.lit(0))
        last = rx.let(tails, lambda t: F.get(t, F.size(t) - 1))
        return F.struct(text.alias("text"), rx.strip(F.coalesce(first, last)).alias("reference"))

    def fields(found: Column) -> Column:
        reference, court = found["reference"], F.lit(None).cast("string")
        for where in (found["text"], reference):  # the reference itself goes first
            for label, names in reversed(v.COURTS):
                court = F.when(where.rlike(rx.CASELESS + rx.alternatives(names)), label).otherwise(court)
        field = lambda p: rx.strip(rx.group(reference, rx.CASELESS + p, 1))
        return F.struct(reference.alias(CASE[0]), field(v.CASE_NUMBER).alias(CASE[1]), field(v.CASE_DATE).alias(CASE[2]), F.when(reference.isNotNull(), court).alias(CASE[3]))

    return rx.let(rx.let(view, cited), fields)
