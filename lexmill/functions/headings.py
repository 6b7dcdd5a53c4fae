"""Which lines are headings: one Column for each profile and chunk policy.

Patterns are tried in the profile's order. A line that a numeric, roman or lettered pattern matches is decided
there: it is such a heading or none. So is one that an article, clause or paragraph pattern matches under the
guidance policy. For the rest an inadmissible match passes the line on to the next pattern.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import vocabulary as v
from ..plans.profiles import Profile, resolve
from . import rx

TYPE = "struct<kind:string,label:string,article_number:string,paragraph_number:string>"
#: Depth of each kind of section in the tree; any other kind is as deep as a part.
LEVELS = {"document_root": 0, "part": 1, "chapter": 2, "section": 3, "article": 4, "clause": 5, "paragraph": 6}
PREFIXED = rx.CASELESS + r"^[IVXLCDM]+\.\s+((?:part|chapter|section|schedule)\b.+)$"


def level(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))
    return F.coalesce(F.element_at(table, kind), F.lit(1))


def _pattern(kind: str, words: str, number: str, dash: str) -> str:
    """With the number as group 1 and the title as group 2."""
    if kind == "roman":
        own = r"^([IVXLCDM]+)(?:[.)]|\b)\s+([^\n]+)$"
    elif kind == "alpha":
        own = r"^([A-Z])\.(?:\s+|\s*[–-]\s*)([^\n]+)$"
    elif kind == "numeric":
        own = rf"^(\d+(?:\.\d+){{0,5}})[.)]?\s+([{words}].+)$"
    elif kind == "schedule":
        own = rf"^(?:{words})\s*(?:№|No\.?|N)?\s*({number})\.?\s*{dash}(.*)$"
    else:
        own = rf"^(?:{words})\s+({number})\.?\s*{dash}(.*)$"
    return rx.CASELESS + own


def _n_words(c: Column) -> Column:
    """Of a stripped text."""
    return F.regexp_count(c, F.lit(rx.WHITE + "+")) + 1


def _short(tail: Column, chars: int = 120, words: int = 14, marks: int = 1) -> Column:
    """Not empty, within the limits, and not starting with a small letter."""
    return (tail != "") & (F.length(tail) <= chars) & (F.regexp_count(tail, F.lit("[.!?;:]")) <= marks) & ~tail.rlike(r"^\p{IsLowercase}") & (_n_words(tail) <= words)


def _weak(tail: Column) -> Column:
    return F.lower(F.regexp_extract(tail, r"^[^\s]+", 0)).isin(v.WEAK_FIRST_WORDS)


def _phrase(tail: Column) -> Column:
    return ~tail.rlike(r"^[(,;:\-—]") & _short(tail) & ~_weak(tail)


def _heading(kind: str, label: Column, article: Column | None = None, paragraph: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), label.alias("label"), (none if article is None else article).alias("article_number"), (none if paragraph is None else paragraph).alias("paragraph_number"))


def _unpacked(by: Callable[[Column, Column, Column], Column]) -> Callable[[Column], Column]:
    return lambda p: rx.let(rx.trimmed(p["title"]), lambda tail: by(p["num"], p["title"], tail))


def _decided(line: Column, profile: Profile, policy: str) -> Column:
    """The heading of a stripped line that isn't empty; null or one without kind: none."""
    no = F.struct(*(F.lit(None).cast("string").alias(n) for n in ("kind", "label", "article_number", "paragraph_number")))
    words = 10 if policy in ("guidance", "case_law") else 14

    def numeric(num: Column, title: Column, tail: Column) -> Column:
        label = F.concat(F.lit("Section "), num, F.lit(". "), title)
        marked = num.contains(".") | F.substring(line, F.length(num) + 1, F.lit(1 << 20)).rlike(rx.PREFIX + r"^\s*[.)]")
        depth = F.regexp_count(num, F.lit(r"\."))
        deeper = no if policy == "guidance" else F.when(depth == 1, _heading("article", label, num)).otherwise(_heading("clause", label, None, num))
        return F.when(~(marked & _short(tail, words=words) & ~_weak(tail)), no).when(depth == 0, _heading("section", label)).otherwise(deeper)

    def symbolic(num: Column, title: Column, tail: Column) -> Column:
        fits = ~num.rlike(r"\p{IsLowercase}") & _short(tail, words=words)
        if profile.switch("block_signatures"):
            name = r"(?:(?:[A-Z]\.){1,3}|[A-Z][A-Z-]+)"
            fits &= ~((F.length(num) == 1) & tail.rlike(rf"^{name}(?:\s+{name}){{0,2}}$"))
        return F.when(fits, _heading("section", F.concat(F.lit("Section "), num, F.lit(". "), title))).otherwise(no)

    def worded(kind: str, num: Column, _title: Column, tail: Column) -> Column:
        label = F.concat(F.lit(f"{kind.capitalize()} "), num, F.when(tail != "", F.concat(F.lit(". "), tail)).otherwise(""))
        if kind in ("part", "chapter", "section", "schedule"):
            fits = (tail == "") | _short(tail, words=words)
            if kind == "section":
                fits &= _phrase(tail)
            return F.when(fits, _heading("other" if kind == "schedule" else kind, label))
        if kind == "article":
            cited = line.rlike(rx.CASELESS + r"\barticle\s+\d+\(")
            fits = ~tail.startswith("(") & ~tail.rlike(r"(?iu)\ATFEU") & ~cited & ((tail == "") | (tail.rlike(r"\p{IsAlphabetic}") & _short(tail)))
            return F.when(fits, _heading("article", label, num))
        if kind == "rule":
            limits = (140, 20, 4) if profile.switch("long_rule_titles") else (120, 14, 1)
            return F.when(~tail.startswith("(") & _short(tail, *limits) & ~_weak(tail), _heading("article", label, num))
        return F.when(_phrase(tail), _heading(kind, label, None, num))

    tried = []
    for kind, keywords, number, dash in v.HEADINGS[profile.code]:
        pattern = _pattern(kind, keywords, number, dash)
        if policy == "guidance" and kind in ("article", "clause", "paragraph"):
            tried.append(F.when(line.rlike(pattern), no))
            continue
        parts = F.struct(F.regexp_extract(line, pattern, 1).alias("num"), F.regexp_extract(line, pattern, 2).alias("title"))

        by = {"numeric": numeric, "roman": symbolic, "alpha": symbolic}.get(kind, partial(worded, kind))
        tried.append(F.when(line.rlike(pattern), rx.let(parts, _unpacked(by))))
    return F.coalesce(*tried)


def _start(profile: Profile) -> str:
    """How any heading starts: a keyword, a numeral, a digit or a letter with a point. Few lines get further."""
    words = [w for kind, w, _, _ in v.HEADINGS[profile.code] if kind not in ("roman", "alpha", "numeric")]
    return rx.CASELESS + rf"\A(?:[IVXLCDM]+(?:[.)]|\b)|\d|[A-Z]\.|{'|'.join(words)})"


def detect_heading(line: Column, profile: Profile | str = "generic", policy: str = "default") -> Column:
    """struct(kind, label, article_number, paragraph_number), or null where the line is no heading."""
    own = resolve(profile)

    def found(text: Column) -> Column:
        likely = text.rlike(_start(own))
        rest = rx.strip(F.regexp_extract(text, PREFIXED, 1))
        candidates = F.when(text.rlike(PREFIXED), F.array(rest, text)).otherwise(F.array(text))
        decided = F.filter(F.transform(candidates, lambda t: _decided(t, own, policy)), lambda h: h["kind"].isNotNull())
        return F.when(likely, F.get(decided, F.lit(0)))

    return rx.let(F.coalesce(line, F.lit("")), lambda t: rx.let(rx.trimmed(t), found))
