"""Scalar functions on text, as Columns. Null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rx


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def normalize_extracted(text: Column | str) -> Column:
    """Line feeds only, plain spaces and hyphens, lines tightened and stripped, at most one empty line in a row.

    Each step that few texts need first asks a cheap pattern; none matches what it would leave as it is.
    """
    gap = rx.WHITE[:-1] + r"&&[^\n]]"
    t = rx.gated(_text(text), r"[\r\x0C]", lambda x: F.regexp_replace(x, r"\r\n|[\r\x0C]", "\n"))
    t = rx.gated(t, r"[\x00\xAD\xA0\x{2009}\x{2011}\x{202F}]", lambda x: F.translate(x, "\u00a0\u202f\u2009\u2011\u00ad\u0000", "   -"))
    # a hyphen or the first space after a word: only there does the pattern look back
    t = rx.gated(t, "-", lambda x: F.regexp_replace(x, rf"{rx.PREFIX}(?:-(?<=\w-)|{gap}(?<=\w{gap}){gap}*-){gap}*(?=\w)", "-"))
    t = F.regexp_replace(t, r" [ \t\x0B]+|[\t\x0B][ \t\x0B]*", " ")
    # both ends of the text are stripped anyway; the line feed stands first, so the search rarely looks at a class
    t = rx.gated(t, rf"\n(?:{gap}|(?<={gap}\n))", lambda x: F.regexp_replace(x, rf"(?dm)^{gap}+|{gap}+$", ""))
    return rx.strip(rx.gated(t, r"\n\n\n", lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n")))


def normalize_chunk(text: Column | str) -> Column:
    """Stripped, with runs of white space as one space."""
    return rx.collapsed(_text(text))


def semantic_hash(text: Column | str) -> Column:
    """SHA-256 of the chunk-normalised text in hex."""
    return F.sha2(normalize_chunk(text).cast("binary"), 256)


def identity_hash(text: Column | str, profile: Column | str) -> Column:
    """SHA-256 of profile and chunk-normalised text."""
    own = F.lit(profile) if isinstance(profile, str) else profile
    return F.sha2(F.concat(own, F.lit(":"), normalize_chunk(text)).cast("binary"), 256)


def short_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first twelve hex digits of the SHA-256 of the joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(*parts).cast("binary"), 256), 1, 12))


def section_id(source_name: Column, path: Column, occurrence: Column) -> Column:
    return short_id("sec-", source_name, F.lit("::"), F.array_join(path, "||"), F.lit("::"), occurrence.cast("string"))


SUPERSCRIPTS, SUBSCRIPTS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "₀₁₂₃₄₅₆₇₈₉", "0123456789"


def normalize_numeric_scripts(text: Column | str) -> Column:
    """Superscript digits after a digit become a decimal part, subscript digits plain digits."""
    t = _text(text)
    after_dot = rf"{rx.PREFIX}(?<=\d)\.[{SUPERSCRIPTS}]+"
    after_digit = rf"{rx.PREFIX}(?<=\d)[{SUPERSCRIPTS}]+"

    def raised(x: Column) -> Column:
        plain = lambda m: F.translate(m["text"], SUPERSCRIPTS, DIGITS)
        return rx.let(rx.replaced(x, after_dot, plain), lambda y: rx.replaced(y, after_digit, lambda m: F.concat(F.lit("."), plain(m))))

    return F.translate(rx.gated(t, f"[{SUPERSCRIPTS}]", raised), SUBSCRIPTS, DIGITS)


def normalize_article_number(value: Column) -> Column:
    """Numeric scripts resolved, and 229(5), 229_5 or 229-5 as 229.5; null if nothing is left."""
    structured = rf"{rx.PREFIX}\A(\d{{2,4}})(?:\((\d{{1,2}})\)|_(\d{{1,2}})|-(\d))\z"
    own = F.regexp_replace(rx.strip(normalize_numeric_scripts(value)), structured, "$1.$2$3$4")
    return F.when(value.isNotNull(), rx.let(own, lambda t: F.when(t != "", t)))


def extract_number(raw: Column) -> Column:
    """The first whole or decimal number (one decimal part) of a number's text."""
    return rx.group(normalize_article_number(F.nullif(raw, F.lit(""))), rf"{rx.PREFIX}\d+(?:\.\d+)?", 0)


def preview(text: Column | str, max_chars: int = 240) -> Column:
    """Collapsed text, cut with an ellipsis where it is longer."""
    t = rx.collapsed(_text(text))
    return F.when(F.length(t) <= max_chars, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, max_chars - 1), rx.WHITE + r"+\z", ""), F.lit("…")))


def is_guidance_artifact(line: Column) -> Column:
    """A page number or a footnote between the lines of a court review."""
    s = rx.strip(F.coalesce(line, F.lit("")))
    lower = F.lower(s)
    note = s.rlike(rf"{rx.PREFIX}\A\d{{1,2}}\s+[А-Яа-яA-Za-z].{{0,160}}\z")
    return (s == "") | s.rlike(rf"{rx.PREFIX}\A\d{{1,3}}\z") | (note & (lower.contains("далее") | lower.contains("сноск")))


def normalize_guidance(text: Column | str) -> Column:
    """Points that start inside a line get a line of their own; artifacts go; one empty line at most."""
    t = F.regexp_replace(_text(text), rf"{rx.PREFIX}(?<!\n)[ \t]+(\d{{1,3}})\.\s*\n(?=[A-ZА-ЯЁ])", "\n$1. ")
    kept = F.transform(F.split(t, rx.LINE_ENDS, -1), rx.strip)
    kept = F.filter(kept, lambda s: (s == "") | ~s.rlike(rx.PREFIX + r"\A\d") | ~is_guidance_artifact(s))  # artifacts start with a digit
    return rx.strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def normalize_line(line: Column | str) -> Column:
    """One line of a page: plain spaces and hyphens, stripped."""
    plain = rx.gated(_text(line), "[\u00a0\u2011\u00ad]", lambda x: F.translate(x, "\u00a0\u2011\u00ad", " -"))
    return rx.let(F.regexp_replace(plain, r" [ \t]+|\t[ \t]*", " "), rx.trimmed)
