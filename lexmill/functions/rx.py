"""Regular expressions in Java that behave like those of Python's re on text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Only \n ends a line; \w, \d, \s and \b know all of Unicode; case folding too (with i).
PREFIX, CASELESS = "(?dU)", "(?diuU)"
#: All that Python's str.strip() and \s take as white space. The first class turns most letters away at once.
WHITE = r"[[^!-~\xA1-\x{167F}]&&[\s\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
WHITE_CHARS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_ENDS = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\x{2028}\x{2029}]"
META = set(".^$*+?{}[]\\|()-&#~")


def escape(text: str) -> str:
    return "".join("\\" + c if c in META else c for c in text)


def alternatives(words: list[str]) -> str:
    """One group that matches any of the words, longest (as escaped) first; nothing if there are none."""
    return "(?:" + "|".join(sorted(map(escape, words), key=len, reverse=True)) + ")" if words else "(?!x)x"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """value as the one row of a generator: the optimiser doesn't copy it into filters and later projections."""
    return F.explode(F.array(value))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_CHARS))


def trimmed(c: Column) -> Column:
    """strip() of a value that may be named several times: a column, a field or a bound variable.

    Most texts start and end with a visible ASCII character, which is far cheaper to see than to trim.
    """
    visible = lambda x: F.ascii(x).between(33, 126)
    return F.when(visible(c) & visible(F.substring(c, -1, 1)), c).otherwise(strip(c))


def collapsed(c: Column) -> Column:
    """strip(), and runs of white space as one space. Single spaces aren't matched, since most already are."""
    return F.regexp_replace(strip(c), rf" {WHITE}+|{WHITE[:-1]}&&[^ ]]{WHITE}*", " ")


def gated(c: Column, needs: str, change: Callable[[Column], Column]) -> Column:
    """change(c) where c has a match of needs, a cheap pattern; else c."""
    return let(c, lambda t: F.when(t.rlike(needs), change(t)).otherwise(t))


def group(c: Column, pattern: str, number: int) -> Column:
    """A group of the first match, null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, number), F.lit(""))


#: Stands for a match where a text is split; texts that have it themselves are split by the pattern.
MARK = "\ue000"
BLOCK = 64


def before(sizes: Column, more: Column | None = None) -> Column:
    """The sum of all sizes before each element, plus the element of more at its place.

    Sums go block by block, so long arrays aren't summed over and over.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    own = lambda x: x["own"]

    def placed(x: Column) -> Column:
        at = lambda i: total(F.slice(x["blocks"], F.lit(1), F.floor(i / BLOCK).cast("int"))) + total(F.slice(own(x), F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
        return F.transform(own(x), lambda _, i: at(i) + (F.get(x["more"], i) if more is not None else F.lit(0)))

    n = F.greatest(F.lit(1), F.ceil(F.size(sizes) / BLOCK).cast("int"))
    blocks = F.transform(F.sequence(F.lit(1), n), lambda b: total(F.slice(sizes, (b - 1) * BLOCK + 1, F.lit(BLOCK))))
    fields = [sizes.alias("own"), blocks.alias("blocks")] + ([more.alias("more")] if more is not None else [])
    return let(F.struct(*fields), placed)


def between(c: Column, pattern: str) -> Column:
    """What stands before, between and after the matches. split() would compile the pattern for every row."""
    return F.when(c.contains(MARK), F.split(c, pattern, -1)).otherwise(F.split(F.regexp_replace(c, pattern, MARK), MARK, -1))


def spans(c: Column, pattern: str) -> Column:
    """All matches in order: array of struct(start, past, text), counted in characters from 0.

    The pattern mustn't match the empty string, nor must a match depend on an earlier one's end.
    """

    def placed(x: Column) -> Column:
        found, gaps = x["found"], x["gaps"]
        starts = before(F.transform(found, lambda f, i: F.length(F.get(gaps, i)) + F.length(f)), F.transform(gaps, F.length))
        return F.zip_with(found, starts, lambda f, at: F.struct(at.alias("start"), (at + F.length(f)).alias("past"), f.alias("text")))

    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return let(F.struct(found.alias("found"), between(c, pattern).alias("gaps")), placed)


def replaced(c: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """c with each match replaced by a function of struct(start, past, text)."""

    def put(found: Column) -> Column:
        return F.array_join(F.transform(between(c, pattern), lambda b, i: F.concat(b, F.coalesce(by(F.get(found, i)), F.lit("")))), "")

    return F.when(c.rlike(pattern), let(spans(c, pattern), put)).otherwise(c)
