"""Main text of web pages by line-block distribution.

1. Markup is stripped into lines, one for each block of text, in page order; a line knows the elements around
   it. Text of scripts, styles, forms and comments is no line. Lines inside page furniture (menus, headers,
   footers, sidebars, notices, adverts, reader comments: by element, role, class or id) are dropped. A class or
   id names furniture if all its parts do. Such a name doesn't count on an element with THRESHOLD characters and
   most of the page's text (unless another part is marked as the article), nor around the only article.
2. If the page marks an article (or main), all lines inside it are kept, and the distribution decides nothing.
3. Otherwise lines that are mostly links, save single links and sentences in paragraphs, count as empty. The
   length of a line block is the sum over WINDOW lines from there. Runs of text end where a whole window is empty.
   A run is kept if one of its blocks reaches the threshold, or the page's largest block if that is less; so
   is a run with a line in the same element as a line of these.

White space, that of references such as &nbsp; included, becomes one space; <br> is white space. Blocks are
joined by one line feed.

Defined results: null and empty pages give an empty text, as do pages of furniture only, and unmarked pages
with a single word. Pages cut off in a
tag lose that tag. A quote that isn't closed before more of the tag ends the tag at the next ">". The time grows with
the page, whatever its markup. Unclosed paragraphs end where the next block starts. Repeated rows give repeated results;
null ids and urls are kept. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WINDOW, THRESHOLD = 3, 80

# Element names of HTML by what they mean here.
RAW = "script style noscript template svg math iframe object canvas audio video textarea select title".split()
FURNITURE = frozenset("nav footer aside form button dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_BEFORE = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
MARKS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar topbar widget widgets".split())
#: Words that leave the meaning of a mark as it is: related-posts, but not related-work.
BESIDE = frozenset("area articles bar block bottom box btn button buttons col column container content fixed form global group icons inner item items layer left links list main media news overlay page panel post posts primary right secondary section site slot small stories sticky top unit wrap wrapper".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

NAME, KEY, PLAIN, GAP = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"[^\s/>=]+|="), re.compile(r"[^\s>]*"), re.compile(r"[\s/]*")
EQUALS = re.compile(r"\s*=\s*")
CLOSES = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
#: Raw elements that hold text only, whatever it looks like; the others are skipped as a whole where they are closed.
OPAQUE = frozenset("script style textarea title iframe noscript template".split())


class Scanner:
    """The tags of a page, in one pass from left to right.

    Places of the next quote or bracket are kept until the scan has passed them, and what was once sought in vain isn't
    sought again, so the time grows with the page however its markup is broken.
    """

    def __init__(self, page: str) -> None:
        self.page, self.ahead = page, dict[str, int]()

    def next(self, sign: str, at: int) -> int:
        """The first place of sign from at on; the page's end if there is none."""
        known = self.ahead.get(sign, -1)
        if known < at:
            known = self.page.find(sign, at)
            self.ahead[sign] = known = len(self.page) if known < 0 else known
        return known

    def closed(self, name: str, at: int) -> int | None:
        """Past the next end tag of that name; none if there is none."""
        key = "/" + name
        if self.ahead.get(key, -1) < at:
            found = CLOSES[name].search(self.page, at)
            self.ahead[key] = found.end() if found else len(self.page) + 1
        return None if self.ahead[key] > len(self.page) else self.ahead[key]

    def quoted(self, at: int) -> tuple[str, int] | None:
        """A quoted value and the place past it; none where the quote isn't closed before more of the tag."""
        end = self.next(self.page[at], at + 1)
        if end == len(self.page) or self.page[end + 1 : end + 2].strip() not in ("", "/", ">"):
            return None
        return self.page[at + 1 : end], end + 1

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], bool, int]:
        """Attributes from a tag's name on, whether the tag closes itself, and the place past it (the page's end: cut off)."""
        found, size = [], len(self.page)
        while True:
            before, at = at, GAP.match(self.page, at).end()
            if at >= size:
                return found, False, size
            if self.page[at] == ">":
                return found, at > before and self.page[at - 1] == "/", at + 1
            if (key := KEY.match(self.page, at)) is None:
                return found, False, size
            at, value = key.end(), ""
            if key[0] != "=" and (equals := EQUALS.match(self.page, at)):
                at = equals.end()
                if self.page[at : at + 1] in ("'", '"') and at < size:
                    if (own := self.quoted(at)) is None:  # never closed: the tag ends where it can
                        return found, False, min(size, self.next(">", at) + 1)
                    value, at = own
                else:
                    plain = PLAIN.match(self.page, at)
                    value, at = plain[0], plain.end()
            elif key[0][0] in "'\"" and self.next(key[0][0], key.start() + 1) < self.next(">", at):
                at = self.next(key[0][0], key.start() + 1) + 1  # a stray quoted string
            found.append((key[0].lower(), value))

    def tags(self) -> Iterator[tuple[int, int, str, bool, list[tuple[str, str]]]]:
        """(start, past, name, closes, attributes) of all that isn't text; name is empty for what means nothing."""
        at, page, size = 0, self.page, len(self.page)
        while (start := self.next("<", at)) < size:
            close = page[start + 1 : start + 2] == "/"
            name = NAME.match(page, start + 1 + close)
            if page.startswith("<!--", start):
                at = min(size, self.next("-->", start + 4) + 3)
                yield start, at, "", False, []
            elif name is None and page[start + 1 : start + 2] in ("!", "?", "/"):
                at = min(size, self.next(">", start) + 1)
                yield start, at, "", False, []
            elif name is None:  # a sign, as in a < b
                at = start + 1
            else:
                own = name[0].lower()
                attrs, alone, at = self.attributes(name.end())
                if at >= size and page[-1:] != ">":
                    own = ""
                elif own in CLOSES and not close and not (alone and own in ("svg", "math")):
                    past = self.closed(own, at)
                    at = past if past is not None else size if own in OPAQUE else at
                    own = ""
                yield start, at, own, close, attrs


PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Line:
    text: str
    linked: int
    links: int
    marks: tuple[tuple[int, str], ...]  # elements around it that look like furniture, by number and kind
    inner: tuple[tuple[int, str], ...]  # those of them inside the innermost article
    article: bool
    paragraph: bool
    parent: int


def furniture(name: str, attrs: list[tuple[str, str]], inside: bool) -> str:
    """How an element starts page furniture: sure, named, comments or not (empty). inside: it stands in an article."""
    if name in FURNITURE or name == "header" and not inside:
        return "sure"
    if not attrs or name in ("html", "body", "article", "main") and not any("comment" in value.lower() for _, value in attrs):
        return ""
    kind = ""
    for key, value in attrs:
        if key in ("class", "id"):
            for token in value.split():
                own = {p.lower() for p in PARTS.findall(token)}
                if own & MARKS and own <= MARKS | BESIDE:
                    kind = "comments" if own & COMMENTS else kind or "named"
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return "sure"
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "sure"
    return kind


def lines(page: str) -> list[Line]:
    """The blocks of a page in order."""
    found: list[Line] = []
    stack: list[tuple] = [("", (), (), False, 0)]  # name, marks, inner, in an article, number
    text: list[str] = []
    linked = links = number = 0

    def end_line() -> None:
        nonlocal linked, links
        if joined := " ".join("".join(text).split()):
            _, marks, inner, inside, _ = stack[-1]
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in BLOCKS), 0)
            found.append(Line(joined, linked, links, marks, inner, inside, stack[at][0] == "p", stack[max(0, at - 1)][4]))
        text.clear()
        linked = links = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            decoded = entities.unescape(raw)
            text.append(decoded)
            if any(name == "a" for name, *_ in stack[-3:]):
                linked += len(decoded)

    last = 0
    for start, past, name, close, attrs in Scanner(page).tags():
        add(page[last:start])
        last = past
        if not name:
            continue
        if name in VOID:
            if name == "hr":
                end_line()
            elif name == "br":
                text.append(" ")
            continue
        if name in BLOCKS:
            end_line()
        if close:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if name not in BLOCKS and stack[i][0] in BLOCKS:
                    break
            continue
        if name in BLOCKS:
            while len(stack) > 1 and (stack[-1][0] not in BLOCKS or stack[-1][0] == "p" or stack[-1][0] in ENDS_BEFORE.get(name, ())):
                if stack[-1][0] in ("li", "dd", "dt", "td", "th", "tr", "option") and stack[-1][0] not in ENDS_BEFORE.get(name, ()):
                    break
                stack.pop()
        links += name == "a"
        number += 1
        _, marks, inner, inside, _ = stack[-1]
        inside = inside or name in ("article", "main") or ("role", "main") in attrs
        if name == "main":
            marks = inner = ()
        elif name == "article" and all(kind != "comments" for _, kind in inner):
            inner = ()
        if kind := furniture(name, attrs, inside):
            marks, inner = (*marks, (number, kind)), (*inner, (number, kind))
        stack.append((name, marks, inner, inside, number))
    add(page[last:])
    end_line()
    return found


def main_text(page: str | None) -> str:
    """The kept blocks of a page, joined by line feeds."""
    own = lines(page or "")
    if not any(x.article and not x.marks for x in own):  # what is around the only article isn't furniture
        for x in own:
            x.marks = x.inner if x.article else x.marks
    plain = [x for x in own if all(kind == "named" for _, kind in x.marks)]
    held: dict[int, int] = {}
    for x in plain:
        for n, _ in x.marks:
            held[n] = held.get(n, 0) + len(x.text)
    most = {n for n, size in held.items() if size >= THRESHOLD and size * 2 > sum(len(x.text) for x in plain)}
    if any(x.article and not x.marks for x in plain):
        most = set()
    own = [x for x in plain if all(n in most for n, _ in x.marks)]
    if any(x.article for x in own):
        return "\n".join(x.text for x in own if x.article)
    if len(own) == 1 and " " not in own[0].text:
        return ""
    heavy = [x.linked * 2 > len(x.text) for x in own]
    size = []
    for i, x in enumerate(own):
        sentence = x.paragraph and (x.links == 1 or x.linked + 3 < len(x.text))
        alone = x.links == 1 and not any(heavy[max(0, i - 1) : i] + heavy[i + 1 : i + 2])
        size.append(0 if heavy[i] and not sentence and not alone else len(x.text))
    block = [sum(size[i : i + WINDOW]) for i in range(len(size))]
    runs: list[list[int]] = [[]]
    for i in range(len(own)):
        if not block[i]:
            runs.append([])
        elif size[i]:
            runs[-1].append(i)
    enough = min(THRESHOLD, max(block, default=0))
    dense = [any(block[i] >= enough for i in run) for run in runs]
    around = {own[i].parent for run, is_dense in zip(runs, dense, strict=True) if is_dense for i in run}
    return "\n".join(own[i].text for run, is_dense in zip(runs, dense, strict=True) if is_dense or any(own[i].parent in around for i in run) for i in run)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
