"""Cleaning and shortening of text, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it. Spark finds
    repeated expressions itself, but not inside lambdas and not across conditions.

    The value is the greatest of one: to take the first element, Spark goes through the whole
    expression for its type at every row. A value that has no order (a map, a variant) is left to ``let_any``."""
    return F.array_max(F.transform(F.array(c), use))


def let_any(c: Column, use: Callable[[Column], Column]) -> Column:
    """``let`` for values of any type."""
    return F.transform(F.array(c), use)[0]


def once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """``df`` with a column that is worked out once a row. A filter on a plain column is pushed
    below the projection that makes it, and works it out again; it doesn't pass a generator."""
    return df.select("*", F.explode(F.array(c)).alias(name))


#: Fixed value: what a pattern with (?U) takes for white space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.trim(c, F.lit(SPACES))


def holds(c: Column, *parts: str) -> Column:
    """Whether a text has one of the parts: a search of bytes, far cheaper than a pattern."""
    return reduce(Column.__or__, [F.contains(c, F.lit(p)) for p in parts])


def where_held(c: Column, change: Callable[[Column], Column], *parts: str) -> Column:
    """``change`` of a text that has one of the parts; without them there is nothing to change."""
    return let(c, lambda x: F.when(holds(x, *parts), change(x)).otherwise(x))


#: White space other than the blank. One range keeps most characters from the many single ones.
_ODD_SPACE = "[\t\n\x0b\f\r\x85\xa0[\u1680-\u3000&&[" + "".join(c for c in SPACES if c > "\xa0") + "]]]+"


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends. Single blanks are left alone."""
    return F.trim(where_held(F.regexp_replace(c, _ODD_SPACE, " "), lambda x: F.regexp_replace(x, "  +", " "), "  "))


def begins_with_letter(c: Column) -> Column:
    """Whether the first character is of A-Z or a-z. No pattern of markers, links, images and tags
    begins with one, so that letter is still there when they have gone."""
    return F.ascii(c).bitwiseOR(F.lit(32)).between(97, 122)


def unlink(c: Column) -> Column:
    """A Markdown link leaves its text."""
    return F.regexp_replace(c, r"\[([^\]]+)\]\([^)]*\)", "$1")


def drop_images(c: Column) -> Column:
    return F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", " ")


def drop_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", " ")


def shorten(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three of a cut text being dots."""
    cut = lambda x: F.concat(F.regexp_replace(F.substring(x, 1, limit - 3), r"(?U)\s+$", ""), F.lit("..."))
    return let(c, lambda x: F.when(F.length(x) <= limit, x).otherwise(cut(x)))


def clean_sentence(c: Column, limit: int = 500) -> Column:
    return shorten(collapse(where_held(c, lambda x: drop_tags(unlink(drop_images(x))), "](", "<")), limit)


def shorten_items(c: Column, items: int, limit: int) -> Column:
    """The first items of an array of strings, each cleaned and shortened, no empty ones."""
    return F.filter(F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, items), lambda x: clean_sentence(F.coalesce(x, F.lit("")), limit)), lambda x: x != "")


def bars(c: Column) -> Column:
    """How many pipes a line has."""
    return F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit("")))


def clean_abstract(c: Column, limit: int) -> Column:
    """An abstract without images, tags, table rows, link targets and Markdown marks; cut hard."""
    lines = F.transform(F.split(drop_tags(drop_images(c)), r"\R"), strip)
    text = F.array_join(F.filter(lines, lambda x: bars(x) < 2), "\n")
    text = collapse(F.regexp_replace(unlink(text), r"[`*_{}]", ""))
    return strip(F.substring(text, 1, limit))


def _bare_heading(line: Column) -> Column:
    """A line without heading marks, section numbers and marks around it."""
    plain = F.regexp_replace(strip(line), r"(?U)^#+\s*", "")
    plain = F.regexp_replace(plain, r"(?U)^\d+(?:\.\d+)*\s+", "")
    return F.regexp_replace(plain, r"^[ *:_\-\t]+|[ *:_\-\t]+$", "")


def _may_begin(line: Column, letters: str) -> Column:
    """Whether a bare heading may begin with one of the letters: a look at the line's first
    characters, so that only few lines are made bare. Other letters than ASCII ones may."""
    return line.rlike(rf"(?U)^[\s#\d.*:_\-]*[{letters}{letters.upper()}[^\x00-\x7f]]")


def abstract_marker(line: Column) -> Column:
    """What follows an abstract's marker on its own line: empty for a bare marker, null for none."""
    tail = r"(?iU)^(?:abstract|a\s*b\s*s\s*t\s*r\s*a\s*c\s*t)\s*[:.-]\s*(.+)$"

    def said(bare: Column) -> Column:
        return F.when(F.lower(F.regexp_replace(bare, r"(?U)\s+", "")) == "abstract", F.lit("")).when(bare.rlike(tail), strip(F.regexp_extract(bare, tail, 1)))

    return F.when(_may_begin(line, "a"), let(_bare_heading(line), said))


#: Headings at which an abstract ends, and titles that aren't one.
ABSTRACT_STOPS = ["introduction", "keywords", "key words", "index terms", "background", "related work", "references", "acknowledg", "method"]
NOT_TITLES = ["abstract", "keywords", "introduction"]
ABSTRACT_FROM, ABSTRACT_LINES, ABSTRACT_LEAST, TITLE_FROM = 250, 160, 30, 80


def abstract_stop(line: Column) -> Column:
    stops = F.array(*[F.lit(s) for s in ABSTRACT_STOPS])
    stop = let(F.lower(_bare_heading(line)), lambda bare: (bare != "") & F.exists(stops, lambda s: (bare == s) | F.startswith(bare, F.concat(s, F.lit(":")))))
    return _may_begin(line, "".join(sorted({s[0] for s in ABSTRACT_STOPS}))) & stop


def extract_abstract(md: Column, limit: int) -> Column:
    """The abstract of a parsed paper: from its marker in the first lines to the next stop or heading; empty if none."""

    def at_marker(m: Column) -> Column:
        at = F.array_position(F.transform(m["marked"], lambda x: x.isNotNull()), True).cast("int")
        return let(at, lambda at: F.when(at > 0, let(F.struct(F.element_at(m["marked"], at).alias("first"), F.slice(m["lines"], at + 1, F.lit(ABSTRACT_LINES)).alias("body")), whole)))

    def whole(p: Column) -> Column:
        heading = lambda line: line.rlike(r"(?U)^\s*#{1,6}\s+\S")
        # a heading ends what has begun; right after a bare marker it belongs to it
        ends = F.transform(p["body"], lambda line, i: abstract_stop(line) | (heading(line) & ((p["first"] != "") | (i > 0))))
        kept = let(F.array_position(ends, True).cast("int"), lambda end: F.when(end > 0, F.slice(p["body"], F.lit(1), end - 1)).otherwise(p["body"]))
        head = F.when(p["first"] != "", F.array(p["first"])).otherwise(F.array().cast("array<string>"))
        return let(clean_abstract(F.array_join(F.concat(head, kept), "\n"), limit), lambda t: F.when(F.length(t) >= ABSTRACT_LEAST, t))

    marked = lambda lines: F.struct(lines.alias("lines"), F.transform(F.slice(lines, 1, ABSTRACT_FROM), abstract_marker).alias("marked"))
    return F.coalesce(let(F.split(md, r"\R"), lambda lines: let(marked(lines), at_marker)), F.lit(""))


def extract_title(md: Column, limit: int = 300) -> Column:
    """The first heading of level one to three that names no standard part; empty if none."""
    pattern = r"(?U)^#{1,3}\s+(.+?)\s*#*\s*$"
    lines = F.filter(F.transform(F.slice(F.split(md, r"\R"), 1, TITLE_FROM), strip), lambda x: x.startswith("#") & x.rlike(pattern))
    titles = F.transform(lines, lambda x: clean_sentence(F.regexp_extract(x, pattern, 1), limit))
    fit = F.filter(titles, lambda t: ~F.lower(F.regexp_replace(t, r"(?U)\s+", "")).isin(NOT_TITLES))
    return F.coalesce(F.try_element_at(fit, F.lit(1)), F.lit(""))


def split_sentences(c: Column) -> Column:
    """An array of sentences; a sentence ends before a capital, a digit or an opening bracket."""
    # after collapse all white space is single blanks between other characters
    parts = F.split(collapse(c), r" (?<=[.!?。！？] )(?=[A-Z0-9\[【])", -1)
    return F.filter(parts, lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\b[\w'-]+\b"))
