"""Citation markers: their syntax, expansion and removal, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import begins_with_letter, clean_sentence, holds, let, strip, where_held

#: The syntax of citation markers.
SPLIT_RANGE = r"\[\s*(\d+)\s*\]\s*(?:-{1,2}|[–—])\s*\[\s*(\d+)\s*\]"
_ITEM = r"\s*\d+\s*(?:[-–—]\s*\d+)?\s*"
BRACKET = rf"\[({_ITEM}(?:[,;]{_ITEM})*)\]"
SOURCE = r"【\s*(\d+)\s*†[^】]*】"
MARKER = rf"(?:{BRACKET}|{SOURCE})"
#: A range of more numbers than this is no citation.
WIDEST = 500


def join_split_ranges(c: Column) -> Column:
    """``[39]-[56]`` becomes ``[39-56]``."""
    return where_held(c, lambda x: F.regexp_replace(x, SPLIT_RANGE, "[$1-$2]"), "[")


def has_marker(c: Column) -> Column:
    return join_split_ranges(c).rlike(MARKER)


def has_bracket(c: Column) -> Column:
    return c.rlike(BRACKET)


def _plain(digits: Column) -> Column:
    """A number without leading zeros."""
    return let(digits, lambda x: F.when(F.startswith(x, F.lit("0")), F.regexp_replace(x, r"^0+(?=\d)", "")).otherwise(x))


def expand(group: Column) -> Column:
    """The ordered distinct numbers of ``1, 3-5; 9``, as strings. Reversed and very wide
    ranges give none; so does a number of over 18 digits in a range."""
    range_ = r"^(\d{1,18})\s*[-–—]\s*(\d{1,18})$"
    nothing = F.array().cast("array<string>")

    def run(ends: Column) -> Column:
        low, high = ends["low"], ends["high"]
        valid = (low <= high) & (high - low <= WIDEST)
        return F.when(valid, F.transform(F.sequence(low, F.when(valid, high).otherwise(low)), lambda i: i.cast("string"))).otherwise(nothing)

    def numbers(part: Column) -> Column:
        ends = F.struct(F.regexp_extract(part, range_, 1).cast("long").alias("low"), F.regexp_extract(part, range_, 2).cast("long").alias("high"))
        return F.when(part.rlike(r"^\d+$"), F.array(_plain(part))).when(part.rlike(range_), let(ends, run)).otherwise(nothing)

    several = lambda x: F.array_distinct(F.flatten(F.transform(F.transform(F.split(x, "[,;]"), strip), numbers)))
    return let(group, lambda x: F.when(x.rlike(r"^\d+\z"), F.array(_plain(x))).otherwise(several(x)))


def marker_indices(marker: Column) -> Column:
    """What one whole marker cites: numbers, or ``source:n`` for an opaque source."""
    inner = F.regexp_extract(marker, rf"^{BRACKET}$", 1)
    source = F.concat(F.lit("source:"), _plain(F.regexp_extract(marker, rf"^{SOURCE}$", 1)))
    return F.when(F.startswith(marker, F.lit("【")) & marker.rlike(rf"^{SOURCE}$"), F.array(source)).otherwise(expand(inner))


def markers(sentence: Column) -> Column:
    """An array of (marker, before, after): every marker with the text on both sides of it."""
    length = lambda array, n: F.aggregate(F.slice(array, 1, n), F.lit(0), lambda s, x: s + F.length(x))

    def placed(text: Column, found: Column) -> Column:
        def at(marker: Column, begin: Column) -> Column:
            return let(begin, lambda at: F.struct(marker.alias("marker"), F.substr(text, F.lit(1), at).alias("before"), F.substr(text, at + F.length(marker) + 1).alias("after")))

        each = lambda between: F.transform(found, lambda marker, i: at(marker, length(between, i + 1) + length(found, i)))
        # a single marker stands where its text first stands: a marker is one whatever is around it
        alone = F.transform(found, lambda marker: at(marker, F.instr(text, marker) - 1))
        return F.when(F.size(found) < 2, alone).otherwise(let(F.split(text, MARKER, -1), each))

    return let(sentence, lambda text: let(F.regexp_extract_all(text, F.lit(f"({MARKER})"), F.lit(1)), lambda found: placed(text, found)))


def drop_numeric(c: Column) -> Column:
    return where_held(c, lambda x: F.regexp_replace(F.regexp_replace(x, SPLIT_RANGE, "[$1-$2]"), BRACKET, " "), "[")


def drop_markers(c: Column) -> Column:
    return where_held(drop_numeric(c), lambda x: F.regexp_replace(x, SOURCE, " "), "【")


def citation_only(sentence: Column) -> Column:
    """Whether nothing but markers, numbers of up to three digits and marks is left."""
    bare = F.regexp_replace(drop_markers(sentence), r"(?U)\b\d{1,3}\b", " ")
    # only an opaque source takes a letter with it
    stays = ~holds(sentence, "【") & sentence.rlike(r"\p{L}")
    return ~begins_with_letter(sentence) & ~stays & (F.regexp_replace(bare, r"(?U)[\s.,;:!?()\[\]{}\-–—]+", "") == "")


def attach(sentences: Column) -> Column:
    """Sentences that are citations only join the one before them; a leading one goes."""

    def joined(marked: Column) -> Column:
        def run(begins: Column) -> Column:
            end = lambda i: F.coalesce(F.get(begins, i + 1), F.size(marked))
            return F.transform(begins, lambda at, i: F.array_join(F.transform(F.slice(marked, at + 1, end(i) - at), lambda s: s["text"]), " "))

        return let(F.array_compact(F.transform(marked, lambda s, i: F.when(~s["lone"], i))), run)

    def attached(marked: Column) -> Column:
        return F.when(F.exists(marked, lambda s: s["lone"]), joined(marked)).otherwise(F.transform(marked, lambda s: s["text"]))

    return let(F.transform(sentences, lambda s: F.struct(s.alias("text"), citation_only(s).alias("lone"))), attached)


def attach_counts(sentences: Column) -> Column:
    """How many sentences were attached and how many went."""

    def counted(only: Column) -> Column:
        first = F.array_position(only, False).cast("int")
        skipped = F.when(first > 0, first - 1).otherwise(F.size(only))
        return F.struct((F.size(F.filter(only, lambda x: x)) - skipped).alias("attached"), skipped.alias("skipped"))

    return let(F.transform(sentences, citation_only), counted)


#: What a trailing bare number may follow without being a citation.
LABEL = r"(?iU)\b(?:figure|fig\.?|table|section|sec\.?|chapter|appendix|eq\.?|equation|algorithm|step|phase|version|rank|top)\s*$"
MODEL = r"(?iU)\b(?:gpt|llama|claude|gemini|bert|vit|rt|dino|resnet|clip|yolo|mistral|mixtral|qwen|deepseek|palm|roberta|vgg)\s*[- ]*$"
BARE_METHOD = "gemini_deep_research"


def cites_bare_numbers(method: Column) -> Column:
    return F.replace(F.lower(F.coalesce(method, F.lit(""))), F.lit("-"), F.lit("_")) == BARE_METHOD


def bare_citation(sentence: Column) -> Column:
    """The number a sentence ends in, if it may be a citation; else null. Whether the number
    is one of the manuscript's references is left to the join with these."""
    pattern = r"^(.*?)(?<![\[\]\d./:#-])(\d{1,3})\s*[.,;:!?]?\s*$"
    before = F.regexp_extract(sentence, pattern, 1)
    labelled = before.rlike(LABEL) | before.rlike(MODEL)
    linked = before.rlike(rf"(?U){BRACKET}[\s.,;:!?)]*$")
    return F.when(sentence.rlike(pattern) & ~labelled & ~linked, _plain(F.regexp_extract(sentence, pattern, 2)))


def mark_target(sentence: Column, target: Column) -> Column:
    """Every bracket of a sentence rewritten: [CITE_THIS] where it cites ``target`` alone,
    with CITE_OTHER where it cites more, [CITE_OTHER] where it doesn't."""
    whole = join_split_ranges(sentence)
    found = F.regexp_extract_all(whole, F.lit(BRACKET), F.lit(1))
    between = F.split(whole, BRACKET, -1)

    def rewrite(group: Column) -> Column:
        cited = expand(group)
        hit = F.when(F.size(cited) == 1, F.lit("[CITE_THIS]")).otherwise(F.lit("[CITE_THIS, CITE_OTHER]"))
        return F.when(F.array_contains(cited, target), hit).otherwise(F.lit("[CITE_OTHER]"))

    pieces = F.zip_with(between, F.transform(found, rewrite), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return clean_sentence(F.array_join(pieces, ""))


#: Fixed value: words that show a line to be an entry of a reference list.
VENUE = r"(?iU)\b(?:arXiv|Proceedings|Conference|Journal|Transactions|Findings|Workshop|URL|doi|preprint|ICLR|NeurIPS|ACL|EMNLP|AAAI|CVPR|ICML|SIGDIAL|UAI)\b"


def reference_entry(line: Column) -> Column:
    """``[n] rest`` with a venue, or with a year and an author list."""
    pattern = r"(?U)^\[(\d{1,4})\]\s+(.+)$"
    rest = F.regexp_extract(line, pattern, 2)
    head = F.substring(rest, 1, 160)
    dated = rest.rlike(r"(?U)\b(?:19|20)\d{2}\b") & (F.contains(head, F.lit(",")) | F.contains(head, F.lit(" and ")))
    return line.startswith("[") & line.rlike(pattern) & (rest.rlike(VENUE) | dated)
