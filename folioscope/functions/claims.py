"""Claims: the clause a citation is attached to, its kind, and comparisons of clauses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .citations import drop_markers, drop_numeric
from .text import begins_with_letter, clean_sentence, holds, let, strip

#: Words that open a clause, and lengths.
CONNECTIVE = r"\b(however|therefore|consequently|whereas|while|although|but|by contrast|conversely|furthermore|moreover|nevertheless|in contrast)\b"
SHORT_CLAUSE, LONG_TEXT, CLAUSE_LIMIT = 40, 300, 500

#: Claim types by keyword; the first that fits is the type.
CLAIM_TYPES = [
    ("security_or_robustness", r"prompt injection|attack|poisoning|adversarial|vulnerability|robustness|jailbreak|security|defense|threat|malicious"),
    ("efficiency_or_deployment", r"latency|cost|token|compression|quantization|pruning|edge|deployment|throughput|memory|cache|serving|efficient|efficiency"),
    ("taxonomy_or_synthesis", r"taxonomy|categorize|paradigm|classify|survey|line of work|trend|convergence|trade[- ]?off|comparison|shared limitation|family|families|direction|research area|landscape"),
    ("result_finding", r"outperform|achieve|accuracy|success rate|result|performance|improve|gain|score|win rate|pass rate"),
    ("benchmark_role", r"benchmark|dataset|evaluation|leaderboard"),
    ("limitation", r"limitation|challenge|fail|failure|struggle|brittle|weakness|risk|degrade|error|hallucination"),
    ("method_description", r"framework|method|model|architecture|pipeline|mechanism|approach|module|agent|retrieval|planning|tool|function calling|orchestration|fine[- ]?tuning"),
    ("dataset_or_task", r"dataset|task|corpus|benchmark"),
]
#: In which order types are wanted, for claims with several citations and with one.
GROUP_ORDER = ["taxonomy_or_synthesis", "method_description", "security_or_robustness", "efficiency_or_deployment", "benchmark_role", "result_finding", "limitation", "dataset_or_task", "background", "other"]
SINGLE_ORDER = ["method_description", "result_finding", "benchmark_role", "security_or_robustness", "efficiency_or_deployment", "limitation", "dataset_or_task", "taxonomy_or_synthesis", "background", "other"]


def _beginnings(words: str) -> list[str]:
    """What a text holds if it has one of the words: their literal beginnings, none that has another one inside."""
    plain = {re.match("[a-z ]+", w)[0] for w in words.split("|")}
    return sorted(p for p in plain if not any(q != p and q in p for q in plain))


#: A text with a connective holds one of these words in lower case, or one of the letters that only a
#: comparison without case takes for ASCII ones.
_MAY_CONNECT, _LIKE_ASCII = sorted(set(re.findall("[a-z]{3,}", CONNECTIVE))), "\u0130\u0131\u017f\u212a"


def claim_type(sentence: Column, section: Column) -> Column:
    text = F.lower(F.concat(section, F.lit(" "), sentence))
    kind = None
    for name, words in CLAIM_TYPES:
        # the plain beginning of a word, then one letter, come before the costly boundary
        hit = holds(text, *_beginnings(words)) & text.rlike(rf"(?U)(?=[{''.join(sorted({w[0] for w in words.split('|')}))}])\b({words})\b")
        kind = F.when(hit, F.lit(name)) if kind is None else kind.when(hit, F.lit(name))
    return kind.when(F.lower(section).rlike(r"(?U)\b(introduction|background)\b"), F.lit("background")).otherwise(F.lit("other"))


def type_priority(kind: Column, mode: Column) -> Column:
    def at(order: list[str]) -> Column:
        place = F.array_position(F.array(*[F.lit(x) for x in order]), kind)
        return F.when(place > 0, place - 1).otherwise(len(order)).cast("int")

    return F.when(mode == "group", at(GROUP_ORDER)).otherwise(at(SINGLE_ORDER))


def size_bin(n: Column) -> Column:
    return F.when(n <= 4, n.cast("string")).when(n <= 8, F.lit("5-8")).when(n <= 15, F.lit("9-15")).otherwise(F.lit("16+"))


def intro_or_conclusion(section: Column) -> Column:
    return F.lower(section).rlike(r"(?U)\b(introduction|conclusion)\b")


def clause_key(clause: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(drop_numeric(clause)), "[^a-z0-9]+", " "))


def similar_keys(a: Column, b: Column) -> Column:
    """Equal, or the shorter long enough and inside the longer; empty keys are like none."""
    inside = F.when(F.length(a) <= F.length(b), (F.length(a) >= SHORT_CLAUSE) & F.contains(b, a)).otherwise((F.length(b) >= SHORT_CLAUSE) & F.contains(a, b))
    return (a != "") & (b != "") & ((a == b) | inside)


def attached_clause(sentence: Column, before: Column, after: Column) -> Column:
    """(text, scope): the least clause before a citation. It begins at the last connective,
    else after the last ``; : — –``, else, in a long text, after the last comma that leaves
    enough. A clause that is too short gives way to the whole sentence."""
    # greedy prefix: the last connective and what follows it
    connective = rf"(?isU)^.*({CONNECTIVE}.*)$"
    may_connect = let(F.lower(before), lambda x: holds(x, *_MAY_CONNECT)) | holds(before, *_LIKE_ASCII)
    after_mark = F.regexp_extract(before, r"(?s)^.*[;:—–](.*)$", 1)
    after_comma = F.regexp_extract(before, r"(?s)^.*,(.*)$", 1)
    comma = (F.length(before) > LONG_TEXT) & F.contains(before, F.lit(",")) & (F.length(clean_sentence(drop_markers(after_comma), 700)) >= SHORT_CLAUSE)
    rest = F.when(holds(before, *";:—–"), after_mark).when(comma, after_comma).otherwise(before)
    part = let(F.when(may_connect, F.regexp_extract(before, connective, 1)).otherwise(""), lambda found: F.when(found != "", found).otherwise(rest))
    whole = clean_sentence(drop_markers(F.concat(before, F.lit(" "), after)), CLAUSE_LIMIT)

    def chosen(clause: Column) -> Column:
        short = F.length(clause) < SHORT_CLAUSE
        text = F.when(short, whole).when(F.length(clause) > CLAUSE_LIMIT, clean_sentence(clause, CLAUSE_LIMIT)).otherwise(clause)
        return F.struct(text.alias("clause"), F.when(short, F.lit("sentence_fallback")).otherwise(F.lit("clause")).alias("scope"))

    return let(clean_sentence(drop_markers(part), 700), chosen)


def evaluable(text: Column) -> Column:
    """Whether a letter is left without markers."""
    unmarked = F.regexp_replace(text, r"\[CITE_(?:THIS|OTHER)(?:,\s*CITE_OTHER)?\]", " ")
    return begins_with_letter(text) | clean_sentence(drop_numeric(unmarked), 700).rlike(r"\p{L}")


def mark_clause(clause: Column) -> Column:
    marked = lambda text: F.when(text == "", F.lit("[CITE_THIS]")).otherwise(F.concat(F.regexp_replace(text, r"[.!?]+$", ""), F.lit(" [CITE_THIS].")))
    return let(strip(clean_sentence(drop_markers(clause), 700)), marked)
