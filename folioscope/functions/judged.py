"""Recovering the JSON of a judge's response, and the scores in it.

The ladder: the whole text, the text inside a code fence, the first balanced object
(BSC and MAR) or what lies between the first and the last brace (TSQ and HDQ), and
for families with fixed criteria a search for each criterion's score. The first
three are VARIANT expressions; finding a balanced object needs a scan that knows
strings and escapes, and is the one Arrow function here.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import once

#: Criteria by family, as judges name them.
CRITERIA = {
    "BSC": ["Claim-Level Citation Support", "Reference Faithfulness and Attribution Accuracy", "Multi-Reference Synthesis Coverage and Quality", "Citation Distribution Balance and Non-Redundancy"],
    "MAR": ["Citation and Reference Presentation Integrity", "Figure/Table Quality and Textual Integration", "Layout and Formatting Professionalism", "Manuscript Component Completeness"],
    "TSQ": ["Research-Space Coverage", "Taxonomy Clarity and Boundary Control", "Survey Organization and Functional Coherence", "Synthesis Insight and Gap Analysis"],
    "HDQ": ["Multi-Level Goal Alignment", "Paragraph Argument Progression", "Atomic Claim Specificity and Technical Concreteness", "Local Synthesis and Non-Enumerative Writing"],
}
#: An older name of a criterion, diagnostics of MAR and their levels, stated totals.
FORMER_NAMES = {"Citation Distribution Balance and Non-Redundancy": "Citation Evidence Balance and Non-Redundancy"}
DIAGNOSTICS = ["citation_reference_presentation_errors", "figure_table_artifact_issues", "layout_formatting_defects", "missing_manuscript_components", "visual_readability_problems"]
LEVELS = ["none", "mild", "moderate", "severe"]
TOTALS = {"BSC": "bsc_raw_20", "MAR": "mar_raw_20"}
#: What becomes of a response: ``ok``, or there is nothing to score in it.
OK, UNPARSED, NO_GROUP = "ok", "unparsed", "missing_group"
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}]', re.S)  # a string that never ends hides what follows


@F.pandas_udf(T.StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first balanced ``{...}`` of a text, strings and escapes respected; null if none."""

    def scan(text: str | None) -> str | None:
        start = (text or "").find("{")
        depth = 0
        for m in _TOKEN.finditer(text, start) if start >= 0 else ():
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            if depth == 0:
                return text[start : m.end()]
        return None

    return texts.map(scan)


def unfence(c: Column) -> Column:
    """The text without the code fence around it."""
    bare = F.trim(c)
    return F.when(bare.startswith("```"), F.regexp_replace(F.regexp_replace(bare, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(bare)


def inner_fence(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?is)```(?:json)?\s*(.*?)\s*```", 1), F.lit(""))


def outer_braces(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _object(v: Column) -> Column:
    """A VARIANT that is an object, else null."""
    return F.when(_kind(v).startswith("OBJECT"), v)


def parse(responses: DataFrame, raw: str = "raw_response", family: str = "family") -> DataFrame:
    """``responses`` with ``rung``, the first that holds JSON of any kind (null if none does),
    and ``parsed``: VARIANT, null where that JSON is no object."""
    text = F.coalesce(F.col(raw), F.lit(""))
    wide = F.col(family).isin("TSQ", "HDQ")
    rows = once(responses.withColumn("_found", first_object(text)), "_whole", F.try_parse_json(F.trim(text)))
    # a lower rung is tried only where those above it hold nothing
    lower = lambda v, c: F.when(v.isNull(), F.try_parse_json(c))
    rows = once(rows, "_fence", lower(F.col("_whole"), F.when(wide, inner_fence(text)).otherwise(unfence(text))))
    rows = once(rows, "_braces", lower(F.coalesce("_whole", "_fence"), F.when(wide, outer_braces(text)).otherwise(F.col("_found"))))
    rungs = [("whole", F.col("_whole")), ("fence", F.col("_fence")), ("braces", F.col("_braces"))]
    rung = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in rungs])
    rows = once(rows.withColumn("rung", rung), "_first", F.coalesce(*[v for _, v in rungs]))
    return once(rows, "parsed", _object(F.col("_first"))).drop("_found", "_whole", "_fence", "_braces", "_first")


def unescape(c: Column) -> Column:
    """The text that the inside of a JSON string stands for."""
    told = F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), c, F.lit('"'))), "$", "string")
    return F.coalesce(told, F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")))


def _loose(criterion: str, whole_numbers: bool) -> str:
    number = r"\d+" if whole_numbers else r"-?\d+(?:\.\d+)?"
    return rf'(?s)"{re.escape(criterion)}"\s*:\s*\{{\s*"score"\s*:\s*({number})\s*,\s*"rationale"\s*:\s*"((?:\\.|[^"\\])*)"'


def loose_item(text: Column, criterion: str, whole_numbers: bool = False) -> Column:
    """(raw, rationale) of a criterion in a text that is no JSON, null if it isn't there."""
    pattern = _loose(criterion, whole_numbers)
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("raw"), unescape(F.regexp_extract(text, pattern, 2)).alias("rationale")))


def raw_scores(responses: DataFrame, key: list[str], raw: str = "raw_response", family: str = "family") -> DataFrame:
    """key, family, criterion, raw (as text), is_text, rationale, rung, status: four rows a response.

    BSC keeps its scores below ``scores`` or, failing that, below ``BSC``, where the fourth
    criterion may have its former name; it has no loose rung. MAR without a MAR object and
    BSC or MAR without JSON hold nothing to score: their status says so. TSQ and HDQ come
    in one response and are always scored, with what is missing left null. The loose rung
    holds only if every criterion of the response is found.
    """
    rows = parse(responses, raw, family).withColumn("_text", F.coalesce(F.col(raw), F.lit("")))
    text, parsed = F.col("_text"), F.col("parsed")
    parts = []
    for f, names in CRITERIA.items():
        own = rows.where(F.col(family) == f)
        together = [*CRITERIA["TSQ"], *CRITERIA["HDQ"]] if f in ("TSQ", "HDQ") else names
        complete = F.lit(f != "BSC") & F.col("rung").isNull()
        for n in together:
            complete = complete & text.rlike(_loose(n, f == "MAR"))
        own = once(own, "_loose", complete)
        group = _object(F.try_variant_get(parsed, f"$.{f}", "variant"))
        if f == "BSC":
            scores = F.try_variant_get(parsed, "$.scores", "variant")
            own = own.withColumn("_group", F.coalesce(scores, group)).withColumn("_former", scores.isNull())
        else:
            own = own.withColumn("_group", group).withColumn("_former", F.lit(False))
        loose, group = F.col("_loose"), F.col("_held")
        own = once(own, "_held", F.col("_group"))
        if f == "BSC":
            status = F.when(parsed.isNull(), UNPARSED).otherwise(OK)
        elif f == "MAR":
            status = F.when(loose | group.isNotNull(), OK).when(parsed.isNull(), UNPARSED).otherwise(NO_GROUP)
        else:
            status = F.lit(OK)
        own = own.withColumn("_status", status)
        entries = []
        for n in names:
            item = _object(F.try_variant_get(group, f"$['{n}']", "variant"))
            if f == "BSC" and n in FORMER_NAMES:
                former = _object(F.try_variant_get(group, f"$['{FORMER_NAMES[n]}']", "variant"))
                item = F.when(F.col("_former") & _kind(item).isin("", "OBJECT<>"), F.coalesce(former, item)).otherwise(item)
            entries.append(F.struct(F.lit(n).alias("criterion"), item.alias("item"), F.when(loose, loose_item(text, n, f == "MAR")).alias("said")))
        # a criterion is a row before its parts are looked at, so that each is found once
        rows_of = once(own.select(*key, family, "_loose", "rung", "_status", F.explode(F.array(*entries)).alias("e")), "_score", F.try_variant_get(F.col("e.item"), "$.score", "variant"))
        found, said = F.col("_score"), F.col("e.said")
        parts.append(rows_of.select(
            *key, F.col(family).alias("family"), "e.criterion", F.when(loose, said["raw"]).otherwise(F.try_variant_get(found, "$", "string")).alias("raw"),
            F.when(loose, F.lit(f != "MAR")).otherwise(_kind(found) == "STRING").alias("is_text"),
            F.coalesce(F.when(loose, said["rationale"]).otherwise(F.try_variant_get(F.col("e.item"), "$.rationale", "string")), F.lit("")).alias("rationale"),
            F.when(loose, F.lit("loose")).otherwise(F.col("rung")).alias("rung"), F.col("_status").alias("status"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def diagnostics(responses: DataFrame, key: list[str], raw: str = "raw_response", family: str = "family") -> DataFrame:
    """key, family, diagnostics (map), overall, stated_20: what a response says beside its scores.
    Of MAR the five known fields, each a known level or ``none``; of the others all texts."""
    rows = parse(responses, raw, family).withColumn("_text", F.coalesce(F.col(raw), F.lit("")))
    said = _object(F.try_variant_get(F.col("parsed"), "$.diagnostics", "variant"))
    known = []
    for d in DIAGNOSTICS:
        level = F.lower(F.trim(F.coalesce(F.try_variant_get(said, f"$.{d}", "string"), F.when(F.col("rung").isNull(), F.nullif(F.regexp_extract("_text", rf'"{d}"\s*:\s*"([^"]+)"', 1), F.lit(""))), F.lit("none"))))
        known += [F.lit(d), F.when(level.isin(LEVELS), level).otherwise(F.lit("none"))]
    every = F.coalesce(F.from_json(F.to_json(said), "map<string,string>"), F.create_map().cast("map<string,string>"))
    overall = F.coalesce(F.try_variant_get(F.col("parsed"), "$.overall_rationale", "string"), F.try_variant_get(F.col("parsed"), "$.overall_assessment", "string"), F.lit(""))
    stated = F.coalesce(*[F.when(F.col(family) == f, F.try_variant_get(F.col("parsed"), f"$.{t}", "int")) for f, t in TOTALS.items()])
    return rows.select(*key, F.col(family).alias("family"), F.when(F.col(family) == "MAR", F.create_map(*known)).otherwise(every).alias("diagnostics"), overall.alias("overall"), stated.alias("stated_20"))


def response_text(c: Column) -> Column:
    """The text inside the usual shapes of an API's answer: a plain field, the content of the
    first choice (a text, or parts), or the texts of all outputs; else the answer as it is."""
    v = F.try_parse_json(c)
    texts = lambda path, each: F.nullif(F.array_join(F.transform(F.try_variant_get(v, path, "array<variant>"), each), "\n"), F.lit(""))
    part = lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$", "string"))
    content = F.try_variant_get(v, "$.choices[0].message.content", "variant")
    plain = F.when(_kind(content) == "STRING", F.try_variant_get(content, "$", "string"))
    outputs = F.flatten(F.transform(F.try_variant_get(v, "$.output", "array<variant>"), lambda o: F.coalesce(F.try_variant_get(o, "$.content", "array<variant>"), F.array().cast("array<variant>"))))
    spoken = F.filter(F.transform(outputs, lambda x: F.try_variant_get(x, "$.text", "string")), lambda t: F.coalesce(t != "", F.lit(False)))
    return F.coalesce(F.nullif(F.try_variant_get(v, "$.output_text", "string"), F.lit("")), plain, texts("$.choices[0].message.content", part), F.nullif(F.array_join(spoken, "\n"), F.lit("")), c)
