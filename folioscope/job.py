"""The whole evaluation as one job over all samples, and its command line.

Every step is a DataFrame over all (method, topic_id) at once. What a sample lacks, or where it
fails, stands in a status column, and the other samples go on.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Limits, judge_settings, read_config
from .functions import prompts
from .functions.ids import id_year
from .operators import audit, balance, evidence, judging, sampling, scanner, scoring
from .operators import events as ev
from .sources import manuscripts, sinks
from .sources.layout import Layout
from .sources.shared import cut

KEY = ["method", "topic_id"]


@dataclass(frozen=True)
class Inputs:
    """``references``: method, topic_id, text (a JSON object from index to paper); ``manuscripts``:
    method, topic_id, md; ``cards``: paper_id, tier_rank, card (JSON); ``topics``: topic_id,
    topic; ``rubrics``: family, rubric."""

    references: DataFrame
    manuscripts: DataFrame
    cards: DataFrame
    topics: DataFrame
    rubrics: DataFrame | None = None


def sample_states(inputs: Inputs) -> DataFrame:
    """method, topic_id, status of every sample that either input knows."""
    known = inputs.references.select(*KEY, F.from_json("text", "map<string,string>").isNotNull().alias("readable")).groupBy(*KEY).agg(F.max("readable").alias("readable"))
    written = inputs.manuscripts.groupBy(*KEY).agg(F.max(F.col("md").isNotNull()).alias("written"))
    both = known.join(written, KEY, "full_outer")
    status = F.when(F.col("readable").isNull(), "missing_references").when(~F.col("readable"), "malformed_references").when(~F.coalesce("written", F.lit(False)), "missing_manuscript").otherwise("ok")
    return both.select(*KEY, status.alias("status"))


def claim_records(inputs: Inputs, limits: Limits = Limits()) -> DataFrame:
    """method, topic_id, n_claims, n_papers, n_chars, truncated, status, jsonl: the records that
    BSC is judged on, for every sample; samples without claims have the status ``no_claims``."""
    states = cut(sample_states(inputs), "states")
    fit = states.where("status = 'ok'").select(*KEY)
    references = manuscripts.ref_map(inputs.references.join(fit, KEY, "left_semi"), KEY)
    used = references.where(id_year(F.col("paper_id")).between(evidence.FIRST_YEAR, evidence.LAST_YEAR))
    sentences = scanner.scan(inputs.manuscripts.join(fit, KEY, "left_semi"), KEY)
    usable = inputs.cards.where("tier_rank < 4")
    found, groups = ev.claims(sentences, used, usable, KEY, F.col("method"), limits.max_group_size)
    found = cut(found, "claims")
    members = found.select(*KEY, "claim_id", F.explode("citation_group.paper_id").alias("paper_id"))
    tiers = cut(evidence.claim_tiers(members, usable, [*KEY, "claim_id"]), "claim-tiers")
    budget = sampling.Budget(limits.max_claim_records, limits.max_papers, limits.max_multi_claims)
    picked = cut(sampling.select_claims(sampling.candidates(found, tiers, KEY), KEY, budget), "picked")
    chosen = found.join(picked, [*KEY, "claim_id"]).join(tiers.select(*KEY, "claim_id", "tier_rank"), [*KEY, "claim_id"])
    chosen = cut(chosen, "selected")
    summary = balance.summary(found, chosen, groups, usable, KEY, limits.max_group_size)
    meta = references.groupBy(*KEY).agg(F.count(F.lit(1)).alias("num_ref_entries"), F.count_if(id_year(F.col("paper_id")).between(evidence.FIRST_YEAR, evidence.LAST_YEAR)).alias("num_refs_after_year_filter"))
    meta = meta.join(found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("num_claim_candidates")), KEY).withColumns({"max_papers": F.lit(limits.max_papers), "max_claim_records": F.lit(limits.max_claim_records), "jsonl_char_limit": F.lit(limits.jsonl_char_limit)})
    heads = meta.select(*KEY, F.to_json(F.struct(F.lit("survey_meta").alias("record_type"), F.col("method"), F.col("topic_id"), F.lit("BSC-v2").alias("metric"), *[c for c in meta.columns if c not in KEY])).alias("meta"))
    tails = summary.select(*KEY, balance.as_record(summary, KEY, "balance_summary").alias("balance"))
    body = F.to_json(F.struct(F.lit("bsc_claim_context").alias("record_type"), "claim_id", "citation_mode", "section_title", "marked_sentence", "original_sentence_with_citations", "citation_group", "citation_group_size", "citation_scope", "claim_type"))
    cards = members.join(picked.select(*KEY, "claim_id"), [*KEY, "claim_id"], "left_semi").join(usable.select("paper_id", "card"), "paper_id").groupBy(*KEY, "claim_id").agg(F.map_from_entries(F.collect_set(F.struct("paper_id", "card"))).alias("cards"))
    rows = chosen.withColumns({"papers": F.col("citation_group.paper_id"), "body": body}).join(cards, [*KEY, "claim_id"]).join(heads, KEY).join(tails, KEY)
    fitted = sampling.fit_budget(rows, KEY, limits.jsonl_char_limit).withColumnRenamed("status", "fit_status")
    out = states.join(fitted, KEY, "left")
    return out.withColumn("status", F.when(F.col("status") != "ok", F.col("status")).otherwise(F.coalesce("fit_status", F.lit("no_claims")))).drop("fit_status")


def score_prompts(inputs: Inputs, records: DataFrame) -> DataFrame:
    """method, topic_id, family, prompt, status: one row a sample and family. Only samples whose
    inputs are there have a prompt."""
    rows = scoring.with_topics(records.select(*KEY, "status", "jsonl"), inputs.topics)
    rubrics = inputs.rubrics if inputs.rubrics is not None else inputs.topics.sparkSession.createDataFrame([], "family string, rubric string")
    parts = []
    for families in judging.CALLS.values():
        for family in families:
            text = prompts.prompt(families, F.col("rubric"), F.col("topic"), F.col("jsonl") if families == ["BSC"] else None)
            fit = F.col("status") == "ok" if family == "BSC" else ~F.col("status").isin("missing_manuscript")
            own = rows.withColumn("family", F.lit(family)).join(F.broadcast(rubrics.where(F.col("family") == family).limit(1)), "family", "left")
            parts.append(own.select(*KEY, "family", F.when(fit, text).alias("prompt"), F.when(~fit, F.col("status")).alias("status")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class Results:
    records: DataFrame
    scores: DataFrame
    statuses: DataFrame


def evaluate(inputs: Inputs, judge: judging.Judge, limits: Limits = Limits()) -> Results:
    """Prepare, ask, score: all samples, all families. ``statuses`` has a row for every sample
    and family, also for those that could not be judged."""
    records = cut(claim_records(inputs, limits), "records")
    asked = cut(score_prompts(inputs, records), "prompts")
    answers = judge.responses(asked.where("prompt is not null").select(*KEY, "family", "prompt")).select(*KEY, "family", "raw_response")
    counts = audit.audit_counts(inputs.manuscripts.where("md is not null"), KEY)
    capped = audit.caps(audit.audit_flags(counts), KEY)
    scores = cut(judging.scores(answers, KEY, capped), "scores")
    failed = asked.where("prompt is null").select(*KEY, "family", "status", F.lit(0).cast("long").alias("warnings"), F.lit(None).cast("long").alias("raw_20"))
    return Results(records, scores, judging.statuses(scores, KEY).unionByName(failed))


def main(argv: list[str] | None = None) -> int:
    """0 if every sample of every family was scored, 1 if some were not, 2 on a bad argument."""
    p = argparse.ArgumentParser(prog="folioscope", description=__doc__)
    p.add_argument("--root", required=True, help="folder with eval_inputs and eval_cache")
    p.add_argument("--responses", required=True, help="recorded responses: JSON lines of method, topic_id, family, raw_response")
    p.add_argument("--cards", required=True, help="evidence cards: a Parquet table of paper_id, tier_rank, card")
    p.add_argument("--topics", required=True, help="topics: JSON")
    p.add_argument("--method", action="append", help="only this method; may be repeated")
    p.add_argument("--topic-id", action="append", help="only this topic; may be repeated")
    p.add_argument("--config", help="a JSON file that says how the judge is reached")
    p.add_argument("--api-mode", choices=["on", "off", "config"], default="off")
    p.add_argument("--model-name", default="")
    p.add_argument("--build-only", action="store_true", help="write the records and stop")
    for name, default in vars(Limits()).items():
        p.add_argument("--" + name.replace("_", "-"), type=int, default=default)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("folioscope").getOrCreate()
    settings = judge_settings(read_config(spark, a.config) if a.config else {}, a.api_mode, a.model_name)
    limits = replace(Limits(), **{n: getattr(a, n) for n in vars(Limits())})
    layout = Layout(a.root)

    def wanted(df: DataFrame) -> DataFrame:
        for column, values in (("method", a.method), ("topic_id", a.topic_id)):
            df = df.where(F.col(column).isin(values)) if values else df
        return df

    refs, mds = manuscripts.whole_texts(spark, layout.references()), manuscripts.whole_texts(spark, layout.manuscripts())
    inputs = Inputs(
        wanted(manuscripts.references_of(refs)), wanted(manuscripts.manuscripts_of(mds)), spark.read.parquet(a.cards), manuscripts.topics(spark, a.topics),
    )
    if a.build_only:
        records = cut(claim_records(inputs, limits), "records")
        sinks.write_jsonl(records.where("jsonl is not null"), layout.records(), KEY)
        return int(not records.where("status <> 'ok'").isEmpty())
    done = evaluate(inputs, judging.RecordedJudge(spark.read.json(a.responses, schema="method string, topic_id string, family string, raw_response string"), KEY), limits)
    sinks.write_jsonl(done.records.where("jsonl is not null"), layout.records(), KEY)
    rows = cut(done.statuses.withColumns({"api_mode": F.lit(settings.api_mode), "model_name": F.lit(settings.model_name)}), "statuses")
    sinks.write_json(done.scores.withColumn("api_mode", F.lit(settings.api_mode)), layout.results("scores", settings.api_mode), ["family", "method", "topic_id"])
    sinks.upsert_csv(rows.select("method", "topic_id", "api_mode", "family", "status", "raw_20"), layout.scores(), layout.scores() + "-work", ["topic_id", "method", "api_mode", "family"])
    sinks.append_log(scoring.summary(rows), layout.log())
    return int(not rows.where("status not in ('ok', 'defaulted')").isEmpty())


if __name__ == "__main__":
    sys.exit(main())
