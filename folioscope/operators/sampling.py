"""Choosing claims under budgets, and fitting the result into a number of characters.

Each choice changes the order of those that follow, so a sample's candidates are one
row, worked through in Python. A sample is one manuscript; its candidates are as many
as its sentences cite, not as many as the corpus has. Many samples go to Python at a time:
``applyInPandas`` would make tables of each, at many times the cost of the choice.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.claims import intro_or_conclusion, size_bin, type_priority
from ..sources.shared import small_batches


@dataclass(frozen=True)
class Budget:
    records: int = 100
    papers: int = 100
    multi: int = 50
    group: tuple[int, int] = (2, 8)

    @property
    def other(self) -> int:
        return max(20, self.records // 4)


def candidates(claims: DataFrame, tiers: DataFrame, key: list[str]) -> DataFrame:
    """Claims with what the choice looks at. ``tiers``: key, claim_id, tier_rank."""
    return claims.join(tiers.select(*key, "claim_id", "tier_rank"), [*key, "claim_id"]).select(
        *key, "claim_id", "citation_mode", "section_title", "citation_group_size", "claim_type", "position", "tier_rank",
        F.col("citation_group.paper_id").alias("papers"), size_bin(F.col("citation_group_size")).alias("size_bin"),
        intro_or_conclusion(F.col("section_title")).alias("frame"), type_priority(F.col("claim_type"), F.col("citation_mode")).alias("priority"),
    )


class Choice:
    """The state of one sample's selection."""

    def __init__(self, budget: Budget):
        self.budget, self.bank = budget, set()
        self.sections, self.bins, self.singles = Counter(), Counter(), Counter()
        self.others = 0
        self.taken: list[tuple[str, str]] = []
        self.skips = Counter()

    def refuse(self, claim: dict) -> str | None:
        if not claim["papers"] or claim["tier_rank"] >= 4:
            return "missing_or_insufficient"
        return "paper_budget" if len(self.bank.union(claim["papers"])) > self.budget.papers else None

    def demoted(self, claim: dict) -> bool:
        return claim["claim_type"] == "other" and self.others >= self.budget.other

    def fresh(self, claim: dict) -> int:
        return len(set(claim["papers"]) - self.bank)

    def order_of_group(self, c: dict) -> tuple:
        return (c["tier_rank"], self.bins[c["size_bin"]], self.sections[c["section_title"]], self.demoted(c), c["frame"], c["priority"], self.fresh(c), c["position"])

    def order_of_single(self, c: dict) -> tuple:
        paper = c["papers"][0] if c["papers"] else ""
        return (c["tier_rank"], self.demoted(c), self.singles[paper], self.sections[c["section_title"]], c["priority"], self.fresh(c), c["position"])

    def take(self, claim: dict, reason: str) -> None:
        self.taken.append((claim["claim_id"], reason))
        self.bank.update(claim["papers"])
        self.sections[claim["section_title"]] += 1
        self.bins[claim["size_bin"]] += 1
        self.others += claim["claim_type"] == "other"
        if claim["citation_mode"] == "single":
            self.singles[claim["papers"][0]] += 1

    def work_through(self, pool: list[dict], quota: int, order, reason: str, member=lambda c: True) -> int:
        """Look at the best of the pool until the quota or the pool is exhausted; whatever was
        looked at leaves the pool, taken or not."""
        got = 0
        while got < quota and len(self.taken) < self.budget.records:
            eligible = [c for c in pool if member(c)]
            if not eligible:
                break
            best = min(eligible, key=order)
            pool.remove(best)
            why = self.refuse(best)
            if why:
                self.skips[why] += 1
            else:
                self.take(best, reason)
                got += 1
        return got

    def run(self, claims: list[dict]) -> None:
        low, high = self.budget.group
        groups = [c for c in claims if c["citation_mode"] == "group" and low <= c["citation_group_size"] <= high]
        singles = [c for c in claims if c["citation_mode"] == "single"]
        chosen = self.work_through(groups, self.budget.multi, self.order_of_group, "multi_claim_priority_with_citation_closure")
        target = self.budget.records - chosen
        known = self.work_through(singles, target, self.order_of_single, "single_claim_already_in_bank", lambda c: self.bank.issuperset(c["papers"]))
        self.work_through(singles, target - known, self.order_of_single, "single_claim_new_paper", lambda c: not self.bank.issuperset(c["papers"]))


def _key_fields(df: DataFrame, key: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in key]


def each_sample(rows: DataFrame, key: list[str], fields: list[T.StructField], work: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """What ``work`` makes of the rows of every sample: tuples of ``fields``, behind the key."""
    schema = T.StructType([*_key_fields(rows, key), *fields])
    kinds = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made = [], []
            for i, sample in enumerate(batch.column("_rows")):
                got = work(sample.as_py())
                at += [i] * len(got)
                made += got
            keys = [batch.column(k).take(pa.array(at, pa.int64())) for k in key]
            columns = [pa.array([m[j] for m in made], f.type) for j, f in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*keys, *columns], names=schema.names)

    small_batches(rows.sparkSession)
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.collect_list(F.struct(*rest)).alias("_rows")).mapInArrow(run, schema)


def select_claims(pool: DataFrame, key: list[str], budget: Budget = Budget()) -> DataFrame:
    """key, claim_id, pick (from 1), selection_reason of the chosen ``candidates``."""
    fields = [T.StructField("claim_id", T.StringType()), T.StructField("pick", T.IntegerType()), T.StructField("selection_reason", T.StringType())]

    def choose(sample: list[dict]) -> list[tuple]:
        state = Choice(budget)
        state.run(sorted(sample, key=lambda r: r["position"]))
        return [(claim, i, why) for i, (claim, why) in enumerate(state.taken, 1)]

    return each_sample(pool, key, fields, choose)


def selection_stats(pool: DataFrame, key: list[str], budget: Budget = Budget()) -> DataFrame:
    """Per sample how many were taken, and how many refused for which reason."""
    names = ["selected", "papers", "missing_or_insufficient", "paper_budget"]

    def count(sample: list[dict]) -> list[tuple]:
        state = Choice(budget)
        state.run(sorted(sample, key=lambda r: r["position"]))
        return [(len(state.taken), len(state.bank), state.skips[names[2]], state.skips[names[3]])]

    return each_sample(pool, key, [T.StructField(n, T.IntegerType()) for n in names], count)


def serialized(record: dict) -> str:
    """One compact line of JSON."""
    return json.dumps(record, ensure_ascii=False, separators=(",", ":")) + "\n"


class Fit:
    """The records of one sample while claims are taken away. Lines of claims and of cards are
    serialised once; what changes with every claim are two short lines and a few lengths."""

    def __init__(self, rows: list[dict], meta: dict, balance: dict):
        self.rows, self.meta, self.balance = sorted(rows, key=lambda r: r["order"]), meta, balance
        self.weakest = sorted(self.rows, key=lambda r: (r["tier_rank"], r["citation_group_size"], r["claim_type"] in ("background", "other"), r["position"]))
        self.cards = {p: c for r in rows for p, c in r["cards"].items()}
        self.uses = Counter(p for r in rows for p in set(r["papers"]))
        self.truncated = False
        self.gone: set[int] = set()
        for r in self.rows:
            r["size"] = len(serialized(self._claim(r, {})))
        self.claim_chars = sum(r["size"] for r in self.rows)
        self.members = sum(len(r["body"].get("citation_group", ())) for r in self.rows)
        self.card_size = {p: len(serialized(self._entry(p, ""))) for p in self.cards}  # with a comma in place of the line's end
        self.card_chars = sum(self.card_size[p] for p in self.uses)

    @staticmethod
    def _claim(r: dict, ids: dict[str, str]) -> dict:
        group = [m | {"evidence_ref_id": ids.get(m["paper_id"], "")} for m in r["body"].get("citation_group", ())]
        return r["body"] | ({"citation_group": group} if "citation_group" in r["body"] else {})

    def _entry(self, paper: str, ref: str) -> dict:
        return {"evidence_ref_id": ref, "paper_id": paper, "evidence_card": self.cards[paper]}

    def left(self) -> list[dict]:
        return [r for r in self.rows if id(r) not in self.gone]

    def ids(self) -> dict[str, str]:
        return {p: f"E{i:03d}" for i, p in enumerate(sorted(self.uses), 1)}

    def summaries(self) -> tuple[dict, dict]:
        """The first and the last record. Only some of their figures follow the claims that went."""
        left = self.left()
        n, multi = len(left), sum(r["citation_mode"] == "group" for r in left)
        single, share = sum(r["citation_mode"] == "single" for r in left), round(multi / max(1, n), 4)
        meta = self.meta | {"num_selected_claims": n, "num_selected_single_claims": single, "num_selected_multi_claims": multi, "multi_citation_claim_ratio_selected": share, "num_selected_papers": len(self.uses), "truncated_to_char_limit": self.truncated}
        balance = self.balance | {"selected_claims": n, "selected_single_citation_claims": single, "selected_multi_citation_claims": multi, "multi_citation_claim_ratio_selected": share, "num_unique_selected_papers": len(self.uses)}
        if self.truncated:
            count = lambda f: dict(Counter(r[f] for r in left))
            others = sum(r["claim_type"] == "other" for r in left)
            balance |= {"citation_group_size_distribution_selected": count("size_bin"), "claim_type_distribution_selected": count("claim_type"), "selected_other_claims": others, "selected_other_claim_ratio": round(others / max(1, n), 4), "contexts_per_section_selected": count("section_title")}
        return meta, balance

    def _bank(self, ids: dict[str, str]) -> dict:
        return {"record_type": "evidence_card_bank", "num_papers": len(ids), "papers": [self._entry(p, i) for p, i in ids.items()]}

    def size(self) -> int:
        """How long ``text`` is, without writing it."""
        ids = self.ids()
        wide = sum(map(len, ids.values()))
        inside = sum(len(ids[m["paper_id"]]) for r in self.left() for m in r["body"].get("citation_group", ()) if m["paper_id"] in ids) if len(ids) > 999 else 4 * self.members
        shell = len(serialized(self._bank({}) | {"num_papers": len(ids)})) + self.card_chars - (len(ids) > 0)
        return sum(len(serialized(x)) for x in self.summaries()) + self.claim_chars + inside + shell + wide

    def text(self) -> str:
        ids = self.ids()
        meta, balance = self.summaries()
        return "".join(map(serialized, [meta, self._bank(ids), *[self._claim(r, ids) for r in self.left()], balance]))

    def drop(self) -> bool:
        """Take the weakest claim away; false if none is left."""
        if not self.weakest:
            return False
        r = self.weakest.pop()
        self.gone.add(id(r))
        self.truncated = True
        self.claim_chars -= r["size"]
        self.members -= len(r["body"].get("citation_group", ()))
        for p in set(r["papers"]):
            self.uses[p] -= 1
            if not self.uses[p]:
                del self.uses[p]
                self.card_chars -= self.card_size[p]
        return True


def fit_budget(records: DataFrame, key: list[str], limit: int) -> DataFrame:
    """key, n_claims, n_papers, n_chars, truncated, status, jsonl: the records of each sample
    within ``limit`` characters, each a line: ``meta``, the bank of cards, the claims in order
    of ``pick`` (else of position) and ``balance``. ``records``: key, claim_id, tier_rank,
    citation_group_size, citation_mode, claim_type, section_title, position, papers, body (the
    claim as JSON) and cards (map from paper to its card as JSON); meta and balance (JSON, the
    same in every row of a sample) are optional.

    While the text is too long, the claim with the weakest evidence, the largest group,
    a weak type and the latest position goes, and with it papers that nothing else
    cites; the bank is numbered anew. A sample that can't fit even without claims has null
    jsonl and the status ``cannot_fit``; one whose records can't be read ``malformed``.
    """
    fields = [T.StructField(n, t) for n, t in (("n_claims", T.IntegerType()), ("n_papers", T.IntegerType()), ("n_chars", T.LongType()), ("truncated", T.BooleanType()), ("status", T.StringType()), ("jsonl", T.StringType()))]

    def fitted(rows: list[dict]) -> tuple:
        first = rows[0]
        given = {n: json.loads(first.get(n) or "{}") for n in ("meta", "balance")}
        for r in rows:
            r |= {"order": r.get("pick", r["position"]), "papers": list(r["papers"]), "body": json.loads(r["body"]), "cards": {p: json.loads(c) for p, c in dict(r["cards"]).items()}}
        fit = Fit(rows, {"record_type": "survey_meta"} | given["meta"], {"record_type": "balance_summary"} | given["balance"])
        while fit.size() > limit:
            if not fit.drop():
                return 0, 0, fit.size(), True, "cannot_fit", None
        text = fit.text()
        return len(fit.left()), len(fit.uses), len(text), fit.truncated, "ok", text

    def fit(sample: list[dict]) -> list[tuple]:
        try:
            return [fitted(sample)]
        except (ValueError, TypeError, KeyError):
            return [(0, 0, 0, False, "malformed", None)]

    return each_sample(records.withColumn("size_bin", size_bin(F.col("citation_group_size"))), key, fields, fit)
