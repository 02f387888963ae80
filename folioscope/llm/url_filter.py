"""URL filters: rules indexed by their rarest literal token.

Every rule, be it a host/path rule or a free pattern, is a regular expression
over ``host + path`` together with the literal tokens that any URL it fits must
hold as whole tokens. How often each of these tokens occurs is counted over all
URLs; a rule is filed under its rarest one. A URL then looks its own tokens up,
and only the rules found there run their expressions.

Defined cases
    * null URL, or one without ``://``: host and path are empty, no rule fits.
    * several host/path rules fit: the longest rule text wins; of equally long
      ones that with the longer host, then the smaller text.
    * a host/path rule outranks every pattern; of patterns that fit, the longest
      wins, then the smaller text. Nothing fits: ``allow``.
    * rules without a usable token are tried on every URL.
    * repeated rows are judged each for itself; an empty table gives an empty one.
    * columns of the input other than the id and the url are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that travel to the executors at a time. A longer list is applied block by
#: block, so what is sent at once is bounded whatever the length of the list.
BLOCK = 20_000
_TOKEN = re.compile(r"[0-9A-Za-z]+")
TOKENS_SQL = "[0-9A-Za-z]+"


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    order: tuple  # larger wins
    named: bool  # reported in the rule column


def site_rule(text: str, verdict: str) -> Rule:
    """``host/path``: the host and all its subdomains, paths that start with the rule's.

    The rule's tokens are whole tokens in any URL it fits, but for the last one of
    a path that doesn't end in a delimiter.
    """
    host, slash, path = text.partition("/")
    path = slash + path
    whole = _TOKEN.findall(host)
    in_path = _TOKEN.findall(path)
    if in_path and re.search(r"[0-9A-Za-z]\Z", path):
        in_path = in_path[:-1]
    end = re.escape(path) if path else "(?:/|\\Z)"
    return Rule(text, verdict, rf"(?s)\A(?:[^/]*\.)?{re.escape(host)}{end}", tuple(whole + in_path), (1, len(text), len(host), [-ord(c) for c in text]), True)


def pattern_rule(regex: str, verdict: str, tokens: Sequence[str] = ()) -> Rule:
    """A regular expression over host + path. ``tokens``: literal tokens it needs, if known."""
    return Rule(regex, verdict, regex, tuple(tokens), (0, len(regex), 0, [-ord(c) for c in regex]), False)


def host_and_path(url):
    """The two columns of the contract, from a URL column."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def token_counts(urls: DataFrame, rules: Iterable[Rule]) -> dict[str, int]:
    """In how many URLs each token of the rules occurs, over all URLs. The result has
    one row for each distinct token of the rules at most."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    spark = urls.sparkSession
    names = spark.createDataFrame([(t,) for t in wanted], "token string")
    tokens = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(f"({TOKENS_SQL})"), F.lit(1)))).alias("token"))
    found = tokens.join(F.broadcast(names) if len(wanted) <= BLOCK else names, "token").groupBy("token").count()
    return {r["token"]: r["count"] for r in found.toLocalIterator()}


class Index:
    """Rules of one block, by their rarest token."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.rules = list(rules)
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, r in enumerate(self.rules):
            if r.tokens:
                rarest = min(r.tokens, key=lambda t: (counts.get(t, 0), t))
                self.by_token.setdefault(rarest, []).append(i)
            else:
                self.always.append(i)

    def best(self, whole: str, compiled: dict[int, re.Pattern]) -> Rule | None:
        candidates = list(self.always)
        for t in set(_TOKEN.findall(whole)):
            candidates += self.by_token.get(t, ())
        fitting = []
        for i in candidates:
            if i not in compiled:
                compiled[i] = re.compile(self.rules[i].regex)
            if compiled[i].search(whole):
                fitting.append(self.rules[i])
        return max(fitting, key=lambda r: r.order, default=None)


def filter_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row's URL. Returns id, host, path, rule, verdict, pattern."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    counts = token_counts(urls, rules)
    out = urls.withColumns({"best": F.lit(None).cast("string"), "verdict": F.lit(default), "named": F.lit(False)})
    spark = pages.sparkSession
    whole_order = sorted(rules, key=lambda r: r.order)
    for at in range(0, len(whole_order), BLOCK):  # later blocks outrank earlier ones
        index = spark.sparkContext.broadcast(Index(whole_order[at : at + BLOCK], counts))

        def judge(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            compiled: dict[int, re.Pattern] = {}
            for b in batches:
                hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
                found = [index.value.best(h + p, compiled) for h, p in zip(hosts, paths)]
                old = zip(b.column("best").to_pylist(), b.column("verdict").to_pylist(), b.column("named").to_pylist())
                rows = [(r.text, r.verdict, r.named) if r else o for r, o in zip(found, old)]
                best, verdict, named = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id"), b.column("host"), b.column("path"), pa.array(best, pa.string()), pa.array(verdict, pa.string()), pa.array(named, pa.bool_())],
                    names=["page_id", "host", "path", "best", "verdict", "named"],
                )

        out = out.mapInArrow(judge, out.schema)
    return out.select(
        F.col("page_id").alias(id_col), "host", "path",
        F.when(F.col("named"), F.col("best")).alias("rule"), "verdict",
        F.when(~F.col("named"), F.col("best")).alias("pattern"),
    )
