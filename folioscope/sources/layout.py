"""Where inputs and results lie below a root."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve(root: str, path: str) -> str:
    """An absolute path or URI as it is, any other below the root."""
    return path if path.startswith("/") or re.match(r"[a-z][a-z0-9+.-]*:", path) else posixpath.join(root, path)


@dataclass(frozen=True)
class Layout:
    root: str

    def references(self) -> str:
        return resolve(self.root, "eval_inputs/*/ref_*.json")

    def manuscripts(self) -> str:
        return resolve(self.root, "eval_cache/md/*/*.md")

    def pages(self) -> str:
        return resolve(self.root, "eval_cache/png/*/*")

    def records(self) -> str:
        return resolve(self.root, "results/records")

    def results(self, family: str, api_mode: str) -> str:
        return resolve(self.root, f"results/{family.lower()}/api_{api_mode}")

    def scores(self) -> str:
        return resolve(self.root, "results/score_table")

    def log(self) -> str:
        return resolve(self.root, "results/log")


def topic_of(path: Column) -> Column:
    """The topic in a reference file's name, three digits; null for other files."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)ref_(\d{3})\.json$", 1), F.lit(""))


def method_of(path: Column) -> Column:
    """The folder a file lies in."""
    return F.nullif(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), F.lit(""))
