"""Settings of an evaluation: where things lie, budgets, and how the judge is reached."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import SparkSession

MODES = ("on", "off", "config")


@dataclass(frozen=True)
class JudgeSettings:
    """One way to reach a judge. Unknown settings of the file stay in ``more``."""

    provider: str = "openai_compatible_chat"
    base_url: str = ""
    api_key: str = "EMPTY"
    api_key_env: str = ""
    model_name: str = ""
    timeout: int = 600
    retries: int = 1
    retry_sleep_base_seconds: float = 5
    temperature: float = 0.2
    max_output_tokens: int = 4096
    api_mode: str = "off"
    more: dict = field(default_factory=dict, hash=False)

    def waits(self) -> list[float]:
        """Seconds to wait after each failed attempt but the last."""
        return [self.retry_sleep_base_seconds * i for i in range(1, self.retries)]


@dataclass(frozen=True)
class Limits:
    """The defaults of the command line."""

    max_papers: int = 100
    max_claim_records: int = 100
    max_single_claims: int = 50
    max_multi_claims: int = 50
    max_group_size: int = 15
    jsonl_char_limit: int = 1_000_000
    abstract_max_chars: int = 1200
    max_pages: int = 50
    max_image_pages: int = 100


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON file on any file system Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def judge_settings(config: dict, mode: str = "off", model_name: str = "") -> JudgeSettings:
    """The settings of a mode: ``on``, ``off``, or what the file names (``config``, off if it
    names none). A model given here outranks the file's."""
    if mode not in MODES:
        raise ValueError(f"api mode {mode!r} is none of {', '.join(MODES)}")
    api = config.get("llm_api", {})
    chosen = api.get("api_mode", "off") if mode == "config" else mode
    given = api.get("api_on" if chosen == "on" else "api_off", {})
    known = {f.name for f in fields(JudgeSettings)} - {"more", "api_mode"}
    made = JudgeSettings(**{k: v for k, v in given.items() if k in known}, api_mode=chosen, more={k: v for k, v in given.items() if k not in known})
    if "max_tokens" in given and "max_output_tokens" not in given:
        made = replace(made, max_output_tokens=given["max_tokens"])
    return replace(made, model_name=model_name) if model_name else made
