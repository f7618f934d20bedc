"""What a run may be told: from the session's configuration, or the environment, or else its default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from .functions.parsing import MOST_CLAIMS
from .operators.cache import THRESHOLD, TTL_DAYS
from .operators.evaluate import GOLD_BLOCK


@dataclass(frozen=True)
class Settings:
    """Named ``spark.claimlens.<name>`` in a session, CLAIMLENS_<NAME> in the environment."""

    cache_threshold: int = THRESHOLD
    cache_ttl_days: int = TTL_DAYS
    max_claims: int = MOST_CLAIMS
    gold_block: int = GOLD_BLOCK
    base_url: str = "https://example.org"
    output_dir: str = ""


def settings(spark: SparkSession, env: dict[str, str] | None = None) -> Settings:
    """The settings of a session; raises ValueError for a number that is none or isn't positive."""
    held, given = os.environ if env is None else env, {}
    for f in fields(Settings):
        told = spark.conf.get(f"spark.claimlens.{f.name}", None) or held.get(f"CLAIMLENS_{f.name.upper()}")
        if told:
            given[f.name] = int(told) if f.type == "int" else told
            if f.type == "int" and given[f.name] < 1:
                raise ValueError(f"{f.name} has to be positive, not {told}")
    return Settings(**given)


def read_env(text: str) -> dict[str, str]:
    """NAME=value lines of a file's text; blank lines, remarks and lines without a sign are passed over, the first of a name counts."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        name, sign, value = line.strip().partition("=")
        if sign and not name.startswith("#"):
            out.setdefault(name.strip(), value.strip())
    return out
