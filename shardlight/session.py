"""Session defaults, settings and tables."""

from __future__ import annotations

import os
import re
import tempfile
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Settings:
    """Typed settings of the engine."""

    language: str = "English"
    chunk_max_tokens: int = 128
    embedding_dim: int = 64
    rerank_threshold: float = 0.2
    snippet_chars: int = 300
    batch_size: int = 3
    requests_per_second: int = 1
    url_prefix: str = "https://files.local/"
    url_seconds: int = 3600
    store_buckets: int = 16
    top_k_before: int = 30
    top_k_after: int = 5
    neighbor_window: int = 1
    sample_size: int = 50
    sample_seed: int = 42
    min_chars: int = 100
    spark: dict = field(default_factory=lambda: {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"})

    @classmethod
    def from_environment(cls, prefix: str = "SHARDLIGHT_", environment: dict[str, str] | None = None) -> Settings:
        """The defaults, with what PREFIX_NAME variables set instead; a value of the wrong type is an error."""
        found = os.environ if environment is None else environment
        own = {f.name: f for f in fields(cls) if f.name != "spark"}
        return cls(**{n: type(f.default)(found[prefix + n.upper()]) for n, f in own.items() if prefix + n.upper() in found})


SETTINGS = Settings()


def session(name: str = "shardlight", settings: Settings = SETTINGS) -> SparkSession:
    b = SparkSession.builder.appName(name)
    for k, v in settings.spark.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only in a local session without it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shardlight-"))
    return spark.sparkContext.getCheckpointDir()
