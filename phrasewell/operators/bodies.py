"""Lookups in a table of function bodies ``(hash, name, body)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut_body


def by_hash(bodies: DataFrame, digest: str) -> DataFrame:
    """``hash, name, body`` of one hash; long bodies are cut."""
    return bodies.where(F.col("hash") == digest).select("hash", "name", cut_body(F.col("body")).alias("body"))


def by_name(bodies: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """``hash, name`` of up to ``limit`` functions whose name contains ``name`` (any case; ``_`` matches any character)."""
    return bodies.where(F.col("name").ilike(f"%{name}%")).select("hash", "name").orderBy("name", "hash").limit(limit)
