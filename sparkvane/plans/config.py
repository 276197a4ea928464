"""Configuration and schemas of a vector database."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from pyspark.sql import types as T

from ..functions.vectors import SPACES

VECTORS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("chunk", T.StringType()),
    T.StructField("ts_ms", T.LongType()), T.StructField("tag", T.StringType()), T.StructField("seq", T.LongType()),
])
DEFAULT_TAG = "default"


def max_elements(gigabytes: float, dimension: int, links: int) -> int:
    """How many vectors a bucket of so much memory holds, 1000 at least."""
    return max(1000, int(gigabytes * 2**30 / (4 * dimension + 8 * links + 256)))


@dataclass
class DbConfig:
    dimension: int = 512
    granularity: str = "hourly"
    space: str = "l2"
    max_memory_gb: float = 1.0
    max_elements: int = 0
    M: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    ttl_minutes: int = 3
    auto_save_seconds: int = 300
    max_loaded_read_only_partitions: int = 50
    wal_cooling_time_seconds: int = 60
    num_threads: int = -1

    def __post_init__(self) -> None:
        if self.dimension <= 0 or self.M < 2 or self.space not in SPACES:
            raise ValueError(f"dimension must be above 0, M 2 or more, space one of {SPACES}")
        if self.max_elements <= 0:
            self.max_elements = max_elements(self.max_memory_gb, self.dimension, self.M)

    @classmethod
    def merged(cls, stored: dict | None, given: dict) -> DbConfig:
        """What is given stands before what is stored; the bucket capacity stays what it was at first."""
        given = {("dimension" if k == "dim" else k): v for k, v in given.items() if v is not None}
        if stored:
            given.pop("max_elements", None)
        return cls(**{**(stored or {}), **given})

    def to_dict(self) -> dict:
        return asdict(self)


def checked_prefix(prefix: str) -> str:
    if not prefix or prefix in (".", "..") or re.search(r"[/\\:]", prefix):
        raise ValueError(f"{prefix!r} can't be a database's name")
    return prefix
