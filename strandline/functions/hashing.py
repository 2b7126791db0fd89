"""Content keys. Spark has no blake2b, so these few run as Arrow-batched functions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _blake8(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=8).hexdigest())


def text_key(text: Column, voice: str, speed: float) -> Column:
    """Key of one spoken line."""
    return _blake8(F.concat(F.lit(f"{voice}:{speed}:"), text))


def fingerprint(size: int, blocks: Iterable[bytes]) -> str:
    """Fingerprint of a file from its size and sampled blocks."""
    h = hashlib.blake2b(f"v1:{size}:".encode(), digest_size=16)
    for b in blocks:
        h.update(b)
    return h.hexdigest()


def sample_offsets(size: int, block: int = 8 << 20) -> list[tuple[int, int]]:
    """(offset, length) of what a fingerprint reads: the start, and beyond two blocks the middle and the end."""
    spots = [(0, min(block, size))]
    if size > 2 * block:
        spots += [(size // 2 - block // 2, block), (size - block, block)]
    return spots
