"""Memoised stages: a result is used again if and only if everything that it was made from is the same.

A stage's address is a hash of its name, its own version, its settings and the addresses of what it reads; tables from
outside enter by a digest of their rows, functions by the version that their owner gives. Under its address lies the
result as Parquet and beside it, written last, a one-row receipt; Spark commits both whole or not at all, so a lost
executor or a killed driver leaves nothing that could be taken for a result. What was done is a table of its own.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REUSED, MADE, BROKEN, BLOCKED = "reused", "made", "broken", "blocked"
JOURNAL = "stage string, address string, state string, took_s double, why string"


class Step(NamedTuple):
    """What became of a stage; ``table`` is None if it is broken or blocked."""

    stage: str
    address: str
    state: str
    took_s: float
    table: DataFrame | None
    why: str | None = None


class Producer:
    """A function from outside with the version that its owner gives; another version makes other results."""

    def __init__(self, version: str, call: Callable[..., Any]):
        self.version, self.call = version, call

    def __call__(self, *a: Any) -> Any:
        return self.call(*a)


def address_of(*parts: Any) -> str:
    """20 hex digits for plain values, in which the order of a mapping's keys does not matter."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=repr).encode()).hexdigest()[:20]


def digest(df: DataFrame) -> str:
    """The same for the same rows in any order and layout: their number and two sums over a hash of each."""
    h = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    r = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1 << 40))).alias("s")).first()
    return address_of(df.dtypes, r["n"], r["x"], r["s"])


class Memo:
    """Results of stages below ``root``, any path that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.steps: list[Step] = []

    def journal(self) -> DataFrame:
        """What was done in this session, one row per stage, in order."""
        return self.spark.createDataFrame([(s.stage, s.address, s.state, s.took_s, s.why) for s in self.steps], JOURNAL)

    def _there(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def find(self, stage: str, address: str) -> DataFrame | None:
        """The result at this address if its receipt is there and speaks of it."""
        at = f"{self.root}/{stage}/{address}"
        if not (self._there(f"{at}/receipt") and self._there(f"{at}/rows")):
            return None
        known = self.spark.read.parquet(f"{at}/receipt").filter((F.col("address") == address) & (F.col("stage") == stage))
        return self.spark.read.parquet(f"{at}/rows") if known.limit(1).count() else None

    def keep(self, stage: str, address: str, made: DataFrame, settings: Mapping) -> DataFrame:
        at = f"{self.root}/{stage}/{address}"
        made.write.mode("overwrite").parquet(f"{at}/rows")
        told = self.spark.range(1).select(F.lit(stage).alias("stage"), F.lit(address).alias("address"), F.lit(json.dumps(dict(settings), sort_keys=True, default=repr)).alias("settings"), F.current_timestamp().alias("at"))
        told.write.mode("overwrite").parquet(f"{at}/receipt")
        return self.spark.read.parquet(f"{at}/rows")

    def step(self, stage: str, version: int, reads: Sequence[Step], make: Callable[..., DataFrame], settings: Mapping | None = None, anew: bool = False) -> Step:
        """Take the result that is there, or make and keep it; an error keeps nothing and is told in the step."""
        settings = settings or {}
        address = address_of(stage, version, settings, [r.address for r in reads])
        began = time.monotonic()
        missing = [r.stage for r in reads if r.table is None]
        if missing:
            found = Step(stage, address, BLOCKED, 0.0, None, "without " + ", ".join(missing))
        else:
            table, state, why = (None if anew else self.find(stage, address)), REUSED, None
            if table is None:
                try:
                    table, state = self.keep(stage, address, make(*[r.table for r in reads]), settings), MADE
                except Exception as e:  # told in the step, and what reads it is blocked
                    state, why = BROKEN, f"{type(e).__name__}: {e}"
            found = Step(stage, address, state, time.monotonic() - began, table, why)
        self.steps.append(found)
        return found


class Stage(NamedTuple):
    """A stage of a graph: what it reads by name, how it is made, and what else its result depends on."""

    name: str
    version: int
    reads: Sequence[str]
    make: Callable[..., DataFrame]
    settings: Mapping = {}


def run_graph(memo: Memo, stages: Iterable[Stage], anew: Sequence[str] = ()) -> dict[str, Step]:
    """All stages in order; those named in ``anew`` are made again. A name that no stage has is an error."""
    stages = list(stages)
    strange = sorted(set(anew) - {s.name for s in stages})
    if strange:
        raise ValueError(f"no such stage: {', '.join(strange)}")
    done: dict[str, Step] = {}
    for s in stages:
        done[s.name] = memo.step(s.name, s.version, [done[n] for n in s.reads], s.make, s.settings, s.name in anew)
    return done
