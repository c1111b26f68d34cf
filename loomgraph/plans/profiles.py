"""Runtime profiles: chunk limits and batch sizes by the kind of machine."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Profile:
    """What a run takes from its machine."""

    kind: str
    chunk_limit: int
    chunk_overlap: int
    model_batch: int
    accelerators: int = 0


#: Limits of the two profiles and of the plain chunker.
PROFILES = {"local_cpu": Profile("local_cpu", 3000, 30, 16), "local_cuda": Profile("local_cuda", 6000, 60, 64)}
CHUNKER_DEFAULTS = (8000, 80)


def runtime_profile(spark: SparkSession, force: str | None = None) -> Profile:
    """The profile of a session: by accelerators its executors are given (or that this machine shows), unless forced; an unknown name counts as CPU."""
    amount = int(spark.conf.get("spark.executor.resource.gpu.amount", "0") or 0)
    shown = [x for x in os.environ.get("CUDA_VISIBLE_DEVICES", "").split(",") if x.strip() not in ("", "-1")]
    count = amount or len(shown)
    kind = force or ("local_cuda" if count else "local_cpu")
    base = PROFILES.get(kind, PROFILES["local_cpu"])
    return Profile(kind, base.chunk_limit, base.chunk_overlap, base.model_batch, count)
