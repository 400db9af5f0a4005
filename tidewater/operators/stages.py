"""A chain of stored stages that resumes: a stage whose inputs and parameters have not changed is read, not run again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidewater.operators.commits import path_of


@dataclass
class Stage:
    """make(spark, inputs, params): inputs has a frame for each of `needs` (earlier stages or sources). A changed make() gets a new version."""

    name: str
    make: Callable[[SparkSession, dict[str, DataFrame], dict], DataFrame]
    needs: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    version: int = 1


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


def source_print(spark: SparkSession, path: str) -> str:
    """What stands for the state of a stored source: names, lengths and times of its files."""
    system, at = path_of(spark, path)
    found, out = system.listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        out.append([f.getPath().getName(), f.getLen(), f.getModificationTime()])
    return _digest(sorted(out))


def run(spark: SparkSession, root: str, stages: list[Stage], sources: dict[str, str]) -> tuple[dict[str, DataFrame], list[str]]:
    """(a frame of each source and stage, the names of the stages that ran). Stages are listed after those they need.

    A stage's result lies under root/name/fingerprint; it counts once Spark has marked its write as successful, so a run that is
    lost in a stage begins again with that one."""
    frames = {n: spark.read.parquet(p) for n, p in sources.items()}
    prints, ran = {n: source_print(spark, p) for n, p in sources.items()}, []
    for s in stages:
        if s.name in prints:
            raise ValueError(f"two sources or stages are called {s.name}")
        if lost := [n for n in s.needs if n not in prints]:
            raise ValueError(f"{s.name} needs {', '.join(lost)} before it")
        prints[s.name] = _digest(s.name, s.version, s.params, [prints[n] for n in s.needs])
        path = f"{root.rstrip('/')}/{s.name}/{prints[s.name]}"
        system, done = path_of(spark, f"{path}/_SUCCESS")
        if not system.exists(done):
            s.make(spark, {n: frames[n] for n in s.needs}, s.params).write.mode("overwrite").parquet(path)
            ran.append(s.name)
        frames[s.name] = spark.read.parquet(path)
    return frames, ran
