"""Tables of jobs over data sets: steps in order, done ones skipped, failures written down, the rest goes on."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from quarry.sources import records


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[SparkSession, Job], None]
    done: Callable[[Job], str | None] = lambda job: None  # a path whose presence says that the step is done


@dataclass(frozen=True)
class Job:
    name: str
    input: str
    output: str
    options: dict = field(default_factory=dict)


def plan(spark: SparkSession, jobs: Iterable[Job], steps: Iterable[Step], limit: int | None = None) -> list[tuple[Job, Step]]:
    """What is to be done, in order: steps whose result isn't there, of jobs whose input is; at most ``limit`` jobs."""
    steps, out = list(steps), []
    for n, job in enumerate(j for j in jobs if records._exists(spark, j.input)):
        if limit is not None and n >= limit:
            break
        out += [(job, s) for s in steps if not ((path := s.done(job)) and records._exists(spark, path))]
    return out


def execute(spark: SparkSession, todo: list[tuple[Job, Step]], log: str | None = None) -> list[tuple[str, str, str]]:
    """Runs planned steps.  A failing step ends its job, not the others; returns (job, step, error), also appended to ``log``."""
    failed: list[tuple[str, str, str]] = []
    for job, step in todo:
        if any(name == job.name for name, _, _ in failed):
            continue
        try:
            step.run(spark, job)
        except Exception as error:  # whatever a step raises is its job's failure
            failed.append((job.name, step.name, str(error).splitlines()[0] if str(error) else type(error).__name__))
    if log and failed:
        spark.createDataFrame(failed, "job string, step string, error string").coalesce(1).write.mode("append").json(log)
    return failed
