"""Batch pipelines of reports: landed file to published report, step by step."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from larkspur.sources import reports

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Report:
    """A report: the prefix of its landed files, what is made of it, and where it is published."""

    name: str
    prefix: str
    output: str
    transform: Transform = lambda df: df
    kind: str = "csv"


@dataclass(frozen=True)
class Pipeline:
    name: str
    reports: tuple[Report, ...]


@dataclass
class Outcome:
    status: str
    steps: dict[str, str] = field(default_factory=dict)
    faults: dict[str, Exception] = field(default_factory=dict)

    def counts(self) -> dict[str, int]:
        return {s: sum(v.split(":")[0] == s for v in self.steps.values()) for s in ("success", "failed", "skipped")}


def named(pipelines: Iterable[Pipeline], name: str) -> Pipeline:
    for p in pipelines:
        if p.name == name:
            return p
    raise ValueError(f"no pipeline {name!r}")


def run(spark: SparkSession, pipeline: Pipeline, landed: str | DataFrame, published: str, skip: Iterable[str] = ()) -> Outcome:
    """Each report's newest landed file (of a folder, or of a catalogue: path, name, modified), transformed and published; a report that fails does not stop the others, and its fault is kept."""
    files = (reports.catalogue(spark, landed) if isinstance(landed, str) else landed).cache()
    steps: dict[str, str] = {}
    faults: dict[str, Exception] = {}
    for report in pipeline.reports:
        if report.name in set(skip):
            steps[report.name] = "skipped"
            continue
        try:
            df = reports.csv(spark, reports.newest_path(files, report.prefix))
            reports.published(report.transform(df), f"{published}/{report.output}", report.kind)
            steps[report.name] = "success"
        except Exception as fault:  # the fault is part of the outcome
            steps[report.name], faults[report.name] = f"failed: {fault}", fault
    files.unpersist()
    failed = any(s.startswith("failed") for s in steps.values())
    return Outcome("partial" if failed and any(s == "success" for s in steps.values()) else "failed" if failed else "success", steps, faults)
