"""Transcripts to the progress feed of one machine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from turnwise.operators import progress as P, records as R
from turnwise.session import materialize


@dataclass(frozen=True)
class Progress:
    projects: DataFrame
    stages: DataFrame
    subtasks: DataFrame


def build(lines: DataFrame, repo_roots: DataFrame, live: DataFrame, machine: str, home: str, deny: DataFrame | None = None) -> Progress:
    """Projects, stages and to-dos from numbered lines, known repositories and the live registry."""
    records = R.read_records(lines, P.PROGRESS_MARKERS)
    latest = materialize(P.latest_progress(records), "latest_progress")
    roots = P.project_root(latest.select("cwd"), repo_roots, home)
    stages, subtasks = P.build_progress(latest, roots, live, machine, deny)
    stages = materialize(stages, "stages")
    return Progress(P.project_rollup(stages), stages, subtasks)
