"""Stages that run when their input has changed: a table of finished runs, by the fingerprint of what each read.

The state is a keyed store of its own. A stage is written to it once it has ended, so a run that failed goes on
with the stage that failed; stages whose input is as it was are left out. A fingerprint lists files and reads none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.jobs import keyed_store
from corpusql.operators.store import fingerprint

_STATE = "stage string, fingerprint string, run long, number long"


@dataclass(frozen=True)
class Stage:
    """listing: path, length and modificationTime of what the stage reads. work: what it does; its result is kept in no place."""

    name: str
    listing: Callable[[SparkSession], DataFrame]
    work: Callable[[SparkSession], None]


def run_stages(spark: SparkSession, stages: list[Stage], path: str, run: int) -> dict[str, str]:
    """Runs the stages in order as run ``run`` (a number that grows) and tells 'done' or 'unchanged' of each.

    Once a stage has worked, those behind it see what it has left, so each fingerprint is taken when its turn comes. An error
    ends the run after the stages before have been noted.
    """
    said: dict[str, str] = {}
    for number, stage in enumerate(stages):
        now = fingerprint(stage.listing(spark), "path", "length", "modificationTime").first().fingerprint or ""
        known = keyed_store.read(spark, path, ["stage"])
        before = known.where(F.col("stage") == stage.name).select("fingerprint").first() if known is not None else None
        if before is not None and before.fingerprint == now:
            said[stage.name] = "unchanged"
            continue
        stage.work(spark)
        done = spark.createDataFrame([(stage.name, now, run, number)], _STATE)
        keyed_store.write(done, path, ["stage"], run * 1000 + number)
        said[stage.name] = "done"
    return said


def backfill(known: DataFrame, wanted: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame], path: str, batch: int) -> int:
    """Writes what ``make`` gives for the rows of ``wanted`` whose key ``known`` has not, as one batch; how many rows that were."""
    todo = wanted.join(known.select(*keys).distinct(), keys, "left_anti")
    n = todo.count()
    if n:
        keyed_store.write(make(todo), path, keys, batch)
    return n
