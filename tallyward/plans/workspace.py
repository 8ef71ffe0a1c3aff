"""Processed tables and marts of one star-schema folder, written once and read many times.

Reports read written marts, as they would from a warehouse: the deduplication and joins run
once, every later query is a narrow scan, and a lost executor costs a re-read, not a re-run.
The tables lie in a folder of the workspace's own, by default below the session's shared folder; ``close``
removes it together with the databases that its runs have made.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tallyward.operators.marts import claims_mart, claims_mart_in_date_order, in_patient_order, patient_mart
from tallyward.operators.measures import claims_rollup
from tallyward.operators.staging import stage
from tallyward.operators.transforms import TRANSFORMS
from tallyward.plans.pipeline import Zones
from tallyward.session import remove_folder, shared_folder
from tallyward.sources.star_schema import raw_table


class Workspace:
    """``as_of`` is also the day under which everything is filed."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: dt.date, run_ts: dt.datetime, root: str | None = None):
        self.spark, self.sf_dir, self.as_of, self.run_ts = spark, sf_dir, as_of, run_ts
        self.root = root or f"{shared_folder(spark)}/tallyward-{uuid.uuid4().hex[:12]}"
        self.databases: list[str] = []
        self._written: dict[str, str] = {}
        self._done: dict[str, Any] = {}

    def zones(self, database: str) -> Zones:
        """Fresh zones for one run."""
        self.databases += [database, f"{database}_marts"]
        run = f"{self.root}/run-{uuid.uuid4().hex[:8]}"
        return Zones(f"{run}/source", f"{run}/raw", f"{run}/processed", f"{run}/warehouse", database)

    def scratch(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def _written_once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._written:
            path = f"{self.root}/{name}"
            build().write.mode("overwrite").option("compression", "zstd").parquet(path)
            self._written[name] = path
        return self.spark.read.parquet(self._written[name])

    def close(self) -> None:
        """Drop the databases of this workspace's runs and remove its folder."""
        for database in self.databases:
            self.spark.sql("DROP DATABASE IF EXISTS IDENTIFIER(:name) CASCADE", args={"name": database})
        remove_folder(self.spark, self.root)
        self.databases, self._written, self._done = [], {}, {}

    def once(self, step: str, run: Callable[[], Any]) -> Any:
        """Outcome of a step that writes; later queries build on the same files."""
        if step not in self._done:
            self._done[step] = run()
        return self._done[step]

    def raw(self, table: str) -> DataFrame:
        return raw_table(self.spark, self.sf_dir, table)

    def raw_written(self, table: str) -> DataFrame:
        """The raw table for steps that read it several times: its joins run once."""
        return self._written_once(f"extracts/{table}", lambda: self.raw(table))

    def transformed(self, table: str) -> DataFrame:
        """The transform as a lazy plan from the star schema."""
        return TRANSFORMS[table](self.raw(table), self.as_of, self.run_ts)

    def processed(self, table: str) -> DataFrame:
        return self._written_once(f"processed/{table}", lambda: self.transformed(table))

    def staged(self, model: str) -> DataFrame:
        return stage(model, self.processed(model.removeprefix("stg_")))

    def build_claims(self) -> DataFrame:
        return claims_mart(self.staged("stg_encounters"), self.staged("stg_patients"))

    def build_patients(self) -> DataFrame:
        return patient_mart(*[
            self.staged(f"stg_{t}") for t in ("patients", "encounters", "conditions", "medications")])

    def claims(self) -> DataFrame:
        return self._written_once("marts/mart_claims_summary", lambda: claims_mart_in_date_order(
            self.staged("stg_encounters"), self.staged("stg_patients")))

    def rollup(self) -> DataFrame:
        return self._written_once("marts/claims_rollup", lambda: claims_rollup(self.claims()).coalesce(1))

    def patients(self) -> DataFrame:
        return self._written_once("marts/mart_patient_metrics", lambda: in_patient_order(self.build_patients()))


_open: dict[tuple[str, str], Workspace] = {}


def open_workspace(spark: SparkSession, sf_dir: str, as_of: dt.date, run_ts: dt.datetime) -> Workspace:
    """One workspace per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = Workspace(spark, sf_dir, as_of, run_ts)
    return _open[key]
