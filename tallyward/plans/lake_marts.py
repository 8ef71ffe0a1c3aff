"""Marts over all days of a lake, kept up to date by the days that change.

Each day of the processed zone is an extract of its own: encounters, conditions and medications of several days add up, and
a patient who comes again is described by the newest day. A changed day is read once, for three small tables
of that day below ``root``: per-patient partials, its claims, and their rollup. The patient mart and the
page figures are merged from those; no other day's rows are read again, except the claims of patients
whose description has changed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators.increments import merge_partials, newest_rows, patient_mart_of, patient_partials
from tallyward.operators.marts import claims_mart, claims_mart_in_date_order
from tallyward.operators.measures import claims_rollup, merge_rollups
from tallyward.operators.staging import stage
from tallyward.operators.transforms import TRANSFORMS
from tallyward.schemas import CORE_TABLES, RAW_COLUMNS
from tallyward.sources.swap import Store, replace_folders
from tallyward.sources.zones import read_processed_partition, write_processed

_DAY = ("year", "month", "day")
DIMENSION = "dimension"


class LakeMarts:
    def __init__(self, spark: SparkSession, processed: str, root: str):
        self.spark, self.processed, self.root = spark, processed, root

    def _empty(self, table: str) -> DataFrame:
        nothing = self.spark.createDataFrame([], ", ".join(f"`{header}` STRING" for header in RAW_COLUMNS[table]))
        return TRANSFORMS[table](nothing, dt.date(1970, 1, 1), dt.datetime(1970, 1, 1))

    def _day(self, table: str, day: dt.date) -> DataFrame:
        """The staged rows of one day, none if it is not there."""
        try:
            rows = read_processed_partition(self.spark, self.processed, table, day)
        except FileNotFoundError:
            rows = self._empty(table)
        return stage(f"stg_{table}", rows)

    def _all_days(self, root: str, table: str, otherwise: DataFrame) -> DataFrame:
        """All days of a table with ``run_date``."""
        try:
            rows = self.spark.read.parquet(f"{root}/{table}")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return otherwise.withColumn("run_date", F.lit(None).cast("date"))
        return rows.withColumn("run_date", F.make_date(*map(F.col, _DAY))).drop(*_DAY)

    def _dimension(self) -> DataFrame:
        """The newest description of each patient, from all days of the processed zone."""
        return newest_rows(stage_with_day(self._all_days(self.processed, "patients", self._empty("patients"))), "patient_id", "run_date")

    def _kept_dimension(self) -> DataFrame:
        place = f"{self.root}/{DIMENSION}"
        if not Store(self.spark, self.root).exists(place):
            return stage("stg_patients", self._empty("patients"))
        return self.spark.read.parquet(place)

    def refresh(self, changed: Iterable[dt.date]) -> list[dt.date]:
        """Bring the marts up to date after these days have come, changed or gone; the days whose claims were written."""
        days = set(changed)
        for day in sorted(days):
            partials = patient_partials(*[self._day(t, day) for t in CORE_TABLES if t != "patients"])
            write_processed(partials, self.root, "partials", day)
        described = ["gender", "race", "ethnicity", "state", "age_years"]
        before = self._kept_dimension().select("patient_id", F.struct(*described).alias("before"))
        fresh = self._dimension()
        moved = fresh.select("patient_id", F.struct(*described).alias("after")).join(before, "patient_id", "full").where(
            ~F.col("before").eqNullSafe(F.col("after"))).select("patient_id")
        seen = self._all_days(self.root, "partials", self._partials_of_nothing()).where("encounters > 0")
        # One date per day that holds claims of such a patient; only dates reach the driver.
        days |= {row.run_date for row in seen.join(moved, "patient_id", "left_semi").select("run_date").distinct().collect()}
        replace_folders(self.spark, self.root, [DIMENSION], lambda staged: fresh.write.parquet(f"{staged}/{DIMENSION}"))
        for day in sorted(days):
            claims = claims_mart_in_date_order(self._day("encounters", day), self._kept_dimension())
            write_processed(claims, self.root, "claims", day)
            written = read_processed_partition(self.spark, self.root, "claims", day)
            write_processed(claims_rollup(written), self.root, "rollup", day)
        return sorted(days)

    def _partials_of_nothing(self) -> DataFrame:
        return patient_partials(*[self._empty(t) for t in CORE_TABLES if t != "patients"])

    def claims(self) -> DataFrame:
        """The claims mart of all days, as ``claims_mart`` gives it for their union."""
        nothing = claims_mart(stage("stg_encounters", self._empty("encounters")), self._kept_dimension())
        return self._all_days(self.root, "claims", nothing).drop("run_date")

    def patients(self) -> DataFrame:
        """The patient mart of all days, merged from their partials."""
        partials = self._all_days(self.root, "partials", self._partials_of_nothing()).drop("run_date")
        return patient_mart_of(self._kept_dimension(), merge_partials(partials))

    def rollup(self) -> DataFrame:
        """Counts and sums of the claims of all days, for the figures of the pages."""
        nothing = claims_rollup(self.claims().limit(0))
        return merge_rollups(self._all_days(self.root, "rollup", nothing).drop("run_date"))


def stage_with_day(rows: DataFrame) -> DataFrame:
    """The staged patients with the day that they come from."""
    staged = stage("stg_patients", rows)
    return rows.where(F.col("patient_id").isNotNull()).select(*staged.columns, "run_date")
