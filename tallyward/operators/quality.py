"""Data checks over raw, staging and mart tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.schemas import AGE_GROUPS, COST_TIERS, GENDERS

# The declared column checks, nineteen in all.
# table -> (columns that must be unique, columns that must be present, column -> accepted values)
DECLARED_CHECKS: dict[str, tuple[tuple[str, ...], tuple[str, ...], dict[str, tuple[str, ...]]]] = {
    "stg_patients": (("patient_id",), ("patient_id", "gender", "age_years"), {"gender": GENDERS}),
    "stg_encounters": (("encounter_id",), ("encounter_id", "patient_id", "total_claim_cost"), {}),
    "stg_conditions": ((), ("patient_id", "condition_code"), {}),
    "stg_medications": ((), ("patient_id", "medication_code"), {}),
    "mart_claims_summary": (
        ("encounter_id",), ("encounter_id",), {"cost_tier": COST_TIERS, "age_group": AGE_GROUPS}),
    "mart_patient_metrics": (("patient_id",), ("patient_id",), {}),
}

RAW_CHECK = ("table_name STRING, status STRING, success BOOLEAN, has_rows BOOLEAN, "
             "no_empty_cols BOOLEAN, row_count BIGINT")


def dq_unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count("*").alias("n_records")).where(F.col("n_records") > 1)


def dq_not_null(df: DataFrame, *columns: str) -> DataFrame:
    """NULL count of every named column, all from one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def dq_accepted_values(df: DataFrame, column: str, accepted: Iterable[str]) -> DataFrame:
    """Values outside the list with their row counts; NULL passes."""
    return df.where(~F.col(column).isin(list(accepted))).groupBy(column).agg(F.count("*").alias("n_records"))


def _result(table: str, column: str, test: str, failing: Column) -> Column:
    return F.struct(
        F.lit(f"{test} {table}.{column}").alias("check_name"),
        F.lit(table).alias("table_name"),
        F.lit(column).alias("column_name"),
        F.lit(test).alias("test"),
        failing.alias("failing"),
        (failing == 0).alias("passed"),
    )


def watched_counters(table: str, key: str | None = None) -> dict[str, Column]:
    """What a write of the table's rows can count in passing: NULLs per checked column, rows with an unlisted value.

    With ``key`` the rows are those of the source of a staging model, which takes only rows that have the key.
    """
    _, present, accepted = DECLARED_CHECKS[table]
    counted = F.col(key).isNotNull() if key else F.lit(True)
    nulls = {f"nulls_{c}": F.count_if(counted & F.col(c).isNull()) for c in present}
    return nulls | {f"unlisted_{c}": F.count_if(counted & ~F.col(c).isin(list(v))) for c, v in accepted.items()}


def _repeated(df: DataFrame, key: str) -> DataFrame:
    return dq_unique(df, key).agg(F.count("*").alias("repeated"))


def _from_counters(df: DataFrame, table: str, counters: dict[str, int]) -> DataFrame:
    """The checks of a table whose write has counted, in the order of ``table_checks``: only uniqueness scans it again, and
    what has unlisted values."""
    unique, present, accepted = DECLARED_CHECKS[table]

    def known(*results: Column) -> DataFrame:
        return df.sparkSession.range(1).select(F.inline(F.array(*results)))

    parts = [_repeated(df, key).select(F.inline(F.array(_result(table, key, "unique", F.col("repeated"))))) for key in unique]
    parts.append(known(*[_result(table, c, "not_null", F.lit(counters[f"nulls_{c}"]).cast("bigint")) for c in present]))
    parts += [
        _unlisted(df, table, c, values) if counters[f"unlisted_{c}"]
        else known(_result(table, c, "accepted_values", F.lit(0).cast("bigint"))) for c, values in accepted.items()]
    return reduce(DataFrame.unionByName, parts)


def _unlisted(df: DataFrame, table: str, column: str, values: tuple[str, ...]) -> DataFrame:
    unlisted = dq_accepted_values(df, column, values).agg(F.count("*").alias("unlisted"))
    return unlisted.select(F.inline(F.array(_result(table, column, "accepted_values", F.col("unlisted")))))


def table_checks(df: DataFrame, table: str, counters: dict[str, int] | None = None) -> DataFrame:
    """One row per declared check of a table.

    A failing count is the number of repeated values, NULL rows or distinct unlisted values.
    Uniqueness and presence share one scan: rows are first counted per key, combined on the
    map side, and the counters then add up. Accepted values scan just their own column. With the ``counters``
    of the table's write (``watched_counters``) only uniqueness needs a scan.
    """
    if counters is not None:
        return _from_counters(df, table, counters)
    unique, present, accepted = DECLARED_CHECKS[table]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in present]
    results = []
    if unique:
        (key,) = unique
        per_key = df.groupBy(key).agg(F.count("*").alias("copies"), *nulls)
        repeated = F.count_if(F.col(key).isNotNull() & (F.col("copies") > 1))
        counts = per_key.agg(
            repeated.alias("repeated"),
            *[F.coalesce(F.sum(f"nulls_{c}"), F.lit(0)).alias(f"nulls_{c}") for c in present])
        results.append(_result(table, key, "unique", F.col("repeated")))
    else:
        counts = df.agg(*nulls)
    results += [_result(table, c, "not_null", F.col(f"nulls_{c}")) for c in present]
    report = counts.select(F.inline(F.array(*results)))
    return reduce(DataFrame.unionByName, [report, *[_unlisted(df, table, c, values) for c, values in accepted.items()]])


def dq_report(tables: dict[str, DataFrame], watched: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Every declared check over the staging models and marts; ``watched`` holds the counters of those whose write has counted."""
    return reduce(DataFrame.unionByName, [
        table_checks(tables[name], name, (watched or {}).get(name)) for name in DECLARED_CHECKS])


def validate_raw(spark: SparkSession, raw: dict[str, DataFrame | None]) -> DataFrame:
    """Row count and header check per raw table; a table that was not landed is skipped."""
    parts = []
    for table, df in raw.items():
        if df is None:
            parts.append(spark.createDataFrame([(table, "SKIP", None, None, None, None)], RAW_CHECK))
            continue
        has_rows = F.col("row_count") > 0
        named = all(name.strip() for name in df.columns)
        success = has_rows & F.lit(named)
        parts.append(df.agg(F.count("*").alias("row_count")).select(
            F.lit(table).alias("table_name"),
            F.when(success, "PASS").otherwise("FAIL").alias("status"),
            success.alias("success"),
            has_rows.alias("has_rows"),
            F.lit(named).alias("no_empty_cols"),
            "row_count",
        ))
    return reduce(DataFrame.unionByName, parts)
