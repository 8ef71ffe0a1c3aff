"""What each report page shows, as named frames over the same marts.

Nothing runs until a frame is used; cache or materialise the marts to serve a whole page.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tallyward.operators import claims as c
from tallyward.operators import overview as o
from tallyward.operators import patients as p
from tallyward.operators import providers as v

Page = dict[str, DataFrame]


def overview_page(claims: DataFrame, patients: DataFrame) -> Page:
    return {
        "cards": o.overview_cards(claims),
        "trend": o.overview_trend(claims),
        "tiers": o.tier_chart(claims),
        "classes": o.class_counts(claims),
        "ages": o.age_chart(claims),
        "genders": o.gender_patients(patients),
        "states": o.state_top12(claims),
    }


def claims_page(claims: DataFrame, rows: int = 200, **selection: Iterable[str] | None) -> Page:
    return {
        "cards": c.claims_cards(claims, **selection),
        "states": c.claims_state_cost(claims, **selection),
        "coverage": c.class_coverage_split(claims, **selection),
        "trend": c.claims_trend(claims, **selection),
        "detail": c.claims_detail_table(claims, rows, **selection),
    }


def patients_page(patients: DataFrame, rows: int = 100, **selection: Iterable[str] | None) -> Page:
    return {
        "states": p.distinct_states(patients),
        "cards": p.patient_cards(patients, **selection),
        "ages": p.age_histogram(patients, **selection),
        "races": p.patients_by_race(patients, **selection),
        "scatter": p.patient_scatter(patients, **selection),
        "chronic": p.chronic_distribution(patients, **selection),
        "detail": p.patient_detail_table(patients, rows, **selection),
    }


def providers_page(claims: DataFrame, top_n: int = 25, metric: str = "Total Billed") -> Page:
    return {
        "cards": v.provider_cards(claims),
        "board": v.provider_leaderboard(claims, top_n, metric),
        "detail": v.provider_detail_table(claims, top_n, metric),
    }
