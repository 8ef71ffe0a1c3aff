import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, RUN_TS
from frames import tables
from tallyward.functions.labels import age_label, fmt_money, short_id, tier_label
from tallyward.operators import claims as c
from tallyward.operators import overview as o
from tallyward.operators import patients as p
from tallyward.operators import providers as v
from tallyward.operators.filters import eq_filters, in_filters
from tallyward.operators.marts import claims_mart, patient_mart
from tallyward.sources.export import envelope, with_total, write_json


@pytest.fixture(scope="module")
def processed(spark):
    return tables(spark, AS_OF, RUN_TS)


@pytest.fixture(scope="module")
def claims(processed):
    return claims_mart(processed["encounters"], processed["patients"]).cache()


@pytest.fixture(scope="module")
def patients(processed):
    return patient_mart(*[processed[t] for t in ("patients", "encounters", "conditions", "medications")]).cache()


def priced(spark, rows):
    """A claims mart with just the columns the figures read."""
    return spark.createDataFrame(
        [(f"e{i}", provider, Decimal(cost), Decimal(payer)) for i, (provider, cost, payer) in enumerate(rows)],
        "encounter_id string, provider_id string, total_claim_cost decimal(18,2), payer_coverage decimal(18,2)"
    ).withColumn("out_of_pocket", F.col("total_claim_cost") - F.col("payer_coverage")).withColumn("patient_id", F.lit("p"))


def test_claim_of_an_unknown_patient_stays_and_counts_as_senior(claims):
    rows = {r.encounter_id: r for r in claims.collect()}
    assert len(rows) == 5
    assert (rows["e4"].state, rows["e4"].age_years, rows["e4"].age_group) == (None, None, "senior")
    assert {k: r.cost_tier for k, r in rows.items()} == {
        "e1": "zero_cost", "e2": "low", "e3": "low", "e4": "high", "e5": "low"}


def test_claims_mart_has_its_twenty_columns(claims, patients):
    assert len(claims.columns) == 20 and len(patients.columns) == 20


def test_patient_without_encounters_has_zeros_and_no_dates(patients):
    rows = {r.patient_id: r for r in patients.collect()}
    assert len(rows) == 4
    d = rows["d"]
    assert (d.total_encounters, d.total_claim_cost, d.avg_claim_cost, d.emergency_visits, d.total_conditions,
            d.total_medications, d.total_medication_cost) == (0, Decimal(0), 0.0, 0, 0, 0, Decimal(0))
    assert d.first_encounter_date is None and d.last_encounter_date is None


def test_patient_measures(patients):
    a, b = (patients.where(F.col("patient_id") == k).first() for k in "ab")
    assert (a.total_encounters, a.total_claim_cost, a.avg_claim_cost, a.emergency_visits) == (2, Decimal(100), 50.0, 1)
    assert (a.first_encounter_date, a.last_encounter_date) == (dt.date(2001, 3, 4), dt.date(2001, 4, 4))
    assert (a.total_conditions, a.chronic_conditions) == (3, 1)
    assert (b.total_medications, b.active_medications, b.total_medication_cost) == (2, 1, Decimal("5.50"))


def test_two_payer_measures_differ(spark):
    rows = priced(spark, [("p", 0, 0), ("p", 100, 50), ("p", 300, 300)])
    assert o.overview_kpis(rows).first().payer_pct == 87.5
    assert v.provider_kpis(rows).first().network_payer_pct == 75.0


def test_averages_round_half_up_on_exact_decimals(spark):
    rows = priced(spark, [("p", Decimal("1.00"), 0), ("p", Decimal("1.01"), 0)])
    assert o.overview_kpis(rows).first().avg_cost == 1.01


def test_empty_selection_means_the_listed_classes(claims):
    assert c.claims_kpis(claims).first().claims == 3  # hospice and 'Emergency' are not listed
    assert c.claims_kpis(claims, classes=[]).first().claims == 3
    assert c.claims_kpis(claims, classes=["hospice"]).first().claims == 1


def test_nothing_selected_gives_zero_and_nulls(claims, patients):
    kpis = c.claims_kpis(claims, classes=["none"]).first()
    assert kpis.claims == 0 and kpis.avg_cost is None and kpis.payer_pct is None and kpis.total_cost is None
    kpis = p.patient_kpis(patients, states=["none"]).first()
    assert kpis.total_patients == 0 and kpis.pct_emergency is None
    assert c.claims_cards(claims, classes=["none"]).first().avg_cost is None
    assert p.patient_cards(patients, states=["none"]).first().patients == "0"
    assert o.overview_cards(claims.where(F.lit(False))).first().total_billed is None
    assert p.age_histogram(patients, states=["none"]).count() == 0


def test_patient_page_without_a_choice_keeps_everyone(patients):
    assert p.patient_kpis(patients, states=[], ages=None).first().total_patients == 4


def test_quotes_in_filter_values_are_data(patients):
    assert [r.patient_id for r in p.patient_metrics(patients, state="O'Brien").collect()] == ["a"]
    assert [r.patient_id for r in p.patient_detail(patients, states=["O'Brien"]).collect()] == ["a"]
    assert p.get_patient(patients, "x' OR '1'='1").count() == 0


def test_point_lookup(patients):
    assert p.get_patient(patients, "b").first().gender == "M"
    assert p.get_patient(patients, "zzz").isEmpty()


def test_blank_filters_put_no_condition(claims):
    assert eq_filters(claims, cost_tier=None, age_group="").count() == 5
    assert in_filters(claims, cost_tier=[], age_group=None).count() == 5


@pytest.mark.parametrize("call, low, high", [
    (lambda f, n: c.claims_summary(f["claims"], n), 1, 1000),
    (lambda f, n: c.claims_detail(f["claims"], n), 50, 1000),
    (lambda f, n: p.patient_metrics(f["patients"], n), 1, 500),
    (lambda f, n: p.patient_detail(f["patients"], n), 50, 500),
    (lambda f, n: v.top_providers(f["claims"], n), 1, 100),
    (lambda f, n: v.provider_leaderboard(f["claims"], n), 10, 50),
])
def test_limit_bounds(claims, patients, call, low, high):
    frames = {"claims": claims, "patients": patients}
    call(frames, low), call(frames, high)
    for wrong in (low - 1, high + 1):
        with pytest.raises(ValueError):
            call(frames, wrong)


def test_newest_first_with_ties_by_key(claims):
    assert [r.encounter_id for r in c.claims_summary(claims).collect()] == ["e4", "e3", "e2", "e1", "e5"]
    assert [r.encounter_id for r in c.claims_summary(claims, 2).collect()] == ["e4", "e3"]


@pytest.mark.parametrize("limit", [1, 2, 3, 5, 6, 7, 9, 10, 100])
def test_newest_first_against_brute_force(spark, claims, limit):
    days = [dt.date(2001, 1, 1 + i % 4) if i % 5 else None for i in range(12)]
    rows = spark.createDataFrame([(f"e{i:02d}", day) for i, day in enumerate(days)], "encounter_id string, encounter_date date")
    spread = rows.repartition(4)
    for name in set(claims.columns) - set(rows.columns):
        spread = spread.withColumn(name, F.lit(None).cast(claims.schema[name].dataType))
    expected = sorted(((day is None, -(day or dt.date.min).toordinal(), f"e{i:02d}") for i, day in enumerate(days)))[:limit]
    got = [r.encounter_id for r in c.claims_summary(spread, limit).collect()]
    assert got == [key for _, _, key in expected]
    assert c.claims_summary(spread.where("encounter_date is null"), 1).collect()[0].encounter_id == "e00"


def test_costliest_first(patients):
    assert [r.patient_id for r in p.patient_metrics(patients).collect()] == ["c", "b", "a", "d"]


def test_leaderboard_ranks_only_the_top_by_billed(spark):
    rows = [(f"big-{i:03d}", 1000 + i, 0) for i in range(10)] + [("small-000", 1, 0)] * 5
    claims = priced(spark, rows).withColumns({
        "patient_id": F.col("encounter_id"), "encounter_class": F.lit("wellness")})
    board = v.provider_leaderboard(claims, 10, "Unique Patients").collect()
    assert "small-000" not in {r.provider_id for r in board}  # most patients, but not among the top billed
    assert [r.rank for r in board] == list(range(1, 11))
    assert board[0].provider_id == "big-000" and board[0].short_id == "big-000..."
    with pytest.raises(ValueError):
        v.provider_leaderboard(claims, 10, "Unlucky")


def test_months_without_a_date_form_a_null_month(spark, claims):
    undated = claims.withColumn("encounter_year", F.lit(None).cast("int"))
    trend = o.overview_trend(claims.unionByName(undated)).collect()
    assert trend[0].month is None and trend[0].claims == 5
    assert trend[1].month == dt.date(2001, 3, 1) and trend[1].claims == 2


def test_histogram_covers_the_range(spark):
    ages = spark.createDataFrame([(float(i), i) for i in (0, 10, 29, 30, 60)], "x double, age_years bigint")
    bins = p.age_histogram(ages, bins=3).collect()
    assert [(r.bin, r.bin_start, r.bin_end, r.patients) for r in bins] == [
        (0, 0.0, 20.0, 2), (1, 20.0, 40.0, 2), (2, 40.0, 60.0, 1)]
    same = p.age_histogram(ages.where("age_years = 10")).collect()
    assert [(r.bin, r.patients) for r in same] == [(0, 1)]


def test_display_text(spark):
    one = spark.createDataFrame([(1,)], "x int")
    text = lambda value: one.select(fmt_money(F.lit(value))).first()[0]
    assert [text(v) for v in (1_234_567, 1_000_000, 450_000, 999_999, 2_500, 830, 1.5, 0, -5)] == [
        "$1.2M", "$1.0M", "$450K", "$1000K", "$2K", "$830", "$2", "$0", "$-5"]
    assert one.select(fmt_money(F.lit(None).cast("double"))).first()[0] is None
    row = one.select(short_id(F.lit("abcdefghij")), tier_label(F.lit("low")), tier_label(F.lit("odd")),
                     age_label(F.lit("adult")), age_label(F.lit("adult"), filter_box=True)).first()
    assert list(row) == ["abcdefgh...", "Low (<$500)", "odd", "Adult (18-64)", "Adult (18–64)"]


def test_cards(claims):
    cards = o.overview_cards(claims).first()
    assert cards.total_claims == "5" and cards.total_billed == "$7K" and cards.avg_claim_cost == "$1,380"
    assert c.claims_cards(claims, classes=["hospice"]).first().total_billed == "$6,000"


def test_envelope_keeps_order_and_counts(spark, claims, tmp_path):
    listing = c.claims_summary(claims, 3)
    row = envelope(listing, "claims", 1000).first()
    assert row.total == 3 and [r.encounter_id for r in row.claims] == ["e4", "e3", "e2"]
    assert {r.total for r in with_total(listing).collect()} == {3}
    write_json(listing, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_pages_hold_working_frames(claims, patients):
    from tallyward.plans.pages import claims_page, overview_page, patients_page, providers_page

    pages = [overview_page(claims, patients), claims_page(claims, 50, classes=["hospice"]),
             patients_page(patients, 50, states=["MA"]), providers_page(claims, 10, "Total Claims")]
    assert [len(page) for page in pages] == [7, 5, 7, 3]
    assert pages[1]["detail"].columns[0] == "Encounter ID" and pages[1]["detail"].count() == 1
    assert pages[2]["cards"].first().patients == "2"
    assert [r["#"] for r in pages[3]["detail"].collect()] == [1, 2]
