"""Check texts: what each query must return, as SQL over the star-schema tables.

Every text derives the raw tables with the statements of the adapter and computes the rest on
its own. Averages are rounded half up in whole numbers, so no binary fraction decides a tie.
"""

from __future__ import annotations

from tallyward.sources.star_schema import RAW_SQL

# What the results are called and made of, written out here so that a wrong one in the package shows.
AGE_FILTER_LABELS = {'pediatric': 'Pediatric (<18)', 'adult': 'Adult (18–64)', 'senior': 'Senior (65+)'}
AGE_LABELS = {'pediatric': 'Pediatric (<18)', 'adult': 'Adult (18-64)', 'senior': 'Senior (65+)'}
TIER_LABELS = {'zero_cost': 'Zero', 'low': 'Low (<$500)', 'medium': 'Medium (<$5k)', 'high': 'High (≥$5k)'}
CLAIM_HEADINGS = {'encounter_id': 'Encounter ID',
     'encounter_class': 'Class',
     'encounter_date': 'Date',
     'state': 'State',
     'age_group': 'Age Group',
     'gender': 'Gender',
     'total_claim_cost': 'Total Cost ($)',
     'payer_coverage': 'Payer Coverage ($)',
     'out_of_pocket': 'Out-of-Pocket ($)',
     'cost_tier': 'Cost Tier'}
PATIENT_HEADINGS = {'patient_id': 'Patient ID',
     'gender': 'Gender',
     'race': 'Race',
     'state': 'State',
     'age_years': 'Age',
     'age_group': 'Age Group',
     'total_encounters': 'Encounters',
     'total_claim_cost': 'Total Cost ($)',
     'avg_claim_cost': 'Avg Cost ($)',
     'total_out_of_pocket': 'Total OOP ($)',
     'emergency_visits': 'ER Visits',
     'chronic_conditions': 'Chronic Conds',
     'active_medications': 'Active Meds'}
PROVIDER_HEADINGS = {'rank': '#',
     'provider_id': 'Provider ID',
     'total_claims': 'Claims',
     'total_billed': 'Total Billed ($)',
     'avg_cost': 'Avg Cost ($)',
     'unique_patients': 'Unique Patients',
     'total_payer_coverage': 'Payer Coverage ($)',
     'total_oop': 'Out-of-Pocket ($)'}
CLAIM_CHOICE = {'classes': ['emergency', 'inpatient'], 'tiers': ['medium', 'high'], 'ages': ['adult', 'senior']}
NO_CLAIM = {'classes': ["O'Brien"]}
PATIENT_CHOICE = {'states': ['NATION_3', 'NATION_7', 'NATION_11'], 'ages': ['adult'], 'genders': ['F']}
NO_PATIENT = {'states': ["O'Brien"]}
AGE_GROUPS = ('pediatric', 'adult', 'senior')
COST_TIERS = ('zero_cost', 'low', 'medium', 'high')
ENCOUNTER_CLASSES = ('ambulatory', 'emergency', 'inpatient', 'outpatient', 'urgentcare', 'wellness')
LANDED_TABLES = ('patients', 'encounters', 'conditions', 'medications', 'procedures', 'observations')
STAGING_MODELS = {'stg_patients': ('patients', 'patient_id',
                      ('patient_id', 'birth_date', 'death_date', 'gender', 'race', 'ethnicity', 'state',
                       'zip_code', 'age_years', 'is_deceased', 'processed_at')),
     'stg_encounters': ('encounters', 'encounter_id',
                        ('encounter_id', 'patient_id', 'provider_id', 'payer_id', 'encounter_class',
                         'encounter_code', 'description', 'encounter_start', 'encounter_stop',
                         'encounter_date', 'encounter_year', 'encounter_month', 'duration_hours',
                         'base_cost', 'total_claim_cost', 'payer_coverage', 'out_of_pocket',
                         'processed_at')),
     'stg_conditions': ('conditions', 'patient_id',
                        ('patient_id', 'encounter_id', 'condition_code', 'condition_description',
                         'onset_date', 'resolution_date', 'is_chronic', 'days_active', 'processed_at')),
     'stg_medications': ('medications', 'patient_id',
                         ('patient_id', 'encounter_id', 'medication_code', 'medication_description',
                          'start_date', 'stop_date', 'is_active', 'base_cost', 'payer_coverage',
                          'total_cost', 'out_of_pocket', 'processed_at'))}
RAW_COLUMNS = {'patients': {'Id': ('patient_id', 'string'),
                  'BIRTHDATE': ('birth_date', 'date'),
                  'DEATHDATE': ('death_date', 'date'),
                  'GENDER': ('gender', 'string'),
                  'RACE': ('race', 'string'),
                  'ETHNICITY': ('ethnicity', 'string'),
                  'STATE': ('state', 'string'),
                  'ZIP': ('zip_code', 'string')},
     'encounters': {'Id': ('encounter_id', 'string'),
                    'PATIENT': ('patient_id', 'string'),
                    'PROVIDER': ('provider_id', 'string'),
                    'PAYER': ('payer_id', 'string'),
                    'ENCOUNTERCLASS': ('encounter_class', 'string'),
                    'CODE': ('encounter_code', 'string'),
                    'DESCRIPTION': ('description', 'string'),
                    'START': ('encounter_start', 'timestamp'),
                    'STOP': ('encounter_stop', 'timestamp'),
                    'BASE_ENCOUNTER_COST': ('base_cost', 'decimal(18,2)'),
                    'TOTAL_CLAIM_COST': ('total_claim_cost', 'decimal(18,2)'),
                    'PAYER_COVERAGE': ('payer_coverage', 'decimal(18,2)')},
     'conditions': {'PATIENT': ('patient_id', 'string'),
                    'ENCOUNTER': ('encounter_id', 'string'),
                    'CODE': ('condition_code', 'string'),
                    'DESCRIPTION': ('condition_description', 'string'),
                    'START': ('onset_date', 'date'),
                    'STOP': ('resolution_date', 'date')},
     'medications': {'PATIENT': ('patient_id', 'string'),
                     'ENCOUNTER': ('encounter_id', 'string'),
                     'CODE': ('medication_code', 'string'),
                     'DESCRIPTION': ('medication_description', 'string'),
                     'START': ('start_date', 'date'),
                     'STOP': ('stop_date', 'date'),
                     'BASE_COST': ('base_cost', 'decimal(18,2)'),
                     'PAYER_COVERAGE': ('payer_coverage', 'decimal(18,2)'),
                     'TOTALCOST': ('total_cost', 'decimal(18,2)')}}

_STAR = ("customer", "nation", "region", "orders", "events", "lineitem", "part")
AS_OF = "date '2001-12-31'"
RUN_TS = "timestamp '2001-12-31 06:00:00'"
CORE = ("patients", "encounters", "conditions", "medications")
DAY = "year=2001/month=12/day=31"


# --- pieces of SQL ------------------------------------------------------------------------------


def mean(column: str, scale: int) -> str:
    cents, n, power = f"cast(sum(cast({column} as decimal(28,2))) * 100 as hugeint)", f"count({column})", 10**scale
    rounded = f"sign({cents}) * ((2 * {power} * abs({cents}) + 100 * {n}) // nullif(200 * {n}, 0))"
    return f"cast({rounded} as double) / {power}"


def total(column: str, scale: int) -> str:
    return f"cast(round(sum({column}), {scale}) as double)"


def ratio_pct(part: str, whole: str) -> str:
    return f"round(cast(sum({part}) as double) / nullif(cast(sum({whole}) as double), 0) * 100, 1)"


def labelled(code: str, labels: dict[str, str]) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in labels.items())
    return f"case {code} {cases} else {code} end"


def whole(value: str) -> str:
    return f"format('{{:,}}', cast(trunc({value}) as bigint))"


def fixed(value: str) -> str:
    return f"cast(cast({value} as decimal(20,1)) as varchar)"


def money(value: str) -> str:
    return (f"case when {value} >= 1000000 then format('${{:.1f}}M', {value} / 1000000) "
            f"when {value} >= 1000 then format('${{:.0f}}K', {value} / 1000) "
            f"else format('${{:,.0f}}', {value}) end")


def among(column: str, values) -> str:
    quoted = ", ".join("'" + value.replace("'", "''") + "'" for value in values)
    return f"{column} in ({quoted})"


def claim_rows(classes=None, tiers=None, ages=None) -> str:
    return " and ".join([
        among("encounter_class", classes or ENCOUNTER_CLASSES),
        among("cost_tier", tiers or COST_TIERS),
        among("age_group", ages or AGE_GROUPS)])


def patient_rows(states=None, ages=None, genders=None) -> str:
    chosen = [among(c, v) for c, v in (("state", states), ("age_group", ages), ("gender", genders)) if v]
    return " and ".join(chosen) or "true"


# --- common tables ------------------------------------------------------------------------------


def _typed(table: str) -> str:
    columns = ", ".join(f"cast({h} as {k}) as {n}" for h, (n, k) in RAW_COLUMNS[table].items())
    return f"select {columns} from raw_{table}"


def _first_of(relation: str, keys: list[str], rest: list[str]) -> str:
    order = ", ".join(f"{c} nulls first" for c in rest)
    return (f"select * exclude (rn) from (select *, row_number() over (partition by {', '.join(keys)} order by {order}) as rn "
            f"from {relation} where {' and '.join(f'{k} is not null' for k in keys)}) where rn = 1")


def _names(table: str) -> list[str]:
    return [name for name, _ in RAW_COLUMNS[table].values()]


_TIER = ("case when total_claim_cost = 0 then 'zero_cost' when total_claim_cost < 500 then 'low' "
         "when total_claim_cost < 5000 then 'medium' else 'high' end")
_AGE = "case when age_years < 18 then 'pediatric' when age_years < 65 then 'adult' else 'senior' end"

_ZEROED = ("total_encounters", "total_claim_cost", "avg_claim_cost", "total_out_of_pocket", "emergency_visits",
           "total_conditions", "chronic_conditions", "total_medications", "active_medications",
           "total_medication_cost")

_COMMON: dict[str, str] = {
    **{f"raw_{t}": RAW_SQL[t].format(**{s: s for s in _STAR}) for t in CORE},
    **{f"typed_{t}": _typed(t) for t in CORE},
    "patients": f"""
        select patient_id, birth_date, death_date, gender, race, ethnicity, state, zip_code,
          cast(floor(({AS_OF} - birth_date) / 365) as bigint) as age_years,
          death_date is not null as is_deceased, {RUN_TS} as processed_at
        from ({_first_of("typed_patients", ["patient_id"], _names("patients")[1:])})""",
    "encounters": f"""
        select encounter_id, patient_id, provider_id, payer_id, encounter_class, encounter_code, description,
          encounter_start, encounter_stop, cast(encounter_start as date) as encounter_date,
          cast(year(encounter_start) as int) as encounter_year, cast(month(encounter_start) as int) as encounter_month,
          round((epoch(encounter_stop) - epoch(encounter_start)) / 3600, 2) as duration_hours,
          base_cost, total_claim_cost, payer_coverage, total_claim_cost - payer_coverage as out_of_pocket,
          {RUN_TS} as processed_at
        from ({_first_of("typed_encounters", ["encounter_id"], _names("encounters")[1:])})""",
    "conditions": f"""
        select patient_id, encounter_id, condition_code, condition_description, onset_date, resolution_date,
          resolution_date is null as is_chronic,
          cast(case when resolution_date is null then {AS_OF} - onset_date else resolution_date - onset_date end as int) as days_active,
          {RUN_TS} as processed_at
        from typed_conditions where patient_id is not null""",
    "medications": f"""
        select patient_id, encounter_id, medication_code, medication_description, start_date, stop_date,
          stop_date is null as is_active, base_cost, payer_coverage, total_cost,
          total_cost - payer_coverage as out_of_pocket, {RUN_TS} as processed_at
        from typed_medications where patient_id is not null""",
    "claims": f"""
        select encounter_id, e.patient_id, provider_id, payer_id, encounter_class, description as encounter_description,
          encounter_date, encounter_year, encounter_month, duration_hours, total_claim_cost, payer_coverage, out_of_pocket,
          gender, race, ethnicity, state, age_years, {_TIER} as cost_tier, {_AGE} as age_group
        from encounters e left join patients p on e.patient_id = p.patient_id""",
    "encounter_metrics": """
        select patient_id, count(*) as total_encounters, sum(total_claim_cost) as total_claim_cost,
          cast(sum(total_claim_cost) as double) / nullif(count(total_claim_cost), 0) as avg_claim_cost,
          sum(out_of_pocket) as total_out_of_pocket, min(encounter_date) as first_encounter_date,
          max(encounter_date) as last_encounter_date,
          cast(count(*) filter (where encounter_class = 'emergency') as bigint) as emergency_visits
        from encounters group by patient_id""",
    "condition_metrics": """
        select patient_id, count(*) as total_conditions, cast(count(*) filter (where is_chronic) as bigint) as chronic_conditions
        from conditions group by patient_id""",
    "medication_metrics": """
        select patient_id, count(*) as total_medications, cast(count(*) filter (where is_active) as bigint) as active_medications,
          sum(total_cost) as total_medication_cost
        from medications group by patient_id""",
    "patient_mart": f"""
        select p.patient_id, gender, race, ethnicity, state, age_years, {_AGE} as age_group, is_deceased,
          first_encounter_date, last_encounter_date, {", ".join(f"coalesce({c}, 0) as {c}" for c in _ZEROED)}
        from patients p
          {" ".join(f"left join {m} on p.patient_id = {m}.patient_id"
                    for m in ("encounter_metrics", "condition_metrics", "medication_metrics"))}""",
}
_NEEDS = {
    **{f"raw_{t}": () for t in CORE},
    **{f"typed_{t}": (f"raw_{t}",) for t in CORE},
    **{t: (f"typed_{t}",) for t in CORE},
    "claims": ("encounters", "patients"),
    "encounter_metrics": ("encounters",),
    "condition_metrics": ("conditions",),
    "medication_metrics": ("medications",),
    "patient_mart": ("patients", "encounter_metrics", "condition_metrics", "medication_metrics"),
}


def over(body: str, *tables: str) -> str:
    """The body with the common tables it names, and those they rest on, put in front."""
    wanted: set[str] = set()
    pending = list(tables)
    while pending:
        name = pending.pop()
        if name not in wanted:
            wanted.add(name)
            pending += _NEEDS[name]
    listed = ",\n".join(f"{name} as ({text})" for name, text in _COMMON.items() if name in wanted)
    return f"with {listed}\n{body}"


def of_claims(body: str) -> str:
    return over(body, "claims")


def of_patients(body: str) -> str:
    return over(body, "patient_mart")


def doubles(columns: list[str], relation: str) -> str:
    """All columns, amounts as doubles."""
    amounts = {"base_cost", "total_claim_cost", "payer_coverage", "out_of_pocket", "total_cost",
               "total_out_of_pocket", "total_medication_cost"}
    return "select " + ", ".join(
        f"cast({c} as double) as {c}" if c in amounts else c for c in columns) + f" from {relation}"


CLAIM_COLUMNS = [
    "encounter_id", "patient_id", "provider_id", "payer_id", "encounter_class", "encounter_description",
    "encounter_date", "encounter_year", "encounter_month", "duration_hours", "total_claim_cost", "payer_coverage",
    "out_of_pocket", "gender", "race", "ethnicity", "state", "age_years", "cost_tier", "age_group"]
PATIENT_COLUMNS = [
    "patient_id", "gender", "race", "ethnicity", "state", "age_years", "age_group", "is_deceased",
    "total_encounters", "total_claim_cost", "avg_claim_cost", "total_out_of_pocket", "emergency_visits",
    "first_encounter_date", "last_encounter_date", "total_conditions", "chronic_conditions",
    "total_medications", "active_medications", "total_medication_cost"]
SUMMARY_COLUMNS = [
    "encounter_id", "patient_id", "encounter_class", "encounter_date", "total_claim_cost", "payer_coverage",
    "out_of_pocket", "cost_tier", "age_group", "gender", "state"]
SCATTER_COLUMNS = [
    "patient_id", "age_group", "gender", "total_encounters", "total_claim_cost", "chronic_conditions",
    "active_medications", "emergency_visits"]


def headed(body: str, headings: dict[str, str]) -> str:
    renamed = ", ".join(f'{k} as "{h}"' for k, h in headings.items())
    return f"select {renamed} from ({body})"


# --- report bodies ------------------------------------------------------------------------------

_NEWEST = "order by encounter_date desc nulls last, encounter_id limit"
_COSTLIEST = "order by total_claim_cost desc nulls last, patient_id limit"


def claims_summary(limit: int, where: str = "true") -> str:
    return doubles(SUMMARY_COLUMNS, f"(select * from claims where {where} {_NEWEST} {limit})")


def claims_detail(limit: int, where: str) -> str:
    return doubles(list(CLAIM_HEADINGS), f"(select * from claims where {where} {_NEWEST} {limit})")


def patient_listing(limit: int, where: str = "true") -> str:
    return doubles(list(PATIENT_HEADINGS), f"(select * from patient_mart where {where} {_COSTLIEST} {limit})")


def patient_scatter(where: str) -> str:
    return doubles(SCATTER_COLUMNS, f"(select * from patient_mart where {where} order by patient_id limit 800)")


CLAIMS_STATS = f"""
    select encounter_class, cost_tier, age_group, count(*) as total_claims, {mean("total_claim_cost", 2)} as avg_cost,
      {total("total_claim_cost", 2)} as total_cost, {mean("out_of_pocket", 2)} as avg_out_of_pocket
    from claims group by all"""
OVERVIEW_KPIS = f"""
    select count(*) as total_claims, count(distinct patient_id) as total_patients, {total("total_claim_cost", 0)} as total_cost,
      {mean("total_claim_cost", 2)} as avg_cost, {ratio_pct("payer_coverage", "total_claim_cost")} as payer_pct,
      {mean("out_of_pocket", 2)} as avg_oop from claims"""
TIER_COUNTS = "select cost_tier, count(*) as n from claims group by 1"
AGE_COSTS = f"""
    select age_group, count(*) as claims, {mean("total_claim_cost", 0)} as avg_cost, {mean("out_of_pocket", 0)} as avg_oop
    from claims where age_group is not null group by 1"""
LIVE_COUNTS = """
    select count(*) as claims_rows, count(distinct patient_id) as patients, count(distinct provider_id) as providers,
      count(distinct state) as states from claims"""
PROVIDER_KPIS = f"""
    select count(distinct provider_id) as total_providers, {mean("total_claim_cost", 0)} as network_avg_cost,
      {total("total_claim_cost", 0)} as network_total,
      round(avg(cast(payer_coverage as double) / nullif(cast(total_claim_cost as double), 0)) * 100, 1) as network_payer_pct
    from claims where provider_id is not null"""
MONTH = "make_date(encounter_year, encounter_month, 1)"


def claims_kpis(where: str) -> str:
    return f"""
    select count(*) as claims, {mean("total_claim_cost", 2)} as avg_cost,
      {ratio_pct("payer_coverage", "total_claim_cost")} as payer_pct, {mean("out_of_pocket", 2)} as avg_oop,
      {total("total_claim_cost", 0)} as total_cost from claims where {where}"""


def state_cost(where: str) -> str:
    return f"""
    select state, count(*) as claims, {total("total_claim_cost", 0)} as total_cost, {mean("total_claim_cost", 0)} as avg_cost,
      {mean("out_of_pocket", 0)} as avg_oop from claims where {where} and state is not null group by 1
    order by total_cost desc nulls last, state limit 15"""


def coverage_split(where: str) -> str:
    return f"""
    select encounter_class, {mean("payer_coverage", 0)} as avg_payer, {mean("out_of_pocket", 0)} as avg_oop
    from claims where {where} and encounter_class is not null group by 1"""


def claims_trend(where: str) -> str:
    return f"""
    select {MONTH} as month, count(*) as claims, {mean("total_claim_cost", 0)} as avg_cost
    from claims where {where} group by 1"""


def patient_kpis(where: str) -> str:
    return f"""
    select count(*) as total_patients, {mean("total_encounters", 1)} as avg_encounters, {mean("chronic_conditions", 1)} as avg_chronic,
      {mean("active_medications", 1)} as avg_meds, {mean("total_claim_cost", 0)} as avg_cost,
      round(cast(count(*) filter (where emergency_visits > 0) as double) / nullif(count(*), 0) * 100, 1) as pct_emergency,
      {mean("total_out_of_pocket", 0)} as avg_oop from patient_mart where {where}"""


def by_race(where: str) -> str:
    return f"""
    select race, count(*) as patients, {mean("total_claim_cost", 0)} as avg_cost from patient_mart
    where {where} and race is not null group by 1 order by patients desc, race limit 10"""


def ages(where: str) -> str:
    return f"select age_years, count(*) as n from patient_mart where {where} and age_years is not null group by 1"


def chronic(where: str) -> str:
    return f"""select chronic_conditions, count(*) as patients from patient_mart
    where {where} and chronic_conditions is not null group by 1"""


def leaderboard(top_n: int, metric: str) -> str:
    return f"""
    select *, cast(row_number() over (order by {metric} desc nulls last, provider_id) as int) as rank,
      substr(provider_id, 1, 8) || '...' as short_id
    from (select provider_id, count(*) as total_claims, {total("total_claim_cost", 0)} as total_billed,
        {mean("total_claim_cost", 0)} as avg_cost, {total("payer_coverage", 0)} as total_payer_coverage,
        {total("out_of_pocket", 0)} as total_oop, count(distinct patient_id) as unique_patients,
        count(distinct encounter_class) as encounter_types
      from claims where provider_id is not null group by 1
      order by total_billed desc nulls last, provider_id limit {top_n})"""


AGE_HISTOGRAM = f"""
    select bin, bin_start, bin_end, cast(sum(n) as bigint) as patients from (
      select n, bin, low + bin * span / cast(30 as double) as bin_start, low + (bin + 1) * span / cast(30 as double) as bin_end
      from (select n, low, high - low as span,
          least(cast(floor((age_years - low) * 30 / cast(high - low as double)) as bigint), 29) as bin
        from (select *, min(age_years) over () as low, max(age_years) over () as high from ({ages("true")}))))
    group by bin, bin_start, bin_end"""


# --- checks, landing and pipeline ---------------------------------------------------------------

def per_table(template: str, tables=CORE, sep: str = " union all ") -> str:
    return sep.join(template.format(t=t) for t in tables)


RAW_NAMES = tuple(f"raw_{t}" for t in CORE)
RAW_COUNTS = per_table("select '{t}' as table_name, count(*) as n_rows from raw_{t}")
CORE_COUNTS = per_table("select '{t}' as table_name, count(*) as n_rows from {t}")
STAGE_COUNTS = per_table("select 'stg_{t}' as table_name, count(*) as n_rows from {t}")
MART_COUNTS = ("select 'mart_claims_summary' as table_name, count(*) as n_rows from claims "
               "union all select 'mart_patient_metrics', count(*) from patient_mart")
KEYED_LANDING = per_table(
    "select '{t}' as table_name, count(*) as n_rows, '{t}/" + DAY + "' as key from raw_{t}")


def _check(table: str, column: str, test: str, failing: str) -> str:
    return (f"select '{test} {table}.{column}' as check_name, '{table}' as table_name, '{column}' as column_name, "
            f"'{test}' as test, cast(({failing}) as bigint) as failing")


def _unique(table: str, relation: str, column: str) -> str:
    return _check(table, column, "unique",
                  f"select count(*) from (select {column} from {relation} where {column} is not null group by 1 having count(*) > 1)")


def _not_null(table: str, relation: str, column: str) -> str:
    return _check(table, column, "not_null", f"select count(*) from {relation} where {column} is null")


def _accepted(table: str, relation: str, column: str, values: str) -> str:
    return _check(table, column, "accepted_values",
                  f"select count(distinct {column}) from {relation} where {column} not in ({values})")


CHECKS = " union all ".join([
    _unique("stg_patients", "patients", "patient_id"),
    _not_null("stg_patients", "patients", "patient_id"),
    _not_null("stg_patients", "patients", "gender"),
    _accepted("stg_patients", "patients", "gender", "'M', 'F'"),
    _not_null("stg_patients", "patients", "age_years"),
    _unique("stg_encounters", "encounters", "encounter_id"),
    _not_null("stg_encounters", "encounters", "encounter_id"),
    _not_null("stg_encounters", "encounters", "patient_id"),
    _not_null("stg_encounters", "encounters", "total_claim_cost"),
    _not_null("stg_conditions", "conditions", "patient_id"),
    _not_null("stg_conditions", "conditions", "condition_code"),
    _not_null("stg_medications", "medications", "patient_id"),
    _not_null("stg_medications", "medications", "medication_code"),
    _unique("mart_claims_summary", "claims", "encounter_id"),
    _not_null("mart_claims_summary", "claims", "encounter_id"),
    _accepted("mart_claims_summary", "claims", "cost_tier", "'zero_cost', 'low', 'medium', 'high'"),
    _accepted("mart_claims_summary", "claims", "age_group", "'pediatric', 'adult', 'senior'"),
    _unique("mart_patient_metrics", "patient_mart", "patient_id"),
    _not_null("mart_patient_metrics", "patient_mart", "patient_id"),
])
ALL = ("claims", "patient_mart", "conditions", "medications", "patients", "encounters")

DAILY_RUN = f"""
    select 'land' as step, table_name, n_rows as rows, 'ok' as status from ({RAW_COUNTS})
    union all select 'land', unnest(['procedures', 'observations']), null, 'skipped'
    union all select 'validate', table_name, n_rows, 'pass' from ({RAW_COUNTS})
    union all select 'transform', table_name, n_rows, 'ok' from ({CORE_COUNTS})
    union all select 'load', table_name, n_rows, 'ok' from ({CORE_COUNTS})
    union all select 'model', table_name, n_rows, 'ok' from ({MART_COUNTS})
    union all select 'check', check_name, failing, case when failing = 0 then 'pass' else 'fail' end from ({CHECKS})"""

# --- events -------------------------------------------------------------------------------------

NOTIFIED = """
    select 'raw-zone' as bucket, key || suffix as key, size, 'logged' as status from (
      select case when event_type = 'error' then 'claims' else 'patients' end || '/' || event_type || ' ' ||
          cast(user_id as varchar) || '/' || props as key,
        case when event_id % 5 <> 0 then cast(round(value * 100) as bigint) else 0 end as size,
        unnest(case when event_id % 17 = 0 then [] when event_id % 3 = 0 then ['', '+copy'] else [''] end) as suffix
      from events)"""
DEFECT_LOG = NOTIFIED.replace("from events)", "from events where event_id % 19 not in (1, 2, 3))")
DEFECT = """case event_id % 19 when 1 then 'broken ' || event_id
    when 2 then '{"Records": [{"s3": {"bucket": {"name": "raw-zone"}, "object": {"size": 1}}}]}'
    else '{"Records": [{"s3": {"bucket": {"name": "raw-zone"}, "object": {"key": "k", "size": "many"}}}]}' end"""
SUMMARIES = """
    select 200 as status_code, 'Ingestion trigger complete' as message, files as files_processed, cast(files * size as bigint) as total_size
    from (select case when event_id % 17 = 0 then 0 when event_id % 3 = 0 then 2 else 1 end::bigint as files,
        case when event_id % 5 <> 0 then cast(round(value * 100) as bigint) else 0 end as size from events)"""
ALARM = """
    select period_start, period_start + interval 5 minute as period_end, errors from (
      select time_bucket(interval 5 minute, ts) as period_start, count(*) as errors
      from events where event_type = 'error' group by 1)"""

PROCESSED = {t: over(doubles(
    list(columns), t), t) for _, (t, _, columns) in STAGING_MODELS.items()}

DEFECT_FAILED = f"""
        select {DEFECT} as value, case when event_id % 19 = 1 then 'not a JSON document' else 'unusable record' end as reason,
          'failed' as status from events where event_id % 19 in (1, 2, 3)"""


def three_days(table: str, key: str) -> str:
    """The processed table with each row as of its own day, which the last character of its key tells."""
    text = over(doubles(["*"], f"({_COMMON[table]})"), f"typed_{table}")
    run_date = f"({AS_OF} - cast(coalesce(ascii(right({key}, 1)) % 3, 0) as int))"
    return f"select *, {run_date} as run_date from ({text.replace(AS_OF, run_date)})"


THREE_DAYS = {"patients": three_days("patients", "patient_id"), "conditions": three_days("conditions", "patient_id")}

ORACLES: dict[str, str] = {
    "discover_csv": over(f"select table_name, cast(1 as bigint) as n_files, n_rows from ({RAW_COUNTS})", *RAW_NAMES),
    "read_raw_csv": over(doubles(_names("encounters") + ["false as corrupt"], "typed_encounters"), "typed_encounters"),
    "land_raw": over(KEYED_LANDING, *RAW_NAMES),
    "landing_stats": over(
        " union all ".join(
            f"select '{t}' as table_name, count(*) as row_count, cast({len(RAW_COLUMNS[t])} as bigint) as col_count, "
            f"{RUN_TS} as upload_ts, 'ehr' as source from raw_{t}" for t in CORE), *RAW_NAMES),
    "landing_manifest": over(
        f"select {RUN_TS} as upload_timestamp, 'ehr' as source, 'claims' as project, count(*) over () as total_tables, "
        f"cast(sum(n_rows) over () as bigint) as total_rows, table_name, n_rows, key from ({KEYED_LANDING})", *RAW_NAMES),
    "missing_tables": over(
        f"select name as table_name from (select unnest([{', '.join(repr(t) for t in LANDED_TABLES)}]) as name) "
        f"where name not in (select table_name from ({RAW_COUNTS}))", *RAW_NAMES),
    "read_raw_partition": PROCESSED["conditions"],
    "write_processed": over(per_table(
        "select '{t}' as table_name, count(*) as n_rows, '{t}/" + DAY + "' as key from {t}"), *CORE),
    "read_processed_partition": PROCESSED["encounters"],
    "load_warehouse": over(CORE_COUNTS, *CORE),
    "crawl_catalog": over(
        f"select table_name, 2001 as year, 12 as month, 31 as day, n_rows from ({RAW_COUNTS})", *RAW_NAMES),
    "source_ref": over(f"{CORE_COUNTS} union all {STAGE_COUNTS}", *CORE),
    "materialize": over(MART_COUNTS, "claims", "patient_mart"),
    "processed_sizes": over(f"select table_name, n_rows > 0 as has_bytes from ({CORE_COUNTS})", *CORE),
    **{f"read_raw_partition_{t}": PROCESSED[t] for t in ("patients", "encounters", "medications")},
    **{f"read_processed_partition_{t}": PROCESSED[t] for t in ("patients", "conditions", "medications")},
    **{f"load_warehouse_{t}": PROCESSED[t] for t in CORE},
    **{f"crawl_catalog_{t}": PROCESSED[t] for t in CORE},
    "materialize_claims": of_claims(doubles(CLAIM_COLUMNS, "claims")),
    "materialize_patients": of_patients(doubles(PATIENT_COLUMNS, "patient_mart")),
    "relanded_day": over(
        "select zone, 'encounters' as table_name, count(*) as n_rows, count(patient_id) as n_patients "
        "from encounters, (select unnest(['raw', 'processed']) as zone) where encounter_id like '%7' group by zone "
        "union all select unnest(['raw', 'processed']), 'conditions', 0, 0", "encounters"),
    "response_document": of_claims(
        f"select *, count(*) over () as total, cast(row_number() over (order by encounter_date desc nulls last, encounter_id) - 1 as int) as place "
        f"from ({claims_summary(100)})"),
    "result_envelope": of_claims(
        f"select *, count(*) over () as total from ({claims_summary(1000, among('encounter_class', ['emergency']))})"),
    "cached_reads": of_claims(CLAIMS_STATS),
    "daily_run": over(DAILY_RUN, *RAW_NAMES, *ALL),
    **{f"transform_{t}": PROCESSED[t] for t in CORE},
    **{f"stg_{t}": PROCESSED[t] for t in CORE},
    "cost_tier": over(
        f"select encounter_id, cost_tier, {labelled('cost_tier', TIER_LABELS)} as tier_label "
        f"from (select encounter_id, {_TIER} as cost_tier from encounters)", "encounters"),
    "age_group": over(
        f"select patient_id, age_group, {labelled('age_group', AGE_LABELS)} as age_label, "
        f"{labelled('age_group', AGE_FILTER_LABELS)} as filter_label "
        f"from (select patient_id, {_AGE} as age_group from patients)", "patients"),
    "eq_filters": of_claims(doubles(CLAIM_COLUMNS, "claims")
                            + " where encounter_class = 'emergency' and cost_tier = 'high' and age_group = 'senior'"),
    "in_filters": of_patients(doubles(PATIENT_COLUMNS, "patient_mart")
                              + f" where {patient_rows(PATIENT_CHOICE['states'], ['adult', 'senior'])}"),
    "get_patient": of_patients(doubles(PATIENT_COLUMNS, "patient_mart") + " where patient_id = 'p42'"),
    "known_dimensions": of_claims(
        "select state, encounter_class, count(*) as n from claims where state is not null and race is not null "
        "and provider_id is not null and encounter_class is not null and age_group is not null and gender is not null "
        "group by 1, 2"),
    "tier_label": of_claims(f"select *, {labelled('cost_tier', TIER_LABELS)} as label from ({TIER_COUNTS})"),
    "age_label": of_claims(f"select *, {labelled('age_group', AGE_LABELS)} as label from ({AGE_COSTS})"),
    "claims_detail_table": of_claims(headed(claims_detail(200, claim_rows()), CLAIM_HEADINGS)),
    "patient_detail_table": of_patients(headed(patient_listing(100), PATIENT_HEADINGS)),
    "provider_detail_table": of_claims(headed(leaderboard(25, "total_billed"), PROVIDER_HEADINGS)),
    "fmt_money": of_claims(
        f"select provider_id, short_id, {money('total_billed')} as billed_text, {money('avg_cost')} as avg_text "
        f"from ({leaderboard(50, 'total_billed')})"),
    "overview_cards": of_claims(
        f"select {whole('total_claims')} as total_claims, {whole('total_patients')} as unique_patients, "
        f"{money('total_cost')} as total_billed, '$' || {whole('avg_cost')} as avg_claim_cost, "
        f"{fixed('payer_pct')} || '%' as payer_coverage, '$' || {whole('avg_oop')} as avg_out_of_pocket "
        f"from ({OVERVIEW_KPIS})"),
    "claims_cards": of_claims(
        f"select {whole('claims')} as claims, '$' || {whole('total_cost')} as total_billed, "
        f"format('${{:,.2f}}', avg_cost) as avg_cost, {fixed('payer_pct')} || '%' as payer_coverage, "
        f"format('${{:,.2f}}', avg_oop) as avg_out_of_pocket from ({claims_kpis(claim_rows())})"),
    "patient_cards": of_patients(
        f"select {whole('total_patients')} as patients, {fixed('avg_encounters')} as avg_encounters, "
        f"{fixed('avg_chronic')} as avg_chronic, {fixed('avg_meds')} as avg_active_meds, "
        f"'$' || {whole('avg_cost')} as avg_claim_cost, '$' || {whole('avg_oop')} as avg_out_of_pocket, "
        f"{fixed('pct_emergency')} || '%' as with_emergency from ({patient_kpis('true')})"),
    "provider_cards": of_claims(
        f"select {whole('total_providers')} as total_providers, '$' || {whole('network_total')} as network_total, "
        f"'$' || {whole('network_avg_cost')} as network_avg_cost, "
        f"{fixed('network_payer_pct')} || '%' as network_payer_coverage from ({PROVIDER_KPIS})"),
    "live_count_cards": of_claims(
        "select " + ", ".join(f"{whole(x)} as {x}" for x in ("claims_rows", "patients", "providers", "states"))
        + f" from ({LIVE_COUNTS})"),
    "mart_claims_summary": of_claims(doubles(CLAIM_COLUMNS, "claims")),
    "mart_patient_metrics": of_patients(doubles(PATIENT_COLUMNS, "patient_mart")),
    "encounter_metrics": over(doubles([
        "patient_id", "total_encounters", "total_claim_cost", "avg_claim_cost", "total_out_of_pocket",
        "first_encounter_date", "last_encounter_date", "emergency_visits"], "encounter_metrics"), "encounter_metrics"),
    "condition_metrics": over("select * from condition_metrics", "condition_metrics"),
    "medication_metrics": over(doubles([
        "patient_id", "total_medications", "active_medications", "total_medication_cost"],
        "medication_metrics"), "medication_metrics"),
    "claims_stats": of_claims(CLAIMS_STATS),
    "cost_by_state": of_claims(f"""
        select state, count(*) as total_claims, {total("total_claim_cost", 2)} as total_cost,
          {mean("total_claim_cost", 2)} as avg_cost, {mean("out_of_pocket", 2)} as avg_out_of_pocket
        from claims where state is not null group by 1"""),
    "overview_kpis": of_claims(OVERVIEW_KPIS),
    "overview_trend": of_claims(
        f"select {MONTH} as month, count(*) as claims, {total('total_claim_cost', 0)} as total_cost from claims group by 1"),
    "cost_tier_counts": of_claims(TIER_COUNTS),
    "class_counts": of_claims(
        f"select encounter_class, count(*) as claims, {mean('total_claim_cost', 0)} as avg_cost "
        "from claims where encounter_class is not null group by 1"),
    "age_group_costs": of_claims(AGE_COSTS),
    "gender_patients": of_patients(
        "select gender, count(distinct patient_id) as patients from patient_mart where gender is not null group by 1"),
    "claims_kpis": of_claims(claims_kpis(claim_rows())),
    "claims_kpis_filtered": of_claims(claims_kpis(claim_rows(**CLAIM_CHOICE))),
    "claims_kpis_no_match": of_claims(claims_kpis(claim_rows(**NO_CLAIM))),
    "class_coverage_split": of_claims(coverage_split(claim_rows())),
    "class_coverage_split_filtered": of_claims(coverage_split(claim_rows(**CLAIM_CHOICE))),
    "claims_trend": of_claims(claims_trend(claim_rows())),
    "claims_trend_filtered": of_claims(claims_trend(claim_rows(**CLAIM_CHOICE))),
    "patient_kpis": of_patients(patient_kpis("true")),
    "patient_kpis_filtered": of_patients(patient_kpis(patient_rows(**PATIENT_CHOICE))),
    "patient_kpis_no_match": of_patients(patient_kpis(patient_rows(**NO_PATIENT))),
    "patients_by_race": of_patients(by_race("true")),
    "patients_by_race_filtered": of_patients(by_race(patient_rows(**PATIENT_CHOICE))),
    "age_distribution": of_patients(ages("true")),
    "age_distribution_filtered": of_patients(ages(patient_rows(**PATIENT_CHOICE))),
    "age_histogram": of_patients(AGE_HISTOGRAM),
    "chronic_distribution": of_patients(chronic("true")),
    "chronic_distribution_filtered": of_patients(chronic(patient_rows(**PATIENT_CHOICE))),
    "provider_kpis": of_claims(PROVIDER_KPIS),
    "live_counts": of_claims(LIVE_COUNTS),
    "distinct_states": of_patients("select distinct state from patient_mart where state is not null"),
    "dedupe_by_key": _first_of("lineitem", ["l_orderkey", "l_linenumber"], [
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        "l_linestatus", "l_shipdate"]),
    "provider_leaderboard": of_claims(leaderboard(25, "total_billed")),
    "provider_leaderboard_by_patients": of_claims(leaderboard(50, "unique_patients")),
    "provider_leaderboard_by_avg_cost": of_claims(leaderboard(10, "avg_cost")),
    "top_providers": of_claims(f"""
        select provider_id, count(*) as total_claims, {total("total_claim_cost", 2)} as total_billed,
          {mean("total_claim_cost", 2)} as avg_claim_cost, count(distinct patient_id) as unique_patients
        from claims where provider_id is not null group by 1 order by total_billed desc nulls last, provider_id limit 10"""),
    "state_top12": of_claims(f"""
        select state, count(*) as claims, {total("total_claim_cost", 0)} as total_cost from claims
        where state is not null group by 1 order by claims desc, state limit 12"""),
    "claims_state_cost": of_claims(state_cost(claim_rows())),
    "claims_state_cost_filtered": of_claims(state_cost(claim_rows(**CLAIM_CHOICE))),
    "claims_summary": of_claims(claims_summary(100)),
    "claims_summary_filtered": of_claims(claims_summary(
        1000, "encounter_class = 'inpatient' and cost_tier = 'medium' and age_group = 'adult'")),
    "claims_detail": of_claims(claims_detail(200, claim_rows())),
    "claims_detail_filtered": of_claims(claims_detail(1000, claim_rows(**CLAIM_CHOICE))),
    "patient_metrics": of_patients(patient_listing(50)),
    "patient_metrics_filtered": of_patients(patient_listing(500, "age_group = 'adult' and state = 'NATION_7'")),
    "patient_detail": of_patients(patient_listing(100)),
    "patient_detail_filtered": of_patients(patient_listing(500, patient_rows(**PATIENT_CHOICE))),
    "patient_scatter": of_patients(patient_scatter("true")),
    "patient_scatter_filtered": of_patients(patient_scatter(patient_rows(**PATIENT_CHOICE))),
    "validate_raw": over(
        per_table("select '{t}' as table_name, case when count(*) > 0 then 'PASS' else 'FAIL' end as status, "
                  "count(*) > 0 as success, count(*) > 0 as has_rows, true as no_empty_cols, count(*) as row_count from raw_{t}")
        + " union all select unnest(['procedures', 'observations']), 'SKIP', null, null, null, null", *RAW_NAMES),
    "dq_unique": over(
        "select encounter_id, count(*) as n_records from typed_encounters where encounter_id is not null "
        "group by 1 having count(*) > 1", "typed_encounters"),
    "dq_not_null": over(
        "select " + ", ".join(f"count(*) - count({x}) as {x}" for x in ("encounter_id", "patient_id", "total_claim_cost"))
        + " from encounters", "encounters"),
    "dq_accepted_values": over(
        "select gender, count(*) as n_records from patients where gender not in ('M', 'F') group by 1", "patients"),
    "dq_report": over(f"select *, failing = 0 as passed from ({CHECKS})", *ALL),
    "raw_partition_present": over(
        per_table("select '{t}' as table_name, cast(count(*) > 0 as bigint) as n_rows from raw_{t}"), *RAW_NAMES),
    "all_raw_partitions_present": over(
        per_table("select '{t}' as table_name, case when count(*) > 0 then 'PASS' else 'FAIL' end as status from raw_{t}",
                  ("patients", "encounters", "conditions"))
        + " union all select 'medications', 'FAIL'", "raw_patients", "raw_encounters", "raw_conditions"),
    "run_summary": over(
        f"select {AS_OF} as run_date, true as has_raw, table_name, case when n_rows > 0 then 'PASS' else 'FAIL' end as status, "
        f"n_rows > 0 as has_bytes from ({RAW_COUNTS})", *RAW_NAMES),
    "ingest_event_log": NOTIFIED,
    "ingest_event_log_prefix": f"select * from ({NOTIFIED}) where starts_with(key, 'claims/')",
    "ingest_event_log_stream": NOTIFIED,
    "ingest_batch_summary": SUMMARIES,
    "ingest_error_alarm": ALARM,
    "ingest_error_alarm_stream": ALARM,
    **{f"incremental_days_{t}": text for t, text in THREE_DAYS.items()},
    **{f"incremental_landing_{t}": PROCESSED[t] for t in CORE},
    "ingest_event_log_defects": DEFECT_LOG,
    "ingest_event_log_failed": DEFECT_FAILED,
    "ingest_event_handling_log": DEFECT_LOG,
    "ingest_event_handling_failed": DEFECT_FAILED,
    "ingest_log_lines": f"""
        select '{{"event":"s3_object_created","project":"claims","environment":"dev","bucket":"raw-zone","key":' || to_json(key) ||
          ',"size_bytes":' || size || ',"timestamp":"2001-12-31T06:00:00.000000"}}' as line from ({NOTIFIED})""",
    "ingest_failure_alarm": """
        select period_start, period_start + interval 5 minute as period_end, errors from (
          select time_bucket(interval 5 minute, ts) as period_start, count(*) as errors
          from events where event_id % 19 in (1, 2, 3) group by 1)""",
}

ROLLUP = of_claims("""
    select encounter_class, cost_tier, age_group, state, encounter_year, encounter_month, count(*) as n_claims,
      cast(sum(total_claim_cost) as double) as sum_total_claim_cost, count(total_claim_cost) as n_total_claim_cost,
      cast(sum(payer_coverage) as double) as sum_payer_coverage, count(payer_coverage) as n_payer_coverage,
      cast(sum(out_of_pocket) as double) as sum_out_of_pocket, count(out_of_pocket) as n_out_of_pocket
    from claims group by 1, 2, 3, 4, 5, 6""")
# The same figures from the rollup, and the same marts by increments.
ORACLES |= {f"rollup_{name}": ORACLES[name] for name in (
    "claims_stats", "cost_by_state", "overview_kpis", "overview_trend", "cost_tier_counts", "class_counts", "age_group_costs",
    "state_top12", "claims_kpis", "claims_kpis_filtered", "claims_kpis_no_match", "claims_state_cost", "claims_state_cost_filtered",
    "class_coverage_split", "class_coverage_split_filtered", "claims_trend", "claims_trend_filtered", "claims_cards")}
ORACLES |= {
    "claims_rollup": ROLLUP, "incremental_rollup": ROLLUP,
    "incremental_patient_mart": ORACLES["mart_patient_metrics"],
    "incremental_claims_mart": ORACLES["mart_claims_summary"],
    "incremental_overview_trend": ORACLES["overview_trend"],
}
ORACLES |= {
    "register_days": ORACLES["crawl_catalog"],
    "dq_report_counted": ORACLES["dq_report"],
    **{f"read_raw_csv_{t}": over(doubles(_names(t) + ["false as corrupt"], f"typed_{t}"), f"typed_{t}") for t in ("patients", "conditions", "medications")},
}
