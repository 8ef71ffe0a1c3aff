"""Raw claims tables derived from a star schema of customers, orders, line items and events.

The texts are plain SQL, run here by Spark over whole tables; every row of the driving table
gives one raw row. They plant what raw extracts suffer from: missing ids, two rows under one id,
claims of unknown patients, patients without claims, open intervals, unpriced and zero-cost
claims, and one provider with a third of all claims.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_SQL = {
    "patients": """
        select case when c_custkey % 211 <> 5 then
            'p' || cast(case when c_custkey % 50 = 7 then c_custkey - 1 else c_custkey end as string) end as Id,
          case when c_custkey % 89 <> 4 then date '1925-01-01' + cast((c_custkey * 7919) % 28000 as int) end as BIRTHDATE,
          case when c_custkey % 11 = 0 then date '1925-01-01' + cast((c_custkey * 7919) % 28000 + 300 as int) end as DEATHDATE,
          case when c_custkey % 97 = 6 then 'U' when c_custkey % 101 = 8 then null
            when c_custkey % 2 = 0 then 'M' else 'F' end as GENDER,
          case when c_custkey % 79 <> 2 then c_mktsegment || ' ' || cast(c_nationkey % 4 as string) end as RACE,
          r_name as ETHNICITY,
          case when c_custkey % 83 <> 6 then n_name end as STATE,
          lpad(cast(c_custkey % 100000 as string), 5, '0') as ZIP
        from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
    """,
    "encounters": """
        select case when o_orderkey % 499 <> 0 then
            'e' || cast(case when o_orderkey % 29 = 4 then o_orderkey - 1 else o_orderkey end as string) end as Id,
          case when o_orderkey % 353 <> 2 then
            'p' || cast(case when o_custkey % 41 = 3 then o_custkey + 1 else o_custkey end as string) end as PATIENT,
          case when o_orderkey % 31 = 0 then null when o_orderkey % 3 = 0 then 'provider-0000'
            else 'provider-' || lpad(cast((o_orderkey * 31) % 997 as string), 4, '0') end as PROVIDER,
          o_orderpriority as PAYER,
          case when o_orderkey % 59 = 8 then null else case o_orderkey % 7 when 0 then 'ambulatory' when 1 then 'emergency'
            when 2 then 'inpatient' when 3 then 'outpatient' when 4 then 'urgentcare' when 5 then 'wellness'
            else 'hospice' end end as ENCOUNTERCLASS,
          cast(o_orderkey % 13 as string) as CODE, 'Status ' || o_orderstatus as DESCRIPTION,
          o_orderdate + interval '1' minute * cast(o_orderkey % 1440 as int) as START,
          case when o_orderkey % 37 <> 5 then
            o_orderdate + interval '1' minute * cast(o_orderkey % 1440 + o_orderkey % 577 as int) end as STOP,
          cast(129.16 as double) as BASE_ENCOUNTER_COST,
          cost_cents / cast(100 as double) as TOTAL_CLAIM_COST,
          floor(cost_cents * (o_orderkey % 101) / cast(100 as double)) / cast(100 as double) as PAYER_COVERAGE
        from (select *, case when o_orderkey % 331 = 1 then null when o_orderkey % 23 = 0 then 0
            else cast(round(o_totalprice * 100) as bigint) % 1000000 end as cost_cents from {orders}) priced
    """,
    "conditions": """
        select case when event_id % 101 <> 7 then 'p' || cast(user_id as string) end as PATIENT,
          'e' || cast(event_id as string) as ENCOUNTER,
          case when event_id % 103 <> 9 then event_type end as CODE, props as DESCRIPTION,
          cast(ts as date) - 8100 as START,
          case when event_id % 3 <> 0 then cast(ts as date) - 8100 + cast(event_id % 90 as int) end as STOP
        from {events}
    """,
    "medications": """
        select case when l_orderkey % 109 <> 7 then 'p' || cast(o_custkey as string) end as PATIENT,
          'e' || cast(l_orderkey as string) as ENCOUNTER,
          case when l_orderkey % 107 <> 3 then cast(l_partkey as string) end as CODE, p_name as DESCRIPTION,
          cast(l_shipdate as date) as START,
          case when l_linestatus = 'F' then cast(l_shipdate as date) + cast(l_quantity as int) end as STOP,
          p_retailprice as BASE_COST, floor(l_extendedprice * 50) / cast(100 as double) as PAYER_COVERAGE,
          l_extendedprice as TOTALCOST
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey
    """,
}

_INPUTS = {
    "patients": ("customer", "nation", "region"),
    "encounters": ("orders",),
    "conditions": ("events",),
    "medications": ("lineitem", "orders", "part"),
}


def star_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One raw table; zone-less timestamps become timestamps of the session zone."""
    inputs = {name: star_table(spark, sf_dir, name) for name in _INPUTS[table]}
    raw = spark.sql(RAW_SQL[table], **inputs)
    zoneless = [f.name for f in raw.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return raw.withColumns({name: F.col(name).cast("timestamp") for name in zoneless})


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {table: raw_table(spark, sf_dir, table) for table in RAW_SQL}


def object_notifications(spark: SparkSession, sf_dir: str, defects: bool = False) -> DataFrame:
    """Object-created notification documents, one JSON text per event row.

    Keys are URL-encoded, every fifth record has no size, every seventeenth document lists no
    records and every third lists two. With ``defects``, of nineteen documents one is no JSON, one has a record
    without a key and one a size that is no number. ``arrived`` is the time of the event.
    """
    events = star_table(spark, sf_dir, "events")
    zone = F.when(F.col("event_type") == "error", "claims").otherwise("patients")
    name = F.concat_ws("/", zone, F.concat_ws(" ", "event_type", "user_id"), "props")
    size = F.when(F.col("event_id") % 5 != 0, F.round(F.col("value") * 100).cast("bigint"))

    def record(key):
        return F.struct(F.struct(
            F.struct(F.lit("raw-zone").alias("name")).alias("bucket"),
            F.struct(F.url_encode(key).alias("key"), size.alias("size")).alias("object"),
        ).alias("s3"))

    once = F.array(record(name))
    twice = F.array(record(name), record(F.concat(name, F.lit("+copy"))))
    records = F.when(F.col("event_id") % 17 == 0, F.slice(once, 1, 0)).when(
        F.col("event_id") % 3 == 0, twice).otherwise(once)
    good = F.to_json(F.struct(records.alias("Records")))
    if not defects:
        return events.select(good.alias("value"), F.col("ts").cast("timestamp").alias("arrived"))
    keyless = F.lit('{"Records": [{"s3": {"bucket": {"name": "raw-zone"}, "object": {"size": 1}}}]}')
    unsized = F.lit('{"Records": [{"s3": {"bucket": {"name": "raw-zone"}, "object": {"key": "k", "size": "many"}}}]}')
    value = F.when(F.col("event_id") % 19 == 1, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).when(
        F.col("event_id") % 19 == 2, keyless).when(F.col("event_id") % 19 == 3, unsized).otherwise(good)
    return events.select(value.alias("value"), F.col("ts").cast("timestamp").alias("arrived"))
