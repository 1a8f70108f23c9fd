"""Two feeds derived from the tables orders, customer and nation.

There are no meeting feeds among the given tables, so each order becomes a CRM
meeting and most of them a calendar entry, with drift and defects placed by
modular arithmetic on the order key. The SQL is plain enough for Spark and for
other engines, so that results can be held against each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CALENDAR_SCHEMA, CRM_SCHEMA
from ..sources.feeds import with_raw

OWNERS = ("Sarah Chen", "Miguel Ortega", "Priya Sharma", "Jonas Weber", "Amelie Laurent", "Tom Okafor")


def _pick(key: str, values: tuple[str, ...]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_two = "lpad(CAST({0} AS STRING), 2, '0')"
_BASE = f"""
SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS st, o_custkey AS ck, c_mktsegment AS seg, n_name AS nation,
  {_pick("o_custkey", OWNERS)} AS owner, {_pick("o_custkey", tuple(o.lower().replace(" ", ".") + "@firma.com" for o in OWNERS))} AS mail,
  'Client ' || lpad(CAST(o_custkey AS STRING), 7, '0') AS client, 8 + o_orderkey % 9 AS hour, CASE WHEN o_orderkey % 2 = 0 THEN '00' ELSE '30' END AS minute
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
"""

CRM_SQL = f"""
SELECT 'CRM-' || lpad(CAST(k AS STRING), 9, '0') AS crm_id,
  {_pick("k", ("Portfolio Review", "LP Advisory Committee", "Allocation Strategy Call", "Fund Update", "Annual Planning"))} AS subject,
  CASE WHEN k % 19 = 0 THEN NULL WHEN k % 53 = 0 THEN ' Multiple ' ELSE client END AS client_name,
  CASE WHEN k % 19 = 0 THEN NULL ELSE seg || ' ' || nation || ' Partners' END AS client_company,
  owner AS relationship_owner,
  CASE WHEN k % 97 = 0 THEN 'not a date'
    WHEN k % 41 = 0 THEN lpad(CAST(month(day) AS STRING), 2, '0') || '-' || lpad(CAST(day(day) AS STRING), 2, '0') || '/' || CAST(year(day) AS STRING)
    ELSE CAST(day AS STRING) END AS meeting_date,
  CASE WHEN k % 37 = 0 THEN NULL ELSE {_two.format("hour")} || ':' || minute END AS meeting_time,
  CASE WHEN k % 19 = 0 THEN 'Internal' WHEN k % 3 = 0 THEN 'Virtual' ELSE 'In-Person' END AS meeting_type,
  CASE WHEN k % 23 = 0 THEN NULL WHEN k % 3 = 0 THEN 'Zoom' WHEN k % 4 = 0 THEN 'Palm Court - ' || nation ELSE 'Harbour Office ' || nation END AS location,
  CASE WHEN k % 29 = 0 THEN '' ELSE 'Discuss ' || lower(seg) || ' exposure' END AS notes,
  CASE WHEN k % 101 = 0 THEN 'pending' WHEN k % 43 = 0 THEN 'Cancelled' WHEN st = 'F' THEN 'Completed' WHEN st = 'O' THEN 'Scheduled' ELSE 'Tentative' END AS status,
  CAST(day AS STRING) || 'T06:00:00Z' AS created_at
FROM ({_BASE}) b
"""

_ENTRY = f"""
SELECT 'CAL-' || lpad(CAST(k AS STRING), 9, '0') || '-' || CAST(n AS STRING) AS event_id, CASE WHEN k % 5 = 1 THEN seg || ' LPAC' ELSE seg || ' ' || {_pick("k", ("Portfolio", "Advisory", "Allocation", "Fund", "Planning"))} || ' session' END AS title,
  mail AS organizer,
  mail || CASE WHEN k % 19 = 0 THEN '' WHEN k % 61 = 0 THEN '|' || lower(replace(client, ' ', '')) || '[at]' || lower(seg) || '[dot]com' ELSE '|' || lower(replace(client, ' ', '.')) || '@' || lower(seg) || '.com' END
    || CASE WHEN k % 59 = 0 THEN '|external-guests' ELSE '' END || CASE WHEN k % 73 = 0 THEN '|' || upper(mail) ELSE '' END AS attendees,
  {{start}} AS start_time, {{end}} AS end_time,
  CASE WHEN k % 27 = 0 THEN NULL WHEN k % 3 = 0 THEN 'Zoom' WHEN k % 4 = 0 THEN 'The Palm Court' WHEN k % 7 = 0 THEN 'Lake House' ELSE 'Harbour Office ' || nation || ', floor 2' END AS location,
  CASE WHEN k % 33 = 0 THEN NULL ELSE 'Agenda: ' || lower(seg) || ' exposure' END AS description,
  {{recurring}} AS is_recurring, CASE WHEN k % 14 = 0 THEN 'tentative' ELSE 'confirmed' END AS status, {{created}} AS created_at
FROM ({_BASE}) b CROSS JOIN (VALUES (0), (1), (2)) v(n) WHERE {{where}}
"""


def _time(day: str, hour: str, minute: str, plain: bool = False) -> str:
    text = f"CAST({day} AS STRING) || 'T' || {_two.format(hour)} || ':' || {minute}"
    return f"{text} || ':00'" if plain else f"{text} || CASE WHEN k % 47 = 0 THEN '' WHEN k % 31 = 0 THEN ':00Z' WHEN k % 79 = 0 THEN ':00-05:00' ELSE ':00' END"


_shift = "hour + CASE WHEN k % 7 = 0 THEN 1 WHEN k % 17 = 0 THEN 2 ELSE 0 END"
_date = "(CASE WHEN k % 13 = 0 THEN CAST(day + INTERVAL '1' DAY AS DATE) ELSE day END)"
_later = "CAST(day + INTERVAL '40' DAY AS DATE)"
_each = lambda *values: "CASE n " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"

# An order's entry, for some a second one near it, for some a later one; from one join, so that it is read and parsed once.
CALENDAR_SQL = _ENTRY.format(
    start=_each(_time(_date, _shift, "minute"), _time(_date, _shift, "'45'", True), _time(_later, "hour", "minute", True)),
    end=_each(_time(_date, f"{_shift} + 1", "minute", True), _time(_date, f"{_shift} + 1", "'45'", True), _time(_later, "hour + 1", "minute", True)),
    recurring=_each("k % 71 = 0", "false", "k % 71 = 0"),
    created=_each("CAST(day AS STRING) || 'T07:00:00Z'", "CAST(day AS STRING) || CASE WHEN k % 2 = 0 THEN 'T05:00:00Z' ELSE 'T08:00:00Z' END", "CAST(day AS STRING) || 'T07:00:00Z'"),
    where=_each("k % 11 <> 0", "k % 67 = 0 AND k % 11 <> 0", "k % 71 = 0 OR k % 89 = 0"), orders="{orders}", customer="{customer}", nation="{nation}",
)


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables; orders, on whose rows all the work is done, are dealt by key, as a small file may be one split."""
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation")}
    return read | {"orders": read["orders"].repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")}


def crm_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_raw(spark.sql(CRM_SQL, **_tables(spark, sf_dir)), CRM_SCHEMA)


def calendar_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(CALENDAR_SQL, **_tables(spark, sf_dir))
    return with_raw(rows.withColumn("attendees", F.split("attendees", r"\|")), CALENDAR_SCHEMA)
