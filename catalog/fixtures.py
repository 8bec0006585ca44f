"""Hospital tables derived from the test tables.

One portable SQL text serves Spark and DuckDB. Every event is used: nothing is
filtered by id or sampled. Control values (rates, wards) are invented; they are
the small hand-written files of a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pflegetakt import Inputs

# Each event is one classification; the event type chooses its code. The hour
# chooses between the two layouts of the day, so that some patient-days carry
# both. `tag` is the day the text stands for, for checks only.
_CLS = """
fx_cls as (
  select event_id as ord,
         case event_type when 'click' then 'A1_S1' when 'view' then 'A2_S2'
              when 'purchase' then 'A3_S3' when 'error' then 'A5_ISO'
              else case when value > 100 then 'A6_S6' else 'X_OTHER' end end as category,
         case event_type when 'click' then 'A1_S1' when 'view' then 'A2_S2'
              when 'purchase' then case when value > 100 then 'A4_S4' else 'A3_S3' end
              when 'error' then 'A5_ISO'
              else case when value > 100 then cast(null as string) else 'X_OTHER' end end as code,
         cast(user_id as string) as pid,
         cast(ts as date) as tag,
         lpad(cast(day(ts) as string), 2, '0') || '.' || lpad(cast(month(ts) as string), 2, '0') || '.' ||
           case when hour(ts) < 4 then substring(cast(year(ts) as string), 3, 2)
                else cast(year(ts) as string) end as datum
  from events)"""

# A case is one patient's week. Its first and last event types choose the rarer
# shapes: admitted before the period, reversed, still open, ending next month.
_BASE = """
fx_base as (
  select user_id, cast(floor((day(ts) - 1) / 7) as int) as wk, min(ts) as t0, max(ts) as t1,
         min_by(event_type, event_id) as first_type, max_by(event_type, event_id) as last_type
  from events group by user_id, cast(floor((day(ts) - 1) / 7) as int))"""

# Ward of a patient by number: `moved` 0 is the ward of the stay itself, 1 the ward
# of a transfer.
_WARDKEY = """
fx_wardkey as (
  select * from (values (0,0,'CH1'),(1,0,'CH3'),(2,0,'IM1'),(3,0,'IM2'),(4,0,'GB2'),(5,0,'IN1'),
    (6,0,'ZZ9'),(7,0,cast(null as string)),(0,1,'CH3'),(1,1,'IM1'),(2,1,'IM2'),(3,1,'GB2'),
    (4,1,'IN1'),(5,1,'ZZ9'),(6,1,cast(null as string)),(7,1,'CH1')) as t(k, moved, w))"""

# A transfer overlaps the last day of the first stay.
_STAYS = """
fx_stays as (
  select cast(user_id as string) as pid,
         'F' || cast(user_id as string) || '-' || cast(wk as string) as case_id,
         w as ward,
         case when moved = 1 then t1
              when wk = 0 and first_type = 'error' then t0 - interval 10 days
              when wk = 1 and first_type = 'view' and last_type = 'view' then t1
              else t0 end as begin_ts,
         case when moved = 1 then t1 + interval 1 day
              when wk = 4 and last_type = 'signup' then null
              when wk = 4 and last_type = 'click' then t1 + interval 4 days
              when wk = 1 and first_type = 'view' and last_type = 'view' then t0
              else t1 end as end_ts,
         user_id * 100 + wk * 10 + moved as ord
  from fx_base join fx_wardkey on k = user_id % 8
  where moved = 0 or last_type = 'purchase')"""

_NEWBORNS = """
fx_newborns as (
  select 'F' || cast(user_id as string) || '-' || cast(wk as string) as case_id,
         t0 as birth, t1 as discharge
  from fx_base where first_type = 'signup' and last_type = 'signup')"""

_RATES = """
fx_rates as (
  select * from (values ('A1_S1',60.0e0),('A2_S2',95.0e0),('A3_S3',150.0e0),('Pflegegrundwert',33.0e0),
    ('erhöhter Pflegegrundwert',123.0e0),('Aufnahme',75.0e0),('Entlassung',0.5e0),('Ausfallzeiten',0.2e0),
    ('Anteil_Hilf',0.8e0)) as t(kategorie, wert))"""

_WARDS = """
fx_wards as (
  select * from (values ('CH1','Chirurgie',20.0e0,0.10e0,0.05e0,0.05e0,50.0e0),
    ('CH3','Chirurgie',18.0e0,0.10e0,0.05e0,0.05e0,50.0e0),
    ('IM1','Innere',25.0e0,0.12e0,0.05e0,0.03e0,10.0e0),('IM2','Innere',25.0e0,0.12e0,0.05e0,0.03e0,10.0e0),
    ('GB2','Geburtshilfe',15.0e0,0.10e0,0.04e0,0.02e0,20.0e0),('IN1','Intensiv',8.0e0,0.15e0,0.05e0,0.05e0,15.0e0))
    as t(ward, kategorie, betten, ausfall1, ausfall2, ausfall3, nachtdienst_quote))"""

_NIGHT = """
fx_night as (
  select n as patienten, 480.0e0 + 20.0e0 * n as min_ex_net, 240.0e0 + 10.0e0 * n as min_hilf_net,
         600.0e0 + 25.0e0 * n as min_ex_geb_net
  from (select distinct cast(p_size as bigint) as n from part) x)"""

ALL = ",".join([_CLS, _BASE, _WARDKEY, _STAYS, _NEWBORNS, _RATES, _WARDS, _NIGHT])

_NEEDS = {
    "fx_cls": [_CLS],
    "fx_stays": [_BASE, _WARDKEY, _STAYS],
    "fx_newborns": [_BASE, _NEWBORNS],
    "fx_rates": [_RATES],
    "fx_wards": [_WARDS],
    "fx_night": [_NIGHT],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(spark: SparkSession, name: str, sources: dict[str, DataFrame]) -> DataFrame:
    text = f"with {','.join(_NEEDS[name])} select * from {name}"
    used = {}
    for source, df in sources.items():
        if f"from {source}" in text:
            text = text.replace(f"from {source}", f"from {{{source}}}")
            used[source] = df
    return spark.sql(text, **used)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One hospital table as a lazy query over the test tables."""
    source = "part" if name == "fx_night" else "events"
    return _query(spark, name, {source: table(spark, sf_dir, source)})


def two_years(events: DataFrame) -> DataFrame:
    """Events with those of every second user a year later."""
    later = F.col("ts") + F.expr("interval 1 year")
    return events.withColumn("ts", F.when(F.col("user_id") % 2 == 1, later).otherwise(F.col("ts")))


def load_inputs(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> Inputs:
    """All tables of a run, from other events if given."""
    sources = {name: table(spark, sf_dir, name) for name in ("events", "part")}
    if events is not None:
        sources["events"] = events
    return Inputs(
        stays=_query(spark, "fx_stays", sources),
        classifications=_query(spark, "fx_cls", sources).drop("tag"),
        controls=_query(spark, "fx_rates", sources),
        wards=_query(spark, "fx_wards", sources),
        newborns=_query(spark, "fx_newborns", sources),
        night=_query(spark, "fx_night", sources),
    )
