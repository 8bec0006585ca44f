"""The same results in SQL, for DuckDB.

Written on their own, in window style and without the library's shortcuts: two
separate de-duplications, two joins, ordinary joins instead of shared shuffles.
"""

from __future__ import annotations

from catalog.fixtures import ALL

# Patient-days.
_DAYS = """
valid as (
  select pid, case_id, ward, ord, cast(begin_ts as date) as begin_day, cast(end_ts as date) as end_day
  from fx_stays
  where ward is not null and begin_ts >= timestamp '2024-01-01 00:00:00'
    and end_ts is not null and cast(end_ts as date) >= cast(begin_ts as date)),
expanded as (
  select pid, case_id, ward, ord,
         cast(unnest(generate_series(begin_day, end_day, interval 1 day)) as date) as tag
  from valid),
master as (
  select * exclude (rn) from (
    select *, row_number() over (partition by pid, tag order by ord desc) as rn from expanded)
  where rn = 1),
matched as (select * from fx_cls where regexp_matches(category, '^A[0-9]')),
own as (
  select pid, datum, tag, code, ord as cls_ord from (
    select *, row_number() over (partition by pid, datum order by ord desc) as rn
    from matched where code <> 'A5_ISO') where rn = 1),
marks as (
  select pid, datum, tag, ord as iso_ord from (
    select *, row_number() over (partition by pid, datum order by ord desc) as rn
    from matched where code = 'A5_ISO') where rn = 1),
joined as (
  select m.pid, m.case_id, m.ward, m.ord, m.tag, o.code as code_own, o.cls_ord,
         cast(case when k.iso_ord is null then 0 else 1 end as integer) as iso,
         k.iso_ord
  from master m
  left join own o on m.pid is not distinct from o.pid and m.tag = o.tag
  left join marks k on m.pid is not distinct from k.pid and m.tag = k.tag),
filled as (
  select * exclude (iso_ord), coalesce(
           first_value(code_own ignore nulls) over (
             partition by case_id order by tag, ord, cls_ord, iso_ord
             rows between current row and unbounded following),
           last_value(code_own ignore nulls) over (
             partition by case_id order by tag, ord, cls_ord, iso_ord
             rows between unbounded preceding and current row)) as code,
         min(tag) over (partition by case_id) as first_day,
         max(tag) over (partition by case_id) as last_day,
         iso_ord
  from joined),
rated as (
  select f.*, r.wert as wert_rate,
         case when iso = 1 then (select wert from fx_rates where kategorie = 'erhöhter Pflegegrundwert')
              else (select wert from fx_rates where kategorie = 'Pflegegrundwert') end as pflegegrundwert,
         cast(case when code_own is null then 1 else 0 end as integer) as imputed,
         cast(case when r.wert is null then 1 else 0 end as integer) as imputed_after_fill
  from filled f left join fx_rates r on f.code is not distinct from r.kategorie),
imputed as (
  select *, coalesce(wert_rate, avg(wert_rate) over (partition by ward)) as wert from rated)"""

# Minutes per patient-day.
_LOAD = """
flagged as (
  select *, case when tag = first_day then (select wert from fx_rates where kategorie = 'Aufnahme')
                 else 0 end as aufnahmewert,
         cast(case when tag <> last_day then 1 else 0 end as integer) as nachts_da,
         (select wert from fx_rates where kategorie = 'Entlassung') as discharge_share
  from imputed),
totals as (select *, wert + pflegegrundwert + aufnahmewert as tageswert from flagged),
discharged as (
  select *, case when tag = last_day
                 then lag(tageswert) over (partition by case_id order by tag, ord, cls_ord, iso_ord)
                      * discharge_share
                 else 0 end as entlasswert
  from totals),
weighted as (
  select *, case when entlasswert > 0 then entlasswert when entlasswert <= 0 then tageswert end as gesamtwert
  from discharged),
discharged_older as (
  select *, case when tag = last_day
                 then lag(wert) over (partition by case_id order by tag, ord, cls_ord, iso_ord)
                      * discharge_share
                 else 0 end as entlasswert
  from flagged),
weighted_older as (
  select *, pflegegrundwert + aufnahmewert
            + case when entlasswert > 0 then entlasswert when entlasswert <= 0 then wert end as gesamtwert
  from discharged_older),
nb_expanded as (
  select distinct case_id, begin_day as auftag, end_day as enttag,
         cast(unnest(generate_series(begin_day, end_day, interval 1 day)) as date) as tag
  from (select case_id, cast(birth as date) as begin_day, cast(discharge as date) as end_day
        from fx_newborns where discharge is not null) where begin_day <= end_day),
nb_days as (
  select *, 'GB2' as ward, 110.0 as gesamtwert, 0 as imputed, 'Ges_Neugeb' as code,
         cast(case when tag = max(tag) over (partition by case_id) then 0 else 1 end as integer) as nachts_da
  from nb_expanded),
all_days as (
  select cast(null as varchar) as pid, case_id, ward, tag, code, gesamtwert, nachts_da, imputed from nb_days
  union all
  select pid, case_id, ward, tag, code, gesamtwert, nachts_da, imputed from weighted w
  where not exists (select 1 from nb_days n where n.case_id is not distinct from w.case_id))"""

# Ward-days and reports.
_WARD = """
master_wards as (
  select case when ward in ('CH1','CH3') then 'CH13' when ward in ('IM1','IM2') then 'IM12' else ward end as station2,
         kategorie, ausfall1, ausfall2, ausfall3, nachtdienst_quote,
         case when count(betten) = count(*) then sum(betten) end as betten
  from fx_wards group by all),
ward_totals as (
  select case when ward in ('CH1','CH3') then 'CH13' when ward in ('IM1','IM2') then 'IM12' else ward end as station2,
         tag, coalesce(sum(gesamtwert), 0) as ppr_tag, coalesce(sum(nachts_da), 0) as census,
         sum(imputed) as fehlend, count(*) as tage
  from all_days group by all),
ward_totals_older as (
  select case when ward in ('CH1','CH3') then 'CH13' when ward in ('IM1','IM2') then 'IM12' else ward end as station2,
         tag, coalesce(sum(gesamtwert), 0) as ppr_tag, coalesce(sum(nachts_da), 0) as census,
         sum(imputed_after_fill) as fehlend, count(*) as tage
  from weighted_older group by all),
ward_days as (
  select *, minuten_nacht / vk_minuten as vk_nacht from (
    select t.*, m.nachtdienst_quote, m.vk_minuten, ppr_tag / m.vk_minuten as vk_tag,
           case when census / m.nachtdienst_quote < 1 then 480.0
                when census / m.nachtdienst_quote >= 1 then census / m.nachtdienst_quote * 480.0 end as minuten_nacht
    from ward_totals t
    left join (select station2, nachtdienst_quote, 38.5 / 7 * 60 as vk_minuten from master_wards) m
      on t.station2 = m.station2)),
day_shifts as (
  select station2, month(tag) as monat, 'Tag' as schicht, count(distinct tag) as schichten,
         sum(tage) as patienten, avg(tage) as belegung,
         case when count(vk_tag) = count(*) then sum(vk_tag) end / count(distinct tag) as vk
  from ward_days group by station2, month(tag)),
night_shifts as (
  select station2, month(tag) as monat, 'Nacht' as schicht, count(distinct tag) as schichten,
         sum(census) as patienten, avg(census) as belegung,
         case when count(vk_nacht) = count(*) then sum(vk_nacht) end / count(distinct tag) as vk
  from ward_days group by station2, month(tag)),
shifts as (select * from day_shifts union all select * from night_shifts),
report as (
  select s.*, m.kategorie, m.betten, m.ausfall1, m.ausfall2, m.ausfall3, s.vk / 50 as leitung
  from shifts s left join master_wards m on s.station2 = m.station2)"""


def _sql(select: str) -> str:
    return f"with {','.join([ALL, _DAYS, _LOAD, _WARD])}\n{select}"


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) as {name}"


_DAY_KEYS = "pid, case_id, ward, tag, ord, cls_ord"

# The comma text and the point text of an event value; every value gets a sign of
# trouble now and then: grouped thousands, no number, nothing.
NUMBER_TEXTS = """
number_texts as (
  select event_id,
         case event_type
           when 'error' then list_extract(['k.A.', '60d', 'NaN'], user_id % 3 + 1)
           when 'signup' then null
           when 'click' then replace(cast(cast(value as decimal(12,2)) as varchar), '.', ',')
           else '1.' || lpad(cast(cast(floor(value) as bigint) as varchar), 3, '0') || ',5' end as comma_text,
         case event_type
           when 'error' then list_extract(['k.A.', '60d', 'NaN'], user_id % 3 + 1)
           when 'signup' then null
           else cast(cast(value as decimal(12,2)) as varchar) end as point_text,
         case event_type
           when 'error' then null
           when 'signup' then null
           when 'click' then cast(cast(value as decimal(12,2)) as double)
           else 1000 + floor(value) + 0.5 end as comma_number,
         case event_type
           when 'error' then null
           when 'signup' then null
           else cast(cast(value as decimal(12,2)) as double) end as point_number
  from events)"""

ORACLE: dict[str, str] = {
    # Rows and columns.
    "scan_delimited": _sql("""
        select 'Süd ' || event_type as station, event_id as zeile,
               cast(cast(value as decimal(12,2)) as double) as wert, cast(user_id as varchar) as fallnummer,
               case when event_type <> 'error' then 'say "' || event_type || '"; \\' end as text
        from events"""),
    "scan_multiline": _sql("""
        select event_id as zeile,
               case when event_type <> 'error'
                    then 'say "' || event_type || '";' || chr(10) || chr(10) || user_id || chr(10) || 'end'
                    else 'Süd ' || event_type end as text
        from events"""),
    "parse_decimal_comma": f"with {NUMBER_TEXTS} select event_id, comma_number as number from number_texts",
    "cast_numeric": f"with {NUMBER_TEXTS} select event_id, point_number as number from number_texts",
    "cast_all_numeric": f"""with {NUMBER_TEXTS}
        select cast(event_id as double) as event_id, point_number as point_text from number_texts""",
    "select_rename": _sql("select pid, code as kuerzel, datum as datum_tag from fx_cls"),
    "filter_regex_prefix": _sql("""
        select ord, category, code, 'category' as tested from fx_cls where regexp_matches(category, '^A[0-9]')
        union all
        select ord, category, code, 'code' as tested from fx_cls where regexp_matches(code, '^A[0-9]')"""),
    "keep_last": _sql("""
        select pid, datum, ord, code from (
          select *, row_number() over (partition by pid, datum order by ord desc) as rn from fx_cls)
        where rn = 1"""),
    "split_isolation": _sql("""
        select 'category' as part, pid, datum, tag, code, cls_ord as ord from own
        union all
        select 'isolation' as part, pid, datum, tag, 'A5_ISO' as code, iso_ord as ord from marks"""),
    "split_isolation_by_day": _sql("""
        select pid, tag, code, ord from (
          select *, row_number() over (partition by pid, tag, code = 'A5_ISO' order by ord desc) as rn
          from matched where code is not null) where rn = 1"""),
    "preview_topn": """
        select event_id, user_id, event_type, value from events order by event_id limit 6""",
    "parse_datetime_multi": """
        select event_id, cast(ts as date) as long_year, cast(ts as date) as short_year,
               cast(ts as date) as long_moment, cast(ts as date) as short_moment,
               case when event_type = 'error' then null
                    else cast(ts as date) - interval 55 year end::date as last_century,
               cast(null as date) as unparsed
        from events""",
    "parse_time_of_day": """
        select event_id, strftime(ts, '%H:%M:%S') as full_clock, strftime(ts, '%H:%M:00') as short_clock,
               cast(null as varchar) as unparsed
        from events""",
    # Missing-value rules.
    "null_propagating_if": """
        select event_id, case when x > 50 then 'high' when x <= 50 then 'low' end as level
        from (select event_id, case when event_type = 'error' then null else value end as x from events)""",
    "ratio_safe": """
        select event_id, case when d = 0 then null else value / d end as quotient
        from (select event_id, value, case event_type when 'error' then 0 when 'view' then null
                     else 1 + user_id end as d from events)""",
    "strict_sum": f"""
        select user_id, day, {_r("case when count(x) = count(*) then sum(x) end", "strict_total")},
               {_r("case when count(x) = count(*) then avg(x) end", "strict_mean")},
               {_r("coalesce(sum(x), 0)", "known_total")}, cast(count(*) as bigint) as n
        from (select user_id, cast(ts as date) as day,
                     case when event_type = 'error' then null else value end as x from events)
        group by user_id, day""",
    "control_scalars": _sql(f"""
        select category, count(*) as n, {_r("count(*) * (select wert from fx_rates where kategorie = 'Pflegegrundwert')", "base_minutes")},
               (select wert from fx_rates where kategorie = 'erhöhter Pflegegrundwert') as raised_base,
               (select wert from fx_rates where kategorie = 'Aufnahme') as admission,
               (select wert from fx_rates where kategorie = 'Entlassung') as discharge,
               (select wert from fx_rates where kategorie = 'Ausfallzeiten') as absence
        from fx_cls group by category"""),
    # Patient-days.
    "filter_valid_stays": _sql("select pid, case_id, ward, ord, begin_day, end_day from valid"),
    "long_stays": _sql("""
        select pid, case_id, ward, ord, begin_day, end_day, datediff('day', begin_day, end_day) + 1 as days
        from valid where datediff('day', begin_day, end_day) >= 5"""),
    "expand_patient_days": _sql("select pid, case_id, ward, ord, tag from expanded"),
    "dedupe_patient_days": _sql("select pid, case_id, ward, ord, tag from master"),
    "join_classifications": _sql(f"select {_DAY_KEYS}, code_own as code, iso from joined"),
    "impute_category": _sql(f"select {_DAY_KEYS}, code_own, code, imputed from rated"),
    "impute_flag_after_fill": _sql(f"select {_DAY_KEYS}, code, imputed_after_fill as imputed from rated"),
    "rate_lookup": _sql(f"select {_DAY_KEYS}, code, wert_rate as wert from rated"),
    "base_value": _sql(f"select {_DAY_KEYS}, iso, pflegegrundwert from rated"),
    "impute_ward_mean": _sql(f"select {_DAY_KEYS}, code, imputed, {_r('wert', 'wert')} from imputed"),
    "stay_checks": _sql("""
        select count(*) filter (end_day >= begin_day) as counted,
               count(*) filter (begin_day is not null and end_day is null) as open,
               count(*) filter (end_day < begin_day) as reversed,
               count(*) filter (begin_day is null) as without_begin
        from (select cast(case when ord % 11 <> 0 then begin_ts end as date) as begin_day,
                     cast(end_ts as date) as end_day from fx_stays
              where ward is not null and (ord % 11 = 0 or begin_ts >= timestamp '2024-01-01 00:00:00'))"""),
    "newborn_checks": _sql("""
        select count(*) filter (b <= d) as counted, count(*) filter (b is null) as without_birth,
               count(*) filter (b is not null and d is null) as without_discharge, count(*) filter (b > d) as reversed
        from (select cast(case digit when '1' then null when '3' then discharge + interval 3 day else birth end as date) as b,
                     cast(case when digit <> '2' then discharge end as date) as d
              from (select *, right(split_part(case_id, '-', 1), 1) as digit from fx_newborns))"""),
    # Workload.
    "admission_discharge": _sql(f"""
        select {_DAY_KEYS}, aufnahmewert, {_r('entlasswert', 'entlasswert')}, {_r('gesamtwert', 'gesamtwert')}
        from weighted"""),
    "admission_discharge_v1": _sql(f"""
        select {_DAY_KEYS}, aufnahmewert, {_r('entlasswert', 'entlasswert')}, {_r('gesamtwert', 'gesamtwert')}
        from weighted_older"""),
    "midnight_census": _sql("""
        select tag, cast(sum(nachts_da) as bigint) as census, count(*) as patient_days
        from weighted group by tag"""),
    "newborn_days": _sql("""
        select case_id, auftag, enttag, tag, ward, cast(gesamtwert as double) as gesamtwert, imputed, nachts_da, code
        from nb_days"""),
    "anti_join_newborns": _sql(f"""
        select {_DAY_KEYS}, {_r('wert', 'wert')} from imputed i
        where not exists (select 1 from fx_newborns n where n.case_id is not distinct from i.case_id)"""),
    "union_newborns": _sql(f"""
        select pid, case_id, ward, tag, code, {_r('gesamtwert', 'gesamtwert')}, nachts_da, imputed from all_days"""),
    # Wards.
    "ward_merge": _sql("""
        select case when ward in ('CH1','CH3') then 'CH13' when ward in ('IM1','IM2') then 'IM12' else ward end as station2,
               count(*) as stays, count(distinct ward) as wards
        from fx_stays group by all"""),
    "ward_master": _sql(f"""
        select s.station2, s.stays, m.kategorie, m.betten, m.nachtdienst_quote,
               {_r('m.ausfall1 + m.ausfall2 + m.ausfall3', 'ausfallzeit')},
               {_r("case when m.station2 is not null then 38.5 * (365.0 / 12 / 7) * 60 end", 'arbeitszeit_monat')},
               {_r("case when m.station2 is not null then 38.5 / 7 * 60 end", 'arbeitszeit_tag_vk')}
        from (select case when ward in ('CH1','CH3') then 'CH13' when ward in ('IM1','IM2') then 'IM12' else ward end as station2,
                     count(*) as stays from valid group by all) s
        left join master_wards m on s.station2 is not distinct from m.station2"""),
    "ward_day": _sql(f"""
        select station2 as Station2, tag as Tag, {_r('ppr_tag', 'ppr_tag')},
               cast(census as bigint) as Patienten_mitternacht, cast(fehlend as bigint) as Fehlende_Tageswerte,
               tage as Patiententage, {_r('vk_tag', 'VK_tag')}
        from ward_days"""),
    "night_quota": _sql(f"""
        select station2 as Station2, tag as Tag, nachtdienst_quote, cast(census as bigint) as Patienten_mitternacht,
               {_r('minuten_nacht', 'Minuten_nacht')}, {_r('vk_nacht', 'VK_nacht')}
        from ward_days"""),
    "night_lookup": _sql(f"""
        select t.station2 as Station2, t.tag as Tag, cast(t.census as bigint) as Patienten_mitternacht,
               {_r("case when t.station2 = 'GB2' then n.min_ex_geb_net when t.station2 <> 'GB2' then n.min_ex_net end", 'Minuten_nacht')},
               {_r("case when m.station2 is not null then case when t.station2 = 'GB2' then n.min_ex_geb_net when t.station2 <> 'GB2' then n.min_ex_net end / (38.5 / 7 * 60) end", 'VK_nacht')}
        from ward_totals t left join fx_night n on t.census = n.patienten
        left join master_wards m on t.station2 = m.station2"""),
    # Reports.
    "shift_union": _sql(f"""
        select station2 as Station2, cast(monat as integer) as Monat, schicht as Schicht, schichten as Anzahl_Schichten,
               cast(patienten as bigint) as Anzahl_Patienten,
               {_r('belegung', 'durchschnittliche_Patientenbelegung')}, {_r('vk', 'VK')}
        from shifts"""),
    "monthly_report": _sql(f"""
        select 'Marienstift' as Standortkennzeichen, station2 as Station2, 'noch_fuellen' as FAB_Key,
               'noch_fuellen' as FAB_Name, kategorie as Kategorie, cast(monat as integer) as Monat,
               schicht as Schicht, schichten as Anzahl_Schichten, betten as Anzahl_Betten,
               cast(patienten as bigint) as Anzahl_Patienten,
               {_r('belegung', 'durchschnittliche_Patientenbelegung')},
               case when station2 = 'GB2' then 'ja' else 'nein' end as Station_GynGeb,
               {_r('vk', 'Soll_Besetzung')}, ausfall1 as Ausfall1, ausfall2 as Ausfall2, ausfall3 as Ausfall3,
               {_r('leitung', 'Leitende_Pflege')}
        from report"""),
    "monthly_report_by_year": _sql(f"""
        select station2 as Station2, cast(jahr as integer) as Jahr, cast(monat as integer) as Monat, schicht as Schicht,
               count(distinct tag) as Anzahl_Schichten,
               {_r("case when count(vk) = count(*) then sum(vk) end / count(distinct tag)", 'Soll_Besetzung')}
        from (select station2, year(tag) as jahr, month(tag) as monat, tag, 'Tag' as schicht, vk_tag as vk from ward_days
              union all
              select station2, year(tag), month(tag), tag, 'Nacht', vk_nacht from ward_days)
        group by station2, jahr, monat, schicht"""),
    "ward_month_total": _sql(f"""
        select station2 as Station2, cast(monat as integer) as Monat,
               {_r("case when count(vk) = count(*) then sum(vk) + sum(leitung) end", 'VK_ges')},
               {_r('avg(belegung)', 'mittlere_Belegung')}
        from report group by station2, monat"""),
    "missing_report": _sql(f"""
        select station2 as Station2, cast(month(tag) as integer) as Monat, cast(sum(tage) as bigint) as Tage,
               cast(sum(fehlend) as bigint) as Fehlend, {_r('sum(fehlend) / sum(tage)', 'Anteil_fehlend')}
        from ward_totals group by station2, month(tag)"""),
    "vk_by_qualification": _sql(f"""
        select station2 as Station2, cast(year(tag) as integer) as Jahr, cast(month(tag) as integer) as Monat,
               {_r('coalesce(sum(exam), 0)', 'Examiniert')}, {_r('coalesce(sum(hilf), 0)', 'Hilf')},
               cast(sum(fehlend) as bigint) as Fehlende_Tageswerte, cast(sum(tage) as bigint) as Patiententage,
               {_r('coalesce(sum(exam), 0) / (38.5 * (365.0 / 12 / 7) * 60 * 0.8)', 'VK_Exam')},
               {_r('coalesce(sum(hilf), 0) / (38.5 * (365.0 / 12 / 7) * 60 * 0.8)', 'VK_Hilf')},
               {_r('sum(fehlend) / sum(tage)', 'Anteil_fehlende_Werte')}
        from (select t.*, t.ppr_tag * 0.8 + case when t.station2 = 'GB2' then n.min_ex_geb_net
                                                 when t.station2 <> 'GB2' then n.min_ex_net end as exam,
                     t.ppr_tag * (1 - 0.8) + n.min_hilf_net as hilf
              from ward_totals_older t left join fx_night n on t.census = n.patienten)
        group by station2, year(tag), month(tag)"""),
}

# The exported report is read back unchanged.
ORACLE["export_reports"] = ORACLE["monthly_report"]

# Inputs of other shapes: the same SQL over changed tables.
_TWO_YEARS = """with events as (
  select * replace (case when user_id % 2 = 1 then ts + interval 1 year else ts end as ts) from events),"""


def _changed(name: str, old: str, new: str) -> str:
    """The SQL of a query with one part of its tables replaced."""
    sql = ORACLE[name]
    if old not in sql:
        raise ValueError(f"{name} has no {old}")
    return sql.replace(old, new, 1)


ORACLE["monthly_report_two_years"] = _changed("monthly_report", "with ", _TWO_YEARS)
ORACLE["monthly_report_by_year_two_years"] = _changed("monthly_report_by_year", "with ", _TWO_YEARS)
ORACLE["monthly_report_split_wards"] = _changed(
    "monthly_report", "('CH3','Chirurgie',18.0e0,0.10e0", "('CH3','Chirurgie',18.0e0,0.20e0"
)
ORACLE["night_lookup_fractions"] = _changed(
    "night_lookup", "select n as patienten", "select n + case when n % 2 = 0 then 0.0e0 else 0.5e0 end as patienten"
)
ORACLE["read_stays_order"] = _sql("""
        select pid, case_id, ward, cast(begin_ts as date) as begin_ts, cast(end_ts as date) as end_ts from (
          select *, row_number() over (partition by pid order by ord desc) as rn from fx_stays) where rn = 1""")
ORACLE["export_controls"] = _sql("""
        select kategorie, wert from fx_rates
        union all select cast(patienten as varchar), min_ex_net from fx_night""")
