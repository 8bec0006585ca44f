"""Every operator as a query over the test tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import fixture, load_inputs, table, two_years
from pflegetakt import Settings, Staffing
from pflegetakt.functions.dates import parse_clock, parse_day, parse_moment_day
from pflegetakt.functions.missing import if_known, ratio, strict_mean, strict_sum, sum_or_zero
from pflegetakt.functions.numbers import all_to_number, parse_decimal_comma, to_number
from pflegetakt.operators import rows
from pflegetakt.operators.lookups import control_scalars, merged_ward
from pflegetakt.plans import patient_days, ward_days, workload
from pflegetakt.plans.patient_days import with_ids
from pflegetakt.sources.delimited import read_stays
from pflegetakt.sources.delimited import scan_delimited as scan_file
from pflegetakt.sources.export import export_reports as write_reports
from pflegetakt.sources.export import read_report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY_KEYS = ["pid", "case_id", "ward", "tag", "ord", "cls_ord"]


def register(query: Query) -> Query:
    QUERIES[query.__name__.rstrip("_")] = query
    return query


def staffing(spark: SparkSession, sf_dir: str) -> Staffing:
    return Staffing(load_inputs(spark, sf_dir), Settings())


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles depend on their order; six places do not."""
    return df.withColumns({name: F.round(name, 6) for name in names})


def scratch(spark: SparkSession, name: str) -> str:
    """Folder that all executors see. Where the session names none, only a local one goes on."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="run-")
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{name}"


# Rows and columns


@register
def scan_delimited(spark, sf_dir):
    """A Latin-1 file with umlauts, comma decimals, doubled quotes, separators and backslashes
    inside quotes and quoted empty texts, written from all events."""
    folder = scratch(spark, "scan_delimited")
    written = table(spark, sf_dir, "events").select(
        F.concat(F.lit("Süd "), "event_type").alias("Station"),
        F.col("event_id").alias("Zeile"),
        F.translate(F.col("value").cast("decimal(12,2)").cast("string"), ".", ",").alias("Wert"),
        F.col("user_id").alias("Fallnummer"),
        F.when(F.col("event_type") == "error", "")
        .otherwise(F.concat(F.lit('say "'), "event_type", F.lit('"; \\')))
        .alias("Text"),
    )
    written.write.mode("overwrite").csv(
        folder, sep=";", header=True, encoding="ISO-8859-1", escape='"'
    )
    return scan_file(spark, folder, "ISO-8859-1").select(
        F.col("Station").alias("station"),
        F.col("Zeile").cast("bigint").alias("zeile"),
        parse_decimal_comma(F.col("Wert")).alias("wert"),
        F.col("Fallnummer").alias("fallnummer"),
        F.col("Text").alias("text"),
    )


@register
def scan_multiline(spark, sf_dir):
    """A file of all events with line breaks, separators and doubled quotes inside quotes, split by Spark."""
    folder = scratch(spark, "scan_multiline")
    kind = F.col("event_type")
    text = F.concat(F.lit('say "'), kind, F.lit('";\n\n'), F.col("user_id").cast("string"), F.lit("\nend"))
    written = table(spark, sf_dir, "events").select(
        F.when(kind != "error", text).otherwise(F.concat(F.lit("Süd "), kind)).alias("Text"),
        F.col("event_id").alias("Zeile"),
    )
    written.write.mode("overwrite").csv(
        folder, sep=";", header=True, encoding="ISO-8859-1", escape='"'
    )
    return scan_file(spark, folder, "ISO-8859-1", multiline=True).select(
        F.col("Zeile").cast("bigint").alias("zeile"), F.col("Text").alias("text")
    )


def _number_texts(spark, sf_dir):
    """Texts with comma or point decimals, grouped thousands, no number, nothing."""
    kind = F.col("event_type")
    none = F.element_at(F.array(F.lit("k.A."), F.lit("60d"), F.lit("NaN")), (F.col("user_id") % 3 + 1).cast("int"))
    plain = F.col("value").cast("decimal(12,2)").cast("string")
    thousands = F.concat(
        F.lit("1."), F.lpad(F.floor("value").cast("string"), 3, "0"), F.lit(",5")
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "error", none)
        .when(kind == "click", F.translate(plain, ".", ","))
        .when(kind != "signup", thousands)
        .alias("comma_text"),
        F.when(kind == "error", none).when(kind != "signup", plain).alias("point_text"),
    )


@register
def parse_decimal_comma_(spark, sf_dir):
    texts = _number_texts(spark, sf_dir)
    return texts.select("event_id", parse_decimal_comma(F.col("comma_text")).alias("number"))


@register
def cast_numeric(spark, sf_dir):
    return _number_texts(spark, sf_dir).select(
        "event_id", to_number(F.col("point_text")).alias("number")
    )


@register
def cast_all_numeric(spark, sf_dir):
    """Every column as a number."""
    texts = _number_texts(spark, sf_dir).select(F.col("event_id").cast("string"), "point_text")
    return all_to_number(texts)


@register
def select_rename(spark, sf_dir):
    named = fixture(spark, sf_dir, "fx_cls").select(
        "ord", "category", "pid", F.col("code").alias("kuerzel"), F.col("datum").alias("datum_tag")
    )
    return named.drop("ord", "category")


@register
def filter_regex_prefix(spark, sf_dir):
    """By the first column and by a named one."""
    texts = fixture(spark, sf_dir, "fx_cls").select("category", "code", "ord")
    pattern = Settings().category_pattern
    first = rows.match_prefix(texts, pattern).withColumn("tested", F.lit("category"))
    named = rows.match_prefix(texts, pattern, "code").withColumn("tested", F.lit("code"))
    return first.unionByName(named)


@register
def keep_last(spark, sf_dir):
    texts = fixture(spark, sf_dir, "fx_cls").select("pid", "datum", "ord", "code")
    return rows.keep_last(texts, ["pid", "datum"], "ord")


@register
def split_isolation(spark, sf_dir):
    categories, isolation = patient_days.split_isolation(
        fixture(spark, sf_dir, "fx_cls"), Settings()
    )
    kinds = ["part", "pid", "datum", "tag", "code", "ord"]
    return (
        categories.withColumnRenamed("cls_ord", "ord")
        .withColumn("part", F.lit("category"))
        .select(*kinds)
        .unionByName(
            isolation.withColumnRenamed("iso_ord", "ord")
            .withColumns({"part": F.lit("isolation"), "code": F.lit(Settings().isolation_code)})
            .select(*kinds)
        )
    )


@register
def split_isolation_by_day(spark, sf_dir):
    """De-duplicated by the parsed day instead of its text."""
    categories, isolation = patient_days.split_isolation(
        fixture(spark, sf_dir, "fx_cls"), Settings(dedupe_by_text=False)
    )
    categories = categories.select("pid", "tag", "code", F.col("cls_ord").alias("ord"))
    marks = isolation.select(
        "pid", "tag", F.lit(Settings().isolation_code).alias("code"), F.col("iso_ord").alias("ord")
    )
    return categories.unionByName(marks)


@register
def preview_topn(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return rows.preview(events, ["event_id"])


@register
def parse_datetime_multi(spark, sf_dir):
    def text(pattern, moment="ts"):
        return F.date_format(moment, pattern)

    past = F.when(F.col("event_type") != "error", F.col("ts") - F.expr("interval 55 years"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        parse_day(text("d.M.yyyy")).alias("long_year"),
        parse_day(text("dd.MM.yy")).alias("short_year"),
        parse_moment_day(text("dd.MM.yyyy HH:mm")).alias("long_moment"),
        parse_moment_day(text("d.M.yy H:m")).alias("short_moment"),
        parse_moment_day(text("d.M.yy H:m", past)).alias("last_century"),
        parse_day(text("yyyy-MM-dd")).alias("unparsed"),
    )


@register
def parse_time_of_day(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        parse_clock(F.date_format("ts", "H:m:s")).alias("full_clock"),
        parse_clock(F.date_format("ts", "HH:mm")).alias("short_clock"),
        parse_clock(F.date_format("ts", "HH.mm")).alias("unparsed"),
    )


# Missing-value rules


def _value_unless_error():
    return F.when(F.col("event_type") != "error", F.col("value"))


@register
def null_propagating_if(spark, sf_dir):
    level = if_known(_value_unless_error() > 50, F.lit("high"), F.lit("low"))
    return table(spark, sf_dir, "events").select("event_id", level.alias("level"))


@register
def ratio_safe(spark, sf_dir):
    kind = F.col("event_type")
    divisor = F.when(kind == "error", 0).when(kind != "view", 1 + F.col("user_id"))
    quotient = ratio(F.col("value"), divisor)
    return table(spark, sf_dir, "events").select("event_id", quotient.alias("quotient"))


@register
def strict_sum_(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(
        "user_id", F.to_date("ts").alias("day"), _value_unless_error().alias("x")
    )
    totals = days.groupBy("user_id", "day").agg(
        strict_sum(F.col("x")).alias("strict_total"),
        strict_mean(F.col("x")).alias("strict_mean"),
        sum_or_zero(F.col("x")).alias("known_total"),
        F.count(F.lit(1)).alias("n"),
    )
    return rounded(totals, "strict_total", "strict_mean", "known_total")


@register
def control_scalars_(spark, sf_dir):
    control = control_scalars(fixture(spark, sf_dir, "fx_rates"), Settings().live_keys)
    counted = fixture(spark, sf_dir, "fx_cls").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    names = ["raised_base", "admission", "discharge", "absence"]
    return rounded(
        counted.select(
            "category",
            "n",
            (F.col("n") * control["base"]).alias("base_minutes"),
            *[control[name].alias(name) for name in names],
        ),
        "base_minutes",
    )


# Patient-days


@register
def filter_valid_stays(spark, sf_dir):
    return with_ids(staffing(spark, sf_dir).valid_stays)


@register
def long_stays(spark, sf_dir):
    """Admitted stays of more than five days."""
    run = Staffing(load_inputs(spark, sf_dir), Settings(long_stay_days=5))
    return run.long_stays()


@register
def expand_patient_days(spark, sf_dir):
    spans = staffing(spark, sf_dir).valid_stays
    return with_ids(rows.expand_days(spans, "begin_day", "end_day"))


@register
def dedupe_patient_days(spark, sf_dir):
    return with_ids(staffing(spark, sf_dir).master_days)


@register
def join_classifications(spark, sf_dir):
    return with_ids(staffing(spark, sf_dir).attached).select(*DAY_KEYS, "code", "iso")


@register
def impute_category(spark, sf_dir):
    days = with_ids(staffing(spark, sf_dir).rated)
    return days.select(*DAY_KEYS, "code_own", "code", "imputed")


@register
def impute_flag_after_fill(spark, sf_dir):
    days = with_ids(staffing(spark, sf_dir).rated)
    return days.select(*DAY_KEYS, "code", F.col("imputed_after_fill").alias("imputed"))


@register
def rate_lookup(spark, sf_dir):
    return with_ids(staffing(spark, sf_dir).rated).select(*DAY_KEYS, "code", "wert")


@register
def base_value(spark, sf_dir):
    return with_ids(staffing(spark, sf_dir).rated).select(*DAY_KEYS, "iso", "pflegegrundwert")


@register
def impute_ward_mean(spark, sf_dir):
    days = with_ids(staffing(spark, sf_dir).imputed)
    return rounded(days.select(*DAY_KEYS, "code", "imputed", "wert"), "wert")


@register
def stay_checks(spark, sf_dir):
    """With a begin that is missing in every eleventh stay."""
    stays = fixture(spark, sf_dir, "fx_stays")
    begin = F.when(F.col("ord") % 11 != 0, F.col("begin_ts"))
    return patient_days.stay_checks(stays.withColumn("begin_ts", begin), Settings())


@register
def newborn_checks(spark, sf_dir):
    """With a missing birth, a missing discharge or a turned span, by the last digit of the user."""
    births = fixture(spark, sf_dir, "fx_newborns")
    digit = F.substring(F.split("case_id", "-")[0], -1, 1)
    turned = F.col("discharge") + F.expr("interval 3 days")
    return workload.newborn_checks(
        births.withColumn(
            "birth", F.when(digit == "3", turned).otherwise(F.when(digit != "1", F.col("birth")))
        ).withColumn("discharge", F.when(digit != "2", F.col("discharge")))
    )


# Workload


def _weighted(days):
    shown = with_ids(days).select(*DAY_KEYS, "aufnahmewert", "entlasswert", "gesamtwert")
    return rounded(shown, "entlasswert", "gesamtwert")


@register
def admission_discharge(spark, sf_dir):
    return _weighted(staffing(spark, sf_dir).weighted)


@register
def admission_discharge_v1(spark, sf_dir):
    return _weighted(staffing(spark, sf_dir).weighted_older)


@register
def midnight_census(spark, sf_dir):
    return (
        staffing(spark, sf_dir)
        .weighted.groupBy("tag")
        .agg(F.sum("nachts_da").alias("census"), F.count(F.lit(1)).alias("patient_days"))
    )


@register
def newborn_days(spark, sf_dir):
    run = staffing(spark, sf_dir)
    return with_ids(workload.newborn_days(run.newborn_spans, run.settings))


@register
def anti_join_newborns(spark, sf_dir):
    run = staffing(spark, sf_dir)
    kept = with_ids(workload.without_cases(run.imputed, run.newborn_spans, run.hot))
    return rounded(kept.select(*DAY_KEYS, "wert"), "wert")


@register
def union_newborns(spark, sf_dir):
    days = with_ids(staffing(spark, sf_dir).all_days)
    names = ["pid", "case_id", "ward", "tag", "code", "gesamtwert", "nachts_da", "imputed"]
    return rounded(days.select(*names), "gesamtwert")


# Wards


@register
def ward_merge(spark, sf_dir):
    merged = merged_ward(F.col("ward"), Settings().ward_merge).alias("station2")
    return (
        fixture(spark, sf_dir, "fx_stays")
        .groupBy(merged)
        .agg(F.count(F.lit(1)).alias("stays"), F.count_distinct("ward").alias("wards"))
    )


@register
def ward_master(spark, sf_dir):
    """Master data of the wards that have valid stays."""
    run = staffing(spark, sf_dir)
    merged = merged_ward(F.col("ward"), run.settings.ward_merge).alias("Station2")
    stays = run.valid_stays.groupBy(merged).agg(F.count(F.lit(1)).alias("stays"))
    names = ["kategorie", "betten", "nachtdienst_quote"]
    times = ["ausfallzeit", "arbeitszeit_monat", "arbeitszeit_tag_vk"]
    joined = ward_days.with_master(stays, run.master, [*names, *times])
    return rounded(joined.withColumnRenamed("Station2", "station2"), *times)


@register
def ward_day(spark, sf_dir):
    names = ["Station2", "Tag", "ppr_tag", "Patienten_mitternacht", "Fehlende_Tageswerte"]
    days = staffing(spark, sf_dir).ward_days.select(*names, "Patiententage", "VK_tag")
    return rounded(days, "ppr_tag", "VK_tag")


@register
def night_quota(spark, sf_dir):
    names = ["Station2", "Tag", "nachtdienst_quote", "Patienten_mitternacht"]
    days = staffing(spark, sf_dir).ward_days.select(*names, "Minuten_nacht", "VK_nacht")
    return rounded(days, "Minuten_nacht", "VK_nacht")


@register
def night_lookup(spark, sf_dir):
    names = ["Station2", "Tag", "Patienten_mitternacht", "Minuten_nacht", "VK_nacht"]
    days = staffing(spark, sf_dir).night_lookup().select(*names)
    return rounded(days, "Minuten_nacht", "VK_nacht")


# Reports


@register
def shift_union(spark, sf_dir):
    shifts = staffing(spark, sf_dir).monthly_shifts().drop("shift_rank")
    return rounded(shifts, "durchschnittliche_Patientenbelegung", "VK")


def _rounded_report(report):
    return rounded(
        report, "durchschnittliche_Patientenbelegung", "Soll_Besetzung", "Leitende_Pflege"
    )


@register
def monthly_report(spark, sf_dir):
    return _rounded_report(staffing(spark, sf_dir).monthly_report())


@register
def monthly_report_by_year(spark, sf_dir):
    """Months of different years kept apart."""
    run = Staffing(load_inputs(spark, sf_dir), Settings(by_year=True))
    names = ["Station2", "Jahr", "Monat", "Schicht", "Anzahl_Schichten", "Soll_Besetzung"]
    return rounded(run.monthly_report().select(*names), "Soll_Besetzung")


@register
def ward_month_total(spark, sf_dir):
    return rounded(staffing(spark, sf_dir).ward_month_total(), "VK_ges", "mittlere_Belegung")


@register
def missing_report(spark, sf_dir):
    return rounded(staffing(spark, sf_dir).missing_report(), "Anteil_fehlend")


@register
def vk_by_qualification(spark, sf_dir):
    return rounded(
        staffing(spark, sf_dir).vk_by_qualification(),
        "Examiniert",
        "Hilf",
        "VK_Exam",
        "VK_Hilf",
        "Anteil_fehlende_Werte",
    )


@register
def export_reports(spark, sf_dir):
    """All reports written; the monthly one read back."""
    folder = write_reports(
        spark, staffing(spark, sf_dir), scratch(spark, "export_reports"), controls=True
    )
    return _rounded_report(read_report(spark, folder, "ppr_bericht"))


# Inputs of other shapes


def _two_years(spark, sf_dir, settings=None):
    events = two_years(table(spark, sf_dir, "events"))
    return Staffing(load_inputs(spark, sf_dir, events), settings or Settings())


@register
def monthly_report_two_years(spark, sf_dir):
    """Months of two years in one row."""
    return _rounded_report(_two_years(spark, sf_dir).monthly_report())


@register
def monthly_report_by_year_two_years(spark, sf_dir):
    names = ["Station2", "Jahr", "Monat", "Schicht", "Anzahl_Schichten", "Soll_Besetzung"]
    report = _two_years(spark, sf_dir, Settings(by_year=True)).monthly_report()
    return rounded(report.select(*names), "Soll_Besetzung")


@register
def monthly_report_split_wards(spark, sf_dir):
    """Merged wards with different attributes keep several master rows, which multiply their reports."""
    inputs = load_inputs(spark, sf_dir)
    absence = F.when(F.col("ward") == "CH3", 0.2).otherwise(F.col("ausfall1"))
    inputs = replace(inputs, wards=inputs.wards.withColumn("ausfall1", absence))
    return _rounded_report(Staffing(inputs, Settings()).monthly_report())


@register
def night_lookup_fractions(spark, sf_dir):
    """Every second key of the night table lies between two counts and meets none."""
    inputs = load_inputs(spark, sf_dir)
    between = F.col("patienten") + F.when(F.col("patienten") % 2 == 0, 0.0).otherwise(0.5)
    inputs = replace(inputs, night=inputs.night.withColumn("patienten", between))
    names = ["Station2", "Tag", "Patienten_mitternacht", "Minuten_nacht", "VK_nacht"]
    days = Staffing(inputs, Settings()).night_lookup().select(*names)
    return rounded(days, "Minuten_nacht", "VK_nacht")


@register
def read_stays_order(spark, sf_dir):
    """Stays from files of nine columns, written in order over several files: each patient's last row.

    The ward is the ninth column, whatever other column has a similar header.
    """
    folder = scratch(spark, "read_stays_order")
    stays = fixture(spark, sf_dir, "fx_stays")

    def moment(name):
        return F.date_format(name, "dd.MM.yyyy HH:mm")

    written = stays.orderBy("ord").select(
        F.col("pid").alias("PID"),
        F.col("case_id").alias("Fallnummer"),
        moment("begin_ts").alias("Aufenthaltsbeginn"),
        moment("end_ts").alias("Aufenthaltsende"),
        F.lit("other").alias("Station"),
        *[F.lit("").alias(f"leer{i}") for i in range(3)],
        F.col("ward").alias("Station neu"),
    )
    written.write.mode("overwrite").csv(folder, sep=";", header=True, escape='"', encoding="ISO-8859-1")
    read = read_stays(spark, folder, "ISO-8859-1")
    days = read.withColumns({name: F.col(name).cast("date") for name in ("begin_ts", "end_ts")})
    return rows.keep_last(days, ["pid"], "ord").drop("ord")


@register
def export_controls(spark, sf_dir):
    """Control tables as a run with reports writes them, read back."""
    folder = write_reports(
        spark, staffing(spark, sf_dir), scratch(spark, "export_controls"), controls=True
    )
    rates = read_report(spark, folder, "Steuerung").select("kategorie", "wert")
    nights = read_report(spark, folder, "Nachtdienst")
    return rates.unionByName(
        nights.select(F.col("patienten").cast("string").alias("kategorie"), F.col("min_ex_net").alias("wert"))
    )
