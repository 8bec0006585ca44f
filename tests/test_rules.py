"""Small cases with exact results: missing values, row order, dates, wards."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hospital import RATES, WARD_ROWS, classified, hospital, rows, stay
from pflegetakt import Settings
from pflegetakt.functions.dates import parse_clock, parse_day, parse_moment_day
from pflegetakt.functions.missing import if_known, key_text, key_value, strict_mean, strict_sum
from pflegetakt.functions.numbers import all_to_number, parse_decimal_comma, to_number
from pflegetakt.operators.rows import keep_last
from pflegetakt.plans import patient_days, reports, ward_days, workload


def day(text):
    return dt.date.fromisoformat(text)


# Workload of single cases


def test_one_day_case_has_no_total_but_counts(spark):
    run = hospital(
        spark,
        [stay("p", "f", "IN1", "2024-02-01 08:00", "2024-02-01 12:00", 1)],
        [classified(1, "p", "01.02.2024", "A1")],
    )
    assert rows(run.weighted, "gesamtwert", "nachts_da") == [(None, 0)]
    assert rows(run.ward_days, "ppr_tag", "Patienten_mitternacht", "Patiententage") == [(0.0, 0, 1)]


def test_two_day_case(spark):
    run = hospital(
        spark,
        [stay("p", "f", "IN1", "2024-02-01 08:00", "2024-02-02 12:00", 1)],
        [classified(1, "p", "01.02.2024", "A1"), classified(2, "p", "02.02.2024", "A1")],
    )
    assert rows(run.weighted, "gesamtwert", order="tag") == [(168.0,), (84.0,)]
    # Older rule: base and admission always count, the share is of the minutes alone.
    assert rows(run.weighted_older, "gesamtwert", order="tag") == [(168.0,), (63.0,)]


def test_zero_discharge_share_falls_back_to_the_day_total(spark):
    rates = [(k, 0.0 if k == "Entlassung" else v) for k, v in RATES]
    run = hospital(
        spark,
        [stay("p", "f", "IN1", "2024-02-01", "2024-02-02", 1)],
        [classified(1, "p", "01.02.2024", "A1")],
        rates,
    )
    assert rows(run.weighted, "gesamtwert", order="tag") == [(168.0,), (93.0,)]


def test_two_layouts_of_one_day_double_the_patient_day(spark):
    stays = [stay("p", "f", "IN1", "2024-02-01", "2024-02-02", 1)]
    texts = [classified(1, "p", "01.02.24", "A1"), classified(2, "p", "01.02.2024", "A2")]
    run = hospital(spark, stays, texts)
    assert rows(run.attached.filter("tag = '2024-02-01'"), "code", "iso", order="cls_ord") == [
        ("A1", 0),
        ("A2", 0),
    ]
    # The last day takes the total of the row before it: the second text's.
    assert rows(run.weighted, "gesamtwert", order=["tag", "cls_ord"]) == [(168.0,), (203.0,), (101.5,)]
    once = hospital(spark, stays, texts, dedupe_by_text=False)
    assert rows(once.attached.filter("tag = '2024-02-01'"), "code") == [("A2",)]


@pytest.mark.parametrize("own, marks", [(2, 2), (0, 2), (1, 0), (2, 1), (0, 1)])
def test_category_and_isolation_texts_pair_up(spark, own, marks):
    texts = ["01.02.24", "01.02.2024"]
    run = hospital(
        spark,
        [stay("p", "f", "IN1", "2024-02-01", "2024-02-01", 1)],
        [classified(i, "p", texts[i], "A1") for i in range(own)]
        + [classified(10 + i, "p", texts[i], "A5_ISO") for i in range(marks)],
    )
    assert run.attached.count() == max(own, 1) * max(marks, 1)
    assert {r.iso for r in run.attached.collect()} == {1 if marks else 0}


def test_fill_takes_next_then_previous(spark):
    run = hospital(
        spark,
        [stay("p", "f", "IN1", "2024-02-01", "2024-02-05", 1)],
        [classified(1, "p", "02.02.2024", "A1"), classified(2, "p", "04.02.2024", "A2")],
    )
    assert rows(run.rated, "code", "imputed", "imputed_after_fill", order="tag") == [
        ("A1", 1, 0),
        ("A1", 0, 0),
        ("A2", 1, 0),
        ("A2", 0, 0),
        ("A2", 1, 0),
    ]


def test_unknown_category_takes_the_ward_mean_and_is_not_imputed(spark):
    run = hospital(
        spark,
        [stay("p", "f", "IN1", "2024-02-01", "2024-02-01", 1), stay("q", "g", "IN1", "2024-02-01", "2024-02-02", 2)],
        [
            classified(1, "p", "01.02.2024", "A9"),
            classified(2, "q", "01.02.2024", "A1"),
            classified(3, "q", "02.02.2024", "A2"),
        ],
    )
    unknown = run.imputed.filter("code = 'A9'")
    assert rows(unknown, "wert", "imputed", "imputed_after_fill") == [(77.5, 0, 1)]


def test_ward_mean_uses_the_ward_before_merging(spark):
    run = hospital(
        spark,
        [
            stay("p", "f", "CH1", "2024-02-01", "2024-02-01", 1),
            stay("q", "g", "CH3", "2024-02-01", "2024-02-01", 2),
            stay("r", "h", "CH3", "2024-02-01", "2024-02-01", 3),
        ],
        [classified(1, "p", "01.02.2024", "A1"), classified(2, "q", "01.02.2024", "A2")],
    )
    assert rows(run.imputed.filter("case_key = '=h'"), "wert") == [(95.0,)]


def test_ward_without_any_minutes(spark):
    run = hospital(spark, [stay("p", "f", "IN1", "2024-02-01", "2024-02-02", 1)])
    assert rows(run.imputed, "wert", order="tag") == [(None,), (None,)]
    assert rows(run.ward_days, "ppr_tag", order="Tag") == [(0.0,), (0.0,)]


def test_isolated_days_take_the_raised_base_value(spark):
    run = hospital(
        spark,
        [stay("p", "f", "IN1", "2024-02-01", "2024-02-02", 1)],
        [classified(1, "p", "01.02.2024", "A5_ISO")],
    )
    assert rows(run.rated, "pflegegrundwert", order="tag") == [(123.0,), (33.0,)]


# Stays


def test_transfer_day_belongs_to_the_later_row(spark):
    run = hospital(
        spark,
        [
            stay("p", "f", "CH1", "2024-02-01", "2024-02-03", 1),
            stay("p", "f", "IN1", "2024-02-03", "2024-02-04", 2),
        ],
    )
    assert rows(run.master_days, "ward", order="tag") == [("CH1",), ("CH1",), ("IN1",), ("IN1",)]


def test_bounds_come_from_the_days_left_in_the_case(spark):
    run = hospital(
        spark,
        [
            stay("p", "f", "CH1", "2024-02-01", "2024-02-03", 1),
            stay("p", "g", "IN1", "2024-02-03", "2024-02-04", 2),
        ],
    )
    assert rows(run.weighted, "case_key", "nachts_da", order="tag") == [
        ("=f", 1),
        ("=f", 0),
        ("=g", 1),
        ("=g", 0),
    ]


def test_stays_that_do_not_count(spark):
    run = hospital(
        spark,
        [
            stay("a", "a", None, "2024-02-01", "2024-02-02", 1),
            stay("b", "b", "IN1", "2023-12-31", "2024-01-02", 2),
            stay("c", "c", "IN1", "2024-02-01", None, 3),
            stay("d", "d", "IN1", "2024-02-03", "2024-02-01", 4),
            stay("e", "e", "IN1", "2024-01-01", "2024-01-01", 5),
            stay("f", "f", "IN1", None, "2024-01-01", 6),
        ],
    )
    assert rows(patient_days.with_ids(run.valid_stays), "pid") == [("e",)]
    assert rows(run.rejected_stays(), "pid") == [("d",)]
    assert rows(run.stay_checks(), "counted", "open", "reversed", "without_begin") == [(1, 1, 1, 1)]
    assert run.long_stays().count() == 0
    everything = hospital(
        spark,
        [
            stay("a", "a", None, "2024-02-01", "2024-02-02", 1),
            stay("b", "b", "IN1", "2023-12-31", "2024-01-02", 2),
        ],
        admitted_from=None,
        require_ward=False,
    )
    assert everything.ward_days.count() == 5


def test_missing_patient_and_case_numbers_match_each_other(spark):
    run = hospital(
        spark,
        [
            stay(None, None, "IN1", "2024-02-01", "2024-02-02", 1),
            stay(None, None, "CH1", "2024-02-02", "2024-02-02", 2),
            stay("", "x", "IN1", "2024-02-01", "2024-02-01", 3),
        ],
        [classified(1, None, "01.02.2024", "A1")],
        newborns=[(None, "2024-03-01", "2024-03-01")],
    )
    days = patient_days.with_ids(run.attached)
    assert rows(days, "pid", "ward", "code", order=["tag", "ord"]) == [
        (None, "IN1", "A1"),
        ("", "IN1", None),
        (None, "CH1", None),
    ]
    # The newborn without a number removes the case without a number.
    kept = patient_days.with_ids(run.all_days).filter("code is null or code <> 'Ges_Neugeb'")
    assert rows(kept, "case_id") == [("x",)]


def test_missing_control_code_matches_missing_category(spark):
    run = hospital(
        spark, [stay("p", "f", "IN1", "2024-02-01", "2024-02-01", 1)], rates=[*RATES, (None, 7.0)]
    )
    assert rows(run.rated, "wert") == [(7.0,)]


# Newborns


def test_newborn_days_replace_the_case(spark):
    run = hospital(
        spark,
        [stay("p", "n", "IN1", "2024-02-01", "2024-02-02", 1), stay("q", "m", "IN1", "2024-02-01", "2024-02-02", 2)],
        newborns=[
            ("n", "2023-05-01 01:00", "2023-05-02 09:00"),
            ("n", "2023-05-01 02:00", "2023-05-02 10:00"),
            ("o", "2024-02-01", None),
            ("u", "2024-02-03", "2024-02-01"),
        ],
    )
    days = patient_days.with_ids(run.all_days)
    assert rows(days.filter("case_id = 'n'"), "tag", "ward", "gesamtwert", "nachts_da", "imputed", "pid") == [
        (day("2023-05-01"), "GB2", 110.0, 1, 0, None),
        (day("2023-05-02"), "GB2", 110.0, 0, 0, None),
    ]
    assert days.filter("case_id in ('o', 'u')").count() == 0
    assert days.filter("case_id = 'm'").count() == 2


def test_newborn_cases_still_shape_the_ward_mean(spark):
    run = hospital(
        spark,
        [stay("p", "n", "IN1", "2024-02-01", "2024-02-01", 1), stay("q", "m", "IN1", "2024-02-01", "2024-02-01", 2)],
        [classified(1, "p", "01.02.2024", "A2")],
        newborns=[("n", "2024-02-01", "2024-02-01")],
    )
    assert rows(run.all_days.filter("case_key = '=m'"), "wert") == [(95.0,)]


# Wards and reports


def test_unknown_ward_keeps_its_rows(spark):
    run = hospital(spark, [stay("p", "f", "ZZ9", "2024-02-01", "2024-02-02", 1)])
    report = run.monthly_report().filter("Schicht = 'Tag'")
    assert rows(report, "Station2", "Anzahl_Patienten", "Soll_Besetzung", "Kategorie") == [
        ("ZZ9", 2, None, None)
    ]


def test_merged_wards_with_unequal_quota_split_and_are_found(spark):
    wards = [
        ("CH1", "Chirurgie", 20.0, 0.1, 0.05, 0.05, 50.0),
        ("CH3", "Chirurgie", 18.0, 0.1, 0.05, 0.05, 40.0),
    ]
    run = hospital(spark, [stay("p", "f", "CH1", "2024-02-01", "2024-02-02", 1)], wards=wards)
    assert rows(run.split_wards(), "Station2", "rows") == [("CH13", 2)]
    assert run.ward_days.count() == 4
    assert rows(run.monthly_shifts().filter("Schicht = 'Tag'"), "Anzahl_Schichten") == [(2,)]


def test_beds_are_missing_when_one_is(spark):
    wards = [("CH1", "C", 20.0, 0.1, 0.1, 0.1, 50.0), ("CH3", "C", None, 0.1, 0.1, 0.1, 50.0)]
    run = hospital(spark, wards=wards)
    assert rows(run.master, "Station2", "betten") == [("CH13", None)]


def test_working_time(spark):
    run = hospital(spark)
    master = run.master.filter("Station2 = 'CH13'")
    assert rows(master, "betten", "arbeitszeit_tag_vk") == [(38.0, 330.0)]
    assert rows(master, "arbeitszeit_monat")[0][0] == pytest.approx(38.5 * (365 / 12 / 7) * 60)
    assert rows(master, "ausfallzeit")[0][0] == pytest.approx(0.2)


@pytest.mark.parametrize("patients, minutes", [(1, 480.0), (2, 480.0), (3, 720.0)])
def test_night_needs_at_least_one_nurse(spark, patients, minutes):
    stays = [stay(f"p{i}", f"f{i}", "IN1", "2024-02-01", "2024-02-02", i) for i in range(patients)]
    first = hospital(spark, stays).ward_days.filter("Tag = '2024-02-01'")
    assert rows(first, "Minuten_nacht", "VK_nacht") == [(minutes, pytest.approx(minutes / 330))]


def test_zero_quota_gives_missing_nights(spark):
    wards = [("IN1", "Intensiv", 8.0, 0.15, 0.05, 0.05, 0.0)]
    run = hospital(spark, [stay("p", "f", "IN1", "2024-02-01", "2024-02-02", 1)], wards=wards)
    assert rows(run.ward_days, "Minuten_nacht", "VK_nacht") == [(None, None)] * 2


def test_months_of_two_years(spark):
    stays = [
        stay("p", "f", "IN1", "2024-01-10", "2024-01-11", 1),
        stay("p", "g", "IN1", "2025-01-10", "2025-01-11", 2),
    ]
    run = hospital(spark, stays)
    assert rows(run.missing_report(), "Monat", "Tage", "Fehlend", "Anteil_fehlend") == [(1, 4, 4, 1.0)]
    apart = hospital(spark, stays, by_year=True)
    assert rows(apart.missing_report(), "Jahr", "Monat", "Tage") == [(2024, 1, 2), (2025, 1, 2)]
    assert apart.ward_month_total().count() == 2


def test_report_order_and_labels(spark):
    run = hospital(
        spark,
        [
            stay("p", "f", "GB2", "2024-01-31", "2024-02-01", 1),
            stay("q", "g", "CH3", "2024-02-01", "2024-02-02", 2),
        ],
    )
    report = run.in_report_order(run.monthly_report())
    got = [(r.Station2, r.Monat, r.Schicht, r.Station_GynGeb) for r in report.collect()]
    assert got == [
        ("CH13", 2, "Tag", "nein"),
        ("CH13", 2, "Nacht", "nein"),
        ("GB2", 1, "Tag", "ja"),
        ("GB2", 1, "Nacht", "ja"),
        ("GB2", 2, "Tag", "ja"),
        ("GB2", 2, "Nacht", "ja"),
    ]
    assert report.columns == [
        "Standortkennzeichen", "Station2", "FAB_Key", "FAB_Name", "Kategorie", "Monat", "Schicht",
        "Anzahl_Schichten", "Anzahl_Betten", "Anzahl_Patienten", "durchschnittliche_Patientenbelegung",
        "Station_GynGeb", "Soll_Besetzung", "Ausfall1", "Ausfall2", "Ausfall3", "Leitende_Pflege",
    ]


def test_night_lookup_and_qualification(spark):
    night = [(0.0, 1.0, 2.0, 3.0), (1.0, 100.0, 50.0, 200.0)]
    stays = [
        stay("p", "f", "IN1", "2024-02-01", "2024-02-02", 1),
        stay("q", "g", "GB2", "2024-02-01", "2024-02-02", 2),
    ]
    classes = [classified(1, "p", "01.02.2024", "A1"), classified(2, "q", "01.02.2024", "A1")]
    run = hospital(spark, stays, classes, night=night)
    nights = run.night_lookup()
    assert rows(nights.filter("Tag = '2024-02-01'"), "Station2", "Minuten_nacht") == [
        ("GB2", 200.0),
        ("IN1", 100.0),
    ]
    assert nights.columns == [
        "Station2", "Tag", "ppr_tag", "Patienten_mitternacht", "Fehlende_Tageswerte", "Patiententage",
        "arbeitszeit_tag_vk", "Minuten_nacht", "VK_tag", "VK_nacht",
    ]
    other = run.night_lookup(obstetric_wards=["IN1"]).filter("Tag = '2024-02-01'")
    assert rows(other, "Station2", "Minuten_nacht") == [("GB2", 100.0), ("IN1", 200.0)]

    # 168 and 63 minutes by the older weighting.
    got = rows(run.vk_by_qualification(), "Station2", "Jahr", "Monat", "Examiniert", "Hilf", "VK_Exam")
    exam_in = (168 + 63) * 0.8 + 101
    minutes = 38.5 * (365 / 12 / 7) * 60 * 0.8
    assert got[1] == ("IN1", 2024, 2, pytest.approx(exam_in), pytest.approx(231 * 0.2 + 52), pytest.approx(exam_in / minutes))
    assert got[0][3] == pytest.approx(231 * 0.8 + 203)


def test_census_outside_the_night_table_is_missing(spark):
    run = hospital(spark, [stay("p", "f", "IN1", "2024-02-01", "2024-02-02", 1)], night=[(0.0, 1.0, 2.0, 3.0)])
    assert rows(run.night_lookup(), "Minuten_nacht", order="Tag") == [(None,), (1.0,)]
    # Sums over known values only.
    assert rows(run.vk_by_qualification(), "Hilf") == [(2.0,)]


def test_strict_totals_of_a_month(spark):
    frame = spark.createDataFrame(
        [("A", day("2024-01-01"), 1.0, None), ("A", day("2024-01-02"), 3.0, 2.0)],
        "Station2 string, Tag date, VK_tag double, VK_nacht double",
    ).withColumns({"Patiententage": F.lit(5), "Patienten_mitternacht": F.lit(4)})
    run = hospital(spark)
    shifts = reports.monthly_shifts(frame, run.settings)
    assert rows(shifts, "shift_rank", "VK", "Anzahl_Patienten") == [(0, 2.0, 10), (1, None, 8)]
    total = run.ward_month_total(frame)
    assert rows(total, "VK_ges", "mittlere_Belegung") == [(None, 4.5)]


# Control table


@pytest.mark.parametrize("missing", ["Pflegegrundwert", "Ausfallzeiten", "Entlassung"])
def test_a_missing_control_row_is_an_error(spark, missing):
    run = hospital(
        spark,
        [stay("p", "f", "IN1", "2024-02-01", "2024-02-02", 1)],
        rates=[r for r in RATES if r[0] != missing],
    )
    with pytest.raises(Exception, match="exactly one row"):
        run.monthly_report().collect()


def test_a_repeated_control_row_is_an_error(spark):
    run = hospital(
        spark,
        [stay("p", "f", "IN1", "2024-02-01", "2024-02-02", 1)],
        rates=[*RATES, ("Aufnahme", 1.0)],
    )
    with pytest.raises(Exception, match="exactly one row"):
        run.monthly_report().collect()


# Column expressions


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column).first()[0]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("01.02.2024", "2024-02-01"),
        ("1.2.24", "2024-02-01"),
        ("01.02.68", "2068-02-01"),
        ("01.02.69", "1969-02-01"),
        ("29.02.72", "1972-02-29"),
        ("01.02.99", "1999-02-01"),
        ("31.02.2024", None),
        ("29.02.2023", None),
        ("01.13.2024", None),
        ("01.02.024", None),
        ("2024-02-01", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_day(spark, text, wanted):
    got = one(spark, parse_day(F.col("t").cast("string")), t=text)
    assert got == (wanted and day(wanted))


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("01.02.2024 10:00", "2024-02-01"),
        ("1.2.24 7:5", "2024-02-01"),
        ("01.02.99 10:00", "1999-02-01"),
        ("01.02.2024 23:59", "2024-02-01"),
        ("01.02.2024 24:00", None),
        ("01.02.2024 10:60", None),
        ("01.02.2024", None),
        (None, None),
    ],
)
def test_parse_moment_day(spark, text, wanted):
    got = one(spark, parse_moment_day(F.col("t").cast("string")), t=text)
    assert got == (wanted and day(wanted))


@pytest.mark.parametrize(
    "text, wanted",
    [("7:05:09", "07:05:09"), ("07:05", "07:05:00"), ("25:00", None), ("7.05", None), (None, None)],
)
def test_parse_clock(spark, text, wanted):
    assert one(spark, parse_clock(F.col("t").cast("string")), t=text) == wanted


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("1,5", 1.5),
        ("1.234,5", 1234.5),
        ("1.234.567", 1234567.0),
        ("-0,25", -0.25),
        ("0.2", 0.2),
        ("12", 12.0),
        ("k.A.", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_decimal_comma(spark, text, wanted):
    assert one(spark, parse_decimal_comma(F.col("t").cast("string")), t=text) == wanted


def test_numbers_of_all_columns(spark):
    frame = spark.createDataFrame([("1", "x y"), ("2.5", "7")], "a string, `b c` string")
    assert [tuple(r) for r in all_to_number(frame).collect()] == [(1.0, None), (2.5, 7.0)]
    assert one(spark, to_number(F.col("t")), t="1,5") is None


def test_if_known(spark):
    frame = spark.createDataFrame([(1,), (3,), (None,)], "x int")
    got = frame.select(if_known(F.col("x") > 2, F.lit("a"), F.lit("b"))).collect()
    assert [r[0] for r in got] == ["b", "a", None]


def test_strict_aggregates(spark):
    frame = spark.createDataFrame([(1, 1.0), (1, None), (2, 2.0), (2, 4.0)], "g int, x double")
    got = frame.groupBy("g").agg(strict_sum(F.col("x")), strict_mean(F.col("x"))).orderBy("g")
    assert [tuple(r) for r in got.collect()] == [(1, None, None), (2, 6.0, 3.0)]


def test_key_text_keeps_missing_and_empty_apart(spark):
    frame = spark.createDataFrame([(None,), ("",), ("=",), ("a",)], "k string")
    keys = frame.select("k", key_text(F.col("k")).alias("t"))
    assert keys.filter("t is null").count() == 0
    assert keys.select("t").distinct().count() == 4
    assert keys.filter(~key_value(F.col("t")).eqNullSafe(F.col("k"))).count() == 0


def test_keep_last_with_missing_keys(spark):
    frame = spark.createDataFrame(
        [(None, 1, "a"), (None, 2, "b"), ("x", 3, None), ("x", 1, "d")], "k string, o int, v string"
    )
    last = keep_last(frame, ["k"], "o")
    assert rows(last, "k", "o", "v") == [(None, 2, "b"), ("x", 3, None)]
    assert rows(keep_last(last, ["k"], "o"), "k", "o", "v") == rows(last, "k", "o", "v")


def test_classification_extras_are_carried(spark):
    frame = spark.createDataFrame(
        [(1, "A1", "A1", "p", "01.02.2024", "K1"), (2, "A2", "A2", "p", "01.02.2024", "K2")],
        "ord bigint, category string, code string, pid string, datum string, anf_kostenstelle string",
    )
    run = hospital(spark, [stay("p", "f", "IN1", "2024-02-01", "2024-02-02", 1)])
    last = patient_days.last_classifications(frame, run.settings, ["anf_kostenstelle"])
    days = patient_days.attach_classifications(run.master_days, patient_days.classified_days(last))
    assert rows(days, "code", "anf_kostenstelle", order="tag") == [("A2", "K2"), (None, None)]


def test_older_master_groups_without_the_quota(spark):
    wards = [w[:-1] + (q,) for w, q in zip(WARD_ROWS[:2], (50.0, 40.0))]
    run = hospital(spark, wards=wards)
    older = ward_days.ward_master(run.inputs.wards, run.settings, with_quota=False)
    assert rows(older, "Station2", "betten") == [("CH13", 38.0)]


@pytest.mark.parametrize("text", ["60d", "60f", "NaN", "Infinity", "-Infinity", "1e", "0x1p3", "1,2,3", "", "."])
def test_texts_that_are_no_numbers(spark, text):
    assert one(spark, parse_decimal_comma(F.col("t")), t=text) is None
    assert one(spark, to_number(F.col("t")), t=text) is None


def test_dots_that_group_nothing_are_decimal_points(spark):
    assert one(spark, parse_decimal_comma(F.col("t")), t="1.5") == 1.5
    assert one(spark, parse_decimal_comma(F.col("t")), t="-1.234.567,5") == -1234567.5


def test_fractional_night_keys_match_no_census(spark):
    run = hospital(
        spark,
        [stay("p", "f", "IN1", "2024-02-01", "2024-02-02", 1)],
        night=[(0.0, 1.0, 2.0, 3.0), (1.0, 7.0, 8.0, 9.0), (1.6, 70.0, 80.0, 90.0)],
    )
    assert rows(run.night_lookup(), "Minuten_nacht", order="Tag") == [(7.0,), (1.0,)]


def test_rejected_newborns_are_kept_apart(spark):
    births = spark.createDataFrame(
        [("a", "2024-01-01", "2024-01-02"), ("b", None, "2024-01-02"), ("c", "2024-01-01", None), ("d", "2024-01-03", "2024-01-02"), ("e", None, None)],
        "case_id string, birth string, discharge string",
    ).selectExpr("case_id", "cast(birth as timestamp) as birth", "cast(discharge as timestamp) as discharge")
    assert rows(workload.rejected_newborns(births), "case_id") == [("b",), ("c",), ("d",), ("e",)]
    assert tuple(workload.newborn_checks(births).first()) == (1, 2, 1, 1)
    assert workload.newborn_spans(births).count() == 1


def test_numbers_too_large_for_a_double_are_missing(spark):
    texts = spark.createDataFrame([("1e400",), ("-1e400",), ("1e300",)], "t string")
    got = texts.select(to_number(F.col("t")).alias("n"), parse_decimal_comma(F.col("t")).alias("m")).collect()
    assert [tuple(r) for r in got] == [(None, None), (None, None), (1e300, 1e300)]


def test_a_stay_of_200_years_is_reported_and_counts_unless_forbidden(spark):
    stays = [stay("a", "a", "IN1", "2024-02-28", "2223-02-27", 1), stay("b", "b", "IN1", "2024-01-31", "2024-03-01", 2)]
    run = hospital(spark, stays)
    assert rows(run.long_stays(), "pid", "days") == [("a", (dt.date(2223, 2, 27) - dt.date(2024, 2, 28)).days + 1)]
    days = run.master_days.groupBy("pid_key").agg(F.count_distinct("tag").alias("n"), F.count("tag").alias("rows"))
    assert rows(days, "n", "rows", order=["pid_key"]) == [(72683, 72683), (31, 31)]
    assert rows(hospital(spark, stays, count_long_stays=False).master_days.groupBy("pid_key").count(), "count") == [(31,)]


def test_distinct_days_over_years_and_split_wards(spark):
    """Days as bits of calendar months equal a distinct count, with repeated ward-days and missing values."""
    rng = random.Random(3)
    days = [dt.date(2023, 12, 30) + dt.timedelta(days=rng.randrange(430)) for _ in range(600)]
    kinds = [(rng.choice("ab"), d, rng.randrange(9), rng.choice([1.0, 2.5]), rng.choice([0, 3, 4])) for d in days]
    kinds.append(("c", dt.date(2024, 5, 31), 1, None, None))
    frame = spark.createDataFrame(
        kinds, "Station2 string, Tag date, Patiententage long, VK_tag double, Patienten_mitternacht long"
    ).withColumn("VK_nacht", F.col("VK_tag") / 2)
    for by_year in (False, True):
        keys = ["Station2", *([F.year("Tag").alias("Jahr")] if by_year else []), F.month("Tag").alias("Monat")]
        names = ["Station2", "Jahr", "Monat"] if by_year else ["Station2", "Monat"]
        shifts = reports.monthly_shifts(frame, Settings(by_year=by_year)).filter("Schicht = 'Tag'")
        assert "distinct" not in shifts._jdf.queryExecution().executedPlan().toString().lower()
        plain = frame.groupBy(*keys).agg(
            F.count_distinct("Tag"), F.sum("Patiententage"), F.round(F.avg("Patiententage"), 9),
            F.when(F.count("VK_tag") == F.count(F.lit(1)), F.round(F.try_divide(F.sum("VK_tag"), F.count_distinct("Tag")), 9)),
        )
        mean, vk = F.round("durchschnittliche_Patientenbelegung", 9), F.round("VK", 9)
        got = shifts.select(*names, "Anzahl_Schichten", "Anzahl_Patienten", mean, vk)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
        assert got.filter("Station2 = 'c'").first()[-1] is None
