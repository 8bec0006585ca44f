"""Large cases cut into pieces give the same rows as whole cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import pflegetakt.operators.skew as skew
from hospital import RATES, classified, hospital, rows, stay
from pflegetakt.operators.rows import expand_days, keep_last, visible_spans
from pflegetakt.plans.patient_days import with_ids
from pflegetakt.plans.ward_days import ward_totals


def busy(spark, seed, **settings):
    """Most stays share one placeholder case, or none at all."""
    rng = random.Random(seed)
    start = dt.date(2024, 1, 1)
    stays, classes = [], []
    for ord in rng.sample(range(100_000), 120):
        begin = start + dt.timedelta(days=rng.randrange(20))
        end = begin + dt.timedelta(days=rng.randrange(6))
        case = rng.choice([None, None, "dummy", "dummy", f"f{rng.randrange(12)}"])
        ward = rng.choice(["CH1", "CH3", "IN1", "ZZ9"])
        stays.append(stay(f"p{rng.randrange(40)}", case, ward, str(begin), str(end), ord))
    for ord in range(260):
        date = start + dt.timedelta(days=rng.randrange(26))
        text = date.strftime(rng.choice(["%d.%m.%Y", "%d.%m.%y"]))
        code = rng.choice(["A1", "A2", "A9", "A5_ISO"])
        classes.append(classified(ord, f"p{rng.randrange(40)}", text, code))
    rates = [(k, 0.5 if k == "Entlassung" else v) for k, v in RATES]
    return hospital(spark, stays, classes, rates, newborns=[("f1", "2024-01-03", "2024-01-05")], **settings)


def everything(run):
    days = with_ids(run.weighted)
    names = [
        "pid", "case_id", "ward", "tag", "ord", "cls_ord", "iso", "code_own", "code", "imputed",
        "first_day", "last_day", "nachts_da",
    ]
    values = [F.round(n, 6).alias(n) for n in ("wert", "aufnahmewert", "entlasswert", "gesamtwert")]
    return sorted((tuple(r) for r in days.select(*names, *values).collect()), key=repr)


def pieces_of(run):
    cut = run.filled.filter("piece is not null").groupBy("scan_key").count()
    return [r["count"] for r in cut.collect()]


@pytest.mark.parametrize("seed,samples", [(1, 1), (2, 64)])
def test_cut_cases_equal_whole_cases(spark, monkeypatch, seed, samples):
    monkeypatch.setattr(skew, "SAMPLES", samples)
    whole = busy(spark, seed)
    cut = busy(spark, seed, max_case_days=30)
    assert pieces_of(whole) == []
    assert len(pieces_of(cut)) >= (2 if samples == 64 else 8)
    assert everything(cut) == everything(whole)


def test_any_comparable_row_order_cuts_cases(spark, monkeypatch):
    """Texts and sparse numbers as row order; pieces stay few and bounded."""
    monkeypatch.setattr(skew, "SAMPLES", 4)
    for order in (F.concat(F.lit("z"), F.col("ord").cast("string")), F.col("ord") * 1_000_003):
        whole, cut = busy(spark, 7), busy(spark, 7, max_case_days=30)
        for run in (whole, cut):
            object.__setattr__(run.inputs, "stays", run.inputs.stays.withColumn("ord", order))
        assert everything(cut) == everything(whole)
        sizes = pieces_of(cut)
        assert len(sizes) > 8 and max(sizes) <= 40


def test_reports_do_not_depend_on_the_size_limits(spark):
    def report(run):
        names = ["Station2", "Monat", "Schicht", "Anzahl_Patienten"]
        vk = F.round("Soll_Besetzung", 6).alias("vk")
        return sorted((tuple(r) for r in run.monthly_report().select(*names, vk).collect()), key=repr)

    plain = report(busy(spark, 3))
    assert report(busy(spark, 3, max_case_days=30)) == plain
    assert report(busy(spark, 3, max_broadcast_wards=0)) == plain


@pytest.mark.parametrize("seed,factor,older", [(3, 0.5, False), (8, 0.5, True), (9, -1.0, False), (9, 0.0, True)])
def test_totals_of_sums_equal_totals_of_rows(spark, seed, factor, older):
    """Means that enter after the aggregation give what means in the rows give."""
    run = busy(spark, seed, max_case_days=40)
    controls = run.inputs.controls.withColumn("wert", F.when(F.col("kategorie") == "Entlassung", factor).otherwise(F.col("wert")))
    object.__setattr__(run.inputs, "controls", controls)
    rows_of, sums_of = (run.weighted_older, run.ward_totals_older) if older else (run.all_days, run.ward_totals)
    assert rows_of.filter("wert is null").count() + run.rated.filter("wert is null").count() > 0

    def shown(totals):
        names = ["Station2", "Tag", "Patienten_mitternacht", "Fehlende_Tageswerte", "Patiententage"]
        return sorted((tuple(r) for r in totals.select(*names, F.round("ppr_tag", 6).alias("ppr_tag")).collect()), key=repr)

    assert shown(sums_of) == shown(ward_totals(rows_of, run.settings))


def test_building_reports_runs_no_job(spark):
    run = busy(spark, 3, max_case_days=30)
    spark.sparkContext.setJobGroup("build", "plans only")
    try:
        run.monthly_report()
        run.vk_by_qualification()
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("build")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_pieces_of_one_day_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(skew, "SAMPLES", 8)
    stays = [stay(f"p{i}", None, "IN1", "2024-02-01", "2024-02-01", i) for i in range(100)]
    run = hospital(spark, stays, max_case_days=50)
    sizes = pieces_of(run)
    assert sum(sizes) == 100 and max(sizes) <= 50
    assert run.filled.count() == 100


def test_large_cases_are_few(spark, monkeypatch):
    """Above one in MOST_HOT of all days, whatever the setting."""
    monkeypatch.setattr(skew, "MOST_HOT", 4)
    stays = [stay(f"p{i}", f"f{i % 10}", "IN1", "2024-02-01", "2024-02-05", i) for i in range(40)]
    stays += [stay(f"q{i}", "big", "IN1", "2024-02-01", "2024-02-05", 100 + i) for i in range(40)]
    run = hospital(spark, stays, max_case_days=1)
    assert [r["case_key"] for r in run.hot.cuts.select("case_key").collect()] == ["=big"]


def test_newborns_leave_large_cases(spark, monkeypatch):
    monkeypatch.setattr(skew, "SAMPLES", 2)
    stays = [stay(f"p{i}", "f1", "IN1", "2024-02-01", "2024-02-03", i) for i in range(20)]
    run = hospital(spark, stays, newborns=[("f1", "2024-02-01", "2024-02-02")], max_case_days=10)
    assert pieces_of(run)
    assert run.all_days.count() == 2
    assert rows(run.ward_totals, "Station2", "Patiententage", order=["Tag"]) == [("GB2", 1), ("GB2", 1)]


def test_a_category_that_stands_twice_counts_twice_in_order(spark):
    """The control row's place is part of the order of days, for any partitioning."""
    twice = [(k, v) for k, v in RATES] + [("A1", 40.0)]
    for parts in (1, 7):
        run = hospital(
            spark,
            [stay("p", "f", "IN1", "2024-02-01", "2024-02-03", 1)],
            [classified(1, "p", "01.02.2024", "A1"), classified(2, "p", "02.02.2024", "A2"), classified(3, "p", "03.02.2024", "A1")],
            twice,
        )
        numbered = run.inputs.controls.withColumn("ord", F.when(F.col("wert") == 40.0, 100).otherwise(1))
        object.__setattr__(run.inputs, "controls", numbered.repartition(parts))
        days = run.weighted.orderBy("tag", "rate_ord").select("tag", "wert", "entlasswert", "gesamtwert")
        got = [(r["tag"].day, *r[1:]) for r in days.collect()]
        # 33 base minutes, 75 on the first day; the last day takes half of the row before.
        assert got == [
            (1, 60.0, 0.0, 168.0), (1, 40.0, 0.0, 148.0), (2, 95.0, 0.0, 128.0), (3, 60.0, 64.0, 64.0), (3, 40.0, 46.5, 46.5),
        ]
        shares = rows(run.ward_totals, "ppr_tag", order=["Tag"])
        assert shares == [(316.0,), (128.0,), (110.5,)]


def test_results_do_not_depend_on_partitioning(spark):
    whole = busy(spark, 4)
    spread = busy(spark, 4)
    inputs = spread.inputs
    object.__setattr__(inputs, "stays", inputs.stays.repartition(7, "pid"))
    object.__setattr__(inputs, "classifications", inputs.classifications.repartition(5))
    assert everything(spread) == everything(whole)


@pytest.mark.parametrize("seed", range(3))
def test_visible_spans_equal_the_last_row_of_each_day(spark, seed):
    rng = random.Random(seed)
    start = dt.date(2024, 1, 1)
    spans = []
    for ord in rng.sample(range(100_000), 300):
        begin = start + dt.timedelta(days=rng.randrange(40))
        end = begin + dt.timedelta(days=rng.choice([0, 1, 2, 9, 30]))
        spans.append((rng.choice(["", "", "=p1", f"=p{rng.randrange(60)}"]), f"f{ord}", begin, end, ord))
    frame = spark.createDataFrame(spans, "pid_key string, case_key string, begin_day date, end_day date, ord bigint")
    for order in (F.col("ord"), F.struct(F.lit("file"), F.col("ord"))):
        ordered = frame.withColumn("ord", order).repartition(5)
        old = keep_last(expand_days(ordered, "begin_day", "end_day"), ["pid_key", "tag"], "ord")
        seen = visible_spans(ordered, "pid_key", "begin_day", "end_day", "ord")
        names = ["pid_key", "tag", "case_key", "ord"]
        days = expand_days(seen, "begin_day", "end_day").select(*names).collect()
        assert sorted(days) == sorted(old.select(*names).collect())
    assert seen.count() < len(days) and visible_spans(frame.limit(0), "pid_key", "begin_day", "end_day", "ord").count() == 0


def test_invariants(spark):
    run = busy(spark, 5)
    assert run.master_days.groupBy("pid_key", "tag").count().filter("count > 1").isEmpty()
    total = run.ward_days.select("Station2", "Tag", "Patiententage").distinct()
    assert total.agg(F.sum("Patiententage")).first()[0] == run.all_days.count()
    own = run.rated.filter("code_own is not null").select("case_key", F.col("code_own").alias("code"))
    filled = run.rated.filter("code is not null").select("case_key", "code")
    assert filled.exceptAll(filled.join(own.distinct(), ["case_key", "code"])).isEmpty()
    months = run.ward_days.select("Station2", F.month("Tag")).distinct().count()
    assert run.monthly_shifts().count() == 2 * months
