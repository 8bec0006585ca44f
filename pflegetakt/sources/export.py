"""Report output: one folder per report under one folder per run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from pflegetakt.plans.staffing import Staffing

# Names of the reports.
WARD_DAYS = "ppr_ergebnis"
MONTHLY = "ppr_bericht"
MISSING = "fehlende_daten"
WARD_MONTHS = "personalbedarf_station_monat"
CONTROLS = "Steuerung"
NIGHT = "Nachtdienst"


def run_folder(target: str, started: dt.datetime | None = None) -> str:
    """Folder of one run; its name carries the time."""
    started = started or dt.datetime.now()
    return f"{target.rstrip('/')}/run_ts={started:%Y-%m-%d_%H-%M-%S}"


def _write(df: DataFrame, folder: str, report: str) -> DataFrame:
    """Computes a report once, as Parquet; the CSV is made from what was written."""
    df.write.mode("overwrite").parquet(f"{folder}/{report}/parquet")
    stored = read_report(df.sparkSession, folder, report)
    stored.write.mode("overwrite").csv(f"{folder}/{report}/csv", sep=";", header=True, escape='"')
    return stored


def read_report(spark: SparkSession, folder: str, report: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{report}/parquet")


def export_reports(
    spark: SparkSession, staffing: Staffing, folder: str, controls: bool = False
) -> str:
    """Writes all reports of a run as Parquet and as CSV, replacing what is there.

    Ward-days are a report themselves and the source of the others. They are
    written first and read back, so the patient-day pipeline runs once, and a lost
    executor costs at most a small aggregate of stored rows.
    """
    stored = _write(staffing.ward_days, folder, WARD_DAYS)
    monthly = staffing.in_report_order(staffing.monthly_report(stored))
    # one file, as the rows are few and their order is part of the report
    report = _write(monthly.coalesce(1), folder, MONTHLY)
    _write(staffing.missing_report(stored), folder, MISSING)
    _write(staffing.ward_month_total(report=report), folder, WARD_MONTHS)
    checks = {
        "check_stays": staffing.stay_checks(),
        "check_newborns": staffing.newborn_checks(),
        "rejected_stays": staffing.rejected_stays().drop("ord"),
        "long_stays": staffing.long_stays().drop("ord"),
        "rejected_newborns": staffing.rejected_newborns(),
        "split_wards": staffing.split_wards(),
    }
    for name, check in checks.items():
        _write(check, folder, name)
    if controls:
        _write(staffing.inputs.controls, folder, CONTROLS)
        if staffing.inputs.night is not None:
            _write(staffing.inputs.night, folder, NIGHT)
    return folder
