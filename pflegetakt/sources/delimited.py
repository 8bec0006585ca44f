"""Semicolon-delimited input files.

Columns are read as text, so no pass is spent on inferring types, and parsed with
explicit rules. Files stay splittable. The row order of a file is data: the later
row wins. It is kept as path, block start and row number within the task, which
rises along the file however it is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pflegetakt.functions.dates import parse_clock, parse_moment_day
from pflegetakt.functions.numbers import all_to_number, parse_decimal_comma
from pflegetakt.schemas import require
from pflegetakt.sources.records import quoted_records

# Column headers of the input files.
CLASSIFICATION_COLUMNS = {
    "code": "Kürzel",
    "case_id": "Fallnummer",
    "pid": "PID",
    "datum": "Datum (Tag)",
}
CLASSIFICATION_EXTRAS = {
    "dauer_min": "Dauer (Minuten)",
    "aufzeit": "Datum (Zeit)",
    "anf_ks": "Anf. KS",
    "anf_kostenstelle": "Anf. Kostenstelle",
}
STAY_COLUMNS = {
    "pid": "PID",
    "case_id": "Fallnummer",
    "begin_ts": "Aufenthaltsbeginn",
    "end_ts": "Aufenthaltsende",
}
# The header of the ward column occurs more than once; its place decides.
STAY_WARD_POSITION = 9
CONTROL_COLUMNS = {"kategorie": "Kategorie", "wert": "Wert"}
WARD_COLUMNS = {
    "ward": "Station",
    "kategorie": "Kategorie",
    "betten": "Betten",
    "ausfall1": "Ausfall1",
    "ausfall2": "Ausfall2",
    "ausfall3": "Ausfall3",
    "nachtdienst_quote": "nachtdienst_quote",
}
NEWBORN_COLUMNS = {
    "case_id": "Fallnummer  Säugling",
    "birth": "Entbindung",
    "discharge": "Entlassung",
}
NIGHT_COLUMNS = {
    "patienten": "Patienten",
    "min_ex_net": "Minuten_ex_nacht_net",
    "min_hilf_net": "Minuten_Hilf_nacht_net",
    "min_ex_geb_net": "Minuten_ex_nacht_geb_net",
}


def scan_delimited(
    spark: SparkSession,
    path: str,
    encoding: str = "UTF-8",
    with_order: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """All columns of a file with a header row, as text; empty, quoted or not, and ``NA`` are missing.

    Quotes inside quoted values are doubled; a backslash is text. Spark appends the
    position to repeated headers. ``with_order`` adds ``ord``. ``multiline`` accepts
    line breaks inside quoted values (not in headers); files stay splittable.
    """
    layout = {"sep": ";", "nullValue": "NA", "escape": '"'}
    read = spark.read.csv(path, header=True, encoding=encoding, **layout)
    names = read.columns
    if multiline:
        records = quoted_records(spark, path, encoding).filter((F.col("block") > 0) | (F.col("row") > 1))
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        values = F.from_csv("record", schema, {**layout, "multiLine": "true"})
        read = records.select(F.struct("path", "block", "row").alias("ord"), values.alias("v"))
        read = read.select(*[F.col(f"v.c{i}").alias(name) for i, name in enumerate(names)], "ord")
    known = [F.nullif(F.col(f"`{name}`"), F.lit("")).alias(name) for name in names]
    if multiline:
        return read.select(*known, *(["ord"] if with_order else []))
    if not with_order:
        return read.select(*known)
    place = F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return read.select(*known, place.alias("ord"))


def _named(table: str, rows: DataFrame, columns: dict[str, str]) -> list[Column]:
    require(table, rows.columns, columns.values())
    return [F.col(f"`{header}`").alias(name) for name, header in columns.items()]


def read_classifications(
    spark: SparkSession, path: str, encoding: str = "UTF-8", extras: bool = False, multiline: bool = False
) -> DataFrame:
    rows = scan_delimited(spark, path, encoding, with_order=True, multiline=multiline)
    columns = [
        F.col(f"`{rows.columns[0]}`").alias("category"),
        *_named("classifications", rows, CLASSIFICATION_COLUMNS),
        "ord",
    ]
    if not extras:
        return rows.select(*columns)
    columns += _named("classifications", rows, CLASSIFICATION_EXTRAS)
    return rows.select(*columns).withColumns(
        {
            "dauer_min": parse_decimal_comma(F.col("dauer_min")),
            "aufzeit": parse_clock(F.col("aufzeit")),
        }
    )


def read_stays(
    spark: SparkSession, path: str, encoding: str = "UTF-8", multiline: bool = False
) -> DataFrame:
    rows = scan_delimited(spark, path, encoding, with_order=True, multiline=multiline)
    headers = [name for name in rows.columns if name != "ord"]
    if len(headers) < STAY_WARD_POSITION:
        require("stays", headers, [f"number {STAY_WARD_POSITION} (ward)"])
    ward = F.col(f"`{headers[STAY_WARD_POSITION - 1]}`").alias("ward")
    return rows.select(*_named("stays", rows, STAY_COLUMNS), ward, "ord").withColumns(
        {
            "begin_ts": parse_moment_day(F.col("begin_ts")),
            "end_ts": parse_moment_day(F.col("end_ts")),
        }
    )


def read_controls(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    rows = scan_delimited(spark, path, encoding)
    return rows.select(*_named("controls", rows, CONTROL_COLUMNS)).withColumn(
        "wert", parse_decimal_comma(F.col("wert"))
    )


def read_wards(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    rows = scan_delimited(spark, path, encoding)
    numbers = [name for name in WARD_COLUMNS if name not in ("ward", "kategorie")]
    return rows.select(*_named("wards", rows, WARD_COLUMNS)).withColumns(
        {name: parse_decimal_comma(F.col(name)) for name in numbers}
    )


def read_newborns(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    rows = scan_delimited(spark, path, encoding)
    return rows.select(*_named("newborns", rows, NEWBORN_COLUMNS)).withColumns(
        {
            "birth": parse_moment_day(F.col("birth")),
            "discharge": parse_moment_day(F.col("discharge")),
        }
    )


def read_night(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    rows = scan_delimited(spark, path, encoding)
    return all_to_number(
        rows.select(*_named("night", rows, NIGHT_COLUMNS)), parse_decimal_comma
    )
