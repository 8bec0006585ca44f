"""Delimited files in, report folders out."""

import csv
import datetime as dt
import io
import json
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hospital import hospital, rows, stay
from pflegetakt import Inputs, Staffing
from pflegetakt.schemas import MissingColumns
from pflegetakt.sources import delimited
from pflegetakt.sources.export import export_reports, read_report, run_folder
from pflegetakt.sources.records import numbered_lines, quoted_records

STAYS = (
    "PID;Fallnummer;a;b;c;Station;Aufenthaltsbeginn;Aufenthaltsende;Station;d\n"
    "1;F1;x;x;x;wrong;01.02.2024 08:00;03.02.24 10:30;CH1;x\n"
    "1;F1;x;x;x;wrong;03.02.2024 10:30;04.02.2024 09:00;IN1;x\n"
    "2;F2;x;x;x;wrong;01.02.99 08:00;02.02.99 09:00;IN1;x\n"
    "3;F3;x;x;x;wrong;01.02.2024 08:00;;IN1;x\n"
    "4;F4;x;x;x;wrong;01.02.2024 08:00;02.02.2024 08:00;NA;x\n"
)
CLASSES = (
    "Kategorie;Fallnummer;PID;Name;Kürzel;Datum (Tag);Dauer (Minuten);Datum (Zeit);Anf. KS;Anf. Kostenstelle\n"
    "A1 Pflege;F1;1;Müller;A1;01.02.2024;12,5;7:05;KS;100\n"
    "A1 Pflege;F1;1;Müller;A2;01.02.2024;;07:06:30;KS;200\n"
    "Essen;F1;1;Müller;A9;02.02.2024;1;;KS;300\n"
    "A5 Iso;F1;1;Müller;A5_ISO;02.02.24;1;25:00;KS;300\n"
)
CONTROLS = (
    "Kategorie;Wert\nA1;60\nA2;95,5\nPflegegrundwert;33\nerhöhter Pflegegrundwert;1.123,25\n"
    "Aufnahme;75\nEntlassung;0,5\nAusfallzeiten;0,2\nAnteil_Hilf;0,8\n"
)
WARDS = (
    "Station;Kategorie;Betten;Ausfall1;Ausfall2;Ausfall3;nachtdienst_quote\n"
    "CH1;Chirurgie;20;0,1;0,05;0,05;50\nIN1;Intensiv;8;0,15;0,05;0,05;2,5\n"
)
NEWBORNS = "Fallnummer  Säugling;Entbindung;Entlassung\n77;01.03.24 03:10;02.03.2024 11:00\n"
NIGHT = (
    "Patienten;Minuten_ex_nacht_net;Minuten_Hilf_nacht_net;Minuten_ex_nacht_geb_net\n"
    "0;480;240,5;500\n1;490;k.A.;510\n"
)


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def inputs_from(spark, folder):
    return Inputs(
        stays=delimited.read_stays(spark, write(folder, "stays.csv", STAYS)),
        classifications=delimited.read_classifications(spark, write(folder, "cls.csv", CLASSES)),
        controls=delimited.read_controls(spark, write(folder, "controls.csv", CONTROLS)),
        wards=delimited.read_wards(spark, write(folder, "wards.csv", WARDS)),
        newborns=delimited.read_newborns(spark, write(folder, "newborns.csv", NEWBORNS)),
        night=delimited.read_night(spark, write(folder, "night.csv", NIGHT)),
    )


def test_files_to_report(spark, tmp_path):
    run = Staffing(inputs_from(spark, tmp_path))
    days = rows(run.weighted, "tag", "ward", "code", "iso", "gesamtwert", order="tag")
    assert [(d[0].day, d[1], d[2], d[3]) for d in days] == [
        (1, "CH1", "A2", 0),
        (2, "CH1", "A2", 1),
        (3, "IN1", "A2", 0),
        (4, "IN1", "A2", 0),
    ]
    assert [d[4] for d in days] == [203.5, 1218.75, 128.5, 64.25]
    assert rows(run.all_days.filter("code = 'Ges_Neugeb'"), "case_key", "gesamtwert", order="tag") == [
        ("=77", 110.0),
        ("=77", 110.0),
    ]
    # The wards file knows no GB2, so newborns keep missing attributes.
    assert run.monthly_report().count() == 6


def test_ninth_column_is_the_ward(spark, tmp_path):
    stays = delimited.read_stays(spark, write(tmp_path, "s.csv", STAYS))
    assert [r.ward for r in stays.orderBy("ord").collect()] == ["CH1", "IN1", "IN1", "IN1", None]
    assert [r.end_ts for r in stays.orderBy("ord").collect()][:4] == [
        dt.date(2024, 2, 3),
        dt.date(2024, 2, 4),
        dt.date(1999, 2, 2),
        None,
    ]


def test_byte_order_mark_and_latin1(spark, tmp_path):
    marked = write(tmp_path, "bom.csv", CONTROLS, "utf-8-sig")
    assert delimited.read_controls(spark, marked).columns == ["kategorie", "wert"]
    latin = write(tmp_path, "latin.csv", CLASSES, "latin-1")
    with pytest.raises(MissingColumns, match="Kürzel"):
        delimited.read_classifications(spark, latin)
    read = delimited.read_classifications(spark, latin, "ISO-8859-1")
    assert [r.code for r in read.orderBy("ord").collect()] == ["A1", "A2", "A9", "A5_ISO"]


def test_classification_extras(spark, tmp_path):
    path = write(tmp_path, "c.csv", CLASSES)
    read = delimited.read_classifications(spark, path, extras=True)
    assert rows(read, "dauer_min", "aufzeit", "anf_ks", "anf_kostenstelle", order="ord") == [
        (12.5, "07:05:00", "KS", "100"),
        (None, "07:06:30", "KS", "200"),
        (1.0, None, "KS", "300"),
        (1.0, None, "KS", "300"),
    ]


def test_numbers(spark, tmp_path):
    night = delimited.read_night(spark, write(tmp_path, "n.csv", NIGHT))
    assert rows(night, *night.columns) == [(0.0, 480.0, 240.5, 500.0), (1.0, 490.0, None, 510.0)]
    controls = delimited.read_controls(spark, write(tmp_path, "k.csv", CONTROLS))
    assert controls.filter("kategorie = 'erhöhter Pflegegrundwert'").first().wert == 1123.25


def test_row_order_survives_splits(spark, tmp_path):
    body = "".join(f"{i};1;2;3;4;5;01.02.2024 08:00;02.02.2024 08:00;IN1;x\n" for i in range(20_000))
    path = write(tmp_path, "long.csv", STAYS.splitlines()[0] + "\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(os.path.getsize(path) // 9))
    try:
        stays = delimited.read_stays(spark, path)
        assert stays.rdd.getNumPartitions() > 8
        assert [int(r.pid) for r in stays.orderBy("ord").select("pid").collect()] == list(range(20_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_large_cases_from_files(spark, tmp_path):
    """The order key of files also cuts large cases."""
    folder = tmp_path
    whole = Staffing(inputs_from(spark, folder))
    from pflegetakt import Settings

    cut = Staffing(inputs_from(spark, folder), Settings(max_case_days=2))
    assert cut.filled.filter("piece is not null").count() > 0
    names = ["tag", "ward", "code", "gesamtwert", "nachts_da"]
    assert rows(cut.weighted, *names) == rows(whole.weighted, *names)


def test_missing_columns_are_named(spark, tmp_path):
    path = write(tmp_path, "w.csv", "Station;Betten\nCH1;3\n")
    with pytest.raises(MissingColumns, match="Kategorie.*nachtdienst_quote"):
        delimited.read_wards(spark, path)
    with pytest.raises(MissingColumns, match="number 9"):
        delimited.read_stays(spark, path)
    with pytest.raises(MissingColumns, match="stays.*ord"):
        inputs = hospital(spark).inputs
        Inputs(inputs.stays.drop("ord"), *[getattr(inputs, n) for n in ("classifications", "controls", "wards", "newborns")])
    with pytest.raises(MissingColumns, match="newborns"):
        Inputs(inputs.stays, inputs.classifications, inputs.controls, inputs.wards, None)


def test_export(spark, tmp_path):
    run = hospital(
        spark,
        [stay("p", "f", "IN1", "2024-02-01", "2024-02-02", 1)],
        night=[(0.0, 1.0, 2.0, 3.0)],
    )
    folder = run_folder(str(tmp_path / "out"), dt.datetime(2024, 3, 1, 7, 8, 9))
    assert folder.endswith("/run_ts=2024-03-01_07-08-09")
    for _ in range(2):  # a second run replaces the first
        export_reports(spark, run, folder, controls=True)
    names = {"ppr_ergebnis", "ppr_bericht", "fehlende_daten", "personalbedarf_station_monat", "Steuerung", "Nachtdienst"}
    checks = {"check_stays", "check_newborns", "rejected_stays", "long_stays", "rejected_newborns", "split_wards"}
    assert set(os.listdir(folder)) == names | checks
    for name in names | checks:
        stored = read_report(spark, folder, name)
        text = spark.read.csv(f"{folder}/{name}/csv", sep=";", header=True)
        assert text.count() == stored.count()
        if name in names | {"check_stays", "check_newborns"}:
            assert text.columns == stored.columns
            assert stored.count() > 0
    assert rows(read_report(spark, folder, "ppr_bericht"), "Schicht", "Anzahl_Patienten") == [
        ("Nacht", 1),
        ("Tag", 2),
    ]
    assert read_report(spark, folder, "Steuerung").agg(F.count("wert")).first()[0] == 8


def test_quotes_backslashes_and_quoted_empties(spark, tmp_path):
    path = write(tmp_path, "q.csv", 'a;b;c\n"x ""y"" z";"end\\";1\n"";"p;q";\n"NA";NA;2\n')
    read = delimited.scan_delimited(spark, path).collect()
    assert [tuple(r) for r in read] == [('x "y" z', "end\\", "1"), (None, "p;q", None), (None, None, "2")]


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path, "m.csv", 'a;b\n"one\ntwo";1\nthree;2\n')
    read = delimited.scan_delimited(spark, path, with_order=True, multiline=True).orderBy("ord").collect()
    assert [(r.a, r.b) for r in read] == [("one\ntwo", "1"), ("three", "2")]


def messy_records(seed, number):
    rng = random.Random(seed)
    parts = ["a", "ä", "; ", "\n", "\n\n", '"', "x" * 30, "\\"]
    return [["".join(rng.choice(parts) for _ in range(rng.randrange(7))), f"z{i}"] for i in range(number)]


@pytest.mark.parametrize("seed,split", [(1, 64), (2, 300), (3, 1_000_000)])
def test_records_with_line_breaks_do_not_depend_on_splits(spark, tmp_path, seed, split):
    """Blocks that begin inside quotes, and records of several blocks."""
    written = messy_records(seed, 150)
    folder = tmp_path / "many"
    folder.mkdir()
    for part in range(2):
        text = io.StringIO()
        csv.writer(text, delimiter=";", lineterminator="\n").writerows([["t", "n"], *written[part::2]])
        write(folder, f"part{part}.csv", text.getvalue(), "latin-1")
    expected = [(t or None, n) for part in range(2) for t, n in written[part::2]]
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        read = delimited.scan_delimited(spark, str(folder), "ISO-8859-1", with_order=True, multiline=True)
        blocks = numbered_lines(spark, str(folder)).select("path", "block").distinct().count()
        got = [(r.t, r.n) for r in read.orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    assert got == expected
    assert blocks == 2 if split == 1_000_000 else blocks > 10


def test_line_ends_empty_files_and_open_quotes(spark, tmp_path):
    path = write(tmp_path, "crlf.csv", 'a;b\r\n"one\ntwo";1\r\n\r\n"";2\r\n')
    read = delimited.scan_delimited(spark, path, with_order=True, multiline=True).orderBy("ord").collect()
    assert [(r.a, r.b) for r in read] == [("one\ntwo", "1"), (None, "2")]
    assert delimited.scan_delimited(spark, write(tmp_path, "none.csv", "a;b\n"), multiline=True).count() == 0
    text = 'a;b\n"never closed;1\n' + "x;2\n" * 30
    with pytest.raises(Exception, match="a quote is not closed"):
        quoted_records(spark, write(tmp_path, "open.csv", text), most_lines=20).collect()


READ = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", sys.argv[2]).config("spark.eventLog.compress", "false")
         .config("spark.driver.host", "127.0.0.1").getOrCreate())
sys.path.insert(0, sys.argv[1])
from pflegetakt.sources.delimited import scan_delimited
read = scan_delimited(spark, sys.argv[3], multiline=True)
print(tuple(read.agg(F.count("n"), F.sum("n"), F.sum(F.length("t"))).first()))
"""


def test_records_of_large_blocks_need_little_memory(tmp_path):
    """One block of a million lines; its records are not sorted, shuffled or held, and tasks need no package."""
    number = 250_000
    folder = tmp_path / "log"
    folder.mkdir()
    path = write(tmp_path, "large.csv", "t;n\n" + "".join(f'"a\n""b"";\n\nc";{i}\n' for i in range(number)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", READ, repo, str(folder), path], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert str((number, number * (number - 1) / 2, 9 * number)) in done.stdout
    events = [json.loads(line) for log in folder.rglob("events*") if log.is_file() for line in log.open()]
    metrics = [e["Task Metrics"] for e in events if e["Event"] == "SparkListenerTaskEnd"]
    assert max(m["Peak Execution Memory"] for m in metrics) < 150e6
    assert sum(m["Shuffle Write Metrics"]["Shuffle Bytes Written"] for m in metrics) < 1e5


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_records_do_not_depend_on_batches(spark, tmp_path, size):
    """Records and blocks may end anywhere in a batch of lines; empty lines and open records at the end stay."""
    rows = [(t, n) for t, n in messy_records(size, 60)]
    text = io.StringIO()
    csv.writer(text, delimiter=";", lineterminator="\n").writerows([["t", "n"], *rows])
    path = write(tmp_path, "b.csv", text.getvalue() + '"open\n\n')
    usual = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for key, value in zip(usual, (211, size), strict=True):
        spark.conf.set(key, value)
    try:
        read = delimited.scan_delimited(spark, path, with_order=True, multiline=True)
        got = [(r.t, r.n) for r in read.orderBy("ord").collect()]
        records = quoted_records(spark, path).orderBy("path", "block", "row").collect()
    finally:
        for key, value in usual.items():
            spark.conf.set(key, value)
    assert got[:-1] == [(t or None, n) for t, n in rows]
    assert len(records) == len(rows) + 2 and records[-1].record == '"open\n'


def test_quoted_ward_does_not_count(spark, tmp_path):
    text = STAYS.replace("02.02.2024 08:00;NA;x", '02.02.2024 08:00;"";x')
    assert text != STAYS
    stays = delimited.read_stays(spark, write(tmp_path, "s.csv", text))
    assert [r.ward for r in stays.orderBy("ord").collect()] == ["CH1", "IN1", "IN1", "IN1", None]
