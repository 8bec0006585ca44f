"""Literal input tables for one hospital; every table can be replaced."""

import datetime as dt

from pflegetakt import Inputs, Settings, Staffing

STAYS = "pid string, case_id string, ward string, begin_ts timestamp_ntz, end_ts timestamp_ntz, ord bigint"
CLASSIFICATIONS = "ord bigint, category string, code string, pid string, datum string"
CONTROLS = "kategorie string, wert double"
WARDS = (
    "ward string, kategorie string, betten double, ausfall1 double, ausfall2 double, "
    "ausfall3 double, nachtdienst_quote double"
)
NEWBORNS = "case_id string, birth timestamp_ntz, discharge timestamp_ntz"
NIGHT = "patienten double, min_ex_net double, min_hilf_net double, min_ex_geb_net double"

RATES = [
    ("A1", 60.0),
    ("A2", 95.0),
    ("Pflegegrundwert", 33.0),
    ("erhöhter Pflegegrundwert", 123.0),
    ("Aufnahme", 75.0),
    ("Entlassung", 0.5),
    ("Ausfallzeiten", 0.2),
    ("Anteil_Hilf", 0.8),
]
WARD_ROWS = [
    ("CH1", "Chirurgie", 20.0, 0.1, 0.05, 0.05, 50.0),
    ("CH3", "Chirurgie", 18.0, 0.1, 0.05, 0.05, 50.0),
    ("IN1", "Intensiv", 8.0, 0.15, 0.05, 0.05, 2.0),
    ("GB2", "Geburtshilfe", 15.0, 0.1, 0.04, 0.02, 20.0),
]


def at(text):
    """``2024-02-01`` or ``2024-02-01 10:00``."""
    return None if text is None else dt.datetime.fromisoformat(text)


def stay(pid, case_id, ward, begin, end, ord):
    return (pid, case_id, ward, at(begin), at(end), ord)


def classified(ord, pid, datum, code, category=None):
    return (ord, category or code, code, pid, datum)


def hospital(
    spark, stays=(), classifications=(), rates=RATES, wards=WARD_ROWS, newborns=(), night=(), **settings
):
    def frame(rows, schema):
        return spark.createDataFrame(list(rows), schema)

    inputs = Inputs(
        stays=frame(stays, STAYS),
        classifications=frame(classifications, CLASSIFICATIONS),
        controls=frame(rates, CONTROLS),
        wards=frame(wards, WARDS),
        newborns=frame([(c, at(b), at(d)) for c, b, d in newborns], NEWBORNS),
        night=frame(night, NIGHT),
    )
    return Staffing(inputs, Settings(**settings))


def rows(frame, *columns, order=None):
    order = order or columns[0]
    picked = frame.orderBy(*([order] if isinstance(order, str) else order)).select(*columns)
    return [tuple(row) for row in picked.collect()]
