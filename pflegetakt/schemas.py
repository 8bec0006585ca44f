"""Column contracts of the input tables."""

from __future__ import annotations

# Column names the plans rely on.
REQUIRED = {
    "stays": ("pid", "case_id", "ward", "begin_ts", "end_ts", "ord"),
    "classifications": ("category", "code", "pid", "datum", "ord"),
    "controls": ("kategorie", "wert"),
    "wards": (
        "ward",
        "kategorie",
        "betten",
        "ausfall1",
        "ausfall2",
        "ausfall3",
        "nachtdienst_quote",
    ),
    "newborns": ("case_id", "birth", "discharge"),
    "night": ("patienten", "min_ex_net", "min_hilf_net", "min_ex_geb_net"),
}


class MissingColumns(ValueError):
    """An input lacks columns; the message names them."""


def require(table: str, present, needed) -> None:
    absent = [name for name in needed if name not in present]
    if absent:
        raise MissingColumns(f"{table}: missing columns {', '.join(absent)}")


def check_columns(inputs) -> None:
    """All inputs must be there before a run; only the night table may be absent."""
    for table, needed in REQUIRED.items():
        df = getattr(inputs, table)
        if df is None:
            if table == "night":
                continue
            raise MissingColumns(f"{table}: table is missing")
        require(table, df.columns, needed)
