"""Runs a registered query and its SQL on the same files and compares all rows."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=repr)


def compare(frame, connection, sql):
    """Empty text when equal, else the first difference."""
    names, got = _rows(frame.columns, [tuple(row) for row in frame.collect()])
    result = connection.execute(sql)
    wanted_names, wanted = _rows([c[0] for c in result.description], result.fetchall())
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if len(got) != len(wanted):
        return f"{len(got)} rows != {len(wanted)}"
    for left, right in zip(got, wanted):
        if left != right:
            return f"{left} != {right}"
        if [type(v) for v in left] != [type(v) for v in right]:
            return f"types of {left} != {right}"
    return ""
