"""Lookups in the small control tables.

No broadcast hints here: Spark compares the known size of the table with
``spark.sql.autoBroadcastJoinThreshold`` and falls back to a shuffled join, which
AQE splits where it is skewed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def control_row(controls: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """One row with one struct ``control``: the value of every named key.

    Fails when a key is absent or occurs twice, whichever field is read.
    """
    named = {short: F.col("kategorie") == key for short, key in keys.items()}
    found = [F.count(F.when(test, 1)) == 1 for test in named.values()]
    values = [F.max(F.when(test, F.col("wert"))).alias(short) for short, test in named.items()]
    problem = F.concat(
        F.lit("control table needs exactly one row for each of: "), F.lit(", ".join(keys.values()))
    )
    complete = found[0]
    for test in found[1:]:
        complete = complete & test
    checked = F.when(complete, F.struct(*values)).otherwise(F.raise_error(problem))
    return controls.agg(checked.alias("control"))


def control_scalars(controls: DataFrame, keys: Mapping[str, str]) -> dict[str, Column]:
    """The same values as scalar subqueries, for use inside expressions."""
    row = control_row(controls, keys).scalar()
    return {short: row.getField(short) for short in keys}


def rate_lists(controls: DataFrame) -> DataFrame:
    """Minutes of each category of the control table, in its order.

    A category may stand there twice; a row of that category then counts once for each. Their order
    is that of the table's ``ord`` column, or by minutes where it has none.
    """
    order = ["ord"] if "ord" in controls.columns else []
    rows = F.sort_array(F.collect_list(F.struct(*order, "wert")))
    return controls.groupBy(F.col("kategorie").alias("rate_code")).agg(
        F.transform(rows, lambda row: row["wert"]).alias("rates")
    )


def rate_lookup(df: DataFrame, lists: DataFrame, code: Column, out: str) -> DataFrame:
    """Adds the list of minutes of a code; missing when there is none."""
    renamed = lists.withColumnRenamed("rates", out)
    return df.join(renamed, code.eqNullSafe(F.col("rate_code")), "left").drop("rate_code")


def merged_ward(ward: Column, merge: Mapping[str, str]) -> Column:
    """Ward after merging; a ward outside the mapping, or none, stays as it is."""
    expr = None
    for target in sorted(set(merge.values())):
        members = sorted(name for name, to in merge.items() if to == target)
        test = ward.isin(*members)
        expr = F.when(test, target) if expr is None else expr.when(test, target)
    return ward if expr is None else expr.otherwise(ward)
