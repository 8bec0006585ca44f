"""Site-relative line removal."""

from pyspark.sql import functions as F

from oracle import compare, connect
from pflegetakt.llm import lines
from pflegetakt.llm.queries import ORACLE, QUERIES


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert compare(QUERIES["op2_line_dedup"](spark, sf_dir), connect(sf_dir), ORACLE["op2_line_dedup"]) == ""


PAGES = [(i, "a.org", f"Home\nown {i}\nHome") for i in range(6)] + [
    (6, "a.org", None),
    (6, "a.org", None),
    (None, "b.org", "Home"),
    (8, None, ""),
    (9, "b.org", "x\n" * 5000),
]


def kept(spark, rows, **options):
    frame = spark.createDataFrame(rows, "id long, host string, text string").withColumn("often", F.lit("clash")).withColumn("salt", F.lit("clash"))
    split = F.filter(F.split("text", "\n"), lambda x: x != "")
    return lines.drop_site_lines(frame, "id", F.col("host"), split, **options).collect()


def test_small_cases(spark):
    for limit in (200_000, 0):  # broadcast, and the way beyond
        rows = kept(spark, PAGES, ratio=0.5, min_pages=3, broadcast_rows=limit)
        assert len(rows) == len(PAGES)
        for r in rows:
            if r["host"] == "a.org":
                assert "Home" not in r["kept"]
                assert r["kept"] == ([f"own {r['id']}"] if r["lines"] else [])
            else:
                assert r["kept"] == r["lines"]  # too few pages for evidence


def test_ratio_is_exceeded_not_met(spark):
    rows = [(i, "h", "half" if i < 5 else "rest") for i in range(10)]
    assert all(r["kept"] == r["lines"] for r in kept(spark, rows, ratio=0.5))
    assert kept(spark, PAGES[:0]) == []


def test_hosts_and_lines(spark):
    frame = spark.createDataFrame([("HTTP://u:p@A.org:80/x?y", "<p>a<br>b</p><script>c</script><b>d</b> e"), (None, None)], "url string, html string")
    a, b = frame.select(lines.host_of(F.col("url")).alias("h"), lines.page_lines(F.col("html")).alias("l")).collect()
    assert (a["h"], a["l"]) == ("a.org", ["a", "b", "d e"])
    assert (b["h"], b["l"]) == ("", [])
