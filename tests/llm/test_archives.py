"""Archives: round trips, magic inside payloads, broken chains, byte ranges."""

import hashlib

import pytest

from oracle import compare, connect
from pflegetakt.llm import archives
from pflegetakt.llm.common import new_folder
from pflegetakt.llm.queries import ORACLE, QUERIES


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert compare(QUERIES["op9_warc"](spark, sf_dir), connect(sf_dir), ORACLE["op9_warc"]) == ""


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
BODIES = [
    None,
    "",
    "short",
    "short",
    "é" * 60,
    "é" * 60,
    "é" * 60,
    f"before{FAKE}after" + "z" * 100,
    FAKE * 3 + "WARC/1.1\r\n",
    "ends with the magic WARC/1.1\r\n",
    "\r\n\r\n",
    "WARC/1.1\r\n" * 40,
    "long " * 100_000,
]


@pytest.fixture(params=["128m", "40001"])
def ranges(spark, request):
    """Whole files, and byte ranges that cut through headers and magics."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], request.param)
    spark.conf.set(names[1], "1")
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def test_round_trip(spark, ranges):
    pages = [(i * 3 + 1, f"http://x/{i}\r\nContent-Length: 1", b) for i, b in enumerate(BODIES)] + [(None, None, "é" * 60), (100, None, None), (100, None, None)]
    frame = spark.createDataFrame([(*p, "clash", 5) for p in pages], "page_id long, url string, html string, id string, offset int")
    got = archives.round_trip(frame, "page_id", "url", "html").collect()
    assert len(got) == len(pages)
    first = {}
    for i, _, body in pages:
        if i is not None and len((body or "").encode()) >= 100:
            first[body] = min(first.get(body, i), i)
    wanted = []
    for i, _, body in pages:
        body = body or ""
        raw = body.encode()
        again = body in first and first[body] != i
        wanted.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[body] if again else None, None if again else body))
    rows = [(r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"]) for r in got]
    assert sorted(rows, key=repr) == sorted(wanted, key=repr)
    assert archives.round_trip(frame.limit(0), "page_id", "url", "html").count() == 0


def test_only_the_chain_from_the_start_counts(spark):
    good = "WARC/1.1\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    broken = "WARC/1.1\r\nContent-Length: 7\r\n\r\nhi\r\n\r\n"
    files = [good * 3, good + broken + good, "junk" + good, good + "junk" + good, broken, "", "WARC/1.1\r\nno end", good + FAKE]
    path = new_folder(spark, "archives")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    for i, text in enumerate(files):
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{i}.warc"))
        out.write(bytearray(text.encode()))
        out.close()
    counts = {}
    for r in archives.read_archives(spark, path).collect():
        counts.setdefault(int(r["file"].rsplit("/", 1)[1][0]), []).append(r["payload"])
    assert counts == {0: ["hi"] * 3, 1: ["hi", "hi\r\n\r\nW"], 3: ["hi"], 4: ["hi\r\n\r\n"], 7: ["hi", "abc"]}


def test_pointer_jumping_follows_long_chains(spark):
    links = [("f", i, i + 1) for i in range(100)] + [("f", 500, 501), ("f", 501, 500), ("g", 3, 4), ("h", 0, 0)]
    frame = spark.createDataFrame(links, "file string, offset long, next long")
    got = sorted((r["file"], r["offset"]) for r in archives.reachable(frame).collect())
    assert got == [("f", i) for i in range(100)]


@pytest.mark.parametrize("cores", [(1, 64), (64, 1)])
def test_scans_may_be_cut_differently(spark, cores):
    """More or fewer cores between the scans, as when executors come or go: splits and numbers change, records do not."""
    names = ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n, None) for n in names]
    bodies = [*BODIES[:12], BODIES[11], *("page %d " % i * 500 for i in range(60))]
    pages = [(i, "http://x", b) for i, b in enumerate(bodies)] + [(100, None, FAKE * 30 + "x" * 60_000)] * 3 + [(200, None, None)] * 5
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    try:
        spark.conf.set(names[1], "1")
        spark.conf.set(names[0], cores[0])
        back = archives.round_trip(frame, "page_id", "url", "html")
        spark.conf.set(names[0], cores[1])
        got = back.collect()
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    assert sorted(r["id"] for r in got) == sorted(p[0] for p in pages)
    raw = {i: (b or "").encode() for i, _, b in pages}
    for r in got:
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw[r["id"]]), hashlib.sha256(raw[r["id"]]).hexdigest())
        if r["record_type"] == "response":
            assert r["payload"].encode() == raw[r["id"]]


def test_records_that_a_scan_misses_are_an_error(spark, monkeypatch):
    whole = archives._contents
    monkeypatch.setattr(archives, "_contents", lambda scan, places, often: whole(scan.where("not value like '%page 7 %'"), places, often))
    frame = spark.createDataFrame([(i, "http://x", f"page {i} ") for i in range(9)], "page_id long, url string, html string")
    with pytest.raises(RuntimeError, match="8, 0.*9, 0"):
        archives.round_trip(frame, "page_id", "url", "html")
