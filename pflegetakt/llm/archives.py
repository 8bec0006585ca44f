"""WARC archives: written by Spark, read back in byte ranges, verified by their boundary chain.

Text files with a record's first line as line separator make Spark cut archives wherever the
magic occurs, also inside payloads. Each cut is a candidate record; its header gives the offset
of the record that should follow. Only candidates that pointer jumping reaches from the file's
start are records. A record's bytes are then put together from the pieces it covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, small_side, stored

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILE_RECORDS = 4096
"""Records of one file at most; longer parts are written as several files."""


def deduplicated(
    pages: DataFrame, id_col: str, payload: Column, least_bytes: int = 100, carry: list[str] | None = None
) -> DataFrame:
    """(id, carried columns, payload, payload_bytes, payload_digest, record_type, refers_to) of every row.

    Of equal payloads of `least_bytes` or more, the row with the least id is the response and the
    others revisit it; smaller ones all are responses. Null payloads are empty. Rows without an
    id are responses of their own unless a row with an id has their payload; of rows equal in id
    and payload each is a response if one is. Groups are found from narrow rows, combined before
    the shuffle; where they are few, payloads are not shuffled at all, else a payload that a
    third of the rows share meets one row, which Spark splits.
    """
    content = F.coalesce(payload, F.lit(""))
    carry = carry or []
    rows = pages.select(F.col(id_col).alias("id"), *carry, content.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    narrow = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    shared = stored(narrow.where("n > 1 and first is not null").select("payload_digest", "first"), "payloads")
    joined = rows.join(small_side(shared), "payload_digest", "left")
    again = (F.col("payload_bytes") >= least_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select(
        "id",
        *carry,
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def _clean(value: Column) -> Column:
    """One header line's worth of a value."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " ")


def record_text(uri: Column) -> Column:
    """A record without its closing blank lines. Revisits have no block, as their payload stands elsewhere."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(""))
    name = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    fields = [
        (F.lit("WARC-Type"), F.col("record_type")),
        (F.lit("WARC-Record-ID"), F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        (F.lit("WARC-Target-URI"), _clean(uri)),
        (F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        (F.lit("WARC-Payload-Length"), F.col("payload_bytes").cast("string")),
        (F.lit("WARC-Refers-To"), F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        (F.lit("WARC-Profile"), F.when(F.col("record_type") == "revisit", F.lit(REVISIT_PROFILE))),
        (F.lit("Content-Type"), F.lit("text/html; charset=utf-8")),
        (F.lit("Content-Length"), F.octet_length(block).cast("string")),
    ]
    # a null value leaves its line out
    lines = [F.concat(k, F.lit(": "), v, F.lit("\r\n")) for k, v in fields]
    return F.concat(F.lit(MAGIC), F.concat_ws("", *lines), F.lit("\r\n"), block)


def write_archives(records: DataFrame, uri: Column, path: str) -> None:
    """Writes one or more uncompressed archives a partition; every file begins with a record."""
    body = records.select(record_text(uri).alias("value"))
    body.write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, value): archives cut at every magic; byte ranges are read by different tasks.

    The pieces of a file are the same in every scan. `block` and `seq` order them within one scan
    only: Spark cuts and packs files by the cores it has at that time.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )


def _digest(value: str) -> Column:
    """What a piece is known by in every scan: SHA-256 of its bytes."""
    return F.unhex(F.sha2(value, 256))


def _field(header: Column, name: str) -> Column:
    """A header field's value; null if it is missing."""
    found = F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.trim(found))


def pieces(scan: DataFrame) -> DataFrame:
    """(file, digest, offset, held, header, length): every piece's place and what its header says.

    `offset` is that of the piece's magic, `held` its bytes, `digest` names its content in any
    other scan; header and length are null where
    there is no header's end or no length. A byte range's first piece begins where the range
    before it ended, so offsets are sums of sizes: within a range by a window, over a file's
    ranges by another with one row a range. Payloads stay out of the shuffle.
    """
    end = F.instr("value", END)
    header = F.when(end > 0, F.substring("value", F.lit(1), end - 1))
    size = _field(header, "Content-Length")
    length = F.when(size.rlike("^[0-9]{1,9}$"), size.cast("long"))
    held = F.octet_length("value").cast("long").alias("held")
    own = scan.select("file", "block", "seq", _digest("value").alias("digest"), held, header.alias("header"), length.alias("length"))
    own = stored(own.withColumn("header", F.when(F.col("length").isNotNull(), F.col("header"))), "pieces")
    blocks = own.groupBy("file", "block").agg(F.sum(F.col("held") + len(MAGIC)).alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("inner", F.coalesce(F.sum(F.col("held") + len(MAGIC)).over(within), F.lit(0))).join(bases, ["file", "block"])
    return placed.withColumn("offset", F.col("base") + F.col("inner") - len(MAGIC)).drop("block", "seq", "base", "inner")


def candidates(cut: DataFrame) -> DataFrame:
    """(file, digest, offset, held, header, length, next): pieces that could be records, by their own headers.

    `next` is the offset of the record that should follow, always a later one.
    """
    own = cut.where((F.col("offset") >= 0) & F.col("length").isNotNull())
    return own.withColumn("next", F.col("offset") + len(MAGIC) + F.octet_length("header") + 2 * len(END) + F.col("length"))


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) of candidates that a chain of `next` offsets reaches from a file's offset 0.

    Pointer jumping: each round doubles the length of every pointer, and marks what marked
    candidates point to. So a chain of n records takes log2(n) rounds. Pointers that do not lead
    forward are dropped. Links and marks are written to the shared folder each round.
    """
    links = links.where(F.col("next") > F.col("offset"))
    known = stored(links.select("file", "offset"), "known")
    jumps = links.select("file", "offset", "next").join(known.select("file", F.col("offset").alias("next")), ["file", "next"], "left_semi")
    jumps = stored(jumps.select("file", "offset", "next"), "jumps")
    marked = stored(known.where("offset = 0"), "marked")
    while jumps.limit(1).count():
        hit = jumps.join(marked, ["file", "offset"], "left_semi").select("file", F.col("next").alias("offset"))
        marked = stored(marked.unionByName(hit).distinct(), "marked")
        far = jumps.select("file", F.col("offset").alias("next"), F.col("next").alias("far"))
        jumps = stored(jumps.join(far, ["file", "next"]).select("file", "offset", F.col("far").alias("next")), "jumps")
    return marked


def _payload(value: Column) -> Column:
    """The block of a record's bytes, from header length and block length."""
    at = F.octet_length("header") + len(END) + 1
    return F.substring(value.cast("binary"), at.cast("int"), F.col("length").cast("int")).cast("string")


def _contents(scan: DataFrame, places: DataFrame, often: DataFrame) -> DataFrame:
    """Columns of the stored `places` (file, digest, ...) and value: each place once, its bytes from a new scan.

    Pieces are found by file and content, which no cutting by Spark changes. Contents that a file
    has several times (`often`) are brought down to one before they meet their places.
    """
    key = ["file", "digest"]
    scan = scan.select("file", _digest("value").alias("digest"), "value")
    again = stored(often.join(places, key, "left_semi"), "again")
    if not again.limit(1).count():
        return scan.join(small_side(places), key)
    once = scan.join(small_side(stored(places.join(again, key, "left_anti"), "once")), key)
    copies = scan.join(small_side(again), key, "left_semi").groupBy(*key).agg(F.first("value").alias("value"))
    return once.unionByName(copies.join(places, key))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, header, payload) of every verified record of all archives below `path`.

    Payloads (of under 1 GB) are read as UTF-8. Empty files have no record; bytes that no chain
    reaches from a file's start, such as what follows a broken length, are not read as records.
    A first scan places the pieces; a second takes the payloads of records that lie in one piece,
    and joins the pieces of those whose payload holds the magic, in order of offset. Scans are
    matched by file and content, so executors may come and go between them; it fails if they do
    not give all records and parts.
    """
    scan = _scan(spark, path)
    place = ["file", "digest"]
    cut = stored(pieces(scan), "cut")
    found = candidates(cut)
    good = stored(found.join(reachable(found.select("file", "offset", "next")), ["file", "offset"], "left_semi"), "records")
    often = stored(cut.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1").select(*place), "often")
    complete = F.col("held") >= F.octet_length("header") + len(END) + F.col("length")
    whole = stored(good.where(complete).select(*place, "offset", "header", "length"), "whole")
    whole = _contents(scan, whole, often).select("file", "offset", "header", _payload(F.col("value")).alias("payload"))

    # the rest: find the pieces that lie inside each record, from narrow rows of such files only
    split = stored(good.where(~complete).select("file", "offset", "header", "length"), "split")
    spots = cut.where("offset >= 0").select(*place, "offset").join(split.select("file").distinct(), "file", "left_semi")
    spots = spots.join(good.select("file", "offset", F.col("offset").alias("record")), ["file", "offset"], "left")
    upto = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = spots.withColumn("record", F.last("record", ignorenulls=True).over(upto))
    owned = owned.join(split.select("file", F.col("offset").alias("record")), ["file", "record"], "left_semi")
    owned = stored(owned.select(*place, "offset", "record"), "owned")
    parts = _contents(scan, owned, often).select("file", F.col("record"), F.struct("offset", "value").alias("part"))
    joined = parts.groupBy("file", F.col("record").alias("offset")).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    full = joined.withColumn("value", F.array_join(F.col("parts.value"), MAGIC)).join(split, ["file", "offset"])
    records = whole.unionByName(full.select("file", "offset", "header", _payload(F.col("value")).alias("payload")))
    wanted = [good.count(), owned.count()]
    read = [records.count(), parts.count()]
    if read != wanted:
        raise RuntimeError(f"archives below {path} changed while they were read: {read} records and parts found again of {wanted}")
    return records


def page_records(records: DataFrame) -> DataFrame:
    """(id, payload, payload_bytes, payload_digest, record_type, refers_to) of read records.

    A response's size and digest are taken from its bytes, a revisit's from its header.
    """
    kind = _field(F.col("header"), "WARC-Type")
    number = r"^<urn:page:(-?[0-9]+)>$"

    def page(name: str) -> Column:
        found = F.regexp_extract(F.coalesce(_field(F.col("header"), name), F.lit("")), number, 1)
        return F.when(found != "", found.cast("long"))

    response = kind == "response"
    told = F.regexp_extract(F.coalesce(_field(F.col("header"), "WARC-Payload-Digest"), F.lit("")), "^sha256:(.*)$", 1)
    return records.select(
        page("WARC-Record-ID").alias("id"),
        F.when(response, F.col("payload")).alias("payload"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(_field(F.col("header"), "WARC-Payload-Length").cast("long")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(told).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(~response, page("WARC-Refers-To")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, id_col: str, url_col: str, payload_col: str, path: str | None = None) -> DataFrame:
    """Writes archives of all pages below `path` (else a folder of this run) and reads them back."""
    spark = pages.sparkSession
    path = path or new_folder(spark, "archives")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    write_archives(deduplicated(rows, "id", F.col("payload"), carry=["url"]), F.col("url"), path)
    return page_records(read_archives(spark, path))
