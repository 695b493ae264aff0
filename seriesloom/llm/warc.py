"""WARC archives: written from pages, and read back by verifying the chain of record boundaries.

The line that begins a record may also stand inside a payload. So the archives are read in pieces
that end at that line, by tasks that know nothing of each other; each piece is a candidate record
and names where, by its own header, its successor begins. Pointer jumping from the start of each
file finds the candidates that the chain reaches; all others lie inside payloads and are joined
to the record that holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions.staging import drop_staged, new_path, staged
from seriesloom.llm.beside import beside

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
#: Payloads from this size on are written once and then referred to.
REVISIT_BYTES = 1000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _payload(text: Column) -> Column:
    return F.coalesce(text.cast("string").cast("binary"), F.lit("").cast("binary"))


def plan_records(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(id, url, html, digest, bytes, keeper): `keeper` is the id whose record holds the payload, null where that is the row itself."""
    body = _payload(F.col(html_col))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    large = staged(rows.where(F.col("bytes") >= REVISIT_BYTES).select("id", "digest", "bytes"), "digests")
    kept = large.groupBy("digest", "bytes").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(beside(kept, "kept"), ["digest", "bytes"], "left").withColumn("keeper", F.when(F.col("keeper") != F.coalesce("id", F.lit(-1)), F.col("keeper")))


def record_text(row_id: Column, url: Column, html: Column, digest: Column, size: Column, keeper: Column, date: str) -> Column:
    """A record without the two line ends that close it."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda i: F.concat(F.lit("<urn:page:"), i.cast("string"), F.lit(">"))
    revisit = keeper.isNotNull()
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(html))
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.coalesce(urn(row_id), F.lit("<urn:page:>"))),
        line("WARC-Target-URI", F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")),
        F.lit(f"WARC-Date: {date}\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Refers-To", urn(keeper)),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str, id_col="page_id", url_col="url", html_col="html", date: str = "2024-01-01T00:00:00Z", records: int = 100_000) -> None:
    """Writes a record for each row of `pages` to archives in the new folder `path`, of at most `records` records each.

    Of rows with equal payloads of at least REVISIT_BYTES, those of the largest id are responses and
    the others revisits without a payload that refer to it; where all these ids are null, all are
    responses. Null html is an empty payload; a null url gives no URI line; a null id an empty one.
    Each task writes what it reads: pages are not shuffled unless there are too many repeated
    payloads to broadcast their digests. No pages: no archives.
    """
    planned = plan_records(pages, id_col, url_col, html_col)
    text = record_text(*(F.col(c) for c in ("id", "url", "html", "digest", "bytes", "keeper")), date)
    planned.select(text.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, piece): what stands between two magic lines, in the order of a file's blocks and their rows."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("piece"))


def _head(piece: Column) -> Column:
    return F.when(F.instr(piece, END) > 0, F.substring_index(piece, END, 1))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, start, until, next): each candidate record, where its bytes end, and where its successor begins by its header.

    `row` counts a block's pieces from 1. What precedes a file's first magic line is the candidate of
    no record: its `start` is negative if it is empty, as it should be, and else null.
    """
    magic = len(MAGIC)
    head = _head(F.col("piece"))
    length = F.expr(r"try_cast(regexp_extract(head, '(?i)(?:^|\n)content-length: *([0-9]{1,18})\\s*(?:\r|\n|$)', 1) as bigint)")
    seen = _pieces(spark, path).select("file", "block", "seq", F.octet_length("piece").cast("long").alias("size"), head.alias("head"))
    seen = staged(seen.select("file", "block", "seq", "size", (F.octet_length("head") + len(END) + length + len(END)).alias("length")), "pieces")
    blocks = seen.groupBy("file", "block").agg(F.sum(F.col("size") + magic).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("seq")
    placed = seen.select("*", F.row_number().over(inside).alias("row"), F.coalesce(F.sum(F.col("size") + magic).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("done")).join(blocks, ["file", "block"])
    start = F.col("base") + F.col("done") - magic  # of the magic line before the piece
    return placed.select("file", "block", "row", F.when((start >= 0) | (F.col("size") == 0), start).alias("start"), (start + magic + F.col("size")).alias("until"), F.when(start >= 0, start + magic + F.col("length")).alias("next"))


def reachable(found: DataFrame) -> DataFrame:
    """`found` with `run` and `real`: whether the chain from its file's start reaches the candidate.

    Neighbours of a block that follow one another are one run, broken wherever a longer jump lands;
    pointers are jumped over runs, so the rounds grow with the logarithm of the runs in a file.
    """
    over = Window.partitionBy("file", "block").orderBy("row")
    rows = staged(found.where("start >= 0").withColumn("near", F.col("next").eqNullSafe(F.lead("start").over(over))), "chain")
    landed = rows.where(~F.col("near") & F.col("next").isNotNull()).select("file", F.col("next").alias("start"), F.lit(True).alias("landed")).distinct()
    broken = F.coalesce(F.col("landed"), F.lit(False)) | ~F.coalesce(F.lag("near").over(over), F.lit(False))
    rows = rows.join(landed, ["file", "start"], "left").withColumn("run", F.sum(F.when(broken, 1).otherwise(0)).over(over))
    rows = staged(rows.drop("landed", "near"), "runs")
    jump = rows.groupBy("file", "block", "run").agg(F.min("start").alias("at"), F.max_by("next", "row").alias("to")).select("file", "at", "to")
    jump = staged(jump, "jump")
    reached = staged(jump.where("at = 0").select("file", "at"), "reached")
    n = reached.count()
    while True:
        stepped = reached.join(jump, ["file", "at"]).where("to is not null").select("file", F.col("to").alias("at"))
        grown = staged(reached.union(stepped.join(jump.select("file", "at"), ["file", "at"], "left_semi")).distinct(), "reached")
        m = grown.count()
        drop_staged(reached)
        reached = grown
        if m == n:
            break
        n = m
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
        longer = staged(jump.join(far, ["file", "to"], "left").select("file", "at", F.col("further").alias("to")), "jump")
        drop_staged(jump)
        jump = longer
    heads = reached.select("file", F.col("at").alias("start"), F.lit(True).alias("hit"))
    runs = rows.join(heads, ["file", "start"], "left_semi").select("file", "block", "run", F.lit(True).alias("hit"))
    return rows.join(runs, ["file", "block", "run"], "left").withColumn("real", F.coalesce("hit", F.lit(False))).drop("hit")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, head, payload): the records of all archives in `path`, with the header lines and the payload of the HTTP message.

    A candidate inside a payload is no record. A file that doesn't begin with the magic line has no
    records; a chain that breaks off ends there. A record whose bytes end early keeps what there is.
    """
    found = staged(reachable(candidates(spark, path)), "candidates")
    # pieces inside payloads, with the record that holds each: the last one before that goes beyond its own piece
    holds = F.col("real") & (F.col("next") > F.col("until"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = found.where(~F.col("real") | holds).withColumn("holder", F.last(F.when(holds, F.struct(F.col("start").alias("record"), F.col("next").alias("end"))), ignorenulls=True).over(before))
    split = staged(held.where("start < holder.end").select("file", "block", "row", "start", "holder.record"), "within")
    other = found.where("not real or next is null").select("file", "block", "row").union(split.where("start = record").select("file", "block", "row"))
    # rows of a block are numbered as in `candidates`: the order of a task's rows is that of the file
    base = _pieces(spark, path)
    mixed_blocks = beside(other.select("file", "block").distinct(), "blocks")
    numbered = base.join(mixed_blocks, ["file", "block"], "left_semi").withColumn("row", F.row_number().over(Window.partitionBy("file", "block").orderBy("seq")))
    plain = base.join(mixed_blocks, ["file", "block"], "left_anti")
    plain = plain.join(beside(found.where("start = 0 and real").select("file").distinct(), "files"), "file", "left_semi").where(F.octet_length("piece") > 0).select("file", "piece")
    mixed = numbered.join(found.where("real and next <= until").select("file", "block", "row", "start"), ["file", "block", "row"]).select("file", "piece")
    parts = numbered.join(split, ["file", "block", "row"]).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", F.col("piece").cast("binary").alias("piece")))).alias("parts"))
    glued = F.array_join(F.transform("parts", lambda x: x["piece"].cast("string")), MAGIC)  # copies each piece once
    sewn = parts.select("file", glued.alias("piece"))
    records = plain.unionByName(mixed).unionByName(sewn).withColumn("head", _head(F.col("piece")))
    size = header(F.col("head"), "Content-Length").try_cast("int")
    block = F.expr(f"substring(cast(piece as binary), octet_length(head) + {len(END) + 1})")
    records = records.withColumn("body", F.substring(block, F.lit(1), size))
    http = F.substring_index(F.col("body").cast("string"), END, 1)
    payload = F.when(header(F.col("head"), "Content-Type").startswith("application/http"), F.expr(f"substring(body, octet_length(http) + {len(END) + 1})")).otherwise(F.col("body"))
    return records.withColumn("http", http).select("file", "head", payload.alias("payload"))


def header(head: Column, name: str) -> Column:
    """The value of a header line, or null."""
    return F.nullif(F.regexp_extract(head, rf"(?i)(?:^|\n){name}: *([^\r\n]*)", 1), F.lit(""))


def op2_warc_boundary_chain(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    number = lambda name: F.regexp_extract(header(F.col("head"), name), r"<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    named = F.regexp_extract(header(F.col("head"), "WARC-Payload-Digest"), "^sha1:([0-9a-f]{40})$", 1)
    read = read_archives(spark, path).select(number("WARC-Record-ID").alias("page_id"), header(F.col("head"), "WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"), named.alias("named"), F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("digest"))
    read = staged(read, "records")
    # one payload may be that of very many revisits, but the payloads referred to are few beside the records;
    # rows may repeat an id, so a payload is that of an id and a digest
    asked = read.where("refers_to is not null").select(F.col("refers_to").alias("keeper"), "named").distinct()
    responses = read.where("record_type = 'response'").select(F.col("page_id").alias("keeper"), F.col("digest").alias("named"), F.col("bytes").alias("full_bytes"))
    kept = beside(responses.join(asked, ["keeper", "named"]).groupBy("keeper", "named").agg(F.max("full_bytes").alias("full_bytes")), "referred")
    full = read.join(kept.withColumnRenamed("named", "full_digest"), (F.col("refers_to") == F.col("keeper")) & (F.col("named") == F.col("full_digest")), "left")
    return full.select("page_id", F.coalesce("full_bytes", "bytes").alias("payload_bytes"), F.coalesce("full_digest", "digest").alias("payload_digest"), "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, payload_bytes, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> p.page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (payload_digest, payload_bytes)
"""
