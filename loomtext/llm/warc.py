"""Content-addressed WARC archive.

Every page becomes one WARC/1.1 record. Payload bytes are stored once, in a table keyed by their SHA-256 digest; record
headers are kept exactly as written in a table of their own; records are rebuilt by joining the two. On reading, every
payload's SHA-256 is computed again and compared with its key, and the header's SHA-1 and length with the payload.

Of rows with equal payloads of at least ``least`` bytes the one with the largest page_id is the response and the others
are revisits that name it; smaller payloads are all responses. Equal page_ids among those with the largest one are all
responses. Null html is an empty payload, a null url an empty target; a null page_id sorts below all others. A payload of
any length is one value; an empty table gives empty archives; other columns are not read, so their names cannot clash.

Copies collapse by partial aggregation of a digest before any exchange of payload bytes; the joins are plain equi-joins
that Spark can split where one payload has very many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import stored, table

LEAST = 1000
#: A fixed archive date, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def header_text(kind: Column, page_id: Column, url: Column, sha1: Column, size: Column, refers: Column) -> Column:
    """The record header up to and with its blank line; line breaks in a url are percent-encoded."""
    uri = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    page = F.coalesce(page_id.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(kind == "revisit", F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers.cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(size.cast("string"))),
        F.lit(CRLF),
    )


def field(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def write_archive(pages: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) as stored: headers (page_id, sha256, header), payloads (sha256, payload)."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha256", F.sha2("payload", 256))
    payloads = stored(p.groupBy("sha256").agg(F.max("payload").alias("payload")), "warc-payloads")
    light = p.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    first = light.where(F.col("size") >= least).groupBy("sha256").agg(F.max("page_id").alias("response"))
    light = light.join(first, "sha256", "left")
    kind = F.when((F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("response")), F.lit("revisit")).otherwise(F.lit("response"))
    light = light.withColumn("kind", kind)
    headers = light.select("page_id", "sha256", header_text(F.col("kind"), F.col("page_id"), F.col("url"), F.col("sha1"), F.col("size"), F.col("response")).alias("header"))
    return stored(headers, "warc-headers"), payloads


def read_records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, record, sha256): the bytes of every record, a response with its payload, a revisit without."""
    kind = field(F.col("header"), "WARC-Type")
    tail = F.lit(CRLF + CRLF).cast("binary")
    whole = headers.where(kind == "response").join(payloads, "sha256").select("page_id", F.concat(F.col("header").cast("binary"), "payload", tail).alias("record"), "sha256")
    return whole.unionByName(headers.where(kind == "revisit").select("page_id", F.concat(F.col("header").cast("binary"), tail).alias("record"), "sha256"))


def restore(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, url, payload) of every page, revisits with the bytes of the response they name."""
    return headers.join(payloads, "sha256").select("page_id", field(F.col("header"), "WARC-Target-URI").alias("url"), "payload")


def parse_records(records: DataFrame) -> DataFrame:
    """What each record says and holds: page_id, record_type, refers_to, sha1, block and whether its digests agree."""
    cut = F.locate(CRLF + CRLF, F.decode("record", "ISO-8859-1"))
    r = records.withColumn("_cut", cut)
    r = r.withColumn("_head", F.decode(F.substring(F.col("record"), F.lit(1), F.col("_cut") + 3), "UTF-8"))
    r = r.withColumn("_n", F.octet_length("record") - F.col("_cut") - 3 - 4)
    r = r.withColumn("block", F.substring(F.col("record"), F.col("_cut") + 4, F.col("_n")))
    r = r.withColumn("record_type", field(F.col("_head"), "WARC-Type"))
    r = r.withColumn("sha1", F.regexp_replace(field(F.col("_head"), "WARC-Payload-Digest"), "^sha1:", ""))
    number = lambda name: F.regexp_extract(field(F.col("_head"), name), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    sound = (F.col("_n") == field(F.col("_head"), "Content-Length").try_cast("long")) & ((F.col("record_type") == "revisit") | ((F.sha1("block") == F.col("sha1")) & (F.sha2("block", 256) == F.col("sha256"))))
    return r.select(number("WARC-Record-ID").alias("page_id"), "record_type", number("WARC-Refers-To").alias("refers_to"), "sha1", "block", "sha256", sound.alias("sound"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, payloads = write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    records = parse_records(read_records(headers, payloads))
    ok = F.when(F.col("sound"), F.octet_length("block").cast("long")).otherwise(F.raise_error(F.lit("a record's digest or length does not agree")).cast("long"))
    read = records.select("page_id", "record_type", "refers_to", "sha1", "sha256", ok.alias("bytes"))
    # A revisit's payload is that of the response it names.
    named = read.where("record_type = 'response'").groupBy(F.col("sha256").alias("_sha256")).agg(F.max("bytes").alias("_bytes"))
    revisits = read.where("record_type = 'revisit'").join(named, F.col("sha256") == F.col("_sha256"))
    both = read.where("record_type = 'response'").withColumn("_bytes", F.col("bytes")).unionByName(revisits.drop("_sha256"))
    return both.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")


OP10_SQL = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM p LEFT JOIN m USING (h)
"""
QUERIES = {"op10_warc": op10_warc}
ORACLES = {"op10_warc": OP10_SQL}
