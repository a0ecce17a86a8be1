"""A content-addressed WARC archive.

Two tables: ``payloads`` holds every payload's bytes once under its SHA-256,
``records`` the exact header bytes of every record and the key of its payload.
Reading joins them, checks each stored payload against its key, and can
rebuild the records as they stand in a WARC file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import keep

# The RFC 4648 base32 alphabet and the WARC 1.1 revisit profile.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are eight groups of five hex digits, four base32 digits each."""
    digits = F.sha1(payload)

    def group(g: Column) -> Column:
        n = F.conv(F.substr(digits, g * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substr(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), group), "")


def _record_id(*parts: Column) -> Column:
    """A stable urn:uuid made from a digest of the parts."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _header(lines: list[tuple[str, Column]]) -> Column:
    """WARC header bytes; a null value leaves its line out, line ends inside values are escaped."""
    out = [F.lit("WARC/1.1")]
    for name, value in lines:
        clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
        out.append(F.concat(F.lit(f"{name}: "), clean))
    return F.encode(F.concat(F.concat_ws(CRLF, *out), F.lit(CRLF)), "UTF-8")


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row under ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest id is the response and the others revisit it; shorter ones
    are all responses (their payload is stored once all the same).  A null
    payload is empty; a null url has no target line; null ids rank last; of
    repeated rows with the smallest id one is the response.
    """
    spark = df.sparkSession
    payload = F.encode(F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")), "UTF-8")
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    src = src.withColumn("key", F.unhex(F.sha2("payload", 256)))
    light = keep(spark, src.select("id", "url", "key", F.octet_length("payload").cast("long").alias("bytes"),
                                   base32_sha1(F.col("payload")).alias("digest")), "warc-index")
    same_row = Window.partitionBy("id", "key").orderBy("url")
    light = light.withColumn("copy", F.row_number().over(same_row))
    first = light.groupBy("key").agg(F.min("id").alias("first_id"))
    rec = light.join(first, "key")
    response = (F.col("bytes") < min_bytes) | (F.col("id").eqNullSafe(F.col("first_id")) & (F.col("copy") == 1))
    rec = rec.withColumns({"response": response, "record_id": _record_id(F.col("id"), F.col("copy"), F.hex("key")),
                           "of": _record_id(F.col("first_id"), F.lit(1), F.hex("key"))})
    revisit = F.when(~F.col("response"), F.lit(True))
    header = _header([
        ("WARC-Type", F.when(F.col("response"), F.lit("response")).otherwise(F.lit("revisit"))),
        ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(REVISIT))),
        ("WARC-Refers-To", F.when(revisit, F.col("of"))),
        ("Refers-To-Key", F.when(revisit, F.col("first_id").cast("string"))),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(F.col("response"), F.col("bytes")).otherwise(F.lit(0)).cast("string")),
    ])
    rec.select("id", "key", header.alias("header")).write.mode("overwrite").parquet(f"{path}/records")

    # joined on (id, key): the rows of a payload that many records share are spread by their ids
    stored = src.select("id", "key", "payload").join(first.select(F.col("first_id").alias("id2"), F.col("key").alias("key2")),
                                                     (F.col("key") == F.col("key2")) & F.col("id").eqNullSafe(F.col("id2")))
    stored = stored.select("key", "payload")
    if not light.where("copy > 1").isEmpty():
        stored = stored.dropDuplicates(["key"])
    stored.write.mode("overwrite").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: id, header, record_type, refers_to (string), declared_digest, payload_bytes, payload_digest, payload, verified.

    ``verified`` is true where the stored bytes have the SHA-256 they are
    stored under and the SHA-1 the header declares.  Sizes and digests are
    taken from the stored bytes before the join, so a reader that does not
    select the payload does not move it.
    """
    store = spark.read.parquet(f"{path}/payloads").select(
        "key", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"), (F.unhex(F.sha2("payload", 256)) == F.col("key")).alias("sound"))
    head = F.decode("header", "UTF-8")

    def line(name: str) -> Column:
        got = F.regexp_extract(head, rf"(?m)^{name}: ([^\r\n]*)", 1)
        return F.when(got != "", got)

    rec = spark.read.parquet(f"{path}/records").select(
        "id", "key", "header", line("WARC-Type").alias("record_type"), line("Refers-To-Key").alias("refers_to"),
        F.substring_index(line("WARC-Payload-Digest"), ":", -1).alias("declared_digest"))
    both = rec.join(store, "key", "left")
    return both.select("id", "header", "record_type", "refers_to", "declared_digest", "payload_bytes", "payload_digest", "payload",
                       F.coalesce(F.col("sound") & (F.col("declared_digest") == F.col("payload_digest")), F.lit(False)).alias("verified"))


def record_bytes(read: DataFrame) -> DataFrame:
    """id, record: the bytes of each record as a WARC file has them (a revisit has no block)."""
    end = F.encode(F.lit(CRLF), "UTF-8")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return read.select("id", F.concat("header", end, block, end, end).alias("record"))


def archive_pages(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_bytes: int = 0) -> DataFrame:
    """Write the archive and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Fails when a payload is missing or does not verify.  Empty table: empty result.
    """
    spark = df.sparkSession
    write_archive(df, path, id_col, url_col, payload_col, min_bytes)
    id_type = df.schema[id_col].dataType.simpleString()
    sound = F.when(F.col("verified"), F.col("record_type")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not verify for record "), F.coalesce(F.col("id").cast("string"), F.lit("null")))))
    return read_archive(spark, path).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", sound.cast("string").alias("record_type"),
        F.col("refers_to").cast(id_type).alias("refers_to"))
