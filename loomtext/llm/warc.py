r"""WARC archives: written from a table of pages, read back, and put together again as captures.

A capture is a transaction of several records: the response (or a revisit, where an equal payload is in the archives already), the request that
fetched it and the metadata about it.  The other records name the response in ``WARC-Concurrent-To``, and ``captures`` joins them on these
identifiers into one nested row for each capture, wherever in the archives the records stand.

Archives are text files of Spark's own writer, compressed by gzip, as records of valid UTF-8 are valid text and a record's end is a
line separator.  They are read by Spark's text reader line by line, as bytes.  A compressed file goes to one task, which takes record after
record from its stream by their ``Content-Length``; it holds one record and one batch of lines at a time, so an archive may be of any size.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import by_value, lean, settled
from loomtext.llm.exact_dedup import _bitmap, _marked
from loomtext.session import shared_folder

EOL = "\r\n"
#: Pages of an archive at most.
PER_FILE = 50_000
MAIN = ("response", "revisit", "resource", "conversion")

_RECORD = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, content_type string, named_digest string, http string, body_bytes bigint, body_sha1 string, body binary"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a string's UTF-8 bytes in upper-case base32: five hexadecimal digits are four of base 32."""
    digest = F.sha1(payload)
    digits = F.concat(*(F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if i > 1 else ()) + (F.substring(h, i, n),)), F.lit(">"))


def _record(block: Column, fields: dict[str, Column]) -> Column:
    """A record without the empty lines that end it. Fields whose value is null are left out."""
    head = F.concat_ws(EOL, F.lit("WARC/1.1"), *(F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(EOL * 2), block)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The column ``value``: for each row of ``pages`` its response or revisit, its request and its metadata, as one text.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest id, then url, is the response and the others revisit
    it; smaller ones are all responses.  Only payloads that occur more than once are shuffled: digests are counted on narrow rows, and the
    repeated ones travel as a bitmap of at most 2 MB.

    * null html: an empty payload, equal to all other empty ones.  Null url: no target.  Null id: least of all, and no page id in the metadata.
    * rows that repeat an id and a payload: one is the response.  Rows equal in everything are told apart by their place in
      the table, so ``pages`` should be read from files.  Empty table: no rows.  Other columns are ignored, whatever their names.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.col(url_col).cast("string"), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), html.alias("html")).withColumn("at", F.monotonically_increasing_id())
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("bytes", F.octet_length("html").cast("long")).withColumn("key", F.xxhash64("digest"))
    top = F.max(F.struct("page_id", "url", "at")).alias("top")
    again = settled(rows.filter(F.col("bytes") >= min_bytes).groupBy("digest", "key").agg(top, F.count("*").alias("n")).filter("n > 1"))
    size = min(max((8 * again.count()).bit_length(), 15), 24)
    marked = _marked(rows, "key", _bitmap(again, "key", "_page", "_bits", size), "_page", "_bits", "_again", size)

    own = _urn(F.lit("response"), F.col("digest"), F.col("at"))
    alone = marked.filter("not _again").select("page_id", "url", "html", "at", "digest", "bytes", own.alias("id"), F.lit(None).cast("string").alias("refers_to"))
    met = marked.filter("_again").join(again.select(F.col("digest"), "top"), "digest", "left")
    first = F.col("top.at").isNull() | (F.col("top.at") == F.col("at"))
    refers_to = F.when(~first, _urn(F.lit("response"), F.col("digest"), F.col("top.at")))
    met = met.select("page_id", "url", "html", "at", "digest", "bytes", F.when(first, own).otherwise(_urn(F.lit("revisit"), F.col("digest"), F.col("at"))).alias("id"), refers_to.alias("refers_to"))
    rows = alone.unionByName(met)

    revisit = F.col("refers_to").isNotNull()
    common = {"WARC-Date": F.lit(date), "WARC-Target-URI": F.col("url")}
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL * 2))
    response = _record(
        F.when(revisit, head).otherwise(F.concat(head, F.col("html"))),
        {"WARC-Type": F.when(revisit, "revisit").otherwise("response"), "WARC-Record-ID": F.col("id"), **common, "WARC-Refers-To": F.col("refers_to"),
         "WARC-Profile": F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), "WARC-Payload-Digest": F.concat(F.lit("sha1:"), "digest"), "Content-Type": F.lit("application/http; msgtype=response")},
    )
    host, path = F.regexp_extract("url", "^[^:/?#]+://([^/?#]*)", 1), F.regexp_extract("url", "^[^:/?#]+://[^/?#]*([^#]*)", 1)
    get = F.concat(F.lit("GET "), F.when(F.coalesce(path, F.lit("")).startswith("/"), path).otherwise(F.concat(F.lit("/"), F.coalesce(path, F.lit("")))), F.lit(f" HTTP/1.1{EOL}Host: "), F.coalesce(host, F.lit("")), F.lit(EOL * 2))
    beside = lambda kind: {"WARC-Type": F.lit(kind), "WARC-Record-ID": _urn(F.lit(kind), F.col("digest"), F.col("at")), **common, "WARC-Concurrent-To": F.col("id")}
    request = _record(get, beside("request") | {"Content-Type": F.lit("application/http; msgtype=request")})
    about = F.concat_ws("", F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(EOL)))
    metadata = _record(about, beside("metadata") | {"Content-Type": F.lit("application/warc-fields")})
    return rows.select(F.concat_ws(EOL * 2, request, response, metadata).alias("value"))


def written(records: DataFrame, folder: str, per_file: int = PER_FILE) -> None:
    """``records`` as archives of at most ``per_file`` pages in a new ``folder``."""
    records.write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


class _Stream:
    """Records from the bytes of one archive, given piece by piece."""

    def __init__(self, bodies: bool) -> None:
        self.bodies, self.held, self.need = bodies, bytearray(), 0

    def take(self, piece: bytes) -> Iterator[tuple]:
        self.held += piece
        at = 0
        while len(self.held) - at >= self.need:
            while self.held[at : at + 2] == b"\r\n":  # empty lines between records
                at += 2
            end = self.held.find(b"\r\n\r\n", at)
            if end < 0:
                self.need = len(self.held) - at + 1
                break
            fields = _fields(bytes(self.held[at:end]))
            size = int(fields["content-length"][0])
            if len(self.held) < end + 4 + size:
                self.need = end + 4 + size - at
                break
            yield self.record(fields, bytes(self.held[end + 4 : end + 4 + size]))
            at, self.need = end + 4 + size, 0
        del self.held[:at]

    def record(self, fields: dict[str, list[str]], block: bytes) -> tuple:
        one = lambda name: fields.get(name, [None])[0]
        http = None
        if (one("content-type") or "").startswith("application/http"):
            head, _, block = block.partition(b"\r\n\r\n")
            http = head.decode("utf-8", "replace")
        kind = one("warc-type")
        digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
        kept = self.bodies or kind in ("metadata", "warcinfo")
        return (one("warc-record-id"), kind, fields.get("warc-concurrent-to"), one("warc-refers-to"), one("warc-target-uri"), one("warc-date"), one("content-type"), one("warc-payload-digest"), http, len(block), digest, block if kept else None)

    def ended(self) -> None:
        if self.held.strip():
            raise ValueError("an archive ends within a record")


def _fields(head: bytes) -> dict[str, list[str]]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record begins with {lines[0][:40]!r}")
    out: dict[str, list[str]] = {}
    last: list[str] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded value goes on
            last[-1] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            last = out.setdefault(name.strip().lower(), [])
            last.append(value.strip())
    return out


def read(spark: SparkSession, folder: str, bodies: bool = False) -> DataFrame:
    """One row for each record of the archives (``.gz``) in ``folder``: its fields, the size and SHA-1 of its payload, and the payload itself.

    The payload is what follows the head of an HTTP message, or the whole block of other records; without ``bodies`` it is null but for
    metadata.  A file that ends within a record or does not begin with one raises.  A file that Spark has split, as it does with large
    ones that are not compressed, raises too.
    """
    lines = spark.read.option("lineSep", "\n").text(folder)
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}[t]) for n, t in (c.split() for c in _RECORD.split(", "))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stream, out, held = None, None, [], 0
        for batch in batches:
            files, values = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            if batch.num_rows and max(batch.column(1).to_pylist()):
                raise ValueError("an archive that is not compressed was split: compress it")
            a = 0
            while a < len(values):
                b = a + 1
                while b < len(values) and files[b] == files[a]:
                    b += 1
                if files[a] != file:
                    if stream:
                        stream.ended()
                    file, stream = files[a], _Stream(bodies)
                for r in stream.take(b"\n".join(values[a:b]) + b"\n"):
                    out.append(r)
                    held += len(r[-1] or b"") + 500
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                        out, held = [], 0
                a = b
        if stream:
            stream.ended()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return lines.mapInArrow(lean(parse), _RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``capture`` (the response, revisit, resource or conversion), ``requests`` and ``metadata``.

    A record belongs to a capture if one of the two names the other in ``WARC-Concurrent-To``; several of a kind are all kept, in order of
    their ids.  A capture that no record names has empty arrays.  A record that names none is in no row.
    """
    rows = settled(records)
    whole = F.struct(*rows.columns)
    mains = rows.filter(F.col("type").isin(*MAIN)).select(F.col("record_id").alias("id"), whole.alias("capture"))
    parts = rows.filter(F.col("type").isin("request", "metadata"))
    naming = parts.select(F.explode("concurrent_to").alias("id"), whole.alias("part"))
    named = mains.select("id", F.explode("capture.concurrent_to").alias("part_id")).join(parts.select(F.col("record_id").alias("part_id"), whole.alias("part")), "part_id").select("id", "part")
    beside = naming.unionByName(named).groupBy("id").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    of = lambda kind: F.coalesce(F.filter("parts", lambda p: p["type"] == kind), F.array())
    return mains.join(beside, "id", "left").select("capture", of("request").alias("requests"), of("metadata").alias("metadata"))


def resolved(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri: each capture with the payload that it stands for.

    A revisit has that of the record that it refers to; its own digest must agree, or it has none.  ``refers_to`` is that record's page id.
    """
    page = F.regexp_extract(F.get("metadata", F.lit(0))["body"].cast("string"), "page-id: (-?[0-9]+)", 1)
    rows = captures.select("capture.*", F.when(page != "", page.cast("long")).alias("page_id"), F.regexp_replace("capture.named_digest", "^sha1:", "").alias("named"))
    rows = settled(rows.select("record_id", "type", "refers_to", "target_uri", "body_bytes", "body_sha1", "page_id", "named"))
    first = rows.filter("type <> 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("of"), F.col("body_bytes").alias("of_bytes"), F.col("body_sha1").alias("named"))
    own = rows.filter("type <> 'revisit'").select("page_id", F.col("body_bytes").alias("payload_bytes"), F.col("body_sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "target_uri")
    again = rows.filter("type = 'revisit'").join(first, ["refers_to", "named"], "left")
    again = again.select("page_id", F.col("of_bytes").alias("payload_bytes"), F.when(F.col("of_bytes").isNotNull(), F.col("named")).alias("payload_digest"), F.col("type").alias("record_type"), F.col("of").alias("refers_to"), "target_uri")
    return own.unionByName(again)


def archived(spark: SparkSession, pages: DataFrame, **columns) -> DataFrame:
    """``pages`` written as archives into the cluster's shared folder, read back, put together and resolved."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    written(records(pages, **columns), folder)
    return resolved(captures(read(spark, folder)))


by_value(__name__)
