"""WARC records, and the resolution of not-modified revisits.

A revisit is joined, as of its date, with the latest strictly earlier full response (status 200) of the same canonical URL. If its
validators (ETag by weak comparison, Last-Modified) are those of that response, the response's payload stands for it,
and the header fields that a not-modified answer may change are merged over the stored ones.

A record is (record_id, kind ``response`` or ``revisit``, url, date timestamp, http_status, profile, headers
array<struct<name, value>> with lower-case names in their order, repeated fields each, payload binary). A revisit whose
profile says that its payload was identical isn't one that wasn't modified: its status is ``other_profile``. Responses of
any other status (partial ones, redirects, errors) are no base; an unknown status or profile counts as the usual one. Of full responses of one URL and date the greatest (record_id, payload digest) counts.
Records with a null URL or date meet nothing. Revisits that repeat are resolved each. Status is ``resolved``,
``mismatch`` (a validator differs), ``no_validator``, ``no_earlier`` or ``other_profile``; only resolved ones have a payload. Null payloads
of responses are empty; very long ones are moved once, by their digest. Without records there is no row. Other columns
are not read, whatever their names. ``read_warc`` passes over what isn't a record; one with a bad length ends its file, as
does a file that is cut off; a bad date is null.
"""

from __future__ import annotations

import contextlib
import gzip
import io
import re
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import salted_lookup, written
from .token_files import _place

# Header fields that a not-modified response may bring up to date; parameters that don't name a page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"utm_[a-z]+|fbclid|gclid"
IDENTICAL = "identical-payload-digest"  # what such a profile's address contains
RECORD = "record_id string, kind string, url string, date timestamp, http_status int, profile string, headers array<struct<name: string, value: string>>, payload binary"
HOT_CHUNKS = 200


def canonical_url(url: Column, tracking: str = TRACKING) -> Column:
    """Host in lower case without www and default port, then path and query; no scheme, fragment or parameters whose names
    match ``tracking``."""
    plain = F.regexp_replace(url, "#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^(.*@)?(www[0-9]?\.)?", ""), ":(80|443)$", "")
    rest = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    rest = F.regexp_replace(rest, rf"([?&])({tracking})=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), r"\?&+", "?"), "[?&]$", "")
    return F.concat(host, F.when(rest == "", F.lit("/")).otherwise(rest))


def header(headers: Column, name: str) -> Column:
    """The first value of a field; null if there is none."""
    return F.get(F.filter(headers, lambda h: h["name"] == name), 0)["value"]


def merged(stored: Column, fresh: Column) -> Column:
    """The stored fields with the permitted ones of the not-modified answer put over them, by name."""
    permitted = F.filter(fresh, lambda h: h["name"].isin(*PERMITTED))
    kept = F.filter(stored, lambda h: ~F.exists(permitted, lambda x: x["name"] == h["name"]))
    return F.array_sort(F.concat(kept, permitted))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def _previous(times: DataFrame) -> DataFrame:
    """The last ``full`` before each (url, at) of ``times``; one row for each url and at.

    A URL over a thousandth of all rows is cut by date into chunks. A chunk is ordered by itself; what a chunk starts
    with comes from a row for each chunk before it.
    """
    total = times.count()
    hot = written(times.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(64, total // 1000)).select(F.col("url").alias("__url")), "hot-urls")  # 1,000 rows at most
    if hot.isEmpty():
        whole = Window.partitionBy("url").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        return times.select("url", "at", F.last("full", ignorenulls=True).over(whole).alias("earlier"))
    bounds = times.join(F.broadcast(hot), F.col("url") == F.col("__url")).groupBy("__url").agg(F.percentile_approx("at", [k / HOT_CHUNKS for k in range(1, HOT_CHUNKS)]).alias("bounds"))
    hot = written(bounds, "hot-bounds")
    cut = times.join(F.broadcast(hot), F.col("url") == F.col("__url"), "left")
    cut = cut.withColumn("chunk", F.coalesce(F.size(F.filter("bounds", lambda b: b < F.col("at"))), F.lit(0))).drop("__url", "bounds")
    within = Window.partitionBy("url", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    filled = cut.withColumn("here", F.last("full", ignorenulls=True).over(within))
    ends = cut.join(F.broadcast(hot.select(F.col("__url"))), F.col("url") == F.col("__url"), "left_semi").where("full is not null")
    ends = ends.groupBy("url", "chunk").agg(F.max_by("full", "at").alias("end"))
    chunks = cut.join(F.broadcast(hot.select(F.col("__url"))), F.col("url") == F.col("__url"), "left_semi").select("url", "chunk").distinct().join(ends, ["url", "chunk"], "left")
    before = Window.partitionBy("url").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # HOT_CHUNKS rows a URL
    carried = chunks.select("url", "chunk", F.last("end", ignorenulls=True).over(before).alias("carried")).where("carried is not null")
    return filled.join(carried, ["url", "chunk"], "left").select("url", "at", F.coalesce("here", "carried").alias("earlier"))


def resolve(records: DataFrame) -> DataFrame:
    """A row for each revisit: record_id, url (canonical), date, status, refers_to, headers (merged), payload."""
    named = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url"), "date", F.unix_micros("date").alias("at"), F.coalesce("http_status", F.lit(200)).alias("http_status"), F.coalesce("profile", F.lit("")).alias("profile"), "headers", F.coalesce("payload", F.lit("").cast("binary")).alias("payload"))
    digest = F.sha2("payload", 256)
    full = F.struct(F.col("record_id"), digest.alias("digest"), "headers")
    known = F.col("url").isNotNull() & F.col("at").isNotNull()
    # The payload stays behind: only its digest goes through the as-of join.
    fulls = named.where((F.col("kind") == "response") & (F.col("http_status") == 200) & known).groupBy("url", "at").agg(F.max(full).alias("full"))
    revisits = written(named.where(F.col("kind") == "revisit").drop("payload", "kind", "http_status"), "revisits")
    asked = revisits.where(known).select("url", "at").distinct().withColumn("full", F.lit(None).cast(fulls.schema["full"].dataType))
    times = written(fulls.unionByName(asked).groupBy("url", "at").agg(F.max("full").alias("full")), "times")
    earlier = written(_previous(times).where("earlier is not null").withColumn("key", F.struct("url", "at")), "earlier")
    rows = revisits.withColumn("key", F.struct("url", "at"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    met = salted_lookup(rows, earlier.select("key", "earlier"), "key", counts, total, ["record_id"], "left").drop("key")

    mine, theirs = F.col("headers"), F.col("earlier.headers")
    etag, modified = header(mine, "etag"), header(mine, "last-modified")
    same = (etag.isNull() | _weak(etag).eqNullSafe(_weak(header(theirs, "etag")))) & (modified.isNull() | modified.eqNullSafe(header(theirs, "last-modified")))
    status = F.when(F.contains("profile", F.lit(IDENTICAL)), "other_profile").when(F.col("earlier").isNull(), "no_earlier").when(etag.isNull() & modified.isNull(), "no_validator").when(same, "resolved").otherwise("mismatch")
    found = met.withColumn("status", status)
    found = found.select("record_id", "url", "date", "status", F.when(F.col("status") == "resolved", F.col("earlier")).alias("base"), "headers")
    result = found.select("record_id", "url", "date", "status", F.col("base.record_id").alias("refers_to"), F.col("base.digest").alias("digest"), F.when(F.col("base").isNotNull(), merged(F.col("base.headers"), F.col("headers"))).alias("headers"))
    result = written(result, "resolved")
    # Payloads are looked up by their digest, so those that repeat are one row; hot ones are dealt to several tasks.
    wanted = result.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    bodies = named.where(F.col("kind") == "response").select(digest.alias("digest"), "payload")
    bodies = bodies.groupBy("digest").agg(F.first("payload").alias("payload"))  # equal digests, equal payloads
    return salted_lookup(result, bodies, "digest", wanted, total, ["record_id"], "left").drop("digest")


def read_warc(spark: SparkSession, paths: str) -> DataFrame:
    """Records of WARC files (.warc or .warc.gz, below a path or by pattern), a file a task, a record at a time."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("date", pa.timestamp("us", "UTC")), ("http_status", pa.int32()), ("profile", pa.string()), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("payload", pa.binary())])
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            fs, place = _place(path)
            with fs.open_input_stream(place, compression=None) as raw:
                stream = io.BufferedReader(raw)
                for row in parse_records(gzip.GzipFile(fileobj=stream) if path.endswith(".gz") else stream):
                    yield pa.RecordBatch.from_pylist([row], kinds)

    files = spark.read.format("binaryFile").load(paths).select("path")
    return files.repartition(max(1, files.count())).mapInArrow(read, RECORD)


def parse_records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Responses and revisits of one WARC stream; other kinds of record are skipped. It ends where a length is bad or the
    stream is cut off."""
    with contextlib.suppress(EOFError, zlib.error, gzip.BadGzipFile):
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            listed = _fields(stream)
            fields = dict(reversed(listed))
            length = fields.get("content-length", "0")
            if not length.isdecimal():
                return
            block = stream.read(int(length))
            if len(block) < int(length):
                return
            kind = fields.get("warc-type")
            if kind not in ("response", "revisit"):
                continue
            head, _, body = block.partition(b"\r\n\r\n")
            first, _, rest = head.partition(b"\r\n")
            status = re.match(rb"HTTP/\S+\s+(\d{3})\b", first)
            headers = [{"name": k, "value": v} for k, v in _fields(io.BytesIO(rest + b"\r\n"))]
            yield {"record_id": fields.get("warc-record-id"), "kind": kind, "url": fields.get("warc-target-uri", "").strip("<>") or None, "date": _date(fields.get("warc-date")), "http_status": int(status[1]) if status else None, "profile": fields.get("warc-profile"), "headers": headers, "payload": body if kind == "response" else None}


def _date(text: str | None) -> datetime | None:
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None
    except ValueError:
        return None


def _fields(stream: io.BufferedIOBase) -> list[tuple[str, str]]:
    """Fields in their order, those that repeat each; their text is UTF-8, or else Latin-1."""
    out = []
    while line := stream.readline().strip():
        try:
            text = line.decode()
        except UnicodeDecodeError:
            text = line.decode("latin-1")
        name, _, value = text.partition(":")
        out.append((name.strip().lower(), value.strip()))
    return out


def captures(pages: DataFrame) -> DataFrame:
    """Records made of ``pages`` (page_id, url, html): a full response of each page and a later revisit by another
    spelling of its URL; every fifth revisit has another ETag, every seventh none, every eleventh page is also
    revisited before its response."""
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    etag = F.concat(F.lit('"'), F.left(F.sha2(F.coalesce("html", F.lit("")), 256), F.lit(16)), F.lit('"'))
    base, none = pages.select("page_id", "url", "html", etag.alias("etag")), F.lit(None).cast("string")
    when = lambda seconds: F.timestamp_seconds(F.col("page_id") * 10 + seconds)
    id_ = lambda kind: F.concat(F.lit(kind), F.col("page_id").cast("string"))
    responses = base.select(id_("r").alias("record_id"), F.lit("response").alias("kind"), "url", when(0).alias("date"), F.lit(200).alias("http_status"), none.alias("profile"), F.array(pair("cache-control", F.lit("max-age=60")), pair("content-type", F.lit("text/html")), pair("etag", F.col("etag"))).alias("headers"), F.encode("html", "UTF-8").alias("payload"))
    other = F.concat(F.regexp_replace(F.regexp_replace("url", "^https?", "HTTP"), "#.*$", ""), F.lit("#again"))
    sent = F.when(F.col("page_id") % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), F.col("etag")))
    fresh = F.array(pair("cache-control", F.lit("max-age=120")), pair("content-length", F.lit("0")))
    fresh = F.when(F.col("page_id") % 7 == 0, fresh).otherwise(F.concat(fresh, F.array(pair("etag", sent))))
    revisit = lambda kind, seconds, rows: rows.select(id_(kind).alias("record_id"), F.lit("revisit").alias("kind"), other.alias("url"), when(seconds).alias("date"), F.lit(304).alias("http_status"), none.alias("profile"), fresh.alias("headers"), F.lit(None).cast("binary").alias("payload"))
    return responses.unionByName(revisit("v", 45, base)).unionByName(revisit("w", -5, base.where(F.col("page_id") % 11 == 0)))


def resolved_sql() -> str:
    """``resolve(captures(pages))`` with its digest columns as DuckDB SQL."""
    return rf"""
WITH base AS (SELECT page_id, url, coalesce(html, '') AS html, '"' || substr(sha256(coalesce(html, '')), 1, 16) || '"' AS etag FROM pages),
spelt AS (SELECT *, regexp_replace(url, '#.*$', '') AS plain FROM base),
parts AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^(.*@)?(www[0-9]?\.)?', ''), ':(80|443)$', '') AS host,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(plain, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', ''), '([?&])({TRACKING})=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&+', '?', 'g'), '[?&]$', '') AS rest FROM spelt),
named AS (SELECT page_id, html, etag, host || CASE WHEN rest = '' THEN '/' ELSE rest END AS url FROM parts),
revisits AS (
  SELECT 'v' || page_id AS record_id, url, page_id * 10 + 45 AS t, page_id, etag FROM named
  UNION ALL SELECT 'w' || page_id, url, page_id * 10 - 5, page_id, etag FROM named WHERE page_id % 11 = 0),
sent AS (SELECT *, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"other"' ELSE etag END AS validator, CASE WHEN page_id % 5 = 0 THEN '"other"' ELSE 'W/' || etag END AS spelling FROM revisits),
met AS (SELECT v.record_id, v.url, v.t, v.validator, any_value(v.spelling) AS spelling, max({{'t': r.page_id * 10, 'id': 'r' || r.page_id, 'html': r.html, 'etag': r.etag}}) AS r
  FROM sent v LEFT JOIN named r ON r.url = v.url AND r.page_id * 10 < v.t GROUP BY ALL),
told AS (SELECT *, CASE WHEN r.id IS NULL THEN 'no_earlier' WHEN validator IS NULL THEN 'no_validator' WHEN validator = r.etag THEN 'resolved' ELSE 'mismatch' END AS status FROM met)
SELECT record_id, url, t::BIGINT AS seconds, status, CASE WHEN status = 'resolved' THEN r.id END AS refers_to,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=120;content-type: text/html;etag: ' || spelling END AS headers,
  CASE WHEN status = 'resolved' THEN sha256(r.html) END AS payload_sha256
FROM told
"""
