"""WARC records, and the resolution of not-modified revisits.

A revisit that says "not modified" has no payload of its own. It is resolved to the latest earlier
full response of the same canonical URL. Its validators are checked (the entity tag by weak comparison,
or without one the modification date), and the headers of the 304 answer replace those of the stored
response, but for the ones that describe the body or the connection.

The as-of join sorts responses and revisits together by (URL, time), cut into ranges at any row, so a
URL with any share of the captures is spread over tasks. Each range carries the latest response along
and puts it beside the revisits that refer to it, so nothing is joined back by id; what a range's first
URL needs from the ranges before comes from one row per range.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, written

# Header fields a 304 answer may not replace (RFC 9111, 3.1 and 3.2, and body metadata).
KEPT_HEADERS = ("content-length", "content-encoding", "content-type", "content-range", "content-location", "transfer-encoding", "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "upgrade", "set-cookie")
NOT_MODIFIED = ("http://netpreserve.org/warc/1.1/revisit/server-not-modified", "http://netpreserve.org/warc/1.0/revisit/server-not-modified")
URL = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^@/?#]*@)?([^:/?#]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host without www and default port in lower case, path without final slashes, sorted query without
    utm_ parameters; neither scheme, user nor fragment. A text that is no absolute URL stays as it is."""
    part = [F.regexp_extract(url, URL, k) for k in range(1, 5)]
    host = F.regexp_replace(F.lower(part[0]), r"^www[0-9]*\.", "")
    port = F.when(part[1].isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part[1]))
    path = F.regexp_replace(part[2], "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(part[3], "&"), lambda p: (p != "") & ~F.startswith(F.lower(p), F.lit("utm_")))), "&")
    return F.when(F.regexp_like(url, F.lit(URL)), F.concat(host, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))).otherwise(url)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Resolve the revisits among ``records``.

    Columns: record_id (ordered), type, url, ts (ordered), headers map<string,string> with
    lower-case names, digest, n_bytes, and http_status where there is one; others are ignored. Type
    `response` is a full response unless its http_status says otherwise (206, or not of class 200; null
    counts as full), `revisit` a not-modified one; other types and a null type are left out.

    Returns per revisit row: record_id, canonical_url, status, refers_to, digest, n_bytes, headers. Status
    is `resolved`; `mismatch` if the latest earlier response has other validators; `unverified` if the
    revisit has none (it is resolved all the same); `missing` if there is no earlier response. Earlier
    means a smaller (ts, record_id); a response of the revisit's own time and a smaller or the same id counts. A
    revisit with a null url or ts is missing, a response with one is never referred to. Repeated revisits
    are resolved one by one; of responses with equal ts and id one is referred to. Null
    headers count as none. An empty table gives an empty result.
    """
    spark = records.sparkSession
    records = records.where("type in ('response', 'revisit')")
    if "http_status" in records.columns:
        records = records.where("type = 'revisit' or http_status is null or (http_status between 200 and 299 and http_status <> 206)")
    rows = records.select(canonical_url(F.col("url")).alias("curl"), "ts", "record_id", (F.col("type") == "revisit").alias("revisit"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest", F.col("n_bytes").cast("long").alias("n_bytes"))
    known = F.col("curl").isNotNull() & F.col("ts").isNotNull()
    order = ["curl", "ts", "record_id", "revisit", "digest"]

    def carry(batches):
        pid = TaskContext.get().partitionId()
        url = first = None
        seen = False
        carried = None  # the latest response, as a batch of one row
        for batch in batches:
            data = batch.select(["record_id", "headers", "digest", "n_bytes"])
            table = pa.Table.from_batches([carried, data] if carried is not None else [data]).combine_chunks()
            skip = 0 if carried is None else 1
            latest = None if carried is None else 0
            take, mine, open_ = [], [], []
            for k, (curl, revisit) in enumerate(zip(batch.column("curl").to_pylist(), batch.column("revisit").to_pylist(), strict=True)):
                if not seen or curl != url:
                    if not seen:
                        first = curl
                    url, latest, seen = curl, None, True
                if revisit:
                    mine.append(k)
                    take.append(latest)
                    open_.append(latest is None and curl == first)
                else:
                    latest = k + skip
            old = table.take(pa.array(take, pa.int64())).combine_chunks()
            new = pa.Table.from_batches([batch]).take(pa.array(mine, pa.int64()))
            if mine:
                yield _walked(pid, False, open_, new.column("curl"), new.column("record_id"), new.column("headers"), old)
            carried = None if latest is None else table.slice(latest, 1).to_batches()[0]
        if carried is not None:
            empty = pa.Table.from_batches([carried])
            none = pa.nulls(1, carried.schema.field("record_id").type), pa.nulls(1, carried.schema.field("headers").type)
            yield _walked(pid, True, [False], pa.array([url], pa.string()), *none, empty)

    n = partitions(spark)
    kind = records.schema["record_id"].dataType.simpleString()
    digest = records.schema["digest"].dataType.simpleString()
    sorted_rows = rows.where(known).repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = f"pid int, tail boolean, open boolean, curl string, record_id {kind}, new map<string,string>, refers_to {kind}, old map<string,string>, digest {digest}, n_bytes long"
    walked, _ = written(sorted_rows.mapInArrow(carry, schema))  # the result reads it

    from_old = ["refers_to", "old", "digest", "n_bytes"]
    tails = walked.where("tail").select("pid", F.struct("curl", *from_old).alias("at"))  # one row a range at most
    spots = spark.range(n).select(F.col("id").cast("int").alias("pid"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.join(tails, "pid", "left").select("pid", F.last("at", ignorenulls=True).over(before).alias("from_before"))
    found = walked.where("not tail").join(F.broadcast(carried), "pid", "left")  # as many rows as ranges
    reaches = F.col("open") & (F.col("from_before.curl") == F.col("curl"))
    found = found.select("record_id", F.col("curl").alias("canonical_url"), "new", *[F.when(reaches, F.col("from_before")[c]).otherwise(F.col(c)).alias(c) for c in from_old])
    lost = rows.where(~known & F.col("revisit")).select("record_id", F.col("curl").alias("canonical_url"), F.col("headers").alias("new"), *[F.lit(None).cast(walked.schema[c].dataType).alias(c) for c in from_old])
    both = found.unionByName(lost)
    tag, old_tag = _weak(F.col("new")["etag"]), _weak(F.col("old")["etag"])
    date, old_date = F.trim(F.col("new")["last-modified"]), F.trim(F.col("old")["last-modified"])
    status = (
        F.when(F.col("old").isNull(), "missing")
        .when(tag.isNotNull(), F.when(F.coalesce(tag == old_tag, F.lit(False)), "resolved").otherwise("mismatch"))
        .when(date.isNotNull(), F.when(F.coalesce(date == old_date, F.lit(False)), "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    both = both.withColumn("status", status)
    good = F.col("status").isin("resolved", "unverified")
    fresh = F.map_filter("new", lambda k, v: ~k.isin(*KEPT_HEADERS) & v.isNotNull())
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    return both.select("record_id", "canonical_url", "status", "refers_to", F.when(good, F.col("digest")).alias("digest"), F.when(good, F.col("n_bytes")).alias("n_bytes"), F.when(good, merged).alias("headers"))


def _walked(pid: int, tail: bool, open_: list[bool], curl, record_id, new, old) -> pa.RecordBatch:
    columns = [pa.array([pid] * len(open_), pa.int32()), pa.array([tail] * len(open_), pa.bool_()), pa.array(open_, pa.bool_()), curl, record_id, new, *(old.column(c) for c in ("record_id", "headers", "digest", "n_bytes"))]
    names = ["pid", "tail", "open", "curl", "record_id", "new", "refers_to", "old", "digest", "n_bytes"]
    return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.chunked_array([c]) for c in columns], names).combine_chunks().to_batches()[0]


def records_of(raw: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or compressed by record: headers in lower case and the block.

    A record whose length is missing or no number ends at the next line that begins a record; one that is
    cut off, as is the last of a damaged file, has the bytes that are there.
    """
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    try:
        line = stream.readline()
        while line:
            if not line.startswith(b"WARC/"):
                line = stream.readline()
                continue
            headers: dict[str, str] = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
            size = headers.get("content-length", "")
            if re.fullmatch("[0-9]{1,15}", size):
                yield {"headers": headers, "block": stream.read(int(size))}
                line = stream.readline()
                continue
            parts = []
            while (line := stream.readline()) and not line.startswith(b"WARC/"):
                parts.append(line)
            yield {"headers": headers, "block": b"".join(parts).removesuffix(b"\r\n\r\n")}
    except (EOFError, gzip.BadGzipFile, zlib.error):
        return


def http_parts(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, headers in lower case and body of an HTTP answer."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("iso-8859-1").split("\r\n")
    words = lines[0].split(" ", 2)
    status = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    return status, headers, body


def record_bytes(kind: str, url: str, date: str, record_id: str, block: bytes, extra: dict[str, str] | None = None) -> bytes:
    """A WARC 1.1 record."""
    head = {"WARC-Type": kind, "WARC-Target-URI": url, "WARC-Date": date, "WARC-Record-ID": f"<{record_id}>", "Content-Type": "application/http;msgtype=response", **(extra or {}), "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under a path: record_id, type, url, ts, headers, digest, n_bytes, body, http_status.

    Revisits of other profiles than server-not-modified get type `duplicate`. A file is read by one
    task, which Spark's binary source hands it as a whole (below 2 GB), and leaves it by some hundred records;
    records without an HTTP block have null headers and http_status and their block as body.
    """
    names = ["record_id", "type", "url", "ts", "headers", "digest", "n_bytes", "body", "http_status"]

    def run(batches):
        for batch in batches:
            for raw in batch["content"]:
                out, size = [], 0
                for r in records_of(raw):
                    h = r["headers"]
                    kind = h.get("warc-type")
                    http = r["block"].startswith(b"HTTP/")
                    status, headers, body = http_parts(r["block"]) if http else (None, None, r["block"])
                    if kind == "revisit" and h.get("warc-profile") not in NOT_MODIFIED:
                        kind = "duplicate"
                    out.append((h.get("warc-record-id", "").strip("<>"), kind, h.get("warc-target-uri", "").strip("<>"), h.get("warc-date"), headers, hashlib.sha256(body).hexdigest(), len(body), body, status))
                    size += len(body)
                    if len(out) >= 500 or size > 32 << 20:
                        yield pd.DataFrame(out, columns=names).astype({"http_status": "Int32"})
                        out, size = [], 0
                yield pd.DataFrame(out, columns=names).astype({"http_status": "Int32"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "record_id string, type string, url string, ts string, headers map<string,string>, digest string, n_bytes long, body binary, http_status int")


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures made of the rows of ``pages`` (page_id, url, html): a full response of each at minute
    page_id, and a not-modified answer some time later with the same tag (page_id mod 4 = 0 or 1), only
    the modification date (2) or another tag (3)."""
    p = F.col("page_id").cast("long")
    html = F.coalesce("html", F.lit(""))
    base = pages.select(p.alias("p"), "url", F.md5(html).alias("m"), F.octet_length(html).cast("long").alias("n"))
    tag = F.concat(F.lit('"'), F.col("m"), F.lit('"'))
    day = (F.col("p") * 60 - F.col("p") % 7 * 3600).cast("string")
    p = F.col("p")
    full = F.create_map(*[x for k, v in (("content-length", F.col("n").cast("string")), ("content-type", F.lit("text/html")), ("etag", tag), ("last-modified", day), ("x-page", p.cast("string"))) for x in (F.lit(k), v)])
    late = p * 60 + 30 + p % 5 * 6000
    answer = F.map_filter(
        F.create_map(*[x for k, v in (("cache-control", F.concat(F.lit("max-age="), (p % 9).cast("string"))), ("connection", F.lit("close")), ("content-length", F.lit("0")), ("date", late.cast("string")), ("etag", F.when(p % 4 < 2, F.concat(F.lit("W/"), tag)).when(p % 4 == 3, F.lit('"other"'))), ("last-modified", day)) for x in (F.lit(k), v)]),
        lambda k, v: v.isNotNull(),
    )
    both = F.array(
        F.struct((2 * p).alias("record_id"), F.lit("response").alias("type"), F.col("url"), (p * 60).alias("ts"), full.alias("headers"), F.col("m").alias("digest"), F.col("n").alias("n_bytes")),
        F.struct((2 * p + 1).alias("record_id"), F.lit("revisit").alias("type"), F.col("url"), late.alias("ts"), answer.alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("n_bytes")),
    )
    return base.select(F.explode(both).alias("r")).select("r.*")


def resolved_pages(pages: DataFrame) -> DataFrame:
    out = resolve_revisits(page_captures(pages))
    lines = F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit(": "), F.col("headers")[k]))
    return out.withColumn("headers", F.array_join(lines, "\n"))


ORACLE = r"""
WITH u AS (SELECT page_id AS p, url, md5(coalesce(html, '')) AS m, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n,
  regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^@/?#]*@)?([^:/?#]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?', ['host', 'port', 'path', 'query']) AS x FROM pages),
c AS (SELECT *, regexp_replace(lower(x.host), '^www[0-9]*\.', '') || CASE WHEN x.port IN ('', '80', '443') THEN '' ELSE ':' || x.port END || regexp_replace(x.path, '/+$', '')
  || CASE WHEN len(list_filter(string_split(x.query, '&'), lambda q: q <> '' AND NOT starts_with(lower(q), 'utm_'))) = 0 THEN ''
     ELSE '?' || array_to_string(list_sort(list_filter(string_split(x.query, '&'), lambda q: q <> '' AND NOT starts_with(lower(q), 'utm_'))), '&') END AS curl FROM u),
r AS (SELECT curl, p * 60 AS ts, 2 * p AS record_id, p, m, n, CAST(p * 60 - p % 7 * 3600 AS VARCHAR) AS lm FROM c),
v AS (SELECT curl, p * 60 + 30 + p % 5 * 6000 AS ts, 2 * p + 1 AS record_id, p, CASE WHEN p % 4 < 2 THEN m WHEN p % 4 = 3 THEN 'other' END AS tag, CAST(p * 60 - p % 7 * 3600 AS VARCHAR) AS lm FROM c),
a AS (SELECT curl, ts, record_id, record_id AS rid FROM r UNION ALL SELECT curl, ts, record_id, NULL FROM v),
w AS (SELECT record_id, rid, last_value(rid IGNORE NULLS) OVER (PARTITION BY curl ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS refers_to FROM a),
j AS (SELECT v.record_id, v.curl AS canonical_url, w.refers_to, v.p AS vp, v.ts AS vts, v.lm AS vlm, v.tag, r.m, r.n, r.lm, r.p AS rp,
  CASE WHEN w.refers_to IS NULL THEN 'missing' WHEN v.tag IS NOT NULL THEN CASE WHEN v.tag = r.m THEN 'resolved' ELSE 'mismatch' END WHEN v.lm = r.lm THEN 'resolved' ELSE 'mismatch' END AS status
  FROM v JOIN w ON w.record_id = v.record_id AND w.rid IS NULL LEFT JOIN r ON r.record_id = w.refers_to)
SELECT record_id, canonical_url, status, refers_to, CASE WHEN status = 'resolved' THEN m END AS digest, CASE WHEN status = 'resolved' THEN n END AS n_bytes,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=' || (vp % 9) || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || vts || chr(10)
    || 'etag: ' || CASE WHEN tag IS NULL THEN '"' || m || '"' ELSE 'W/"' || tag || '"' END || chr(10) || 'last-modified: ' || vlm || chr(10) || 'x-page: ' || rp END AS headers
FROM j
"""
