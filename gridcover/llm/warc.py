"""WARC captures: not-modified revisits resolved against earlier full responses (operator 1).

A revisit is a capture whose server answered "not modified": it has headers but no body. It is resolved by an as-of join to
the latest full response (status 200) of the same canonical URL that was captured strictly earlier; of several at one time, the one
with the greatest record id. The validators must agree: the strong comparison of ETag where both have one, else equal
Last-Modified where both have one, else equal payload digests where both have one; a revisit that shares no validator with the response is left
unresolved. The resolved headers are the response's, with those of the revisit that RFC 9111 permits to update (names
are lower case; KEPT_HEADERS and what Connection names never change).

Canonical URL: without scheme, fragment, user, default port, leading "www.", tracking parameters and a trailing slash or index
page; the host is in lower case; the other parameters are sorted.

Distribution: only ids, times and headers take part, never bodies. One shuffle by URL; within a URL a running maximum answers
the as-of join. URLs are counted first. Those of more than `hot_url` captures, and of more than one in MOST_PARTS of all, are split by
time at quantiles of their own (up to PIECES pieces), each piece is answered alone, and pieces take over the last response of earlier
pieces, so that no task gathers a hot URL; the quantiles, at most about 2 * MOST_PARTS numbers, are broadcast. Captures of one URL at one
and the same time stay together.

Nulls: a null url is canonically null and matches nothing; a null time matches nothing, and a response without a time is "other"; null
headers count as none; a null record id is kept. Repeated records are resolved alike. outcome is one of response, resolved, validator_mismatch, no_validator, no_earlier_response, other.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Headers of a stored response that a not-modified answer must not change.
KEPT_HEADERS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
#: Hot URLs at most, and pieces of one of them.
MOST_PARTS, PIECES = 20_000, 1024
_TRACKING = r"^(utm_[a-z]+|fbclid|gclid|msclkid|ref|sessionid|sid)(=|$)"


# -- files


def parse_warc(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or gzipped by record: WARC headers, HTTP status, HTTP headers and body.

    A record that ends early or has no version line raises ValueError.
    """
    if data[:2] == b"\x1f\x8b":
        plain, rest = [], data
        while rest:
            d = zlib.decompressobj(31)
            plain.append(d.decompress(rest) + d.flush())
            rest = d.unused_data.lstrip(b"\x00")
        data = b"".join(plain)
    at = 0
    while at < len(data):
        if data[at : at + 2] in (b"\r\n",):
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        head = _fields(data[at:end].split(b"\r\n")[1:])
        size = int(head.get("content-length", "0"))
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("a record ends early")
        at = end + 4 + size
        record = {"type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "digest": head.get("warc-payload-digest"), "refers_to": head.get("warc-refers-to"), "status": None, "headers": {}, "body": block}
        if head.get("content-type", "").replace(" ", "").startswith("application/http") and block.startswith(b"HTTP/"):
            top, _, body = block.partition(b"\r\n\r\n")
            lines = top.split(b"\r\n")
            status = lines[0].split(b" ", 2)
            record |= {"status": int(status[1]) if len(status) > 1 and status[1].isdigit() else None, "headers": _fields(lines[1:]), "body": body}
        yield record


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        name = name.strip().lower()
        out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def write_warc(records: list[dict], compress: bool = False) -> bytes:
    """The records as a WARC/1.1 file; the inverse of parse_warc."""
    out = []
    for r in records:
        block = r.get("body") or b""
        if r.get("status") is not None:
            block = b"\r\n".join([f"HTTP/1.1 {r['status']} -".encode(), *(f"{k}: {v}".encode() for k, v in r["headers"].items())]) + b"\r\n\r\n" + block
        names = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "url": "WARC-Target-URI", "date": "WARC-Date", "digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
        head = ["WARC/1.1", *(f"{n}: {r[k]}" for k, n in names.items() if r.get(k) is not None), *(["Content-Type: application/http; msgtype=response"] if r.get("status") is not None else []), f"Content-Length: {len(block)}"]
        one = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
        out.append(gzip.compress(one, mtime=0) if compress else one)
    return b"".join(out)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under a path: type, record_id, url, ts (epoch seconds), digest, status, headers, body."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])
        for b in batches:
            for content in b.column(0):
                rows = [{k: (list(r[k].items()) if k == "headers" else r[k]) for k in kinds.names} for r in parse_warc(content.as_py())]
                for k in range(0, len(rows), 200):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 200], schema=kinds)

    files = spark.read.format("binaryFile").load(path).select("content")
    out = files.mapInArrow(parsed, "type string, record_id string, url string, date string, digest string, status int, headers map<string,string>, body binary")
    return out.withColumn("ts", F.unix_seconds(F.to_timestamp("date"))).drop("date")


# -- resolution


def canonical_url(url: Column) -> Column:
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.substring_index(rest, "#", 1)
    before = F.substring_index(rest, "?", 1)
    query = F.substring(rest, F.length(before) + 2, F.length(rest))
    host = F.lower(F.regexp_replace(F.substring_index(before, "/", 1), r"^[^@]*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.substring(before, F.length(F.substring_index(before, "/", 1)) + 1, F.length(before))
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.(html?|php)$", "/"), "/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers with those of the update that may change them; names in order."""
    named = F.transform(F.split(F.lower(F.coalesce(update["connection"], F.lit(""))), ","), lambda x: F.trim(x))
    may = F.map_filter(update, lambda k, _: ~k.isin(KEPT_HEADERS) & ~F.array_contains(named, k))
    old = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(may), k))
    return F.map_from_entries(F.array_sort(F.concat(F.map_entries(old), F.map_entries(may))))


def resolve_revisits(records: DataFrame, hot_url: int = 100_000, keep: list[str] | None = None) -> DataFrame:
    """records: record_id, url, ts (long), type, status, headers (map of lower-case names), digest. Adds canonical_url, outcome, refers_to,
    resolved_headers and resolved_digest (those of the response itself for responses; null where unresolved)."""
    keep = keep if keep is not None else []
    none = F.create_map().cast("map<string,string>")
    r = records.select("record_id", "ts", "type", "status", F.coalesce("headers", none).alias("headers"), "digest", canonical_url(F.col("url")).alias("canonical_url"), *keep)
    full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull()
    r = r.withColumn("_full", F.when(F.coalesce(full, F.lit(False)), F.struct("ts", "record_id", F.map_entries("headers").alias("headers"), "digest")))

    # rows without url or time find nothing and are dealt out by their record; the others by url, and those of a hot url by time as well
    each = max(hot_url, records.count() // MOST_PARTS)
    idle = F.col("canonical_url").isNull() | F.col("ts").isNull()
    alone = -1 - F.pmod(F.xxhash64("record_id", "ts", "canonical_url"), F.lit(1 << 20)).cast("int")
    counts = r.where(~idle).groupBy("canonical_url").agg(F.count("*").alias("_n")).where(F.col("_n") > each)
    hot = materialize(counts, "warc-hot")
    any_hot = not hot.isEmpty()
    if any_hot:
        quantiles = F.percentile_approx("ts", F.array(*[F.lit(k / PIECES) for k in range(1, PIECES)]), F.lit(10 * PIECES))
        cuts = r.where(~idle).join(F.broadcast(hot), "canonical_url").groupBy("canonical_url").agg(F.first("_n").alias("_n"), quantiles.alias("_at"))
        step = F.greatest(F.lit(1), F.floor(F.lit(PIECES * each) / F.col("_n")).cast("int"))
        cuts = materialize(cuts.select("canonical_url", F.array_distinct(F.filter("_at", lambda x, k: (k + 1) % step == 0)).alias("_at")), "warc-cuts")
        r = r.join(F.broadcast(cuts), "canonical_url", "left")
        r = r.withColumn("_hot", F.col("_at").isNotNull() & ~idle).withColumn("_part", F.when(idle, alone).when(F.col("_at").isNull(), 0).otherwise(F.size(F.filter("_at", lambda x: x <= F.col("ts"))))).drop("_at")
    else:
        r = r.withColumn("_part", F.when(idle, alone).otherwise(0))

    earlier = Window.partitionBy("canonical_url", "_part").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    whole, r = r, r.withColumn("_found", F.max("_full").over(earlier))
    if any_hot:
        ends = whole.where("_hot").groupBy("canonical_url", "_part").agg(F.max("_full").alias("_last"))
        before = Window.partitionBy("canonical_url").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select("canonical_url", "_part", F.max("_last").over(before).alias("_carried"))
        r = r.join(carried, ["canonical_url", "_part"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    r = r.withColumn("_found", F.when(~idle, F.col("_found")))

    old, new = F.map_from_entries("_found.headers"), F.col("headers")
    strong = lambda c: F.when(~c.startswith("W/"), c)
    both = lambda a, b: a.isNotNull() & b.isNotNull()
    agree = (
        F.when(both(old["etag"], new["etag"]), F.coalesce(strong(old["etag"]) == strong(new["etag"]), F.lit(False)))
        .when(both(old["last-modified"], new["last-modified"]), old["last-modified"] == new["last-modified"])
        .when(both(F.col("_found.digest"), F.col("digest")), F.col("_found.digest") == F.col("digest"))
    )
    outcome = (
        F.when(F.col("_full").isNotNull(), "response")
        .when(F.coalesce(F.col("type") != "revisit", F.lit(True)), "other")
        .when(F.col("_found").isNull(), "no_earlier_response")
        .when(agree.isNull(), "no_validator")
        .when(agree, "resolved")
        .otherwise("validator_mismatch")
    )
    r = r.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    return r.select(
        "record_id", "ts", "canonical_url", "outcome", F.when(done, F.col("_found.record_id")).alias("refers_to"),
        F.when(done, merged_headers(old, new)).when(F.col("outcome") == "response", F.map_from_entries(F.array_sort(F.map_entries(new)))).alias("resolved_headers"),
        F.when(done, F.col("_found.digest")).when(F.col("outcome") == "response", F.col("digest")).alias("resolved_digest"), *keep,
    )


def captures(pages: DataFrame) -> DataFrame:
    """A capture log derived from pages: of each page a full response, a later revisit by a variant of its url, whose validators differ for
    every seventh page, and for every fifth page an earlier revisit. Times follow page_id; without one, ids and times are null."""
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    h = lambda **x: F.create_map(*[v for k, e in x.items() for v in (F.lit(k.replace("_", "-")), e)])
    rec = lambda k, ts, kind, status, url, headers: F.struct((F.col("page_id") * 10 + k).alias("record_id"), ts.cast("long").alias("ts"), F.lit(kind).alias("type"), F.lit(status).alias("status"), url.alias("url"), headers.alias("headers"))
    at, url = F.col("page_id") * 100, F.col("url")
    length = F.length(F.coalesce("html", F.lit(""))).cast("string")
    response = rec(1, at + 10, "response", 200, url, h(cache_control=F.lit("max-age=60"), content_length=length, content_type=F.lit("text/html"), date=F.concat(F.lit("day "), F.col("page_id")), etag=tag))
    later = rec(2, at + 20, "revisit", 304, F.concat(F.regexp_replace(url, "^https?", "http"), F.lit("#seen")), h(cache_control=F.lit("max-age=600"), content_length=F.lit("0"), date=F.concat(F.lit("day "), F.col("page_id") + 1), etag=F.when(F.col("page_id") % 7 == 0, F.lit('"other"')).otherwise(tag)))
    sooner = rec(3, at + 5, "revisit", 304, url, h(date=F.concat(F.lit("day "), F.col("page_id"))))
    rows = F.array_compact(F.array(response, later, F.when(F.col("page_id") % 5 == 0, sooner)))
    return pages.select("page_id", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.explode(rows).alias("r")).select("page_id", "digest", "r.*").withColumn("digest", F.when(F.col("type") == "response", F.col("digest")))


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's captures, resolved; headers as lines in the order of their names."""
    out = resolve_revisits(captures(table(spark, sf_dir, "pages")), keep=["page_id"])
    lines = F.array_join(F.transform(F.map_entries("resolved_headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", "page_id", "canonical_url", "outcome", "refers_to", lines.alias("headers"), F.col("resolved_digest").alias("digest"))


OP1_SQL = r"""
WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) AS m, CAST(length(coalesce(html, '')) AS VARCHAR) AS n FROM pages
), r AS (
  SELECT page_id * 10 + 1 AS record_id, page_id, page_id * 100 + 10 AS ts, 'response' AS kind, url, 'max-age=60' AS cc, n AS cl, page_id AS day, '"' || m || '"' AS etag, m AS digest FROM p
  UNION ALL
  SELECT page_id * 10 + 2, page_id, page_id * 100 + 20, 'revisit', regexp_replace(url, '^https?', 'http') || '#seen', 'max-age=600', '0', page_id + 1, CASE WHEN page_id % 7 = 0 THEN '"other"' ELSE '"' || m || '"' END, NULL FROM p
  UNION ALL
  SELECT page_id * 10 + 3, page_id, page_id * 100 + 5, 'revisit', url, NULL, NULL, page_id, NULL, NULL FROM p WHERE page_id % 5 = 0
), s AS (SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS u FROM r
), t AS (SELECT *, regexp_extract(u, '^[^?]*') AS b, regexp_extract(u, '^[^?]*[?](.*)$', 1) AS q FROM s
), c AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/]*')), '^[^@]*@', ''), ':(80|443)$', ''), '^www[.]', '')
    || regexp_replace(regexp_replace(regexp_extract(b, '^[^/]*(.*)$', 1), '/index[.](html?|php)$', '/'), '/+$', '')
    || coalesce((SELECT '?' || string_agg(x, '&' ORDER BY x) FROM (SELECT unnest(string_split(q, '&')) AS x) z WHERE x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid|msclkid|ref|sessionid|sid)(=|$)')), '') AS canonical_url
  FROM t
), f AS (SELECT canonical_url, ts, max(record_id) AS record_id FROM c WHERE kind = 'response' AND ts IS NOT NULL GROUP BY 1, 2
), g AS (
  SELECT c.*, (SELECT max(f.ts) FROM f WHERE f.canonical_url = c.canonical_url AND f.ts < c.ts) AS fts FROM c
), j AS (
  SELECT g.*, o.record_id AS o_id, o.etag AS o_etag, o.digest AS o_digest, o.cl AS o_cl, o.cc AS o_cc
  FROM g LEFT JOIN f ON f.canonical_url = g.canonical_url AND f.ts = g.fts LEFT JOIN c o ON o.record_id = f.record_id
), k AS (
  SELECT *, CASE WHEN kind = 'response' THEN CASE WHEN ts IS NULL THEN 'other' ELSE 'response' END WHEN o_id IS NULL THEN 'no_earlier_response' WHEN etag IS NULL THEN 'no_validator' WHEN etag = o_etag THEN 'resolved' ELSE 'validator_mismatch' END AS outcome FROM j
)
SELECT record_id, page_id, canonical_url, outcome, CASE WHEN outcome = 'resolved' THEN o_id END AS refers_to,
  CASE WHEN outcome IN ('response', 'resolved') THEN 'cache-control: ' || cc || chr(10) || 'content-length: ' || CASE WHEN outcome = 'response' THEN cl ELSE o_cl END || chr(10) || 'content-type: text/html' || chr(10) || 'date: day ' || CAST(day AS VARCHAR) || chr(10) || 'etag: ' || etag END AS headers,
  CASE WHEN outcome = 'response' THEN digest WHEN outcome = 'resolved' THEN o_digest END AS digest
FROM k
"""
