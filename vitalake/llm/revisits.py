"""WARC revisits: a "not modified" record gets the payload of the latest earlier full response for its URL.

An as-of join by canonical URL. Records are dealt by URL and by a slice of time, so the captures of one hot
URL are many groups; what a slice lacks comes from the last full response of the slices before it, of which
there is one row per URL and slice. Only ids, validators and headers take part; payloads are fetched at the
end by the id of the response. DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a stored response that a 304 must not change: those of the message and of the payload.
#: Fixed values, from the HTTP specifications.
KEPT_HEADERS = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection",
    "te", "trailer", "transfer-encoding", "upgrade", "content-encoding", "content-length", "content-range", "content-type",
    "content-md5", "digest",
)
#: Query parameters that do not name a page.
TRACKING = "^(utm_[a-z]+|gclid|fbclid|msclkid|ref|sessionid|phpsessid|jsessionid)="
#: Records of a time slice, and slices at most.
SLICE_ROWS, SLICES = 200_000, 4096

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//(?:[^/?#@]*@)?([^/:?#]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """host, port if not a default one, path and sorted query: scheme, user, `www`, fragment and tracking left out.

    Null for null and for texts that are no URL with a host.
    """

    def part(i: int) -> Column:
        return F.regexp_extract(F.trim(url), _URL, i)

    host = F.regexp_replace(F.lower(part(2)), r"^(www[0-9]*|m)\.|\.$", "")
    port = F.when(part(3).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(3)))
    path = F.regexp_replace(F.regexp_replace(part(4), "/+", "/"), "/$", "")
    pairs = F.array_sort(F.filter(F.split(part(5), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, port, path, query))


def headers_of(block: Column) -> Column:
    """A header block as a map by lower-case name; lines of one name are joined by a comma, others are skipped."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"),
            F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"),
        ),
    )
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    values = F.transform(
        names, lambda n: F.array_join(F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: p["value"]), ", ")
    )
    return F.map_from_arrays(names, values)


def merged_headers(stored: Column, fresh: Column, kept: tuple[str, ...] = KEPT_HEADERS) -> Column:
    """The stored headers with those of the 304 that may change them."""
    allowed = F.map_filter(fresh, lambda k, _: ~k.isin(*kept))
    return F.map_zip_with(stored, allowed, lambda _, old, new: F.coalesce(new, old))


def _etag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per record: record_id, type, url, ts, outcome, refers_to, headers, payload.

    records has record_id, type ("response" or "revisit"), url, ts (long), status (int), headers (text block),
    payload. A full response has status 200 and a payload. A revisit's response is the last full one before it
    by (ts, record_id) with the same canonical URL. outcome is "response" for responses; for revisits
    "resolved", "changed" (the revisit's validator, its ETag or else its Last-Modified, is not the
    response's), "unverified" (it has none, but the response has) or "missing" (no earlier full response).
    ETags compare weakly. Only a resolved revisit gets the payload and the merged headers; refers_to is
    named for "changed" and "unverified" too.

    A null url, ts or record_id leaves a revisit missing, and such a response stands for no other; null
    headers are none. Responses of one record_id count as one, with the least payload. Each repeated
    row gets its result. An empty table gives no rows; further columns are ignored.
    """
    known = records.select(
        "record_id", "type", "url", F.col("ts").cast("long").alias("ts"), "status", "payload",
        F.coalesce(headers_of(F.col("headers")), F.create_map().cast("map<string,string>")).alias("headers"),
        canonical_url(F.col("url")).alias("page"),
    )
    places = known.agg(F.count("*").alias("n")).first().n
    slices = int(min(SLICES, max(1, -(-places // SLICE_ROWS))))
    edges = known.approxQuantile("ts", [i / slices for i in range(1, slices)], 0.1 / slices) if slices > 1 else []
    cuts = F.array(*[F.lit(int(e)) for e in sorted(set(edges))]).cast("array<long>")
    usable = F.col("page").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("payload").isNotNull() & usable
    info = F.when(full, F.struct("record_id", "headers"))
    events = known.withColumn("slice", F.size(F.filter(cuts, lambda c: c <= F.col("ts")))).withColumn("info", info)
    # Records that can find nothing are spread by their id instead of meeting in the group of a null.
    page = F.when(usable, F.col("page")).otherwise(F.concat(F.lit("\u0000"), F.xxhash64("record_id", "url", "ts").cast("string")))
    events = events.withColumn("page", page).drop("payload")

    before = Window.partitionBy("page", "slice").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("here", F.last("info", ignorenulls=True).over(before))
    when = F.when(F.col("info").isNotNull(), F.struct("ts", "record_id"))
    last = events.groupBy("page", "slice").agg(F.max_by("info", when).alias("last"))
    earlier = Window.partitionBy("page").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).filter("carried IS NOT NULL").drop("last")
    found = near.join(carried, ["page", "slice"], "left").withColumn("source", F.coalesce("here", "carried"))

    etag, stored = _etag(F.col("headers")), F.col("source.headers")
    modified = F.col("headers")["last-modified"]
    is_revisit = F.col("type") == "revisit"
    outcome = (
        F.when(~is_revisit | F.col("type").isNull(), "response")
        .when(F.col("source").isNull(), "missing")
        .when(etag.isNotNull(), F.when(etag.eqNullSafe(_etag(stored)), "resolved").otherwise("changed"))
        .when(modified.isNotNull(), F.when(modified.eqNullSafe(stored["last-modified"]), "resolved").otherwise("changed"))
        .when(stored["etag"].isNull() & stored["last-modified"].isNull(), "resolved")
        .otherwise("unverified")
    )
    judged = found.withColumn("outcome", outcome).select(
        "record_id", "type", "url", "ts", "outcome",
        F.when(is_revisit, F.col("source.record_id")).alias("refers_to"),
        F.when(F.col("outcome") == "resolved", merged_headers(stored, F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )
    payloads = known.filter(full).groupBy(F.col("record_id").alias("refers_to")).agg(F.min("payload").alias("payload"))
    # Revisits that want no payload are spread by their id instead of meeting in the group of a null.
    wanted = F.when(F.col("outcome") == "resolved", F.col("refers_to"))
    spread = F.when(wanted.isNotNull(), 0).otherwise(F.pmod(F.xxhash64("record_id", "url", "ts"), F.lit(4096)) + 1).cast("long")
    revisits = judged.filter(is_revisit).withColumns({"wanted": wanted, "spread": spread})
    payloads = payloads.withColumnRenamed("refers_to", "wanted").withColumn("spread", F.lit(0).cast("long"))
    revisits = revisits.join(payloads, ["wanted", "spread"], "left").drop("wanted", "spread")
    others = known.filter(~is_revisit | F.col("type").isNull()).select(
        "record_id", "type", "url", "ts", F.lit("response").alias("outcome"), F.lit(None).cast(records.schema["record_id"].dataType).alias("refers_to"),
        "headers", "payload",
    )
    return revisits.select(*others.columns).unionByName(others)


def captures(pages: DataFrame) -> DataFrame:
    """Records of a table of pages: each page is fetched, fetched again with other content, and asked for in between or after.

    With p for a page's id: its response `r` at time 4 p holds the text, another response `s` at 4 p + 2 a short text, and
    the revisit `v` comes at 4 p + 1, when `s` is still to come, or at 4 p + 3, when `s` is the latest. The hash of the
    text says which, and all else: one `r` in sixteen has status 404, every second `s` has status 500; `r` has an ETag,
    or Last-Modified alone, or no validator, `s` an ETag; a revisit asks with the validator of `r`, with that of `s`,
    or with none. Pages whose URLs have one canonical form meet.
    """
    tag = F.md5(F.col("html").cast("binary"))

    def digit(i: int, among: str) -> Column:
        return F.substring(tag, i, 1).rlike(f"[{among}]")

    end = "\r\n"
    day = F.concat(F.lit("day "), F.length("html").cast("string"))
    own = F.when(tag.rlike("[0-3]$"), F.concat(F.lit("Last-Modified: "), day)).otherwise(F.concat(F.lit('ETag: "'), tag, F.lit('"')))
    other = F.concat(F.lit('ETag: "s'), F.col("page_id").cast("string"), F.lit('"'))
    time = 4 * F.col("page_id").cast("long")

    def record(kind: str, name: str, ts: Column, status: Column, headers: list[Column], payload: Column) -> DataFrame:
        return pages.select(
            F.concat(F.lit(kind), F.col("page_id").cast("string")).alias("record_id"), F.lit(name).alias("type"), "url",
            ts.alias("ts"), status.alias("status"), F.concat(*headers).alias("headers"), payload.alias("payload"),
        )

    def response(text: Column) -> Column:
        return F.concat(F.lit(f"Content-Type: text/html{end}Content-Length: "), F.octet_length(text).cast("string"), F.lit(f"{end}Date: 1{end}"))

    short = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    asked = F.when(digit(5, "0-7"), own).when(digit(5, "89abcd"), other).otherwise("")
    return (
        record("r", "response", time, F.when(digit(2, "0"), 404).otherwise(200), [response(F.col("html")), F.when(digit(3, "01"), "").otherwise(own)], F.col("html"))
        .unionByName(record("s", "response", time + 2, F.when(digit(4, "0-7"), 500).otherwise(200), [response(short), other], short))
        .unionByName(record("v", "revisit", time + F.when(digit(1, "0-7"), 1).otherwise(3), F.lit(304),
                            [F.lit(f"Content-Length: 0{end}Date: 2{end}Age: 5{end}"), asked], F.lit(None).cast("string")))
    )


def digest(resolved: DataFrame) -> DataFrame:
    """One row per record with its headers as sorted text and a hash of its payload."""
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return resolved.select(
        "record_id", "outcome", "refers_to", canonical_url(F.col("url")).alias("page"), F.array_join(lines, ";").alias("headers"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.md5(F.col("payload").cast("binary")).alias("payload_md5"),
    )


SQL = r"""
WITH p AS (
    SELECT page_id, html, md5(html) AS tag, regexp_extract(trim(url),
        '^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//(?:[^/?#@]*@)?([^/:?#]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?',
        ['scheme', 'host', 'port', 'path', 'query']) AS u
    FROM pages
), q AS (
    SELECT *, regexp_replace(lower(u.host), '^(www[0-9]*|m)\.|\.$', '', 'g') AS host,
        list_sort([x FOR x IN string_split(u.query, '&') IF x <> '' AND NOT regexp_matches(lower(x),
        '^(utm_[a-z]+|gclid|fbclid|msclkid|ref|sessionid|phpsessid|jsessionid)=')]) AS pairs
    FROM p
), c AS (
    SELECT page_id, html, tag, CASE WHEN host <> '' THEN host || CASE WHEN u.port IN ('', '80', '443') THEN '' ELSE ':' || u.port END
        || regexp_replace(regexp_replace(u.path, '/+', '/', 'g'), '/$', '')
        || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END END AS page,
        CASE WHEN regexp_matches(tag, '[0-3]$') THEN 'last-modified=day ' || length(html) ELSE 'etag="' || tag || '"' END AS validator
    FROM q
), own AS (
    SELECT *, 'etag="s' || page_id || '"' AS other, 'page ' || page_id AS short FROM c
), responses AS (
    SELECT 'r' || page_id AS record_id, page, 4 * page_id AS ts, html AS payload, substr(tag, 2, 1) <> '0' AS usable,
        CASE WHEN substr(tag, 3, 1) NOT IN ('0', '1') THEN validator END AS validator FROM own
    UNION ALL
    SELECT 's' || page_id, page, 4 * page_id + 2, short, NOT substr(tag, 4, 1) BETWEEN '0' AND '7', other FROM own
), asked AS (
    SELECT 'v' || page_id AS record_id, page, 4 * page_id + CASE WHEN substr(tag, 1, 1) BETWEEN '0' AND '7' THEN 1 ELSE 3 END AS ts,
        CASE WHEN substr(tag, 5, 1) BETWEEN '0' AND '7' THEN validator WHEN substr(tag, 5, 1) IN ('8', '9', 'a', 'b', 'c', 'd') THEN other END
        AS validator
    FROM own
), found AS (
    SELECT v.*, s.record_id AS source, s.payload, s.validator AS stored,
        CASE WHEN s.record_id IS NULL THEN 'missing' WHEN v.validator IS NOT NULL AND v.validator IS DISTINCT FROM s.validator THEN 'changed'
             WHEN v.validator IS NULL AND s.validator IS NOT NULL THEN 'unverified' ELSE 'resolved' END AS outcome
    FROM asked v ASOF LEFT JOIN (SELECT * FROM responses WHERE usable AND payload IS NOT NULL AND page IS NOT NULL) s
        ON s.page = v.page AND s.ts < v.ts
)
SELECT record_id, 'response' AS outcome, CAST(NULL AS VARCHAR) AS refers_to, page,
    'content-length=' || octet_length(encode(payload)) || ';content-type=text/html;date=1' || coalesce(';' || validator, '') AS headers,
    octet_length(encode(payload)) AS payload_bytes, md5(payload) AS payload_md5
FROM responses
UNION ALL
SELECT record_id, outcome, source, page,
    CASE WHEN outcome = 'resolved' THEN 'age=5;content-length=' || octet_length(encode(payload)) || ';content-type=text/html;date=2'
         ELSE 'age=5;content-length=0;date=2' END || coalesce(';' || validator, ''),
    CASE WHEN outcome = 'resolved' THEN octet_length(encode(payload)) END,
    CASE WHEN outcome = 'resolved' THEN md5(payload) END
FROM found
"""
