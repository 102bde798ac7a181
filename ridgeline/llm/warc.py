"""Not-modified revisits of a web archive, resolved to earlier full responses.

A revisit record says that a page had not changed and stores no body. It is
joined as of its time to the latest earlier full response for the same
canonical URL, and accepted if a validator agrees: the payload digest where
both sides have one, else the entity tag, else the date of last modification;
weak tags compare by their value. The resolved record takes the earlier body,
and its headers with those overlaid that a not-modified answer may update.

Records of one URL are ordered in short spans of time; the last full response
of each span is carried into the later spans through a table with one row per
span. A URL with a third of all records is therefore many tasks. Bodies do not
travel with the ordering: they join by record id at the end.

Cases: a record without a URL or time is never resolved (``no url``,
``no time``), nor is it a target; of full responses at one time the one with
the largest id counts, and a response at the revisit's own time is not
earlier; null validators agree with nothing (``no validator``); null headers
are empty; repeated revisit rows are each resolved, repeated responses count
once; long bodies are only moved once; an empty table gives no rows; further
columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import documents, only, shared_folder, stored
from ridgeline.llm.registry import query

# Header fields that an answer "not modified" may update (HTTP semantics), beside those of the exchange itself.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Seconds of a span.
SPAN = 86400


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, tracking fields and a last slash do not tell pages apart; nor does the host's case."""
    c = F.regexp_replace(F.trim(url), "#.*$", "")
    c = F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(c, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www[0-9]*[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(c, "^[^/?]*", "")
    rest = F.regexp_replace(rest, "([?&])utm_[a-z]+=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "[?]&+", "?"), "&&+", "&")
    rest = F.regexp_replace(rest, "[/?&]+$", "")
    return F.nullif(F.concat(host, rest), F.lit(""))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit record.

    ``records``: (record_id, url, captured_at in seconds, kind ``response`` or
    ``revisit``, etag, last_modified, payload_digest, headers as a map with
    lower-case names, body). Output: record_id, url_key, captured_at,
    source_id, reason (``resolved`` or why not), headers, body.
    """
    spark = records.sparkSession
    keyed = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "captured_at", "kind", _tag(F.col("etag")).alias("etag"),
        "last_modified", "payload_digest", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        F.floor(F.col("captured_at") / SPAN).alias("span"))
    usable = F.col("url_key").isNotNull() & F.col("captured_at").isNotNull()
    facts = ("etag", "last_modified", "payload_digest", "headers")
    at = stored(keyed, shared_folder(spark), "records")
    full = at.where(usable & (F.col("kind") == "response")).dropDuplicates(["record_id"])
    revisits = at.where(F.col("kind") == "revisit")

    # Per span of a URL: the ids of its last response, carried into later spans.
    brief = F.struct("captured_at", "record_id")
    spans = full.groupBy("url_key", "span").agg(F.max(brief).alias("latest")).withColumn("asks", F.lit(False))
    asked = revisits.where(usable).select("url_key", "span").distinct().withColumns(
        {"latest": F.lit(None).cast(spans.schema["latest"].dataType), "asks": F.lit(True)})
    both = spans.unionByName(asked).groupBy("url_key", "span").agg(F.max("latest").alias("latest"), F.max("asks").alias("asks"))
    before = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("carried", F.last("latest", ignorenulls=True).over(before)).where("asks").select("url_key", "span", "carried")

    # Inside a span: the last response strictly before each revisit.
    marks = revisits.where(usable).select("record_id", "url_key", "captured_at", "span", "kind", *facts[:3], "headers").unionByName(
        full.select("record_id", "url_key", "captured_at", "span", "kind", *facts[:3], "headers"))
    inside = Window.partitionBy("url_key", "span").orderBy("captured_at").rangeBetween(Window.unboundedPreceding, -1)
    near = marks.withColumn("near", F.max(F.when(F.col("kind") == "response", brief)).over(inside)).where("kind = 'revisit'")
    found = near.join(carried, ["url_key", "span"], "left").withColumn("source_id", F.coalesce("near.record_id", "carried.record_id"))

    source = full.select(F.col("record_id").alias("source_id"), *[F.col(c).alias(f"source_{c}") for c in facts])
    facts_of = [c for c in source.columns if c != "source_id"]
    none = found.where("source_id is null").withColumns({c: F.lit(None).cast(source.schema[c].dataType) for c in facts_of})
    d = found.where("source_id is not null").join(source, "source_id").select(*none.columns).unionByName(none)
    agrees = F.lit(None).cast("boolean")
    for c in ("last_modified", "etag", "payload_digest"):
        mine, theirs = F.col(c), F.col(f"source_{c}")
        agrees = F.when(mine.isNotNull() & theirs.isNotNull(), mine == theirs).otherwise(agrees)
    reason = (F.when(F.col("source_id").isNull(), "no earlier response").when(agrees.isNull(), "no validator")
              .when(agrees, "resolved").otherwise("validator differs"))
    d = d.withColumn("reason", reason)
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("source_headers", lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    ok = F.col("reason") == "resolved"
    d = d.select("record_id", "url_key", "captured_at", F.when(ok, F.col("source_id")).alias("source_id"), "reason",
                 F.when(ok, merged).alias("headers"))
    lost = revisits.where(~usable).select(
        "record_id", "url_key", "captured_at", F.lit(None).cast(dict(d.dtypes)["source_id"]).alias("source_id"),
        F.when(F.col("url_key").isNull(), "no url").otherwise("no time").alias("reason"), F.lit(None).cast("map<string,string>").alias("headers"))
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("source_id"), "body").dropDuplicates(["source_id"])
    # Rows without a source stay out of the joins, where they would all meet in one task.
    columns = ("record_id", "url_key", "captured_at", "source_id", "reason", "headers", "body")
    bare = d.where("source_id is null").unionByName(lost).withColumn("body", F.lit(None).cast(records.schema["body"].dataType))
    return d.where("source_id is not null").join(bodies, "source_id").select(*columns).unionByName(bare.select(*columns))


def archive(pages: DataFrame) -> DataFrame:
    """Archive records made from (page_id, url, html), three captures a page.

    A page is fetched in full, then asked for again twice. Its id sets when: a
    fetch every ten minutes, the revisits two hours and three days later. Every
    seventh first revisit carries a wrong tag, every eleventh no validator.
    """
    page, start = F.col("page_id"), F.col("page_id") * 600
    body = F.coalesce("html", F.lit(""))
    tag = F.concat(F.lit('"'), F.substring(F.md5(body.cast("binary")), 1, 16), F.lit('"'))
    none = F.lit(None).cast("string")

    def record(n: int, delay: int, kind: str, etag: Column, digest: Column, extra: list[Column], full: bool) -> Column:
        return F.struct(
            (page * 3 + n).alias("record_id"), F.col("url").alias("url"), (start + delay).alias("captured_at"), F.lit(kind).alias("kind"),
            etag.alias("etag"), none.alias("last_modified"), digest.alias("payload_digest"),
            F.create_map(F.lit("date"), (start + delay).cast("string"), *extra).alias("headers"), (F.col("html") if full else none).alias("body"))

    first = record(0, 0, "response", tag, F.sha1(body.cast("binary")), [F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"),
                                                                       F.lit("cache-control"), F.lit("max-age=600")], True)
    wrong = F.when(page % 7 == 0, F.lit('"0"')).when(page % 11 == 0, none).otherwise(F.concat(F.lit("W/"), tag))
    second = record(1, 7200, "revisit", wrong, none, [F.lit("content-type"), F.lit("application/octet-stream"), F.lit("expires"), F.lit("0")], False)
    third = record(2, 3 * SPAN, "revisit", none, F.sha1(body.cast("binary")), [F.lit("cache-control"), F.lit("no-store")], False)
    return pages.select(F.explode(F.array(first, second, third)).alias("r")).select("r.*")


OP10_SQL = f"""
with bare as (
  select page_id, coalesce(html, '') as html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as u from pages),
keyed as (
  select page_id, html, nullif(
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www[0-9]*[.]', ''), ':(80|443)$', '') ||
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '^[^/?]*', ''),
      '([?&])utm_[a-z]+=[^&]*', '\\1', 'g'), '[?]&+', '?', 'g'), '&&+', '&', 'g'), '[/?&]+$', ''), '') as k from bare),
full_ as (select page_id * 3 as id, k, page_id * 600 as t, '"' || substr(md5(html), 1, 16) || '"' as tag, sha1(html) as sha,
  octet_length(encode(html)) as n from keyed where k is not null and page_id is not null),
asks as (
  select page_id * 3 + 1 as id, k, page_id * 600 + 7200 as t, page_id * 600 + 7200 as date_,
    case when page_id % 7 = 0 then '"0"' when page_id % 11 = 0 then null else '"' || substr(md5(html), 1, 16) || '"' end as tag,
    null as sha, '0' as expires, 'max-age=600' as cc from keyed
  union all
  select page_id * 3 + 2, k, page_id * 600 + {3 * SPAN}, page_id * 600 + {3 * SPAN}, null, sha1(html), null, 'no-store' from keyed),
found as (
  select a.*, f.id as fid, f.tag as ftag, f.sha as fsha, f.n as fn,
    row_number() over (partition by a.id order by f.t desc, f.id desc) as r
  from asks a left join full_ f on f.k = a.k and f.t < a.t),
judged as (
  select *, case when k is null then 'no url' when t is null then 'no time' when fid is null then 'no earlier response'
    when coalesce(sha = fsha, tag = ftag) is null then 'no validator' when coalesce(sha = fsha, tag = ftag) then 'resolved'
    else 'validator differs' end as reason from found where r = 1)
select id as record_id, k as url_key, t as captured_at, case when reason = 'resolved' then fid end as source_id, reason,
  case when reason = 'resolved' then 'cache-control=' || cc || ';content-type=text/html;date=' || date_ || ';etag=' || ftag ||
    case when expires is null then '' else ';expires=' || expires end end as headers,
  case when reason = 'resolved' then fn end as body_bytes, case when reason = 'resolved' then fsha end as body_sha1
from judged"""


@query("op10_warc_revisits", OP10_SQL)
def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of an archive made from all pages."""
    pages = only(documents(spark, sf_dir, "pages"), page_id="page_id", url="url", html="html")
    d = resolve_revisits(archive(pages))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return d.select(
        "record_id", "url_key", "captured_at", "source_id", "reason", F.array_join(pairs, ";").alias("headers"),
        F.octet_length("body").cast("bigint").alias("body_bytes"), F.sha1(F.col("body").cast("binary")).alias("body_sha1"))
