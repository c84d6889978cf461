"""WARC revisits: a not-modified capture is completed from the latest earlier full response of its URL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import stack

# fixed values: headers of a not-modified answer that replace those of the stored response
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# fixed values: query parameters that name a campaign or a referrer, not a document
TRACKING = r"(utm_[^=&]*|ref|fbclid|gclid)"


@dataclass(frozen=True)
class Revisits:
    """Headers that a revisit may change, and the time slices into which the captures of one URL are cut."""
    permitted: tuple[str, ...] = PERMITTED
    slices: int = 4096


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, user, ``www.``, default port, fragment, tracking parameters and closing slash.

    The host is in lower case and the other parameters keep their order; null stays null.
    """
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), f"&{TRACKING}(=[^&]*)?(?=&|$)", ""), r"^&+", "")
    return F.concat(host, F.regexp_replace(path, r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then clash, the last value holds."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])))


def _tag(headers: Column) -> Column:
    """The entity tag without the mark of a weak one: not-modified answers compare weakly."""
    return F.regexp_replace(F.trim(F.element_at(headers, "etag")), r"^W/", "")


def earlier_response(records: DataFrame, slices: int) -> DataFrame:
    """``(_url, _at, _source_at, _source)`` for the times of revisits in ``(_id, _url, _at, _full)``: the latest full response
    strictly before; times without one are left out.

    Of several at one time the largest id is taken.  Captures of a URL are cut into time slices: the answer is in the
    slice itself or is the last of the slices before, so no task has to sort all captures of a common URL.
    """
    span = records.agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"))  # one row
    sliced = records.crossJoin(F.broadcast(span)).withColumn(
        "_slice", F.floor((F.col("_at") - F.col("_from")).cast("double") / (F.col("_to") - F.col("_from") + 1) * slices)).drop("_from", "_to")
    full = F.when(F.col("_full"), F.struct(F.col("_at").alias("at"), F.col("_id").alias("id")))
    inside = Window.partitionBy("_url", "_slice").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    near = sliced.withColumn("_near", F.max(full).over(inside)).where("not _full").groupBy("_url", "_slice", "_at").agg(F.max("_near").alias("_near"))
    last = sliced.groupBy("_url", "_slice").agg(F.max(full).alias("_last"))  # at most `slices` rows a URL
    before = Window.partitionBy("_url").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_url", "_slice", F.max("_last").over(before).alias("_carried"))
    found = near.join(carried, ["_url", "_slice"]).select("_url", "_at", F.coalesce("_near", "_carried").alias("_found"))
    return found.where("_found is not null").select("_url", "_at", F.col("_found.at").alias("_source_at"), F.col("_found.id").alias("_source"))


def resolved_revisits(records: DataFrame, cfg: Revisits | None = None) -> DataFrame:
    """``(record_id, url_key, ts, outcome, source_id, headers, payload)``: one row for each record with an id.

    ``records`` has ``record_id``, ``kind`` (``response`` or ``revisit``), ``url``, ``ts`` (a whole number), ``headers``
    (map) and ``payload``.  A response comes back as it is, with ``outcome`` ``full``.  A revisit takes the payload and
    headers of the latest earlier full response of its canonical URL, its own permitted headers replacing the stored
    ones: ``etag`` or ``last-modified`` tells which validator agreed.  A tag decides if the revisit and the response have
    one, else the time of the last change.  Otherwise the revisit keeps its own headers and has no payload: ``missing`` without an
    earlier response, ``changed`` where the validator differs, ``unproven`` where there is none to compare.

    An id alone tells nothing apart: a revisit is resolved by its own URL and time, and a response is known by URL, time and id; of
    several that share all three, the one with the smallest payload and headers is read.  Null urls and null times match nothing; a
    null kind counts as a revisit; null headers are empty; names are put in lower case.  Repeated rows give repeated rows.
    Other columns are ignored; an empty table gives an empty result.
    """
    cfg = cfg or Revisits()
    rows = records.where("record_id is not null").select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"),
        F.coalesce(F.col("kind") == "response", F.lit(False)).alias("_full"), _lowered(F.col("headers")).alias("headers"), "payload")
    placed = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    slim = rows.where(placed).select(F.col("record_id").alias("_id"), F.col("url_key").alias("_url"), F.col("ts").alias("_at"), "_full")
    pairs = earlier_response(slim, cfg.slices)
    stored = (rows.where(F.col("_full") & placed).groupBy(F.col("url_key").alias("_s_url"), F.col("ts").alias("_s_at"), F.col("record_id").alias("_s_id"))
              .agg(F.min(F.struct("payload", F.array_sort(F.map_entries("headers")).alias("headers"))).alias("_kept"))
              .select("_s_url", "_s_at", "_s_id", F.col("_kept.payload").alias("_body"), F.map_from_entries("_kept.headers").alias("_stored")))
    # revisits without a place never enter a join, where they would share one key
    revisits = rows.where("not _full")
    none = F.lit(None)
    lost = revisits.where(~placed).select("*", none.cast(rows.schema["record_id"].dataType).alias("_source"), none.cast("map<string,string>").alias("_stored"), none.cast(rows.schema["payload"].dataType).alias("_body"))
    asked = revisits.where(placed).join(pairs, (F.col("url_key") == F.col("_url")) & (F.col("ts") == F.col("_at")), "left")
    met = asked.join(stored, (F.col("url_key") == F.col("_s_url")) & (F.col("_source_at") == F.col("_s_at")) & (F.col("_source") == F.col("_s_id")), "left")
    met = stack(met.select(*lost.columns), lost)
    tag, stored_tag = _tag(F.col("headers")), _tag(F.col("_stored"))
    since, stored_since = F.element_at("headers", "last-modified"), F.element_at("_stored", "last-modified")
    outcome = (F.when(F.col("_source").isNull(), "missing")
               .when(tag.isNotNull() & stored_tag.isNotNull(), F.when(tag == stored_tag, "etag").otherwise("changed"))
               .when(since.isNotNull() & stored_since.isNotNull(), F.when(since == stored_since, "last-modified").otherwise("changed"))
               .otherwise("unproven"))
    ok = F.col("outcome").isin("etag", "last-modified")
    renewed = F.map_filter("headers", lambda k, _: k.isin(list(cfg.permitted)))
    kept = F.map_filter("_stored", lambda k, _: ~F.array_contains(F.map_keys(renewed), k))
    settled = met.withColumn("outcome", outcome).select(
        "record_id", "url_key", "ts", "outcome", F.col("_source").alias("source_id"),
        F.when(ok, F.map_concat(kept, renewed)).otherwise(F.col("headers")).alias("headers"), F.when(ok, F.col("_body")).alias("payload"))
    full = rows.where("_full").select("record_id", "url_key", "ts", F.lit("full").alias("outcome"), F.col("record_id").alias("source_id"), "headers", "payload")
    return stack(full, settled)


def headers_text(headers: Column) -> Column:
    """``name: value`` lines by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
