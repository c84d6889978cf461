"""One query per operator over the whole of its table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.leaks import UNITS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op5_simhash_groups")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.simhash import hex_digits, near_groups

    found = near_groups(table(spark, sf, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query("op6_secret_scan")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.secrets import BASE, of_kinds, secret_spans, spelled

    found = secret_spans(table(spark, sf, "documents").select("doc_id", "text")).drop("text")
    counts = [F.size(of_kinds(F.col("spans"), (r,))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(spelled(of_kinds(F.col("spans"), BASE)), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


@query("op10_quality_rules")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm import quality

    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    ensemble = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    found = quality.scored(docs, ensemble)
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


@query("op2_pareto_mix")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.mixing import mixed

    found = mixed(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_UNIT_WORDS = "|".join("\\" + u if u in "$" else u for u in UNITS)
_LEAK_SQL = rf"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'i', item_id, coalesce(text, '') FROM benchmark
), names AS (  -- twice, since a match takes the end of the word before it
  SELECT kind, id, regexp_replace(regexp_replace(t, '([\p{{Ll}}\p{{N}},;:] )(\p{{Lu}}[\p{{L}}\p{{M}}]*)', '\1' || chr(1) || '\2', 'g'),
                                  '([\p{{Ll}}\p{{N}},;:] )(\p{{Lu}}[\p{{L}}\p{{M}}]*)', '\1' || chr(1) || '\2', 'g') AS t FROM texts
), points AS (
  SELECT kind, id, regexp_replace(regexp_replace(lower(t), '([0-9])[.,:]([0-9])', '\1_\2', 'g'), '([0-9])[.,:]([0-9])', '\1_\2', 'g') AS t FROM names
), numbers AS (
  SELECT kind, id, regexp_replace(t, '(^|[^\p{{L}}\p{{N}}_])([0-9][0-9_]*)', '\1' || chr(2) || '\2 ', 'g') AS t FROM points
), clean AS (
  SELECT kind, id, regexp_replace(t, '[^_\x01-\x03%°$€£\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g') AS t FROM numbers
), units AS (
  SELECT kind, id, regexp_replace(t, '(\x02[^ ]* +)({_UNIT_WORDS})([ \x01-\x03]|$)', '\1' || chr(3) || '\2\3', 'g') AS t FROM clean
), words AS (
  SELECT kind, id, list_filter(string_split(t, ' '), lambda x: x <> '') AS raw FROM units
), made AS (
  SELECT kind, id, raw, list_transform(raw, lambda x: regexp_replace(x, '([\x01-\x03]).+', '\1')) AS m FROM words
  UNION ALL SELECT kind, id, raw, list_transform(raw, lambda x: regexp_replace(replace(x, chr(1), ''), '([\x01-\x03]).+', '\1')) FROM words
), wins AS (
  SELECT DISTINCT kind, id, p, raw[p:p + 4] AS raw, m[p:p + 4] AS m FROM (
    SELECT kind, id, raw, m, unnest(range(1, len(m) - 3)) AS p FROM made WHERE len(m) >= 5)
), items AS (
  SELECT id AS item_id, m, p AS ip, raw AS iraw, list_transform(raw, lambda x: regexp_replace(x, '^[\x01-\x03]', '')) AS same,
         p - dense_rank() OVER (PARTITION BY id ORDER BY p) AS r FROM wins
  WHERE kind = 'i' AND len(list_filter(m, lambda x: x[1] NOT IN (chr(1), chr(2), chr(3)))) >= 2
), lengths AS (
  SELECT item_id, r, count(DISTINCT ip) >= 5 AS long FROM items GROUP BY ALL
), needs AS (
  SELECT item_id, CASE WHEN bool_or(long) THEN 5 ELSE 1 END AS need FROM lengths GROUP BY item_id
), counted AS (
  SELECT i.*, need FROM items i JOIN lengths USING (item_id, r) JOIN needs USING (item_id) WHERE long OR need = 1
), sized AS (
  SELECT i.*, n FROM counted i JOIN (SELECT item_id, count(DISTINCT same) AS n FROM counted GROUP BY item_id) USING (item_id)
), met AS (
  SELECT w.id AS doc_id, s.item_id, w.p - s.ip AS off, s.ip, s.n, s.need, s.same, w.raw AS draw, s.iraw, s.m,
         s.ip - dense_rank() OVER (PARTITION BY w.id, s.item_id, w.p - s.ip ORDER BY s.ip) AS run
  FROM wins w JOIN sized s ON w.m = s.m WHERE w.kind = 'd'
), stretch AS (
  SELECT * FROM met QUALIFY max(ip) OVER (PARTITION BY doc_id, item_id, off, run) - min(ip) OVER (PARTITION BY doc_id, item_id, off, run) + 1 >= need
), slots AS (
  SELECT doc_id, item_id, off, k, theirs, count(DISTINCT ours) AS vals, max((ours <> theirs)::INT) AS changed FROM (
    SELECT doc_id, item_id, off, m[j] AS k, iraw[j] AS theirs, draw[j] AS ours FROM (
      SELECT *, unnest(range(1, 6)) AS j FROM stretch) WHERE m[j] IN (chr(1), chr(2), chr(3)))
  GROUP BY ALL
), per AS (
  SELECT doc_id, item_id, off, count(*) AS slots, sum((vals > 1)::INT) AS conflicts, sum(changed) AS changed FROM slots GROUP BY ALL
)
SELECT s.doc_id, s.item_id, max(s.n)::BIGINT AS n_windows, count(DISTINCT s.same)::BIGINT AS matched,
       count(DISTINCT s.same) / max(s.n) AS coverage, coalesce(max(p.slots), 0)::BIGINT AS slots, coalesce(max(p.changed), 0)::BIGINT AS changed
FROM stretch s LEFT JOIN per p ON s.doc_id = p.doc_id AND s.item_id = p.item_id AND s.off = p.off
WHERE coalesce(p.conflicts <= p.slots * 0.1, true)
GROUP BY s.doc_id, s.item_id HAVING count(DISTINCT s.same) / max(s.n) >= 0.8
"""


@query("op9_template_leaks", _LEAK_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.leaks import leaks

    return leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("doc_hash")


_BYTES_SQL = """
WITH t AS (SELECT doc_id, row_number() OVER () AS r, hex(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT r, i, md5(substr(x, 2 * i - 1, 400)) AS h FROM (SELECT r, x, unnest(range(1, n - 198)) AS i FROM t WHERE n >= 200)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM starts) WHERE c > 1),
-- a start covers 200 bytes; runs of covered bytes are merged from their starts
edges AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true) AS opens FROM again),
runs AS (SELECT r, min(i) AS lo, max(i) + 199 AS hi FROM (SELECT r, i, sum(opens::INT) OVER (PARTITION BY r ORDER BY i) AS g FROM edges) GROUP BY r, g),
kept AS (SELECT r, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY r ORDER BY lo) AS before FROM runs),
ends AS (SELECT r, count(*) AS n_spans, sum(hi - lo + 1) AS n_removed, max(hi) AS last FROM runs GROUP BY r),
parts AS (SELECT k.r, string_agg(substr(x, 2 * before + 1, 2 * (lo - 1 - before)), '' ORDER BY lo) AS y FROM kept k JOIN t USING (r) GROUP BY k.r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE y || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM t LEFT JOIN ends USING (r) LEFT JOIN parts USING (r)
"""


@query("op4_suffix_dedup", _BYTES_SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.suffixes import without_repeats

    found = without_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


_WORDS_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS o FROM starts) WHERE o > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
words AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS j FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op7_substring_dedup", _WORDS_SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.substrings import without_repeats

    found = without_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'
), o AS (
  SELECT *, row_number() OVER w AS n, lag(role, 1, 'start') OVER w AS before, count(*) OVER (PARTITION BY conv_id) AS total FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 10 + length(role) END + length(text)
           + len(regexp_extract_all(text, '\\|### System:|### User:|### Assistant:|### Role|</turn>')) + 9)::BIGINT AS formatted_chars,
       bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AND (n < total OR role = 'assistant')) AS valid
FROM o GROUP BY conv_id
"""


@query("op1_chat_format", _CHAT_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.chat import chat_digests, chat_segments

    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_digests(chat_segments(turns))


@query("op3_posting_list_neighbours")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.neighbours import neighbours

    return neighbours(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def capture_records(pages: DataFrame) -> DataFrame:
    """Three captures of each page: the page, and two revisits whose validators agree, differ or lack by page id."""
    page, base = F.col("page_id"), F.col("page_id") * 1000
    digest = F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16)
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    text = lambda c: c.cast("string")
    capture = lambda n, kind, at, headers, payload: F.struct(
        (page * 3 + n).alias("record_id"), F.lit(kind).alias("kind"), at.alias("ts"), headers.alias("headers"), payload.alias("payload"))
    first = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), text(F.length("html")), F.lit("ETag"), quoted(digest),
                         F.lit("Last-Modified"), text(base - 500), F.lit("Date"), text(base), F.lit("Cache-Control"), F.lit("max-age=60"))
    again = F.create_map(F.lit("ETag"), F.concat(F.when(page % 2 == 0, "W/").otherwise(""), quoted(digest)), F.lit("Date"), text(base + 400),
                         F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("no-cache"))
    later = (F.when(page % 3 == 0, F.create_map(F.lit("ETag"), quoted(F.substring(F.md5("url"), 1, 16)), F.lit("Date"), text(base + 900)))
             .when(page % 3 == 1, F.create_map(F.lit("Last-Modified"), text(base - 500), F.lit("Expires"), text(base + 99_000)))
             .otherwise(F.create_map(F.lit("Date"), text(base + 900))))
    at = F.when(page % 5 == 0, base - 100).otherwise(base + 400)
    none = F.lit(None).cast("string")
    return pages.select("url", F.explode(F.array(capture(0, "response", base, first, F.col("html")), capture(1, "revisit", at, again, none), capture(2, "revisit", base + 900, later, none))).alias("r")).select("url", "r.*")


_REVISIT_SQL = r"""
WITH r AS (
  SELECT page_id * 3 AS record_id, 'response' AS kind, url, page_id * 1000 AS ts, html AS payload, page_id,
         MAP {'content-type': 'text/html', 'content-length': length(html)::VARCHAR, 'etag': '"' || md5(coalesce(html, ''))[:16] || '"',
              'last-modified': (page_id * 1000 - 500)::VARCHAR, 'date': (page_id * 1000)::VARCHAR, 'cache-control': 'max-age=60'} AS h FROM pages
  UNION ALL
  SELECT page_id * 3 + 1, 'revisit', url, CASE WHEN page_id % 5 = 0 THEN page_id * 1000 - 100 ELSE page_id * 1000 + 400 END, NULL, page_id,
         MAP {'etag': CASE WHEN page_id % 2 = 0 THEN 'W/' ELSE '' END || '"' || md5(coalesce(html, ''))[:16] || '"', 'date': (page_id * 1000 + 400)::VARCHAR,
              'content-length': '0', 'cache-control': 'no-cache'} FROM pages
  UNION ALL
  SELECT page_id * 3 + 2, 'revisit', url, page_id * 1000 + 900, NULL, page_id,
         CASE WHEN page_id % 3 = 0 THEN MAP {'etag': '"' || md5(url)[:16] || '"', 'date': (page_id * 1000 + 900)::VARCHAR}
              WHEN page_id % 3 = 1 THEN MAP {'last-modified': (page_id * 1000 - 500)::VARCHAR, 'expires': (page_id * 1000 + 99000)::VARCHAR}
              ELSE MAP {'date': (page_id * 1000 + 900)::VARCHAR} END FROM pages
), bare AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS b FROM r
), cut AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^[^@]*@', ''), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_filter(string_split(regexp_extract(b, '^[^?]*\?(.*)$', 1), '&'),
           lambda p: NOT regexp_full_match(p, '(utm_[^=&]*|ref|fbclid|gclid)(=[^&]*)?')), '&') AS q FROM bare
), c AS (
  SELECT *, host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url_key FROM cut
), v AS (
  SELECT c.*, f.record_id AS source_id, f.h AS fh, f.payload AS fp
  FROM (SELECT * FROM c WHERE kind = 'revisit') c ASOF LEFT JOIN (SELECT * FROM c WHERE kind = 'response') f ON c.url_key = f.url_key AND c.ts > f.ts
), o AS (
  SELECT *, CASE WHEN source_id IS NULL THEN 'missing'
      WHEN h['etag'] IS NOT NULL AND fh['etag'] IS NOT NULL THEN CASE WHEN regexp_replace(h['etag'], '^W/', '') = regexp_replace(fh['etag'], '^W/', '') THEN 'etag' ELSE 'changed' END
      WHEN h['last-modified'] IS NOT NULL AND fh['last-modified'] IS NOT NULL THEN CASE WHEN h['last-modified'] = fh['last-modified'] THEN 'last-modified' ELSE 'changed' END
      ELSE 'unproven' END AS outcome FROM v
), allowed AS (
  SELECT *, list_filter(map_entries(h), lambda e: e.key IN ('cache-control', 'content-location', 'date', 'etag', 'expires', 'last-modified', 'vary')) AS fresh FROM o
), merged AS (
  SELECT record_id, url_key, ts, outcome, source_id, CASE WHEN outcome IN ('etag', 'last-modified')
      THEN list_concat(list_filter(map_entries(fh), lambda e: NOT list_contains(list_transform(fresh, lambda x: x.key), e.key)), fresh) ELSE map_entries(h) END AS hs,
    CASE WHEN outcome IN ('etag', 'last-modified') THEN fp END AS payload FROM allowed
  UNION ALL SELECT record_id, url_key, ts, 'full', record_id, map_entries(h), payload FROM c WHERE kind = 'response'
)
SELECT record_id, url_key, ts, outcome, source_id, array_to_string(list_sort(list_transform(hs, lambda e: e.key || ': ' || e.value)), chr(10)) AS headers,
       md5(payload) AS payload_md5 FROM merged
"""


@query("op8_revisits", _REVISIT_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.revisits import headers_text, resolved_revisits

    found = resolved_revisits(capture_records(table(spark, sf, "pages")))
    return found.select("record_id", "url_key", "ts", "outcome", "source_id", headers_text(F.col("headers")).alias("headers"), F.md5("payload").alias("payload_md5"))


_HOST_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
runs AS (SELECT r, i, ws[i:i + 2] AS run FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS c FROM runs) WHERE c > 1),
again AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS i FROM twice) GROUP BY r),
c AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM t JOIN w USING (r) LEFT JOIN again USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [word_chars < 3 * n_words, word_chars > 12 * n_words, 100 * n_symbols > 10 * n_words,
         100 * n_dup_lines > 30 * n_lines, 100 * n_repeat_words > 20 * n_words] AS fails FROM c
), rules AS (
  SELECT source, base_failed, unnest(range(0, 6)) AS rule, unnest(list_concat([base_failed], fails)) AS bad FROM f
), hosts AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(bad::INT)::DOUBLE AS k FROM rules GROUP BY ALL
), moments AS (
  SELECT rule, sum(k) / sum(n) AS share, avg(k / n) FILTER (n > 1) AS m, avg(k * (k - 1) / (n * (n - 1))) FILTER (n > 1) AS p FROM hosts GROUP BY rule
), prior AS (
  SELECT rule, coalesce(m, share) AS m, CASE WHEN p - m * m > 0 THEN least(greatest((m - p) / (p - m * m), 2), 10000) ELSE 10000 END AS s FROM moments
), posterior AS (
  SELECT source, rule, n, s, (k + m * s) / (n + s) AS mean FROM hosts JOIN prior USING (rule)
), verdicts AS (
  SELECT source, bool_or(rule = 0 AND low > 0.5) AS host_rejected, list(low > 0.2 ORDER BY rule) AS binds FROM (SELECT *, mean - 2 * sqrt(mean * (1 - mean) / (n + s + 1)) AS low FROM posterior) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected,
       NOT base_failed AND NOT host_rejected AND len(list_filter(list_zip(fails, binds[2:]), lambda x: x[1] AND x[2])) = 0 AS kept
FROM f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.source
"""


@query("op11_host_rules", _HOST_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.hosts import host_rules

    return host_rules(table(spark, sf, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept")


_NEGATIVE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score) WHERE rank <= 10
"""


@query("op12_hard_negatives", _NEGATIVE_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.negatives import hard_negatives

    rows = table(spark, sf, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.whitening import whitened

    return whitened(table(spark, sf, "embeddings"))
