"""Graph queries: each part is a chunk that says what it requires; each supplier asks about a part."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import text as T
from catalog import views as V
from lodestone.operators import graph


def parents(spark, sf):
    p = F.col("p_partkey")
    text = F.concat(
        F.lit("("), "p_name", F.lit(") requires "), "p_type", F.lit(" "), "p_brand", F.lit(" before use. Note: "), "p_type", F.lit(" "), "p_brand",
        F.lit(" REQUIRES size "), F.col("p_size").cast("string"), F.lit("! Nothing else? A requirement, size "), F.col("p_size").cast("string"),
        F.lit(" requires -tools-"))
    return V.table(spark, sf, "part").select(
        F.when(p % 97 == 5, " ").otherwise(F.lpad(p.cast("string"), 8, "0")).alias("parent_chunk_id"), F.concat(F.lit("d"), p).alias("parent_doc_id"),
        F.lit("generic_doc").alias("doc_semantic_type"), "p_name", V.source_of(p).alias("source_type"), F.concat(F.lit(" "), "p_name", F.lit(".")).alias("title"),
        F.when(p % 3 == 0, "").otherwise(F.col("p_brand")).alias("section_heading"), text.alias("text")).drop("p_name")


V.SQL["gparents"] = f"""
SELECT lpad(p_partkey::VARCHAR, 8, '0') AS chunk_id, {V.source_sql('p_partkey')} AS source_type, p_name, p_brand, p_type, p_size, p_partkey % 3 = 0 AS no_section FROM part WHERE p_partkey % 97 <> 5"""


def norm(value):
    return T.NAME_SQL.replace("lower(text)", f"lower({value})")


# the phrases of a chunk in order of their places; what is said follows from how the text is built
V.SQL["phrases"] = """
SELECT chunk_id, 0 AS place, p_name AS name, 'title' AS kind FROM gparents UNION ALL
SELECT chunk_id, 1, p_brand, 'section' FROM gparents WHERE NOT no_section UNION ALL SELECT chunk_id, 2, source_type, 'source_type' FROM gparents UNION ALL
SELECT chunk_id, 3, p_name, 'concept' FROM gparents UNION ALL SELECT chunk_id, 4, p_type || ' ' || p_brand, 'concept' FROM gparents UNION ALL
SELECT chunk_id, 5, 'Note: ' || p_type || ' ' || p_brand, 'concept' FROM gparents UNION ALL SELECT chunk_id, 6, 'size ' || p_size, 'concept' FROM gparents UNION ALL
SELECT chunk_id, 7, 'A requirement, size ' || p_size, 'concept' FROM gparents UNION ALL SELECT chunk_id, 8, 'tools', 'concept' FROM gparents"""
V.SQL["gents"] = f"""
SELECT chunk_id, min(place) AS place, arg_min(name, place) AS name, norm AS normalized_name, arg_min(kind, place) AS entity_type, regexp_replace(norm, '[^a-z0-9]+', '_', 'g') AS entity_id
FROM (SELECT *, {norm('name')} AS norm FROM phrases) GROUP BY chunk_id, norm
QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY min(place)) <= 8"""


@query("f01_extract_entities", V.ctes("gparents", "phrases", "gents") + " SELECT chunk_id, place, entity_id, name, normalized_name, entity_type FROM gents")
def f01(spark, sf):
    return graph.extract_entities(parents(spark, sf))


V.SQL["grels"] = f"""
SELECT s.chunk_id, s.place + 1 AS place, se.entity_id || '__requires__' || te.entity_id AS relation_id, se.entity_id AS src_entity_id, te.entity_id AS tgt_entity_id,
  list_slice(list_filter(string_split(sn || ' requires ' || tn, ' '), lambda w, i: list_position(string_split(sn || ' requires ' || tn, ' '), w) = i), 1, 6) AS keywords
FROM (SELECT a.chunk_id, a.place, {norm('a.name')} AS sn, {norm('b.name')} AS tn FROM phrases a JOIN phrases b ON b.chunk_id = a.chunk_id AND b.place = a.place + 1 WHERE a.place IN (3, 5, 7)) s
JOIN gents se ON se.chunk_id = s.chunk_id AND se.normalized_name = sn JOIN gents te ON te.chunk_id = s.chunk_id AND te.normalized_name = tn"""


@query("f02_extract_requires", V.ctes("gparents", "phrases", "gents", "grels") + " SELECT chunk_id, place, relation_id, array_to_string(keywords, ' ') AS keywords FROM grels")
def f02(spark, sf):
    return graph.extract_requires(parents(spark, sf)).select("chunk_id", "place", "relation_id", F.array_join("keywords", " ").alias("keywords"))


V.SQL["entities"] = "SELECT entity_id, arg_min(name, (chunk_id, place)) AS name, arg_min(normalized_name, (chunk_id, place)) AS normalized_name, arg_min(entity_type, (chunk_id, place)) AS entity_type FROM gents GROUP BY ALL"
V.SQL["rels"] = """
SELECT relation_id, src_entity_id, tgt_entity_id, list_sort(list(DISTINCT w)) AS keywords FROM (SELECT relation_id, src_entity_id, tgt_entity_id, unnest(keywords) AS w FROM grels) GROUP BY ALL"""
V.SQL["rel_chunks"] = "SELECT *, row_number() OVER (PARTITION BY relation_id ORDER BY chunk_id) - 1 AS i FROM (SELECT DISTINCT relation_id, chunk_id FROM grels)"
BUILT = ["gparents", "phrases", "gents", "grels", "entities", "rels", "rel_chunks"]


@query("f03_merge_entities", V.ctes("gparents", "phrases", "gents", "entities") + """
SELECT *, (SELECT count(DISTINCT chunk_id) FROM gents g WHERE g.entity_id = entities.entity_id) AS n_chunks FROM entities""")
def f03(spark, sf):
    found = graph.extract_entities(parents(spark, sf))
    chunks = found.groupBy("entity_id").agg(F.count_distinct("chunk_id").alias("n_chunks"))
    return graph.merge_entities(found).drop("description").join(chunks, "entity_id")


@query("f04_merge_relations", V.ctes(*BUILT) + " SELECT relation_id, src_entity_id, tgt_entity_id, array_to_string(keywords, ' ') AS keywords FROM rels")
def f04(spark, sf):
    return graph.merge_relations(graph.extract_requires(parents(spark, sf))).select(
        "relation_id", "src_entity_id", "tgt_entity_id", F.array_join("keywords", " ").alias("keywords"))


# what a model may extract, read from order lines: a part is an entity with aliases, a part and its supplier are related
def told_lines(spark, sf):
    line, even = F.col("l_linenumber"), F.col("l_linenumber") % 2 == 0
    part, supplier = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    return V.table(spark, sf, "lineitem").select(
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("chunk_id"), line.alias("place"), part.alias("entity_id"), F.concat(F.lit("Part "), line.cast("string")).alias("name"),
        F.concat(F.lit("part "), line.cast("string")).alias("normalized_name"), F.col("l_returnflag").alias("entity_type"),
        F.when(even, F.concat(F.lit("in "), F.col("l_orderkey").cast("string"))).alias("description"), F.array(F.concat(part, "l_returnflag"), F.concat(part, "l_linestatus"), F.lit("")).alias("aliases"),
        F.concat(part, F.lit("__"), supplier).alias("relation_id"), part.alias("src_entity_id"), supplier.alias("tgt_entity_id"), F.col("l_returnflag").alias("relation_type"),
        F.col("l_discount").alias("weight"), F.when(even, F.array("l_returnflag", "l_linestatus")).otherwise(F.array().cast("array<string>")).alias("keywords"))


V.SQL["told"] = """
SELECT lpad(l_orderkey::VARCHAR, 12, '0') AS chunk_id, l_linenumber AS place, 'p' || l_partkey AS entity_id, 's' || l_suppkey AS tgt, l_returnflag AS f, l_linestatus AS s, l_discount AS weight,
  CASE WHEN l_linenumber % 2 = 0 THEN 'in ' || l_orderkey ELSE '' END AS description FROM lineitem"""


@query("f03_merge_told_entities", V.ctes("told") + """
SELECT entity_id, 'Part ' || arg_min(place, (chunk_id, place)) AS name, 'part ' || arg_min(place, (chunk_id, place)) AS normalized_name, arg_min(f, (chunk_id, place)) AS entity_type,
  coalesce(arg_min(description, (chunk_id, place)) FILTER (description <> ''), '') AS description,
  (SELECT string_agg(DISTINCT a, '|' ORDER BY a) FROM (SELECT entity_id AS e, unnest([entity_id || f, entity_id || s]) AS a FROM told) x WHERE x.e = told.entity_id) AS aliases FROM told GROUP BY entity_id""")
def f03_told(spark, sf):
    told = told_lines(spark, sf)
    # at most five aliases a part
    aliases = graph.merge_aliases(told).groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), "|").alias("aliases"))
    return graph.merge_entities(told).join(aliases, "entity_id")


@query("f04_merge_told_relations", V.ctes("told") + """
SELECT entity_id || '__' || tgt AS relation_id, entity_id AS src_entity_id, tgt AS tgt_entity_id, arg_min(f, (chunk_id, place)) AS relation_type, arg_min(description, (chunk_id, place)) AS description,
  arg_min(weight, (chunk_id, place)) AS weight, coalesce((SELECT string_agg(DISTINCT k, '|' ORDER BY k) FROM (SELECT entity_id AS e, tgt AS t, unnest([f, s]) AS k FROM told WHERE place % 2 = 0) x WHERE x.e = told.entity_id AND x.t = told.tgt), '') AS keywords
FROM told GROUP BY entity_id, tgt""")
def f04_told(spark, sf):
    return graph.merge_relations(told_lines(spark, sf)).withColumn("keywords", F.array_join("keywords", "|"))


@query("f05_build_graph", V.ctes(*BUILT) + """
SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(DISTINCT (entity_id, chunk_id)) FROM gents) AS entity_chunks, (SELECT count(*) FROM rels) AS relations,
  (SELECT count(*) FROM rel_chunks) AS relation_chunks, (SELECT count(*) FROM gparents) AS parents""")
def f05(spark, sf):
    built = graph.build_graph(parents(spark, sf))
    counts = {n: getattr(built, n).agg(F.count("*").alias("n")).scalar() for n in ("entity_chunks", "relations", "relation_chunks", "parents")}
    return built.entities.agg(F.count("*").alias("entities")).select("entities", *[c.alias(n) for n, c in counts.items()])


def questions(spark, sf):
    s = F.col("s_suppkey")
    part = V.table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return V.table(spark, sf, "supplier").join(part, s == F.col("p_partkey")).select(
        s.cast("string").alias("query_id"), F.concat(F.lit("Which tools does the "), "p_name", F.lit(" need, "), F.upper("p_type"), F.lit(" "), "p_brand", F.lit("? ask "), V.source_of(s)).alias("query"),
        F.when(s % 2 == 0, F.array(F.upper(V.source_of(s + 1)))).alias("source_hints"))


V.SQL["gquestions"] = f"""
SELECT s_suppkey::VARCHAR AS query_id, 'Which tools does the ' || p_name || ' need, ' || upper(p_type) || ' ' || p_brand || '? ask ' || {V.source_sql('s_suppkey')} AS query,
  CASE WHEN s_suppkey % 2 = 0 THEN {V.source_sql('(s_suppkey + 1)')} END AS hint FROM supplier JOIN part ON p_partkey = s_suppkey"""
V.SQL["seeds"] = f"""
SELECT query_id, entity_id FROM (SELECT query_id, ' ' || {norm('query')} || ' ' AS q FROM gquestions) JOIN entities ON contains(q, ' ' || normalized_name || ' ')"""


@query("f06_seed_entities", V.ctes(*BUILT, "gquestions", "seeds") + " SELECT * FROM seeds")
def f06(spark, sf):
    return graph.seed_entities(questions(spark, sf), graph.build_graph(parents(spark, sf)))


V.SQL["d0"] = "SELECT DISTINCT query_id, relation_id FROM seeds JOIN rels ON entity_id = src_entity_id OR entity_id = tgt_entity_id"
V.SQL["reach"] = """
SELECT query_id, e AS entity_id FROM (SELECT DISTINCT query_id, unnest([src_entity_id, tgt_entity_id]) AS e FROM d0 JOIN rels USING (relation_id)) WHERE (query_id, e) NOT IN (SELECT (query_id, entity_id) FROM seeds)"""
V.SQL["d1"] = "SELECT DISTINCT query_id, relation_id FROM reach JOIN rels ON entity_id = src_entity_id OR entity_id = tgt_entity_id WHERE (query_id, relation_id) NOT IN (SELECT (query_id, relation_id) FROM d0)"
V.SQL["dists"] = "SELECT *, 0 AS depth FROM d0 UNION ALL SELECT *, 1 FROM d1"
WALKED = [*BUILT, "gquestions", "seeds", "d0", "reach", "d1", "dists"]


@query("f07_expand_frontier", V.ctes(*WALKED) + " SELECT * FROM dists")
def f07(spark, sf):
    built = graph.build_graph(parents(spark, sf))
    return graph.expand_frontier(graph.seed_entities(questions(spark, sf), built), built.relations, 2)


V.SQL["rscores"] = f"""
SELECT query_id, relation_id, CASE WHEN o > 0 THEN 0.5 + 0.5 * o + 0.25 * k ELSE 0.35 END / (depth + 1) AS relation_score FROM (
  SELECT query_id, relation_id, depth, len(list_intersect(qt, list_distinct(list_append(keywords, 'requires')))) AS o, len(list_intersect(qt, keywords)) AS k
  FROM dists JOIN rels USING (relation_id) JOIN (SELECT query_id, list_distinct(string_split({norm('query')}, ' ')) AS qt FROM gquestions) USING (query_id))"""


@query("f08_relation_score", V.ctes(*WALKED, "rscores") + " SELECT query_id, relation_id, round(relation_score, 6) AS relation_score FROM rscores")
def f08(spark, sf):
    built = graph.build_graph(parents(spark, sf))
    asked = questions(spark, sf)
    found = graph.expand_frontier(graph.seed_entities(asked, built), built.relations, 2)
    return graph.score_relations(asked, found, built.relations).withColumn("relation_score", F.round("relation_score", 6))


V.SQL["cscores"] = """
SELECT query_id, chunk_id, round(sum(score), 9) AS score, string_agg(DISTINCT e, '|' ORDER BY e) AS es, string_agg(DISTINCT r, '|' ORDER BY r) AS rs FROM (
  SELECT query_id, chunk_id, 2.0::DOUBLE AS score, entity_id AS e, NULL AS r FROM seeds JOIN (SELECT DISTINCT entity_id, chunk_id FROM gents) USING (entity_id) UNION ALL
  SELECT query_id, chunk_id, relation_score * CASE WHEN i < 5 THEN 1.0::DOUBLE - i * 0.2::DOUBLE ELSE 0.1 END, NULL, relation_id FROM rscores JOIN rel_chunks USING (relation_id)) GROUP BY ALL"""


@query("f09_score_chunks", V.ctes(*WALKED, "rscores", "cscores") + " SELECT query_id, chunk_id, round(score, 6) AS score FROM cscores")
def f09(spark, sf):
    return graph.score_chunks(questions(spark, sf), graph.build_graph(parents(spark, sf)), 2).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("f10_graph_search", V.ctes(*WALKED, "rscores", "cscores") + """
SELECT query_id, chunk_id AS item_id, rank::INTEGER AS rank, round(score, 6) AS score, coalesce(es, '') AS matched_entities, coalesce(rs, '') AS matched_relations FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT c.query_id, chunk_id, round(score + CASE WHEN hint = source_type THEN 0.15 ELSE 0 END, 9) AS score, es, rs FROM cscores c JOIN gparents USING (chunk_id) JOIN gquestions USING (query_id))) WHERE rank <= 20""")
def f10(spark, sf):
    found = graph.graph_search(questions(spark, sf), graph.build_graph(parents(spark, sf)), 20, 2)
    return found.select("query_id", "item_id", "rank", F.round("score", 6).alias("score"), F.array_join("matched_entities", "|").alias("matched_entities"),
                        F.array_join("matched_relations", "|").alias("matched_relations"))


V.SQL["near"] = V.SQL["rscores"].replace("FROM dists JOIN", "FROM (SELECT *, 0 AS depth FROM d0) dists JOIN")
V.SQL["near_scores"] = V.SQL["cscores"].replace("FROM rscores JOIN", "FROM near JOIN")


@query("f10_graph_search_depth1", V.ctes(*BUILT, "gquestions", "seeds", "d0", "near", "near_scores") + """
SELECT query_id, chunk_id AS item_id, rank::INTEGER AS rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT c.query_id, chunk_id, round(score + CASE WHEN hint = source_type THEN 0.15 ELSE 0 END, 9) AS score FROM near_scores c JOIN gparents USING (chunk_id) JOIN gquestions USING (query_id))) WHERE rank <= 20""")
def f10_near(spark, sf):
    found = graph.graph_search(questions(spark, sf), graph.build_graph(parents(spark, sf)), 20, 1)
    return found.select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))
