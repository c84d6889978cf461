"""Sampling and chunking queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from catalog import metrics, query
from catalog import text as T
from catalog import views as V
from lodestone import model
from lodestone.operators import chunking, sampling, summaries
from lodestone.plans import grid


def gold_ids(spark, sf):
    """The gold documents of all passages, and one id per passage that is in no corpus."""
    missing = V.table(spark, sf, "benchmark").select(F.concat(F.lit("missing-"), F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("doc_id"))
    return V.passage_gold(spark, sf).select(F.col("item_id").alias("doc_id")).unionByName(missing)


def normalized(spark, sf):
    return sampling.normalize_documents(V.docs(spark, sf), gold_ids(spark, sf))


V.SQL["gold_ids"] = """
SELECT DISTINCT item_id AS doc_id FROM passage_gold UNION ALL SELECT 'missing-' || lpad(item_id::VARCHAR, 6, '0') FROM benchmark"""
V.SQL["doc_full"] = f"""
SELECT d.doc_id, d.source_type, {T.sql_clean('d.title')} AS title, {T.sql_clean('d.content')} AS content, t.text,
  {T.sql_semantic_type('d.source_type', 'd.title', 'd.content')} AS doc_semantic_type,
  d.doc_id IN (SELECT doc_id FROM gold_ids) AS is_gold FROM docs d JOIN doc_texts t USING (doc_id)"""
GOLD = ["passage_keys", "passage_gold", "gold_ids", "docs"]


@query("b05_normalize_documents", V.ctes(*GOLD, "doc_texts", "doc_full") + """
SELECT doc_id, source_type, title, md5(content) AS content, md5(text) AS text, doc_semantic_type, is_gold,
  length(content)::INTEGER AS content_chars, length(text)::INTEGER AS text_chars FROM doc_full""")
def b05(spark, sf):
    return normalized(spark, sf).withColumn("content", F.md5("content")).withColumn("text", F.md5("text"))


def sql_literal(text: str) -> str:
    quoted = [f"'{part}'" for part in text.split("\n")]
    return "(" + " || chr(10) || ".join(quoted) + ")"


def sql_pack(pieces: str, size: int, glue: str) -> str:
    """Greedy packing as a fold over structs of finished pieces and the open one."""
    joined = f"(s.open || {glue} || p.open)"
    return f"""(CASE WHEN len({pieces}) = 0 THEN []::VARCHAR[] ELSE list_transform([list_reduce(list_transform({pieces}, lambda x: {{'done': []::VARCHAR[], 'open': x}}),
      lambda s, p: CASE WHEN length({joined}) <= {size} THEN {{'done': s.done, 'open': {joined}}}
      ELSE {{'done': list_append(s.done, s.open), 'open': p.open}} END)], lambda r: list_append(r.done, r.open))[1] END)"""


def split_ctes(source: str, size: int, separators: list[str], name: str) -> tuple[str, str]:
    """One CTE per separator; ``source`` has (id, ord, c).  Returns the CTEs and the name of the last."""
    parts = [f"{name}_0 AS (SELECT id, ord, {T.sql_strip('c')} AS c FROM {source})"]
    for number, separator in enumerate(separators, 1):
        if separator == "":
            cut = f"list_transform(range(0, length(c), {size}), lambda i: substr(c, i + 1, {size}))"
        else:
            mark = sql_literal(separator)
            pieces = (f"list_filter(list_transform(string_split(c, {mark}), lambda x, i: CASE WHEN i = 1 THEN x ELSE {mark} || x END), lambda x: x <> '')")
            cut = sql_pack(pieces, size, "''")
        parts.append(f"""{name}_{number} AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY ord, sub) AS ord, {T.sql_strip('c')} AS c FROM (
  SELECT id, ord, unnest(l) AS c, generate_subscripts(l, 1) AS sub FROM (SELECT id, ord, CASE WHEN length(c) <= {size} THEN [c] ELSE {cut} END AS l FROM {name}_{number - 1} WHERE c <> '')) WHERE {T.sql_strip('c')} <> '')""")
    return ",\n".join(parts), f"{name}_{len(separators)}"


def overlap_sql(chunks: str, overlap: int) -> str:
    """Overlapped and cleaned chunks of (id, ord, c), numbered from 0, blanks dropped after numbering."""
    prefix = T.sql_strip(f"right(lag(c) OVER (PARTITION BY id ORDER BY ord), {overlap})")
    return f"""SELECT id, i, {T.sql_clean('t')} AS t FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS i,
  CASE WHEN coalesce(prefix, '') = '' THEN c ELSE {T.sql_strip("prefix || chr(10) || chr(10) || c")} END AS t FROM (SELECT *, {prefix} AS prefix FROM {chunks})) WHERE {T.sql_clean('t')} <> ''"""


def heading_sql(text: str) -> str:
    lines = f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {T.sql_strip('x')}), lambda x: regexp_matches(x, '{model.SECTION_LINE}'))"
    return f"coalesce(left(list_extract({lines}, 1), 120), '')"


V.SQL["to_split"] = "SELECT doc_id AS id, 1 AS ord, text AS c FROM doc_full"
FULL = [*GOLD, "doc_texts", "doc_full", "to_split"]


def flat_sql(size: int, overlap: int, separators: list[str]) -> str:
    levels, last = split_ctes("to_split", size, separators, "s")
    return f"""{V.ctes(*FULL)}, {levels}, cut AS ({overlap_sql(last, overlap)})
SELECT id || '::chunk_' || lpad(i::VARCHAR, 4, '0') AS chunk_id, doc_id AS parent_doc_id, source_type, doc_semantic_type, title, i::INTEGER AS chunk_index,
  {heading_sql('t')} AS section_heading, md5(t) AS text, length(t)::INTEGER AS text_chars, is_gold AS is_gold_parent FROM cut JOIN doc_full ON id = doc_id"""


def parent_ctes(size: int, overlap: int, tag: str = "") -> str:
    """``parents{tag}``: the parent chunks of all documents."""
    levels, last = split_ctes("to_split", size, model.STRUCTURE_SEPARATORS, f"s{tag}")
    return f"""{levels}, cut{tag} AS ({overlap_sql(last, overlap)}),
parents{tag} AS (SELECT id || '::parent_' || lpad(i::VARCHAR, 4, '0') AS parent_chunk_id, doc_id AS parent_doc_id, source_type, doc_semantic_type, title,
  i::INTEGER AS parent_chunk_index, {heading_sql('t')} AS heading, t, is_gold FROM cut{tag} JOIN doc_full ON id = doc_id)"""


def child_ctes(size: int, overlap: int, mode: str, parents: str = "parents", tag: str = "") -> str:
    """``kids{tag}``: (id of the parent, i, t), cut by size or by semantic units."""
    if mode == "recursive":
        levels, last = split_ctes(f"ptext{tag}", size, model.STRUCTURE_SEPARATORS, f"k{tag}")
        return f"ptext{tag} AS (SELECT parent_chunk_id AS id, 1 AS ord, t AS c FROM {parents}), {levels}, kids{tag} AS ({overlap_sql(last, overlap)})"
    own = {name: re.sub(r"\b(notes|units)\b", rf"\1{tag}", V.SQL[name]) for name in ("units", "to_cut")}
    levels, last = split_ctes(f"to_cut{tag}", size, model.STRUCTURE_SEPARATORS, f"k{tag}")
    return f"""notes{tag} AS (SELECT parent_chunk_id AS conv_id, doc_semantic_type AS kind, t AS text FROM {parents}),
units{tag} AS ({own["units"]}), to_cut{tag} AS ({own["to_cut"]}), {levels},
listed{tag} AS (SELECT id, list(c ORDER BY ord) AS l, id IN (SELECT id FROM to_cut{tag} WHERE found) AS found FROM {last} GROUP BY id),
pieces{tag} AS (SELECT id, unnest(l) AS c, generate_subscripts(l, 1) AS ord FROM (SELECT id, CASE WHEN found THEN {sql_pack('l', size, 'chr(10)')} ELSE l END AS l FROM listed{tag})),
kids{tag} AS ({overlap_sql(f"pieces{tag}", overlap)})"""


def nested_sql(mode: str = "recursive", docs: str | None = None, sizes: tuple[int, int, int, int] = (3000, 300, 700, 100)) -> str:
    return f"""{V.ctes(*FULL) if docs is None else docs}, {parent_ctes(*sizes[:2])}, {child_ctes(*sizes[2:], mode, tag='_c')}
SELECT k.id || '::child_' || lpad(k.i::VARCHAR, 4, '0') AS chunk_id, parent_chunk_id, parent_doc_id, source_type, doc_semantic_type, title, parent_chunk_index,
  k.i::INTEGER AS child_chunk_index, CASE WHEN {heading_sql('k.t')} <> '' THEN {heading_sql('k.t')} ELSE heading END AS section_heading, md5(k.t) AS text,
  length(k.t)::INTEGER AS text_chars, length(p.t)::INTEGER AS parent_text_chars, is_gold AS is_gold_parent FROM kids_c k JOIN parents p ON p.parent_chunk_id = k.id"""


# all gold documents and a tenth of the corpus
V.SQL["sampled"] = """
SELECT doc_id, source_type, true AS is_gold FROM docs SEMI JOIN gold_ids USING (doc_id) UNION ALL
SELECT doc_id, source_type, false FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r FROM docs ANTI JOIN gold_ids USING (doc_id))
WHERE r <= (SELECT count(*) // 10 FROM docs)"""


def sampled(spark, sf):
    docs = V.docs(spark, sf).select("doc_id", "source_type")
    gold = gold_ids(spark, sf)
    return sampling.sample_gold_plus_background(docs, gold, gold.count() + docs.count() // 10)


@query("c01_sample_gold_plus_background", V.ctes(*GOLD, "sampled") + " SELECT * FROM sampled")
def c01(spark, sf):
    return sampling.in_sample_order(sampled(spark, sf))


@query("c02_sample_stats", V.ctes(*GOLD, "sampled") + """
SELECT (SELECT count(*) FROM docs) AS total_dataset_documents, (SELECT count(*) FROM sampled) AS sampled_documents,
  (SELECT count(*) FROM gold_ids) AS gold_doc_ids_from_questions, (SELECT count(*) FROM sampled WHERE is_gold) AS gold_documents_found,
  (SELECT count(*) FROM gold_ids ANTI JOIN docs USING (doc_id)) AS missing_gold_documents,
  (SELECT string_agg(doc_id, '|' ORDER BY doc_id) FROM (SELECT doc_id FROM gold_ids ANTI JOIN docs USING (doc_id) ORDER BY doc_id LIMIT 50)) AS missing_gold_doc_ids,
  (SELECT count(*) FROM sampled WHERE NOT is_gold) AS background_documents""")
def c02(spark, sf):
    stats = sampling.sample_stats(V.docs(spark, sf), gold_ids(spark, sf), sampled(spark, sf))
    return stats.withColumn("missing_gold_doc_ids", F.array_join("missing_gold_doc_ids", "|"))


@query("c02_source_distribution", V.ctes("docs") + " SELECT source_type, count(*) AS documents FROM docs GROUP BY ALL")
def c02_sources(spark, sf):
    return sampling.source_distribution(V.docs(spark, sf))


SPLIT_700, LAST_700 = split_ctes("to_split", 700, model.STRUCTURE_SEPARATORS, "s")


@query("c03_recursive_split", f"""{V.ctes(*FULL)}, {SPLIT_700}
SELECT id AS doc_id, (row_number() OVER (PARTITION BY id ORDER BY ord) - 1)::INTEGER AS i, length(c)::INTEGER AS chars, md5(c) AS digest FROM {LAST_700}""")
def c03(spark, sf):
    pieces = normalized(spark, sf).select("doc_id", chunking.recursive_split(F.col("text"), 700).alias("pieces"))
    return pieces.select("doc_id", F.posexplode("pieces").alias("i", "piece")).select(
        "doc_id", "i", F.length("piece").alias("chars"), F.md5("piece").alias("digest"))


# lines stand for chunks, so that SQL can follow
V.SQL["line_chunks"] = f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i, line FROM (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {T.sql_strip('x')}), lambda x: x <> '') AS l FROM documents))"""


def line_arrays(spark, sf):
    pieces = F.filter(F.transform(F.split("text", "\n"), chunking.strip), lambda x: x != "")
    return V.table(spark, sf, "documents").select("doc_id", pieces.alias("pieces"))


@query("c04_add_overlap", V.ctes("line_chunks") + f"""
SELECT doc_id, i::INTEGER AS i, md5(CASE WHEN i = 0 OR prefix = '' THEN line ELSE {T.sql_strip("prefix || chr(10) || chr(10) || line")} END) AS digest FROM (
  SELECT *, {T.sql_strip("right(lag(line) OVER (PARTITION BY doc_id ORDER BY i), 40)")} AS prefix FROM line_chunks)""")
def c04(spark, sf):
    rows = line_arrays(spark, sf).withColumn("pieces", chunking.add_overlap("pieces", 40))
    return rows.select("doc_id", F.posexplode("pieces").alias("i", "piece")).select("doc_id", "i", F.md5("piece").alias("digest"))


# conversations as meeting notes, faqs and tickets: each message becomes a labelled block of lines
LABELS = ["Decision: ", "Q: ", "Impact: ", "1. ", "## "]
KINDS = ["meeting_notes", "faq", "issue_ticket", "policy_rule", "technical_doc", "playbook", "generic_doc"]
V.SQL["notes"] = f"""
SELECT conv_id, list_extract({KINDS}, (conv_id % 7 + 1)::INTEGER) AS kind, string_agg(CASE WHEN turn % 2 = 0 THEN list_extract({LABELS}, ((conv_id + turn) % 5 + 1)::INTEGER) ELSE '' END || text, chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id"""


def notes(spark, sf):
    talk = V.table(spark, sf, "conversations")
    label = F.get(F.array(*[F.lit(x) for x in LABELS]), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)).cast("int"))
    block = F.concat(F.when(F.col("turn") % 2 == 0, label).otherwise(""), F.col("text"))
    kind = F.get(F.array(*[F.lit(x) for x in KINDS]), F.pmod("conv_id", F.lit(7)).cast("int"))
    grouped = talk.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("blocks"))
    return grouped.select("conv_id", kind.alias("kind"), F.array_join(F.transform("blocks", lambda x: x["b"]), "\n\n").alias("text"))


OPENS = " ".join(f"WHEN '{k}' THEN regexp_matches(line, '(?i){p}')" for k, p in model.UNIT_OPENERS.items())
V.SQL["units"] = f"""
SELECT conv_id, unit, string_agg(line, chr(10) ORDER BY i) AS raw, bool_or(opened) OVER (PARTITION BY conv_id) AS found FROM (
  SELECT *, sum(o::INTEGER) OVER (PARTITION BY conv_id ORDER BY i) AS unit, bool_or(o) OVER (PARTITION BY conv_id) AS opened FROM (
    SELECT conv_id, i, line, coalesce(CASE kind {OPENS} ELSE false END, false) AS o FROM (SELECT conv_id, kind, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (
      SELECT conv_id, kind, list_transform(string_split({T.sql_strip('text')}, chr(10)), lambda x: {T.sql_strip('x')}) AS l FROM notes)))) GROUP BY conv_id, unit, opened"""


@query("c05_semantic_units", V.ctes("notes", "units") + f"""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY unit)::INTEGER - 1 AS i, md5({T.sql_strip('raw')}) AS digest FROM units WHERE found AND {T.sql_strip('raw')} <> ''""")
def c05(spark, sf):
    found = notes(spark, sf).select("conv_id", F.posexplode(chunking.semantic_units(F.col("text"), F.col("kind"))).alias("i", "unit"))
    return found.select("conv_id", "i", F.md5("unit").alias("digest"))


V.SQL["to_cut"] = f"""
SELECT conv_id AS id, unit AS ord, {T.sql_strip('raw')} AS c, found FROM units WHERE found AND {T.sql_strip('raw')} <> ''
UNION ALL SELECT conv_id, 0, text, false FROM notes WHERE conv_id NOT IN (SELECT conv_id FROM units WHERE found)"""
CUT_300, CUT_LAST = split_ctes("to_cut", 300, model.STRUCTURE_SEPARATORS, "s")


@query("c06_semantic_child_split", f"""{V.ctes("notes", "units", "to_cut")}, {CUT_300},
listed AS (SELECT id, list(c ORDER BY ord) AS l, id IN (SELECT id FROM to_cut WHERE found) AS found FROM {CUT_LAST} GROUP BY id),
merged AS (SELECT id, CASE WHEN found THEN {sql_pack('l', 300, 'chr(10)')} ELSE l END AS l FROM listed)
SELECT id AS conv_id, (i - 1)::INTEGER AS i, length(c)::INTEGER AS chars, md5(c) AS digest FROM (SELECT id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM merged)""")
def c06(spark, sf):
    split = chunking.with_semantic_children(notes(spark, sf), 300, kind="kind")
    return split.select("conv_id", F.posexplode("pieces").alias("i", "piece")).select(
        "conv_id", "i", F.length("piece").alias("chars"), F.md5("piece").alias("digest"))


def digested(chunks):
    return chunks.withColumn("text", F.md5("text"))


@query("c07_chunk_structured", flat_sql(1200, 150, model.STRUCTURE_SEPARATORS))
def c07(spark, sf):
    return digested(chunking.chunk_structured(normalized(spark, sf)))


@query("c08_chunk_parent_child", nested_sql())
def c08(spark, sf):
    return digested(chunking.chunk_parent_child(normalized(spark, sf))[1])


@query("c08_chunk_parent_child_semantic", nested_sql("semantic"))
def c08_semantic(spark, sf):
    return digested(chunking.chunk_parent_child(normalized(spark, sf), mode="semantic")[1])


NOTE_DOCS = f"""{V.ctes("notes")}, doc_full AS (SELECT conv_id::VARCHAR AS doc_id, kind AS source_type, 'note' AS title, text, kind AS doc_semantic_type, false AS is_gold FROM notes),
to_split AS ({V.SQL["to_split"]})"""


@query("c08_chunk_parent_child_semantic_notes", nested_sql("semantic", NOTE_DOCS, (900, 90, 300, 40)))
def c08_notes(spark, sf):
    docs = notes(spark, sf).select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("kind").alias("source_type"), F.lit("note").alias("title"), "text", F.col("kind").alias("doc_semantic_type"), F.lit(False).alias("is_gold"))
    return digested(chunking.chunk_parent_child(docs, 900, 90, 300, 40, "semantic")[1])


@query("c10_chunk_uploads", flat_sql(200, 20, model.UPLOAD_SEPARATORS))
def c10(spark, sf):
    return digested(chunking.chunk_uploads(normalized(spark, sf)))


@query("c09_chunk_stats", V.ctes("line_chunks") + """
SELECT lang, count(DISTINCT doc_id) AS documents, count(line) AS total_chunks, coalesce(round(avg(length(line)), 2), 0) AS average_chunk_chars,
  coalesce(min(length(line)), 0)::INTEGER AS min_chunk_chars, coalesce(max(length(line)), 0)::INTEGER AS max_chunk_chars,
  round(count(line) / count(DISTINCT doc_id), 2) AS average_chunks_per_doc
FROM documents LEFT JOIN line_chunks USING (doc_id) GROUP BY lang""")
def c09(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "lang")
    chunks = line_arrays(spark, sf).select("doc_id", F.explode("pieces").alias("text"))
    return chunking.chunk_stats(docs, chunks.join(docs, "doc_id").withColumn("text_chars", F.length("text")), ["lang"])


@query("c09_chunk_stats_total", V.ctes("line_chunks") + """
SELECT count(DISTINCT doc_id) AS documents, count(line) AS total_chunks, round(avg(length(line)), 2) AS average_chunk_chars,
  min(length(line))::INTEGER AS min_chunk_chars, max(length(line))::INTEGER AS max_chunk_chars, round(count(line) / count(DISTINCT doc_id), 2) AS average_chunks_per_doc
FROM documents LEFT JOIN line_chunks USING (doc_id)""")
def c09_total(spark, sf):
    chunks = line_arrays(spark, sf).select("doc_id", F.explode("pieces").alias("text"))
    return chunking.chunk_stats(V.table(spark, sf, "documents").select("doc_id"), chunks.withColumn("text_chars", F.length("text")))


# ten neighbouring vectors form a document; the threshold suits random vectors
@query("c11_merge_similar_neighbours", """
SELECT doc_id, merged_index::INTEGER AS merged_index, count(*) AS n_merged, string_agg('v' || vec_id, ' ' ORDER BY vec_id) AS text FROM (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY vec_id) - 1 AS merged_index FROM (
    SELECT vec_id, vec_id // 10 AS doc_id, (NOT coalesce(list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id)) > 0.05, false))::INTEGER AS opens
    FROM embeddings)) GROUP BY ALL""")
def c11(spark, sf):
    chunks = V.table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 10).alias("doc_id"), F.col("vec_id").alias("chunk_index"),
        F.concat(F.lit("v"), "vec_id").alias("text"), "embedding")
    return chunking.merge_similar_neighbours(chunks, 0.05)


V.SQL["prints"] = """
SELECT count(*) AS n_ids, sum(('0x' || substr(md5(id), 1, 8))::BIGINT)::BIGINT AS hash_sum, bit_xor(('0x' || substr(md5(id), 9, 8))::BIGINT) AS hash_xor FROM (SELECT {key}::VARCHAR AS id FROM {table})"""


def print_sql(table, key):
    return V.SQL["prints"].format(key=key, table=table)


@query("c12_sample_fingerprint", f"SELECT 'doc_id' AS id_key, * FROM ({print_sql('documents', 'doc_id')}) UNION ALL SELECT 'item_id', * FROM ({print_sql('benchmark', 'item_id')})")
def c12(spark, sf):
    return sampling.sample_fingerprint(V.table(spark, sf, "documents").select("doc_id"), "doc_id").unionByName(
        sampling.sample_fingerprint(V.table(spark, sf, "benchmark").select("item_id"), "item_id"))


@query("c13_assert_same_sample", """
SELECT 2::BIGINT AS runs, count(DISTINCT s) = 1 AS same FROM (SELECT list(doc_id ORDER BY doc_id) AS s FROM documents UNION ALL SELECT list(doc_id ORDER BY doc_id) FROM documents WHERE n_chars >= 0)""")
def c13(spark, sf):
    first = sampling.sample_fingerprint(V.table(spark, sf, "documents").select("doc_id"), "doc_id")
    second = sampling.sample_fingerprint(V.table(spark, sf, "documents").filter("n_chars >= 0").select("doc_id"), "doc_id")
    return sampling.assert_same_sample(first.unionByName(second), ["n_ids", "hash_sum", "hash_xor"])


PROFILES = model.FIXED_PROFILES + model.SEMANTIC_PROFILES
GRID_KS = [1, 5, 10, 20]


def grid_sql() -> str:
    """Chunks of every profile, a search over each, and its ranking, under the names that the metric views read."""
    sizes = sorted({(p[1], p[2]) for p in PROFILES})
    tag = {size: f"_{n}" for n, size in enumerate(sizes)}
    parts = [parent_ctes(*size, tag[size]) for size in sizes]
    parts += [child_ctes(p[3], p[4], p[5], "parents" + tag[p[1], p[2]], f"_p{n}") for n, p in enumerate(PROFILES)]
    kids = " UNION ALL ".join(f"SELECT '{p[0]}' AS profile, id || '::child_' || lpad(i::VARCHAR, 4, '0') AS item_id, t AS text FROM kids_p{n}" for n, p in enumerate(PROFILES))
    names = ", ".join(f"'{p[0]}'" for p in PROFILES)
    bm25 = V.bm25_sql("gitems", "questions", V.CHILD_SQL, 50)
    bm25["toks"] = bm25["toks"].replace("SELECT item_id", "SELECT profile, item_id")
    bm25["corpus"] = bm25["corpus"].replace("SELECT ", "SELECT profile, ") + " GROUP BY profile"
    bm25["posts"] = bm25["posts"].replace("SELECT item_id", "SELECT profile, item_id")
    bm25["dfs"] = "SELECT profile, term, count(*) AS df FROM posts GROUP BY ALL"
    bm25["scored"] = bm25["scored"].replace("SELECT query_id", "SELECT profile, query_id").replace("JOIN dfs USING (term), corpus", "JOIN dfs USING (profile, term) JOIN corpus USING (profile)")
    bm25["bm25"] = bm25["bm25"].replace("PARTITION BY query_id", "PARTITION BY profile, query_id")
    parts += [f"gitems AS ({kids})", f"profiles AS (SELECT unnest([{names}]) AS profile)", *(f"{name} AS ({body})" for name, body in bm25.items())]
    covered = metrics.V.SQL["coverage"].replace("ranking", "evidence")
    parts += [f"""asked AS (SELECT profile, profile || '|' || item_id AS question_id, CASE item_id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'unknown' ELSE 'list' END AS question_type, 0.0::DOUBLE AS latency_ms
  FROM benchmark, profiles)""", """ranking AS (SELECT profile || '|' || query_id AS question_id, doc AS item_id, row_number() OVER (PARTITION BY profile, query_id ORDER BY rank) AS rank
  FROM (SELECT profile, query_id, split_part(item_id, '::', 1) AS doc, min(rank) AS rank FROM bm25 GROUP BY ALL))""",
              "returned AS (SELECT profile || '|' || question_id AS question_id, item_id FROM passage_gold, profiles)",
              """evidence AS (SELECT profile || '|' || query_id AS question_id, rank, unnest([item_id, split_part(item_id, '::', 1), split_part(item_id, '::', 1) || '::' || split_part(item_id, '::', 2)]) AS item_id FROM bm25)""",
              """evidence_groups AS (SELECT question_id, 'document' AS group_id, item_id AS evidence_id FROM returned UNION ALL SELECT question_id, 'second', item_id || '::parent_0001' FROM returned)"""]
    parts += [f"{name} AS ({V.SQL[name]})" for name in ("hits", "numbered", "expected", "counted", "metrics", "tall", "kept")] + [f"coverage AS ({covered})"]
    return V.ctes(*FULL, "questions") + ", " + ", ".join(parts)


def grouped_sql(groups: str, tall: str, coverage: str) -> str:
    """(keys, metric, k, value) of relations with the key columns ``groups``."""
    return f"""SELECT {groups}, metric, k, avg(value) AS value FROM {tall} WHERE metric <> 'ap' GROUP BY ALL
UNION ALL SELECT {groups}, 'questions', 0, count(DISTINCT question_id)::DOUBLE FROM {tall} GROUP BY ALL
UNION ALL SELECT {groups}, 'average_latency_ms', 0, 0.0 FROM {tall} GROUP BY ALL{coverage}"""


COVERED_BY = """
UNION ALL SELECT {groups}, 'evidence_coverage', k, avg(evidence_coverage) FROM coverage JOIN asked USING (question_id) WHERE n_groups > 0 GROUP BY ALL"""


def headline_sql(keys: str, rows: str, digits: int) -> str:
    picks = [("questions", 0, "questions"), ("recall", 10, "recall_10"), ("evidence_coverage", 10, "coverage_10"), ("hit", 5, "hit_5"), ("mrr", 20, "mrr"), ("ndcg", 10, "ndcg_10"), ("average_latency_ms", 0, "average_latency_ms")]
    return f"SELECT {keys}, " + ", ".join(f"round(max(value) FILTER (metric = '{m}' AND k = {k}), {digits}) AS {name}" for m, k, name in picks) + f" FROM ({rows}) GROUP BY ALL"


def run_grid(spark, sf):
    """Each gold document is evidence as a whole, and so is its second parent chunk."""
    gold = V.passage_gold(spark, sf).withColumnRenamed("item_id", "doc_id")
    n = F.pmod(F.col("query_id").cast("long"), F.lit(3))
    questions = V.questions(spark, sf).withColumn("question_type", F.when(n == 0, "fact").when(n == 1, "").otherwise("list"))
    whole = gold.select("question_id", F.lit("document").alias("group_id"), F.col("doc_id").alias("evidence_id"))
    second = gold.select("question_id", F.lit("second").alias("group_id"), F.concat("doc_id", F.lit("::parent_0001")).alias("evidence_id"))
    return grid.run_profile_grid(normalized(spark, sf), questions, gold, PROFILES, GRID_KS, evidence=whole.unionByName(second))


BY_PROFILE = grouped_sql("profile", "(SELECT * FROM kept JOIN asked USING (question_id))", COVERED_BY.format(groups="profile"))


@query("c14_run_profile_grid", grid_sql() + f"""
SELECT profile, metric, k, round(value, 4) AS value FROM ({BY_PROFILE}) UNION ALL
SELECT profile, 'evidence_coverage_questions', 0, count(*)::DOUBLE FROM coverage JOIN asked USING (question_id) WHERE n_groups > 0 AND k = 20 GROUP BY ALL""")
def c14(spark, sf):
    return run_grid(spark, sf).summary


SIZES = {size: n for n, size in enumerate(sorted({(p[1], p[2]) for p in PROFILES}))}
STATS = " UNION ALL ".join(f"""SELECT '{p[0]}' AS profile, (SELECT count(*) FROM kids_p{n}) AS total_child_chunks, (SELECT round(avg(length(t)), 2) FROM kids_p{n}) AS average_child_chunk_chars,
  (SELECT max(length(t))::INTEGER FROM kids_p{n}) AS max_child_chunk_chars, count(*) AS total_parent_chunks, round(avg(length(t)), 2) AS average_parent_chunk_chars,
  max(length(t))::INTEGER AS max_parent_chunk_chars FROM parents_{SIZES[p[1], p[2]]}""" for n, p in enumerate(PROFILES))


@query("g17_compare_profiles", grid_sql() + f", head AS ({headline_sql('profile', BY_PROFILE, 4)}), stats AS ({STATS}) SELECT * FROM head JOIN stats USING (profile)")
def g17(spark, sf):
    run = run_grid(spark, sf)
    return summaries.compare_profiles(run.summary, run.stats, GRID_KS)


# gold by type: the metric views once more, with the type as part of the question
BY_TYPE = """, typed AS (SELECT r.question_id, item_id, coalesce(nullif(doc_semantic_type, ''), 'generic_doc') AS grp FROM returned r JOIN doc_full ON doc_id = item_id),
asked_t AS (SELECT DISTINCT split_part(question_id, '|', 1) AS profile, question_id || '|' || grp AS question_id, grp FROM typed),
returned_t AS (SELECT question_id || '|' || grp AS question_id, item_id FROM typed),
ranking_t AS (SELECT p.question_id || '|' || grp AS question_id, item_id, rank FROM (SELECT DISTINCT question_id, grp FROM typed) p JOIN ranking r ON r.question_id = p.question_id), """ + ", ".join(
    f"{name}_t AS (" + re.sub(r"\b(asked|returned|ranking|hits|numbered|expected|counted|metrics|tall)\b(?!\()", r"\1_t", V.SQL[name]) + ")" for name in ("hits", "numbered", "expected", "counted", "metrics", "tall", "kept"))


@query("g17_compare_profile_types", grid_sql() + BY_TYPE + ", q AS (" + headline_sql("profile, question_type AS grp", grouped_sql(
    "profile, question_type", "(SELECT * FROM kept JOIN asked USING (question_id))", COVERED_BY.format(groups="profile, question_type")), 6)
    + "), d AS (" + headline_sql("profile, grp", grouped_sql("profile, grp", "(SELECT * FROM kept_t JOIN asked_t USING (question_id))", ""), 6)
    + """) SELECT 'question_type' AS kind, * RENAME (grp AS "group") FROM q UNION ALL SELECT 'doc_semantic_type', * FROM d""")
def g17_types(spark, sf):
    run = run_grid(spark, sf)
    both = [summaries.compare_profile_types(rows, GRID_KS).withColumn("kind", F.lit(kind)) for kind, rows in (("question_type", run.question_types), ("doc_semantic_type", run.doc_types))]
    shown = both[0].unionByName(both[1])
    return shown.select("kind", "profile", "group", *[F.round(c, 6).alias(c) for c in shown.columns if c not in ("kind", "profile", "group")])
