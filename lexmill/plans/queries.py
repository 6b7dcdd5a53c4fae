"""The registered queries of the document operators, each with SQL that tells its rows from the source tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunks, citations, guidance, numbering, pages, sections, trace
from ..sources import corpora
from . import profiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_name"), "text")


# SQL for normalised text

_HYPHEN = r"'([\p{L}\p{M}\p{N}_])[ \t]*-[ \t]*([\p{L}\p{M}\p{N}_])', '\1-\2', 'g')"
_LINES = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), {_HYPHEN}, {_HYPHEN}, '[ \t\x0B]+', ' ', 'g'), '(?m)^ +| +$', '', 'g')"
N1 = rf"trim(regexp_replace({_LINES}, '\n\n\n+', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"
D = f"d AS (SELECT doc_id, {N1} AS t FROM documents)"
N2 = r"trim(regexp_replace(t, '\s+', ' ', 'g'))"
W = f"""{D},
w AS (SELECT doc_id, t, CASE WHEN length(t) <= 1200 THEN 0 ELSE CAST(ceil((length(t) - 1200) / 1080.0) AS INTEGER) END AS last FROM d WHERE t <> ''),
p AS (SELECT doc_id, CAST(i AS INTEGER) AS i, length(t) > 1200 AS long, trim(regexp_replace(substr(t, CAST(i * 1080 + 1 AS BIGINT), 1200), '\\s+', ' ', 'g')) AS c FROM w, unnest(range(0, last + 1)) AS u(i))"""
ROOT_ID = "'sec-' || substr(sha256(source || '::Document::1'), 1, 12)"


def _made(method: str) -> str:
    """The chunks of documents without headings and empty lines."""
    return f"""WITH {W},
s AS (SELECT doc_id, 'doc-' || CAST(doc_id AS VARCHAR) AS source, CAST(i + 1 AS INTEGER) AS n, CASE WHEN long THEN 'char_fallback' ELSE '{method}' END AS chunk_method, c FROM p WHERE c <> ''),
k AS (SELECT *, {ROOT_ID} AS section_id FROM s),
m AS (SELECT *, 'chunk-' || substr(sha256(source || ':' || section_id || ':' || n || ':' || chunk_method || ':' || sha256('generic:' || c)), 1, 12) AS chunk_id FROM k)"""


@query(f"WITH {D} SELECT doc_id, sha256(t) AS text_sha256, CAST(length(t) AS INTEGER) AS n_chars FROM d")
def normalize_extracted(spark, sf_dir):
    own = documents(spark, sf_dir).select("doc_id", text.normalize_extracted("text").alias("t"))
    return own.select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), F.length("t").alias("n_chars"))


@query(f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, CAST(length({N2}) AS INTEGER) AS n_chars FROM d")
def normalize_chunk(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.length(text.normalize_chunk("text")).alias("n_chars"))


@query(f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, sha256({N2}) AS semantic_hash, sha256('generic:' || {N2}) AS identity_hash FROM d")
def semantic_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.semantic_hash("text").alias("semantic_hash"), text.identity_hash("text", "generic").alias("identity_hash"))


_KINDS = ["code", "primary_legislation", "guidance", "case_law", "commentary", "other", "court_guidance", "procedure_rules", "regulation", ""]


@query("""
WITH k AS (SELECT doc_id, ['generic', 'ru', 'us', 'eu', 'ae'][CAST(doc_id % 5 + 1 AS INTEGER)] AS profile,
  ['code', 'primary_legislation', 'guidance', 'case_law', 'commentary', 'other', 'court_guidance', 'procedure_rules', 'regulation', ''][CAST(doc_id // 5 % 10 + 1 AS INTEGER)] AS doc_kind FROM documents)
SELECT doc_id, profile, doc_kind, CASE WHEN doc_kind IN ('code', 'primary_legislation', '') THEN 'statute' WHEN doc_kind IN ('guidance', 'commentary') THEN 'guidance' WHEN doc_kind = 'case_law' THEN 'case_law'
  WHEN doc_kind = 'court_guidance' AND profile <> 'us' THEN 'guidance' WHEN doc_kind = 'procedure_rules' AND profile = 'us' THEN 'statute' ELSE 'default' END AS policy FROM k
""")
def chunk_policies(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ["generic", "RU", "usa", "European Union", "U.A.E."])), (F.col("doc_id") % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.floor(F.col("doc_id") / 5) % 10 + 1).cast("int"))
    own = documents(spark, sf_dir).select("doc_id", profiles.profile_code(name).alias("profile"), kind.alias("doc_kind"))
    policy = F.coalesce(*(F.when(F.col("profile") == c, profiles.chunk_policy_column(c, F.col("doc_kind"))) for c in sorted(profiles.enabled_profiles())))
    return own.select("doc_id", "profile", "doc_kind", policy.alias("policy"))


@query(f"WITH {W} SELECT doc_id, i AS part, sha256(c) AS part_sha256 FROM p")
def char_windows(spark, sf_dir):
    own = documents(spark, sf_dir).select("doc_id", text.normalize_extracted("text").alias("t")).where("t <> ''")
    cut = own.select("doc_id", F.posexplode(chunks.char_windows(F.col("t"), profiles.Limits())).alias("part", "e"))
    return cut.select("doc_id", "part", F.sha2(text.normalize_chunk("e.text").cast("binary"), 256).alias("part_sha256"))


def _plain(kind: str) -> Query:
    def run(spark, sf_dir):
        return chunks.chunks(documents(spark, sf_dir), "generic", kind)

    return run


_CHUNK_COLUMNS = ["doc_id", "order", "chunk_method", "section_id", "chunk_id", "semantic_hash"]


@query(_made("by_section") + ' SELECT doc_id, n AS "order", chunk_method, section_id, chunk_id, sha256(c) AS semantic_hash FROM m')
def doc_chunks_default(spark, sf_dir):
    return _plain("other")(spark, sf_dir).select(*_CHUNK_COLUMNS)


@query(_made("statute_unit") + ' SELECT doc_id, n AS "order", chunk_method, section_id, chunk_id, sha256(c) AS semantic_hash FROM m')
def doc_chunks_statute(spark, sf_dir):
    return _plain("code")(spark, sf_dir).select(*_CHUNK_COLUMNS)


@query(_made("case_law_paragraph") + " SELECT chunk_method, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, CAST(sum(length(c)) AS BIGINT) AS n_chars FROM m GROUP BY 1")
def chunk_method_counts(spark, sf_dir):
    return _plain("case_law")(spark, sf_dir).groupBy("chunk_method").agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@query(_made("statute_unit") + " SELECT doc_id, chunk_id, lag(chunk_id) OVER (PARTITION BY doc_id ORDER BY n) AS prev_chunk_id, lead(chunk_id) OVER (PARTITION BY doc_id ORDER BY n) AS next_chunk_id FROM m")
def chunk_adjacency(spark, sf_dir):
    return _plain("code")(spark, sf_dir).select("doc_id", "chunk_id", "prev_chunk_id", "next_chunk_id")


@query(f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, {N2} AS x FROM d) SELECT doc_id, CASE WHEN length(x) <= 240 THEN x ELSE rtrim(substr(x, 1, 239)) || '…' END AS preview FROM c")
def review_preview(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.preview("text").alias("preview"))


# Statutes: a part for each order, an article for each of its lines

_L = """l AS (SELECT l_orderkey AS doc_id, 'doc-' || CAST(l_orderkey AS VARCHAR) AS source, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS n, l_partkey AS p, l_suppkey AS s FROM lineitem)"""
_PART = "Part 1. Obligations"


def _tree(number: str = "n", occurrence: str = "1") -> str:
    title = f"'Article ' || {number} || '. Supply of goods'"
    return f"""WITH {_L},
t AS (
  SELECT doc_id, source, n + 1 AS n, 'article' AS kind, {title} AS title, 'Document||{_PART}||' || {title} AS path, {occurrence} AS occurrence, {title} || chr(10) || 'Supplier ' || s || ' delivers part ' || p || '.' AS body FROM l
  UNION ALL SELECT DISTINCT doc_id, source, 1, 'part', '{_PART}', 'Document||{_PART}', 1, '{_PART}' FROM l
  UNION ALL SELECT DISTINCT doc_id, source, 0, 'document_root', 'Document', 'Document', 1, '' FROM l),
i AS (SELECT *, 'sec-' || substr(sha256(source || '::' || path || '::' || occurrence), 1, 12) AS section_id FROM t)"""


def _statutes(spark, sf_dir, **options) -> DataFrame:
    return corpora.statutes(table(spark, sf_dir, "lineitem"), **options)


@query(f"WITH {_L} SELECT 'heading' AS line_kind, 'article' AS heading_kind, count(*) AS n FROM l UNION ALL SELECT 'heading', 'part', count(DISTINCT doc_id) FROM l UNION ALL SELECT 'text', NULL, count(*) FROM l UNION ALL SELECT 'blank', NULL, count(*) - count(DISTINCT doc_id) FROM l")
def heading_classify(spark, sf_dir):
    found = sections.lines(_statutes(spark, sf_dir), "generic", "statute")
    return found.groupBy(sections.line_kind(F.col("heading"), F.col("text")).alias("line_kind"), F.col("heading.kind").alias("heading_kind")).agg(F.count("*").alias("n"))


@query(_tree() + ' SELECT doc_id, n AS "order", kind, title, CAST(length(body) AS INTEGER) AS n_chars FROM i')
def section_tree(spark, sf_dir):
    return sections.sections(_statutes(spark, sf_dir), "generic", "statute").select("doc_id", "order", "kind", "title", F.length("text").alias("n_chars"))


@query(_tree() + ' SELECT doc_id, n AS "order", path FROM i')
def section_paths(spark, sf_dir):
    return sections.sections(_statutes(spark, sf_dir), "generic", "statute").select("doc_id", "order", F.array_join("path", "||").alias("path"))


_ROOT_OF, _PART_OF = ("max(CASE WHEN n = %d THEN section_id END) OVER (PARTITION BY doc_id)" % n for n in (0, 1))


@query(_tree() + f' SELECT doc_id, n AS "order", section_id, CASE WHEN n > 1 THEN {_PART_OF} WHEN n = 1 THEN {_ROOT_OF} END AS parent_section_id FROM i')
def section_ids(spark, sf_dir):
    return sections.sections(_statutes(spark, sf_dir), "generic", "statute").select("doc_id", "order", "section_id", "parent_section_id")


@query(f"""WITH {_L}, o AS (SELECT doc_id, n, 2 + length('{_PART}') + sum(length('Article ' || n || '. Supply of goods') + length('Supplier ' || s || ' delivers part ' || p || '.') + 3) OVER (PARTITION BY doc_id ORDER BY n) AS past,
  length('Article ' || n || '. Supply of goods') + length('Supplier ' || s || ' delivers part ' || p || '.') + 1 AS size FROM l)
SELECT doc_id, CAST(n + 1 AS INTEGER) AS "order", CAST(past - size - 3 AS INTEGER) AS start_offset, CAST(past - 3 AS INTEGER) AS end_offset FROM o""")
def section_offsets(spark, sf_dir):
    return sections.sections(_statutes(spark, sf_dir), "generic", "statute").where("kind = 'article'").select("doc_id", "order", "start_offset", "end_offset")


@query(_tree("1", "n") + ' SELECT doc_id, n AS "order", title, section_id FROM i')
def duplicate_paths(spark, sf_dir):
    return sections.sections(_statutes(spark, sf_dir, repeat_numbers=True), "generic", "statute").select("doc_id", "order", "title", "section_id")


_STATUTE_CHUNKS = _tree() + """, c AS (SELECT doc_id, source, n, section_id, title, kind, replace(body, chr(10), ' ') AS c FROM i WHERE body <> '')
SELECT doc_id, n AS "order", 'chunk-' || substr(sha256(source || ':' || section_id || ':' || n || ':statute_unit:' || sha256('generic:' || c)), 1, 12) AS chunk_id, title AS section_title, kind AS section_type, c AS text FROM c"""


@query(_STATUTE_CHUNKS)
def statute_chunks(spark, sf_dir):
    return chunks.chunks(_statutes(spark, sf_dir), "generic", "code").select("doc_id", "order", "chunk_id", "section_title", "section_type", "text")


@query(f"WITH {_L} SELECT doc_id, CAST(count(*) + 2 AS INTEGER) AS n_sections, CAST(count(*) + 1 AS INTEGER) AS n_chunks FROM l GROUP BY 1")
def nested_documents(spark, sf_dir):
    return chunks.documents(_statutes(spark, sf_dir), "generic", "code").select("doc_id", F.size("sections").alias("n_sections"), F.size("chunks").alias("n_chunks"))


@query(f"""WITH {_L}, d AS (SELECT count(*) AS a, count(DISTINCT doc_id) AS b FROM l)
SELECT 'chunk' AS stage, 'chunk_policy_selected' AS type, b AS n FROM d UNION ALL SELECT 'normalize', 'document_normalized', b FROM d
UNION ALL SELECT 'detect', 'section_line_classified', 3 * a FROM d UNION ALL SELECT 'detect', 'heading_detected', a + b FROM d""")
def trace_events(spark, sf_dir):
    return trace.events(_statutes(spark, sf_dir), "generic", "code").groupBy("stage", "type").agg(F.count("*").alias("n"))


# Reviews: a point for each order of a customer

_O = "o AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS n, o_orderkey AS k, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)"
_POINT = "n || '. Заказ рассмотрен судом. Определение Верховного Суда РФ от 5 мая 2023 г. № ' || k || '-КГ.'"


def _reviews(spark, sf_dir) -> DataFrame:
    return corpora.reviews(table(spark, sf_dir, "orders"))


@query(f"""WITH {_O}, p AS (SELECT doc_id, n, {_POINT} AS body, 'doc-' || doc_id AS source FROM o),
a AS (SELECT *, CAST(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY n) + length('Обзор судебной практики.') + 2 AS INTEGER) AS past FROM p)
SELECT doc_id, n AS "order", 'Point ' || n AS title, 'sec-' || substr(sha256(source || '::Document||Point ' || n || '::1'), 1, 12) AS section_id, CAST(past - 1 - length(body) AS INTEGER) AS start_offset, CAST(past - 1 AS INTEGER) AS end_offset FROM a
UNION ALL SELECT DISTINCT doc_id, 0, 'Document', 'sec-' || substr(sha256(source || '::Document::1'), 1, 12), 0, CAST(length('Обзор судебной практики.') AS INTEGER) FROM p""")
def guidance_points(spark, sf_dir):
    return sections.sections(_reviews(spark, sf_dir), "ru", "guidance", "court_guidance").select("doc_id", "order", "title", "section_id", "start_offset", "end_offset")


@query(f"WITH {_O} SELECT doc_id, n AS \"order\", CAST(n AS VARCHAR) AS point_number, 'Определение Верховного Суда РФ от 5 мая 2023 г. № ' || k || '-КГ.' AS source_case_reference, k || '-КГ' AS source_case_number, '5 мая 2023 г.' AS source_case_date, 'Верховный Суд РФ' AS source_case_court FROM o")
def guidance_metadata(spark, sf_dir):
    found = sections.sections(_reviews(spark, sf_dir), "ru", "guidance", "court_guidance").where("kind = 'clause'")
    return found.select("doc_id", "order", "metadata.point_number", "metadata.source_case_reference", "metadata.source_case_number", "metadata.source_case_date", "metadata.source_case_court")


@query(f"WITH {_O} SELECT doc_id, n + 1 AS \"order\", 'guidance_point' AS chunk_method, {_POINT} AS text FROM o UNION ALL SELECT DISTINCT doc_id, 1, 'guidance_preamble', 'Обзор судебной практики.' FROM o")
def guidance_chunks(spark, sf_dir):
    return chunks.chunks(_reviews(spark, sf_dir), "ru", "court_guidance").select("doc_id", "order", "chunk_method", "text")


@query(f"WITH {_O}, c AS (SELECT doc_id, max(n) AS n FROM o GROUP BY 1) SELECT doc_id, CASE WHEN n >= 3 THEN 'guidance_point' ELSE 'guidance_paragraph' END AS method, CASE WHEN n >= 3 THEN n ELSE 1 END AS n_blocks FROM c UNION ALL SELECT doc_id, 'guidance_preamble', 1 FROM c WHERE n >= 3")
def guidance_blocks_strict(spark, sf_dir):
    cut = _reviews(spark, sf_dir).select("doc_id", F.explode(guidance.split_blocks(text.normalize_guidance("text"), any_start=False, min_points=3)).alias("b"))
    return cut.groupBy("doc_id", F.col("b.method").alias("method")).agg(F.count("*").cast("int").alias("n_blocks"))


# Statute splitters

_S = "s AS (SELECT s_nationkey AS doc_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS n, s_suppkey AS k, count(*) OVER (PARTITION BY s_nationkey) AS total FROM supplier)"
_FILL = "repeat(' The holder keeps a record of each step.', {})"


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, n_name AS definition_term, n_name || ': means nation number ' || n_nationkey || '.' AS text FROM nation")
def definition_entries(spark, sf_dir):
    found = chunks.chunks(corpora.definitions(table(spark, sf_dir, "nation")), "generic", "code").where("chunk_method = 'definition_entry'")
    return found.select("doc_id", "metadata.definition_term", "text")


@query(f"WITH {_S} SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n AS VARCHAR) AS legal_unit_number, 'Section A. General principles ' || n || '. Supplier ' || k || ' complies.' || {_FILL.format(30)} AS text FROM s WHERE total >= 2")
def rule_blocks(spark, sf_dir):
    found = chunks.chunks(corpora.rulebooks(table(spark, sf_dir, "supplier")), "ae", "primary_legislation").where("chunk_method = 'statute_rule'")
    return found.select("doc_id", "metadata.legal_unit_number", "text")


def _cut_sql(head: str, label: str) -> str:
    return f"WITH {_S} SELECT CAST(doc_id AS BIGINT) AS doc_id, n AS \"order\", CASE WHEN n = 1 THEN '{head} ' ELSE '' END || {label} || ' supplier ' || k || ' may act.' || {_FILL.format(20)} AS text FROM s"


def _cut(spark, sf_dir, style: str, profile: str, kind: str) -> DataFrame:
    return chunks.chunks(corpora.subdivided(table(spark, sf_dir, "supplier"), style), profile, kind).select("doc_id", "order", "text")


@query(_cut_sql("Rule 4. Summons", "'(' || n || ')'"))
def us_subdivisions(spark, sf_dir):
    return _cut(spark, sf_dir, "us", "us", "procedure_rules")


@query(_cut_sql("Article 12", "n || '.'"))
def eu_subdivisions(spark, sf_dir):
    return _cut(spark, sf_dir, "eu", "eu", "primary_legislation")


@query(_cut_sql("Having regard to the following:", "'(' || n || ')'") + " WHERE total >= 2")
def eu_recitals(spark, sf_dir):
    return _cut(spark, sf_dir, "recitals", "eu", "primary_legislation")


@query(f"WITH {_S} SELECT CAST(doc_id AS BIGINT) AS doc_id, n AS \"order\", 'statute_unit' AS chunk_method, 'supplier ' || k || ' is licensed.' AS text FROM s")
def ae_preamble(spark, sf_dir):
    return chunks.chunks(corpora.preambles(table(spark, sf_dir, "supplier")), "ae", "code").select("doc_id", "order", "chunk_method", "text")


@query(f"WITH {_S} SELECT CAST(doc_id AS BIGINT) AS doc_id, n + 1 AS \"order\", 'case_law_paragraph' AS chunk_method, 'supplier ' || k || ' is licensed.' AS text FROM s UNION ALL SELECT DISTINCT CAST(doc_id AS BIGINT), 1, 'case_law_paragraph', 'Virtual Markets Rulebook' FROM s")
def paragraph_units(spark, sf_dir):
    return chunks.chunks(corpora.preambles(table(spark, sf_dir, "supplier")), "generic", "case_law").select("doc_id", "order", "chunk_method", "text")


# Citations: a text for each order

_REF = ["doc_id", "ordinal", "raw", "scheme", "article_number", "paragraph_number", "part_number", "doc_family"]
_NONE = "CAST(NULL AS VARCHAR)"


def _refs(style: str, profile: str, **options) -> Query:
    def run(spark, sf_dir):
        return citations.references(corpora.citing(table(spark, sf_dir, "orders"), style), profile, **options).select(*_REF)

    return run


def _ref_sql(*rows: tuple[str, str, str, str]) -> str:
    """rows: raw, scheme, article, family as SQL."""
    parts = [f"SELECT k AS doc_id, {i} AS ordinal, {raw} AS raw, '{scheme}' AS scheme, CAST({article} AS VARCHAR) AS article_number, {_NONE} AS paragraph_number, {_NONE} AS part_number, {family} AS doc_family FROM o" for i, (raw, scheme, article, family) in enumerate(rows, 1)]
    return f"WITH {_O} " + " UNION ALL ".join(parts)


@query(_ref_sql(("'Article ' || n", "article", "n", _NONE), ("'Section ' || k", "section", "k", _NONE)))
def refs_generic(spark, sf_dir):
    return _refs("generic", "generic")(spark, sf_dir)


@query(_ref_sql(("n || ' U.S.C. § ' || k", "section", "k", "'usc'")))
def refs_us(spark, sf_dir):
    return _refs("us", "us")(spark, sf_dir)


@query(_ref_sql(("n || ' U.S.C. § ' || k", "section", "k", "'usc'")))
def refs_us_narrowed(spark, sf_dir):
    return _refs("us", "U.S.", doc_family="usc")(spark, sf_dir)


@query(_ref_sql(("'Article ' || k", "article", "k", "'gdpr'"), ("'Recital ' || n", "recital", "n", "'gdpr'")))
def refs_eu(spark, sf_dir):
    return _refs("eu", "eu")(spark, sf_dir)


@query(_ref_sql(("'Article ' || k", "article", "k", "'vara'")))
def refs_ae(spark, sf_dir):
    return _refs("ae", "ae")(spark, sf_dir)


_DECIMAL = "CASE WHEN length(CAST(k AS VARCHAR)) BETWEEN 4 AND 5 AND substr(CAST(k AS VARCHAR), 4, 1) <> '0' THEN substr(CAST(k AS VARCHAR), 1, 3) || '.' || substr(CAST(k AS VARCHAR), 4) ELSE CAST(k AS VARCHAR) END"


@query(f"WITH {_O}, r AS (SELECT k, n, {_DECIMAL} AS a FROM o) SELECT k AS doc_id, 1 AS ordinal, 'пункт ' || n || ' статьи ' || a AS raw, 'ru_article' AS scheme, a AS article_number, CAST(n AS VARCHAR) AS paragraph_number, {_NONE} AS part_number, 'gk_rf' AS doc_family FROM r")
def refs_ru(spark, sf_dir):
    return _refs("ru", "ru")(spark, sf_dir)


@query(f"WITH {_O} SELECT k AS doc_id, CAST(n AS VARCHAR) AS article_number, 'gdpr' AS doc_family FROM o UNION ALL SELECT k, CAST(k AS VARCHAR), 'eu_directive' FROM o")
def nearest_family(spark, sf_dir):
    return _refs("families", "eu")(spark, sf_dir).select("doc_id", "article_number", "doc_family")


@query("SELECT o_orderkey AS doc_id, 'eu_directive' AS doc_family FROM orders")
def doc_families(spark, sf_dir):
    return corpora.citing(table(spark, sf_dir, "orders"), "families").select("doc_id", citations.doc_family(F.col("text"), "eu").alias("doc_family"))


@query(f"WITH {_O} SELECT k AS doc_id, 'us' AS jurisdiction, 'section' AS scheme, CAST(k AS VARCHAR) AS article_number, 'usc' AS doc_family, 4 AS n_parts FROM o")
def canonical_parts(spark, sf_dir):
    found = citations.canonical_parts(_refs("us", "us")(spark, sf_dir), "United States")
    part = lambda n: F.element_at("canonical", n).alias(n)
    return found.select("doc_id", part("jurisdiction"), part("scheme"), part("article_number"), part("doc_family"), F.size("canonical").alias("n_parts"))


# Numbers


def _key():
    return F.col("o_orderkey").cast("string")


@query("SELECT o_orderkey, o_orderkey || '.23 and 4' AS fixed FROM orders")
def numeric_scripts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.normalize_numeric_scripts(F.concat(_key(), F.lit("²³ and ₄"))).alias("fixed"))


@query("SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey AS VARCHAR)) BETWEEN 2 AND 4 THEN o_orderkey || '.5' ELSE o_orderkey || '(5)' END AS article_number FROM orders")
def article_numbers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.normalize_article_number(F.concat(F.lit(" "), _key(), F.lit("(5) "))).alias("article_number"))


@query(f"WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k AS o_orderkey, 'см. статья ' || {_DECIMAL} || ' АПК РФ' AS fixed FROM o")
def legal_text_repairs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", numbering.normalize_legal(F.concat(F.lit("см. статья  "), _key(), F.lit(" АПК РФ\n")), "ru").alias("fixed"))


@query("SELECT o_orderkey, 'Условие договора' AS footnote, CASE WHEN o_orderkey >= 10 THEN 'Article ' || o_orderkey || '.7 applies' ELSE 'Article ' || o_orderkey || '_7 applies' END AS suffix FROM orders")
def contextual_numbers(spark, sf_dir):
    suffix = numbering.normalize_reference(F.concat(F.lit("Article "), _key(), F.lit("_7  applies")), "generic")
    note = numbering.normalize_legal(F.concat(F.lit("Условие договора["), F.lit("1"), F.lit("]")), "ru")
    return table(spark, sf_dir, "orders").select("o_orderkey", note.alias("footnote"), suffix.alias("suffix"))


@query("SELECT o_orderkey, ['article_like', 'section_like', 'unknown'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS context FROM orders")
def reference_contexts(spark, sf_dir):
    word = F.element_at(F.array(F.lit("Статья "), F.lit("разд "), F.lit("заказ ")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbering.reference_context(F.concat(word, _key()), "ru").alias("context"))


# Pages: one for each order of a customer


def _registry(spark, sf_dir) -> DataFrame:
    return corpora.registry_pages(table(spark, sf_dir, "orders"))


@query(f"WITH {_O} SELECT DISTINCT doc_id, unnest(['Registry of all orders', 'and is kept on file.']) AS line FROM o WHERE total >= 3")
def repeated_noise(spark, sf_dir):
    return pages.repeated_noise(pages.page_lines(_registry(spark, sf_dir)))


@query(f"WITH {_O} SELECT DISTINCT doc_id, unnest(['registry of all orders', 'and is kept on file.']) AS fingerprint FROM o WHERE total >= 3")
def header_fingerprints(spark, sf_dir):
    return pages.repeated_fingerprints(pages.page_lines(_registry(spark, sf_dir)))


_PAGE = "CASE WHEN total >= 3 THEN 'Order ' || k || ' was placed' ELSE 'Registry of all orders Order ' || k || ' was placed and is kept on file.' END"


@query(f"WITH {_O} SELECT doc_id, n AS page_number, {_PAGE} AS text FROM o")
def page_texts(spark, sf_dir):
    return pages.clean_pages(_registry(spark, sf_dir), "generic")


@query(f"WITH {_O} SELECT doc_id, sha256(string_agg({_PAGE}, chr(10) || chr(10) ORDER BY n)) AS text_sha256 FROM o GROUP BY 1")
def page_documents(spark, sf_dir):
    return pages.document_text(_registry(spark, sf_dir), "generic").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query(f"WITH {_O} SELECT 'body_text' AS kind, 2 * count(*) AS n FROM o UNION ALL SELECT 'toc_leader', CAST(sum(n % 3) AS BIGINT) FROM o")
def page_line_kinds(spark, sf_dir):
    flat = pages.page_lines(corpora.contents_pages(table(spark, sf_dir, "orders"))).select(F.explode("lines").alias("line"))
    return flat.groupBy(pages.line_kind(F.col("line"), "generic").alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {_O} SELECT doc_id, n AS page_number, 'Orders like ' || k || ' were placed before ' || k || '.' AS text FROM o WHERE n % 3 < 2")
def toc_pages(spark, sf_dir):
    return pages.clean_pages(corpora.contents_pages(table(spark, sf_dir, "orders")), "generic")


@query(f"WITH {_O} SELECT doc_id, n AS page_number, 'A. Order ' || k || ' terms' || chr(10) || 'Part ' || k || ' Delivery' || chr(10) || 'Goods ' || k || ' are sent.' AS text FROM o")
def merged_markers(spark, sf_dir):
    return pages.clean_pages(corpora.marker_pages(table(spark, sf_dir, "orders")), "generic")


@query(f"WITH {_O}, a AS (SELECT sum(CASE WHEN total >= 3 THEN 2 ELSE 4 END) AS c, sum(CASE WHEN total >= 3 THEN 1 ELSE 3 END) AS d FROM o) SELECT 'pdf_line_classified' AS type, CAST(c AS BIGINT) AS n FROM a UNION ALL SELECT 'pdf_line_decided', CAST(d AS BIGINT) FROM a")
def page_trace_events(spark, sf_dir):
    return trace.page_events(_registry(spark, sf_dir), "generic").groupBy("type").agg(F.count("*").alias("n"))


_STATES = """WITH {o}, p AS (SELECT n % 3 AS leaders FROM o)
SELECT 'pdf_line_classified' AS type, 'body_text' AS kind, CAST(NULL AS VARCHAR) AS state_to, 2 * count(*) AS n FROM p
UNION ALL SELECT 'pdf_line_classified', 'toc_leader', NULL, CAST(sum(leaders) AS BIGINT) FROM p
UNION ALL SELECT 'pdf_line_decided', 'body_text', 'front_matter', 2 * count(*) FROM p WHERE leaders < 2"""


@query(_STATES.format(o=_O))
def page_contents_events(spark, sf_dir):
    """Pages of contents have no decisions; a single line of contents goes before lines are merged."""
    return _page_events(corpora.contents_pages(table(spark, sf_dir, "orders")))


@query(f"""WITH {_O}, k AS (SELECT count(*) AS n FROM o)
SELECT 'pdf_line_classified' AS type, 'body_text' AS kind, CAST(NULL AS VARCHAR) AS state_to, 2 * n AS n FROM k
UNION ALL SELECT 'pdf_line_classified', 'structural_heading', NULL, 3 * n FROM k
UNION ALL SELECT 'pdf_line_decided', 'body_text', 'front_matter', n FROM k UNION ALL SELECT 'pdf_line_decided', 'structural_heading', 'body', n FROM k
UNION ALL SELECT 'pdf_line_decided', 'body_text', 'body', n FROM k""")
def page_marker_events(spark, sf_dir):
    """Markers are decided on with the lines that take them; a heading makes the rest of a page body."""
    return _page_events(corpora.marker_pages(table(spark, sf_dir, "orders")))


def _page_events(found: DataFrame) -> DataFrame:
    told = trace.page_events(found, "generic").select("type", F.element_at("data", "kind").alias("kind"), F.element_at("data", "state_to").alias("state_to"))
    return told.groupBy("type", "kind", "state_to").agg(F.count("*").alias("n"))
