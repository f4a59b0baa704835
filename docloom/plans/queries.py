"""The reference operators as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import fixed, recognition, replies, text
from docloom.models import Recorded, chunk_text
from docloom.operators import answer, citations, context, corpus, index, pick, retrieve, score
from docloom.plans import folders, sql
from docloom.sources import corpus as folder
from docloom.sources import index_store, questions, results
from docloom.stages import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def document_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Term frequencies, written once, and the totals and idf that are made from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tf = staged(index.term_frequencies(docs, "doc_id", F.col("text")), "tf")
    totals = index.lengths(docs, tf)
    return tf, totals, index.inverse_frequencies(tf, totals)


# --- terms and scores -------------------------------------------------------------------------------
@registered(f"WITH {sql.terms('documents', 'doc_id', 'text')} SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term")
def tokens_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_frequencies(table(spark, sf_dir, "documents"), "doc_id", F.col("text")).select("doc_id", "term", "tf")


@registered(f"WITH {sql.bm25_tables('documents', 'doc_id', 'text')} SELECT term, df, round(idf, 6) AS idf FROM idf")
def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, idf = document_tables(spark, sf_dir)
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


_ASKED = sql.terms("(SELECT item_id AS qid, text FROM benchmark) q", "qid", "text", "asked")
_BM25 = f"WITH {sql.bm25_tables('documents', 'doc_id', 'text')}, {_ASKED}, scores AS ({sql.bm25('tf', 'totals', 'idf', 'asked', 'doc_id')})"


@registered(f"{_BM25} SELECT qid, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores) WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf, totals, idf = document_tables(spark, sf_dir)
    scores = index.bm25(tf, idf, totals, index.query_terms(benchmark_questions(spark, sf_dir)), "doc_id")
    order = Window.partitionBy("qid").orderBy(*retrieve.best_first("score", "doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 10).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def label_centres(vectors: DataFrame) -> DataFrame:
    """(qid, query_vector): the mean vector of each label."""
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("query_vector")).select(F.col("label").alias("qid"), "query_vector")


_CENTRES = "centres AS (SELECT label AS qid, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label)"
_DENSE = "dense AS (SELECT c.qid, e.vec_id, list_inner_product(e.embedding::DOUBLE[], c.v) AS score FROM centres c, embeddings e)"


@registered(f"WITH {_CENTRES}, {_DENSE} SELECT qid, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM dense) WHERE rank <= 200")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    held = vectors.select("vec_id", F.col("embedding").alias("vector"))
    scores = retrieve.dense_best(held, label_centres(vectors), "vec_id", fixed.CANDIDATES)
    order = Window.partitionBy("qid").orderBy(*retrieve.best_first("score", "vec_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= fixed.CANDIDATES).select("qid", "vec_id", "rank", F.round("score", 6).alias("score"))


@registered(
    f"""{_BM25}, {_CENTRES}, pairs AS (SELECT item_id AS qid, (item_id % 10)::INT AS label FROM benchmark),
dense AS (SELECT p.qid, e.vec_id AS doc_id, list_inner_product(e.embedding::DOUBLE[], c.v) AS score FROM pairs p JOIN centres c ON c.qid = p.label, embeddings e),
r AS (
  SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores
  UNION ALL SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) FROM dense),
f AS (SELECT qid, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS fused FROM r WHERE rank <= 200 GROUP BY qid, doc_id)
SELECT qid, doc_id, round(fused, 6) AS fused, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, doc_id) AS place FROM f)"""
)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term and dense rankings fused; documents and vectors are paired by id, as nothing else pairs them."""
    tf, totals, idf = document_tables(spark, sf_dir)
    asked = benchmark_questions(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings")
    centres = label_centres(vectors).withColumnRenamed("qid", "label")
    wanted = asked.select("qid", F.pmod("qid", F.lit(10)).alias("label")).join(centres, "label").select("qid", "query_vector")
    held = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    scores = index.bm25(tf, idf, totals, index.query_terms(asked), "doc_id")
    both = retrieve.ranked(scores, "doc_id", fixed.CANDIDATES, "bm25", 1.0).unionByName(retrieve.ranked(retrieve.dense_best(held, wanted, "doc_id", fixed.CANDIDATES), "doc_id", fixed.CANDIDATES, "dense", 1.0))
    order = Window.partitionBy("qid").orderBy(*retrieve.best_first("fused", "doc_id"))
    return retrieve.fused(both, "doc_id").select("qid", "doc_id", F.round("fused", 6).alias("fused"), F.row_number().over(order).alias("place"))


# --- identifiers ------------------------------------------------------------------------------------
_IDS = f"ids AS (SELECT DISTINCT doc_id, {sql.norm_value('raw')} AS id FROM (SELECT doc_id, unnest({sql.identifiers('text')}) AS raw FROM documents))"


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rel"), "text")
    return index.file_identifiers(docs)


@registered(f"WITH {_IDS} SELECT id, count(*) AS df FROM ids GROUP BY id")
def id_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.identifier_frequencies(document_ids(spark, sf_dir))


@registered(f"WITH {_IDS}, d AS (SELECT id, count(*) AS df FROM ids GROUP BY id) SELECT doc_id, id FROM ids JOIN d USING (id) WHERE df <= {fixed.BRIDGE_MAX_DF}")
def rare_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = document_ids(spark, sf_dir)
    return ids.join(index.identifier_frequencies(ids).where(F.col("df") <= fixed.BRIDGE_MAX_DF), "id").select(F.col("rel").alias("doc_id"), "id")


@registered(
    f"""WITH raws AS (SELECT DISTINCT unnest({sql.identifiers('text')}) AS raw FROM documents)
SELECT raw, doc_id, row_number() OVER (PARTITION BY raw ORDER BY doc_id) AS place FROM raws JOIN documents ON contains(lower(text), lower(raw))"""
)
def id_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an identifier of the corpus as part of their text; without a term score ties go by id."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = docs.select(F.explode(F.array_distinct(text.identifiers("text"))).alias("question")).distinct().withColumn("qid", F.col("question"))
    hits = retrieve.identifier_hits(docs, asked)
    order = Window.partitionBy("qid").orderBy("chunk_id")
    return hits.select(F.col("qid").alias("raw"), F.col("chunk_id").alias("doc_id"), F.row_number().over(order).alias("place"))


# --- units, chunks, context ----------------------------------------------------------------------------
_LINES = r"list_filter(regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda l: regexp_replace(l, '[\s\x0b]', '', 'g') <> '')"
_CHUNKS = f"""d AS (SELECT doc_id, regexp_replace(text, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, t, {_LINES} AS held FROM d WHERE t <> ''),
chunks AS (
  SELECT doc_id, 0 AS place, 'file' AS loc, t AS body FROM k WHERE length(t) <= {fixed.SMALL_UNIT}
  UNION ALL
  SELECT doc_id, s AS place, 'file lines ' || (10 * s + 1) || '-' || least(len(held), 10 * s + 14), array_to_string(held[10 * s + 1 : 10 * s + 14], chr(10))
  FROM k, unnest(range(0, 1 + ceil(greatest(len(held) - 14, 0) / 10.0)::BIGINT)) AS u(s) WHERE length(t) > {fixed.SMALL_UNIT})"""


@registered(f"WITH {_CHUNKS} SELECT doc_id, place, loc, length(body) AS n_chars, md5(body) AS digest FROM chunks")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = corpus.chunks(corpus.documents_as_files(table(spark, sf_dir, "documents")))
    number = F.shiftright("chunk_id", 24)
    return parts.select(number.alias("doc_id"), (F.col("chunk_id") - F.shiftleft(number, 24)).alias("place"), "loc", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@registered(f"WITH {_CHUNKS} SELECT doc_id, place, left('doc/' || doc_id || ' | ' || loc || chr(10) || body, {fixed.EMBED_CHARS}) AS embedded FROM chunks")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each chunk an embedder gets."""
    parts = corpus.chunks(corpus.documents_as_files(table(spark, sf_dir, "documents")))
    number = F.shiftright("chunk_id", 24)
    return parts.select(number.alias("doc_id"), (F.col("chunk_id") - F.shiftleft(number, 24)).alias("place"), chunk_text().alias("embedded"))


@registered(f"WITH {_CHUNKS} SELECT doc_id, '### doc/' || doc_id || '.txt' || chr(10) || left(string_agg(left(body, {fixed.PICK_CHUNK_CHARS}), chr(10) ORDER BY place), {fixed.PICK_FILE_CHARS}) AS part FROM chunks GROUP BY doc_id")
def pick_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a picker's listing shows it."""
    parts = corpus.chunks(corpus.documents_as_files(table(spark, sf_dir, "documents")))
    held = parts.groupBy("rel").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("held"))
    number = F.shiftright(F.get("held", F.lit(0))["chunk_id"], 24)
    return held.select(number.alias("doc_id"), pick.listing_part("rel", F.transform("held", lambda h: h["text"])).alias("part"))


@registered(
    f"""{_BM25}, ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores),
q AS (SELECT qid, list({{'id': doc_id, 'n': length(text)}} ORDER BY rank) AS docs FROM ranked JOIN documents USING (doc_id) WHERE rank <= 200 GROUP BY qid),
f AS (SELECT qid, list_reduce(docs, lambda acc, x: CASE WHEN acc.used + x.n <= {fixed.CONTEXT_CHARS}
  THEN {{'used': acc.used + x.n + {fixed.CHUNK_OVERHEAD}, 'ids': list_append(acc.ids, x.id)}} ELSE acc END, {{'used': 0::BIGINT, 'ids': []::BIGINT[]}}) AS r FROM q)
SELECT qid, i AS place, r.ids[i] AS doc_id FROM f, unnest(range(1, len(r.ids) + 1)) AS u(i)"""
)
def context_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the ranked documents fit a context, taken in order and skipped where they don't."""
    tf, totals, idf = document_tables(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    scores = index.bm25(tf, idf, totals, index.query_terms(benchmark_questions(spark, sf_dir)), "doc_id")
    queue = retrieve.ranked(scores, "doc_id", fixed.CANDIDATES, "bm25", 1.0).join(docs, "doc_id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank0", "doc_id", "n"))).alias("queue"))
    flagged = queue.withColumn("n", F.transform("queue", lambda d: d["n"])).withColumn("taken", context.greedy_fit("n", fixed.CONTEXT_CHARS, fixed.CHUNK_OVERHEAD))
    kept = F.transform(F.filter(F.arrays_zip("queue", "taken"), lambda z: z["taken"]), lambda z: z["queue"]["doc_id"])
    return flagged.select("qid", F.posexplode(kept).alias("i", "doc_id")).select("qid", (F.col("i") + 1).cast("long").alias("place"), "doc_id")


def _row_sql(name: str, order: str, columns: list[str]) -> str:
    clean = lambda c: f"regexp_replace(regexp_replace(trim({c}::VARCHAR), '^(-?[0-9]+)\\.0$', '\\1'), '\\s+', ' ', 'g')"
    body = " || ' | ' || ".join(f"'{c}: ' || {clean(c)}" for c in columns)
    return f"""SELECT '{name}' AS source, 1 AS row_ord, '{name} header' AS loc, '{name} columns: {" | ".join(columns)}' AS text
UNION ALL SELECT '{name}', row_number() OVER (ORDER BY {order}) + 1, '{name} row ' || (row_number() OVER (ORDER BY {order}) + 1), '{name} | ' || {body} FROM {name}"""


_TABLES = {
    "region": ("r_regionkey", ["r_regionkey", "r_name"]),
    "nation": ("n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]),
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
}


@registered("\nUNION ALL ".join(_row_sql(n, o, c) for n, (o, c) in _TABLES.items()))
def row_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as sheets, all columns: one unit for each row, with the columns' names."""
    out = None
    for name, (order, columns) in _TABLES.items():
        rows = corpus.table_rows(table(spark, sf_dir, name).select(*columns), [order])
        units = corpus.row_units(rows, name, most=None).select(F.lit(name).alias("source"), F.col("row_ord").cast("long").alias("row_ord"), "loc", "text")
        out = units if out is None else out.unionByName(units)
    return out


@registered(r"SELECT page_id, 'html' AS loc, length(html) AS n_chars, length(html) - length(replace(html, chr(10), '')) AS line_ends, md5(html) AS digest FROM pages WHERE regexp_replace(html, '\s', '', 'g') <> ''")
def html_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are indexed as plain text, with their tags, one unit each."""
    pages = table(spark, sf_dir, "pages")
    unit = F.struct(F.col("html").alias("text"), F.lit("html").alias("loc"), F.lit(False).alias("is_row"))
    files = corpus.file_records(pages.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("rel"), F.col("page_id").alias("file_ord"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("skip"), F.array(unit).alias("units")))
    body = F.col("u.text")
    return files.select(F.col("file_ord").alias("page_id"), F.explode("units").alias("u")).select("page_id", "u.loc", F.length(body).cast("long").alias("n_chars"), (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))).cast("long").alias("line_ends"), F.md5(body.cast("binary")).alias("digest"))


# --- a folder of files ------------------------------------------------------------------------------------
_NAMED = "lpad(doc_id::VARCHAR, 9, '0')"
_ROW = "'id: ' || doc_id || ' | lang: ' || lang || ' | source: ' || source"


def _table_sql(ending: str, kind: str, remainder: int, where: str, first: int) -> str:
    told = f"{where} || "
    return f"""SELECT {_NAMED} || '.{ending}' AS rel, '{kind}' AS kind, {first} AS place, {told} ' columns: id | lang | source' AS text, {told} ' header' AS loc, true AS is_row FROM documents WHERE doc_id % 5 = {remainder}
UNION ALL SELECT {_NAMED} || '.{ending}', '{kind}', {first + 1}, {told} ' | ' || {_ROW}, {told} ' row 2', true FROM documents WHERE doc_id % 5 = {remainder}"""


_UNITS = f"""units AS (
SELECT {_NAMED} || '.txt' AS rel, 'text' AS kind, 0 AS place, coalesce(text, '') AS text, 'file' AS loc, false AS is_row FROM documents WHERE doc_id % 5 = 0
UNION ALL {_table_sql("csv", "csv", 1, "'csv'", 0)}
UNION ALL SELECT {_NAMED} || '.docx', 'docx', 0, 'Document ' || doc_id || chr(10) || lang || ' from ' || source, 'Document ' || doc_id, false FROM documents WHERE doc_id % 5 = 2
UNION ALL {_table_sql("docx", "docx", 2, "'table 1 (Document ' || doc_id || ')'", 1)}
UNION ALL {_table_sql("xlsx", "xlsx", 3, "'sheet One'", 0)})"""


@registered(f"WITH {_UNITS} SELECT rel, kind, NULL::VARCHAR AS skip, place, text, loc, is_row FROM units UNION ALL SELECT {_NAMED} || '.bin', NULL, 'unknown type', NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 5 = 4")
def folder_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files of five kinds, listed, dispatched and parsed into units."""
    parsed = folder.read_corpus(spark, folders.written(table(spark, sf_dir, "documents")))
    return parsed.select("rel", "kind", "skip", F.posexplode_outer("units").alias("place", "u")).select("rel", "kind", "skip", "place", "u.text", "u.loc", "u.is_row")


@registered(
    f"""WITH {_CHUNKS}, {_UNITS}
SELECT true AS built, false AS built_again, (SELECT count(DISTINCT rel) FROM units WHERE regexp_replace(text, '[\\s\\x0b]', '', 'g') <> '') AS files,
(SELECT count(*) FROM chunks WHERE doc_id % 5 = 0) + (SELECT count(*) FROM units WHERE kind <> 'text') AS chunks,
(SELECT count(*) FROM documents WHERE doc_id % 5 = 4 OR doc_id % 5 = 0 AND regexp_replace(coalesce(text, ''), '[\\s\\x0b]', '', 'g') = '') AS skipped"""
)
def folder_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files indexed on disk, asked for again without a change, and reported."""
    root = folders.written(table(spark, sf_dir, "documents"))
    path = f"{root}-index"
    _, built = index_store.ensure_index(spark, root, path)
    _, again = index_store.ensure_index(spark, root, path)
    return index_store.report(spark, path).select(F.lit(built).alias("built"), F.lit(again).alias("built_again"), "files", "chunks", F.col("n_skipped").alias("skipped"))


# --- files, families, marks of withdrawal -----------------------------------------------------------------
_ENDS = [*(e for ends in fixed.KINDS.values() for e in ends), ".bin", ""]
_KINDS = [next((k for k, ends in fixed.KINDS.items() if f".{e.rsplit('.', 1)[-1]}" in ends), None) if e else None for e in _ENDS]


@registered(
    f"""WITH f AS (SELECT page_id, (page_id % {len(_ENDS)})::INT + 1 AS i, CASE WHEN page_id % 11 = 0 THEN -1 WHEN page_id % 13 = 0 THEN 314572800 ELSE strlen(html) END AS size FROM pages),
g AS (SELECT *, {sql.one(_KINDS)}[i] AS kind FROM f)
SELECT page_id, kind, CASE WHEN size < 0 THEN 'cannot stat' WHEN page_id % 17 = 0 THEN 'not a regular file' WHEN size > {fixed.MAX_BYTES} THEN 'too large' WHEN kind IS NULL THEN 'unknown type'
  WHEN page_id % 7 = 0 THEN 'permission denied' WHEN kind IN ('docx', 'xlsx') AND page_id % 5 <> 0 THEN 'not a zip container (likely encrypted Office file)' END AS reason FROM g"""
)
def kind_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as if they were files of all kinds, some broken in some way."""
    page = F.col("page_id")
    name = F.concat(F.lit("f"), page.cast("string"), F.get(F.array(*map(F.lit, _ENDS)), (page % len(_ENDS)).cast("int")))
    size = F.when(page % 11 == 0, -1).when(page % 13 == 0, 300 * 1024 * 1024).otherwise(F.octet_length("html"))
    magic = F.when(page % 7 != 0, F.when(page % 5 == 0, F.unhex(F.lit("504B0304"))).otherwise(F.left("html", F.lit(4)).cast("binary")))
    files = table(spark, sf_dir, "pages").select("page_id", corpus.kind_of(name).alias("kind"), size.alias("size"), magic.alias("magic"), (page % 17 != 0).alias("regular"))
    return files.select("page_id", "kind", corpus.skip_reason("kind", "size", "magic", "regular").alias("reason"))


@registered(
    rf"""SELECT page_id, url, CASE lower(regexp_extract(url, '[^/.](\.[^./]*)$', 1)) {" ".join(f"WHEN '{e}' THEN '{k}'" for k, es in fixed.KINDS.items() for e in es)} END AS kind,
regexp_replace(CASE WHEN regexp_matches(url, '[^/.]\.[^./]*$') THEN regexp_replace(url, '\.[^./]*$', '') ELSE url END, '[_\-.]+', ' ', 'g') AS title FROM pages"""
)
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", corpus.kind_of("url").alias("kind"), text.title_of("url").alias("title"))


_REVISIONS = ["_r1.txt", "_rev2.txt", "-v3.txt", "_r4_WITHDRAWN.txt", ".txt", "_final.txt"]


@registered(
    """WITH f AS (SELECT doc_id, doc_id // 6 AS item, [1, 2, 3, 4, -1, -1][doc_id % 6 + 1] AS rev, doc_id % 6 <> 3 AS standing FROM documents),
w AS (SELECT *, count(*) OVER (PARTITION BY item) AS n, max(rev) FILTER (WHERE rev >= 0 AND standing) OVER (PARTITION BY item) AS top FROM f)
SELECT doc_id, 'reports/item' || item AS family, rev, standing AND NOT (n > 1 AND rev >= 0 AND coalesce(rev < top, false)) AS live FROM w"""
)
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as if each six were revisions of one report."""
    rel = F.concat(F.lit("reports/item"), F.floor(F.col("doc_id") / 6).cast("string"), F.get(F.array(*map(F.lit, _REVISIONS)), (F.col("doc_id") % 6).cast("int")))
    files = table(spark, sf_dir, "documents").select("doc_id", rel.alias("rel")).withColumn("withdrawn", text.withdrawn_by_name("rel"))
    return corpus.superseded(files).select("doc_id", text.family_key("rel").alias("family"), text.revision_number("rel").cast("int").alias("rev"), (~F.col("withdrawn")).alias("live"))


_MARKS = ["", "This revision is now withdrawn.", "status: obsolete", "What did the earlier revision say?", "value in r1 please", "value in r12 please"]
_SAID = f"SELECT doc_id, {sql.one(_MARKS)}[doc_id % 6 + 1] || ' ' || coalesce(text, '') AS said FROM documents"


@registered(f"SELECT doc_id, regexp_matches(left(said, {fixed.WITHDRAWN_CHARS}), '(?i){fixed.WITHDRAWN_TEXT}') AS withdrawn, regexp_matches(said, '(?i){fixed.OLD_REVISION}') AS asks_old FROM ({_SAID})")
def withdrawn_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under different openings."""
    said = F.concat(F.get(F.array(*map(F.lit, _MARKS)), (F.col("doc_id") % 6).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", text.withdrawn_by_text(said).alias("withdrawn"), text.asks_for_old(said).alias("asks_old"))


@registered("SELECT source, n FROM (SELECT source, count(*) FILTER (WHERE regexp_matches(left(text, 3000), '(?i)" + fixed.WITHDRAWN_TEXT + "')) AS n, count(*) AS all_n FROM documents GROUP BY source)")
def withdrawn_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(text.withdrawn_by_text("text")).alias("n"))


# --- replies and values -------------------------------------------------------------------------------------
@registered("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN n_chars::VARCHAR WHEN 1 THEN source WHEN 4 THEN lang ELSE '' END AS cleaned FROM documents")
def answer_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers built around columns of documents: with a label and a unit, in quotes, none, too long, with a remark."""
    kind = F.col("doc_id") % 5
    given = F.when(kind == 0, F.concat(F.lit("Answer: "), F.col("n_chars").cast("string"), F.lit(" mm"))).when(kind == 1, F.concat(F.lit('"'), "source", F.lit('"'))).when(kind == 2, F.lit("Not found"))
    given = given.when(kind == 3, F.array_join(F.array_repeat("source", 9), " ")).otherwise(F.concat(F.lit("result: "), "lang", F.lit(" (see table)")))
    return table(spark, sf_dir, "documents").select("doc_id", replies.clean_answer(given).alias("cleaned"))


@registered(
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 's' ELSE '' END AS steps, CASE doc_id % 3 WHEN 0 THEN coalesce(left(text, 40), '') WHEN 1 THEN source ELSE '' END AS answer,
CASE doc_id % 3 WHEN 0 THEN source || '.txt|' || lang || '.md' WHEN 1 THEN lang || '/a.txt' ELSE '' END AS sources FROM documents"""
)
def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies built from documents: fenced JSON, broken JSON, none."""
    kind = F.col("doc_id") % 3
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.lit("s").alias("steps"), F.left("text", F.lit(40)).alias("answer"), F.array(F.concat("source", F.lit(".txt")), F.concat("lang", F.lit(".md"))).alias("sources"))), F.lit("\n```"))
    broken = F.concat(F.lit('so "answer": "'), "source", F.lit('" and "'), "lang", F.lit('/a.txt"'))
    rows = table(spark, sf_dir, "documents").select("doc_id", replies.parse_reply(F.when(kind == 0, fenced).when(kind == 1, broken).otherwise(F.lit("nothing said"))).alias("r"))
    return rows.select("doc_id", "r.steps", "r.answer", F.array_join("r.sources", "|").alias("sources"))


@registered("SELECT doc_id, doc_id % 4 IN (0, 3) AS hit FROM documents")
def value_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value of each document in other spellings, and as part of longer tokens."""
    number, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    value = F.concat(F.lit("AB"), number, F.lit("-"), "lang")
    body = F.when(kind == 0, F.concat(F.lit("part ab"), number, F.lit(" "), F.upper("lang"), F.lit(" here"))).when(kind == 1, F.concat(F.lit("part"), value)).when(kind == 2, F.concat(value, F.lit("x"))).otherwise(F.concat(F.lower(value), F.lit(".")))
    return table(spark, sf_dir, "documents").select("doc_id", text.contains_value(body, value).alias("hit"))


#: Words that documents are asked for.
WORDS = ["the", "und", "avec", "que", "is", "BY-NC"]


@registered(
    f"""WITH v AS (SELECT unnest({sql.one(WORDS)}) AS value)
SELECT value, count(*) AS documents, min(doc_id) AS first_doc FROM v JOIN documents ON regexp_matches(text, '(?i)(?:^|[^0-9A-Za-z])' || value || '(?:[^0-9A-Za-z]|$)') GROUP BY value"""
)
def value_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each of some words stands as a whole token."""
    asked = spark.createDataFrame([(v,) for v in WORDS], "value string").withColumn("pattern", text.value_pattern("value"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = docs.join(asked, F.rlike("text", "pattern"))
    return hits.groupBy("value").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))


@registered("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a/' || source || '.txt' WHEN 1 THEN 'b/' || source || '.txt|c/' || lang || '.csv' WHEN 2 THEN 'b/' || source || '.txt' ELSE '' END AS resolved FROM documents")
def names_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files by base name, by path, by a path beyond the corpus, and of no file."""
    path = lambda folder, name, end: F.concat(F.lit(folder), name, F.lit(end))
    kind = F.col("doc_id") % 4
    names = F.when(kind == 0, F.array(path("", "source", ".txt"))).when(kind == 1, F.array(path("b/", "source", ".txt"), path("./c/", "lang", ".csv"))).when(kind == 2, F.array(path("/mnt/app/corpus/b/", "source", ".txt"))).otherwise(F.array(F.lit("none.bin")))
    rows = table(spark, sf_dir, "documents").select("doc_id", names.alias("names"), F.array(path("a/", "source", ".txt"), path("b/", "source", ".txt"), path("c/", "lang", ".csv")).alias("allowed"))
    return rows.select("doc_id", F.array_join(citations.resolve_names("names", "allowed"), "|").alias("resolved"))


# --- transcriptions ------------------------------------------------------------------------------------------
@registered(
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'US_PLATE' WHEN 1 THEN 'CN_PLATE' ELSE 'SIGN' END AS kind,
CASE c_custkey % 3 WHEN 0 THEN upper(left(c_mktsegment, 3)) || c_custkey WHEN 1 THEN '京A·' || c_custkey ELSE upper(c_name) END AS cleaned FROM customer"""
)
def ocr_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as recognised plates and signs."""
    kind, number = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    us = F.concat(F.lit("TYPE: US_PLATE\nTEXT: Texas "), F.lower(F.left("c_mktsegment", F.lit(3))), number)
    raw = F.when(kind == 0, us).when(kind == 1, F.concat(F.lit("**TYPE**: CN_PLATE\n**TEXT**: 京A・"), number)).otherwise(F.concat(F.lit("TYPE: SIGN\nTEXT: x\nTEXT: “"), "c_name", F.lit("”")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")).withColumn("kind", recognition.reply_kind("raw"))
    return rows.select("c_custkey", "kind", recognition.clean_recognised(recognition.reply_text("raw"), "kind").alias("cleaned"))


@registered(
    """WITH p AS (SELECT user_id, greatest(1e-9, least(1.0, abs(value) / 1000)) AS p FROM events WHERE value IS NOT NULL)
SELECT user_id, count(*) AS n, round(exp(avg(ln(p))), 3) AS confidence FROM p GROUP BY user_id"""
)
def event_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometric means of rescaled values as if they were token probabilities, as an aggregate."""
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1.0), F.abs("value") / 1000))
    return table(spark, sf_dir, "events").where("value is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.exp(F.avg(F.log(p))), 3).alias("confidence"))


_SIDE = "CASE WHEN greatest(w, h) > 1600 THEN greatest(1, round_even({0} * (1600.0::DOUBLE / greatest(w, h)), 0)) WHEN greatest(w, h) < 640 THEN greatest(1, round_even({0} * (640.0::DOUBLE / greatest(w, h)), 0)) ELSE {0} END::INT"


@registered(
    f"""WITH e AS (SELECT event_id, least(1.0, abs(value) / 1000) AS p, (event_id % 4999 + 1)::INT AS w, (event_id % 2999 + 1)::INT AS h FROM events)
SELECT event_id, CASE WHEN p IS NULL THEN 0.0 ELSE round_even(exp((ln(greatest(p, 1e-9)) + ln(0.5::DOUBLE)) / 2), 4) END AS confidence, {_SIDE.format("w")} AS width, {_SIDE.format("h")} AS height FROM e"""
)
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as images with two token probabilities (none without a value) and a size."""
    p, size = F.least(F.lit(1.0), F.abs("value") / 1000), lambda most: (F.col("event_id") % most + 1).cast("int")
    probabilities = F.when(p.isNull(), F.array().cast("array<double>")).otherwise(F.array(p, F.lit(0.5)))
    rows = table(spark, sf_dir, "events").select("event_id", recognition.confidence(probabilities).alias("confidence"), recognition.model_size(size(4999), size(2999)).alias("s"))
    return rows.select("event_id", "confidence", "s.width", "s.height")


@registered(
    """WITH d AS (SELECT source, doc_id, text FROM documents)
SELECT 20 * (SELECT count(*) FROM d WHERE doc_id % 3 = 0 AND doc_id % 10 <> 0 AND text IS NOT NULL) AS points, 20 * (SELECT count(*) FROM d) AS most, (SELECT coalesce(max(doc_id % 7 / 2.0::DOUBLE), 0.0) FROM d WHERE doc_id % 10 <> 0) AS slowest"""
)
def score_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' beginnings as expected transcriptions; a third comes back in another spelling, a third wrong, a third not."""
    start, number = F.left("text", F.lit(20)), F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    got = F.when(number % 3 == 0, F.concat(F.lit("- "), F.upper(start))).when(number % 3 == 1, F.concat(start, F.lit("x")))
    expected = docs.select(number.alias("name"), start.alias("text"))
    return score.total_score(expected, score.compared(expected, docs.select(number.alias("name"), got.alias("text"), ((number % 7) / 2).alias("seconds"), (number % 10 != 0).alias("present"))))


# --- questions and results -------------------------------------------------------------------------------------
@registered(
    """SELECT item_id, 1 AS n, item_id::VARCHAR AS qid, text AS question FROM benchmark WHERE item_id % 3 < 2
UNION ALL SELECT item_id, 1, item_id || '_1', text FROM benchmark WHERE item_id % 3 = 2 UNION ALL SELECT item_id, 2, 'k' || item_id, text FROM benchmark WHERE item_id % 3 = 2"""
)
def question_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as plain files, objects and lists."""
    item, kind = F.col("item_id"), F.col("item_id") % 3
    path = F.concat(F.lit("q/"), item.cast("string"), F.when(kind == 0, ".txt").otherwise(".json"))
    one = F.to_json(F.struct(item.alias("id"), F.col("text").alias("query")))
    several = F.concat(F.lit("["), F.to_json(F.struct("text")), F.lit(", "), F.to_json(F.struct(F.concat(F.lit("k"), item.cast("string")).alias("qid"), F.col("text"))), F.lit(", 3]"))
    files = table(spark, sf_dir, "benchmark").select(path.alias("path"), F.when(kind == 0, F.col("text")).when(kind == 1, one).otherwise(several).alias("content"))
    return questions.parse_questions(files).select(text.without_extension(text.base_name("path")).cast("long").alias("item_id"), F.col("n").cast("int").alias("n"), "qid", "question")


@registered("SELECT conv_id::VARCHAR AS qid, turn AS n, text AS question FROM conversations WHERE role = 'user'")
def conversation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a question file in JSON, read back."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    files = asked.select(F.concat(F.lit("q/"), F.col("turn").cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct(F.col("conv_id").alias("id"), F.col("text").alias("question"))).alias("content"))
    return questions.parse_questions(files).select("qid", text.without_extension(text.base_name("path")).cast("long").alias("n"), "question")


@registered(
    """SELECT 'item_' || item_id || '_x_output.json' AS name, '{"answer":' || CASE WHEN item_id % 4 = 0 THEN '""' ELSE to_json(left(text, 30))::VARCHAR END
|| ',"citations":[' || CASE WHEN item_id % 4 = 0 THEN '' ELSE '"doc/' || item_id || '.txt"' END || '],"confidence":' || CASE WHEN item_id % 4 = 0 THEN '0.0' ELSE '0.9' END || '}' AS body FROM benchmark"""
)
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as results, a quarter of them without an answer."""
    number, none = F.col("item_id").cast("string"), F.col("item_id") % 4 == 0
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item "), number, F.lit("/x")).alias("qid"), F.when(~none, F.left("text", F.lit(30))).alias("answer"), F.array(F.concat(F.lit("doc/"), number, F.lit(".txt"))).alias("citations"), F.when(none, 0.0).otherwise(fixed.CONFIDENT).alias("confidence"))
    return results.answer_json(rows)


# --- the whole search, over documents; checked by hand on a small corpus in the tests ------------------------------
_INDEXES: dict[tuple[str, str], index.Index] = {}


def document_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of the documents, its tables written once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = index.staged_index(corpus.documents_as_files(table(spark, sf_dir, "documents")))
    return _INDEXES[key]


def benchmark_search(spark: SparkSession, sf_dir: str) -> tuple[index.Index, DataFrame, DataFrame]:
    held, asked = document_index(spark, sf_dir), benchmark_questions(spark, sf_dir)
    return held, asked, retrieve.search(held, asked)


@registered()
def search_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of the whole search for each benchmark item, bridge chunks spliced in."""
    held, _, found = benchmark_search(spark, sf_dir)
    return found.join(held.chunks, "chunk_id").select("qid", "pos", "rel", "loc")


@registered()
def bridge_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers that the best chunks of each benchmark item lead on to."""
    held, asked = document_index(spark, sf_dir), benchmark_questions(spark, sf_dir)
    return retrieve.bridge_identifiers(held, asked, retrieve.first_ranking(held, asked)[1]).select("qid", "hop", "id")


@registered()
def context_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each benchmark item: its length, a digest, and the files in order."""
    packed = context.pack_context(*benchmark_search(spark, sf_dir))
    return packed.select("qid", F.length("context").alias("n_chars"), F.md5(F.col("context").cast("binary")).alias("digest"), F.array_join("files", "|").alias("files"))


@registered()
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question to citations with a reader that repeats the fourth to sixth word of the item and names no file."""
    held, asked = document_index(spark, sf_dir), benchmark_questions(spark, sf_dir)
    said = F.array_join(F.slice(F.split("question", " "), 4, 3), " ")
    reader = Recorded(reply_table=asked.select("qid", F.to_json(F.struct(said.alias("answer"))).alias("reply")))
    return answer.answer(held, asked, reader).select("qid", "answer", F.array_join("citations", "|").alias("citations"), "confidence")
