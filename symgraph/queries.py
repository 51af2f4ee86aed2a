"""The engine's operators bound to the tables, each with the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions import text as t
from symgraph.functions.imports import extract_imports
from symgraph.functions.paths import detect_language, should_skip, stored_language, under_dir
from symgraph.operators import diff, digest, graph, lookups
from symgraph.operators import search as s
from symgraph.plans import registry
from symgraph.session import with_package
from symgraph.sources import changes
from symgraph.sources.files import project_status as status_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def bound(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that gives the same rows."""

    def register(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


# --- search -------------------------------------------------------------------

_SCORED = """
    WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
    scored AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS score FROM embeddings, q)"""


@bound(_SCORED + " SELECT vec_id, label, round(score, 4) AS score FROM scored WHERE label = 3 AND score >= 0.01 ORDER BY scored.score DESC, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = s.search(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 20, 0.01, {"label": 3}, ties=["vec_id"])
    return hits.select("vec_id", "label", F.round("score", 4).alias("score"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings")
    return points.select("vec_id", "embedding", F.col("label").alias("file_path"), (F.col("vec_id") % 25).alias("symbol"), (F.col("vec_id") % 3).alias("branch"))


_RANKED = """,
    versions AS (SELECT vec_id, label AS file_path, vec_id % 25 AS symbol, vec_id % 3 AS branch, score FROM scored)"""
_COLLAPSED = """
    SELECT file_path, symbol, branch, vec_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (
        PARTITION BY file_path, symbol ORDER BY CASE branch WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END, score DESC, vec_id) AS n FROM {source}) WHERE n = 1"""


@bound(_SCORED + _RANKED + _COLLAPSED.format(source="versions"))
def vector_collapse_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = s.score_points(_versions(spark, sf_dir), _vector(spark, sf_dir))
    best = s.collapse(hits, [2, 0], ties=["vec_id"])
    return best.select("file_path", "symbol", "branch", "vec_id", F.round("score", 4).alias("score"))


@bound(
    _SCORED + _RANKED + ", few AS (SELECT * FROM versions WHERE branch IN (0, 2) ORDER BY score DESC, vec_id LIMIT 80), best AS ("
    + _COLLAPSED.format(source="few").replace("round(score, 4) AS score", "score") + ") SELECT file_path, symbol, branch, vec_id, round(score, 4) AS score FROM best ORDER BY best.score DESC, vec_id LIMIT 10"
)
def vector_overfetch_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = s.search(_versions(spark, sf_dir), _vector(spark, sf_dir), 10, chain=[2, 0], ties=["vec_id"], fanout=4)
    best = s.top(s.collapse(hits, [2, 0], ties=["vec_id"]), 10, ["vec_id"])
    return best.select("file_path", "symbol", "branch", "vec_id", F.round("score", 4).alias("score"))


@bound("SELECT vec_id, label FROM embeddings WHERE NOT (label = 1 AND vec_id >= 100)")
def vector_delete_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").withColumn("recent", F.col("vec_id") >= 100)
    return diff.delete_where(points, label=1, recent=True).select("vec_id", "label")


@bound("""SELECT doc_id, CASE WHEN lang = 'en' THEN 'new' ELSE 'old' END AS origin, source FROM documents WHERE lang = 'en' OR source <> 'src3'""")
def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    old, new = docs.where("source <> 'src3'"), docs.where("lang = 'en'")
    both = diff.upsert(old.withColumn("origin", F.lit("old")), new.withColumn("origin", F.lit("new")), ["doc_id"])
    return both.select("doc_id", "origin", "source")


@bound("""
    WITH n AS (SELECT 'r' || n_regionkey AS file, n_name AS symbol, count(c_custkey) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
    f AS (SELECT file, symbol, CASE symbol WHEN 'NATION_7' THEN 1 ELSE 2 END AS position FROM n WHERE symbol IN ('NATION_7', 'NATION_3')),
    o AS (SELECT file, symbol, row_number() OVER (ORDER BY k DESC, symbol) AS position FROM n)
    SELECT file, symbol, CAST(position AS BIGINT) AS position, 0 AS source FROM f UNION ALL
    SELECT file, symbol, position, 1 FROM o WHERE position <= 8 AND symbol NOT IN (SELECT symbol FROM f)""")
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    nodes = nation.select(F.col("n_name").alias("id"), F.lit("type").alias("kind"), F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("file"))
    found = s.exact(nodes, "does NATION_7 trade with NATION_3 or NATION_7?", 10)
    first = found.select("file", F.col("name").alias("symbol"), F.when(F.col("name") == "NATION_7", 1).otherwise(2).cast("bigint").alias("position"))
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).count()
    rank = F.row_number().over(s.Window.orderBy(F.coalesce("count", F.lit(0)).desc(), "n_name"))  # nations: 25 rows
    then = nation.join(sizes, "n_nationkey", "left").select(F.concat(F.lit("r"), "n_regionkey").alias("file"), F.col("n_name").alias("symbol"), rank.cast("bigint").alias("position"))
    return s.merge(first, then, 10)


_TOKENS = "list_distinct(list_filter(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: length(x) >= 3))"


@bound(f"SELECT doc_id, CAST(len({_TOKENS.format(text='text')}) AS BIGINT) AS tokens, sha256(array_to_string(list_sort({_TOKENS.format(text='text')}), ' ')) AS digest FROM documents")
def query_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", t.query_identifiers(F.col("text")).alias("tokens"))
    return found.select("doc_id", F.size("tokens").cast("bigint").alias("tokens"), F.sha2(F.array_join(F.array_sort("tokens"), " "), 256).alias("digest"))


@bound(f"""
    WITH names AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part), m AS (SELECT min(name) AS a, max(name) AS z FROM names),
    asked AS (SELECT doc_id, unnest({_TOKENS.format(text="text || ' ' || source || ' ' || CASE doc_id % 3 WHEN 0 THEN a || ' and ' || z WHEN 1 THEN z ELSE '' END")}) AS name FROM documents, m)
    SELECT name, count(*) AS asked, CAST(sum(doc_id) AS BIGINT) AS ids FROM asked JOIN names USING (name) GROUP BY name""")
def exact_token_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of part names that each document's text, with some names added, mentions."""
    names = table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("name")).distinct()
    ends = names.agg(F.min("name").alias("a"), F.max("name").alias("z"))
    docs = table(spark, sf_dir, "documents").crossJoin(F.broadcast(ends))  # one row
    added = F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" and ", "a", "z")).when(F.col("doc_id") % 3 == 1, F.col("z")).otherwise("")
    asked = docs.select("doc_id", F.concat_ws(" ", "text", "source", added).alias("question"))
    nodes = names.select("name", F.lit("func").alias("kind"), F.lit("").alias("file"), F.col("name").alias("id"))
    found = s.exact_each(nodes, asked, "doc_id", "question")
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("asked"), F.sum("doc_id").alias("ids"))


# --- scalars ------------------------------------------------------------------

_DIRTY = "'  ' || replace(text, chr(10), '  ' || chr(9) || chr(10) || chr(10) || ' ' || chr(10) || chr(10)) || chr(10) || ' '"
_CLEAN = "trim(regexp_replace(regexp_replace({x}, '[ \\t]+(\\n|\\z)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"


def _dirtied(text: str = "text"):
    gap = "  \t\n\n \n\n"
    return F.concat(F.lit("  "), F.replace(F.col(text), F.lit("\n"), F.lit(gap)), F.lit("\n "))


@bound(f"SELECT doc_id, sha256({_CLEAN.format(x=_DIRTY)}) AS digest, {_CLEAN.format(x=_DIRTY)} <> {_DIRTY} AS changed FROM documents")
def normalize_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _dirtied().alias("dirty"))
    clean = t.normalize_content(F.col("dirty"))
    return docs.select("doc_id", F.sha2(clean, 256).alias("digest"), (clean != F.col("dirty")).alias("changed"))


@bound("SELECT doc_id, sha256(source || chr(0) || lang || chr(0) || doc_id) AS chunk_id, left(sha256(source || chr(0) || lang || chr(0) || doc_id), 8) AS head FROM documents")
def chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = t.chunk_id(F.col("source"), F.col("lang"), F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", identity.alias("chunk_id"), F.substring_index(t.storage_uuid(identity), "-", 1).alias("head"))


@bound(f"SELECT sha256({_CLEAN.format(x='text')}) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", t.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@bound("""
    WITH x AS (SELECT doc_id, trim(split_part(trim(text), chr(10), 1)) AS line FROM documents)
    SELECT doc_id, CASE WHEN length(line) > 160 THEN left(line, 160) || '…' ELSE line END AS summary FROM x""")
def clip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.clip_summary(F.col("text")).alias("summary"))


@bound("SELECT doc_id, sha256(left(text, 1000)) AS digest, length(left(text, 1000)) AS chars, length(text) AS uncapped FROM documents")
def cap_runes(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped, whole = t.cap_chars(F.col("text"), 1000), t.cap_chars(F.col("text"), 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(capped, 256).alias("digest"), F.length(capped).cast("bigint").alias("chars"), F.length(whole).cast("bigint").alias("uncapped"))


_HEADER = "source || ' [text] in ' || lang || chr(10) || 'Does: ' || chr(10) || 'Serves: ' || chr(10) || 'Duties: ' || chr(10) || 'Uses: ' || lang || ', ' || source || chr(10) || 'Topics: ' || chr(10) || chr(10)"
_CUT = f"""
    WITH h AS (SELECT doc_id, {_HEADER} AS head, {_CLEAN.format(x='text')} AS body FROM documents),
    w AS (SELECT *, CASE WHEN length(head) + length(body) <= 4000 THEN greatest(length(body), 1) ELSE greatest(4000 - length(head), 1000) END AS width FROM h),
    cut AS (SELECT *, unnest(range(0, greatest(CAST(ceil(length(body) / width) AS BIGINT), 1))) AS number FROM w)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    listed = F.lit(None).cast("array<string>")
    header = t.embed_header(F.col("source"), F.lit("text"), F.col("lang"), none, none, listed, F.array("lang", "source"), listed)
    docs = table(spark, sf_dir, "documents").select("doc_id", header.alias("head"), t.normalize_content(F.col("text")).alias("body"))
    return docs.select("doc_id", F.posexplode(t.embed_chunks(F.col("head"), F.col("body"), 4000)).alias("number", "chunk"))


@bound(_CUT + " SELECT doc_id, number, sha256(head || substr(body, number * width + 1, width)) AS digest, length(substr(body, number * width + 1, width)) AS chars FROM cut")
def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", F.col("number").cast("bigint").alias("number"), F.sha2("chunk.text", 256).alias("digest"), F.length("chunk.content").cast("bigint").alias("chars"))


@bound(_CUT + ", n AS (SELECT doc_id, count(*) AS chunks FROM cut GROUP BY doc_id) SELECT chunks, count(*) AS documents FROM n GROUP BY chunks")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _chunks(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    return counted.groupBy("chunks").agg(F.count(F.lit(1)).alias("documents"))


_KEYWORDS = ", ".join(f"'{k}'" for k in t.CALL_KEYWORDS)


@bound(f"""
    WITH found AS (SELECT page_id, list_distinct(list_filter(regexp_extract_all(html, '([A-Za-z0-9_]+(?:\\.[A-Za-z0-9_]+)?)[\\t\\n\\f\\r ]*\\(', 1),
        lambda c: c NOT IN ({_KEYWORDS}) AND split_part(c, '.', -1) NOT IN ({_KEYWORDS}))) AS calls FROM pages)
    SELECT page_id, array_to_string(list_sort(calls), ',') AS calls FROM found""")
def extract_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(t.extract_calls(F.col("html"))), ",").alias("calls"))


@bound("""
    WITH w AS (SELECT p_partkey, replace(p_brand, '#', '') AS p, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
    SELECT p_partkey, 'go' AS language, unnest([b, a]) AS alias, unnest(['x.org/' || p || '/' || b, 'x.org/' || p]) AS path FROM w UNION ALL
    SELECT p_partkey, 'typescript', unnest([a, b, b || 's', a || '_c']), unnest(['./' || p, p, '../' || p, '../' || p]) FROM w""")
def import_extract_go_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_brand", F.lit("#"), F.lit("")).alias("p"), F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("b"))
    go = F.format_string('import (\n\t"x.org/%s/%s"\n\t%s "x.org/%s"\n\t_ "side/effects"\n)\n', "p", "b", "a", "p")
    script = F.format_string("import * as %s from './%s'\nimport %s from \"%s\"\nimport { %ss, x as %s_c } from `../%s`\n", "a", "p", "b", "p", "b", "a", "p")
    both = part.select("p_partkey", F.lit("go").alias("language"), go.alias("source")).unionByName(part.select("p_partkey", F.lit("typescript").alias("language"), script.alias("source")))
    refs = both.select("p_partkey", "language", F.explode(extract_imports(F.col("language"), F.col("source"))).alias("r"))
    return refs.select("p_partkey", "language", "r.alias", "r.path")


@bound("""
    SELECT p_partkey, unnest([a || '_x', b, 'pkg', a]) AS alias, unnest([p_brand || '.' || b, p_brand || '.' || a, 'top.pkg', p_brand || '.sub.' || a]) AS path
    FROM (SELECT p_partkey, replace(p_brand, '#', '') AS p_brand, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""")
def import_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_brand", F.lit("#"), F.lit("")).alias("p"), F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("b"))
    source = F.format_string("from %s import %s as %s_x, (%s as %s)\nimport top.pkg\nfrom %s.sub import %s, *\nx = 1\n", "p", "b", "a", "a", "b", "p", "a")
    refs = part.select("p_partkey", F.explode(extract_imports(F.lit("python"), source)).alias("r"))
    return refs.select("p_partkey", "r.alias", "r.path")


_PATH = "regexp_extract(url, '://[^/]+/([^?#]*)', 1) || CASE page_id % 8 WHEN 0 THEN '/vendor/lib.GO' WHEN 1 THEN '/a_test.go' WHEN 2 THEN '/x.pb.go' WHEN 3 THEN '/node_modules/p/i.tsx' WHEN 4 THEN '/m.py' WHEN 5 THEN '/vendors/s.rb' WHEN 6 THEN '/k.js' ELSE '' END"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = ["/vendor/lib.GO", "/a_test.go", "/x.pb.go", "/node_modules/p/i.tsx", "/m.py", "/vendors/s.rb", "/k.js", ""]
    tail = F.element_at(F.array(*map(F.lit, tails)), (F.col("page_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "://[^/]+/([^?#]*)", 1), tail).alias("path"))


@bound(f"SELECT page_id, {_PATH} AS path FROM pages WHERE NOT regexp_matches({_PATH}, '(^|/)(vendor|node_modules)/|_test\\.go$|\\.pb\\.go$')")
def skip_glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(~should_skip(F.col("path"), ["vendor/**", "**/node_modules/**", "**/*.pb.go"]))


@bound(f"SELECT page_id, {_PATH} AS path FROM pages WHERE NOT ({_PATH} = 'en' OR starts_with({_PATH}, 'en/') OR starts_with({_PATH}, 'de/1/'))")
def ignore_dir_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(~under_dir(F.col("path"), ["en/", "./de/1"]))


@bound(f"""
    WITH p AS (SELECT page_id, lower(regexp_extract({_PATH}, '\\.([^./]*)$', 1)) AS e FROM pages)
    SELECT page_id, CASE e WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'rb' THEN 'ruby' ELSE '' END AS lang,
           CASE e WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'tsx' THEN 'ts' WHEN 'js' THEN 'js' ELSE '' END AS language FROM p""")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", detect_language(F.col("path")).alias("lang"), stored_language(F.col("path")).alias("language"))


@bound("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'not json' ELSE 'k=' || json_extract_string(props, '$.k') END AS summary,
          CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS tags FROM events""")
def llm_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.to_json(F.struct(F.concat(F.lit("k="), F.get_json_object("props", "$.k")).alias("summary"), F.array("event_type").alias("tags")))
    reply = t.parse_reply(F.when(F.col("event_type") == "error", " not json\n").otherwise(made))
    events = table(spark, sf_dir, "events").select("event_id", reply.alias("r"))
    return events.select("event_id", F.trim(F.rtrim("r.summary", F.lit("\n"))).alias("summary"), F.array_join("r.tags", ",").alias("tags"))


# --- manifest and changes -----------------------------------------------------


def _snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Symbols now (one source is gone), and a manifest that lacks another and has old hashes for one language."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").cast("string").alias("symbol"), "lang", F.sha2("text", 256).alias("content_hash"))
    manifest = docs.where("file <> 'src7'").select("file", "symbol", t.chunk_id(F.lit("main"), F.col("symbol"), F.lit(0)).alias("chunk_id"), F.when(F.col("lang") == "de", "old").otherwise(F.col("content_hash")).alias("embedded_hash"))
    return docs.where("file <> 'src5'"), manifest


@bound("SELECT source AS file, CAST(doc_id AS VARCHAR) AS symbol FROM documents WHERE source <> 'src5' AND (source = 'src7' OR lang = 'de')")
def manifest_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, manifest = _snapshot(spark, sf_dir)
    return diff.dirty_symbols(symbols, manifest).select("file", "symbol")


@bound("SELECT source AS file, CAST(doc_id AS VARCHAR) AS symbol FROM documents WHERE source IN ('src5', 'src2')")
def manifest_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, manifest = _snapshot(spark, sf_dir)
    deleted = spark.createDataFrame([("src2",)], "file string")
    return diff.stale_rows(manifest, symbols, deleted).select("file", "symbol")


@bound("SELECT source AS file, CAST(doc_id AS VARCHAR) AS symbol, sha256('main' || chr(0) || doc_id || chr(0) || '1') AS chunk_id FROM documents WHERE lang = 'fr' AND n_chars <= 2000")
def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").cast("string").alias("symbol"), "lang", "n_chars")
    old = docs.select("file", "symbol", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    new = docs.where("lang = 'fr'").select("file", "symbol", F.explode(F.when(F.col("n_chars") > 2000, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("n"))
    with_id = lambda df: df.select("file", "symbol", t.chunk_id(F.lit("main"), F.col("symbol"), F.col("n")).alias("chunk_id"))
    return diff.orphan_chunks(with_id(old), with_id(new))


@bound("SELECT CAST(doc_id AS VARCHAR) AS symbol FROM documents WHERE source = 'src7'")
def extend_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("symbol"))
    keyed = docs.withColumn("chunk_id", t.chunk_id(F.lit("main"), F.col("symbol"), F.lit(0)))
    return diff.missing(keyed, keyed.where("source <> 'src7'").select("chunk_id")).select("symbol")


@bound("""
    SELECT CAST(o_orderkey AS VARCHAR) AS file, 'changed' AS op FROM orders WHERE o_orderdate > TIMESTAMP '1999-01-01' UNION ALL
    SELECT CAST(l_orderkey AS VARCHAR) AS file, 'deleted' FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""")
def changed_files_mtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("file"), "o_orderstatus", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("modified"))
    changed = diff.changed_since(orders, 915148800).select("file", F.lit("changed").alias("op"))
    manifest = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"))
    return changed.unionByName(diff.removed_files(manifest, orders.where("o_orderstatus <> 'F'")).withColumn("op", F.lit("deleted")))


_STATUS_SQL = """
    WITH p AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') || p_partkey AS f, p_type AS y FROM part)
    SELECT f AS path, CASE WHEN y IN ('ECONOMY', 'SMALL') THEN 'deleted' ELSE 'changed' END AS op FROM p UNION ALL
    SELECT f || '.new', 'changed' FROM p WHERE y = 'SMALL'"""


def _lines(spark: SparkSession, sf_dir: str, gone: str, moved: str, other: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_type", F.concat(F.translate("p_name", " ", "_"), "p_partkey").alias("f"))
    shape = F.when(F.col("p_type") == "ECONOMY", F.format_string(gone, "f")).when(F.col("p_type") == "SMALL", F.format_string(moved, "f", "f")).otherwise(F.format_string(other, "f"))
    return part.select(shape.alias("line"))


@bound(_STATUS_SQL)
def name_status_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.parse_name_status(_lines(spark, sf_dir, "D\t%s", "R100\t%s\t%s.new", "M\t%s"))


@bound(_STATUS_SQL)
def porcelain_status_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.parse_porcelain(_lines(spark, sf_dir, " D %s", 'R  %s -> "%s.new"', "?? %s"))


@bound("SELECT CAST(user_id AS VARCHAR) AS path, min(event_id) AS first_commit FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type IN ('click', 'purchase') GROUP BY 1")
def commit_replay_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    commits = events.select(F.col("event_id").alias("commit"), "ts")
    status = F.when(F.col("event_type") == "click", "M").when(F.col("event_type") == "purchase", "A").otherwise("D")
    touched = events.select(F.col("event_id").alias("commit"), F.col("user_id").cast("string").alias("path"), status.alias("status"))
    return changes.replay_commits(commits, touched, F.lit("2024-01-15").cast("timestamp_ntz"))


@bound("""
    WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS path, 'changed' AS op FROM customer UNION ALL
               SELECT CAST(o_custkey AS VARCHAR), CASE o_orderstatus WHEN 'F' THEN 'deleted' ELSE 'changed' END FROM orders)
    SELECT path, CASE WHEN bool_or(op = 'deleted') THEN 'deleted' ELSE 'changed' END AS op FROM a GROUP BY path""")
def change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.lit("changed").alias("op"))
    orders = table(spark, sf_dir, "orders")
    ranged = orders.select(F.col("o_custkey").cast("string").alias("path"), F.when(F.col("o_orderstatus") == "F", "deleted").otherwise("changed").alias("op"))
    return diff.change_set(seen, ranged)


@bound("SELECT CAST(c_custkey AS VARCHAR) AS name, count(o_orderkey) > 0 AS indexed, count(o_orderkey) AS points FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def project_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name"))
    return status_of(projects, table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("project")))


# --- graph --------------------------------------------------------------------


def _supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("calls").alias("kind")).distinct()


@bound("""
    SELECT 'p' || l_partkey AS id, count(DISTINCT l_suppkey) AS callers, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey
    GROUP BY ALL ORDER BY callers DESC, name, id LIMIT 10""")
def fan_in_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"))
    return graph.top_fan_in(_supplies(spark, sf_dir), nodes, 10)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = lambda name, a, x, b, y: table(spark, sf_dir, name).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    return edge("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(edge("customer", "n", "c_nationkey", "c", "c_custkey")).unionByName(edge("orders", "c", "o_custkey", "o", "o_orderkey"))


_TREE_SQL = """
    WITH RECURSIVE e(src, dst) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
        UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),"""
_RING_SQL = """
    WITH RECURSIVE e(src, dst) AS MATERIALIZED (SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem WHERE l_returnflag = 'R'
        UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_returnflag <> 'R'),"""
_WALK_SQL = " w(id, depth) AS (SELECT {root}, 0 UNION SELECT {to}, depth + 1 FROM w JOIN e ON {own} = id WHERE depth < {depth})"


def _ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with cycles: every line item leads from supplier to part, or back, by its return flag."""
    items = table(spark, sf_dir, "lineitem")
    s_, p = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    return_ = items.where("l_returnflag = 'R'").select(s_.alias("src"), p.alias("dst"))
    return return_.unionByName(items.where("l_returnflag <> 'R'").select(p.alias("src"), s_.alias("dst"))).distinct()


def _root(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(name,)], "id string")


@bound(_TREE_SQL + _WALK_SQL.format(root="'r1'", to="dst", own="src", depth=3) + " SELECT id, depth FROM w WHERE depth > 0")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.walk(_tree(spark, sf_dir), _root(spark, "r1"), 3)


@bound(_RING_SQL + _WALK_SQL.format(root="'s5'", to="src", own="dst", depth=4) + " SELECT id, depth FROM w WHERE depth > 0")
def walk_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.walk(_ring(spark, sf_dir), _root(spark, "s5"), 4, forward=False)


@bound(_RING_SQL + _WALK_SQL.format(root="'s5'", to="dst", own="src", depth=5) + " SELECT id, min(depth) AS depth FROM w WHERE id <> 's5' GROUP BY id")
def deps_min_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = graph.walk(_ring(spark, sf_dir), _root(spark, "s5"), 5, min_depth=True)
    return reached.where("id <> 's5'")


@bound("""
    WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem),
    b AS (SELECT src AS id, 'out' AS direction, dst AS other FROM e UNION ALL SELECT dst, 'in', src FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY id, direction ORDER BY other) AS n FROM b)
    SELECT id, direction, 'calls' AS kind, other FROM r WHERE n <= 8""")
def adjacency_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _supplies(spark, sf_dir)
    roots = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return graph.adjacency(edges, roots, 8)


@bound("""
    WITH RECURSIVE c(branch, hop, ancestor) AS (SELECT doc_id, 0, doc_id FROM documents UNION ALL
        SELECT branch, hop + 1, ancestor // 2 FROM c WHERE hop < 16 AND ancestor > 0)
    SELECT branch, hop, ancestor FROM c""")
def branch_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("branch"), F.when(F.col("doc_id") > 0, F.floor(F.col("doc_id") / 2)).alias("parent"))
    return graph.all_branch_chains(branches)


@bound("""
    SELECT o_custkey, o_orderkey AS candidate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
        ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey) AS n FROM orders) WHERE n = 1""")
def parent_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("candidate"), F.col("o_orderdate").alias("base_ts"), F.col("o_orderpriority").alias("ahead"))
    return graph.parent_branch(candidates, ["o_custkey"]).select("o_custkey", "candidate")


_WORDS = "SELECT DISTINCT replace(p_brand, '#', '') AS b, split_part(p_name, ' ', 1) AS x, split_part(p_name, ' ', 2) AS y FROM part"


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A method for each brand and second word, which calls the methods named by the first words."""
    part = table(spark, sf_dir, "part").select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("b"), F.split("p_name", " ")[0].alias("x"), F.split("p_name", " ")[1].alias("y"))
    return part


@bound(f"""
    WITH w AS ({_WORDS}), m AS (SELECT DISTINCT b || '.' || x AS symbol, x AS bare FROM w),
    c AS (SELECT DISTINCT b || '.' || x AS caller, 'Brand1.' || x AS k FROM w UNION SELECT b || '.' || x, y FROM w UNION SELECT b || '.' || x, x FROM w)
    SELECT symbol AS id, count(DISTINCT caller) AS callers FROM m JOIN c ON k = symbol OR k = bare WHERE caller <> symbol GROUP BY symbol""")
def called_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _functions(spark, sf_dir)
    symbol = F.concat_ws(".", "b", "x")
    symbols = words.groupBy(symbol.alias("symbol")).agg(F.array_union(F.array(F.concat(F.lit("Brand1."), F.min("x")), F.min("x")), F.collect_set("y")).alias("calls"))
    found = graph.called_by(symbols.withColumn("id", F.col("symbol")))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("callers"))


@bound(f"""
    WITH w AS ({_WORDS}), f AS (SELECT DISTINCT b, x FROM w)
    SELECT DISTINCT 'sym:' || a.b || '/' || a.x || '.go#' || a.x AS src, 'sym:' || c.b || '/' || c.x || '.go#' || c.x AS dst, 'calls' AS kind
    FROM f a JOIN f c ON (c.b = a.b OR c.b = 'Brand1') AND c.x IN ('red', 'small') WHERE NOT (a.b = c.b AND a.x = c.x)""")
def resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _functions(spark, sf_dir).select("b", "x").distinct()
    file = F.concat(F.col("b"), F.lit("/"), F.col("x"), F.lit(".go"))
    symbols = words.select(file.alias("file"), F.col("x").alias("symbol"), F.lit("function").alias("type"), F.array(*map(F.lit, ["red", "small", "one.red", "one.small", "ext.red"])).alias("calls"))
    refs = [("other", "pkg:Brand2", 0), ("one", "pkg:Brand3", 1), ("one", "pkg:Brand1", 2), ("ext", "pkg:ext:red", 3)]
    imports = words.select(file.alias("file"), F.explode(F.array(*(F.struct(F.lit(a).alias("alias"), F.lit(p).alias("package"), F.lit(o).alias("ord")) for a, p, o in refs))).alias("r"))
    return graph.resolve_calls(symbols, imports.select("file", "r.*"))


@bound("""
    WITH have AS (SELECT DISTINCT l_suppkey, p_brand, p_type FROM lineitem JOIN part ON p_partkey = l_partkey),
    need AS (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size <= 10), k AS (SELECT p_type, count(*) AS needed FROM need GROUP BY p_type)
    SELECT l_suppkey, p_type FROM have JOIN need USING (p_type, p_brand) JOIN k USING (p_type) GROUP BY l_suppkey, p_type, needed HAVING count(*) = needed""")
def implements_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    have = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_type", "p_brand")
    need = part.where("p_size <= 10").select("p_type", "p_brand")
    return graph.division(have, need, "p_brand", ["l_suppkey", "p_type"], ["p_type"])


def _geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as packages, nations as files, customers as symbols, segments as summaries of the rich ones."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    node = lambda df, i, k, n, f, l, x: df.select(i.alias("id"), F.lit(k).alias("kind"), n.alias("name"), f.alias("file"), l.cast("int").alias("line"), x.alias("summary"))
    none, zero = F.lit(""), F.lit(0)
    region = F.concat(F.lit("R"), F.col("n_regionkey"))
    file = F.concat(region, F.lit("/"), F.col("n_name"))
    packages = node(nation.select("n_regionkey").distinct(), F.concat(F.lit("pkg:"), region), "package", region, none, zero, none)
    files = node(nation, F.concat(F.lit("file:"), file), "file", F.col("n_name"), file, zero, none)
    people = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    about = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise("")
    symbols = node(people, F.concat(F.lit("sym:"), F.col("c_custkey")), "type", F.col("c_name"), file, F.col("c_custkey"), about)
    return packages.unionByName(files).unionByName(symbols)


@bound("""
    WITH p AS (SELECT 'R' || n_regionkey AS package, 'R' || n_regionkey || '/' || n_name AS file, c.* FROM customer c JOIN nation ON c_nationkey = n_nationkey),
    n AS (SELECT package, count(*) AS symbols FROM p GROUP BY package),
    r AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY file, c_custkey) AS k FROM p WHERE c_acctbal > 5000),
    a AS (SELECT package, string_agg(c_name || ': ' || c_mktsegment, '; ' ORDER BY k) AS about FROM r WHERE k <= 2 GROUP BY package)
    SELECT package, symbols, coalesce(about, '') AS about, '- ' || package || ' (' || symbols || ' symbols)' || coalesce(' — ' || about, '') AS line
    FROM n LEFT JOIN a USING (package)""")
def package_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.package_lines(_geography(spark, sf_dir))


@bound("""
    WITH c AS (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1),
    x AS (SELECT DISTINCT 'R' || n_regionkey AS package, '' AS file, 'R' || n_regionkey || '/' AS line FROM nation UNION ALL
          SELECT 'R' || n_regionkey, 'R' || n_regionkey || '/' || n_name, '  ' || n_name || CASE WHEN k > 0 THEN ' (' || k || ' symbols)' ELSE '' END
          FROM nation LEFT JOIN c ON c_nationkey = n_nationkey)
    SELECT left('# Files by folder' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY package, file) || chr(10), 32000) AS digest FROM x""")
def structure_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.structure(_geography(spark, sf_dir))


@bound("""
    WITH r AS (SELECT *, row_number() OVER w AS n, sum(strlen(text)) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT conv_id, turn, role, sha256(text) AS digest FROM r WHERE n = 1 OR b + 60 <= 2000""")
def context_block_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = digest.within_budget(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], "text", 2000, 60)
    return kept.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"))


@bound("""
    SELECT 'id' AS ask, 'pkg:R1' AS id, 0 AS line UNION ALL
    SELECT 'name', 'file:R' || n_regionkey || '/' || n_name, 0 FROM nation WHERE n_name = 'NATION_7' UNION ALL
    SELECT 'file', 'file:R' || n_regionkey || '/' || n_name, 0 FROM nation WHERE n_name = 'NATION_7' UNION ALL
    SELECT 'file', 'sym:' || c_custkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7' UNION ALL
    SELECT 'symbols', 'sym:' || c_custkey, c_custkey FROM customer UNION ALL
    SELECT 'files', 'file:R' || n_regionkey || '/' || n_name, 0 FROM nation UNION ALL
    SELECT DISTINCT 'packages', 'pkg:R' || n_regionkey, 0 FROM nation""")
def node_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _geography(spark, sf_dir)
    home = nodes.where("name = 'NATION_7'").select("file").first()[0]
    asked = {"id": lookups.node_by_id(nodes, "pkg:R1"), "name": lookups.nodes_by_name(nodes, "NATION_7"), "file": lookups.nodes_in_file(nodes, home)}
    asked |= {"symbols": lookups.symbol_nodes(nodes), "files": lookups.file_nodes(nodes), "packages": lookups.packages(nodes)}
    parts = [df.select(F.lit(name).alias("ask"), "id", "line") for name, df in asked.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@bound("""
    SELECT 'from' AS side, 'p' || l_partkey AS other FROM lineitem WHERE l_suppkey = 5 GROUP BY ALL UNION ALL
    SELECT 'to', 's' || l_suppkey FROM lineitem WHERE l_partkey = 7 GROUP BY ALL""")
def edge_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _supplies(spark, sf_dir)
    out = lookups.edges_from(edges, "s5").select(F.lit("from").alias("side"), F.col("dst").alias("other"))
    return out.unionByName(lookups.edges_to(edges, "p7").select(F.lit("to").alias("side"), F.col("src").alias("other")))


@bound("""
    SELECT 'chunk' AS ask, CAST(doc_id AS VARCHAR) AS what FROM documents WHERE source = 'src3' UNION ALL
    SELECT DISTINCT 'file', source FROM documents""")
def manifest_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").cast("string").alias("chunk_id"))
    chunks = lookups.chunks_of_file(manifest, "src3").select(F.lit("chunk").alias("ask"), F.col("chunk_id").alias("what"))
    return chunks.unionByName(lookups.manifest_files(manifest).select(F.lit("file").alias("ask"), F.col("file").alias("what")))


@bound("SELECT lang, min(doc_id) AS first FROM documents WHERE lang <> '' GROUP BY lang")
def languages_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.languages_seen(table(spark, sf_dir, "documents"), "lang", "doc_id")


@bound("""SELECT '{"name":"' || c_name || '","path":"/w/' || c_custkey || '","points":' || count(o_orderkey) || '}' AS json FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_name, c_custkey""")
def project_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.concat(F.lit("/w/"), "c_custkey").alias("path"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return lookups.json_rows(status_of(projects, orders.select(F.col("c_name").alias("project"))).drop("indexed"))


@bound("""
    WITH s AS (SELECT doc_id, '// ' || source || ' — ' || doc_id || ' (text)' || chr(10) || text || chr(10) || chr(10) AS section FROM documents),
    r AS (SELECT doc_id, section, row_number() OVER (ORDER BY doc_id) AS n, sum(strlen(section)) OVER (ORDER BY doc_id) AS b FROM s)
    SELECT doc_id, sha256(section) AS digest FROM r WHERE n = 1 OR b <= 200000""")
def readme_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), F.col("doc_id").cast("string").alias("symbol"), F.lit("text").alias("type"), F.col("text").alias("content"))
    return lookups.readme_source(docs, order=("doc_id",)).select("doc_id", F.sha2("section", 256).alias("digest"))


_PROJECTS = "SELECT c_name AS name, '/w/' || c_nationkey || '/' || c_custkey AS path FROM customer"


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.concat(F.lit("/w/"), "c_nationkey", F.lit("/"), "c_custkey").alias("path"))


@bound(f"""
    WITH p AS ({_PROJECTS}), n AS (SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '/moved/' || c_custkey END AS path FROM customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT s_name, '/s/' || s_suppkey FROM supplier)
    SELECT coalesce(p.name, n.name) AS name, coalesce(nullif(n.path, ''), p.path, '') AS path FROM p FULL JOIN n ON p.name = n.name
    WHERE coalesce(p.name, n.name) <> (SELECT max(s_name) FROM supplier)""")
def registry_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0"), table(spark, sf_dir, "supplier")
    path = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("/moved/"), "c_custkey"))
    new = customer.select(F.col("c_name").alias("name"), path.alias("path")).unionByName(supplier.select(F.col("s_name").alias("name"), F.concat(F.lit("/s/"), "s_suppkey").alias("path")))
    last = supplier.agg(F.max("s_name")).first()[0]
    return registry.remove_projects(registry.add_projects(_projects(spark, sf_dir), new), [last, "nobody"])


@bound(f"""
    WITH p AS ({_PROJECTS}), q AS (SELECT o_orderkey AS request, CASE o_orderkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'new' || o_orderkey ELSE '' END AS name,
        CASE WHEN o_orderkey % 5 = 0 THEN '/given/' || o_orderkey ELSE '' END AS path,
        CASE WHEN o_orderkey % 3 = 0 THEN '/home/x' || o_orderkey ELSE '/w/' || c_nationkey || '/' || c_custkey END AS cwd FROM orders JOIN customer ON o_custkey = c_custkey),
    a AS (SELECT request, cwd, nullif(q.name, '') AS name, coalesce(nullif(q.path, ''), p.path, cwd) AS path FROM q LEFT JOIN p ON p.name = q.name)
    SELECT request, coalesce(a.name, (SELECT min(p.name) FROM p WHERE p.path = a.path), split_part(cwd, '/', -1)) AS name, path FROM a""")
def registry_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, F.col("c_name")).when(k % 4 == 1, F.concat(F.lit("new"), k)).otherwise("")
    cwd = F.when(k % 3 == 0, F.concat(F.lit("/home/x"), k)).otherwise(F.concat(F.lit("/w/"), "c_nationkey", F.lit("/"), "c_custkey"))
    requests = asked.select(k.alias("request"), name.alias("name"), F.when(k % 5 == 0, F.concat(F.lit("/given/"), k)).otherwise("").alias("path"), cwd.alias("cwd"))
    return registry.resolve_projects(_projects(spark, sf_dir), requests)


def _program(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The geography with some customers as entry points, regions that import one another, and calls among customers."""
    nodes = _geography(spark, sf_dir)
    entry = F.col("id").startswith("sym:") & (F.col("line") % 400 == 7)
    nodes = nodes.withColumn("kind", F.when(entry, "func").otherwise(F.col("kind"))).withColumn("name", F.when(entry, "Main").otherwise(F.col("name")))
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"))
    region = lambda n: F.concat(F.lit("pkg:R"), n)
    file = F.concat(F.lit("file:R"), "n_regionkey", F.lit("/"), "n_name")
    symbol = lambda n: F.concat(F.lit("sym:"), n)
    edges = edge(nation, region(F.col("n_regionkey")), file, "defines")
    edges = edges.unionByName(edge(nation.where("n_nationkey < 20"), file, region(F.pmod(F.col("n_nationkey") * 3, F.lit(5))), "imports"))
    edges = edges.unionByName(edge(nation.where("n_nationkey % 4 = 1"), file, F.concat(F.lit("pkg:ext:"), "n_name"), "imports"))
    return nodes, edges.unionByName(edge(customer, symbol(F.col("c_custkey")), symbol(F.col("c_custkey") % 37 + 1), "calls"))


@bound("""
    WITH RECURSIVE f AS (SELECT 'file:R' || n_regionkey || '/' || n_name AS file, 'pkg:R' || n_regionkey AS package, n_nationkey AS k FROM nation),
    i AS (SELECT file, package, 'pkg:R' || (k * 3) % 5 AS dst FROM f WHERE k < 20),
    e AS (SELECT file AS src, dst FROM i UNION SELECT package, dst FROM i),
    w(id, depth) AS (SELECT 'pkg:R1', 0 UNION SELECT dst, depth + 1 FROM w JOIN e ON src = id WHERE depth < 3)
    SELECT id, min(depth) AS depth, 'package' AS kind FROM w WHERE id <> 'pkg:R1' GROUP BY id""")
def package_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External packages have no node here, so they are not listed."""
    nodes, edges = _program(spark, sf_dir)
    return graph.dependencies(edges, nodes, graph.resolve_target(nodes, "R1"), 3).select("id", "depth", "kind")


@bound("""
    WITH s AS (SELECT 'sym:' || c_custkey AS id, c_custkey AS k, CASE WHEN c_custkey % 400 = 7 THEN 'Main' ELSE c_name END AS name FROM customer),
    o AS (SELECT id, 'sym:' || (k % 37 + 1) AS other FROM s)
    SELECT s.id, (SELECT 'calls' || ' ' || other FROM o WHERE o.id = s.id) AS out,
           coalesce((SELECT string_agg('calls ' || o.id, ',' ORDER BY o.id) FROM o WHERE o.other = s.id), '') AS into
    FROM s WHERE name = 'Main'""")
def symbol_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _program(spark, sf_dir)
    told = lambda c: F.array_join(F.transform(c, lambda e: F.concat_ws(" ", e["kind"], e["other"])), ",").alias(c)
    return graph.symbol_info(nodes, edges, "Main").select("id", told("out"), told("into"))


@bound("""
    WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem),
    b AS (SELECT src AS id, 0 AS d, dst AS other FROM e UNION ALL SELECT dst, 1, src FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY id, d ORDER BY other) AS n FROM b)
    SELECT id, string_agg(CASE d WHEN 0 THEN 'calls → ' ELSE 'calls ← ' END || other, chr(10) ORDER BY d, other) AS block FROM r WHERE n <= 8 GROUP BY id""")
def adjacency_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _supplies(spark, sf_dir)
    roots = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    sides = graph.adjacency(edges, roots, 8)
    held = lambda d: F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.struct("kind", "other"))))
    listed = sides.groupBy("id").agg(held("out").alias("out"), held("in").alias("into"))
    return listed.select("id", t.edges_block(F.col("out"), F.col("into")).alias("block"))


@bound("""
    WITH c AS (SELECT c.*, CASE WHEN c_custkey % 400 = 7 THEN 'Main' ELSE c_name END AS name, 'R' || n_regionkey AS package, 'R' || n_regionkey || '/' || n_name AS file
               FROM customer c JOIN nation ON c_nationkey = n_nationkey),
    n AS (SELECT package, count(*) AS k FROM c GROUP BY package),
    r AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY file, c_custkey) AS k FROM c WHERE c_acctbal > 5000),
    a AS (SELECT package, string_agg(name || ': ' || c_mktsegment, '; ' ORDER BY k) AS about FROM r WHERE k <= 2 GROUP BY package),
    p AS (SELECT string_agg('- ' || package || ' (' || k || ' symbols)' || coalesce(' — ' || about, ''), chr(10) ORDER BY package) AS t FROM n LEFT JOIN a USING (package)),
    e AS (SELECT string_agg('- ' || file || ':' || c_custkey || ' Main', chr(10) ORDER BY file, c_custkey) AS t FROM c WHERE name = 'Main'),
    f AS (SELECT c_custkey % 37 + 1 AS k, count(*) AS callers FROM customer GROUP BY 1),
    g AS (SELECT name, callers, file, c_custkey, row_number() OVER (ORDER BY callers DESC, name, 'sym:' || c_custkey) AS i FROM f JOIN c ON c_custkey = k),
    h AS (SELECT string_agg(i || '. ' || name || ' (' || callers || ' callers) — ' || file || ':' || c_custkey, chr(10) ORDER BY i) AS t FROM g WHERE i <= 10)
    SELECT left('# The code at a glance' || chr(10) || chr(10) || '## Folders' || chr(10) || p.t || chr(10) || chr(10) || '## Starts at' || chr(10) || e.t || chr(10)
        || chr(10) || '## Called most' || chr(10) || h.t || chr(10), 4000) AS digest FROM p, e, h""")
def summary_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.summary(*_program(spark, sf_dir))


# --- what SQL can't express ---------------------------------------------------


@bound()
def symbols_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python module made from every part, parsed to symbols."""
    from symgraph.operators.parse import extract_symbols

    part = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    source = F.format_string("import os\n\nclass %s:\n    def %s(self):\n        x = os.path(1)\n        return run(x)\n\ndef short(): pass\n", F.initcap(F.col("w")[0]), F.col("w")[1])
    files = part.select(F.concat(F.lit("pkg/m"), "p_partkey", F.lit(".py")).alias("path"), source.alias("content"))
    return extract_symbols(files).select("file", "symbol", "type", "line", F.array_join("calls", ",").alias("calls"))


@bound()
def embed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a symbol: summarised, cut into chunks and embedded by the offline models."""
    from symgraph.operators.enrich import FirstLine, HashedWords, points_of

    docs = table(spark, sf_dir, "documents").select(
        F.lit("corpus").alias("project"), F.lit("main").alias("branch"), F.col("source").alias("file"), F.col("doc_id").cast("string").alias("symbol"),
        F.lit("text").alias("type"), F.col("lang").alias("language"), F.col("text").alias("content"), F.array().cast("array<string>").alias("calls"),
    )
    points = points_of(docs, FirstLine(), HashedWords(64), t.embed_char_budget(8192))
    return points.select("chunk_id", "file_path", "symbol", "chunk_number", "chunk_count", "embedding")


def queries() -> dict[str, Query]:
    return {name: with_package(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
