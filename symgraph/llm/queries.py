"""The operators bound to the tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm import langid, toxicity
from symgraph.llm.common import crc_mod, read_table, shared_dir
from symgraph.llm.decontaminate import find_leaks
from symgraph.llm.line_dedup import dedup_lines
from symgraph.llm.packing import pack_documents
from symgraph.llm.shards import ShardStore
from symgraph.llm.simhash import fingerprint_hex, near_duplicates
from symgraph.llm.spotsigs import compare_edits
from symgraph.llm.substring_dedup import remove_repeats
from symgraph.llm.url_filter import PATTERN_RULES, HostRule, judge_urls
from symgraph.session import with_package

HOST_RULES = (
    HostRule("net", "/", "block"),
    HostRule("example.net", "/en/", "allow"),
    HostRule("example.com", "/de/", "block"),
    HostRule("org", "/fr/", "allow"),
)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    lines = F.size(F.split("text", "\n", -1))
    kept = dedup_lines(docs.select("doc_id", "text", lines.cast("long").alias("n_lines")), runs="runs")
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["past"] - r["first"])
    return kept.select(
        "doc_id",
        "n_lines",
        F.coalesce(removed, F.lit(0)).alias("n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = crc_mod(F.col("doc_id"), 4)
    model = langid.train(docs, training=part != 2, calibration=part == 3)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score", "entropy", "accepted")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in eighths, each appended and compacted; what the store then holds."""
    docs = read_table(spark, sf_dir, "documents")
    store = ShardStore(spark, shared_dir(spark, "shards"))
    arrivals = 8
    for n in range(arrivals):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == n))
        store.compact()
        store.expire()
    held = store.read()
    return held.select("doc_id", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(read_table(spark, sf_dir, "pages"), HOST_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(read_table(spark, sf_dir, "documents"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    part = crc_mod(F.col("doc_id"), 5)
    classifier = toxicity.train(docs, read_table(spark, sf_dir, "labels"), training=part != 0)
    return toxicity.score(docs, classifier).select("doc_id", (part == 0).alias("held_out"), "score", "predicted")


def _url_sql() -> str:
    fitting = lambda action: "|".join(f"(?:{r.pattern})" for r in PATTERN_RULES if r.action == action).replace("'", "''")
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(HOST_RULES, key=lambda r: -len(r.name))
    cases = " ".join(f"WHEN {fits.format(h=r.host, p=r.path)} THEN '{r.name}'" for r in longest)
    actions = " ".join(f"WHEN '{r.name}' THEN '{r.action}'" for r in HOST_RULES)
    return f"""
        WITH cut AS (
            SELECT page_id, coalesce(url, '') AS url,
                   CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail
            FROM pages),
        parts AS (
            SELECT page_id, url,
                   translate(regexp_extract(tail, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut),
        ruled AS (SELECT *, CASE {cases} END AS rule FROM parts)
        SELECT page_id, host, path, rule,
               coalesce(CASE rule {actions} END, CASE WHEN regexp_matches(lower(url), '{fitting("allow")}') THEN 'allow'
                        WHEN regexp_matches(lower(url), '{fitting("block")}') THEN 'block' ELSE 'allow' END) AS verdict
        FROM ruled"""


_LINES_SQL = """
    WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
    lines AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line FROM split),
    counted AS (SELECT *, len(regexp_extract_all(line, '[^ \\t\\r]+')) AS w FROM lines),
    summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM counted),
    ahead AS (
        SELECT p.doc_id, p.i AS s, min(q.i) AS e FROM summed p JOIN summed q
        ON q.doc_id = p.doc_id AND q.i >= p.i AND q.c - p.c + p.w >= 20 GROUP BY p.doc_id, p.i),
    behind AS (
        SELECT p.doc_id, max(q.i) AS s, p.i AS e FROM summed p JOIN summed q
        ON q.doc_id = p.doc_id AND q.i <= p.i AND p.c - q.c + q.w >= 20 GROUP BY p.doc_id, p.i),
    stretches AS (SELECT DISTINCT doc_id, s, e FROM (SELECT * FROM ahead UNION ALL SELECT doc_id, s, e FROM behind)),
    texts AS (SELECT doc_id, s, e, array_to_string(a[s + 1:e + 1], chr(10)) AS t FROM stretches JOIN split USING (doc_id)),
    ranked AS (SELECT *, rank() OVER (PARTITION BY t, e - s ORDER BY doc_id, s) AS r FROM texts),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM ranked WHERE r > 1),
    runs AS (SELECT doc_id, count(*) AS n_removed, count(DISTINCT g) AS n_runs FROM (
        SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone) GROUP BY doc_id),
    kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(a) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
           sha256(coalesce(t, '')) AS kept_sha256
    FROM split d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_SHARDS_SQL = "SELECT doc_id, lang, source, length(text) AS n_chars, sha256(text) AS text_sha256 FROM documents"

_LEAKS_SQL = r"""
    WITH texts AS (
        SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
    words AS (
        SELECT side, id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM texts),
    widths AS (SELECT DISTINCT least(len(w), 5) AS n FROM words WHERE side = 'i' AND len(w) > 0),
    shingles AS (
        SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
        FROM words JOIN widths ON len(w) >= n AND (side = 'd' OR n = least(len(w), 5))),
    sizes AS (SELECT id AS item_id, count(*) AS n_item FROM shingles WHERE side = 'i' GROUP BY id),
    shared AS (
        SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM shingles d JOIN shingles i USING (s)
        WHERE d.side = 'd' AND i.side = 'i' GROUP BY ALL)
    SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
    FROM shared JOIN sizes USING (item_id) WHERE n_shared / n_item >= 0.8 - 1e-9"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    bound = (
        op1_line_dedup,
        op2_language_id,
        op3_sharding,
        op4_simhash,
        op5_url_filter,
        op6_spotsigs,
        op7_suffix_array,
        op8_decontamination,
        op9_packing,
        op10_toxicity,
    )
    return {query.__name__: with_package(query) for query in bound}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": _LINES_SQL,
        "op3_sharding": _SHARDS_SQL,
        "op5_url_filter": _url_sql(),
        "op8_decontamination": _LEAKS_SQL,
    }
