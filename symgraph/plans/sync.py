"""Index, incremental sync and search over a store."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from symgraph.functions.text import chunk_id, content_hash, embed_char_budget
from symgraph.operators import digest, graph
from symgraph.operators.diff import dirty_symbols, missing, orphan_chunks, stale_rows
from symgraph.operators.enrich import Embedder, Enricher, FirstLine, HashedWords, points_of
from symgraph.operators.parse import extract_symbols
from symgraph.operators.search import collapse, exact, merge, search, top
from symgraph.plans.store import Locked, Store

_CHUNK = ["file", "symbol", "chunk_id"]


@dataclass(frozen=True)
class SyncResult:
    version: int
    files: int
    dirty_symbols: int
    chunks: int
    removed: int
    skipped: bool = False


class _Kept:
    """Frames persisted for one sync, and nothing else of the session."""

    def __init__(self):
        self.frames: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.frames.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.frames[-1]

    def release(self) -> None:
        for df in self.frames:
            df.unpersist()


def sync(
    store: Store,
    project: str,
    branch: str,
    files: DataFrame,
    deleted: DataFrame | None = None,
    enricher: Enricher | None = None,
    embedder: Embedder | None = None,
    max_tokens: int = 8192,
    module: str = "",
    complete: bool = True,
    dry_run: bool = False,
    now: int | None = None,
    wait: float = 4.0,
) -> SyncResult:
    """Bring a branch's tables up to a snapshot; where nothing differs, nothing is published.

    ``files(path, content)`` is the whole tree if ``complete``, so files it lacks are
    deleted; otherwise only the changed ones, and ``deleted(file)`` lists those that went.
    Only dirty symbols are summarised and embedded, and only theirs and removed symbols'
    edges change; imports of the files are always resolved again, against the files given and
    those stored. All tables are published as one version. While another writer holds the
    project's lock for ``wait`` seconds, the sync is skipped.
    """
    try:
        with store.lock(project, wait):
            return _sync(store, project, branch, files, deleted, enricher, embedder, max_tokens, module, complete, dry_run, now, extend=False)
    except Locked:
        return SyncResult(store.version(), 0, 0, 0, 0, skipped=True)


def index(store: Store, project: str, branch: str, files: DataFrame, extend: bool = False, **options) -> SyncResult:
    """Index a whole tree: every symbol anew, or with ``extend`` only those whose first chunk is not stored.

    Points of symbols and files that are gone go; ``called_by`` lists each symbol's callers in the tree.
    """
    with store.lock(project):
        if not extend:
            store.drop_branch(project, branch)
        options = {"deleted": None, "enricher": None, "embedder": None, "max_tokens": 8192, "module": "", "dry_run": False, "now": None} | options
        return _sync(store, project, branch, files, complete=True, extend=extend, **options)


def _sync(store, project, branch, files, deleted, enricher, embedder, max_tokens, module, complete, dry_run, now, extend) -> SyncResult:
    stamp, kept = int(time.time()) if now is None else now, _Kept()
    home = lambda df: df.withColumn("project", F.lit(project)).withColumn("branch", F.lit(branch))
    manifest = store.table("manifest", project, branch)
    try:
        symbols = extract_symbols(files).withColumn("content_hash", content_hash(F.col("content"))).dropDuplicates(["file", "symbol"])
        symbols = kept(home(symbols))
        parsed = files.select(F.col("path").alias("file")).distinct()
        gone = manifest.select("file").distinct().join(parsed, "file", "left_anti") if complete else deleted
        if extend:
            keyed = symbols.withColumn("chunk_id", chunk_id(F.lit(branch), F.col("symbol"), F.lit(0)))
            dirty = kept(missing(keyed, store.table("points", project, branch)).drop("chunk_id"))
        else:
            dirty = kept(dirty_symbols(symbols, manifest))
        stale = kept(stale_rows(manifest, symbols, gone, None if complete else parsed).select(*_CHUNK))
        imports = kept(_imports(store, project, branch, files, gone, module))
        edges = store.table("edges", project, branch).drop("project", "branch")
        held = edges.join(parsed.select(graph.file_id(F.col("file")).alias("src")), "src", "left_semi").where("kind = 'imports'")
        made = graph.import_edges(imports)
        keys = ["src", "dst", "kind"]
        n_imports = made.join(held, keys, "left_anti").count() + held.join(made, keys, "left_anti").count()
        n_files, n_dirty, n_stale = files.count(), dirty.count(), stale.count()
        if dry_run or not (n_dirty or n_stale or n_imports):
            return SyncResult(store.version(), n_files, n_dirty, 0, n_stale)
        callers = graph.called_by(symbols.withColumn("id", graph.symbol_id(F.col("file"), F.col("symbol"))))
        callers = callers.groupBy("id").agg(F.array_sort(F.collect_set("caller")).alias("called_by"))
        told = dirty.withColumn("id", graph.symbol_id(F.col("file"), F.col("symbol"))).join(callers, "id", "left").drop("id")
        told = told.withColumn("called_by", F.coalesce("called_by", F.array().cast("array<string>")))
        points = points_of(told, enricher or FirstLine(), embedder or HashedWords(), embed_char_budget(max_tokens))
        points = kept(points.withColumn("last_modified", F.lit(stamp).cast("bigint")))
        new = points.select("project", "branch", "chunk_id", F.col("file_path").alias("file"), "symbol", "content_hash", F.col("content_hash").alias("embedded_hash"), F.lit(stamp).cast("bigint").alias("updated_at"))
        out = kept(orphan_chunks(manifest, new).select(*_CHUNK).unionByName(stale).distinct())
        left = lambda df: df.join(out, _CHUNK, "left_anti").join(new.select(*_CHUNK), _CHUNK, "left_anti")
        store.replace("manifest", project, branch, left(manifest).unionByName(new))
        old = left(store.table("points", project, branch).withColumnRenamed("file_path", "file")).withColumnRenamed("file", "file_path")
        store.replace("points", project, branch, old.unionByName(points.select(*old.columns)))
        _stage_graph(store, project, branch, files, symbols, dirty, stale, points, gone, imports, home)
        known = int(graph.graph_version(store.table("meta", project, branch)).first()[0])
        store.set_meta(project, branch, last_sync_at=stamp, graph_version=known + 1)
        n_chunks, n_out = points.count(), out.count()
        return SyncResult(store.publish(), n_files, n_dirty, n_chunks, n_out)
    finally:
        store.rollback()
        kept.release()


def _imports(store: Store, project: str, branch: str, files: DataFrame, gone: DataFrame | None, module: str) -> DataFrame:
    """Imports of ``files``, resolved against the folders of these and of the files stored."""
    known = store.table("manifest", project, branch).select(F.col("file").alias("path"))
    known = known.unionByName(store.table("nodes", project, branch).where("file <> ''").select(F.col("file").alias("path"))).distinct()
    known = known if gone is None else known.join(gone.select(F.col("file").alias("path")), "path", "left_anti")
    return graph.resolve_imports(files, module, files.select("path").unionByName(known))


def _stage_graph(store, project, branch, files, symbols, dirty, stale, points, gone, imports, home) -> None:
    """Nodes and edges of dirty symbols anew, those of removed ones away, imports of the files rebuilt; all others stay."""
    nodes, edges = (store.table(n, project, branch).drop("project", "branch") for n in ("nodes", "edges"))
    symbol = graph.symbol_id(F.col("file"), F.col("symbol"))
    parsed = files.select(F.col("path").alias("file")).distinct()
    told = points.where("chunk_number = 0").select(F.col("file_path").alias("file"), "symbol", "summary")
    described = dirty.join(told, ["file", "symbol"], "left").withColumn("summary", F.coalesce("summary", F.lit("")))
    fresh = graph.structural_nodes(described).unionByName(graph.file_nodes(parsed)).unionByName(graph.package_nodes(imports)).dropDuplicates(["id"])
    removed = stale.select(symbol.alias("id")).join(symbols.select(symbol.alias("id")), "id", "left_anti")
    if gone is not None:
        removed = removed.unionByName(nodes.join(gone.select("file").where("file <> ''"), "file", "left_semi").select("id"))
    left = nodes.join(removed, "id", "left_anti").join(fresh.select("id"), "id", "left_anti")
    store.replace("nodes", project, branch, home(left.unionByName(fresh)))
    # Callees are found among the symbols given and the functions stored of other files.
    owners = graph.call_owners(symbols)
    stored = nodes.where(F.col("kind").isin("func", "method")).join(removed, "id", "left_anti").join(parsed, "file", "left_anti")
    owners = owners.unionByName(graph.node_owners(stored))
    again = dirty.select("file", "symbol")
    of_dirty = lambda df: df.join(again.select(symbol.alias("src")), "src", "left_semi")
    built = graph.file_edges(parsed).unionByName(graph.defines_edges(dirty)).unionByName(graph.import_edges(imports))
    for made in (graph.embeds_edges(symbols), graph.implements_edges(symbols)):
        built = built.unionByName(of_dirty(made))
    built = built.unionByName(graph.resolve_calls(dirty, imports, owners))
    edges = graph.replace_edges(edges, graph.empty_edges(store.spark), parsed.select(graph.file_id(F.col("file")).alias("src")), ["imports"])
    sources = removed.select(F.col("id").alias("src")).unionByName(again.select(symbol.alias("src")))
    store.replace("edges", project, branch, home(graph.replace_edges(edges, built, sources)))


def clean_branches(store: Store, project: str, branches: Sequence[str]) -> int:
    """Remove branches that are gone from every table, as one version."""
    for branch in branches:
        store.drop_branch(project, branch)
    return store.publish()


def replay(store: Store, project: str, branch: str, files: DataFrame, commits: DataFrame, touched: DataFrame, since, **options) -> SyncResult:
    """Sync the ``files`` that commits since a moment touched; they are what is left of them now."""
    from symgraph.sources.changes import replay_commits

    chosen = replay_commits(commits, touched, since).select("path")
    return sync(store, project, branch, files.join(chosen, "path", "left_semi"), complete=False, **options)


def cached_digest(store: Store, project: str, branch: str, kind: str = "summary") -> str:
    """The ``summary`` or ``structure`` digest of a branch's graph, built once for each graph version."""
    current = str(graph.graph_version(store.table("meta", project, branch)).first()[0])
    if store.meta(project, branch, f"{kind}_digest_version") == current:
        text = store.meta(project, branch, f"{kind}_digest")
        if text is not None:
            return text
    nodes, edges = store.table("nodes", project, branch), store.table("edges", project, branch)
    text = (digest.summary(nodes, edges) if kind == "summary" else digest.structure(nodes)).first()["digest"]
    store.set_meta(project, branch, **{f"{kind}_digest": text, f"{kind}_digest_version": current})
    store.publish()
    return text


def semantic_search(store: Store, project: str, query: str, embedder: Embedder, chain: Sequence[str], k: int = 5, threshold: float = 0.4, **filters: object) -> DataFrame:
    """The ``k`` best symbols for a query over a branch chain; the nearest branch's version of each."""
    vector = embedder.embed([query])[0]
    hits = search(store.table("points", project), vector, 0, threshold, filters, chain)
    return top(collapse(hits, chain, ties=["chunk_number"]), k, ["file_path", "symbol"])


def hybrid_search(store: Store, project: str, query: str, embedder: Embedder, chain: Sequence[str], k: int = 5, threshold: float = 0.72) -> DataFrame:
    """Exact symbol hits first, then semantic ones to fill up; an empty query finds nothing."""
    nodes = store.table("nodes", project, chain[0])
    rank = lambda *by: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by))  # noqa: E731  over at most k rows
    found = exact(nodes, query if query.strip() else "", k)
    first = found.select("file", F.col("name").alias("symbol"), "score", rank("position", "kind", "file", "id").alias("position"))
    if not query.strip():
        return first.limit(0).withColumn("source", F.lit(0))
    hits = semantic_search(store, project, query, embedder, chain, k, threshold)
    then = hits.select(F.col("file_path").alias("file"), "symbol", "score", rank(F.desc("score"), "file_path", "symbol").alias("position"))
    return merge(first, then, k)


