"""The property graph: building its edges, walking them, and what branches descend from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from symgraph.functions.imports import extract_imports, local_import_candidates
from symgraph.functions.paths import detect_language
from symgraph.functions.text import bare_name, clip_summary, package_dir, receiver_name
from symgraph.schemas import SYMBOL_KINDS

_EDGE = ("src", "dst", "kind")


# --- identities (their prefixes, and the kinds of nodes and edges, are fixed values) ---------


def package_id(folder: Column) -> Column:
    return F.concat(F.lit("pkg:"), folder)


def external_package_id(path: Column) -> Column:
    return F.concat(F.lit("pkg:ext:"), path)


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_id(path: Column, symbol: Column) -> Column:
    return F.concat(F.lit("sym:"), path, F.lit("#"), symbol)


def is_local_package(identity: Column) -> Column:
    return identity.startswith("pkg:") & ~identity.startswith("pkg:ext:")


def node_kind(kind: Column) -> Column:
    return F.when(kind == "function", "func").when(kind.isin("method", "const"), kind).otherwise("type")


# --- construction -------------------------------------------------------------


def structural_nodes(symbols: DataFrame) -> DataFrame:
    """Package, file and symbol nodes of ``symbols(file, symbol, type, line, summary)``."""
    folder = package_dir(F.col("file"))
    shape = lambda i, k, n, f, l, s: (i.alias("id"), k.alias("kind"), n.alias("name"), f.alias("file"), l.alias("line"), s.alias("summary"))
    empty, zero = F.lit(""), F.lit(0)
    packages = symbols.select(*shape(package_id(folder), F.lit("package"), folder, empty, zero, empty)).distinct()
    files = symbols.select(*shape(file_id(F.col("file")), F.lit("file"), F.substring_index("file", "/", -1), F.col("file"), zero, empty)).distinct()
    own = symbols.select(*shape(symbol_id(F.col("file"), F.col("symbol")), node_kind(F.col("type")), F.col("symbol"), F.col("file"), F.col("line"), clip_summary(F.coalesce("summary", F.lit("")))))
    return packages.unionByName(files).unionByName(own.dropDuplicates(["id"]))


def file_nodes(files: DataFrame) -> DataFrame:
    """Package and file nodes of ``files(file)``, also of those without symbols."""
    folder, nothing = package_dir(F.col("file")), F.lit("")
    tail = (F.lit(0).alias("line"), nothing.alias("summary"))
    packages = files.select(package_id(folder).alias("id"), F.lit("package").alias("kind"), folder.alias("name"), nothing.alias("file"), *tail)
    own = files.select(file_id(F.col("file")).alias("id"), F.lit("file").alias("kind"), F.substring_index("file", "/", -1).alias("name"), "file", *tail)
    return packages.unionByName(own).distinct()


def package_nodes(imports: DataFrame) -> DataFrame:
    """Nodes of the packages that ``imports(package)`` name, local and external."""
    name = F.regexp_replace("package", "^pkg:(?:ext:)?", "")
    return imports.select(F.col("package").alias("id"), F.lit("package").alias("kind"), name.alias("name"), F.lit("").alias("file"), F.lit(0).alias("line"), F.lit("").alias("summary")).distinct()


def file_edges(files: DataFrame) -> DataFrame:
    """``defines`` edges from packages to ``files(file)``."""
    return files.select(package_id(package_dir(F.col("file"))).alias("src"), file_id(F.col("file")).alias("dst"), F.lit("defines").alias("kind")).distinct()


def defines_edges(symbols: DataFrame) -> DataFrame:
    """``defines`` edges from packages to files and from files to ``symbols(file, symbol)``."""
    held = symbols.select(file_id(F.col("file")).alias("src"), symbol_id(F.col("file"), F.col("symbol")).alias("dst"), F.lit("defines").alias("kind"))
    return file_edges(symbols.select("file")).unionByName(held.distinct())


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def embeds_edges(symbols: DataFrame) -> DataFrame:
    """Embedded types of structs: a symbol of the same file, else an external name."""
    bare = lambda x: F.rtrim(_trimmed(F.regexp_replace(x, "(?://|`).*$", "")), F.lit(","))
    lines = F.transform(F.split("content", "\n"), bare)
    fields = F.filter(lines, lambda x: x.rlike(r"^\*?[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?$"))
    held = symbols.where("type = 'struct'").select("file", "symbol", F.explode(F.transform(fields, lambda x: F.ltrim(x, F.lit("*")))).alias("target"))
    known = symbols.select("file", F.col("symbol").alias("target"), F.lit(True).alias("_known")).distinct()
    dst = F.when(F.col("_known"), symbol_id(F.col("file"), F.col("target"))).otherwise(F.concat(F.lit("sym:ext:"), "target"))
    return held.join(known, ["file", "target"], "left").select(symbol_id(F.col("file"), F.col("symbol")).alias("src"), dst.alias("dst"), F.lit("embeds").alias("kind")).distinct()


def interface_methods(content: Column) -> Column:
    lines = F.transform(F.split(content, "\n"), lambda x: _trimmed(F.regexp_replace(x, "//.*$", "")))
    return F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^([A-Za-z_][A-Za-z0-9_]*)\(", 1)), lambda m: m != "")


def division(have: DataFrame, need: DataFrame, on: str, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Pairs (left, right) where the left has every ``on`` value that the right needs."""
    need = need.distinct()
    sizes = need.groupBy(*right).agg(F.count(F.lit(1)).alias("_needed"))
    shared = [c for c in left if c in right]
    met = have.distinct().join(need, [*shared, on]).groupBy(*dict.fromkeys([*left, *right])).agg(F.count(F.lit(1)).alias("_met"))
    return met.join(sizes, list(right)).where("_met = _needed").drop("_met", "_needed")


def implements_edges(symbols: DataFrame) -> DataFrame:
    """Types of a file whose methods there include all of an interface's of that file."""
    need = symbols.where("type = 'interface'").select("file", F.col("symbol").alias("interface"), F.explode(interface_methods(F.col("content"))).alias("method"))
    types = symbols.where("type in ('struct', 'class')").select("file", F.col("symbol").alias("receiver")).distinct()
    have = symbols.where("type = 'method'").select("file", receiver_name(F.col("symbol")).alias("receiver"), bare_name(F.col("symbol")).alias("method"))
    pairs = division(have.join(types, ["file", "receiver"]), need, "method", ["file", "receiver"], ["file", "interface"])
    return pairs.select(symbol_id(F.col("file"), F.col("receiver")).alias("src"), symbol_id(F.col("file"), F.col("interface")).alias("dst"), F.lit("implements").alias("kind"))


def folders_of(files: DataFrame) -> DataFrame:
    """Every folder that holds a file, directly or deeper."""
    parts = F.split(package_dir(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select(F.explode(above).alias("folder")).distinct()


def resolve_imports(files: DataFrame, module: str = "", known: DataFrame | None = None) -> DataFrame:
    """``(file, ord, alias, path, package)`` of every import of ``files(path, content)``, in order.

    The package is the folder named if files of ``known(path)`` (by default ``files``) are in
    it, else its parent if that is a folder, else external.
    """
    language, folder = detect_language(F.col("path")), package_dir(F.col("path"))
    refs = files.select(F.col("path").alias("file"), language.alias("_language"), folder.alias("_folder"), F.posexplode(extract_imports(language, F.col("content"))).alias("ord", "_ref"))
    refs = refs.select("file", "ord", F.col("_ref.alias").alias("alias"), F.col("_ref.path").alias("path"), local_import_candidates(F.col("_language"), F.col("_folder"), F.col("_ref.path"), F.lit(module)).alias("_at"))
    refs = refs.withColumn("_above", F.when(F.col("_at").contains("/"), package_dir(F.col("_at"))))
    there = folders_of(files if known is None else known)
    for at, name in (("_at", "_here"), ("_above", "_parent")):
        refs = refs.join(there.select(F.col("folder").alias(at), F.col("folder").alias(name)), at, "left")
    package = F.coalesce(package_id(F.coalesce("_here", "_parent")), external_package_id(F.col("path")))
    return refs.select("file", "ord", "alias", "path", package.alias("package"))


def import_edges(imports: DataFrame) -> DataFrame:
    return imports.select(file_id(F.col("file")).alias("src"), F.col("package").alias("dst"), F.lit("imports").alias("kind")).distinct()


def call_owners(symbols: DataFrame) -> DataFrame:
    """``(dst, name, package)``: what calls can resolve to among ``symbols(file, symbol, type)``."""
    owners = symbols.where(node_kind(F.col("type")).isin("func", "method"))
    return owners.select(symbol_id(F.col("file"), F.col("symbol")).alias("dst"), F.col("symbol").alias("name"), package_id(package_dir(F.col("file"))).alias("package"))


def node_owners(nodes: DataFrame) -> DataFrame:
    """The same among stored ``nodes(id, name, file)``."""
    return nodes.select(F.col("id").alias("dst"), "name", package_id(package_dir(F.col("file"))).alias("package"))


def resolve_calls(symbols: DataFrame, imports: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """``calls`` edges of ``symbols(file, symbol, type, calls)`` to ``owners`` (by default, among themselves).

    A bare call is of the caller's package; ``alias.name`` of the local package that the
    file's last import under that alias names. The callee is a function or method of exactly
    that name there, other than the caller.
    """
    call = F.col("call")
    calls = symbols.select("file", "symbol", F.explode(F.array_distinct("calls")).alias("call"))
    calls = calls.withColumn("alias", F.when(call.contains("."), F.regexp_extract(call, r"^([^.]*)\.", 1))).withColumn("name", F.when(call.contains("."), F.regexp_extract(call, r"^[^.]*\.(.*)$", 1)).otherwise(call))
    known = imports.groupBy("file", "alias").agg(F.max_by("package", "ord").alias("package"))
    calls = calls.join(known.where(is_local_package(F.col("package"))), ["file", "alias"], "left")
    wanted = F.when(F.col("alias").isNull(), package_id(package_dir(F.col("file")))).otherwise(F.col("package"))
    callers = calls.select(symbol_id(F.col("file"), F.col("symbol")).alias("src"), "name", wanted.alias("package")).where("package is not null")
    owners = call_owners(symbols) if owners is None else owners
    return callers.join(owners, ["name", "package"]).where("src <> dst").select("src", "dst", F.lit("calls").alias("kind")).distinct()


def called_by(symbols: DataFrame, identity: str = "id", name: str = "symbol") -> DataFrame:
    """``(identity, caller_id, caller)``: who calls a symbol by its qualified or bare name, itself excluded."""
    calls = symbols.select(F.col(identity).alias("caller_id"), F.col(name).alias("caller"), F.explode("calls").alias("key"))
    owners = symbols.select(identity, F.explode(F.array_distinct(F.array(F.col(name), bare_name(F.col(name))))).alias("key"))
    return calls.join(owners, "key").where(F.col("caller_id") != F.col(identity)).select(identity, "caller_id", "caller").distinct()


# --- maintenance --------------------------------------------------------------


def replace_file_graph(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes after ``files(file)`` were parsed again or deleted: theirs go, ``new`` come; packages stay."""
    kept = old.join(files.select("file").where("file <> ''").distinct(), "file", "left_anti")
    return kept.join(new.select("id"), "id", "left_anti").unionByName(new)


def replace_edges(old: DataFrame, new: DataFrame, sources: DataFrame, kinds: Sequence[str] = ()) -> DataFrame:
    """Edges after those that leave ``sources(src)`` (of some kinds, or all) are built anew.

    Edges into what is gone stay; joins with nodes hide them.
    """
    gone = sources.select("src").distinct()
    leaving = old.join(gone, "src", "left_semi")
    leaving = leaving.where(F.col("kind").isin(list(kinds))) if kinds else leaving
    return old.join(leaving, list(_EDGE), "left_anti").unionByName(new).dropDuplicates(list(_EDGE))


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti")


# --- queries ------------------------------------------------------------------


def top_fan_in(edges: DataFrame, nodes: DataFrame, n: int, kind: str | None = "calls") -> DataFrame:
    """Nodes with the most edges into them (edges are a set), by count, then name, then id."""
    chosen = edges.where(F.col("kind") == kind) if kind else edges
    counted = chosen.select("src", "dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    ranked = counted.join(nodes, "id").orderBy(F.desc("callers"), "name", "id")
    return ranked.limit(n) if n > 0 else ranked


def walk(edges: DataFrame, roots: DataFrame, depth: int, forward: bool = True, nodes: DataFrame | None = None, min_depth: bool = False) -> DataFrame:
    """``(id, depth)`` of what ``depth`` steps over ``edges(src, dst)`` reach from ``roots(id)``.

    One row for each node and depth it is reached at (``min_depth``: the least), so a root
    in a cycle comes back at a depth above zero; roots themselves, at depth zero, are not
    listed. The depth is known, so the steps are joins of one plan, each level distinct.
    """
    a, b = ("src", "dst") if forward else ("dst", "src")
    step = edges.select(F.col(a).alias("id"), F.col(b).alias("_to")).distinct()
    level, levels = roots.select("id").distinct(), []
    for d in range(1, depth + 1):
        level = level.join(step, "id").select(F.col("_to").alias("id")).distinct()
        levels.append(level.withColumn("depth", F.lit(d)))
    out = levels[0] if levels else roots.select("id", F.lit(0).alias("depth")).limit(0)
    for other in levels[1:]:
        out = out.unionByName(other)
    if min_depth:
        out = out.groupBy("id").agg(F.min("depth").alias("depth"))
    return out.join(nodes, "id") if nodes is not None else out


def callers(edges: DataFrame, nodes: DataFrame, name: str, depth: int = 1) -> DataFrame:
    """Who calls the symbols of a name, up to ``depth`` calls away."""
    roots = nodes.where((F.col("name") == name) & F.col("kind").isin(*SYMBOL_KINDS)).select("id")
    return walk(edges.where("kind = 'calls'"), roots, depth, forward=False, nodes=nodes).orderBy("depth", "name", "id")


def resolve_target(nodes: DataFrame, target: str) -> DataFrame:
    """The node a target names: as a file, else as a package, else as an id; at most one row."""
    rank = F.when(F.col("id") == f"file:{target}", 0).when(F.col("id") == f"pkg:{target}", 1).when(F.col("id") == target, 2)
    return nodes.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank").limit(1).drop("_rank")


def package_edges(edges: DataFrame) -> DataFrame:
    """Import edges of files, also lent to the packages that define the files."""
    imports = edges.where("kind = 'imports'").select("src", "dst")
    members = edges.where("kind = 'defines' and src like 'pkg:%'").select(F.col("src").alias("package"), F.col("dst").alias("src"))
    lent = imports.join(members, "src").select(F.col("package").alias("src"), "dst")
    return imports.unionByName(lent).where(~F.col("src").startswith("pkg:ext:")).distinct()


def dependencies(edges: DataFrame, nodes: DataFrame, root: DataFrame, depth: int = 3) -> DataFrame:
    """Packages that a file or package needs, at their least depth; the root is never listed."""
    reached = walk(package_edges(edges), root, depth, min_depth=True)
    return reached.join(root.select("id"), "id", "left_anti").join(nodes, "id").orderBy("depth", "name", "id")


def adjacency(edges: DataFrame, roots: DataFrame, cap: int = 8) -> DataFrame:
    """``(id, direction, kind, other)`` of the edges at ``roots(id)``, at most ``cap`` each way."""
    shape = lambda d, own, other: edges.select(F.col(own).alias("id"), F.lit(d).alias("direction"), "kind", F.col(other).alias("other"))
    both = shape("out", "src", "dst").unionByName(shape("in", "dst", "src")).join(roots.select("id").distinct(), "id", "left_semi")
    order = Window.partitionBy("id", "direction").orderBy("kind", "other")
    return both.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n") if cap > 0 else both


def symbol_info(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Symbols of a name with all edges at them: ``out`` and ``into``, arrays of struct(kind, other) in order."""
    found = nodes.where((F.col("name") == name) & F.col("kind").isin(*SYMBOL_KINDS))
    sides = adjacency(edges, found.select("id"), 0)
    for direction, column in (("out", "out"), ("in", "into")):
        held = sides.where(F.col("direction") == direction).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("kind", "other"))).alias(column))
        found = found.join(held, "id", "left").withColumn(column, F.coalesce(column, F.array().cast("array<struct<kind:string,other:string>>")))
    return found.orderBy("kind", "file", "id")


def branch_chain(branches: DataFrame, start: str | int, most: int = 16) -> list:
    """A branch and its ancestors, nearest first: up to ``most`` hops, none twice, indexed ones only.

    ``branches(branch, parent)``; every hop is a point lookup.
    """
    chain = [start]
    for _ in range(most):
        row = branches.where(F.col("branch") == chain[-1]).select("parent").first()
        parent = row["parent"] if row else None
        if parent is None or parent in chain or branches.where(F.col("branch") == parent).isEmpty():
            break
        chain.append(parent)
    return chain


def all_branch_chains(branches: DataFrame, most: int = 16) -> DataFrame:
    """``(branch, hop, ancestor)`` for every branch at once: one join for each hop."""
    parents = branches.select(F.col("branch").alias("ancestor"), "parent")
    indexed = branches.select(F.col("branch").alias("parent"))
    level = branches.select("branch", F.lit(0).alias("hop"), F.col("branch").alias("ancestor"), F.array("branch").alias("_path"))
    out = level
    for hop in range(1, most + 1):
        level = level.join(parents, "ancestor").join(indexed, "parent", "left_semi").where(~F.array_contains("_path", F.col("parent")))
        level = level.select("branch", F.lit(hop).alias("hop"), F.col("parent").alias("ancestor"), F.concat("_path", F.array("parent")).alias("_path"))
        out = out.unionByName(level)
    return out.drop("_path")


def parent_branch(candidates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of ``candidates(candidate, base_ts, ahead)``, that of the latest base, then the fewest commits ahead, then by name."""
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("base_ts"), "ahead", "candidate")
    if not by:
        return candidates.orderBy(F.desc("base_ts"), "ahead", "candidate").limit(1)
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def graph_version(meta: DataFrame) -> DataFrame:
    """One row, the graph version in ``meta(key, value)``; zero where it is missing or not a number."""
    stored = F.max(F.when(F.col("key") == "graph_version", F.expr("try_cast(value as bigint)")))
    return meta.agg(F.coalesce(stored, F.lit(0)).alias("graph_version"))


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "src string, dst string, kind string")
