import pytest
from pyspark.sql import functions as F

from symgraph.operators import diff, digest, graph, search
from symgraph.sources import changes

CHAIN = [("main", "A"), ("A", "B"), ("B", "C")]


@pytest.fixture(scope="module")
def chain_edges(spark):
    return spark.createDataFrame([(a, b, "calls") for a, b in CHAIN], "src string, dst string, kind string")


@pytest.fixture(scope="module")
def chain_nodes(spark):
    rows = [(n, "func", n, f"{n}.go", 1, "") for n in ("main", "A", "B", "C")]
    return spark.createDataFrame(rows, "id string, kind string, name string, file string, line int, summary string")


def ids(df, *columns):
    return sorted(tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect())


def test_walk(spark, chain_edges, chain_nodes):
    assert ids(graph.callers(chain_edges, chain_nodes, "C", 1), "name") == ["B"]
    assert ids(graph.callers(chain_edges, chain_nodes, "C", 3), "name", "depth") == [("A", 2), ("B", 1), ("main", 3)]
    assert ids(graph.callers(chain_edges, chain_nodes, "C", 0), "name") == [] == ids(graph.callers(chain_edges, chain_nodes, "C", -1), "name")
    assert len(graph.top_fan_in(chain_edges, chain_nodes, 10).collect()) == 3
    cut = graph.replace_edges(chain_edges, graph.empty_edges(spark), spark.createDataFrame([("A",)], "src string"))
    assert ids(graph.callers(cut, chain_nodes, "C", 3), "name") == ["B"]


def test_walk_of_cycles_and_diamonds(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("b", "c"), ("c", "gone")], "src string, dst string")
    root = spark.createDataFrame([("a",)], "id string")
    assert ids(graph.walk(edges, root, 2), "id", "depth") == [("a", 2), ("b", 1), ("c", 1), ("c", 2), ("gone", 2)]
    assert ids(graph.walk(edges, root, 2, min_depth=True), "id", "depth") == [("a", 2), ("b", 1), ("c", 1), ("gone", 2)]
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert "gone" not in ids(graph.walk(edges, root, 3, nodes=nodes), "id")


def test_package_dependencies(spark):
    edges = spark.createDataFrame(
        [("pkg:a", "file:a/x.go", "defines"), ("file:a/x.go", "pkg:b", "imports"), ("pkg:b", "file:b/y.go", "defines"), ("file:b/y.go", "pkg:a", "imports"), ("file:b/y.go", "pkg:ext:fmt", "imports")],
        "src string, dst string, kind string",
    )
    nodes = spark.createDataFrame([(i, "package", i[4:], "", 0, "") for i in ("pkg:a", "pkg:b", "pkg:ext:fmt")] + [("file:a/x.go", "file", "x.go", "a/x.go", 0, "")], "id string, kind string, name string, file string, line int, summary string")
    root = graph.resolve_target(nodes, "a")
    assert ids(root, "id") == ["pkg:a"] and ids(graph.resolve_target(nodes, "a/x.go"), "id") == ["file:a/x.go"] and ids(graph.resolve_target(nodes, "zz"), "id") == []
    assert ids(graph.dependencies(edges, nodes, root), "id", "depth") == [("pkg:b", 1), ("pkg:ext:fmt", 2)]


def test_collapse(spark):
    hits = spark.createDataFrame([("main", "a.go", "Foo", 0.95), ("feature", "a.go", "Foo", 0.8), ("feature", "b.go", "Bar", 0.9)], "branch string, file_path string, symbol string, score double")
    near = search.top(search.collapse(hits, ["feature", "main"]), 0, ["symbol"]).collect()
    assert [(r["symbol"], r["branch"]) for r in near] == [("Bar", "feature"), ("Foo", "feature")]
    assert ids(search.collapse(hits, []), "symbol", "score") == [("Bar", 0.9), ("Foo", 0.95)]
    assert search.over_fetch(5, 2) == 40 and search.over_fetch(0, 2) == 0 and search.over_fetch(5, 0) == 20


def test_search_filters_and_zero_vectors(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 0.0], "x"), (3, [0.6, 0.8], "x"), (4, [1.0, 0.1], "y")], "id long, embedding array<float>, type string")
    found = search.search(points, [2.0, 0.0], 5, 0.5, {"type": "x"}, ties=["id"]).collect()
    assert [(r["id"], round(r["score"], 4)) for r in found] == [(1, 1.0), (3, 0.6)]
    assert search.search(points, [0.0, 0.0], 5).count() == 0


def test_exact(spark, chain_nodes):
    assert [r["name"] for r in search.exact(chain_nodes.withColumn("name", F.concat("name", F.lit("xx"))), "does Bxx call Axx and Bxx").collect()] == ["Bxx", "Axx"]
    assert search.exact(chain_nodes, "nothing here").count() == 0 == search.exact(chain_nodes, "").count()


def test_manifest_diff(spark):
    manifest = spark.createDataFrame(
        [("unchanged", "a.go", "Unchanged", "h1"), ("source", "a.go", "Edited", "old"), ("removed", "a.go", "Removed", "gone"), ("deleted", "b.go", "InDeleted", "x"), ("null", "a.go", "Null", None)],
        "chunk_id string, file string, symbol string, embedded_hash string",
    )
    symbols = spark.createDataFrame([("a.go", "Unchanged", "h1"), ("a.go", "Edited", "h2"), ("a.go", "New", "h3"), ("a.go", "Null", "h4")], "file string, symbol string, content_hash string")
    assert ids(diff.dirty_symbols(symbols, manifest), "symbol") == ["Edited", "New", "Null"]
    deleted = spark.createDataFrame([("b.go",)], "file string")
    assert ids(diff.stale_rows(manifest, symbols, deleted, symbols.select("file")), "chunk_id") == ["deleted", "removed"]
    assert diff.delete_where(manifest).count() == 5 and diff.delete_where(manifest, file="a.go", symbol="New").count() == 5
    assert ids(diff.removed_files(manifest, symbols), "file") == ["b.go"]


def test_status_lines(spark):
    lines = spark.createDataFrame([(x,) for x in [" M a.go", "?? b.go", " D c.go", "R  old.go -> new.go", '?? "q r.go"', "x"]], "line string")
    assert ids(changes.parse_porcelain(lines), "path", "op") == [("a.go", "changed"), ("b.go", "changed"), ("c.go", "deleted"), ("new.go", "changed"), ("old.go", "deleted"), ("q r.go", "changed")]
    ranged = spark.createDataFrame([(x,) for x in ["M\ta", "D\tb", "R100\told\tnew", "A\tc", ""]], "line string")
    assert ids(changes.parse_name_status(ranged), "path", "op") == [("a", "changed"), ("b", "deleted"), ("c", "changed"), ("new", "changed"), ("old", "deleted")]
    gone = spark.createDataFrame([("* main 1 [origin/main] x",), ("  old 2 [origin/old: gone] y",)], "line string")
    assert ids(changes.gone_branches(gone), "branch") == ["old"]
    both = diff.change_set(changes.parse_name_status(ranged), spark.createDataFrame([("a", "deleted")], "path string, op string"))
    assert ("a", "deleted") in ids(both, "path", "op") and both.count() == 5


def test_parent_branch_and_chain(spark):
    candidates = spark.createDataFrame([("main", 100, 3), ("dev", 100, 0), ("old", 50, 0)], "candidate string, base_ts long, ahead int")
    assert graph.parent_branch(candidates).first()["candidate"] == "dev"
    branches = spark.createDataFrame([("f", "dev"), ("dev", "main"), ("main", None), ("x", "y"), ("y", "x")], "branch string, parent string")
    assert graph.branch_chain(branches, "f") == ["f", "dev", "main"] and graph.branch_chain(branches, "x") == ["x", "y"]
    assert ids(graph.all_branch_chains(branches, 3).where("branch = 'x'"), "hop", "ancestor") == [(0, "x"), (1, "y")]


def test_digests(spark):
    nodes = spark.createDataFrame(
        [
            ("pkg:internal/api", "package", "internal/api", "", 0, ""), ("pkg:cmd", "package", "cmd", "", 0, ""), ("pkg:ext:fmt", "package", "fmt", "", 0, ""),
            ("file:internal/api/handler.go", "file", "handler.go", "internal/api/handler.go", 0, ""), ("file:cmd/main.go", "file", "main.go", "cmd/main.go", 0, ""),
            ("sym:internal/api/handler.go#Handle", "func", "Handle", "internal/api/handler.go", 10, "Handles inbound requests."),
            ("sym:internal/api/handler.go#helper", "func", "helper", "internal/api/handler.go", 20, "Shared helper logic."),
            ("sym:cmd/main.go#main", "func", "main", "cmd/main.go", 5, ""),
        ],
        "id string, kind string, name string, file string, line int, summary string",
    )
    edges = spark.createDataFrame([("sym:internal/api/handler.go#Handle", "sym:internal/api/handler.go#helper", "calls"), ("sym:cmd/main.go#main", "sym:internal/api/handler.go#Handle", "calls")], "src string, dst string, kind string")
    text = digest.summary(nodes, edges).first()["digest"]
    assert "helper (1 callers)" in text and "fmt" not in text and "- cmd/main.go:5 main" in text
    assert "- internal/api (2 symbols) — Handle: Handles inbound requests.; helper: Shared helper logic." in text
    tree = digest.structure(nodes).first()["digest"]
    assert "  handler.go (2 symbols)" in tree and "  main.go (1 symbols)" in tree
    assert digest.session_digest(nodes, edges).first()["digest"].count("# ") >= 2
    assert "nothing yet" in digest.structure(nodes.limit(0)).first()["digest"]


def test_context_block(spark):
    rows = [(i, 0.5, f"S{i}", "func", "a.go", "", "p" * 100, "c") for i in range(5)]
    results = spark.createDataFrame(rows, "position int, score double, symbol string, type string, file string, layer string, purpose string, code string")
    block = digest.context_block(results, "p", 'q "x"', 110).first()["block"]
    assert block.startswith('<context project="p" query="q \\"x\\"">') and block.endswith("</context>") and block.count("## ") == 2
    assert digest.context_block(results, "p", "q", 1).first()["block"].count("## ") == 1
    assert digest.context_block(results.limit(0), "p", "q").first()["block"].count("## ") == 0
