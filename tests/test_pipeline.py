import json

import pytest
from pyspark.sql import functions as F

from symgraph.operators import graph
from symgraph.operators.enrich import Fallback, HashedWords, RateLimited
from symgraph.operators.parse import extract_symbols
from symgraph.plans.store import Locked, Store
from symgraph.plans.sync import cached_digest, clean_branches, hybrid_search, index, semantic_search, sync
from symgraph.sources.files import module_name, read_files
from symgraph.streaming.sync import read_arrivals, start_sync

GO = '''package api

import (
	"fmt"
	w "example.com/proj/internal/widget"
)

const (
	One = 1
	Two = 2
	Three = 3
)

type Doer interface {
	Do(x int) error
	// comment(
}

type Base struct {
	n int
	s string
}

type Server struct {
	Base
	q.Client
	name string
}

func (s *Server) Do(x int) error {
	fmt.Println("}", x)
	return w.Run(x)
}

func helper(a interface{ X() }) (b struct{ y int }) {
	s.Do(1)
	return
}
'''
PY = "class A:\n    def m(self):\n        return run(1)\n\n    async def n(self):\n        pass\n        return 2\n\ndef run(x):\n    y = A().m()\n    return y\n"
TS = "export class Box {\n  get(x: number): string {\n    if (x) {\n      return call(x)\n    }\n  }\n}\ninterface Shape {\n  a: string\n}\nconst go = async (y: T) => {\n  go(1)\n  return 1\n}\nfunction top(a) {\n  return '}'\n  // }\n}\n"
RUST = "pub struct P {\n  x: u8,\n}\nenum E {\n  A,\n  B,\n}\ntrait T {\n  fn f(&self);\n}\nimpl P {\n  pub fn new<'a>(x: &'a u8) -> P {\n    P { x: *x }\n  }\n}\n"
JAVA = "public class K {\n  private int v;\n  public int get(int a) throws X {\n    if (a > 0) {\n      return v;\n    }\n    return 0;\n  }\n}\ninterface I {\n  void x();\n}\n"


def symbols_of(spark, path, source):
    files = spark.createDataFrame([(path, source)], "path string, content string")
    return {(r["symbol"], r["type"]): r for r in extract_symbols(files).collect()}


def test_go_symbols(spark):
    found = symbols_of(spark, "internal/api/s.go", GO)
    assert set(found) == {("One", "const"), ("Doer", "interface"), ("Base", "struct"), ("Server", "struct"), ("Server.Do", "method"), ("helper", "function")}
    assert found["One", "const"]["line"] == 8 and found["Server.Do", "method"]["calls"] == ["Do", "fmt.Println", "w.Run"]


@pytest.mark.parametrize(
    ("path", "source", "expected"),
    [
        ("a.py", PY, {("A", "class"), ("A.n", "method"), ("run", "function")}),
        ("a.ts", TS, {("Box", "class"), ("Box.get", "method"), ("Shape", "interface"), ("go", "function"), ("top", "function")}),
        ("a.js", TS.replace("x: number", "x").replace("): string", ")").replace("y: T", "y"), {("Box", "class"), ("Box.get", "method"), ("go", "function"), ("top", "function")}),
        ("a.rs", RUST, {("P", "struct"), ("E", "enum"), ("T", "trait"), ("new", "function")}),
        ("a.java", JAVA, {("K", "class"), ("K.get", "method"), ("I", "interface")}),
        ("a.rb", "def x\n1\n2\nend", set()),
        ("broken.py", "def (:\n\n\n", set()),
    ],
)
def test_other_symbols(spark, path, source, expected):
    assert set(symbols_of(spark, path, source)) == expected


def test_structural_edges(spark):
    files = spark.createDataFrame([("internal/api/s.go", GO), ("internal/widget/w.go", "package widget\n\nfunc Run(x int) error {\n\treturn nil\n}\n")], "path string, content string")
    symbols = extract_symbols(files)
    edges = lambda df: {(r["src"], r["dst"]) for r in df.collect()}
    at = "sym:internal/api/s.go#"
    assert edges(graph.embeds_edges(symbols)) == {(at + "Server", at + "Base"), (at + "Server", "sym:ext:q.Client")}
    assert edges(graph.implements_edges(symbols)) == {(at + "Server", at + "Doer")}
    imports = graph.resolve_imports(files, "example.com/proj")
    assert edges(graph.import_edges(imports)) == {("file:internal/api/s.go", "pkg:ext:fmt"), ("file:internal/api/s.go", "pkg:internal/widget")}
    assert (at + "Server.Do", "sym:internal/widget/w.go#Run") in edges(graph.resolve_calls(symbols, imports))


def test_import_folders(spark):
    files = spark.createDataFrame([("src/app.ts", "import { h } from './utils/helpers'\nimport r from 'react'\n"), ("src/utils/helpers.ts", "")], "path string, content string")
    assert {r["path"]: r["package"] for r in graph.resolve_imports(files).collect()} == {"./utils/helpers": "pkg:src/utils", "react": "pkg:ext:react"}


def test_read_files(spark, tmp_path):
    for path, body in {"go.mod": "// x\nmodule example.com/proj\n", "a.go": GO, "vendor/v.go": GO, ".hid/h.go": GO, "t_test.go": GO, "d/b.py": PY}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    found = read_files(spark, str(tmp_path), ["vendor/**"])
    assert sorted(r["path"] for r in found.collect()) == ["a.go", "d/b.py"]
    assert module_name(spark.createDataFrame([("// x\nmodule example.com/proj\n",)], "content string")).first()[0] == "example.com/proj"


def test_sync_is_incremental(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    tree = {"a.py": PY, "b.py": "def keep(x):\n    y = x\n    return run(y)\n", "c.py": "def gone(x):\n    y = x\n    return y\n"}
    files = lambda t: spark.createDataFrame(sorted(t.items()), "path string, content string")
    first = sync(store, "p", "main", files(tree), now=1)
    assert (first.version, first.removed) == (1, 0) and first.dirty_symbols == first.chunks == 5
    assert sync(store, "p", "main", files(tree), now=2).version == 1
    changed = {"a.py": PY, "b.py": tree["b.py"].replace("y = x", "y = 2")}
    assert sync(store, "p", "main", files(changed), dry_run=True).version == 1
    second = sync(store, "p", "main", files(changed), now=3)
    assert (second.version, second.dirty_symbols, second.removed) == (2, 1, 1)
    names = {r["symbol"] for r in store.table("manifest", "p", "main").collect()}
    assert names == {"A", "A.n", "run", "keep"}
    assert {r["symbol"]: r["updated_at"] for r in store.table("manifest", "p", "main").collect()} == {"A": 1, "A.n": 1, "run": 1, "keep": 3}
    rebuilt = Store(spark, str(tmp_path / "full"))
    sync(rebuilt, "p", "main", files(changed), now=3)
    nodes, edges = ([s.table(n, "p", "main") for s in (store, rebuilt)] for n in ("nodes", "edges"))
    assert sorted(map(tuple, nodes[0].collect())) == sorted(map(tuple, nodes[1].collect()))
    live = [sorted(map(tuple, e.join(n.select(F.col("id").alias("dst")), "dst", "left_semi").select(e.columns).collect())) for e, n in zip(edges, nodes, strict=True)]
    assert live[0] == live[1]
    assert {r["dst"] for r in graph.dangling_edges(edges[0], nodes[0]).collect()} == {"file:c.py"}
    assert store.table("manifest", "p", "main", version=1).count() == 5
    called = {r["symbol"]: r["called_by"] for r in rebuilt.table("points", "p", "main").collect()}
    assert "keep" in called["run"]
    sync(store, "p", "other", files(tree), now=4)
    store.drop_branch("p", "main")
    store.publish()
    assert store.table("points", "p", "main").count() == 0 and store.count("p") == 5


TREE = {
    "app/a.py": "import os\nimport lib.util as u\n\ndef foo(x):\n    y = u.help(x)\n    return bar(y)\n\ndef bar(x):\n    y = x\n    return y\n",
    "lib/util.py": "def help(x):\n    y = x\n    return y\n",
}


def edges_of(store, kind):
    return {(r["src"], r["dst"]) for r in store.table("edges", "p", "main").where(F.col("kind") == kind).collect()}


def as_files(spark, tree):
    return spark.createDataFrame(sorted(tree.items()), "path string, content string")


def test_sync_of_changed_files_resolves_against_the_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    sync(store, "p", "main", as_files(spark, TREE), now=1)
    call, local = ("sym:app/a.py#foo", "sym:lib/util.py#help"), ("file:app/a.py", "pkg:lib")
    assert call in edges_of(store, "calls") and edges_of(store, "imports") == {local, ("file:app/a.py", "pkg:ext:os")}
    marker = spark.createDataFrame([("p", "main", "sym:app/a.py#bar", "sym:ext:marker", "calls")], store.table("edges").schema)
    store.upsert("edges", "p", "main", marker)
    store.publish()
    users = spark.range(3).persist()
    changed = sync(store, "p", "main", as_files(spark, {"app/a.py": TREE["app/a.py"].replace("bar(y)", "bar(y + 1)")}), complete=False, now=2)
    assert (changed.dirty_symbols, changed.removed) == (1, 0)
    # The callee's file was not given; the clean symbol's marker stays.
    assert call in edges_of(store, "calls") and ("sym:app/a.py#bar", "sym:ext:marker") in edges_of(store, "calls")
    assert local in edges_of(store, "imports") and users.storageLevel.useMemory
    folders = store._folders(store.version())
    only = sync(store, "p", "main", as_files(spark, {"app/a.py": TREE["app/a.py"].replace("bar(y)", "bar(y + 1)").replace("import os", "import sys")}), complete=False, now=3)
    assert (only.dirty_symbols, only.chunks, only.version) == (0, 0, changed.version + 1)
    assert edges_of(store, "imports") == {local, ("file:app/a.py", "pkg:ext:sys")}
    sync(store, "q", "main", as_files(spark, TREE), now=4)
    assert {k: v for k, v in store._folders(store.version()).items() if k[1][0] == "p" and k[0] == "points"}.keys() == {k for k in folders if k[0] == "points"}
    before = {k: v for k, v in store._folders(store.version()).items() if k[1][0] == "p"}
    sync(store, "q", "main", as_files(spark, {"lib/util.py": TREE["lib/util.py"].replace("y = x", "y = 2")}), complete=False, now=5)
    assert {k: v for k, v in store._folders(store.version()).items() if k[1][0] == "p"} == before
    sync(store, "p", "main", spark.createDataFrame([], "path string, content string"), spark.createDataFrame([("lib/util.py",)], "file string"), complete=False, now=6)
    assert {r["id"] for r in store.table("nodes", "p", "main").where("file = 'lib/util.py'").collect()} == set()
    assert store.expire() > 0 and len(store.versions()) == 1 and store.exists("q", "main") and not store.exists("q", "other")
    users.unpersist()


def test_index_extend_and_branches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = index(store, "p", "main", as_files(spark, TREE), now=1)
    assert first.chunks == 3 == first.dirty_symbols and store.count("p") == 3
    called = {r["symbol"]: r["called_by"] for r in store.table("points", "p").collect()}
    assert called == {"foo": [], "bar": ["foo"], "help": []}
    more = TREE | {"lib/new.py": "def fresh(x):\n    y = x\n    return y\n", "lib/util.py": TREE["lib/util.py"].replace("y = x", "y = 3")}
    # Stored symbols are passed over, whatever their content is now.
    assert index(store, "p", "main", as_files(spark, more), extend=True, now=2).dirty_symbols == 1
    assert index(store, "p", "main", as_files(spark, more), now=3).dirty_symbols == 4
    index(store, "p", "old", as_files(spark, TREE), now=4)
    clean_branches(store, "p", ["old", "never"])
    assert store.homes() == [("p", "main")]
    with store.lock("p"):
        assert sync(store, "p", "main", as_files(spark, more), wait=0.2).skipped
        with pytest.raises(Locked), store.lock("p", 0.1):
            pass
    with store.lock("p"):
        pass


def test_digests_are_built_once_for_a_graph_version(spark, tmp_path, monkeypatch):
    from symgraph.operators import digest

    store, built = Store(spark, str(tmp_path / "store")), []
    real = digest.summary
    monkeypatch.setattr(digest, "summary", lambda *a: built.append(1) or real(*a))
    sync(store, "p", "main", as_files(spark, TREE), now=1)
    text = cached_digest(store, "p", "main")
    assert "bar" in text and cached_digest(store, "p", "main") == text and built == [1]
    sync(store, "p", "main", as_files(spark, TREE | {"lib/z.py": "def more(x):\n    y = x\n    return y\n"}), now=2)
    assert cached_digest(store, "p", "main") != text and built == [1, 1]
    assert "a.py (2 symbols)" in cached_digest(store, "p", "main", "structure")


def test_searches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    sync(store, "p", "main", spark.createDataFrame([("a.py", PY), ("b.py", "def parse_json(text):\n    data = text\n    return data\n")], "path string, content string"), now=1)
    hits = semantic_search(store, "p", "parse json text data", HashedWords(), ["main"], 1, 0.1).collect()
    assert [h["symbol"] for h in hits] == ["parse_json"]
    both = hybrid_search(store, "p", "where does run parse json text data", HashedWords(), ["main"], 3, 0.1).collect()
    assert both[0]["symbol"] == "run" and both[0]["score"] == 1.0 and len({b["symbol"] for b in both}) == len(both)
    assert hybrid_search(store, "p", "  ", HashedWords(), ["main"]).count() == 0


def test_store_publishes_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.set_meta("p", "b", graph_version="not a number")
    store.rollback()
    assert store.publish() == 0
    store.set_meta("p", "b", graph_version="not a number")
    assert store.publish() == 1 and graph.graph_version(store.table("meta")).first()[0] == 0
    other = Store(spark, str(tmp_path / "s"))
    store.set_meta("p", "b", graph_version=7)
    assert store.publish() == 2 and graph.graph_version(other.table("meta")).first()[0] == 7


def test_streamed_sync(spark, tmp_path):
    arrivals, root = tmp_path / "in", str(tmp_path / "store")
    arrivals.mkdir()
    put = lambda n, *rows: (arrivals / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
    put(1, {"path": "a.py", "content": PY, "deleted": False, "arrived": 1}, {"path": "b.py", "content": PY.replace("A", "B"), "deleted": False, "arrived": 1})
    run = lambda: start_sync(read_arrivals(spark, str(arrivals)), root, "p", "main", str(tmp_path / "ck")).awaitTermination()
    run()
    put(2, {"path": "b.py", "content": None, "deleted": True, "arrived": 2})
    run()
    assert {r["file"] for r in Store(spark, root).table("manifest", "p", "main").collect()} == {"a.py"}


def test_fallback():
    class Says:
        def __init__(self, reply):
            self.text = reply

        def reply(self, *_):
            if isinstance(self.text, Exception):
                raise self.text
            return self.text

    assert Fallback(Says(RateLimited()), Says("ok")).reply("s", "l", "c") == "ok"
    with pytest.raises(RateLimited):
        Fallback(Says(RateLimited()), Says(RateLimited())).reply("s", "l", "c")
    with pytest.raises(RuntimeError):
        Fallback(Says(ValueError())).reply("s", "l", "c")
    assert HashedWords(8).embed(["", "fooBar foo"])[0] == [0.0] * 8


def test_called_by(spark):
    rows = [("1", "A.Close", ["helper", "Close"]), ("2", "B.Close", []), ("3", "helper", ["A.Close"])]
    symbols = spark.createDataFrame(rows, "id string, symbol string, calls array<string>")
    assert sorted((r["id"], r["caller"]) for r in graph.called_by(symbols).collect()) == [("1", "helper"), ("2", "A.Close"), ("3", "A.Close")]
    assert symbols.where(F.lit(True)).count() == 3
