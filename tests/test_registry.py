import subprocess

import pytest
from pyspark.sql import functions as F

from symgraph.functions import text
from symgraph.operators import lookups
from symgraph.operators.enrich import summarise
from symgraph.plans.registry import Registry, Settings, load_settings, set_nested
from symgraph.sources import changes
from symgraph.sources.files import source_files


def test_registry(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "projects"))
    assert registry.projects().count() == 0 and registry.read_readme("a") == ""
    registry.add("a", "/w/a")
    registry.add("a", "")
    registry.add("b", "/w/b")
    registry.remove("nobody")
    assert sorted(map(tuple, registry.projects().collect())) == [("a", "/w/a"), ("b", "/w/b")]
    assert registry.resolve("a", cwd="/x") == ("a", "/w/a")
    assert registry.resolve("a", "/other", "/x") == ("a", "/other")
    assert registry.resolve(cwd="/w/b") == ("b", "/w/b") and registry.resolve(cwd="/w/new") == ("new", "/w/new")
    registry.remove("b")
    assert {r["name"] for r in registry.projects().collect()} == {"a", "new"}
    registry.write_readme("a", "x" * 9000)
    assert len(registry.read_readme("a")) == 8000


def test_settings():
    assert load_settings("") == Settings() and load_settings('{"results": 9, "skip": ["a/**"], "x": 1}') == Settings(results=9, skip=("a/**",), extra={"x": 1})
    assert set_nested({"a": 1, "c": {"d": 2}}, "a.b", 3) == {"a": {"b": 3}, "c": {"d": 2}}
    assert set_nested({"c": {"d": 2}}, "c.e", 4) == {"c": {"d": 2, "e": 4}} and set_nested({}, "x", 1) == {"x": 1}


def test_repository_facts(spark, tmp_path):
    assert not changes.is_repository(str(tmp_path)) and changes.current_branch(str(tmp_path)) == "" == changes.head_commit(str(tmp_path))
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    body = "def f(x):\n    y = x\n    return y\n"
    (tmp_path / "a.py").write_text(body)
    (tmp_path / "untracked.py").write_text(body)
    git("add", "a.py")
    git("commit", "-qm", "one")
    git("branch", "dev")
    (tmp_path / "a.py").write_text(body + "\n")
    git("commit", "-qam", "two")
    assert changes.is_repository(str(tmp_path)) and changes.current_branch(str(tmp_path)) == "main" and len(changes.head_commit(str(tmp_path))) == 40
    row = changes.branch_candidates(spark, str(tmp_path), "main").first()
    assert (row["candidate"], row["ahead"]) == ("dev", 0) and row["base_ts"] > 0
    files = lambda **k: sorted(r["path"] for r in source_files(spark, str(tmp_path), **k).collect())
    assert files() == ["a.py"] and files(paths=["untracked.py", "gone.py"]) == ["untracked.py"]
    commits, touched = (spark.createDataFrame(rows, kind) for rows, kind in (([("c1", 10), ("c2", 20)], "commit string, ts long"), ([("c1", "a.py"), ("c2", "a.py")], "commit string, path string")))
    last = changes.last_commit_times(spark.createDataFrame([("a.py",), ("b.py",)], "path string"), commits, touched, 99)
    assert {r["path"]: r["last_modified"] for r in last.collect()} == {"a.py": 20, "b.py": 99}


def test_texts_for_people_and_models(spark):
    one = lambda column: spark.range(1).select(column).first()[0]
    said = one(text.result_text(F.lit(1), F.lit(0.5), F.lit("S"), F.lit("func"), F.lit("a.go"), F.lit("dev"), F.lit(1), F.lit(3), F.lit("why"), F.lit("x\ny\nz"), 2))
    assert said.split("\n") == ["1. S (func) in a.go, score 0.50", "   on branch dev", "   best of its parts: 2 of 3", "   why", "    x", "    y", "    (more lines)"]
    assert one(text.definition_note(F.lit("Does it."), F.lit("a.go"), F.lit(7))) == "Does it. @ a.go:7" and one(text.definition_note(F.lit(""), F.lit("a.go"), F.lit(7))) == "a.go:7"
    assert one(text.instructed_query(F.lit("q"), "")) == "q" and one(text.instructed_query(F.lit("q"), "find")).endswith("q")
    assert one(text.sync_line(F.lit(1), F.lit(2), F.lit(3))) == "1 files changed, 2 chunks embedded, 3 removed"
    asked = [one(text.summary_prompt(F.lit("S"), F.lit("func"), F.lit("go"), F.lit("code"), F.lit(about))) for about in ("", "an overview")]
    assert "an overview" in asked[1] and "overview" not in asked[0] and all(a.endswith("func S in go:\ncode") for a in asked)
    assert one(text.readme_prompt(F.lit("p"), F.array(F.lit("go"), F.lit("ts")), F.lit("src"))).endswith("Languages: go, ts. Its source, as evidence only:\nsrc")
    assert one(text.parse_reply(F.lit('{"summary": "s", "businessContext": "b"}')))["business_context"] == "b"


def test_failed_replies_are_told(spark):
    class Fails:
        def reply(self, symbol, language, code):
            if symbol == "bad":
                raise ValueError("no")
            return "fine"

    rows = summarise(spark.createDataFrame([("ok", "go", "x"), ("bad", "go", "y")], "symbol string, language string, content string"), Fails()).orderBy("symbol").collect()
    assert [(r["summary"], r["error"]) for r in rows] == [("", "ValueError: no"), ("fine", None)]


def test_readme_source_and_json(spark):
    symbols = spark.createDataFrame([(i, f"f{i}", "s", "func", "c" * 30, ["go", "", "ts", "go"][i]) for i in range(4)], "ord int, file string, symbol string, type string, content string, language string")
    size = len("// f0 — s (func)\n".encode()) + 32
    assert [lookups.readme_source(symbols, n).count() for n in (1, size, 2 * size, 99 * size)] == [1, 1, 2, 4]
    assert [r["language"] for r in lookups.languages_seen(symbols).collect()] == ["go", "ts"]
    assert lookups.json_rows(symbols.select("ord", "file").limit(1)).first()[0] == '{"ord":0,"file":"f0"}'


@pytest.mark.parametrize("path", ["a/b.py"])
def test_walk_and_read(spark, tmp_path, path):
    (tmp_path / path).parent.mkdir()
    (tmp_path / path).write_text("x")
    assert [r["path"] for r in source_files(spark, str(tmp_path)).collect()] == [path]
