import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symgraph.functions import paths, text
from symgraph.functions.imports import extract_imports


def values(spark, column, rows, kind="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], kind).select(column).collect()]


def test_query_identifiers(spark):
    asked = ["why does HookSearch fail on an empty query?", "Handle calls helper, and Handle again", ""]
    found = values(spark, text.query_identifiers(F.col("x")), asked)
    assert found == [["why", "does", "HookSearch", "fail", "empty", "query"], ["Handle", "calls", "helper", "and", "again"], []]


def test_calls_drop_keywords_and_repeats(spark):
    source = "func main() { if (x) { a.B(1); c (2); a.B(3); len(x); x.append(1); éa(1) } }"
    assert values(spark, text.extract_calls(F.col("x")), [source]) == [["main", "a.B", "c", "a"]]


def test_normalize_content(spark):
    rows = ["  a  \n\n\n\nb\t\n", "\n\n", "x", "a\n \t\n \nb", "\u00a0a\u00a0"]
    assert values(spark, text.normalize_content(F.col("x")), rows) == ["a\n\nb", "", "x", "a\n\nb", "a"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(body=st.text(alphabet="ab \né", max_size=300), budget=st.integers(1, 120))
def test_chunks_reassemble(spark, body, budget):
    chunks = spark.range(1).select(text.embed_chunks(F.lit("head"), F.lit(body), budget).alias("c")).first()["c"]
    assert "".join(c["content"] for c in chunks) == body
    assert all(c["text"] == "head" + c["content"] for c in chunks)
    assert len(chunks) == 1 or all(len(c["content"]) <= max(budget - 4, budget // 4, 1) for c in chunks)


def test_chunk_counts(spark):
    body = "\n".join(["x" * 19] * 2000)
    size = lambda b: spark.range(1).select(F.size(text.embed_chunks(F.lit(""), F.lit(body), b))).first()[0]
    assert size(0) == 1 and size(100_000) == 1 and size(4000) == 10
    assert text.embed_char_budget(8192) == 19660 == text.embed_char_budget(0)


def test_ids(spark):
    row = spark.range(1).select(*(text.chunk_id(F.lit("main"), F.lit("Foo"), F.lit(n)).alias(str(n)) for n in (0, 1))).first()
    assert row["0"] != row["1"] and len(row["0"]) == 64
    assert values(spark, text.storage_uuid(F.col("x")), ["abc"]) == ["abc00000-0000-0000-0000-000000000000"]
    assert values(spark, text.branch_token(F.col("x")), ["", "a/b"])[0] == "_detached"


def test_names_and_clips(spark):
    assert values(spark, text.bare_name(F.col("x")), ["A.B.c", "d"]) == ["c", "d"]
    assert values(spark, text.receiver_name(F.col("x")), ["A.B.c", "d"]) == ["A.B", ""]
    assert values(spark, text.package_dir(F.col("x")), ["a/b/c.go", "c.go"]) == ["a/b", "."]
    assert values(spark, text.clip_summary(F.col("x")), [" a\nb", "x" * 170]) == ["a", "x" * 160 + "…"]


def test_reply(spark):
    rows = values(spark, text.parse_reply(F.col("x")), ['{"summary":"s","tags":["a"]}', " plain ", "{}"])
    assert [(r["summary"], r["tags"]) for r in rows] == [("s", ["a"]), ("plain", []), ("{}", [])]


@pytest.mark.parametrize(
    ("path", "skipped"),
    [
        ("node_modules/a.js", True), ("x/node_modules/y/a.js", True), ("internal/vendors/registry.go", False),
        ("internal/services/vendorstuff.go", False), ("a/vendor/b.go", True), ("deep/a.pb.go", True), ("a.generated.go", True),
        ("x/a.generated.go", True), ("a_test.go", True), ("a_test.py", False), ("vendor", False), ("pkg/main.go", False),
    ],
)
def test_skip(spark, path, skipped):
    patterns = ["node_modules/**", "vendor/**", "**/*.pb.go", "*.generated.go"]
    assert values(spark, paths.should_skip(F.col("x"), patterns), [path]) == [skipped]


def test_languages_and_folders(spark):
    assert values(spark, paths.detect_language(F.col("x")), ["a.GO", "b.tsx", "c.txt", "noext", ".ts"]) == ["go", "typescript", "", "", "typescript"]
    assert values(spark, paths.stored_language(F.col("x")), ["a.go", "b.tsx", "c.rs"]) == ["go", "ts", ""]
    assert values(spark, paths.under_dir(F.col("x"), ["./vendor/", "/r/abs"], "/r"), ["vendor/a", "myvendor/a", "vendor", "abs/x"]) == [True, False, True, True]
    assert values(spark, paths.infer_module(F.col("x")), ["services/user/service.py"]) == ["services.user.service"]


@pytest.mark.parametrize(
    ("language", "source", "expected"),
    [
        ("go", 'import (\n\t"fmt"\n\tq "a/b/c"\n\t_ "side"\n)', [("fmt", "fmt"), ("q", "a/b/c")]),
        ("python", "import numpy as np\nimport os.path\nfrom a.b import c as d, (e)\nfrom x import *", [("np", "numpy"), ("path", "os.path"), ("d", "a.b.c"), ("e", "a.b.e")]),
        ("typescript", "import * as ns from './ns'\nimport def from \"lib\"\nimport { a, b as c } from './m'", [("ns", "./ns"), ("def", "lib"), ("a", "./m"), ("c", "./m")]),
        ("ruby", "import x", []),
    ],
)
def test_imports(spark, language, source, expected):
    found = values(spark, extract_imports(F.lit(language), F.col("x")), [source])[0]
    assert [tuple(r) for r in found] == expected
