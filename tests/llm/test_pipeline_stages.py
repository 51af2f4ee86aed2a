import os

import pytest
from pyspark.sql import functions as F
from samples import DOCUMENTS, prose
from test_dedup import kept_lines
from test_llm_operators import leaks_by_definition

import corpus_pipeline
from symgraph.llm import toxicity

SF = "/root/testdata/sf0.001"
CLASHING = ["row", "key", "runs", "lines", "left", "found_id", "component", "set_id", "doc_key", "item_id", "_words", "_kept", "_leaked", "_runs", "copies", "score"]


@pytest.fixture(scope="module")
def untidy(spark):
    """Nulls in every column, repeated and missing ids, ties, a very long text, and columns that could clash."""
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, prose(1, 80)), (4, prose(1, 80)), (4, prose(2, 60)), (None, prose(3, 60)), (None, None), (6, "x" * 200_000), (7, prose(8, 3_000))]
    docs = spark.createDataFrame([(i, t, None if i == 3 else "en", None, None if t is None else len(t)) for i, t in rows], DOCUMENTS)
    return docs.select("*", *(F.lit(7).alias(c) for c in CLASHING))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_untidy_tables(spark, untidy, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    found = stage(spark, untidy, SF)
    rows = found.collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 6, 7, None} and sum(r["length"] for r in rows if r["doc_id"] == 2) == 1
    else:
        assert found.columns == untidy.columns and all(r["copies"] == 7 for r in rows)
        # Only copies go: of the rows without words one, of the equal rows one.
        left = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in rows)
        every = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in untidy.collect())
        if name == "SimHash near-dedup":
            assert len(left) == 6 and {i for i, _ in left} == {-1, 1, 4, 6, 7}
        else:
            assert left == every
    assert len(stage(spark, untidy.limit(0), SF).collect()) == 0


def shingles_of(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_by_brute_force(spark, tmp_path):
    """Stage after stage by the definitions, with the classifier's own decisions in the first."""
    items = [(i, prose(900 + i, 25)) for i in range(3)]
    repeated = "\n".join(prose(800 + k, 12) for k in range(3))
    texts = []
    for i in range(120):
        words = prose(i, 90).split()
        if i % 4 == 0:
            words[10:24:2] = ["idiot", "scum", "moron", "loser", "idiot", "scum", "moron"]
        if i % 10 == 3:
            words[40:40] = items[i % 3][1].split()
        lines = [" ".join(words[k : k + 15]) for k in range(0, len(words), 15)]
        if i % 9 in (4, 5):
            lines[2:2] = repeated.split("\n")
        texts.append("\n".join(lines))
    # Near copies on one line each, which line dedup cannot see, an exact copy, and a long text.
    texts += [" ".join(t.replace(" a", " aa", 1).split()) for t in texts[1:12]] + [texts[22], prose(3000, 4000)]
    docs = list(enumerate(texts))
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(table, labels, training=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    left = [(r["doc_id"], r["text"]) for r in table.join(toxicity.score(table, model).where("score < 0.5").select("doc_id"), "doc_id").orderBy("doc_id").collect()]
    assert 80 < len(left) < len(docs)
    cut = kept_lines_of_runs(left)
    sets = {i: shingles_of(t) for i, t in cut.items()}
    leader = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            leader[i] = min(leader[j] for j in sets if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) - 1e-9)
    single = {i: cut[i] for i in sets if leader[i] == i}
    leaked = {d for d, *_ in leaks_by_definition(list(single.items()), items)}
    expected = {i for i in single if i not in leaked}
    assert leaked and len(single) < len(cut)
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in found} == expected
    tokens = {r["doc_id"]: r["doc_tokens"] for r in found}
    assert all(sum(r["length"] for r in found if r["doc_id"] == i) == n for i, n in tokens.items())


def kept_lines_of_runs(docs):
    return kept_lines(docs, 20)
