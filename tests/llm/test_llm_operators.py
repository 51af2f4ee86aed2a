import hashlib
import json
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from samples import frame, prose

from symgraph.llm import langid, toxicity
from symgraph.llm.decontaminate import decontaminate, find_leaks
from symgraph.llm.packing import pack_documents, padding, sequence_cost
from symgraph.llm.shards import ConcurrentCommit, ShardStore
from symgraph.llm.spotsigs import COMMON_WORDS, compare_edits, near_pairs
from symgraph.llm.url_filter import HostRule, PatternRule, build_index, judge_urls, parse_rules

PAGES = "page_id long, url string"


# --- URL filters --------------------------------------------------------------

RULES = (HostRule("net", "/", "block"), HostRule("example.net", "/en/", "allow"), HostRule("example.com", "/de/", "block"))


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://A.Example.NET/en/1?x#y", ("a.example.net", "/en/1", "example.net/en/", "allow")),
        ("http://b.net/fr", ("b.net", "/fr", "net/", "block")),
        ("http://b.net", ("b.net", "", None, "allow")),
        ("http://notexample.com/de/1", ("notexample.com", "/de/1", None, "allow")),
        ("http://example.com/de/", ("example.com", "/de/", "example.com/de/", "block")),
        ("http://casino.org/a", ("casino.org", "/a", None, "block")),
        ("http://casinos-online.org", ("casinos-online.org", "", None, "block")),
        ("http://betsy.org/x", ("betsy.org", "/x", None, "allow")),
        ("http://10.0.0.1/x", ("10.0.0.1", "/x", None, "block")),
        ("http://x.org?u=http://b.net/", ("x.org", "", None, "allow")),
        ("//b.net/x", ("", "", None, "allow")),
        ("", ("", "", None, "allow")),
        (None, ("", "", None, "allow")),
    ],
)
def test_urls(spark, url, expected):
    row = judge_urls(spark.createDataFrame([(1, url)], PAGES), RULES).first()
    assert (row["host"], row["path"], row["rule"], row["verdict"]) == expected


def test_url_rules_are_found_by_their_rarest_token(spark):
    rules = [PatternRule("^common^rare^"), PatternRule("y")]
    assert build_index(rules, {"common": 9, "rare": 1}) == {"rare": [0], "": [1]}
    pages = spark.createDataFrame([(1, "http://x.org/zebra", "h"), (1, "http://x.org/zebra", "h")], PAGES + ", host string")
    found = judge_urls(pages, (), [PatternRule("/ze.ra/")]).collect()
    assert [(r["page_id"], r["verdict"], r["pattern_rule"]) for r in found] == [(1, "block", "/ze.ra/")] * 2
    assert judge_urls(pages.limit(0), RULES).count() == 0 and judge_urls(pages, (), ()).count() == 2
    assert judge_urls(pages, RULES, keep=("host", "page_id")).columns == ["host", "page_id", "host", "path", "rule", "verdict", "pattern_rule"]


@pytest.mark.parametrize(
    ("line", "tokens", "fits", "not_"),
    [
        ("||ads.", ("ads",), ["http://ads.x.org/", "https://a.ads.b/"], ["http://x.org/ads.", "http://myads.x/"]),
        ("||x.org/a^", ("x", "org", "a"), ["http://x.org/a", "http://b.x.org/a?c"], ["http://x.org/ab", "http://xx.org/a"]),
        ("/ad*s^", (), ["http://x/ads", "http://x/add/s"], ["http://x/s"]),
        ("|http:*/track^*|", ("http", "track"), ["http://x/track/1"], ["https://x/track/1"]),
        ("^a.b^c^", ("a", "b", "c"), ["http://x/a.b/c", "a.b?c"], ["http://x/a.bc", "http://x/aab/c"]),
        (".gif|", ("gif",), ["http://x/y.gif"], ["http://x/y.gif?z"]),
        ("|data|", ("data",), ["DATA"], ["data1"]),
        ("@@^fine^", ("fine",), ["http://fine/"], ["http://finer/"]),
    ],
)
def test_rule_syntax(line, tokens, fits, not_):
    rule = PatternRule(line)
    assert rule.tokens == tokens
    held = lambda url: [t for t in rule.tokens if t not in regex.findall("[a-z0-9]+", url.lower())]
    assert all(regex.search(rule.pattern, u.lower()) and not held(u) for u in fits) and not any(regex.search(rule.pattern, u.lower()) for u in not_)


def test_any_number_of_rules_in_blocks(spark):
    urls = [f"http://h{i}.example/p{i % 7}/q{i}" for i in range(300)] + ["http://H7.Example/p0", None, "x"]
    pages = spark.createDataFrame(list(enumerate(urls)), PAGES)
    rules = parse_rules("\n".join(["! none", *(f"||h{i}.example/p{i % 5}^" for i in range(21_000)), "@@^q14^", "^q14^"]))
    hosts = [HostRule(f"h{i}.example", "/p1/", "allow") for i in range(0, 300, 2)] + [HostRule("example", "/p1/", "block")]
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge_urls(pages, hosts, rules, block_rules=4000).collect()}

    def expected(i):
        at, path = (7, 0) if i == 300 else (i, i % 7)
        if path == 1 and i < 300:
            return (f"h{i}.example/p1/", "allow") if i % 2 == 0 else ("example/p1/", "block")
        # The rule of host h<i> blocks /p<i % 5>; one with q14 is excepted.
        return None, "block" if i <= 300 and path == at % 5 and i != 14 else "allow"

    assert found == {i: expected(i) for i in range(len(urls))}
    assert found[14][1] == "allow" and found[0][1] == "block"
    assert sum(v == "block" for _, v in found.values()) > 30


# --- packing ------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    return path, tokenizers.Tokenizer.from_file(path)


def test_packing_round_trip(spark, tokenizer, odd):
    path, known = tokenizer
    odd_texts = ["a  b", " lead", "tail ", "x \n y", "x\n\n  y", "a   b\t c", "  x", "don't  I'll 12 3,4 ...", "<|endoftext|> x", "\0 a", "日本語 テキスト é", "\n", " ", "  "]
    texts = [None, "", *odd_texts, *(prose(i, 10 + 37 * i % 700) for i in range(40)), prose(99, 9000)]
    found = pack_documents(frame(spark, texts).repartition(2), path, block_tokens=9000, with_ids=True).toPandas()
    ids = {i: [*known.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    for doc, own in found.sort_values("start").groupby("doc_id"):
        assert [x for piece in own["ids"] for x in piece] == ids[doc]
        assert (own["doc_tokens"] == len(ids[doc])).all() and own["start"].tolist() == [0, *own["length"].cumsum()[:-1]]
        assert own["ids_crc32"].tolist() == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in own["ids"]]
    assert set(found["doc_id"]) == set(ids)
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]] and own["length"].sum() <= 2048
    assert padding(found.groupby("sequence_id")["length"].sum()).sum() == 0
    assert pack_documents(odd, path).select("doc_id").distinct().count() == 7 and pack_documents(odd.limit(0), path).count() == 0


def test_packing_balances_cost(spark, tokenizer):
    pieces = pack_documents(frame(spark, [prose(i, 20 + i) for i in range(400)]).coalesce(1), tokenizer[0])
    cost = sequence_cost(pieces).where("tokens = 2048").toPandas()["cost"]
    assert len(cost) > 5 and cost.max() < 1.3 * cost.min()


# --- language identification --------------------------------------------------


@pytest.fixture(scope="module")
def two_languages(spark):
    rows = [(i, prose(i, 30 + i % 50, "abcdefg" if i % 2 else "efghijkl"), "xx" if i % 2 else "yy") for i in range(240)]
    return spark.createDataFrame([*rows, (999, None, "xx"), (998, "abc", None)], "doc_id long, text string, lang string")


def test_language_model(spark, two_languages, odd):
    part = F.col("doc_id") % 3
    model = langid.train(two_languages, part != 2, part == 0)
    assert model.languages == ["xx", "yy"] and len(model.shares) == 1
    for keys, values in model.part(0).grams:
        assert (np.diff(keys) > 0).all() and np.isfinite(values).all()
    found = langid.identify(two_languages, model)
    held = two_languages.where("doc_id % 3 = 2").join(found, "doc_id")
    assert held.where("lang <> lang_pred").count() == 0 and held.where("not accepted or score not between 0 and 1").count() == 0
    marks = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd.where("doc_id < 4"), model).collect()}
    assert marks == {1: ("und", 0.0), 2: ("und", 0.0), 3: ("und", 0.0)}
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"} and langid.identify(odd.limit(0), model).count() == 0
    # Other scripts and noise are told apart from the languages known, long and short, and one very long text is whole.
    foreign = ["\u4eca\u65e5\u306f\u826f\u3044\u5929\u6c17\u3067\u3059", "\u043f\u0440\u0438\u0432\u0435\u0442 \u043a\u0430\u043a \u0434\u0435\u043b\u0430", prose(5, 60, "qrstuvwxyz"), prose(6, 200, "abcdefghijklmnopqrstuvwxyz"), "zzzz"]
    own = [prose(1001, 4, "abcdefg"), prose(1002, 40, "efghijkl"), prose(1003, 60_000, "abcdefg")]
    rows = langid.identify(frame(spark, [*foreign, *own]), model).orderBy("doc_id").collect()
    assert [r["accepted"] for r in rows] == [False] * len(foreign) + [True] * len(own)
    assert [r["lang_pred"] for r in rows[len(foreign) :]] == ["xx", "yy", "xx"] and all(r["score"] < 0.5 for r in rows[: len(foreign)])
    # Ties (here of two equal models) go to the first name.
    copies = two_languages.unionByName(two_languages.where("lang = 'xx'").withColumn("lang", F.lit("aa")))
    assert {r["lang_pred"] for r in langid.identify(frame(spark, own[:1]), langid.train(copies, part != 2, part == 0)).collect()} == {"aa"}


def test_calibration_counts_every_document(spark):
    rows = [(i, prose(i, 2 + i % 5, ("abcdefg", "efghijkl", "cdefghi")[i % 3]), ("xx", "yy", "zz")[i % 3]) for i in range(3900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    apart = F.col("doc_id") % 20 != 0  # 3,705 documents, of which the calibrating model counts none
    model = langid.train(docs, F.lit(True), apart)
    counts = langid.count_ngrams(docs.select("text", "lang", F.lit(True).alias("fit"), "doc_id").where(~apart))
    partial = langid.build_model(langid.kneser_ney(counts.select(F.lit("fit").alias("model"), "lang", "gram", "n")))
    scored = langid._summed(langid._unsummed(docs.where(apart)), partial).collect()
    assert len(scored) == 3705
    n = np.array([r["n"] for r in scored], float)
    entropy, truth = -np.array([r["sums"] for r in scored]) / n[:, None], np.array([r["doc_id"] % 3 for r in scored])
    right = entropy.argmin(axis=1) == truth
    usual = np.array([np.average(entropy[right & (truth == k), k], weights=n[right & (truth == k)]) for k in range(3)])
    assert np.allclose(model.usual, usual, rtol=1e-7) and 0.5 < right.mean() < 1
    x, y, reach = [], [], 0
    for h, size, k in zip(entropy, n, truth, strict=True):
        for known in (range(3), [j for j in range(3) if j != k]):  # then as if its own language had no model
            order = sorted(known, key=lambda j: h[j])
            over = max(h[order[0]] - usual[order[0]], 0)
            x.append([1, np.sqrt((h[order[1]] - h[order[0]]) * size), np.log1p(size), over * np.sqrt(size), over])
            y.append(float(order[0] == k))
            reach = max(reach, over * np.sqrt(size) * y[-1])
    x, w = np.array(x), np.array(model.weights)
    # Where the penalised likelihood has its maximum, its slope is zero.
    assert np.allclose(x.T @ (1 / (1 + np.exp(-x @ w)) - y) + w, 0, atol=1e-2) and model.limit == pytest.approx(1.5 * reach + 1)


def kneser_ney_by_hand(texts, alphabet):
    """Probability of a character after up to three others, by the definition."""
    padded = ["    " + t + " " for t in texts]
    counts = {4: defaultdict(int)}
    for t in padded:
        for i in range(4, len(t)):
            counts[4][t[i - 3 : i + 1]] += 1
    for k in (3, 2, 1):
        counts[k] = defaultdict(int)
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1

    def discount(k):
        once, twice = (sum(v == x for v in counts[k].values()) for x in (1, 2))
        return min(max(once / (once + 2 * twice), 0.1), 0.95) if once + twice else 0.5

    def p(gram):
        k = len(gram)
        if k == 1:
            total = sum(counts[1].values())
            return max(counts[1][gram] - discount(1), 0) / total + discount(1) * len(counts[1]) / total / alphabet if gram in counts[1] else 1e-3 / alphabet
        after = [v for g, v in counts[k].items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        weight = discount(k) * len(after) / sum(after)
        return max(counts[k].get(gram, 0) - discount(k), 0) / sum(after) + weight * p(gram[1:])

    return p


@pytest.mark.parametrize("part_entries", [langid.PART_ENTRIES, 400, 60])
def test_entropies_by_brute_force(spark, part_entries):
    texts = {"aa": [prose(i, 12, "abc") for i in range(4)], "bb": [prose(50 + i, 12, "bcde") for i in range(4)]}
    rows = [(10 * k + i, t, lang) for k, (lang, own) in enumerate(texts.items()) for i, t in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = langid.count_ngrams(docs.withColumn("fit", F.lit(True))).select(F.lit("all").alias("model"), "lang", "gram", "n")
    model = langid.build_model(langid.kneser_ney(counts), part_entries)
    assert len(model.shares) == 1 if part_entries > 1000 else len(model.shares) > 2
    asked = ["abc bca", "edc xx b", "a"]
    found = langid._summed(langid._unsummed(frame(spark, asked)), model).orderBy("doc_id").collect()
    alphabet = len({c for own in texts.values() for t in own for c in t}) + 1
    for lang in (0, 1):
        p = kneser_ney_by_hand(texts[["aa", "bb"][lang]], alphabet)
        for r, text in zip(found, asked, strict=True):
            padded = "    " + text + " "
            expected = sum(np.log(p(padded[i - 3 : i + 1])) for i in range(4, len(padded)))
            assert r["sums"][lang] == pytest.approx(expected, rel=1e-4) and r["n"] == len(text) + 1


# --- toxicity -----------------------------------------------------------------


@pytest.fixture(scope="module")
def abuse(spark):
    rows = []
    for i in range(300):
        words = prose(i, 40).split()
        if i % 5 == 0:
            words[3:9:2] = ["zornig", "blaffen" + "abc"[i % 3], "idiot"]
        elif i % 7 == 0:
            words[5] = "idiot"
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(0, 1, 1), (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity(spark, abuse, odd):
    docs, labels = abuse
    model = toxicity.train(docs, labels, F.col("doc_id") % 3 != 0)
    scored = toxicity.score(docs, model).where("doc_id % 3 = 0").collect()
    assert all((r["predicted"] == 1) == (r["doc_id"] % 5 == 0) == (r["score"] >= 0.5) for r in scored)
    empty = {r["score"] for r in toxicity.score(frame(spark, [None, "", "... 12"]), model).collect()}
    assert len(empty) == 1 and 0 <= empty.pop() < 0.5
    assert toxicity.score(odd, model).count() == odd.count() == toxicity.drop_toxic(odd, model).count()
    assert toxicity.drop_toxic(odd, model).schema == odd.schema and toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_without_labels(spark, abuse):
    docs, labels = abuse
    model = toxicity.train(docs, labels.limit(0), F.col("doc_id") % 3 != 0)
    rude, plain = (r["score"] for r in toxicity.score(frame(spark, ["you idiot scum trash", "a fine day"]), model).orderBy("doc_id").collect())
    assert rude > 0.5 > plain


def test_label_model_discounts_copies():
    chosen = np.random.RandomState(0)
    truth = chosen.rand(4000) < 0.3
    flip = lambda p: np.where(chosen.rand(4000) < p, ~truth, truth) * 2 - 1
    noisy = flip(0.35)
    votes = np.stack([flip(0.1), flip(0.12), flip(0.15), noisy, noisy, noisy, noisy], axis=1)
    model, posterior = toxicity.fit_label_model(votes)
    assert ((posterior >= 0.5) == truth).mean() > 0.93 and abs(model.share - 0.3) < 0.06
    # Every copy but one depends on another copy, which then explains it whatever the class.
    assert sum(o >= 3 for o in model.other[3:]) == 3
    for i in (4, 5, 6):
        table = model.tables[i] if model.other[i] >= 3 else model.tables[3]
        assert (table[:, [0, 2], [0, 2]] > 0.99).all()
    accuracy = [np.where(votes[:, i] > 0, posterior, 1 - posterior).mean() for i in range(3)]
    assert np.allclose(accuracy, [0.9, 0.88, 0.85], atol=0.05)
    labelled = toxicity.fit_label_model(votes, np.where(chosen.rand(4000) < 0.05, ~truth, truth).astype(int))[1]
    assert ((labelled >= 0.5) == truth).mean() > 0.95


def test_label_model_posteriors_by_brute_force():
    chosen = np.random.RandomState(1)
    votes = chosen.randint(-1, 2, (60, 4))
    votes[:, 2] = np.where(chosen.rand(60) < 0.8, votes[:, 1], votes[:, 2])
    model, _ = toxicity.fit_label_model(votes)

    def chance(row, y):  # the joint probability of a class and its votes, factor by factor
        p = model.share if y else 1 - model.share
        for i, o in enumerate(model.other):
            p *= model.tables[i][y, row[o] + 1 if o >= 0 else 0, row[i] + 1]
        return p

    expected = [chance(r, 1) / (chance(r, 0) + chance(r, 1)) for r in votes]
    assert np.allclose(1 / (1 + np.exp(-model.log_odds(votes + 1))), expected)
    every = np.array(np.meshgrid(*[[-1, 0, 1]] * 4)).reshape(4, -1).T
    assert sum(chance(r, y) for r in every for y in (0, 1)) == pytest.approx(1)


def test_voters_of_other_origin():
    plain = toxicity.Lexicon({"zornig": (0, 0.98), "4|blaf": (1, 0.85)}, frozenset(["gemecker"]))
    cast = lambda text: dict(zip(toxicity.VOTERS, toxicity.votes_of(toxicity.signs_of(text, plain)), strict=True))
    assert set(cast("").values()) == {0, -1} and cast("")["nothing"] == -1
    rude = cast("you stupid f**k sooooo zornig zornig zornig Blaffen gemecker")
    assert {v for v in rude if rude[v] > 0} >= {"seeds: insult", "company>=1", "words, 0.9>=1", "words, 0.97>=3", "beginnings, 0.8>=1", "addressed", "masked", "stretched"}
    assert rude["beginnings, 0.9>=1"] == -1 and rude["shouted"] == 0
    assert cast("WHAT IS ALL THIS!!! NOISE!!! NOW!!!")["shouted"] == 1 == cast("a b c d e!!!")["marks"]


def test_shouting_is_looked_for_in_whole_texts():
    plain = toxicity.Lexicon()
    loud = [toxicity.signs_of(t, plain) for t in ("so WHAT IS ALL THIS NOISE", "\u00abWHAT IS THIS NOISE NOW", "I AM NOT GOING THERE", "quiet " * 500 + "LOUD " * 400)]
    assert [s.shouted for s in loud] == [5, 5, 4, 400]
    assert all(toxicity.votes_of(s)[toxicity.VOTERS.index("shouted")] == 1 for s in loud)
    assert toxicity.signs_of("WHat a Fine Day it is, I say", plain).shouted == 0


# --- decontamination ----------------------------------------------------------


def leaks_by_definition(docs, items, threshold=0.8):
    words_of = lambda text: [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    runs = lambda words, n: {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
    found = set()
    for i, item in items:
        own = words_of(item)
        wanted = runs(own, min(5, len(own))) if own else set()
        for d, text in docs:
            shared = wanted & runs(words_of(text), min(5, len(own)))
            if wanted and len(shared) >= threshold * len(wanted) - 1e-9:
                found.add((d, i, len(wanted), len(shared)))
    return found


def test_leaks_are_exact(spark):
    items = [(i, prose(1000 + i, 4 + 3 * i)) for i in range(25)] + [(90, ""), (91, None), (92, "Two words!")]
    docs = []
    for d in range(60):
        words = prose(d, 400).split()
        item = (items[d % 25][1] or "").split()
        for k in range(d % 6):
            item[(7 * k) % len(item)] = "edited"
        words[50:50] = item if d % 3 else [w.upper() + "," for w in item]
        docs.append((d, " ".join(words)))
    docs += [(70, None), (71, ""), (72, "two WORDS"), (73, prose(3, 20) + " two words " + prose(4, 20)), (74, "words two")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    found = {tuple(r)[:4] for r in find_leaks(frame(spark, docs), table).collect()}
    assert found == leaks_by_definition(docs, items) and len(found) > 20
    kept = decontaminate(frame(spark, docs), table)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {f[0] for f in found}


def test_leak_edges(spark, odd):
    items = spark.createDataFrame([(1, prose(1, 80)), (1, None), (None, prose(2, 60))], "item_id long, text string")
    held = {(r["doc_id"], r["item_id"], r["containment"]) for r in find_leaks(odd, items).collect()}
    assert held == {(4, 1, 1.0), (5, 1, 1.0), (None, None, 1.0)}
    left = decontaminate(odd, items)
    assert left.columns == odd.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 6]
    assert find_leaks(odd.limit(0), items).count() == 0 == find_leaks(odd, items.limit(0)).count()
    mixed = frame(spark, [(7, prose(1, 80)), (7, prose(8, 30)), (None, prose(9, 30)), (None, prose(1, 80))])
    assert sorted(r["text"] for r in decontaminate(mixed, items).collect()) == sorted([prose(8, 30), prose(9, 30)])


# --- SpotSigs -----------------------------------------------------------------


def spots(text):
    words, found, marked = [], [], True
    for w in (x for x in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if x):
        if w in COMMON_WORDS:
            marked = True
        else:
            words.append(w)
            found.append(marked)
            marked = False

    def hashed(chain):
        h = 42
        for w in chain:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h - (1 << 64) if h >> 63 else h

    return {hashed(words[i : i + 3]) for i, m in enumerate(found) if m} or {hashed([text])}


def spotted(i):
    return " ".join(w if k % 4 else ["the", "une", "der", "los"][k // 4 % 4] for k, w in enumerate(prose(i, 30 + i).split()))


def test_edits_are_likened(spark):
    texts = ["", None, "the the THE of", "the " * 3000, *(spotted(i) for i in range(30)), "Ünïcode: the çà va—bien"]
    found = compare_edits(frame(spark, list(reversed(list(enumerate(texts))))).repartition(3)).orderBy("doc_id").collect()
    plain = [t or "" for t in texts]
    for i, r in enumerate(found):
        text, other = plain[i], plain[(i + 1) % len(plain)]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        own, changed, following = spots(text), spots(edited), spots(other)
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(len(own & changed) / len(own | changed)) and r["near_next"] == pytest.approx(len(own & following) / len(own | following))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (own == changed)
        told = [{x[k : k + 16] for k in range(0, len(x), 16)} for x in (r["fingerprint"], r["edited_fingerprint"])]
        assert r["near_edited"] == pytest.approx(len(told[0] & told[1]) / len(told[0] | told[1]))


def test_next_text_over_many_ranges(spark):
    from symgraph.llm.spotsigs import with_next_text

    docs = frame(spark, [(7 * i % 101, f"t{7 * i % 101}") for i in range(101)] + [(50, "t50b")])
    found = sorted((r["doc_id"], r["text"], r["next_text"]) for r in with_next_text(docs, rows_per_range=6).collect())
    order = sorted([(i, f"t{i}") for i in range(101)] + [(50, "t50b")])
    assert found == [(*x, order[(k + 1) % len(order)][1]) for k, x in enumerate(order)]


def test_spot_edges_and_pairs(spark, odd):
    assert compare_edits(odd).count() == odd.count() and compare_edits(odd.limit(0)).count() == 0
    texts = [spotted(i) for i in range(20)]
    texts += [" ".join(t.split()[:-3]) for t in texts] + [texts[0]]
    pairs, members = near_pairs(frame(spark, texts), 0.6)
    sets = defaultdict(list)
    for i, t in enumerate(texts):
        sets[frozenset(spots(t))].append(i)
    leads = {min(v): s for s, v in sets.items()}
    expected = {(a, b) for a in leads for b in leads if a < b and len(leads[a] & leads[b]) >= 0.6 * len(leads[a] | leads[b]) - 1e-9}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == expected and expected
    assert {(r["doc_id"], r["set_id"]) for r in members.collect()} == {(i, min(v)) for v in sets.values() for i in v}


def test_every_part_of_a_text_without_common_words_counts(spark):
    from symgraph.llm.spotsigs import signature_columns

    plain = " ".join(f"x{i}" for i in range(60))
    halved = " ".join([*(f"x{i}" for i in range(30)), *(f"y{i}" for i in range(30))])
    late = spotted(3) + " the " + plain
    clauses = "\u4eca\u65e5\u306f\u3001\u826f\u3044\u3001\u5929\u6c17\u3001\u3067\u3059\u306d"
    pairs = [(plain, halved), (late, late.replace("x40 ", "z40 ")), (clauses, clauses + "\u3048"), (plain, plain + " x60")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    found = signature_columns(df, own="a", changed="b").orderBy("i").collect()
    assert all(set(r["own"]) != set(r["changed"]) for r in found)
    # Chains start at word 0 (an anchor, which holds words 1 and 2) and at words 3 to 59.
    assert len(found[0]["own"]) == 58 and len(set(found[0]["own"]) & set(found[0]["changed"])) == 26


# --- sharding -----------------------------------------------------------------


def test_shards(spark, odd, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=4000, fan_in=3, floor_bytes=3000)
    assert store.compact() is None and store.append(odd.limit(0)) is None
    with pytest.raises(LookupError):
        store.read()
    rows = lambda df: sorted(map(repr, df.select(*odd.columns).collect()))
    for n in range(7):
        store.append(odd.withColumn("key", F.lit(n).cast("long")))
        store.compact()
    held = store.read()
    assert rows(held) == sorted(r for n in range(7) for r in rows(odd.withColumn("key", F.lit(n).cast("long"))))
    sizes = [store.tier(r.size) for r in store.manifest().runs]
    assert len(sizes) < 7 and all(sizes.count(t) < 3 for t in sizes)
    first = store.read(1)
    assert first.count() == odd.count()
    with pytest.raises(ValueError, match="columns"):
        store.append(odd.drop("label"))
    before = len(store.versions())
    assert before > 7 and store.expire(keep=1) > 0 and len(store.versions()) == 1 and rows(store.read()) == rows(held)


def test_merged_files_have_the_target_size(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=60_000, fan_in=4, floor_bytes=1000)
    for n in range(16):
        store.append(frame(spark, [(40 * n + i, prose(40 * n + i, 40)) for i in range(40)]).repartition(5))
        store.compact()
    size = lambda f: store._fs().getFileStatus(store._path(f)).getLen()
    merged = [[size(f) for f in r.files] for r in store.manifest().runs if r.size > 50_000]
    assert store.read().count() == 640 and merged
    # No file is larger than the target, and there are at most twice as many as would do.
    assert all(max(files) <= 61_000 and len(files) <= 2 * sum(files) / 60_000 + 1 for files in merged)


def test_commits_do_not_overwrite(spark, tmp_path):
    one, two = (ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    docs = frame(spark, ["a", "b"])
    base = one.append(docs)
    two.append(docs)
    with pytest.raises(ConcurrentCommit):
        one._commit(base.schema, (), base.version)
    assert one.read().count() == 4
    assert json.loads(one.manifest().schema)["type"] == "struct"
