import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from samples import frame, prose
from pyspark.sql import functions as F

from symgraph.llm import substring_dedup
from symgraph.llm.components import connected_components
from symgraph.llm.esa import EnhancedSuffixArray
from symgraph.llm.line_dedup import dedup_lines
from symgraph.llm.simhash import QUADRUPLES, fingerprint_hex, near_duplicates, one_of_each
from symgraph.llm.substring_dedup import remove_repeats
from symgraph.llm.xxh import majority_bits, xxh64_slices


# --- line dedup ---------------------------------------------------------------


def kept_lines(texts, least):
    """By the definition: a line goes if a run with enough words that holds it occurs earlier."""
    lines = {i: t.split("\n") for i, t in texts}
    weigh = lambda run: sum(len(x.split()) for x in run)
    first = {}
    for i in sorted(lines):
        for s in range(len(lines[i])):
            for e in range(s + 1, len(lines[i]) + 1):
                first.setdefault(tuple(lines[i][s:e]), (i, s))
    out = {}
    for i, own in lines.items():
        gone = set()
        for s in range(len(own)):
            for e in range(s + 1, len(own) + 1):
                run = tuple(own[s:e])
                if weigh(run) >= least and first[run] != (i, s):
                    gone |= set(range(s, e))
        out[i] = "\n".join(x for k, x in enumerate(own) if k not in gone)
    return out


def test_line_dedup_is_exact(spark):
    chosen = random.Random(3)
    pool = ["", "a", "b c", "d e f", "g h i j k", "l", "m n o p q r s t"]
    texts = [(i, "\n".join(chosen.choice(pool) for _ in range(chosen.randint(1, 14)))) for i in range(40)]
    found = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, texts), 6).collect()}
    assert found == kept_lines(texts, 6)


def test_line_dedup_tells_documents_apart_by_text(spark):
    run = "one two three\nfour five six"
    rows = [(7, run), (7, "keep one\n" + run), (None, "keep two\n" + run), (None, "keep two\n" + run), (None, "keep three\nkeep two"), (8, run), (8, run)]
    found = dedup_lines(frame(spark, rows), 6).collect()
    left = sorted((r["doc_id"] or 0, r["text"]) for r in found)
    # The rows without an id come first, so theirs are the first copies.
    assert left == [(0, "keep three\nkeep two"), (0, "keep two\n" + run), (0, "keep two\n" + run), (7, ""), (7, "keep one"), (8, ""), (8, "")]


def test_line_dedup_of_long_blank_and_repeating_texts(spark):
    chosen = random.Random(5)
    blanks = "\n" * 60
    texts = ["a b" + blanks + "c d", "a b" + blanks + "c d" + blanks, "\n".join(chosen.choice(["x", "y", ""]) for _ in range(90))]
    texts += ["\n".join(["p q r"] * 40), "\n".join(["p q r"] * 9 + ["s"] + ["p q r"] * 3)]
    found = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, texts), 4).collect()}
    assert found == kept_lines(list(enumerate(texts)), 4)


def test_line_dedup_edges(spark, odd):
    found = dedup_lines(odd, 20).collect()
    assert len(found) == odd.count()
    texts = {(r["doc_id"], r["key"]): r["text"] for r in found}
    assert texts[1, 0] is None and texts[2, 1] == "" and texts[3, 2] == " \n\t\n"
    assert texts[5, 5] == "" and texts[4, 3] == texts[4, 4] != ""
    assert dedup_lines(odd.limit(0)).count() == 0
    many = frame(spark, ["\n".join(["one two three"] * 3000), "\n".join(["one two three"] * 10)])
    assert [len(r["text"].split("\n")) for r in dedup_lines(many, 6).orderBy("doc_id").collect()][0] <= 2


# --- SimHash ------------------------------------------------------------------


def simhash(text, words=3):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts = [w for w in re.split(r"[\x20\x09-\x0D]+", parts) if w]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_hashes_of_all_lengths():
    data = bytes(random.Random(1).randrange(256) for _ in range(400))
    starts = np.array([s for s in range(0, 100, 7) for _ in range(80)])
    sizes = np.array([n for _ in range(0, 100, 7) for n in range(80)])
    found = xxh64_slices(data, starts, sizes, 42)
    assert found.tolist() == [xxhash.xxh64_intdigest(data[s : s + n], 42) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    h = np.array([random.Random(i).getrandbits(64) for i in range(1300)], dtype=np.uint64)
    bits = majority_bits(h, np.array([1, 999, 300]))
    assert bits[0] == h[0] and int(bits[1]) == sum(1 << b for b in range(64) if 2 * int(((h[1:1000] >> np.uint64(b)) & np.uint64(1)).sum()) > 999)


def test_quadruples_cover_any_five_positions():
    from itertools import combinations

    assert all(any(set(q) <= set(five) for q in QUADRUPLES) for five in combinations(range(8), 5))


def test_components_by_simhash(spark):
    base = prose(5, 400).split()
    texts = [None, "", " \t ", "One", "one", "A b", prose(6, 30)]
    for i in range(60):
        own = list(base)
        for k in range(i % 3):
            own[(37 * i + k) % 400] = f"w{i}{k}"
        texts.append(" ".join(own))
    found = near_duplicates(frame(spark, texts)).select("doc_id", fingerprint_hex(F.col("fp")).alias("h"), "component_id").collect()
    prints = {i: simhash(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["h"] for r in found} == {i: f"{p:016x}" for i, p in prints.items()}
    leader = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            leader[i] = min(leader[j] for j in prints if bin(prints[i] ^ prints[j]).count("1") <= 3)
    assert {r["doc_id"]: r["component_id"] for r in found} == leader


def test_long_posting_lists_are_dealt_in_blocks(spark, monkeypatch):
    from symgraph.llm import simhash as module

    monkeypatch.setattr(module, "_BLOCK", 8)
    chain = [(1 << (i % 3)) ^ (i // 3 << 40) for i in range(90)]
    nodes = spark.createDataFrame([(i, [x]) for i, x in enumerate(dict.fromkeys(chain))], "id long, fp array<long>")
    edges = module.links(nodes, QUADRUPLES, 5, 3).collect()
    values = list(dict.fromkeys(chain))
    near = lambda a, b: bin(values[a] ^ values[b]).count("1") <= 3
    assert all(near(r["src"], r["dst"]) for r in edges)
    group = {i: i for i in range(len(values))}
    other = dict(group)
    for _ in values:
        for i in range(len(values)):
            group[i] = min(group[j] for j in range(len(values)) if near(i, j))
        for r in edges:
            other[r["src"]] = other[r["dst"]] = min(other[r["src"]], other[r["dst"]])
    assert other == group


def test_one_of_each(spark, odd):
    first = prose(9, 300)
    near = " ".join(w if i != 150 else "changed" for i, w in enumerate(first.split()))
    kept = one_of_each(frame(spark, [first, prose(10, 300), near, first, "", ""])).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 1, 4]
    left = one_of_each(odd)
    assert left.columns == odd.columns and one_of_each(odd.limit(0)).count() == 0
    # The rows without words are alike; 4, 4 and 5 are copies; the one without an id is alone.
    assert sorted((r["doc_id"] or 0, r["key"]) for r in left.collect() if r["doc_id"] != 4) == [(0, 6), (1, 0), (6, 7)] and left.count() == 4
    mixed = frame(spark, [(7, first), (7, prose(11, 90)), (None, near), (None, prose(12, 90)), (None, prose(12, 90))])
    assert sorted(r["text"] for r in one_of_each(mixed).collect()) == sorted([first, prose(11, 90), prose(12, 90)])


def test_simhash_edges(spark, odd):
    assert near_duplicates(odd).count() == odd.count() and near_duplicates(odd.limit(0)).count() == 0
    same = frame(spark, [(None, prose(2, 60)), (3, prose(2, 60)), (None, "x y z")])
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in near_duplicates(same).collect()) == [(0, 0), (0, 3), (3, 3)]


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(9, i) for i in range(1000, 1200)]
    edges = spark.createDataFrame([*path, *star, (7, 7)], "src long, dst long")
    found = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 9 for i in [9, *range(1000, 1200)]}
    assert connected_components(edges.limit(0)).count() == 0


# --- suffix array -------------------------------------------------------------


def without_repeats(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + length] for b in bodies for s in range(len(b) - length + 1))
    out = []
    for b in bodies:
        marks = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                marks[s : s + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, marks, strict=True) if not m)
        out.append((len(b), sum(marks), len(re.findall(b"\1+", bytes(marks))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("max_blocks", [4000, 2])
def test_repeats_are_exact(spark, monkeypatch, max_blocks):
    monkeypatch.setattr(substring_dedup.repeated_spans, "__defaults__", (200, 50, max_blocks))
    chosen = random.Random(11)
    passage = [prose(20 + i, 60) for i in range(4)]
    texts = [None, "", "é" * 150, "ab" * 300, prose(30, 400)]
    for i in range(40):
        parts = [prose(100 + i, chosen.randint(1, 40))]
        for _ in range(chosen.randint(0, 3)):
            p = chosen.choice(passage)
            parts += [p[chosen.randint(0, 60) : chosen.randint(230, len(p))], prose(500 + chosen.randint(0, 30), 3)]
        texts.append(" ".join(parts))
    found = remove_repeats(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in found] == without_repeats(texts, 200)


def test_repeat_edges(spark, odd):
    found = remove_repeats(odd, with_text=True).collect()
    assert len(found) == odd.count()
    assert {(r["doc_id"], r["n_removed"] > 0) for r in found} == {(1, False), (2, False), (3, False), (4, True), (5, True), (None, False), (6, True)}
    assert all(r["n_bytes"] - r["n_removed"] == len(r["kept"]) for r in found)
    assert remove_repeats(odd.limit(0)).count() == 0


def test_suffix_array_and_intervals():
    text = b"mississippi$banana"
    octets = np.frombuffer(text, np.uint8)
    ends = np.full(len(text), len(text))
    array = EnhancedSuffixArray(octets, ends, np.arange(len(text)), 4)
    order = sorted(range(len(text)), key=lambda i: text[i:])
    assert array.positions.tolist() == order
    common = lambda a, b: next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or a + k >= len(text) or b + k >= len(text)), 0)
    assert array.lcp.tolist() == [0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)]
    before = np.r_[-1, octets[:-1].astype(int)]
    found = {(d, tuple(sorted(p.tolist()))) for d, p in array.maximal_repeats(2, before)}
    places = defaultdict(list)
    for n in range(2, len(text)):
        for s in range(len(text) - n + 1):
            places[text[s : s + n]].append(s)
    maximal = {(len(x), tuple(p)) for x, p in places.items() if len(p) > 1 and len({text[i - 1 : i] for i in p}) > 1 - (0 in p) and len({text[i + len(x) : i + len(x) + 1] for i in p}) > 1}
    assert found == maximal


def joined(pairs, nodes):
    """The smallest node that each node reaches."""
    leader = {n: n for n in nodes}
    for _ in leader:
        for a, b in pairs:
            leader[a] = leader[b] = min(leader[a], leader[b])
    return leader


@pytest.mark.parametrize("block", [2048, 9])
def test_forests_join_what_all_pairs_join(spark, monkeypatch, block):
    from symgraph.llm import simhash as module

    monkeypatch.setattr(module, "_BLOCK", block)
    chosen = random.Random(4)
    sets = [sorted(chosen.sample(range(60), chosen.randint(30, 40))) for _ in range(40)]
    sets += [sorted({*chosen.sample(s, len(s) - chosen.randint(1, 4)), 70 + i}) for i, s in enumerate(sets)]
    n, parts = len(sets), [i % 40 if i % 5 == 0 else i for i in range(len(sets))]
    fps = [[chosen.getrandbits(5), chosen.getrandbits(5)] for _ in sets]
    lists = [(i % 2, i) for i in range(40)] + [(7, i) for i in range(n)] + [(9, 3), (9, 4)]
    nodes = spark.createDataFrame(list(enumerate(fps)), "set_id long, fp array<long>")
    members = spark.createDataFrame([(k, i, len(sets[i]), parts[i]) for k, i in lists], "key long, set_id long, n int, component long")
    bits = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(fps[a], fps[b], strict=True))
    fits = [(a, b) for a in range(n) for b in range(a) if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and bits(a, b) <= 2]
    found = [tuple(r) for r in module.possible_links(members, nodes, 0.8, 2).collect()]
    assert joined(found, set(parts)) == joined([(parts[a], parts[b]) for a, b in fits], set(parts))
    jaccard = lambda a, b: len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]})
    alike = [(a, b) for a in range(n) for b in range(a) if jaccard(a, b) >= 0.8]
    held = spark.createDataFrame(list(enumerate(sets)), "set_id long, elements array<long>")
    found = [tuple(r) for r in module.verified_links(members, nodes, held, 0.8, 128).collect()]
    assert {(max(x), min(x)) for x in found} <= set(alike) and len(alike) >= 30
    own = [(i, p) for i, p in enumerate(parts)]
    assert joined(found + own, range(n)) == joined(alike + own, range(n))


def test_stage_searches_by_the_index_of_fingerprints(spark, monkeypatch):
    from itertools import combinations

    from symgraph.llm import set_join
    from symgraph.llm import simhash as module

    base = [prose(40 + i, 400).split() for i in range(6)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:k], "edited", *b[k + 1 :]]) for b in base for k in (50, 200, 350)]
    # Equal fingerprints, as one shingle is most of the text, but other shingles: both stay.
    texts += ["a " * 2000 + prose(60, 30), "a " * 2000 + prose(61, 30)]
    prints = [simhash(t, 5) for t in texts]
    assert prints[-1] == prints[-2]
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if bin(prints[a] ^ prints[b]).count("1") <= 3]
    assert len(near) >= 10
    seen, known = [], []
    links, similar_sets = module.links, module.similar_sets
    monkeypatch.setattr(module, "links", lambda nodes, sets, least, most: seen.append((sets, least, most, links(nodes, sets, least, most))) or seen[-1][3])
    monkeypatch.setattr(module, "similar_sets", lambda *a: known.append(a[4].count()) or similar_sets(*a))
    kept = {r["doc_id"] for r in one_of_each(frame(spark, texts)).collect()}
    assert kept == {*range(6), len(texts) - 2, len(texts) - 1}
    ((sets, least, most, found),) = seen
    assert (sets, least, most) == (QUADRUPLES, 5, 3) and known[0] >= 8
    number = {p: min(i for i, q in enumerate(prints) if q == p) for p in prints}
    of = lambda x: number[x % 2**64]
    by_index = [(of(r["src"]), of(r["dst"])) for r in found.collect()] + [(i, number[p]) for i, p in enumerate(prints)]
    assert joined(by_index, range(len(texts))) == joined(near, range(len(texts)))
    # Pairs that these links join are not compared again.
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (5, 6)], "src long, dst long")
    classes = spark.createDataFrame([(1, 1), (2, 1), (4, 1)], "id long, component long")
    assert {tuple(r) for r in set_join._apart(pairs, classes).collect()} == {(1, 3), (5, 6)}


@pytest.mark.parametrize("block", [2048, 5])
def test_wide_classes_are_those_of_exact_likeness(spark, monkeypatch, block):
    from symgraph.llm import simhash as module

    monkeypatch.setattr(module, "_BLOCK", block)
    texts, held = [], []
    for i in range(120):
        base = prose(700 + i % 40, 100 + 5 * (i % 40)).split()
        own = list(base)
        for k in range(i // 40 * (1 + i % 4)):  # each edited word costs up to five shingles
            own[(11 + 23 * k) % len(own)] = f"w{i}x{k}"
        texts.append(" ".join(own))
    texts += ["a b c d e f g h", "a b c d e f g h i", "a b c d e f g", "", None, "One two", "one TWO"]
    for t in texts:
        parts = (t or "").lower().split()
        held.append({tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set())
    like = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    near = [[j for j in range(len(held)) if like(held[i], held[j])] for i in range(len(held))]
    around = [len(a & b) / len(a | b) for a in held for b in held if a and a is not b]
    assert sum(0.8 <= x < 0.86 for x in around) > 20 < sum(0.7 < x < 0.8 for x in around)
    leader = list(range(len(held)))
    for _ in held:
        leader = [min(leader[j] for j in near[i]) for i in range(len(held))]
    kept = {r["doc_id"] for r in one_of_each(frame(spark, texts)).collect()}
    assert kept == set(leader)
