"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Voters, of several origins. Seed lexicons of insults and profanity, one for each language
   and kind, vote on a text's words. Words that keep company with seed words make a lexicon
   without any labels. Two more are induced from the labels of the training sample, of words
   and of word beginnings, at several levels of purity. Patterns look for masked and stretched
   words, shouting, exclamations, and seed words that follow a form of address. Each votes
   toxic, not toxic, or abstains. The training label is one more voter.
2. Label model. The votes are drawn given a hidden class: each voter's vote depends on the
   class and on the vote of at most one other voter. EM estimates the share of the classes
   and these tables, that is the voters' accuracies and their correlations; which voters
   depend on which is the maximum spanning forest of their mutual information given the
   class, estimated with the rest. EM starts from the share of toxic votes; that labels are
   mostly right is a prior belief (``LABEL_TRUST``).
3. Classifier. A logistic regression over lexicon entries, hit counts and votes is trained
   on the posterior labels, and scores whole texts.

The sample has the labelled training documents of the smallest hashes, at most
``max_toxic`` and ``max_other`` of them, distinct texts; everything learned has a bound, so
it is broadcast. Scoring is one pass over the documents without a shuffle.

Defined cases: a null text is empty; a text without words has the score of no hits at all.
Null labels are passed over; a doc_id with several labels is toxic if any is. Without
labelled documents of both classes only the seed lexicons speak. Repeated rows are scored
one by one. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import written

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that lexicons may hold.
STEMS = (4, 5, 6)
_CACHED_WORDS = 50_000  # words that a task keeps looked up

#: Insults and profanity of several languages (seed lexicons; words, lower-cased).
SEEDS = {
    "insult": """idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting
        clown fool fools imbecile pig pigs vermin filth ugly coward liar creep freak jerk""",
    "profanity": "fuck fucking shit bitch bastard asshole crap damn whore slut cunt dick piss",
    "german": "arschloch scheisse scheiße dumm idioten trottel abschaum wichser hure schlampe",
    "french": "connard connasse salope merde imbécile crétin ordure putain enculé débile",
    "spanish": "estúpido imbécil basura mierda puta cabrón gilipollas escoria pendejo asqueroso",
}
_SEED_WORDS = frozenset(w for words in SEEDS.values() for w in words.split())


def terms_of(words: Counter) -> Counter:
    """Lexicon terms of a text: its words, and their beginnings marked by length."""
    out: Counter = Counter()
    for word, n in words.items():
        out[word] += n
        for k in STEMS:
            if len(word) > k:
                out[f"{k}|{word[:k]}"] += n
    return out


@dataclass
class Lexicon:
    """Terms with their purity, the share of toxic texts among those that hold them, and the seeds' company."""

    terms: dict[str, tuple[int, float]] = field(default_factory=dict)  # number, purity
    company: frozenset[str] = frozenset()
    _cache: dict[str, tuple[tuple[int, float, bool], ...]] = field(default_factory=dict, repr=False)

    def of_word(self, word: str) -> tuple[tuple[int, float, bool], ...]:
        """Number, purity, and whether it is a beginning, of each term that a word has."""
        found = self._cache.get(word)
        if found is None:
            held = [(word, False), *((f"{k}|{word[:k]}", True) for k in STEMS if len(word) > k)]
            found = tuple((*self.terms[t], stem) for t, stem in held if t in self.terms)
            if len(self._cache) < _CACHED_WORDS:
                self._cache[word] = found
        return found

    def __getstate__(self):
        return {"terms": self.terms, "company": self.company, "_cache": {}}


#: Purities from which an induced lexicon's hits are counted apart.
LEVELS = (0.8, 0.9, 0.97)
#: Forms of address (fixed values).
ADDRESS = frozenset("you your u ya du dich dein ihr euch tu toi vous votre ton usted tú te ustedes vosotros".split())
_MASKED = re.compile(r"[^\W\d_][*#@$%]{2,}[^\W\d_]?|[^\W\d_][*@$][^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
_SEED_KIND = {w: i for i, words in enumerate(SEEDS.values()) for w in words.split()}


@dataclass
class Signs:
    """What the voters and the classifier see of a text."""

    terms: dict[int, int]  # occurrences of each lexicon term
    hits: np.ndarray  # words with a term of each level of purity: whole words, then beginnings
    seeds: list[int]  # seed words of each kind
    company: int
    words: int
    shouted: int
    marks: int
    masked: bool
    stretched: bool
    addressed: bool


def signs_of(text: str, lexicon: Lexicon) -> Signs:
    words = _WORD.findall(text.lower())
    terms: dict[int, int] = {}
    hits, seeds, company = np.zeros(2 * len(LEVELS), np.int64), [0] * len(SEEDS), 0
    for word, n in Counter(words).items():
        found = lexicon.of_word(word)
        if found:
            purity = [0.0, 0.0]
            for number, p, stem in found:
                terms[number] = terms.get(number, 0) + n
                purity[stem] = max(purity[stem], p)
            hits += n * np.array([purity[stem] >= level for stem in (0, 1) for level in LEVELS])
        kind = _SEED_KIND.get(word)
        if kind is not None:
            seeds[kind] += n
        company += n * (word in lexicon.company)
    shouted = sum(len(w) > 1 and w.isupper() for w in text.split())
    addressed = any(seeds) and any(w in _SEED_KIND and not ADDRESS.isdisjoint(words[max(i - 4, 0) : i]) for i, w in enumerate(words))
    masked = any(c in text for c in "*#@$%") and _MASKED.search(text) is not None
    return Signs(terms, hits, seeds, company, len(words), shouted, text.count("!"), masked, _STRETCHED.search(text) is not None, addressed)


_KINDS = [(kind, level) for kind in ("words", "beginnings") for level in LEVELS]
VOTERS = (
    *(f"seeds: {kind}" for kind in SEEDS),
    "seeds>=2",
    "company>=1",
    "company>=3",
    *(f"{kind}, {level}>=1" for kind, level in _KINDS),
    *(f"{kind}, {level}>=3" for kind, level in _KINDS),
    *(f"{kind}, {level}/1000>=3" for kind, level in _KINDS),
    "addressed",
    "masked",
    "stretched",
    "shouted",
    "marks",
    "nothing",
)


def votes_of(s: Signs) -> list[int]:
    """One vote for each of ``VOTERS``: 1 toxic, -1 not toxic, 0 abstains."""
    least = lambda count, n: 1 if count >= n else (-1 if not count else 0)
    hits, seeds = s.hits.tolist(), sum(s.seeds)
    out = [int(n > 0) for n in s.seeds]
    out += [int(seeds >= 2), least(s.company, 1), least(s.company, 3)]
    out += [least(n, k) for k in (1, 3) for n in hits]
    out += [1 if n and 1000 * n >= 3 * s.words else (-1 if not n else 0) for n in hits]
    out += [int(s.addressed), int(s.masked), int(s.stretched)]
    out.append(1 if s.words >= 5 and s.shouted > 0.3 * s.words else 0)
    out.append(1 if s.words >= 5 and s.marks > 0.1 * s.words else 0)
    out.append(-1 if not any(hits) and not seeds else 0)
    return out


#: The share of training labels that are believed right, with a weight of as many labels as there are.
LABEL_TRUST = 0.95
#: Mutual information (nats) from which two voters count as dependent.
LEAST_DEPENDENCE = 0.02


@dataclass
class LabelModel:
    """Votes of a hidden class, each voter depending on the class and perhaps on one other voter.

    ``tables[i][class, vote of the other, vote]`` (votes 0, 1, 2 for not toxic, abstains,
    toxic); ``other[i]`` is the voter that voter i depends on, or -1.
    """

    share: float
    other: list[int]
    tables: list[np.ndarray]

    def log_odds(self, cast: np.ndarray) -> np.ndarray:
        """Of the toxic class, for each row of votes (0, 1, 2)."""
        odds = np.full(len(cast), np.log(self.share) - np.log1p(-self.share))
        for i, table in enumerate(self.tables):
            given = cast[:, self.other[i]] if self.other[i] >= 0 else np.zeros(len(cast), np.int64)
            odds += np.log(table[1, given, cast[:, i]]) - np.log(table[0, given, cast[:, i]])
        return odds


def _forest(joint: np.ndarray, m: int) -> list[int]:
    """For each voter the one it depends on: the maximum spanning forest by mutual information given the class.

    ``joint[class, voter, vote, voter, vote]`` has counts.
    """
    p = joint / joint.sum(axis=(0, 2, 4), keepdims=True)
    one = np.einsum("ciaia->cia", p)
    of_class = one.sum(axis=2)[:, :, None, None, None]
    apart = one[:, :, :, None, None] * one[:, None, None, :, :] / of_class
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(p > 0, p * np.log(p / apart), 0).sum(axis=(0, 2, 4))
    other, best = [-1] * m, np.full(m, -1.0)
    open_ = set(range(m))
    while open_:
        i = max(open_, key=lambda v: (best[v], -v))
        open_.remove(i)
        if best[i] < LEAST_DEPENDENCE:
            other[i] = -1
        for j in open_:
            if gain[i, j] > best[j]:
                best[j], other[j] = gain[i, j], i
    return other


def fit_label_model(votes: np.ndarray, gold: np.ndarray | None = None, rounds: int = 60) -> tuple[LabelModel, np.ndarray]:
    """The label model of votes of -1, 0, 1 (and labels), and each row's posterior chance of the toxic class."""
    cast = votes.astype(np.int64) + 1
    # The first guess is the share of toxic votes; voters that go together count as one, those that never differ as none.
    spread = (votes - votes.mean(axis=0)) / (votes.std(axis=0) + 1e-9)
    weight = 1 / np.maximum(((spread.T @ spread / len(votes)) ** 2).sum(axis=1), 1)
    weight = weight * (votes.std(axis=0) > 0)
    posterior = ((votes > 0) @ weight + 0.1) / ((votes != 0) @ weight + 0.2)
    if gold is not None:
        cast = np.concatenate([cast, np.where(gold > 0, 2, 0)[:, None]], axis=1)
    n, m = cast.shape
    one_hot = np.eye(3)[cast].reshape(n, 3 * m)
    other: list[int] = []
    for round_ in range(rounds):
        by_class = np.stack([1 - posterior, posterior])
        joint = np.stack([one_hot.T @ (one_hot * w[:, None]) for w in by_class]).reshape(2, m, 3, m, 3)
        if round_ < 10:  # then the structure is kept, so that the likelihood can only rise
            # By the likelier class of each row: a class still in doubt would pass for dependence among its voters.
            sure = [one_hot[posterior < 0.5], one_hot[posterior >= 0.5]]
            other = _forest(np.stack([x.T @ x for x in sure]).reshape(2, m, 3, m, 3) + 1e-3, m)
        tables = []
        for i, j in enumerate(other):
            if gold is not None and i == m - 1:
                other[i] = j = -1  # labels are not drawn from votes
            counts = joint[:, j, :, i, :] if j >= 0 else np.repeat(np.einsum("caa->ca", joint[:, i, :, i, :])[:, None, :], 3, axis=1)
            counts = counts + 0.5
            if gold is not None and i == m - 1:
                belief = n / 2 * np.array([[LABEL_TRUST, 0, 1 - LABEL_TRUST], [1 - LABEL_TRUST, 0, LABEL_TRUST]])
                counts = counts + belief[:, None, :]
            tables.append(counts / counts.sum(axis=2, keepdims=True))
        share = (by_class[1].sum() + 1) / (n + 2)
        if gold is not None:  # the labels' share is believed as the labels are
            share = (2 * share + (gold > 0).mean()) / 3
        share = min(max(share, 1e-6), 1 - 1e-6)
        model = LabelModel(float(share), list(other), tables)
        new = 1 / (1 + np.exp(-np.clip(model.log_odds(cast), -30, 30)))
        done = np.abs(new - posterior).max() < 1e-4
        posterior = new
        if done and round_ >= 10:
            break
    return model, posterior


def features_of(s: Signs, votes: list[int], n_terms: int) -> tuple[list[int], list[float]]:
    """Sparse features: terms held, votes, counts and densities of hits."""
    at, value = [], []
    for number, n in s.terms.items():
        at.append(number)
        value.append(min(1.0 + 0.5 * np.log(n), 3.0))
    base = n_terms
    for i, v in enumerate(votes):
        if v:
            at.append(base + i)
            value.append(float(v))
    base += len(VOTERS)
    counted = [*s.hits.tolist(), sum(s.seeds)]
    for i, hits in enumerate(counted):
        if hits:
            at += [base + 2 * i, base + 2 * i + 1]
            value += [float(np.log1p(hits)), min(100 * hits / max(s.words, 1), 20.0) / 5]
    return at, value


def n_features(n_terms: int) -> int:
    return n_terms + len(VOTERS) + 2 * (2 * len(LEVELS) + 1)


@dataclass
class Classifier:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        s = signs_of(text, self.lexicon)
        at, value = features_of(s, votes_of(s), len(self.lexicon.terms))
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[a] * v for a, v in zip(at, value, strict=True)), -30, 30))))


def fit_logistic(rows: list[tuple[list[int], list[float]]], target: np.ndarray, weight: np.ndarray, size: int, ridge: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Sparse logistic regression on soft labels, by Adam over the whole sample."""
    at = np.fromiter((a for r, _ in rows for a in r), np.int64)
    value = np.fromiter((v for _, r in rows for v in r), np.float64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r, _ in rows])
    w, bias = np.zeros(size), 0.0
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    total = weight.sum()
    for step in range(1, steps + 1):
        margin = bias + np.bincount(owner, w[at] * value, len(rows))
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target) * weight
        slope = np.append(np.bincount(at, error[owner] * value, size) + ridge * w, error.sum()) / total
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = 0.05 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    return w, bias


def training_sample(docs: DataFrame, labels: DataFrame, training: Column, max_toxic: int, max_other: int) -> DataFrame:
    """``(doc_id, text, toxic)`` of the labelled training rows of the smallest hashes, texts distinct."""
    known = labels.where(training & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(max_other))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = held.join(F.broadcast(written(chosen, "label-sample")), "doc_id")
    return held.groupBy(F.xxhash64("text").alias("_key"), "text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")).drop("_key")


def induce_lexicon(sample: DataFrame, max_terms: int = 4000, least: int = 6) -> Lexicon:
    """Terms that toxic texts of the sample hold far more often than others, purest first, and the seeds' company.

    Company is what texts with seed words hold far more often than others, whatever their labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(3)]
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = Counter(_WORD.findall(text.as_py().lower()))
                held = list(terms_of(words))
                counts[0].update(held)
                if label:
                    counts[1].update(held)
                if not _SEED_WORDS.isdisjoint(words):
                    counts[2].update(words.keys())
        names = list(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in counts)], names=["term", "texts", "toxic", "seeded"])

    counted = sample.select("text", "toxic").mapInArrow(run, "term string, texts long, toxic long, seeded long")
    counted = counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("texts", "toxic", "seeded")))
    counted = written(counted, "term-counts")
    totals = sample.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    # Without labels of both classes, only seeds and their company are left.
    share = (totals["t"] or 0) / max(totals["n"], 1)
    rows: list = []
    if 0 < share < 1:
        kept = counted.where((F.col("texts") >= least) & (_purity("toxic") >= 3 * share / (1 + 2 * share)) & (_surplus("toxic", share) > 4))
        rows = kept.select("term", _purity("toxic").alias("purity")).orderBy(F.desc(_surplus("toxic", share)), "term").limit(max_terms).collect()
    # Purity is taken against a base rate of one half, whatever the sample's mix.
    odds = lambda p: p * (1 - share) / (p * (1 - share) + (1 - p) * share)
    terms = {r["term"]: (i, odds(r["purity"])) for i, r in enumerate(rows)} or {w: (i, 0.9) for i, w in enumerate(sorted(_SEED_WORDS))}
    seeded = counted.where(F.col("term").isin(sorted(_SEED_WORDS))).agg(F.max("seeded")).first()[0] or 0
    part = min(max(2 * seeded / max(totals["n"], 1), 0.01), 0.99)  # about the share of texts with seed words
    near = counted.where((F.col("texts") >= least) & ~F.col("term").contains("|") & (_purity("seeded") >= min(2.5 * part, 0.9)) & (_surplus("seeded", part) > 6))
    company = near.where(~F.col("term").isin(sorted(_SEED_WORDS))).orderBy(F.desc(_surplus("seeded", part)), "term").limit(max_terms).collect()
    return Lexicon(terms, frozenset(r["term"] for r in company))


def _purity(column: str) -> Column:
    return F.col(column) / F.col("texts")


def _surplus(column: str, share: float) -> Column:
    """The surplus over a share of the texts, in standard deviations."""
    return (F.col(column) - F.col("texts") * share) / F.sqrt(F.col("texts") * share * (1 - share))


def train(docs: DataFrame, labels: DataFrame, training: Column, max_toxic: int = 4000, max_other: int = 8000) -> Classifier:
    """A classifier of ``docs(doc_id, text)`` from the rows of ``labels(doc_id, toxic)`` where ``training`` holds."""
    sample = written(training_sample(docs, labels, training, max_toxic, max_other), "toxicity-sample")
    lexicon = induce_lexicon(sample)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            rows = []
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                s = signs_of(text.as_py(), lexicon)
                votes = votes_of(s)
                rows.append((*features_of(s, votes, len(lexicon.terms)), votes, label))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["at", "value", "votes", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(run, "at array<int>, value array<double>, votes array<int>, toxic int").collect()
    size = n_features(len(lexicon.terms))
    gold = np.array([r["toxic"] for r in rows])
    if not len(rows) or gold.min() == gold.max():
        # Only the seeds' votes: one hit is even odds, each doubling adds.
        weights = np.zeros(size)
        weights[len(lexicon.terms) + len(VOTERS) + 4 * len(LEVELS)] = 3.0
        return Classifier(lexicon, weights, -2.1)
    votes = np.array([r["votes"] for r in rows])
    posterior = fit_label_model(votes, gold)[1]
    weights, bias = fit_logistic([(r["at"], r["value"]) for r in rows], posterior, np.ones(len(rows)), size)
    # The sample takes other shares of the classes than the labelled rows have; undo it.
    known = labels.where(training & F.col("toxic").isNotNull()).agg(F.avg((F.col("toxic") > 0).cast("double")).alias("p")).first()["p"]
    here = gold.mean()
    return Classifier(lexicon, weights, float(bias + np.log(known / (1 - known)) - np.log(here / (1 - here))))


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    names = docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keep = pa.array([model.score(t.as_py() or "") < 0.5 for t in batch.column(text)], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, docs.schema)
