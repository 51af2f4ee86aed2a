"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of orders 1 to 4 over lower-cased letters, with everything else
read as one space. Counts come from every training document: a scan task counts its own
4-grams and emits each once, Spark sums them, derives the lower orders' counts and joins
probabilities and back-off weights. What a model holds is every n-gram of its training
texts, so it grows with them. It is scored from sorted arrays of 64-bit hashes.

Arrays are broadcast in parts of at most ``PART_ENTRIES`` numbers, each of which has one pass
over the documents: several languages, or, of a language with more n-grams than that, those
that end in some of the characters, with which the text's positions that end in the same
characters are scored. Sums over the parts are exact.

A text gets the language of the lowest cross-entropy per character. The score is the chance
that this is right, from a logistic calibration over the margin to the second language, the
length, and by how much the entropy is above what the language's own texts have. It is
fitted on all the training documents that a second model, of the same counts without them, has
not seen: as they are, and as texts of a language that no model knows, for which the document's
own is left out. Predictions below ``reject_below`` are marked as not accepted; other
scripts and noise end there.

Defined cases: a null text or one without letters is ``und`` with score 0, not accepted.
Without training documents every text is. Ties go to the alphabetically first language.
Repeated rows, and rows without a doc_id, are judged one by one. Extra columns are ignored,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import written
from symgraph.llm.xxh import remix

ORDERS = 4
#: Numbers (of four bytes) in the arrays of one part of the models.
PART_ENTRIES = 24_000_000

_CHUNK = 1 << 19  # characters
_FLUSH = 1 << 20  # distinct n-grams that a task gathers before it emits them
_STEPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _characters(text: str) -> np.ndarray:
    """Code points of a text's letters, lower-cased, other runs as one space, padded by spaces."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letter_table()[points], points, np.uint32(32))
    points = np.concatenate((np.full(ORDERS, 32, np.uint32), points, np.full(1, 32, np.uint32)))
    space = points == 32
    keep = ~(space & np.r_[False, space[:-1]])
    keep[:ORDERS] = True
    keep[ORDERS : ORDERS + 1] &= ~space[ORDERS : ORDERS + 1]
    return points[keep]


def _keys(points: np.ndarray) -> list[np.ndarray]:
    """For each order, the hashed n-gram that ends at each position."""
    c, total, out = points.astype(np.uint64) + np.uint64(1), None, []
    for order in range(ORDERS):
        step = np.zeros(len(c), np.uint64)
        step[order:] = c[: len(c) - order] if order else c
        total = step * _STEPS[order] if total is None else total + step * _STEPS[order]
        out.append(remix(total, order + 1).view(np.int64))
    return out


def _keys_of(grams: np.ndarray) -> np.ndarray:
    """Hashes of n-grams given as rows of code points: those that ``_keys`` has."""
    total = np.zeros(len(grams), np.uint64)
    for back in range(grams.shape[1]):
        total += (grams[:, -1 - back].astype(np.uint64) + np.uint64(1)) * _STEPS[back]
    return remix(total, grams.shape[1]).view(np.int64)


def _positions(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The text of each position that a text predicts (its padding excluded), and the positions."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    owner = np.repeat(np.arange(len(parts)), sizes)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(inside >= ORDERS)
    return owner[at], at


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about a chunk's characters: first row and texts (null: empty)."""
    texts, held, size, lo = batch.column(column), [], 0, 0
    for i in range(len(texts)):
        held.append(texts[i].as_py() or "")
        size += len(held[-1])
        if size >= _CHUNK or i == len(texts) - 1:
            yield lo, held
            lo, held, size = i + 1, [], 0


def count_ngrams(docs: DataFrame) -> DataFrame:
    """``(lang, gram, n, n_fit)``: counts of 4-grams by language.

    ``docs(text, lang, fit)``: ``n_fit`` counts only the rows whose ``fit`` is true.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}  # rows of hash, four code points, two counts

        def summed(rows: np.ndarray) -> np.ndarray:
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            new = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
            out = rows[new].copy()
            out[:, 5:] = np.add.reduceat(rows[:, 5:], new, axis=0)
            return out

        def emit(lang: str) -> pa.RecordBatch:
            rows = summed(np.concatenate(held.pop(lang)))
            text = rows[:, 1:5].astype("<u4").tobytes().decode("utf-32-le")
            grams = [text[i : i + ORDERS] for i in range(0, len(text), ORDERS)]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), pa.array(grams, pa.string()), pa.array(rows[:, 5]), pa.array(rows[:, 6])], names=["lang", "gram", "n", "n_fit"])

        for batch in batches:
            langs, fits = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, texts in _chunks(batch, 0):
                groups: dict[tuple[str, bool], list[np.ndarray]] = {}
                for i, text in enumerate(texts):
                    groups.setdefault((langs[lo + i], bool(fits[lo + i])), []).append(_characters(text))
                for (lang, fit), parts in groups.items():
                    _, at = _positions(parts)
                    if not len(at):
                        continue
                    points = np.concatenate(parts)
                    key, first, count = np.unique(_keys(points)[-1][at], return_index=True, return_counts=True)
                    t = at[first]
                    columns = (key, *(points[t - back] for back in range(ORDERS - 1, -1, -1)), count, count * fit)
                    held.setdefault(lang, []).append(np.stack([c.astype(np.int64) for c in columns], axis=1))
                    if sum(map(len, held[lang])) > _FLUSH:
                        held[lang] = [summed(np.concatenate(held[lang]))]
                        if len(held[lang][0]) > _FLUSH // 2:
                            yield emit(lang)
        for lang in list(held):
            yield emit(lang)

    source = docs.select(F.col("text").cast("string"), F.col("lang").cast("string"), F.col("fit"))
    counted = source.mapInArrow(run, "lang string, gram string, n long, n_fit long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("n_fit").alias("n_fit"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``(model, lang, size, gram, value, is_context)`` from ``counts(model, lang, gram, n)`` of 4-grams.

    ``value`` is the probability of an n-gram's last character after the others or, for a
    context, the weight of the lower order after it. Lower orders count the different
    n-grams that end with theirs.
    """
    of, part = ["model", "lang"], lambda first, size: F.substring("gram", first, size)
    orders = {ORDERS: written(counts.withColumnRenamed("n", "v"), "grams")}
    for size in range(ORDERS - 1, 0, -1):
        lower = orders[size + 1].groupBy(*of, part(2, size).alias("gram")).agg(F.count(F.lit(1)).alias("v"))
        orders[size] = written(lower, "grams")
    alphabet = orders[1].groupBy("model").agg((F.count_distinct("gram") + 1).alias("alphabet"))
    out, below = [], None
    for size in range(1, ORDERS + 1):
        grams = orders[size]
        once, twice = (F.sum((F.col("v") == n).cast("long")) for n in (1, 2))
        share = F.when(once + twice > 0, F.least(F.greatest(once / (once + 2 * twice), F.lit(0.1)), F.lit(0.95))).otherwise(0.5)
        kinds = grams.groupBy(*of).agg(share.alias("d"), F.sum("v").alias("total"), F.count(F.lit(1)).alias("kinds"))
        if size == 1:
            joined = grams.join(F.broadcast(kinds), of).join(F.broadcast(alphabet), "model")  # a row for each language
            p = F.greatest(F.col("v") - F.col("d"), F.lit(0)) / F.col("total") + F.col("d") * F.col("kinds") / F.col("total") / F.col("alphabet")
        else:
            contexts = grams.groupBy(*of, part(1, size - 1).alias("context")).agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("kinds"))
            contexts = contexts.join(F.broadcast(kinds.select(*of, "d")), of).withColumn("weight", F.col("d") * F.col("kinds") / F.col("total"))
            contexts = written(contexts, "contexts")
            out.append(contexts.select(*of, F.lit(size).alias("size"), F.col("context").alias("gram"), F.col("weight").alias("value"), F.lit(True).alias("is_context")))
            joined = grams.withColumn("context", part(1, size - 1)).withColumn("suffix", part(2, size - 1))
            joined = joined.join(contexts, [*of, "context"]).join(below, [*of, "suffix"])
            p = F.greatest(F.col("v") - F.col("d"), F.lit(0)) / F.col("total") + F.col("weight") * F.col("p")
        found = written(joined.select(*of, "gram", p.alias("value")), "probabilities")
        out.append(found.select(*of, F.lit(size).alias("size"), "gram", "value", F.lit(False).alias("is_context")))
        below = found.select(*of, F.col("gram").alias("suffix"), F.col("value").alias("p"))
    both = out[0]
    for other in out[1:]:
        both = both.unionByName(other)
    return both


def _points(grams: pa.ChunkedArray, size: int) -> np.ndarray:
    """Code points of n-grams of one size, without a Python object for each."""
    held = pa.concat_arrays(grams.cast(pa.string()).chunks)
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
    text = held.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes().decode()
    return np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(-1, size)


@dataclass
class Part:
    """Sorted hash arrays of some languages: of each order, n-grams with log probabilities, contexts with log weights.

    ``slices`` and ``slice_``: only n-grams whose last character's code point has that remainder.
    """

    languages: list[int]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    unseen: float
    slices: int = 1
    slice_: int = 0

    @staticmethod
    def _row(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sorted_keys, values = table
        if not len(sorted_keys):
            return np.zeros((len(keys), values.shape[1]), np.float32), np.zeros(len(keys), bool)
        at = np.searchsorted(sorted_keys, keys)
        at[at == len(sorted_keys)] = 0
        return values[at], sorted_keys[at] == keys

    def log_probabilities(self, keys: list[np.ndarray], before: list[np.ndarray], order: int = ORDERS) -> np.ndarray:
        """Of each position, by language; ``keys`` and ``before`` are its and the last position's n-grams."""
        if order == 0:
            return np.full((len(keys[0]), len(self.languages)), self.unseen, np.float32)
        found, known = self._row(self.grams[order - 1], keys[order - 1])
        if not known.all():
            lost = np.flatnonzero(~known)
            lower = self.log_probabilities([k[lost] for k in keys], [k[lost] for k in before], order - 1)
            if order > 1:
                weight, seen = self._row(self.contexts[order - 1], before[order - 2][lost])
                lower = lower + np.where(seen[:, None], weight, 0)
            found[lost] = lower
        return found

    def sums(self, parts: list[np.ndarray]) -> np.ndarray:
        """Sums of log probabilities by text and language."""
        owner, at = _positions(parts)
        out = np.zeros((len(parts), len(self.languages)))
        if len(at):
            points = np.concatenate(parts)
            keys = _keys(points)
            if self.slices > 1:
                own = np.flatnonzero(points[at] % self.slices == self.slice_)
                owner, at = owner[own], at[own]
        if len(at):
            logs = self.log_probabilities([k[at] for k in keys], [k[at - 1] for k in keys])
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[heads]] = np.add.reduceat(logs.astype(np.float64), heads, axis=0)
        return out


@dataclass
class Model:
    """The parts of the models, and the calibration of scores."""

    languages: list[str]
    table: DataFrame
    shares: list[tuple[list[int], int, int]]  # of each part: languages, number of slices, slice
    unseen: float
    usual: np.ndarray | None = None  # entropy of each language's own texts
    weights: tuple[float, ...] = (0.0, 1.0, 0.0, -1.0, -1.0)
    limit: float = np.inf  # of the entropy's excess, times the square root of the length

    def part(self, number: int) -> Part:
        """A part's arrays, from its share of the table (of a bounded size)."""
        own, slices, slice_ = self.shares[number]
        names = [self.languages[i] for i in own]
        rows = self.table.where(F.col("lang").isin(names))
        if slices > 1:
            rows = rows.where(F.col("is_context") | (F.pmod(F.ascii(F.substring("gram", -1, 1)), F.lit(slices)) == slice_))
        number = (F.array_position(F.array(*map(F.lit, names)), F.col("lang")) - 1).cast("int").alias("number")
        data = rows.select("size", "is_context", number, "gram", F.col("value").cast("float").alias("value")).toArrow()
        empty = (np.zeros(0, np.int64), np.zeros((0, len(own)), np.float32))
        grams, contexts, below = [], [], None
        for size in range(1, ORDERS + 1):
            found = {}
            for is_context, width in ((True, size - 1), (False, size)):
                of = data.filter((pc.field("size") == size) & (pc.field("is_context") == is_context))
                if not width or not of.num_rows:
                    found[is_context] = (*empty, np.zeros((0, max(width, 1)), np.uint32))
                    continue
                texts, number_of = np.unique(_points(of["gram"], width).view(f"<U{width}").ravel(), return_inverse=True)
                points = texts.view("<u4").reshape(-1, width)
                values = np.full((len(texts), len(own)), np.nan, np.float32)
                values[number_of, of["number"].to_numpy()] = of["value"].to_numpy()
                keys = _keys_of(points)
                order = np.argsort(keys)
                found[is_context] = (keys[order], values[order], points[order])
            keys, values, points = found[False]
            weights = (found[True][0], np.nan_to_num(found[True][1], nan=1.0))  # a context that a language lacks weighs nothing
            if size == 1:
                values = np.where(np.isnan(values), np.exp(self.unseen), values)
            elif len(keys):
                # An n-gram that a language lacks has its context's weight times the lower order.
                weight, seen = Part._row(weights, _keys_of(points[:, :-1]))
                lower = Part._row(below, _keys_of(points[:, 1:]))[0]
                values = np.where(np.isnan(values), np.where(seen[:, None], weight, 1) * lower, values)
            below = (keys, values)
            grams.append((keys, np.log(values).astype(np.float32)))
            contexts.append((weights[0], np.log(weights[1]).astype(np.float32)))
        return Part(own, grams, contexts, self.unseen, slices, slice_)

    def judge(self, entropy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Best language of each text, its margin to the second, its entropy, and that entropy's excess."""
        best = entropy.argmin(axis=1)
        ranked = np.sort(entropy, axis=1)
        margin = ranked[:, 1] - ranked[:, 0] if entropy.shape[1] > 1 else np.ones(len(n))
        excess = np.maximum(ranked[:, 0] - self.usual[best], 0) if self.usual is not None else np.zeros(len(n))
        return best, margin, ranked[:, 0], excess

    @staticmethod
    def signs(margin: np.ndarray, n: np.ndarray, excess: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(n)), np.sqrt(margin * n), np.log1p(n), excess * np.sqrt(n), excess], axis=1)

    def scores(self, margin: np.ndarray, n: np.ndarray, excess: np.ndarray) -> np.ndarray:
        chance = 1 / (1 + np.exp(-np.clip(self.signs(margin, n, excess) @ np.array(self.weights), -30, 30)))
        return np.where(excess * np.sqrt(n) <= self.limit, chance, 0.4 * chance)


def build_model(table: DataFrame, part_entries: int = PART_ENTRIES) -> Model | None:
    """A model from the rows of ``kneser_ney`` of one ``model``, in parts of bounded size."""
    sizes = sorted((r["lang"], r["rows"], r["chars"]) for r in table.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("size") == 1).cast("long")).alias("chars")).collect())
    if not sizes:
        return None
    alphabet = table.where("size = 1").agg(F.count_distinct("gram")).first()[0] + 1
    shares: list[tuple[list[int], int, int]] = []
    group, rows = [], 0
    for i, (_, n, _) in enumerate(sizes):
        if n > part_entries:
            slices = -(-n // part_entries)
            shares += [([i], slices, k) for k in range(slices)]
        elif group and (len(group) + 1) * (rows + n) > part_entries:
            shares.append((group, 1, 0))
            group, rows = [i], n
        else:
            group, rows = [*group, i], rows + n
    if group:
        shares.append((group, 1, 0))
    return Model([lang for lang, _, _ in sizes], table, shares, float(np.log(1e-3 / alphabet)))


def _summed(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` after one pass for each part: sums, ``n`` predicted characters, and whether there are letters.

    The last pass leaves the texts behind.
    """
    languages = len(model.languages)
    for number in range(len(model.shares)):
        shared = rows.sparkSession.sparkContext.broadcast(model.part(number))
        if number:
            rows = written(rows, "language-sums")  # so that no task holds two parts

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=number == len(model.shares) - 1) -> Iterator[pa.RecordBatch]:
            part: Part = shared.value
            for batch in batches:
                for lo, texts in _chunks(batch, 1):
                    own = batch.slice(lo, len(texts))
                    parts = [_characters(t) for t in texts]
                    known = np.zeros((len(texts), languages))
                    for i, sums in enumerate(own.column(2).to_pylist()):
                        if sums:
                            known[i] = sums
                    known[:, part.languages] += part.sums(parts)
                    n = np.fromiter((len(p) - ORDERS for p in parts), np.int64, len(parts))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, known.size + 1, languages, dtype=np.int32)), pa.array(known.ravel()))
                    text = pa.nulls(len(texts), pa.string()) if last else own.column(1)
                    lettered = pa.array([any(map(str.isalpha, t)) for t in texts], pa.bool_())
                    yield pa.RecordBatch.from_arrays([own.column(0), text, lists, pa.array(n), lettered], names=own.schema.names)

        rows = rows.mapInArrow(run, rows.schema)
    return rows


def _unsummed(docs: DataFrame) -> DataFrame:
    nothing = F.lit(None)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), nothing.cast("array<double>").alias("sums"), nothing.cast("long").alias("n"), nothing.cast("boolean").alias("lettered"))


def _logistic(rows: DataFrame, size: int, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression of ``rows(x array<double>, y)`` by Newton's method, each step a sum over all rows."""
    w, pairs = np.zeros(size), [(i, j) for i in range(size) for j in range(i + 1)]
    x = [F.col("x")[i] for i in range(size)]
    for _ in range(30):
        margin = sum((c * float(v) for c, v in zip(x, w, strict=True)), F.lit(0.0))
        given = rows.withColumn("p", 1 / (1 + F.exp(-F.least(F.greatest(margin, F.lit(-30.0)), F.lit(30.0)))))
        slopes = [F.sum((F.col("p") - F.col("y")) * c) for c in x]
        bends = [F.sum(F.col("p") * (1 - F.col("p")) * x[i] * x[j]) for i, j in pairs]
        sums = np.array(given.agg(*slopes, *bends).first(), float)
        bend = ridge * np.eye(size)
        for (i, j), value in zip(pairs, sums[size:], strict=True):
            bend[i, j] += value
            bend[j, i] = bend[i, j]
        step = np.linalg.solve(bend, sums[:size] + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return np.round(w, 9)  # the order of the sums may differ from run to run


def train(docs: DataFrame, training: Column, calibration: Column, part_entries: int = PART_ENTRIES) -> Model | None:
    """A model of the rows of ``docs(doc_id, text, lang)`` where ``training`` holds.

    ``calibration`` marks the training rows that the calibrating model does not count; all of
    them are scored to calibrate.
    """
    known = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = written(count_ngrams(known.select("text", "lang", (~calibration).alias("fit"))), "gram-counts")
    both = F.array(*(F.struct(F.lit(name).alias("model"), F.col(n).alias("n")) for name, n in (("all", "n"), ("fit", "n_fit"))))
    tables = written(kneser_ney(counts.select("lang", "gram", F.explode(both).alias("c")).select("c.model", "lang", "gram", "c.n").where("n > 0")), "language-models")
    model, partial = (build_model(tables.where(F.col("model") == name), part_entries) for name in ("all", "fit"))
    if model is None or partial is None:
        return model
    # ``doc_id`` carries the language's number through the passes.
    number = F.array_position(F.array(*map(F.lit, partial.languages)), F.col("lang")) - 1
    rows = _summed(_unsummed(known.where(calibration).select(number.alias("doc_id"), "text")), partial)
    return calibrated(model, partial, written(rows.select("doc_id", "sums", "n").where("n > 1"), "calibration-sums"))


def calibrated(model: Model, partial: Model, rows: DataFrame) -> Model:
    """``model`` with the calibration that ``rows(doc_id, sums, n)``, scored by ``partial``, give; doc_id is the language's number.

    All rows count; what reaches the driver is one row for each language, and sums.
    """
    found = rows.select("doc_id", "n", F.transform("sums", lambda x: -x / F.col("n")).alias("entropy")).withColumn("lowest", F.array_min("entropy"))
    right = F.array_position("entropy", F.col("lowest")) - 1 == F.col("doc_id")
    own = lambda column: F.when(right, column)
    by_language = found.groupBy("doc_id").agg(
        F.sum(own(F.col("lowest") * F.col("n"))).alias("sum"), F.sum(own(F.col("n"))).alias("n"), F.max(own(F.col("lowest"))).alias("highest"), F.min("lowest").alias("lowest")
    )
    facts = by_language.collect()
    if not facts:
        return model
    highest = [r["highest"] for r in facts if r["highest"] is not None]
    every = max(highest) if highest else min(r["lowest"] for r in facts)  # for a language without such documents
    usual = np.full(len(partial.languages), every)
    for r in facts:
        if r["n"]:
            usual[r["doc_id"]] = round(r["sum"] / r["n"], 9)
    partial = replace(partial, usual=usual)
    rules = replace(partial, table=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            truth, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            n = n.astype(float)
            entropy = -np.array(batch.column(1).to_pylist()) / n[:, None]
            best, margin, _, excess = rules.judge(entropy, n)
            right = best == truth
            signs, target = [Model.signs(margin, n, excess)], [right.astype(float)]
            reach = [np.where(right, excess * np.sqrt(n), 0)]
            if len(usual) > 1:
                # As if the document's own language had no model.
                apart = entropy.copy()
                apart[np.arange(len(n)), np.maximum(truth, 0)] = np.inf
                best, ranked = apart.argmin(axis=1), np.sort(apart, axis=1)
                second = ranked[:, 1] if len(usual) > 2 else ranked[:, 0] + margin
                signs.append(Model.signs(second - ranked[:, 0], n, np.maximum(ranked[:, 0] - usual[best], 0)))
                target.append(np.zeros(len(n)))
                reach.append(np.zeros(len(n)))
            x = np.concatenate(signs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(np.concatenate(target)), pa.array(np.concatenate(reach))], names=["x", "y", "reach"])

    signs = written(rows.select("doc_id", "sums", "n").mapInArrow(run, "x array<double>, y double, reach double"), "calibration-signs")
    limit = 1.5 * signs.agg(F.max("reach")).first()[0] + 1
    named = dict(zip(partial.languages, usual, strict=True))
    return replace(model, usual=np.array([named.get(x, every) for x in model.languages]), weights=tuple(_logistic(signs, len(model.weights))), limit=limit)


def identify(docs: DataFrame, model: Model | None, reject_below: float = 0.5) -> DataFrame:
    """``(doc_id, lang_pred, score, entropy, accepted)`` of every row of ``docs(doc_id, text)``."""
    rows = _unsummed(docs)
    if model is not None:
        rows = _summed(rows, model)
    rules = None if model is None else replace(model, table=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = np.array(batch.column(4).to_pylist(), bool)  # null: no model
            size = batch.num_rows
            pred, score, entropy = np.full(size, "und", object), np.zeros(size), np.full(size, np.nan)
            at = np.flatnonzero(lettered) if rules is not None else np.zeros(0, np.int64)
            if len(at):
                n = batch.column(3).to_numpy(zero_copy_only=False)[at].astype(float)
                sums = np.array(batch.column(2).take(pa.array(at)).to_pylist())
                best, margin, lowest, excess = rules.judge(-sums / n[:, None], n)
                pred[at], entropy[at] = np.array(rules.languages, object)[best], lowest
                score[at] = rules.scores(margin, n, excess)
            columns = [batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(entropy), pa.array(lettered & (score >= reject_below))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "entropy", "accepted"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, accepted boolean")
