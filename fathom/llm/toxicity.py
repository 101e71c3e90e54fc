"""Toxicity by class-conditional Kneser-Ney models.

Two models of how words are spelt, one of toxic and one of ordinary texts, are learnt from labelled
documents. A word's probability is the product, from its first character on, of the probabilities of
each character after the word's beginning so far (and at last of the word's end). Each is an absolutely
discounted class count, interpolated with a backoff that both classes share: in how many different words
of either class the character follows that beginning, discounted in turn and interpolated with the Kneser-Ney
continuation probability of the character after the last ``LOWER`` characters, that is in how many different
beginnings it follows them. So an expression never seen before is judged by the longest
beginning that was seen, and where neither class has seen anything both models agree.

A text's log-likelihoods under both models are compared by their difference a word: over the whole text,
over its most toxic window of words, and by what words exceed a margin by, against the root of the length. A logistic curve,
fitted on labelled rows that the counts leave out, turns the three into a score.

How it scales. Word counts by class are combined map-side; beginnings are counted from the vocabulary,
not from the running text. The model grows with the labelled input and stays distributed. Beginnings
of which each class has one text at most differ in nothing from beginnings never seen (a count of one is
discounted whole) and are left out, which changes no score. What remains is cut by the words' first two characters into
parts of at most ``part_nodes`` beginnings (16 bytes each) on average; a task holds a part for each step, a word is in
one part, and one pass of the texts through as many steps as parts does it, without a shuffle and with the same result. Labels are broadcast only up to ``small_labels`` rows; beyond, the
labelled texts are shuffled by doc_id. ``most_fit`` bounds the rows that the logistic curve is fitted on: as many
are held back from the counts, a fifth of the labelled rows at most.

Defined cases. Null and empty texts have differences of 0 and the score of such a text. A doc_id that
is labelled more than once is toxic if one label says so; null labels are not used. Without labelled
rows of both classes to fit the curve on every score is the share of toxic labels, or 0. Repeated rows are scored each. An
empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from .common import written
from .licenses import words_of

#: What is taken off counts of 1, 2, and 3 or more: a word of a single text is no evidence of its class.
DISCOUNTS = (1.0, 1.3, 1.6)
#: What is taken off the number of different words in the shared backoff.
TYPE_DISCOUNT = 0.1
#: Characters of the longest beginning, the models' order; the whole word follows it.
DEPTH = 10
#: Characters of the history that both classes share.
LOWER = 3
END = "\n"
PART_NODES = 1 << 21


def _remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def held_out() -> Column:
    return F.coalesce(_remainder() % 3 == 1, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, small_labels: int) -> tuple[DataFrame, int]:
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(~held_out())
    rows = known.count()
    if rows <= small_labels:
        known = F.broadcast(known)
    return docs.select("doc_id", "text").join(known, "doc_id"), rows


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            b = batch.slice(k, 2000)
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(set(words_of(text.as_py())))  # a text that repeats a word is no more evidence
            words = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], names=["word", "ordinary", "toxic"])


def spelling_model(labelled: DataFrame, depth: int = DEPTH, lower: int = LOWER) -> DataFrame:
    """Rows (node, begin, delta, escape) from rows (text, toxic).

    ``delta`` is the difference of log-likelihood of a beginning given the one before, ``escape`` that of anything
    unseen after it; ``begin`` has the first two characters. The root, '', has only an escape. Beginnings that
    are no evidence are left out.
    """
    vocabulary = written(labelled.select("text", "toxic").mapInArrow(_word_counts, "word string, ordinary long, toxic long").groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "vocabulary")
    begin = lambda n: F.substr("word", F.lit(1), n)
    chain = F.transform(F.sequence(F.lit(1), F.least(F.lit(depth), F.length("word"))), lambda n: F.struct(begin(n).alias("node"), begin(n - 1).alias("parent")))
    end = F.array(F.struct(F.concat("word", F.lit(END)).alias("node"), begin(F.lit(depth)).alias("parent")))
    steps = vocabulary.where("word != ''").select(F.explode(F.concat(chain, end)).alias("s"), "ordinary", "toxic").select("s.*", "ordinary", "toxic")
    nodes = steps.groupBy("node", "parent").agg(F.sum("ordinary").alias("o"), F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("words"))
    # The last characters of the history, and with what follows: the rest of the word behind a longest beginning.
    history = F.when(F.length("parent") > lower, F.substr("parent", F.length("parent") - (lower - 1), F.lit(lower))).otherwise(F.col("parent"))
    nodes = written(nodes.select("*", history.alias("history"), F.substr("node", F.length("parent") + 1, F.length("node")).alias("next")), "nodes")
    # In how many beginnings something follows a history.
    follows = nodes.groupBy("history", "next").agg(F.count(F.lit(1)).alias("types"))
    histories = nodes.groupBy("history").agg(F.count(F.lit(1)).alias("all_types"))
    off = lambda c: F.least(F.col(c).cast("double"), F.when(F.col(c) <= 1, F.lit(DISCOUNTS[0])).when(F.col(c) == 2, F.lit(DISCOUNTS[1])).otherwise(F.lit(DISCOUNTS[2])))
    parents = nodes.groupBy("parent").agg(F.sum("o").alias("po"), F.sum("t").alias("pt"), F.sum(off("o")).alias("fo"), F.sum(off("t")).alias("ft"), F.sum("words").alias("all_words"), F.count(F.lit(1)).alias("nexts"))
    # Both classes' different words, discounted, and what that frees by the shorter history.
    shared = (F.col("words") - F.lit(TYPE_DISCOUNT) + F.lit(TYPE_DISCOUNT) * F.col("nexts") * F.col("types") / F.col("all_types")) / F.col("all_words")

    def p(c: str, total: str, freed: str) -> Column:
        return F.when(F.col(total) > 0, (F.col(c) - off(c) + F.col(freed) * shared) / F.col(total)).otherwise(shared)

    unseen = lambda total, freed: F.when(F.col(total) > 0, F.col(freed) / F.col(total)).otherwise(F.lit(1.0))
    seen = nodes.where("o > 1 or t > 1").join(parents, "parent").join(follows, ["history", "next"]).join(histories, "history")
    scored = seen.select("node", F.log(p("t", "pt", "ft") / p("o", "po", "fo")).alias("delta"))
    escapes = parents.where("po > 1 or pt > 1").select(F.col("parent").alias("node"), F.log(unseen("pt", "ft") / unseen("po", "fo")).alias("escape"))
    both = scored.join(escapes, "node", "full").select("node", F.substr("node", F.lit(1), F.lit(2)).alias("begin"), *(F.coalesce(c, F.lit(0.0)).cast("float").alias(c) for c in ("delta", "escape")))
    return written(both, "model")


def part_of(begin: Column | str, parts: int) -> Column:
    return F.pmod(F.xxhash64(begin), F.lit(parts)).cast("int")


def part_of_word(word: str, parts: int) -> int:
    h = xxhash.xxh64_intdigest(word[:2].encode(), 42)
    return (h - 2**64 if h >= 2**63 else h) % parts


@dataclass
class Part:
    """One of ``parts`` parts of a model: sorted hashes of beginnings, with their differences."""

    number: int
    parts: int
    keys: np.ndarray
    delta: np.ndarray
    escape: np.ndarray


def model_parts(model: DataFrame, part_nodes: int = PART_NODES) -> Iterator[Part]:
    """The model in parts; beginnings of less than two characters are in each of them."""
    parts = -(-model.count() // part_nodes) or 1
    for k in range(parts):
        rows = model.where((part_of("begin", parts) == k) | (F.length("begin") < 2)).select(F.xxhash64("node").alias("key"), "delta", "escape").toArrow()
        keys = rows.column("key").to_numpy()
        order = np.argsort(keys)
        yield Part(k, parts, keys[order], rows.column("delta").to_numpy()[order], rows.column("escape").to_numpy()[order])


class Speller:
    """Differences of log-likelihood of words by a part of a model; None for words of other parts."""

    def __init__(self, part: Part, depth: int = DEPTH, cache: int = 200_000) -> None:
        self.part, self.depth, self.limit = part, depth, cache
        self.known: dict[bytes, float] = {}
        self.begun: dict[str, tuple[float, float, bool]] = {}
        root = self._find("")
        self.begun[""] = (0.0, root[1] if root else 0.0, True)
        self.root = self.begun[""]

    def _find(self, piece: str) -> tuple[float, float] | None:
        h = xxhash.xxh64_intdigest(piece.encode(), 42)
        h = h - 2**64 if h >= 2**63 else h
        at = int(self.part.keys.searchsorted(h))
        return (float(self.part.delta[at]), float(self.part.escape[at])) if at < len(self.part.keys) and self.part.keys[at] == h else None

    def _begin(self, piece: str) -> tuple[float, float, bool]:
        """Sum of the differences up to and with a beginning; the escape behind it; whether it was seen."""
        got = self.begun.get(piece)
        if got is None:
            total, escape, seen = self._begin(piece[:-1])
            found = self._find(piece) if seen else None
            got = (total + found[0], found[1], True) if found else (total + escape, 0.0, False)
            self.begun[piece] = got
        return got

    def difference(self, word: bytes) -> float:
        text = word.decode()
        if self.part.parts > 1 and part_of_word(text, self.part.parts) != self.part.number:
            return 0.0
        total, escape, seen = self._begin(text[: self.depth])
        if seen:
            found = self._find(text + END)
            total += found[0] if found else escape
        return total

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        if len(self.begun) > self.limit:
            self.begun = {"": self.root}
        for w in set(words).difference(self.known):
            self.known[w] = self.difference(w)
        return np.fromiter(map(self.known.__getitem__, words), float, len(words))


WINDOW = 2
FEATURES = 3


def features(differences: np.ndarray, margin: float = 2.5) -> list[float]:
    """Differences of log-likelihood normalised by length: a word's mean over the whole text; over the most toxic window; and what words exceed the margin by, against the root of the length, as chance excess grows with it."""
    n = len(differences)
    if not n:
        return [0.0] * FEATURES
    sums = np.concatenate([[0.0], np.cumsum(np.clip(differences, -1.0, 6.0))])
    size = min(WINDOW, n)
    excess = np.maximum(np.minimum(differences, 8.0) - margin, 0).sum() / np.sqrt(n + 20)
    return [float(np.clip(differences, -0.5, 6.0).mean()), float((sums[size:] - sums[:-size]).max()) / WINDOW, float(np.log1p(10 * excess))]


def _featured(docs: DataFrame, parts: list, keep: list[str]) -> DataFrame:
    """The kept columns and __x0, __x1, ...: the texts go through one step for each part of the model, and between steps with the words' differences so far."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    for number, part in enumerate(parts):
        last = number == len(parts) - 1
        names = [*keep, *(f"__x{i}" for i in range(FEATURES))] if last else [*keep, *([] if "text" in keep else ["text"]), "__so_far"]

        def run(batches: Iterator[pa.RecordBatch], part=part, names=names, number=number, last=last) -> Iterator[pa.RecordBatch]:
            speller = Speller(part.value)
            for b in batches:
                x, so_far = np.zeros((b.num_rows if last else 0, FEATURES)), []
                for k, text in enumerate(b.column("text")):
                    found = speller.of(words_of(text.as_py()))
                    if number:
                        found = found + np.frombuffer(b.column("__so_far")[k].as_py(), float)
                    if last:
                        x[k] = features(found)
                    else:
                        so_far.append(found.tobytes())
                new = {f"__x{i}": pa.array(x[:, i]) for i in range(FEATURES)} if last else {"__so_far": pa.array(so_far, pa.binary())}
                yield pa.RecordBatch.from_arrays([new[n] if n in new else b.column(n) for n in names], names=names)

        docs = docs.mapInArrow(run, StructType([StructField(n, kinds.get(n, BinaryType() if n == "__so_far" else DoubleType())) for n in names]))
    return docs


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, positive: float = 2.0) -> np.ndarray:
    """Weights (the last for the constant) by Newton's steps; rows of the rarer, positive label count ``positive`` times."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    share = np.where(y > 0, positive, 1.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (share * p * (1 - p))[:, None]) + penalty, a.T @ (share * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _features_of(b) -> np.ndarray:
    return np.column_stack([b.column(f"__x{i}").to_numpy() for i in range(FEATURES)])


def _fitted(docs: DataFrame, labels: DataFrame, most_fit: int, small_labels: int, part_nodes: int):
    """The broadcast parts of the model and the logistic weights."""
    spark = docs.sparkSession
    labelled, rows = _labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels.select("doc_id", "toxic"), small_labels)
    of_million = int(1e6 * min(0.2, most_fit / max(1, rows)))
    kept_back = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < of_million
    model = spelling_model(labelled.where(~kept_back))
    parts = [spark.sparkContext.broadcast(p) for p in model_parts(model, part_nodes)]
    chosen = labelled.where(kept_back).select("doc_id", F.col("toxic").cast("long").alias("toxic"), "text")
    fit = _featured(chosen, parts, ["doc_id", "toxic"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_fit).toArrow()
    x, y = _features_of(fit), fit.column("toxic").to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        return parts, fit_logistic(x, y)
    share = float(np.clip(labelled.agg(F.avg("toxic")).first()[0] or 0.0, 1e-9, 1 - 1e-9))  # of all labelled rows, not of the few held back
    return parts, np.array([0.0] * FEATURES + [np.log(share / (1 - share))])


def _score(weights: np.ndarray) -> Column:
    """The logistic curve over __x0, __x1, ..."""
    total = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        total = total + F.lit(float(w)) * F.col(f"__x{i}")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(total, F.lit(700.0)), F.lit(-700.0))))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_fit: int = 20_000, small_labels: int = 1_000_000, part_nodes: int = PART_NODES) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    parts, weights = _fitted(docs, labels, most_fit, small_labels, part_nodes)
    scored = _featured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), parts, ["doc_id"]).select("doc_id", _score(weights).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_fit: int = 20_000, small_labels: int = 1_000_000, part_nodes: int = PART_NODES) -> DataFrame:
    """docs without those of a score of ``threshold`` or more."""
    parts, weights = _fitted(docs, labels, most_fit, small_labels, part_nodes)
    rows = docs.select(F.struct("*").alias("doc"), "text")  # columns may have any names
    return _featured(rows, parts, ["doc"]).where(_score(weights) < threshold).select("doc.*")


def op2_toxicity(spark, sf_dir):
    from .common import table

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
