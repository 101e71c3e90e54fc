"""Quality rules: robust multivariate outliers.

Every text becomes a vector of transformed text statistics. For each (language, source) the minimum
covariance determinant (MCD) estimate of centre and scatter is found by concentration steps from
several deterministic starts until the determinants settle, and a text is rejected when its squared Mahalanobis
distance from the robust centre is beyond a cut-off.

A group's estimate is shrunk towards that of all rows with the weight of ``weight`` rows, so that a small group
is judged much as all are, a large one by itself, and none changes its judge at a certain size.

How it scales. The statistics are one pass over the texts and a few numbers a row. A concentration
step is two passes over that table, in Arrow batches, and an aggregation by (group, start) after each. The h-subset is
exact but for rows of nearly equal distance: rows are counted by group, start and distance in steps of a ten-thousandth
of its magnitude, and the subset ends with the step that reaches the h-th row; the second pass sums up what is in it.
Counts and sums are combined within a batch and again map-side, the join with the
models deals out groups that hold a large share of the rows, and no group is ever brought into one task. The
models have one row per group and start; of all rows as one group, the driver sends three along with the passes.

Defined cases. A null text counts as empty and has no words, so the base rule rejects it. Null
languages or sources form groups of their own. Rows at one distance are in the subset together. Repeated rows are
judged one by one. An empty table gives an empty result. Columns other than doc_id, text, lang and source are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .graph import spread_join

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
STATS_SCHEMA = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long, n_digits long"
_INTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits"]
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!?;:=\"'()[]{}/\\@_~^`+-"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that occur twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        key = h[:n].copy()
        for j in range(1, width):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    again = set()
    at = np.flatnonzero(hit).tolist()
    for i in at:  # equal hashes are compared word by word
        g = tuple(words[i : i + width])
        if g in seen:
            again.add(g)
        seen[g] = i
    cover = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if tuple(words[i : i + width]) in again:
            cover[i] += 1
            cover[i + width] -= 1
    return int((np.cumsum(cover)[:-1] > 0).sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines)), len(lines)


def text_stats(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(text.count, SPACES))
    dup, lines = duplicate_lines(text)
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words), lines, without(_UPPER), without(_MARKS), without(_DIGITS)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [text_stats(t.as_py()) for t in b.column("text")]
        cols = list(zip(*got, strict=True)) if got else [[] for _ in _INTS]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), b.column("lang").cast(pa.string()), b.column("source").cast(pa.string()), *(pa.array(c, pa.int64()) for c in cols)],
            names=["doc_id", "lang", "source", *_INTS],
        )


def statistics(docs: DataFrame) -> DataFrame:
    """One row of statistics per document, from its whole text."""
    return docs.select("doc_id", "text", "lang", "source").mapInArrow(_stats, STATS_SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def vector(prior: float = 40.0) -> list[Column]:
    """The transformed statistics. Rates are shrunk to their usual values with the weight of ``prior`` words, so that short texts don't stand out by chance."""
    n = F.col("n_words").cast("double")
    rate = lambda c, per, usual, weight: (F.col(c) + F.lit(float(usual * weight))) / (per + F.lit(float(weight)))
    root = lambda x: F.sqrt(x)  # noqa: E731  evens out the variance of a rate
    return [
        F.log(rate("word_chars", n, 5.5, prior)),
        root(rate("n_symbols", n, 0.0, prior)),
        root(rate("n_upper", n, 0.1, prior)),
        root(rate("n_marks", n, 0.0, prior)),
        root(rate("n_dup_lines", F.col("n_lines"), 0.0, 10.0)),
        root(rate("n_repeat_words", n, 0.0, prior)),
    ]


P = 6
#: Standard deviations under which differences of a coordinate don't count: texts of one source may all lack symbols or repeats.
FLOORS = (0.06, 0.12, 0.06, 0.12, 0.12, 0.12)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _solve(key: list[str], schema: str, h: float):
    """Moments to centre, inverse scatter and log determinant, a few rows at a time."""
    consistency = _consistency(h)

    def run(batches):
        for pdf in batches:
            centres, scatters, inverses, dets = [], [], [], []
            for row in pdf[["n", *(f"s{i}" for i in range(P)), *(f"q{i}_{j}" for i, j in _PAIRS)]].to_numpy(float):
                mu, cov = estimate(row[0], row[1 : 1 + P], row[1 + P :], consistency)
                centres.append(mu.tolist())
                scatters.append(cov[np.triu_indices(P)].tolist())
                inverses.append(np.linalg.inv(cov)[np.triu_indices(P)].tolist())
                dets.append(float(np.linalg.slogdet(cov)[1]))
            out = pdf[key].copy()
            out["n"], out["mu"], out["cov"], out["inv"], out["logdet"] = pdf["n"].astype(float), centres, scatters, inverses, dets
            yield out

    return run, f"{schema}, n double, mu array<double>, cov array<double>, inv array<double>, logdet double"


def estimate(n: float, s: np.ndarray, q: np.ndarray, consistency: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of moments."""
    mu = s / max(n, 1.0)
    cov = np.zeros((P, P))
    for (i, j), v in zip(_PAIRS, q, strict=True):
        cov[i, j] = cov[j, i] = v / max(n, 1.0) - mu[i] * mu[j]
    return mu, cov * consistency + np.diag(np.square(FLOORS))


def chi2_quantile(p: float, k: int) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3


def _consistency(h: float) -> float:
    """Makes the scatter of the closest fraction h that of the whole, for normal data."""
    if h >= 1:
        return 1.0
    q = chi2_quantile(h, P)
    x = np.linspace(0, q, 4001)
    mid = (x[1:] + x[:-1]) / 2
    density = mid ** ((P + 2) / 2 - 1) * np.exp(-mid / 2) / (2 ** ((P + 2) / 2) * math.gamma((P + 2) / 2))
    return h / float(density.sum() * (x[1] - x[0]))


def _distance() -> Column:
    """Squared Mahalanobis distance of x from mu under inv."""
    d = [F.col("x")[i] - F.col("mu")[i] for i in range(P)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(_PAIRS):
        total = total + d[i] * d[j] * F.col("inv")[k] * (1.0 if i == j else 2.0)
    return total


_SUMS = [f"s{i}" for i in range(P)] + [f"q{i}_{j}" for i, j in _PAIRS]


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    x = F.col("x")
    sums = [F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(P)), *(F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in _PAIRS)]
    return rows.groupBy(*by).agg(*sums)


#: The group of all rows.
ALL = ""


def _with_all(by_group: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums by group, and as group ALL their sums."""
    rest = [k for k in keys if k != "g"]
    total = by_group.groupBy(*rest).agg(*(F.sum(c).alias(c) for c in sums)).withColumn("g", F.lit(ALL))
    return by_group.select(*keys, *sums).unionByName(total.where(F.col(sums[0]) > 0).select(*keys, *sums))


#: Steps a distance is counted in, for each doubling.
FINE = 8192


#: Counts of rows and sums of their coordinates and of the products of these.
_MOMENT_SCHEMA = "g string, start int, n double, " + ", ".join(f"{c} double" for c in _SUMS)
_FIRST, _SECOND = (np.array(k) for k in zip(*_PAIRS, strict=True))
_TWICE = np.where(_FIRST == _SECOND, 1.0, 2.0)


def steps(x: np.ndarray, mu: np.ndarray, inv: np.ndarray) -> np.ndarray:
    """Steps of the distances of rows (n, P) from their models (n, k, P) under (n, k, pairs)."""
    away = x[:, None, :] - mu
    d2 = (away[:, :, _FIRST] * away[:, :, _SECOND] * inv * _TWICE).sum(-1)
    return np.floor(np.log2(np.maximum(d2, 0.0) + 1e-9) * FINE).astype(np.int64)


def _read(b: pa.RecordBatch, pooled: list) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """x, codes of groups, the groups, starts, steps and cuts of a batch: a column for each model of the row's group, then for each of all rows."""
    n = b.num_rows
    flat = lambda c, width: c.flatten().to_numpy(zero_copy_only=False).reshape(n, -1, width)
    x = flat(b.column("x"), P)[:, 0]
    own = b.column("models").flatten()
    part = lambda name: own.field(name)
    each = lambda name: np.broadcast_to(np.array([m[name] for m in pooled], float), (n, *np.shape([m[name] for m in pooled])))
    mu = np.concatenate([flat(part("mu"), P), each("mu")], 1)
    inv = np.concatenate([flat(part("inv"), len(_PAIRS)), each("inv")], 1)
    one = lambda name: np.concatenate([part(name).to_numpy(zero_copy_only=False).reshape(n, -1), each(name).astype(np.int64)], 1)
    groups = b.column("g").dictionary_encode()
    return x, groups.indices.to_numpy(), groups.dictionary.to_pylist(), one("start"), steps(x, mu, inv), one("cut")


def _counted(pooled: list):
    """Rows by group, start and step of distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            _, code, names, start, step, _ = _read(b, pooled)
            of_all = start.shape[1] - len(pooled)
            for k in range(start.shape[1]):
                group = code.astype(np.int64) if k < of_all else np.full(len(code), len(names), np.int64)
                # A column holds one start, as models are listed in their order and those that stay are start 0.
                keys, count = np.unique((group << 32) + (step[:, k] + (1 << 31)), return_counts=True)
                named = pa.DictionaryArray.from_arrays(pa.array(keys >> 32, pa.int64()), pa.array([*names, ALL])).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [named, pa.array(np.full(len(keys), start[0, k]), pa.int32()), pa.array((keys & 0xFFFFFFFF) - (1 << 31), pa.int64()), pa.array(count, pa.int64())],
                    names=["g", "start", "step", "rows"],
                )

    return run


def _summed(pooled: list):
    """Moments by group and start of the rows that are not beyond the cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, code, names, start, step, cut = _read(b, pooled)
            of_all = start.shape[1] - len(pooled)
            inside = step <= cut
            order = np.argsort(code, kind="stable")
            begins = np.flatnonzero(np.diff(code[order], prepend=-1))
            moments = np.concatenate([np.ones((len(x), 1)), x, x[:, _FIRST] * x[:, _SECOND]], 1)[order]
            for k in range(start.shape[1]):
                kept = moments * inside[order, k, None]
                got = np.add.reduceat(kept, begins, 0) if k < of_all else kept.sum(0, keepdims=True)
                named = pa.array([names[c] for c in code[order][begins]] if k < of_all else [ALL], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [named, pa.array(np.full(len(got), start[0, k]), pa.int32()), *(pa.array(c) for c in got.T)], names=["g", "start", "n", *_SUMS]
                )

    return run


def _near(rows: DataFrame, models: DataFrame, total: int) -> DataFrame:
    """(g, x, models) of rows (g, tie, x): each with the models of its group, by start."""
    own = models.where(F.col("g") != ALL).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("start", "mu", "inv", "cut"))).alias("models"), F.max("size").alias("n"))
    return spread_join(rows, own, "g", F.xxhash64("tie"), total=total).select("g", "x", "models")


def _pooled(models: DataFrame) -> list[dict]:
    """The models of all rows, one for each start."""
    return [r.asDict() for r in models.where(F.col("g") == ALL).select("start", "mu", "inv", "cut").orderBy("start").collect()]


def _cuts(rows: DataFrame, models: DataFrame, total: int, part: float) -> DataFrame:
    """models with their cut: the step with which a part of a group's rows is reached."""
    counted = _near(rows, models, total).mapInArrow(_counted(_pooled(models)), "g string, start int, step long, rows long")
    counts = counted.groupBy("g", "start", "step").agg(F.sum("rows").alias("rows"))
    by = Window.partitionBy("g", "start")
    upto = counts.select("g", "start", "step", F.sum("rows").over(by.orderBy("step")).alias("upto"), F.sum("rows").over(by).alias("of"))
    cut = upto.where(F.col("upto") >= F.ceil(F.col("of") * F.lit(part))).groupBy("g", "start").agg(F.min("step").alias("cut"))
    return models.drop("cut").join(cut, ["g", "start"])


def _concentrated(rows: DataFrame, models: DataFrame, total: int) -> DataFrame:
    """(g, start, moments) of the rows within the cut of their models."""
    summed = _near(rows, models, total).mapInArrow(_summed(_pooled(models)), _MOMENT_SCHEMA)
    return summed.groupBy("g", "start").agg(*(F.sum(c).alias(c) for c in ("n", *_SUMS)))


def mcd(rows: DataFrame, h: float = 0.75, most_steps: int = 12, settled: float = 1e-3) -> DataFrame:
    """MCD models of rows (g string, tie long, x array<double>): one row (g, size, mu, cov, inv) per group. Group '' holds all rows.

    Starts, each deterministic: coordinatewise median and quartile distance; the moments of all rows; and the
    scatter of the directions from the median. The first concentration step keeps the closest half, the others the
    closest h. After three steps the model of the smallest determinant stays for each group, and goes on until no
    log determinant changes by more than ``settled``.
    """
    x = F.col("x")
    thirds = lambda r: r.agg(F.count(F.lit(1)).alias("size"), *(F.percentile_approx(x[i], [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i in range(P)))
    quart = written(thirds(rows.groupBy("g")).unionByName(thirds(rows).where("size > 0").withColumn("g", F.lit(ALL))), "quartiles")
    mids = quart.select("g", "size", F.array(*(F.col(f"p{i}")[1] for i in range(P))).alias("mu"), F.array(*(F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, 2) + F.lit(FLOORS[i] ** 2) for i in range(P))).alias("var"))
    total = quart.where(F.col("g") == ALL).agg(F.sum("size")).first()[0] or 0
    sizes = mids.select("g", "size")
    diagonal = F.array(*(F.lit(1.0) / F.col("var")[i] if i == j else F.lit(0.0) for i, j in _PAIRS))
    medians = mids.select("g", F.lit(0).alias("start"), "mu", diagonal.alias("inv"))
    run, schema = _solve(["g", "start"], "g string, start int", 1.0)
    everything = _with_all(_moments(rows, ["g"]), ["g"], ["n", *_SUMS]).withColumn("start", F.lit(1))
    # Directions in units of the quartile distance, at unit length, brought back to the median and to scale.
    unit = F.array(*((x[i] - F.col("mu")[i]) / F.sqrt(F.col("var")[i]) for i in range(P)))
    size = F.sqrt(F.aggregate("u", F.lit(1e-12), lambda a, v: a + v * v) / F.lit(float(P)))
    back = F.array(*(F.col("mu")[i] + F.col("u")[i] / size * F.sqrt(F.col("var")[i]) for i in range(P)))
    turned = spread_join(rows, mids.where(F.col("g") != ALL).withColumn("n", F.col("size")), "g", F.xxhash64("tie"), total=total).withColumn("u", unit).select("g", back.alias("x"))
    directions = _with_all(_moments(turned, ["g"]), ["g"], ["n", *_SUMS]).withColumn("start", F.lit(2))
    solved = everything.unionByName(directions).mapInPandas(run, schema).select("g", "start", "mu", "inv")
    fresh = {"cut": F.lit(0).cast("long"), "logdet": F.lit(None).cast("double")}
    models = written(medians.unionByName(solved).join(sizes, "g").withColumns(fresh), "models")
    run, schema = _solve(["g", "start"], "g string, start int", h)
    for step in range(most_steps if total else 0):
        within = written(_cuts(rows, models, total, 0.5 if step == 0 else h), "cuts")
        last = within.select("g", "start", "size", F.col("logdet").alias("was"))
        models = _concentrated(rows, within, total).mapInPandas(run, schema).join(last, ["g", "start"]).withColumn("cut", fresh["cut"])
        if step == 2:
            models = models.groupBy("g").agg(F.min_by(F.struct(*models.columns), F.struct("logdet", "start")).alias("m")).select("m.*").withColumn("start", F.lit(0))
        models = written(models, "models")
        if step > 2:
            moved = models.agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
            if moved is None or moved <= settled:
                break
    if not total:
        return models.select("g", "size", "mu", F.col("inv").alias("cov"), "inv")
    return models.groupBy("g").agg(F.min_by(F.struct("size", "mu", "cov", "inv"), F.struct("logdet", "start")).alias("m")).select("g", "m.*")


def _shrunk(models: DataFrame, pooled, weight: float) -> DataFrame:
    """(g, mu, inv, n): each group's estimate with that of all rows as so many rows more."""
    centre, scatter = np.array(pooled.mu), np.zeros((P, P))
    for (i, j), v in zip(_PAIRS, pooled["cov"], strict=True):
        scatter[i, j] = scatter[j, i] = v

    def run(batches):
        for pdf in batches:
            mus, inverses = [], []
            for size, mu, cov in zip(pdf["size"], pdf["mu"], pdf["cov"], strict=True):
                own = np.zeros((P, P))
                for (i, j), v in zip(_PAIRS, cov, strict=True):
                    own[i, j] = own[j, i] = v
                mu, both = shrink(float(size), np.array(mu), own, centre, scatter, weight)
                mus.append(mu.tolist())
                inverses.append(np.linalg.inv(both)[np.triu_indices(P)].tolist())
            out = pdf[["g"]].copy()
            out["mu"], out["inv"], out["n"] = mus, inverses, pdf["size"].astype("int64")
            yield out

    return models.mapInPandas(run, "g string, mu array<double>, inv array<double>, n long")


def shrink(size: float, mu: np.ndarray, cov: np.ndarray, centre: np.ndarray, scatter: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    part = size / (size + weight)
    away = mu - centre
    # What the centres differ by counts as scatter while neither is sure.
    return part * mu + (1 - part) * centre, part * cov + (1 - part) * scatter + part * (1 - part) * np.outer(away, away)


def robust_outliers(stats: DataFrame, h: float = 0.75, cutoff: float = 0.9999, weight: float = 60.0, most_steps: int = 12) -> DataFrame:
    """stats with base_failed, distance2 (null where the base rules fail) and kept: a chi-square quantile is the cut-off."""
    group = F.to_json(F.struct(F.coalesce("lang", F.lit("")).alias("l"), F.coalesce("source", F.lit("")).alias("s"), F.col("lang").isNull().alias("ln"), F.col("source").isNull().alias("sn")))
    marked = stats.withColumn("base_failed", base_failed()).withColumn("g", group).withColumn("tie", F.monotonically_increasing_id()).withColumn("x", F.array(*vector()))
    marked = written(marked, "marked")
    rows = marked.where(~F.col("base_failed")).select("g", "tie", "x")
    models = written(mcd(rows, h, most_steps), "mcd")
    pooled = models.where(F.col("g") == ALL).first()  # one row
    limit = chi2_quantile(cutoff, P)
    if pooled is None:  # no row passes the base rules
        return marked.withColumn("distance2", F.lit(None).cast("double")).withColumn("kept", F.lit(False)).drop("g", "tie", "x")
    own = written(_shrunk(models.where(F.col("g") != ALL), pooled, weight), "shrunk")
    judged = spread_join(marked, own, "g", F.xxhash64("tie"), "left").withColumn("distance2", F.when(~F.col("base_failed"), _distance()))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= limit, F.lit(True))).drop("g", "tie", "x", "mu", "inv")


def quality_rules(docs: DataFrame, **how) -> DataFrame:
    """Statistics, the base verdict and the robust verdict of every document."""
    return robust_outliers(statistics(docs), **how)


def op10_quality(spark, sf_dir):
    from .common import table

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
