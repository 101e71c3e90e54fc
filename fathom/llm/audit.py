"""Audit of how filters interact: every order of them, visited by swaps of neighbours.

Each document's failures are a mask of bits, and the documents of a part are counted by mask (the cells).
An order's step removes what fails its filter and no earlier one. Orders are visited so that each
differs from the last by one swap of neighbours; a swap changes nothing but its two steps, which
are counted anew from the cells. What a filter removes is added up along the walk, its Shapley sum.

How it scales. Rows are reduced to a text's digest and mask without a Python worker. Equal rows are
combined before anything is joined, so that a text or id that a third of all rows have is one row a task; labels are joined by
id, and repeats found by the least id of each digest. A part has two to the number of filters cells at most, and one task
writes its orders; all parts together are never in one place.

Defined cases. A null text is an empty one; equal texts have equal SHA-256 digests. A null doc_id is neither smaller nor
larger than another and has no label. Labels of one id are combined: good or toxic if one row says so. Null languages
and empty ones are one part. Repeated rows count each; rows of one id and text don't repeat each other. An empty table gives an empty
result. Columns other than doc_id, text, lang and the labels are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at one text, A the lowest: words, distinct words, capitals, symbols."""

    def of(words: Column) -> Column:
        n = F.size(words)
        fails = (n < 200, 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"), 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.char_length(text).cast("long"), F.rlike(text, F.lit("[#$%&*|]")))
        return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))

    return let(F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != ""), of)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, cells): of each mask that occurs in a part, its documents, the good ones and the toxic ones."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    rows = rows.join(known, "doc_id", "left").select("doc_id", "part", "mask", "digest", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    has_id = F.col("doc_id").isNotNull()
    alike = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(has_id, F.col("n")).otherwise(F.lit(0))).alias("with_id"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    repeats = F.col("with_id") - F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(F.lit(0))
    split = alike.select("part", "mask", "good", "toxic", "n", F.coalesce(repeats, F.lit(0)).alias("r"))
    both = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("r")).alias("n")), F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), F.col("r").alias("n")))
    counted = split.select("part", "good", "toxic", F.inline(both)).groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0))).alias(c) for c in ("good", "toxic")))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def walk(n: int) -> Iterator[int]:
    """Places k of the swaps of k and k + 1 that lead from 0, 1, .. through every other order of n things once."""
    if n < 2:
        return
    inner, down = walk(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        k = next(inner, None)
        if k is None:
            return
        yield k + 1 if down else k
        down = not down


def orders(counts: np.ndarray, filters: str = FILTERS) -> dict[str, list]:
    """Every order's steps from the cells' counts, three (documents, good, toxic) for each mask."""
    f = len(filters)
    masks = np.arange(1 << f)
    order = list(range(f))

    def step(k: int) -> np.ndarray:
        before = sum(1 << g for g in order[:k])
        return counts[(masks & before == 0) & (masks >> order[k] & 1 == 1)].sum(0)

    failing = [int(counts[masks >> g & 1 == 1, 0].sum()) for g in range(f)]
    only = [int(counts[1 << g, 0]) for g in range(f)]
    total, steps, shapley = int(counts[:, 0].sum()), [step(k) for k in range(f)], [0] * f
    out: dict[str, list] = {c: [] for c in ("filter_order", "step", *COUNTS)}
    visited = []

    def visit() -> None:
        kept = total
        for k, (g, (n, good, toxic)) in enumerate(zip(order, steps, strict=True)):
            kept -= int(n)
            shapley[g] += int(n)
            visited.append(g)
            row = ("".join(filters[x] for x in order), k + 1, kept, int(n), failing[g] - int(n), only[g], int(good), int(toxic))
            for c, x in zip(out, row, strict=False):
                out[c].append(x)

    visit()
    for k in walk(f):
        order[k], order[k + 1] = order[k + 1], order[k]
        steps[k : k + 2] = step(k), step(k + 1)
        visit()
    out["shapley"] = [shapley[g] for g in visited]
    return out


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, found in zip(b.column("part").to_pylist(), b.column("cells").to_pylist(), strict=True):
            counts = np.zeros((1 << len(FILTERS), 3), np.int64)
            for c in found:
                counts[c["mask"]] = c["n"], c["good"], c["toxic"]
            rows = orders(counts)
            columns = [pa.array([part] * len(rows["step"]), pa.string()), pa.array(rows["filter_order"], pa.string()), pa.array(rows["step"], pa.int32()), *(pa.array(rows[c], pa.int64()) for c in COUNTS)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *COUNTS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step."""
    return cells(docs, labels).mapInArrow(_walked, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def op12_filter_audit(spark, sf_dir):
    from .common import table

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _in_duckdb() -> str:
    letters = " CROSS JOIN ".join(f"(VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)) p{k}(l{k}, b{k})" for k in range(1, 6))
    apart = " AND ".join(f"l{i} <> l{j}" for i in range(1, 6) for j in range(i + 1, 6))
    steps = " UNION ALL ".join(f"SELECT {'||'.join(f'l{i}' for i in range(1, 6))} AS filter_order, {k} AS step, b{k} AS f, {' + '.join(f'(1 << b{i})' for i in range(1, k)) or '0'} AS before FROM orders" for k in range(1, 6))
    return rf"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents),
masks AS (SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM words),
known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks LEFT JOIN known USING (doc_id) GROUP BY part, mask),
orders AS (SELECT * FROM {letters} WHERE {apart}),
steps AS ({steps}),
counted AS (SELECT part, filter_order, step, f, sum(n) AS total, sum(CASE WHEN mask & (before | (1 << f)) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & (1 << f) > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before > 0 AND mask & (1 << f) > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = 1 << f THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & (1 << f) > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & (1 << f) > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells CROSS JOIN steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted
"""


SQL = {"op12_filter_audit": _in_duckdb()}
