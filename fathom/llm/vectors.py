"""Compression of vectors to codes, with VA-file filtering of the codebooks' entries.

Vectors are cut into equal consecutive parts, and each part becomes the number of the nearest entry of its
position's codebook. The coordinates of a codebook's entries are quantised to cells of ``bits`` bits. For
every part that is looked up, tables hold the least and the greatest squared difference to each cell of each
coordinate; their sums over an entry's cells bound its distance from below and above. Only entries whose lower bound does not
exceed the least upper bound are refined with distances in integers, so that results are exact. Codebooks
begin as the parts of the ``entries`` vectors of the smallest ids; a round moves each entry to the rounded-down mean of
its parts.

How it scales. A round is one pass without a shuffle of vectors: a task adds up the parts of its rows by
entry, and what is shuffled is that table (one row an entry and position) for each task, combined map-side. Codebooks
are of a fixed size and go with the tasks. The errors are added up by label, with labels that many rows share dealt out, and joined to the codes, which are written once.

Defined cases. Rows whose vector is null or holds a null, infinite or NaN component are dropped. Vectors
shorter than the longest one, or than the next multiple of the number of parts, count as filled up with
zeros. Ids may repeat or be null: equal ids are ordered by their vectors, nulls come last. Equal distances go to the smaller
number. Entries without a part stay. With fewer vectors than entries there are as many entries. Distances are exact at any magnitude; an error or a
sum beyond a long is the greatest long. Null labels are one label. An empty table gives an empty result. Columns other than those asked for are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables
from .graph import spread_join

PARTS, ENTRIES, ROUNDS, BITS = 16, 64, 2, 4
#: Magnitudes up to which squares and their sums over a part stay within 64 bits.
SMALL = 1 << 28
MOST_LONG = 2**63 - 1
#: Sums of a task below this are added up as decimals, others one by one.
FITS = 10**28
BATCH = 4096


def integers(b: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows of floor(256 * x), filled up to ``width``; Python's integers where 64 bits might not do."""
    v = b.column("v")
    flat = np.floor(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256.0)
    sizes = np.diff(v.offsets.to_numpy())
    small = not len(flat) or np.abs(flat).max() < SMALL
    out = np.zeros((len(sizes), width), np.int64 if small else object)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat.astype(np.int64) if small else [int(x) for x in flat]
    return out


@dataclass
class Cells:
    """A codebook's entries with the cells of their coordinates: bounds by coordinate and cell, and each entry's cells."""

    entries: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cell: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, bits: int = BITS) -> Cells:
        n, k = entries.shape[1], 1 << bits
        first, size = entries.min(0), entries.max(0) - entries.min(0) + 1
        marks = first[:, None] + size[:, None] * np.arange(k + 1)[None, :] // k
        cell = np.array([np.searchsorted(marks[j], entries[:, j], "right") - 1 for j in range(n)], np.int64).reshape(n, len(entries))
        return cls(entries, marks[:, :-1], marks[:, 1:] - 1, cell)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest entry of each row."""
        rows, width = parts.shape
        lower = np.zeros((rows, len(self.entries)), parts.dtype)
        upper = np.zeros_like(lower)
        for j in range(width):
            x = parts[:, j, None]
            below, above = self.low[j] - x, x - self.high[j]
            inside = np.maximum(np.maximum(below, above), 0)
            beyond = np.maximum(np.abs(below), np.abs(above))
            lower += (inside * inside)[:, self.cell[j]]
            upper += (beyond * beyond)[:, self.cell[j]]
        row, entry = np.nonzero(lower <= upper.min(1)[:, None])
        off = parts[row] - self.entries[entry]
        distance = (off * off).sum(1) if width else np.zeros(len(row), np.int64)
        starts = np.searchsorted(row, np.arange(rows))
        least = np.minimum.reduceat(distance, starts) if rows else distance
        hit = np.flatnonzero(distance == np.repeat(least, np.diff(np.append(starts, len(row)))))
        return entry[hit[np.searchsorted(row[hit], np.arange(rows))]], least


def _books(book: list, dtype: type) -> list[Cells]:
    return [Cells.of(np.array(p, dtype).reshape(len(p), len(p[0]))) for p in book]


class Coder:
    """Codes batches of vectors by one state of the codebooks."""

    def __init__(self, book: list) -> None:
        self.book, self.width = book, len(book) * len(book[0][0])
        big = any(abs(x) >= SMALL for p in book for e in p for x in e)
        self.exact = _books(book, object)
        self.fast = None if big else _books(book, np.int64)

    def parts(self, b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each part position: its number, the parts, their entries and distances."""
        v = integers(b, self.width)
        if self.fast is None:
            v = v.astype(object)
        books = self.exact if v.dtype == object else self.fast
        w = self.width // len(books)
        for p, cells in enumerate(books):
            x = v[:, p * w : (p + 1) * w]
            yield p, x, *cells.nearest(x)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, BATCH):
            yield b.slice(k, BATCH)


def moved(rows: DataFrame, book: list) -> list:
    """The codebooks after a round."""
    parts, entries, w = len(book), len(book[0]), len(book[0][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, n, total = Coder(book), np.zeros((parts, entries), np.int64), np.zeros((parts, entries, w), object)
        for b in _sliced(batches):
            for p, x, entry, _ in coder.parts(b):
                n[p] += np.bincount(entry, minlength=entries)
                for j in range(w):
                    sums = np.zeros(entries, x.dtype)
                    np.add.at(sums, entry, x[:, j])
                    total[p, :, j] += sums
        for p, e in zip(*np.nonzero(n), strict=True):
            sums = [int(t) for t in total[p, e]]
            fits = [abs(t) < FITS for t in sums]
            yield pa.RecordBatch.from_pydict(
                {"p": pa.array([p] * w, pa.int32()), "e": pa.array([e] * w, pa.int32()), "j": pa.array(range(w), pa.int32()), "n": pa.array([n[p, e]] * w, pa.int64()),
                 "total": pa.array([str(t) if f else None for t, f in zip(sums, fits, strict=True)], pa.string()), "big": pa.array([None if f else str(t) for t, f in zip(sums, fits, strict=True)], pa.string())}
            )

    sums = rows.select("v").mapInArrow(run, "p int, e int, j int, n long, total string, big string")
    out = [[list(e) for e in p] for p in book]
    for r in sums.groupBy("p", "e", "j").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(28,0)")).alias("total"), F.collect_list("big").alias("big")).collect():
        out[r.p][r.e][r.j] = (int(r.total or 0) + sum(map(int, r.big))) // r.n
    return out


def first_book(rows: DataFrame, parts: int, entries: int, width: int) -> list:
    """Codebooks of the parts of the vectors with the smallest ids: one list of entries, themselves lists of integers, for each part."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), F.col("v")).limit(entries).toArrow()
    v = integers(first.combine_chunks().to_batches()[0], width)
    w = width // parts
    return [[[int(x) for x in e[p * w : (p + 1) * w]] for e in v] for p in range(parts)]


def digest(book: list) -> str:
    return hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", id: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, code (an entry's number for each part, in two hex digits), error, label_error and codebooks_sha256 of every kept vector."""
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("codes have two hex digits: up to 256 entries, and a part at least")
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").alias("label"), x.alias("v")).where(x.isNotNull() & finite)
    shape = "id", "label", "code", "error"
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    with Tables(vectors.sparkSession) as tables:
        if longest is None:
            book, coded = [], rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        else:
            width = max(1, -(-longest // parts)) * parts
            book = first_book(rows, parts, entries, width)
            for _ in range(rounds):
                book = moved(rows, book)
            coded = rows.mapInArrow(_encoder(book, shape), _code_schema(rows))
        coded = tables.written(coded, "codes")
        # One key for each label, nulls too.
        coded = coded.withColumn("key", F.concat_ws("", F.lit("="), F.col("label").cast("string"), F.col("label").isNull().cast("string")))
        sums = coded.groupBy("key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("n"))
        sums = tables.written(sums.select("key", "n", F.least("sum", F.lit(MOST_LONG)).cast("long").alias("label_error")), "errors")
        out = spread_join(coded, sums, "key", F.xxhash64("id", "code"))
        return tables.kept(out.select(F.col("id").alias(id), "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256")), "compressed")


def _code_schema(rows: DataFrame):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    return StructType([*(StructField(c, rows.schema[c].dataType) for c in ("id", "label")), StructField("code", StringType()), StructField("error", LongType())])


def _encoder(book: list, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(book)
        for b in _sliced(batches):
            codes, errors = np.zeros((b.num_rows, len(book)), np.uint8), np.zeros(b.num_rows, object)
            for p, _, entry, distance in coder.parts(b):
                codes[:, p] = entry
                errors = errors + distance
            error = pa.array([min(int(e), MOST_LONG) for e in errors], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), error], names=list(names))

    return run


def op11_vectors(spark, sf_dir):
    from .common import table

    return compress(table(spark, sf_dir, "embeddings"))


def _nearest(k: int) -> str:
    return f"a{k} AS MATERIALIZED (SELECT vec_id, p, min(d * 64 + e) AS m FROM (SELECT vec_id, p, e, sum((x - c) * (x - c)) AS d FROM comp JOIN b{k} USING (p, j) GROUP BY ALL) GROUP BY ALL)"


def _moved(k: int) -> str:
    return (
        f"b{k + 1} AS MATERIALIZED (SELECT p, e, j, coalesce(m, c) AS c FROM b{k} LEFT JOIN (SELECT p, CAST(m % 64 AS BIGINT) AS e, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m"
        f" FROM a{k} JOIN comp USING (vec_id, p) GROUP BY ALL) USING (p, e, j))"
    )


SQL = {
    "op11_vectors": f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
places AS (SELECT vec_id, v, len(v) // 16 AS w, unnest(range(len(v))) AS i FROM kept),
comp AS MATERIALIZED (SELECT vec_id, i // w AS p, i % w AS j, v[i + 1] AS x FROM places),
ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64),
b0 AS MATERIALIZED (SELECT p, e, j, x AS c FROM comp JOIN ids USING (vec_id)),
{_nearest(0)}, {_moved(0)}, {_nearest(1)}, {_moved(1)}, {_nearest(2)},
codes AS (SELECT vec_id, string_agg(printf('%02x', CAST(m % 64 AS INT)), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) FROM b2) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)
"""
}
