"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``least`` words that a document and a benchmark item share, found by their
Karp-Rabin hashes and joined with the item's places. Items whose seeds reach far enough are tiled: the
longest match of words not yet marked becomes a tile, again and again, until none of ``least`` words is
left. An item leaks into a document when its tiles cover ``coverage`` of its words, in whatever order
its passages stand.

How it scales. The benchmark is a stated query set: it is taken in blocks of at most ``block_bytes``
of text, each small enough to be sent to every task, and each block runs against all documents in one
pass without a shuffle. Whole texts are hashed with rolling arithmetic in vectors. Tiling never lists
pairs of places: Karp-Rabin runs over the text and the item for one length at a time, the longest that
still occurs, which is found by bisection, so that texts of one word again and again cost no more than
others: the work is the text's length times the number of different tile lengths.

Defined cases. Null and empty texts hold nothing; items with fewer words than ``least`` can't be told
from chance and never leak. Items of one text each have their rows, and so have repeated documents. A
null item_id or doc_id stays null. An empty table on either side gives an empty result. Columns other
than the keys and the texts are not read by leaks(); clean() passes all columns through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licenses import words_of

BASE = np.uint64(0x100000001B3)
BLOCK_BYTES = 16 << 20


def _windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` numbers."""
    n = len(ids) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size if n > 0 else 0):
            h = h * BASE + ids[k : k + n]
    return h


class _Prefixes:
    """Karp-Rabin hashes of a sequence's windows of any length, from its prefixes."""

    def __init__(self, ids: np.ndarray, powers: np.ndarray) -> None:
        self.powers, self.n = powers, len(ids)
        with np.errstate(over="ignore"):
            # Running sums of id * BASE^(n - 1 - place); of() brings windows to one scale, wherever they start.
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * powers[np.arange(self.n - 1, -1, -1)], dtype=np.uint64)])

    def of(self, starts: np.ndarray, size: int, scale: int) -> np.ndarray:
        """Hashes at one scale for all sequences of at most ``scale`` words."""
        with np.errstate(over="ignore"):
            return (self.sums[starts + size] - self.sums[starts]) * self.powers[scale - self.n + starts]


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows without a mark."""
    marks = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(marks[size:] == marks[:-size]) if size <= len(marked) else np.zeros(0, int)


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in a, start in b, length) of two sequences of numbers, the longest first, of one length the first in a, then in b."""
    scale = max(len(a), len(b))
    powers = np.empty(scale + 1, np.uint64)
    with np.errstate(over="ignore"):
        powers[0] = 1
        powers[1:] = np.cumprod(np.full(scale, BASE), dtype=np.uint64)
    of_a, of_b = _Prefixes(a, powers), _Prefixes(b, powers)
    in_a, in_b, out = np.zeros(len(a), bool), np.zeros(len(b), bool), []

    def found(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        at_b = _free(in_b, size)
        at_a = _free(in_a, size) if len(at_b) else at_b
        if not len(at_a):
            return None
        h_b, h_a = of_b.of(at_b, size, scale), of_a.of(at_a, size, scale)
        hit = np.isin(h_a, h_b)
        return (at_a[hit], h_a[hit], at_b, h_b) if hit.any() else None

    high = min(len(a), len(b)) + 1
    while True:
        low, best = least - 1, None  # matches of length low occur, of length high don't
        while high - low > 1:
            # Lengths near the least come first: most texts share little.
            mid = min((low + high) // 2, 2 * low + 1)
            got = found(mid)
            low, high, best = (mid, high, got) if got else (low, mid, best)
        if best is None:
            return out
        at_a, h_a, at_b, h_b = best
        order = np.argsort(h_b, kind="stable")
        queues: dict[int, list[int]] = {}
        for h, j in zip(h_b[order][::-1].tolist(), at_b[order][::-1].tolist(), strict=True):
            queues.setdefault(h, []).append(j)  # the smallest place is the last
        wanted = {h for h in set(h_a.tolist()) if h in queues}
        end_a = -1
        for i, h in zip(at_a.tolist(), h_a.tolist(), strict=True):
            if i < end_a or h not in wanted:
                continue
            queue, kept = queues[h], []
            while queue:
                j = queue.pop()
                if in_b[j : j + low].any():
                    continue  # for good
                if (a[i : i + low] != b[j : j + low]).any():  # equal hashes of different words
                    kept.append(j)
                    continue
                in_a[i : i + low] = True
                in_b[j : j + low] = True
                out.append((i, j, low))
                end_a = i + low
                break
            queue += kept[::-1]
            if not queue:
                wanted.discard(h)
                if not wanted:
                    break
        high = low if low > least else least
        if low == least:
            return out


class Seeds:
    """The windows of a block of items, by hash."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], least: int) -> None:
        self.least, self.vocabulary, self.items = least, {}, []
        hashes, which, place = [], [], []
        for key, words in items:
            if len(words) < least:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            h = _windows(ids, least)
            hashes.append(h)
            which.append(np.full(len(h), len(self.items)))
            place.append(np.arange(len(h)))
            self.items.append((key, ids))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.which, self.place = (np.concatenate(x)[order] if x else np.zeros(0, int) for x in (which, place))

    def match(self, words: list[bytes], coverage: float) -> Iterator[tuple[int | None, float, list[tuple[int, int, int]]]]:
        """Items that leak into a text: key, share of the item's words under tiles, tiles."""
        size = self.least
        if len(words) < size or not len(self.hashes):
            return
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        full = np.flatnonzero(known[size:] - known[:-size] == size)
        if not len(full):
            return
        with np.errstate(over="ignore"):
            h = np.zeros(len(full), np.uint64)
            for k in range(size):
                h = h * BASE + ids[full + k]
        h = np.unique(h)
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        low, times = low[high > low], (high - low)[high > low]
        at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())  # each window of the block that the text has
        which, place = self.which[at], self.place[at]
        order = np.argsort(which, kind="stable")
        which, place = which[order], place[order]
        for k, places in zip(np.unique(which).tolist(), np.split(place, np.flatnonzero(np.diff(which)) + 1), strict=True) if len(which) else ():
            key, item = self.items[k]
            covered = np.zeros(len(item) + 1, np.int64)
            np.add.at(covered, places, 1)
            np.add.at(covered, places + size, -1)
            if (np.cumsum(covered)[:-1] > 0).sum() < coverage * len(item):
                continue  # tiles lie within the seeds
            found = tiles(ids, item, size)
            share = sum(n for _, _, n in found) / len(item)
            if share >= coverage:
                yield key, share, found


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items in blocks of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0]
    if not total:
        return
    n = -(-total // block_bytes)
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r.item_id, words_of(r.text)) for r in block.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


LEAKS = "doc_id long, item_id long, coverage double, tiles array<struct<doc_word long, item_word long, words long>>"


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row (doc_id, item_id, coverage, tiles) for each item that leaks into a document."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], LEAKS)
    first = True
    for items in _blocks(benchmark, block_bytes):
        block = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(block.value, least)
            kind = pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))
            for b in batches:
                rows = []
                for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    for item, share, found in seeds.match(words_of(text.as_py()), coverage):
                        rows.append((key, item, share, [{"doc_word": i, "item_word": j, "words": n} for i, j, n in found]))
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), kind), strict=True)], names=["doc_id", "item_id", "coverage", "tiles"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LEAKS)
        out = found if first else out.unionByName(found)
        first = False
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those into which an item leaks."""
    spark = docs.sparkSession
    for items in _blocks(benchmark, block_bytes):
        block = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(block.value, least)
            for b in batches:
                yield b.filter(pa.array([next(seeds.match(words_of(t.as_py()), coverage), None) is None for t in b.column("text")], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark, sf_dir):
    from .common import table

    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    longest = F.aggregate("tiles", F.lit(0).cast("long"), lambda m, t: F.greatest(m, t["words"]))
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").cast("long").alias("n_tiles"), longest.alias("longest_tile"))
