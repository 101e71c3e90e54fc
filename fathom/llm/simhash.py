"""SimHash near-dedup with meet-in-the-middle ball hashing.

A fingerprint bit is 1 where more than half the hashes of a text's word shingles have it set. Two
fingerprints at most ``radius`` bits apart have a common variant at most half the radius (rounded up)
from each. So every distinct fingerprint emits all its variants within half the radius, rows meet on
their variant, and what meets is verified.

``fingerprint_components`` is exact for 64 bits and radius 2: a variant has at most 64 neighbours at
one bit, so that a meeting holds 65 fingerprints at most; all of them are within two bits of each
other, so that links to the smallest of them lose no component.

``near_duplicates`` looks for a similarity (Jaccard's, of sets of five-word shingles by default), which
for SimHash means an angle: it takes wider fingerprints and ball-hashes each 32-bit band. Nodes (distinct sets of
shingles) that meet and are near enough by all bits make up crowds; within a crowd all pairs are verified by their
shingle sets, exactly.

How it scales. Fingerprints are one pass over the texts; equal ones are counted once, so copies cost
nothing more. The variants of the distinct fingerprints are shuffled, a fixed number for each. A meeting's nodes
are compared with its smallest, and pair by pair only where that leaves several crowds in a meeting. A crowd's sets are
dealt over blocks of bounded size. A block's pairs are counted at once by products of matrices, with each other and with the crowd's
pivot, and only links that join are emitted: this is linear in the crowd. Nodes that are then not in the
crowd's largest group are compared with all of the crowd, block by block. So a large group of near copies costs little more than its
members, and a large crowd that holds no near copies costs the square of its blocks, never rows for its pairs.
Components are found by rounds of minima by key and joins that deal hot keys out.

Defined cases. Null and empty texts have fingerprint zero and are linked like any other. Texts with
fewer words than a shingle have one shingle, all of their words. Repeated rows are all returned, or in
``near_duplicates`` are copies of which one stays. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .graph import components, spread_join


def shingle_hashes(text: str | None, size: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of words between ASCII spaces, A-Z in lower case, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, ">u8")
    n = max(1, len(words) - size + 1)
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    begins = [0, *(e + 1 for e in ends[: n - 1])]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[a:e], seed) for a, e in zip(begins, ends[min(size, len(words)) - 1 :], strict=True)]), ">u8")


_STEPS = np.array([(k * 0x9E3779B97F4A7C15) % 2**64 for k in range(64)], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """The majority of the hashes' bits; further 64-bit words take the hashes' mixes."""
    n = len(hashes)
    if not n:
        return bytes(8 * words)
    mixed = hashes
    if words > 1:
        mixed = hashes.astype(np.uint64)[:, None] + _STEPS[:words]
        more = mixed[:, 1:]
        more ^= more >> np.uint64(30)
        more *= np.uint64(0xBF58476D1CE4E5B9)
        more ^= more >> np.uint64(27)
        more *= np.uint64(0x94D049BB133111EB)
        more ^= more >> np.uint64(31)
    bits = np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(-1)).reshape(n, 64 * words)
    whole = n // 255  # eight-bit sums of 255 rows each
    ones = bits[255 * whole :].sum(0, dtype=np.uint8).astype(np.uint32)
    if whole:
        ones += bits[: 255 * whole].reshape(whole, 255, -1).sum(1, dtype=np.uint8).sum(0, dtype=np.uint32)
    return np.packbits(ones > n // 2).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, keys: list[str] | None = None, repeats: bool = True) -> DataFrame:
    """The key columns (longs) and f0, f1, ...: a long for each 64 bits.

    Without ``repeats`` every different shingle counts once, ``node`` is a hash of the set of shingles and ``shingles`` its size.
    """
    keys = keys or ["doc_id"]
    names = [*keys, *([] if repeats else ["node", "shingles"]), *(f"f{k}" for k in range(words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, nodes, sizes = [], [], []
            for t in b.column("text"):
                h = shingle_hashes(t.as_py(), shingle)
                if not repeats:
                    h = np.unique(h)
                    nodes.append(_signed(xxhash.xxh64_intdigest(h.tobytes(), 42)))
                    sizes.append(len(h))
                found.append(fingerprint(h, words))
            got = np.frombuffer(b"".join(found), ">i8").reshape(-1, words)
            of_sets = [] if repeats else [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(k).cast(pa.int64()) for k in keys), *of_sets, *(pa.array(got[:, k].astype(np.int64)) for k in range(words))], names=names)

    return docs.select(*keys, "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) of fingerprints f at 2 or fewer differing bits, each meeting's to its smallest."""
    masks = F.array(*(F.lit(_signed(m)) for m in [0, *(1 << i for i in range(64))]))
    variants = distinct.select("f", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("f")))).alias("variant"))
    met = variants.withColumn("least", F.min("f").over(Window.partitionBy("variant"))).where("f != least")
    return met.where(F.bit_count(F.col("f").bitwiseXOR(F.col("least"))) <= 2).select(F.col("f").alias("u"), F.col("least").alias("v")).distinct()


def fingerprint_components(prints: DataFrame) -> DataFrame:
    """(doc_id, f0) with component_id, the smallest doc_id reachable by links of at most 2 bits."""
    prints = written(prints.select("doc_id", "f0"), "fingerprints")
    distinct = written(prints.groupBy(F.col("f0").alias("f")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = written(components(written(links(distinct), "links")), "roots")
    rooted = distinct.join(roots, distinct.f == roots.node, "left").select("f", "first", F.col("n").alias("copies"), F.coalesce("root", "f").alias("root"))
    rooted = written(rooted, "rooted")
    smallest = written(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")), "smallest")
    of_print = written(spread_join(rooted, smallest, "root", F.xxhash64("f")).select(F.col("f").alias("f0"), "component_id", F.col("copies").alias("n")), "of_print")
    return spread_join(prints.withColumn("tie", F.monotonically_increasing_id()), of_print, "f0", F.xxhash64("tie")).select("doc_id", "f0", "component_id")


BAND_MASKS = [0, *(1 << i for i in range(32))]


def most_apart(similarity: float, bits: int) -> int:
    """Differing bits up to which a pair's shingles are compared.

    Shingle sets of a Jaccard similarity have an angle, and each bit differs with a chance in proportion
    to it; four standard deviations more let pairs pass that are just as similar as asked.
    """
    chance = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * chance + 4 * math.sqrt(bits * chance * (1 - chance)))


def _shingle_sets(texts: DataFrame, shingle: int, keep: list[str]) -> DataFrame:
    """The kept columns and shingles: the different shingles' hashes of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                b = batch.slice(k, 500)
                sets = [np.unique(shingle_hashes(t.as_py(), shingle)).astype(np.uint64).view(np.int64) for t in b.column("text")]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sets, pa.list_(pa.int64()))], names=[*keep, "shingles"])

    kept = texts.select(*keep, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")
    return kept.mapInArrow(run, f"{schema}, shingles array<long>")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left shares with each on the right, by products of 0-1 matrices, some columns at a time."""
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    column, owner = column[keep], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = np.cumsum(np.diff(column[order], prepend=-1) > 0) - 1 if len(order) else column, owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [begin, begin + 4096])
        m = np.zeros((len(left) + len(right), 4096), np.float32)
        m[owner[a:b], column[a:b] - begin] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _joined(similar: np.ndarray) -> np.ndarray:
    """The smallest row joined with each row of a symmetric matrix of links."""
    root = np.full(len(similar), -1)
    for i in range(len(similar)):
        if root[i] < 0:
            group = np.zeros(len(similar), bool)
            group[i], new = True, np.array([i])
            while len(new):
                reached = similar[new].any(0) & ~group
                group |= reached
                new = np.flatnonzero(reached)
            root[group] = i
    return root


def verified(nodes: np.ndarray, sets: list[np.ndarray], is_left: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that join the nodes whose sets have the Jaccard similarity, of a pair of nodes of which one at least is left."""
    left = np.flatnonzero(is_left)
    sizes = np.array([len(x) for x in sets], float)
    shared = shared_counts([sets[i] for i in left], sets)
    near = shared >= similarity * (sizes[left][:, None] + sizes[None, :] - shared) - 1e-9
    links = np.zeros((len(sets), len(sets)), bool)
    links[left] = near
    links |= links.T
    root = _joined(links)
    other = np.flatnonzero(root != np.arange(len(sets)))
    return nodes[other], nodes[root[other]]


def _verify(rows: DataFrame, by: list[str], similarity: float) -> DataFrame:
    """Links (u, v) within each group of rows (node, shingles, left); groups are bounded."""

    def run(group: pa.Table) -> pa.Table:
        sets = [x.values.to_numpy() for x in group.column("shingles")]
        u, v = verified(group.column("node").to_numpy(), sets, group.column("left").to_numpy(), similarity)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.groupBy(*by).applyInArrow(run, "u long, v long")


def _crowds(met: DataFrame, distinct: DataFrame, fs: list[str], limit: int) -> DataFrame:
    """(node, root): nodes that meet and whose fingerprints are near enough, joined. Nodes apart from all others are left out."""

    def marked(pairs: DataFrame, name: str) -> DataFrame:
        for s in "uv":
            pairs = pairs.join(distinct.select(F.col("node").alias(s), *(F.col(f).alias(f"{s}{f}") for f in fs)), s)
        apart = sum((F.bit_count(F.col(f"u{f}").bitwiseXOR(F.col(f"v{f}"))) for f in fs), F.lit(0))
        return written(pairs.select("u", "v", (apart <= limit).alias("near")), name)

    # Each meeting's nodes with its smallest: that joins nearly all.
    stars = marked(met.where("node != least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct(), "stars")
    found = stars.where("near").select("u", "v")
    roots = written(components(found), "crowds")
    # Then, in the meetings where a node is not near the smallest, all pairs that this leaves in different crowds.
    by = Window.partitionBy("variant")
    more_than_two = met.where("n > 2")
    far = stars.where("not near").select(F.col("u").alias("node"), F.col("v").alias("least"))
    mixed = written(more_than_two.join(far, ["node", "least"], "left_semi").select("variant").distinct(), "mixed")
    rooted = more_than_two.join(mixed, "variant", "left_semi").join(roots, "node", "left").select("variant", "node", "least", F.coalesce("root", "node").alias("root"))
    apart = rooted.select("*", F.min("root").over(by).alias("lowest"), F.max("root").over(by).alias("highest")).where("lowest != highest and node != least")
    apart = written(apart.select("variant", "node", "root"), "apart")
    u, v = (apart.select("variant", F.col("node").alias(s), F.col("root").alias(f"{s}root")) for s in "uv")
    more = marked(u.join(v.hint("merge"), "variant").where("uroot < vroot").select("u", "v").distinct(), "more").where("near").select("u", "v")
    return written(components(found.union(more)), "crowds") if more.head(1) else roots


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 8, block: int = 512, block_shingles: int = 1 << 20) -> DataFrame:
    """docs without all but one document, the one of smallest doc_id, of each group of near copies."""
    keyed = _row_keys(docs).select("__id", "__text", "doc.text")
    prints = written(fingerprints(keyed, shingle, words, ["__id", "__text"], repeats=False), "fingerprints")
    fs = [f"f{k}" for k in range(words)]
    distinct = written(prints.groupBy("node", "shingles", *fs).agg(F.min(F.struct("__id", "__text")).alias("first")), "distinct")
    bands = F.array(*(x for f in fs for x in (F.col(f).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f, 32))))
    keys = F.flatten(F.transform(bands, lambda band, i: F.transform(F.array(*(F.lit(m) for m in BAND_MASKS)), lambda m: F.shiftleft(i.cast("long"), 32).bitwiseXOR(band.bitwiseXOR(m)))))
    by = Window.partitionBy("variant")
    variants = distinct.select("node", F.explode(keys).alias("variant"))
    met = written(variants.select("variant", "node", F.min("node").over(by).alias("least"), F.count(F.lit(1)).over(by).alias("n")).where("n > 1"), "meetings")
    crowds = _crowds(met, distinct, fs, most_apart(similarity, 64 * words))

    # The sets of all that have a crowd, each crowd in blocks of bounded size.
    members = distinct.join(crowds, "node").select("node", "shingles", "first", F.col("root").alias("crowd"))
    pieces = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum("shingles") / F.lit(block_shingles)))
    sizes = written(members.groupBy("crowd").agg(pieces().cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")), "sizes")
    members = spread_join(written(members, "members"), sizes, "crowd", F.xxhash64("node"))
    place = members.select(F.col("first.__id").alias("__id"), F.col("first.__text").alias("__text"), "node", "crowd", "blocks", "pivot", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    texts = keyed.join(place, ["__id", "__text"]).dropDuplicates(["__id", "__text"])
    sets = written(_shingle_sets(texts, shingle, ["node", "crowd", "blocks", "pivot", "block"]), "sets")

    # All pairs within a block, and all with the crowd's pivot.
    everywhere = sets.where("node = pivot and blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = sets.where("node != pivot or blocks = 1").unionByName(everywhere)
    found = written(_verify(rows.select("crowd", "block", "node", "shingles", F.lit(True).alias("left")), ["crowd", "block"], similarity), "found")
    roots = written(components(found), "roots")
    # Then, in crowds of more blocks, all that this has not joined with the crowd's largest group against all.
    large = written(sets.where("blocks > 1").select("crowd", "node", "block", "blocks").join(roots, "node", "left").select("crowd", "node", "block", "blocks", F.coalesce("root", "node").alias("root")), "large")
    if large.head(1):
        groups = large.groupBy("crowd", "root").agg(F.count(F.lit(1)).alias("n"))
        main = groups.groupBy("crowd").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
        main = written(main.where("most < all").select("crowd", "main", F.ceil((F.col("all") - F.col("most")) / F.lit(block)).cast("int").alias("parts")), "main")
        open_ = large.join(main, "crowd").select("node", "main", "parts", "root")
        wide = sets.join(open_, "node").select("crowd", "node", "shingles", "block", "blocks", "parts", (F.col("root") != F.col("main")).alias("left"))
        range_of = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        left = wide.where("left").select("crowd", "node", "shingles", "left", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("parts")).cast("int").alias("part"), F.explode(range_of("blocks")).alias("block"))
        right = wide.select("crowd", "node", "shingles", F.lit(False).alias("left"), F.explode(range_of("parts")).alias("part"), "block")
        rest = written(_verify(left.unionByName(right), ["crowd", "part", "block"], similarity), "rest")
        roots = written(components(found.union(rest)), "roots")
    rooted = distinct.join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    stays = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    # Equal rows of one doc_id still repeat; they have the same place after the join.
    return _row_keys(docs).join(written(stays, "stays"), ["__id", "__text"], "left_semi").dropDuplicates(["__id", "__text"]).select("doc.*")


def _row_keys(docs: DataFrame) -> DataFrame:
    """Two longs that tell rows apart which have one doc_id, or none, and different texts, and the row, whose columns may have any names."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("__id"), F.xxhash64("text").alias("__text"), F.struct("*").alias("doc"))


def op9_simhash(spark, sf_dir):
    from .common import table

    found = fingerprint_components(fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
