"""Language identification, words first: per-language log frequencies of words, backed off to character n-grams.

A word that the learnt texts hold is evidence for a language by its log frequency there: the logarithm of
how often it stands in the language's texts, at the rate of all texts, shrunk to the shared frequency with
the weight of one occurrence (``WEIGHT``). A word that they don't hold is looked up by the n-grams of its spelling (its
ends marked): the longest ones first, and progressively shorter ones as long as none of that length is
known; its evidence is the mean over those that are. A text's languages are compared by the sum over its
words and the share of documents; the score is the best one's posterior.

How it scales. One pass over the texts codes them in blocks of ``block_chars`` characters: a block has its
own numbering of its words, and a document becomes the numbers and counts of its words, packed. Only a block's
vocabulary is shuffled by word, to be joined with the word counts, which grow with the corpus and are never
broadcast or collected; what is found comes back to the block, where documents are summed up, in a group that the block's
size bounds (one document at least). N-grams are counted over the vocabulary and joined with the words that are
unseen only, each n-gram dealt out over ``SALTS`` places. Only one number a language goes to the driver.

Defined cases. Words are runs of letters (and letter-like numerals), in lower case. A null text, an empty one
and one without a letter are ``und`` with score 0; so is every text if nothing was learnt. A text of letters
of which nothing is known has the language of most learnt documents, with its share as the score. Ties go to the
smaller language. Rows with a null language or a null doc_id teach nothing and are predicted. Repeated rows
count and are predicted each. An empty table gives an empty result. Of the table's columns only those asked for are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import Tables, let
from .graph import spread_join

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Characters of the longest n-gram, ends of words included.
ORDER = 4
#: Occurrences that the shared frequency counts as.
WEIGHT = 1.0
BLOCK_CHARS = 1 << 25
BLOCK_DOCS = 50_000
SALTS = 8
_CODED = "block long, doc boolean, train string, letters boolean, bag binary, idx int, word string, langs array<string>, counts array<long>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def pack(numbers: dict[int, int]) -> bytes:
    """Numbers of words with their counts, compressed: ascending differences, then counts."""
    at = np.fromiter(sorted(numbers), np.uint32, len(numbers))
    n = np.fromiter(map(numbers.__getitem__, at.tolist()), np.uint32, len(numbers))
    return zlib.compress(np.diff(at, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(bag), np.uint8)
    k = len(raw) // 8
    at, n = (np.ascontiguousarray(raw[i * 4 * k : (i + 1) * 4 * k].reshape(4, k).T).view("<u4").ravel() for i in range(2))
    return np.cumsum(at, dtype=np.int64), n


class _Block:
    """The words and documents of a block, as they come."""

    def __init__(self, number: int) -> None:
        self.number, self.chars = number, 0
        self.vocabulary: dict[str, int] = {}
        self.learnt: dict[str, Counter] = {}
        self.keep, self.train, self.letters, self.bags = [], [], [], []

    def add(self, keep: pa.Scalar, text: str | None, train: str | None) -> None:
        counts: dict[int, int] = {}
        for word, n in Counter(words_of(text)).items():
            counts[self.vocabulary.setdefault(word, len(self.vocabulary))] = n
        if train is not None:
            self.learnt.setdefault(train, Counter()).update(counts)
        self.keep.append(keep)
        self.train.append(train)
        self.letters.append(any(c.isalpha() for c in text) if counts else False)
        self.bags.append(pack(counts))
        self.chars += len(text or "")

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        d = len(self.bags)
        rows = {"keep": self.keep, "block": [self.number] * d, "doc": [True] * d, "train": self.train, "letters": self.letters, "bag": self.bags}
        yield pa.RecordBatch.from_arrays([pa.array(rows.get(f.name, [None] * d), f.type) for f in schema], schema=schema)
        words, langs = list(self.vocabulary), sorted(self.learnt)
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            found = [[(g, n) for g in langs if (n := self.learnt[g].get(i))] for i in range(k, k + len(part))]
            rows = {"block": [self.number] * len(part), "doc": [False] * len(part), "idx": list(range(k, k + len(part))), "word": part}
            rows |= {"langs": [[g for g, _ in x] for x in found], "counts": [[n for _, n in x] for x in found]}
            yield pa.RecordBatch.from_arrays([pa.array(rows.get(f.name, [None] * len(part)), f.type) for f in schema], schema=schema)


def coded(rows: DataFrame, block_chars: int) -> DataFrame:
    """Rows (keep, text, train) as documents and words of blocks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = StructType([StructField("keep", rows.schema["keep"].dataType), *_parse_datatype_string(_CODED).fields])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for b in batches:
            for keep, text, train in zip(b.column("keep"), b.column("text"), b.column("train"), strict=True):
                block.add(keep.as_py(), text.as_py(), train.as_py())
                if block.chars >= block_chars or len(block.bags) >= BLOCK_DOCS:
                    yield from block.batches(schema)
                    number += 1
                    block = _Block(number)
        if block.bags:
            yield from block.batches(schema)

    return rows.mapInArrow(run, out)


def _large(table: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: never broadcast, though the compressed file that Spark goes by may be small."""
    return table.hint("merge")


def evidence(counts: DataFrame, key: str) -> DataFrame:
    """Rows (key, lang, v) of rows (key, lang, n): the log frequency in the language relative to the shared one, which all languages have."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("of"), F.count(F.lit(1)).alias("n"))
    sums = totals.agg(F.sum("of"), F.sum("n")).first()
    rates = totals.select("lang", "n", (F.lit(float(sums[0] or 0)) / F.col("of")).alias("rate"))
    return spread_join(counts, rates, "lang", F.xxhash64(key), total=sums[1] or 0).select(key, "lang", F.log1p(F.col("n") * F.col("rate") / F.lit(WEIGHT)).alias("v"))


def grams(word: Column, n: int) -> Column:
    """The n-grams of a word with its ends marked, each as often as it stands there."""

    def of(marked: Column) -> Column:
        places = F.when(F.size(marked) >= n, F.sequence(F.lit(0), F.size(marked) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(*(F.get(marked, i + k) for k in range(n))))

    # By characters: a substring by position would read a long word from its begin each time.
    return let(F.split(F.concat(F.lit("^"), word, F.lit("$")), ""), of)


def spelt(unseen: DataFrame, counts: DataFrame, order: int, tables: Tables) -> Iterator[DataFrame]:
    """Evidence (word, lang, v) of unseen words (id, word) by the longest n-grams of which any is known; rows of n-grams carry the number, as words may be long."""
    for n in range(order, 0, -1):
        if unseen.isEmpty():
            return
        pieces = unseen.select("id", F.explode(grams(F.col("word"), n)).alias("gram"))
        known = tables.written(counts.select("lang", F.explode(grams(F.col("word"), n)).alias("gram")).groupBy("gram", "lang").agg(F.count(F.lit(1)).alias("n")), "grams")
        by_gram = evidence(known, "gram").groupBy("gram").agg(F.collect_list(F.struct("lang", "v")).alias("of"))
        # Every n-gram is dealt out alike: the commonest has a few per cent of all places in any language.
        salted = by_gram.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = pieces.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(_large(salted), ["gram", "salt"]).groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.flatten(F.collect_list("of")).alias("of"))
        means = met.select("id", "k", F.inline("of")).groupBy("id", "lang").agg(F.round(F.sum("v") / F.first("k"), 9).alias("v"))
        found = tables.written(means, "spelt")
        yield unseen.join(_large(found), "id").select("word", "lang", "v")
        unseen = tables.written(unseen.join(_large(found.select("id").distinct()), "id", "left_anti"), "unseen")


def _judge(priors: dict[str, int]):
    """A function of a block's documents and its words' evidence that gives keep, lang_pred and score."""
    langs = sorted(priors)
    names = pa.array(langs, pa.string())
    start = np.log(np.array([priors[g] for g in langs], float) / max(1, sum(priors.values())))

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        order = np.argsort(words.column("idx").to_numpy(), kind="stable")
        idx = words.column("idx").to_numpy()[order]
        of = pc.index_in(words.column("lang"), names).to_numpy()[order].astype(np.int64)
        v = words.column("v").to_numpy()[order]
        starts = np.searchsorted(idx, np.arange((idx[-1] if len(idx) else 0) + 2))  # of each word's evidence
        best, score = [], []
        for letters, bag in zip(docs.column("letters").to_pylist(), docs.column("bag"), strict=True):
            if not letters or not langs:
                best.append(UNKNOWN)
                score.append(0.0)
                continue
            at, n = unpack(bag.as_py())
            at = np.minimum(at, len(starts) - 1)
            low = starts[at]
            size = starts[np.minimum(at + 1, len(starts) - 1)] - low
            where = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            total = start + np.bincount(of[where], v[where] * np.repeat(n, size), len(langs))
            k = int(np.argmax(total))
            best.append(langs[k])
            score.append(float(1 / np.exp(total - total[k]).sum()))
        return pa.table({"keep": docs.column("keep"), "lang_pred": pa.array(best, pa.string()), "score": pa.array(score, pa.float64())})

    return run


def identify(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",), order: int = ORDER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The kept columns of every row, lang_pred and score (kept columns of these names give way); rows where ``learn`` holds and the language is known are learnt from."""
    with Tables(docs.sparkSession) as tables:
        kept = [c for c in keep if c not in ("lang_pred", "score")]
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("keep"), F.col(f"`{text}`").alias("text"), F.when(learn, F.col(f"`{lang}`").cast("string")).alias("train"))
        table = tables.written(coded(rows, block_chars), "coded")
        words = table.where("not doc").select("block", "idx", "word", "langs", "counts")
        priors = {r.train: r.n for r in table.where("doc and train is not null").groupBy("train").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts = words.select("word", F.inline(F.arrays_zip(F.col("langs").alias("lang"), F.col("counts").alias("n"))))
        counts = tables.written(counts.repartition("word").groupBy("word", "lang").agg(F.sum("n").alias("n")), "counts")
        unseen = words.select("word").distinct().join(_large(counts.select("word").distinct()), "word", "left_anti")
        unseen = tables.written(unseen.select(F.monotonically_increasing_id().alias("id"), "word"), "unseen")
        known = evidence(counts, "word")
        for found in spelt(unseen, counts, order, tables):
            known = known.union(found)
        hits = tables.written(words.select("block", "idx", "word").join(_large(known), "word").select("block", "idx", "lang", "v"), "hits")
        out = StructType([table.schema["keep"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
        bags = table.where("doc").select(F.col("block").alias("of"), "keep", "letters", "bag")
        judged = bags.groupBy("of").cogroup(hits.groupBy("block")).applyInArrow(_judge(priors), out)
        return tables.kept(judged.select("keep.*", "lang_pred", "score"), "languages")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op13_language(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, F.col("doc_id").isNotNull() & ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
