"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

Chunks are runs of whole lines with ``least_words`` words or more, and their ends are drawn by their own content. A hash that
rolls over the hashes of two neighbouring lines draws a cut where it has a certain remainder, at one line in ``EVERY``;
what stands between two cuts is a chunk. A passage of few lines seldom has two cuts, so that every line with a word
also begins a chunk that ends where the words suffice, and ends one that is found in the same way backwards. Neither what
stands before or behind a passage nor where it stands moves a boundary within it, and every run
of whole lines with enough words that occurs twice is a union of chunks that occur twice.

Chunks that occur anywhere else in the corpus, in an earlier row or earlier in the same text, are removed
once all their lines are compared byte by byte. What is removed stays where it occurs first: each
removed line is equal to one at an earlier place that is not removed. Lines without a word don't count
and go with the chunk they stand in or behind.

How it scales. Rows are numbered in a copy written once, so that all jobs mean the same row by a number,
however the scan is split. Chunks are found in time in proportion to a text's lines. What is shuffled is a hash and a place for each chunk,
combined map-side by hash, so that a chunk that a third of all rows share is one row per task; the join
that finds the copies deals such chunks out. The lines of repeated chunks are compared by the least and the greatest
line of a hash, also combined map-side. The texts are shuffled twice, by the row's number.

Defined cases. A null text stays null, an empty one empty. A text of which all is removed becomes
empty; the row stays. Repeated rows keep the text in the first of them. Repeated chunks within one
text count as copies. Words are runs of other characters than space and U+0009 to U+000D. A chunk
with a line whose hash another line has, too, is left. An empty table gives an empty result. All other
columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written
from .graph import spread_join

WORD = r"[^\x20\x09-\x0D]+"


#: A cut is before one in so many lines.
EVERY = 8
#: Where words are not told apart by single spaces.
ODD = ("\t", "\x0b", "\x0c", "\r", "  ", "\n ", " \n")


def _lines(text: Column) -> Column:
    """The lines with a word: place, hash and words."""

    def words(x: Column, odd: Column) -> Column:
        spaces = F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
        return F.when(odd, F.regexp_count(x, F.lit(WORD))).when(x == "", 0).otherwise(spaces + 1)

    def lines(odd: Column) -> Column:
        line = lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), words(x, odd).alias("w"))
        return F.filter(F.transform(F.split(text, "\n"), line), lambda s: s["w"] > 0)

    odd = F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    for mark in ODD:
        odd = odd | F.contains(text, F.lit(mark))
    return let(F.coalesce(odd, F.lit(False)), lines)


def chunks(text: Column, least_words: int) -> Column:
    """Chunks of a text: first line, last line with what follows it without a word, hash of the lines' hashes."""
    least = F.lit(least_words)

    def taken(ls: Column, places: Column) -> Column:
        """How many of the lines at some places make up the words; null if all of them don't."""
        none = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"))
        add = lambda a, k: F.when(a["w"] >= least, a).otherwise(F.struct((a["w"] + F.get(ls, k)["w"]).alias("w"), (a["n"] + 1).alias("n")))
        return F.aggregate(places, none, add, lambda a: F.when(a["w"] >= least, a["n"]))

    def spans(ls: Column) -> Column:
        """First and last line of each chunk in one long; the same chunk once (numbers are told apart by hashing, structs by comparing all pairs).

        Lines are reached by their places: a slice would copy all lines first.
        """
        span = lambda a, b: F.shiftleft(a.cast("long"), 32) + b.cast("long")
        ahead = lambda i, n: F.sequence(i, F.least(i + n, F.size(ls)) - 1)
        behind = lambda i, n: F.sequence(i, F.greatest(i + 1 - n, F.lit(0)), F.lit(-1))
        # Most lines need few others.
        enough = lambda x, way, i: F.when(x["w"] >= least, F.lit(1)).otherwise(F.coalesce(taken(ls, way(i, F.lit(min(6, least_words)))), taken(ls, way(i, least))))
        on = F.transform(ls, lambda x, i: span(i, i - 1 + enough(x, ahead, i)))
        back = F.transform(ls, lambda x, i: span(i + 1 - enough(x, behind, i), i))
        return F.filter(F.array_distinct(F.concat(let(_cuts(ls), lambda cuts: between(ls, cuts)), on, back)), lambda s: s.isNotNull())

    def between(ls: Column, cuts: Column) -> Column:
        """Chunks from one cut to the next that have the words."""
        words = lambda a, b: F.aggregate(F.sequence(a, b), F.lit(0), lambda n, k: n + F.get(ls, k)["w"])
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(cuts) - 2, F.lit(0))), lambda k: F.struct(F.get(cuts, k).alias("a"), (F.get(cuts, k + 1) - 1).alias("b")))
        return F.transform(pairs, lambda p: F.when(words(p["a"], p["b"]) >= least, F.shiftleft(p["a"].cast("long"), 32) + p["b"]))

    def _cuts(ls: Column) -> Column:
        rolled = lambda i: F.pmod(F.xxhash64(F.get(ls, i - 1)["h"], F.get(ls, i)["h"]), F.lit(EVERY)) == 0
        inner = F.when(F.size(ls) > 1, F.filter(F.sequence(F.lit(1), F.size(ls) - 1), rolled)).otherwise(F.array().cast("array<int>"))
        return F.when(F.size(ls) > 0, F.concat(F.array(F.lit(0)), inner, F.array(F.size(ls))))

    def chunk(ls: Column) -> Column:
        def of(s: Column) -> Column:
            a, b = F.shiftright(s, 32).cast("int"), s.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
            end = F.coalesce(F.get(ls, b + 1)["at"] - 1, F.lit(2**31 - 1))
            return F.struct(F.get(ls, a)["at"].alias("first"), end.alias("last"), F.xxhash64(F.transform(F.sequence(a, b), lambda k: F.get(ls, k)["h"])).alias("hash"))

        return F.transform(spans(ls), of)

    return let(_lines(text), chunk)


def _places(spans: Column, lines: Column) -> Column:
    """The places of lines that spans cover, each once."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], F.least(s["last"], F.size(lines) - 1)))))


def dedup_lines(docs: DataFrame, text: str = "text", least_words: int = 50) -> DataFrame:
    """docs with the text's repeated chunks removed, and how much: __removed_lines and __removed_bytes (with more underscores where docs has such columns)."""
    base = written(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct("*").alias("doc")), "numbered")
    whole = F.col(f"doc.`{text}`")
    found = written(base.select("__row", F.explode(chunks(whole, least_words)).alias("c")).select("__row", "c.*"), "chunks")
    at = F.struct(F.col("__row").alias("row"), F.col("first").alias("first"))
    repeated = written(found.groupBy("hash").agg(F.min(at).alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    is_copy = (F.col("original.row") != F.col("__row")) | (F.col("original.first") != F.col("first"))
    again = spread_join(found, repeated, "hash", F.xxhash64("__row", "first"))
    again = written(again.select("__row", "first", "last", is_copy.alias("copy")), "again")
    by_row = lambda rows: rows.groupBy("__row").agg(F.collect_list(F.struct("first", "last")).alias("__spans"))

    # Lines of repeated chunks that have one hash and different bytes: hardly ever any.
    joined = base.select("__row", whole.alias("__text")).join(by_row(again).hint("merge"), "__row")
    compared = joined.select(F.explode(let(F.split("__text", "\n"), lambda ls: F.transform(_places("__spans", ls), lambda i: F.get(ls, i)))).alias("line"))
    unlike = compared.groupBy(F.xxhash64("line").alias("h")).agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a != b").select("h")
    unlike, gone = written(unlike, "unlike"), again.where("copy")
    if not unlike.isEmpty():
        each = joined.select("__row", F.split("__text", "\n").alias("ls"), F.explode("__spans").alias("s"))
        lines = each.select("__row", "s.*", F.explode(F.transform(F.sequence("s.first", F.least("s.last", F.size("ls") - 1)), lambda i: F.xxhash64(F.get("ls", i)))).alias("h"))
        spoilt = lines.join(unlike, "h", "left_semi").select("__row", "first", "last").distinct()
        gone = gone.join(written(spoilt, "spoilt"), ["__row", "first", "last"], "left_anti")
    gone = by_row(gone)

    joined = base.join(gone.hint("merge"), "__row", "left")
    lines = F.split(whole, "\n")
    out = let(
        F.struct(lines.alias("lines"), _places(F.col("__spans"), lines).alias("gone")),
        lambda x: F.struct(
            F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"]), lambda i: F.get(x["lines"], i)), "\n").alias("text"),
            F.size(x["gone"]).alias("n"),
        ),
    )
    done = joined.withColumn("__out", F.when(F.col("__spans").isNotNull(), out))
    left = F.when(F.col("__out").isNull(), whole).otherwise(F.col("__out.text"))
    size = (F.octet_length(whole) - F.octet_length("__out.text")).cast("long")
    taken = {c.lower() for c in docs.columns}
    free = lambda name: free(f"_{name}") if name in taken else name
    counts = {free("__removed_lines"): F.coalesce("__out.n", F.lit(0)), free("__removed_bytes"): F.coalesce(size, F.lit(0).cast("long"))}
    kept = [(left if c == text else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns]
    return done.select(*kept, *(c.alias(n) for n, c in counts.items()))


def op8_line_dedup(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", F.col("__removed_lines").alias("removed_lines"), F.col("__removed_bytes").alias("removed_bytes"))
