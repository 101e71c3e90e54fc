"""Pipeline stages keep columns of any names, and take nulls, repeats and empty tables."""

import pytest
from pyspark.sql import functions as F

from fathom.llm import decontaminate, linededup, simhash, toxicity

NAMES = ["__id", "__text", "node", "first", "root", "f0", "__row", "__spans", "__out", "doc", "hash", "__removed_lines", "__removed_bytes", "__x0", "__x1", "__so_far", "part", "word", "label", "toxic", "score", "keep"]
LINE = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "one two", LINE, LINE, f"some line\n{LINE}\nother line", LINE.upper(), "plain words of a text " * 30, "plain words of a text " * 30 + "more"]
    df = spark.createDataFrame([(k if k != 1 else None, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(3, LINE, "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({n: F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id"), F.lit(-1))) for n in NAMES})


def stages(spark):
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(9)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(0, "plain words of a text " * 3), (1, None)], "item_id long, text string")
    return {
        "toxicity": lambda d: toxicity.drop_toxic(d, labels), "line_dedup": lambda d: linededup.dedup_lines(d).select(*d.columns),
        "simhash": simhash.near_duplicates, "decontamination": lambda d: decontaminate.clean(d, benchmark),
    }


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "simhash", "decontamination"])
def test_stage_keeps_columns(spark, docs, name):
    stage = stages(spark)[name]
    got = stage(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[n] == f"{n}-{-1 if r.doc_id is None else r.doc_id}" for r in rows for n in NAMES)
    assert stage(docs.limit(0)).collect() == []


def test_counts_of_removed_lines_give_way(spark, docs):
    got = linededup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "___removed_lines", "___removed_bytes"]
    assert got.agg(F.sum("___removed_lines")).first()[0] >= 2
