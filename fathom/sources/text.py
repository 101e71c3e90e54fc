"""Delimited soundings, archives and encodings."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fathom import model as M
from fathom.functions import exprs as E


def decoded(raw: Column) -> Column:
    """Text of bytes: UTF-8 without its mark where valid, else Latin-1. Windows-1252 needs decode_windows()."""
    utf8 = F.try_validate_utf8(raw.cast("string"))
    return F.regexp_replace(F.coalesce(utf8, F.decode(raw, "ISO-8859-1")), "^﻿", "")


@F.pandas_udf(StringType())
def decode_windows(raw: pd.Series) -> pd.Series:
    """UTF-8, else Windows-1252, else Latin-1."""

    def of(b: bytes | None) -> str | None:
        if b is None:
            return None
        for name in ("utf-8-sig", "cp1252"):
            try:
                return b.decode(name)
            except UnicodeDecodeError:
                pass
        return b.decode("latin-1")

    return raw.map(of)


def sniff_delimiter(head: str, among: tuple[str, ...] = M.DELIMITERS) -> str:
    """The commonest of the delimiters in the first line of a head; a tab where there is none."""
    line = head.split("\n", 1)[0]
    best = max(among, key=line.count)
    return best if line.count(best) else "\t"


def resolve_header(df: DataFrame, synonyms: dict[str, tuple[str, ...]] = M.HEADER_SYNONYMS, needed: tuple[str, ...] = ("lon", "lat", "depth")) -> DataFrame:
    """df with the columns that synonyms name, found by normalised names; code, name and date may lack."""
    import re
    import unicodedata

    norm = lambda s: re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower())
    have = {norm(c): c for c in reversed(df.columns)}
    found = {k: next((have[n] for n in names if n in have), None) for k, names in synonyms.items()}
    if lacking := [k for k in needed if not found[k]]:
        raise ValueError(f"no column for {', '.join(lacking)} in {df.columns}")
    return df.select(*((F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(k) for k, c in found.items()))


def read_soundings(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Typed soundings of delimited files with a header; numbers may have decimal commas."""
    if delimiter is None:
        head = spark.read.text(path).limit(1).collect()
        delimiter = sniff_delimiter(head[0][0] if head else "")
    raw = resolve_header(spark.read.csv(path, sep=delimiter, header=True))
    return raw.select("code", "name", "date", *(E.decimal_comma(F.col(c)).alias(c) for c in ("lon", "lat", "depth")))


def matching(soundings: DataFrame, token: str, codes: tuple[str, ...]) -> DataFrame:
    """Rows whose name contains a token, whose code is one of a set, or whose code ends like the first of it."""
    name, code = E.normal_name(F.coalesce("name", F.lit(""))), E.normal_name(F.coalesce("code", F.lit("")))
    return soundings.where(name.contains(token) | code.isin(*codes) | code.endswith(codes[0]))


def audit(soundings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejections counted by their first reason."""
    judged = soundings.withColumn("reason", E.reject_reason(F.col("lon"), F.col("lat"), F.col("depth")))
    return judged.where("reason = 'ok'").drop("reason"), judged.where("reason != 'ok'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def archive_members(spark: SparkSession, path: str, endings: tuple[str, ...] = (".tab", ".csv", ".txt"), most_bytes: int = 1 << 30) -> DataFrame:
    """(path, member, size, text) of the text members of zip archives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        if m.filename.lower().endswith(endings) and m.file_size <= most_bytes:
                            rows.append((where, m.filename, m.file_size, z.read(m)))
            yield pd.DataFrame(rows, columns=["path", "member", "size", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    raw = files.mapInPandas(run, "path string, member string, size long, content binary")
    return raw.select("path", "member", "size", decode_windows("content").alias("text"))


def largest_member(members: DataFrame) -> DataFrame:
    return members.groupBy("path").agg(F.max_by(F.struct("member", "size", "text"), F.struct("size", "member")).alias("m")).select("path", "m.*")


def line_hits(texts: DataFrame, key: str, text: str, pattern: str, most: int = 40) -> DataFrame:
    """The first lines of each text that match, with their places."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    hit = lines.where(F.col("line").rlike(pattern)).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("h"))
    return hit.select(key, F.explode(F.slice("h", 1, most)).alias("h")).select(key, "h.line_no", "h.line")
