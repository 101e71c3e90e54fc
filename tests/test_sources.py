"""The data source of survey files: ranges, encodings, headers, filters, and writes in two phases."""

import io
import json
import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathom import model as M
from fathom.sources import survey

ROWS = [("A1", 'Étang; "é"\nx', "2020-01-01", -1.1, 44.9, 2.5), (None, None, None, 1e-7, -0.0, None), ("B,2", "naïve", "", 3.0, 4.0, 7.25)]


@pytest.fixture(scope="module")
def s(spark):
    survey.register(spark)
    return spark


def load(s, path, kind, **options):
    return s.read.format("survey").option("kind", kind).options(**options).load(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("kind", ["delimited", "zip", "geojson"])
def test_round_trip(s, tmp_path, kind):
    df, path = s.createDataFrame(ROWS, M.SOUNDING), str(tmp_path / "t")
    df.repartition(2).write.format("survey").option("kind", kind).mode("append").save(path)
    want = sorted(((c, n, d or (None if kind != "geojson" else d), *x) for c, n, d, *x in ROWS), key=str)
    more = {"multiline": "true"} if kind == "delimited" else {}
    assert rows(load(s, path, kind, **more)) == want
    df.limit(1).write.format("survey").option("kind", kind).mode("append").save(path)
    assert load(s, path, kind, **more).count() == 4
    df.limit(0).write.format("survey").option("kind", kind).mode("overwrite").save(path)
    assert load(s, path, kind, **more).count() == 0
    assert survey.vacuum(path) > 0 and load(s, path, kind, **more).count() == 0


def test_ranges_take_each_line_once(s, tmp_path):
    lines = ["lon,lat,prof,Code Lac"] + [f"{i}.5,4{'4' * (i % 7)},{i % 9},c{i}" for i in range(60)]
    for end, last in (("\n", ""), ("\r\n", "\r\n")):
        path = tmp_path / f"a{len(end)}.csv"
        path.write_bytes(("﻿" + end.join(lines) + last).encode())
        whole = rows(load(s, str(path), "delimited"))
        assert len(whole) == 60 and whole[0][0].startswith("c")
        reader = survey._Reader({"path": str(path)})
        for size in (*range(1, 40), 97, 1000):
            reader.split = size
            got = [r for p in reader.partitions() for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            assert sorted(got, key=str) == whole, size


def test_encodings_headers_and_bad_numbers(s, tmp_path):
    (tmp_path / "a.txt").write_bytes("Longitude;LATITUDE;Profondeur;Nom\n1,5;2;3;é\n".encode() + "x;2;;œuf\n".encode("cp1252") + b"1;2;3;\x81\n\n1\n")
    (tmp_path / "_b.txt").write_bytes(b"no;header\n")
    got = [(r.name, r.lon, r.lat, r.depth) for r in load(s, str(tmp_path), "delimited").collect()]
    assert got == [("é", 1.5, 2.0, 3.0), ("œuf", None, 2.0, None), ("\x81", 1.0, 2.0, 3.0), (None, 1.0, None, None)]
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="no column for lon"):
        load(s, str(tmp_path / "c.csv"), "delimited").count()
    (tmp_path / "d.csv").write_text("")
    assert load(s, str(tmp_path / "d.csv"), "delimited").count() == 0


def test_largest_member(s, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("small.csv", "lon,lat,depth\n1,2,3\n")
        z.writestr("large.tab", "lon\tlat\tdepth\n1\t2\t3\n4\t5\t6\n")
        z.writestr("readme.md", "x" * 999)
    assert load(s, str(tmp_path), "zip").count() == 2 and load(s, str(tmp_path), "zip", members="all").count() == 3


def test_features_in_blocks_of_any_size():
    each = [{"type": "Feature", "properties": {"name": "é]},{" * k}, "geometry": {"type": "Point", "coordinates": [k, 1.5]}} for k in range(7)]
    text = json.dumps({"type": "FeatureCollection", "crs": {"x": [1]}, "features": each}, ensure_ascii=False, indent=1).encode()
    for size in (1, 3, 50, 10_000):
        assert list(survey.features(io.BytesIO(text), size)) == each
    assert list(survey.features(io.BytesIO(json.dumps(each[2]).encode()))) == [each[2]]
    assert list(survey.features(io.BytesIO(b'{"type":"Point","coordinates":[1,2]}')))[0]["geometry"]["coordinates"] == [1, 2]
    with pytest.raises(ValueError, match="within a feature"):
        list(survey.features(io.BytesIO(text[:-40])))


def test_filters_are_the_readers(s, tmp_path):
    df, path = s.range(100).select(F.concat(F.lit("c"), F.col("id") % 3).alias("code"), F.lit(None).cast("string").alias("name"), F.lit("d").alias("date"), F.col("id").cast("double").alias("lon"), F.lit(1.0).alias("lat"), F.when(F.col("id") % 5 > 0, F.col("id") * 0.5).alias("depth")), str(tmp_path / "t")
    df.write.format("survey").mode("append").save(path)
    asked = "depth > 10 and lon <= 90 and code in ('c1', 'c2') and name is null"
    found = load(s, path, "delimited").where(asked)
    assert rows(found) == rows(df.where(asked)) and found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "depth" not in plan.split("Filter", 1)[1].split("\n")[0] and "isnull(name" in plan


def test_aborted_and_killed_writes_leave_nothing(s, tmp_path):
    path = str(tmp_path / "t")
    df = s.range(50).select(F.lit("a").alias("code"), F.lit("b").alias("name"), F.lit("d").alias("date"), F.col("id").cast("double").alias("lon"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("depth"))
    df.write.format("survey").mode("append").save(path)
    bad = df.repartition(3).withColumn("depth", F.when(F.col("lon") == 49, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("depth")))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("survey").mode("append").save(path)
    assert load(s, path, "delimited").count() == 50
    survey.vacuum(path)  # a task that was still running may have staged its file after the abort
    assert load(s, path, "delimited").count() == 50 and not [f for f in os.listdir(path) if "staging" in f]
    # A task that ran and a job that died before, or within, its commit.
    writer = survey._Writer({"path": path}, df.schema, False)
    batch = pa.RecordBatch.from_pydict({"code": ["z"], "name": ["z"], "date": ["z"], "lon": [1.0], "lat": [1.0], "depth": [1.0]})
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))
    assert load(s, path, "delimited").count() == 50
    writer.commit([again, None])
    assert load(s, path, "delimited").count() == 51 and first.name != again.name
    assert not [f for f in os.listdir(path) if "staging" in f]
