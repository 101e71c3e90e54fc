"""Soundings as files, by a Spark data source: delimited text, zip archives and GeoJSON, to read and to write.

    register(spark)
    spark.read.format("survey").option("kind", "delimited").load(path)
    df.write.format("survey").option("kind", "geojson").mode("append").save(path)

Options: ``kind`` (delimited, zip or geojson), ``delimiter`` (for reading the commonest in a file's header, for writing ;),
``decimal`` (for writing , or .), ``split_bytes`` of delimited text, ``members`` (of an archive the largest one or all),
``multiline`` (quoted fields may hold line ends; then a file is not split), ``licence`` of written collections.

Reading. Delimited files are cut into byte ranges, each a partition; a range takes the lines that begin in it.
Headers are resolved by synonyms, numbers may have decimal commas. A line is UTF-8 where that is valid, else Windows-1252, else
Latin-1, so that a range needs no other to know its text. An archive is one partition and decompresses its members as a
stream, a collection is one partition and is parsed a feature at a time. Filters are evaluated before rows leave the
reader. Rows leave it in Arrow batches.

Writing in two phases. A task writes its file under ``_staging-<id>``. The commit moves the files to names that nobody reads
yet, and then puts a manifest in place that lists all files of the table; readers go by the newest manifest. So a job that
is aborted or killed at any time, or tasks that are run twice, leave no row to be read; aborting deletes the staging folder, and ``vacuum``
what a task that outlives its job stages after that. Folders without a manifest are
read by listing; names that begin with _ or . are left out.

Files are reached through Arrow's file systems, by URI.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import math
import re
import time
import unicodedata
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from fathom import model as M

COLUMNS = ("code", "name", "date", "lon", "lat", "depth")
NUMBERS = ("lon", "lat", "depth")
ENDINGS = {"delimited": (".csv", ".txt", ".tab", ".tsv"), "zip": (".zip",), "geojson": (".geojson", ".json")}
MANIFEST = "_manifest-"
BATCH = 8192


def place(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it, of a URI or a local path."""
    if re.match(r"file:/+", path):
        path = "/" + re.sub(r"^file:/+", "", path)
    return fs.FileSystem.from_uri(path)


def decode_line(raw: bytes) -> str:
    for name in ("utf-8", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


def normal(name: str) -> str:
    return re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower())


def resolved(header: list[str]) -> list[int | None]:
    """Where each of COLUMNS stands in a header; only code, name and date may lack."""
    have = {normal(h): i for i, h in reversed(list(enumerate(header)))}
    at = [next((have[n] for n in M.HEADER_SYNONYMS[c] if n in have), None) for c in COLUMNS]
    if lacking := [c for c, i in zip(COLUMNS, at, strict=True) if i is None and c in NUMBERS]:
        raise ValueError(f"no column for {', '.join(lacking)} in {header}")
    return at


def number(value) -> float | None:
    """A number, possibly with a decimal comma; nothing where there is none."""
    if isinstance(value, int | float):
        return float(value)
    text = (value or "").strip().replace(",", ".")
    return float(text) if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", text) else None


def commonest(line: str) -> str:
    best = max(M.DELIMITERS, key=line.count)
    return best if line.count(best) else "\t"


_TESTS = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b,
}


def test_of(f: Filter):
    """(column, test) of a filter that the reader evaluates, else nothing. Nulls pass none."""
    column = getattr(f, "attribute", ("",))
    if len(column) != 1 or column[0] not in COLUMNS:
        return None
    k = COLUMNS.index(column[0])
    if isinstance(f, IsNotNull):
        return k, lambda a: True
    value = getattr(f, "value", None)
    # Comparisons of a NaN are Spark's to make.
    if type(f) not in _TESTS or value is None or isinstance(value, float) and math.isnan(value):
        return None
    test = _TESTS[type(f)]
    return k, lambda a: a != a or test(a, value)


@dataclass
class Piece(InputPartition):
    """A file, or the part of it from ``begin`` to before ``end``."""

    path: str
    begin: int
    end: int | None

    def __init__(self, path: str, begin: int = 0, end: int | None = None) -> None:
        super().__init__(None)
        self.path, self.begin, self.end = path, begin, end


def committed(files: fs.FileSystem, base: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """The files of a table with their sizes: by its newest manifest, else all in its folder; or one file."""
    top = files.get_file_info(base)
    if top.type == fs.FileType.File:
        return [(base, top.size)]
    found = [x for x in files.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.type == fs.FileType.File]
    manifests = sorted(x.path for x in found if x.base_name.startswith(MANIFEST))
    if manifests:
        with files.open_input_stream(manifests[-1]) as f:
            names = set(json.loads(f.read()))
        return sorted((x.path, x.size) for x in found if x.base_name in names)
    return sorted((x.path, x.size) for x in found if x.base_name[0] not in "_." and x.base_name.lower().endswith(endings))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"], options.get("kind", "delimited")
        self.delimiter, self.split = options.get("delimiter"), int(options.get("split_bytes", 64 << 20))
        self.members, self.multiline = options.get("members", "largest"), options.get("multiline", "false") == "true"
        self.tests: list = []
        if self.kind not in ENDINGS:
            raise ValueError(f"kind is one of {', '.join(ENDINGS)}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if (test := test_of(f)) is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[InputPartition]:
        files, base = place(self.path)
        out = []
        for path, size in committed(files, base, ENDINGS[self.kind]):
            if self.kind == "delimited" and not self.multiline:
                out += [Piece(path, b, min(b + self.split, size)) for b in range(0, size, self.split)]
            else:
                out.append(Piece(path))
        return out or [Piece("")]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        rows = getattr(self, f"_{self.kind}")(place(self.path)[0], piece) if piece.path else iter(())
        rows = (r for r in rows if all(r[k] is not None and test(r[k]) for k, test in self.tests))
        kinds = [pa.float64() if c in NUMBERS else pa.string() for c in COLUMNS]
        while part := list(islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*part, strict=True), kinds, strict=True)], names=list(COLUMNS))

    def _table(self, header: str, lines: Iterable[str]) -> Iterator[tuple]:
        """Rows of lines, of which the header is not one."""
        csv.field_size_limit(1 << 30)
        sep = self.delimiter or commonest(header)
        at = resolved(next(csv.reader([header], delimiter=sep)))
        for fields in csv.reader(lines, delimiter=sep):
            if fields:
                got = [fields[i] if i is not None and i < len(fields) else None for i in at]
                yield (*(x or None for x in got[:3]), *map(number, got[3:]))

    def _stream(self, raw: Iterable[bytes]) -> Iterator[tuple]:
        lines = map(decode_line, raw)
        header = next(lines, "").removeprefix("﻿").rstrip("\r\n")
        return self._table(header, lines) if header else iter(())

    def _delimited(self, files: fs.FileSystem, piece: Piece) -> Iterator[tuple]:
        with files.open_input_file(piece.path) as raw:
            f = io.BufferedReader(raw, 1 << 20)
            if piece.end is None:
                yield from self._stream(f)
                return
            header = decode_line(f.readline()).removeprefix("﻿").rstrip("\r\n")
            if piece.begin > f.tell():
                f.seek(piece.begin - 1)  # a line that begins at the very begin is this piece's
                f.readline()

            def lines() -> Iterator[str]:
                while f.tell() < piece.end and (line := f.readline()):
                    yield decode_line(line)

            if header:
                yield from self._table(header, lines())

    def _zip(self, files: fs.FileSystem, piece: Piece) -> Iterator[tuple]:
        with files.open_input_file(piece.path) as raw, zipfile.ZipFile(raw) as z:
            members = [m for m in z.infolist() if m.filename.lower().endswith(ENDINGS["delimited"])]
            if self.members == "largest":
                members = sorted(members, key=lambda m: (m.file_size, m.filename))[-1:]
            for m in members:
                with z.open(m) as f:
                    yield from self._stream(f)

    def _geojson(self, files: fs.FileSystem, piece: Piece) -> Iterator[tuple]:
        with files.open_input_stream(piece.path) as raw:
            for feature in features(raw):
                shape, given = feature.get("geometry") or {}, feature.get("properties") or {}
                if shape.get("type") == "Point" and len(shape.get("coordinates") or ()) >= 2:
                    text = [None if given.get(c) is None else str(given[c]) for c in COLUMNS[:3]]
                    yield (*text, number(shape["coordinates"][0]), number(shape["coordinates"][1]), number(given.get("depth_m", given.get("depth"))))


def features(raw, size: int = 1 << 20) -> Iterator[dict]:
    """Features of a GeoJSON file as they come: of a collection, one feature, or a bare geometry."""
    decoder, parse = codecs.getincrementaldecoder("utf-8-sig")(), json.JSONDecoder()
    text, at, done = "", 0, False

    def more() -> bool:
        """Drop what has been parsed and read on, by as much as is left at least: a feature of any length is parsed a few times only."""
        nonlocal text, at, done
        block = raw.read(max(size, len(text) - at))
        done = not block
        text, at = text[at:] + decoder.decode(block, done), 0
        return not done

    while not (head := re.search(r'"features"\s*:\s*\[', text)) and more():
        pass
    if head is None:
        if text.strip():
            one = json.loads(text)
            yield one if one.get("type") == "Feature" else {"geometry": one, "properties": {}}
        return
    at = head.end()
    gap = re.compile(r"[\s,]*")
    while True:
        at = gap.match(text, at).end()
        if text.startswith("]", at):
            return
        try:
            feature, at = parse.raw_decode(text, at)
        except json.JSONDecodeError:
            if not more():
                raise ValueError("the collection ends within a feature") from None
            continue
        yield feature


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.kind, self.overwrite = options["path"].rstrip("/"), options.get("kind", "delimited"), overwrite
        self.delimiter, self.decimal, self.licence = options.get("delimiter", ";"), options.get("decimal", ","), options.get("licence")
        self.id = uuid.uuid4().hex
        if lacking := set(COLUMNS) - set(schema.names):
            raise ValueError(f"soundings need {', '.join(sorted(lacking))}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return Written(None)
        files, base = place(self.path)
        staging = f"{base}/_staging-{self.id}"
        files.create_dir(staging, recursive=True)
        name = f"part-{uuid.uuid4().hex}{ENDINGS[self.kind][0]}"  # another one for every attempt
        with files.open_output_stream(f"{staging}/{name}") as out:
            rows = (r for b in chain([first], batches) for r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in COLUMNS), strict=True))
            getattr(self, f"_{self.kind}")(out, rows)
        return Written(name)

    def _delimited(self, out, rows: Iterator[tuple]) -> None:
        text = io.TextIOWrapper(out, "utf-8", newline="", write_through=False)
        w = csv.writer(text, delimiter=self.delimiter, lineterminator="\n")
        w.writerow(COLUMNS)
        shown = lambda x: "" if x is None else repr(x).replace(".", self.decimal) if isinstance(x, float) else x
        w.writerows(map(shown, r) for r in rows)
        text.flush()
        text.detach()

    def _zip(self, out, rows: Iterator[tuple]) -> None:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            with z.open("soundings.csv", "w", force_zip64=True) as member:
                self._delimited(member, rows)

    def _geojson(self, out, rows: Iterator[tuple]) -> None:
        head = {"type": "FeatureCollection"} | ({"licence": self.licence} if self.licence else {})
        shown = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
        out.write((shown(head)[:-1] + ',"features":[').encode())
        for k, (code, name, date, lon, lat, depth) in enumerate(rows):
            feature = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [lon, lat]}, "properties": {"code": code, "name": name, "date": date, "depth_m": depth}}
            out.write((",\n" if k else "\n").encode() + shown(feature).encode())
        out.write(b"\n]}")

    def commit(self, messages: list[Written | None]) -> None:
        files, base = place(self.path)
        names = [m.name for m in messages if m is not None and m.name]
        files.create_dir(base, recursive=True)
        before = [] if self.overwrite else [p.rsplit("/", 1)[1] for p, _ in committed(files, base, ENDINGS[self.kind])]
        for name in names:
            files.move(f"{base}/_staging-{self.id}/{name}", f"{base}/_{name}")
        listed = f"{base}/_staging-{self.id}-list"
        with files.open_output_stream(listed) as f:
            f.write(json.dumps(before + [f"_{n}" for n in names]).encode())
        files.move(listed, f"{base}/{MANIFEST}{time.time_ns():020d}")  # from here on they are read
        self._discard(files, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._discard(*place(self.path))

    def _discard(self, files: fs.FileSystem, base: str) -> None:
        staging = f"{base}/_staging-{self.id}"
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)


def vacuum(path: str) -> int:
    """Delete what no reader of the newest manifest reads: overwritten files, older manifests, what killed jobs left. Not while jobs write or read."""
    files, base = place(path)
    kept = {p for p, _ in committed(files, base, ())}
    found = files.get_file_info(fs.FileSelector(base))
    newest = max((x.path for x in found if x.base_name.startswith(MANIFEST)), default=None)
    gone = [x for x in found if newest and x.path not in kept | {newest}]
    for x in gone:
        files.delete_dir(x.path) if x.type == fs.FileType.Directory else files.delete_file(x.path)
    return len(gone)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters evaluated in the reader."""
    spark.dataSource.register(SurveyFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


class SurveyFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "survey"

    def schema(self) -> str:
        return M.SOUNDING

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), schema, overwrite)
