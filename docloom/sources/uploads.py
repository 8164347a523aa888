"""Uploaded files as a Spark data source: read in parts with filters pushed down, written so that a write shows as a whole or not at all.

    register(spark)
    spark.read.format("uploads").load(folder).where("mime = 'image/png' and length < 20971520")
    results.write.format("uploads").mode("append").save(folder)

A row is a file: name (its path below the folder), mime (by its ending), length, content. Reading lists the folder once and deals the files
to parts by size; filters on name, mime and length are settled on the list, before a byte of content is read. A schema without content
(`spark.read.schema("name string, length long")`) reads the list alone. Files stay below 2 GB.

What is written goes into packs, Parquet files of many uploads, so that a table of small files stays a few large ones; with pack=false each row
becomes a file. Readers take both, and open of a pack only the row groups that a filter leaves.

A task writes its files to a folder of its own below `_staging`. The commit moves them to their places and then puts down a
manifest named `_committed_<id>`; readers take the files that manifests list (all files, where there are none, as in a folder that others
fill). A task that fails deletes its folder, an abort that of all tasks. What a driver that dies leaves in `_staging` no
reader looks at; clear_staging deletes it. Texts (any mime text/*, application/json) can be masked on their way out: see Mask.

Folders are reached through pyarrow's file systems (file, s3, gs, hdfs, ...), by drivers and tasks alike.
"""

from __future__ import annotations

import json
import mimetypes
import posixpath
import re
import time
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from .records import IDENTIFIERS

SCHEMA = "name string, mime string, length long, content binary"
PART_BYTES = 32 << 20
GRACE = 15  # tenths of a second that an abort waits for tasks to stop
GROUP_BYTES, GROUP_ROWS = 8 << 20, 4096  # of a pack
STAGING, COMMITTED, PACK = "_staging", "_committed_", ".pack"
KINDS = {"name": pa.string(), "mime": pa.string(), "length": pa.int64(), "content": pa.binary()}
IDENTIFIER = re.compile(IDENTIFIERS)


def mask_text(text: str, shown: int = 4) -> str:
    """Letters and digits of identifiers hidden but for the last few of each."""
    hide = lambda m: re.sub("[0-9A-Za-z]", "X", m[0][:-shown]) + m[0][-shown:]
    return IDENTIFIER.sub(hide, text)


def mime_of(name: str) -> str:
    return mimetypes.guess_type(name)[0] or "application/octet-stream"


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and folder of a path or URI."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), posixpath.abspath(path)


def _join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def safe_name(name: str) -> str:
    """The name if it stays below the folder and isn't one of the source's own."""
    parts = (name or "").split("/")
    if not name or any(p in ("", ".", "..") for p in parts) or parts[0].startswith("_"):
        raise ValueError(f"not a name for a file: {name!r}")
    return name


@dataclass
class Part(InputPartition):
    files: list[tuple[str, int]]


#: What a pushed filter says of a listed value.
TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b, StringStartsWith: lambda a, b: a.startswith(b)}


class UploadsReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):  # noqa: N802 the name is Spark's
        for f in filters:
            attribute = getattr(f, "attribute", ())
            if type(f) in TESTS and len(attribute) == 1 and attribute[0] in ("name", "mime", "length") and getattr(f, "value", None) is not None:
                self.tests.append((attribute[0], type(f), f.value))
            else:
                yield f

    def listed(self) -> list[tuple[str, int]]:
        system, folder = place_of(self.options["path"])
        found = {f.path[len(folder.rstrip("/")) + 1 :]: f.size for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if f.type == fs.FileType.File}
        manifests = [n for n in found if n.startswith(COMMITTED)]
        if manifests:
            found = {n: found[n] for m in manifests for n in json.loads(system.open_input_stream(_join(folder, m)).read()) if n in found}
        return sorted((n, s) for n, s in found.items() if not n.startswith("_"))

    def partitions(self):
        fits = lambda name, size: all(TESTS[kind]({"name": name, "mime": mime_of(name), "length": size}[column], value) for column, kind, value in self.tests)
        most, parts, room = int(self.options.get("partbytes", PART_BYTES)), [], 0
        for name, size in self.listed():
            if name.endswith(PACK) or fits(name, size):
                if not parts or room < size:
                    parts.append(Part([]))
                    room = most
                parts[-1].files.append((name, size))
                room -= size + 1024
        return parts or [Part([])]

    def read(self, partition):
        system, folder = place_of(self.options["path"])
        schema = pa.schema([(c, KINDS[c]) for c in self.columns])
        for name, size in partition.files:
            if name.endswith(PACK):
                yield from self._unpacked(system, _join(folder, name), schema)
                continue
            row = {"name": name, "mime": mime_of(name), "length": size}
            if "content" in self.columns:
                row["content"] = system.open_input_stream(_join(folder, name)).read()
            yield pa.RecordBatch.from_pylist([row], schema)

    def _unpacked(self, system: fs.FileSystem, path: str, schema: pa.Schema):
        with system.open_input_file(path) as file:
            pack = pq.ParquetFile(file)
            for group in range(pack.num_row_groups):
                known = pack.read_row_group(group, columns=["name", "mime", "length"])
                fits = [all(TESTS[kind](row[column], value) for column, kind, value in self.tests) for row in known.to_pylist()]
                if any(fits):
                    got = pack.read_row_group(group, columns=self.columns).select(self.columns).cast(schema)
                    yield from got.filter(pa.array(fits)).to_batches()


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class UploadsWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = options["path"], columns, overwrite
        self.mask = options.get("mask", "true").lower() == "true"
        self.pack = options.get("pack", "true").lower() == "true"
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        system, folder = place_of(self.path)
        own = f"{STAGING}/{self.job}/{uuid.uuid4().hex}"
        rows = self._rows(iterator)
        try:
            return Written(own, self._packed(system, folder, own, rows) if self.pack else self._loose(system, folder, own, rows))
        except BaseException:
            _delete(system, _join(folder, own))
            raise

    def _rows(self, iterator):
        for row in iterator:
            got = row.asDict() if hasattr(row, "asDict") else dict(zip(self.columns, row, strict=True))
            name, content = safe_name(got["name"]), bytes(got["content"] or b"")
            if self.mask and (mime_of(name).startswith("text/") or mime_of(name) == "application/json"):
                content = mask_text(content.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")
            yield name, content

    def _loose(self, system: fs.FileSystem, folder: str, own: str, rows) -> list[str]:
        names = []
        for name, content in rows:
            target = _join(folder, f"{own}/{name}")
            system.create_dir(posixpath.dirname(target), recursive=True)
            with system.open_output_stream(target) as out:
                out.write(content)
            names.append(name)
        return names

    def _packed(self, system: fs.FileSystem, folder: str, own: str, rows) -> list[str]:
        name, writer, held, size = f"{uuid.uuid4().hex}{PACK}", None, [], 0

        def group():
            columns = [[n for n, _ in held], [mime_of(n) for n, _ in held], [len(c) for _, c in held], [c for _, c in held]]
            writer.write_table(pa.table({c: pa.array(v, KINDS[c]) for c, v in zip(KINDS, columns, strict=True)}))

        for row in rows:
            if writer is None:
                system.create_dir(_join(folder, own), recursive=True)
                out = system.open_output_stream(_join(folder, f"{own}/{name}"))
                writer = pq.ParquetWriter(out, pa.schema(list(KINDS.items())), compression="zstd")
            held.append(row)
            size += len(row[1])
            if size >= GROUP_BYTES or len(held) >= GROUP_ROWS:
                group()
                held, size = [], 0
        if writer is None:
            return []
        if held:
            group()
        writer.close()
        out.close()
        return [name]

    def commit(self, messages):
        system, folder = place_of(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        system.create_dir(folder, recursive=True)
        have = {f.path[len(folder.rstrip("/")) + 1 :] for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if f.type == fs.FileType.File}
        twice = len(names) - len(set(names)) or (0 if self.overwrite else len(have & set(names)))
        if twice:
            self.abort(messages)
            raise ValueError(f"{twice} names are there already or twice in the rows")
        # Without a manifest yet, the files that are there become the first one: from now on manifests say what counts.
        before = [n for n in have if n.startswith(COMMITTED)]
        if not before and not self.overwrite and (others := sorted(n for n in have if not n.startswith("_"))):
            _put(system, _join(folder, f"{COMMITTED}{uuid.uuid4().hex}"), others)
        elif not before:
            _put(system, _join(folder, f"{COMMITTED}{uuid.uuid4().hex}"), [])
        for m in done:
            for name in m.names:
                target = _join(folder, name)
                system.create_dir(posixpath.dirname(target), recursive=True)
                system.move(_join(folder, f"{m.folder}/{name}"), target)
        _put(system, _join(folder, f"{COMMITTED}{self.job}"), names)
        if self.overwrite:
            for name in have - set(names):
                if not name.startswith(STAGING):
                    system.delete_file(_join(folder, name))
        self._clear(system, folder)

    def abort(self, messages):
        # Tasks that are being stopped may still write for a moment.
        for _ in range(GRACE):
            self._clear(*place_of(self.path))
            time.sleep(0.1)

    def _clear(self, system: fs.FileSystem, folder: str) -> None:
        _delete(system, _join(folder, f"{STAGING}/{self.job}"))
        staging = _join(folder, STAGING)
        if system.get_file_info(staging).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(staging)):
            system.delete_dir(staging)


def _put(system: fs.FileSystem, path: str, names: list[str]) -> None:
    with system.open_output_stream(f"{path}.tmp") as out:
        out.write(json.dumps(names).encode())
    system.move(f"{path}.tmp", path)


def _delete(system: fs.FileSystem, folder: str) -> None:
    if system.get_file_info(folder).type == fs.FileType.Directory:
        system.delete_dir(folder)


class Uploads(DataSource):
    """The source "uploads". Options: path; partbytes, how much a part reads; mask, false to write identifiers as they
    are; pack, false to write a file for each row. Names are compared with those of loose files that are there, not with packed ones."""

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> UploadsReader:
        return UploadsReader(dict(self.options), list(schema.fieldNames()))

    def writer(self, schema, overwrite: bool) -> UploadsWriter:
        missing = {"name", "content"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"to be written, uploads need {', '.join(sorted(missing))}")
        return UploadsWriter(dict(self.options), list(schema.fieldNames()), overwrite)


def clear_staging(path: str) -> None:
    """Delete what stopped jobs have left; no write to the folder may be under way."""
    system, folder = place_of(path)
    _delete(system, _join(folder, STAGING))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, filters included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Uploads)
