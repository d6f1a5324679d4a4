"""Zip archives of event exports as a Spark data source: one partition for each archive, inflated as a stream.

``spark.read.format("event_archives").load(path)`` gives the numbered lines of every archive of a folder (or of a glob in
its last part); ``df.write.format("event_archives").save(path)`` writes rows (archive, line_no, line) as archives.
Files are opened through Arrow's file systems, so a folder may be local, on HDFS or in an object store; no archive is
ever one row or one buffer, whatever its size.
"""
from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch
from itertools import islice
from pathlib import PurePosixPath
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Columns of an event export and the name each takes here.
EVENT_COLUMNS = {
    "Année": "year",
    "Numéro": "number",
    "Département": "dep",
    "Code INSEE": "source_code",
    "Nom de la commune": "name",
    "Date de première alerte": "ts",
    "Surface parcourue (m2)": "size",
    "Surface forêt (m2)": "forest_size",
    "Surface maquis garrigues (m2)": "scrub_size",
    "Type de peuplement": "stand_type",
    "Nature": "cause",
}
# How the header line of an event export starts, and the name of the export.
EVENT_HEADER = "Année;Numéro"
EVENT_FILE = "incendies.csv"
LINES = "source string, line_no long, part string, values array<string>"
ARROW_LINES = pa.schema([("source", pa.string()), ("line_no", pa.int64()), ("part", pa.string()), ("values", pa.list_(pa.string()))])
BLOCK = 20_000  # lines of one Arrow batch


def event_member(archive: zipfile.ZipFile) -> str:
    """The export inside an archive, in any folder and any case; of several the first by name."""
    found = sorted(m.filename for m in archive.infolist() if PurePosixPath(m.filename).name.lower() == EVENT_FILE)
    if not found:
        raise ValueError(f"{archive.filename or 'archive'} holds no {EVENT_FILE}")
    return found[0]


def _fields(line: str, sep: str) -> list[str | None]:
    """The fields of one line; what is empty is missing."""
    return [field or None for field in next(csv.reader([line], delimiter=sep), [])]


def numbered(lines: Iterable[str], sep: str = ";", header: str = EVENT_HEADER) -> Iterator[tuple[int, str, list[str | None]]]:
    """(number, part, values) of each line: "preamble" with its own fields, "header", or "record" with the values of
    EVENT_COLUMNS by the position their names have in the header, so unnamed columns shift nothing."""
    places: list[int | None] | None = None
    for number, line in enumerate(lines):
        line = line.rstrip("\r\n")
        if places is None and line.startswith(header):
            names = _fields(line, sep)
            places = [names.index(c) if c in names else None for c in EVENT_COLUMNS]
            yield number, "header", []
        elif places is None:
            yield number, "preamble", [line, " ".join(f or "" for f in _fields(line, sep))]
        elif line:
            values = _fields(line, sep)
            yield number, "record", [values[p] if p is not None and p < len(values) else None for p in places]


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path inside it; a path without a scheme, or of scheme file, is local."""
    if re.match(r"(?!file:)[a-z0-9+.-]+://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


def listed(path: str) -> list[str]:
    """The archives of a folder, or those whose names match the last part of the path."""
    system, place = file_system(path)
    scheme = path[: -len(place)] if path.endswith(place) else ""
    if system.get_file_info(place).type == fs.FileType.Directory:
        place = place.rstrip("/") + "/*.zip"
    folder, pattern = place.rsplit("/", 1)
    files = system.get_file_info(fs.FileSelector(folder or "/"))
    return sorted(scheme + f.path for f in files if f.type == fs.FileType.File and fnmatch(f.base_name, pattern))


@dataclass
class Archive(InputPartition):
    path: str


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: Sequence[str]):
        self.paths = paths

    def partitions(self) -> list[Archive]:
        found = [Archive(file) for path in self.paths for file in listed(path)]
        if not found:
            raise FileNotFoundError(f"no archives at {', '.join(self.paths)}")
        return found

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        system, place = file_system(partition.path)
        source = PurePosixPath(place).name
        with system.open_input_file(place) as file, zipfile.ZipFile(file) as archive, archive.open(event_member(archive)) as member:
            rows = numbered(io.TextIOWrapper(member, encoding="utf-8"))
            while block := list(islice(rows, BLOCK)):
                number, part, values = zip(*block)
                yield pa.record_batch([pa.array([source] * len(block)), pa.array(number), pa.array(part), pa.array(values, pa.list_(pa.string()))], schema=ARROW_LINES)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class ArchiveWriter(DataSourceWriter):
    """Each attempt of a task writes into a folder of its own; the archives move to their place when all tasks are done, so
    a lost or repeated attempt adds no archive. An archive of the same name is replaced."""

    def __init__(self, path: str):
        self.path, self.staging = path.rstrip("/"), f"{path.rstrip('/')}/_staging-{uuid4().hex}"

    def write(self, iterator) -> Staged:
        """Rows sorted by archive, then by line; an archive's rows are all in one task."""
        system, place = file_system(f"{self.staging}/{uuid4().hex}")
        system.create_dir(place)
        names: list[str] = []
        output = archive = member = None

        def close():
            for opened in (member, archive, output):
                if opened is not None:
                    opened.close()

        for row in iterator:
            if not names or row.archive != names[-1]:
                close()
                names.append(row.archive)
                output = system.open_output_stream(f"{place}/{row.archive}")
                archive = zipfile.ZipFile(output, "w", zipfile.ZIP_DEFLATED)
                member = archive.open(EVENT_FILE, "w", force_zip64=True)
            member.write(row.line.encode("utf-8") + b"\r\n")
        close()
        if len(set(names)) < len(names):
            raise ValueError("rows of an archive must follow each other: sort them by archive")
        return Staged(place, names)

    def commit(self, messages) -> None:
        system, place = file_system(self.path)
        written = [(m.folder, name) for m in messages if m is not None for name in m.names]
        if len({name for _, name in written}) < len(written):
            self.abort(messages)
            raise ValueError("rows of an archive lie in several tasks: repartition them by archive")
        for folder, name in written:
            system.move(f"{folder}/{name}", f"{place}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        system, place = file_system(self.staging)
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


class EventArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_archives"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> ArchiveReader:
        several = self.options.get("paths")
        return ArchiveReader(json.loads(several) if several else [self.options["path"]])

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def archive_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(source, line_no, part, values) of all lines of all archives, one task for each archive."""
    spark.dataSource.register(EventArchives)
    reader = spark.read.format("event_archives")
    return reader.load(paths) if isinstance(paths, str) else reader.option("paths", json.dumps(list(paths))).load()


def write_archives(lines: DataFrame, path: str) -> None:
    """Rows (archive, line_no, line) as zip archives, the lines of each in order of their numbers."""
    lines.sparkSession.dataSource.register(EventArchives)
    rows = lines.select("archive", "line_no", "line").repartition("archive").sortWithinPartitions("archive", "line_no")
    rows.write.format("event_archives").mode("append").save(path)
