"""CSV members of zip archives as a Spark source (S7, S13): a partition a member, an encoding a file.

    spark.dataSource.register(ZippedCsv)
    spark.read.format("zipcsv").option("encodings", '{"*_old.csv": "latin-1"}').load("/landed/enrolment")

Archives are listed and read through ``pyarrow.fs``, so the path may be local or in any store that
knows, but has to be one that driver and executors both reach.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Rows of a batch.
ROWS = 20_000
#: Fixed value: the encoding of members that aren't UTF-8 and that no pattern names.
FALLBACK = "cp1252"
#: Columns that tell where a row is from.
PLACE = ("archive", "member")


def _open(path: str):
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, place


def _archives(path: str) -> list[str]:
    """The archive, or the archives in a folder, as paths of the same store."""
    from pyarrow import fs

    store, place = _open(path)
    if store.get_file_info(place).type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(place))
    head = path[: len(path) - len(place)] if path.endswith(place) else ""
    return sorted(head + f.path for f in found if f.is_file and f.extension.lower() == "zip")


def decoded(raw: bytes, name: str, encodings: dict[str, str]) -> str:
    """Text of a member: in the encoding of the first pattern that fits its name, else UTF-8, else Windows-1252."""
    for pattern, encoding in encodings.items():
        if fnmatch.fnmatch(name, pattern):
            return raw.decode(encoding)
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode(FALLBACK, "replace")


class Member(InputPartition):
    def __init__(self, archive: str, member: str):
        super().__init__(None)
        self.archive, self.member = archive, member


class MemberReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, members: str, encodings: dict[str, str]):
        self.names, self.path, self.members, self.encodings = schema.fieldNames(), path, members, encodings

    def partitions(self) -> list[InputPartition]:
        out = []
        for archive in _archives(self.path):
            store, place = _open(archive)
            with store.open_input_file(place) as handle, zipfile.ZipFile(handle) as z:
                out += [Member(archive, n) for n in z.namelist() if fnmatch.fnmatch(n.lower(), self.members)]
        return out

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no member fits
            return
        store, place = _open(partition.archive)
        with store.open_input_file(place) as handle, zipfile.ZipFile(handle) as z:
            text = decoded(z.read(partition.member), partition.member, self.encodings)
        rows, where = csv.reader(io.StringIO(text, newline="")), {"archive": partition.archive, "member": partition.member}
        header = {name: i for i, name in reversed(list(enumerate(next(rows, []))))}
        held: list[list[str]] = []
        for row in rows:
            if row:
                held.append(row)
            if len(held) == ROWS:
                yield self._batch(held, header, where)
                held = []
        if held:
            yield self._batch(held, header, where)

    def _batch(self, rows: list[list[str]], header: dict[str, int], where: dict[str, str]) -> pa.RecordBatch:
        columns = []
        for name in self.names:
            at = header.get(name)
            column = [where[name]] * len(rows) if name in where else [None if at is None or at >= len(r) else r[at] for r in rows]
            columns.append(pa.array(column, pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=self.names)


class ZippedCsv(DataSource):
    """Options: ``path`` (an archive or a folder of archives), ``members`` (a pattern of names, ``*.csv``), ``encodings`` (JSON of pattern to encoding).

    Without a schema given, columns are the header's of the first member, and ``archive`` and ``member``. A given schema has
    string columns; those that a member lacks are null in it. A member without rows gives none.
    """

    @classmethod
    def name(cls) -> str:
        return "zipcsv"

    def _reader(self, schema: StructType) -> MemberReader:
        return MemberReader(schema, self.options["path"], self.options.get("members", "*.csv"), json.loads(self.options.get("encodings", "{}")))

    def schema(self) -> StructType:
        reader = self._reader(StructType([]))
        first = next(iter(reader.partitions()), None)
        names: list[str] = []
        if first is not None:
            store, place = _open(first.archive)
            with store.open_input_file(place) as handle, zipfile.ZipFile(handle) as z:
                names = next(csv.reader(io.StringIO(decoded(z.read(first.member), first.member, reader.encodings), newline="")), [])
        return StructType([StructField(n, StringType()) for n in dict.fromkeys([*names, *PLACE])])

    def reader(self, schema: StructType) -> MemberReader:
        return self._reader(schema)
