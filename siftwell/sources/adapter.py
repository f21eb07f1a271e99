"""Source adapters: a Spark data source over collected record files.

``spark.read.format("collected")`` and ``readStream`` give ``(ordinal, source_code, raw)`` rows from
folders of JSON lines, whose files end in ``suffix`` (``.jsonl``). The folder may be
mounted or on any store that Arrow opens (``hdfs://``, ``s3://``, ...). Nothing is fetched from the network.

The ordinal puts records in order of arrival: the number of the file in the order in which files came,
and the byte at which the line begins. Large files are read in ranges of ``range_bytes`` by several tasks.

A stream keeps a log of the files it has seen, in the folder named by the option ``log``, which must be
as lasting as the checkpoint. An entry has path, modification time and size; the offset is the number of
entries, so late files get later offsets whatever their names are, and a replayed batch reads the same
files. A file that has changed is a new arrival. Files should be moved into the folder whole.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import RAW_SCHEMA

LINE_BITS = 36  # of the ordinal, for the place in a file
RANGE_BYTES = 64 << 20


class _LocalFiles:
    """Files of a folder that driver and executors have mounted."""

    def __init__(self, folder: str):
        self.root = folder.removeprefix("file://").replace("file:", "", 1)

    def listed(self) -> list[tuple[str, int, int]]:
        if not os.path.isdir(self.root):
            return []
        with os.scandir(self.root) as entries:
            return [(e.path, e.stat().st_mtime_ns, e.stat().st_size) for e in entries if e.is_file()]

    def open(self, path: str):
        return open(path, "rb")

    def write(self, name: str, content: bytes) -> None:
        """A file that appears as a whole."""
        os.makedirs(self.root, exist_ok=True)
        with open(f"{self.root}/{name}.writing", "wb") as out:
            out.write(content)
        os.replace(f"{self.root}/{name}.writing", f"{self.root}/{name}")


class _RemoteFiles:
    """Files of any store that Arrow opens."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs = fs
        self.system, self.root = fs.FileSystem.from_uri(folder)

    def listed(self) -> list[tuple[str, int, int]]:
        infos = self.system.get_file_info(self.fs.FileSelector(self.root, allow_not_found=True))
        return [(i.path, int(i.mtime_ns or 0), i.size) for i in infos if i.type == self.fs.FileType.File]

    def open(self, path: str):
        return io.BufferedReader(self.system.open_input_file(path), 1 << 20)

    def write(self, name: str, content: bytes) -> None:
        self.system.create_dir(self.root, recursive=True)
        with self.system.open_output_stream(f"{self.root}/{name}.writing") as out:
            out.write(content)
        self.system.move(f"{self.root}/{name}.writing", f"{self.root}/{name}")


def _files(folder: str) -> _LocalFiles | _RemoteFiles:
    return _RemoteFiles(folder) if "://" in folder and not folder.startswith("file:") else _LocalFiles(folder)


def _listed(folder: str, suffix: str) -> list[tuple[str, int, int]]:
    """``(path, modification time in ns, size)`` of the record files of a folder by time and name."""
    return sorted((f for f in _files(folder).listed() if f[0].endswith(suffix)), key=lambda f: (f[1], f[0]))


class _Range(InputPartition):
    def __init__(self, number: int, path: str, start: int, end: int):
        self.number, self.path, self.start, self.end = number, path, start, end


def _ranges(number: int, path: str, size: int, range_bytes: int) -> list[_Range]:
    return [_Range(number, path, at, min(at + range_bytes, size)) for at in range(0, size, range_bytes)]


def _rows(folder: str, source: str, part: _Range) -> Iterator[tuple[int, str, dict]]:
    """The records whose lines begin inside the range."""
    with _files(folder).open(part.path) as lines:
        at = max(part.start - 1, 0)
        lines.seek(at)
        if part.start:
            at += len(lines.readline())  # the rest of a line that begins before the range, or just its end
        while at < part.end:
            line = lines.readline()
            if not line:
                return
            if line.strip():
                record = json.loads(line)
                fields = {k: v if isinstance(v, str) or v is None else json.dumps(v, sort_keys=True) for k, v in record.items()}
                yield (part.number << LINE_BITS) + at, fields.get("source_code") or source, fields
            at += len(line)


class _Options:
    def __init__(self, options):
        self.folder, self.source = options["path"], options.get("source", "unknown")
        self.range_bytes, self.log = int(options.get("range_bytes", RANGE_BYTES)), options.get("log")
        self.suffix = options.get("suffix", ".jsonl")

    def read(self, partition):
        return _rows(self.folder, self.source, partition)


class _Reader(_Options, DataSourceReader):
    def partitions(self):
        return [r for n, (path, _, size) in enumerate(_listed(self.folder, self.suffix)) for r in _ranges(n, path, size, self.range_bytes)]


class _StreamReader(_Options, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        if not self.log:
            raise ValueError("a stream of collected files needs the option log, a folder that lasts as long as the checkpoint")
        self.entries = self._read_log()

    def _read_log(self) -> list[tuple[str, int, int]]:
        """All entries in order. Every file of the log is named by the number of its first entry."""
        files = _files(self.log)
        entries: list[tuple[str, int, int]] = []
        for name in sorted(path for path, _, _ in files.listed() if path.endswith(".json")):
            with files.open(name) as part:
                entries += [tuple(e) for e in json.loads(part.read())]
        return entries

    def initialOffset(self):
        return {"files": 0}

    def latestOffset(self):
        seen = set(self.entries)
        fresh = [f for f in _listed(self.folder, self.suffix) if f not in seen]
        if fresh:
            _files(self.log).write(f"{len(self.entries):012d}.json", json.dumps(fresh).encode())
            self.entries += fresh
        return {"files": len(self.entries)}

    def partitions(self, start, end):
        if end["files"] > len(self.entries):
            self.entries = self._read_log()
        return [r for n in range(start["files"], end["files"])
                for r in _ranges(n, self.entries[n][0], self.entries[n][2], self.range_bytes)]

    def commit(self, end):
        pass


class CollectedRecords(DataSource):
    """Register with ``spark.dataSource.register(CollectedRecords)``."""

    @classmethod
    def name(cls):
        return "collected"

    def schema(self):
        return RAW_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)
