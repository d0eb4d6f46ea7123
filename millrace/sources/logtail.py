"""A data source of log files of lines that grow at their ends: `spark.read.format("log_lines")` and `spark.readStream`.

Files of a folder are read by byte ranges, cut at line feeds, in as many partitions as their bytes ask for. As a stream, the
offset is how far each file was read, so that lines appended to a file, not only new files, are told once. A last line without
its line feed is being written and waits. Paths are those that pyarrow reaches (file, hdfs, s3, gs) or local ones.

Rows: path, at (the line's first byte), value. Options: path, range_bytes, suffix (of the files' names).
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a partition, about.
RANGE_BYTES = 8 << 20


def _open(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str = "") -> dict[str, int]:
    """Files below the path that end in suffix, in order of their names, with their sizes."""
    from pyarrow import fs

    store, place = _open(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.File:
        return {place: info.size}
    found = store.get_file_info(fs.FileSelector(place, allow_not_found=True, recursive=True))
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith((".", "_"))}


class Range(InputPartition):
    """Bytes of a file, [start, stop); the lines that begin there are its rows. Bytes from `end` on don't count."""

    def __init__(self, file: str, start: int, stop: int, end: int):
        self.file, self.start, self.stop, self.end = file, start, stop, end


def ranges(begun: dict[str, int], ends: dict[str, int], size: int) -> list[Range]:
    return [Range(f, a, min(a + size, end), end) for f, end in ends.items() for a in range(begun.get(f, 0), end, size)]


class _Lines:
    def __init__(self, options):
        self.path, self.suffix = options.get("path"), options.get("suffix", "")
        self.size = int(options.get("range_bytes", RANGE_BYTES))
        if not self.path or self.size < 1:
            raise ValueError("log_lines needs a path, and ranges of a byte or more")

    def read(self, part: Range | None):
        if part is None:  # Spark asks once where there is no partition
            return
        store, _ = _open(self.path)
        with store.open_input_file(part.file) as file:
            at = part.start
            if at:  # a line that began before belongs to the range before
                file.seek(at - 1)
                at += len(_line(file, part.end)) - 1
            file.seek(at)
            while at < part.stop:
                line = _line(file, part.end - at)
                if not line.endswith(b"\n"):
                    return  # not whole yet
                yield (part.file, at, line[:-1].decode("utf-8", "replace"))
                at += len(line)


def _line(file, most: int) -> bytes:
    """The file's bytes up to and with the next line feed, at most so many."""
    found, start = [], file.tell()
    while most > 0:
        block = file.read(min(most, 1 << 16))
        if not block:
            break
        stop = block.find(b"\n")
        found.append(block if stop < 0 else block[: stop + 1])
        most -= len(found[-1])
        if stop >= 0:
            break
    line = b"".join(found)
    file.seek(start + len(line))
    return line


class LinesReader(_Lines, DataSourceReader):
    def partitions(self):
        return ranges({}, listed(self.path, self.suffix), self.size)


class LinesStream(_Lines, DataSourceStreamReader):
    """Offsets are {file: bytes read}. A file's end is behind its last line feed."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, _ = _open(self.path)
        return {f: self._whole(store, f, size) for f, size in listed(self.path, self.suffix).items()}

    def _whole(self, store, file: str, size: int) -> int:
        with store.open_input_file(file) as source:
            at = size
            while at > 0:
                start = max(0, at - (1 << 16))
                source.seek(start)
                stop = source.read(at - start).rfind(b"\n")
                if stop >= 0:
                    return start + stop + 1
                at = start
        return 0

    def partitions(self, start: dict, end: dict):
        return ranges(start, {f: stop for f, stop in end.items() if stop > start.get(f, 0)}, self.size)

    def commit(self, end: dict) -> None:
        pass


class LogLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return "path string, at long, value string"

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)

    def streamReader(self, schema) -> LinesStream:
        return LinesStream(self.options)


def register(spark) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(LogLines)
