"""Log lines from the text files that running attempts write.

A Python data source, ``raw_lines``, for batch and stream. Files lie at
``<root>/<run_id>/<attempt>/<stream>``, where the stream is ``stdout`` or ``stderr`` with
any ending; one folder level more, as other writers make it, is fine. Rows are ``(run_id,
attempt, seq, stream, line)``. ``seq`` is twice the byte offset of the line, plus one for
``stderr``, so that it is unique within an attempt; between the two streams it says nothing
about time.

A row ends after a line feed. So that a line of any length is many small rows, a row also
ends at a multiple of ``CELL`` bytes when the cell before it has no line feed (moved on to
the next character of UTF-8). Whether a byte ends a row depends on the bytes before it and
on nothing else. A task has a range of a file and emits the rows that end in it; it looks
back for where the first of them begins. So the rows are the same for any split of the
files, and growing files give in any number of steps what they give at once.

The offset of a stream is the size of every file, kept by Spark's checkpoint. What has not
ended when a file is read stays for later. A batch read also emits it, as the last row.

Defined cases: an empty file has no rows; bytes that are no UTF-8 are replaced; carriage
returns stay; a file that shrinks is an error; other files are left alone.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

CELL = 1 << 20
SPLIT = 64 << 20
_SCHEMA = "run_id string, attempt int, seq long, stream string, line string"
_PLACE = re.compile(r"([^/]+)/(\d+)/(stdout|stderr)(?:\.[^/]*)?(?:/[^/_.][^/]*)?")
_FIELD = re.compile(r"(?:run_id|attempt|stream)=")
_BATCH_ROWS = 10_000


class Range(InputPartition):
    """Rows that end after ``start`` and not after ``end``; ``last`` if the file ends there."""

    def __init__(self, path: str, place: tuple, start: int, end: int, last: bool):
        self.path, self.place, self.start, self.end, self.last = path, place, start, end, last


def place_of(path: str) -> tuple[str, int, str] | None:
    """Run, attempt and stream of a path below the root; ``run_id=`` and so on may stand
    before them."""
    found = _PLACE.fullmatch(_FIELD.sub("", path))
    return (found[1], int(found[2]), found[3]) if found else None


class _Bytes:
    """A file read in pieces, from any place."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, start: int, end: int) -> bytes:
        start, end = max(start, 0), min(end, self.size)
        if end <= start:
            return b""
        self.file.seek(start)
        return self.file.read(end - start)


def _cut(data: _Bytes, at: int, cell: int) -> int | None:
    """Where the row that runs through the cell before ``at`` ends; None if there is a
    line feed in that cell, or if the bytes at ``at`` are not there yet."""
    if at < cell or b"\n" in data.read(at - cell, at):
        return None
    after = data.read(at, at + 4)
    return next((at + k for k, b in enumerate(after) if b & 0xC0 != 0x80), None)


def _row_start(data: _Bytes, at: int, cell: int) -> int:
    """Where the row that holds byte ``at`` begins."""
    low = at - at % cell
    while True:
        found = data.read(low, at).rfind(b"\n")
        cut = _cut(data, low, cell) if low else None
        start = max(low + found + 1 if found >= 0 else -1, cut if cut is not None and cut <= at else -1)
        if start >= 0 or not low:
            return max(start, 0)
        low -= cell


def rows_of_range(file, size: int, start: int, end: int, last: bool, cell: int = CELL):
    """``(offset, bytes)`` of the rows that end in a range. A line feed at byte ``k`` ends a
    row known at ``k + 1``, a cut before byte ``k`` one known at ``k + 1``, too."""
    data = _Bytes(file, size)
    begin, ended = None, False  # whether the cell before has a line feed, as far as known
    for low in range(start - start % cell, end, cell):
        high = min(low + cell, end)
        # A cut belongs to where its first byte behind is seen.
        ends = []
        cut = None if ended else _cut(data, low, cell)
        if cut is not None and start < cut + 1 <= end:
            ends.append(cut)
        block_start = max(low, start)
        block = data.read(block_start, high)
        at = block.find(b"\n")
        while at >= 0:
            ends.append(block_start + at + 1)
            at = block.find(b"\n", at + 1)
        ended = b"\n" in block
        for stop in sorted(set(ends)):
            if begin is None:
                begin = _row_start(data, stop - 1, cell)
            if block_start <= begin < stop <= high:
                yield begin, block[begin - block_start : stop - block_start]
            elif begin < stop:
                yield begin, data.read(begin, stop)
            begin = stop
    if last and end:
        begin = _row_start(data, end - 1, cell) if begin is None else begin
        if begin < end and data.read(end - 1, end) != b"\n":
            yield begin, data.read(begin, end)


class _Files:
    """What batch and stream share: listing the files, cutting ranges, reading them."""

    def __init__(self, options):
        self.root = options["path"]
        self.split = int(options.get("split_bytes", SPLIT))
        self.cell = int(options.get("cell_bytes", CELL))

    def _system(self):
        scheme, _, rest = self.root.partition(":/")
        if rest and scheme not in ("", "file"):
            return files.FileSystem.from_uri(self.root)
        path = "/" + rest.lstrip("/") if scheme == "file" else self.root
        return files.LocalFileSystem(), path.rstrip("/")

    def sizes(self) -> dict[str, int]:
        system, root = self._system()
        selector = files.FileSelector(root, recursive=True, allow_not_found=True)
        found = {}
        for info in system.get_file_info(selector):
            name = info.path[len(root.rstrip("/")) + 1 :]
            if info.type == files.FileType.File and info.size and place_of(name):
                found[name] = info.size
        return found

    def ranges(self, start: dict[str, int], end: dict[str, int], last: bool) -> list[Range]:
        out = []
        for name, size in sorted(end.items()):
            at = start.get(name, 0)
            if size < at:
                raise ValueError(f"{name} has shrunk from {at} to {size} bytes")
            while at < size:
                stop = min(at + self.split, size)
                out.append(Range(name, place_of(name), at, stop, last and stop == size))
                at = stop
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, root = self._system()
        run_id, attempt, stream = partition.place
        schema = pa.schema(
            [("run_id", pa.string()), ("attempt", pa.int32()), ("seq", pa.int64()),
             ("stream", pa.string()), ("line", pa.string())]
        )

        def batch(rows):
            seq = [2 * at + (stream == "stderr") for at, _ in rows]
            lines = [line.decode("utf-8", "replace") for _, line in rows]
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([run_id] * n), pa.array([attempt] * n, pa.int32()),
                 pa.array(seq, pa.int64()), pa.array([stream] * n), pa.array(lines, pa.string())],
                schema=schema,
            )

        with system.open_input_file(f"{root.rstrip('/')}/{partition.path}") as file:
            rows, held = [], 0
            # Nothing behind the end is looked at: it may not have been there before.
            size = partition.end
            found = rows_of_range(file, size, partition.start, partition.end, partition.last, self.cell)
            for row in found:
                rows.append(row)
                held += len(row[1])
                if len(rows) >= _BATCH_ROWS or held >= 4 * CELL:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files = _Files(options)

    def partitions(self):
        return self.files.ranges({}, self.files.sizes(), last=True)

    def read(self, partition):
        return self.files.read(partition) if partition else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.files = _Files(options)

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return self.files.sizes()

    def partitions(self, start, end):
        return self.files.ranges(start, end, last=False)

    def read(self, partition):
        return self.files.read(partition)

    def commit(self, end):
        pass


class RawLines(DataSource):
    @classmethod
    def name(cls):
        return "raw_lines"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def read_raw_lines(spark: SparkSession, root: str, **options):
    """The lines of finished attempts below ``root``."""
    spark.dataSource.register(RawLines)
    return spark.read.format("raw_lines").options(**options).load(root)


def stream_raw_lines(spark: SparkSession, root: str, **options):
    """The lines of running attempts below ``root``, as they are written."""
    spark.dataSource.register(RawLines)
    return spark.readStream.format("raw_lines").options(**options).load(root)
