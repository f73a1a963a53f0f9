"""The raw line source: any split and any number of steps give the same rows."""

import io
import random

import pytest

from scriptflow.sources import raw_lines
from scriptflow.streaming import logs as streaming


def plain(data: bytes, cell: int, last=True):
    """Rows of a whole file, byte by byte."""
    out, begin = [], 0
    for k in range(1, len(data) + 1):
        if k < len(data) and k > begin:
            # A cut before byte k: the nearest multiple has no line feed in its cell.
            grid = next((g for g in range(k, max(k - 4, -1), -1) if g % cell == 0), None)
            if grid and grid >= cell and b"\n" not in data[grid - cell : grid]:
                inside = data[grid : k + 1]
                if inside[-1] & 0xC0 != 0x80 and all(b & 0xC0 == 0x80 for b in inside[:-1]):
                    out.append((begin, data[begin:k]))
                    begin = k
        if data[k - 1 : k] == b"\n":
            out.append((begin, data[begin:k]))
            begin = k
    if last and begin < len(data):
        out.append((begin, data[begin:]))
    return out


def texts():
    rng = random.Random(6)
    yield b""
    yield b"\n"
    yield b"no end"
    yield "ä\U0001f600é".encode() * 40
    yield b"x" * 100 + b"\n" + b"y" * 64
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(12)):
            parts.append("".join(rng.choice("ab éß\U0001f600\r") for _ in range(rng.choice([0, 3, 15, 16, 17, 70]))))
        yield "\n".join(parts).encode()


@pytest.mark.parametrize("cell", [8, 16])
def test_ranges_add_up(cell):
    rng = random.Random(cell)
    for data in texts():
        want = plain(data, cell)
        assert b"".join(r for _, r in want) == data
        for _ in range(6):
            cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(rng.randrange(9)))})
            got = []
            for start, end in zip(cuts, cuts[1:]):
                # The file has grown to the end of the range and no further.
                got += raw_lines.rows_of_range(
                    io.BytesIO(data[:end]), end, start, end, end == len(data), cell
                )
            assert got == want, (data, cuts)


def test_rows_are_bounded():
    data = ("é" * 5000 + "\nshort\n" + "z" * 3000).encode()
    rows = list(raw_lines.rows_of_range(io.BytesIO(data), len(data), 0, len(data), True, 64))
    assert max(len(r) for _, r in rows) <= 2 * 64 + 3
    assert b"".join(r for _, r in rows) == data
    for _, row in rows:
        row.decode()


def test_places():
    assert raw_lines.place_of("r1/2/stdout.log") == ("r1", 2, "stdout")
    assert raw_lines.place_of("run_id=7/attempt=1/stream=stderr/part-0.txt") == ("7", 1, "stderr")
    for other in ("r1/2/notes.txt", "r1/x/stdout", "stdout", "r1/2/stdout.log/_SUCCESS", "a/b/1/stdout"):
        assert raw_lines.place_of(other) is None


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "runs"
    for name, text in {
        "a/1/stdout.log": "one\ntwo\nthr",
        "a/1/stderr.log": "é\n",
        "a/2/stdout.log": "",
        "b/1/stdout": "x" * 1000 + "\n",
        "b/1/notes.txt": "no\n",
    }.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return folder


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_batch(spark, root):
    got = rows_of(raw_lines.read_raw_lines(spark, str(root)))
    assert got == [
        ("a", 1, 0, "stdout", "one\n"),
        ("a", 1, 1, "stderr", "é\n"),
        ("a", 1, 8, "stdout", "two\n"),
        ("a", 1, 16, "stdout", "thr"),
        ("b", 1, 0, "stdout", "x" * 1000 + "\n"),
    ]
    # Another split of the files is no other result.
    assert rows_of(raw_lines.read_raw_lines(spark, f"file://{root}", split_bytes=7)) == got
    cut = [rows_of(raw_lines.read_raw_lines(spark, str(root), split_bytes=n, cell_bytes=64)) for n in (5, 100, 10**6)]
    assert cut[0] == cut[1] == cut[2] and len(cut[0]) > len(got)


def test_stream_over_growing_files_and_restarts(spark, root, tmp_path):
    table = streaming.LiveTable(str(tmp_path / "live"), lambda batch: batch)

    def now():
        lines = raw_lines.stream_raw_lines(spark, str(root), split_bytes=6)
        for _ in range(2):  # a second call finds nothing new
            query = (
                lines.writeStream.foreachBatch(
                    lambda b, k: b.write.mode("overwrite").parquet(f"{table.rows_path}/batch_id={k}")
                )
                .option("checkpointLocation", f"{table.path}/checkpoint")
                .trigger(processingTime="0 seconds")
                .start()
            )
            try:
                query.processAllAvailable()
            finally:
                query.stop()
        return rows_of(table.rows(lines).drop("batch_id"))

    first = now()
    assert ("a", 1, 16, "stdout", "thr") not in first and len(first) == 4
    with open(root / "a/1/stdout.log", "a") as f:
        f.write("ee\nfour")
    (root / "c/3").mkdir(parents=True)
    (root / "c/3/stderr").write_text("late\n")
    second = now()
    assert set(second) - set(first) == {("a", 1, 16, "stdout", "three\n"), ("c", 3, 1, "stderr", "late\n")}
    with open(root / "a/1/stdout.log", "a") as f:
        f.write("\n")
    assert now() == rows_of(raw_lines.read_raw_lines(spark, str(root)))
    assert not spark.streams.active


def test_a_shrunken_file_is_an_error():
    with pytest.raises(ValueError, match="shrunk"):
        raw_lines._Files({"path": "x"}).ranges({"a/1/stdout": 5}, {"a/1/stdout": 4}, False)
