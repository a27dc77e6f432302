"""A streaming source that follows growing text files: each line once, as soon as its end is written.

Offsets are bytes read per file. A trigger takes every file up to its last line end, so a half line waits for the rest,
and the stream's checkpoint keeps the offsets, so a restart goes on where it stopped. Files may appear at any time. Files are read through
pyarrow's file systems, from tasks, in pieces of at most `pieceBytes`; only names and sizes are looked up on the driver.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PIECE_BYTES = 32 << 20
_BLOCK = 1 << 16
_ROWS = 4096


@dataclass
class Piece(InputPartition):
    """The lines of a file that begin at `start` or later and before `end`; `first` is where the trigger's lines begin."""

    path: str
    first: int
    start: int
    end: int


def _is_end(byte: int) -> bool:
    return byte in b"\n\r"


def _last_end(file, size: int, known: int) -> int:
    """The place after the last line end in the file's first `size` bytes, or `known` where there is none after it."""
    at = size
    while at > known:
        block = max(known, at - _BLOCK)
        file.seek(block)
        data = file.read(at - block)
        found = max(data.rfind(b"\n"), data.rfind(b"\r"))
        if found >= 0:
            return block + found + 1
        at = block
    return known


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str, piece: int):
        self.folder, self.suffix, self.piece = folder, suffix, piece

    def _files(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        store, root = fs.FileSystem.from_uri(self.folder)
        listed = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        plain = [f for f in listed if f.type == fs.FileType.File and f.path.endswith(self.suffix)]
        return store, sorted((f for f in plain if not posixpath.basename(f.path).startswith((".", "_"))), key=lambda f: f.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, files = self._files()
        out = {}
        for f in files:
            with store.open_input_file(f.path) as file:
                end = _last_end(file, f.size, 0)
            if end:
                out[f.path] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        """Pieces of what was added; a file that is shorter than it was has been replaced and is read from its beginning."""
        out = []
        for path, stop in sorted(end.items()):
            first = start.get(path, 0)
            first = 0 if first > stop else first
            out += [Piece(path, first, at, min(at + self.piece, stop)) for at in range(first, stop, self.piece)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_file(partition.path) as file:
            rows: list[tuple[int, str]] = []
            for at, line in _lines(file, partition):
                rows.append((at, line.decode(errors="replace")))
                if len(rows) == _ROWS:
                    yield _batch(partition.path, rows)
                    rows = []
            if rows:
                yield _batch(partition.path, rows)


def _lines(file, piece: Piece) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in the piece; empty lines are none."""
    at = piece.start
    if at > piece.first:
        # the line that the byte before belongs to is the earlier piece's
        file.seek(at - 1)
        held = file.read(1)
        begun = _is_end(held[0])
    else:
        file.seek(at)
        begun = True
    line, begins = bytearray(), at
    while True:
        data = file.read(_BLOCK)
        if not data:
            return
        for part in data.replace(b"\r", b"\n").split(b"\n")[:-1]:
            if begun and (line or part):
                yield begins, bytes(line + part)
            at += len(part) + 1
            line, begins, begun = bytearray(), at, True
            if at >= piece.end:
                return
        rest = data[max(data.rfind(b"\n"), data.rfind(b"\r")) + 1 :]
        at += len(rest)
        if begun:
            line += rest


def _batch(path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [path] * len(rows), "at": pa.array([r[0] for r in rows], pa.int64()), "value": [r[1] for r in rows]})


class TailedText(DataSource):
    """Source `tailed_text` with the options path (a folder), suffix and pieceBytes."""

    @classmethod
    def name(cls) -> str:
        return "tailed_text"

    def schema(self) -> str:
        return "path string, at bigint, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("pieceBytes", PIECE_BYTES)))


def tailed_lines(spark: SparkSession, folder: str, suffix: str = "", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """A stream of path, at (the line's first byte) and value of the lines that end in a line feed or a carriage return.

    Empty lines are left out, bytes that are no UTF-8 become replacement characters, and files with hidden names (with a
    first dot or underscore) are not followed. A file that got shorter is read again from its beginning."""
    spark.dataSource.register(TailedText)
    uri = folder if "://" in folder else folder.replace("file:", "", 1)
    return spark.readStream.format("tailed_text").option("path", uri).option("suffix", suffix).option("pieceBytes", piece_bytes).load()
