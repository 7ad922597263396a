"""Lines in files of zstd frames, as a data source: a task for each run of frames, each read as a stream.

A frame is a unit that can be unpacked by itself. Where frames begin is known from the headers of frames and blocks, so a
file's list of frames takes a look at three bytes of each block and unpacks nothing. Frames may end anywhere: a line belongs
to the task that holds the line break before it (the first line to the first task), and that task reads on into the frames
behind its own up to the next line break, as Spark's own reader of text does with splits. No task holds more than a piece of
a frame and the lines in it.

Writing is by two steps: tasks write to a folder aside, whose files are moved in place when all have succeeded, and removed
if not, so that a failed job leaves no row behind. Files are opened by pyarrow, for paths it knows (local, HDFS, S3, GCS).

Defined cases: an empty file, frames without content and skippable frames have no lines; a last line without a line break
counts; empty lines are lines; line breaks are \\n or \\r\\n; bytes that are no UTF-8 and broken frames are errors.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "file string, first boolean, line string"
#: Fixed values of the format: a frame's magic number, the one of skippable frames without its lowest four bits, and how many
#: bytes the longest frame header takes.
MAGIC, SKIPPED, LONGEST_HEADER = 0xFD2FB528, 0x184D2A50, 18
PIECE, BATCH = 1 << 20, 1 << 22


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def frames(file: pa.NativeFile, size: int, at: int = 0) -> Iterator[tuple[int, int]]:
    """Start and end of each frame with content, from byte ``at`` on, where one must begin."""
    import zstandard

    while at < size:
        file.seek(at)
        head = file.read(LONGEST_HEADER)
        magic = int.from_bytes(head[:4], "little")
        if magic & ~15 == SKIPPED:
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        if magic != MAGIC:
            raise ValueError(f"no zstd frame at byte {at}")
        start, checked = at, zstandard.get_frame_parameters(head).has_checksum
        at += zstandard.frame_header_size(head)
        last = False
        while not last:
            file.seek(min(at, size))
            x = int.from_bytes(file.read(3), "little")
            last = bool(x & 1)
            at += 3 + (1 if x >> 1 & 3 == 1 else x >> 3)  # one byte stands for a whole block of it
            if at > size:
                break
        at += 4 * checked
        if at > size:
            raise ValueError(f"the frame at byte {start} is cut off")
        yield start, at


@dataclass
class Frames(InputPartition):
    """The frames of a file that begin in these bytes."""

    path: str
    start: int
    end: int
    size: int


class _Bytes:
    """Some bytes of a file, as a file: the unpacking reader would go on into the next frame."""

    def __init__(self, file: pa.NativeFile, start: int, end: int):
        self.file, self.left = file, end - start
        file.seek(start)

    def read(self, n: int = -1) -> bytes:
        got = self.file.read(self.left if n < 0 else min(n, self.left))
        self.left -= len(got)
        return got


def unpacked(part: Frames) -> Iterator[tuple[bool, bytes]]:
    """Pieces of the content from the task's first frame to the file's end, and whether they are the task's own."""
    import zstandard

    system, place = opened(part.path)
    with system.open_input_file(place) as file, system.open_input_file(place) as heads:
        for start, end in frames(heads, part.size, part.start):
            with zstandard.ZstdDecompressor(max_window_size=1 << 31).stream_reader(_Bytes(file, start, end), closefd=False) as frame:
                while piece := frame.read(PIECE):
                    yield start < part.end, piece


def lines(part: Frames) -> Iterator[bytes]:
    """The lines whose line break before them is in the task's own frames."""
    kept: list[bytes] = []  # the beginning of a line that goes on; pieces are joined once
    begun = not part.start
    for own, piece in unpacked(part):
        if not own:
            if not begun:
                return
            head, found, _ = piece.partition(b"\n")
            kept.append(head)
            if found:
                yield b"".join(kept)
                return
            continue
        if not begun:
            _, found, piece = piece.partition(b"\n")
            if not found:
                continue
            begun = True
        *whole, rest = piece.split(b"\n")
        if whole:
            yield b"".join([*kept, whole[0]])
            yield from whole[1:]
            kept = []
        kept.append(rest)
    if begun and (rest := b"".join(kept)):
        yield rest


class ZstReader(DataSourceReader):
    def __init__(self, path: str, least: int):
        self.path, self.least = path, least

    def partitions(self) -> list[Frames]:
        system, place = opened(self.path)
        info = system.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        # names that begin with _ or . are not read, as with Spark's readers
        held = [info] if info.is_file else sorted((f for f in system.get_file_info(fs.FileSelector(place)) if f.is_file and f.base_name[0] not in "_."), key=lambda f: f.path)
        top = self.path[: len(self.path) - len(place)] if self.path.endswith(place) else ""
        parts = []
        for f in held:
            start = 0
            with system.open_input_file(f.path) as file:
                for _, end in frames(file, f.size):
                    if end - start >= self.least:
                        parts.append(Frames(top + f.path, start, end, f.size))
                        start = end
            if start and start < f.size:
                parts[-1].end = f.size
            elif start < f.size:
                parts.append(Frames(top + f.path, 0, f.size, f.size))
        return parts

    def read(self, partition: Frames | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty list of partitions is read as one that has nothing
            return
        schema = pa.schema([("file", pa.string()), ("first", pa.bool_()), ("line", pa.string())])
        found, first = lines(partition), not partition.start
        while True:
            block, size = [], 0
            for line in found:
                block.append(line.removesuffix(b"\r").decode())
                size += len(line) + 64
                if size >= BATCH:
                    break
            if not block:
                return
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(block), pa.string()), pa.array([first, *[False] * (len(block) - 1)]), pa.array(block, pa.string())], schema=schema)
            first = False


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class ZstWriter(DataSourceArrowWriter):
    """A file for each task that has rows, with a frame for each ``frame`` bytes of text, cut where that falls."""

    def __init__(self, path: str, frame: int, header: str | None):
        self.path, self.frame, self.header, self.aside = path.rstrip("/"), frame, header, f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import zstandard

        blocks = (("\n".join(b.column(0).to_pylist()) + "\n").encode() for b in iterator if b.num_rows)
        if (block := next(blocks, None)) is None:
            return Written(None)
        system, place = opened(self.path)
        system.create_dir(f"{place}/{self.aside}")
        name = f"part-{uuid.uuid4().hex}.zst"
        with system.open_output_stream(f"{place}/{self.aside}/{name}", compression=None) as out:
            text = f"{self.header}\n".encode() if self.header else b""
            for more in itertools.chain([block], blocks):
                text += more
                cut = len(text) - len(text) % self.frame
                for at in range(0, cut, self.frame):
                    out.write(zstandard.ZstdCompressor(write_checksum=True).compress(text[at : at + self.frame]))
                text = text[cut:]
            if text:
                out.write(zstandard.ZstdCompressor(write_checksum=True).compress(text))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, place = opened(self.path)
        system.create_dir(place)
        for m in messages:
            if m and m.name:
                system.move(f"{place}/{self.aside}/{m.name}", f"{place}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Also removes what attempts of lost tasks wrote."""
        system, place = opened(self.path)
        if system.get_file_info(f"{place}/{self.aside}").type != fs.FileType.NotFound:
            system.delete_dir(f"{place}/{self.aside}")


class ZstLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plycast_zst"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZstReader:
        return ZstReader(self.options["path"], int(self.options.get("least", 1)))

    def writer(self, schema, overwrite: bool) -> ZstWriter:
        if overwrite or len(schema) != 1:
            raise ValueError("one column of text can be appended")
        return ZstWriter(self.options["path"], int(self.options.get("frame", 1 << 27)), self.options.get("header"))


def read_lines(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """file, first (whether it is its file's first line) and line, of a file or of the files in a folder. A task takes as many frames
    as hold ``least`` packed bytes."""
    spark.dataSource.register(ZstLines)
    return spark.read.format("plycast_zst").option("least", least).load(path)


def append_lines(df: DataFrame, path: str, frame: int = 1 << 27, header: str | None = None) -> None:
    """Adds the texts of ``df``'s one column, each a line (null: an empty one), to a folder of zstd files, all of them or
    none. Each file begins with the ``header``."""
    df.sparkSession.dataSource.register(ZstLines)
    (name,) = df.columns
    out = df.na.fill("", [name]).write.format("plycast_zst").mode("append").option("frame", frame)
    (out.option("header", header) if header else out).save(path)
