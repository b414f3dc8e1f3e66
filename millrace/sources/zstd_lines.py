"""Lines in zstd files as a Spark data source: ``spark.read.format("zstd_lines")``, after :func:`register`.

A row is a line (``value``). Files are whatever ``pyarrow.fs`` opens: local paths, ``file:``, ``s3:``, ``gs:`` or ``hdfs:`` addresses.

Writing: a task writes files of its own below ``_temporary``, closing one when it has ``max_documents`` lines or its compressed
size has reached ``max_bytes``, whichever comes first, so that a file exceeds the bound by less than its last line. The
commit gives the files of the tasks that succeeded their names ``part-00000.jsonl.zst``, in the order of tasks; what failed or
repeated tasks left is removed. ``_SUCCESS`` is written last; with overwrite, old files go just before.

Reading: a file is a partition; one larger than ``split_bytes`` is cut where its zstd frames end, found by their block headers
without decompressing. Lines end at line feeds alone. Blank lines, and lines that are not UTF-8, are left out.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SUFFIX = ".jsonl.zst"
LEVEL = 6
MAX_DOCUMENTS, MAX_BYTES = 100_000, 256 << 20
#: Lines and bytes of a batch that is read.
BATCH_LINES, BATCH_BYTES = 4096, 8 << 20


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZstdLines)


class ZstdLines(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "zstd_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"], int(self.options.get("split_bytes", MAX_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        o = self.options
        return Writer(o["path"], overwrite, int(o.get("max_documents", MAX_DOCUMENTS)), int(o.get("max_bytes", MAX_BYTES)), int(o.get("level", LEVEL)))


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    # Spark writes file:/a for what pyarrow calls file:///a.
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def _listed(fs: pafs.FileSystem, root: str) -> list[pafs.FileInfo]:
    """The files of a folder in order of their names, or the file itself; names that start with _ or . are not data."""
    at = fs.get_file_info(root)
    found = [at] if at.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, allow_not_found=False))
    return sorted((f for f in found if f.type == pafs.FileType.File and f.path.endswith(".zst") and f.base_name[0] not in "_."), key=lambda f: f.path)


def frames(file, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each zstd frame of a file, by its headers."""
    import zstandard

    start = 0
    while start < size:
        file.seek(start)
        head = file.read(18)
        magic = int.from_bytes(head[:4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # a frame to skip
            end = start + 8 + int.from_bytes(head[4:8], "little")
        else:
            end = start + zstandard.frame_header_size(head)
            last = False
            while not last:
                file.seek(end)
                block = int.from_bytes(file.read(3), "little")
                last, kind, length = bool(block & 1), block >> 1 & 3, block >> 3
                end += 3 + (1 if kind == 1 else length)
            end += 4 * zstandard.get_frame_parameters(head).has_checksum
        yield start, end - start
        start = end


@dataclass
class Part(InputPartition):
    path: str
    start: int
    length: int


class Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int) -> None:
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Part]:
        fs, root = _opened(self.path)
        parts = []
        for f in _listed(fs, root):
            if f.size <= self.split_bytes:
                parts.append(Part(f.path, 0, f.size))
                continue
            with fs.open_input_file(f.path) as file:
                own: list[Part] = []
                for start, length in frames(file, f.size):
                    if own and own[-1].length + length <= self.split_bytes:
                        own[-1].length += length
                    else:
                        own.append(Part(f.path, start, length))
            parts += own
        return parts or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = _opened(self.path)
        lines, size = [], 0
        for line in _lines(fs, part):
            lines.append(line)
            size += len(line)
            if len(lines) >= BATCH_LINES or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
                lines, size = [], 0
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])


def _lines(fs: pafs.FileSystem, part: Part) -> Iterator[str]:
    """The lines that begin in a part of a file."""
    import zstandard

    with fs.open_input_file(part.path) as file:
        end = part.start + part.length
        opened = lambda start, stop: io.BufferedReader(_Plain(zstandard.ZstdDecompressor().stream_reader(_Slice(file, start, stop), read_across_frames=True)), 1 << 20)
        with opened(part.start, end) as raw:
            if part.start and not raw.readline().endswith(b"\n"):
                return  # all of this part belongs to a line that began before
            unended = b""
            for line in raw:
                if not line.endswith(b"\n"):
                    unended = line
                    break
                yield from _text(line)
        if end < file.size():
            # The first line of the next part is the rest of this one's last, or a whole line if that had ended.
            with opened(end, file.size()) as raw:
                unended += raw.readline()
        yield from _text(unended)


def _text(line: bytes) -> Iterator[str]:
    if line.strip():
        try:
            yield line.decode("utf-8").removesuffix("\n")
        except UnicodeDecodeError:
            return


class _Plain(io.RawIOBase):
    """What a decompressor reads; its own ``readinto`` may give nothing before the end."""

    def __init__(self, reader) -> None:
        self.reader = reader

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.reader.read(len(into))
        into[: len(got)] = got
        return len(got)


class _Slice(io.RawIOBase):
    """Bytes of a file from ``start`` up to ``stop``."""

    def __init__(self, file, start: int, stop: int) -> None:
        self.file, self.at, self.stop = file, start, stop

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        self.file.seek(self.at)
        got = self.file.read(min(len(into), self.stop - self.at))
        into[: len(got)] = got
        self.at += len(got)
        return len(got)


@dataclass
class Written(WriterCommitMessage):
    task: int
    paths: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, max_documents: int, max_bytes: int, level: int) -> None:
        self.path, self.overwrite, self.max_documents, self.max_bytes, self.level = path, overwrite, max_documents, max_bytes, level
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, root = _opened(self.path)
        task = TaskContext.get().partitionId()
        own = f"{root}/_temporary/{self.job}/{task:06d}-{uuid.uuid4().hex}"
        paths: list[str] = []
        file = None
        for batch in batches:
            for line in batch.column(0):
                if not line.is_valid:
                    continue
                if file is None or file.lines >= self.max_documents or file.reached(self.max_bytes):
                    if file is None:
                        fs.create_dir(own, recursive=True)
                    else:
                        file.close()
                    paths.append(f"{own}/{len(paths):06d}{SUFFIX}")
                    file = _File(fs, paths[-1], self.level)
                file.write(line.as_py().encode("utf-8") + b"\n")
        if file is not None:
            file.close()
        return Written(task, paths)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.path)
        fs.create_dir(root, recursive=True)
        old = _listed(fs, root)
        if fs.get_file_info(f"{root}/_SUCCESS").type == pafs.FileType.File:
            fs.delete_file(f"{root}/_SUCCESS")
        if self.overwrite:
            for f in old:
                fs.delete_file(f.path)
        numbers = [int(m[1]) for f in old if not self.overwrite and (m := re.match(r"part-(\d+)", f.base_name))]
        at = max(numbers, default=-1) + 1
        for done in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            for path in done.paths:
                fs.move(path, f"{root}/part-{at:05d}{SUFFIX}")
                at += 1
        self.abort(messages)
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.path)
        for folder in (f"{root}/_temporary/{self.job}", f"{root}/_temporary"):
            # Another job may be writing below the outer one.
            if fs.get_file_info(folder).type == pafs.FileType.Directory and (folder.endswith(self.job) or not fs.get_file_info(pafs.FileSelector(folder))):
                fs.delete_dir(folder)


class _File:
    """A zstd file under way: one frame, whose compressed size is known when it matters."""

    def __init__(self, fs: pafs.FileSystem, path: str, level: int) -> None:
        import zstandard

        self.block = zstandard.FLUSH_BLOCK
        self.raw = fs.open_output_stream(path, compression=None)  # else the suffix alone would have it compressed
        self.stream = zstandard.ZstdCompressor(level=level).stream_writer(self.raw, closefd=False)
        self.lines = self.pending = 0

    def write(self, line: bytes) -> None:
        self.stream.write(line)
        self.lines += 1
        self.pending += len(line)

    def reached(self, bound: int) -> bool:
        """Whether the file has ``bound`` compressed bytes; the compressor is asked only if it might."""
        if self.raw.tell() + self.pending + self.pending // 128 + 1024 < bound:
            return False
        self.stream.flush(self.block)
        self.pending = 0
        return self.raw.tell() >= bound

    def close(self) -> None:
        self.stream.close()
        self.raw.close()
