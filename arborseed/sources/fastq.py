"""FASTQ files in byte ranges: each partition finds its first record by the form of records, so nothing is counted or shuffled."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from .files import Split, listed, opened, splits, taken

SCHEMA = "file string, at long, name string, seq string, qual string"
#: Bytes of a split and of one read.
SPLIT, CHUNK = 64 << 20, 4 << 20
#: Bytes of small splits that a task takes one after another.
TASK = 16 << 20
AT, PLUS, NEWLINE, RETURN = (ord(c) for c in "@+\n\r")


def is_gzip(path: str) -> bool:
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        return f.read(2) == b"\x1f\x8b"


def plain_bytes(path: str, begin: int, first: int = CHUNK) -> Iterator[bytes]:
    """The file's bytes from `begin`: at first `first` of them, then twice as many each time, up to CHUNK."""
    fs, at = opened(path)
    size = min(max(1, first), CHUNK)
    with fs.open_input_file(at) as f:
        f.seek(begin)
        while data := f.read(size):
            yield data
            size = min(2 * size, CHUNK)


def unzipped(path: str) -> Iterator[bytes]:
    """The bytes of a gzip file, of all of its members."""
    unzip = zlib.decompressobj(31)
    for data in plain_bytes(path, 0):
        while data:
            yield unzip.decompress(data)
            data = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
    if tail := unzip.flush():
        yield tail


def lines_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the lines that end within data, without their line ends."""
    stop = np.flatnonzero(data == NEWLINE)
    begin = np.r_[0, stop[:-1] + 1] if len(stop) else stop
    end = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == RETURN))
    return begin, end


def first_record(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> int | None:
    """The first line that opens a record: @, and two lines on a +, before it a sequence as long as the quality behind it."""
    n = len(begin) - 3
    if n <= 0:
        return None
    size = end - begin
    mark = lambda i, c: (size[i : i + n] > 0) & (data[np.minimum(begin[i : i + n], len(data) - 1)] == c)
    found = np.flatnonzero(mark(0, AT) & mark(2, PLUS) & (size[1 : 1 + n] == size[3 : 3 + n]))
    return int(found[0]) if len(found) else None


def records(chunks: Iterator[bytes], base: int, begin: int, end: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, place of each record's first byte, begins and ends of its four lines) of records that begin in [begin, end).

    chunks go on from byte `base` of the file. A record that isn't one is an error; empty lines at the end are none.
    """
    rest, known, last = b"", begin == 0, False
    if base < begin:  # the line that holds the byte before `begin` belongs to the split before
        while b"\n" not in rest:
            more = next(chunks, None)
            if more is None:
                return
            rest += more
        cut = rest.index(b"\n") + 1
        base, rest = base + cut, rest[cut:]
        if base >= end:  # no line begins in this split
            return
    while not last:
        more = next(chunks, None)
        last = more is None
        rest += (b"" if rest.endswith(b"\n") or not rest else b"\n") if last else more
        data = np.frombuffer(rest, np.uint8)
        b, e = lines_of(data)
        at = 0
        if not known:
            at = first_record(data, b, e)
            if at is None:
                if len(b) and base + int(b[0]) >= end or last:
                    return
                continue
            known = True
        n = (len(b) - at) // 4
        starts = b[at : at + 4 * n : 4]
        n = int(np.searchsorted(base + starts, end, "left"))
        if n:
            lb, le = b[at : at + 4 * n].reshape(n, 4), e[at : at + 4 * n].reshape(n, 4)
            size = le - lb
            head = lambda i: data[np.minimum(lb[:, i], len(data) - 1)]  # noqa: B023, E731
            good = (size[:, 0] > 0) & (head(0) == AT) & (size[:, 2] > 0) & (head(2) == PLUS) & (size[:, 1] == size[:, 3])
            if not good.all():
                bad = int(np.flatnonzero(~good)[0])
                if rest[lb[bad, 0] :].strip() or any(x.strip() for x in chunks):
                    raise ValueError(f"not a FASTQ record at byte {base + int(lb[bad, 0])}")
                n, last = bad, True
                lb, le = lb[:n], le[:n]
            if n:
                yield data, base + lb[:, 0], lb, le
        if len(starts) > n:  # the next record is beyond the split
            return
        used = int(b[at + 4 * n]) if at + 4 * n < len(b) else (int(np.flatnonzero(data == NEWLINE)[-1]) + 1 if len(b) else 0)
        left = rest[used:]
        if last and left.strip() and base + used < end:
            raise ValueError(f"not a FASTQ record at byte {base + used}")
        base, rest = base + used, left


@dataclass
class Run(Split):
    """Splits of `step` bytes in a row."""

    step: int = SPLIT


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("splitbytes", SPLIT))
        self.task = int(options.get("taskbytes", self.size))

    def partitions(self) -> list[Run]:
        """A task takes small splits one after another, up to `taskbytes` of a file, so tasks grow with the bytes and not with the splits."""
        out: list[Run] = []
        step = max(1, self.size)
        for s in splits([x for x in listed(self.path) if x[1]], max(step, self.task // step * step), is_gzip):
            out.append(Run(s.path, s.begin, s.end, s.whole, step))
        return out or [Run("", 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        if partition.whole:
            yield from self.split(partition)
        else:
            for at in range(partition.begin, partition.end, partition.step):
                yield from self.split(Split(partition.path, at, min(partition.end, at + partition.step)))

    def split(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition.whole:
            chunks, base, begin, end = unzipped(partition.path), 0, 0, 1 << 62
        else:
            begin, end = partition.begin, partition.end
            base = max(0, begin - 1)
            chunks = plain_bytes(partition.path, base, end - base)
        for data, at, lb, le in records(chunks, base, begin, end):
            name = taken(data, lb[:, 0] + 1, le[:, 0])
            name = pc.replace_substring_regex(name, r"(?s)\s.*$", "")
            file = pa.array([partition.path] * len(at), pa.string())
            yield pa.RecordBatch.from_arrays([file, pa.array(at), name, taken(data, lb[:, 1], le[:, 1]), taken(data, lb[:, 3], le[:, 3])], ["file", "at", "name", "seq", "qual"])


class FastqSource(DataSource):
    """`spark.read.format("fastq").option("splitbytes", n).load(path)`: a file, a folder or a pattern; gzip files are one split each."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def scan(spark: SparkSession, path: str, split_bytes: int = SPLIT, task_bytes: int = 0) -> DataFrame:
    """(file, at, name, seq, qual): the records of FASTQ files; at is the place of a record's first byte, in order within a file.

    A task takes splits of a file up to task_bytes one after another, one split at least.
    """
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("splitbytes", str(split_bytes)).option("taskbytes", str(max(split_bytes, task_bytes))).load(path)
