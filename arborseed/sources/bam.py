"""BAM files: read in byte ranges of compressed blocks, or by region through their index, and written sorted, each part with its index.

A file is a chain of compressed blocks of at most 64 KB; a record's place is the byte of its block and its place within it. A
partition finds its first block by the blocks' form and its first record by the records', so a file needs no index to be split.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .files import Split, listed, opened, taken

SCHEMA = "name string, flag int, reference string, start long, mapq int, cigar string, mate_reference string, mate_start long, tlen long, seq string, qual string, edits int, md string"
#: Fixed values of the format: block header, the empty block at the end, magic words, letters of operations and of bases, bytes of a block.
BLOCK = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"
END = BLOCK + b"\x1b\x00\x03\x00" + b"\x00" * 8
MAGIC, INDEX_MAGIC, OPERATIONS, LETTERS, FULL = b"BAM\x01", b"BAI\x01", "MIDNSHP=X", "=ACMGRSVTWYHKDBN", 0xFF00
#: Compressed bytes of a split and of one read; the index's windows.
SPLIT, CHUNK, WINDOW = 32 << 20, 4 << 20, 1 << 14
#: Records in a row that a place must open to count as a record's, unless the file ends before.
IN_A_ROW = 4
FIXED = struct.Struct("<iiiBBHHHiiii")
_CODE_OF = np.full(256, 15, np.uint8)
for _i, _c in enumerate(LETTERS):
    _CODE_OF[ord(_c)] = _i
_LETTER = np.frombuffer(LETTERS.encode(), np.uint8)


# ---------------------------------------------------------------- blocks


class Blocks:
    """The uncompressed bytes of a file from a block on, and the byte at which each block begins."""

    def __init__(self, path: str, begin: int):
        fs, at = opened(path)
        self.file, self.raw, self.at = fs.open_input_file(at), b"", begin
        self.file.seek(begin)
        self.size = self.file.size()

    def _fill(self, n: int) -> bool:
        while len(self.raw) < n:
            data = self.file.read(max(CHUNK, n - len(self.raw)))
            if not data:
                return False
            self.raw += data
        return True

    def seek_block(self) -> bool:
        """Goes on to the next place that opens a block which is followed by another one, or by the file's end."""
        while self._fill(18):
            found = self.raw.find(BLOCK[:4])
            if found < 0:
                self.at, self.raw = self.at + len(self.raw) - 3, self.raw[-3:]
                if not self._fill(18):
                    return False
                continue
            self.at, self.raw = self.at + found, self.raw[found:]
            size = self._size()
            if size and self._fill(size) and (self.at + size == self.size or self._fill(size + 4) and self.raw[size : size + 4] == BLOCK[:4]):
                return True
            self.at, self.raw = self.at + 1, self.raw[1:]
        return False

    def _size(self) -> int:
        """Bytes of the block at hand; 0 if it isn't one. Its size is among the extra fields."""
        if not self._fill(18) or self.raw[:4] != BLOCK[:4]:
            return 0
        extra = int.from_bytes(self.raw[10:12], "little")
        self._fill(12 + extra)
        i = 12
        while i + 4 <= 12 + extra:
            size = int.from_bytes(self.raw[i + 2 : i + 4], "little")
            if self.raw[i : i + 2] == b"BC" and size == 2:
                return int.from_bytes(self.raw[i + 4 : i + 6], "little") + 1
            i += 4 + size
        return 0

    def next(self) -> tuple[int, bytes] | None:
        """(byte at which it begins, content) of the next block."""
        size = self._size()
        if not size or not self._fill(size):
            if self.raw:
                raise ValueError(f"not a compressed block at byte {self.at}")
            return None
        extra = int.from_bytes(self.raw[10:12], "little")
        content = zlib.decompress(self.raw[12 + extra : size - 8], -15)
        if zlib.crc32(content) != int.from_bytes(self.raw[size - 8 : size - 4], "little"):
            raise ValueError(f"a block's check sum is wrong at byte {self.at}")
        at, self.at, self.raw = self.at, self.at + size, self.raw[size:]
        return at, content


def header(path: str) -> tuple[str, list[tuple[str, int]], tuple[int, int]]:
    """(text, (reference, bases), place of the first record as (block, byte within))."""
    blocks, data, edges = Blocks(path, 0), b"", []

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            more = blocks.next()
            if more is None:
                raise ValueError(f"{path} ends within its header")
            edges.append((len(data), more[0]))
            data += more[1]

    need(12)
    if data[:4] != MAGIC:
        raise ValueError(f"{path} is no BAM file")
    n_text = int.from_bytes(data[4:8], "little")
    need(12 + n_text)
    text = data[8 : 8 + n_text].rstrip(b"\0").decode()
    at, references = 12 + n_text, []
    for _ in range(int.from_bytes(data[8 + n_text : 12 + n_text], "little")):
        need(at + 4)
        n = int.from_bytes(data[at : at + 4], "little")
        need(at + 8 + n)
        references.append((data[at + 4 : at + 3 + n].decode(), int.from_bytes(data[at + 4 + n : at + 8 + n], "little")))
        at += 8 + n
    begin, block = max(x for x in edges if x[0] <= at)
    if at == len(data):  # the records begin with the next block
        block, begin = blocks.at, at
    return text, references, (block, at - begin)


# ---------------------------------------------------------------- records


def plausible(data: np.ndarray, n_refs: int) -> np.ndarray:
    """Whether a record could begin at each byte, by its fixed fields and the end of its name."""
    n = len(data) - 36
    if n <= 0:
        return np.zeros(0, bool)
    word = lambda i: np.lib.stride_tricks.sliding_window_view(data[i : i + n + 3], 4)[:n].copy().view("<i4")[:, 0].astype(np.int64)
    size, ref, pos, l_seq, mate, mate_pos = word(0), word(4), word(8), word(20), word(24), word(28)
    l_name, ops = data[12 : 12 + n].astype(np.int64), data[16 : 16 + n].astype(np.int64) + (data[17 : 17 + n].astype(np.int64) << 8)
    least = 32 + l_name + 4 * ops + (l_seq + 1) // 2 + l_seq
    fits = (l_name > 1) & (l_seq >= 0) & (size >= least) & (size < least + (1 << 24)) & (ref >= -1) & (ref < n_refs) & (mate >= -1) & (mate < n_refs) & (pos >= -1) & (mate_pos >= -1)
    last = np.arange(n) + 35 + l_name
    inside = last < len(data)
    return fits & inside & (data[np.minimum(last, len(data) - 1)] == 0)


def chain(data: bytes, at: int) -> list[int]:
    """The places of the whole records from `at` on, and of what follows them."""
    out = [at]
    while at + 4 <= len(data):
        at += 4 + int.from_bytes(data[at : at + 4], "little", signed=True)
        if at > len(data) or at < out[-1] + 36:
            break
        out.append(at)
    return out


def first_record(data: bytes, n_refs: int, ended: bool) -> int | None:
    """The first place that opens a row of records, IN_A_ROW or up to the end; None if more bytes are needed to tell."""
    could = plausible(np.frombuffer(data, np.uint8), n_refs)
    for at in np.flatnonzero(could).tolist():
        places, i = chain(data, at), 0
        while i < len(places) and i < IN_A_ROW and places[i] < len(could) and could[places[i]]:
            i += 1
        if i >= IN_A_ROW:
            return at
        if i == len(places) or places[i] >= len(could):  # plausible as far as it goes
            if not ended:
                return None
            if places[-1] == len(data):
                return at
    return len(data) if ended else None


@lru_cache(1 << 12)
def _cigar(words: bytes) -> str:
    """The CIGAR of operations as BAM has them; most records share a few."""
    return "".join(f"{w >> 4}{OPERATIONS[w & 15]}" for (w,) in struct.iter_unpack("<I", words)) or "*"


def decoded(data: bytes, places: list[int], names: list[str]) -> pa.RecordBatch:
    """The records at the places but the last, which is where they end."""
    raw = np.frombuffer(data, np.uint8)
    at = np.array(places[:-1], np.int64)
    fixed = raw[at[:, None] + np.arange(36)].copy().view(np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")]))[:, 0]
    n, l_name, ops = fixed["l_seq"].astype(np.int64), fixed["l_name"].astype(np.int64), fixed["ops"].astype(np.int64)
    name = taken(raw, at + 36, at + 35 + l_name)
    c_at = at + 36 + l_name
    s_at = c_at + 4 * ops
    q_at = s_at + (n + 1) // 2
    row = np.repeat(np.arange(len(at)), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    pair = raw[np.repeat(s_at, n) + inner // 2]
    letters = _LETTER[np.where(inner % 2 == 0, pair >> 4, pair & 15)]
    quals = raw[np.repeat(q_at, n) + inner] + np.uint8(33)
    edge = np.cumsum(n)
    seq, qual = taken(letters, edge - n, edge), taken(np.where(quals == 32, 0, quals).astype(np.uint8), edge - n, edge)
    unknown = np.zeros(len(at), bool)
    unknown[n > 0] = raw[q_at[n > 0]] == 255
    qual = pc.if_else(pa.array(unknown), pa.scalar(None, pa.string()), qual) if unknown.any() else qual
    cigars, edits, mds = [], [], []
    for i, a in enumerate(c_at.tolist()):
        cigars.append(_cigar(bytes(data[a : a + 4 * int(ops[i])])))
        found = tags(data, int(q_at[i] + n[i]), places[i + 1])
        edits.append(found.get("NM"))
        mds.append(found.get("MD"))
    known = np.array([*names, None], object)
    return pa.RecordBatch.from_arrays(
        [name, pa.array(fixed["flag"].astype(np.int32)), pa.array(known[fixed["ref"]], pa.string()), pa.array(fixed["pos"].astype(np.int64)), pa.array(fixed["mapq"].astype(np.int32)), pa.array(cigars, pa.string()), pa.array(known[fixed["mate"]], pa.string()), pa.array(fixed["mate_pos"].astype(np.int64)), pa.array(fixed["tlen"].astype(np.int64)), seq, qual, pa.array(edits, pa.int32()), pa.array(mds, pa.string())],
        COLUMNS)


COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def tags(data: bytes, at: int, end: int) -> dict:
    """The whole-number and text tags of a record."""
    out = {}
    while at + 3 <= end:
        key, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind in "ZH":
            stop = data.index(b"\0", at)
            out[key], at = data[at:stop].decode(), stop + 1
        elif kind == "B":
            at += 5 + SIZES[chr(data[at])] * int.from_bytes(data[at + 1 : at + 5], "little")
        else:
            n = SIZES[kind]
            if kind in "cCsSiI":
                out[key] = int.from_bytes(data[at : at + n], "little", signed=kind in "csi")
            at += n
    return out


# ---------------------------------------------------------------- index


def bin_of(begin: int, end: int) -> int:
    """The smallest of the format's nested bins (of 2^14 bases, and eight times as many level by level) that holds begin to end."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
    return 0


def index_bytes(n_refs: int, ref: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray, after: np.ndarray) -> bytes:
    """The index of records in order: of each reference its bins' stretches of places, and each window's first place."""
    out = [INDEX_MAGIC, struct.pack("<i", n_refs)]
    for r in range(n_refs):
        own = np.flatnonzero(ref == r)
        bins: dict[int, list[list[int]]] = {}
        windows = np.zeros(int(end[own].max() - 1 >> 14) + 1 if len(own) else 0, np.uint64)
        for i in own.tolist():
            held = bins.setdefault(bin_of(int(begin[i]), int(end[i])), [])
            if held and held[-1][1] == int(place[i]):
                held[-1][1] = int(after[i])
            else:
                held.append([int(place[i]), int(after[i])])
            for w in range(int(begin[i]) >> 14, (int(end[i]) - 1 >> 14) + 1):
                if not windows[w]:
                    windows[w] = place[i]
        out.append(struct.pack("<i", len(bins)))
        for b, held in sorted(bins.items()):
            out.append(struct.pack("<Ii", b, len(held)) + b"".join(struct.pack("<QQ", *x) for x in held))
        for w in range(1, len(windows)):  # a window that no record reaches has the place of the one before
            windows[w] = windows[w] or windows[w - 1]
        out.append(struct.pack("<i", len(windows)) + windows.astype("<u8").tobytes())
    return b"".join(out) + struct.pack("<Q", int((ref < 0).sum()))


def region_begin(path: str, reference: int, begin: int) -> int | None:
    """The place in the file before which no record reaches base `begin` of the reference, by its index; None without one."""
    fs, at = opened(path + ".bai")
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_file(at) as f:
        data = f.read()
    n_refs, i = int.from_bytes(data[4:8], "little"), 8
    for r in range(n_refs):
        n_bins, i = int.from_bytes(data[i : i + 4], "little"), i + 4
        for _ in range(n_bins):
            i += 8 + 16 * int.from_bytes(data[i + 4 : i + 8], "little")
        n, i = int.from_bytes(data[i : i + 4], "little"), i + 4
        if r == reference:
            w = np.frombuffer(data, "<u8", n, i)
            return int(w[min(begin >> 14, n - 1)]) if n else -1
        i += 8 * n
    return -1


# ---------------------------------------------------------------- source


@dataclass
class BamSplit(Split):
    """Compressed bytes begin to end; place: that of the first record, where it is known; names of the references."""

    place: int = -1
    region: tuple[int, int, int] | None = None
    names: list = field(default_factory=list)


#: Tasks that a scan is dealt to at most; each of these reads its splits one after the other.
TASKS = 1024


@dataclass
class BamSplits(InputPartition):
    splits: list


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size, self.region = options["path"], max(1, int(options.get("splitbytes", SPLIT))), options.get("region")

    def partitions(self) -> list[BamSplits]:
        out = []
        for path, total in listed(self.path, ".bam"):
            _, references, (block, within) = header(path)
            names, region, first = [r[0] for r in references], None, block << 16 | within
            if self.region:
                name, _, span = self.region.rpartition(":")
                begin, stop = (int(x) for x in span.split("-"))
                if name not in names:
                    continue
                region = (names.index(name), begin, stop)
                at = region_begin(path, region[0], begin)
                if at == -1:
                    continue
                if at:
                    first = max(first, at)
            out += [BamSplit(path, max(a, first >> 16), min(total, a + self.size), False, first if a <= first >> 16 else -1, region, names) for a in range((first >> 16) // self.size * self.size, total, self.size)]
        each = max(1, -(-len(out) // TASKS))
        return [BamSplits(out[i : i + each]) for i in range(0, len(out), each)] or [BamSplits([])]

    def read(self, partition: BamSplits) -> Iterator[pa.RecordBatch]:
        for split in partition.splits:
            yield from self._read(split)

    def _read(self, partition: BamSplit) -> Iterator[pa.RecordBatch]:
        for batch in split_records(partition):
            if partition.region:
                r, begin, stop = partition.region
                start = batch.column(3).to_numpy()
                here = pc.equal(batch.column(2), partition.names[r]).fill_null(False).to_numpy(zero_copy_only=False)
                past = here & (start >= stop)
                cigar = [sum(int(n) for n, k in _parts(c) if k in "MDN=X") for c in batch.column(5).to_pylist()]
                batch = batch.filter(pa.array(here & (start < stop) & (start + np.maximum(1, np.array(cigar, np.int64)) > begin)))
                yield batch
                if past.any():  # records are in order
                    return
            else:
                yield batch


def _parts(cigar: str) -> list[tuple[str, str]]:
    return re.findall(r"(\d+)([MIDNSHP=X])", cigar)


def split_records(s: BamSplit) -> Iterator[pa.RecordBatch]:
    """The records that begin in blocks that begin in the split."""
    blocks = Blocks(s.path, s.begin if s.place < 0 else s.place >> 16)
    if s.place < 0 and not blocks.seek_block():
        return
    data, at, mine, ended = b"", None if s.place < 0 else s.place & 0xFFFF, None, False
    while True:
        block = None if ended else blocks.next()
        if block is None:
            ended = True
        else:
            if block[0] >= s.end and mine is None:  # bytes from here on belong to the next split
                mine = len(data)
            data += block[1]
        if at is None:
            if mine == 0:
                return
            at = first_record(data, len(s.names), ended)
            if at is None:
                continue
        places = chain(data, at)
        if mine is not None or ended:
            stop = len(data) if mine is None else mine
            places = [p for p in places if p < stop] + [p for p in places if p >= stop][:1]
            if places[-1] >= stop or ended:
                if ended and mine is None and places[-1] != len(data):
                    raise ValueError(f"{s.path} ends within a record")
                if len(places) > 1:
                    yield decoded(data, places, s.names)
                return
        elif len(data) - at >= CHUNK and len(places) > 1:
            yield decoded(data, places, s.names)
            data, at = data[places[-1] :], 0


class BamSource(DataSource):
    """`spark.read.format("bam").option("splitbytes", n).option("region", "name:begin-end").load(path)`, places from 0; writes folders."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options, overwrite)


# ---------------------------------------------------------------- sink


#: A letter's code as a hexadecimal digit, and a quality's letter less 33, for bytes.translate.
_DIGIT, _LESS = bytes(b"0123456789ABCDEF"[c] for c in _CODE_OF), bytes((i - 33) % 256 for i in range(256))


@lru_cache(1 << 12)
def _operations(cigar: str | None) -> tuple[int, bytes, int]:
    """(number of operations, these as BAM has them, bases of the reference, 1 at least) of a CIGAR; most records share a few."""
    parts = [] if cigar in (None, "*", "") else _parts(cigar)
    words = [int(n) << 4 | OPERATIONS.index(k) for n, k in parts]
    return len(words), struct.pack(f"<{len(words)}I", *words), max(1, sum(int(n) for n, k in parts if k in "MDN=X"))


def encoded(r: dict, number: dict[str, int]) -> bytes:
    """A record of a row as SCHEMA has it."""
    name = (r["name"] or "*").encode() + b"\0"
    operations, cigar, span = _operations(r["cigar"])
    seq = (r["seq"] or "").encode()
    packed = bytes.fromhex((seq + b"=" * (len(seq) % 2)).translate(_DIGIT).decode())
    qual = r["qual"].encode().translate(_LESS) if r["qual"] and len(r["qual"]) == len(seq) else b"\xff" * len(seq)
    start = r["start"] if r["start"] is not None else -1
    extra = (b"" if r["edits"] is None else b"NMi" + struct.pack("<i", r["edits"])) + (b"" if r["md"] is None else b"MDZ" + r["md"].encode() + b"\0")
    mate_start = r["mate_start"] if r["mate_start"] is not None else -1
    body = FIXED.pack(0, number.get(r["reference"], -1), start, len(name), r["mapq"] or 0, bin_of(max(0, start), max(0, start) + span) if start >= 0 else 4680, operations, r["flag"] or 0, len(seq), number.get(r["mate_reference"], -1), mate_start, r["tlen"] or 0)
    body = body[4:] + name + cigar + packed + qual + extra
    return struct.pack("<i", len(body)) + body


@dataclass
class Written(WriterCommitMessage):
    made: str
    final: str


class BamWriter(DataSourceArrowWriter):
    """A part per task, under a hidden name until all tasks are done: header, sorted records, end block, and its index."""

    def __init__(self, options, overwrite: bool):
        import json

        self.path, self.overwrite, self.references = options["path"], overwrite, [tuple(x) for x in json.loads(options.get("references", "[]"))]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import uuid

        from pyspark import TaskContext

        fs, folder = opened(self.path)
        fs.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex[:8]}.bam"
        number = {r[0]: i for i, r in enumerate(self.references)}
        text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{m}\n" for n, m in self.references)
        head = MAGIC + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(number))
        head += b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", m) for n, m in self.references)
        rows, starts, where = [], [], []  # of records: (reference, begin, end); uncompressed place; of blocks: place
        with fs.open_output_stream(f"{folder}/_{name}") as out:
            out_at = 0

            def put(data: bytes) -> int:
                nonlocal out_at
                squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
                body = squeeze.compress(data) + squeeze.flush()
                block = BLOCK + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))
                out.write(block)
                out_at += len(block)
                return out_at

            for i in range(0, len(head), FULL):
                put(head[i : i + FULL])
            where.append(out_at)
            data, total = bytearray(), 0
            for batch in iterator:
                for r in batch.to_pylist():
                    record = encoded(r, number)
                    ref = number.get(r["reference"], -1)
                    span = _operations(r["cigar"])[2]
                    rows.append((ref, r["start"] or 0, (r["start"] or 0) + span))
                    starts.append(total)
                    data += record
                    total += len(record)
                    while len(data) >= FULL:
                        where.append(put(bytes(data[:FULL])))
                        del data[:FULL]
            if data:
                where.append(put(bytes(data)))
            out.write(END)
        starts.append(total)
        place = np.array(where, np.uint64)[np.array(starts) // FULL] << np.uint64(16) | (np.array(starts) % FULL).astype(np.uint64)
        ref, begin, end = np.array(rows, np.int64).reshape(-1, 3).T
        with fs.open_output_stream(f"{folder}/_{name}.bai") as out:
            out.write(index_bytes(len(number), ref, begin, end, place[:-1], place[1:]))
        return Written(f"{folder}/_{name}", f"{folder}/{name}")

    def commit(self, messages: list[Written]) -> None:
        fs, folder = opened(self.path)
        if self.overwrite:
            new = {m.made for m in messages if m} | {f"{m.made}.bai" for m in messages if m}
            for x in fs.get_file_info(pafs.FileSelector(folder)):
                if x.type == pafs.FileType.File and x.path not in new:
                    fs.delete_file(x.path)
        for m in messages:
            if m:
                fs.move(m.made, m.final)
                fs.move(f"{m.made}.bai", f"{m.final}.bai")

    def abort(self, messages: list[Written]) -> None:
        fs, _ = opened(self.path)
        for m in messages:
            if m:
                for made in (m.made, f"{m.made}.bai"):
                    fs.delete_file(made)


# ---------------------------------------------------------------- DataFrames


def read_bam(spark: SparkSession, path: str, split_bytes: int = SPLIT, region: str | None = None) -> DataFrame:
    """SCHEMA's columns, and rev and mapped, of the records of a file, folder or pattern; region `name:begin-end`, from 0, end exclusive."""
    spark.dataSource.register(BamSource)
    source = spark.read.format("bam").option("splitbytes", str(split_bytes))
    rows = (source.option("region", region) if region else source).load(path)
    return rows.withColumns({"rev": F.col("flag").bitwiseAND(16) != 0, "mapped": F.col("flag").bitwiseAND(4) == 0})


def write_bam(records: DataFrame, references: list[tuple[str, int]], path: str) -> None:
    """Records (SCHEMA's columns) as parts sorted by reference, in the order given, and start; each part is a BAM file of its own with an index.

    references: (name, bases) of the header, which every part carries. Parts cover one stretch of references and places after the other.
    """
    import json

    spark = records.sparkSession
    spark.dataSource.register(BamSource)
    order = {n: i for i, (n, _) in enumerate(references)}
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    rows = records.select(*(F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS))
    listed_ = F.broadcast(spark.createDataFrame(list(order.items()) or [("", 0)], "_ref string, _order int"))  # as large as the header
    placed = rows.join(listed_, F.col("reference") == F.col("_ref"), "left").withColumn("_last", F.col("_order").isNull())
    keys = ["_last", "_order", "start", "name", "flag"]
    placed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*COLUMNS).write.format("bam").option("references", json.dumps(references)).mode("overwrite").save(path)
