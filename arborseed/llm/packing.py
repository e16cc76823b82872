"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

A document's ids are cut into full sequences and one remainder; the remainders of a group are placed longest first, each
into the first bin that has room. The tournament tree holds the largest free capacity below each node, so the first bin
with room is found in logarithmic time. Groups are dealt by a salted hash of the row and, for rows repeated within a task, of
their number there, so a group's size is bounded whatever the table holds; groups are packed independently.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, MASK, mix, small_batches, tidy

#: Tokens of a sequence, the id after each document, documents of a group on average.
LENGTH, END_ID, GROUP = 1024, 0, 1024
#: Pre-tokens whose ids a worker keeps.
KEPT = 400_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long, tie long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: The public pattern that splits text before byte-pair merging, as tokenizers' byte-level pre-tokenizer applies it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: The same split for texts of ASCII and Latin letters only, where Python's own faster `re` tells the classes apart alike.
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NOT_PLAIN = r"[^\t\n -~À-ÖØ-öø-ž]"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(own)))}


class _Ids(dict):
    """pre-token -> its ids as little-endian 32-bit integers; byte-pair merging runs once per pre-token kept."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.whole, self.letters = Tokenizer.from_file(tokenizer_json), byte_letters()
        self.merge = self.whole.model.tokenize
        with open(tokenizer_json, encoding="utf-8") as f:
            self.added = re.compile("|".join(re.escape(x["content"]) for x in json.load(f)["added_tokens"]) or "(?!)").search

    def __missing__(self, piece: str) -> bytes:
        if len(self) > KEPT:
            self.clear()
        found = self.merge(piece.encode().decode("latin-1").translate(self.letters))
        made = self[piece] = struct.pack(f"<{len(found)}I", *[x.id for x in found])
        return made

    def encoded(self, text: str, find) -> bytes:
        """The ids of a text; one that holds an added token goes to the tokenizer as a whole."""
        if self.added(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, find(text)))


def ids_of(tokenizer_json: str) -> _Ids:
    """One table for all tasks of a Python worker, until another operator runs there."""
    tables = CACHES.setdefault("packing", {})
    if tokenizer_json not in tables:
        tables[tokenizer_json] = _Ids(tokenizer_json)
    return tables[tokenizer_json]


class TournamentTree:
    """Free capacities of the bins; each inner node holds the larger of its two children's."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.size)

    def place(self, need: int) -> tuple[int, int]:
        """(the first bin with room, the place in it), after taking the room."""
        free, i = self.free, 1
        while i < self.size:
            i *= 2
            if free[i] < need:
                i += 1
        at = free[i]
        free[i] = at - need
        leaf = i
        while i > 1:
            i //= 2
            most = max(free[2 * i], free[2 * i + 1])
            if free[i] == most:
                break
            free[i] = most
        return leaf - self.size, at


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed longest first; equal lengths in the order given."""
    tree = TournamentTree(len(lengths), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        bins[i], left = tree.place(lengths[i])
        offsets[i] = capacity - left
    return bins, offsets


def tokenized_pieces(docs: DataFrame, tokenizer_json: str, groups: int, length: int = LENGTH) -> DataFrame:
    """A row for each piece of each document; a null text is empty and so only the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find, plain, odd, ids = regex.compile(SPLIT).findall, re.compile(PLAIN_SPLIT).findall, re.compile(NOT_PLAIN).search, ids_of(tokenizer_json)
        end, task, seen = np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId(), Counter()
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            ties = batch.column(1).to_pylist()
            numbers = []
            for tie in ties:
                numbers.append(seen[tie])
                seen[tie] += 1
            dealt = _groups(batch.column(1).to_numpy().view(np.uint64), task, np.array(numbers, np.uint64), groups).tolist()
            for doc, tie, grp, text in zip(batch.column(0).to_pylist(), ties, dealt, batch.column(2).to_pylist(), strict=True):
                held = ids.encoded(text := text or "", find if odd(text) else plain) + end
                total = len(held) // 4
                rows += [(doc, s, min(length, total - s), zlib.crc32(held[4 * s : 4 * (s + length)]), total, grp, tie) for s in range(0, total, length)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.lit(11), docs["doc_id"], docs["text"]).alias("tie"), docs["text"].cast("string").alias("text"))
    small_batches(docs)
    return rows.mapInArrow(tidy(run, "packing"), PIECES)


def _groups(tie: np.ndarray, task: int, number: np.ndarray, groups: int) -> np.ndarray:
    """The groups of a task's rows by hash and number among the rows of that hash; they don't depend on the order of the rows."""
    return (mix(tie + number * np.uint64(0x9E3779B97F4A7C15) + np.uint64((task + 1) * 0xC2B2AE3D27D4EB4F & MASK)) % np.uint64(groups)).astype(np.int64)


def pack(docs: DataFrame, tokenizer_json: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """A row for each piece: where it lies in its document and in its sequence.

    The sum of a sequence's pieces is its length; a reader pads it to `length` unless it is a power of two. Null and empty
    texts hold the end id only; null ids and repeated rows are documents of their own; an empty table gives no rows; other
    columns are ignored. sequence_id is the group times 2**32 plus the bin.
    """
    groups = max(1, -(-docs.count() // group))

    def fit(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "tie", "doc_id", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pieces["length"].tolist(), length)
        return pieces.assign(sequence_id=pieces["grp"] * (1 << 32) + bins, offset=offsets)[[x.split()[0] for x in PACKED.split(", ")]]

    return tokenized_pieces(docs, tokenizer_json, groups, length).groupBy("grp").applyInPandas(fit, PACKED)
