import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from arborseed.llm import packing
from arborseed.llm.queries import tokenizer_json

TEXTS = [None, "", "a", "The theea's 12 ½x² don't_stop  \t\n\n  end ", "ça va? Ñandú œuvre ß€ 漢字 <|endoftext|>   x", "wörd " * 3000, "same", "same", "x" * 9000]


def encode(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_json())
    return [*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_pieces_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "y")], "doc_id long, text string, length string")
    rows = packing.pack(docs, tokenizer_json(), length=256, group=4).collect()
    for i, text in enumerate(TEXTS):
        ids = encode(text)
        pieces = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == list(np.cumsum([0, *(r["length"] for r in pieces[:-1])]))
        assert sum(r["length"] for r in pieces) == len(ids) == pieces[0]["doc_tokens"]
        for r in pieces:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == r["ids_crc32"]
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 256
    assert packing.pack(docs.limit(0), tokenizer_json()).count() == 0


def test_repeated_rows_are_dealt_to_all_groups(spark):
    df = spark.createDataFrame([(7, "the same words again")] * 400 + [(None, None)] * 40, "doc_id long, text string").repartition(3)
    rows = packing.pack(df, tokenizer_json(), length=64, group=20).collect()
    assert len(rows) == 440 and sum(r["doc_id"] is None for r in rows) == 40
    sizes = np.bincount([r["sequence_id"] >> 32 for r in rows])
    assert len(sizes) == 22 and sizes.max() < 60
    filled = {}
    for r in rows:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert max(filled.values()) <= 64


@given(st.lists(st.integers(1, 64), max_size=80))
def test_first_fit_decreasing_is_first_fit(lengths):
    bins, offsets = packing.first_fit_decreasing(lengths, 64)
    room: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        at = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if at == len(room):
            room.append(64)
        assert (bins[i], offsets[i]) == (at, 64 - room[at])
        room[at] -= lengths[i]


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_plain_split_agrees(text):
    import re

    import regex

    if not re.search(packing.NOT_PLAIN, text):
        assert re.findall(packing.PLAIN_SPLIT, text) == regex.findall(packing.SPLIT, text)
