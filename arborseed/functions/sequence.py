"""Sequence functions as Column expressions; all but `decimals` stay in the JVM."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .sketch import NT

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Which base each letter of a text stands for when text is read as a genome.
PATTERN = "".join("ACGT"[i % 4] for i in range(26))


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dna(text: Column | str) -> Column:
    """Text as bases: letters a-z in either case are mapped, all else goes; null is empty."""
    letters = F.regexp_replace(F.coalesce(col(text), F.lit("")), "[^A-Za-z]", "")
    return F.translate(letters, LETTERS + LETTERS.upper(), PATTERN * 2)


def complement(s: Column | str) -> Column:
    """Case is kept; anything but a base becomes N."""
    return F.translate(F.regexp_replace(col(s), "[^ACGTacgt]", "N"), "ACGTacgt", "TGCAtgca")


def reverse_complement(s: Column | str) -> Column:
    """Upper-case bases only; other characters are reversed unchanged."""
    return F.translate(F.reverse(col(s)), "ACGT", "TGCA")


def compress_homopolymers(s: Column | str) -> Column:
    return F.regexp_replace(col(s), r"(?i)(.)\1+", "$1")


def homopolymer_starts(s: Column | str) -> Column:
    """0-based positions that compression keeps."""
    chars = F.split(F.lower(col(s)), "")
    return F.filter(F.sequence(F.lit(0), F.length(col(s)) - 1), lambda i: (i == 0) | (F.get(chars, i) != F.get(chars, i - 1)))


def mask_ends(s: Column | str, n: int) -> Column:
    """Without n bases at both ends; empty if nothing would be left."""
    s = col(s)
    return F.when(F.length(s) > 2 * n, F.substring(s, F.lit(n + 1), F.length(s) - 2 * n)).otherwise("")


def mean_phred(qual: Column | str, start: Column, k: int) -> Column:
    """Mean quality of k places from a 0-based start; 0 beyond the read."""
    qual = col(qual)
    span = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.ascii(F.substring(qual, start + i, F.lit(1))) - 33)
    return F.when((start >= 0) & (start + k <= F.length(qual)), F.aggregate(span, F.lit(0), lambda a, x: a + x) / F.lit(float(k))).otherwise(0.0)


def kmers(s: Column | str, k: int) -> Column:
    """All k-mers in order, in one linear pass."""
    return F.regexp_extract_all(col(s), F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def is_syncmer(kmer: Column, other: Column, k: int, s: int, t: int = 0, opened: bool = False) -> Column:
    """Whether on the k-mer or on its reverse complement `other` the least s-mer (by letters, ties count) is at offset t, or at k-s-t unless opened."""

    def one(x: Column) -> Column:
        parts = [F.substring(x, j + 1, s) for j in range(k - s + 1)]
        ends = parts[t] if opened or t == k - s - t else F.least(parts[t], parts[k - s - t])
        return ends == F.least(*parts)

    return one(kmer) | one(other)


def rotate_left(x: Column | str, r: int) -> Column:
    r %= 64
    return col(x) if r == 0 else F.shiftleft(col(x), r).bitwiseOR(F.shiftrightunsigned(col(x), 64 - r))


def rotate_right(x: Column | str, r: int) -> Column:
    return rotate_left(x, -r % 64)


def unsigned_key(x: Column | str) -> Column:
    """A signed value that orders as the unsigned 64-bit pattern does."""
    return col(x).bitwiseXOR(F.lit(-(1 << 63)))


def dust_short(s: Column | str) -> Column:
    """DUST complexity, 0 to 100, of reads of at most 64 three-mers: 200 times pairs of equal three-mers over n (n-1)."""
    found = kmers(F.regexp_replace(F.upper(col(s)), "[^ACGT]", ""), 3)
    n = F.size(found)
    kinds = F.array_distinct(found)
    pairs = F.aggregate(F.transform(kinds, lambda x: _pairs(found, x)), F.lit(0), lambda a, x: a + x)
    return F.when(n < 2, 0.0).otherwise(200.0 * pairs / (n * (n - 1)))


def _pairs(found: Column, x: Column) -> Column:
    c = F.size(F.filter(found, lambda y: y == x))
    return (c * (c - 1) / 2).cast("int")


def sanitized(name: Column | str) -> Column:
    return F.translate(col(name), "/| :\\", "_____")


def without_mate(name: Column | str) -> Column:
    return F.regexp_replace(col(name), "/[12]$", "")


def phred_of(p: Column | str) -> Column:
    return F.when(col(p) > 0, -10 * F.log10(col(p))).otherwise(100.0)


def probability_of(q: Column | str) -> Column:
    return F.pow(F.lit(10.0), -col(q) / 10)


def base_index(c: Column | str) -> Column:
    """A, C, G, T as 0 to 3, * as 4, all else 5."""
    at = F.instr(F.lit("ACGT*"), F.upper(col(c)))
    return F.when((at > 0) & (F.length(col(c)) == 1), at - 1).otherwise(5)


def non_empty_parts(s: Column | str, sep: str) -> Column:
    return F.filter(F.split(col(s), sep), lambda x: x != "")


def wrapped(s: Column | str, width: int = 80) -> Column:
    return F.regexp_replace(col(s), f"(.{{{width}}})(?=.)", "$1\n")


def sam_flag(paired: Column, proper: Column, unmapped: Column, mate_unmapped: Column, rev: Column, mate_rev: Column, first: Column) -> Column:
    bit = lambda c, v: F.when(c, v).otherwise(0)
    return bit(paired, 1) + bit(proper, 2) + bit(unmapped, 4) + bit(mate_unmapped, 8) + bit(rev, 16) + bit(mate_rev, 32) + F.when(paired, F.when(first, 64).otherwise(128)).otherwise(0)


def template_length(start: Column, end: Column, rev: Column, mate_start: Column, mate_end: Column, mate_rev: Column) -> Column:
    """From one read's 5' end to the other's, ends included, signed by order; 0 where both are the same place."""
    here, there = F.when(rev, end - 1).otherwise(start), F.when(mate_rev, mate_end - 1).otherwise(mate_start)
    return there - here + F.signum(there - here).cast("int")


def base_value(c: Column | str) -> Column:
    """The published 64-bit constant of a base, either case; 0 for anything else."""
    out = F.lit(0).cast("long")
    for base, value in NT.items():
        out = F.when(F.upper(col(c)) == base, F.lit(value - (1 << 64) if value >> 63 else value)).otherwise(out)
    return out


def sequence_hash(s: Column | str) -> Column:
    """The xor of the rotated values of a whole sequence; another letter than a base is an error, and nothing hashes to 0."""
    s = col(s)
    folded = F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: rotate_left(a, 1).bitwiseXOR(base_value(c)))
    return F.when(s.rlike("[^ACGTacgt]"), F.raise_error(F.lit("not a base sequence")).cast("long")).otherwise(folded)


def decimals(x: Column | str, places: int = 6) -> Column:
    """A number's text as C prints it: its exact binary value is rounded, a tie to the even digit. Java rounds its shortest decimal form, ties up."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array(["null" if v is None else f"{v:.{places}f}" for v in values.to_pylist()], pa.string())

    return run(col(x).cast("double"))
