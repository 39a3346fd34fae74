"""Sequence functions as column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
COMPLEMENT = "TGCA"
SEPARATOR = "%"
TERMINATOR = "$"

#: A view of ordinary text as bases, letter by letter: for test tables that hold no sequences.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
AS_BASES = "AAAACCGAGCCGTTCGATTTCGAGCT"


def clean(seq: Column, soft_mask: str = "upper") -> Column:
    """Upper-case bases; every other character is ``A``. ``soft_mask='A'`` also turns lower-case bases into ``A``."""
    if soft_mask not in ("upper", "A"):
        raise ValueError("soft_mask is 'upper' or 'A'")
    raised = F.translate(seq, BASES.lower(), BASES) if soft_mask == "upper" else seq
    return F.regexp_replace(raised, f"[^{BASES}]", "A")


def revcomp(seq: Column) -> Column:
    """Reverse complement of bases; other characters but ``#`` become ``A``."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT#]", "T"), BASES, COMPLEMENT))


def fold(text: Column) -> Column:
    """A text as bases; characters without a base are dropped, null is empty."""
    lower = F.translate(F.lower(F.coalesce(text, F.lit(""))), LETTERS, AS_BASES)
    return F.regexp_replace(lower, f"[^{BASES}]", "")


def kmer_code(kmer: Column) -> Column:
    """The 2-bit code of a k-mer of up to 31 bases, first base highest; null with any other character."""
    digits = F.translate(kmer, BASES, "0123")
    return F.when(kmer.rlike(f"^[{BASES}]+$"), F.conv(digits, 4, 10).cast("long"))


def kmer_decode(code: Column, k: int) -> Column:
    """The k-mer of a 2-bit code."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", BASES)


def legal(seq: Column, policy: int = 0, seed: int = 0) -> Column:
    """Reads' characters that are no bases: 0 leaves them (they never match), 1 makes them ``A``, 2 a base by place and
    seed."""
    if policy == 0:
        return seq
    if policy == 1:
        return F.regexp_replace(seq, f"[^{BASES}]", "A")
    if policy == 2:
        chars = F.filter(F.split(seq, ""), lambda c: c != "")
        drawn = F.transform(
            chars,
            lambda c, i: F.when(c.rlike(f"^[{BASES}]$"), c).otherwise(
                F.substring(F.lit(BASES), F.pmod(F.xxhash64(seq, i, F.lit(seed)), F.lit(4)).cast("int") + 1, 1)
            ),
        )
        return F.array_join(drawn, "")
    raise ValueError("policy is 0, 1 or 2")
