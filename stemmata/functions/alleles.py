"""Column functions over typing profiles: arrays of long alleles, or strings of nucleotides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alleles that count as missing; the second is written by fixed-width padding.
MISSING_ALLELES = (-1, 0)
#: Nucleotide symbols that count as missing.
MISSING_SYMBOLS = ("?", "-", " ")
_INTEGER = "^[+-]?[0-9]+$"


def normalise_allele(token: Column) -> Column:
    """An allele number, or -1 for null, blank, '?', 'N', and whatever is no 64-bit integer."""
    trimmed = F.trim(token)
    return F.coalesce(F.when(trimmed.rlike(_INTEGER), trimmed.try_cast("bigint")), F.lit(-1).cast("bigint"))


def normalise_alleles(tokens: Column) -> Column:
    return F.transform(tokens, normalise_allele)


def is_missing(allele: Column) -> Column:
    return allele.isin(*MISSING_ALLELES)


def is_missing_symbol(symbol: Column) -> Column:
    return symbol.isin(*MISSING_SYMBOLS)


def missing_positions(alleles: Column) -> Column:
    """0-based places of missing alleles."""
    marked = F.transform(alleles, lambda a, i: F.when(is_missing(a), i))
    return F.filter(marked, lambda i: i.isNotNull())


def missing_symbol_positions(sequence: Column) -> Column:
    marked = F.transform(F.split(sequence, ""), lambda c, i: F.when(is_missing_symbol(c), i))
    return F.filter(marked, lambda i: i.isNotNull())


def allele_at(alleles: Column, place: int | Column) -> Column:
    """The allele at a 0-based place; an error beyond the ends."""
    return F.element_at(alleles, F.lit(place) + 1 if isinstance(place, int) else (place + 1).cast("int"))


def compare_at(a: Column, b: Column, place: int | Column) -> Column:
    """-1, 0 or 1."""
    x, y = allele_at(a, place), allele_at(b, place)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def same_profile(a: Column, b: Column) -> Column:
    return a == b


def symbols(sequence: Column) -> Column:
    """A nucleotide string as an array of one-letter strings."""
    return F.split(sequence, "")


def is_nucleotides(sequence: Column) -> Column:
    return sequence.rlike("^[ACGT]*$")


def pack_nucleotides(sequence: Column) -> Column:
    """Two bits a base (A 00, C 01, G 10, T 11) as a bit string, first base first; null if other symbols occur."""
    bits = F.array_join(F.transform(symbols(sequence), lambda c: F.when(c == "A", "00").when(c == "C", "01").when(c == "G", "10").when(c == "T", "11")), "")
    return F.when(is_nucleotides(sequence), bits)


def padded(alleles: Column, length: int) -> Column:
    """Short profiles filled up with the missing allele 0."""
    return F.when(F.size(alleles) >= length, alleles).otherwise(F.concat(alleles, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(length) - F.size(alleles), F.lit(0)))))


def valid_point(id_: Column, alleles: Column) -> Column:
    """Ids are at least 0, profiles hold something."""
    return F.coalesce((id_ >= 0) & (F.size(alleles) > 0), F.lit(False))
