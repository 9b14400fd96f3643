"""Alphabets: which letters a sequence may have, and their integer codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Alphabet:
    """codes: letter to code. Other letters get invalid. fold: letters of either case are the same."""

    name: str
    size: int
    letters: str
    invalid: int
    fold: bool = True

    def codes(self) -> dict[str, int]:
        found = {c: i for i, c in enumerate(self.letters)}
        return found | {c.lower(): i for c, i in found.items()} if self.fold else found

    def table(self) -> Column:
        """Codes by code point, of ASCII letters."""
        codes = self.codes()
        return F.expr("array(" + ", ".join(str(codes.get(chr(c), self.invalid)) for c in range(128)) + ")")

    def encode(self, text: Column) -> Column:
        """A string to its array of codes; null stays null."""
        table = self.table()
        letters = F.filter(F.split(text, ""), lambda c: c != "")
        return F.transform(letters, lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(self.invalid)))

    def encode_known(self, text: Column) -> Column:
        """As encode(), without what the alphabet doesn't have: other letters go before the string is taken apart."""
        known = "".join(c for c, i in self.codes().items() if i < self.size)
        return F.filter(self.encode(F.regexp_replace(text, f"[^{known}]", "")), lambda c: c < self.size)

    def decode(self, codes: Column) -> Column:
        letters = F.array(*map(F.lit, self.letters))
        return F.array_join(F.transform(codes, lambda c: F.coalesce(F.get(letters, c), F.lit("?"))), "")


# The letters in the order of their codes.
DNA5 = Alphabet("dna5", 5, "NACGT", 5)
DNA4 = Alphabet("dna4", 4, "ACGT", 5)
PROTEIN = Alphabet("protein", 26, "ABCDEFGHIJKLMNOPQRSTUVWYZX", 25)
UPPER_DNA = Alphabet("upper_dna", 4, "ACGT", 4, fold=False)
LETTERS = Alphabet("letters", 26, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26, fold=False)

_BY_NAME = {a.name: a for a in (DNA5, DNA4, PROTEIN, UPPER_DNA, LETTERS)}


def alphabet(name: str) -> Alphabet:
    try:
        return _BY_NAME[name.lower()]
    except KeyError:
        raise ValueError(f"unknown alphabet {name!r}; known are {', '.join(_BY_NAME)}") from None


def valid_codes(seq: Column, size: int) -> Column:
    """Codes within the alphabet."""
    return F.filter(seq, lambda c: (c >= 0) & (c < size))


def reverse_complement(seq: Column) -> Column:
    """Of codes A C G T = 0 1 2 3."""
    return F.transform(F.reverse(seq), lambda c: c.bitwiseXOR(F.lit(3)))


def stranded(seq: Column, strand: Column) -> Column:
    return F.when(strand == "-", reverse_complement(seq)).otherwise(seq)
