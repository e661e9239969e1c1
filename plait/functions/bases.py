"""Bases and signatures as column expressions.

A signature is a string over ``acgt-`` and blank; blank means "not covered" and matches anything.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the order of codes 0 to 5.
ALPHABET = "acgt- "
BASES = "acgt-"


def normalise(seq: Column) -> Column:
    """Lower case; whatever is no base goes."""
    return F.regexp_replace(F.lower(seq), "[^acgt]", "")


def normalise_cells(row: Column) -> Column:
    """An alignment row: lower case, ``_`` is a gap, whatever else is no base is blank."""
    return F.regexp_replace(F.translate(F.lower(row), "_", "-"), "[^acgt-]", " ")


def code(base: Column) -> Column:
    """0 to 5; 5 for whatever is no base and no gap."""
    at = F.instr(F.lit(ALPHABET), base)
    return F.when(at > 0, at - 1).otherwise(5)


def letter(number: Column) -> Column:
    """The base of a code."""
    return F.substring(F.lit(ALPHABET), number + 1, F.lit(1))


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "acgt", "tgca")


def symbols(sig: Column) -> Column:
    """The signature's characters as an array; none for an empty one."""
    return F.when(F.length(sig) > 0, F.split(sig, "")).otherwise(F.array().cast("array<string>"))


def one_hot(sig: Column) -> Column:
    """Positions of the ones among 5 slots a column; blanks have none."""
    at = F.transform(symbols(sig), lambda b, i: F.when(b != " ", i * 5 + code(b)))
    return F.filter(at, lambda x: x.isNotNull())


def leave_one_out(sig: Column, v: Column) -> Column:
    """Input (all other columns) and target of the prediction of column ``v``, from 0."""
    rest = F.concat(F.substring(sig, F.lit(1), v), F.substring(sig, v + 2, F.length(sig)))
    return F.struct(rest.alias("x"), F.substring(sig, v + 1, F.lit(1)).alias("y"))


def tile(pattern: Column | str, length: int) -> Column:
    """``pattern`` over and over, ``length`` characters."""
    return F.rpad(F.lit(""), length, F.lit(pattern) if isinstance(pattern, str) else pattern)


def trim_and_pad(sig: Column, a: int) -> Column:
    """``a`` columns at each end become blank."""
    return F.concat(F.repeat(F.lit(" "), F.least(F.lit(a), F.length(sig))), F.substring(sig, F.lit(a + 1), F.greatest(F.length(sig) - 2 * a, F.lit(0))),
                    F.repeat(F.lit(" "), F.greatest(F.least(F.lit(a), F.length(sig) - a), F.lit(0))))


def blanks(sig: Column) -> Column:
    """How many columns are not covered."""
    return F.length(sig) - F.length(F.replace(sig, F.lit(" "), F.lit("")))


def template_parts(template: Column, parts: int, overlap: int = 0) -> Column:
    """Structs part, start, seq: windows of length/parts + overlap that wrap around the end."""
    size = F.floor(F.length(template) / parts).cast("int")
    twice = F.concat(template, template)
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(p.alias("part"), (p * size).alias("start"), F.substring(twice, p * size + 1, size + overlap).alias("seq")))


def cut_at(seq: Column, cuts: Column) -> Column:
    """Structs pos, seq: the pieces of a read between ascending cut positions."""
    ends = F.concat(cuts, F.array(F.length(seq)))
    return F.transform(ends, lambda e, i: F.struct(i.alias("pos"), F.substring(seq, F.when(i > 0, F.get(cuts, i - 1)).otherwise(0) + 1, e - F.when(i > 0, F.get(cuts, i - 1)).otherwise(0)).alias("seq")))


def _count(a: Column, b: Column, test) -> Column:
    return F.aggregate(F.zip_with(symbols(a), symbols(b), lambda x, y: F.when(test(x, y), 1).otherwise(0)), F.lit(0), lambda n, x: n + x)


def masked_hamming(a: Column, b: Column) -> Column:
    """Differing columns, blanks matching anything."""
    return _count(a, b, lambda x, y: (x != y) & (x != " ") & (y != " "))


def hamming(a: Column, b: Column) -> Column:
    return _count(a, b, lambda x, y: x != y)


def comparable(a: Column, b: Column) -> Column:
    """Columns that both cover."""
    return _count(a, b, lambda x, y: (x != " ") & (y != " "))


def consensus_mismatch(sig: Column, consensus: Column) -> Column:
    """Differing columns where the consensus is known."""
    return _count(sig, consensus, lambda x, y: (x != y) & (y != " "))
