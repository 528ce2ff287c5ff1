"""Column expressions for symbols, codes and bit strings; all stay in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabet in code order (a=1 .. t=5), its two-bit part, and the Rice divisors of the codecs.
ALPHABET = "acgnt"
BASES = "acgt"
LENGTH_DIVISOR = 64
SHORT_DIVISOR = 8

#: How ordinary text is read as a sequence: letters, digits and spaces become bases in turn, all else becomes n.
LETTERS = string.ascii_lowercase + string.ascii_uppercase + string.digits + " "
AS_BASES = (BASES * 7)[:26] * 2 + (BASES * 3)[:10] + "g"


def sanitize_text(text: Column) -> Column:
    """Any text as a sequence of the same length in characters."""
    return F.regexp_replace(F.translate(text, LETTERS, AS_BASES), "[^acgt]", "n")


def sanitize(seq: Column) -> Column:
    """A sequence in lower case, with n for every other symbol."""
    return F.regexp_replace(F.lower(seq), "[^acgt]", "n")


def is_valid(seq: Column) -> Column:
    return seq.rlike("^[acgntACGNT]*$")


def first_invalid(seq: Column) -> Column:
    """0-based place of the first symbol outside the alphabet, -1 if there is none."""
    return F.regexp_instr(seq, F.lit("[^acgntACGNT]")).cast("long") - 1


def checked(seq: Column, name: Column) -> Column:
    """The sequence in lower case; fails with symbol and place if it holds another symbol."""
    at = first_invalid(seq)
    symbol = F.substring(seq, at.cast("int") + 1, F.lit(1))
    return F.when(at < 0, F.lower(seq)).otherwise(F.raise_error(F.concat(F.lit("invalid symbol '"), symbol, F.lit("' at "), at.cast("string"), F.lit(" of "), name)))


def code(symbol: Column) -> Column:
    """1..5 for a c g n t in either case, 0 for anything else."""
    return F.instr(F.lit(ALPHABET), F.lower(symbol)).cast("long")


def symbol_of(number: Column) -> Column:
    return F.substring(F.lit(ALPHABET), number.cast("int"), F.lit(1))


def two_bit(symbol: Column) -> Column:
    """0..3 for a c g t, -1 for anything else."""
    return F.instr(F.lit(BASES), F.lower(symbol)).cast("long") - 1


def base_of(number: Column) -> Column:
    return F.substring(F.lit(BASES), number.cast("int") + 1, F.lit(1))


def is_power_of_two(b: Column) -> Column:
    """For divisors: 2, 4, 8, ..."""
    return (b >= 2) & (b.bitwiseAND(b - 1) == 0)


def log2_of(b: Column) -> Column:
    return F.bit_count(b - 1).cast("long")


def position_bits(ref_len: Column) -> Column:
    """Bits that hold the positions 0 .. len(R); the last of them marks runs of n."""
    return F.when(ref_len > 0, F.length(F.bin(ref_len))).otherwise(F.lit(1)).cast("long")


def fixed_binary(n: Column, width: Column) -> Column:
    return F.when(width == 0, F.lit("")).otherwise(F.lpad(F.bin(n), width.cast("int"), F.lit("0")))


def from_binary(bits: Column) -> Column:
    return F.conv(bits, 2, 10).cast("long")


def rice(n: Column, divisor: int) -> Column:
    """Quotient in unary, a 0, the remainder in log2(divisor) bits."""
    k = divisor.bit_length() - 1
    return F.concat(F.repeat(F.lit("1"), F.shiftright(n, k).cast("int")), F.lit("0"), F.lpad(F.bin(n.bitwiseAND(divisor - 1)), F.lit(k), F.lit("0")))


def from_rice(bits: Column, divisor: int) -> Column:
    k = divisor.bit_length() - 1
    quotient = F.instr(bits, "0") - 1
    return quotient.cast("long") * divisor + from_binary(F.substring(bits, quotient + 2, F.lit(k)))


def rice_bits(n: Column, divisor: int) -> Column:
    """The length of such a code."""
    k = divisor.bit_length() - 1
    return F.shiftright(n, k) + 1 + k


def short_limit(width: Column) -> Column:
    """The longest factor that is cheaper as a literal."""
    return F.floor(F.lit(64.0) / 135 * (width + 3)).cast("long")
