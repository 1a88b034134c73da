"""Sequence functions: columns in, columns out, inside whole-stage code generation wherever Spark allows.

Coordinates are 0-based and half-open. Null sequences give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: complements of the four bases and N, and of all IUPAC codes in both cases
STRICT_FROM, STRICT_TO = "ACTGN", "TGACN"
IUPAC_FROM = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn"
IUPAC_TO = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"
# fixed value: channel order of decoded one-hot rows
DECODE_ORDER = ("A", "G", "C", "T")
BASES = ("A", "C", "G", "T")
LONG = "bigint"


def revcomp(s: Column) -> Column:
    """Reverse complement of upper-case A, C, G, T and N; other symbols stay."""
    return F.reverse(F.translate(s, STRICT_FROM, STRICT_TO))


def revcomp_iupac(s: Column) -> Column:
    """Reverse complement of all IUPAC codes, case kept."""
    return F.reverse(F.translate(s, IUPAC_FROM, IUPAC_TO))


def revcomp_bins(bins: Column) -> Column:
    """Reverse complement of each bin, bins in reverse order."""
    return F.reverse(F.transform(bins, revcomp))


def cut(s: Column, start: Column, end: Column) -> Column:
    """s[start:end) with the bounds clamped to the sequence."""
    lo = F.greatest(start, F.lit(0).cast(LONG))
    return F.substring(s, (lo + 1).cast("int"), F.greatest(end - lo, F.lit(0).cast(LONG)).cast("int"))


def strip_n(s: Column, right: bool = True) -> Column:
    """s without leading (and trailing) N."""
    left = F.regexp_replace(s, "^N+", "")
    return F.regexp_replace(left, "N+$", "") if right else left


def count_of(s: Column, symbol: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(symbol), F.lit("")))


def n_fraction(s: Column) -> Column:
    return count_of(s, "N").cast("double") / F.length(s)


def gc_fraction(s: Column) -> Column:
    return (count_of(s, "G") + count_of(s, "C")).cast("double") / F.nullif(F.length(s), F.lit(0))


def one_hot(s: Column) -> Column:
    """A row of four booleans (A, C, G, T) for each symbol; other symbols are all false."""
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.array(*(c == F.lit(b) for b in BASES)))


def one_hot_decode(rows: Column) -> Column:
    """Symbols of rows of four 0/1 numbers in the order A, G, C, T; a row without a one is N."""
    names = F.array(F.lit("N"), *map(F.lit, DECODE_ORDER))
    return F.array_join(F.transform(rows, lambda r: F.element_at(names, (F.array_position(r, 1) + 1).cast("int"))), "")


def bins(s: Column, width: int) -> Column:
    """Successive pieces of `width` symbols; the last may be shorter, an empty sequence has none."""
    # one pass: a substring counts symbols from the start each time
    return F.coalesce(F.regexp_extract_all(s, F.lit(f"(?s).{{1,{width}}}"), F.lit(0)), F.array().cast("array<string>"))


def bins_from_right(s: Column, width: int) -> Column:
    """Pieces of `width` symbols cut from the right end, nearest first; the farthest may be shorter."""
    return F.transform(bins(F.reverse(s), width), F.reverse)


def substitute(s: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """s with ref at 1-based pos replaced by alt; alt `-` deletes ref."""
    return F.concat(cut(s, F.lit(0).cast(LONG), pos - 1), F.when(alt == "-", "").otherwise(alt), cut(s, pos - 1 + F.length(ref), F.length(s).cast(LONG)))


def allele(ref: Column, alts: Column, genotype: Column) -> Column:
    """The allele a genotype number names; a missing (null or negative) number is the reference."""
    return F.element_at(F.concat(F.array(ref), alts), F.when(genotype >= 0, genotype + 1).otherwise(1).cast("int"))


def gtf_tags(attributes: Column) -> Column:
    """Values of the `tag` entries of a GTF attribute column, unquoted."""
    parts = F.filter(F.transform(F.split(attributes, ";"), lambda x: F.trim(x)), lambda x: x.startswith("tag "))
    return F.array_distinct(F.transform(parts, lambda x: F.replace(F.substring_index(x, " ", -1), F.lit('"'), F.lit(""))))


def gtf_attribute(attributes: Column, key: str) -> Column:
    """The last value of one attribute, unquoted; null where it is missing."""
    parts = F.filter(F.transform(F.split(attributes, ";"), lambda x: F.trim(x)), lambda x: x.startswith(key + " "))
    return F.replace(F.regexp_extract(F.try_element_at(parts, F.lit(-1)), "^[^ ]+ (.*)$", 1), F.lit('"'), F.lit(""))


def omim_ids(entries: Column) -> Column:
    """x of each `OMIM:x|...` entry, in order; null where there is none."""
    found = F.transform(F.filter(entries, lambda e: e.startswith("OMIM:")), lambda e: F.split_part(F.split_part(e, F.lit("|"), F.lit(1)), F.lit(":"), F.lit(2)))
    return F.when(F.size(found) > 0, found)


def encode_description(pairs: Column) -> Column:
    """`k:v;k:v` of an array of (k, v)."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit(":"), p["v"])), ";")


def decode_description(text: Column) -> Column:
    return F.str_to_map(text, F.lit(";"), F.lit(":"))


def region(chrom: Column, start: Column, end: Column) -> Column:
    """1-based closed region text of a 0-based half-open interval."""
    return F.concat(chrom, F.lit(":"), (start + 1).cast("string"), F.lit("-"), end.cast("string"))


def parse_mapping(text: Column) -> tuple[Column, Column, Column]:
    """chrom, strand and position of `chr8:+20601`."""
    return F.regexp_extract(text, "^([^:]+):", 1), F.regexp_extract(text, ":([+-])", 1), F.regexp_extract(text, "([0-9]+)$", 1).cast(LONG)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_odds_change(ref0: Column, ref1: Column, alt0: Column, alt1: Column) -> Column:
    """Absolute change of the log odds of class 1 between two pairs of logits."""
    return F.abs((ref1 - ref0) - (alt1 - alt0))


def argmax(logits: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def relative_bucket(distance: Column, buckets: int = 32, max_distance: int = 128) -> Column:
    """Bidirectional relative-position bucket: exact for small distances, logarithmic up to max_distance, capped beyond.

    The logarithm's bucket edges are found in whole numbers, so a distance on an edge belongs to the bucket that starts there."""
    half = buckets // 2
    exact = half // 2
    steps = half - exact
    edges = [next(n for n in range(exact, max_distance + 1) if n**steps * exact**k >= exact**steps * max_distance**k) for k in range(1, steps)]
    n = F.abs(distance)
    far = F.lit(exact)
    for edge in edges:
        far = far + (n >= edge).cast("int")
    return F.when(distance > 0, half).otherwise(0) + F.when(n < exact, n.cast("int")).otherwise(far)


def acceptor_axis(d: Column) -> Column:
    """Plot position of a distance: -20..-1 to d - 1, 1 to -1, 2..20 to d - 2."""
    return F.when(d.between(-20, -1), d - 1).when(d == 1, -1).when(d.between(2, 20), d - 2)


@F.udf(StringType(), useArrow=True)
def _two_decimals(x):
    return None if x is None else f"{x:.2f}"


def two_decimals(x: Column) -> Column:
    """x as Python's :.2f writes it: its exact binary value, ties to the even digit. Java's formatter rounds ties away from zero."""
    return _two_decimals(x.cast("double"))
