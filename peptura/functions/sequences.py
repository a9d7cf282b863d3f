"""Sequence and name functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that no k-mer may hold.
DISALLOWED = "BXUZOJ"
HYBRID_PREFIX = "hybrid_"


def counted(lo: Column, hi: Column) -> Column:
    """lo..hi, empty when hi < lo (Spark's sequence would count down)."""
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def prefixes(seq: Column) -> Column:
    return F.transform(counted(F.lit(1), F.length(seq)), lambda i: F.substring(seq, F.lit(1), i))


def suffixes(seq: Column) -> Column:
    """From the whole sequence down to its last letter."""
    return F.transform(counted(F.lit(1), F.length(seq)), lambda i: F.substring(seq, i, F.length(seq)))


def positions(seq: Column, part: Column) -> Column:
    """0-based starts of non-overlapping occurrences, from the left. One step for each occurrence, not each letter."""
    pieces = F.split(seq, F.concat(F.lit("\\Q"), part, F.lit("\\E")), -1)
    step = F.length(part)
    starts = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, p: F.struct((s["at"] + F.length(p) + step).alias("at"), F.concat(s["out"], F.array(s["at"] + F.length(p))).alias("out")),
    )
    return starts["out"]


def short_protein_name(name: Column) -> Column:
    return F.substring_index(name, "|", 2)


def lower_underscore(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def hyphenated(left: Column, right: Column) -> Column:
    return F.concat(left, F.lit("-"), right)


def hybrid_name(left: Column, right: Column) -> Column:
    return F.concat(F.lit(HYBRID_PREFIX), left, F.lit("-"), right)


def parse_hybrid_name(name: Column) -> tuple[Column, Column]:
    """Left and right pieces of ``hybrid_L-R``; anything else is an error."""
    pattern = "^hybrid_([^-]*)-([^-]*)$"
    wrong = F.raise_error(F.concat(F.lit("not a hybrid name: "), name)).cast("string")
    side = lambda i: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, i)).when(name.isNotNull(), wrong)
    return side(1), side(2)


RESULT_FILE = r"^(.+)\.comet\.(\d+)-\2\.(target|decoy)\.txt$"


def parse_result_file_name(name: Column) -> tuple[Column, Column, Column]:
    """Sample, scan and kind of a one-scan result file; empty strings where the name has another form."""
    return tuple(F.regexp_extract(name, RESULT_FILE, i) for i in (1, 2, 3))


def scan_number(spectrum_id: Column) -> Column:
    """The number after ``scan=`` or ``scanId=``; an id without one is an error."""
    n = F.regexp_extract(spectrum_id, r"(?:scan|scanId)=(\d+)", 1)
    return F.when(n != "", n).otherwise(F.raise_error(F.concat(F.lit("no scan number in "), spectrum_id)).cast("string")).cast("long")


def fasta_description(left_proteins: Column, right_proteins: Column) -> Column:
    join = lambda c: F.array_join(F.sort_array(c), ",")
    return F.concat(F.lit("left-prots:"), join(left_proteins), F.lit(";right-prots:"), join(right_proteins))


def kmer_overlap(b: Column, y: Column) -> Column:
    """Longest end of b that is a beginning of y."""
    fits = F.filter(counted(F.lit(1), F.least(F.length(b), F.length(y))), lambda i: F.right(b, i) == F.left(y, i))
    return F.coalesce(F.array_max(fits), F.lit(0))


def legacy_subsequence(seq: Column, start: Column, end: Column) -> Column:
    """end - start + 1 letters from the 1-based place ``start``; place 0 stands before the first letter."""
    return F.when(start == 0, F.substring(seq, F.lit(1), end - start)).otherwise(F.substring(seq, start, end - start + 1))


def digest_flags(seq: Column, start: Column, end: Column, left: list[str], right: list[str]) -> tuple[Column, Column]:
    """Whether seq[start:end] counts as a b and as a y k-mer under a digest rule; ['-'] stands for any cut."""
    at = lambda i: F.substring(seq, i + 1, F.lit(1))
    b = at(start).isin(left) | F.lit(left == ["-"]) | ((start > 0) & F.substring(seq, F.greatest(start, F.lit(1)), F.lit(1)).isin(right))
    y = at(end - 1).isin(right) | F.lit(right == ["-"]) | ((end < F.length(seq)) & at(end).isin(left))
    return b, y


def is_hybrid(proteins: Column) -> Column:
    """All proteins are hybrids; true on none, as 'all' is."""
    return F.forall(proteins, lambda p: F.startswith(p, F.lit(HYBRID_PREFIX)))


def junction_seqs(left: Column, right: Column) -> tuple[Column, Column]:
    """Product-ion sequences that span the junction: b and y ones."""
    b = F.transform(counted(F.lit(1), F.length(right)), lambda i: F.concat(left, F.left(right, i)))
    y = F.transform(counted(F.lit(1), F.length(left) - 1), lambda i: F.concat(F.substring(left, i + 1, F.length(left)), right))
    return b, y


def permuted(seq: Column, letters: str) -> Column:
    """All texts in which every one of the letters stands in each place that holds one of them."""
    chars = F.when(F.length(seq) == 0, F.array().cast("array<string>")).otherwise(F.split(seq, ""))
    return F.aggregate(
        chars, F.array(F.lit("")),
        lambda made, c: F.flatten(F.transform(made, lambda m: F.when(c.isin(list(letters)), F.array(*[F.concat(m, F.lit(x)) for x in letters])).otherwise(F.array(F.concat(m, c))))),
    )


def decoy(seq: Column) -> Column:
    """Reversed with the last residue kept."""
    n = F.length(seq)
    return F.when(n <= 2, seq).otherwise(F.concat(F.reverse(F.substring(seq, F.lit(1), n - 1)), F.right(seq, F.lit(1))))


def plain_digits(number: Column, places: int) -> Column:
    """A double of at most some places as text, with an exponent from 1e16 on only; Spark writes one from 1e7 on."""
    text, size = number.cast("string"), F.abs(number)
    digits = F.regexp_replace(number.cast(f"decimal(38,{max(places, 1)})").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((size >= 1e7) & (size < 1e16), digits).otherwise(F.regexp_replace(text, r"(\.0)?E(\d)", r"e+$2"))


def time_units(seconds: Column, places: int = 2) -> Column:
    """Seconds, minutes and hours in one line."""
    show = lambda c, unit: F.concat(plain_digits(F.round(c, places), places), F.lit(unit))
    return F.concat_ws(" = ", show(seconds, " secs"), show(seconds / 60, " mins"), show(seconds / 3600, " hrs"))


def next_multiple_of_10(n: Column) -> Column:
    return (F.floor(n / 10) + 1) * 10


def ion_type_code(ion_type: Column) -> Column:
    """b is 0, y is 1; null for anything else."""
    return F.when(ion_type == "b", 0).when(ion_type == "y", 1)


def ion_type_of(code: Column) -> Column:
    return F.when(code == 0, "b").when(code == 1, "y")


def string_to_bool(text: Column) -> Column:
    """False where the text holds an f of either case, true otherwise."""
    return ~F.contains(F.lower(text), F.lit("f"))


def to_percent(index: Column, total: Column) -> Column:
    """Whole percent, cut towards zero."""
    return (F.lit(100) * index / total).cast("int")


def hashable_boundaries(bounds: Column) -> Column:
    """Two bounds joined by a hyphen; null for any other number of them."""
    return F.when(F.size(bounds) == 2, F.array_join(bounds.cast("array<string>"), "-"))
