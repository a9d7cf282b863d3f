"""Residue masses and mass arithmetic as column expressions.

Masses have exactly seven decimals, so sums are taken in integer units of 1e-7 Da: they do not depend on the order of
addition and are equal in every engine. They become doubles once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Monoisotopic residue masses (Da).
RESIDUES = {
    "A": 71.0371138, "R": 156.1011110, "N": 114.0429274, "D": 115.0269430, "C": 103.0091845, "E": 129.0425931,
    "Q": 128.0585775, "G": 57.0214637, "H": 137.0589119, "I": 113.0840640, "L": 113.0840640, "K": 128.0949630,
    "M": 131.0404846, "F": 147.0684139, "P": 97.0527639, "S": 87.0320284, "T": 101.0476785, "W": 186.0793130,
    "Y": 163.0633285, "U": 168.9641990, "V": 99.0684139,
}
#: Residue masses of the older engine (Da).
LEGACY_RESIDUES = {
    "A": 71.037114, "R": 156.101111, "N": 114.042927, "D": 115.026943, "C": 103.009185, "E": 129.042593,
    "Q": 128.058578, "G": 57.021464, "H": 137.058912, "I": 113.084064, "L": 113.084064, "K": 128.094963,
    "M": 131.040485, "F": 147.068414, "P": 97.052764, "S": 87.032028, "T": 101.047679, "U": 150.95363,
    "W": 186.079313, "Y": 163.06332, "V": 99.068414,
}
PROTON_MASS = 1.00727646688
WATER_MASS = 2 * 1.007825035 + 15.99491463
#: m/z bases of the older engine by (ion type, charge).
LEGACY_BASES = {
    ("b", 1): 1.007825035 - 0.0005486,
    ("b", 2): 2 * 1.007825035 - 2 * 0.0005486,
    ("y", 1): 3 * 1.007825035 + 15.99491463 - 0.0005486,
    ("y", 2): 4 * 1.007825035 + 15.99491463 - 2 * 0.0005486,
}
DEFAULT_PPM, LEGACY_PPM = 20.0, 10.0


def _units(residues: dict[str, float], scale: int) -> Column:
    """Array of integer masses for A to Z, null where a letter is no residue."""
    return F.array(*[F.lit(round(residues[c] * scale)).cast("long") if c in residues else F.lit(None).cast("long") for c in map(chr, range(65, 91))])


def residue_units(letter: Column) -> Column:
    """Mass of one letter in 1e-7 Da, null for an unknown one."""
    at = F.ascii(letter) - 64
    return F.when((at >= 1) & (at <= 26), F.element_at(_units(RESIDUES, 10**7), F.when((at >= 1) & (at <= 26), at).otherwise(1)))


def mass_units(seq: Column) -> Column:
    """Sum of residue masses in 1e-7 Da; null if the sequence holds an unknown residue, 0 if it is empty."""
    table = _units(RESIDUES, 10**7)
    known = ~seq.rlike("[^A-Z]")
    letters = F.when(F.length(seq) == 0, F.array().cast("array<string>")).otherwise(F.split(seq, ""))
    total = F.aggregate(F.transform(letters, lambda c: F.element_at(table, F.ascii(c) - 64)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(known, total)


def aa_mass(seq: Column) -> Column:
    return mass_units(seq) / F.lit(1e7)


def checked_aa_mass(seq: Column) -> Column:
    """As aa_mass, but an unknown residue is an error."""
    m = aa_mass(seq)
    return F.when(seq.isNotNull() & m.isNull(), F.raise_error(F.concat(F.lit("unknown residue in "), seq)).cast("double")).otherwise(m)


def legacy_mass(seq: Column) -> Column:
    table = _units(LEGACY_RESIDUES, 10**6)
    letters = F.when(F.length(seq) == 0, F.array().cast("array<string>")).otherwise(F.split(seq, ""))
    return F.aggregate(F.transform(letters, lambda c: F.element_at(table, F.ascii(c) - 64)), F.lit(0).cast("long"), lambda a, x: a + x) / F.lit(1e6)


def b_mz(mass: Column, charge: Column) -> Column:
    return (mass + charge * PROTON_MASS) / charge


def y_mz(mass: Column, charge: Column) -> Column:
    return (mass + WATER_MASS + charge * PROTON_MASS) / charge


def ion_mz(mass: Column, charge: Column, ion_type: Column) -> Column:
    wrong = F.raise_error(F.concat(F.lit("no such ion type: "), ion_type)).cast("double")
    return F.when(ion_type == "b", b_mz(mass, charge)).when(ion_type == "y", y_mz(mass, charge)).otherwise(wrong)


def precursor_mz(mass: Column, charge: Column) -> Column:
    return y_mz(mass, charge)


def legacy_ion_mz(mass: Column, charge: Column, ion_type: Column) -> Column:
    base = F.lit(None).cast("double")
    for (kind, z), value in LEGACY_BASES.items():
        base = F.when((ion_type == kind) & (charge == z), F.lit(value)).otherwise(base)
    return (base + mass) / charge


def ppm_to_dalton(ppm, reference: Column) -> Column:
    return F.lit(ppm) * reference / 1e6


def ppm_to_da_abs(ppm, mass: Column) -> Column:
    return F.abs(F.lit(ppm) / 1e6 * mass)


def ppm_diff(first: Column, second: Column) -> Column:
    """Relative to the first argument."""
    return F.abs(first - second) / first * 1e6


def mz_diff(ion: Column, peak: Column, ppm: bool = False) -> Column:
    return (ion - peak) / ion * (1e6 if ppm else 1)


def b_ion_bounds(mz: Column, charge: Column, ppm) -> tuple[Column, Column]:
    """Bounds on the residue mass of b ions within ppm of a peak."""
    tol = ppm_to_dalton(ppm, mz)
    return charge * (mz - tol - PROTON_MASS), charge * (mz + tol - PROTON_MASS)


def y_ion_bounds(mz: Column, charge: Column, ppm) -> tuple[Column, Column]:
    lo, hi = b_ion_bounds(mz, charge, ppm)
    return lo - WATER_MASS, hi - WATER_MASS
