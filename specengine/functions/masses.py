"""Element, residue and peptide masses.

Masses are added up as whole nano-Daltons (LONG).  The sums are exact, so they
do not depend on the order in which Spark adds the parts, and one division at
the end gives the mass in Daltons.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

NANO = 10**9

# Atom masses (monoisotopic, average).
ATOM_MASSES = {
    "H": ("1.007825035", "1.00794"),
    "O": ("15.99491463", "15.9994"),
    "N": ("14.003074", "14.0067"),
    "C": ("12.0", "12.0107"),
    "S": ("31.9720707", "32.065"),
    "P": ("30.973762", "30.973761"),
}

# Residue formulas used for monoisotopic masses.
RESIDUE_FORMULAS = {
    "A": "C3H5ON", "B": "C4H6O2N2", "C": "C3H5ONS", "D": "C4H5O3N",
    "E": "C5H7O3N", "F": "C9H9ON", "G": "C2H3ON", "H": "C6H7ON3",
    "I": "C6H11ON", "K": "C6H12ON2", "L": "C6H11ON", "M": "C5H9ONS",
    "N": "C4H6O2N2", "O": "C4H6O2N2", "P": "C5H7ON", "Q": "C5H8O2N2",
    "R": "C6H12ON4", "S": "C3H5O2N", "T": "C4H7O2N", "V": "C5H9ON",
    "W": "C11H10ON2", "Y": "C9H9O2N", "Z": "C5H8O2N2",
}

# Residues without a formula (monoisotopic).
RESIDUE_PLACEHOLDERS = {"J": "0.0", "U": "150.953640", "X": "111.060000"}

# Average residue masses.
AVERAGE_RESIDUES = {
    "A": "71.0788", "B": "114.1038", "C": "103.1388", "D": "115.0886",
    "E": "129.1155", "F": "147.1766", "G": "57.0519", "H": "137.1411",
    "I": "113.1594", "J": "0.0", "K": "128.1741", "L": "113.1594",
    "M": "131.1926", "N": "114.1038", "O": "114.1038", "P": "97.1167",
    "Q": "128.1307", "R": "156.1875", "S": "87.0782", "T": "101.1051",
    "U": "0.0", "V": "99.1326", "W": "186.2132", "X": "113.1594",
    "Y": "163.1760", "Z": "128.1307",
}

# Cysteine is always alkylated; masses added at the termini.
CYSTEINE_SHIFT = {"mono": "57.02146", "average": "57.0513"}
PROTON = "1.007276"
CLEAVE_N = "1.007276"
CLEAVE_C = "17.002735"
HYDROGEN = "1.007825035"


def to_nano(text: str) -> int:
    """A decimal string of Daltons as whole nano-Daltons."""
    return int(Decimal(text).scaleb(9))


def formula_nano(formula: str, mass_type: str = "mono") -> int:
    """Mass of a constant formula; used to build literal tables on the driver."""
    which = 0 if mass_type == "mono" else 1
    return sum(
        to_nano(ATOM_MASSES[atom][which]) * int(count or 1)
        for atom, count in re.findall(r"([A-Z])(\d*)", formula)
    )


def residue_table(mass_type: str = "mono") -> dict[str, int]:
    """Letter to nano-Daltons, cysteine shift included."""
    if mass_type == "mono":
        table = {aa: formula_nano(f) for aa, f in RESIDUE_FORMULAS.items()}
        table.update({aa: to_nano(m) for aa, m in RESIDUE_PLACEHOLDERS.items()})
    else:
        table = {aa: to_nano(m) for aa, m in AVERAGE_RESIDUES.items()}
    table["C"] += to_nano(CYSTEINE_SHIFT[mass_type])
    return table


def residue_nano(letter: Column, mass_type: str = "mono") -> Column:
    """Nano-Daltons of one upper-case letter (array literal lookup by code)."""
    table = residue_table(mass_type)
    masses = F.array(*[F.lit(table[chr(65 + i)]).cast("long") for i in range(26)])
    return F.get(masses, F.ascii(letter) - 65)


def peptide_nano(sequence: Column, mass_type: str = "mono") -> Column:
    """Exact nano-Daltons of a residue string; 0 for an empty one."""
    return F.aggregate(
        F.split(F.upper(sequence), ""),
        F.lit(0).cast("long"),
        lambda total, letter: total + F.coalesce(residue_nano(letter, mass_type), F.lit(0)),
    )


def nano_sum(nano: Column) -> Column:
    """Exact sum of whole nano-Daltons as a decimal: a LONG total overflows from about six million peptides on.

    The upper and the lower bits are added up as LONGs, which holds for 10^11 rows.
    """
    high, low = F.sum(F.shiftright(nano, 20)), F.sum(nano.bitwiseAND((1 << 20) - 1))
    return (high.cast("decimal(20,0)") * F.lit(1 << 20).cast("decimal(7,0)") + low.cast("decimal(20,0)")).cast("decimal(38,0)")


def daltons(nano: Column) -> Column:
    return nano.cast("double") / F.lit(float(NANO))


def peptide_mass(sequence: Column, mass_type: str = "mono") -> Column:
    return daltons(peptide_nano(sequence, mass_type))


def formula_mass(formula: Column, mass_type: str = "mono") -> Column:
    """`C6H12ON2` to Daltons: every letter starts an atom, digits count it."""
    which = 0 if mass_type == "mono" else 1
    atoms = F.create_map(*[
        F.lit(x) for a, m in ATOM_MASSES.items() for x in (a, to_nano(m[which]))
    ])
    parts = F.regexp_extract_all(formula, F.lit(r"([A-Z]\d*)"), F.lit(1))
    return daltons(F.aggregate(
        parts,
        F.lit(0).cast("long"),
        lambda total, part: total
        + F.element_at(atoms, F.substring(part, 1, 1)).cast("long")
        * F.coalesce(F.substring(part, 2, 10).try_cast("long"), F.lit(1).cast("long")),
    ))


MATCHING_OFFSET_NANO = to_nano(CLEAVE_C) + to_nano(CLEAVE_N) + to_nano(PROTON)


def matching_nano(nano: Column) -> Column:
    """Neutral residue mass to the M+H used to match precursors."""
    return nano + F.lit(MATCHING_OFFSET_NANO).cast("long")


def matching_mass(mass: Column) -> Column:
    return mass + F.lit(float(CLEAVE_C)) + F.lit(float(CLEAVE_N)) + F.lit(float(PROTON))


def mass_from_matching(mass: Column) -> Column:
    return mass - F.lit(float(CLEAVE_C)) - F.lit(float(CLEAVE_N)) - F.lit(float(PROTON))


def precursor_mass(mz: Column, charge: Column) -> Column:
    """Singly protonated mass of a precursor; charge 0 counts as 1."""
    z = F.when(charge == 0, 1).otherwise(charge)
    proton = F.lit(float(PROTON))
    return (mz - proton) * z + proton


def mz_from_mass(mass: Column, charge: Column) -> Column:
    z = F.when(charge == 0, 1).otherwise(charge)
    proton = F.lit(float(PROTON))
    return (mass - proton) / z + proton


def k_mass_index(mz: Column, spacing: float = 1.0005) -> Column:
    """Integer m/z index; a value that is already whole is kept as it is."""
    whole = mz.cast("int")
    return F.when(F.abs(mz - whole) < 0.00001, whole).otherwise(
        (mz / F.lit(spacing) + 0.5).cast("int")
    )
