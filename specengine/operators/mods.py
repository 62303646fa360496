"""Peptide modifications: parsing, variants, compatibility."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specengine.functions.arrays import once
from specengine.functions.masses import formula_nano, residue_nano, to_nano
from specengine.functions.peptide import format_mod_sequence

GLOBAL, N_TERMINAL, C_TERMINAL = "Global", "NTerminal", "CTerminal"
DEFAULT_MAX_MODS = 2

MOD_TYPE = "array<struct<pos:int,label:string,nano:bigint,aa:string,restriction:string>>"


@dataclass(frozen=True)
class Modification:
    """One configured mass change; residue None means any."""

    mass: str
    residue: str | None = None
    restriction: str = GLOBAL
    fixed: bool = False

    @property
    def nano(self) -> int:
        return to_nano(self.mass)


def terminal_mods() -> list[Modification]:
    """N-terminal losses that every search considers: Q and C lose NH3, E loses H2O."""
    return [
        Modification(str(-formula_nano(f) / 10**9), aa, N_TERMINAL)
        for aa, f in (("Q", "NH3"), ("C", "NH3"), ("E", "H2O"))
    ]


def parse_mods(text: str, fixed: bool = False) -> list[Modification]:
    """`15.9949@M,42.011@[` to modifications; `[` and `]` stand for the termini."""
    mods = []
    for item in filter(None, (part.strip() for part in text.split(","))):
        restriction = GLOBAL
        if item.endswith("["):
            restriction, item = N_TERMINAL, item[:-1]
        elif item.endswith("]"):
            restriction, item = C_TERMINAL, item[:-1]
        mass, _, residue = item.partition("@")
        mods.append(Modification(mass, residue or None, restriction, fixed))
    return mods


def label_of(mod: Modification) -> str:
    return f"{float(mod.mass):.3f}".rstrip("0").rstrip(".")


def _site(mod: Modification, pos: Column, letter: Column) -> Column:
    return F.struct(
        pos.cast("int").alias("pos"),
        F.lit(label_of(mod)).alias("label"),
        F.lit(mod.nano).cast("long").alias("nano"),
        letter.alias("aa"),
        F.lit(mod.restriction).alias("restriction"),
    )


def _inner_sites(sequence: Column, mod: Modification) -> Column:
    every = F.transform(F.split(sequence, ""), lambda c, i: _site(mod, i + 1, c))
    return F.filter(every, lambda s: s.aa == mod.residue) if mod.residue else every


def _sites(sequence: Column, mods: list[Modification]) -> Column:
    """Every (modification, residue) place in a peptide, ordered by position."""
    found = [F.array().cast(MOD_TYPE)]
    for mod in mods:
        if mod.restriction == GLOBAL:
            found.append(_inner_sites(sequence, mod))
            continue
        pos = F.lit(1) if mod.restriction == N_TERMINAL else F.length(sequence)
        letter = F.substring(sequence, pos, F.lit(1))
        matches = letter == mod.residue if mod.residue else F.lit(True)
        found.append(F.when(matches, F.array(_site(mod, pos, letter))).otherwise(
            F.array().cast(MOD_TYPE)))
    return F.array_sort(F.concat(*found))


def apply_mods(peptides: DataFrame, mods: list[Modification],
               max_mods: int = DEFAULT_MAX_MODS, with_terminal: bool = True,
               fixed_mandatory: bool = False) -> DataFrame:
    """Each peptide unmodified and with every choice of up to `max_mods` sites.

    A variant never modifies one residue twice.  A peptide has at most 40
    residues, so the number of variants per row is bounded and they are made
    in the row, without a join.  Fixed modifications make variants like the
    others unless `fixed_mandatory`, which puts them on every variant.
    """
    fixed = [m for m in mods if m.fixed and fixed_mandatory]
    chosen = [m for m in mods if m not in fixed] + (terminal_mods() if with_terminal else [])
    sequence = F.col("sequence")
    df = once(once(peptides, "_sites", _sites(sequence, chosen)), "_fixed", _sites(sequence, fixed))
    none = F.array(F.array().cast(MOD_TYPE))
    level, levels = none, [none]
    for _ in range(max_mods):
        level = F.flatten(F.transform(level, lambda chosen_: F.transform(
            F.filter(F.col("_sites"), lambda s: (
                F.size(chosen_) == 0) | (s.pos > F.get(chosen_, F.size(chosen_) - 1).pos)),
            lambda s: F.concat(chosen_, F.array(s)),
        )))
        levels.append(level)
    df = df.withColumn("mods", F.explode_outer(F.concat(*levels)))
    if fixed:
        taken = lambda m: F.exists("_fixed", lambda f: f.pos == m.pos)
        df = df.filter(~F.exists("mods", taken)).withColumn(
            "mods", F.array_sort(F.concat("mods", "_fixed")))
    df = df.drop("_sites", "_fixed")
    plain = F.size("mods") == 0
    return df.withColumn(
        "mod_sequence",
        F.when(plain, sequence).otherwise(format_mod_sequence(sequence, F.col("mods"))),
    )


def mods_nano(mods: Column) -> Column:
    return F.aggregate(mods, F.lit(0).cast("long"), lambda t, m: t + m.nano)


def mods_compatible(mods: Column, length: Column, allowed: list[tuple[str, str]]) -> Column:
    """Every interior modification is a configured (residue, label); the two ends are not checked.

    Unmodified peptides pass; with nothing allowed, a modified one does not.
    """
    if not allowed:
        return F.size(mods) == 0
    names = F.array(*[F.lit(f"{aa}:{label}") for aa, label in allowed])
    inner = F.filter(mods, lambda m: (m.pos > 1) & (m.pos < length))
    return F.forall(inner, lambda m: F.array_contains(
        names, F.concat(m.aa, F.lit(":"), m.label)))


def residue_masses(sequence: Column, mods: Column | None = None) -> Column:
    """Nano-Daltons of each residue, modifications added."""
    masses = F.transform(F.split(sequence, ""), lambda c: residue_nano(c))
    if mods is None:
        return masses
    shifted = F.transform(masses, lambda m, i: m + F.aggregate(
        F.filter(mods, lambda x: x.pos == i + 1), F.lit(0).cast("long"), lambda t, x: t + x.nano))
    return F.when(F.size(mods) > 0, shifted).otherwise(masses)
