"""Theoretical fragment ions of a peptide, made in its row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specengine.functions.arrays import once
from specengine.functions.masses import CLEAVE_C, CLEAVE_N, HYDROGEN, to_nano
from specengine.operators.mods import residue_masses
from specengine.session import spread_work

# Added to the residues of a b or y fragment; each further charge adds one hydrogen.
B_NANO = to_nano(CLEAVE_N)
Y_NANO = to_nano(CLEAVE_C) + 2 * to_nano(HYDROGEN)
CHARGE_NANO = to_nano(HYDROGEN)
MAX_ION_CHARGE = 3

# Ion types, the terminus they hold, their partner and what they are short of or above.
ION_TYPES = [
    ("A", "N", "X", "CO", -1), ("B", "N", "Y", "", 0), ("C", "N", "Z", "NH3", 1),
    ("X", "C", "A", "CO", 1), ("Y", "C", "B", "", 0), ("Z", "C", "C", "NH3", -1),
]

# Intensity factors of fragments by their last residue, and of the second b ion.
Y_FACTORS = {"P": 5.0}
B_FACTORS = {"D": 5.0, "N": 2.0, "Q": 2.0, "V": 3.0, "E": 3.0, "I": 3.0, "L": 3.0}
SECOND_B_PROLINE, SECOND_B = 10.0, 3.0


def ion_types(spark) -> DataFrame:
    return spark.createDataFrame(
        ION_TYPES, "type string, terminus string, pair string, formula string, sign int")


def prefix_masses(masses: Column) -> Column:
    """Running sums of the residues, starting with 0."""
    return F.aggregate(
        masses, F.array(F.lit(0).cast("long")),
        lambda out, m: F.concat(out, F.array(F.element_at(out, -1) + m)))


def _factor(letter: Column, table: dict[str, float]) -> Column:
    factors = F.array(*[F.lit(table.get(chr(65 + i), 1.0)) for i in range(26)])
    return F.get(factors, F.ascii(letter) - 65)


ALL_FIELDS = ("z", "pos", "type", "nano", "mz", "weight")


def with_ions(peptides: DataFrame, max_charge: int = MAX_ION_CHARGE,
              fields: tuple[str, ...] = ALL_FIELDS) -> DataFrame:
    """Add `ions`: an array of structs with the wanted fields.

    Order: charge, then cleavage place, then b before y.  `nano` is the exact
    mass before the division by charge.  The y fragment of place i holds the
    residues after i; the last place has only a b ion.
    """
    mods = F.col("mods") if "mods" in peptides.columns else None
    spread = spread_work(peptides, "mod_sequence" if "mod_sequence" in peptides.columns
                         else "sequence")
    df = once(spread, "_pre", prefix_masses(residue_masses(F.col("sequence"), mods)))
    length = F.length("sequence")

    def ion(z: int, i: Column, kind: str) -> Column:
        extra = (z - 1) * CHARGE_NANO
        if kind == "b":
            nano = F.get("_pre", i) + F.lit(B_NANO + extra).cast("long")
            weight = _factor(F.substring(F.col("sequence"), i, F.lit(1)), B_FACTORS) * F.when(
                i == 2, F.when(F.col("sequence").startswith("P"), SECOND_B_PROLINE)
                .otherwise(SECOND_B)).otherwise(1.0)
        else:
            nano = F.element_at("_pre", -1) - F.get("_pre", i) + F.lit(Y_NANO + extra).cast("long")
            weight = _factor(F.right(F.col("sequence"), F.lit(1)), Y_FACTORS)
        made = {"z": F.lit(z), "pos": i.cast("int"), "type": F.lit(kind), "nano": nano,
                "mz": nano.cast("double") / F.lit(float(z * 10**9)), "weight": weight}
        return F.struct(*[made[f].alias(f) for f in fields])

    def of_charge(z: int) -> Column:
        inner = F.flatten(F.transform(
            F.sequence(F.lit(1), length - 1), lambda i: F.array(ion(z, i, "b"), ion(z, i, "y"))))
        last = F.array(ion(z, length, "b"))
        return F.when(length > 1, F.concat(inner, last)).otherwise(last)

    ions = F.concat(*[of_charge(z) for z in range(1, max_charge + 1)])
    return once(df, "ions", ions).drop("_pre")


#: Ions that the Python step hands on at a time.
IONS_PER_BATCH = 100_000
_KINDS = {"peptide": "string", "z": "int", "pos": "int", "type": "string", "nano": "bigint", "mz": "double", "weight": "double"}
_FACTORS = np.full((2, 256), np.nan)
_FACTORS[:, 65:91] = 1.0
for _row, _table in enumerate((B_FACTORS, Y_FACTORS)):
    for _letter, _value in _table.items():
        _FACTORS[_row, ord(_letter)] = _value


def _ions_of(names: pa.Array, sequences: list[str], residues: np.ndarray, max_charge: int) -> dict[str, pa.Array]:
    """All ions of some peptides, whose residues (NaN where unknown) lie one after another, in the order of `with_ions`."""
    n = np.array([len(s) for s in sequences], np.int64)
    at = np.append(0, np.cumsum(n))
    letters = np.frombuffer("".join(sequences).encode("ascii", "replace"), np.uint8)
    unknown = np.isnan(residues)
    sums = np.append(0, np.cumsum(np.where(unknown, 0, residues).astype(np.int64)))
    missing = np.append(0, np.cumsum(unknown))
    per = 2 * n - 1
    size = per * max_charge
    of = np.repeat(np.arange(len(n)), size)
    i = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    z, i = i // per[of] + 1, i % per[of]
    is_y, place = i % 2 == 1, i // 2 + 1
    here, end, begin = at[of] + place, at[of + 1], at[of]
    nano = np.where(is_y, sums[end] - sums[here] + Y_NANO, sums[here] - sums[begin] + B_NANO) + (z - 1) * CHARGE_NANO
    lost = np.where(is_y, missing[end], missing[here]) > missing[begin]
    second = np.where(letters[begin] == ord("P"), SECOND_B_PROLINE, SECOND_B)
    weight = _FACTORS[is_y.astype(int), letters[np.where(is_y, end, here) - 1]] * np.where(~is_y & (place == 2), second, 1.0)
    return {"peptide": names.take(pa.array(of)), "z": pa.array(z.astype(np.int32)), "pos": pa.array(place.astype(np.int32)),
            "type": pa.DictionaryArray.from_arrays(pa.array(is_y.astype(np.int8)), pa.array(["b", "y"])).cast(pa.string()),
            "nano": pa.array(nano, mask=lost), "mz": pa.array(nano / (z * 10.0**9), mask=lost),
            "weight": pa.array(weight, mask=np.isnan(weight))}


def theoretical_ions(peptides: DataFrame, max_charge: int = MAX_ION_CHARGE,
                     fields: tuple[str, ...] = tuple(_KINDS)) -> DataFrame:
    """One row per ion: peptide, z, pos, type, nano, mz, weight, or the wanted `fields` of these.

    The ions of many peptides are made at once, as those of `with_ions`.  A
    missing or empty sequence has one b row per charge, with what is known of it.
    """
    key = "mod_sequence" if "mod_sequence" in peptides.columns else "sequence"
    mods = F.col("mods") if "mods" in peptides.columns else None
    odd = F.col("sequence").isNull() | (F.length("sequence") == 0)
    rows = spread_work(peptides, key).select(
        F.col(key).cast("string").alias("peptide"), F.when(~odd, F.col("sequence")).alias("sequence"),
        F.when(~odd, F.transform(residue_masses(F.col("sequence"), mods), lambda m: m.cast("double"))).alias("residues"),
        F.col("sequence").isNull().alias("missing"))
    schema = ", ".join(f"{f} {_KINDS[f]}" for f in fields)

    def batch_of(columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f] for f in fields], list(fields))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sequences = batch.column("peptide"), batch.column("sequence")
            usual = sequences.is_valid().to_numpy(zero_copy_only=False)
            for name, missing in zip(*(batch.column(c).filter(pa.array(~usual)).to_pylist() for c in ("peptide", "missing"))):
                z = np.arange(1, max_charge + 1)
                nano = B_NANO + (z - 1) * CHARGE_NANO
                none = np.full(len(z), missing)
                yield batch_of({
                    "peptide": pa.array([name] * len(z), pa.string()), "z": pa.array(z.astype(np.int32)),
                    "pos": pa.array(np.zeros(len(z), np.int32), mask=none), "type": pa.array(["b"] * len(z), pa.string()),
                    "nano": pa.array(nano, mask=none), "mz": pa.array(nano / (z * 10.0**9), mask=none),
                    "weight": pa.array(np.zeros(len(z)), mask=np.full(len(z), True))})
            own = np.flatnonzero(usual)
            texts = sequences.take(pa.array(own)).to_pylist()
            effort = np.cumsum([(2 * len(t) - 1) * max_charge for t in texts]) // IONS_PER_BATCH if texts else np.zeros(0)
            for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(effort)) + 1):
                if len(part):
                    at = pa.array(own[part])
                    residues = batch.column("residues").take(at).flatten().to_numpy(zero_copy_only=False).astype(float)
                    yield batch_of(_ions_of(names.take(at), [texts[p] for p in part], residues, max_charge))

    return rows.mapInArrow(made, schema)


def scored_ions(ions: Column, charge_cap: int) -> Column:
    """Ions that are scored: up to the cap, and never the highest charge."""
    return F.filter(ions, lambda x: (x.z <= charge_cap) & (x.z < MAX_ION_CHARGE))
