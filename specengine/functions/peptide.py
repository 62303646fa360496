"""Sequence predicates, protein labels and modified-sequence strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The residue alphabets and the peptide length limits.
UNAMBIGUOUS = "ACDEFGHIKLMNPQRSTVWY"
VALID = UNAMBIGUOUS + "BZ"
MIN_PEPTIDE, MAX_PEPTIDE = 4, 40

# Label prefixes that mark a decoy protein.
DECOY_PREFIXES = ["###REV###", "###RND###", "RND_", "REV_", "REV1_", "DECOY_"]
DECOY = "DECOY_"


def usable_peptide(sequence: Column) -> Column:
    """Scoreable length and only unambiguous residues; the cheap length test goes first."""
    return F.length(sequence).between(MIN_PEPTIDE, MAX_PEPTIDE) & unambiguous_sequence(sequence)


def valid_sequence(sequence: Column) -> Column:
    return sequence.rlike(f"^[{VALID}]+$")


def unambiguous_sequence(sequence: Column) -> Column:
    return sequence.rlike(f"^[{UNAMBIGUOUS}]+$")


def probably_semi_tryptic(sequence: Column) -> Column:
    return ~sequence.rlike("[RK]$")


def aa_count(sequence: Column, residue: str) -> Column:
    return F.length(sequence) - F.length(F.replace(sequence, F.lit(residue), F.lit("")))


def protein_id(annotation: Column) -> Column:
    """`sp|X|...` gives X, anything else its first word as an upper-case identifier.

    A leading `>` and punctuation before the first letter or digit are dropped, other punctuation becomes `_`.
    """
    bare = F.regexp_replace(annotation, "^>", "")
    word = F.regexp_extract(F.regexp_replace(F.trim(annotation), "^>", ""), "^([^ ]*)", 1)
    begun = F.regexp_replace(F.upper(word), r"^[^\p{L}\p{Nd}]+", "")
    return F.when(
        bare.rlike(r"^sp\|[^|]*\|"), F.regexp_extract(bare, r"^sp\|([^|]*)\|", 1)
    ).otherwise(F.regexp_replace(begun, r"[^\p{L}\p{Nd}]", "_"))


def condition_protein_label(label: Column) -> Column:
    """A label that is safe inside reports: printable, a bar as `_`, quotes and separators as blanks."""
    printable = F.regexp_replace(label, r"[^\x20-\x7E]", "")
    return F.translate(printable, "|'\"!;:,", "_      ")


def decoy_label(label: Column) -> Column:
    """`DECOY_` plus the rest for a known decoy prefix, else NULL; NULL also where nothing is left."""
    out = F.lit(None).cast("string")
    for prefix in reversed(DECOY_PREFIXES):
        rest = F.substring(label, len(prefix) + 1, 1 << 30)
        known = F.when(rest != "", F.concat(F.lit(DECOY), rest))
        out = F.when(label.startswith(prefix), known).otherwise(out)
    return out


def plain_sequence(mod_sequence: Column) -> Column:
    """`n[42.011]SK[79.966]NVD` without its modifications."""
    return F.regexp_replace(mod_sequence, r"^n\[[^\]]*\]|\[[^\]]*\]", "")


def parse_mod_sequence(mod_sequence: Column) -> Column:
    """Modifications of a modified string: ARRAY<STRUCT<pos, aa, mass_change>>, pos from 1.

    A leading `n[..]` belongs to the first residue, as does a later `[..]` to
    the residue before it.
    """
    body = F.regexp_replace(mod_sequence, r"^n\[[^\]]*\]", "")
    residues = F.regexp_extract_all(body, F.lit(r"([A-Za-z](?:\[[^\]]*\])?)"), F.lit(1))
    marked = F.filter(
        F.transform(residues, lambda r, i: F.struct((i + 1).cast("int").alias("pos"), r.alias("r"))),
        lambda x: F.length(x.r) > 1)
    inner = F.transform(marked, lambda x: F.struct(
        x.pos.alias("pos"), F.substring(x.r, 1, 1).alias("aa"),
        F.substring(x.r, F.lit(3), F.length(x.r) - 3).try_cast("double").alias("mass_change")))
    leading = F.when(mod_sequence.startswith("n["), F.array(F.struct(
        F.lit(1).alias("pos"), F.substring(body, 1, 1).alias("aa"),
        F.regexp_extract(mod_sequence, r"^n\[([^\]]*)\]", 1).try_cast("double").alias(
            "mass_change")))).otherwise(F.array().cast("array<struct<pos:int,aa:string,mass_change:double>>"))
    return F.filter(F.concat(leading, inner), lambda m: m.mass_change.isNotNull())


def format_mod_sequence(sequence: Column, mods: Column) -> Column:
    """Insert `[label]` after every modified residue; `mods` carries pos (from 1) and label."""
    return F.aggregate(
        F.reverse(F.array_sort(mods)),
        sequence,
        lambda s, m: F.concat(
            F.substring(s, F.lit(1), m.pos), F.lit("["), m.label, F.lit("]"),
            F.substring(s, m.pos + 1, F.length(s)),
        ),
    )
