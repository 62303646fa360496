"""Proteins to peptides: cleavage, missed cleavages, semi-specific ends, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specengine.functions.arrays import once
from specengine.functions.peptide import MAX_PEPTIDE, MIN_PEPTIDE, usable_peptide
from specengine.operators.filters import checked_small
from specengine.session import shuffle_partitions, store

# Named cleavage rules; `[after]|{not before}`.
RULES = {"trypsin": "[RK]|{P}", "lysinec": "[K]", "lysc": "[K]"}
MAX_MISSED = 5
#: Residues up to which the peptides of a protein are compared inside its row.
ROW_RESIDUES = 1_000_000
#: Residues whose distinct peptides one task makes.
TASK_RESIDUES = 1_500_000


def rule_residues(rule: str) -> tuple[str, str]:
    """Residues to cut after, and residues that must not follow."""
    rule = RULES.get(rule.lower(), rule)
    after, _, not_before = rule.partition("|")
    return after.strip("[]"), not_before.strip("{}")


def cut_pattern(rule: str) -> str:
    """The rule as a zero-width pattern for `split`."""
    after, not_before = rule_residues(rule)
    return f"(?<=[{after}])" + (f"(?![{not_before}])" if not_before else "")


def cut_pieces(sequence: Column, rule: str = "trypsin") -> Column:
    return F.filter(F.split(sequence, cut_pattern(rule)), lambda piece: piece != "")


def piece_starts(sequence: Column, rule: str = "trypsin") -> Column:
    """0-based start of every piece, in one pass over neighbouring residues."""
    after, not_before = rule_residues(rule)
    letters = F.split(sequence, "")
    following = F.concat(F.slice(letters, F.lit(2), F.greatest(F.lit(0), F.length(sequence) - 1)),
                         F.array(F.lit("")))

    def cut(here: Column, then: Column) -> Column:
        ok = here.isin(*after) & (then != "")
        return ok & ~then.isin(*not_before) if not_before else ok

    marks = F.transform(F.zip_with(letters, following, cut),
                        lambda mark, i: F.when(mark, (i + 1).cast("int")))
    return F.concat(F.array(F.lit(0)), F.filter(marks, lambda m: m.isNotNull()))


def digest(proteins: DataFrame, rule: str = "trypsin", missed: int = 0,
           usable: bool = True, positions: bool = False) -> DataFrame:
    """Peptides of each protein row: protein, sequence, missed_cleavages[, start, before, after].

    Neighbouring pieces are joined first and tested afterwards, so only
    residues that touch in the protein end up together.  Rows stay in the
    partition of their protein: no shuffle.
    """
    if not 0 <= missed <= MAX_MISSED:
        raise ValueError(f"missed cleavages must be 0..{MAX_MISSED}")
    df = once(proteins, "_pieces", cut_pieces(F.col("sequence"), rule))
    if positions:
        df = once(df, "_starts", piece_starts(F.col("sequence"), rule))
    df = df.drop("sequence").select("*", F.posexplode("_pieces").alias("_i", "_piece"))
    if missed:
        df = df.withColumn("missed_cleavages", F.explode(F.sequence(
            F.lit(0), F.least(F.lit(missed), F.size("_pieces") - 1 - F.col("_i")))))
        sequence = F.when(F.col("missed_cleavages") == 0, F.col("_piece")).otherwise(
            F.array_join(F.slice("_pieces", F.col("_i") + 1, F.col("missed_cleavages") + 1), ""))
    else:
        df = df.withColumn("missed_cleavages", F.lit(0))
        sequence = F.col("_piece")
    df = df.withColumn("sequence", sequence)
    if positions:
        df = df.withColumn("start", F.get("_starts", F.col("_i"))).withColumn(
            "before", F.coalesce(F.right(F.get("_pieces", F.col("_i") - 1), F.lit(1)), F.lit("-"))
        ).withColumn(
            "after", F.coalesce(F.left(
                F.get("_pieces", F.col("_i") + F.col("missed_cleavages") + 1), F.lit(1)),
                F.lit("-"))
        )
    df = df.drop("_pieces", "_starts", "_i", "_piece")
    return df.filter(usable_peptide(F.col("sequence"))) if usable else df


def _runs(missed: int) -> Column:
    """All runs of up to `missed` + 1 neighbouring pieces of `_pieces`, joined."""
    pieces = F.col("_pieces")
    if not missed:
        return pieces
    joined = lambda i, k: F.array_join(F.slice(pieces, i + 1, k + 1), "")
    return F.flatten(F.transform(pieces, lambda piece, i: F.concat(F.array(piece), F.transform(
        F.slice(F.array(*[F.lit(k) for k in range(1, missed + 1)]), F.lit(1),
                F.least(F.lit(missed), F.size(pieces) - 1 - i)), lambda k: joined(i, k)))))


def _distinct_peptides(proteins: DataFrame, rule: str, listed: Column, most: int = ROW_RESIDUES) -> DataFrame:
    """Usable peptides (protein, sequence) of the list made from `_pieces`, distinct per protein.

    Repeats are dropped inside the row.  Only rows whose label others share, or
    of more than `most` residues, compare their peptides by a shuffle.  The
    proteins themselves are dealt out anew, in tasks of `TASK_RESIDUES`.
    """
    is_long = F.coalesce(F.length("sequence") > most, F.lit(False))
    labels = store(proteins.groupBy(F.col("protein").alias("_label")).agg(
        F.count(F.lit(1)).alias("_n"), F.max(is_long).alias("_long"), F.sum(F.length("sequence")).alias("_residues")), "labels")
    shared = labels.filter("_n > 1 OR _long").select("_label")
    residues = labels.agg(F.coalesce(F.sum("_residues"), F.lit(0))).first()[0]
    # Tasks of bounded text, as a residue becomes several rows.
    proteins = proteins.repartition(max(shuffle_partitions(proteins), -(-residues // TASK_RESIDUES)), F.xxhash64("protein", "sequence"))
    is_shared = F.col("protein").eqNullSafe(F.col("_label"))

    def peptides(rows: DataFrame, in_row: bool) -> DataFrame:
        pieces = once(rows, "_pieces", cut_pieces(F.col("sequence"), rule))
        return pieces.select("protein", F.explode(F.array_distinct(listed) if in_row else listed).alias("sequence")).filter(
            usable_peptide(F.col("sequence")))

    if shared.isEmpty():
        return peptides(proteins, True)
    shared = checked_small(shared)
    return peptides(proteins.join(shared, is_shared, "left_anti"), True).unionByName(
        peptides(proteins.join(shared, is_shared, "left_semi"), False).distinct())


def missed_cleavages(proteins: DataFrame, limit: int = 2, rule: str = "trypsin") -> DataFrame:
    """Distinct peptides of a protein with up to `limit` bonds left uncut."""
    if not 0 <= limit <= MAX_MISSED:
        raise ValueError(f"missed cleavages must be 0..{MAX_MISSED}")
    return _distinct_peptides(proteins.select("protein", "sequence"), rule, _runs(limit))


def semi_cleavages(proteins: DataFrame, rule: str = "trypsin", missed: int = 0) -> DataFrame:
    """Specific peptides plus every prefix and suffix of usable length, distinct per protein."""
    def parts(whole: Column) -> Column:
        longest = F.least(F.length(whole) - 1, F.lit(MAX_PEPTIDE))
        ends = F.flatten(F.transform(
            F.sequence(F.lit(MIN_PEPTIDE), longest),
            lambda n: F.array(F.substring(whole, F.lit(1), n), F.right(whole, n))))
        return F.when(longest >= MIN_PEPTIDE, F.concat(F.array(whole), ends)).otherwise(F.array(whole))

    if not 0 <= missed <= MAX_MISSED:
        raise ValueError(f"missed cleavages must be 0..{MAX_MISSED}")
    return _distinct_peptides(proteins.select("protein", "sequence"), rule, F.flatten(F.transform(_runs(missed), parts)))


def count_missed(sequence: Column, rule: str = "trypsin") -> Column:
    """Bonds inside a peptide that the rule would cut."""
    after, not_before = rule_residues(rule)
    following = f"(?=[^{not_before}])" if not_before else "(?=.)"
    return F.regexp_count(sequence, F.lit(f"[{after}]{following}"))
