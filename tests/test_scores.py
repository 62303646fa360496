"""Conditioning, K-score, best matches and expectation against step-by-step Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specengine.functions.masses import residue_table
from specengine.operators import blocks as B
from specengine.operators import condition as C
from specengine.operators import ions as I
from specengine.operators import joins as J
from specengine.operators import kernels as K
from specengine.operators import psm as P
from specengine.operators import scoring as S
from specengine.plans import search as Q
from specengine.plans import tables
from specengine.plans.library_queries import unique_peptides

RNG = random.Random(5)
SPECTRUM = "id long, precursor struct<mz:double,charge:int,intensity:double>, peaks array<struct<mz:double,intensity:double>>"


def spectra_rows(n=12, size=60):
    rows = []
    for i in range(n):
        mz = sorted({round(RNG.uniform(100, 1500), 1) for _ in range(size)})
        rows.append((i, (RNG.uniform(400, 900), 1 + i % 3, None),
                     [(m, float(RNG.randint(1, 500))) for m in mz]))
    return rows


ROWS = spectra_rows()


@pytest.fixture(scope="module")
def spectra(spark):
    return spark.createDataFrame(ROWS, SPECTRUM)


def peaks_of(df):
    return {r.id: [tuple(p) for p in r.peaks] for r in df.collect()}


def test_remove_isotopes(spectra):
    got = peaks_of(spectra.withColumn("peaks", C.remove_isotopes(F.col("peaks"), 150.0)))
    for id_, _, peaks in ROWS:
        out = []
        for p in (x for x in peaks if x[0] > 150):
            if out and p[0] < out[-1][0] + 0.95:
                if not out[-1][1] > p[1]:
                    out[-1] = p
            else:
                out.append(p)
        assert got[id_] == out


def test_clean_isotopes(spectra):
    got = peaks_of(spectra.withColumn("peaks", C.clean_isotopes(F.col("peaks"))))
    for id_, _, peaks in ROWS:
        out, last, start = [], peaks[0], peaks[0][0]
        for p in peaks[1:]:
            if p[0] - start < 1.5 and p[0] > 200:
                last = p if p[1] > last[1] else last
            else:
                out.append(last)
                last, start = p, p[0]
        assert got[id_] == [*out, last]


def test_top_n_peaks(spectra):
    got = peaks_of(spectra.withColumn("peaks", C.top_n_peaks(F.col("peaks"), 10)))
    for id_, _, peaks in ROWS:
        assert got[id_] == sorted(sorted(peaks, key=lambda p: (-p[1], p[0]))[:10])


def test_probid_keeps_every_third_of_a_long_list(spark):
    peaks = [(float(i), float(i % 97 + 1)) for i in range(1, 901)]
    df = spark.createDataFrame([(1, (500.0, 2, None), peaks)], SPECTRUM)
    got = peaks_of(df.withColumn("peaks", C.probid_truncate(F.col("peaks"))))[1]
    step = int((900 - 1) / 3)
    want = []
    for a, b in ((1, 1 + step), (1 + step, 1 + 2 * step), (1 + 2 * step, 900)):
        inside = [p for p in peaks if a <= p[0] < b]
        want += sorted(sorted(inside, key=lambda p: (-p[1], p[0]))[:100])
    assert got == want


def test_dense_vector(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 3, 5.0), (2, 1, 1.0)], "id long, k int, intensity double")
    got = {r.id: r.vector for r in C.dense_vector(df).collect()}
    assert got == {1: [2.0, 0.0, 0.0, 5.0], 2: [0.0, 1.0]}


def test_guess_charge(spark):
    df = spark.createDataFrame([
        (1, (500.0, 0, None), [(100.0, 50.0), (600.0, 1.0)]),
        (2, (500.0, 0, None), [(100.0, 50.0), (600.0, 40.0)])], SPECTRUM)
    got = df.select("id", C.guess_charge(F.col("peaks"), F.col("precursor.mz")).alias("z")).collect()
    assert {r.id: r.z for r in got} == {1: 1, 2: 2}


# ---- ions and K-score ------------------------------------------------------------------

TABLE = residue_table()
PEPTIDES = ["GEQVNGEKPDNASK", "ESVNIDVEK", "PWAMLK", "CCCCK", "DDPELVNQK"]


def k_index(mz):
    return int(mz) if abs(mz - int(mz)) < 1e-5 else int(mz / 1.0005 + 0.5)


def ion_list(sequence, cap):
    """(z, pos, type, mz) in scoring order."""
    masses = [TABLE[c] for c in sequence]
    out = []
    for z in range(1, cap + 1):
        for i in range(1, len(sequence) + 1):
            extra = (z - 1) * I.CHARGE_NANO
            out.append((z, i, "b", (sum(masses[:i]) + I.B_NANO + extra) / (z * 1e9)))
            if i < len(sequence):
                out.append((z, i, "y", (sum(masses[i:]) + I.Y_NANO + extra) / (z * 1e9)))
    return out


def sequential_kscore(vector, ions):
    """Credit ion by ion: a measured index pays out at most its largest request."""
    used, score, count = {}, {"b": 0.0, "y": 0.0}, {"b": 0, "y": 0}
    at = lambda k: vector[k] if 0 <= k < len(vector) else 0.0
    for _, _, kind, mz in ions:
        k = k_index(mz)
        for j, share, direct in ((k, 1.0, True), (k + 1, 0.5, False), (k - 1, 0.5, False)):
            extra = at(j) * share - used.get(j, 0.0)
            if at(j) and extra > 0:
                used[j] = used.get(j, 0.0) + extra
                score[kind] += extra
                count[kind] += direct
    return score, count


def test_ions_match_a_loop(spark):
    df = spark.createDataFrame([(p,) for p in PEPTIDES], "sequence string")
    got = {r.sequence: [(x.z, x.pos, x.type, x.mz) for x in r.ions] for r in I.with_ions(df, 3).collect()}
    for p in PEPTIDES:
        assert got[p] == ion_list(p, 3)


def test_ion_weights(spark):
    rows = I.theoretical_ions(spark.createDataFrame([("PDNAP",)], "sequence string"), 1).collect()
    b = {r.pos: r.weight for r in rows if r.type == "b"}
    assert b == {1: 1.0, 2: 50.0, 3: 2.0, 4: 1.0, 5: 1.0}
    assert {r.weight for r in rows if r.type == "y"} == {5.0}


def block_of(peptides):
    at = np.concatenate(([0], np.cumsum([len(p) for p in peptides])))
    letters = "".join(peptides)
    return K.Peptides(np.array([TABLE[c] for c in letters]), at, np.frombuffer(letters.encode(), np.uint8))


def test_block_ions_match_a_loop():
    for cap in (1, 2, 3):
        ions = block_of(PEPTIDES + ["K"]).ions(cap)
        for i, p in enumerate(PEPTIDES + ["K"]):
            own = slice(ions.at[i], ions.at[i + 1])
            got = list(zip(ions.z[own], ions.place[own], np.where(ions.is_y[own], "y", "b"), ions.mz[own]))
            assert got == ion_list(p, cap)


@pytest.mark.parametrize("charge", [1, 2, 3])
def test_kscore_equals_sequential_usage(spark, charge):
    vector = [RNG.random() if RNG.random() < 0.4 else 0.0 for _ in range(1500)]
    library = spark.createDataFrame([(p, p, 0.0) for p in PEPTIDES],
                                    "mod_sequence string, sequence string, matching_mass double")
    spectra = spark.createDataFrame([(1, (500.0, charge, None), vector)],
                                    "id long, precursor struct<mz:double,charge:int,intensity:double>, vector array<double>")
    index = np.flatnonzero(vector)
    measured = K.Measured(charge, index, np.array(vector)[index], ())
    raw, score, _ = K.kscore(measured, block_of(PEPTIDES), 0, len(PEPTIDES), K.Axis())
    scored = spark.createDataFrame([(1, charge, p, float(x), float(y)) for p, x, y in zip(PEPTIDES, raw, score)],
                                   "id long, charge int, peptide string, raw_score double, score double")
    rows = S.ion_use(scored, spectra, library).collect()
    assert len(rows) == len(PEPTIDES)
    for r in rows:
        score, count = sequential_kscore(vector, ion_list(r.peptide, 1 if charge == 1 else 2))
        assert r.raw_score == pytest.approx(score["b"] + score["y"])
        assert (r.b_score, r.y_score) == pytest.approx((score["b"], score["y"]))
        assert (r.b_count, r.y_count) == (count["b"], count["y"])
        n = len(r.peptide)
        assert r.score == pytest.approx(r.raw_score * math.log(n) / (3 * math.sqrt(n)) * 1000)


def test_first_within_is_the_lowest_peak():
    rng = np.random.default_rng(2)
    peaks = np.sort(np.round(rng.random(2000) * 1500, 2))
    mz = np.concatenate((rng.random(3000) * 1600, peaks[:50] + 0.025, peaks[:50] - 0.025))
    for error in (0.025, 1.0):
        want = []
        for x in mz:
            near = np.flatnonzero(np.abs(peaks - x) <= error)
            want.append(near[0] if len(near) else -1)
        assert K.first_within(peaks, mz, error).tolist() == want
    assert K.first_within(np.zeros(0), mz, 1.0).max() == -1


@pytest.mark.parametrize("charge", [1, 2])
def test_peak_scores_equal_loops(charge):
    rng = np.random.default_rng(4)
    peaks, values = np.sort(rng.random(2000) * 1200 + 50), rng.random(2000) + 0.5
    block = block_of(PEPTIDES)
    cap = 1 if charge == 1 else 2
    total = float(values.sum())
    raw, *_ = K.morpheus(K.Measured(charge, peaks, values, (total,)), block, 1, 4, K.Axis())
    _, score, _ = K.probid(K.Measured(charge, peaks, values, (3.5, 700.0)), block, 1, 4, K.Axis())
    for i, p in enumerate(PEPTIDES[1:4]):
        hits = [np.flatnonzero(np.abs(peaks - (mz - K.HYDROGEN_MASS * z)) <= 0.025) for z, _, _, mz in ion_list(p, cap)]
        hits = [h[0] for h in hits if len(h)]
        assert raw[i] == pytest.approx(len(hits) + sum(values[h] for h in hits) / total)
        want, n = 3.5 * (p.count("W") + 1), 0
        for _, _, _, mz in ion_list(p, 1):
            near = np.flatnonzero(np.abs(peaks - mz) <= 1.0)
            if len(near):
                n += 1
                off = mz - peaks[near[0]]
                want += math.log(values[near[0]]) - math.log(math.sqrt(2 * math.pi) / 0.5) - off * off / 0.5
        want += (n * math.log(n) if n else 0.0) - (2 * len(p) - n) * math.log(700.0)
        assert score[i] == pytest.approx(want)


def test_comet_counts_every_ion():
    rng = np.random.default_rng(6)
    bins = np.unique((rng.random(2000) * 40_000).astype(int))
    values = rng.random(len(bins))
    weight = dict(zip(bins.tolist(), values))
    raw, *_ = K.comet(K.Measured(2, bins, values, ()), block_of(PEPTIDES), 0, len(PEPTIDES), K.Axis())
    for i, p in enumerate(PEPTIDES):
        want = sum(weight.get(int(mz * (1.0 / 0.03) + 1.0), 0.0) for _, _, _, mz in ion_list(p, 2)) * 0.005
        assert raw[i] == pytest.approx(want)


def test_blocks_bound_their_pairs():
    n_left, n_right = np.zeros(500, int), np.zeros(500, int)
    n_left[40], n_right[40] = 30_000, 30_000
    n_left[41:400], n_right[41:400] = 7, 900
    n_left[450], n_right[460] = 10**6, 10**6
    plan = B.plan_blocks(n_left, n_right, 1.2)
    pairs = np.bincount(plan.block, n_left * n_right.astype(float)) / (plan.left_parts * plan.right_parts)
    rows = np.maximum(np.bincount(plan.block, n_left) / plan.left_parts, np.bincount(plan.block, n_right) / plan.right_parts)
    assert pairs.max() <= 5_000_000 and rows.max() <= B.ROWS_PER_BLOCK
    assert (np.diff(plan.block) >= 0).all() and (np.diff(plan.block) <= 1).all()
    # Ordinary bins are joined, not scattered.
    assert len(set(plan.block[41:400])) < 10


@pytest.mark.parametrize("join", ["bins", "limits", "dalton"])
def test_blocks_of_any_size_give_the_joins_pairs(spark, folder, join):
    scans = tables.spectra(spark, folder).filter("id % 3 = 0")
    library = unique_peptides(spark, folder).filter("length(sequence) < 14")
    joins = {"bins": J.bin_charge_join, "limits": Q.limits_join, "dalton": J.da_tolerance_join}
    want = sorted(tuple(r) for r in joins[join](scans, library).join(
        S.choose_algorithm("morpheus").measure(scans).select("id"), "id").select("id", "mod_sequence").collect())
    for target in (40.0, 1e9):
        got = S.score_spectra(scans, library, Q.WINDOWS[join], "morpheus", positive=False, target=target)
        assert sorted((r.id, r.peptide) for r in got.collect()) == want
    assert len(want) > 100


def test_ppm_reaches_half_a_dalton():
    masses = np.array([999.4, 999.6, 1000.0, 1000.4, 1000.5, 1000.9])
    assert J.dalton_window(20.0, "ppm").keeps(1000.0, 2, masses).tolist() == [False, True, True, True, False, False]
    assert J.dalton_window(0.45, "ppm").keeps(1000.0, 2, masses).tolist() == [False, True, True, True, False, False]
    assert J.dalton_window(1.0).keeps(1000.0, 2, masses).all()


def test_states_equal_windows(spark):
    rows = [(i % 7, f"PEP{i % 400}", float(int(RNG.expovariate(1 / 120)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, peptide string, hyperscore double").repartition(9).distinct()
    states = P.spectrum_states(df, 5)
    got = sorted((r.id, r.rank, r.peptide, r.hyperscore) for r in P.matches_of(states).collect())
    want = sorted((r.id, r.rank, r.peptide, r.hyperscore) for r in P.top_matches(df, 5).collect())
    assert got == want
    counts = {(r.id, r.bin): r.n for r in P.histogram_of(states).collect()}
    assert counts == {(r.id, r.bin): r.n for r in P.hyperscore_histogram(df).collect()}
    assert P.spectrum_states(df.limit(0)).count() == 0


def test_expectation_reads_the_pairs_once(spark, folder):
    library = unique_peptides(spark, folder)
    states = Q.search_states(tables.spectra(spark, folder), library, carried=2)
    plan = P.expectation(states)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FlatMapCoGroupsInArrow") == 1


def test_unknown_algorithm():
    with pytest.raises(ValueError):
        S.choose_algorithm("none")


# ---- best matches and expectation ----------------------------------------------------------

def psm_rows(n=3000):
    return [(i % 7, f"PEP{i}", float(int(RNG.expovariate(1 / 120)))) for i in range(n)]


def test_best_and_next_breaks_ties_by_peptide(spark):
    df = spark.createDataFrame([(1, "B", 5.0), (1, "A", 5.0), (1, "C", 9.0), (2, "Z", 1.0)],
                               "id long, peptide string, hyperscore double")
    got = {r.id: tuple(r)[1:] for r in P.best_and_next(df).collect()}
    assert got == {1: ("C", 9.0, "A", 5.0), 2: ("Z", 1.0, None, None)}


def test_expectation_matches_a_loop(spark):
    rows = psm_rows()
    df = spark.createDataFrame(rows, "id long, peptide string, hyperscore double")
    got = {r.id: r for r in P.expectation(df).collect()}
    for id_ in range(7):
        scores = [s for i, _, s in rows if i == id_]
        bins = [0] * (max(int(s * 0.05 + 0.5) for s in scores) + 1)
        for s in scores:
            bins[int(s * 0.05 + 0.5)] += 1
        above = [sum(bins[i:]) for i in range(len(bins))]
        survivors = [a - above[-1] for a in above[:-1]] + [above[-1]]
        used = [(i, math.log10(v)) for i, v in enumerate(survivors) if 10 <= v <= int(0.5 + survivors[0] / 2)]
        n, sx, sy = len(used), sum(x for x, _ in used), sum(y for _, y in used)
        slope = (n * sum(x * y for x, y in used) - sx * sy) / (n * sum(x * x for x, _ in used) - sx * sx)
        assert got[id_].slope == pytest.approx(slope)
        assert got[id_].expect == pytest.approx(10 ** ((sy - slope * sx) / n + slope * 0.05 * max(scores)))


def test_few_scores_use_the_default_line(spark):
    df = spark.createDataFrame([(1, "A", 100.0), (1, "B", 40.0)], "id long, peptide string, hyperscore double")
    row = P.expectation(df).first()
    assert (row.slope, row.intercept) == (-0.18, 3.5)
    assert row.expect == pytest.approx(10 ** (3.5 - 0.18 * 5))


# ---- many spectra at once --------------------------------------------------------------------

@pytest.mark.parametrize("name", ["kscore", "tandem", "comet", "morpheus", "probid"])
def test_batches_equal_the_plain_kernels(name):
    """Hits only, whatever the runs: empty ones, spectra without a peak, peaks off the axis."""
    rng = np.random.default_rng(8)
    peptides = ["".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), rng.integers(1, 30))) for _ in range(300)] + ["K"]
    block = block_of(peptides)
    first = rng.integers(0, 250, 40)
    last = np.minimum(first + rng.integers(0, 60, 40), len(peptides))
    sizes = np.append(0, rng.integers(1, 60, 39))
    width = {"kscore": 1.0, "tandem": 0.4, "comet": 0.03}.get(name)
    axes = [np.sort(rng.random(n) * 2000 + 40) for n in sizes]
    if width:
        axes = [np.unique(np.append(np.trunc(a / width), -3)) if len(a) else a for a in axes]
    values = [rng.random(len(a)) + 0.1 for a in axes]
    extra = rng.random((40, 2)) * 9 + 1
    at = np.append(0, np.cumsum([len(a) for a in axes]))
    spectra = K.Spectra(at, np.concatenate(axes), np.concatenate(values), extra)
    for charge in (1, 2):
        pairs = K.Pairs(first, last)
        for positive in (False, True):
            place, raw, score, hyper = K.BATCHES[name](spectra, pairs, block, charge, positive)
            spectrum, peptide = pairs.of(place)
            for i in np.flatnonzero(sizes > 0):
                axis = axes[i].astype(int) if width else axes[i]
                want = K.KERNELS[name](K.Measured(charge, axis, values[i], tuple(extra[i])), block, first[i], last[i], K.Axis())
                own = spectrum == i
                seen = peptide[own] - first[i]
                for got, plain in zip((raw[own], score[own], hyper[own]), want):
                    assert got == pytest.approx(plain[seen])
                assert positive or len(seen) == last[i] - first[i]
                assert set(np.flatnonzero(want[1] > 0)) <= set(seen)
        hits = np.count_nonzero(raw)
        assert 0 < hits < pairs.n


def test_a_batch_holds_bounded_pairs():
    size, peaks = np.array([10, 3 << 20, 5, 7, 1 << 19, 1 << 19, 9]), np.array([1, 1, 1, 1, 1, 20, 1])
    got = S._batches(size, peaks, np.array([0, 1, 3, 4, 5, 6]))
    assert np.concatenate(got).tolist() == [0, 1, 3, 4, 5, 6] and len(got) == 3
    assert all(len(b) == 1 or (size * (1 + peaks // 8))[b[1:]].sum() <= S.BATCH_PAIRS for b in got)


def test_slices_of_peptides_meet_every_pair_once(monkeypatch):
    """A block gives the same pairs and states whatever its slices hold."""
    rng = np.random.default_rng(9)
    peptides = sorted({"".join(rng.choice(list("ACDEFGHIK"), 9)) for _ in range(90)})
    masses = np.sort(np.round(rng.random(len(peptides)) * 2 + 1000, 3))
    right = pa.table({"mod_sequence": peptides, "sequence": peptides, "matching_mass": masses,
                      "residues": [[TABLE[c] for c in p] for p in peptides]})
    left = pa.table({"id": np.arange(30), "charge": pa.array([1, 2, 3] * 10, pa.int32()),
                     "precursor_mass": np.linspace(999.5, 1002.5, 30),
                     "axis": [np.arange(i % 3, 1100.0, 3) for i in range(30)],
                     "value": [rng.random(len(range(i % 3, 1100, 3))) for i in range(30)],
                     "extra": pa.array([[]] * 30, pa.list_(pa.float64()))})
    made = []
    for size in (8_192, 7):
        monkeypatch.setattr(S, "SLICE_PEPTIDES", size)
        rows = S._scored("kscore", J.BINS, True, None)(left, right).to_pylist()
        parts = S._scored("kscore", J.BINS, True, 2)(left, right).to_pylist()
        best = {}
        for p in parts:
            best.setdefault(p["id"], []).extend((-t["hyperscore"], t["peptide"]) for t in p["top"])
        made.append((sorted(map(str, rows)), {i: sorted(b)[:2] for i, b in best.items()},
                     sum(c["n"] for p in parts for c in p["counts"])))
    assert made[0] == made[1] and made[0][2] == len(made[0][0]) > 500


def test_ion_use_reads_stored_matches(spark, folder):
    """The search is not repeated in the plan: its peptides, spectra and matches are files by then."""
    scans, library = tables.spectra(spark, folder).limit(50), unique_peptides(spark, folder)
    best = P.matches_of(Q.search_states(scans, library, carried=1))
    used = S.ion_use(best, C.k_vectors(C.condition_spectra(scans, C.Settings(isotope_mz=150.0))), library)
    assert "FlatMapCoGroupsInArrow" not in used._jdf.queryExecution().optimizedPlan().toString()


def test_states_of_blocks_equal_windows_over_all_pairs(spark, folder):
    scans, library = tables.spectra(spark, folder), unique_peptides(spark, folder)
    states = Q.search_states(scans, library, "kscore", "bins", 3)
    pairs = Q.search(scans, library)
    want = sorted((r.id, r.rank, r.peptide, r.hyperscore) for r in P.top_matches(pairs, 3).collect())
    assert sorted((r.id, r.rank, r.peptide, r.hyperscore) for r in P.matches_of(states).collect()) == want
    counts = {(r.id, r.bin): r.n for r in P.histogram_of(states).collect()}
    assert counts == {(r.id, r.bin): r.n for r in P.hyperscore_histogram(pairs).collect()} and len(want) > 100
