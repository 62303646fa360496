"""Scores of spectra against runs of peptides, as array arithmetic.

A block holds its peptides in order of mass, so the candidates of a spectrum
are one run of them.  What depends on peptides only is made once per block:
the ions, and lists of them by index or m/z and peptide.  `BATCHES` score many
spectra at once; a peak is looked up in those lists, so the cost is the ions
that are hit, not the ions of every pair.  `KERNELS` are the same scores of one
spectrum in their plain form, at the cost of all ions of the run.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

import numpy as np

from specengine.operators.ions import B_FACTORS, B_NANO, CHARGE_NANO, SECOND_B, SECOND_B_PROLINE, Y_FACTORS, Y_NANO

# Index width of the tandem score (a 32-bit 0.4), bin width and score scale of comet,
# tolerances of morpheus and probid, the mass of hydrogen in morpheus.
TANDEM_WIDTH = 0.4000000059604645
COMET_WIDTH, COMET_SCALE = 0.03, 0.005
MORPHEUS_TOLERANCE = 0.025
PROBID_ERROR = 1.0
HYDROGEN_MASS = 1.007825035

FACTORIALS = np.array([float(math.factorial(i)) for i in range(171)])


class Ions(NamedTuple):
    """Ions of all peptides up to a charge, by peptide, then charge, place, b before y; `at` are the peptides' offsets."""

    at: np.ndarray
    peptide: np.ndarray
    z: np.ndarray
    place: np.ndarray
    is_y: np.ndarray
    mz: np.ndarray


class Peptides:
    """The peptides of a block: residues in nano-Daltons, letters, and what is made from them."""

    def __init__(self, residues: np.ndarray, at: np.ndarray, letters: np.ndarray):
        self.at, self.letters = at, letters
        self.length = np.diff(at)
        sums = np.concatenate(([0], np.cumsum(residues)))
        self.prefix = sums[1:] - np.repeat(sums[at[:-1]], self.length)
        self.total = sums[at[1:]] - sums[at[:-1]]
        self._made: dict = {}

    def ions(self, cap: int) -> Ions:
        if cap not in self._made:
            n = self.length
            per = 2 * n - 1
            size = per * cap
            at = np.concatenate(([0], np.cumsum(size)))
            peptide = np.repeat(np.arange(len(n)), size)
            i = np.arange(at[-1]) - at[peptide]
            z, i = i // per[peptide] + 1, i % per[peptide]
            is_y, place = i % 2 == 1, i // 2 + 1
            before = self.prefix[self.at[peptide] + place - 1]
            nano = np.where(is_y, self.total[peptide] - before + Y_NANO, before + B_NANO) + (z - 1) * CHARGE_NANO
            self._made[cap] = Ions(at, peptide, z, place, is_y, nano.astype(float) / (z * 10.0**9))
        return self._made[cap]

    @cached_property
    def tryptophans(self) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(self.letters == ord("W"))))
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def once(self, key: object, make: Callable[[], object]) -> object:
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]


class Measured(NamedTuple):
    """A spectrum: charge, a sorted axis (indexes or m/z), values on it, and further numbers."""

    charge: int
    axis: np.ndarray
    value: np.ndarray
    extra: tuple[float, ...]


def _runs(values: np.ndarray, at: np.ndarray, first: int, last: int) -> np.ndarray:
    """Sums of the runs first..last that the offsets mark; empty runs give 0."""
    sums = np.concatenate(([0.0], np.cumsum(values)))
    edges = at[first:last + 1] - at[first]
    if len(values) and (np.diff(edges) > 0).all():
        return np.add.reduceat(values, edges[:-1])
    return sums[edges[1:]] - sums[edges[:-1]]


class Axis:
    """A measured axis spread out for lookup by index; the same memory serves one spectrum after another."""

    def __init__(self):
        self.values = np.zeros(1)

    def at(self, spectrum: Measured, index: np.ndarray) -> np.ndarray:
        inside = (spectrum.axis >= 0) & (spectrum.axis < 1 << 24)
        axis, value = spectrum.axis[inside], spectrum.value[inside]
        most = max(int(axis[-1]) if len(axis) else 0, int(index.max()) if len(index) else 0) + 1
        if most > len(self.values):
            self.values = np.zeros(2 * most)
        self.values[axis] = value
        found = self.values[index]
        self.values[axis] = 0.0
        return found


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order, by a sort: `np.unique` hashes whole numbers, which takes many times as long."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[:len(values)]]


def sorted_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and the places they had, equal ones as they came.

    Key and place are sorted as one whole number if they fit, which takes a fraction of the time of an `argsort`.
    """
    bits = len(key).bit_length()
    if not len(key) or key.min() < 0 or int(key.max()) >> (62 - bits):
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = np.sort(key << bits | np.arange(len(key)))
    return both >> bits, both & ((1 << bits) - 1)


def k_index(mz: np.ndarray) -> np.ndarray:
    whole = np.trunc(mz)
    return np.where(np.abs(mz - whole) < 0.00001, whole, np.trunc(mz / 1.0005 + 0.5)).astype(np.int64)


def _cap(charge: int) -> int:
    return 1 if charge == 1 else 2


# A kernel takes (spectrum, peptides, first, last, axis) and returns raw score, score, hyperscore of the run.

def _credits(peptides: Peptides, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, indexes and shares: an index hit by an ion pays in full, one next to a hit one pays half."""
    ions = peptides.ions(cap)
    wide = 1 << 24
    hit = distinct(ions.peptide * wide + k_index(ions.mz))
    gap = np.diff(hit)
    # Next to a hit and none itself; what lies between two hits counts once.
    above = hit[np.append(gap > 1, True)[:len(hit)]] + 1
    below = hit[np.append(True, gap > 2)[:len(hit)]] - 1
    key, order = sorted_order(np.concatenate((hit, above, below)))
    share = np.where(order < len(hit), 1.0, 0.5)
    at = np.searchsorted(key, np.arange(len(peptides.length) + 1) * wide)
    return at, key % wide, share


def kscore(spectrum: Measured, peptides: Peptides, first: int, last: int, axis: Axis) -> tuple[np.ndarray, ...]:
    cap = _cap(spectrum.charge)
    at, index, share = peptides.once(("k", cap), lambda: _credits(peptides, cap))
    own = slice(at[first], at[last])
    raw = _runs(axis.at(spectrum, index[own]) * share[own], at, first, last)
    n = peptides.length[first:last].astype(float)
    score = raw * (np.log(n) / (3.0 * np.sqrt(n)) * 1000.0)
    return raw, score, score


def _tandem_theory(peptides: Peptides, cap: int) -> tuple[np.ndarray, ...]:
    """Per peptide, charge and index: the summed weight and whether the last ion there is a y."""
    ions = peptides.ions(cap)
    n = peptides.length[ions.peptide]
    used = np.where(ions.is_y, n - ions.place > 1, ions.place > 1)  # single residues are no fragments here
    peptide, z, place, is_y = (x[used] for x in (ions.peptide, ions.z, ions.place, ions.is_y))
    k = np.trunc(ions.mz[used] / TANDEM_WIDTH + 0.5).astype(np.int64)
    table = np.ones((2, 256))
    for kind, factors in enumerate((B_FACTORS, Y_FACTORS)):
        for letter, factor in factors.items():
            table[kind, ord(letter)] = factor
    letter = peptides.letters[np.where(is_y, peptides.at[peptide + 1] - 1, peptides.at[peptide] + place - 1)]
    second = np.where(peptides.letters[peptides.at[peptide]] == ord("P"), SECOND_B_PROLINE, SECOND_B)
    weight = table[is_y.astype(int), letter] * np.where(~is_y & (place == 2), second, 1.0)
    _, order = sorted_order((peptide * (cap + 1) + z) * (int(k.max()) + 1 if len(k) else 1) + k)  # ions of an index stay in order
    peptide, z, k, weight, is_y = peptide[order], z[order], k[order], weight[order], is_y[order]
    new = np.ones(len(k), bool)
    new[1:] = (peptide[1:] != peptide[:-1]) | (z[1:] != z[:-1]) | (k[1:] != k[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(k)) - 1
    weight = np.add.reduceat(weight, begin) if len(begin) else weight
    return np.searchsorted(peptide[begin], np.arange(len(peptides.length) + 1)), k[begin], weight, is_y[end] if len(k) else is_y


def tandem(spectrum: Measured, peptides: Peptides, first: int, last: int, axis: Axis) -> tuple[np.ndarray, ...]:
    cap = _cap(spectrum.charge)
    at, index, weight, is_y = peptides.once(("t", cap), lambda: _tandem_theory(peptides, cap))
    own = slice(at[first], at[last])
    paid = weight[own] * axis.at(spectrum, index[own])
    raw = _runs(paid, at, first, last)
    hit = paid > 0
    b, y = _runs((hit & ~is_y[own]).astype(float), at, first, last), _runs((hit & is_y[own]).astype(float), at, first, last)
    return raw, raw, raw * FACTORIALS[np.rint(b).astype(int)] * FACTORIALS[np.rint(y).astype(int)]


def comet(spectrum: Measured, peptides: Peptides, first: int, last: int, axis: Axis) -> tuple[np.ndarray, ...]:
    cap = _cap(spectrum.charge)
    ions = peptides.ions(cap)
    index = peptides.once(("c", cap), lambda: np.trunc(ions.mz * (1.0 / COMET_WIDTH) + 1.0).astype(np.int64))
    raw = _runs(axis.at(spectrum, index[ions.at[first]:ions.at[last]]), ions.at, first, last) * COMET_SCALE
    return raw, raw, raw


def first_within(peaks: np.ndarray, mz: np.ndarray, error: float) -> np.ndarray:
    """Place of the lowest peak within +-error of each m/z, -1 without one."""
    if not len(peaks):
        return np.full(len(mz), -1)
    at = np.searchsorted(peaks, mz - error * (1 + 1e-9))
    while True:  # peaks that only rounding put into reach
        short = (at < len(peaks)) & (peaks[np.minimum(at, len(peaks) - 1)] < mz)
        short &= np.abs(peaks[np.minimum(at, len(peaks) - 1)] - mz) > error
        if not short.any():
            break
        at = at + short
    found = at < len(peaks)
    found &= np.abs(peaks[np.minimum(at, len(peaks) - 1)] - mz) <= error
    return np.where(found, at, -1)


def morpheus(spectrum: Measured, peptides: Peptides, first: int, last: int, axis: Axis) -> tuple[np.ndarray, ...]:
    cap = _cap(spectrum.charge)
    ions = peptides.ions(cap)
    shifted = peptides.once(("m", cap), lambda: ions.mz - HYDROGEN_MASS * ions.z)
    at = first_within(spectrum.axis, shifted[ions.at[first]:ions.at[last]], MORPHEUS_TOLERANCE)
    hit = at >= 0
    matched = _runs(np.where(hit, spectrum.value[at], 0.0), ions.at, first, last)
    raw = _runs(hit.astype(float), ions.at, first, last) + matched / spectrum.extra[0]
    return raw, raw, raw


def probid(spectrum: Measured, peptides: Peptides, first: int, last: int, axis: Axis) -> tuple[np.ndarray, ...]:
    """Matches, n ln n, immonium term and the cost of ions that were not seen."""
    ions = peptides.ions(1)
    mz = ions.mz[ions.at[first]:ions.at[last]]
    at = first_within(spectrum.axis, mz, PROBID_ERROR)
    hit = at >= 0
    theta = PROBID_ERROR * 0.5
    constant = math.log(math.sqrt(2 * math.pi)) - math.log(theta)
    off = mz - spectrum.axis[at]
    each = np.where(hit, np.log(np.where(hit, spectrum.value[at], 1.0)) - constant - off * off / (2 * theta * theta), 0.0)
    n = np.rint(_runs(hit.astype(float), ions.at, first, last))
    raw = _runs(each, ions.at, first, last) + np.where(n > 0, n * np.log(np.maximum(n, 1.0)), 0.0)
    log_sum, span = spectrum.extra
    missed = (2 * peptides.length[first:last] - n) * -math.log(span if span else 1.0)
    score = raw + log_sum * (peptides.tryptophans[first:last] + 1) + missed
    return raw, score, score


# ---- many spectra at once ----------------------------------------------------

class Spectra(NamedTuple):
    """Spectra one after another: their peaks' offsets, sorted axes and values, and a row of further numbers each."""

    at: np.ndarray
    axis: np.ndarray
    value: np.ndarray
    extra: np.ndarray


class Postings(NamedTuple):
    """Entries sorted by (index, peptide): `key` is index * peptides + peptide."""

    key: np.ndarray
    peptide: np.ndarray
    payload: np.ndarray


def _postings(index: np.ndarray, peptide: np.ndarray, n: int, payload: np.ndarray) -> Postings:
    key, order = sorted_order(index * n + peptide)
    return Postings(key, peptide[order].astype(np.int32), payload[order])


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range that each is of."""
    size = np.maximum(end - begin, 0)
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + (begin - (np.cumsum(size) - size))[of], of


class Pairs:
    """The pairs of a batch: spectrum i with the peptides first[i]..last[i], one run after another."""

    def __init__(self, first: np.ndarray, last: np.ndarray):
        self.first, self.last = first, last
        size = last - first
        self.at = np.cumsum(size) - size
        self.n = int(size.sum())

    def place(self, spectrum: np.ndarray, peptide: np.ndarray) -> np.ndarray:
        return (self.at - self.first)[spectrum] + peptide

    def sums(self, place: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(place, values, self.n) if len(place) else np.zeros(self.n)

    def of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spectrum and peptide of pairs in ascending order."""
        size = np.diff(np.searchsorted(place, np.append(self.at, self.n)))
        spectrum = np.repeat(np.arange(len(size)), size)
        return spectrum, place - (self.at - self.first)[spectrum]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        return self.of(np.arange(self.n))


def _hits(spectra: Spectra, pairs: Pairs, postings: Postings, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every posting under an index of a spectrum and in its run: posting, place of the pair, measured value."""
    spectrum = np.repeat(np.arange(len(pairs.first)), np.diff(spectra.at))
    index = spectra.axis.astype(np.int64)
    inside = (index >= 0) & (index < 1 << 24)
    spectrum, index, value = spectrum[inside], index[inside], spectra.value[inside]
    entry, peak = ranges(np.searchsorted(postings.key, index * n + pairs.first[spectrum]),
                          np.searchsorted(postings.key, index * n + pairs.last[spectrum]))
    return entry, pairs.place(spectrum[peak], postings.peptide[entry]), value[peak]


# A batch takes (spectra, pairs, peptides, charge cap, whether only positive scores are wanted) and
# returns the places of pairs with their raw score, score and hyperscore.

def _chosen(raw: np.ndarray, positive: bool) -> np.ndarray:
    return np.flatnonzero(raw > 0) if positive else np.arange(len(raw))


def kscore_batch(spectra: Spectra, pairs: Pairs, peptides: Peptides, cap: int, positive: bool) -> tuple[np.ndarray, ...]:
    n = len(peptides.length)

    def made() -> Postings:
        at, index, share = _credits(peptides, cap)
        return _postings(index, np.repeat(np.arange(n), np.diff(at)), n, share.astype(np.float32))

    postings = peptides.once(("k batch", cap), made)
    entry, place, value = _hits(spectra, pairs, postings, n)
    raw = pairs.sums(place, value * postings.payload[entry])
    at = _chosen(raw, positive)
    size = peptides.length.astype(float)
    factor = np.log(size) / (3.0 * np.sqrt(size)) * 1000.0
    score = raw[at] * factor[pairs.of(at)[1]]
    return at, raw[at], score, score


def tandem_batch(spectra: Spectra, pairs: Pairs, peptides: Peptides, cap: int, positive: bool) -> tuple[np.ndarray, ...]:
    n = len(peptides.length)

    def made() -> Postings:
        at, index, weight, is_y = _tandem_theory(peptides, cap)
        return _postings(index, np.repeat(np.arange(n), np.diff(at)), n, np.where(is_y, -weight, weight))

    postings = peptides.once(("t batch", cap), made)  # weights are positive; a minus marks a y
    entry, place, value = _hits(spectra, pairs, postings, n)
    weight = postings.payload[entry]
    paid = np.abs(weight) * value
    raw = pairs.sums(place, paid)
    b, y = (pairs.sums(place[(paid > 0) & kind]) for kind in (weight > 0, weight < 0))
    at = _chosen(raw, positive)
    raw = raw[at]
    return at, raw, raw, raw * FACTORIALS[b[at].astype(int)] * FACTORIALS[y[at].astype(int)]


def comet_batch(spectra: Spectra, pairs: Pairs, peptides: Peptides, cap: int, positive: bool) -> tuple[np.ndarray, ...]:
    n = len(peptides.length)

    def made() -> Postings:
        ions = peptides.ions(cap)
        index = np.trunc(ions.mz * (1.0 / COMET_WIDTH) + 1.0).astype(np.int64)
        return _postings(index, ions.peptide, n, np.zeros(len(index), np.int8))

    entry, place, value = _hits(spectra, pairs, peptides.once(("c batch", cap), made), n)
    raw = pairs.sums(place, value) * COMET_SCALE
    at = _chosen(raw, positive)
    return at, raw[at], raw[at], raw[at]


def _first_at_least(values: np.ndarray, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Per row the first place in low..high whose value reaches the limit, `high` without one."""
    low, high = low.copy(), high.copy()
    while (low < high).any():
        middle = (low + high) // 2
        is_open = low < high
        less = is_open & (values[np.minimum(middle, len(values) - 1)] < limit)
        low, high = np.where(less, middle + 1, low), np.where(is_open & ~less, middle, high)
    return low


def _near(spectra: Spectra, pairs: Pairs, peptides: Peptides, name: str, mz: np.ndarray, peptide: np.ndarray,
          error: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ions with a peak of the spectrum within +-error: ion, place of the pair, lowest such peak.

    Ions are listed by bins as wide as the error; a spectrum looks into every bin that a peak reaches once.
    """
    n = len(peptides.length)
    to_bin = lambda x: np.floor(x / error).astype(np.int64)
    postings = peptides.once(name, lambda: _postings(to_bin(mz), peptide, n, np.arange(len(mz))))
    reach = error * (1 + 1e-9)
    owner = np.repeat(np.arange(len(pairs.first)), np.diff(spectra.at))
    low, high = to_bin(spectra.axis - reach), to_bin(spectra.axis + reach)
    bins, of = ranges(low, high + 1)
    floor = int(bins.min()) if len(bins) else 0
    span = (int(bins.max()) if len(bins) else 0) - floor + 1
    cell = distinct(owner[of] * span + (bins - floor))
    spectrum, bins = cell // span, cell % span + floor
    entry, of = ranges(np.searchsorted(postings.key, bins * n + pairs.first[spectrum]),
                        np.searchsorted(postings.key, bins * n + pairs.last[spectrum]))
    spectrum, ion = spectrum[of], postings.payload[entry]
    wanted, end = mz[ion], spectra.at[spectrum + 1]
    at = _first_at_least(spectra.axis, spectra.at[spectrum], end, wanted - reach)
    while True:  # peaks that only rounding put into reach
        peak = spectra.axis[np.minimum(at, len(spectra.axis) - 1)]
        short = (at < end) & (peak < wanted) & (np.abs(peak - wanted) > error)
        if not short.any():
            break
        at = at + short
    found = np.flatnonzero((at < end) & (np.abs(peak - wanted) <= error))
    # In the order of the ions, so that sums are those of the plain form.
    found = found[sorted_order(spectrum[found] * max(len(mz), 1) + ion[found])[1]]
    return ion[found], pairs.place(spectrum[found], peptide[ion[found]]), at[found]


def morpheus_batch(spectra: Spectra, pairs: Pairs, peptides: Peptides, cap: int, positive: bool) -> tuple[np.ndarray, ...]:
    ions = peptides.ions(cap)
    shifted = peptides.once(("m", cap), lambda: ions.mz - HYDROGEN_MASS * ions.z)
    _, place, peak = _near(spectra, pairs, peptides, f"m batch {cap}", shifted, ions.peptide, MORPHEUS_TOLERANCE)
    raw, matched = pairs.sums(place), pairs.sums(place, spectra.value[peak])
    at = _chosen(raw, positive)
    raw = raw[at] + matched[at] / spectra.extra[pairs.of(at)[0], 0]
    return at, raw, raw, raw


def probid_batch(spectra: Spectra, pairs: Pairs, peptides: Peptides, cap: int, positive: bool) -> tuple[np.ndarray, ...]:
    """Pairs without a seen ion have a score too, so every pair is returned."""
    ions = peptides.ions(1)
    ion, place, peak = _near(spectra, pairs, peptides, "p batch", ions.mz, ions.peptide, PROBID_ERROR)
    theta = PROBID_ERROR * 0.5
    constant = math.log(math.sqrt(2 * math.pi)) - math.log(theta)
    off = ions.mz[ion] - spectra.axis[peak]
    each = np.log(spectra.value[peak]) - constant - off * off / (2 * theta * theta)
    n = pairs.sums(place)
    raw = pairs.sums(place, each) + np.where(n > 0, n * np.log(np.maximum(n, 1.0)), 0.0)
    spectrum, peptide = pairs.whole()
    log_sum, span = spectra.extra[:, 0], spectra.extra[:, 1]
    cost = -np.log(np.where(span == 0, 1.0, span))
    score = raw + log_sum[spectrum] * (peptides.tryptophans[peptide] + 1) + (
        2 * peptides.length[peptide] - n) * cost[spectrum]
    return np.arange(pairs.n), raw, score, score


BATCHES = {"kscore": kscore_batch, "tandem": tandem_batch, "comet": comet_batch, "morpheus": morpheus_batch,
           "probid": probid_batch, "sequest": probid_batch}

KERNELS = {"kscore": kscore, "tandem": tandem, "comet": comet, "morpheus": morpheus, "probid": probid, "sequest": probid}


# ---- ion use ---------------------------------------------------------------

def ion_use(peptides: Peptides, cap: int, row: np.ndarray, axis: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per peptide, each with a spectrum of its own: hits by b and by y, and their shares of the measured values.

    Entry i of the spectra lies at index `axis[i]` of the spectrum of peptide `row[i]`.  The first ion (charge, place, b
    before y) that touches an index is paid first; a direct hit that comes after a half payment gets the other half.
    Only direct hits are counted.
    """
    n, ions, wide = len(peptides.length), peptides.ions(cap), 1 << 24
    key, order = sorted_order(ions.peptide * wide + k_index(ions.mz))
    new = np.append(True, key[1:] != key[:-1])[:len(key)]
    key, first = key[new], order[new]  # equal keys come in the order of the ions
    inside = (axis >= 0) & (axis < wide) & (value != 0)
    row, value = row[inside], value[inside]
    index = row * wide + axis[inside].astype(np.int64)
    none = len(ions.mz)

    def first_of(k: np.ndarray) -> np.ndarray:
        if not none:
            return np.full(len(k), none)
        at = np.minimum(np.searchsorted(key, k), len(key) - 1)
        return np.where(key[at] == k, first[at], none)

    direct, beside = first_of(index), np.minimum(first_of(index - 1), first_of(index + 1))
    half = np.where((beside < none) & (beside < direct), 0.5, 0.0)
    whole = np.where(direct < none, 1.0 - half, 0.0)
    is_y = np.append(ions.is_y, False)
    sums = lambda x: np.bincount(row, x, n) if len(row) else np.zeros(n)
    counts = [sums((direct < none) & (is_y[direct] == y)) for y in (False, True)]
    scores = [sums(value * (whole * (is_y[direct] == y) + half * (is_y[beside] == y))) for y in (False, True)]
    return *counts, *scores
