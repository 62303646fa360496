"""Hierarchical packing of token ids into context windows of several lengths.

A task tokenizes its documents and packs them as it reads them; nothing is shuffled and each text is
tokenized once.  Per batch:

1. whole windows of WINDOW tokens are cut off long documents, each is a full sequence;
2. what is left of a document is routed to the smallest tier (TIERS) that holds it;
3. tiers are packed from the longest on: the longest rest opens a window of its tier, its gap is filled
   by the longest rests of shorter tiers that fit, and at last by cutting one, so that it is full;
4. what doesn't fill a window waits for the next batch; at a task's end it is cut into windows of
   powers of two, which need no padding.

So only whole powers of two come out.  Sequences of one tier are dealt to step groups of STEP in the
order of their cost (the sum of the squared piece lengths, as attention has it), to and fro, so that
groups of a tier cost about the same.

Texts are split at single blanks between characters that aren't white space, where the tokenizer
splits in any case; each distinct piece of a task is tokenized once and then looked up by its hash.
The ids are those of the JSON file's tokenizer; the faster file of the same ranks gives them wherever
the text doesn't spell its special token.

Defined cases: null text is empty: its one id is the end id.  Repeated rows are packed each.  Sequence
numbers carry the task's number in their upper bits, so they are distinct, not gapless.  A repeated
task reads the same rows in the same order and gives the same pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType

from specengine.llm.common import chunks, span_hashes, utf8

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
STEP = 16
END_ID = 1
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"  # the same vocabulary
SPECIAL = "<|endoftext|>"
#: Distinct pieces of text that a task remembers.
HELD_PIECES = 2_500_000

SCHEMA = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_group long")


@cache
def shared_tokens(path: str, ranks_path: str) -> Tokens:
    """One for all tasks of a worker."""
    return Tokens(path, ranks_path)


class Tokens:
    """Token ids of texts, by looking up the pieces between safe blanks."""

    def __init__(self, path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                       special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.bytes_of[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
        self.ids = np.zeros(0, np.uint32)

    @staticmethod
    def _cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places of blanks before which a text may be cut; a character that could be white space of
        several bytes (they begin with C2, E1, E2 or E3) on either side rules a blank out."""
        inner = np.flatnonzero(data[1:-1] == 0x20) + 1 if len(data) > 2 else np.zeros(0, np.int64)
        # Nothing is read over a row's border: a blank at a row's end or start has none or a neighbour's byte.
        start_or_end = np.zeros(len(data) + 1, bool)
        start_or_end[at] = True
        before, after = data[inner - 1], data[inner + 1]
        solid = (before > 0x20) & (before != 0x7F) & (after > 0x20) & (after != 0x7F)
        wide = np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3))
        lead2 = np.where(inner >= 2, data[np.maximum(inner - 2, 0)], 0)
        lead3 = np.where(inner >= 3, data[np.maximum(inner - 3, 0)], 0)
        wide |= (before >= 0x80) & ((lead2 == 0xC2) | np.isin(lead3, (0xE1, 0xE2, 0xE3)))
        return inner[solid & ~wide & ~start_or_end[inner] & ~start_or_end[inner + 1]]

    def _encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray,
                whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids per piece).  Pieces between cuts are tokenized as one text, since a cut
        always separates tokens, and parted again by the tokens' bytes."""
        raw = data.tobytes()
        own = [self._ids(raw[a:b].decode("utf-8", "replace")) for a, b in zip(start[~whole], end[~whole])]
        joined = b"".join([raw[a:b] for a, b in zip(start[whole], end[whole])])
        many = self._ids(joined.decode("utf-8", "replace"))
        if SPECIAL.encode() in joined:
            parts = [self._ids(raw[a:b].decode("utf-8", "replace")) for a, b in zip(start[whole], end[whole])]
            per_whole = np.array([len(x) for x in parts], np.int64)
            many = np.concatenate(parts)
        else:
            stops = np.searchsorted(np.cumsum(self.bytes_of[many]), np.cumsum((end - start)[whole])) + 1
            per_whole = np.diff(np.concatenate(([0], stops)))
        n = np.zeros(len(start), np.int64)
        n[whole], n[~whole] = per_whole, [len(x) for x in own]
        out = np.zeros(n.sum(), np.uint32)
        of_whole = np.repeat(whole, n)
        out[of_whole] = many
        if own:
            out[~of_whole] = np.concatenate(own)
        return out, n

    def _ids(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.ranks.encode_ordinary(text), np.uint32)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of the rows)."""
        rows = len(at) - 1
        start = np.sort(np.concatenate((self._cuts(data, at), at[:-1][np.diff(at) > 0])))
        end = np.append(start[1:], len(data))[:len(start)]
        row = np.searchsorted(at, start, "right") - 1
        key = span_hashes(data, start, end)
        kinds, first = np.unique(key, return_index=True)
        near = np.minimum(np.searchsorted(self.keys, kinds), max(len(self.keys) - 1, 0))
        new = self.keys[near] != kinds if len(self.keys) else np.ones(len(kinds), bool)
        if len(self.keys) + new.sum() > HELD_PIECES:
            self._forget()
            new = np.ones(len(kinds), bool)
        if new.any():
            # A piece is whole if it begins and ends at a cut; only a row's last piece doesn't.
            whole = np.append(row[1:] == row[:-1], False)[first[new]] & (start != at[row])[first[new]]
            found, n = self._encode(data, start[first[new]], end[first[new]], whole)
            begin = len(self.ids) + np.cumsum(n) - n
            self.ids = np.concatenate((self.ids, found))
            keys = np.concatenate((self.keys, kinds[new]))
            where = np.concatenate((self.at, np.c_[begin, n]))
            order = np.argsort(keys)
            self.keys, self.at = keys[order], where[order]
        place = self.at[np.searchsorted(self.keys, key)] if len(key) else np.zeros((0, 2), np.int64)
        n = place[:, 1]
        stop = np.cumsum(n)
        ids = self.ids[np.repeat(place[:, 0] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        per_row = np.bincount(row, n, rows).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(per_row)))


class Packer:
    """Collects pieces and gives full sequences; a piece is (document, start, ids)."""

    def __init__(self, first_sequence: int):
        self.next = first_sequence
        self.waiting: list[tuple[int, int, np.ndarray]] = []
        self.done: list[tuple[int, list]] = []

    def add(self, doc: int, ids: np.ndarray) -> None:
        whole = len(ids) // WINDOW * WINDOW
        for start in range(0, whole, WINDOW):
            self.done.append((WINDOW, [(doc, start, ids[start:start + WINDOW])]))
        if whole < len(ids):
            self.waiting.append((doc, whole, ids[whole:]))

    def pack(self) -> None:
        """Fill windows from the longest rests on; the rest of the rests waits."""
        rests = sorted(self.waiting, key=lambda p: (len(p[2]), p[0], p[1]))
        sizes, low, self.waiting = [len(p[2]) for p in rests], 0, []
        left = sum(sizes)
        while rests:
            tier = next(t for t in TIERS if t >= sizes[-1])
            if left < tier:
                break
            window, gap = [rests.pop()], tier - sizes.pop()
            left -= len(window[0][2])
            while gap:
                # The longest that fits without a cut; else the shortest is cut, which leaves the least behind.
                at = _last_fitting(sizes, gap)
                if at >= 0:
                    piece = rests.pop(at)
                    sizes.pop(at)
                    left -= len(piece[2])
                    window.append(piece)
                    gap -= len(piece[2])
                    continue
                doc, start, ids = rests.pop(0)
                sizes.pop(0)
                window.append((doc, start, ids[:gap]))
                tail = (doc, start + gap, ids[gap:])
                at = _last_fitting(sizes, len(tail[2])) + 1
                rests.insert(at, tail)
                sizes.insert(at, len(tail[2]))
                left -= gap
                gap = 0
            self.done.append((tier, window))
        self.waiting = rests

    def finish(self) -> None:
        """Cut what waits into windows of powers of two, the longest first."""
        self.pack()
        left, pieces = sum(len(p[2]) for p in self.waiting), list(reversed(self.waiting))
        self.waiting = []
        while left:
            size = min(WINDOW, 1 << left.bit_length() - 1)
            window, gap = [], size
            while gap:
                doc, start, ids = pieces.pop()
                window.append((doc, start, ids[:gap]))
                if len(ids) > gap:
                    pieces.append((doc, start + gap, ids[gap:]))
                gap -= len(window[-1][2])
            self.done.append((size, window))
            left -= size

    def sequences(self) -> list[tuple[int, int, int, list]]:
        """(sequence, tier, step group, pieces) of the finished windows."""
        out, by_tier = [], {}
        for tier, window in self.done:
            by_tier.setdefault(tier, []).append(window)
        for tier, windows in sorted(by_tier.items()):
            windows.sort(key=lambda w: -sum(len(p[2]) ** 2 for p in w))
            groups = -(-len(windows) // STEP)
            for i, window in enumerate(windows):
                turn, place = divmod(i, groups)
                group = place if turn % 2 == 0 else groups - 1 - place
                out.append((self.next + i, tier, self.next + group, window))
            self.next += len(windows)
        self.done = []
        return out


def _last_fitting(sizes: list[int], most: int) -> int:
    """Place of the last size that isn't above `most`, or -1."""
    return bisect_right(sizes, most) - 1


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group) of every piece."""
    import public_tokenizers

    paths = tokenizer or public_tokenizers.path(TOKENIZER), ranks or public_tokenizers.path(RANKS)
    id_type: DataType = docs.schema["doc_id"].dataType

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = shared_tokens(*paths), Packer(TaskContext.get().partitionId() << 40)
        names: dict[int, tuple[object, int]] = {}
        counter = 0
        for batch in chunks(batches):
            ids, at = tokens.encode(*utf8(batch.column(1)))
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                own = np.append(ids[at[i]:at[i + 1]], np.uint32(END_ID))
                names[counter] = (doc_id, len(own))
                packer.add(counter, own)
                counter += 1
            packer.pack()
            yield rows(packer.sequences(), names)
            names = {p[0]: names[p[0]] for p in packer.waiting}
        packer.finish()
        yield rows(packer.sequences(), names)

    arrow_id = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}[id_type.typeName()]

    def rows(sequences: list, names: dict) -> pa.RecordBatch:
        out: list[tuple] = []
        for sequence, tier, group, window in sequences:
            offset = 0
            for doc, start, ids in window:
                out.append((names[doc][0], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()),
                            names[doc][1], sequence, offset, tier, group))
                offset += len(ids)
        kinds = [arrow_id, *[pa.int64()] * 6, pa.int32(), pa.int64()]
        columns = list(zip(*out)) if out else [[]] * 9
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            ["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]])

    return docs.select("doc_id", "text").mapInArrow(step, f"doc_id {id_type.simpleString()}, {SCHEMA}")
