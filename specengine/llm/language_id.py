"""Language identification with hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS signs, made from its code point alone.  A trigram's
vector binds its letters: the first one's vector rotated by two places, the second's by one, multiplied
with the third's.  A document's vector bundles (adds) the vectors of all its trigrams, a language's
prototype those of all its documents.  A document gets the language whose prototype has the
largest cosine with it; the score is that cosine, cut to 0..1.

A task turns a chunk of documents into a matrix of trigram counts and multiplies it with the trigrams'
vectors.  Prototypes are added by language and block of dimensions, after each task has added its own.
They are one vector a language, LANGUAGES at most, and so are broadcast.

Words are runs of letters in lower case, with one blank on either side.

Defined cases: null text and text without a letter get `und` and score 0; so does every text when no
language was learned, or if none of its trigrams points anywhere.  Ties go to the first language by
code point.  Rows with a null language or id teach nothing, but are predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from specengine.llm.common import U, add_columns, chunks, mix

DIMENSIONS = 1024
LANGUAGES = 10_000
#: Characters whose trigram counts a task holds as one matrix.
CHUNK = 2_000_000
UNKNOWN = "und"


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for every code point."""
    seeds = mix(letters.astype(U) + U(1))[:, None] + np.arange(DIMENSIONS // 64, dtype=U)[None, :]
    bits = np.unpackbits(mix(seeds).astype("<u8").view(np.uint8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def trigram_vectors(letters: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The bound vectors of trigrams, given the letters' vectors and the places of the three letters."""
    out = np.roll(letters, 2, axis=1)[a]
    out *= np.roll(letters, 1, axis=1)[b]
    out *= letters[c]
    return out


def bundles(column: pa.Array, group: np.ndarray | None = None, groups: int = 0) -> np.ndarray:
    """One bundled vector per row, or per group of rows; 0 where there is no letter."""
    rows = len(column)
    if group is None:
        group, groups = np.arange(rows), rows
    texts = pc.utf8_lower(column.fill_null("") if column.null_count else column).to_pylist()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    row = np.repeat(np.arange(rows), np.diff(np.concatenate(([0], ends))))[:len(codes)]
    letter = np.where(_is_letter()[codes], codes, 0x20)
    # Runs of other characters become one blank; a row's text has a blank before and behind it.
    keep = (letter != 0x20) | np.concatenate(([True], letter[:-1] != 0x20)) | np.concatenate(
        ([True], row[1:] != row[:-1]))
    letter, row = letter[keep], row[keep]
    head = np.concatenate(([True], row[1:] != row[:-1])) & (letter != 0x20) if len(letter) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    letter, row = np.insert(letter, at, 0x20), np.insert(row, at, row[at])
    tail = np.flatnonzero(np.concatenate((row[1:] != row[:-1], [True])) & (letter != 0x20)) if len(row) else []
    letter, row = np.insert(letter, np.asarray(tail, int) + 1, 0x20), np.insert(row, np.asarray(tail, int) + 1, row[tail])
    if len(letter) < 3:
        return np.zeros((groups, DIMENSIONS), np.float32)
    inside = np.flatnonzero((row[2:] == row[:-2]) & (letter[1:-1] != 0x20))
    present = np.zeros(0x110000, bool)
    present[letter] = True
    alphabet = np.flatnonzero(present)
    number_of = np.zeros(0x110000, np.int32)
    number_of[alphabet] = np.arange(len(alphabet))
    place = number_of[letter]
    n = len(alphabet)
    key = (place[inside].astype(np.int64) * n + place[inside + 1]) * n + place[inside + 2]
    if n ** 3 <= 20_000_000:
        there = np.bincount(key, minlength=1) > 0
        kinds = np.flatnonzero(there)
        number = (np.cumsum(there) - 1)[key]
    else:
        kinds, number = np.unique(key, return_inverse=True)
    vectors = letter_vectors(alphabet)
    out = np.zeros((groups, DIMENSIONS), np.float32)
    of = group[row[inside]]
    for first in range(0, len(kinds), 16_384):  # bounds the matrices, whatever the alphabet
        some = kinds[first:first + 16_384]
        mine = (number >= first) & (number < first + len(some))
        counts = np.bincount(of[mine] * len(some) + number[mine] - first, minlength=groups * len(some))
        bound = trigram_vectors(vectors, some // (n * n), some // n % n, some % n)
        out += counts.reshape(groups, len(some)).astype(np.float32) @ bound
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Chunks whose count matrix stays small, and at most 1024 documents."""
    for part in chunks(iter([batch]), most=CHUNK):
        for first in range(0, part.num_rows, 1024):
            yield part.slice(first, 1024)


def prototypes(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototype by language, from (text, lang) without null languages."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in _pieces(batch):
                langs, group = np.unique(np.array(part.column(1).to_pylist()), return_inverse=True)
                for lang, total in zip(langs, bundles(part.column(0), group, len(langs))):
                    sums[str(lang)] = sums.get(str(lang), 0.0) + total.astype(np.float64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * 16), pa.array(np.arange(16)),
                 pa.array(np.rint(total).astype(np.int64).reshape(16, -1).tolist(), pa.list_(pa.int64()))],
                ["lang", "block", "part"])

    parts = labelled.mapInArrow(add, "lang string, block long, part array<long>")
    sums = parts.select("lang", "block", F.posexplode("part").alias("i", "v")).groupBy("lang", "block", "i").agg(
        F.sum("v").alias("v")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("block", "i", "v"))).alias("v"))
    found = sums.select("lang", F.col("v.v").alias("v")).limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return {r[0]: _unit(np.array(r[1], np.float64)[None, :])[0].astype(np.float32) for r in sorted(found)}


def predict(docs: DataFrame, learned: dict[str, np.ndarray], keep_text: bool = False) -> DataFrame:
    """docs with lang_pred and score, from the text alone."""
    held = docs.sparkSession.sparkContext.broadcast(
        (list(learned), np.stack(list(learned.values())) if learned else np.zeros((0, DIMENSIONS), np.float32)))
    schema = StructType([f for f in docs.schema.fields if keep_text or f.name != "text"])
    schema = schema.add("lang_pred", StringType()).add("score", DoubleType())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = held.value
        for batch in batches:
            for part in _pieces(batch):
                vectors = bundles(part.column(part.schema.get_field_index("text")))
                if names:
                    cosine = _unit(vectors) @ matrix.T
                    best = cosine.argmax(1)
                    score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
                    known = vectors.any(1)
                    lang = np.where(known, np.array(names, object)[best], UNKNOWN)
                    score = np.where(known, score, 0.0)
                else:
                    lang, score = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                yield add_columns(part, () if keep_text else ("text",),
                                  lang_pred=pa.array(lang.tolist(), pa.string()), score=score)

    return docs.mapInArrow(judge, schema)


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5 is 0: these rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    held_out = is_held_out(F.col("doc_id"))
    teaching = docs.filter(~held_out & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("text", "lang")
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), prototypes(teaching))
