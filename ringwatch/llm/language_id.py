"""Language identification with hyperdimensional letter n-gram profiles.

Every letter has a random vector of +1 and -1 in a thousand dimensions or so; a word boundary has
one too. An n-gram binds its letters: each vector is permuted (rotated) by its place, and the
rotated vectors are multiplied. A document bundles (adds up) its n-grams. A language prototype
bundles the unit vectors of its documents. A document gets the language of the nearest prototype
by cosine, after the part that all prototypes share has been taken out of both.

Whole texts are read; documents go through one map without a shuffle, and only one partial
prototype per language and task is added up. Prototypes are small by construction (languages x
dimensions), and their number is checked against `max_langs` before they are sent to the tasks.

Edge cases: a null text, or one without a letter, is `und` with score 0, as is everything when
no document can be learned from. Ties go to the language that sorts first. Long texts are taken
in pieces, with the same sums.
"""

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch.llm.common import replacing, with_missing

DIMS = 1024
ORDER = 3
SLOTS = 64
PIECE = 1_000_000
SEED = 20


@functools.cache
def letter_slots(slots: int) -> np.ndarray:
    """The slot of every code point: 0 for non-letters, a-z and then hashed slots for other letters."""
    table = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (slots - 27)
    return table


@functools.cache
def placed_letters(slots: int, dims: int, order: int) -> list[np.ndarray]:
    """The letter vectors, rotated once for every place of an n-gram."""
    letters = (np.random.default_rng(SEED).integers(0, 2, (slots, dims), dtype=np.int8) * 2 - 1).astype(np.int8)
    return [np.roll(letters, place, axis=1) for place in range(order)]


def gram_counts(text: str, slots: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct letter n-grams of a text as numbers, and how often each occurs.

    Runs of other characters are one boundary; n-grams without a letter in the middle are none.
    """
    found: dict[int, int] = {}
    table = letter_slots(slots)
    tail = np.zeros(1, dtype=np.int64)
    parts = []
    for start in range(0, max(len(text), 1), PIECE):
        codes = table[np.frombuffer(text[start : start + PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        codes = np.concatenate([tail, codes] + ([np.zeros(1, dtype=np.int64)] if start + PIECE >= len(text) else []))
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        if len(codes) >= order:
            key = codes[: len(codes) - order + 1].copy()
            for place in range(1, order):
                key = key * slots + codes[place : len(codes) - order + 1 + place]
            key = key[codes[order // 2 : len(codes) - order + 1 + order // 2] != 0]
            parts.append(np.unique(key, return_counts=True))
        tail = codes[-(order - 1) :]
    if len(parts) == 1:
        return parts[0]
    for keys, counts in parts:
        for k, n in zip(keys.tolist(), counts.tolist()):
            found[k] = found.get(k, 0) + n
    return np.array(list(found), dtype=np.int64), np.array(list(found.values()), dtype=np.int64)


def bundle(keys: np.ndarray, counts: np.ndarray, slots: int, dims: int, order: int) -> np.ndarray:
    """The unit vector of a document from its n-grams; zeros without any."""
    placed, out = placed_letters(slots, dims, order), np.zeros(dims, dtype=np.float32)
    for start in range(0, len(keys), 4096):
        rest, bound = keys[start : start + 4096], None
        for place in range(order - 1, -1, -1):
            letter = placed[place][rest % slots]
            bound = letter if bound is None else np.multiply(bound, letter, out=bound)
            rest = rest // slots
        out += counts[start : start + 4096].astype(np.float32) @ bound.astype(np.float32)
    norm = float(np.linalg.norm(out))
    return out / norm if norm else out


def document_vector(text: str | None, slots: int, dims: int, order: int) -> np.ndarray | None:
    keys, counts = gram_counts(text or "", slots, order)
    return bundle(keys, counts, slots, dims, order) if len(keys) else None


def learn_prototypes(docs: DataFrame, dims: int = DIMS, order: int = ORDER, slots: int = SLOTS) -> DataFrame:
    """(lang, dim, value): one bundled vector per language of the rows with text and lang."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                vector = document_vector(text.as_py(), slots, dims, order)
                if vector is not None:
                    name = lang.as_py()
                    sums[name] = sums[name] + vector if name in sums else vector.astype(np.float64)
        for name, vector in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name], "vector": [vector.tolist()]}, schema=schema)

    schema = pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.float64()))])
    partial = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    vectors = partial.mapInArrow(add_up, "lang string, vector array<double>")
    return vectors.select("lang", F.posexplode("vector").alias("dim", "value")).groupBy("lang", "dim").agg(F.sum("value").alias("value"))


def prototype_matrix(prototypes: DataFrame, dims: int = DIMS, max_langs: int = 4096) -> tuple[list[str], np.ndarray]:
    """Sorted names and centred unit rows; at most max_langs x dims numbers come to the driver."""
    rows = prototypes.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("v"))
    rows = rows.limit(max_langs + 1).collect()
    if len(rows) > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs if so many are meant")
    rows = sorted(rows, key=lambda r: r["lang"])
    matrix = np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), dims)
    # sums of floats differ in their last digits with the order of the tasks
    matrix = np.round(matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12), 9)
    return [r["lang"] for r in rows], matrix


def identify(
    docs: DataFrame, names: list[str], matrix: np.ndarray, dims: int = DIMS, order: int = ORDER, slots: int = SLOTS
) -> DataFrame:
    """`docs` without its text column, with lang_pred and score (cosine with the prototype, 0 to 1)."""
    common = matrix.mean(axis=0) if len(names) > 1 else np.zeros(dims)
    centred = matrix - common
    centred = (centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    shared, plain = common.astype(np.float32), matrix.astype(np.float32)
    kept = replacing(with_missing(docs, text="string"), "lang_pred", "score")
    others = [c for c in kept.columns if c != "text"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            for text in batch.column("text"):
                vector = document_vector(text.as_py(), slots, dims, order)
                if vector is None or not names:
                    pred.append("und")
                    score.append(0.0)
                    continue
                best = int(np.argmax(np.round(centred @ (vector - shared), 6)))
                pred.append(names[best])
                score.append(round(float(min(max(plain[best] @ vector, 0.0), 1.0)), 6))
            columns = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*others, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")
    return kept.mapInArrow(predict, f"{fields}{', ' if fields else ''}lang_pred string, score double")
