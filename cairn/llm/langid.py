"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent n-grams (orders 1 to 3), counted over all its training documents.
A document is compared by its own most frequent n-grams: the sum of how far each is out of place in the
profile, with the profile's length for those that are missing. The nearest profile gives the language.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import utf8_slices

#: n-grams kept of a language and of a document.
PROFILE, DOCUMENT = 400, 300
#: The most languages that a model may have: bounds the model at ``MAX_LANGUAGES * PROFILE`` rows.
MAX_LANGUAGES = 1000
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def ngrams(text: str) -> np.ndarray:
    """All n-gram codes of a text: three code points of 21 bits, leading zeros for shorter ones.

    The text is lower-cased; every run of other characters than letters is one boundary (a space). An n-gram
    may begin or end with a boundary; trigrams have a letter in the middle, and a boundary alone is none.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    chars = np.concatenate(([32], np.where(letter, points, 32), [32])).astype(np.int64)
    is_letter = chars != 32
    keep = np.r_[True, is_letter[1:] | is_letter[:-1]]
    c, m = chars[keep], is_letter[keep]
    if not m.any():
        return np.empty(0, np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate((c[m], two, three[m[1:-1]]))


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` frequent codes, most frequent first; ties by code."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        near = counts >= least
        codes, counts = codes[near], counts[near]
    return codes[np.lexsort((codes, -counts))][:most]


def train_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE) -> DataFrame:
    """``lang, code, rank`` (from 0) over all rows with a language and a text; counts are summed over the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])

        for batch in utf8_slices(batches, 0, 4 << 20):
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(ngrams(text))
            for lang, parts in by.items():
                codes, counts = np.unique(np.concatenate(parts), return_counts=True)
                held.setdefault(lang, []).append((codes, counts))
                size += len(codes)
            if size > 2_000_000:
                yield from merged()
                held, size = {}, 0
        yield from merged()

    texts = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    totals = texts.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return totals.withColumn("rank", rank - 1).where(F.col("rank") < profile).select("lang", "code", "rank")


def predict(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", document: int = DOCUMENT) -> DataFrame:
    """``doc_id, lang_pred, score``; only the text decides.

    ``score`` is the margin between the nearest and the second nearest profile over the latter's distance
    (one minus the distance's share of the greatest possible, with one language). The model is collected:
    at most ``MAX_LANGUAGES`` profiles of a fixed length, which is checked.

    Edge cases: a null text, a text without a letter, or an empty model gives ``und`` with score 0; ties go to the
    language that comes first by name; texts are used whole; other columns are not read.
    """
    model = profiles.orderBy("lang", "rank").limit(MAX_LANGUAGES * 10_000 + 1).toArrow()
    names = sorted(set(model["lang"].to_pylist()))
    if len(names) > MAX_LANGUAGES or model.num_rows > MAX_LANGUAGES * 10_000:
        raise ValueError(f"more than {MAX_LANGUAGES} languages or 10000 n-grams each")
    lang = np.searchsorted(np.array(names), np.array(model["lang"].to_pylist())) if names else np.empty(0, int)
    codes, slots = np.unique(model["code"].to_numpy().astype(np.int64), return_inverse=True)
    size = int(model["rank"].to_numpy().max()) + 1 if model.num_rows else 0
    places = np.full((len(codes) + 1, len(names)), size, np.int32)  # the last row: in no profile
    places[slots, lang] = model["rank"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((names, codes, places, size))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, codes, places, size = shared.value
        for batch in utf8_slices(batches, 1):
            found, scores = [], []
            for text in batch.column(1).to_pylist():
                own, counts = np.unique(ngrams(text or ""), return_counts=True)
                if not len(own) or not names:
                    found.append("und")
                    scores.append(0.0)
                    continue
                top = ranked(own, counts, document)
                at = np.searchsorted(codes, top)
                at[at == len(codes)] = 0
                rows = places[np.where(codes[at] == top, at, len(codes))]
                here = np.arange(len(top), dtype=np.int32)[:, None]
                distance = np.where(rows < size, np.abs(rows - here), size).sum(axis=0)
                best = int(distance.argmin())
                other = np.delete(distance, best)
                second = float(other.min()) if len(other) else float(size * len(top))
                found.append(names[best])
                scores.append(min(1.0, max(0.0, (second - float(distance[best])) / second)) if second else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(nearest, "doc_id long, lang_pred string, score double")


def is_held_out(id_col: str = "doc_id"):
    """Whether a row belongs to the held-out third: ``crc32`` of the id as text is 1 modulo 3 (never for a null id)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
