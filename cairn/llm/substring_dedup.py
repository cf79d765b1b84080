"""Substring deduplication by repeated-phrase automata.

Every window of ``width`` words holds a key phrase of ``PHRASE`` words: the one whose hash is smallest. Equal windows
have equal key phrases, so a window can only recur if its key phrase does. Key phrases that recur anywhere in the corpus are
found by counting hashes. The documents are dealt into shards of bounded size, and each shard gets the recurring phrases
that its documents may hold, compiles them into an Aho-Corasick automaton, and streams its documents through it: the automaton
says, by words and not by hashes, where the phrases occur. Windows over a located key phrase are then confirmed: of each
distinct window the first occurrence in the corpus stays, and every other one is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import attach_group, materialize, numbered, release, sweep, utf8_slices

#: Words of a key phrase, words of a shard's documents (a longer document is a shard's only large one).
PHRASE, SHARD_WORDS = 5, 400_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def run_hashes(hashed: np.ndarray, width: int, step: np.uint64 = _STEP, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive word hashes, or of those that begin at ``at``."""
    whole = max(0, len(hashed) - width + 1)
    h = np.zeros(whole if at is None else len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            h = h * step + (hashed[j : j + whole] if at is None else hashed[at + j])
        return _mix(h)


def _slide(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least (or greatest) of every ``width`` consecutive values, by doubling."""
    done = 1
    while done < width:
        more = min(done, width - done)
        values = best(values[: len(values) - more], values[more:])
        done += more
    return values


def key_phrases(phrases: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the hashes of a stream's phrases: the key hash of every window of ``width`` words, and where key phrases of ``valid`` windows begin."""
    span = width - PHRASE + 1
    keys = _slide(phrases, span, np.minimum)
    edge = np.zeros(span - 1, np.uint64)
    return keys, _slide(np.r_[edge, np.where(valid, keys, 0), edge], span, np.maximum) == phrases


class _Words(dict):
    """Numbers words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def _hashes_of(words: _Words, kept: np.ndarray) -> np.ndarray:
    """The hashes of all numbered words; those of the first ones are known."""
    fresh = [xxhash.xxh3_64_intdigest(w) for w in list(words)[len(kept) :]]
    return np.r_[kept, np.array(fresh, np.uint64)]


class _Stream:
    """Texts' words as one stream of numbers, a number that is no word behind each text: windows must not reach over it."""

    def __init__(self, split: list[list[bytes]], words: _Words, width: int) -> None:
        flat = chain.from_iterable(part for s in split for part in (s, (b"\n",)))
        self.sizes = np.array([len(s) for s in split], np.int64)
        self.begin = np.r_[0, np.cumsum(self.sizes + 1)]
        self.numbers = np.fromiter(map(words.__getitem__, flat), np.int64, int(self.begin[-1]))
        edges = np.zeros(max(0, len(self.numbers) - width + 1) + 1, np.int64)
        whole = self.sizes >= width
        np.add.at(edges, self.begin[:-1][whole], 1)
        np.add.at(edges, (self.begin[:-1] + self.sizes - width + 1)[whole], -1)
        self.valid = np.cumsum(edges[:-1]).astype(bool)

    def lists(self, at: np.ndarray) -> np.ndarray:
        """Offsets that cut ascending places ``at`` into one list per text."""
        return np.searchsorted(at, self.begin).astype(np.int32)


def scan(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, hi, lo, whole_sha256, keys, packed, row``.

    ``hi, lo`` name the word sequence by 128 bits, ``whole_sha256`` is of all words joined; texts of at least ``width`` words have the hashes of
    their key phrases in ``keys`` and their words, joined and compressed, in ``packed``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, pack = _Words(), np.empty(0, np.uint64), zstandard.ZstdCompressor(level=1).compress
        for batch in utf8_slices(batches, 1, 4 << 20):
            if len(words) > 1_000_000:
                words, known = _Words(), known[:0]
            split = [text.encode("utf-8", "surrogatepass").split() if text else [] for text in batch.column(1).to_pylist()]
            stream = _Stream(split, words, width)
            known = _hashes_of(words, known)
            phrases = run_hashes(known[stream.numbers], PHRASE)
            at = np.flatnonzero(key_phrases(phrases, stream.valid, width)[1]) if len(stream.valid) else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(stream.lists(at)), pa.array(phrases[at].view(np.int64)))
            joined = [b" ".join(s) for s in split]
            names = np.array([np.frombuffer(xxhash.xxh3_128_digest(j), np.int64) for j in joined])
            sums = pa.array([hashlib.sha256(j).hexdigest() for j in joined])
            packed = pa.array([pack(j) if n >= width else None for j, n in zip(joined, stream.sizes, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stream.sizes), pa.array(names[:, 0]), pa.array(names[:, 1]), sums, lists, packed], ["doc_id", "n_words", "hi", "lo", "whole_sha256", "keys", "packed"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(run, "doc_id long, n_words long, hi long, lo long, whole_sha256 string, keys array<long>, packed binary")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "phrase-scan")


def _letters(numbers: np.ndarray) -> str:
    """Three letters a word, each place from an alphabet of its own, so that matches begin at words."""
    digits = np.stack([numbers % 128, numbers // 128 % 128, numbers // 16384], axis=1) + np.array([0x100, 0x200, 0x300])
    return digits.astype("<u4").tobytes().decode("utf-32-le")


def locate(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the phrases that begin at ``starts`` of a stream of word numbers occur in it (a boolean per word), by an automaton."""
    text, found = _letters(numbers), np.zeros(len(numbers), bool)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i in starts.tolist():
        automaton.add_word(text[3 * i : 3 * (i + PHRASE)], 1)
    if len(automaton):
        automaton.make_automaton()
        ends = np.fromiter((end for end, _ in automaton.iter(text)), np.int64)
        found[ends // 3 - PHRASE + 1] = True
    return found


def suspects(texts: list[bytes], recurring: np.ndarray, width: int) -> tuple[_Stream, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as a stream, the starts of windows whose key phrase recurs, and these windows' two hashes.

    The key phrases whose hash is among ``recurring`` (sorted) become one automaton, through which all the texts stream.
    """
    words = _Words()
    stream = _Stream([text.split(b" ") for text in texts], words, width)
    hashed = _hashes_of(words, np.empty(0, np.uint64))[stream.numbers]
    phrases = run_hashes(hashed, PHRASE)
    keys, is_key = key_phrases(phrases, stream.valid, width)
    at = np.flatnonzero(is_key)
    slot = np.minimum(np.searchsorted(recurring, phrases[at]), len(recurring) - 1)
    found = locate(stream.numbers, at[recurring[slot] == phrases[at]])
    located = np.where(found[: len(phrases)], phrases, _NONE)
    windows = np.flatnonzero(stream.valid & (_slide(located, width - PHRASE + 1, np.minimum) == keys))
    return stream, windows, run_hashes(hashed, width, at=windows), run_hashes(hashed, width, _OTHER, windows)


def suspect_windows(rows: DataFrame, placed: DataFrame, shards: int, width: int) -> DataFrame:
    """``place, runs, first, second, packed``: of each distinct text with windows whose key phrase recurs, their starts (as runs) and hashes.

    Texts, their places and the recurring phrases that each shard may hold meet in one cogroup by shard.
    """
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    each = rows.select(shard, F.explode("keys").alias("key"))
    recurring = materialize(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "recurring-phrases")
    sweep(rows.sparkSession)
    held = materialize(rows.select(shard, F.explode(F.array_distinct("keys")).alias("key")).join(recurring, "key"), "phrases-of-shards")
    sweep(rows.sparkSession)
    held = held.select("shard", "key", F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("place"))
    side = held.unionByName(placed.select(shard, F.lit(None).cast("long").alias("key"), "row", F.col("pos").alias("place")))
    text = rows.where("packed IS NOT NULL").select(shard, "row", "packed")
    schema = pa.schema([("place", pa.int64()), ("runs", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())), ("second", pa.list_(pa.int32())), ("packed", pa.binary())])

    def search(texts: pa.Table, side: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        keys = side["key"].drop_null().to_numpy().view(np.uint64)
        places = side.select(["row", "place"]).drop_null().to_pydict()
        place = dict(zip(places["row"], places["place"], strict=True))
        mine = [(place[row], packed) for row, packed in zip(texts["row"].to_pylist(), texts["packed"].to_pylist(), strict=True) if row in place]
        if not mine or not len(keys):
            return schema.empty_table()
        stream, windows, first, second = suspects([unpack(packed) for _, packed in mine], np.unique(keys), width)
        cut = np.flatnonzero(np.diff(windows, prepend=-2) != 1)  # no run reaches over the end of a text
        heads, tails = windows[cut], np.r_[windows[cut[1:] - 1], windows[-1:]]
        of = np.searchsorted(stream.begin, heads, "right") - 1
        runs = np.stack([heads, tails], axis=1) - stream.begin[of][:, None]
        hit = np.diff(stream.lists(windows)) > 0
        ends = pa.array(np.r_[0, stream.lists(windows)[1:][hit]].astype(np.int32))
        run_ends = pa.array(2 * np.r_[0, np.searchsorted(of, np.flatnonzero(hit), "right")].astype(np.int32))
        lists = [pa.ListArray.from_arrays(run_ends, pa.array(runs.ravel())), pa.ListArray.from_arrays(ends, pa.array(first.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(second.view(np.int64).astype(np.int32)))]
        shown = [m for m, h in zip(mine, hit, strict=True) if h]
        return pa.table([pa.array([m[0] for m in shown], pa.int64()), *lists, pa.array([m[1] for m in shown], pa.binary())], schema=schema)

    return materialize(text.groupBy("shard").cogroup(side.groupBy("shard")).applyInArrow(search, "place long, runs array<long>, first array<long>, second array<int>, packed binary"), "suspect-windows")


def cut_repeats(windows: DataFrame, width: int, place_bits: int) -> DataFrame:
    """``place, n_removed, kept_sha256`` of the texts that lose words.

    A window's place in the corpus is one number, so its first occurrence is a minimum that combines before the shuffle. Each first
    occurrence goes back to its one text; a text removes all its suspect windows but those.
    """
    starts = F.flatten(F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda i: F.sequence(F.get("runs", i), F.get("runs", i + 1))))
    each = windows.select("place", F.explode(F.arrays_zip(starts.alias("start"), "first", "second")).alias("w"))
    each = each.select(F.col("w.first").alias("first"), F.col("w.second").alias("second"), F.shiftleft("place", place_bits).bitwiseOR(F.col("w.start")).alias("at"))
    firsts = each.groupBy("first", "second").agg(F.min("at").alias("at"))
    stay = firsts.groupBy(F.shiftright("at", place_bits).alias("place")).agg(F.collect_list(F.col("at").bitwiseAND(F.lit((1 << place_bits) - 1))).alias("stay"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for place, runs, packed, stay in zip(*(c.to_pylist() if i != 3 else c for i, c in enumerate(batch.columns)), strict=True):
                words = unpack(packed).split(b" ")
                delta = np.zeros(len(words) + 1, np.int64)
                gone = np.zeros(len(words), bool)
                for a, b in zip(runs[::2], runs[1::2], strict=True):
                    gone[a : b + 1] = True
                if stay.is_valid:
                    gone[stay.values.to_numpy()] = False
                at = np.flatnonzero(gone)
                delta[at] += 1
                delta[at + width] -= 1
                keep = np.cumsum(delta[:-1]) == 0
                if len(at):
                    kept = b" ".join([words[i] for i in np.flatnonzero(keep)])
                    out.append((place, len(words) - int(keep.sum()), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["place", "n_removed", "kept_sha256"])

    joined = windows.select("place", "runs", "packed").join(stay, "place", "left")
    return materialize(joined.mapInArrow(cut, "place long, n_removed long, kept_sha256 string"), "cut-texts")


def remove_repeats(docs: DataFrame, width: int = 20, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: one row per input row.

    Words are runs of characters other than ``[\\x20\\x09-\\x0D]``, unchanged. Every word covered by a window of ``width`` words whose
    sequence also starts earlier (smaller id, or the same document and an earlier start) is removed; windows are judged on the input.

    A text with the same words as an earlier one of at least ``width`` words loses all of them, and only distinct texts are searched. Phrases are
    told apart by their words, windows with one another by 96 bits.

    Edge cases: a null or empty text, and one without words, has no words and an empty rest; texts under ``width`` words lose none; a null id
    comes after all others; rows that share an id are ordered by a hash of their words, rows equal in both lose all words but one of them; a text of
    any length is searched whole, in one task; an empty table gives an empty table. Only the two named columns are read.
    """
    rows = scan(docs, width, id_col, text_col)
    small = materialize(rows.select("row", "doc_id", "n_words", "hi", "lo", "whole_sha256", F.col("doc_id").isNull().alias("z")), "text-names")
    first = F.min(F.struct("z", "doc_id", "row")).alias("first")
    told = attach_group(small.where(F.col("n_words") >= width), ["hi", "lo"], "row", [first])
    told = materialize(told.select("row", "z", "doc_id", "hi", "lo", "n_words", (F.col("first.row") != F.col("row")).alias("copy")), "text-copies")
    placed = materialize(numbered(told.where("NOT copy").select("row", "z", "doc_id", "hi", "lo", F.lit(0).alias("g")), "g", ["z", "doc_id", "hi", "lo"], "text-order").select("row", "pos"), "text-places")
    size = told.agg(F.sum("n_words").alias("words"), F.max("n_words").alias("longest"), F.count("*").alias("n")).first()
    place_bits = int(size["longest"] or 0).bit_length()
    if place_bits + int(size["n"]).bit_length() > 63:
        raise ValueError("documents times the longest document's words exceed 63 bits")
    windows = suspect_windows(rows, placed, -(-int(size["words"] or 1) // shard_words), width)
    release(rows)
    sweep(docs.sparkSession)
    cut = cut_repeats(windows, width, place_bits)
    release(windows)
    lost = placed.join(cut.withColumnRenamed("place", "pos"), "pos").select("row", "n_removed", "kept_sha256")
    lost = lost.unionByName(told.where("copy").select("row", F.col("n_words").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256")))
    out = small.join(lost, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
each AS MATERIALIZED (SELECT doc_id, i, words[i] AS word, CASE WHEN i + 19 <= len(words) THEN words[i:i + 19] END AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
judged AS (SELECT doc_id, i, word,
    win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM each),
covered AS (SELECT doc_id, i, word,
    bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM judged),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS rest
  FROM covered GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
