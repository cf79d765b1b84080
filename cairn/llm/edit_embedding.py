"""Document fingerprints by randomised edit embedding.

A walk reads a text from the left and writes one symbol a step; after each step a shared random bit of
(step, character) says whether the walk moves on to the next character or stays. Two texts of small edit
distance fall back into step after an edit, so their walks differ in few places: edit distance becomes
Hamming distance. A fingerprint keeps a bit-sampled part of the walk: steps sampled by hash, at a rate
that halves with each doubling of the text's length. The samples of a coarser level are among those of a
finer one, so fingerprints of any two lengths compare at the coarser level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import attach_group, materialize, utf8_slices
from cairn.llm.components import connected_components

#: A fingerprint keeps between this many and about four times as many samples of a long text.
SAMPLES = 64
#: The most runs into which documents are dealt by id; a run is streamed, so its length costs a task time but no memory.
MAX_RUNS = 16_384
_SEED = np.uint64(0x5DEECE66D1CE4E5B)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def symbols(text: str) -> np.ndarray:
    """One byte per code point: itself for Latin-1, hashed to a byte beyond."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 256, points, (points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)


def level_of(n_chars: int) -> int:
    """The sampling level: steps with so many trailing zero bits in their hash are kept."""
    return max(0, (2 * n_chars // SAMPLES).bit_length() - 2)


#: Random bits of the walk: 256 characters x 4096 step classes; the class of a step is hashed from it.
_BITS = (_mixed(np.arange(256 * 4096, dtype=np.uint64) ^ _SEED) >> np.uint64(40)).astype(np.uint8).reshape(4096, 256) & 1


def walks(texts: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """``(level, samples)`` of each text: samples are 4-bit symbols of the sampled steps, in step order.

    A symbol stands for the walk's character and the one behind it, as single letters are too few to tell texts apart.

    All walks of a batch advance together, longest text first, so that finished ones drop off at the end.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    out: list[tuple[int, np.ndarray]] = [(0, np.empty(0, np.uint8))] * len(texts)
    if not len(order) or not sizes[0]:
        return out
    end = np.zeros(1, np.uint8)  # behind each text, so that its last character has a neighbour of its own
    data = np.concatenate([x for i in order for x in (texts[i], end)])
    ends = np.cumsum(sizes + 1) - 1
    at = ends - sizes
    levels = np.array([level_of(int(n)) for n in sizes])
    finest, rows = int(levels[sizes > 0].min()), np.arange(len(order))
    live = int((sizes > 0).sum())
    at, ends, rows, levels = at[:live].copy(), ends[:live], rows[:live], levels[:live]
    kept_row: list[np.ndarray] = []
    kept_symbol: list[np.ndarray] = []
    step, chunk = 0, 4096
    flat = _BITS.reshape(-1)
    while len(at):
        hashed = _mixed(np.arange(step, step + chunk, dtype=np.uint64) ^ _SEED)
        classes = ((hashed >> np.uint64(50)) & np.uint64(4095)).astype(np.int64) << 8
        zeros = hashed & np.uint64((1 << 40) - 1)
        for k in range(chunk):
            char = data[at]
            z = int(zeros[k])
            depth = (z & -z).bit_length() - 1 if z else 40
            if depth >= finest:
                take = levels <= depth
                kept_row.append(rows[take])
                kept_symbol.append(_FOLD[char[take] * np.uint8(31) + data[at[take] + 1]])
            at += flat[classes[k] + char]
            if k & 31 == 31 or len(at) < 64:
                going = at < ends
                if not going.all():
                    at, ends, rows, levels = at[going], ends[going], rows[going], levels[going]
                    if not len(at):
                        break
            else:
                over = at >= ends
                if over.any():
                    going = ~over
                    at, ends, rows, levels = at[going], ends[going], rows[going], levels[going]
                    if not len(at):
                        break
        step += chunk
    if kept_row:
        all_rows, all_symbols = np.concatenate(kept_row), np.concatenate(kept_symbol)
        by = np.argsort(all_rows, kind="stable")
        all_symbols = all_symbols[by]
        bounds = np.searchsorted(all_rows[by], np.arange(len(order) + 1))
    else:
        all_symbols, bounds = np.empty(0, np.uint8), np.zeros(len(order) + 1, np.int64)
    for k, i in enumerate(order):
        out[i] = (level_of(len(texts[i])), all_symbols[bounds[k] : bounds[k + 1]])
    return out


#: Four bits of a character and its right neighbour, which are multiplied and added to one byte.
_FOLD = ((_mixed(np.arange(256, dtype=np.uint64)) >> np.uint64(33)) & np.uint64(15)).astype(np.uint8)


def _sampled_depths(count: int, level: int) -> np.ndarray:
    """The levels up to which the first ``count`` sampled steps of ``level`` are kept."""
    have = _depths.get(level)
    size = 4096 << level
    while have is None or len(have) < count:
        hashed = _mixed(np.arange(size, dtype=np.uint64) ^ _SEED) & np.uint64((1 << 40) - 1)
        low = hashed & (~hashed + np.uint64(1))
        depth = np.where(hashed == 0, 40, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64))
        have = depth[depth >= level]
        _depths[level] = have
        size *= 2
    return have[:count]


_depths: dict[int, np.ndarray] = {}


def coarser(fingerprint: tuple[int, np.ndarray], level: int) -> np.ndarray:
    """The samples that a coarser ``level`` would have kept."""
    own, samples = fingerprint
    return samples if own >= level else samples[_sampled_depths(len(samples), own) >= level]


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """The share of equal samples at the coarser of the two levels; steps beyond the shorter walk are unequal.

    Two empty texts are alike (1); an empty one and another are not (0).
    """
    level = max(a[0], b[0])
    x, y = coarser(a, level), coarser(b, level)
    if not len(x) and not len(y):
        return 1.0 if len(a[1]) == len(b[1]) else 0.0
    short = min(len(x), len(y))
    return float((x[:short] == y[:short]).sum()) / max(len(x), len(y))


def encode(fingerprint: tuple[int, np.ndarray]) -> str:
    level, samples = fingerprint
    return f"{level}:" + samples.tobytes().translate(_HEX).decode()


def decode(text: str) -> tuple[int, np.ndarray]:
    level, _, body = text.partition(":")
    return int(level), np.frombuffer(body.encode().translate(_UNHEX), np.uint8)


_HEX = bytes(b"0123456789abcdef"[i & 15] for i in range(256))
_UNHEX = bytes(int(chr(i), 16) if chr(i) in "0123456789abcdef" else 0 for i in range(256))


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many first ones of the next text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint``: one row per input row, whole texts, a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in utf8_slices(batches, 1, 32 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            marks = [encode(w) for w in walks([symbols(t) for t in texts])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(marks)], ["doc_id", "n_chars", "fingerprint"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _run_number(ident: Column, cuts: list[float]) -> Column:
    """How many of the ascending ``cuts`` are not below ``ident``, searched in two steps of about 64; the last run for a null."""
    if not cuts:
        return F.lit(0)
    chunks = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
    lasts = F.array(*(F.lit(c[-1]) for c in chunks))
    within = F.array(*(F.array(*map(F.lit, c)) for c in chunks))
    behind = F.array(*(F.lit(sum(map(len, chunks[k + 1 :]))) for k in range(len(chunks))))
    at = F.size(F.filter(lasts, lambda c: c < ident))
    found = F.size(F.filter(F.get(within, at), lambda c: c >= ident)) + F.get(behind, at)
    return F.when(ident.isNull(), len(cuts)).when(at >= len(chunks), 0).otherwise(found)


def _in_order(docs: DataFrame, chars_a_part: int) -> DataFrame:
    """``part, doc_id, text, copy``: documents in runs of descending id; each run ends with a copy of the document that follows
    it (after the last: the first). Only one row per run, of at most ``MAX_RUNS``, is looked at as a whole."""
    ids = docs.select("doc_id")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, min(MAX_RUNS, -(-chars // chars_a_part)))
    cuts = sorted(set(ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    numbered = docs.withColumn("part", _run_number(F.col("doc_id"), cuts).cast("int")).withColumn("h", F.xxhash64("text"))
    order = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "h")
    firsts = sorted((r["part"], r["first"]["doc_id"], r["first"]["h"]) for r in numbered.groupBy("part").agg(F.max(order).alias("first")).collect())
    # Each run's first document also ends the run before; that of the first run ends the last one.
    rows = [(p, d, h, firsts[k - 1][0]) for k, (p, d, h) in enumerate(firsts)]
    ends = docs.sparkSession.createDataFrame(rows, "part int, id long, h long, to int")
    runs = numbered.select("part", "doc_id", "text", F.lit(False).alias("copy"))
    copies = numbered.join(F.broadcast(ends), ["part", "h"]).where(F.col("doc_id").eqNullSafe(F.col("id"))).dropDuplicates(["part"])
    runs = runs.union(copies.select("to", "doc_id", "text", F.lit(True)))
    runs = runs.repartitionById(parts, F.col("part"))  # a task per run, where a hash would put several into one
    return runs.sortWithinPartitions("part", "copy", F.desc_nulls_last("doc_id"), F.xxhash64("text").desc())


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_a_part: int = 16_000_000) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``: one row per input row.

    The next document is the one with the next smaller id; after the smallest id comes the greatest. The
    edited text replaces a document's last half by the beginning of the next one. Texts move once, into
    runs of descending ids; a task streams through its runs.

    Edge cases: a null text is empty; null ids come after all others; rows that repeat an id follow each other by
    the hash of their text; a single document is its own next one; an empty table gives an empty table;
    only the two named columns are read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int | None, str, bool]] = []

        def done(rows: list[tuple[int, int | None, str, bool]]) -> pa.RecordBatch | None:
            own = [symbols(r[2]) for r in rows]
            pairs = [(k, edited(r[2], rows[k + 1][2])) for k, r in enumerate(rows) if not r[3] and k + 1 < len(rows)]
            marks = walks([*own, *(symbols(t) for _, t in pairs)])
            table = []
            for n, (k, text) in enumerate(pairs):
                mark, changed = marks[k], marks[len(rows) + n]
                table.append((rows[k][1], len(rows[k][2]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), encode(mark), encode(changed), likeness(mark, changed), likeness(mark, marks[k + 1])))
            if not table:
                return None
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in utf8_slices(batches, 2, 24 << 20):
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if (out := done(held)) is not None:
                yield out
            held = [] if held[-1][3] else held[-1:]

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(texts, chars_a_part).select("part", "doc_id", "text", "copy").mapInArrow(run, schema)


def bands(fingerprint: str, count: int = 16, width: int = 6, later: int = 8) -> list[str]:
    """Bit-sampled band keys over the whole of each of the two coarser views of a fingerprint, so that texts of neighbouring levels meet.

    A view is cut into stretches of ``SAMPLES / 2`` steps, which are shared by all texts that reach so far. The first gives ``count`` tuples of ``width``
    samples at shared places, each other one ``later``: texts that differ in one part meet by another. Of the last, shorter stretch only the
    tuples count whose places it has. A text shorter than a band is one key.
    """
    mark, span = decode(fingerprint), SAMPLES // 2
    keys = []
    for level in (mark[0], mark[0] + 1):
        view = coarser(mark, level)
        if len(view) < width:
            keys.append(f"{level}|{view.tobytes().hex()}")
            continue
        for start in range(0, len(view), span):
            stretch = view[start : start + span]
            for b in range(later if start else count):
                draws = _mixed(np.arange(b * width, (b + 1) * width, dtype=np.uint64) ^ np.uint64(level + 77 + 1000 * start))
                places = np.sort((draws % np.uint64(span if start else max(width, len(stretch)))).astype(np.int64))
                if places[-1] < len(stretch):
                    keys.append(f"{level}|{start}|{b}|{stretch[places].tobytes().hex()}")
    return keys


@cache
def _places(level: int, start: int, span: int, count: int, width: int) -> np.ndarray:
    """The places of the bands of a stretch, one row a band, ascending: a draw is shared by all texts of a level that reach so far."""
    draws = _mixed(np.arange(count * width, dtype=np.uint64) ^ np.uint64(level + 77 + 1000 * start))
    return np.sort((draws % np.uint64(span)).astype(np.int64).reshape(count, width), axis=1)


def band_numbers(mark: tuple[int, np.ndarray], count: int = 16, width: int = 6, later: int = 8) -> np.ndarray:
    """``bands`` as numbers, equal where the keys are equal: level, stretch, band and samples of four bits each have their own bits."""
    span, powers, found = SAMPLES // 2, 16 ** np.arange(width, dtype=np.int64), []
    for level in (mark[0], mark[0] + 1):
        view = coarser(mark, level).astype(np.int64)
        if len(view) < width:
            found.append(np.array([1 << 62 | level << 56 | len(view) << 32 | int((view * powers[: len(view)]).sum())]))
            continue
        for start in range(0, len(view), span):
            stretch = view[start : start + span]
            places = _places(level, start, span if start else max(width, len(stretch)), later if start else count, width)
            fits = np.flatnonzero(places[:, -1] < len(stretch))
            found.append((level << 56 | start // span << 40) + (fits << 32) + stretch[places[fits]] @ powers)
    return np.unique(np.concatenate(found))


#: Words of 16 samples in a sketch.
_WORDS = 8
_SKETCH = "own int, n int, coarser_n int, " + ", ".join(f"s{k} long" for k in range(_WORDS))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows a fingerprint, one for each level of its bands: its own level, the samples of its own and of its next level, and the first samples at the row's level."""
    for batch in batches:
        ids, levels, own, n, coarser_n, heads = [], [], [], [], [], []
        for ident, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            mark = decode(text)
            views = [mark[1], coarser(mark, mark[0] + 1)]
            for up, view in enumerate(views):
                head = np.zeros(16 * _WORDS, np.uint8)
                head[: min(len(head), len(view))] = view[: len(head)]
                heads.append(head[::2] | head[1::2] << 4)
                for column, value in ((ids, ident), (levels, mark[0] + up), (own, mark[0]), (n, len(views[0])), (coarser_n, len(views[1]))):
                    column.append(value)
        if ids:
            words = np.stack(heads).view(np.int64)
            columns = [pa.array(ids, pa.int64()), *(pa.array(c, pa.int32()) for c in (levels, own, n, coarser_n)), *(pa.array(words[:, k]) for k in range(_WORDS))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "level", "own", "n", "coarser_n", *(f"s{k}" for k in range(_WORDS))])


def _may_be_alike(x: str, y: str, least: float) -> Column:
    """False only where sketches of two documents at one level rule out a ``likeness`` of ``least``; documents without a sketch may always be alike.

    Likeness asks that, of the samples of the longer, at most a share of ``1 - least`` be unequal or beyond the shorter. The samples of a coarser level are among
    those of the level that counts, in the same steps, so what differs among their first, the longer's beyond the shorter's included, is no more than that.
    """
    at = lambda c, d: F.col(f"{c}_{d}")
    counted = F.greatest(at("own", x), at("own", y))
    n = [F.when(at("own", d) == counted, at("n", d)).otherwise(at("coarser_n", d)) for d in (x, y)]
    most, apart = F.greatest(*n), F.lit(0)
    for k in range(_WORDS):
        differs = at(f"s{k}", x).bitwiseXOR(at(f"s{k}", y))
        for step in (1, 2):
            differs = differs.bitwiseOR(F.shiftrightunsigned(differs, step))
        apart = apart + F.bit_count(differs.bitwiseAND(F.lit(0x1111111111111111)))
    return F.coalesce((F.least(*n) >= F.lit(least) * most - 1e-6) & (apart <= F.lit(1 - least) * most + 1e-6), F.lit(True))


def edit_groups(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, group_id``: near copies by fingerprint. Documents that share a band key link when their ``likeness`` is
    at least ``least``; groups follow links.

    Pairs that their sketches rule out (``_may_be_alike``) are not compared. Members of a key are first held against its leader (the smallest id), one comparison each. Then all pairs of
    a key whose documents are not in one group by now are tested, so no link that a key offers is lost. Rows that
    repeat an id link by any of their texts. Null ids get a null group.
    """
    marks = materialize(fingerprints(docs, id_col, text_col).select("doc_id", "fingerprint").where("doc_id IS NOT NULL").distinct(), "fingerprints")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_numbers(decode(f)) for f in batch.column(1).to_pylist()]
            if keys:
                docs_ = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(docs_), pa.array(np.concatenate(keys))], ["doc_id", "key"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [likeness(decode(p), decode(q)) >= least for p, q in zip(*(batch.column(k).to_pylist() for k in (2, 3)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def linked(pairs: DataFrame) -> DataFrame:
        x, y = (marks.select(F.col("doc_id").alias(c), F.col("fingerprint").alias(f"mark_{c}")) for c in "ab")
        return materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "mark_a", "mark_b").mapInArrow(alike, "a long, b long"), "edit-links")

    def pair(left: str, right: str) -> list[Column]:
        return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]

    level = F.shiftright("key", 56).bitwiseAND(F.lit(63)).cast("int").alias("level")
    several = marks.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("several"))
    sketched = marks.join(several, "doc_id", "left_anti").mapInArrow(_sketches, f"doc_id long, level int, {_SKETCH}")
    sketched = materialize(sketched.unionByName(several.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("level")), allowMissingColumns=True), "sketches")

    def sketch(rows: DataFrame, ident: str) -> DataFrame:
        """``rows`` with the sketch of a document at a key's level, its columns behind the document's name."""
        return rows.join(sketched.select(F.col("doc_id").alias(ident), "level", *(F.col(c).alias(f"{c}_{ident}") for c in sketched.columns[2:])), [ident, "level"])

    rows = materialize(marks.mapInArrow(keyed, "doc_id long, key long").distinct(), "band-keys")
    # Keys of one document pair nobody.
    led = materialize(attach_group(rows, ["key"], "doc_id", [F.min("doc_id").alias("leader"), F.count("*").alias("n")], having=F.col("n") > 1).drop("n"), "shared-keys")
    star = sketch(sketch(led.where("doc_id <> leader").select("doc_id", "leader", level).distinct(), "doc_id"), "leader")
    star = materialize(star.where(_may_be_alike("doc_id", "leader", least)).select(*pair("doc_id", "leader")).distinct(), "leader-pairs")
    direct = linked(star)

    # What is left: pairs across components. Keys that are one component by now hold none.
    named = led.select("doc_id", "key").join(connected_components(direct).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    parts = named.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("k")).where("k > 1").select("key", "main")
    open_keys = materialize(sketch(named.join(mixed, "key").select("key", "main", "root", F.col("doc_id").alias("x"), level), "x"), "open-keys").drop("level")
    open_keys = open_keys.withColumnRenamed("root", "root_x")
    everyone = open_keys.select(*(F.col(c).alias(c.removesuffix("x") + "y" if c.endswith("x") else c) for c in open_keys.columns if c != "main"))
    others = open_keys.where("root_x <> main").drop("main")
    # Most pairs of a key are unlike: their sketches say so where they meet, before a pair becomes a row that moves.
    met = others.join(everyone, "key").where("root_x <> root_y").where(_may_be_alike("x", "y", least))
    rest = met.select(*pair("x", "y")).distinct().join(star, ["a", "b"], "left_anti")
    roots = connected_components(direct.union(linked(materialize(rest, "cross-pairs"))))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id")).join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    found = attach_group(named.where("root IS NOT NULL"), ["root"], "doc_id", [F.min("doc_id").alias("group_id")]).select("doc_id", "group_id")
    return found.union(named.where("root IS NULL").select("doc_id", F.lit(None).cast("long").alias("group_id")))
