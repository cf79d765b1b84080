"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Documents become sorted arrays of 64-bit shingle hashes. A tile holds the documents that share one of
their first shingles in a global order (common shingles last) and whose set sizes lie in the band that
the threshold allows. Inside a tile pairs are bounded from above, first by the shingle's positions, then
by the bit counts of the bitmap signatures; what is left is decided by intersecting the sorted arrays.

No tile is expanded into all its pairs while that can be told to be needless: first every member is held
against the tile's leader; after that only pairs between different components are left to test, and a
tile whose members are already one component is done.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import attach_group, materialize, release, salts_of, utf8_slices, without_ids
from cairn.llm.components import connected_components

#: A-Z to a-z, other bytes unchanged.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS_KEPT = 250_000
#: Shingles in more first-places than this are ordered last; of those at most so many, the most frequent
#: ones. Only speed depends on either: any global order finds the same links.
HOT_DF, HOT_LIMIT = 64, 300_000
#: Bits of the Bloom filter that tells which documents a second scan must turn into arrays; a full filter costs time only.
BLOOM_BITS = 1 << 26


class _WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts: Iterable[str | None], width: int, ids: _WordIds) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than ``width`` words make one shingle."""
    words, ends = [], [0]
    for text in texts:
        if text:
            words += text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        ends.append(len(words))
    hashed = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):

        def fold(parts: list[np.ndarray], count: int) -> np.ndarray:
            h = np.full(len(parts[0]), count + 1, np.uint64)
            for part in parts:
                h = (h ^ (h >> np.uint64(29)) ^ part) * _MIX
                h = (h << np.uint64(23)) | (h >> np.uint64(41))
            return (h ^ (h >> np.uint64(32))) * _MIX

        whole = len(hashed) - width + 1
        rolled = fold([hashed[k : k + whole] for k in range(width)], width) if whole > 0 else np.empty(0, np.uint64)
        sets = []
        for start, end in zip(ends, ends[1:], strict=False):
            if end == start:
                sets.append(np.empty(0, np.uint64))
            elif end - start < width:
                sets.append(fold([hashed[k : k + 1] for k in range(start, end)], end - start))
            else:
                found = np.sort(rolled[start : end - width + 1])
                sets.append(found[np.r_[True, found[1:] != found[:-1]]])
    return sets


def needed(size: int, percent: int) -> int:
    """The least overlap with any partner: ``percent`` of the set's own size, rounded up."""
    return -(-percent * size // 100)


def first_ones(size: int, percent: int) -> int:
    """So many shingles, the first in any one order, hold one that every partner has among its first."""
    return size - needed(size, percent) + 1


def stored_ones(size: int, percent: int) -> int:
    """So many are kept by the scan: a margin replaces common ones that move back in the order."""
    first = first_ones(size, percent)
    return min(size, first + first // 4 + 16)


def bitmap(tokens: np.ndarray) -> bytes:
    """A bitmap of the set with the power of two of bits that is at least four times its size."""
    bits = max(64, 1 << int(4 * len(tokens) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def overlap_bound(size_a: int, bits_a: bytes, size_b: int, bits_b: bytes) -> int:
    """No less than the size of the intersection: every bit that one side lacks is an element it lacks."""
    a, b = np.frombuffer(bits_a, np.uint64), np.frombuffer(bits_b, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(size_a - int(np.bitwise_count(a & ~b).sum()), size_b - int(np.bitwise_count(b & ~a).sum()))


def _order(tokens: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens in the global order (hot ones last, by rank), and how many are not hot."""
    if not len(hot):
        return tokens, len(tokens)
    at = np.searchsorted(hot, tokens)
    at[at == len(hot)] = 0
    is_hot = hot[at] == tokens
    late = tokens[is_hot][np.argsort(rank[at[is_hot]], kind="stable")]
    return np.r_[tokens[~is_hot], late], len(tokens) - len(late)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _set_id(tokens: np.ndarray) -> tuple[int, int]:
    digest = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64)
    return int(digest[0]), int(digest[1])


class _Once:
    """Which keys this task has met; forgets all when full, as a repeat does no harm."""

    def __init__(self, most: int = 200_000):
        self.seen: set = set()
        self.most = most

    def __call__(self, key) -> bool:
        if key in self.seen:
            return False
        if len(self.seen) >= self.most:
            self.seen.clear()
        self.seen.add(key)
        return True


def _hot_tokens(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``limit`` most frequent tokens, sorted, each with its rank from rare to frequent."""
    table = counts.where(F.col("n") > HOT_DF).orderBy(F.desc("n"), "token").limit(limit).toArrow()
    tokens = table["token"].to_numpy().view(np.uint64)
    rank = np.lexsort((tokens, table["n"].to_numpy()))
    place = np.empty(len(tokens), np.int32)
    place[rank] = np.arange(len(tokens))
    order = np.argsort(tokens)
    return tokens[order], place[order]


def _bloom(ids: DataFrame, name: str) -> np.ndarray:
    """A Bloom filter of the ids; at most ``BLOOM_BITS / 64`` words are collected."""
    spots = ids.select(F.explode(_id_spots(name)).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 AS int))")).alias("bits"))
    table, out = words.toArrow(), np.zeros(BLOOM_BITS // 64, np.int64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return out


def _id_spots(name: str) -> Column:
    return F.array(*(F.pmod(F.xxhash64(name, F.lit(k)), F.lit(BLOOM_BITS)) for k in range(3))).alias("spots")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All shingles of ``set`` columns."""
    for batch in _slices(batches, 256):
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]))], ["token"])


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def _ordered(heads: pa.RecordBatch, order: tuple[np.ndarray, np.ndarray], percent: int) -> Iterator[tuple]:
    """``(id, size, first shingles)`` by ``(id, size, head)``; None where the head does not hold them all."""
    flat, ends = heads.column(2).flatten().to_numpy().view(np.uint64), np.cumsum(pa.compute.list_value_length(heads.column(2)).to_numpy())
    for sid, size, start, end in zip(heads.column(0).to_pylist(), heads.column(1).to_pylist(), [0, *ends], ends, strict=False):
        tokens, cold = _order(flat[start:end], *order)
        first = first_ones(size, percent)
        yield sid, size, None if cold < first and end - start < size else tokens[:first]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    ends = np.r_[0, np.cumsum([len(r[2]) for r in rows])].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate([r[2] for r in rows]) if rows else np.empty(0, np.uint64)))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), lists], ["sid", "size", "tokens"])


class _Join:
    """The settings of one join and the steps that read texts or arrays."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int):
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.width, self.percent = width, percent

    def features(self) -> DataFrame:
        """One row per document: ``doc_id, hi, lo, n, bits, head, row``, in one scan of the texts.

        ``hi, lo`` identify the set by 128 bits. ``head`` (the first shingles by hash) and ``bits`` are null where the task
        has met the set before, and where it is empty.
        """
        width, percent = self.width, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, once = _WordIds(), _Once()
            for batch in utf8_slices(batches, 1, 4 << 20):
                sets = shingle_sets(batch.column(1).to_pylist(), width, ids)
                names = [_set_id(s) for s in sets]
                fresh = [len(s) > 0 and once(name) for s, name in zip(sets, names, strict=True)]
                heads = [s[: stored_ones(len(s), percent)] if f else s[:0] for s, f in zip(sets, fresh, strict=True)]
                ends = np.r_[0, np.cumsum([len(h) for h in heads])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate(heads)), mask=pa.array([not f for f in fresh]))
                bits = pa.array([bitmap(s) if f else None for s, f in zip(sets, fresh, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in names], pa.int64()) for k in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), bits, lists], ["doc_id", "hi", "lo", "n", "bits", "head"])

        found = self.texts.mapInArrow(run, "doc_id long, hi long, lo long, n long, bits binary, head array<long>")
        return materialize(found.withColumn("row", F.monotonically_increasing_id()), "shingle-features")

    def arrays(self, wanted: DataFrame) -> DataFrame:
        """``sid, n, set`` of the sets ``wanted(sid, hi, lo, least)``: their texts are found by the id ``least`` of a document that has them.

        The filter of ids spares most texts; texts that it lets pass by mistake cost time only.
        """
        bloom, width = self.texts.sparkSession.sparkContext.broadcast(_bloom(wanted, "least")), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, once = _WordIds(), _Once()
            for batch in batches:
                spot = batch.column(2).flatten().to_numpy().reshape(-1, 3)
                hit = np.ones(len(spot), bool)
                for k in range(3):
                    hit &= ((bloom.value[spot[:, k] >> 6] >> (spot[:, k] & 63)) & 1).astype(bool)
                for part in utf8_slices(iter([batch.filter(pa.array(hit))]), 1, 4 << 20):
                    sets = [s for s in shingle_sets(part.column(1).to_pylist(), width, ids) if len(s)]
                    found = [(*name, len(s), s.tobytes()) for s in sets if once(name := _set_id(s))]
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["hi", "lo", "n", "set"])

        seen = self.texts.where("doc_id IS NOT NULL").select("doc_id", "text", _id_spots("doc_id")).mapInArrow(run, "hi long, lo long, n long, set binary")
        return seen.join(wanted.select("sid", "hi", "lo"), ["hi", "lo"]).dropDuplicates(["sid"]).select("sid", "n", "set")

    def tile_rows(self, feats: DataFrame, sets: DataFrame) -> DataFrame:
        """``token, sid, size, pos``: the first shingles of every set, in the global order, that may be another set's too."""
        heads = feats.where("head IS NOT NULL").select("row", "n", "head")
        counts = heads.select(F.explode("head").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        counts = materialize(counts.where("n > 1"), "shingle-counts")
        # Sets with many common shingles show others than their heads: count those too before the order is final.
        seen = self.whole_sets(self.short(heads, sets, self.order(counts)), sets)
        wider = seen.mapInArrow(_tokens, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > HOT_DF)
        order = self.order(counts.union(wider).groupBy("token").agg(F.max("n").alias("n")))
        short = self.short(heads, sets, order)
        more = self.whole_sets(short.join(seen.select("sid"), "sid", "left_anti"), sets)

        percent, schema = self.percent, "sid long, size long, tokens array<long>"

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _packed([(sid, size, tokens) for sid, size, tokens in _ordered(batch, order.value, percent) if tokens is not None])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches, 256):
                sets = (np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2))
                yield _packed([(sid, size, _order(s, *order.value)[0][: first_ones(size, percent)]) for sid, size, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets, strict=True)])

        late = materialize(seen.union(more).join(short, "sid", "left_semi").select("sid", "n", "set").mapInArrow(whole, schema), "late-prefixes")
        own = heads.join(sets.select("sid"), F.col("row") == F.col("sid"), "left_semi").mapInArrow(prefixes, schema)
        # A shingle that only one head has can still be among the first of a set that was ordered anew.
        shared = materialize(counts.select("token").union(late.select(F.explode("tokens").alias("token"))).distinct(), "shared-shingles")
        rows = own.union(late).select("sid", "size", F.posexplode("tokens").alias("pos", "token"))
        places = materialize(rows.join(shared.hint("merge"), "token", "left_semi").select("token", "sid", "size", "pos"), "tile-rows")
        release(counts, seen, short, more, late, shared)
        return places

    def order(self, counts: DataFrame):
        """The global order, for all tasks: the common shingles that come last, with their ranks."""
        return self.texts.sparkSession.sparkContext.broadcast(_hot_tokens(counts, HOT_LIMIT))

    def short(self, heads: DataFrame, sets: DataFrame, order) -> DataFrame:
        """``sid`` of the sets whose heads lack shingles that are among their first in this order."""
        percent = self.percent

        def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([sid for sid, _, tokens in _ordered(batch, order.value, percent) if tokens is None], pa.int64())], ["sid"])

        return materialize(heads.mapInArrow(lacking, "sid long").join(sets.select("sid"), "sid", "left_semi"), "short-heads")

    def whole_sets(self, chosen: DataFrame, sets: DataFrame) -> DataFrame:
        """``sid, n, set`` of the chosen sets, read from their texts."""
        wanted = materialize(sets.join(chosen, "sid", "left_semi").select("sid", "hi", "lo", "least"), "wanted-sets")
        found = self.texts.sparkSession.createDataFrame([], "sid long, n long, set binary") if wanted.isEmpty() else self.arrays(wanted)
        found = materialize(found, "shingle-arrays")
        release(wanted)
        return found

    def close(self, left: DataFrame, a: str, b: str) -> DataFrame:
        """Pairs within the size band whose overlap can still reach the threshold, given the token's positions."""
        sizes, percent = [F.col(f"{x}.size") for x in (a, b)], self.percent
        band = F.least(*sizes) * 100 >= F.greatest(*sizes) * percent
        most = F.least(*(F.col(f"{x}.size") - F.col(f"{x}.pos") for x in (a, b)))
        return left.where(band & (most * (100 + percent) >= percent * (sizes[0] + sizes[1]))).select(F.least(F.col(f"{a}.sid"), F.col(f"{b}.sid")).alias("a"), F.greatest(F.col(f"{a}.sid"), F.col(f"{b}.sid")).alias("b")).distinct()

    def links(self, feats: DataFrame, sets: DataFrame) -> DataFrame:
        places = self.tile_rows(feats, sets)
        # Two leaders: the member with the tile's shingle first, as few of its shingles are rarer and it is near what the members
        # have in common; and one that each tile draws by hash among the early ones, so that a document meets several.
        member = F.struct("sid", "size", "pos")
        first = F.min(F.struct("pos", "sid", "size")).alias("first")
        drawn = F.min(F.struct(F.floor(F.col("pos") / 4).alias("early"), F.xxhash64("sid", "token").alias("h"), "sid", "size", "pos")).alias("drawn")
        led = attach_group(places, ["token"], "sid", [first, drawn])
        leader = F.explode(F.array(*(F.struct(F.col(f"{c}.sid").alias("sid"), F.col(f"{c}.size").alias("size"), F.col(f"{c}.pos").alias("pos")) for c in ("first", "drawn"))))
        star = materialize(self.close(led.select(member.alias("x"), leader.alias("leader")).where("x.sid <> leader.sid"), "x", "leader"), "leader-pairs")
        direct = self.verified(star, feats, sets)

        # What is left: pairs across components. Tiles that are one component by now hold none.
        roots = connected_components(direct)
        named = places.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        parts = named.groupBy("token", "root").agg(F.count("*").alias("n"))
        mixed = parts.groupBy("token").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("k")).where("k > 1").select("token", "main")
        mixed = materialize(mixed, "mixed-tiles")
        open_tiles = materialize(named.join(mixed, "token"), "open-tiles")
        release(places, mixed)
        everyone = open_tiles.select("token", F.col("root").alias("root_y"), member.alias("y"))
        others = open_tiles.where("root <> main").select("token", F.col("root").alias("root_x"), member.alias("x"))
        rest = materialize(self.close(others.join(everyone, "token").where("root_x <> root_y"), "x", "y").join(star, ["a", "b"], "left_anti"), "cross-pairs")
        release(open_tiles, star)
        return direct.union(self.verified(rest, feats, sets))

    def verified(self, pairs: DataFrame, feats: DataFrame, sets: DataFrame) -> DataFrame:
        """Of the candidate pairs those that link: bit counts first, then the sorted arrays."""
        percent = self.percent

        def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches, 512):
                size_a, bits_a, size_b, bits_b = (batch.column(k).to_pylist() for k in range(2, 6))
                keep = [overlap_bound(m, x, n, y) * (100 + percent) >= percent * (m + n) for m, x, n, y in zip(size_a, bits_a, size_b, bits_b, strict=True)]
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        def intersected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches, 512):
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    if len(p) > len(q):
                        p, q = q, p
                    at = np.searchsorted(q, p)
                    at[at == len(q)] = 0
                    same = int((q[at] == p).sum())
                    keep.append(100 * same >= percent * (len(p) + len(q) - same))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        def side(table: DataFrame, name: str, *values: str) -> DataFrame:
            return table.select(F.col("sid").alias(name), *(F.col(v).alias(f"{v}_{name}") for v in values))

        both = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        signs = materialize(feats.where("head IS NOT NULL").select(F.col("row").alias("sid"), "n", "bits").join(both, "sid", "left_semi"), "signatures")
        signed = pairs.join(side(signs, "a", "n", "bits"), "a").join(side(signs, "b", "n", "bits"), "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
        left = materialize(signed.mapInArrow(bounded, "a long, b long"), "bounded-pairs")
        release(signs)
        if left.isEmpty():
            return left
        found = self.whole_sets(left.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), sets)
        full = left.join(side(found, "a", "set"), "a").join(side(found, "b", "set"), "b").select("a", "b", "set_a", "set_b")
        links = materialize(full.mapInArrow(intersected, "a long, b long"), "links")
        release(found, left)
        return links


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, sets, links)``: ``rows(doc_id, hi, lo, n, row, ...)`` for every row of ``docs``, ``sets(hi, lo, sid, least, salts)``
    for every distinct set that is not empty (``least`` is the smallest id that has it), ``links(a, b)`` between set ids.

    The links join all sets that the threshold joins, directly or by way of others; pairs inside one
    component that were not needed to join it are not listed. Rows with a null id have no set in ``sets`` but
    by way of an equal text.
    """
    join = _Join(docs, id_col, text_col, width, percent)
    feats = join.features()
    salted = _named(feats).select("hi", "lo", "doc_id", _salt(feats), F.when(F.col("head").isNotNull(), F.col("row")).alias("row"))
    # A null id may come before the others of its set in a task and hold the head.
    holders = feats.where("head IS NOT NULL").groupBy("hi", "lo").agg(F.min("row").alias("sid"))
    sets = salted.groupBy("hi", "lo").agg(F.min("doc_id").alias("least"), F.collect_set("salt").alias("salts"))
    sets = materialize(sets.join(holders, ["hi", "lo"]), "shingle-sets")
    return feats, sets, join.links(feats, sets)


def _salt(feats: DataFrame) -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(salts_of(feats.sparkSession))).cast("int").alias("salt")


def _named(feats: DataFrame) -> DataFrame:
    return feats.where("doc_id IS NOT NULL AND n > 0")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set holds its distinct
    ``width``-word shingles (the whole sequence where there are fewer words), compared by 64-bit hash. Two
    documents link when ``100 * intersection >= percent * union``; ``component_id`` is the smallest id
    that links lead to.

    Edge cases: a document without words (null or blank text) has ``n_shingles`` 0 and is its own component;
    a row with a null id takes no part in the join and gets its own count and a null component; rows that repeat an id
    are separate members of that id (equal texts are linked anyway); an empty table gives an empty table;
    only the two named columns are read.
    """
    feats, sets, links = ngram_links(docs, id_col, text_col, width, percent)
    roots = connected_components(links).withColumnRenamed("node", "sid")
    rooted = sets.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    # A component, or the copies of one set, may be any share of all rows: the way back is salted twice.
    placed = attach_group(rooted.select("hi", "lo", "salts", "least", "sid", "root"), ["root"], "sid", [F.min("least").alias("component_id")])
    placed = placed.select("hi", "lo", F.explode("salts").alias("salt"), "component_id")
    named = _named(feats).select("doc_id", "n", "hi", "lo", _salt(feats)).join(placed, ["hi", "lo", "salt"])
    alone = feats.where("doc_id IS NULL OR n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return named.select("doc_id", "n", "component_id").union(alone).withColumnRenamed("n", "n_shingles")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id names their component: one document of each group.

    Rows with a null id stay. Rows that repeat an id and fall into different components stay if one of them names its component.
    """
    found = materialize(ngram_components(docs, id_col, text_col, width, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    return without_ids(docs, id_col, found)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
  FROM u x JOIN u y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM o JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b
  WHERE 100 * n_both >= 80 * (len(p.sh) + len(q.sh) - n_both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, (SELECT min(r.b) FROM r WHERE r.a = s.doc_id) AS component_id
FROM s
"""
