"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Pieces are dealt at random over neighbourhoods of bounded size. In each neighbourhood a few islands evolve
packings of the same pieces, every island in its own task; a crossover injects whole well-filled bins of
one parent, removes the duplicates from the other, and puts displaced documents back by best fit. After
every epoch the elite of an island moves on to the next island of its neighbourhood. Bins of the best
packing that are full enough are final; the pieces of the others are dealt anew with those of other
neighbourhoods, until one bounded neighbourhood or a fixed number of rounds is left.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize, utf8_slices

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Places of an order that are counted together when ranges of it are dealt.
PLACES = 256


def _encoder(path: str):
    """``encode(text) -> ids`` as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them: a special token's string is its id.

    A ``.json`` file that has a ``.tiktoken`` twin with the same vocabulary is encoded by way of the
    twin, which gives the same ids in a third of the time; the tests hold both against each other.
    """
    import os

    twin = f"{path.removesuffix('.json')}.tiktoken"
    if path.endswith(".json") and os.path.exists(twin):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            with open(twin, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})
            return lambda text: own.encode(text, allowed_special="all")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda text: tok.encode(text, add_special_tokens=False).ids


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document: whole, or full pieces behind a shorter first one."""
    first = n_ids if n_ids <= capacity else n_ids % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n_ids, capacity))]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Encode whole texts, append ``separator``, cut documents longer than ``capacity``; one row per piece.

    ``keep_ids`` adds the column ``ids array<int>``; without it only the piece's CRC-32 travels on.
    ``carry`` names columns of ``docs`` whose strings every piece keeps.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in utf8_slices(batches, 1):
            rows: list[tuple] = []
            origin: list[int] = []
            for at, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ids = np.array([*(encoder(text) if text else ()), separator], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append((doc, k, start, length, zlib.crc32(part.tobytes()), part.astype(np.int32)))
                    origin.append(at)
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            if keep_ids:
                arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)]
            arrays += [batch.column(2 + k).take(pa.array(origin)) for k in range(len(carry))]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *carry])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).cast("string").alias(c) for c in carry))
    return texts.mapInArrow(encode, PIECE_SCHEMA + (", ids array<int>" if keep_ids else "") + "".join(f", `{c}` string" for c in carry))


class Packing:
    """Bins over the pieces of one neighbourhood: a list of index lists and what each has left."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.left: list[int] = []

    def best_fit(self, items: list[int]) -> None:
        """Put each item where it leaves the least room; ``levels`` has a bit for every room that some bin has."""
        rooms: dict[int, list[int]] = {}
        levels = 0
        for b, room in enumerate(self.left):
            if room:
                rooms.setdefault(room, []).append(b)
                levels |= 1 << room
        for i in items:
            size = self.sizes[i]
            fit = levels >> size
            if fit:
                room = size + (fit & -fit).bit_length() - 1
                b = rooms[room].pop()
                if not rooms[room]:
                    levels ^= 1 << room
                self.bins[b].append(i)
            else:
                room, b = self.capacity, len(self.bins)
                self.bins.append([i])
                self.left.append(room)
            self.left[b] = room = room - size
            if room:
                rooms.setdefault(room, []).append(b)
                levels |= 1 << room

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first; then the fuller the full bins (sum of squared fills), so that room gathers in few bins."""
        fill = self.capacity - np.array(self.left)
        return -len(self.bins), float((fill.astype(float) ** 2).sum())

    def labels(self) -> list[int]:
        out = [0] * len(self.sizes)
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out

    @classmethod
    def of(cls, sizes: list[int], capacity: int, labels) -> Packing:
        out = cls(sizes, capacity)
        groups: dict[int, list[int]] = {}
        for i, b in enumerate(labels):
            groups.setdefault(int(b), []).append(i)
        out.bins = list(groups.values())
        out.left = [capacity - sum(sizes[i] for i in g) for g in out.bins]
        return out


def crossover(a: Packing, b: Packing, rng: np.random.Generator) -> Packing:
    """Inject whole well-filled bins of ``a`` into ``b``; bins of ``b`` that lose an item dissolve, and
    their other items are displaced and put back by best fit, largest first."""
    room = np.array(a.left)
    full = np.flatnonzero(room <= max(np.quantile(room, 0.6), 0))
    chosen = full[rng.random(len(full)) < 0.5]
    taken = {i for k in chosen for i in a.bins[k]}
    child = Packing(a.sizes, a.capacity)
    displaced = []
    for k in chosen:
        child.bins.append(list(a.bins[k]))
        child.left.append(a.left[k])
    for items, left in zip(b.bins, b.left, strict=True):
        rest = [i for i in items if i not in taken]
        if len(rest) == len(items):
            child.bins.append(list(items))
            child.left.append(left)
        else:
            displaced += rest
    child.best_fit(sorted(displaced, key=lambda i: (-a.sizes[i], i)))
    return child


def mutate(p: Packing, rng: np.random.Generator) -> Packing:
    """Dissolve the emptiest bins and a few random ones, and put their items back by best fit."""
    room = np.array(p.left, float)
    gone = set(np.argsort(-room, kind="stable")[: max(1, len(room) // 20)].tolist()) | set(np.flatnonzero(rng.random(len(room)) < 0.03).tolist())
    child = Packing(p.sizes, p.capacity)
    displaced = []
    for k, items in enumerate(p.bins):
        if k in gone:
            displaced += items
        else:
            child.bins.append(list(items))
            child.left.append(p.left[k])
    child.best_fit(sorted(displaced, key=lambda i: (-p.sizes[i], i)))
    return child


def evolve(sizes: list[int], capacity: int, seed: int, immigrants: list, population: int, generations: int) -> list[int]:
    """One epoch of one island; gives the labels of its elite. Deterministic in its arguments.

    Stops early once no packing with fewer bins can exist (the total size rounded up to bins).
    """
    rng = np.random.default_rng(seed)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    people = [Packing.of(sizes, capacity, labels) for labels in immigrants if labels is not None]
    while len(people) < population:
        p = Packing(sizes, capacity)
        noisy = order if not people else sorted(range(len(sizes)), key=dict(enumerate((-np.array(sizes) * rng.uniform(0.85, 1.15, len(sizes))).tolist())).__getitem__)
        p.best_fit(noisy)
        people.append(p)
    bound = -(-sum(sizes) // capacity)
    people.sort(key=Packing.fitness, reverse=True)
    for _ in range(generations):
        if len(people[0].bins) <= bound:
            break
        i, j = rng.integers(0, max(2, population // 2)), rng.integers(0, population)
        child = crossover(people[i], people[j if j != i else (j + 1) % population], rng)
        if rng.random() < 0.5:
            child = mutate(child, rng)
        people[-1] = child
        people.sort(key=Packing.fitness, reverse=True)
    return people[0].labels()


def pack(pieces: DataFrame, capacity: int = 2048, neighbourhood: int = 4096, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 12, full: float = 0.99, rounds: int = 4, seed: int = 7, order_col: str | None = None) -> DataFrame:
    """Add ``sequence_id, offset`` to ``pieces`` (any columns, among them ``length`` from 1 to ``capacity``).

    ``sequence_id`` is unique per sequence; offsets are gapless from 0. A piece of full length is a sequence of
    its own and takes no part. A neighbourhood has about ``neighbourhood`` pieces, the bound of a task's
    memory; the number of neighbourhoods follows the input.

    With ``order_col``, a dense numbering of the documents such as their positions in a mix, neighbourhoods are
    contiguous ranges of it instead of random ones, and ``sequence_id`` ascends with the mean of a sequence's
    pieces in it. The column is not returned. Columns of ``pieces`` may have any names.
    """
    own = [c for c in pieces.columns if c != order_col]
    place = [F.col(f"`{order_col}`").cast("long").alias("__place")] if order_col else []
    plain = pieces.select(*(F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(own)), F.col("length").alias("length"), *place)
    pieces = materialize(plain.withColumn("__item", F.monotonically_increasing_id()), "pieces")
    names = [F.col(f"own_{k}").alias(c) for k, c in enumerate(own)]
    place = ["__place"] if order_col else []
    whole = pieces.where(F.col("length") >= capacity).select("__item", F.lit(-1).alias("__round"), F.lit(0).alias("__hood"), F.lit(0).alias("__bin"), F.col("__item").alias("__own"), F.lit(0).cast("long").alias("offset"))
    done = [whole]
    open_items = pieces.where(F.col("length") < capacity).select("__item", F.col("length").cast("int").alias("size"), *place)
    for turn in range(rounds):
        count = open_items.count()
        if not count:
            break
        hoods = max(1, -(-count // neighbourhood))
        last = hoods == 1 or turn == rounds - 1
        if order_col:
            dealt = materialize(_ranges(open_items, neighbourhood, seed + turn), "dealt")
        else:
            dealt = open_items.withColumn("hood", F.pmod(F.xxhash64("__item", F.lit(seed + turn)), F.lit(hoods)).cast("int"))
        packed = materialize(_islands(dealt, capacity, islands, epochs, population, generations, seed + 1000 * turn, 2.0 if last else full), "packed")
        sealed = packed.where("sealed").select("__item", F.lit(turn).alias("__round"), F.col("hood").alias("__hood"), F.col("bin").alias("__bin"), F.lit(0).cast("long").alias("__own"), F.col("offset"))
        done.append(sealed)
        open_items = packed.where("NOT sealed").select("__item", "size")
        if order_col:
            open_items = open_items.join(dealt.select("__item", "__place"), "__item")
        if last:
            break
    placed = done[0]
    for part in done[1:]:
        placed = placed.union(part)
    ident = F.when(F.col("__round") < 0, -1 - F.col("__own")).otherwise(F.col("__round") * F.lit(1 << 56).cast("long") + F.col("__hood") * F.lit(1 << 20).cast("long") + F.col("__bin"))
    if order_col:
        placed = materialize(placed, "placed")
        bins = ["__round", "__hood", "__bin", "__own"]
        means = pieces.select("__item", *place).join(placed, "__item").groupBy(*bins).agg(F.avg("__place").alias("__mean"))
        means = means.withColumn("__span", F.floor(F.col("__mean") / PLACES))
        nth = F.row_number().over(Window.partitionBy("__span").orderBy("__mean", *bins))
        numbers = means.select(*bins, (F.col("__span") * F.lit(1 << 32).cast("long") + nth).alias("sequence_id"))
        return pieces.join(placed.join(numbers, bins), "__item").select(*names, "sequence_id", "offset")
    joined = pieces.join(placed, "__item").withColumn("sequence_id", ident)
    return joined.select(*names, "sequence_id", "offset")


def _ranges(items: DataFrame, neighbourhood: int, seed: int) -> DataFrame:
    """``items`` with their ``hood``: contiguous ranges of ``__place`` of about ``neighbourhood`` items.

    Only counts of spans of ``PLACES`` places pass one task. A span that holds more than a neighbourhood, as when one
    place repeats, is split by hash.
    """
    spans = items.withColumn("__span", F.floor(F.col("__place") / PLACES))
    counts = spans.groupBy("__span").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__span", F.floor(before / neighbourhood).alias("first"), F.greatest(F.lit(1), F.floor(F.col("n") / neighbourhood)).alias("parts"))
    hood = F.col("first") + F.pmod(F.xxhash64("__item", F.lit(seed)), F.col("parts"))
    return spans.join(starts, "__span").select("__item", "size", "__place", hood.cast("int").alias("hood"))


def _islands(dealt: DataFrame, capacity: int, islands: int, epochs: int, population: int, generations: int, seed: int, full: float) -> DataFrame:
    """``(__item, size, hood, bin, offset, sealed)``: the islands of every neighbourhood, epoch by epoch."""
    state = dealt.groupBy("hood").agg(F.array_sort(F.collect_list(F.struct("__item", "size"))).alias("items"))
    state = state.withColumn("island", F.explode(F.array(*map(F.lit, range(islands))))).withColumn("elite", F.lit(None).cast("array<int>")).withColumn("guest", F.lit(None).cast("array<int>"))
    schema = "hood int, items array<struct<__item: long, size: int>>, island int, elite array<int>"

    def epoch_of(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                elites = []
                for row in frame.itertuples(index=False):
                    sizes = [int(x["size"]) for x in row.items]
                    key = seed + 101 * int(row.hood) + 11 * int(row.island) + number
                    elites.append(evolve(sizes, capacity, key, [row.elite, row.guest], population, generations))
                yield pd.DataFrame({"hood": frame.hood, "items": frame["items"], "island": frame.island, "elite": elites})

        return run

    for number in range(epochs):
        spread = state.repartition("hood", "island")
        state = spread.mapInPandas(epoch_of(number), schema)
        if number < epochs - 1:
            state = materialize(state, "islands")
            moved = state.select("hood", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guest"))
            state = state.join(moved, ["hood", "island"])
    use = F.size(F.array_distinct("elite"))
    best = state.groupBy("hood").agg(F.min_by(F.struct("items", "elite"), F.struct(use, F.col("island"))).alias("best"))
    rows = best.select("hood", F.explode(F.arrays_zip(F.col("best.items").alias("item"), F.col("best.elite").alias("bin"))).alias("x")).select("hood", "x.item.__item", "x.item.size", "x.bin")
    bins = rows.groupBy("hood", "bin").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("by"), F.col("__item"), F.col("size")))).alias("members"))
    fill = F.aggregate("members", F.lit(0), lambda a, m: a + m["size"])
    placed = bins.withColumn("sealed", (fill >= F.lit(full * capacity)) if full <= 1 else F.lit(True))
    starts = F.transform("members", lambda m, i: F.struct(m["__item"].alias("__item"), m["size"].alias("size"), F.aggregate(F.slice("members", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("offset")))
    return placed.select("hood", "bin", "sealed", F.explode(starts).alias("m")).select("m.__item", "m.size", "hood", "bin", "m.offset", "sealed")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, **settings) -> DataFrame:
    """Encode, cut and pack whole documents: ``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``.

    Edge cases: a null or empty text is the separator alone; a null id is carried along; rows that repeat
    an id or a text are packed each for itself; documents longer than ``capacity`` are cut, the first piece
    being the shorter one; an empty table gives an empty table; only the two named columns are read.
    """
    return pack(token_pieces(docs, vocabulary, capacity, separator, id_col, text_col, keep_ids), capacity, **settings)
