"""Mixing sources to target weights by Pfair scheduling.

Every source's documents form blocks. With weight ``w``, block ``j`` (from 1) is released at
``floor((j-1)/w)`` and due at ``ceil(j/w)``, in slots of one block; earliest deadline first over the released
blocks keeps every source within one block of ``w * t`` at all times. Weights are exact fractions, so this
holds however long a schedule is. When a source runs out, a new phase plans the others anew with their
weights scaled up. The slots of all blocks are dealt by one task, which streams a row per block and holds a
few numbers per source; documents then find their block by a join.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize


def rounded_shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Weights as whole slots of a period: at least one slot each, the rest by largest remainder."""
    total, period = sum(weights.values()), max(period, len(weights))
    spare = period - len(weights)
    exact = {s: 1 + spare * w / total for s, w in weights.items()} if any(w / total * period < 1 for w in weights.values()) else {s: w / total * period for s, w in weights.items()}
    shares = {s: math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (shares[s] - exact[s], s))[: period - sum(shares.values())]:
        shares[s] += 1
    return shares


def exact_shares(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the ratio of the weights, which are read as the decimals they print as."""
    parts = {s: Fraction(str(w)) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in parts.values()))
    return {s: int(x * scale) for s, x in parts.items()}


class _Sources:
    """Sources with their shares, greatest share first; ones that ran out are skipped in nearly constant time."""

    def __init__(self, shares: dict[str, int]):
        self.shares, self.total = dict(shares), sum(shares.values())
        self.order = sorted(shares, key=lambda s: (-shares[s], s))
        self.at = {s: k for k, s in enumerate(self.order)}
        self.next = list(range(len(self.order) + 1))

    def drop(self, source: str) -> None:
        self.total -= self.shares[source]
        self.next[self.at[source]] = self.at[source] + 1

    def alive(self, k: int) -> int:
        """The first place from ``k`` on whose source is left."""
        end = k
        while self.next[end] != end:
            end = self.next[end]
        while self.next[k] != end and k != end:
            self.next[k], k = end, self.next[k]
        return end


def _edf(sources: _Sources) -> Iterator[str]:
    """The source of every slot, without end: earliest deadline first over the released blocks.

    With ``q`` the sum of shares and ``a`` a source's share, block ``j`` is released at ``(j-1)*q // a`` and due at
    ``ceil(j*q / a)``. Ties go to the greater share, then by name. First blocks are all released at 0 and their
    order is that of ``sources``, so a phase touches only the sources that it serves.
    """
    q, order, shares = sources.total, sources.order, sources.shares
    waiting: list[tuple] = []
    ready: list[tuple] = []
    fresh = sources.alive(0)
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        first = None
        if fresh < len(order):
            a = shares[order[fresh]]
            first = (-(-q // a), -a, order[fresh], 1)
        if first and (not ready or first < ready[0]):
            _, minus, s, j = first
            fresh = sources.alive(fresh + 1)
        else:
            _, minus, s, j = heapq.heappop(ready)
        a = -minus
        heapq.heappush(waiting, (j * q // a, -(-(j + 1) * q // a), minus, s, j + 1))
        yield s
        t += 1


def edf_period(shares: dict[str, int]) -> list[str]:
    """The source of every slot of one period, which has as many slots as the shares sum to."""
    return list(islice(_edf(_Sources(shares)), sum(shares.values())))


def schedule(blocks: dict[str, int], weights: dict[str, float], period: int | None = None) -> Iterator[tuple[str, int, int]]:
    """``(source, block, slot)`` of all blocks, slot by slot.

    A new phase begins when a source runs out. With ``period`` the weights of a phase are rounded to whole slots of it.
    """
    left = {s: n for s, n in blocks.items() if n}
    sources = _Sources(exact_shares({s: weights[s] for s in left})) if left and not period else None
    done = dict.fromkeys(left, 0)
    slot = 0
    while left:
        for s in _edf(sources or _Sources(rounded_shares({s: weights[s] for s in left}, period))):
            yield s, done[s], slot
            slot += 1
            done[s] += 1
            if done[s] == left[s]:
                del left[s]
                if sources:
                    sources.drop(s)
                break


def mix_positions(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, block_docs: int = 16, period: int | None = None, seed: int = 11, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``doc_id, source, block, slot, position``: one row per input row; ``position`` is its place in the mix.

    ``weights`` by source; sources without an entry, and all without ``weights``, weigh the number of their
    documents to the power of ``alpha``. Documents of a source are shuffled by a hash of their id; a block is ``block_docs``
    consecutive ones. All rows are placed; when a source is used up, the others go on with their
    weights scaled up. Within a phase each source stays within one block of its share at every slot. ``period``
    rounds weights to whole slots of a period; without it they are exact.

    Ranks inside a source come from counts of hash buckets, so a source that holds most rows is ranked by
    many tasks.

    Edge cases: a null source is a source of its own (``source`` stays null); a null id is placed like any
    other; repeated rows are placed one after the other; weights that are not positive raise; an
    empty table gives an empty table; only the two named columns are read.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    keyed = keyed.withColumn("key", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit(""))))
    keyed = keyed.withColumn("h", F.xxhash64(F.coalesce("doc_id", F.lit(0).cast("long")), F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
    counts = materialize(keyed.groupBy("key", "bucket").agg(F.count("*").alias("n")), "source-buckets")
    given = {("1" + s if s is not None else "0"): w for s, w in (weights or {}).items()}
    if not all(w > 0 for w in given.values()):
        raise ValueError("weights must be positive")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[str, int] = {}
        for batch in batches:
            sizes.update(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        slots = schedule({k: -(-n // block_docs) for k, n in sizes.items()}, {k: float(given.get(k, n**alpha)) for k, n in sizes.items()}, period)
        while part := list(islice(slots, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "block", "slot"])

    sizes = counts.groupBy("key").agg(F.sum("n").alias("n")).repartition(1)
    plan = materialize(sizes.mapInArrow(deal, "key string, block long, slot long"), "mix-plan")

    before = F.sum("n").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("key", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("key", "bucket").orderBy(F.col("h"), F.col("doc_id"))) - 1
    ranked = keyed.withColumn("within", within).join(offsets, ["key", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block_docs).cast("long"))
    joined = ranked.join(plan, ["key", "block"])
    return joined.select("doc_id", "source", "block", "slot", (F.col("slot") * block_docs + F.col("rank") % block_docs).alias("position"))


def first_places(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **settings) -> DataFrame:
    """``__id, __source, __position``: the place in the mix of every id and source; of repeated rows the first one's."""
    places = mix_positions(docs, id_col=id_col, source_col=source_col, **settings)
    return places.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source")).agg(F.min("position").alias("__position"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **settings) -> DataFrame:
    """``docs`` with all their columns, in the order of the mix: ranges of positions per partition, sorted within.

    Rows that repeat an id and a source take the place of the first of them.
    """
    first = first_places(docs, id_col, source_col, **settings)
    mark = uuid.uuid4().hex  # no column of documents has it in its name
    first = first.select(*(F.col(c).alias(f"{c}_{mark}") for c in first.columns))
    same = docs[id_col].cast("long").eqNullSafe(first[f"__id_{mark}"]) & docs[source_col].cast("string").eqNullSafe(first[f"__source_{mark}"])
    return docs.join(first, same).orderBy(f"__position_{mark}").drop(*first.columns)
