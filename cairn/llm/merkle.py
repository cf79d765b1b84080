"""Merkle manifests of a dataset by cogrouped subtree exchange.

Leaves are hashed by SQL functions and numbered within their language. A superblock is a run of ``BLOCK`` leaves; its
top is all that others need of it. The tops form a tree of the same kind, so the same step, applied again to ever fewer nodes,
gives each superblock its outer nodes. Then leaves and outer nodes are cogrouped by superblock: one call finishes
the local reduction, joins the proofs and folds them. No task holds more than a superblock and its outer nodes.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize, numbered

#: Children of a node, levels that a superblock reduces, leaves of a superblock.
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(size: int) -> int:
    """Levels above ``size`` nodes."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


def climb(hashes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from the given ones to those ``levels`` above."""
    every = [hashes]
    for _ in range(levels):
        last = every[-1]
        every.append([digest("".join(last[i : i + FAN])) for i in range(0, len(last), FAN)])
    return every


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """Left and right siblings (joined) of node ``at``, level by level below the top: two entries a level."""
    path = []
    for nodes in levels[:-1]:
        start = at - at % FAN
        path += ["".join(nodes[start:at]), "".join(nodes[at + 1 : start + FAN])]
        at //= FAN
    return path


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        leaf = digest(left + leaf + right)
    return leaf


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 of ``byte count:value`` of each field, ``-`` for a null one."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*told), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``g, pos, size, doc_id, lang, leaf, tampered``: one row per input row, placed within its language; ``tampered`` is
    the leaf of the lower-cased text where 3 divides the id's crc32, else null. ``g`` orders languages (null first, bytewise)."""
    text = F.col("text").cast("string")
    fields = [F.col(c) for c in FIELDS[:-1]]
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 0
    lang = F.col("lang").cast("string")
    group = F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang))
    rows = docs.select(group.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest([*fields, text]).alias("leaf"), F.when(hit, leaf_digest([*fields, lower])).alias("tampered"), F.monotonically_increasing_id().alias("row"))
    # Written before it is dealt by ranges, which looks at its input twice: texts are read and hashed once.
    return numbered(materialize(rows, "leaves"), "g", ["doc_id", "leaf", "row"], "placed-leaves")


def tops(nodes: DataFrame) -> DataFrame:
    """``g, pos, size, hash``: the top of every superblock of ``nodes(g, pos, size, hash)``, as nodes of the tree above."""

    def reduce(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        size = int(frame["size"].iloc[0])
        top = climb(frame.sort_values("pos")["hash"].tolist(), min(LEVELS, depth(size)))[-1]
        return pd.DataFrame({"g": [key[0]], "pos": [key[1]], "size": [-(-size // BLOCK)], "hash": top})

    blocks = nodes.select("g", "pos", "size", "hash").groupBy("g", F.expr(f"pos div {BLOCK}").alias("block"))
    return materialize(blocks.applyInPandas(reduce, "g string, pos long, size long, hash string"), "superblocks")


def exchange(nodes: DataFrame, outer: DataFrame, finish: Callable[[pd.DataFrame, list[list[str]], pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """Cogroup ``nodes(g, pos, size, hash, ...)`` and the outer nodes ``outer(g, pos, ...)`` by superblock; ``finish`` gets the
    superblock's nodes in order, the levels of its local reduction and its outer row."""

    def join(key: tuple, inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos")
        levels = climb(inner["hash"].tolist(), min(LEVELS, depth(int(inner["size"].iloc[0]))))
        return finish(inner, levels, above.iloc[0])

    left = nodes.groupBy("g", F.expr(f"pos div {BLOCK}").alias("block"))
    return left.cogroup(outer.groupBy("g", F.col("pos").alias("block"))).applyInPandas(join, schema)


def paths(nodes: DataFrame, most: int) -> DataFrame:
    """``g, pos, path, top`` of ``nodes(g, pos, size, hash)``: each node's siblings up to the one node that remains of its group (``top``);
    ``most`` is the largest group's size. Each call of itself has ``BLOCK`` times fewer nodes."""
    if most <= 1:
        return nodes.select("g", "pos", F.array().cast("array<string>").alias("path"), F.col("hash").alias("top"))

    def finish(inner: pd.DataFrame, levels: list[list[str]], above: pd.Series) -> pd.DataFrame:
        found = [[*siblings(levels, i), *above["path"]] for i in range(len(inner))]
        return pd.DataFrame({"g": inner["g"], "pos": inner["pos"], "path": found, "top": above["top"]})

    return materialize(exchange(nodes, paths(tops(nodes), -(-most // BLOCK)), finish, "g string, pos long, path array<string>, top string"), "paths")


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, lang``: one row per input row.

    Leaves ascend by id within a language; runs of eight become their hash until one node, the language's subroot, remains; subroots,
    null first and then by the bytes of their names, give the root in the same way. ``proof_sha256`` hashes all siblings on the way to the root.
    ``folded_root`` is computed anew from the row's leaf, or the tampered one where there is one, and the siblings.

    Edge cases: nulls count as ``-`` in the leaf; rows with a null id come first, are never tampered and, like rows that repeat an id, are
    ordered by their leaf (equal rows have equal leaves and take any places among them); an empty and a null text differ; texts of any length
    are hashed whole by Spark and never leave the scan; a table of one row is its own root with no siblings; an empty table gives an empty table.
    Only the five named columns are read, so others may have any name.
    """
    placed = leaves(docs)
    nodes = placed.withColumn("hash", F.col("leaf"))
    most = placed.agg(F.max("size")).first()[0] or 0
    inside = paths(tops(nodes), -(-most // BLOCK))
    subroots = inside.where("pos = 0").select(F.lit("").alias("g"), F.col("g").alias("lang_key"), F.col("top").alias("hash"))
    forest = materialize(numbered(subroots, "g", ["lang_key"], "subroots"), "forest")
    above = paths(forest, forest.agg(F.max("size")).first()[0] or 0).select("pos", F.col("path").alias("__up"), F.col("top").alias("root"))
    by_lang = materialize(forest.select("pos", F.col("lang_key").alias("g")).join(above, "pos").drop("pos"), "forest-paths")
    outer = inside.join(by_lang, "g").select("g", "pos", F.concat("path", "__up").alias("path"), F.col("top").alias("subroot"), "root")

    def finish(inner: pd.DataFrame, levels: list[list[str]], above: pd.Series) -> pd.DataFrame:
        up, proofs, folded = list(above["path"]), [], []
        for i, (leaf, tampered) in enumerate(zip(inner["leaf"], inner["tampered"], strict=True)):
            path = siblings(levels, i) + up
            proofs.append(digest("".join(path)))
            folded.append(fold(tampered or leaf, path))
        return pd.DataFrame({"doc_id": inner["id"], "leaf": inner["leaf"], "subroot": above["subroot"], "root": above["root"], "proof_sha256": proofs, "folded_root": folded, "g": inner["g"]})

    # Ids travel as text, as pandas would turn a column with nulls into doubles.
    rows = nodes.select("g", "pos", "size", "hash", F.col("doc_id").cast("string").alias("id"), "leaf", "tampered")
    found = exchange(rows, outer, finish, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, g string")
    lang = F.when(F.col("g") != "", F.substring("g", 2, 1 << 30))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), lang.alias("lang"))


def _crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a string of ASCII characters."""
    bit = "lambda x, b: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {bit})"
    chars = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {chars}), {byte}), 4294967295)"


def oracle_sql(levels: int = 8) -> str:
    """The whole manifest in DuckDB SQL, for at most ``FAN ** levels`` leaves a language and as many languages."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

    def tree(name: str, base: str) -> list[str]:
        """Levels ``name_0 ..`` of ``base(g, pos, h)``: left and right siblings, whether the group still has several nodes."""
        run = f"PARTITION BY g, pos // {FAN} ORDER BY pos ROWS BETWEEN"
        node = f"count(*) OVER (PARTITION BY g) > 1 AS several, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"
        out = [f"{name}_0 AS MATERIALIZED (SELECT g, pos, h, {node} FROM {base})"]
        for k in range(1, levels + 1):
            out.append(f"{name}_{k} AS MATERIALIZED (SELECT g, pos, h, {node} FROM (SELECT g, pos // {FAN} AS pos, CASE WHEN several THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {name}_{k - 1} GROUP BY g, pos // {FAN}, several))")
        return out

    def walk(name: str, source: str, out: str) -> list[str]:
        """Proof and fold of ``source(g, pos, proof, fold, ...)`` through the tree's levels."""
        steps, last = [], source
        for k in range(levels):
            steps.append(f"{out}_{k} AS (SELECT p.* REPLACE (p.pos // {FAN} AS pos, CASE WHEN n.several THEN p.proof || n.l || n.r ELSE p.proof END AS proof, CASE WHEN n.several THEN sha256(n.l || p.fold || n.r) ELSE p.fold END AS fold) FROM {last} p JOIN {name}_{k} n ON p.g = n.g AND p.pos = n.pos)")
            last = f"{out}_{k}"
        return steps

    parts = [
        f"leaf AS MATERIALIZED (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, lang, {leaf('text')} AS h, CASE WHEN doc_id IS NOT NULL AND {_crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(lower)} END AS tampered FROM documents)",
        "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaf)",
        *tree("t", "placed"),
        f"subroots AS MATERIALIZED (SELECT g AS name, h, '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS pos FROM t_{levels})",
        *tree("u", "subroots"),
        "start AS (SELECT g, pos, doc_id, h AS leaf, lang, '' AS proof, coalesce(tampered, h) AS fold FROM placed)",
        *walk("t", "start", "a"),
        f"middle AS (SELECT '' AS g, s.pos, a.doc_id, a.leaf, a.lang, a.proof, a.fold, s.h AS subroot FROM a_{levels - 1} a JOIN subroots s ON a.g = s.name)",
        *walk("u", "middle", "b"),
    ]
    return f"WITH {', '.join(parts)} SELECT b.doc_id, b.leaf, b.subroot, r.h AS root, sha256(b.proof) AS proof_sha256, b.fold AS folded_root, b.fold = r.h AS verified, b.lang FROM b_{levels - 1} b CROSS JOIN u_{levels} r"
