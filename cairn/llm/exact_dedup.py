"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own characters say so, each chunk becomes an identifier that is verified
against the chunk's text, and texts are compared as ordered identifier lists. Chunk texts move once, to
the dictionary (map tasks merge equal chunks before that); documents themselves never move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import attach_group, materialize, without_ids

#: Characters that normalisation deletes.
SPACE = r"[\x20\x09-\x0D]"


def chunk_pattern(least: int = 1024, most: int = 8192) -> str:
    """The cutting rule: after at least ``least`` characters, behind two neighbours whose code points
    are 5 modulo 8 (below U+0250); at ``most`` characters in any case."""
    mark = "".join(f"\\x{{{c:x}}}" for c in range(0x21, 0x250) if c % 8 == 5)
    return f"(?s).{{{least - 2},{most - 2}}}?[{mark}]{{2}}|.{{1,{most}}}"


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64, least: int = 1024, most: int = 8192) -> DataFrame:
    """One row per input row: ``doc_id, n_code_points, text_sha256, recipe`` (verified chunk ids, in order).

    ``id_bits`` shortens the provisional ids so that tests can force collisions. The dictionary job
    groups ``(id, chunk text)``; texts that share an id are told apart by their rank within the id, and
    recipes that use such an id carry ``(position, rank)`` entries in ``ranks``.
    """
    ident = lambda c: F.xxhash64(c) if id_bits >= 64 else F.pmod(F.xxhash64(c), F.lit(1 << id_bits))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = texts.withColumn("norm", F.regexp_replace("text", f"{SPACE}+", "")).withColumn("chunks", F.regexp_extract_all("norm", F.lit(chunk_pattern(least, most)), F.lit(0)))
    recipes = cut.select("doc_id", F.length("text").cast("long").alias("n_code_points"), F.sha2("norm", 256).alias("text_sha256"), F.transform("chunks", ident).alias("recipe"), F.monotonically_increasing_id().alias("row"))
    recipes = materialize(recipes, "recipes")
    dictionary = cut.select(F.explode("chunks").alias("chunk")).select(ident(F.col("chunk")).alias("id"), "chunk").distinct()
    shared = materialize(dictionary.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "shared-ids")
    if shared.isEmpty():
        return recipes.withColumn("ranks", F.array().cast("array<string>"))
    # Texts that share an id: rank them by text; an id with many texts is not expected, a sort by (id, chunk) serves it.
    clash = dictionary.join(shared, "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("chunk")).alias("texts"))
    clash = clash.select("id", F.posexplode("texts").alias("rank", "chunk"))
    used = cut.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.posexplode("chunks").alias("pos", "chunk")).withColumn("id", ident(F.col("chunk")))
    ranks = used.join(clash, ["id", "chunk"]).groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_set(F.concat_ws(":", F.format_string("%09d", "pos"), "rank"))).alias("ranks"))
    joined = recipes.alias("r").join(ranks.alias("k"), (F.col("r.doc_id").eqNullSafe(F.col("k.doc_id"))) & (F.col("r.text_sha256") == F.col("k.text_sha256")), "left")
    return joined.select("r.*", F.coalesce("ranks", F.array().cast("array<string>")).alias("ranks"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64, least: int = 1024, most: int = 8192) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, n_code_points, row``: one row per input row.

    Texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``.
    The row with the most code points in the original text stays, then the smallest id.

    Edge cases: a null text counts as empty, and all texts without a visible character are one group; a
    null id comes after all others in the choice; rows that repeat an id with an equal text keep
    exactly one row ``kept`` (``row`` tells them apart); an empty table gives an empty table; only the two
    named columns are read, so other columns may have any name.
    """
    recipes = chunk_recipes(docs, id_col, text_col, id_bits, least, most)
    best = F.min(F.struct((-F.col("n_code_points")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))).alias("best")
    found = attach_group(recipes, ["recipe", "ranks"], "row", [best, F.count("*").alias("group_size")])
    return found.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.row") == F.col("row")).alias("kept"), "text_sha256", "n_code_points", "row")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``exact_dedup`` keeps.

    Rows are dropped by id, so an id that repeats with different texts stays if any of its rows stays; of fully equal rows one stays.
    """
    result = exact_dedup(docs, id_col, text_col)
    stays = materialize(result.select("doc_id", "kept", "group_size"), "kept")
    keep = stays.where("kept").select(F.col("doc_id").alias("__keep"))
    gone = stays.where("NOT kept").select(F.col("doc_id").alias("__gone")).join(keep, F.col("__gone").eqNullSafe(F.col("__keep")), "left_anti").distinct()
    left = without_ids(docs, id_col, materialize(gone, "dropped"))
    twice = stays.where("kept OR group_size > 1").groupBy("doc_id").count().where("count > 1")
    return left if twice.isEmpty() else left.dropDuplicates([id_col, text_col])


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(x) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(x) DESC, doc_id) = doc_id AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
