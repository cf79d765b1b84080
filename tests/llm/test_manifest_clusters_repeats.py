"""Operators 11 to 13 against brute force and their SQL, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from cairn.llm import clustering, common, merkle, queries, substring_dedup

DOCS = "doc_id long, source string, lang string, n_chars long, text string, pos string, row string, g string, hash string"
SF = "/root/testdata/sf0.001"


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_centroid_clusters", "op13_substring_dedup"])
def test_queries_equal_their_sql(spark, name):
    found = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows_of(found, want.columns) == sorted(want.fetchall(), key=lambda r: tuple(map(str, r)))


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode('utf-8', 'surrogatepass'))}:{v}"
    leaf = lambda r, text: sha("".join(map(field, [*r[:4], text])))
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def way(levels, at):
        for nodes in levels[:-1]:
            start = at // 8 * 8
            yield nodes[start:at], nodes[at + 1 : start + 8]
            at //= 8

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(r, r[4]), r))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for n in names:
        groups[n].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[n] = tree([x[1] for x in groups[n]])
    top, out = tree([trees[n][-1][0] for n in names]), []
    for k, n in enumerate(names):
        for i, (doc, own, r) in enumerate(groups[n]):
            path = [*way(trees[n], i), *way(top, k)]
            node = leaf(r, lower(r[4])) if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 else own
            for left, right in path:
                node = sha("".join(left) + node + "".join(right))
            out.append((doc, own, trees[n][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=lambda r: tuple(map(str, r)))


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_equals_brute_force(spark):
    """Nulls, equal rows, rows that share an id, a language over several superblocks, many small languages, a long text."""
    rows = [(i, f"s{i % 3}", "big", i, f"Text {i}") for i in range(1300)]
    rows += [(i, None, f"l{i}", None, "T") for i in range(70)]
    rows += [(None, "a", None, 1, "X"), (None, None, None, None, None), (5, "s", "", 0, ""), (5, "s", "", 0, ""), (5, "t", "", 0, "Abc"), (7, "s", "é", 3, None), (9, "s", "é", 3, "É A" * 400_000)]
    docs = spark.createDataFrame([(*r, "1", "2", "3", "4") for r in rows], DOCS)
    assert rows_of(merkle.merkle_manifest(docs), MANIFEST) == brute_manifest(rows)


def test_manifest_of_one_and_no_rows(spark):
    one = [(None, "a", None, 1, "X")]
    assert rows_of(merkle.merkle_manifest(spark.createDataFrame([(*one[0], "", "", "", "")], DOCS)), MANIFEST) == brute_manifest(one)
    assert merkle.merkle_manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_tampering_with_one_field_breaks_the_proof():
    levels = merkle.climb([sha(str(i)) for i in range(100)], merkle.depth(100))
    for at in (0, 63, 64, 99):
        path = merkle.siblings(levels, at)
        assert merkle.fold(levels[0][at], path) == levels[-1][0] != merkle.fold(sha("other"), path)


def test_numbered_places(spark):
    df = spark.range(2000).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS g", "id % 7 AS k", "id")
    found = common.numbered(df, "g", ["k", "id"], "numbers").collect()
    for g in "ab":
        mine = sorted((r for r in found if r["g"] == g), key=lambda r: (r["k"], r["id"]))
        assert [r["pos"] for r in mine] == list(range(len(mine))) and {r["size"] for r in mine} == {len(mine)}


def brute_kmeans(rows, k=8, rounds=10, dims=64):
    kept = [(i, [int(np.floor(1024.0 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}"), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(c) // len(groups[n]) for c in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    per = {}
    for _, d, c in found:
        per[c] = per.get(c, 0) + d
    return sorted(((i, c, d, per[c], sum(per.values()), sha(",".join(map(str, centroids[c])))) for i, d, c in found), key=lambda r: tuple(map(str, r)))


CLUSTERS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
VECTORS = "vec_id long, embedding array<double>, x string, far string"


@pytest.mark.parametrize("count", [150, 5])
def test_clusters_equal_brute_force(spark, count):
    """Wrong lengths, nulls, not a number, infinities, equal vectors, repeated and null ids, negative components, fewer vectors than clusters."""
    rng = random.Random(count)
    rows = [(i, [rng.gauss(i % 4, 0.3) - 2 for _ in range(64)]) for i in range(count)]
    rows += [rows[0], (0, rows[1][1]), (None, rows[2][1]), (None, None), (900, []), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [float("nan")] + [0.0] * 63), (904, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], VECTORS)
    assert rows_of(clustering.kmeans(df), CLUSTERS) == brute_kmeans(rows)


def test_clusters_of_nothing_and_of_too_large_components(spark):
    assert clustering.kmeans(spark.createDataFrame([(1, [1.0], "", "")], VECTORS)).collect() == []
    with pytest.raises(ValueError):
        clustering.kmeans(spark.createDataFrame([(1, [1e6] * 64, "", "")], VECTORS))


def test_pivots_spare_exact_distances_and_keep_ties():
    rng = np.random.default_rng(0)
    centers = rng.integers(-1000, 1000, (8, 64))
    x = np.concatenate([c + rng.integers(-30, 30, (200, 64)) for c in centers])
    centroids = np.concatenate([centers, centers[:2]])
    far = np.stack([np.sqrt(clustering.exact(x, p)) for p in centers], axis=1)
    who, best, count = clustering.assign(x, far, centroids, centers)
    every = np.stack([clustering.exact(x, c) for c in centroids], axis=1)
    assert (who == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert count < 0.4 * every.size


def brute_repeats(rows, width=20):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, gone = set(), [set() for _ in rows]
    for i in order:
        for s in range(len(split[i]) - width + 1):
            window = tuple(split[i][s : s + width])
            gone[i] |= set(range(s, s + width)) if window in seen else set()
            seen.add(window)
    return sorted(((rows[i][0], len(w), len(gone[i]), sha(" ".join(x for k, x in enumerate(w) if k not in gone[i]))) for i, w in enumerate(split)), key=lambda r: tuple(map(str, r)))


REPEATS = ("doc_id", "n_words", "n_removed", "kept_sha256")
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "É") for b in ("ra", "se", "to", "WU")]


@pytest.mark.parametrize("shard_words", [300, 400_000])
def test_repeats_equal_brute_force(spark, shard_words):
    """Copies, near copies, shared passages of 19 to 60 words, repeats within a text, odd spaces, nulls, a long text."""
    rng = random.Random(3)
    text = lambda n: [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)]
    passages = [text(n) for n in (19, 20, 21, 60)]
    rows = []
    for i in range(90):
        words = text(rng.randrange(0, 90))
        for _ in range(i % 3):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        if i % 5 == 4:
            words = re.findall(r"[^\x20\x09-\x0D]+", rng.choice(rows)[1] or "")
            if i % 2 and words:
                words[rng.randrange(len(words))] = "edit"
        rows.append((i, rng.choice([" ", "\n", " \t\x0b"]).join(words)))
    rows += [(90, None), (91, ""), (92, " \n"), (93, "a " * 50), (94, "x y\x1fz " * 25), (None, rows[5][1] + " tail"), (95, " ".join(text(3000) * 2))]
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "doc_id long, text string, row string, keys string, pos string")
    assert rows_of(substring_dedup.remove_repeats(docs, shard_words=shard_words), REPEATS) == brute_repeats(rows)


def test_repeated_rows_and_ids_keep_one_text(spark):
    rng = random.Random(1)
    one, two = (" ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(40)) for _ in range(2))
    docs = spark.createDataFrame([(1, one), (1, one), (1, two), (None, two), (None, two)], "doc_id long, text string")
    found = substring_dedup.remove_repeats(docs).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in found) == [(40, 0), (40, 0), (40, 40), (40, 40), (40, 40)]
    assert {r["kept_sha256"] for r in found if r["n_removed"] == 0} == {sha(one), sha(two)}
    assert substring_dedup.remove_repeats(docs.limit(0)).collect() == []


def test_the_automaton_finds_every_occurrence():
    numbers = np.array([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 200, 20_000, 3, 4, 5, 6, 1, 2])
    found = substring_dedup.locate(numbers, np.array([0, 2]))
    assert np.flatnonzero(found).tolist() == [0, 2, 6, 13]
