"""Recall of the bands, against planted edits; which pairs count is told by the likeness alone."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import edit_embedding as e

WORDS = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in ("ra", "st", "nem", "lo", "kit", "vus", "ti", "an")]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def changed(rng, words, kind):
    words, n = list(words), len(words)
    if isinstance(kind, int):
        for _ in range(kind):
            at, how = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (how > 0)] = [] if how == 1 else prose(rng, 1)
        return words
    part, share = kind
    size = int(n * share)
    return prose(rng, size) + words[size:] if part == "head" else words[: n - size] + prose(rng, size) if part == "tail" else words[: n // 2] + prose(rng, size) + words[n // 2 :]


@pytest.mark.parametrize("n", [150, 600, 3000])
def test_bands_meet_where_texts_are_alike(n):
    """3 and 10 edited words, a new beginning or end, a passage put in: of the pairs of likeness 0.8 or more, 9 of 10 share a band."""
    rng = random.Random(n)
    found = {}
    for kind in (3, 10, ("head", 0.05), ("head", 0.1), ("head", 0.15), ("tail", 0.1), ("middle", 0.05)):
        for _ in range(25):
            words = prose(rng, n)
            a, b = (e.walks([e.symbols(" ".join(w))])[0] for w in (words, changed(rng, words, kind)))
            met = bool(set(e.bands(e.encode(a))) & set(e.bands(e.encode(b))))
            found.setdefault(kind, []).append((e.likeness(a, b) >= 0.8, met))
    alike = [met for pairs in found.values() for near, met in pairs if near]
    print({k: (sum(a for a, _ in v) / len(v), sum(a and m for a, m in v) / len(v)) for k, v in found.items()})
    assert sum(alike) >= 0.9 * len(alike) and len(alike) > 60


def test_every_part_of_a_view_has_bands():
    mark = e.walks([e.symbols(" ".join(prose(random.Random(1), 3000)))])[0]
    starts = {int(k.split("|")[1]) for k in e.bands(e.encode(mark)) if int(k.split("|")[0]) == mark[0]}
    assert starts >= set(range(0, len(mark[1]) - e.SAMPLES // 2, e.SAMPLES // 2))


def test_band_numbers_are_equal_where_keys_are():
    """edit_groups: one number a key; of any two texts as many are shared as of the keys, also of texts shorter than a band."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 16, 300).astype(np.uint8)
    marks = [(int(rng.integers(0, 5)), np.where(rng.random(n) < 0.1, rng.integers(0, 16, n), base[:n]).astype(np.uint8)) for n in [*range(12), *rng.integers(12, 300, 80)]]
    keys, numbers = [set(e.bands(e.encode(m))) for m in marks], [set(e.band_numbers(m).tolist()) for m in marks]
    assert all(len(a & b) == len(c & d) for a, c in zip(keys, numbers, strict=True) for b, d in zip(keys, numbers, strict=True))
    assert all(n >> 56 & 63 in (m[0], m[0] + 1) for m, found in zip(marks, numbers, strict=True) for n in found)


def test_sketches_rule_out_unlike_pairs_only(spark):
    """edit_groups: no pair of likeness 0.8 is ruled out at any level that two texts share, most unlike ones are, and those never become rows."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 16, 700).astype(np.uint8)
    like = [(2 + k % 2, np.where(rng.random(n) < p, rng.integers(0, 16, n), (base if k % 2 == 0 else e.coarser((2, base), 3))[:n]).astype(np.uint8)) for k, (n, p) in enumerate((n, p) for n in (0, 5, 40, 70, 110, 128, 140, 200, 250) for p in (0, 0, 0.05, 0.18, 0.22, 1))]
    marks = spark.createDataFrame([(i, e.encode(m)) for i, m in enumerate(like)], "doc_id long, fingerprint string")
    rows = marks.mapInArrow(e._sketches, f"doc_id long, level int, {e._SKETCH}")
    sides = [rows.select("level", *(F.col(c).alias(f"{c}_{d}") for c in rows.columns if c != "level")) for d in "ab"]
    told = [(r[0], r[1], r[2]) for r in sides[0].join(sides[1], "level").select("doc_id_a", "doc_id_b", e._may_be_alike("a", "b", 0.8)).collect()]
    assert all(may for a, b, may in told if e.likeness(like[a], like[b]) >= 0.8)
    assert sum(e.likeness(like[a], like[b]) >= 0.8 for a, b, _ in told) > 100
    unlike = [may for a, b, may in told if min(len(like[a][1]), len(like[b][1])) > 100 and e.likeness(like[a], like[b]) < 0.4]
    assert len(unlike) > 100 and not any(unlike)


def test_unlike_documents_of_a_key_are_not_paired(spark, monkeypatch):
    """edit_groups: hundreds of unlike texts with one beginning share keys; no pair of them is compared, and near copies and repeated ids among them are found."""
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    start = words(40)
    rows = [(i, start + " " + words(160)) for i in range(120)] + [(500, start + " " + words(160)), (500, "short")]
    rows += [(1000 + i, t[: len(t) - 3] + "xyz") for i, t in rows[:10]] + [(2000, rows[120][1]), (2001, "short")]
    made, written = {}, e.materialize
    monkeypatch.setattr(e, "materialize", lambda df, name: made.setdefault(name, written(df, name)))
    got = {r.doc_id: r.group_id for r in e.edit_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {d: d for d, _ in rows} | {1000 + i: i for i in range(10)} | {2000: 500, 2001: 500}
    assert got == want
    assert made["shared-keys"].count() > 1000 and made["cross-pairs"].count() + made["leader-pairs"].count() < 200
