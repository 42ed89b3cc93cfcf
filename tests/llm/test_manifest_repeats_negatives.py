"""Merkle manifest, removal of repeated windows and hard negatives, each against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postgrain.llm import merkle, negatives, windows
from postgrain.llm.ordering import positions


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_tree(nodes, fanout):
    """The top of a list of digests, and for each leaf its siblings as (left, right) pairs, lowest level first."""
    paths = [[] for _ in nodes]
    under = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, up_under = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for s in range(len(run)):
                for leaf in under[at + s]:
                    paths[leaf].append(("".join(run[:s]), "".join(run[s + 1 :])))
            up.append(sha("".join(run)))
            up_under.append([leaf for u in under[at : at + fanout] for leaf in u])
        nodes, under = up, up_under
    return (nodes[0] if nodes else None), paths


def brute_manifest(rows, fanout):
    """(leaf, subroot, root, path) of each row (doc_id, text, lang), sorted."""
    parts = {}
    for doc_id, text, lang in rows:
        parts.setdefault(lang, []).append((doc_id is not None, doc_id or 0, sha(framed(doc_id) + framed(lang) + framed(text))))
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    made = {p: brute_tree([leaf for *_, leaf in sorted(parts[p])], fanout) for p in order}
    root, above = brute_tree([made[p][0] for p in order], fanout)
    out = []
    for k, p in enumerate(order):
        for (*_, leaf), path in zip(sorted(parts[p]), made[p][1]):
            out.append((leaf, made[p][0], root, [tuple(x) for x in path + above[k]]))
    return sorted(out)


def test_manifest_by_brute_force(spark, odd, documents):
    rng = random.Random(2)
    base = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    many = [(rng.randrange(10**6), f"t{k}", rng.choice(["a", "b", "ä", "z", "", None])) for k in range(150)]
    langs = [(k, "x", f"l{k}") for k in range(20)]  # a part for each row
    for rows, fanout in ((base + many, 8), (langs, 3), (many[:1], 8), ([], 8)):
        docs = documents([(i, t, p, "s") for i, t, p in rows])
        leaves = docs.select("doc_id", "lang", merkle.leaf([F.col(c) for c in ("doc_id", "lang", "text")]).alias("digest"))
        made = merkle.manifest(leaves, "doc_id", F.col("lang"), fanout)
        proofs = made.proofs().withColumn("folds", merkle.folded(F.col("digest"), F.col("path")))
        got = proofs.withColumn("proof", merkle.proof_digest(F.col("path"))).collect()
        want = brute_manifest(rows, fanout)
        assert sorted((r.digest, r.subroot, made.root, [tuple(p) for p in r.path]) for r in got) == want
        assert all(r.folds == made.root for r in got)
        assert sorted(r.proof for r in got) == sorted(sha("".join(a + b for a, b in path)) for *_, path in want)
        nodes = made.nodes().collect()
        assert sum(n.tree == "parts" and n.level == 0 for n in nodes) == len(rows)


def test_tampering_is_seen(spark, documents):
    docs = documents([(k, f"Text {k}", "en", "s") for k in range(50)])
    leaves = docs.select("doc_id", "lang", merkle.leaf([F.col("text")]).alias("digest"), merkle.leaf([F.lower("text")]).alias("seen"))
    made = merkle.manifest(leaves, "doc_id", F.col("lang"))
    bad = made.proofs().filter(merkle.folded(F.col("seen"), F.col("path")) == made.root)
    assert bad.count() == 0


def test_positions_of_a_hot_group(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("x"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"))
    got = positions(rows, "g", ["x"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.pos, r.x, r["of"]))
    for places in by.values():
        places.sort()
        assert [p for p, *_ in places] == list(range(len(places)))
        assert [x for _, x, _ in places] == sorted(x for _, x, _ in places)
        assert {n for *_, n in places} == {len(places)}


def brute_repeats(rows, size):
    """(doc_id, n_words, n_removed, kept) of rows (doc_id, text), a null id last, equal ids by the digest of the text."""

    def digest(text):
        return "" if text is None else hashlib.md5(text.encode()).hexdigest()

    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, digest(r[1])))
    seen, out = set(), []
    for doc_id, text in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for at in range(len(words) - size + 1):
            run = tuple(words[at : at + size])
            if run in seen:
                gone[at : at + size] = [True] * size
            seen.add(run)
        out.append((doc_id, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=str)


def test_repeats_by_brute_force(spark, odd, documents):
    rng = random.Random(20)
    base = [(r.doc_id, r.text) for r in odd.collect()]
    passage = [f"P{k}" for k in range(60)]
    many = []
    for k in range(120):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([0, 1, 19, 20, 21, 90]))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(40)
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[a : a + rng.randrange(60)]
        many.append((rng.choice([None, k // 2, 7, rng.randrange(10**6)]), rng.choice([" ", "\t", " \n "]).join(words)))
    many += many[:30] + [(None, "same " * 50)] * 3 + [(1000, "é " * 45 + "e"), (1001, None), (1002, "Low low " * 30)]
    for rows, size in ((base + many, 20), (base + many, 3), ([], 20)):
        got = windows.remove_repeats(documents([(i, t, "en", "s") for i, t in rows]), size).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows, size)


def test_sketch_only_overestimates():
    """Equal windows at two places count at least twice, whatever lies around them."""
    rng = random.Random(4)
    for _ in range(50):
        vocabulary = rng.choice([2, 5, 1000])
        texts = [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(80))) for _ in range(6)]
        texts[3] = texts[1] + " " + texts[2]
        column = pa.array(texts)
        counts, places = {}, {}
        for _, raw, offsets in windows.chunks(column, 200):
            w = windows.Windows.of(raw, offsets, 20)
            for run in w.counted().tolist():
                counts[run] = counts.get(run, 0) + 1
            for start, at in zip(w.starts.tolist(), w.at.tolist()):
                places.setdefault(w.words[start : start + 20].tobytes(), []).append(w.runs[at])
        for runs in places.values():
            assert len(set(runs)) == 1 and counts[runs[0]] >= len(runs)


def test_counters_are_two_bits():
    """Counts up to two as by numpy, in a quarter of a byte each (a byte each took an executor beyond its memory)."""
    rng, n = np.random.default_rng(5), 1 << 12
    counters, total = windows.Counters.of(n), np.zeros(n, dtype=np.int64)
    assert counters.once.nbytes + counters.twice.nbytes == n // 4
    for size in (0, 1, 300, 2000):
        c = rng.integers(0, n, size)
        counters.add(c)
        total += np.bincount(c, minlength=n)
    for least, bits in ((1, counters.once), (2, counters.twice)):
        assert (np.unpackbits(bits, bitorder="little").astype(bool) == (total >= least)).all()


def test_small_sketch_loses_nothing(spark, documents, monkeypatch):
    """A sketch in which most counters meet gives the same result."""
    rows = [(k, " ".join(f"w{(k % 5) * 7 + j % 31}" for j in range(60))) for k in range(40)]
    monkeypatch.setattr(windows, "WIDTH_BITS", 8)
    monkeypatch.setattr(windows, "SLICE_BITS", 5)
    got = windows.remove_repeats(documents([(i, t, "en", "s") for i, t in rows])).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows, 20)


def brute_negatives(rows, positives=5, wanted=10):
    ok = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if None not in (i, label, v) and None not in v and all(map(math.isfinite, v))]
    anchors = {}
    for i, label, v in ok:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for i, (label, v) in anchors.items():
        others = sorted(((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in ok if j != i and len(w) == len(v)), key=lambda x: x[:2])
        for s, j, _ in [x for x in others if x[2] == label][:positives]:
            fits = [(t, n) for t, n, m in others if m != label and 30 * -s <= 100 * -t <= 90 * -s][:wanted]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, score int, rank string")
    return sorted(tuple(r) for r in negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0, **options).collect())


def vectors(seed, n, dim, labels):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dim))
    return [(int(k), int(rng.integers(labels)), (middle[k % 6] + rng.normal(size=dim)).tolist()) for k in rng.permutation(n)]


def test_negatives_by_brute_force(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = vectors(1, 700, 8, 3) + [(k, 1, [1.0, 0.5]) for k in range(5000, 5130)]
    rows += [(None, 1, [1.0] * 8), (9000, None, [1.0] * 8), (9100, 1, None), (9200, 1, [1.0, None] * 4), (9300, 1, [nan] * 8), (9400, 2, [inf] * 8)]
    rows += [(9500, 1, [0.0] * 8), (9600, 1, [-1.0] * 8), (100, 2, [0.1] * 8), (100, 1, [0.1] * 8), (200, 1, [0.3] * 8), (9701, 0, []), (9700, 1, [])]
    rows += [(k, 0, [1.0, 0.25]) for k in range(6000, 6150)] + rows[:20]  # ties beyond a strip, repeated rows
    want = brute_negatives(rows)
    assert want and mined(spark, rows) == want
    # Many blocks, packs and strips, and a seed of a few rows.
    for name, value in (("BLOCK_BYTES", 8 * 8 * 50), ("PACK_BYTES", 8 * 8 * 2), ("STRIP", 7), ("SEED", 40), ("GROUP", 2), ("CLUSTERS", 3)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, rows) == want


def test_negatives_of_few_rows(spark):
    for rows in ([], [(100, 1, [1.0, 1.0])], [(1, 1, [1.0]), (2, 2, [1.0])], [(100, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5])]):
        assert mined(spark, rows) == brute_negatives(rows)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for dim in (1, 2, 16):
        members, block = rng.normal(size=(20, dim)) + 2, rng.normal(size=(300, dim)) * rng.choice([0, 1, 100], size=(300, 1))
        assert (members @ block.T <= negatives.bounds(members, block) * negatives.norms(members)[:, None] + 1e-9).all()
