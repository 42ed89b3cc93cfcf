"""Similarity join, shards, exact top-k, personal data, mixing and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from postgrain.llm import fair_mix, group_join, perm_table, pii, queries, va_file


def shingles(text: str | None) -> frozenset:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    lowest = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            lowest[find(k)] = min(lowest.get(find(k), r[0]), r[0])
    return sorted(((r[0], len(sets[k]), lowest.get(find(k), r[0])) for k, r in enumerate(rows)), key=str)


def edited_texts(seed: int, groups: int, copies: int, most: int):
    rng = random.Random(seed)
    passage = [f"common{k}" for k in range(40)]
    rows, ids = [], iter(rng.sample(range(10_000), groups * copies + 40))
    for g in range(groups):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 5, 9, 60, 200]))]
        if g % 3 == 0:
            words[2:2] = passage
        for _ in range(copies):
            new = list(words)
            for _ in range(rng.randrange(most)):
                new[rng.randrange(len(new))] = f"n{rng.randrange(10**6)}"
            rows.append((next(ids), " ".join(new) if rng.random() < 0.8 else "\t".join(new).upper(), "en", "s"))
    for k in range(40):
        rows.append((next(ids), " ".join(passage[: 20 + k // 2] + [f"u{k}{j}" for j in range(k % 12)]), "en", "s"))
    return rows


def test_links_by_brute_force(spark, documents, odd):
    base = [tuple(r)[:4] for r in odd.collect()]
    for rows in (base, edited_texts(1, 30, 6, 4), edited_texts(2, 4, 60, 9), []):
        got = group_join.link_documents(documents(rows)).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def test_reach_loses_no_link():
    """Any two linked sets share as many of their first hashes as the smaller need of both."""
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.integers(1, 80))
        m = int(rng.integers(-(-3 * n // 4), 4 * n // 3 + 1))
        least = -(-75 * (n + m) // 175)
        if least > min(n, m):
            continue
        pool = rng.permutation(1000)
        x, y = np.sort(pool[:n]), np.sort(np.concatenate([rng.choice(pool[:n], least, replace=False), pool[n : n + m - least]]))
        (a, need_a), (b, need_b) = group_join.reach(n, 75), group_join.reach(m, 75)
        common = len(np.intersect1d(x[:a], y[:b]))
        assert common >= need_a and common >= need_b


def test_near_copies_form_no_pairs(spark, documents):
    rows = edited_texts(3, 1, 300, 3)
    sets = group_join.document_sets(documents(rows), 5, ["doc_id"])
    assert sets.count() == len(rows)
    got = group_join.link_documents(documents(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def test_shard_table():
    shards = {"a": 1, "b": 1, "c": 2}
    table = perm_table.fill(shards, 1009)
    counts = {name: table.count(name) for name in shards}
    assert abs(counts["a"] - counts["b"]) <= 1 and abs(counts["c"] - 2 * counts["a"]) <= 2 and None not in table
    same = perm_table.fill(dict(reversed(shards.items())), 1009)
    assert same == table
    many = {f"s{k}": 1 for k in range(10)}
    full, fewer = perm_table.fill(many, 10007), perm_table.fill({k: v for k, v in many.items() if k != "s9"}, 10007)
    assert sum(a != b for a, b in zip(full, fewer)) < 0.25 * 10007
    for bad in ({}, {"a": 0}):
        with pytest.raises(ValueError):
            perm_table.fill(bad, 1009)
    with pytest.raises(ValueError):
        perm_table.fill(many, 10)
    # By turns, one claim at a time.
    claims, taken, k = {n: 0 for n in sorted(shards)}, {}, 0
    order = {}
    for n in claims:
        d = hashlib.sha256(n.encode()).digest()
        start, step = int.from_bytes(d[:8], "big") % 1009, int.from_bytes(d[8:16], "big") % 1008 + 1
        order[n] = [(start + j * step) % 1009 for j in range(1009)]
    while len(taken) < 1009:
        for n in ("a", "b", "c", "c"):
            slot = next((s for s in order[n] if s not in taken), None)
            if slot is not None:
                taken[slot] = n
    assert [taken[s] for s in range(1009)] == table


def test_shards_of_rows(spark, odd, documents, tmp_path):
    table = perm_table.fill({"p": 1, "q": 1}, 101)
    placed = perm_table.place(odd.withColumnRenamed("node", "slot").withColumnRenamed("finish", "shard"), "doc_id", {"shard": table})
    rows = placed.collect()
    assert len(rows) == odd.count()
    for r in rows:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 101
        assert r.slot == slot and r.shard == table[slot]
    perm_table.write_shards(placed, f"file://{tmp_path}/shards")
    assert spark.read.parquet(f"file://{tmp_path}/shards").count() == len(rows)
    assert perm_table.place(documents([]), "doc_id", {"shard": table}).count() == 0


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(rng.normal(size=(700, 8)).astype(np.float32))]
    rows += [(700, rows[3][1], 0), (701, rows[3][1], 0), (800, None, 0), (900, [1.0, None] * 4, 0), (1000, [float("nan")] * 8, 0)]
    rows += [(1100, [1e30] * 8, 0), (1101, [-3.0, 2.0], 0), (1200, [1.0, 1.0], 0), (None, rows[4][1], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = va_file.top_k(vectors, vectors.vec_id % 100 == 0, 10, wave=4).collect()
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 100 == 0:
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in good if i != q and len(a) == len(b))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert va_file.top_k(vectors.limit(0), vectors.vec_id % 100 == 0, 10).count() == 0


def test_top_k_of_many_queries_and_repeated_ids(spark):
    """More queries than a strip and a wave; of rows with a query's id the smallest vector that takes part asks."""
    rng = np.random.default_rng(7)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rng.integers(-3, 4, size=(900, 5)))]
    rows += [(10, [float("nan")] * 5), (10, [-9.0, 1.0, 2.0, 3.0, 4.0]), (20, rows[20][1]), (30, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    good = [(i, v) for i, v in rows if v and np.isfinite(v).all()]
    asks = {}
    for i, v in good:
        if i % 2 == 0:
            asks[i] = min(asks.get(i, v), v)
    want = []
    for q, a in asks.items():
        scores = sorted((-int(1024 * 1024 * np.dot(a, b)), i) for i, b in good if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    for wave in (4096, 300):
        got = va_file.top_k(vectors, vectors.vec_id % 2 == 0, 10, wave=wave).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text: str) -> str:
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and total % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }
            if ok[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_base_spans_by_brute_force(spark, documents, odd):
    rng = random.Random(7)
    parts = ["a.b", "@", ".", "1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (017) 555-7713", "192.168.0.1", "999.1.1.1", "001.2.3.4", " ", "-", "x@y.zz", "_", "😀", "é", "\n", "+", "12", "(", ")", "%"]
    texts = ["".join(rng.choices(parts, k=rng.choice([3, 8, 30]))) for _ in range(300)]
    texts += ["a" * 30_000, "1" * 30_000, "1 " * 15_000, "+1" + " (" * 15_000, "a@" * 9000, "1." * 9000, "a@b.c_d@e.f", "x@y_d@e.f", "1.2.3.4.5.6.7.8", None, ""]
    docs = documents([(k, t, "en", "s") for k, t in enumerate(texts)])
    found = pii.find(docs.select("doc_id", "text"))
    got = pii.select(found, pii.Trees(0.0, [], [float("inf")] * 4)).select("doc_id", pii.listed("base").alias("base"), pii.listed("spans").alias("spans"), pii.redacted("text", "spans").alias("clean")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.base == r.spans == base_spans(texts[r.doc_id] or "")
        assert "x@y.zz" not in (r.clean or "")
    shown = pii.redacted("text", "spans").alias("clean")
    one = documents([(1, "😀 mail a@b.org or +1 (017) 555-7713, host 10.0.0.1.", "en", "s")])
    assert pii.select(pii.find(one), pii.Trees(0.0, [], [float("inf")] * 4)).select(shown).head()[0] == "😀 mail [EMAIL] or [PHONE], host [IP]."


def test_trees_add_spans_and_keep_base(spark, documents):
    """Addresses that the base rule knows teach one that it misses; text without any stays as it is."""
    rows = [(k, f"please write to user{k}@host{k % 9}.example.org today", "en", "s") for k in range(300)]
    rows += [(300 + k, f"number {k} of the list is {k * 7}", "en", "s") for k in range(100)]
    rows += [(1000, "please write to user7 (at) host3.example.org today", "en", "s")]
    found = pii.find(documents(rows).select("doc_id", "text"))
    got = {r.doc_id: r.spans for r in pii.select(found, pii.train(found)).select("doc_id", pii.listed("spans").alias("spans")).collect()}
    assert all(got[k] == base_spans(rows[k][1]) for k in range(400))
    assert got[1000] == "email:16:44"


PLANTED = {
    "phone": ["(415) 555-0132", "tel 555-123-4567", "212-555-0187", "415 555 0132 415 555 0199", "(415) 555-0132 (415) 555-0199", "303.555.0143"],
    "card": ["4111.1111.1111.1111", "4012/8888/8888/1881", "pay 5500.0000.0000.0004"],
    "email": ["ann (at) host3.example.org", "bob [at] mail [dot] example [dot] com"],
}


def test_trees_find_planted_spans(spark, documents):
    """Spans that no base rule knows are found from base spans whose marks are hidden; other numbers are left alone."""
    rng = random.Random(3)
    n = lambda k: "".join(rng.choices("0123456789", k=k))
    texts = [rng.choice(["+1 ({}) {}-{}", "+1-{}-{}-{}", "+1 {} {} {}"]).format(n(3), n(3), n(4)) for _ in range(400)]
    texts += [rng.choice(["4111-1111-1111-1111", "4012 8888 8888 1881", "5500-0000-0000-0004"]) for _ in range(200)]
    texts += [f"user{k}@host{k % 9}.example.org" for k in range(200)]
    other = [f"on {rng.randrange(1900, 2100)}-{n(2)}-{n(2)}" for _ in range(200)] + [f"order {n(8)}" for _ in range(200)]
    other += [f"{n(4)}.{n(4)}.{n(4)}" for _ in range(100)] + [f"sold (at) {n(1)}.{n(2)}" for _ in range(50)]
    planted = [(kind, text) for kind, many in PLANTED.items() for text in many for _ in range(2)]
    rows = [f"it says {x} and then more" for x in [*texts, *other, *(x for _, x in planted)]]
    found = pii.find(documents([(k, x, "en", "s") for k, x in enumerate(rows)]).select("doc_id", "text"))
    got = {r.doc_id: r.spans for r in pii.select(found, pii.train(found)).select("doc_id", pii.listed("spans").alias("spans")).collect()}
    spans = {k: [x.split(":") for x in v.split(",") if x] for k, v in got.items()}
    first = len(texts) + len(other)
    assert all(got[k] == base_spans(rows[k]) for k in range(first))
    for k, (kind, text) in enumerate(planted, first):
        want = re.findall(r"\(415\) 555-0\d+|415 555 0\d+", text) or [re.sub("^(tel|pay) ", "", text)]
        assert [(name, rows[k][int(a) : int(b)]) for name, a, b in spans[k]] == [(kind, w) for w in want], text


def test_mix_against_sql(spark, documents, odd, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = [(k, "w " * rng.choice([0, 1, 5, 60]), "en", rng.choice(["a", "a", "a", "b", None, "é"])) for k in range(400)]
    rows += [(None, f"x {k % 5} y", "en", "a") for k in range(60)] + [(7, "same words", "en", "b")] * 9
    for docs in (documents(rows), odd, documents([])):
        file = f"{tmp_path}/documents-{docs.count()}.parquet"
        docs.toPandas().astype({"doc_id": "Int64"}).to_parquet(file)
        monkeypatch.setattr(fair_mix, "BUCKET_ROWS", 50)
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{file}'")
        want = con.sql(queries.MIX_SQL).fetchall()
        got = fair_mix.mix(docs, ranges=16).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_mix_reaches_targets(spark, documents):
    rng = random.Random(9)
    rows = [(k, "w " * rng.randrange(1, 20), "en", "abc"[min(2, k % 9 // 4)]) for k in range(3000)]
    got = fair_mix.mix(documents(rows)).collect()
    source = {r[0]: r[3] for r in rows}
    for name in "abc":
        mine = [r for r in got if source[r.doc_id] == name]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 60
        assert all(r.taken <= 2 * r.size for r in mine)


def test_mix_of_null_and_equal_rows(spark, documents):
    """Null ids are shuffled like others, reruns on other partitions agree, and the stage returns the mix."""
    import corpus_pipeline as pipe

    rng = random.Random(3)
    rows = [(None, f"t{k} " + "w " * rng.randrange(1, 60), "en", "ab"[k % 2]) for k in range(600)]
    rows += [(1, "one two three", "en", "a")] * 40 + [(None, None, "en", "b")] * 5 + [(2, "lone " * 30, "en", "c")]
    docs = documents(rows)
    key = fair_mix.row_key(F.col("doc_id"), F.col("source"), F.col("text"))

    def taken(docs):
        return sorted((r.k, r.size, r.copies) for r in fair_mix.mix(docs.withColumn("k", key), keep=("k",)).collect())

    first = taken(docs)
    assert first == taken(docs.repartition(7, "text"))
    sizes = [[size for k, size, copies in first if copies == c and size > 3] for c in (1, 2)]
    assert all(sizes) and abs(np.mean(sizes[0]) - np.mean(sizes[1])) < 8
    total = {}
    for k, _, copies in first:
        total[k] = total.get(k, 0) + copies
    got = {}
    for r in pipe.source_mix(spark, docs, "").withColumn("k", key).collect():
        got[r.k] = got.get(r.k, 0) + 1
    assert got == {k: n for k, n in total.items() if n}


def test_near_duplicates_of_null_and_repeated_ids(spark, documents):
    """One row of a group stays, also where ids are null or stand in several rows; wordless rows are in no group."""
    import corpus_pipeline as pipe

    one, two, three = (" ".join(f"{w}{k}" for k in range(40)) for w in ("red", "blue", "green"))
    texts = [(None, one), (None, one), (None, one + " more"), (None, two), (None, two), (7, two + " more"), (7, one), (3, one + " again")]
    texts += [(9, three), (9, three), (9, three + " more"), (9, two + " again"), (None, ""), (None, None), (5, ""), (5, ""), (6, None), (None, "only this one is here")]
    got = pipe.near_duplicates(spark, documents([(i, t, "en", "s") for i, t in texts]), "")
    want = [(3, one + " again"), (7, two + " more"), (None, "only this one is here"), (None, ""), (None, None), (5, ""), (6, None)]
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect() if r.doc_id != 9) == sorted((str(i), str(t)) for i, t in want)
    assert [r.text in (three, three + " more") for r in got.filter("doc_id = 9").collect()] == [True]
    alone = pipe.near_duplicates(spark, documents([(None, one, "en", "s")] * 3 + [(None, one + " more", "en", "s")]), "")
    assert alone.count() == 1 and alone.columns == got.columns


def shuffled_bytes(plan) -> int:
    """Bytes that the shuffles of an executed plan wrote."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled_bytes(plan.executedPlan())
    if name.endswith("QueryStage"):
        return shuffled_bytes(plan.plan())
    own = plan.metrics().apply("shuffleBytesWritten").value() if name == "Exchange" else 0
    return own + sum(shuffled_bytes(plan.children().apply(k)) for k in range(plan.children().size()))


def test_near_duplicates_shuffles_few_texts(spark, documents):
    import corpus_pipeline as pipe

    texts = [" ".join(f"{k * 7919 + j:x}" for j in range(200)) for k in range(0, 4000, 10)]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(1000 + k, texts[k], "en", "s") for k in range(5)] + [(9, texts[9], "en", "s")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the rows that go are many
    try:
        done = pipe.near_duplicates(spark, documents(rows), "")
        assert sorted(r.doc_id for r in done.collect()) == list(range(400))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    one = sum(map(len, texts)) // 10
    assert 0 < shuffled_bytes(done._jdf.queryExecution().executedPlan()) < one


def test_split_by_bitmap(spark):
    from postgrain.llm.bitmap import split

    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"k{i}") for i in range(3000)] + [(None, "x"), (None, None)], "a long, b string")
    wanted = rows.filter("a % 7 = 0 or a is null").select(rows["a"].alias("c"), rows["b"].alias("d"))
    among, others = split(rows, ["a", "b"], wanted, ["c", "d"])
    among, others = ([tuple(r) for r in df.collect()] for df in (among, others))
    assert {tuple(r) for r in wanted.collect()} <= set(among) and len(among) < 460
    assert sorted(among + others, key=repr) == sorted((tuple(r) for r in rows.collect()), key=repr)
    nothing, everything = split(rows, ["a", "b"], wanted.limit(0), ["c", "d"])
    assert nothing.count() == 0 and everything.count() == 3002


def test_pipeline_by_parts(spark, documents, odd):
    import corpus_pipeline as pipe
    from postgrain.session import stage

    english = "the river runs past the old mill and the children play there every day until dark comes"
    french = "le fleuve coule devant le vieux moulin et les enfants y jouent chaque jour avant la nuit"
    rows = [(k, f"{english} number {k} " * 3 if k % 2 else f"{french} numéro {k} " * 3, "en" if k % 2 else "fr", "ab"[k % 3 % 2]) for k in range(60)]
    rows += [(100, rows[1][1], "en", "a"), (101, rows[1][1] + "and more", "en", "b"), (102, "12 34 !!", "en", "a"), (103, None, "fr", "a")]
    rows += [(104, f"{english} ask ann@mail.example.org now", "en", "a")]
    docs = documents(rows)
    first = stage(pipe.language(spark, docs, ""))
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {r[0] for r in rows} - {102, 103}
    second = stage(pipe.near_duplicates(spark, first, ""))
    lowest = {i: c for i, _, c in brute_components(rows)}
    assert second.columns == docs.columns
    assert sorted(r.doc_id for r in second.collect()) == sorted(i for i, c in lowest.items() if i == c and i not in (102, 103))
    third = stage(pipe.personal_data(spark, second, ""))
    before, after = {r.doc_id: r.text for r in second.collect()}, {r.doc_id: r.text for r in third.collect()}
    assert after.pop(104) == before.pop(104).replace("ann@mail.example.org", "[EMAIL]") and after == before
    fourth = stage(pipe.source_mix(spark, third, ""))
    copies = {}
    for r in fourth.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {r.doc_id: r.copies for r in fair_mix.mix(third).collect() if r.copies}
    last = pipe.token_ids(spark, fourth, "").collect()
    assert all(r.decoded_sha256 == hashlib.sha256(({**after, 104: before.get(104)}.get(r.doc_id) or "").encode()).hexdigest() for r in last if r.doc_id != 104)
    for docs, stages in ((odd, pipe.STAGES[2:4]), (documents([]), [pipe.STAGES[0], pipe.STAGES[3]])):
        for _, work in stages:
            out = work(spark, docs, "")
            assert out.columns == docs.columns and (out.count() > 0) == (docs is odd)
