"""Language, byte-level BPE, token counts, SimHash and page text."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from postgrain.llm import byte_bpe, hashing, language, page_tree, simhash, token_cache

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_shingles_by_brute_force():
    texts = ["a B c d e f g", None, "", "one", "x\ty\x0bz  w", "é 😀 a b c d", "a b c d e f g a b c d e f g " * 50]
    got = list(hashing.shingle_sets(pa.array(texts + ["pad"]).slice(0, len(texts)), 5))
    for text, found in zip(texts, got):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        words = [w for w in low.split(" ") if w]
        want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        assert len(found) == len(want)
    assert len(np.intersect1d(got[0], got[6])) == 3


def test_codebook_separates():
    for n in (2, 4, 9):
        codes = language.codebook(n)
        assert len({tuple(c) for c in codes}) == n
        assert all(abs(codes[:, k].sum()) < n for k in range(codes.shape[1]))
    assert language.codebook(1).shape == (1, 0)


def test_language_held_out(spark, documents):
    words = {"xx": ["lorem", "ipsum", "dolor"], "yy": ["zakat", "wexon", "qirra"], "zz": ["münte", "größe", "fühle"]}
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(words[lang], k=12)), lang, "s") for k, lang in enumerate(["xx", "yy", "zz"] * 40)]
    model = language.fit_languages(documents(rows[:90]))
    got = {r.doc_id: r for r in language.predict_languages(documents(rows[90:]), model, ["doc_id", "lang"]).collect()}
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got.values()) and len(got) == 30


def test_language_odd_rows(spark, documents, odd):
    model = language.fit_languages(odd)
    assert model.languages == ["en", "fr"]
    got = language.predict_languages(odd, model, ["doc_id", "text"]).collect()
    assert len(got) == odd.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    nothing = language.fit_languages(documents([]))
    assert {r.lang_pred for r in language.predict_languages(odd, nothing, ["doc_id"]).collect()} == {"und"}
    one = language.fit_languages(odd.filter("lang = 'en'"))
    assert {(r.lang_pred, r.score) for r in language.predict_languages(odd, one, ["doc_id"]).collect()} == {("en", 1.0), ("und", 0.0)}
    assert language.predict_languages(documents([]), model, ["doc_id"]).count() == 0


def test_byte_bpe_against_library(spark, odd, documents):
    import tiktoken

    bpe = byte_bpe.ByteBpe.load(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choices("aabcdeths  \n\t'é=-1\x1c\x85　😀", k=rng.choice([1, 9, 300])))
        assert bpe.encode(text) == library.encode_ordinary(text)
    for text in ("a" * 9000, "ab" * 9000, "=" * 5000 + "x", "theing" * 999):
        assert bpe.encode(text) == library.encode_ordinary(text)
    got = byte_bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN, ["doc_id", "text"]).collect()
    for r in got:
        ids = library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    both = byte_bpe.decode(byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN, ["doc_id", "text"]), RANKS, public_tokenizers.PATTERN, ["text"])
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both.collect())
    assert byte_bpe.round_trip(documents([]), RANKS, public_tokenizers.PATTERN, ["doc_id"]).count() == 0


def test_byte_bpe_merges_lower_rank_later():
    """A merge may make a pair of lower rank than its own, and equal ranks merge from the left."""
    ranks = {bytes([k]): k for k in range(256)} | {b"abc": 256, b"ab": 257, b"aa": 258}
    bpe = byte_bpe.ByteBpe(ranks, r"\S+")
    assert bpe.encode("abcab") == [256, 257]
    assert bpe.encode("aaaaa") == [258, 258, 97]


def brute_merge(ranks, piece):
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while pairs := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        _, k = min(pairs)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[x] for x in parts]


@pytest.mark.parametrize("wide, short", [(1, 256), (8, 256), (64, 256), (1, 20), (1 << 30, 256)])
def test_byte_bpe_merges_pre_tokens_together(monkeypatch, wide, short):
    """Pre-tokens in one queue get the ids that each gets alone, in vocabularies in which a merge may make a lower rank too."""
    monkeypatch.setattr(byte_bpe, "WIDE", wide)
    monkeypatch.setattr(byte_bpe, "SHORT", short)
    rng = random.Random(5)
    for n in range(60):
        longer = list({bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(rng.randint(0, 40))})
        rng.shuffle(longer)
        ranks = {x: k for k, x in enumerate(longer + [bytes([k]) for k in range(256)])}
        pieces = [bytes(rng.choices(b"abcd"[: rng.randint(1, 4)], k=rng.randint(1, 40))) for _ in range(rng.choice([1, 9, 300]))]
        bpe = byte_bpe.ByteBpe(ranks, r"\S+")
        want = [brute_merge(ranks, x) for x in pieces]
        assert [bpe.encode(x.decode()) for x in pieces] == want
        pieces = [x for x in pieces if x not in ranks]
        got = [byte_bpe.unpacked(x) for x in byte_bpe.ByteBpe(ranks, r"\S+").merge(pieces)]
        assert got == [brute_merge(ranks, x) for x in pieces]
        assert not any(bpe.buckets) and not any(bpe.low)
    with pytest.raises(KeyError):
        byte_bpe.ByteBpe({b"ab": 0, b"b": 1}, r"\S+").encode("aba")
    assert byte_bpe.ByteBpe({b"ab": 0, b"b": 1}, r"\S+").encode("abbab") == [0, 1, 0]


def test_byte_bpe_merges_once_a_slice(monkeypatch):
    """The new pre-tokens of a slice go through few queues, each distinct one once, and a known one through none."""
    bpe = byte_bpe.ByteBpe.load(RANKS, public_tokenizers.PATTERN)
    queues, merge = [], bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda pieces: queues.append(list(pieces)) or merge(pieces))
    texts = [None, "", *(" ".join(f"zqx{chr(97 + k % 26)}{chr(97 + k // 26)}wv" for k in range(a, a + 600)) for a in range(5)), "x" * 3 * byte_bpe.TOGETHER]
    got = bpe.encode_all(texts)
    assert [bpe.decode(byte_bpe.unpacked(x)) for x in got] == [(t or "").encode() for t in texts]
    merged = [x for q in queues for x in q]
    assert len(merged) == len(set(merged)) > 600
    assert len(queues) <= 2 + sum(map(len, merged)) // byte_bpe.TOGETHER
    queues.clear()
    assert bpe.encode_all(texts[:-1]) == got[:-1] and queues == []


def test_token_counts_and_cache(spark, odd, documents, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = token_cache.count_tokens(odd, cache, path, ["doc_id", "text"]).collect()
        assert len(got) == odd.count()
        for r in got:
            assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
            assert r.n_bytes == len((r.text or "").encode())
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count()  # the second run encoded nothing
    counter, whole = token_cache.Counter(path, True), token_cache.Counter(path, False)
    rng = random.Random(3)
    parts = ["a", "B", "é", "é", "́", " ", "\x1c", "　", "'s", "'", "9", "<|endoftext|>", "<|", "!", "İ", "Σ", "的", "😀"]
    texts = ["".join(rng.choices(parts, k=rng.choice([2, 9, 60]))).strip(" ") for _ in range(600)]
    assert list(counter.count(texts)) == list(whole.count(texts))
    assert token_cache.count_tokens(documents([]), f"{cache}-2", path, ["doc_id"]).count() == 0


def test_edit_study_by_brute_force(spark, odd, documents):
    rows = [(k * 7 % 101, f"text number {k} " * (k % 9), "en", "s") for k in range(60)]
    for docs in (odd, documents(rows), documents(rows[:1]), documents([])):
        got = simhash.edit_study(docs).collect()
        order = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
        want = []
        for k, (known, doc_id, text) in enumerate(order):
            after = order[(k + 1) % len(order)][2]
            changed = (text[: len(text) - len(text) // 2] + after[: len(text) // 2]).encode()
            own, new, following = (simhash.fingerprint(x) for x in (text.encode(), changed, after.encode()))
            want.append((doc_id if known else None, len(text), hashlib.sha256(changed).hexdigest(), own.hex(), new.hex(), simhash.likeness(own, new), simhash.likeness(own, following)))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_radius_search_by_brute_force(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(128) for _ in range(30)]
    for v in list(values):
        for flips in (1, 3, 4):
            near = v
            for bit in rng.sample(range(128), flips):
                near ^= 1 << bit
            values.append(near)
    prints = [f"{v:032x}" for v in values] + [None, f"{values[0]:032x}"]
    got = simhash.within_radius(spark.createDataFrame([(p,) for p in prints], "fingerprint string")).collect()
    want = {(a, b) for a in prints[:-2] for b in prints[:-2] if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 3}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def near_components(prints):
    """The smallest fingerprint that each of ``prints`` (hex) reaches by links of at most three bits."""
    values = sorted(set(prints))
    numbers = [int(p, 16) for p in values]
    label = list(range(len(values)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(values)):
        for b in range(a):
            if (numbers[a] ^ numbers[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {p: values[find(k)] for k, p in enumerate(values)}


def flipped(value, bits):
    for bit in bits:
        value ^= 1 << bit
    return value


def crowded_prints(rng):
    """Scattered fingerprints with neighbours, a dense cube, and many that share most bits and mostly lie four bits or more apart."""
    values = [rng.getrandbits(128) for _ in range(40)]
    values += [flipped(v, rng.sample(range(128), n)) for v in values for n in (1, 3, 4, 5)]
    center, other = rng.getrandbits(128), rng.getrandbits(128)
    values += [center ^ k for k in range(256)]
    values += [flipped(other, rng.sample(range(100, 124), rng.choice([4, 6, 8]))) for _ in range(400)]
    values += [flipped(other, rng.sample(range(0, 128, 5), 7)) for _ in range(300)]
    return [f"{v:032x}" for v in values]


def test_near_groups_by_brute_force(spark):
    prints = crowded_prints(random.Random(9))
    want = {p: low for p, low in near_components(prints).items() if p != low}
    assert len(set(want.values())) > 20
    table = spark.createDataFrame([(p,) for p in [*prints, *prints[:50], None]], "fingerprint string")
    for small in (simhash.SMALL, 64):
        got = simhash.near_groups(table, small=small).collect()
        assert {r.fingerprint: r.lowest for r in got} == want and len(got) == len(want)
    assert simhash.near_groups(table.limit(0)).count() == 0
    assert simhash.within_radius(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_groups(table, 4, 4)


@pytest.mark.parametrize("used", [0, (1 << 90) - 1, ((1 << 128) - 1) ^ 0b1111111 << 30])
def test_cuts_lose_no_link(used):
    """Fingerprints that agree on ``used`` and lie within the radius agree on one of the next masks; every mask is larger."""
    rng = random.Random(used)
    masks = simhash.cut(used, 4, 1)
    assert all(m & used == used and m != used for m in masks)
    free = [k for k in range(128) if not used >> k & 1]
    for _ in range(500):
        differ = flipped(0, rng.sample(free, rng.randrange(4)))
        assert any(differ & m == 0 for m in masks)


def test_wide_buckets_are_cut_anew(spark):
    """Two hundred fingerprints that agree on 96 bits but hardly link: tasks compare sixteen at a time."""
    rng = random.Random(10)
    found = []
    while len(found) < 200:
        new = rng.getrandbits(32)
        if all((new ^ x).bit_count() > 3 for x in found):
            found.append(new)
    found += [x ^ 0b1001 for x in found[:30]]
    prints = [f"{x:032x}" for x in found]
    got = simhash.near_groups(spark.createDataFrame([(p,) for p in prints], "fingerprint string"), small=16).collect()
    assert {r.fingerprint: r.lowest for r in got} == {p: low for p, low in near_components(prints).items() if p != low}


def test_near_ids(spark):
    a, b, far = "0" * 32, "0" * 31 + "7", "f" * 32
    rows = [(5, b, 1), (3, a, 1), (None, a, 2), (9, far, 1), (9, far, 1), (None, "5" * 32, 1), (8, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, fingerprint string, lowest int")
    got = simhash.with_near_id(docs.withColumnRenamed("lowest", "first")).collect()
    want = [(*r, {a: 3, b: 3, far: 9}.get(r[1])) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.with_near_id(docs.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><p>Welcome to the best site there is.</p></header>
<div id="cookie-notice"><p>We use cookies on this site. Please accept all of them.</p></div><nav><a href=1>Home</a></nav>
<main><div class="post-content with-sidebar"><h1>Title &amp; more</h1><p>First   paragraph, with a <a href=x>link</a> and&nbsp;text.<br>Same block.
<p>Second.<ul><li>one item<li>two items</ul><aside class="sidebar"><p>Buy this now. It is a really great product.</p></aside>
<script>var t="</p>";</script><form><label>Name</label></form></div>
<section class="comments"><h2>Comments</h2><p>I love this article so much, it is nice.</p><p>So do I, and all my friends.</p></section></main>
<footer>(c) me</footer></body></html>"""


@pytest.fixture(scope="session")
def page_model(spark):
    return page_tree.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def test_page_text(spark, page_model):
    want = "Title & more\nFirst paragraph, with a link and text. Same block.\nSecond.\none item\ntwo items"
    deep = "<article>" + "<div>" * 3000 + "<p>Deep text is found as well, however far down it is.</p>" + "</div>" * 3000 + "</article>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<nav>menu</nav>"), (5, "x", deep)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = page_tree.extract(pages, page_model, ["page_id", "url"]).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert texts == {1: want, 2: "", 3: "", 4: "", 5: "Deep text is found as well, however far down it is."}
    empty = page_tree.train(pages.limit(0))
    assert page_tree.extract(pages.limit(0), empty, ["page_id"]).count() == 0


FIRST, SECOND = "The first paragraph is long enough to stand for the text of an article, which it does.", "A second one follows it."
TWO = f"<p>{FIRST}<p>{SECOND}"


def test_page_text_without_article_markup(spark):
    """A table mostly of pages whose article sits in div or plain p keeps their text, with and without labelled pages."""
    nav, end = "<nav><a href=1>Home</a> <a href=2>News</a></nav>", "<footer>(c) me</footer>"
    plain = [f"<body>{nav}<div id=content>{TWO}</div>{end}", f"<body>{nav}{TWO}{end}", f"<body>{nav}<div class=x><div>{TWO}</div></div>{end}"]
    marked = f"<body>{nav}<article>{TWO}</article>{end}"
    rows = [(k, f"u{k}", plain[k % 3] if k % 10 else marked) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for some in (pages, pages.filter("page_id % 10 > 0")):
        got = page_tree.extract(some, page_tree.train(some), ["page_id"]).collect()
        assert {r.text for r in got} == {f"{FIRST}\n{SECOND}"}


@pytest.mark.parametrize(
    "start",
    ["<head><title>T</title>", "<title>T</title>", "<head><title>T</title><body>", "<head><noscript><link><body>"]
    + [f"<head></head><body><div><{t}></div>" for t in ("noscript", "iframe", "object", "select><option>a", "textarea", "template", "svg", "canvas")]
    + ["<body><iframe src=x><div>", "<body><noscript>a</noscript><object><iframe></iframe>"],
)
def test_page_text_of_open_tags(start, page_model):
    """An omitted end tag of the head, and silent elements that are never closed, do not take the rest of the page along."""
    assert page_tree.main_text(f"{start}{TWO}<iframe></iframe>", page_model) == f"{FIRST}\n{SECOND}"
    closed = f"<head><title>T</title></head><body><noscript><p>{FIRST}</p></noscript><select><option><p>no</select><template><div>{FIRST}</div></template>"
    assert page_tree.main_text(f"{closed}{TWO}", page_model) == f"{FIRST}\n{SECOND}"


def test_messages_by_enumeration():
    """Marginals equal those from summing over all labellings."""
    from itertools import product
    from math import exp

    parent, unary = [-1, 0, 0, 1, 1, 2], [0.3, -1.0, 2.0, 0.5, -0.2, 1.1]
    edge = {"00": 0.4, "01": -1.5, "10": 0.2, "11": 0.9}
    weight = {}
    for labels in product((0, 1), repeat=6):
        score = sum(u for u, y in zip(unary, labels) if y) + sum(edge[f"{labels[parent[k]]}{labels[k]}"] for k in range(1, 6))
        weight[labels] = exp(score)
    total = sum(weight.values())
    one, pairs = page_tree.marginals(parent, unary, edge)
    for k in range(6):
        assert one[k] == pytest.approx(sum(w for y, w in weight.items() if y[k]) / total)
        if k:
            want = [sum(w for y, w in weight.items() if (y[parent[k]], y[k]) == ab) / total for ab in ((0, 0), (0, 1), (1, 0), (1, 1))]
            assert pairs[k] == pytest.approx(want)


def test_language_sample_of_null_ids(spark, documents):
    """Rows that share an id, or a text, are sampled like others; kept columns with clashing names are replaced."""
    rows = [(None, f"the house of number {k % 50} is here", "en", "a") for k in range(3000)]
    rows += [(5, "la maison de la ville est ici", "fr", "b")] * 3000
    sample = language.sample_by_language(documents(rows), "doc_id", 600)
    counts = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert all(480 < counts[x] < 720 for x in ("en", "fr"))
    model = language.fit_languages(documents(rows), rows_per_language=100)
    docs = documents(rows[-1:] + rows[:1]).withColumn("a.b", F.lit(1))
    got = language.predict_languages(docs, model, ["doc_id", "score", "a.b", "text"])
    assert got.columns == ["doc_id", "a.b", "text", "lang_pred", "score", "ambiguous"]
    assert sorted((str(r.doc_id), r.text, r.lang_pred) for r in got.collect()) == [("5", rows[-1][1], "fr"), ("None", rows[0][1], "en")]
    with pytest.raises(ValueError):
        language.fit_languages(documents([(k, "some words", f"l{k}", "a") for k in range(language.MOST_LANGUAGES + 1)]))


def test_batches_are_cut_by_bytes():
    """Encoders see slices of bounded bytes, a longer text alone, with all rows in order."""
    texts = ["x" * n for n in (5, 0, 300, 2, 40, 40, 40)] + [None, "é"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(9)), "__text": texts}).slice(1)
    cut = list(hashing.pieces(batch, "__text", 100))
    assert [p.column("id").to_pylist() for p in cut] == [[1], [2], [3, 4, 5], [6, 7, 8]]
    assert [t for p in cut for t in p.column("__text").to_pylist()] == texts[1:]
    assert [len(p) for p in byte_bpe.slices(iter([batch]))] == [8]


def test_worker_keeps_one_operator():
    from postgrain.llm.workers import per_worker

    assert per_worker(("test_a", 1), lambda: "x") == "x" and per_worker(("test_a", 1), lambda: "y") == "x"
    per_worker(("test_b", 1), lambda: "z")
    assert per_worker(("test_a", 1), lambda: "y") == "y"


def test_lean_work_drops_what_other_operators_kept():
    """A task without values of its own leaves none of other operators beside its own memory; one with them keeps them."""
    from postgrain.llm.workers import lean, only, per_worker

    per_worker(("test_c", 1), lambda: "x")
    seen = []
    list(lean(lambda batches: seen.append(dict(only("test_c"))) or batches, "test_c")(iter([])))
    assert seen == [{("test_c", 1): "x"}]
    list(lean(lambda batches: batches)(iter([])))
    assert per_worker(("test_c", 1), lambda: "y") == "y"


def test_made_batches_leave_in_parts():
    from postgrain.llm.workers import BATCH_BYTES, lean

    text = ["é" * (k * 997 % 40_000) for k in range(200)] + [None, "", "z" * (2 * BATCH_BYTES)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(203)), "text": text}).slice(1)
    made = list(lean(lambda batches: batches)(iter([batch, batch.slice(0, 0), batch.slice(0, 3)])))
    assert pa.Table.from_batches(made).to_pydict() == pa.Table.from_batches([batch, batch.slice(0, 3)]).to_pydict()
    assert len(made) > 4 and all(b.nbytes < 2 * BATCH_BYTES or b.num_rows <= 50 for b in made)


def test_texts_reach_workers_in_batches_by_bytes(spark):
    """10,000 long texts would be one batch of any size; an executor holds several beside its heap."""
    from postgrain.llm.workers import BATCH_BYTES, BATCH_SETTING, mapped

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], ["n", "size"])

    rows = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("word "), 5000).alias("text"))
    before = spark.conf.get(BATCH_SETTING, None)
    try:
        spark.conf.unset(BATCH_SETTING)
        got = mapped(rows, sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 400 and max(r.size for r in got) < 1.5 * BATCH_BYTES
        spark.conf.set(BATCH_SETTING, "1m")
        assert max(r.size for r in mapped(rows, sizes, "n long, size long").collect()) < 1.5 * 2**20
        assert spark.conf.get(BATCH_SETTING) == "1m"
    finally:
        spark.conf.unset(BATCH_SETTING) if before is None else spark.conf.set(BATCH_SETTING, before)


def test_byte_cache_is_bounded(monkeypatch):
    import public_tokenizers

    bpe = byte_bpe.ByteBpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    monkeypatch.setattr(byte_bpe, "CACHED_BYTES", 40 * byte_bpe.ENTRY_BYTES)
    bpe.room = byte_bpe.CACHED_BYTES
    text = " ".join(f"word{k}" for k in range(500))
    assert bpe.decode(bpe.encode(text)) == text.encode()
    assert len(bpe.cache) <= 41 and len(bpe.older) <= 41
