"""N-gram join, packing, archives, extraction, toxicity and language model on small inputs."""

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import html_extract, lm_scoring, ngram_join, packing, toxicity, warc
from skeinwork.llm.ngram_join import NgramJaccardJoin
from skeinwork.llm.queries import TOKENIZER


def near_docs(seed=5, groups=6, copies=9):
    rng, out, n = random.Random(seed), [], 0
    passage = " ".join(f"p{i}" for i in range(30))
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(12, 90))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                words += passage.split()
            out.append((n, " ".join(words)))
            n += 1
    return out


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.setdefault(i, set()).update({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        c = len(sets[a] & sets[b])
        if c and den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "num", "long_list"), [(4, 85, 6), (5, 80, 2)])
def test_join_matches_brute_force(spark, k, num, long_list):
    rows = [*near_docs(), (1000, None), (1001, ""), (1002, "one two"), (1003, "One  two"), (1004, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in NgramJaccardJoin(k, num, 100, long_list).classes(docs).collect()}
    assert got == brute_components(rows, k, num, 100)


def test_join_in_small_blocks_matches_brute_force(spark, monkeypatch):
    """Chains of documents that share most shingles: classes that leaders don't join are found in blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 7)
    rng, rows = random.Random(8), []
    base = [f"w{i}" for i in range(60)]
    for i in range(90):
        words = base[: rng.randrange(40, 60)]
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for num in (60, 85):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in NgramJaccardJoin(3, num, 100, 2).classes(docs).collect()}
        assert got == brute_components(rows, 3, num, 100)


def test_join_searches_each_text_of_an_id(spark):
    near = lambda i: " ".join([*(f"a{j}" for j in range(60)), f"z{i}"])
    other = lambda i: " ".join([*(f"b{j}" for j in range(60)), f"y{i}"])
    rows = [(5, other(0), 1), (9, near(0), 1), (9, other(0), 1), (11, near(1), 1), (20, "own words stand here", 1), (30, "q " * 300_000, 1), (31, "q " * 200_000, 1)]
    docs = spark.createDataFrame([(i, t, n, "x") for i, t, n in rows], "doc_id bigint, text string, n int, component string")
    got = sorted((r.doc_id, r.component_id) for r in NgramJaccardJoin().classes(docs).collect())
    assert got == [(5, 5), (9, 5), (9, 5), (11, 5), (20, 20), (30, 30), (31, 30)]
    kept = NgramJaccardJoin().keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [5, 20, 30]


def test_join_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")], "doc_id bigint, text string")
    got = [(r.doc_id, r.component_id) for r in NgramJaccardJoin().classes(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, None), (1, 1), (1, 1), (2, 1)], key=str)
    assert NgramJaccardJoin().classes(docs.limit(0)).count() == 0
    assert sorted(r.doc_id for r in NgramJaccardJoin().keep_one(docs.where("doc_id is not null")).collect()) == [1, 1]


def test_best_fit_and_bounds():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = np.sort(rng.integers(1, 101, 60))[::-1]
        bins = packing.best_fit(lengths, 100)
        load = np.bincount(bins, lengths)
        assert load.max() <= 100 and packing.lower_bound(lengths, 100) <= len(load)
    assert packing.lower_bound(np.full(9, 51), 100) == 9 and packing.lower_bound(np.full(9, 34), 100) == 5
    assert packing.lower_bound(np.array([], int), 100) == 0


def test_unmatched_tags_are_linear():
    import time

    for page in ("<button>" + "<div>" * 50_000 + "</section>" * 50_000, "<div>" * 50_000 + "</section>" * 50_000, "<button>" + "<div><ul>" * 25_000 + "</div>" * 25_000 + "<p>end"):
        began = time.perf_counter()
        html_extract.units(page)
        assert time.perf_counter() - began < 4


def test_bound_takes_thresholds_where_lengths_change_sides():
    lengths = np.array([1058] * 170 + [992] * 230)
    assert packing.lower_bound(lengths, 2048) == 285 == len(set(packing.best_fit(lengths, 2048)))
    rng = np.random.default_rng(2)
    for _ in range(60):  # never above what some packing needs
        size = int(rng.integers(5, 40))
        lengths = -np.sort(-rng.integers(1, size + 1, rng.integers(1, 9)))
        least = min(len(set(packing.best_fit(rng.permutation(lengths), size))) for _ in range(200))
        assert -(-int(lengths.sum()) // size) <= packing.lower_bound(lengths, size) <= least


@pytest.mark.parametrize("lengths", [[1058, 992], [1025, 1024], [700, 683], [900, 500, 650]])
def test_packing_ends_whatever_the_lengths(spark, lengths):
    rows = [(i, 0, 0, lengths[i % len(lengths)] if i % 7 else lengths[0], 0) for i in range(800)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECE), per_group=200).collect()
    load = {}
    for r in got:
        load[r.sequence_id] = load.get(r.sequence_id, 0) + r.length
    all_lengths = -np.sort(-np.array([r[3] for r in rows]))
    assert sorted(r.doc_id for r in got) == list(range(800)) and max(load.values()) <= 2048
    assert len(load) <= len(set(packing.best_fit(all_lengths, 2048))) + 4
    if lengths == [1058, 992]:
        assert len(load) == packing.lower_bound(all_lengths, 2048)


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["river", "Überfluss", "x1", "#", "  ", "​", "日本"]) for _ in range(rng.randrange(0, 900)))) for i in range(150)] + [(900, None), (901, "long " * 7000), (None, "a"), (902, "hello <|endoftext|> world"), (903, "same"), (904, "same")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = packing.pack(packing.pieces(docs, *TOKENIZER), per_group=60).collect()
    slow = Tokenizer.from_file(TOKENIZER[0])
    want = {}
    for i, t in rows:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        n = len(ids)
        first = n % 2048 or 2048 if n > 2048 else n
        cuts = [0, *range(first, n + 1, 2048)] if n > 2048 else [0, n]
        want |= {(i, k): (a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= packing.lower_bound(np.array([r.length for r in got]), 2048) + 2
    assert packing.pack(packing.pieces(docs.limit(0), *TOKENIZER)).count() == 0


def test_archives_round_trip(spark):
    import base64
    import hashlib

    rows = [(3, "http://a/ü?q=1", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "u", None), (5, "u", ""), (None, "u", "<p>x</p>"), (7, "v", "y" * 600_000), (7, "v", "z"), (8, "v", "y" * 600_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    index = warc.write_archives(pages)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(index).collect()), key=str)
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    firsts = {}
    for i, _, h in rows:
        firsts[h or ""] = min(x for x in (firsts.get(h or ""), i) if x is not None)
    want = sorted(((i, len((h or "").encode()), sha(h), "response" if firsts[h or ""] == i else "revisit", None if firsts[h or ""] == i else firsts[h or ""]) for i, _, h in rows), key=str)
    assert got == want
    for r in index.collect():
        fields, _, end = warc.parse(warc.BundleReader(r.bundle).record(r.frame, r.offset, r.length))
        assert fields["WARC-Record-ID"] == r.record_id and end == r.length
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    kinds = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(pages, least_bytes=9)).collect()}
    assert kinds[3] == "response" and kinds[8] == "revisit"
    again = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages, broadcast_rows=0)).collect()), key=str)
    assert again == want


def test_bundles_are_read_by_many_tasks(spark):
    pages = spark.createDataFrame([(i, f"<p>{i}</p>", "b") for i in range(400)], "page_id bigint, html string, bundle string").repartition(16)
    index = warc.write_archives(pages)
    found = warc.read_archives(index)
    assert index.select("bundle").distinct().count() == 16 and found.rdd.getNumPartitions() == 16
    assert sorted(r.page_id for r in found.collect()) == list(range(400))


def test_bundles_open_as_plain_zstandard(spark):
    import io

    import zstandard

    index = warc.write_archives(spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(50)], "page_id bigint, url string, html string")).collect()
    path = index[0].bundle.removeprefix("file://")
    with open(path, "rb") as f:
        data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
    assert data.count(b"WARC/1.1\r\n") == sum(r.bundle == index[0].bundle for r in index)


PAGE = """<!doctype html><html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><!-- <p>no</p> --><header><nav><a href=/>Home</a></nav></header>
<div id="cookie-banner">We use cookies on this site.</div><main><article><h1>Title &amp; more</h1><p>First <b>bold</b>word   of
a long enough paragraph, with <a href="x>y">a link</a>.</p><div class="ad">Buy now and save a lot.</div><p>Second paragraph stands here&nbsp;too.<br>After a break.</p>
<form><label>Mail</label><input></form></article><section class="comments"><p>I liked reading this very much, thank you.</p></section></main><aside><ul><li><a href=1>Other</a></li></ul></aside><footer>&copy; us</footer></body></html>"""


def test_extraction():
    want = "Title & more\nFirst boldword of a long enough paragraph, with a link.\nSecond paragraph stands here too. After a break."
    assert html_extract.main_text(PAGE) == want
    assert html_extract.main_text("") == "" and html_extract.main_text("<nav><a>Home</a></nav>") == ""
    cut = html_extract.main_text(PAGE[: PAGE.index("After")])
    assert cut.endswith("Second paragraph stands here too.")
    for page in html_extract.PAGES:
        inside = [" ".join(re.sub("<[^>]*>", "", x).split()) for x in re.findall(r"\[\[(.*?)\]\]", page, re.S)]
        assert html_extract.main_text(page.replace("[[", "").replace("]]", "")) == "\n".join(inside)


def test_hint_words_in_compounds_and_open_elements():
    body = "<p>The first paragraph has quite a few words in it, as articles do.</p><p>And so has the second one, which ends the page here.</p>"
    for name in ("content-header-main", "more-content", "article"):
        assert html_extract.main_text(f'<html><body><div class="{name}">{body}</div></body></html>').count("\n") == 1, name
    assert html_extract.main_text(f'<body><div class="tools"><button>Play<video src=x></div><div>{body}</div></body>').count("\n") == 1
    assert "Play" not in html_extract.main_text(f'<body><div><button><div>Play</div></button></div><article>{body}</article></body>')


def test_region_has_the_greatest_sum():
    """The scan against all regions of random scores."""
    rng = random.Random(3)
    word, tag = html_extract.weights()
    for _ in range(30):
        page = "".join(rng.choice(("<p>some words stand in here.</p>", "<nav><a href=1>Home</a></nav>", "<div class=ad>buy it now</div>", "<b>bold</b>", "<ul><li><a href=2>next</a></li></ul>")) for _ in range(12))
        found = html_extract.units(page)
        scores = [len(v.split()) * html_extract.word_weight(c) if k == "word" and c else tag.get(v, -0.2) if k == "tag" else 0.0 for k, v, c, _ in found]
        best = max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))
        lo, hi = html_extract.best_region(scores)
        assert sum(scores[lo:hi]) == pytest.approx(max(best, 0.0))


def test_extraction_is_linear_on_odd_pages():
    import time

    def seconds(n):
        began = time.process_time()
        html_extract.main_text("<p " + "a=\"b\" c='d' " * n + ">" + "text and words here. " * 9)
        return time.process_time() - began

    seconds(1000)
    assert seconds(200_000) < 8 * max(seconds(50_000), 0.02)
    for odd in ("<" * 200_000, "<a href='" * 40_000, "<p>" * 100_000, "<div class=\"x" * 30_000, "<script>" * 20_000):
        html_extract.main_text(odd)


def test_extraction_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "w", ""), (1, "u", PAGE)], "page_id bigint, url string, html string")
    rows = html_extract.extract(pages).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows) and html_extract.extract(pages.limit(0)).count() == 0


def test_toxicity(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [f"w{rng.randrange(3000)}" for _ in range(60)]
        if toxic:
            for _ in range(2):
                words[rng.randrange(60)] = rng.choice(["idiot", "Worthless.", f"zorp{rng.choice('abcdefgh')}a", "scum,"])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(9000, None, None, None), (None, "idiot scum", None, None), (9001, "x " * 60_000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs = docs.unionByName(docs.where("doc_id = 5")).withColumn("toxic", F.lit("clash")).withColumn("seen", F.lit(1))
    labs = spark.createDataFrame([*labels, (9000, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labs).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in range(600)) and held
    assert sum(got[i].predicted == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert got[9000].predicted == 0 and got[None].predicted == 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert toxicity.score(docs.limit(0), labs).count() == 0
    assert toxicity.score(docs, labs.limit(0)).where("doc_id is null").first().predicted == 1


def test_label_model_knows_copies():
    """A voter that repeats another hangs on it and adds next to nothing; quotes and marks hide no word."""
    rng = np.random.default_rng(5)
    y = (rng.random(4000) < 0.2).astype(int)
    vote = lambda up, down: np.where(rng.random(4000) < np.where(y == 1, up, down), 1, 0)
    a, b, c = vote(0.7, 0.05), vote(0.7, 0.05), vote(0.6, 0.05)
    noisy = np.where(rng.random(4000) < 0.1, 1 - y, y)
    plain, _ = toxicity.label_model(np.stack([a, b, c], 1).astype(np.int8), noisy)
    copied, parent = toxicity.label_model(np.stack([a, b, c, a, a], 1).astype(np.int8), noisy)
    assert parent[3] in (0, 4) and parent[4] in (0, 3)
    assert ((plain > 0.5) == y).mean() > (noisy == y).mean() + 0.05 and ((copied > 0.5) == y).mean() == ((plain > 0.5) == y).mean()
    voters = toxicity.Voters(["zorp-"])
    assert all(voters.votes(t)[0] == 1 for t in ("(idiot)", '"Moron', "idiot!!!", "loser...", "\u201cclown\u201d")) and voters.votes("zorpel")[len(toxicity.LEXICONS)] == 1


def test_label_model_in_blocks_is_the_whole_one(monkeypatch):
    """Blocks of 7 rows give what one block gives, and the classifier's slope is zero where it stops."""
    rng = np.random.default_rng(3)
    y = (rng.random(900) < 0.2).astype(int)
    votes = np.where(rng.random((900, 12)) < np.where(y[:, None] == 1, 0.4, 0.03), 1, 0).astype(np.int8)
    votes[:, 3] = np.where(rng.random(900) < 0.9, votes[:, 2], 0)
    got = []
    for rows in (7, 900):
        monkeypatch.setattr(toxicity, "ROWS", rows)
        post, parent = toxicity.label_model(votes, y)
        got.append((post, parent, toxicity.linear_classifier(votes, post)))
    assert np.allclose(got[0][0], got[1][0], atol=1e-9) and (got[0][1] == got[1][1]).all() and np.allclose(got[0][2], got[1][2], atol=1e-9)
    assert parent[3] == 2 or parent[2] == 3
    x, w = toxicity._features(votes), got[1][2]
    slope = x.T @ (post - 1 / (1 + np.exp(-(x @ w)))) - w
    assert np.abs(slope[w != 0]).max() < 1e-5


def test_language_model(spark):
    import math
    from collections import Counter

    rng = random.Random(4)
    pairs = {f"a{i}": f"b{i}" for i in range(20)}
    rows = [(i, " ".join(x for _ in range(60) for x in (lambda a: (a, pairs[a]))(f"A{rng.randrange(20)}".lower()))) for i in range(400)] + [(900, None), (None, "a1 new"), (901, "unknown")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    counts = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*(t or "").lower().split(), "\0end"])
    total = sum(counts.values())
    for i, t in rows:
        tokens = [*(t or "").lower().split(), "\0end"]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(base)
    held = [got[i] for i in range(400) if got[i].held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scoring.score(docs.limit(0)).count() == 0


def test_model_depends_on_the_documents_only(spark, monkeypatch):
    """1, 8 and 32 partitions, several parts, a very long and repeated rows: scores agree and beat the base by 5 %."""
    monkeypatch.setattr(lm_scoring, "PART_TOKENS", 12_000)
    rng = random.Random(6)
    rows = [(i, " ".join(f"a{k} b{k} c{k % 7}" for k in (rng.randrange(30) for _ in range(40)))) for i in range(250)]
    rows += [(700, " ".join(f"a{i % 30} b{i % 30}" for i in range(40_000))), (701, "a1 b1"), (701, "a1 b1"), (None, "a1 b1")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, uid int")
    runs = [sorted(((r.doc_id, r.score, r.base_score, r.held_out) for r in lm_scoring.score(docs.repartition(n)).collect()), key=str) for n in (1, 8, 32)]
    for run in runs[1:]:
        assert [(a, h) for a, _, _, h in run] == [(a, h) for a, _, _, h in runs[0]]
        assert np.allclose([s for _, s, _, _ in run], [s for _, s, _, _ in runs[0]], rtol=1e-6)
    held = [x for x in runs[0] if x[3]]
    assert held and sum(x[1] for x in held) > 0.95 * sum(x[2] for x in held)


@pytest.mark.parametrize("n", [1, 3, 50, 731])
def test_model_is_normalised(n):
    """Probabilities of all classes add up to 1 before and after training, scores far out of range included."""
    rng = np.random.default_rng(n)
    counts = np.sort(rng.integers(1, 1000, n))[::-1].astype(float)
    model = lm_scoring.LogBilinear.start(counts)
    trainer = lm_scoring.Trainer(model, counts, 3)
    for _ in range(30):
        trainer.step(rng.integers(0, n + 1, 64), rng.integers(0, n + 1, 64), rng.integers(0, n, 64))
    far = lm_scoring.LogBilinear(model.r, model.q * 2000, model.c1, model.c2, model.b)
    for m in (model, trainer.m, far):
        hidden = m.r[rng.integers(0, n + 1, 7)] @ m.c1 + m.r[rng.integers(0, n + 1, 7)] @ m.c2
        got = m.log_probabilities(np.repeat(hidden, n, 0), np.tile(np.arange(n), 7)).reshape(7, n)
        assert np.allclose(np.exp(got.astype(float)).sum(1), 1, atol=1e-3)


def test_training_learns_pairs_in_blocks():
    """A class inside a block that always follows another gets most of the probability there."""
    n, rng = 400, np.random.default_rng(2)
    trainer = lm_scoring.Trainer(lm_scoring.LogBilinear.start(np.ones(n)), np.ones(n), 1)
    for _ in range(600):
        near = rng.integers(0, n, 1024)
        trainer.step(np.full(1024, n), near, (near + 100) % n)
    m = trainer.m
    got = m.log_probabilities(m.r[:n] @ m.c1 + m.r[n] @ m.c2, (np.arange(n) + 100) % n)
    assert np.exp(got).mean() > 20 / n


def test_classes_grow_with_the_words():
    assert lm_scoring.own_words(10**8) == 20_000 and lm_scoring.own_words(100) == lm_scoring.LEAST_OWN


def test_equal_rows_over_many_parts(spark, monkeypatch):
    """A third of all rows equal and without an id, over many parts: all are scored, and alike."""
    monkeypatch.setattr(lm_scoring, "PART_TOKENS", 2_000)
    rows = [(None, "a b c d e f g h")] * 600 + [(i, f"w{i} a b c d e f g") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = lm_scoring.score(docs).collect()
    assert len(got) == 1800 and np.ptp([r.score for r in got if r.doc_id is None]) < 1e-6


def test_words_are_hashed_once_a_task(spark, monkeypatch):
    """What place tells of documents agrees with counting word by word; a rare word is hashed once however often it comes."""
    import pyarrow as pa

    class Rows:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def withColumn(self, *_):
            return self

    calls, rows = [], Rows()

    class Hashing:
        @staticmethod
        def xxh64_intdigest(word):
            calls.append(word)
            return zlib.crc32(word) + 1

    monkeypatch.setattr(lm_scoring, "xxhash", Hashing)
    monkeypatch.setattr(lm_scoring, "_rows", lambda _: rows)
    head = np.array([zlib.crc32(w) + 1 for w in (b"a", b"b", b"c")], np.int64)
    vocab = lm_scoring.Vocabulary(head, np.array([9, 8, 7]), 2, 2, np.array([0, 1, 3, 2, 3], np.int32), np.array([4.0, 6.0]), np.array([9.0, 8, 3, 12, 5]), 100, 40, 5)
    lm_scoring.place(None, vocab)
    texts = [b"a b rare1 A", b"", b"rare1 " * 1000, b"c rare2 c rare1 rare2", *(b"w%d a w%d" % (i % 7, i) for i in range(60))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([False] * len(texts)), pa.array(texts, pa.binary())], ["doc_id", "held_out", "text"])

    def surface(word):
        return zlib.crc32(word[-3:]) % lm_scoring.LETTERS % vocab.surface

    def found():
        return [r for b in rows.run(iter([batch])) for r in b.to_pylist()]

    got = found()
    assert len(calls) == len(set(calls)) == 3 + 2 + 60
    monkeypatch.setattr(lm_scoring, "SCORED", 40)
    monkeypatch.setattr(lm_scoring, "CACHE_WORDS", 10)
    for again, r, text in zip(found(), got, texts, strict=True):
        words = text.lower().split()
        rare = [w for w in words if w not in (b"a", b"b", b"c")]
        classes = [{b"a": 0, b"b": 1, b"c": 3}.get(w, 2 + surface(w)) for w in words]
        share = sum({b"a": 0, b"b": 0, b"c": np.log10(8 / 6)}.get(w, -np.log10(vocab.class_words[surface(w)])) for w in words)
        base = sum(np.log10({b"a": 10, b"b": 9, b"c": 8}.get(w, 1)) for w in words) + np.log10(6) - (len(words) + 1) * np.log10(141)
        assert (r["n_tokens"], r["known"]) == (len(words) + 1, len(words) - len(rare) + 1)
        assert r["base"] == pytest.approx(base) and r["share"] == pytest.approx(share)
        assert r["ids"] == np.array(classes, "<u2").tobytes()
        for x in (r, again):
            assert dict(zip(x["h"], x["c"], strict=True)) == {zlib.crc32(w) + 1: rare.count(w) for w in rare}
        assert {k: again[k] for k in ("n_tokens", "known", "base", "share", "ids")} == {k: r[k] for k in ("n_tokens", "known", "base", "share", "ids")}


def test_sums_of_gradients():
    """Rows that repeat in a batch move once, by the sum of their gradients."""
    rng = np.random.default_rng(8)
    rows, grads = rng.zipf(1.3, 3000) % 50, rng.normal(size=(3000, 6)).astype(np.float32)
    at, got = lm_scoring._sums(rows, 60, grads, np.arange(9000).reshape(3000, 3))
    want = np.zeros((60, 6))
    np.add.at(want, rows, grads)
    assert at.tolist() == sorted(set(rows.tolist())) and np.allclose(got, want[at], atol=1e-3)
    n = 30
    trainer = lm_scoring.Trainer(lm_scoring.LogBilinear.start(np.ones(n)), np.ones(n), 1)
    before = trainer.m.flat()
    trainer.step(np.array([n, 3, 3]), np.array([3, 3, 4]), np.array([1, 1, 20]))
    m, b = trainer.m, trainer.m.filled(before)
    assert sorted(set(np.flatnonzero((m.r != b.r).any(1)))) == [3, 4, n] and not trainer.q[:, -1].any()


@pytest.mark.parametrize("scale", [1, 30, 2000])
def test_normalisers_from_tables(monkeypatch, scale):
    """Normalisers of pairs of classes agree with those of their scores, scores far out of range included, with and without tables."""
    n, rng = 300, np.random.default_rng(9)
    start = lm_scoring.LogBilinear.start(np.arange(n, 0, -1.0))
    model = lm_scoring.LogBilinear(start.r * 3, start.q * scale, start.c1, start.c2, start.b)
    near, far = rng.integers(0, n + 1, 3000), rng.integers(0, n + 1, 3000)
    hidden = model.r[near] @ model.c1 + model.r[far] @ model.c2
    scores = (hidden.astype(float) @ model.q[: model.levels.tops].T + model.b[: model.levels.tops]).T
    most = scores.max(0)
    want = most + np.log(np.exp(scores - most).sum(0))
    for cells, tables in ((lm_scoring.MOST_CELLS, 2), (10, 0)):
        monkeypatch.setattr(lm_scoring, "MOST_CELLS", cells)
        contexts = lm_scoring.Contexts(model)
        got, sums = contexts.of(near, far)
        assert len(contexts.tables) == tables and np.allclose(got, hidden, atol=1e-6) and np.allclose(sums, want, rtol=1e-4, atol=1e-4)
    every = model.log_probabilities(np.repeat(got[:5], n, 0), np.tile(np.arange(n), 5), np.repeat(sums[:5], n))
    assert np.allclose(np.exp(every.astype(float)).reshape(5, n).sum(1), 1, atol=1e-3)
