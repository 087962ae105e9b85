"""Phrases, fill-in-middle and personal data against brute force on small inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import fill_middle, phrases, pii

DOCS = "doc_id bigint, text string, lang string"


def docs_of(spark, rows):
    """With further columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("n", "uid", "words", "phrase", "kind", "output", "h", "c")})


# -- phrases ----------------------------------------------------------------------------------


def brute_phrases(rows, least, most, top):
    grams, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, most + 1):
                grams[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in grams.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((lang, " ".join(p), a, f[p[:k]], f[p[k:]], total[lang], score))
        kept.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(kept[:top])]
    return sorted(out)


def phrase_rows(seed):
    rng = random.Random(seed)
    words = ["The", "the", "of", "a", "new", "york", "é", "日本", "x y", "\x1cz", "b\x00", "in"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\r\n", "  "]) for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "fr", None, "und", ""])))
    return [*rows, *rows[:5], (None, None, "en"), (1, "", "en"), (2, "...,,", None), (3, "new york " * 3000, "fr")]


@pytest.mark.parametrize(("seed", "least", "most", "tokens", "bits"), [(1, 10, 3, 500, 1 << 29), (2, 4, 4, 10**6, 1 << 15), (3, 10, 2, 1, 1 << 29)])
def test_phrases_match_brute_force(spark, monkeypatch, seed, least, most, tokens, bits):
    monkeypatch.setattr(phrases, "PART", 40)  # several salted parts a language
    rows = phrase_rows(seed)
    got = phrases.collocations(docs_of(spark, rows), least, most, 30, tokens=tokens, most_bits=bits)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute_phrases(rows, least, most, 30)


def test_phrase_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    rows = [("en", 0, "", 10**13), ("en", 1, "a", big + 1), ("en", 1, "b", big + 7), ("en", 2, "a b", big)]
    found = phrases.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, f bigint"))
    assert [r.score for r in found.collect()] == [10**6 * big * big // ((big + 1) * (big + 7))]


def test_no_phrases(spark):
    assert phrases.collocations(docs_of(spark, [(1, None, None)]).limit(0)).collect() == []
    assert phrases.collocations(docs_of(spark, [(1, None, None), (2, "a b", "en")])).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1,)], "doc_id bigint")).collect() == []


@pytest.mark.parametrize("words", [1, 2, 3, 5, 9])
def test_suffix_array_orders_by_words(words):
    ids = np.random.default_rng(words).integers(0, 3, 300).astype(np.int32)
    order = phrases.suffix_array(ids, np.arange(300), words)
    suffix = lambda i: (list(ids[i : i + words]) + [0] * words)[:words]
    assert sorted(order.tolist()) == list(range(300)) and all(suffix(a) <= suffix(b) for a, b in zip(order, order[1:], strict=False))
    lcp = phrases.common_prefixes(ids, order, words)
    for a, b, k in zip(order, order[1:], lcp[1:], strict=False):
        x, y = suffix(a), suffix(b)
        assert k == next((i for i in range(words) if x[i] != y[i]), words)


# -- fill in the middle -----------------------------------------------------------------------

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def brute_middle(doc_id, text):
    units, text = re.findall(UNIT, text or ""), text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def middle_rows():
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(["word", "é", "𝄞𝄞", " ", "\n", "\t\x0b", "<", "S>", "<P", "\x1c", "\x00"]) for _ in range(rng.randrange(40)))
    rows = [(i, text(), "en") for i in range(300)]
    return [*rows, *rows[:3], (None, "a b c d", None), (-5, "a b c d", None), (400, None, None), (401, "", None), (402, " \n", None), (403, "has <M> in it", None), (404, "w " * 200_000, None), (2**62, "x", None)]


def test_fill_middle_matches_brute_force_and_restores(spark):
    rows = middle_rows()
    made = fill_middle.transform(docs_of(spark, rows))
    got = sorted(((r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in made.collect()), key=repr)
    assert got == sorted(((i, brute_middle(i, t)) for i, t, _ in rows), key=repr)
    assert {form for _, (_, form, *_) in got} == {"plain", "spm", "psm"}
    back = sorted(((r.doc_id, r.text) for r in fill_middle.restore(made).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t, _ in rows), key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = sorted(tuple(r) for r in fill_middle.digest(docs_of(spark, rows[:300])).collect())
    assert found == sorted((i, *(b := brute_middle(i, t))[:4], sha(b[4]), sha(t)) for i, t, _ in rows[:300])
    assert fill_middle.digest(docs_of(spark, rows[:1]).limit(0)).collect() == []


def test_runs_cut_where_units_end():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", "é", "𝄞", " ", "\n", "\x0b"]) for _ in range(rng.randrange(30)))
        units = re.findall(UNIT, text)
        runs, chars = fill_middle.Runs.of(text), fill_middle.Runs.of(text, "char")
        assert runs.n_units == len(units) and [runs.cut(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]
        assert chars.n_units == len(text) and [chars.cut(k) for k in range(len(text) + 1)] == list(range(len(text) + 1))
        assert len(runs.starts) == len(re.findall(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", text))
    with pytest.raises(ValueError):
        fill_middle.Runs.of("a").cut(2)
    with pytest.raises(ValueError):
        fill_middle.Runs.of("a", "line")


# -- personal data ----------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TOKEN = r"""[^\s,;"'<>|]*[0-9@][^\s,;"'<>|]*(?: [(+]?[0-9][^\s,;"'<>|]*)*"""


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def brute_base(text):
    return [(k, m.start(), m.end()) for k, r in BASE.items() for m in re.finditer(r, text) if passes(k, m[0])]


def letters(text):
    return [w for w in re.split(r"[^a-zé]+", text.lower()) if w]


def brute_pii(texts):
    """Spans of every text by the method, with plain dictionaries."""
    order, rows, base = list(BASE), [], [brute_base(t) for t in texts]
    for n, text in enumerate(texts):
        for kind, regex in [*BASE.items(), ("possible", re.compile(TOKEN, re.ASCII))]:
            found = list(re.finditer(regex, text))
            for i, m in enumerate(found):
                before = text[found[i - 1].end() if i else 0 : m.start()][-pii.WINDOW :]
                after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else None][: pii.WINDOW]
                start, match = m.start(), m[0]
                if kind == "possible":
                    start += len(match) - len(match.lstrip("([{"))
                    match = match.lstrip("([{").rstrip(".:!?)]}")
                    size = len(re.sub("[^a-zA-Zé0-9]", "", match))
                    if size < pii.LEAST_CHARS or len(match) > pii.MOST_CHARS or any(a < start + len(match) and b > start for _, a, b in base[n]):
                        continue
                elif not passes(kind, match):
                    continue
                rows.append((n, kind, start, match, letters(before)[-2:], letters(after)[:2]))
    counted = Counter((match, side, words[last], " ".join(words) if len(words) == 2 else None) for _, _, _, match, before, after in rows for side, words, last in (("before", before, -1), ("after", after, 0)) if words)
    wide = {p for p, c in Counter((side, pair) for _, side, _, pair in counted if pair).items() if c >= pii.LEAST_SUPPORT}
    one = Counter(e[1:] for e in {(match, side, word) for match, side, word, _ in counted})
    edges, speaks = Counter(), set()
    for (match, side, word, pair), c in counted.items():
        if (side, pair) in wide:
            edges[match, side, pair] += c
            speaks.add((match, side, pair))
        if one[side, word] >= pii.LEAST_SUPPORT:
            edges[match, side, word] += c
            if (side, pair) not in wide:
                speaks.add((match, side, word))
    totals = Counter()
    for t in texts:
        w = letters(t)
        totals.update(w)
        totals.update(" ".join(p) for p in zip(w, w[1:], strict=False))
    own = Counter()
    for e, c in edges.items():
        own[e[1:]] += c
    seeds = {(m, k): pii.SURE for _, k, _, m, _, _ in rows if k != "possible"}
    named, found = {m for m, _ in seeds}, {}
    for _ in range(pii.ROUNDS):
        mass, support = Counter(), Counter()
        for (m, k), confidence in (seeds | found).items():
            for e, c in edges.items():
                if e[0] == m:
                    mass[(*e[1:], k)] += c * confidence
                    support[(*e[1:], k)] += 1
        conf = {p: mass[p] // (max(totals[p[1]], own[p[:2]]) + 1) for p in mass if support[p] >= pii.LEAST_SUPPORT}
        doubt = Counter()
        for e in speaks:
            for k in order:
                if e[0] not in named and conf.get((*e[1:], k), 0) >= pii.LEAST_CONFIDENCE:
                    doubt[e[0], k] += math.floor(-math.log(1 - conf[(*e[1:], k)] / pii.SURE) * pii.SURE)
        found = {i: c for i, d in doubt.items() if (c := math.floor((1 - math.exp(-d / pii.SURE)) * pii.SURE)) >= pii.ACCEPT}
    best = {}
    for (m, k), c in found.items():
        best[m] = min(best.get(m, (1, 0)), (-c, order.index(k)))
    out = [[(order.index(k), a, b) for k, a, b in spans] for spans in base]
    for n, kind, start, match, _, _ in rows:
        if kind == "possible" and match in best:
            out[n].append((best[match][1], start, start + len(match)))
    return [",".join(f"{order[k]}:{a}:{b}" for k, a, b in sorted(spans)) for spans in out]


def pii_texts():
    rng = random.Random(4)
    word = lambda: rng.choice("lorem ipsum dolor sit amet é consectetur the of".split())
    fill = lambda: " ".join(word() for _ in range(rng.randrange(1, 12)))
    ring = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    host = lambda: ".".join(str(rng.randrange(256)) for _ in range(4))
    texts = [f"{fill()} my phone number {ring()} {fill()}" for _ in range(30)] + [f"{fill()}\nwrite to mailbox {word()}{i}@m.example.com, {fill()}." for i in range(30)]
    texts += [f"{fill()} server address {host()} {fill()}" for _ in range(20)] + [f"{fill()} {rng.choice([host(), ring(), '4111 1111 1111 1111'])} {fill()}" for _ in range(40)]
    # unseen identifiers in the places of the seeds, the same one elsewhere, and a second round's context
    texts += [f"{fill()} my phone number (555) {rng.randrange(100, 999)}-4242. {fill()}" for _ in range(4)]
    texts += ["my phone number 020 7946 0018, thanks", "a text with 020 7946 0018 and no context", "write to mailbox root@localhost now", "server address fe80:12:7a:1 is down"]
    texts += [f"extension line {n} {fill()}" for n in ("020 7946 0018", "(555) 123-4242", "(555) 777-4242", "0800 123 987")] + [f"my phone number {n}" for n in ("(555) 123-4242", "(555) 777-4242")]
    # clean numbers where nothing speaks for an identifier
    texts += [f"{fill()} order number {rng.randrange(10**6, 10**7)} {fill()}" for _ in range(10)] + ["the of 1234567 the of", "version 2.0.0 of 2024-01-01 é"]
    return [*texts, *texts[:3], "", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.4 a@b.c_d@e.f x@y", "+1 2 +12345678 +123456789012345678 +1((((((((", "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1112 0000000000000000"]


def test_personal_data_matches_brute_force(spark):
    texts = pii_texts()
    docs = docs_of(spark, [(i, t, "en") for i, t in enumerate(texts)])
    for bound in (pii.BROADCAST_PATTERNS, 0):  # both ways to count the patterns' words
        got = {r.doc_id: r for r in pii.report(docs, bound).collect()}
        wanted = brute_pii(texts)
        assert {i: got[i].spans for i in got} == dict(enumerate(wanted))
    for i, t in enumerate(texts):
        base = brute_base(t)
        assert tuple(got[i][f"n_{k}"] for k in BASE) == tuple(sum(x[0] == k for x in base) for k in BASE)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    said = lambda t: [texts[i][int(a) : int(b)] for i in [texts.index(t)] for _, a, b in (s.split(":") for s in got[i].spans.split(","))]
    assert said("my phone number 020 7946 0018, thanks") == said("a text with 020 7946 0018 and no context") == ["020 7946 0018"]
    assert said("write to mailbox root@localhost now") == ["root@localhost"] and said("server address fe80:12:7a:1 is down") == ["fe80:12:7a:1"]
    assert all(got[i].spans == "" for i, t in enumerate(texts) if "order number" in t or "version" in t)


def test_personal_data_edges(spark):
    shapes = lambda n: ["a" * n, "1" * n, "a." * n + "@", "+1" + " (" * n, "x@" + "a." * n, "1 " * n, "1.2.3" * n, "a@b.c " * n, "1.2.3.4," * (n // 10)]
    long = [*shapes(1000), *shapes(60_000)]  # as the reference patterns are quadratic, only the first half is compared
    rows = [(None, "mail me@x.org", None), (1, None, None), (1, "", None), (2, "𝄞 me@x.org", None), *((10 + i, t, None) for i, t in enumerate(long))]
    got = [(r.doc_id, r.spans) for r in pii.report(docs_of(spark, rows)).collect()]
    assert sorted((x for x in got if x[0] is None or x[0] < 10), key=repr) == sorted([(None, "email:5:13"), (1, ""), (1, ""), (2, "email:2:10")], key=repr)
    assert [dict(got)[10 + i] for i in range(9)] == [",".join(f"{k}:{a}:{b}" for k, a, b in brute_base(t)) for t in long[:9]]
    assert dict(got)[10 + 17].count("ip:") == 6000 and dict(got)[10 + 16].count("email:") == 60_000
    assert pii.report(docs_of(spark, rows).limit(0)).collect() == [] and [tuple(r)[1:5] for r in pii.report(spark.createDataFrame([(1,)], "doc_id bigint")).collect()] == [(0, 0, 0, 0)]
