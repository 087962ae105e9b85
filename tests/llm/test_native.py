"""Quality rules, exact dedup, mixing and line templates against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skeinwork.llm import exact_dedup, line_templates, mixing, quality_rules

DOCS = "doc_id bigint, text string, lang string, source string, kept boolean, size int, keep_id string"
LONG = " ".join(f"word{i % 37} the of" for i in range(2000))
ROWS = [
    (1, "a b  c", "en", "s1", None, None, None),
    (2, "a\nb c", "en", None, None, None, None),
    (3, "", "de", "s1", None, None, None),
    (4, None, None, "s1", None, None, None),
    (4, None, None, "s1", None, None, None),
    (5, LONG, "en", "s2", None, None, None),
    (None, "abc", None, "s2", None, None, None),
    (6, "x y z x y z x y z q", "fr", "", None, None, None),
    (7, "line one is here 12\nline one is here 99\nother text stands alone today", "en", "s2", None, None, None),
    (8, "line one is here 7\nshort\nsomething else again is written", "en", "s2", None, None, None),
]
SPACES = " \t\n\x0b\x0c\r"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_counts_match_brute_force(docs):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.assess(docs).collect()}
    assert len(quality_rules.assess(docs).collect()) == len(ROWS)
    for doc_id, text, *_ in ROWS:
        w = words(text)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        r = got[(doc_id, len(w))]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_rejects_odd_histograms(spark):
    prose = "the river rose and the farmers moved their herds to higher ground with the help of all who were there on that day in spring as it was said"
    clean = [(i, " ".join(f"{w}{'' if j % 9 else '.'}" for j, w in enumerate((prose + f" number{i} ").split() * 3 if False else [*prose.split(), *prose.upper().lower().split()[::-1], f"n{i}"])), "en") for i in range(30)]
    junk = [(100, " ".join(f"%%{i}$$ ##{i * 7}&&" for i in range(60)), "en")]
    df = spark.createDataFrame(clean + junk, "doc_id bigint, text string, lang string")
    rows = {r.doc_id: r for r in quality_rules.assess(df).collect()}
    assert all(rows[i].kept for i in range(30)) and not rows[100].kept and not rows[100].base_failed
    assert {r.doc_id for r in quality_rules.keep_good(df).collect()} == set(range(30))


def test_language_without_reference_passes(spark):
    """Texts of another script are no junk where nothing tells how their language looks."""
    prose = " ".join(["the river rose and the farmers moved their herds to higher ground with the help of all who were there on that day"] * 5)
    rows = [(i, f"{prose} n{i} x{i}y z{i}" + "".join(f" w{i}v{j}" for j in range(120)), "en") for i in range(25)]
    rows += [(100, " ".join(f"слово{chr(0x430 + i % 30)}{chr(0x430 + i // 30)}" for i in range(200)), "ru")]
    got = {r.doc_id: r.kept for r in quality_rules.assess(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got[100] and all(got.values())


def test_every_language_has_a_reference(spark, monkeypatch):
    """Junk of the last of 203 languages is seen, also of no stated language, with references broadcast and shuffled."""
    rows = [(100 * k + i, " ".join(f"{'de la' if k == 202 else 'xu va'} {chr(97 + i)}{chr(97 + j % 26)}{'m' * (j // 26)}" for j in range(40)), f"l{k:03}") for k in range(203) for i in range(20 + (k < 202))]
    junk = " ".join(f"%%{i}$$ ##{i * 7}&&" for i in range(90))
    rows += [(90000, junk, "l202"), (90001, junk, None), (90002, rows[-1][1], None), (90003, junk, "few")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    default = None
    for bound in (None, 3):
        if bound:
            monkeypatch.setattr(quality_rules, "BROADCAST_LANGUAGES", bound)
        got = {r.doc_id: r for r in quality_rules.assess(df).collect()}
        assert len(got) == len(rows) and {i for i, r in got.items() if not r.kept} == {90000, 90001}
        assert got[90002].word_distance == pytest.approx(got[20219].word_distance)
        seen = {i: (round(r.char_distance, 9), round(r.word_distance, 9)) for i, r in got.items()}
        assert default in (None, seen)
        default = seen
    assert quality_rules.keep_good(df).count() == len(rows) - 2


def test_js_distance(spark):
    one = spark.range(1)
    d = lambda p, q: one.select(quality_rules.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first().d
    assert d([1.0, 0.0], [0.0, 1.0]) == pytest.approx(1.0) and d([0.5, 0.5], [0.5, 0.5]) == 0.0


@pytest.mark.parametrize("limit", [exact_dedup.BROADCAST_BYTES, 0])
def test_dedup_matches_brute_force(docs, limit):
    groups = {}
    for doc_id, text, *_ in ROWS:
        groups.setdefault("".join(c for c in text or "" if c not in SPACES), []).append((-len(text or ""), doc_id is None, doc_id))
    got = exact_dedup.membership(docs, limit).collect()
    assert len(got) == len(ROWS)
    for r in got:
        norm = next(n for n in groups if hashlib.sha256(n.encode()).hexdigest() == r.text_sha256)
        assert r.keep_id == min(groups[norm])[2] and r.group_size == len(groups[norm])
    assert sum(r.kept for r in got) == len(groups) == exact_dedup.deduplicate(docs, limit).count()
    assert exact_dedup.deduplicate(docs, limit).columns == docs.columns


def test_single_rows_dont_shuffle(spark, tmp_path):
    """Of 4,000 texts, 30 of them twice, few rows reach the shuffle by digest; bits count exactly."""
    rows = [(i, f"text number {i % 3970} stands alone", 1) for i in range(4000)]
    spark.createDataFrame(rows, "doc_id bigint, text string, __sk_sha int").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    keys = exact_dedup.digests(docs)
    filters, bits = exact_dedup.bloom(keys, "text_sha256", exact_dedup.BROADCAST_BYTES)
    maybe = {r.text_sha256 for r in exact_dedup.mark_possible(keys, "text_sha256", "x", filters, bits).where("x").collect()}
    twice = {hashlib.sha256(f"textnumber{i}standsalone".encode()).hexdigest() for i in range(30)}
    assert twice <= maybe and len(maybe) < 400
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(3970))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for out in (exact_dedup.membership(none), exact_dedup.deduplicate(none), quality_rules.assess(none), quality_rules.keep_good(none), mixing.mix(none), line_templates.clean(none)):
        assert out.count() == 0


def test_mix_reaches_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 50), f"s{i % 4}" if i % 4 else None) for i in range(1200)] + [(5000 + i, "x " * 10, "tiny") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, names = Counter(), sorted({r[2] for r in rows if r[2]}) + [None]
    for _, t, s in rows:
        sizes[s] += len(words(t))
    weight, total = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values())
    want, open_ = {}, set(names)
    while open_:  # fill by weight; whoever exceeds its ceiling gets that
        left = total - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            want |= share
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken in (0, r.size, 2 * r.size)
    assert all(abs(taken[s] - want[s]) <= 50 for s in names)
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_mixed_repeats_rows(spark, tmp_path):
    spark.createDataFrame([(i, "w " * 5, f"s{i % 3}", 1) for i in range(60)], "doc_id bigint, text string, source string, size int").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() * 5 == mixing.mix(docs).agg(F.sum("taken")).first()[0]


@pytest.mark.parametrize("limit", [mixing.BROADCAST_ROWS, 0])
def test_mix_spreads_repeated_rows(spark, limit):
    """3,000 rows alike are dealt to blocks, and each is decided by itself."""
    df = spark.createDataFrame([(1, "a b c d", "s", 9)] * 3000 + [(None, "e f", None, 8)] * 50, "doc_id bigint, text string, source string, copies int").repartition(6)
    got = mixing.mix(df).collect()
    assert len(got) == 3050 and abs(sum(r.taken for r in got if r.source) - 1.5 * 12100 + sum(r.taken for r in got if not r.source)) <= 6
    assert Counter(r.taken for r in got) == Counter(r.taken for r in mixing.mix(df.coalesce(2)).collect())
    out = mixing.mixed(df, broadcast_rows=limit)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)


def test_mix_handles_nulls(docs):
    assert mixing.mix(docs).count() == len(ROWS)


def test_line_templates(docs):
    got = {r.doc_id: r for r in line_templates.clean(docs).collect()}
    assert got[7].n_dropped == 1 and got[7].text == "line one is here 12\nother text stands alone today"
    assert got[8].text == "short\nsomething else again is written" and got[8].n_lines == 3
    assert got[5].text == LONG and got[3].text == "" and len(line_templates.clean(docs).collect()) == len(ROWS)


def test_leaf_template_is_voted_by_position(spark):
    mixed = "notice from the {} office about {} roads being closed".format
    rows = [(i, mixed(f"name{chr(97 + i)}", f"place{chr(97 + i)}")) for i in range(20)]
    rows += [(100 + i, "notice from the board said nothing more than was needed") for i in range(3)]
    got = {r.doc_id: r.n_dropped for r in line_templates.clean(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [i for i, n in sorted(got.items()) if not n] == [0, 100] and sum(got.values()) == 21


def test_short_lines_recur_too(spark):
    rows = [(i, f"All rights reserved.\n\n{i}\n2024\nこの文章は空白を含まない長い行です。\nown{chr(97 + i)} line") for i in range(3)]
    got = {r.doc_id: (r.n_lines, r.text) for r in line_templates.clean(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0: (6, rows[0][1]), 1: (6, "\n1\nownb line"), 2: (6, "\n2\nownc line")}


def test_lines_are_dropped_by_row(spark):
    shared = "the same line stands in here"
    rows = [(1, f"{shared}\nred apples grow on this tree"), (None, f"blue boats sail over that lake\n{shared}"), (None, f"{shared}\ngreen hills lie behind our house")]
    rows += [(2, "only in rows of one id\nfirst text is about old ships"), (2, "second text is about new trains\nonly in rows of one id")]
    got = sorted(r.text for r in line_templates.clean(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    text = "\n".join(got)
    assert all(text.count(x) == 1 for _, t in rows for x in t.split("\n")) and len(text.split("\n")) == 7 and rows[0][1] in got


def test_second_family_of_a_leaf_is_general_too(spark):
    """Two families of one token count and beginning; names stand in both, and columns clash."""
    rows = [(i, f"notice from the office about name{chr(97 + i)} and street{chr(97 + i)} being closed again today") for i in range(12)]
    rows += [(50 + i, f"notice from the harbour says boat{chr(97 + i)} will never sail any more until may") for i in range(6)]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id bigint, text string, n_lines int, __sk_parts string")
    out = line_templates.clean(df)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r["__sk_parts"]) for r in out.collect()}
    assert out.columns == ["doc_id", "__sk_parts", "text", "n_lines", "n_dropped"]
    assert got == {i: (1, int(i not in (0, 50)), "x") for i, _ in rows}


def test_lines_are_masked_once(spark, monkeypatch):
    """Texts are cut and masked once; odd white space, digits, rows of one doc_id or without any against brute force."""
    cut, calls, rnd = line_templates._lines, [], random.Random(9)
    monkeypatch.setattr(line_templates, "_lines", lambda docs: calls.append(1) or cut(docs))
    pool = ["seen on {} May\x0bby all", " seen  on x{}y May by all ", "  {} ", "\t", "", "{0} {0}", "{0}\r{0}\x0c", "<*>", "<*> {}", "one of\tthese three{} things", "one  of these {}x things\r", "straße № ٣ bleibt zu", "only here"]
    rows = [(rnd.choice([1, 2, 3, None]), "\n".join(rnd.choice(pool).format(rnd.choice("78")) for _ in range(rnd.randint(1, 6)))) for _ in range(60)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string")
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_templates.clean(df).collect())

    def key(line):
        raw = words(line)
        masked = ["<*>" if re.search("[0-9]", w) else w for w in raw]
        return tuple(raw if len(raw) < 4 and set(masked) <= {"<*>"} else masked)

    docs = sorted({(r.doc_id is None, r.doc_id or 0, r.h, r.text) for r in df.withColumn("h", F.xxhash64("text")).collect()})
    met = {}
    for at, (*_, text) in enumerate(docs):
        for i, line in enumerate(text.split("\n")):
            met.setdefault(key(line), []).append((at, i))
    lost = {x for k, at in met.items() if k and len({d for d, _ in at}) > 1 for x in at[1:]}
    want = Counter()
    for at, (none, d, _, text) in enumerate(docs):
        lines = text.split("\n")
        kept = [x for i, x in enumerate(lines) if (at, i) not in lost]
        want[(None if none else d, len(lines), len(lines) - len(kept), "\n".join(kept))] += (rows + rows[:5]).count((None if none else d, text))
    assert got == want and len(calls) == 1
