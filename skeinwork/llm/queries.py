"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fill_middle, html_extract, line_templates, lm_scoring, mixing, packing, phrases, pii, quality_rules, toxicity, warc
from .common import table
from .ngram_join import NgramJaccardJoin

#: The vocabulary as the tokenizers library reads it, and the same as byte ranks.
TOKENIZER = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramJaccardJoin(k=4, num=85, den=100).classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.membership(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = packing.pieces(table(spark, sf_dir, "documents"), *TOKENIZER)
    return packing.pack(items).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.clean(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


SQL = {}

SQL["op5_exact_dedup"] = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS r
  FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, text_sha256 FROM ranked
"""

SQL["op3_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), entries AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
  common AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM entries a JOIN entries b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS (SELECT x, y FROM common UNION SELECT y, x FROM common),
  reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id
"""


_VOTE = """{name}_spread AS (SELECT leaf, w, unnest(range(4, len(toks) + 1)) AS pos, unnest(toks[4:]) AS tok FROM {t}
), {name}_best AS (SELECT leaf, pos, tok FROM {name}_spread GROUP BY leaf, pos, tok QUALIFY row_number() OVER (PARTITION BY leaf, pos ORDER BY sum(w) DESC, tok DESC) = 1
), {name}_base AS (SELECT leaf, list(tok ORDER BY pos) AS base FROM {name}_best GROUP BY leaf
), {name} AS (SELECT t.* FROM {t} t JOIN {name}_base b ON b.leaf = t.leaf WHERE 3 + len(list_filter(range(4, len(t.toks) + 1), lambda i: t.toks[i] = b.base[i - 3])) >= ceil(len(t.toks) * 0.7 - 1e-9)
)"""
SQL["op9_line_dedup"] = rf"""
WITH split AS (
  SELECT doc_id, i - 1 AS line_no, list_filter(regexp_split_to_array(parts[i], '[\x20\x09-\x0D]+'), lambda w: w <> '') AS raw
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), masked AS (SELECT *, list_transform(raw, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS m FROM split
), lines AS (SELECT doc_id, line_no, CASE WHEN len(m) < 4 AND len(list_filter(m, lambda w: w <> '<*>')) = 0 THEN raw ELSE m END AS toks FROM masked WHERE len(m) > 0
), leaves AS (SELECT *, concat(len(toks), ' ', toks[1], ' ', toks[2], ' ', toks[3]) AS leaf, array_to_string(toks, ' ') AS variant FROM lines
), tokens AS (SELECT leaf, variant, first(toks) AS toks, count(*) AS w, min(doc_id) AS a, max(doc_id) AS b FROM leaves GROUP BY leaf, variant
), forks AS (SELECT leaf FROM tokens GROUP BY leaf HAVING count(*) > 1 AND min(a) <> max(b)
), forked AS (SELECT leaf, variant, toks, w FROM tokens WHERE leaf IN (FROM forks)
), {_VOTE.format(name="level1", t="forked")}, rest AS (
  SELECT leaf AS trunk, leaf || ' ' || toks[-1] AS leaf, variant, toks, w FROM forked WHERE (leaf, variant) NOT IN (SELECT (leaf, variant) FROM level1)
), {_VOTE.format(name="level2", t="rest")}, named AS (
  SELECT t.leaf, t.variant, CASE WHEN a.leaf IS NOT NULL THEN 'leaf' WHEN b.leaf IS NOT NULL THEN 'below ' || b.leaf ELSE 'own ' || t.variant END AS template
  FROM tokens t LEFT JOIN level1 a ON a.leaf = t.leaf AND a.variant = t.variant LEFT JOIN level2 b ON b.trunk = t.leaf AND b.variant = t.variant
), ranked AS (
  SELECT doc_id, line_no, row_number() OVER (PARTITION BY l.leaf, template ORDER BY doc_id, line_no) > 1 AND min(doc_id) OVER w <> max(doc_id) OVER w AS gone
  FROM leaves l JOIN named n ON n.leaf = l.leaf AND n.variant = l.variant WINDOW w AS (PARTITION BY l.leaf, template)
), parts AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents)
SELECT p.doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(gone, false)) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY p.line_no) FILTER (NOT coalesce(gone, false)), '') AS text
FROM parts p LEFT JOIN ranked r ON r.doc_id = p.doc_id AND r.line_no = p.line_no GROUP BY p.doc_id
"""


SQL["op8_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM s
"""

_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_JSD = "sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: CASE WHEN {p}[i] > 0 THEN {p}[i] * log2(2 * {p}[i] / ({p}[i] + {q}[i])) ELSE 0 END + CASE WHEN {q}[i] > 0 THEN {q}[i] * log2(2 * {q}[i] / ({p}[i] + {q}[i])) ELSE 0 END)) / 2))"
_MEANS = "SELECT a.lang, a.c, b.h FROM (SELECT lang, list(m ORDER BY i) AS c FROM (SELECT lang, i, avg(cs[i]) AS m FROM {t}, range(1, {k} + 1) r(i) GROUP BY lang, i) GROUP BY lang) a JOIN (SELECT lang, list(m ORDER BY i) AS h FROM (SELECT lang, i, avg(hs[i]) AS m FROM {t}, range(1, {n} + 1) r(i) GROUP BY lang, i) GROUP BY lang) b ON a.lang = b.lang"
_COUNT = lambda chars: f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"
_SIZES = {"k": len(quality_rules.CHAR_CLASSES), "n": len(quality_rules.COMMON_WORDS) + 1}
SQL["op2_quality_rules"] = rf"""
WITH words AS (
  SELECT doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)
), grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE c > 1) GROUP BY doc_id
), counted AS (
  SELECT w.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) AS n_chars, {_COUNT("#*$%&|<>")} AS n_symbols, coalesce(c.n, 0) AS n_repeat_words,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, {_COUNT("a-z")} AS c1, {_COUNT("A-Z")} AS c2, {_COUNT("0-9")} AS c3, {_COUNT(".,;:!?''" + chr(34) + "()-")} AS c5, {_COUNT(r"^\x00-\x7F").replace("[^^", "[")} AS c7,
    list_transform({_LIST(quality_rules.COMMON_WORDS)}, lambda c: len(list_filter(w, lambda x: lower(regexp_replace(x, '[.,;:!?]+$', '')) = c))) AS hits
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM words) w LEFT JOIN covered c ON c.doc_id = w.doc_id
), shares AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    list_transform([c1, c2, c3, n_symbols, c5, word_chars - c1 - c2 - c3 - n_symbols - c5 - c7, c7, n_chars - word_chars], lambda x: x / greatest(n_chars, 1)) AS cs,
    list_transform(list_append(hits, n_words - list_sum(hits)), lambda x: x / greatest(n_words, 1)) AS hs
  FROM counted
), good AS (SELECT * FROM shares WHERE NOT base_failed AND lang IN (SELECT lang FROM shares WHERE NOT base_failed GROUP BY lang HAVING count(*) >= {quality_rules.LEAST_DOCS})
), first AS ({_MEANS.format(t="good", **_SIZES)}
), near AS (SELECT g.* FROM good g JOIN first f ON f.lang = g.lang WHERE {_JSD.format(p="cs", q="f.c")} <= {quality_rules.TRIM} AND {_JSD.format(p="hs", q="f.h")} <= {2 * quality_rules.TRIM}
), again AS (FROM ({_MEANS.format(t="near", **_SIZES)}) WHERE lang IN (SELECT lang FROM near GROUP BY lang HAVING count(*) >= {quality_rules.LEAST_DOCS})
), refs AS (FROM again UNION ALL SELECT * FROM first WHERE lang NOT IN (SELECT lang FROM again)
), judged AS (
  SELECT s.doc_id, min({_JSD.format(p="s.cs", q="r.c")}) AS dc, min({_JSD.format(p="s.hs", q="r.h")}) AS dw
  FROM shares s JOIN refs r ON r.lang = s.lang OR s.lang IS NULL GROUP BY s.doc_id
)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce((n_chars >= {quality_rules.GUARD_CHARS} AND dc > {quality_rules.MAX_CHAR_DISTANCE}) OR (n_words >= {quality_rules.GUARD_WORDS} AND dw > {quality_rules.MAX_WORD_DISTANCE}), false) AS kept
FROM shares s LEFT JOIN judged j ON j.doc_id = s.doc_id
"""


SQL["op11_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), spread AS (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (VALUES (1), (2), (3)) s(n) WHERE len(w) >= n
), grams AS (SELECT lang, n AS k, w[i:i + n - 1] AS p, count(*) AS f FROM spread GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang
), candidates AS (SELECT lang, k AS size, p, f AS a FROM grams WHERE k > 1 AND f >= 10
), cuts AS (SELECT lang, size, p, a, unnest(range(1, size)) AS cut FROM candidates
), scores AS (
  SELECT c.lang, c.size, c.p, c.a, c.cut, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.p = c.p[1:c.cut] JOIN grams y ON y.lang = c.lang AND y.p = c.p[c.cut + 1:c.size]
), lowest AS (FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), around AS (SELECT lang, q, max(a) AS longer FROM (SELECT lang, a, unnest([p[1:2], p[2:3]]) AS q FROM candidates WHERE size = 3) GROUP BY lang, q
), kept AS (SELECT s.*, array_to_string(s.p, ' ') AS phrase FROM lowest s LEFT JOIN around o ON o.lang = s.lang AND o.q = s.p WHERE o.longer IS NULL OR 100 * o.longer < 50 * s.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""

SQL["op12_fill_in_middle"] = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256(concat('42:', doc_id)) AS h FROM documents
), drawn AS (
  SELECT *, list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, CAST(8 * i + 1 AS INTEGER), 8) AS BIGINT)) AS d, len(u) AS n FROM units
), cuts AS (
  SELECT *, array_to_string(u[1:least(d[1] % (n + 1), d[2] % (n + 1))], '') AS pre, array_to_string(u[least(d[1] % (n + 1), d[2] % (n + 1)) + 1:greatest(d[1] % (n + 1), d[2] % (n + 1))], '') AS mid,
    array_to_string(u[greatest(d[1] % (n + 1), d[2] % (n + 1)) + 1:], '') AS suf,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM cuts
"""


_FOUND = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "possible": r"""[^\s,;"''<>|]*[0-9@][^\s,;"''<>|]*(?: [(+]?[0-9][^\s,;"''<>|]*)*""",
}
_WORDS = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}]+'), lambda w: w <> '')"
_CUT = " UNION ALL ".join(f"SELECT uid, '{k}' AS kind, regexp_extract_all(t, '{r}') AS ms, regexp_split_to_array(t, '{r}') AS gs FROM docs WHERE regexp_matches(t, '[0-9@]')" for k, r in _FOUND.items())
_ROUND = f"""scored{{i}} AS (SELECT side, words, kind, sum(n * confidence) AS mass, count(*) AS support FROM graph JOIN known{{j}} USING (instance) GROUP BY ALL
), patterns{{i}} AS (SELECT side, words, kind, mass // (total + 1) AS c FROM scored{{i}} JOIN totals USING (side, words) WHERE support >= {pii.LEAST_SUPPORT} AND mass // (total + 1) >= {pii.LEAST_CONFIDENCE}
), met{{i}} AS (SELECT instance, kind, sum(CAST(floor(-ln(1 - c / {pii.SURE}) * {pii.SURE}) AS BIGINT)) AS doubt FROM graph JOIN patterns{{i}} USING (side, words) WHERE speaks AND instance NOT IN (SELECT instance FROM seeds) GROUP BY ALL
), found{{i}} AS (SELECT instance, kind, CAST(floor((1 - exp(-doubt / {pii.SURE})) * {pii.SURE}) AS BIGINT) AS confidence FROM met{{i}} WHERE floor((1 - exp(-doubt / {pii.SURE})) * {pii.SURE}) >= {pii.ACCEPT}
), known{{i}} AS (FROM seeds UNION ALL FROM found{{i}}
), """
SQL["op13_personal_data"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents
), cut AS ({_CUT}
), items AS (SELECT uid, kind, i, ms[i] AS m, length(gs[i]) AS gap, {_WORDS.format(x="right(gs[i], 100)")} AS b, {_WORDS.format(x="left(gs[i + 1], 100)")} AS a FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM cut)
), placed AS (SELECT *, sum(gap + length(m)) OVER (PARTITION BY uid, kind ORDER BY i) - length(m) AS s FROM items
), trimmed AS (
  SELECT uid, kind, b[-2:] AS before, a[1:2] AS after, CASE WHEN kind = 'possible' THEN s + length(m) - length(ltrim(m, '([{{')) ELSE s END AS s, CASE WHEN kind = 'possible' THEN rtrim(ltrim(m, '([{{'), '.:!?)]}}') ELSE m END AS m FROM placed
), tested AS (SELECT *, s + length(m) AS e, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM trimmed
), judged AS (
  SELECT *, CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: TRY_CAST(x AS HUGEINT) > 255)) = 0 WHEN 'phone' THEN length(d) BETWEEN 8 AND 15
    WHEN 'card' THEN length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INTEGER) ELSE 2 * CAST(d[i] AS INTEGER) - CASE WHEN CAST(d[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    ELSE length(regexp_replace(m, '[^\p{{L}}0-9]', '', 'g')) >= {pii.LEAST_CHARS} AND length(m) <= {pii.MOST_CHARS} END AS valid FROM tested
), base AS (SELECT * FROM judged WHERE valid AND kind <> 'possible'
), possible AS (SELECT * FROM judged c WHERE valid AND kind = 'possible' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.uid = c.uid AND b.s < c.e AND b.e > c.s)
), rows AS (SELECT *, CASE WHEN length(m) <= {pii.MOST_CHARS} THEN m ELSE sha256(m) END AS instance FROM (FROM base UNION ALL FROM possible)
), seen AS (
  SELECT instance, 'before' AS side, before[-1] AS one, CASE WHEN len(before) = 2 THEN array_to_string(before, ' ') END AS pair FROM rows
  UNION ALL SELECT instance, 'after', after[1], CASE WHEN len(after) = 2 THEN array_to_string(after, ' ') END FROM rows
), counted AS (SELECT instance, side, one, pair, count(*) AS n FROM seen WHERE one IS NOT NULL GROUP BY ALL
), marked AS (SELECT *, coalesce(pair IS NOT NULL AND (side, pair) IN (SELECT (side, pair) FROM counted WHERE pair IS NOT NULL GROUP BY side, pair HAVING count(*) >= {pii.LEAST_SUPPORT}), false) AS wide FROM counted
), graph AS (
  SELECT instance, side, pair AS words, n, true AS speaks FROM marked WHERE wide UNION ALL
  SELECT instance, side, one, sum(n), bool_or(NOT wide) FROM marked WHERE (side, one) IN (SELECT (side, one) FROM counted GROUP BY side, one HAVING count(DISTINCT instance) >= {pii.LEAST_SUPPORT}) GROUP BY instance, side, one
), text_words AS (SELECT {_WORDS.format(x="t")} AS w FROM docs
), every AS (SELECT words, count(*) AS total FROM (SELECT unnest(w) AS words FROM text_words UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM text_words)) GROUP BY words
), totals AS (SELECT side, words, greatest(coalesce(max(total), 0), sum(n)) AS total FROM graph LEFT JOIN every USING (words) GROUP BY side, words
), seeds AS (SELECT DISTINCT instance, kind, {pii.SURE} AS confidence FROM rows WHERE kind <> 'possible'
), {"".join(_ROUND.format(i=i + 1, j=i) for i in range(pii.ROUNDS)).replace("known0", "seeds")}chosen AS (
  SELECT * FROM found{pii.ROUNDS} QUALIFY row_number() OVER (PARTITION BY instance ORDER BY confidence DESC, list_position({list(pii.KINDS)}, kind)) = 1
), all_spans AS (SELECT uid, kind, s, e, true AS base FROM base UNION ALL SELECT r.uid, c.kind, r.s, r.e, false FROM rows r JOIN chosen c ON c.instance = r.instance WHERE r.kind = 'possible'
), said AS (SELECT *, concat(kind, ':', s, ':', e) AS x, list_position({list(pii.KINDS)}, kind) AS o FROM all_spans
), by_doc AS (
  SELECT uid, {", ".join(f"count(*) FILTER (base AND kind = '{k}') AS n_{k}" for k in pii.KINDS)}, sha256(coalesce(string_agg(x, ',' ORDER BY o, s) FILTER (base), '')) AS base_sha256, string_agg(x, ',' ORDER BY o, s) AS spans FROM said GROUP BY uid
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN by_doc USING (uid)
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
