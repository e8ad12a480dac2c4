"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from .lines import LineParams
from .mixing import HEX, PART, TERMS, MixParams
from .quality import QualityParams
from .substring import SubstringParams


def _quality() -> str:
    p = QualityParams()
    has = lambda rx: f"len(regexp_extract_all(t, '{rx}'))"
    lower, upper = has("[a-z]"), has(r"[\p{Lu}]")
    classes = [lower, upper, rf"({has(r'[\p{L}]')} - {lower} - {upper})", has("[0-9]"), has(r"[\x20\x09-\x0D]"), has("[.,;:''()-]")]
    cls = ", ".join(classes)
    k = p.n_common
    counts = f"list_transform(range(1, {k + 1}), lambda i: len(list_filter(lw, lambda x: x = words[i])))"
    share = lambda c: f"list_transform({c}, lambda x: CASE WHEN list_sum({c}) > 0 THEN x / list_sum({c})::DOUBLE ELSE 0.0 END)"
    mean = lambda c, size: "[" + ", ".join(f"sum(round({c}[{i}] * 1000000)::BIGINT) / count(*) / 1000000" for i in range(1, size + 1)) + "]"
    js = lambda a, b: (
        f"sqrt(greatest(0.0, list_sum(list_transform(range(1, len({a}) + 1), lambda i: "
        f"CASE WHEN {a}[i] > 0 THEN {a}[i] * log2({a}[i] / (({a}[i] + {b}[i]) / 2)) ELSE 0.0 END + "
        f"CASE WHEN {b}[i] > 0 THEN {b}[i] * log2({b}[i] / (({a}[i] + {b}[i]) / 2)) ELSE 0.0 END)) / 2))"
    )
    return rf"""
WITH a AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}]+'), lambda x: x <> '') AS lw
  FROM documents),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
    SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM a WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY 1),
f AS (
  SELECT a.doc_id, lang, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, list_append([{cls}], 0) AS c0, length(t) AS chars,
         lw
  FROM a LEFT JOIN r USING (doc_id)),
h AS (SELECT *, list_append(c0[1:{len(classes)}], chars - list_sum(c0)) AS c, c0[1] + c0[2] + c0[3] AS letters,
             n_words < {p.min_words} OR 100 * n_repeat_words > {p.max_repeat_percent} * n_words AS base_failed FROM f),
s AS (SELECT *, {share('c')} AS pc FROM h),
tw AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(lw) AS word FROM a WHERE lang IS NOT NULL) GROUP BY 1, 2),
tk AS (SELECT lang, list(word ORDER BY i) AS words FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS i FROM tw) WHERE i <= {k} GROUP BY 1),
tl AS (SELECT tk.* FROM tk JOIN (SELECT lang FROM documents GROUP BY 1 HAVING count(*) >= {p.min_docs}) USING (lang)),
x AS (SELECT s.doc_id, s.lang, tl.lang AS ref, base_failed, letters, pc, {counts} AS v0, len(lw) AS runs FROM s, tl),
y AS (SELECT *, {share('list_append(v0, runs - list_sum(v0))')} AS pv FROM x),
refs AS (SELECT ref, {mean('pc', len(classes) + 1)} AS rc, {mean('pv', k + 1)} AS rv
         FROM y WHERE lang = ref AND NOT base_failed AND letters >= {p.min_letters} GROUP BY 1),
d AS (SELECT doc_id, lang, ref, round({js('pc', 'rc')}, 6) AS dc, round({js('pv', 'rv')}, 6) AS dv, round({js('pc', 'rc')} + {js('pv', 'rv')}, 6) AS ds
      FROM y JOIN refs USING (ref) WHERE letters >= {p.min_letters}),
m AS (SELECT doc_id, ref, dc, dv FROM d
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN lang = ref AND dc <= {p.max_class_distance} AND dv <= {p.max_word_distance} THEN 0 ELSE 1 END, ds, ref) = 1)
SELECT h.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(dc > {p.max_class_distance} OR dv > {p.max_word_distance}, false) AS kept,
       ref AS ref_lang, dc AS class_distance, dv AS word_distance
FROM h LEFT JOIN m USING (doc_id)"""


def mixing_sql(docs: str = "documents", columns: str = "doc_id, source, copy, shuffle_key, n_chars, text") -> str:
    """Rows of the mixing operator with its default parameters over ``docs``."""
    seed = MixParams().seed
    key = lambda tag, part: f"('0x' || substr(md5('{seed}{tag}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || ({part})::VARCHAR), 1, {HEX}))::BIGINT"
    return f"""
WITH n AS (SELECT source, count(*) AS n FROM {docs} GROUP BY 1),
r AS (SELECT source AS src, (SELECT sum(n) FROM n)::DOUBLE / ((SELECT count(*) FROM n)::DOUBLE * n) AS rate FROM n),
q AS (SELECT src, greatest(1, ceil(rate / {PART})::INT) AS parts, rate / greatest(1, ceil(rate / {PART})::INT) AS l FROM r),
f AS (SELECT src, k, exp(-l) * exp(sum(CASE WHEN k = 0 THEN 0.0 ELSE ln(l / k) END) OVER (PARTITION BY src ORDER BY k)) AS pk, parts
      FROM q, (SELECT unnest(range(0, {TERMS})) AS k)),
c AS (SELECT src, any_value(parts) AS parts, list(cdf ORDER BY k) AS cdf
      FROM (SELECT src, parts, k, sum(pk) OVER (PARTITION BY src ORDER BY k) AS cdf FROM f) GROUP BY src),
d AS (SELECT t.*, list_sum(list_transform(range(0, parts), lambda j: len(list_filter(cdf, lambda x: x <= {key("u", "j")} / 16.0 ** {HEX})))) AS copies
      FROM {docs} t JOIN c ON t.source IS NOT DISTINCT FROM c.src),
e AS (SELECT *, unnest(range(0, copies::BIGINT))::INT AS copy FROM d)
SELECT {columns} FROM (SELECT *, {key("s", "copy")} AS shuffle_key FROM e)"""


SUBSTRING = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
g AS (SELECT doc_id, pos, string_agg(word, ' ') OVER v AS k, count(*) OVER v AS n FROM p
      WINDOW v AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {SubstringParams().window - 1} FOLLOWING)),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) > 1 AS again FROM g WHERE n = {SubstringParams().window}),
c AS (SELECT p.doc_id, p.pos, word, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN {SubstringParams().window - 1} PRECEDING AND CURRENT ROW) = 1 AS gone
      FROM p LEFT JOIN f USING (doc_id, pos))
SELECT d.doc_id, count(word) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN c USING (doc_id) GROUP BY 1"""

def _lines() -> str:
    """Candidates by shared segments; then furthest places reached with 0, 1, ... edits, a match of letters being free."""
    p = LineParams()
    edits = lambda n: f"(CASE WHEN {n} < {p.min_edit_chars} THEN 0 ELSE greatest(1, least({p.most_edits}, {n} // {p.chars_per_edit})) END)"
    start = "(n // (e + 1)) * seg + greatest(0, seg - (e + 1 - n % (e + 1))) + 1"
    width = "n // (e + 1) + CASE WHEN seg >= e + 1 - n % (e + 1) THEN 1 ELSE 0 END"
    same = lambda i, j: f"len(list_filter(range(1, least(length(a) - ({i}), length(b) - ({j})) + 1), lambda t: substring(a, ({i}) + 1, t) = substring(b, ({j}) + 1, t)))"
    return rf"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
c AS (SELECT *, regexp_matches(line, '[^ 	-
]') AS worded FROM l),
f AS (SELECT line, length(line) AS len, doc_id AS k, pos AS p FROM c WHERE worded QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1),
z AS (SELECT line, len, d, len - d AS n, {edits("(len - d)")} AS e FROM f, (SELECT unnest(range(0, {p.most_edits + 1})) AS d) WHERE len > d),
y AS (SELECT *, unnest(range(0, e + 1)) AS seg FROM z WHERE e > 0 AND d <= e),
i AS (SELECT line, n, seg, substring(line, {start}, {width}) AS s FROM y WHERE d = 0),
q AS (SELECT line, n, seg, substring(line, {start} + o, {width}) AS s FROM (SELECT *, unnest(range(greatest(-seg, d - e + seg), least(seg, d + e - seg) + 1)) AS o FROM y) WHERE {start} + o >= 1),
t AS (SELECT DISTINCT i.line AS a, q.line AS b, {edits("length(i.line)")} AS most FROM i JOIN q USING (n, seg, s) WHERE i.line <> q.line AND (length(q.line) > length(i.line) OR i.line < q.line)),
r AS (
  SELECT a, b, most, {same("0", "0")} AS i, {same("0", "0")} AS j, 0 AS e FROM t
  UNION
  SELECT a, b, most, x + {same("x", "y")}, y + {same("x", "y")}, e + 1
  FROM (SELECT a, b, most, e, i + di AS x, j + dj AS y FROM r, (VALUES (1, 1), (1, 0), (0, 1)) v(di, dj) WHERE e < most AND (i < length(a) OR j < length(b)) AND i + di <= length(a) AND j + dj <= length(b))),
g AS (SELECT DISTINCT a, b FROM r WHERE i = length(a) AND j = length(b)),
u AS (SELECT x.line AS one, y.line AS other, x.k AS one_k, x.p AS one_p, y.k AS other_k, y.p AS other_p
      FROM (SELECT a, b FROM g UNION ALL SELECT b, a FROM g) g2 JOIN f x ON x.line = g2.a JOIN f y ON y.line = g2.b),
d AS (SELECT one AS line, count(*) AS links, min(other_k) FILTER ((other_k, other_p) < (one_k, one_p)) AS near_k FROM u GROUP BY 1),
m AS (SELECT c.*, coalesce(d.links, 0) AS links, f.line IS NOT NULL AND (c.doc_id, c.pos) <> (f.k, f.p) AS again, near_k, f.k AS first_k FROM c LEFT JOIN f USING (line) LEFT JOIN d USING (line)),
w AS (SELECT *, NOT again AND near_k IS NOT NULL AS near FROM m),
s AS (SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (again) AS n_exact, count(*) FILTER (near) AS n_near, sum(links)::BIGINT AS n_links,
        coalesce(list_sort(list_distinct(list(CASE WHEN again THEN first_k ELSE near_k END) FILTER (again OR near))), []) AS dup_of, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT again AND NOT near) AS kept FROM w GROUP BY 1)
SELECT d.doc_id, n_lines, n_exact, n_near, n_links, dup_of, CASE WHEN text IS NOT NULL THEN length(coalesce(kept, '')) END AS n_chars, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d JOIN s USING (doc_id)"""


_CRC = "list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING = rf"""
WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
b AS (SELECT run, c, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS bytes FROM r),
t AS (SELECT {_CRC} AS tbl),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, bytes), lambda s, y: xor(tbl[(xor(s, y) & 255) + 1], s >> 8)), 4294967295) AS h FROM b, t),
o AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM o WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
x AS (SELECT word, i, length(word) AS len, substring(word, 1, i - 1) || substring(word, i + 1) AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
d AS (SELECT x.word AS long, w.word AS short FROM x JOIN w ON cut = w.word),
p AS (SELECT a.word AS word, b.word AS other FROM x a JOIN x b USING (i, len, cut) WHERE a.word <> b.word UNION SELECT long, short FROM d UNION SELECT short, long FROM d),
k AS (SELECT p.word, count(*) AS n_near, min({{'m': -w.n, 'other': other}}) AS best FROM p JOIN w ON w.word = other GROUP BY 1),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.other END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM w LEFT JOIN k USING (word)),
g AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL SELECT g.word, f.form, depth + 1 FROM g JOIN f ON g.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, depth) AS root FROM g GROUP BY 1) USING (word)"""

MINHASH = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * m >= 85 * (u.n + v.n - m)),
r AS (SELECT DISTINCT x AS doc_id, x AS z FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.z),
c AS (SELECT doc_id, min(z) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, s, unnest(list_transform(range(1, len(ws) - s + 2), lambda i: array_to_string(ws[i:i + s - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS s) WHERE len(ws) >= s),
f AS (SELECT lang, s, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
c AS (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE s > 1),
k AS (SELECT *, unnest(range(1, s)) AS k FROM c),
x AS (SELECT k.lang, k.phrase, k.a, k.k, y.f AS l, z.f AS r, (2000000::HUGEINT * k.a // (y.f::HUGEINT + z.f))::BIGINT AS score
      FROM k JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(ws[1:k], ' ') JOIN f z ON z.lang = k.lang AND z.phrase = array_to_string(ws[k + 1:], ' ')),
m AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN (SELECT lang, s, a, unnest(range(2, s)) AS size, ws FROM c) q USING (lang), (SELECT unnest([1, 2, 3]) AS i)
      WHERE c.s = size AND i + size - 1 <= q.s AND c.phrase = array_to_string(q.ws[i:i + size - 1], ' ') AND 100 * q.a >= 80 * c.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m ANTI JOIN d USING (lang, phrase)) JOIN t USING (lang) WHERE rank <= 2000"""

ORACLES = {"op3_line_dedup": _lines(), "op4_substring_dedup": SUBSTRING, "op6_quality_rules": _quality(), "op10_mixing": mixing_sql(), "op11_minhash": MINHASH, "op12_collocations": PHRASES, "op13_spelling_variants": SPELLING}
