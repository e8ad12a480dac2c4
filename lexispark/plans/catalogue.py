"""Registered queries of the document-intelligence operators, each with its DuckDB SQL.

The test tables hold no regulations, so every operator runs on an analogue:
documents stand for documents (source for doc_type, lang for taxonomy), events
for fetches and runs, conversations for sections with ordered clauses.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, pdf, quality, text, urls
from ..operators import diff, lookup, merge, pages, postings, render, search, snapshots
from ..sources.scratch import scratch_dir

NOW = "2024-02-15T00:00:00Z"
NOW_SQL = "TIMESTAMP '2024-02-15 00:00:00'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL for the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, doc_type, taxonomy, title (first line), full_text."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("doc_type"), F.col("lang").alias("taxonomy"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("full_text"))


DOCS_SQL = "SELECT doc_id, source AS doc_type, lang AS taxonomy, string_split(text, chr(10))[1] AS title, text AS full_text FROM documents"
BLANK_SQL = "[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
TRIM = lambda s: f"regexp_replace({s}, '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g')"
NORM = lambda s: f"translate({s}, '{text.WIDE}', '{text.NARROW}')"


# ---- search -------------------------------------------------------------------------------------


def tf_sql(column: str, term: str) -> str:
    """Occurrences of a term that cannot overlap itself."""
    return f"(length({column}) - length(replace(lower({column}), '{term}', ''))) // {len(term)}"


def search_sql(terms: list[str], where: str = "true", limit: int = 10) -> str:
    tf = ", ".join(f"{tf_sql('title', t)} + {tf_sql('full_text', t)} AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    idf = lambda i: f"CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END"
    score = " + ".join(f"({idf(i)}) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(terms)))
    hit = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""
WITH d AS ({DOCS_SQL}),
c AS (SELECT *, greatest(length(title) - 2, 0) + greatest(length(full_text) - 2, 0) AS len, {tf} FROM d),
s AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM c)
SELECT doc_id, doc_type, taxonomy, round(-({score}), 6) AS rank FROM c, s WHERE {hit} AND ({where}) ORDER BY -({score}), doc_id LIMIT {limit}"""


def searched(spark: SparkSession, sf_dir: str, keyword: str, **given) -> DataFrame:
    found = search.scan(documents(spark, sf_dir), keyword, "doc_id", ("title", "full_text"), **given)
    return found.select("doc_id", "doc_type", "taxonomy", F.round("rank", 6).alias("rank"))


@query(search_sql(["thanea"]))
def search_single(spark, sf_dir):
    return searched(spark, sf_dir, "thanea")


@query(search_sql(["ation", "with"]))
def search_and(spark, sf_dir):
    return searched(spark, sf_dir, "ation　with")


@query(search_sql(["tion"], "taxonomy = 'en' AND doc_type = 'src1'", 20))
def search_filtered(spark, sf_dir):
    return searched(spark, sf_dir, "Tion", keep=lookup.given(taxonomy="en", doc_type="src1", title=None), limit=20)


SHORT_SQL = search_sql(["thanea"])


@query(f"SELECT 'thanea' AS asked, doc_id, rank FROM ({SHORT_SQL}) UNION ALL SELECT 'thanea of', doc_id, rank FROM ({SHORT_SQL}) WHERE length('of') >= 3")
def search_short_term(spark, sf_dir):
    """A query with a term below three characters has no hit, where its long term alone has."""
    found = [searched(spark, sf_dir, k).select(F.lit(k).alias("asked"), "doc_id", "rank") for k in ("thanea", "thanea of")]
    return found[0].unionByName(found[1])


@query(search_sql(["the"], "true", 50))
def search_idf_floor(spark, sf_dir):
    return searched(spark, sf_dir, '"the"', limit=500)


@query(f"""
WITH d AS ({DOCS_SQL}),
q AS (SELECT item_id AS query_id, list_sort(list_transform(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda w: lpad(length(w)::VARCHAR, 4, '0') || w), 'DESC')[1][5:] AS term FROM benchmark),
t AS (SELECT DISTINCT term FROM q WHERE length(term) >= 3),
x AS (SELECT doc_id, lower(title) AS a, lower(full_text) AS b, greatest(length(title) - 2, 0) + greatest(length(full_text) - 2, 0) AS len FROM d),
h AS (SELECT term, doc_id, len,
        len(list_filter(range(1, length(a) - length(term) + 2), lambda i: substring(a, i, length(term)) = term))
      + len(list_filter(range(1, length(b) - length(term) + 2), lambda i: substring(b, i, length(term)) = term)) AS tf
      FROM x, t WHERE contains(b, term) OR contains(a, term)),
f AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
s AS (SELECT count(*) AS n, avg(len) AS mean FROM x),
r AS (SELECT q.query_id, h.doc_id AS key, round(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS rank
      FROM q JOIN h USING (term) JOIN f USING (term), s)
SELECT query_id, key, round(rank, 6) AS rank, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, key)::INT AS position FROM r) WHERE position <= 5""")
def search_batch_topk(spark, sf_dir):
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), longest.alias("keyword"))
    found = postings.search_once(documents(spark, sf_dir), queries, "doc_id", ("title", "full_text"), limit=5)
    return found.select("query_id", "key", F.round("rank", 6).alias("rank"), "position")


def and_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda w: w != "")
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.get(words, 1), longest).alias("keyword"))


# the second and the longest word of an item; the second may be too short to hit
AND_SQL = "SELECT item_id AS query_id, ws[2] AS a, list_sort(list_transform(ws, lambda w: lpad(length(w)::VARCHAR, 4, '0') || w), 'DESC')[1][5:] AS b FROM (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM benchmark)"


@query(f"""
WITH d AS ({DOCS_SQL}),
q AS (SELECT query_id, unnest([a, b]) AS term FROM ({AND_SQL}) WHERE least(length(a), length(b)) >= 3),
t AS (SELECT DISTINCT term FROM q),
x AS (SELECT doc_id, lower(title) AS a, lower(full_text) AS b, greatest(length(title) - 2, 0) + greatest(length(full_text) - 2, 0) AS len FROM d),
c AS (SELECT term, doc_id FROM x, t WHERE contains(b, term) OR contains(a, term)),
f AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
two AS (SELECT query_id, doc_id FROM q JOIN c USING (term) GROUP BY 1, 2 HAVING count(*) = 2),
h AS (SELECT term, doc_id, len,
        len(list_filter(range(1, length(a) - length(term) + 2), lambda i: substring(a, i, length(term)) = term))
      + len(list_filter(range(1, length(b) - length(term) + 2), lambda i: substring(b, i, length(term)) = term)) AS tf
      FROM (SELECT DISTINCT term, doc_id FROM two JOIN q USING (query_id)) JOIN x USING (doc_id)),
s AS (SELECT count(*) AS n, avg(len) AS mean FROM x),
r AS (SELECT q.query_id, doc_id AS key, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score
      FROM two JOIN q USING (query_id) JOIN h USING (doc_id, term) JOIN f USING (term), s GROUP BY 1, 2)
SELECT query_id, key, round(-score, 6) AS rank, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(-score, 9), key)::INT AS position FROM r) WHERE position <= 5""")
def search_batch_and(spark, sf_dir):
    found = postings.search_once(documents(spark, sf_dir), and_queries(spark, sf_dir), "doc_id", ("title", "full_text"), limit=5)
    return found.select("query_id", "key", F.round("rank", 6).alias("rank"), "position")


@query(f"""SELECT doc_id, CASE WHEN i > 0 THEN CASE WHEN i > 1 THEN ' … ' ELSE '' END || '<b>' || substring(t, i, 4) || '</b>' || substring(t, i + 4, 14) || CASE WHEN i + 18 <= length(t) THEN ' … ' ELSE '' END ELSE substring(t, 1, 18) END AS snippet
FROM (SELECT doc_id, full_text AS t, strpos(lower(full_text), 'tion') AS i FROM ({DOCS_SQL}))""")
def search_snippet(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", search.first_hit(F.col("full_text"), "Tion").alias("snippet"))


def window_sql(shown: str, columns: str) -> str:
    """Snippets of ``shown`` (id, body, terms and ``columns``): scores of windows, then the marks as islands of hits."""
    last = "max({z}) OVER (PARTITION BY id ORDER BY {pos}, {z} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
WITH shown AS ({shown}),
hits AS (SELECT id, i AS term, length(terms[i]) - 2 AS size, unnest(list_filter(range(0, length(x) - length(terms[i]) + 1), lambda p: substring(x, p + 1, length(terms[i])) = terms[i])) AS pos
         FROM (SELECT id, lower(body) AS x, terms, unnest(range(1, len(terms) + 1)) AS i FROM shown)),
cut AS (SELECT id, string_split_regex(body, '[.:][ \t\n\r]+') AS parts, regexp_extract_all(body, '[.:][ \t\n\r]+') AS seps FROM shown),
stop AS (SELECT id, coalesce(list_sum(list_transform(parts[1:k], lambda v: length(v))), 0)::BIGINT + coalesce(list_sum(list_transform(seps[1:k - 1], lambda v: length(v))), 0)::BIGINT AS o, length(seps[k]) AS n
         FROM (SELECT *, unnest(range(1, len(seps) + 1)) AS k FROM cut)),
starts AS (SELECT id, 0 AS s FROM shown UNION ALL SELECT id, unnest(range(o + 2, o + n + 1)) FROM stop),
governed AS (SELECT id, pos, term, max(s) AS s FROM hits JOIN starts USING (id) WHERE s <= pos GROUP BY ALL),
tried AS (SELECT id, pos, term, pos AS s, 0 AS kind FROM hits UNION ALL SELECT id, pos, term, s, 1 FROM governed JOIN shown USING (id) WHERE s < pos AND length(body) - 2 > 16),
scored AS (SELECT t.id, t.pos, t.term, t.s, t.kind, count(DISTINCT h.term) AS d, count(h.term) AS n, arg_max(h.pos + h.size, h.pos * 100 + h.term) AS z
           FROM tried t LEFT JOIN hits h ON h.id = t.id AND h.pos >= t.s AND h.pos < t.s + 16 GROUP BY ALL),
best AS (SELECT id, arg_min(struct_pack(s := s, kind := kind, z := z), struct_pack(score := -(999 * d + n + CASE WHEN kind = 0 THEN 0 WHEN s = 0 THEN 120 ELSE 100 END), pos := pos, term := term, kind := kind)) AS b FROM scored GROUP BY id),
placed AS (SELECT id, CASE WHEN b IS NULL THEN 0 WHEN b.kind = 1 THEN b.s ELSE greatest(0, least(b.s - (16 - (b.z - b.s)) // 2, length(body) - 18)) END AS w FROM shown LEFT JOIN best USING (id)),
runs AS (SELECT id, min(pos) AS a, max(pos + size - 1) AS z FROM (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY pos, z) AS run FROM
         (SELECT *, pos + size - 1 AS z, CASE WHEN pos <= {last.format(pos="pos", z="pos + size - 1")} THEN 0 ELSE 1 END AS new FROM hits)) GROUP BY id, run),
bold AS (SELECT id, min(a) AS a, max(z) AS z FROM (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY a, z) AS run FROM
         (SELECT *, CASE WHEN a < {last.format(pos="a", z="z")} THEN 0 ELSE 1 END AS new FROM (SELECT id, a, least(z, w + 15) + 3 AS z FROM runs JOIN placed USING (id) WHERE a >= w AND a < w + 16))) GROUP BY id, run),
marks AS (SELECT id, string_agg(substring(body, before + 1, a - before) || '<b>' || substring(body, a + 1, z - a) || '</b>', '' ORDER BY a) AS head, max(z) AS z FROM
          (SELECT bold.id, a, z, body, lag(z, 1, w) OVER (PARTITION BY bold.id ORDER BY a) AS before FROM bold JOIN placed USING (id) JOIN shown USING (id)) GROUP BY id)
SELECT {columns}, CASE WHEN w > 0 THEN ' … ' ELSE '' END || coalesce(head, '') || substring(body, coalesce(z, w) + 1, w + 18 - coalesce(z, w)) || CASE WHEN w + 18 < length(body) THEN ' … ' ELSE '' END AS snippet
FROM shown JOIN placed USING (id) LEFT JOIN marks USING (id)"""


@query(window_sql(f"SELECT doc_id AS id, doc_id, rank, full_text AS body, ['ation', 'with'] AS terms FROM ({search_sql(['ation', 'with'], 'true', 50)}) JOIN ({DOCS_SQL}) USING (doc_id)", "doc_id, rank"))
def search_best_snippet(spark, sf_dir):
    """The window of each of the best rows that shows the query best."""
    found = search.scan(documents(spark, sf_dir), "ation with", "doc_id", ("title", "full_text"), limit=50)
    return found.select("doc_id", F.round("rank", 6).alias("rank"), "snippet")


@query(window_sql(f"SELECT query_id || '/' || key AS id, query_id, key, position, full_text AS body, [a, b] AS terms FROM ({ORACLES['search_batch_and']}) JOIN ({AND_SQL}) USING (query_id) JOIN ({DOCS_SQL}) d ON key = d.doc_id", "query_id, key, position"))
def search_batch_snippets(spark, sf_dir):
    """Two-term queries answered together, with the window of every row found."""
    docs, queries = documents(spark, sf_dir), and_queries(spark, sf_dir)
    found = postings.search_once(docs, queries, "doc_id", ("title", "full_text"), limit=5)
    return postings.shown(found, queries, docs, F.col("doc_id"), "full_text").select("query_id", "key", "position", "snippet")


# ---- scalar functions ---------------------------------------------------------------------------

WIDENED = "translate(text, '-~0123456789 ', '－～０１２３４５６７８９　')"


@query(f"SELECT doc_id, {NORM(WIDENED)} AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.translate("text", "-~0123456789 ", "－～０１２３４５６７８９　")).alias("norm"))


@query(f"SELECT doc_id, regexp_replace({NORM('text')}, '{BLANK_SQL}', '', 'g') AS key, {TRIM(f'''regexp_replace({NORM('text')}, '{BLANK_SQL}+', ' ', 'g')''')} AS query FROM documents")
def normalize_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_key(F.col("text")).alias("key"), text.normalize_query(F.col("text")).alias("query"))


@query(f"SELECT page_id, {TRIM(f'''regexp_replace(html, '{BLANK_SQL}+', ' ', 'g')''')} AS line FROM pages")
def clean_text_single(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_line(F.col("html")).alias("line"))


@query(r"""SELECT doc_id, """ + TRIM(r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(t, '　', ' '), '[ \t]+', ' ', 'g'), '\n +', chr(10), 'g'), ' +\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')""") + r""" AS block
FROM (SELECT doc_id, replace(replace(text, '. ', '.　 ' || chr(9)), ', ', ', ' || chr(10) || chr(10) || chr(10) || ' ') AS t FROM documents)""")
def clean_text_multi(spark, sf_dir):
    spread = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".　 \t")), F.lit(", "), F.lit(", \n\n\n "))
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_block(spread).alias("block"))


# the SQL has patterns of its own, so that a wrong one in the functions shows
ERA_RX = r"(令和|平成|昭和|大正|明治)\s*(元|[0-9]{1,2})\s*年\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*日"
SIZE_RX = r"(?:PDF|pdf)[^/]*/([0-9,.]+)(KB|MB|kb)"
ERA_SQL = "CASE doc_id % 6 WHEN 0 THEN '（令和７年４月１日）' WHEN 1 THEN '平成元年 ' || (doc_id % 12 + 1) || ' 月8日' WHEN 2 THEN '昭和43年12月' || (doc_id % 28 + 1) || '日' WHEN 3 THEN '大正' || (doc_id % 14 + 1) || '年1月2日' WHEN 4 THEN '明治' || (doc_id % 44 + 1) || '年11月30日' ELSE title END"


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(t, '{ERA_RX}') THEN
  printf('%04d-%02d-%02d', CASE regexp_extract(t, '{ERA_RX}', 1) WHEN '令和' THEN 2018 WHEN '平成' THEN 1988 WHEN '昭和' THEN 1925 WHEN '大正' THEN 1911 ELSE 1867 END
  + CASE WHEN regexp_extract(t, '{ERA_RX}', 2) = '元' THEN 1 ELSE regexp_extract(t, '{ERA_RX}', 2)::INT END, regexp_extract(t, '{ERA_RX}', 3)::INT, regexp_extract(t, '{ERA_RX}', 4)::INT) END AS issued_at
FROM (SELECT doc_id, {NORM(ERA_SQL)} AS t FROM ({DOCS_SQL}))""")
def era_dates(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", dates.era_date(F.expr(ERA_SQL)).alias("issued_at"))


FOLDER_SQL = "'https://x.example/law/jimu-unei/shotoku/' || lpad((doc_id * 7919 % 1000000)::{}, 6, '0') || CASE WHEN doc_id % 3 = 0 THEN '_1' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '/index.htm' ELSE '/01.htm' END"
YYMMDD = r"/jimu-unei/.+/(\d{2})(\d{2})(\d{2})(?:[_-]\d+)?/(?:index|01)\.htm$"


@query(rf"""WITH u AS (SELECT doc_id, {FOLDER_SQL.format('VARCHAR')} AS u FROM documents),
p AS (SELECT *, regexp_extract(u, '{YYMMDD}', 1)::INT AS y, regexp_extract(u, '{YYMMDD}', 2)::INT AS m, regexp_extract(u, '{YYMMDD}', 3)::INT AS d FROM u)
SELECT doc_id, CASE WHEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND y BETWEEN 1 AND 60 THEN printf('%04d-%02d-%02d', CASE WHEN y <= 31 THEN 1988 ELSE 1925 END + y, m, d) END AS issued_at,
       regexp_extract(u, '/law/jimu-unei/(.+?)/(?:index|01)\.htm$', 1) AS guideline, regexp_extract(u, '/law/jimu-unei/([^/]+)/', 1) AS taxonomy FROM p""")
def folder_dates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("u", F.expr(FOLDER_SQL.format("STRING")))
    return d.select("doc_id", dates.folder_date(F.col("u")).alias("issued_at"), urls.guideline_id(F.col("u")).alias("guideline"), urls.guideline_taxonomy(F.col("u")).alias("taxonomy"))


SIZE_SQL = "title || CASE doc_id % 4 WHEN 0 THEN '（PDF/' || doc_id || '.18MB）' WHEN 1 THEN '(PDFファイル/1,' || lpad((doc_id % 1000)::{0}, 3, '0') || 'KB)' WHEN 2 THEN '(pdf/' || doc_id || 'kb)' ELSE '' END"


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(t, '{SIZE_RX}') THEN floor(replace(regexp_extract(t, '{SIZE_RX}', 1), ',', '')::DOUBLE * CASE WHEN upper(regexp_extract(t, '{SIZE_RX}', 2)) = 'MB' THEN 1024 ELSE 1 END + 0.5)::INT END AS size_kb
FROM (SELECT doc_id, {SIZE_SQL.format('VARCHAR')} AS t FROM ({DOCS_SQL}))""")
def pdf_size(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", pdf.size_kb(F.expr(SIZE_SQL.format("STRING"))).alias("size_kb"))


KIND_SQL = "title || CASE doc_id % 8 WHEN 0 THEN '新旧 対応表' WHEN 1 THEN 'インボイス　Ｑ＆Ａ' WHEN 2 THEN '別紙の通知' WHEN 3 THEN 'お知らせ' WHEN 4 THEN '参考資料' WHEN 5 THEN 'ｆａｑ' WHEN 6 THEN '資料1' ELSE '新旧対照表（別紙）' END"
KIND_CASE = """WHEN contains(t, '新旧対照表') OR contains(t, '新旧対応表') OR contains(t, '対比表') THEN 'comparison' WHEN contains(lower(t), 'q&a') OR contains(lower(t), 'faq') OR contains(t, '質疑応答') THEN 'qa-pdf'
  WHEN contains(t, '別紙') OR contains(t, '別表') OR contains(t, '様式') OR contains(t, '付録') OR contains(t, '添付資料') THEN 'attachment'
  WHEN contains(t, '通知') OR contains(t, 'お知らせ') OR contains(t, '連絡') THEN 'notice' WHEN contains(t, '参考') OR contains(t, '関連資料') THEN 'related'"""


@query(f"""SELECT doc_id, CASE {KIND_CASE} ELSE 'unknown' END AS kind FROM (SELECT doc_id,
  regexp_replace(translate({NORM(KIND_SQL)}, '{text.WIDE_LETTERS}', '{text.NARROW_LETTERS}'), '{BLANK_SQL}', '', 'g') AS t FROM ({DOCS_SQL}))""")
def pdf_kind(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", pdf.kind(F.expr(KIND_SQL)).alias("kind"))


NUMBER_SQL = "CASE doc_id % 5 WHEN 0 THEN ' 1－4－' || doc_id || 'の2　' WHEN 1 THEN '183～' || doc_id || '共－1 ' WHEN 2 THEN '1の3・' || doc_id || 'の4共-1' WHEN 3 THEN doc_id || '-' || doc_id || '-3  ' ELSE '' END || title"
PART = "[0-9０-９]+(?:の[0-9０-９]+)?"
SHAPES = [rf"(?s)^({x})[\s　]*(.*)$" for x in (f"{PART}(?:・{PART})+共[-－]{PART}", f"[0-9０-９]+[〜ー～][0-9０-９]+共[-－]{PART}", f"{PART}(?:[-－]{PART})+")]
SHAPE = lambda i: "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(t, '{rx}') THEN regexp_extract(t, '{rx}', {i}) END" for rx in SHAPES) + ")"


@query(f"""SELECT doc_id, regexp_replace({NORM(SHAPE(1))}, '{BLANK_SQL}', '', 'g') AS clause_number, {TRIM(SHAPE(2))} AS body
FROM (SELECT doc_id, regexp_replace({NUMBER_SQL}, '^{BLANK_SQL}+', '') AS t FROM ({DOCS_SQL}))""")
def clause_number(spark, sf_dir):
    n = text.clause_number(F.expr(NUMBER_SQL))
    return documents(spark, sf_dir).select("doc_id", n["clause_number"].alias("clause_number"), n["body"].alias("body"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 AND o_custkey > 0 THEN 'https://x.example/' || lpad((o_orderkey % 7)::VARCHAR, 2, '0') || '/' || CASE WHEN o_custkey < 10 THEN '0' ELSE '' END || o_custkey || '.htm' END AS url,
  CASE WHEN o_orderkey % 10 <> 8 AND o_orderkey % 10 <> 0 THEN ['shotoku', 'gensen', 'joto', 'sozoku', 'hojin', 'shohi', 'inshi', NULL, 'osirase'][o_orderkey % 10] END AS folder
FROM orders""")
def section_urls(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    url = urls.section_url(F.lit("https://x.example/"), F.col("o_orderkey") % 7, F.col("o_custkey"))
    return o.select("o_orderkey", url.alias("url"), urls.answer_folder((F.col("o_orderkey") % 10).cast("string")).alias("folder"))


REPLY_SQL = "CASE doc_id % 4 WHEN 0 THEN 'https://x.example/law/bunshokaito/shotoku/' || doc_id || '/index.htm' WHEN 1 THEN 'https://x.example/about/organization/osaka/bunshokaito/hojin/' || doc_id || '/index.htm' WHEN 2 THEN 'https://x.example/about/organization/nowhere/bunshokaito/' || lang || '/' || doc_id || '.htm' ELSE 'https://x.example/law/tsutatsu/kihon/sisan/sozoku2/kaisei/' || doc_id || '/index.htm' END"


@query(r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'shotoku/' || doc_id WHEN 1 THEN 'osaka/hojin/' || doc_id WHEN 2 THEN 'nowhere/' || lang || '/' || doc_id END AS reply,
  CASE doc_id % 4 WHEN 0 THEN 'shotoku' WHEN 1 THEN 'hojin' WHEN 2 THEN lang END AS taxonomy, CASE doc_id % 4 WHEN 0 THEN '国税庁' WHEN 1 THEN '大阪国税局' WHEN 2 THEN 'nowhere' END AS issuer,
  CASE WHEN doc_id % 4 = 3 THEN doc_id::VARCHAR END AS revision, CASE WHEN doc_id % 4 = 3 THEN 'sisan/sozoku2' END AS revision_taxonomy FROM documents""")
def url_keys(spark, sf_dir):
    u = F.col("u")
    d = table(spark, sf_dir, "documents").withColumn("u", F.expr(REPLY_SQL))
    return d.select("doc_id", urls.reply_id(u).alias("reply"), urls.reply_taxonomy(u).alias("taxonomy"), urls.reply_issuer(F.lit(None).cast("string"), u).alias("issuer"), urls.revision_id(u).alias("revision"), urls.revision_taxonomy(u).alias("revision_taxonomy"))


# ---- lookups and lists --------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_custkey, c_name, coalesce(n_name, '') AS nation FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey > 1""")
def lookup_left_join(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    full = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n.filter("n_regionkey > 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return full.select("o_orderkey", "o_custkey", "c_name", F.coalesce("n_name", F.lit("")).alias("nation"))


@query("SELECT doc_id, source AS k, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'db' ELSE 'live' END AS source FROM documents")
def lookup_fallback(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("k"))
    held = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return lookup.with_fallback(d.select("doc_id"), held, d, ["doc_id"])


@query("SELECT d.doc_id, string_split(d.text, chr(10))[1] AS title, l.quality AS issued_at FROM documents d LEFT JOIN labels l USING (doc_id) WHERE source = 'src3' ORDER BY l.quality DESC NULLS LAST, d.doc_id DESC LIMIT 50")
def list_available(spark, sf_dir):
    d = documents(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("issued_at")), "doc_id", "left")
    return lookup.available_documents(d, "src3")


PROPS = "CASE event_type WHEN 'error' THEN '[]' WHEN 'view' THEN '' WHEN 'signup' THEN NULL ELSE '[' || props || ']' END"


def attachments(spark, sf_dir, wanted):
    e = table(spark, sf_dir, "events").withColumn("pdfs", F.expr(PROPS))
    test = lookup.has_attachment("pdfs", wanted)
    return (e if test is None else e.filter(test)).select("event_id", "pdfs")


@query(f"SELECT event_id, pdfs FROM (SELECT event_id, {PROPS} AS pdfs FROM events) WHERE pdfs IS NOT NULL AND pdfs NOT IN ('', '[]')")
def has_attachment_true(spark, sf_dir):
    return attachments(spark, sf_dir, True)


@query(f"SELECT event_id, pdfs FROM (SELECT event_id, {PROPS} AS pdfs FROM events) WHERE pdfs IS NULL OR pdfs IN ('', '[]')")
def has_attachment_false(spark, sf_dir):
    return attachments(spark, sf_dir, False)


@query(f"SELECT event_id, {PROPS} AS pdfs FROM events")
def has_attachment_unset(spark, sf_dir):
    return attachments(spark, sf_dir, None)


@query("SELECT lang, count(*) > 0 AS any_clause, count(*) AS n FROM documents GROUP BY 1")
def exists_any(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg((F.count("*") > 0).alias("any_clause"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) <= 2")
def group_cap(spark, sf_dir):
    return lookup.capped(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")], 2).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT p_type, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) = 1")
def first_per_kind(spark, sf_dir):
    return lookup.first_per(table(spark, sf_dir, "part"), ["p_type"], [F.col("p_partkey")]).select("p_type", "p_partkey", "p_name")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations")
def carried_label(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", lookup.last_seen_label(c, F.when(F.col("role") == "user", F.col("turn")), "conv_id", "turn").alias("heading"))


# ---- freshness ----------------------------------------------------------------------------------

FRESH = f"""min(ts) AS oldest, max(ts) AS newest, count(ts) AS n, greatest(0, floor((epoch_us({NOW_SQL}) - epoch_us(min(ts))) / 86400000000.0))::BIGINT AS days"""
LEVEL = "CASE WHEN days < 7 THEN 'fresh' WHEN days < 30 THEN 'stale' ELSE 'outdated' END AS staleness, CASE WHEN days >= 30 THEN 'outdated: ' || days || ' days. refetch' END AS warning"


@query(f"SELECT *, {LEVEL} FROM (SELECT event_type, {FRESH} FROM events GROUP BY 1)")
def freshness_range(spark, sf_dir):
    return diff.freshness(table(spark, sf_dir, "events"), "ts", NOW, ["event_type"], "refetch")


@query(f"SELECT *, {LEVEL} FROM (SELECT {FRESH} FROM events WHERE event_type IN ('view', 'click')) WHERE n > 0")
def freshness_filtered(spark, sf_dir):
    return diff.freshness(diff.scoped(table(spark, sf_dir, "events"), "event_type", ["view", "click"]), "ts", NOW, None, "refetch")


@query(f"SELECT event_id, user_id, c_name, ts FROM events JOIN customer ON user_id = c_custkey WHERE ts < {NOW_SQL} - INTERVAL 20 DAY")
def stale_sections(spark, sf_dir):
    e = table(spark, sf_dir, "events").join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"))
    return diff.stale(e, "ts", NOW, 20, ["user_id", "event_id"]).select("event_id", "user_id", "c_name", "ts")


# ---- snapshots, differences, health -------------------------------------------------------------


@query("SELECT doc_id, sha1(source || chr(10) || doc_id || chr(10) || string_split(text, chr(10))[1] || chr(10) || text) AS content_hash, string_split(text, chr(10))[1] AS title FROM documents WHERE source = 'src0' AND lang IN ('en', 'fr')")
def snapshot_scope(spark, sf_dir):
    d = documents(spark, sf_dir)
    d = d.withColumn("content_hash", quality.document_hash(F.col("doc_type"), F.col("doc_id").cast("string"), F.col("title"), F.col("full_text")))
    return diff.document_snapshot(d, "src0", ["en", "fr"])


@query("SELECT doc_id, sha1(text) AS content_hash, string_split(text, chr(10))[1] AS title FROM documents")
def snapshot_hash(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.lit(1).alias("circular_id"), F.col("doc_id").alias("clause_number"), "full_text", "title")
    circulars = spark.range(1).select(F.lit(1).alias("id"), F.lit("all").alias("formal_name"))
    return diff.clause_snapshot(d, circulars, "all")


@query("SELECT conv_id, sha1(string_agg(turn::VARCHAR || chr(10) || role || chr(10) || text || chr(10) || '---' || chr(10), '' ORDER BY turn)) AS content_hash FROM conversations GROUP BY 1")
def section_hash(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(quality.ordered_hash(F.col("turn"), F.col("turn").cast("string"), F.col("role"), F.col("text")).alias("content_hash"))


def two_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Before: all documents. After: Spanish ones are gone, French ones changed, those of one source have new ids; one source has no hash."""
    d = documents(spark, sf_dir)
    title = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.col("title"))
    unhashed = F.when(F.col("doc_type") == "src2", F.lit(None).cast("string"))
    before = d.select("doc_id", F.when(F.col("doc_type") != "src2", F.sha1(F.col("full_text").cast("binary"))).otherwise(unhashed).alias("content_hash"), title.alias("title"))
    kept = d.filter("taxonomy != 'es'")
    after = kept.select(
        F.when(F.col("doc_type") == "src5", F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")).alias("doc_id"),
        F.sha1(F.concat("full_text", F.when(F.col("taxonomy") == "fr", F.lit("!")).otherwise(F.lit(""))).cast("binary")).alias("content_hash"),
        title.alias("title"),
    )
    return before, after


SNAPSHOTS = """WITH b AS (SELECT doc_id, CASE WHEN source <> 'src2' THEN sha1(text) END AS h, doc_id || ' ' || string_split(text, chr(10))[1] AS title FROM documents),
a AS (SELECT CASE WHEN source = 'src5' THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, sha1(text || CASE WHEN lang = 'fr' THEN '!' ELSE '' END) AS h, doc_id || ' ' || string_split(text, chr(10))[1] AS title FROM documents WHERE lang <> 'es'),
c AS (SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'orphaned' WHEN b.h <> a.h THEN 'updated' ELSE 'same' END AS status, coalesce(a.title, b.title) AS title FROM b FULL JOIN a ON a.doc_id = b.doc_id)
"""


@query(SNAPSHOTS + "SELECT * FROM c")
def diff_four_patterns(spark, sf_dir):
    return diff.changes(*two_snapshots(spark, sf_dir))


@query(SNAPSHOTS + "SELECT * FROM c WHERE status <> 'same'")
def diff_digests(spark, sf_dir):
    """Two stored snapshots compared by their digests."""
    stored = [snapshots.Snapshot.write(s, f"{scratch_dir(spark)}/snapshot-{uuid.uuid4().hex}", 64) for s in two_snapshots(spark, sf_dir)]
    return snapshots.changed(*stored)


@query(SNAPSHOTS + "SELECT * FROM c WHERE status = 'orphaned' AND title IN (SELECT title FROM c WHERE status = 'new')")
def diff_moved_semi(spark, sf_dir):
    return diff.moved(diff.changes(*two_snapshots(spark, sf_dir)))


@query(SNAPSHOTS + "SELECT DISTINCT doc_id FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)")
def diff_anti(spark, sf_dir):
    before, after = two_snapshots(spark, sf_dir)
    return diff.missing_keys(after, before)


@query(SNAPSHOTS + """SELECT count(*) FILTER (status <> 'orphaned') AS total, 3::BIGINT AS failed, count(*) FILTER (status = 'new') AS new_docs, count(*) FILTER (status = 'updated') AS updated_docs, count(*) FILTER (status = 'orphaned') AS orphaned_docs,
(SELECT count(*) FROM c WHERE status = 'orphaned' AND title IN (SELECT title FROM c WHERE status = 'new')) AS moved_docs, 3 / count(*) FILTER (status <> 'orphaned')::DOUBLE AS fail_rate FROM c""")
def diff_summary(spark, sf_dir):
    return diff.summary(*two_snapshots(spark, sf_dir), failed=3)


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS fetched, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def per_group_outcomes(spark, sf_dir):
    return diff.outcomes(table(spark, sf_dir, "events"), "user_id", F.col("event_type") != "error")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per event type and day; the event types stand for document types."""
    e = table(spark, sf_dir, "events")
    kinds = {"view": "kaisei", "click": "jimu-unei", "purchase": "tax-answer", "signup": "qa-jirei", "error": "bunshokaitou"}
    name = F.lit(None).cast("string")
    for k, v in kinds.items():
        name = F.when(F.col("event_type") == k, F.lit(v)).otherwise(name)
    runs = e.groupBy(name.alias("doc_type"), F.date_trunc("day", "ts").alias("ran_at")).agg(
        F.count("*").alias("total"), F.count_if(F.col("value") > 80).alias("failed"), F.count_if(F.col("value") < 30).alias("updated_docs")
    )
    return runs.withColumn("fail_rate", F.col("failed") / F.col("total"))


HISTORY = """WITH h AS (SELECT CASE event_type WHEN 'view' THEN 'kaisei' WHEN 'click' THEN 'jimu-unei' WHEN 'purchase' THEN 'tax-answer' WHEN 'signup' THEN 'qa-jirei' WHEN 'error' THEN 'bunshokaitou' END AS doc_type,
  date_trunc('day', ts)::TIMESTAMP AS ran_at, count(*) AS total, count(*) FILTER (value > 80) AS failed, count(*) FILTER (value < 30) AS updated_docs, count(*) FILTER (value > 80) / count(*)::DOUBLE AS fail_rate FROM events GROUP BY 1, 2),
k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_type ORDER BY ran_at DESC) <= 12),
m AS (SELECT doc_type, median(total)::DOUBLE AS median_total, median(fail_rate) AS median_fail_rate FROM k GROUP BY 1)
"""


@query(HISTORY + "SELECT * FROM k")
def history_last12(spark, sf_dir):
    return diff.last_runs(history(spark, sf_dir))


@query(HISTORY + "SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_type ORDER BY ran_at DESC) = 1")
def history_last(spark, sf_dir):
    return diff.last_run(history(spark, sf_dir))


@query(HISTORY + "SELECT * FROM m")
def history_median(spark, sf_dir):
    return diff.medians(history(spark, sf_dir))


@query(HISTORY + ", t AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in quality.MIN_FAILURES.items()) + """) AS t(doc_type, least)),
j AS (SELECT h.*, coalesce(median_total, 0.0) AS median_total, coalesce(median_fail_rate, 0.0) AS median_fail_rate, updated_docs / total::DOUBLE AS update_ratio, least FROM h LEFT JOIN m USING (doc_type) LEFT JOIN t USING (doc_type))
SELECT doc_type, ran_at, total, failed, updated_docs, fail_rate, median_total, median_fail_rate, update_ratio, len(reasons) > 0 AS warn, reasons FROM (
  SELECT *, list_filter([CASE WHEN failed >= least AND fail_rate >= 0.01 THEN 'fail_rate' END, CASE WHEN median_total <> 0 AND abs(total - median_total) / median_total >= 0.2 THEN 'count_drift' END, CASE WHEN update_ratio > 0.5 THEN 'structural_change' END], lambda x: x IS NOT NULL) AS reasons FROM j)""")
def health_flags(spark, sf_dir):
    h = history(spark, sf_dir)
    return diff.evaluate(h, h)


@query("SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN o.source ELSE 'new ' || n.source END AS source FROM (SELECT doc_id, source FROM documents WHERE lang <> 'fr') o FULL JOIN (SELECT doc_id, source FROM documents WHERE lang <> 'en') n USING (doc_id)")
def upsert_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    old = d.filter("lang != 'fr'").select("doc_id", "source")
    new = d.filter("lang != 'en'").select("doc_id", F.concat(F.lit("new "), "source").alias("source"))
    return merge.upserted(old, new, ["doc_id"])


@query("""SELECT conv_id, list(kind ORDER BY rank, turn) AS kinds FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'comparison' WHEN 'assistant' THEN 'related' ELSE 'unknown' END AS kind,
  CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 3 ELSE 5 END AS rank FROM conversations) GROUP BY 1""")
def priority_sort(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "comparison").when(F.col("role") == "assistant", "related").otherwise("unknown")
    item = F.struct("turn", kind.alias("kind"))
    return c.groupBy("conv_id").agg(F.transform(pdf.by_priority(F.array_sort(F.collect_list(item))), lambda p: p["kind"]).alias("kinds"))


# ---- pages --------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS raw_title, lower(trim(regexp_extract(html, '(?i)<meta[^>]+charset=[\"'']?([A-Za-z0-9_-]+)', 1))) AS charset FROM pages")
def page_charset(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("raw_title"), pages.detect_charset(F.lit(None).cast("string"), F.col("html")).alias("charset"))


# the pages' links are absolute or start at the host's root
@query(r"""
WITH h AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS own, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS found FROM pages),
l AS (SELECT page_id, unnest(found) AS href, generate_subscripts(found, 1) AS i, scheme, own FROM h),
a AS (SELECT page_id, i, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN href LIKE '//%' THEN scheme || ':' || href ELSE scheme || '://' || own || href END AS link FROM l),
f AS (SELECT page_id, link, min(i) AS i FROM a GROUP BY 1, 2)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos, link, regexp_extract(link, '^[a-z]+://([^/?#]+)', 1) AS host FROM f""")
def page_links(spark, sf_dir):
    """Absolute links of every page, the first of each."""
    return pages.links(table(spark, sf_dir, "pages"))


@query()
def page_sections(spark, sf_dir):
    """Title, headings and blocks of every page by the tree parser."""
    return pages.outline(table(spark, sf_dir, "pages"))


@query("""SELECT conv_id, string_agg('## ' || turn || '（' || role || '）' || chr(10) || chr(10) || CASE WHEN role = 'user' THEN '' ELSE '> ' END || text || chr(10), chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1""")
def render_markdown(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    paragraph = F.struct(F.when(F.col("role") == "user", 1).otherwise(2).alias("indent"), F.col("text").alias("text"))
    md = render.clause(F.col("turn").cast("string"), F.col("role"), F.array(paragraph))
    parts = F.array_sort(F.collect_list(F.struct("turn", md.alias("m"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["m"]), "\n").alias("markdown"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_single(spark, sf_dir)
