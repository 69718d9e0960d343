"""Driver queries for the corpus analytics (P1-P14) over documents, pages and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import render as R
from quillframe.functions import text as T
from quillframe.operators import analytics as A
from quillframe.operators import near_duplicates as N
from quillframe.plans.pipeline_queries import _sql_plain
from quillframe.plans import workflow as W
from quillframe.plans.registry import query
from quillframe.plans.text_queries import SQL_MARKDOWN, SQL_TITLE, WS, doc_markdown, doc_title, sql_strip, sql_word_count
from quillframe.sources.tables import table

SQL_TOKENS = "regexp_extract_all(lower({x}), '(\\pL+)', 1)"
SQL_LEVELS = (
    "list_filter(list_transform(string_split({md}, chr(10)), lambda l: length(regexp_extract(l, '^(#{{1,6}}) ', 1))), "
    "lambda x: x > 0)"
)


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *cols)


@query(
    "heading_audit",
    f"""WITH m AS (SELECT doc_id, {SQL_LEVELS.format(md=SQL_MARKDOWN)} AS lv FROM documents)
SELECT doc_id, CAST(len(lv) AS INTEGER) AS n_headings,
       CAST(len(list_filter(lv, lambda x: x = 1)) AS INTEGER) AS n_h1,
       CAST(len(list_filter(lv, lambda x: x = 2)) AS INTEGER) AS n_h2,
       CAST(len(list_filter(lv, lambda x: x = 3)) AS INTEGER) AS n_h3,
       CAST(len(list_filter(range(2, len(lv) + 1), lambda i: lv[i] - lv[i - 1] > 1)) AS INTEGER) AS level_jumps,
       len(list_filter(lv, lambda x: x = 1)) = 1 AS h1_ok,
       array_to_string(lv, ',') AS levels
FROM m""",
)
def heading_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading counts per level, level jumps and the single-H1 rule."""
    d = _docs(spark, sf_dir, "text").select("doc_id", A.heading_level_list(doc_markdown(F.col("text"))).alias("lv"))
    d = d.select("doc_id", A.heading_audit("lv").alias("a"))
    return d.select("doc_id", "a.n_headings", "a.n_h1", "a.n_h2", "a.n_h3", "a.level_jumps", "a.h1_ok",
                    F.array_join("a.levels", ",").alias("levels"))


_SQL_TFIDF = f"""WITH tk AS (SELECT doc_id, unnest({SQL_TOKENS.format(x='text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tk GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT tf.doc_id, tf.term, tf.tf, df.df, tf.tf * ln(CAST(n.n AS DOUBLE) / df.df) AS score
      FROM tf JOIN df USING (term), n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s)"""


@query(
    "keywords_topk",
    _SQL_TFIDF
    + """
SELECT doc_id, term, tf, df, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def keywords_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-5 tf-idf terms per document (ties by term)."""
    k = A.top_keywords(_docs(spark, sf_dir, "text"), 5)
    return k.select("doc_id", "term", "tf", "df", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(
    "keyword_density",
    f"""WITH d AS (SELECT doc_id, text, {SQL_TOKENS.format(x='text')} AS tk, {sql_word_count('text')} AS wc,
                      {SQL_TOKENS.format(x=SQL_TITLE)} AS kt FROM documents),
k AS (SELECT doc_id, tk, wc, unnest(list_distinct(kt)) AS keyword FROM d)
SELECT doc_id, keyword, CAST(len(list_filter(tk, lambda t: t = keyword)) AS BIGINT) AS hits, CAST(wc AS BIGINT) AS word_count,
       CASE WHEN wc > 0 THEN CAST(100.0 AS DOUBLE) * len(list_filter(tk, lambda t: t = keyword)) * 1 / wc END AS density,
       coalesce(CASE WHEN wc > 0 THEN CAST(100.0 AS DOUBLE) * len(list_filter(tk, lambda t: t = keyword)) * 1 / wc END > 3.0, false) AS stuffing
FROM k""",
)
def keyword_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of each title word in its document, stuffing flag > 3%."""
    d = _docs(spark, sf_dir, "text")
    return A.keyword_density_rows(d, "doc_id", "text", F.array_distinct(T.tokens(doc_title(F.col("text")))))


@query(
    "readability",
    f"""WITH d AS (SELECT doc_id, {SQL_TOKENS.format(x='text')} AS tk,
                      CAST(greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS BIGINT) AS s FROM documents),
m AS (SELECT doc_id, s, CAST(len(tk) AS BIGINT) AS w, CAST(coalesce(list_sum(list_transform(tk, lambda t: length(t))), 0) AS BIGINT) AS l FROM d)
SELECT doc_id, s AS sentences, w AS words, l AS letters,
       CASE WHEN w > 0 THEN CAST(w AS DOUBLE) / CAST(s AS DOUBLE) END AS words_per_sentence,
       CASE WHEN w > 0 THEN CAST(l AS DOUBLE) / CAST(w AS DOUBLE) END AS letters_per_word,
       CASE WHEN w > 0 THEN CAST(4.71 AS DOUBLE) * CAST(l AS DOUBLE) / CAST(w AS DOUBLE)
                          + CAST(0.5 AS DOUBLE) * CAST(w AS DOUBLE) / CAST(s AS DOUBLE) - CAST(21.43 AS DOUBLE) END AS ari
FROM m""",
)
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, words, letters and the Automated Readability Index."""
    d = _docs(spark, sf_dir, "text").select("doc_id", A.readability("text").alias("r"))
    return d.select("doc_id", "r.*")


@query(
    "redundancy",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                      generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, {sql_strip('line')} AS key FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY i) AS rn FROM k),
o AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE key <> '' AND rn > 1) AS removed,
             string_agg(line, chr(10) ORDER BY i) FILTER (WHERE key = '' OR rn = 1) AS deduped
      FROM r GROUP BY doc_id)
SELECT doc_id, CAST(lines AS INTEGER) AS lines, CAST(removed AS INTEGER) AS removed,
       CAST(length(deduped) AS BIGINT) AS deduped_chars, md5(deduped) AS deduped_md5,
       CAST(removed AS DOUBLE) / CAST(lines AS DOUBLE) AS removed_share
FROM o""",
)
def redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated non-blank lines removed (first kept), removed share."""
    d = _docs(spark, sf_dir, "text").select("doc_id", A.dedupe_lines("text").alias("r"))
    return d.select(
        "doc_id", F.col("r.lines").alias("lines"), F.col("r.removed").alias("removed"),
        F.length("r.text").cast("bigint").alias("deduped_chars"), F.md5("r.text").alias("deduped_md5"),
        (F.col("r.removed").cast("double") / F.col("r.lines").cast("double")).alias("removed_share"),
    )


@query(
    "word_target",
    f"""WITH d AS (SELECT lang, CAST(len(regexp_extract_all(text, '[^{WS}]+')) AS BIGINT) AS w FROM documents)
SELECT lang, CASE WHEN w * 10 < 1000 * 8 THEN 'under' WHEN w * 10 > 1000 * 12 THEN 'over' ELSE 'on_target' END AS band,
       count(*) AS docs, CAST(sum(w) AS BIGINT) AS words,
       CAST(sum(w) AS DOUBLE) / CAST(count(*) * 1000 AS DOUBLE) AS avg_ratio
FROM d GROUP BY 1, 2""",
)
def word_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article length against a 1,000-word target, banded, per language."""
    d = _docs(spark, sf_dir, "text", "lang").select("lang", T.ws_word_count("text").alias("w"))
    d = d.withColumn("band", A.word_target_band(F.col("w"), F.lit(1000)))
    return d.groupBy("lang", "band").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("w").cast("bigint").alias("words"),
        (F.sum("w").cast("double") / (F.count(F.lit(1)) * 1000).cast("double")).alias("avg_ratio"),
    )


_SQL_HREF = "regexp_extract_all(html, '(?i)<a\\s[^>]*href=[\"'']([^\"'']*)[\"'']', 1)"


@query(
    "title_audit",
    f"""WITH p AS (SELECT page_id, html,
       regexp_matches(html, '(?is)<title[^>]*>.*?</title>') AS has_title,
       regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
       regexp_matches(html, '(?is)<meta\\s+name=["'']description["'']') AS has_desc,
       regexp_extract(html, '(?is)<meta\\s+name=["'']description["'']\\s+content=["'']([^"'']*)["'']', 1) AS descr
  FROM pages)
SELECT page_id, has_title, CASE WHEN has_title THEN CAST(length(title) AS INTEGER) END AS title_chars,
       has_title AND length(title) BETWEEN 30 AND 60 AS title_ok,
       has_desc AS has_description, CASE WHEN has_desc THEN CAST(length(descr) AS INTEGER) END AS description_chars,
       has_desc AND length(descr) BETWEEN 70 AND 160 AS description_ok,
       CAST(len(regexp_extract_all(html, '(?i)<h1[\\s>]')) AS INTEGER) AS n_h1,
       CAST(len({_SQL_HREF}) AS INTEGER) AS n_links
FROM p""",
)
def title_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title / meta-description lengths and limits, H1 and link counts per page."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    return p.select("page_id", A.page_audit("html").alias("a"), F.size(A.links("html")).cast("int").alias("n_links")).select(
        "page_id", "a.has_title", "a.title_chars", "a.title_ok", "a.has_description", "a.description_chars",
        "a.description_ok", "a.n_h1", "n_links",
    )


@query(
    "image_alt_audit",
    """WITH p AS (SELECT page_id, regexp_extract_all(html, '(?i)(<img\\b[^>]*>)', 1) AS imgs FROM pages)
SELECT page_id, CAST(len(imgs) AS INTEGER) AS images,
       CAST(len(list_filter(imgs, lambda t: NOT regexp_matches(t, '(?i)\\balt\\s*=\\s*["''][^"'']*\\S[^"'']*["'']'))) AS INTEGER) AS missing_alt
FROM p""",
)
def image_alt_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: images and images without alt text per page."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    return p.select("page_id", A.image_alt_audit(html="html").alias("a")).select("page_id", "a.images", "a.missing_alt")


def page_text(html):
    """Visible page text: script and style blocks dropped, tags replaced by spaces."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", " ")
    return F.regexp_replace(t, r"<[^>]*>", " ")


_SQL_PAGE_TEXT = (
    "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), "
    "'(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
)


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, three of four with a link to the page of the next id: its URL
    as it is, without a scheme, or with the host in capitals and the port."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    after = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("_next"))
    nxt = F.col("_next")
    rest = F.regexp_replace(nxt, "^[a-z]+://[^/?#]*", "")
    host = F.regexp_extract(nxt, "^[a-z]+://([^/?#]*)", 1)
    href = (
        F.when(F.col("page_id") % 4 == 0, nxt)
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("//"), host, rest))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("http://"), F.upper(host), F.lit(":80"), rest))
    )
    more = F.coalesce(F.concat(F.lit('<a href="'), href, F.lit('">next</a>')), F.lit(""))
    return p.join(after, "page_id", "left").select("page_id", "url", F.concat("html", more).alias("html"))


_SQL_HOST = "regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1)"
_SQL_PATH = "regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(
    "link_candidates",
    f"""WITH q AS (SELECT a.page_id, a.url, a.html || coalesce('<a href="' || CASE a.page_id % 4
    WHEN 0 THEN b.url WHEN 1 THEN regexp_replace(b.url, '^[a-z]+:', '')
    WHEN 2 THEN 'http://' || upper({_SQL_HOST.format(u='b.url')}) || ':80' || regexp_replace(b.url, '^[a-z]+://[^/?#]*', '') END || '">next</a>', '') AS html
  FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id + 1),
p AS (SELECT page_id, {_SQL_HOST.format(u='url')} AS host, {_SQL_PATH.format(u='url')} AS path, {_SQL_PAGE_TEXT} AS text, {_SQL_HREF} AS hrefs FROM q),
h AS (SELECT page_id, host, unnest(hrefs) AS href FROM p),
r AS (SELECT page_id, lower(CASE WHEN href LIKE 'http%' THEN regexp_replace({_SQL_HOST.format(u='href')}, ':80$', '') WHEN href LIKE '//%' THEN regexp_extract(href, '^//([^/?#]*)', 1) ELSE host END) AS host,
             CASE WHEN href LIKE 'http%' THEN {_SQL_PATH.format(u='href')} WHEN href LIKE '//%' THEN regexp_extract(href, '^//[^/?#]*([^?#]*)', 1)
                  ELSE regexp_extract(href, '^([^?#]*)', 1) END AS path FROM h),
inv AS (SELECT DISTINCT r.page_id, p.page_id AS target FROM r JOIN p ON r.host = p.host AND r.path = p.path WHERE r.page_id <> p.page_id),
tk AS (SELECT page_id, unnest({SQL_TOKENS.format(x='text')}) AS term FROM p),
tf AS (SELECT page_id, term, count(*) AS tf FROM tk GROUP BY 1, 2),
ix AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM tf),
top AS (SELECT term, max(page_id) FILTER (WHERE k = 1) AS one, max(page_id) FILTER (WHERE k = 2) AS two
        FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY tf DESC, page_id) AS k FROM ix WHERE df > 1) GROUP BY term),
lk AS (SELECT inv.page_id, a.term, count(*) AS linked FROM inv JOIN ix a ON a.page_id = inv.target JOIN ix b ON b.page_id = inv.page_id AND b.term = a.term GROUP BY 1, 2),
f AS (SELECT ix.*, coalesce(linked, 0) AS linked, CASE WHEN one = ix.page_id THEN two ELSE one END AS best
      FROM ix JOIN top USING (term) LEFT JOIN lk ON lk.page_id = ix.page_id AND lk.term = ix.term WHERE df > 1)
SELECT f.page_id, term, tf, df, linked, df - 1 - linked AS candidates, best, inv.target IS NOT NULL AS best_linked
FROM f LEFT JOIN inv ON inv.page_id = f.page_id AND inv.target = f.best WHERE df - 1 - linked > 0""",
)
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page and term shared with other pages, how many of them it does not link to yet, and the best holder."""
    pages = W.cut(linked_pages(spark, sf_dir), "linked-pages")
    index = W.cut(A.term_index(pages.select("page_id", page_text(F.col("html")).alias("text"))), "term-index")
    inventory = W.cut(A.link_inventory(pages), "link-inventory")
    return A.link_candidates(index, inventory)


_SQL_SHINGLES = (
    "list_distinct(list_transform(range(1, len({tk}) - 6), lambda i: array_to_string({tk}[i:i + 7], ' ')))"
)


@query(
    "benchmark_overlap",
    f"""WITH d AS (SELECT doc_id, {SQL_TOKENS.format(x='text')} AS tk FROM documents),
ds AS (SELECT doc_id, CASE WHEN len(tk) >= 8 THEN {_SQL_SHINGLES.format(tk='tk')} ELSE [] END AS sh FROM d),
dx AS (SELECT doc_id, len(sh) AS own, unnest(sh) AS shingle FROM ds),
b AS (SELECT item_id, {SQL_TOKENS.format(x='text')} AS tk FROM benchmark),
bx AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(tk) >= 8 THEN {_SQL_SHINGLES.format(tk='tk')} ELSE [] END) AS shingle FROM b)
SELECT doc_id, item_id, count(*) AS shared, CAST(any_value(own) AS INTEGER) AS own,
       CAST(count(*) AS DOUBLE) / CAST(any_value(own) AS DOUBLE) AS containment
FROM dx JOIN bx USING (shingle) GROUP BY doc_id, item_id""",
)
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-token shingle containment of each document in benchmark items."""
    d = _docs(spark, sf_dir, "text")
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    o = A.shingle_overlap(d, b, 8)
    return o.select("doc_id", "item_id", "shared", F.col("own").cast("int").alias("own"), "containment")


_SQL_FIVE = "list_transform(range(1, greatest(len(tk) - 3, 2)), lambda i: array_to_string(tk[i:i + 4], ' '))"


@query(
    "near_duplicates",
    f"""WITH d AS (SELECT doc_id, {SQL_TOKENS.format(x='text')} AS tk FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct({_SQL_FIVE})) AS sh FROM d WHERE len(tk) > 0),
c AS (SELECT min(doc_id) AS id, count(*) AS copies, sh FROM s GROUP BY sh),
x AS (SELECT id, copies, len(sh) AS n, unnest(sh) AS shingle FROM c),
p AS (SELECT a.id AS class_a, b.id AS class_b, any_value(a.copies) AS copies_a, any_value(b.copies) AS copies_b, count(*) AS shared, any_value(a.n + b.n) AS n
      FROM x a JOIN x b ON a.shingle = b.shingle AND a.id < b.id GROUP BY 1, 2)
SELECT class_a, class_b, copies_a, copies_b, shared, CAST(shared AS DOUBLE) / (n - shared) AS jaccard FROM p WHERE CAST(shared AS DOUBLE) / (n - shared) >= 0.8""",
)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8, near form: every pair of different texts whose five-word shingles have a Jaccard
    similarity of 0.8, by class of equal texts, with the number of copies of each."""
    pairs, members = N.near_duplicates(_docs(spark, sf_dir, "text"))
    copies = members.where("doc_id = class_id").select("class_id", "copies")
    a, b = (copies.select(F.col("class_id").alias(f"class_{x}"), F.col("copies").alias(f"copies_{x}")) for x in "ab")
    return pairs.join(a, "class_a").join(b, "class_b").select("class_a", "class_b", "copies_a", "copies_b", "shared", "jaccard")


def _outline(text):
    lines = F.split(text, "\n")
    heads = F.filter(F.transform(lines, lambda l, i: F.struct((i + 1).alias("i"), l.alias("l"))), lambda x: (x["i"] % 5 == 0) & (x["l"] != ""))
    outline = F.concat(F.transform(heads, lambda x: x["l"]), F.array(F.lit("Summary")))
    return F.transform(outline, lambda h: F.struct(h.alias("heading"), F.lit(100).alias("word_allocation")))


def _sql_norm(x: str) -> str:
    return f"regexp_replace({sql_strip('lower(' + x + ')')}, '[{WS}]+', ' ', 'g')"


@query(
    "outline_coverage",
    f"""WITH md AS (SELECT doc_id, {SQL_MARKDOWN} AS md, text FROM documents),
l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM md),
lv AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}}) ', 1)) AS level FROM l),
sec AS (SELECT *, max(CASE WHEN level > 0 THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS hid FROM lv),
a AS (SELECT doc_id, hid,
             any_value(CASE WHEN i = hid THEN regexp_replace(line, '^#{{1,6}} ', '') END) AS heading,
             CAST(sum(CASE WHEN i <> hid THEN {sql_word_count('line')} ELSE 0 END) AS BIGINT) AS words
      FROM sec WHERE hid IS NOT NULL GROUP BY doc_id, hid),
aa AS (SELECT doc_id, {_sql_norm('heading')} AS norm, sum(words) AS words FROM a GROUP BY 1, 2),
ol AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM md),
o0 AS (SELECT doc_id, line AS heading FROM ol WHERE i % 5 = 0 AND line <> ''
       UNION ALL SELECT doc_id, 'Summary' FROM documents),
o AS (SELECT doc_id, {_sql_norm('heading')} AS norm, sum(100) AS alloc FROM o0 GROUP BY 1, 2),
j AS (SELECT coalesce(o.doc_id, aa.doc_id) AS doc_id, o.alloc, aa.words FROM o FULL OUTER JOIN aa ON o.doc_id = aa.doc_id AND o.norm = aa.norm)
SELECT doc_id,
       count(alloc) AS outline_sections,
       count(CASE WHEN alloc IS NOT NULL AND words IS NOT NULL THEN 1 END) AS covered,
       count(CASE WHEN alloc IS NOT NULL AND words IS NULL THEN 1 END) AS missing,
       count(CASE WHEN alloc IS NULL AND words IS NOT NULL THEN 1 END) AS extra,
       CAST(sum(coalesce(alloc, 0)) AS BIGINT) AS allocated_words,
       CAST(sum(CASE WHEN alloc IS NOT NULL THEN coalesce(words, 0) ELSE 0 END) AS BIGINT) AS covered_words,
       CASE WHEN sum(coalesce(alloc, 0)) > 0
            THEN CAST(sum(CASE WHEN alloc IS NOT NULL THEN coalesce(words, 0) ELSE 0 END) AS DOUBLE) / CAST(sum(coalesce(alloc, 0)) AS DOUBLE) END AS coverage_ratio
FROM j GROUP BY doc_id""",
)
def outline_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: the article's sections (words per heading) against an outline
    (every 5th line as a section of 100 words, plus a Summary)."""
    d = _docs(spark, sf_dir, "text")
    out = A.outline_coverage_rows(d.select("doc_id", "text", doc_markdown(F.col("text")).alias("md")).withColumn("_o", _outline(F.col("text"))), F.col("_o"))
    return out.select("doc_id", "outline_sections", "covered", "missing", "extra", "allocated_words", "covered_words", "coverage_ratio")


def _target_md(md, doc_id):
    return F.when(doc_id % 5 == 0, F.regexp_replace(md, r"(?md)^### ", "## ")).otherwise(
        F.concat(F.regexp_replace(md, "[aeiou]", ""), F.lit("\n\n(zh)"))
    )


@query(
    "translation_parity",
    f"""WITH d AS (SELECT doc_id, {SQL_MARKDOWN} AS md, list_distinct({SQL_TOKENS.format(x=SQL_TITLE)}) AS kw FROM documents),
t AS (SELECT doc_id, md, kw,
             CASE WHEN doc_id % 5 = 0 THEN regexp_replace(md, '(?m)^### ', '## ', 'g')
                  ELSE regexp_replace(md, '[aeiou]', '', 'g') || chr(10) || chr(10) || '(zh)' END AS tg FROM d)
SELECT doc_id, {SQL_LEVELS.format(md='md')} = {SQL_LEVELS.format(md='tg')} AS same_structure,
       len(list_filter(kw, lambda k: NOT contains(tg, k))) = 0 AS keywords_kept,
       CASE WHEN length(md) > 0 THEN CAST(length(tg) AS DOUBLE) / CAST(length(md) AS DOUBLE) END AS length_ratio
FROM t""",
)
def translation_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source vs 'translated' Markdown: heading structure, kept keywords, length ratio."""
    d = _docs(spark, sf_dir, "text").select(
        "doc_id", doc_markdown(F.col("text")).alias("md"), F.array_distinct(T.tokens(doc_title(F.col("text")))).alias("kw")
    )
    t = d.withColumn("tg", _target_md(F.col("md"), F.col("doc_id")))
    p = A.translation_parity(F.col("md"), F.col("tg"), F.col("kw"))
    return t.select("doc_id", p["same_structure"].alias("same_structure"), p["keywords_kept"].alias("keywords_kept"),
                    p["length_ratio"].alias("length_ratio"))


@query(
    "plain_text",
    f"""WITH m AS (SELECT doc_id, {SQL_MARKDOWN} AS md FROM documents),
p AS (SELECT doc_id, {_sql_plain('md')} AS t FROM m)
SELECT doc_id, CAST(length(t) AS BIGINT) AS text_chars, md5(t) AS text_md5 FROM p""",
)
def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown stripped to plain text."""
    d = _docs(spark, sf_dir, "text").select("doc_id", R.markdown_to_text(doc_markdown(F.col("text"))).alias("t"))
    return d.select("doc_id", F.length("t").cast("bigint").alias("text_chars"), F.md5("t").alias("text_md5"))


_SQL_OTHER = """CASE (doc_id + length(language)) % 4 WHEN 0 THEN md WHEN 1 THEN regexp_replace(md, '(?m)^### ', '## ', 'g')
                  WHEN 2 THEN md || chr(10) || '## End' ELSE regexp_replace(md, '^# ', '') END"""


@query(
    "translation_tables",
    f"""WITH d AS (SELECT doc_id, {SQL_MARKDOWN} AS md, list_distinct({SQL_TOKENS.format(x=SQL_TITLE)}) AS kw FROM documents),
asked AS (SELECT doc_id, unnest(['zh', 'may']) AS language FROM d),
there AS (SELECT doc_id, language, {_SQL_OTHER} AS tg FROM d, (SELECT unnest(['zh', 'may', 'fr']) AS language)
          WHERE (language = 'zh' AND doc_id % 7 <> 0) OR language = 'may' OR (language = 'fr' AND doc_id % 11 = 0)),
j AS (SELECT coalesce(a.doc_id, t.doc_id) AS doc_id, coalesce(a.language, t.language) AS language, a.doc_id IS NOT NULL AS wanted, tg
      FROM asked a FULL OUTER JOIN there t ON a.doc_id = t.doc_id AND a.language = t.language),
l AS (SELECT j.*, md, kw, {SQL_LEVELS.format(md='md')} AS sl, CASE WHEN tg IS NOT NULL THEN {SQL_LEVELS.format(md='tg')} END AS tl FROM j JOIN d USING (doc_id)),
f AS (SELECT *, CASE WHEN tg IS NOT NULL THEN list_filter(range(1, greatest(len(sl), len(tl)) + 1), lambda i: sl[i] IS DISTINCT FROM tl[i])[1] END AS pos FROM l)
SELECT doc_id AS topic_id, language, CASE WHEN NOT wanted THEN 'unasked' WHEN tg IS NULL THEN 'missing' ELSE 'ok' END AS status,
       CASE WHEN tg IS NOT NULL THEN pos IS NULL END AS same_structure,
       CASE WHEN pos IS NULL THEN NULL WHEN pos > len(sl) THEN 'extra' WHEN pos > len(tl) THEN 'missing' ELSE 'level' END AS difference,
       CAST(pos AS INTEGER) AS position, CAST(sl[pos] AS INTEGER) AS source_level, CAST(tl[pos] AS INTEGER) AS target_level,
       CASE WHEN tg IS NOT NULL THEN CAST(len(list_filter(kw, lambda k: NOT contains(tg, k))) AS INTEGER) END AS keywords_lost,
       CASE WHEN tg IS NOT NULL AND length(md) > 0 THEN CAST(length(tg) AS DOUBLE) / CAST(length(md) AS DOUBLE) END AS length_ratio
FROM f""",
)
def translation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 on two tables: articles with the languages asked for, and the translations that came
    (some missing, some unasked, some with another heading level, a heading more or one fewer)."""
    d = _docs(spark, sf_dir, "text").select(
        F.col("doc_id").alias("topic_id"), doc_markdown(F.col("text")).alias("body"), F.array_distinct(T.tokens(doc_title(F.col("text")))).alias("keywords"),
        F.array(F.lit("zh"), F.lit("may")).alias("target_languages"),
    )
    t = d.select("topic_id", "body", F.explode(F.array(F.lit("zh"), F.lit("may"), F.lit("fr"))).alias("language"))
    t = t.where(((F.col("language") == "zh") & (F.col("topic_id") % 7 != 0)) | (F.col("language") == "may") | ((F.col("language") == "fr") & (F.col("topic_id") % 11 == 0)))
    kind = (F.col("topic_id") + F.length("language")) % 4
    other = (
        F.when(kind == 0, F.col("body"))
        .when(kind == 1, F.regexp_replace("body", r"(?md)^### ", "## "))
        .when(kind == 2, F.concat("body", F.lit("\n## End")))
        .otherwise(F.regexp_replace("body", r"\A# ", ""))
    )
    return A.parity_of_tables(d, t.select("topic_id", "language", other.alias("body")))
