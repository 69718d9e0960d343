"""Corpus analytics (P1-P14) on literal fixtures."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillframe.operators import analytics as A
from quillframe.operators import near_duplicates as NearDuplicates
from quillframe.operators import contracts as C


def test_heading_audit(spark):
    md = "# T\n## a\n#### deep\n## b\n# second"
    df = spark.createDataFrame([(md,)], "t string").select(A.heading_level_list("t").alias("lv"))
    a = df.select(A.heading_audit("lv").alias("a")).first().a
    assert (a.n_headings, a.n_h1, a.n_h2, a.level_jumps, a.h1_ok) == (5, 2, 2, 1, False)


def test_dedupe_lines(spark):
    t = "a\n b \n\nb\na\n\nc"
    r = spark.createDataFrame([(t,)], "t string").select(A.dedupe_lines("t").alias("r")).first().r
    assert r.text == "a\n b \n\n\nc" and r.lines == 7 and r.removed == 2


def test_readability(spark):
    r = spark.createDataFrame([("The cat sat. It ran!",)], "t string").select(A.readability("t").alias("r")).first().r
    assert (r.sentences, r.words, r.letters) == (2, 5, 14)
    assert abs(r.ari - (4.71 * 14 / 5 + 0.5 * 5 / 2 - 21.43)) < 1e-12


def test_keywords_and_density(spark):
    docs = spark.createDataFrame([(1, "spark spark rdd"), (2, "spark sql"), (3, "pandas")], "doc_id bigint, text string")
    k = {(r.doc_id, r.term): r.rank for r in A.top_keywords(docs, 2).collect()}
    assert k[(1, "rdd")] == 1 and k[(1, "spark")] == 2 and k[(2, "sql")] == 1
    kw = spark.createDataFrame([(1, "Spark"), (1, "rdd spark")], "doc_id bigint, keyword string")
    d = {r.keyword: r for r in A.keyword_density(docs, kw).collect()}
    assert d["Spark"].hits == 2 and abs(d["Spark"].density - 100 * 2 / 3) < 1e-9 and d["Spark"].stuffing


def test_keywords_by_bounds_equal_all_terms(spark):
    """Whatever part of the df table is broadcast, the keywords are those of a count over all terms; no shuffle by (document, term)."""
    rnd = random.Random(9)
    words = ["w" + chr(97 + i % 26) * (1 + i // 26) for i in range(120)]
    rows = [(i, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(len(words))], k=rnd.choice([1, 3, 30, 80])))) for i in range(60)]
    rows += [(3, "wa wa again"), (None, "wa nobody"), (None, "wb nobody"), (90, None), (91, ""), (92, "wa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    tfs = {}
    for d, t in rows:
        tfs.setdefault(d, Counter()).update((t or "").split())
    df = Counter(t for c in tfs.values() for t in c)
    want = set()
    for d, c in tfs.items():
        order = sorted((-(n * math.log(len(rows) / df[t])), t, n) for t, n in c.items())[:5]
        want |= {(d, t, n, df[t], r) for r, (_, t, n) in enumerate(order, 1)}
    for hot in (0, 1, 12, 10_000):
        found = A.top_keywords(docs, hot_terms=hot)
        assert {(r.doc_id, r.term, r.tf, r.df, r["rank"]) for r in found.collect()} == want, hot
        assert found.count() == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(doc_id#\d+L, term#", plan)


def test_page_audit_images_links(spark):
    html = ('<html><head><title>Short</title><meta name="description" content="' + "d" * 80 + '"></head>'
            '<body><h1>x</h1><img src=a.png><img alt="ok" src=b.png><a href="/p/2">two</a></body></html>')
    r = spark.createDataFrame([(html,)], "h string").select(
        A.page_audit("h").alias("p"), A.image_alt_audit(html="h", md=F.lit("![](x.png) ![alt](y.png)")).alias("i"), A.links("h").alias("l")
    ).first()
    assert r.p.title_chars == 5 and not r.p.title_ok and r.p.description_ok and r.p.n_h1 == 1
    assert (r.i.images, r.i.missing_alt) == (4, 2) and r.l == ["/p/2"]


def test_shingle_overlap(spark):
    words = " ".join(f"w{chr(97 + i)}" for i in range(12))  # 12 tokens
    docs = spark.createDataFrame([(1, "wa wb wc wd we wf wg wh"), (2, "short text")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, "xx wa wb wc wd we wf wg wh yy")], "item_id bigint, text string")
    o = A.shingle_overlap(docs.withColumn("text", F.regexp_replace("text", "w", "")), bench.withColumn("text", F.regexp_replace("text", "w", "")), 8).collect()
    assert len(o) == 1 and o[0].doc_id == 1 and o[0].shared == 1 and o[0].containment == 1.0
    assert words


def test_url_references(spark):
    """The forms of a reference, resolved by hand (host, path)."""
    base = "https://Me@WWW.site.org:443/a/b/c.html?q=1#top"
    cases = {
        "https://other.org": ("other.org", "/"), "HTTP://Other.org:80/x?y#z": ("other.org", "/x"), "http://other.org:443/": ("other.org:443", "/"),
        "//cdn.org/p": ("cdn.org", "/p"), "/": ("www.site.org", "/"), "/x/./y/../z": ("www.site.org", "/x/z"), "d": ("www.site.org", "/a/b/d"),
        "../d/": ("www.site.org", "/a/d/"), "../../../up": ("www.site.org", "/up"), "./": ("www.site.org", "/a/b/"), "..": ("www.site.org", "/a/"),
        "?q=2": ("www.site.org", "/a/b/c.html"), "#part": ("www.site.org", "/a/b/c.html"), "": ("www.site.org", "/a/b/c.html"), "/.well-known/x": ("www.site.org", "/.well-known/x"),
        "mailto:me@x.org": None, "javascript:void(0)": None, "data:text/plain,x": None, "ftp://x.org/": None, "http:x": None,
    }
    df = spark.createDataFrame([(k, base) for k in cases], "h string, b string")
    got = {r.h: r.p and tuple(r.p) for r in df.select("h", A.url_page(F.col("h"), F.col("b")).alias("p")).collect()}
    assert got == cases
    assert spark.range(1).select(A.url_page(F.lit("/x"), F.lit(None).cast("string"))).first()[0] is None


def test_link_candidates_of_two_sites_and_a_hot_term(spark):
    page = "page_id bigint, url string, html string, text string"
    rows = [
        (1, "http://a.org/", '<a href="/x">x</a><a href="/x#y">again</a><a href="/">me</a>', "hot rare"),
        (2, "http://a.org/x", '<a href="http://B.org">b</a>', "hot rare rare"),
        (3, "http://b.org/", '<a href="mailto:q">q</a>', "hot hot alone"),
        (4, "https://b.org/y", '<a href="..">up</a><a href="//a.org/x">x</a>', "hot rare"),
    ]
    rows += [(i, f"http://c.org/{i}", "", "hot") for i in range(10, 210)]
    pages = spark.createDataFrame(rows, page)
    inv = A.link_inventory(pages).cache()
    # the root paths of a.org and b.org are two pages; 4 lies on https, the same host
    assert sorted(map(tuple, inv.collect())) == [(1, 2), (2, 3), (4, 2), (4, 3)]
    got = {(r.page_id, r.term): tuple(r[2:]) for r in A.link_candidates(A.term_index(pages).cache(), inv).collect()}
    assert got[1, "rare"] == (1, 3, 1, 1, 2, True) and got[2, "rare"] == (2, 3, 0, 2, 1, False) and got[4, "rare"] == (1, 3, 1, 1, 2, True)
    assert got[4, "hot"] == (1, 204, 2, 201, 3, True) and got[3, "hot"] == (2, 204, 0, 203, 1, False)
    assert len([k for k in got if k[1] == "hot"]) == 204 and ("alone" not in {k[1] for k in got})
    # a page that links every other holder of a term has no candidate for it
    full = inv.unionByName(spark.createDataFrame([(4, 1)], "page_id bigint, target bigint"))
    assert (4, "rare") not in {(r.page_id, r.term) for r in A.link_candidates(A.term_index(pages), full).collect()}


def test_near_duplicates_equal_all_pairs(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = rnd.choices(words, k=rnd.choice([3, 30, 90, 300]))
        texts.append(" ".join(base))
        for _ in range(6):
            other = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 5])):
                other[rnd.randrange(len(other))] = rnd.choice(words)
            texts.append(" ".join(other))
    texts += [texts[0]] * 40 + ["", "!!", "one two", "two one"]  # copies, no tokens, short texts
    sets = {}
    for i, t in enumerate(texts):
        tk = t.split() if t != "!!" else []
        if tk:
            sets.setdefault(frozenset(" ".join(tk[j : j + 5]) for j in range(max(1, len(tk) - 4))), []).append(i)
    want = {}
    for x, ix in sets.items():
        for y, iy in sets.items():
            if ix[0] < iy[0] and len(x & y) >= 0.8 * len(x | y):
                want[ix[0], iy[0]] = len(x & y)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    df = df.withColumn("text", F.translate("text", "0123456789", "abcdefghij"))
    pairs, members = NearDuplicates.near_duplicates(df)
    got = {(r.class_a, r.class_b): r.shared for r in pairs.collect()}
    assert want and got == want
    assert {r.doc_id: (r.class_id, r.copies) for r in members.collect()} == {i: (ix[0], len(ix)) for ix in sets.values() for i in ix}


def test_overlap_is_the_same_by_every_route(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{chr(97 + (i * k) % 7)}" for k in range(40)) + " common words in every text that there is") for i in range(60)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "so common words in every text that there is here"), (2, docs.first().text)], "item_id bigint, text string")
    want = sorted(map(tuple, A.shingle_overlap(docs, items).collect()))
    assert len(want) > 60 and sorted(map(tuple, A.shingle_overlap(docs, items, broadcast_rows=0, hot=20).collect())) == want


def test_outline_coverage(spark):
    md = spark.createDataFrame([(1, "# Intro\none two\n## Body\nthree\n## Extra\nfour five six")], "doc_id bigint, md string")
    secs = A.article_sections(md)
    outline = spark.createDataFrame([(1, "intro", 10), (1, "Body ", 10), (1, "Missing", 5)], "doc_id bigint, heading string, word_allocation int")
    r = A.outline_coverage(secs, outline).first()
    assert (r.outline_sections, r.covered, r.missing, r.extra, r.allocated_words, r.covered_words) == (3, 2, 1, 1, 25, 3)


def test_translation_parity_and_band(spark):
    r = spark.createDataFrame([("# A\n## b\nspark", "# X\n## y\nspark")], "s string, t string").select(
        A.translation_parity(F.col("s"), F.col("t"), F.array(F.lit("spark"))).alias("p"),
        A.word_target_band(F.lit(700), F.lit(1000)).alias("b1"), A.word_target_band(F.lit(1300), F.lit(1000)).alias("b2"),
    ).first()
    assert r.p.same_structure and r.p.keywords_kept and r.b1 == "under" and r.b2 == "over"


def test_contract_flatteners(spark):
    pub = '{"formats": {"markdown": "# x", "social_twitter": "' + "t" * 300 + '"}, "metadata": {"title": "T", "tags": ["a", "b"]}}'
    df = spark.createDataFrame([(1, pub)], "topic_id bigint, content string")
    rows = {r.format: r for r in C.publisher_formats(df).collect()}
    assert rows["markdown"].text == "# x" and rows["markdown"].tags == "a,b"
    assert not spark.createDataFrame([(rows["social_twitter"].text,)], "t string").select(C.social_within_limit(F.col("t"))).first()[0]
    seo = spark.createDataFrame([(1, '{"seo_score": 85, "keyword_analysis": {"keyword_density": "2.5%"}}')], "topic_id bigint, content string")
    s = C.seo_report(seo).first()
    assert s.seo_score == 85.0 and s.keyword_density == 2.5


def test_coverage_within_the_row_equals_the_joined_form(spark):
    rnd = random.Random(8)
    docs, outlines = [], []
    for i in range(40):
        heads = [rnd.choice(["Intro", " intro ", "BODY", "Body  two", "End", "Extra"]) for _ in range(rnd.randrange(0, 7))]
        docs.append((i, "".join(f"{'#' * rnd.randint(1, 3)} {h}\n{'word ' * rnd.randrange(5)}\n" for h in heads)))
        outlines.append((i, [(rnd.choice(["intro", "body", "body two", "missing"]), rnd.randrange(50)) for _ in range(rnd.randrange(0, 5))]))
    md = spark.createDataFrame(docs, "doc_id bigint, md string")
    ol = spark.createDataFrame(outlines, "doc_id bigint, o array<struct<heading:string,word_allocation:int>>")
    joined = A.outline_coverage(A.article_sections(md), ol.select("doc_id", F.inline("o")))
    within = A.outline_coverage_rows(md.join(ol, "doc_id"), F.col("o"))
    assert sorted(map(tuple, within.select(*joined.columns).collect())) == sorted(map(tuple, joined.collect()))
