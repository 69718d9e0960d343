"""Corpus analytics asked of the model by the reference prompts (P1-P14),
given deterministic definitions of our own.

Scale notes:
* Per-document work (headings, readability, redundancy, coverage arrays)
  uses higher-order functions on the row itself: no shuffle, and cost is
  O(n log n) in the document's own size.
* Corpus statistics (document frequency, keyword hubs, shingle overlap) are
  hash aggregations with partial aggregation, so a term or shingle held by a
  third of all documents is pre-aggregated per task before the shuffle.
* No operator emits all pairs within a group: link candidates come from one
  "hub" document per keyword (an aggregate), and overlap joins documents to
  a benchmark set on exact shingles (output bounded by doc shingles x
  matching benchmark items; AQE splits a skewed shingle partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import text as T


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ P1 headings


def heading_levels(md: Column | str) -> Column:
    """array<struct<pos int, level int, text string>> of Markdown ATX headings (# .. ######)."""
    lines = F.split(_c(md), "\n")
    items = F.transform(
        lines,
        lambda l, i: F.struct(
            i.alias("pos"),
            F.length(F.regexp_extract(l, r"^(#{1,6}) ", 1)).alias("level"),
            F.regexp_replace(l, r"^#{1,6} ", "").alias("text"),
        ),
    )
    return F.filter(items, lambda x: x["level"] > 0)


def heading_audit(levels: Column | str) -> Column:
    """struct(n_headings, n_h1, n_h2, n_h3, level_jumps, h1_ok, levels)
    from an array of heading levels (see :func:`heading_levels`; pass a
    column reference so the array is computed once per row).

    A jump is a heading more than one level deeper than the previous heading;
    h1_ok means exactly one H1.
    """
    lv = _c(levels)
    n = F.size(lv)
    jumps = F.size(
        F.filter(
            F.zip_with(F.slice(lv, 2, F.greatest(n - 1, F.lit(0))), F.slice(lv, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: a - b > 1),
            lambda x: x,
        )
    )

    def cnt(k: int) -> Column:
        return F.size(F.filter(lv, lambda x: x == k))

    return F.struct(
        n.cast("int").alias("n_headings"),
        cnt(1).cast("int").alias("n_h1"),
        cnt(2).cast("int").alias("n_h2"),
        cnt(3).cast("int").alias("n_h3"),
        jumps.cast("int").alias("level_jumps"),
        (cnt(1) == 1).alias("h1_ok"),
        lv.alias("levels"),
    )


def heading_level_list(md: Column | str) -> Column:
    """array<int> of heading levels in document order."""
    return F.transform(heading_levels(md), lambda x: x["level"])


# -------------------------------------------------------------- P3 keywords


def term_frequencies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf): explode tokens then count -- partial aggregation per task."""
    # explode_outer + filter: keeps the tokenizer from running twice (see shingle_overlap)
    terms = docs.select(key, F.explode_outer(T.tokens(text)).alias("term")).where(F.col("term").isNotNull())
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


#: Terms whose document frequency is broadcast, at most.
HOT_TERMS = 200_000


def top_keywords(docs: DataFrame, k: int = 5, key: str = "doc_id", text: str = "text",
                 tf: DataFrame | None = None, hot_terms: int = HOT_TERMS) -> DataFrame:
    """Per document the k terms with the highest tf * ln(N / df), ties by term.

    N = number of documents (a scalar subquery), df = documents containing
    the term (aggregate on term).  Only terms that can be among a document's k
    meet the whole df table: the df of at most ``hot_terms`` most frequent terms
    are broadcast, any other term lies below their least df and so between two
    scores, and what is below k lower bounds is out.  Texts are dealt by key
    once, so counts and bounds need no shuffle of their own.
    """
    tf = tf if tf is not None else term_frequencies(docs.select(key, text).repartition(key), key, text)
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    tf = _possible_keywords(tf, df, n_docs, k, key, hot_terms)
    scored = tf.join(df, "term").select(
        key, "term", "tf", "df", (F.col("tf") * F.log(n_docs / F.col("df"))).alias("score")
    )
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("term"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _possible_keywords(tf: DataFrame, df: DataFrame, n_docs: Column, k: int, key: str, hot_terms: int) -> DataFrame:
    """The rows of ``tf`` whose score can be among their document's k highest."""
    steps = [1 << i for i in range(62)]
    counts = df.agg(F.array(*[F.count_if(F.col("df") >= s) for s in steps]).alias("n"))
    few = F.filter(F.arrays_zip(F.array(*[F.lit(s).cast("long") for s in steps]).alias("df"), F.col("n").alias("n")), lambda x: x["n"] <= hot_terms)
    least = counts.select(F.get(few, F.lit(0))["df"]).scalar()
    hot = F.broadcast(df.where(F.col("df") >= least).select("term", F.col("df").alias("_df")))  # at most hot_terms rows

    def score(d: Column) -> Column:
        return F.col("tf") * F.log(n_docs / d)

    low = F.coalesce("_df", F.greatest(least - 1, F.lit(1)))
    bound = tf.join(hot, "term", "left").select(key, "term", "tf", score(low).alias("_low"), score(F.coalesce("_df", F.lit(1))).alias("_high"))
    w = Window.partitionBy(key).orderBy(F.col("_low").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kth = F.coalesce(F.nth_value("_low", k).over(w), F.lit(0.0))
    # a score's last digits may differ from its bounds'
    return bound.withColumn("_kth", kth).where(F.col("_high") >= F.col("_kth") * (1 - 1e-9)).select(key, "term", "tf")


# -------------------------------------------------------------- P2 density


def keyword_density_rows(df: DataFrame, key: str, text: str, keywords: Column | str, stuffing_pct: float = 3.0) -> DataFrame:
    """P2 on rows that carry their own keyword list (``keywords`` array<string>).

    A keyword matches as a whole token sequence of the lower-cased text
    (tokens = runs of letters), case-insensitive.  hits = matches; density =
    100 * hits * words in keyword / word_count(text), null when the text has
    no words; stuffing when density > ``stuffing_pct``.

    All within the row, no shuffle.  The tokens are sorted once and their runs
    counted, O(n log n) however many keywords there are; a one-word keyword
    looks its run up, a phrase is matched on the token array.  Case variants of
    a keyword are one row.
    """
    a = df.select(
        key,
        T.tokens(text).alias("_tk"),
        T.word_count(text).alias("word_count"),
        F.transform(_c(keywords), lambda k: F.struct(k.alias("keyword"), T.tokens(k).alias("kt"))).alias("_kws"),
    )
    # each step is a column of its own: read inside a lambda, an expression would be evaluated per element
    a = a.withColumn("_st", F.array_sort("_tk"))
    places = F.transform("_st", lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    a = a.withColumn("_runs", F.filter(places, lambda x: (x["i"] == 0) | (F.get(F.col("_st"), x["i"] - 1) != x["t"])))
    ends = F.transform("_runs", lambda x, j: F.coalesce(F.get(F.col("_runs"), j + 1)["i"], F.size("_st")) - x["i"])
    a = a.withColumn("_counts", F.map_from_arrays(F.transform("_runs", lambda x: x["t"]), ends))
    tk = F.col("_tk")
    n = F.size(tk)

    def phrase_hits(kt: Column) -> Column:
        m = F.size(kt)
        return F.when(n >= m, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))), lambda i: F.slice(tk, i, m) == kt)))

    def word_hits(kt: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("_counts"), F.try_element_at(kt, F.lit(1))), F.lit(0))

    def counted(kt: Column) -> Column:
        variants = F.transform(F.filter("_kws", lambda k: k["kt"] == kt), lambda k: k["keyword"])
        hits = F.when(F.size(kt) == 0, F.lit(0)).when(F.size(kt) == 1, word_hits(kt)).otherwise(F.coalesce(phrase_hits(kt), F.lit(0)))
        return F.struct(F.array_max(variants).alias("keyword"), hits.cast("bigint").alias("hits"), F.size(kt).alias("n_words"))

    rows = F.transform(F.array_distinct(F.transform("_kws", lambda k: k["kt"])), counted)
    b = a.select(key, "word_count", F.explode_outer(rows).alias("k")).where(F.col("k").isNotNull())
    b = b.select(key, F.col("k.keyword").alias("keyword"), F.col("k.hits").alias("hits"), F.col("k.n_words").alias("n_words"), "word_count")
    b = b.where(F.col("keyword").isNotNull())
    wc = F.col("word_count")
    density = F.when(wc > 0, F.lit(100.0) * F.col("hits") * F.col("n_words") / wc)
    return b.select(key, "keyword", "hits", "word_count", density.alias("density")).withColumn(
        "stuffing", F.coalesce(F.col("density") > stuffing_pct, F.lit(False))
    )


def keyword_density(docs: DataFrame, keywords: DataFrame, key: str = "doc_id", text: str = "text",
                    stuffing_pct: float = 3.0) -> DataFrame:
    """P2 for a separate (key, keyword) table: keywords are gathered per
    document (a small list) and joined on the document key, then counted
    row-wise by :func:`keyword_density_rows`."""
    kw = keywords.groupBy(key).agg(F.array_sort(F.collect_set("keyword")).alias("_kw"))
    return keyword_density_rows(docs.select(key, text).join(kw, key), key, text, F.col("_kw"), stuffing_pct)


# ---------------------------------------------------------- P4 / P5 pages


def page_audit(html: Column | str, title_range: tuple[int, int] = (30, 60), desc_range: tuple[int, int] = (70, 160)) -> Column:
    """<title> and meta description lengths with within-limit flags."""
    h = _c(html)
    title = F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)
    has_title = h.rlike(r"(?is)<title[^>]*>.*?</title>")
    desc = F.regexp_extract(h, r"""(?is)<meta\s+name=["']description["']\s+content=["']([^"']*)["']""", 1)
    has_desc = h.rlike(r"""(?is)<meta\s+name=["']description["']""")
    tl = F.length(title)
    dl = F.length(desc)
    return F.struct(
        has_title.alias("has_title"),
        F.when(has_title, tl).cast("int").alias("title_chars"),
        (has_title & tl.between(*title_range)).alias("title_ok"),
        has_desc.alias("has_description"),
        F.when(has_desc, dl).cast("int").alias("description_chars"),
        (has_desc & dl.between(*desc_range)).alias("description_ok"),
        F.regexp_count(h, F.lit(r"(?i)<h1[\s>]")).cast("int").alias("n_h1"),
    )


def image_alt_audit(html: Column | str | None = None, md: Column | str | None = None) -> Column:
    """P5: struct(images, missing_alt) over HTML <img> tags and Markdown images."""
    zero = F.lit(0)
    n_html = miss_html = zero
    if html is not None:
        imgs = F.regexp_extract_all(_c(html), F.lit(r"(?i)(<img\b[^>]*>)"), 1)
        n_html = F.size(imgs)
        miss_html = F.size(F.filter(imgs, lambda t: ~t.rlike(r"""(?i)\balt\s*=\s*["'][^"']*\S[^"']*["']""")))
    n_md = miss_md = zero
    if md is not None:
        alts = F.regexp_extract_all(_c(md), F.lit(r"!\[([^\]]*)\]\([^)]*\)"), 1)
        n_md = F.size(alts)
        miss_md = F.size(F.filter(alts, lambda a: F.trim(a) == ""))
    return F.struct((n_html + n_md).cast("int").alias("images"), (miss_html + miss_md).cast("int").alias("missing_alt"))


def links(html: Column | str) -> Column:
    """Link inventory: href values of <a> tags."""
    return F.regexp_extract_all(_c(html), F.lit(r"""(?i)<a\s[^>]*href=["']([^"']*)["']"""), 1)


# -------------------------------------------------------- P6 link candidates


def _path_without_dots(path: Column) -> Column:
    """Dot segments removed: ``.`` goes, ``..`` takes the segment before it along; an empty path is ``/``."""
    parts = F.slice(F.split(path, "/", -1), 2, 1 << 20)
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(x == "..", up).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))

    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, none, step)
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    plain = F.when(F.contains(path, F.lit("/.")), F.concat(F.lit("/"), F.array_join(closed, "/"))).otherwise(path)
    return F.when(path == "", F.lit("/")).otherwise(plain)


def url_page(url: Column | str, base: Column | str | None = None) -> Column:
    """struct(host, path): the page that a link names, null if it names none.

    ``url`` is absolute or, with ``base`` (the absolute URL of the page that
    holds it), a reference of any form: ``//host/path``, ``/path``, ``path``,
    ``../path``, ``?query``, ``#part`` or empty.  Hosts are lower-cased,
    without user, and without a port that is the scheme's own; dot segments
    are removed; query and fragment name no other page.  Schemes other than
    http(s) (``mailto:``, ``javascript:``, ``data:``) name no page.
    """
    u = F.trim(_c(url))
    b = F.trim(_c(base)) if base is not None else F.lit(None).cast("string")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    base_scheme = F.lower(F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    base_host = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    base_path = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    own_host = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    with_host = u.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")
    own_path = F.when(with_host, F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)).otherwise(
        F.regexp_extract(u, r"^([^?#]*)", 1)
    )
    # a relative path takes the place of the base's last segment
    folder = F.regexp_extract(F.when(base_path == "", F.lit("/")).otherwise(base_path), r"^(.*/)", 1)
    path = (
        F.when(with_host, own_path)
        .when(own_path == "", base_path)
        .when(own_path.startswith("/"), own_path)
        .otherwise(F.concat(folder, own_path))
    )
    used = F.when(scheme != "", scheme).otherwise(base_scheme)
    host = F.lower(F.regexp_replace(F.when(with_host, own_host).otherwise(base_host), r"^[^@]*@", ""))
    port = F.when(used == "https", F.lit(":443")).otherwise(F.lit(":80"))
    host = F.regexp_replace(host, F.concat(port, F.lit("$")), F.lit(""))
    ok = used.isin("http", "https") & (host != "") & ((scheme == "") | with_host)
    return F.when(ok, F.struct(host.alias("host"), _path_without_dots(path).alias("path")))


def link_inventory(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, target): distinct links of each page to other pages of the table.

    Links are resolved against their page's URL and joined on (host, path), so
    two sites that share a path stay apart.
    """
    own = pages.select(F.col(key).alias("target"), url_page(F.col(url)).alias("p")).where(F.col("p").isNotNull())
    out = pages.select(F.col(key), F.col(url).alias("_u"), F.explode_outer(links(html)).alias("_h")).where(F.col("_h").isNotNull())
    named = out.select(key, url_page(F.col("_h"), F.col("_u")).alias("p")).where(F.col("p").isNotNull())
    # a page links a target once, however often: pairs are made distinct before they meet the targets
    named = named.select(key, "p.host", "p.path").distinct()
    return named.join(own.select("target", "p.host", "p.path"), ["host", "path"]).where(F.col(key) != F.col("target")).select(key, "target").distinct()


def term_index(texts: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """(term, key, tf, df): the inverted index with complete statistics, no term or page left out.

    tf counts per page, df pages per term; both are combined before their
    shuffles.  The join of df back onto a term that a third of all pages hold
    is a skewed join with one row on the other side, which AQE splits.
    """
    tf = term_frequencies(texts, key, text)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return tf.join(df, "term").select("term", key, "tf", "df")


def link_candidates(index: DataFrame, inventory: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per page and term that it shares with pages it does not link to.

    ``index`` is :func:`term_index`, ``inventory`` :func:`link_inventory`; both
    are read more than once, so pass written tables.  Per row: df (pages that
    hold the term), ``linked`` (of the other holders, those that the page
    links to already), ``candidates`` (those that it does not), and ``best``,
    the other holder with the term most often (ties: least key), with
    ``best_linked``.  Terms whose other holders are all linked drop out.

    Candidates are counted, not listed, so no page pairs arise: linked holders
    are found from the links (links x terms of the target, semi-joined with
    the page's own terms) and the two most frequent holders of a term by
    aggregates that combine before the shuffle.
    """
    shared = index.where(F.col("df") > 1)
    often = F.struct(F.col("tf").alias("tf"), (-F.col(key)).alias("k"))
    first = shared.groupBy("term").agg(F.max(often).alias("_1"))
    second = shared.join(first, "term").where(often != F.col("_1")).groupBy("term").agg(F.max(often).alias("_2"))
    tops = first.join(second, "term").select("term", (-F.col("_1.k")).alias("_first"), (-F.col("_2.k")).alias("_second"))

    held = inventory.join(shared.select(F.col(key).alias("target"), "term"), "target")
    held = held.join(shared.select(key, "term"), [key, "term"], "left_semi")
    linked = held.groupBy(key, "term").agg(F.count(F.lit(1)).alias("linked"))

    rows = shared.join(linked, [key, "term"], "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
    full = rows.where(F.col("df") - 1 - F.col("linked") > 0).join(tops, "term")
    full = full.withColumn("best", F.when(F.col("_first") == F.col(key), F.col("_second")).otherwise(F.col("_first")))
    known = inventory.select(F.col(key), F.col("target").alias("best"), F.lit(True).alias("best_linked"))
    full = full.join(known, [key, "best"], "left")
    return full.select(
        key, "term", "tf", "df", "linked", (F.col("df") - 1 - F.col("linked")).alias("candidates"), "best",
        F.coalesce("best_linked", F.lit(False)).alias("best_linked"),
    )


# ------------------------------------------------------------ P7 readability


def readability(text: Column | str) -> Column:
    """struct(sentences, words, letters, words_per_sentence, letters_per_word, ari).

    words = tokens, letters = letters in tokens, sentences = max(1, runs of
    [.!?]); ARI = 4.71 * letters/words + 0.5 * words/sentences - 21.43 (null
    without words).
    """
    toks = T.tokens(text)
    words = F.size(toks).cast("bigint")
    letters = F.aggregate(toks, F.lit(0).cast("bigint"), lambda a, t: a + F.length(t))
    sents = T.sentence_count(text)
    wps = F.when(words > 0, words.cast("double") / sents.cast("double"))
    lpw = F.when(words > 0, letters.cast("double") / words.cast("double"))
    ari = F.when(
        words > 0,
        F.lit(4.71) * letters.cast("double") / words.cast("double")
        + F.lit(0.5) * words.cast("double") / sents.cast("double")
        - F.lit(21.43),
    )
    return F.struct(
        sents.alias("sentences"), words.alias("words"), letters.alias("letters"),
        wps.alias("words_per_sentence"), lpw.alias("letters_per_word"), ari.alias("ari"),
    )


# ---------------------------------------------------------------- P8 overlap


def shingles(tokens: Column | str, w: int = 8) -> Column:
    """Distinct w-token shingles (tokens joined by one space); none when shorter than w.

    ``tokens`` must be a column reference (e.g. a selected ``T.tokens``
    column): it is read inside a lambda, which would otherwise re-run the
    tokenizer for every shingle.
    """
    toks = _c(tokens)
    n = F.size(toks)
    sh = F.transform(F.sequence(F.lit(1), F.greatest(n - w + 1, F.lit(1))), lambda i: F.array_join(F.slice(toks, i, w), " "))
    return F.when(n >= w, F.array_distinct(sh)).otherwise(F.expr("CAST(array() AS array<string>)"))


#: Reference shingles that may go to every task (12 bytes each).
OVERLAP_BROADCAST = 1_000_000
#: Documents that share one shingle before its rows are salted.
OVERLAP_HOT = 10_000
OVERLAP_SALTS = 32


def shingle_overlap(docs: DataFrame, corpus: DataFrame, w: int = 8, key: str = "doc_id", ref_key: str = "item_id",
                    text: str = "text", ref_text: str = "text", broadcast_rows: int = OVERLAP_BROADCAST, hot: int = OVERLAP_HOT) -> DataFrame:
    """Per (doc, reference item) sharing shingles: shared distinct shingles
    and containment = shared / doc's distinct shingles.

    Shingles meet as 64-bit hashes.  The reference's are written and counted:
    up to ``broadcast_rows`` they go to every task and the documents are not
    shuffled at all.  Beyond that, documents' shingles that no reference item
    holds are dropped first (semi join), and shingles that more than ``hot``
    documents share are salted, with their few reference rows repeated.
    ``explode_outer`` + a null filter keeps the optimizer from inferring a
    non-empty filter below the tokenizer projection (which would re-run the
    tokenizer inside the shingle lambda).
    """
    from quillframe.operators.inference import materialize

    def hashed(df: DataFrame, k: str, x: str) -> DataFrame:
        sh = df.select(F.col(k), T.tokens(x).alias("_tk")).select(k, shingles("_tk", w).alias("sh"))
        sh = sh.select(k, F.transform("sh", lambda s: F.xxhash64(s)).alias("sh"))
        return sh.select(k, F.size("sh").alias("own"), F.explode_outer("sh").alias("shingle")).where(F.col("shingle").isNotNull())

    rs = materialize(hashed(corpus, ref_key, ref_text).select(ref_key, "shingle").distinct(), "reference-shingles")
    ds = hashed(docs, key, text)
    if rs.count() <= broadcast_rows:
        j = ds.join(F.broadcast(rs), "shingle")
    else:
        ds = materialize(ds.join(rs.select("shingle").distinct(), "shingle", "left_semi"), "document-shingles")
        many = materialize(ds.groupBy("shingle").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select("shingle"), "hot-shingles")
        cold = ds.join(many, "shingle", "left_anti").join(rs, "shingle")
        salted = ds.join(many, "shingle", "left_semi").withColumn("_salt", F.pmod(F.xxhash64(F.col(key)), F.lit(OVERLAP_SALTS)))
        spread = rs.join(many, "shingle", "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(OVERLAP_SALTS - 1).cast("bigint"))))
        j = cold.unionByName(salted.join(spread, ["shingle", "_salt"]).drop("_salt"))
    return j.groupBy(key, ref_key).agg(
        F.count(F.lit(1)).alias("shared"), F.first("own").alias("own")
    ).select(key, ref_key, "shared", "own", (F.col("shared") / F.col("own")).alias("containment"))


# ------------------------------------------------------------ P9 redundancy


def dedupe_lines(text: Column | str) -> Column:
    """struct(text, lines, removed) with repeated non-blank lines removed.

    Lines split on ``\\n`` compare after stripping whitespace; the first
    occurrence is kept, blank lines always stay.  Sort-based per row
    (O(n log n)), no shuffle.
    """
    lines = F.split(_c(text), "\n")
    items = F.transform(lines, lambda l, i: F.struct(T.strip_ws(l).alias("k"), i.alias("i"), l.alias("l")))
    srt = F.array_sort(items)
    n = F.size(srt)
    prev = F.concat(F.array(F.lit(None).cast("string")), F.slice(F.transform(srt, lambda x: x["k"]), 1, F.greatest(n - 1, F.lit(0))))
    keep_flags = F.zip_with(
        srt,
        prev,
        lambda x, pk: F.struct(
            ((x["k"] == "") | pk.isNull() | (pk != x["k"])).alias("keep"),
            x["i"].alias("i"),
            x["l"].alias("l"),
        ),
    )
    kept = F.array_sort(F.transform(F.filter(keep_flags, lambda x: x["keep"]), lambda x: F.struct(x["i"].alias("i"), x["l"].alias("l"))))
    out = F.array_join(F.transform(kept, lambda x: x["l"]), "\n")
    return F.struct(out.alias("text"), n.cast("int").alias("lines"), (n - F.size(kept)).cast("int").alias("removed"))


# ----------------------------------------------------------- P10 coverage


def normalize_heading(h: Column) -> Column:
    return F.regexp_replace(T.strip_ws(F.lower(h)), f"{T.WS_CLASS}+", " ")


def with_sections(md: DataFrame, text: str = "md") -> DataFrame:
    """``md`` with ``_secs``: array of struct(heading, level, words), words being
    the word_count of the lines up to the next heading.

    Per-line arrays are materialised as columns first, so each section sums
    a slice of the per-line word counts: O(lines) per document, no shuffle.
    """
    given = md.columns
    lines = F.split(F.col(text), "\n")
    a = md.select("*", lines.alias("_lines"))
    a = a.select(
        "*",
        F.transform("_lines", lambda l: F.length(F.regexp_extract(l, r"^(#{1,6}) ", 1))).alias("_lv"),
        F.transform("_lines", lambda l: T.word_count(l)).alias("_wc"),
    )
    a = a.withColumn(
        "_heads", F.filter(F.transform("_lv", lambda l, i: F.struct(i.alias("pos"), l.alias("level"))), lambda x: x["level"] > 0)
    )
    heads = F.col("_heads")
    secs = F.transform(
        heads,
        lambda h, j: F.struct(
            F.regexp_replace(F.try_element_at(F.col("_lines"), h["pos"] + 1), r"^#{1,6} ", "").alias("heading"),
            h["level"].alias("level"),
            F.aggregate(
                F.slice(
                    F.col("_wc"),
                    h["pos"] + 2,
                    F.coalesce(F.try_element_at(heads, j + 2)["pos"], F.size(F.col("_wc"))) - h["pos"] - 1,
                ),
                F.lit(0).cast("bigint"),
                lambda acc, x: acc + x,
            ).alias("words"),
        ),
    )
    return a.select(*given, secs.alias("_secs"))


def article_sections(md: DataFrame, key: str = "doc_id", text: str = "md") -> DataFrame:
    """Sections of a Markdown article: (key, heading, norm, level, words), see :func:`with_sections`."""
    # explode_outer + filter: a plain explode makes the optimizer infer a
    # size(secs) > 0 filter and push it below the staged projections, which
    # would re-evaluate the per-line arrays inside the lambda.
    return with_sections(md.select(key, text), text).select(key, F.explode_outer("_secs").alias("s")).where(F.col("s").isNotNull()).select(
        key, F.col("s.heading").alias("heading"), normalize_heading(F.col("s.heading")).alias("norm"),
        F.col("s.level").alias("level"), F.col("s.words").alias("words"),
    )


COVERAGE = ("outline_sections", "covered", "missing", "extra")


def outline_coverage_rows(df: DataFrame, outline: Column, key: str = "doc_id", text: str = "md") -> DataFrame:
    """P10 on rows that hold their outline (array of struct(heading, word_allocation)) beside the article.

    Both lists are normalised, sorted together by heading and folded once, so a
    row costs O(n log n) in its own headings and nothing is shuffled.
    """
    a = with_sections(df.select(key, text, outline.alias("_outline")), text)
    item = lambda norm, alloc, words: F.struct(norm.alias("norm"), alloc.cast("bigint").alias("alloc"), words.cast("bigint").alias("words"))
    none = F.lit(None)
    planned = F.transform("_outline", lambda o: item(normalize_heading(o["heading"]), o["word_allocation"], none))
    there = F.transform("_secs", lambda s: item(normalize_heading(s["heading"]), none, s["words"]))
    a = a.select(key, F.array_sort(F.concat(F.coalesce(planned, F.array().cast("array<struct<norm:string,alloc:bigint,words:bigint>>")), there)).alias("_all"))
    zero = F.lit(0).cast("bigint")
    empty = F.struct(
        none.cast("string").alias("norm"), none.cast("bigint").alias("alloc"), none.cast("bigint").alias("words"),
        *[zero.alias(c) for c in (*COVERAGE, "allocated_words", "covered_words")],
    )

    def closed(acc: Column) -> Column:
        """The heading that ends here, counted."""
        o, w = acc["alloc"].isNotNull(), acc["words"].isNotNull()
        add = {"outline_sections": o, "covered": o & w, "missing": o & ~w, "extra": w & ~o}
        return F.struct(
            *[(acc[c] + add[c].cast("bigint")).alias(c) for c in COVERAGE],
            (acc["allocated_words"] + F.coalesce(acc["alloc"], zero)).alias("allocated_words"),
            (acc["covered_words"] + F.when(o, F.coalesce(acc["words"], zero)).otherwise(zero)).alias("covered_words"),
        )

    def plus(x: Column, y: Column) -> Column:
        return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x + y)

    def step(acc: Column, x: Column) -> Column:
        same = acc["norm"].eqNullSafe(x["norm"])
        done = closed(acc)
        return F.struct(
            x["norm"].alias("norm"),
            F.when(same, plus(acc["alloc"], x["alloc"])).otherwise(x["alloc"]).alias("alloc"),
            F.when(same, plus(acc["words"], x["words"])).otherwise(x["words"]).alias("words"),
            *[F.when(same, acc[c]).otherwise(done[c]).alias(c) for c in (*COVERAGE, "allocated_words", "covered_words")],
        )

    # one-element generator: a filter on the fold's result may not be pushed below it (it would run the fold twice)
    folded = F.when(F.size("_all") > 0, F.aggregate("_all", empty, step, closed))
    out = a.select(key, F.explode_outer(F.array(folded)).alias("_c")).where(F.col("_c").isNotNull()).select(key, "_c.*")
    ratio = F.when(F.col("allocated_words") > 0, F.col("covered_words").cast("double") / F.col("allocated_words").cast("double"))
    return out.withColumn("coverage_ratio", ratio)


def outline_coverage(sections: DataFrame, outline: DataFrame, key: str = "doc_id") -> DataFrame:
    """P10: outline sections (key, heading, word_allocation) vs article sections
    (key, norm, words) by normalised heading -> per key: covered, missing,
    extra, allocated and actual words, ratio."""
    o = outline.select(key, normalize_heading(F.col("heading")).alias("norm"), "word_allocation").groupBy(key, "norm").agg(
        F.sum("word_allocation").alias("alloc")
    )
    a = sections.groupBy(key, "norm").agg(F.sum("words").alias("words"))
    j = o.join(a, [key, "norm"], "full_outer")
    return j.groupBy(key).agg(
        F.count(F.when(F.col("alloc").isNotNull(), 1)).alias("outline_sections"),
        F.count(F.when(F.col("alloc").isNotNull() & F.col("words").isNotNull(), 1)).alias("covered"),
        F.count(F.when(F.col("alloc").isNotNull() & F.col("words").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("alloc").isNull() & F.col("words").isNotNull(), 1)).alias("extra"),
        F.sum(F.coalesce(F.col("alloc"), F.lit(0))).cast("bigint").alias("allocated_words"),
        F.sum(F.when(F.col("alloc").isNotNull(), F.coalesce(F.col("words"), F.lit(0))).otherwise(0)).cast("bigint").alias("covered_words"),
    ).withColumn(
        "coverage_ratio",
        F.when(F.col("allocated_words") > 0, F.col("covered_words").cast("double") / F.col("allocated_words").cast("double")),
    )


# ---------------------------------------------------------- P11 parity


def translation_parity(source_md: Column, target_md: Column, keywords: Column) -> Column:
    """struct(same_structure, keywords_kept, length_ratio).

    same_structure = the two heading-level sequences are equal; keywords_kept
    = every keyword occurs in the target; length_ratio = target/source chars.
    """
    ls = F.transform(heading_levels(source_md), lambda x: x["level"])
    lt = F.transform(heading_levels(target_md), lambda x: x["level"])
    return F.struct(
        (ls == lt).alias("same_structure"),
        F.forall(F.coalesce(keywords, F.array()), lambda k: target_md.contains(k)).alias("keywords_kept"),
        F.when(F.length(source_md) > 0, F.length(target_md).cast("double") / F.length(source_md).cast("double")).alias("length_ratio"),
    )


def parity_of_tables(
    sources: DataFrame,
    translations: DataFrame,
    key: str = "topic_id",
    body: str = "body",
    languages: str = "target_languages",
    keywords: str = "keywords",
    language: str = "language",
) -> DataFrame:
    """P11 on two tables: every translation held against its source, one row per (key, language).

    ``sources`` has the body, the languages asked for and the keywords to keep;
    ``translations`` (key, language, body).  ``status`` is ``missing`` (asked
    for, not there), ``unasked`` (there, not asked for) or ``ok``.  The heading
    levels of both are aligned one by one; ``difference`` names the first place
    where they part: ``level`` (``position`` from 1, ``source_level``,
    ``target_level``), ``missing`` or ``extra`` when one side has ended.

    One equi join on (key, language), both sides as they are; a translation of
    a key that has no source has a null source.
    """
    none = F.array().cast("array<string>")
    level = lambda c: F.transform(heading_levels(c), lambda x: x["level"].cast("int"))
    own = sources.select(F.col(key), level(body).alias("_sl"), F.length(body).alias("_sn"), F.coalesce(F.col(keywords), none).alias("_kw"), F.coalesce(F.col(languages), none).alias("_asked"))
    asked = own.select("*", F.explode(F.array_distinct("_asked")).alias(language))
    there = translations.select(F.col(key), F.col(language), F.col(body).alias("_t"))
    # both sides are cut to what they bring to the key: bodies of sources are not repeated per language
    wanted = asked.select(key, language, F.lit(True).alias("_wanted"))
    pairs = wanted.join(there, [key, language], "full_outer")
    rows = pairs.join(own.drop("_asked"), key, "left").withColumn("_tl", F.when(F.col("_t").isNotNull(), level("_t")))
    pairwise = F.zip_with("_sl", "_tl", lambda a, b: F.struct(a.alias("s"), b.alias("t")))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("struct<position:int,s:int,t:int>").alias("found"))
    fold = F.aggregate(
        pairwise, start,
        lambda acc, x: F.struct(
            (acc["at"] + 1).alias("at"),
            F.when(acc["found"].isNull() & ~x["s"].eqNullSafe(x["t"]), F.struct((acc["at"] + 1).alias("position"), x["s"].alias("s"), x["t"].alias("t"))).otherwise(acc["found"]).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    rows = rows.withColumn("_d", F.when(F.col("_sl").isNotNull() & F.col("_tl").isNotNull(), fold))
    d = F.col("_d")
    both = F.col("_t").isNotNull() & F.col("_sn").isNotNull()
    return rows.select(
        key, language,
        F.when(F.col("_wanted").isNull(), F.lit("unasked")).when(F.col("_t").isNull(), F.lit("missing")).otherwise(F.lit("ok")).alias("status"),
        F.when(both, d.isNull()).alias("same_structure"),
        F.when(d["s"].isNull() & d.isNotNull(), F.lit("extra")).when(d["t"].isNull() & d.isNotNull(), F.lit("missing")).when(d.isNotNull(), F.lit("level")).alias("difference"),
        d["position"].alias("position"), d["s"].alias("source_level"), d["t"].alias("target_level"),
        F.when(both, F.size(F.filter("_kw", lambda k: ~F.contains(F.col("_t"), k)))).alias("keywords_lost"),
        F.when(both & (F.col("_sn") > 0), F.length("_t").cast("double") / F.col("_sn").cast("double")).alias("length_ratio"),
    )


# ------------------------------------------------------------ P13 target


def word_target_band(words: Column, target: Column) -> Column:
    """P13: 'under' (< 0.8), 'on_target' (0.8 - 1.2), 'over' (> 1.2) of target words."""
    return (
        F.when(words * 10 < target * 8, F.lit("under"))
        .when(words * 10 > target * 12, F.lit("over"))
        .otherwise(F.lit("on_target"))
    )
