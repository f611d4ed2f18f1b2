"""Documents to sections, chunks and search records, and their profiles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions import chunking as C
from quillmill.functions.text import slug
from quillmill.plans.catalogue import register
from quillmill.sources.views import table


def chunked(docs: DataFrame, profile: str = "next") -> DataFrame:
    """doc_id, chunk, start, end and content; each text by itself, in the task that reads it."""
    most, overlap = C.PROFILES[profile]

    def cut(batches):
        for b in batches:
            rows = [(d, k, s, e, x[s:e]) for d, x in zip(b["doc_id"], b["text"], strict=True) for k, (s, e) in enumerate(C.bounded_chunks(x or "", most, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start", "end", "content"])

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, chunk int, start int, end int, content string")


@register("chunk_documents")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunked(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "chunk", "start", "end", F.sha2("content", 256).alias("content_hash"))


@register("chunk_profiles")
def chunk_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both profiles side by side: counts, sizes, duplicates."""
    d, out = table(spark, sf_dir, "documents"), None
    for profile in C.PROFILES:
        c = chunked(d, profile).select("doc_id", F.length("content").alias("n"), F.sha2("content", 256).alias("h"))
        whole = c.agg(
            F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("parents"), F.min("n").alias("shortest"), F.percentile("n", 0.5).alias("median"), F.round(F.avg("n"), 3).alias("mean"),
            F.max("n").alias("longest"), (F.count("*") - F.count_distinct("h")).alias("duplicates"),
        )
        # nearest rank over the counts by size, of which a profile bounds the number
        upto = c.groupBy("n").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy("n")))
        rank = F.bround((F.col("chunks") - 1) * F.lit(0.95).cast("double"), 0)
        p95 = upto.join(F.broadcast(whole.select("chunks"))).filter(F.col("upto") > rank).agg(F.min("n").alias("p95"))
        c = whole.join(F.broadcast(p95)).withColumn("profile", F.lit(profile))
        out = c if out is None else out.unionByName(c)
    return out


@register(
    "size_summary",
    """WITH s AS (SELECT lang, length(text) AS n, sha256(text) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY lang) AS c FROM s)
SELECT lang, count(*) AS chunks, min(n) AS shortest, median(n) AS median, round(avg(n), 3) AS mean, max(n) FILTER (WHERE i = CAST(round_even((c - 1) * 0.95, 0) AS BIGINT)) AS p95, max(n) AS longest,
  count(*) FILTER (WHERE n > 8000) AS oversized, count(*) - count(DISTINCT h) AS duplicates FROM r GROUP BY lang""",
)
def size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes with the nearest-rank 95th percentile: counts by size are summed, so no group's rows are gathered."""
    d = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("n"), F.sha2("text", 256).alias("h"))
    plain = d.groupBy("lang").agg(
        F.count("*").alias("chunks"), F.min("n").alias("shortest"), F.percentile("n", 0.5).alias("median"), F.round(F.avg("n"), 3).alias("mean"), F.max("n").alias("longest"),
        F.count_if(F.col("n") > 8000).alias("oversized"), (F.count("*") - F.count_distinct("h")).alias("duplicates"),
    )
    by_size = d.groupBy("lang", "n").agg(F.count("*").alias("k"))
    w = Window.partitionBy("lang").orderBy("n")
    upto = by_size.withColumn("upto", F.sum("k").over(w)).join(plain.select("lang", "chunks"), "lang")
    rank = F.bround((F.col("chunks") - 1) * F.lit(0.95).cast("double"), 0)
    p95 = upto.filter(F.col("upto") > rank).groupBy("lang").agg(F.min("n").alias("p95"))
    return plain.join(p95, "lang")


@register("section_extract")
def section_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that headings open; repeated ids of a document get the number of their occurrence."""

    def cut(batches):
        for b in batches:
            rows = []
            for d, x in zip(b["doc_id"], b["text"], strict=True):
                text = C.clean_page(x or "")
                for k, (number, title, s, e) in enumerate(C.sections(text)):
                    kind = "contents" if C.contents_page(text[s:e]) else "section"
                    rows.append((d, k, number, title, s, e, kind, len(C.children(text[s:e]))))
            yield pd.DataFrame(rows, columns=["doc_id", "place", "number", "title", "start", "end", "kind", "n_children"])

    found = table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(cut, "doc_id long, place int, number string, title string, start int, end int, kind string, n_children int")
    base = slug(F.concat_ws(" ", "number", "title"))
    w = Window.partitionBy("doc_id", "section_id").orderBy("place")
    found = found.withColumn("section_id", base).withColumn("nth", F.row_number().over(w))
    named = F.when(F.col("nth") > 1, F.concat("section_id", F.lit("-occurrence-"), F.col("nth").cast("string"))).otherwise(F.col("section_id"))
    return found.select("doc_id", "place", named.alias("section_id"), "title", "start", "end", "kind", "n_children")


@register(
    "line_offsets",
    """WITH l AS (SELECT conv_id, turn, length(text) AS n FROM conversations), o AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT conv_id, turn, CAST(start AS BIGINT) AS start, CAST(lead(start, 1, start + n + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS next_start FROM o""",
)
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running offsets of pages (here: turns) in their joined text, and where the next one begins."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    c = c.withColumn("start", F.coalesce(F.sum(F.col("n") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return c.select("conv_id", "turn", "start", F.coalesce(F.lead("start").over(w), F.col("start") + F.col("n") + 1).alias("next_start"))


@register(
    "context_format",
    """SELECT conv_id, string_agg('[' || CAST(turn + 1 AS VARCHAR) || '] ' || role || ': ' || left(text, 40), chr(10) || chr(10) ORDER BY turn) AS context FROM conversations WHERE turn < 6 GROUP BY conv_id""",
)
def context_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered blocks of the first sources, joined by blank lines."""
    line = F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("] "), "role", F.lit(": "), F.substring("text", 1, 40))
    c = table(spark, sf_dir, "conversations").filter("turn < 6").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("s"))
    return c.select("conv_id", F.array_join(F.transform("s", lambda x: x["line"]), "\n\n").alias("context"))


#: White space of any script, for Java's and DuckDB's engines alike, and a line that holds several columns.
_SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_COLUMNS = rf"[^{_SPACE}](?:[{_SPACE}]*\||\t|\x20{{3,}})[{_SPACE}]*[^{_SPACE}][^\n]*(?:\||\t|\x20{{3,}})"


def table_like(text: Column) -> Column:
    """At least three rows and an eighth of the lines hold several columns; null is an empty text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{_SPACE}]"))
    counted = F.aggregate(lines, F.struct(F.lit(0).alias("lines"), F.lit(0).alias("rows")), lambda s, x: F.struct((s["lines"] + 1).alias("lines"), (s["rows"] + x.rlike(_COLUMNS).cast("int")).alias("rows")))
    return F.element_at(F.transform(F.array(counted), lambda s: (s["rows"] >= 3) & (100 * s["rows"] >= 12 * s["lines"])), 1)


@register(
    "preflight_profile",
    rf"""WITH l AS (SELECT doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines FROM documents),
r AS (SELECT *, len(list_filter(lines, lambda x: regexp_matches(x, '{_COLUMNS}'))) AS rows FROM l)
SELECT doc_id, rows >= 3 AND 100 * rows >= 12 * len(lines) AS table_like, length(regexp_replace(coalesce(text, ''), '[{_SPACE}]', '', 'g')) >= 40 AS text_page FROM r""",
)
def preflight_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which whole texts hold enough letters to need no recognition of images, and which look like tables."""
    visible = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"[^{_SPACE}]"))
    return table(spark, sf_dir, "documents").select("doc_id", table_like(F.col("text")).alias("table_like"), (visible >= 40).alias("text_page"))


@register(
    "active_content",
    """SELECT page_id, list_filter([CASE WHEN regexp_matches(lower(html), '<script') THEN 'script' END, CASE WHEN regexp_matches(lower(html), '<iframe|<object|<embed') THEN 'embedded' END, CASE WHEN regexp_matches(lower(html), 'javascript:') THEN 'link' END,
  CASE WHEN starts_with(html, '%PDF') THEN 'pdf' END], lambda x: x IS NOT NULL) AS markers FROM pages""",
)
def active_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.lower("html")
    markers = F.array(F.when(h.contains("<script"), "script"), F.when(h.rlike("<iframe|<object|<embed"), "embedded"), F.when(h.contains("javascript:"), "link"), F.when(F.col("html").startswith("%PDF"), "pdf"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_compact(markers).alias("markers"))


@register(
    "search_records",
    """SELECT doc_id, upper(source) || '|' || lower(lang) || '|' || CAST(doc_id AS VARCHAR) AS id, lang || ' ' || source || ' ' || left(text, 100) AS search_text, sha256(text) AS content_hash, left(text, 300) AS preview, length(text) AS content_length FROM documents""",
)
def search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.concat_ws("|", F.upper("source"), F.lower("lang"), F.col("doc_id").cast("string")).alias("id"), F.concat_ws(" ", "lang", "source", F.substring("text", 1, 100)).alias("search_text"),
        F.sha2("text", 256).alias("content_hash"), F.substring("text", 1, 300).alias("preview"), F.length("text").cast("long").alias("content_length"),
    )


@register("numeric_grounding")
def numeric_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of an assistant's turn, and whether the turn before it holds them."""

    def judge(batches):
        for b in batches:
            rows = []
            for c, t, answer, evidence in zip(b["conv_id"], b["turn"], b["text"], b["evidence"], strict=True):
                claims = C.numeric_claims(answer or "")
                good = sum(C.supported(x, answer, evidence or "") for x in claims)
                rows.append((c, t, len(claims), good, C.without_unsupported(answer or "", evidence or "")))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "n_claims", "n_supported", "cleaned"])

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("evidence", F.lag("text").over(w)).filter("role = 'assistant'")
    return c.select("conv_id", "turn", "text", "evidence").mapInPandas(judge, "conv_id long, turn long, n_claims int, n_supported int, cleaned string")


@register(
    "status_ladder",
    """WITH r AS (SELECT b.item_id, b.item_id % 5 AS kind, length(b.text) AS n FROM benchmark b) SELECT item_id,
  CASE WHEN kind = 4 THEN 'UNSCORABLE' WHEN n % 3 = 0 AND kind < 2 THEN 'PASS_PAGE' WHEN n % 3 = 0 THEN 'PASS_SECTION_HINT' WHEN kind = 3 THEN 'FAIL_SECTION' WHEN n % 3 = 1 THEN 'PASS_DOC' ELSE 'FAIL_WRONG_SOURCE' END AS status,
  CASE WHEN kind = 4 THEN 'none' WHEN n % 3 = 0 THEN 'none' WHEN kind = 3 THEN 'selection' ELSE CASE WHEN n % 3 = 1 THEN 'none' ELSE 'candidate' END END AS miss FROM r""",
)
def status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation statuses in order of strictness, and where a miss arose."""
    kind, n = F.col("item_id") % 5, F.length("text")
    page = n % 3 == 0
    status = (
        F.when(kind == 4, "UNSCORABLE").when(page & (kind < 2), "PASS_PAGE").when(page, "PASS_SECTION_HINT").when(kind == 3, "FAIL_SECTION").when(n % 3 == 1, "PASS_DOC").otherwise("FAIL_WRONG_SOURCE")
    )
    miss = F.when(kind == 4, "none").when(page, "none").when(kind == 3, "selection").when(n % 3 == 1, "none").otherwise("candidate")
    return table(spark, sf_dir, "benchmark").select("item_id", status.alias("status"), miss.alias("miss"))


@register(
    "profile_comparison",
    """WITH a AS (SELECT p_brand, list(p_partkey ORDER BY p_retailprice DESC, p_partkey)[1:10] AS a, list(p_partkey ORDER BY p_size DESC, p_partkey)[1:10] AS b FROM part GROUP BY p_brand)
SELECT p_brand, a[1] = b[1] AS top_match, list_contains(b[1:5], a[1]) AS in_top5, list_contains(b, a[1]) AS in_top10, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM a""",
)
def profile_comparison(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The top lists of two profiles of a question; only what ranks in a list is gathered."""
    from quillmill.functions.vectors import jaccard
    from quillmill.operators.retrieval import ranked_lists

    lists = ranked_lists(spark, sf_dir).filter((F.col("r1") <= k) | (F.col("r2") <= k))
    top = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col(r) <= k, F.struct(r, "p_partkey")))), lambda x: x["p_partkey"])
    t = lists.groupBy("p_brand").agg(top("r1").alias("a"), top("r2").alias("b"))
    first = F.get("a", F.lit(0))
    return t.select(
        "p_brand", (first == F.get("b", F.lit(0))).alias("top_match"), F.array_contains(F.slice("b", 1, 5), first).alias("in_top5"), F.array_contains("b", first).alias("in_top10"), F.round(jaccard(F.col("a"), F.col("b"), 1.0), 6).alias("jaccard")
    )
