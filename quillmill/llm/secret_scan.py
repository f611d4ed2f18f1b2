"""Secret scan over an incremental blob ledger, by built-in functions alone.

Every version of a text is a blob named by its SHA-256.  The ledger has a row for each
blob and rule version that was ever scanned, with what was found (possibly nothing).
A run looks up which (blob, rule version) pairs the ledger lacks, scans each such blob
once however many documents hold it, and joins the findings of old and new rows back to
all documents.  ``RULES`` belong to versions; giving a rule a new version scans all
blobs again for that version only.

Places are code points.  Spark's regular expressions return matches without places, so
a text is also split at the matches: the lengths of gaps and matches add up to places.

Null and empty texts have no findings.  Repeated rows share a blob and each get its
findings.  Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import release_shuffles, stored, whole_rows, with_text

SPAN = "array<struct<start:int,kind:int,end:int>>"
BLOCK = 256  # matches


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    version: str
    group: int = 0
    least: int = 0  # characters of the group


#: A key to its end line; without one, over the base64 lines that follow; else the header alone.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
    r"(?:[^-]*(?:-[^-]+){0,40}-----END [A-Z ]{0,30}PRIVATE KEY-----|[\x20\t]*[\r\n]+[A-Za-z0-9+/=]{16,}[A-Za-z0-9+/=\r\n]*)?"
)

#: Kinds in the order in which they are listed at equal starts.  A least length inside a
#: pattern says the same as dropping shorter matches, where those are maximal runs.
RULES: tuple[Rule, ...] = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "base-1", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", "base-1"),
    Rule("hex", r"[0-9a-f]{16,}", "base-1"),
    Rule("private_key", PRIVATE_KEY, "keys-2"),
    Rule("code_host", r"gh[opsru]_[A-Za-z0-9]{36,}", "keys-2"),
    Rule("chat", r"xox[abeprs]-[A-Za-z0-9-]{10,}", "keys-2"),
    Rule("payment", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", "keys-2"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "keys-2"),
)
BASE = 3  # of RULES


def rule_spans(text: Column, rule: Rule, kind: int) -> Column:
    """The spans of one rule in a text, in order."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    keys = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    met = F.arrays_zip(hits.alias("hit"), keys.alias("key"), F.split(text, rule.pattern, -1).alias("gap"))
    nothing = F.array().cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), nothing.alias("found"))

    def step(done: Column, x: Column) -> Column:
        begin = done["at"] + F.length(x["gap"])
        end = begin + F.length(F.coalesce(x["hit"], F.lit("")))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        whole = x["hit"].isNotNull() & (F.length(x["key"]) >= rule.least)
        return F.struct(end.alias("at"), F.when(whole, F.concat(done["found"], F.array(span))).otherwise(done["found"]).alias("found"))

    # block by block, so that a span is copied once in its block and once a later block, and not once a later span
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(met), F.lit(1)), F.lit(BLOCK)), lambda i: F.aggregate(F.slice(met, i, F.lit(BLOCK)), start, step))

    def put(done: Column, block: Column) -> Column:
        moved = F.transform(block["found"], lambda x: F.struct((x["start"] + done["at"]).alias("start"), x["kind"].alias("kind"), (x["end"] + done["at"]).alias("end")))
        return F.struct((done["at"] + block["at"]).alias("at"), F.concat(done["found"], moved).alias("found"))

    walked = F.aggregate(blocks, start, put, lambda done: done["found"])
    return F.when(text.rlike(rule.pattern), walked).otherwise(nothing)


def blob_table(docs: DataFrame) -> DataFrame:
    """doc_id and ``blob``: the content address of each row's text, with the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("blob", F.sha2("text", 256))


def unseen(blobs: DataFrame, ledger: DataFrame | None, versions: list[str]) -> DataFrame:
    """blob and ``missing``, the rule versions that the ledger has no row for."""
    every = F.array(*[F.lit(v) for v in versions])
    if ledger is None:
        return blobs.select("blob", every.alias("missing"))
    seen = ledger.filter(F.col("version").isin(versions)).groupBy("blob").agg(F.collect_set("version").alias("seen"))
    lacking = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", lacking.alias("missing")).filter(F.size("missing") > 0)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, version, spans) for the pairs that ``ledger`` lacks."""
    versions = list(dict.fromkeys(r.version for r in rules))
    rows = blob_table(docs)
    if ledger is not None:
        rows = rows.join(unseen(rows.select("blob").distinct(), ledger, versions), "blob")
    else:
        rows = rows.withColumn("missing", F.array(*[F.lit(v) for v in versions]))
    # one text a blob; copies meet at the first aggregation, before the shuffle
    once = rows.groupBy("blob").agg(F.first("text").alias("text"), F.first("missing").alias("missing"))

    def found(version: str) -> Column:
        spans = [rule_spans(F.col("text"), r, k) for k, r in enumerate(rules) if r.version == version]
        return F.array_sort(F.array_distinct(F.concat(*spans)))

    pairs = F.array(*[F.struct(F.lit(v).alias("version"), F.when(F.array_contains("missing", v), found(v)).alias("spans")) for v in versions])
    rows = once.select("blob", F.explode(pairs).alias("p")).select("blob", "p.version", "p.spans")
    return rows.filter(F.col("spans").isNotNull())


def blob_findings(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and ``spans`` of the blobs in which something was found, from old and new ledger rows.

    They are written before they are joined back: Spark then splits the join where very many paths have one blob.
    """
    new = scan(docs, ledger, rules)
    versions = list(dict.fromkeys(r.version for r in rules))
    return _by_blob(new if ledger is None else new.unionByName(ledger.filter(F.col("version").isin(versions)).select("blob", "version", "spans")))


def _by_blob(rows: DataFrame) -> DataFrame:
    """blob and all its ``spans``, from ledger rows."""
    # a rule version has a row of its own, and several where writers repeated it
    found = rows.filter(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return stored(found, "findings")


def findings(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob and ``spans`` of each row."""
    paths = blob_table(docs).select("doc_id", "blob")
    nothing = F.array().cast(SPAN)
    return paths.join(blob_findings(docs, ledger, rules), "blob", "left").select("doc_id", "blob", F.coalesce("spans", nothing).alias("spans"))


def _named(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    parts = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(parts, ",")


def secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans."""
    return _counted(findings(docs, ledger, rules), rules)


def _counted(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")
    base = F.filter(spans, lambda x: x["kind"] < BASE)
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{rules[k].kind}") for k in range(BASE)],
        F.sha2(_named(base, rules), 256).alias("base_sha256"),
        _named(spans, rules).alias("spans"),
    )


def arrivals(docs: DataFrame, parts: int = 2) -> list[DataFrame]:
    """The rows as they would come in several deliveries, dealt by a hash of the id."""
    return [docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == k) for k in range(parts)]


def incremental_secrets(deliveries: list[DataFrame], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The findings of all rows of all deliveries: each delivery scans only the blobs that no earlier one had, and adds them to the ledger."""
    every = deliveries[0]
    for d in deliveries[1:]:
        every = every.unionByName(d)
    ledger = None
    for k, d in enumerate(deliveries[:-1]):
        new = stored(scan(d, ledger, rules), f"ledger{k}")
        ledger = new if ledger is None else ledger.unionByName(new)
    last = deliveries[-1]
    new = scan(last, ledger, rules) if ledger is not None else scan(last, None, rules)
    known = new if ledger is None else ledger.unionByName(new)
    nothing = F.array().cast(SPAN)
    joined = blob_table(every).select("doc_id", "blob").join(_by_blob(known), "blob", "left")
    return _counted(joined.select("doc_id", "blob", F.coalesce("spans", nothing).alias("spans")), rules)


def append_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` lacks, append it there, and return the findings of all rows."""
    spark = docs.sparkSession
    schema = f"blob string, version string, spans {SPAN}"
    try:
        ledger = spark.read.schema(schema).parquet(path)
        ledger.limit(0).count()
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        ledger = None
    scan(docs, ledger, rules).write.mode("append").parquet(path)
    return secrets(docs, spark.read.schema(schema).parquet(path), rules)


def masked(docs: DataFrame, mark: str = "[secret]", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` with every finding in ``text`` replaced by ``mark``; overlapping findings become one.

    Without a ledger every text is to be scanned, so rows are matched where they are read: those without a match of
    any rule have no finding and stay as they are; the others become blobs, and only they are shuffled.
    """
    if ledger is not None:
        return _masked(docs, mark, ledger, rules)
    matched = F.lit(False)
    for rule in rules:
        matched = matched | F.coalesce(F.col("text"), F.lit("")).rlike(rule.pattern)
    some = stored(docs.filter(matched), "matched")
    return docs.filter(~matched).unionByName(_masked(some, mark, None, rules))


def _masked(docs: DataFrame, mark: str, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    named = whole_rows(docs).withColumn("_blob", F.sha2(F.coalesce(F.col("t"), F.lit("")), 256))
    found = blob_findings(docs.select("doc_id", "text"), ledger, rules).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    release_shuffles(docs.sparkSession)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, x: Column) -> Column:
        inside = x["start"] < done["at"]
        gap = F.substring(F.col("t"), done["at"] + 1, x["start"] - done["at"])
        out = F.when(inside, done["out"]).otherwise(F.concat(done["out"], gap, F.lit(mark)))
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"), out.alias("out"))

    cleaned = F.aggregate("_spans", start, step, lambda d: F.concat(d["out"], F.substring(F.col("t"), d["at"] + 1, F.length("t"))))
    joined = named.join(found, "_blob", "left")
    return with_text(joined, docs.schema, F.when(F.col("_spans").isNull(), F.col("t")).otherwise(cleaned))
