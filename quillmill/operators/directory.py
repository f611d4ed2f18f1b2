"""Directory records and answers that are put right by them.

A record is a text of lines: a title, then labels with their values on the same line or
on the ones below.  Answers are repaired field by field from the question, the answer and the record
found for it; all of it is expressions, so that a table of answers needs one join and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.plans.catalogue import register
from quillmill.sources.views import table

#: How a label's line ends and how long it is at most, the labels that hold a contact, and those that may have their value on the same line.
LABEL = r"(?i)(?:country|name|address|phone(?:\s*\d+)?|telephone(?:\s+(?:for\s+orders|office))?|business\s+hours(?:\s+(?:office|product\s+(?:centre|center)))?|fax|toll[ -]?free|mailbox|website|contact|title|email|cell#?|territor(?:y|ies)|region|office|product center)$"
CONTACT = r"(?i)(?:address|phone(?:\s*\d+)?|telephone(?:\s+(?:for\s+orders|office))?|fax(?:\s*\d+)?|toll[ -]?free|mailbox|website|email|cell#?)$"
LONGEST_LABEL = 80
INLINE = r"(?i)^(business\s+hours\s+(?:office|product\s+(?:centre|center))|telephone(?:\s+(?:for\s+orders|office))?|phone(?:\s*\d+)?|office\s*(?:&|and)\s*product\s+center\s+address|address|fax(?:\s*\d+)?|toll[ -]?free|mailbox|website|email|cell#?)\s*[:#-]?\s+(.+)$"
#: What a question asks for, in this order, and the labels that then stay; and the labels that may go.
EVERYTHING = r"(?i)\b(?:all|every|complete)\s+(?:contact|directory)|\bcontact details?\b"
HOURS = r"business\s+hours(?:\s+(?:office|product\s+(?:centre|center)))?"
ASKED = (
    (r"(?i)\b(?:phone|telephone)\b", r"telephone(?!\s+for\s+orders)(?:\s+office)?|phone(?:\s*\d+)?"),
    (r"(?i)\b(?:email|e-mail)\b", r"email|e-mail"),
    (r"(?i)\b(?:website|web site|url)\b", r"website|web site|url"),
    (r"(?i)\b(?:address|located|location)\b", r"(?:office\s*(?:&|and)\s*product\s+center\s+)?address"),
    (r"(?i)\bhours?\b", HOURS),
)
REMOVABLE = rf"telephone\s+for\s+orders|telephone(?:\s+office)?|phone(?:\s*\d+)?|{HOURS}|office\s*(?:&|and)\s*product\s+center\s+address|address|fax|email|website"
ORDER_SIZE = r"(?i)\b(?:minimum|ordering|order)\b.*\b(?:order|size)\b|\border\s+size\b"
ORDER_NOISE = r"(?i)(?:payment\s+methods?\s+accepted|delivery\s+cost|delivery\s+charge|average\s+lead\s+time|business\s+hours?)[^.!?]*(?:[.!?]|$)\s*"


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def plain(text: Column) -> Column:
    """What is compared of a value: its words in lower case."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def fields(content: Column) -> Column:
    """Labels and values of a record in order, as an array of (label, value); a label that comes again has its last value.

    One fold over the lines: an open label gathers the lines below it until the next label or a line that has both.
    """
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s\x{FFFD}]+", " ")))
    lines = F.filter(lines, lambda x: x != "")
    lines = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    none = F.array().cast("array<struct<label:string,value:string>>")
    pair = lambda label, value: F.struct(label.alias("label"), value.alias("value"))

    def closed(s: Column) -> Column:
        return F.when(s["value"] != "", F.array_append(s["found"], pair(s["label"], s["value"]))).otherwise(s["found"])

    def step(s: Column, x: Column) -> Column:
        label = x.rlike(LABEL) & (F.length(x) <= LONGEST_LABEL)
        inline = ~label & x.rlike(INLINE)
        both = pair(F.regexp_replace(F.regexp_extract(x, INLINE, 1), r"\s+", " "), F.trim(F.regexp_extract(x, INLINE, 2)))
        gathered = F.when(s["label"] == "", "").otherwise(F.ltrim(F.concat(s["value"], F.lit(" "), x)))
        found = F.when(inline, F.array_append(closed(s), both)).when(label, closed(s)).otherwise(s["found"])
        return F.struct(F.when(inline, "").when(label, x).otherwise(s["label"]).alias("label"), F.when(inline | label, "").otherwise(gathered).alias("value"), found.alias("found"))

    every = F.aggregate(lines, F.struct(F.lit("").alias("label"), F.lit("").alias("value"), none.alias("found")), step, closed)
    last = lambda name: F.element_at(F.filter(every, lambda f: f["label"] == name), -1)["value"]
    return F.transform(F.array_distinct(F.transform(every, lambda f: f["label"])), lambda name: pair(name, last(name)))


def has(answer: Column, value: Column) -> Column:
    """Does an answer give a value: its words, or its digits where these are seven or more?"""
    digits = lambda x: F.regexp_replace(x, r"[^0-9]", "")
    return (plain(value) != "") & F.contains(plain(answer), plain(value)) | (F.length(digits(value)) >= 7) & F.contains(digits(answer), digits(value))


def _added(answer: Column, missing: Column) -> Column:
    """The answer with missing fields below it, each on a line."""
    lines = F.array_join(F.transform(missing, lambda f: F.concat(f["label"], F.lit(": "), f["value"])), "\n")
    return F.when(F.size(missing) == 0, answer).otherwise(F.concat(answer, F.when(answer == "", "").otherwise("\n\n"), lines))


def with_contacts(answer: Column, known: Column) -> Column:
    """Once an answer gives one contact of the record, the others are added that it lacks."""
    contacts = F.filter(known, lambda f: f["label"].rlike(CONTACT) & (plain(f["value"]) != ""))
    lacking = F.filter(contacts, lambda f: ~has(answer, f["value"]))
    values = F.transform(lacking, lambda f: plain(f["value"]))
    once = F.filter(lacking, lambda f, i: F.array_position(values, plain(f["value"])) == i + 1)
    return F.when(F.exists(contacts, lambda f: has(answer, f["value"])), _added(answer, once)).otherwise(answer)


def with_asked_hours(answer: Column, known: Column, question: Column) -> Column:
    """Hours that were asked for and aren't given."""
    lacking = F.filter(known, lambda f: f["label"].rlike(rf"(?i)^{HOURS}$") & (f["value"] != "") & ~has(answer, f["value"]))
    return F.when(question.rlike(r"(?i)\bhours?\b"), _added(answer, lacking)).otherwise(answer)


def only_asked(answer: Column, question: Column) -> Column:
    """The answer without labelled lines that the question didn't ask for; a question for all, or for none of the labels, leaves it."""

    def kept(allowed: str) -> Column:
        gone = F.regexp_replace(answer, rf"(?i)(?<!\w)(?!(?:{allowed})\b)(?:{REMOVABLE})\s*:\s*[^\n]*(?:\n|$)", "")
        return stripped(F.regexp_replace(F.regexp_replace(gone, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))

    out = F.when(question.rlike(EVERYTHING), answer)
    for pattern, allowed in ASKED:
        out = out.when(question.rlike(pattern), kept(allowed))
    return out.when(question.rlike(ORDER_SIZE), stripped(F.regexp_replace(answer, ORDER_NOISE, ""))).otherwise(answer)


def with_role(answer: Column, source: Column, role: str = "FBO") -> Column:
    """The first minimum order size is that of a role, where the source says so and the answer left it out."""
    said = source.rlike(rf"(?i)minimum\s+order\s+size\s+{role}\b")
    return F.when(said, F.regexp_replace(answer, rf"(?is)\A(.*?)(?<!{role}\s)(minimum\s+order\s+size)(?=\s+(?:is|for)\b)", rf"$1{role} $2")).otherwise(answer)


def with_order_size(answer: Column, source: Column, question: Column, role: str = "FBO") -> Column:
    """The minimum order that was asked for, as the source has it."""
    value = F.trim(F.regexp_replace(F.regexp_extract(source, rf"(?i)minimum\s+order\s+size\s+{role}\s*[:-]\s*([^.\n]+)", 1), r"\s+", " "))
    lacking = question.rlike(ORDER_SIZE) & (plain(value) != "") & ~has(answer, value)
    said = stripped(answer)
    return F.when(lacking, F.concat(said, F.when(said == "", "").otherwise("\n\n"), F.lit(f"Minimum order size {role}: "), value, F.lit("."))).otherwise(answer)


def without_contradiction(answer: Column, source: Column) -> Column:
    """Amounts of an order size, and a minimum order after sponsorship, as the source has them."""
    size = r"(?is)(\d+(?:[.,]\d+)?\s*CC).*?(?:around|approximately)\s*([\d.,]+)\s*([A-Z]{3})\b"
    cc, amount, currency = (F.regexp_extract(source, size, k) for k in (1, 2, 3))
    quoted = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    wrong = F.concat(F.lit(r"(?is)\A(.*?"), quoted(cc), F.lit(r".*?\b(?:around|approximately)\s+)[\d.,]+\s+"), quoted(F.upper(currency)), F.lit(r"\b"))
    fixed = F.when(cc != "", F.regexp_replace(answer, wrong, F.concat(F.lit("$1"), amount, F.lit(" "), F.upper(currency)))).otherwise(answer)
    free = source.rlike(r"(?i)after\s+sponsorship\s*[:-]?\s*(?:we\s+)?(?:do\s+not|don't)\s+have\s+a\s+minimum\s+order")
    return F.when(free, F.regexp_replace(fixed, r"(?is)\A(.*?)after\s+sponsorship\s*[:-]?\s*[^.\n]+(?:\.|$)", "$1After sponsorship: there is no minimum order.")).otherwise(fixed)


def repaired(rows: DataFrame) -> DataFrame:
    """``rows`` (``question``, ``answer``, ``record``) with ``known`` fields and the ``repaired`` answer; nulls are empty texts."""
    q, r = F.coalesce("question", F.lit("")), F.coalesce("record", F.lit(""))
    out = rows.withColumn("known", fields(r)).withColumn("repaired", stripped(F.col("answer")))
    known, a = F.col("known"), F.col("repaired")
    for step in (
        lambda: with_contacts(a, known), lambda: with_asked_hours(a, known, q), lambda: with_role(a, r), lambda: with_order_size(a, r, q),
        lambda: without_contradiction(a, r), lambda: only_asked(a, q),
    ):
        out = out.withColumn("repaired", step())
    return out


def supplier_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory record for each supplier, from its name, nation and number."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    number = F.col("s_suppkey").cast("string")
    lines = F.concat_ws("\n", "s_name", F.lit("Country"), "n_name", F.concat(F.lit("Telephone Office +"), number, F.lit("-555-"), number), F.lit("Email"), F.concat(F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", "")), F.lit("@example.org")),
                        F.lit("Business Hours Office"), F.concat(F.lit("Monday to Friday"), F.lit("\n8 to "), F.pmod("s_suppkey", F.lit(9)).cast("string"), F.lit(" pm")))
    return s.select("s_suppkey", "s_name", "n_name", "s_acctbal", lines.alias("record"))


@register(
    "directory_answers",
    """WITH s AS (SELECT s_suppkey, s_name, n_name, s_acctbal, '+' || s_suppkey || '-555-' || s_suppkey AS phone, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) || '@example.org' AS email, 'Monday to Friday 8 to ' || (s_suppkey % 9) || ' pm' AS hours FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, 4 AS fields, CASE WHEN s_acctbal < 2000 THEN 'Telephone Office: ' || phone WHEN s_acctbal < 5000 THEN 'We are open.' || chr(10) || chr(10) || 'Business Hours Office: ' || hours
  ELSE 'Call ' || phone || '.' || chr(10) || chr(10) || 'Email: ' || email END AS repaired FROM s""",
)
def directory_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about suppliers, repaired by their records: what wasn't asked for goes, what was is added, and contacts are completed."""
    r = supplier_records(spark, sf_dir)
    phone = F.regexp_extract("record", r"(\+\S+)", 1)
    case = lambda few, some, rest: F.when(F.col("s_acctbal") < 2000, few).when(F.col("s_acctbal") < 5000, some).otherwise(rest)
    question = case("What is the phone number?", "When are the office hours?", "How can I reach them?")
    answer = case(F.concat(F.lit("Telephone Office: "), phone, F.lit("\nFax: none\nEmail: info@example.org")), F.lit("We are open."), F.concat(F.lit("Call "), phone, F.lit(".")))
    out = repaired(r.withColumn("question", question).withColumn("answer", answer))
    return out.select("s_suppkey", F.size("known").alias("fields"), "repaired")


#: A record begins with its title, above a line that names its kind and one with its country.
RECORD_START = r"(?m)(?=^[^\n]+\n(?:Operating )?Country\n[^\n]+$)"


def records(text: Column) -> Column:
    """The records of a directory's text, in order: ``kind`` (office or staff), ``title``, ``country``, ``content`` and ``record_id``.

    Numbers in ids count each kind by itself; e-mail addresses that a line end broke are put together first.
    """
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"([\w.+-]+@[\w.-]+)\n([A-Za-z0-9-]{1,20}\.[A-Za-z]{2,})", "$1$2")
    whole = F.regexp_replace(whole, r"([\w.+-]+)\n(@[\w.-]+\.[A-Za-z]{2,})", "$1$2")
    found = F.filter(F.split(whole, RECORD_START), lambda x: x.rlike(r"^[^\n]+\n(?:Operating )?Country\n[^\n]+"))
    line = lambda x, k: F.trim(F.regexp_replace(F.get(F.split(x, "\n"), F.lit(k)), r"\s+", " "))
    kind = lambda x: F.when(line(x, 1) == "Country", "office").otherwise("staff")

    def record(x: Column, i: Column) -> Column:
        number = F.size(F.filter(F.slice(found, F.lit(1), i + 1), lambda y: kind(y) == kind(x)))
        name = F.substring(F.regexp_replace(F.regexp_replace(F.lower(line(x, 0)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)
        return F.struct(kind(x).alias("kind"), line(x, 0).alias("title"), line(x, 2).alias("country"), stripped(x).alias("content"), F.concat_ws("-", kind(x), F.lpad(number.cast("string"), 3, "0"), name).alias("record_id"))

    return F.transform(found, record)
