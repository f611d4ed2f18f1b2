"""Search over sections with several fields: fuzzy terms, phrases, and ranks by how close the words stand.

A section has an id, a title (its first sentence), its text, and a search text of all
three.  Questions are the rows of ``benchmark``.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators.retrieval import bm25_search
from quillmill.operators.scoring import GIVEN, LOOKED_UP, REMEMBERED, Beginnings, Best, Expanded, Given, best_documents, documents_of, question_blocks, rounded_key, rows_by_id, spread
from quillmill.plans.catalogue import register
from quillmill.sources.views import table

#: What a field's score counts, and a phrase in it.
FIELD_BOOST = {"section_id": 8.0, "section_title": 6.0, "content": 3.0, "search_text": 1.0}
PHRASE_BOOST = {"section_title": 5.0, "content": 2.0}
K1, B = 1.2, 0.75
WORD = r"[\p{L}\p{N}]+"
#: Letters from which the shared deletions are taken; two edits within them leave two words a variant in common.
PREFIX = 7
EDITS = 2
#: The same where words are looked up in the tasks: more letters leave fewer words to compare.
BEGINNING = 10


def analysed(text: Column) -> Column:
    """The words of a text in order, with repeats, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def field_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``field`` and its ``words``; fields without a word have no row.

    The search text is the others with spaces between them, so its words are theirs: a text is taken apart once.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit("-"), F.col("doc_id").cast("string")).alias("section_id"), F.coalesce("text", F.lit("")).alias("content"))
    d = d.withColumn("section_title", F.regexp_extract("content", r"^[^.\n]*", 0))
    alone = [f for f in FIELD_BOOST if f != "search_text"]
    d = d.select("doc_id", *(analysed(F.col(f)).alias(f) for f in alone)).withColumn("search_text", F.concat(*(alone)))
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("words")) for f in FIELD_BOOST)))
    return d.select("doc_id", fields.alias("f")).select("doc_id", "f.field", "f.words").filter(F.size("words") > 0)


def question_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", analysed(F.col("text")).alias("asked"))


def counted_words(words: Column) -> Column:
    """Each different word of an array with its ``places`` (from 0, in order): runs of the sorted places, found inside the row."""
    # a value that a lambda uses for each element is bound as a lambda's own variable first: otherwise it would be made again for each
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("place"))))

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"]))
        return bound(begins, lambda starts: F.transform(starts, lambda b, k: one(s, b, F.coalesce(F.get(starts, k + 1), F.size(s)))))

    def one(s: Column, begin: Column, end: Column) -> Column:
        return F.struct(F.get(s, begin)["term"].alias("term"), F.transform(F.slice(s, begin + 1, end - begin), lambda x: x["place"]).alias("places"))

    none = F.array().cast("array<struct<term:string,places:array<int>>>")
    return F.when(F.size(words) > 0, bound(placed, runs)).otherwise(none)


def placed_postings(words: DataFrame) -> DataFrame:
    """``doc_id``, ``field``, ``length`` (of the field), ``term`` and its ``places``; nothing is shuffled."""
    return words.select("doc_id", "field", F.size("words").alias("length"), F.explode(counted_words(F.col("words"))).alias("p")).select("doc_id", "field", "length", "p.term", "p.places")


def postings(words: DataFrame) -> DataFrame:
    """``doc_id``, ``field``, ``length`` (of the field), ``term`` and ``tf``; a row's words are added up where they were read."""
    return words.select("doc_id", "field", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("doc_id", "field", "length", "term").agg(F.count("*").alias("tf"))


def dictionary(words: DataFrame) -> DataFrame:
    """``term`` and ``dfs``: how many rows of each field hold it, in the order of ``FIELD_BOOST``; counts are added up before the shuffle."""
    each = words.select("field", F.explode(F.array_distinct("words")).alias("term"))
    return each.groupBy("term").agg(F.array(*(F.count_if(F.col("field") == f) for f in FIELD_BOOST)).alias("dfs"))


def allowed_edits(term: Column) -> Column:
    """How many edits a term of this length may have: none up to two letters, one up to five, else two."""
    n = F.length(term)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(EDITS)


def _without_one(word: Column) -> Column:
    places = F.when(F.length(word) > 0, F.sequence(F.lit(1), F.length(word))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def variants(term: Column) -> Column:
    """The first letters of a term, with up to ``EDITS`` of them left out.

    Words within so many insertions, deletions, replacements and swaps of neighbours have
    a variant in common: each edit costs either side one letter at most.  There are 29 at most.
    """
    head = F.substring(term, 1, PREFIX)
    once = _without_one(head)
    return F.array_distinct(F.concat(F.array(head), once, F.flatten(F.transform(once, _without_one))))


def _swapped(word: Column) -> Column:
    """The word with each two neighbours swapped."""
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), F.substring(word, i + 2, F.length(word))))


def edits(a: Column, b: Column, near: Column) -> Column:
    """Edits between two different words of two letters and more where they are two at most (swapped neighbours are one), else null.

    ``near`` is their distance without swaps, up to four (a swap is two edits there).  Swapped forms are made of
    few pairs: a swap and another edit leave each word one letter at most that the other lacks, two swaps none.
    """
    rest = lambda x, y: F.length(F.call_function("translate", x, y, F.lit("")))  # noqa: E731  letters of x that y lacks
    one_more = F.exists(_swapped(a), lambda x: F.levenshtein(x, b, 1) >= 0) | F.exists(_swapped(b), lambda x: F.levenshtein(a, x, 1) >= 0)
    even = F.length(a) == F.length(b)
    return (
        F.when(near.between(0, 1), near)
        .when(near == 2, F.when(even & F.array_contains(_swapped(a), b), 1).otherwise(2))
        .when((near == 3) & (rest(a, b) <= 1) & (rest(b, a) <= 1) & one_more, 2)
        .when((near >= 3) & even & (rest(a, b) == 0) & (rest(b, a) == 0) & F.arrays_overlap(_swapped(a), _swapped(b)), 2)
    )


def expansions(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``asked``, ``term`` and ``distance``: the ``known`` terms that an asked one may stand for, with the further columns of ``known``.

    Terms meet through shared deletions (equal ones through their beginnings, too) and are compared exactly.
    ``known`` is read once: its columns come along, so that no second pass over the texts has to find them again.
    """
    a = asked.select(F.col("term").alias("asked")).distinct()
    may = allowed_edits(F.col("asked"))
    ours = a.select("asked", F.explode(F.when(may > 0, variants(F.col("asked"))).otherwise(F.array(F.col("asked")))).alias("variant"))
    theirs = known.select("*", F.explode(variants(F.col("term"))).alias("variant"))
    a, b = F.col("asked"), F.col("term")
    # the distance is asked for once a pair, with the least threshold that still tells: a swap is two edits there
    near = F.when(a == b, 0).when(may == 1, F.levenshtein(a, b, 2)).when(may == EDITS, F.levenshtein(a, b, 2 * EDITS)).otherwise(-1)
    met = ours.join(theirs, "variant").filter(F.abs(F.length(a) - F.length(b)) <= may).filter(near >= 0)
    met = met.drop("variant").dropDuplicates(["asked", "term"]).withColumn("near", near)
    distance = F.when(F.col("near") == 0, 0).otherwise(edits(a, b, F.col("near")))
    return met.select("asked", *known.columns, distance.alias("distance")).filter(F.col("distance") <= may)


def _idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def _saturated(tf: Column, length: Column, mean: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * length / mean))


def phrase_starts(places: Column, asked_at: Column) -> Column:
    """Where a phrase would begin if each of these ``places`` held the word that it has ``asked_at``."""
    return F.flatten(F.transform(asked_at, lambda a: F.transform(places, lambda p: p - a)))


def phrase_count(starts: Column, words: Column) -> Column:
    """How many of the ``starts`` of a phrase's words have all of its ``words``: none is met twice for one word, so they come as often as that."""
    s = F.sort_array(starts)
    return F.aggregate(F.array(s), F.lit(0), lambda _, x: F.size(F.filter(x, lambda v, i: v == F.get(x, i + words - 1))))


_EXPR = {
    "section_id": "coalesce(source, '') || '-' || CAST(doc_id AS VARCHAR)",
    "section_title": r"regexp_extract(coalesce(text, ''), '^[^.\n]*')",
    "content": "coalesce(text, '')",
}
_EXPR["search_text"] = f"({_EXPR['section_id']}) || ' ' || ({_EXPR['section_title']}) || ' ' || ({_EXPR['content']})"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}')"


_FIELDS = "f AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {_words(e)} AS words FROM documents" for f, e in _EXPR.items()) + ") x WHERE len(words) > 0)"
_CUT = "list_transform(range(1, length({0}) + 1), lambda {1}: substr({0}, 1, {1} - 1) || substr({0}, {1} + 1))"
_VARIANTS = f"list_distinct(list_concat([substr(term, 1, {PREFIX})], {_CUT.format(f'substr(term, 1, {PREFIX})', 'i')}, flatten(list_transform({_CUT.format(f'substr(term, 1, {PREFIX})', 'i')}, lambda y: {_CUT.format('y', 'j')}))))"
#: The SQL compares bytes: letters of two bytes in the given tables become one byte that no word has.
_ONE_BYTE = "translate({}, 'ßäçèéêíñóöü', '!#$%&()*+,-')"
_MAY = "CASE WHEN length(a.term) <= 2 THEN 0 WHEN length(a.term) <= 5 THEN 1 ELSE 2 END"


def _cases(boosts: dict[str, float]) -> str:
    return "CASE field " + " ".join(f"WHEN '{f}' THEN {b}::DOUBLE" for f, b in boosts.items()) + " END"


@register(
    "multi_field_search",
    rf"""WITH {_FIELDS}, n AS (SELECT field, count(*) AS n, avg(len(words)) AS mean FROM f GROUP BY field),
p AS (SELECT doc_id, field, length, term, count(*) AS tf FROM (SELECT doc_id, field, len(words) AS length, unnest(words) AS term FROM f) x GROUP BY ALL),
v AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
a AS (SELECT item_id, {_words("coalesce(text, '')")} AS asked FROM benchmark), q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(asked) AS term FROM a) x GROUP BY ALL),
av AS (SELECT term, unnest({_VARIANTS}) AS variant FROM (SELECT DISTINCT term FROM q WHERE length(term) > 2) x), tv AS (SELECT term, unnest({_VARIANTS}) AS variant FROM (SELECT DISTINCT term FROM v WHERE length(term) > 1) x),
met AS (SELECT DISTINCT a.term AS asked, b.term FROM av a JOIN tv b USING (variant) WHERE abs(length(a.term) - length(b.term)) <= {_MAY} UNION SELECT q.term, v.term FROM q JOIN v USING (term)),
e AS (SELECT a.term AS asked, m.term, damerau_levenshtein({_ONE_BYTE.format('a.term')}, {_ONE_BYTE.format('m.term')}) AS distance FROM met m JOIN (SELECT DISTINCT term FROM q) a ON m.asked = a.term WHERE distance <= {_MAY}),
w AS (SELECT field, asked, term, ln(1 + (n - most + 0.5::DOUBLE) / (most + 0.5::DOUBLE)) * (1 - distance / least(length(asked), length(term))::DOUBLE) AS w, mean
  FROM (SELECT e.asked, e.term, e.distance, v.field, max(v.df) OVER (PARTITION BY v.field, e.asked) AS most FROM e JOIN v USING (term)) x JOIN n USING (field)),
b AS (SELECT item_id, doc_id, field, sum(times * w * tf / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * length / mean))) * {_cases(FIELD_BOOST)} AS s FROM (SELECT item_id, times, w.field, w.term, w, mean FROM q JOIN w ON q.term = w.asked) x JOIN p USING (field, term) GROUP BY item_id, doc_id, field),
best AS (SELECT item_id, doc_id, max(s) AS s FROM b GROUP BY item_id, doc_id),
i AS (SELECT item_id, field, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) AS w, any_value(mean) AS mean FROM q JOIN v USING (term) JOIN n USING (field) GROUP BY item_id, field),
h AS (SELECT item_id, doc_id, field, len(words) AS length, asked, words, CASE WHEN contains(' ' || array_to_string(words, ' ') || ' ', ' ' || array_to_string(asked, ' ') || ' ')
  THEN len(list_filter(range(1, len(words) - len(asked) + 2), lambda k: words[k:k + len(asked) - 1] = asked)) ELSE 0 END AS tf FROM a JOIN f ON len(asked) > 0 AND field IN ({', '.join(f"'{f}'" for f in PHRASE_BOOST)})),
ph AS (SELECT item_id, doc_id, sum({_cases(PHRASE_BOOST)} * w * tf / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * length / mean))) AS s FROM h JOIN i USING (item_id, field) WHERE tf > 0 GROUP BY item_id, doc_id)
SELECT item_id, doc_id, round(score, 4) AS score, phrase, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank
  FROM (SELECT item_id, doc_id, best.s + coalesce(ph.s, 0) AS score, ph.s IS NOT NULL AS phrase FROM best LEFT JOIN ph USING (item_id, doc_id)) x) y WHERE rank <= 20""",
)
def multi_field_search(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The best field of each section counts, with its boost; an unbroken phrase in title or text adds to it.

    Terms stand for others within the allowed edits: such a match counts less by its
    edits over the shorter length, and all that a term stands for share the largest document count.
    Tasks count the documents of the terms that they read, and only these counts are brought together, where each term is looked up.
    The most frequent of those that stand for something are given to the tasks that score documents (``GIVEN`` at most), which look up the others
    themselves; neither expansions nor postings are shuffled.
    """
    content = F.coalesce("text", F.lit(""))
    section_id = F.concat(F.coalesce("source", F.lit("")), F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    row = F.array(spaced_words(section_id), spaced_words(F.regexp_extract(content, r"^[^.\n]*", 0)), spaced_words(content))
    documents = rows_by_id(table(spark, sf_dir, "documents").select("doc_id", row.alias("row")), F.col("row"))

    def block_of(block: dict[int | None, list[str]]) -> DataFrame:
        asked = list(dict.fromkeys(w for x in block.values() for w in x))
        meant = Expanded(asked, BEGINNING)
        found = asked_counts(documents, meant).toArrow()  # the block's words at most, one row more, and those given to the tasks
        counts, total, given = (found.filter(x) for x in (pc.is_valid(found["i"]), pc.and_(pc.is_null(found["i"]), pc.is_null(found["term"])), pc.is_valid(found["term"])))
        most, own = np.zeros((2, len(FIELD_BOOST), len(asked)))
        for x, name in ((most, "most"), (own, "own")):
            x[:, counts["i"].to_numpy()] = np.array(counts[name].combine_chunks().flatten(), float).reshape(-1, len(FIELD_BOOST)).T
        n, words = (np.array((total[c].to_pylist() or [[0] * len(FIELD_BOOST)])[0], float) for c in ("most", "own"))
        pairs = given["pairs"].combine_chunks()
        each = np.array(pairs.flatten(), np.int64)
        table = Given(uuid.uuid4().hex, given["term"].combine_chunks(), np.array(pc.list_value_length(pairs), np.int32), (each // 4).astype(np.int32), (each % 4).astype(np.int8))
        score = field_scores(block, asked, Expanded(asked, BEGINNING, table), most, own, n, words / np.maximum(n, 1))
        return best_documents(documents, k, len(block), list(block), score, {"score": "double", "phrase": "boolean"})

    found = reduce(DataFrame.unionByName, map(block_of, question_blocks(question_words(spark, sf_dir))), spark.createDataFrame([], "item_id long, doc_id long, key long, score double, phrase boolean"))
    order = Window.partitionBy("item_id").orderBy(F.desc("key"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("item_id", "doc_id", F.round("score", 4).alias("score"), "phrase", "rank")


class FieldWords:
    """The words of some documents' fields (``section_id``, ``section_title``, ``content``; the search text has the words of all three): all, or those that ``meant`` knows to stand for something.

    A group is a field of a document; rows of one document whose fields have one length count as one.
    ``doc``, ``field`` and ``length`` have a place for each group; ``group``, ``word`` and ``tf`` for each group and different word of it,
    ``first`` and ``n`` are those of ``Expanded`` for each of the ``words``, as ``to`` and ``near`` are. ``counted`` has the rows of each field, and ``long`` their words.
    """

    def __init__(self, rows: list[list[list[str]]], meant: Expanded | None = None):
        groups: dict[tuple[int, int, int], int] = {}
        texts, sizes, owns, wholes = [], [], [], []
        whole = len(FIELD_BOOST) - 1
        self.counted, self.long = np.zeros((2, len(FIELD_BOOST)), np.int64)
        for i, parts in enumerate(rows):
            for row in parts:
                length = [x.count(" ") + 1 if x else 0 for x in row]
                for f, (x, n) in enumerate(zip([*row, ""], [*length, sum(length)], strict=True)):
                    self.counted[f] += n > 0
                    self.long[f] += n
                    if x:
                        texts.append(x), sizes.append(n)
                        owns.append(groups.setdefault((i, f, n), len(groups)))
                        wholes.append(groups.setdefault((i, whole, sum(length)), len(groups)))
        self.doc, self.field, self.length = np.array(list(groups), np.int64).reshape(-1, 3).T
        places: defaultdict[str, int] = defaultdict()
        places.default_factory = places.__len__
        code = np.fromiter(map(places.__getitem__, chain.from_iterable(map(str.split, texts))), np.int64, sum(sizes))
        self.words = list(places)
        text = np.repeat(np.arange(len(texts)), sizes)
        if meant is not None:
            number = meant.numbers(self.words)
            self.first, self.n, self.to, self.near = meant.first[number], meant.n[number], meant.to, meant.near
            kept = self.n[code] > 0
            text, code = text[kept], code[kept]
        each = np.concatenate([np.array(x, np.int64)[text] for x in (owns, wholes)]) * max(1, len(self.words)) + np.tile(code, 2)
        each, self.tf = np.unique(each, return_counts=True)
        self.group, self.word = np.divmod(each, max(1, len(self.words)))

    def pairs(self, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each asked word that one of the words ``here`` (places in ``word``) may stand for: which of ``here`` it is, and its place in ``to``."""
        w = self.word[here]
        return spread(self.first[w], self.n[w])


def asked_counts(documents: DataFrame, meant: Expanded) -> DataFrame:
    """How many documents of each field hold what an asked word (its number ``i``) stands for, as the ``most`` of one term, and the word itself (``own``).

    A row without ``i`` and ``term`` has the rows of each field, and their words. Rows with a ``term``, the most frequent of those that stand for
    something, have the numbers of asked words four times, and the edits, as ``pairs``.
    """
    fields = range(len(FIELD_BOOST))
    names = [f"n{f}" for f in fields]
    # by number, so that terms are not brought together in few tasks because they take little room
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counts(batches):
        held: defaultdict[str, int] = defaultdict()
        held.default_factory = held.__len__
        dfs, rows_of, words_of = np.zeros(0, np.int64), *np.zeros((2, len(fields)), np.int64)

        def counted() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.string()), *(pa.array(x) for x in dfs.reshape(-1, len(fields)).T)], ["term", *names])

        for _, rows in documents_of(batches):
            x = FieldWords(rows)
            number = np.fromiter(map(held.__getitem__, x.words), np.int64, len(x.words))
            dfs = np.concatenate([dfs, np.zeros(len(held) * len(fields) - len(dfs), np.int64)])
            np.add.at(dfs, number[x.word] * len(fields) + x.field[x.group], 1)
            rows_of, words_of = rows_of + x.counted, words_of + x.long
            if len(held) > REMEMBERED:
                yield counted()
                held.clear()
                dfs = dfs[:0]
        yield counted()
        # no word is empty
        yield pa.record_batch([pa.array([None, ""], pa.string()), *(pa.array(x) for x in zip(rows_of.tolist(), words_of.tolist(), strict=True))], ["term", *names])

    def of_asked(batches):
        most, own, total = *np.zeros((2, len(fields), len(meant.asked)), np.int64), [None, None]
        terms, df, n, pairs = [], *np.zeros((3, 0), np.int64)
        for b in larger(batches, LOOKED_UP):
            words, values = b.column(0).to_pylist(), np.stack([c.to_numpy() for c in b.columns[1:]], axis=1)
            for i in [i for i, w in enumerate(words) if not w]:
                total[words[i] is not None] = values[i].tolist()
                words[i] = ""  # stands for nothing
            found, to, edits_off, _ = meant.found(words)
            row, same = np.repeat(np.arange(len(words)), found), edits_off == 0
            for f in fields:
                np.maximum.at(most[f], to, values[row, f])
                own[f, to[same]] = values[row[same], f]
            held = np.flatnonzero(found)
            terms += [words[i] for i in held.tolist()]
            df, n, pairs = (np.concatenate(x) for x in ((df, values[held].sum(axis=1)), (n, found[held]), (pairs, 4 * to + edits_off)))
            if len(terms) > 2 * (GIVEN // parts + LOOKED_UP):
                terms, df, n, pairs = most_frequent(GIVEN // parts, terms, df, n, pairs)
        terms, df, n, pairs = most_frequent(GIVEN // parts, terms, df, n, pairs)
        for at in range(0, len(terms), LOOKED_UP):
            some, end = n[at : at + LOOKED_UP], int(n[:at].sum())
            yield made([None] * len(some), None, None, terms[at : at + LOOKED_UP], pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(some)], pa.int32()), pa.array(pairs[end : end + int(some.sum())])))
        held = np.flatnonzero(most.any(axis=0))
        yield made(held.tolist(), most.T[held].tolist(), own.T[held].tolist(), None, None)
        if any(total):
            yield made([None], *([x] if x else None for x in total), None, None)

    def made(i: list, most: list | None, own: list | None, term: list | None, pairs: pa.Array | None) -> pa.RecordBatch:
        longs = lambda x: pa.array(x or [None] * len(i), pa.list_(pa.int64()))
        return pa.record_batch([pa.array(i, pa.int64()), longs(most), longs(own), pa.array(term or [None] * len(i), pa.string()), longs(None) if pairs is None else pairs], ["i", "most", "own", "term", "pairs"])

    found = documents.mapInArrow(counts, ", ".join(["term string", *(f"{c} long" for c in names)])).repartition(parts, "term")
    known = found.groupBy("term").agg(*(F.sum(c).alias(c) for c in names))
    each = known.mapInArrow(of_asked, "i long, most array<long>, own array<long>, term string, pairs array<long>")
    highest = (F.array(*(F.max(F.col(c)[f]) for f in fields)).alias(c) for c in ("most", "own"))
    return each.groupBy("i", "term").agg(*highest, F.max("pairs").alias("pairs"))


def larger(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together, of as many ``rows`` at least."""
    some, n = [], 0
    for b in chain(batches, [None]):
        if b is not None:
            some.append(b)
            n += b.num_rows
        if n >= rows or b is None and n:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            some, n = [], 0


def most_frequent(most: int, terms: list[str], df: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The terms of the highest ``df``, ``most`` of them, with their ``n`` pairs."""
    best = np.sort(np.argsort(-df, kind="stable")[:most])
    _, place = spread((np.cumsum(n) - n)[best], n[best])
    return [terms[i] for i in best.tolist()], df[best], n[best], pairs[place]


def field_scores(block: dict, asked: list[str], meant: Expanded, most: np.ndarray, own: np.ndarray, n: np.ndarray, mean: np.ndarray) -> Callable[[np.ndarray, list[list], Best], None]:
    """Scores of documents by fields; ``most`` and ``own`` are the document counts of what an asked word stands for and of itself, ``n`` and ``mean`` the rows and their mean length, all a row for each field."""
    number = {w: i for i, w in enumerate(asked)}
    times = np.zeros((len(asked), len(block)))
    for j, x in enumerate(block.values()):
        for w in x:
            times[number[w], j] += 1
    idf = lambda df: np.log(1 + (n[:, None] - df + 0.5) / (df + 0.5))
    shared, itself = idf(most), idf(own) @ times
    boosts, names = list(FIELD_BOOST.values()), list(FIELD_BOOST)
    text = names.index("content")
    saturated = lambda tf, length, m: tf / (tf + K1 * (1 - B + B * length / m))
    # a text with a phrase has the phrase's rarest word, so only the phrases of such a word are looked for; a title is the beginning of its text
    phrases, rarest = [f" {' '.join(x)} " for x in block.values()], {}
    for j, x in enumerate(block.values()):
        if x:
            rarest.setdefault(min(x, key=lambda w: own[text, number[w]]), []).append(j)

    def add_phrases(x: FieldWords, rows: list[list], out: np.ndarray, seen: np.ndarray) -> None:
        found = np.flatnonzero(np.isin(x.word, [w for w, term in enumerate(x.words) if term in rarest]) & (x.field[x.group] == text))
        asked_for: dict[int, set[int]] = {}
        for i, w in zip(x.doc[x.group[found]].tolist(), x.word[found].tolist(), strict=True):
            asked_for.setdefault(i, set()).update(rarest[x.words[w]])
        for i, js in asked_for.items():
            for parts in rows[i]:
                for at in range(len(parts)):
                    if names[at] in PHRASE_BOOST:
                        padded, length = f" {parts[at]} ", parts[at].count(" ") + 1
                        for j in js:
                            tf, begin = 0, padded.find(phrases[j])
                            while begin >= 0:
                                tf, begin = tf + 1, padded.find(phrases[j], begin + 1)
                            if tf:
                                out[i, j] += PHRASE_BOOST[names[at]] * itself[at, j] * saturated(tf, length, mean[at])
                                seen[i, j] = True

    def score(doc: np.ndarray, rows: list[list], best: Best) -> None:
        if meant.full():
            meant.forget()
        x = FieldWords(rows, meant)
        field = x.field[x.group]
        scores = np.zeros((len(rows), len(block)))
        for f, boost in enumerate(boosts):
            here = np.flatnonzero(field == f)
            if len(here):
                row, place = x.pairs(here)
                a = x.to[place]
                group = x.group[here]
                value = saturated(x.tf[here], x.length[group], mean[f])[row] * x.near[place] * shared[f, a]
                used = np.zeros(len(asked), bool)
                used[a] = True
                column, width = np.cumsum(used) - 1, int(used.sum())
                sums = np.bincount(x.doc[group][row] * width + column[a], value, len(rows) * width).reshape(-1, width)
                scores = np.maximum(scores, boost * (sums @ times[used]))
        extra, seen = np.zeros_like(scores), np.zeros(scores.shape, bool)
        add_phrases(x, rows, extra, seen)
        scores = np.where(scores > 0, scores + extra, 0)
        d, q = np.nonzero(scores)
        best.offer(q, doc[d], rounded_key(scores[d, q], 6), scores[d, q], seen[d, q])

    return score


def question_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id`` and the different words ``asked`` of two letters and more, in order."""
    return question_words(spark, sf_dir).select("item_id", F.filter(F.array_distinct("asked"), lambda w: F.length(w) > 1).alias("asked"))


def spaced_words(text: Column) -> Column:
    """The words of ``analysed`` with spaces between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _by_blocks(spark: SparkSession, sf_dir: str, k: int, score_of: Callable, values: dict[str, str], asked: DataFrame) -> DataFrame:
    """The ``k`` best documents of each question with their ``rank``; ``score_of`` makes a block's scoring of the documents' texts."""
    documents = rows_by_id(table(spark, sf_dir, "documents"), spaced_words(F.col("text")))
    of = lambda block: best_documents(documents, k, len(block), list(block), score_of(block), values)
    schema = ", ".join(["item_id long, doc_id long, key long", *(f"{n} {t}" for n, t in values.items())])
    found = reduce(DataFrame.unionByName, map(of, question_blocks(asked)), spark.createDataFrame([], schema))
    order = Window.partitionBy("item_id").orderBy(F.desc("key"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def prefix_scores(block: dict[int | None, list[str]]) -> Callable[[np.ndarray, list[list[str]], Best], None]:
    """How many of a document's words begin with some word of each question."""
    words: dict[str, list[int]] = {}
    for j, asked in enumerate(block.values()):
        for w in asked:
            words.setdefault(w, []).append(j)
    begins = Beginnings(list(words))
    means = begins.means(len(block), words)

    def score(doc: np.ndarray, rows: list[list[str]], best: Best) -> None:
        matches = np.zeros((len(rows), len(block)))
        for i, texts in enumerate(rows):
            at = begins.numbers([w for x in texts for w in x.split()])
            which, times = np.unique(at[at >= 0], return_counts=True)
            matches[i] = times @ means[which]
        d, q = np.nonzero(matches)
        best.offer(q, doc[d], matches[d, q].astype(np.int64))

    return score


def cover_scores(block: dict[int | None, list[str]], operands: int) -> Callable[[np.ndarray, list[list[str]], Best], None]:
    """Rank, number and least width of the covers of each question's first words.

    A word that is met least is in at most as many covers, each time, as there are words; so most documents are known to be
    under the k-th best by their counts alone, and only the others are swept.
    """
    first = [list(dict.fromkeys(asked))[:operands] for asked in block.values()]
    words: dict[str, list[int]] = {}
    for j, asked in enumerate(first):
        for place, w in enumerate(asked):
            words.setdefault(w, []).append(j * operands + place)
    wanted = np.array([len(x) for x in first])
    idle = np.arange(operands)[None, :] >= wanted[:, None]
    begins = Beginnings(list(words))
    means = begins.means(len(block) * operands, words)

    def swept(pos: np.ndarray, there: np.ndarray) -> tuple[float, int, int]:
        """``pos``: places of the words that match, in order; ``there``: which operands each of them is."""
        n = np.arange(1, len(pos) + 1)
        left = np.maximum.accumulate(np.where(there, n[:, None], 0), axis=0).min(axis=1)
        stop = np.flatnonzero(left > np.r_[0, left[:-1]])
        start = left[stop] - 1
        width = pos[stop] - pos[start]
        return float((0.1 / (1 + width - (stop - start))).sum()), len(stop), int(width.min()) + 1

    def score(doc: np.ndarray, rows: list[list[str]], best: Best) -> None:
        found: list[tuple] = []
        for i, texts in enumerate(rows):
            at = [begins.numbers(x.split()) for x in texts]
            which, times = np.unique(np.concatenate(at), return_counts=True)
            which, times = which[which >= 0], times[which >= 0]
            counts = (times @ means[which]).reshape(len(block), operands)
            least = np.where(idle, np.inf, counts).min(axis=1)
            all_there = (wanted > 0) & (least > 0)
            most = 0.1 * np.minimum(np.where(all_there, least, 0) * wanted, counts.sum(axis=1))
            for j in np.flatnonzero(all_there & (rounded_key(most, 9) + 1 >= best.least)).tolist():
                own = means[:, j * operands : j * operands + wanted[j]] > 0
                pos, there = [], []
                for a in at:
                    p = np.flatnonzero((a >= 0) & own[a].any(axis=1))
                    pos.append(p)
                    there.append(own[a[p]])
                pos, there = np.concatenate(pos), np.concatenate(there)
                if len(at) > 1:  # rows of one document: what stands at one place stands there together
                    pos, same = np.unique(pos, return_inverse=True)
                    there = np.stack([np.bincount(same, t, len(pos)) > 0 for t in there.T], axis=1)
                found.append((j, doc[i], *swept(pos, there)))
            if found and (len(found) > 20_000 or i % 16 == 15 or i == len(rows) - 1):
                q, d, s, n, w = map(np.array, zip(*found, strict=True))
                best.offer(q, d, rounded_key(s, 9), s, n, w)
                found = []

    return score


def covers(entries: Column, operands: Column) -> Column:
    """Minimal covers of an array of (pos, ops) in order: the windows that hold all operands 0 to n-1 and of which no smaller one does.

    One sweep keeps where each operand was met last; a window ends here and begins at the
    least of these, if that has moved on.  Each gives its place (``start``, ``stop``) and how many words in it
    match nothing (``noise``).
    """
    none = F.array().cast("array<struct<start:int,stop:int,noise:int>>")
    start = F.struct(F.array_repeat(F.lit(0), operands).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("left"), none.alias("found"))

    def step(s: Column, e: Column) -> Column:
        n = s["n"] + 1
        last = F.transform(s["last"], lambda x, j: F.when(F.array_contains(e["ops"], j), n).otherwise(x))
        left = F.array_min(last)
        begin = F.element_at(entries, F.greatest(left, F.lit(1)))["pos"]
        cover = F.struct(begin.alias("start"), e["pos"].alias("stop"), (e["pos"] - begin - (n - left)).alias("noise"))
        found = F.when((left > 0) & (left > s["left"]), F.array_append(s["found"], cover)).otherwise(s["found"])
        return F.struct(last.alias("last"), n.alias("n"), left.alias("left"), found.alias("found"))

    return F.aggregate(entries, start, step, lambda s: s["found"])


def density(found: Column, weight: float = 0.1) -> Column:
    """The rank of covers: each counts less by the words in it that match nothing."""
    return F.aggregate(found, F.lit(0.0), lambda s, c: s + weight / (1 + c["noise"]))


_OPERANDS = f"""o AS (SELECT item_id, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'place': i - 1, 'word': w[i]}}), recursive := true) FROM (
  SELECT item_id, list_filter(list_distinct_in_order, lambda x: length(x) > 1) AS w FROM (SELECT item_id, list_filter(asked, lambda x, i: list_position(asked, x) = i) AS list_distinct_in_order
  FROM (SELECT item_id, {_words("coalesce(text, '')")} AS asked FROM benchmark) y) x) z)"""
_TEXTS = f"t AS (SELECT doc_id, {_words(_EXPR['content'])} AS words FROM documents)"


@register(
    "prefix_rank_search",
    f"""WITH {_OPERANDS}, {_TEXTS}, p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM t) x GROUP BY ALL), v AS (SELECT DISTINCT term FROM p),
m AS (SELECT DISTINCT item_id, term FROM o JOIN v ON starts_with(term, word))
SELECT item_id, doc_id, matches, round(0.1::DOUBLE * matches, 4) AS score, rank FROM (SELECT item_id, doc_id, CAST(sum(tf) AS BIGINT) AS matches, row_number() OVER (PARTITION BY item_id ORDER BY sum(tf) DESC, doc_id) AS rank
  FROM m JOIN p USING (term) GROUP BY item_id, doc_id) x WHERE rank <= 20""",
)
def prefix_rank_search(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """Any word's beginning may match: then each matching place is a cover by itself, so that places are counted and not gathered."""
    best = _by_blocks(spark, sf_dir, k, prefix_scores, {}, question_operands(spark, sf_dir))
    return best.select("item_id", "doc_id", F.col("key").alias("matches"), F.round(0.1 * F.col("key"), 4).alias("score"), "rank")


@register(
    "cover_density_search",
    f"""WITH {_OPERANDS}, {_TEXTS}, a AS (SELECT * FROM o WHERE place < 3), n AS (SELECT item_id, count(*) AS n FROM a GROUP BY item_id),
w AS (SELECT doc_id, unnest(words) AS term, unnest(range(1, len(words) + 1)) AS pos FROM t), m AS (SELECT DISTINCT item_id, place, term FROM a JOIN (SELECT DISTINCT term FROM w) v ON starts_with(term, word)),
h AS (SELECT item_id, doc_id, pos, max(pos) FILTER (place = 0) AS p0, max(pos) FILTER (place = 1) AS p1, max(pos) FILTER (place = 2) AS p2 FROM m JOIN w USING (term) GROUP BY ALL),
l AS (SELECT item_id, doc_id, pos, row_number() OVER g AS i, max(p0) OVER g AS l0, max(p1) OVER g AS l1, max(p2) OVER g AS l2 FROM h WINDOW g AS (PARTITION BY item_id, doc_id ORDER BY pos)),
c AS (SELECT *, least(l0, l1, l2) AS s FROM l JOIN n USING (item_id) WHERE (l0 IS NOT NULL)::INT + (l1 IS NOT NULL)::INT + (l2 IS NOT NULL)::INT = n),
f AS (SELECT item_id, doc_id, s, min(pos) AS e, min(i) AS i FROM c GROUP BY item_id, doc_id, s),
r AS (SELECT f.item_id, f.doc_id, count(*) AS covers, min(e - f.s + 1) AS tightest, sum(0.1::DOUBLE / (1 + (e - f.s) - (f.i - l.i))) AS score FROM f JOIN l ON f.item_id = l.item_id AND f.doc_id = l.doc_id AND f.s = l.pos GROUP BY f.item_id, f.doc_id)
SELECT item_id, doc_id, covers, CAST(tightest AS INTEGER) AS tightest, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r) x WHERE rank <= 20""",
)
def cover_density_search(spark: SparkSession, sf_dir: str, k: int = 20, operands: int = 3) -> DataFrame:
    """Sections that hold all of a question's first words (each by its beginning), ranked by how closely they stand."""
    asked = question_operands(spark, sf_dir).select("item_id", F.slice("asked", 1, operands).alias("asked"))
    best = _by_blocks(spark, sf_dir, k, lambda block: cover_scores(block, operands), {"score": "double", "covers": "long", "tightest": "long"}, asked)
    return best.select("item_id", "doc_id", "covers", F.col("tightest").cast("int").alias("tightest"), F.round("score", 6).alias("score"), "rank")


# The score of a section for a question: how it was found, and what both have in common.


def known_words(text: Column) -> Column:
    """Different words of two letters and more, in order."""
    return F.filter(F.array_distinct(analysed(text)), lambda w: F.length(w) > 1)


def section_score(found: Column, question: Column, section_id: Column, title: Column, content: Column, words: Column, phrases: Column) -> Column:
    """``found`` and what the question shares with a section's id, title and text.

    ``words`` and ``phrases`` are the question's, made once a row.  A title, phrase or
    word with a digit that both have is the section's own topic, of which the strongest counts.
    """
    asked, name, text = T.squeezed(F.lower(question)), T.squeezed(F.lower(title)), T.squeezed(F.lower(content))
    head = lambda n: T.squeezed(F.lower(F.substring(content, 1, n)))
    near = T.overlap(T.character_grams(question), T.character_grams(title))
    of_text = F.size(F.array_intersect(words, known_words(F.substring(text, 1, 2000))))
    score = found + F.when((section_id != "") & F.contains(asked, F.lower(section_id)), 0.75).otherwise(0.0)
    score = score + F.when((name != "") & F.contains(asked, name), 0.8).otherwise(0.0) + F.when(near >= 0.68, near * 1.1).otherwise(0.0)
    score = score + F.when(F.size(words) > 0, of_text / F.size(words) * 0.35).otherwise(0.0)

    def best(items: Column, in_title: float, in_text: float) -> Column:
        values = F.transform(items, lambda p: F.when(F.contains(name, p), in_title).when(F.contains(head(1800), p), in_text).otherwise(0.0))
        return F.coalesce(F.array_max(values), F.lit(0.0))

    numbered = F.filter(words, lambda w: (F.length(w) >= 4) & w.rlike("[0-9]"))
    topic = F.greatest(F.when((F.length(name) >= 3) & F.contains(asked, name), 1.6).otherwise(0.0), best(phrases, 1.5, 0.65), best(numbered, 1.8, 0.9))
    each = F.transform(phrases, lambda p: F.when(F.contains(name, p), 0.35).when(F.contains(head(800), p), 0.12).otherwise(0.0))
    return F.round(score + topic + F.aggregate(each, F.lit(0.0), lambda s, x: s + x), 5)


@register("section_ranks")
def section_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts found for each question, by the score of a section; a test holds it against a plain computation over the whole table."""
    found = bm25_search(spark, sf_dir).select("item_id", "doc_id", F.col("score").alias("found"))
    q = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("question"))
    content = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit("-"), F.col("doc_id").cast("string")).alias("section_id"), F.regexp_extract(content, r"^[^.\n]*", 0).alias("title"), content.alias("content"))
    pairs = found.join(q.withColumn("words", known_words(F.col("question"))).withColumn("phrases", T.key_phrases(F.col("words"))), "item_id").join(d, "doc_id")
    names = ("found", "question", "section_id", "title", "content", "words", "phrases")
    scored = pairs.select("item_id", "doc_id", section_score(*map(F.col, names)).alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))
