"""Fuzzy terms, phrases, covers and inverted lists against brute force."""

import collections
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import nearest, search
from quillmill.operators.retrieval import unit_vectors


def neighbours_by_edit(word, letters):
    """All words one insertion, deletion, replacement or swap of neighbours away."""
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters}
        out |= {word[:i] + c + word[i + 1 :] for c in letters} | {word[:i] + word[i + 1 :]}
        if i + 1 < len(word):
            out.add(word[:i] + word[i + 1] + word[i] + word[i + 2 :])
    return out


def test_expansions_are_all_terms_within_the_allowed_edits(spark):
    r = random.Random(4)
    letters = "abcé"
    words = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(500)})
    asked = words[::12]
    want = set()
    for a in asked:
        near, far = {a: 0}, {a}
        for d in range(1, (0 if len(a) <= 2 else 1 if len(a) <= 5 else 2) + 1):
            far = {x for w in far for x in neighbours_by_edit(w, letters)}
            near = {x: d for x in far} | near
        want |= {(a, w, near[w]) for w in words if w in near and (len(w) >= 2 or w == a)}
    make = lambda x: spark.createDataFrame([(w,) for w in x], "term string")
    assert {tuple(x) for x in search.expansions(make(asked), make(words)).collect()} == want


def test_phrases_by_places_equal_a_look_at_every_window(spark):
    r = random.Random(6)
    cases = [([r.choice("abc") for _ in range(r.randint(0, 14))], [r.choice("abc") for _ in range(r.randint(1, 4))]) for _ in range(120)] + [(list("aaaa"), list("aa")), ([], ["a"])]
    want = {n: sum(w[i : i + len(a)] == a for i in range(len(w) - len(a) + 1)) for n, (w, a) in enumerate(cases)}
    df = spark.createDataFrame([(n, w, a) for n, (w, a) in enumerate(cases)], "n int, w array<string>, a array<string>")
    held = df.select("n", "a", F.explode_outer(search.counted_words(F.col("w"))).alias("p")).select("n", "a", "p.term", "p.places")
    at = F.filter(F.transform("a", lambda x, i: F.when(x == F.col("term"), i)), lambda i: i.isNotNull())
    starts = held.withColumn("starts", search.phrase_starts(F.coalesce("places", F.array().cast("array<int>")), at)).groupBy("n").agg(F.flatten(F.collect_list("starts")).alias("s"), F.max(F.size("a")).alias("m"))
    assert {x["n"]: x["c"] for x in starts.select("n", search.phrase_count(F.col("s"), F.col("m")).alias("c")).collect()} == want


def test_counted_words_are_the_places_of_each(spark):
    words = [list("banana"), ["x"], [], ["b", "a", "b"]]
    got = spark.createDataFrame([(n, w) for n, w in enumerate(words)], "n int, w array<string>").select("n", search.counted_words(F.col("w")).alias("c")).collect()
    for row in got:
        w = words[row["n"]]
        assert [(c["term"], c["places"]) for c in row["c"]] == [(t, [i for i, x in enumerate(w) if x == t]) for t in sorted(set(w))]


def test_dictionary_counts_rows_by_field(spark):
    rows = [(1, "content", ["a", "b", "a"]), (1, "section_title", ["a"]), (2, "content", ["a"]), (2, "search_text", ["c"])]
    got = search.dictionary(spark.createDataFrame(rows, "doc_id long, field string, words array<string>")).collect()
    assert {r["term"]: dict(zip(search.FIELD_BOOST, r["dfs"], strict=True)) for r in got} == {
        "a": {"section_id": 0, "section_title": 1, "content": 2, "search_text": 0}, "b": {"section_id": 0, "section_title": 0, "content": 1, "search_text": 0}, "c": {"section_id": 0, "section_title": 0, "content": 0, "search_text": 1}
    }


def test_covers_equal_all_windows_without_a_smaller_one(spark):
    r, rows, want = random.Random(8), [], []
    for n in range(60):
        m = r.randint(1, 3)
        entries = {p: sorted(r.sample(range(m), r.randint(1, m))) for p in sorted(r.sample(range(1, 30), r.randint(1, 15)))}
        whole = [(a, b) for a, b in itertools.combinations_with_replacement(entries, 2) if {o for p, ops in entries.items() if a <= p <= b for o in ops} == set(range(m))]
        least = sorted((a, b) for a, b in whole if not any((c, d) != (a, b) and a <= c and d <= b for c, d in whole))
        want.append([(a, b, b - a + 1 - sum(a <= p <= b for p in entries)) for a, b in least])
        rows.append((n, m, list(entries.items())))
    df = spark.createDataFrame(rows, "n int, m int, e array<struct<pos:int,ops:array<int>>>").orderBy("n")
    got = df.select("n", search.covers(F.col("e"), F.col("m")).alias("c")).orderBy("n").collect()
    assert [[tuple(c) for c in x["c"]] for x in got] == want


def test_probed_lists_have_nine_of_ten_neighbours(spark, small):
    v = unit_vectors(spark, small)
    q = v.filter("vec_id % 20 = 0")
    pairs = lambda df: {(r["query_id"], r["vec_id"]) for r in df.collect()}
    exact = pairs(nearest.neighbours(v, q, exact=True))
    assert len(pairs(nearest.neighbours(v, q)) & exact) >= 0.9 * len(exact)


def test_clusters_need_few_lists_and_bounds_stay_exact(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16))
    rows = [(i, i % 2, (centres[i % 12] + 0.1 * r.normal(size=16)).tolist()) for i in range(600)]
    v = spark.createDataFrame(rows, "vec_id long, label int, v array<double>").repartition(3)
    x = np.array([v for _, _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in range(0, 600, 20):
        s = x @ x[i]
        best = sorted((j for j in range(i % 2, 600, 2) if j != i and s[j] > 0), key=lambda j: (-round(s[j], 9), j))[:10]
        want |= {(i, j) for j in best}
    q = v.filter("vec_id % 20 = 0")
    got = {n: {(r["query_id"], r["vec_id"]) for r in nearest.neighbours(v, q, probe=n, exact=e).collect()} for n, e in ((1, True), (6, False))}
    assert got[1] == want and len(got[6] & want) >= 0.9 * len(want)
    assert nearest.neighbours(v.limit(0), q.limit(0)).count() == 0


def test_same_vector_many_times(spark):
    rows = [(i, 1, [1.0, 0.0, 0.5]) for i in range(300)] + [(999, 1, [0.0, 1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, label int, v array<double>")
    got = nearest.neighbours(v, v.filter("vec_id = 20"), exact=True).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(10)) and collections.Counter(r["score"] for r in got) == {1.0: 10}


def test_blocks_and_parts_keep_few_rows(spark, monkeypatch):
    """Each block of queries and part of vectors leaves at most k rows a query, and the best of all are exact; rows without label or id are no neighbours."""
    monkeypatch.setattr(nearest, "PART", 70)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 4)
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 8))
    rows = [(i, i % 2, x[i].tolist()) for i in range(400)] + [(None, 0, x[0].tolist()), (1000, None, x[0].tolist())]
    v = spark.createDataFrame(rows, "vec_id long, label int, v array<double>")
    q = v.filter("vec_id % 20 = 0")
    centres = nearest.centroids(v.filter("vec_id < 400"))
    lists = nearest.listed(v.filter("vec_id < 400 and label is not null"), centres)
    every = nearest.probes(q.filter("label is not null"), centres, dict.fromkeys(range(len(centres)), 3.2))
    assert nearest._scanned(lists, every, 5).count() <= 20 * 3 * 5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(0, 400, 20) for j in sorted((j for j in range(i % 2, 400, 2) if j != i and x[i] @ x[j] > 0), key=lambda j: -(x[i] @ x[j]))[:5]}
    assert {(n["query_id"], n["vec_id"]) for n in nearest.neighbours(v, q, k=5, probe=2, exact=True).collect()} == want


def score_by_hand(found, question, section_id, title, content):
    words = [w for w in dict.fromkeys(re.findall(r"[^\W_]+", question.lower())) if len(w) > 1]
    phrases = list(dict.fromkeys(" ".join(words[i : i + n]) for n in (4, 3, 2) for i in range(len(words) - n + 1)))[:12]
    squeeze = lambda x: " ".join(x.lower().split())

    def grams(x):
        s = re.sub(r"[\W_]", "", x.lower())
        return {s[i : i + 3] for i in range(max(len(s) - 2, 1))} if s else set()

    asked, name = squeeze(question), squeeze(title)
    g, h = grams(question), grams(title)
    near = len(g & h) / min(len(g), len(h)) if g and h else 0
    text_words = set(re.findall(r"[^\W_]+", squeeze(content)[:2000]))
    score = found + 0.75 * (section_id in asked) + 0.8 * bool(name and name in asked) + (near * 1.1 if near >= 0.68 else 0)
    score += 0.35 * len(set(words) & text_words) / len(words) if words else 0
    topic = [0.0, 1.6 * (len(name) >= 3 and name in asked)]
    early = squeeze(content[:1800])
    topic += [1.5 if p in name else 0.65 if p in early else 0 for p in phrases]
    topic += [1.8 if w in name else 0.9 if w in early else 0 for w in words if len(w) >= 4 and re.search("[0-9]", w)]
    return score + max(topic) + sum(0.35 if p in name else 0.12 if p in squeeze(content[:800]) else 0 for p in phrases)


def test_section_scores_of_the_whole_table(spark, small):
    from quillmill.operators.retrieval import bm25_search
    from quillmill.sources.views import table

    docs = {r["doc_id"]: r for r in table(spark, small, "documents").collect()}
    items = {r["item_id"]: r["text"] for r in table(spark, small, "benchmark").collect()}
    got = {(r["item_id"], r["doc_id"]): r["score"] for r in search.section_ranks(spark, small).collect()}
    found = bm25_search(spark, small).collect()
    assert len(got) == len(found) > 100
    for r in found:
        d = docs[r["doc_id"]]
        want = score_by_hand(r["score"], items[r["item_id"]], f"{d['source']}-{d['doc_id']}", re.match(r"[^.\n]*", d["text"])[0], d["text"])
        assert abs(got[r["item_id"], r["doc_id"]] - want) < 2e-5


def test_section_score_of_a_named_topic(spark):
    rows = [(0.5, "What does plan-7 Harbour Fees say on tariff2024 fees?", "plan-7", "Harbour  Fees", "The tariff2024 lists fees."), (0.0, "", "", "", ""), (1.0, "zz", "a", "Nothing here", "else")]
    df = spark.createDataFrame(rows, "found double, question string, section_id string, title string, content string")
    df = df.withColumn("words", search.known_words(F.col("question"))).withColumn("phrases", T.key_phrases(F.col("words")))
    got = [r[0] for r in df.select(search.section_score(*(F.col(c) for c in df.columns))).collect()]
    assert abs(got[0] - score_by_hand(*rows[0])) < 1e-5 and got[0] > 3 and got[1:] == [0.0, 1.0]
