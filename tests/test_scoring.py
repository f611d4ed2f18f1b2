"""Scores made where the documents are read."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from quillmill.operators import scoring as S


def test_best_keeps_the_highest_keys_and_the_least_ids():
    rng = np.random.default_rng(1)
    rows = [(int(q), int(d), int(s)) for d in range(500) for q, s in zip(range(3), rng.integers(0, 9, 3), strict=True)]
    best = S.Best(3, 7)
    for at in range(0, len(rows), 31):
        best.offer(*(np.array(x) for x in zip(*rows[at : at + 31], strict=True)))
    want = sorted(r for q in range(3) for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))[:7])
    assert sorted(zip(*(v.tolist() for v in best.kept), strict=True)) == want


def test_the_longest_beginning_stands_for_the_others():
    asked = ["ab", "abc", "b", "abd"]
    found = S.Beginnings(asked)
    means = found.means(4, {w: [i] for i, w in enumerate(asked)})
    for word in ["abcde", "abx", "a", "", "b", "abd"]:
        i = found.numbers([word])[0]
        assert [w for w, m in zip(asked, means[i] if i >= 0 else np.zeros(4), strict=True) if m] == [w for w in asked if word.startswith(w)]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Few documents: repeated ids (one text alike), copies, a null text and one without terms."""
    path, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    texts = [(1, "alpha beta gamma alpha"), (1, "beta gamma delta beta"), (2, "alphabet gamma. Alpha beta"), (3, None), (4, "a b"), *((k, "gamma Delta alpha") for k in range(5, 40)), (40, "Beta alpha gamma delta " * 50)]
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, 'en', 'web', length(?))", [(i, t, t) for i, t in texts])
    con.execute("create table benchmark as select * from (values (1::bigint, 'alpha beta, alpha gamma'), (2, 'delt gam'), (3, ''), (4, 'unheard'), (5, 'de alpha beta')) x(item_id, text)")
    for t in ("documents", "benchmark"):
        con.execute(f"copy {t} to '{path}/{t}.parquet' (format parquet)")
    return str(path), con


@pytest.mark.parametrize("name", ["bm25_search", "tfidf_search", "prefix_rank_search"])
def test_repeated_ids_and_odd_texts(spark, odd, name):
    got = entry.queries()[name](spark, odd[0])
    want = odd[1].execute(entry.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) >= 20


@pytest.mark.parametrize("name", ["bm25_search", "tfidf_search", "prefix_rank_search", "cover_density_search"])
def test_no_pair_of_question_and_document_is_shuffled_before_the_best_are_chosen(spark, small, name):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan


@pytest.mark.parametrize("name", ["vector_topk", "semantic_cache_hits"])
def test_no_pair_of_vectors_is_stored_or_ordered_before_the_best_are_chosen(spark, small, name):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan


def test_vectors_by_small_blocks_and_odd_ones(spark, tmp_path, monkeypatch):
    """Copies, opposite and zero vectors, other lengths and a null label; many blocks and parts."""
    from quillmill.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2), monkeypatch.setattr(retrieval, "PART", 5)
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label integer)")
    rng = np.random.default_rng(3)
    rows = [(i, [0.0] * 4 if i == 7 else [1.0, 2.0, 0.0, 1.0] if i % 9 == 0 else rng.normal(size=4).round(3).tolist(), None if i == 11 else i % 3) for i in range(90)]
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    con.execute(f"copy embeddings to '{tmp_path}/embeddings.parquet' (format parquet)")
    con.execute("delete from embeddings where vec_id = 7")  # SQL has no cosine of a zero vector
    for name in ("vector_topk", "semantic_cache_hits"):
        got = entry.queries()[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=repr)


def test_words_stand_for_those_within_the_allowed_edits():
    con = duckdb.connect()
    rng = np.random.default_rng(5)
    words = list({"".join(rng.choice(list("abc"), n)) for n in rng.integers(1, 14, 250).tolist()})
    found = S.Expanded(words[:60], 7)
    for w in words:
        want = con.execute("select i, damerau_levenshtein(a, ?) d from (select unnest(range(len(x))) i, unnest(x) a from (select ?::varchar[] x)) where d <= case when length(a) <= 2 then 0 when length(a) <= 5 then 1 else 2 end", [w, words[:60]]).fetchall()
        assert sorted(found[w]) == sorted(want)


def test_expansions_and_postings_are_not_shuffled(spark, small):
    plan = entry.queries()["multi_field_search"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "HashAggregate" not in plan


def near_words(rng, letters, n, most):
    """Words, and for each some that are a few edits off (swaps with a letter in between, too)."""
    words = ["".join(rng.choice(list(letters), k)) for k in rng.integers(1, most, n).tolist()]
    for w in list(words):
        for _ in range(3):
            x = list(w)
            for _ in range(rng.integers(0, 3)):
                i, c = int(rng.integers(len(x) + 1)), str(rng.choice(list(letters)))
                x[i : i + 2] = [[c, *x[i : i + 2]], x[i + 1 : i + 2], [c, *x[i + 1 : i + 2]], x[i : i + 2][::-1], [*x[i + 1 : i + 2], c, *x[i : i + 1]]][int(rng.integers(5))]
            words.append("".join(x) or "a")
    return list(dict.fromkeys(words))


@pytest.mark.parametrize(("letters", "most"), [("ab", 9), ("abcdé", 14), ("ab", S.LETTERS + 9)])
def test_edits_of_many_pairs_are_those_of_each(letters, most):
    words = near_words(np.random.default_rng(7), letters, 120, most)
    pairs = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if abs(len(a) - len(b)) <= 2][:60_000]
    got = S.edits_within_two(words, words, *np.array(pairs).T)
    assert got.tolist() == [S.edits_within(words[i], words[j], 2) for i, j in pairs]


def test_words_are_looked_up_together_and_not_pair_by_pair(monkeypatch):
    words = near_words(np.random.default_rng(8), "abcdé", 300, 13)
    con = duckdb.connect()
    con.execute("create table w as select unnest(range(len(x))) i, translate(unnest(x), 'é', '!') a from (select ?::varchar[] x)", [words])
    want = con.execute("select w.a, a.i, damerau_levenshtein(a.a, w.a) d from w, (select * from w where i < 60) a where d <= case when length(a.a) <= 2 then 0 when length(a.a) <= 5 then 1 else 2 end").fetchall()
    monkeypatch.setattr(S, "edits_within", lambda *_: pytest.fail("one pair at a time")), monkeypatch.setattr(S, "REMEMBERED", 100)
    found, again, got = S.Expanded(words[:60], 10), S.Expanded(words[:60], 10), []
    for at in range(0, len(words), 40):
        if found.full():
            found.forget()
        some = words[at : at + 40]
        found.numbers([*some, *(w for w in words[:5] if w not in some)])  # some are met again when they are older, or forgotten
        got += [(w.replace("é", "!"), i, n) for w in some for i, n in found[w]]
        assert [found[w] for w in words[:5]] == [again[w] for w in words[:5]] and len(found.number) <= 145
    assert sorted(got) == sorted(want)


def test_documents_with_one_id_count_once_for_a_term_and_length(spark, odd):
    got = entry.queries()["multi_field_search"](spark, odd[0])
    want = odd[1].execute(entry.oracle_sql()["multi_field_search"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) >= 20


def test_counts_of_terms_do_not_depend_on_what_a_task_remembers(spark, odd, monkeypatch):
    from quillmill.operators import search

    class Steps(list):
        """Keeps what a DataFrame's tasks would run."""

        sparkSession = spark

        def mapInArrow(self, run, _):
            self.append(run)
            return self

        groupBy = agg = repartition = lambda self, *_: self

    asked = "alpha beta gama delt alphabet de".split()
    texts = [(i, [["web " + str(i), "", " ".join(x)]]) for i, x in enumerate([["alpha", "beta"], ["gamma", "delta"], ["alpha", "alphabet", "alpha"], []])]
    batches = [pa.record_batch([pa.array([i]), pa.array([rows])], ["doc_id", "rows"]) for i, rows in texts]
    every = []
    for remembered in (0, 1000):
        monkeypatch.setattr(search, "REMEMBERED", remembered)
        steps = search.asked_counts(Steps(), S.Expanded(asked, 10))
        sums: dict = {}
        for row in (r for b in steps[0](iter(batches)) for r in b.to_pylist()):
            sums[row["term"]] = [a + b for a, b in zip(sums.get(row["term"], [0] * 4), list(row.values())[1:], strict=True)]
        every.append(sums)
    assert every[0] == every[1]
    assert every[0]["alpha"] == [0, 0, 2, 2] and every[0][None] == [4, 0, 3, 4] and every[0][""] == [8, 0, 7, 15]


@pytest.mark.parametrize("given", [0, 3, 1000])
def test_results_do_not_depend_on_the_words_that_tasks_are_given(spark, odd, monkeypatch, given):
    from quillmill.operators import search

    monkeypatch.setattr(search, "GIVEN", given)
    got = entry.queries()["multi_field_search"](spark, odd[0])
    assert sorted(map(tuple, got.collect())) == sorted(odd[1].execute(entry.oracle_sql()["multi_field_search"]).fetchall())
    words = ["alpha", "unlike", "gamma"]
    table = S.Given("x", pa.array(words), np.array([2, 0, 1]), np.array([0, 1, 2]), np.array([0, 2, 1]))
    found = S.Expanded(["alpha", "alphabe", "gama"], 10, table)
    monkeypatch.setattr(S.Expanded, "found", lambda *_: pytest.fail("looked up"))
    found.numbers(words[::-1])
    assert [found[w] for w in words] == [[(0, 0), (1, 2)], [], [(2, 1)]]
    assert found.near[found.first[found.number["gamma"]]] == 1 - 1 / 4


def test_the_most_frequent_terms_keep_their_pairs():
    from quillmill.operators import search

    terms, df, n, pairs = search.most_frequent(2, list("abcd"), np.array([5, 1, 9, 5]), np.array([1, 2, 0, 3]), np.arange(6))
    assert (terms, df.tolist(), n.tolist(), pairs.tolist()) == (["a", "c"], [5, 9], [1, 0], [0])
