"""Ranked search and conversation repair against brute force; language identification by held-out accuracy."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import conversation_repair, language_id, lexical_search
from quillmill.llm.common import documents, prepare
from quillmill.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}

# 11: ranked lexical search


def ranked_by_hand(docs, queries, k=50):
    """All documents scored for all queries."""
    known = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    known = [(i, c, sum(c.values())) for i, c in known if c]
    n_docs, n_terms = len(known), sum(n for _, _, n in known)
    df = collections.Counter(t for _, c, _ in known for t in c)
    asked = collections.defaultdict(set)
    for item, text in queries:
        asked[item] |= set(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c, n in known:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is not None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize(("shard", "part", "block"), [(None, None, None), (300, 900, 3)])
def test_search_equals_brute_force(spark, small, monkeypatch, shard, part, block):
    if shard:
        monkeypatch.setattr(lexical_search, "SHARD", shard)
        monkeypatch.setattr(lexical_search, "PART", part)
        monkeypatch.setattr(lexical_search, "BLOCK", block)
    docs, items = documents(prepare(spark), small), documents(spark, small, "benchmark")
    got = rows_of(lexical_search.ranked(docs.repartition(3), items), "item_id", "rank", "doc_id", "score")
    assert sorted(got, key=repr) == ranked_by_hand(rows_of(docs, "doc_id", "text"), rows_of(items, "item_id", "text"))


def test_search_of_odd_rows(spark):
    """Nulls, ties, repeated ids, terms beyond ASCII, and a query that nothing answers."""
    docs = [(i, "the same words again") for i in range(70)] + [(None, "the same Words"), (None, "lone ÉTUDE étude"), (5, "étude 日本 x1_y"), (5, "étude 日本 x1_y"), (90, None), (91, "..."), (92, "the " * 3000)]
    items = [(1, "same WORDS"), (2, "étude"), (3, "日本, y!"), (4, None), (5, "nowhere"), (6, "the"), (None, "again"), (1, "lone")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(lexical_search.ranked(d, q), "item_id", "rank", "doc_id", "score")
    assert sorted(got, key=repr) == ranked_by_hand(docs, items)


def test_wand_skips_and_keeps_the_best():
    r = random.Random(3)
    for _ in range(200):
        lists, total = [], collections.Counter()
        for _ in range(r.randint(1, 8)):
            at = sorted(r.sample(range(60), r.randint(1, 50)))
            impacts = [r.randint(1, 9) for _ in at]
            total.update(dict(zip(at, impacts, strict=True)))
            lists.append((max(impacts), [*at, 1 << 62], impacts))
        heap = []
        lexical_search.wand(lists, heap, 5, [-i for i in range(60)])
        assert sorted(((s, -t) for s, t in heap), key=lambda x: (-x[0], x[1])) == sorted(((s, d) for d, s in total.items()), key=lambda x: (-x[0], x[1]))[:5]


# 12: language identification


def test_codes_are_apart():
    for k in (2, 3, 4, 7, 8, 20, 60):
        words = language_id.code(k)
        assert words.shape[0] == k and (abs(words.sum(0)) < k).all()
        assert language_id.distance(words) >= max(1, words.shape[1] // 4)


def test_gram_counts_do_not_depend_on_windows(monkeypatch):
    text = "Ärger, über  alles!\n" * 300 + "日本語 fin"
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "WINDOW", 37)
    assert (language_id.gram_counts(text) == whole).all()
    assert whole.sum() == sum(len(b" " + b" ".join(text.lower().encode().translate(language_id._LETTERS).split()) + b" ") - n + 1 for n in language_id.ORDERS)


def test_decoding_corrects_wrong_bits():
    words = language_id.code(4)
    model = language_id.Model(list("abcd"), words, np.zeros((7, 4), np.float32), np.ones(7))
    for k in range(4):
        for flipped in range(7):
            margins = 4.0 * words[k].astype(float)
            margins[flipped] *= -1
            loss, wrong = model.decode(margins[None])
            assert loss[0].argmin() == k and wrong[0][k] == 1


def test_languages_are_found(spark, small):
    docs = documents(prepare(spark), small)
    lang = dict(rows_of(docs, "doc_id", "lang"))
    held = [r for r in QUERIES["op12_language_id"](spark, small).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held) and len(held) > 40
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_held_out_rows_and_labels_are_no_input(spark, small):
    docs = documents(prepare(spark), small)
    other = docs.withColumn("lang", F.expr("if(crc32(cast(doc_id as string)) % 3 = 1, 'xx', lang)"))
    a, b = language_id.fit(docs), language_id.fit(other)
    assert a.languages == b.languages and (a.weights == b.weights).all()


def test_unknown_and_ambiguous_languages(spark):
    rows = [(i, t, g) for i in range(60) for t, g in (("the house of the mind and this", "en"), ("das Haus und der Geist", "de"))]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(1, None), (2, "12 !?"), (3, ""), (None, "the mind of this"), (4, "der Geist"), (5, "the mind of the house das Haus und der Geist"), (6, "q")]
    got = {r["doc_id"]: r for r in language_id.identified(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, None, 4)] == ["und", "und", "und", "en", "de"]
    assert got[1]["score"] == 0 and not got[4]["ambiguous"] and got[1]["ambiguous"] and got[6]["score"] < 0.999
    empty = language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r["lang_pred"] for r in language_id.identified(spark.createDataFrame(asked, "doc_id long, text string"), empty).collect()] == ["und"] * 7


# 13: conversation structure repair

AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = (("u", "user"), ("a", "assistant"))
BLANK = " \t\n\x0b\x0c\r"


def damaged_by_hand(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        kept, role, text = out[conv], " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def cheapest(rows, faults):
    """(cost, letters, messages): the first whole way by cost and letters, of all ways."""
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, letters, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, letters, out
        push = lambda c, x, j, s, m: heapq.heappush(heap, (cost + c, letters + x, j, s, out + m))  # noqa: B023, E731
        for initial, name in NAMES:
            if (state, initial) in AFTER:
                push(5, "I", i, AFTER[state, initial], ((name, ""),))
        if i < len(rows):
            _, role, text = rows[i]
            push(2, "D", i + 1, state, ())
            if faults[i] in ("", "t"):
                more = 5 * (faults[i] == "t")
                if (state, role[:1]) in AFTER:
                    push(more, "K", i + 1, AFTER[state, role[:1]], ((role, text),))
                for initial, name in NAMES:
                    if (state, initial) in AFTER:
                        push(more + 1, "R", i + 1, AFTER[state, initial], ((name, text),))


def audited_by_hand(rows):
    out = []
    for conv, kept in damaged_by_hand(rows).items():
        seen, faults = set(), []
        for _, role, text in kept:
            bare = text.strip(BLANK)
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in kept]
        turns = [r[0] for r in kept if r[0] is not None]
        cost, letters, messages = cheapest(kept, faults)
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in messages).encode()).hexdigest()
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, letters, digest))
    return sorted(out, key=repr)


ROLES = ["user", "assistant", "system", "tool", "", None, "a", "s"]
TEXTS = ["Hi.", "x", "Hello there?\n", "", " ", None, "a! ", "b.", "c. ", "d", "e.", "f."]


def odd_conversations(seed=5):
    """Short and long conversations with all kinds of faults, ties, nulls and repeated rows."""
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(150)]:
        for _ in range(900 if conv == 7 else r.choice([1, 2, 3, 8, 12, 20])):
            turn = r.randint(0, 1500) if conv == 7 else r.choice([None, *range(12)])
            rows.append((conv, turn, r.choice(ROLES) if r.random() < 0.3 else r.choice(ROLES[:2]), r.choice(TEXTS)))
    return rows + rows[:40]


SCHEMA = "conv_id long, turn long, role string, text string"


def audits(df):
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted(rows_of(conversation_repair.audited(conversation_repair.damaged(df)), *names), key=repr)


@pytest.mark.parametrize("segment", [256, 5])
def test_repair_equals_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    rows = odd_conversations()
    assert audits(spark.createDataFrame(rows, SCHEMA).repartition(4)) == audited_by_hand(rows)


def test_repair_query(spark, small):
    rows = rows_of(documents(prepare(spark), small, "conversations"), "conv_id", "turn", "role", "text")
    got = QUERIES["op13_conversation_repair"](spark, small)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == audited_by_hand(rows)


def test_repaired_messages_are_what_the_digest_says(spark):
    rows = odd_conversations(9)
    df = spark.createDataFrame(rows, SCHEMA)
    out = collections.defaultdict(list)
    for conv, place, role, text in sorted(rows_of(conversation_repair.repaired(conversation_repair.damaged(df)), "conv_id", "place", "role", "text"), key=lambda r: (repr(r[0]), r[1])):
        assert place == len(out[conv])
        out[conv].append(f"{role}:{text}")
    for row in audits(df):
        assert hashlib.sha256("\n".join(out[row[0]]).encode()).hexdigest() == row[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(m[:1] for m in out[row[0]]))


def test_layers_are_computed_once_a_prefix(spark, monkeypatch):
    import pyarrow as pa

    calls = []
    real = conversation_repair.advance
    monkeypatch.setattr(conversation_repair, "advance", lambda layer, symbol: calls.append(symbol) or real(layer, symbol))
    signatures = sorted({"u" * i + "a" * j for i in range(6) for j in range(6)})
    list(conversation_repair._solve([pa.record_batch([pa.array(signatures)], ["sig"])]))
    assert len(calls) == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})


def test_conversation_of_which_nothing_is_left(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = audits(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA))
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert audits(spark.createDataFrame([], SCHEMA)) == []
