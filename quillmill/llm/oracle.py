"""DuckDB SQL of the operators that SQL can express, from the same rule tables."""

from __future__ import annotations

from quillmill.llm import lexical_search, license_scan, quality_rules, secret_scan


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def quality_sql() -> str:
    stops = ", ".join(_text(x) for x in dict.fromkeys(quality_rules.STOP_WORDS))
    tests = []
    for measure, least, most in quality_rules.RULES:
        if least is not None:
            tests.append(f"{measure} >= {least}")
        if most is not None:
            tests.append(f"{measure} <= {most}")
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END"
    return rf"""WITH w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d),
v AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) >= 5) x),
p AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM v) x WHERE c > 1),
r AS (SELECT doc_id, CAST(sum(least(5, step)) AS BIGINT) AS n FROM (SELECT doc_id, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5) AS step FROM p) x GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines,
  len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop, len(list_filter(w, lambda x: lower(x) <> upper(x))) AS n_letter,
  len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*] '))) AS n_bullet, len(list_filter(l, lambda x: regexp_matches(x, '\.\.\. *$'))) AS n_ellipsis FROM w LEFT JOIN r USING (doc_id)),
s AS (SELECT *, {share('word_chars', 'n_words')} AS mean_word_chars, {share('n_symbols', 'n_words')} AS symbols_per_word, {share('n_stop', 'n_words')} AS stop_word_share, {share('n_letter', 'n_words')} AS letter_word_share,
  {share('n_bullet', 'n_lines')} AS bullet_line_share, {share('n_ellipsis', 'n_lines')} AS ellipsis_line_share, {share('n_dup_lines', 'n_lines')} AS dup_line_share, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept FROM s"""


def secrets_sql() -> str:
    """Places as the operator finds them: gaps and matches of a split text add up."""
    parts = []
    for kind, rule in enumerate(secret_scan.RULES):
        p = _text(rule.pattern)
        parts.append(f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, {p})) + 1), lambda i: {{
    'start': CAST(list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:i-1], lambda x: length(x))), 0) AS BIGINT), 'kind': {kind},
    'stop': CAST(list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda x: length(x))) + list_sum(list_transform(regexp_extract_all(t, {p})[1:i], lambda x: length(x))) AS BIGINT),
    'size': length(regexp_extract_all(t, {p}, {rule.group})[i])}}), lambda x: x.size >= {rule.least})""")
    every = parts[0]
    for part in parts[1:]:
        every = f"list_concat({every}, {part})"
    names = "[" + ", ".join(_text(r.kind) for r in secret_scan.RULES) + "]"
    named = lambda which: f"array_to_string(list_transform({which}, lambda x: {names}[x.kind + 1] || ':' || CAST(x.start AS VARCHAR) || ':' || CAST(x.stop AS VARCHAR)), ',')"
    counts = ", ".join(f"len(list_filter(s, lambda x: x.kind = {k})) AS n_{secret_scan.RULES[k].kind}" for k in range(secret_scan.BASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, list_sort({every}) AS s FROM d)
SELECT doc_id, {counts}, sha256({named(f'list_filter(s, lambda x: x.kind < {secret_scan.BASE})')}) AS base_sha256, {named('s')} AS spans FROM f"""


def licences_sql() -> str:
    by_id: dict[str, list[str]] = {}
    for s, k in license_scan.sentence_table().items():
        by_id.setdefault(k, []).append(s)
    cases = " ".join(f"WHEN s IN ({', '.join(_text(s) for s in group)}) THEN {_text(k)}" for k, group in by_id.items())
    steps, last = [], "s0"
    for k, (sequence, name) in enumerate(license_scan.rule_list(), 1):
        p = _text(license_scan.rule_pattern(sequence))
        steps.append(f"s{k} AS (SELECT doc_id, ids, regexp_replace(rest, {p}, ' ', 'g') AS rest, CASE WHEN regexp_matches(rest, {p}) THEN list_append(found, {_text(name)}) ELSE found END AS found FROM {last})")
        last = f"s{k}"
    whole, one = "chr(10) || lower(t) || chr(10)", "parts[i]"
    for pattern, to in license_scan.WHOLE:
        whole = f"regexp_replace({whole}, {_text(pattern)}, {_text(to)}, 'g')"
    for pattern, to in license_scan.ONE:
        one = f"regexp_replace({one}, {_text(pattern)}, {_text(to)}, 'g')"
    needed = "|".join(license_scan.NEEDED)
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, i, CASE {cases} END AS id FROM (SELECT doc_id, i, {one} AS s FROM (
  SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split({whole}, chr(12)) AS parts FROM d WHERE regexp_matches(lower(t), '{needed}')) a) b) c),
k AS (SELECT doc_id, list(id ORDER BY i) AS ids FROM n WHERE id IS NOT NULL GROUP BY doc_id),
s0 AS (SELECT d.doc_id, coalesce(ids, []) AS ids, ' ' || array_to_string(coalesce(ids, []), '  ') || ' ' AS rest, CAST([] AS VARCHAR[]) AS found FROM d LEFT JOIN k USING (doc_id)),
{', '.join(steps)}
SELECT doc_id, len(ids) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_sort(list_distinct(found)), ',') AS licences FROM {last}"""


def search_sql() -> str:
    found = lambda table, key: rf"SELECT {key}, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_text(lexical_search.TERM)}) AS t FROM {table}"
    return f"""WITH d AS (SELECT * FROM ({found('documents', 'doc_id')}) x WHERE len(t) > 0), c AS (SELECT count(*) AS n_docs, CAST(coalesce(sum(len(t)), 0) AS BIGINT) AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest(t) AS term FROM ({found('benchmark', 'item_id')}) x),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) x WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) x WHERE rank <= 50"""


ORACLE_SQL = {"op11_lexical_search": search_sql(), "op2_quality_rules": quality_sql(), "op7_secret_scan": secrets_sql(), "op10_license_scan": licences_sql()}
