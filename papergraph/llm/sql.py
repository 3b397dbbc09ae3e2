"""SQL that DuckDB can run, for the operators that SQL can express."""

from __future__ import annotations

from .secrets import ACCESS, ASSIGN, ENDPOINT, HEX, KINDS, NAME, OPAQUE, SCOPE_END

WORD = r"[^\x20\x09-\x0D]+"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(pattern: str, group: int = 0) -> str:
    """All matches of ``t``: a list of {s, e, t, p}."""
    p = _quoted(pattern)
    before = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"""(SELECT list_transform(range(1, len(m) + 1), lambda i: {{'s': ({before})::BIGINT, 'e': ({before} + length(m[i]))::BIGINT, 't': m[i], 'p': q[i]}})
  FROM (SELECT regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS q, string_split_regex(t, {p}) AS g))"""


def _near(parts: str, lo: str, hi: str) -> str:
    return f"len(list_filter({parts}, lambda x: x.e > {lo} AND x.s < {hi})) > 0"


def _linked(weak: str, others: list[str]) -> str:
    block = "len(list_filter(scopes, lambda b: b.e <= w.s))"
    lo = f"greatest(w.s - 200, coalesce(scopes[{block}].e, 0))"
    hi = f"least(w.e + 200, coalesce(scopes[{block} + 1].s, 4611686018427387904))"
    free = " AND ".join(f"NOT {_near(k, 'w.s', 'w.e')}" for k in ("assign", "access", "hex"))
    return f"list_filter({weak}, lambda w: {free} AND ({' OR '.join(_near(o, lo, hi) for o in others)}))"


def _spans(kinds) -> str:
    lists = ", ".join(f"list_transform({k}, lambda x: {{'s': x.s, 'k': {KINDS.index(k)}, 'e': x.e}})" for k in kinds)
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"array_to_string(list_transform(list_sort(flatten([{lists}])), lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"


OP2 = f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {_matches(ASSIGN, 2)} AS assign_all, {_matches(ACCESS)} AS access, {_matches(HEX)} AS hex, {_matches(NAME)} AS name0,
  list_filter({_matches(OPAQUE)}, lambda x: regexp_matches(x.t, '[0-9]') AND regexp_matches(x.t, '[a-z]') AND regexp_matches(x.t, '[A-Z]')) AS opaque0,
  {_matches(ENDPOINT)} AS endpoint0, {_matches(SCOPE_END)} AS scopes FROM a),
p AS (SELECT *, list_filter(assign_all, lambda x: length(x.p) >= 6) AS assign, list_filter(assign_all, lambda x: length(x.p) < 6) AS short0 FROM f),
l AS (SELECT doc_id, assign, access, hex, {_linked("name0", ["assign", "hex", "opaque0", "short0"])} AS name, {_linked("opaque0", ["access", "name0", "endpoint0"])} AS opaque,
  {_linked("short0", ["access", "name0", "endpoint0"])} AS short, {_linked("endpoint0", ["assign", "hex", "opaque0", "short0"])} AS endpoint FROM p)
SELECT doc_id, {", ".join(f"len({k})::BIGINT AS n_{k}" for k in KINDS)}, sha256({_spans(KINDS[:3])}) AS base_sha256, {_spans(KINDS)} AS spans FROM l"""

OP9 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS h, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, t, regexp_extract_all(t, '{WORD}') AS w FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM c, range(3) AS o(k) WHERE c.n > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
f AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM l WHERE regexp_matches(l, '{WORD}') GROUP BY r),
nl AS (SELECT r, len(x) AS words, array_to_string(x, ' ') AS k FROM (SELECT r, regexp_extract_all(unnest(string_split(regexp_replace(lower(t), '[0-9]+', '0', 'g'), chr(10))), '{WORD}') AS x FROM d) WHERE len(x) > 0),
s AS (SELECT h, k, count(DISTINCT r) AS n FROM nl JOIN d USING (r) GROUP BY ALL),
o AS (SELECT s.h, k FROM s JOIN (SELECT h, count(*) AS nd FROM d GROUP BY h) x ON s.h IS NOT DISTINCT FROM x.h WHERE n > 20 AND n > nd * 0.005),
rm AS (SELECT nl.r, sum(words) AS n FROM nl JOIN d USING (r) JOIN o ON o.h IS NOT DISTINCT FROM d.h AND o.k = nl.k GROUP BY nl.r),
e AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(f.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(rm.n, 0)::BIGINT AS n_removed_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN f USING (r) LEFT JOIN rm USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - n_removed_words < 0.3 * n_words) AS kept FROM e"""

OP10 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
x AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
p AS (SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS s FROM x),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.s = b.s AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
c(a, m) AS (SELECT doc_id, doc_id FROM x UNION SELECT l.b, c.m FROM c JOIN l ON l.a = c.a WHERE c.m < l.b),
k AS (SELECT a, min(m) AS m FROM c GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, m AS component_id, doc_id = m AS kept FROM x JOIN k ON k.a = x.doc_id"""

OP11 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*{WORD}|[\x20\x09-\x0D]+') AS u, {", ".join(f"('0x' || substr(x, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))} FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _clusters(k: int = 8, rounds: int = 10) -> str:
    """The rounds written out one after another; vectors as lists, sums as exact integers."""
    least = "(SELECT vec_id, v, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (SELECT r, vec_id, v, c, list_sum(list_transform(range(1, 65), lambda j: (v[j] - w[j]) * (v[j] - w[j]))) AS d FROM v, {c}) GROUP BY r, vec_id, v)"
    steps = [
        "WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS c, v AS w FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds):
        sums = f"SELECT cluster, list(m ORDER BY j) AS w FROM (SELECT cluster, j, (s - ((s % n) + n) % n) // n AS m FROM (SELECT cluster, j, sum(v[j]) AS s, count(*) AS n FROM {least.format(c=f'c{i}')}, range(1, 65) AS x(j) GROUP BY ALL)) GROUP BY cluster"
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(x.w, o.w)::BIGINT[] AS w FROM c{i} o LEFT JOIN ({sums}) x ON x.cluster = o.c)")
    steps.append(f"a AS MATERIALIZED {least.format(c=f'c{rounds}')}")
    return ", ".join(steps) + f""" SELECT vec_id, cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a JOIN c{rounds} ON c = cluster"""


SQL = {"op2_linked_secrets": OP2, "op9_line_frequency": OP9, "op10_minhash_postings": OP10, "op11_fill_in_middle": OP11, "op12_zone_map_clusters": _clusters()}
