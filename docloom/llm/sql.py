"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from . import codes, licenses, urlfilter

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 win AS MATERIALIZED (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS span, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS x FROM b WHERE len(w) > 0),
 spans AS (SELECT DISTINCT span FROM win),
 places AS (SELECT doc_id, span, unnest(range(1, len(w) - span + 2)) AS i, w FROM d JOIN spans ON len(w) >= span),
 hit AS MATERIALIZED (SELECT doc_id, i, span, item FROM (SELECT doc_id, i, span, array_to_string(w[i:i + span - 1], ' ') AS x FROM places) JOIN win USING (span, x)),
 n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + span)) AS p FROM hit) GROUP BY doc_id),
 it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP3 = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""


OP12 = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
 h AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l, [CAST('0x' || substr(s, 1 + 8 * i, 8) AS BIGINT) FOR i IN range(4)] AS h FROM t),
 c AS (SELECT *, len(l) AS n, least(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS a, greatest(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS b FROM h),
 p AS (SELECT doc_id, text, n, CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:], '') AS suffix FROM c),
 o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
 sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o"""


def op11() -> str:
    """Every entry compared with every part: two rounds of assignment and update, then the codes."""
    parts, entries, rounds = codes.PARTS, codes.ENTRIES, codes.ROUNDS

    def nearest(book: str) -> str:
        return f"""SELECT vec_id, rn, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.vec_id, x.rn, x.p, b.e,
  CAST(list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS BIGINT) AS d FROM x JOIN {book} b USING (p)) GROUP BY ALL"""

    steps = ""
    for r in range(rounds):
        steps += f""", a{r} AS MATERIALIZED ({nearest(f"b{r}")}),
 m{r} AS (SELECT p, e, i, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, e, unnest(v) AS c, unnest(range(1, len(v) + 1)) AS i FROM x JOIN a{r} USING (rn, p)) GROUP BY ALL),
 u{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM m{r} GROUP BY ALL), b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(u{r}.v, b{r}.v) AS v FROM b{r} LEFT JOIN u{r} USING (p, e))"""
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rn, vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 x AS MATERIALIZED (SELECT rn, vec_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM k, range({parts}) t(p)), b0 AS MATERIALIZED (SELECT p, rn AS e, v FROM x WHERE rn < {entries}){steps},
 f AS MATERIALIZED ({nearest(f"b{rounds}")}), r AS (SELECT rn, k.vec_id, label, string_agg(lpad(printf('%x', e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM k JOIN f USING (rn) GROUP BY ALL),
 w AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS c, unnest(range(1, len(v) + 1)) AS i FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, w"""


def op10() -> str:
    rows = ", ".join(f"({n}, '{label}', '{kind}', {size}, {at}, '{a}', '{b}', '{c}')" for n, label, kind, size, at, a, b, c in licenses.template_rows())
    phrases = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS p, '{label}' AS label FROM d, LATERAL unnest(range(1, len(w) - {n - 2})) t(i) WHERE array_to_string(w[i:i + {n - 1}], ' ') = '{text}'" for text, label in licenses.PHRASES.items() for n in [len(text.split())])
    slack, cover, gram = licenses.SLACK, licenses.COVERAGE, licenses.GRAM
    return f"""WITH g(template, label, kind, size, place, t0, t1, t2) AS (VALUES {rows}), d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
 b AS MATERIALIZED ({phrases}), bn AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
 r AS (SELECT doc_id, i - 1 AS p, w[i] AS t0, w[i + 1] AS t1, w[i + 2] AS t2 FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
 v AS MATERIALIZED (SELECT doc_id, template, label, kind, size, place, p, p - place AS diagonal FROM r JOIN g USING (t0, t1, t2)),
 l AS (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS earlier FROM (SELECT DISTINCT doc_id, template, kind, diagonal FROM v)),
 i AS (SELECT *, sum(CASE WHEN kind = 'body' AND diagonal - earlier <= {slack} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM l),
 u AS (SELECT doc_id, template, label, kind, size, island, p, place, unnest(range(place, place + {gram})) AS word FROM v JOIN i USING (doc_id, template, kind, diagonal)),
 m AS (SELECT doc_id, label, kind, size, CASE WHEN kind = 'body' THEN count(DISTINCT word) / size ELSE count(DISTINCT place) / (size - {gram - 1}) END::DOUBLE AS share, min(p) AS a, max(p) + {gram} AS z FROM u GROUP BY doc_id, template, label, kind, size, island),
 k AS (SELECT *, CASE WHEN kind = 'body' THEN share >= {cover} AND z - a <= size * (2 - {cover}) + {slack} ELSE share = 1 END AS good FROM m),
 s AS (SELECT doc_id, max(share) AS score FROM k GROUP BY doc_id),
 ls AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM k WHERE good UNION SELECT doc_id, label FROM b) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN bn USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN ls USING (doc_id)"""


def op6() -> str:
    """Host and path by text functions, rules longest first, then the shrunk posterior bound level by level."""
    ranked = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ranked) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ranked) + " END"
    double = ", ".join(f"'{s}'" for s in urlfilter.DOUBLE_SUFFIXES)
    tail = lambda n: f"array_to_string(string_split(host, '.')[-{n}:], '.')"
    rho = lambda level, mean: f"(SELECT CASE WHEN sum((n - 1) * {mean} * (1 - {mean})) <> 0 THEN least({urlfilter.MOST_RHO}, greatest({urlfilter.LEAST_RHO}, (sum(n * pow(bad / n - {mean}, 2)) - sum({mean} * (1 - {mean}))) / sum((n - 1) * {mean} * (1 - {mean})))) ELSE {urlfilter.MOST_RHO} END::DOUBLE AS rho FROM {level} WHERE n > 0)"
    return rf"""WITH u AS MATERIALIZED (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
 worst AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
 o AS (SELECT host, bad FROM (SELECT host, TRY_CAST(nullif(regexp_extract(path, '/(\d{{1,18}})(?:[./]|$)', 1), '') AS BIGINT) AS doc FROM u) LEFT JOIN worst ON doc = doc_id),
 h AS MATERIALIZED (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, CASE WHEN {tail(2)} IN ({double}) THEN {tail(3)} ELSE {tail(2)} END AS domain, CASE WHEN {tail(2)} IN ({double}) THEN {tail(2)} ELSE {tail(1)} END AS suffix FROM o GROUP BY host),
 d AS MATERIALIZED (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(bad) AS bad FROM h GROUP BY ALL), s AS MATERIALIZED (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
 w AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) ELSE 0.5 END AS p FROM s),
 s1 AS MATERIALIZED (SELECT s.*, p FROM s, w), rs AS {rho("s1", "p")}, s2 AS (SELECT suffix, (bad + (1 / rho - 1) * p) / (n + 1 / rho - 1) AS sm FROM s1, rs),
 d1 AS MATERIALIZED (SELECT d.*, sm FROM d JOIN s2 USING (suffix)), rd AS {rho("d1", "sm")}, d2 AS (SELECT domain, suffix, (bad + (1 / rho - 1) * sm) / (n + 1 / rho - 1) AS dm FROM d1, rd),
 h1 AS MATERIALIZED (SELECT h.*, dm FROM h JOIN d2 USING (domain, suffix)), rh AS {rho("h1", "dm")},
 h2 AS (SELECT host, n + 1 / rho - 1 AS m, (bad + (1 / rho - 1) * dm) / (n + 1 / rho - 1) AS mean FROM h1, rh)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN mean - {urlfilter.Z} * sqrt(mean * (1 - mean) / (m + 1)) > {urlfilter.MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN h2 USING (host)"""
