"""DuckDB SQL for the corpus operators that SQL can express, over the same tables."""

from __future__ import annotations

_SPACE = r"chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM parts
), keyed AS (
  SELECT doc_id, line, pos, {_LOWER.format(f"trim(line, {_SPACE})")} AS k FROM lines
), dead AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT keyed.doc_id, line, pos, holder IS NOT NULL AND holder <> keyed.doc_id AS gone FROM keyed LEFT JOIN dead USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

#: crc32 of UTF-8 bytes: the table of the reflected polynomial, then one step a byte.
OP9 = """
WITH RECURSIVE bits AS (
  SELECT i AS n, i::bigint AS v, 0 AS step FROM range(256) r(i)
  UNION ALL
  SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8
), tab AS (
  SELECT list(v ORDER BY n) AS t FROM bits WHERE step = 8
), hexed AS (
  SELECT doc_id, coalesce(source, chr(0)) AS stratum, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h,
         md5('0|' || coalesce(doc_id::varchar, '')) AS digest FROM documents
), summed AS (
  SELECT doc_id, stratum, digest, n + 8 AS size,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(n), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM hexed, tab
), ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY digest, doc_id, size, text_crc32) - 1) / (2 * count(*) OVER (PARTITION BY stratum))::double AS fraction FROM summed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, stratum, digest, doc_id, size, text_crc32) - 1 AS p, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p * 24 // n)::int AS shard, p - ((p * 24 // n) * n + 23) // 24 AS slot, NULL::int AS grown_shard FROM placed
"""


def _share(level: int, path: list[str]) -> str:
    """CTEs that share the budgets of one level of the tree."""
    here, parent = ", ".join(path[: level + 1]), ", ".join(path[:level])
    by = f"PARTITION BY {parent} " if level else ""
    name = path[level]
    given = f"(SELECT max(total) FROM total) AS given FROM n{level}" if not level else f"s{level - 1}.budget AS given FROM n{level} JOIN s{level - 1} USING ({parent})"
    return f"""
n{level} AS (SELECT {here}, sum(cap) AS cap, max(w_{name}) AS w FROM leaf GROUP BY {here}),
g{level} AS (SELECT n{level}.*, {given}),
r{level} AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre,
   sum(w) OVER a - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w
   FROM g{level} WINDOW o AS ({by}ORDER BY cap::double / w::double, {name}), a AS ({by})),
f{level} AS (SELECT *, cap * left_w <= (given - pre) * w AS is_full FROM r{level}),
e{level} AS (SELECT *, given - coalesce(sum(cap) FILTER (is_full) OVER a, 0) AS rest, coalesce(sum(w) FILTER (NOT is_full) OVER a, 0) AS open FROM f{level} WINDOW a AS ({by})),
p{level} AS (SELECT *, CASE WHEN is_full THEN cap ELSE (rest * w) // CASE WHEN open = 0 THEN 1 ELSE open END END AS part FROM e{level}),
t{level} AS (SELECT *, rest - coalesce(sum(part) FILTER (NOT is_full) OVER ({by}), 0) AS odd, row_number() OVER (PARTITION BY {parent + ", " if level else ""}is_full ORDER BY {name}) AS turn FROM p{level}),
s{level} AS (SELECT {here}, (part + CASE WHEN NOT is_full AND turn <= odd THEN 1 ELSE 0 END)::hugeint AS budget FROM t{level})"""


_PATH = ["domain", "lang", "source"]

OP3 = f"""
WITH light AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) = '' THEN 'other'
         ELSE 'domain' || (regexp_extract(coalesce(source, ''), '([0-9]+)$', 1)::bigint % 3)::varchar END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS tokens
  FROM documents
), leaf AS (
  SELECT domain, lang, source, sum(tokens)::hugeint AS available, sum(tokens)::hugeint * 4 AS cap,
    (CASE domain WHEN 'domain0' THEN 5 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END)::hugeint AS w_domain,
    (CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END)::hugeint AS w_lang, 1::hugeint AS w_source
  FROM light GROUP BY ALL
), total AS (SELECT sum(available) AS total FROM leaf),
{",".join(_share(i, _PATH) for i in range(3))},
plan AS (
  SELECT leaf.domain, leaf.lang, leaf.source, budget, budget // greatest(available, 1) AS epoch, budget % greatest(available, 1) AS rest
  FROM leaf JOIN s2 USING (domain, lang, source)
), run AS (
  SELECT light.*, budget, epoch, rest, md5('17|' || epoch::varchar || '|' || coalesce(doc_id::varchar, '')) AS digest
  FROM light JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, tokens, budget::bigint AS leaf_budget,
  (epoch + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY digest, doc_id, tokens RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END)::int AS copies
FROM run
"""

OP11 = r"""
WITH RECURSIVE orders AS (
  SELECT f AS filter_order FROM unnest(['A', 'B', 'C', 'D', 'E']) u(f)
  UNION ALL
  SELECT filter_order || f FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) u(f) WHERE NOT contains(filter_order, f)
), read AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), judged AS (
  SELECT doc_id, part, list_value(len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
      100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)) AS fails
  FROM read
), marked AS (
  SELECT part, list_transform(fails, lambda x: coalesce(x, false)) AS fails,
    coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM judged LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
), cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM marked GROUP BY ALL
), steps AS (
  SELECT filter_order, step, filter_order[step] AS filter FROM (SELECT filter_order FROM orders WHERE length(filter_order) = 5), range(1, 6) r(step)
), met AS (
  SELECT cells.*, steps.*, fails[strpos('ABCDE', filter)] AS here,
    len(list_filter(range(1, step), lambda i: fails[strpos('ABCDE', filter_order[i])])) > 0 AS gone,
    len(list_filter(fails, lambda x: x)) AS failed FROM cells, steps
), sums AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT here), 0)::bigint AS kept, coalesce(sum(n) FILTER (NOT gone AND here), 0)::bigint AS removed,
    coalesce(sum(n) FILTER (gone AND here), 0)::bigint AS redundant, coalesce(sum(n) FILTER (here AND failed = 1), 0)::bigint AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND here), 0)::bigint AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND here), 0)::bigint AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, step::int AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::bigint AS shapley FROM sums
"""

OP12 = """
WITH read AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::varchar) AS d FROM documents
), drawn AS (
  SELECT *, ('0x' || d[1:8])::bigint AS h1, ('0x' || d[9:16])::bigint AS h2, ('0x' || d[17:24])::bigint AS h3, ('0x' || d[25:32])::bigint AS h4 FROM read
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cut
)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts
"""

#: Bytes as two hex digits each; windows of 50 bytes, their least document, and runs of what later documents lose.
OP13 = """
WITH hexed AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), pieces AS (
  SELECT doc_id, o, substring(h, 2 * o + 1, 2 * 549) AS piece, least(n - 49 - o, 500) AS windows FROM (SELECT doc_id, h, n, unnest(range(0, n - 49, 500)) AS o FROM hexed WHERE n >= 50)
), windows AS (
  SELECT doc_id, o + k AS p, md5_number(substring(piece, 2 * k + 1, 100)) AS w FROM (SELECT doc_id, o, piece, unnest(range(windows)) AS k FROM pieces)
), least AS (
  SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)
), lost AS (
  SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50, true) AS opens FROM windows JOIN least USING (w) WHERE first < doc_id
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(opens::int) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM lost) GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, list(struct_pack(a := a, b := b) ORDER BY a) AS rs FROM runs GROUP BY doc_id
)
SELECT doc_id, n::bigint AS n_bytes, coalesce(gone, 0)::bigint AS n_removed, coalesce(spans, 0)::bigint AS n_spans,
  sha256(unhex(CASE WHEN rs IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(rs) + 1),
    lambda i: h[(CASE WHEN i = 0 THEN 0 ELSE 2 * rs[i].b END) + 1 : (CASE WHEN i = len(rs) THEN 2 * n ELSE 2 * rs[i + 1].a END)]), '') END)) AS kept_sha256
FROM hexed LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL = {"op3_mixing_weights": OP3, "op5_line_dedup": OP5, "op9_sharding": OP9, "op11_filter_audit": OP11, "op12_fill_in_middle": OP12, "op13_suffix_dedup": OP13}
