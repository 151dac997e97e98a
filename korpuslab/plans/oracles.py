"""DuckDB SQL that checks the named queries, written apart from them."""

from __future__ import annotations

_NORM = r"trim(regexp_replace(lower(translate({t}, '’‘–—‐' || chr(160) || 'Iİ', '''''--- ıi')), '\s+', ' ', 'g'))"
_WER = r"trim(regexp_replace(regexp_replace({n}, '[,;:!?()\[\]{{}}\"“”…]+', ' ', 'g'), '\s+', ' ', 'g'))"


def norm(t: str) -> str:
    return _NORM.format(t=t)


def wer(t: str) -> str:
    return _WER.format(n=norm(t))


def toks(w: str) -> str:
    return f"CASE WHEN {w} = '' THEN []::varchar[] ELSE string_split({w}, ' ') END"


def derived(t: str, k: str) -> str:
    return f"flatten(list_transform({t}, lambda x, i: CASE WHEN (i - 1 + {k}) % 11 = 0 THEN []::varchar[] WHEN (i - 1 + {k}) % 13 = 0 THEN ['zzz'] WHEN (i - 1 + {k}) % 17 = 0 THEN [x, x] ELSE [x] END))"


def distance(a: str, b: str) -> str:
    """Edit distance of two lists with few distinct values: each value as one ASCII character."""
    code = lambda x: f"array_to_string(list_transform({x}, lambda v: chr((33 + list_position(list_distinct(list_concat({a}, {b})), v))::int)), '')"
    return f"levenshtein({code(a)}, {code(b)})"


#: Edit distance of token lists r and h, row by row.
_WORD_DISTANCE = """(list_reduce(list_prepend(range(0, len(h) + 1), list_transform(range(1, len(r) + 1), lambda i: [i::bigint])), lambda prev, t:
  list_reduce(list_prepend([t[1]], list_transform(range(1, len(h) + 1), lambda j: [j::bigint])), lambda cur, k:
    list_append(cur, least(prev[k[1]] + (CASE WHEN r[t[1]] = h[k[1]] THEN 0 ELSE 1 END), prev[k[1] + 1] + 1, cur[k[1]] + 1)))))[len(h) + 1]"""

_PAIRS = f"""
n AS (SELECT conv_id, turn, role, {wer('text')} AS w FROM conversations),
r AS (SELECT conv_id, turn, role, {toks('w')} AS r FROM n),
h AS (SELECT *, {derived('r', '(conv_id + turn)')} AS h FROM r),
s AS (SELECT *, string_split(array_to_string(r, ' '), '') AS rc, string_split(array_to_string(h, ' '), '') AS hc FROM h),
pairs AS (SELECT conv_id, turn, role, r, h, len(r) AS words, length(array_to_string(r, ' ')) AS chars, {_WORD_DISTANCE} AS edits, {distance('rc', 'hc')} AS char_edits FROM s),
rated AS (SELECT *, CASE WHEN words > 0 THEN edits / words WHEN edits > 0 THEN 1.0 ELSE 0.0 END AS wer, CASE WHEN chars > 0 THEN char_edits / chars WHEN char_edits > 0 THEN 1.0 ELSE 0.0 END AS cer FROM pairs)
"""

_ITEMS = f"""
n AS (SELECT item_id, text, {wer('text')} AS w FROM benchmark),
items AS (SELECT item_id, text, {toks('w')} AS r FROM n),
pairs AS (SELECT *, {derived('r', 'item_id')} AS h, {derived('r', '(item_id + 5)')} AS o FROM items),
triples AS (SELECT item_id, text AS reference, array_to_string(h, ' ') AS before, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN array_to_string(h, ' ') ELSE array_to_string(o, ' ') END AS after FROM pairs)
"""

_CLIPS = "clips AS (SELECT source AS client_id, 'clips/' || doc_id || '.a.wav' AS path, lang AS locale, (doc_id % 3)::varchar AS split FROM documents)"
_CELL = "{{'d': {d}::bigint, 'p': {p}::bigint, 'i': {i}::bigint, 'x': {x}::bigint, 's': {s}::bigint}}"


def cell(d: str, p: int, i: str, x: str, s: str) -> str:
    return _CELL.format(d=d, p=p, i=i, x=x, s=s)


_LEDGER = """
e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'claimed' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'skipped' END AS e, floor(epoch(ts)) AS t FROM events),
l AS (SELECT user_id, list({'status': '', 'n': 0, 'a': t::double, 'z': NULL::double, 'e': e} ORDER BY ts, event_id) AS l FROM e GROUP BY user_id),
f AS (SELECT user_id, list_reduce(list_prepend({'status': 'none', 'n': 0, 'a': NULL::double, 'z': NULL::double, 'e': ''}, l), lambda s, x:
  CASE WHEN s.status = 'none' AND x.e = 'created' THEN {'status': 'pending', 'n': s.n, 'a': s.a, 'z': s.z, 'e': ''}
       WHEN s.status = 'pending' AND x.e = 'claimed' THEN {'status': 'running', 'n': s.n, 'a': x.a, 'z': NULL::double, 'e': ''}
       WHEN s.status = 'running' AND x.e = 'succeeded' THEN {'status': 'succeeded', 'n': s.n, 'a': s.a, 'z': x.a, 'e': ''}
       WHEN s.status = 'running' AND x.e = 'failed' THEN {'status': 'failed', 'n': s.n + 1, 'a': s.a, 'z': x.a, 'e': ''}
       WHEN s.status = 'running' AND x.e = 'skipped' THEN {'status': 'skipped', 'n': s.n, 'a': s.a, 'z': x.a, 'e': ''}
       ELSE s END) AS s FROM l),
state AS (SELECT user_id, s.status AS status, s.n AS retry_count, s.a AS started_at, s.z AS finished_at FROM f WHERE s.status <> 'none')
"""

_REGISTRY = """
registry AS (SELECT c_custkey AS place, CASE WHEN c_custkey % 50 = 0 THEN 'raw-' ELSE 'spk-' END || CASE WHEN c_custkey % 31 = 0 THEN c_custkey - 1 ELSE c_custkey END AS speaker_id,
  CASE WHEN c_custkey % 4 = 0 THEN 'withdrawn' WHEN c_custkey % 41 = 0 THEN 'unknown' ELSE 'active' END AS consent_status, CASE WHEN c_custkey % 37 = 0 THEN '' ELSE c_mktsegment END AS usage_scope FROM customer)
"""

_POISSON = "CASE " + " ".join(f"WHEN u < {t!r} THEN {k}" for k, t in enumerate([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253])) + " ELSE 8 END"

#: Jobs after events that leave them pending or running, in the order of event ids.
_OPEN = """
l AS (SELECT user_id, list({'s': event_type, 'a': floor(epoch(ts))::double, 'j': event_id} ORDER BY event_id) AS l FROM events GROUP BY user_id),
f AS (SELECT user_id, list_reduce(list_prepend({'s': 'none', 'a': NULL::double, 'j': NULL::bigint}, l), lambda s, x:
  CASE WHEN s.s = 'none' AND x.s = 'signup' THEN {'s': 'pending', 'a': s.a, 'j': x.j} WHEN s.s = 'pending' AND x.s = 'view' THEN {'s': 'running', 'a': x.a, 'j': s.j}
       WHEN s.s = 'running' AND x.s = 'purchase' THEN {'s': 'pending', 'a': s.a, 'j': s.j} WHEN s.s = 'running' AND x.s = 'click' THEN {'s': 'pending', 'a': NULL::double, 'j': s.j} ELSE s END) AS s FROM l)
"""



def _endings(close: str, end: str, plural: bool = True) -> str:
    """What may follow a noun's stem as one regular expression: plural, possessive, case and copula, each as it sounds there."""
    a, vowel, d = ("a" if close in "ıu" else "e"), end == "vowel", ("t" if end == "hard" else "d")
    flat = "ı" if a == "a" else "i"
    said = lambda i, v, t="d": f"(?:{t}{i}r|{'y' if v else ''}{t}{i})?"
    y, n = ("y", "n") if vowel else ("", "")
    cases = f"{y}{close}{said(close, True)}|{y}{a}{said(flat, True)}|{d}{a}{said(flat, True)}|{d}{a}n{said(flat, False)}|{n}{close}n{said(close, False)}|{y}l{a}{said(flat, True)}|{'ç' if end == 'hard' else 'c'}{a}{said(flat, True)}"
    after_third = f"n{close}{said(close, True)}|n{a}{said(flat, True)}|nd{a}{said(flat, True)}|nd{a}n{said(flat, False)}|n{close}n{said(close, False)}|yl{a}{said(flat, True)}|nc{a}{said(flat, True)}"
    i = "" if vowel else close
    soft = f"{close}{said(close, True)}|{a}{said(flat, True)}|d{a}{said(flat, True)}|d{a}n{said(flat, False)}|{close}n{said(close, False)}|l{a}{said(flat, True)}|c{a}{said(flat, True)}"
    owned = f"{i}(?:m|n|m{close}z|n{close}z)(?:{soft}|d{close}r|d{close})?|{'s' if vowel else ''}{close}(?:{after_third}|d{close}r|yd{close})?"
    alone = f"{owned}|{cases}|{said(close, vowel, d)[:-1]}"
    return f"{alone}|l{a}r(?:{_endings(flat, 'soft', False)})?" if plural else alone


_ENDINGS = " ".join(f"WHEN '{c}{e}' THEN '{_endings(c, e)}'" for c in "ıuiü" for e in ("vowel", "hard", "soft")) + " " + " ".join(f"WHEN '{e}' THEN '{'|'.join(_endings(c, e) for c in 'ıuiü')}'" for e in ("vowel", "hard", "soft"))


def _plain(t: str) -> str:
    """Letters beyond ASCII as signs, as distances count bytes."""
    return f"translate({t}, 'çğıöşüâîû', '123456789')"


def _sound(t: str) -> str:
    letters = f"regexp_replace(translate({t}, 'çğıöşüwvyqxbdgzj', 'cgiosuvfikkptksc'), '[^a-z0-9]', '', 'g')"
    bones = f"string_split({letters}[1:1] || regexp_replace({letters}[2:], '[aeiou]', '', 'g'), '')"
    return f"array_to_string(list_filter({bones}, lambda x, i: i = 1 OR ({bones})[i - 1] <> x), '')"


_INFLECTED = f"""
WITH f AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part), forms AS (SELECT upper(w) AS canonical_term, {wer('w')} AS form FROM f),
r AS (SELECT p_partkey AS k, unnest(string_split(lower(p_name), ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i FROM part),
b AS (SELECT *, regexp_extract(w, '([aıoueiöü])[^aıoueiöü]*$', 1) IN ('a', 'ı', 'o', 'u') AS back FROM r),
x AS (SELECT k * 10 + i AS key, (CASE WHEN k % 7 = 0 THEN w[1:2] || 'x' || w[3:] ELSE w END) || CASE (k + i) % 3 WHEN 0 THEN CASE WHEN back THEN 'lardan' ELSE 'lerden' END WHEN 1 THEN CASE WHEN back THEN 'ların' ELSE 'lerin' END ELSE '' END AS text FROM b),
n AS (SELECT key, unnest(string_split({wer('text')}, ' ')) AS token FROM x), d AS (SELECT DISTINCT token FROM n WHERE token <> ''),
c AS (SELECT token, token[1:n] AS stem, token[n + 1:] AS suffix FROM (SELECT token, unnest(range(3, length(token))) AS n FROM d)),
g AS (SELECT *, translate(regexp_extract(stem, '([aıoueiöüâîû])[^aıoueiöüâîû]*$', 1), 'aıoueiöüâîû', 'ııuuiiüüıiu') || CASE WHEN regexp_matches(stem, '[aıoueiöüâîû]$') THEN 'vowel' WHEN regexp_matches(stem, '[fstkçşhpqx]$') THEN 'hard' ELSE 'soft' END AS kind FROM c),
parts AS (SELECT token, token AS stem, '' AS suffix FROM d UNION SELECT token, stem, suffix FROM g WHERE regexp_full_match(suffix, CASE kind {_ENDINGS} END)),
s AS (SELECT DISTINCT stem FROM parts), sk AS (SELECT stem, {_sound('stem')} AS sound FROM s), fk AS (SELECT *, {_sound('form')} AS sound FROM forms),
met AS (
  SELECT stem, canonical_term, form, 0 AS how, 0 AS distance FROM s JOIN forms ON stem = form
  UNION ALL SELECT stem, canonical_term, form, 1, 1 FROM s, forms WHERE length(stem) >= 3 AND length(form) >= 3 AND levenshtein({_plain('stem')}, {_plain('form')}) = 1
  UNION ALL SELECT stem, canonical_term, form, 2, levenshtein({_plain('stem')}, {_plain('form')}) FROM sk JOIN fk USING (sound) WHERE stem <> form AND length(sound) >= 3
), ranked AS (SELECT *, rank() OVER (PARTITION BY token ORDER BY how, distance, length(suffix)) AS turn FROM parts JOIN met USING (stem)),
best AS (SELECT token, count(DISTINCT canonical_term) AS terms, min(struct_pack(t := canonical_term, f := form, s := stem, x := suffix)) AS b, min(how) AS how, min(distance) AS distance FROM ranked WHERE turn = 1 GROUP BY token)
SELECT key, token, CASE WHEN terms = 1 THEN b.t END AS canonical_term, b.f AS form, b.s AS stem, b.x AS suffix, ['exact', 'near', 'sound'][how + 1] AS how, distance::int AS distance, terms > 1 AS abstained FROM n JOIN best USING (token)
"""

ORACLE_SQL = {
    "inflected_match": _INFLECTED,
    "long_edits": f"""
        WITH n AS (SELECT doc_id, {wer('text')} AS w FROM documents), a AS (SELECT doc_id, regexp_replace(w, '[^\\x00-\\x7F]', '?', 'g') AS w FROM n),
        t AS (SELECT doc_id, {toks('w')} AS t FROM a), f AS (SELECT doc_id, t, {derived('t', 'doc_id')} AS h, list_transform(t, lambda x: x[1:1]) AS r FROM t),
        g AS (SELECT doc_id, t, h, r, list_transform({derived('r', 'doc_id')}, lambda x: CASE WHEN x = 'zzz' THEN chr(1) ELSE x END) AS d FROM f),
        e AS (SELECT doc_id, len(r) AS words, levenshtein(array_to_string(r, ''), array_to_string(d, '')) AS edits, levenshtein(array_to_string(t, ' '), array_to_string(h, ' ')) AS char_edits FROM g)
        SELECT doc_id, words, edits, edits AS script_edits, char_edits FROM e""",
    "lexicon_match": f"""
        WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS f FROM part), forms AS (SELECT DISTINCT upper(f) AS canonical_term, {wer('f')} AS form FROM w), t AS (SELECT p_partkey AS key, string_split({wer("replace(p_name, 'e', 'ee')")}, ' ') AS l FROM part),
        g AS (SELECT key, unnest(l) AS token, generate_subscripts(l, 1)::int - 1 AS place FROM t), b AS (SELECT DISTINCT token, CASE WHEN instr(token, chr(39)) > 0 THEN substr(token, 1, length(token) - instr(reverse(token), chr(39))) ELSE token END AS bare FROM g WHERE token <> ''),
        m AS (SELECT token, canonical_term, levenshtein(bare, form) AS d FROM b, forms WHERE bare <> '' AND form <> '' AND levenshtein(bare, form) <= 1), best AS (SELECT token, min(d) AS d FROM m GROUP BY token),
        v AS (SELECT token, d, count(DISTINCT canonical_term) AS n, min(canonical_term) AS canonical_term FROM m JOIN best USING (token, d) GROUP BY token, d)
        SELECT key, place, token, CASE WHEN n = 1 THEN canonical_term END AS canonical_term, d::int AS distance, n > 1 AS abstained FROM g JOIN v USING (token)""",
    "ledger_retries": """
        WITH e AS (SELECT user_id, ts, event_id, event_type, floor(epoch(ts))::double AS t FROM events),
        l AS (SELECT user_id, list({'s': event_type, 'n': 0, 'r': NULL::varchar, 'a': t} ORDER BY ts, event_id) AS l FROM e GROUP BY user_id),
        f AS (SELECT user_id, list_reduce(list_prepend({'s': 'none', 'n': 0, 'r': NULL::varchar, 'a': NULL::double}, l), lambda s, x:
          CASE WHEN s.s = 'none' AND x.s = 'signup' THEN {'s': 'pending', 'n': s.n, 'r': s.r, 'a': s.a} WHEN s.s = 'pending' AND x.s = 'view' THEN {'s': 'running', 'n': s.n, 'r': s.r, 'a': x.a}
               WHEN s.s = 'running' AND x.s = 'purchase' THEN {'s': 'pending', 'n': s.n + 1, 'r': 'purchase', 'a': s.a} WHEN s.s = 'running' AND x.s = 'error' THEN {'s': 'failed', 'n': s.n + 1, 'r': 'error', 'a': s.a}
               WHEN s.s = 'running' AND x.s = 'click' THEN {'s': 'pending', 'n': s.n, 'r': 'stale recovery', 'a': NULL::double} ELSE s END) AS s FROM l)
        SELECT user_id, s.s AS status, s.n AS retry_count, s.r AS error_reason, s.a AS started_at FROM f WHERE s.s <> 'none'""",
    "ledger_stale": f"WITH {_OPEN}, n AS (SELECT max(floor(epoch(ts))) AS t FROM events) SELECT s.a < n.t - 432000 AS stale, count(*) AS jobs FROM f, n WHERE s.s = 'running' GROUP BY 1",
    "claim_order": f"WITH {_OPEN} SELECT user_id, s.j // 1000 AS batch, s.j AS seq FROM f WHERE s.s = 'pending' ORDER BY s.j LIMIT 25",
    "round_outcomes": "SELECT user_id % 10 AS bucket, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'skipped' END AS event, count(*) AS jobs FROM events WHERE event_type NOT IN ('signup', 'view') GROUP BY ALL",
    "crossed_rates": """
        WITH d AS (SELECT lang, source, n_chars % 11 AS edits, n_chars // 6 AS words FROM documents), r AS (SELECT *, CASE WHEN words > 0 THEN edits / words WHEN edits > 0 THEN 1.0::double ELSE 0.0::double END AS rate FROM d)
        SELECT lang, source, grouping_id(lang, source)::bigint AS "grouping", count(*) AS pairs, sum(edits)::bigint AS edits, sum(words)::bigint AS words, round(avg(rate), 9) AS macro_wer, CASE WHEN sum(words) > 0 THEN sum(edits) / sum(words) WHEN sum(edits) > 0 THEN 1.0::double ELSE 0.0::double END AS micro_wer
        FROM r GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())""",
    "rebalance": """
        WITH o AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality = 1 ORDER BY sha256('11|' || doc_id)) AS turn, count(*) FILTER (quality <> 1) OVER () AS errors FROM labels)
        SELECT doc_id, quality FROM o WHERE quality <> 1 OR turn <= floor(0.4::double / (1 - 0.4::double) * errors)""",
    "sentence_rules": """
        WITH r AS (SELECT o_orderkey AS k, c_mktsegment AS m, CASE WHEN o_orderkey % 12 = 0 THEN 'train' WHEN c_mktsegment < 'D' THEN 'tech_dev' ELSE 'tech_test_frozen' END AS split, CASE WHEN o_orderkey % 30 = 0 THEN 'OTHER' ELSE c_mktsegment END AS family FROM orders JOIN customer ON o_custkey = c_custkey),
        l AS (SELECT family FROM r GROUP BY family HAVING count(DISTINCT split) > 1)
        SELECT '4-unknown-split' AS rule, count(*) AS rows, min(k::varchar) AS first_key FROM r WHERE split = 'train' HAVING count(*) > 0 UNION ALL SELECT '5-family-mismatch', count(*), min(k::varchar) FROM r WHERE family <> m HAVING count(*) > 0
        UNION ALL SELECT '6-family-leak', count(*), min(family) FROM l HAVING count(*) > 0""",
    "request_validation": """
        WITH v AS (SELECT CASE WHEN event_id % 50 = 0 THEN 'protocol_version' WHEN event_id % 40 = 0 THEN 'transcription_run_id' WHEN event_id % 7 = 0 THEN 'engine' WHEN event_id % 11 = 0 THEN 'model_revision' WHEN event_id % 13 = 0 THEN 'audio_path' END AS violation FROM events)
        SELECT violation, count(*) AS requests FROM v WHERE violation IS NOT NULL GROUP BY violation""",
    "claimed_requests": "SELECT o_orderpriority AS engine, count(DISTINCT o_custkey) AS jobs FROM orders WHERE o_orderstatus = 'O' GROUP BY 1",
    "unsafe_speakers": "SELECT c_custkey, c_custkey % 9 = 0 OR c_custkey % 10 = 0 OR c_custkey % 14 = 0 AS unsafe FROM customer",
    "quarantine": """
        SELECT substr(sha256(c_name || '|' || (c_custkey * 1000) || '|sha256:m'), 1, 20) AS token, c_name AS speaker_id, c_custkey * 1000.0::double + 604800 AS quarantine_until, c_custkey * 1000.0::double + 2592000 AS backup_expiry,
          c_custkey % 2 <> 0 AND 1000000 >= c_custkey * 1000 + 604800 AS due FROM customer WHERE c_custkey % 3 = 0""",
    "error_classes": f"""
        WITH {_ITEMS}, z AS (SELECT unnest(list_transform(r, lambda x, i: CASE WHEN (i - 1 + item_id) % 4 = 0 THEN CASE WHEN x SIMILAR TO '.*[0-9].*' THEN 'number' ELSE 'apostrophe' END WHEN (i - 1 + item_id) % 4 = 1 THEN CASE WHEN x SIMILAR TO '.*[0-9].*' THEN 'number' WHEN length(x) >= 4 THEN 'suffix' ELSE 'word' END WHEN (i - 1 + item_id) % 9 = 2 AND x <> '42' THEN 'number' END)) AS error_class FROM items)
        SELECT error_class, count(*) AS times FROM z WHERE error_class IS NOT NULL GROUP BY error_class""",
    "evaluation_rows": f"""
        WITH {_PAIRS} SELECT 'conversations' AS source_dataset, 'stand-in' AS asr_engine, CASE WHEN r = h THEN 'identity' ELSE 'error' END AS pair_type, CASE WHEN wer <= 0 THEN 'identity' WHEN wer <= 0.05 THEN 'up_to_5' WHEN wer <= 0.15 THEN '5_to_15' WHEN wer <= 0.3 THEN '15_to_30' ELSE 'over_30' END AS bucket,
          count(*) AS rows, count(*) AS records, 0::bigint AS speakers FROM rated GROUP BY ALL""",
    "manifest_verify": """
        SELECT CASE WHEN c_custkey % 17 = 0 THEN 'missing' ELSE 'changed' END AS verdict, count(*) AS clips FROM customer WHERE c_custkey % 19 <> 0 AND c_name LIKE '%5' AND (c_custkey % 17 = 0 OR c_custkey % 5 = 0) GROUP BY 1""",
    "text_normalize": f"""
        WITH rows AS (SELECT 'documents' AS origin, doc_id AS id, 0::bigint AS part, text FROM documents UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations)
        SELECT origin, id, part, sha256({norm('text')}) AS normalized_sha256, sha256({wer('text')}) AS wer_sha256 FROM rows""",
    "tokenise_counts": f"WITH n AS (SELECT doc_id, {wer('text')} AS w FROM documents) SELECT doc_id, len({toks('w')}) AS n_tokens FROM n",
    "edit_counts": f"""
        WITH {_ITEMS}, v AS (SELECT item_id, list_reverse(r) AS r, list_reverse(h) AS h FROM pairs), dp AS (
          SELECT item_id, (list_reduce(list_prepend(
            list_transform(range(0, len(h) + 1), lambda j: {cell('j', 2, 'j', '0', '0')}),
            list_transform(range(1, len(r) + 1), lambda i: [{cell('i', 0, '0', '0', '0')}])),
            lambda prev, t: list_reduce(list_prepend(
              [{cell('prev[1].d + 1', 1, 'prev[1].i', 'prev[1].x + 1', 'prev[1].s')}],
              list_transform(range(1, len(h) + 1), lambda j: [{cell('j', 0, '0', '0', '0')}])),
              lambda cur, k: list_append(cur, CASE WHEN r[t[1].d] = h[k[1].d] THEN prev[k[1].d] ELSE least(
                {cell('prev[k[1].d].d + 1', 0, 'prev[k[1].d].i', 'prev[k[1].d].x', 'prev[k[1].d].s + 1')},
                {cell('prev[k[1].d + 1].d + 1', 1, 'prev[k[1].d + 1].i', 'prev[k[1].d + 1].x + 1', 'prev[k[1].d + 1].s')},
                {cell('cur[k[1].d].d + 1', 2, 'cur[k[1].d].i + 1', 'cur[k[1].d].x', 'cur[k[1].d].s')}) END))))[len(h) + 1] AS c FROM v)
        SELECT item_id, c.i AS insertions, c.x AS deletions, c.s AS substitutions FROM dp""",
    "wer_cer_by_role": f"""
        WITH {_PAIRS} SELECT role, count(*) AS pairs, sum(edits)::bigint AS word_edits, sum(words)::bigint AS reference_words, sum(char_edits)::bigint AS char_edits, sum(chars)::bigint AS reference_chars,
          sum(edits) / sum(words) AS wer, sum(char_edits) / sum(chars) AS cer FROM pairs GROUP BY role""",
    "macro_by_turn": f"WITH {_PAIRS} SELECT turn, count(*) AS pairs, round(avg(wer), 9) AS macro_wer, round(avg(cer), 9) AS macro_cer FROM rated GROUP BY turn",
    "wer_buckets": f"""
        WITH {_PAIRS} SELECT role, CASE WHEN wer <= 0 THEN 'identity' WHEN wer <= 0.05 THEN 'up_to_5' WHEN wer <= 0.15 THEN '5_to_15' WHEN wer <= 0.3 THEN '15_to_30' ELSE 'over_30' END AS bucket, count(*) AS pairs FROM rated GROUP BY ALL""",
    "before_after": f"""
        WITH {_ITEMS}, x AS (SELECT item_id, reference, before, after, {wer('reference')} AS r, {wer('before')} AS b, {wer('after')} AS a FROM triples)
        SELECT item_id, CASE WHEN b <> r AND a = r THEN 'improved' WHEN b = r AND a <> r THEN 'damaged' WHEN b = r AND a = r AND (before <> reference OR after <> reference) THEN 'orthographic_only' ELSE 'unchanged' END AS change FROM x""",
    "overcorrection": f"""
        WITH {_ITEMS}, w AS (SELECT item_id, {wer('reference')} AS r, {wer('before')} AS b, {wer('after')} AS a FROM triples),
        l AS (SELECT item_id, {toks('r')} AS r, {toks('b')} AS b, {toks('a')} AS a FROM w), e AS (SELECT item_id % 2 AS half, {distance('r', 'b')} AS eb, {distance('r', 'a')} AS ea FROM l)
        SELECT half, count(*) AS rows, sum(eb)::bigint AS edits_before, sum(ea)::bigint AS edits_after, count(*) FILTER (ea < eb) AS improved, count(*) FILTER (ea = eb) AS unchanged, count(*) FILTER (ea > eb) AS damaged,
          count(*) FILTER (eb = 0) AS correct_before, count(*) FILTER (eb = 0 AND ea > 0) AS overcorrected, coalesce((sum(eb) - sum(ea)) / nullif(sum(eb), 0), 0.0) AS relative_wer_reduction,
          coalesce(count(*) FILTER (eb = 0 AND ea > 0) / nullif(count(*) FILTER (eb = 0), 0), 0.0) AS overcorrection_rate FROM e GROUP BY half""",
    "hallucinated_tokens": f"""
        WITH {_ITEMS}, o AS (SELECT item_id, r, h, list_concat({derived('r', '(item_id + 3)')}, CASE WHEN item_id % 4 = 0 THEN ['ghost'] ELSE []::varchar[] END) AS out FROM pairs)
        SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(out, lambda x: NOT list_contains(r, x) AND NOT list_contains(h, x)))), ' ') AS hallucinated FROM o""",
    "top_substitutions": f"""
        WITH {_ITEMS}, z AS (SELECT unnest(list_filter(list_transform(r, lambda x, i: CASE WHEN (i - 1 + item_id) % 5 = 0 THEN x END), lambda x: x IS NOT NULL AND x <> 'zzz')) AS reference_token FROM items)
        SELECT reference_token, 'zzz' AS hypothesis_token, count(*) AS times FROM z GROUP BY ALL ORDER BY times DESC, reference_token LIMIT 20""",
    "term_mentions": f"""
        WITH m AS (SELECT l_orderkey AS k, p_name, p_type, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
        f AS (SELECT p_brand, k % 7 <> 0 AS found, k % 7 <> 0 AND k % 5 <> 0 AS canonical,
          k % 7 <> 0 AND {wer("CASE WHEN k % 3 = 0 THEN p_type WHEN k % 4 = 0 THEN p_name || 'x' ELSE ' ' || p_name || ',' END")} IN ({wer('p_name')}, {wer('p_type')}) AS surface,
          k % 7 <> 0 AND {wer("CASE WHEN k % 11 = 0 THEN 'other' ELSE p_brand END")} = {wer('p_brand')} AS suffix FROM m)
        SELECT p_brand AS term_family, count(*) AS total, count(*) FILTER (surface) AS surface_correct, count(*) FILTER (canonical) AS canonical_correct, count(*) FILTER (suffix) AS suffix_preserved, count(*) FILTER (NOT canonical) AS identity_damage,
          count(*) FILTER (surface) / count(*) AS surface_accuracy, count(*) FILTER (canonical) / count(*) AS canonical_accuracy, count(*) FILTER (suffix) / count(*) AS suffix_preservation FROM f GROUP BY p_brand""",
    "clip_select": f"""
        WITH {_CLIPS}, c AS (SELECT regexp_extract(path, '([^/]+)\\.[^./]*$', 1) AS clip_id, path, 'spk-' || substr(sha256('v1|' || client_id), 1, 16) AS speaker_id FROM clips WHERE locale = 'de' AND split = '1'),
        o AS (SELECT *, row_number() OVER (ORDER BY sha256('42|' || clip_id), clip_id)::int AS rank FROM c) SELECT rank, clip_id, path, speaker_id FROM o WHERE rank <= 50""",
    "speaker_distribution": "SELECT 'spk-' || substr(sha256('v1|' || source), 1, 16) AS speaker_id, count(*) AS clips FROM documents GROUP BY source",
    "missing_sources": "SELECT lang, count(*) FILTER (doc_id % 4 <> 0) AS missing, count(*) FILTER (doc_id % 8 = 0) AS below_clips, count(*) FILTER (doc_id % 4 = 0) AS present FROM documents GROUP BY lang",
    "clip_stems": """
        WITH n AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages)
        SELECT page_id, CASE WHEN regexp_extract(name, '^(.+)\\.[^.]*$', 1) = '' THEN name ELSE regexp_extract(name, '^(.+)\\.[^.]*$', 1) END AS stem, page_id % 3 = 0 AS escapes FROM n""",
    "split_leakage": "SELECT source AS term_family, count(DISTINCT doc_id % 3) AS splits FROM documents GROUP BY source HAVING count(DISTINCT doc_id % 3) > 1",
    "families_by_split": "SELECT (doc_id % 2)::varchar AS split, string_agg(DISTINCT source, ',' ORDER BY source) AS families FROM documents WHERE doc_id % 2 = 0 OR source < 'src2' GROUP BY 1",
    "group_leakage": "SELECT l_partkey, count(DISTINCT l_linenumber % 2) AS splits, count(*) AS rows FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_linenumber % 2) > 1",
    "lexicon_violations": """
        SELECT '1-unknown-term' AS rule, count(*) AS rows, min(p_partkey) AS first_place FROM part WHERE p_partkey % 9 = 0 HAVING count(*) > 0
        UNION ALL SELECT '2-no-receipt', count(*), min(p_partkey) FROM part WHERE p_size <= 3 HAVING count(*) > 0 UNION ALL SELECT '3-not-frozen', count(*), min(p_partkey) FROM part WHERE p_size % 10 = 0 HAVING count(*) > 0""",
    "family_mismatch": "SELECT p_brand AS family, count(*) AS sentences FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 10 = 0 GROUP BY p_brand",
    "freeze_digest": "WITH h AS (SELECT n_regionkey, sha256(n_nationkey || '|' || n_name) AS h FROM nation) SELECT n_regionkey, sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM h GROUP BY n_regionkey",
    "freeze_changes": """
        WITH o AS (SELECT c_name AS path, 'sha256:' || sha256(c_custkey::varchar) AS old FROM customer WHERE c_custkey % 19 <> 0), n AS (SELECT c_name AS path, 'sha256:' || sha256((c_custkey + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END)::varchar) AS new FROM customer WHERE c_custkey % 17 <> 0)
        SELECT path, old, new FROM o FULL JOIN n USING (path) WHERE old IS DISTINCT FROM new""",
    "qc_read": r"""
        WITH c AS (SELECT *, conv_id + turn AS k FROM conversations), o AS (SELECT *, CASE WHEN k % 5 = 0 THEN '  ' || lower(text) || chr(9) WHEN k % 7 = 0 THEN text || ' extra' ELSE text END AS observed FROM c),
        f AS (SELECT *, k % 2 = 0 AND k % 4 = 0 AND k % 8 <> 0 AS excused, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) = trim(regexp_replace(lower(observed), '\s+', ' ', 'g')) AS same FROM o),
        r AS (SELECT *, array_to_string(list_filter([CASE WHEN k % 13 = 0 THEN 'missing_audio' END, CASE WHEN k % 6 = 0 THEN 'missing_consent' END, CASE WHEN k % 17 = 0 THEN 'clipping' END, CASE WHEN k % 19 = 0 THEN 'corruption' END, CASE WHEN k % 8 = 0 THEN 'artificial_spelling' END, CASE WHEN NOT same AND NOT excused THEN 'content_mismatch' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f)
        SELECT conv_id, turn, CASE WHEN reasons = '' THEN 'passed' ELSE 'failed' END AS status, reasons, excused AS pronunciation_variant FROM r""",
    "qc_spontaneous": """
        WITH c AS (SELECT *, conv_id + turn AS k FROM conversations),
        r AS (SELECT *, array_to_string(list_filter([CASE WHEN k % 7 = 0 THEN 'missing_audio' END, CASE WHEN k % 11 = 0 THEN 'missing_consent' END, CASE WHEN k % 3 = 0 OR k % 5 = 0 OR trim(text) = '' THEN 'missing_manual_reference' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c)
        SELECT conv_id, turn, CASE WHEN reasons = '' THEN 'passed' ELSE 'failed' END AS status, reasons FROM r""",
    "eligibility_violations": f"""
        WITH {_REGISTRY}, t AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY place) AS turn FROM registry), v AS (SELECT place, speaker_id, CASE WHEN NOT starts_with(speaker_id, 'spk-') THEN 'speaker_id is not opaque' WHEN turn > 1 THEN 'speaker_id is repeated'
          WHEN consent_status NOT IN ('active', 'withdrawn') THEN 'consent_status is unknown' WHEN usage_scope = '' THEN 'usage_scope is empty' END AS violation FROM t) SELECT * FROM v WHERE violation IS NOT NULL""",
    "eligibility": f"""
        WITH {_REGISTRY}, w AS (SELECT usage_scope, CASE WHEN speaker_id = 'spk-7' THEN 'withdrawn' ELSE consent_status END AS consent_status FROM registry)
        SELECT usage_scope, consent_status, CASE WHEN consent_status = 'active' THEN 'eligible' ELSE 'ineligible' END AS eligibility, 'private-human-recording' AS provenance, 'pending' AS qc_state, count(*) AS speakers FROM w GROUP BY usage_scope, consent_status""",
    "public_export": """
        SELECT 'Audio_Path' AS column, CASE WHEN page_id % 3 = 0 THEN '/data/' || page_id ELSE 'C:\\data\\' || page_id END AS value FROM pages WHERE page_id % 3 = 0 OR page_id % 4 = 0
        UNION ALL SELECT 'url_path', url FROM pages WHERE url LIKE '/%' OR substr(url, 2, 1) = ':'""",
    "ledger_state": f"WITH {_LEDGER} SELECT user_id, status, retry_count, started_at, finished_at FROM state",
    "ledger_snapshot": f"WITH {_LEDGER} SELECT user_id, status, retry_count, started_at, finished_at FROM state",
    "ledger_summary": f"WITH {_LEDGER} SELECT status, count(*) AS jobs, sum(retry_count)::bigint AS retries FROM state GROUP BY status",
    "ledger_reconcile": f"""
        WITH {_LEDGER} SELECT CASE WHEN status IS NULL THEN 'new' WHEN status = 'succeeded' THEN 'reused' WHEN status IN ('failed', 'skipped') THEN 'left' ELSE 'open' END AS kind, count(*) AS requests FROM customer LEFT JOIN state ON c_custkey = user_id GROUP BY 1""",
    "resource_gate": """
        WITH t AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events),
        c AS (SELECT user_id, count(*) AS clip_count, count(*) FILTER (event_type IN ('purchase', 'view')) AS succeeded, count(*) FILTER (event_type = 'click') AS skipped FROM t WHERE turn <= 25 GROUP BY user_id)
        SELECT user_id, clip_count, succeeded, skipped, clip_count - succeeded - skipped AS failed, succeeded / clip_count AS coverage, CASE WHEN succeeded / clip_count >= 0.98 THEN 'allowed' ELSE 'incomplete_resource' END AS status FROM c""",
    "fake_adapter": """
        WITH r AS (SELECT conv_id || '-' || turn AS u, CASE WHEN conv_id % 9 = 0 THEN 'not_applicable' WHEN conv_id % 5 = 0 THEN 'missing_audio' END AS reason, conv_id FROM conversations)
        SELECT 'tr-1' AS transcription_run_id, u AS utterance_id, 'fake' AS engine, CASE WHEN conv_id % 9 = 0 THEN 'skipped' WHEN reason IS NULL THEN 'succeeded' ELSE 'failed' END AS status,
          CASE WHEN reason IS NULL THEN 'fixture transcript for ' || u END AS transcript, CASE WHEN reason IS NULL THEN 'sha256:' || sha256('fixture transcript for ' || u) END AS output_checksum, reason AS error_reason FROM r""",
    "result_validation": """
        WITH v AS (SELECT CASE WHEN event_id % 50 = 0 THEN 'protocol_version' WHEN event_id % 40 = 0 THEN 'status' WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'transcript' WHEN event_id % 11 = 0 THEN 'output_checksum' END AS violation FROM events)
        SELECT violation, count(*) AS results FROM v WHERE violation IS NOT NULL GROUP BY violation""",
    "audit_sample": """
        WITH j AS (SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)), o AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY sha256('7|' || doc_id), doc_id)::int AS rank FROM j)
        SELECT doc_id, lang, quality, rank FROM o WHERE rank <= 5""",
    "dedup_text": f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {wer('text')}",
    "pair_builder": f"WITH {_PAIRS} SELECT CASE WHEN r = h THEN 'identity' ELSE 'error' END AS pair_type, r = h AS is_identity, count(*) AS pairs FROM pairs GROUP BY ALL",
    "sliced_rates": f"""
        WITH {_PAIRS}, u AS (SELECT 'all' AS slice, '' AS value, edits, words, wer FROM rated UNION ALL SELECT 'role', role, edits, words, wer FROM rated UNION ALL SELECT 'turn', turn::varchar, edits, words, wer FROM rated)
        SELECT slice, value, count(*) AS pairs, sum(edits)::bigint AS edits, sum(words)::bigint AS words, round(avg(wer), 9) AS macro_wer, sum(edits) / sum(words) AS micro_wer FROM u GROUP BY slice, value""",
    "engine_populations": """
        WITH r AS (SELECT user_id AS u, event_type AS e, bool_or(value > 10) AS ok FROM events GROUP BY ALL)
        SELECT a.e AS engine_a, b.e AS engine_b, count(*) AS shared, count(*) FILTER (a.ok AND b.ok) AS both_succeeded FROM r a JOIN r b ON a.u = b.u AND a.e <= b.e GROUP BY ALL""",
    "all_engines": "SELECT user_id FROM events WHERE value > 10 GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)",
    "coverage_verdict": """
        WITH e AS (SELECT event_type, event_id % 60 <> 0 AS ok, event_id % 7 AS x, event_id % 11 + 1 AS n FROM events), s AS (SELECT event_type, count(*) AS total, count(*) FILTER (ok) AS succeeded, sum(CASE WHEN ok THEN x ELSE 0 END)::bigint AS edits, sum(CASE WHEN ok THEN n ELSE 0 END)::bigint AS words,
          sum(CASE WHEN ok THEN x ELSE n END)::bigint AS pessimistic_edits, sum(n)::bigint AS all_words FROM e GROUP BY event_type)
        SELECT *, succeeded / total AS coverage, CASE WHEN succeeded / total >= 0.98 THEN 'EVIDENCE_COMPLETE' ELSE 'EVIDENCE_INCOMPLETE' END AS verdict, edits / words AS wer, pessimistic_edits / all_words AS pessimistic_wer FROM s""",
    "bootstrap": f"""
        WITH r AS (SELECT doc_id, n_chars, replicate::int AS replicate, ('0x' || substr(md5('0|' || replicate || '|' || doc_id), 1, 8))::bigint / 4294967296.0::double AS u FROM documents, range(1, 21) t(replicate)), w AS (SELECT *, {_POISSON} AS w FROM r)
        SELECT replicate, round(sum(w * (doc_id % 3)) / sum(w * n_chars) - sum(w * (doc_id % 5)) / sum(w * n_chars), 12) AS difference FROM w GROUP BY replicate""",
    "decision_matrix": """
        SELECT n_name, CASE WHEN k % 9 = 0 OR k % 7 + 1 < 3 THEN 'EVIDENCE_INCOMPLETE' WHEN NOT (k % 2 <> 0 OR (k * 2 >= 25 AND k >= 10 AND k % 5 >= 2)) THEN 'PROBLEM_NOT_SHOWN' WHEN k % 3 = 0 THEN 'CHEAP_BASELINE_SUFFICIENT'
          WHEN k * 20 >= 200 THEN 'PROMOTE_TO_MODEL_TRAINING' ELSE 'EVIDENCE_INCOMPLETE' END AS decision FROM (SELECT n_name, n_nationkey AS k FROM nation)""",
}
