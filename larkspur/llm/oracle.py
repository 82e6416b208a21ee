"""SQL for the operators that SQL can express on whole tables, written from their contracts."""

from __future__ import annotations

from .secrets import RULES

_BLANK = r"[\x20\x09-\x0D]+"


def _spans(rule) -> str:
    """Spans of a rule's matches: lengths of what stands between matches and of the matches add up to places."""
    p = rule.pattern.replace("'", "''")
    ends = "list_sum([length(x) for x in b[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i-1]]), 0)"
    each = f"list_transform(range(1, len(m) + 1), lambda i: {{'s': ({ends})::BIGINT, 'k': {RULES.index(rule)}, 'e': ({ends} + length(m[i]))::BIGINT, 'n': length(g[i])}})"
    return f"(SELECT list_filter({each}, lambda x: x.n >= {rule.least}) FROM (SELECT regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS b, regexp_extract_all(t, '{p}', {rule.group}) AS g))"


def _found(kind: int, pattern: str, good: str = "true", group: str = "length(x.m)", start: str = "0") -> str:
    """Spans of a pattern's matches x.m (first group x.g) that are good, ``start`` into a match and ``group`` long."""
    p = pattern.replace("'", "''")
    begin = "(list_sum([length(y) for y in b[1:i]]) + coalesce(list_sum([length(y) for y in m[1:i-1]]), 0))::BIGINT"
    each = f"list_transform(range(1, len(m) + 1), lambda i: {{'s': {begin}, 'm': m[i], 'g': g[i]}})"
    rows = f"list_filter({each}, lambda x: {good})"
    return f"(SELECT list_transform({rows}, lambda x: {{'s': x.s + {start}, 'k': {kind}, 'e': x.s + {start} + {group}}}) FROM (SELECT regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS b, regexp_extract_all(t, '{p}', 1) AS g))"


_DIGITS = "regexp_replace(x.m, '[^0-9]', '', 'g')"
_DIGIT = f"(substr({_DIGITS}, length({_DIGITS}) - j::INT, 1)::INT * (1 + j % 2))"
_FLAT = "replace(x.g, ' ', '')"
_CHECKED = f"list_reduce(list_transform(string_split(substr({_FLAT}, 5) || substr({_FLAT}, 1, 4), ''), lambda c: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97)"
_AFTER = {"group": "length(x.g)", "start": "length(x.m) - length(x.g)"}
_PRIVATE = [
    _found(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    _found(1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x.m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0"),
    _found(2, r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length({_DIGITS})), lambda j: {_DIGIT} - CASE WHEN {_DIGIT} > 9 THEN 9 ELSE 0 END)) % 10 = 0"),
    _found(3, r"(\+[0-9][\x20().0-9-]+[0-9])", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    _found(4, r"(?:IBAN|iban|Iban)[ \t\n:=#.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)", f"length({_FLAT}) BETWEEN 15 AND 34 AND {_CHECKED} = 1", **_AFTER),
    _found(5, r"(?:SSN|ssn)[ \t\n:=#.]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})", **_AFTER),
    _found(6, r"://([^\x00-\x20/@:?#]+:[^\x00-\x20/@?#]+)@[A-Za-z0-9-]", group="length(x.g)", start="3"),
]
_PRIVATE_NAME = "['email', 'ip', 'card', 'phone', 'iban', 'ssn', 'login'][x.k + 1] || ':' || x.s || ':' || x.e"

_NAME = f"[{', '.join(repr(r.kind) for r in RULES)}][x.k + 1] || ':' || x.s || ':' || x.e"

SQL = {
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM d WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS win FROM w),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM h) WHERE first < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM later) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(ws) AS n, coalesce(len(ps), 0) AS r, list_filter(ws, lambda w, j: ps IS NULL OR NOT list_contains(ps, j)) AS kept FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n AS n_words, r AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k""",
    "op3_pii": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, {', '.join(f'{x} AS k{i}' for i, x in enumerate(_PRIVATE))} FROM d),
a AS (SELECT *, list_sort({' || '.join(f'k{i}' for i in range(7))}) AS every, list_sort(k0 || k1 || k2 || k3) AS base FROM s)
SELECT doc_id, len(k0) AS n_email, len(k1) AS n_ip, len(k2) AS n_card, len(k3) AS n_phone,
 sha256(coalesce(array_to_string(list_transform(base, lambda x: {_PRIVATE_NAME}), ','), '')) AS base_sha256, coalesce(array_to_string(list_transform(every, lambda x: {_PRIVATE_NAME}), ','), '') AS spans FROM a""",
    "op7_embedding_dedup": """
WITH RECURSIVE every AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings),
v AS (SELECT rid, label, embedding::DOUBLE[] AS e FROM every
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.rid AS u, b.rid AS w FROM v a JOIN v b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(u, w) AS (SELECT u, w FROM l UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
m AS (SELECT r.u, min(vec_id) AS low FROM r JOIN every ON every.rid = r.w GROUP BY r.u),
c AS (SELECT rid, vec_id, least(vec_id, low) AS component_id FROM every LEFT JOIN m ON m.u = every.rid)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.u = c.rid) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM c""",
    "op8_secrets": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, {', '.join(f'{_spans(r)} AS k{i}' for i, r in enumerate(RULES))} FROM d),
a AS (SELECT *, list_sort({' || '.join(f'k{i}' for i in range(len(RULES)))}) AS every, list_sort(k0 || k1 || k2) AS base FROM s)
SELECT doc_id, len(k0) AS n_assign, len(k1) AS n_access, len(k2) AS n_hex,
 sha256(coalesce(array_to_string(list_transform(base, lambda x: {_NAME}), ','), '')) AS base_sha256, coalesce(array_to_string(list_transform(every, lambda x: {_NAME}), ','), '') AS spans FROM a""",
    "op9_suffix_array": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM d WHERE length(x) >= 800),
h AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS k FROM w),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY k) > 1),
g AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS begins FROM r),
s AS (SELECT doc_id, i, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM g),
sp AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM s GROUP BY doc_id, nth),
gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM sp),
k AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, string_agg(substr(x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op11_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS lang_total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c SEMI JOIN k USING (lang, term) WHERE c.lang = g.lang AND c.source = g.source), 0) AS total FROM g),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (v.lang_total + v.v)::HUGEINT AS q
  FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM every QUALIFY part = 'pair' OR rank <= 200""",
    "op12_panes": """
WITH one AS (SELECT click_id, min(ROW(coalesce(arrived_at, ts), ts, kind, value)) AS c FROM clicks WHERE ts IS NOT NULL GROUP BY click_id),
d AS (SELECT click_id, c[2] AS ts, coalesce(c[3], 'none') AS kind, CASE WHEN isfinite(c[4]) THEN floor(100 * c[4] + 0.5)::BIGINT ELSE 0 END AS cents, (epoch_us(c[1]) // 86400000000) AS day,
  coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(click_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda t, i: xor(t >> 1, 3988292384 * (t & 1)))), 4294967295) % 30 - 23, 0) AS lag FROM one),
e AS (SELECT coalesce(click_id, -1) AS click_id, kind, cents, least(9, day % 10 + greatest(0, lag)) AS batch, epoch_us(ts) - (day - day % 10) * 86400000000 AS event FROM d),
r AS (SELECT *, floor(event / 3600000000.0)::BIGINT AS hour FROM e),
w AS (SELECT b.batch, (SELECT max(event) FROM r WHERE r.batch < b.batch) AS w FROM range(10) b(batch)),
x AS (SELECT r.*, coalesce(w.w >= (hour + 49) * 3600000000, false) AS late FROM r JOIN w USING (batch)),
p AS (SELECT kind, hour, batch, count(*) AS n, sum(cents) AS cents FROM x WHERE NOT late GROUP BY ALL),
t AS (SELECT kind, hour, batch, sum(n) OVER o AS n, sum(cents) OVER o AS cents, sum(n) OVER o - n AS n0, sum(cents) OVER o - cents AS cents0, min(batch) OVER (PARTITION BY kind, hour) AS first FROM p WINDOW o AS (PARTITION BY kind, hour ORDER BY batch)),
a AS (SELECT kind, hour, greatest(first, (SELECT min(w.batch) FROM w WHERE w.w >= (hour + 13) * 3600000000)) AS at, first FROM (SELECT DISTINCT kind, hour, first FROM t) WHERE EXISTS (SELECT 1 FROM w WHERE w.w >= (hour + 13) * 3600000000)),
f AS (SELECT a.at AS batch, hour, -1 AS click_id, arg_max(t.n, t.batch) AS n_rows, arg_max(t.cents, t.batch) AS cents, 'emit' AS record, kind FROM t JOIN a USING (kind, hour) WHERE t.batch <= a.at GROUP BY ALL
  UNION ALL SELECT 9, hour, -1, arg_max(n, batch), arg_max(t.cents, batch), 'final', kind FROM t ANTI JOIN a USING (kind, hour) GROUP BY kind, hour
  UNION ALL SELECT t.batch, hour, -1, n0, cents0, 'retract', kind FROM t JOIN a USING (kind, hour) WHERE t.batch > a.at
  UNION ALL SELECT t.batch, hour, -1, n, cents, 'replace', kind FROM t JOIN a USING (kind, hour) WHERE t.batch > a.at
  UNION ALL SELECT batch, hour, click_id, 1, cents, 'late', kind FROM x WHERE late)
SELECT batch::BIGINT AS batch, hour::BIGINT AS hour, click_id::BIGINT AS click_id, n_rows::BIGINT AS n_rows, cents::BIGINT AS cents, record, kind FROM f""",
}
