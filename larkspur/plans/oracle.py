"""SQL that gives each query's rows in another engine, written from the rules rather than from the plans."""

from __future__ import annotations

from ..functions import text as T
from . import fixtures as X
from .queries import NO_HIT, QUERY, VECTOR_OF

TEXT = "coalesce(text, '')"
RIGHTS = ["read", "write", "create", "publish", "local", "public"]


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{T.SPACE}+|{T.SPACE}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{T.SPACE}+', ' ', 'g'))"


def lower(x: str) -> str:
    return f"translate({x}, '{T.UPPER}', '{T.LOWER}')"


def normal(x: str) -> str:
    return f"trim(regexp_replace({lower(x)}, '[^a-z0-9]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return rf"list_transform(list_filter(regexp_split_to_array({x}, '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '' AND strlen(t) < 40), lambda t: lower(t))"


def grams(x: str) -> str:
    each = "CASE WHEN length(w) < 3 THEN ['_' || w || '_'] ELSE list_transform(range(1, length(w) - 1), lambda i: substr('_' || w || '_', i, 5)) END"
    return f"flatten(list_transform(list_filter(string_split({normal(x)}, ' '), lambda w: w <> ''), lambda w: {each}))"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def gibberish(x: str) -> str:
    b = f"regexp_replace({x}, '{T.CONTROL}', '', 'g')"
    return f"(length({b}) = 0 OR (length({b}) >= 10 AND ({count(b, T.ALNUM)} / length({b}) < 0.20 OR {count(b, T.SYMBOL)} / length({b}) > 0.70)) OR regexp_matches({b}, '{T.SYMBOL}{{12}}'))"


LINES = f"list_filter(list_transform(string_split(regexp_replace({TEXT}, '{T.CONTROL_BUT_TAB_AND_LINE}', '', 'g'), chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"


def bm25(docs: str, token_sql: str, query: list[str], k1: float, part: str = "") -> str:
    """CTEs that end in ``scored`` (doc, part, dl, score); ``docs`` has doc, text, ``part``, and any other columns."""
    rows = ", ".join(f"('{t}', {query.count(t)})" for t in dict.fromkeys(query))
    by = part or "0"
    return f"""
toks AS (SELECT doc, {by} AS part, {token_sql} AS tk FROM {docs}),
stats AS (SELECT part, count(*) AS n, greatest(sum(len(tk)), 1) / greatest(count(*), 1) AS avgdl FROM toks GROUP BY part),
q(term, qf) AS (VALUES {rows}),
tf AS (SELECT doc, part, dl, term, count(*) AS f FROM (SELECT doc, part, len(tk) AS dl, unnest(tk) AS term FROM toks) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT part, term, count(DISTINCT doc) AS df FROM tf GROUP BY ALL),
parts AS (SELECT tf.doc, qf * ln((n - df + 0.5) / (df + 0.5) + 1) * f * ({k1} + 1) / (f + {k1} * (0.25 + 0.75 * greatest(dl, 1) / avgdl)) AS s
  FROM tf JOIN df USING (part, term) JOIN stats USING (part) JOIN q USING (term)),
sums AS (SELECT doc, sum(s) AS s FROM parts GROUP BY doc),
scored AS (SELECT t.doc, t.part, len(t.tk) AS dl, round(coalesce(s, 0), 6) AS score FROM toks t LEFT JOIN sums USING (doc))"""


DOCS = f"(SELECT doc_id AS doc, {TEXT} AS text, source FROM documents)"
WORDS = QUERY.split()
VEC = f"(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {VECTOR_OF})"
SIM = f"round(coalesce(list_cosine_similarity(embedding::DOUBLE[], {VEC}), 0), 6)"
KEYWORD = bm25(DOCS, tokens("text"), WORDS, 1.2)


def gram_list(query: str) -> list[str]:
    out = []
    for w in query.split():
        w = f"_{w}_"
        out += [w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else [w]
    return out


def candidates(n: int) -> str:
    return f"cand AS (SELECT vec_id AS doc, {SIM} AS cosine FROM embeddings ORDER BY cosine DESC, doc LIMIT {n}), cdocs AS (SELECT c.doc, coalesce(d.text, '') AS text FROM cand c LEFT JOIN documents d ON d.doc_id = c.doc)"


def rerank(n: int, k: int, query: str = QUERY) -> str:
    return f"{candidates(n)}, {bm25('cdocs', grams('text'), gram_list(query), 1.5)}, ranked AS (SELECT doc, CASE WHEN max(dl) OVER () = 0 THEN cosine ELSE score END AS score, cosine FROM scored JOIN cand USING (doc) ORDER BY score DESC, cosine DESC, doc LIMIT {k})"


def exact_snippet(x: str, query: str) -> str:
    t = strip(x)
    at = f"instr({lower(t)}, '{query}')"
    return f"CASE WHEN {at} > 0 THEN substr({t}, greatest({at} - 1 - 160, 0) + 1, 320) ELSE left({t}, 320) END"


def scaled_snippet(x: str, words: list[str]) -> str:
    t = strip(x)
    norm = normal(f"left({t}, 32000)")
    places = "list_filter([" + ", ".join(f"instr(norm, '{w}')" for w in words) + "], lambda p: p > 0)"
    at = f"floor((list_min({places}) - 1) * (greatest(length(t), 1) / greatest(length(norm), 1)))"
    cut = collapse(f"substr(t, greatest({at} - 160, 0)::INT + 1, 320)")
    return f"(SELECT CASE WHEN len({places}) = 0 THEN left(t, 320) ELSE {cut} END FROM (SELECT {t} AS t, {norm} AS norm))"


HYBRID = f"WITH {KEYWORD}, hits AS (SELECT doc, score FROM scored WHERE score > 0 ORDER BY score DESC, doc LIMIT 200), joined AS (SELECT doc, score, {SIM} AS cosine FROM hits JOIN embeddings ON vec_id = doc)"
PEERS = f"WITH {bm25(DOCS, tokens('text'), WORDS, 1.2, 'source')}, ranked AS (SELECT part AS peer, doc, score, row_number() OVER (PARTITION BY part ORDER BY score DESC, doc) AS rn FROM scored WHERE score > 0)"
TRACKER = "tracker AS (SELECT doc_id AS path, n_chars - (lang = 'fr')::BIGINT AS mtime, sha256(CASE WHEN lang = 'de' THEN upper(left(text, 5)) ELSE text END) AS sha FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"
BEST_RULE = f"""WITH rules AS ({X.PATHS}), best AS (SELECT page_id, url, path_id, grp, is_public, rights FROM (
 SELECT page_id, url, r.*, row_number() OVER (PARTITION BY page_id ORDER BY strlen(prefix) DESC, path_id) AS rn FROM pages LEFT JOIN rules r ON starts_with(url, prefix)) WHERE rn = 1)"""
HEX = "list_reduce(list_transform(string_split(regexp_extract(t, '^0x\\+?0*([0-9a-f]{1,16})$', 1), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::HUGEINT), lambda a, b: a * 16 + b)"
NUMBER = "TRY_CAST(nullif(regexp_extract(t, '^\\+?0*([0-9]{1,20})$', 1), '') AS HUGEINT)"
SIGNED = "CASE WHEN {0} > 9223372036854775807 THEN {0} - 18446744073709551616 ELSE {0} END"

def plausible(x: str) -> str:
    b = f"regexp_replace({x}, '{T.CONTROL}', '', 'g')"
    return f"({strip(x)} <> '' AND length({x}) >= 5 AND length({b}) > 0 AND NOT (length({b}) >= 40 AND {count(b, T.ALNUM)} / length({b}) < 0.15))"


CLEAN = f"coalesce(array_to_string(list_transform(list_filter({LINES}, lambda x: NOT {gibberish('x')}), lambda x: {collapse('x')}), chr(10)), '')"
PEOPLE = "people AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE replace(c_name, '#', '_') END AS \"user\", c_mktsegment AS grp, sha256(c_name) AS pw_hash, c_acctbal < 0 AS locked FROM customer)"
KNOWN = f"{PEOPLE}, grps AS (SELECT DISTINCT grp AS name FROM people WHERE grp <> 'MACHINERY'), users AS (SELECT \"user\", locked, pw_hash FROM people WHERE c_custkey % 5 = 0 AND c_custkey % 7 <> 0)"
RIGHTS_OF = f"{X.GROUPS} UNION ALL SELECT n_nationkey::VARCHAR, 1::BIGINT << n_nationkey FROM nation UNION ALL SELECT DISTINCT c_mktsegment, (1::BIGINT << (30 + length(c_mktsegment))::INT) + CASE WHEN c_mktsegment < 'C' THEN {X.ADMIN} ELSE 0 END FROM customer"
VALID = "regexp_full_match({0}, '[A-Za-z0-9_.-]{{1,64}}')"
USER_VERDICTS = f"""SELECT "user", grp, pw_hash, CASE WHEN NOT {VALID.format('"user"')} THEN 'invalid_input' WHEN grp NOT IN (SELECT name FROM grps) THEN 'not_found' WHEN "user" IN (SELECT "user" FROM users) THEN 'already_exists' END AS error FROM people"""

SQL: dict[str, str] = {
    "scan_ext_filter": f"SELECT page_id, ext, ext IN ({', '.join(repr(e) for e in ('txt', 'md', 'rs', 'py', 'json', 'pdf', 'docx', 'xlsx', 'xls', 'csv', 'pptx'))}) AS wanted FROM (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]\\.([^./]+)$', 1)) AS ext FROM pages)",
    "vector_roundtrip": "SELECT vec_id, len(embedding)::INT AS n, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings",
    "keyword_index_topk": f"WITH {KEYWORD} SELECT doc, score FROM scored WHERE score > 0 ORDER BY score DESC, doc LIMIT 10",
    "block_max_topk": f"WITH {KEYWORD} SELECT doc, score FROM scored WHERE score > 0 ORDER BY score DESC, doc LIMIT 10",
    "boolean_index": f"WITH {bm25(DOCS, tokens('text'), ['the', 'the', 'estion', 'of', 'thering'], 1.2)} SELECT doc, score FROM scored JOIN toks USING (doc) WHERE (list_contains(tk, 'the') OR list_contains(tk, 'estion')) AND (list_contains(tk, 'of') OR list_contains(tk, 'thering')) AND NOT list_contains(tk, 'and') ORDER BY score DESC, doc LIMIT 10",
    "phrase_index": f"WITH {bm25(DOCS, tokens('text'), ['of', 'the', 'estion'], 1.2)} SELECT doc, score FROM scored JOIN toks USING (doc) WHERE contains(' ' || array_to_string(tk, ' ') || ' ', ' of the ') AND NOT contains(' ' || array_to_string(tk, ' ') || ' ', ' the and ') ORDER BY score DESC, doc LIMIT 10",
    "index_after_sync": f"""WITH moved AS (SELECT doc_id + 1 AS doc, coalesce(text, '') AS text FROM documents WHERE (doc_id + 1) % 7 = 0),
now AS (SELECT * FROM moved UNION ALL SELECT doc_id, coalesce(text, '') FROM documents WHERE lang IS DISTINCT FROM 'fr' AND doc_id NOT IN (SELECT doc FROM moved)),
{bm25('now', tokens('text'), QUERY.split(), 1.2)} SELECT doc, score FROM scored WHERE score > 0 ORDER BY score DESC, doc LIMIT 20""",
    "dir_listing": "SELECT source || '/' || doc_id AS name, lpad(n_chars::VARCHAR, 10, ' ') || '  ' || source || '/' || doc_id AS line FROM documents UNION ALL SELECT DISTINCT source, '   ' || source FROM documents",
    "doc_fetch": f"SELECT doc_id, left({TEXT}, 2000000) AS text, CASE WHEN {TEXT} = '' THEN 'empty_or_unreadable' ELSE '' END AS error FROM documents",
    "query_validate": f"SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty_query' WHEN length(t) > 4096 THEN 'query_too_long' WHEN regexp_matches(t, '{T.CONTROL}') THEN 'query_has_control_chars' ELSE 'ok' END AS verdict FROM (SELECT conv_id, turn, {strip(TEXT)} AS t FROM conversations)",
    "limit_clamp": "SELECT p_partkey, nullif(p_size, 13) * 2 - 2 AS asked, CASE WHEN p_size = 13 OR p_size IS NULL THEN 10 WHEN p_size * 2 - 2 < 1 THEN 1 WHEN p_size * 2 - 2 > 50 THEN 50 ELSE p_size * 2 - 2 END AS granted FROM part",
    "iam_name_valid": f"SELECT name, regexp_full_match({strip('name')}, '[A-Za-z0-9_.-]{{1,64}}') AS valid FROM (SELECT c_name AS name FROM customer UNION ALL SELECT DISTINCT c_mktsegment FROM customer)",
    "iam_path_valid": f"SELECT page_id, regexp_full_match({strip('url')}, '[ -~]{{1,512}}') AS valid FROM pages",
    "ascii_valid": f"SELECT doc_id, length({TEXT}) BETWEEN 1 AND 4096 AND regexp_full_match({TEXT}, '[ -~]*') AS valid FROM documents",
    "base_name": "SELECT page_id, CASE WHEN n IN ('', '.', '..') THEN 'file.bin' ELSE n END AS name FROM (SELECT page_id, list_last(string_split(rtrim(url, '/'), '/')) AS n FROM pages)",
    "truncate_chars": f"SELECT doc_id, substr({TEXT}, 1, 320) AS head, '' AS none FROM documents",
    "rights_parse": f"SELECT s, CAST(CASE {' '.join(f'WHEN t = {r!r} THEN {1 << i}' for i, r in enumerate(RIGHTS))} WHEN t = 'admin' THEN {X.ADMIN} WHEN regexp_full_match(t, '0x\\+?0*[0-9a-f]{{1,16}}') THEN {SIGNED.format(HEX)} WHEN {NUMBER} < 18446744073709551616 THEN {SIGNED.format(NUMBER)} END AS BIGINT) AS rights FROM (SELECT s, lower(trim(s)) AS t FROM ({X.RIGHTS_TEXT} UNION ALL SELECT ' 0X' || hex((p_retailprice * 100)::BIGINT) FROM part UNION ALL SELECT '+' || (p_retailprice * 100)::BIGINT FROM part UNION ALL SELECT p_brand FROM part))",
    "term_freq": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens(TEXT)}) AS term FROM documents) GROUP BY ALL",
    "doc_freq": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({tokens(TEXT)}) AS term FROM documents) GROUP BY term",
    "doc_length_stats": f"SELECT count(*) AS n_docs, sum(len({tokens(TEXT)}))::BIGINT AS total_len, round(greatest(sum(len({tokens(TEXT)})), 1) / greatest(count(*), 1), 6) AS avgdl FROM documents",
    "status_counts": "SELECT (SELECT count(DISTINCT source) FROM documents) AS n_peers, (SELECT count(*) FROM documents) AS n_docs, (SELECT least(count(*), 200) FROM events) AS ring",
    "gibberish_lines": f"SELECT doc_id, len(lines)::INT AS n_lines, len(list_filter(lines, lambda x: {gibberish('x')}))::INT AS n_gibberish FROM (SELECT doc_id, {LINES} AS lines FROM documents)",
    "bm25_topk": f"WITH {KEYWORD} SELECT doc, score FROM scored WHERE score > 0 ORDER BY score DESC, doc LIMIT 10",
    "bm25_boolean": f"WITH {bm25(DOCS, tokens('text'), ['the', 'of', 'the', 'estion'], 1.2)} SELECT doc, score FROM scored JOIN toks USING (doc) WHERE score > 0 AND list_contains(tk, 'the') AND NOT list_contains(tk, 'and') ORDER BY score DESC, doc LIMIT 10",
    "cosine_topk": f"SELECT vec_id AS doc, {SIM} AS cosine FROM embeddings ORDER BY cosine DESC, doc LIMIT 10",
    "cosine_pruned": f"SELECT vec_id AS doc, {SIM} AS cosine FROM embeddings ORDER BY cosine DESC, doc LIMIT 10",
    "vec_lookup": f"SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS place, unnest(embedding) AS value FROM embeddings WHERE vec_id = {VECTOR_OF}",
    "ngram_bm25": f"WITH {bm25(DOCS, grams('text'), gram_list(QUERY), 1.5)} SELECT doc, dl::INT AS dl, score FROM scored",
    "ngram_rerank": f"WITH {rerank(50, 50)} SELECT doc, score, cosine FROM ranked",
    "vector_query": f"WITH {rerank(50, 5)} SELECT doc, score, cosine FROM ranked",
    "vector_query_snippets": f"WITH {rerank(50, 5)} SELECT ranked.doc, score, {scaled_snippet('cdocs.text', WORDS)} AS snippet FROM ranked JOIN cdocs USING (doc)",
    "hybrid_join": f"{HYBRID} SELECT doc, score, cosine FROM joined",
    "hybrid_topk": f"{HYBRID}, top AS (SELECT greatest(max(score), 1) AS best FROM hits), fused AS (SELECT doc, score AS bm, round(0.7 * score / best + 0.3 * greatest(cosine, 0), 6) AS score FROM joined, top ORDER BY 3 DESC, bm DESC, doc LIMIT 10) SELECT f.doc, f.score, {exact_snippet(TEXT, QUERY)} AS snippet FROM fused f JOIN documents ON doc_id = f.doc",
    "hybrid_fallback_vector": f"WITH {rerank(50, 5, NO_HIT)} SELECT ranked.doc, score, {scaled_snippet('cdocs.text', NO_HIT.split())} AS snippet FROM ranked JOIN cdocs USING (doc)",
    "hybrid_fallback_bm25": f"WITH {KEYWORD}, top AS (SELECT doc, score FROM scored WHERE score > 0 ORDER BY score DESC, doc LIMIT 10) SELECT top.doc, top.score, {exact_snippet(TEXT, QUERY)} AS snippet FROM top JOIN documents ON doc_id = top.doc",
    "peer_topk": f"{PEERS} SELECT peer, doc, score FROM ranked WHERE rn <= 5",
    "federated_topk": f"{PEERS} SELECT peer, doc, score FROM ranked WHERE rn <= CASE WHEN peer = 'src0' THEN 10 ELSE 5 END ORDER BY score DESC, peer, doc LIMIT 10",
    "text_normalize": f"SELECT doc_id, {normal(TEXT)} AS normal FROM documents",
    "query_tokens": f"SELECT item_id, array_to_string(list_filter(string_split({normal(f'left({TEXT}, 32000)')}, ' '), lambda w: length(w) >= 2), '|') AS tokens FROM benchmark",
    "char_ngrams": f"SELECT doc_id, len(g)::INT AS n, sha256(array_to_string(g, ' ')) AS digest FROM (SELECT doc_id, {grams(TEXT)} AS g FROM documents)",
    "snippet_scaled": f"SELECT doc_id, {scaled_snippet(TEXT, ['thering', 'estion'])} AS snippet FROM documents",
    "snippet_exact": f"SELECT doc_id, {exact_snippet(TEXT, 'of the')} AS snippet FROM documents",
    "markup_segments": "SELECT page_id, coalesce(array_to_string(list_transform(list_filter(regexp_split_to_array(coalesce(html, ''), '[<>]'), lambda x: NOT starts_with(x, '/') AND NOT contains(x, ' ')), lambda x: x || ' '), ''), '') AS text FROM pages",
    "strip_markup": f"SELECT page_id, {collapse(chr(114) + 'egexp_replace(coalesce(html, ' + repr('') + '), ' + repr('<[^>]*>') + ', ' + repr(' ') + ', ' + repr('g') + ')')} AS text FROM pages",
    "collapse_ws": f"SELECT doc_id, {collapse(TEXT)} AS text FROM documents",
    "page_clean": f"SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(lines, lambda x: NOT {gibberish('x')}), lambda x: {collapse('x')}), chr(10)), '') AS text FROM (SELECT doc_id, {LINES} AS lines FROM documents)",
    "page_plausible": f"SELECT doc_id, {strip(TEXT)} <> '' AND length({TEXT}) >= 5 AND length(b) > 0 AND NOT (length(b) >= 40 AND {count('b', T.ALNUM)} / length(b) < 0.15) AS plausible FROM (SELECT doc_id, text, regexp_replace({TEXT}, '{T.CONTROL}', '', 'g') AS b FROM documents)",
    "content_hash": f"SELECT doc_id, sha256({TEXT}) AS sha256 FROM documents",
    "login_proof": f"SELECT challenge, pw_hash, sha256(unhex(sha256(pw_hash)) || unhex(nonce_hex) || encode(challenge) || encode(node)) AS proof FROM ({X.LOGINS} UNION ALL SELECT c_mktsegment, md5(c_name), c_name, c_nationkey::VARCHAR FROM customer)",
    "chat_topic": "SELECT a.n_name, b.n_name AS other, CASE WHEN a.n_name < b.n_name THEN 'chat-' || a.n_name || '-' || b.n_name ELSE 'chat-' || b.n_name || '-' || a.n_name END AS topic FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name",
    "sync_changed": f"WITH {TRACKER} SELECT d.doc_id AS path, d.n_chars AS mtime, CASE WHEN t.path IS NULL THEN 'new' ELSE 'changed' END AS status FROM documents d LEFT JOIN tracker t ON t.path = d.doc_id WHERE t.path IS NULL OR t.mtime <> d.n_chars",
    "sync_deleted": "SELECT doc_id AS path FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND lang = 'fr'",
    "sync_vector_changed": f"WITH {TRACKER} SELECT d.doc_id AS path, d.n_chars AS mtime, sha256(d.text) AS sha256, CASE WHEN t.path IS NULL THEN 'new' ELSE 'changed' END AS status FROM documents d LEFT JOIN tracker t ON t.path = d.doc_id WHERE {strip('coalesce(d.text, ' + repr('') + ')')} <> '' AND (t.path IS NULL OR t.mtime <> d.n_chars OR t.sha <> sha256(d.text))",
    "doc_fetch_upsert": f"""WITH p AS (SELECT * FROM documents WHERE doc_id % 7 <> 0), r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE {TEXT} END AS t, CASE WHEN doc_id % 5 = 0 THEN 'not_found' ELSE '' END AS e FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(p.doc_id, r.doc_id) AS req_id, p.source AS peer, 'd/' || p.doc_id AS path, r.doc_id IS NOT NULL AS done, coalesce(t, '') AS text, coalesce(e, '') AS error FROM p FULL JOIN r ON p.doc_id = r.doc_id""",
    "dedup_messages": "SELECT DISTINCT sha256(event_type || '|' || user_id || '|' || props) AS hash, event_type AS kind, user_id || '|' || props AS payload FROM events",
    "peer_presence": "SELECT user_id AS peer, event_type <> 'error' AS online FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "message_counts": "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type",
    "event_ring": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 200",
    "session_valid": f'SELECT session, "user", expires FROM ({X.SESSIONS} UNION ALL SELECT event_id::VARCHAR, user_id::VARCHAR, event_id % 2000 FROM events) WHERE NOT (expires < {X.NOW})',
    "iam_group_rights": f'SELECT m."user", bit_or(g.rights) AS rights FROM ({X.MEMBERSHIPS} UNION ALL SELECT c_name, unnest([c_mktsegment, c_nationkey::VARCHAR, \'gone\']) FROM customer) m JOIN ({RIGHTS_OF}) g ON m.grp = g.name GROUP BY m."user"',
    "iam_groups_list": f"SELECT name, (CASE WHEN rights < 0 THEN rights::HUGEINT + 18446744073709551616 ELSE rights::HUGEINT END)::VARCHAR AS rights FROM ({RIGHTS_OF}) ORDER BY name",
    "iam_longest_prefix": f"{BEST_RULE} SELECT page_id, path_id FROM best",
    "iam_prefix_intervals": f"""WITH rules AS (SELECT path_id, prefix FROM ({X.PATHS}) UNION ALL SELECT 'r' || page_id, left(url, (8 + page_id % 40)::INT) FROM pages),
 first AS (SELECT prefix, min(path_id) AS path_id FROM rules WHERE prefix IS NOT NULL GROUP BY prefix), n AS (SELECT max(length(prefix)) AS most FROM first),
 heads AS (SELECT page_id, left(url, k::INT) AS prefix, k FROM (SELECT page_id, url, unnest(range(0, least(length(url), most) + 1)) AS k FROM pages, n)),
 best AS (SELECT page_id, arg_max(path_id, k) AS path_id FROM heads JOIN first USING (prefix) GROUP BY page_id)
SELECT page_id, path_id FROM pages LEFT JOIN best USING (page_id)""",
    "iam_access_check": f"""{BEST_RULE},
 asked(right_name, wanted, public_scope) AS (VALUES {', '.join(f"('{n}', {w}, {str(p).lower()})" for n, w, p in X.WANTED)}),
 who(session) AS (VALUES ('s-ann'), ('s-bob'), ('s-old'), ('s-cyd'), ('s-dan'), ('s-none')),
 live AS (SELECT session, "user" FROM ({X.SESSIONS}) WHERE expires >= {X.NOW}),
 m AS ({X.MEMBERSHIPS}), own AS (SELECT m."user", bit_or(g.rights) AS rights FROM m JOIN ({X.GROUPS}) g ON m.grp = g.name GROUP BY 1),
 judged AS (SELECT page_id || '/' || who.session || '/' || right_name AS case_id, wanted,
   CASE WHEN NOT regexp_full_match({strip('url')}, '[ -~]{{1,512}}') THEN 'invalid_path' WHEN live."user" IS NULL THEN 'no_session' WHEN path_id IS NULL THEN 'no_path_rule' WHEN public_scope AND NOT is_public THEN 'path_not_public'
        WHEN grp IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m."user" = live."user" AND m.grp = best.grp) THEN 'group_mismatch' END AS no,
   coalesce(own.rights, 0) & best.rights AS eff
  FROM best CROSS JOIN asked CROSS JOIN who LEFT JOIN live ON live.session = who.session LEFT JOIN own ON own."user" = live."user")
SELECT case_id, CASE WHEN no IN ('invalid_path', 'no_session') THEN NULL WHEN no IS NOT NULL THEN false ELSE (eff & wanted) = wanted END AS allowed,
 coalesce(no, CASE WHEN (eff & wanted) = wanted THEN 'allow' ELSE 'deny' END) AS reason, CASE WHEN no IS NULL THEN eff ELSE 0 END::BIGINT AS effective FROM judged""",
    "iam_replay": f"""WITH e AS ({X.EVENTS} UNION ALL SELECT event_id + 100, event_type, CASE WHEN event_id % 4 = 0 THEN 'delete' ELSE 'upsert' END, CASE WHEN user_id % 50 = 0 THEN ' ' ELSE user_id::VARCHAR END, CASE WHEN event_id % 9 <> 0 THEN props END FROM events)
SELECT record_type, key, value_json FROM (SELECT *, row_number() OVER (PARTITION BY record_type, key ORDER BY seq DESC) AS rn FROM e WHERE trim(key) <> '' AND strlen(key) <= 512 AND (op = 'delete' OR value_json IS NOT NULL)) WHERE rn = 1 AND op = 'upsert'""",
    "iam_export": f"""WITH {PEOPLE} SELECT 'group' AS record_type, name AS key, to_json({{'name': name, 'rights': rights}})::VARCHAR AS value_json FROM ({RIGHTS_OF})
 UNION ALL SELECT 'membership', "user" || '::' || grp, to_json({{'user': "user", 'grp': grp}})::VARCHAR FROM people
 UNION ALL SELECT 'path', path_id, to_json({{'path_id': path_id, 'prefix': prefix, 'grp': grp, 'is_public': is_public, 'rights': rights}})::VARCHAR FROM ({X.PATHS})""",
    "topic_valid": "SELECT name, regexp_full_match(name, '[A-Za-z0-9._-]{1,128}') AS valid FROM (SELECT p_name AS name FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT n_name FROM nation)",
    "trim_truncate": f"SELECT doc_id, left({strip(TEXT)}, 64) AS head FROM documents",
    "bool_parse": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN false WHEN 1 THEN true END AS flag FROM part",
    "hex32_parse": f"SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN sha256({TEXT}) END AS key FROM documents",
    "flatten_lines": f"SELECT doc_id, {strip(f'translate({TEXT}, chr(13) || chr(10), chr(32) || chr(32))')} AS line FROM documents",
    "epoch_times": "SELECT event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000 AS ms FROM events",
    "score_text": "SELECT p_partkey, printf('%.3f', p_retailprice) AS three, printf('%.4f', p_retailprice) AS four FROM part",
    "new_ids": "SELECT count(*) AS n, count(*) AS different, count(*) AS well_formed FROM customer",
    "blank_query": "SELECT doc_id AS doc, 0.0::DOUBLE AS score FROM documents WHERE false",
    "bm25_grouped": f"WITH {bm25(DOCS, tokens('text'), ['the', 'the', 'estion', 'of', 'thering'], 1.2)} SELECT doc, score FROM scored JOIN toks USING (doc) WHERE (list_contains(tk, 'the') OR list_contains(tk, 'estion')) AND (list_contains(tk, 'of') OR list_contains(tk, 'thering')) AND NOT list_contains(tk, 'and') ORDER BY score DESC, doc LIMIT 10",
    "extract_formats": f"""SELECT '/corpus/' || doc_id || '.' || k AS path, doc_id AS mtime, CASE WHEN k = 'bad.txt' THEN NULL WHEN k = 'csv' THEN doc_id || ' a, b ' || sha256(t) || '  ' WHEN k IN ('txt', 'TXT') THEN t ELSE '' END AS text, k = 'bad.txt' AS broken
 FROM (SELECT doc_id, {TEXT} AS t, ['txt', 'TXT', 'md', 'csv', 'bin', 'bad.txt'][doc_id % 6 + 1] AS k FROM documents)""",
    "pdf_text": f"""SELECT path, concat_ws(chr(10), CASE WHEN one THEN c END, CASE WHEN two THEN doc_id || '!' END) AS text, 2::INT AS pages, (one::INT + two::INT)::INT AS native, 0::INT AS scanned, (2 - one::INT - two::INT)::INT AS skipped
 FROM (SELECT doc_id, doc_id || '.pdf' AS path, c, {plausible('c')} AS one, length(doc_id || '!') >= 5 AS two FROM (SELECT doc_id, {CLEAN} AS c FROM documents))""",
    "sync_next_keyword": f"SELECT doc_id AS path, n_chars AS mtime FROM documents WHERE doc_id % 5 = 1 OR (doc_id % 5 <> 0 AND {TEXT} <> '')",
    "sync_next_vector": f"""WITH {TRACKER}, now AS (SELECT doc_id, n_chars, sha256(text) AS sha FROM documents WHERE doc_id % 5 <> 1 AND {strip(TEXT)} <> ''),
 touched AS (SELECT doc_id FROM now LEFT JOIN tracker t ON t.path = doc_id WHERE t.path IS NULL OR t.mtime <> n_chars OR t.sha <> now.sha)
SELECT doc_id AS path, n_chars AS mtime, sha AS sha256, CASE WHEN doc_id IN (SELECT doc_id FROM touched) THEN 1 ELSE len(embedding) END::INT AS width FROM now LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NOT NULL OR doc_id IN (SELECT doc_id FROM touched)""",
    "search_poll": f"""{PEERS}, hits AS (SELECT peer, doc, score FROM ranked WHERE rn <= CASE WHEN peer = 'src0' THEN 10 ELSE 5 END ORDER BY score DESC, peer, doc LIMIT 10)
SELECT 1::BIGINT AS search_id, true AS ok, '' AS error, true AS partial, (row_number() OVER (ORDER BY score DESC, peer, doc))::INT AS rank, peer, doc::VARCHAR AS doc, score FROM hits
UNION ALL SELECT 2, true, '', true, NULL, NULL, NULL, NULL UNION ALL SELECT 3, false, 'not_found', true, NULL, NULL, NULL, NULL""",
    "hybrid_only": "SELECT event_id, user_id FROM events WHERE event_type = 'click'",
    "iam_user_verdicts": f"WITH {KNOWN} {USER_VERDICTS}",
    "iam_group_verdicts": f"WITH {KNOWN}, new AS (SELECT n_name AS name, n_regionkey::BIGINT AS rights FROM nation UNION ALL SELECT DISTINCT grp, 2 FROM people) SELECT name, rights, CASE WHEN NOT {VALID.format('name')} THEN 'invalid_input' WHEN name IN (SELECT name FROM grps) THEN 'already_exists' END AS error FROM new",
    "iam_path_verdicts": f"""WITH {KNOWN}, new AS (SELECT (page_id % 200)::VARCHAR AS path_id, url AS prefix, CASE page_id % 3 WHEN 0 THEN 'MACHINERY' WHEN 1 THEN 'BUILDING' END AS grp FROM pages),
 judged AS (SELECT *, CASE WHEN NOT regexp_full_match({strip('prefix')}, '[ -~]{{1,512}}') THEN 'invalid_input' WHEN grp IS NOT NULL AND grp NOT IN (SELECT name FROM grps) THEN 'not_found' WHEN path_id IN (SELECT path_id FROM ({X.PATHS})) THEN 'already_exists' END AS e FROM new)
SELECT path_id, prefix, CASE WHEN e IS NULL AND row_number() OVER (PARTITION BY path_id, e IS NULL ORDER BY prefix, grp NULLS FIRST) > 1 THEN 'already_exists' ELSE e END AS error FROM judged""",
    "iam_membership_add": f"WITH {KNOWN} SELECT \"user\", grp FROM people WHERE c_custkey % 10 = 0 AND c_custkey % 7 <> 0 UNION SELECT \"user\", grp FROM people WHERE \"user\" IN (SELECT \"user\" FROM users) AND grp IN (SELECT name FROM grps)",
    "iam_bootstrap": f"""WITH {KNOWN} SELECT 'first' AS pass, kind, key FROM (VALUES ('user', 'root'), ('membership', 'root'), ('group', 'admins'), ('path', 'Documents')) AS t(kind, key)
 UNION ALL SELECT 'first', 'group', name FROM grps UNION ALL SELECT 'later', 'group', name FROM grps UNION ALL SELECT 'later', 'user', "user" FROM users""",
    "audit_append": f"WITH {KNOWN}, judged AS ({USER_VERDICTS}) SELECT {X.NOW}::BIGINT AS ts, 'root' AS actor, 'add_user' AS action, \"user\" AS target, 'ok' AS detail FROM judged WHERE error IS NULL",
    "login_begin": f"""WITH {KNOWN} SELECT p."user", md5(p.pw_hash) AS challenge, {X.NOW + 60}::BIGINT AS expires, false AS used, CASE WHEN NOT {VALID.format('p."user"')} THEN 'invalid_input' WHEN u.locked IS NULL THEN 'not_found' WHEN u.locked THEN 'locked' END AS error FROM people p LEFT JOIN users u ON u."user" = p."user\"""",
    "login_finish": f"""WITH {PEOPLE}, tries AS (SELECT *, md5(pw_hash) AS challenge, unnest([c_custkey * 2, c_custkey * 2 + 1]) AS attempt FROM people),
 judged AS (SELECT attempt, "user", challenge, CASE WHEN c_custkey % 7 = 0 THEN 'invalid_input' WHEN c_custkey % 11 = 0 THEN 'not_found' WHEN c_custkey % 6 = 1 OR c_custkey % 13 = 0 THEN 'unauthorized' WHEN c_custkey % 4 = 0 THEN 'expired' WHEN locked THEN 'locked' WHEN c_custkey % 3 = 0 OR attempt % 2 = 1 THEN 'unauthorized' ELSE 'ok' END AS verdict FROM tries)
SELECT attempt, "user", challenge, verdict, CASE WHEN verdict = 'ok' THEN {X.NOW + 900}::BIGINT END AS session_expires FROM judged""",
}

SQL["merged_search_stream"] = """WITH e AS (SELECT event_id, user_id, coalesce(value, 0.0) AS score, min(event_id) OVER (PARTITION BY user_id) AS opened FROM events),
 h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, 'p' || event_id % 3, event_id::VARCHAR) AS rank FROM e WHERE event_id % 2 >= opened % 2)
SELECT 'n' || user_id % 4 AS origin, user_id AS search_id, rank::INT AS rank, 'p' || event_id % 3 AS peer, event_id::VARCHAR AS doc, score FROM h WHERE rank <= 1 + user_id % 5"""
SQL["doc_fetch_stream"], SQL["login_finish_stream"] = SQL["doc_fetch_upsert"], SQL["login_finish"]
SQL["hybrid_many"] = f"""SELECT 1::BIGINT AS query_id, * FROM ({SQL["hybrid_topk"].replace("LIMIT 10", "LIMIT 5").replace("SELECT f.doc", "SELECT row_number() OVER (ORDER BY f.score DESC, f.bm DESC, f.doc)::INT AS rank, 'fused' AS branch, f.doc")})
UNION ALL SELECT 2, * FROM ({SQL["hybrid_fallback_vector"].replace("SELECT ranked.doc", "SELECT row_number() OVER (ORDER BY score DESC, cosine DESC, ranked.doc)::INT AS rank, 'vector' AS branch, ranked.doc")})"""
