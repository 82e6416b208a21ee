"""Every query that the engine registers, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import validate as V
from ..operators import access, balls, bm25, intervals, login, search, sync
from ..operators.scratch import folder, keeping
from ..sources import files, index, segments, tables
from ..streaming import live, stateful
from . import fixtures as X

QUERY = "thering estion of the"
PHRASE = "of the"
NO_HIT = "zzqqxx yyvvkk"
VECTOR_OF = 7
K = 10

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = tables.read(spark, sf_dir, table)
    return tables.dealt(df) if table in ("documents", "pages") else df


def values(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(X.spark(sql))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


# Scans and sources


@query
def scan_ext_filter(spark, d):
    ext = files.extension(F.regexp_replace("url", "[?#].*$", ""))
    return read(spark, d, "pages").select("page_id", ext.alias("ext")).withColumn("wanted", F.col("ext").isin(*files.EXTENSIONS))


@query
def vector_roundtrip(spark, d):
    where = f"{folder(spark)}/vectors"
    index.save(where, vectors=read(spark, d, "embeddings").select("vec_id", "embedding"))
    held = index.load(spark, where, "vectors")
    return held.select("vec_id", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query
def keyword_index_topk(spark, d):
    where = f"{folder(spark)}/keywords"
    index.build_keyword(read(spark, d, "documents"), where)
    return index.search_keyword(spark, where, QUERY, K)


@query
def block_max_topk(spark, d):
    """Plain terms by the blocks of a segment index that can reach the best ten."""
    held = segments.SegmentIndex(spark, f"{folder(spark)}/segments")
    held.upsert(read(spark, d, "documents"))
    return held.search_pruned(QUERY, K)[0]


@query
def boolean_index(spark, d):
    """Groups, exclusions and boosts evaluated on postings."""
    held = segments.SegmentIndex(spark, f"{folder(spark)}/segments")
    held.upsert(read(spark, d, "documents"))
    return held.search("(the^2 OR estion) AND (of OR thering) -and", K)


@query
def phrase_index(spark, d):
    """A phrase by the positions in its terms' postings."""
    held = segments.SegmentIndex(spark, f"{folder(spark)}/segments")
    held.upsert(read(spark, d, "documents"))
    return held.search('+"of the" -"the and" estion', K)


@query
def index_after_sync(spark, d):
    """French documents go, every seventh one gets the text of the one before, and segments are merged on the way."""
    docs = read(spark, d, "documents").select("doc_id", "text", "lang")
    held = segments.SegmentIndex(spark, f"{folder(spark)}/segments", merge=2)
    held.upsert(docs)
    held.delete(docs.filter("lang = 'fr'"))
    moved = docs.select((F.col("doc_id") + 1).alias("doc_id"), "text").filter("doc_id % 7 = 0")
    held.upsert(moved)
    return held.search_pruned(QUERY, 20)[0]


@query
def dir_listing(spark, d):
    docs = read(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"), F.lit(False).alias("is_dir"), F.col("n_chars").alias("length"), "source")
    folders = docs.select(F.col("source").alias("name"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("length")).distinct()
    return files.listing(docs.drop("source").unionByName(folders))


@query
def doc_fetch(spark, d):
    text = T.truncate(_text(), T.DOC_CHARS)
    return read(spark, d, "documents").select("doc_id", text.alias("text"), F.when(text == "", "empty_or_unreadable").otherwise("").alias("error"))


# Validation and projection


@query
def query_validate(spark, d):
    texts = read(spark, d, "conversations").select("conv_id", "turn", "text")
    return texts.select("conv_id", "turn", F.coalesce(V.query_error(F.col("text")), F.lit("ok")).alias("verdict"))


@query
def limit_clamp(spark, d):
    asked = F.nullif(F.col("p_size"), F.lit(13)) * 2 - 2
    return read(spark, d, "part").select("p_partkey", asked.alias("asked"), V.limit_clamp(asked).alias("granted"))


@query
def iam_name_valid(spark, d):
    c = read(spark, d, "customer").select(F.col("c_name").alias("name")).union(read(spark, d, "customer").select("c_mktsegment").distinct())
    return c.select("name", V.name_valid(F.col("name")).alias("valid"))


@query
def iam_path_valid(spark, d):
    return read(spark, d, "pages").select("page_id", V.path_valid(F.col("url")).alias("valid"))


@query
def ascii_valid(spark, d):
    return read(spark, d, "documents").select("doc_id", V.ascii_valid(_text()).alias("valid"))


@query
def base_name(spark, d):
    return read(spark, d, "pages").select("page_id", V.base_name(F.col("url")).alias("name"))


@query
def truncate_chars(spark, d):
    return read(spark, d, "documents").select("doc_id", T.truncate(_text(), 320).alias("head"), T.truncate(_text(), 0).alias("none"))


@query
def rights_parse(spark, d):
    """The fixed spellings, and every part's sizes and prices written as numbers."""
    p = read(spark, d, "part")
    cents = (F.col("p_retailprice") * 100).cast("long")
    made = p.select(F.concat(F.lit(" 0X"), F.hex(cents)).alias("s")).union(p.select(F.concat(F.lit("+"), cents.cast("string")))).union(p.select("p_brand"))
    return values(spark, X.RIGHTS_TEXT).union(made).select("s", V.rights_parse(F.col("s")).alias("rights"))


# Aggregates of a collection


@query
def term_freq(spark, d):
    return bm25.term_freq(read(spark, d, "documents"), T.keyword_tokens(_text()))


@query
def doc_freq(spark, d):
    return bm25.doc_freq(term_freq(spark, d))


@query
def doc_length_stats(spark, d):
    out = bm25.length_stats(read(spark, d, "documents"), T.keyword_tokens(_text()))
    return out.select("n_docs", "total_len", F.round("avgdl", 6).alias("avgdl"))


@query
def status_counts(spark, d):
    docs = read(spark, d, "documents").agg(F.countDistinct("source").alias("n_peers"), F.count("*").alias("n_docs"))
    return docs.crossJoin(F.broadcast(read(spark, d, "events").agg(F.least(F.count("*"), F.lit(200)).alias("ring"))))


@query
def gibberish_lines(spark, d):
    lines = T.page_lines(_text())
    return read(spark, d, "documents").select("doc_id", F.size(lines).alias("n_lines"), F.size(F.filter(lines, T.is_gibberish)).alias("n_gibberish"))


# Search


@query
def bm25_topk(spark, d):
    return bm25.keyword_topk(read(spark, d, "documents"), QUERY, K)


@query
def bm25_boolean(spark, d):
    return bm25.keyword_topk(read(spark, d, "documents"), '+the "of the" -and estion', K)


@query
def cosine_topk(spark, d):
    e = read(spark, d, "embeddings")
    return search.cosine_topk(e, search.vec_lookup(e, VECTOR_OF), K)


@query
def cosine_pruned(spark, d):
    """The same ten from cells in the order of their bounds."""
    e, where = read(spark, d, "embeddings"), f"{folder(spark)}/balls"
    balls.build(e, where)
    return balls.topk(spark, where, search.vec_lookup(e, VECTOR_OF), K)[0]


@query
def vec_lookup(spark, d):
    e = read(spark, d, "embeddings")
    return e.filter(F.col("vec_id") == VECTOR_OF).select("vec_id", F.posexplode("embedding").alias("place", "value"))


@query
def ngram_bm25(spark, d):
    out = bm25.ngram_scores(read(spark, d, "documents"), QUERY)
    return keeping(out.select("doc", "dl", "score"), out)


@query
def ngram_rerank(spark, d):
    e = read(spark, d, "embeddings")
    few = search.cosine_topk(e, search.vec_lookup(e, VECTOR_OF), 50)
    return search.ngram_rerank(few, read(spark, d, "documents"), QUERY, 50)


@query
def vector_query(spark, d):
    e = read(spark, d, "embeddings")
    return search.vector_query(e, read(spark, d, "documents"), QUERY, search.vec_lookup(e, VECTOR_OF), 5)


@query
def vector_query_snippets(spark, d):
    e = read(spark, d, "embeddings")
    found = search.vector_query_snippets(e, read(spark, d, "documents"), QUERY, search.vec_lookup(e, VECTOR_OF), 5)
    return keeping(found.drop("cosine"), found)


@query
def hybrid_join(spark, d):
    e = read(spark, d, "embeddings")
    return search.hybrid_join(bm25.keyword_topk(read(spark, d, "documents"), QUERY, search.HYBRID_CANDIDATES), e, search.vec_lookup(e, VECTOR_OF))


@query
def hybrid_topk(spark, d):
    e = read(spark, d, "embeddings")
    return search.hybrid_search(read(spark, d, "documents"), e, QUERY, search.vec_lookup(e, VECTOR_OF), K)


@query
def hybrid_fallback_vector(spark, d):
    e = read(spark, d, "embeddings")
    return search.hybrid_search(read(spark, d, "documents"), e, NO_HIT, search.vec_lookup(e, VECTOR_OF), 5)


@query
def hybrid_fallback_bm25(spark, d):
    e = read(spark, d, "embeddings")
    return search.hybrid_search(read(spark, d, "documents"), e.filter(F.lit(False)), QUERY, search.vec_lookup(e, VECTOR_OF), K)


@query
def hybrid_many(spark, d):
    """A query with hits and one without, in one plan."""
    e = read(spark, d, "embeddings")
    v = search.vec_lookup(e, VECTOR_OF)
    return search.hybrid_many(read(spark, d, "documents"), e, [(1, QUERY, v), (2, NO_HIT, v)], 5)


@query
def peer_topk(spark, d):
    return search.peer_topk(read(spark, d, "documents"), QUERY)


@query
def federated_topk(spark, d):
    return search.federated_search(read(spark, d, "documents"), QUERY, "src0", K)


# Text


@query
def text_normalize(spark, d):
    return read(spark, d, "documents").select("doc_id", T.normalize(_text()).alias("normal"))


@query
def query_tokens(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.array_join(T.query_tokens(_text()), "|").alias("tokens"))


@query
def char_ngrams(spark, d):
    held = read(spark, d, "documents").select("doc_id", T.char_ngrams(_text()).alias("grams"))
    return held.select("doc_id", F.size("grams").alias("n"), F.sha2(F.array_join("grams", " "), 256).alias("digest"))


@query
def snippet_scaled(spark, d):
    return read(spark, d, "documents").select("doc_id", T.snippet_scaled(_text(), "thering estion").alias("snippet"))


@query
def snippet_exact(spark, d):
    return read(spark, d, "documents").select("doc_id", T.snippet_exact(_text(), PHRASE).alias("snippet"))


@query
def markup_segments(spark, d):
    return read(spark, d, "pages").select("page_id", T.markup_segments(F.coalesce("html", F.lit(""))).alias("text"))


@query
def strip_markup(spark, d):
    return read(spark, d, "pages").select("page_id", T.strip_markup(F.coalesce("html", F.lit(""))).alias("text"))


@query
def collapse_ws(spark, d):
    return read(spark, d, "documents").select("doc_id", T.collapse(_text()).alias("text"))


@query
def page_clean(spark, d):
    return read(spark, d, "documents").select("doc_id", T.page_clean(_text()).alias("text"))


@query
def page_plausible(spark, d):
    return read(spark, d, "documents").select("doc_id", T.page_plausible(_text()).alias("plausible"))


@query
def content_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(_text(), 256).alias("sha256"))


@query
def login_proof(spark, d):
    c = read(spark, d, "customer").select(F.col("c_mktsegment").alias("pw_hash"), F.md5("c_name").alias("nonce_hex"), F.col("c_name").alias("challenge"), F.col("c_nationkey").cast("string").alias("node"))
    rows = values(spark, X.LOGINS).unionByName(c).withColumn("nonce", F.unhex("nonce_hex"))
    return rows.select("challenge", "pw_hash", access.login_proof("pw_hash", "nonce", "challenge", "node").alias("proof"))


@query
def chat_topic(spark, d):
    n = read(spark, d, "nation").select("n_name", "n_regionkey")
    m = n.select(F.col("n_name").alias("other"), "n_regionkey")
    pairs = n.join(m, "n_regionkey").filter("n_name != other")
    return pairs.select("n_name", "other", F.concat(F.lit("chat-"), F.least("n_name", "other"), F.lit("-"), F.greatest("n_name", "other")).alias("topic"))


# Incremental indexing: the labelled documents are what an index knows, with French ones since touched and German ones rewritten


def _files(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("mtime"), "text", "lang")


def _tracker(spark, d):
    known = read(spark, d, "labels").select(F.col("doc_id").alias("path")).distinct()
    held = _files(spark, d).join(known, "path")
    return held.select("path", (F.col("mtime") - (F.col("lang") == "fr").cast("long")).alias("mtime"), F.sha2(F.when(F.col("lang") == "de", F.upper(F.left("text", F.lit(5)))).otherwise(F.col("text")), 256).alias("sha256"))


@query
def sync_changed(spark, d):
    return sync.changed(_files(spark, d), _tracker(spark, d))


@query
def sync_deleted(spark, d):
    # French files are gone
    return sync.deleted(_tracker(spark, d), _files(spark, d).filter("lang <> 'fr'"))


@query
def sync_vector_changed(spark, d):
    return sync.content_changed(_files(spark, d), _tracker(spark, d))


@query
def doc_fetch_upsert(spark, d):
    """Fetches of every document but each seventh, answered for all but each third, some with an error."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("req_id"), F.col("source").alias("peer"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), _text().alias("text"))
    failed = F.col("req_id") % 5 == 0
    answers = docs.filter("req_id % 3 <> 0").select("req_id", F.when(failed, "").otherwise(F.col("text")).alias("text"), F.when(failed, "not_found").otherwise("").alias("error"))
    return sync.upsert(docs.filter("req_id % 7 <> 0").drop("text"), answers)


# Messages and presence, over events


def _messages(spark, d):
    return read(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), F.concat_ws("|", F.col("user_id").cast("string"), "props").alias("payload"))


@query
def dedup_messages(spark, d):
    return live.dedup_messages(_messages(spark, d)).select("hash", "kind", "payload")


@query
def peer_presence(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("peer"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "expired").otherwise("discovered").alias("status"))
    return live.presence(e)


@query
def message_counts(spark, d):
    return live.message_counts(_messages(spark, d))


@query
def event_ring(spark, d):
    return live.ring(read(spark, d, "events").select("event_id", "user_id", "event_type"))


@query
def session_valid(spark, d):
    sessions = read(spark, d, "events").select(F.col("event_id").cast("string").alias("session"), F.col("user_id").cast("string").alias("user"), (F.col("event_id") % 2000).alias("expires"))
    return access.live(values(spark, X.SESSIONS).unionByName(sessions), X.NOW)


# Access control


@query
def iam_group_rights(spark, d):
    """Everyone is in the group of their segment, of their nation and of one that doesn't exist."""
    p = read(spark, d, "customer").select(F.col("c_name").alias("user"), F.explode(F.array("c_mktsegment", F.col("c_nationkey").cast("string"), F.lit("gone"))).alias("grp"))
    return access.group_rights(values(spark, X.MEMBERSHIPS).unionByName(p), _rights(spark, d))


@query
def iam_groups_list(spark, d):
    shown = F.when(F.col("rights") < 0, F.col("rights").cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.col("rights").cast("decimal(20,0)"))
    return _rights(spark, d).select("name", shown.cast("string").alias("rights")).orderBy("name")


@query
def iam_longest_prefix(spark, d):
    out = access.longest_prefix(read(spark, d, "pages").select("page_id", F.col("url").alias("path")), values(spark, X.PATHS))
    return out.select("page_id", F.col("rule_path_id").alias("path_id"))


@query
def iam_prefix_intervals(spark, d):
    """The fixed rules, and a rule for a part of each page's address: as many as there are pages."""
    pages = read(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    made = pages.select(F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("path_id"), F.expr("left(path, cast(8 + page_id % 40 as int))").alias("prefix"))
    out = intervals.longest_prefix(pages, values(spark, X.PATHS).select("path_id", "prefix").unionByName(made))
    return out.select("page_id", F.col("rule_path_id").alias("path_id"))


@query
def iam_access_check(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    asked = spark.createDataFrame([(s, n, w, p) for s in ("s-ann", "s-bob", "s-old", "s-cyd", "s-dan", "s-none") for n, w, p in X.WANTED], "session string, right string, wanted long, public_scope boolean")
    cases = pages.crossJoin(F.broadcast(asked)).withColumn("case_id", F.concat_ws("/", F.col("page_id").cast("string"), "session", "right"))  # eighteen cases a page
    return access.check(cases.select("case_id", "session", "path", "wanted", "public_scope"), values(spark, X.SESSIONS), values(spark, X.MEMBERSHIPS), values(spark, X.GROUPS), values(spark, X.PATHS), X.NOW)


@query
def iam_replay(spark, d):
    """The fixed cases, and an event for each of the event table: deletes, upserts with and without a value, blank keys."""
    e = read(spark, d, "events")
    key = F.when(F.col("user_id") % 50 == 0, F.lit(" ")).otherwise(F.col("user_id").cast("string"))
    made = e.select((F.col("event_id") + 100).alias("seq"), F.col("event_type").alias("record_type"), F.when(F.col("event_id") % 4 == 0, "delete").otherwise("upsert").alias("op"), key.alias("key"), F.when(F.col("event_id") % 9 != 0, F.col("props")).alias("value_json"))
    return access.replay(values(spark, X.EVENTS).unionByName(made))


@query
def iam_export(spark, d):
    groups = _rights(spark, d).withColumn("key", F.col("name"))
    members = _people(spark, d).select("user", "grp").withColumn("key", F.concat_ws("::", "user", "grp"))
    paths = values(spark, X.PATHS).withColumn("key", F.col("path_id"))
    return access.export(group=groups, membership=members, path=paths)


# Smaller rules


@query
def topic_valid(spark, d):
    names = read(spark, d, "part").select(F.col("p_name").alias("name")).union(read(spark, d, "customer").select("c_name")).union(read(spark, d, "nation").select("n_name"))
    return names.select("name", V.topic_valid(F.col("name")).alias("valid"))


@query
def trim_truncate(spark, d):
    return read(spark, d, "documents").select("doc_id", T.trim_truncate(_text(), 64).alias("head"))


@query
def bool_parse(spark, d):
    s = F.concat(F.lit(" "), (F.col("p_size") % 3).cast("string"), F.lit("\t"))
    return read(spark, d, "part").select("p_partkey", V.bool_parse(s).alias("flag"))


@query
def hex32_parse(spark, d):
    digest = F.sha2(_text(), 256)
    s = F.when(F.col("doc_id") % 3 == 0, F.upper(digest)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  "), digest)).otherwise(F.left(digest, F.lit(63)))
    return read(spark, d, "documents").select("doc_id", F.lower(F.hex(V.hex32_parse(s))).alias("key"))


@query
def flatten_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", T.flatten_lines(_text()).alias("line"))


@query
def epoch_times(spark, d):
    return read(spark, d, "events").select("event_id", V.epoch_s(F.col("ts")).alias("s"), V.epoch_ms(F.col("ts")).alias("ms"))


@query
def score_text(spark, d):
    return read(spark, d, "part").select("p_partkey", T.score_text(F.col("p_retailprice"), 3).alias("three"), T.score_text(F.col("p_retailprice"), 4).alias("four"))


@query
def new_ids(spark, d):
    """Random ids have the right form and none stands twice."""
    ids = read(spark, d, "customer").select("c_custkey", login.new_id().alias("id"))
    return ids.agg(F.count("*").alias("n"), F.countDistinct("id").alias("different"), F.sum(F.col("id").rlike("^[0-9a-f]{32}$").cast("long")).alias("well_formed"))


@query
def blank_query(spark, d):
    e, docs = read(spark, d, "embeddings"), read(spark, d, "documents")
    vector = search.vec_lookup(e, VECTOR_OF)
    found = bm25.keyword_topk(docs, " \t ", K).union(bm25.keyword_topk(docs, QUERY, 0))
    for q, k in ((" ", K), (QUERY, 0)):
        found = found.union(search.vector_query(e, docs, q, vector, k).select("doc", "score"))
    return found


@query
def bm25_grouped(spark, d):
    return bm25.keyword_topk(read(spark, d, "documents"), "(the^2 OR estion) AND (of OR thering) -and", K)


# Files: texts as they would lie in a folder, in several formats


def _as_files(spark, d):
    docs = read(spark, d, "documents").select("doc_id", _text().alias("text"))
    kind = F.element_at(F.array(*map(F.lit, ("txt", "TXT", "md", "csv", "bin", "bad.txt"))), (F.col("doc_id") % 6 + 1).cast("int"))
    cells = F.concat(F.col("doc_id").cast("string"), F.lit(',"a, b"\n'), F.sha2("text", 256), F.lit(",\n"))
    body = F.when(kind == "csv", F.encode(cells, "UTF-8")).when(kind == "bad.txt", F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return docs.select(F.concat(F.lit("/corpus/"), F.col("doc_id").cast("string"), F.lit("."), kind).alias("path"), F.col("doc_id").alias("mtime"), body.alias("content"))


@query
def extract_formats(spark, d):
    return files.extract(_as_files(spark, d)).select("path", "mtime", "text", F.col("error").isNotNull().alias("broken"))


@query
def pdf_text(spark, d):
    """Each document as a PDF of two pages, its text and its number."""
    shown = F.regexp_replace(_text(), r"([()\\])", r"\\$1")
    head = "%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [ 3 0 R 4 0 R ] /Count 2 >> endobj\n3 0 obj << /Type /Page /Contents 5 0 R >> endobj\n4 0 obj << /Type /Page /Contents 6 0 R >> endobj\n"
    stream = [F.concat(F.lit(f"{n} 0 obj << /Filter [] >> stream\n"), body, F.lit("\nendstream endobj\n")) for n, body in ((5, F.concat(F.lit("BT ("), shown, F.lit(") Tj ET"))), (6, F.concat(F.lit("BT 1 0 0 1 9 9 Tm [("), F.col("doc_id").cast("string"), F.lit(") -250 (\\041)] TJ ET"))))]
    content = F.encode(F.concat(F.lit(head), *stream, F.lit("trailer << /Root 1 0 R >>")), "UTF-8")
    made = read(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.col("doc_id").alias("mtime"), content.alias("content"))
    return files.read_pdfs(made).select("path", "text", "pages", "native", "scanned", "skipped")


# States after a pass


@query
def sync_next_keyword(spark, d):
    blank = F.when(F.col("path") % 5 == 0, "").when(F.col("path") % 5 == 1, " ").otherwise(F.col("text"))
    return sync.next_keyword_state(_files(spark, d).withColumn("text", blank), _tracker(spark, d))


@query
def sync_next_vector(spark, d):
    blank = F.when(F.col("path") % 5 == 1, " \u3000").otherwise(F.col("text"))
    now = _files(spark, d).withColumn("text", blank)
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("path"), F.col("embedding").alias("vec"))
    fresh = sync.content_changed(now, _tracker(spark, d)).select("path", F.array(F.lit(1.0).cast("float")).alias("vec"))
    out = sync.next_vector_state(now, vectors, _tracker(spark, d), fresh)
    return out.select("path", "mtime", "sha256", F.size("vec").alias("width"))


# Searches that other peers answer


@query
def search_poll(spark, d):
    """What three searches hold: one with hits, one without, one that is unknown."""
    hits = search.federated_search(read(spark, d, "documents"), QUERY, "src0", K)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "peer", "doc"))  # ten rows
    written = hits.select(F.lit("me").alias("origin"), F.lit(1).cast("long").alias("search_id"), rank.alias("rank"), "peer", F.col("doc").cast("string").alias("doc"), "score")
    searches = spark.createDataFrame([("me", 1), ("me", 2)], "origin string, search_id long")
    found = [live.poll(searches, written, "me", k) for k in (1, 2, 3)]
    rows = found[0].union(found[1]).union(found[2])
    each = rows.select("search_id", "ok", "error", "partial", F.explode_outer("hits").alias("hit"))
    return each.select("search_id", "ok", "error", "partial", "hit.rank", "hit.peer", "hit.doc", "hit.score")


@query
def hybrid_only(spark, d):
    kind = F.when(F.col("event_type") == "click", "hybrid").otherwise(F.col("event_type"))
    return live.merged_kind(read(spark, d, "events").select("event_id", kind.alias("kind"), "user_id"))


# Records with their rules, over customers


def _people(spark, d):
    """Every seventh has a name that isn't valid; users stand twice, in two groups."""
    c = read(spark, d, "customer")
    user = F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(F.regexp_replace("c_name", "#", "_"))
    return c.select("c_custkey", user.alias("user"), F.col("c_mktsegment").alias("grp"), F.sha2("c_name", 256).alias("pw_hash"), (F.col("c_acctbal") < 0).alias("locked"))


def _groups(spark, d):
    return _people(spark, d).filter("grp <> 'MACHINERY'").select(F.col("grp").alias("name"), F.lit(1).cast("long").alias("rights")).distinct()


def _rights(spark, d):
    """The fixed groups, one for each nation with the right of its number, and one for each segment."""
    nations = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.expr("shiftleft(1L, n_nationkey)").alias("rights"))
    segments = read(spark, d, "customer").select("c_mktsegment").distinct().select(F.col("c_mktsegment").alias("name"), F.expr("shiftleft(1L, 30 + length(c_mktsegment)) + IF(c_mktsegment < 'C', -9223372036854775807L - 1L, 0L)").alias("rights"))
    return values(spark, X.GROUPS).unionByName(nations).unionByName(segments)


def _users(spark, d):
    return _people(spark, d).filter("c_custkey % 5 = 0 and c_custkey % 7 <> 0").select("user", "locked", "pw_hash")


@query
def iam_user_verdicts(spark, d):
    return access.user_verdicts(_users(spark, d), _people(spark, d).select("user", "grp", "pw_hash"), _groups(spark, d))


@query
def iam_group_verdicts(spark, d):
    new = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("rights")).union(_people(spark, d).select("grp", F.lit(2).cast("long")).distinct())
    return access.group_verdicts(_groups(spark, d), new)


@query
def iam_path_verdicts(spark, d):
    new = read(spark, d, "pages").select((F.col("page_id") % 200).cast("string").alias("path_id"), F.col("url").alias("prefix"), F.when(F.col("page_id") % 3 == 0, "MACHINERY").when(F.col("page_id") % 3 == 1, "BUILDING").alias("grp"), F.lit(True).alias("is_public"), F.lit(1).cast("long").alias("rights"))
    return access.path_verdicts(values(spark, X.PATHS), new, _groups(spark, d)).select("path_id", "prefix", "error")


@query
def iam_membership_add(spark, d):
    held = _people(spark, d).filter("c_custkey % 10 = 0 and c_custkey % 7 <> 0").select("user", "grp")
    return access.add_membership(held, _people(spark, d).select("user", "grp"), _groups(spark, d), _users(spark, d))


@query
def iam_bootstrap(spark, d):
    """Once without users, and once with some, where nothing changes."""
    users = _users(spark, d)
    none = users.limit(0)
    members, paths = spark.createDataFrame([], "user string, grp string"), values(spark, X.PATHS).limit(0)
    first = access.bootstrap(none, members, _groups(spark, d), paths, "root", "hash", "p")
    later = access.bootstrap(users, members, _groups(spark, d), paths, "root", "hash", "p")
    out = None
    for name, tables in (("first", first), ("later", later)):
        for kind, key, t in zip(("user", "membership", "group", "path"), ("user", "user", "name", "prefix"), tables, strict=True):
            rows = t.select(F.lit(name).alias("pass"), F.lit(kind).alias("kind"), F.col(key).alias("key"))
            out = rows if out is None else out.union(rows)
    return out


@query
def audit_append(spark, d):
    judged = access.user_verdicts(_users(spark, d), _people(spark, d).select("user", "grp", "pw_hash"), _groups(spark, d))
    return access.audit(judged, "root", "add_user", "user", X.NOW)


@query
def login_begin(spark, d):
    asked = _people(spark, d).select("user", F.md5("pw_hash").alias("challenge"))
    return login.begin(asked, _users(spark, d), X.NOW)


@query
def login_finish(spark, d):
    """Everyone tries twice, every third with a wrong proof, some too late, some with another's challenge or one that was used."""
    p, key = _people(spark, d), F.col("c_custkey")
    challenge = F.md5("pw_hash")
    held = p.filter("c_custkey % 11 <> 0").select(challenge.alias("challenge"), F.when(key % 13 == 0, "other").otherwise(F.col("user")).alias("user"), F.when(key % 4 == 0, X.NOW - 1).otherwise(X.NOW).cast("long").alias("expires"), (key % 6 == 1).alias("used"), F.unhex(F.lit("00ff")).alias("nonce"))
    right = access.login_proof("pw_hash", "nonce", "challenge", "node")
    made = p.select("c_custkey", "user", challenge.alias("challenge"), "pw_hash", F.unhex(F.lit("00ff")).alias("nonce"), F.lit("node-1").alias("node"))
    tries = made.select("user", "challenge", F.when(key % 3 == 0, "no").otherwise(right).alias("proof"), F.explode(F.array(key * 2, key * 2 + 1)).alias("attempt"))
    users = p.filter("c_custkey % 7 <> 0").select("user", "locked", "pw_hash")
    return login.finish(tries, held, users, "node-1", X.NOW)


# Streams: fed in two parts, the query being started anew for the second


def _streamed(spark, parts, plan, mode="append"):
    """The folder that holds what ``plan`` of a stream over the parts has written."""
    top = folder(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{top}/in")
        stateful.run(plan(spark.readStream.schema(part.schema).parquet(f"{top}/in")), f"{top}/out", f"{top}/state", mode)
    return f"{top}/out"


@query
def merged_search_stream(spark, d):
    """A search for each user, opened by their first event; every event is a hit. Those with even numbers come first."""
    e = read(spark, d, "events").select("event_id", "user_id", F.coalesce("value", F.lit(0.0)).alias("score"))
    key = [F.concat(F.lit("n"), (F.col("user_id") % 4).cast("string")).alias("origin"), F.col("user_id").alias("search_id")]
    none = F.lit(None).cast("string")
    opens = e.groupBy("user_id").agg(F.min("event_id").alias("event_id")).select(*key, (1 + F.col("user_id") % 5).cast("int").alias("lim"), none.alias("peer"), none.alias("doc"), F.lit(0.0).alias("score"), "event_id")
    hits = e.select(*key, F.lit(None).cast("int").alias("lim"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("peer"), F.col("event_id").cast("string").alias("doc"), "score", "event_id")
    rows = opens.unionByName(hits)
    out = _streamed(spark, [rows.filter(F.col("event_id") % 2 == k).drop("event_id") for k in (0, 1)], stateful.merge_hits, "update")
    return stateful.latest(spark, out, stateful.MERGED, ["origin", "search_id"])


@query
def doc_fetch_stream(spark, d):
    """Fetches, then their responses, as a stream of upserts."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("req_id"), F.col("source").alias("peer"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), _text().alias("text"))
    failed = F.col("req_id") % 5 == 0
    asked = docs.filter("req_id % 7 <> 0").select("req_id", "peer", "path", F.lit(None).cast("boolean").alias("done"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("string")
    answers = docs.filter("req_id % 3 <> 0").select("req_id", none.alias("peer"), none.alias("path"), F.lit(True).alias("done"), F.when(failed, "").otherwise(F.col("text")).alias("text"), F.when(failed, "not_found").otherwise("").alias("error"))
    out = _streamed(spark, [asked, answers], lambda s: s)
    rows = stateful.upserted(spark, out, "req_id long, peer string, path string, done boolean, text string, error string", "req_id", [])
    return rows.select("req_id", "peer", "path", F.coalesce("done", F.lit(False)).alias("done"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("error", F.lit("")).alias("error"))


@query
def login_finish_stream(spark, d):
    """The challenges and attempts of login_finish; second attempts come after a restart."""
    p, key = _people(spark, d), F.col("c_custkey")
    ts, none, at = F.timestamp_seconds(F.lit(X.NOW)).alias("ts"), F.lit(None).cast("string"), F.lit(None).cast("long")
    challenge, nonce = F.md5("pw_hash"), F.unhex(F.lit("00ff"))
    held = p.filter("c_custkey % 11 <> 0").select(
        ts, challenge.alias("challenge"), F.when(key % 13 == 0, "other").otherwise(F.col("user")).alias("owner"), F.when(key % 4 == 0, X.NOW - 1).otherwise(X.NOW).cast("long").alias("expires"),
        (key % 6 == 1).alias("used"), nonce.alias("nonce"), at.alias("attempt"), none.alias("user"), none.alias("proof"), at.alias("now"),
    )
    right = access.login_proof("pw_hash", "nonce", "challenge", "node")
    made = p.select("c_custkey", "user", challenge.alias("challenge"), "pw_hash", nonce.alias("nonce"), F.lit("node-1").alias("node"))
    tries = made.select(
        ts, "challenge", none.alias("owner"), at.alias("expires"), F.lit(None).cast("boolean").alias("used"), F.lit(None).cast("binary").alias("nonce"),
        F.explode(F.array(key * 2, key * 2 + 1)).alias("attempt"), "user", F.when(key % 3 == 0, "no").otherwise(right).alias("proof"), F.lit(X.NOW).cast("long").alias("now"),
    )
    users = p.filter("c_custkey % 7 <> 0").select("user", "locked", "pw_hash")
    parts = [held.unionByName(tries.filter("attempt % 2 = 0")), tries.filter("attempt % 2 = 1")]
    out = _streamed(spark, parts, lambda s: stateful.finish(s, users, "node-1"))
    return spark.read.schema(stateful.JUDGED).parquet(out).drop("epoch")
