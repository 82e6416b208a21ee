"""Access control, change detection, sources and streams on small relations."""

import hashlib
import io
import os
import time
import zipfile
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import validate as V
from larkspur.operators import access, login, sync
from larkspur.plans import fixtures as X
from larkspur.plans.queries import values
from larkspur.sources import files
from larkspur.sources.pdf import pdf_pages
from larkspur.streaming import live


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_access_outcomes(spark):
    groups = values(spark, "SELECT * FROM (VALUES ('g', CAST(3 AS BIGINT)), ('h', CAST(4 AS BIGINT))) AS t(name, rights)")
    members = values(spark, "SELECT * FROM (VALUES ('u', 'g'), ('u', 'gone')) AS t(\"user\", grp)")
    paths = values(spark, "SELECT * FROM (VALUES ('1', '/a', 'g', false, CAST(7 AS BIGINT)), ('2', '/ab', 'h', true, CAST(7 AS BIGINT)), ('0', '/a', CAST(NULL AS VARCHAR(20)), true, CAST(1 AS BIGINT))) AS t(path_id, prefix, grp, is_public, rights)")
    sessions = values(spark, "SELECT * FROM (VALUES ('s', 'u', CAST(10 AS BIGINT)), ('old', 'u', CAST(9 AS BIGINT))) AS t(session, \"user\", expires)")
    cases = [(1, "s", "é", 1, False), (2, "old", "/a", 1, False), (3, "s", "/b", 1, False), (4, "s", "/a/x", 1, True), (5, "s", "/abc", 1, True), (6, "s", "/a", 2, False), (7, "s", "/a", 0, False)]
    df = spark.createDataFrame(cases, "case_id int, session string, path string, wanted long, public_scope boolean")
    got = rows(access.check(df, sessions, members, groups, paths, 10), "case_id")
    assert got == [(1, None, "invalid_path", 0), (2, None, "no_session", 0), (3, False, "no_path_rule", 0), (4, True, "allow", 1), (5, False, "group_mismatch", 0), (6, False, "deny", 1), (7, True, "allow", 1)]
    assert access.longest_prefix(df, paths.limit(0)).filter("rule_path_id is not null").count() == 0


def test_replay_last_arrival_wins(spark):
    got = rows(access.replay(values(spark, X.EVENTS)), "record_type", "key")
    assert got == [("membership", "ann::g", '{"m":2}'), ("path", "p", '{"p":1}'), ("user", "ann", '{"version":1}')]


def test_adding_records(spark):
    groups, members, paths = (values(spark, x) for x in (X.GROUPS, X.MEMBERSHIPS, X.PATHS))
    new = spark.createDataFrame([("readers", 9), ("bad name", 1), ("fresh", 2)], "name string, rights long")
    assert {r.name for r in access.add_group(groups, new).collect()} == {"readers", "writers", "admins", "nobody", "fresh"}
    asked = spark.createDataFrame([("ann", "admins"), ("ann", "none"), ("who", "admins"), ("ann", "readers")], "user string, grp string")
    assert access.add_membership(members, asked, groups, members.select("user").distinct()).count() == members.count() + 1
    rules = spark.createDataFrame([("n1", "/x", "readers", True, 1), ("n2", "/x", "none", True, 1), ("n3", "", None, True, 1), ("n4", "/y", None, True, 1)], paths.schema)
    assert access.add_path(paths, rules, groups).count() == paths.count() + 2


def test_sync(spark):
    before = spark.createDataFrame([("same", 1, "a"), ("gone", 1, "b"), ("touched", 1, "c"), ("rewritten", 1, "d"), ("blanked", 1, "e")], "path string, mtime long, text string")
    after = spark.createDataFrame([("same", 1, "a"), ("touched", 2, "c"), ("rewritten", 1, "D"), ("blanked", 2, " "), ("new", 1, "n")], before.schema)
    tracker = before.select("path", "mtime", F.sha2("text", 256).alias("sha256"))
    assert rows(sync.changed(after, tracker).select("path", "status"), "path") == [("blanked", "changed"), ("new", "new"), ("touched", "changed")]
    assert rows(sync.content_changed(after, tracker).select("path", "status"), "path") == [("new", "new"), ("rewritten", "changed"), ("touched", "changed")]
    assert rows(sync.deleted(tracker, after), "path") == [("gone",)]
    # one live version a path, and a blank document leaves the vectors, unlike where faults were known
    old = before.select("path", F.array(F.lit(0.0)).alias("vec"))
    fresh = spark.createDataFrame([(p, [1.0]) for p in ("touched", "rewritten", "new")], "path string, vec array<double>")
    state = {r.path: r.vec for r in sync.next_vector_state(after, old, tracker, fresh).collect()}
    assert state == {"same": [0.0], "touched": [1.0], "rewritten": [1.0], "new": [1.0]}
    assert {r.path for r in sync.next_keyword_state(after, tracker).collect()} == {"same", "touched", "rewritten", "blanked", "new"}


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("DOT", "."), body)
    return out.getvalue()


def test_extraction(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><row><c t="s"><v>0</v></c><c><v>7</v></c></row></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>cell</t></si></sst>'
    made = {
        "a.TXT": b"plain", "sub/b.docx": zipped(word__documentDOTxml="<w:t>one</w:t><w:t>two words</w:t>"), "c.csv": b"x,y\n1,2\n", "d.md": b"unread", "e.bin": b"z", "bad.txt": b"\xff", "bad.docx": b"no",
        "p.pptx": zipped(ppt__slides__slide1DOTxml="<a>s1</a>", ppt__slides__slide2DOTxml="<a>s2</a>", ppt__slides__slide4DOTxml="<a>s4</a>"), "s.xlsx": zipped(xl__worksheets__sheet1DOTxml=sheet, xl__sharedStringsDOTxml=shared),
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    everything = files.crawl(spark, str(tmp_path))
    assert everything.count() == 9 and files.crawl_known(spark, str(tmp_path)).count() == 8
    got = {r.path.rpartition("/")[2]: (r.text, r.error is not None) for r in files.extract(everything).collect()}
    assert got["a.TXT"] == ("plain", False) and got["b.docx"] == (" w:t one  w:t  ", False) and got["c.csv"] == ("x y 1 2 ", False)
    assert got["d.md"] == ("", False) and got["e.bin"] == ("", False) and got["bad.txt"] == (None, True) and got["bad.docx"] == (None, True)
    assert "s2" in got["p.pptx"][0] and "s4" not in got["p.pptx"][0] and got["s.xlsx"] == ("cell 7 ", False)


def test_pdf_pages_fall_back():
    native, ocr = (lambda _: ["good page", "", "--", None]), (lambda _: ["", "scanned", "", ""])
    got = files.pdf_report(b"", native, ocr, str.strip, lambda t: len(t) >= 5)
    assert got["text"] == "good page\nscanned" and (got["pages"], got["native"], got["scanned"], got["skipped"]) == (4, 1, 1, 2)
    assert files.pdf_report(b"", lambda _: [None])["warnings"] == ["page 1 skipped"]


def pdf(*pages, packed=False, tail=b"trailer << /Root 1 0 R >>"):
    """A PDF with a content stream for each page; ``packed``: dictionaries in an object stream."""
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(pages)))
    dicts = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [ {kids} ] /Count {len(pages)} >>"}
    out = [b"%PDF-1.5\n%\xe2\xe3\n"]
    for i, body in enumerate(pages):
        dicts[10 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents [ {11 + 2 * i} 0 R ] >>"
        data = zlib.compress(body)
        out.append(b"%d 0 obj << /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream endobj\n" % (11 + 2 * i, len(data), data))
    if packed:
        places, at = [], 0
        for n, d in dicts.items():
            places.append(f"{n} {at}")
            at += len(d) + 1
        head = " ".join(places) + " "
        data = zlib.compress((head + " ".join(dicts.values())).encode())
        out.append(b"90 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length 91 0 R >> stream\r\n%s\nendstream endobj 91 0 obj %d endobj\n" % (len(dicts), len(head), data, len(data)))
    else:
        out += [f"{n} 0 obj {d} endobj\n".encode() for n, d in dicts.items()]
    return b"".join([*out, tail])


SHOWN = b"BT /F1 12 Tf 72 720 Td (Plain \\(text\\) \\101) Tj 0 -14 Td [ (spl) -20 (it ) <776f7264> ] TJ T* (\\377\\376) Tj (last) Tj ET"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_text(packed):
    data = pdf(SHOWN, "BT (zweite Seite, für sich) Tj ET".encode(), packed=packed)
    assert pdf_pages(data) == ["Plain (text) A\nsplit word\nlast", "zweite Seite, für sich"]
    assert files.READERS["pdf"](data) == "Plain (text) A\nsplit word\nlast\nzweite Seite, für sich"


def test_pdf_faults(spark, tmp_path):
    good = pdf(SHOWN, b"BT (a) Tj ET")
    made = {"good.pdf": good, "none.pdf": b"no", "locked.pdf": pdf(SHOWN, tail=b"trailer << /Root 1 0 R /Encrypt 5 0 R >>"), "cut.PDF": good[: len(good) // 2], "broken.pdf": good.replace(b"FlateDecode", b"FlateDecodf", 1), "loop.pdf": pdf(SHOWN).replace(b"/Kids [", b"/Kids [ 2 0 R")}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "a.txt").write_text("not one")
    got = {r.path.rpartition("/")[2]: r for r in files.read_pdfs(files.crawl(spark, str(tmp_path))).collect()}
    assert set(got) == set(made)
    r = got["good.pdf"]
    assert (r.pages, r.native, r.scanned, r.skipped, r.warnings, r.error) == (2, 1, 0, 1, ["page 2 skipped"], None) and r.text.startswith("Plain")
    assert all(got[x].text is None and got[x].error for x in ("none.pdf", "locked.pdf"))
    assert got["loop.pdf"].pages == 1 and got["broken.pdf"].skipped == 2 and got["cut.PDF"].error is None
    texts = {r.path.rpartition("/")[2]: r.text for r in files.extract(files.crawl(spark, str(tmp_path))).collect()}
    assert texts["good.pdf"] == got["good.pdf"].text and texts["none.pdf"] is None


def test_page_rules_are_the_same_in_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    odd = ["", " \u2003 a\x85b \x07\n\n!!!!!!!!!!!!\n%%%%%%%%%% ab\n", "....,,,,,....,,,,a" * 3, "\x00\x01", "x" * 4, "\u3000" * 50, "été \u1680 ok"]
    rows = docs.unionByName(spark.createDataFrame([(x,) for x in odd], "text string")).filter("text is not null")
    for r in rows.select("text", T.page_clean(F.col("text")).alias("c"), T.page_plausible(F.col("text")).alias("p")).collect():
        assert T.py_page_clean(r.text) == r.c and T.py_page_plausible(r.text) == r.p


def test_strip_is_linear(spark):
    text = "a" + " " * 1_000_000 + "b" + "\u2003 " * 1000
    row = spark.createDataFrame([(text,)], "t string")
    began = time.time()
    got = row.select(F.length(T.strip(F.col("t"))), F.length(T.page_clean(F.col("t"))), F.length(T.snippet_exact(F.col("t"), "zz")), F.length(T.snippet_scaled(F.col("t"), "b zz")), V.query_error(F.col("t"))).first()
    assert tuple(got)[:2] == (1_000_002, 0) and got[4] == "query_too_long" and time.time() - began < 20


def test_users_groups_and_rules_are_judged(spark):
    def table(rows_, schema):
        return spark.createDataFrame(rows_, schema)

    groups, users, members = table([("g", 1)], "name string, rights long"), table([("ann", False, "h")], "user string, locked boolean, pw_hash string"), table([("ann", "g")], "user string, grp string")
    paths = table([("p", "a", None, True, 1)], "path_id string, prefix string, grp string, is_public boolean, rights long")
    new = table([("bob", "g", "x"), ("bob", "g", "y"), ("ann", "g", "z"), ("cy d", "g", "z"), ("dan", "none", "z")], "user string, grp string, pw_hash string")
    judged = sorted((r.user, r.pw_hash, r.error) for r in access.user_verdicts(users, new, groups).collect())
    assert judged == [("ann", "z", "already_exists"), ("bob", "x", None), ("bob", "y", "already_exists"), ("cy d", "z", "invalid_input"), ("dan", "z", "not_found")]
    after, joined = access.add_user(users, members, new, groups)
    assert {r.user for r in after.collect()} == {"ann", "bob"} and {tuple(r) for r in joined.collect()} == {("ann", "g"), ("bob", "g")}
    rules = table([("p", "b", None, True, 1), ("q", "b", "none", True, 1), ("r", "b", "g", True, 1), ("s", "", None, True, 1)], "path_id string, prefix string, grp string, is_public boolean, rights long")
    assert {r.path_id: r.error for r in access.path_verdicts(paths, rules, groups).collect()} == {"p": "already_exists", "q": "not_found", "r": None, "s": "invalid_input"}
    log = access.audit(access.user_verdicts(users, new, groups), "root", "add_user", "user", 9)
    assert [tuple(r) for r in log.collect()] == [(9, "root", "add_user", "bob", "ok")]


def test_bootstrap_only_without_users(spark):
    none = [spark.createDataFrame([], s) for s in ("user string, locked boolean, pw_hash string", "user string, grp string", "name string, rights long", "path_id string, prefix string, grp string, is_public boolean, rights long")]
    assert not access.any_user(none[0])
    users, members, groups, paths = access.bootstrap(*none, "root", "hash", "p1")
    assert [tuple(r) for r in users.collect()] == [("root", False, "hash")] and [tuple(r) for r in members.collect()] == [("root", "admins")]
    assert groups.first().rights == -(1 << 63) + 63 and tuple(paths.first()) == ("p1", "Documents", "admins", False, 7)
    again = access.bootstrap(users, members, groups, paths, "other", "hash", "p2")
    assert again[0].count() == 1 and again[3].count() == 1


def test_poll(spark):
    hits = spark.createDataFrame([("n", 1, 2, "q", "b", 0.4), ("n", 1, 1, "p", "a", 0.9), ("m", 1, 1, "p", "c", 0.8)], live.HITS)
    searches = spark.createDataFrame([("n", 1), ("n", 2)], "origin string, search_id long")
    one, two, none = (live.poll(searches, hits, "n", k).first() for k in (1, 2, 3))
    assert (one.ok, one.error, one.partial, [h.doc for h in one.hits]) == (True, "", True, ["a", "b"])
    assert (two.ok, two.hits) == (True, []) and (none.ok, none.error, none.partial, none.hits) == (False, "not_found", True, [])
    kinds = spark.createDataFrame([("hybrid", 1), ("keyword", 2), (None, 3)], "kind string, n int")
    assert [tuple(r) for r in live.merged_kind(kinds).collect()] == [(1,)]


def test_canonical(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "a")
    assert files.canonical(f"{tmp_path}/link/../a/./x") == f"{os.path.realpath(tmp_path)}/a/x" and files.canonical("bad\0path") == "bad\0path"


def test_segments_match_column(spark):
    xml = "<a>x</a><b c>two words</b>tail"
    assert spark.createDataFrame([(xml,)], "t string").select(T.markup_segments(F.col("t"))).first()[0] == files.segments(xml)


def stream(spark, tmp_path, batches, schema):
    """A stream over files, one batch each."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows_ in enumerate(batches):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").json(str(folder / f"{i}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(folder))


def drained(query):
    try:
        query.processAllAvailable()
        return query
    finally:
        query.stop()


def test_stream_dedup_equals_batch(spark, tmp_path):
    schema = "ts timestamp, kind string, payload string"
    data = [(datetime(2024, 1, 1), "a", "x"), (datetime(2024, 1, 1), "a", "x"), (datetime(2024, 1, 1), "b", "x")]
    s = live.dedup_messages(stream(spark, tmp_path, [data[:2], data[1:]], schema))
    drained(s.select("hash").writeStream.format("memory").queryName("dedup").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start())
    want = {r.hash for r in live.dedup_messages(spark.createDataFrame(data, schema)).collect()}
    got = [r.hash for r in spark.table("dedup").collect()]
    assert len(got) == 2 and set(got) == want


def test_stream_presence(spark, tmp_path):
    schema = "peer string, ts long, seq long, status string"
    data = [("p", 1, 1, "discovered"), ("p", 2, 2, "expired"), ("p", 3, 3, "discovered"), ("q", 1, 4, "expired")]
    s = live.presence(stream(spark, tmp_path, [data[:2], data[2:]], schema))
    drained(s.writeStream.format("memory").queryName("presence").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start())
    assert {tuple(r) for r in spark.table("presence").collect()} == {("p", True), ("q", False)}


def test_stream_merge(spark, tmp_path):
    schema = "origin string, search_id long, lim int, peer string, doc string, score double"
    first = [("n", 1, 2, None, None, None), ("n", 1, None, "p", "d1", 0.5), ("n", 2, None, "p", "lost", 0.9), ("m", 1, None, "p", "other", 0.9)]
    late = [("n", 1, None, "q", "d2", 0.7), ("n", 1, None, "q", "d1", 0.5)]
    s = live.merge_hits(stream(spark, tmp_path, [first, late], schema))
    # a query with processing-time timeouts never runs out of batches: wait for its rows instead
    q = s.writeStream.format("memory").queryName("merge").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    for _ in range(240):
        if spark.table("merge").filter("rank = 2").count() or not q.isActive:
            break
        time.sleep(0.25)
    q.stop()
    got = [tuple(r) for r in spark.table("merge").collect()]
    assert {r[:2] for r in got} == {("n", 1)}
    assert {("n", 1, 1, "q", "d2", 0.7), ("n", 1, 2, "p", "d1", 0.5)} <= set(got)


def test_route(spark, tmp_path):
    seen = []
    s = stream(spark, tmp_path, [[("a", "1"), ("b", "2"), ("c", "3")]], "kind string, payload string")
    q = live.route(s, {"a": lambda df, _: seen.append(("a", df.count())), "b": lambda df, _: seen.append(("b", df.count()))}, str(tmp_path / "c"))
    drained(q)
    assert sorted(seen) == [("a", 1), ("b", 1)]


def test_expiry_is_inclusive(spark):
    df = spark.createDataFrame([(9,), (10,)], "expires long")
    assert [r[0] for r in live.live(df, F.lit(10)).collect()] == [10]
    assert [r[0] for r in access.live(df, 10).collect()] == [10]
    assert pytest.approx(1) == df.filter("expires = 10").count()


def test_login(spark):
    ids = {k: k * 32 for k in "abcdef"}
    users = spark.createDataFrame([("ann", False, "h1"), ("bob", True, "h2")], "user string, locked boolean, pw_hash string")
    got = {(r.user, r.error) for r in login.begin(spark.createDataFrame([("ann", "x"), ("bob", "y"), ("who", "z"), ("a b", "w")], "user string, challenge string"), users, 100).collect()}
    assert got == {("ann", None), ("bob", "locked"), ("who", "not_found"), ("a b", "invalid_input")}
    held = [(ids["a"], "ann", 160, False), (ids["b"], "ann", 99, False), (ids["c"], "ann", 160, True), (ids["d"], "bob", 160, False)]
    challenges = spark.createDataFrame([(*h, b"n") for h in held], "challenge string, user string, expires long, used boolean, nonce binary")

    def proof(challenge, pw):
        return hashlib.sha256(hashlib.sha256(pw.encode()).digest() + b"n" + challenge.encode() + b"node").hexdigest()

    tries = [("ann", ids["a"], "00"), ("ann", ids["a"], proof(ids["a"], "h1")), ("ann", ids["a"], proof(ids["a"], "h1")), ("ann", ids["b"], ""), ("ann", ids["c"], ""), ("bob", ids["d"], ""), ("bob", ids["a"], ""), ("ann", "short", ""), ("ann", ids["f"], "")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(tries)], "attempt int, user string, challenge string, proof string")
    out = rows(login.finish(df, challenges, users, "node", 100).select("attempt", "verdict", "session_expires"), "attempt")
    assert [r[1] for r in out] == ["unauthorized", "ok", "unauthorized", "expired", "unauthorized", "locked", "unauthorized", "invalid_input", "not_found"]
    assert out[1][2] == 1000 and len(spark.range(1).select(login.new_id()).first()[0]) == 32


def test_pdf_path(tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"")
    (tmp_path / "a.txt").write_bytes(b"")
    assert files.pdf_path_error(str(tmp_path / "a.PDF")) is None
    assert [files.pdf_path_error(str(tmp_path / x)) for x in ("", "a.txt", "none.pdf")] == ["folder", "suffix", "missing"]


def test_every(spark, tmp_path):
    done = []
    q = live.every(spark, 1, lambda: done.append(1), str(tmp_path / "c"))
    for _ in range(120):
        if len(done) > 1 or not q.isActive:
            break
        time.sleep(0.25)
    q.stop()
    assert len(done) > 1
