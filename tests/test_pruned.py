"""Prefix sweeps and pruned cosine against plain versions, and files that break their readers."""

import io
import random
import time
import zipfile

import numpy as np
import pytest

from larkspur.operators import balls, intervals, search
from larkspur.sources import files
from larkspur.sources.pdf import BrokenPdf, pdf_pages


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_longest_prefix(spark, parts):
    rnd = random.Random(parts)
    word = lambda n: "".join(rnd.choice("ab/é") for _ in range(n))
    rules = [(f"p{k:03}", word(rnd.randint(0, 7)), k) for k in range(60)] + [("p999", None, 1)] + ([("p0", "", 5)] if parts == 7 else [])
    asked = [(k, word(rnd.randint(0, 14))) for k in range(400)] + [(400 + k, "abab/é" * 3) for k in range(300)] + [(900, None), (901, "")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = intervals.longest_prefix(spark.createDataFrame(asked, "n int, path string"), spark.createDataFrame(rules, "path_id string, prefix string, rights int"))
        rows = {r.n: (r.rule_path_id, r.rule_prefix, r.rule_rights) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == len(asked)
    for n, path in asked:
        fits = [r for r in rules if path is not None and r[1] is not None and path.startswith(r[1])]
        best = min(fits, key=lambda r: (-len(r[1]), r[0]), default=None)
        assert rows[n] == ((best[0], best[1], best[2]) if best else (None, None, None)), path
    empty = intervals.longest_prefix(spark.createDataFrame(asked, "n int, path string"), spark.createDataFrame([], "path_id string, prefix string"))
    assert empty.filter("rule_path_id is not null").count() == 0


def test_pruned_cosine(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.15
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, [0.0] * 16), (5001, None), (5002, [1.0, 2.0]), (5003, [float("nan")] * 16), (5004, x[3].tolist()), (5005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    balls.build(df, f"{tmp_path}/b")
    for q in (x[3], x[700], rng.normal(size=16), np.zeros(16), np.array([1.0, 2.0])):
        hits, report = balls.topk(spark, f"{tmp_path}/b", q.tolist(), 8)
        assert [tuple(r) for r in hits.collect()] == [tuple(r) for r in search.cosine_topk(df, q.tolist(), 8).collect()]
        assert report.vectors == len(rows)
    assert balls.topk(spark, f"{tmp_path}/b", x[3].tolist(), 8)[1].read < len(rows) / 3
    balls.build(df.limit(0), f"{tmp_path}/none")
    assert balls.topk(spark, f"{tmp_path}/none", [1.0], 3)[0].collect() == []


def archive(method=zipfile.ZIP_DEFLATED, **members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("DOT", "."), text)
    return out.getvalue()


def test_no_file_ends_a_job(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><c t="s"><v>9</v></c></worksheet>'
    locked, odd = (bytearray(archive(word__documentDOTxml="<a>x</a>")) for _ in range(2))
    for data, field, value in ((locked, 6, 1), (odd, 8, 99)):  # the flag of an encrypted member; a compression that isn't known
        data[field] = value
        central = data.index(b"PK\x01\x02")
        data[central + field + 2] = value
    huge = b"%PDF-1.4\n1 0 obj << /Length " + b"9" * 400 + b" >> stream\nx\nendstream endobj trailer << /Root 1 0 R >>"
    packed = b"%PDF-1.4\n1 0 obj << /Type /ObjStm /First 4 /N " + b"9" * 400 + b" /Length 1 >> stream\nx\nendstream endobj trailer << /Root 1 0 R >>"
    made = {"wide.csv": b"a," + b"x" * 200_000, "index.xlsx": archive(xl__worksheets__sheet1DOTxml=sheet), "locked.docx": bytes(locked), "odd.docx": bytes(odd), "huge.pdf": huge, "packed.pdf": packed, "good.txt": b"fine"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: r for r in files.extract(files.crawl(spark, str(tmp_path))).collect()}
    assert len(got["wide.csv"].text) == 200_003 and got["good.txt"].text == "fine"
    assert all(got[x].text is None and got[x].error for x in ("index.xlsx", "locked.docx", "odd.docx"))
    assert len(files.read_pdfs(files.crawl(spark, str(tmp_path))).collect()) == 2


def test_open_strings_take_linear_time():
    began = time.time()
    with pytest.raises(BrokenPdf):
        pdf_pages(b"%PDF-1.4\n" + b"1 0 obj (" * 30_000)
    assert time.time() - began < 20


def test_inflated_bytes_are_bounded(monkeypatch):
    monkeypatch.setattr(files, "INFLATED", 1000)
    with pytest.raises(ValueError, match="more than"):
        files.docx(archive(word__documentDOTxml="x" * 2000))
