"""Hand-worked cases of text, validation and vector functions, on either side of each threshold."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import validate as V
from larkspur.functions import vector as X
from larkspur.operators.bm25 import _py_ngrams


def one(spark, build, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("t"))).collect()]


def test_normalize_is_ascii(spark):
    assert one(spark, T.normalize, "", "Über-Maß 12", "A  b\n\nC!", "ÄÖ") == ["", "ber ma 12", "a b c", ""]


def test_normalize_head_stops(spark):
    assert [len(x) for x in one(spark, T.normalize_head, "a" * 32_001, "a" * 31_999)] == [32_000, 31_999]


def test_query_tokens_need_two_characters(spark):
    assert one(spark, T.query_tokens, "a bc d ef", "") == [["bc", "ef"], []]


@pytest.mark.parametrize(("n", "size"), [(2, 3), (3, 3), (6, 6), (9, 6)])
def test_ngram_size_is_clamped(n, size):
    assert T.ngram_size(n) == size


def test_char_ngrams(spark):
    assert one(spark, T.char_ngrams, "a", "ab", "abc", "abcd", "A é") == [["_a_"], ["_ab_"], ["_abc_"], ["_abcd", "abcd_"], ["_a_"]]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=40))
def test_ngrams_of_query_and_document_agree(spark, s):
    assert one(spark, T.char_ngrams, s)[0] == _py_ngrams(s, 5)
    assert one(spark, lambda c: T.normalize(T.normalize(c)), s) == one(spark, T.normalize, s)


def test_keyword_tokens(spark):
    assert one(spark, T.keyword_tokens, "Größe, a-b " + "x" * 39 + " " + "y" * 40) == [["größe", "a", "b", "x" * 39]]


def test_gibberish_thresholds(spark):
    lines = ["", "!!!!!!!!!", "ab!!!!!!!!", "a!!!!!!!!!", "abc!!!!!!!", "ab d!!!!!!!!", "a" * 30 + "!" * 11, "a" * 30 + "!" * 12, "plain words"]
    assert one(spark, T.is_gibberish, *lines) == [True, False, True, True, False, False, False, True, False]


def test_page_plausible_thresholds(spark):
    pages = ["", "   ", "abcd", "abcde", "a" * 5 + "-" * 34, "a" * 5 + "-" * 35, "a" * 6 + "-" * 34]
    assert one(spark, T.page_plausible, *pages) == [False, False, False, True, True, False, True]


def test_page_clean(spark):
    assert one(spark, T.page_clean, "  a\x01 b \n\n!!!!!!!!!!!!\n c\t d") == ["a b\nc d"]


def test_markup_keeps_names_and_drops_phrases(spark):
    xml = "<w:p>one</w:p><w:p>two words</w:p>"
    assert one(spark, T.markup_segments, xml) == [" w:p one  w:p  "]
    assert one(spark, T.strip_markup, xml) == ["one two words"]


def test_snippets(spark):
    long = "x " * 300 + "needle " + "y " * 300
    scaled, = one(spark, lambda c: T.snippet_scaled(c, "needle"), long)
    assert "needle" in scaled and len(scaled) <= 320
    exact = one(spark, lambda c: T.snippet_exact(c, " NEEDLE "), long, "no match here", "  ", "needle at start")
    assert exact[0].index("needle") == 160 and exact[1:] == ["no match here", "", "needle at start"]
    assert one(spark, lambda c: T.snippet_exact(c, "b"), "a\n b") == ["a\n b"]
    assert one(spark, lambda c: T.snippet_scaled(c, "bb"), "a\n bb") == ["a bb"]


def test_validation(spark):
    assert one(spark, V.query_error, " ", "x" * 4096, "x" * 4097, "a\u0085b", "ok\n") == ["empty_query", None, "query_too_long", "query_has_control_chars", None]
    assert one(spark, V.name_valid, "a.b-c_1", "", "x" * 65, " padded ", "a b") == [True, False, False, True, False]
    assert one(spark, V.ascii_valid, "a", "", "a\n", "é") == [True, False, False, False]
    assert one(spark, V.base_name, "a/b.txt", "..", "a/", "/") == ["b.txt", "file.bin", "a", "file.bin"]
    assert one(spark, V.rights_parse, "admin", "0xFF", "18446744073709551615", "-1", " read ") == [-(1 << 63), 255, -1, None, 1]
    assert one(spark, V.bool_parse, "0", "1", "2") == [False, True, None]
    assert one(spark, V.hex32_parse, "0" * 64, "0" * 63) == [bytearray(32), None]
    df = spark.createDataFrame([(None,), (0,), (50,), (51,)], "x int")
    assert [r[0] for r in df.select(V.limit_clamp(F.col("x"))).collect()] == [10, 1, 50, 50]


def test_cosine(spark):
    cases = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0, 2.0, 2.0], [1.0], 1 / 3), ([float("nan")], [1.0], 0.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(X.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([c for _, _, c in cases])


def test_page_rules_hold_no_character_by_itself():
    import tracemalloc

    page = "words," * 200_000
    assert T.py_page_clean("warm up 1") == "warm up 1" and T.py_page_plausible("warm up 1")
    tracemalloc.start()
    assert T.py_page_plausible(page) and T.py_page_clean(page) == page.strip()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(page)
