"""Text functions as Column builders: all of them stay inside the JVM's generated code.

Character classes are spelt out, so that every engine that is given the same pattern reads it the
same way.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths, weights and classes that results depend on.
SCAN_CHARS = 32_000
SNIPPET_CHARS = 320
DOC_CHARS = 2_000_000
NGRAM_DEFAULT, NGRAM_MIN, NGRAM_MAX = 5, 3, 6
TOKEN_BYTES = 40
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CONTROL = r"[\x{0}-\x{1f}\x{7f}-\x{9f}]"
CONTROL_BUT_TAB_AND_LINE = r"[\x{0}-\x{8}\x{b}-\x{1f}\x{7f}-\x{9f}]"
ALNUM = r"[\p{L}\p{N}]"
SYMBOL = r"[!-/:-@\[-\x{60}{-~]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(s: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(s, UPPER, LOWER)


def strip(s: Column) -> Column:
    """Without white space at either end, in time that grows with the text: an anchored pattern would try each inner run."""
    return F.trim(s, F.lit(SPACES))


def collapse(s: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, f"{SPACE}+", " "))


def normalize(s: Column) -> Column:
    """ASCII letters and digits in lower case; all else is one space between, so that 'über' is 'ber'."""
    return F.trim(F.regexp_replace(ascii_lower(s), "[^a-z0-9]+", " "))


def normalize_head(s: Column) -> Column:
    """The first 32,000 characters, normalised."""
    return normalize(F.left(s, F.lit(SCAN_CHARS)))


def words(s: Column) -> Column:
    """Words of a normalised string; none for an empty one."""
    return F.filter(F.split(s, " "), lambda w: w != "")


def query_tokens(s: Column) -> Column:
    """Words of two characters or more."""
    return F.filter(F.split(normalize_head(s), " "), lambda w: F.length(w) >= 2)


def keyword_tokens(s: Column) -> Column:
    """Runs of letters and digits under 40 bytes, in lower case."""
    kept = F.filter(F.split(s, r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) < TOKEN_BYTES))
    return F.transform(kept, lambda t: F.lower(t))


def ngram_size(n: int) -> int:
    return min(max(n, NGRAM_MIN), NGRAM_MAX)


def char_ngrams(s: Column, n: int = NGRAM_DEFAULT, boundary: str = "_") -> Column:
    """Character n-grams of each normalised word between boundary marks; a shorter word stays whole."""
    n = ngram_size(n)

    def grams(word: Column) -> Column:
        w = F.concat(F.lit(boundary), word, F.lit(boundary))
        many = F.length(w) - n + 1
        return F.when(many < 1, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.substring(w, i, F.lit(n))))

    return F.flatten(F.transform(words(normalize(s)), grams))


def truncate(s: Column, n: int) -> Column:
    return F.left(s, F.lit(n)) if n > 0 else F.lit("")


def trim_truncate(s: Column, n: int) -> Column:
    """At most ``n`` characters of what is left without white space at the ends."""
    return truncate(strip(s), n)


def score_text(score: Column, decimals: int) -> Column:
    """A score as it is shown."""
    return F.format_string(f"%.{decimals}f", score.cast("double"))


def head(s: Column) -> Column:
    return F.left(s, F.lit(SNIPPET_CHARS))


def snippet_scaled(text: Column, query: str) -> Column:
    """320 characters around the earliest query token, placed by scaling from normalised text; white space collapsed.

    Without a token, or where none occurs, the text's first 320 characters as they are.
    """
    tokens = sorted({w for w in _py_normalize(query[:SCAN_CHARS]).split() if len(w) >= 2})
    t, norm = strip(text), normalize_head(strip(text))
    if not tokens:
        return head(t)
    places = F.filter(F.array(*[F.locate(w, norm) for w in tokens]), lambda p: p > 0)
    at = F.floor((F.array_min(places) - 1) * (F.greatest(F.length(t), F.lit(1)) / F.greatest(F.length(norm), F.lit(1))))
    start = F.greatest(at - SNIPPET_CHARS // 2, F.lit(0)).cast("int")
    return F.when(F.size(places) == 0, head(t)).otherwise(collapse(F.substring(t, start + 1, F.lit(SNIPPET_CHARS))))


def _py_normalize(s: str) -> str:
    lowered = s.translate(str.maketrans(UPPER, LOWER))
    return " ".join("".join(c if c in LOWER or c in "0123456789" else " " for c in lowered).split())


def snippet_exact(text: Column, query: str) -> Column:
    """320 characters from 160 before the whole query (A-Z in either case), or the first 320; white space stays."""
    t = strip(text)
    q = query.strip().translate(str.maketrans(UPPER, LOWER))
    if not q:
        return head(t)
    at = F.instr(ascii_lower(t), q)
    start = F.greatest(at - 1 - SNIPPET_CHARS // 2, F.lit(0))
    return F.when(at > 0, F.substring(t, start + 1, F.lit(SNIPPET_CHARS))).otherwise(head(t))


def markup_segments(xml: Column) -> Column:
    """What stands between angle brackets and holds no space, closing tags left out, a space after each."""
    parts = F.filter(F.split(xml, "[<>]"), lambda x: ~F.startswith(x, F.lit("/")) & (F.instr(x, " ") == 0))
    return F.array_join(F.transform(parts, lambda x: F.concat(x, F.lit(" "))), "")


def strip_markup(xml: Column) -> Column:
    """Text outside tags, white space collapsed: what `markup_segments` was meant to give."""
    return collapse(F.regexp_replace(xml, "<[^>]*>", " "))


def strip_control(s: Column) -> Column:
    return F.regexp_replace(s, CONTROL_BUT_TAB_AND_LINE, "")


def flatten_lines(s: Column) -> Column:
    """One line: breaks are spaces, none at the ends."""
    return strip(F.translate(s, "\r\n", "  "))


def is_gibberish(line: Column) -> Column:
    """Symbol soup: few letters and digits, or many symbols, or 12 symbols in a row, or nothing printable."""
    bare = F.regexp_replace(line, CONTROL, "")
    n = F.length(bare)
    letters, symbols = F.regexp_count(bare, F.lit(ALNUM)), F.regexp_count(bare, F.lit(SYMBOL))
    return (n == 0) | ((n >= 10) & ((letters / n < 0.20) | (symbols / n > 0.70))) | bare.rlike(f"{SYMBOL}{{12}}")


def page_lines(s: Column) -> Column:
    """Trimmed non-blank lines."""
    return F.filter(F.transform(F.split(strip_control(s), "\n"), strip), lambda x: x != "")


def page_clean(s: Column) -> Column:
    """Control characters and gibberish lines go, white space collapses."""
    return F.array_join(F.transform(F.filter(page_lines(s), lambda x: ~is_gibberish(x)), collapse), "\n")


def py_page_clean(s: str) -> str:
    """``page_clean`` where a page is at hand in Python; tested to be equal."""
    control, control_but, symbols, _, spaces = _patterns()

    def gibberish(line: str) -> bool:
        bare = control.sub("", line)
        n, marks = len(bare), _symbols(bare)
        few = n >= 10 and (marks / n > 0.70 or _alnums(bare) / n < 0.20)
        return n == 0 or few or (marks >= 12 and bool(symbols.search(bare)))

    lines = [x.strip(SPACES) for x in control_but.sub("", s).split("\n")]
    return "\n".join(spaces.sub(" ", x).strip(" ") for x in lines if x and not gibberish(x))


def py_page_plausible(s: str) -> bool:
    """``page_plausible`` in Python."""
    n = len(bare := _patterns()[0].sub("", s))
    return bool(s.strip(SPACES)) and len(s) >= 5 and n > 0 and not (n >= 40 and _alnums(bare) / n < 0.15)


@functools.cache
def _patterns() -> tuple:
    import regex

    return tuple(regex.compile(p) for p in (_py(CONTROL), _py(CONTROL_BUT_TAB_AND_LINE), _py(SYMBOL) + "{12}", f"{ALNUM}+", f"[{SPACES}]+"))


_ALNUM_BYTES = (UPPER + LOWER + "0123456789").encode()
_SYMBOL_BYTES = bytes(c for c in range(33, 127) if c not in _ALNUM_BYTES)


def _symbols(s: str) -> int:
    raw = s.encode("utf-8", "surrogatepass")  # symbols are ASCII, whose bytes stand for nothing else
    return len(raw) - len(raw.translate(None, _SYMBOL_BYTES))


def _alnums(s: str) -> int:
    """Letters and digits, counted without a list of them."""
    if s.isascii():
        raw = s.encode()
        return len(raw) - len(raw.translate(None, _ALNUM_BYTES))
    return sum(m.end() - m.start() for m in _patterns()[3].finditer(s))


def _py(pattern: str) -> str:
    r"""A class of characters with its ``\x{..}`` as Python writes them."""
    import re

    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: rf"\U{int(m[1], 16):08x}", pattern)


def page_plausible(s: Column) -> Column:
    """Whether a page's text looks extracted rather than scanned."""
    bare = F.regexp_replace(s, CONTROL, "")
    n = F.length(bare)
    return (strip(s) != "") & (F.length(s) >= 5) & (n > 0) & ~((n >= 40) & (F.regexp_count(bare, F.lit(ALNUM)) / n < 0.15))
