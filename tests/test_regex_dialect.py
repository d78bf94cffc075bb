"""Each regex of the answer chain: Python ``re`` semantics vs the Java form
Spark runs, on random text with Unicode digits/letters, odd spaces and
newlines (the flags (?U) and (?d) are what make them agree)."""
import random
import re
import unicodedata

from pyspark.sql import functions as F

from boxwise.functions.answers import SLASH, sql_str

# Fixed values: (Python pattern, Python replacement, Java pattern, Java replacement)
PATTERNS = [
    (r'([\\\w]*)/([\\\w]*)', r'\\frac{\1}{\2}', SLASH, r'\\frac{$1}{$2}'),
    (r'(?<!\.)\.$', '', r'(?d)(?<!\.)\.$', ''),
    (r'(\\text\{\()(.*?)(\)\})', '\\2', r'(?d)(\\text\{\()(.*?)(\)\})', '$2'),
    (r'(\\text\{)(.*?)(\})', '\\2', r'(?d)(\\text\{)(.*?)(\})', '$2'),
    (r'(\\boxed\{)(.*)(\})', '\\2', r'(?d)(\\boxed\{)(.*)(\})', '$2'),
    (r'(frac)([^{])(\d)', 'frac{\\2}{\\3}', r'(?U)(frac)([^{])(\d)', 'frac{$2}{$3}'),
    (r'(sqrt)([^{])', 'sqrt{\\2}', r'(sqrt)([^{])', 'sqrt{$2}'),
    (r'frac{(\d+)}(\d+)', r'frac{\1}{\2}', r'(?U)frac\{(\d+)\}(\d+)', 'frac{$1}{$2}'),
    (r'frac(\d+){(\d+)}', r'frac{\1}{\2}', r'(?U)frac(\d+)\{(\d+)\}', 'frac{$1}{$2}'),
]
ALPHABET = ["1", "2", "\u00b2", "\u00bd", "e\u0301", "\u2167", "٣", "x", "é", "_", "\\", "/", "{", "}", "(", ")", ".", "\n", " ", "\u00a0", "$",
            "frac", "sqrt", "\\text{", "\\boxed{", "\\text{(", ")}"]


def test_patterns_agree(spark):
    rnd = random.Random(5)
    vals = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 12))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(vals)), "i int, s string")
    cols = [F.expr(f"regexp_replace(s, {sql_str(jp)}, {sql_str(jr)})").alias(f"p{k}")
            for k, (_, _, jp, jr) in enumerate(PATTERNS)]
    nums = F.expr(f"regexp_extract_all(s, {sql_str(r'(?U)-?\d*\.?\d+')}, 0)").alias("nums")
    got = {r.i: r for r in df.select("i", *cols, nums).collect()}
    for i, v in enumerate(vals):
        for k, (pp, pr, _, _) in enumerate(PATTERNS):
            assert got[i][f"p{k}"] == re.sub(pp, pr, v), (k, v)
        assert got[i].nums == re.findall(r'-?\d*\.?\d+', v), v


def test_word_characters_are_pythons(spark):
    """Every code point: Spark's class against Python's \\w."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, chr(c)) for c in points if unicodedata.category(chr(c)) != "Cn"], "c int, s string")
    cls = SLASH[1:SLASH.index("]") + 1]
    got = {r.c for r in df.where(F.expr(f"s RLIKE {sql_str('^' + cls + '$')}")).collect()}
    old = {c for c in points if unicodedata.category(chr(c)) != "Cn" and re.fullmatch(r"[\\\w]", chr(c))}
    # characters newer than the JVM's tables are unknown to it
    assert got <= old and all(unicodedata.category(chr(c))[0] in "LN" and c > 0x250 for c in old - got)
