import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.diff import lines_of, script, unified

WORDS = ["ações", "NAÇÕES", "leões", "jornais", "papéis", "lençóis", "azuis", "flores", "casas", "pass", "lápis", "mês", "as", "Ünïcode", "ЁЛКА", "한국", "İstanbul", "ﬁn", "x1", "ＦＵＬＬ", "école", ""]


def test_columns_agree_with_python(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    got = df.select("w", T.fold(F.col("w")).alias("f"), T.reduced(T.fold(F.col("w"))).alias("r"), T.slug(F.col("w")).alias("s")).collect()
    for row in got:
        assert row.f == T.plain(row.w), row.w
        assert row.r == T.reduce_word(row.f), row.w
        assert row.s == T.slug_of(row.w), row.w


@pytest.mark.parametrize("word, short", [("acoes", "acao"), ("leoes", "leao"), ("jornais", "jornal"), ("papeis", "papel"), ("azuis", "azul"), ("flores", "flor"), ("casas", "casa"), ("pass", ""), ("lapis", ""), ("mes", ""), ("casa", "")])
def test_endings(word, short):
    assert T.reduce_word(word) == short


def test_tokens(spark):
    text = "Olá, mundo_novo! 12x é ½ №7"
    got = spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t"))).first()[0]
    assert got == regex.findall(T.TOKEN, text) == ["Olá", "mundo", "novo", "12x", "e", "7"]


@pytest.mark.parametrize("pattern, path, fits", [("*.md", "a.md", True), ("*.md", "x/a.md", False), ("x/?.md", "x/a.md", True), ("[a-c]*", "bz", True), ("[^a-c]*", "bz", False), ("[", "[", False), ("a\\*", "a*", True), ("a\\*", "ab", False), ("[z-a]", "m", False), ("", "", True), ("a[]", "a", False)])
def test_glob(spark, pattern, path, fits):
    assert spark.createDataFrame([(path,)], "p string").select(T.glob(F.col("p"), pattern)).first()[0] is fits


def test_percent():
    assert T.percent_decoded("a%20b%C3%A9%zz%4") == "a bé%zz%4"
    assert T.path_uri("x y/é.md") == "note:///x%20y/%C3%A9.md"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_script_is_right_and_shortest(a, b):
    edits = script(a, b)
    assert [s for op, s in edits if op != "+"] == a and [s for op, s in edits if op != "-"] == b
    cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] if a[i - 1] == b[j - 1] else 99)
    assert sum(op != " " for op, _ in edits) == cost[-1][-1]


def test_unified():
    assert lines_of("a\r\nb\rc\n") == ["a", "b", "c"]
    assert unified("x", "y", "a\n", "a\r\n") == ""
    old = "".join(f"{i}\n" for i in range(20))
    new = old.replace("3\n", "three\n", 1).replace("17\n", "")
    assert unified("x", "y", old, new) == "--- x\n+++ y\n@@ -1,7 +1,7 @@\n 0\n 1\n 2\n-3\n+three\n 4\n 5\n 6\n@@ -15,6 +15,5 @@\n 14\n 15\n 16\n-17\n 18\n 19\n"
    assert unified("x", "y", "", "a") == "--- x\n+++ y\n@@ -1,0 +1,1 @@\n+a\n"
