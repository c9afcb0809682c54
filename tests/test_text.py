"""Scalar text functions, on the hand-made fixtures of FIXTURES.md part C and dialect traps."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as t
from loomtext.functions.porter import stem


def one(spark, value, make, lang=None):
    df = spark.createDataFrame([(value, lang)], "x string, lang string")
    return df.select(make(F.col("x"), F.col("lang")).alias("y")).first()["y"]


LUA = "-- Adds two numbers together.\nlocal function add(a,b)\n  return a+b\nend"


@pytest.mark.parametrize(
    "code,lang,comment",
    [
        (LUA, "lua", "-- Adds two numbers together.\n"),
        ("-- a\nfunction f() end\n-- longer one\n-- here\nlocal function g() end", "lua", "-- longer one\n-- here\n"),
        ("-- ab\nfunction f() end\n-- cd\nfunction g() end", "lua", "-- ab\n"),
        ('"""Doc\nstring"""\nfunction f() end', "julia", "Doc\nstring"), ('"short"\nf(x)=x', "julia", "short"), ("f(x)=x", "julia", None),
        ("(** Doc *) let f x = x", "ocaml", " Doc "), ("#' Doc\nf <- function(x) x", "r", "#' Doc\n"), (";; doc\n(define (f x) x)", "racket", ";; doc\n"), ("  ", "lua", None), ("x", "go", None),
    ],
)
def test_raw_comment(spark, code, lang, comment):
    assert one(spark, code, t.raw_comment, lang) == comment


@pytest.mark.parametrize(
    "raw,lang,summary",
    [
        ("-- Adds two numbers together.\n", "lua", "Adds two numbers together."), ("Returns the sum of both inputs.", "lua", None),
        ("Released under GPL version three", "r", "Released under GPL version three"), ("Computes it well. Args: x", "r", "Computes it well."),
        (":type x of things", "r", None), ("does a TODO thing here", "r", None), ("two words", "r", None), ("a b c", "r", None),
        ("#' Makes a plot\n#' of :class name: data.", "r", "Makes a plot of data."), ("Compute :returns x things now", "r", None), (None, "r", None),
    ],
)
def test_clean_summary(spark, raw, lang, summary):
    assert one(spark, raw, t.clean_summary, lang) == summary


@pytest.mark.parametrize("text,first", [("One. Two.", "One."), ("no end\nhere", "no end"), ("\n\n Joined\nline! x", "Joined line!"), (" \n", None), (None, None), ("v1.2 is out? yes", "v1.2 is out?"), (".", ".")])
def test_first_sentence(spark, text, first):
    assert one(spark, text, lambda x, _: t.first_sentence(x)) == first


@pytest.mark.parametrize("lang,code,bare", [("lua", LUA, "local function add(a,b)\n  return a+b\nend"), ("julia", '"""d"""\n\nf(x)=x', "f(x)=x"), ("ocaml", "(** a *)let x = 1 (** b *)", "let x = 1 "), ("racket", "  ;; a\n(f)", "(f)"), ("lua", " ", None)])
def test_code_only(spark, lang, code, bare):
    assert one(spark, code, t.code_only, lang) == bare


def test_extraction(spark):
    fwd, back = lambda x, _: t.extract_code(x), lambda x, _: t.extract_code(x, forward=False)
    assert one(spark, "a <python>\n```python\nx=1\n```\n</PYTHON> b", fwd) == "x=1"
    assert one(spark, "say ```python\ny=2\n``` end", fwd) == "y=2"
    assert one(spark, "z=3\nNote: this", fwd) == "z=3"
    assert one(spark, "<CODE>```lua\nf()\n```</CODE>", back) == "f()"
    loose = lambda x, _: t.extract_code_permissive(x)
    assert one(spark, "```ocaml\nlet x = 1", loose) == "let x = 1"
    assert one(spark, "here it is: define foo bar", loose) == "define foo bar"
    assert one(spark, "Code:\nx + y\n# no", loose) == "x + y"
    assert one(spark, "# only", loose) == "# only"
    assert one(spark, "a <SUMMARY> b <SUMMARY>\n# c </SUMMARY>", lambda x, _: t.summary_tail(x)) == " c"


def test_tokens(spark):
    assert one(spark, "It's 3.5, ok-no", lambda x, _: t.nist_tokens(x)) == ["it's", "3.5", ",", "ok-no"]
    assert one(spark, "a &lt;b&gt; x.", lambda x, _: t.nist_tokens(x)) == ["a", "<", "b", ">", "x", "."]
    assert one(spark, "äb-c_d!", lambda x, _: t.punct_split(x)) == "äb - c_d !"
    assert one(spark, " a\xa0b\x1cc ", lambda x, _: t.words(x)) == ["a", "b", "c"]
    assert one(spark, "ÄB c1", lambda x, _: t.alnum(x)) == "bc1"
    assert one(spark, None, lambda x, _: t.alnum(x)) == ""
    assert one(spark, "the Foo_1 1x foo_1", lambda x, _: t.identifiers(x)) == ["the", "foo_1", "foo_1"]


def test_ratios(spark):
    df = spark.createDataFrame([("add a b", "function add(a, b)"), ("adds things up", "function add(a, b)"), ("!!", "function f( )"), ("the of", "x")], "s string, c string")
    rows = df.select(t.identifier_ratio(F.col("s"), F.col("c"), F.lit("lua")).alias("r"), t.token_overlap(F.col("s"), F.col("c")).alias("o"), t.has_blank_parameter(F.col("c")).alias("b")).collect()
    assert [r.r for r in rows] == [1.0, 0.0, None, 0.0] and [r.o for r in rows] == [1.0, 0.0, 0.0, 0.0] and [r.b for r in rows] == [False, False, True, False]


def test_docstrings_and_folding(spark):
    df = spark.createDataFrame([('def f():\n    """Doc."""\n    return 1  # Doc.', "Doc.")], "c string, d string")
    assert df.select(t.strip_docstrings(F.col("c"), F.col("d"))).first()[0] == "def f():\n\n    return 1  #"
    comment, code = t.fold_comments(F.col("c"))
    assert tuple(spark.createDataFrame([(" # a\nx = 1\n#b",)], "c string").select(comment, code).first()) == ("a b", "x = 1")
    assert tuple(spark.createDataFrame([("x",)], "c string").select(comment, code).first()) == (None, "x")


def test_join_tokens_and_tags(spark):
    df = spark.createDataFrame([(["Adds", "x", "."], "/m/deepseek-coder-6.7b-instruct/"), (None, "/m/other/")], "w array<string>, p string")
    rows = df.select(t.join_tokens(F.col("w")).alias("a"), t.join_tokens(F.col("w"), False).alias("b"), t.model_tag(F.col("p")).alias("x"), t.model_tag(F.col("p"), True).alias("y")).collect()
    assert tuple(rows[0]) == ("Adds x.", "Adds x .", "ds_mid3th", "ds_mid3th") and rows[1].x == "other"


@pytest.mark.parametrize("word,root", [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopeful", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("sky", "sky")])
def test_porter(word, root):
    assert stem(word) == root
