"""Golden cases and brute-force checks of the expressions."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import masking as M
from gridloom.functions import spans as S
from gridloom.functions import tables as T
from gridloom.functions import text as X
from gridloom.functions import tokens as K
from gridloom.functions import values as V
from gridloom.operators import collation, encoding, scoring, truncation


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


def table(spark, header, rows, column):
    return one(spark, f"t {T.TABLE}", ((header, rows),), column)


def test_linearize(spark):
    t = (["year", "city"], [["1896", "athens"], ["1900", "paris"]])
    assert table(spark, *t, T.linearize(F.col("t"))) == "col : year | city row 1 : 1896 | athens row 2 : 1900 | paris"
    offsets = [(o.row, o.cell, o.s, o.e) for o in table(spark, *t, T.cell_offsets(F.col("t")))]
    assert offsets == [(-1, 0, 6, 10), (-1, 1, 13, 17), (0, 0, 26, 30), (0, 1, 33, 39), (1, 0, 48, 52), (1, 1, 55, 60)]
    assert table(spark, ["year", "city"], [], T.linearize(F.col("t"))) == "col : year | city "
    assert table(spark, [], [["a"]], T.linearize(F.col("t"))) == "row 1 : a"
    assert table(spark, ["a"], [[None], None], T.linearize(F.col("t"))) == "col : a row 1 : None row 2 : "
    assert one(spark, f"t {T.TABLE}", (None,), T.linearize(F.col("t"))) is None


def test_offsets_give_the_cells_back(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("ab é中😀|") for _ in range(r.randint(0, 6)))
    rows = [((([word() for _ in range(r.randint(0, 4))]), [[word() for _ in range(r.randint(0, 4))] for _ in range(r.randint(0, 5))]),) for _ in range(60)]
    for row in spark.createDataFrame(rows, f"t {T.TABLE}").select("t", T.linearize(F.col("t")).alias("flat"), T.cell_offsets(F.col("t")).alias("o")).collect():
        cells = [(-1, i, c) for i, c in enumerate(row.t.header)] + [(k, i, c) for k, cs in enumerate(row.t.rows) for i, c in enumerate(cs)]
        assert [(o.row, o.cell, row.flat[o.s : o.e]) for o in row.o] == cells


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("Café", "cafe"), ("a – b", "a - b"), ('"x"', "x"), ("a (b) (c)", "a"), ("(foo)", "(foo)"), ("Foo. [1]", "foo"), ("Foo (bar)[1].", "foo (bar)[1]"), ("[1]", ""), ("[a]", "[a]"), ("C#", "c"), ("C++", "c"), ("5*", "5"), ("a´b", "a b"), ("", ""), ("ﬁ①", "fi1")],
)
def test_normalize(given, wanted):
    assert V.normalize_text(given) == wanted


NUMBERS = {"5": 5, " +5 ": 5, "5.0": 5, "5e0": 5, "1_000": 1000, "1,000": None, "nan": None, "inf": None, "2.9999999": 2, "2.0000001": 2, "-2.9999999": -2, "12d": None, "0x1p3": None, "1__0": None, ".5": 0.5, "5.": 5, "١٢": 12, "　７ ": 7, "1e999": None, "": None, ".": None, "-0": 0}


def test_parse_number(spark):
    df = spark.createDataFrame([(k,) for k in NUMBERS] + [(None,)], "s string").select("s", V.parse_number(F.col("s")).alias("x"))
    assert {r.s: r.x for r in df.collect()} == NUMBERS | {None: None}


BIG = {"126e65": 1.26e67, "-1e81": -1e81, "1e24": 1e24, "9223372036854775808": 2.0**63, "9007199254740993": 2.0**53, "9007199254740991": 2.0**53 - 1, "4503599627370495.5": 4503599627370495.5}


def test_parse_big_numbers(spark):
    df = spark.createDataFrame([(k,) for k in BIG], "s string").select("s", V.parse_number(F.col("s")).alias("x"))
    assert {r.s: r.x for r in df.collect()} == BIG


def test_normalize_null_characters(spark):
    texts = ["5", "5\0", "5\0a", "\0"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1).select("s", V.normalize(F.col("s")).alias("x"))
    assert {r.s: r.x for r in df.collect()} == {t: t for t in texts}


def test_numbers_as_python_reads_them(spark):
    r = random.Random(2)
    texts = list({"".join(r.choice("0123_.eE+- \xa0x") for _ in range(r.randint(1, 6))) for _ in range(3000)})

    def python(s):
        try:
            return float(s)
        except ValueError:
            return None

    got = {x.s: x.v for x in spark.createDataFrame([(t,) for t in texts], "s string").select("s", V.read_float(F.col("s")).alias("v")).collect()}
    assert got == {t: python(t) for t in texts}


def test_parse_date_and_value(spark):
    cases = {"2008-xx-xx": ("number", 2008.0, None), "xx-01-02": ("date", None, (-1, 1, 2)), "2001-02-31": ("date", None, (2001, 2, 31)), "xx-xx-xx": ("string", None, None), "2001-13-01": ("string", None, None), "05-06-2007": ("string", None, None), "2001-xxxx-01": ("string", None, None), "7": ("number", 7.0, None)}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: (r.v.kind, r.v.num, (r.v.y, r.v.m, r.v.d) if r.v.kind == "date" else None) for r in df.select("s", V.to_value(F.col("s"), F.lit(""), F.col("s")).alias("v")).collect()}
    assert got == cases


DENOTATIONS = [
    (["5 km"], ["5"], "5", True), (["5 km", "5 mi"], ["5", "5"], "5 mi", False), (["a, b"], [""], "a, b", True), (["a", "b"], ["", ""], "b, a", True),
    (["a", "b"], ["", ""], "a", False), (["A", "a"], ["", ""], "a", True), ([], [], "a", False), ([None], [None], "", True), (["xx-01-02"], ["xx-01-02"], "xx-01-02", True),
]


def test_denotations(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(DENOTATIONS)], "i int, t array<string>, c array<string>, p string, ok boolean")
    scored = scoring.denotation_scores(df, "p", "t", "c")
    assert [(r.i, r.correct) for r in scored.orderBy("i").collect()] == [(i, x[3]) for i, x in enumerate(DENOTATIONS)]
    total = scoring.accuracy(scored).first()
    assert (total.examples, total.correct, total.accuracy) == (9, 6, 0.6667)
    assert scoring.accuracy(scored.where("false")).first().accuracy == 1.0
    with pytest.raises(Exception, match="differ in number"):
        scoring.denotation_scores(df.limit(1).withColumn("c", F.array()), "p", "t", "c").collect()


MULTISETS = [("1, 2", "2.0, 1", True), ("a, a", "a", False), ("nan", "nan", False), ("inf", "Infinity", True), ("-0", "0", True), ("", "", True), ("A", " a", True), ("-inf", "inf", False), ("1e1", "10", True), (None, "", True)]


def test_multisets(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(MULTISETS)], "i int, p string, g string, ok boolean")
    scored = scoring.multiset_scores(df, "p", "g")
    assert [r.correct for r in scored.orderBy("i").collect()] == [x[2] for x in MULTISETS]
    assert scoring.mean_accuracy(scored.where("false")).first().accuracy is None


def spans_of(rows):
    return [None if x is None else (x.s, x.e) for x in rows]


def test_spans(spark):
    schema = f"a {S.SPANS}, b {S.SPANS}"
    spans = [(3, 4), (1, 3), (2, 5), (4, 4), (6, 9)]
    assert spans_of(one(spark, schema, (spans, []), S.clean(F.col("a"), F.lit(8)))) == [(1, 3), (3, 4)]
    assert spans_of(one(spark, schema, (spans, []), S.clean(F.col("a"), F.lit(0)))) == [(1, 3), (3, 4), (6, 9)]
    tokens, mentions = [(0, 2), (2, 8), (8, 13)], [(1, 3), (9, 10), (20, 22)]
    assert spans_of(one(spark, schema, (tokens, mentions), S.to_tokens(F.col("a"), F.col("b")))) == [(0, 2), (2, 3), None]
    assert spans_of(one(spark, "m array<array<int>>", ([[1, 2], [3], None, [4, None], []],), S.from_pairs(F.col("m")))) == [(1, 2)]
    got = one(spark, f"k array<int>, t {S.SPANS}", ([0, 1, 3], [(0, 2), (2, 8), (8, 9), (9, 13)]), S.merge_runs(F.col("k"), F.col("t")))
    assert spans_of(got) == [(0, 8), (9, 13)]
    assert one(spark, "x int", (1,), S.overlap_side(F.lit(1), F.lit(3), F.lit(3), F.lit(4))) == -1


def test_masking(spark):
    schema, row = f"ids array<int>, sp {S.SPANS}", ([10, 11, 12, 13], [(1, 3)])
    ids, sp, m, p = F.col("ids"), F.col("sp"), K.MASK, K.PAD
    assert one(spark, schema, row, M.mask_ids(ids, sp, F.lit(""))) == [10, m, 13]
    assert one(spark, schema, row, M.label_ids(ids, sp)) == [p, 11, 12, p]
    assert one(spark, schema, row, M.mask_ids(ids, sp, F.lit(""), "token")) == [10, m, m, 13]
    assert one(spark, schema, row, M.mask_ids(ids, sp, F.lit(""), "token", merge=True)) == [10, m, 13]
    assert one(spark, schema, ([], []), M.mask_ids(ids, sp, F.lit(""), "token", merge=True)) == []
    with pytest.raises(ValueError):
        M.mask_ids(ids, sp, F.lit(""), "word")
    assert one(spark, "n int", (10,), M.sample_indices(F.col("n"), F.lit(3), F.lit("k"))) == sorted(one(spark, "n int", (10,), M.sample_indices(F.col("n"), F.lit(3), F.lit("k"))))
    assert one(spark, "n int", (2,), M.sample_indices(F.col("n"), F.lit(9), F.lit("k"))) == [0, 1]
    assert one(spark, "n int", (0,), M.sample_indices(F.col("n"), F.lit(9), F.lit("k"))) == []


def test_tokens(spark):
    text = "  Ab1 c-é 😀x "
    got = one(spark, "s string", (text,), K.token_offsets(F.col("s")))
    assert [text[o.s : o.e] for o in got] == one(spark, "s string", (text,), K.tokens(F.col("s"))) == ["Ab1", "c", "-", "é", "😀", "x"]
    assert one(spark, "s string", (text,), K.truncate_text(F.col("s"), 2)) == "  Ab1 c"
    assert one(spark, "s string", (text,), K.truncate_text(F.col("s"), 9)) == text
    assert one(spark, "s string", ("a b c",), K.truncate_cell(F.col("s"), 3)) == "a b c"
    assert one(spark, "s string", ("   ",), K.truncate_cell(F.col("s"), 1)) == "   "


def test_rows_within_a_budget(spark):
    t = F.col("t")
    for budget, kept in [(0, -1), (4, -1), (5, 0), (8, 0), (9, 1), (13, 2), (99, 2)]:
        assert table(spark, ["a", "b"], [["1"], ["2"]], truncation.kept_rows(t, F.lit(budget))) == kept


def test_escapes(spark):
    assert one(spark, "s string", ("a\\pb|c",), X.tsv_unescape_list(F.col("s"))) == ["a|b", "c"]
    assert one(spark, "s string", ("x\\\\n",), X.tsv_unescape(F.col("s"))) == "x\\\n"
    assert one(spark, "s string", ("a.b.c",), X.split_answers(F.col("s"), ".")) == ["a", "b", "c"]
    assert one(spark, "s string", ("",), X.with_prefix_space(F.col("s"))) == ""
    assert one(spark, "s string", ("　x",), X.with_prefix_space(F.col("s"))) == "　x"


def test_encodings_keep_their_lengths(spark):
    rows = [(1, "the cat sat", (["a", "b"], [["c d", None], ["e"]]), [[4, 7], [0, 3]], ["x", "y"]), (2, None, None, None, None), (3, "", ([], []), [[0, 1]], [])]
    df = spark.createDataFrame(rows, f"k int, context string, table {T.TABLE}, mentions array<array<int>>, answers array<string>")
    for corpus in ("natural", "sql"):
        for r in encoding.assemble({corpus: df}, "k").collect():
            assert len(r.labels) == len(r.target_input_ids)
            assert len(r.attention_mask) == len(r.input_ids)
            if corpus == "natural":
                assert len(r.input_ids) <= len(r.target_input_ids)
                assert all(x in (K.PAD, t) for x, t in zip(r.labels, r.target_input_ids))
    with pytest.raises(ValueError):
        encoding.assemble({"natural": df}, "k", methods={"natural": ["other"]})
    with pytest.raises(ValueError):
        encoding.Settings(max_source=4)


def test_collation(spark):
    rows = [(0, [1, 2, 3], [1, 1, 1], [4, 5], [4, 1]), (1, [1], [1], [4, 5, 6], [4, 5, 6]), (2, [], [], [], [])]
    df = spark.createDataFrame(rows, "i int, input_ids array<int>, attention_mask array<int>, target_input_ids array<int>, labels array<int>")
    got = {r.i: r for r in collation.collate(df, "i", 2, 4).collect()}
    assert got[0].input_ids == [1, 2, 3, 1] and got[1].attention_mask == [1, 0, 0, 0]
    assert got[0].labels == [4, -100, -100, -100] and got[0].decoder_input_ids == [2, 4, 5, 1]
    assert got[2].input_ids == got[2].decoder_input_ids == []
