"""Random inputs against slow plain models of the sequential operators."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import masking as M
from gridloom.functions import spans as S
from gridloom.functions import tokens as K

SPAN = st.tuples(st.integers(0, 12), st.integers(0, 12))
CASES = st.lists(st.tuples(st.lists(SPAN, max_size=6), st.integers(0, 14), st.lists(st.integers(1, 3), max_size=6), st.lists(st.sampled_from([7, 8, K.MASK]), max_size=8)), min_size=40, max_size=40)


def kept(spans, length):
    out, end = [], -1
    for s, e in sorted(spans):
        if s < e and s >= end and (not length or e <= length):
            out.append((s, e))
            end = e
    return out


def tiles(lengths):
    out, at = [], 0
    for n in lengths:
        out.append((at, at + n))
        at += n
    return out


def touched(tokens, spans):
    out = []
    for s, e in spans:
        hit = [i for i, (a, b) in enumerate(tokens) if a < e and b > s]
        out.append((hit[0], hit[-1] + 1) if hit else None)
    return out


def collapsed(ids):
    return [x for i, x in enumerate(ids) if not (x == K.MASK and i and ids[i - 1] == K.MASK)]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(CASES)
def test_sequential_operators(spark, cases):
    rows = [(i, spans, n, tiles(lengths), ids) for i, (spans, n, lengths, ids) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, spans {S.SPANS}, n int, toks {S.SPANS}, ids array<int>").coalesce(1)
    clean = S.clean(F.col("spans"), F.col("n"))
    got = df.select("*", clean.alias("clean"), S.to_tokens(F.col("toks"), clean).alias("hit"), M.collapse(F.col("ids")).alias("out")).collect()
    for r in got:
        want = kept([(x.s, x.e) for x in r.spans], r.n)
        assert [(x.s, x.e) for x in r.clean] == want
        assert [x and (x.s, x.e) for x in r.hit] == touched([(x.s, x.e) for x in r.toks], want)
        assert r.out == collapsed(r.ids)
