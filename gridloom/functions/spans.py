"""Span algebra on ARRAY<STRUCT<s INT, e INT>>; the end is exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.binding import let

SPANS = "array<struct<s:int,e:int>>"


def from_pairs(mentions: Column) -> Column:
    """Spans of ARRAY<ARRAY<INT>>; entries that aren't pairs of numbers are left out, null gives no spans."""
    ok = F.filter(F.coalesce(mentions, F.array().cast("array<array<int>>")), lambda m: (F.size(m) == 2) & F.get(m, 0).isNotNull() & F.get(m, 1).isNotNull())
    return F.transform(ok, lambda m: F.struct(F.get(m, 0).alias("s"), F.get(m, 1).alias("e")))


def span(s: Column, e: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))


def shift(spans: Column, by: Column) -> Column:
    return let(by, lambda d: F.transform(spans, lambda x: span(x["s"] + d, x["e"] + d)))


def clip(spans: Column, length: Column) -> Column:
    """Spans that begin before and end within ``length``."""
    return let(length, lambda n: F.filter(spans, lambda x: (x["s"] < n) & (x["e"] <= n)))


def clean(spans: Column, length: Column) -> Column:
    """Sorted spans without empty ones, those that begin before the last kept one ends and, if length isn't 0, those that end beyond it."""
    start = F.struct(F.lit(-1).alias("prev"), F.array().cast(SPANS).alias("out"))

    def step(a: Column, x: Column, n: Column) -> Column:
        keep = (x["s"] < x["e"]) & (x["s"] >= a["prev"]) & ((n == 0) | (x["e"] <= n))
        return F.struct(F.when(keep, x["e"]).otherwise(a["prev"]).alias("prev"), F.when(keep, F.array_append(a["out"], x)).otherwise(a["out"]).alias("out"))

    return let(F.coalesce(length, F.lit(0)), lambda n: F.aggregate(F.array_sort(spans), start, lambda a, x: step(a, x, n), lambda a: a["out"]))


def overlap_side(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """1 if the first span lies behind the second, -1 if before, 0 if they overlap."""
    return F.when(s1 >= e2, 1).when(e1 <= s2, -1).otherwise(0)


def to_tokens(tokens: Column, mentions: Column) -> Column:
    """Of each mention the span of tokens that it touches (first, last + 1), or null."""

    def one(m: Column, toks: Column) -> Column:
        hit = F.filter(F.transform(toks, lambda t, i: F.when((t["s"] < m["e"]) & (t["e"] > m["s"]), i)), lambda i: i.isNotNull())
        return let(hit, lambda h: F.when(F.size(h) > 0, span(F.array_min(h), F.array_max(h) + 1)))

    return let(tokens, lambda toks: F.transform(mentions, lambda m: one(m, toks)))


def merge_runs(indices: Column, tokens: Column) -> Column:
    """Character spans of runs of consecutive token indices (sorted)."""
    start = F.struct(F.lit(-2).alias("prev"), F.array().cast(SPANS).alias("out"))

    def step(a: Column, i: Column, toks: Column) -> Column:
        t = F.get(toks, i)
        last = F.element_at(a["out"], -1)
        longer = F.array_append(F.slice(a["out"], 1, F.size(a["out"]) - 1), span(last["s"], t["e"]))
        return F.struct(i.alias("prev"), F.when(i == a["prev"] + 1, longer).otherwise(F.array_append(a["out"], span(t["s"], t["e"]))).alias("out"))

    return let(tokens, lambda toks: F.aggregate(indices, start, lambda a, i: step(a, i, toks), lambda a: a["out"]))


def as_text(spans: Column) -> Column:
    """'s-e,s-e' for reports; a null span prints as '-'."""
    return F.array_join(F.transform(spans, lambda x: F.when(x.isNull(), F.lit("-")).otherwise(F.concat(x["s"].cast("string"), F.lit("-"), x["e"].cast("string")))), ",")
