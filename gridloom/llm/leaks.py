"""Problem 7: evaluation passages inside a training corpus, by a distributed positional inverted index.

The corpus is read once into a positional index of all its words: one row a document, with the hashes of its words in
order, so a posting is a word with its place and its neighbours. It doesn't depend on the test items, and serves any number of
them. Every window of ``window`` consecutive words of an item is looked up by its rarest word: a posting that has a neighbour in
common with it gives a document and an offset (place in the document minus place in the item). The item's whole list of words,
shifted to that offset, is then intersected with the document's in one step: runs of consecutive places are exact
phrases, and words that stand at most ``SLACK`` places off count for proximity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.plainform import plain_units
from gridloom.llm.stage import stage

WINDOW = 10
#: Places that a word may have shifted by to count as near its place.
SLACK = 3
#: A proximity match has ``WINDOW`` words near their places among so many consecutive words of the item.
STRETCH = 12
PHRASE, PROXIMITY = "phrase", "proximity"


def positional_index(texts: DataFrame, key: str) -> DataFrame:
    """(``key`` BIGINT, words ARRAY<BIGINT>): hashes of a text's words in plain form, in order; rows with a null key or without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Known(dict):
            """word -> its 64-bit hash."""

            def __missing__(self, word: str) -> int:
                if len(self) > 500_000:
                    self.clear()
                h = xxhash.xxh3_64_intdigest(word)
                self[word] = h = h - (1 << 64) if h >> 63 else h
                return h

        known = Known().__getitem__
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                words = [plain_units(t) for t in batch.column(1).slice(lo, 512).to_pylist()]
                flat = np.fromiter((known(w) for ws in words for w in ws), np.int64, sum(map(len, words)))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, words)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 512), lists], [key, "words"])

    known = texts.select(F.col(key).cast("bigint").alias(key), "text").where(F.col(key).isNotNull() & F.col("text").isNotNull())
    return known.mapInArrow(run, f"`{key}` bigint, words array<bigint>").where(F.size("words") > 0)


def postings(index: DataFrame, key: str) -> DataFrame:
    """(``key``, place, term, before, after) of an index: every word with its place and its neighbours (null at the ends)."""
    zipped = F.arrays_zip(F.col("words").alias("term"), F.concat(F.array(F.lit(None).cast("bigint")), F.expr("slice(words, 1, size(words) - 1)")).alias("before"), F.expr("slice(words, 2, size(words))").alias("after"))
    return index.select(key, F.posexplode(zipped).alias("place", "p")).select(key, "place", "p.term", "p.before", "p.after")


def anchors(item_index: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """(item_id, place, term, before, after): the word of each window of an item that the corpus has least often; none for windows with a word that the corpus lacks."""
    own = postings(item_index, "item_id").join(item_index.select("item_id", F.size("words").alias("n_words")), "item_id")
    counts = index.select(F.explode("words").alias("term")).join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    ranked = own.where(F.col("n_words") >= window).join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ahead = Window.partitionBy("item_id").orderBy("place").rowsBetween(0, window - 1)
    best = F.min(F.struct("n", "place", "term", "before", "after")).over(ahead).alias("best")
    return ranked.select("item_id", "place", "n_words", best).where((F.col("place") + window <= F.col("n_words")) & (F.col("best.n") > 0)).select("item_id", "best.place", "best.term", "best.before", "best.after").distinct()


def intersected(document: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(longest run of the item's words at their places, words near their places, most of them within a stretch) where item word k belongs at shift + k of the document."""
    n = len(item)
    padded = np.full(n + 2 * SLACK, np.iinfo(np.int64).min)
    lo, hi = max(0, shift - SLACK), min(len(document), shift + n + SLACK)
    if lo < hi:
        padded[lo - shift + SLACK : hi - shift + SLACK] = document[lo:hi]
    exact = padded[SLACK : SLACK + n] == item
    near = np.zeros(n, bool)
    for k in range(2 * SLACK + 1):
        near |= padded[k : k + n] == item
    breaks = np.flatnonzero(~np.concatenate([[False], exact, [False]]))
    sums = np.cumsum(np.concatenate([[0], near]))
    stretch = min(STRETCH, n)
    return int(np.diff(breaks).max()) - 1, int(sums[-1]), int((sums[stretch:] - sums[:-stretch]).max())


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents that hold a passage of an item: (doc_id, item_id, kind, run, words_near, n_words), a row for each pair.

    kind 'phrase': at least ``window`` consecutive words of the item stand in the document word by word; run is the longest such run.
    kind 'proximity': no such phrase, but at an offset that an anchor gives ``window`` words of some ``STRETCH``
    consecutive ones of the item stand within ``SLACK`` places of where they belong. words_near is the number of such words in all. Words
    are compared in plain form; each Han or kana character is a word. All phrases are found, as a phrase holds an anchor and one of its neighbours.
    Null ids and null, empty or blank texts take no part, items of fewer than ``window`` words (2 or more) can't leak,
    repeated rows change nothing, empty tables give an empty result.
    """
    if window < 2:
        raise ValueError("window must be 2 or more")
    index = stage(positional_index(docs, "doc_id"))
    item_index = stage(positional_index(items.select("item_id", "text").distinct(), "item_id"))
    wanted = stage(anchors(item_index, index, window))
    found = postings(index, "doc_id").join(wanted.select("item_id", "term", F.col("place").alias("at"), F.col("before").alias("b"), F.col("after").alias("a")), "term")
    found = found.where((F.col("before") == F.col("b")) | (F.col("after") == F.col("a"))).select("doc_id", "item_id", (F.col("place") - F.col("at")).alias("shift")).distinct()
    found = stage(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            document, item = ((c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(3), batch.column(4)))
            got = [
                intersected(document[1][document[0][k] : document[0][k + 1]], item[1][item[0][k] : item[0][k + 1]], shift)
                for k, shift in enumerate(batch.column(2).to_pylist())
            ]
            cols = list(zip(*got)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int32()) for c in cols), pa.array(np.diff(item[0]).astype(np.int32))], ["doc_id", "item_id", "run", "words_near", "in_stretch", "n_words"])

    # Only the words around the offset go on, so a candidate costs as much as the item is long.
    from_ = F.greatest(F.col("shift") - SLACK, F.lit(0))
    length = F.greatest(F.col("shift") + F.size("item_words") + SLACK - from_, F.lit(0))
    placed = found.join(index, "doc_id").join(item_index.withColumnRenamed("words", "item_words"), "item_id")
    placed = placed.select("doc_id", "item_id", (F.col("shift") - from_).alias("shift"), F.slice("words", from_ + 1, length).alias("words"), "item_words")
    met = placed.mapInArrow(run, "doc_id bigint, item_id bigint, run int, words_near int, in_stretch int, n_words int").where((F.col("run") >= window) | (F.col("in_stretch") >= window))
    best = F.max(F.struct(F.greatest("run", F.lit(window - 1)).alias("rank"), "words_near", "run", "n_words")).alias("best")
    kind = F.when(F.col("best.run") >= window, PHRASE).otherwise(PROXIMITY)
    return met.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", kind.alias("kind"), "best.run", "best.words_near", "best.n_words")


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, split, n_docs, n_near, longest_run, whole) of every item: documents with a phrase and with a proximity match, and of phrases the longest; whole: some document holds all its words in a row."""
    phrase = F.col("kind") == PHRASE
    run = F.when(phrase, F.col("run"))
    hit = found.groupBy("item_id").agg(F.count_if(phrase).alias("n_docs"), F.count_if(~phrase).alias("n_near"), F.max(run).alias("longest_run"), F.max(run == F.col("n_words")).alias("whole"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return items.select("item_id", "split").join(hit, "item_id", "left").select("item_id", "split", zero("n_docs"), zero("n_near"), zero("longest_run"), F.coalesce("whole", F.lit(False)).alias("whole"))
