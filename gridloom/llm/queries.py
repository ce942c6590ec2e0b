"""Queries of the training-data problems: name -> callable(spark, folder of tables), and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, leaks, lookalikes, mixing, near_duplicates, sentences, split_overlap, splitting, sql

#: The folder of vocabulary files; another one can be named in the session's setting spark.gridloom.tokenizers.
TOKENIZERS = "/opt/tokenizers"
TOKENIZER = f"{TOKENIZERS}/byte_bpe_50k.json"


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.token_ids(_read(spark, folder, "documents"), "doc_id", "text", _vocabulary(spark))


def p6_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The ids turned back into text."""
    return bpe.texts_of(p6_ids(spark, folder), "doc_id", "ids", _vocabulary(spark))


def _vocabulary(spark: SparkSession) -> str:
    return f"{spark.conf.get('spark.gridloom.tokenizers', TOKENIZERS)}/byte_bpe_50k.json"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_overlap.overlap_pairs(split_overlap.overlaps(_read(spark, folder, "wtq")))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    wtq = _read(spark, folder, "wtq")
    return split_overlap.overlap_report(wtq, split_overlap.overlaps(wtq))


def _mixed_corpora(spark: SparkSession, folder: str) -> dict[str, tuple[DataFrame, str | None]]:
    return {"natural": (_read(spark, folder, "natural_corpus"), None), "synthetic": (_read(spark, folder, "synthetic_corpus"), "question"), "sql": (_read(spark, folder, "sql_corpus"), None)}


def p2_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(_mixed_corpora(spark, folder), _read(spark, folder, "mix_targets"))


def p2_checked(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.checked(p2_mix(spark, folder), _mixed_corpora(spark, folder), _read(spark, folder, "mix_targets"))


def p2_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(p2_mix(spark, folder), _read(spark, folder, "mix_targets"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    corpora = {"wtq": _read(spark, folder, "wtq"), "synthetic": _read(spark, folder, "synthetic_corpus")}
    return splitting.split_corpora(corpora, _read(spark, folder, "size_limits"))


def p3_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.rejoined(p3_pieces(spark, folder), _read(spark, folder, "size_limits"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_pieces(spark, folder).where("piece = 0 and n_pieces > 1").select("corpus", "rec_no")


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.groups({"synthetic": (_read(spark, folder, "synthetic_corpus"), "question", "words"), "sql": (_read(spark, folder, "sql_corpus"), "table", "cells")})


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.group_pairs(p4_groups(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.lookalike_answers(_read(spark, folder, "wtq")).select("rec_no", "ans_pos")


def p5_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """How many cases there are of each kind of difference."""
    return lookalikes.lookalike_answers(_read(spark, folder, "wtq")).groupBy("kind").agg(F.count("*").alias("n_cases"))


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.consistent_forms(_read(spark, folder, "wtq"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).where(F.col("kind") == leaks.PHRASE).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(_read(spark, folder, "documents"), _read(spark, folder, "eval_items"))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(p7_leaks(spark, folder), _read(spark, folder, "eval_items")).drop("n_near")


def p7_near(spark: SparkSession, folder: str) -> DataFrame:
    """Items with documents that hold them nearly."""
    return leaks.leaked_items(p7_leaks(spark, folder), _read(spark, folder, "eval_items")).where("n_near > 0").select("item_id", "split", "n_near")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(_read(spark, folder, "documents")).select("doc_id", "end_pos")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_report": p1_report,
        "p2_mix": p2_mix,
        "p2_shares": p2_shares,
        "p2_checked": p2_checked,
        "p3_found": p3_found,
        "p3_pieces": p3_pieces,
        "p3_rejoined": p3_rejoined,
        "p4_found": p4_found,
        "p4_groups": p4_groups,
        "p5_found": p5_found,
        "p5_forms": p5_forms,
        "p5_kinds": p5_kinds,
        "p6_ids": p6_ids,
        "p6_texts": p6_texts,
        "p7_found": p7_found,
        "p7_leaks": p7_leaks,
        "p7_items": p7_items,
        "p7_near": p7_near,
        "p8_found": p8_found,
    }


_SIZE = """(coalesce(list_sum(list_transform("table".header, lambda h: coalesce(length(h), 0))), 0)
  + coalesce(list_sum(list_transform(flatten("table".rows), lambda c: coalesce(length(c), 0))), 0))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": sql.P1_FOUND,
        "p1_report": sql.P1_REPORT,
        "p4_found": sql.P4_FOUND,
        "p4_groups": sql.P4_GROUPS,
        "p5_found": sql.P5_FOUND,
        "p6_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p7_found": sql.P7_FOUND,
        "p7_items": sql.P7_ITEMS,
        "p3_found": f"""
            SELECT 'wtq' AS corpus, rec_no FROM wtq WHERE {_SIZE} > (SELECT max_chars FROM size_limits WHERE corpus = 'wtq')
            UNION ALL
            SELECT 'synthetic' AS corpus, rec_no FROM synthetic_corpus WHERE {_SIZE} > (SELECT max_chars FROM size_limits WHERE corpus = 'synthetic')""",
        "p2_checked": """
            SELECT mix_id, corpus, weight / sum(weight) OVER (PARTITION BY mix_id) AS target_share, CAST(0 AS BIGINT) AS over_cap, CAST(0 AS BIGINT) AS repeated,
                CAST(0 AS BIGINT) AS unusable, true AS close FROM mix_targets""",
        # Every table comes back from its pieces; no piece breaks a limit, lacks rows that would fit, or cuts a row that fits.
        "p3_rejoined": f"""
            WITH tables AS (SELECT 'wtq' AS corpus, rec_no, "table" FROM wtq UNION ALL SELECT 'synthetic', rec_no, "table" FROM synthetic_corpus)
            SELECT corpus, rec_no, md5(
                array_to_string(list_transform(coalesce("table".header, []), lambda h: coalesce(h, '')), '')
                || array_to_string(list_transform(flatten(coalesce("table".rows, [])), lambda c: coalesce(c, '')), '')) AS text_md5,
                CAST(0 AS BIGINT) AS over_limit, CAST(0 AS BIGINT) AS wrong_overlap, CAST(0 AS BIGINT) AS short,
                CAST(0 AS BIGINT) AS cut_rows
            FROM tables JOIN size_limits USING (corpus) WHERE {_SIZE} > max_chars""",
    }
