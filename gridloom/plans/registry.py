"""Registered queries over the driver's tables, and the SQL each is checked against."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import masking as M
from gridloom.functions import spans as S
from gridloom.functions import tables as T
from gridloom.functions import text as X
from gridloom.functions import tokens as K
from gridloom.functions import values as V
from gridloom.functions.tokenizers import Special, Vocabulary
from gridloom.operators import collation, encoding, scoring
from gridloom.operators import truncation as TR
from gridloom.plans import pipelines
from gridloom.plans import sql as Q
from gridloom.sources import readers, sinks
from gridloom.sources.scratch import scratch

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query under its function's name, with the SQL it is checked against where one can say it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def ids_text(ids):  # noqa: ANN001, ANN201
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


# Tables as text.

_LINES = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
_CELLS = " || ' | ' || ".join(_LINES)


@query(f"""
    SELECT l_orderkey, 'col : {' | '.join(_LINES)} ' || string_agg('row ' || n || ' : ' || cells, ' ' ORDER BY n) AS flat
    FROM (SELECT l_orderkey, {_CELLS} AS cells, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINES)}) AS n FROM lineitem)
    GROUP BY l_orderkey""")
def linearize_orders(spark: SparkSession, folder: str) -> DataFrame:
    tables = readers.grouped_tables(_read(spark, folder, "lineitem"), "l_orderkey", _LINES, _LINES)
    return tables.select("l_orderkey", T.linearize(F.col("table")).alias("flat"))


@query("""
    SELECT r_name, 'col : n_nationkey | n_name ' || string_agg('row ' || n || ' : ' || n_nationkey || ' | ' || n_name, ' ' ORDER BY n) AS flat
    FROM (SELECT r_name, n_nationkey, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS n
      FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY r_name""")
def linearize_nations(spark: SparkSession, folder: str) -> DataFrame:
    named = _read(spark, folder, "nation").join(_read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return readers.grouped_tables(named, "r_name", ["n_nationkey", "n_name"], ["n_nationkey"]).select("r_name", T.linearize(F.col("table")).alias("flat"))


_FLAT = Q.flat('"table".header', '"table".rows')


@query(f"""SELECT rec_no, CASE WHEN "table" IS NOT NULL THEN {_FLAT} END AS flat FROM wtq""")
def linearize_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "wtq").select("rec_no", T.linearize(F.col("table")).alias("flat"))


@query(f"""
    WITH x AS (SELECT rec_no, coalesce("table".header, []) AS h, coalesce("table".rows, {Q.NULL_ROWS}) AS rows FROM wtq WHERE "table" IS NOT NULL),
    c AS (SELECT rec_no, -1 AS r, unnest(range(0, len(h))) AS c, unnest({Q.shown('h')}) AS cell FROM x
      UNION ALL SELECT rec_no, r, unnest(range(0, len(cells))), unnest({Q.shown('cells')}) FROM
        (SELECT rec_no, unnest(range(0, len(rows))) AS r, unnest(rows) AS cells FROM x)),
    p AS (SELECT rec_no, r, c, cell, CASE WHEN c > 0 THEN 3 WHEN r < 0 THEN 6 ELSE length('row ' || (r + 1) || ' : ') END AS lead FROM c),
    e AS (SELECT rec_no, r AS r0, lead(r) OVER w AS nr, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY rec_no ORDER BY r, c)),
    rl AS (SELECT rec_no, r, sum(len_) OVER (PARTITION BY rec_no ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
      SELECT rec_no, -1 AS r, CASE WHEN len(h) > 0 THEN length({Q.header_text('h')}) + 1 ELSE 0 END AS len_ FROM x
      UNION ALL SELECT rec_no, r, length(t) + 1 FROM (SELECT rec_no, unnest(range(0, len(rows))) AS r, unnest({Q.row_texts('rows')}) AS t FROM x)))
    SELECT rec_no, p.r::INT AS r, c::INT AS c, (coalesce(before, 0) + sum(lead + length(cell)) OVER (PARTITION BY rec_no, p.r ORDER BY c) - length(cell))::INT AS s,
      (coalesce(before, 0) + sum(lead + length(cell)) OVER (PARTITION BY rec_no, p.r ORDER BY c))::INT AS e
    FROM p JOIN rl USING (rec_no, r)""")
def linearize_offsets(spark: SparkSession, folder: str) -> DataFrame:
    cells = _read(spark, folder, "wtq").where(F.col("table").isNotNull()).select("rec_no", F.explode(T.cell_offsets(F.col("table"))).alias("o"))
    return cells.select("rec_no", F.col("o.row").alias("r"), F.col("o.cell").alias("c"), F.col("o.s").alias("s"), F.col("o.e").alias("e"))


@query(f"""
    SELECT rec_no, q || CASE WHEN length(q) > 0 AND length(f) > 0 THEN ' ' ELSE '' END || f AS both_text,
      (length(q) + CASE WHEN length(q) > 0 AND length(f) > 0 THEN 1 ELSE 0 END)::INT AS shift
    FROM (SELECT rec_no, coalesce(question, '') AS q, CASE WHEN "table" IS NULL THEN '' ELSE {_FLAT} END AS f FROM synthetic_corpus)""")
def concat_query_table(spark: SparkSession, folder: str) -> DataFrame:
    q, f = F.coalesce("question", F.lit("")), F.coalesce(T.linearize(F.col("table")), F.lit(""))
    return _read(spark, folder, "synthetic_corpus").select("rec_no", T.concat_question(q, f).alias("both_text"), T.table_shift(q, f).alias("shift"))


@query("""SELECT rec_no, (coalesce(len("table".header), 0) * (coalesce(len("table".rows), 0) + 1))::INT AS n_elements,
    coalesce(len(list_filter(coalesce("table".rows, []), lambda r: r IS NULL OR len(r) <> len("table".header) OR "table".header IS NULL)) = 0, true) AS regular
    FROM sql_corpus WHERE "table" IS NOT NULL AND len("table".header) > 0""")
def element_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "sql_corpus").where(F.size(T.header_of(F.col("table"))) > 0)
    return rows.select("rec_no", T.element_count(F.col("table")).alias("n_elements"), readers.well_formed(F.col("table")).alias("regular"))


# Tokens and truncation.

_CONTEXT = f"(SELECT rec_no, context, {Q.pieces('context')} AS f, {Q.tokens('context')} AS b FROM natural_corpus WHERE context IS NOT NULL)"


@query(f"SELECT rec_no, coalesce(array_to_string(b, chr(31)), '') AS toks, {Q.spans_text(Q.offsets('f', 'b'))} AS spans FROM {_CONTEXT}")
def tokenize_offsets(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "natural_corpus").where(F.col("context").isNotNull())
    return rows.select("rec_no", F.array_join(K.tokens(F.col("context")), "\x1f").alias("toks"), S.as_text(K.token_offsets(F.col("context"))).alias("spans"))


@query(f"SELECT doc_id, {Q.count('text')}::INT AS n_tokens FROM documents WHERE text IS NOT NULL")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "documents").where(F.col("text").isNotNull()).select("doc_id", K.token_count(F.col("text")).alias("n_tokens"))


@query(f"""SELECT rec_no, {Q.cut('context', 24)} AS short, least({Q.count('context')}, 24)::INT AS n_tokens FROM natural_corpus WHERE context IS NOT NULL""")
def truncate_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "natural_corpus").where(F.col("context").isNotNull())
    return rows.select("rec_no", K.truncate_text(F.col("context"), 24).alias("short"), F.least(K.token_count(F.col("context")), F.lit(24)).alias("n_tokens"))


@query(f"""WITH p AS (SELECT p_partkey, p_name || ' ' || p_type AS cell FROM part) SELECT p_partkey, {Q.cut_cell('cell', 3)} AS cell FROM p""")
def truncate_cell(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "part").select("p_partkey", K.truncate_cell(F.concat_ws(" ", "p_name", "p_type"), 3).alias("cell"))


_BUDGET = f"""
    WITH x AS (SELECT rec_no, {Q.count(Q.header_text('"table".header'))} AS nh,
      list_transform({Q.row_texts('"table".rows')}, lambda t_: {Q.count('t_')}) AS ls FROM wtq WHERE "table" IS NOT NULL)"""


@query(_BUDGET + """
    SELECT rec_no, nh::INT AS header_tokens, (CASE WHEN nh > 96 THEN -1 ELSE len(list_filter(range(1, len(ls) + 1), lambda i_: nh + list_sum(ls[1:i_]) <= 96)) END)::INT AS kept FROM x""")
def row_budget(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("table")
    return _read(spark, folder, "wtq").where(t.isNotNull()).select("rec_no", TR.header_tokens(t).alias("header_tokens"), TR.kept_rows(t, F.lit(96)).alias("kept"))


@query(_BUDGET + " SELECT rec_no FROM x WHERE nh > 16")
def header_too_long(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("table")
    return _read(spark, folder, "wtq").where(t.isNotNull()).where(TR.kept_rows(t, F.lit(16)) < 0).select("rec_no")


@query(f"""WITH {Q.truncated('(SELECT rec_no, coalesce(question, $$$$) AS question, "table" FROM wtq)', 'question', 12, 128, 4)}
    SELECT rec_no, q AS question, CASE WHEN NOT none THEN {Q.flat('header', 'rows')} END AS flat, coalesce(kept >= 0, true) AS fits FROM fitt""")
def truncate_full(spark: SparkSession, folder: str) -> DataFrame:
    cut = TR.truncate(_read(spark, folder, "wtq").select("rec_no", "question", "table"), "question", "table", 12, 128, 4)
    return cut.select("rec_no", "question", T.linearize(F.col("table")).alias("flat"), "fits")


# Spans.


@query(f"""
    WITH x AS (SELECT rec_no, coalesce(context, '') AS c, {Q.pairs('mentions')} AS m, answers FROM natural_corpus)
    SELECT rec_no, {Q.prefixed('c')} AS context,
      {Q.spans_text(f"list_transform(m, lambda v_: {{'s': v_.s + length({Q.prefixed('c')}) - length(c), 'e': v_.e + length({Q.prefixed('c')}) - length(c)}})")} AS mentions,
      coalesce(array_to_string(list_transform(answers, lambda a_, i_: CASE WHEN i_ = 1 THEN {Q.prefixed('a_')} ELSE a_ END), '|'), '') AS answers FROM x""")
def prefix_space_shift(spark: SparkSession, folder: str) -> DataFrame:
    rows = encoding.prefixed(_read(spark, folder, "natural_corpus").select("rec_no", "context", "mentions", "answers"), "rec_no")
    return rows.select("rec_no", "context", S.as_text(F.col("mentions")).alias("mentions"), F.coalesce(F.array_join("answers", "|"), F.lit("")).alias("answers"))


@query(f"""SELECT rec_no, {Q.spans_text(f"list_filter({Q.pairs('mentions')}, lambda v_: v_.s < 80 AND v_.e <= 80)")} AS mentions FROM natural_corpus""")
def mention_clip(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "natural_corpus").select("rec_no", S.as_text(S.clip(S.from_pairs(F.col("mentions")), F.lit(80))).alias("mentions"))


_CLEAN = Q.clean(Q.pairs("mentions"), "length(coalesce(context, ''))")


@query(f"SELECT rec_no, {Q.spans_text(_CLEAN)} AS mentions FROM natural_corpus")
def clean_spans(spark: SparkSession, folder: str) -> DataFrame:
    spans = S.clean(S.from_pairs(F.col("mentions")), F.length(F.coalesce("context", F.lit(""))))
    return _read(spark, folder, "natural_corpus").select("rec_no", S.as_text(spans).alias("mentions"))


@query(f"""WITH x AS (SELECT rec_no, unnest({Q.pairs('mentions')}) AS a, unnest(range(0, len({Q.pairs('mentions')}))) AS i, {Q.pairs('mentions')} AS m FROM natural_corpus)
    SELECT rec_no, i::INT AS i, (CASE WHEN a.s >= m[i].e THEN 1 WHEN a.e <= m[i].s THEN -1 ELSE 0 END)::INT AS side FROM x WHERE i > 0""")
def span_sides(spark: SparkSession, folder: str) -> DataFrame:
    """On which side of the mention before each mention lies, or 0 if they overlap."""
    rows = _read(spark, folder, "natural_corpus").select("rec_no", S.from_pairs(F.col("mentions")).alias("m"))
    each = rows.select("rec_no", "m", F.posexplode("m").alias("i", "a")).where("i > 0").withColumn("b", F.get("m", F.col("i") - 1))
    return each.select("rec_no", "i", S.overlap_side(F.col("a.s"), F.col("a.e"), F.col("b.s"), F.col("b.e")).alias("side"))


_IN_TOKENS = f"""(SELECT rec_no, f, b, o, list_filter({Q.to_tokens('o', 'm')}, lambda s_: s_ IS NOT NULL) AS sp, {Q.to_tokens('o', 'm')} AS raw, {Q.ids('b')} AS ids FROM
    (SELECT rec_no, f, b, {Q.offsets('f', 'b')} AS o, m FROM (SELECT rec_no, {Q.pieces('context')} AS f, {Q.tokens('context')} AS b, {_CLEAN} AS m
      FROM natural_corpus WHERE context IS NOT NULL)))"""


def _in_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "natural_corpus").where(F.col("context").isNotNull())
    rows = rows.select("rec_no", "context", S.clean(S.from_pairs(F.col("mentions")), F.length("context")).alias("m"), K.token_offsets(F.col("context")).alias("o"))
    rows = rows.withColumn("raw", S.to_tokens(F.col("o"), F.col("m"))).withColumn("ids", K.token_ids(F.col("context")))
    return rows.withColumn("sp", F.filter("raw", lambda x: x.isNotNull()))


@query(f"SELECT rec_no, {Q.spans_text('raw')} AS in_tokens FROM {_IN_TOKENS}")
def char2token(spark: SparkSession, folder: str) -> DataFrame:
    return _in_tokens(spark, folder).select("rec_no", S.as_text(F.col("raw")).alias("in_tokens"))


# Masking.

_N = '(coalesce(len("table".header), 0) * (coalesce(len("table".rows), 0) + 1))'


@query(f"""SELECT rec_no, {Q.ids_text(Q.sample(_N, f'greatest(1, ({_N} * 200 + 999) // 1000)', "'1:' || rec_no || ':t'"))} AS elements
    FROM natural_corpus WHERE "table" IS NOT NULL AND len("table".header) > 0""")
def mask_sample_elements(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "natural_corpus").where(F.size(T.header_of(F.col("table"))) > 0)
    key = F.concat(F.lit("1:"), F.col("rec_no").cast("string"), F.lit(":t"))
    return rows.select("rec_no", ids_text(encoding.element_sample(F.col("table"), key, 0.2)).alias("elements"))


_TAKEN = Q.sample("len(b)", "(len(b) * 150 + 999) // 1000", "'1:' || rec_no || ':c'")


@query(f"""
    WITH x AS (SELECT rec_no, {Q.offsets('f', 'b')} AS o, {_TAKEN} AS k FROM {_CONTEXT}),
    i AS (SELECT rec_no, o, unnest(k) AS t FROM x), g AS (SELECT *, t - row_number() OVER (PARTITION BY rec_no ORDER BY t) AS island FROM i),
    s AS (SELECT rec_no, min(o[t + 1].s) AS s, max(o[t + 1].e) AS e FROM g GROUP BY rec_no, island)
    SELECT rec_no, coalesce(string_agg(s.s || '-' || s.e, ',' ORDER BY s.s), '') AS spans FROM x LEFT JOIN s USING (rec_no) GROUP BY rec_no""")
def mask_sample_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "natural_corpus").where(F.col("context").isNotNull()).withColumn("o", K.token_offsets(F.col("context")))
    taken = M.sample_indices(F.size("o"), encoding.percent_ceil(F.size("o"), 0.15), F.concat(F.lit("1:"), F.col("rec_no").cast("string"), F.lit(":c")))
    return rows.withColumn("k", taken).select("rec_no", S.as_text(S.merge_runs(F.col("k"), F.col("o"))).alias("spans"))


@query(f"SELECT rec_no, {Q.ids_text(Q.mask_span('ids', 'sp'))} AS masked, {Q.ids_text(Q.labels('ids', 'sp'))} AS labels FROM {_IN_TOKENS}")
def mask_span_labels(spark: SparkSession, folder: str) -> DataFrame:
    ids, sp = F.col("ids"), F.col("sp")
    return _in_tokens(spark, folder).select("rec_no", ids_text(M.mask_ids(ids, sp, F.lit(""))).alias("masked"), ids_text(M.label_ids(ids, sp)).alias("labels"))


_BERT = Q.mask_token("ids", "sp", "'1:' || rec_no || ':'")


@query(f"SELECT rec_no, {Q.ids_text(Q.collapse('masked'))} AS masked FROM (SELECT rec_no, {_BERT} AS masked FROM {_IN_TOKENS})")
def mask_token_bert(spark: SparkSession, folder: str) -> DataFrame:
    key = F.concat(F.lit("1:"), F.col("rec_no").cast("string"))
    return _in_tokens(spark, folder).select("rec_no", ids_text(M.mask_ids(F.col("ids"), F.col("sp"), key, "token", "bert", True)).alias("masked"))


@query(f"SELECT rec_no, {Q.ids_text('list_transform(ids, lambda x_, i_: CASE WHEN (i_ - 1) % 3 = 0 THEN 1 ELSE x_ END)')} AS ids FROM {_IN_TOKENS}")
def replace_special(spark: SparkSession, folder: str) -> DataFrame:
    flags = F.transform("ids", lambda x, i: (i % 3 == 0).cast("int"))
    return _in_tokens(spark, folder).select("rec_no", ids_text(M.replace_at(F.col("ids"), flags)).alias("ids"))


# Encodings and corpora; a small budget, so that all cuts occur.

_SETTINGS = encoding.Settings(max_source=160, max_context=24, max_cell=6)
_FULL = encoding.Settings()
_BOTH = """(q || CASE WHEN length(q) > 0 AND length(fl) > 0 THEN ' ' ELSE '' END || fl)"""
_SHIFTED = "list_transform(m0, lambda v_: {'s': v_.s + d, 'e': v_.e + d})"
_NO_SPANS = "[]::STRUCT(s INT, e INT)[]"


def _framed(ids: str, start: int = K.START, end: int = K.END) -> str:
    return Q.ids_text(f"list_concat([{start}], list_concat({ids}, [{end}]))")


def _cut_sql(corpus: str, s: encoding.Settings, question: str = "context", more: str = "", where: str = "true") -> str:
    """CTEs up to fitt of the records of a corpus, cut to the settings' budget, with the prefix space."""
    source = f"""(SELECT rec_no, {Q.prefixed(f"coalesce({question}, '')")} AS c, {'answers,' if 'answers' in more else ''} {f"{Q.pairs('mentions')} AS m0, length({Q.prefixed(f'coalesce({question}, $$$$)')}) - length(coalesce({question}, '')) AS d," if 'm0' in more else ''} "table" FROM {corpus} WHERE {where})"""
    return f"WITH {Q.truncated(source, 'c', s.max_context, s.max_source - s.safe_tokens, s.max_cell, more)}"


def _salient_sql(s: encoding.Settings) -> str:
    """rec_no and the three lists as text."""
    return f"""{_cut_sql('natural_corpus', s, more=', m0, d')},
    g AS (SELECT *, CASE WHEN none THEN '' ELSE {Q.flat('header', 'rows')} END AS fl, list_filter({_SHIFTED}, lambda y_: y_.s < length(q) AND y_.e <= length(q)) AS mm FROM fitt WHERE none OR kept >= 0),
    h AS (SELECT rec_no, {_BOTH} AS txt, {Q.clean('mm', 'length(q)')} AS sp0 FROM g),
    k AS (SELECT rec_no, {Q.pieces('txt')} AS f, {Q.tokens('txt')} AS b, {Q.clean('sp0', 'length(txt)')} AS m FROM h),
    o AS (SELECT rec_no, b, m, {Q.offsets('f', 'b')} AS o FROM k),
    z AS (SELECT rec_no, {Q.ids('b')} AS ids, list_filter({Q.to_tokens('o', 'm')}, lambda s_: s_ IS NOT NULL) AS sp FROM o)
    SELECT rec_no, {_framed(Q.mask_span('ids', 'sp'))} AS input_ids, {_framed('ids')} AS target_input_ids, {_framed(Q.labels('ids', 'sp'), K.PAD, K.PAD)} AS labels FROM z"""


def _random_sql(s: encoding.Settings) -> str:
    n = "(len(header) * (len(rows) + 1))"
    element = f"CASE WHEN i_ < len(header) THEN header[i_ + 1] ELSE coalesce(rows[i_ // len(header)][i_ % len(header) + 1], '') END"
    left = f"{s.max_mask_tokens} - {Q.count('names')}"
    taken = Q.sample("len(cb)", f"least({left}, (len(cb) * {round(s.context_mask_prob * 1000)} + 999) // 1000)", "key || ':c'")
    # Cells with their index and places: pieces of the flat table, summed up.
    return f"""{_cut_sql('natural_corpus', s)},
    g AS (SELECT rec_no, q, header, rows, {Q.flat('header', 'rows')} AS fl, '{s.seed}:' || rec_no AS key FROM fitt WHERE NOT none AND kept >= 0 AND len(header) > 0),
    e AS (SELECT *, {Q.sample(n, f'greatest(1, ({n} * {round(s.table_mask_prob * 1000)} + 999) // 1000)', "key || ':t'")} AS els FROM g),
    nm AS (SELECT *, coalesce(array_to_string(list_transform(els, lambda i_: {element}), ' '), '') AS names, {Q.pieces('q')} AS cf, {Q.tokens('q')} AS cb FROM e),
    tk AS (SELECT *, {Q.offsets('cf', 'cb')} AS co, {taken} AS inds FROM nm),
    ix AS (SELECT rec_no, co, unnest(inds) AS t FROM tk), isl AS (SELECT *, t - row_number() OVER (PARTITION BY rec_no ORDER BY t) AS island FROM ix),
    cs AS (SELECT rec_no, min(co[t + 1].s)::INT AS s, max(co[t + 1].e)::INT AS e FROM isl GROUP BY rec_no, island),
    cells AS (SELECT rec_no, -1 AS r, unnest(range(0, len(header))) AS c, unnest(header) AS cell FROM tk
      UNION ALL SELECT rec_no, r, unnest(range(0, len(cells))), unnest(cells) FROM (SELECT rec_no, unnest(range(0, len(rows))) AS r, unnest(rows) AS cells FROM tk)),
    leads AS (SELECT rec_no, -1 AS r, 0 AS c, length('col : ') AS lead FROM tk UNION ALL
      SELECT rec_no, r, 0, length('row ' || (r + 1) || ' : ') + 1 FROM (SELECT rec_no, unnest(range(0, len(rows))) AS r FROM tk)),
    runs AS (SELECT rec_no, r, coalesce(c, 0) AS c, cell, coalesce(lead, 3) AS lead FROM cells FULL JOIN leads USING (rec_no, r, c)),
    pl AS (SELECT rec_no, r, c, cell, sum(lead + coalesce(length(cell), 0)) OVER (PARTITION BY rec_no ORDER BY r, c) AS e FROM runs),
    ts AS (SELECT pl.rec_no, (pl.e - length(cell) + length(q) + CASE WHEN length(q) > 0 THEN 1 ELSE 0 END)::INT AS s, (pl.e + length(q) + CASE WHEN length(q) > 0 THEN 1 ELSE 0 END)::INT AS e
      FROM pl JOIN tk USING (rec_no) WHERE cell IS NOT NULL AND c < len(header) AND list_contains(els, len(header) * (r + 1) + c)),
    sp AS (SELECT rec_no, list({{'s': s, 'e': e}}) AS spans FROM (SELECT * FROM cs UNION ALL SELECT * FROM ts) GROUP BY rec_no),
    h AS (SELECT rec_no, key, {_BOTH} AS txt, coalesce(spans, {_NO_SPANS}) AS sp0 FROM tk LEFT JOIN sp USING (rec_no)),
    k AS (SELECT rec_no, key, {Q.pieces('txt')} AS f, {Q.tokens('txt')} AS b, {Q.clean('sp0', 'length(txt)')} AS m FROM h),
    o AS (SELECT rec_no, key, b, m, {Q.offsets('f', 'b')} AS o FROM k),
    z AS (SELECT rec_no, key, {Q.ids('b')} AS ids, list_filter({Q.to_tokens('o', 'm')}, lambda s_: s_ IS NOT NULL) AS sp FROM o),
    w AS (SELECT rec_no, ids, sp, {Q.mask_token('ids', 'sp', "key || ':'")} AS masked FROM z)
    SELECT rec_no, {_framed(Q.collapse('masked'))} AS input_ids, {_framed('ids')} AS target_input_ids, {_framed(Q.labels('ids', 'sp'), K.PAD, K.PAD)} AS labels FROM w"""


_FIRST = f"list_transform(answers, lambda a_, i_: CASE WHEN i_ = 1 THEN {Q.prefixed('a_')} ELSE a_ END)"


def _qa_sql(corpus: str, s: encoding.Settings, question: str = "context", where: str = "true") -> str:
    return f"""{_cut_sql(corpus, s, question, ', answers', where)},
    g AS (SELECT rec_no, {_BOTH} AS txt, coalesce(array_to_string({_FIRST}, ', '), '') AS a FROM (SELECT *, CASE WHEN none THEN '' ELSE {Q.flat('header', 'rows')} END AS fl FROM fitt WHERE none OR kept >= 0))
    SELECT rec_no, {_framed(Q.ids(Q.tokens('txt')))} AS input_ids, {_framed(Q.ids(Q.tokens('a')))} AS target_input_ids, {_framed(Q.ids(Q.tokens('a')))} AS labels FROM g"""


def _assembled_sql(s: encoding.Settings) -> str:
    parts = [("natural", "random_masking", _random_sql(s)), ("natural", "salient_masking", _salient_sql(s)), ("synthetic", "qa", _qa_sql("synthetic_corpus", s)), ("sql", "qa", _qa_sql("sql_corpus", s))]
    return " UNION ALL ".join(f"SELECT '{c}' AS corpus, '{m}' AS method, * FROM ({q})" for c, m, q in parts)


def _texts(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "rec_no", *(ids_text(F.col(c)).alias(c) for c in ("input_ids", "target_input_ids", "labels")))


@query(_salient_sql(_SETTINGS))
def salient_masking(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(encoding.salient_masking(_read(spark, folder, "natural_corpus").select("rec_no", "context", "table", "mentions"), "rec_no", _SETTINGS))


@query(_random_sql(_SETTINGS))
def random_masking(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(encoding.random_masking(_read(spark, folder, "natural_corpus").select("rec_no", "context", "table", "mentions"), "rec_no", _SETTINGS))


@query(_qa_sql("wtq", _SETTINGS, "question", '"table" IS NOT NULL'))
def qa_encode(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "wtq").where(F.col("table").isNotNull()).select("rec_no", "question", "table", "answers")
    return _texts(encoding.qa(rows, "rec_no", _SETTINGS, question="question"))


_LOW = """(SELECT rec_no, lower(question) AS question, answers, {'header': list_transform("table".header, lambda c_: lower(coalesce(c_, 'None'))),
    'rows': list_transform("table".rows, lambda r_: list_transform(r_, lambda c_: lower(coalesce(c_, 'None'))))} AS "table" FROM wtq WHERE "table" IS NOT NULL)"""


@query(_qa_sql(_LOW, _SETTINGS, "question"))
def qa_lower(spark: SparkSession, folder: str) -> DataFrame:
    """Question and table in lower case, with the check that no length changes."""
    rows = _read(spark, folder, "wtq").where(F.col("table").isNotNull()).select("rec_no", "question", "table", "answers")
    return _texts(encoding.qa(rows, "rec_no", dataclasses.replace(_SETTINGS, lower_case=True), question="question"))


def _corpora(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: _read(spark, folder, f"{n}_corpus").select("rec_no", "context", "table", "mentions", "answers") for n in readers.CORPORA}


@query(f"SELECT corpus, method, count(*) AS n FROM ({_assembled_sql(_SETTINGS)}) GROUP BY corpus, method")
def corpus_union(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.assemble(_corpora(spark, folder), "rec_no", _SETTINGS).groupBy("corpus", "method").agg(F.count("*").alias("n"))


@query(_assembled_sql(_FULL))
def corpus_encoded(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(encoding.assemble(_corpora(spark, folder), "rec_no", _FULL), "corpus", "method")


_LEN = "len(string_split({0}, ','))"


@query(f"""SELECT count(*) FILTER (method <> 'qa' AND {_LEN.format('input_ids')} > {_LEN.format('target_input_ids')}) AS source_longer,
    count(*) FILTER ({_LEN.format('labels')} <> {_LEN.format('target_input_ids')}) AS label_unlike_target, count(*) FILTER ({_LEN.format('input_ids')} > 160) AS source_too_long,
    sum({_LEN.format('input_ids')})::BIGINT AS source_tokens, max({_LEN.format('input_ids')})::INT AS longest_source FROM ({_assembled_sql(_SETTINGS)})""")
def length_invariants(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.length_violations(encoding.assemble(_corpora(spark, folder), "rec_no", _SETTINGS), _SETTINGS.max_source)


_PLAIN_QA = f"""WITH {Q.truncated('(SELECT rec_no, coalesce(question, $$$$) AS c, answers, "table" FROM wtq)', 'c', 126, 126, 6, ', answers')},
    g AS (SELECT rec_no, {_BOTH} AS txt, coalesce(array_to_string(answers, ', '), '') AS a FROM (SELECT *, CASE WHEN none THEN '' ELSE {Q.flat('header', 'rows')} END AS fl FROM fitt WHERE none OR kept >= 0))
    SELECT rec_no, {_framed(f"({Q.ids(Q.tokens('txt'))})[1:126]")} AS input_ids, {_framed(f"({Q.ids(Q.tokens('a'))})[1:6]")} AS labels FROM g"""


@query(_PLAIN_QA)
def table_qa(spark: SparkSession, folder: str) -> DataFrame:
    rows = pipelines.TableQA(max_source=128, max_target=8, max_cell=6).process(_read(spark, folder, "wtq").select("rec_no", "question", "table", "answers"), "rec_no")
    return rows.select("rec_no", ids_text(F.col("input_ids")).alias("input_ids"), ids_text(F.col("labels")).alias("labels"))


@query("""
    WITH t AS (SELECT r_regionkey, 'col : r_regionkey | r_name row 1 : ' || r_regionkey || ' | ' || r_name AS flat FROM region)
    SELECT r_regionkey, item_id, text || ' ' || flat AS both_text FROM t CROSS JOIN eval_items""")
def pair_table_queries(spark: SparkSession, folder: str) -> DataFrame:
    # Every question with every table, which is the operator.
    tables = readers.grouped_tables(_read(spark, folder, "region"), "r_regionkey", ["r_regionkey", "r_name"], ["r_name"])
    pairs = readers.pair(tables, _read(spark, folder, "eval_items").select("item_id", "text"))
    return pairs.select("r_regionkey", "item_id", T.concat_question(F.col("text"), T.linearize(F.col("table"))).alias("both_text"))


# Sources, selection, order.


@query("SELECT rec_no, id FROM wtq WHERE split = 'train' AND id IN (SELECT id FROM wtq WHERE split = 'test' AND id IS NOT NULL)")
def fewshot_filter(spark: SparkSession, folder: str) -> DataFrame:
    wtq = _read(spark, folder, "wtq")
    ids = readers.select_split(wtq, "test").select("id").distinct()
    return readers.select_split(wtq, "train").join(ids, "id", "left_semi").select("rec_no", "id")


@query("SELECT split, count(*) AS n, count(DISTINCT id) AS n_ids FROM wtq WHERE split IN ('validation', 'test') GROUP BY split")
def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    wtq = _read(spark, folder, "wtq")
    parts = [readers.select_split(wtq, s, predicting=True) for s in ("validation", "test")]
    return parts[0].unionByName(parts[1]).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1000")
def head_n(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").limit(1000)


@query("SELECT user_id, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS event_type, max(struct_pack(ts := ts, event_id := event_id)).event_id AS event_id FROM events GROUP BY user_id")
def last_wins(spark: SparkSession, folder: str) -> DataFrame:
    return readers.last_wins(_read(spark, folder, "events"), "user_id", F.struct("ts", "event_id"), ["event_type", "event_id"])


@query(r"""
    WITH x AS (SELECT rec_no, replace(replace(context, ' or ', '\p'), ' and ', '|') || '\\n' || rec_no || '\n' AS s FROM sql_corpus WHERE context IS NOT NULL)
    SELECT rec_no, array_to_string(list_transform(string_split(s, '|'), lambda v: replace(replace(replace(v, '\n', chr(10)), '\p', '|'), '\\', '\')), chr(31)) AS items FROM x""")
def tsv_unescape(spark: SparkSession, folder: str) -> DataFrame:
    s = F.replace(F.replace("context", F.lit(" or "), F.lit("\\p")), F.lit(" and "), F.lit("|"))
    s = F.concat(s, F.lit("\\\\n"), F.col("rec_no").cast("string"), F.lit("\\n"))
    rows = _read(spark, folder, "sql_corpus").where(F.col("context").isNotNull())
    return rows.select("rec_no", F.array_join(X.tsv_unescape_list(s), "\x1f").alias("items"))


@query("SELECT rec_no, array_to_string(answers, ', ') AS answer FROM wtq WHERE len(answers) > 0 AND len(list_filter(answers, lambda a: a IS NOT NULL)) > 0")
def answer_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "wtq").where(F.exists("answers", lambda a: a.isNotNull()))
    return rows.select("rec_no", X.join_answers(F.col("answers")).alias("answer"))


@query(f"""SELECT rec_no, regexp_replace(replace(coalesce(question, ''), chr(10), ' '), '^{Q.SPACE}+|{Q.SPACE}+$', '', 'g') AS value FROM wtq""")
def predictions_sink_lines(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.prediction_lines(_read(spark, folder, "wtq"), "rec_no", "question")


# Typed values and scoring.


@query(f"""SELECT cell, {Q.normalized('cell')} AS norm FROM (SELECT DISTINCT unnest(flatten("table".rows)) AS cell FROM wtq) WHERE cell IS NOT NULL""")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    cells = _read(spark, folder, "wtq").select(F.explode(F.flatten(F.filter(F.col("table.rows"), lambda r: r.isNotNull()))).alias("cell"))
    return scoring.normalized_lookup(cells, "cell")


_FLOAT = r"^[+-]?([0-9]+(_[0-9]+)*\.?|([0-9]+(_[0-9]+)*)?\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"


def _strip(s: str) -> str:
    return f"regexp_replace({s}, '^{Q.SPACE}+|{Q.SPACE}+$', '', 'g')"


def _number(s: str) -> str:
    raw = f"(CASE WHEN regexp_matches({_strip(s)}, '{_FLOAT}') THEN TRY_CAST(replace({_strip(s)}, '_', '') AS DOUBLE) END)"
    return f"(CASE WHEN abs({raw} - round_even({raw}, 0)) < 1e-6 THEN trunc({raw}) WHEN isfinite({raw}) THEN {raw} END)"


_SQL_CELLS = """(SELECT DISTINCT unnest(flatten("table".rows)) AS cell FROM sql_corpus)"""


@query(f"SELECT cell, {_number('cell')} AS num FROM {_SQL_CELLS} WHERE cell IS NOT NULL")
def parse_number(spark: SparkSession, folder: str) -> DataFrame:
    flat = F.flatten(F.filter(F.col("table.rows"), lambda r: r.isNotNull()))
    cells = _read(spark, folder, "sql_corpus").select(F.explode(flat).alias("cell")).where("cell is not null").distinct()
    return cells.select("cell", V.parse_number(F.col("cell")).alias("num"))


_DATES = """(SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, 'xx-%m-%d')
    WHEN 2 THEN strftime(o_orderdate, '%Y-XX-xx') ELSE strftime(o_orderdate, '%d-%Y-%m') END AS s FROM orders)"""


@query(f"""SELECT o_orderkey, s, CASE WHEN ok THEN y END AS y, CASE WHEN ok THEN m END AS m, CASE WHEN ok THEN d END AS d FROM (
    SELECT *, coalesce(y IS NOT NULL AND (m = -1 OR m BETWEEN 1 AND 12) AND (d = -1 OR d BETWEEN 1 AND 31) AND NOT (y = -1 AND m = -1 AND d = -1), false) AS ok FROM (
    SELECT o_orderkey, s, CASE WHEN p[1] IN ('xx', 'xxxx') THEN -1 ELSE TRY_CAST(p[1] AS INT) END AS y, CASE WHEN p[2] = 'xx' THEN -1 ELSE TRY_CAST(p[2] AS INT) END AS m,
      CASE WHEN p[3] = 'xx' THEN -1 ELSE TRY_CAST(p[3] AS INT) END AS d FROM (SELECT o_orderkey, s, string_split(lower(s), '-') AS p FROM {_DATES})))""")
def parse_date(spark: SparkSession, folder: str) -> DataFrame:
    rows = _dates(spark, folder).withColumn("v", V.parse_date(F.col("s")))
    return rows.select("o_orderkey", "s", F.col("v.y").alias("y"), F.col("v.m").alias("m"), F.col("v.d").alias("d"))


def _dates(spark: SparkSession, folder: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    f = lambda x: F.date_format(d, x)
    s = F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, F.concat(F.lit("xx-"), f("MM-dd"))).when(k == 2, F.concat(f("yyyy"), F.lit("-XX-xx"))).otherwise(f("dd-yyyy-MM"))
    return _read(spark, folder, "orders").select("o_orderkey", s.alias("s"))


@query(f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN 'number' WHEN 3 THEN 'string' ELSE 'date' END AS kind,
    CASE WHEN o_orderkey % 4 = 2 THEN split_part(s, '-', 1)::DOUBLE END AS num, lower(s) AS norm FROM {_DATES}""")
def to_value(spark: SparkSession, folder: str) -> DataFrame:
    rows = _dates(spark, folder).withColumn("v", V.to_value(F.col("s"), F.lit(None).cast("string"), V.normalize(F.col("s"))))
    return rows.select("o_orderkey", F.col("v.kind").alias("kind"), F.col("v.num").alias("num"), F.col("v.norm").alias("norm"))


# Answers of an order: quantities, ship dates or flags of its lines, by the order's key; predictions are altered for some orders.
_ITEM = """CASE l_orderkey % 3 WHEN 0 THEN l_quantity::INT || ' units' WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE l_returnflag || '" [' || l_linestatus || ']' END"""
_CANON = """CASE l_orderkey % 3 WHEN 0 THEN l_quantity::INT || '.0' WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END"""
_GUESS = """CASE WHEN l_orderkey % 3 = 0 THEN (l_quantity::INT + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END) || '.0000001' WHEN l_orderkey % 3 = 1 THEN strftime(l_shipdate, '%Y-%m-%d')
    ELSE lower(l_returnflag) || '" ' END"""
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice"
_ANSWERS = f"""
    o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS n FROM lineitem),
    t0 AS (SELECT l_orderkey AS k, n, CASE l_orderkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'date' ELSE 'string' END AS kind,
      CASE l_orderkey % 3 WHEN 0 THEN (l_quantity::INT)::VARCHAR WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE lower(l_returnflag) || '"' END AS key FROM o),
    t AS (SELECT k, kind, key, min(n) AS n FROM t0 GROUP BY k, kind, key),
    p0 AS (SELECT l_orderkey AS k, n, CASE l_orderkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'date' ELSE 'string' END AS kind,
      CASE WHEN l_orderkey % 3 = 0 THEN (l_quantity::INT + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR WHEN l_orderkey % 3 = 1 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE lower(l_returnflag) || '"' END AS key
      FROM o WHERE NOT (l_orderkey % 5 = 0 AND n = 1 AND (SELECT count(*) FROM lineitem y WHERE y.l_orderkey = o.l_orderkey) > 1)),
    nt AS (SELECT k, count(*) AS nt FROM t GROUP BY k), np AS (SELECT k, count(*) AS lines, count(DISTINCT key) AS np, min(key) AS one FROM p0 GROUP BY k),
    hit AS (SELECT t.k, count(*) AS hits FROM t WHERE EXISTS (SELECT 1 FROM p0 WHERE p0.k = t.k AND p0.key = t.key) GROUP BY t.k),
    scored AS (SELECT k AS l_orderkey, CASE WHEN nt = 1 THEN lines = 1 AND coalesce(hits, 0) = 1 ELSE nt = np AND coalesce(hits, 0) = nt END AS correct
      FROM nt JOIN np USING (k) LEFT JOIN hit USING (k))"""


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "lineitem")
    k, q, day = F.col("l_orderkey"), F.col("l_quantity").cast("int"), F.date_format("l_shipdate", "yyyy-MM-dd")
    item = F.when(k % 3 == 0, F.concat(q.cast("string"), F.lit(" units"))).when(k % 3 == 1, day).otherwise(F.concat("l_returnflag", F.lit('" ['), "l_linestatus", F.lit("]")))
    canon = F.when(k % 3 == 0, F.concat(q.cast("string"), F.lit(".0"))).when(k % 3 == 1, day).otherwise(F.lit(""))
    guess = F.when(k % 3 == 0, F.concat((q + (k % 7 == 0).cast("int")).cast("string"), F.lit(".0000001"))).when(k % 3 == 1, day).otherwise(F.concat(F.lower("l_returnflag"), F.lit('" ')))
    lines = rows.select("l_orderkey", F.struct(*_ORDER.split(", "), item.alias("item"), canon.alias("canon"), guess.alias("guess")).alias("x"))
    per = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    short = F.when((k % 5 == 0) & (F.size("xs") > 1), F.slice("xs", 2, F.size("xs"))).otherwise(F.col("xs"))
    return per.select("l_orderkey", F.col("xs.item").alias("originals"), F.col("xs.canon").alias("canonicals"), F.array_join(short["guess"], ", ").alias("prediction"))


@query(f"WITH {_ANSWERS} SELECT * FROM scored")
def denotation_match(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.denotation_scores(_answers(spark, folder), "prediction", "originals", "canonicals").select("l_orderkey", "correct")


@query(f"WITH {_ANSWERS} SELECT count(*) AS examples, count(*) FILTER (correct) AS correct, round((count(*) FILTER (correct) + 1e-9) / (count(*) + 1e-9), 4) AS accuracy FROM scored")
def denotation_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.accuracy(scoring.denotation_scores(_answers(spark, folder), "prediction", "originals", "canonicals"))


@query(f"WITH {_ANSWERS} SELECT k AS l_orderkey, count(*) AS n_values FROM t GROUP BY k")
def value_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.typed(_answers(spark, folder), "originals", "canonicals", "v").select("l_orderkey", F.size("v").cast("bigint").alias("n_values"))


_MULTI = f"""
    o AS (SELECT l_orderkey, l_quantity, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem),
    s AS (SELECT l_orderkey, list_sort(list(l_quantity::INT::VARCHAR || l_returnflag)) = list_sort(list(CASE WHEN l_orderkey % 4 = 0 AND n = 1 AND c > 1 THEN 'none' ELSE l_quantity::INT::VARCHAR || l_returnflag END)) AS same
      FROM o GROUP BY l_orderkey),
    scored AS (SELECT l_orderkey, same AND l_orderkey % 9 <> 0 AS correct FROM s)"""


def _multi(spark: SparkSession, folder: str) -> DataFrame:
    k, q = F.col("l_orderkey"), F.col("l_quantity").cast("int").cast("string")
    x = F.struct(*_ORDER.split(", "), F.concat_ws(", ", q, "l_returnflag").alias("truth"), F.concat_ws(", ", F.concat(q, F.lit(".00")), F.concat(F.lower("l_returnflag"), F.lit("  "))).alias("guess"))
    per = _read(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    guesses = F.transform("xs", lambda v, i: F.when((k % 4 == 0) & (i == 0) & (F.size("xs") > 1), F.lit("none")).otherwise(v["guess"]))
    per = per.select("l_orderkey", F.array_join(F.col("xs.truth"), ", ").alias("truth"), F.concat(F.array_join(F.reverse(guesses), ", "), F.when(k % 9 == 0, F.lit(", nan")).otherwise(F.lit(""))).alias("guess"))
    return scoring.multiset_scores(per, "guess", "truth")


@query(f"WITH {_MULTI} SELECT * FROM scored")
def multiset_match(spark: SparkSession, folder: str) -> DataFrame:
    return _multi(spark, folder).select("l_orderkey", "correct")


@query(f"WITH {_MULTI} SELECT avg(correct::INT) AS accuracy FROM scored")
def multiset_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.mean_accuracy(_multi(spark, folder))


@query("""SELECT 'nu-' || (rec_no - 1) AS ex_id, question AS prediction, coalesce(array_to_string(t.answers, '|'), '') AS answers
    FROM wtq JOIN (SELECT id AS tid, arg_max(answers, rec_no) AS answers FROM wtq WHERE split = 'test' AND answers IS NOT NULL GROUP BY id) t ON tid = 'nu-' || (rec_no - 1)""")
def prediction_join(spark: SparkSession, folder: str) -> DataFrame:
    wtq = _read(spark, folder, "wtq")
    lines = scoring.predictions_with_ids(wtq.select((F.col("rec_no") - 1).alias("line"), F.col("question").alias("value")), None)
    targets = readers.last_wins(readers.select_split(wtq, "test").where("answers is not null"), "id", F.col("rec_no"), ["answers"])
    found = lines.join(targets.withColumnRenamed("id", "ex_id"), "ex_id")
    return found.select("ex_id", "prediction", F.array_join("answers", "|").alias("answers"))


@query("SELECT count(*) AS test_samples, 0.5::DOUBLE AS test_share FROM (SELECT 1 FROM wtq LIMIT 100000)")
def metrics_report(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.metrics(_read(spark, folder, "wtq"), "test", {"share": 0.5}, 100_000)


# A list of one string as Python prints it: in single quotes, or in double ones where it has a single quote and no double one.
_QUOTED = r"""'[' || CASE WHEN contains(norm, chr(39)) AND NOT contains(norm, '"') THEN '"' || replace(norm, '\', '\\') || '"'
    ELSE chr(39) || replace(replace(norm, '\', '\\'), chr(39), '\' || chr(39)) || chr(39) END || ']'"""
_SHOWN = r"""CASE o_orderkey % 5 WHEN 0 THEN s WHEN 1 THEN s || ' o''clock' WHEN 2 THEN s || ' "of" it''s' WHEN 3 THEN s || '\x' ELSE 'a ' || s END"""


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN printf('N(%f)', split_part(s, '-', 1)::DOUBLE) WHEN o_orderkey % 4 = 3 THEN 'S'
    ELSE printf('D(%d,%d,%d)', CASE WHEN p[1] = 'xx' THEN -1 ELSE p[1]::INT END, p[2]::INT, p[3]::INT) END || {_QUOTED} AS shown
    FROM (SELECT *, string_split(s, '-') AS p, lower({_SHOWN}) AS norm FROM {_DATES})""")
def value_strings(spark: SparkSession, folder: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 5, F.col("s")
    told = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit(" o'clock"))).when(k == 2, F.concat(day, F.lit(" \"of\" it's"))).when(k == 3, F.concat(day, F.lit("\\x"))).otherwise(F.concat(F.lit("a "), day))
    rows = _dates(spark, folder).withColumn("told", told).withColumn("n", V.normalize(F.col("told")))
    return rows.withColumn("v", V.to_value(F.col("told"), F.col("s"), F.col("n"))).select("o_orderkey", V.show_value(F.col("v"), F.col("n")).alias("shown"))


_CELL_OF = """(SELECT DISTINCT s FROM (SELECT unnest(flatten("table".rows)) AS s FROM wtq UNION ALL SELECT unnest(answers) FROM wtq) WHERE s IS NOT NULL)"""
_INT = r"^[+-]?[0-9]+(_[0-9]+)*$"


def _date_part(p: str, unknown: str) -> str:
    return f"CASE WHEN {p} IN ({unknown}) THEN -1 WHEN regexp_matches({_strip(p)}, '{_INT}') THEN TRY_CAST(replace({_strip(p)}, '_', '') AS INT) END"


# Python reads digits of any script.
_DIGITS = f"translate(s, '{''.join(V._DIGITS)}', '{V._DIGIT_VALUES}')"


@query(f"""WITH u AS (SELECT s, {_DIGITS} AS t FROM {_CELL_OF}), x AS (SELECT s, {_number('t')} AS n, string_split(lower(t), '-') AS p FROM u),
    y AS (SELECT *, CASE WHEN len(p) = 3 THEN {_date_part('p[1]', "'xx', 'xxxx'")} END AS dy, CASE WHEN len(p) = 3 THEN {_date_part('p[2]', "'xx'")} END AS dm, CASE WHEN len(p) = 3 THEN {_date_part('p[3]', "'xx'")} END AS dd FROM x),
    z AS (SELECT *, coalesce(n IS NULL AND (dm = -1 OR dm BETWEEN 1 AND 12) AND (dd = -1 OR dd BETWEEN 1 AND 31) AND dy IS NOT NULL AND NOT (dy = -1 AND dm = -1 AND dd = -1), false) AS ok FROM y)
    SELECT s, CASE WHEN n IS NOT NULL OR ok AND dm = -1 AND dd = -1 THEN 'number' WHEN ok THEN 'date' ELSE 'string' END AS kind,
      CASE WHEN n IS NOT NULL THEN n WHEN ok AND dm = -1 AND dd = -1 THEN dy END AS num,
      CASE WHEN ok AND NOT (dm = -1 AND dd = -1) THEN dy || '-' || dm || '-' || dd END AS ymd FROM z""")
def cell_values(spark: SparkSession, folder: str) -> DataFrame:
    """The types of all different cells and answers, read twice: as expressions and in plain Python; a difference is an error."""
    wtq = _read(spark, folder, "wtq")
    cells = wtq.select(F.explode(F.flatten(F.filter(F.col("table.rows"), lambda r: r.isNotNull()))).alias("s")).union(wtq.select(F.explode("answers"))).where("s is not null").distinct()
    rows = scoring.typed(cells.withColumn("one", F.array("s")), "one", None, "py").withColumn("v", V.to_value(F.col("s"), F.col("s"), V.normalize(F.col("s"))))
    v, other = F.col("v"), F.get("py", 0)
    checked = F.when(v.eqNullSafe(other), v).otherwise(F.raise_error(F.concat(F.lit("read in two ways: "), "s")).cast(V.VALUE))
    rows = rows.select("s", checked.alias("v"))
    return rows.select("s", F.col("v.kind").alias("kind"), F.col("v.num").alias("num"), F.concat_ws("-", "v.y", "v.m", "v.d").alias("ymd")).withColumn("ymd", F.when(F.col("kind") == "date", F.col("ymd")))


@query("SELECT rec_no, lower(context) AS context FROM sql_corpus WHERE context IS NOT NULL")
def lower_case(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "sql_corpus").where(F.col("context").isNotNull())
    return rows.select("rec_no", pipelines.lower_checked(F.col("context")).alias("context"))


# Collation.

_IDS = f"(SELECT rec_no, {Q.ids(Q.tokens('context'))} AS ids FROM natural_corpus WHERE context IS NOT NULL)"


@query(f"""WITH w AS (SELECT rec_no, ids, (ceil(max(len(ids)) OVER (PARTITION BY rec_no // 32) / 8.0) * 8)::INT AS width FROM {_IDS})
    SELECT rec_no, width, {Q.ids_text("list_concat(ids, list_transform(range(0, width - len(ids)), lambda v_: 1))")} AS ids FROM w""")
def pad_batch(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "natural_corpus").where(F.col("context").isNotNull()).select("rec_no", K.token_ids(F.col("context")).alias("ids"))
    rows = collation.batch_width(rows.withColumn("batch", F.expr("rec_no div 32")), "ids", "batch", 8)
    return rows.select("rec_no", "width", ids_text(collation.pad_to(F.col("ids"), F.col("width"), K.PAD)).alias("ids"))


@query(f"""SELECT rec_no, {Q.ids_text('CASE WHEN len(ids) > 0 THEN list_concat([2], ids[1:len(ids) - 1]) ELSE ids END')} AS decoder_input_ids FROM {_IDS}""")
def decoder_shift(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "natural_corpus").where(F.col("context").isNotNull()).select("rec_no", K.token_ids(F.col("context")).alias("ids"))
    return rows.select("rec_no", ids_text(collation.shift_right(F.col("ids"))).alias("decoder_input_ids"))


@query(f"""
    WITH x AS (SELECT rec_no, row_number() OVER (ORDER BY rec_no) - 1 AS i, {Q.ids(Q.tokens('context'))} AS ids FROM natural_corpus WHERE context IS NOT NULL),
    w AS (SELECT *, (ceil(max(len(ids)) OVER (PARTITION BY i // 16) / 8.0) * 8)::INT AS width FROM x), p AS (SELECT *, list_transform(range(0, width - len(ids)), lambda v_: 1) AS gap FROM w)
    SELECT rec_no, {Q.ids_text('list_concat(gap, ids)')} AS input_ids, {Q.ids_text('list_concat(list_transform(gap, lambda v_: 0), list_transform(ids, lambda v_: 1))')} AS attention_mask,
      {Q.ids_text('list_concat(list_transform(gap, lambda v_: -7), ids)')} AS labels,
      {Q.ids_text('list_concat([2], list_concat(gap, ids)[1:width - 1])')} AS decoder_input_ids FROM p WHERE width > 0""")
def collated(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "natural_corpus").where(F.col("context").isNotNull()).select("rec_no", K.token_ids(F.col("context")).alias("input_ids"))
    rows = rows.join(rows.select("rec_no", (F.row_number().over(Window.orderBy("rec_no")) - 1).alias("i")), "rec_no")
    rows = rows.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))).withColumn("labels", F.col("input_ids")).withColumn("target_input_ids", F.col("input_ids"))
    out = collation.collate(rows, "i", 16, 8, side="left", ignore=-7)
    return out.select("rec_no", *(ids_text(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "labels", "decoder_input_ids")))


@query("""SELECT rec_no, lower(coalesce(array_to_string(answers, ', '), '')) AS prediction, coalesce(array_to_string(answers, ', '), '') AS ground
    FROM wtq WHERE regexp_full_match(coalesce(array_to_string(answers, ', '), ''), '([!-~]([ -~]*[!-~])?)?') AND NOT regexp_matches(lower(coalesce(array_to_string(answers, ', '), '')), '(^|, )[+-]?nan(, |$)')""")
def decoded_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as ids of their characters, labels with ignored places behind, decoded and scored: all are right."""
    text = F.coalesce(F.array_join("answers", ", "), F.lit(""))
    rows = _read(spark, folder, "wtq").where(text.rlike("^([!-~]([ -~]*[!-~])?)?$")).where(~F.lower(text).rlike("(^|, )[+-]?nan(, |$)"))
    ids = lambda s: F.transform(F.filter(F.split(s, ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c) + 100)
    words = F.create_map(*(F.lit(x) for c in range(32, 127) for x in (c + 100, chr(c))))
    rows = rows.select("rec_no", ids(F.lower(text)).alias("said"), F.concat(ids(text), F.array_repeat(F.lit(K.IGNORE), 3)).alias("labels"))
    scored = scoring.id_scores(rows, "said", "labels", words)
    return scored.where("correct").select("rec_no", "prediction", "ground")


_EVERYTHING = f"""(SELECT rec_no, {Q.prefixed("coalesce(context, '')")} AS q, CASE WHEN "table" IS NULL THEN '' ELSE {_FLAT} END AS fl FROM natural_corpus)"""


@query(f"SELECT rec_no, {_strip(_BOTH)} AS text FROM {_EVERYTHING}")
def vocabulary_encode(spark: SparkSession, folder: str) -> DataFrame:
    """Whole records through a vocabulary file, with budgets that cut nothing; the ids decode to the text.

    The folder of vocabulary files can be named in the session's setting spark.gridloom.tokenizers.
    """
    end = 50256  # the only special token of this file
    tok = Vocabulary(f"{spark.conf.get('spark.gridloom.tokenizers', '/opt/tokenizers')}/byte_bpe_50k.json", Special(start=end, end=end, pad=end, mask=end, first=0, count=end))
    settings = encoding.Settings(max_source=10**7, max_context=10**6, max_cell=10**6, tokenizer=tok)
    rows = encoding.salient_masking(_read(spark, folder, "natural_corpus").select("rec_no", "context", "table", "mentions"), "rec_no", settings)
    return rows.select("rec_no", scoring.decoded(F.col("target_input_ids"), tok).alias("text"))


# Sources and sinks: tables written in each format and read back.


_CORPUS_ROWS = " UNION ALL ".join(f"""SELECT '{n}' AS corpus, rec_no, context, coalesce(len("table".rows), -1)::INT AS n_rows, coalesce(len(mentions), -1)::INT AS n_mentions,
    coalesce(array_to_string(answers, '|'), '') AS answers FROM {n}_corpus""" for n in readers.CORPORA)


@query(_CORPUS_ROWS)
def source_corpora(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch(spark)
    # rec_no travels as the first answer, so that lines can be told apart.
    for n, df in _corpora(spark, folder).items():
        df.select("context", "table", "mentions", F.concat(F.array(F.col("rec_no").cast("string")), F.coalesce("answers", F.array().cast("array<string>"))).alias("answers")).write.json(f"{root}/{n}.jsonl")
    out = None
    for n, df in readers.read_corpora(spark, root).items():
        rest = F.array_join(F.slice("answers", 2, F.size("answers")), "|")
        part = df.select(F.lit(n).alias("corpus"), F.get("answers", 0).cast("bigint").alias("rec_no"), "context", F.coalesce(F.size("table.rows"), F.lit(-1)).alias("n_rows"), F.coalesce(F.size("mentions"), F.lit(-1)).alias("n_mentions"), rest.alias("answers"))
        out = part if out is None else out.unionByName(part)
    return out


def _question_rows(spark: SparkSession, folder: str, split: str) -> DataFrame:
    return readers.select_split(_read(spark, folder, "wtq"), split).select(F.col("rec_no").cast("string").alias("id"), "question", "table", "answers")


def _questions_back(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    root = scratch(spark)
    for split in readers.SPLITS:
        rows = _question_rows(spark, folder, split)
        if kind == "csv":
            rows = rows.select("id", "question", F.to_json("table", {"ignoreNullFields": "false"}).alias("table"), F.to_json("answers").alias("answers"))
            rows.write.csv(f"{root}/{split}.csv", header=True, escape='"', quoteAll=True, emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        else:
            rows.write.json(f"{root}/{split}.json")
    back = readers.read_questions(spark, {s: f"{root}/{s}.{kind}" for s in readers.SPLITS})
    return back.select("split", F.col("id").cast("bigint").alias("rec_no"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce(T.linearize(F.col("table")), F.lit("")).alias("flat"), F.coalesce(F.array_join("answers", "|"), F.lit("")).alias("answers"))


_QUESTIONS = f"""SELECT split, rec_no, coalesce(question, '') AS question, CASE WHEN "table" IS NOT NULL THEN {_FLAT} ELSE '' END AS flat, coalesce(array_to_string(answers, '|'), '') AS answers FROM wtq"""


@query(_QUESTIONS)
def source_json(spark: SparkSession, folder: str) -> DataFrame:
    return _questions_back(spark, folder, "json")


@query(_QUESTIONS)
def source_csv(spark: SparkSession, folder: str) -> DataFrame:
    return _questions_back(spark, folder, "csv")


def _escaped(s):  # noqa: ANN001, ANN202
    return F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p")), F.lit("\n"), F.lit("\\n"))


@query("""SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS originals, o_custkey::VARCHAR AS canonicals FROM orders""")
def source_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Tagged TSV written in two files with other orders of fields, read back by their header lines."""
    root = scratch(spark)
    rows = _read(spark, folder, "orders").select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("id"), F.concat_ws("|", *map(_escaped, (F.col("o_orderstatus"), F.col("o_orderpriority")))).alias("o"), F.col("o_custkey").cast("string").alias("c"))
    for k, fields in enumerate((["id", "o", "c"], ["c", "id", "o"])):
        names = {"id": "id", "o": "targetValue", "c": "targetCanon"}
        part = rows.where(F.crc32("id") % 2 == k).select(*(F.col(f).alias(names[f]) for f in fields))
        part.write.csv(f"{root}/{k}", sep="\t", header=True, quote="")
    read = readers.read_targets(spark, f"{root}/*")
    return read.select(F.expr("cast(substr(ex_id, 2) as bigint)").alias("o_orderkey"), F.array_join("originals", "|").alias("originals"), F.array_join("canonicals", "|").alias("canonicals"))


@query("SELECT rec_no, question AS prediction FROM wtq WHERE question IS NOT NULL AND regexp_full_match(question, '[!-~]([ -~]*[!-~])?')")
def sink_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions written in order, and ids beside them; read back by line number and joined to their targets with both checks."""
    root = scratch(spark)
    rows = _read(spark, folder, "wtq").where(F.col("question").rlike("^[!-~]([ -~]*[!-~])?$")).select("rec_no", "question")
    sinks.write_predictions(rows, "rec_no", "question", f"{root}/said")
    sinks.write_predictions(rows.withColumn("id", F.col("rec_no").cast("string")), "rec_no", "id", f"{root}/ids")
    lines = [_whole_file(spark, f"{root}/{n}") for n in ("said", "ids")]
    said = scoring.predictions_with_ids(lines[0], lines[1].select("line", F.col("value").alias("id")))
    joined = scoring.join_targets(said, rows.select(F.col("rec_no").cast("string").alias("ex_id")))
    return joined.select(F.col("ex_id").cast("bigint").alias("rec_no"), "prediction")


def _whole_file(spark: SparkSession, path: str) -> DataFrame:
    """Part files in order, as one file's numbered lines."""
    lines = readers._numbered(spark, path)
    before = lines.groupBy("file").agg(F.count("*").alias("n")).select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return lines.join(before, "file").select((F.col("before") + F.col("line")).alias("line"), X.py_strip(F.col("value")).alias("value"))


@query("""WITH t AS (SELECT id, max(rec_no) AS rec_no FROM wtq WHERE split = 'train' AND id IS NOT NULL GROUP BY id)
    SELECT rec_no, id FROM t WHERE id IN (SELECT id FROM t ORDER BY id LIMIT 64)""")
def fewshot_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows of a file of ids, one row each, with the count checked."""
    train = readers.last_wins(readers.select_split(_read(spark, folder, "wtq"), "train").where("id is not null"), "id", F.col("rec_no"), ["rec_no"])
    path = scratch(spark)
    train.orderBy("id").limit(64).select("id").write.text(path)
    return readers.keep_ids(train, readers.id_set(spark, path)).select("rec_no", "id")
