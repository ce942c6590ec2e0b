"""Questions and tables as id sequences: source, target and label of the pre-training and fine-tuning methods.

Every method is one function over Arrow batches that cuts, flattens, tokenizes and masks a record in one pass, by any ``Tokenizer``; methods
of one corpus share the truncation. There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import masking as M
from gridloom.functions import spans as S
from gridloom.functions import tables as T
from gridloom.functions import text as X
from gridloom.functions.tokenizers import BuiltIn, Tokenizer, count
from gridloom.operators import records as R


@dataclass(frozen=True)
class Settings:
    """Parameters of the processors; the defaults are those of the method."""

    table_mask_prob: float = 0.2
    context_mask_prob: float = 0.15
    max_mask_tokens: int = 200
    max_source: int = 1024
    max_context: int = 128
    max_cell: int = 15
    safe_tokens: int = 5
    answer_separator: str = ", "
    lower_case: bool = False
    seed: str = "1"
    special_tokens: bool = True
    tokenizer: Tokenizer = field(default_factory=BuiltIn)

    def __post_init__(self) -> None:
        if not self.max_source > self.safe_tokens:
            raise ValueError("max_source must exceed safe_tokens")
        if self.max_source - self.safe_tokens < self.max_context:
            raise ValueError("max_context must fit into max_source less safe_tokens")


def percent_ceil(n: Column, share: float) -> Column:
    """ceil(n * share) in whole numbers."""
    p = round(share * 1000)
    return F.floor((n * p + 999) / 1000).cast("int")


Encoded = tuple[list[int], list[int], list[int]]


@dataclass
class _Record:
    """A record cut to its budget, and how its text is encoded."""

    key: str
    context: str
    table: R.Table
    mentions: list[R.Span]
    answers: list[str]


def _framed(ids: list[int], settings: Settings, label: bool = False) -> list[int]:
    """Ids between start and end; in labels of masking both are padding."""
    special = settings.tokenizer.special
    if not settings.special_tokens:
        return ids
    return [special.pad, *ids, special.pad] if label else [special.start, *ids, special.end]


def _masked_pair(text: str, spans: list[R.Span], key: str, settings: Settings, granularity: str, strategy: str, merge: bool) -> Encoded:
    """Source, target and label of a text with character spans masked."""
    tok = settings.tokenizer
    ids = tok.ids(text)
    over = R.covered(len(ids), R.to_tokens(tok.places(text), R.clean(spans, len(text))))
    source = R.masked(tok, ids, over, key, granularity, strategy, merge)
    label = [x if first >= 0 else tok.special.pad for x, first in zip(ids, over)]
    return _framed(source, settings), _framed(ids, settings), _framed(label, settings, True)


def _salient(r: _Record, settings: Settings) -> Encoded:
    n = len(r.context)
    spans = R.clean([(s, e) for s, e in r.mentions if s < n and e <= n], n)
    return _masked_pair(R.with_question(r.context, r.table)[0], spans, r.key, settings, "span", "mask", False)


def _random(r: _Record, settings: Settings) -> Encoded | None:
    table, tok, columns = r.table, settings.tokenizer, len(r.table.header)
    if not columns:
        return None
    n = columns * (len(table.rows) + 1)
    chosen = R.sample(n, max(1, _share(n, settings.table_mask_prob)), f"{r.key}:t")
    left = settings.max_mask_tokens - count(tok, " ".join(table.element(i) for i in chosen))
    places = tok.places(r.context)
    in_context = R.runs(R.sample(len(places), min(left, _share(len(places), settings.context_mask_prob)), f"{r.key}:c"), places)
    text, at, pieces = R.with_question(r.context, table)
    spans = R.clean(in_context, len(r.context))
    wanted = set(chosen)
    for piece, row, cell in pieces:
        if 0 <= cell < columns and columns * (row + 1) + cell in wanted:
            spans.append((at, at + len(piece)))
        at += len(piece)
    return _masked_pair(text, spans, r.key, settings, "token", "bert", True)


def _qa(r: _Record, settings: Settings) -> Encoded:
    answer = _framed(settings.tokenizer.ids(settings.answer_separator.join(r.answers)), settings)
    return _framed(settings.tokenizer.ids(R.with_question(r.context, r.table)[0]), settings), answer, answer


def _share(n: int, share: float) -> int:
    """ceil(n * share) in whole numbers."""
    return (n * round(share * 1000) + 999) // 1000


def lower_whole(text: str) -> str:
    """Lower case; a text whose length changes by it is an error, as places in it would move."""
    low = text.lower()
    if len(low) != len(text):
        raise ValueError(f"length changes in lower case: {text}")
    return low


def _record(key: object, context: str | None, table: dict | None, mentions: list | None, answers: list | None, settings: Settings) -> _Record | None:
    """A record with prefix spaces, its places moved by them, cut to the budget; None where the header doesn't fit."""
    raw = context or ""
    context = R.prefixed(raw)
    moved = len(context) - len(raw)
    own = R.Table(table["header"], table["rows"]) if table else R.Table(None, None)
    if settings.lower_case:
        context, own.header, own.rows = lower_whole(context), [lower_whole(c) for c in own.header], [[lower_whole(c) for c in r] for r in own.rows]
    cut = R.truncated(settings.tokenizer, context, own, settings.max_context, settings.max_source - settings.safe_tokens, settings.max_cell)
    if cut is None:
        return None
    answers = [R.prefixed(a) if i == 0 and a is not None else a for i, a in enumerate(answers or ())]
    shown = [settings.seed] if key is None else [settings.seed, str(key)]
    return _Record(":".join(shown), *cut, [(s + moved, e + moved) for s, e in R.pairs(mentions)], [a for a in answers if a is not None])


_METHODS: dict[str, Callable[[_Record, Settings], Encoded | None]] = {"random_masking": _random, "salient_masking": _salient, "qa": _qa}
_OUT = ["input_ids", "target_input_ids", "labels"]


def encoded(df: DataFrame, key: str, methods: list[str], settings: Settings = Settings()) -> DataFrame:
    """(method, ``key``, input_ids, target_input_ids, labels) by each of the methods; a record is cut once for all of them.

    ``df``: key, context, table, and mentions and answers where the methods use them. Null contexts, mentions and answers count as empty, null tables as
    tables without columns. Records whose table header exceeds the budget are left out, and by random masking those without columns.
    """
    if unknown := set(methods) - set(_METHODS):
        raise ValueError(f"no method {sorted(unknown)[0]!r}")
    key_type = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int32())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[tuple] = []
                for i, row in enumerate(zip(*(part.column(k).to_pylist() for k in range(5)))):
                    record = _record(*row, settings)
                    if record is not None:
                        out += [(i, m, *got) for m in methods if (got := _METHODS[m](record, settings)) is not None]
                at, names, *ids = zip(*out) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), part.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, lists) for x in ids)], ["method", key, *_OUT])

    columns = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (("mentions", "array<array<int>>"), ("answers", "array<string>"))]
    return df.select(key, "context", "table", *columns).mapInArrow(run, f"method string, `{key}` {key_type}, " + ", ".join(f"{c} array<int>" for c in _OUT))


def salient_masking(df: DataFrame, key: str, settings: Settings = Settings()) -> DataFrame:
    """Context mentions masked as spans: ``key``, input_ids, target_input_ids, labels.

    Mentions are moved with the prefix space, cut to the truncated context and cleaned.
    """
    return encoded(df, key, ["salient_masking"], settings).drop("method")


def element_sample(table: Column, key: Column, share: float) -> Column:
    """Indices (sorted) of the table elements to mask: a share of all, at least one."""
    n = T.element_count(table)
    return M.sample_indices(n, F.greatest(F.lit(1), percent_ceil(n, share)), key)


def random_masking(df: DataFrame, key: str, settings: Settings = Settings()) -> DataFrame:
    """A share of table elements and context tokens masked token by token: ``key``, input_ids, target_input_ids, labels.

    The table comes first; the context gets at most what the budget of mask tokens leaves. Choices follow from seed and key.
    """
    return encoded(df, key, ["random_masking"], settings).drop("method")


def qa(df: DataFrame, key: str, settings: Settings = Settings(), question: str = "context") -> DataFrame:
    """Question and table as source, joined answers as target and label: ``key``, input_ids, target_input_ids, labels."""
    return encoded(df.select(key, F.col(question).alias("context"), "table", "answers"), key, ["qa"], settings).drop("method")


def prefixed(df: DataFrame, key: str) -> DataFrame:
    """Context and first answer with a prefix space, mentions as spans moved by it."""
    context = F.coalesce(F.col("context"), F.lit(""))
    added = F.length(X.with_prefix_space(context)) - F.length(context)
    mentions = S.shift(S.from_pairs(F.col("mentions")), added)
    keep = [F.col(c) for c in df.columns if c not in ("context", "mentions", "answers")]
    answers = [X.prefix_first(F.col("answers")).alias("answers")] if "answers" in df.columns else []
    return df.select(*keep, X.with_prefix_space(context).alias("context"), mentions.alias("mentions"), *answers)


def steered_rows(tok: Tokenizer, question: str, answers: list[str], table: R.Table, max_length: int, key: str) -> list[int]:
    """The rows of a training table that stay when it exceeds the budget: those that share a cell with the answers or the question's words, their neighbours, and of the others, by hash, as many as the budget's share."""
    left = max_length - count(tok, question) - count(tok, R.header_text(table.header))
    sizes = [count(tok, R.row_text(r, 99)) for r in table.rows]
    n, total = len(sizes), sum(sizes)
    if total < left or not n:
        return list(range(n))
    wanted = {a.lower() for a in answers} | set(question.split()) | set(question.strip("?!.,").split(" "))
    near = {j for i, r in enumerate(table.rows) if not wanted.isdisjoint(c.lower() for c in r) for j in range(i - 2, i + 3)}
    others = [i for i in range(n) if i not in near]
    dropped = min(len(others), int(n * (1 - max(left, 0) / total)))
    gone = {others[i] for i in R.sample(len(others), dropped, f"{key}:r")}
    return [i for i in range(n) if i not in gone]


def questions(df: DataFrame, key: str, options: dict, training: bool = False) -> DataFrame:
    """(``key``, input_ids, attention_mask, labels) of questions (key, question, table, answers); ``options`` are the parameters of ``plans.pipelines.TableQA``."""
    tok: Tokenizer = options["tokenizer"]
    settings = Settings(max_source=options["max_source"], max_context=min(128, options["max_source"] - 5), tokenizer=tok)
    longest = options["max_target"] if training or options["max_target_predicting"] is None else options["max_target_predicting"]
    specials, key_type = 2 * settings.special_tokens, dict(df.dtypes)[key]

    def one(k: object, question: str | None, table: dict | None, answers: list | None) -> tuple[list[int], list[int]] | None:
        question, told = question or "", [a for a in answers or () if a is not None]
        own = R.Table(table["header"], table["rows"]) if table else R.Table(None, None)
        if options["lower_case"]:
            question = question.lower()
        room = options["max_source"] - specials
        keep = steered_rows(tok, question, told, own, room, f"{options['seed']}:{k}") if training else None
        cut = R.truncated(tok, question, own, room, room, options["max_cell"], keep)
        if cut is None:
            return None
        source = tok.ids(R.with_question(*cut)[0])[:room]
        return _framed(source, settings), _framed(tok.ids(options["answer_separator"].join(told))[: max(longest - specials, 0)], settings)[:longest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int32())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = [(i, *x) for i, row in enumerate(zip(*(part.column(k).to_pylist() for k in range(4)))) if (x := one(*row)) is not None]
                at, source, labels = zip(*got) if got else [()] * 3
                mask = [[1] * len(x) for x in source]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, lists) for x in (source, mask, labels))], [key, "input_ids", "attention_mask", "labels"])

    return df.select(key, "question", "table", "answers").mapInArrow(run, f"`{key}` {key_type}, input_ids array<int>, attention_mask array<int>, labels array<int>")


#: Methods of each corpus, in the order of the output.
CORPUS_METHODS = {"natural": ["random_masking", "salient_masking"], "synthetic": ["qa"], "sql": ["qa"]}


def assemble(corpora: dict[str, DataFrame], key: str, settings: Settings = Settings(), methods: dict[str, list[str]] = CORPUS_METHODS) -> DataFrame:
    """All corpora as one training set: corpus, method, ``key``, input_ids, attention_mask, target_input_ids, labels; a row for each method."""
    parts = [encoded(df, key, methods[name], settings).select(F.lit(name).alias("corpus"), "*") for name, df in corpora.items() if methods.get(name)]
    return reduce(DataFrame.unionByName, parts).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
