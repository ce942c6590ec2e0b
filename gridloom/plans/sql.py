"""Pieces of ANSI-like SQL (DuckDB dialect) that say the same as the expressions of ``gridloom.functions``."""

from __future__ import annotations

import unicodedata

NULL_ROWS = "[]::VARCHAR[][]"
SPACE = r"[\x09-\x0D\x1C-\x20\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TOKEN = r"[ \t\n\r\f]*([A-Za-z0-9_]+|[^ \t\n\r\fA-Za-z0-9_])"


def shown(cells: str) -> str:
    return f"list_transform(coalesce({cells}, []::VARCHAR[]), lambda c_: coalesce(c_, 'None'))"


def joined(cells: str, sep: str = " | ") -> str:
    return f"coalesce(array_to_string({cells}, '{sep}'), '')"


def header_text(header: str) -> str:
    return f"(CASE WHEN len(coalesce({header}, [])) > 0 THEN 'col : ' || {joined(shown(header))} ELSE '' END)"


def row_texts(rows: str) -> str:
    return f"list_transform(coalesce({rows}, {NULL_ROWS}), lambda r_, i_: 'row ' || i_ || ' : ' || {joined(shown('r_'))})"


def flat(header: str, rows: str) -> str:
    return f"({header_text(header)} || CASE WHEN len(coalesce({header}, [])) > 0 THEN ' ' ELSE '' END || {joined(row_texts(rows), ' ')})"


def pieces(text: str) -> str:
    return f"regexp_extract_all({text}, '{TOKEN}')"


def tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '{TOKEN}', 1)"


def count(text: str) -> str:
    return f"len({pieces(text)})"


def cut(text: str, n: int) -> str:
    return f"(CASE WHEN {count(text)} > {n} THEN array_to_string({pieces(text)}[1:{n}], '') ELSE {text} END)"


def cut_cell(cell: str, n: int) -> str:
    return f"(CASE WHEN {count(cell)} >= {n} THEN ltrim(array_to_string({pieces(cell)}[1:{n}], ''), ' ') ELSE {cell} END)"


def offsets(full: str, bare: str) -> str:
    at = f"list_sum(list_transform({full}[1:i_], lambda p_: length(p_)))"
    return f"list_transform(range(1, len({full}) + 1), lambda i_: {{'s': ({at} - length({bare}[i_]))::INT, 'e': {at}::INT}})"


def spans_text(spans: str) -> str:
    return f"coalesce(array_to_string(list_transform({spans}, lambda x_: CASE WHEN x_ IS NULL THEN '-' ELSE x_.s || '-' || x_.e END), ','), '')"


def ids_text(ids: str) -> str:
    return f"coalesce(array_to_string(list_transform({ids}, lambda x_: x_::VARCHAR), ','), '')"


def hash_number(key: str, begin: int = 1) -> str:
    return f"('0x' || substr(md5({key}), {begin}, 8))::BIGINT"


def ids(toks: str) -> str:
    return f"list_transform({toks}, lambda t_: (4 + {hash_number('t_')} % 50257)::INT)"


def prefixed(s: str) -> str:
    return f"(CASE WHEN length({s}) = 0 OR regexp_matches({s}, '^{SPACE}') THEN {s} ELSE ' ' || {s} END)"


def pairs(mentions: str) -> str:
    ok = f"list_filter(coalesce({mentions}, []::INT[][]), lambda m_: len(m_) = 2 AND m_[1] IS NOT NULL AND m_[2] IS NOT NULL)"
    return f"list_transform({ok}, lambda m_: {{'s': m_[1], 'e': m_[2]}})"


def clean(spans: str, length: str) -> str:
    keep = f"x_.s < x_.e AND x_.s >= a_.prev AND (coalesce({length}, 0) = 0 OR x_.e <= {length})"
    return f"""list_reduce(list_sort({spans}), lambda a_, x_: CASE WHEN {keep} THEN {{'prev': x_.e, 'out': list_append(a_.out, x_)}} ELSE a_ END,
      {{'prev': -1, 'out': []::STRUCT(s INT, e INT)[]}}).out"""


def to_tokens(offs: str, mentions: str) -> str:
    hit = f"list_filter(range(0, len({offs})), lambda k_: {offs}[k_ + 1].s < m_.e AND {offs}[k_ + 1].e > m_.s)"
    return f"list_transform({mentions}, lambda m_: CASE WHEN len({hit}) > 0 THEN {{'s': list_min({hit})::INT, 'e': (list_max({hit}) + 1)::INT}} END)"


def uncovered(spans: str, i: str) -> str:
    return f"len(list_filter({spans}, lambda v_: v_.s <= {i} AND v_.e > {i})) = 0"


def labels(ids_: str, spans: str) -> str:
    return f"list_transform({ids_}, lambda x_, i_: CASE WHEN {uncovered(spans, '(i_ - 1)')} THEN 1 ELSE x_ END)"


def mask_span(ids_: str, spans: str) -> str:
    last = "list_filter({0}, lambda w_: w_.s <= i_ - 1 AND w_.e > i_ - 1)[-1].s".format(spans)
    return f"list_filter(list_transform({ids_}, lambda x_, i_: CASE WHEN {uncovered(spans, '(i_ - 1)')} THEN x_ WHEN {last} = i_ - 1 THEN 50264 END), lambda y_: y_ IS NOT NULL)"


def bert_id(x: str, key: str) -> str:
    u = f"{hash_number(key)} / 4294967296.0"
    return f"CASE WHEN {u} < 0.8 THEN 50264 WHEN {u} < 0.9 THEN {x} ELSE (4 + {hash_number(key, 9)} % 50257)::INT END"


def mask_token(ids_: str, spans: str, key: str) -> str:
    return f"list_transform({ids_}, lambda x_, i_: CASE WHEN {uncovered(spans, '(i_ - 1)')} THEN x_ ELSE {bert_id('x_', f'{key} || (i_ - 1)')} END)"


def collapse(ids_: str) -> str:
    return f"list_filter({ids_}, lambda z_, j_: NOT (z_ = 50264 AND j_ > 1 AND coalesce({ids_}[j_ - 1], -1) = 50264))"


def sample(n: str, k: str, key: str) -> str:
    ranked = f"list_sort(list_transform(range(0, {n}), lambda q_: {{'h': md5({key} || ':' || q_), 'i': q_}}))"
    return f"list_sort(list_transform(({ranked})[1:greatest(least({k}, {n}), 0)], lambda g_: g_.i))"


def truncated(source: str, question: str, max_question: int, max_length: int, max_cell: int, more: str = "") -> str:
    """CTEs ending in ``cutt`` (rec_no, q, header, rows, kept, and what ``more`` names): question, cells and rows within a budget."""
    cell = cut_cell("coalesce(d_, 'None')", max_cell)
    head = f"list_transform(coalesce(\"table\".header, []::VARCHAR[]), lambda d_: {cell})"
    body = f"list_transform(coalesce(\"table\".rows, {NULL_ROWS}), lambda e_: list_transform(coalesce(e_, []::VARCHAR[]), lambda d_: {cell}))"
    return f"""
    src AS (SELECT rec_no, {cut(question, max_question)} AS q, "table" IS NULL AS none, {head} AS header, {body} AS rows {more} FROM {source}),
    lens AS (SELECT *, {max_length} - {count('q')} AS budget, {count(header_text('header'))} AS nh,
      list_transform({row_texts('rows')}, lambda t_: {count('t_')}) AS ls FROM src),
    cutt AS (SELECT * EXCLUDE (rows, nh, ls, budget), CASE WHEN none THEN NULL WHEN nh > budget THEN -1
        ELSE len(list_filter(range(1, len(ls) + 1), lambda i_: nh + list_sum(ls[1:i_]) <= budget)) END AS kept, rows AS allrows, nh, budget FROM lens),
    fitt AS (SELECT * EXCLUDE (allrows), allrows[1:greatest(kept, 0)] AS rows FROM cutt)"""


def compatible() -> tuple[str, str, dict[str, str]]:
    """Characters with a compatibility form of one character, those forms, and the forms of several characters of the first two blocks and of general punctuation; by rule."""
    one, forms, several = [], [], {}
    for c in map(chr, range(0x80, 0x10000)):
        form = unicodedata.normalize("NFKD", c)
        if form != unicodedata.normalize("NFD", c):
            if len(form) == 1:
                one.append(c)
                forms.append(form)
            elif ord(c) < 0x180 or 0x2000 <= ord(c) < 0x2070:
                several[c] = form
    return "".join(one), "".join(forms), several


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def decomposed(s: str) -> str:
    """Without marks on letters and in compatibility form."""
    one, forms, several = compatible()
    for c, form in several.items():
        s = f"replace({s}, '{c}', {quoted(form)})"
    return f"strip_accents(translate({s}, {quoted(one)}, {quoted(forms)}))"


def normalized(s: str) -> str:
    """The form in which strings are compared; notes, details and quotes at the ends go as long as there are some, up to 8 times."""
    marks = "•♦†‡*#+"
    plain = f"translate({decomposed(s)}, '‘’´`“”‐‑‒–—−', chr(39) || chr(39) || chr(39) || chr(39) || '\"\"------')"
    strip = lambda x: f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"
    note = rf"(?:\[[^\]]*\]|[{marks}])"
    notes = lambda x: rf"CASE WHEN regexp_full_match({x}, '(?s)(?:\[[0-9]+\]|[{marks}]){note}*') THEN '' ELSE regexp_replace({x}, '(?s)^(.+?){note}+$', '\1') END"
    details = lambda x: rf"regexp_replace({x}, '(?s)^(.+?)(?: \([^)]*\))+$', '\1')"
    quotes = lambda x: rf"regexp_replace({x}, '(?s)^\"([^\"]*)\"$', '\1')"
    # A lambda for each step, so that the text of a step stands once.
    bind = lambda x, f, v: f"list_transform([{x}], lambda {v}: {f(v)})[1]"
    step = lambda a: quotes(strip(details(strip(bind(strip(a), notes, "n_")))))
    bare = f"list_reduce(range(0, 8), lambda a_, i_: {step('a_')}, {plain})"
    return strip(f"lower(regexp_replace(regexp_replace({bare}, '[.]$', ''), '{SPACE}+', ' ', 'g'))")
