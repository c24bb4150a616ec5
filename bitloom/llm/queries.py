"""The pN_ queries over the tables of a data folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions.text import WS_CHARS
from bitloom.llm import bitext, formats, leakage, lookalike, mixing, pairs, pieces, quality, residue
from bitloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(f: Callable[..., DataFrame], *tables: str) -> Query:
    """A query that hands whole tables to an operator."""
    return lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in tables])


def queries() -> dict[str, Query]:
    return {
        "p1_found": _over(residue.found, "trans_unit"),
        "p1_kinds": _over(residue.cases, "trans_unit"),
        "p1_evidence": _over(residue.evidence_counts, "trans_unit"),
        "p2_found": _over(pieces.found, "chunks_manifest", "chunk_file"),
        "p2_pieces": _over(pieces.pieces, "chunks_manifest", "chunk_file"),
        "p2_delivery": _over(pieces.delivery, "chunks_manifest", "chunk_file"),
        "p2_tiling": _over(pieces.tiling, "chunks_manifest", "chunk_file"),
        "p3_found": _over(lookalike.found, "terminology"),
        "p3_classes": _over(lookalike.members, "terminology"),
        "p4_found": _over(pairs.found, "trans_unit", "xliff_file"),
        "p4_defects": _over(pairs.defects, "trans_unit", "xliff_file"),
        "p5_found": _over(bitext.found, "trans_unit", "xliff_file", "base_lexicon"),
        "p5_links": _over(bitext.links, "trans_unit", "xliff_file", "base_lexicon"),
        "p6_found": _over(formats.found, "terminology", "glossary"),
        "p6_records": _over(formats.records, "terminology", "glossary"),
        "p7_found": _over(leakage.found, "documents", "eval_items"),
        "p7_items": _over(leakage.by_item, "documents", "eval_items"),
        "p8_selection": _over(mixing.selection, "documents", "mix_targets"),
        "p8_shares": _over(mixing.shares, "documents", "mix_targets"),
        "p9_found": _over(quality.found, "documents", "common_words"),
        "p9_statistics": lambda spark, d: _over(quality.statistics, "documents", "common_words")(spark, d).withColumn("reasons", F.array_join("reasons", ",")),
    }


# What formats.IGNORED leaves out, for an engine whose classes are ASCII.
_IGNORED = r"[\s\x0b\x{85}\p{Z}\p{P}!-/:-@\[-`{-~]+"


def _canonical(x: str) -> str:
    return f"regexp_replace(lower({x}), '{_IGNORED}', '', 'g')"


def _part(*cols: str) -> str:
    return " || chr(2) || ".join(f"coalesce('=' || {c}, '0')" for c in cols)


_TERM_A = _part(_canonical("source_lang"), _canonical("source"))
_TERM_B = _part(_canonical("target_lang"), _canonical("target"))
_KEYED = f"""
keyed as (
  select 'terminology' as table_name, term_id as id, least({_TERM_A}, {_TERM_B}) || chr(1) || greatest({_TERM_A}, {_TERM_B}) as k,
    {_part('source_lang', 'source', 'target_lang', 'target')} as raw from terminology
  union all select 'glossary', entry_id, {_part('direction')} || chr(1) || {_part(_canonical('term'))} || chr(1) || {_part('translation')},
    {_part('direction', 'term', 'translation')} from glossary)"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _times(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {_quoted(pattern)}))"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_quoted(pattern)})"


def _documents_sql() -> str:
    """The statistics of problem 9, line by line."""
    q, share = quality, "case when {1} > 0 then {0} / {1}::double else 0.0 end".format
    rules = (
        ("empty", "n_lines = 0"),
        ("word_count", f"han_share < 0.2 and (n_words < {q.MIN_WORDS} or n_words > {q.MAX_WORDS})"),
        ("word_length", f"han_share < 0.2 and (mean_word_length < {q.MIN_MEAN_WORD} or mean_word_length > {q.MAX_MEAN_WORD})"),
        ("symbols", f"han_share < 0.2 and symbols_per_word > {q.MAX_SYMBOLS_PER_WORD}"),
        ("bullet_lines", f"bullet_lines > {q.MAX_BULLET_LINES}"), ("ellipsis_lines", f"ellipsis_lines > {q.MAX_ELLIPSIS_LINES}"),
        ("alphabetic_words", f"han_share < 0.2 and alphabetic_words < {q.MIN_ALPHABETIC_WORDS}"), ("common_words", f"n_common < {q.MIN_COMMON_WORDS}"),
        ("ended_lines", f"ended_lines <= {q.MIN_ENDED_LINES}"), ("not_running_text", f"prose_share < {q.MIN_PROSE_SHARE}"),
    )
    reasons = ", ".join(f"case when {cond} then '{name}' end" for name, cond in rules)
    return f"""with known as (select list(distinct lower(word)) as ws, string_agg(distinct case when length(word) = 1 and ascii(word) > 127 then lower(word) end, '') as signs
  from common_words where word is not null),
split as (select row_number() over () as id, doc_id, coalesce(text, '') as text from documents),
raw as (select id, trim(unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))), {_quoted(WS_CHARS)}) as line from split),
bared as (select id, line, lower(regexp_replace(line, {_quoted(q.NOT_TEXT)}, '', 'g')) as bare from raw where line <> ''),
worded as (select *, list_filter(string_split(regexp_replace(bare, {_quoted(q.NO_LETTERS)}, ' ', 'g'), ' '), lambda w: w <> '') as found, {_times('bare', q.HAN)} as han,
  {_times('line', q.SYMBOL)} as symbols, {_has('line', q.BULLET)} as listed, {_has('line', q.TABLE)} as tabled, {_has('bare', q.MARK)} as mark, length(line) as chars from bared),
hit as (select w.*, len(found) as n, len(list_filter(found, lambda w: list_contains(ws, w))) as hits,
  case when signs is null or signs = '' then 0 else len(list_filter(string_split(bare, ''), lambda c: length(c) > 0 and contains(signs, c))) end as hits_han from worded w, known),
judged as (select *, not tabled and not {_has('line', q.OTHER)} and not (symbols > chars * {q.LINE_SYMBOLS} and {_times('bare', q.SYMBOL)} > length(bare) * {q.LINE_SYMBOLS})
  and not (listed and n < {q.ITEM_WORDS} and han < {q.ITEM_HAN}) and case when han >= {q.LINE_HAN} then (mark or han >= {q.LINE_HAN_UNENDED}) and hits_han > han * {q.LINE_COMMON_HAN}
  else n >= (case when mark then {q.LINE_WORDS} else {q.LINE_WORDS_UNENDED} end) and hits > n * {q.LINE_COMMON} end as good from hit),
summed as (select id, count(*) as n_lines, sum({_times('line', q.WORD)}) as n_words, sum({_times('line', f"[^{q._WS}]")}) as letters, sum({_times('line', q.WORD_WITH_LETTER)}) as alphabetic,
  sum(symbols) as symbols, sum({_times('line', q.SIGN)}) as signs, sum(case when han > 0 then hits_han else hits end) as common, sum(case when han > 0 then han else n end) as units, sum(han) as han,
  sum(chars) as line_chars, sum(case when good then chars else 0 end) as running, sum(listed::int) as bullet, sum(tabled::int) as tables, sum({_has('line', q.END)}::int) as ended,
  sum({_has('line', '(?:[.][.][.]|…)$')}::int) as ellipsis from judged group by id),
counted as (select doc_id, length(text) as n_chars, {", ".join(f"coalesce({c}, 0)::bigint as {c}" for c in (
    "n_lines", "n_words", "letters", "alphabetic", "symbols", "signs", "common", "units", "han", "line_chars", "running", "bullet", "tables", "ended", "ellipsis"))}
  from split left join summed using (id)),
shared as (select doc_id, n_chars, n_words, n_lines, common as n_common, {share('letters', 'n_words')} as mean_word_length, {share('symbols', 'n_chars')} as symbol_ratio,
  {share('signs', 'n_words')} as symbols_per_word, {share('ended', 'n_lines')} as ended_lines, {share('bullet', 'n_lines')} as bullet_lines, {share('tables', 'n_lines')} as table_lines,
  {share('ellipsis', 'n_lines')} as ellipsis_lines, {share('alphabetic', 'n_words')} as alphabetic_words, {share('common', 'units')} as common_share,
  {share('han', 'n_chars')} as han_share, {share('running', 'line_chars')} as prose_share from counted),
documents_measured as (select *, list_filter([{reasons}], lambda x: x is not null) as reasons from shared)"""


def _passages_sql() -> str:
    """The places of documents where a passage of an item stands: 12 words, or 24 letters of a Chinese item."""
    word = r"[\p{L}\p{N}]+"
    grams = "unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(list_slice(w, i, i + 11), ' ')))"
    runs = "unnest(list_transform(range(1, length(c) - 22), lambda i: substr(c, i, 24)))"
    return f"""with words as (select doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{word}') as w from documents),
items as (select item_id, item_lang like 'zh%' as zh, regexp_extract_all(replace(lower(item_text), 'ß', 'ss'), '{word}') as w from eval_items),
grams as (select doc_id, {grams} as g from words),
item_grams as (select distinct item_id, {grams} as g from items where not zh),
letters as (select doc_id, array_to_string(w, '') as c from words where len(w) > 0),
item_letters as (select item_id, array_to_string(w, '') as c from items where zh),
runs as (select distinct item_id, {runs} as r from item_letters where length(c) >= 24),
doc_runs as (select doc_id, {runs} as r from letters where length(c) >= 24),
hits as (select doc_id, item_id from grams join item_grams using (g) union all select doc_id, item_id from doc_runs join runs using (r))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """select manifest_id, chunk_no from chunk_file join chunks_manifest using (manifest_id)
where length(chunk_text) > case when chunk_size >= 1 then chunk_size else 5000 end""",
        "p2_tiling": """select manifest_id, chunk_no, any_value(length(chunk_text))::int as n_chars, true as within, true as overlapping, true as tiled,
  true as verbatim from chunk_file join chunks_manifest using (manifest_id)
where length(chunk_text) > case when chunk_size >= 1 then chunk_size else 5000 end group by manifest_id, chunk_no""",
        "p6_found": f"""with {_KEYED} select table_name, first_id, id as copy_id
from (select *, min(id) over (partition by table_name, k) as first_id from keyed) where id <> first_id""",
        "p6_records": f"with {_KEYED} select table_name, min(id) as first_id, count(*) as copies, count(distinct raw) as forms from keyed group by table_name, k",
        "p9_found": f"""{_documents_sql()} select doc_id from documents_measured
where len(list_filter(reasons, lambda x: not list_contains([{', '.join(map(_quoted, quality.HINTS))}], x))) > 0""",
        "p9_statistics": f"{_documents_sql()} select * replace (array_to_string(reasons, ',') as reasons) from documents_measured",
        "p7_found": f"{_passages_sql()} select distinct doc_id, item_id from hits",
        "p7_items": f"{_passages_sql()} select item_id, count(distinct doc_id) as documents, count(*) as hits from hits group by item_id",
    }
