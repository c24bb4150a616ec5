"""The queries of the core operators over the tables of a data folder, and their SQL.

Every query reads its whole tables. Where the tables lack a shape that an operator handles, its input is derived from all of
their rows by an expression that the SQL shares: chunk texts are dressed with Markdown of every kind, targets get fences and
lengths, and the earlier version of the translation units follows from their change types.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.functions import text as X
from bitloom.operators import align, chunk, delta, glossary, mask, qa, repair, segment, similarity
from bitloom.plans import selection
from bitloom.plans.export import export
from bitloom.runtime import checkpoint, ensure_checkpoint_dir, spread, table
from bitloom.sources import writers

Query = Callable[[SparkSession, str], DataFrame]


def _cells(spark: SparkSession, d: str, column: str) -> DataFrame:
    """(doc_id, seg_no, seg): one side of the cells of every file; of rows with one place the first loaded counts."""
    rows = table(spark, d, "trans_unit")
    first = rows.groupBy("file_id", "seg_no").agg(F.min_by(F.struct(column), "unit_key").alias("v"))
    return first.select(F.col("file_id").alias("doc_id"), "seg_no", F.coalesce(f"v.{column}", F.lit("")).alias("seg"))


def align_units(spark: SparkSession, d: str) -> DataFrame:
    pairs = align.align(_cells(spark, d, "source"), _cells(spark, d, "target"))
    return align.with_unit_ids(pairs)


def align_mismatches(spark: SparkSession, d: str) -> DataFrame:
    s, t = (_cells(spark, d, c).where("seg <> ''") for c in ("source", "target"))
    return align.count_mismatches(s, t)


def _version(spark: SparkSession, d: str, current: bool) -> DataFrame:
    """The units with a target, and an earlier state of all units: without the new ones, updated ones with another target, others with other line ends."""
    rows = table(spark, d, "trans_unit").select(
        F.col("file_id").alias("doc_id"), "unit_id", "unit_key", "project", F.coalesce("change_type", F.lit("")).alias("ct"),
        F.coalesce("source", F.lit("")).alias("src"), F.coalesce("target", F.lit("")).alias("tgt"),
    )
    if current:
        rows = rows.where(X.strip(F.col("tgt")) != "")
    else:
        rows = rows.where(F.col("ct") != "new").withColumn(
            "tgt", F.concat("tgt", F.when(F.col("ct") == "updated", " (earlier)").otherwise("\r\n"))
        )
    return delta.last_per_id(rows.drop("ct"), ["doc_id", "unit_id"], "unit_key")


def change_types(spark: SparkSession, d: str) -> DataFrame:
    return delta.classify(_version(spark, d, True), _version(spark, d, False)).select("doc_id", "unit_id", "unit_key", "change_type")


def changed_only(spark: SparkSession, d: str) -> DataFrame:
    rows = delta.classify(_version(spark, d, True), _version(spark, d, False))
    return delta.select_records(rows, True, True).groupBy("project").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("change_type") == "updated").alias("updated"), F.count_if(F.col("change_type") == "new").alias("added")
    )


def removed_units(spark: SparkSession, d: str) -> DataFrame:
    return delta.removed(_version(spark, d, True), _version(spark, d, False)).select("doc_id", "unit_id", "src", "tgt", "change_type")


def removed_map(spark: SparkSession, d: str) -> DataFrame:
    """The removed units written as a map and read again: place in the file, id and text."""
    gone = delta.removed(_version(spark, d, True), _version(spark, d, False)).withColumn("unit_id", F.concat_ws("/", "doc_id", "unit_id"))
    path = f"{ensure_checkpoint_dir(spark)}/removed_map-{uuid.uuid4().hex}"
    writers.write_removed(gone, True, path, "en", "xx")
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').select(
        "stable_id", F.coalesce("source_en", F.lit("")).alias("source_en"), "change_type", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row")
    )
    # whether each row comes after all before it, in the order of the parts
    before = F.max("stable_id").over(Window.orderBy("_file", "_row").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("sorted", F.coalesce(before <= F.col("stable_id"), F.lit(True))).drop("_file", "_row")


def _terms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The terms, those without a domain with a blank target, and their directed entries."""
    terms = table(spark, d, "terminology").withColumns({
        "domain": F.lower(X.strip(F.col("domain"))), "target": F.when(F.col("domain").isNull(), " ").otherwise(F.col("target")),
    })
    return terms, glossary.directed(terms, X.reversed_direction(F.col("source_lang"), F.col("target_lang")), "term_id", ["domain"])


def glossary_build(spark: SparkSession, d: str) -> DataFrame:
    return glossary.build(_terms(spark, d)[1], "term_id", ["domain"])


def glossary_collisions(spark: SparkSession, d: str) -> DataFrame:
    return glossary.collisions(_terms(spark, d)[1], "term_id", ["domain"])


def glossary_examples(spark: SparkSession, d: str) -> DataFrame:
    return glossary.examples(_terms(spark, d)[1], "term_id", ["domain"])


def glossary_summary(spark: SparkSession, d: str) -> DataFrame:
    terms = _terms(spark, d)[0]
    return glossary.summary(terms, X.reversed_direction(F.col("source_lang"), F.col("target_lang")), "term_id", ["domain"])


def domain_scores(spark: SparkSession, d: str) -> DataFrame:
    return glossary.domains(table(spark, d, "documents"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "trans_unit").select("unit_key", "source_lang", "target_lang", "source", "target")
    return spread(units).select(
        "unit_key", "source_lang", "target_lang", F.coalesce("source", F.lit("")).alias("src"), F.coalesce("target", F.lit("")).alias("tgt")
    )


def glossary_selection(spark: SparkSession, d: str) -> DataFrame:
    """The glossary that each document takes, by the domain of its text."""
    terms = _terms(spark, d)[0].withColumn("domain", F.when(F.col("domain") != "", F.col("domain")))
    summaries = glossary.summary(terms, X.reversed_direction(F.col("source_lang"), F.col("target_lang")), "term_id", ["domain"])
    return selection.select_for_documents(table(spark, d, "documents"), summaries)


def export_summary(spark: SparkSession, d: str) -> DataFrame:
    """The export of every chunk against an earlier one, incremental, with a glossary: a row of figures for each."""
    t = F.col("text")
    docs = _markdown(spark, d).withColumnRenamed("chunk_path", "doc_id")
    target = docs.withColumn("text", F.replace(F.replace(t, F.lit("1. third"), F.lit("1. dritte")), F.lit("| a | b |\n"), F.lit("")))
    old_source = docs.withColumn("text", F.concat(F.replace(t, F.lit("- first"), F.lit("- former")), F.lit("\n```\n\nGone")))
    old_target = docs.withColumn("text", F.replace(t, F.lit("1. third"), F.lit("1. dritter")))
    earlier = checkpoint(align.with_unit_ids(align.align(*(segment.segments(x) for x in (old_source, old_target)))))
    terms = spark.createDataFrame([("third", "dritter"), ("Part", "Part"), ("", "x")], "term string, translation string").where("term <> ''")
    return export(docs, target, earlier, terms, only_changed=True, threshold="error").summary


def _flag_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with targets of other lengths and with fences, by their place in the file."""
    place, t = F.col("seg_no") % 10, F.coalesce("target", F.lit(""))
    return table(spark, d, "trans_unit").select(
        "unit_key", "project", F.coalesce("change_type", F.lit("")).alias("change_type"), F.coalesce("source", F.lit("")).alias("src"),
        F.when(place == 7, F.repeat(F.concat(t, F.lit(" ")), F.lit(7))).when(place == 3, F.concat(F.lit("```\n"), t)).otherwise(t).alias("tgt"),
    )


def qa_flags(spark: SparkSession, d: str) -> DataFrame:
    # the message of a length shows a rounded ratio, which engines round otherwise
    return qa.pair_flags(_flag_pairs(spark, d), ["unit_key"]).withColumn("message", F.split_part("message", F.lit(" ("), F.lit(1)))


def _lexicon_terms(spark: SparkSession, d: str) -> DataFrame:
    """The lexicon as a glossary of each language pair: the first translation of each word."""
    lex = table(spark, d, "base_lexicon")
    a = lex.select("concept_id", F.col("lang").alias("sl"), F.col("word").alias("term"))
    b = lex.select("concept_id", F.col("lang").alias("tl"), F.col("word").alias("translation"))
    both = a.join(b, "concept_id").where("sl <> tl and term is not null and translation is not null")
    order = F.struct("concept_id", "translation")
    return both.groupBy("sl", "tl", "term").agg(F.min_by("translation", order).alias("translation"))


def qa_term_flags(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d).withColumns({
        "sl": F.substring(X.lang_prefix(F.col("source_lang")), 1, 2), "tl": F.substring(X.lang_prefix(F.col("target_lang")), 1, 2),
    })
    return qa.term_flags(pairs, _lexicon_terms(spark, d), ["unit_key"], on=["sl", "tl"]).select("unit_key", "flag_type", "message")


def qa_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate at each threshold."""
    flags = qa.pair_flags(_flag_pairs(spark, d), ["unit_key"]).select("severity")
    mild = flags.where("severity = 'warning'")
    gates = [qa.gate(f, t).withColumn("threshold", F.lit(f"{name} {t}")) for name, f in (("all", flags), ("mild", mild), ("none", mild.limit(0))) for t in qa.RANK]
    return functools.reduce(DataFrame.unionByName, gates)


# Markdown around the text of a chunk: of every kind, sound and broken.
_BEFORE = "## Part\n- first **bold ** and ** more**\n-second\n1. third\n| a | b |\n\n"
_AFTER = "\n\n## Notes\nInline `a<b` in <div class=\"k\">`deep` text</div>, $x+y$ and $$z = 1$$, <br/> <SPAN>s</SPAN>\n[label] (target)  {{PH_MATH_BLOCK_300}}  end\n"
_ENDS = ("```py\nx = 1", "odd ` tick, {{PH_HTML_900}} and {{PH_CODE_BLOCK_100}}", "a [broken](link and ](more", "  ```sh  \nls\n```\n")


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    end = F.lit(_ENDS[3])
    for k in range(3):
        end = F.when(F.col("chunk_no") % 4 == k, _ENDS[k]).otherwise(end)
    return table(spark, d, "chunk_file").select(
        "chunk_path", F.concat(F.lit(_BEFORE), F.coalesce("chunk_text", F.lit("")), F.lit(_AFTER), end).alias("text")
    )


def segments(spark: SparkSession, d: str) -> DataFrame:
    return segment.segments(_markdown(spark, d), "chunk_path")


def mask_regions(spark: SparkSession, d: str) -> DataFrame:
    """The protected regions of all Markdown chunks and unit sources, one row each."""
    texts = _markdown(spark, d).unionByName(table(spark, d, "trans_unit").select(
        F.concat(F.lit("unit/"), F.col("unit_key").cast("string")).alias("chunk_path"), F.col("source").alias("text")
    ))
    return texts.select("chunk_path", mask.protect(F.col("text")).alias("p")).select("chunk_path", F.explode("p.regions").alias("r")).select(
        "chunk_path", "r.ord", "r.token", "r.original"
    )


def mask_restore(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after masking and restoring, in order of creation and in reverse."""
    done = _markdown(spark, d).select("chunk_path", mask.protect(F.col("text")).alias("p"))
    return done.select("chunk_path", *[mask.restore(F.col("p.masked"), F.col("p.regions"), order).alias(order) for order in ("creation", "reverse")])


def repaired(spark: SparkSession, d: str) -> DataFrame:
    return _markdown(spark, d).select("chunk_path", repair.repair(F.col("text")).alias("text"))


def syntax_errors(spark: SparkSession, d: str) -> DataFrame:
    found = _markdown(spark, d).select("chunk_path", F.explode(qa.syntax_errors(F.col("text"))).alias("error"))
    units = table(spark, d, "trans_unit").select(
        F.concat(F.lit("unit/"), F.col("unit_key").cast("string")).alias("chunk_path"),
        F.explode(qa.syntax_errors(F.coalesce("target", F.lit("")))).alias("error"),
    )
    return found.unionByName(units)


def length_profile(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", X.char_count(t).alias("chars"), X.word_count(t).alias("words"), X.token_estimate(t).alias("tokens"), X.route(t).alias("route")
    )


def line_kinds(spark: SparkSession, d: str) -> DataFrame:
    lines = _markdown(spark, d).select(F.explode(F.split(X.newlines(F.col("text")), "\n", -1)).alias("x"))
    x = F.col("x")
    return lines.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(X.is_heading(x)).alias("headings"), F.count_if(X.is_unordered_item(x)).alias("items"),
        F.count_if(X.is_ordered_item(x)).alias("numbered"), F.count_if(X.is_table_row(x)).alias("rows"), F.count_if(X.is_fence(x)).alias("fences"),
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunks(_markdown(spark, d), 800, "chunk_path")


def chunk_manifest(spark: SparkSession, d: str) -> DataFrame:
    return chunk.manifest(_markdown(spark, d), 800, "chunk_path").withColumn("chunks", F.array_join("chunks", ","))


def delivered_chunks(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "chunks_manifest").select("manifest_id", "chunk_count", F.size("chunks").cast("long").alias("listed"))
    came = table(spark, d, "chunk_file").groupBy("manifest_id").agg(F.count(F.lit(1)).alias("delivered"))
    return listed.join(came, "manifest_id", "left").na.fill(0, ["delivered"])


def diff_rates(spark: SparkSession, d: str) -> DataFrame:
    """How much each target differs from its source."""
    units = table(spark, d, "trans_unit").select("unit_key", "source", "target")
    return similarity.quality_gate(similarity.diff_rates(spread(units), "source", "target", ["unit_key"]))


def long_diff_rates(spark: SparkSession, d: str) -> DataFrame:
    """The same for texts over the bound of the exact distance: each revision against its parent."""
    docs = table(spark, d, "documents")
    old = docs.groupBy("rev_id").agg(F.min_by("text", "doc_id").alias("before"))
    both = docs.select("doc_id", "text", F.col("parent_rev_id").alias("rev_id")).join(old, "rev_id")
    long = both.where(F.greatest(F.length("text"), F.length("before")) > similarity.EXACT_CHARS)
    return similarity.quality_gate(similarity.diff_rates(long, "before", "text", ["doc_id"]))


def normalized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "trans_unit").select("unit_key", X.normalize_segment(F.col("target")).alias("target"))


def xliff_documents(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "xliff_file").select(F.col("file_id").alias("doc_id"), "original", "source_lang", "target_lang")
    pairs = align_units(spark, d).join(files, "doc_id")
    return writers.xliff_documents(pairs, F.col("source_lang"), F.col("target_lang"), F.col("original"))


def tmx_documents(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "xliff_file").select(F.col("file_id").alias("doc_id"), "source_lang", "target_lang", "exported_at")
    pairs = align_units(spark, d).join(files, "doc_id")
    return writers.tmx_documents(pairs, F.col("source_lang"), F.col("target_lang"), F.col("exported_at"))


def directions(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("source_lang"), F.col("target_lang")
    return table(spark, d, "xliff_file").select(
        "file_id", X.lang_prefix(a).alias("source_prefix"), X.lang_prefix(b).alias("target_prefix"), X.reversed_direction(a, b).alias("reversed")
    )


def progress_lines(spark: SparkSession, d: str) -> DataFrame:
    """A progress line for each file, with its units as elapsed seconds of ninety."""
    spent = F.col("n_units").cast("long")
    return table(spark, d, "xliff_file").select("file_id", X.progress_line(
        F.lit(2), F.lit(6), F.col("project"), F.lit("RUNNING"), X.eta_detail(spent, F.lit(90))
    ).alias("line"))


def project_summary(spark: SparkSession, d: str) -> DataFrame:
    s, t = (X.normalize_segment(F.col(c)) for c in ("src", "tgt"))
    counted = _flag_pairs(spark, d).select("project", "change_type", F.size(qa.flags_of(s, t)).alias("n"))
    return counted.groupBy("project").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("qa_flags"), F.count_if(F.col("change_type") != "unchanged").alias("changed_pairs"),
    )


def queries() -> dict[str, Query]:
    found = (
        align_units, align_mismatches, change_types, changed_only, removed_units, removed_map, glossary_build, glossary_collisions,
        glossary_examples, glossary_summary, glossary_selection, domain_scores, qa_flags, qa_term_flags, qa_gate, segments, mask_regions, mask_restore,
        repaired, syntax_errors, length_profile, line_kinds, chunks, chunk_manifest, delivered_chunks, diff_rates, long_diff_rates, normalized,
        xliff_documents, tmx_documents, directions, progress_lines, project_summary, export_summary,
    )
    return {f.__name__: f for f in found}


# SQL for the same rows. White space as a class body, since \s of the SQL engine is ASCII.
_W = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{_W}]+|[{_W}]+\z', '', 'g')"


def _lf(x: str) -> str:
    return rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"


def _normal(x: str) -> str:
    return _strip(rf"regexp_replace({_lf(x)}, '[ \t]+', ' ', 'g')")


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _xml(x: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}', '{safe}')"
    return x


def _duration(x: str) -> str:
    return f"case when {x} < 60 then {x} || 's' else ({x} // 60) || 'm' || lpad(({x} % 60)::varchar, 2, '0') || 's' end"


_CELLS = """
cells as (select file_id, seg_no, source, target from trans_unit
  qualify row_number() over (partition by file_id, seg_no order by unit_key) = 1),
pairs as (select file_id as doc_id, seg_no, coalesce(source, '') as src, coalesce(target, '') as tgt from cells
  where coalesce(source, '') <> '' or coalesce(target, '') <> ''),
based as (select *, substr(sha1(case when src <> '' then src
    else '_empty_source_' || row_number() over (partition by doc_id order by seg_no) end), 1, 12) as base from pairs),
units as (select doc_id, seg_no, src, tgt, 'seg-' || base || case when n > 1 then '-' || n else '' end as unit_id
  from (select *, row_number() over (partition by doc_id, base order by seg_no) as n from based))"""

_VERSIONS = f"""
cur as (select file_id as doc_id, unit_id, unit_key, project, coalesce(source, '') as src, target as tgt from trans_unit
  where {_strip("coalesce(target, '')")} <> '' qualify row_number() over (partition by file_id, unit_id order by unit_key desc) = 1),
old as (select file_id as doc_id, unit_id, coalesce(source, '') as src,
    coalesce(target, '') || case when change_type = 'updated' then ' (earlier)' else chr(13) || chr(10) end as tgt from trans_unit
  where coalesce(change_type, '') <> 'new' qualify row_number() over (partition by file_id, unit_id order by unit_key desc) = 1),
typed as (select c.*, case when o.unit_id is null then 'new'
    when {_strip(_lf('c.src'))} = {_strip(_lf('o.src'))} and {_strip(_lf('c.tgt'))} = {_strip(_lf('o.tgt'))} then 'unchanged'
    else 'updated' end as change_type from cur c left join old o using (doc_id, unit_id)),
gone as (select doc_id, unit_id, src, tgt, 'removed' as change_type from old anti join cur using (doc_id, unit_id))"""


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_DRESSED = f"""dressed as (select chunk_path, {_literal(_BEFORE)} || coalesce(chunk_text, '') || {_literal(_AFTER)} ||
  case chunk_no % 4 when 0 then {_literal(_ENDS[0])} when 1 then {_literal(_ENDS[1])} when 2 then {_literal(_ENDS[2])} else {_literal(_ENDS[3])} end as text from chunk_file)"""


def _masked_sql() -> str:
    """The passes of masking, one after the other: ``masked`` has text, regions and number of the next token."""
    tags = mask.TAGS.split("|")
    patterns = (
        "(?s)```.*?```", "`[^`]+`", r"(?s)\$\$.*?\$\$", rf"\$[^{_W}$][^$]*[^{_W}$]\$", rf"(?i)<(?:{mask.TAGS})(?:[{_W}]+[^<>]*?)?[{_W}]*/>",
        "(?is)" + "|".join(rf"<{t}(?:[{_W}]+[^<>]*?)?>.*?</{t}>" for t in tags),
    )
    steps, last = [], "masked0"
    for k, ((kind, _), pattern) in enumerate(zip(mask.PASSES, patterns), 1):
        steps.append(f"""split{k} as (select chunk_path, n, es, regexp_extract_all(t, '{pattern}') as f, string_split_regex(t, '{pattern}') as parts from {last}),
masked{k} as (select chunk_path, n + len(f) as n, list_concat(es, list_transform(range(0, len(f)), lambda i: {{'ord': (n + i)::int, 'token': '{{{{PH_{kind}_' || (n + i) || '}}}}', 'original': f[i + 1]}})) as es,
  array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || case when i <= len(f) then '{{{{PH_{kind}_' || (n + i - 1) || '}}}}' else '' end), '') as t from split{k})""")
        last = f"masked{k}"
    start = "[]::struct(ord int, token varchar, original varchar)[]"
    return f"""masked0 as (select chunk_path, 0::bigint as n, {start} as es, text as t from texts),
{", ".join(steps)}, masked as (select * from {last})"""


def _prefix(x: str) -> str:
    return f"split_part(lower({_strip(f'coalesce({x}, chr(32))')}), '-', 1)"


_TERMS = f"""
trimmed as (select term_id, lower({_strip('domain')}) as domain, {_strip("coalesce(source, '')")} as s, {_strip("case when domain is null then ' ' else coalesce(target, '') end")} as t,
    {_prefix('source_lang')} like 'zh%' and {_prefix('target_lang')} like 'en%' as reversed from terminology),
directed as (select domain, term_id, case when reversed then t else s end as term, case when reversed then s else t end as translation
  from trimmed where s <> '' and t <> ''),
first as (select domain, term, translation from directed
  qualify row_number() over (partition by domain, term order by term_id) = 1),
clash as (select d.domain, d.term_id, d.term, f.translation as kept, d.translation as dropped from directed d
  join first f on d.domain is not distinct from f.domain and d.term = f.term where d.translation <> f.translation)"""

_FLAGS = f"""
derived as (select *, coalesce(target, '') as x from trans_unit),
normal as (select unit_key, {_normal("coalesce(source, '')")} as s,
  {_normal("case seg_no % 10 when 7 then repeat(x || ' ', 7) when 3 then '```' || chr(10) || x else x end")} as t from derived),
flags as (
  select unit_key, 'missing_target' as flag_type, 'error' as severity, 'target segment is empty' as message from normal where s <> '' and t = ''
  union all select unit_key, 'unchanged_text', 'warning', 'source and target are identical' from normal where s <> '' and s = t and regexp_matches(s, '[A-Za-z]')
  union all select unit_key, 'placeholder_leak', 'error', 'target still contains placeholder tokens' from normal where regexp_matches(t, '\\{{\\{{PH_[A-Z_0-9]+\\}}\\}}')
  union all select unit_key, 'length_too_short', 'warning', 'target/source length ratio is very small' from normal where s <> '' and t <> '' and length(t)::double / length(s) < 0.2
  union all select unit_key, 'length_too_long', 'warning', 'target/source length ratio is very large' from normal where s <> '' and t <> '' and length(t)::double / length(s) > 5.0
  union all select unit_key, 'code_fence_mismatch', 'warning', 'source/target code fence parity differs' from normal where {_count('s', '(?m)^```')} % 2 <> {_count('t', '(?m)^```')} % 2)"""

def _segments(text: str, n: str = "") -> str:
    """CTEs up to ``segs``, with a suffix, of an expression over the dressed texts."""
    return f"""
chunk_texts{n} as (select chunk_path, {_lf(text)} as text from dressed),
lines{n} as (select chunk_path, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos from chunk_texts{n}),
marked{n} as (select *, regexp_matches(line, '^[{_W}]*```') as fence from lines{n}),
numbered{n} as (select *, sum(fence::int) over (partition by chunk_path order by pos) as n from marked{n}),
kinds{n} as (select *, case when fence or n % 2 = 1 then 'code' when regexp_matches(line, '^[{_W}]*$') then 'blank'
    when regexp_matches(line, '^[{_W}]{{0,3}}#{{1,6}}[{_W}]+[^{_W}]') then 'heading'
    when regexp_matches(line, '^[{_W}]{{0,3}}([-*+]|[0-9]+\\.)[{_W}]+[^{_W}]') then 'list'
    when regexp_matches({_strip('line')}, '^\\|') and regexp_matches({_strip('line')}, '\\|$') then 'table' else 'paragraph' end as kind from numbered{n}),
starts{n} as (select *, case when kind = 'code' then (fence and n % 2 = 1)::int when kind = 'blank' then 0
    when kind = 'paragraph' then (coalesce(lag(kind) over (partition by chunk_path order by pos), '') <> 'paragraph')::int else 1 end as start from kinds{n}),
grouped{n} as (select *, sum(start) over (partition by chunk_path order by pos) as g from starts{n} where kind <> 'blank'
  or n % 2 = 1),
joined{n} as (select chunk_path, g, min(kind) as kind, case when min(kind) = 'code' then {_strip("string_agg(line, chr(10) order by pos)")}
    when min(kind) = 'paragraph' then {_normal(f"string_agg({_strip('line')}, ' ' order by pos)")} else {_normal("min(line)")} end as seg from grouped{n} group by chunk_path, g),
segs{n} as (select chunk_path, row_number() over (partition by chunk_path order by g) as seg_no, kind, seg from joined{n} where seg <> '')"""


_SEGMENTS = _DRESSED + ", " + _segments("text")


def _bare(x: str) -> str:
    return rf"regexp_replace({x}, '(?ms)^```.*?^```[ \t]*\n?', '', 'g')"


def _errors(key: str, x: str, source: str) -> str:
    lone = rf"regexp_replace(regexp_replace({_bare('x')}, '``[^`]*``', '', 'g'), '``+', '', 'g')"
    token = r"\{\{PH_[A-Z_0-9]+\}\}"
    base = f"(select {key} as chunk_path, coalesce({x}, '') as x from {source})"
    return f"""
  select chunk_path, 'Unclosed code fence detected.' as error from {base} where {_count('x', '(?m)^```')} % 2 <> 0
  union all select chunk_path, 'Unbalanced inline backticks detected.' from {base} where {_count(lone, '`')} % 2 <> 0
  union all select chunk_path, 'Unrestored placeholders detected: ' || array_to_string(list_sort(list_distinct(regexp_extract_all(x, '{token}'))), ', ')
    from {base} where regexp_matches(x, '{token}')
  union all select chunk_path, 'Malformed Markdown links detected.' from {base}
    where {_count(_bare('x'), chr(92) + ']' + chr(92) + '(')} > {_count(_bare('x'), r'\[[^\]\n]+\]\([^)]+\)')}"""


def _repaired(x: str) -> str:
    steps = (
        (r"\*\*[ \t]+([^\n]*?)\*\*", r"**\1**"), (r"\*\*([^\n]*?)[ \t]+\*\*", r"**\1**"), (rf"(?m)^([{_W}]*)([-*+])([^{_W}])", r"\1\2 \3"),
        (r"(?m)^[ \t]*```([^\n`]*?)[ \t]+$", r"```\1"), (r"\][ \t]+\(", "]("), (r"[ \t]+(\{\{PH_[A-Z_0-9]+\}\})", r"\1"),
        (r"(\{\{PH_[A-Z_0-9]+\}\})[ \t]+", r"\1"),
    )
    for pattern, replacement in steps:
        x = f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"
    return x


def _domain_sql() -> str:
    def values(words: tuple[str, ...], weight: int, first: int) -> list[str]:
        return [f"({first + i}, '{w}', {weight})" for i, w in enumerate(words)]

    rows = values(glossary.STRONG_KEYWORDS, 2, 0) + values(glossary.WEAK_KEYWORDS, 1, len(glossary.STRONG_KEYWORDS))
    return f"""with words(ord, kw, weight) as (values {', '.join(rows)}),
hits as (select doc_id, ord, kw, weight from documents, words where contains(lower(coalesce(text, '')), kw)),
scored as (select doc_id, sum(weight)::int as score, array_to_string(list_slice(list(kw order by ord), 1, {glossary.MATCHES_KEPT}), ',') as matches
  from hits group by doc_id)
select d.doc_id, coalesce(score, 0) as score, coalesce(matches, '') as matches,
  case when coalesce(score, 0) >= {glossary.DOMAIN_SCORE} then 'ecommerce' else 'default' end as domain
from documents d left join scored s using (doc_id)"""


def _term_sql() -> str:
    def has(text: str, term: str) -> str:
        quoted = rf"regexp_replace({term}, '([^A-Za-z0-9_\x80-\x{{10ffff}}])', '\\\1', 'g')"
        return (
            f"case when not contains(lower({text}), lower({term})) then false when regexp_matches({term}, '[A-Za-z0-9]') then regexp_matches({text}, '(?i)(^|[^A-Za-z0-9_])' || {quoted} || '($|[^A-Za-z0-9_])') "
            f"else contains({text}, {term}) end"
        )

    return f"""with normal as (select unit_key, substr({_prefix('source_lang')}, 1, 2) as sl, substr({_prefix('target_lang')}, 1, 2) as tl,
    {_normal("coalesce(source, '')")} as s, {_normal("coalesce(target, '')")} as t from trans_unit),
lex as (select a.lang as sl, b.lang as tl, a.word as term, b.word as translation from base_lexicon a join base_lexicon b using (concept_id)
  where a.lang <> b.lang qualify row_number() over (partition by a.lang, b.lang, a.word order by concept_id, b.word) = 1)
select unit_key, 'term_inconsistency' as flag_type, 'expected terminology ''' || term || ''' -> ''' || translation || '''' as message
from normal join lex using (sl, tl) where s <> '' and t <> '' and not starts_with(s, '```') and {has('s', 'term')} and not {has('t', 'translation')}"""


def _chunks_sql(size: int) -> str:
    """Sections of the dressed texts, and their packing as a recursion over the parts: ``packed`` has a list of chunks."""
    ends = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
    return f"""with recursive {_DRESSED},
cut as (select chunk_path, text, string_split_regex(text, '(?m)^##[{_W}]+') as parts from dressed),
listed as (select chunk_path, text, len(parts) as n, unnest(parts) as p, unnest(range(0, len(parts))) as i from cut),
headed as (select *, string_split_regex({_strip("p")}, '{ends}') as ls from listed),
sectioned as (select chunk_path, text, n, i, case when i = 0 then {_strip("p")} else {_strip("'## ' || " + _strip("ls[1]") + " || chr(10) || array_to_string(ls[2:], chr(10))")} end as x, {_strip("p")} <> '' as whole from headed),
sections as (select chunk_path, i, x from sectioned where n > 1 and whole union all select chunk_path, 0, any_value(text) from sectioned group by chunk_path having any_value(n) <= 1 or not bool_or(whole)),
parts as (select chunk_path, i, 0 as j, x, false as f from sections where length(x) <= {size} union all
  select chunk_path, i, row_number() over (partition by chunk_path, i order by j) as j, x, row_number() over (partition by chunk_path, i order by j) = 1 as f
  from (select chunk_path, i, unnest(string_split(x, chr(10) || chr(10))) as x, unnest(range(0, len(string_split(x, chr(10) || chr(10))))) as j from sections where length(x) > {size})
  where not regexp_matches(x, '^[{_W}]*$')),
ordered as (select chunk_path, row_number() over (partition by chunk_path order by i, j) as k, x, f, length(x) as n from parts),
folded as (select chunk_path, 0::bigint as k, []::varchar[] as done, null::varchar as cur, 0::bigint as size from dressed
  union all select o.chunk_path, o.k,
    case when o.n > {size} then list_concat(done, case when cur is null then [] else [cur] end, list_transform(range(0, (o.n - 1) // {size} + 1), lambda i: substr(o.x, i * {size} + 1, {size})))
      when cur is not null and (o.f or size + o.n + 2 > {size}) then list_append(done, cur) else done end,
    case when o.n > {size} then null when cur is null or o.f or size + o.n + 2 > {size} then o.x else cur || chr(10) || chr(10) || o.x end,
    case when o.n > {size} then 0 when cur is null or o.f or size + o.n + 2 > {size} then o.n else size + o.n + case when size > 0 then 2 else 0 end end
  from folded c join ordered o on c.chunk_path = o.chunk_path and o.k = c.k + 1),
last as (select chunk_path, case when cur is null then done else list_append(done, cur) end as chunks from folded qualify row_number() over (partition by chunk_path order by k desc) = 1),
packed as (select chunk_path, case when len(chunks) = 0 then [''] else chunks end as chunks from last)"""


def _export_sql() -> str:
    """Segments of the present and the earlier sides, pairs with ids, change types, flags, and figures for each document."""
    def ids(n: str, s: str, t: str) -> str:
        return f"""pairs{n} as (select coalesce(a.chunk_path, b.chunk_path) as doc_id, coalesce(a.seg_no, b.seg_no) as i, coalesce(a.seg, '') as src, coalesce(b.seg, '') as tgt
  from segs{s} a full join segs{t} b on a.chunk_path = b.chunk_path and a.seg_no = b.seg_no),
base{n} as (select *, substr(sha1(case when src <> '' then src else '_empty_source_' || row_number() over (partition by doc_id order by i) end), 1, 12) as h from pairs{n}),
units{n} as (select *, h || '-' || row_number() over (partition by doc_id, h order by i) as id from base{n})"""

    def term(text: str, word: str) -> str:
        return f"regexp_matches({text}, '(?i)(^|[^A-Za-z0-9_]){word}($|[^A-Za-z0-9_])')"

    row = "'| a | b |' || chr(10)"
    target = f"replace(replace(text, '1. third', '1. dritte'), {row}, '')"
    old = "replace(text, '- first', '- former') || chr(10) || '```' || chr(10) || chr(10) || 'Gone'"
    flags = f"""(s <> '' and t = '')::int + (s <> '' and s = t and regexp_matches(s, '[A-Za-z]'))::int + regexp_matches(t, '\\{{\\{{PH_[A-Z_0-9]+\\}}\\}}')::int
  + (s <> '' and t <> '' and (length(t)::double / length(s) < 0.2 or length(t)::double / length(s) > 5.0))::int + ({_count('s', '(?m)^```')} % 2 <> {_count('t', '(?m)^```')} % 2)::int"""
    errors = "(s <> '' and t = '') or regexp_matches(t, '\\{\\{PH_[A-Z_0-9]+\\}\\}')"
    terms = " + ".join(f"(s <> '' and t <> '' and not starts_with(s, '```') and {term('s', a)} and not {term('t', b)})::int" for a, b in (("third", "dritter"), ("Part", "Part")))
    return f"""with {_DRESSED}, {_segments("text", "1")}, {_segments(target, "2")}, {_segments(old, "3")}, {_segments("replace(text, '1. third', '1. dritter')", "4")},
{ids("n", "1", "2")}, {ids("o", "3", "4")},
typed as (select c.*, case when o.id is null then 'new' when {_strip('c.src')} = {_strip('o.src')} and {_strip('c.tgt')} = {_strip('o.tgt')} then 'unchanged' else 'updated' end as ct
  from unitsn c left join unitso o using (doc_id, id)),
gone as (select doc_id, count(*) as n from (select doc_id, id from unitso except select doc_id, id from unitsn) group by doc_id),
flagged as (select doc_id, {flags} + {terms} as n, ({errors})::int as bad, ({flags}) + ({terms}) > 0 as any_flag
  from (select doc_id, {_normal('src')} as s, {_normal('tgt')} as t from typed where ct <> 'unchanged')),
summed as (select doc_id, sum(n) as n, max(bad) as bad, bool_or(any_flag) as any_flag from flagged group by doc_id)
select doc_id, count(*) filter (ct <> 'unchanged') as pairs, count(*) filter (src <> '') as source_segments, count(*) filter (tgt <> '') as target_segments,
  count(*) filter (ct <> 'unchanged') as changed_pairs, coalesce(any_value(g.n), 0) as removed_pairs, count(*) as stable_ids, true as incremental, coalesce(any_value(f.n), 0)::bigint as qa_flags,
  2::bigint as glossary_terms, case when any_value(f.bad) = 1 then 'error' when any_value(f.any_flag) then 'warning' else 'none' end as max_severity, 'error' as fail_on_severity,
  case when any_value(f.bad) = 1 then 2 else 0 end as exit_code
from typed left join gone g using (doc_id) left join summed f using (doc_id) group by doc_id"""


def oracle_sql() -> dict[str, str]:
    percent = "least(100, n_units * 100 // 90)"
    return {
        "align_units": f"with {_CELLS} select doc_id, seg_no, src, tgt, unit_id from units",
        "align_mismatches": f"""with {_CELLS}, n as (select doc_id, count(*) filter (src <> '') as source_segments, count(*) filter (tgt <> '') as target_segments
from pairs group by doc_id) select * from n where source_segments <> target_segments""",
        "change_types": f"with {_VERSIONS} select doc_id, unit_id, unit_key, change_type from typed",
        "changed_only": f"""with {_VERSIONS} select project, count(*) as pairs, count(*) filter (change_type = 'updated') as updated, count(*) filter (change_type = 'new') as added
from typed where change_type <> 'unchanged' group by project""",
        "removed_units": f"with {_VERSIONS} select * from gone",
        "removed_map": f"with {_VERSIONS} select doc_id || '/' || unit_id as stable_id, src as source_en, change_type, true as sorted from gone",
        "glossary_build": f"with {_TERMS} select domain, term, translation from first",
        "glossary_collisions": f"with {_TERMS} select domain, term_id, term, kept, dropped from clash",
        "glossary_examples": f"""with {_TERMS} select domain, term_id, term, kept, dropped, row_number() over (partition by domain order by term_id)::int as example_no
from clash qualify row_number() over (partition by domain order by term_id) <= {glossary.EXAMPLES_KEPT}""",
        "glossary_summary": f"""with {_TERMS}, n as (select domain, count(*) as n, count(*) filter (s = '' or t = '') as skipped_count from trimmed group by domain)
select n.domain, (select count(*) from first f where f.domain is not distinct from n.domain) as term_count, skipped_count,
  (select count(*) from clash c where c.domain is not distinct from n.domain) as collision_count from n""",
        "glossary_selection": f"""with {_TERMS}, kept as (select nullif(domain, '') as domain, count(*) as n from (select distinct nullif(domain, '') as domain, term from directed) group by 1),
scored as ({_domain_sql()}), own as (select doc_id, score, k.n, case when k.n is null then 'default' else scored.domain end as selected_domain from scored left join kept k using (domain))
select doc_id, score, selected_domain, coalesce(n, (select k.n from kept k where k.domain is null), 0) as term_count from own""",
        "domain_scores": _domain_sql(),
        "export_summary": _export_sql(),
        "chunks": _chunks_sql(800) + """ select chunk_path, unnest(range(1, len(chunks) + 1))::int as chunk_no, unnest(list_transform(range(1, len(chunks) + 1), lambda i: printf('chunk_%03d.md', i))) as name,
  unnest(chunks) as chunk from packed""",
        "chunk_manifest": _chunks_sql(800) + """ select chunk_path, 800 as chunk_size, len(chunks)::int as chunk_count,
  array_to_string(list_transform(range(1, len(chunks) + 1), lambda i: printf('chunk_%03d.md', i)), ',') as chunks from packed""",
        "qa_flags": f"with {_FLAGS} select unit_key, flag_type, severity, message from flags",
        "qa_term_flags": _term_sql(),
        "qa_gate": f"""with {_FLAGS}, sets(name, least, most) as (values ('all', 1, 2), ('mild', 1, 1), ('none', 0, 0)), ranks(threshold, r) as (values ('none', 0), ('warning', 1), ('error', 2)),
ranked as (select case severity when 'error' then 2 else 1 end as r, count(*) as n from flags group by 1),
worst as (select name, coalesce((select max(r) from ranked where r between least and most), 0) as m from sets)
select name || ' ' || threshold as threshold, ['none', 'warning', 'error'][m + 1] as max_severity, r > 0 and m >= r as failed from worst, ranks""",
        "segments": f"with {_SEGMENTS} select chunk_path, seg_no::int as seg_no, kind, seg from segs",
        "mask_regions": f"""with {_DRESSED}, texts as (select chunk_path, text from dressed union all select 'unit/' || unit_key, source from trans_unit where source is not null),
{_masked_sql()}, each as (select chunk_path, unnest(es) as e from masked) select chunk_path, e.ord as ord, e.token as token, e.original as original from each""",
        "mask_restore": f"""with {_DRESSED}, texts as (select chunk_path, text from dressed), {_masked_sql()}
select chunk_path, text as reverse, list_reduce(list_prepend({{'token': '', 'original': t}}, list_transform(es, lambda e: {{'token': e.token, 'original': e.original}})),
  lambda a, e: {{'token': '', 'original': replace(a.original, e.token, e.original)}}).original as creation from masked join dressed using (chunk_path)""",
        "repaired": f"with {_DRESSED} select chunk_path, {_repaired('text')} as text from dressed",
        "syntax_errors": f"with {_DRESSED} " + _errors("chunk_path", "text", "dressed") + " union all " + _errors("'unit/' || unit_key", "target", "trans_unit"),
        "length_profile": f"""select doc_id, length(text)::int as chars, {_count('text', f'[^{_W}]+')}::int as words, (length(text) // 3)::int as tokens,
  case when length(text) > 5000 then 'SPLIT' else 'OK' end as route from documents""",
        "line_kinds": f"""with {_SEGMENTS} select count(*) as lines, count(*) filter (regexp_matches(line, '^[{_W}]{{0,3}}#{{1,6}}[{_W}]+[^{_W}]')) as headings,
  count(*) filter (regexp_matches(line, '^[{_W}]{{0,3}}[-*+][{_W}]+[^{_W}]')) as items, count(*) filter (regexp_matches(line, '^[{_W}]{{0,3}}[0-9]+\\.[{_W}]+[^{_W}]')) as numbered,
  count(*) filter (regexp_matches({_strip('line')}, '^\\|') and regexp_matches({_strip('line')}, '\\|$')) as rows, count(*) filter (fence) as fences from marked""",
        "delivered_chunks": """select manifest_id, chunk_count, len(chunks) as listed, (select count(*) from chunk_file c where c.manifest_id = m.manifest_id) as delivered
from chunks_manifest m""",
        "diff_rates": f"""with texts as (select unit_key, coalesce(source, '') as l, coalesce(target, '') as r, list_distinct(string_split(coalesce(source, ''), '')) as ls,
  list_distinct(string_split(coalesce(target, ''), '')) as rs from trans_unit),
-- the distance of this engine goes by bytes: signs of both sides get a byte each, those of one side alone one that the other hasn't
coded as (select *, list_filter(ls, lambda x: list_contains(rs, x)) as shared, list_filter(ls, lambda x: not list_contains(rs, x)) as only_l, list_filter(rs, lambda x: not list_contains(ls, x)) as only_r,
  list_transform(range(3, 128), lambda i: chr(i::int)) as codes from texts),
mapped as (select *, array_to_string(list_slice(codes, 1, len(shared)), '') as known from coded),
measured as (select unit_key, levenshtein(translate(l, array_to_string(shared, '') || array_to_string(only_l, ''), known || repeat(chr(1), len(only_l))),
  translate(r, array_to_string(shared, '') || array_to_string(only_r, ''), known || repeat(chr(2), len(only_r))))::int as distance, greatest(length(l), length(r), 1)::int as max_len from mapped),
rated as (select *, printf('%.2f', distance / max_len * 100)::double as diff_rate from measured)
select *, case when diff_rate <= 10 then 'PASS' else 'WARNING' end as verdict from rated""",
        "normalized": f"select unit_key, {_normal('target')} as target from trans_unit",
        "xliff_documents": f"""with {_CELLS} select doc_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<xliff version="1.2">' || chr(10) || '  <file original="' || {_xml('any_value(original)')}
  || '" source-language="' || {_xml('any_value(source_lang)')} || '" target-language="' || {_xml('any_value(target_lang)')} || '" datatype="plaintext">' || chr(10) || '    <body>' || chr(10)
  || string_agg('      <trans-unit id="' || {_xml('unit_id')} || '" xml:space="preserve">' || chr(10) || '        <source>' || {_xml('src')} || '</source>' || chr(10)
  || '        <target>' || {_xml('tgt')} || '</target>' || chr(10) || '      </trans-unit>', chr(10) order by seg_no)
  || chr(10) || '    </body>' || chr(10) || '  </file>' || chr(10) || '</xliff>' || chr(10) as content
from units join xliff_file on doc_id = file_id group by doc_id""",
        "tmx_documents": f"""with {_CELLS} select doc_id, '<?xml version=''1.0'' encoding=''utf-8''?>' || chr(10)
  || '<tmx version="1.4"><header creationtool="bitloom" creationtoolversion="1" segtype="paragraph" adminlang="en-us" srclang="' || {_xml('any_value(source_lang)')}
  || '" datatype="PlainText" creationdate="' || strftime(any_value(exported_at), '%Y%m%dT%H%M%SZ') || '" /><body>'
  || string_agg('<tu tuid="' || unit_id || '"><tuv xml:lang="' || {_xml('source_lang')} || '"><seg>' || {_xml('src')} || '</seg></tuv><tuv xml:lang="' || {_xml('target_lang')}
  || '"><seg>' || {_xml('tgt')} || '</seg></tuv></tu>', '' order by seg_no) || '</body></tmx>' as content
from units join xliff_file on doc_id = file_id group by doc_id""",
        "directions": f"""select file_id, {_prefix('source_lang')} as source_prefix, {_prefix('target_lang')} as target_prefix,
  {_prefix('source_lang')} like 'zh%' and {_prefix('target_lang')} like 'en%' as reversed from xliff_file""",
        "progress_lines": f"""select file_id, '[PROGRESS] 2/6 ' || project || ' | RUNNING | elapsed=' || {_duration('n_units')} || ' eta=' || {_duration('greatest(0, 90 - n_units)')}
  || ' progress=' || {percent} || '%' as line from xliff_file""",
        "project_summary": f"""with {_FLAGS}, n as (select unit_key, count(*) as n from flags group by unit_key)
select project, count(*) as pairs, coalesce(sum(n), 0)::bigint as qa_flags, count(*) filter (coalesce(change_type, '') <> 'unchanged') as changed_pairs
from trans_unit left join n using (unit_key) group by project""",
    }
