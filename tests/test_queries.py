"""Every core query against its SQL, on the smallest data folder."""

import glob
import os

import pytest

from bitloom.plans import queries as Q


@pytest.fixture(scope="module")
def sql(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, data, sql, name):
    got, want = Q.queries()[name](spark, data).toPandas(), sql.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, data, name):
    assert Q.queries()[name](spark, data).count() >= 0


#: Conditions on the rows of a query that each has to hold for some row: the branches of its operators.
BRANCHES = {
    "change_types": [f"change_type = '{x}'" for x in ("new", "updated", "unchanged")], "removed_units": ["src <> ''"], "removed_map": ["sorted"],
    "changed_only": ["updated > 0", "added > 0"], "export_summary": ["removed_pairs > 0", "qa_flags > 0", "exit_code = 2", "pairs < stable_ids"],
    "mask_regions": [f"token like '%PH_{x}%'" for x in ("CODE_BLOCK", "INLINE", "MATH_BLOCK", "HTML")] + ["original like '%PH_INLINE%'"],
    "mask_restore": ["creation <> reverse"], "line_kinds": ["headings > 0 and items > 0 and numbered > 0 and rows > 0 and fences > 0"],
    "segments": [f"kind = '{x}'" for x in ("heading", "list", "table", "paragraph", "code")], "chunks": ["length(chunk) = 800", "chunk_no > 1", "chunk like '## %'"],
    "syntax_errors": [f"error like '%{x}%'" for x in ("fence", "backticks", "placeholders", "links")],
    "qa_flags": [f"flag_type = '{x}'" for x in ("missing_target", "unchanged_text", "placeholder_leak", "length_too_short", "length_too_long", "code_fence_mismatch")],
    "qa_gate": ["failed", "not failed", "max_severity = 'none'", "max_severity = 'warning'"], "glossary_collisions": ["kept <> dropped"], "glossary_summary": ["skipped_count > 0"],
    "diff_rates": ["verdict = 'PASS'", "verdict = 'WARNING'"], "domain_scores": ["score >= 0"], "repaired": ["text like '%**bold**%'", "text like '%- second%'", "text like '%[label](target){{%'"],
}


@pytest.mark.parametrize("name", sorted(BRANCHES))
def test_every_branch_occurs(spark, data, name):
    rows = Q.queries()[name](spark, data).cache()
    missing = [x for x in BRANCHES[name] if rows.where(x).isEmpty()]
    rows.unpersist()
    assert not missing


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "seg_no", "src", "tgt", "unit_id"]
