import csv
import io
import json
import subprocess
import sys
import time
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from bitloom.operators import chunk
from bitloom.plans import progress, selection
from bitloom.plans.export import export
from bitloom.sources import files, writers
from bitloom.streaming.documents import document_stream, write_segments


def docs(spark, *texts):
    return spark.createDataFrame([(1, t) for t in texts], "doc_id int, text string")


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("﻿x\r\ny\rz".encode())
    got = files.read_documents(spark, str(tmp_path / "a.md"))
    assert got.first().text == "x\ny\nz"
    assert files.read_documents(spark, str(tmp_path / "a.md"), keep_bom=True).first().text == "﻿x\ny\nz"
    assert [(r.line_no, r.line) for r in files.lines(got).collect()] == [(1, "x"), (2, "y"), (3, "z")]
    (tmp_path / "c.json").write_text('{"source_language": " de ", "target_language": ""}')
    assert files.read_languages(spark, str(tmp_path / "c.json")) == files.Languages("de", "zh-CN")
    assert files.read_languages(spark, str(tmp_path / "none.json")) == files.Languages()


def test_baseline(spark, tmp_path):
    path = tmp_path / "b.csv"
    with path.open("w", newline="", encoding="utf-8-sig") as f:
        csv.writer(f).writerows([["stable_id", "source_en", "target_zh", "change_type"], ["a", "s1", "t1", "new"], [" a ", 's"2', "t\n2", "new"], ["", "x", "y", "z"]])
    assert [tuple(r) for r in files.read_baseline(spark, str(path)).collect()] == [("a", 's"2', "t\n2")]
    assert files.read_baseline(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "c.csv").write_text("id,other\n1,2\n")
    assert files.read_baseline(spark, str(tmp_path / "c.csv")).count() == 0


def test_glossary_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"map": {" a ": "x", "b": ""}, "terms": [{"source": "c", "target": "z"}]}), encoding="utf-8")
    (tmp_path / "t.json").write_text(json.dumps({"terms": [{"source": "a", "target": "x"}, {"source": "a", "target": "y"}, {"source": "", "target": "z"}]}))
    assert [tuple(r) for r in files.read_glossary(spark, str(tmp_path / "m.json")).collect()] == [("a", "x")]
    assert [tuple(r) for r in files.read_glossary(spark, str(tmp_path / "t.json")).collect()] == [("a", "y")]
    assert files.read_glossary(spark, str(tmp_path / "none.json")).count() == 0
    assert [r.source for r in files.read_terms(spark, str(tmp_path / "t.json")).orderBy("ord").collect()] == ["a", "a", ""]


def test_export(spark, tmp_path):
    source, target = docs(spark, "# T\n\nvalve <a> & b\n\n```\nx\n```"), docs(spark, "# T2\n\nv\n\n```\nx\n```\n\nmore")
    gl = spark.createDataFrame([("valve", "Ventil")], "term string, translation string")
    first = export(source, target, glossary=gl)
    assert {r.flag_type for r in first.flags.collect()} == {"length_too_short", "unchanged_text", "term_inconsistency"}
    assert first.summary.first().asDict() == {
        "doc_id": 1, "source_segments": 3, "target_segments": 4, "changed_pairs": 4, "stable_ids": 4, "pairs": 4, "removed_pairs": 0, "qa_flags": 3,
        "incremental": False, "glossary_terms": 1, "max_severity": "warning", "fail_on_severity": "none", "exit_code": 0}
    assert export(source, target, glossary=gl, threshold="warning").summary.first().exit_code == 2
    changed = export(source, docs(spark, "# T3\n\nv"), baseline=first.pairs, only_changed=True)
    assert sorted(r.change_type for r in changed.pairs.collect()) == ["unchanged", "updated", "updated"]
    assert changed.selected.count() == 2 and changed.removed.count() == 1
    xliff = writers.xliff_documents(first.pairs, F.lit("en"), F.lit("de"), F.lit("o\"x")).first().content
    root = ET.fromstring(xliff.encode())
    assert root.find("file").get("original") == 'o"x' and [u.find("source").text for u in root.iter("trans-unit")][1] == "valve <a> & b"
    tmx = writers.tmx_documents(first.pairs, F.lit("en"), F.lit("de"), F.lit("2024-01-02 03:04:05").cast("timestamp")).first().content
    assert ET.fromstring(tmx.encode()).find("header").get("creationdate") == "20240102T030405Z"
    assert len(list(ET.fromstring(tmx.encode()).iter("tu"))) == 4
    writers.write_csv(writers.segment_map(first.pairs, "en", "de"), str(tmp_path / "map"), ["stable_id"])
    again = files.read_baseline(spark, str(tmp_path / "map"))
    assert sorted(tuple(r) for r in again.collect()) == sorted((r.unit_id, r.src, r.tgt) for r in first.pairs.collect())
    assert writers.flag_map(first.flags, "en", "de").columns == ["stable_id", "flag_type", "severity", "message", "source_en", "target_de"]
    writers.write_files(writers.xliff_documents(first.pairs, F.lit("en"), F.lit("de"), F.lit("o")), str(tmp_path / "x"), F.format_string("%d.xliff", "doc_id"))
    assert ET.parse(tmp_path / "x/1.xliff").getroot().find("file").get("original") == "o"
    writers.write_chunks(chunk.chunks(docs(spark, "a" * 30), 20), str(tmp_path / "c"))
    assert (tmp_path / "c/1/chunk_002.md").read_text() == "a" * 10
    entries = spark.createDataFrame([(3, "valve", "Ventil"), (1, "pump", "Pumpe"), (4, "pump", "Pumpen"), (5, "pump", "Pumpe")], "term_id int, term string, translation string")
    found = json.loads(writers.glossary_json(entries, "en-US", "de").first().content)
    assert list(found["map"].items()) == [("pump", "Pumpe"), ("valve", "Ventil")] and found["term_count"] == 2 and found["collision_count"] == 1
    assert found["collision_examples"] == [{"term": "pump", "kept": "Pumpe", "dropped": "Pumpen"}] and found["direction"] == "en-US->de"
    assert not found["reversed_from_default_en_zh"] and json.loads(writers.glossary_json(entries.limit(0), "zh-CN", "en").first().content)["reversed_from_default_en_zh"]
    writers.write_manifest(docs(spark, "a" * 30), str(tmp_path / "m"), 20)
    assert json.loads((tmp_path / "m/1/chunks_manifest.json").read_text()) == {"source_file": "1", "chunk_size": 20, "chunk_count": 2, "chunks": ["chunk_001.md", "chunk_002.md"]}
    assert not writers.write_removed(changed.removed, False, str(tmp_path / "r0"), "en", "de") and not (tmp_path / "r0").exists()
    assert writers.write_removed(changed.removed, True, str(tmp_path / "r1"), "en", "de") and spark.read.csv(str(tmp_path / "r1"), header=True).count() == 1


def test_commands_pass_their_output_through():
    out = io.StringIO()
    assert progress.run([sys.executable, "-c", "import sys; print('one'); print('two', file=sys.stderr)"], 1, 1, "s", out=out) == 0
    said = out.getvalue().splitlines()
    assert said[0].endswith("| START") and {"one", "two"} == set(said[1:-1]) and " | DONE | " in said[-1]
    with pytest.raises(subprocess.CalledProcessError):
        progress.run([sys.executable, "-c", "raise SystemExit(3)"], 1, 1, "s", out=out)
    assert " | ERROR | CalledProcessError elapsed=" in out.getvalue().splitlines()[-1]


def test_selection(spark):
    paths = {"default": "d.json", "ecommerce": "e.json"}
    assert selection.select_path(spark, paths, explicit="x.json", domain="auto", text="sku").path == "x.json"
    auto = selection.select_path(spark, paths, domain="auto", text="The SKU of a listing")
    assert auto.path == "e.json" and auto.score >= 3 and set(auto.matches) == {"listing", "sku"}
    assert selection.select_path(spark, paths, domain="auto", text="pumps").path == selection.select_path(spark, paths, domain="other").path == "d.json"
    assert selection.select_path(spark, paths, domain="ecommerce").domain == "ecommerce"
    with pytest.raises(ValueError):
        selection.select_path(spark, {}, domain="x")


def test_progress():
    out = io.StringIO()
    with progress.watched(1, 2, "stage", heartbeat=0.02, warning_after=0.03, out=out):
        time.sleep(0.1)
    said = [x.split(" | ")[1] for x in out.getvalue().splitlines()]
    assert said[0] == "START" and said[-1] == "DONE" and said.count("WARNING") == 1 and "RUNNING" in said
    with pytest.raises(KeyError), progress.watched(1, 1, "s", out=out):
        raise KeyError
    assert "ERROR" in out.getvalue()
    assert progress.eta(40, 120) == "elapsed=40s eta=1m20s progress=33%"
    for bad in (lambda: progress.line(0, 1, "s", "DONE"), lambda: progress.line(1, 1, "s", "GONE"), lambda: progress.eta(-1, 1), lambda: progress.eta(1, 0)):
        with pytest.raises(ValueError):
            bad()


def test_stream_of_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# A\n\ntext")
    query = write_segments(document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert [r.kind for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seg_no").collect()] == ["heading", "paragraph"]
