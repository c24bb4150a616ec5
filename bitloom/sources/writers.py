"""Exchange files of a set of pairs.

The rows are formatted in the JVM and written by tasks, in the order of the pairs: a range
partitioning on the order key keeps each part sorted, and the parts follow one another by name. One file
per document comes from a partitioned write; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions.text import escape_markup

#: Characters that XML 1.0 cannot hold.
_NOT_XML = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]"


def _xml(text: Column) -> Column:
    return escape_markup(F.regexp_replace(text, _NOT_XML, ""))


def xliff_unit() -> Column:
    """The XLIFF element of a pair (unit_id, src, tgt)."""
    return F.concat(
        F.lit('      <trans-unit id="'), _xml(F.col("unit_id")), F.lit('" xml:space="preserve">\n        <source>'),
        _xml(F.col("src")), F.lit("</source>\n        <target>"), _xml(F.col("tgt")), F.lit("</target>\n      </trans-unit>"),
    )


def tmx_unit(source_lang: Column, target_lang: Column) -> Column:
    """The TMX element of a pair."""
    def side(lang: Column, text: Column) -> Column:
        return F.concat(F.lit('<tuv xml:lang="'), _xml(lang), F.lit('"><seg>'), _xml(text), F.lit("</seg></tuv>"))

    return F.concat(
        F.lit('<tu tuid="'), _xml(F.col("unit_id")), F.lit('">'), side(source_lang, F.col("src")),
        side(target_lang, F.col("tgt")), F.lit("</tu>"),
    )


def xliff_documents(pairs: DataFrame, source_lang: Column, target_lang: Column, original: Column, key: str = "doc_id", index: str = "seg_no") -> DataFrame:
    """(key, content): a whole XLIFF 1.2 file for each document. A document's units meet in one row."""
    units = pairs.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), xliff_unit().alias("u")))).alias("us"),
        F.first(source_lang).alias("sl"), F.first(target_lang).alias("tl"), F.first(original).alias("o"),
    )
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<xliff version="1.2">\n  <file original="'), _xml(F.col("o")),
        F.lit('" source-language="'), _xml(F.col("sl")), F.lit('" target-language="'), _xml(F.col("tl")),
        F.lit('" datatype="plaintext">\n    <body>\n'),
    )
    body = F.array_join(F.transform("us", lambda x: x["u"]), "\n")
    return units.select(key, F.concat(head, body, F.lit("\n    </body>\n  </file>\n</xliff>\n")).alias("content"))


def tmx_documents(pairs: DataFrame, source_lang: Column, target_lang: Column, created: Column, tool: str = "bitloom", version: str = "1", key: str = "doc_id", index: str = "seg_no") -> DataFrame:
    """(key, content): a whole TMX 1.4 file for each document; ``created`` is its time stamp (UTC)."""
    units = pairs.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), tmx_unit(source_lang, target_lang).alias("u")))).alias("us"),
        F.first(source_lang).alias("sl"), F.first(created).alias("c"),
    )
    head = F.concat(
        F.lit("<?xml version='1.0' encoding='utf-8'?>\n<tmx version=\"1.4\">"),
        F.lit(f'<header creationtool="{tool}" creationtoolversion="{version}" segtype="paragraph" adminlang="en-us" srclang="'),
        _xml(F.col("sl")), F.lit('" datatype="PlainText" creationdate="'), F.date_format("c", "yyyyMMdd'T'HHmmss'Z'"), F.lit('" /><body>'),
    )
    return units.select(key, F.concat(head, F.array_join(F.transform("us", lambda x: x["u"]), ""), F.lit("</body></tmx>")).alias("content"))


def write_files(contents: DataFrame, folder: str, name: Column) -> None:
    """The ``content`` of each row as a file of its own, byte for byte, in a folder that all workers reach.

    Tasks write their rows themselves; a task that runs again writes the same files again.
    """
    def write(rows) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for r in rows:
            path = f"{base}/{r.name}"
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(path) as f:
                f.write(r.content.encode())

    contents.select(name.alias("name"), "content").foreachPartition(write)


def segment_map(pairs: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    """The columns of the segment map and of the removed map."""
    return pairs.select(
        F.col("unit_id").alias("stable_id"), F.col("src").alias(f"source_{source_lang}"),
        F.col("tgt").alias(f"target_{target_lang}"), "change_type",
    )


def flag_map(flags: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    """The columns of the quality flags file."""
    return flags.select(
        F.col("unit_id").alias("stable_id"), "flag_type", "severity", "message",
        F.col("src").alias(f"source_{source_lang}"), F.col("tgt").alias(f"target_{target_lang}"),
    )


def write_csv(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A CSV folder with header and quoted quotes; sorted parts where an order is given."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    ordered.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_chunks(chunks: DataFrame, folder: str, key: str = "doc_id") -> None:
    """Each chunk as a file of its own, in a folder per document."""
    write_files(chunks.select(key, "name", F.col("chunk").alias("content")), folder, F.concat_ws("/", F.col(key).cast("string"), "name"))


def glossary_json(entries: DataFrame, source_lang: str, target_lang: str, order: str = "term_id") -> DataFrame:
    """(content): one JSON document with header fields, collision examples and the map in the order of its first entries.

    ``entries`` are directed (see :func:`bitloom.operators.glossary.directed`), of one group. For glossaries that people keep: a
    document is one row.
    """
    from bitloom.operators import glossary

    kept = entries.groupBy("term").agg(F.min_by("translation", order).alias("translation"), F.min(order).alias("at"))
    clashes = glossary.collisions(entries, order, [])
    counted = clashes.agg(F.count(F.lit(1)).alias("collision_count"))
    shown = clashes.orderBy(order).limit(glossary.EXAMPLES_KEPT).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(order, "term", "kept", "dropped"))), lambda x: F.struct(x["term"].alias("term"), x["kept"].alias("kept"), x["dropped"].alias("dropped"))
    ).alias("collision_examples"))
    whole = kept.agg(F.array_sort(F.collect_list(F.struct("at", "term", "translation"))).alias("e"))
    one = whole.join(counted).join(shown)  # three single rows
    return one.select(F.to_json(F.struct(
        F.lit(source_lang).alias("source_language"), F.lit(target_lang).alias("target_language"),
        F.lit(f"{source_lang}->{target_lang}").alias("direction"),
        F.lit(source_lang.lower().startswith("zh") and target_lang.lower().startswith("en")).alias("reversed_from_default_en_zh"),
        F.size("e").alias("term_count"), "collision_count", "collision_examples",
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["term"].alias("term"), x["translation"].alias("translation")))).alias("map"),
    )).alias("content"))


def write_removed(removed: DataFrame, has_baseline: bool, path: str, source_lang: str, target_lang: str) -> bool:
    """The removed map, sorted by id; written only where there is a baseline to compare with."""
    if has_baseline:
        write_csv(segment_map(removed, source_lang, target_lang), path, ["stable_id"])
    return has_baseline


def write_manifest(documents: DataFrame, folder: str, size: int, key: str = "doc_id", text: str = "text") -> None:
    """The chunk files of each document, and a manifest beside them."""
    from bitloom.operators import chunk

    write_chunks(chunk.chunks(documents, size, key, text), folder, key)
    manifests = chunk.manifest(documents, size, key, text).select(key, F.to_json(F.struct(
        F.col(key).cast("string").alias("source_file"), "chunk_size", "chunk_count", "chunks"
    )).alias("content"))
    write_files(manifests, folder, F.concat_ws("/", F.col(key).cast("string"), F.lit("chunks_manifest.json")))
