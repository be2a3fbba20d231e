"""Text sources as blocks: Markdown and plain text, drafts, tables in prose, source code, sections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import INT, TEXT, row

CODE_LINES = 50
MIN_PARSED_CHARS = 10


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, line): the lines of each text, numbered from 1."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)


def line_class(line: Column) -> Column:
    return (
        F.when(F.trim(line) == "", "blank")
        .when(line.rlike(r"^\s*(```|~~~)"), "fence")
        .when(line.rlike(r"^#{1,6}\s"), "heading")
        .when(line.rlike(r"^\s*\|.*\|\s*$"), "table")
        .when(line.rlike(r"^\s*([-*+]|[0-9]+[.)])\s"), "list")
        .otherwise("paragraph")
    )


def blocks_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_type, line_start, line_end, content): headings, code, tables, lists and paragraphs.

    Line classes are made per row; a window per document finds where the class changes. A heading is a
    block of its own, lines between fences are code, blank lines part blocks.
    """
    w = Window.partitionBy(key).orderBy("n")
    rows = lines_of(docs, key, text).withColumn("kind", line_class(F.col("line")))
    fences = F.sum(F.when(F.col("kind") == "fence", 1).otherwise(0)).over(w)
    rows = rows.withColumn("fences", fences)
    rows = rows.withColumn("kind", F.when((F.col("fences") % 2 == 1) | (F.col("kind") == "fence"), "code").otherwise(F.col("kind")))
    new = (F.lag("kind").over(w) != F.col("kind")) | (F.col("kind") == "heading") | F.lag("kind").over(w).isNull()
    rows = rows.withColumn("block", F.sum(F.when(new, 1).otherwise(0)).over(w)).where("kind <> 'blank'")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(key, "block", "kind").agg(F.min("n").alias("line_start"), F.max("n").alias("line_end"), body.alias("content")).select(key, F.col("kind").alias("block_type"), "line_start", "line_end", "content")


def sections_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, heading, n_lines, n_words): lines under the last heading before them."""
    w = Window.partitionBy(key).orderBy("n")
    rows = lines_of(docs, key, text).withColumn("is_heading", line_class(F.col("line")) == "heading")
    rows = rows.withColumn("section", F.sum(F.when(F.col("is_heading"), 1).otherwise(0)).over(w))
    body = ~F.col("is_heading") & (F.trim("line") != "")
    words = F.size(F.filter(F.split(F.col("line"), r"\s+"), lambda x: x != ""))
    head = F.max(F.when(F.col("is_heading"), F.regexp_replace("line", r"^#+\s*", "")))
    return rows.groupBy(key, "section").agg(head.alias("heading"), F.count_if(body).alias("n_lines"), F.coalesce(F.sum(F.when(body, words)), F.lit(0)).cast("long").alias("n_words"))


def prose_tables(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "\t") -> DataFrame:
    """(key, line_start, n_rows, width): runs of two lines or more with the same number of two cells or more."""
    w = Window.partitionBy(key).orderBy("n")
    width = F.when(F.col("line").contains(mark), F.size(F.split("line", f"\\Q{mark}\\E", -1))).otherwise(0)
    rows = lines_of(docs, key, text).withColumn("width", width)
    rows = rows.withColumn("run", F.sum(F.when(F.lag("width").over(w).eqNullSafe(F.col("width")), 0).otherwise(1)).over(w)).where("width >= 2")
    return rows.groupBy(key, "run", "width").agg(F.min("n").alias("line_start"), F.count("*").alias("n_rows")).where("n_rows >= 2").select(key, "line_start", "n_rows", "width")


def draft_body(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, line): a draft's prose: no headings, code, blank lines, nor anything from a references heading on."""
    w = Window.partitionBy(key).orderBy("n")
    rows = lines_of(docs, key, text).withColumn("kind", line_class(F.col("line")))
    rows = rows.withColumn("fences", F.sum(F.when(F.col("kind") == "fence", 1).otherwise(0)).over(w))
    ends = F.col("line").rlike(r"(?i)^#{0,6}\s*(references|bibliography|參考文獻)\s*$")
    rows = rows.withColumn("ended", F.max(F.when(ends, 1).otherwise(0)).over(w))
    return rows.where("ended = 0 AND fences % 2 = 0 AND kind NOT IN ('fence', 'heading', 'blank')").select(key, "n", "line")


def reference_list(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, position, reference): entries after a references heading; numbered, bulleted or parted by blank lines."""
    w = Window.partitionBy(key).orderBy("n")
    rows = lines_of(docs, key, text)
    head = F.col("line").rlike(r"(?i)^#{0,6}\s*(references|bibliography|參考文獻)\s*$")
    rows = rows.withColumn("started", F.max(F.when(head, 1).otherwise(0)).over(w)).where((F.col("started") == 1) & ~head)
    starts = F.col("line").rlike(r"^\s*(\[[0-9]+\]|[0-9]+[.)]|[-*])\s") | (F.coalesce(F.trim(F.lag("line").over(w)), F.lit("")) == "")
    rows = rows.withColumn("position", F.sum(F.when(starts & (F.trim("line") != ""), 1).otherwise(0)).over(w)).where(F.trim("line") != "")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: F.trim(x["line"])), " ")
    return rows.groupBy(key, "position").agg(F.regexp_replace(body, r"^\s*(\[[0-9]+\]|[0-9]+[.)]|[-*])\s+", "").alias("reference"))


def code_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CODE_LINES) -> DataFrame:
    """(key, chunk, line_start, line_end, content): source code in chunks of `size` lines."""
    rows = lines_of(docs, key, text).withColumn("chunk", F.floor((F.col("n") - 1) / size))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(key, "chunk").agg(F.min("n").alias("line_start"), F.max("n").alias("line_end"), body.alias("content"))


def is_parsed(content: Column) -> Column:
    return F.length(F.trim(F.coalesce(content, F.lit("")))) >= MIN_PARSED_CHARS


def read_texts(spark, path: str) -> DataFrame:
    """(doc_id, path, text): whole text files; each file is one row, UTF-8 with a fallback to Latin-1."""
    raw = spark.read.format("binaryFile").load(path)
    utf8 = F.try_validate_utf8(raw.content.cast("string"))
    return raw.select(F.xxhash64("path").alias("doc_id"), "path", F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("text"))


#: Characters of a block that is cut, and of the chunks it is cut into.
BLOCK_CHARS, CHUNK_CHARS = 2000, 1500
#: Characters of chunks that are handed on together.
PACKED_CHARS = 1 << 20


_SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s*")


def chunks(text: str) -> list[tuple[str, int, int]]:
    """(content, first line, last line) of a long block's chunks, in time linear in its length.

    Lines, sentences of long lines and cuts of long sentences are the pieces. Running lengths say where a
    chunk that starts at a piece must end, so each chunk is one jump.
    """
    pieces, at = [], []
    for i, line in enumerate(text.split("\n")):
        parts = [line] if len(line) <= CHUNK_CHARS else [s for s in _SENTENCE_END.split(line) if s]
        cuts = [s[k : k + CHUNK_CHARS] for s in parts for k in range(0, max(len(s), 1), CHUNK_CHARS)]
        pieces += cuts
        at += [i] * len(cuts)
    upto = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])
    out, i = [], 0
    while i < len(pieces):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + CHUNK_CHARS + 1, side="right")) - 1)
        body = "\n".join(pieces[i:j]).strip(" ")
        if body:
            out.append((body, at[i], at[j - 1]))
        i = j
    return out


def split_long(blocks: DataFrame, key: str = "block_id", content: str = "content") -> DataFrame:
    """(key, chunk, first_line, last_line, content): blocks of over 2,000 characters in chunks of up to 1,500, others whole.

    Cuts fall between lines, inside a long line between sentences, inside a long sentence anywhere. Lines
    are counted from 0; chunks of blanks alone are left out.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    long = F.length(text) > BLOCK_CHARS

    kind = T.StructType([blocks.schema[key], *row(chunk=INT, first_line=INT, last_line=INT, content=TEXT).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks go on as soon as there is a megabyte of them, so memory holds one batch of texts and no more."""

        def packed(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
            types = [of, pa.int32(), pa.int32(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=kind.names)

        for b in batches:
            rows, size = [], 0
            for k, t in zip(*b.columns):
                for i, (body, first, last) in enumerate(chunks(t.as_py())):
                    rows.append((k.as_py(), i, first, last, body))
                    size += len(body)
                    if size > PACKED_CHARS:
                        yield packed(rows, b.schema.types[0])
                        rows, size = [], 0
            if rows:
                yield packed(rows, b.schema.types[0])

    parts = blocks.where(long).select(key, text.alias("text")).mapInArrow(cut, kind)
    whole = blocks.where(~long).select(key, F.lit(0).alias("chunk"), F.lit(0).alias("first_line"), F.regexp_count(text, F.lit("\n")).alias("last_line"), text.alias("content"))
    return parts.unionByName(whole)


def table_rows(tables: DataFrame, key: str = "block_id", content: str = "content") -> DataFrame:
    """(key, row, content): the rows of pipe tables as JSON records; a table whose first row is all numbers has no header and gives none.

    Repeated headers are told apart, short rows are filled up, rows of placeholders go.
    """
    lines = F.filter(F.split(F.col(content), "\r?\n"), lambda x: x.contains("|") & ~x.rlike(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$"))

    def cells(line: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|", -1), lambda x: F.trim(x))

    # an explode of one value computes it once, where a column would be put into each row's expressions, the whole text with it
    found = tables.select(key, F.explode(F.array(lines)).alias("lines")).where(F.size("lines") >= 2)
    headed = found.select(key, "lines", F.explode(F.array(cells(F.get("lines", F.lit(0))))).alias("head"))
    before = lambda h, i: F.size(F.filter(F.slice("head", F.lit(1), i), lambda g: g == h))
    named = F.transform("head", lambda h, i: F.concat(F.when(h == "", F.concat(F.lit("column "), (i + 1).cast("string"))).otherwise(h), F.when(before(h, i) > 0, F.concat(F.lit(" ["), (before(h, i) + 1).cast("string"), F.lit("]"))).otherwise("")))
    numeric = F.forall("head", lambda h: h.rlike(r"^[+-]?[0-9][0-9,]*(\.[0-9]+)?%?$"))
    rows = headed.where(~numeric).select(key, "lines", F.explode(F.array(named)).alias("names"))
    rows = rows.select(key, "names", F.posexplode(F.slice("lines", F.lit(2), F.size("lines"))).alias("row", "line"))
    rows = rows.select(key, "row", "names", F.explode(F.array(cells(F.col("line")))).alias("values"))
    filled = F.transform("names", lambda n, i: F.coalesce(F.get("values", i), F.lit("")))
    stated = F.exists(filled, lambda v: ~F.lower(v).isin("", "-", "--", "n/a", "na", "tbd", "none", "null"))
    return rows.where(stated).select(key, "row", F.to_json(F.map_from_arrays("names", filled)).alias("content"))


#: Openings of classes and functions at the left margin.
UNIT_START = r"^(?:export\s+)?(?:default\s+)?(?:public\s+)?(?:async\s+)?(class|def|function|func|fn|interface|struct)\s+([A-Za-z_][A-Za-z0-9_]*)"


def code_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, unit, kind, name, line_start, line_end): classes and functions that start at the left margin; what is before the first is a module.

    A unit ends before the next one, trailing blank lines left out.
    """
    w = Window.partitionBy(key).orderBy("n")
    rows = lines_of(docs, key, text).withColumn("kind", F.regexp_extract("line", UNIT_START, 1))
    rows = rows.withColumn("unit", F.sum(F.when(F.col("kind") != "", 1).otherwise(0)).over(w)).where(F.trim("line") != "")
    first = F.min_by(F.struct(F.col("kind"), F.regexp_extract("line", UNIT_START, 2).alias("name")), "n")
    units = rows.groupBy(key, "unit").agg(first.alias("f"), F.min("n").alias("line_start"), F.max("n").alias("line_end"))
    return units.select(key, "unit", F.when(F.col("f.kind") == "", "module").otherwise(F.col("f.kind")).alias("kind"), "f.name", "line_start", "line_end")


def without_repeated_headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, line): lines without headings that repeat or are empty, nor the blank line after them.

    A heading of level 2 or more is empty if no text follows before the next heading of its level or above.
    A first-level heading repeats an earlier first-level one, others repeat any heading that is kept.
    """
    w, whole = Window.partitionBy(key).orderBy("n"), Window.partitionBy(key, "title").orderBy("n")
    rows = lines_of(docs, key, text).withColumn("level", F.length(F.regexp_extract(F.trim("line"), r"^(#+)\s+\S", 1)))
    rows = rows.withColumn("title", F.lower(F.trim(F.regexp_replace(F.trim("line"), r"^#+\s+", ""))))
    filled = rows.where(F.trim("line") != "").withColumn("next_level", F.lead("level").over(w))
    empty = (F.col("level") >= 2) & (F.col("next_level").isNull() | ((F.col("next_level") > 0) & (F.col("next_level") <= F.col("level"))))
    heads = filled.where("level > 0").withColumn("empty", empty)
    kept = heads.where(~F.col("empty"))
    seen = F.count("*").over(whole.rowsBetween(Window.unboundedPreceding, -1))
    seen_top = F.count_if(F.col("level") == 1).over(whole.rowsBetween(Window.unboundedPreceding, -1))
    repeated = kept.withColumn("gone", F.when(F.col("level") == 1, seen_top > 0).otherwise(seen > 0)).where("gone")
    gone = heads.where("empty").select(key, "n").unionByName(repeated.select(key, "n")).withColumn("gone", F.lit(True))
    marked = rows.join(gone, [key, "n"], "left").withColumn("after", F.lag("gone").over(w))
    return marked.where(F.col("gone").isNull() & ~(F.col("after").eqNullSafe(F.lit(True)) & (F.trim("line") == ""))).select(key, "n", "line")
