"""Delimited text whose records may hold line breaks, read by splits in any of several encodings.

Spark hands out physical lines, in order within a split. Whether a line break ends a record depends on
whether a quotation is open there, and that on all the text before it. So a first pass gives for each split
what state it ends in for either state it may begin in, open or not; a prefix over the splits of a file, a
few values each, picks the true ones. A second pass then cuts each split into records by itself. Only the
ends of records that cross a split are shuffled, to be put together. No file is read by one task.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.errors import RequestError

#: Leading rows that may be noise, and encodings in the order in which they are tried.
MAX_NOISE_ROWS = 5
ENCODINGS = ("utf-8-sig", "cp950", "gb18030")

_BOM = b"\xef\xbb\xbf"
_FIELD_LIMIT = 2**31 - 1


def unique_headers(names: list[str | None]) -> list[str]:
    """Blank headers are numbered, repeated ones become `name [2]`."""
    seen: dict[str, int] = {}
    out = []
    for i, raw in enumerate(names):
        name = (raw or "").strip() or f"column {i + 1}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name} [{seen[name]}]")
    return out


def filled_cells(row: list[str]) -> int:
    return sum(c.strip().lower() not in ("", "nan") for c in row)


def noise_rows(rows: list[list[str]], widest: int) -> int:
    """How many rows stand above the header: leading rows of one value at most, if the row below them is as wide as any."""
    counts = [filled_cells(row) for row in rows]
    skipped = 0
    for n in counts[:MAX_NOISE_ROWS]:
        if n > 1 or skipped + 1 >= len(rows):
            break
        skipped += 1
    return skipped if widest >= 2 and skipped and counts[skipped] == widest else 0


class LineStates:
    """Whether a quotation is open behind a line, for either state before it; quotation marks inside a bare cell count for nothing."""

    def __init__(self, sep: str):
        s = re.escape(sep.encode())
        bare = rb'[^"\r' + s + rb"][^\r" + s + rb"]*+"
        shut = rb'[^"]*+(?:""[^"]*+)*+"[^\r' + s + rb"]*+"  # from inside a quotation to the end of its cell
        cells = rb'(?:(?:"' + shut + rb"|" + bare + rb")?+[\r" + s + rb"])*+"
        left_open = cells + rb'"[^"]*+(?:""[^"]*+)*+\Z'
        self._after_shut = re.compile(left_open)
        self._after_open = re.compile(rb'[^"]*+(?:""[^"]*+)*+\Z|' + shut + rb"[\r" + s + rb"]" + left_open)

    def after(self, line: bytes, is_open: bool) -> bool:
        if b'"' not in line:
            return is_open
        return (self._after_open if is_open else self._after_shut).match(line) is not None


def parsed(text: str, sep: str) -> list[list[str]]:
    csv.field_size_limit(_FIELD_LIMIT)
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, line): the bytes between line feeds, with the start of the split they lie in."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[list]]]:
    """The splits of a task in turn: their key and their lines, as lists of few at a time."""

    def runs() -> Iterator[tuple[tuple, list]]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns))
            for key, group in groupby(rows, key=lambda r: r[:-1]):
                yield key, [r[-1] for r in group]

    for key, parts in groupby(runs(), key=lambda x: x[0]):
        yield key, (lines for _, lines in parts)


def _decodes(text: bytes, encoding: str) -> bool:
    try:
        text.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _split_states(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, out = LineStates(sep), []
        for (path, start), parts in _by_split(batches):
            ends, fits = [False, True], [True] * len(ENCODINGS)
            for lines in parts:
                text = b"\n".join(lines)
                if not text.isascii():
                    fits = [ok and _decodes(text, e) for ok, e in zip(fits, ENCODINGS)]
                if b'"' in text:
                    for line in lines:
                        if ends[0] == ends[1]:
                            ends[0] = ends[1] = states.after(line, ends[0])
                        else:
                            ends = [states.after(line, ends[0]), states.after(line, ends[1])]
            out.append((path, start, *ends, fits))
        columns = list(zip(*out)) or [[]] * 5
        types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.bool_())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["path", "start", "from_shut", "from_open", "fits"])

    return run


def _splits(lines: DataFrame, sep: str) -> DataFrame:
    """(path, encoding, starts, opened, crossed) of each file: its splits, whether a quotation is open where each begins, and whether one is where any ends."""
    each = lines.mapInArrow(_split_states(sep), "path string, start long, from_shut boolean, from_open boolean, fits array<boolean>")
    order = Window.partitionBy("path").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # a split either sets the state, or keeps it, or turns it over; turns count since the last split that set it
    each = each.withColumn("turns", F.sum((F.col("from_shut") & ~F.col("from_open")).cast("int")).over(order))
    fixed = F.when(F.col("from_shut") == F.col("from_open"), F.struct("start", "from_shut", "turns"))
    each = each.withColumn("base", F.max(fixed).over(before)).withColumn("done", F.coalesce(F.lag("turns").over(order), F.lit(0)))
    turned = (F.col("done") - F.coalesce("base.turns", F.lit(0))) % 2 == 1
    opened = F.coalesce("base.from_shut", F.lit(False)) != turned
    fits = F.array(*[F.bool_and(F.get("fits", F.lit(i))) for i in range(len(ENCODINGS))])
    crossed = F.bool_or(F.when(F.col("opened"), F.col("from_open")).otherwise(F.col("from_shut")))
    files = each.withColumn("opened", opened).groupBy("path").agg(fits.alias("fits"), F.sort_array(F.collect_list(F.struct("start", "opened"))).alias("s"), crossed.alias("crossed"))
    encoding = F.get(F.array(*map(F.lit, ENCODINGS)), (F.array_position("fits", F.lit(True)) - 1).cast("int"))
    return files.select("path", F.when(F.array_contains("fits", True), encoding).alias("encoding"), F.transform("s", lambda x: x["start"]).alias("starts"), F.transform("s", lambda x: x["opened"]).alias("opened"), "crossed")


def _cut(sep: str, whole: bool):
    """The records of each split, parsed (whole), or what crosses its ends: tail 1 begins a record, tail 0 goes on with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = LineStates(sep)

        def decoded(lines: list[bytes], encoding: str, first: bool) -> str:
            text = b"\n".join(lines)
            return (text.removeprefix(_BOM) if first else text).decode("utf-8" if encoding == "utf-8-sig" else encoding)

        def rows(key: tuple, cells: list[list[str]], done: int) -> pa.RecordBatch:
            n, at = len(cells), range(done, done + len(cells))
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(at, pa.int64()), pa.array(cells, pa.list_(pa.string()))], names=["path", "start", "place", "cells"])

        def fragment(key: tuple, tail: int, done: int, lines: list[bytes]) -> pa.RecordBatch:
            columns = [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([tail], pa.int32()), pa.array([done], pa.int64()), pa.array([b"\n".join(lines)])]
            return pa.RecordBatch.from_arrays(columns, names=["path", "start", "tail", "place", "part"])

        for (path, start, is_open, encoding), parts in _by_split(batches):
            head: list[bytes] | None = [] if is_open else None
            held: list[bytes] = []  # lines of the record that is not ended
            key, done, state = (path, start), 0, is_open
            for lines in parts:
                ended: list[bytes] = []
                for line in lines:
                    state = states.after(line, state)
                    (held if head is None else head).append(line)
                    if state:
                        continue
                    if head is None:
                        ended += held
                        held = []
                    else:
                        if not whole:
                            yield fragment(key, 0, 0, head)
                        head = None
                if ended:
                    # texts of cells are needed by the pass for rows alone; the other one needs their number where the file begins
                    if whole or start == 0:
                        cells = parsed(decoded(ended, encoding, start == 0 and done == 0) + "\n", sep)
                        if whole:
                            yield rows(key, cells, done)
                        done += len(cells)
                    else:
                        done += 1
            if not whole and head:
                yield fragment(key, 0, 0, head)
            if not whole and held:
                yield fragment(key, 1, done, held)

    return run


_ROWS = "path string, start long, place long, cells array<string>"
_FRAGMENTS = "path string, start long, tail int, place long, part binary"


def _stitched(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, place, encoding, parts in zip(*(c.to_pylist() for c in b.columns)):
                text = b"\n".join(parts)
                text = text.removeprefix(_BOM) if start == 0 and place == 0 else text
                cells = parsed(text.decode("utf-8" if encoding == "utf-8-sig" else encoding), sep)
                columns = [pa.array([path] * len(cells), pa.string()), pa.array([start] * len(cells), pa.int64()), pa.array(range(place, place + len(cells)), pa.int64()), pa.array(cells, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "start", "place", "cells"])

    return run


def records(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, list]:
    """((path, start, place, cells), files): each record of each file under path, with its place among those that begin in its split.

    A pass over the lines finds the states and encodings when the plan is built; where a record crosses a
    split, another one gathers such records. The splits of both must be the same, which is checked: a
    session whose number of cores changes between them fails rather than reads wrongly.
    """
    if len(sep) != 1 or not sep.isascii() or sep in '"\r\n':
        raise RequestError("a separator is one ASCII character, no quotation mark and no line break")
    lines = physical_lines(spark, path)
    found = sorted(_splits(lines, sep).collect())  # a row for each file, a number and a bit for each of its splits
    unread = [r.path for r in found if r.encoding is None]
    if unread:
        raise RequestError(f"{unread[0]} is in none of {', '.join(ENCODINGS)}")
    known = spark.createDataFrame([tuple(r)[:4] for r in found], "path string, encoding string, starts array<long>, opened array<boolean>")
    placed = lines.join(F.broadcast(known), "path", "left")  # some ten bytes for a split of many megabytes
    at = F.coalesce(F.array_position("starts", F.col("start")).cast("int"), F.lit(0))
    is_open = F.when(at > 0, F.get("opened", at - 1)).otherwise(F.raise_error(F.lit("the splits of the file have changed; read it again")).cast("boolean"))
    placed = placed.select("path", "start", is_open.alias("is_open"), "encoding", "line")
    rows = placed.mapInArrow(_cut(sep, True), _ROWS)
    if any(r.crossed for r in found):
        order = Window.partitionBy("path").orderBy("start", "tail")
        pieces = placed.mapInArrow(_cut(sep, False), _FRAGMENTS).withColumn("run", F.sum("tail").over(order))
        joined = pieces.groupBy("path", "run").agg(F.sort_array(F.collect_list(F.struct("start", "tail", "place", "part"))).alias("p"))
        first = F.get("p", F.lit(0))
        crossing = joined.join(F.broadcast(known.select("path", "encoding")), "path").select("path", first["start"].alias("start"), first["place"].alias("place"), "encoding", F.transform("p", lambda x: x["part"]).alias("parts"))
        rows = rows.unionByName(crossing.mapInArrow(_stitched(sep), _ROWS))
    return rows, found


def _leading(spark: SparkSession, file, sep: str) -> tuple[list[list[str]], list[int]]:
    """The first records of a file, and for each the bytes up to its end."""
    n = 64
    while True:
        lines = [bytes(r.line) for r in physical_lines(spark, file.path).select("line").limit(n).collect()]
        rows, ends, held, size, states, is_open = [], [], [], 0, LineStates(sep), False
        for line in lines:
            held.append(line)
            size += len(line) + 1
            is_open = states.after(line, is_open)
            if not is_open or len(held) == len(lines) < n:
                text = b"\n".join(held).removeprefix(_BOM if not rows else b"")
                cells = parsed(text.decode("utf-8" if file.encoding == "utf-8-sig" else file.encoding) + "\n", sep)
                rows, ends, held = rows + cells, ends + [size] * len(cells), []
        if len(rows) > MAX_NOISE_ROWS or len(lines) < n:
            return rows[: MAX_NOISE_ROWS + 1], ends
        n *= 8


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV file, or a folder of such files of one layout, as text columns.

    Cells may hold line breaks and separators within quotation marks; each file is UTF-8, Big5 (cp950) or
    GB18030, whichever decodes it first. Titles above the header and blank rows are left out, cells beyond
    the header too; missing cells are null. Each file begins with the header, after as many rows as in the
    first file. Whether those are titles is asked of the widest row, in one more pass, only if the first row
    has one value at most. The line feed that ends a file belongs to no cell, even if a quotation is never
    closed. An empty file has no rows and is refused.
    """
    rows, files = records(spark, path, sep)
    if not files:
        raise RequestError(f"{path} has no rows")
    head, ends = _leading(spark, files[0], sep)
    if not any(filled_cells(r) for r in head):
        raise RequestError(f"{path} has no rows")
    skip = 0
    if filled_cells(head[0]) <= 1:
        n = F.size(F.filter("cells", lambda c: ~F.lower(F.trim(c)).isin("", "nan")))
        skip = noise_rows(head, rows.agg(F.max(n).alias("n")).first().n)
    if len(files[0].starts) > 1 and ends[skip] > files[0].starts[1]:
        raise RequestError("the header does not end within the first split; read larger splits")
    names, header = unique_headers(head[skip]), head[skip]
    same = F.col("cells") == F.array(*map(F.lit, header)).cast("array<string>")
    leads = (F.col("start") == 0) & (F.col("place") <= skip)
    kept = F.when(~leads, True).when((F.col("place") < skip) | same, False).otherwise(F.raise_error(F.lit("a file has another header than the first one")).cast("boolean"))
    body = rows.where(kept).where(F.exists("cells", lambda c: F.trim(c) != ""))
    return body.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
