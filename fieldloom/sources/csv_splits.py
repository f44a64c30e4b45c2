"""CSV records from files of any size, read by all cores, quoted line breaks included.

Files are read as lines, so one large file has many splits. A line begins inside a quoted cell or it does not; for every split a first pass notes where it would end from either start, and
how many records would begin in it. Those few rows, put together in order of the splits, tell each split how it really starts and how many records stand before it; a second pass then cuts and numbers
the records of every split alone. Only a record that runs over the end of a split is put together from its pieces.

Cells follow Spark's own reader: a doubled quote is a quote, a quote inside an unquoted cell is itself, a cell that goes on after its closing quote is taken as written, an empty cell is null, and lines
without any character are no records.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions.text import basename
from fieldloom.session import materialise

DELIMITERS = (",", ";", "\t")
SAMPLE_CHARS, SAMPLE_LINES = 1024, 5
RECORD_CHARS = 64 << 20
PIECES = "path string, block long, number long, piece boolean, text string, cells array<string>, closed boolean, delimiter string"


def closing(text: str, at: int) -> int:
    """Place after the quote that closes a cell whose content is read at ``at``; -1 if none does."""
    while (at := text.find('"', at)) >= 0:
        if text[at + 1:at + 2] != '"':
            return at + 1
        at += 2
    return -1


def ends_inside(line: str, delimiter: str, inside: bool) -> bool:
    """Is a quoted cell open after this line, if one was (not) open before it?"""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside or line[at:at + 1] == '"':
            at = closing(line, at if inside else at + 1)
            if at < 0:
                return True
        inside = False
        at = line.find(delimiter, at) + 1
        if at == 0:
            return False


def cells_of(record: str, delimiter: str) -> tuple[list, bool]:
    """Cells of a record, and whether its last quoted cell is closed."""
    record = record.removesuffix("\r")
    if '"' not in record:
        return [c or None for c in record.split(delimiter)], True
    cells, at = [], 0
    while True:
        end = closing(record, at + 1) if record[at:at + 1] == '"' else at
        if end < 0:
            return [*cells, _plain(record[at + 1:])], False
        stop = record.find(delimiter, end)
        stop = len(record) if stop < 0 else stop
        cells.append((_plain(record[at + 1:end - 1]) if stop == end > at else record[at:stop]) or None)
        if stop == len(record):
            return cells, True
        at = stop + 1


def _plain(quoted: str) -> str:
    return quoted.replace('""', '"').replace("\r\n", "\n")


def delimiter_in(sample: str) -> str:
    """A comma anywhere in the sample, else a semicolon, else a tab."""
    return next((d for d in DELIMITERS[:2] if d in sample), DELIMITERS[2])


def file_lines(spark: SparkSession, path: str, plain_path, pattern: str = "*.csv") -> DataFrame:
    """path, block, at, value: every line of every file named like ``pattern``; ``at`` rises within a split."""
    lines = spark.read.format("text").options(recursiveFileLookup=True, lineSep="\n", pathGlobFilter=pattern).load(path)
    return lines.select(plain_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def file_heads(lines: DataFrame) -> DataFrame:
    """Per file: delimiter, first lines (cut to the sample size) and header cells, from the start of its first split."""
    def read(batches):
        path, held, done = None, [], set()
        for batch in batches:
            for now, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now != path:
                    if held:
                        yield head(path, held)
                    path, held = now, []
                if path in done:
                    continue
                held.append(line)
                if len(held) >= SAMPLE_LINES and sum(map(len, held)) >= SAMPLE_CHARS and first_record(held)[1]:
                    yield head(path, held)
                    held, done = [], {path}
        if held:
            yield head(path, held)

    def first_record(held):
        delimiter, inside, record = delimiter_in("\n".join(held)[:SAMPLE_CHARS]), False, []
        for line in held:
            if line.removesuffix("\r") or record:
                record.append(line)
                inside = ends_inside(line, delimiter, inside)
                if not inside:
                    return record, True
        return record, False

    def head(path, held):
        delimiter = delimiter_in("\n".join(held)[:SAMPLE_CHARS])
        header = [c or "" for c in cells_of("\n".join(first_record(held)[0]), delimiter)[0]]
        while len(header) > 1 and not header[-1]:
            header.pop()
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([delimiter]), pa.array([[x[:SAMPLE_CHARS] for x in held[:SAMPLE_LINES]]]), pa.array([header], pa.list_(pa.string()))],
                                          ["path", "delimiter", "lines", "header"])

    return lines.where("block = 0").select("path", "value").mapInArrow(read, "path string, delimiter string, lines array<string>, header array<string>")


def split_ends(lines: DataFrame) -> DataFrame:
    """Per split and delimiter: is a quoted cell open at its end, and how many records begin in it, from either start (``closed`` and ``open``)."""
    names = ["path", "block", "delimiter", "closed_end", "closed_count", "open_end", "open_count"]

    def read(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for path, block, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (path, block) != key:
                    done += rows(key, state)
                    key, state = (path, block), {d: [False, 0, True, 0] for d in DELIMITERS}
                worded, quoted = line not in ("", "\r"), '"' in line
                for d, s in state.items():
                    s[1] += worded and not s[0]
                    s[3] += worded and not s[2]
                    if quoted:
                        s[0], s[2] = ends_inside(line, d, s[0]), ends_inside(line, d, s[2])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if key:
            yield pa.RecordBatch.from_pylist(rows(key, state), schema)

    def rows(key, state):
        return [dict(zip(names, (*key, d, *s))) for d, s in state.items()] if key else []

    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("delimiter", pa.string()), ("closed_end", pa.bool_()), ("closed_count", pa.int64()), ("open_end", pa.bool_()), ("open_count", pa.int64())])
    return lines.select("path", "block", "value").mapInArrow(read, "path string, block long, delimiter string, closed_end boolean, closed_count long, open_end boolean, open_count long")


def split_starts(ends: DataFrame) -> DataFrame:
    """path, unclosed, block, inside, before: how each split starts, the records that begin before it, and whether the file ends in an open cell. One row a split is put in order, never a row a line."""
    one = F.struct("block", "closed_end", "closed_count", "open_end", "open_count")
    files = ends.groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("splits"))
    start = F.expr("named_struct('inside', false, 'number', 0L, 'done', cast(array() as array<struct<block:bigint,inside:boolean,before:bigint>>))")

    def go(state, split):
        here = F.struct(split["block"].alias("block"), state["inside"].alias("inside"), state["number"].alias("before"))
        return F.struct(F.when(state["inside"], split["open_end"]).otherwise(split["closed_end"]).alias("inside"),
                        (state["number"] + F.when(state["inside"], split["open_count"]).otherwise(split["closed_count"])).alias("number"),
                        F.concat(state["done"], F.array(here)).alias("done"))

    told = files.select("path", F.aggregate("splits", start, go).alias("told"))
    return told.select("path", F.col("told.inside").alias("unclosed"), F.inline("told.done"))


def cut(batches):
    """Records of splits (path, block, value, inside, before, delimiter), numbered from 1; those that run over a split's end or begin before it as pieces."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("piece", pa.bool_()), ("text", pa.string()), ("cells", pa.list_(pa.string())), ("closed", pa.bool_()), ("delimiter", pa.string())])
    key, held, inside, number, tail, delimiter = None, [], False, 0, False, ","
    for batch in batches:
        done = []
        for path, block, line, starts, before, sign in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if (path, block) != key:
                if held:
                    done.append((*key, number, True, "\n".join(held), None, None, delimiter))
                key, held, inside, number, tail, delimiter = (path, block), [], starts, before, starts, sign
            if not inside:
                if line in ("", "\r"):
                    continue
                number += 1
                tail = False
            held.append(line)
            inside = ends_inside(line, delimiter, inside)
            if not inside:
                text, held = "\n".join(held), []
                if tail:
                    done.append((path, block, number, True, text, None, None, delimiter))
                else:
                    cells, closed = cells_of(text, delimiter)
                    done.append((path, block, number, False, text if '"' in text else None, cells, closed, delimiter))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, number, True, "\n".join(held), None, None, delimiter), schema)], schema=schema)


def joined_pieces(pieces: DataFrame, longest: int) -> DataFrame:
    """Records put together from their pieces; of those that are too long every piece goes on alone, without cells."""
    sized = pieces.withColumn("chars", F.sum(F.length("text")).over(Window.partitionBy("path", "number")))  # a piece a split at most
    text = F.array_join(F.array_sort(F.collect_list(F.struct("block", "text")))["text"], "\n")
    whole = sized.where(F.col("chars") <= longest).groupBy("path", "number", "delimiter").agg(F.min("block").alias("block"), text.alias("text"))

    def parse(batches):
        for batch in batches:
            found = [cells_of(text, d) for text, d in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([True] * batch.num_rows), batch.column(3),
                                              pa.array([c for c, _ in found], pa.list_(pa.string())), pa.array([c for _, c in found], pa.bool_()), batch.column(4)], names)

    names = ["path", "block", "number", "piece", "text", "cells", "closed", "delimiter"]
    short = whole.select("path", "block", "number", "text", "delimiter").mapInArrow(parse, PIECES)
    return short.unionByName(sized.where(F.col("chars") > longest).select(*names))


def read_records(spark: SparkSession, path: str, plain_path, longest: int = RECORD_CHARS, pattern: str = "*.csv") -> DataFrame:
    """path, source_file, row_number, header, cells, surplus, lines, text, reason for every record under the headers of the CSVs in ``path``.

    ``cells`` is as long as the header. ``reason`` is null for sound records; 'surplus cells' and 'unclosed quote' records keep their cells and have their text beside them; pieces of a
    record of more than ``longest`` characters have a text only ('record too long').
    """
    lines = file_lines(spark, path, plain_path, pattern)
    heads = materialise(file_heads(lines), "heads")
    starts = split_starts(split_ends(lines).join(heads.select("path", "delimiter"), ["path", "delimiter"]))
    starts = materialise(starts.join(heads.select("path", "delimiter"), "path"), "splits")
    wanted = lines.join(starts, ["path", "block"]).sortWithinPartitions("path", "block", "at")  # a split's lines stay together, whatever the join
    found = wanted.select("path", "block", "value", "inside", "before", "delimiter").mapInArrow(cut, PIECES)
    records = found.where("NOT piece")
    broken = starts.where("inside OR unclosed").select("path").distinct()
    if not broken.isEmpty():
        records = records.unionByName(joined_pieces(found.where("piece").join(broken, "path", "left_semi"), longest))
    rows = records.where("number > 1").join(heads.select("path", "header", "lines"), "path")
    size, own = F.size("header"), F.col("cells")
    surplus = F.filter(F.slice("cells", size + 1, F.greatest(F.size("cells") - size, F.lit(0))), lambda c: c.isNotNull())
    reason = (F.when(own.isNull(), "record too long").when(~F.col("closed"), "unclosed quote").when(F.size(surplus) > 0, "surplus cells"))
    padded = F.when(own.isNotNull(), F.transform("header", lambda _, i: F.get(own, i)))
    text = F.coalesce("text", F.expr("array_join(cells, delimiter, '')"))
    return rows.select("path", basename(F.col("path")).alias("source_file"), (F.col("number") - 1).alias("row_number"), "header", padded.alias("cells"), F.when(own.isNotNull(), surplus).alias("surplus"),
                       "lines", text.alias("text"), reason.alias("reason"))
