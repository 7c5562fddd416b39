"""Grouped-block CSV: preamble, group header, pulse header, then a group row with its count and that many pulse rows, again and again."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigtables.functions.scalars import MISSING, NUMBER, UNIT_S, cell_number, cell_text, cell_unreadable, narrowed, quoted, shortest_time
from sigtables.operators.catalog import Property, property_errors, property_value
from sigtables.sources.framing import group_lines, numbered

#: Labels of the columns for count, time and name, after normalising, and the delimiters in order of preference.
COUNT = ("count", "pulse_count", "num_pulses", "n", "nrec")
TIME = ("time", "toa", "time_of_arrival", "arrival_time")
NAME = ("groupid", "group_id", "group", "id", "name")
DELIMITERS = (",", ";", "\t", "|")


@dataclass(frozen=True)
class Rule:
    """What becomes of a column: left out, under another key, with a unit, as text or as a narrower number."""

    skip: bool = False
    key: str | None = None
    unit: str | None = None
    text: bool = False
    dtype: str | None = None


@dataclass(frozen=True)
class Profile:
    """count, time and name: labels or keys that say which column it is, where the known names don't; rules: by label or key."""

    preamble: int = 1
    toa_unit: str = "us"
    count: str | None = None
    time: str | None = None
    name: str | None = None
    group_rules: Mapping[str, Rule] = field(default_factory=dict)
    pulse_rules: Mapping[str, Rule] = field(default_factory=dict)


def _key(label: str) -> str:
    return "_".join("".join(c.lower() if c.isascii() and c.isalnum() else " " for c in label).split())


def cells(line: str, sep: str) -> list[str]:
    """The fields of one line: a quote opens only where a field begins, "" inside is one; fields are trimmed."""
    if '"' not in line:
        return [c.strip() for c in line.split(sep)]
    return [c.strip() for c in next(csv.reader([line], delimiter=sep, skipinitialspace=True))]


def _place(keys: list[str], labels: list[str], wanted: str | None, known: Sequence[str], taken: int | None = None) -> int | None:
    """The column that a label names exactly, or its key, or one of the known names."""
    if wanted is not None:
        return labels.index(wanted) if wanted in labels else keys.index(_key(wanted)) if _key(wanted) in keys else None
    return next((keys.index(n) for n in known if n in keys and keys.index(n) != taken), None)


def _renamed(labels: list[str], keys: list[str], rules: Mapping[str, Rule]) -> list[str | None]:
    """The key of each column under its rule; null: left out."""
    own = [rules.get(label, rules.get(key, Rule())) for label, key in zip(labels, keys, strict=True)]
    return [None if r.skip else r.key or k for r, k in zip(own, keys, strict=True)]


#: Files up to so many bytes are framed as a whole, each by one task; longer ones in splits.
SMALL = 64 << 20
#: Bytes of a file framed whole in which lines are looked for at once.
PIECE = 1 << 20
#: Rows that leave a task at once.
BATCH = 20_000
ROWS = pa.schema([("path", pa.string()), ("group_ord", pa.int32()), ("row", pa.int32()), ("line", pa.int64()), ("offset", pa.int64()), ("declared", pa.int32()), ("attributes", pa.map_(pa.string(), pa.string())), ("fields", pa.map_(pa.string(), pa.string())), ("name", pa.string()), ("time", pa.string()), ("time_label", pa.string()), ("time_key", pa.string())])
ROWS_DDL = "path string, group_ord int, row int, line long, offset long, declared int, attributes map<string,string>, fields map<string,string>, name string, time string, time_label string, time_key string"


@dataclass(frozen=True)
class Header:
    """What a file's two headers say: delimiter, labels and keys (None: left out) of both kinds of rows, and the columns of count, name and time."""

    sep: str
    attributes: list[str | None]
    pulse_labels: list[str]
    fields: list[str | None]
    count: int | None
    name: int | None
    time: int | None
    wrong: str | None

    @staticmethod
    def read(group: str, pulse: str, profile: Profile) -> Header:
        sep = max(DELIMITERS, key=lambda d: (len(cells(group, d)), -DELIMITERS.index(d)))
        labels, pulse_labels = cells(group, sep), cells(pulse, sep)
        keys, pulse_keys = [_key(x) for x in labels], [_key(x) for x in pulse_labels]
        count = _place(keys, labels, profile.count, COUNT)
        name = _place(keys, labels, profile.name, NAME, count)
        time = _place(pulse_keys, pulse_labels, profile.time, TIME)
        wrong = "no count column" if count is None else "no time column" if time is None else "a column without a name" if "" in keys + pulse_keys else None
        return Header(sep, _told_apart(_renamed(labels, keys, profile.group_rules)), pulse_labels, _told_apart(_renamed(pulse_labels, pulse_keys, profile.pulse_rules)), count, name, time, wrong)


def _told_apart(keys: list[str | None]) -> list[str | None]:
    """keys, of which the second of a kind gets _2, the third _3, so that no column is lost."""
    out: list[str | None] = []
    for k in keys:
        n, new = 1, k
        while new is not None and new in out:
            n += 1
            new = f"{k}_{n}"
        out.append(new)
    return out


def line_ends(data: np.ndarray, first: int = 0) -> Iterator[tuple[int, int]]:
    """(first byte, byte after the last) of each line of a text from byte `first` on; ends are LF, CRLF or CR.

    They are looked for in pieces of PIECE bytes, so that what is held doesn't grow with the text.
    """
    begun = first
    for low in range(first, len(data), PIECE):
        piece = data[low : low + PIECE]
        feed, back = np.flatnonzero(piece == 10) + low, np.flatnonzero(piece == 13) + low
        lone = back[(back + 1 == len(data)) | (data[np.minimum(back + 1, len(data) - 1)] != 10)]
        at = np.sort(np.concatenate([feed, lone]))
        if len(at):
            end = at - ((data[at] == 10) & (at > first) & (data[np.maximum(at - 1, 0)] == 13))
            yield from zip([begun, *(at[:-1] + 1).tolist()], end.tolist(), strict=True)
            begun = int(at[-1]) + 1
    if begun < len(data):
        yield begun, len(data)


def framed(path: str, content: bytes | pa.Buffer, profile: Profile, most_lines: int | None) -> Iterator[pa.RecordBatch]:
    """The rows of one file, in order. Errors name the byte where the file begins to be something else. Beside the file some batch of rows is held."""
    view = memoryview(content)
    if bytes(view[:2]) in (b"\xff\xfe", b"\xfe\xff"):
        raise ValueError(f"{path}, byte 0: UTF-16")
    first = 3 if bytes(view[:3]) == b"\xef\xbb\xbf" else 0
    spans = line_ends(np.frombuffer(view, np.uint8), first) if len(view) else iter(())
    header: Header | None = None
    begun, seen, group, row, take = "", 0, -1, 0, 0
    out: list[list] = [[] for _ in ROWS]
    maps = {"attributes": ([0], [], []), "fields": ([0], [], [])}
    wanted: dict[str, list[tuple[int, str]]] = {}

    def batch() -> pa.RecordBatch:
        made = {n: pa.MapArray.from_arrays(pa.array(at, pa.int32()), pa.array(k, pa.string()), pa.array(v, pa.string())) for n, (at, k, v) in maps.items()}
        whole = pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.array(c, f.type) for f, c in zip(ROWS, out, strict=True)], schema=ROWS)
        for c in out:
            c.clear()
        maps.update({"attributes": ([0], [], []), "fields": ([0], [], [])})
        return whole

    for number, (a, b) in enumerate(spans, 1):
        try:
            text = bytes(view[a:b]).decode()
        except UnicodeDecodeError as e:
            raise ValueError(f"{path}, line {number}: not UTF-8 (byte {a + e.start})") from e
        bare = text.strip(" ")
        if number <= profile.preamble or not bare or bare[0] == "#":
            continue
        if most_lines is not None and seen >= most_lines:
            break
        seen += 1
        if seen == 1:
            begun = text
            continue
        if header is None:
            header = Header.read(begun, text, profile)
            if header.wrong:
                raise ValueError(f"{path}: {header.wrong}")
            wanted = {n: [(i, k) for i, k in enumerate(keys) if k is not None] for n, keys in (("attributes", header.attributes), ("fields", header.fields))}
            width, time_label, time_key = len(header.pulse_labels), header.pulse_labels[header.time], header.fields[header.time]
            continue
        cell = cells(text, header.sep)
        if own := group < 0 or row == take or len(cell) != width:
            told = cell[header.count].strip() if header.count < len(cell) else ""
            take = int(told) if told.isascii() and told.isdigit() and len(told) <= 9 else None
            group, row = group + 1, 0
        kind, other = ("attributes", "fields") if own else ("fields", "attributes")
        at, keys, values = maps[kind]
        for i, k in wanted[kind]:
            if i < len(cell):
                keys.append(k)
                values.append(cell[i])
        at.append(len(keys))
        maps[other][0].append(maps[other][0][-1])
        fixed = (path, group, -1 if own else row, number, a, take if own else None, None, None, (cell[header.name] if header.name is not None and header.name < len(cell) else None) if own else None, None if own else cell[header.time], time_label, time_key)
        for c, v in zip(out, fixed, strict=True):
            c.append(v)
        row += not own
        if len(out[0]) >= BATCH:
            yield batch()
    if out[0]:
        yield batch()


def lines_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, block, line (from 1), offset (its first byte) and value of each line; large files are read in splits. Ends are LF, CRLF or CR.

    A file in UTF-16 or a line that isn't UTF-8 is an error that names the line and its byte. A task counts the lines and
    bytes of its split; what stands before a split is added from those counts, a row for each split.
    """
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", "\n").text(paths).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"), F.col("value").cast("binary").alias("value"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, line, byte = None, 0, 0
        for batch in batches:
            rows = []
            for path, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (path, block) != where:
                    where, line, byte = (path, block), 0, 0
                pieces = value.removesuffix(b"\r").split(b"\r")
                at = byte
                for x in pieces:
                    rows.append((path, block, line, at, x))
                    line, at = line + 1, at + len(x) + 1
                byte += len(value) + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["path", "block", "_line", "_byte", "value"])

    own = raw.drop("size").mapInArrow(local, "path string, block long, _line long, _byte long, value binary")
    sizes = raw.groupBy("path", "block").agg(F.sum(F.octet_length("value") + 1).alias("_bytes"), F.sum(F.size(F.split(F.regexp_replace(F.decode("value", "ISO-8859-1"), "\r$", ""), "\r"))).alias("_lines"), F.max("size").alias("_size"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # Spark's reader leaves out a byte order mark, which shows in the bytes that a file has beyond its lines (its last end may lack)
    mark = F.when(F.col("_size") - F.sum("_bytes").over(W.partitionBy("path")) >= 2, 3).otherwise(0)
    starts = sizes.select("path", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_lines", "_bytes")))
    starts = starts.join(sizes.select("path", "block", mark.alias("_mark")), ["path", "block"])
    d = own.join(F.broadcast(starts), ["path", "block"])
    d = d.select("path", "block", (F.col("_line") + F.col("_lines_before") + 1).alias("line"), (F.col("_byte") + F.col("_bytes_before") + F.col("_mark")).alias("offset"), "value")
    wrong = F.raise_error(F.format_string("%s, line %d: not UTF-8 (begins at byte %d)", "path", "line", "offset")).cast("string")
    return d.withColumn("value", F.when(F.is_valid_utf8(F.col("value").cast("string")), F.col("value").cast("string")).otherwise(wrong))


def read_rows(spark: SparkSession, paths: str | list[str], profile: Profile = Profile(), most_lines: int | None = None, noted: bool = False) -> DataFrame:
    """path, group_ord, row (-1: a group's own), line, offset, declared, attributes, fields, name, time and the time's label and key, of all rows.

    A row of another width than the pulse header ends a block early and begins the next group; a count that can't be
    read means: up to the next such row. Files of up to SMALL bytes are framed whole, each by one task; longer ones in splits, a
    bucket of lines a task. most_lines: only the first lines of each file that are neither empty nor comments, headers
    included, for a look at it. noted: a column error, with which a file of up to SMALL bytes that can't be read has a row
    (after those before its error), instead of an error.
    """
    files = spark.read.format("binaryFile").load(paths)
    large = [r.path for r in files.where(F.col("length") > SMALL).select("path").collect()]  # names, as a listing has them

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, error = batch.column(0)[i].as_py(), None
                try:
                    for rows in framed(path, batch.column(1)[i].as_buffer(), profile, most_lines):
                        yield rows.append_column("error", pa.nulls(rows.num_rows, pa.string())) if noted else rows
                except ValueError as e:
                    if not noted:
                        raise
                    error = str(e)
                if error:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), *(pa.nulls(1, f.type) for f in ROWS if f.name != "path"), pa.array([error])], [*ROWS.names, "error"])

    small = files.where(F.col("length") <= SMALL).select("path", "content").mapInArrow(frame, ROWS_DDL + (", error string" if noted else ""))
    if not large:
        return small
    split = rows_in_splits(spark, large, profile, most_lines)
    return small.unionByName(split.withColumn("error", F.lit(None).cast("string")) if noted else split)


def rows_in_splits(spark: SparkSession, paths: str | list[str], profile: Profile = Profile(), most_lines: int | None = None) -> DataFrame:
    """read_rows() of files of any length, each read and framed by many tasks."""
    body = lines_of(spark, paths).where((F.col("line") > profile.preamble) & (F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    body = numbered(body, "n").drop("block").where(F.lit(True) if most_lines is None else F.col("n") < most_lines)
    heads = body.where("n < 2").groupBy("path").agg(F.max(F.when(F.col("n") == 0, F.col("value"))).alias("g"), F.max(F.when(F.col("n") == 1, F.col("value"))).alias("p"))

    @F.pandas_udf("sep string, attributes array<string>, pulse_labels array<string>, fields array<string>, count int, name int, time int, wrong string")
    def resolved(group: pd.Series, pulse: pd.Series) -> pd.DataFrame:
        out = [Header.read(g, p, profile) for g, p in zip(group, pulse, strict=True)]
        names = ("sep", "attributes", "pulse_labels", "fields", "count", "name", "time", "wrong")
        return pd.DataFrame([[getattr(h, n) for n in names] for h in out], columns=names).astype({c: "Int32" for c in ("count", "name", "time")})

    @F.pandas_udf("array<string>")
    def split(value: pd.Series, sep: pd.Series) -> pd.Series:
        return pd.Series([cells(v, s) for v, s in zip(value, sep, strict=True)])

    heads = heads.where("p is not null").select("path", resolved("g", "p").alias("h"))
    heads = heads.withColumn("h", F.when(F.col("h.wrong").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "h.wrong")).cast(heads.schema["h"].dataType)).otherwise(F.col("h")))
    d = body.where("n >= 2").join(heads, "path").withColumn("cells", split("value", "h.sep"))
    declared = F.trim(F.get("cells", F.col("h.count")))
    d = d.withColumns({"declared": F.when(declared.rlike(r"^\d{1,9}$"), declared.try_cast("int")), "odd": F.size("cells") != F.size("h.pulse_labels")})
    d = group_lines(d.withColumn("take", F.coalesce(F.col("declared").cast("long"), F.lit(-1).cast("long"))), 2)

    def keyed(keys: Column) -> Column:
        pairs = F.filter(F.arrays_zip(keys.alias("k"), F.col("cells").alias("v")), lambda x: x["k"].isNotNull() & x["v"].isNotNull())
        return F.map_from_entries(pairs)

    none = F.create_map().cast("map<string,string>")
    own = F.col("row") < 0
    return d.select(
        "path", "group_ord", "row", "line", "offset", F.when(own, F.col("declared")).alias("declared"),
        F.when(own, keyed(F.col("h.attributes"))).otherwise(none).alias("attributes"), F.when(~own, keyed(F.col("h.fields"))).otherwise(none).alias("fields"),
        F.when(own, F.get("cells", F.col("h.name"))).alias("name"), F.when(~own, F.get("cells", F.col("h.time"))).alias("time"),
        F.get("h.pulse_labels", F.col("h.time")).alias("time_label"), F.get("h.fields", F.col("h.time")).alias("time_key"),
    )


def read_pulse_csv(spark: SparkSession, paths: str | list[str], profile: Profile = Profile(), strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, pulses, diagnostics). Missing and unreadable cells are NaN; diagnostics has count mismatches and unreadable cells,
    with the line and the byte at which it begins.

    If strict, a count mismatch or an unreadable time is an error before anything is returned; an unreadable field never is.
    """
    return tables_of(read_rows(spark, paths, profile), profile, strict)


def tables_of(rows: DataFrame, profile: Profile = Profile(), strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, pulses, diagnostics) of read_rows()."""
    pulses = rows.where("row >= 0").select("path", "group_ord", F.col("row").alias("idx"), (cell_number(F.col("time")) * UNIT_S[profile.toa_unit]).alias("toa_s"), "fields", "line", "offset")
    actual = pulses.groupBy("path", "group_ord").agg(F.count("*").alias("actual_count"), F.min_by("toa_s", "idx").alias("t0_s"))
    groups = rows.where("row < 0").select("path", "group_ord", "name", "declared", "attributes", "line", "offset").join(actual, ["path", "group_ord"], "left")
    groups = groups.withColumn("actual_count", F.coalesce("actual_count", F.lit(0).cast("long"))).withColumn("declared_count", F.coalesce("declared", "actual_count")).drop("declared")
    counts = groups.where("declared_count != actual_count").select("path", "group_ord", "line", "offset", F.lit(None).cast("string").alias("column"), F.format_string("declares %d pulses and has %d", F.col("declared_count"), F.col("actual_count")).alias("message"))
    text = [k for label, r in profile.pulse_rules.items() if r.text for k in (r.key, _key(label)) if k]
    entry = F.explode(F.map_entries("fields")).alias("e")
    bad = rows.where("row >= 0").select("path", "group_ord", "line", "offset", "time_key", entry).where(cell_unreadable(F.col("e.value")) & (~F.col("e.key").isin(text) if text else F.lit(True)))
    kind = F.when(F.col("e.key") == F.col("time_key"), "unreadable time ").otherwise("unreadable field ")
    found = bad.select("path", "group_ord", "line", "offset", F.col("e.key").alias("column"), F.concat(kind, "e.value").alias("message"))
    wrong = counts.unionByName(found)
    if strict and (first := wrong.where("message NOT LIKE 'unreadable field%'").agg(F.min_by(F.struct("path", "line", "message"), F.struct("path", "line")).alias("w")).first().w):
        raise ValueError(f"{first.path}, line {first.line}: {first.message}")
    return groups, pulses, wrong


def typed_fields(pulses: DataFrame, profile: Profile, keys: Sequence[str]) -> DataFrame:
    """pulses with a column for each key of its fields: text where a rule says so, else a number, narrowed to the rule's dtype."""
    rules = {r.key or _key(label): r for label, r in profile.pulse_rules.items()}

    def column(key: str) -> Column:
        cell, r = F.try_element_at("fields", F.lit(key)), rules.get(key, Rule())
        return cell if r.text else narrowed(cell_number(F.coalesce(cell, F.lit(""))), r.dtype)

    return pulses.select(*[c for c in pulses.columns if c != "fields"], *[column(k).alias(k) for k in keys])


def text_codes(pulses: DataFrame, column: str, *by: str) -> DataFrame:
    """pulses with <column>_code: texts of each group numbered as they first appear."""
    first = pulses.groupBy(*by, column).agg(F.min("idx").alias("_first"))
    codes = first.withColumn(f"{column}_code", F.row_number().over(W.partitionBy(*by).orderBy("_first")) - 1).drop("_first")
    same = [pulses[c].eqNullSafe(codes[c]) for c in (*by, column)]
    return pulses.join(codes, same).select(pulses["*"], codes[f"{column}_code"])


def typed_attributes(groups: DataFrame, definitions: Sequence[Property] = (), *by: str) -> DataFrame:
    """by, key, num_value, txt_value and warning of each attribute of a group.

    A defined property is read by its definition; where that fails the text stays and the warning says why. Of others a
    missing cell is neither, a finite number a number, all else text.
    """
    d = groups.select(*by, F.explode("attributes").alias("key", "cell"))
    number = F.when(F.trim("cell").rlike(NUMBER), F.trim("cell").try_cast("double"))
    gone = F.lower(F.trim("cell")).isin(*MISSING)
    warning, num, txt = F.lit(None).cast("string"), F.when(~gone, number), F.when(~gone & number.isNull(), F.col("cell"))
    for p in definitions:
        is_p, (n, t) = F.col("key") == p.key, property_value(F.col("cell"), p)
        error = property_errors(F.col("cell"), p)
        warning = F.when(is_p, error).otherwise(warning)
        num = F.when(is_p, F.when(error.isNull(), n)).otherwise(num)
        txt = F.when(is_p, F.when(error.isNull(), t).otherwise(F.col("cell"))).otherwise(txt)
    return d.select(*by, "key", num.alias("num_value"), txt.alias("txt_value"), warning.alias("warning"))


def sniff_csv(spark: SparkSession, paths: str | list[str], profile: Profile = Profile(), most_rows: int = 20) -> DataFrame:
    """path, column and kind (integer, number or text) as the first rows of each file's first group suggest; no row for columns without cells.

    At most most_rows rows are looked at: a proposal, which reading doesn't depend on. Only the lines that may hold them are framed.
    """
    rows = read_rows(spark, paths, profile, 3 + most_rows).where((F.col("group_ord") == 0) & F.col("row").between(0, most_rows - 1))
    found = rows.select("path", F.explode("fields").alias("column", "cell")).where(~F.lower(F.trim("cell")).isin(*MISSING))
    v = cell_number(F.col("cell"))
    whole = ~F.isnan(v) & (v == F.floor(v)) & F.abs(v).between(0, (1 << 31) - 1)
    kinds = found.groupBy("path", "column").agg(F.bool_and(whole).alias("whole"), F.bool_and(~cell_unreadable(F.col("cell"))).alias("number"))
    return kinds.select("path", "column", F.when(F.col("whole"), "integer").when(F.col("number"), "number").otherwise("text").alias("kind"))


def write_pulse_csv(groups: DataFrame, pulses: DataFrame, path: str, fields: list[str], preamble: str = "# pulses", time: str = "toa_us", unit: str = "us", whole: bool = False, sep: str = ",", labels: tuple[str, str, str] = ("name", "count", "time")) -> None:
    """groups(group_ord, name) and pulses(group_ord, idx, a time, fields) as text whose parts, in order, are one file.

    whole: each part is a file of its own instead, with the preamble and the headers before its groups. labels: of the
    columns of name, count and time.

    The time is a column in the file's unit, or toa_s in seconds, written with as few decimals as read back the same. Null
    and NaN are empty cells, whole numbers have no fraction, and what would be read otherwise stands in quotes.
    """
    n = pulses.groupBy("group_ord").agg(F.count("*").alias("n"))
    types = dict(pulses.dtypes)

    def text(c: str) -> Column:
        return F.coalesce(quoted(F.col(c), sep) if types[c] == "string" else cell_text(F.col(c).cast("double")), F.lit(""))

    first = F.coalesce(shortest_time(F.col(time), UNIT_S[unit]), F.lit("")) if time == "toa_s" else text(time)
    own = groups.join(n, "group_ord", "left").select("group_ord", F.lit(-1).alias("idx"), F.concat(F.coalesce(quoted(F.col("name"), sep), F.lit("")), F.lit(sep), F.coalesce("n", F.lit(0)).cast("string")).alias("value"))
    rows = pulses.select("group_ord", F.col("idx").cast("int").alias("idx"), F.concat_ws(sep, first, *[text(c) for c in fields]).alias("value"))
    lines = [preamble, sep.join(labels[:2]), sep.join([labels[2], *fields])]
    if whole:

        def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begun = False
            for batch in batches:
                if batch.num_rows and not begun:
                    begun = True
                    yield pa.RecordBatch.from_arrays([pa.array(lines, batch.schema.field(0).type)], schema=batch.schema)
                yield batch

        own.unionByName(rows).repartitionByRange("group_ord").sortWithinPartitions("group_ord", "idx").select("value").mapInArrow(headed, "value string").write.text(path)
        return
    head = groups.sparkSession.createDataFrame([(i - 3, -1, line) for i, line in enumerate(lines)], "group_ord int, idx int, value string")
    own.unionByName(rows).unionByName(head).repartitionByRange("group_ord", "idx").sortWithinPartitions("group_ord", "idx").select("value").write.text(path)
