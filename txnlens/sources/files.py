"""Readers for the source files: transactions, users and cards CSV, category
lookup, and the fraud-label JSON.

Reading has two halves. The first turns files into text columns (``multiLine`` off,
so files stay splittable): every file's header is checked against the first one's,
so a file with another column order raises instead of misplacing values, and
``by_header=True`` reads files of different orders each by its own header. The
second (``typed_columns``, ``label_pairs``) is a projection over text that also runs
on text from elsewhere: pandas' missing-value markers become null and each column
is cast **by name** to the fixed schema. Columns keep the file's order; missing
required columns raise; extra columns are kept as text. A line with too many or too
few fields is counted by ``parse_failures`` and raises under ``strict``; so is a quoted
line break, unless ``quoted_breaks=True`` has such records put together.
``write_checked`` keeps what does not parse: good rows and rejected ones, with their
reasons and text, are written in one pass.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.functions.nulls import null_na_strings
from txnlens.schemas import CARDS, LABELS, MCC, TXN, USERS


def _cast(c: Column, dtype: T.DataType, date_format: str | None, strict: bool) -> Column:
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.TimestampNTZType) and date_format:
        parsed = F.to_timestamp_ntz(c, F.lit(date_format))
        if strict:
            return parsed
        # unparsable text -> null instead of failing the job
        return F.when(F.try_to_timestamp(c, F.lit(date_format)).isNotNull(), parsed)
    return c.cast(dtype) if strict else c.try_cast(dtype)


#: Holds a line whose number of fields is not the header's.
_BAD_LINE = "__bad_line"
LINE = "(line)"


def _records(spark: SparkSession, path, separator: str = "\n", escape: str | None = None) -> DataFrame:
    """(file, first, value): the records of files whose quoted strings may hold the separator, one row each.

    In CSV files the separator ends a line; below, a line is a piece between two of them.
    ``escape`` begins a pair of characters that is no quote.

    The files are read split by split as lines. A line has an odd number of quotes
    where a quoted field is left open or closed, so the parity of the quotes before it
    says whether it begins a record: summed within a split, and over the splits before
    it (one row a split). The lines are shuffled once, by split, for the running sum;
    then records of one line go straight on, and only the lines of longer ones are
    brought together and joined. ``first`` marks a file's first record. A quote that
    is never closed makes the rest of its file one record, as in other readers.
    """
    bare = F.regexp_replace("value", re.escape(escape) + "(?s:.)", "") if escape else F.col("value")
    lines = spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"), "value", (F.regexp_count(bare, F.lit('"')) % 2).alias("odd"))
    splits = lines.groupBy("file", "split").agg(F.sum("odd").alias("odds"))
    order = Window.partitionBy("file").orderBy("split")
    splits = splits.select("file", "split", F.coalesce(F.sum("odds").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    in_split = Window.partitionBy("file", "split").orderBy("place")
    open_ = (F.col("before") + F.sum("odd").over(in_split) - F.col("odd")) % 2 == 1
    placed = lines.join(splits, ["file", "split"]).withColumn("open", open_)
    # (split, number in it) of the record's first line, if it is in this split
    at = placed.withColumn("begun", F.sum(F.when(F.col("open"), 0).otherwise(1)).over(in_split)).withColumn(
        "whole", ~F.col("open") & (F.col("odd") == 0))
    single = at.filter("whole").select("file", ((F.col("split") == 0) & (F.col("begun") == 1)).alias("first"), "value")
    # the lines of longer records; those before a split's first record belong to the last one of the splits before
    long = at.filter("not whole")
    last = long.groupBy("file", "split").agg(F.max(F.when(~F.col("open"), F.col("begun"))).alias("opened")).withColumn(
        "from", F.last(F.when(F.col("opened").isNotNull(), F.struct("split", F.col("opened").alias("begun"))), True).over(
            order.rowsBetween(Window.unboundedPreceding, -1))).select("file", "split", "from")
    owned = long.join(last, ["file", "split"]).withColumn(
        "record", F.when(F.col("begun") > 0, F.struct("split", "begun")).otherwise(F.col("from")))
    joined = owned.groupBy("file", "record").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("split", "place", "value"))), lambda x: x["value"]), separator).alias("value"))
    return single.unionByName(joined.select("file", ((F.col("record.split") == 0) & (F.col("record.begun") == 1)).alias("first"), "value"))


def _joined_text(spark: SparkSession, path, names: list[str], **options) -> DataFrame:
    """The columns of ``_records`` as text, and ``_BAD_LINE``; a file with another header raises."""
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD_LINE, **options}
    value = F.regexp_replace("value", "\r$", "")
    row = _records(spark, path).withColumn("value", value).filter(F.length("value") > 0).withColumn(
        "row", F.from_csv("value", ", ".join(f"`{n}` string" for n in (*names, _BAD_LINE)), options))
    same = F.array(*[F.col("row").getField(n) for n in names]) == F.array(*map(F.lit, names))
    checked = F.when(~F.col("first"), True).when(same, False).otherwise(
        F.raise_error(F.concat(F.lit("another header in "), F.col("file"), F.lit(": "), F.substring("value", 1, 200))))
    return row.filter(checked).select("row.*")


def _text_columns(spark: SparkSession, path, by_header: bool = False, checked: bool = False, quoted_breaks: bool = False, **options) -> DataFrame:
    """The CSV files' columns as text, and ``_BAD_LINE``.

    ``quoted_breaks`` reads files whose quoted fields hold line breaks (see ``_records``).

    ``checked`` parses whole lines even where few columns are used, without which
    the parser does not notice a malformed line.
    """

    def reader():
        return spark.read.option("header", True).option("escape", '"').option("multiLine", False).options(**options)

    def one(files) -> DataFrame:
        names = reader().csv(files).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, _BAD_LINE)])
        return (reader().schema(schema).option("enforceSchema", False).option("mode", "PERMISSIVE").option("columnPruning", not checked)
                .option("columnNameOfCorruptRecord", _BAD_LINE).csv(files))

    if quoted_breaks:
        if by_header:
            raise ValueError("quoted_breaks needs one header in all files")
        return _joined_text(spark, path, reader().csv(path).columns, **options)
    if not by_header:
        return one(path)
    groups: dict[tuple, list[str]] = {}
    for file in reader().csv(path).inputFiles():
        groups.setdefault(tuple(reader().csv(file).columns), []).append(file)
    parts = [one(files) for files in groups.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def typed_columns(raw: DataFrame, schema: T.StructType, date_format: str | None = None, strict: bool = False,
                  rename: dict[str, str] | None = None) -> DataFrame:
    """Text columns to typed rows: missing markers to null, known columns cast by name.

    ``strict=False`` (default): a value that does not parse becomes null.
    ``strict=True``: it fails the job, as does a malformed line.
    """
    if rename:
        raw = raw.withColumnsRenamed(rename)
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    names = [c for c in raw.columns if c != _BAD_LINE]
    raw = null_na_strings(raw, names)
    types = {f.name: f.dataType for f in schema.fields}

    def column(c: str) -> Column:
        out = _cast(F.col(f"`{c}`"), types[c], date_format, strict) if c in types else F.col(f"`{c}`")
        if strict and _BAD_LINE in raw.columns:
            out = F.when(F.col(_BAD_LINE).isNull(), out).otherwise(
                F.raise_error(F.concat(F.lit("malformed line: "), F.substring(_BAD_LINE, 1, 200))))
        return out.alias(c)

    # the file's own column order, like pandas
    return raw.select(*[column(c) for c in names])


def read_typed_csv(spark: SparkSession, path, schema: T.StructType, date_format: str | None = None,
                   strict: bool = False, rename: dict[str, str] | None = None, by_header: bool = False,
                   quoted_breaks: bool = False, **options) -> DataFrame:
    """CSV with a header, cast by column name to ``schema`` (see ``typed_columns``).

    ``rename`` maps the file's column names to the schema's (e.g.
    ``{"on_dark_web": "card_on_dark_web"}``) for sources whose headers differ.
    """
    return typed_columns(_text_columns(spark, path, by_header, strict, quoted_breaks, **options), schema, date_format, strict, rename)


def text_failures(raw: DataFrame, schema: T.StructType, date_format: str | None = None) -> DataFrame:
    """Per typed column of ``schema``: values present in the text that do not parse, and malformed lines.

    Columns ``column``, ``failures``; the row ``(line)`` counts malformed lines where
    the reader marks them, else 0.
    """
    names = [c for c in raw.columns if c != _BAD_LINE]
    raw = null_na_strings(raw, names)
    typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType) and f.name in names]
    bad_lines = F.count(_BAD_LINE) if _BAD_LINE in raw.columns else F.lit(0).cast("long")
    counts = raw.agg(*[
        F.count_if(F.col(f"`{f.name}`").isNotNull()
                   & _cast(F.col(f"`{f.name}`"), f.dataType, date_format, False).isNull()).alias(f.name)
        for f in typed], bad_lines.alias(LINE))
    return counts.unpivot([], [*[f.name for f in typed], f"`{LINE}`"], "column", "failures")


def parse_failures(spark: SparkSession, path, schema: T.StructType, date_format: str | None = None,
                   by_header: bool = False, quoted_breaks: bool = False, **options) -> DataFrame:
    """``text_failures`` of CSV files.

    The non-strict readers turn such values into null; this counts them (one
    aggregation over the files), so bad dates, ids and lines are reported, not lost.
    """
    return text_failures(_text_columns(spark, path, by_header, True, quoted_breaks, **options), schema, date_format)


#: Columns beside the typed ones in what ``checked_columns`` returns.
STATUS, REASONS, SOURCE = "status", "reasons", "source"


def checked_columns(raw: DataFrame, schema: T.StructType, date_format: str | None = None, rename: dict[str, str] | None = None,
                    required: list[str] | None = None) -> DataFrame:
    """Text columns to typed rows, good and rejected ones, without loss.

    A row is rejected if a value that is there does not parse, if a ``required``
    column is missing in it, or if the reader marks its line as malformed. Adds
    ``reasons`` (the columns, or ``(line)``; empty for good rows), ``source`` (a rejected
    row's text: its line if malformed, else its fields as JSON) and ``status`` (``good``
    or ``rejected``). Rejected rows keep the values that do parse.
    """
    if rename:
        raw = raw.withColumnsRenamed(rename)
    names = [c for c in raw.columns if c != _BAD_LINE]
    if clash := {STATUS, REASONS, SOURCE}.intersection(names):
        raise ValueError(f"columns {sorted(clash)} would be overwritten; rename them")
    marked = _BAD_LINE in raw.columns
    bad_line = F.col(_BAD_LINE).isNotNull() if marked else F.lit(False)
    fields = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]))
    kept = raw.select("*", fields.alias("__fields"))
    text = null_na_strings(kept, names)
    typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType) and f.name in names]
    reasons = [F.when(F.col(f"`{f.name}`").isNotNull() & _cast(F.col(f"`{f.name}`"), f.dataType, date_format, False).isNull(), f.name) for f in typed]
    reasons += [F.when(F.col(f"`{c}`").isNull(), c) for c in required or []]
    # a malformed line's fields are not where they belong, so the line is its only reason
    listed = F.when(bad_line, F.array(F.lit(LINE))).otherwise(F.array_distinct(F.array_compact(F.array(*reasons))) if reasons else F.array().cast("array<string>"))
    told = text.withColumn(REASONS, listed)
    line = F.coalesce(_BAD_LINE, "__fields") if marked else F.col("__fields")
    told = told.withColumn(SOURCE, F.when(F.size(REASONS) > 0, line)).withColumn(STATUS, F.when(F.size(REASONS) > 0, "rejected").otherwise("good"))
    types = {f.name: f.dataType for f in schema.fields}
    if missing := [c for c in types if c not in names]:
        raise ValueError(f"missing columns {missing}")
    values = [(_cast(F.col(f"`{c}`"), types[c], date_format, False) if c in types else F.col(f"`{c}`")).alias(c) for c in names]
    return told.select(*values, REASONS, SOURCE, STATUS)


def write_checked(spark: SparkSession, path, out: str, schema: T.StructType, date_format: str | None = None, rename: dict[str, str] | None = None,
                  required: list[str] | None = None, by_header: bool = False, quoted_breaks: bool = False, **options) -> DataFrame:
    """CSV files to Parquet at ``out`` in one pass: good and rejected rows in a folder each (see ``checked_columns``).

    Returns the written table (later: ``spark.read.parquet(out)``) for ``good_rows``,
    ``rejected_rows`` and ``rejection_counts``, which do not read the sources again.
    Without any row no file is written, and the table returned is empty.
    """
    raw = _text_columns(spark, path, by_header, True, quoted_breaks, **options)
    checked = checked_columns(raw, schema, date_format, rename, required)
    checked.write.mode("overwrite").partitionBy(STATUS).parquet(out)
    return spark.read.schema(checked.schema).parquet(out)


def good_rows(checked: DataFrame) -> DataFrame:
    """The good rows of a table of ``write_checked``; only their files are read."""
    return checked.filter(F.col(STATUS) == "good").drop(STATUS, REASONS, SOURCE)


def rejected_rows(checked: DataFrame) -> DataFrame:
    """The rejected rows of a table of ``write_checked`` with their reasons and text; only their files are read."""
    return checked.filter(F.col(STATUS) == "rejected").drop(STATUS)


def rejection_counts(checked: DataFrame) -> DataFrame:
    """(reason, rows) of the rejected rows; a row with several reasons counts for each."""
    return rejected_rows(checked).select(F.explode(REASONS).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def read_transactions(spark: SparkSession, path, date_format: str | None = None,
                      strict: bool = False, rename: dict[str, str] | None = None, **options) -> DataFrame:
    """Transactions CSV; ``amount`` stays text for ``clean_transactions``."""
    return read_typed_csv(spark, path, TXN, date_format, strict, rename, **options)


def read_users(spark: SparkSession, path, strict: bool = False, rename: dict[str, str] | None = None,
               **options) -> DataFrame:
    """Users CSV; money columns stay ``$``-prefixed text for ``clean_users``."""
    return read_typed_csv(spark, path, USERS, None, strict, rename, **options)


def read_cards(spark: SparkSession, path, date_format: str | None = None, strict: bool = False,
               rename: dict[str, str] | None = None, **options) -> DataFrame:
    """Cards CSV. ``date_format`` (e.g. ``MM/yyyy``) if the dates are not ISO."""
    return read_typed_csv(spark, path, CARDS, date_format, strict, rename, **options)


def read_mcc(spark: SparkSession, path, rename: dict[str, str] | None = None, **options) -> DataFrame:
    """Merchant category lookup CSV with columns ``code`` and ``description``."""
    return read_typed_csv(spark, path, MCC, None, False, rename, **options)


# one "id": label pair at the end of a piece (the label a JSON string or a bare
# number/boolean/null), followed only by closing braces and blanks
_STRING = r'"(?:[^"\\]|\\.)*"'
_PAIR = rf'({_STRING}\s*:\s*(?:{_STRING}|[^\s,"{{}}\[\]]+))[\s}}]*$'
_NO_PAIR = rf'^[\s{{}}]*(?:{_STRING}\s*:\s*\{{)?[\s{{}}]*$'


def label_pairs(pieces: DataFrame, column: str = "value") -> DataFrame:
    """Pieces of a label object, each with one ``"id": label`` pair at its end, to rows (id, Target).

    The pair is decoded as JSON, so escapes in ids and labels are; a bare ``null`` is
    null, other bare literals are their text. A piece of braces only (an empty
    object) gives no row; anything else without a pair raises.
    """
    piece = F.col(column)
    pair = F.regexp_extract(piece, _PAIR, 1)
    decoded = F.from_json(F.concat(F.lit("{"), pair, F.lit("}")), "map<string,string>")
    checked = F.when(piece.rlike(_PAIR), decoded).when(piece.rlike(_NO_PAIR), F.lit(None)).otherwise(
        F.raise_error(F.concat(F.lit("not an id/label pair: "), F.substring(piece, 1, 200))))
    return (pieces.select(F.explode(checked).alias("id", "Target"))
            .select(F.col("id").cast(LABELS["id"].dataType).alias("id"), "Target"))


def read_label_map(spark: SparkSession, path, whole: bool = False, quoted_commas: bool = False) -> DataFrame:
    """Fraud labels stored as one JSON object ``{"target": {"<id>": "<label>", ...}}``.

    A JSON reader would parse the single object in one task (and infer one
    struct field per id). The file is instead split on commas, which in this
    layout only separate pairs, and the text reader splits the file across tasks
    (see ``label_pairs``). Requires an uncompressed file. A comma inside an id or label
    raises, unless ``quoted_commas=True`` puts such strings together again: whether a
    piece begins inside a string follows from the quotes before it, in its split and in
    the splits before (see ``_records``; one shuffle of the text, a file is still read by
    many tasks). ``whole=True`` reads other layouts: each file is parsed as a map, by one
    task. Columns ``id`` (bigint) and ``Target`` (text).
    """
    if quoted_commas:
        return label_pairs(_records(spark, path, ",", "\\"))
    if not whole:
        return label_pairs(spark.read.option("lineSep", ",").text(path))
    text = spark.read.option("wholetext", True).text(path)
    groups = F.map_values(F.from_json("value", "map<string,map<string,string>>", {"mode": "FAILFAST"}))
    return (text.select(F.explode(groups).alias("group")).select(F.explode("group").alias("id", "Target"))
            .select(F.col("id").cast(LABELS["id"].dataType).alias("id"), "Target"))
