"""Call and transfer records from delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom import rules
from threadloom.functions import tabular
from threadloom.functions.text import strip


def detect(docs: DataFrame, order: list[str] = rules.DELIMITERS, head: int | None = None) -> DataFrame:
    """Add ``lines`` and ``delimiter`` (null where the text is not a table)."""
    lined = docs.withColumn("lines", tabular.text_lines(F.col("text")))
    return lined.withColumn("delimiter", tabular.delimiter_of(F.col("lines"), order, head))


def header_layout(docs: DataFrame) -> DataFrame:
    """Per tabular document: header flag and the four column positions."""
    tables = detect(docs).filter("delimiter IS NOT NULL")
    cells = tables.withColumn("header", tabular.header_cells(F.get("lines", F.lit(0)), F.col("delimiter")))
    places = tabular.call_positions(F.col("header"))
    return cells.select(
        "*",
        tabular.has_call_header(F.col("header")).alias("has_header"),
        *[place.alias(f"{name}_at") for name, place in places.items()],
    )


def call_rows(docs: DataFrame) -> DataFrame:
    """Call records of tabular documents (case_id, doc_id, line_no, caller, called, ts_raw, duration_raw)."""
    layout = header_layout(docs)
    data = F.when(F.col("has_header"), F.slice("lines", F.lit(2), F.size("lines"))).otherwise(F.col("lines"))
    rows = layout.select(
        "case_id", "doc_id", "delimiter", "caller_at", "called_at", "ts_raw_at", "duration_raw_at",
        F.posexplode(data).alias("line_no", "line"),
    ).withColumn("cells", tabular.cells_of(F.col("line"), F.col("delimiter")))

    def cell(name: str) -> Column:
        return strip(F.get("cells", F.col(f"{name}_at")))

    return (
        rows.select(
            "case_id", "doc_id", F.col("line_no").cast("long").alias("line_no"),
            *[cell(n).alias(n) for n in ("caller", "called", "ts_raw", "duration_raw")],
        )
        .filter((F.col("caller") != "") & (F.col("called") != ""))
    )


def positional_call_rows(docs: DataFrame) -> DataFrame:
    """Looser variant: fixed positions, no header rule, the line kept as source sentence."""
    tables = docs.withColumn("delimiter", tabular.plain_delimiter_of(F.col("text"))).filter("delimiter IS NOT NULL")
    rows = tables.select(
        "case_id", "doc_id", "delimiter", F.posexplode(F.split(strip(F.col("text")), "\n")).alias("line_no", "line")
    ).filter(strip(F.col("line")) != "")
    quoted = (F.col("delimiter") == ",") & F.contains("line", F.lit('"'))
    plain = F.transform(F.split("line", F.concat(F.lit(r"\Q"), F.col("delimiter"), F.lit(r"\E"))), strip)
    cells = rows.withColumn(
        "cells", F.when(quoted, tabular.cells_of(F.col("line"), F.col("delimiter"))).otherwise(plain)
    ).filter(F.size("cells") >= 2)
    return cells.select(
        "case_id", "doc_id", F.col("line_no").cast("long").alias("line_no"),
        *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("caller", "called", "ts_raw", "duration_raw"))],
        F.col("line").alias("source_sentence"),
    )


def routed(docs: DataFrame) -> DataFrame:
    """Documents with their delimiter, null for narratives, in one pass over the texts.

    The lines go in as the one element of a list: named in several places, they would be cut anew for each.
    """
    lines = F.array(tabular.text_lines(F.col("text")))
    found = F.transform(lines, lambda own: tabular.delimiter_of(own, rules.DELIMITERS))
    return docs.select(*docs.columns, F.explode_outer(found).alias("delimiter"))


def route_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split documents into call tables and narratives."""
    seen = routed(docs)
    return (
        seen.filter("delimiter IS NOT NULL"),
        seen.filter("delimiter IS NULL").select(*docs.columns),
    )


def table_rows(docs: DataFrame) -> DataFrame:
    """Generic tables in documents: one map from header name to cell per non-blank row."""
    tables = detect(docs, rules.DELIMITERS_HEAD, head=5).filter("delimiter IS NOT NULL")
    named = tables.withColumn("header", tabular.cells_of(F.get("lines", F.lit(0)), F.col("delimiter")))
    rows = named.select(
        "case_id", "doc_id", "header", "delimiter",
        F.posexplode(F.slice("lines", F.lit(2), F.size("lines"))).alias("line_no", "line"),
    ).withColumn("cells", tabular.cells_of(F.col("line"), F.col("delimiter")))
    width = F.least(F.size("header"), F.size("cells"))
    filled = rows.filter(F.exists("cells", lambda c: strip(c) != ""))
    return filled.select(
        "case_id", "doc_id", F.col("line_no").cast("long").alias("line_no"),
        F.map_from_arrays(
            F.slice("header", F.lit(1), width), F.slice("cells", F.lit(1), width)
        ).alias("cells"),
    )


def read_table(spark: SparkSession, path: str, sep: str = ",", infer: bool = False) -> DataFrame:
    """Delimited files with a header; rows blank in every column are dropped."""
    table = spark.read.csv(path, sep=sep, header=True, inferSchema=infer, mode="PERMISSIVE")
    blank = F.lit(True)
    for name in table.columns:
        blank = blank & (strip(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))) == "")
    return table.filter(~blank)


def sniff_files(spark: SparkSession, path: str) -> DataFrame:
    """Delimiter per file, voted over all lines by one aggregate, so file size does not matter."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = lines.filter(strip(F.col("value")) != "")
    counts = [tabular._count(F.col("value"), d) for d in rules.DELIMITERS]
    votes = lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("line_count"),
        *[F.min(c).alias(f"low{i}") for i, c in enumerate(counts)],
        *[F.max(c).alias(f"high{i}") for i, c in enumerate(counts)],
    )
    choice = F.coalesce(*[
        F.when((F.col(f"low{i}") == F.col(f"high{i}")) & (F.col(f"low{i}") > 0), F.lit(d))
        for i, d in enumerate(rules.DELIMITERS)
    ])
    return votes.select("path", "line_count", F.when(F.col("line_count") >= 2, choice).alias("delimiter"))


def read_call_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Call records from large headed files, mapped by header name."""
    table = read_table(spark, path, sep)
    low = {c.strip().lower(): c for c in table.columns}

    def pick(names: list[str], place: int | None) -> Column:
        for name in names:
            if name in low:
                return strip(F.col(f"`{low[name]}`"))
        return strip(F.col(f"`{table.columns[place]}`")) if place is not None else F.lit(None).cast("string")

    rows = table.select(
        pick(["caller", "from", "a_number"], 0).alias("caller"),
        pick(["called", "to", "b_number"], 1).alias("called"),
        pick(["timestamp", "date", "time"], None).alias("ts_raw"),
        pick(["duration"], None).alias("duration_raw"),
    )
    return rows.filter((F.col("caller") != "") & (F.col("called") != ""))


def map_aliases(table: DataFrame, aliases: dict[str, list[str]], keep: list[str] = ()) -> DataFrame:
    """Rename by header aliases, value by value; ``keep`` columns pass through untouched."""
    headers = [c for c in table.columns if c not in keep]
    return table.select(*keep, *[tabular.first_match(headers, names).alias(out) for out, names in aliases.items()])


def map_calls(table: DataFrame, keep: list[str] = ()) -> DataFrame:
    return map_aliases(table, rules.CALL_ALIASES, keep)


def map_transfers(table: DataFrame, keep: list[str] = ()) -> DataFrame:
    mapped = map_aliases(table, rules.TRANSFER_ALIASES, keep)
    return mapped.withColumn("currency", F.coalesce("currency", F.lit("USD")))


def call_records(rows: DataFrame) -> DataFrame:
    """Mapped rows as call records without a source sentence."""
    return rows.withColumn("source_sentence", F.lit(None).cast("string"))


def transactions(rows: DataFrame) -> DataFrame:
    """Mapped rows with a readable amount; others are skipped."""
    return (
        rows.filter(strip(F.col("amount").cast("string")) != "")
        .withColumn("amount", F.expr("try_cast(trim(amount) AS DOUBLE)"))
        .filter("amount IS NOT NULL")
        .withColumn("kind", F.lit("transfer"))
    )


def validate_format(table: DataFrame, expected: str = "cdr", keep: list[str] = ()) -> DataFrame:
    """One row: ok flag, row count, error text."""
    headers = F.array(*[F.lit(c) for c in table.columns if c not in keep])
    counted = table.agg(F.count(F.lit(1)).alias("row_count")).withColumn("format", tabular.classify_headers(headers))
    error = (
        F.when(F.col("row_count") == 0, F.lit("No rows"))
        .when((F.col("format") != expected) & F.lit(expected != "unknown"),
              F.concat(F.lit(f"Expected {expected}, got "), F.col("format")))
    )
    return counted.select("row_count", "format", error.isNull().alias("ok"), F.coalesce(error, F.lit("")).alias("error"))


def infer_types(table: DataFrame, order: list[str], rows: int = 10) -> DataFrame:
    """Column kinds guessed from the first rows: number, date, string or unknown."""
    head = table.orderBy(*order).limit(rows).withColumn("_row", F.row_number().over(Window.orderBy(*order)))
    names = [c for c in table.columns]
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), strip(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias("value"))
        for c in names
    ]))
    long = head.select("_row", pairs.alias("p")).select("_row", "p.column", "p.value")
    values = long.groupBy("column").agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("value") != "", F.struct("_row", "value")))), lambda s: s["value"]
        ).alias("values")
    )
    first = F.get("values", F.lit(0))

    def dotted(v: Column) -> Column:
        return F.replace(v, F.lit(","), F.lit("."))

    def numeric(v: Column) -> Column:
        return v.try_cast("double")

    def digits(v: Column) -> Column:
        return F.replace(dotted(v), F.lit("-"), F.lit("")).rlike(r"(?U)^\d+$")

    def one_dot(v: Column) -> Column:
        return F.length(dotted(v)) - F.length(F.replace(dotted(v), F.lit("."), F.lit(""))) <= 1

    checked = F.filter("values", lambda v: digits(v) | one_dot(v))
    readable = F.forall(checked, lambda v: numeric(dotted(v)).isNotNull())
    non_zero = F.forall(checked, lambda v: numeric(dotted(v)) != 0)
    share = F.size(F.filter("values", lambda v: digits(v) | F.contains(v, F.lit(".")))) / F.size("values")
    number = numeric(first).isNotNull() & readable & (non_zero | (share > 0.7))
    dated = F.exists(F.slice("values", 1, 3), lambda v: F.contains(v, F.lit("/")) | F.contains(v, F.lit("-")))
    kind = (
        F.when(F.size("values") == 0, "unknown").when(number, "number").when(dated, "date").otherwise("string")
    )
    return values.select("column", kind.alias("kind"))
