"""Column functions over delimited text held in a column, and header rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom import rules
from threadloom.functions.text import strip

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def text_lines(text: Column) -> Column:
    return F.filter(F.split(strip(text), LINE_BREAK), lambda line: line.rlike(r"(?U)\S"))


def line_count(text: Column) -> Column:
    """Number of lines; a final line break starts no new line."""
    ended = F.regexp_replace(text, "(" + LINE_BREAK + r")\z", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(ended, LINE_BREAK)))


def _count(line: Column, delimiter: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(delimiter), F.lit("")))


def delimiter_of(lines: Column, order: list[str] = rules.DELIMITERS, head: int | None = None,
                 min_rows: int = 2) -> Column:
    """First delimiter found equally often, and at all, on every line; null if none."""
    seen = lines if head is None else F.slice(lines, 1, head)

    def votes(delimiter: str) -> Column:
        # most texts are settled by their first line, the others by the first one that differs
        first = _count(F.get(seen, F.lit(0)), delimiter)
        return (first > 0) & F.forall(seen, lambda line: _count(line, delimiter) == first)

    choice = F.coalesce(*[F.when(votes(d), F.lit(d)) for d in order])
    return F.when(F.size(lines) >= min_rows, choice)


def plain_delimiter_of(text: Column) -> Column:
    """Looser rule: the delimiter occurs somewhere on each of the first five lines."""
    lines = F.split(strip(text), "\n")
    head = F.slice(lines, 1, 5)
    found = [
        F.when(F.forall(head, lambda line: F.contains(line, F.lit(d))), F.lit(d)) for d in rules.DELIMITERS_PLAIN
    ]
    return F.when(F.size(lines) >= 2, F.coalesce(*found))


def cells_of(line: Column, delimiter: Column) -> Column:
    """Cells of one line; quoted cells may hold the delimiter and doubled quotes."""
    quoted = F.lit('"')
    # each cell is read together with the delimiter before it, the first one with an added one
    field = F.concat(F.lit(r"\Q"), delimiter, F.lit(r'\E("(?:[^"]|"")*"|(?:(?!\Q'), delimiter, F.lit(r"\E).)*)"))
    parts = F.transform(
        F.regexp_extract_all(F.concat(delimiter, line), field, F.lit(1)),
        lambda c: F.when(
            F.startswith(c, quoted) & F.endswith(c, quoted) & (F.length(c) >= 2),
            F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), quoted),
        ).otherwise(c),
    )
    plain = F.split(line, F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E")))
    return F.when(F.contains(line, quoted), parts).otherwise(plain)


def header_cells(line: Column, delimiter: Column) -> Column:
    return F.transform(cells_of(line, delimiter), lambda c: F.lower(strip(c)))


def has_call_header(cells: Column) -> Column:
    return F.arrays_overlap(cells, F.array(*[F.lit(w) for w in rules.CALL_HEADER_WORDS]))


def _position(cells: Column, name: str) -> Column:
    """Zero-based position of the last header cell with this name."""
    return F.when(
        F.array_contains(cells, name), F.size(cells) - F.array_position(F.reverse(cells), name).cast("int")
    )


def call_positions(cells: Column) -> dict[str, Column]:
    """Column positions of a call table, by header name or, without a header, by place."""
    header = has_call_header(cells)

    def chain(names: list[str], place: int, fallback: int | None) -> Column:
        by_name = F.coalesce(*[_position(cells, n) for n in names], F.lit(fallback).cast("int"))
        return F.when(header, by_name).otherwise(F.lit(place))

    return {
        "caller": chain(["caller", "from", "a_number"], 0, 0),
        "called": chain(["called", "to", "b_number"], 1, 1),
        "ts_raw": chain(["timestamp", "date", "time"], 2, None),
        "duration_raw": chain(["duration"], 3, None),
    }


def classify_headers(headers: Column) -> Column:
    """'cdr', 'financial' or 'unknown' from an array of header names."""
    low = F.transform(headers, F.lower)

    def hits(names) -> Column:
        return F.size(F.array_intersect(low, F.array(*[F.lit(n) for n in names])))

    return (
        F.when(hits(rules.CALL_ALIASES) >= 2, "cdr")
        .when(hits(rules.TRANSFER_ALIASES) >= 2, "financial")
        .when(hits(["caller", "called", "from", "to"]) > 0, "cdr")
        .when(hits(["amount", "account", "credit", "debit"]) > 0, "financial")
        .otherwise("unknown")
    )


def first_match(headers: list[str], aliases: list[str]) -> Column:
    """First non-blank value, by alias order, of a column whose name contains the alias."""
    named = [h for alias in aliases for h in headers if alias in h.lower()]
    if not named:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.nullif(strip(F.col(f"`{h}`").cast("string")), F.lit("")) for h in named])


def row_completeness(required: list[str]) -> Column:
    """Share of required columns that are filled."""
    if not required:
        return F.lit(1.0)
    filled = [F.when(strip(F.col(c).cast("string")) != "", 1).otherwise(0) for c in required]
    return sum(filled[1:], filled[0]) / F.lit(float(len(required)))
