"""Book files: headers, bodies and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprobe import params

# Markers, field names and date format of the book files.
START_MARK = "*** START"
END_MARK = "*** END"
RELEASE_FIELD = "release date"
PUBLICATION_FIELD = "original publication"
TITLE_FIELD = "title"
DATE_FORMAT = "MMMM d, yyyy"

YEAR_PATTERN = r"(?:^|[^\p{L}\p{N}_])(\d{4})(?:$|[^\p{L}\p{N}_])"


WHITESPACE = " \t\n\r\x0b\x0c"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def lines_of(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def parse_books(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``metadata``, ``body`` and ``parse_error`` to whole book files.

    Header lines end at the first start mark; the body runs to the last end
    mark of the file. Files without one of the marks carry an error and no body.
    """
    rest = [c for c in df.columns if c != text]
    lines = df.select(*rest, lines_of(F.col(text)).alias("_lines"))
    marks = lines.select(
        *rest, "_lines",
        F.array_position(F.transform("_lines", lambda x: x.contains(START_MARK)), True).alias("_start"),
        F.array_position(F.reverse(F.transform("_lines", lambda x: x.contains(END_MARK))), True).alias("_back"))
    start, n = F.col("_start").cast("int"), F.size("_lines")
    end = (n - F.col("_back") + 1).cast("int")  # 1-based line of the last end mark
    head = F.filter(F.slice("_lines", 1, F.greatest(start - 1, F.lit(0))), lambda x: x.contains(":"))
    entry = F.transform(head, lambda x: F.struct(
        F.lower(strip(F.substring_index(x, ":", 1))).alias("key"),
        strip(F.substr(x, F.instr(x, ":") + 1)).alias("value")))
    body_lines = F.slice("_lines", start + 1, F.greatest(end - start - 1, F.lit(0)))
    body = F.when(end - start > 1, F.concat(F.array_join(body_lines, "\n"), F.lit("\n"))).otherwise("")
    error = F.when(start == 0, "no start mark").when(F.col("_back") == 0, "no end mark")
    return marks.select(
        *rest,
        F.when(start > 0, _last_wins(entry)).alias("metadata"),
        F.when(error.isNull(), body).alias("body"),
        error.alias("parse_error"))


def _last_wins(entries: Column) -> Column:
    """Map of key/value structs in which a later key replaces an earlier one.

    Independent of the session's policy for duplicate keys.
    """
    numbered = F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value")))
    # Sorted by key and place, an entry is the last of its key if another key follows.
    ordered = F.array_sort(numbered)
    following = F.concat(F.slice(F.transform(ordered, lambda e: e["key"]), F.lit(2), F.greatest(
        F.size(ordered), F.lit(1))), F.array(F.lit(None).cast("string")))
    paired = F.arrays_zip(ordered.alias("e"), following.alias("k"))
    last = F.filter(paired, lambda p: p["e"].isNotNull() & ~p["e"]["key"].eqNullSafe(p["k"]))
    return F.map_from_arrays(F.transform(last, lambda p: p["e"]["key"]), F.transform(last, lambda p: p["e"]["value"]))


def field(name: str) -> Column:
    return F.coalesce(F.element_at("metadata", F.lit(name)), F.lit(""))


def _date_text(value: Column) -> Column:
    return strip(F.substring_index(value, "[", 1))


def release_date(header: Column) -> Column:
    """Date of the first release line of a raw header; NULL when unparsable."""
    line = F.get(F.filter(F.split(header, "\n"),
                          lambda x: F.lower(x).contains(RELEASE_FIELD + ":")), 0)
    value = F.get(F.split(line, ":"), 1)
    return F.try_to_timestamp(_date_text(value), F.lit(DATE_FORMAT)).cast("date")


def release_date_strict(metadata_value: Column) -> Column:
    """Date from a parsed header field; unparsable text raises."""
    text = _date_text(metadata_value)
    parsed = F.try_to_timestamp(text, F.lit(DATE_FORMAT))
    failed = F.raise_error(F.concat(F.lit("not a release date: "), text)).cast("timestamp")
    return F.coalesce(parsed, failed)


def publication_year(col: Column) -> Column:
    """First word of exactly four digits, as text; NULL without one."""
    return F.nullif(F.regexp_extract(col, YEAR_PATTERN, 1), F.lit(""))


def released_after(df: DataFrame, date: str = params.RELEASE_CUTOFF,
                   col: str = "release_date") -> DataFrame:
    return df.filter(F.col(col) > F.lit(date).cast("date"))


def header_of(content: Column) -> Column:
    """Text of a raw file up to its first start mark, however far down that is."""
    return F.substring_index(decode_header(content, None), START_MARK, 1)


def decode_header(content: Column, n: int | None = params.HEADER_BYTES) -> Column:
    """First ``n`` bytes (None: all) as UTF-8, or as Latin-1 when they are not valid UTF-8."""
    head = content if n is None else F.substring(content, 1, n)
    return F.when(F.is_valid_utf8(head.cast("string")), head.cast("string")).otherwise(
        F.decode(head, "ISO-8859-1"))


def book_corpus(parsed: DataFrame) -> DataFrame:
    """Corpus columns from :func:`parse_books` rows; any bad file fails the build."""
    checked = parsed.filter(F.when(F.col("parse_error").isNull(), F.lit(True)).otherwise(
        F.raise_error(F.col("parse_error")).cast("boolean")))
    return checked.select(
        field(TITLE_FIELD).alias("title"),
        release_date_strict(field(RELEASE_FIELD)).alias("release_date"),
        publication_year(field(PUBLICATION_FIELD)).alias("original_publication"),
        F.col("body").alias("text"))
