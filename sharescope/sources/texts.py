"""Text out of file bytes.

Plain text and mark-up are decoded by Spark expressions. Of Office and OpenDocument containers, only unzipping
is Python's: it makes their members rows, and a file that can't be opened an error row.
"""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import OPEN_DOCUMENT_FILES, PLAIN_TEXT, SHEET_FILES, SLIDE_FILES, WORD_FILES

# What Windows code page 1252 has at 0x80-0x9F (five places are unassigned).
_CP1252 = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")
_C1 = "".join(chr(c) for c in range(0x80, 0xA0))


def decode_utf16(content: Column) -> Column:
    """UTF-16 after its byte-order mark, in either order; half a unit or half a pair of surrogates becomes U+FFFD."""
    digits = F.hex(content)
    swapped = F.when(F.startswith(digits, F.lit("FFFE")), F.regexp_replace(digits, "(..)(..)", "$2$1")).otherwise(digits)
    first, second = "D[89AB]..", "D[C-F].."

    def repaired(units: Column) -> Column:
        alone = lambda u, i: ((u.rlike(first) & ~F.coalesce(F.get(units, i + 1).rlike(second), F.lit(False)))
                              | (u.rlike(second) & ~F.coalesce(F.get(units, i - 1).rlike(first), F.lit(False))))
        return F.transform(units, lambda u, i: F.when(alone(u, i), "FFFD").otherwise(u))

    # As the element of an array, the units are computed once and not for each of their uses.
    units = F.get(F.transform(F.array(F.regexp_extract_all(swapped, F.lit("...."), F.lit(0))), repaired), 0)
    odd = F.when(F.length(content) % 2 == 1, "FFFD").otherwise("")
    return F.decode(F.unhex(F.concat(F.array_join(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), ""), odd)), "UTF-16BE")


def decode_text(content: Column) -> Column:
    """UTF-16 with a byte-order mark, else UTF-8 (mark dropped), else Windows-1252; broken bytes never raise."""
    utf8 = content.cast("string")
    start = F.substring(content, 1, 2)
    western = F.translate(F.decode(content, "ISO-8859-1"), _C1, _CP1252)
    return (F.when((start == F.lit(b"\xff\xfe")) | (start == F.lit(b"\xfe\xff")), decode_utf16(content))
            .when(F.is_valid_utf8(utf8), F.regexp_replace(utf8, r"\A\x{FEFF}", ""))
            .otherwise(western))


def strip_tags(markup: Column) -> Column:
    """Scripts, styles and tags become blanks; entities stay."""
    bare = F.regexp_replace(markup, r"(?is)<(script|style).*?</\1>", " ")
    return F.regexp_replace(bare, r"<[^>]+>", " ")


def unescape(text: Column) -> Column:
    """Named and numbered entities as characters (Arrow UDF; texts without "&" pass through)."""
    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)

    return run(text)


def unescaped(rows: DataFrame) -> DataFrame:
    """The same for whole (file_id, text) rows, where `text` is still to be computed by array functions."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=batch["text"].map(html.unescape, na_action="ignore"))

    return rows.mapInPandas(run, "file_id bigint, text string")


def markup_text(markup: Column) -> Column:
    return unescape(strip_tags(markup))


# ── Containers ───────────────────────────────────────────────────────────────

# The members of a container that hold text, by kind, in reading order, and what ends a line in them.
_MEMBERS = {
    "word": (WORD_FILES, ["word/document.xml", "word/footnotes.xml", "word/endnotes.xml", "word/(header|footer)[0-9]*.xml"], "p"),
    "slides": (SLIDE_FILES, ["ppt/slides/slide[0-9]+.xml", "ppt/notesSlides/notesSlide[0-9]+.xml"], "p"),
    "sheet": (SHEET_FILES, ["xl/workbook.xml", "xl/sharedStrings.xml"], "si"),
    "open": (OPEN_DOCUMENT_FILES, ["content.xml"], "[ph]"),
}


# Bytes a Python worker hands on at once.
HANDED_ON = 4 << 20


def in_small_batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches that are closed as soon as their `size` adds up to a few megabytes, so that no worker holds the results of a whole batch it was given."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight >= HANDED_ON or len(held) >= 1_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def arrow_rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches, each made a Python tuple only when it is asked for."""
    for batch in batches:
        columns = [batch.column(name) for name in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


_UNZIPPED = pa.schema([("file_id", pa.int64()), ("extension", pa.string()), ("member", pa.string()), ("xml", pa.binary()), ("error", pa.string())])


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each XML member of each archive, and one without a member for each file: all that needs Python."""
    def rows() -> Iterator[tuple]:
        for file_id, extension, content in arrow_rows(batches, "file_id", "extension", "content"):
            members = [(file_id, extension, None, None, None)]
            try:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                    members += [(file_id, extension, m, archive.read(m), None) for m in archive.namelist() if m.endswith(".xml")]
            except Exception as problem:  # whatever is wrong with one file stays with that file
                members = [(file_id, extension, None, None, f"archive cannot be opened: {problem}")]
            yield from members

    return in_small_batches(rows(), _UNZIPPED, lambda r: len(r[3] or b""))


def _element(name: str) -> str:
    return rf"(?:[\w.-]+:)?{name}"


def _lines(kind: Column, xml: Column) -> Column:
    """The lines of text of one member, as expressions over its mark-up; blank ones are left out."""
    between = lambda end: F.split(xml, rf"</{_element(end)}\s*>")
    runs = lambda part: F.array_join(F.regexp_extract_all(
        F.regexp_replace(part, rf"<{_element('tab')}\s*/>", "<t> </t>"), F.lit(rf"<{_element('t')}(?:\s[^<>]*)?>([^<]*)</"), F.lit(1)), "")
    names = F.regexp_extract_all(xml, F.lit(rf"<{_element('sheet')}\s[^<>]*?name=\"([^\"]*)\""), F.lit(1))
    office = lambda end: F.transform(between(end), runs)
    return F.filter(
        F.when(kind == "open", F.transform(between(_MEMBERS["open"][2]), lambda part: F.regexp_replace(part, "<[^<>]*>", "")))
        .when(kind == "sheet", F.concat(names, office(_MEMBERS["sheet"][2])))
        .otherwise(office("p")), lambda line: line != "")


def container_texts(files: DataFrame) -> DataFrame:
    """(file_id, text, error) of Office and OpenDocument files: members are rows, their text comes from expressions."""
    members = files.select("file_id", "extension", "content").mapInArrow(_unzipped, "file_id bigint, extension string, member string, xml binary, error string")
    kind, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, (extensions, patterns, _) in _MEMBERS.items():
        kind = F.when(F.col("extension").isin(extensions), name).otherwise(kind)
        for i, pattern in enumerate(patterns):
            whole = F.col("extension").isin(extensions) & F.col("member").rlike(rf"\A{pattern.replace('.xml', '[.]xml')}\z")
            rank = F.when(whole, i).otherwise(rank)
    number = F.coalesce(F.regexp_extract("member", "([0-9]+)[.]xml", 1).try_cast("int"), F.lit(0))
    read = members.withColumns({"kind": kind, "rank": rank}).filter("rank IS NOT NULL OR member IS NULL")
    read = read.withColumn("text", F.when(F.col("rank").isNotNull(), F.array_join(_lines(F.col("kind"), decode_text(F.col("xml"))), "\n")))
    parts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("rank", number.alias("number"), "member", "text"))))
    joined = read.groupBy("file_id").agg(F.max("error").alias("error"), F.array_join(F.transform(parts, lambda m: m["text"]), "\n").alias("text"))
    # Only texts with an entity go through Python.
    plain = F.coalesce(unescape(F.when(F.contains("text", F.lit("&")), F.col("text"))), F.col("text"))
    return joined.select("file_id", F.when(F.col("error").isNull(), plain).alias("text"), "error")


def extract_texts(files: DataFrame) -> DataFrame:
    """(file_id, text, method, error) of (file_id, extension, content) rows.

    PDFs need a native library that is not part of this package: they come back as errors.
    """
    plain = files.filter(F.col("extension").isin(PLAIN_TEXT))
    decoded = plain.select("file_id", "extension", decode_text(F.col("content")).alias("text"))
    marked = F.col("extension").isin("html", "htm", "xml")
    texts = (decoded.filter(~marked).select("file_id", "text")
             .unionByName(unescaped(decoded.filter(marked).select("file_id", strip_tags(F.col("text")).alias("text"))))
             .withColumn("error", F.lit(None).cast("string")))
    packed = files.filter(F.col("extension").isin(WORD_FILES + SHEET_FILES + SLIDE_FILES + OPEN_DOCUMENT_FILES))
    unpacked = container_texts(packed)
    other = files.filter(~F.col("extension").isin(
        PLAIN_TEXT + WORD_FILES + SHEET_FILES + SLIDE_FILES + OPEN_DOCUMENT_FILES)).select(
        "file_id", F.lit(None).cast("string").alias("text"),
        F.concat(F.lit("no extractor for ."), F.col("extension")).alias("error"))
    return texts.unionByName(unpacked).unionByName(other).withColumn("method", F.lit("text"))
