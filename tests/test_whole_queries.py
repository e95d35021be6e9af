"""Registered queries that return all rows, beside those that return a page, against SQL without a limit."""

import re
from pathlib import Path

import pytest

from sharescope.operators import indexing as I
from tests.test_queries import FOLDER, REGISTERED, plain, rows_of, tables  # noqa: F401

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test data")


def same_as_sql(spark, tables, name):  # noqa: F811
    """The rows of a registered query, after comparing them with its SQL."""
    df = REGISTERED[name].run(spark, str(FOLDER))
    columns = sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in columns]).collect()
    answer = tables.execute(REGISTERED[name].sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert rows_of(rows, range(len(columns))) == rows_of(answer.fetchall(), [names.index(c) for c in columns])
    return rows


def test_grid_has_every_column(spark, tables):  # noqa: F811
    whole = {r["folder_id"] for r in same_as_sql(spark, tables, "permission_grid_whole")}
    first = {r["folder_id"] for r in REGISTERED["permission_grid"].run(spark, str(FOLDER)).select("folder_id").distinct().collect()}
    assert len(first) == 60 and first < whole


def test_texts_are_kept_whole(spark, tables):  # noqa: F811
    assert max(len(r["clean"]) for r in same_as_sql(spark, tables, "clean_content_whole")) > 200_000
    rows = same_as_sql(spark, tables, "extraction_whole")
    assert all(r["status"] != "too_large" for r in rows) and max(r["chars"] or 0 for r in rows) > 4000
    (whole,) = same_as_sql(spark, tables, "round_statistics_whole")
    (small,) = REGISTERED["round_statistics"].run(spark, str(FOLDER)).collect()
    assert whole["extracted"] > small["extracted"]
    ddl = "file_id bigint, extension string, size bigint, acl_read boolean, new_acl_id int, acl_id int, text string, method string, error string"
    long = spark.createDataFrame([(1, "txt", 1 << 30, True, 9, 1, "a" * 250_000 + " end", "text", None), (2, "txt", 5, True, 9, 1, "a b", "text", None)], ddl)
    got = {r.file_id: r for r in I.extraction_outcome(long).collect()}
    assert got[1].status == "text" and got[1].content.endswith("a end") and not got[1].content_cut
    got = {r.file_id: (r.status, r.content, r.content_cut) for r in I.extraction_outcome(long, 1 << 40, 2).collect()}
    assert got == {1: ("text", "aa", True), 2: ("text", "a ", True)}
    assert {r.file_id: r.status for r in I.extraction_outcome(long, 100).collect()} == {1: "too_large", 2: "text"}
    folder = long.select("file_id", "extension", "size")
    assert {r.status for r in I.add_missing(folder, spark.createDataFrame([], "file_id bigint")).collect()} == {"pending"}


def test_every_duplicate_has_its_row(spark, tables):  # noqa: F811
    from pyspark.sql import functions as F

    from sharescope.operators import duplicates as D
    from tests.fixtures import folders_of, frame, shares_of
    same_as_sql(spark, tables, "duplicate_members_whole")
    copies = frame(spark, [(2 * g + k, 2000 + g, f"k{g}") for g in range(60) for k in range(2)], "file_id bigint, size bigint, quick_hash string")
    folders, shares = folders_of(spark, [("", None)]), shares_of(spark)
    place = folders.select("folder_id", "share_id").first()
    files = copies.select("*", F.col("quick_hash").alias("content_hash"), F.lit(place.folder_id).alias("folder_id"), F.lit(place.share_id).alias("share_id"),
                          F.concat(F.lit("f"), "file_id").alias("name"), F.lit(None).cast("timestamp_ntz").alias("mtime"))
    assert {r.file_id for r in D.group_members(files, folders, shares).collect()} == set(range(120))
    assert D.group_members(files, folders, shares, limit=50).count() == 100


def test_numbers_without_a_query_are_named():
    covered = {code for r in REGISTERED.values() for code in r.covers.split()}
    readme = (Path(__file__).resolve().parents[1] / "README.md").read_text()
    named = readme.split("not registered:", 1)[1].split(".", 1)[0]
    assert {f"S{i}" for i in range(1, 11)} - covered == set(re.findall(r"\bS\d+\b", named))
