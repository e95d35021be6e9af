"""Registered queries against SQL on the same tables (SHARESCOPE_ALL_QUERIES=1 runs every one)."""

import os
from pathlib import Path

import duckdb
import pytest

from sharescope.plans.registry import load

FOLDER = Path(os.environ.get("SHARESCOPE_TESTDATA", "/root/testdata/sf0.001"))
QUICK = ["fold_text", "name_parts", "naming_patterns", "share_summary", "empty_folders", "duplicate_groups", "decode_descriptors", "visible_files",
         "many_tokens", "file_changes", "search_substring", "search_phrase", "breadcrumbs", "compliance_totals", "missing_folders", "transitive_members",
         "sign_in_throttle", "office_text", "catalogue_replaced", "snapshots_stored", "audit_purged", "phrase_scores", "decode_bytes"]
REGISTERED = load()
CHOSEN = sorted(REGISTERED) if os.environ.get("SHARESCOPE_ALL_QUERIES") else QUICK

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test data")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def plain(value):
    if value is None or value != value:
        return "NULL"
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def rows_of(rows, order):
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, tables, name):
    registered = REGISTERED[name]
    df = registered.run(spark, str(FOLDER))
    columns = sorted(df.columns)
    got = rows_of(df.select(*[f"`{c}`" for c in columns]).collect(), range(len(columns)))
    if registered.sql is None:
        assert got
        return
    answer = tables.execute(registered.sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert got == rows_of(answer.fetchall(), [names.index(c) for c in columns])


def test_every_operator_family_is_covered():
    covered = {code for r in REGISTERED.values() for code in r.covers.split()}
    for family, count in {"S": 10, "X": 24, "J": 12, "A": 17, "R": 10, "I": 14, "Q": 17, "B": 7, "G": 14, "D": 9, "P": 7, "T": 7, "L": 25}.items():
        assert {f"{family}{i}" for i in range(1, count + 1)} <= covered
