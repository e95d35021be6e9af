"""The registered queries against SQL, and the pipeline's stages against what each must do to its own input."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from sharescope.llm.queries import QUERIES, SQL

from .cases import awkward, frame, with_clashes
from .test_decontamination import shingles
from .test_simhash import brute_parts, fingerprint

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("tables")
    rows = awkward()
    long = next(r[1] for r in rows if r[0] == 18).split()
    spark.createDataFrame([(1, " ".join(long[50:90]))], "item_id long, text string").write.parquet(str(place / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(str(place / "labels.parquet"))
    frame(spark, rows).write.parquet(str(place / "documents.parquet"))
    return str(place)


def test_stages_act_on_their_own_input(spark, folder):
    rows, stages = awkward(), dict(corpus_pipeline.STAGES)
    docs = with_clashes(frame(spark, rows), "kept", "fingerprint", "_key")
    for name, stage in list(stages.items())[:-1]:
        got = stage(spark, docs, folder).collect()
        assert got and list(got[0].asDict()) == corpus_pipeline.COLUMNS
        texts = sorted((r["text"] for r in got), key=str)
        if name == "toxicity":
            assert texts == sorted((r[1] for r in rows), key=str)
        if name == "simhash_near_dedup":
            part = brute_parts({fingerprint(r[1]) for r in rows})
            assert len(got) == len(set(part.values()))
        if name == "substring_dedup":
            assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None and r["doc_id"] is not None)
        if name == "decontamination":
            item = shingles(spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"])
            assert texts == sorted((r[1] for r in rows if len(item & shingles(r[1])) < 0.8 * len(item)), key=str)


def test_run_is_its_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(str, corpus_pipeline.run(spark, folder).select(key).collect())) == sorted(map(str, docs.select(key).collect()))


def plain(rows, order):
    return sorted(tuple("NULL" if r[i] is None else f"{r[i]:.9f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not FOLDER.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, name):
    db = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    answer = db.execute(SQL[name])
    names = [d[0] for d in answer.description]
    found = QUERIES[name](spark, str(FOLDER))
    assert sorted(found.columns) == sorted(names)
    got = found.select(*names).collect()
    assert plain(got, range(len(names))) == plain(answer.fetchall(), range(len(names)))
