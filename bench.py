"""Headline queries over a stored catalogue; prints one JSON line.

The estate is derived from $BENCH_SF_DIR and stored once (catalogue and index builds are timed
separately), and the token's access is evaluated once, as a deployment would. Searches then mirror the published benchmark: home page,
common, rare and mid words, type filter, a late page, exclusions, file names; the rest are
whole-estate jobs, for which throughput matters.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from types import SimpleNamespace

from sharescope.operators import duplicates as D
from sharescope.operators import folderplan as L
from sharescope.operators import indexing as I
from sharescope.operators import permissions as X
from sharescope.operators import reconcile as C
from sharescope.operators import reports as R
from sharescope.operators import search as Q
from sharescope.plans import base_sql
from sharescope.plans.people_queries import sign_in_throttle
from sharescope.plans.report_queries import hashed
from sharescope.session import build_session, shared_folder
from sharescope.sources.derived import AS_OF, Estate

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
TOKEN = base_sql.TOKEN
STORED = ["shares", "folders", "files", "acls", "documents", "plan", "principals", "members", "listing"]


def timed(action, runs: int = 1) -> float:
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def run(df) -> None:
    """Compute every column of every row, and keep none."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session("sharescope-bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    estate = Estate(spark, FOLDER)
    store = tempfile.mkdtemp(prefix="bench-", dir=shared_folder(spark).removeprefix("file:"))
    times: dict[str, float] = {}

    def build_catalogue() -> None:
        for name in STORED:
            df = getattr(estate, name)
            (df.drop("content") if name == "files" else df).write.parquet(f"{store}/{name}")

    def build_index() -> None:
        stored = {n: spark.read.parquet(f"{store}/{n}") for n in STORED}
        I.write_index(spark, f"{store}/index", I.postings(
            stored["files"], stored["folders"], stored["shares"], stored["documents"]), partitions=int(CPUS) * 4)

    times["catalogue_build"] = timed(build_catalogue)
    times["index_build"] = timed(build_index)
    t = SimpleNamespace(**{n: spark.read.parquet(f"{store}/{n}") for n in STORED})
    lib = Q.Library(t.shares, t.folders, t.files, t.acls, t.documents,
                    spark.read.parquet(f"{store}/index/postings"), spark.read.parquet(f"{store}/index/dictionary"))

    searches = {
        "home_newest": ("", {"sort": "newest", "limit": 10}),
        "common_word": ("the", {}),
        "common_word_pdf": ("the", {"type": "pdf"}),
        "common_word_page_50": ("the", {"offset": 980}),
        "common_word_newest": ("the", {"sort": "newest"}),
        "two_common_words": ("the and", {}),
        "phrase": ('"of the"', {}),
        "rare_word": ("thanedble", {}),
        "mid_word": ("enauch", {}),
        "common_minus_mid": ("the -enauch", {}),
        "file_name": ("nota 4241", {}),
    }
    Q.search(lib, TOKEN, Q.SearchParams("calienta", limit=1), "postings").collect()  # JVM warm-up
    prepared = []
    times["access_prepare"] = timed(lambda: prepared.append(X.prepare_access(t.files, t.folders, t.acls, TOKEN)))
    access = prepared[0]
    for name, (text, extra) in searches.items():
        params = Q.SearchParams(text, **extra)
        times[f"search_{name}"] = timed(lambda: Q.search(lib, access, params, "postings").collect(), RUNS)
    together = {n: Q.SearchParams(text, **extra) for n, (text, extra) in searches.items() if text}
    times[f"search_{len(together)}_in_one_job"] = timed(lambda: Q.search_many(lib, access, together).collect(), RUNS)
    times["search_count"] = timed(lambda: Q.capped_count(
        Q.matches(lib, access, Q.SearchParams("the"), "postings")).collect(), RUNS)
    params = Q.SearchParams('nota thé -"of the"', limit=50)
    times["search_substring_scan"] = timed(lambda: Q.search(lib, access, params).collect(), RUNS)

    jobs = {
        "share_summary": lambda: R.summary(t.shares, t.files, t.folders, estate.scan_runs),
        "files_by_age": lambda: R.by_age(t.files, AS_OF),
        "hygiene": lambda: R.hygiene_rows(t.files, t.folders, t.shares),
        "visible_files": lambda: X.visible_files(t.files, t.folders, t.acls, TOKEN),
        "permission_grid": lambda: R.permission_grid(t.folders, t.shares, t.acls, t.principals, t.members),
        "duplicates": lambda: D.group_members(hashed(estate), t.folders, t.shares),
        "compliance": lambda: L.capped_issues(L.issues(
            L.folder_facts(t.folders, t.files, t.plan, True), t.files, t.plan, t.folders, t.shares)),
        "compliance_totals": lambda: L.totals(
            L.folder_facts(t.folders, t.files, t.plan, True), t.files, t.plan, t.folders),
        "reconcile": lambda: C.file_changes(t.listing, t.files.selectExpr(
            "share_id", "fpath AS path", "name", "file_id", "size", "mtime")),
        "sign_in_throttle": lambda: sign_in_throttle(estate),
    }
    for name, job in jobs.items():
        times[name] = timed(lambda: run(job()), 1)

    queries = {k: v for k, v in times.items() if not k.endswith("_build")}
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(queries.values()), 3), "unit": "sec",
        "queries": queries, "builds": {k: v for k, v in times.items() if k.endswith("_build")},
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
