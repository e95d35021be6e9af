"""Permission-filtered search: parsing, matching, ranking, paging, snippets.

Two ways to match. The substring mode looks for folded terms inside each text and moves only
booleans between tables. The postings mode reads a stored index, knows three readings of each
word (as typed, Spanish, English), phrases and alternatives, and ranks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import paths as P
from ..functions import values as V
from ..functions.stemming import lexeme
from ..functions.text import FOLD_FROM, FOLD_TO, NOT_WORD, SPACE, fold, words
from ..schema import COUNT_CAP
from ..session import materialize, stored
from .common import constant_table, top_per_group
from .indexing import CONFIG_FIELDS, POSTING_BUCKETS, WEIGHTS
from .permissions import visible_files
from .ranking import cover_scores, word_counts
from .reports import page

_FOLD_MAP = str.maketrans(FOLD_FROM, FOLD_TO)
_EXCLUDED = rf'(?:\A|[{SPACE}])-(?:"([^"]*)"?|([^{SPACE}"]+))'
_EXCLUDED_TEXT = r'\s-(?:"([^"]*)"?|([^\s"]+))'
# More written words than this behind one query are joined instead of listed.
EXPANSION_CAP = 2_000
# Hits a task sorts at once when they are stored.
HITS_PART = 500_000
RESULT = ["file_id", "name", "extension", "size", "mtime", "share_id", "share", "folder_id", "folder_path", "path"]


def fold_text(text: str) -> str:
    return text.translate(_FOLD_MAP).lower()


# ── Queries ──────────────────────────────────────────────────────────────────

@dataclass(frozen=True)
class Query:
    """A parsed query: clauses are alternatives, each a list of items (a word, or the words of a phrase)."""

    text: str
    terms: tuple[str, ...]
    excluded: tuple[str, ...]
    clauses: tuple[tuple[tuple[str, ...], ...], ...]


def _bare(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text)


def parse(typed: str) -> Query:
    """Terms, "phrases", alternatives (or) and exclusions (-word, -"a phrase") of one typed query."""
    # Splitting at exclusions gives what is between them, and what each holds in quotes or as one word.
    pieces = re.split(_EXCLUDED_TEXT, " " + fold_text(typed))
    excluded = [" ".join(_bare(quoted or word)) for quoted, word in zip(pieces[1::3], pieces[2::3])]
    # Quotes alternate: what stands before an odd number of them is words, the rest phrases.
    clauses: list[list[tuple[str, ...]]] = [[]]
    sides = [_bare(side) for side in " ".join(pieces[::3]).split('"')]
    for number, side in enumerate(sides):
        if number % 2:
            clauses[-1] += [tuple(side)] if side else []
            continue
        for word in side:
            if word == "or":
                clauses.append([])
            else:
                clauses[-1].append((word,))
    text = " ".join(re.sub(r'[^\w\s"]|_', " ", " ".join(pieces[::3])).split())
    return Query(text, tuple(w for side in sides for w in side if w != "or"), tuple(filter(None, excluded)), tuple(tuple(c) for c in clauses if c))


def parse_column(typed: Column) -> dict[str, Column]:
    """The same decomposition for a column of queries: text, terms and excluded phrases."""
    folded = fold(typed)
    groups = [F.regexp_extract_all(folded, F.lit(_EXCLUDED), F.lit(i)) for i in (1, 2)]
    both = F.zip_with(groups[0], groups[1], lambda a, b: words(F.when(a != "", a).otherwise(b)))
    left = F.regexp_replace(folded, _EXCLUDED, " ")
    left = F.regexp_replace(left, rf'[^\p{{L}}\p{{N}}{SPACE}"]', " ")
    text = F.trim(F.regexp_replace(left, rf"[{SPACE}]+", " "))
    terms = F.filter(F.split(F.regexp_replace(text, NOT_WORD, " "), " "), lambda t: (t != "") & (t != "or"))
    return {"text": text, "terms": terms, "excluded": F.filter(both, lambda e: e != "")}


@dataclass(frozen=True)
class SearchParams:
    q: str = ""
    share_id: int | None = None
    type: str | None = None
    modified_from: str | None = None
    modified_to: str | None = None
    sort: str = "relevance"
    limit: int = 20
    offset: int = 0


@dataclass
class Library:
    """The tables a search runs over. `postings` and `dictionary` only serve the postings mode."""

    shares: DataFrame
    folders: DataFrame
    files: DataFrame
    acls: DataFrame
    documents: DataFrame
    postings: DataFrame | None = None
    dictionary: DataFrame | None = None
    buckets: int = POSTING_BUCKETS


# ── What one account can find ────────────────────────────────────────────────

def candidates(library: Library, token, params: SearchParams) -> DataFrame:
    """Visible files in enabled shares that pass the share, type and date filters."""
    files = library.files
    if params.share_id is not None:
        files = files.filter(F.col("share_id") == params.share_id)
    files = files.filter(N.in_type(F.col("extension"), params.type)
                         & V.in_days(F.col("mtime"), params.modified_from, params.modified_to))
    seen = visible_files(files.select("file_id", "share_id", "folder_id", "name", "extension", "size", "mtime", "acl_id"),
                         library.folders, library.acls, token)
    roots = library.shares.filter("enabled").select(
        "share_id", F.col("name").alias("share"), F.col("path").alias("share_path"))
    return seen.withColumnRenamed("path", "folder_path").join(roots, "share_id")


def match_substrings(library: Library, found: DataFrame, query: Query) -> DataFrame:
    """Candidates whose name, place and content together hold every term and no exclusion.

    Contents are reduced to one boolean per needle at the scan, plus a short head for phrases that
    run from the place into the content; only those travel to the join.
    """
    needles = list(query.terms) + list(query.excluded)
    if not needles:
        return found
    content = F.coalesce(fold(F.col("content")), F.lit(""))
    reach = max(len(n) for n in needles)
    reduced = library.documents.select(
        "file_id", F.substring(content, 1, reach).alias("head"),
        *[F.contains(content, F.lit(n)).alias(f"in_{i}") for i, n in enumerate(needles)])
    title = F.concat_ws(" ", words(F.col("name")), words(F.concat_ws(" ", "share", "folder_path")), F.col("head"))
    joined = found.join(reduced, "file_id", "left")
    hits = [F.col(f"in_{i}") | F.contains(title, F.lit(n)) for i, n in enumerate(needles)]
    keep = F.lit(True)
    for i, hit in enumerate(hits):
        indexed = F.col("head").isNotNull()
        keep = keep & ((indexed & hit) if i < len(query.terms) else ~F.coalesce(indexed & hit, F.lit(False)))
    return joined.filter(keep).select(*found.columns)


def _query_lexemes(query: Query, stemmed: bool) -> tuple[list[tuple], dict]:
    """Rows (unit, config, clause, item, offset, lexeme) and how many items each clause still has.

    Unit 0 is the query itself, the others are exclusions. A word that is a stop word in one
    language drops out of that language's reading but keeps its place inside a phrase.
    """
    rows, sizes = [], {}
    units = [query.clauses] + [(((tuple(e.split())),),) for e in query.excluded]
    for config in CONFIG_FIELDS if stemmed else ["simple"]:
        for unit, clauses in enumerate(units):
            for clause, items in enumerate(clauses):
                alive = 0
                for item, typed in enumerate(items):
                    known = [(o, lexeme(w, config)) for o, w in enumerate(typed)]
                    known = [(o, x) for o, x in known if x is not None]
                    rows += [(unit, config, clause, item, o, x, len(known)) for o, x in known]
                    alive += bool(known)
                sizes[(unit, config, clause)] = alive
    return rows, sizes


_ASKED = ["query_no", "unit", "config", "clause", "item", "offset", "lexeme", "word_count", "items"]


def _fields(config: str) -> str:
    return CONFIG_FIELDS[config]


def expand_words(library: Library, rows: list[tuple], stemmed: bool, cap: int = EXPANSION_CAP) -> tuple[DataFrame, list[str] | None]:
    """Query rows with each written word that reads one of their lexemes, and the fields it counts in.

    As typed, the words are the lexemes. Stemmed, the dictionary is asked for at most `cap` words,
    which then prune the postings as constants; a query that stands for more stays a join.
    """
    names = [*_ASKED, "word", "fields"]
    if not stemmed:
        expanded = [(*r, r[6], "ABC") for r in rows]
        return constant_table(library.postings, expanded, names), sorted({r[6] for r in rows})
    readings = library.dictionary.filter(F.col("lexeme").isin(sorted({r[6] for r in rows}))).select("lexeme", "config", "word")
    found = readings.limit(cap + 1).collect()
    if len(found) > cap:
        fields = F.lit("")
        for config in CONFIG_FIELDS:
            fields = F.when(F.col("reading") == config, _fields(config)).otherwise(fields)
        asked = constant_table(library.postings, rows, _ASKED)
        joined = asked.join(readings.withColumnRenamed("config", "reading"), "lexeme")
        return joined.groupBy(*_ASKED, "word").agg(F.array_join(F.collect_set(fields), "").alias("fields")), None
    spelled: dict[str, dict[str, set]] = {}
    for lexeme_, config, word in found:
        spelled.setdefault(lexeme_, {}).setdefault(word, set()).update(_fields(config))
    expanded = [(*r, word, "".join(sorted(fields))) for r in rows for word, fields in spelled.get(r[6], {}).items()]
    words_ = sorted({r[-2] for r in expanded})
    return constant_table(library.postings, expanded or [(*rows[0], "", "")], names), words_


def asked_rows(queries: list[Query], stemmed: bool = True) -> list[tuple]:
    """What the queries look for, one row a word: (query_no, unit, config, clause, item, offset, lexeme, word_count, items)."""
    wanted = []
    for number, query in enumerate(queries):
        rows, sizes = _query_lexemes(query, stemmed)
        wanted += [(number, *r, sizes[(r[0], r[1], r[2])]) for r in rows]
    return wanted


def posting_hits(library: Library, queries: list[Query], stemmed: bool = True) -> DataFrame:
    """Every posting some word of the queries reads, once per place:
    (query_no, unit, config, clause, item, offset, word_count, items, file_id, field, pos).

    Unit 0 of a query is itself, the others are its exclusions.
    """
    wanted = asked_rows(queries, stemmed)
    expanded, spelled = expand_words(library, wanted or [(-1, 0, "", 0, 0, 0, "", 0, 0)], stemmed)
    postings = library.postings
    if spelled is not None:
        # Constants: folders of other buckets are not listed, row groups of other words not read.
        buckets = [F.pmod(F.xxhash64(F.lit(w)), F.lit(library.buckets)).cast("int") for w in spelled]
        postings = postings.filter(F.col("word").isin(spelled)).filter(F.col("bucket").isin(buckets))
        hits = postings.join(expanded, "word")
    else:
        # So many that they stay a join: on the bucket too, so that folders of other buckets are pruned as it runs.
        bucket = F.pmod(F.xxhash64("word"), F.lit(library.buckets)).cast("int")
        hits = postings.join(expanded.withColumn("bucket", bucket), ["bucket", "word"])
    hits = hits.filter(F.contains("fields", F.col("field")))
    return hits.select("query_no", "unit", "config", "clause", "item", "offset", "word_count", "items", "file_id", "field", "pos")


@dataclass(frozen=True)
class Hits:
    """The hits of some queries, stored, and over how many tasks they are dealt so that no task's share grows with the texts."""

    rows: DataFrame
    tasks: int


def store_hits(library: Library, queries: list[Query], stemmed: bool = True) -> Hits:
    """Postings that are built as they are read cost a pass over all texts: matching and relevance share it."""
    rows = stored(posting_hits(library, queries, stemmed))
    return Hits(rows, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // HITS_PART + 1))


def by_single_words(queries: list[Query]) -> bool:
    return all(len(clause) == 1 and len(clause[0]) == 1 for q in queries for clause in q.clauses)


def match_postings(library: Library, queries: list[Query], stemmed: bool = True, kept: Hits | None = None) -> DataFrame:
    """(query_no, file_id, matched, in_title, score, excluded) for files some word of a query occurs in.

    Everything is grouped within a file, so the hits are shuffled once, by file: phrases into runs
    of adjacent words, words and runs into clauses, clauses into files. Only what a query asks for
    is weighed: whole runs, in clauses all of whose items were found, and of several readings of a
    clause the one that weighs most, so that one place isn't counted once a language.
    """
    weight = F.lit(0.0)
    for name, value in WEIGHTS.items():
        weight = F.when(F.col("field") == name, value).otherwise(weight)
    clause = ["file_id", "query_no", "unit", "config", "clause", "items"]
    hits = kept.rows.repartition(kept.tasks, "file_id") if kept else posting_hits(library, queries, stemmed).repartition("file_id")
    present = hits.withColumn("weight", weight).withColumn("whole", F.lit(True))
    if any(len(item) > 1 for q in queries for c in q.clauses for item in c) or any(" " in e for q in queries for e in q.excluded):
        start = (F.col("pos") - F.col("offset")).alias("start")
        present = hits.groupBy(*clause, "item", "word_count", "field", start).agg(
            F.sum(weight).alias("weight"), (F.count("*") == F.col("word_count")).alias("whole"))
    titled = F.col("field").isin("A", "B")
    if max((len(c) for q in queries for c in q.clauses), default=1) <= 60:
        # One bit per item: plain numbers in the aggregation buffer.
        bit = F.expr("shiftleft(1L, item)")
        seen = lambda cond: F.bit_count(F.coalesce(F.bit_or(F.when(cond, bit)), F.lit(0).cast("long")))
    else:
        seen = lambda cond: F.count_distinct(F.when(cond, F.col("item")))
    clauses = present.groupBy(*clause).agg(
        (seen(F.col("whole")) == F.col("items")).alias("found"),
        (seen(F.col("whole") & titled) == F.col("items")).alias("titled"), F.sum(F.when(F.col("whole"), F.col("weight")).otherwise(0.0)).alias("weight"))
    readings = clauses.groupBy("file_id", "query_no", "unit", "clause").agg(
        F.bool_or("found").alias("found"), F.bool_or("titled").alias("titled"), F.max(F.when(F.col("found"), F.col("weight"))).alias("weight"))
    asked = F.col("unit") == 0
    return readings.groupBy("file_id", "query_no").agg(
        F.bool_or(asked & F.col("found")).alias("matched"), F.bool_or(asked & F.col("titled")).alias("in_title"),
        F.round(F.sum(F.when(asked & F.col("found"), F.col("weight")).otherwise(0.0)), 6).alias("score"),
        F.bool_or(~asked & F.col("found")).alias("excluded"))


def by_covers(library: Library, matched: DataFrame, queries: list[Query], stemmed: bool, kept: Hits | None = None) -> DataFrame:
    """`matched` files (query_no, and the columns of `candidates`) with their relevance by cover density.

    Where every query asks for single words, each of their places is a cover by itself, and the weight of the places is the relevance already.
    """
    if by_single_words(queries):
        return matched
    kept = kept or store_hits(library, queries, stemmed)
    # Read twice, for the words before a file's content and for the result: computed once.
    matched = materialize(matched)
    files = matched.select("file_id", "name", "share", "folder_path").dropDuplicates(["file_id"])
    scores = cover_scores(kept.rows, word_counts(files), asked_rows(queries, stemmed), kept.tasks)
    return matched.drop("score").join(scores, ["query_no", "file_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def newest() -> list[Column]:
    return [F.col("mtime").desc_nulls_last(), F.asc("file_id")]


def rank_candidates(matched: DataFrame, cap: int = COUNT_CAP) -> DataFrame:
    """The likeliest of many matches: the newest found by name or place, and the newest of all.

    With no more matches than `cap` the second list is all of them, so nothing is lost and no
    count is needed first.
    """
    # Both lists lie within the newest of either kind, which one ranked pass finds.
    near = top_per_group(matched, ["in_title"], newest(), cap).drop("rank")
    overall = F.row_number().over(Window.orderBy(*newest()))  # at most 2 x cap rows
    return near.withColumn("rank", overall).filter(F.col("in_title") | (F.col("rank") <= cap)).drop("rank")


def matches(library: Library, token, params: SearchParams, mode: str = "substring", stemmed: bool = True, rank: str = "covers") -> DataFrame:
    """All files the account finds, unordered.

    `rank` says what `score` is in the postings mode: cover density, or with "places" the plain weight of all places that were found.
    """
    query = parse(params.q)
    found = candidates(library, token, params)
    if mode == "substring":
        return match_substrings(library, found, query).withColumns({"score": F.lit(0.0), "in_title": F.lit(False)})
    if query.clauses or query.excluded:
        kept = store_hits(library, [query], stemmed) if rank == "covers" and not by_single_words([query]) else None
        hits = match_postings(library, [query], stemmed, kept)
        if query.clauses:
            matched = found.join(hits.filter("matched AND NOT excluded").select("query_no", "file_id", "score", "in_title"), "file_id")
            return (by_covers(library, matched, [query], stemmed, kept) if rank == "covers" else matched).drop("query_no")
        # Files without an index row are in no posting, so they can't be excluded.
        found = found.join(hits.filter("excluded").select("file_id"), "file_id", "left_anti")
    return found.withColumns({"score": F.lit(0.0), "in_title": F.lit(False)})


def ordering(params: SearchParams, has_terms: bool) -> list[Column]:
    if params.sort == "name":
        return [F.lower("name").asc(), F.asc("file_id")]
    if params.sort == "newest" or not has_terms:
        return newest()
    return [F.desc("score"), *newest()]


def search(library: Library, token, params: SearchParams, mode: str = "substring", stemmed: bool = True, pool: int | None = None, rank: str = "covers") -> DataFrame:
    """One page of results, without snippets. All matches are ranked, unless `pool` asks for the likeliest only.

    Relevance is only worked out where it orders the result.
    """
    query = parse(params.q)
    found = matches(library, token, params, mode, stemmed, rank if params.sort == "relevance" else "places")
    if pool and mode == "postings" and params.sort == "relevance" and query.terms:
        found = rank_candidates(found, pool)
    ordered = page(found, ordering(params, bool(query.terms)), params.limit, params.offset)
    return ordered.select(*RESULT[:-1], P.display_path(F.col("share_path"), F.col("folder_path"), F.col("name")).alias("path"),
                          "score")


def search_many(library: Library, token, asked: dict[str, SearchParams], stemmed: bool = True, rank: str = "covers") -> DataFrame:
    """First pages of many queries of one account in one job, with `query` and `position`.

    Each result equals that of `search`. All queries share one pass over the postings and one over
    the visible files; every query must have something to look for.
    """
    names, params = list(asked), list(asked.values())
    queries = [parse(p.q) for p in params]
    if any(not q.clauses for q in queries):
        raise ValueError("a query without words lists everything: run it alone")
    facts = [(n, names[n], p.share_id, p.type if p.type in N.TYPE_GROUPS or p.type == "other" else None, p.modified_from,
              p.modified_to, p.sort, p.offset, p.limit) for n, p in enumerate(params)]
    wishes = constant_table(library.postings, facts, [
        "query_no", "query", "w_share", "w_type", "w_from", "w_to", "w_sort", "w_offset", "w_limit"])
    kept = store_hits(library, queries, stemmed) if rank == "covers" and not by_single_words(queries) else None
    hits = match_postings(library, queries, stemmed, kept).filter("matched AND NOT excluded").drop("matched", "excluded")
    found = candidates(library, token, SearchParams()).join(hits.join(wishes, "query_no"), "file_id")
    if rank == "covers":
        found = by_covers(library, found, queries, stemmed, kept)
    unset = lambda c: F.col(c).isNull()
    day = lambda c: F.col(c).cast("timestamp_ntz")
    found = found.filter(
        (unset("w_share") | (F.col("share_id") == F.col("w_share")))
        & (unset("w_type") | (N.type_group(F.col("extension")) == F.col("w_type")))
        & (unset("w_from") | (F.col("mtime") >= day("w_from")))
        & (unset("w_to") | (F.col("mtime") < day("w_to") + F.expr("INTERVAL '1' DAY"))))
    relevance = F.col("w_sort") == "relevance"
    by_score = F.when(relevance, F.col("score")).otherwise(0.0)
    by_name = F.when(F.col("w_sort") == "name", F.lower("name")).otherwise("")
    by_time = F.when(F.col("w_sort") != "name", F.col("mtime"))
    last = max(p.offset + p.limit for p in params)
    ranked = top_per_group(found, ["query_no"], [by_score.desc(), by_name.asc(), by_time.desc_nulls_last(), F.asc("file_id")], last)
    shown = ranked.filter((F.col("rank") > F.col("w_offset")) & (F.col("rank") <= F.col("w_offset") + F.col("w_limit")))
    return shown.select("query", (F.col("rank") - F.col("w_offset")).alias("position"), *RESULT[:-1],
                        P.display_path(F.col("share_path"), F.col("folder_path"), F.col("name")).alias("path"), "score")


def capped_count(found: DataFrame, cap: int = COUNT_CAP) -> DataFrame:
    """How many were found, counted no further than needed to say "more than `cap`"."""
    n = F.count("*")
    return found.select("file_id").limit(cap + 1).agg(
        F.least(n, F.lit(cap)).alias("total"), (n > cap).alias("total_capped"))


def recently_modified(library: Library, token, limit: int = 10) -> DataFrame:
    return search(library, token, replace(SearchParams(), limit=limit, sort="newest"))


# ── Snippets ─────────────────────────────────────────────────────────────────

# Characters a snippet shows, a third of them before its first hit, how far its ends move to a blank; and how much of
# a term a highlighted word must begin with: all but its ending, and four letters at least.
WIDTH, REACH = 240, 30
ENDING, SHORTEST = 2, 4
_LETTER = r"[\p{L}\p{N}_]"
SEGMENTS = "array<struct<text:string,hit:boolean>>"


def hit_pattern(terms: list[str]) -> str:
    """Words that begin like one of the terms; longer beginnings first. Without terms there are none."""
    starts = {t[:-ENDING] if len(t) > SHORTEST + ENDING else t[:SHORTEST] for t in terms}
    return rf"(?<!{_LETTER})(?:{'|'.join(re.escape(s) for s in sorted(starts, key=lambda s: (-len(s), s))) or '(?!)'}){_LETTER}*"


def snippet(content: Column, terms: list[str], width: int = WIDTH) -> Column:
    """The stretch of a text around its first hit, as plain and highlighted segments; empty for a text without characters.

    Only the stretch is searched for hits: the text is split once, at its first.
    """
    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)
    pattern = hit_pattern(terms)

    def cut(s: Column) -> Column:
        text, folded = s["text"], s["folded"]
        size = F.length(text)
        ahead = F.length(F.get(F.split(folded, pattern, 2), 0))
        start = F.when(ahead < size, F.greatest(ahead - width // 3, F.lit(0))).otherwise(0)
        end = F.least(start + width, size)
        # Both ends move outwards to a blank, if one is near.
        back = F.instr(F.reverse(F.substring(text, F.greatest(start - REACH + 2, F.lit(1)), F.least(start, F.lit(REACH - 1)))), " ")
        on = F.instr(F.substring(text, end + 1, F.lit(REACH)), " ")
        return F.struct(F.when((start > 0) & (back > 0), start - back + 1).otherwise(start).alias("start"), F.when((end < size) & (on > 0), end + on - 1).otherwise(end).alias("end"),
                        text.alias("text"), folded.alias("folded"))

    def marked(w: Column) -> Column:
        # One character more at either side tells whether a hit is cut off by an end.
        lead = F.least(w["start"], F.lit(1))
        around = F.substring(w["folded"], w["start"] - lead + 1, w["end"] - w["start"] + lead + 1)
        shown = F.substring(w["text"], w["start"] + 1, w["end"] - w["start"])
        plain, found = F.transform(F.split(around, pattern), F.length), F.transform(F.regexp_extract_all(around, F.lit(pattern), F.lit(0)), F.length)
        # Lengths of plain and highlighted parts by turns, from the lead on; what reaches beyond the end is plain.
        size = F.length(shown)
        ends = F.aggregate(F.zip_with(plain, found, lambda p, h: F.struct(p.alias("p"), h.alias("h"))),
                           F.struct((-lead).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("hits")),
                           lambda a, x: F.struct((a["at"] + F.coalesce(x["p"], F.lit(0)) + F.coalesce(x["h"], F.lit(0))).alias("at"),
                                                 F.when(x["h"].isNotNull(), F.concat(a["hits"], F.array(F.struct((a["at"] + x["p"]).cast("int").alias("from"), (a["at"] + x["p"] + x["h"]).cast("int").alias("to")))))
                                                 .otherwise(a["hits"]).alias("hits")), lambda a: a["hits"])
        inside = F.filter(ends, lambda h: (h["from"] >= 0) & (h["to"] <= size))
        piece = lambda a, b, hit: F.struct(F.regexp_replace(F.substring(shown, a + 1, b - a), rf"[{SPACE}]+", " ").alias("text"), F.lit(hit).alias("hit"))
        dots = lambda when: F.when(when, F.array(F.struct(F.lit("…").alias("text"), F.lit(False).alias("hit")))).otherwise(F.array().cast(SEGMENTS))
        body = let(inside, lambda hits: F.concat(F.flatten(F.transform(hits, lambda h, i: F.array(
            piece(F.when(i > 0, F.get(hits, i - 1)["to"]).otherwise(0), h["from"], False), piece(h["from"], h["to"], True)))),
            F.array(piece(F.coalesce(F.get(hits, F.size(hits) - 1)["to"], F.lit(0)), size, False))))
        return F.concat(dots(w["start"] > 0), F.filter(body, lambda x: x["text"] != ""), dots(w["end"] < F.length(w["text"])))

    return let(F.struct(content.alias("text"), fold(content).alias("folded")), lambda s: F.when(F.length(s["text"]) > 0, let(cut(s), marked)).otherwise(F.array().cast(SEGMENTS)))


def snippet_segments(text: str, terms: list[str], width: int = WIDTH) -> list[dict]:
    """The snippet of one text, worked out in the running session."""
    row = SparkSession.active().range(1).select(snippet(F.lit(text), terms, width).alias("segments")).first()
    return [s.asDict() for s in row.segments]


def with_snippets(results: DataFrame, documents: DataFrame, query: Query, width: int = WIDTH) -> DataFrame:
    """Adds `snippet` to one page of results; contents are joined only for that page."""
    if not query.terms:
        return results.withColumn("snippet", F.array().cast(SEGMENTS))
    shown = snippet(F.coalesce("content", F.lit("")), list(query.terms), width)
    return results.join(documents.select("file_id", "content"), "file_id", "left").withColumn("snippet", shown).drop("content")


def respond(library: Library, token, params: SearchParams, mode: str = "substring", stemmed: bool = True, count: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """What a search page needs, from one set of matches: its results with snippets, and the capped count (None if `count` is off).

    Matches are worked out and stored once; without the count only the page is, and a page by name or time ranks nothing.
    """
    query = parse(params.q)
    found = matches(library, token, params, mode, stemmed, "covers" if params.sort == "relevance" else "places")
    if count:
        found = materialize(found)
    shown = page(found, ordering(params, bool(query.terms)), params.limit, params.offset).select(
        *RESULT[:-1], P.display_path(F.col("share_path"), F.col("folder_path"), F.col("name")).alias("path"), "score")
    return with_snippets(shown, library.documents, query), capped_count(found) if count else None
