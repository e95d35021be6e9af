"""Search and browsing as one account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import browse as B
from ..operators import indexing as I
from ..operators import search as Q
from ..sources.derived import Estate
from . import base_sql as S
from .registry import query


def library(e: Estate, stemmed: bool | None = None) -> Q.Library:
    """The derived tables; with `stemmed` given, also postings and dictionary built on the fly."""
    lib = Q.Library(e.shares, e.folders, e.files.drop("content"), e.acls, e.documents)
    if stemmed is not None:
        lib.postings = I.postings(e.files, e.folders, e.shares, e.documents)
        lib.dictionary = I.dictionary(I.vocabulary(lib.postings), stemmed)
    return lib


def shown(df: DataFrame) -> DataFrame:
    return df.select("file_id", "name", "share", "folder_path", "path", "size", F.col("mtime").cast("string").alias("mtime"))


# ── Parsing ──────────────────────────────────────────────────────────────────

_SP = r"\t-\r\x1c-\x20\x85\p{Z}"
_EXC = rf"""[{_SP}]-(?:"([^"]*)"?|([^{_SP}"]+))"""


@query("Q1", rf"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(remaining, '[^\p{{L}}\p{{N}}{_SP}"]', ' ', 'g'), '[{_SP}]+', ' ', 'g')) AS text,
    array_to_string(list_filter(string_split(trim(regexp_replace(remaining, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda t: t <> '' AND t <> 'or'), ' ') AS terms,
    array_to_string(list_filter(list_transform(regexp_extract_all(typed, '{_EXC}'), lambda m: trim(regexp_replace(substr(m, 3), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda x: x <> ''), '|') AS excluded
    FROM (SELECT *, regexp_replace(typed, '{_EXC}', ' ', 'g') AS remaining FROM (SELECT conv_id, turn, {S.fold("' ' || replace(replace(text, ', ', ' -'), '. ', ' or -\"')")} AS typed FROM conversations))""")
def parse_queries(e: Estate) -> DataFrame:
    """Conversation turns as typed queries, their commas and full stops turned into exclusions."""
    typed = F.concat(F.lit(" "), F.replace(F.replace(F.col("text"), F.lit(", "), F.lit(" -")), F.lit(". "), F.lit(' or -"')))
    parts = Q.parse_column(typed)
    return e.table("conversations").select("conv_id", "turn", parts["text"].alias("text"), F.array_join(parts["terms"], " ").alias("terms"),
                                           F.array_join(parts["excluded"], "|").alias("excluded"))


# ── Substring mode ───────────────────────────────────────────────────────────

_TEXT = f"""SELECT d.file_id, concat_ws(' ', {S.words('f.name')}, {S.words("s.name || ' ' || f.fpath")}, {S.fold("coalesce(d.content, '')")}) AS t
    FROM est_docs d JOIN est_files f USING (file_id) JOIN est_shares s USING (share_id)"""
_ROW = f"file_id, name, share, folder_path, {S.show('share_path', 'folder_path', 'name')} AS path, size, CAST(mtime AS VARCHAR) AS mtime"


def _like(include: list[str], exclude: list[str] = (), where: str = "true") -> str:
    tests = [f"contains(t.t, {S.lit(w)})" for w in include] + [f"NOT coalesce(contains(t.t, {S.lit(w)}), false)" for w in exclude] + [where]
    return f"SELECT found.* FROM found LEFT JOIN ({_TEXT}) t USING (file_id) WHERE " + " AND ".join(tests)


@query("Q3 Q7 Q8 Q12 Q15", f"SELECT {_ROW} FROM ({_like(['the', 'nota'], ['of the'])}) ORDER BY mtime DESC NULLS LAST, file_id LIMIT 50")
def search_substring(e: Estate) -> DataFrame:
    return shown(Q.search(library(e), S.TOKEN, Q.SearchParams('nota THÉ -"of the"', limit=50)))


@query("Q3 Q6", f"SELECT file_id FROM ({_like(['de'], ['d3 en', 'que la'])})")
def substring_matches(e: Estate) -> DataFrame:
    return Q.matches(library(e), S.TOKEN, Q.SearchParams('de -"d3 en" -que-la')).select("file_id")


@query("Q7 Q12 X8 X18", f"""SELECT {_ROW} FROM ({_like(['e'], [], "extension NOT IN " + S.sids(sorted({'pdf', 'docx', 'xlsx', 'txt', 'html', 'dwg', 'zip'})) + " AND mtime >= TIMESTAMP '2012-01-01' AND mtime < TIMESTAMP '2023-01-02'")}) ORDER BY lower(name), file_id LIMIT 30 OFFSET 2""")
def search_other_by_name(e: Estate) -> DataFrame:
    p = Q.SearchParams("e", type="other", modified_from="2012-01-01", modified_to="2023-01-01", sort="name", limit=30, offset=2)
    return shown(Q.search(library(e), S.TOKEN, p))


@query("Q7", f"SELECT {_ROW} FROM ({_like(['nota'], [], 'share_id = 1 AND extension IN ' + S.sids(['doc', 'docx']))}) ORDER BY mtime DESC NULLS LAST, file_id LIMIT 20")
def search_one_share(e: Estate) -> DataFrame:
    return shown(Q.search(library(e), S.TOKEN, Q.SearchParams("nota", share_id=1, type="word")))


@query("Q17 Q12", f"SELECT {_ROW} FROM found ORDER BY mtime DESC NULLS LAST, file_id LIMIT 10")
def recently_modified(e: Estate) -> DataFrame:
    return shown(Q.recently_modified(library(e), S.TOKEN))


@query("Q10", f"SELECT least(n, 1000) AS total, n > 1000 AS total_capped FROM (SELECT count(*) AS n FROM ({_like(['e'])}))")
def result_count(e: Estate) -> DataFrame:
    return Q.capped_count(Q.matches(library(e), S.TOKEN, Q.SearchParams("e")))


@query("Q10", "SELECT least(n, 25) AS total, n > 25 AS total_capped FROM (SELECT count(*) AS n FROM found)", name="capped_result_count")
def capped_result_count(e: Estate) -> DataFrame:
    return Q.capped_count(Q.matches(library(e), S.TOKEN, Q.SearchParams()), 25)


# ── Postings mode ────────────────────────────────────────────────────────────

_FIELDS = f"""SELECT d.file_id, {S.word_list('f.name')} AS a, {S.word_list("s.name || ' ' || f.fpath")} AS b, {S.word_list("coalesce(d.content, '')")} AS c
    FROM est_docs d JOIN est_files f USING (file_id) JOIN est_shares s USING (share_id)"""


def _run(phrase: str, fields: str = "abc") -> str:
    return "(" + " OR ".join(f"contains(' ' || array_to_string(w.{f}, ' ') || ' ', ' {phrase} ')" for f in fields) + ")"


def _score(words: list[str]) -> str:
    per = [f"{weight} * len(list_filter(w.{f}, lambda x: x = '{word}'))" for word in words for f, weight in (("a", 1.0), ("b", 0.4), ("c", 0.2))]
    return "round(" + " + ".join(per) + ", 6)::DOUBLE"


def _words(where: str, columns: str = "found.*") -> str:
    return f"SELECT {columns} FROM found JOIN ({_FIELDS}) w USING (file_id) WHERE {where}"


@query("Q2 Q8", f"SELECT file_id FROM ({_words(_run('the') + ' AND ' + _run('nota'))})")
def search_all_words(e: Estate) -> DataFrame:
    return Q.matches(library(e, False), S.TOKEN, Q.SearchParams("the nota"), "postings", False).select("file_id")


@query("Q4", f"SELECT file_id FROM ({_words(_run('of the') + ' AND ' + _run('nota'))})")
def search_phrase(e: Estate) -> DataFrame:
    return Q.matches(library(e, False), S.TOKEN, Q.SearchParams('"of the" nota'), "postings", False).select("file_id")


@query("Q5", f"SELECT file_id FROM ({_words(_run('of the') + ' OR (' + _run('que') + ' AND ' + _run('nota') + ') OR ' + _run('src2'))})")
def search_alternatives(e: Estate) -> DataFrame:
    return Q.matches(library(e, False), S.TOKEN, Q.SearchParams('"of the" or que nota OR src2'), "postings", False).select("file_id")


@query("Q6", f"SELECT file_id FROM ({_words(_run('the') + ' AND NOT ' + _run('of the') + ' AND NOT ' + _run('d1'))})")
def search_exclusions(e: Estate) -> DataFrame:
    return Q.matches(library(e, False), S.TOKEN, Q.SearchParams('the -"of the" -d1'), "postings", False).select("file_id")


@query("Q6", f"SELECT file_id FROM found WHERE file_id NOT IN (SELECT file_id FROM ({_words(_run('the'))}))", name="search_only_exclusions")
def search_only_exclusions(e: Estate) -> DataFrame:
    """Files without an index row are not excluded."""
    return Q.matches(library(e, False), S.TOKEN, Q.SearchParams("-the"), "postings", False).select("file_id")


@query("Q9 Q11 Q12 Q13 Q15", f"SELECT {_ROW}, score FROM ({_words(_run('and') + ' AND ' + _run('the'), 'found.*, ' + _score(['and', 'the']) + ' AS score')}) ORDER BY score DESC, mtime DESC NULLS LAST, file_id LIMIT 40")
def search_ranked(e: Estate) -> DataFrame:
    page = Q.search(library(e, False), S.TOKEN, Q.SearchParams("and the", limit=40), "postings", False, rank="places")
    return page.select("file_id", "name", "share", "folder_path", "path", "size", F.col("mtime").cast("string").alias("mtime"), "score")


def _runs(phrase: str, weigh: float = 1.0) -> str:
    """Weight of the whole runs of a phrase."""
    typed = phrase.split()
    same = lambda f: " AND ".join(f"w.{f}[i + {n}] = '{t}'" for n, t in enumerate(typed))
    per = [f"{weight * len(typed)} * len(list_filter(range(1, len(w.{f}) + 1), lambda i: coalesce({same(f)}, false)))" for f, weight in (("a", 1.0), ("b", 0.4), ("c", 0.2))]
    return "(" + " + ".join(per) + ")"


@query("Q4 Q9", f"SELECT file_id, round({_runs('of the')} + {_runs('and')}, 6)::DOUBLE AS score FROM ({_words(_run('of the') + ' AND ' + _run('and'), 'found.*, w.*')}) w")
def phrase_scores(e: Estate) -> DataFrame:
    """Words of a phrase that stray elsewhere weigh nothing."""
    return Q.matches(library(e, False), S.TOKEN, Q.SearchParams('"of the" and'), "postings", False, "places").select("file_id", "score")


_BOTH = f"({_run('que')} AND {_run('nota')})"


@query("Q5 Q9", f"""SELECT file_id, round(CASE WHEN {_run('of the')} THEN {_runs('of the')} ELSE 0 END + CASE WHEN {_BOTH} THEN {_runs('que')} + {_runs('nota')} ELSE 0 END, 6)::DOUBLE AS score
    FROM ({_words(_run('of the') + ' OR ' + _BOTH, 'found.*, w.*')}) w""")
def alternative_scores(e: Estate) -> DataFrame:
    """Only alternatives that were found weigh."""
    return Q.matches(library(e, False), S.TOKEN, Q.SearchParams('"of the" or que nota'), "postings", False, "places").select("file_id", "score")


def _covers(words: list[str], phrases: list[str], alternatives: list[list[int]], where: str) -> str:
    """Scores by cover density. Items are the single words, then the phrases of two; alternatives list numbers of items."""
    every = sorted({*words, *(w for p in phrases for w in p.split())})
    ends = [f"word = '{w}'" for w in words] + [f"word = '{p.split()[1]}' AND before = '{p.split()[0]}'" for p in phrases]
    long = [0] * len(words) + [1] * len(phrases)
    last = ", ".join(f"max(pos - {long[i]}) FILTER ({end}) OVER o AS s{i}" for i, end in enumerate(ends))
    best = "greatest(" + ", ".join("CASE WHEN " + " AND ".join(f"s{i} IS NOT NULL" for i in items) + " THEN least(" + ", ".join(f"s{i}" for i in items) + ") END" for items in alternatives) + ", NULL)"
    return f"""WITH w AS (SELECT file_id, len(a) AS la, len(b) AS lb, list_concat(a, b, c) AS ws FROM ({_words(where, 'found.file_id, w.* EXCLUDE (file_id)')})), p AS (SELECT file_id, unnest(range(1, len(ws) + 1)) AS pos FROM w),
    e AS (SELECT file_id, pos, ws[pos] AS word, CASE WHEN pos - 1 NOT IN (0, la, la + lb) THEN ws[pos - 1] END AS before, CASE WHEN pos <= la THEN 10 WHEN pos <= la + lb THEN 25 ELSE 50 END AS field FROM p JOIN w USING (file_id)),
    h AS (SELECT *, row_number() OVER o AS n, sum(field) OVER o AS upto FROM e WHERE word IN ({", ".join(f"'{w}'" for w in every)}) WINDOW o AS (PARTITION BY file_id ORDER BY pos)),
    l AS (SELECT *, {last} FROM h WINDOW o AS (PARTITION BY file_id ORDER BY pos)), b AS (SELECT *, {best} AS s FROM l),
    c AS (SELECT *, lag(s) OVER (PARTITION BY file_id ORDER BY pos) AS p FROM b)
    SELECT c.file_id, round(sum((c.n - z.n + 1) * 10.0 / (c.upto - z.upto + z.field) / (1 + (c.pos - z.pos) - (c.n - z.n))), 6)::DOUBLE AS score
    FROM c JOIN h z ON z.file_id = c.file_id AND z.pos = c.s WHERE c.s IS NOT NULL AND (c.p IS NULL OR c.s > c.p) GROUP BY c.file_id"""


@query("Q9", _covers(["and", "nota"], [], [[0, 1]], _run("and") + " AND " + _run("nota")))
def cover_scores(e: Estate) -> DataFrame:
    """Two words, of which one mostly stands in names and the other in contents: near and far, once and often."""
    return Q.matches(library(e, False), S.TOKEN, Q.SearchParams("and nota"), "postings", False).select("file_id", "score")


@query("Q9 Q4", _covers(["and", "the"], ["of the"], [[0, 1, 2]], " AND ".join(_run(x) for x in ("and", "the", "of the"))))
def cover_scores_phrase(e: Estate) -> DataFrame:
    """A phrase and two words, one of which is part of the phrase."""
    return Q.matches(library(e, False), S.TOKEN, Q.SearchParams('and the "of the"'), "postings", False).select("file_id", "score")


@query("Q9 Q5", _covers(["que", "nota"], ["of the"], [[2], [0, 1]], f"{_run('of the')} OR ({_run('que')} AND {_run('nota')})"))
def cover_scores_alternatives(e: Estate) -> DataFrame:
    return Q.matches(library(e, False), S.TOKEN, Q.SearchParams('"of the" or que nota'), "postings", False).select("file_id", "score")


_MATCHED = _words(_run('en'), f"found.*, {_run('en', 'ab')} AS in_title")


@query("Q11", f"""WITH m AS ({_MATCHED}) SELECT file_id FROM (SELECT file_id FROM m WHERE in_title ORDER BY mtime DESC NULLS LAST, file_id LIMIT 20)
    UNION SELECT file_id FROM (SELECT file_id FROM m ORDER BY mtime DESC NULLS LAST, file_id LIMIT 20)""")
def rank_candidates(e: Estate) -> DataFrame:
    found = Q.matches(library(e, False), S.TOKEN, Q.SearchParams("en"), "postings", False)
    return Q.rank_candidates(found, 20).select("file_id")


@query("Q2 Q9 I9")
def search_stemmed(e: Estate) -> DataFrame:
    """Bilingual search: each word as typed, by its Spanish and by its English stem."""
    return Q.search(library(e, True), S.TOKEN, Q.SearchParams("anean notas", limit=100), "postings").select("file_id", "name", "score")


_HIT = r"(?s)^(.*?)(^|[^\p{L}\p{N}_])(?:nota|than)"


_SNIPPETS = rf"""WITH page AS (SELECT file_id FROM ({_like(['nota', 'than'])}) ORDER BY mtime DESC NULLS LAST, file_id LIMIT 50),
    t AS (SELECT file_id, content AS c, length(content) AS n, {S.fold('content')} AS f FROM page JOIN est_docs USING (file_id)),
    h AS (SELECT *, CASE WHEN regexp_matches(f, '{_HIT}') THEN greatest(0, length(regexp_extract(f, '{_HIT}', 1)) + length(regexp_extract(f, '{_HIT}', 2)) - 80) ELSE 0 END AS a0 FROM t),
    w AS (SELECT *, least(n, a0 + 240) AS b0, strpos(reverse(substr(c, 1, a0)), ' ') AS back FROM h),
    v AS (SELECT *, CASE WHEN a0 > 0 AND back BETWEEN 1 AND 29 THEN a0 - back + 1 ELSE a0 END AS a, strpos(substr(c, b0 + 1), ' ') AS ahead FROM w),
    u AS (SELECT *, CASE WHEN b0 < n AND ahead BETWEEN 1 AND 30 THEN b0 + ahead - 1 ELSE b0 END AS b FROM v)
    SELECT file_id, CASE WHEN a > 0 THEN '…' ELSE '' END || regexp_replace(substr(c, a + 1, b - a), '[{_SP}]+', ' ', 'g') || CASE WHEN b < n THEN '…' ELSE '' END AS snippet FROM u"""


@query("Q14 Q13", _SNIPPETS)
def search_snippets(e: Estate) -> DataFrame:
    """The window shown with each result; which words light up is checked in the tests."""
    lib = library(e)
    params = Q.SearchParams("nota than", limit=50)
    page = Q.search(lib, S.TOKEN, params)
    return Q.with_snippets(page, lib.documents, Q.parse(params.q)).select(
        "file_id", F.array_join(F.transform("snippet", lambda s: s["text"]), "").alias("snippet"))


@query("Q10 Q12 Q13 Q14 Q15", f"""SELECT r.file_id, name, path, size, mtime, snippet, total, total_capped FROM ({_SNIPPETS}) r JOIN (SELECT {_ROW} FROM found) USING (file_id),
    (SELECT least(n, 1000) AS total, n > 1000 AS total_capped FROM (SELECT count(*) AS n FROM ({_like(['nota', 'than'])})))""")
def search_response(e: Estate) -> DataFrame:
    """A page with snippets and the count of all that was found, from one set of matches."""
    shown_, total = Q.respond(library(e), S.TOKEN, Q.SearchParams("nota than", limit=50))
    return shown_.withColumn("k", F.lit(1)).join(total.withColumn("k", F.lit(1)), "k").select(
        "file_id", "name", "path", "size", F.col("mtime").cast("string").alias("mtime"), F.array_join(F.transform("snippet", lambda s: s["text"]), "").alias("snippet"), "total", "total_capped")


# ── Browsing ─────────────────────────────────────────────────────────────────

_OPEN = "SELECT d.* FROM est_folders d JOIN est_shares s USING (share_id) WHERE s.enabled AND d.acl_id IN (SELECT acl_id FROM listable)"


def tables(e: Estate) -> tuple:
    return e.folders, e.shares, e.acls


@query("B1", f"SELECT s.share_id, s.name, s.path, d.folder_id AS root_folder_id FROM est_shares s JOIN ({_OPEN}) d USING (share_id) WHERE d.path = ''")
def browsable_shares(e: Estate) -> DataFrame:
    return B.browsable_shares(e.shares, e.folders, e.acls, S.TOKEN)


@query("B2", f"SELECT p.folder_id AS parent_id, c.folder_id, c.name FROM ({_OPEN}) c JOIN ({_OPEN}) p ON p.share_id = c.share_id AND c.path <> '' AND p.path = {S.parent('c.path')}")
def child_folders(e: Estate) -> DataFrame:
    return B.child_folders(*tables(e), S.TOKEN)


@query("B3", f"""SELECT folder_id, file_id, name, rank::INT AS rank, n > 3 AS files_truncated FROM (SELECT v.*, row_number() OVER (PARTITION BY folder_id ORDER BY lower(v.name), file_id) AS rank,
    count(*) OVER (PARTITION BY folder_id) AS n FROM visible v WHERE folder_id IN (SELECT folder_id FROM ({_OPEN}))) WHERE rank <= 3""")
def folder_files(e: Estate) -> DataFrame:
    return B.folder_files(e.files, *tables(e), S.TOKEN, limit=3).select("folder_id", "file_id", "name", "rank", "files_truncated")


@query("B3", f"SELECT folder_id, file_id, false AS files_truncated FROM visible WHERE folder_id IN (SELECT folder_id FROM ({_OPEN}))", name="folder_files_default_limit")
def folder_files_default_limit(e: Estate) -> DataFrame:
    return B.folder_files(e.files, *tables(e), S.TOKEN).select("folder_id", "file_id", "files_truncated")


@query("B4", f"SELECT folder_id, folder_id NOT IN (SELECT folder_id FROM visible) AND acl_id NOT IN (SELECT acl_id FROM opening) AS files_hidden FROM ({_OPEN})")
def hidden_files_flag(e: Estate) -> DataFrame:
    return B.hidden_files_flag(e.files, *tables(e), S.TOKEN)


@query("B5", f"""SELECT c.folder_id, ordinal::INT AS ordinal, l.folder_id AS link_id, CASE WHEN c.above = '' THEN s.name ELSE regexp_extract(c.above, '([^/]*)$', 1) END AS name
    FROM (SELECT share_id, folder_id, unnest(list_sort({S.ancestors('path')}, 'ASC')) AS above, unnest(range(0, len({S.ancestors('path')}))) AS ordinal FROM ({_OPEN})) c
    JOIN est_shares s USING (share_id) LEFT JOIN ({_OPEN}) l ON l.share_id = c.share_id AND l.path = c.above""")
def breadcrumbs(e: Estate) -> DataFrame:
    return B.breadcrumbs(*tables(e), S.TOKEN)


@query("B6", f"""SELECT p.share_id, p.folder_id, p.status, CASE WHEN p.status = 'planned' OR EXISTS (SELECT 1 FROM ({_OPEN}) o WHERE o.share_id = p.share_id
    AND o.path = CASE WHEN p.entry_path = '' THEN '' ELSE substr(p.path, 1, length(p.entry_path)) END AND p.entry_path IS NOT NULL) THEN p.entry_path END AS entry_path
    FROM placed p WHERE p.folder_id IN (SELECT folder_id FROM ({_OPEN}))""")
def browsing_placement(e: Estate) -> DataFrame:
    return B.folder_placements(*tables(e), e.plan, S.TOKEN)


@query("B7 X22", f"""SELECT f.file_id, {S.show('f.share_path', 'f.folder_path', 'f.name')} AS path, d.status AS index_status, CASE WHEN d.content <> '' THEN substr(d.content, 1, 5000) END AS text_excerpt,
    coalesce(length(d.content) > 5000, false) AS text_truncated, CASE WHEN f.extension = 'pdf' THEN 'pdf' END AS preview FROM found f LEFT JOIN est_docs d USING (file_id)""")
def document_details(e: Estate) -> DataFrame:
    return B.document_details(e.files.drop("content"), *tables(e), e.documents, S.TOKEN).select(
        "file_id", "path", "index_status", "text_excerpt", "text_truncated", "preview")
