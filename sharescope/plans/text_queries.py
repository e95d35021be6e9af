"""Scalar functions over the columns of the estate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import paths as P
from ..functions import text as T
from ..functions import values as V
from ..operators import folderplan as L
from ..schema import EXTRACT_MAX_CHARS, TYPE_GROUPS
from ..sources.derived import AS_OF, Estate
from . import base_sql as S
from .registry import query


@query("X1", f"SELECT doc_id, {S.fold('text')} AS folded FROM documents")
def fold_text(e: Estate) -> DataFrame:
    return e.table("documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("X2", f"SELECT doc_id, {S.words('text')} AS words, CAST(len({S.word_list('text')}) AS BIGINT) AS n_words FROM documents")
def word_split(e: Estate) -> DataFrame:
    return e.table("documents").select(
        "doc_id", T.words(F.col("text")).alias("words"), F.size(T.word_array(F.col("text"))).cast("long").alias("n_words"))


_SP = r"\t-\r\x1c-\x20\x85\p{Z}"


_LONG_SQL = r"repeat(html || E'\t\n \n\n', CASE WHEN page_id % 8 = 0 THEN CAST(250000 // length(html) + 2 AS INT) ELSE 2 END)"
_LONG = r"repeat(concat(html, '\t\n \n\n'), CASE WHEN page_id % 8 = 0 THEN CAST(250000 div length(html) + 2 AS INT) ELSE 2 END)"


@query("X3", rf"""SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(html || E'\t\n \n\n' || html, '[ \t\r\f\x0B]+', ' ', 'g'),
    '\n[{_SP}]*\n+', E'\n\n', 'g'), '^[{_SP}]+|[{_SP}]+$', '', 'g'), 1, 200000) AS clean FROM pages""")
def clean_content(e: Estate) -> DataFrame:
    raw = F.concat("html", F.lit("\t\n \n\n"), "html")
    return e.table("pages").select("page_id", T.clean_content(raw, EXTRACT_MAX_CHARS).alias("clean"))


@query("X3", rf"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_LONG_SQL}, '[ \t\r\f\x0B]+', ' ', 'g'),
    '\n[{_SP}]*\n+', E'\n\n', 'g'), '^[{_SP}]+|[{_SP}]+$', '', 'g') AS clean FROM pages""")
def clean_content_whole(e: Estate) -> DataFrame:
    """Whole texts, every eighth page repeated until it is longer than any limit of `clean_content`."""
    html = e.table("pages").select("page_id", F.expr(_LONG).alias("raw"))
    return html.select("page_id", T.clean_content(F.col("raw")).alias("clean"))


_ODD_NAME = "name || CASE file_id % 5 WHEN 0 THEN '.TAR.GZ' WHEN 1 THEN '' WHEN 2 THEN '.' WHEN 3 THEN '.' || repeat('x', 40) ELSE ' v2.PDF' END"


@query("X4 X5", rf"""SELECT file_id, odd, substr({S.extension('odd')}, 1, 32) AS extension, {S.stem('odd')} AS stem
    FROM (SELECT file_id, {_ODD_NAME} AS odd FROM est_files UNION ALL SELECT -1 - file_id, '.' || extension FROM est_files)""")
def name_parts(e: Estate) -> DataFrame:
    odd = e.files.select("file_id", F.expr(_ODD_NAME.replace("name || CASE", "concat(name, CASE").replace("END", "END)")).alias("odd"))
    hidden = e.files.select((-1 - F.col("file_id")).alias("file_id"), F.concat(F.lit("."), "extension").alias("odd"))
    return odd.unionByName(hidden).select("file_id", "odd", N.extension(F.col("odd")).alias("extension"),
                                          N.stem(F.col("odd")).alias("stem"))


_SHARE_FORMS = r"CASE share_id % 4 WHEN 0 THEN path WHEN 1 THEN path || '\' WHEN 2 THEN '/srv/' || name || '/' ELSE 'C:\Shares\' || name END"


@query("X6 J1", rf"""SELECT file_id, regexp_replace(sp, '[\\/]+$', '') || CASE WHEN f.fpath = '' THEN '' ELSE sep || replace(f.fpath, '/', sep) END || sep || f.name AS shown
    FROM est_files f JOIN (SELECT *, CASE WHEN starts_with(sp, '/') AND NOT starts_with(sp, '//') THEN '/' ELSE '\' END AS sep
    FROM (SELECT share_id, {_SHARE_FORMS} AS sp FROM est_shares)) s USING (share_id)""")
def display_path(e: Estate) -> DataFrame:
    form = F.col("share_id") % 4
    sp = (F.when(form == 0, F.col("path")).when(form == 1, F.concat("path", F.lit("\\")))
          .when(form == 2, F.concat(F.lit("/srv/"), "name", F.lit("/")))
          .otherwise(F.concat(F.lit("C:\\Shares\\"), "name")))
    roots = e.shares.select("share_id", sp.alias("sp"))
    return e.files.select("file_id", "share_id", "fpath", "name").join(roots, "share_id").select(
        "file_id", P.display_path(F.col("sp"), F.col("fpath"), F.col("name")).alias("shown"))


@query("X7 R1", """SELECT share_id, path, name FROM est_listing WHERE lower(name) NOT IN ('thumbs.db', 'desktop.ini', '.ds_store',
    '$recycle.bin', 'system volume information', 'dfsrprivate', '~snapshot') AND NOT starts_with(lower(name), '~$')""")
def ignore_filter(e: Estate) -> DataFrame:
    return e.listing.filter(~N.is_ignored(F.col("name"))).select("share_id", "path", "name")


_GROUP_CASE = "CASE " + " ".join(f"WHEN extension IN {S.sids(exts)} THEN '{k}'" for k, (_, exts) in TYPE_GROUPS.items()) + " ELSE 'other' END"


@query("X8", f"SELECT {_GROUP_CASE} AS type_group, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM est_files GROUP BY 1")
def type_groups(e: Estate) -> DataFrame:
    return e.files.groupBy(N.type_group(F.col("extension")).alias("type_group")).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("X9", r"""SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+\-@\t\r]') THEN '''' || t ELSE t END AS cell
    FROM (SELECT doc_id, substr('=+-@x ', CAST(doc_id % 6 AS INT) + 1, 1) || text AS t FROM documents)""")
def formula_safe_cell(e: Estate) -> DataFrame:
    risky = F.expr("concat(substr('=+-@x ', CAST(doc_id % 6 AS INT) + 1, 1), text)")
    return e.table("documents").select("doc_id", V.formula_safe(risky).alias("cell"))


@query("X10 X11", f"SELECT share_id, path, CAST({S.depth('path')} AS BIGINT) AS depth, upper(path) AS shouted, lower(upper(path)) AS path_key, "
                  f"{S.parent('path')} AS parent FROM est_folders")
def path_depth_and_key(e: Estate) -> DataFrame:
    p = F.col("path")
    return e.folders.select("share_id", "path", P.depth(p).alias("depth"), F.upper(p).alias("shouted"),
                            P.path_key(F.upper(p)).alias("path_key"), P.parent(p).alias("parent"))


_RAW_PATH = r"""'\' || replace(fpath, '/', ' \\ ') || CASE file_id % 7 WHEN 0 THEN '\..\x' WHEN 1 THEN '/a:b' WHEN 2 THEN '/final.' WHEN 3 THEN '//b?|c/'
    WHEN 4 THEN '\' || repeat('n', 300) WHEN 5 THEN '/ sub /' ELSE '' END"""


@query("X12", rf"""SELECT file_id, array_to_string(parts, '/') AS path,
    concat_ws(',', CASE WHEN len(list_filter(parts, lambda p: regexp_matches(p, '[<>:"|?*\x00-\x1f]'))) > 0 THEN 'character' END,
        CASE WHEN len(list_filter(parts, lambda p: p IN ('.', '..'))) > 0 THEN 'dots' END,
        CASE WHEN len(list_filter(parts, lambda p: length(p) > 255)) > 0 THEN 'too long' END,
        CASE WHEN len(list_filter(parts, lambda p: p NOT IN ('.', '..') AND ends_with(p, '.'))) > 0 THEN 'trailing dot' END) AS problems
    FROM (SELECT file_id, list_filter(list_transform(string_split(replace(raw, '\', '/'), '/'), lambda p: trim(p)), lambda p: p <> '') AS parts
          FROM (SELECT file_id, {_RAW_PATH} AS raw FROM est_files))""")
def normalize_path(e: Estate) -> DataFrame:
    tail = F.expr(r"""CASE file_id % 7 WHEN 0 THEN '\\..\\x' WHEN 1 THEN '/a:b' WHEN 2 THEN '/final.' WHEN 3 THEN '//b?|c/'
        WHEN 4 THEN concat('\\', repeat('n', 300)) WHEN 5 THEN '/ sub /' ELSE '' END""")
    raw = F.concat(F.lit("\\"), F.replace(F.col("fpath"), F.lit("/"), F.lit(" \\\\ ")), tail)
    path = P.normalize_path(raw)
    return e.files.select("file_id", path.alias("path")).withColumn(
        "problems", F.array_join(P.path_problems(F.col("path")), ","))


@query("X13", "SELECT share_id, path, replace(lower(path), '/', chr(1)) AS order_key FROM est_folders")
def tree_order(e: Estate) -> DataFrame:
    p = F.col("path")
    return (e.folders.select("share_id", "path", F.replace(F.lower(p), F.lit("/"), F.lit("\x01")).alias("order_key"))
            .orderBy("share_id", P.tree_order(p)))


_PATTERNS = [("{YYYY}-{N} *", "(19|20)[0-9][0-9]-[0-9]+ .*"), ("nota {N}", "nota [0-9]+"), ("*{N}*{N}", ".*[0-9]+.*[0-9]+"),
             ("{yyyy}-?? INFORMÉ", "(19|20)[0-9][0-9]-.. informe"), ("* * * * * x", ".* .* .* .* .* x"), ("nota*1", "nota.*1"), ("*", ".*")]


@query("X14", f"""SELECT file_id, pattern, regexp_matches({S.fold('(' + S.stem('name') + ')')}, '(?s)^(' || regex || ')$') AS follows
    FROM est_files, (VALUES {S.values(_PATTERNS)}) p(pattern, regex)""")
def naming_patterns(e: Estate) -> DataFrame:
    patterns = F.explode(F.array(*[F.lit(p) for p, _ in _PATTERNS]))
    asked = e.files.select("file_id", "name", patterns.alias("pattern")).withColumn("regex", N.pattern_regex(F.col("pattern")))
    return asked.select("file_id", "pattern", N.matches_pattern(F.col("name"), F.col("regex")).alias("follows"))


@query("X15", r"""SELECT page_id, array_to_string(list_filter(t, lambda v, i: list_position(list_transform(t, lambda x: lower(x)), lower(v)) = i), '|') AS kept,
    array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), '|') AS extensions
    FROM (SELECT page_id, list_filter(list_transform(raw, lambda v: trim(v)), lambda v: v <> '') AS t,
          list_filter(list_transform(raw, lambda v: lower(regexp_replace(trim(v), '^\.+', ''))), lambda v: v <> '') AS x
          FROM (SELECT page_id, string_split(replace(replace(url || '/' || upper(url), '.', '/ .. '), '?', '/'), '/') AS raw FROM pages))""")
def clean_lists(e: Estate) -> DataFrame:
    doubled = F.concat("url", F.lit("/"), F.upper("url"))
    raw = F.split(F.replace(F.replace(doubled, F.lit("."), F.lit("/ .. ")), F.lit("?"), F.lit("/")), "/")
    return e.table("pages").select("page_id", F.array_join(V.clean_list(raw), "|").alias("kept"),
                                   F.array_join(V.clean_list(raw, extensions=True), "|").alias("extensions"))


@query("X16", f"""SELECT share_id, path_key, example, CASE WHEN naming_pattern IS NOT NULL AND NOT regexp_matches({S.fold('(' + S.stem('example') + ')')}, regex)
    THEN 'pattern' ELSE 'type' END AS problem
    FROM (SELECT *, unnest(examples) AS example FROM est_plan)
    WHERE (naming_pattern IS NOT NULL AND NOT regexp_matches({S.fold('(' + S.stem('example') + ')')}, regex))
       OR (len(extensions) > 0 AND NOT list_contains(extensions, {S.extension('example')}))""")
def example_check(e: Estate) -> DataFrame:
    return L.example_problems(e.plan).select("share_id", "path_key", "example", "problem")


@query("X17", """SELECT file_id, CASE WHEN mtime IS NULL THEN 'unknown' WHEN mtime >= TIMESTAMP '2024-01-01' - INTERVAL 365 DAY THEN '< 1 year'
    WHEN mtime >= TIMESTAMP '2024-01-01' - INTERVAL 1095 DAY THEN '1-3 years' WHEN mtime >= TIMESTAMP '2024-01-01' - INTERVAL 1825 DAY THEN '3-5 years'
    WHEN mtime >= TIMESTAMP '2024-01-01' - INTERVAL 3650 DAY THEN '5-10 years' ELSE '> 10 years' END AS age FROM est_files""")
def age_classes(e: Estate) -> DataFrame:
    return e.files.select("file_id", V.age_class(F.col("mtime"), AS_OF).alias("age"))


@query("X18", "SELECT file_id, CAST(mtime AS VARCHAR) AS mtime FROM est_files WHERE mtime >= TIMESTAMP '2015-03-01' AND mtime < TIMESTAMP '2019-07-01'")
def day_range(e: Estate) -> DataFrame:
    return e.files.filter(V.in_days(F.col("mtime"), "2015-03-01", "2019-06-30")).select(
        "file_id", F.col("mtime").cast("string").alias("mtime"))


@query("X19", """SELECT file_id, (a IS NULL AND b IS NULL) OR coalesce(abs(epoch_us(a) - epoch_us(b)) < 1000000, false) AS same FROM (
    SELECT file_id, mtime AS a, CASE file_id % 4 WHEN 0 THEN mtime WHEN 1 THEN mtime + INTERVAL 999 MILLISECOND WHEN 2 THEN mtime - INTERVAL 1 SECOND END AS b FROM est_files)""")
def same_time(e: Estate) -> DataFrame:
    other = F.expr("CASE file_id % 4 WHEN 0 THEN mtime WHEN 1 THEN mtime + INTERVAL '0.999' SECOND WHEN 2 THEN mtime - INTERVAL '1' SECOND END")
    return e.files.select("file_id", V.same_time(F.col("mtime"), other).alias("same"))


@query("X20", r"""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN lower(c_name) WHEN 1 THEN lower(c_name) WHEN 2 THEN lower(c_name)
    WHEN 3 THEN lower(c_name) || '@other.org' ELSE lower(c_name) END AS account FROM customer""")
def usernames(e: Estate) -> DataFrame:
    typed = F.expr(r"""CASE c_custkey % 5 WHEN 0 THEN concat('CORP\\', c_name) WHEN 1 THEN concat(c_name, '@Example.com')
        WHEN 2 THEN concat('  ', upper(c_name), '\t') WHEN 3 THEN concat(c_name, '@Other.org') ELSE c_name END""")
    return e.table("customer").select("c_custkey", V.normalize_username(typed, "example.com").alias("account"))


@query("X21", f"""SELECT file_id, CASE WHEN extension NOT IN {S.sids(N.EXTRACTABLE)} THEN 'metadata' WHEN size > 3000 THEN 'too_large' ELSE 'pending' END AS status FROM est_files""")
def initial_status(e: Estate) -> DataFrame:
    return e.files.select("file_id", N.initial_status(F.col("extension"), F.col("size"), 3000).alias("status"))


@query("X22", "SELECT doc_id, substr(text, 1, 5000) AS excerpt, length(text) > 5000 AS truncated FROM documents")
def excerpts(e: Estate) -> DataFrame:
    first, cut = T.excerpt(F.col("text"))
    return e.table("documents").select("doc_id", first.alias("excerpt"), cut.alias("truncated"))


@query("X23", "SELECT event_id, CAST(props AS JSON) ->> '$.k' AS k, CAST(props AS JSON) ->> '$.q' AS q FROM events")
def json_fields(e: Estate) -> DataFrame:
    return e.table("events").select("event_id", V.json_field(F.col("props"), "k").alias("k"), V.json_field(F.col("props"), "q").alias("q"))


@query("X24", r"""SELECT o_orderkey, CASE WHEN b = 0 THEN '—' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(b / 1024.0 * 10 + 0.5) / 10)
    WHEN b < 1073741824 THEN printf('%.1f MB', floor(b / 1048576.0 * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(b / 1073741824.0 * 10 + 0.5) / 10) END AS shown,
    CASE WHEN o_orderkey % 7 <> 0 THEN floor((o_orderkey % 5)::DOUBLE / (o_orderkey % 7) * 1000 + 0.5) / 10 END AS pct
    FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN o_orderkey % 1024 WHEN 2 THEN o_orderkey * 256 WHEN 3 THEN o_orderkey * 1048576 ELSE o_orderkey * 1073741824 END AS b FROM orders)""")
def human_sizes(e: Estate) -> DataFrame:
    b = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN o_orderkey % 1024 WHEN 2 THEN o_orderkey * 256 WHEN 3 THEN o_orderkey * 1048576 ELSE o_orderkey * 1073741824 END")
    key = F.col("o_orderkey")
    return e.table("orders").select("o_orderkey", V.human_size(b).alias("shown"), V.percentage(key % 5, key % 7).cast("double").alias("pct"))
