"""The derived estate in plain SQL, written independently of the Spark derivation, for result checks."""

from __future__ import annotations

import re

from ..functions.text import FOLD_FROM, FOLD_TO
from ..sources.derived import ACL_ROWS, PLAN_ROWS, PROTECTED_ACLS

TOKEN = ["S-1-1-0", "S-1-5-11", "S-1-5-2", "S-1-5-32-545", "U10005", "G2001", "G2002", "G3001"]
BASELINE = TOKEN[:4]


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def sids(token) -> str:
    return "(" + ", ".join(lit(s) for s in token) + ")"


def fold(text: str) -> str:
    return f"lower(translate({text}, '{FOLD_FROM}', '{FOLD_TO}'))"


def words(text: str) -> str:
    return f"trim(regexp_replace({fold(text)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def word_list(text: str) -> str:
    return f"list_filter(string_split({words(text)}, ' '), lambda w: w <> '')"


def ancestors(path: str) -> str:
    return (f"list_distinct(list_transform(range(0, len(string_split({path}, '/')) + 1), "
            f"lambda i: array_to_string(list_slice(string_split({path}, '/'), 1, i), '/')))")


def depth(path: str) -> str:
    return f"CASE WHEN {path} = '' THEN 0 ELSE length({path}) - length(replace({path}, '/', '')) + 1 END"


def parent(path: str) -> str:
    return f"CASE WHEN {path} <> '' THEN regexp_extract({path}, '^(.*)/[^/]*$', 1) END"


def show(share_path: str, folder: str, name: str | None = None) -> str:
    out = f"{share_path} || CASE WHEN {folder} = '' THEN '' ELSE '\\' || replace({folder}, '/', '\\') END"
    return out if name is None else f"{out} || '\\' || {name}"


def stem(name: str) -> str:
    return f"CASE WHEN regexp_matches({name}, '(?s)^.+\\.[^.]*$') THEN regexp_extract({name}, '(?s)^(.+)\\.([^.]*)$', 1) ELSE {name} END"


def extension(name: str) -> str:
    return f"lower(regexp_extract({name}, '(?s)^(.+)\\.([^.]*)$', 2))"


def masks(entries: str, keys: str, where: str = "true", flags: str = "(flags & 8) = 0") -> str:
    """Bit by bit: a right is granted when the first entry that mentions it allows it."""
    return (f"SELECT {keys}, CAST(sum(CASE WHEN verdict = 'allow' THEN 1::BIGINT << bit ELSE 0 END) AS BIGINT) AS mask FROM "
            f"(SELECT {keys}, bit, arg_min(ace_type, position) AS verdict FROM {entries}, (SELECT unnest(range(0, 32))::INT AS bit) "
            f"WHERE (mask >> bit) & 1 = 1 AND {flags} AND {where} GROUP BY {keys}, bit) GROUP BY {keys}")


def level(mask: str) -> str:
    return (f"CASE WHEN {mask} & 2032127 = 2032127 THEN 'full' WHEN {mask} & 2 <> 0 AND {mask} & 65536 <> 0 AND {mask} & 1 <> 0 "
            f"THEN 'modify' WHEN {mask} & 2 <> 0 THEN 'write' WHEN {mask} & 1 <> 0 THEN 'read' ELSE 'none' END")


_FILE_NAME = ("CASE WHEN doc_id % 3 = 0 THEN (2010 + doc_id % 15) || '-' || doc_id || ' Informe' ELSE 'nota ' || doc_id END "
              "|| CASE WHEN ext = '' THEN '' ELSE '.' || ext END")

# A planned entry's pattern as an RE2 expression: the same answers without atomic groups.
_RE = "naming_pattern"
for _token, _regex in (("{YYYY}", "(19|20)[0-9][0-9]"), ("{MM}", "(0[1-9]|1[0-2])"),
                       ("{DD}", "(0[1-9]|[12][0-9]|3[01])"), ("{N}", "[0-9]+")):
    _RE = f"replace({_RE}, '{_token}', '{_regex}')"
_RE = f"'(?s)^' || replace(replace(replace({_RE}, '*', '.*'), 'Informe', 'informe'), 'NOTA', 'nota') || '$'"

TABLES: dict[str, str] = {
    "est_shares": r"SELECT DISTINCT CAST(substr(source, 4) AS INT) AS share_id, source AS name, '\\fs01\' || source AS path, "
                  r"CAST(substr(source, 4) AS INT) % 10 <> 9 AS enabled FROM documents",
    "est_files": f"""SELECT doc_id AS file_id, share_id, share_id || ':' || fpath AS folder_id, fpath, {_FILE_NAME} AS name,
        ext AS extension, n_chars AS size,
        CASE WHEN doc_id % 97 = 0 THEN NULL
             ELSE CAST(DATE '2024-01-01' - CAST((doc_id * 37) % 5000 AS INT) AS TIMESTAMP) END AS mtime,
        CASE WHEN doc_id % 83 = 0 THEN 7 WHEN doc_id % 79 = 0 THEN 8 END AS acl_id, text AS content
        FROM (SELECT doc_id, n_chars, text, CAST(substr(source, 4) AS INT) AS share_id,
            CASE WHEN doc_id % 40 = 1 THEN ''
                 ELSE lang || '/d' || (doc_id % 7) || CASE WHEN doc_id % 2 = 0 THEN '/s' || (doc_id % 3) ELSE '' END
                      || CASE WHEN doc_id % 50 = 0 THEN '/x1/x2/x3/x4/x5/x6/x7' ELSE '' END END AS fpath,
            CASE doc_id % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'txt'
                            WHEN 4 THEN 'html' WHEN 5 THEN 'dwg' WHEN 6 THEN 'zip' ELSE '' END AS ext
            FROM documents) d""",
    "est_folders": f"""SELECT share_id, share_id || ':' || p AS folder_id, p AS path, regexp_extract(p, '([^/]*)$', 1) AS name,
        CAST({depth('p')} AS BIGINT) AS depth,
        CASE WHEN (share_id + length(p)) % 11 = 10 THEN NULL ELSE CAST(1 + (share_id + length(p)) % 6 AS INT) END AS acl_id,
        'U' || (10000 + (share_id + length(p)) % 7) AS owner_sid,
        CASE WHEN (share_id + length(p)) % 11 = 10 AND (share_id + length(p)) % 2 = 0 THEN 'DescriptorError: ACL truncated' END AS acl_error,
        CASE WHEN p = 'Archivo/2020' AND share_id % 6 = 0 THEN 'Access denied' END AS list_error
        FROM (SELECT DISTINCT share_id, unnest({ancestors('fpath')}) AS p FROM est_files
              UNION SELECT share_id, 'Archivo' FROM est_shares UNION SELECT share_id, 'Archivo/2020' FROM est_shares) u""",
    "est_acl_entries": f"SELECT acl_id::INT AS acl_id, position::INT AS position, sid, ace_type, mask::BIGINT AS mask, flags::INT AS flags "
                       f"FROM (VALUES {values(ACL_ROWS)}) t(acl_id, position, sid, ace_type, mask, flags)",
    "est_acls": f"SELECT acl_id, acl_id IN {sids(PROTECTED_ACLS)} AS is_protected, bool_or((flags & 16) = 0) AS has_explicit "
                f"FROM est_acl_entries GROUP BY acl_id",
    "est_docs": """SELECT file_id, content, CASE WHEN file_id % 13 = 0 THEN 'error' WHEN file_id % 17 = 0 THEN 'pending'
        WHEN file_id % 19 = 0 THEN 'extracting' WHEN file_id % 23 = 0 THEN 'ocr_unavailable'
        WHEN file_id % 8 IN (5, 6, 7) THEN 'metadata' ELSE 'text' END AS status,
        CASE WHEN file_id % 13 = 0 THEN 'cannot read' END AS error FROM est_files""",
    "est_some_docs": "SELECT * FROM est_docs WHERE file_id % 3 <> 2",
    "est_plan": f"""SELECT share_id, path, lower(path) AS path_key, allow_files, allow_subfolders, naming_pattern,
        CASE WHEN ext = '' THEN [] ELSE string_split(ext, ',') END AS extensions, max_files::INT AS max_files, purpose,
        CASE WHEN ex = '' THEN [] ELSE string_split(ex, ',') END AS examples,
        CASE WHEN kw = '' THEN [] ELSE string_split(kw, ',') END AS keywords, {_RE} AS regex
        FROM (SELECT share_id FROM est_shares WHERE share_id % 7 <> 6),
        (VALUES {values(PLAN_ROWS)}) t(path, allow_files, allow_subfolders, naming_pattern, ext, max_files, purpose, ex, kw)""",
    "est_principals": """SELECT 'U' || (10000 + c_custkey) AS sid, c_name AS name,
        CASE WHEN c_custkey % 3 = 0 THEN 'Customer ' || c_custkey END AS display_name, 'user' AS kind FROM customer
        UNION ALL SELECT 'G' || (2000 + n_nationkey), n_name, NULL, 'group' FROM nation WHERE n_nationkey <> 4
        UNION ALL SELECT 'G' || (3000 + r_regionkey), r_name, NULL, 'group' FROM region""",
    "est_edges": """SELECT 'G' || (3000 + n_regionkey) AS group_sid, 'G' || (2000 + n_nationkey) AS member_sid FROM nation
        UNION ALL SELECT 'G' || (2000 + c_nationkey), 'U' || (10000 + c_custkey) FROM customer""",
    "est_members": """SELECT 'G' || (2000 + n_nationkey) AS group_sid, 'U' || (10000 + c_custkey) AS member_sid
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'G' || (3000 + n_regionkey), 'U' || (10000 + c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "est_audit": r"""SELECT event_id, ts AS "at", 'user' || user_id AS username,
        CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'download'
             WHEN 'error' THEN 'sign_in_failed' ELSE 'sign_in' END AS action,
        CASE WHEN event_type IN ('view', 'purchase') THEN '\\fs01\f' || (event_id % 50) END AS path,
        props AS detail, '10.0.' || (user_id % 256) || '.1' AS client_ip FROM events""",
    "est_listing": f"""SELECT share_id, fpath AS path, name, false AS is_dir, CASE WHEN file_id % 31 = 0 THEN size + 7 ELSE size END AS size,
        CASE WHEN file_id % 37 = 0 THEN mtime + INTERVAL 1 DAY WHEN file_id % 11 = 0 THEN mtime + INTERVAL 400 MILLISECOND ELSE mtime END AS mtime,
        false AS is_reparse_point FROM est_files WHERE file_id % 29 <> 0 AND NOT (share_id % 5 = 0 AND fpath LIKE '%/d3%')
        UNION ALL SELECT share_id, fpath, CASE WHEN file_id % 82 = 0 THEN '~$' || name ELSE 'copia ' || name END, false, size, mtime, file_id % 3 = 0
        FROM est_files WHERE file_id % 41 = 0
        UNION ALL SELECT share_id, {parent('path')}, name, true, 0, NULL, false FROM est_folders WHERE path <> '' AND NOT (share_id % 5 = 0 AND path LIKE '%/d3%')
        UNION ALL SELECT share_id, '', n, true, 0, NULL, n = 'enlace' FROM est_shares, (VALUES ('Nueva'), ('enlace')) v(n)
        UNION ALL SELECT share_id, '', 'THUMBS.DB', false, 10, NULL, false FROM est_shares""",
    "est_runs": """SELECT o_orderkey AS run_id, CAST(o_custkey % 20 AS INT) AS share_id,
        CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'partial' ELSE 'failed' END AS status, o_orderdate AS finished_at
        FROM orders WHERE CAST(o_custkey % 20 AS INT) IN (SELECT share_id FROM est_shares)""",
    # What the token of the checks may list and open.
    "listable": f"SELECT acl_id FROM ({masks('est_acl_entries', 'acl_id', 'sid IN ' + sids(TOKEN))}) WHERE mask & 1 = 1",
    "opening": f"SELECT acl_id FROM (" + masks("est_acl_entries", "acl_id", "sid IN " + sids(TOKEN),
                                               "(flags & 1) = 1 AND sid NOT IN ('S-1-3-0', 'S-1-3-1')") + ") WHERE mask & 1 = 1",
    "pairs": """SELECT DISTINCT f.acl_id AS file_acl, d.acl_id AS folder_acl, f.share_id FROM est_files f
        JOIN est_folders d USING (folder_id) WHERE f.acl_id IS NOT NULL AND d.acl_id IS NOT NULL""",
    "pair_entries": """SELECT file_acl, folder_acl, position, sid, ace_type, mask, flags FROM (SELECT DISTINCT file_acl, folder_acl FROM pairs) p
        JOIN est_acl_entries e ON e.acl_id = file_acl
        UNION ALL SELECT file_acl, folder_acl, 1000 + position, sid, ace_type, mask, (flags & 7) | 16 FROM (SELECT DISTINCT file_acl, folder_acl FROM pairs) p
        JOIN est_acl_entries e ON e.acl_id = folder_acl WHERE file_acl <> 7 AND (flags & 1) = 1 AND sid NOT IN ('S-1-3-0', 'S-1-3-1')""",
    "open_pairs": f"SELECT file_acl, folder_acl FROM ({masks('pair_entries', 'file_acl, folder_acl', 'sid IN ' + sids(TOKEN))}) WHERE mask & 1 = 1",
    "visible": """SELECT f.*, d.path AS folder_path, d.acl_id AS folder_acl FROM est_files f JOIN est_folders d USING (folder_id)
        WHERE (f.acl_id IS NULL AND d.acl_id IN (SELECT acl_id FROM opening))
           OR (f.acl_id, d.acl_id) IN (SELECT (file_acl, folder_acl) FROM open_pairs)""",
    "found": """SELECT v.*, s.name AS share, s.path AS share_path FROM visible v JOIN est_shares s ON s.share_id = v.share_id AND s.enabled""",
    # Placement and counts of folders under a plan.
    "placed": f"""SELECT d.share_id, d.folder_id, d.path, d.list_error,
        CASE WHEN p.path_key = lower(d.path) THEN 'planned' WHEN p.allow_subfolders THEN 'free' ELSE 'outside' END AS status,
        p.path AS entry_path, p.path_key AS entry_key, p.allow_files, p.naming_pattern, p.regex, p.extensions, p.max_files
        FROM est_folders d LEFT JOIN LATERAL (SELECT * FROM est_plan p WHERE p.share_id = d.share_id
            AND (lower(d.path) = p.path_key OR p.path_key = '' OR starts_with(lower(d.path), p.path_key || '/'))
            ORDER BY length(p.path_key) DESC LIMIT 1) p ON true
        WHERE d.share_id IN (SELECT share_id FROM est_plan)""",
    "counted": """SELECT d.folder_id, (SELECT count(*) FROM est_files f WHERE f.folder_id = d.folder_id) AS direct,
        (SELECT count(*) FROM est_files f WHERE f.share_id = d.share_id AND (d.path = '' OR f.fpath = d.path OR starts_with(f.fpath, d.path || '/'))) AS subtree,
        EXISTS (SELECT 1 FROM est_folders u WHERE u.share_id = d.share_id AND u.list_error IS NOT NULL
                AND (d.path = '' OR u.path = d.path OR starts_with(u.path, d.path || '/'))) AS unknown FROM est_folders d""",
    "facts": "SELECT * FROM placed JOIN counted USING (folder_id)",
    "governed": f"""SELECT f.file_id, f.name, f.extension, f.folder_id, a.share_id, a.path, a.entry_path, a.naming_pattern, a.extensions,
        a.naming_pattern IS NOT NULL AS checked,
        a.naming_pattern IS NOT NULL AND NOT regexp_matches({fold('(' + stem('f.name') + ')')}, a.regex) AS misnamed,
        len(a.extensions) > 0 AND NOT list_contains(a.extensions, f.extension) AS wrong_type
        FROM est_files f JOIN facts a USING (folder_id)
        WHERE (a.status = 'free' OR (a.status = 'planned' AND a.allow_files)) AND (a.naming_pattern IS NOT NULL OR len(a.extensions) > 0)""",
    "missing": """SELECT p.share_id, p.path, p.path_key FROM est_plan p
        WHERE NOT EXISTS (SELECT 1 FROM est_folders d WHERE d.share_id = p.share_id AND lower(d.path) = p.path_key)
        AND (SELECT arg_max(struct_pack(e := d.list_error), length(d.path)) FROM est_folders d WHERE d.share_id = p.share_id
             AND (d.path = '' OR starts_with(p.path_key, lower(d.path) || '/'))).e IS NULL""",
    # Copies: hashes of the texts of files whose size is not unique.
    "sized": "SELECT f.*, octet_length(encode(content)) AS bytes FROM est_files f",
    "hashed": """SELECT *, sha256(content) AS content_hash FROM sized
        WHERE bytes IN (SELECT bytes FROM sized WHERE bytes >= 1024 GROUP BY bytes HAVING count(*) > 1)""",
}
_NAMES = re.compile(r"\b(" + "|".join(TABLES) + r")\b")


def with_tables(sql: str) -> str:
    """The statement with the derived tables it needs, in dependency order."""
    order: list[str] = []

    def need(text: str, own: str | None = None) -> None:
        for name in dict.fromkeys(_NAMES.findall(text)):
            if name != own and name not in order:
                need(TABLES[name], name)
                order.append(name)

    need(sql)
    # Materialised, or nested views would be expanded many times over.
    head = ",\n".join(f"{name} AS MATERIALIZED ({TABLES[name]})" for name in order)
    if not head:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
