"""Table schemas and the constants that are part of the results."""

from __future__ import annotations

# Limits and defaults that change what a query returns.
COUNT_CAP = 1_000
MAX_FILES_LISTED = 1_000
EXCERPT_CHARS = 5_000
LONG_PATH_LIMIT = 240
DEEP_FOLDER_LIMIT = 8
DEFAULT_MAX_FILES = 500
HISTORY_DAYS = 400
HASH_CHUNK = 64 * 1024
DEDUPE_MIN_SIZE = 1_024
FULL_HASH_MAX_SIZE = 512 * 1024 * 1024
EXTRACT_MAX_SIZE = 50 * 1024 * 1024
EXTRACT_MAX_CHARS = 200_000
AUDIT_RETENTION_DAYS = 365
LOGIN_MAX_FAILURES = 3
LOGIN_WINDOW_MINUTES = 30
PRINCIPAL_REFRESH_DAYS = 1
MAX_ERROR_SAMPLE = 20
EXTENSION_LENGTH = 32

# Names never catalogued (compared without case) and lock-file prefixes.
IGNORED_NAMES = [
    "Thumbs.db", "desktop.ini", ".DS_Store", "$RECYCLE.BIN",
    "System Volume Information", "DfsrPrivate", "~snapshot",
]
IGNORED_PREFIXES = ["~$"]

# Age classes, as (label, years).
AGE_CLASSES = [("< 1 year", 1), ("1-3 years", 3), ("3-5 years", 5), ("5-10 years", 10)]
AGE_OLDER = "> 10 years"
AGE_UNKNOWN = "unknown"

# Type filter key -> label and extensions; everything else is "other".
TYPE_GROUPS = {
    "pdf": ("PDF", ["pdf"]),
    "word": ("Word", ["doc", "docx", "docm", "dot", "dotx", "odt", "rtf"]),
    "excel": ("Excel", ["xls", "xlsx", "xlsm", "xlsb", "xltx", "csv", "ods"]),
    "powerpoint": ("PowerPoint", ["ppt", "pptx", "pptm", "pps", "ppsx", "odp"]),
    "text": ("Text", ["txt", "md", "log", "json", "xml", "html", "htm"]),
    "email": ("Email", ["msg", "eml"]),
    "image": ("Images", ["jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp", "heic"]),
    "cad": ("CAD", ["dwg", "dxf", "dgn", "step", "stp", "ifc"]),
    "archive": ("Archives", ["zip", "rar", "7z", "tar", "gz"]),
    "media": ("Audio & video", ["mp3", "wav", "m4a", "mp4", "avi", "mov", "mkv", "wmv"]),
}

# Extensions whose text can be read.
PLAIN_TEXT = ["txt", "csv", "tsv", "md", "log", "json", "xml", "html", "htm", "ini", "cfg", "sql", "yml", "yaml"]
WORD_FILES = ["docx", "docm", "dotx", "dotm"]
SHEET_FILES = ["xlsx", "xlsm", "xltx", "xltm"]
SLIDE_FILES = ["pptx", "pptm", "ppsx", "ppsm", "potx"]
OPEN_DOCUMENT_FILES = ["odt", "ods", "odp"]
EXTRACTABLE = PLAIN_TEXT + WORD_FILES + SHEET_FILES + SLIDE_FILES + OPEN_DOCUMENT_FILES + ["pdf"]

# Access masks, ACE flags and well-known identities.
READ_DATA = 0x1
WRITE_DATA = 0x2
DELETE = 0x10000
GENERIC_READ, GENERIC_WRITE, GENERIC_EXECUTE, GENERIC_ALL = 0x80000000, 0x40000000, 0x20000000, 0x10000000
FILE_READ, FILE_WRITE, FILE_EXECUTE, FULL_ACCESS = 0x00120089, 0x00120116, 0x001200A0, 0x001F01FF
OBJECT_INHERIT, CONTAINER_INHERIT, INHERIT_ONLY, INHERITED = 0x01, 0x02, 0x08, 0x10
EVERYONE = "S-1-1-0"
CREATOR_SIDS = ["S-1-3-0", "S-1-3-1"]
BASELINE_SIDS = ["S-1-1-0", "S-1-5-11", "S-1-5-2"]
EXTRA_BASELINE_SIDS = ["S-1-5-32-545"]
DOMAIN_USERS_RID = "513"
DEMO_DOMAIN = "S-1-5-21-999-999-999"

# Identities named without a directory.
WELL_KNOWN = {
    "S-1-1-0": "Everyone",
    "S-1-3-0": "CREATOR OWNER",
    "S-1-3-1": "CREATOR GROUP",
    "S-1-3-4": "OWNER RIGHTS",
    "S-1-5-2": "NETWORK",
    "S-1-5-4": "INTERACTIVE",
    "S-1-5-9": "Enterprise Domain Controllers",
    "S-1-5-11": "Authenticated Users",
    "S-1-5-18": "SYSTEM",
    "S-1-5-32-544": "BUILTIN\\Administrators",
    "S-1-5-32-545": "BUILTIN\\Users",
    "S-1-5-32-547": "BUILTIN\\Power Users",
    "S-1-5-32-549": "BUILTIN\\Server Operators",
    "S-1-5-32-551": "BUILTIN\\Backup Operators",
}

ACE = "struct<position:int,sid:string,ace_type:string,mask:bigint,flags:int>"

# Catalogue tables as DDL, for readers that must not infer.
TABLES: dict[str, str] = {
    "shares": "share_id int, name string, path string, enabled boolean",
    "scan_runs": ("run_id bigint, share_id int, status string, finished_at timestamp_ntz, folders_seen bigint, "
        "folders_skipped bigint, files_seen bigint, files_added bigint, files_updated bigint, "
        "files_removed bigint, error_count bigint, error_sample string"),
    "acls": f"acl_id string, is_protected boolean, is_null_dacl boolean, has_explicit boolean, aces array<{ACE}>",
    "folders": ("share_id int, folder_id string, path string, name string, depth bigint, acl_id string, owner_sid string, "
        "mtime timestamp_ntz, acl_error string, list_error string"),
    "files": ("file_id bigint, share_id int, folder_id string, name string, extension string, size bigint, "
        "mtime timestamp_ntz, ctime timestamp_ntz, quick_hash string, content_hash string, "
        "indexed_at timestamp_ntz, acl_id string"),
    "principals": "sid string, name string, display_name string, kind string, dn string, resolved_at timestamp_ntz",
    "group_members": "group_sid string, member_sid string",
    "documents": "file_id bigint, status string, content string, error string, extracted_at timestamp_ntz",
    "plan": ("share_id int, path string, path_key string, purpose string, belongs string, not_belongs string, "
        "owner string, naming string, naming_pattern string, examples array<string>, extensions array<string>, "
        "keywords array<string>, allow_files boolean, allow_subfolders boolean, max_files int, "
        "updated_at timestamp_ntz, updated_by string"),
    "plan_snapshots": ("share_id int, day date, taken_at timestamp_ntz, files_total bigint, files_in_plan bigint, "
        "files_checked bigint, files_misnamed bigint, files_wrong_type bigint, folders_planned bigint, "
        "folders_missing bigint, folders_empty bigint, folders_overgrown bigint"),
    "audit_events": ("event_id bigint, at timestamp_ntz, username string, action string, file_id bigint, path string, "
        "detail string, client_ip string"),
    "users": "user_id bigint, username string, last_login timestamp_ntz",
    "sessions": "session_id bigint, user_id bigint, token_sids array<string>, expires_at timestamp_ntz",
    "listing": ("share_id int, path string, name string, is_dir boolean, size bigint, mtime timestamp_ntz, "
        "ctime timestamp_ntz, is_reparse_point boolean"),
}
