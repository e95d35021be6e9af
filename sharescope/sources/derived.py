"""A document estate derived from general-purpose tables, by row arithmetic only.

Documents become files, their sources become shares, customers and their nations become
accounts and groups, events become the audit log. Everything is a projection of the input
(folders and shares also need a distinct), so the estate grows with the tables it is read from.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aces as A
from ..functions import paths as P
from ..operators.common import inline_rows

# Folder ACLs 1-6 and file ACLs 7-8 as (acl, position, sid, type, mask, flags).
ACL_ROWS = [
    (1, 0, "S-1-1-0", "allow", 1179785, 3),
    (2, 0, "G2001", "allow", 1179785, 3),
    (3, 0, "U10005", "deny", 1179785, 3), (3, 1, "G2002", "allow", 1179785, 3),
    (4, 0, "S-1-1-0", "allow", 1179785, 0), (4, 1, "G2003", "allow", 1179785, 3),
    (5, 0, "G2004", "allow", 1179785, 9),
    (6, 0, "G3001", "allow", 1245631, 3), (6, 1, "S-1-3-0", "allow", 2032127, 11),
    (7, 0, "G2001", "allow", 1179785, 0),
    (8, 0, "U10005", "deny", 1179785, 0),
]
PROTECTED_ACLS = (3, 7)

# Planned folders of every share that has a plan, as (path, allow_files, allow_subfolders,
# naming_pattern, extensions, max_files, purpose, examples, keywords).
PLAN_ROWS = [
    ("", False, False, None, "", None, "Raíz del recurso", "", ""),
    ("EN", False, False, None, "", None, "English documents", "", "english"),
    ("EN/d0", True, False, "{YYYY}-{N} *", "pdf,docx", None, "Informes anuales", "2020-3 Informe.pdf,mal.pdf,2021-4 Hoja.xlsx", "informe,anual"),
    ("EN/d1", True, True, "nota {N}", "", None, "Notas sueltas", "nota 12.txt", "nota"),
    ("EN/d2", True, True, None, "pdf,docx,xlsx,txt,html", 3, "Varios", "", ""),
    ("es", True, True, None, "", None, "Documentación en español", "", "español"),
    ("fr", False, True, "{YYYY}-* Informe", "", None, "Documents français", "2019-8 informe.pdf", ""),
    ("Archivo", True, False, None, "", None, "Archivo histórico", "", "archivo"),
    ("Archivo/2020", True, False, None, "", None, "Año 2020", "", ""),
    ("Archivo/2021", True, False, None, "", None, "Año 2021", "", ""),
    ("Archivo/2020/Enero", True, False, None, "", None, "Enero de 2020", "", ""),
    ("Actas", True, False, "{YYYY}-{MM}-{DD} *", "pdf", None, "Actas de reuniones", "2025-03-14 Acta.pdf,acta 3.pdf", "acta,reunión"),
]

AS_OF = "2024-01-01 00:00:00"

_FILES = """
SELECT doc_id AS file_id, share_id, concat(share_id, ':', fpath) AS folder_id, fpath,
       concat(CASE WHEN doc_id % 3 = 0 THEN concat(2010 + doc_id % 15, '-', doc_id, ' Informe')
                   ELSE concat('nota ', doc_id) END,
              CASE WHEN ext = '' THEN '' ELSE concat('.', ext) END) AS name,
       ext AS extension, n_chars AS size,
       CASE WHEN doc_id % 97 = 0 THEN NULL
            ELSE CAST(date_sub(DATE '2024-01-01', CAST((doc_id * 37) % 5000 AS INT)) AS TIMESTAMP_NTZ) END AS mtime,
       CASE WHEN doc_id % 83 = 0 THEN 7 WHEN doc_id % 79 = 0 THEN 8 END AS acl_id,
       text AS content
FROM (SELECT doc_id, n_chars, text, CAST(substr(source, 4) AS INT) AS share_id,
        CASE WHEN doc_id % 40 = 1 THEN ''
             ELSE concat(lang, '/d', doc_id % 7, CASE WHEN doc_id % 2 = 0 THEN concat('/s', doc_id % 3) ELSE '' END,
                         CASE WHEN doc_id % 50 = 0 THEN '/x1/x2/x3/x4/x5/x6/x7' ELSE '' END) END AS fpath,
        CASE doc_id % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'txt'
                        WHEN 4 THEN 'html' WHEN 5 THEN 'dwg' WHEN 6 THEN 'zip' ELSE '' END AS ext
      FROM {documents})
"""


@dataclass
class Estate:
    """Lazily derived tables of one data folder."""

    spark: SparkSession
    folder: str
    as_of: str = AS_OF
    _views: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def shares(self) -> DataFrame:
        share_id = F.expr("CAST(substr(source, 4) AS INT)")
        return (self.table("documents").select("source").distinct()
                .select(share_id.alias("share_id"), F.col("source").alias("name"),
                        F.concat(F.lit("\\\\fs01\\"), "source").alias("path"),
                        (share_id % 10 != 9).alias("enabled")))

    @cached_property
    def files(self) -> DataFrame:
        """Catalogue rows plus each file's text; columns nobody asks for are pruned at the scan."""
        return self.spark.sql(_FILES, documents=self.table("documents"))

    @cached_property
    def folders(self) -> DataFrame:
        used = (self.files.select("share_id", "fpath").distinct()
                .select("share_id", F.explode(P.ancestors(F.col("fpath"))).alias("path")))
        fixed = self.shares.select("share_id", F.explode(F.array(F.lit("Archivo"), F.lit("Archivo/2020"))).alias("path"))
        path, share = F.col("path"), F.col("share_id")
        code = share + F.length(path)
        return (used.unionByName(fixed).distinct()
                .select("share_id", F.concat_ws(":", share, path).alias("folder_id"), "path",
                        P.base_name(path).alias("name"), P.depth(path).alias("depth"),
                        F.when(code % 11 != 10, 1 + code % 6).alias("acl_id"),
                        F.concat(F.lit("U"), (10000 + code % 7).cast("string")).alias("owner_sid"),
                        F.when((code % 11 == 10) & (code % 2 == 0), "DescriptorError: ACL truncated").alias("acl_error"),
                        F.when((path == "Archivo/2020") & (share % 6 == 0), "Access denied").alias("list_error")))

    @cached_property
    def acl_entries(self) -> DataFrame:
        rows = inline_rows(ACL_ROWS, ["acl_id", "position", "sid", "ace_type", "mask", "flags"])
        return self.spark.sql(f"SELECT acl_id, position, sid, ace_type, CAST(mask AS BIGINT) AS mask, flags "
                              f"FROM (SELECT {rows})")

    @cached_property
    def acls(self) -> DataFrame:
        """One row per distinct ACL with its entries in order (at most 64 KiB each)."""
        return (self.acl_entries.groupBy("acl_id")
                .agg(A.ordered(F.collect_list(F.struct("position", "sid", "ace_type", "mask", "flags"))).alias("aces"))
                .select("acl_id", F.col("acl_id").isin(*PROTECTED_ACLS).alias("is_protected"),
                        F.lit(False).alias("is_null_dacl"),
                        F.exists("aces", lambda a: ~A.has(a["flags"], 0x10)).alias("has_explicit"), "aces"))

    @cached_property
    def documents(self) -> DataFrame:
        """Index state of every file."""
        return (self.files
                .select("file_id", "content", F.expr(
                    "CASE WHEN file_id % 13 = 0 THEN 'error' WHEN file_id % 17 = 0 THEN 'pending' "
                    "WHEN file_id % 19 = 0 THEN 'extracting' WHEN file_id % 23 = 0 THEN 'ocr_unavailable' "
                    "WHEN file_id % 8 IN (5, 6, 7) THEN 'metadata' ELSE 'text' END").alias("status"),
                    F.expr("CASE WHEN file_id % 13 = 0 THEN 'cannot read' END").alias("error")))

    @cached_property
    def some_documents(self) -> DataFrame:
        """The index before its metadata pass, which has to add what is missing."""
        return self.documents.filter("file_id % 3 <> 2")

    @cached_property
    def plan(self) -> DataFrame:
        names = ["path", "allow_files", "allow_subfolders", "naming_pattern", "extensions", "max_files", "purpose",
                 "examples", "keywords"]
        rows = inline_rows(PLAN_ROWS, names)
        as_list = lambda c: F.filter(F.split(c, ","), lambda v: v != "").alias(c)
        return (self.shares.filter("share_id % 7 <> 6").selectExpr("share_id", rows)
                .select("share_id", "path", P.path_key(F.col("path")).alias("path_key"), "purpose",
                        F.lit("").alias("belongs"), F.lit("").alias("not_belongs"), F.lit("").alias("owner"),
                        F.lit("").alias("naming"), "naming_pattern", as_list("examples"), as_list("extensions"),
                        as_list("keywords"), "allow_files", "allow_subfolders", "max_files"))

    @cached_property
    def principals(self) -> DataFrame:
        users = self.table("customer").select(
            F.expr("concat('U', 10000 + c_custkey)").alias("sid"), F.col("c_name").alias("name"),
            F.expr("CASE WHEN c_custkey % 3 = 0 THEN concat('Customer ', c_custkey) END").alias("display_name"),
            F.lit("user").alias("kind"))
        nations = self.table("nation").filter("n_nationkey <> 4").select(
            F.expr("concat('G', 2000 + n_nationkey)").alias("sid"), F.col("n_name").alias("name"),
            F.lit(None).cast("string").alias("display_name"), F.lit("group").alias("kind"))
        regions = self.table("region").select(
            F.expr("concat('G', 3000 + r_regionkey)").alias("sid"), F.col("r_name").alias("name"),
            F.lit(None).cast("string").alias("display_name"), F.lit("group").alias("kind"))
        return users.unionByName(nations).unionByName(regions)

    @cached_property
    def edges(self) -> DataFrame:
        """Direct membership: regions hold nations, nations hold customers."""
        upper = self.table("nation").select(F.expr("concat('G', 3000 + n_regionkey)").alias("group_sid"),
                                            F.expr("concat('G', 2000 + n_nationkey)").alias("member_sid"))
        lower = self.table("customer").select(F.expr("concat('G', 2000 + c_nationkey)").alias("group_sid"),
                                              F.expr("concat('U', 10000 + c_custkey)").alias("member_sid"))
        return upper.unionByName(lower)

    @cached_property
    def members(self) -> DataFrame:
        """Transitive user members, flattened by one join because the nesting is two deep."""
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        return joined.select(
            F.explode(F.expr("array(concat('G', 2000 + n_nationkey), concat('G', 3000 + n_regionkey))")).alias("group_sid"),
            F.expr("concat('U', 10000 + c_custkey)").alias("member_sid"))

    @cached_property
    def audit(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.col("ts").alias("at"), F.expr("concat('user', user_id)").alias("username"),
            F.expr("CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'download' "
                   "WHEN 'error' THEN 'sign_in_failed' ELSE 'sign_in' END").alias("action"),
            F.expr("CASE WHEN event_type IN ('view', 'purchase') THEN concat('\\\\\\\\fs01\\\\f', event_id % 50) END").alias("path"),
            F.col("props").alias("detail"),
            F.expr("concat('10.0.', user_id % 256, '.1')").alias("client_ip"))

    @cached_property
    def listing(self) -> DataFrame:
        """A later listing of the same shares: files gone, resized, touched, added, and some noise."""
        kept = self.files.filter("file_id % 29 <> 0 AND NOT (share_id % 5 = 0 AND fpath LIKE '%/d3%')").select(
            "share_id", F.col("fpath").alias("path"), "name", F.lit(False).alias("is_dir"),
            F.expr("CASE WHEN file_id % 31 = 0 THEN size + 7 ELSE size END").alias("size"),
            F.expr("CASE WHEN file_id % 37 = 0 THEN mtime + INTERVAL '1' DAY "
                   "WHEN file_id % 11 = 0 THEN mtime + INTERVAL '0.4' SECOND ELSE mtime END").alias("mtime"),
            F.lit(False).alias("is_reparse_point"))
        added = self.files.filter("file_id % 41 = 0").select(
            "share_id", F.col("fpath").alias("path"),
            F.expr("CASE WHEN file_id % 82 = 0 THEN concat('~$', name) ELSE concat('copia ', name) END").alias("name"),
            F.lit(False).alias("is_dir"), "size", "mtime", F.expr("file_id % 3 = 0").alias("is_reparse_point"))
        folders = self.folders.filter("path <> '' AND NOT (share_id % 5 = 0 AND path LIKE '%/d3%')").select(
            "share_id", P.parent(F.col("path")).alias("path"), "name", F.lit(True).alias("is_dir"),
            F.lit(0).cast("long").alias("size"), F.lit(None).cast("timestamp_ntz").alias("mtime"),
            F.lit(False).alias("is_reparse_point"))
        extra = self.shares.select(
            "share_id", F.lit("").alias("path"), F.explode(F.array(F.lit("Nueva"), F.lit("enlace"))).alias("name"),
            F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"),
            F.lit(None).cast("timestamp_ntz").alias("mtime"))
        extra = extra.withColumn("is_reparse_point", F.col("name") == "enlace")
        noise = self.shares.select(
            "share_id", F.lit("").alias("path"), F.lit("THUMBS.DB").alias("name"), F.lit(False).alias("is_dir"),
            F.lit(10).cast("long").alias("size"), F.lit(None).cast("timestamp_ntz").alias("mtime"),
            F.lit(False).alias("is_reparse_point"))
        return kept.unionByName(added).unionByName(folders).unionByName(extra).unionByName(noise)

    @cached_property
    def scan_runs(self) -> DataFrame:
        """Past runs, from orders: one run per order of a customer whose number names a share."""
        shares = self.shares.select("share_id")
        return (self.table("orders").select(
                    F.col("o_orderkey").alias("run_id"), F.expr("CAST(o_custkey % 20 AS INT)").alias("share_id"),
                    F.expr("CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'partial' ELSE 'failed' END").alias("status"),
                    F.col("o_orderdate").alias("finished_at"))
                .join(shares, "share_id", "left_semi"))
