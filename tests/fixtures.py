"""Small estates used by several tests."""

from pyspark.sql import functions as F

from sharescope.functions import paths as P
from sharescope.operators.permissions import acl_arrays

READ, MODIFY, FULL = 0x00120089, 0x001301BF, 0x001F01FF
EVERYONE, ALICE, BOB, CAROL, FINANCE, HR = "S-1-1-0", "ALICE", "BOB", "CAROL", "FINANCE", "HR"


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def folders_of(spark, rows, share_id=1):
    """rows: (path, acl_id[, list_error])."""
    data = [(share_id, f"{share_id}:{r[0]}", r[0], r[0].rsplit("/", 1)[-1], r[1], r[2] if len(r) > 2 else None) for r in rows]
    out = frame(spark, data, "share_id int, folder_id string, path string, name string, acl_id string, list_error string")
    return out.withColumn("depth", P.depth(F.col("path"))).withColumn("acl_error", F.lit(None).cast("string"))


def files_of(spark, rows, share_id=1):
    """rows: (id, folder path, name[, acl_id])."""
    data = [(r[0], share_id, f"{share_id}:{r[1]}", r[2], r[2].rpartition(".")[2].lower() if "." in r[2] else "", 100 + r[0],
             r[3] if len(r) > 3 else None) for r in rows]
    out = frame(spark, data, "file_id bigint, share_id int, folder_id string, name string, extension string, size bigint, acl_id string")
    return out.withColumn("mtime", F.expr("timestampadd(DAY, CAST(file_id AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')"))


def acls_of(spark, entries, protected=()):
    """entries: (acl_id, sid, type, mask, flags) in order."""
    rows, seen = [], {}
    for acl, sid, kind, mask, flags in entries:
        rows.append((acl, seen.setdefault(acl, 0), sid, kind, mask, flags))
        seen[acl] += 1
    flat = frame(spark, rows, "acl_id string, position int, sid string, ace_type string, mask bigint, flags int")
    return (acl_arrays(flat).withColumn("is_protected", F.col("acl_id").isin(*protected) if protected else F.lit(False))
            .withColumn("is_null_dacl", F.lit(False))
            .withColumn("has_explicit", F.exists("aces", lambda a: a["flags"].bitwiseAND(F.lit(16)) == 0)))


def shares_of(spark, *rows):
    return frame(spark, rows or [(1, "Docs", r"\\fs01\Docs", True)], "share_id int, name string, path string, enabled boolean")
