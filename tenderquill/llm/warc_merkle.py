"""Merkle fixity audit of replicated WARC files.

A record is a leaf: (file, offset, length, sha256 of its bytes). Records that
start within one 64 KiB offset range form a range node, 16 neighbouring ranges a
node of the next level, and so on up to one root for each file; a node's hash is
the sha256 of its children's positions and hashes in offset order. Ranges are
fixed offsets, so a lost record doesn't shift its neighbours. Roots of two
replicas are compared first; each level down takes only the children of nodes
that differ, until single records are left. The nodes that differ are written at
each level, and the descent stops where there are none.

A range holds at most the records that start in 64 KiB and a node 16 children;
the root takes all nodes of the last level below it, one for each 4 GiB of a
file. So no group grows with the number of files, and the root's with the length
of its one file only. Record payloads are hashed where they are read and never
moved.

Defined cases: a null payload hashes as empty bytes; null files form a file of
their own and null offsets count as 0; several records at one offset are
compared as the sorted list of their hashes; a file or record that one replica
lacks is reported as missing or extra; empty replicas give no rows; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize, table

RANGE_BYTES, FAN_OUT, LEVELS = 1 << 16, 16, 5


def leaves(records: DataFrame, file_col: str = "file", offset_col: str = "offset", digest: Column | None = None, length: Column | None = None) -> DataFrame:
    """file, offset, length, hash: one row for each offset; digest defaults to the sha256 of column payload."""
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary")) if digest is None else None
    rows = records.select(
        F.coalesce(F.col(file_col).cast("string"), F.lit("")).alias("file"),
        F.coalesce(F.col(offset_col).cast("long"), F.lit(0)).alias("offset"),
        (F.octet_length(payload).cast("long") if length is None else length).alias("length"),
        (F.sha2(payload, 256) if digest is None else digest).alias("hash"),
    )
    return rows.groupBy("file", "offset").agg(
        F.max("length").alias("length"),
        F.when(F.count("*") == 1, F.min("hash")).otherwise(F.sha2(F.array_join(F.sort_array(F.collect_list("hash")), ","), 256)).alias("hash"),
    )


def _parents(nodes: DataFrame, position: Column) -> DataFrame:
    """Nodes (file, pos, hash) over children whose place is position."""
    child = F.struct(F.col("pos"), F.col("hash"))
    listed = F.sort_array(F.collect_list(child))
    text = F.array_join(F.transform(listed, lambda c: F.concat_ws(":", c["pos"].cast("string"), c["hash"])), ",")
    return nodes.groupBy("file", position.alias("parent")).agg(F.sha2(text, 256).alias("hash")).withColumnRenamed("parent", "pos")


def trees(leaf: DataFrame) -> list[DataFrame]:
    """Levels of the trees, leaves' ranges first, roots last; each is written once."""
    levels, nodes = [], _parents(leaf.withColumnRenamed("offset", "pos"), F.floor(F.col("pos") / RANGE_BYTES))
    for k in range(LEVELS):
        if k:
            whole = k == LEVELS - 1
            nodes = _parents(nodes, F.lit(0).cast("long") if whole else F.floor(F.col("pos") / FAN_OUT))
        nodes = materialize(nodes, f"merkle-{k}")
        levels.append(nodes)
    return levels


def _differing(x: DataFrame, y: DataFrame, place: str) -> DataFrame:
    """Rows of a full join on file and place whose hashes differ, sides as x and y."""
    both = x.alias("x").join(y.alias("y"), ["file", place], "full_outer")
    return both.where(~F.col("x.hash").eqNullSafe(F.col("y.hash")))


def merkle_audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """file, offset, length, status (corrupt, missing, extra) of the records in which leaf tables differ."""
    a, b = trees(primary), trees(replica)
    wrong = None
    for k in reversed(range(LEVELS)):
        x, y = a[k], b[k]
        if wrong is not None:
            up = F.lit(0).cast("long") if k == LEVELS - 2 else F.floor(F.col("pos") / FAN_OUT)
            x, y = (n.withColumn("up", up).join(wrong, ["file", "up"], "left_semi").drop("up") for n in (x, y))
        wrong = materialize(_differing(x, y, "pos").select("file", F.col("pos").alias("up")), f"merkle-wrong-{k}")
        if not wrong.limit(1).count():
            break
    at = F.floor(F.col("offset") / RANGE_BYTES)
    x, y = (n.withColumn("up", at).join(wrong, ["file", "up"], "left_semi").drop("up") for n in (primary, replica))
    status = F.when(F.col("y.hash").isNull(), "missing").when(F.col("x.hash").isNull(), "extra").otherwise("corrupt")
    return _differing(x, y, "offset").select("file", "offset", F.coalesce("x.length", "y.length").alias("length"), status.alias("status"))


RECORDS_A_FILE = 1000


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A response record's bytes as a string."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def op7_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC files of 1,000 page ids each, against a replica with planted faults.

    In the replica, the record of a page with id mod 97 = 5 has its last byte
    changed and that of a page with id mod 1009 = 7 is lost. Pages without id
    are spread over files by their hash.
    """
    p = table(spark, sf_dir, "pages")
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = p.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.floor(F.col("page_id") / RECORDS_A_FILE), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(4096))).cast("long").alias("file"),
        record.alias("r"),
    ).select(
        "page_id",
        "file",
        F.octet_length("r").cast("long").alias("length"),
        F.sha2("r", 256).alias("hash"),
        F.when(F.col("page_id") % 97 == 5, F.sha2(F.concat(F.expr("left(r, length(r) - 1)"), F.lit("?")), 256)).otherwise(F.sha2("r", 256)).alias("replica_hash"),
    )
    w = Window.partitionBy("file").orderBy("page_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = materialize(rows.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0))), "warc-records")
    primary = leaves(rows, digest=F.col("hash"), length=F.col("length"))
    replica = leaves(rows.where("page_id IS NULL OR page_id % 1009 <> 7"), digest=F.col("replica_hash"), length=F.col("length"))
    bad = merkle_audit(primary, replica)
    ids = rows.select(F.col("file").cast("string").alias("file"), "offset", "page_id")
    return bad.join(ids, ["file", "offset"]).select("page_id", "file", "offset", "length", "status")


OP7_SQL = f"""
WITH r AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, CAST(floor(page_id / {RECORDS_A_FILE}) AS BIGINT) AS file,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r
  FROM pages WHERE page_id IS NOT NULL
), o AS (
  SELECT page_id, file, CAST(strlen(r) AS BIGINT) AS length,
    CAST(coalesce(sum(strlen(r)) OVER (PARTITION BY file ORDER BY page_id, sha256(r) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM r
)
SELECT page_id, CAST(file AS VARCHAR) AS file, "offset", length, CASE WHEN page_id % 1009 = 7 THEN 'missing' ELSE 'corrupt' END AS status
FROM o WHERE page_id % 97 = 5 OR page_id % 1009 = 7
"""
