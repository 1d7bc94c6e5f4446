"""Merkle fixity audit of WARC records.

Pages become WARC records; records lie in archive files in the order of their
ids, at offsets summed within the file. Each replica has a tree of its own, made
from its own records and offsets: digests of records are hashed together by
ordered offset ranges, ranges by groups of PARTS, those by file, files by groups
of FANOUT, up to a root. If roots differ, only children of nodes whose digests
differ are compared, level by level, down to the records of differing ranges.
There, equal records of an id match wherever they lie; of the others, the k-th
of an id in one replica is compared with the k-th in the other.

Defined results: null url and html count as empty; records with a null page_id
lie in files of negative numbers, by the first digits of their digests; rows
with one page_id are ordered by their digests, and running sums are split by
those digests' beginnings, so that a crowded id is no single task's; records that
only the copy has are reported as extra, without a place in the original; very
long pages are hashed whole; an empty table has no root, and two of them agree;
columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, md5_key, stored

#: Ids of one archive file, bytes of one offset range, children of a node within a file, children of a node of files.
FILE, RANGE, PARTS, FANOUT = 1024, 65_536, 1024, 16
#: Files of records without an id; their numbers are -1 to -UNNAMED.
UNNAMED = 4096


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC resource record as text; its length counts UTF-8 bytes."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def manifest(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) to a row per record: page_id, length, sha, file, offset (the sum of the lengths of earlier records of the file)."""
    r = pages.select(F.col("page_id").cast("long"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("r"))
    r = r.select("page_id", F.octet_length("r").cast("long").alias("length"), F.sha2(F.col("r").cast("binary"), 256).alias("sha"))
    digits = F.conv(F.substring("sha", 1, 3), 16, 10).cast("long")
    r = r.select("*", F.coalesce(F.floor(F.col("page_id") / FILE), -1 - digits).cast("long").alias("file"), F.struct("page_id", digits.alias("digits")).alias("part"))
    parts = r.groupBy("file", "part").agg(F.sum("length").alias("in_part"))
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file", "part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("file", "part").orderBy("sha").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("own", F.coalesce(F.sum("length").over(within), F.lit(0))).join(parts, ["file", "part"])
    return r.select("page_id", "length", "sha", "file", (F.col("before") + F.col("own")).cast("long").alias("offset"))


def _level(below: DataFrame, up_file: Column, up_node: Column, *order: str) -> DataFrame:
    """The parents of below (replica, file, node, sha): the digest of each one's children in order. Adds to below's rows nothing but reads them once."""
    children = F.array_sort(F.collect_list(F.struct(*order, "sha")))
    label = lambda x: F.concat_ws(":", *[x[c].cast("string") for c in order], x["sha"])
    hashed = F.sha2(F.array_join(F.transform(children, label), ",").cast("binary"), 256)
    return below.groupBy("replica", up_file.alias("up_file"), up_node.alias("up_node")).agg(hashed.alias("sha")).select("replica", F.col("up_file").alias("file"), F.col("up_node").alias("node"), "sha")


def _parents() -> list[tuple[Column, Column]]:
    """(file, node) of the parents of ranges, of their groups, and of the groups of those."""
    up = F.floor(F.col("node") / PARTS).cast("long")
    return [(F.col("file"), up), (F.col("file"), up), (F.col("file"), F.lit(0).cast("long"))]


def trees(*replicas: DataFrame) -> tuple[DataFrame, list[tuple[DataFrame, Column, Column]]]:
    """Records of all replicas (replica, page_id, length, sha, file from 0, offset, node: the range), and the levels of their trees from the ranges up, each with its parents' columns. The last level has a row per replica that has records."""
    leaves = None
    for k, pages in enumerate(replicas):
        one = manifest(pages).select(F.lit(k).alias("replica"), "page_id", "length", "sha", (F.col("file") + UNNAMED).alias("file"), "offset", F.floor(F.col("offset") / RANGE).cast("long").alias("node"))
        leaves = one if leaves is None else leaves.unionByName(one)
    leaves = stored(leaves)
    now = stored(_level(leaves, F.col("file"), F.col("node"), "offset"))
    levels, high = [], now.agg(F.max("file")).first()[0]
    for up_file, up_node in _parents():
        levels.append((now, up_file, up_node))
        now = stored(_level(now, up_file, up_node, "file", "node"))
    while high:
        up_file, high = F.floor(F.col("file") / FANOUT).cast("long"), high // FANOUT
        levels.append((now, up_file, F.col("node")))
        now = stored(_level(now, up_file, F.col("node"), "file", "node"))
    levels.append((now, None, None))
    return leaves, levels


def root(pages: DataFrame) -> str | None:
    """The root of a replica's tree; None for an empty table."""
    leaves, levels = trees(pages)
    top = levels[-1][0].first()
    for df in (leaves, *(x[0] for x in levels)):
        dropped(df)
    return top["sha"] if top else None


def _differing(level: DataFrame) -> DataFrame:
    """(file, node) of the nodes that the two replicas' trees have different digests of, or that one of them lacks."""
    of = lambda k: F.max(F.when(F.col("replica") == k, F.col("sha")))
    return level.groupBy("file", "node").agg(of(0).alias("a"), of(1).alias("b")).filter(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node")


def descend(levels: list[tuple[DataFrame, Column, Column]]) -> tuple[DataFrame, list[DataFrame]]:
    """The differing ranges of two replicas' trees, and what each level compares: from the root down, the children of differing nodes only."""
    compared = [levels[-1][0]]
    bad = _differing(compared[0])
    for level, up_file, up_node in levels[-2::-1]:
        parents = bad.select(F.col("file").alias("up_file"), F.col("node").alias("up_node"))
        children = level.select("*", up_file.alias("up_file"), up_node.alias("up_node")).join(parents, ["up_file", "up_node"], "left_semi")
        compared.append(children)
        bad = _differing(children)
    return bad, compared


def audit(original: DataFrame, copy: DataFrame) -> DataFrame:
    """Where copy differs from original: page_id, file, offset, length, damage (corrupt, missing, extra), original_sha256, copy_sha256."""
    leaves, levels = trees(original, copy)
    bad, _ = descend(levels)
    rows = leaves.join(bad, ["file", "node"], "left_semi")
    rows = rows.select("*", F.struct("page_id", "sha").alias("same"), F.struct("page_id").alias("id"))
    # of equal records of an id, as many as both have match; what one has more of is left
    many = rows.groupBy("same").agg(*[F.count(F.when(F.col("replica") == k, 1)).alias(f"n{k}") for k in (0, 1)])
    odd = rows.join(many.filter("n0 <> n1"), "same")
    odd = odd.withColumn("k", F.row_number().over(Window.partitionBy("replica", "same").orderBy("offset"))).filter(F.col("k") > F.least("n0", "n1"))
    # the k-th one left of an id, in each replica
    odd = odd.withColumn("k", F.row_number().over(Window.partitionBy("replica", "id").orderBy("sha", "offset")))
    mine = lambda c: F.max(F.when(F.col("replica") == 0, F.col(c)))
    other = lambda c: F.max(F.when(F.col("replica") == 1, F.col(c)))
    found = odd.groupBy("id", "k").agg((mine("file") - UNNAMED).alias("file"), mine("offset").alias("offset"), F.coalesce(mine("length"), other("length")).alias("length"), mine("sha").alias("original_sha256"), other("sha").alias("copy_sha256"))
    damage = F.when(F.col("copy_sha256").isNull(), "missing").when(F.col("original_sha256").isNull(), "extra").otherwise("corrupt")
    return found.select(F.col("id.page_id").alias("page_id"), "file", "offset", "length", damage.alias("damage"), "original_sha256", "copy_sha256")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with about 1.2 % of its pages altered in one character and 0.4 % lost, by a hash of the id."""
    p = F.substring(md5_key(F.col("page_id"), "replica"), 1, 2)
    half = F.floor(F.length(F.coalesce("html", F.lit(""))) / 2).cast("int")
    body = F.coalesce("html", F.lit(""))
    altered = F.concat(F.substring(body, F.lit(1), half), F.lit("~"), F.substring(body, half + 2, F.length(body)))
    return pages.filter(p != "03").select("page_id", "url", F.when(p.isin("00", "01", "02"), altered).otherwise(F.col("html")).alias("html"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, substr(md5(coalesce(CAST(page_id AS VARCHAR), '') || ':replica'), 1, 2) AS k
  FROM pages),
q AS (
  SELECT page_id, url, html, k,
         CASE WHEN k IN ('00', '01', '02') THEN substr(html, 1, CAST(floor(length(html) / 2) AS BIGINT)) || '~' || substr(html, CAST(floor(length(html) / 2) AS BIGINT) + 2) ELSE html END AS other
  FROM p),
r AS (
  SELECT page_id, k,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS a,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(other) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || other || chr(13) || chr(10) || chr(13) || chr(10) AS b
  FROM q),
s AS (
  SELECT page_id, k, CAST(coalesce(floor(page_id / 1024), -1 - CAST('0x' || substr(sha256(a), 1, 3) AS BIGINT)) AS BIGINT) AS file, CAST(strlen(a) AS BIGINT) AS length, sha256(a) AS original_sha256,
         CASE WHEN k <> '03' THEN sha256(b) END AS copy_sha256
  FROM r),
t AS (
  SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, original_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM s)
SELECT page_id, file, "offset", length, CASE WHEN copy_sha256 IS NULL THEN 'missing' ELSE 'corrupt' END AS damage, original_sha256, copy_sha256
FROM t WHERE copy_sha256 IS DISTINCT FROM original_sha256
"""
