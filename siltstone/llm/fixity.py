"""Fixity audit of archive records by Merkle trees over ordered ranges.

Every replica lays itself out by what it holds: records in order of their ids,
``ARCHIVE_RECORDS`` ids to an archive, ``RANGE_RECORDS`` to a range; within a
range records follow one another by id and digest, so a change of length moves
nothing outside it. A range's leaf is taken over the SHA-256 digests of its
records, a node above over its children's places and hashes. Two replicas are
compared root by root; only below a node that differs are its children looked
at, and records are read again only in ranges that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import read_table, written

ARCHIVE_RECORDS = 512  # consecutive record ids that one archive holds
RANGE_RECORDS = 16  # ids of a lowest range
FAN = 8
LEVELS = 3  # ranges, what is above them, and the archive's root


def records(table: DataFrame, id_col: str, content_cols: list[str]) -> DataFrame:
    """(archive, range, record_id, digest, length, copies): contents are hashed where they lie, equal records counted.

    A null content column counts as empty. Records without id lie in archive
    null, in ranges by digest.
    """
    content = F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content_cols])
    hashed = table.select(F.col(id_col).cast("long").alias("record_id"), F.octet_length(content).cast("long").alias("length"), F.sha2(content, 256).alias("digest"))
    place = F.coalesce(F.pmod(F.col("record_id"), F.lit(ARCHIVE_RECORDS)), F.pmod(F.xxhash64("digest"), F.lit(ARCHIVE_RECORDS)))
    return hashed.groupBy("record_id", "digest", "length").agg(F.count("*").alias("copies")).select(
        F.floor(F.col("record_id") / ARCHIVE_RECORDS).cast("long").alias("archive"), F.floor(place / RANGE_RECORDS).cast("long").alias("range"), "record_id", "digest", "length", "copies")


def _word(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long")


def tree(found: DataFrame) -> list[DataFrame]:
    """Nodes (archive, range, hash) of each level; the leaves have the range's bytes too.

    A leaf combines its records' digests word by word without gathering them,
    so an id that a third of all rows share is counted in many tasks.
    """
    own = F.sha2(F.concat_ws(":", F.coalesce(F.col("record_id").cast("string"), F.lit("")), "digest", F.col("copies").cast("string")), 256)
    words = [F.bit_xor(_word(F.col("own"), i)).cast("string").alias(f"w{i}") for i in range(4)]
    leaves = found.withColumn("own", own).groupBy("archive", "range").agg(*words, F.sum(F.col("length") * F.col("copies")).alias("bytes"), F.sum("copies").alias("n"))
    out = [written(leaves.select("archive", "range", F.sha2(F.concat_ws(":", "w0", "w1", "w2", "w3", F.col("bytes").cast("string"), F.col("n").cast("string")), 256).alias("hash"), "bytes"), "merkle")]
    for _ in range(1, LEVELS):
        below = out[-1].select("archive", F.floor(F.col("range") / FAN).cast("long").alias("range"), F.struct(F.col("range").alias("place"), "hash").alias("child"))
        # at most ``FAN`` children
        parts = F.transform(F.array_sort(F.collect_list("child")), lambda c: F.concat_ws(":", c["place"].cast("string"), c["hash"]))
        out.append(written(below.groupBy("archive", "range").agg(F.sha2(F.concat_ws(",", parts), 256).alias("hash")), "merkle"))
    return out


def _differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(archive, range) of the nodes that do not agree."""
    a, b = ours.withColumnRenamed("hash", "h1"), theirs.withColumnRenamed("hash", "h2")
    same = a["archive"].eqNullSafe(b["archive"]) & (a["range"] == b["range"])
    return a.join(b, same, "full").where("not h1 <=> h2").select(F.coalesce(a["archive"], b["archive"]).alias("archive"), F.coalesce(a["range"], b["range"]).alias("range"))


def _under(nodes: DataFrame, bad: DataFrame, up: Column) -> DataFrame:
    """The rows of ``nodes`` below the ranges ``bad``; ``up`` gives a row's range on their level."""
    b = bad.select(F.col("archive").alias("_a"), F.col("range").alias("_r"))
    return nodes.join(b, F.col("archive").eqNullSafe(F.col("_a")) & (up == F.col("_r")), "left_semi")


def damaged_ranges(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(archive, range) of the lowest ranges that differ between two trees, found from the roots down."""
    bad = written(_differing(ours[-1], theirs[-1]), "differing")
    for level in range(LEVELS - 2, -1, -1):
        up = F.floor(F.col("range") / FAN)
        bad = written(_differing(_under(ours[level], bad, up), _under(theirs[level], bad, up)), "differing")
    return bad


def _offsets(left: DataFrame, leaves: DataFrame, bad: DataFrame) -> DataFrame:
    """``left`` (records of the ranges ``bad``) with their offset in the archive; null without an id."""
    archives = bad.select(F.col("archive").alias("_a")).where("_a is not null").distinct()
    before = W.partitionBy("archive").orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # over an archive's few ranges
    starts = leaves.join(archives, F.col("archive") == F.col("_a"), "left_semi").select(F.col("archive").alias("_a"), F.col("range").alias("_r"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("archive", "range").orderBy("record_id", "digest").rowsBetween(W.unboundedPreceding, -1)
    told = left.where("record_id is not null").withColumn("inside", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(within), F.lit(0)))
    told = told.join(starts, (F.col("archive") == F.col("_a")) & (F.col("range") == F.col("_r"))).withColumn("offset", F.col("start") + F.col("inside")).drop("_a", "_r", "start", "inside")
    return told.unionByName(left.where("record_id is null").withColumn("offset", F.lit(None).cast("long")))


def audit(primary: DataFrame, replica: DataFrame, id_col: str, content_cols: list[str]) -> DataFrame:
    """The damaged records of ``replica``: archive, record_id, offset, length, expected, found, damage.

    ``damage`` is changed, missing or extra; offset and length are the
    primary's, null for an extra record, as is ``archive``. Where an id repeats,
    equal records are matched first, and what is left pairs by digest as changed.
    Records without id are only missing or extra and have no offset. Equal
    tables, empty ones too, give no rows. Other columns are ignored.
    """
    ours = written(records(primary, id_col, content_cols), "records")
    theirs = written(records(replica, id_col, content_cols), "records")
    left, right = tree(ours), tree(theirs)
    bad = damaged_ranges(left, right)
    a = _offsets(_under(ours, bad, F.col("range")), left[0], bad)
    b = _under(theirs, bad, F.col("range")).select(F.col("record_id").alias("_id"), F.col("digest").alias("_digest"), F.col("copies").alias("_copies"))
    both = a.join(b, a["record_id"].eqNullSafe(b["_id"]) & (a["digest"] == b["_digest"]), "full")
    more = F.coalesce("copies", F.lit(0)) - F.coalesce("_copies", F.lit(0))
    # what one side has more often, a row each
    gone = both.where(more > 0).withColumn("nth", F.explode(F.sequence(F.coalesce("_copies", F.lit(0)).cast("long"), F.col("copies") - 1)))
    gone = gone.select("archive", "record_id", (F.col("offset") + F.col("nth") * F.col("length")).alias("offset"), "length", F.col("digest").alias("expected"), F.col("nth"))
    come = both.where(more < 0).withColumn("nth", F.explode(F.sequence(F.coalesce("copies", F.lit(0)).cast("long"), F.col("_copies") - 1))).select(F.col("_id"), F.col("_digest").alias("found"), F.col("nth").alias("_nth"))
    pair = gone.where("record_id is not null").withColumn("k", F.row_number().over(W.partitionBy("record_id").orderBy("expected", "nth"))).drop("nth")
    other = come.where("_id is not null").withColumn("_k", F.row_number().over(W.partitionBy("_id").orderBy("found", "_nth"))).drop("_nth")
    met = pair.join(other, (F.col("record_id") == F.col("_id")) & (F.col("k") == F.col("_k")), "full").select(
        "archive", F.coalesce("record_id", "_id").alias("record_id"), "offset", "length", "expected", "found",
        F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("changed").alias("damage"))
    none = F.lit(None)
    nameless = gone.where("record_id is null").select("archive", "record_id", "offset", "length", "expected", none.cast("string").alias("found"), F.lit("missing").alias("damage"))
    extra = come.where("_id is null").select(none.cast("long").alias("archive"), F.col("_id").alias("record_id"), none.cast("long").alias("offset"), none.cast("long").alias("length"), none.cast("string").alias("expected"), "found", F.lit("extra").alias("damage"))
    return met.unionByName(nameless).unionByName(extra)


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of ``pages`` as a failing store might return it; a digest of the id says which records suffer."""
    fate = F.substring(F.md5(F.concat(F.lit("fixity"), F.col("page_id").cast("string")).cast("binary")), 1, 2)
    kept = pages.where(~(F.coalesce(fate, F.lit("")) == "02")).withColumn(
        "html", F.when(fate == "00", F.concat(F.lit("?"), F.expr("substring(html, 2)"))).when(fate == "01", F.expr("substring(html, 1, length(html) div 2)")).otherwise(F.col("html")))
    return kept.unionByName(pages.where(fate == "03").withColumn("page_id", -F.col("page_id") - 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages), "page_id", ["url", "html"])


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') || chr(10) || coalesce(html, '') AS content, substr(md5('fixity' || page_id), 1, 2) AS fate, coalesce(url, '') AS u, coalesce(html, '') AS h FROM pages),
l AS (SELECT *, page_id // 512 AS archive, strlen(content) AS length, coalesce(sum(strlen(content)) OVER (PARTITION BY page_id // 512 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM p),
r AS (SELECT page_id, CASE fate WHEN '00' THEN sha256(u || chr(10) || '?' || substr(h, 2)) WHEN '01' THEN sha256(u || chr(10) || substr(h, 1, length(h) // 2)) ELSE sha256(content) END AS found FROM p WHERE fate <> '02')
SELECT archive, l.page_id AS record_id, "offset", length, sha256(content) AS expected, found, CASE WHEN found IS NULL THEN 'missing' ELSE 'changed' END AS damage
FROM l LEFT JOIN r ON l.page_id = r.page_id WHERE found IS DISTINCT FROM sha256(content)
UNION ALL
SELECT NULL, -page_id - 1, NULL, NULL, NULL, sha256(content), 'extra' FROM p WHERE fate = '03'
"""
