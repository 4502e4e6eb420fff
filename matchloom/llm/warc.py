"""Merkle fixity audit of WARC replicas.

A replica is a table of records (archive, offset, content, record_id). Records are hashed; the hashes of the records
that begin in one range of offsets make a leaf, in order of offset; `fanout` neighbouring ranges make a node, level
by level, up to one node per archive. Archives meet in groups by the first digits of their name's hash, four, two and
none: the last is the root of the replica. Two replicas are compared from their roots down, and only children of
nodes that differ are looked at; records are compared in differing ranges alone.

A null archive stands for the empty name, a null offset for -1, a null content is unlike the empty one. Records that
repeat place and content are counted with their number. Where several records claim one offset, they are compared as
a set. An empty replica has an empty root; then every record of the other one is missing or extra.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.sources.staging import stage


@dataclass(frozen=True)
class AuditSettings:
    range_bytes: int = 65_536
    fanout: int = 16


def record_of(url: Column, html: Column, record_id: Column, date: str = "2024-01-01T00:00:00Z") -> Column:
    """A WARC/1.0 resource record as text. Its UUID comes from the id and the address."""
    digest = F.md5(F.concat_ws(" ", record_id.cast("string"), url))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"),
        F.concat_ws("-", *parts),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def lay_out(records: DataFrame, archive_bytes: int) -> DataFrame:
    """Give records (record_id, content) an archive and an offset: archives of about `archive_bytes`, dealt by the
    id's hash, with the records of each one after the other in order of id."""
    length = F.octet_length(F.coalesce("content", F.lit(""))).cast("long")
    sized = records.withColumn("length", length)
    total = sized.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    archives = max(1, -(-total // archive_bytes))
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("record_id").cast("string"), F.lit(""))), 1, 8), 16, 10)
    dealt = sized.withColumn("archive", F.format_string("archive-%06d", number.cast("long") % archives))
    before = Window.partitionBy("archive").orderBy("record_id", F.md5("content")).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def hashed(records: DataFrame, settings: AuditSettings = AuditSettings()) -> DataFrame:
    """(archive, offset, range, hash, record_id, copies): the records without their contents, written once."""
    place = F.coalesce(F.col("offset").cast("long"), F.lit(-1))
    rows = records.select(
        F.coalesce(F.col("archive").cast("string"), F.lit("")).alias("archive"),
        place.alias("offset"),
        F.floor(place / settings.range_bytes).cast("long").alias("range"),
        F.coalesce(F.sha2(F.col("content").cast("binary"), 256), F.lit("null")).alias("hash"),
        "record_id",
    )
    counted = rows.groupBy("archive", "offset", "range", "hash").agg(
        F.min("record_id").alias("record_id"), F.count("*").alias("copies")
    )
    return stage(counted, "fixity-records")


_CHILDREN = "array_join(transform(array_sort(collect_list(struct(idx, path, hash))), x -> concat(x.path, ':', x.hash)), ' ')"


def tree(records: DataFrame, height: int, settings: AuditSettings = AuditSettings()) -> list[DataFrame]:
    """Levels of (path, up, idx, hash), from the root down to the ranges. `height`: range levels of every archive.

    A group holds the records of one range, or `fanout` nodes, or the archives that share four digits of a hash.
    """

    def ranges(level: int, idx: Column) -> Column:
        return F.concat_ws("/", "archive", F.lit(level), idx.cast("string"))

    def above(level: int) -> Column:
        if level < height:
            return ranges(level + 1, F.floor(F.col("idx") / settings.fanout).cast("long"))
        return F.concat(F.lit("#"), F.substring(F.md5("archive"), 1, 4))

    entry = "concat_ws(' ', x.offset, x.hash, x.copies)"
    content = F.expr(f"array_join(transform(array_sort(collect_list(struct(offset, hash, copies))), x -> {entry}), ' ')")
    nodes = records.groupBy("archive", F.col("range").alias("idx")).agg(F.sha2(content, 256).alias("hash"))
    levels = []
    for level in range(height + 1):
        nodes = stage(
            nodes.select("archive", "idx", "hash", ranges(level, F.col("idx")).alias("path"), above(level).alias("up")),
            "fixity-nodes",
        )
        levels.append(nodes.select("path", "up", "idx", "hash"))
        if level < height:
            next_idx = F.floor(F.col("idx") / settings.fanout).cast("long").alias("next")
            nodes = nodes.groupBy("archive", next_idx).agg(F.sha2(F.expr(_CHILDREN), 256).alias("hash"))
            nodes = nodes.withColumnRenamed("next", "idx")
    for digits in (2, 0, None):
        groups = levels[-1].groupBy("up").agg(F.sha2(F.expr(_CHILDREN), 256).alias("hash"))
        up = F.lit(None).cast("string") if digits is None else F.substring("up", 1, 1 + digits)
        groups = groups.select(F.col("up").alias("path"), up.alias("up"), F.lit(0).cast("long").alias("idx"), "hash")
        levels.append(stage(groups, "fixity-nodes"))
    return levels[::-1]


def height_of(*replicas: DataFrame, settings: AuditSettings = AuditSettings()) -> int:
    """Range levels that bring the longest archive to one node."""
    last = max((r.agg(F.max("range")).first()[0] or 0) for r in replicas)
    height = 0
    while last > 0:
        last, height = last // settings.fanout, height + 1
    return height


def root_of(levels: list[DataFrame]) -> str | None:
    row = levels[0].select("hash").first()
    return row and row[0]


def differing(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """(path) of the ranges that differ, found from the roots down. Equal roots end it at once."""
    bad = None
    for ours, theirs in zip(left, right):
        a, b = (level.select("path", "up", "hash") for level in (ours, theirs))
        if bad is not None:  # children of differing nodes only
            parents = bad.select(F.col("path").alias("up"))
            a, b = a.join(parents, "up", "left_semi"), b.join(parents, "up", "left_semi")
        a = a.select("path", F.col("hash").alias("hash_a"))
        b = b.select("path", F.col("hash").alias("hash_b"))
        met = a.join(b, "path", "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        bad = stage(met.select("path"), "fixity-differing")
        if not bad.limit(1).count():
            break
    return bad


def audit(ours: DataFrame, theirs: DataFrame, settings: AuditSettings = AuditSettings()) -> DataFrame:
    """(archive, offset, record_id, kind, hash_ours, hash_theirs) of damaged places: `changed`, `missing` in theirs
    or `extra` there."""
    a, b = hashed(ours, settings), hashed(theirs, settings)
    height = height_of(a, b, settings=settings)
    bad = differing(tree(a, height, settings), tree(b, height, settings))

    def claimed(records: DataFrame, name: str) -> DataFrame:
        path = F.concat_ws("/", "archive", F.lit(0), F.col("range").cast("string"))
        inside = records.join(bad, path == F.col("path"), "left_semi")
        entries = F.array_sort(F.collect_list(F.concat_ws(" x ", "hash", F.when(F.col("copies") > 1, F.col("copies")))))
        return inside.groupBy("archive", "offset").agg(
            F.array_join(entries, " ").alias(f"hash_{name}"), F.min("record_id").alias(f"id_{name}")
        )

    met = claimed(a, "ours").join(claimed(b, "theirs"), ["archive", "offset"], "full")
    kind = F.when(F.col("hash_theirs").isNull(), "missing").when(F.col("hash_ours").isNull(), "extra").otherwise("changed")
    return met.where(~F.col("hash_ours").eqNullSafe(F.col("hash_theirs"))).select(
        "archive",
        "offset",
        F.coalesce("id_ours", "id_theirs").alias("record_id"),
        kind.alias("kind"),
        "hash_ours",
        "hash_theirs",
    )
