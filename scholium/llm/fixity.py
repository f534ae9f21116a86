"""Merkle fixity audit of WARC records.

Records in order have offsets; FANOUT neighbours make a range, whose digest is that of its records' keys and digests in order; FANOUT ranges make a range above, up to a
root. Two replicas with equal roots are equal. Else only mismatching ranges are entered, level by level, down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.llm._tables import read
from scholium.operators.numbering import number_rows
from scholium.runtime import cut, drop

FANOUT = 64
#: Of the drill in the query: one record in so many has a byte changed in the second replica; one in so many, by another remainder, is lost there.
DRILL, LOST = 97, 211


def warc_record(uri: Column, key: Column, payload: Column) -> Column:
    """A response record as text: header lines, an empty line, the payload and two line ends. Nulls count as empty."""
    u, k, p = (F.coalesce(c.cast("string"), F.lit("")) for c in (uri, key, payload))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), k, F.lit(">\r\nWARC-Target-URI: "), u,
        F.lit("\r\nContent-Length: "), F.octet_length(p).cast("string"), F.lit("\r\n\r\n"), p, F.lit("\r\n\r\n"),
    )


class Tree:
    """levels[0] has (file, node, key, offset, length, digest) of each record, levels[i] (file, node, first, end, digest) of each range of FANOUT nodes below, the last one a root for each file.

    Records are ordered by key within a file; ties by digest. Null keys sort first. Without a file column there is one file, 0. An empty table has no levels beyond the first, which is empty.
    """

    def __init__(self, df: DataFrame, key: str, record: Column, file: Column | None = None, fanout: int = FANOUT):
        self.fanout = fanout
        body = df.select((file if file is not None else F.lit(0)).cast("long").alias("file"), F.col(key).alias("key"), record.cast("binary").alias("__r"))
        body = body.select("file", "key", F.coalesce(F.octet_length("__r"), F.lit(0)).cast("long").alias("length"), F.sha2(F.coalesce("__r", F.lit(b"")), 256).alias("digest"))
        rows = number_rows(body, ["key", "digest"], ["file"], number="node", total_of="length", total="offset")
        self.levels = [cut(rows.select("file", "node", "key", "offset", "length", "digest"), "level")]
        below = self.levels[0].select("file", "node", F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("end"), F.concat(F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("")), F.lit(":"), F.col("digest")).alias("digest"))
        most = self.levels[0].agg(F.max("node")).first()[0]
        while most is not None:
            up = below.groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(
                F.min("first").alias("first"), F.max("end").alias("end"),
                # at most FANOUT children
                F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("node").alias("n"), "digest"))), lambda x: x.digest), ""), 256).alias("digest"),
            )
            below = cut(up, "level")
            self.levels.append(below)
            if most < fanout:
                break
            most //= fanout

    def root(self) -> DataFrame:
        return self.levels[-1]


def damage(a: Tree, b: Tree) -> DataFrame:
    """(file, node, key, status) of the records that differ between replicas: damaged, missing (only in a) or extra (only in b). node is the place in a, of extra ones in b.

    Trees of different heights are entered at the lower one's root level. A record lost or added shifts the ranges behind it in its file, so that these mismatch
    too; their records are matched by key and digest, then by key, wherever they stand. Of records that repeat a key, as many are matched as both
    replicas have. Null keys are a key of their own.
    """
    if a.fanout != b.fanout:
        raise ValueError("the trees have different fanouts")
    top = min(len(a.levels), len(b.levels)) - 1
    bad = None
    for level in range(top, 0, -1):
        x, y = (t.levels[level].select("file", "node", "digest") for t in (a, b))
        if bad is not None:
            x, y = (_under(d, bad, a.fanout) for d in (x, y))
        nxt = cut(_differing(x, y).select("file", "node"), "bad")
        if bad is not None:
            drop(bad)
        bad = nxt
    x, y = (t.levels[0].select("file", "node", "key", "digest") for t in (a, b))
    if bad is not None:
        x, y = (_under(d, bad, a.fanout) for d in (x, y))
    both = x.withColumn("side", F.lit(0)).unionByName(y.withColumn("side", F.lit(1)))
    # equal records of the two replicas cancel out, as many as both have; what is left is paired by key
    odd = both.groupBy("file", "key", "digest").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb")).where("na <> nb")
    odd = odd.select(F.col("file").alias("__f"), F.col("key").alias("__k"), F.col("digest").alias("__d"), F.least("na", "nb").alias("same"))
    left = both.join(odd, (F.col("file") == F.col("__f")) & (F.col("digest") == F.col("__d")) & F.col("key").eqNullSafe(F.col("__k"))).drop("__f", "__k", "__d")
    left = left.withColumn("nth", F.row_number().over(Window.partitionBy("file", "key", "digest", "side").orderBy("node"))).where("nth > same")
    left = left.withColumn("nth", F.row_number().over(Window.partitionBy("file", "key", "side").orderBy("node")))
    pair = left.groupBy("file", "key", "nth").agg(F.min(F.when(F.col("side") == 0, F.col("node"))).alias("in_a"), F.min(F.when(F.col("side") == 1, F.col("node"))).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").otherwise("damaged")
    return pair.select("file", F.coalesce("in_a", "in_b").alias("node"), "key", status.alias("status"))


def _under(d: DataFrame, bad: DataFrame, fanout: int) -> DataFrame:
    """The nodes of d below the mismatching ones."""
    up = bad.select("file", F.col("node").alias("__up"))
    return d.withColumn("__up", F.floor(F.col("node") / fanout)).join(up, ["file", "__up"], "left_semi").drop("__up")


def _differing(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.withColumnRenamed("digest", "other"), ["file", "node"], "full_outer").where(~F.col("digest").eqNullSafe(F.col("other")))


def op7_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit drill over all pages as WARC records: a second replica with changed bytes and lost records is made, and the damage found. One row per record, with
    its offset, digest, range's digest and status."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    html, crc = F.coalesce("html", F.lit("")), F.crc32(F.col("page_id").cast("string").cast("binary"))
    flipped = F.when((crc % DRILL == 0) & (F.length(html) > 0), F.concat(F.lit("~"), F.substring(html, 2, 1 << 30))).otherwise(html)
    a = Tree(pages, "page_id", warc_record(F.col("url"), F.col("page_id"), html))
    b = Tree(pages.where(~F.coalesce(crc % LOST == 1, F.lit(False))), "page_id", warc_record(F.col("url"), F.col("page_id"), flipped))
    found = damage(a, b).where("status <> 'extra'").select("node", "status")
    rng = a.levels[1].select(F.col("node").alias("range_id"), F.col("digest").alias("range_sha256")) if len(a.levels) > 1 else None
    out = a.levels[0].join(found, "node", "left").withColumn("range_id", F.floor(F.col("node") / FANOUT).cast("long"))
    out = out.join(rng, "range_id") if rng is not None else out.withColumn("range_sha256", F.lit(None).cast("string"))
    return out.select(F.col("key").alias("page_id"), F.col("node").alias("ordinal"), F.col("offset").alias("record_offset"), "length", F.col("digest").alias("sha256"), "range_id", "range_sha256", F.coalesce("status", F.lit("intact")).alias("status"))


QUERIES = {"op7_merkle_fixity": op7_merkle_fixity}
_REC = "'WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:' || coalesce(page_id::VARCHAR, '') || '>\r\nWARC-Target-URI: ' || coalesce(url, '') || '\r\nContent-Length: ' || octet_length(encode(coalesce(html, '')))::VARCHAR || '\r\n\r\n' || coalesce(html, '') || '\r\n\r\n'"
_CRC_BITS = ["b0 AS (SELECT range AS n, range::BIGINT AS v FROM range(256))"] + [f"b{i} AS (SELECT n, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM b{i - 1})" for i in range(1, 9)]
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(page_id::VARCHAR, ''), lambda h: ascii(h)::BIGINT)), lambda c, x: xor(c // 256, tab[1 + (xor(c % 256, x))::INT])), 4294967295::BIGINT)"
ORACLES = {
    "op7_merkle_fixity": f"""WITH {", ".join(_CRC_BITS)}, tabs AS (SELECT list(v ORDER BY n) AS tab FROM b8),
    r AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS ordinal, octet_length(encode({_REC}))::BIGINT AS length, sha256({_REC}) AS sha256, CASE WHEN {_CRC} % {LOST} = 1 THEN 'missing' WHEN {_CRC} % {DRILL} = 0 AND html <> '' AND html[1] <> '~' THEN 'damaged' ELSE 'intact' END AS status FROM pages, tabs),
    o AS (SELECT *, CAST(coalesce(sum(length) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset, ordinal // {FANOUT} AS range_id FROM r),
    g AS (SELECT range_id, sha256(string_agg('=' || page_id || ':' || sha256, '' ORDER BY ordinal)) AS range_sha256 FROM o GROUP BY range_id)
    SELECT page_id, ordinal, record_offset, length, sha256, o.range_id, range_sha256, status FROM o JOIN g ON o.range_id = g.range_id"""
}
