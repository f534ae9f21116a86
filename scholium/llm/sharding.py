"""Sharding by jump consistent hashing (Lamping and Veach, 2014): a stable key gives a shard without a ring table, and
one more shard takes rows only into itself.

The hash is a chain of 64-bit linear congruential steps. Spark's ANSI arithmetic rejects overflow, so a step is done on
three limbs of 22, 22 and 20 bits; every product stays under 2**46. All of it is a JVM expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm._tables import read
from scholium.operators.numbering import number_rows

MULTIPLIER = 2862933555777941757
_M = [MULTIPLIER & 0x3FFFFF, (MULTIPLIER >> 22) & 0x3FFFFF, MULTIPLIER >> 44]
SHARDS = 16
#: Steps of a chain; more are an error. The expected number is the logarithm of the shard count, 22 at most, and the odds of needing 128 are under 1e-40.
STEPS = 128


def _key(df: DataFrame, key: str) -> Column:
    """Integers are their own key; other types are hashed by xxhash64. A null key counts as 0."""
    kind = df.schema[key].dataType.typeName()
    c = F.col(key).cast("long") if kind in ("long", "integer", "short", "byte") else F.xxhash64(F.col(key))
    return F.coalesce(F.when(F.col(key).isNotNull(), c), F.lit(0).cast("long"))


def jump_hash(key: Column, shards: list[int]) -> Column:
    """A struct s<n> of the shard in each of several shard counts, which share the chain of steps."""
    if not shards or min(shards) < 1 or max(shards) >= 1 << 31:
        raise ValueError("shard counts lie from 1 to 2**31 - 1")

    def step(s: Column, _: Column) -> Column:
        r0 = s.k0 * _M[0] + 1
        r1 = s.k0 * _M[1] + s.k1 * _M[0] + F.shiftright(r0, 22)
        r2 = s.k0 * _M[2] + s.k1 * _M[1] + s.k2 * _M[0] + F.shiftright(r1, 22)
        k1, k2 = r1.bitwiseAND(0x3FFFFF), r2.bitwiseAND(0xFFFFF)
        top = F.shiftright(k1, 11) + k2 * 2048 + 1  # the key's highest 31 bits, plus 1
        out = [r0.bitwiseAND(0x3FFFFF).alias("k0"), k1.alias("k1"), k2.alias("k2")]
        for i, n in enumerate(shards):
            b, done = s[f"b{i}"], s[f"d{i}"]
            j = F.floor((b + 1).cast("double") * (F.lit(float(1 << 31)) / top.cast("double")))
            over = done | (j >= n)
            out += [F.when(over, b).otherwise(j).alias(f"b{i}"), over.alias(f"d{i}")]
        return F.struct(*out)

    zero = F.lit(0).cast("long")
    start = [key.bitwiseAND(0x3FFFFF).alias("k0"), F.shiftrightunsigned(key, 22).bitwiseAND(0x3FFFFF).alias("k1"), F.shiftrightunsigned(key, 44).alias("k2")]
    for i in range(len(shards)):
        start += [zero.alias(f"b{i}"), F.lit(False).alias(f"d{i}")]
    # each step moves every unfinished bucket up by one at least, so max(shards) steps always suffice; a finished chain only passes through
    chain = F.aggregate(F.sequence(F.lit(1), F.lit(min(max(shards), STEPS))), F.struct(*start), step)

    def ended(s: Column, i: int) -> Column:
        return s[f"b{i}"].cast("int") if max(shards) <= STEPS else F.when(s[f"d{i}"], s[f"b{i}"].cast("int")).otherwise(F.raise_error(F.lit("a chain of more steps than STEPS")).cast("int"))

    return F.transform(F.array(chain), lambda s: F.struct(*[ended(s, i).alias(f"s{n}") for i, n in enumerate(shards)]))[0]


def shard(df: DataFrame, key: str, shards: int, text: str, grown: bool = True) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for each row of df.

    size: UTF-8 bytes of the text plus 1; a null text has none, and crc32 0. slot: the row's place in its shard by key,
    gapless from 0; equal keys share a shard and take neighbouring slots. A null key counts as 0. Empty tables give no
    rows. Other columns of df are left aside, so no name can clash.
    """
    h = jump_hash(F.col("__k"), [shards, shards + 1] if grown else [shards])
    body = df.select(
        F.col(key).alias("__key"), _key(df, key).alias("__k"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
    ).withColumn("__h", h)
    body = body.select("__key", "size", "text_crc32", F.lit("key").alias("law"), F.col(f"__h.s{shards}").alias("shard"), (F.col(f"__h.s{shards + 1}") if grown else F.lit(None).cast("int")).alias("grown_shard"))
    out = number_rows(body, ["__key", "size", "text_crc32"], ["shard"], number="slot")
    return out.select(F.col("__key").alias(key), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op1_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), "doc_id", SHARDS, "text")


def _sql() -> str:
    """The chain in 128-bit integers, unrolled; the checksum of a text as a fold over its bytes."""
    steps, last = [], "s0"
    n = SHARDS
    steps.append("s0 AS (SELECT doc_id, text, CAST(doc_id AS HUGEINT) AS k, 0::BIGINT AS b0, false AS d0, 0::BIGINT AS b1, false AS d1 FROM documents)")
    for i in range(1, n + 2):
        steps.append(f"t{i} AS (SELECT doc_id, text, b0, d0, b1, d1, (k * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k FROM {last})")
        js = [f"CAST(floor((b{x} + 1) * (2147483648.0::DOUBLE / CAST((k // 8589934592::HUGEINT) + 1 AS DOUBLE))) AS BIGINT)" for x in (0, 1)]
        cols = ", ".join(f"CASE WHEN d{x} OR {js[x]} >= {n + x} THEN b{x} ELSE {js[x]} END AS b{x}, d{x} OR {js[x]} >= {n + x} AS d{x}" for x in (0, 1))
        steps.append(f"s{i} AS (SELECT doc_id, text, k, {cols} FROM t{i})")
        last = f"s{i}"
    table = ["bits0 AS (SELECT range AS n, range::BIGINT AS v FROM range(256))"]
    for i in range(1, 9):
        table.append(f"bits{i} AS (SELECT n, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM bits{i - 1})")
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::BIGINT)), lambda c, x: xor(c // 256, tab[1 + (xor(c % 256, x))::INT])), 4294967295::BIGINT)"
    return (
        "WITH " + ", ".join(steps + table) + ", tabs AS (SELECT list(v ORDER BY n) AS tab FROM bits8)"
        " SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,"
        f" {crc} AS text_crc32, 'key' AS law, b0::INTEGER AS shard,"
        f" row_number() OVER (PARTITION BY b0 ORDER BY doc_id) - 1 AS slot, b1::INTEGER AS grown_shard FROM {last}, tabs"
    )


QUERIES = {"op1_jump_shards": op1_jump_shards}
ORACLES = {"op1_jump_shards": _sql()}
