"""SimHash near-duplicates: fingerprints by their bits in each segment, met on a grid, verified exactly.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the hashes of the text's
three-word shingles.  The embedding maps it to the number of bits in each of 16 segments of
four bits, a point of a grid.  One changed bit moves one coordinate by one, so the Manhattan
distance of two points is at most the fingerprints' Hamming distance.  Fingerprints that
differ in up to two bits lie within two steps, so a grid point exists that is within one step
of both: each fingerprint is sent to its own point and the 32 around it at most, and those
that meet at a point are compared bit by bit.

Texts with equal fingerprints go as one.  Where more than CROWD fingerprints meet at a point
(groups of thousands of near copies), comparing all pairs would grow with the square of
the group.  Their links are found just as exactly by the values between them: two
fingerprints differ in up to two bits if, and only if, some value is within one bit of both;
at most 65 fingerprints have a value in common.  No pair of a crowd is made.

A null, empty or blank text has no shingle: its fingerprint is zero, which links like any
other.  Fewer than three words are one shingle.  Rows that repeat an id stay as they are; a
null id is linked and gets its component's least id, which is null only if no member has one.
Long texts are hashed in blocks.  An empty table gives no rows.  Columns other than doc_id
and text, of any name, aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lumenframe.llm import components
from lumenframe.llm.common import beside, freed, written

WORDS, SEED, NEAR = 3, 42, 2
SEGMENTS, WIDTH = 16, 4
CROWD = 32
#: Bytes of a text that are cut into words at a time.
BLOCK = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _words(data: bytes, block: int) -> Iterator[list[bytes]]:
    """Words of whole blocks; bytes' own lower() and split() know just A-Z and this white space."""
    start = 0
    while start < len(data):
        after = SPACE.search(data, start + block) if start + block < len(data) else None
        end = after.start() if after else len(data)
        yield data[start:end].lower().split()
        start = end


def simhash(text: str, block: int = BLOCK) -> int:
    """The fingerprint, unsigned."""
    ones, total, carried = np.zeros(64, np.int64), 0, []
    for words in _words(text.encode(), block):
        words = carried + words
        hashes = np.fromiter((xxh64_intdigest(b" ".join(s), SEED) for s in zip(words, words[1:], words[2:])), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
        carried = words[-(WORDS - 1) :]
    if not total and carried:
        return xxh64_intdigest(b" ".join(carried), SEED)
    return sum(1 << int(b) for b in np.flatnonzero(ones * 2 > total))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, f: the fingerprint as a signed long, of every row."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return beside(docs, ["doc_id"], "text", lambda texts: {"f": [signed(simhash(t)) for t in texts]}, {"f": "long"})


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def point(f: Column) -> Column:
    """Bits in each segment, as the digits of one long."""
    out = F.lit(0).cast("long")
    for i in range(SEGMENTS):
        count = F.bit_count(F.shiftrightunsigned(f, WIDTH * i).bitwiseAND(_long((1 << WIDTH) - 1))).cast("long")
        out = out.bitwiseOR(F.shiftleft(count, WIDTH * i))
    return out


def around(p: Column) -> Column:
    """The point and those one step from it."""
    steps = [p]
    for i in range(SEGMENTS):
        digit, one = F.shiftrightunsigned(p, WIDTH * i).bitwiseAND(_long((1 << WIDTH) - 1)), _long(1 << WIDTH * i)
        steps += [F.when(digit < WIDTH, p + one), F.when(digit > 0, p - one)]
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def links(spark: SparkSession, distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) from distinct fingerprints f: links that hang together just what differs in up to two bits."""
    met = written(spark, distinct.select("f", point(F.col("f")).alias("p")).select("f", F.explode(around(F.col("p"))).alias("p")), "grid")
    sizes = written(spark, met.groupBy("p").agg(F.count("*").alias("n")).where("n > 1"), "grid-sizes")
    few = met.join(sizes.where(F.col("n") <= crowd), "p").select("p", "f")
    pairs = few.alias("x").join(few.alias("y"), "p").where("x.f < y.f").where(F.bit_count(F.col("x.f").bitwiseXOR(F.col("y.f"))) <= NEAR).select(F.col("x.f").alias("a"), F.col("y.f").alias("b"))
    crowded = met.join(sizes.where(F.col("n") > crowd), "p").select("f").distinct()
    between = F.concat(F.array(F.col("f")), F.array(*(F.col("f").bitwiseXOR(_long(1 << i)) for i in range(64))))
    shared = crowded.select("f", F.explode(between).alias("v")).groupBy("v").agg(F.min("f").alias("b"), F.collect_list("f").alias("fs")).where(F.size("fs") > 1)
    hubs = shared.select(F.explode("fs").alias("a"), "b").where("a <> b")
    out = written(spark, pairs.unionByName(hubs), "simhash-links")
    freed(spark, met, sizes)
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = written(spark, fingerprints(docs), "fingerprints")
    least = written(spark, rows.groupBy("f").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    linked = links(spark, least.select("f"), crowd)
    roots = components.roots(spark, linked)
    rooted = written(spark, least.join(roots.withColumnRenamed("node", "f"), "f", "left").select("f", "least_id", F.coalesce("root", "f").alias("root")), "rooted")
    freed(spark, linked, least)
    smallest = written(spark, rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "components")
    named = written(spark, rooted.join(smallest, "root").select("f", "component_id"), "fingerprint-components")
    freed(spark, rooted, smallest)
    return rows.join(named, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
