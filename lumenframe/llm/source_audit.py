"""Source divergence audit: which sources of a language use words in other shares, and which words.

Texts are cut into terms and counted by (lang, source) within each task; the counts are
added up by Spark.  Terms in enough documents of their language are kept.  They are dealt
into blocks, and the sources of a language into sides, so that a tile is a dense matrix of
sources by terms of bounded size: it holds the share p of every source and term in whole
billionths, zero counts included.  A tile compares all its pairs of sources by broadcasting,
some terms at a time, and hands on one number for each pair: the sum over its terms.  The
partial pair matrices are added up by Spark.  The tile of a side with itself also hands on
its best terms of each source, of which the last ranking chooses the best of all blocks.

All arithmetic is exact: shares by long division in three steps of 1000 (right up to 9e15
terms a language), squares below 2^60.

A null text, lang or source is the empty string.  Every row counts as a document, also those
that repeat an id or have none.  Ties go to the lesser item in UTF-8.  Long texts are cut in
blocks.  A source without terms has its pairs; a language without kept terms has pairs of
value 0.  An empty table gives no rows.  Columns other than text, lang and source, of any
name, aren't read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import freed, written

MIN_DOCS, TOP = 10, 10
#: Terms of a block and sources of a side; cells that are compared at a time; counters that a task holds.
BLOCK_TERMS, SIDE, CELLS, HELD = 512, 64, 1 << 20, 200_000
UNIT = 1_000_000_000
#: Bytes of a text cut at a time.
PIECE = 1 << 20
#: Terms are runs of ASCII letters and of code points beyond ASCII; as bytes, all from 0x80 on.
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


def terms(text: str, piece: int = PIECE) -> Counter:
    """Counts by term, as bytes."""
    data, out, start = text.encode().translate(TO_TERMS), Counter(), 0
    while start < len(data):
        end = data.find(b" ", start + piece)
        end = len(data) if end < 0 else end
        out.update(data[start:end].split(b" "))
        start = end
    out.pop(b"", None)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of some rows; the empty term stands for the group itself."""
    names = ["lang", "source", "term", "n", "docs"]

    def out(totals: dict) -> pa.RecordBatch:
        rows = [(lang, source, t.decode(), n, documents[lang, source][t]) for (lang, source), counts in totals.items() for t, n in counts.items()]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    totals, documents, held = defaultdict(Counter), defaultdict(Counter), 0
    for b in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
            group, found = (lang or "", source or ""), terms(text or "")
            before = len(totals[group])
            totals[group].update(found)
            documents[group].update(found.keys())
            totals[group][b""] = 0
            held += len(totals[group]) - before
            if held >= HELD:
                yield out(totals)
                totals, documents, held = defaultdict(Counter), defaultdict(Counter), 0
    if totals:
        yield out(totals)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * counts / totals) for counts up to the totals, exactly."""
    rest, out = counts.astype(np.int64), np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // totals
        rest = rest % totals
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def pair_sums(p: np.ndarray, q: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Sources of p by sources of q: the divergence summed over the terms, which are the columns of both."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, cells // max(1, len(p) * len(q)))
    for k in range(0, p.shape[1], step):
        out += divergence(p[:, None, k : k + step], q[None, :, k : k + step]).sum(axis=2)
    return out


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """One block of terms for two sides of sources: partial sums of pairs, and the best terms of each source."""
    lang, first, second = (k.as_py() for k in key[:3])
    heads = rows.filter(pc.equal(rows["term"], ""))
    sources, side, size, vocabulary = (heads[c].to_pylist() for c in ("source", "side", "source_total", "lang_terms"))
    n_terms = vocabulary[0]
    number = {s: i for i, s in enumerate(sources)}
    body = rows.filter(pc.not_equal(rows["term"], ""))
    coded = body["term"].combine_chunks().dictionary_encode()
    words = coded.dictionary.to_pylist()
    counts = np.zeros((len(sources), len(words)), np.int64)
    at = np.array([number[s] for s in body["source"].to_pylist()], np.int64)
    term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts[at, term] = body["n"].to_numpy()
    weight = np.array(size, np.int64)[:, None] + 2 * n_terms
    p = shares(counts + 2, weight) if words else np.zeros((len(sources), 0), np.int64)
    left, right = ([i for i, s in enumerate(side) if s == k] for k in (first, second))
    sums = pair_sums(p[left], p[right])
    made = []
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if a != b:
                made.append((lang, sources[a], "pair", sources[b], int(sums[i, j])))
                if first != second:
                    made.append((lang, sources[b], "pair", sources[a], int(sums[i, j])))
    if first == second and words:
        of_lang = np.zeros(len(words), np.int64)
        of_lang[term] = body["lang_n"].to_numpy()
        q = shares(of_lang + 2, np.array(body["lang_total"][0].as_py() + 2 * n_terms))
        value = divergence(p, q[None, :])
        order = np.argsort(np.argsort(np.array([w.encode() for w in words], dtype=object), kind="stable"))
        for a in left:
            own = np.flatnonzero((counts[a] > 0) & (p[a] > q))
            for t in own[np.lexsort((order[own], -value[a, own]))][:TOP]:
                made.append((lang, sources[a], "term", words[t], int(value[a, t])))
    kinds = {"lang": pa.string(), "source": pa.string(), "part": pa.string(), "item": pa.string(), "value": pa.int64()}
    return pa.table({c: pa.array([r[k] for r in made], kind) for k, (c, kind) in enumerate(kinds.items())})


def audit(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, block_terms: int = BLOCK_TERMS, side: int = SIDE) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank."""
    counted = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = written(spark, counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs)
    kept = written(spark, kept.select("lang", "term", "lang_n"), "kept-terms")
    mine = written(spark, counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")
    langs = counts.where("term = ''").groupBy("lang").agg(F.count("*").alias("lang_sources"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("lang_terms"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    totals = mine.groupBy("lang", "source").agg(F.sum("n").alias("source_total"))
    groups = counts.where("term = ''").select("lang", "source").join(langs, "lang").join(totals, ["lang", "source"], "left").na.fill(0, ["lang_terms", "lang_total", "source_total"])
    blocks, sides = (F.greatest(F.ceil(F.col(c) / n), F.lit(1)).cast("int") for c, n in (("lang_terms", block_terms), ("lang_sources", side)))
    groups = groups.withColumns({"blocks": blocks, "sides": sides}).withColumn("side", F.pmod(F.xxhash64("source"), F.col("sides")).cast("int"))
    groups = written(spark, groups, "sources")
    freed(spark, counts)
    block: Column = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    shape = ["lang", "source", "side", "sides", "source_total", "lang_terms", "lang_total"]
    heads = groups.select(*shape, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit("").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lang_n"))
    cells = mine.join(groups, ["lang", "source"]).select(*shape, block.alias("block"), "term", "n", "lang_n")
    tiles = F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda k: F.struct(F.least(k, F.col("side")).alias("a"), F.greatest(k, F.col("side")).alias("b")))
    dealt = heads.unionByName(cells).withColumn("tile", F.explode(tiles)).select("*", "tile.a", "tile.b")
    dealt = dealt.select("lang", "a", "b", "block", "source", "side", "source_total", "lang_terms", "lang_total", "term", "n", "lang_n")
    partial = dealt.groupBy("lang", "a", "b", "block").applyInArrow(_tile, "lang string, source string, part string, item string, value long")
    summed = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(best)).where(f"part = 'pair' OR rank <= {TOP}")


#: The same for DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * z.v) AS p,
         1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (z.lang_total + 2 * z.v) AS lang_p
  FROM grp g JOIN kept k USING (lang) JOIN sizes z USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN totals s USING (lang, source)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), whole AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(v.value, 0) AS BIGINT) AS value
  FROM grp g JOIN grp o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN pairs v ON v.lang = g.lang AND v.source = g.source AND v.item = o.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - lang_p) * (p - lang_p)) // (p + lang_p) AS BIGINT) FROM p WHERE n > 0 AND p > lang_p
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM whole
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
