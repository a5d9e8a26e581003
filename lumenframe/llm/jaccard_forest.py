"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is the set of its shingles (runs of five words, 64-bit hashes; a text of
one to four words is one shingle).  Documents of equal sets are copies and go on as
one representative that carries their number.

A signature has LEVELS symbols (16 bits of a minhash) in each of TREES trees, as bytes:
the paths of all documents, in the order of these bytes, are a tree's prefix trie, and
a node is the run of paths that begin with one prefix.  A document looks for partners
below one node of each tree.  Its prefixes start at the deepest level and are shortened
one symbol at a time, where the node above has fewest members, until a document at the
threshold shares a prefix with it in some tree with the target probability
(shortened()).  At `base`, the longest prefix that meets the target if all trees use
it, nodes of up to SMALL_NODE members cost next to nothing and are taken at once, so
only documents of large nodes descend: their sizes below base are counted, and the
depths differ by document and tree.  A node holds every document below it, as long as
one of them looks for partners there; a pair meets at the shorter of its two prefixes.

Members of a node are verified exactly, by counting common shingles.  Nodes with the
same members and seekers in several trees are verified once.  A large node is dealt
into blocks of bounded size, and each pair of blocks is a task, so no task holds a
large node and no row is made for a pair: a task returns, for each member, its number
of links and the least document it hangs together with there.  A pair that meets in
several trees is counted in the first.  (The exact number of links of N near copies
takes N * N / 2 comparisons, however they are dealt; each member is sent once for
each block of its node.)

Texts without words (null, empty, blank) are copies of each other; rows without an id
aren't in the result, and an empty table gives none.  Rows that repeat an id and its
text count as copies; different texts of one id keep their own numbers of links, but
their classes merge.  Columns other than doc_id and text, of any name, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import slices, written
from lumenframe.llm.components import roots

WORDS = 5
THRESHOLD = 0.8
TARGET = 0.999
TREES, LEVELS = 16, 8
#: Members up to which a node isn't worth a longer prefix.
SMALL_NODE = 256
#: Bounds of a block of a large node: documents and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 1_024, 400_000
MEMORY = 400_000
#: Pairs of entries of a task's inverted index, and linked pairs, worked on at once.
PAIRS, PAIRS_COMPARED = 1 << 20, 1 << 17
SLICE_CHARS = 1_000_000
_ODD = (np.random.default_rng(20_240_607).integers(1, 1 << 62, TREES * LEVELS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_MIX = np.uint64(0x9FB21C651E98DF25)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def prefix_depth(threshold: float = THRESHOLD, target: float = TARGET, trees: int = TREES, deepest: int = LEVELS) -> int:
    """The longest prefix at which, used in all trees, a pair of that similarity still meets in one of them with the target probability."""
    for depth in range(deepest, 1, -1):
        if trees * log(1 - threshold**depth) <= log(1 - target):
            return depth
    return 1


def shortened(sizes: dict[int, dict[int, int]], base: int, threshold: float = THRESHOLD, target: float = TARGET) -> list[int]:
    """Prefix length in each tree. sizes: by tree, members of a document's large nodes by depth; below them it is alone.

    All prefixes start at LEVELS.  In turn the one is shortened whose node above has the
    fewest members (then the first tree), until the chance to miss a document at the
    threshold is down to what the target allows.  Trees without a large node are at base at once.
    """
    depths = [LEVELS if t in sizes else base for t in range(TREES)]
    missed = lambda: sum(log(1 - threshold**d) for d in depths)
    while missed() > log(1 - target) + 1e-12:
        open_trees = [t for t in range(TREES) if depths[t] > base]
        if not open_trees:
            break
        depths[min(open_trees, key=lambda t: (sizes[t].get(depths[t] - 1, 1), t))] -= 1
    return depths


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


def shingles(text: str, hashes: _WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, n)
    width = min(words, n)
    out = h[: n - width + 1].copy()
    for i in range(1, width):
        out = (out * _STEP) ^ (out >> np.uint64(31))
        out += h[i : n - width + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def paths(sets: list[np.ndarray]) -> list[bytes]:
    """Signatures: for each tree LEVELS symbols of two bytes. Sets aren't empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), TREES * LEVELS), ">u2")
    for k, odd in enumerate(_ODD):
        low = np.minimum.reduceat(flat * odd, starts)
        out[:, k] = ((low ^ (low >> np.uint64(29))) * _MIX) >> np.uint64(48)
    return [row.tobytes() for row in out]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, set_hash, n_shingles, paths of every row with an id; no paths for texts without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for b in batches:
            texts, ids = [t or "" for t in b.text], b.doc_id.to_numpy()
            for s, e in slices(texts, SLICE_CHARS):
                sets = [shingles(t, hashes) for t in texts[s:e]]
                full = [x for x in sets if len(x)]
                own = iter(paths(full) if full else [])
                yield pd.DataFrame({"doc_id": ids[s:e], "set_hash": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], "n_shingles": [len(x) for x in sets], "paths": [next(own) if len(x) else None for x in sets]})

    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInPandas(run, "doc_id long, set_hash binary, n_shingles long, paths binary")


def _prefix(depth: Column | int, tree: Column | None = None) -> Column:
    """The prefix of a path (of a tree of the paths)."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.substring("path", F.lit(1), 2 * depth) if tree is None else F.substring("paths", tree * (2 * LEVELS) + 1, 2 * depth)


def prefix_lengths(spark: SparkSession, trees: DataFrame, base: int, threshold: float, target: float, small: int) -> DataFrame:
    """rep, set_key, depths of the documents that are in large nodes; trees: rep, set_key, tree, path."""
    node = trees.select("*", _prefix(base).alias("prefix"))
    large = written(spark, node.groupBy("tree", "prefix").agg(F.count("*").alias("members")).where(F.col("members") > small), "large-nodes")
    inside = written(spark, node.join(large, ["tree", "prefix"]).select("rep", "set_key", "tree", "path", "members"), "in-large-nodes")
    below = inside.select("rep", "set_key", "tree", "path", F.explode(F.sequence(F.lit(base + 1), F.lit(LEVELS - 1))).alias("depth")) if base + 1 < LEVELS else inside.select("rep", "set_key", "tree", "path", F.lit(0).alias("depth")).limit(0)
    below = below.select("rep", "set_key", "tree", "depth", _prefix(F.col("depth")).alias("prefix"))
    sizes = written(spark, below.groupBy("tree", "depth", "prefix").agg(F.count("*").alias("members")).where("members > 1"), "node-sizes")
    seen = inside.select("rep", "set_key", "tree", F.lit(base).alias("depth"), "members").unionByName(below.join(sizes, ["tree", "depth", "prefix"]).select("rep", "set_key", "tree", "depth", "members"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for nodes in b.nodes:
                own: dict[int, dict[int, int]] = {}
                for n in nodes:
                    own.setdefault(n["tree"], {})[n["depth"]] = n["members"]
                out.append(shortened(own, base, threshold, target))
            yield pd.DataFrame({"rep": b.rep, "set_key": b.set_key, "depths": out})

    return seen.groupBy("rep", "set_key").agg(F.collect_list(F.struct("tree", "depth", "members")).alias("nodes")).mapInPandas(choose, "rep long, set_key long, depths array<int>")


def _links(sets: list[np.ndarray], sides: np.ndarray, across: bool, symbols: np.ndarray, depths: np.ndarray, tree: int, depth: int, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of members at or over the threshold; of different sides, if across; only those that meet at this depth and in no earlier tree."""
    m, lengths = len(sets), np.array([len(s) for s in sets], np.int64)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), lengths)
    common = np.zeros((m, m))  # whole numbers below 2 ** 53 are exact
    often = counts > max(8, m // 16)
    places = np.cumsum(often) - 1
    hit = often[column]
    step = max(1, (8 << 20) // m)
    oc, oo = places[column[hit]], owner[hit]
    for c in range(0, int(often.sum()), step):
        inside = (oc >= c) & (oc < c + step)
        x = np.zeros((m, min(step, int(often.sum()) - c)), np.float32)
        x[oo[inside], oc[inside] - c] = 1
        common += x @ x.T
    rare = (counts[column] >= 2) & ~hit
    order = np.argsort(column[rare], kind="stable")
    ro, rc = owner[rare][order], column[rare][order]
    if len(ro):
        run = counts[rc]
        first = np.concatenate([[True], rc[1:] != rc[:-1]])
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        after = run - (np.arange(len(ro)) - start) - 1  # partners that follow in the same column
        total = np.cumsum(after)
        cuts = np.unique([0, *np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)), len(ro)])
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            reps = after[s:e]
            a = np.repeat(np.arange(s, e), reps)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(reps) - reps, reps)
            common += np.bincount(ro[a] * m + ro[b], minlength=m * m).reshape(m, m)
        # owners ascend within a column, so each rare pair was counted once, at i < j; the dense part is symmetric
    i, j = np.nonzero(np.triu(common * (threshold.denominator + threshold.numerator) >= threshold.numerator * (lengths[:, None] + lengths[None, :]), 1))
    if across:
        both = sides[i] != sides[j]
        i, j = i[both], j[both]
    here = np.empty(len(i), bool)
    for s in range(0, len(i), PAIRS_COMPARED):
        a, b = i[s : s + PAIRS_COMPARED], j[s : s + PAIRS_COMPARED]
        shorter = np.minimum(depths[a, : tree + 1], depths[b, : tree + 1])
        shared = (symbols[a, : tree + 1] == symbols[b, : tree + 1]).cumprod(axis=2, dtype=np.int8).sum(axis=2, dtype=np.int8)
        here[s : s + PAIRS_COMPARED] = (shorter[:, tree] == depth) & ~(shared[:, :tree] >= shorter[:, :tree]).any(axis=1)
    return i[here], j[here]


def _hang_together(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each member the least id that it is linked with, over any number of links."""
    low = ids.copy()
    while True:
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        if (low == before).all():
            return low


def _verify(group: list[tuple], at: tuple, threshold: Fraction) -> tuple[np.ndarray, ...]:
    """(ids, set keys, links, least id) of the members that have links. group: (id, set key, copies, side, paths, depths, shingles); at: tree, depth, prefix and blocks."""
    group = sorted({(r[0], r[1]): r for r in group}.values(), key=lambda r: r[:2])
    ids, sets, copies = (np.array([r[k] for r in group], np.int64) for k in range(3))
    symbols = np.frombuffer(b"".join(r[4] for r in group), ">u2").astype(np.uint16).reshape(len(group), TREES, LEVELS)
    depths = np.frombuffer(b"".join(r[5] for r in group), np.int8).reshape(len(group), TREES)
    i, j = _links([np.frombuffer(r[6], np.uint64) for r in group], np.array([r[3] for r in group]), at[3] != at[4], symbols, depths, at[0], at[1], threshold)
    links = np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
    some = links > 0
    return ids[some], sets[some], links[some], _hang_together(i, j, ids)[some]


def join(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET, block_docs: int = BLOCK_DOCS, small_node: int = SMALL_NODE) -> DataFrame:
    """doc_id, class_id, n_links of every row with an id.

    n_links counts the other rows whose similarity is at least the threshold, copies
    included; class_id is the least id that a document hangs together with by links.
    """
    exact = Fraction(threshold).limit_denominator(10_000)
    base = prefix_depth(threshold, target)
    sig = written(spark, signatures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "signatures")
    copies = sig.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("paths").alias("paths"))
    set_key = F.conv(F.hex(F.substring("set_hash", 1, 8)), 16, -10).cast("long").alias("set_key")
    copies = written(spark, copies.select("*", set_key), "copies")
    full = copies.where("paths is not null")
    trees = full.select("rep", "set_key", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "paths").select("rep", "set_key", "tree", _prefix(LEVELS, F.col("tree")).alias("path"))
    depths = written(spark, prefix_lengths(spark, trees, base, threshold, target, small_node), "depths")
    full = written(spark, full.join(depths, ["rep", "set_key"], "left").withColumn("depths", F.coalesce("depths", F.array_repeat(F.lit(base), TREES))), "forest")

    walked = full.select("rep", "set_key", "n_shingles", "paths", F.posexplode("depths").alias("tree", "own")).select("*", F.explode(F.sequence(F.lit(base), "own")).alias("depth"))
    in_nodes = walked.select("rep", "set_key", "n_shingles", "tree", "depth", _prefix(F.col("depth"), F.col("tree")).alias("prefix"), (F.col("own") == F.col("depth")).alias("seeks"))
    who = lambda seed: F.sum(F.xxhash64("rep", "set_key", "seeks", F.lit(seed)).cast("decimal(20,0)"))
    nodes = in_nodes.groupBy("tree", "depth", "prefix").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("size"), F.max("seeks").alias("sought"), who(0).alias("who"), who(1).alias("who2")).where("members > 1 and sought")
    nodes = nodes.groupBy("members", "who", "who2").agg(F.min(F.struct("tree", "depth", "prefix", "size")).alias("n")).select("n.tree", "n.depth", "n.prefix", F.greatest(F.ceil(F.col("members") / block_docs), F.ceil(F.col("n.size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    nodes = written(spark, nodes, "nodes")
    places = in_nodes.select("rep", "set_key", "tree", "depth", "prefix").join(nodes, ["tree", "depth", "prefix"]).groupBy("rep", "set_key").agg(F.collect_list(F.struct("tree", "depth", "prefix", "blocks")).alias("nodes"))
    wanted = full.select("set_hash", "rep", "set_key", "copies", "paths", "depths").join(places, ["rep", "set_key"])
    one_text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    sized = one_text.join(wanted, one_text.doc_id == wanted.rep).select("set_hash", "rep", "set_key", "copies", "paths", "depths", "nodes", "text")

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for b in batches:
            b["shingles"] = [shingles(t or "", hashes).tobytes() for t in b.text]
            b["depths"] = [np.asarray(d, np.int8).tobytes() for d in b.depths]
            own = [xxhash.xxh3_128_digest(x) == bytes(h) for x, h in zip(b.shingles, b.set_hash, strict=True)]
            yield b[own].drop(columns=["text", "set_hash"])

    carried = ["rep", "set_key", "copies", "paths", "depths", "shingles"]
    # hashed again here: that takes less time than 1.3 times the input takes disk
    sets = sized.mapInPandas(to_sets, "rep long, set_key long, copies long, paths binary, depths binary, nodes array<struct<tree:int,depth:int,prefix:binary,blocks:int>>, shingles binary")
    own = sets.select(*carried, F.explode("nodes").alias("n")).select(*carried, "n.*", F.pmod(F.xxhash64("rep", "set_key"), F.col("n.blocks")).cast("int").alias("block"))
    dealt = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    place = ["tree", "depth", "prefix", "x", "y"]
    dealt = dealt.select(*carried, "tree", "depth", "prefix", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, at, found = [], None, []
        for b in batches:
            for rep, key, n, own_paths, own_depths, data, side, *where in zip(b.rep, b.set_key, b.copies, b.paths, b.depths, b.shingles, b.side, *(b[c] for c in place), strict=True):
                if where != at:
                    if len(group) > 1:
                        found.append(_verify(group, at, exact))
                    group, at = [], where
                group.append((rep, key, n, side, own_paths, own_depths, data))
            if found:
                yield pd.DataFrame({c: np.concatenate([f[k] for f in found]) for k, c in enumerate(("rep", "set_key", "links", "low"))})
                found = []
        if len(group) > 1:
            yield pd.DataFrame(dict(zip(("rep", "set_key", "links", "low"), _verify(group, at, exact), strict=True)))

    linked = dealt.repartition(*place).sortWithinPartitions(*place, "rep").mapInPandas(verify, "rep long, set_key long, links long, low long")
    linked = written(spark, linked, "links")
    classes = roots(spark, linked.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    per_set = linked.groupBy("rep", "set_key").agg(F.sum("links").alias("links"))
    per_set = copies.select("set_hash", "rep", "set_key", "copies").join(per_set, ["rep", "set_key"], "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    per_set = per_set.select("set_hash", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return sig.select("doc_id", "set_hash").join(per_set, "set_hash").select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without those of a class except the one of least id; rows without an id stay, and so do all columns."""
    others = join(spark, docs).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(others, docs.doc_id.cast("long") == others.doc_id, "left_anti")
