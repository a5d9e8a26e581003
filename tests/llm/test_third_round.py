"""Fill-in-middle, SimHash on a grid and the source audit against brute force, on odd tables, and against their SQL."""

from __future__ import annotations

import os
import random
import re
from collections import Counter
from fractions import Fraction
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lumenframe.llm import fill_middle, queries, simhash_grid, source_audit
from tests.llm.test_llm import CLASHING, DOCS, odd_rows, prose

SF = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
MORE = ("n", "form", "output", "f", "p", "a", "b", "side", "block", "term", "item", "value", "docs", "least_id", "root", "component_id", "fingerprint")
BIG = 2**60 + 1


def wide(frame):
    for c in (*CLASHING, *MORE):
        if c not in frame.columns:
            frame = frame.withColumn(c, F.lit("clash"))
    return frame


@pytest.mark.parametrize("name", ["op11_fill_middle", "op13_source_audit"])
def test_query_equals_sql(spark, name):
    got = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


# -- op11


def cut_by_hand(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_of_odd_texts_equals_the_plain_rule():
    rng = random.Random(5)
    for _ in range(400):
        texts = ["".join(rng.choice(["<", "P", ">", "S", "M", "<P>", "ab", "é", "🙂", " ", "\n", "x", "€", "<<", "<S"]) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 6))]
        ids = [rng.choice([None, 5, BIG, rng.randint(0, 10**6)]) for _ in texts]
        for block in (1, 2, 5, 1000):
            batches = fill_middle._transformed(pa.array(ids, pa.int64()), pa.array(["left out", *texts]).slice(1), "1", 90, 20, block)
            assert [tuple(r.values()) for r in pa.Table.from_batches(list(batches)).to_pylist()] == [cut_by_hand(i, t) for i, t in zip(ids, texts)]


def test_fill_middle_of_odd_tables(spark):
    rows = odd_rows() + [(BIG, "a <P b> c", "en", "s", 1), (BIG + 1, "it has <M> in it", "en", "s", 1), (BIG + 2, "<<S <S <M é>" * 50, "en", "s", 1), (BIG + 3, prose(9, 300_000), "en", "s", 1)]
    frame = wide(spark.createDataFrame(rows, DOCS)).coalesce(1)
    got = fill_middle.transform(frame).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    by = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted((tuple(r)[:6] for r in got), key=by) == sorted((cut_by_hand(r[0], r[1]) for r in rows), key=by)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((r[0], r[1] or "") for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.digests(frame.limit(0)).count() == 0


def test_fill_middle_restores_whatever_the_cuts_touch(spark):
    rows = [(i, random.Random(i).choice(["<", "<<", "x<", "S>", "<M"]) * 3 + "<" * (i % 4) + "P>"[: i % 3] + "é" * (i % 5), "en", "s", 1) for i in range(600)]
    got = fill_middle.transform(spark.createDataFrame(rows, DOCS)).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert {(r.doc_id, r.back) for r in got} == {(r[0], r[1]) for r in rows}
    shares = Counter(r.form for r in got)
    assert shares["spm"] and shares["psm"] > shares["spm"]


# -- op12


def plain_simhash(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values):
    """The least position that each value hangs together with."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 2 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_simhash_of_blocks_equals_the_plain_rule():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", "É", " ", "\t", "\x0b", "\x1c", " ", "\n", "w7"]) for _ in range(rng.randint(0, 60)))
        assert {simhash_grid.simhash(text, block) for block in (1, 5, 1 << 20)} == {plain_simhash(text)}


def test_grid_points_bound_the_distance(spark):
    rng = np.random.default_rng(1)
    values = [0, -1, 1 << 62, *(int(v) for v in rng.integers(-(2**63), 2**63 - 1, 60))]
    rows = spark.createDataFrame([(v,) for v in values], "f long").select("f", simhash_grid.point(F.col("f")).alias("p")).withColumn("around", simhash_grid.around(F.col("p"))).collect()
    digits = lambda p: [p >> 4 * i & 15 for i in range(16)]
    for r in rows:
        assert digits(r.p) == [(r.f >> 4 * i & 15).bit_count() for i in range(16)]
        near = [digits(a) for a in r["around"]]
        assert all(sum(abs(x - y) for x, y in zip(digits(r.p), d)) <= 1 and max(d) <= 4 for d in near) and len(near) == len(set(map(tuple, near)))
        assert len(near) == 1 + sum((d < 4) + (d > 0) for d in digits(r.p))


@pytest.mark.parametrize("crowd", [32, 2])
def test_links_hang_together_what_brute_force_links(spark, crowd):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1, 7}
    for v in list(values)[:20]:
        chain = v
        for _ in range(rng.randint(1, 12)):  # chains of links, some of them three bits long
            for _ in range(rng.randint(1, 3)):
                chain ^= 1 << rng.randrange(64)
            values.add(chain)
    dense = rng.getrandbits(64)
    values |= {dense ^ (1 << i) ^ (1 << j) for i in range(0, 24) for j in range(i)}  # a crowd
    values = sorted(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    made = simhash_grid.links(spark, spark.createDataFrame([(s,) for s in signed], "f long"), crowd).collect()
    place = {s: i for i, s in enumerate(signed)}
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in made:
        i, j = find(place[r.a]), find(place[r.b])
        root[max(i, j)] = min(i, j)
    assert [find(i) for i in range(len(values))] == classes(values)
    assert len(made) < 40 * len(values)  # no pairs of a crowd


def test_near_duplicates_of_odd_tables(spark):
    rows = odd_rows() + [(BIG, prose(1, 60).upper(), "en", "s", 1), (BIG + 1, prose(1, 60) + " w1", "en", "s", 1), (BIG + 2, " ", "en", "s", 1), (7, "one  ", "en", "s", 1), (None, "by itself only here", "en", "s", 1)]
    base = prose(11, 900).split()
    for k in range(40):  # near copies in the thousandth
        rows.append((900 + k, " ".join(base[:k] + [f"x{k}"] + base[k:]), "en", "s", 1))
    got = simhash_grid.near_duplicates(spark, wide(spark.createDataFrame(rows, DOCS))).collect()
    values = [plain_simhash(r[1]) for r in rows]
    roots = classes(values)
    least = {}
    for r, k in zip(rows, roots):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    want = Counter((r[0], f"{v:016x}", least.get(k)) for r, v, k in zip(rows, values, roots))
    assert Counter(map(tuple, got)) == want
    assert simhash_grid.near_duplicates(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_query_of_near_duplicates_equals_brute_force(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op12_simhash_grid(spark, SF).collect()}
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    values = [plain_simhash(r.text) for r in rows]
    assert got == {r.doc_id: (f"{v:016x}", rows[k].doc_id) for r, v, k in zip(rows, values, classes(values))}


# -- op13


def audit_by_hand(rows, least):
    groups = {(r[2] or "", r[3] or "") for r in rows}
    counts, seen = {}, {}
    for r in rows:
        found = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")))
        for t, n in found.items():
            seen[r[2] or "", t] = seen.get((r[2] or "", t), 0) + 1
            counts[r[2] or "", r[3] or "", t] = counts.get((r[2] or "", r[3] or "", t), 0) + n
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted(s for x, s in groups if x == lang)
        kept = sorted(t for (x, t), n in seen.items() if x == lang and n >= least)
        count = {s: {t: counts.get((lang, s, t), 0) for t in kept} for s in sources}
        share = lambda c, total: 1 + int(Fraction(10**9 * (c + 2), total + 2 * len(kept)))
        p = {s: {t: share(count[s][t], sum(count[s].values())) for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", own)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, t, v, k + 1) for k, (v, t) in enumerate(ranked) if part == "pair" or k < 10]
    return sorted(out)


def audited_rows():
    rng, rows = random.Random(6), odd_rows()
    for k in range(260):
        lang, source = rng.choice(["en", "de", "", None]), rng.choice(["a", "b", "ä", None, *(f"s{i}" for i in range(12))])
        rows.append((k, " ".join(rng.choice(["The", "tHe", "Éa", "éa", "x1y", f"w{rng.randint(0, 40)}z", "日本", "q_r", "\x85v"]) for _ in range(rng.randint(0, 60))), lang, source, 1))
    return rows + [(None, "the " * 50_000, "en", "a", 1), (5000, "alone", "xx", "only", 1), (5001, "", "yy", "one", 1), (5002, None, "yy", "two", 1)]


@pytest.mark.parametrize("sizes", [{}, {"block_terms": 3, "side": 4}])
def test_source_audit_equals_brute_force(spark, sizes):
    rows = audited_rows()
    got = source_audit.audit(spark, wide(spark.createDataFrame(rows, DOCS)), **sizes).collect()
    assert sorted(map(tuple, got)) == audit_by_hand(rows, 10)


def test_source_audit_of_no_rows(spark):
    none = source_audit.audit(spark, spark.createDataFrame([], DOCS))
    assert none.count() == 0 and none.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    for _ in range(500):
        total = rng.randint(1, 9 * 10**15)
        count = rng.choice([2, total, rng.randint(0, total)])
        assert int(source_audit.shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * count // total


def test_terms_are_cut_in_pieces():
    text = "The thE é_É\x85 a1b " * 40
    assert {tuple(sorted(source_audit.terms(text, piece).items())) for piece in (1, 7, 1 << 20)} == {tuple(sorted((t.encode(), n) for t, n in Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))).items()))}
