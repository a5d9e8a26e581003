"""Fill-in-middle: texts cut at unit boundaries and told in another order, with sentinels.

A unit is a run of ASCII letters or any other code point by itself.  One automaton over
bytes knows UTF-8's continuation bytes, where units begin, and whole sentinels.  Its state
is known from the last two bytes whatever came before (this is checked when its table is
made), so a batch is scanned with one table lookup for each byte, in blocks, across the
texts as they lie in Arrow's buffer.  The first pass counts the transitions of each text and
each block: code points, units, sentinels.  The counts give each text's form and the
ordinals of its cuts; the second pass reads only the blocks that hold a cut.

A null or empty text is plain.  A null id draws as the empty word would.  Rows that repeat an
id or a text are each transformed by themselves, and the same id draws the same numbers.
Long texts are scanned in blocks like others.  An empty table gives no rows.  Columns other
than doc_id and text, of any name, aren't read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The sentinels, and the shares (of 100) of plain texts and of suffix-first ones among the others.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
BLOCK = 1 << 20
#: Bytes of output after which a batch is handed on.
HANDED_ON = 1 << 24

# Classes of bytes; START stands before a text.
OTHER, LETTER, KEY_P, KEY_S, KEY_M, OPEN, CLOSE, CONTINUED, START = range(9)
# States: nothing pending, within letters, after "<", after "<" and a sentinel's letter.
OUT, IN, OPENED, IN_P, IN_S, IN_M = range(6)
# Emissions: nothing, a code point within a unit, one that begins a unit, one that ends a sentinel.
NOTHING, INSIDE, BEGINS, ENDS_SENTINEL = range(4)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint16)
    out[[*range(65, 91), *range(97, 123)]] = LETTER
    for char, kind in (("P", KEY_P), ("S", KEY_S), ("M", KEY_M), ("<", OPEN), (">", CLOSE)):
        out[ord(char)] = kind
    out[0x80:0xC0] = CONTINUED
    return out


def step(state: int, kind: int) -> tuple[int, int]:
    """(next state, emission)."""
    letters = state in (IN, IN_P, IN_S, IN_M)
    if kind == START:
        return OUT, NOTHING
    if kind == CONTINUED:
        return OUT, NOTHING
    if kind in (LETTER, KEY_P, KEY_S, KEY_M):
        keyed = {KEY_P: IN_P, KEY_S: IN_S, KEY_M: IN_M}.get(kind, IN) if state == OPENED else IN
        return keyed, INSIDE if letters else BEGINS
    if kind == CLOSE and state in (IN_P, IN_S, IN_M):
        return OUT, ENDS_SENTINEL
    return (OPENED if kind == OPEN else OUT), BEGINS


def _emissions() -> np.ndarray:
    """By the classes of a byte and of the two before it."""
    table = np.zeros((9, 9, 9), np.uint8)
    for a in range(9):
        for b in range(9):
            before = {step(step(s, a)[0], b)[0] for s in range(6)}
            if len(before) > 1:
                raise AssertionError("two bytes must settle the state")
            for c in range(9):
                table[a, b, c] = step(min(before), c)[1]
    return table.ravel()


CLASSES, EMISSIONS = _classes(), _emissions()


class Scan:
    """Two passes over texts that lie one after another in a buffer: text i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK):
        self.data, self.offsets, self.block = data, offsets, block
        self.first = int(offsets[0])
        n = len(offsets) - 1
        self.units, self.chars, self.sentinels = (np.zeros(n, np.int64) for _ in range(3))
        blocks = range(self.first, int(offsets[-1]), block)
        self.units_before = np.zeros(len(blocks) + 1, np.int64)
        self.chars_before = np.zeros(len(blocks) + 1, np.int64)
        for k, at in enumerate(blocks):
            e = self.emitted(at)
            i, j = np.searchsorted(offsets, [at, at + len(e)], "right") - 1
            part = slice(int(i), min(int(j) + 1, n))
            ends = np.clip(offsets[part.start : part.stop + 1] - at, 0, len(e))
            for counts, hit in ((self.units, e >= BEGINS), (self.chars, e >= INSIDE), (self.sentinels, e == ENDS_SENTINEL)):
                total = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
                counts[part] += np.diff(total[ends])
            self.units_before[k + 1] = self.units_before[k] + np.count_nonzero(e >= BEGINS)
            self.chars_before[k + 1] = self.chars_before[k] + np.count_nonzero(e >= INSIDE)

    def emitted(self, at: int) -> np.ndarray:
        """Emissions of the block's bytes; START stands twice before each text."""
        end = min(at + self.block, int(self.offsets[-1]))
        low = max(at - 2, self.first)
        kinds = np.full(end - at + 2, START, np.uint16)
        kinds[low - at + 2 :] = CLASSES[self.data[low:end]]
        before, two_before = kinds[1:-1].copy(), kinds[:-2].copy()
        i, j = np.searchsorted(self.offsets, [at - 1, end])
        starts = self.offsets[i:j] - at
        before[starts[starts >= 0]] = START
        two_before[starts[starts >= 0]] = START
        after = starts + 1
        two_before[after[(after >= 0) & (after < end - at)]] = START
        return EMISSIONS[two_before * 81 + before * 9 + kinds[2:]]

    def cuts(self, rows: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte in data, code points before it in its text) where so many units of a row's text end."""
        at, chars = self.offsets[rows + 1].astype(np.int64), self.chars[rows].copy()
        ordinal = (np.cumsum(self.units) - self.units)[rows] + units
        text_chars = (np.cumsum(self.chars) - self.chars)[rows]
        inside = np.flatnonzero(units < self.units[rows])
        home = np.searchsorted(self.units_before, ordinal[inside], "right") - 1
        for k in np.unique(home):
            mine = inside[home == k]
            start = self.first + int(k) * self.block
            e = self.emitted(start)
            place = np.flatnonzero(e >= BEGINS)[ordinal[mine] - self.units_before[k]]
            points = np.concatenate([[0], np.cumsum(e >= INSIDE, dtype=np.int64)])
            at[mine], chars[mine] = start + place, self.chars_before[k] + points[place] - text_chars[mine]
        return at, chars


def draws(doc_id, salt: str) -> tuple[int, int, int, int]:
    """Four unsigned numbers from the salt and the id's decimal digits."""
    return struct.unpack(">4I", sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def _transformed(ids: pa.Array, texts: pa.Array, salt: str, plain_from: int, spm_below: int, block: int) -> Iterator[pa.RecordBatch]:
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")
    scan = Scan(np.frombuffer(raw, np.uint8), offsets, block)
    drawn = np.array([draws(i, salt) for i in ids.to_pylist()], np.int64).reshape(len(texts), 4)
    plain = (scan.chars == 0) | (scan.sentinels > 0) | (drawn[:, 2] % 100 >= plain_from)
    spm = drawn[:, 3] % 100 < spm_below
    rows = np.flatnonzero(~plain)
    ends = np.sort(drawn[rows, :2] % (scan.units[rows, None] + 1), axis=1)
    (first, prefix_chars), (last, until) = (scan.cuts(rows, ends[:, k]) for k in (0, 1))
    cut = {int(r): k for k, r in enumerate(rows)}
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    start, held, out = 0, 0, []
    for r in range(len(texts)):
        a, z = int(offsets[r]), int(offsets[r + 1])
        if r in cut:
            f, u = int(first[cut[r]]), int(last[cut[r]])
            parts = (s, raw[u:z], p, raw[a:f], m, raw[f:u]) if spm[r] else (p, raw[a:f], s, raw[u:z], m, raw[f:u])
            out.append(b"".join(parts))
        else:
            out.append(bytes(raw[a:z]))
        held += len(out[-1])
        if held >= HANDED_ON or r + 1 == len(texts):
            mine = range(start, r + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(start, len(mine)), pa.array(scan.units[start : r + 1]), pa.array(["plain" if plain[i] else "spm" if spm[i] else "psm" for i in mine]),
                    pa.array([int(prefix_chars[cut[i]]) if i in cut else None for i in mine], pa.int64()),
                    pa.array([int(until[cut[i]] - prefix_chars[cut[i]]) if i in cut else None for i in mine], pa.int64()), pa.array(out, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )
            start, held, out = r + 1, 0, []


def transform(docs: DataFrame, salt: str = "1", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain), output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from _transformed(b.column(0), b.column(1), salt, plain_from, spm_below, block)

    made = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    chosen = docs.select("doc_id", "text")
    return chosen.mapInArrow(run, T.StructType([chosen.schema["doc_id"], *made]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A cut text holds no sentinel, and no sentinel overlaps itself, so each is found once."""
    after = lambda c, mark: F.substring_index(c, mark, -1)
    before = lambda c, mark: F.substring_index(c, mark, 1)
    middle = after(output, MIDDLE)
    psm = F.concat(after(before(output, SUFFIX), PREFIX), middle, after(before(output, MIDDLE), SUFFIX))
    spm = F.concat(after(before(output, MIDDLE), PREFIX), middle, after(before(output, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """transform(), with the hashes of the output and of the text rebuilt from it in place of the output."""
    out = transform(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: The same for DuckDB.
SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM cut
), formed AS (
  SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
