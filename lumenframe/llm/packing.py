"""Best-fit packing of token sequences, improved by exchanges between underfull bins.

Documents are tokenised where they lie; only lengths and checksums of their pieces
are shuffled.  Pieces are dealt by hash into groups of about GROUP pieces, and each
group is packed by itself: best fit by decreasing length first, then local search.
The search takes the emptiest bin and moves a document out of it, or exchanges one
for one or two for one with another underfull bin, whenever that raises the sum of
squared fills; it goes on until the bin is empty or no exchange helps.  Every underfull
bin is a partner: all of them are looked up at once, by what each can give back, and
the exchange that raises the sum most is made.  Changed bins are queued again, and the
sweeps end when one finds no exchange.  A group whose free room is less than one bin
can't lose another bin and is done.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm.bpe_segtree import WORD_PATTERN, byte_letters
from lumenframe.llm.common import written

ROOM = 2048
GROUP = 8192


class Tokens:
    """Ids of texts as the tokenizers library gives them for a byte-level BPE file.

    Merge ranks and words are those of the file; tiktoken, whose inner loop is
    several times faster, applies them, and tokenizers itself takes over where
    tiktoken gives up.  Special tokens in a text are special, as in tokenizers.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._fast = tiktoken.Encoding("file", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._exact = Tokenizer.from_file(path)
        self._exact.no_truncation()
        self._exact.no_padding()

    def ids(self, text: str) -> np.ndarray:
        try:
            return np.array(self._fast.encode(text, allowed_special="all"), "<u4")
        except ValueError:
            return np.array(self._exact.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def load(path: str) -> Tokens:
    return Tokens(path)


def cut(n: int, room: int = ROOM) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole rooms, of which the first may be shorter."""
    pieces = -(-n // room)
    first = n - room * (pieces - 1)
    return [(0, first), *((first + room * i, room) for i in range(pieces - 1))]


def best_fit(lengths: list[int], room: int = ROOM) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has r free
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        fits = rooms >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            at = by_room[free].pop()
            if not by_room[free]:
                rooms &= ~(1 << free)
        else:
            free, at = room, len(bins)
            bins.append([])
        bins[at].append(i)
        left = free - size
        by_room.setdefault(left, []).append(at)
        rooms |= 1 << left
    return bins


def _exchange(donor: list[int], other: list[int], free: int, gap: int, lengths: list[int]) -> tuple[list[int], list[int]] | None:
    """The exchange that fills `other` most: items that leave donor, items that leave other.

    The net length d that `other` gains is positive and at most its free room; gap is
    how much fuller it is than the donor.  Squared fill rises by 2 d (gap + d).
    """
    best, found = 0, None
    singles = [([], 0), *(([b], lengths[b]) for b in other)]
    pairs = [([donor[x], donor[y]], lengths[donor[x]] + lengths[donor[y]]) for x in range(len(donor)) for y in range(x)]
    give = [([a], lengths[a]) for a in donor] + pairs
    for out, size in give:
        for back, less in singles:
            d = size - less
            if best < d <= free and gap + d > 0:
                best, found = d, (out, back)
    if len(donor) > 0:
        for a in donor:
            for x in range(len(other)):
                for y in range(x):
                    d = lengths[a] - lengths[other[x]] - lengths[other[y]]
                    if best < d <= free and gap + d > 0:
                        best, found = d, ([a], [other[x], other[y]])
    return found


class _Receivers:
    """What every underfull bin can give back, indexed for one donor's gifts at a time.

    An entry is a bin and the size it gives back: nothing, an item, or (against one item
    of the donor only) a pair.  Entries of changed bins are left behind at a full dummy.
    """

    def __init__(self, bins: list[list[int]], fill: np.ndarray, lengths: list[int], room: int):
        self.bins, self.lengths, self.room = bins, lengths, room
        self.fill = np.append(fill, room)  # the last one is the dummy
        self.spans: dict[int, tuple[int, int, int, int]] = {}
        self._build()

    def _own(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([self.lengths[i] for i in self.bins[j]], np.int64)
        x, y = np.triu_indices(len(sizes), 1)
        return np.unique(np.append(sizes, 0)), np.unique(sizes[x] + sizes[y])

    def _build(self) -> None:
        self.at, self.size, self.ends = [], [], []
        open_bins = np.flatnonzero((self.fill[:-1] > 0) & (self.fill[:-1] < self.room)).tolist()
        own = {j: self._own(j) for j in open_bins}
        for kind in (0, 1):
            counts = [len(own[j][kind]) for j in open_bins]
            self.at.append(np.repeat(np.array(open_bins, np.int64), counts))
            self.size.append(np.concatenate([own[j][kind] for j in open_bins] or [np.zeros(0, np.int64)]))
            self.ends.append(dict(zip(open_bins, np.cumsum(counts).tolist(), strict=True)))
        self.spans = {j: tuple(self.ends[kind][j] - (len(own[j][kind]) if first else 0) for kind in (0, 1) for first in (1, 0)) for j in open_bins}
        self.live = sum(len(s) for s in self.size)

    def changed(self, j: int) -> None:
        """Index bin j anew; a full or empty bin takes part no more."""
        dummy, span = len(self.fill) - 1, self.spans.pop(j, None)
        if span:
            self.at[0][span[0] : span[1]] = dummy
            self.at[1][span[2] : span[3]] = dummy
        if 0 < self.fill[j] < self.room:
            span = ()
            for kind, sizes in enumerate(self._own(j)):
                span += (len(self.size[kind]), len(self.size[kind]) + len(sizes))
                self.at[kind] = np.append(self.at[kind], np.full(len(sizes), j))
                self.size[kind] = np.append(self.size[kind], sizes)
            self.spans[j] = span
        if sum(len(s) for s in self.size) > 2 * self.live + 1024:
            self._build()

    def best(self, k: int) -> int:
        """The bin whose exchange with donor k raises the sum of squared fills most; -1 if none does."""
        f = int(self.fill[k])
        singles, pairs = self._own(k)
        found, most = -1, 0
        self.fill[k] = self.room  # no exchange with itself
        for kind, gifts in ((0, np.union1d(singles, pairs)), (1, singles)):
            size = self.size[kind]
            fill = self.fill[self.at[kind]]
            # the most that is given and still fits, less what comes back
            d = gifts[np.searchsorted(gifts, size + self.room - fill, side="right") - 1] - size
            gain = np.where(d > 0, d * (fill - f + d), 0)
            if len(gain) and gain[i := int(gain.argmax())] > most:
                found, most = int(self.at[kind][i]), int(gain[i])
        self.fill[k] = f
        return found


def local_search(bins: list[list[int]], lengths: list[int], room: int = ROOM) -> list[list[int]]:
    bins = [list(b) for b in bins if b]
    all_fills = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
    alive, least = len(bins), -(-int(all_fills.sum()) // room)
    if alive <= least:
        return bins
    near = _Receivers(bins, all_fills, lengths, room)
    fill, changed = near.fill, True
    while changed and alive > least:
        changed = False
        queue = [(int(f), k) for k, f in enumerate(fill[:-1]) if 0 < f < room]
        heapq.heapify(queue)
        while alive > least and queue:
            f, k = heapq.heappop(queue)
            if f != fill[k] or not bins[k]:
                continue
            while bins[k] and (j := near.best(k)) >= 0:
                out, back = _exchange(bins[k], bins[j], int(room - fill[j]), int(fill[j] - fill[k]), lengths)
                bins[k] = [i for i in bins[k] if i not in out] + back
                bins[j] = [i for i in bins[j] if i not in back] + out
                d = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
                fill[k], fill[j] = fill[k] - d, fill[j] + d
                near.changed(k)
                near.changed(j)
                changed = True
                if fill[j] < room:
                    heapq.heappush(queue, (int(fill[j]), j))
            if not bins[k]:
                alive -= 1
    return [b for b in bins if b]


def pack(lengths: list[int], room: int = ROOM) -> list[list[int]]:
    return local_search(best_fit(lengths, room), lengths, room)


def pieces(docs: DataFrame, tokenizer_path: str, room: int = ROOM) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load(tokenizer_path)
        for b in batches:
            rows, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(tokens.ids(text or ""), np.array([0], "<u4"))
                own = cut(len(ids), room)
                rows += [i] * len(own)
                out += [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(own)]
            columns = zip(*out, strict=True) if out else [()] * 4
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *made], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, tokenizer_path: str, room: int = ROOM, group: int = GROUP) -> DataFrame:
    """Every piece with sequence_id and offset: its place in a sequence without gaps.

    A null text is empty, and an empty document is its end token alone.  Rows with
    null or repeated ids are packed each by itself.  Equal lengths are packed in the
    order of their ids.  Other columns aren't read.  An empty table gives none.  The rows of pieces (no texts) are
    written first, so texts are read and tokenised once and the number of groups comes
    from the number of pieces, however long documents are.
    """
    cut_up = written(docs.sparkSession, pieces(docs, tokenizer_path, room), "pieces")
    n_groups = max(1, round(cut_up.count() / group))
    # the row's number in the written table deals rows that repeat each other over the groups, too
    dealt = cut_up.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(n_groups)).cast("int"))

    def run(g: pa.Table) -> pa.Table:
        g = g.take(pc.sort_indices(g, [(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "start", "length")], null_placement="at_start"))
        lengths = g["length"].to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, members in enumerate(pack(lengths, room)):
            at = 0
            for i in members:
                sequence[i], offset[i] = k, at
                at += lengths[i]
        first = np.int64(g["grp"][0].as_py()) << np.int64(32)
        return g.drop_columns("grp").append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("grp").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
