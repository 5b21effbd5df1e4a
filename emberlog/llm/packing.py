"""Packing documents into training sequences by swap-based local search.

Documents longer than a sequence are cut into full pieces, the first one shorter. Documents are dealt to groups of
about GROUP by a hash of their place in the table; each group is packed on its own, so the search is parallel, its
memory bounded, and no more than one sequence in thousands is lost at a group's edge.

A group's pieces are put into bins by best fit, once from the largest on and once as they come, and the better end of
two searches counts. The search empties bins: pieces of the least filled bin move to
other underfull bins, or are exchanged one for one, one for two or two for one with smaller ones there, always so that
the sum of squared fills grows. Changes that fill a bin to the last token are looked for first. Where no change helps,
a trade with a full bin fills the donor and leaves the same fill in smaller pieces, which fit into more gaps: the sum
of squared fills stays, that of squared pieces in underfull bins falls. Neither sum can change for ever, so the search
ends: when no underfull bin has a change or a trade any more, or when the rest of room is less than a bin. A bin that
runs empty is saved.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import document_columns, releasing, scratch, stored
from emberlog.llm.tokens import encoder

#: Documents that one task packs together.
GROUP = 8_192
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


def cut_pieces(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, the first shorter if n isn't a multiple of limit."""
    first = n % limit or min(n, limit)
    return [(0, first)] * (n > 0) + [(s, limit) for s in range(first, n, limit)]


def arrival_bins(sizes: list[int], limit: int) -> list[list[int]]:
    """Bins of indexes of sizes in the order of arrival; each piece goes to the fullest bin that has room for it."""
    bins: list[list[int]] = []
    with_gap: list[list[int]] = [[] for _ in range(limit + 1)]
    gaps = 0  # bit g is set if some bin has a gap of g
    for k, size in enumerate(sizes):
        if fits := gaps >> size:
            gap = size + (fits & -fits).bit_length() - 1
            b = with_gap[gap].pop()
            if not with_gap[gap]:
                gaps ^= 1 << gap
        else:
            gap, b = limit, len(bins)
            bins.append([])
        bins[b].append(k)
        with_gap[gap - size].append(b)
        gaps |= 1 << (gap - size)
    return bins


class LocalSearch:
    """Moves, exchanges and trades between the bins of one group.

    What a bin may give back for a piece or two is an offer: nothing, a piece or a pair of its pieces, equal sums once.
    Offers of underfull bins are rows of flat arrays, and by the sum that would fill the bin up in `fills`; pieces and
    pairs of full bins are in `full` by their sum. A bin that changed gets new offers and a new version; its old rows
    are dead, and its old entries are dropped where they are met. New rows stand at the end, so a donor that failed
    only looks at the rows written since.
    """

    def __init__(self, sizes: list[int], bins: list[list[int]], limit: int):
        self.sizes, self.limit = sizes, limit
        self.bins = {b: list(items) for b, items in enumerate(bins)}
        self.fill = {b: sum(sizes[k] for k in items) for b, items in self.bins.items()}
        self.version = dict.fromkeys(self.bins, 0)
        self.squares: dict[int, int] = {}  # of a full bin: the sum of its squared pieces
        self.fills: dict[int, list[tuple[int, int, int, int]]] = {}  # sum: bin, version, what it gives back, in how many pieces
        self.full: dict[int, list[tuple[int, int, int, int]]] = {}  # sum: bin, version, of how many pieces, their squares
        self.rows = np.zeros((4, 1_024), np.int32)  # bin, weight, the largest sum that may come for it (-1: dead), kind: 0, 1 or 2 pieces
        self.end = 0
        self.place: dict[int, tuple[int, int]] = {}
        self.seen = dict.fromkeys(self.bins, 0)  # the rows that a bin has looked at since it changed
        for b in self.bins:
            self._write(b)

    def _sums(self, b: int) -> tuple[list[int], list[int]]:
        """The different sizes of bin b's pieces, and the different sums of two of them."""
        own = Counter(self.sizes[k] for k in self.bins[b])
        return sorted(own), sorted({x + y for x, n in own.items() for y in own if y < x or (y == x and n > 1)})

    def _squares(self, items: list[int]) -> int:
        return sum(self.sizes[k] ** 2 for k in items)

    def _write(self, b: int) -> None:
        """Bin b has changed: what it offered is dead, and what it offers now is written."""
        start, end = self.place.pop(b, (0, 0))
        self.rows[2, start:end] = -1
        self.seen[b] = 0
        self.version[b] += 1
        if b not in self.bins:
            return
        gap, version = self.limit - self.fill[b], self.version[b]
        if not gap:
            self.squares[b] = self._squares(self.bins[b])
            own = Counter(self.sizes[k] for k in self.bins[b])
            for x, n in own.items():  # each different piece and pair once
                self.full.setdefault(x, []).append((b, version, 1, x * x))
                for y in own:
                    if y < x or (y == x and n > 1):
                        self.full.setdefault(x + y, []).append((b, version, 2, x * x + y * y))
            return
        ones, twos = self._sums(b)
        for kind, sums in enumerate(((0,), ones, twos)):
            for x in sums:
                self.fills.setdefault(x + gap, []).append((b, version, x, kind))
        weights = np.array([0, *ones, *twos], np.int32)
        if self.end + len(weights) > self.rows.shape[1]:
            self._make_room(len(weights))
        self.place[b] = self.end, self.end + len(weights)
        own = self.rows[:, self.end : self.end + len(weights)]
        own[0], own[1], own[2], own[3] = b, weights, weights + gap, 2
        own[3, 0], own[3, 1 : 1 + len(ones)] = 0, 1
        self.end += len(weights)

    def _make_room(self, n: int) -> None:
        """Drops dead rows; then as much room as the rest takes is free."""
        alive = self.rows[2, : self.end] >= 0
        before = np.concatenate([[0], np.cumsum(alive)])
        rest = self.rows[:, : self.end][:, alive]
        self.place = {b: (int(before[s]), int(before[e])) for b, (s, e) in self.place.items()}
        self.seen = {b: int(before[x]) for b, x in self.seen.items()}
        self.end = rest.shape[1]
        self.rows = np.zeros((4, 2 * (self.end + n)), np.int32)
        self.rows[:, : self.end] = rest

    def _shift(self, a: int, b: int, give: list[int], take: list[int]) -> None:
        """give goes from bin a to bin b, take from b to a."""
        for k in give:
            self.bins[a].remove(k)
            self.bins[b].append(k)
        for k in take:
            self.bins[b].remove(k)
            self.bins[a].append(k)
        change = sum(self.sizes[k] for k in give) - sum(self.sizes[k] for k in take)
        self.fill[a] -= change
        self.fill[b] += change
        self._write(a)
        self._write(b)

    def _pieces(self, b: int, total: int, n: int) -> list[int]:
        """n pieces of bin b that have this size together."""
        size, held = self.sizes, {}
        if n < 2:
            return [next(k for k in self.bins[b] if size[k] == total)] if n else []
        for k in self.bins[b]:
            if total - size[k] in held:
                return [held[total - size[k]], k]
            held[size[k]] = k
        raise ValueError("no such pieces")

    def _filling(self, donor: int) -> tuple[int, list[int], list[int]] | None:
        """The change with the largest gain among those that fill a bin to the last token.

        A change that moves d tokens from the donor to a bin raises the sum of squared fills by 2 d (the bin's fill -
        the donor's + d).
        """
        best, found = 0, None
        for n, sums in enumerate(self._sums(donor), 1):
            for x in sums:
                held = self.fills.get(x, ())
                alive = [e for e in held if self.version[e[0]] == e[1]]
                if len(alive) < len(held):
                    self.fills[x] = alive
                for b, _, back, kind in alive:
                    gain = (x - back) * (self.fill[b] - self.fill[donor] + x - back)
                    if b != donor and n + kind < 4 and x > back and gain > best:
                        best, found = gain, (b, x, n, back, kind)
        if not found:
            return None
        b, x, n, back, kind = found
        return b, self._pieces(donor, x, n), self._pieces(b, back, kind)

    def _best(self, donor: int) -> tuple[int, list[int], list[int]] | None:
        """The change with the largest gain among all that the rows not yet seen offer."""
        (ones, twos), start = self._sums(donor), self.seen[donor]
        of, weight, most, kind = self.rows[:, start : self.end]
        at = np.flatnonzero((most >= ones[0]) & (weight < (twos or ones)[-1]) & (of != donor))
        if not len(at):
            return None
        weight, most, single = weight[at], most[at], kind[at] < 2
        room, best, found = self.limit - (most - weight) - self.fill[donor], 0, None  # room: a bin's fill - the donor's
        for n, sums in enumerate((ones, twos), 1):
            for x in sums:
                d = (x - weight).astype(np.int64)
                may = (x <= most) & (d > 0)
                gain = np.where(may if n == 1 else may & single, d * (room + d), 0)
                if gain[k := int(gain.argmax())] > best:
                    best, found = int(gain[k]), (start + int(at[k]), n, x)
        if not found:
            return None
        k, n, given = found
        b, back, _, kind_back = self.rows[:, k].tolist()
        return b, self._pieces(donor, given, n), self._pieces(b, back, kind_back)

    def _trade(self, donor: int) -> tuple[int, list[int], list[int]] | None:
        """A trade that fills the donor from a full bin and leaves there the donor's fill in smaller pieces (by their squares)."""
        gap, own = self.limit - self.fill[donor], self._squares(self.bins[donor])
        for x in (0, *sorted({self.sizes[k] for k in self.bins[donor]})):
            held = self.full.get(gap + x, [])
            kept = len(held)
            for k in range(len(held) - 1, -1, -1):
                b, version, n, squares = held[k]
                if self.version[b] != version:
                    kept = k if kept == k + 1 else kept
                elif self.squares[b] - squares + x * x < own:
                    del held[kept:]
                    return b, self._pieces(donor, x, int(x > 0)), self._pieces(b, gap + x, n)
            del held[kept:]
        return None

    def run(self) -> list[list[int]]:
        """Bins after the search; in each round donors are tried from the least filled on, until a round changes nothing."""
        total, changed = sum(self.fill.values()), True
        while changed:
            changed, tried = False, set()
            queue = [(f, b) for b, f in self.fill.items() if f < self.limit]
            heapq.heapify(queue)
            while queue:
                if len(self.bins) * self.limit - total < self.limit:  # with less room than one bin in all, no bin can be saved
                    return list(self.bins.values())
                fill, donor = heapq.heappop(queue)
                if donor in tried or self.fill.get(donor) != fill:
                    continue
                tried.add(donor)
                while self.bins[donor] and (change := self._filling(donor) or self._best(donor)):
                    self._shift(donor, *change)
                    changed = True
                    if self.fill[change[0]] < self.limit and change[0] not in tried:
                        heapq.heappush(queue, (self.fill[change[0]], change[0]))
                self.seen[donor] = self.end
                if not self.bins[donor]:
                    del self.bins[donor], self.fill[donor]
                    self._write(donor)
                    del self.seen[donor]
                elif trade := self._trade(donor):
                    self._shift(donor, *trade)
                    changed = True
                    tried.discard(trade[0])
                    heapq.heappush(queue, (self.fill[trade[0]], trade[0]))
        return list(self.bins.values())


def decreasing_bins(sizes: list[int], limit: int) -> list[list[int]]:
    """arrival_bins of the sizes from the largest on: best fit decreasing."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    return [[order[k] for k in b] for b in arrival_bins([sizes[k] for k in order], limit)]


def pack_sizes(sizes: list[int], limit: int) -> list[list[int]]:
    """Bins of indexes of sizes (each from 1 to limit). Full pieces are bins of their own and take no part in the search.

    Neither start is always the better one: pieces in order of size leave fewer bins where many are large, in order of
    arrival where all are middling. So the search is made from both, unless the first one ends at the least number that
    there can be, and the one with fewer bins counts.
    """
    part = [k for k, s in enumerate(sizes) if s < limit]
    small = [sizes[k] for k in part]
    least, best = -(-sum(small) // limit), None
    for start in (decreasing_bins, arrival_bins):
        bins = LocalSearch(small, start(small, limit), limit).run()
        if best is None or len(bins) < len(best):
            best = bins
        if len(best) == least:
            break
    return [[k] for k, s in enumerate(sizes) if s == limit] + [[part[k] for k in b] for b in best]


def document_pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int) -> DataFrame:
    """One row for each piece of docs (doc_id, text): its place in the document, its length, the CRC-32 of its ids, and row, a number of its document."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        names = [*(x.split()[0] for x in PIECES.split(", ")), "row"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode_column(b.column("text")), strict=True):
                ids += tail
                row += 1
                for k, (s, n) in enumerate(cut_pieces(len(ids) // 4, limit)):
                    rows.append((doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), row))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)

    return document_columns(docs, "doc_id", "text").mapInArrow(releasing(pieces), PIECES + ", row bigint")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, limit: int = 1024, group: int = GROUP) -> DataFrame:
    """Pieces of docs (doc_id, text) with sequence_id and offset: where each stands in a sequence of at most limit tokens.

    Null text is empty and gives one piece, the end id. Null ids and repeated rows are documents of their own. Offsets
    of a sequence have no gaps. Further columns are ignored. An empty table gives no row.
    """
    spark = docs.sparkSession
    pieces = stored(document_pieces(docs, tokenizer, end_id, limit), f"{scratch(spark, 'packing')}/pieces")
    groups = max(1, -(-pieces.where("piece = 0").count() // group))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("row", "piece")])
        lengths, shard = rows["length"].to_pylist(), rows["shard"][0].as_py()
        at, sequence = [0] * len(lengths), [0] * len(lengths)
        for number, items in enumerate(pack_sizes(lengths, limit)):
            place = 0
            for k in items:
                at[k], sequence[k], place = place, (shard << 32) + number, place + lengths[k]
        return rows.drop_columns(["shard", "row"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(at, pa.int64()))

    # dealt by documents, not by ids: rows of one id, or of none, are spread like any others
    shard = F.pmod(F.xxhash64("row"), F.lit(groups))
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(pack, PACKED)
