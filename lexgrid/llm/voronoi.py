"""Exact Jaccard joins of regions of sets, by document pivots.

A region is a group of members (sets) of which any two may be linked: linked
if PERCENT * union <= 100 * intersection, so at a Jaccard distance of at most
EPSILON.  region_links() takes memberships, one row per member and region, and
returns links that connect whatever links inside the regions connect.

Regions of up to REGION members and ITEMS set elements are joined in one task:
small ones pair by pair, others recursively (see Region).  Members may name the
cells that brought them into their region; where only members of one cell are
to be compared, and no cell has more than CELL of them, pairs go by cells.

A larger region is dealt over as many tasks as it takes, and each of its
members is compared to the same PIVOTS members of it, one a bucket of a hash:
first members that no pivot is linked to yet, then those that share most with
the last pivots.  A pivot has then met all, and leaves.  Distances to pivots
part the rest.  By the triangle inequality, the least distance of two linked
members to any pivot differs by EPSILON at most, so both are within
T = 2 EPSILON, or both are beyond T - EPSILON:

- Within T, a member goes to the Voronoi region of its nearest pivot, and to
  each other one whose pivot is no more than 2 EPSILON farther: two linked
  members meet in the region of either's nearest pivot.  Pivots closer than
  MERGED to each other share a region.
- Beyond T - EPSILON, members are far from every pivot and the inequality says
  little.  They go to cells of single shingles: the first ones of each set, as
  many as two linked sets can't both miss, in an order that puts shingles of
  many pivots last.  So a passage that many members share makes no crowded
  cell.  Cells without a member beyond T are dropped.

The regions that this gives are joined in the next round.  Members linked to
the same pivot are in one component; a region of such members only is done.
A region that pivots have not parted TRIES times (sets that are all alike, but
not linked), or that is left after ROUNDS, is cut into blocks, and each pair of
blocks is one region: quadratic, but exact and in bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.shared import removed, staged
from lexgrid.llm.textscan import mix

#: Linked if PERCENT * union <= 100 * intersection.
PERCENT = 80
EPSILON = 1 - PERCENT / 100
REGION = 2048
ITEMS = 1 << 21
PIVOTS = 32
MERGED = 0.8
TRIES, ROUNDS = 2, 8
#: Members of a region that are compared pair by pair, and of one that recursion leaves whole.
SMALL, LEAF = 12, 96
#: Members of a cell up to which it is compared pair by pair.
CELL = 32
#: Set elements looked up at once.
CHUNK = 1 << 20
PART_BYTES = 1 << 20
_SLACK = 1e-9

#: Gives (rid, items, regions), one row for each rid, from (rid, regions); items holds the set in a form that Unpack reads.
Attach = Callable[[DataFrame], DataFrame]
#: Sets of a column: (unsigned hashes in ascending order, distinct in each row, bounds of the rows).
Unpack = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]

_OUT = "kind int, a bigint, b bigint, tag int, label bigint, score double, tries int, before bigint, cells array<bigint>, items binary"
_OUT_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
#: What a row of _OUT is: a link of a and b; a member a of the new region b; a member a of cells in the region b; the set of a.
LINK, CHILD, CELL, SET = 0, 1, 2, 3


def linked(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    return 100 * both >= PERCENT * (a + b - both)


def needed(n: np.ndarray) -> np.ndarray:
    """So many first elements of a set of n, in any order common to all sets: two linked sets can't have them all different."""
    return n - -(-n * PERCENT // 100) + 1


def members_of_cells(crowded: int):
    """(rid, pivot, crowded, tag) of the members of cells with two rids or more, from rows (cell, rid, tag) sorted by cell, rid.

    The pivot is the least rid of the cell.  A cell is streamed, never held, once it has more than `crowded` members.
    """
    names = ["rid", "pivot", "crowded", "tag"]
    none = np.zeros(0, dtype=np.int64)

    def out(rid: np.ndarray, pivot: np.ndarray, many: np.ndarray, tag: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(pivot), pa.array(many), pa.array(tag.astype(np.int32))], names=names)

    def closed(cell: np.ndarray, rid: np.ndarray, tag: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.RecordBatch:
        size = stops - starts
        of = np.repeat(np.arange(len(starts)), size)
        keep = size[of] > 1
        return out(rid[keep], rid[starts][of][keep], (size > crowded)[of][keep], tag[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (none, none, none)  # the rows of the last cell, if it isn't crowded yet
        crowd: tuple[int, int, int] | None = None  # cell, pivot and last rid of a crowded cell that may go on
        for batch in batches:
            if not len(batch):
                continue
            cell, rid, tag = (np.asarray(batch.column(c)).astype(np.int64) for c in ("cell", "rid", "tag"))
            if crowd is not None:
                same = cell == crowd[0]
                fresh = same & (rid != np.concatenate([[crowd[2]], rid[:-1]]))
                if fresh.any():
                    yield out(rid[fresh], np.full(fresh.sum(), crowd[1]), np.ones(fresh.sum(), dtype=bool), tag[fresh])
                if same.all():
                    crowd = (crowd[0], crowd[1], int(rid[-1]))
                    continue
                cell, rid, tag, crowd = cell[~same], rid[~same], tag[~same], None
            cell, rid, tag = (np.concatenate(x) for x in zip(held, (cell, rid, tag)))
            keep = np.ones(len(cell), dtype=bool)
            keep[1:] = (cell[1:] != cell[:-1]) | (rid[1:] != rid[:-1])
            cell, rid, tag = cell[keep], rid[keep], tag[keep]
            new = np.ones(len(cell), dtype=bool)
            new[1:] = cell[1:] != cell[:-1]
            starts = np.flatnonzero(new)
            last = starts[-1]
            if len(cell) - last > crowded:
                crowd = (int(cell[last]), int(rid[last]), int(rid[-1]))
                yield closed(cell, rid, tag, starts, np.append(starts[1:], len(cell)))
                held = (none, none, none)
            else:
                yield closed(cell[:last], rid[:last], tag[:last], starts[:-1], starts[1:])
                held = (cell[last:], rid[last:], tag[last:])
        if len(held[0]):
            yield closed(*held, np.zeros(1, dtype=np.int64), np.array([len(held[0])]))

    return run


class Sets:
    """Sets of some rows; `unique` and `rank` give them as ranks among all their elements."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray) -> None:
        self.values, self.bounds = values, bounds
        self.size = np.diff(bounds)
        self.bits = np.uint64(max(1, len(self.size).bit_length()))

    @cached_property
    def _ranked(self) -> tuple[np.ndarray, np.ndarray]:
        unique, rank = np.unique(self.values, return_inverse=True)
        return unique, rank.reshape(-1).astype(np.int64)

    @property
    def unique(self) -> np.ndarray:
        return self._ranked[0]

    @property
    def rank(self) -> np.ndarray:
        return self._ranked[1]

    def _keys(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """A row and the upper bits of a value: ascending over the sets."""
        return rows.astype(np.uint64) << (np.uint64(64) - self.bits) | values >> self.bits

    @cached_property
    def keys(self) -> np.ndarray:
        return self._keys(np.repeat(np.arange(len(self.size)), self.size), self.values)

    def both(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Intersection sizes of the rows of i with those of j."""
        swap = self.size[i] > self.size[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        out = np.empty(len(i), dtype=np.int64)
        ends = np.cumsum(self.size[i])
        at, last = 0, len(self.keys) - 1
        while at < len(i):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
            n = self.size[i[at:stop]]
            pair = np.repeat(np.arange(stop - at), n)
            value = self.values[self.bounds[i[at:stop]][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)]
            wanted = self._keys(j[at:stop][pair], value)
            place = np.searchsorted(self.keys, wanted)
            met = np.zeros(len(pair), dtype=bool)
            left = np.arange(len(pair))
            while len(left):  # more than once only where a set has values of the same upper bits
                now = place[left]
                left = left[(now <= last) & (self.keys[np.minimum(now, last)] == wanted[left])]
                same = self.values[place[left]] == value[left]
                met[left[same]] = True
                left = left[~same]
                place[left] += 1
            out[at:stop] = np.bincount(pair, met, stop - at).astype(np.int64)
            at = stop
        return out


def overlaps(rank: np.ndarray, owner: np.ndarray, n: int, others: list[np.ndarray], n_ranks: int) -> np.ndarray:
    """n x len(others) intersection sizes of the sets that `rank` and `owner` give with other sets of ranks."""
    out = np.empty((n, len(others)), dtype=np.int64)
    mark = np.zeros(n_ranks, dtype=bool)
    for k, other in enumerate(others):
        mark[other] = True
        out[:, k] = np.bincount(owner[mark[rank]], minlength=n)
        mark[other] = False
    return out


class Forest:
    """Components of a few members; links are kept only where they join two of them."""

    def __init__(self, rids: np.ndarray, label: np.ndarray | None = None) -> None:
        self.rids = rids
        self.of = np.arange(len(rids))
        self.links: list[tuple[int, int]] = []
        if label is not None and (label >= 0).any():
            _, first, place = np.unique(label, return_index=True, return_inverse=True)
            self.of = np.where(label >= 0, first[place.reshape(-1)], self.of)

    def join(self, i: int, others: np.ndarray) -> None:
        """Links i to others."""
        others = others[self.of[others] != self.of[i]]
        if len(others):
            names, first = np.unique(self.of[others], return_index=True)
            self.links += [(int(self.rids[i]), int(self.rids[j])) for j in others[first]]
            self.of[np.isin(self.of, names)] = self.of[i]


class Region:
    """Links that connect the members of one region, found recursively.

    Pivots make Voronoi cells; a member goes to the cell of its nearest pivot
    and to each other whose pivot is at most 2 EPSILON farther, and cells are
    joined in turn until they are small or pivots no longer part them.  Then
    members are counted against each other through the postings of their
    elements, unless they are in one component already.
    """

    def __init__(self, rids: np.ndarray, rank: np.ndarray, bounds: np.ndarray, label: np.ndarray | None = None) -> None:
        self.size = np.diff(bounds)
        self.forest = Forest(rids, label)
        kept, again, seen = np.unique(rank, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(rids)), self.size)
        # elements of one set only count for its size alone
        met = seen[again.reshape(-1)] > 1
        self.rank, self.n_ranks = again.reshape(-1)[met], len(kept)
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(owner[met], minlength=len(rids)))])
        self.seen = seen

    def set(self, i: int) -> np.ndarray:
        return self.rank[self.bounds[i] : self.bounds[i + 1]]

    def flat(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, place in members) of the members' elements."""
        n = self.bounds[members + 1] - self.bounds[members]
        owner = np.repeat(np.arange(len(members)), n)
        return self.rank[np.repeat(self.bounds[members] - (np.cumsum(n) - n), n) + np.arange(len(owner))], owner

    def able(self) -> np.ndarray:
        """Members that share enough of their set with the rest to have a link."""
        members = np.arange(len(self.size))
        for _ in range(4):  # each turn leaves out some that could have met those left out before; the rest is compared
            if len(members) < 2:
                break
            rank, owner = self.flat(members)
            again = np.bincount(rank, minlength=self.n_ranks)[rank] > 1
            keep = 100 * np.bincount(owner[again], minlength=len(members)) >= PERCENT * self.size[members]
            if keep.all():
                return members
            members = members[keep]
        return members

    def links(self) -> list[tuple[int, int]]:
        self.join(self.able())
        return self.forest.links

    def join(self, members: np.ndarray) -> None:
        if len(members) < 2 or (self.forest.of[members] == self.forest.of[members[0]]).all():
            return
        if len(members) <= LEAF:
            return self._compare(members)
        rank, owner = self.flat(members)
        common = np.bincount(owner, self.seen[rank], len(members)) / self.size[members]
        at = np.unique(np.append(np.linspace(0, len(members) - 1, 7).astype(int), common.argmax()))
        both = overlaps(rank, owner, len(members), [self.set(m) for m in members[at]], self.n_ranks)
        a, b = self.size[members][:, None], self.size[members[at]][None, :]
        near_enough = linked(both, a, b)
        for k, p in enumerate(members[at]):
            self.forest.join(int(p), members[near_enough[:, k]])
        d = 1 - both / (a + b - both)
        home, near = d.argmin(axis=1), d.min(axis=1)
        inside = [d[:, k] <= np.where(home == k, 1, near + 2 * EPSILON + _SLACK) for k in range(len(at)) if (home == k).any()]
        if max(x.sum() for x in inside) > 0.7 * len(members) or sum(x.sum() for x in inside) > 2 * len(members):
            self._compare(members)  # these pivots do not part the region
        else:
            for x in inside:
                self.join(members[x])

    def _compare(self, members: np.ndarray) -> None:
        order = members[np.argsort(self.size[members], kind="stable")]
        rank, owner = self.flat(order)
        by = np.argsort(rank, kind="stable")
        posting = owner[by]
        ends = np.cumsum(np.bincount(rank, minlength=self.n_ranks))
        begins = np.concatenate([[0], ends[:-1]])
        size, of = self.size[order], self.forest.of
        for i in range(len(order) - 1):
            stop = int(np.searchsorted(size, size[i] * 100 // PERCENT, side="right"))
            if (of[order[i + 1 : stop]] == of[order[i]]).all():
                continue
            mine = self.set(int(order[i]))
            n = ends[mine] - begins[mine]
            places = np.repeat(begins[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(posting[places], minlength=len(order))[i + 1 : stop]
            found = i + 1 + np.flatnonzero(linked(both, size[i], size[i + 1 : stop]))
            if len(found):
                self.forest.join(int(order[i]), order[found])
                of = self.forest.of


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a (region, salt) ends."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.concat_batches(held)

    for batch in batches:
        if not len(batch):
            continue
        region, salt = np.asarray(batch.column("region")), np.asarray(batch.column("salt"))
        new = np.ones(len(batch), dtype=bool)
        new[1:] = (region[1:] != region[:-1]) | (salt[1:] != salt[:-1])
        if held:
            end = held[-1]
            new[0] = (end.column("region")[len(end) - 1].as_py(), end.column("salt")[len(end) - 1].as_py()) != (region[0], salt[0])
        starts = np.flatnonzero(new)
        if len(starts):
            at = int(starts[-1])
            held.append(batch.slice(0, at))
            if sum(map(len, held)):
                yield joined()
            held = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        yield joined()


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of whole groups in pieces of about PART_BYTES of items, cut between groups."""
    region, salt = np.asarray(batch.column("region")), np.asarray(batch.column("salt"))
    new = np.ones(len(batch), dtype=bool)
    new[1:] = (region[1:] != region[:-1]) | (salt[1:] != salt[:-1])
    starts = np.flatnonzero(new)
    before = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(batch.column("items"))).astype(np.int64))])
    piece = before[starts] // PART_BYTES
    cuts = starts[np.append(True, piece[1:] != piece[:-1])].tolist()
    for a, b in zip(cuts, [*cuts[1:], len(batch)]):
        yield batch.slice(a, b - a)


class _Task:
    """What one batch of whole (region, salt) groups gives, as rows of _OUT."""

    def __init__(self, batch: pa.RecordBatch, unpack: Unpack) -> None:
        region, salt, rid = (np.asarray(batch.column(c)).astype(np.int64) for c in ("region", "salt", "rid"))
        keep = np.ones(len(batch), dtype=bool)
        keep[1:] = (region[1:] != region[:-1]) | (salt[1:] != salt[:-1]) | (rid[1:] != rid[:-1])
        batch = batch.filter(pa.array(keep))
        self.region, self.rid = region[keep], rid[keep]
        salt = salt[keep]
        self.mode, self.role, self.tries, self.count = (np.asarray(batch.column(c)).astype(np.int64) for c in ("mode", "role", "tries", "count"))
        # labels are pivots' ids and may be negative: ranks serve for them
        label = batch.column("label")
        known, place = np.unique(np.asarray(label.fill_null(0)), return_inverse=True)
        self.label_ids, self.label = known, np.where(np.asarray(label.is_null()), -1, place.reshape(-1))
        self.score = np.asarray(batch.column("score").fill_null(0.0))
        self.items, self.cells = batch.column("items"), batch.column("cells")
        self.sets = Sets(*unpack(self.items))
        new = np.ones(len(self.rid), dtype=bool)
        new[1:] = (self.region[1:] != self.region[:-1]) | (salt[1:] != salt[:-1])
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.starts, len(self.rid)))

    def rows(self) -> Iterator[pa.RecordBatch]:
        compared = self.mode[self.starts] != 1
        i, j, celled = self._by_cells()
        yield self._links(*self._verified(i, j))
        compared &= ~celled
        small = compared & (self.sizes <= SMALL)
        yield self._links(*self._small(self.starts[small], self.sizes[small]))
        for a, n in zip(self.starts[compared & ~small].tolist(), self.sizes[compared & ~small].tolist()):
            at = self.sets.bounds[a : a + n + 1]
            got = Region(self.rid[a : a + n], self.sets.rank[at[0] : at[-1]], at - at[0], self.label[a : a + n]).links()
            if got:
                yield self._links(*(np.array(x) for x in zip(*got)))
        pivoted = self.mode[self.starts] == 1
        for a, n in zip(self.starts[pivoted].tolist(), self.sizes[pivoted].tolist()):
            yield from self._pivoted(a, a + n)

    @staticmethod
    def _batch(kind: int, a, b=None, tag=None, label=None, score=None, tries=None, before=None, cells=None, items=None) -> pa.RecordBatch:
        full = lambda x, t: pa.nulls(len(a), t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t)
        columns = [full(np.full(len(a), kind), _OUT_TYPES[0]), *(full(x, t) for x, t in zip((a, b, tag, label, score, tries, before, cells, items), _OUT_TYPES[1:]))]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _OUT.split(", ")])

    def _links(self, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return self._batch(LINK, a, b)

    def _small(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of small groups: all their pairs whose sizes and labels allow one."""
        i, j = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for n in np.unique(sizes).tolist():
            x, y = np.triu_indices(n, 1)
            at = starts[sizes == n][:, None]
            i.append((at + x).ravel())
            j.append((at + y).ravel())
        return self._verified(np.concatenate(i), np.concatenate(j))

    def _by_cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of members that share a cell, and which groups these are all pairs of: those whose members name cells, none of them large."""
        none = np.zeros(0, dtype=np.int64)
        group = np.repeat(np.arange(len(self.starts)), self.sizes)
        named = self.cells.is_valid()
        if not len(group) or not pc.any(named).as_py():
            return none, none, np.zeros(len(self.starts), dtype=bool)
        member = np.repeat(np.arange(len(group)), np.asarray(self.cells.value_lengths().fill_null(0)))
        cell = np.asarray(self.cells.flatten()).astype(np.int64)
        celled = np.logical_and.reduceat(np.asarray(named), self.starts)
        order = np.lexsort((member, cell, group[member]))
        member, cell = member[order], cell[order]
        new = np.ones(len(cell), dtype=bool)
        new[1:] = (cell[1:] != cell[:-1]) | (group[member][1:] != group[member][:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(cell)))
        celled[group[member[starts[sizes > CELL]]]] = False
        keep = celled[group[member[starts]]]
        i, j = [none], [none]
        for n in np.unique(sizes[keep]).tolist():
            x, y = np.triu_indices(n, 1)
            at = starts[keep & (sizes == n)][:, None]
            i.append(member[(at + x).ravel()])
            j.append(member[(at + y).ravel()])
        pair = np.unique(np.concatenate(i) * len(group) + np.concatenate(j))
        return pair // len(group), pair % len(group), celled

    def _verified(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, x, y = self.sets.size[i], self.sets.size[j], self.label[i], self.label[j]
        keep = (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)) & ((x < 0) | (x != y))
        i, j = i[keep], j[keep]
        if len(i):
            ok = linked(self.sets.both(i, j), self.sets.size[i], self.sets.size[j])
            i, j = i[ok], j[ok]
        return self.rid[i], self.rid[j]

    def _pivoted(self, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        """Links to the pivots, and the regions and cells that the members go to."""
        bounds = self.sets.bounds[start : stop + 1]
        rank, bounds = self.sets.rank[bounds[0] : bounds[-1]], bounds - bounds[0]
        size = np.diff(bounds)
        owner = np.repeat(np.arange(len(size)), size)
        rid, n_pivots = self.rid[start:stop], int((self.role[start:stop] == 0).sum())
        pivot_sets = [rank[bounds[k] : bounds[k + 1]] for k in range(n_pivots)]
        both = overlaps(rank, owner, len(size), pivot_sets, len(self.sets.unique))
        union = size[:, None] + size[None, :n_pivots] - both
        near_enough, d = linked(both, size[:, None], size[None, :n_pivots]), 1 - both / union
        forest = Forest(rid)
        by_score = np.lexsort((rid[:n_pivots], -self.score[start : start + n_pivots]))
        for k in by_score.tolist():
            forest.join(k, np.flatnonzero(near_enough[:, k]))
        if forest.links:
            yield self._links(*(np.array(x) for x in zip(*forest.links)))
        if n_pivots == len(size):
            return
        rest = np.arange(n_pivots, len(size))
        yield self._batch(SET, rid[rest], items=self.items.slice(start + n_pivots, len(rest)))
        region, count, tries = self.region[start], self.count[start], self.tries[start]
        best = by_score[near_enough[rest][:, by_score].argmax(axis=1)]
        own = near_enough[rest].any(axis=1)
        inherited = self.label[start:stop][rest]
        labels = pa.array(np.where(own, rid[best], self.label_ids[np.maximum(inherited, 0)]), mask=~own & (inherited < 0))
        meets = np.zeros(len(self.sets.unique), dtype=np.int64)
        for p in pivot_sets:
            meets[p] += 1
        score = (np.bincount(owner, meets[rank], len(size)) / size)[rest]
        near = d[rest].min(axis=1)
        inner = near <= 2 * EPSILON + _SLACK
        for name, group in self._clusters(d[:n_pivots], rid[:n_pivots]):
            inside = inner & (d[rest][:, group] <= near[:, None] + 2 * EPSILON + _SLACK).any(axis=1)
            if inside.any():
                at = rest[inside]
                child = mix(np.full(len(at), mix(np.array([region], dtype=np.int64).view(np.uint64))[0]) + np.array([name], dtype=np.int64).view(np.uint64)).view(np.int64)
                yield self._batch(CHILD, rid[at], child, 2 * np.minimum(size[at], 1 << 29) + 1, labels.filter(pa.array(inside)), score[inside], np.full(len(at), tries), np.full(len(at), count))
        outer = rest[near > EPSILON - _SLACK]
        if len(outer):
            is_inner = np.zeros(len(size), dtype=bool)
            is_inner[rest[inner]] = True
            mine = np.isin(owner, outer)
            e_rank, e_owner = rank[mine], owner[mine]
            order = np.lexsort((self.sets.unique[e_rank], meets[e_rank], e_owner))
            e_rank, e_owner = e_rank[order], e_owner[order]
            place = np.arange(len(e_owner)) - np.searchsorted(e_owner, e_owner)
            keep = place < needed(size[e_owner])
            e_rank, e_owner = e_rank[keep], e_owner[keep]
            cell = mix(self.sets.unique[e_rank] ^ mix(np.array([region], dtype=np.int64).view(np.uint64))[0]).view(np.int64)
            heads = np.flatnonzero(np.append(True, e_owner[1:] != e_owner[:-1]))
            of = e_owner[heads]
            cells = pa.ListArray.from_arrays(pa.array(np.append(heads, len(cell)), pa.int32()), pa.array(cell))
            yield self._batch(CELL, rid[of], np.full(len(of), region), 2 * np.minimum(size[of], 1 << 29) + ~is_inner[of], cells=cells)

    @staticmethod
    def _clusters(d: np.ndarray, rid: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(least rid, places) of the pivots that chains of distances up to MERGED connect."""
        near = d[:, : len(rid)] <= MERGED
        of = np.arange(len(rid))
        while True:
            low = np.where(near, of[None, :], len(rid)).min(axis=1)
            if (low == of).all():
                break
            of = low
        return [(int(rid[of == c].min()), np.flatnonzero(of == c)) for c in np.unique(of)]


def _dealt(members: DataFrame, turn: int, blocks: bool) -> DataFrame:
    """(rid, regions): where each member goes, as structs of region, salt, mode (0 whole, 1 pivots, 2 blocks), role and what members carry."""
    size = members.groupBy("region").agg(
        F.count("*").alias("count"), F.sum(F.shiftright("tag", 1)).alias("items"), F.count("label").alias("labelled"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.max(F.col("tag").bitwiseAND(1)).alias("core"), F.max("before").alias("before"), F.max("tries").alias("past"),
    ).where("count > 1 and core = 1 and not (labelled = count and low = high)")
    large = (F.col("count") > 2) & ((F.col("count") > REGION) | (F.col("items") > ITEMS))
    tries = F.when(F.col("count") > 0.7 * F.col("before"), F.col("past") + 1).otherwise(0)
    size = size.withColumn("now", tries).select(
        "region", "count", F.col("now").alias("tries"), F.when(~large, 0).when(F.lit(blocks) | (F.col("now") >= TRIES), 2).otherwise(1).alias("mode"),
        F.ceil(F.greatest(F.col("count") / REGION, F.col("items") / ITEMS)).cast("int").alias("parts"),
    )
    dealt = members.select("rid", "region", "tag", "label", "score", "cells").join(size, "region")
    bucket = F.pmod(F.xxhash64("rid", "region", F.lit(turn)), F.lit(PIVOTS))
    first = F.struct(F.col("label").isNotNull().alias("met"), (-F.coalesce("score", F.lit(0.0))).alias("score"), F.xxhash64("rid", F.lit(turn)).alias("by"), "rid")
    # from all members, so that the minimum is taken before a shuffle: a large region comes to PIVOTS rows a task
    pivots = members.groupBy("region", bucket.alias("bucket")).agg(F.min(first).alias("first"))
    pivots = pivots.join(size.where("mode = 1").select("region"), "region").select("region", F.col("first.rid").alias("rid"), F.lit(True).alias("pivot"))
    dealt = dealt.join(pivots, ["region", "rid"], "left")
    one = lambda n: F.pmod(F.xxhash64("rid", F.lit("deal")), n).cast("int")
    n_blocks = 2 * F.col("parts")
    block = one(n_blocks)
    other = F.filter(F.sequence(F.lit(0), n_blocks - 1), lambda o: o != block)
    salts = (
        F.when(F.col("mode") == 0, F.array(F.lit(0)))
        .when(F.col("mode") == 2, F.transform(other, lambda o: F.least(block, o) * n_blocks + F.greatest(block, o)))
        .when(F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1))
        .otherwise(F.array(one(F.col("parts"))))
    )
    role = F.when(F.col("pivot"), 0).otherwise(1)
    cells = F.when(F.col("mode") == 0, F.col("cells"))
    carried = F.struct("region", "salt", "mode", role.alias("role"), "label", "score", "tries", "count", cells.alias("cells"))
    return dealt.withColumn("salt", F.explode(salts)).groupBy("rid").agg(F.collect_list(carried).alias("regions"))


def _joined(members: DataFrame, attach: Attach, unpack: Unpack, turn: int, blocks: bool) -> DataFrame:
    """Rows of _OUT from one round over members (rid, region, tag, label, score, tries, before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches):
            for part in _parts(batch):
                yield from _Task(part, unpack).rows()

    shipped = attach(_dealt(members, turn, blocks)).select("rid", "items", F.explode("regions").alias("x")).select("rid", "items", "x.*")
    return shipped.repartition("region", "salt").sortWithinPartitions("region", "salt", "role", "rid").mapInArrow(run, _OUT)


def region_links(members: DataFrame, attach: Attach, unpack: Unpack) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): links that connect all members (rid, region, n) that links inside the regions connect; and the staged tables behind it.

    n is the size of the member's set, about.  A column cells (array of longs)
    says that only members with a common cell need a link.
    """
    fresh = [F.lit(None).cast(t).alias(c) for c, t in (("label", "bigint"), ("score", "double"), ("tries", "int"), ("before", "bigint"), ("cells", "array<bigint>"))]
    tag = (2 * F.least("n", F.lit(1 << 29)) + 1).cast("int").alias("tag")
    own = fresh if "cells" not in members.columns else [*fresh[:-1], F.col("cells")]
    members = staged(members.select("rid", "region", tag, *own), "members", free=True)
    tables: list[DataFrame] = []
    turn = 0
    while True:
        got = staged(_joined(members, attach, unpack, turn, turn >= ROUNDS), "links", free=True)
        tables.append(got)
        removed(got.sparkSession, members)
        turn += 1
        if got.where(F.col("kind") != LINK).isEmpty():
            break
        children = got.where(F.col("kind") == CHILD).select(F.col("a").alias("rid"), F.col("b").alias("region"), "tag", "label", "score", "tries", "before", fresh[-1])
        far = got.where(F.col("kind") == CELL).select(F.col("b").alias("region"), F.col("a").alias("rid"), "tag", "cells")
        cored = far.groupBy("region").agg(F.max(F.col("tag").bitwiseAND(1)).alias("core")).where("core = 1").select("region")
        cells = far.join(cored, "region").select(F.explode("cells").alias("cell"), "rid", "tag")
        met = cells.repartition("cell").sortWithinPartitions("cell", "rid").mapInArrow(members_of_cells(REGION), "rid bigint, pivot bigint, crowded boolean, tag int")
        region = F.xxhash64(F.lit("cells"), F.lit(turn), "pivot").alias("region")
        far = met.groupBy("rid", region).agg(F.max("tag").alias("tag")).select("rid", "region", "tag", *fresh)
        members = staged(children.unionByName(far), "members")
        attach = _held(got)
    links = tables[0]
    for t in tables[1:]:
        links = links.unionByName(t)
    return links.where(F.col("kind") == LINK).select("a", "b"), tables


def _held(got: DataFrame) -> Attach:
    """Sets from the last round's output, which holds those of all members of its large regions."""
    sets = got.where(F.col("kind") == SET).groupBy(F.col("a").alias("rid")).agg(F.min("items").alias("items"))
    return lambda each: sets.join(each, "rid")
