"""A prefix tree of sets, and its traversal with many probes at once (helper of the n-gram Jaccard join, no Spark in it).

All sets of a tree have one order of their shingles: those that more of the sets hold come first, so that near copies run along
one path until they differ. The tree is walked once for all probes together. What a probe has in common with a path is counted
once for all sets below it; a probe leaves a subtree as soon as the shingles that can still follow, on either side, no longer
reach the overlap that the shortest set below it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEP = 128  # shingles counted at a time, below 256 so that a sum fits a byte


def needed_overlap(a, b):
    """Least intersection of sets of these sizes with 100 * intersection >= 80 * union."""
    return -(-4 * (a + b) // 9)


@dataclass(frozen=True)
class Limits:
    sets: int = 512
    shingles: int = 1 << 19


class Sets:
    """Sets of shingle hashes, each with its weight (how many rows have it), and how many links each has been found to have."""

    def __init__(self, sets: list[np.ndarray], weights: list[int]):
        self.sets, self.weights = sets, np.array(weights, np.int64)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.links = np.zeros(len(sets), np.int64)

    def parts(self, limits: Limits) -> list[np.ndarray]:
        """Numbers of the sets in runs of bounded size, one set at least."""
        out, run, held = [], [], 0
        for i, n in enumerate(self.sizes.tolist()):
            if run and (len(run) >= limits.sets or held + n > limits.shingles):
                out.append(np.array(run))
                run, held = [], 0
            run.append(i)
            held += n
        return out + [np.array(run)] if run else out


class _Tree:
    """Sorted sequences; what neighbours share is a path of the tree. Shingles that no probe holds are left out."""

    def __init__(self, mine: list[np.ndarray], theirs: list[np.ndarray], same: bool):
        owner = np.repeat(np.arange(len(mine)), [len(s) for s in mine])
        other = np.repeat(np.arange(len(theirs)), [len(s) for s in theirs])
        own = np.concatenate(mine)
        values, place, times = np.unique(own if same else np.concatenate([own, *theirs]), return_inverse=True, return_counts=True)
        if same:
            shared, probe_place = times > 1, place
        else:
            place, probe_place = place[: len(own)], place[len(own) :]
            shared = np.zeros(len(values), bool)
            shared[place] = True
            seen = np.zeros(len(values), bool)
            seen[probe_place] = True
            shared &= seen
        order = np.flatnonzero(shared)
        order = order[np.argsort(-times[order], kind="stable")]  # ties by hash: `values` are sorted
        rank = np.full(len(values), -1, np.int64)
        rank[order] = np.arange(len(order))
        keep = rank[place] >= 0
        keyed = np.sort(owner[keep] * (len(order) + 1) + rank[place][keep])
        lengths = np.bincount(owner[keep], minlength=len(mine))
        sequences = np.split((keyed % (len(order) + 1)).astype(np.int32), np.cumsum(lengths)[:-1])
        self.members = np.array(sorted(range(len(mine)), key=lambda i: sequences[i].astype(">i4").tobytes()))
        self.sequences = [sequences[i] for i in self.members]
        self.lengths = lengths[self.members]
        self.forks = np.zeros(len(mine), np.int64)  # how much a sequence shares with the one before it
        for i in range(1, len(mine)):
            a, b = self.sequences[i - 1], self.sequences[i]
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            self.forks[i] = differ.argmax() if differ.any() else n
        hold = rank[probe_place] >= 0
        self.probes = np.zeros((len(order), len(theirs)), np.uint8)
        self.probes[rank[probe_place][hold], other[hold]] = 1
        self.probe_lengths = np.bincount(other[hold], minlength=len(theirs))

    def matches(self, sizes: np.ndarray, probe_sizes: np.ndarray):
        """(member, its probes with enough overlap) of every member that has some; `sizes` of whole sets."""
        sizes = sizes[self.members]
        everyone = np.arange(self.probes.shape[1])
        todo = [(0, len(sizes), 0, everyone, np.zeros(len(everyone), np.int64))]
        while todo:
            low, high, depth, active, overlap = todo.pop()
            path = self.sequences[low]
            end = len(path) if high - low == 1 else int(self.forks[low + 1 : high].min())
            need = needed_overlap(probe_sizes[active], sizes[low:high].min())
            longest = self.lengths[low:high].max()
            while True:
                keep = overlap + np.minimum(longest - depth, self.probe_lengths[active] - overlap) >= need
                if not keep.all():
                    active, overlap, need = active[keep], overlap[keep], need[keep]
                if depth == end or not len(active):
                    break
                part = path[depth : min(end, depth + STEP)]
                if 4 * len(active) > len(everyone):
                    gained = np.add.reduce(self.probes[part], axis=0, dtype=np.uint8)[active]
                else:
                    gained = np.add.reduce(self.probes[part[:, None], active], axis=0, dtype=np.uint8)
                overlap, depth = overlap + gained, depth + len(part)
            if not len(active):
                continue
            if high - low == 1:
                yield int(self.members[low]), active[overlap >= needed_overlap(probe_sizes[active], sizes[low])]
            else:
                cuts = [low, *(low + 1 + np.flatnonzero(self.forks[low + 1 : high] == end)).tolist(), high]
                todo += [(a, b, depth, active, overlap) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def join_sets(left: Sets, right: Sets | None = None, limits: Limits = Limits()) -> list[tuple[int, int]]:
    """Add the links of every pair to the sets, and give enough of the pairs to join what all of them join.

    Without `right` the pairs are those within `left`. A link to a set counts as often as its weight says. The pairs given are
    numbers of sets; those of `right` follow those of `left`.
    """
    other, base = (left, 0) if right is None else (right, len(left.sets))
    label = np.arange(base + len(other.sets))
    forest: list[tuple[int, int]] = []
    mine, theirs = left.parts(limits), other.parts(limits)
    for i, a in enumerate(mine):
        for b in theirs[i:] if right is None else theirs:
            same = right is None and b is theirs[i]
            tree = _Tree([left.sets[k] for k in a], [other.sets[k] for k in b], same)
            for x, found in tree.matches(left.sizes[a], other.sizes[b]):
                found = found[found > x] if same else found
                if not len(found):
                    continue
                x, ys = a[x], b[found]
                left.links[x] += other.weights[ys].sum()
                other.links[ys] += left.weights[x]
                labels, first = np.unique(label[base + ys], return_index=True)
                fresh = labels != label[x]
                if fresh.any():
                    forest += [(int(x), int(base + ys[k])) for k in first[fresh]]
                    label[np.isin(label, labels)] = label[x]
    return forest
