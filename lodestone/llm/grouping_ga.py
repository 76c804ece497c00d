"""A grouping genetic algorithm for bin packing: one island's work, in plain Python.

Items are given by length, in descending order; a solution is a list of bins of item positions. Crossover injects well-filled
bins of one parent whole into the other and removes the bins that then hold an item twice. Mutation dissolves the emptiest bins and a few others. The
displaced items of both come back in two steps: first one or two of them replace one or two items of a bin where that fills the bin better
(its items are displaced in turn), then best fit in descending order places the rest.

Bins that a start has filled to the brim can be set aside (`settle`, a share of them by chance), so a large instance is evolved where there is something to gain.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np


@dataclass
class Solution:
    bins: list[list[int]]
    fills: list[int]

    def fitness(self) -> tuple[int, int]:
        """Fewer bins first, then fuller ones."""
        return len(self.bins), -sum(f * f for f in self.fills)

    def genome(self, n: int) -> bytes:
        """Each item's bin."""
        out = np.empty(n, "<i4")
        for k, b in enumerate(self.bins):
            out[b] = k
        return out.tobytes()


def from_genome(genome: bytes, lengths: list[int]) -> Solution:
    of = np.frombuffer(genome, "<i4")
    bins: list[list[int]] = [[] for _ in range(int(of.max(initial=-1)) + 1)]
    for item, k in enumerate(of.tolist()):
        bins[k].append(item)
    return Solution(bins, [sum(lengths[i] for i in b) for b in bins])


def best_fit(solution: Solution, items: list[int], lengths: list[int], capacity: int) -> Solution:
    """Put items, in the order given, each into the fullest bin with room; changes the solution's bins."""
    bins, fills = solution.bins, solution.fills
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0  # bit g: some bin has room for exactly g
    for k, f in enumerate(fills):
        by_gap[capacity - f].append(k)
        open_gaps |= 1 << (capacity - f)
    for item in items:
        size = lengths[item]
        fits = open_gaps >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            k = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps &= ~(1 << gap)
            bins[k].append(item)
            fills[k] += size
        else:
            gap, k = capacity, len(bins)
            bins.append([item])
            fills.append(size)
        left = gap - size
        by_gap[left].append(k)
        open_gaps |= 1 << left
    return solution


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Bins that any packing needs: the volume, and for each threshold the large items with what small ones can't share their gaps."""
    sizes = np.asarray(lengths, np.int64)
    if not len(sizes):
        return 0
    best = -(-int(sizes.sum()) // capacity)
    for small in np.unique(sizes[sizes <= capacity // 2]).tolist() or [0]:
        huge, large = sizes > capacity - small, (sizes > capacity // 2) & (sizes <= capacity - small)
        rest = int(sizes[(sizes >= small) & (sizes <= capacity // 2)].sum()) - int((capacity - sizes[large]).sum())
        best = max(best, int(huge.sum() + large.sum()) + max(0, -(-rest // capacity)))
    return best


def replace(solution: Solution, items: list[int], lengths: list[int], capacity: int, rng: random.Random) -> list[int]:
    """Fill bins better by exchanging one or two of their items for displaced ones, in place; gives back what is displaced then, in order of position."""
    if not items:
        return []
    free = sorted((lengths[i], i) for i in items)
    sizes = [x for x, _ in free]
    order = [k for k, f in enumerate(solution.fills) if f < capacity]
    rng.shuffle(order)

    def give(old: tuple[int, ...], new: list[int]) -> None:
        own = solution.bins[k]
        for i in old:
            own.remove(i)
        for at in sorted(new, reverse=True):
            own.append(free.pop(at)[1])
            sizes.pop(at)
        for i in old:
            at = bisect_right(sizes, lengths[i])
            sizes.insert(at, lengths[i])
            free.insert(at, (lengths[i], i))

    for k in order:
        gap = capacity - solution.fills[k]
        own = solution.bins[k]
        best, old, new = 0, (), []
        outs = [(lengths[i], (i,)) for i in own]
        if len(own) <= 6:
            outs += [(lengths[i] + lengths[j], (i, j)) for n, i in enumerate(own) for j in own[:n]]
        for size, out in outs:  # one displaced item for one or two of the bin's
            at = bisect_right(sizes, size + gap) - 1
            if at >= 0 and sizes[at] - size > best:
                best, old, new = sizes[at] - size, out, [at]
                if best == gap:
                    break
        if best < gap and len(sizes) > 1:  # two displaced items for one or two
            for size, out in outs:
                room = size + gap
                top = bisect_left(sizes, room)
                for one in range(top) if top <= 12 else [rng.randrange(top) for _ in range(8)]:
                    two = bisect_right(sizes, room - sizes[one]) - 1
                    if two == one:
                        two -= 1
                    if two >= 0 and sizes[one] + sizes[two] - size > best:
                        best, old, new = sizes[one] + sizes[two] - size, out, [one, two]
                if best == gap:
                    break
        if best > 0:
            give(old, new)
            solution.fills[k] += best
    return sorted(i for _, i in free)


def crossover(into: Solution, donor: Solution, lengths: list[int], capacity: int, rng: random.Random) -> Solution:
    full = sorted(range(len(donor.bins)), key=lambda k: (-donor.fills[k], rng.random()))[: max(1, len(donor.bins) // 2)]
    given = [k for k in full if rng.random() < 0.5] or full[:1]
    return inject(into, [donor.bins[k] for k in given], lengths, capacity, rng)


def inject(into: Solution, given: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> Solution:
    """A solution with the given bins first; others that hold an item of theirs are dissolved."""
    taken = {i for b in given for i in b}
    bins, fills, displaced = [list(b) for b in given], [sum(lengths[i] for i in b) for b in given], []
    for b, f in zip(into.bins, into.fills, strict=True):
        if taken.isdisjoint(b):
            bins.append(list(b))
            fills.append(f)
        else:
            displaced += [i for i in b if i not in taken]
    out = Solution(bins, fills)
    return best_fit(out, replace(out, displaced, lengths, capacity, rng), lengths, capacity)


def mutate(of: Solution, lengths: list[int], capacity: int, rng: random.Random) -> Solution:
    order = sorted(range(len(of.bins)), key=of.fills.__getitem__)
    gone = {*order[: max(2, len(order) // 50)], *rng.sample(order, min(len(order), 2 + len(order) // 20))}
    out = Solution([list(b) for k, b in enumerate(of.bins) if k not in gone], [f for k, f in enumerate(of.fills) if k not in gone])
    loose = replace(out, sorted(i for k in gone for i in of.bins[k]), lengths, capacity, rng)
    if rng.random() < 0.5:  # near the descending order, but not quite
        loose.sort(key=lambda i: -lengths[i] * rng.uniform(0.85, 1.0))
    return best_fit(out, loose, lengths, capacity)


def evolve(lengths: list[int], capacity: int, immigrants: list[bytes], population: int, generations: int, seed: int, settle: float = 0.0) -> list[Solution]:
    """The island's population, the fittest first. lengths in descending order; ends at once when a solution meets the lower bound.

    A generation has half as many children as the population, one in three of them by mutation; the fittest of old and new live on. settle: the share of the first
    solution's full bins that are set aside."""
    rng, n = random.Random(seed), len(lengths)
    least = lower_bound(lengths, capacity)
    people = [from_genome(g, lengths) for g in immigrants] or [best_fit(Solution([], []), list(range(n)), lengths, capacity)]
    people.sort(key=Solution.fitness)
    if len(people[0].bins) <= least:
        return people
    aside = [b for b, f in zip(people[0].bins, people[0].fills, strict=True) if f == capacity and rng.random() < settle]
    if aside:
        first, *others = people
        done = {i for b in aside for i in b}
        rest = [i for i in range(n) if i not in done]
        new = {i: k for k, i in enumerate(rest)}
        part = lambda x: Solution([[new[i] for i in b] for b in x.bins if b[0] in new], [f for b, f in zip(x.bins, x.fills, strict=True) if b[0] in new])
        inner = [part(first), *(part(inject(x, aside, lengths, capacity, rng)) for x in others)]
        own = [lengths[i] for i in rest]
        grown = _grow(inner, own, capacity, population, generations, max(least - len(aside), lower_bound(own, capacity)), rng)
        whole = [Solution([list(b) for b in aside] + [[rest[i] for i in b] for b in x.bins], [capacity] * len(aside) + x.fills) for x in grown]
        return sorted([*whole, first], key=Solution.fitness)[:population]
    return _grow(people, lengths, capacity, population, generations, least, rng)


def _grow(people: list[Solution], lengths: list[int], capacity: int, population: int, generations: int, least: int, rng: random.Random) -> list[Solution]:
    n = len(lengths)
    while len(people) < population:
        people.append(best_fit(Solution([], []), sorted(range(n), key=lambda i: -lengths[i] * rng.uniform(0.9, 1.0)), lengths, capacity))
    people.sort(key=Solution.fitness)
    people = people or [Solution([], [])]
    for _ in range(generations):
        if len(people[0].bins) <= least:
            break
        children = []
        for k in range(max(2, population // 2)):
            one, two = sorted(rng.sample(range(len(people)), 2)) if len(people) > 1 else (0, 0)
            children.append(mutate(people[one], lengths, capacity, rng) if k % 3 == 2 else crossover(people[one], people[two], lengths, capacity, rng))
        # Of solutions that are equally fit one stays, so the population keeps its variety.
        people = sorted({x.fitness(): x for x in reversed(people + children)}.values(), key=Solution.fitness)[:population]
    return people
