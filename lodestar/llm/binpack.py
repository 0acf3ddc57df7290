"""Bin completion over a histogram of lengths.

A corpus has at most `capacity` different lengths, however many documents it has, so the solver works on
(length, count) classes and returns filling patterns with multiplicities. Its input and output are bounded by the
capacity, not by the number of documents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

Filling = tuple[tuple[int, int], ...]  # (length, items of it in one bin), longest first


@dataclass
class Packing:
    patterns: list[tuple[Filling, int]]
    bins: int
    lower_bound: int
    optimal: bool


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: the volume bound, sharpened at every threshold for items that exclude each other."""
    lengths = sorted(hist)
    best = -(-sum(x * n for x, n in hist.items()) // capacity)
    for k in [0, *[x for x in lengths if 2 * x <= capacity]]:
        big = sum(n for x, n in hist.items() if x > capacity - k)
        half = [(x, n) for x, n in hist.items() if capacity - k >= x and 2 * x > capacity]
        small = sum(x * n for x, n in hist.items() if k <= x and 2 * x <= capacity)
        n_half = sum(n for _, n in half)
        room = n_half * capacity - sum(x * n for x, n in half)
        best = max(best, big + n_half + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing, a class at a time: equal bins move together, so the work follows the classes."""
    by_room: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: Filling, bins: int) -> None:
        if bins:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append((filling, bins))

    for x in sorted(hist, reverse=True):
        left = hist[x]
        while left:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                fits = capacity // x
                put(capacity - fits * x, ((x, fits),), left // fits)
                if left % fits:
                    put(capacity - left % fits * x, ((x, left % fits),), 1)
                break
            room = rooms[at]
            filling, bins = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            fits = room // x
            full = min(bins, left // fits)
            put(room - fits * x, (*filling, (x, fits)), full)
            left -= full * fits
            if full < bins and left:
                put(room - left * x, (*filling, (x, left)), 1)
                full, left = full + 1, 0
            put(room, filling, bins - full)
    return [group for room in rooms for group in by_room[room]]


def completions(lengths: list[int], avail: dict[int, int], largest: int, capacity: int, effort: int) -> tuple[list[Filling], bool, int]:
    """Undominated fillings around the largest item, least waste first, whether these are all, and the work done.

    A filling is dropped if a free item still fits, if a free item fits in place of a shorter one, or in place of two
    that together are no longer than it: the other filling is then at least as good. One item that fills the bin by itself
    beats all else; a full bin of more items does not. `effort` bounds the work of the enumeration, in lengths looked at.
    """
    room = capacity - largest
    cand = [x for x in lengths if x <= room and avail[x] - (x == largest) > 0]
    if room in cand:
        return [((largest, 2),) if room == largest else ((largest, 1), (room, 1))], True, len(lengths)
    least = cand[-1] if cand else 0
    found: list[tuple[int, tuple[int, ...]]] = []

    def free(x: int, taken: tuple[int, ...]) -> bool:
        return avail[x] - (x == largest) - taken.count(x) > 0

    def dominated(taken: tuple[int, ...], slack: int) -> bool:
        if slack == 0:
            # nothing longer can take the place of one item; of two, only what is exactly as long
            sums = {taken[i] + taken[j] for i in range(len(taken)) for j in range(i)}
            return any(x in avail and x <= room and free(x, taken) for x in sums)
        for x in cand:
            if not free(x, taken):
                continue
            if x <= slack or any(y < x <= y + slack for y in set(taken)):
                return True
            if any(taken[i] + taken[j] <= x <= taken[i] + taken[j] + slack for i in range(len(taken)) for j in range(i)):
                return True
        return False

    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    work = 0
    while stack and work < effort:
        work += 8
        at, slack, taken = stack.pop()
        if slack < least or at == len(cand):
            work += len(cand)
            if not dominated(taken, slack):
                found.append((slack, taken))
            continue
        # the deeper branch, which takes the longest that fits, is popped first
        at = max(at, bisect_left(cand, -slack, key=lambda x: -x))
        stack.append((at + 1, slack, taken) if at < len(cand) else (at, slack, taken))
        if at < len(cand) and free(cand[at], taken):
            stack.append((at, slack - cand[at], (*taken, cand[at])))
    out = []
    for _, taken in sorted(found):
        n: dict[int, int] = {largest: 1}
        for x in taken:
            n[x] = n.get(x, 0) + 1
        out.append(tuple(sorted(n.items(), reverse=True)))
    return out or [((largest, 1),)], not stack, work + len(lengths)


def greedy(hist: dict[int, int], capacity: int, among: int, effort: int, work: int) -> tuple[list[tuple[Filling, int]], int]:
    """The `among` longest items by best fit among themselves, then the least wasteful filling around the longest left.

    What is left after `work` goes by best fit. Returns the fillings and the work not done.
    """
    own: dict[int, int] = {}
    avail = dict(hist)
    lengths = sorted(hist, reverse=True)
    for x in lengths:
        n = min(avail[x], among)
        own[x], avail[x], among = n, avail[x] - n, among - n
    out = best_fit({x: n for x, n in own.items() if n}, capacity)
    at = 0
    while at < len(lengths) and work > 0:
        x = lengths[at]
        if not avail[x]:
            at += 1
            continue
        fillings, _, done = completions(lengths[at:], avail, x, capacity, effort)
        filling, work = fillings[0], work - done
        times = min(avail[y] // n for y, n in filling)
        for y, n in filling:
            avail[y] -= n * times
        out.append((filling, times))
    return out + best_fit({x: n for x, n in avail.items() if n}, capacity), work


def pack_histogram(hist: dict[int, int], capacity: int, work: int = 12_000_000, effort: int = 20_000) -> Packing:
    """Fewest bins for `hist` (length -> count).

    Best-fit decreasing is the first incumbent; if it meets the lower bound it is optimal. Else packings in which more and more of the
    longest items stay among themselves are tried, and then bins are completed one after another around the largest item left; a
    branch is left once its waste exceeds what an improvement may waste. A filling is first repeated as often as its items allow, then
    taken once, at every size. The search ends after `work`, counted in lengths looked at, with the best packing found; `optimal` says
    whether it is proven: the bound is met, or all was searched and no enumeration was cut short at `effort`.
    """
    hist = {x: n for x, n in hist.items() if n > 0}
    if not hist:
        return Packing([], 0, 0, True)
    if min(hist) < 1 or max(hist) > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    bound = lower_bound(hist, capacity)
    best = best_fit(hist, capacity)
    n_best = sum(m for _, m in best)
    volume, items = sum(x * n for x, n in hist.items()), sum(hist.values())
    for among in sorted({items * k // 40 for k in (0, 2, 6)}):
        if n_best > bound:
            other, left = greedy(hist, capacity, among, effort // 4, work // 8)
            work -= work // 8 - max(left, 0)
            if (n := sum(m for _, m in other)) < n_best:
                best, n_best = other, n
    lengths = sorted(hist, reverse=True)
    avail = dict(hist)
    path: list[tuple[Filling, int]] = []
    stack: list[Iterator[tuple[Filling, int]]] = []
    waste = bins = 0
    complete = True

    def branches() -> Iterator[tuple[Filling, int]]:
        nonlocal complete, work
        largest = next(x for x in lengths if avail[x])
        fillings, all_, done = completions(lengths, avail, largest, capacity, effort)
        complete, work = complete and all_, work - done
        for filling in fillings:
            most = min(avail[x] // n for x, n in filling)
            yield filling, most
            if most > 1:
                yield filling, 1

    if n_best > bound:
        stack.append(branches())
    while stack and n_best > bound:
        if work <= 0:
            complete = False
            break
        branch = next(stack[-1], None)
        if branch is None:
            stack.pop()
            if path:
                done, times = path.pop()
                for x, n in done:
                    avail[x] += n * times
                items += times * sum(n for _, n in done)
                bins -= times
                waste -= times * (capacity - sum(x * n for x, n in done))
            continue
        work -= 8
        filling, times = branch
        more = times * (capacity - sum(x * n for x, n in filling))
        if waste + more > (n_best - 1) * capacity - volume:
            continue
        for x, n in filling:
            avail[x] -= n * times
        items -= times * sum(n for _, n in filling)
        bins, waste = bins + times, waste + more
        path.append((filling, times))
        if not items and bins < n_best:
            best, n_best = list(path), bins
        stack.append(branches() if items else iter(()))
    return Packing(best, n_best, bound, n_best == bound or complete)
