"""Whether two bags of words, each in some order, run together to the same letters: exact, whatever the number of words.

Laid side by side, one list of words is always ahead of the other by some
letters, the overhang: the end of a word.  The list that is behind adds its
next word, and the overhang becomes another one.  So a pair of orders is a
closed walk over the overhangs that begins at the empty one and uses each word
as often as it is there, and there are at most as many overhangs as letters.

Such a walk exists where each way from overhang to overhang can be given a
number of uses so that every overhang is entered as often as it is left, every
word is used as often as it is there, and all ways in use hang together with the
empty overhang.  Bounds of these numbers are narrowed by the equations; where
that leaves a choice, each number of uses is tried in turn.  Choices that share
no equation are looked at one after the other and not in all combinations.

The question holds that of packing bins, so the time of made-up cases can grow
exponentially; there is no number of steps after which the search gives up.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

#: Longer overhangs are told apart by where they stand and not by their letters, so that they need not be copied.
_COPIED = 256
#: (variables with their factors, least value of the sum, greatest value of the sum)
_Row = tuple[list[tuple[int, int]], float, float]


def _ways(bags: tuple[Counter, Counter]) -> list[tuple[object, object, tuple[int, str]]]:
    """(overhang, overhang, (side, word)) for each word that can be added at an overhang; the empty one is None."""
    words = [sorted(b) for b in bags]
    lengths = [sorted({len(w) for w in b}) for b in bags]

    def overhang(side: int, word: str, at: int) -> tuple:
        return (side, word[at:], 0) if len(word) - at <= _COPIED else (side, word, at)

    # with nothing ahead both sides have a word to come; that of the first is taken
    ways: list = [(None, overhang(0, w, 0), (0, w)) for w in words[0]]
    open_ = [head for _, head, _ in ways]
    seen = set(open_)
    while open_:
        here = open_.pop()
        side, word, at = here
        behind, ahead = 1 - side, len(word) - at
        found = []
        for n in lengths[behind]:
            if n > ahead:
                break
            if (w := word[at : at + n]) in bags[behind]:
                found.append((w, overhang(side, word, at + n) if n < ahead else None))
        if lengths[behind] and ahead < lengths[behind][-1]:
            rest = word[at:]
            for i in range(bisect_left(words[behind], rest), len(words[behind])):
                w = words[behind][i]
                if not w.startswith(rest):
                    break
                if len(w) > ahead:
                    found.append((w, overhang(behind, w, ahead)))
        for w, there in found:
            ways.append((here, there, (behind, w)))
            if there is not None and there not in seen:
                seen.add(there)
                open_.append(there)
    return ways


def _that_close(ways: list[tuple]) -> list[tuple]:
    """The ways from which the empty overhang can be reached again."""
    into: dict = {}
    for tail, head, _ in ways:
        into.setdefault(head, []).append(tail)
    closing, open_ = {None}, [None]
    while open_:
        for tail in into.get(open_.pop(), ()):
            if tail not in closing:
                closing.add(tail)
                open_.append(tail)
    return [w for w in ways if w[1] in closing]


class _Uses:
    """Whole numbers between bounds under rows of sums; bounds are narrowed, and restored from ``trail``."""

    def __init__(self, most: list[int]) -> None:
        self.low, self.high = [0] * len(most), most
        self.rows: list[_Row] = []
        self.of: list[list[int]] = [[] for _ in most]
        #: how often a row had no numbers left
        self.failed: list[int] = []
        #: the value of each number in the try that settled most
        self.liked: list[int] = []
        self.trail: list[tuple[int, int, int]] = []

    def add(self, terms: list[tuple[int, int]], least: float, greatest: float) -> None:
        for v, _ in terms:
            self.of[v].append(len(self.rows))
        self.rows.append((terms, least, greatest))
        self.failed.append(1)

    def undo(self, mark: int) -> None:
        while len(self.trail) > mark:
            v, self.low[v], self.high[v] = self.trail.pop()

    def bound(self, v: int, low: int, high: int) -> None:
        self.trail.append((v, self.low[v], self.high[v]))
        self.low[v], self.high[v] = low, high

    def narrow(self, rows: Iterable[int]) -> bool:
        """Narrows all bounds that follow from the rows; False where no numbers are left."""
        low, high = self.low, self.high
        open_ = dict.fromkeys(rows)
        while open_:
            row = next(iter(open_))
            del open_[row]
            terms, least, greatest = self.rows[row]
            sum_low = sum(low[v] if f > 0 else -high[v] for v, f in terms)
            sum_high = sum(high[v] if f > 0 else -low[v] for v, f in terms)
            if sum_low > greatest or sum_high < least:
                self.failed[row] += 1
                return False
            # what the row lets a number go up from its least, and down from its greatest value
            up, down = greatest - sum_low, sum_high - least
            for v, f in terms:
                a, b = low[v], high[v]
                if b - a <= up and b - a <= down:
                    continue
                more, less = (up, down) if f > 0 else (down, up)
                new = max(a, b - less), min(b, a + more)
                if new != (a, b):
                    if new[0] > new[1]:
                        self.failed[row] += 1
                        return False
                    self.bound(v, int(new[0]), int(new[1]))
                    open_.update(dict.fromkeys(self.of[v]))
        return True

    def parts(self, among: Iterable[int]) -> list[list[int]]:
        """The numbers that are still open, in parts that share no row."""
        left = {v for v in among if self.low[v] < self.high[v]}
        out = []
        while left:
            part, open_, rows = [], [left.pop()], set()
            while open_:
                part.append(v := open_.pop())
                for row in self.of[v]:
                    if row not in rows:
                        rows.add(row)
                        for w, _ in self.rows[row][0]:
                            if w in left:
                                left.remove(w)
                                open_.append(w)
            out.append(sorted(part))
        return out

    def choice(self, part: list[int]) -> int:
        """An open number of a row that leaves little open and has failed often."""
        low, high = self.low, self.high
        best = None
        for row in {r for v in part for r in self.of[v]}:
            open_ = sum(high[v] - low[v] for v, _ in self.rows[row][0])
            if open_ and (best is None or (open_ / self.failed[row], row) < best):
                best = open_ / self.failed[row], row
        return max((v for v, _ in self.rows[best[1]][0] if low[v] < high[v]), key=lambda v: (sum(self.failed[r] for r in self.of[v]), v))

    def values(self, v: int) -> list[int]:
        """All values of a number, that of the furthest try first."""
        first = min(max(self.liked[v], self.low[v]), self.high[v])
        return [first, *(n for n in range(self.high[v], self.low[v] - 1, -1) if n != first)]

    def solve(self) -> bool:
        """Whether there are such numbers; the bounds then meet in them."""
        start, steps = len(self.trail), 100
        self.liked = list(self.high)
        # rows that failed and values that went far come first when it begins again, with twice the steps until all is tried
        while (found := self._tried(steps)) is None:
            self.undo(start)
            steps *= 2
        return found

    def _tried(self, steps: int) -> bool | None:
        """The same; None where so many wrong choices do not settle it."""
        # lengths of the trail: at its longest, and as far as its values are liked
        deepest, kept = 0, len(self.trail)
        # (part, place in the stack of the choice that it comes from, the parts after it)
        agenda = None
        for part in self.parts(range(len(self.low))):
            agenda = (part, -1, agenda)
        # [number, values left to try, length of the trail, part, place of the choice before, the parts after it]
        stack: list[list] = []
        while agenda:
            part, before, after = agenda
            v = self.choice(part)
            stack.append([v, iter(self.values(v)), len(self.trail), part, before, after])
            while True:
                v, values, mark, part, before, after = stack[-1]
                self.undo(mark)
                kept = min(kept, mark)
                value = next(values, None)
                if value is None:
                    # other choices for parts that are settled do not help this one
                    if before < 0:
                        return False
                    del stack[before + 1 :]
                    continue
                self.bound(v, value, value)
                if self.narrow(self.of[v]):
                    if len(self.trail) > deepest:
                        for w, _, _ in self.trail[kept:]:
                            if self.low[w] == self.high[w]:
                                self.liked[w] = self.low[w]
                        deepest = kept = len(self.trail)
                    agenda = after
                    for p in self.parts(part):
                        agenda = (p, len(stack) - 1, agenda)
                    break
                if not (steps := steps - 1):
                    return None
        return True


def _loose(ways: Sequence[tuple], used: Iterator[int]) -> set | None:
    """Overhangs in use that do not hang together with the empty one, if there are any."""
    heads: dict = {}
    for i in used:
        heads.setdefault(ways[i][0], []).append(ways[i][1])

    def reached(start: object) -> set:
        found, open_ = {start}, [start]
        while open_:
            for head in heads.get(open_.pop(), ()):
                if head not in found:
                    found.add(head)
                    open_.append(head)
        return found

    whole = reached(None)
    return next((reached(tail) for tail in heads if tail not in whole), None)


def run_alike(one: Iterable[str], two: Iterable[str]) -> bool:
    """Whether both lists of words, each in some order, run together to the same letters."""
    bags = Counter(w for w in one if w), Counter(w for w in two if w)
    letters = [Counter() for _ in bags]
    for bag, of in zip(bags, letters, strict=True):
        for word, n in bag.items():
            for letter, m in Counter(word).items():
                of[letter] += n * m
    if letters[0] != letters[1]:
        return False
    ways = _that_close(_ways(bags))
    numbers = _Uses([bags[side][word] for _, _, (side, word) in ways])
    sums: dict = {(side, word): [] for side in (0, 1) for word in bags[side]}
    flows: dict = {}
    for i, (tail, head, added) in enumerate(ways):
        sums[added].append((i, 1))
        if tail is not None:
            flows.setdefault(tail, []).append((i, -1))
        if head is not None:
            flows.setdefault(head, []).append((i, 1))
    for (side, word), terms in sums.items():
        numbers.add(terms, bags[side][word], bags[side][word])
    for terms in flows.values():
        numbers.add(terms, 0, 0)
    if not numbers.narrow(range(len(numbers.rows))):
        return False
    start, fixed = len(numbers.trail), len(numbers.rows)
    # sets of overhangs, each with whether it has to be left (or is not used at all)
    open_: list[list[tuple[set, bool]]] = [[]]
    while open_:
        cuts = open_.pop()
        numbers.undo(start)
        for row in range(len(numbers.rows) - 1, fixed - 1, -1):
            for v, _ in numbers.rows.pop()[0]:
                numbers.of[v].remove(row)
        for inside, left in cuts:
            if left:
                numbers.add([(i, 1) for i, (tail, head, _) in enumerate(ways) if tail in inside and head not in inside], 1, float("inf"))
            else:
                numbers.add([(i, 1) for i, (tail, _, _) in enumerate(ways) if tail in inside], 0, 0)
        if numbers.narrow(range(fixed, len(numbers.rows))) and numbers.solve():
            loose = _loose(ways, (i for i, n in enumerate(numbers.low) if n))
            if loose is None:
                return True
            open_ += [[*cuts, (loose, False)], [*cuts, (loose, True)]]
    return False
