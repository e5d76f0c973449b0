"""Periodic runs of words: stretches that repeat one block several times, found by a suffix automaton with link-cut access.

Words are appended to a suffix automaton one at a time. Its suffix links form a tree, kept as preferred paths in splay trees: all
states of a path have the same last occurrence, the path's colour. Access to the state of the new prefix recolours the path from it
to the root, segment by segment. A segment of colour e whose longest string has L words says: the last L words also end at e, and
nothing longer does. With d = i - e at most L, a square of root length d ends at i; it extends to the left as far as the segment
goes, to L + d words of period d, and to the right as long as later words report the same start. Access costs O(log n) segments a
word, amortised.

A run of at least four periods ends, at each word past its first period, with L >= 3d, and a shorter period of these words would
have given a later last occurrence; so the distance is the smallest period, and the start found is the run's own.

Only regions that can hold a run go through the automaton: where words equal those 1, 2 or 3 before for long enough, or where
consecutive 4-word shingles recur within a third of their stretch. Every run of at least 4 periods lies in one region with its
neighbours, so nothing is lost; prose leaves no region.

A document is one row and one task's work at a time; nothing is shuffled. Null, empty and blank texts have no words and no runs.
Repeated rows give repeated results; columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.llm.scratch import arrow_map
from tessella.llm.words import mix, slices, word_hashes

RESULT = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_GRAM = 4


class LastOccurrences:
    """A suffix automaton of the words appended so far, its suffix-link tree cut into paths of equal last occurrence."""

    def __init__(self) -> None:
        self.steps: list[dict] = [{}, {}]  # state 0 is none, state 1 the empty string
        self.length, self.link = [0, 0], [0, 0]
        self.left, self.right, self.up, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]  # splay trees; shallow states stand left
        self.whole, self.size = 1, 0

    def _state(self, length: int, link: int, steps: dict) -> int:
        self.steps.append(steps)
        self.length.append(length)
        self.link.append(link)
        self.left.append(0)
        self.right.append(0)
        self.up.append(link)
        self.colour.append(-1)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        """Make x the root of its path's tree; the colour stays with the root."""
        left, right, up, colour = self.left, self.right, self.up, self.colour
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            for v in ((y, x) if (left[z] == y) == (left[y] == x) else (x, x)) if inner else (x,):
                p = up[v]
                g = up[p]
                if left[p] == v:
                    child = left[p] = right[v]
                    right[v] = p
                else:
                    child = right[p] = left[v]
                    left[v] = p
                if child:
                    up[child] = p
                if g:
                    if left[g] == p:
                        left[g] = v
                    elif right[g] == p:
                        right[g] = v
                    else:
                        colour[v] = colour[p]
                else:
                    colour[v] = colour[p]
                up[p], up[v] = v, g

    def append(self, word: int) -> list[tuple[int, int]]:
        """(distance to the last occurrence, length of the longest such suffix) for each segment that the new word recolours."""
        steps, length, link = self.steps, self.length, self.link
        at, self.size = self.size, self.size + 1
        p, new = self.whole, self._state(self.size, 0, {})
        while p and word not in steps[p]:
            steps[p][word] = new
            p = link[p]
        if not p:
            target = 1
        else:
            target = q = steps[p][word]
            if length[p] + 1 != length[q]:
                target = self._above(q, length[p] + 1)
                while p and steps[p].get(word) == q:
                    steps[p][word] = target
                    p = link[p]
        link[new] = self.up[new] = target
        self.whole = new
        return self._access(new, at)

    def _above(self, q: int, length: int) -> int:
        """A state for the strings of q up to length, put between q and its link, on q's path."""
        clone = self._state(length, self.link[q], dict(self.steps[q]))
        self._splay(q)
        above = self.left[clone] = self.left[q]
        if above:
            self.up[above] = clone
        self.left[q], self.up[clone] = clone, q
        self.link[q] = clone
        return clone

    def _access(self, state: int, at: int) -> list[tuple[int, int]]:
        right, colour, below, x, found = self.right, self.colour, 0, state, []
        while x:
            self._splay(x)
            if colour[x] >= 0:
                found.append((at - colour[x], self.length[x]))
            if right[x]:
                colour[right[x]] = colour[x]
            right[x] = below
            below, x = x, self.up[x]
        colour[below] = at
        return found


def find_runs(words: list, least: int = 6, power: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least max(least, power * period) words (power 4 or more), by start, then period."""
    occurrences, numbers, ends = LastOccurrences(), {}, {}
    for i, word in enumerate(words):
        for d, longest in occurrences.append(numbers.setdefault(word, len(numbers))):
            if d <= longest and longest + d >= max(least, power * d):
                ends[i - d - longest + 1, d] = i
    return sorted((start, end - start + 1, d) for (start, d), end in ends.items())


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of the stretches of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def regions(hashes: np.ndarray, bounds: np.ndarray, least: int, power: int) -> list[tuple[int, int]]:
    """Disjoint (first, last) word numbers in all texts' words that hold every run, each with its neighbours."""
    n, found = len(hashes), []
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for q in range(1, _GRAM):
        same = np.zeros(n, bool)
        same[q:] = (hashes[q:] == hashes[:-q]) & (doc[q:] == doc[:-q])
        a, b = _stretches(same)
        long = b - a + 1 >= max(least, power * q) - q
        found.append(np.stack([a[long] - q - 1, b[long] + 1]))
    if n > _GRAM:
        gram = hashes[: n - _GRAM + 1]
        for i in range(1, _GRAM):
            gram = mix(gram * np.uint64(31) + hashes[i : n - _GRAM + 1 + i])
        gram = mix(gram + doc[_GRAM - 1 :].astype(np.uint64))
        gram = np.where(doc[_GRAM - 1 :] == doc[: n - _GRAM + 1], gram, mix(np.arange(len(gram), dtype=np.uint64)))
        order = np.argsort(gram, kind="stable")
        again = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
        back = np.full(n, n, np.int64)  # of the shingle that ends here, to its last occurrence
        back[order[again + 1] + _GRAM - 1] = order[again + 1] - order[again]
        # a run of period q has at least (power - 1) * q - 3 such shingles in a row, all within q
        shortest, flags = (power - 1) * _GRAM - 3, back < n
        for _ in range(4):
            a, b = _stretches(flags)
            reach = np.where(b - a + 1 >= shortest, (b - a + 4) // (power - 1), 0)
            flags = np.zeros(n, bool)
            for x, y, most in zip(a[reach > 0], b[reach > 0], reach[reach > 0]):
                flags[x : y + 1] = back[x : y + 1] <= most
        found.append(np.stack([a - reach - _GRAM, b + 1])[:, reach > 0])
    a, b = np.concatenate(found, axis=1)
    if not len(a):
        return []
    home = doc[np.clip(b - 1, 0, n - 1)]
    a, b = np.maximum(a, bounds[home]), np.minimum(b, bounds[home + 1] - 1)
    order, out = np.argsort(a, kind="stable"), []
    for x, y in zip(a[order].tolist(), b[order].tolist()):
        if out and x <= out[-1][1] and x >= out[-1][2]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y, int(bounds[np.searchsorted(bounds, x, "right") - 1])])
    return [(x, y) for x, y, _ in out]


def runs_of_texts(texts: list[bytes | None], least: int = 6, power: int = 4) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """(words, runs) of each text."""
    for part in slices(texts):
        hashes, bounds = word_hashes(part, lower=False)
        inside: list[list[tuple[int, int]]] = [[] for _ in part]
        for a, b in regions(hashes, bounds, least, power):
            k = int(np.searchsorted(bounds, a, "right")) - 1
            inside[k].append((a - int(bounds[k]), b - int(bounds[k])))
        for text, places in zip(part, inside):
            words = (text or b"").split()  # of bytes: at the six ASCII blanks alone
            yield words, sorted((a + s, length, p) for a, b in places for s, length, p in find_runs(words[a : b + 1], least, power))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [w for w, g in zip(words, gone.tolist()) if not g]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 6, power: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed) for each row of df: all its runs by start and period, and its text without their repetitions."""
    if power < 4:
        raise ValueError("power must be at least 4: shorter runs can escape the regions and the automaton's last occurrences")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            n, runs, kept = [], [], []
            for words, found in runs_of_texts(batch.column(1).to_pylist(), least, power):
                n.append(len(words))
                runs.append([{"start": s, "length": k, "period": p} for s, k, p in found])
                kept.append(b" ".join(collapse(words, found)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("t")), work, RESULT)


def longest(found: DataFrame) -> DataFrame:
    """Of periodic_runs(): the number of runs, the longest one (then the smallest start and period), and digests of runs and text."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS at, -r.period AS of)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = found.select("id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, period, length = -F.col("best.at"), -F.col("best.of"), F.col("best.length")
    return out.select("id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
