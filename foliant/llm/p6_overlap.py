"""Problem 6: records of evaluation splits that also occur, exactly or almost, in training.

Method: edit-distance segment join. An evaluation text of length L has at most
k = L // 9 edits to any partner (a tenth of the longer length), so of k + 1
disjoint segments one is intact and starts in the partner but few characters
off. Training texts look up all their substrings of segment length; partners
pass bounds on the characters before the segment (few edits lie there), on how
often each character occurs and on hashed character 3-grams (an edit changes at
most n n-grams on either side) and are verified with banded dynamic programming.
No bucket is capped: candidates are counted in blocks of bounded size instead of emitted.
Which k + 1 disjoint segments are cut is chosen by how rare they are in the
block's training texts near their places.

Texts are compared in the one form of problem 3, each distinct form once; rows
join to the pairs of forms afterwards. Blocks are by script and lengths, a training
text visiting every block that may hold a partner: a partner's main script has
at most 2k characters less in it than any other script.

Defined results: null hashes, and null, empty and blank texts match nothing;
rows whose split names none of the three are left out; texts of fewer than nine
characters match only if equal in form.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import split_names, with_split
from foliant.llm.p3_visual import Canonical, bigram_model
from foliant.runtime import materialize, read_table

QUERIES = 8_000_000  # characters of the evaluation texts in a block, about
RATIO = 1.6  # of the lengths of the evaluation texts in a block, at most
PART = 6_000_000  # characters of the training texts in a part of a block, about
SLOTS, PLACES = 1 << 17, 32  # of the index of segments: by hash, and by place in the text
WINDOW = 24  # characters before a segment that are compared first
HITS = 1 << 15  # postings looked at together, about
WORK = 1 << 25  # cells of the choice of segments at once
SLICE = 1 << 12  # pairs whose n-grams are compared at once
SIGNS = np.uint64(0x8000800080008000)  # of four lanes in a word
PIECE = 128  # segments chosen together
BITS1, BITS3 = 1, 8  # bits for counted characters and for hashed 3-grams, for each character of the longest text
BATCH = 4_096  # pairs verified at once

_ZONES = ((0x0, 0x900, "L"), (0x900, 0x980, "D"), (0x1900, 0x1950, "I"), (0x1C00, 0x1C50, "R"), (0x1C50, 0x1C80, "O"), (0x1E00, 0x2000, "L"), (0x11480, 0x114E0, "T"), (0x11BC0, 0x11C00, "S"))
ZONES = "DILORSTX"


def _zone_table() -> np.ndarray:
    table = np.full(0x110000, ZONES.index("X"), dtype=np.uint8)
    for a, b, z in _ZONES:
        table[a:b] = ZONES.index(z)
    return table


def zones(texts: list[str], table: np.ndarray) -> tuple[list[str], list[str]]:
    """The main zone of each text, and those that may be the main zone of a partner."""
    flat, _, lengths = _codes(texts)
    n = np.bincount(np.repeat(np.arange(len(texts)) * len(ZONES), lengths) + table[flat], minlength=len(texts) * len(ZONES)).reshape(len(texts), len(ZONES))
    may = n >= (n.max(1) - 2 * (lengths // 9))[:, None]
    return [ZONES[i] for i in n.argmax(1)], ["".join(z for z, x in zip(ZONES, m, strict=True) if x) for m in may.tolist()]


def segment_length(length: int) -> int:
    """Length q such that length // 9 + 1 segments of q fit in, with room to choose them."""
    return 6 if length >= 18 else 4 if length >= 9 else 0


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in one array, where each begins, and their lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.cumsum(lengths) - lengths, lengths


def _grams(flat: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n characters from each place on."""
    out = np.zeros(max(len(flat) - n + 1, 0), dtype=np.uint32)
    for i in range(n if len(out) else 0):
        out *= np.uint32(0x9E3779B1)
        out += flat[i : len(flat) - n + 1 + i]
        out ^= out >> np.uint32(15)
    return out * np.uint32(0x85EBCA6B)


def _slots(flat: np.ndarray, q: int) -> np.ndarray:
    """For the q characters from each place on, the first of the slots they share by hash, one for each place."""
    return (_grams(flat, q) >> np.uint32(33 - SLOTS.bit_length())).astype(np.int64) * PLACES


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): the places starts[i] .. starts[i] + counts[i] - 1 of all i."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def _bits(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, n: int, bits: int) -> np.ndarray:
    """For each text the set of its n-grams, hashed to bits."""
    out = np.zeros((len(lengths), bits // 64), dtype=np.uint64)
    grams = _grams(flat, n) >> np.uint32(33 - bits.bit_length())
    for s in range(0, len(lengths), 2048):
        m = np.maximum(lengths[s : s + 2048] - n + 1, 0)
        row, place = _spread(begins[s : s + 2048], m)
        held = np.zeros((len(m), bits), dtype=np.uint8)
        held.ravel()[row * bits + grams[place]] = 1
        out[s : s + 2048] = np.packbits(held, axis=1).view(np.uint64)
    return out


def _counts(flat: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """For each text the parities, by hash, of its characters, each with its how-manieth occurrence.

    As many bits differ at most as the texts have such characters of their own: 2 for each edit.
    """
    out = np.zeros((len(lengths), bits // 64), dtype=np.uint64)
    ends = np.cumsum(lengths)
    for s in range(0, len(lengths), 512):
        m = lengths[s : s + 512]
        end = ends[s + len(m) - 1]
        key = np.sort((np.repeat(np.arange(len(m), dtype=np.uint32), m).astype(np.uint64) << np.uint64(32)) | flat[end - m.sum() : end])
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        nth = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
        h = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32) * np.uint32(0x9E3779B1) + nth.astype(np.uint32) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(33 - bits.bit_length())
        odd = np.bincount((key >> np.uint64(32)).astype(np.int64) * bits + h, minlength=len(m) * bits) & 1
        out[s : s + 512] = np.packbits(odd.astype(np.uint8).reshape(len(m), bits), axis=1).view(np.uint64)
    return out


def _before(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each place of each text the set of the 2-grams in the WINDOW characters before it, hashed to 64 bits.

    WINDOW places come before each text: place p of text i is at begins[i] + p + WINDOW * (i + 1).
    """
    one = np.uint64(1) << (_grams(flat, 2) >> np.uint32(26)).astype(np.uint64)
    row, place = _spread(begins, np.maximum(lengths - 1, 0))
    size = len(flat) + WINDOW * (len(lengths) + 1)
    wide = np.zeros(size, dtype=np.uint64)
    wide[place + WINDOW * (row + 1)] = one[place]
    span = 1  # of the 2-grams from a place on
    while 2 * span <= WINDOW - 1:
        wide = wide[:-span] | wide[span:]
        span *= 2
    rest = WINDOW - 1 - span
    out = np.zeros(size, dtype=np.uint64)
    np.bitwise_or(wide[: size - WINDOW], wide[rest : rest + size - WINDOW], out=out[WINDOW:])
    return out


def _lanes(*x: np.ndarray) -> np.ndarray:
    """Four numbers of under 14 bits and any sign in one word; the highest bit of a lane of a sum of two tells that the lane's sum is not negative."""
    return sum((y.astype(np.int64) + (1 << 14)).astype(np.uint64) << np.uint64(16 * i) for i, y in enumerate(x))


def within(a: list[str], b: list[str], k: np.ndarray) -> np.ndarray:
    """Edit distances of the pairs a[i], b[i] where at most k[i], else -1; banded, all pairs in step."""
    n = len(a)
    out = np.full(n, -1, dtype=np.int64)
    if not n:
        return out
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    w, rows = int(k.max()), int(la.max())
    big = np.int32(1 << 20)
    left = np.zeros((n, rows), dtype=np.int32)
    right = np.full((n, rows + 2 * w + 2), -2, dtype=np.int32)  # shifted by w
    for i in range(n):
        left[i, : la[i]] = np.frombuffer(a[i].encode("utf-32-le", "surrogatepass"), dtype=np.int32)
        m = min(int(lb[i]), rows + w + 1)
        right[i, w : w + m] = np.frombuffer(b[i][:m].encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    live = np.flatnonzero(np.abs(la - lb) <= k)
    off = np.arange(-w, w + 1)
    row = np.where(off >= 0, off, big).astype(np.int32)[None, :].repeat(len(live), 0)  # distances of the empty prefix
    step = np.arange(2 * w + 1, dtype=np.int32)
    for i in range(rows + 1):
        done = la[live] == i
        if done.any():
            d = live[done]
            j = lb[d] - i + w
            ok = (j >= 0) & (j <= 2 * w)
            v = row[done][np.arange(len(d)), np.clip(j, 0, 2 * w)]
            out[d] = np.where(ok & (v <= k[d]), v, -1)
        stay = ~done & (row.min(1) <= k[live])
        if not stay.all():
            live, row = live[stay], row[stay]
        if not len(live) or i == rows:
            break
        col = i + off  # column of the other text that each place of the band stands for
        cost = (right[live, i : i + 2 * w + 1] != left[live, i][:, None]).astype(np.int32)
        new = row + cost
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new[:, col < -1] = big
        edge = col == -1  # the empty prefix of the other text
        if edge.any():
            new[:, edge] = i + 1
        new = np.minimum.accumulate(new - step, axis=1) + step
        row = new
    return out


def rarest(cost: np.ndarray, parts: int, q: int, weights: np.ndarray) -> np.ndarray:
    """Starts of ``parts`` disjoint segments of q characters with the least weighted cost, for each text.

    cost: places x texts, infinite where no segment fits. weights: of the segments, from the front.
    """
    places, n = cost.shape
    took = np.zeros((places + q, n, parts), dtype=bool)
    first = np.full((n, parts + 1), np.inf, dtype=np.float32)
    first[:, 0] = 0
    best = [first] * q  # of the texts' first i + 1 .. i + q characters
    for i in range(places):
        alt = best[0][:, :-1] + cost[i][:, None] * weights
        last = best[-1]
        np.less(alt, last[:, 1:], out=took[i + q - 1])
        new = last.copy()
        np.minimum(alt, last[:, 1:], out=new[:, 1:])
        best = [*best[1:], new]
    starts = np.zeros((n, parts), dtype=np.int64)
    left, end, who = np.full(n, parts), np.full(n, places + q - 1), np.arange(n)
    for i in range(places + q - 2, q - 2, -1):
        at = np.flatnonzero((end > i) & (left > 0))
        hit = at[took[i, at, left[at] - 1]]
        starts[who[hit], left[hit] - 1] = i - q + 1
        left[hit] -= 1
        end[at] = i
        end[hit] = i - q + 1
    return starts


class Block:
    """Evaluation texts with their segments and bounds, in arrays.

    Of all ways to cut k + 1 disjoint segments, the one is taken whose segments
    are the rarest among ``others`` (the texts to be looked up, or like ones)
    near their places; which one is taken does not alter what is found.
    """

    CHARS = 32_000  # of the given texts looked up at once

    def __init__(self, texts: list[str], others: list[str] | None = None):
        self.texts = texts
        flat, begins, self.lengths = _codes(texts)
        self.k = self.lengths // 9
        longest = int(self.lengths.max())
        self.shift = max(0, longest.bit_length() - 13)  # places in longer texts are compared less finely
        bits1, bits3 = (max(64, 1 << min(18, (x * longest - 1).bit_length())) for x in (BITS1, BITS3))
        self.bounds = [(1, bits1, _counts(flat, self.lengths, bits1)), (3, bits3, _bits(flat, begins, self.lengths, 3, bits3))]
        common = texts if others is None else others
        sizes = np.array([segment_length(n) for n in self.lengths])
        before = _before(flat, begins, self.lengths)
        # for each segment length, by place from the front and from the end: what to look at, postings of each slot and place, text and bounds of each posting
        self.held = []
        for q in sorted(set(sizes.tolist()) - {0}):
            ids = np.flatnonzero(sizes == q)
            wide = max(1, -(-int(self.lengths[ids].max()) // PLACES))
            grams = _slots(flat, q)
            owner, starts = [], []
            seen = np.zeros(SLOTS * PLACES + 1, dtype=np.int64)
            for s in range(0, len(common), SLICE):
                others, at, n = _codes(common[s : s + SLICE])
                row, place = _spread(at, np.maximum(n - q + 1, 0))
                seen[1:] += np.bincount(_slots(others, q)[place] + np.minimum((place - at[row]) // wide, PLACES - 1), minlength=SLOTS * PLACES)
            seen = np.cumsum(seen).astype(np.int32 if seen.sum() < 1 << 31 else np.int64)
            for k in np.unique(self.k[ids]).tolist():
                same = ids[self.k[ids] == k]
                weights = (2 * np.minimum(np.arange(k + 1), k - np.arange(k + 1)) + 1).astype(np.float32)
                pieces = k // PIECE + 1  # of a long text, each with its share of the segments
                cuts = [c * (k + 1) // pieces for c in range(pieces + 1)]
                most = int(self.lengths[same].max()) // pieces + 1
                step = max(1, WORK // (most * (k // pieces + 2)))
                for s in range(0, len(same), step):
                    part = same[s : s + step]
                    got = []
                    for c in range(pieces):
                        low, high = self.lengths[part] * c // pieces, self.lengths[part] * (c + 1) // pieces
                        i = low + np.arange(int((high - low).max()) - q + 1)[:, None]
                        fits = i + q <= high
                        g = grams[np.where(fits, begins[part] + i, begins[part])]
                        cost = (seen[g + np.minimum((i + k // 2) // wide, PLACES - 1) + 1] - seen[g + np.maximum(i - k // 2, 0) // wide]).astype(np.float32)
                        got.append(low[:, None] + rarest(np.where(fits, cost + np.float32(0.05), np.float32(np.inf)), cuts[c + 1] - cuts[c], q, weights[cuts[c] : cuts[c + 1]]))
                    starts.append(np.concatenate(got, axis=1).ravel())
                    owner.append(np.repeat(part, k + 1))
            owner, start = np.concatenate(owner), np.concatenate(starts)
            order = np.argsort(owner, kind="stable")
            owner, start = owner[order], start[order]
            no = np.concatenate([[0], np.cumsum(owner[1:] != owner[:-1])])
            no = np.arange(len(owner)) - np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[no]
            # edits up to the segment's start: in the window before it at most as many as segments end after the window's start
            ends = owner * (2 * longest) + start + q
            window = np.arange(len(owner)) - np.maximum(np.searchsorted(ends, owner * (2 * longest) + np.maximum(start - WINDOW, -1), side="right"), np.arange(len(owner)) - no)
            behind, tail = self.k[owner] - no, start - self.lengths[owner]
            sets = before[begins[owner] + start + WINDOW * (owner + 1)]
            for back in (False, True):
                mine = np.flatnonzero((behind < no) == back)
                if len(mine):
                    order, low, high, first = self._index(grams[begins[owner[mine]] + start[mine]], -tail[mine] if back else start[mine], (behind if back else no)[mine])
                    mine = mine[order]
                    # where the segment may start in a partner, from its front and from its end
                    bounds = _lanes(*(y * (x[mine] >> self.shift) for x, y in ((start - no, -1), (start + no, 1), (tail - behind, -1), (tail + behind, 1))))
                    most = np.minimum(4 * window[mine], 64).astype(np.uint8)
                    self.held.append((q, back, low, high, first, owner[mine].astype(np.int32), bounds, sets[mine], most))

    @staticmethod
    def _index(slot: np.ndarray, place: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order of the postings by slot and place; for each place of a given text the first place to look at and the one after the last; where each slot and place begins."""
        wide = int(place.max()) // PLACES + 1
        low, high = np.full(PLACES, np.iinfo(np.int64).max), np.full(PLACES, -1)
        np.minimum.at(low, place // wide, place - reach)
        np.maximum.at(high, place // wide, place + reach)
        low, high = np.minimum.accumulate(low[::-1])[::-1], np.maximum.accumulate(high)
        key = slot + place // wide
        first = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=SLOTS * PLACES))]).astype(np.int32)
        near = np.arange(int(high[-1]) + 1)
        return np.argsort(key, kind="stable"), np.searchsorted(high, near, side="left"), np.searchsorted(low, near, side="right"), first

    def partners(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(given text, evaluation text) of the pairs that pass the segment and n-gram bounds.

        Of k + 1 segments, take the first with at most as many edits up to its end
        as segments before it: it is intact, with at most j edits before it and
        k - j behind it, and at most i edits from the end of the segment i + 1 before
        it on. Only such places are looked at.
        """
        flat, begins, lengths = _codes(texts)
        before = _before(flat, begins, lengths)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for q, back, low, high, first, owner, bounds, sets, most in self.held:
            row, place = _spread(begins, np.maximum(lengths - q + 1, 0))
            front = place - begins[row]
            x = lengths[row] - front if back else front
            near = np.flatnonzero(x < len(low))
            row, place, front, x = row[near], place[near], front[near], x[near]
            slot = _slots(flat, q)[place]
            start = first[slot + low[x]]
            n = np.maximum(first[slot + high[x]] - start, 0)
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            row, front, start, n = row[hit], front[hit], start[hit], n[hit]
            f, e = np.minimum(front >> self.shift, (1 << 14) - 1), np.maximum((front - lengths[row]) >> self.shift, 1 - (1 << 14))
            f, at = _lanes(f, -f, e, -e), begins[row] + front + WINDOW * (row + 1)
            past = np.cumsum(n)
            cuts = np.unique(np.searchsorted(past, np.arange(0, int(past[-1]), HITS), side="right"))
            start = (start - past + n).astype(np.int64)
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(n)], strict=True):  # small enough for the processor's cache
                which = np.repeat(np.arange(i, j, dtype=np.int32), n[i:j])
                post = start.take(which)
                post += np.arange(past[i] - n[i], past[j - 1])
                ok = f.take(which)
                ok += bounds.take(post)
                ok &= SIGNS
                ok = np.flatnonzero(ok == SIGNS)
                which, post = which[ok], post[ok]
                ok = np.flatnonzero(np.bitwise_count(sets.take(post) ^ before.take(at.take(which))) <= most.take(post))
                found.append((row[which[ok]], owner[post[ok]]))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        t, e = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
        k = np.maximum(lengths[t], self.lengths[e]) // 10
        for n, bits, table in self.bounds:
            some, at = np.unique(t, return_inverse=True) if n > 2 else (np.arange(len(texts)), t)
            own = _bits(flat, begins[some], lengths[some], n, bits) if n > 1 else _counts(flat, lengths, bits)
            ok = np.zeros(len(t), dtype=bool)
            for s in range(0, len(t), SLICE):  # small enough for the processor's cache
                x = table.take(e[s : s + SLICE], axis=0, mode="clip")
                x ^= own.take(at[s : s + SLICE], axis=0, mode="clip")
                x = np.bitwise_count(x)
                # few words: by column, as sums of short rows are slow
                differ = x.sum(1, dtype=np.int32) if x.shape[1] > 8 else sum(x[:, w].astype(np.uint16) for w in range(x.shape[1]))
                ok[s : s + SLICE] = differ <= 2 * n * k[s : s + SLICE]
            t, e = np.divmod(np.unique(t[ok] * len(self.texts) + e[ok]), len(self.texts))
            k = np.maximum(lengths[t], self.lengths[e]) // 10
        return t, e

    def match(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(evaluation text, given text, edit distance) of all pairs within a tenth."""
        out: list[tuple[int, int, int]] = []
        wait: list[tuple[int, int]] = []

        def verify():
            wait.sort(key=lambda p: len(self.texts[p[0]]))
            for s in range(0, len(wait), BATCH):
                part = wait[s : s + BATCH]
                a, b = [self.texts[i] for i, _ in part], [texts[j] for _, j in part]
                d = within(a, b, np.array([max(len(x), len(y)) // 10 for x, y in zip(a, b, strict=True)]))
                out.extend((i, j, int(x)) for (i, j), x in zip(part, d, strict=True) if x >= 0)
            wait.clear()

        begin, size = 0, 0
        for j, text in enumerate(texts):
            size += len(text)
            if size >= self.CHARS or j + 1 == len(texts):
                t, e = self.partners(texts[begin : j + 1])
                wait += zip(e.tolist(), (t + begin).tolist(), strict=True)
                begin, size = j + 1, 0
                if len(wait) >= 4 * BATCH:
                    verify()
        verify()
        return out


def _forms(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, table = Canonical(model), _zone_table()
        for b in batches:
            texts = [canon.text(t) if t else "" for t in b.column(1).to_pylist()]
            ok = [bool(t.strip()) for t in texts]
            long = [t if o and len(t) >= 9 else None for t, o in zip(texts, ok, strict=True)]
            found = iter(zip(*zones([t for t in long if t], table), strict=True))
            main, may = zip(*[next(found) if t else (None, None) for t in long], strict=True) if long else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3),
                 pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() if o else None for t, o in zip(texts, ok, strict=True)], pa.binary()),
                 pa.array(long, pa.string()), pa.array(main, pa.string()), pa.array(may, pa.string()), pa.array([len(t) if t else None for t in long], pa.int32())],
                names=["id", "held_out", "image", "form", "text", "zone", "may", "n"])

    return run


def _join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if left.empty or right.empty:
        return pd.DataFrame({"form_e": pd.Series(dtype=object), "form_t": pd.Series(dtype=object), "distance": pd.Series(dtype="int32")})
    held, train = list(left["text"]), list(right["text"])
    found = Block(held, train).match(train)
    return pd.DataFrame({"form_e": [left["form"].iloc[i] for i, _, _ in found], "form_t": [right["form"].iloc[j] for _, j, _ in found], "distance": np.array([d for *_, d in found], dtype="int32")})


def _reach(n: int) -> range:
    """Lengths of the texts that may be within a tenth of one of n characters."""
    return range(math.ceil(0.9 * n - 1e-9), math.floor(n / 0.9 + 1e-9) + 1)


def plan_blocks(held: dict[tuple[str, int], int], train: dict[tuple[str, int], int], queries: int, part: int) -> tuple[list[tuple], list[tuple], int]:
    """Blocks of evaluation texts of one zone and of like lengths, each with the training texts in reach, in parts.

    held, train: (zone, length) -> texts. Returns rows (zone, n, first cell, subs, parts)
    for either side and the number of cells; a cell is a block's sub and a part.
    A length with more texts than a block holds is divided by hash (subs).
    """
    places_e: list[tuple] = []
    places_t: list[tuple] = []
    cells = 0
    for zone in sorted({z for z, _ in held}):
        lengths = sorted(n for z, n in held if z == zone)
        there = sorted(n for z, n in train if z == zone)
        at = 0
        while at < len(lengths):
            end, size = at, 0
            while end < len(lengths) and lengths[end] <= RATIO * lengths[at] and (end == at or size + held[zone, lengths[end]] * lengths[end] <= queries):
                size += held[zone, lengths[end]] * lengths[end]
                end += 1
            low, high = _reach(lengths[at]).start, _reach(lengths[end - 1]).stop
            near = [n for n in there if low <= n < high]
            if near:
                subs, parts = -(-size // queries), -(-sum(train[zone, n] * n for n in near) // part)
                places_e += [(zone, n, cells, subs, parts) for n in lengths[at:end]]
                places_t += [(zone, n, cells, subs, parts) for n in near]
                cells += subs * parts
            at = end
    return places_e, places_t, cells


def similar_forms(forms: DataFrame, queries: int = QUERIES, part: int = PART) -> DataFrame:
    """(form_e, form_t, distance) of different forms, one held out and one not, within a tenth.

    forms: form (a key), held_out, text, zone, may, n; one row for each form and side.
    """
    spark = forms.sparkSession
    placed = materialize(forms.withColumn("zone", F.explode(F.when(F.col("held_out"), F.array("zone")).otherwise(F.split("may", "")))).select("form", "held_out", "text", "zone", "n"), "p6-places")
    # as many rows as there are scripts and lengths
    count = {(r["held_out"], r["zone"], r["n"]): r["count"] for r in placed.groupBy("held_out", "zone", "n").count().collect()}
    *places, cells = plan_blocks(*[{(z, n): c for (h, z, n), c in count.items() if h is held} for held in (True, False)], queries, part)
    schema = "zone string, n int, first int, subs int, parts int"
    e, t = (
        # the planned places are bounded by scripts x lengths; beyond the bound the join is left to the optimizer
        placed.where("held_out" if held else "not held_out").join((F.broadcast if len(p) < 200_000 else lambda x: x)(spark.createDataFrame(p, schema)), ["zone", "n"])
        for held, p in zip((True, False), places, strict=True))
    h = F.xxhash64("form")
    e = e.withColumn("sub", F.pmod(h, "subs")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    t = t.withColumn("part", F.pmod(h, "parts")).withColumn("sub", F.explode(F.expr("sequence(0, subs - 1)")))
    # aliases, as both sides come from one table; cells are few and dear, so each is to have a task
    tasks = max(1, 3 * cells)
    e, t = (x.select((F.col("first") + F.col("sub") * F.col("parts") + F.col("part")).cast("int").alias("cell"), F.col("form").alias("form"), F.col("text").alias("text")).repartition(tasks, "cell") for x in (e, t))
    return e.groupBy("cell").cogroup(t.groupBy("cell")).applyInPandas(_join, "form_e binary, form_t binary, distance int")


def find_overlaps(rows: DataFrame) -> DataFrame:
    """(held, train, distance): pairs of ids; distance null where only the images agree.

    rows: id, text, held_out (null rows are left out), image (null matches nothing).
    """
    rows = rows.where("held_out is not null").select("id", "text", "held_out", "image")
    model = bigram_model(rows.select("text"))
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("image", T.StringType()), T.StructField("form", T.BinaryType()), T.StructField("text", T.StringType()), T.StructField("zone", T.StringType()), T.StructField("may", T.StringType()), T.StructField("n", T.IntegerType())])
    rows = materialize(rows.mapInArrow(_forms(model), schema), "p6-rows")
    forms = rows.where("text is not null").groupBy("form", "held_out").agg(*[F.min(c).alias(c) for c in ("text", "zone", "may", "n")])
    near = materialize(similar_forms(forms).where("form_e <> form_t"), "p6-near")
    e = rows.where("held_out").select(F.col("id").alias("held"), F.col("form").alias("form_e"), F.col("image").alias("image_e"))
    t = rows.where("not held_out").select(F.col("id").alias("train"), F.col("form").alias("form_t"), F.col("image").alias("image_t"))
    same = e.join(t, e["form_e"] == t["form_t"]).select("held", "train", F.lit(0).alias("distance"))
    close = near.join(e, "form_e").join(t, "form_t").select("held", "train", "distance")
    image = e.join(t, e["image_e"] == t["image_t"]).select("held", "train", F.lit(None).cast("int").alias("distance"))
    return same.unionByName(close).unionByName(image).groupBy("held", "train").agg(F.min("distance").alias("distance"))


def image_hash(c):
    """A SHA-256 however it is written: letter case, prefix, blanks and separators aside."""
    v = F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s*sha-?256\s*[:=-]?\s*", ""), r"[^0-9a-f]", "")
    return F.when(F.length(v) == 64, v)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = with_split(read_table(spark, sf_dir, "manifest"), split_names(spark, sf_dir))
    return m.select(F.col("row_id").alias("id"), "text", (F.col("canonical_split") != "train").alias("held_out"), image_hash(F.col("sha256")).alias("image"), "canonical_split", "dataset")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_overlaps(_rows(spark, sf_dir))
    return got.select(F.least("held", "train").alias("row_a"), F.greatest("held", "train").alias("row_b"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and overlapping rows per split and dataset of the held-out row."""
    rows = _rows(spark, sf_dir)
    held = rows.select(F.col("id").alias("held"), F.col("canonical_split").alias("split"), "dataset")
    return find_overlaps(rows).join(held, "held").groupBy("split", "dataset").agg(F.count("*").alias("n_pairs"), F.countDistinct("held").alias("n_rows"))
