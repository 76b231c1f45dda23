"""Exact substring de-duplication by hash-compared suffix sort.

A byte is removed where a string of LENGTH bytes that covers it starts anywhere else. Any such string holds the same anchors in both
places: the places whose GRAM-byte hash is least within a window (all of them, on ties). So only suffixes at anchors whose hash occurs
again are sorted, group by group. Suffixes are compared by binary search over prefix polynomial hashes for their common extension, and a
merge sort ranks each run's suffixes in its sibling by such comparisons. A pair's common extension to the right is then the least of the
neighbours' between them, to the left it is searched the same way; where both make LENGTH bytes, the pair's run is removed. In groups of
over PAIRED members no pairs are listed: the texts before the anchors are sorted in the same way, from the anchor backwards, and for each
share of LENGTH to either side the two orders' runs of common extension meet, which gives the members that agree on both.
Collision verification: neighbours' order and common extension, and what a pair shares to the left, are compared byte by byte, so a run is
removed only where bytes agree; a group where hashes deceived is done again by bytes. Equal bytes always have equal hashes.

A group of over LARGE members never meets in one task. Members all of whose windows are equal are settled by a 128-bit BLAKE2 digest, counted
in each file first, and one stands for them. If still more are left, their windows are split by how much of them stands before the anchor,
in PARTS ranges: members that share what all windows of a range have in common form the range's groups, and those whose windows of the
range are all equal are settled likewise; and so on, until a range is a single window.

Texts that occur again as a whole are settled by their digest too, and one of each stands for all. Null counts as empty, texts shorter than
LENGTH lose nothing, texts of any length are read whole, every row gives a row, also repeated ones (equal ids, null ids); an empty table
gives none. Matches are judged on the input, of ties all go. Columns other than id and text are not read."""

from __future__ import annotations

import hashlib
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped, saved, table
from .spool import Spool

LENGTH, GRAM = 400, 128
PAIRED, LARGE, PARTS, BATCH_ROWS = 64, 1 << 14, 3, 1000
_RNG = np.random.default_rng(7_400)
_BYTE = _RNG.integers(1, 1 << 64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1 << 62, 1 << 63)) | 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        for b in (_BASE, inverse):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _POWERS.append(np.cumprod(x, dtype=np.uint64))
        del _POWERS[:-2]
    return _POWERS[0][:n], _POWERS[1][:n]


class Hashes:
    """Prefix polynomial hashes of a buffer of strings that end at ``ends``; equal substrings of any two have equal hashes. Powers count
    from each string's start, so their tables are as long as the longest string only."""

    def __init__(self, buf: np.ndarray, ends: np.ndarray):
        self.buf, self.n = buf, len(buf)
        size = np.diff(ends, prepend=0)
        self.local = np.empty(self.n + 1, np.int32)
        self.local[:-1] = np.arange(self.n) - np.repeat(ends - size, size)
        self.local[-1] = size[-1] if len(size) else 0
        up, self.down = powers(int(size.max(initial=0)) + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        for a in range(0, self.n, 1 << 18):
            z = min(a + (1 << 18), self.n)
            self.sums[a + 1 : z + 1] = np.cumsum(_BYTE[buf[a:z]] * up[self.local[a:z]], dtype=np.uint64) + self.sums[a]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[self.local[a]]

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Length of the common extension of places i and j, forwards or backwards, at most ``most``, by binary search."""
        found = np.zeros(len(i), np.int64)
        step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        while step:
            n = found + step
            fits = n <= most
            n = np.where(fits, n, found)
            same = self.of(i - n, i) == self.of(j - n, j) if back else self.of(i, i + n) == self.of(j, j + n)
            found = np.where(fits & same, n, found)
            step >>= 1
        return found


def _window_min(x: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """op over x[s : s + w] for every s with a whole window, from running values within blocks of w."""
    n = len(x)
    full = -(-n // w) * w
    fill = np.iinfo(x.dtype).max if op is np.minimum else 0
    blocks = np.concatenate([x, np.full(full - n, fill, x.dtype)]).reshape(-1, w)
    head = op.accumulate(blocks, axis=1).ravel()
    tail = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[: n - w + 1], head[w - 1 : n])


def anchors(buf: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) in a buffer of texts of ``length`` bytes or more that end at ``ends``."""
    w, n = length - gram + 1, len(buf)
    sums = Hashes(buf, ends)
    at = np.arange(n - gram + 1)
    h = sums.of(at, at + gram)
    h = ((h ^ (h >> np.uint64(29))) * _MIX) >> np.uint64(1) | np.uint64(1)
    for e in ends[:-1]:
        h[e - gram + 1 : e] = np.iinfo(np.uint64).max
    least = _window_min(h, w)
    for e in ends[:-1]:
        least[e - length + 1 : e] = 0
    # place i is an anchor if it holds the least hash of some window that has it
    held = _window_min(np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(len(h) - len(least), np.uint64)]), w, np.maximum)
    found = np.flatnonzero(held == h)
    return found, h[found].view(np.int64)


def suffix_order(sums: Hashes, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sorts the suffixes at ``at`` (of ``size`` bytes) within equal, adjacent ``group``: merge sort, all groups at once. A suffix's place in
    the merged run is its place in its own plus the number of its sibling's suffixes before it, found by binary search."""
    n = len(at)
    order = np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    start = np.repeat(first, np.diff(np.append(first, n)))
    stop = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    place = np.arange(n) - start
    width = 1
    while width < (stop - start).max(initial=0):
        run = place // width
        other = start + (run ^ 1) * width
        low, high = np.minimum(other, stop), np.minimum(other + width, stop)
        moved = np.flatnonzero(low < high)
        lo, hi, left = low[moved].copy(), high[moved].copy(), (run[moved] & 1) == 0
        a = order[moved]
        while (open_ := lo < hi).any():
            k = np.flatnonzero(open_)
            mid = (lo[k] + hi[k]) >> 1
            b = order[mid]
            most = np.minimum(size[a[k]], size[b])
            n_same = sums.common(at[a[k]], at[b], most)
            over = n_same == most
            x, y = at[a[k]] + n_same, at[b] + n_same
            cx, cy = sums.buf[np.minimum(x, sums.n - 1)].astype(np.int64), sums.buf[np.minimum(y, sums.n - 1)].astype(np.int64)
            below = np.where(over, np.where(left[k], size[b] < size[a[k]], size[b] <= size[a[k]]), cy < cx)
            lo[k] = np.where(below, mid + 1, lo[k])
            hi[k] = np.where(below, hi[k], mid)
        to = start[moved] + (run[moved] & ~1) * width + (place[moved] - run[moved] * width) + (lo - low[moved])
        fresh = order.copy()
        fresh[to] = order[moved]
        order = fresh
        width *= 2
    return order


def _exact(lefts: list[bytes], rights: list[bytes], length: int) -> list[tuple[int, int]]:
    """(bytes before, bytes after) the anchor that repeat, for each member, by plain strings: for hashes that deceived."""
    best = [(0, 0)] * len(lefts)
    for d in range(max(map(len, lefts)) + 1):
        met: dict[bytes, list[int]] = {}
        for i, (x, y) in enumerate(zip(lefts, rights, strict=True)):
            if len(x) >= d and len(y) >= length - d:
                met.setdefault(x[len(x) - d :] + y[: length - d], []).append(i)
        for own in met.values():
            for i in own if len(own) > 1 else ():
                best[i] = (max(best[i][0], d), max(best[i][1], length - d))
    return best


def _agree(texts: list[bytes], i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether texts i and j agree on their first n bytes and are in order."""
    return np.fromiter((texts[x][:k] == texts[y][:k] and texts[x] <= texts[y] for x, y, k in zip(i.tolist(), j.tolist(), n.tolist(), strict=True)), bool, len(i))


def _ordered(sums: Hashes, texts: list[bytes], at: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the suffixes, each one's common extension with the one before it or -1 at a group's first, groups where hashes deceived)."""
    order = suffix_order(sums, at, size, group)
    i, j = order[:-1], order[1:]
    k = np.flatnonzero(group[i] == group[j])
    common = np.full(len(at), -1, np.int64)
    common[k + 1] = sums.common(at[i[k]], at[j[k]], np.minimum(size[i[k]], size[j[k]]))
    return order, common, group[i[k[~_agree(texts, i[k], j[k], common[k + 1])]]]


def _meeting(order: np.ndarray, lcp: np.ndarray, back: np.ndarray, lcs: np.ndarray, nl: np.ndarray, nr: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, after) of the members of large groups, from both orders: at each distance d those with the d bytes before and the length - d
    bytes after the anchor in common are runs of either order."""
    n = len(order)
    before, after, hit = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    r, l = np.empty(n, np.int64), np.empty(n, np.int64)
    changes = np.zeros(length + 2, bool)  # distances at which a run or a member comes or goes
    for x in (length - lcp, lcs + 1, length - nr, nl + 1):
        changes[np.clip(x, 0, length + 1)] = True
    for d in range(int(nl.max(initial=0)) + 1):
        if changes[d] or not d:
            r[order], l[back] = np.cumsum(lcp < length - d), np.cumsum(lcs < d)
            m = np.flatnonzero((nl >= d) & (nr >= length - d))
            key = l[m] * (n + 1) + r[m]
            by = np.argsort(key, kind="stable")
            same = key[by[1:]] == key[by[:-1]]
            hit[:] = False
            hit[m[by[1:][same]]] = hit[m[by[:-1][same]]] = True
        before[hit] = d
        after[hit] = np.maximum(after[hit], length - d)
    return before, after


def repeats(group: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For members of adjacent groups that share an anchor: how many bytes before and after it are to go (0, 0: none)."""
    n = len(group)
    nl, nr = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    ends = np.cumsum(nl + nr)
    at = ends - nr
    sums = Hashes(np.frombuffer(b"".join(x for p in zip(lefts, rights, strict=True) for x in p), np.uint8), ends)
    order, lcp, deceived = _ordered(sums, rights, at, nr, group)
    wrong = set(deceived.tolist())
    before, after, why = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)

    def note(i, j, l, r):
        for a, b in ((i, j), (j, i)):
            # a member may come up once for each distance only, so plain assignment is enough
            up = l > before[a]
            before[a[up]], why[a[up]] = l[up], b[up]
            after[a] = np.maximum(after[a], r)

    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.diff(np.append(first, n))
    stop = np.repeat(first + count, count)
    many = np.repeat(count > PAIRED, count)
    k = np.flatnonzero(~many)
    r = np.full(n, np.iinfo(np.int64).max)
    lefts_of: dict[int, list] = {}
    for distance in range(1, PAIRED):
        k = k[k + distance < stop[k]]
        r[k] = np.minimum(r[k], lcp[k + distance])
        k = k[r[k] + nl[order[k]] >= length]  # extensions only shrink with the distance
        if not len(k):
            break
        i, j = order[k], order[k + distance]
        most = np.minimum(nl[i], nl[j])
        ok = r[k] + most >= length
        i, j, own = i[ok], j[ok], r[k][ok]
        if len(i):
            l = sums.common(at[i], at[j], most[ok], back=True)
            ok = l + own >= length
            note(i[ok], j[ok], l[ok], own[ok])
            for g, x, y, c in zip(group[i[ok]].tolist(), i[ok].tolist(), j[ok].tolist(), l[ok].tolist(), strict=True):
                lefts_of.setdefault(g, []).append((x, y, c))
    for g, pairs in lefts_of.items():  # what the pairs found to the left
        if any(lefts[x][len(lefts[x]) - c :] != lefts[y][len(lefts[y]) - c :] for x, y, c in pairs):
            wrong.add(g)
    if many.any():
        own = np.flatnonzero(many)
        mirrored = [lefts[m][::-1] for m in own]
        to = np.cumsum(nl[own])
        back, lcs, deceived = _ordered(Hashes(np.frombuffer(b"".join(mirrored), np.uint8), to), mirrored, to - nl[own], nl[own], group[own])
        wrong.update(deceived.tolist())
        place = np.cumsum(many) - 1
        kept = many[order]
        before[own], after[own] = _meeting(place[order[kept]], lcp[kept], back, lcs, nl[own], nr[own], length)
    for g in wrong:
        own = np.flatnonzero(group == g)
        for m, (l, r_) in zip(own, _exact([lefts[x] for x in own], [rights[x] for x in own], length), strict=True):
            before[m], after[m] = l, r_
    return before, after


def _split(spool: Spool, members: DataFrame, length: int, parts: int) -> DataFrame:
    """The members (f, row, pos; x, y: the least and most bytes of their windows before the anchor) by range of their windows: g for what they
    have in common, (k1, k2) for all that they cover. A row for each of these and file: n members, one of them, and what they cover."""

    def split(f, rows, side):
        row, pos, lo, hi = (side[c] for c in ("row", "pos", "x", "y"))
        met: dict[bytes, list] = {}
        for _, texts, n in rows:
            s, e = np.searchsorted(row, [n, n + len(texts)])
            for r, p, x, y in zip(*(c[s:e].tolist() for c in (row, pos, lo, hi)), strict=True):
                t = texts[r - n]
                least, most, step = max(x, length - (len(t) - p)), min(y, p), -(-(y - x + 1) // parts)
                for a in range(x, y + 1, step):
                    b = min(a + step - 1, y)
                    if max(a, least) <= min(b, most):
                        start, end, name = p - min(b, most), p + length - max(a, least), struct.pack("<iiii", a, b, max(a, least), min(b, most))
                        key = hashlib.blake2b(t[p - a : p + length - b] + name[:8], digest_size=8).digest() + hashlib.blake2b(t[start:end] + name, digest_size=16).digest()
                        if (own := met.get(key)) is None:
                            met[key] = [1, r, p, a, b, array("q", (r, start, end))]
                            continue
                        own[0] += 1
                        if own[5][-3] == r and start <= own[5][-1]:  # members come in order of place
                            own[5][-1] = end
                        else:
                            own[5].extend((r, start, end))
        keys, own = list(met), list(met.values())
        for at in range(0, len(keys), 2000):
            k = np.frombuffer(b"".join(keys[at : at + 2000]), np.int64).reshape(-1, 3)
            *cols, spans = zip(*own[at : at + 2000], strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(k[:, c].copy()) for c in range(3)), pa.array(np.full(len(k), f)), *(pa.array(c, pa.int64()) for c in cols), pa.array([x.tobytes() for x in spans], pa.binary())], ["g", "k1", "k2", "f", "n", "row", "pos", "x", "y", "spans"])

    return spool.each(members, split, ", ".join(f"{c} bigint" for c in ("g", "k1", "k2", "f", "n", "row", "pos", "x", "y")) + ", spans binary")


def _unpacked(settled: DataFrame) -> DataFrame:
    """(f, row, a, z) from (f, spans)."""

    def run(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            own = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 3)
            f = np.repeat(batch.column(0).to_numpy(), [len(x) // 24 for x in raw])
            for at in range(0, len(own), 10_000):
                k = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(f[k]), *(pa.array(own[k, c]) for c in range(3))], ["f", "row", "a", "z"])

    return settled.mapInArrow(run, "f bigint, row bigint, a bigint, z bigint")


def _divided(members: DataFrame, group: DataFrame, large: int) -> tuple[DataFrame, DataFrame, bool]:
    """(members of groups that one task can hold, of larger ones, whether there are such); a member alone is in neither."""
    sizes = saved(members.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "group-sizes")
    few, many = (sizes.where(x).select("g") for x in (F.col("n") <= large, F.col("n") > large))
    # the groups grow with the corpus, so that side is not for broadcasting at any size; the large ones are few (one in ``large`` members at
    # most), so members are shuffled once, not again for these
    return group.join(few.hint("merge"), "g"), group.join(many.hint("broadcast"), "g"), not many.isEmpty()


def removed(spool: Spool, length: int = LENGTH, gram: int = GRAM, large: int = LARGE) -> DataFrame:
    """(f, row, a, z): byte ranges to remove, overlapping ones included. ``large``: members that meet in a task at most."""
    copies = saved(spool.copies(), "copies")

    def find(f, rows, side):
        skip = set(side["row"].tolist())
        for _, texts, n in rows:
            own = [(n + i, x) for i, x in enumerate(texts) if len(x) >= length and n + i not in skip]
            if not own:
                continue
            sizes = np.array([len(x) for _, x in own])
            ends = np.cumsum(sizes)
            at, h = anchors(np.frombuffer(b"".join(x for _, x in own), np.uint8), ends, length, gram)
            doc = np.searchsorted(ends, at, "right")
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), f)), pa.array(np.array([r for r, _ in own])[doc]), pa.array(at - (ends - sizes)[doc])], ["g", "f", "row", "pos"])

    found = saved(spool.each(copies.where("not first").select("f", "row"), find, "g bigint, f bigint, row bigint, pos bigint"), "anchors")
    ranged = lambda df: df.select("g", "f", "row", "pos", F.lit(0).cast("long").alias("x"), F.lit(length - gram).cast("long").alias("y"))
    small, more, any_more = _divided(found, ranged(found), large)
    settled, parts = [], 1  # equal windows as a whole first
    while any_more:  # at most 1 + log(length - gram + 1) / log(PARTS) times
        rows, parts = saved(_split(spool, more.select("f", "row", "pos", "x", "y"), length, parts), "ranges"), PARTS
        settled.append(_unpacked(rows.where("n > 1").select("f", "spans")))
        # a class has a row a file at most, here with the span of a member that is alone in its file: what has several there is settled already
        own = Window.partitionBy("g", "k1", "k2")
        classes = rows.withColumn("spans", F.expr("if(n = 1, spans, null)")).withColumn("nth", F.row_number().over(own.orderBy("f"))).withColumn("files", F.count("*").over(own))
        classes = saved(classes.where("nth = 1 or spans is not null").select("g", "f", "row", "pos", "x", "y", F.expr("nth = 1").alias("first"), F.expr("if(files > 1, spans, null)").alias("spans")), "classes")
        settled.append(_unpacked(classes.where("spans is not null").select("f", "spans")))
        ones = classes.where("first").drop("first", "spans")
        fewer, more, any_more = _divided(ones, ones, large)
        small = small.unionByName(fewer)

    def cut(f, rows, side):
        row, pos, g, x, y = (side[c] for c in ("row", "pos", "g", "x", "y"))
        for _, texts, n in rows:
            a, b = np.searchsorted(row, [n, n + len(texts)])
            for s in range(a, b, 5000):
                z = min(s + 5000, b)
                left = [texts[r - n][max(0, p - k) : p] for r, p, k in zip(row[s:z].tolist(), pos[s:z].tolist(), y[s:z].tolist(), strict=True)]
                right = [texts[r - n][p : p + length - k] for r, p, k in zip(row[s:z].tolist(), pos[s:z].tolist(), x[s:z].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(g[s:z]), pa.array(np.full(z - s, f)), pa.array(row[s:z]), pa.array(pos[s:z]), pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["g", "f", "row", "pos", "before", "after"])

    around = spool.each(small, cut, "g bigint, f bigint, row bigint, pos bigint, before binary, after binary")

    def sort(batches):
        def done(t):
            before, after = repeats(t["g"].to_numpy(), t["before"].to_pylist(), t["after"].to_pylist(), length)
            k = np.flatnonzero(before + after >= length)
            pos = t["pos"].to_numpy()[k]
            return pa.RecordBatch.from_arrays([pa.array(t["f"].to_numpy()[k]), pa.array(t["row"].to_numpy()[k]), pa.array(pos - before[k]), pa.array(pos + after[k])], ["f", "row", "a", "z"])

        for t in grouped(batches, ["g"]):
            g, a = t["g"].to_numpy(), 0
            stops = np.append(np.flatnonzero(g[1:] != g[:-1]) + 1, len(g))
            for z in stops:  # whole groups, about BATCH_ROWS at a time
                if z - a >= BATCH_ROWS or z == len(g):
                    yield done(t.slice(a, z - a))
                    a = z

    spans = around.repartition("g").sortWithinPartitions("g").mapInArrow(sort, "f bigint, row bigint, a bigint, z bigint")
    whole = copies.join(spool.rows.select("f", "row", "n"), ["f", "row"]).where(F.col("n") >= length).select("f", "row", F.lit(0).cast("long").alias("a"), F.col("n").alias("z"))
    for own in (*settled, whole):
        spans = spans.unionByName(own)
    return saved(spans, "spans")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, large: int = LARGE) -> DataFrame:
    """(id, n_bytes, spans: removed (start, end) runs, kept: remaining bytes), a row for each row."""
    spool = Spool(docs, id_col, text_col)
    item = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def keep(f, rows, side):
        row, a, z = side["row"], side["a"], side["z"]
        for ids, texts, n in rows:
            s, e = np.searchsorted(row, [n, n + len(texts)])
            runs: list[list] = [[] for _ in texts]
            for r, x, y in sorted(zip(row[s:e].tolist(), a[s:e].tolist(), z[s:e].tolist(), strict=True)):
                own = runs[r - n]
                if own and x <= own[-1]["end"]:
                    own[-1]["end"] = max(own[-1]["end"], y)
                else:
                    own.append({"start": x, "end": y})
            kept = [b"".join(t[p:q] for p, q in zip([0, *(x["end"] for x in own)], [*(x["start"] for x in own), len(t)], strict=True)) for t, own in zip(texts, runs, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts]), pa.array(runs, item), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    out = spool.each(removed(spool, length, gram, large), keep, f"id {spool.id_type}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def op7_suffixes(spark, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
