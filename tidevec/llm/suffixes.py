"""Suffix-array dedup: remove every byte inside a string of ``LENGTH`` bytes that also starts earlier.

Which places count as suffixes. Only equal strings need to meet, and equal strings of
LENGTH bytes choose the same place inside them: that of the smallest hash among their
``SEED``-byte substrings. The strings of a document that choose one place form a
stretch, so a document is a few stretches (about 3 for 100 bytes), each with the hash of
its seed and that of its whole content, from prefix polynomial hashes. Seeds that a
first pass finds in many texts (a common phrase, a ruler) are chosen last, wherever they
stand, so stretches around a common seed do not meet at it; common contents are reduced
to their first place in each task before anything is shuffled.

Stretches meet by the hash of their seed. Of those with equal content all but the first
go as a whole, once their bytes have been compared with the first one's: runs of such
matches between two documents fetch the earlier one's bytes once. Where one seed has stretches of different content, the first of each
content fetch their bytes and their suffixes from the seed on are sorted: a mergesort
whose comparisons find the common extension of two suffixes by binary search over
prefix hashes, so they take a logarithmic number of steps, and then compare one byte.
Neighbours' common extensions divide the sorted suffixes into classes for every length,
and those with equal bytes before the seed share a string; its first place stays. So every
match that was found by hashes is verified on the bytes, and none is removed otherwise.

Data travel packed, a binary value for many stretches, and are divided by hashes of
seeds, or by ids, over a number of buckets in proportion to the input.

Defined cases: a null text is empty; ids are integers (other types are an error); rows
that repeat an id and its text are one document and all get its result; rows of one id with
unlike texts are documents of their own, ordered by a hash of the text; a null id comes
before all others. Texts shorter than LENGTH are kept whole; longer ones are read in
sections, of any number. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from tidevec.llm.common import cut, pick, small

LENGTH = 100
SEED = 32
SECTION = 1_000_000  # bytes looked at at once, of a document or of several
BUCKET_BYTES = 6_000_000  # of text a bucket
OFTEN = 3  # times that a seed stands in a section to be counted as common
SETTLE = 8  # rounds of looking for common seeds in a section
COMMON = 100_000  # common seeds at most that are chosen last
_U = np.uint64
_LAST = _U(0xFFFFFFFFFF000000)  # rank of common seeds
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64)
_NULL = np.iinfo(np.int64).min
_powers: dict[int, np.ndarray] = {}
#: Of packed values: of places, a text has less than 2^31 bytes; to, to_t and to_lo name the later of two equal stretches.
_KINDS = {
    "g": np.uint64, "s": np.uint64, "doc": np.int64, "t": np.int32, "lo": np.int32, "w": np.uint8, "off": np.uint8,
    "n": np.int32, "to": np.int64, "to_t": np.int32, "to_lo": np.int32,
}
STRETCH = ("g", "s", "doc", "t", "lo", "w", "off")
MATCH = ("doc", "t", "lo", "n", "to", "to_t", "to_lo")


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), modulo 2^64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        x = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
        x[0] = 1
        known = _powers[base] = np.cumprod(x, dtype=np.uint64)
    return known[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Prefix:
    """Prefix polynomial hashes of a buffer: ``of(i, n)`` is the hash of n bytes from i, wherever they stand."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buf] * _power(_BASE, n), out=self.sums[1:])
        self.inverse = _power(_INVERSE, n + 1)

    def of(self, i: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.sums[i + n] - self.sums[i]) * self.inverse[i]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from minima within blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted table."""
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x if len(table) else np.zeros(x.shape, bool)


def _choose_again(memo: dict, common: np.ndarray) -> None:
    """The strings whose seeds are common now choose a place anew. All others keep theirs: what they chose is still the
    smallest, as seeds only move to the end."""
    g, place, (lo, hi, seeds) = memo["g"], memo["place"], memo["chosen"]
    w = LENGTH - SEED + 1  # a stretch has as many strings at most
    moved = np.flatnonzero(_among(seeds, common))
    for i in range(0, len(moved), 1024):
        begin, end = lo[moved[i : i + 1024], None], hi[moved[i : i + 1024], None]
        seen = np.minimum(begin + np.arange(2 * w - 1), len(g) - 1)
        rank = g[seen] >> _U(24) << _U(24)
        rank[_among(g[seen], common)] = _LAST
        best = np.lib.stride_tricks.sliding_window_view(rank | seen.astype(np.uint64), w, axis=1).min(axis=2)
        string = begin + np.arange(w)
        own = string <= end
        place[string[own]] = (best[own] & _U(0xFFFFFF)).astype(np.int64)
    # where a stretch begins is told by a string and the one before it
    string = np.unique((lo[moved, None] + np.arange(w + 1)).ravel())
    string = string[(string > 0) & (string < len(place))]
    memo["first"][string] = memo["starts"][string] & (~memo["starts"][string - 1] | (place[string] != place[string - 1]))


def stretches(parts: list[tuple[int, int, int, bytes, int]], common: np.ndarray | None = None, memo: dict | None = None) -> dict[str, np.ndarray]:
    """Stretches of (document, text hash, place of the first byte, bytes, number of strings that start in them).

    g: hash of the seed; s: of the content; doc, t; lo: first string's start; w: strings less one; off: seed from lo.
    common: hashes of seeds (sorted) to be chosen only where a string has no others. memo: kept from a call for the same
    parts, with some of the same common seeds; then only the strings that had chosen one of the others choose again.
    """
    if memo:
        _choose_again(memo, common)
    else:
        buf = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
        n = len(buf)
        size = np.array([len(p[3]) for p in parts], np.int64)
        begin = np.cumsum(size) - size
        count = np.array([p[4] for p in parts], np.int64)
        if n < LENGTH or not count.any():
            return {c: np.zeros(0, _KINDS[c]) for c in STRETCH}
        starts = np.zeros(n + 1, np.int32)
        np.add.at(starts, begin[count > 0], 1)
        np.add.at(starts, (begin + count)[count > 0], -1)
        starts = np.cumsum(starts[: n - LENGTH + 1]) > 0
        at = np.arange(n - SEED + 1)
        prefix = Prefix(buf)
        g = _mix(prefix.of(at, SEED))
        rank = g >> _U(24) << _U(24)
        if common is not None and len(common):
            few = np.zeros(1 << 16, bool)  # most seeds are told apart by some bits
            few[(common & _U(0xFFFF)).astype(np.int64)] = True
            i = np.flatnonzero(few[(g & _U(0xFFFF)).astype(np.int64)])
            rank[i[_among(g[i], common)]] = _LAST
        place = (_sliding_min(rank | at.astype(np.uint64), LENGTH - SEED + 1) & _U(0xFFFFFF)).astype(np.int64)
        first = starts.copy()
        first[1:] &= ~starts[:-1] | (place[1:] != place[:-1])
        memo = {} if memo is None else memo
        memo |= {"prefix": prefix, "g": g, "place": place, "starts": starts, "first": first, "begin": begin, "stop": begin + count}
        memo["rows"] = [np.array([x[c] for x in parts], np.int64) for c in (0, 1, 2)]
    prefix, g, begin = memo["prefix"], memo["g"], memo["begin"]
    lo = np.flatnonzero(memo["first"])
    a, owner = memo["place"][lo], np.searchsorted(begin, lo, "right") - 1
    hi = np.minimum(np.r_[lo[1:], len(memo["first"])], memo["stop"][owner]) - 1
    memo["chosen"] = lo, hi, g[a]
    s = _mix(prefix.of(lo, hi - lo + LENGTH) ^ _mix(((hi - lo) << 8 | (a - lo)).astype(np.uint64)))
    doc, t, base = memo["rows"]
    return {
        "g": g[a], "s": s, "doc": doc[owner], "t": t[owner].astype(np.int32), "lo": (lo - begin[owner] + base[owner]).astype(np.int32),
        "w": (hi - lo).astype(np.uint8), "off": (a - lo).astype(np.uint8),
    }




def _packed(key: np.ndarray, fields: dict[str, np.ndarray], name: str) -> pa.RecordBatch:
    """A row for each key with its fields as binary values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    ends = np.r_[cuts[1:], len(key)] if len(key) else cuts
    columns = [pa.array(key[cuts])]
    for x in fields.values():
        x = x[order]
        columns.append(pa.array([x[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, [name, *fields])


def _unpacked(table: pa.Table, names: tuple[str, ...] | list[str]) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(b"".join([x for x in table.column(c).to_pylist() if x is not None]), _KINDS[c]) for c in names}


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    return (_mix(x.view(np.uint64) + _U(0x9E3779B97F4A7C15)) % _U(n)).astype(np.int64)


def _owner(doc: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """Which of n groups of documents one is in: plain arithmetic, which ``_removals`` states in SQL functions too."""
    return np.mod(doc ^ t.astype(np.int64), n)


def whole_matches(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Of stretches by seed: matches of those whose content (by its hash) stands earlier with the first of that content;
    the firsts; and the firsts of seeds with several contents."""
    order = np.lexsort((x["lo"], x["t"], x["doc"], x["s"], x["g"]))
    g, s, doc, t, lo = (x[c][order] for c in ("g", "s", "doc", "t", "lo"))
    new_s = np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])][: len(g)]
    new_g = np.r_[True, g[1:] != g[:-1]][: len(g)]
    head = np.flatnonzero(new_s)[np.cumsum(new_s) - 1]
    # a place that equals the first one, or the one before it, comes from a repeated row
    again = np.r_[False, (doc[1:] == doc[:-1]) & (t[1:] == t[:-1]) & (lo[1:] == lo[:-1])][: len(g)] & ~new_s
    gone = np.flatnonzero(~new_s & ~again & ~((doc == doc[head]) & (t == t[head]) & (lo == lo[head])))
    first, own = order[head[gone]], order[gone]
    matches = {"doc": x["doc"][first], "t": x["t"][first], "lo": x["lo"][first], "n": x["w"][own].astype(np.int32) + LENGTH, "to": x["doc"][own], "to_t": x["t"][own], "to_lo": x["lo"][own]}
    contents = np.bincount((np.cumsum(new_g) - 1)[new_s])
    return matches, order[new_s], order[new_s & (contents[np.cumsum(new_g) - 1] > 1)] if len(g) else order


def joined_matches(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Matches between the same two documents at the same distance, overlapping or touching, become one."""
    order = np.lexsort((m["lo"], m["to_lo"].astype(np.int64) - m["lo"], m["to_t"], m["to"], m["t"], m["doc"]))
    m = {c: x[order] for c, x in m.items()}
    pair = np.zeros(len(order), bool)
    for c in ("doc", "t", "to", "to_t"):
        pair[1:] |= m[c][1:] != m[c][:-1]
    far = m["to_lo"].astype(np.int64) - m["lo"]
    pair[1:] |= far[1:] != far[:-1]
    pair[:1] = True
    number = np.cumsum(pair)
    of, lo, n = _merge(number, m["lo"].astype(np.int64), m["n"].astype(np.int64))
    at = np.searchsorted(number, of, "left")
    return {"doc": m["doc"][at], "t": m["t"][at], "lo": lo, "n": n, "to": m["to"][at], "to_t": m["to_t"][at], "to_lo": lo + far[at]}


class Suffixes:
    """Suffixes of segments, from each one's seed to its end, with comparisons by prefix hashes."""

    def __init__(self, buf: np.ndarray, seed: np.ndarray, end: np.ndarray):
        self.buf, self.seed, self.size, self.prefix = np.append(buf, 0), seed, end - seed, Prefix(buf)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        a, b = self.seed[i], self.seed[j]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.prefix.of(a, mid) == self.prefix.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffix i comes before j; equal ones if ``ties``."""
        n = self.common(i, j)
        ended_i, ended_j = n == self.size[i], n == self.size[j]
        by_byte = self.buf[self.seed[i] + n] < self.buf[self.seed[j] + n]
        return np.where(ended_i, ~ended_j | ties, ~ended_j & by_byte)

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Numbers of the suffixes (which come by group), sorted within each group: a bottom-up mergesort
        in which all elements of all groups look up their ranks in the other run at once."""
        n = len(group)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        count = np.diff(np.r_[first, n])
        start = np.repeat(first, count)
        stop = start + np.repeat(count, count)
        order, width, local = np.arange(n), 1, np.arange(n) - start
        while width < count.max(initial=0):
            run = local // width
            left = run % 2 == 0
            other = start + (run + np.where(left, 1, -1)) * width
            low = np.minimum(other, stop)
            begin, high = low.copy(), np.minimum(other + width, stop)
            active = np.flatnonzero(low < high)
            while len(active):
                mid = (low[active] + high[active]) >> 1
                # a right element goes behind equal left ones
                before = self.less(order[mid], order[active], False)
                tie = ~left[active]
                if tie.any():
                    before[tie] = self.less(order[mid[tie]], order[active[tie]], True)
                low[active[before]] = mid[before] + 1
                high[active[~before]] = mid[~before]
                active = active[low[active] < high[active]]
            pair = start + (run - run % 2) * width
            to = pair + local - run * width + (low - begin)
            merged = np.empty_like(order)
            merged[to] = order
            order = merged
            width *= 2
        return order


def partial_matches(x: dict[str, np.ndarray], segments: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, start of a string in the segment) for each string that an earlier stretch has too.

    x: g, doc, t, lo, w, off of the stretches; segments: their bytes one after another.
    """
    if not len(x["g"]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = x["w"].astype(np.int64) + LENGTH
    begin = np.cumsum(size) - size
    by = np.argsort(x["g"], kind="stable")
    buf = np.frombuffer(segments, np.uint8)
    begin, size = begin[by], size[by]
    g, doc, t, lo, w, off = (x[c][by] for c in ("g", "doc", "t", "lo", "w", "off"))
    lo, w, off = lo.astype(np.int64), w.astype(np.int64), off.astype(np.int64)
    suffixes = Suffixes(buf, begin + off, begin + size)
    order = suffixes.sort(g)
    common = np.zeros(len(order), np.int64)
    same = np.flatnonzero(g[order[1:]] == g[order[:-1]]) + 1
    common[same] = suffixes.common(order[same - 1], order[same])
    common[np.r_[True, g[order[1:]] != g[order[:-1]]]] = -1
    found_i, found_p = [], []
    reach = np.arange(LENGTH)
    for o in range(LENGTH - SEED + 1):
        # strings with o bytes before the seed need LENGTH - o from it on
        has = (off[order] >= o) & (off[order] - o <= w[order])
        if not has.any():
            continue
        interval = np.cumsum(common < LENGTH - o)[has]
        i = order[has]
        start = begin[i] + off[i] - o
        left = suffixes.prefix.of(start, o)
        rank = np.lexsort((lo[i] + off[i], t[i], doc[i], left, interval))
        i, start, interval, left = i[rank], start[rank], interval[rank], left[rank]
        while len(i):
            again = np.r_[False, (interval[1:] == interval[:-1]) & (left[1:] == left[:-1])]
            head = np.flatnonzero(~again)[np.cumsum(~again) - 1]
            own, first = np.flatnonzero(again), head[again]
            ok = np.empty(len(own), bool)
            for k in range(0, len(own), 20_000):  # the bytes decide
                ok[k : k + 20_000] = (buf[start[own[k : k + 20_000], None] + reach] == buf[start[first[k : k + 20_000], None] + reach]).all(1)
            earlier = (doc[i[own]] != doc[i[first]]) | (t[i[own]] != t[i[first]]) | (lo[i[own]] + off[i[own]] != lo[i[first]] + off[i[first]])
            found_i.append(by[i[own[ok & earlier]]])
            found_p.append((start[own] - begin[i[own]])[ok & earlier])
            other = own[~ok]  # equal hashes of other bytes are looked at again among themselves
            i, start, interval, left = i[other], start[other], interval[other], left[other]
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_p)


def _merge(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of a document become one."""
    if not len(doc):
        return doc, lo, n
    order = np.lexsort((lo, doc))
    doc, lo, stop = doc[order], lo[order], (lo + n)[order]
    number = np.cumsum(np.r_[True, doc[1:] != doc[:-1]])
    span = np.int64(1) << 40
    reach = np.maximum.accumulate(stop + number * span)  # no span of an earlier document reaches into a later one
    new = np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] + number[1:] * span > reach[:-1])]
    at = np.flatnonzero(new)
    stops = reach[np.r_[at[1:], len(doc)] - 1] - number[at] * span
    return doc[at], lo[at], stops - lo[at]


def _numbered(doc: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different documents (rows of id and text hash) in order, and each one's number."""
    return np.unique(np.stack([doc, t.astype(np.int64)], 1), axis=0, return_inverse=True)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    return _finish(*_removals(docs, id_col, text_col), id_col)


def _sections(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, int, bytes, int]]]:
    """Lists of (document, text hash, place, bytes, strings that start there) of about SECTION bytes each. batch: doc, t, text."""
    parts, size = [], 0
    for doc, t, raw in zip(*(batch.column(c).to_pylist() for c in (0, 1)), batch.column(2).cast(pa.binary()).to_pylist()):
        for i in range(0, max(1, len(raw) - LENGTH + 1), SECTION):
            part = raw[i : i + SECTION + LENGTH - 1]
            parts.append((doc, t, i, part, max(0, len(part) - LENGTH + 1)))
            size += len(part)
            if size >= SECTION:
                yield parts
                parts, size = [], 0
    yield parts


def _common_seeds(own: DataFrame) -> np.ndarray:
    """Sorted hashes of the seeds that stand in most stretches, of those that stand in several of a section. Which ones they
    are changes how stretches meet, not what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in _sections(batch):
                memo, known, often = {}, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                for _ in range(SETTLE):
                    x = stretches(parts, known, memo)
                    # of one content, one stretch counts
                    order = np.lexsort((x["s"], x["g"]))
                    g, s = x["g"][order], x["s"][order]
                    g, n = np.unique(g[np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])][: len(g)]], return_counts=True)
                    new = (n >= OFTEN) & ~_among(g, known)
                    if not new.any():
                        break
                    # without these, strings choose others, which can be common too: a phrase and a letter beside it
                    known, often = np.r_[known, g[new]], np.r_[often, n[new]]
                    order = np.argsort(known)
                    known, often = known[order], often[order]
                yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(often)], ["g", "n"])

    found = own.select("doc", "t", "text").mapInArrow(run, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n"))
    return np.sort(found.orderBy(F.desc("n"), "g").limit(COMMON).select("g").toArrow().column("g").to_numpy().view(np.uint64))


def _removals(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The texts with their id, doc (the id, null as the smallest), t (hash of the text) and owner; and by owner, packed, the
    spans to remove, some with the bytes that must stand there."""
    spark = docs.sparkSession
    own = pick(docs, id=id_col, text=text_col)
    if own.schema["id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be an integer column")
    own = own.select(F.col("id").cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("doc", F.coalesce("id", F.lit(_NULL))).withColumn("t", F.hash("text"))
    total = own.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES)) | 1
    common = spark.sparkContext.broadcast(_common_seeds(own))
    kinds = ", ".join(f"{c} binary" for c in STRETCH)
    local = [f"m_{c}" for c in MATCH]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches by bucket, the first of each content, and the matches with those, which travel with them."""
        for batch in batches:
            for parts in _sections(batch):
                x = stretches(parts, common.value)
                if not len(x["g"]):
                    continue
                x["bucket"] = _bucket(x["g"], buckets)
                matches, firsts, _ = whole_matches(x)
                rows = _packed(x["bucket"][firsts], {c: x[c][firsts] for c in STRETCH}, "bucket")
                for name in local:
                    rows = rows.append_column(name, pa.nulls(rows.num_rows, pa.binary()))
                yield rows
                if len(matches["doc"]):
                    more = _packed(_owner(matches["doc"], matches["t"], buckets), {f"m_{c}": matches[c] for c in MATCH}, "bucket")
                    none = [pa.nulls(more.num_rows, pa.binary())] * len(STRETCH)
                    yield pa.RecordBatch.from_arrays([more.column(0), *none, *more.columns[1:]], ["bucket", *STRETCH, *local])

    def meet(table: pa.Table) -> pa.Table:
        """By owner of the earlier document: matches, and stretches whose bytes are needed."""
        x = _unpacked(table, STRETCH)
        matches, _, several = whole_matches(x)
        before = {c: np.frombuffer(b"".join([v for v in table.column(f"m_{c}").to_pylist() if v is not None]), _KINDS[c]) for c in MATCH}
        matches = joined_matches({c: np.concatenate([matches[c], before[c]]).astype(_KINDS[c]) for c in MATCH})
        out = pa.Table.from_batches([_packed(_owner(matches["doc"], matches["t"], buckets), {c: matches[c].astype(_KINDS[c]) for c in MATCH}, "owner")])
        asked = {c: x[c][several] for c in ("doc", "t", "lo", "g", "w", "off")}
        more = pa.Table.from_batches([_packed(_owner(asked["doc"], asked["t"], buckets), asked, "owner")])
        return pa.concat_tables([out, more], promote_options="default").select(["owner", *MATCH, "g", "w", "off"])

    scanned = own.select("doc", "t", "text").mapInArrow(scan, f"bucket bigint, {kinds}, {', '.join(f'{c} binary' for c in local)}")
    by_owner = ", ".join(f"{c} binary" for c in (*MATCH, "g", "w", "off"))
    first = cut(scanned.groupBy("bucket").applyInArrow(meet, f"owner bigint, {by_owner}"))

    # documents whose bytes are needed
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, _ = _numbered(np.frombuffer(d, np.int64), np.frombuffer(t, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1].astype(np.int32))], ["doc", "t"])

    wanted = cut(first.select("doc", "t").mapInArrow(names, "doc bigint, t int").distinct())
    keyed = own.withColumn("owner", F.pmod(F.col("doc").bitwiseXOR(F.col("t").cast("bigint")), F.lit(buckets)))
    some = keyed.join(small(wanted), ["doc", "t"], "left_semi").select("owner", "doc", "t", "text")

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        """The bytes of the wanted stretches, by seed; and those of matches, by the later document's owner."""
        texts = dict(zip(zip(left.column("doc").to_pylist(), left.column("t").to_pylist()), left.column("text").cast(pa.binary()).to_pylist()))
        asked = right.filter(pa.compute.is_valid(right.column("g")))
        x = _unpacked(asked, ["doc", "t", "lo", "g", "w", "off"])
        m = joined_matches(_unpacked(right.filter(pa.compute.is_null(right.column("g"))), MATCH))
        n = x["w"].astype(np.int64) + LENGTH
        requests = _with_bytes(texts, _bucket(x["g"], buckets), {c: x[c] for c in ("doc", "t", "lo", "g", "w", "off")}, x["doc"], x["t"], x["lo"], n)
        spans = {"doc": m["to"], "t": m["to_t"], "lo": m["to_lo"].astype(np.int32), "n": m["n"].astype(np.int32)}
        matches = _with_bytes(texts, _owner(m["to"], m["to_t"], buckets), spans, m["doc"], m["t"], m["lo"], m["n"])
        return pa.concat_tables([requests, matches], promote_options="default").select(["bucket", "doc", "t", "lo", "g", "w", "off", "n", "bytes"])

    got = some.groupBy("owner").cogroup(first.groupBy("owner"))
    got = got.applyInArrow(fetch, "bucket bigint, doc binary, t binary, lo binary, g binary, w binary, off binary, n binary, bytes binary")

    def sort(table: pa.Table) -> pa.Table:
        """Spans of strings that an earlier suffix has too. Matches go on as they are: their bucket is their owner."""
        valid = pa.compute.is_valid(table.column("g"))
        own, passing = table.filter(valid), table.filter(pa.compute.invert(valid))
        x = _unpacked(own, ["doc", "t", "lo", "g", "w", "off"])
        i, p = partial_matches(x, b"".join(own.column("bytes").to_pylist()))
        docs_, number = _numbered(x["doc"][i], x["t"][i])
        of, lo, n = _merge(number, x["lo"][i].astype(np.int64) + p, np.full(len(i), LENGTH, np.int64))
        spans = {"doc": docs_[of, 0], "t": docs_[of, 1].astype(np.int32), "lo": lo.astype(np.int32), "n": n.astype(np.int32)}
        found = pa.Table.from_batches([_packed(_owner(spans["doc"], spans["t"], buckets), spans, "owner")])
        return pa.concat_tables([found, passing.select(["bucket", "doc", "t", "lo", "n", "bytes"]).rename_columns(["owner", "doc", "t", "lo", "n", "bytes"])], promote_options="default")

    spans = got.groupBy("bucket").applyInArrow(sort, "owner bigint, doc binary, t binary, lo binary, n binary, bytes binary")
    return keyed, spans


def _with_bytes(texts: dict, key: np.ndarray, fields: dict[str, np.ndarray], doc: np.ndarray, t: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.Table:
    """Fields packed by key, and the n bytes at lo of each one's document."""
    segments = [texts[d, h][i : i + m] for d, h, i, m in zip(doc.tolist(), t.tolist(), lo.tolist(), n.tolist())]
    order = np.argsort(key, kind="stable")
    rows = _packed(key, fields, "bucket")
    joined, i = [], 0
    for size in np.unique(key, return_counts=True)[1].tolist():
        joined.append(b"".join([segments[j] for j in order[i : i + size]]))
        i += size
    return pa.Table.from_batches([rows.append_column("bytes", pa.array(joined, pa.binary()))])


def _finish(keyed: DataFrame, spans: DataFrame, id_col: str) -> DataFrame:
    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        raws = left.column("text").cast(pa.binary()).to_pylist()
        own = list(zip(left.column("doc").to_pylist(), left.column("t").to_pylist()))
        texts = dict(zip(own, raws))
        x = _unpacked(right, ["doc", "t", "lo", "n"])
        for row in right.filter(pa.compute.is_valid(right.column("bytes"))).to_pylist():
            at, there = 0, row["bytes"]
            m = {c: np.frombuffer(row[c], _KINDS[c]).tolist() for c in ("doc", "t", "lo", "n")}
            for d, t, lo, n in zip(m["doc"], m["t"], m["lo"], m["n"]):
                if texts[d, t][lo : lo + n] != there[at : at + n]:
                    raise RuntimeError("two contents have one hash; run again with other values in _BYTE")
                at += n
        docs_, number = _numbered(x["doc"], x["t"])
        of, lo, n = _merge(number, x["lo"].astype(np.int64), x["n"].astype(np.int64))
        where = {(d, t): (i, j) for (d, t), i, j in zip(docs_.tolist(), np.searchsorted(of, np.arange(len(docs_)), "left").tolist(), np.searchsorted(of, np.arange(len(docs_)), "right").tolist())}
        out = []
        for name, raw in zip(own, raws):
            kept, at, removed = [], 0, 0
            i, j = where.get(name, (0, 0))
            for a, b in zip(lo[i:j].tolist(), (lo[i:j] + n[i:j]).tolist()):
                kept.append(raw[at:a])
                removed += b - a
                at = b
            kept.append(raw[at:])
            out.append((len(raw), removed, j - i, hashlib.sha256(b"".join(kept)).hexdigest()))
        columns = list(zip(*out)) if out else [[], [], [], []]
        return pa.table([left.column("id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = keyed.select("owner", "id", "doc", "t", "text")
    return rows.groupBy("owner").cogroup(spans.groupBy("owner")).applyInArrow(apply, f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def oracle() -> str:
    """DuckDB SQL for ``dedup`` on documents: every string of LENGTH bytes, grouped by its hexadecimal digits."""
    n = LENGTH
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM (SELECT DISTINCT doc_id, text FROM documents)),
s AS (SELECT doc_id, pos, md5_number(substr(x, 2 * pos + 1, {2 * n})) AS s FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - {n - 1})) AS pos FROM d)),
again AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS r FROM s) WHERE r > 1
),
runs AS (
  SELECT doc_id, min(pos) AS a, max(pos) + {n} AS b FROM (
    SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (
      SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {n} THEN 0 ELSE 1 END AS fresh FROM again))
  GROUP BY doc_id, run
),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM runs GROUP BY doc_id
),
parts AS (
  SELECT d.doc_id, x, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed,
    list_prepend(0, coalesce(b, [])) AS begins, list_append(coalesce(a, []), len(x) // 2) AS ends
  FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans,
  sha256(unhex(list_aggregate(list_transform(range(1, len(begins) + 1), lambda i: substr(x, 2 * begins[i] + 1, 2 * (ends[i] - begins[i]))), 'string_agg', ''))) AS kept_sha256
FROM parts"""
