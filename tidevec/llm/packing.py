"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents become token ids (one end id after each); those longer than the capacity
are cut into pieces of full capacity and a rest. How many pieces there are of each
length, at most ``capacity`` numbers, is all that packing needs:

1. Martello-Toth reduction: going from the longest pieces down, sets that dominate
   every other way to complete such a bin are fixed at once: a piece that nothing
   fits beside; a piece with its exact complement; a piece with the longest one that
   fits, where not even the two shortest would fit together; and the same where at
   most two more fit and no pair of them fills more. The instance shrinks by them.
2. Best fit, longest first, for the remainder. Bins of equal content are kept as one
   pattern with a count, so the work depends on the capacity, not on the corpus.

The patterns, again bounded by the capacity, then give the pieces of a length their
places by rank. Ranks are taken in salted groups with counted starts, so no length,
however common, meets in one task.

Defined cases: a null text is empty and becomes the end id alone; rows with equal
ids or texts are all packed; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from tidevec.llm.common import cut, pick

CAPACITY = 4096
END = 1
CACHE = 400_000  # white-space separated chunks whose ids a worker remembers
SEEN = 1 << 23  # hashes of chunks that were met
MARK = ";"  # stands between words that are encoded together
#: What a tokenizer file must say for a text's ids to be those of its chunks between white space, one after another:
#: normalisation that never reaches over white space, and a split at it. Fixed values.
CHUNKED = {
    "normalizer": ["NFC", {"Regex": "\\s+"}, "Lowercase"],
    "pre_tokenizer": ["'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", "ByteLevel"],
}
#: Letters that normalisation maps to single letters, so that a word of them is a token run of its own whatever signs
#: follow: ASCII and the Latin blocks up to U+024F, without the dotted capital I, which becomes a letter and a mark.
_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?&#%*$()]*)")
_ODD = re.compile("[\x1c-\x1f\x85]")  # white space to Python or to the tokenizer, but not to both


def is_chunked(path: str) -> bool:
    """Whether the file's tokenizer works on chunks between white space (see ``CHUNKED``)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = [n.get("pattern", n["type"]) for n in (spec["normalizer"] or {}).get("normalizers", [])]
    split = [p["pattern"]["Regex"] if p["type"] == "Split" else p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] != "Split" or "Regex" in p["pattern"]]
    return normal == CHUNKED["normalizer"] and split == CHUNKED["pre_tokenizer"]


class Encoder:
    """The ids of whole texts, as little-endian bytes. Chunks between white space, and words before signs, are encoded
    once and remembered where the tokenizer file allows it; any other file's tokenizer gets the whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the cores
        self.tokenizer, self.chunked = Tokenizer.from_file(path), is_chunked(path)
        self.known: dict[str, bytes] = {}
        self.met = bytearray(SEEN)  # which chunks, by hash, came before: the memory's second half is for those that come again
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if t and (not self.chunked or _ODD.search(t))]
        out = dict(zip(whole, self._tokenize([texts[i] for i in whole])))
        chunks = [[] if i in out or not t else t.split() for i, t in enumerate(texts)]
        found = [list(map(self.known.get, c)) for c in chunks]
        more = self._learn({c for own, got in zip(chunks, found) if None in got for c, g in zip(own, got) if g is None})
        return [out[i] if i in out else b"".join([more[c] if g is None else g for c, g in zip(own, got)] if None in got else got) for i, (own, got) in enumerate(zip(chunks, found))]

    def _tokenize(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _tokenize_words(self, words: list[str]) -> list[bytes]:
        """``_tokenize`` for words of letters, many in one text: no word has the token of the sign between them."""
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        out: list[bytes] = []
        for group, raw in zip(groups, self._tokenize([f" {MARK} ".join(g) for g in groups])):
            ids = np.frombuffer(raw, "<u4")
            cuts = np.flatnonzero(ids == self.mark[0]) * 4
            if len(self.mark) == 1 and len(cuts) == len(group) - 1:
                out += [raw[i:j] for i, j in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)])]
            else:
                out += self._tokenize(group)
        return out

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of new chunks: of plain words with signs behind, those of the word in small letters and of the signs."""
        known, met, plain, rest = self.known, self.met, [], []
        for c in chunks:
            if m := _WORD.fullmatch(c):
                plain.append((c, m[1].lower(), m[2]))
            else:
                rest.append(c)
        words = list({w for _, w, _ in plain if w not in known})
        rest += {x for _, _, x in plain if x and x not in known}
        new = dict(zip(words, self._tokenize_words(words))) | dict(zip(rest, self._tokenize(rest)))
        ids = lambda x: new[x] if x in new else known[x]
        out = new | {c: ids(w) + ids(x) if x else ids(w) for c, w, x in plain}
        if len(known) < CACHE:  # frequent chunks come early
            for c, got in out.items():
                h = hash(c) % SEEN
                if not met[h] and len(known) >= CACHE // 2:
                    met[h] = 1
                elif len(c) < 64 and len(known) < CACHE:
                    known[c] = got
        return out


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """id, piece, start, length and ids_crc32 of every piece of every document; ids too, if asked for."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    rows = pick(df, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    end = np.array([END], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                owner, piece, start, length, crc, all_ids = [], [], [], [], [], []
                for j, raw in enumerate(encode(part.column(1).to_pylist())):
                    raw += end
                    for n, at in enumerate(range(0, len(raw), step)):
                        own = raw[at : at + step]
                        owner.append(j)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if ids:
                            all_ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                columns = [part.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The worker's own, which outlives a task."""
    return Encoder(path)


Pattern = tuple[list[tuple[int, int]], int]  # (size, how many) from the front of the bin; bins like this


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Fix the bins that dominate all others, and take their pieces out of counts."""
    fixed: list[Pattern] = []

    def smallest(n: int, without: int) -> list[int]:
        """The n smallest sizes, with repeats, one piece of size ``without`` aside."""
        out: list[int] = []
        for size in sorted(counts):
            out += [size] * min(n - len(out), counts[size] - (size == without))
            if len(out) == n:
                break
        return out

    sizes = sorted(counts, reverse=True)
    for s in sizes:
        while counts.get(s, 0):
            room = capacity - s
            low = smallest(3, s)
            if not low or low[0] > room:
                fixed.append(([(s, 1)], counts.pop(s)))
                break
            k = next(x for x in sizes if x <= room and counts.get(x, 0) > (x == s))
            if k != room and len(low) > 1 and low[0] + low[1] <= room:
                if len(low) > 2 and sum(low) <= room:
                    break
                if k < _best_pair(counts, s, room):
                    break
            n = counts[s] // 2 if k == s else min(counts[s], counts[k])
            fixed.append(([(s, 2)] if k == s else [(s, 1), (k, 1)], n))
            for x in (s, k):
                counts[x] -= n
                if not counts[x]:
                    del counts[x]
    return fixed


def _best_pair(counts: dict[int, int], without: int, room: int) -> int:
    """The largest sum of two pieces within the room, one piece of size ``without`` aside."""
    own = [x for x in sorted(counts) if x < room and counts[x] > (x == without)]
    best, i, j = 0, 0, len(own) - 1
    while i <= j:
        total = own[i] + own[j]
        if total > room:
            j -= 1
        elif i == j and counts[own[i]] - (own[i] == without) < 2:
            break
        else:
            best = max(best, total)
            i += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit with the longest pieces first; bins of equal content stay together."""
    open_bins: dict[int, list[Pattern]] = {}
    rooms = 0  # bit r is set if bins with r left are open

    def put(pattern: list[tuple[int, int]], n: int, room: int) -> None:
        nonlocal rooms
        if n:
            open_bins.setdefault(room, []).append((pattern, n))
            rooms |= 1 << room

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            fits = rooms >> s
            room = (fits & -fits).bit_length() - 1 + s if fits else capacity
            each = room // s
            if fits:
                group = open_bins[room]
                pattern, n = group.pop()
                if not group:
                    del open_bins[room]
                    rooms ^= 1 << room
            else:
                pattern, n = [], -(-left // each)
            full = min(n, left // each)
            put(pattern + [(s, each)], full, room - each * s)
            left -= full * each
            n -= full
            if n and left:  # fewer than a bin takes
                put(pattern + [(s, left)], 1, room - left * s)
                left, n = 0, n - 1
            put(pattern, n, room) if pattern else None
    return [x for group in open_bins.values() for x in group]


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold exactly the counted pieces."""
    counts = {s: n for s, n in counts.items() if n}
    if any(s < 1 or s > capacity for s in counts):
        raise ValueError("a piece doesn't fit")
    return reduce_dominated(counts, capacity) + best_fit(counts, capacity)


def allotments(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """size -> rows of (first rank, pieces in a bin, first sequence, offset in the bin), by first rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for size, each in pattern:
            rank = used.get(size, 0)
            out.setdefault(size, []).append((rank, each, sequence, offset))
            used[size] = rank + n * each
            offset += size * each
        sequence += n
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def place(parts: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """sequence_id and offset for pieces (id, piece, start, length, ids_crc32). parts is read twice: cut it before."""
    spark = parts.sparkSession
    salts = max(64, parts.count() // 100_000)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)))
    counted = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = {int(r["length"]): int(r["n"]) for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    where = spark.sparkContext.broadcast(allotments(pack_counts(counts, capacity)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy(id_col, "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own)).join(starts, ["length", "salt"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("rank") - 1 + F.col("first")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                rows = where.value[int(size)]
                own = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                q = rank[at] - own[:, 0]
                sequence[at] = own[:, 2] + q // own[:, 1]
                offset[at] = own[:, 3] + q % own[:, 1] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = parts.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return place(cut(pieces(df, id_col, text_col, tokenizer, capacity)), capacity, id_col)
