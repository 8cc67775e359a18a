"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is the majority vote of the hashes of a text's word shingles. To find
the fingerprints at up to three differing bits, every distinct fingerprint emits the
variants within half the radius, and equal variants meet in one bucket. As three is
odd, a fourth of the bits is set aside in turn: some fourth holds at least one of the
differing bits, so at most two are left in the other 48 bits, and the balls of radius
one around both fingerprints share a variant. That makes 4 x 49 variants, not the
2,081 of a ball of radius two. Variants travel as fingerprint and variant number,
9 bytes each, packed in one binary value a bucket.

Within a bucket, fingerprints that share a variant and the bits set aside differ in
two bits at most, those with one more differing bit in three: they are linked through
the smallest one, so a group of any size gives links in proportion to its size and
none is lost to the components. Fingerprints that differ in three of the bits set
aside share the 48 other bits and are looked up by those. Every link is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidevec.llm.common import cut, fewer, pick, small, stored
from tidevec.llm.components import components

SEED = 42
RADIUS = 3
ENTRIES = 200_000  # a bucket
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float32)  # byte -> its bits
_M48 = np.uint64((1 << 48) - 1)
_M16 = np.uint64(0xFFFF)
_FLIPS = np.array([0, *(1 << i for i in range(48))], np.uint64)


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 (seed 42) of each k-word shingle, repeats included; the whole sequence if it is shorter."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    return [digest(joined[i:j], SEED) for i, j in zip(starts, (ends[k - 1 :] - 1).tolist())]


def mixed(h: np.ndarray, n: int) -> np.ndarray:
    """n 64-bit words of each hash: itself first, the others by a multiply-shift mix."""
    out = np.empty((len(h), n), np.uint64)
    out[:, 0] = h
    for i in range(1, n):
        x = h + np.uint64((0x9E3779B97F4A7C15 * i) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, i] = x ^ (x >> np.uint64(31))
    return out


def fingerprints(texts: list[bytes | None], k: int, words: int = 1) -> np.ndarray:
    """A row of 64-bit words for each text: a bit is 1 if set in over half the hashes; zero without any word."""
    out = np.zeros((len(texts), words), np.uint64)
    for at in range(0, len(texts), 64):
        hashed = [shingle_hashes(t or b"", k) for t in texts[at : at + 64]]
        n = np.array([len(x) for x in hashed])
        flat = np.array([y for x in hashed for y in x], np.uint64)
        if not len(flat):
            continue
        owner = np.repeat(np.arange(len(n)) * 256, n)
        as_bytes = mixed(flat, words).view(np.uint8).reshape(len(flat), words * 8)
        sums = [np.bincount(owner + as_bytes[:, j], minlength=256 * len(n)).reshape(len(n), 256).astype(np.float32) @ _BITS for j in range(words * 8)]
        bits = np.concatenate(sums, 1) * 2 > n[:, None]
        out[at : at + 64] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return out


def with_fingerprint(df: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the 64 bits as a long) of every row; a null text counts as empty."""
    rows = pick(df, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                fp = fingerprints(part.column(1).cast(pa.binary()).to_pylist(), k)[:, 0]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def _turn(fp: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 48 bits left and the 16 bits set aside."""
    by = block.astype(np.uint64) * np.uint64(16)
    turned = (fp >> by) | np.where(by == 0, np.uint64(0), fp << ((np.uint64(64) - by) % np.uint64(64)))
    return turned >> np.uint64(16), turned & _M16


def _keys(fp: np.ndarray, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each (fingerprint, variant number 0..195): the variant with its block, and the bits set aside."""
    block = variant // 49
    rest, aside = _turn(fp, block)
    return (rest ^ _FLIPS[variant % 49]) | (block.astype(np.uint64) << np.uint64(48)), aside


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def linked(fp: np.ndarray, variant: np.ndarray) -> np.ndarray:
    """Verified links (rows of two fingerprints) among the entries of a bucket."""
    key, aside = _keys(fp, variant)
    order = np.lexsort((fp, aside, key))
    key, aside, fp, centre = key[order], aside[order], fp[order], variant[order] % 49 == 0
    start = np.r_[True, key[1:] != key[:-1]]
    run = np.cumsum(start) - 1
    many = np.bincount(run)[run] > 1
    key, aside, fp, centre, run = key[many], aside[many], fp[many], centre[many], run[many]
    if not len(fp):
        return np.zeros((0, 2), np.uint64)
    found = []
    # same variant, same bits aside: through the smallest
    place = run.astype(np.uint64) << np.uint64(16) | aside
    first = np.r_[True, place[1:] != place[:-1]]
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    found.append(np.stack([fp[head], fp], 1)[~first])
    # same variant, one differing bit aside: the smallest of both
    at, rep = place[first], fp[first]
    found += _lookups(at, rep, at, rep, [1 << i for i in range(16)])
    # the 48 bits equal, three differing bits aside
    alone = np.flatnonzero(centre)
    place = place[alone]
    pairs = np.bincount(run[alone])[run[alone]] > 1
    alone, place = alone[pairs], place[pairs]
    if len(alone):
        found += _lookups(place, fp[alone], place, fp[alone], [sum(1 << i for i in c) for c in combinations(range(16), 3)])
    links = np.concatenate(found)
    distance = np.bitwise_count(links[:, 0] ^ links[:, 1])
    links = links[(distance <= RADIUS) & (distance > 0)]
    return np.unique(np.sort(links, axis=1), axis=0)


def _lookups(at: np.ndarray, own: np.ndarray, among: np.ndarray, values: np.ndarray, flips: list[int]) -> list[np.ndarray]:
    """(own, value) wherever a place with these bits flipped is among the sorted places."""
    out = []
    for flip in flips:
        want = at ^ np.uint64(flip)
        i = np.minimum(np.searchsorted(among, want), len(among) - 1)
        hit = (among[i] == want) & (want > at)
        if hit.any():
            out.append(np.stack([own[hit], values[i[hit]]], 1))
    return out


def ball_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column fp, at 1 to 3 differing bits, enough
    to join whatever can be reached. distinct is read twice: cut it before."""
    spark = distinct.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() * 196 // ENTRIES))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variant = np.arange(196, dtype=np.uint8)
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(whole), 4096):
                part = whole[i : i + 4096]
                fp, v = np.repeat(part, 196), np.tile(variant, len(part))
                key, _ = _keys(fp, v)
                to = (_mix(key) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                to, fp, v = to[order], fp[order], v[order]
                cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                ends = np.r_[cuts[1:], len(to)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[cuts]), pa.array([fp[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()), pa.array([v[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())],
                    ["bucket", "fps", "variants"],
                )

    def meet(table: pa.Table) -> pa.Table:
        fp = np.frombuffer(b"".join(table.column("fps").to_pylist()), np.uint64)
        v = np.frombuffer(b"".join(table.column("variants").to_pylist()), np.uint8)
        links = linked(fp, v).view(np.int64)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    packed = distinct.select("fp").mapInArrow(emit, "bucket bigint, fps binary, variants binary")
    return packed.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint")


def near_duplicates(df: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of every row.

    Rows are linked if their fingerprints differ in up to three bits; component_id is the smallest id
    reachable, the row's own included. Null and empty texts have fingerprint zero and link like any other.
    Rows with equal ids or texts are all returned; a null id is never a component's id unless all are null.
    An empty table gives an empty result.
    """
    own = cut(with_fingerprint(df, k, id_col, text_col))
    distinct = cut(own.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(ball_links(distinct))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(of_root, "root").select("fp", "component_id")
    out = own.join(labels, "fp")
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near-duplicates by similarity, for filtering a corpus.

#: Members of a key that meet in pairs at once. Those of more are compared with a few members first, and what is
#: not linked by then with all the others.
ALL_PAIRS = 8
LEADERS, ROUNDS = 4, 1
BLOCK = 2048  # members of a key compared with as many others in one task
COMMON = 500_000  # shingles whose frequency is known when shingles are ordered, the most frequent ones
SKETCH = 16  # 64-bit words
_EPS = 1e-9
_ENTRY = np.dtype([("node", "<i8"), ("key", "<i8"), ("n", "<i4"), ("at", "<i4")])


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text or b"", k), np.uint64))


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's hashes falls on each bit. Two sketches differ in no more bits than the
    sets have members that are not shared."""
    odd = np.bincount((hashes % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def majority(hashes: np.ndarray) -> np.int64:
    """The fingerprint of a set: a bit is 1 if set in over half the hashes."""
    if not len(hashes):
        return np.int64(0)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0]


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes of a set, rare ones before common ones: of two sets at the similarity or over, the
    prefixes share a hash, whatever the order is, as long as it is one for all sets."""
    size = len(hashes) - int(np.ceil(similarity * len(hashes) - _EPS)) + 1
    rank = np.zeros(len(hashes), np.int64)
    if len(common):
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        i = np.minimum(np.searchsorted(common, short), len(common) - 1)
        rank = np.where(common[i] == short, counts[i], 0)
    return hashes[np.lexsort((hashes, rank))][: max(0, min(size, len(hashes)))]


def _may(n_i: np.ndarray, at_i: np.ndarray, n_j: np.ndarray, at_j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes that share a hash at these places of their order can be similar."""
    shared = np.minimum(at_i, at_j) + np.minimum(n_i - at_i, n_j - at_j)
    return (np.minimum(n_i, n_j) >= similarity * np.maximum(n_i, n_j) - _EPS) & (shared >= similarity / (1 + similarity) * (n_i + n_j) - _EPS)


def _group_pairs(entries: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of the nodes of equal keys with few members, and the entries of those with many."""
    entries = entries[np.lexsort((entries["node"], entries["key"]))]
    node, key = entries["node"], entries["key"]
    entries = entries[np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])][: len(key)]]
    node, key, n, at = (entries[x] for x in ("node", "key", "n", "at"))
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    size = np.diff(np.r_[start, len(key)])
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    for m in range(2, ALL_PAIRS + 1):
        own = start[size == m]
        for i, j in combinations(range(m), 2):
            left.append(own + i)
            right.append(own + j)
    i, j = np.concatenate(left), np.concatenate(right)
    ok = _may(n[i], at[i], n[j], at[j], similarity)
    return np.unique(np.stack([node[i[ok]], node[j[ok]]], 1), axis=0), entries[np.repeat(size, size) > ALL_PAIRS]


def _sets_of(batch: pa.RecordBatch, at: int, k: int, rows: int) -> Iterator[list[np.ndarray]]:
    """The sets of the texts in a column, for so many rows at a time."""
    for i in range(0, batch.num_rows, rows):
        yield [shingle_set(x, k) for x in batch.column(at).slice(i, rows).cast(pa.binary()).to_pylist()]


def _node(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def _common(texts: DataFrame, k: int, shingles: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper halves of hashes that many sets have, sorted, and how many do. Left-out ones count as rare,
    which makes keys of more members and loses nothing."""
    spark = texts.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // 2_000_000))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted hashes as steps, low and high halves and counts apart, which compress well."""
        for batch in batches:
            for sets in _sets_of(batch, 0, k, 4096):
                flat = np.concatenate(sets)
                h, n = np.unique((flat >> np.uint64(32)).astype(np.uint32), return_counts=True)
                cuts = np.searchsorted(h, (np.arange(buckets + 1) * 2**32 // buckets).astype(np.uint64))
                own = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
                packed = []
                for b in own:
                    part = slice(cuts[b], cuts[b + 1])
                    step = np.diff(h[part], prepend=np.uint32(0))
                    packed.append(np.stack([step & 0xFFFF, step >> 16, n[part]]).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(packed, pa.binary())], ["bucket", "packed"])

    def add(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u2").reshape(3, -1) for x in table.column("packed").to_pylist()]
        hashes = np.concatenate([np.cumsum(x[0].astype(np.uint32) | (x[1].astype(np.uint32) << 16), dtype=np.uint32) for x in parts])
        h, of = np.unique(hashes, return_inverse=True)
        n = np.bincount(of, np.concatenate([x[2] for x in parts])).astype(np.int64)
        return pa.table({"h": h[n > ALL_PAIRS].astype(np.int64), "n": n[n > ALL_PAIRS]})

    counted = texts.mapInArrow(emit, "bucket bigint, packed binary").groupBy("bucket").applyInArrow(add, "h bigint, n bigint")
    held = counted.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = held.column("h").to_numpy().astype(np.uint32), held.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


class _Sets:
    """Texts as sets of shingle hashes. A node is a set; texts of equal sets (by a 64-bit hash) are one node."""

    def __init__(self, df: DataFrame, k: int, similarity: float, id_col: str, text_col: str):
        self.k, self.similarity = k, similarity
        self.rows = pick(df, id=id_col, text=text_col).withColumn("t", F.xxhash64("text"))
        self.kind = self.rows.schema["id"].dataType.simpleString()
        # sets are larger than the texts, and made again where they are read
        own = self._of(self.rows, "id", "t", "node", "n", "fp", *[f"s{i}" for i in range(SKETCH)])
        self.own = stored(own)
        first = F.min(F.struct("id", "t")).alias("first")
        # equal sets have equal sketches
        columns = ["n", "fp", *[f"s{i}" for i in range(SKETCH)]]
        self.nodes = stored(self.own.groupBy("node").agg(first, *[F.min(c).alias(c) for c in columns]))

    def _of(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Columns of the sets of rows (id, t, text, and others)."""
        k, names = self.k, list(rows.columns)
        kinds = {"node": "bigint", "n": "int", "fp": "bigint", "set": "binary"} | {f"s{i}": "bigint" for i in range(SKETCH)}
        schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString() if c in names else kinds[c]}" for c in columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, sets in enumerate(_sets_of(batch, names.index("text"), k, 512)):
                    part = batch.slice(512 * i, 512)
                    made = {"set": lambda: pa.array([x.tobytes() for x in sets], pa.binary()), "n": lambda: pa.array(map(len, sets), pa.int32())}
                    made["node"] = lambda: pa.array(np.array([_node(x) for x in sets], np.uint64).view(np.int64))
                    made["fp"] = lambda: pa.array(np.array([majority(x) for x in sets], np.int64))
                    if "s0" in columns:
                        sketch = np.stack([parity_sketch(x) for x in sets])
                        made |= {f"s{j}": lambda j=j: pa.array(sketch[:, j]) for j in range(SKETCH)}
                    yield pa.RecordBatch.from_arrays([part.column(names.index(c)) if c in names else made[c]() for c in columns], list(columns))

        return rows.mapInArrow(run, schema)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b: nodes) whose sets are similar. Sizes and parity sketches leave few to compare, and only their
        sets are made."""
        s = self.similarity
        words = [f"s{i}" for i in range(SKETCH)]
        side = lambda c: self.nodes.select(F.col("node").alias(c), F.struct("n", *words).alias(f"_{c}"))
        apart = sum((F.bit_count(F.col(f"_a.{w}").bitwiseXOR(F.col(f"_b.{w}"))) for w in words), F.lit(0))
        total = F.col("_a.n") + F.col("_b.n")
        may = (F.least("_a.n", "_b.n") >= s * F.greatest("_a.n", "_b.n") - _EPS) & (apart <= (1 - s) / (1 + s) * total + _EPS)
        pairs = cut(pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(may).select("a", "b"))
        pairs = fewer(pairs, pairs.count())
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        holders = small(cut(self.nodes.join(wanted, "node", "left_semi").select("node", F.col("first.id").alias("_id"), F.col("first.t").alias("_t"))))
        held = self.rows.join(holders, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))).select("node", "text")
        sets = self._of(held.withColumnRenamed("node", "of"), "of", "set").dropDuplicates(["of"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(c).to_pylist()] for c in (2, 3))
                both = np.array([len(np.intersect1d(v, w, assume_unique=True)) for v, w in zip(x, y)], np.int64)
                size = np.array([len(v) + len(w) for v, w in zip(x, y)], np.int64)
                ok = pa.array(both >= s * (size - both) - _EPS)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

        left, right = sets.select(F.col("of").alias("a"), F.col("set").alias("x")), sets.select(F.col("of").alias("b"), F.col("set").alias("y"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def _ball_roots(sets: _Sets) -> DataFrame:
    """(node, root) of what connects by fingerprints within three bits, as far as the sets are similar: every node
    is compared with one node of its component, and what is not similar to that is left to the search by prefixes."""
    fps = cut(sets.nodes.groupBy("fp").agg(F.min("node").alias("least")))
    named = fps.join(components(ball_links(fps)), fps["fp"] == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    centre = named.join(fps.select(F.col("fp").alias("root"), F.col("least").alias("b")), "root").select("fp", "b")
    stars = sets.nodes.select("fp", F.col("node").alias("a")).join(centre, "fp").where("a <> b").select("a", "b")
    return components(sets.verified(stars))


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that roots don't connect yet."""
    of_a, of_b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in "ab")
    return pairs.join(of_a, "a", "left").join(of_b, "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots after these links; a root's links to its members stand for the links so far."""
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def similar_groups(df: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, t (hash of the text) and first (id and t of the group's first member) of every row.

    Groups are what connects texts whose sets of k-word shingles have a Jaccard similarity of at least
    ``similarity``. Ball hashing finds the fingerprints within three bits first. Texts of that similarity can
    differ in many more bits, so what it leaves apart is searched exactly on the 64-bit hashes of the shingles: similar
    sets share a hash in their prefixes, every candidate is verified on the whole sets, and a pair that is not compared
    is connected already. Texts without words are equal to each other; null texts have none. Null ids come first; rows that repeat an
    id and its text are one document. An empty table gives an empty result.

    Members of a key that many nodes share are compared with a few leaders in each of some rounds, then with
    all members of other groups, in blocks; what is verified there is filtered by sizes, places and parity
    sketches, which loses nothing.
    """
    spark = df.sparkSession
    sets = _Sets(df, k, similarity, id_col, text_col)
    roots = _ball_roots(sets)
    shingles = sets.own.agg(F.sum("n")).first()[0] or 0
    shared = spark.sparkContext.broadcast(_common(sets.rows.select("text"), k, shingles))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(shingles * (1 - similarity)) // ENTRIES)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for batch in batches:
            for own in _sets_of(batch, 0, k, 2048):
                node = np.array([_node(x) for x in own], np.uint64).view(np.int64)
                keys = [prefix(x, common, counts, similarity) for x in own]
                sizes = np.array([len(x) for x in keys], np.int64)
                out = np.empty(sizes.sum(), _ENTRY)
                if not len(out):
                    continue
                out["node"], out["key"] = np.repeat(node, sizes), np.concatenate(keys).view(np.int64)
                out["n"] = np.repeat([len(x) for x in own], sizes)
                out["at"] = np.concatenate([np.arange(m) for m in sizes])
                to = (_mix(out["key"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                to, out = to[order], out[order]
                cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                ends = np.r_[cuts[1:], len(to)]
                yield pa.RecordBatch.from_arrays([pa.array(to[cuts]), pa.array([out[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())], ["bucket", "packed"])

    def meet(table: pa.Table) -> pa.Table:
        pairs, many = _group_pairs(np.frombuffer(b"".join(table.column("packed").to_pylist()), _ENTRY), similarity)
        none = pa.nulls(len(pairs), pa.int64())
        found = pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "key": none, "n": none, "at": none})
        left = pa.table({"a": many["node"], "b": pa.nulls(len(many), pa.int64()), "key": many["key"], "n": many["n"].astype(np.int64), "at": many["at"].astype(np.int64)})
        return pa.concat_tables([found, left])

    packed = sets.rows.select("text").mapInArrow(emit, "bucket bigint, packed binary")
    met = stored(packed.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint, key bigint, n bigint, at bigint"))
    roots = _merged(roots, sets.verified(_rooted(met.where("b is not null").select("a", "b"), roots)))
    many = met.where("b is null").select(F.col("a").alias("node"), "key", "n", "at")
    if not many.isEmpty():
        roots = _connect_many(many, sets, roots)
    named = sets.nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    firsts = named.groupBy("root").agg(F.min("first").alias("first"))
    labels = named.select("node", "root").join(firsts, "root").select("node", "first")
    return sets.own.select("id", "t", "node").join(labels, "node").select(F.col("id").alias(id_col), "t", "first")


def _connect_many(many: DataFrame, sets: _Sets, roots: DataFrame) -> DataFrame:
    """roots, and what further links among the members of keys with many members make of them."""
    similarity = sets.similarity
    sketches = [f"s{i}" for i in range(SKETCH)]
    many = stored(many.join(sets.nodes.select("node", *sketches), "node"))
    n_min, n_max = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    total = F.col("x.n") + F.col("y.n")
    apart = sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in sketches), F.lit(0))
    may = (F.col("x.root") != F.col("y.root")) & (n_min >= similarity * n_max - _EPS)
    may &= F.least("x.at", "y.at") + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= similarity / (1 + similarity) * total - _EPS
    may &= apart <= (1 - similarity) / (1 + similarity) * total + _EPS
    ends = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]

    def unsettled() -> DataFrame:
        """Members of keys that still have several roots."""
        named = many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        keys = named.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("_m")).where("_lo <> _hi")
        return stored(named.join(keys, "key").withColumn("blocks", F.ceil(F.col("_m") / BLOCK).cast("int")).drop("_lo", "_hi", "_m"))

    for r in range(ROUNDS):
        left = unsettled()
        if left.isEmpty():
            return roots
        # the same leaders for all keys of a family, so that pairs of several keys are one
        leader = [F.min(F.struct(F.xxhash64("node", F.lit(r * LEADERS + i)).alias("o"), "node", "n", "at", "root", *sketches)) for i in range(LEADERS)]
        leaders = left.groupBy("key").agg(F.array(*leader).alias("l")).select("key", F.explode("l").alias("l")).select("key", "l.node", "l.n", "l.at", "l.root", *[f"l.{s}" for s in sketches])
        roots = _merged(roots, sets.verified(left.alias("x").join(leaders.alias("y"), (F.col("x.key") == F.col("y.key")) & may).select(*ends)))
    left = unsettled()
    if left.isEmpty():
        return roots
    x = left.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    y = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    where = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.root") < F.col("y.root"))
    return _merged(roots, sets.verified(x.alias("x").join(y.alias("y"), where & may).select(*ends)))


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are first in their group of near-duplicates, with all their columns. Rows that
    repeat an id and its text are one document and stay or go together."""
    gone = similar_groups(docs, k, similarity, id_col, text_col).where(~F.struct(id_col, "t").eqNullSafe(F.col("first")))
    gone = small(cut(gone.select(F.col(id_col).alias("_id"), F.col("t").alias("_t")).distinct()))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_t"]), "left_anti")
