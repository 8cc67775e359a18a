import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidevec.llm import decontaminate, html_text, langid, licenses, lines, packing, simhash, suffixes, toxicity

D = "doc_id long, text string"
EDGES = [(9001, None), (9002, ""), (None, "a text without an id, long enough to be a line of its own"), (9003, "é" * 500), (9004, "\n\n  \t\n")]


def docs(spark, rows, parts=3):
    """Documents with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, D).repartition(parts)
    return df.withColumns({c: F.lit(1) for c in ("id", "key", "fp", "node", "h", "line", "owner", "bucket", "w", "rank")})


def prose(rng, n, words=None):
    words = words or ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "the", "of", "and"]
    return " ".join(rng.choice(words) + (str(rng.randrange(40)) if rng.random() < 0.6 else "") for _ in range(n))


# licences


def test_license_base_places(spark):
    rows = EDGES + [
        (1, "MIT license MIT license. cc-by! CC BY\tNC 4.0 the mit. license"), (2, "mit license " * 500),
        (3, "GNU General Public License, version 3 or later; gnu general public license"), (4, "Apache License, Version 2.0. http://www.apache.org/licenses/LICENSE-2.0"),
        (5, "é MIT Licensé mit license"), (6, "permit license cc bye"), (1, "MIT license"),
    ]
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = licenses.scan(docs(spark, rows)).collect()

    def brute(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))

    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(((i, *brute(t)) for i, t in rows), key=key)
    labels = {r.doc_id: r.labels for r in got if r.doc_id != 1}
    assert labels[3] == "gpl,gpl-3.0-or-later" and labels[4] == "apache,apache-2.0" and labels[6] == ""
    assert all(0 <= r.score <= 1 for r in got)


def test_license_suppression(spark):
    from tidevec.llm.license_rules import GATES, rules

    assert len(rules()) > 200
    for _, _, _, keyword, regex in rules():
        re.compile(regex)
        assert any(g in keyword for g in GATES) or keyword == "classpath"
    text = "licensed under the gnu lesser general public license version 2.1 and SPDX-License-Identifier: MIT"
    found = licenses.scan(docs(spark, [(1, text)])).first().detections

    def brute(words):
        hits = []
        for o, p, label, k, x in rules():
            if k in words:
                hits += [(m.start(), m.end(), p, o, label) for m in re.finditer(x, words)]
        inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and a is not b and (b[2] > a[2] or b[2] == a[2] and (b[1] - b[0] > a[1] - a[0] or (a[:2] == b[:2] and b[3] < a[3])))
        return sorted(h[3] for h in hits if not any(inside(h, g) for g in hits))

    words = " " + " ".join(re.findall(r"[a-z0-9]+", text.lower())) + " "
    assert sorted(d.rule for d in found) == brute(words)


def test_license_scan_of_long_texts(spark):
    """Twice the detections take about twice the time, and all are found."""
    import time

    took = []
    for n in (1, 4000, 16000):
        began = time.perf_counter()
        r = licenses.scan(docs(spark, [(1, "mit license and " * n)])).first()
        took.append(time.perf_counter() - began)
        assert r.n_base == n and len(r.detections) == n and r.n_words == 3 * n
        assert [d.first_word for d in r.detections] == list(range(0, 3 * n, 3))
    assert took[2] - took[0] < 8 * max(1.0, took[1] - took[0])


# packing


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_ids_are_the_tokenizers(encoder):
    rng = random.Random(1)
    texts = ["a\x1cb c", "a\x85b", "é é x  ΑΣ ΑΣ", "don't'sx <|endoftext|>y", "a​b c", "ǅ²½ 12 　 x", "퟿﻿ x", "Word, (word): WORD... w.w 's", "1.5,", "&&&", "A.B!", "İSTANBUL!!"]
    alphabet = "abzAZ019 .,;:!?&#%*$()'éßΣ\t\ń漢"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(500)]
    marks = [chr(c) for r in ((0x130, 0x132), (0x300, 0x304), (0x915, 0x920), (0x93C, 0x93D), (0x958, 0x960), (0x5D0, 0x5D4), (0xFB1D, 0xFB4F)) for c in range(*r)]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 4))) + rng.choice(".,;:!?&#%*$()'\"-") + rng.choice(["", " x", "a"]) for _ in range(3000)]
    for i in range(0, len(texts), 100):
        for t, ids in zip(texts[i : i + 100], encoder.encode(texts[i : i + 100])):
            assert ids == np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    assert encoder.encode([None, ""]) == [b"", b""]


def test_ids_of_another_tokenizer():
    import public_tokenizers

    other = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["A b, C.", None, "two  spaces, GELDİ.", ""]
    assert not other.chunked
    assert other.encode(texts) == [np.array(other.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_packing_counts(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 100])
    counts = {s: rng.randrange(1, 200) for s in rng.sample(range(1, capacity + 1), rng.randrange(1, 10))}
    patterns = packing.pack_counts(dict(counts), capacity)
    used = {}
    for pattern, n in patterns:
        assert 0 < sum(s * k for s, k in pattern) <= capacity and n > 0
        for s, k in pattern:
            used[s] = used.get(s, 0) + k * n
    assert used == counts
    plain = []  # best fit, longest first, piece by piece
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        i = min((i for i, room in enumerate(plain) if room >= s), key=lambda i: plain[i], default=None)
        if i is None:
            plain.append(capacity - s)
        else:
            plain[i] -= s
    assert sum(n for _, n in patterns) <= len(plain)


def test_reduction_is_optimal_on_small_instances():
    def fewest(items, capacity):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] >= items[i] and bins[j] not in bins[:j]:
                    bins[j] -= items[i]
                    go(i + 1, bins)
                    bins[j] += items[i]
            bins.append(capacity - items[i])
            go(i + 1, bins)
            bins.pop()

        go(0, [])
        return best[0]

    rng = random.Random(4)
    for _ in range(150):
        items = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))), reverse=True)
        counts = {}
        for s in items:
            counts[s] = counts.get(s, 0) + 1
        left = dict(counts)
        fixed = sum(n for _, n in packing.reduce_dominated(left, 20))
        rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
        assert fixed + fewest(rest, 20) == fewest(items, 20), items


def test_pack(spark, encoder):
    rng = random.Random(2)
    rows = EDGES + [(i, prose(rng, rng.choice([3, 30, 300, 5000]))) for i in range(60)] + [(5, "same id")]
    got = packing.pack(docs(spark, rows)).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        if i == 5:
            continue
        ids = encoder.encode([t])[0] + b"\1\0\0\0"
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in mine] == [(a // 4, len(ids[a : a + 16384]) // 4, zlib.crc32(ids[a : a + 16384])) for a in range(0, len(ids), 16384)]
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r.length for r in got) // 4096) + 2
    assert packing.pack(docs(spark, rows).where("false")).count() == 0


# SimHash


def brute_fingerprint(text, k=3):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark):
    rng = random.Random(3)
    base = [prose(rng, 400) for _ in range(8)]
    rows = EDGES[:2] + EDGES[3:] + [(5, "A\x0bB\x1cC d É"), (6, "one two"), (3, base[0])]
    for i in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w)))
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    rows.sort()
    fp = [brute_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3]
    root = roots(len(fp), links)
    assert got == {(i, f"{f:016x}"): rows[r][0] for (i, _), f, r in zip(rows, fp, root)}
    assert simhash.near_duplicates(docs(spark, rows).where("false")).count() == 0


def test_ball_links_lose_nothing():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 120, dtype=np.uint64)
    all_fp = [base]
    for d in (1, 2, 3, 4, 5):
        x = base.copy()
        for i in range(len(x)):
            for b in rng.choice(64 if i % 3 else 16, d, replace=False):
                x[i] ^= np.uint64(1) << np.uint64(b)
        all_fp.append(x)
    fp = np.unique(np.concatenate(all_fp))
    distance = np.bitwise_count(fp[:, None] ^ fp)
    want = roots(len(fp), np.argwhere(np.triu((distance <= 3) & (distance > 0))).tolist())
    entries, variant = np.repeat(fp, 196), np.tile(np.arange(196, dtype=np.uint8), len(fp))
    to = simhash._mix(simhash._keys(entries, variant)[0]) % np.uint64(5)
    number = {int(x): i for i, x in enumerate(fp)}
    links = [(number[int(a)], number[int(b)]) for k in range(5) for a, b in simhash.linked(entries[to == k], variant[to == k])]
    assert roots(len(fp), links) == want


def test_similar_documents_keep_one(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        w = prose(rng, 300).split()
        rows.append((g * 10, " ".join(w)))
        for c in range(1, 4):
            x = list(w)
            for _ in range(c):  # up to 3 of 300 words: a similarity of about 0.9 and more
                x[rng.randrange(len(x))] = "changed"
            rows.append((g * 10 + c, " ".join(x)))
    rows += [(1000 + i, prose(rng, 200)) for i in range(20)] + [(2000, None), (2001, ""), (2002, "")]
    kept = {r.doc_id for r in simhash.keep_one(docs(spark, rows)).collect()}
    assert kept - {2000, 2001, 2002} == {g * 10 for g in range(12)} | set(range(1000, 1020))
    assert len(kept & {2000, 2001, 2002}) == 1
    assert simhash.keep_one(docs(spark, rows)).columns == docs(spark, rows).columns


def near_pairs(rng, changes, base=240):
    """Pairs of texts of different words, the second with that many words changed far enough apart: 5 shingles each."""
    for i, c in enumerate(changes):
        w = [f"w{i}x{j}y{rng.randrange(10**6)}" for j in range(base)]
        x = list(w)
        for j in range(c):
            x[4 + 6 * j] = f"n{i}x{j}"
        yield (2 * i, " ".join(w)), (2 * i + 1, " ".join(x))


def jaccard(a, b, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_documents_equal_brute_force_around_the_threshold(spark):
    # 5 changes of 236 shingles: 0.81; 6: 0.77; 4: 0.84
    pairs = list(near_pairs(random.Random(8), [4, 5, 5, 5, 6, 6, 7, 8] * 30))
    rows = [r for p in pairs for r in p]
    want = {a[0] for a, _ in pairs} | {b[0] for a, b in pairs if jaccard(a[1], b[1]) < 0.8}
    shares = [jaccard(a[1], b[1]) for a, b in pairs]
    assert sum(0.8 <= s < 0.85 for s in shares) > 50 and sum(0.7 <= s < 0.8 for s in shares) > 50
    assert {r.doc_id for r in simhash.keep_one(docs(spark, rows)).collect()} == want


def test_candidate_search_loses_no_similar_pair():
    rng = np.random.default_rng(3)
    entries, want = [], []
    for i in range(300):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        y = np.unique(np.r_[x[rng.permutation(len(x))[: max(1, round(len(x) * rng.uniform(0.85, 1)))]], rng.integers(0, 2**64, int(n * rng.uniform(0, 0.1)), dtype=np.uint64)])
        both = len(np.intersect1d(x, y))
        if both >= 0.8 * (len(x) + len(y) - both):
            want.append((2 * i, 2 * i + 1))
        entries += [(2 * i, x), (2 * i + 1, y)]
    common = np.sort(rng.permutation(np.concatenate([x for _, x in entries]))[:9000] >> np.uint64(32)).astype(np.uint32)
    counts = rng.integers(9, 99, len(common))
    packed = []
    for node, x in entries:
        keys = simhash.prefix(x, common, counts, 0.8)
        packed += [(node, key, len(x), at) for at, key in enumerate(keys.view(np.int64).tolist())]
    pairs, many = simhash._group_pairs(np.array(packed, simhash._ENTRY), 0.8)
    assert set(want) <= set(map(tuple, pairs[:, :2].tolist())) and len(want) > 100 and not len(many)


def test_similar_documents_at_common_shingles(spark, monkeypatch):
    """Documents of one template whose shingles all are common; the true partner is any of the others."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(9)
    shell = [f"t{j}" for j in range(150)]
    rows = []
    for i in range(60):
        x = list(shell)
        own = rng.sample(range(0, 150), 8)
        for j in own:
            x[j] = f"u{i}x{j}"
        y = list(x)
        y[own[0]] = f"v{i}"
        rows += [(2 * i, " ".join(x)), (2 * i + 1, " ".join(y))]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = {i for i in range(len(rows)) if find(i) == i}
    assert 30 < len(want) < 100
    assert {r.doc_id for r in simhash.keep_one(docs(spark, rows)).collect()} == want


# lines


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a == b or a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


@pytest.mark.parametrize("few", [8, 2])
def test_line_dedup(spark, monkeypatch, few):
    monkeypatch.setattr(lines, "FEW", few)
    rng = random.Random(6)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(18, 60))).strip() + "x" for _ in range(15)]
    rows = list(EDGES)
    for d in range(80):
        own = []
        for _ in range(rng.randint(0, 5)):
            x = list(rng.choice(base[:3] if d % 2 else base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                p, o = rng.randrange(len(x)), rng.random()
                if o < 0.3:
                    x[p] = rng.choice("abcde")
                elif o < 0.6:
                    x.insert(p, rng.choice("abcdé"))
                else:
                    x.pop(p)
            line = "".join(x).strip()
            own.append(line.upper() if rng.random() < 0.1 else line)
        rows.append((d, "\n".join(own)))
    rows += [(1000 + i, f"{base[0]}  row\t{i:04d} end of row") for i in range(40)]
    rows.append(rows[10])
    norm = lambda x: re.sub("[ \t\r\f\x0b]+", " ", x.lower()).strip(" ")
    places, first = [], {}
    for i, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate(t.split("\n")):
            if len(norm(line)) >= 20:
                first.setdefault(norm(line), len(places))
                places.append((i, n, norm(line)))
    gone = {(i, n) for p, (i, n, k) in enumerate(places) if first[k] < p or any(first[y] < first[k] and one_edit(y, k) for y in first)}
    want = sorted(((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)) for i, t in rows), key=str)
    got = lines.dedup(docs(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want
    assert set(got.columns) == set(docs(spark, rows).columns) | {"n_lines", "n_removed"}


def test_banded_distance(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(7)
    for k in (1, 2, 3):
        pairs = []
        while len(pairs) < 300:
            a = "".join(rng.choice("ab") for _ in range(rng.randint(k + 2, 14)))
            b = list(a)
            for _ in range(rng.randint(0, k + 1)):
                p = rng.randrange(len(b))
                b[p : p + rng.randrange(2)] = rng.choice(["", "a", "b", "bb"])
                b = b or ["a"]
            a, b = sorted([a, "".join(b)], key=len, reverse=True)
            if len(a) - len(b) <= k < len(b):
                pairs.append((a, b))
        got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.distance(F.col("a"), F.col("b"), k).alias("d")).collect()
        for r in got:
            assert (r.d if r.d <= k else None) == (distance(r.a, r.b) if distance(r.a, r.b) <= k else None), r


# suffixes


def test_suffix_dedup(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    base = [prose(rng, 120, words) for _ in range(5)]
    rows = EDGES + [(0, base[0]), (1002, base[0] * 2), (2000, "x" * 700), (7, base[1]), (7, base[1])]
    for d in range(70):
        r = rng.random()
        if r < 0.3:
            t = prose(rng, rng.randint(0, 120), words)
        elif r < 0.7:
            w = rng.choice(base).split()
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        else:
            b = rng.choice(base)
            i = rng.randrange(len(b) // 2)
            t = prose(rng, 20, words) + b[i : i + rng.randint(80, 300)] + "é" + "ab" * rng.randint(0, 80)
        rows.append((d * 3 + 11, t))
    want, seen = {}, set()
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p] += 1
                gone[p + 100] -= 1
            seen.add(b[p : p + 100])
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert sum(x[1] for x in want.values()) > 10_000
    for section in (1_000_000, 700):
        monkeypatch.setattr(suffixes, "SECTION", section)
        got = suffixes.dedup(docs(spark, rows)).collect()
        assert len(got) == len(rows) and {r.doc_id: tuple(r)[1:] for r in got} == want
    assert suffixes.dedup(docs(spark, rows).where("false")).count() == 0


def test_suffix_dedup_of_one_id_with_unlike_texts(spark):
    rng = random.Random(13)
    long, short = prose(rng, 90), prose(rng, 40)
    rows = [(2, long), (2, short), (2, short), (3, long), (1, short + " x" + long)]
    got = suffixes.dedup(docs(spark, rows)).collect()
    assert len(got) == 5 and all(r.n_removed <= r.n_bytes for r in got)
    # all of it stands in the first document
    assert all(r.n_removed == r.n_bytes for r in got if r.doc_id != 1) and [r.n_removed for r in got if r.doc_id == 1] == [0]
    with pytest.raises(TypeError):
        suffixes.dedup(docs(spark, rows).select(F.col("doc_id").cast("string").alias("doc_id"), "text"))


def test_suffix_dedup_around_a_common_phrase(spark, monkeypatch):
    """A phrase in all documents, with unlike surroundings: its seeds are known as common, and chosen nowhere else."""
    rng = random.Random(14)
    phrase = "the same forty-odd bytes stand in every text "
    rows = [(i, prose(rng, 12) + " " + phrase + prose(rng, 12)) for i in range(80)] + [(100 + i, "=" * rng.randrange(100, 400)) for i in range(20)]
    rows.append((200, rows[3][1]))
    own = docs(spark, rows).select(F.col("doc_id").alias("doc"), F.hash("text").alias("t"), "text")
    common = suffixes._common_seeds(own.coalesce(1))
    assert len(common)
    x = suffixes.stretches([(i, 0, 0, t.encode(), max(0, len(t.encode()) - 99)) for i, t in rows[:80]], common)
    assert np.unique(x["g"], return_counts=True)[1].max() <= 2
    got = {r.doc_id: r.n_removed for r in suffixes.dedup(docs(spark, rows).coalesce(1)).collect()}
    assert got[200] == len(rows[3][1].encode()) and not any(got[i] for i in range(80))
    assert all(got[100 + i] == len(t) for i, (_, t) in enumerate(rows[81:100], 1))


def test_hash_collisions_are_no_matches(spark, monkeypatch):
    """Where two bytes have one hash value, the bytes are compared and the job says so instead of removing text."""
    same = suffixes._BYTE.copy()
    same[ord("a")] = same[ord("b")]
    monkeypatch.setattr(suffixes, "_BYTE", same)
    text = "".join(random.Random(15).choice("ab") for _ in range(150))
    parts = [(1, 0, 0, text.encode(), 51), (2, 0, 0, text.translate({97: 98, 98: 97}).encode(), 51)]
    x = suffixes.stretches(parts)
    matches, _, _ = suffixes.whole_matches(x)
    assert len(matches["doc"])
    m = suffixes.joined_matches(matches)
    spans = {"doc": m["to"], "t": m["to_t"], "lo": m["to_lo"].astype(np.int32), "n": m["n"].astype(np.int32)}
    rows = suffixes._with_bytes({(p[0], 0): p[3] for p in parts}, np.zeros(len(m["to"]), np.int64), spans, m["doc"], m["t"], m["lo"], m["n"])
    keyed = spark.createDataFrame([(0, p[0], p[0], 0, p[3].decode()) for p in parts], "owner bigint, id bigint, doc bigint, t int, text string")
    packed = spark.createDataFrame([(0, *[bytes(rows.column(c)[0].as_py()) for c in ("doc", "t", "lo", "n", "bytes")])], "owner bigint, doc binary, t binary, lo binary, n binary, bytes binary")
    with pytest.raises(Exception, match="two contents have one hash"):
        suffixes._finish(keyed, packed, "doc_id").collect()


def test_suffix_sort():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))).encode() for _ in range(400)]
    group = np.sort(np.array([rng.randrange(12) for _ in texts]))
    end = np.cumsum([len(t) for t in texts])
    begin = end - [len(t) for t in texts]
    s = suffixes.Suffixes(np.frombuffer(b"".join(texts), np.uint8), begin, end)
    assert s.sort(group).tolist() == sorted(range(len(texts)), key=lambda i: (group[i], texts[i], i))


def test_line_dedup_of_a_long_text(spark):
    """A text of 60,000 lines that all stand in an earlier one; what is left is one line."""
    body = "\n".join(f"line number {i} of a very long text" for i in range(0, 2_400_000, 40))
    import time

    began = time.perf_counter()
    got = {r.doc_id: r for r in lines.dedup(docs(spark, [(1, body), (2, body + "\nthis one is new to both of them")])).collect()}
    assert got[2].text == "this one is new to both of them" and got[2].n_removed == 60_000 and got[1].n_lines == 60_000
    assert time.perf_counter() - began < 240


# decontamination


def test_decontamination(spark):
    rng = random.Random(10)
    items = [(i, prose(rng, rng.choice([1, 3, 5, 7, 9, 11, 14, 16, 40, 200]))) for i in range(40)] + [(100, None), (101, ""), (102, "two words"), (3, "the same id again " + prose(rng, 30))]
    rows = list(EDGES)
    for d in range(120):
        t = prose(rng, 60)
        if d % 3 == 0:
            w = rng.choice(items)[1] or ""
            w = w.split()
            for _ in range(rng.randrange(4)):
                if w:
                    w[rng.randrange(len(w))] = "swapped"
            t += " " + " ".join(w).upper() + ". " + prose(rng, 20)
        rows.append((d, t))
    split = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).strip().split()
    want = {}
    for di, dt in set(rows):
        w = split(dt)
        for ii, it in items:
            x = split(it)
            size = min(15, len(x))
            need = size - (3 if size == 15 else size // 5)
            # every window of the item on every diagonal, without any mask
            for shift in range(-len(x), len(w) if x else -len(x)):
                agree = [0 <= shift + i < len(w) and w[shift + i] == x[i] for i in range(len(x))]
                sums = [sum(agree[i : i + size]) for i in range(len(agree) - size + 1)]
                if max(sums) >= need:
                    first = shift + next(i for i, n in enumerate(sums) if n >= need)
                    old = want.get((di, ii), (0, 10**9))
                    want[di, ii] = (max(old[0], max(sums)), min(old[1], first))
    known = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.first_word) for r in decontaminate.overlaps(docs(spark, rows), known).collect()}
    assert got == want and len(want) > 10
    hit = {d for d, _ in want}
    assert {r.doc_id for r in decontaminate.clean(docs(spark, rows), known).collect()} == {i for i, _ in rows} - hit
    assert decontaminate.overlaps(docs(spark, rows), known.where("false")).count() == 0


def test_short_masks_fit_between_all_substitutions():
    for n in range(1, decontaminate.WINDOW):
        masks = decontaminate.short_masks(n)
        for gone in itertools.combinations(range(n), decontaminate.allowed(n)):
            assert any(all(m[i] == "0" for i in gone) for m in masks), (n, gone)


def test_decontamination_finds_all_substitutions_in_a_window(spark):
    w = [f"word{i}" for i in range(15)]
    known = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    rows = []
    for i, gone in enumerate(itertools.combinations(range(15), 3)):
        rows.append((i, "before it " + " ".join("other" if j in gone else x for j, x in enumerate(w)) + " after it"))
    got = {r.doc_id: (r.matched, r.first_word) for r in decontaminate.overlaps(docs(spark, rows), known).collect()}
    assert got == {i: (12, 2) for i in range(455)}


def test_decontamination_without_broadcast(spark, monkeypatch):
    known = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    rows = docs(spark, [(1, "zero one two three four FIVE six seven eight nine ten eleven twelve"), (2, "nothing of the kind is in this text at all, is it")])
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert [r.doc_id for r in decontaminate.overlaps(rows, known).collect()] == [1]


def test_clean_documents_are_not_shuffled_or_sorted(spark, monkeypatch):
    """The ids that go are broadcast, whatever Spark thinks of their size; only too many of them meet the texts by a shuffle."""
    passage = " ".join(f"word{i}" for i in range(30))
    rows = docs(spark, [(1, f"before {passage} after"), (2, "nothing of it"), (3, None), (None, passage), (None, "goes with the other null id"), (2, "nothing again")])
    known = spark.createDataFrame([("a", passage)], "item_id string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = decontaminate.clean(rows, known)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        want = [(2, "nothing again"), (2, "nothing of it"), (3, None)]
        key = lambda r: (r[0], r[1] or "")
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == want
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
        assert sorted(((r.doc_id, r.text) for r in decontaminate.clean(rows, known).collect()), key=key) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy now, a very long advert that nobody wants to read at all.</div>
<article><h1>A &amp; B</h1><p>First   paragraph<br>goes on.</p><div class="ad">Another advert with many words in it.</div><p>Short.</p><aside>Side</aside>
<p>Last <b>bold</b> &#233;<form><input value="x">Send</form></p></article><section id="comments"><p>Reader: I liked it very much indeed, thank you for it.</p></section>
<footer>&copy; nobody</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "A & B\nFirst paragraph goes on.\nShort.\nLast bold é"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav><a>x</a></nav>") == ""
    plain = "<body><div class='menu'><a href='/'>Home</a></div><div><p>" + "A sentence of the text. " * 5 + "</p><p>Short one.</p></div><div class='footer'>f</div>"
    assert html_text.main_text(plain) == ("A sentence of the text. " * 5).strip() + "\nShort one."
    assert html_text.main_text("<article><p>one<p>two</article><p>not this") == "one\ntwo"
    assert html_text.main_text("<article><p>a < b") == "a < b"
    assert html_text.main_text('<div class="content has-sidebar"><article><div class="entry-header"><h1>T</h1></div><p><a href="/x">linked</a></p></article></div>') == "T\nlinked"
    assert html_text.main_text('<article><p>text</p></article><article class="comment"><p>me too</p></article>') == "text"


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body><p>Short story.</p></body>", "Short story."),
        ("<h1>T</h1><p>a</p><p>b</p>", "T\na\nb"),
        ("<article class='related-work'><p>Text of it.</p></article>", "Text of it."),
        ("<article><p>The price:</p><div class='share-price'>12 EUR</div></article>", "The price:\n12 EUR"),
        ("<article><h1>T</h1><p>Text.</p><div class=share><a href=x>fb</a> <a href=y>tw</a></div><section class=comments><p>Nice!</p></section></article>", "T\nText."),
        # an advert between is no gap, and a short end stays
        ("<div><h1>T</h1><p>Long text, of the article.</p><div class=ad>Buy!</div><p>Thanks for reading.</p></div><div class='site-footer'>(c)</div>", "T\nLong text, of the article.\nThanks for reading."),
        # a list of links after the last dive is a menu, in an article too; one between two surges is the text's
        ("<article><p>Text.</p><ul><li><a>1</a><li><a>2</a><li><a>3</a><li><a>4</a></ul></article>", "Text."),
        ("<article><p>Text.</p><ul><li><a>1</a><li><a>2</a><li><a>3</a><li><a>4</a></ul><p>More.</p></article>", "Text.\n1\n2\n3\n4\nMore."),
        # without class names, the menu and the links below weigh nothing
        ("<body><div><a>a</a></div><ul><li><a>b</a><li><a>c</a><li><a>d</a></ul><div><p>Body text.</p><p>More.</p></div><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul><div>x</div></body>", "Body text.\nMore."),
    ],
)
def test_surge_and_dive(html, text):
    assert html_text.main_text(html) == text


def test_blocks_against_brute_force():
    rng = random.Random(12)
    for _ in range(300):
        weights = [rng.choice([0, 0, 0, rng.randrange(1, 50)]) for _ in range(rng.randrange(25))]
        zero = lambda i: not any(weights[i : i + html_text.WINDOW])
        want, i = [], 0
        while i < len(weights):
            if weights[i]:
                j = next(j for j in range(i + 1, len(weights) + 1) if zero(j))
                want.append((i, j))
                i = j
            i += 1
        assert html_text.blocks(weights) == want, weights


@pytest.mark.parametrize("html", ["<a " * 170_000, '<a href="x ' * 50_000, "<" * 500_000, "<div>" * 100_000, "<b>" * 90_000 + "</i>" * 90_000, '<a ">" ' * 70_000, "<div " + "a" * 500_000 + ">x", "<div class=related>x" * 30_000])
def test_long_pages_take_linear_time(html):
    import time

    began = time.perf_counter()
    html_text.main_text(html)
    assert time.perf_counter() - began < 5


def test_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(df, url_col="url").collect()
    assert sorted(((r.page_id, r.url, r.n_chars, len(r.text)) for r in got), key=str) == sorted([(1, "u", 49, 49), (2, None, 0, 0), (None, "v", 0, 0), (1, "u", 49, 49)], key=str)
    assert html_text.extract(df, "page_id", "html").count() == 4


# languages and toxicity: held-out accuracy


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_accuracy(spark, corpus):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.train(corpus, ~held)
    got = langid.identify(corpus, model).join(corpus.where(held).select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert np.mean([r.rejected for r in got]) < 0.02
    edge = {r.doc_id: r for r in langid.identify(docs(spark, EDGES + [(1, "123 %%% ..")]), model).collect()}
    assert edge[9001].lang_pred == edge[9002].lang_pred == edge[1].lang_pred == "und" and edge[9001].score == 0
    assert edge[None].lang_pred == "en" and edge[9003].lang_pred != "und"
    assert langid.fit([], []).predict(["text"]) == [("und", 0.0, 1.0, True)]
    kept = langid.keep_identified(docs(spark, EDGES), model)
    assert 9001 not in {r.doc_id for r in kept.collect()} and kept.columns == docs(spark, EDGES).columns


def test_toxicity_accuracy(spark):
    path = "/root/testdata/sf0.1"
    texts, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = toxicity.train(texts, labels, ~held)
    got = toxicity.score(texts, model).join(labels.where(held), "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.predicted for r in got) > 0.9 and hit / sum(r.toxic for r in got) > 0.8
    edge = {r.doc_id: r for r in toxicity.score(docs(spark, EDGES + [(1, "You are an idiot, pathetic moron.")]), model).collect()}
    assert edge[9001].score == edge[9002].score and not edge[9001].predicted and edge[1].predicted


def test_toxicity_without_labels():
    for model in (toxicity.fit([], []), toxicity.fit(["a"], [0])):
        assert model.bias < 0 and (model.weights > 0).all()


def test_label_model_discounts_copies():
    rng = np.random.default_rng(2)
    y = rng.random(3000) < 0.3
    good = [np.where(y, rng.random(3000) < 0.8, rng.random(3000) < 0.05) for _ in range(3)]
    votes = np.stack([*good, good[0], good[0]], 1)
    posterior, found = toxicity.label_model(votes, np.where(np.arange(3000) < 1000, y, -1))
    assert found["correlation"][0, 3] > 0.5 and found["correlation"][0, 1] == 0
    assert np.mean((posterior > 0.5) == y) > 0.95


def test_label_model_beats_the_majority():
    """Two good voters against five bad ones that are copies of one another, with few known rows; most rows have no label."""
    rng = np.random.default_rng(5)
    n = 8000
    y = rng.random(n) < 0.3
    good = [np.where(y, rng.random(n) < 0.7, rng.random(n) < 0.04) for _ in range(3)]
    bad = np.where(y, rng.random(n) < 0.5, rng.random(n) < 0.4)
    votes = np.stack([*good, *[bad ^ (rng.random(n) < 0.02) for _ in range(5)]], 1)
    known = np.where(np.arange(n) < 1000, y, -1)
    posterior, found = toxicity.label_model(votes, known)
    rest = known < 0
    right = np.mean((posterior > 0.5)[rest] == y[rest])
    majority = np.mean((votes.mean(1) > 0.5)[rest] == y[rest])
    # as good as with the true rates
    true = lambda j, c: good[j][y == c].mean()
    odds = np.log(y.mean() / (1 - y.mean())) + sum(np.where(g, np.log(true(j, True) / true(j, False)), np.log((1 - true(j, True)) / (1 - true(j, False)))) for j, g in enumerate(good))
    best = np.mean((odds > 0)[rest] == y[rest])
    assert right > best - 0.02 and right > majority + 0.05
    # accuracies come close to the true ones
    for j, g in enumerate(good):
        assert abs(found["accuracy"][j] - y[g].mean()) < 0.05
    # and no label decides its own row's posterior
    other, _ = toxicity.label_model(votes, np.where(np.arange(n) == 0, ~y, known))
    assert abs(other[0] - posterior[0]) < 0.05


def test_toxicity_has_many_voters():
    assert toxicity.VOTERS >= 50


def test_new_words_are_encoded_together_and_rare_ones_leave_room(monkeypatch):
    """1,000 new words are a few texts to the tokenizer; when the memory fills, chunks that come again get its second half."""
    import public_tokenizers

    from tidevec.llm import packing

    monkeypatch.setattr(packing, "CACHE", 400)
    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    plain, given = e._tokenize, []
    monkeypatch.setattr(e, "_tokenize", lambda texts: given.append(len(texts)) or plain(texts))
    letters = "abcdefghij"
    words = [f"Qz{a}{b}{c}" for a in letters for b in letters for c in letters]
    assert e.encode([" ".join(words)]) == plain([" ".join(words)]) and sum(given) < 10
    text = "Often; comes, again. " * 3 + "ßé;é ;;; 'tis"
    for _ in range(3):
        assert e.encode([text]) == plain([text])
    assert {"Often;", "comes,", "again."} <= set(e.known)


def test_suffix_strings_choose_again_where_seeds_became_common(monkeypatch):
    rng = random.Random(8)
    phrases = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (40, 90, 200)] + ["-" * 150]
    parts = []
    for d in range(60):
        raw = "".join(rng.choice([*phrases, prose(rng, 12)]) for _ in range(6)).encode()
        parts.append((d, 0, 0, raw, max(0, len(raw) - suffixes.LENGTH + 1)))
    memo, known, looked = {}, np.zeros(0, np.uint64), []
    whole = suffixes._sliding_min
    monkeypatch.setattr(suffixes, "_sliding_min", lambda *a: looked.append(1) or whole(*a))
    for _ in range(5):
        x = suffixes.stretches(parts, known, memo)
        looks, fresh = len(looked), suffixes.stretches(parts, known)
        assert all((x[c] == fresh[c]).all() for c in suffixes.STRETCH) and len(looked) == looks + 1
        g, n = np.unique(x["g"], return_counts=True)
        known = np.union1d(known, g[n >= 2])
    # one look at all strings in the calls with a memo, and one in each of the others
    assert len(known) > 20 and len(looked) == 6


@pytest.mark.parametrize("most", [1, 100_000])
def test_line_dedup_finds_later_places_without_all_lines(spark, monkeypatch, most):
    """The places of repeated lines were found anew from all lines each time, and all lines shuffled for it."""
    monkeypatch.setattr(lines, "BROADCAST_ROWS", most)
    common = "one line that every second document of these has"
    docs = spark.createDataFrame([(i, f"{common}\nline number {i * 7919} of its own, {i:x}") for i in range(40)], "doc_id long, text string")
    gone = lines.removed(docs)
    read = {c for path in {f.rpartition("/")[0] for f in gone.inputFiles()} for c in spark.read.parquet(path).columns}
    assert "line_no" in read and not {"k0", "k1", "k2", "k3", "n"} & read
    assert {(r.id, r.line_no) for r in gone.collect()} >= {(i, 0) for i in range(1, 40)}


def test_components_of_few_links_take_few_tasks(spark):
    """Every shuffle of every round had all partitions, whatever there was to shuffle."""
    from tidevec.llm.components import components

    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("24", "false")):
        spark.conf.set(n, v)
    try:
        found = components(spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long"))
        assert found.rdd.getNumPartitions() == 1
        assert {tuple(r) for r in found.collect()} == {(2, 1), (3, 1), (9, 7)}
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
