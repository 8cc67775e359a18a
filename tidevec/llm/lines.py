"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines (of at least ``MIN_CHARS`` characters after lower-casing and squeezing white
space) are duplicates if they differ in at most ``EDITS`` = 1 insertion, deletion or
substitution. The first place of a line, by document id and line number, counts; a
place is removed if an equal line, or one within the edit, has an earlier first place.

Split into EDITS + 1 = 2 segments, two such lines agree in one of them: at the same
place counted from the start, or from the end. So every line indexes the hashes of what
is left without either segment, under its own length, and probes those under the next
length. The texts are read once for that: what is stored of a line is its place, a hash
of 128 bits, its length and its four keys. Only keys that lines of different text share
go on, and only for those are the lines fetched. A key with few lines
gives its pairs, verified by a banded bit-parallel edit distance. A key with many is
not cut short: its lines divide the segment that may differ into eighths and index what
is left without each, and so on, until a key means that all but one character agree;
then its lines are linked through the earliest one. So common segments cost a few more
rows a line and never all pairs of a group, and no link that decides a removal is lost.

Defined cases: a null text has no lines and stays null; a text of which all lines go
becomes empty; shorter lines, empty ones included, always stay. Rows with equal id and
text count as one document; a null id comes first. Texts of any length and with any
number of removed lines are handled in time proportional to their length. An empty
table gives an empty result. Extra columns are kept by ``dedup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidevec.llm.common import cut, join_counted, pick, small, stored

MIN_CHARS = 20
EDITS = 1
#: Lines of a key that still give all their pairs.
FEW = 8
#: Parts a segment is divided into at each further level.
FAN = 8
#: Times that the part of a pair which may differ is halved before its edit distance is found.
HALVINGS = 4
#: Rows of line hashes and places that are broadcast at most: what a broadcast takes of the driver's memory, several
#: times its size, comes on top of that of the plans.
BROADCAST_ROWS = 100_000
#: (side, segment) of the keys that are stored with each line.
_KEYS = [(side, j) for side in (0, 1) for j in range(EDITS + 1)]


def normal(text: Column) -> Column:
    """Lower case, with single spaces for white space within lines; most texts have no other and need no regex."""
    odd = F.lit(False)
    for gap in ("  ", "\t", "\r", "\f", "\x0b"):
        odd = odd | F.contains(text, F.lit(gap))
    lower = F.lower(text)
    return F.when(odd, F.regexp_replace(lower, "[ \\t\\r\\f\\x0B]+", " ")).otherwise(lower)


def _lines(docs: DataFrame) -> DataFrame:
    """id, t (hash of the text), line_no and line of every line. docs: id, text."""
    rows = docs.select("id", F.xxhash64("text").alias("t"), normal(F.col("text")).alias("text"))
    rows = rows.select("id", "t", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    return rows.select("id", "t", "line_no", F.trim("raw").alias("line"))


def _edge(length: Column, parts: Column, j: Column) -> Column:
    """Where part j of a line of this length begins."""
    return F.floor(length.cast("bigint") * j / parts).cast("int")


def _outside(line: Column, n: Column, side: Column, parts: Column, j: Column) -> Column:
    """Hash of what is left of a line without part j of the layout for its length plus side."""
    size = n + side
    begin, end = _edge(size, parts, j), _edge(size, parts, j + 1)
    return F.xxhash64(size, parts, j, F.substring(line, F.lit(1), begin), F.substring(line, end - side + 1, size - end))


def _shared(rows: DataFrame) -> DataFrame:
    """Keys that lines of different text have, one of them under its own length, and how many rows have
    each (rows). rows: key, h, side."""
    keys = rows.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min("side").alias("side"), F.count("*").alias("rows"))
    return cut(keys.where("a < b and side = 0").select("key", "rows"))


def distance(a: Column, b: Column, k: int = EDITS) -> Column:
    """Edit distance where it is at most k, else some number over k: banded bit-parallel, one step a
    character of b, 2k + 2 bits a step. a is at least as long as b, by k at most; b is longer than k."""
    w = 2 * k + 2
    full = (1 << w) - 1
    x, y = F.split(a, "", -1), F.split(b, "", -1)

    def step(acc: Column, c: Column, i: Column) -> Column:
        vp, vn = acc["vp"], acc["vn"]
        at = i + (k + 1 - w)
        match = F.lit(0)
        for bit in range(w):
            match = match + F.when(F.get(acc["x"], at + bit) == c, 1 << bit).otherwise(0)
        # one struct a step, so that each value is computed once
        d0 = ((((match.bitwiseAND(vp)) + vp).bitwiseXOR(vp)).bitwiseOR(match).bitwiseOR(vn)).bitwiseAND(full)
        return d0

    def fold(acc: Column, item: Column) -> Column:
        i, c = item["i"], item["c"]
        d0 = step(acc, c, i)
        vp = acc["vp"]
        hp = acc["vn"].bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(full)
        hn = d0.bitwiseAND(vp)
        late = i - (F.size(acc["x"]) - k)
        level = F.lit(w - 2) - late
        bit = lambda v, at: F.shiftright(v, at).bitwiseAND(1)
        # shift by a column: powers of two are few
        pick_bit = lambda v: sum((F.when(level == s, bit(v, s)).otherwise(0) for s in range(w)), F.lit(0))
        d = acc["d"] + F.when(late < 0, F.lit(1) - bit(d0, w - 1)).otherwise(pick_bit(hp) - pick_bit(hn))
        half = F.shiftright(d0, 1)
        return F.struct(
            acc["x"].alias("x"), hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp))).bitwiseAND(full).alias("vp"),
            half.bitwiseAND(hp).alias("vn"), d.alias("d"),
        )

    zero = F.struct(x.alias("x"), F.lit((full << (w - k - 1)) & full).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("d"))
    items = F.transform(y, lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    return F.aggregate(items, zero, fold, lambda acc: acc["d"])


def _halved(pairs: DataFrame) -> DataFrame:
    """pairs (first, same, l, s) with the half that agrees taken off l and s; same becomes false where neither
    half does, as one edit leaves one of the two alone."""
    n, m = F.length("l"), F.length("s")
    p = F.floor(m / 2).cast("int")
    pairs = pairs.select("*", n.alias("n"), m.alias("m"), p.alias("p"))
    p, q = F.col("p"), F.col("m") - F.col("p")
    head = F.substring("l", 1, p) == F.substring("s", 1, p)
    tail = F.substring("l", F.col("n") - q + 1, q) == F.substring("s", p + 1, q)
    pairs = pairs.select("*", F.when(~F.col("same"), 3).when(F.col("m") < 8, 0).when(head, 1).when(tail, 2).otherwise(3).alias("how"))
    how = F.col("how")
    # a character of what agrees stays at the cut, so that what is left is longer than the band
    cut_l = F.when(how == 1, F.substring("l", p, F.col("n"))).when(how == 2, F.substring("l", F.lit(1), F.col("n") - q + 1)).otherwise(F.col("l"))
    cut_s = F.when(how == 1, F.substring("s", p, F.col("m"))).when(how == 2, F.substring("s", F.lit(1), p + 1)).otherwise(F.col("s"))
    return pairs.select("first", (how < 3).alias("same"), cut_l.alias("l"), cut_s.alias("s"))


def _verified(pairs: DataFrame, parts: int) -> DataFrame:
    """The place that a verified pair removes: the later one. pairs: a, b with h, side, j, n, line, first.

    Their key says that they agree outside part j; that is compared, and the distance found of the part with
    two more characters at each end, halved as far as halves agree.
    """

    def cuts(c: str) -> tuple[Column, Column, Column]:
        line, n, side = F.col(f"{c}.line"), F.col(f"{c}.n"), F.col(f"{c}.side")
        size = n + side
        begin = F.greatest(F.lit(0), _edge(size, F.lit(parts), F.col(f"{c}.j")) - 2)
        end = F.least(size, _edge(size, F.lit(parts), F.col(f"{c}.j") + 1) + 2) - side
        return F.substring(line, F.lit(1), begin), F.substring(line, begin + 1, end - begin), F.substring(line, end + 1, n - end)

    (a1, a2, a3), (b1, b2, b3) = cuts("a"), cuts("b")
    a_longer = F.col("a.n") >= F.col("b.n")
    pairs = pairs.select(
        F.greatest("a.first", "b.first").alias("first"), ((a1 == b1) & (a3 == b3)).alias("same"),
        F.when(a_longer, a2).otherwise(b2).alias("l"), F.when(a_longer, b2).otherwise(a2).alias("s"),
    )
    for _ in range(HALVINGS):
        pairs = _halved(pairs)
    # the distance stands in the select, and the filter behind an aggregate, so it is computed once a pair
    measured = pairs.select("first", F.when(F.col("same"), distance(F.col("l"), F.col("s"))).alias("d"))
    return measured.groupBy("first").agg(F.min("d").alias("d")).where(F.col("d") <= EDITS).select("first")


def _near(docs: DataFrame, base: DataFrame, total: int) -> DataFrame:
    """first: the places of lines that have an earlier line within the edit. base: what is stored of the lines."""
    columns = ["key", "side", "j", "h", "n"]
    flat = base.select("id", "t", "line_no", "h", "n", F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.lit(j).alias("j"), F.col(f"k{i}").alias("key")) for i, (side, j) in enumerate(_KEYS)])).alias("k"))
    flat = flat.select("id", "t", "line_no", "h", "n", "k.side", "k.j", "k.key")
    rows = join_counted(flat, _shared(flat.select("key", "h", "side")), ["key"], "rows", total, most=BROADCAST_ROWS)
    rows = stored(rows.groupBy(*columns).agg(F.min(F.struct("id", "t", "line_no")).alias("first")))
    # a line for each hash, fetched from its first place
    places = stored(rows.select("h", "first.*").distinct())
    holders = small(cut(places.select(F.col("id").alias("_id"), F.col("t").alias("_t")).distinct()), BROADCAST_ROWS)
    held = docs.withColumn("t", F.xxhash64("text")).join(holders, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left_semi")
    wanted = small(places, BROADCAST_ROWS).select("h", *[F.col(c).alias(f"_{c}") for c in ("id", "t", "line_no")])
    lines = _lines(held).join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")) & (F.col("line_no") == F.col("_line_no")))
    rows = cut(rows.join(lines.groupBy("h").agg(F.min("line").alias("line")), "h"))

    def keyed(rows: DataFrame, parts: int) -> DataFrame:
        """A row for each of FAN parts of part j."""
        out = rows.withColumn("j", F.explode(F.sequence(F.col("j") * FAN, F.col("j") * FAN + FAN - 1)))
        size = F.col("n") + F.col("side")
        width = _edge(size, F.lit(parts), F.col("j") + 1) - _edge(size, F.lit(parts), F.col("j"))
        return out.where(width > 0).withColumn("key", _outside(F.col("line"), F.col("n"), F.col("side"), F.lit(parts), F.col("j")))

    parts, found = EDITS + 1, None
    while True:
        counts = cut(rows.groupBy("key").agg(F.count("*").alias("rows")))
        # few lines: all their pairs, of a bounded list
        item = F.struct("side", "h", "j", "n", "first", "line")
        few = rows.join(counts.where(F.col("rows") <= FEW).select("key"), "key").groupBy("key").agg(F.collect_list(item).alias("rows"))
        a = few.select("rows", F.explode("rows").alias("a")).where("a.side = 0")
        b = a.select("a", F.explode("rows").alias("b")).where("a.h <> b.h and (b.side = 1 or a.h < b.h)")
        pairs = b.select("a", "b")
        many = join_counted(rows, cut(counts.where(F.col("rows") > FEW)), ["key"], "rows", total, most=BROADCAST_ROWS)
        # at the end, where one character may differ: through the earliest line
        last = F.col("n") + F.col("side") <= parts
        leaf = many.where(last)
        own = F.struct("h", "side", "j", "n", "first", "line")
        # lines of side 1 equal what is left, so a key has one of them, and each is within the edit of all others
        star = leaf.groupBy("key").agg(F.min(F.struct(F.col("first"), own.alias("r"))).alias("s"), F.count("*").alias("rows")).select("key", F.col("s.r").alias("b"), "rows")
        star = join_counted(leaf.select("key", own.alias("a")), cut(star), ["key"], "rows", total, most=BROADCAST_ROWS).where("a.h <> b.h").select("a", "b")
        keep = lambda c: F.struct(*[F.col(f"{c}.{x}") for x in ("h", "side", "j", "n", "first", "line")]).alias(c)
        hits = cut(_verified(pairs.select(keep("a"), keep("b")).unionByName(star.select(keep("a"), keep("b"))), parts))
        found = hits if found is None else found.unionByName(hits)
        parts *= FAN
        deeper = keyed(many.where(~last).drop("key"), parts)
        rows = cut(join_counted(deeper, _shared(deeper.select("key", "h", "side")), ["key"], "rows", total, most=BROADCAST_ROWS))
        if rows.isEmpty():
            return found.distinct()


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, t (hash of the text) and line_no of every line to remove."""
    own = pick(docs, id=id_col, text=text_col)
    n = F.length("line")
    keys = [_outside(F.col("line"), F.col("n"), F.lit(side), F.lit(EDITS + 1), F.lit(j)).alias(f"k{i}") for i, (side, j) in enumerate(_KEYS)]
    lines = _lines(own).select("id", "t", "line_no", "line", n.alias("n")).where(F.col("n") >= MIN_CHARS)
    base = stored(lines.select("id", "t", "line_no", "n", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(EDITS), "line").alias("g"), *keys))
    total = base.count()
    again = cut(base.groupBy("h", "g").agg(F.count("*").alias("rows")).where("rows > 1"))
    # stored, as what follows reads the places three times and would shuffle all lines each time
    places = stored(join_counted(base.select("id", "t", "line_no", "h", "g"), again, ["h", "g"], "rows", total, most=BROADCAST_ROWS))
    place = F.struct("id", "t", "line_no")
    firsts = stored(places.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("rows")))
    later = join_counted(places, firsts, ["h", "g"], "rows", total, most=BROADCAST_ROWS).where(~place.eqNullSafe(F.col("first"))).select("id", "t", "line_no")
    near = _near(own, base, total).select("first.id", "first.t", "first.line_no")
    return later.unionByName(near)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text of the lines that are left, and n_lines and n_removed (which replace columns of that name)."""
    docs = docs.drop("n_lines", "n_removed")
    gone = removed(docs, id_col, text_col).groupBy("id", "t").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    # names that docs can't have: none of its columns is longer
    own = "_" * (1 + max(map(len, docs.columns)))
    gone = gone.select(F.col("id").alias(f"{own}id"), F.col("t").alias(f"{own}t"), F.col("gone").alias(f"{own}gone"))
    rows = docs.join(gone, docs[id_col].eqNullSafe(gone[f"{own}id"]) & (F.xxhash64(docs[text_col]) == gone[f"{own}t"]), "left")
    gone, cuts = F.col(f"{own}gone"), F.col(f"{own}parts")
    parts = F.when(gone.isNotNull(), F.split(docs[text_col], "\n", -1))
    rows = rows.select(*[docs[c] for c in docs.columns], gone, parts.alias(f"{own}parts"))
    # runs of lines between those that go
    n = F.size(cuts)
    runs = F.arrays_zip(F.concat(F.array(F.lit(-1)), gone).alias("a"), F.concat(gone, F.array(n)).alias("b"))
    left = F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(cuts, r["a"] + 2, r["b"] - r["a"] - 1))), "\n")
    text = F.when(gone.isNull(), docs[text_col]).otherwise(left)
    breaks = F.octet_length(docs[text_col]) - F.octet_length(F.replace(docs[text_col], F.lit("\n"), F.lit("")))
    return rows.select(
        *[text.alias(c) if c == text_col else docs[c] for c in docs.columns],
        F.coalesce(breaks + 1, F.lit(0)).cast("bigint").alias("n_lines"),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("bigint").alias("n_removed"),
    )


def oracle() -> str:
    """DuckDB SQL for ``dedup`` on doc_id and text of documents: the same rule, stated plainly."""
    return f"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
),
l AS (
  SELECT doc_id, text, raw, line_no, trim(regexp_replace(lower(raw), '[ \\t\\r\\f\\x0B]+', ' ', 'g'), ' ') AS line FROM raw
),
f AS (
  SELECT line, len(line) AS n, min({{'d': doc_id, 'n': line_no}}) AS first, row_number() OVER () AS h
  FROM l WHERE len(line) >= {MIN_CHARS} GROUP BY line
),
halves AS (
  SELECT h, line, n, first, side, n + side AS size, unnest([0, 1]) AS j FROM f, (VALUES (0), (1)) AS s(side)
),
keys AS (
  SELECT h, line, n, first, side, size, j,
    CASE j WHEN 1 THEN substr(line, 1, CAST(size // 2 AS BIGINT)) ELSE substr(line, CAST(size // 2 - side + 1 AS BIGINT)) END AS rest FROM halves
),
pairs AS (
  SELECT DISTINCT a.line AS x, b.line AS y, greatest(a.first, b.first) AS first
  FROM keys a JOIN keys b ON a.size = b.size AND a.j = b.j AND a.rest = b.rest AND a.h <> b.h WHERE a.side = 0
),
near AS (
  SELECT DISTINCT first FROM pairs WHERE len(list_filter(range(CAST(len(y) + 1 AS BIGINT)), lambda k: substr(x, 1, k) = substr(y, 1, k)
    AND substr(x, k + 2) = substr(y, CASE WHEN len(x) = len(y) THEN k + 2 ELSE k + 1 END))) > 0
),
marked AS (
  SELECT l.*, len(l.line) >= {MIN_CHARS} AND (f.first <> {{'d': doc_id, 'n': line_no}} OR near.first IS NOT NULL) AS gone
  FROM l LEFT JOIN f ON l.line = f.line LEFT JOIN near ON near.first = {{'d': doc_id, 'n': line_no}}
),
kept AS (
  SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS left_text
  FROM marked GROUP BY doc_id, text
)
SELECT d.doc_id, CASE WHEN n_removed > 0 THEN left_text ELSE d.text END AS text,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id AND k.text = d.text"""
