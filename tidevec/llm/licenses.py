"""License scan by ordered signature rules, in DataFrame functions only.

Texts are reduced to their words (A-Z lower-cased, split at every other ASCII
character) with single spaces between. A cheap gate keeps texts without any licence
vocabulary from further work; on the others each rule's keyword is looked for, and
the regex of a rule is only run where its keyword occurs. Of the detections, one that
lies within another of higher priority is suppressed; within one of equal priority
it is suppressed if shorter, or equal and of a later rule. The labels of what is left
are the scan's, beside those of the base phrases, which always stay.

Everything is computed within the row, so there is no shuffle. Detections are resolved
in one pass over them in order of position.

A fold that appends to an array copies it at every step, so folds go over chunks of ``CHUNK``
detections: the time grows with the text and the detections, not with their square.

Defined cases: texts of any length are scanned whole; a null text is empty; a text without detections has empty labels, score
0 and null positions. Overlapping places of a phrase all count. Repeated rows give
repeated results; extra columns are dropped; a null id is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidevec.llm.common import ascii_lower, pick
from tidevec.llm.license_rules import BASE, GATES, rules

CHUNK = 256
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words with single spaces between and around; empty without words."""
    flat = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD, " "))
    return F.when(flat == "", F.lit("")).otherwise(F.concat(F.lit(" "), flat, F.lit(" ")))


def _spaces(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("bigint")


def _rule_table() -> Column:
    return F.array(
        *[
            F.struct(F.lit(o).alias("rule"), F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(k).alias("keyword"), F.lit(x).alias("regex"))
            for o, p, label, k, x in rules()
        ]
    )


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _folded(items: Column, carry: dict[str, Column], kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """The array (of a kind) that a fold makes of items. step: from a struct of the carried values and ``out``, and an
    item, to such a struct; ``out`` is what a chunk has given so far."""

    def chunks(x: Column) -> Column:
        last = F.floor((F.size(x) - 1) / CHUNK).cast("int")
        return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda c: F.slice(x, c * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array().cast(f"array<array<{_ITEM[kind]}>>"))

    def of_chunk(acc: Column, chunk: Column) -> Column:
        kept = [acc[c].alias(c) for c in carry]
        return F.aggregate(chunk, F.struct(*kept, F.array().cast(f"array<{kind}>").alias("out")), step, lambda a: F.struct(*[a[c].alias(c) for c in carry], F.array_append(acc["out"], a["out"]).alias("out")))

    zero = F.struct(*[v.alias(c) for c, v in carry.items()], F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(_let(items, chunks), zero, of_chunk, lambda acc: F.flatten(acc["out"]))


_DETECTION = "struct<start:int,width:int,priority:int,rule:int,label:string,first_word:bigint,words:bigint>"
_KEPT = "struct<rule:int,label:string,priority:int,start:int,stop:int,first_word:bigint,last_word:bigint>"
#: Kinds of the items that are folded into these.
_ITEM = {
    _DETECTION: "struct<gap:int,gap_words:bigint,len:int,words:bigint>",
    _KEPT: "struct<start:int,w:int,p:int,rule:int,label:string,first_word:bigint,words:bigint>",
}


def _found(words: Column, rule: Column) -> Column:
    """Places of a rule's matches: the lengths of what lies between them and of the matches, and their words, add up to
    positions."""
    gaps = F.transform(F.split(words, rule["regex"], -1), lambda g: F.struct(F.length(g).alias("gap"), _spaces(g).alias("gap_words")))
    matches = F.transform(F.regexp_extract_all(words, rule["regex"], F.lit(0)), lambda m: F.struct(F.length(m).alias("len"), _spaces(m).alias("words")))
    steps = F.zip_with(gaps, matches, lambda g, m: F.struct(g["gap"].alias("gap"), g["gap_words"].alias("gap_words"), m["len"].alias("len"), m["words"].alias("words")))

    def step(acc: Column, x: Column) -> Column:
        begin, word = acc["at"] + x["gap"], acc["word"] + x["gap_words"]
        hit = F.struct(begin.alias("start"), x["len"].alias("width"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"), word.alias("first_word"), x["words"].alias("words"))
        return F.struct(
            (begin + F.coalesce(x["len"], F.lit(0))).alias("at"), (word + F.coalesce(x["words"], F.lit(0).cast("bigint"))).alias("word"),
            F.when(x["len"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], hit)).alias("out"),
        )

    return _folded(steps, {"at": F.lit(0), "word": F.lit(0).cast("bigint")}, _DETECTION, step)


def _detections(words: Column) -> Column:
    """All detections, by start, longer first, higher priority first, then in order of the rules."""
    hits = F.transform(F.filter(_rule_table(), lambda r: F.contains(words, r["keyword"])), lambda r: _found(words, r))
    flat = F.flatten(hits)
    keyed = F.transform(flat, lambda d: F.struct(d["start"].alias("start"), (-d["width"]).alias("w"), (-d["priority"]).alias("p"), d["rule"].alias("rule"), d["label"].alias("label"), d["first_word"].alias("first_word"), d["words"].alias("words")))
    return F.array_sort(keyed)


def _kept(sorted_hits: Column) -> Column:
    """Detections that no other one suppresses. What contains a detection comes before it, so it is
    enough to know how far the detections of each priority, or a higher one, have reached."""

    def step(acc: Column, d: Column) -> Column:
        stop, priority = d["start"] - d["w"], -d["p"]
        reach = F.element_at(F.array(*[acc[f"r{p}"] for p in (1, 2, 3, 4)]), priority)
        own = F.struct(d["rule"].alias("rule"), d["label"].alias("label"), priority.alias("priority"), d["start"].alias("start"), stop.alias("stop"), d["first_word"].alias("first_word"), (d["first_word"] + d["words"] - 1).alias("last_word"))
        further = [F.when(priority >= p, F.greatest(acc[f"r{p}"], stop)).otherwise(acc[f"r{p}"]).alias(f"r{p}") for p in (1, 2, 3, 4)]
        return F.struct(*further, F.when(reach >= stop, acc["out"]).otherwise(F.array_append(acc["out"], own)).alias("out"))

    return _folded(sorted_hits, {f"r{p}": F.lit(-1) for p in (1, 2, 3, 4)}, _KEPT, step)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections
    (rule, label, priority, and the first and last word of each that is left)."""
    rows = pick(df, id=id_col, text=text_col).select("id", words_of(F.col("text")).alias("w"))
    w = F.col("w")
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains(w, F.lit(g))
    rows = rows.withColumn("gate", gate)
    rows = rows.withColumn("kept", F.when(F.col("gate"), _kept(_detections(w))).otherwise(F.array().cast(f"array<{_KEPT}>")))
    rows = rows.withColumn("n_words", F.when(w == "", F.lit(0)).otherwise(_spaces(w) - 1).cast("bigint"))
    places, firsts, lasts, base = [], [], [], []
    for phrase, label in BASE.items():
        has = F.col("gate") & F.contains(w, F.lit(f" {phrase} "))
        n = F.when(has, F.size(F.split(w, f" {phrase}(?= )", -1)) - 1).otherwise(0).cast("bigint")
        places.append(n)
        firsts.append(F.when(has, _spaces(F.substring_index(w, f" {phrase} ", 1))))
        lasts.append(F.when(has, F.col("n_words") - _spaces(F.substring_index(w, f" {phrase} ", -1)) - len(phrase.split())))
        base.append(F.when(has, F.lit(label)))
    rows = rows.select(
        "id", "n_words", "w", "kept",
        sum(places[1:], places[0]).alias("n_base"),
        F.least(*firsts).cast("bigint").alias("first_word"),
        F.greatest(*lasts).cast("bigint").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*base)))).alias("b"),
    )
    detections = F.transform("kept", lambda d: F.struct(*[d[c].alias(c) for c in ("rule", "label", "priority", "first_word", "last_word")]))
    labels = F.array_sort(F.array_distinct(F.concat("b", F.transform("kept", lambda d: d["label"]))))
    priority = F.coalesce(F.array_max(F.transform("kept", lambda d: d["priority"])), F.lit(0))
    score = F.element_at(F.array(*[F.lit(x) for x in (0.0, 0.6, 0.8, 0.9, 1.0)]), priority + 1)
    return rows.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("b", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("b") > 0, F.greatest(score, F.lit(0.6))).otherwise(score).alias("score"),
        detections.alias("detections"),
    )
