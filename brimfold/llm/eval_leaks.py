"""Evaluation texts that stand in training documents, word for word or with other parameters.

Words become a template: numbers, units and names (any word outside the vocabulary of the evaluation items) turn
into typed placeholders, all others stay. Templates of windows of ``window`` words (whole items, where an item is
shorter) are hash-joined with those of the items. The slots then tell what leaked: equal words are a verbatim leak;
if each slot value of the item stands for one value of the document throughout the passage, and a window has at least
``literal`` words that are no slots, the item was re-parameterised. A passage is what lies on one diagonal of document and
item. Items of one form fit the same passage; the one with the most windows counts, then the one with the most equal slot
values, then the least id. Equal words have equal templates, so the join loses no verbatim window.

The items are the small side: their words go to the workers, so more than MAX_ITEMS items, or MAX_CHARACTERS in all, are
refused; their windows are broadcast only up to MAX_BROADCAST bytes.

Defined results: null and empty texts, on either side, leak nothing. Null ids take no part. Repeated rows count
once. An item shorter than ``window`` must stand there as a whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from brimfold.llm.text import END, M1, U, WordHash, mix, window_hashes_of, words, words_of_all
from brimfold.plans.shared import TooLarge, bounded_rows

MAX_ITEMS, MAX_CHARACTERS, MAX_BROADCAST = 50_000, 20_000_000, 32_000_000
#: A capitalised word is a name if it stands in at most this share of the items (and at least in one is allowed).
RARE = 0.02
#: Words that name a unit of the number before them.
UNITS = frozenset(
    "year years month months week weeks day days hour hours minute minutes second seconds percent euro euros eur usd dollar dollars credits coins requests clients times people "
    "jahr jahre jahren monat monate monaten woche wochen tag tage tagen stunde stunden minute minuten sekunden prozent mal leute leuten menschen kunden".split()
)
NAME, NUMBER, UNIT, BREAK = 1, 2, 3, 4
WORDS_CACHED = 200_000
#: Texts whose words are looked at in one go.
CHUNK = 512
FILTER_BITS = 20


class Template(dict):
    """word -> token of the template; base words are given, others are typed and remembered within a bound."""

    def __init__(self, base: dict[str, int]):
        super().__init__(base | {END: BREAK})
        self.base = base | {END: BREAK}

    def __missing__(self, word: str) -> int:
        if len(self) > len(self.base) + WORDS_CACHED:
            self.clear()
            self.update(self.base)
        t = self[word] = NUMBER if word.isdecimal() else NAME
        return t


def vocabulary(texts: list[str]) -> dict[str, int]:
    """Template tokens of the items' words: units, and all words that are no names. Names are capitalised wherever they stand, and rare."""
    seen, small, items = WordHash(), set(), Counter()
    for text in texts:
        low = words(text)
        items.update(set(low))
        for w in text.split():
            for p in words(w):
                if w[:1].islower():
                    small.add(p)
    most = max(1, RARE * len(texts))
    base = {w: seen[w] for w in items if not w.isdecimal() and (w in small or items[w] > most)}
    return base | {u: UNIT for u in UNITS}


def _template_windows(tokens: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of the windows of n tokens) for each of the sorted ``lengths``, each built on the one before."""
    h, done = np.zeros(len(tokens), U), 0
    for n in lengths:
        for k in range(done, min(n, len(tokens))):
            part = h[: len(tokens) - k]
            part ^= tokens[k:]
            part *= M1
            part ^= part >> U(31)
        done = n
        yield n, mix(h[: max(0, len(tokens) - n + 1)] ^ U(n))


def _scan(base: dict[str, int], lengths: list[int], known: np.ndarray | None, exact: np.ndarray | None = None, literal: int = 0):
    """Iterator function: (_id, _text) to (_id, _h, _x, _p, _slots, _literal): template hash, word hash, place, slot values and number of other words of each window.

    ``known``: sorted template hashes; other windows are left out, and so are those with less than ``literal`` words that are no
    slots whose word hash is not in the sorted ``exact``, as they can be no leak. Of windows of equal words in a text the first is told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, seen = Template(base), WordHash()
        typed = np.array([NAME, NUMBER, UNIT], U)
        if known is not None:
            maybe = np.zeros(1 << FILTER_BITS, bool)
            maybe[known & U((1 << FILTER_BITS) - 1)] = True
        for batch in batches:
            for first in range(0, len(batch), CHUNK):
                part = batch.slice(first, CHUNK)
                ws = words_of_all(part.column(1).to_pylist())
                tokens = np.fromiter((template[w] for w in ws), U, len(ws))
                ends = np.flatnonzero(tokens == BREAK)
                begins = np.r_[0, ends[:-1] + 1]
                rows, hashes, words_, places, slots, others = [], [], [], [], [], []
                for n, h in _template_windows(tokens, lengths):
                    if known is not None:
                        at = np.flatnonzero(maybe[h & U((1 << FILTER_BITS) - 1)])
                        at = at[np.isin(h[at], known)]
                    else:
                        at = np.arange(len(h))
                    doc = np.searchsorted(ends, at)
                    inside = at + n <= ends[doc] if len(at) else np.zeros(0, bool)
                    at, doc = at[inside], doc[inside]
                    if not len(at):
                        continue
                    spread = at[:, None] + np.arange(n)
                    need, where = np.unique(spread, return_inverse=True)
                    x = window_hashes_of(np.fromiter((seen[ws[k]] for k in need.tolist()), U, len(need))[where.reshape(spread.shape)])
                    slot = np.isin(tokens[spread], typed)
                    other = n - slot.sum(axis=1)
                    keep = np.ones(len(at), bool) if exact is None else (other >= literal) | np.isin(x, exact)
                    keep &= np.isin(np.arange(len(at)), np.unique(np.column_stack([doc.astype(U), x]), axis=0, return_index=True)[1])
                    for k in np.flatnonzero(keep).tolist():
                        slots.append([ws[j] for j in spread[k][slot[k]].tolist()])
                    rows.append(doc[keep])
                    hashes.append(h[at[keep]])
                    words_.append(x[keep])
                    places.append(at[keep] - begins[doc[keep]])
                    others.append(other[keep])
                join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
                signed = lambda parts: pa.array(join(parts, U).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(join(rows, np.int64))), signed(hashes), signed(words_), pa.array(join(places, np.int32)), pa.array(slots, pa.list_(pa.string())), pa.array(join(others, np.int32))], ["_id", "_h", "_x", "_p", "_slots", "_literal"])

    return run


def eval_leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, window: int = 12, literal: int = 6) -> DataFrame:
    """(doc_id, item_id, verbatim_windows, changed_windows): one row per document and item leaked into it, either way."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("_id"), F.col(doc_text).cast("string").alias("_text")).where("_id is not null and _text is not null")
    wanted = items.select(F.col(item_id).alias("_id"), F.col(item_text).cast("string").alias("_text")).where("_id is not null and _text is not null").distinct()
    kind = {x: df.schema["_id"].dataType for x, df in (("doc", source), ("item", wanted))}
    rows = [(i, t) for i, t in bounded_rows(wanted, MAX_ITEMS, "evaluation set") if words(t)]
    base = vocabulary([t for _, t in rows])
    short = sorted({len(words(t)) for _, t in rows if len(words(t)) < window})

    if (size := sum(len(t) for _, t in rows)) > MAX_CHARACTERS:
        raise TooLarge(f"the evaluation set has {size} characters, more than {MAX_CHARACTERS}")

    made = []
    for lengths, part in [([window], [x for x in rows if len(words(x[1])) >= window])] + [([n], [x for x in rows if len(words(x[1])) == n]) for n in short]:
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(part)), pa.int64()), pa.array([t for _, t in part], pa.string())], ["_id", "_text"])
        for out in _scan(base, lengths, None)([batch]):
            made += [(part[r["_id"]][0], r["_h"], r["_x"], r["_p"], r["_slots"]) for r in out.to_pylist()]
    shape = T.StructType([T.StructField("_item", kind["item"]), T.StructField("_h", T.LongType()), T.StructField("_ix", T.LongType()), T.StructField("_ip", T.IntegerType()), T.StructField("_islots", T.ArrayType(T.StringType()))])
    known, exact = (np.unique(np.array([m[i] for m in made], np.int64).view(U)) for i in (1, 2))
    lengths = sorted({*short, *([window] if any(len(words(t)) >= window for _, t in rows) else [])})
    small = spark.createDataFrame(made, shape)
    if sum(64 + sum(16 + 4 * len(w) for w in m[4]) for m in made) <= MAX_BROADCAST:
        small = F.broadcast(small)

    scanned = source.mapInArrow(_scan(base, lengths, known, exact, literal), f"_id {kind['doc'].simpleString()}, _h bigint, _x bigint, _p int, _slots array<string>, _literal int")
    zipped = F.arrays_zip(F.col("_islots").alias("i"), F.col("_slots").alias("d"))
    joined = scanned.join(small, "_h").where("size(_islots) = size(_slots)").withColumn("_pairs", F.array_distinct(zipped))
    one_to_one = lambda pairs: (F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["i"])))) & (F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["d"]))))
    judged = joined.withColumns({"_verbatim": F.col("_x") == F.col("_ix"), "_changed": (F.col("_x") != F.col("_ix")) & one_to_one(F.col("_pairs")) & (F.col("_literal") >= literal)})
    judged = judged.where("_verbatim or _changed").withColumn("_diagonal", F.col("_p") - F.col("_ip"))
    passages = judged.groupBy("_id", "_item", "_diagonal").agg(F.count_if("_verbatim").alias("v"), F.count_if("_changed").alias("c"), F.min("_p").alias("_from"), F.array_distinct(F.flatten(F.collect_set("_pairs"))).alias("_pairs"))
    passages = passages.select("_id", "_item", "_from", "v", F.when(one_to_one(F.col("_pairs")), F.col("c")).otherwise(0).alias("c"), F.size(F.filter("_pairs", lambda p: p["i"] == p["d"])).alias("_same"))
    # all passages that begin at one place of a document compete; the items are few, and so are these
    place = W.Window.partitionBy("_id", "_from").orderBy((F.col("v") + F.col("c")).desc(), F.col("_same").desc(), "_item")
    counted = passages.withColumn("_rank", F.row_number().over(place)).groupBy("_id", "_item").agg(F.sum("v").alias("verbatim_windows"), F.sum(F.when(F.col("_rank") == 1, F.col("c")).otherwise(0)).alias("changed_windows"))
    return counted.where("verbatim_windows > 0 or changed_windows > 0").select(F.col("_id").alias("doc_id"), F.col("_item").alias("item_id"), "verbatim_windows", "changed_windows")
