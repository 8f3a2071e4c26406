"""Long exact spans that stand in more than one document, by level-wise doubling of window lengths.

Up to ``least`` characters windows are doubled in length: a quarter, a half and the whole of it. At the first two,
windows are chosen by their content: of all windows in a stretch of ``least`` characters the one with the least hash, so
a stretch has its chosen window at the same place in every document that holds it. A stretch whose chosen window stands
in one document alone is given up; only what is left is looked at again at twice the length. At ``least`` every window
that is left is compared, so the result is exact but for collisions of 64-bit hashes of equal length. How much of a
document is shared (``shared_chars``) needs no more, as every longer stretch is covered by windows of that length.

The stretches themselves (``shared_spans``) are doubled on, until no candidate survives. A longest stretch can only begin
where the documents that hold a window differ in the character before it, and end where they differ in the one after
it. From each beginning candidates run to the 1st, the 2nd to 2nd, the 3rd to 4th, the 5th to 8th such end and so on; those
that stand in one document alone are given up, and only beginnings whose last candidate stands in several are doubled
again. So a stretch is one that stands as a whole in another document: where two others hold one half each, there are two.
A window that came before in its run of adjacent windows (a repetition: blanks, dashes, a refrain) begins no candidates, as
all of its places would; there stretches may be told in parts, down to ``least`` characters, that cover it without a gap.

Whole copies are collapsed first: a text held by several documents is shared as a whole, and one document
stands for all of them. Windows found in different documents are found by a count per hash that is aggregated
before the shuffle; no pairs are formed, so a stretch held by a third of all documents costs one row per place. All joins
are sort-merge joins, which spill: nothing here has a size bound that would allow a broadcast.

Defined results: null ids, null texts and texts shorter than ``least`` have no spans. A stretch repeated only
inside one document is not shared. Repeated rows of an id count once (the greatest text). Lengths are in
characters (code points). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimfold.llm.text import M1, M2, U, mix
from brimfold.plans.shared import discard, materialize

#: Stands for the character before the first window after a repetition, where a beginning is looked for in every text.
BEHIND = -2
#: Characters hashed at once, so that the arrays stay in the processor's cache; a longer text is a chunk of its own.
CHUNK = 1 << 16


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after the other, and where each begins (one more entry for the end)."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    return np.concatenate(raw).astype(U), np.cumsum([0, *map(len, raw)])


def _hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """h[i]: hash of the window of ``length`` from i; the last length-1 entries mean nothing. Lengths double from the powers of two below."""
    powers, h, size = {}, (codes + U(1)) * M1, 1
    h ^= h >> U(29)
    parts, rest = [], length
    while size <= length:
        if rest & size:
            powers[size] = h
        if size * 2 <= length:
            new = h * M1
            new[:-size] += h[size:] * M2
            new ^= new >> U(31)
            h = new
        size *= 2
    out, at = None, 0
    for size in sorted(powers, reverse=True):
        part = powers[size]
        if out is None:
            out, at = part * M2, size
        else:
            out = (out ^ (out >> U(30))) * M1
            out[:-at] += part[at:]
            at += size
    return mix(out)


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width]; the last width-1 entries see fewer."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = op(out[:-step], out[step:]) if step < len(out) else out[:-step]
        have += step
    return out


def _chosen(h: np.ndarray, ok: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least hash of some run of ``width`` positions that are all ``ok``."""
    if len(h) < width:
        return np.empty(0, np.int64)
    h = (h >> U(32)).astype(np.uint32)  # half the bytes; where the upper halves tie, both are chosen, in every document
    low = _slide(h, width, np.minimum)
    full = _slide(ok, width, np.logical_and)
    full[len(h) - width + 1 :] = False
    low[~full] = 0
    high = _slide(low[::-1], width, np.maximum)[::-1]
    return np.flatnonzero((high == h) & (high > 0))


def _again(pos: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the sorted places hold a hash that came before in the same run of adjacent places."""
    run = np.cumsum(np.r_[0, np.diff(pos) != 1])[: len(pos)]
    order = np.lexsort((pos, h, run))
    out = np.zeros(len(pos), bool)
    out[order[1:]] = (run[order[1:]] == run[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
    return out


def _chunks(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about CHUNK characters."""
    texts, size, first = [], 0, 0
    for i, t in enumerate(batch.column(at).to_pylist()):
        texts.append(t)
        size += len(t)
        if size >= CHUNK:
            yield first, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, texts


def _windows(length: int, least: int, masked: bool, beside: bool = False):
    """Iterator function: (_id, _text[, _won]) to (_id, _pos, _h[, _before, _after]), the chosen windows of ``length``.

    Any run of least - length + 1 positions holds a chosen one. With ``masked``, _won has the chosen windows of half
    the length, and only stretches of ``least`` whose chosen one is live are looked at. With ``beside``, the characters
    next to each window are told, -1 where the text begins or ends, BEHIND for the first window after a repetition.
    """
    width = least - length + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _chunks(batch, 1):
                codes, begin = _codes(texts)
                n = len(codes)
                ok = np.ones(n, bool)
                for e in begin[1:]:  # windows that would cross the end of a text
                    ok[max(0, e - length + 1) : e] = False
                if masked:
                    ok &= _left_over(begin, batch.column(2).slice(first, len(texts)), length, least)
                if not ok.any():
                    continue
                h = _hashes(codes, length)
                pos = np.flatnonzero(ok) if width == 1 else _chosen(h, ok, width)
                doc = np.searchsorted(begin, pos, "right") - 1
                ids = batch.column(0).take(pa.array(first + doc))
                columns, names = [ids, pa.array((pos - begin[doc]).astype(np.int32)), pa.array(h[pos].view(np.int64))], ["_id", "_pos", "_h"]
                if beside:
                    signed = codes.view(np.int64)
                    before = np.where(pos > begin[doc], signed[np.maximum(pos - 1, 0)], -1)
                    again = _again(pos, h[pos])
                    before[1:][again[:-1] & ~again[1:] & (np.diff(pos) == 1)] = BEHIND
                    after = np.where(pos + length < begin[doc + 1], signed[np.minimum(pos + length, n - 1)], -1)
                    columns, names = columns + [pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))], [*names, "_before", "_after"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _left_over(begin: np.ndarray, won: pa.ListArray, length: int, least: int) -> np.ndarray:
    """Which windows of ``length`` lie in a stretch of ``least`` whose chosen window of half the length is live."""
    n, width = begin[-1], least - length // 2 + 1
    flat = won.flatten()
    place = np.repeat(begin[:-1], [len(x) for x in won]) + flat.field(0).to_numpy()
    value = np.full(n, U(2**64 - 2))  # the lowest bit says whether a window is live
    value[place] = flat.field(1).to_numpy().view(U)
    good = (_slide(value, width, np.minimum) & U(1)).astype(bool)
    for b, e in zip(begin[:-1], begin[1:]):  # stretches that would cross the end of a text
        good[max(b, e - least + 1) : e] = False
    cover = np.zeros(n + 1, np.int64)
    i = np.flatnonzero(good)
    np.add.at(cover, i, 1)
    np.add.at(cover, i + least - length + 1, -1)
    return np.cumsum(cover[:-1]) > 0


def _repeated(windows: DataFrame) -> DataFrame:
    """Hashes found in more than one document."""
    return windows.groupBy("_h").agg(F.min("_id").alias("_a"), F.max("_id").alias("_b")).where("_a <> _b").select("_h", F.lit(1).cast("bigint").alias("_live"))


def _left(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Documents that still have a repeated window: (_id, _text, _won); _won has place and hash of its chosen windows, live ones with the lowest bit set."""
    value = F.col("_h").bitwiseAND(F.lit(-2).cast("bigint")).bitwiseOR(F.coalesce("_live", F.lit(0).cast("bigint"))).alias("_v")
    won = windows.join(_repeated(windows).hint("merge"), "_h", "left").select("_id", "_pos", value, "_live").groupBy("_id").agg(F.collect_list(F.struct("_pos", "_v")).alias("_won"), F.count("_live").alias("_n"))
    return docs.select("_id", "_text").join(won.where("_n > 0").select("_id", "_won").hint("merge"), "_id")


def _prepared(df: DataFrame, key: str, text: str, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (_id, _text), one row per id; digests (_id, _md, _n); and those of texts held several times (_id, _rep, _n)."""
    source = df.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text")).where((F.length("_text") >= least) & F.col("_id").isNotNull())

    def digests(rows: DataFrame) -> DataFrame:
        return materialize(rows.select("_id", F.unhex(F.md5("_text")).alias("_md"), F.length("_text").alias("_n")).groupBy("_id").agg(F.first("_md").alias("_md"), F.first("_n").alias("_n"), F.count("*").alias("_rows")), "digests")

    digest = digests(source)
    if digest.where("_rows > 1").limit(1).count():
        source = materialize(source.groupBy("_id").agg(F.max("_text").alias("_text")), "once")
        digest = digests(source)
    copies = digest.groupBy("_md").agg(F.min("_id").alias("_rep"), F.count("*").alias("_copies")).where("_copies > 1")
    return source, digest, digest.join(copies.hint("merge"), "_md").select("_id", "_rep", "_n")


def _live(source: DataFrame, held: DataFrame, least: int, beside: bool) -> DataFrame:
    """Windows of ``least`` characters that stand in more than one of the different texts: (_id, _pos, _h[, _from, _to]).

    _from tells whether the texts that hold the window differ in the character before it, _to in the one after it.
    """
    shape = f"_id {source.schema['_id'].dataType.simpleString()}, _pos int, _h bigint"
    spare = held.where("_id <> _rep").select("_id")
    first = materialize(source.mapInArrow(_windows(least // 4, least, False), shape), "windows")
    left = materialize(_left(source, first.join(spare.hint("merge"), "_id", "left_anti")), "left")
    second = materialize(left.mapInArrow(_windows(least // 2, least, True), shape), "windows")
    discard(first)
    still = materialize(_left(left, second), "left")
    discard(second)
    discard(left)
    last = materialize(still.mapInArrow(_windows(least, least, True, beside), shape + (", _before int, _after int" if beside else "")), "windows")
    discard(still)
    if not beside:
        return last.join(_repeated(last).select("_h").hint("merge"), "_h", "left_semi")
    ends = last.groupBy("_h").agg(F.min("_id").alias("_a"), F.max("_id").alias("_b"), ((F.min("_before") != F.max("_before")) | (F.min("_before") == BEHIND)).alias("_from"), (F.min("_after") != F.max("_after")).alias("_to")).where("_a <> _b")
    return last.select("_id", "_pos", "_h").join(ends.select("_h", "_from", "_to"), "_h")


def shared_chars(df: DataFrame, key: str, text: str, least: int = 400) -> DataFrame:
    """(id, shared_chars, n_chars): each document with a stretch of ``least`` or more characters that stands in another one, and how
    many of its characters lie in any such stretch. ``least`` is a multiple of 4."""
    source, digest, held = _prepared(df, key, text, least)
    live = _live(source, held, least, False)
    kind = source.schema["_id"].dataType.simpleString()
    covered = live.groupBy("_id").agg(F.sort_array(F.collect_set("_pos")).alias("_p")).mapInArrow(_merge(least), f"_id {kind}, shared_chars bigint")
    every = covered.join(held.select("_id").hint("merge"), "_id", "left_anti").unionByName(held.select("_id", F.col("_n").cast("bigint").alias("shared_chars")))
    return every.join(digest.select("_id", F.col("_n").alias("n_chars")).hint("merge"), "_id").select(F.col("_id").alias("id"), "shared_chars", "n_chars")


def shared_spans(df: DataFrame, key: str, text: str, least: int = 400) -> DataFrame:
    """(id, start, length, shared_chars, n_chars): the stretches of ``least`` or more characters of each document that stand as a whole
    in another one and are part of no longer such stretch. They may overlap. ``least`` is a multiple of 4."""
    source, digest, held = _prepared(df, key, text, least)
    live = _live(source, held, least, True)
    id_ = f"_id {source.schema['_id'].dataType.simpleString()}"
    places = live.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_pos", "_h", "_from", "_to"))).alias("_w"))
    # a row a document: its windows in order; written, as each doubling reads them
    places = materialize(places, "places")
    reached = materialize(places.mapInArrow(_begins(least), f"{id_}, _start int, _end int"), "reached")
    alive, low = reached.select("_id", "_start"), 1
    while True:
        asked = places.join(alive.groupBy("_id").agg(F.collect_list("_start").alias("_s")), "_id")
        tried = materialize(asked.mapInArrow(_candidates(least, low), f"{id_}, _start int, _end int, _nth int, _h bigint"), "tried")
        good = tried.join(tried.groupBy("_h").agg(F.min("_id").alias("_a"), F.max("_id").alias("_b")).where("_a <> _b").select("_h"), "_h", "left_semi")
        good = materialize(good.select("_id", "_start", "_end", "_nth"), "good")
        discard(tried)
        further = materialize(reached.unionByName(good.select("_id", "_start", "_end")).groupBy("_id", "_start").agg(F.max("_end").alias("_end")), "reached")
        discard(reached)
        reached, low = further, low * 2
        alive = good.where(F.col("_nth") == low).select("_id", "_start")
        if not alive.limit(1).count():
            break
    ends = reached.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_start", "_end"))).alias("_s"))
    spans = places.join(ends, "_id").mapInArrow(_longest(least), f"{id_}, start int, length int, shared_chars bigint")
    whole = held.select("_id", F.lit(0).alias("start"), F.col("_n").alias("length"), F.col("_n").cast("bigint").alias("shared_chars"))
    every = spans.join(held.select("_id").hint("merge"), "_id", "left_anti").unionByName(whole)
    return every.join(digest.select("_id", F.col("_n").alias("n_chars")).hint("merge"), "_id").select(F.col("_id").alias("id"), "start", "length", "shared_chars", "n_chars")


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Row number and the columns of the windows of each document, in order of their places."""
    for i, w in enumerate(batch.column(batch.schema.get_field_index("_w"))):
        rows = w.values
        yield i, {name: rows.field(name).to_numpy(zero_copy_only=False) for name in ("_pos", "_h", "_from", "_to")}


def _marks(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of windows where a longest stretch may begin and may end, and the run of adjacent windows each one is in."""
    gap = np.diff(w["_pos"]) != 1
    run = np.cumsum(np.r_[0, gap])
    return np.flatnonzero((w["_from"] & ~_again(w["_pos"], w["_h"])) | np.r_[True, gap]), np.flatnonzero(w["_to"] | np.r_[gap, True]), run


def _begins(least: int):
    """Iterator function: (_id, _w) to (_id, _start, _end): each beginning with its first end, up to which all that hold it agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, w in _arrays(batch):
                begin, end, _ = _marks(w)
                rows += [i] * len(begin)
                starts.append(w["_pos"][begin])
                ends.append(w["_pos"][end[np.searchsorted(end, begin)]] + least)
            join = lambda x: pa.array(np.concatenate(x).astype(np.int32) if x else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), join(starts), join(ends)], ["_id", "_start", "_end"])

    return run


def _candidates(least: int, low: int):
    """Iterator function: (_id, _w, _s) to (_id, _start, _end, _nth, _h): from each place of _s the candidates to its ends after the ``low``-th up to the 2 ``low``-th.

    The hash of a candidate is made of its length and the hashes of the windows that cover it, each beginning where the one before ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            starts = batch.column(batch.schema.get_field_index("_s"))
            for i, w in _arrays(batch):
                _, end, run_ = _marks(w)
                pos, h = w["_pos"], w["_h"].view(U)
                for s in sorted(starts[i].values.to_numpy().tolist()):
                    at = int(np.searchsorted(pos, s))
                    first = int(np.searchsorted(end, at))
                    value, k = U(0), at
                    for nth in range(low + 1, 2 * low + 1):
                        if first + nth - 1 >= len(end) or run_[end[first + nth - 1]] != run_[at]:
                            break
                        last = int(end[first + nth - 1])
                        while k <= last:
                            value = mix(np.array([value ^ h[k]]))[0]
                            k += least
                        tail = mix(np.array([value ^ h[last] ^ U(last - at)]))[0]
                        rows.append(i)
                        out.append((s, int(pos[last]) + least, nth, int(tail.view(np.int64))))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64())))], ["_id", "_start", "_end", "_nth", "_h"])

    return run


def _longest(least: int):
    """Iterator function: (_id, _w, _s) to (_id, start, length, shared_chars): of the sorted stretches those that lie in no other one,
    windows that none of them covers, and how many characters all of them cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, lengths, covered = [], [], [], []
            spans = batch.column(batch.schema.get_field_index("_s"))
            for i, w in _arrays(batch):
                start, end = (spans[i].values.field(f).to_numpy() for f in ("_start", "_end"))
                keep = end > np.r_[-1, np.maximum.accumulate(end)[:-1]]
                start, end, pos = start[keep], end[keep], w["_pos"]
                of = np.searchsorted(start, pos, "right") - 1
                spare, extra, k = pos[end[of] < pos + least], [], 0  # only in and behind repetitions
                while k < len(spare):
                    extra.append(spare[k])
                    k = max(k + 1, int(np.searchsorted(spare, spare[k] + least, "right")) - 1)
                start = np.r_[start, np.array(extra, start.dtype)]
                end = np.r_[end, np.array(extra, end.dtype) + least]
                order = np.argsort(start, kind="stable")
                start, end = start[order], end[order]
                rows += [i] * len(start)
                starts.append(start)
                lengths.append(end - start)
                total = np.minimum(np.diff(pos), least).sum() + least
                covered += [int(total)] * len(start)
            join = lambda x: pa.array(np.concatenate(x).astype(np.int32) if x else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), join(starts), join(lengths), pa.array(covered, pa.int64())], ["_id", "start", "length", "shared_chars"])

    return run


def _merge(least: int):
    """Iterator function: (_id, _p) to (_id, shared_chars); _p has the sorted places of shared windows of ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [int(np.minimum(np.diff(p.values.to_numpy()), least).sum()) + least for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64())], ["_id", "shared_chars"])

    return run
