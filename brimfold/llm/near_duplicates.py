"""Near-duplicate records with small edits: MinHash banding, verified on the full n-gram sets.

A record's set holds the hashes of all its n-word sequences. Records with equal sets collapse into one node. ``bands``
x ``rows`` minima of the set give the band hashes, and nodes that share one are candidates. With 64 bands of 5 rows a
pair of similarity 0.6 is a candidate with probability 0.994, of 0.65 with 0.9996, of 0.8 with certainty for all
purposes. Every candidate pair is decided, whatever the size of its band, but few have to be formed:

1. Each node of a band is verified against the band's least node, its leader: at most one pair a node and band.
   Verified pairs are links, and linked nodes form clusters.
2. Nodes of one band in different clusters are verified too. Jaccard distance is a metric, so two nodes whose distances
   to their common leader differ by more than the threshold allows are not similar, and are not formed.
3. Classes need no more. For all pairs, the nodes of a cluster are compared in blocks, each block with each, by the
   product of their incidence matrices; only pairs that reach the threshold leave a block.

Before the sets of a candidate pair are brought together, one bit of each minimum is compared: a pair of the threshold's
similarity agrees in at least MARGIN standard errors less than is expected of it, or is lost with probability 4e-11. What is
left is decided by the sets themselves. So classes cost work in proportion to the rows of the bands, and pairs cost, within
clusters, a 256th of a shuffled row each. The count of common n-grams is exact but for collisions of 32-bit hashes (one in
10^5 pairs of 200 n-grams).

Defined results: records whose required text has no words, and sets without a single sequence, have no
duplicates. A null id takes no part. Of repeated rows of an id the latest counts (ties: the greatest set key).
Records with equal sets are duplicates of similarity 1. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimfold.llm.text import END, U, WordHash, mix, window_hashes, words_of_all
from brimfold.operators.components import components
from brimfold.plans.shared import discard, materialize

#: Records whose words are hashed in one go.
CHUNK = 128
#: Nodes and n-grams of a block of a cluster; a pair of blocks is what one worker holds at a time.
BLOCK_NODES, BLOCK_GRAMS = 256, 250_000
#: Columns of an incidence matrix multiplied at once.
COLUMNS = 4096
#: How many standard errors below its expectation the agreement of two sketches may lie.
MARGIN = 6.5


class NearDuplicates(NamedTuple):
    """members (id, rep): the node of every record with a set; links (a, b, similarity): verified pairs of nodes that hold every
    class together; labels (node, label): the cluster of each node in a link of the first step; sets (node, _set, _size)."""

    members: DataFrame
    links: DataFrame
    labels: DataFrame
    sets: DataFrame
    threshold: float


def _sketches(texts: list[str], required: str, n: int, bands: int, rows: int):
    """Iterator function: (_id, _at, _row, texts) to (_id, _at, _row, _key, _size, _set, _bands, _sig): the sorted 32-bit hashes as bytes, band hashes, a bit of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, width, must = WordHash(), len(texts), texts.index(required)
        end = U(seen[END])
        rng = np.random.default_rng(7)
        mult = rng.integers(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
        words = -(-bands * rows // 64)
        number = mix(np.arange(1, bands + 1, dtype=U))
        for batch in batches:
            keep, keys, sets, hashes = [], [], [], []
            for first in range(0, len(batch), CHUNK):
                columns = [batch.column(c).slice(first, CHUNK).to_pylist() for c in texts]
                ws = words_of_all([t for record in zip(*columns) for t in record])
                tokens = np.fromiter((seen[w] for w in ws), U, len(ws))
                ends = tokens == end
                text = np.cumsum(ends)[~ends]  # the text each word is in
                tokens = tokens[~ends]
                count = len(columns[0])
                size = np.bincount(text, minlength=count * width).reshape(count, width)
                windows = window_hashes(tokens, n)
                begin = np.cumsum(np.r_[0, size.sum(axis=1)])
                for i in np.flatnonzero((size[:, must] > 0) & (size.sum(axis=1) >= n)).tolist():
                    found = np.unique(windows[begin[i] : begin[i + 1] - n + 1])
                    keep.append(first + i)
                    keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    s = (found >> U(32)).astype(np.uint32)
                    sets.append(s if len(s) < 2 else s[np.r_[True, s[1:] != s[:-1]]])
                    low = np.full(bands * rows, 2**32 - 1, np.uint32)
                    for k in range(0, len(sets[-1]), 256):
                        np.minimum(low, (sets[-1][k : k + 256, None] * mult).min(axis=0), out=low)
                    hashes.append(low)
            low = np.array(hashes, U).reshape(len(keep), bands, rows)
            h = np.broadcast_to(number, (len(keep), bands)).copy()
            for r in range(rows):
                h = mix(h ^ low[:, :, r])
            flat = np.ascontiguousarray((h >> U(32)).astype(np.uint32)).view(np.int32).reshape(-1)
            bits = np.zeros((len(keep), 64 * words), np.uint8)
            bits[:, : bands * rows] = (mix(low) >> U(63)).astype(np.uint8).reshape(len(keep), bands * rows)
            sig = np.packbits(bits, axis=1).view(np.int64).reshape(-1)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, w, dtype=np.int32)), pa.array(x)) for x, w in ((flat, bands), (sig, words))]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("_id", "_at", "_row")), pa.array(keys, pa.binary()), pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary()), *lists], ["_id", "_at", "_row", "_key", "_size", "_set", "_bands", "_sig"])

    return run


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, _set_a, _set_b) to (a, b, similarity)."""
    for batch in batches:
        out = np.empty(len(batch))
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            out[i] = common / (len(both) - common)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["a", "b", "similarity"])


def _verified(pairs: DataFrame, made: DataFrame, minima: int, threshold: float, name: str) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) that may be similar by their sketches; others are left out. Written, as it is read more than once."""
    words, chance = -(-minima // 64), (1 + threshold) / 2
    least = math.floor(minima * chance - MARGIN * math.sqrt(minima * chance * (1 - chance))) + 64 * words - minima
    sketch = lambda x: made.select(F.col("_row").alias(x), F.col("_sig").alias(f"_sig_{x}"))
    agree = sum((F.bit_count(F.bitwise_not(F.col("_sig_a")[k].bitwiseXOR(F.col("_sig_b")[k]))) for k in range(words)), F.lit(0))
    likely = materialize(pairs.join(sketch("a"), "a").join(sketch("b"), "b").where(agree >= least).select("a", "b"), name)
    if not likely.limit(1).count():
        return likely.withColumn("similarity", F.lit(0.0))
    # of the sets only those needed are moved; the side that may be hot is joined while rows are small
    nodes = likely.select(F.col("a").alias("_row")).unionByName(likely.select(F.col("b").alias("_row")))
    held = made.select("_row", "_set").join(nodes, "_row", "left_semi")
    side = lambda x: held.select(F.col("_row").alias(x), F.col("_set").alias(f"_set_{x}"))
    both = likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_set_a", "_set_b")
    out = materialize(both.mapInArrow(_similarity, "a bigint, b bigint, similarity double"), name)
    discard(likely)
    return out


def near_duplicates(df: DataFrame, key: str, texts: list[str], required: str, latest: str | None = None, n: int = 5, threshold: float = 0.8, bands: int = 64, rows: int = 5) -> NearDuplicates:
    """Records whose sets of n-word sequences of ``texts`` (in this order) have a Jaccard similarity of ``threshold`` or more, linked."""
    alias = [f"_t{i}" for i in range(len(texts))]
    at = F.unix_micros(F.col(latest).cast("timestamp")) if latest else F.lit(0).cast("bigint")
    source = df.select(F.col(key).alias("_id"), at.alias("_at"), F.monotonically_increasing_id().alias("_row"), *[F.col(c).cast("string").alias(a) for c, a in zip(texts, alias)]).where("_id is not null")
    shape = f"_id {source.schema['_id'].dataType.simpleString()}, _at bigint, _row bigint, _key binary, _size int, _set binary, _bands array<int>, _sig array<bigint>"
    # rows get their numbers once: whatever comes later reads the written table
    made = materialize(source.mapInArrow(_sketches(alias, alias[texts.index(required)], n, bands, rows), shape), "sets")
    sets = made.select(F.col("_row").alias("node"), "_set", "_size")

    # few ids and few sets come again: only those are sorted, and joined with the rest as a table of known size
    again = materialize(made.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select("_id"), "again")
    latest_of = made.join(again, "_id", "left_semi").groupBy("_id").agg(F.max(F.struct("_at", "_key", "_row")).alias("_m")).select("_id", "_m._key", "_m._row")
    newest = made.join(again, "_id", "left_anti").select("_id", "_key", "_row").unionByName(latest_of)
    copies = materialize(newest.groupBy("_key").agg(F.min("_row").alias("rep"), F.count("*").alias("_n")).where("_n > 1").select("_key", "rep"), "copies")
    members = materialize(newest.join(copies, "_key", "left").select(F.col("_id").alias("id"), F.coalesce("rep", "_row").alias("rep"), (F.col("_row") == F.coalesce("rep", "_row")).alias("_first")), "members")

    banded = made.select(F.col("_row").alias("node"), "_bands").join(members.where("_first").select(F.col("rep").alias("node")), "node", "left_semi").select("node", F.posexplode("_bands").alias("_b", "_v"))
    held = banded.select(F.shiftleft(F.col("_b").cast("bigint"), 32).bitwiseOR(F.col("_v").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))).alias("_h"), "node")
    buckets = materialize(held.groupBy("_h").agg(F.count("*").alias("_n"), F.min("node").alias("a"), F.max("node").alias("b"), F.try_sum("node").alias("_s")).where("_n > 1"), "buckets")
    # of two or three nodes least, greatest and sum tell all (a sum that overflows is of many more); for more the members are looked up
    third = buckets.where("_n = 3").select("_h", "a", F.explode(F.array("b", F.col("_s") - F.col("a") - F.col("b"))).alias("b"))
    leaders = materialize(buckets.where("_n > 3").select("_h", "a"), "leaders")
    crowd = materialize(held.join(leaders, "_h").where("node <> a").select("_h", "a", F.col("node").alias("b")).unionByName(third), "crowd")

    check = lambda pairs, name: _verified(pairs, made, bands * rows, threshold, name)
    star = check(buckets.where("_n = 2").select("a", "b").unionByName(crowd.select("a", "b")).distinct(), "star")
    linked = star.where(F.col("similarity") >= threshold)
    labels = components(linked, "a", "b")

    # nodes of one band, but of different clusters; those next to the leader were verified with it
    # (what the sketches tell apart is at least as far from the leader as the threshold allows)
    far = 1 - threshold
    placed = crowd.join(star, ["a", "b"], "left").join(labels.select(F.col("node").alias("b"), "label"), "b", "left").select("_h", F.col("b").alias("node"), F.coalesce("label", "b").alias("label"), (1 - F.col("similarity")).alias("d"))
    mixed = placed.groupBy("_h").agg(F.min("label").alias("_l"), F.max("label").alias("_m")).where("_l <> _m").select("_h")
    rest = materialize(placed.join(mixed, "_h", "left_semi"), "rest")
    x, y = (rest.select("_h", F.col("node").alias(c), F.col("label").alias(f"l{c}"), F.col("d").alias(f"d{c}")) for c in "ab")
    # an unknown distance is beyond far, so only a known one below it tells anything with it, and that is not enough
    cross = x.join(y, "_h").where(F.expr(f"a < b and la <> lb and coalesce(abs(da - db) <= {far + 1e-9!r}, true)")).select("a", "b").distinct()
    found = check(cross, "cross").where(F.col("similarity") >= threshold)
    for done in (again, copies, buckets, leaders, crowd, rest):
        discard(done)
    return NearDuplicates(members.select("id", "rep"), linked.unionByName(found), labels, sets, threshold)


def _within_blocks(threshold: float):
    """Iterator function: rows (_l, _i, _j, _b, node, _set), sorted by _l, _i, _j, to the similar pairs (a, b, similarity) of blocks _i and _j of cluster _l."""

    def pairs(nodes: np.ndarray, block: np.ndarray, sets: list[np.ndarray], i: int, j: int):
        size = np.array([len(s) for s in sets])
        column = np.unique(np.concatenate(sets), return_inverse=True)[1]
        row = np.repeat(np.arange(len(sets)), size)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        common = np.zeros((len(left), len(right)))
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        for low in range(0, int(column[-1]) + 1, COLUMNS):
            s, e = np.searchsorted(column, (low, low + COLUMNS))
            part = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - low)), np.float32)
            part[row[s:e], column[s:e] - low] = 1
            common += part[left] @ part[right].T
        ratio = common / (size[left][:, None] + size[right][None, :] - common)
        good = ratio >= threshold
        if i == j:
            good &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        p, q = np.nonzero(good)
        a, b = nodes[left[p]], nodes[right[q]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(ratio[p, q])], ["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, rows = None, []
        for batch in batches:
            ids = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_l", "_i", "_j", "_b", "node")])
            column = batch.column("_set")
            for k in range(len(batch)):
                group = tuple(ids[k, :3])
                if group != open_ and rows:
                    yield pairs(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows], int(open_[1]), int(open_[2]))
                    rows = []
                open_ = group
                rows.append((ids[k, 4], ids[k, 3], np.frombuffer(column[k].as_py(), np.uint32)))
        if rows:
            yield pairs(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows], int(open_[1]), int(open_[2]))

    return run


def similar_pairs(found: NearDuplicates) -> DataFrame:
    """(a, b, similarity), a < b: every two similar nodes."""
    sized = found.labels.join(found.sets.select("node", "_size"), "node")
    clusters = sized.groupBy("label").agg(F.count("*").alias("_n"), F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("_size") / BLOCK_GRAMS)).cast("int").alias("_k")).where("_n > 2")
    nodes = found.labels.join(clusters, "label").select("node", F.col("label").alias("_l"), "_k", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int").alias("_b"))
    spread = nodes.join(found.sets.select("node", "_set"), "node").select("_l", "_b", "node", "_set", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_o"))
    blocks = spread.select("_l", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", "node", "_set").repartition("_l", "_i", "_j").sortWithinPartitions("_l", "_i", "_j")
    inside = blocks.mapInArrow(_within_blocks(found.threshold), "a bigint, b bigint, similarity double")
    # links of two nodes that are a cluster of their own, and those between clusters
    ends = found.links.join(found.labels.select(F.col("node").alias("a"), F.col("label").alias("_la")), "a", "left").join(found.labels.select(F.col("node").alias("b"), F.col("label").alias("_lb")), "b", "left")
    others = ends.join(clusters.select(F.col("label").alias("_la"), F.lit(1).alias("_in")), "_la", "left").where("_in is null or not (_la <=> _lb)").select("a", "b", "similarity")
    return inside.unionByName(others)


def all_pairs(found: NearDuplicates) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records, copies expanded. Equi-joins on the node, which AQE splits where it is hot."""
    m = found.members
    within = m.select("rep", F.col("id").alias("x")).join(m.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    near = similar_pairs(found)
    across = near.join(m.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    return within.unionByName(across).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def classes(found: NearDuplicates) -> DataFrame:
    """(id, class_id): one row per record; its class is the least id reachable by links. No pairs are formed."""
    labels = components(found.links, "a", "b").select(F.col("node").alias("rep"), "label")
    placed = found.members.join(labels, "rep", "left").select("id", F.coalesce("label", "rep").alias("_c"))
    return placed.join(placed.groupBy("_c").agg(F.min("id").alias("class_id")), "_c").select("id", "class_id")
