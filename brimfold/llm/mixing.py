"""Sources mixed to target weights by a low-discrepancy schedule of equal-token blocks.

Each document is measured in tokens of a public tokenizer. Every source's documents, in shuffled order, are cut into
blocks of ``block_tokens``; a document longer than a block is a block of its own, and what is scheduled are the blocks that
hold documents. A mix is a row of slots: golden-ratio points are mapped through the cumulative shares of
the sources, so any run of slots is close to the shares; the r-th slot of a source takes its block r modulo its
number of blocks, in an order that runs through all of them before one is used again. So a document is used at most
once per round, and rounds are capped by ``max_repeats``.

The size of a mix is its ``size_ratio`` times the tokens of all documents. A source whose cap is below its share
gives all it may; the others give more, in proportion to their weights, until the size is reached or all are at their
cap. The shares reached are counted from the documents in the mix, not from the schedule.

Running totals and ranks are computed in two levels (totals of cells, then within cells), so no source is one task.

Defined results: documents with null or empty text have no tokens and are not in a mix; those without a source belong
to none but count for the size. Repeated rows of an id count once (the greatest). Plan rows without plan or source, or
without a positive weight, get nothing; repeated rows of a plan and source add up their weights and take the greatest
max_repeats. Sources that don't exist, or that a plan doesn't name, give nothing. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brimfold.llm.text import once_per_worker
from brimfold.operators.prefix import CELLS, running_total
from brimfold.plans.shared import bounded_rows, materialize

MAX_PLAN_ROWS = 100_000
GOLDEN = (5**0.5 - 1) / 2
#: Fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _count(vocabulary, name: str):
    """Iterator function: (_id, _source, _text) to (_id, _source, tokens); ``vocabulary`` is a broadcast file of ranks, parsed once a worker."""

    def coder():
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.value.splitlines() if line)}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = once_per_worker(("tokenizer", name, len(vocabulary.value)), coder).encode_ordinary
        for batch in batches:
            tokens = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], ["_id", "_source", "tokens"])

    return run


def token_sizes(docs: DataFrame, key: str, source: str, text: str, tokenizer: str) -> DataFrame:
    """(_id, _source, tokens), one row per document; ``tokenizer`` is the path of a vocabulary file of byte-level ranks, on the driver."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_id"), F.col(source).cast("string").alias("_source"), F.col(text).cast("string").alias("_text")).where("_id is not null")
    shape = f"_id {rows.schema['_id'].dataType.simpleString()}, _source string, tokens bigint"
    sizes = rows.mapInArrow(_count(spark.sparkContext.broadcast(Path(tokenizer).read_bytes()), tokenizer), shape)
    return materialize(sizes.groupBy("_id").agg(F.max(F.struct("_source", "tokens")).alias("_m")).select("_id", "_m.*"), "sizes")


def filled(weights: dict[str, float], caps: dict[str, float], size: float) -> dict[str, float]:
    """Amounts in proportion to the weights, none above its cap, that sum up to ``size`` or to all caps."""
    amounts, left, room = dict.fromkeys(weights, 0.0), size, {s: w for s, w in weights.items() if w > 0 and caps.get(s, 0) > 0}
    while room and left > 0:
        level = left / sum(room.values())
        full = [s for s, w in room.items() if caps[s] <= level * w]
        if not full:
            return amounts | {s: level * w for s, w in room.items()}
        for s in full:
            amounts[s] = caps[s]
            left -= caps[s]
            del room[s]
    return amounts


def plan_rows(targets: DataFrame, sizes: DataFrame, numbers: DataFrame) -> list[dict]:
    """One dict per plan and source, with its share, its amount and its part of the line of slots. Driver side: as many rows as the plans have.

    ``numbers`` (source, block) has the blocks of each source.
    """
    held = sizes.groupBy("_source").agg(F.sum("tokens").alias("source_tokens")).join(numbers.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("blocks")), "_source", "left")
    whole = sizes.agg(F.sum("tokens")).first()[0] or 0
    wanted = targets.select("plan", "source", F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(0)).alias("r"), F.coalesce("size_ratio", F.lit(0.0)).alias("q")).where("plan is not null and source is not null")
    wanted = wanted.groupBy("plan", "source").agg(F.sum("w").alias("w"), F.max("r").alias("r"), F.max("q").alias("q")).join(held.withColumnRenamed("_source", "source"), "source", "left")
    plans = defaultdict(list)
    for row in bounded_rows(wanted, MAX_PLAN_ROWS, "table of mixing plans"):
        plans[row["plan"]].append(row)
    out = []
    for plan, rows in sorted(plans.items()):
        rows.sort(key=lambda x: x["source"])
        total, size = sum(x["w"] for x in rows), max(x["q"] for x in rows) * whole
        caps = {x["source"]: float(max(0, x["r"]) * (x["source_tokens"] or 0)) for x in rows}
        amounts = filled({x["source"]: x["w"] for x in rows}, caps, size)
        blocks_of = {x["source"]: x["blocks"] or 0 for x in rows}
        # blocks differ, by their last document, so what counts is their mean
        needed = {x["source"]: amounts[x["source"]] * blocks_of[x["source"]] / x["source_tokens"] if x["source_tokens"] else 0.0 for x in rows}
        line = sum(needed.values())
        slots, at = math.ceil(line), 0.0
        for x in rows:
            part, blocks = needed[x["source"]] / line if line else 0.0, blocks_of[x["source"]]
            step = max(1, round(blocks * GOLDEN))
            while blocks and math.gcd(step, blocks) > 1:
                step += 1
            out.append({"plan": plan, "source": x["source"], "target_share": x["w"] / total if total else 0.0, "max_repeats": max(0, x["r"]), "source_tokens": x["source_tokens"] or 0, "slots": slots, "low": at, "high": at + part, "blocks": blocks, "step": step})
            at += part
        if line:  # the sum of the parts may fall short of 1 by a rounding
            next(x for x in reversed(out) if x["high"] > x["low"])["high"] = 1.0
    return out


_PLAN = T.StructType([T.StructField(n, t()) for n, t in (("plan", T.StringType), ("source", T.StringType), ("target_share", T.DoubleType), ("max_repeats", T.IntegerType), ("source_tokens", T.LongType), ("slots", T.LongType), ("low", T.DoubleType), ("high", T.DoubleType), ("blocks", T.LongType), ("step", T.LongType))])


def _schedule(spark: SparkSession, plans: list[dict]) -> DataFrame:
    """(plan, slot, source, block, copy): which block of which source stands in each slot."""
    # the line of a plan is cut into as many cells as it has sources, so a cell has few of them and all plans together at most three rows a source
    cells = Counter(p["plan"] for p in plans if p["high"] > p["low"])
    line = None
    for plan, slots in sorted({(p["plan"], p["slots"]) for p in plans if cells[p["plan"]]}):
        at = (F.col("id") + 0.5) * GOLDEN % 1
        part = spark.range(slots).select(F.lit(plan).alias("plan"), F.col("id").alias("slot"), at.alias("_u"), F.floor(at * cells[plan]).alias("_c"))
        line = part if line is None else line.unionByName(part)
    if line is None:
        return spark.createDataFrame([], "plan string, slot bigint, source string, block bigint, copy bigint")
    named = ("plan", "source", "low", "high", "max_repeats", "blocks", "step")
    parts = [(*(p[n] for n in named), c) for p in plans if p["high"] > p["low"] for c in range(int(p["low"] * cells[p["plan"]]), int(p["high"] * cells[p["plan"]]) + 1)]
    table = spark.createDataFrame(parts, "plan string, source string, low double, high double, max_repeats int, blocks bigint, step bigint, _c bigint")
    # each slot falls to one source: an equi-join on the cell of the line
    taken = line.join(F.broadcast(table), ["plan", "_c"]).where("_u >= low and _u < high").select("plan", "slot", "source", "max_repeats", "blocks", "step")
    width = max(1, max(p["slots"] for p in plans) // CELLS)
    ranked = running_total(taken, ["plan", "source"], F.floor(F.col("slot") / width), ["slot"], F.lit(1), "_rank")
    copy = F.floor(F.col("_rank") / F.col("blocks"))
    return ranked.select("plan", "slot", "source", ((F.col("_rank") % F.col("blocks")) * F.col("step") % F.col("blocks")).alias("block"), copy.alias("copy"), "max_repeats").where("copy < max_repeats").drop("max_repeats")


def mix(docs: DataFrame, key: str, source: str, text: str, targets: DataFrame, tokenizer: str, block_tokens: int = 1024, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The mixes (plan, slot, source, id, copy, tokens), one row per use of a document, and the shares reached.

    Shares: (plan, source, target_share, actual_share, mix_tokens, source_tokens, max_repeats, uses), one row per plan and source.
    """
    spark = docs.sparkSession
    sizes = token_sizes(docs, key, source, text, tokenizer)
    order = F.xxhash64(F.col("_id").cast("string"), F.lit(seed))
    placed = running_total(sizes.where("_source is not null and tokens > 0").withColumn("_o", order), ["_source"], F.pmod(F.shiftright("_o", 40), F.lit(CELLS)), ["_o", "_id"], F.col("tokens"), "_before")
    raw = materialize(placed.select(F.col("_source").alias("source"), F.floor(F.col("_before") / block_tokens).alias("raw"), F.col("_id").alias("id"), "tokens"), "blocks")
    # blocks that hold a document, numbered without gaps
    width = max(1, (raw.agg(F.max("raw")).first()[0] or 0) // CELLS)
    numbers = materialize(running_total(raw.select("source", "raw").distinct(), ["source"], F.floor(F.col("raw") / width), ["raw"], F.lit(1), "block"), "numbers")
    plans = plan_rows(targets, sizes, numbers)
    blocks = raw.join(numbers.hint("merge"), ["source", "raw"]).select("source", "block", "id", "tokens")
    mixed = materialize(_schedule(spark, plans).join(blocks.hint("merge"), ["source", "block"]).select("plan", "slot", "source", "id", "copy", "tokens"), "mix")
    reached = mixed.groupBy("plan", "source").agg(F.sum("tokens").alias("mix_tokens"), F.count("*").alias("uses"))
    table = spark.createDataFrame([tuple(p[f.name] for f in _PLAN) for p in plans], _PLAN).select("plan", "source", "target_share", "max_repeats", "source_tokens")
    shares = table.join(reached, ["plan", "source"], "left").fillna(0, ["mix_tokens", "uses"])
    total = shares.groupBy("plan").agg(F.sum("mix_tokens").alias("_all"))
    shares = shares.join(total, "plan").withColumn("actual_share", F.when(F.col("_all") > 0, F.col("mix_tokens") / F.col("_all")).otherwise(0.0))
    return mixed, shares.select("plan", "source", "target_share", "actual_share", "mix_tokens", "source_tokens", "max_repeats", "uses")
