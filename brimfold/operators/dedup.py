"""One posting from many deliveries of it.

Postings that share a canonical URL, a source id, a fingerprint or the hash of a long description are one; so are those
of one company whose long descriptions begin alike, are about as long and nearly equal, and those of one company and
place (or both remote) with nearly equal titles and similar descriptions. Links form components (least label, lineage
cut in the shared folder), and each component is merged by aggregates. Every two rows of a block count, however far apart
they are: rows with the same texts stand for each other, and bounds that no similar pair can fail (lengths, edit distance
of titles, longest common subsequence of texts) come before difflib's ratio.

Defined results: empty keys link nothing. Ties in preference go to the earlier row (``order``).
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import BooleanType

from brimfold.functions.keys import fingerprint
from brimfold.functions.text import normalize_company, normalize_plain
from brimfold.functions.urls import canonical_url, host_quality
from brimfold.operators.components import components
from brimfold.plans.shared import materialize

LONG_TEXT = 500
SIMILAR = 0.97
TITLE_SIMILAR, TEXT_SIMILAR = 0.9, 0.88


@lru_cache(64)
def _places(text: str) -> dict[str, int]:
    """Bit set of the positions of each character."""
    back = text[::-1]
    return {c: int("".join("1" if x == c else "0" for x in back), 2) for c in set(text)}


def _common(left: str, right: str) -> int:
    """Length of the longest common subsequence (bit-parallel): the blocks that difflib matches are one, so they are never longer in all."""
    at, full = _places(left), (1 << len(left)) - 1
    v = full
    for c in right:
        u = v & at.get(c, 0)
        v = (v + u) | (v - u)
    return len(left) - (v & full).bit_count()


def alike(left: str, right: str, least: float) -> bool:
    """Whether difflib's ratio of two texts, which depends on the order of the two, is ``least`` or more. An upper bound of it comes first."""
    both = len(left) + len(right)
    if left == right or not both:
        return True
    if 2.0 * min(len(left), len(right)) / both < least or 2.0 * _common(left, right) / both < least:
        return False
    return SequenceMatcher(None, left, right).ratio() >= least


def _alike(least: float):
    """alike of two columns, in Arrow batches."""

    @F.pandas_udf(BooleanType())
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([alike(a or "", b or "", least) for a, b in zip(left, right)], dtype=bool)

    return run


def with_keys(df: DataFrame) -> DataFrame:
    """Adds _keys, the array of exact keys of a canonical posting, and _anchor, the block of its description."""
    company, body = normalize_company(F.col("company")), normalize_plain(F.col("description"))
    df = df.withColumns({"_company": company, "_body": body})
    urls = F.array_distinct(F.filter(F.transform(F.concat(F.array("url", "apply_url", "canonical_url"), F.map_values("source_urls")), canonical_url), lambda u: u != ""))
    space = F.lower(F.coalesce(F.nullif(F.col("ats"), F.lit("")), F.col("source"), F.lit("")))
    long = (F.col("_company") != "") & (F.length("_body") >= LONG_TEXT)
    keys = F.concat(
        F.transform(urls, lambda u: F.concat(F.lit("u|"), u)),
        F.when(F.col("source_job_id") != "", F.array(F.concat_ws("|", F.lit("i"), space, "source_job_id"))).otherwise(F.array()),
        F.array(F.concat(F.lit("f|"), fingerprint(F.col("company"), F.col("title"), F.col("location")))),
        F.when(long, F.array(F.concat_ws("|", F.lit("d"), "_company", F.sha2("_body", 256)))).otherwise(F.array()),
    )
    anchor = F.when(long, F.concat_ws("|", "_company", F.floor(F.length("_body") / 200), F.substring(F.sha2(F.substring("_body", 1, 300), 256), 1, 16)))
    return df.withColumns({"_keys": keys, "_anchor": anchor}).drop("_company")


def exact_links(df: DataFrame, order: str, keys: str) -> DataFrame:
    """(a, b): each row linked with the first row that holds one of its keys. One row per key of a row; no pairs within a key."""
    held = df.select(F.col(order).alias("b"), F.explode(keys).alias("_k"))
    first = held.groupBy("_k").agg(F.min("b").alias("a"))
    return held.join(first, "_k").where("a <> b").select("a", "b").distinct()


def _classes(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (o, ...) that agree in ``by`` as one class: (first, last, by) of each, and the links (a, b) of its rows with the first."""
    classes = rows.groupBy(*by).agg(F.min("o").alias("first"), F.max("o").alias("last"))
    many = classes.where("first <> last")
    same = rows.join(many.select(*[F.col(c).alias(f"_{c}") for c in by], "first"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).where("o <> first").select(F.col("first").alias("a"), F.col("o").alias("b"))
    return classes, same


def _side(df: DataFrame, suffix: str, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(c + suffix) for c in df.columns if c not in keep])


def near_links(df: DataFrame, order: str) -> DataFrame:
    """(a, b): rows of one anchor block with nearly equal descriptions."""
    rows = df.where("_anchor is not null").select(F.col(order).alias("o"), F.col("_anchor").alias("key"), F.col("_body").alias("body"))
    classes, same = _classes(rows, ["key", "body"])
    # a class may come before another with one row and after it with another: each order counts where it occurs
    pairs = _side(classes, "_l", "key").join(_side(classes, "_r", "key"), "key").where("first_l < last_r and first_l <> first_r")
    short, long = F.least(F.length("body_l"), F.length("body_r")), F.greatest(F.length("body_l"), F.length("body_r"))
    close = pairs.where(short / long >= 0.95).where(_alike(SIMILAR)(F.col("body_l"), F.col("body_r")))
    return close.select(F.col("first_l").alias("a"), F.col("first_r").alias("b")).unionByName(same)


def similar_links(df: DataFrame, order: str) -> DataFrame:
    """(a, b): rows of one company, and of one place or both remote, with nearly equal titles and similar descriptions."""
    remote = F.coalesce("remote", F.lit(False))
    where = F.array(F.struct(F.concat(F.lit("p|"), "location_normalized").alias("w"), remote.alias("far")), F.when(remote, F.struct(F.lit("r").alias("w"), F.lit(False).alias("far"))))
    rows = df.where("company_normalized <> ''").select(F.col(order).alias("o"), "company_normalized", F.col("title_normalized").alias("title"), F.col("_body").alias("body"), F.explode(F.array_compact(where)).alias("_w"))
    rows = rows.select("o", F.concat_ws("|", "company_normalized", "_w.w").alias("key"), "_w.far", "title", "body")
    classes, same = _classes(rows, ["key", "far", "title", "body"])
    classes = materialize(classes, "similar")

    # titles first, each pair of a block's different ones once; no title pair of that ratio is further apart in edits
    titles = classes.select("key", "title").distinct()
    near = _side(titles, "_l", "key").join(_side(titles, "_r", "key"), "key")
    both = F.length("title_l") + F.length("title_r")
    near = near.where(F.least(F.length("title_l"), F.length("title_r")) * 2 >= TITLE_SIMILAR * both - 1e-6).where(F.levenshtein("title_l", "title_r") <= (1 - TITLE_SIMILAR) * both + 1e-6)
    near = near.where(_alike(TITLE_SIMILAR)(F.col("title_l"), F.col("title_r")))

    pairs = near.join(_side(classes, "_l", "key"), ["key", "title_l"]).join(_side(classes, "_r", "key"), ["key", "title_r"])
    # two remote rows meet in the block of remote ones, not in that of their place
    pairs = pairs.where("first_l < last_r and first_l <> first_r and not (far_l and far_r)")
    pairs = pairs.where(F.least(F.length("body_l"), F.length("body_r")) * 2 >= TEXT_SIMILAR * (F.length("body_l") + F.length("body_r")) - 1e-6)
    return pairs.where(_alike(TEXT_SIMILAR)(F.col("body_l"), F.col("body_r"))).select(F.col("first_l").alias("a"), F.col("first_r").alias("b")).unionByName(same)


def merge_groups(df: DataFrame, group: str, order: str, aggregators: list[str]) -> DataFrame:
    """One posting per group: the fields of the preferred row, sources and tags united, maps merged (later rows win), the longest description, flags or-ed."""
    best_url = F.coalesce(F.nullif(F.col("canonical_url"), F.lit("")), F.nullif(F.col("apply_url"), F.lit("")), F.col("url"))
    quality = F.when((F.col("ats") != "") & (best_url != ""), 4).otherwise(host_quality(best_url, aggregators))
    preference = F.struct(quality, F.col("remote").cast("int"), F.col("published_at"), -F.col(order))
    same = [c for c in df.columns if c not in {group, order, "sources", "tags", "source_urls", "source_job_ids", "description", "remote", "hybrid", "onsite"} and not c.startswith("_")]
    out = df.groupBy(group).agg(
        F.min(order).alias(order), F.max_by(F.struct(*same), preference).alias("_best"), F.max_by("description", F.struct(F.length("description"), preference)).alias("description"),
        F.bool_or("remote").alias("remote"), F.bool_or("hybrid").alias("hybrid"), F.count("*").alias("merged"),
    )
    # sets and maps are reduced to one row per group and entry first, so a large group is never one row
    for name in ("sources", "tags"):
        each = df.select(group, F.explode(name).alias("_e")).distinct().groupBy(group).agg(F.array_sort(F.collect_list("_e")).alias(name))
        out = out.join(each, group, "left").withColumn(name, F.coalesce(name, F.array()))
    for name in ("source_urls", "source_job_ids"):
        each = df.select(group, order, F.explode(name).alias("_k", "_e")).groupBy(group, "_k").agg(F.max_by("_e", order).alias("_e")).groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_e")))).alias(name))
        out = out.join(each, group, "left").withColumn(name, F.coalesce(name, F.create_map().cast("map<string,string>")))
    return out.select(group, order, "_best.*", "sources", "tags", "source_urls", "source_job_ids", "description", "remote", "hybrid", (~F.col("remote") & ~F.col("hybrid")).alias("onsite"), "merged")


def deduplicate(postings: DataFrame, order: str, aggregators: list[str] | None = None, near: bool = True) -> DataFrame:
    """Canonical postings, one per group of duplicates; ``order`` is a unique number of the rows, in the order they came."""
    keyed = materialize(with_keys(postings), "keyed")
    links = exact_links(keyed, order, "_keys")
    if near:
        links = links.unionByName(near_links(keyed, order)).unionByName(similar_links(keyed, order))
    groups = components(links, "a", "b").select("node", F.col("label").alias("group"))
    placed = keyed.drop("_keys", "_anchor", "_body").join(groups.withColumnRenamed("node", order), order, "left").withColumn("group", F.coalesce("group", order))
    return merge_groups(placed, "group", order, aggregators or [])


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; every column of the keys may be null."""
    w = W.Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
