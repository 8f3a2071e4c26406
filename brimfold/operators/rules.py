"""Rules that are data: ladders, reasons, best-scoring families, aliases in sentences, sections that carry over.

Rule lists are parameters and become literals of the plan, so each row is judged in one codegen stage without a join.
Ties go to the earlier rule, sentence or row, as every key carries a position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from brimfold.functions.text import contains_any, has_alias, normalize_plain, sentences


def first_match(text: Column, ladder: list[tuple[str, str]], otherwise: str) -> Column:
    """struct(level, evidence): the first pattern of the ladder found in ``text``, and what it matched."""
    out = None
    for name, pattern in ladder:
        hit = F.struct(F.lit(name).alias("level"), F.regexp_extract(text, pattern, 0).alias("evidence"))
        out = F.when(text.rlike(pattern), hit) if out is None else out.when(text.rlike(pattern), hit)
    none = F.struct(F.lit(otherwise).alias("level"), F.lit("").alias("evidence"))
    return none if out is None else out.otherwise(none)


def reasons(rules: list[tuple[Column, Column]]) -> Column:
    """Array of the reasons whose condition holds, in the order of the rules; a null condition doesn't hold."""
    return F.filter(F.array(*[F.when(c, r) for c, r in rules]), lambda r: r.isNotNull())


def accepted(text: Column, accept: list[str], veto: list[str]) -> Column:
    """Some accepted term and no vetoed one."""
    return contains_any(text, accept) & ~contains_any(text, veto)


def best_family(title: Column, body: Column, families: list[tuple[str, list[str], list[str]]], otherwise: str) -> Column:
    """struct(id, score): the family with the most hits, min(12, 6 per title term) + min(4, 1 per body term); ties go to the earlier one."""
    hits = lambda text, terms: sum((F.coalesce(F.contains(text, F.lit(t)), F.lit(False)).cast("int") for t in terms), F.lit(0))
    scored = [F.struct((F.least(F.lit(12), 6 * hits(title, t)) + F.least(F.lit(4), hits(body, b))).alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("id")) for k, (name, t, b) in enumerate(families)]
    best = F.array_max(F.array(*scored)) if scored else F.struct(F.lit(0).alias("score"), F.lit(otherwise).alias("id"))
    return F.struct(F.when(best["score"] > 0, best["id"]).otherwise(otherwise).alias("id"), F.greatest(best["score"], F.lit(0)).alias("score"))


def alias_hits(text: Column, aliases: dict[str, list[str]]) -> Column:
    """Sorted array of the names that have an alias in normalised ``text``."""
    found = []
    for name in sorted(aliases):
        test = F.lit(False)
        for alias in aliases[name]:
            test = test | has_alias(text, alias)
        found.append(F.when(test, F.lit(name)))
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def sentence_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, sentence): the sentences of each text in order."""
    return df.select(F.col(key), F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))


def carried_sections(rows: DataFrame, key: str, on: list[str], off: list[str], longest: int = 80) -> DataFrame:
    """Adds ``optional``: whether the last heading up to this sentence is one of ``on`` rather than of ``off``.

    A heading is a sentence of at most ``longest`` characters that is one of the terms or begins with it and a blank.
    """
    head = F.regexp_replace(normalize_plain(F.col("sentence")), r"^[ :\-]+|[ :\-]+$", "")
    is_one = lambda terms: (F.length(head) <= longest) & head.rlike(rf"^(?:{'|'.join(terms)})(?: |$)")
    flag = F.when(is_one(on), True).when(is_one(off), False)
    w = W.Window.partitionBy(key).orderBy("pos").rowsBetween(W.Window.unboundedPreceding, 0)
    return rows.withColumn("_flag", flag).withColumn("optional", F.coalesce(F.last("_flag", ignorenulls=True).over(w), F.lit(False))).drop("_flag")


def strongest_mentions(rows: DataFrame, key: str, aliases: dict[str, list[str]], optional: list[str], mandatory: list[str]) -> DataFrame:
    """(key, name, requirement, evidence, mentions, only_optional): for each name found in a text its strongest mention, earlier ones first.

    ``rows`` has key, pos, sentence, optional. Strength: mandatory, then optional, then mentioned.
    """
    text = normalize_plain(F.col("sentence"))
    rows = rows.withColumn("_text", text)
    is_optional = F.col("optional") | contains_any(F.col("_text"), optional)
    strength = F.when(is_optional, 2).when(contains_any(F.col("_text"), mandatory), 3).otherwise(1)
    hits = rows.select(key, "pos", F.substring("sentence", 1, 260).alias("evidence"), strength.alias("_s"), is_optional.alias("_o"), F.explode(alias_hits(F.col("_text"), aliases)).alias("name"))
    best = hits.groupBy(key, "name").agg(F.max_by(F.struct("_s", "evidence"), F.struct("_s", -F.col("pos"))).alias("_b"), F.count("*").alias("mentions"), F.bool_and("_o").alias("only_optional"))
    named = F.element_at(F.array(F.lit("mentioned"), F.lit("optional"), F.lit("mandatory")), F.col("_b._s"))
    return best.select(key, "name", named.alias("requirement"), F.col("_b.evidence").alias("evidence"), "mentions", "only_optional")


def capped(caps: list[tuple[Column, int, str]], top: int = 100) -> Column:
    """struct<cap, why>: the least cap whose condition holds (``top`` without one) and the reasons that set it, in order, joined by commas."""
    held = F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("cap"), F.lit(why).alias("why"))) for c, n, why in caps]), lambda x: x.isNotNull())
    least = F.coalesce(F.array_min(F.transform(held, lambda x: x["cap"])), F.lit(top))
    return F.struct(least.alias("cap"), F.array_join(F.transform(F.filter(held, lambda x: x["cap"] == least), lambda x: x["why"]), ",").alias("why"))
