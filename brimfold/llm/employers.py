"""Spellings of one employer linked: pigeonhole segment join on brands, verified with a banded edit distance.

Names are taken apart into brand words, line of business and legal form (``employer_names``). Which words name a line is
counted in the names themselves: a word that stands last behind MIN_BRANDS different brands or more. Of two such words, the
rarer one means the same line as the other if most brands it stands behind stand before the other as well. A lexicon of
lines adds translations and shortened words that are too rare to be counted. Equal parts make one
spelling, weighted by its rows. Brands of one line within EDITS edits are found without comparing all: a brand is cut
into EDITS + 1 segments, one of which must stand unchanged, at a place shifted by no more than the edits allow, in
any other brand that close; an inverted index of segments gives the candidates, ``levenshtein`` with a bound verifies
them. Two words count in either order, more also in the order of the alphabet. Names without a known line
that differ in the first letter of their last word alone are different words, not a typing error. Each spelling then joins the closest heavier one of compatible legal form, so
clusters are trees around the spelling most rows use, not chains of likenesses.

Spellings that lack a part (no line, an initial for the first word, the first half of the brand alone) join a cluster
only if exactly one fits: one with the same line and legal form where they are given.

Defined results: null, blank and placeholder names are no employer and have no row. Names with equal parts are one
employer; equal brands in different lines are not. Repeated rows add weight. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimfold.llm.employer_names import LINE_WORDS, brand_and_rest, near, parse
from brimfold.operators.components import components
from brimfold.plans.shared import bounded_rows, discard, materialize

EDITS = 2
#: Shortest brand in which two edits still mean the same name.
TWO_EDITS_FROM = 9
#: Shortest first half of a brand that is linked to the whole.
HALF_FROM = 5
ANY = "*"
#: A word names a line if it stands last behind so many brands, and in this share of the names that hold it.
MIN_BRANDS, MOSTLY = 5, 0.8
#: The rarer of two words means the same line if so many of its brands, and this share of them, stand before the other too.
BOTH, BOTH_SHARE = 3, 0.6
MAX_LINES = 20_000


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, n) to (word, brand): each word of a name of several words; brand is what stands before it if it is the last, else null."""
    for batch in batches:
        words, brands = [], []
        for name in batch.column(0).to_pylist():
            every, end = brand_and_rest(name)
            if len(every) > 1:
                words += every
                brands += [None] * (len(every) - 1) + [" ".join(every[:-1]) if end else None]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(brands, pa.string())], ["word", "brand"])


def own_lines(counted: DataFrame) -> dict[str, str]:
    """word -> line of the words that name a line of business in these names (name, n) and are not in the lexicon. As many as the trades have; more than MAX_LINES are refused."""
    held = materialize(counted.mapInArrow(_endings, "word string, brand string"), "endings")
    words = held.groupBy("word").agg(F.count("brand").alias("_last"), F.count("*").alias("_all"), F.countDistinct("brand").alias("brands"))
    lines = words.where((F.col("brands") >= MIN_BRANDS) & (F.col("_last") >= MOSTLY * F.col("_all"))).select("word", "brands")
    sizes = {r["word"]: r["brands"] for r in bounded_rows(lines, MAX_LINES, "list of lines of business")}
    new = {w for w in sizes if w not in LINE_WORDS and not any(len(x) > 5 and len(w) > 5 and near(w, x) for x in LINE_WORDS)}
    if not new:
        return {}
    behind = held.where("brand is not null").join(lines, "word").select("word", "brand").distinct()
    both = behind.join(behind.select(F.col("word").alias("other"), "brand"), "brand").where("word <> other").groupBy("word", "other").agg(F.count("*").alias("n"))
    out = {w: w for w in new}
    pairs = [(r["n"], r["word"], r["other"]) for r in bounded_rows(both.where(F.col("n") >= BOTH), 100 * MAX_LINES, "pairs of lines of business")]
    for n, word, other in sorted(pairs):
        if word in new and sizes[other] > sizes[word] and n >= BOTH_SHARE * sizes[word]:
            out[word] = LINE_WORDS.get(other, other)
    for word in out:  # a word that means another that means a third
        while out.get(out[word], out[word]) != out[word]:
            out[word] = out[out[word]]
    discard(held)
    return out


def _parts(own: dict[str, str]):
    """Iterator function: (name, n) to (name, n, words, line, legal) of the names that are an employer's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(v, own) for v in batch.column(0).to_pylist()]
            keep = [i for i, p in enumerate(found) if p]
            names = [found[i] for i in keep]
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([list(p.words) for p in names], pa.list_(pa.string())), pa.array([p.line for p in names], pa.string()), pa.array([p.legal for p in names], pa.string())], ["name", "n", "words", "line", "legal"])

    return run


def _hash(line: str, length: int, segment: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{line}|{length}|{segment}|{text}".encode()) - 2**63


def _cuts(length: int) -> list[tuple[int, int]]:
    """(start, length) of the EDITS + 1 segments of a string; the last ones are a letter longer where it doesn't divide."""
    k = EDITS + 1
    short, longer = divmod(length, k)
    out, at = [], 0
    for i in range(k):
        size = short + (i >= k - longer)
        out.append((at, size))
        at += size
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, line, key, last) to (node, key, last, h, role): the segments of each key as index entries (role i), and those it looks up (role p).

    A key looks up keys of its own length and up to EDITS less. A key without a line looks in those of every line.
    """
    for batch in batches:
        nodes, keys, lasts, hashes, roles = [], [], [], [], []
        for node, line, key, last in zip(*(c.to_pylist() for c in batch.columns)):
            own = [(line, "i"), (ANY, "i")] if line else [(ANY, "i")]
            n = len(key)
            made = set()
            for block, role in own:
                made |= {(_hash(block, n, i, key[s : s + size]), role) for i, (s, size) in enumerate(_cuts(n))}
            # a key without a line is the probe whatever the lengths, as those of a line don't look for it
            for m in range(max(EDITS + 1, n - EDITS), n + 1 + (0 if line else EDITS)):
                shift = n - m
                for i, (s, size) in enumerate(_cuts(m)):
                    low = max(0, s - i, s + shift - (EDITS - i))
                    high = min(n - size, s + i, s + shift + (EDITS - i))
                    made |= {(_hash(line or ANY, m, i, key[p : p + size]), "p") for p in range(low, high + 1)}
            for h, role in made:
                nodes.append(node)
                keys.append(key)
                lasts.append(last)
                hashes.append(h)
                roles.append(role)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.string()), pa.array(lasts, pa.int32()), pa.array(hashes, pa.int64()), pa.array(roles, pa.string())], ["node", "key", "last", "h", "role"])


def _fits(a: Column, b: Column) -> Column:
    return (a == b) | (a == "") | (b == "")


def close_brands(keys: DataFrame) -> DataFrame:
    """(a, b, d): nodes whose keys are within EDITS edits, d the least distance; one swap of neighbours counts as one edit. ``keys`` has node, line, key and last, the letters before its last word (0 where there is one word or a line beside it, -1 where the last word was put first)."""
    made = materialize(keys.where(F.length("key") > EDITS).select("node", "line", "key", "last").mapInArrow(_segments, "node bigint, key string, last int, h bigint, role string"), "segments")
    index = made.where("role = 'i'").select("h", F.col("node").alias("b"), F.col("key").alias("kb"), F.col("last").alias("lb"))
    probe = made.where("role = 'p'").select("h", F.col("node").alias("a"), F.col("key").alias("ka"), F.col("last").alias("la"))
    # they differ in one letter, and it is the first of the last word, wherever that word stands in either key
    only_at = lambda k: f"left(ka, {k}) = left(kb, {k}) and substring(ka, {k} + 1, 1) <> substring(kb, {k} + 1, 1) and substring(ka, {k} + 2) = substring(kb, {k} + 2)"
    other_word = F.expr(f"length(ka) = length(kb) and ((la > 0 and {only_at('la')}) or (lb > 0 and {only_at('lb')}) or (least(la, lb) < 0 and {only_at('0')}))")
    # verified where they meet, so that only close pairs are shuffled; a pair met in several segments is reduced after that
    pairs = probe.join(index, "h").where("a <> b").where(~other_word).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"))
    d = F.levenshtein("ka", "kb", EDITS)
    letters = lambda c: F.array_sort(F.split(c, ""))
    swapped = (F.length("ka") == F.length("kb")) & (letters("ka") == letters("kb"))
    shortest = F.least(F.length("ka"), F.length("kb"))
    scored = pairs.withColumn("d", d).where("d >= 0").withColumn("d", F.when((F.col("d") == 2) & swapped, 1).otherwise(F.col("d")))
    return scored.where((F.col("d") <= 1) | (shortest >= TWO_EDITS_FROM)).groupBy("a", "b").agg(F.min("d").alias("d"))


def _single(matches: DataFrame) -> DataFrame:
    """(lone, cluster) of those that match exactly one cluster."""
    return matches.groupBy("lone").agg(F.min("cluster").alias("cluster"), F.max("cluster").alias("_other")).where(F.col("cluster") == F.col("_other")).select("lone", "cluster")


def employers(names: DataFrame, name: str) -> DataFrame:
    """(name, employer, linked_by): one row per distinct spelling, as stored; ``employer`` is the spelling of its cluster that most rows use.

    ``linked_by`` tells how a spelling came to its cluster: ``parts`` (equal parts, or it is alone or the heaviest), ``segments`` (edits,
    by the segment join), ``line`` (a missing line of business), ``initial`` or ``half`` (a shortened brand).
    """
    counted = names.select(F.col(name).cast("string").alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n"))
    counted = materialize(counted, "counted")
    parsed = materialize(counted.mapInArrow(_parts(own_lines(counted)), "name string, n bigint, words array<string>, line string, legal string"), "names")
    node = F.xxhash64(F.array_join("words", " "), "line", "legal").alias("node")
    nodes = parsed.groupBy("words", "line", "legal").agg(F.sum("n").alias("w"), F.max(F.struct("n", "name")).alias("_top"))
    nodes = materialize(nodes.select(node, "words", "line", "legal", "w", F.col("_top.name").alias("top")), "nodes")

    initial = F.exists("words", lambda w: w.endswith("."))
    key = lambda words: F.struct(F.concat_ws("", words).alias("key"), F.when(F.size(words) > 1, F.length(F.concat_ws("", words)) - F.length(F.element_at(words, -1))).otherwise(0).cast("int").alias("last"))
    orders = F.when(F.size("words") == 2, F.array(key(F.col("words")), key(F.reverse("words")).withField("last", F.lit(-1)))).when(F.size("words") > 2, F.array_distinct(F.array(key(F.col("words")), key(F.array_sort("words"))))).otherwise(F.array(key(F.col("words"))))
    keys = nodes.where(~initial).select("node", "line", F.explode(orders).alias("_k")).select("node", "line", "_k.key", F.when(F.col("line") == "", F.col("_k.last")).otherwise(0).alias("last"))
    close = materialize(close_brands(keys), "close")

    # each spelling joins the closest heavier one of its line
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("line").alias(f"line_{x}"), F.col("legal").alias(f"legal_{x}"), F.col("w").alias(f"w_{x}"))
    both = materialize(close.join(of("a"), "a").join(of("b"), "b").where(_fits(F.col("legal_a"), F.col("legal_b"))), "both")
    same = both.where("line_a = line_b")
    up = same.select("d", *[F.when(F.struct("w_a", "a") < F.struct("w_b", "b"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("a", "b", "child"), ("b", "a", "parent"), ("w_b", "w_a", "w"))])
    edges = materialize(up.groupBy("child").agg(F.min_by("parent", F.struct("d", -F.col("w"), "parent")).alias("parent")), "edges")
    labels = components(edges, "child", "parent")
    clustered = materialize(nodes.join(labels, "node", "left").withColumn("cluster", F.coalesce("label", "node")).drop("label"), "clustered")

    # what a cluster lacks is told by its heaviest spelling
    heads = clustered.groupBy("cluster").agg(F.max_by(F.struct("words", "line"), F.struct("w", "node")).alias("_h"), F.max("legal").alias("legal"), F.sum("w").alias("w")).select("cluster", "_h.*", "legal", "w")
    heads = materialize(heads.withColumn("lacks", F.when(F.exists("words", lambda x: x.endswith(".")), "word").when(F.col("line") == "", "line").otherwise("")), "heads")
    whole = heads.where("lacks = ''")

    ends = lambda x, y: both.where("(line_a = '') <> (line_b = '')").select(F.col(x).alias("p"), F.col(y).alias("q"), F.col(f"line_{x}").alias("_l"), "d").where("_l = ''")
    cluster_of = clustered.select("node", "cluster", "legal")
    unlined = ends("a", "b").unionByName(ends("b", "a")).join(cluster_of.select(F.col("node").alias("p"), F.col("cluster").alias("lone")), "p").join(cluster_of.select(F.col("node").alias("q"), "cluster"), "q")
    unlined = unlined.join(heads.where("lacks = 'line'").select(F.col("cluster").alias("lone"), F.col("legal").alias("_g")), "lone").join(whole.select("cluster", "legal"), "cluster").where(_fits(F.col("_g"), F.col("legal")))
    nearest = materialize(unlined.groupBy("lone", "cluster").agg(F.min("d").alias("d")), "nearest")
    least = nearest.groupBy("lone").agg(F.min("d").alias("d"))
    by_line = materialize(_single(nearest.join(least, ["lone", "d"])), "line")

    members = clustered.join(whole.select("cluster", F.col("legal").alias("_legal"), F.col("w").alias("_w")), "cluster").select("cluster", "words", "line", F.col("_legal").alias("legal"), F.col("_w").alias("w"))
    # halves of brands: the first of two words, or the beginning of a single one
    firsts = members.where("size(words) = 2").select("cluster", F.col("words")[0].alias("half"), "line", "legal", "w")
    cut = F.transform(F.sequence(F.lit(HALF_FROM), F.length("key") - 3), lambda k: F.substring("key", F.lit(1), k))
    begins = members.where("size(words) = 1").withColumn("key", F.col("words")[0]).where(F.length("key") >= HALF_FROM + 3).select("cluster", F.explode(cut).alias("half"), "line", "legal", "w")
    halves = materialize(firsts.unionByName(begins).distinct(), "halves")
    ones = heads.where("size(words) = 1 and lacks <> 'word'").select(F.col("cluster").alias("lone"), F.col("words")[0].alias("half"), F.col("line").alias("_l"), F.col("legal").alias("_g"), F.col("w").alias("_w")).where(F.length("half") >= HALF_FROM)
    by_half = materialize(_single(ones.join(nearest.select("lone"), "lone", "left_anti").join(halves, "half").where(_fits(F.col("_l"), F.col("line")) & _fits(F.col("_g"), F.col("legal")) & (F.col("lone") != F.col("cluster")) & (F.col("_w") < F.col("w"))).select("lone", "cluster")), "half")

    # an initial: of one of two words, of the whole brand set before it, or of the line
    dotted = heads.where("lacks = 'word' and size(words) > 1").select(F.col("cluster").alias("lone"), F.col("words")[0].substr(1, 1).alias("first"), F.concat_ws("", F.slice("words", 2, F.size("words"))).alias("rest"), F.col("line").alias("_l"), F.col("legal").alias("_g"))
    two = members.where("size(words) = 2")
    heads_of = lambda f, rest: two.select("cluster", f.alias("_f"), rest.alias("rest"), "line", "legal")
    full = heads_of(F.col("words")[0], F.col("words")[1]).unionByName(heads_of(F.col("words")[1], F.col("words")[0])).unionByName(heads_of(F.col("line"), F.col("words")[1]))
    brand = members.select("cluster", F.concat_ws("", "words").alias("rest"), "line", "legal").unionByName(halves.select("cluster", F.col("half").alias("rest"), "line", "legal"))
    led = full.unionByName(brand.withColumn("_f", F.col("rest"))).unionByName(brand.withColumn("_f", F.col("line"))).withColumn("first", F.substring("_f", 1, 1)).drop("_f").distinct()
    by_initial = materialize(_single(dotted.join(led, ["first", "rest"]).where(_fits(F.col("_l"), F.col("line")) & _fits(F.col("_g"), F.col("legal"))).select("lone", "cluster")), "initial")

    # what was joined may be what others belong to, so the links form components
    more = materialize(by_line.withColumn("kind", F.lit("line")).unionByName(by_initial.withColumn("kind", F.lit("initial"))).unionByName(by_half.withColumn("kind", F.lit("half"))), "more")
    final = components(more, "lone", "cluster").select(F.col("node").alias("cluster"), F.col("label").alias("final"))
    kinds = more.groupBy(F.col("lone").alias("cluster")).agg(F.min("kind").alias("kind"))
    placed = clustered.join(final, "cluster", "left").join(kinds, "cluster", "left").join(edges.select(F.col("child").alias("node"), F.lit("segments").alias("_by")), "node", "left")
    placed = placed.select("words", "line", "legal", "w", "top", F.coalesce("final", "cluster").alias("_c"), F.coalesce("kind", "_by", F.lit("parts")).alias("linked_by"))
    tops = placed.groupBy("_c").agg(F.max_by("top", F.struct("w", "top")).alias("employer"))
    return parsed.select("name", "words", "line", "legal").join(placed.select("words", "line", "legal", "_c", "linked_by"), ["words", "line", "legal"]).join(tops, "_c").select("name", "employer", "linked_by")


def spelling_pairs(found: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b in byte order: every two spellings of one employer."""
    a, b = found.select("employer", F.col("name").alias("name_a")), found.select("employer", F.col("name").alias("name_b"))
    return a.join(b, "employer").where("name_a < name_b").select("name_a", "name_b")
