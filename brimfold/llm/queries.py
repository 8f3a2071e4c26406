"""Queries of the operators in this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brimfold.functions.text import ENTITIES
from brimfold.llm.employers import employers, spelling_pairs
from brimfold.llm.eval_leaks import eval_leaks
from brimfold.llm.mixing import mix
from brimfold.llm.near_duplicates import NearDuplicates, all_pairs, classes, near_duplicates
from brimfold.llm.places import map_places, place_entries
from brimfold.llm.shared_spans import shared_chars, shared_spans
from brimfold.sources.tables import table

POSTING = ["title", "company_name", "description"]


def _postings(spark: SparkSession, folder: str) -> NearDuplicates:
    return near_duplicates(table(spark, folder, "remotive", "id", "fetched_at", *POSTING), "id", POSTING, "description", "fetched_at", n=3, threshold=0.6)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return all_pairs(_postings(spark, folder))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per posting with its class, the least id of the postings linked with it."""
    return classes(_postings(spark, folder))


def _places(spark: SparkSession, folder: str, skip_exact: bool) -> DataFrame:
    entries = place_entries(table(spark, folder, "places"))
    parts = []
    for feed, key, value in (("remotive", "id", "candidate_required_location"), ("arbeitnow", "slug", "location")):
        part = map_places(table(spark, folder, feed, key, value, "fetched_at"), key, value, "fetched_at", entries, skip_exact)
        parts.append(part.select(F.lit(feed).alias("feed"), "row_key", "place_id"))
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _places(spark, folder, True)


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Postings per feed and place, all values included; place 0 counts the unmatched."""
    return _places(spark, folder, False).groupBy("feed", "place_id").agg(F.count("*").alias("postings"))


def _employers(spark: SparkSession, folder: str) -> DataFrame:
    return employers(table(spark, folder, "remotive", "company_name").unionByName(table(spark, folder, "arbeitnow", "company_name")), "company_name")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_pairs(_employers(spark, folder))


def p5_employers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per spelling with the employer it means."""
    return _employers(spark, folder)


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return eval_leaks(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", table(spark, folder, "eval_items", "item_id", "text"), "item_id", "text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).where("verbatim_windows > 0").select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Verbatim and re-parameterised leaks, with the number of windows of each."""
    return _leaks(spark, folder)


#: The vocabulary used where the setting ``spark.brimfold.tokenizer`` names none.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    tokenizer = spark.conf.get("spark.brimfold.tokenizer", TOKENIZER)
    return mix(table(spark, folder, "documents", "doc_id", "source", "text"), "doc_id", "source", "text", table(spark, folder, "mix_targets"), tokenizer)


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Each use of a document in each mix, in the order of its slots."""
    return _mix(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source in each mix."""
    return _mix(spark, folder)[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_chars(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text").select(F.col("id").alias("doc_id"), "shared_chars")


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Each stretch that stands as a whole in another document, and how much of its own document is shared."""
    found = shared_spans(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "start", "length", (F.col("shared_chars") / F.col("n_chars")).alias("shared_part"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_classes": p1_classes, "p3_found": p3_found, "p3_counts": p3_counts, "p5_found": p5_found, "p5_employers": p5_employers, "p6_found": p6_found, "p6_leaks": p6_leaks, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_spans": p8_spans}

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _bare(x: str) -> str:
    """SQL: a text without tags, the entities of the feeds resolved."""
    out = f"regexp_replace(coalesce({x}, ''), '<[^>]*>', ' ', 'g')"
    for entity, character in ENTITIES.items():
        out = f"replace({out}, '{entity}', '{character.replace(chr(39), chr(39) * 2)}')"
    return out


_SIMILAR = f"""WITH RECURSIVE w AS (SELECT DISTINCT id, {_WORDS.format(_bare('title'))} || {_WORDS.format(_bare('company_name'))} || {_WORDS.format(_bare('description'))} AS w FROM remotive WHERE len({_WORDS.format(_bare('description'))}) > 0),
        s AS (SELECT DISTINCT id, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS k FROM w)), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
        p AS (SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.6 * (x.n + y.n - c))"""

SQL: dict[str, str] = {
    "p1_found": _SIMILAR + "SELECT id_a, id_b FROM p",
    "p1_classes": _SIMILAR + """, e AS (SELECT id_a AS a, id_b AS b FROM p UNION ALL SELECT id_b, id_a FROM p),
        g AS (SELECT id, id AS c FROM n UNION SELECT e.b, g.c FROM g JOIN e ON e.a = g.id AND g.c < e.b)
        SELECT id, min(c) AS class_id FROM g GROUP BY 1""",
    "p6_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format(_bare('text'))} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format(_bare('text'))} AS w FROM eval_items), m AS (SELECT item_id, w, least(12, len(w)) AS n FROM i WHERE len(w) > 0),
        iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM m)),
        dw AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM m)))
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (n, s)""",
    "p8_found": """WITH w AS (SELECT doc_id, k, md5(text[k:k + 399]) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS k FROM documents WHERE length(text) >= 400)),
        r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), p AS (SELECT DISTINCT doc_id, k FROM w SEMI JOIN r USING (h)), g AS (SELECT doc_id, least(400, lead(k, 1, k + 400) OVER (PARTITION BY doc_id ORDER BY k) - k) AS n FROM p)
        SELECT doc_id, sum(n)::bigint AS shared_chars FROM g GROUP BY 1""",
}
