"""Text and posting operators over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brimfold.functions import keys, text, urls
from brimfold.operators import dedup, postings, rules, summaries
from brimfold.plans.shared import new_path
from brimfold.sources import feeds, providers
from brimfold.sources.tables import table

# Rule lists of these queries: examples of the kinds of lists the operators take.
ACCEPT = ["engineer", "developer", "analyst", "operator", "architect"]
VETO = ["senior", "lead", "working student"]
LADDER = [("lead", r"\b(?:lead|principal|head)\b"), ("senior", r"\b(?:senior|sr)\b"), ("student", r"\b(?:working student|intern)\b"), ("junior", r"\b(?:junior|graduate|associate)\b")]
FAMILIES = [("data", ["data", "database", "analyst"], ["data warehouse", "schema design", "query tuning"]), ("security", ["security", "compliance", "penetration"], ["audit trail", "incident handling", "key management"]), ("web", ["frontend", "backend", "mobile"], ["checkout page", "booking flow", "mobile client"])]
ALIASES = {"api design": ["interface design", "schema design"], "operations": ["incident handling", "capacity planning", "kapazitätsplanung"], "scripting": ["typed scripting", "skriptsprachen"], "testing": ["load testing", "contract testing", "lasttests", "abnahmetests"], "audit": ["audit trail", "static analysis"]}
OPTIONAL = ["nice to have", "is welcome", "von vorteil"]
MANDATORY = ["is required", "we expect", "wir erwarten", "you bring", "sie bringen"]
ON, OFF = ["nice to have", "von vorteil"], ["you will", "we expect", "wir erwarten", "fluent english", "in return"]
GERMAN = [" und ", " oder ", " wir ", " sie ", " mit ", " die ", " der ", " unsere ", " für ", " zu "]


# --- SQL of the expressions the queries share ---------------------------------------------------------------------
def _bare(x: str) -> str:
    low = f"replace(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '&', ' and ')"
    return rf"trim(regexp_replace(regexp_replace({low}, '[^a-z0-9äöüß+/#. -]+', ' ', 'g'), '\s+', ' ', 'g'), ' ')"


def _norm(x: str) -> str:
    return _bare(f"CASE WHEN regexp_matches({x}, '[<&]') THEN {_plain(x)} ELSE {x} END")


def _title(x: str) -> str:
    bare = rf"regexp_replace({_norm(x)}, '\b(?:{'|'.join(text.GENDER_MARKS)})\b', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({bare}, '\s+', ' ', 'g'), '^[ \-/]+|[ \-/]+$', '', 'g')"


def _company(x: str) -> str:
    # RE2's word boundary knows ASCII letters only, so umlauts stand aside as letters while it runs
    into, back = _norm(x), None
    for a, b in (("ä", "0zz1"), ("ö", "0zz2"), ("ü", "0zz3")):
        into = f"replace({into}, '{a}', '{b}')"
    back = rf"regexp_replace({into}, '\b(?:{'|'.join(text.LEGAL_FORMS)})\b\.?', ' ', 'g')"
    for a, b in (("ä", "0zz1"), ("ö", "0zz2"), ("ü", "0zz3")):
        back = f"replace({back}, '{b}', '{a}')"
    return rf"trim(regexp_replace({back}, '\s+', ' ', 'g'), ' ')"


def _fingerprint(c: str, t: str, p: str) -> str:
    return f"concat_ws('|', {_company(c)}, {_title(t)}, replace({_norm(p)}, 'deutschland', 'germany'))"


def _plain(x: str) -> str:
    out = f"regexp_replace(coalesce({x}, ''), '(?s)<!--.*?-->', '', 'g')"
    out = rf"regexp_replace({out}, '(?i)</?(?:{'|'.join(text.BLOCK_TAGS)})\b[^>]*>', chr(10), 'g')"
    out = f"regexp_replace({out}, '</?[a-zA-Z][^>]*>', '', 'g')"
    for entity, character in text.ENTITIES.items():
        out = f"replace({out}, '{entity}', '{character.replace(chr(39), chr(39) * 2)}')"
    out = rf"regexp_replace(replace({out}, chr(160), ' '), '[ \t]+', ' ', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '\n[ \t]+', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({out}, '^\s+|\s+$', '', 'g')"


def _parts(x: str) -> str:
    marked = rf"regexp_replace(coalesce({x}, ''), '([.!?])\s+', '\1' || chr(1), 'g')"
    return rf"list_filter([regexp_replace(s, '^\s+|\s+$', '', 'g') for s in regexp_split_to_array({marked}, '\x01|;\s+|[\r\n]+|[•●▪]')], lambda s: s <> '')"


def _has(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")" if terms else "false"


def _hits(x: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({x}, '{t}')::int" for t in terms) + ")"


# --- queries -------------------------------------------------------------------------------------------------------
def q01_top_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "arbeitnow", "slug", "title", "company_name", "fetched_at")
    rows = rows.where(rules.accepted(text.normalize_text(F.col("title")), ACCEPT, VETO))
    once = dedup.first_per_key(rows, ["slug"], [F.col("fetched_at").desc_nulls_last(), F.col("title"), F.col("company_name")])
    order = [F.col("fetched_at").desc_nulls_last(), F.col("slug")]
    return summaries.report_queue(once, F.col("company_name").isNotNull(), order, 50).select("report_number", "slug", text.normalize_title(F.col("title")).alias("title"))


def q02_normalized_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("text_md5"))


def q03_visible_text(spark: SparkSession, d: str) -> DataFrame:
    plain = text.markup_to_text(F.col("description"))
    return table(spark, d, "remotive", "id", "description").withColumn("t", plain).select("id", F.length("t").alias("chars"), F.md5("t").alias("text_md5"))


def q04_canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "arbeitnow", "slug", "url").withColumn("u", urls.canonical_url(F.col("url")))
    return rows.select("slug", F.col("u").alias("canonical"), urls.url_host(F.col("u")).alias("host"), urls.host_quality(F.col("u"), ["www.arbeitnow.example"]).alias("quality"))


def q05_posting_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "arbeitnow", "slug", "company_name", "title", "location", "description", "salary")
    return rows.select("slug", keys.posting_key(F.col("company_name"), F.col("title"), F.col("location")).alias("job_key"), keys.digest(*[F.col(c) for c in ("title", "company_name", "location", "description", "salary")]).alias("content_hash"))


def q06_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = rules.sentence_rows(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"), F.max(F.length("sentence")).alias("longest"))


def q07_german_markers(spark: SparkSession, d: str) -> DataFrame:
    low = F.concat(F.lit(" "), text.normalize_text(F.col("text")), F.lit(" "))
    rows = table(spark, d, "documents", "doc_id", "lang", "text").withColumn("t", low)
    hits = sum((text.count_of(F.col("t"), m) for m in GERMAN), F.lit(0))
    rows = rows.select(F.coalesce(F.lower("lang"), F.lit("")).alias("lang"), ((F.length("t") >= 300) & (hits >= 9)).alias("german"))
    return rows.groupBy("lang", "german").agg(F.count("*").alias("documents"))


def q08_rejection_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "arbeitnow", "slug", "title", "company_name", "description", "job_types")
    title = text.normalize_text(F.col("title"))
    types = text.normalize_text(F.concat_ws(" ", "job_types"))
    why = rules.reasons([(text.contains_any(title, VETO), F.lit("title")), (text.contains_any(types, ["intern"]), F.lit("employment type")), (text.truthy(F.col("company_name")).isNull(), F.lit("no company")), (F.length(F.coalesce("description", F.lit(""))) < 200, F.lit("short description"))])
    return summaries.count_reasons(rows.select("slug", why.alias("why")), "why", "slug").withColumnRenamed("reason", "why")


def q09_title_ladder(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "remotive", "id", "title").withColumn("t", text.normalize_text(F.col("title")))
    return rows.select("id", rules.first_match(F.col("t"), LADDER, "other").alias("m")).select("id", "m.level", "m.evidence")


def q10_best_family(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "remotive", "id", "title", "description").select("id", text.normalize_text(F.col("title")).alias("t"), text.normalize_plain(text.markup_to_text(F.col("description"))).alias("b"))
    return rows.select("id", rules.best_family(F.col("t"), F.col("b"), FAMILIES, "other").alias("f")).select("id", F.col("f.id").alias("family"), F.col("f.score").cast("int").alias("score"))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return rules.carried_sections(rules.sentence_rows(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text"), "doc_id", ON, OFF)


def q11_strongest_mentions(spark: SparkSession, d: str) -> DataFrame:
    return rules.strongest_mentions(_sections(spark, d), "doc_id", ALIASES, OPTIONAL, MANDATORY).select("doc_id", F.col("name").alias("skill"), "requirement", F.md5("evidence").alias("evidence_md5"), "mentions", "only_optional")


def q12_carried_sections(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("optional").alias("in_optional"))


def q13_exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "arbeitnow", "slug", "company_name", "title", "location")
    rows = rows.withColumn("k", keys.fingerprint(F.col("company_name"), F.col("title"), F.col("location")))
    return dedup.first_per_key(rows, ["k"], [F.col("slug")]).select("slug", F.sha2("k", 256).alias("fingerprint"))


def _remotive_postings(spark: SparkSession, d: str) -> DataFrame:
    """Canonical postings of every row of remotive, dated by its delivery."""
    rows = table(spark, d, "remotive", "id", "title", "company_name", "candidate_required_location", "description", "tags", "fetched_at")
    raw = rows.select(F.lit("remotive").alias("source"), F.col("id").cast("string").alias("source_job_id"), F.col("company_name").alias("company"), "title", F.col("candidate_required_location").alias("location"), F.lit(True).alias("remote"), F.lit("").alias("url"), F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), "description", "tags", F.col("id").alias("_ord"))
    return postings.normalise_postings(raw, exact_html=False)


def q14_anchor_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks in which descriptions are compared."""
    keyed = dedup.with_keys(_remotive_postings(spark, d)).where("_anchor is not null")
    return keyed.groupBy(F.col("_anchor").alias("anchor")).agg(F.count("*").alias("n"), F.countDistinct("_ord").alias("ids"))


def q15_merged_postings(spark: SparkSession, d: str) -> DataFrame:
    """One posting for each company, title and place of remotive, merged from all its rows."""
    merged = dedup.merge_groups(_remotive_postings(spark, d), "job_key", "_ord", [])
    return merged.select("job_key", F.col("_ord").alias("first"), F.col("source_job_id").alias("best"), F.md5("description").alias("description_md5"), F.array_join("tags", ",").alias("tags"), F.array_join("sources", ",").alias("sources"), F.element_at("source_job_ids", "remotive").alias("last_id"), "remote", "merged")


def q35_year_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = rules.sentence_rows(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    rows = rows.select("doc_id", "pos", F.explode(text.year_ranges(F.col("sentence"))).alias("y")).select("doc_id", "pos", "y.low", "y.high").where("low <= 20 and coalesce(high, 0) <= 30")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("low").alias("most"), F.max_by("pos", F.struct("low", -F.col("pos"))).alias("at"))


def _arbeitnow(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "arbeitnow", "slug", "company_name", "title", "description", "remote", "url", "tags", "job_types", "location", "created_at", "salary")


def q41_epoch_projection(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every row's time: epoch numbers of any writing to ISO texts, texts kept, nulls empty."""
    return providers.arbeitnow_rows(_arbeitnow(spark, d)).select(F.col("source_job_id").alias("slug"), "published_at")


def q49_arbeitnow_projection(spark: SparkSession, d: str) -> DataFrame:
    """The projection over every row: epoch numbers of any writing, texts, nulls."""
    return providers.arbeitnow_rows(_arbeitnow(spark, d)).select(F.col("source_job_id").alias("slug"), "company", "title", "remote", "url", "published_at", F.md5("description").alias("description_md5"), "salary", "employment_type", "location", F.array_join("tags", ",").alias("tags"))


def _lever(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lever", "site", "id", "text", "categories", "descriptionPlain", "lists", "additionalPlain", "hostedUrl", "applyUrl", "workplaceType", "createdAt").withColumnRenamed("site", "employer")


def q42_nested_projection(spark: SparkSession, d: str) -> DataFrame:
    """Every row of lever as a raw posting."""
    return providers.lever_rows(_lever(spark, d)).select(F.col("company").alias("site"), F.col("source_job_id").alias("id"), "title", "location", "remote", "hybrid", "url", "apply_url", F.md5("description").alias("text_md5"), "employment_type", F.array_join("tags", ",").alias("tags"))


def q43_union_sources(spark: SparkSession, d: str) -> DataFrame:
    """All feeds as raw postings in their order: counts of each source, and whether the numbers of its rows are unique and in its range."""
    rows = providers.union_sources([providers.remotive_rows(_remotive(spark, d)), providers.arbeitnow_rows(_arbeitnow(spark, d)), providers.lever_rows(_lever(spark, d))])
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("source_job_id").alias("postings"), F.count_if(text.truthy(F.col("title")).isNull()).alias("untitled"), F.countDistinct("_ord").alias("numbers"), F.max(F.shiftright("_ord", 52)).alias("place"))


def q62_remotive_projection(spark: SparkSession, d: str) -> DataFrame:
    """Every row of remotive as a raw posting."""
    return providers.remotive_rows(_remotive(spark, d)).select("source_job_id", "company", "title", "location", "url", "published_at", F.md5("description").alias("description_md5"), "salary", "employment_type", F.array_join("tags", ",").alias("tags"))


def q63_short_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an alias: short ones as words of their own, others anywhere."""
    t = table(spark, d, "documents", "doc_id", "text").withColumn("t", text.normalize_plain(F.col("text")))
    return t.select("doc_id", *[text.has_alias(F.col("t"), a).alias(n) for n, a in (("as_word", "it"), ("as_word_too", "api"), ("anywhere", "team"))])


def q44_html_parser(spark: SparkSession, d: str) -> DataFrame:
    """The exact HTML reading, in Arrow batches."""
    return table(spark, d, "remotive", "id", "description").withColumn("t", text.html_to_text(F.coalesce("description", F.lit("")))).select("id", F.length("t").alias("chars"), F.md5("t").alias("text_md5"))


def q45_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Canonical postings of remotive, one per group of duplicates."""
    rows = table(spark, d, "remotive", "id", "url", "title", "company_name", "candidate_required_location", "salary", "description", "job_type", "tags", "publication_date", "fetched_at")
    once = dedup.first_per_key(rows, ["id"], [F.col("fetched_at"), F.col("title")])
    raw = once.select(F.lit("remotive").alias("source"), F.col("id").cast("string").alias("source_job_id"), F.col("company_name").alias("company"), "title", F.col("candidate_required_location").alias("location"), F.lit(True).alias("remote"), "url", F.col("publication_date").alias("published_at"), "description", "salary", F.col("job_type").alias("employment_type"), "tags", F.col("id").alias("_ord"))
    done = dedup.deduplicate(postings.normalise_postings(raw, exact_html=False), "_ord", ["remotive.example"])
    return done.select("job_key", "source_job_id", "company_normalized", "title_normalized", "published_at", "content_hash", F.array_join("tags", ",").alias("tags"), "merged")


def q64_exact_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of postings linked by exact keys alone: source id, fingerprint, hash of a long description."""
    return dedup.deduplicate(_remotive_postings(spark, d), "_ord", [], near=False).select(F.col("_ord").alias("first"), "merged")


def q46_exact_key_groups(spark: SparkSession, d: str) -> DataFrame:
    """Postings linked with the first that has their company and title, or their description."""
    rows = table(spark, d, "remotive", "id", "company_name", "title", "description").select("id", F.array(F.concat(F.lit("t|"), text.normalize_company(F.col("company_name")), F.lit("|"), text.normalize_title(F.col("title"))), F.concat(F.lit("d|"), F.md5(F.coalesce("description", F.lit(""))))).alias("k"))
    return dedup.exact_links(rows, "id", "k").groupBy("b").agg(F.min("a").alias("first"), F.count("*").alias("links")).withColumnRenamed("b", "id")


def _answers(rows: DataFrame, employer: str, jobs: Column, container: str) -> DataFrame:
    """Documents as a provider gives them, one posting each: (path, body)."""
    inner = F.struct(F.array(jobs).alias("jobs")) if container != "subdomains" else F.struct(F.array(jobs).alias("offers"))
    return rows.select(F.lit("made").alias("path"), F.to_json(F.struct(F.create_map(F.coalesce(employer, F.lit("none")), inner).alias(container))).alias("body"))


def _remotive(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "remotive", "id", "url", "title", "company_name", "category", "tags", "job_type", "publication_date", "candidate_required_location", "salary", "description")


def _greenhouse_docs(spark: SparkSession, d: str) -> DataFrame:
    named = lambda *c: F.array(*[F.struct(F.col(x).alias("name")) for x in c])
    kind = F.array(F.struct(F.lit("Level").alias("name"), F.lit("x").alias("value")), F.struct(F.lit("Employment Type").alias("name"), F.col("job_type").alias("value")))
    jobs = F.struct("id", "title", F.col("publication_date").alias("updated_at"), F.struct(F.col("candidate_required_location").alias("name")).alias("location"), F.col("url").alias("absolute_url"), F.col("description").alias("content"), kind.alias("metadata"), named("category").alias("departments"), named("company_name", "salary").alias("offices"))
    return providers.parsed(_answers(_remotive(spark, d), "company_name", jobs, "boards"), "greenhouse")


def q65_greenhouse(spark: SparkSession, d: str) -> DataFrame:
    """Every row of remotive as a document of another provider, read by its schema and projected."""
    return providers.greenhouse(_greenhouse_docs(spark, d)).select("source_job_id", "company", "title", "location", "remote", "url", "published_at", F.md5("description").alias("description_md5"), "employment_type", F.array_join("tags", "|").alias("tags"))


def q66_collection_log(spark: SparkSession, d: str) -> DataFrame:
    """What the log of those documents says of each employer, and of as many that can't be read."""
    docs = _greenhouse_docs(spark, d)
    broken = providers.parsed(_remotive(spark, d).select(F.concat(F.lit("/x/"), "id").alias("path"), F.lit('{"boards": 5').alias("body"), F.when(F.col("id") % 2 == 0, "HTTP Error 404: gone").otherwise("").alias("error"), F.lit(None).cast("int").alias("status")), "greenhouse")
    log = providers.collection_log(docs, "greenhouse", "boards", "jobs").unionByName(providers.collection_log(broken, "greenhouse", "boards", "jobs"))
    return log.groupBy(F.coalesce("employer", F.lit("")).alias("employer"), "ok", F.coalesce("http_status", F.lit(0)).alias("http_status")).agg(F.sum("jobs").alias("jobs"), F.sum("requests").alias("requests"), F.max(F.regexp_replace("error", "[0-9]{5,}", "n")).alias("error"))


def q67_ashby(spark: SparkSession, d: str) -> DataFrame:
    second = F.array(F.struct(F.col("candidate_required_location").alias("location")), F.struct(F.col("category").alias("location")))
    jobs = F.struct("id", "title", F.col("candidate_required_location").alias("location"), second.alias("secondaryLocations"), F.col("category").alias("department"), F.col("job_type").alias("team"), (F.col("id") % 5 > 0).alias("isListed"), (F.col("id") % 2 == 0).alias("isRemote"), F.when(F.col("id") % 3 == 0, "Hybrid").alias("workplaceType"), F.col("description").alias("descriptionHtml"), F.col("publication_date").alias("publishedAt"), F.col("job_type").alias("employmentType"), F.col("url").alias("jobUrl"), F.struct(F.col("salary").alias("compensationTierSummary")).alias("compensation"))
    rows = providers.ashby(providers.parsed(_answers(_remotive(spark, d), "company_name", jobs, "boards"), "ashby"))
    return rows.select("source_job_id", "company", "title", "location", "remote", "hybrid", "url", "apply_url", F.md5("description").alias("description_md5"), "salary", "employment_type", F.array_join("tags", "|").alias("tags"))


def q68_recruitee(spark: SparkSession, d: str) -> DataFrame:
    pay = F.when(F.col("salary").isNotNull(), F.struct(F.lit("EUR").alias("currency"), F.lit("").alias("min"), F.col("salary").alias("max"), F.lit("year").alias("period")))
    jobs = F.struct(F.when(F.col("id") % 2 == 0, F.col("id")).alias("id"), F.concat(F.lit("g"), "id").alias("guid"), F.when(F.col("id") % 7 == 0, "draft").alias("status"), F.when(F.col("id") % 3 == 0, F.col("company_name")).alias("company_name"), "title", F.col("candidate_required_location").alias("location"), (F.col("id") % 4 == 0).alias("remote"), F.col("url").alias("careers_url"), F.col("publication_date").alias("created_at"), "description", F.col("title").alias("requirements"), F.col("category").alias("department"), F.col("job_type").alias("employment_type_code"), pay.alias("salary"))
    rows = providers.recruitee(providers.parsed(_answers(_remotive(spark, d), "category", jobs, "subdomains"), "recruitee"))
    return rows.select("source_job_id", "company", "title", "location", "remote", "hybrid", "url", "apply_url", "published_at", F.md5("description").alias("description_md5"), "salary", "employment_type", F.array_join("tags", "|").alias("tags"))


def _tag(name: str, value: Column) -> Column:
    """An XML element with this text, control signs escaped; none for null."""
    safe = F.replace(F.replace(F.replace(value.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.coalesce(F.concat(F.lit(f"<{name}>"), safe, F.lit(f"</{name}>")), F.lit(""))


def _landed(rows: DataFrame, xml: Column) -> str:
    """One document with an element a line, as one provider's answer is one file."""
    path = new_path(rows.sparkSession, "landing")
    ends = rows.sparkSession.createDataFrame([(0, "<rss><channel>"), (2, "</channel></rss>")], "k int, value string")
    lines = rows.select(F.lit(1).alias("k"), F.regexp_replace(xml, r"[\r\n]+", " ").alias("value")).unionByName(ends)
    lines.coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return path


def q69_personio(spark: SparkSession, d: str) -> DataFrame:
    """Every row of remotive as a position of an account's XML."""
    code = F.element_at(F.array(*[F.lit(k) for k in providers.YEARS]), (F.col("id") % len(providers.YEARS) + 1).cast("int"))
    block = F.concat(F.lit("<jobDescriptions><jobDescription>"), _tag("name", F.lit("Tasks")), _tag("value", F.col("id")), F.lit("</jobDescription></jobDescriptions>"))
    xml = F.concat(F.lit("<position>"), _tag("id", F.col("id")), _tag("subcompany", F.when(F.col("id") % 2 == 0, F.col("id") % 9)), _tag("office", F.col("category")), _tag("department", F.col("category")), _tag("name", F.concat(F.lit("Role "), "id")), block, _tag("employmentType", F.col("job_type")), _tag("schedule", F.when(F.col("id") % 3 == 0, "full-time")), _tag("yearsOfExperience", code), F.lit("</position>"))
    rows = providers.personio(spark, _landed(_remotive(spark, d), xml), "acme", "Acme Inc", "de")
    return rows.select("source_job_id", "company", "title", "location", "url", F.md5("description").alias("description_md5"), "employment_type", F.array_join("tags", "|").alias("tags"))


def q70_feed_posts(spark: SparkSession, d: str) -> DataFrame:
    """Every row of remotive as an item of a feed; those that speak of work and link to a post become postings."""
    link = F.concat(F.when(F.col("id") % 3 == 0, "https://g.example/url?q=").otherwise(""), F.lit("https://www.posts.example/in/"), F.col("id") % 500)
    xml = F.concat(F.lit("<item>"), _tag("title", F.concat(F.lit("Role "), "id", F.when(F.col("id") % 2 == 0, " hiring").otherwise(" idle"))), _tag("link", link), _tag("guid", F.concat(F.lit("g"), "id")), _tag("author", F.col("category")), _tag("description", F.concat(F.lit("work "), F.col("id") % 500)), F.lit("</item>"))
    entries = feeds.feed_entries(spark, _landed(_remotive(spark, d).where("id is not null"), xml))
    found = feeds.feed_postings(entries, "posts", r"posts\.example", "/in/", ["role"], ["hiring", "idle"], 10_000_000)
    return found.groupBy("url").agg(F.count("*").alias("n"), F.max("feed_name").alias("feed"), F.bool_and(F.col("title").startswith("Role ")).alias("titled"))


QUERIES = {f.__name__: f for f in (q65_greenhouse, q66_collection_log, q67_ashby, q68_recruitee, q69_personio, q70_feed_posts, q01_top_report, q02_normalized_text, q03_visible_text, q04_canonical_urls, q05_posting_keys, q06_sentences, q07_german_markers, q08_rejection_reasons, q09_title_ladder, q10_best_family, q11_strongest_mentions, q12_carried_sections, q13_exact_duplicates, q14_anchor_blocks, q35_year_ranges, q41_epoch_projection, q42_nested_projection, q43_union_sources, q15_merged_postings, q64_exact_groups, q62_remotive_projection, q63_short_aliases, q44_html_parser, q45_deduplicated, q46_exact_key_groups, q49_arbeitnow_projection)}

_ROWS = f"SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS sentence FROM (SELECT doc_id, {_parts('text')} AS p FROM documents)"
_HEAD = rf"regexp_replace({_bare('sentence')}, '^[ :\-]+|[ :\-]+$', '', 'g')"
_FLAG = f"CASE WHEN length(h) <= 80 AND regexp_matches(h, '^(?:{'|'.join(ON)})(?: |$)') THEN true WHEN length(h) <= 80 AND regexp_matches(h, '^(?:{'|'.join(OFF)})(?: |$)') THEN false END"
_CARRIED = f"SELECT doc_id, pos, sentence, coalesce(last_value(f IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS optional FROM (SELECT *, {_FLAG} AS f FROM (SELECT *, {_HEAD} AS h FROM ({_ROWS})))"
_SCORES = ", ".join(f"{{'score': least(12, 6 * {_hits('t', t)}) + least(4, {_hits('b', b)}), 'ord': {-k}, 'id': '{n}'}}" for k, (n, t, b) in enumerate(FAMILIES))

_CANON = f"""SELECT id, fetched_at, tags, {_plain("coalesce(nullif(trim(company_name, ' '), ''), 'Unknown company')")} AS c, {_plain("coalesce(nullif(trim(title, ' '), ''), 'Untitled role')")} AS t, {_plain("coalesce(nullif(trim(candidate_required_location, ' '), ''), '')")} AS p0, {_plain("coalesce(nullif(trim(description, ' '), ''), '')")} AS d FROM remotive"""
_CANON = f"SELECT *, CASE WHEN p0 <> '' THEN p0 ELSE 'Remote' END AS p FROM ({_CANON})"
# seconds above ten digits are milliseconds; the number is read in any writing
_EPOCH = r"""(WITH a AS (SELECT *, trim(coalesce(created_at, ''), ' ') AS v FROM arbeitnow), b AS (SELECT *, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]{1,2})?') THEN try_cast(v AS DECIMAL(26, 9)) END AS n FROM a),
        c AS (SELECT *, CASE WHEN n > 10000000000 THEN n / 1000 ELSE n END AS s FROM b), e AS (SELECT *, CASE WHEN s BETWEEN -62135596800 AND 253402300799 THEN round(s * 1000000)::bigint END AS m FROM c)
        SELECT *, CASE WHEN m IS NULL THEN v WHEN m % 1000000 = 0 THEN strftime(make_timestamp(m), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(make_timestamp(m), '%Y-%m-%dT%H:%M:%S.%fZ') END AS published_at FROM e)"""
_OR = lambda *x: "coalesce(" + ", ".join(f"nullif(trim({c}, ' '), '')" for c in x) + ", '')"

SQL = {
    "q01_top_report": f"""WITH r AS (SELECT slug, title, company_name, fetched_at, row_number() OVER (PARTITION BY slug ORDER BY fetched_at DESC NULLS LAST, title NULLS FIRST, company_name NULLS FIRST) AS n FROM arbeitnow WHERE {_has(_norm('title'), ACCEPT)} AND NOT {_has(_norm('title'), VETO)}),
        o AS (SELECT row_number() OVER (ORDER BY company_name IS NOT NULL DESC, fetched_at DESC NULLS LAST, slug) AS report_number, slug, title FROM r WHERE n = 1)
        SELECT report_number::int AS report_number, slug, {_title('title')} AS title FROM o WHERE report_number <= 50""",
    "q02_normalized_text": f"SELECT doc_id, md5({_norm('text')}) AS text_md5 FROM documents",
    "q03_visible_text": f"SELECT id, length(t)::int AS chars, md5(t) AS text_md5 FROM (SELECT id, {_plain('description')} AS t FROM remotive)",
    "q04_canonical_urls": r"""WITH a AS (SELECT slug, regexp_replace(trim(coalesce(url, ''), ' '), '#.*$', '') AS u FROM arbeitnow),
        b AS (SELECT slug, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)', 1) AS head, u FROM a),
        c AS (SELECT slug, lower(head) AS head, u[length(head) + 1:] AS rest FROM b),
        e AS (SELECT slug, head, regexp_replace(regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/{2,}', '/', 'g'), '/+$', '') AS path, list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(?:utm_[^=]*|source|ref|referrer|gh_src)(?:=|$)')) AS q FROM c),
        f AS (SELECT slug, head || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM e),
        g AS (SELECT slug, canonical, lower(regexp_extract(canonical, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) AS host FROM f)
        SELECT slug, canonical, host, (CASE WHEN host = '' THEN 0 WHEN host = 'www.arbeitnow.example' THEN 1 ELSE 3 END)::int AS quality FROM g""",
    "q05_posting_keys": f"SELECT slug, substring(sha256({_fingerprint('company_name', 'title', 'location')}), 1, 20) AS job_key, sha256(concat_ws('|', coalesce(title, ''), coalesce(company_name, ''), coalesce(location, ''), coalesce(description, ''), coalesce(salary, ''))) AS content_hash FROM arbeitnow",
    "q06_sentences": f"SELECT doc_id, count(*) AS n, sum(length(sentence))::bigint AS chars, max(length(sentence))::int AS longest FROM ({_ROWS}) GROUP BY 1",
    "q07_german_markers": "WITH t AS (SELECT coalesce(lower(lang), '') AS lang, ' ' || " + _norm("text") + " || ' ' AS t FROM documents) SELECT lang, length(t) >= 300 AND (" + " + ".join(f"(length(t) - length(replace(t, '{m}', ''))) // {len(m)}" for m in GERMAN) + ") >= 9 AS german, count(*) AS documents FROM t GROUP BY 1, 2",
    "q08_rejection_reasons": f"""WITH w AS (SELECT slug, unnest(list_filter([CASE WHEN {_has(_norm('title'), VETO)} THEN 'title' END, CASE WHEN {_has(_norm("array_to_string(job_types, ' ')"), ['intern'])} THEN 'employment type' END, CASE WHEN coalesce(trim(company_name, ' '), '') = '' THEN 'no company' END, CASE WHEN length(coalesce(description, '')) < 200 THEN 'short description' END], lambda x: x IS NOT NULL)) AS why FROM arbeitnow)
        SELECT why, count(*) AS rows, min(slug) AS first FROM w GROUP BY 1""",
    "q09_title_ladder": "WITH t AS (SELECT id, " + _norm("title") + " AS t FROM remotive) SELECT id, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in LADDER) + " ELSE 'other' END AS level, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN regexp_extract(t, '{p}', 0)" for _, p in LADDER) + " ELSE '' END AS evidence FROM t",
    "q10_best_family": f"WITH t AS (SELECT id, {_norm('title')} AS t, {_bare(_plain('description'))} AS b FROM remotive), s AS (SELECT id, list_max([{_SCORES}]) AS m FROM t) SELECT id, CASE WHEN m.score > 0 THEN m.id ELSE 'other' END AS family, greatest(m.score, 0)::int AS score FROM s",
    "q11_strongest_mentions": f"""WITH s AS (SELECT *, {_bare('sentence')} AS t FROM ({_CARRIED})), o AS (SELECT *, optional OR {_has('t', OPTIONAL)} AS is_o, {_has('t', MANDATORY)} AS is_m FROM s),
        h AS (SELECT doc_id, pos, substring(sentence, 1, 260) AS evidence, is_o, CASE WHEN is_o THEN 2 WHEN is_m THEN 3 ELSE 1 END AS st, unnest(list_filter([{', '.join(f"CASE WHEN {_has('t', ALIASES[n])} THEN '{n}' END" for n in sorted(ALIASES))}], lambda x: x IS NOT NULL)) AS skill FROM o)
        SELECT doc_id, skill, ['mentioned', 'optional', 'mandatory'][arg_max(st, (st, -pos))] AS requirement, md5(arg_max(evidence, (st, -pos))) AS evidence_md5, count(*) AS mentions, bool_and(is_o) AS only_optional FROM h GROUP BY 1, 2""",
    "q12_carried_sections": f"SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE optional) AS in_optional FROM ({_CARRIED}) GROUP BY 1",
    "q13_exact_duplicates": f"SELECT min(slug) AS slug, sha256(k) AS fingerprint FROM (SELECT slug, {_fingerprint('company_name', 'title', 'location')} AS k FROM arbeitnow) GROUP BY k",
    "q14_anchor_blocks": f"SELECT concat_ws('|', c, length(b) // 200, substring(sha256(substring(b, 1, 300)), 1, 16)) AS anchor, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT id, {_company('c')} AS c, {_bare('d')} AS b FROM ({_CANON})) WHERE c <> '' AND length(b) >= 500 GROUP BY 1",
    "q35_year_ranges": rf"""WITH m AS (SELECT doc_id, pos, unnest(regexp_extract_all(sentence, '(?i)\b(\d{{1,2}})(?:\s*[-–—]\s*(\d{{1,2}}))?\s*\+?\s*(?:years?|yrs?|jahre?n?)\b')) AS y FROM ({_ROWS})),
        v AS (SELECT doc_id, pos, regexp_extract(y, '^(\d{{1,2}})', 1)::int AS low, try_cast(nullif(regexp_extract(y, '^\d{{1,2}}\s*[-–—]\s*(\d{{1,2}})', 1), '') AS int) AS high FROM m)
        SELECT doc_id, count(*) AS n, max(low) AS most, arg_max(pos, (low, -pos))::int AS at FROM v WHERE low <= 20 AND coalesce(high, 0) <= 30 GROUP BY 1""",
    "q41_epoch_projection": f"SELECT {_OR('slug')} AS slug, published_at FROM {_EPOCH}",
    "q42_nested_projection": f"""SELECT site, {_OR('id')} AS id, {_OR('text')} AS title, {_OR("array_to_string(categories.allLocations, ' | ')", 'categories.location')} AS location, lower({_OR('workplaceType')}) = 'remote' AS remote, lower({_OR('workplaceType')}) = 'hybrid' AS hybrid, {_OR('hostedUrl')} AS url, {_OR('applyUrl', 'hostedUrl')} AS apply_url,
        md5(concat_ws(chr(10) || chr(10), nullif(trim({_OR('descriptionPlain')}, ' '), ''), nullif(trim(array_to_string([concat_ws(chr(10), x.text, x.content) for x in coalesce(lists, [])], chr(10) || chr(10)), ' '), ''), nullif({_OR('additionalPlain')}, ''))) AS text_md5, {_OR('categories.commitment')} AS employment_type,
        coalesce(array_to_string(list_filter([categories.team, categories.department], lambda x: trim(x, ' ') <> ''), ','), '') AS tags FROM lever""",
    "q43_union_sources": f"""WITH r AS (SELECT 'remotive' AS source, 0 AS place, {_OR('id::varchar')} AS k, title FROM remotive UNION ALL SELECT 'arbeitnow', 1, {_OR('slug')}, title FROM arbeitnow UNION ALL SELECT 'lever', 2, {_OR('id')}, text FROM lever)
        SELECT source, count(*) AS n, count(DISTINCT k) AS postings, count(*) FILTER (WHERE coalesce(trim(title, ' '), '') = '') AS untitled, count(*) AS numbers, max(place)::bigint AS place FROM r GROUP BY 1""",
    "q44_html_parser": f"SELECT id, length(t)::int AS chars, md5(t) AS text_md5 FROM (SELECT id, {_plain('description')} AS t FROM remotive)",
    "q15_merged_postings": f"""WITH r AS (SELECT id, strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ') AS w, list_filter(coalesce(tags, []), lambda x: x <> '') AS tags, d, substring(sha256({_fingerprint('c', 't', 'p')}), 1, 20) AS job_key FROM ({_CANON})),
        g AS (SELECT job_key, min(id) AS first, arg_max(id, (w, -id))::varchar AS best, md5(arg_max(d, (length(d), w, -id))) AS description_md5, max(id)::varchar AS last_id, count(*) AS merged FROM r GROUP BY 1), e AS (SELECT job_key, string_agg(DISTINCT x, ',' ORDER BY x) AS tags FROM (SELECT job_key, unnest(tags) AS x FROM r) GROUP BY 1)
        SELECT job_key, first, best, description_md5, coalesce(tags, '') AS tags, 'remotive' AS sources, last_id, true AS remote, merged FROM g LEFT JOIN e USING (job_key)""",
    "q64_exact_groups": f"""WITH RECURSIVE r AS (SELECT id, {_fingerprint('c', 't', 'p')} AS f, {_company('c')} AS c, {_bare('d')} AS b FROM ({_CANON})), h AS (SELECT id, unnest(['f|' || f, CASE WHEN c <> '' AND length(b) >= 500 THEN 'd|' || c || '|' || sha256(b) END]) AS k FROM r),
        m AS (SELECT k, min(id) AS a FROM h WHERE k IS NOT NULL GROUP BY 1), l AS (SELECT DISTINCT a, id AS b FROM h JOIN m USING (k) WHERE a <> id), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), g AS (SELECT DISTINCT id, id AS c FROM r UNION SELECT e.b, g.c FROM g JOIN e ON e.a = g.id AND g.c < e.b), n AS (SELECT id, min(c) AS c FROM g GROUP BY 1)
        SELECT n.c AS first, count(*) AS merged FROM r JOIN n USING (id) GROUP BY 1""",
    "q49_arbeitnow_projection": f"""SELECT {_OR('slug')} AS slug, {_OR('company_name')} AS company, {_OR('title')} AS title, coalesce(remote, false) AS remote, {_OR('url')} AS url, published_at, md5({_OR('description')}) AS description_md5, {_OR('salary')} AS salary, coalesce(array_to_string(job_types, ', '), '') AS employment_type, {_OR('location')} AS location, array_to_string(tags, ',') AS tags FROM {_EPOCH}""",
    "q62_remotive_projection": f"""SELECT {_OR('id::varchar')} AS source_job_id, {_OR('company_name')} AS company, {_OR('title')} AS title, coalesce(nullif(trim(candidate_required_location, ' '), ''), 'Remote') AS location, {_OR('url')} AS url, {_OR('publication_date')} AS published_at, md5({_OR('description')}) AS description_md5, {_OR('salary')} AS salary, {_OR('job_type')} AS employment_type, array_to_string(tags, ',') AS tags FROM remotive""",
    "q63_short_aliases": f"""WITH t AS (SELECT doc_id, {_bare('text')} AS t FROM documents) SELECT doc_id, regexp_matches(t, '(?:^|[^a-z0-9äöüß_])it(?:$|[^a-z0-9äöüß_])') AS as_word, regexp_matches(t, '(?:^|[^a-z0-9äöüß_])api(?:$|[^a-z0-9äöüß_])') AS as_word_too, contains(t, 'team') AS anywhere FROM t""",
    "q65_greenhouse": f"""SELECT {_OR('id::varchar')} AS source_job_id, coalesce(company_name, 'none') AS company, {_OR('title')} AS title, {_OR('candidate_required_location')} AS location, contains(lower({_OR('candidate_required_location')}), 'remote') AS remote, {_OR('url')} AS url, {_OR('publication_date')} AS published_at, md5({_OR('description')}) AS description_md5, {_OR('job_type')} AS employment_type,
        coalesce(array_to_string(list_filter([category, company_name, salary], lambda x: x IS NOT NULL), '|'), '') AS tags FROM remotive""",
    "q66_collection_log": """SELECT coalesce(company_name, 'none') AS employer, true AS ok, 0 AS http_status, count(*) AS jobs, count(*) AS requests, '' AS error FROM remotive GROUP BY 1
        UNION ALL SELECT '', false, CASE WHEN id % 2 = 0 THEN 404 ELSE 0 END, 0, count(*), max(CASE WHEN id % 2 = 0 THEN 'HTTP Error 404: gone' ELSE regexp_replace('no valid document: ' || id, '[0-9]{5,}', 'n') END) FROM remotive GROUP BY id % 2""",
    "q67_ashby": f"""SELECT id::varchar AS source_job_id, coalesce(company_name, 'none') AS company, {_OR('title')} AS title, coalesce(array_to_string(list_filter([candidate_required_location, CASE WHEN category IS DISTINCT FROM candidate_required_location THEN category END], lambda x: trim(x, ' ') <> ''), ' | '), '') AS location, id % 2 = 0 AS remote, id % 3 = 0 AS hybrid, {_OR('url')} AS url, {_OR('url')} AS apply_url,
        md5({_OR('description')}) AS description_md5, {_OR('salary')} AS salary, {_OR('job_type')} AS employment_type, coalesce(array_to_string(list_filter([category, job_type], lambda x: trim(x, ' ') <> ''), '|'), '') AS tags FROM remotive WHERE id % 5 > 0""",
    "q68_recruitee": f"""SELECT CASE WHEN id % 2 = 0 THEN id::varchar ELSE 'g' || id END AS source_job_id, {_OR("CASE WHEN id % 3 = 0 THEN company_name END", "coalesce(category, 'none')")} AS company, {_OR('title')} AS title, {_OR('candidate_required_location')} AS location, id % 4 = 0 AS remote, false AS hybrid, {_OR('url')} AS url, {_OR('url')} AS apply_url, {_OR('publication_date')} AS published_at,
        md5(concat_ws(chr(10) || chr(10), nullif(trim(coalesce(description, ''), ' '), ''), nullif(trim(coalesce(title, ''), ' '), ''))) AS description_md5, CASE WHEN salary IS NULL THEN '' ELSE trim(concat_ws(' ', coalesce(nullif(salary, ''), ''), 'EUR', 'year'), ' ') END AS salary, {_OR('job_type')} AS employment_type, coalesce(category, '') AS tags FROM remotive WHERE id % 7 <> 0""",
    "q69_personio": f"""SELECT id::varchar AS source_job_id, CASE WHEN id % 2 = 0 THEN (id % 9)::varchar ELSE 'Acme Inc' END AS company, 'Role ' || id AS title, {_OR('category')} AS location, 'https://acme.jobs.personio.de/job/' || id || '?language=de' AS url,
        md5('Tasks' || chr(10) || id || chr(10) || chr(10) || (['{"', '".join(providers.YEARS.values())}'])[id % {len(providers.YEARS)} + 1]) AS description_md5, concat_ws(' / ', nullif(trim(job_type, ' '), ''), CASE WHEN id % 3 = 0 THEN 'full-time' END) AS employment_type, concat_ws('|', nullif(trim(category, ' '), ''), (['{"', '".join(providers.YEARS)}'])[id % {len(providers.YEARS)} + 1]) AS tags FROM remotive""".replace('", "', "', '"),
    "q70_feed_posts": "SELECT 'https://www.posts.example/in/' || (id % 500) AS url, 1::bigint AS n, 'posts' AS feed, true AS titled FROM remotive GROUP BY id % 500",
    "q46_exact_key_groups": f"""WITH k AS (SELECT id, unnest(['t|' || {_company('company_name')} || '|' || {_title('title')}, 'd|' || md5(coalesce(description, ''))]) AS k FROM remotive), f AS (SELECT k, min(id) AS a FROM k GROUP BY 1), l AS (SELECT DISTINCT a, id FROM k JOIN f USING (k) WHERE a <> id)
        SELECT id, min(a) AS first, count(*) AS links FROM l GROUP BY 1""",
}
