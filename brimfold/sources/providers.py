"""Provider payloads to one raw posting schema: explicit schemas on read, explosion, projection; failures as rows of a log.

Payloads are landed files: one JSON document each, or XML for feeds. Schemas are declared, never inferred. A payload
whose container can't be parsed gives no postings and one failed row in the log, so one bad file or employer fails alone;
a field of another type than declared costs its own value only. Ids and instants are read as they stand, as text.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = (
    "source string, source_job_id string, company string, title string, location string, remote boolean, hybrid boolean, url string, apply_url string, canonical_url string, ats string, "
    "published_at string, description string, salary string, employment_type string, tags array<string>, lead_type string, post_author string, feed_name string"
)
LOG = "source string, employer string, ok boolean, jobs bigint, requests bigint, http_status int, error string"

# What a document holds its postings in.
CONTAINERS = {"arbeitnow": "pages", "remotive": "jobs", "greenhouse": "boards", "ashby": "boards", "lever": "sites", "recruitee": "subdomains"}
SCHEMAS = {
    "arbeitnow": "pages array<struct<data:array<struct<slug:string,company_name:string,title:string,description:string,remote:boolean,url:string,tags:array<string>,job_types:array<string>,location:string,created_at:string,salary:string>>>>",
    "remotive": "jobs array<struct<id:string,url:string,title:string,company_name:string,category:string,tags:array<string>,job_type:string,publication_date:string,candidate_required_location:string,salary:string,description:string>>",
    "greenhouse": "boards map<string,struct<jobs:array<struct<id:string,title:string,updated_at:string,location:struct<name:string>,absolute_url:string,content:string,metadata:array<struct<name:string,value:string>>,departments:array<struct<name:string>>,offices:array<struct<name:string>>>>>>",
    "ashby": "boards map<string,struct<jobs:array<struct<id:string,title:string,location:string,secondaryLocations:array<struct<location:string>>,department:string,team:string,isListed:boolean,isRemote:boolean,workplaceType:string,descriptionPlain:string,descriptionHtml:string,publishedAt:string,employmentType:string,jobUrl:string,applyUrl:string,compensation:struct<compensationTierSummary:string>>>>>",
    "lever": "sites map<string,array<struct<id:string,text:string,categories:struct<location:string,allLocations:array<string>,commitment:string,team:string,department:string>,descriptionPlain:string,description:string,lists:array<struct<text:string,content:string>>,additionalPlain:string,additional:string,hostedUrl:string,applyUrl:string,workplaceType:string,createdAt:string,salaryRange:struct<currency:string,min:double,max:double,interval:string>,salaryDescriptionPlain:string>>>",
    "recruitee": "subdomains map<string,struct<offers:array<struct<id:string,guid:string,slug:string,status:string,company_name:string,title:string,location:string,remote:boolean,hybrid:boolean,careers_url:string,careers_apply_url:string,published_at:string,created_at:string,description:string,requirements:string,department:string,category_code:string,experience_code:string,employment_type_code:string,salary:struct<currency:string,min:string,max:string,period:string>>>>>",
}
PERSONIO = "id string, subcompany string, office string, department string, recruitingCategory string, name string, jobDescriptions struct<jobDescription:array<struct<name:string,value:string>>>, employmentType string, seniority string, schedule string, yearsOfExperience string, createdAt string"
# What the codes for years of experience stand for.
YEARS = {"lt-1": "Less than 1 year of experience", "1-2": "1-2 years of experience", "2-5": "2-5 years of experience", "5-7": "5-7 years of experience", "7-10": "7-10 years of experience", "10-15": "10-15 years of experience", "gt-15": "15+ years of experience"}
# Fixed value: how a status code is named in error texts.
STATUS = r"(?i)HTTP(?: Error)?\s*(\d{3})"


def _or(*columns: Column) -> Column:
    """The first that is neither null nor blank, else the empty string."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns], F.lit(""))


def _lines(*columns: Column) -> Column:
    return F.concat_ws("\n\n", *[F.nullif(F.trim(c), F.lit("")) for c in columns])


def _epoch(value: Column) -> Column:
    """ISO text of epoch seconds, or milliseconds above ten digits, in any writing of numbers; other texts as they are, null as the empty text."""
    text = _or(value)
    number = F.when(text.rlike(r"^[+-]?[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]{1,2})?$"), text).try_cast("decimal(26,9)")
    seconds = F.when(number > 10_000_000_000, number / 1000).otherwise(number)
    # years 1 to 9999
    micros = F.when(seconds.between(-62_135_596_800, 253_402_300_799), F.round(seconds * 1_000_000)).cast("bigint")
    at = F.to_utc_timestamp(F.timestamp_micros(micros), F.current_timezone())
    iso = F.when(micros % 1_000_000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return F.coalesce(iso, text)


def payloads(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(path, doc, error, status): landed JSON documents, one row each, parsed by the provider's schema; doc is null where its container can't be read."""
    return parsed(spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("body")), source)


def parsed(rows: DataFrame, source: str, employer: str | None = None) -> DataFrame:
    """``payloads`` of rows (path or url, body[, error, status]), as a REST source gives them.

    ``employer`` names the column that says whose postings a body holds, for providers with an address an employer.
    """
    here = set(rows.columns)
    body = F.col("body")
    if employer:  # one employer's answer, put where a document of all employers has it
        body = F.concat(F.lit('{"' + CONTAINERS[source] + '":{'), F.regexp_replace(F.to_json(F.array(F.col(employer))), r"^\[|\]$", ""), F.lit(":"), body, F.lit("}}"))
    schema = SCHEMAS[source] + (", " + SCHEMAS[source].removeprefix("pages array<struct<").removesuffix(">>").replace("data:", "data ", 1) if source == "arbeitnow" else "")
    doc = F.from_json(body, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    fields = {"path": F.col("path" if "path" in here else "url"), "doc": doc, "error": F.col("error") if "error" in here else F.lit(""), "status": F.col("status") if "status" in here else F.lit(None).cast("int"), "owner": F.col(employer) if employer else F.lit(None).cast("string")}
    out = rows.select(*[c.alias(n) for n, c in fields.items()])
    if source == "arbeitnow":  # a page by itself, or several in one document
        out = out.withColumn("doc", F.col("doc").withField("pages", F.coalesce("doc.pages", F.when(F.col("doc.data").isNotNull(), F.array(F.struct(F.col("doc.data").alias("data")))))))
    whole = F.col("doc._bad").isNull() | F.col(f"doc.{CONTAINERS[source]}").isNotNull()
    return out.withColumn("doc", F.when(whole & (F.coalesce("error", F.lit("")) == ""), F.col("doc")))


def _finish(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    fields = [x.strip().split(" ") for x in RAW.split(", ")]
    values = {"source": F.lit(source), "ats": F.lit(""), **columns}
    return df.select(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


def _keyed(docs: DataFrame, container: str, jobs: str | None) -> DataFrame:
    """(employer, j): one row per posting of a document keyed by employer."""
    by = docs.where("doc is not null").select(F.explode(f"doc.{container}").alias("employer", "v"))
    return by.select("employer", F.explode(f"v.{jobs}" if jobs else "v").alias("j"))


def arbeitnow(docs: DataFrame) -> DataFrame:
    return arbeitnow_rows(docs.where("doc is not null").select(F.explode("doc.pages").alias("p")).select(F.explode("p.data").alias("j")).select("j.*"))


def arbeitnow_rows(j: DataFrame) -> DataFrame:
    """Postings of arbeitnow that already are rows."""
    return _finish(j, "arbeitnow", source_job_id=_or(F.col("slug")), company=_or(F.col("company_name")), title=_or(F.col("title")), location=_or(F.col("location")), remote=F.coalesce("remote", F.lit(False)), url=_or(F.col("url")), published_at=_epoch(F.col("created_at")), description=_or(F.col("description")), salary=_or(F.col("salary")), employment_type=F.concat_ws(", ", "job_types"), tags=F.col("tags"))


def remotive(docs: DataFrame) -> DataFrame:
    return remotive_rows(docs.where("doc is not null").select(F.explode("doc.jobs").alias("j")).select("j.*"))


def remotive_rows(j: DataFrame) -> DataFrame:
    """Postings of remotive that already are rows."""
    return _finish(j, "remotive", source_job_id=_or(F.col("id")), company=_or(F.col("company_name")), title=_or(F.col("title")), location=F.coalesce(F.nullif(F.trim("candidate_required_location"), F.lit("")), F.lit("Remote")), remote=F.lit(True), url=_or(F.col("url")), published_at=_or(F.col("publication_date")), description=_or(F.col("description")), salary=_or(F.col("salary")), employment_type=_or(F.col("job_type")), tags=F.col("tags"))


def greenhouse(docs: DataFrame) -> DataFrame:
    j = _keyed(docs, "boards", "jobs").select("employer", "j.*")
    kind = F.filter("metadata", lambda m: F.lower(m["name"]).rlike("employment|job type"))
    names = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<name:string>>")), lambda x: x["name"])
    return _finish(j, "greenhouse", ats=F.lit("greenhouse"), source_job_id=_or(F.col("id")), company=F.col("employer"), title=_or(F.col("title")), location=_or(F.col("location.name")), remote=F.lower(_or(F.col("location.name"))).contains("remote"), url=_or(F.col("absolute_url")), published_at=_or(F.col("updated_at")), description=_or(F.col("content")), employment_type=_or(F.try_element_at(kind, F.lit(1))["value"]), tags=F.array_compact(F.concat(names("departments"), names("offices"))))


def ashby(docs: DataFrame) -> DataFrame:
    j = _keyed(docs, "boards", "jobs").select("employer", "j.*").where(F.coalesce("isListed", F.lit(True)))
    second = F.transform(F.coalesce("secondaryLocations", F.array().cast("array<struct<location:string>>")), lambda x: x["location"])
    places = F.filter(F.array_distinct(F.concat(F.array("location"), second)), lambda x: F.trim(x) != "")
    slug = F.element_at(F.split(F.regexp_replace(_or(F.col("jobUrl")), r"[?#].*$|/+$", ""), "/"), -1)
    return _finish(j, "ashby", ats=F.lit("ashby"), source_job_id=_or(F.col("id"), slug), company=F.col("employer"), title=_or(F.col("title")), location=F.array_join(places, " | "), remote=F.coalesce("isRemote", F.lit(False)) | (F.lower(_or(F.col("workplaceType"))) == "remote"), hybrid=F.lower(_or(F.col("workplaceType"))) == "hybrid", url=_or(F.col("jobUrl")), apply_url=_or(F.col("applyUrl"), F.col("jobUrl")), published_at=_or(F.col("publishedAt")), description=_or(F.col("descriptionPlain"), F.col("descriptionHtml")), salary=_or(F.col("compensation.compensationTierSummary")), employment_type=_or(F.col("employmentType")), tags=F.filter(F.array("department", "team"), lambda x: F.trim(x) != ""))


def lever(docs: DataFrame) -> DataFrame:
    return lever_rows(_keyed(docs, "sites", None).select("employer", "j.*"))


def lever_rows(j: DataFrame) -> DataFrame:
    """Postings of lever that already are rows, with their ``employer``; columns it does not deliver may be missing."""
    spare = {"description": "string", "additional": "string", "salaryDescriptionPlain": "string", "salaryRange": "struct<currency:string,min:double,max:double,interval:string>"}
    j = j.withColumns({c: F.lit(None).cast(t) for c, t in spare.items() if c not in j.columns})
    blocks = F.array_join(F.transform(F.coalesce("lists", F.array().cast("array<struct<text:string,content:string>>")), lambda x: F.concat_ws("\n", x["text"], x["content"])), "\n\n")
    pay = F.when(F.col("salaryRange").isNotNull(), F.concat_ws(" ", F.col("salaryRange.currency"), F.concat_ws("-", F.col("salaryRange.min").cast("bigint"), F.col("salaryRange.max").cast("bigint")), F.col("salaryRange.interval")))
    kind = F.lower(_or(F.col("workplaceType")))
    return _finish(j, "lever", ats=F.lit("lever"), source_job_id=_or(F.col("id")), company=F.col("employer"), title=_or(F.col("text")), location=_or(F.array_join("categories.allLocations", " | "), F.col("categories.location")), remote=kind == "remote", hybrid=kind == "hybrid", url=_or(F.col("hostedUrl")), apply_url=_or(F.col("applyUrl"), F.col("hostedUrl")), published_at=_epoch(F.col("createdAt")), description=_lines(_or(F.col("descriptionPlain"), F.col("description")), blocks, _or(F.col("additionalPlain"), F.col("additional"))), salary=_or(F.col("salaryDescriptionPlain"), pay), employment_type=_or(F.col("categories.commitment")), tags=F.filter(F.array("categories.team", "categories.department"), lambda x: F.trim(x) != ""))


def recruitee(docs: DataFrame, status: str = "published") -> DataFrame:
    j = _keyed(docs, "subdomains", "offers").select("employer", "j.*").where(F.lower(F.coalesce("status", F.lit(status))) == status)
    pay = F.when(F.col("salary").isNotNull(), F.concat_ws(" ", F.concat_ws("-", F.nullif("salary.min", F.lit("")), F.nullif("salary.max", F.lit(""))), F.col("salary.currency"), F.col("salary.period")))
    return _finish(j, "recruitee", ats=F.lit("recruitee"), source_job_id=_or(F.col("id"), F.col("guid"), F.col("slug")), company=_or(F.col("company_name"), F.col("employer")), title=_or(F.col("title")), location=_or(F.col("location")), remote=F.coalesce("remote", F.lit(False)), hybrid=F.coalesce("hybrid", F.lit(False)), url=_or(F.col("careers_url")), apply_url=_or(F.col("careers_apply_url"), F.col("careers_url")), published_at=_or(F.col("published_at"), F.col("created_at")), description=_lines(F.coalesce("description", F.lit("")), F.coalesce("requirements", F.lit(""))), salary=F.trim(F.coalesce(pay, F.lit(""))), employment_type=_or(F.col("employment_type_code")), tags=F.filter(F.array("department", "category_code", "experience_code"), lambda x: F.trim(x) != ""))


def personio(spark: SparkSession, path: str, account: str, company: str = "", language: str = "en") -> DataFrame:
    """Positions of one account's XML; ``company`` is who they are if a position does not say."""
    j = spark.read.format("xml").schema(PERSONIO).option("rowTag", "position").load(path)
    block = lambda x: F.regexp_replace(F.concat_ws("\n", F.trim(x["name"]), F.trim(x["value"])), r"^\s+|\s+$", "")
    blocks = F.array_join(F.filter(F.transform(F.coalesce("jobDescriptions.jobDescription", F.array().cast("array<struct<name:string,value:string>>")), block), lambda x: x != ""), "\n\n")
    years = F.create_map(*[F.lit(x) for kv in YEARS.items() for x in kv])[F.trim("yearsOfExperience")]
    url = F.concat(F.lit(f"https://{account}.jobs.personio.de/job/"), F.trim("id"), F.lit(f"?language={quote(language)}"))
    both = lambda *c: F.filter(F.transform(F.array(*c), lambda x: F.trim(x)), lambda x: x != "")
    return _finish(j, "personio", ats=F.lit("personio"), source_job_id=_or(F.col("id")), company=_or(F.col("subcompany"), F.lit(company), F.lit(account)), title=_or(F.col("name")), location=_or(F.col("office")), remote=F.lower(_or(F.col("office"))).contains("remote"), url=url, apply_url=url, canonical_url=url, published_at=_or(F.col("createdAt")), description=_lines(blocks, F.coalesce(years, F.lit(""))), employment_type=F.array_join(both("employmentType", "schedule"), " / "), tags=both("department", "recruitingCategory", "seniority", "yearsOfExperience"))


def collection_log(docs: DataFrame, source: str, container: str | None = None, jobs: str | None = None) -> DataFrame:
    """One row per employer (or per document where there are none): whether it was read, how many postings it gave, what failed and with which status."""
    said = F.coalesce(F.nullif("error", F.lit("")), F.concat(F.lit("no valid document: "), F.element_at(F.split("path", "/"), -1)))
    bad = docs.where("doc is null").select(F.lit(source).alias("source"), F.col("owner").alias("employer"), F.lit(False).alias("ok"), F.lit(0).cast("bigint").alias("jobs"), F.lit(1).cast("bigint").alias("requests"), F.coalesce("status", http_status(F.col("error"))).alias("http_status"), F.substring(said, 1, 300).alias("error"))
    good = docs.where("doc is not null")
    if container:
        by = good.select("status", F.explode(f"doc.{container}").alias("employer", "v"))
        n = F.size(f"v.{jobs}" if jobs else "v")
        ok = by.select("employer", "status", (n >= 0).alias("ok"), F.greatest(n, F.lit(0)).cast("bigint").alias("jobs"))
    else:
        n = F.aggregate("doc.pages", F.lit(0), lambda a, p: a + F.greatest(F.size(p["data"]), F.lit(0))) if source == "arbeitnow" else F.greatest(F.size("doc.jobs"), F.lit(0))
        ok = good.select(F.lit(None).cast("string").alias("employer"), "status", F.lit(True).alias("ok"), F.coalesce(n, F.lit(0)).cast("bigint").alias("jobs"))
    ok = ok.select(F.lit(source).alias("source"), "employer", "ok", "jobs", F.lit(1).cast("bigint").alias("requests"), F.col("status").cast("int").alias("http_status"), F.when(F.col("ok"), "").otherwise("no list of postings").alias("error"))
    return ok.unionByName(bad)


def http_status(error: Column) -> Column:
    """The status code named in an error text, or null."""
    return F.nullif(F.regexp_extract(error, STATUS, 1), F.lit("")).try_cast("int")


def failure_rows(answers: DataFrame, source: str, employer: str = "url") -> DataFrame:
    """(source, company, http_status, exception_type, description, message) of the answers of a REST source that failed."""
    short = F.substring(F.regexp_replace(F.trim("error"), r"\s+", " "), 1, 240)
    rows = answers.where(F.coalesce("error", F.lit("")) != "").select(F.lit(source).alias("source"), F.col(employer).alias("company"), F.coalesce("status", http_status(F.col("error"))).alias("http_status"), F.col("error_kind").alias("exception_type"), short.alias("description"))
    return rows.withColumn("message", F.concat_ws(" | ", "source", "company", "exception_type", F.concat(F.lit("HTTP "), F.col("http_status").cast("string")), "description"))


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """All sources in their order, with _ord: unique, rising with source and position."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("_ord", F.lit(k).cast("bigint") * (1 << 52) + F.monotonically_increasing_id())
        out = part if out is None else out.unionByName(part)
    return out
