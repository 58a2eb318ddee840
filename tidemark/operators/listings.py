"""Keyed listing tables: keys, dedupe, filters, scoring replies, upserts and listing queries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.plans.ordered import chunk_by_value, plain, row_index


# Fixed values of the listing tables.
APPLIED = ("submitted", "assisted", "manual")
NOT_STORED = ("skipped", "failed", "dry_run")
EXCLUDED_REASON = "Excluded by company or keyword filter"
SITE_ROOT = {"indeed": "https://www.indeed.com", "naukri": "https://www.naukri.com"}
REPLY_SCHEMA = "score string, reasoning string, skill_overlap array<string>, gaps array<string>, recommended boolean"
PROFILE_SCHEMA = "summary string, skills array<string>, experience_years double, preferred_titles array<string>"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def job_key(portal: Column, job_id: Column, url: Column) -> Column:
    """portal:stable-id. The query string is searched too, so an Indeed ``jk`` is found wherever it stands."""
    bare = F.regexp_replace(F.regexp_replace(url, r"\?.*$", ""), r"/+$", "")
    linkedin = F.coalesce(_found(bare, r"(\d{6,})$"), _found(job_id, r"currentJobId=(\d+)"))
    naukri = F.coalesce(_found(bare, r"job-listings-(\d+)"), _found(bare, r"(\d{6,})$"))
    indeed = F.coalesce(_found(url, r"jk=([a-f0-9]+)"), _found(job_id, r"jk=([a-f0-9]+)"), _found(job_id, r"^([a-f0-9]+)$"))
    special = F.when(portal == "linkedin", linkedin).when(portal == "naukri", naukri).when(portal == "indeed", indeed)
    slug = _found(bare, r"([^/]*)$")
    short = F.when(F.length(slug) < 120, slug)
    cleaned = F.nullif(F.substring(F.regexp_replace(job_id, r"[^\w\-]", "_"), 1, 120), F.lit(""))
    return F.concat(portal, F.lit(":"), F.coalesce(special, short, cleaned, bare))


def portal_job_id(portal: Column, url: Column) -> Column:
    """The id a portal's url carries, else its last segment (LinkedIn) or the url itself."""
    last = F.regexp_extract(F.regexp_replace(url, r"/+$", ""), r"([^/]*)$", 1)
    linkedin = F.coalesce(_found(url, r"currentJobId=(\d+)|/view/(\d+)", 1), _found(url, r"currentJobId=(\d+)|/view/(\d+)", 2), last)
    naukri = F.coalesce(_found(url, r"job-listings-(\d+)|/(\d+)(?:\?|$)", 1), _found(url, r"job-listings-(\d+)|/(\d+)(?:\?|$)", 2), url)
    indeed = F.coalesce(_found(url, r"jk=([a-f0-9]+)"), url)
    return F.when(portal == "linkedin", linkedin).when(portal == "naukri", naukri).when(portal == "indeed", indeed).otherwise(url)


def clean_listings(df: DataFrame) -> DataFrame:
    """Absolute urls, trimmed titles (untitled rows go), 'Unknown' company, LinkedIn urls without query."""
    fixed = F.col("url")
    for portal, root in SITE_ROOT.items():
        relative = ~F.col("url").startswith("http") if portal == "naukri" else F.col("url").startswith("/")
        fixed = F.when((F.col("portal") == portal) & relative, F.concat(F.lit(root), F.col("url"))).otherwise(fixed)
    company = F.coalesce(F.nullif(F.trim("company"), F.lit("")), F.lit("Unknown"))
    out = df.withColumn("title", F.trim("title")).filter((F.col("title") != "") & F.col("url").isNotNull())
    out = out.withColumn("url", fixed).withColumn("company", company).withColumn("job_id", portal_job_id(F.col("portal"), F.col("url")))
    return out.withColumn("url", F.when(F.col("portal") == "linkedin", F.regexp_replace("url", r"\?.*$", "")).otherwise(F.col("url")))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], largest: bool = False) -> DataFrame:
    """One row per key by smallest (or largest) ``order``. Combined before the shuffle, so a hot key is no problem."""
    rank = F.struct(*[F.col(o) for o in order])
    pick = (F.max_by if largest else F.min_by)(F.struct(*[c for c in df.columns]), rank)
    return df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(pick.alias("_row")).select("_row.*")


def dedupe_listings(df: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """First seen per (portal, job_id); ``limit`` keeps the first n of each portal, as a scan does."""
    unique = first_rows(df, ["portal", "job_id"], [order])
    if limit is None:
        return unique
    ranked = row_index(chunk_by_value(unique, order), ["portal"], [order], "_n")
    return plain(ranked.df.filter(F.col("_n") <= limit).drop("_n"))


def posted_days(text: Column) -> Column:
    """'3 days ago' -> 3, today and hours -> 0, yesterday -> 1, else null."""
    t = F.lower(F.trim(text))
    days = _found(t, r"(\d+)\s*days?\s*ago")
    return (F.when(days.isNotNull(), days.cast("int")).when(t.rlike("today"), 0).when(t.rlike("yesterday"), 1)
            .when(t.rlike(r"\d+\s*(hours?|hrs?)\s*ago"), 0))


def recent_listings(df: DataFrame, max_days: int, col: str = "posted") -> DataFrame:
    """Drop rows known to be older than ``max_days``; unknown ages stay."""
    age = posted_days(F.col(col))
    return df.filter(age.isNull() | (age <= max_days))


def drop_deleted(df: DataFrame, jobs: DataFrame, key: str = "id") -> DataFrame:
    """Remove listings whose key is tombstoned: one anti join."""
    dead = jobs.filter(F.col("deleted_at").isNotNull()).select(key)
    return df.join(dead, key, "left_anti")


JOB_FIELDS = ("title", "company", "location", "url", "scraped_at")
SCORE_FIELDS = ("match_score", "reasoning", "skill_overlap", "gaps", "recommended")


def _fold_batch(batch: DataFrame, order: str, fields: Sequence[str], keep_posted: bool) -> DataFrame:
    """One change per key, as if the batch rows had been applied in ``order``.

    The last row gives the plain fields; the longest description wins, the first of equal ones; with
    ``keep_posted`` the last non-null ``posted`` wins. Everything is an aggregate with partial combining.
    """
    rank = F.col(order)
    size = F.coalesce(F.length("description"), F.lit(-1))
    last_posted = F.max_by("posted", F.when(F.col("posted").isNotNull(), rank)) if keep_posted else F.min_by("posted", rank)
    aggs = [F.max_by(F.struct(*fields), rank).alias("_last"),
            F.min_by(F.struct("portal", "job_id"), rank).alias("_first"),
            F.max_by("description", F.struct(size, -rank)).alias("description"),
            last_posted.alias("posted")]
    return batch.groupBy("id").agg(*aggs).select("id", "_first.*", "_last.*", "description", "posted")


def _merge_jobs(jobs: DataFrame, changes: DataFrame, now: Column, fields: Sequence[str], keep_posted: bool) -> DataFrame:
    new = changes.select(*[F.col(c).alias(f"n_{c}") for c in changes.columns])
    both = jobs.join(new, jobs["id"] == new["n_id"], "full_outer")
    hit, fresh = F.col("n_id").isNotNull(), F.col("id").isNull()
    longer = F.coalesce(F.length("n_description"), F.lit(-1)) > F.coalesce(F.length("description"), F.lit(-1))
    cells = {
        "id": F.coalesce("id", "n_id"), "portal": F.coalesce("portal", "n_portal"), "job_id": F.coalesce("job_id", "n_job_id"),
        "description": F.when(hit & longer, F.col("n_description")).otherwise(F.col("description")),
        "posted": F.when(fresh, F.col("n_posted")).otherwise(F.when(hit & F.lit(keep_posted), F.coalesce("n_posted", "posted")).otherwise(F.col("posted"))),
        "created_at": F.when(fresh, now).otherwise(F.col("created_at")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        "deleted_at": F.col("deleted_at")}
    for f in fields:
        cells[f] = F.when(hit, F.col(f"n_{f}")).otherwise(F.col(f))
    # A listing without a score starts at 0 with empty lists.
    empty = {"match_score": F.lit(0), "reasoning": F.lit(""), "skill_overlap": F.array().cast("array<string>"),
             "gaps": F.array().cast("array<string>"), "recommended": F.lit(False)}
    for f in SCORE_FIELDS:
        if f not in cells:
            cells[f] = F.when(fresh, empty[f]).otherwise(F.col(f))
    return both.select(*[cells[c].alias(c) for c in jobs.columns])


def upsert_matches(jobs: DataFrame, batch: DataFrame, now: Column, order: str) -> DataFrame:
    """Insert or update by key: the longer description wins, ``posted`` is kept when the new one is null,
    creation time and tombstone stay."""
    fields = [*JOB_FIELDS, *SCORE_FIELDS]
    return _merge_jobs(jobs, _fold_batch(batch, order, fields, True), now, fields, True)


def upsert_listings(jobs: DataFrame, batch: DataFrame, now: Column, order: str) -> DataFrame:
    """As above without touching the scores; an existing ``posted`` is not updated."""
    return _merge_jobs(jobs, _fold_batch(batch, order, JOB_FIELDS, False), now, JOB_FIELDS, False)


def soft_delete(jobs: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Tombstone the given ids."""
    marks = keys.select("id").distinct().withColumn("_hit", F.lit(True))
    out = jobs.join(marks, "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return out.select(*[F.when(hit, now).otherwise(F.col(c)).alias(c) if c in ("deleted_at", "updated_at") else F.col(c) for c in jobs.columns])


def update_description(jobs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Replace descriptions by id from (id, description), one row per id."""
    new = changes.select("id", F.col("description").alias("_d"), F.lit(True).alias("_hit"))
    out = jobs.join(new, "id", "left")
    cells = {"description": F.col("_d"), "updated_at": now}
    return out.select(*[F.when(F.col("_hit"), cells[c]).otherwise(F.col(c)).alias(c) if c in cells else F.col(c) for c in jobs.columns])


def is_applied(status: Column) -> Column:
    return F.coalesce(status.isin(*APPLIED), F.lit(False))


def record_applications(applications: DataFrame, records: DataFrame, order: str) -> DataFrame:
    """Upsert (job_pk, status, message, applied_at); skipped, failed and dry-run records are not stored."""
    cols = ["job_pk", "status", "message", "applied_at"]
    kept = first_rows(records.filter(~F.col("status").isin(*NOT_STORED)).select(*cols, order), ["job_pk"], [order], largest=True)
    new = kept.select(*[F.col(c).alias(f"n_{c}") for c in cols])
    both = applications.select(*cols).join(new, F.col("job_pk") == F.col("n_job_pk"), "full_outer")
    hit = F.col("n_job_pk").isNotNull()
    return both.select(*[F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def mark_manual(keys: DataFrame, now: Column, message: str = "Marked applied via UI") -> DataFrame:
    """Application records for jobs applied to by hand."""
    return keys.select(F.col("id").alias("job_pk"), F.lit("manual").alias("status"), F.lit(message).alias("message"), now.alias("applied_at"))


def to_apply(matches: DataFrame, applications: DataFrame, dry_run: bool = False) -> DataFrame:
    """Recommended matches (all in a dry run) not applied to yet; the rest get status 'skipped'."""
    wanted = matches if dry_run else matches.filter("recommended")
    done = applications.filter(is_applied(F.col("status"))).select(F.col("job_pk").alias("id"), F.lit(True).alias("_done"))
    status = F.when(F.col("_done"), "skipped").otherwise("dry_run" if dry_run else "pending")
    return wanted.join(done, "id", "left").withColumn("status", status).drop("_done")


def _with_status(jobs: DataFrame, applications: DataFrame) -> DataFrame:
    a = applications.select(F.col("job_pk").alias("_pk"), F.col("status").alias("apply_status"),
                            F.col("message").alias("apply_message"), "applied_at")
    return jobs.join(a, jobs["id"] == a["_pk"], "left").drop("_pk")


def _like(col: str, text: str) -> Column:
    # Pattern characters in the search text keep their meaning, as in the SQL form.
    return F.col(col).ilike(f"%{text}%")


def list_jobs(jobs: DataFrame, applications: DataFrame, portal: str | None = None, applied: bool | None = None,
              min_score: int = 0, search: str = "", limit: int | None = 200, offset: int = 0,
              include_deleted: bool = False) -> DataFrame:
    """Filtered page of jobs with application status, best score first, then latest update, then id.

    The job filters precede the join and reach the scan; sort, limit and offset are one top-n.
    """
    rows = jobs.filter(F.col("match_score") >= min_score)
    if not include_deleted:
        rows = rows.filter(F.col("deleted_at").isNull())
    if portal:
        rows = rows.filter(F.col("portal") == portal)
    if search:
        rows = rows.filter(_like("title", search) | _like("company", search) | _like("description", search))
    out = _with_status(rows, applications)
    if applied is not None:
        out = out.filter(is_applied(F.col("apply_status")) == F.lit(applied))
    out = out.orderBy(F.desc("match_score"), F.desc("updated_at"), "id")
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def get_job(jobs: DataFrame, applications: DataFrame, job_pk: str) -> DataFrame:
    """One job with its application status."""
    return _with_status(jobs.filter(F.col("id") == job_pk), applications.filter(F.col("job_pk") == job_pk))


def job_stats(jobs: DataFrame, applications: DataFrame) -> DataFrame:
    """Totals in one pass over the joined table."""
    rows = _with_status(jobs.select("id", "deleted_at", "recommended", F.length("description").alias("_len")), applications)
    live = F.col("deleted_at").isNull()
    return rows.agg(F.count_if(live).alias("total"), F.count_if(~live).alias("deleted"),
                    F.count_if(live & is_applied(F.col("apply_status"))).alias("applied"),
                    F.count_if(live & F.col("recommended")).alias("recommended"),
                    F.count_if(live & (F.col("_len") > 50)).alias("with_description"))


def decorate_jobs(df: DataFrame) -> DataFrame:
    """Parse JSON-text lists and add the flags and score band shown to a reader."""
    out = df
    for c, t in df.dtypes:
        if c in ("skill_overlap", "gaps") and t == "string":
            out = out.withColumn(c, F.coalesce(F.from_json(F.col(c), "array<string>"), F.array().cast("array<string>")))
    band = F.when(F.col("match_score") >= 80, "score-high").when(F.col("match_score") >= 60, "score-mid").otherwise("score-low")
    return (out.withColumn("recommended", F.coalesce(F.col("recommended").cast("boolean"), F.lit(False)))
            .withColumn("is_applied", is_applied(F.col("apply_status")))
            .withColumn("has_description", F.coalesce(F.length("description"), F.lit(0)) > 50)
            .withColumn("is_deleted", F.col("deleted_at").isNotNull()).withColumn("score_band", band))


def location_filter(df: DataFrame, locations: Sequence[str], col: str = "location") -> DataFrame:
    """Any preferred location is a substring, ignoring case; no preference keeps everything."""
    if not locations:
        return df
    text = F.lower(F.col(col))
    return df.filter(sum((text.contains(x.lower()).cast("int") for x in locations), F.lit(0)) > 0)


def is_excluded(companies: Sequence[str], keywords: Sequence[str]) -> Column:
    """Company substring, or keyword in the title or description (the title stands in for an empty one)."""
    company, title = F.lower("company"), F.lower("title")
    body = F.lower(F.coalesce(F.nullif("description", F.lit("")), F.col("title")))
    tests = [company.contains(c.lower()) for c in companies]
    tests += [title.contains(k.lower()) | body.contains(k.lower()) for k in keywords]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def extract_json(reply: Column) -> Column:
    """JSON text of a model reply: a fenced block, else the whole, else first '{' to last '}'."""
    text = F.trim(reply)
    fenced = _found(text, r"(?is)```(?:json)?\s*(.*?)\s*```")
    body = F.trim(F.coalesce(fenced, text))
    braces = _found(body, r"(?s)(\{.*\})")
    return F.coalesce(F.when(body.startswith("{") & body.endswith("}"), body), braces, F.lit("{}"))


def apply_match_replies(listings: DataFrame, replies: DataFrame, min_score: int = 70, companies: Sequence[str] = (),
                        keywords: Sequence[str] = (), key: str = "id") -> DataFrame:
    """Join listings to scorer replies (key, reply): score clamped to 0..100, recommended by score or flag.

    Excluded listings stay with score 0 and a reason. A broken reply counts as an empty one.
    """
    both = listings.join(replies.select(key, "reply"), key, "left")
    data = F.from_json(extract_json(F.coalesce("reply", F.lit("{}"))), REPLY_SCHEMA)
    both = both.withColumn("_x", is_excluded(companies, keywords)).withColumn("_d", data)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.col("_d.score").try_cast("double").cast("int"), F.lit(0))))
    score = F.when(F.col("_x"), 0).otherwise(score)
    none = F.array().cast("array<string>")
    lists = lambda c: F.when(F.col("_x"), none).otherwise(F.coalesce(F.col(f"_d.{c}"), none))
    return (both.withColumn("match_score", score)
            .withColumn("reasoning", F.when(F.col("_x"), EXCLUDED_REASON).otherwise(F.coalesce("_d.reasoning", F.lit(""))))
            .withColumn("skill_overlap", lists("skill_overlap")).withColumn("gaps", lists("gaps"))
            .withColumn("recommended", ~F.col("_x") & ((F.col("match_score") >= min_score) | F.coalesce("_d.recommended", F.lit(False))))
            .drop("_x", "_d", "reply"))


def rank_matches(matches: DataFrame, position: str, top: int | None = None, recommended_only: bool = False) -> DataFrame:
    """Best score first, input order among equals; ``top`` is a top-n."""
    rows = matches.filter("recommended") if recommended_only else matches
    out = rows.orderBy(F.desc("match_score"), position)
    return out if top is None else out.limit(top)


def profile_from_reply(df: DataFrame, raw: str = "raw_text", reply: str = "reply") -> DataFrame:
    """Parsed profile reply; the whole raw text is kept."""
    data = F.from_json(extract_json(F.coalesce(F.col(reply), F.lit("{}"))), PROFILE_SCHEMA)
    none = F.array().cast("array<string>")
    out = df.withColumn("_d", data)
    return (out.withColumn("raw_text", F.col(raw)).withColumn("summary", F.coalesce("_d.summary", F.lit("")))
            .withColumn("skills", F.coalesce("_d.skills", none)).withColumn("experience_years", F.col("_d.experience_years"))
            .withColumn("preferred_titles", F.coalesce("_d.preferred_titles", none)).drop("_d"))


class _FirstMatch(HTMLParser):
    """Text of the first element that matches one of (tag, class or id). A closing tag also closes what was left open inside."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    MUTED = {"script", "style"}

    def __init__(self, selectors: Sequence[tuple[str, str, str]]):
        super().__init__(convert_charrefs=True)
        self.selectors, self.open, self.done, self.parts = selectors, [], False, []

    def _hit(self, tag: str, attrs: dict) -> bool:
        for want_tag, kind, want in self.selectors:
            value = attrs.get(kind) or ""
            if (not want_tag or tag == want_tag) and (not want or (want in value.split() if kind == "class" else want == value)):
                return True
        return False

    def handle_starttag(self, tag, attrs):
        if not self.done and tag not in self.VOID and (self.open or self._hit(tag, dict(attrs))):
            self.open.append(tag)

    def handle_endtag(self, tag):
        if not self.done and tag in self.open:
            while self.open.pop() != tag:
                pass
            self.done = not self.open

    def handle_data(self, data):
        if self.open and not self.done and not self.MUTED.intersection(self.open):
            self.parts.append(data)


# Where each portal keeps its description (tag, attribute, value).
DESCRIPTION_SELECTORS = {
    "linkedin": (("div", "class", "show-more-less-html__markup"), ("div", "class", "description__text"),
                 ("article", "class", "jobs-description__container")),
    "naukri": (("div", "class", "dang-inner-html"), ("section", "class", "job-desc")),
    "indeed": (("", "id", "jobDescriptionText"), ("div", "class", "jobsearch-jobDescriptionText")),
}


def page_descriptions(pages: DataFrame, selectors: dict | None = None, max_chars: int | None = None) -> DataFrame:
    """(id, portal, html) -> (id, text): text of the first element matching the portal's selectors, trimmed.

    Pages that hold none of the wanted tags, classes or ids have no text and are not parsed; the others are read whole, batch by batch
    inside the tasks. ``max_chars`` shortens the result when asked.
    """
    table = selectors or DESCRIPTION_SELECTORS
    wanted = [(F.col("portal") == portal) & F.contains(F.lower("html"), F.lit((want or f"<{tag}").lower())) for portal, found in table.items() for tag, _, want in found]
    html = F.when(reduce(lambda x, y: x | y, wanted), F.col("html")) if wanted else F.lit(None).cast("string")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for portal, html in zip(batch.column("portal").to_pylist(), batch.column("html").to_pylist()):
                if portal not in table or html is None:
                    texts.append("")
                    continue
                parser = _FirstMatch(table[portal])
                parser.feed(html)
                text = "".join(parser.parts).strip()
                texts.append(text if max_chars is None else text[:max_chars])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    id_type = dict(pages.dtypes)["id"]
    return pages.select("id", "portal", html.alias("html")).mapInArrow(parse, f"id {id_type}, text string")


def fill_descriptions(jobs: DataFrame, pages: DataFrame, selectors: dict | None = None, max_chars: int | None = None) -> DataFrame:
    """Take the page text where the stored description has at most 50 characters."""
    short = jobs.filter(F.coalesce(F.length("description"), F.lit(0)) <= 50).select("id", "portal")
    text = page_descriptions(short.join(pages.select("id", "html"), "id"), selectors, max_chars)
    out = jobs.join(text.filter(F.col("text") != "").withColumnRenamed("text", "_t"), "id", "left")
    return out.select(*[F.coalesce("_t", "description").alias(c) if c == "description" else F.col(c) for c in jobs.columns])


def import_matches(raw: DataFrame) -> DataFrame:
    """Items either nested under ``job`` or flat -> match rows with defaults; see sources.read_matches_json."""
    have = dict(raw.dtypes)
    cols = ("portal", "job_id", "title", "company", "location", "url", "description", "posted", "scraped_at")
    nested = {f.name for f in raw.schema["job"].dataType.fields} if "job" in have else set()

    def pick(c: str) -> Column:
        options = [F.col(f"job.{c}")] if c in nested else []
        options += [F.when(F.col("job").isNull(), F.col(c)) if nested else F.col(c)] if c in have else []
        return F.coalesce(*options).cast("string") if options else F.lit(None).cast("string")

    none = F.array().cast("array<string>")
    return raw.select(
        *[pick(c).alias(c) for c in cols],
        F.coalesce(F.col("score").cast("int"), F.lit(0)).alias("match_score"), F.coalesce("reasoning", F.lit("")).alias("reasoning"),
        F.coalesce("skill_overlap", none).alias("skill_overlap"), F.coalesce("gaps", none).alias("gaps"),
        F.coalesce("recommended", F.lit(False)).alias("recommended"))
