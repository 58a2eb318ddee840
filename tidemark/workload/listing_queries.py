"""Listing-table operators over listings built from pages and documents, and chat operators over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import corpus as C, listings as L
from tidemark.sources.tables import load
from tidemark.workload.base import query

def now():
    """The time of the change, fixed so that SQL can repeat it."""
    return F.lit("2024-06-01 00:00:00")


def raw_listings(spark, d):
    """One listing per page, with repeated ids, relative urls, blank titles and companies, and every kind of age."""
    p = load(spark, d, "pages").select(F.col("page_id").alias("pid"), "url")
    n = F.col("pid")
    text = load(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.col("text").alias("body"))
    s = lambda c: c.cast("string")
    portal = F.when(n % 3 == 0, "linkedin").when(n % 3 == 1, "indeed").otherwise("naukri")
    url = (F.when(n % 3 == 0, F.concat(F.lit("https://site.example/jobs/view/"), s(1000000 + n % 90), F.lit("?ref=x")))
           .when(n % 3 == 1, F.concat(F.when(n % 2 == 0, F.lit("https://jobs.example")).otherwise(F.lit("")), F.lit("/viewjob?from=a&jk="), F.substring(F.md5(s(n % 70)), 1, 16)))
           .otherwise(F.concat(F.when(n % 2 == 0, F.lit("https://work.example")).otherwise(F.lit("")), F.lit("/job-listings-"), s(500000 + n % 80))))
    posted = (F.when(n % 7 == 0, F.concat(s(n % 15), F.lit(" Days ago"))).when(n % 7 == 1, "Today").when(n % 7 == 2, "yesterday").when(n % 7 == 3, "5 hours ago").when(n % 7 == 4, ""))
    return p.join(text, "pid", "left").select(
        "pid", portal.alias("portal"), F.when(n % 17 == 0, "  ").otherwise(F.concat(F.lit(" Role "), s(n % 11), F.lit(" "))).alias("title"),
        F.when(n % 5 == 0, " ").otherwise(F.concat(F.lit("Company "), s(n % 13))).alias("company"),
        F.when(n % 4 == 0, "Pune, India").when(n % 4 == 1, "Remote").when(n % 4 == 2, "Berlin").otherwise("New York").alias("location"), url.alias("url"),
        F.when(n % 6 == 0, F.lit("short")).otherwise(F.coalesce("body", F.lit(""))).alias("description"), posted.alias("posted"), F.lpad(s(n), 8, "0").alias("scraped_at"))


RAW = """raw AS (SELECT page_id AS pid, CASE page_id % 3 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' ELSE 'naukri' END AS portal,
  CASE WHEN page_id % 17 = 0 THEN '  ' ELSE ' Role ' || (page_id % 11) || ' ' END AS title, CASE WHEN page_id % 5 = 0 THEN ' ' ELSE 'Company ' || (page_id % 13) END AS company,
  CASE page_id % 4 WHEN 0 THEN 'Pune, India' WHEN 1 THEN 'Remote' WHEN 2 THEN 'Berlin' ELSE 'New York' END AS location,
  CASE page_id % 3 WHEN 0 THEN 'https://site.example/jobs/view/' || (1000000 + page_id % 90) || '?ref=x'
    WHEN 1 THEN (CASE WHEN page_id % 2 = 0 THEN 'https://jobs.example' ELSE '' END) || '/viewjob?from=a&jk=' || substr(md5((page_id % 70)::VARCHAR), 1, 16)
    ELSE (CASE WHEN page_id % 2 = 0 THEN 'https://work.example' ELSE '' END) || '/job-listings-' || (500000 + page_id % 80) END AS url,
  CASE WHEN page_id % 6 = 0 THEN 'short' ELSE coalesce(d.text, '') END AS description,
  CASE page_id % 7 WHEN 0 THEN (page_id % 15) || ' Days ago' WHEN 1 THEN 'Today' WHEN 2 THEN 'yesterday' WHEN 3 THEN '5 hours ago' WHEN 4 THEN '' END AS posted, lpad(page_id::VARCHAR, 8, '0') AS scraped_at
  FROM pages LEFT JOIN documents d ON d.doc_id = page_id),
 cl AS (SELECT * EXCLUDE (url), CASE WHEN portal = 'linkedin' THEN split_part(url, '?', 1) ELSE url END AS url FROM (SELECT pid, portal, trim(title) AS title, coalesce(nullif(trim(company), ''), 'Unknown') AS company, location,
   CASE WHEN portal = 'indeed' AND url LIKE '/%' THEN 'https://www.indeed.com' || url WHEN portal = 'naukri' AND url LIKE '/%' THEN 'https://www.naukri.com' || url ELSE url END AS url, description, posted, scraped_at,
   CASE portal WHEN 'linkedin' THEN (1000000 + pid % 90)::VARCHAR WHEN 'indeed' THEN substr(md5((pid % 70)::VARCHAR), 1, 16) ELSE (500000 + pid % 80)::VARCHAR END AS job_id FROM raw) WHERE title <> ''),
 li AS (SELECT *, portal || ':' || job_id AS id FROM cl)"""


def listings(spark, d):
    clean = L.clean_listings(raw_listings(spark, d))
    return clean.withColumn("id", L.job_key(F.col("portal"), F.col("job_id"), F.col("url")))


def scored(spark, d):
    """Listings with scores, as matches."""
    n = F.col("pid")
    return listings(spark, d).withColumn("match_score", (n * 37 % 101).cast("int")).withColumn("reasoning", F.concat(F.lit("because "), n.cast("string"))).withColumn(
        "skill_overlap", F.array(F.lit("sql"), (n % 5).cast("string"))).withColumn("gaps", F.array(F.concat(F.lit("g"), (n % 3).cast("string")))).withColumn("recommended", F.col("match_score") >= 70)


SC = RAW + """, sc AS (SELECT *, (pid * 37 % 101)::INT AS match_score, 'because ' || pid AS reasoning, ['sql', (pid % 5)::VARCHAR] AS skill_overlap, ['g' || (pid % 3)] AS gaps, pid * 37 % 101 >= 70 AS recommended FROM li)"""
JOB_COLS = ["id", "portal", "job_id", "title", "company", "location", "url", "description", "posted", "scraped_at", "match_score", "reasoning", "skill_overlap", "gaps", "recommended", "created_at", "updated_at", "deleted_at"]


def stored(spark, d):
    """The job table as left by an earlier scan of every other page; some rows are tombstoned."""
    one = L.first_rows(scored(spark, d).filter("pid % 2 = 0"), ["id"], ["pid"])
    dead = F.when(F.col("pid") % 9 == 0, "2024-05-05 00:00:00")
    return one.withColumn("created_at", F.lit("2024-05-01 00:00:00")).withColumn("updated_at", F.concat(F.lit("2024-05-02 00:00:"), F.lpad((F.col("pid") % 60).cast("string"), 2, "0"))).withColumn("deleted_at", dead).select(*JOB_COLS)


ST = SC + """, so AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pid) AS rn FROM sc WHERE pid % 2 = 0),
 st AS (SELECT id, portal, job_id, title, company, location, url, description, posted, scraped_at, match_score, reasoning, skill_overlap, gaps, recommended, '2024-05-01 00:00:00' AS created_at,
  '2024-05-02 00:00:' || lpad((pid % 60)::VARCHAR, 2, '0') AS updated_at, CASE WHEN pid % 9 = 0 THEN '2024-05-05 00:00:00' END AS deleted_at FROM so WHERE rn = 1)"""


def applications(spark, d):
    one = stored(spark, d).withColumn("_h", F.conv(F.substring(F.md5("id"), 1, 2), 16, 10).cast("int"))
    status = F.when(F.col("_h") % 4 == 0, "submitted").when(F.col("_h") % 4 == 1, "failed").when(F.col("_h") % 4 == 2, "manual")
    return one.withColumn("status", status).filter("status IS NOT NULL").select(F.col("id").alias("job_pk"), "status", F.lit("m").alias("message"), F.lit("2024-05-03").alias("applied_at"))


AP = ST + """, ap AS (SELECT id AS job_pk, CASE h % 4 WHEN 0 THEN 'submitted' WHEN 1 THEN 'failed' ELSE 'manual' END AS status, 'm' AS message, '2024-05-03' AS applied_at
  FROM (SELECT id, ('0x' || substr(md5(id), 1, 2))::INT AS h FROM st) WHERE h % 4 <> 3)"""


@query("clean_listings", f"WITH {RAW} SELECT pid, portal, title, company, url, job_id FROM cl")
def _(spark, d):
    return L.clean_listings(raw_listings(spark, d)).select("pid", "portal", "title", "company", "url", "job_id")


@query("job_key", f"""WITH {RAW}, k AS (SELECT pid, id FROM li) SELECT * FROM k UNION ALL
SELECT page_id + 1000000, 'other:' || CASE WHEN regexp_extract(rtrim(regexp_replace(url, '[?].*$', ''), '/'), '([^/]*)$', 1) <> '' THEN regexp_extract(rtrim(regexp_replace(url, '[?].*$', ''), '/'), '([^/]*)$', 1) ELSE page_id::VARCHAR END FROM pages""")
def _(spark, d):
    other = load(spark, d, "pages").select((F.col("page_id") + 1000000).alias("pid"), L.job_key(F.lit("other"), F.col("page_id").cast("string"), F.col("url")).alias("id"))
    return listings(spark, d).select("pid", "id").unionByName(other)


@query("portal_job_id", f"WITH {RAW} SELECT pid, job_id FROM cl")
def _(spark, d):
    return listings(spark, d).select("pid", L.portal_job_id(F.col("portal"), F.col("url")).alias("job_id"))


@query("dedupe_listings", f"WITH {RAW} SELECT portal, job_id, min(pid) AS pid, arg_min(title, pid) AS title FROM li GROUP BY ALL")
def _(spark, d):
    return L.dedupe_listings(listings(spark, d), "pid").select("portal", "job_id", "pid", "title")


@query("dedupe_listings_top", f"WITH {RAW}, u AS (SELECT portal, job_id, min(pid) AS pid FROM li GROUP BY ALL) SELECT portal, job_id, pid FROM u QUALIFY row_number() OVER (PARTITION BY portal ORDER BY pid) <= 25")
def _(spark, d):
    return L.dedupe_listings(listings(spark, d), "pid", 25).select("portal", "job_id", "pid")


@query("posted_days", f"""WITH {RAW}, a AS (SELECT pid, CASE WHEN regexp_matches(lower(posted), '[0-9]+ days ago') THEN regexp_extract(posted, '[0-9]+')::INT WHEN lower(posted) LIKE '%today%' THEN 0 WHEN lower(posted) LIKE '%yesterday%' THEN 1
  WHEN posted LIKE '%hours ago%' THEN 0 END AS days FROM raw) SELECT pid, days FROM a WHERE days IS NULL OR days <= 7""")
def _(spark, d):
    return L.recent_listings(raw_listings(spark, d), 7).select("pid", L.posted_days(F.col("posted")).alias("days"))


@query("drop_deleted", f"WITH {ST} SELECT li.pid, li.id FROM li WHERE id NOT IN (SELECT id FROM st WHERE deleted_at IS NOT NULL)")
def _(spark, d):
    return L.drop_deleted(listings(spark, d), stored(spark, d)).select("pid", "id")


FOLD = """, fo AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pid DESC) AS last, row_number() OVER (PARTITION BY id ORDER BY length(description) DESC, pid) AS lng, row_number() OVER (PARTITION BY id ORDER BY posted IS NULL, pid DESC) AS pst,
   row_number() OVER (PARTITION BY id ORDER BY pid) AS first FROM sc),
 nw AS (SELECT a.id, a.portal, a.job_id, a.title, a.company, a.location, a.url, a.scraped_at, a.match_score, a.reasoning, a.skill_overlap, a.gaps, a.recommended, b.description, c.posted, f.posted AS first_posted
  FROM fo a JOIN fo b ON b.id = a.id AND b.lng = 1 JOIN fo c ON c.id = a.id AND c.pst = 1 JOIN fo f ON f.id = a.id AND f.first = 1 WHERE a.last = 1)"""


@query("upsert_matches", f"""WITH {ST} {FOLD} SELECT nw.id, nw.portal, nw.job_id, nw.title, nw.company, nw.location, nw.url, CASE WHEN st.id IS NULL OR length(nw.description) > length(st.description) THEN nw.description ELSE st.description END AS description,
  coalesce(nw.posted, st.posted) AS posted, nw.scraped_at, nw.match_score, nw.reasoning, nw.skill_overlap, nw.gaps, nw.recommended, coalesce(st.created_at, '2024-06-01 00:00:00') AS created_at, '2024-06-01 00:00:00' AS updated_at, st.deleted_at
  FROM nw LEFT JOIN st USING (id)""")
def _(spark, d):
    return L.upsert_matches(stored(spark, d), scored(spark, d), now(), "pid")


@query("upsert_listings", f"""WITH {ST} {FOLD} SELECT nw.id, nw.title, CASE WHEN st.id IS NULL OR length(nw.description) > length(st.description) THEN nw.description ELSE st.description END AS description,
  CASE WHEN st.id IS NULL THEN nw.first_posted ELSE st.posted END AS posted, coalesce(st.match_score, 0) AS match_score, coalesce(st.reasoning, '') AS reasoning, coalesce(st.recommended, false) AS recommended, coalesce(st.created_at, '2024-06-01 00:00:00') AS created_at, st.deleted_at FROM nw LEFT JOIN st USING (id)""")
def _(spark, d):
    out = L.upsert_listings(stored(spark, d), listings(spark, d), now(), "pid")
    return out.select("id", "title", "description", "posted", "match_score", "reasoning", "recommended", "created_at", "deleted_at")


@query("soft_delete", f"WITH {ST} SELECT id, CASE WHEN match_score < 20 THEN '2024-06-01 00:00:00' ELSE deleted_at END AS deleted_at, CASE WHEN match_score < 20 THEN '2024-06-01 00:00:00' ELSE updated_at END AS updated_at FROM st")
def _(spark, d):
    jobs = stored(spark, d)
    return L.soft_delete(jobs, jobs.filter("match_score < 20"), now()).select("id", "deleted_at", "updated_at")


@query("update_description", f"WITH {ST} SELECT id, CASE WHEN match_score < 20 THEN 'new text' ELSE description END AS description, CASE WHEN match_score < 20 THEN '2024-06-01 00:00:00' ELSE updated_at END AS updated_at FROM st")
def _(spark, d):
    jobs = stored(spark, d)
    return L.update_description(jobs, jobs.filter("match_score < 20").select("id", F.lit("new text").alias("description")), now()).select("id", "description", "updated_at")


@query("record_applications", f"""WITH {AP}, rec AS (SELECT id AS job_pk, CASE pid % 5 WHEN 0 THEN 'submitted' WHEN 1 THEN 'skipped' WHEN 2 THEN 'failed' WHEN 3 THEN 'dry_run' ELSE 'assisted' END AS status, 'r' || pid AS message, '2024-06-01' AS applied_at, pid FROM li),
 k AS (SELECT * FROM rec WHERE status IN ('submitted', 'assisted') QUALIFY row_number() OVER (PARTITION BY job_pk ORDER BY pid DESC) = 1)
SELECT coalesce(k.job_pk, ap.job_pk) AS job_pk, coalesce(k.status, ap.status) AS status, coalesce(k.message, ap.message) AS message, coalesce(k.applied_at, ap.applied_at) AS applied_at FROM ap FULL JOIN k ON k.job_pk = ap.job_pk""")
def _(spark, d):
    n = F.col("pid")
    status = F.when(n % 5 == 0, "submitted").when(n % 5 == 1, "skipped").when(n % 5 == 2, "failed").when(n % 5 == 3, "dry_run").otherwise("assisted")
    rec = listings(spark, d).select(F.col("id").alias("job_pk"), status.alias("status"), F.concat(F.lit("r"), n.cast("string")).alias("message"), F.lit("2024-06-01").alias("applied_at"), "pid")
    return L.record_applications(applications(spark, d), rec, "pid")


@query("mark_manual", f"""WITH {AP} SELECT job_pk, CASE WHEN match_score >= 90 THEN 'manual' ELSE status END AS status FROM ap JOIN st ON st.id = job_pk UNION SELECT id, 'manual' FROM st WHERE match_score >= 90""")
def _(spark, d):
    new = L.mark_manual(stored(spark, d).filter("match_score >= 90"), F.lit("2024-06-01")).withColumn("o", F.lit(1))
    return L.record_applications(applications(spark, d), new, "o").select("job_pk", "status")


@query("to_apply", f"""WITH {AP} SELECT id, CASE WHEN ap.status IN ('submitted', 'assisted', 'manual') THEN 'skipped' ELSE 'pending' END AS status FROM st LEFT JOIN ap ON job_pk = id WHERE recommended""")
def _(spark, d):
    return L.to_apply(stored(spark, d), applications(spark, d)).select("id", "status")


@query("list_jobs", f"""WITH {AP} SELECT id, match_score, ap.status AS apply_status FROM st LEFT JOIN ap ON job_pk = id WHERE deleted_at IS NULL AND match_score >= 30 AND (title ILIKE '%role 1%' OR company ILIKE '%role 1%' OR description ILIKE '%role 1%')
  AND (ap.status IS NULL OR ap.status NOT IN ('submitted', 'assisted', 'manual')) ORDER BY match_score DESC, updated_at DESC, id LIMIT 20 OFFSET 1""")
def _(spark, d):
    return L.list_jobs(stored(spark, d), applications(spark, d), applied=False, min_score=30, search="role 1", limit=20, offset=1).select("id", "match_score", "apply_status")


@query("list_jobs_applied", f"""WITH {AP} SELECT id, match_score, ap.status AS apply_status FROM st JOIN ap ON job_pk = id WHERE portal = 'naukri' AND ap.status IN ('submitted', 'assisted', 'manual') ORDER BY match_score DESC, updated_at DESC, id""")
def _(spark, d):
    return L.list_jobs(stored(spark, d), applications(spark, d), portal="naukri", applied=True, limit=None, include_deleted=True).select("id", "match_score", "apply_status")


@query("get_job", f"WITH {AP} SELECT id, title, ap.status AS apply_status FROM st LEFT JOIN ap ON job_pk = id WHERE id = 'linkedin:1000006'")
def _(spark, d):
    return L.get_job(stored(spark, d), applications(spark, d), "linkedin:1000006").select("id", "title", "apply_status")


@query("job_stats", f"""WITH {AP} SELECT sum((deleted_at IS NULL)::INT)::BIGINT AS total, sum((deleted_at IS NOT NULL)::INT)::BIGINT AS deleted, sum((deleted_at IS NULL AND coalesce(ap.status IN ('submitted', 'assisted', 'manual'), false))::INT)::BIGINT AS applied,
  sum((deleted_at IS NULL AND recommended)::INT)::BIGINT AS recommended, sum((deleted_at IS NULL AND length(description) > 50)::INT)::BIGINT AS with_description FROM st LEFT JOIN ap ON job_pk = id""")
def _(spark, d):
    return L.job_stats(stored(spark, d), applications(spark, d))


@query("decorate_jobs", f"""WITH {AP} SELECT id, skill_overlap, recommended, coalesce(ap.status IN ('submitted', 'assisted', 'manual'), false) AS is_applied, length(description) > 50 AS has_description, deleted_at IS NOT NULL AS is_deleted,
  CASE WHEN match_score >= 80 THEN 'score-high' WHEN match_score >= 60 THEN 'score-mid' ELSE 'score-low' END AS score_band FROM st LEFT JOIN ap ON job_pk = id""")
def _(spark, d):
    rows = L.list_jobs(stored(spark, d), applications(spark, d), limit=None, include_deleted=True).withColumn("skill_overlap", F.to_json("skill_overlap"))
    return L.decorate_jobs(rows).select("id", "skill_overlap", "recommended", "is_applied", "has_description", "is_deleted", "score_band")


@query("location_filter", f"WITH {RAW} SELECT pid, location FROM li WHERE lower(location) LIKE '%pune%' OR lower(location) LIKE '%remote%'")
def _(spark, d):
    return L.location_filter(listings(spark, d), ["PUNE", "remote"]).select("pid", "location")


REPLIES = """rp AS (SELECT pid, CASE pid % 5 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '{"score": ' || (pid % 140) || ', "reasoning": "r", "skill_overlap": ["a", "b"], "gaps": [], "recommended": false}' || chr(10) || '```'
  WHEN 1 THEN 'text {"score": ' || (pid % 60) || ', "recommended": true} tail' WHEN 2 THEN 'no json here' WHEN 3 THEN '{"score": ' || (pid % 100) || '}' END AS reply FROM li)"""


def replies(spark, d):
    n = F.col("pid")
    s = lambda m: (n % m).cast("string")
    reply = (F.when(n % 5 == 0, F.concat(F.lit("Sure:\n```json\n{\"score\": "), s(140), F.lit(", \"reasoning\": \"r\", \"skill_overlap\": [\"a\", \"b\"], \"gaps\": [], \"recommended\": false}\n```")))
             .when(n % 5 == 1, F.concat(F.lit("text {\"score\": "), s(60), F.lit(", \"recommended\": true} tail"))).when(n % 5 == 2, "no json here").when(n % 5 == 3, F.concat(F.lit("{\"score\": "), s(100), F.lit("}"))))
    return listings(spark, d).select("pid", reply.alias("reply"))


@query("exclude_filter", f"WITH {RAW} SELECT pid, (lower(company) LIKE '%company 3%' OR lower(title) LIKE '%role 4%' OR lower(coalesce(nullif(description, ''), title)) LIKE '%the %') AS excluded FROM li")
def _(spark, d):
    return listings(spark, d).select("pid", L.is_excluded(["Company 3"], ["role 4", "The "]).alias("excluded"))


@query("apply_match_replies", f"""WITH {RAW}, {REPLIES}, e AS (SELECT li.pid, reply, lower(company) LIKE '%company 3%' AS x FROM li JOIN rp USING (pid)),
 s AS (SELECT pid, x, CASE WHEN x THEN 0 ELSE CASE pid % 5 WHEN 0 THEN least(100, pid % 140) WHEN 1 THEN pid % 60 WHEN 3 THEN pid % 100 ELSE 0 END END::INT AS match_score FROM e)
SELECT pid, match_score, CASE WHEN x THEN 'Excluded by company or keyword filter' WHEN pid % 5 = 0 THEN 'r' ELSE '' END AS reasoning, CASE WHEN pid % 5 = 0 AND NOT x THEN ['a', 'b'] ELSE [] END AS skill_overlap, NOT x AND (match_score >= 70 OR pid % 5 = 1) AS recommended FROM s""")
def _(spark, d):
    out = L.apply_match_replies(listings(spark, d), replies(spark, d), 70, ["company 3"], key="pid")
    return out.select("pid", "match_score", "reasoning", "skill_overlap", "recommended")


@query("rank_matches", f"WITH {SC} SELECT pid, match_score FROM sc WHERE recommended ORDER BY match_score DESC, pid LIMIT 5")
def _(spark, d):
    return L.rank_matches(scored(spark, d), "pid", 5, True).select("pid", "match_score")


@query("profile_from_reply", f"""WITH {RAW}, p AS (SELECT pid, description, '{{"summary": "s' || pid || '", "skills": ["x", "' || (pid % 4) || '"], "experience_years": ' || (pid % 9) || '.5}}' AS reply FROM li)
SELECT pid, description AS raw_text, CASE WHEN pid % 4 = 0 THEN '' ELSE 's' || pid END AS summary, CASE WHEN pid % 4 = 0 THEN [] ELSE ['x', (pid % 4)::VARCHAR] END AS skills, CASE WHEN pid % 4 <> 0 THEN pid % 9 + 0.5::DOUBLE END AS experience_years FROM p""")
def _(spark, d):
    n = F.col("pid")
    reply = F.when(n % 4 != 0, F.concat(F.lit('{"summary": "s'), n.cast("string"), F.lit('", "skills": ["x", "'), (n % 4).cast("string"), F.lit('"], "experience_years": '), (n % 9).cast("string"), F.lit(".5}")))
    return L.profile_from_reply(listings(spark, d).withColumn("reply", reply), "description").select("pid", "raw_text", "summary", "skills", "experience_years")


PAGE_SELECTORS = {p: (("article", "class", ""),) for p in ("linkedin", "indeed", "naukri")}


ARTICLE = r"""regexp_replace(regexp_replace(replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '^\s+|\s+$', '', 'g')"""


@query("page_descriptions", f"SELECT page_id AS id, {ARTICLE} AS text FROM pages")
def _(spark, d):
    pages = load(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("linkedin").alias("portal"), "html")
    return L.page_descriptions(pages, PAGE_SELECTORS)


@query("fill_descriptions", f"""WITH {RAW}, pt AS (SELECT page_id, {ARTICLE} AS page_text FROM pages)
SELECT li.pid AS id, CASE WHEN coalesce(length(li.description), 0) <= 50 AND li.portal IN ('linkedin', 'indeed', 'naukri') AND coalesce(page_text, '') <> '' THEN page_text ELSE li.description END AS description
FROM li LEFT JOIN pt ON pt.page_id = li.pid""")
def _(spark, d):
    n = listings(spark, d).withColumn("id", F.col("pid"))
    return L.fill_descriptions(n, load(spark, d, "pages").select(F.col("page_id").alias("id"), "html"), PAGE_SELECTORS).select("id", "description")


# --- chat --------------------------------------------------------------------------------------------------------

TOPICS = "tp AS (SELECT doc_id AS sample_id, lang || '_' || source AS area, 'about ' || doc_id || ' in {year}' AS query, replace(text, chr(10), ' ') AS answer FROM documents)"


def topics(spark, d):
    """One topic per document: its whole text is the answer."""
    return load(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.concat_ws("_", "lang", "source").alias("area"),
                                              F.concat(F.lit("about "), F.col("doc_id").cast("string"), F.lit(" in {year}")).alias("query"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("answer"))


PIECES = "list_filter(list_transform(string_split(answer, '.'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


@query("key_takeaways", f"WITH {TOPICS} SELECT sample_id, array_to_string(list_transform(({PIECES})[1:3], lambda s: replace('{C.TAKEAWAY[0]}', '{{topic}}', area) || lower(s) || '{C.TAKEAWAY[1]}'), ' ') AS takeaways FROM tp")
def _(spark, d):
    return topics(spark, d).select("sample_id", C.key_takeaways(F.col("answer"), F.col("area")).alias("takeaways"))


@query("bullet_takeaways", f"WITH {TOPICS} SELECT sample_id, array_to_string(list_transform(({PIECES})[1:4], lambda s: '- ' || lower(s)), chr(10)) AS bullets FROM tp")
def _(spark, d):
    return topics(spark, d).select("sample_id", C.bullet_takeaways(F.col("answer")).alias("bullets"))


def _uni(*parts: str) -> str:
    return f"(('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


def _draw(key: str, salt: str, items: str, n: int) -> str:
    return f"({items})[floor({_uni(key, repr(salt))} * {n})::INT + 1]"


def web_sql(key: str, source: str) -> str:
    """CTEs ending in ``wb``: the restyled sentences of ``source`` (columns of tp and ``answer``), choices hashed on ``key``."""
    drawn = ", ".join("{'o': md5(" + key + " || ':source" + str(i) + "'), 't': '" + t.split("{}")[0] + "' || "
                      + _draw(key, f"name{i}", "[" + ", ".join(f"'{x}'" for x in names) + "]", len(names)) + " || '" + t.split("{}")[1] + "'}"
                      for i, (t, names) in enumerate(C.SOURCES))
    count = _uni(key, "'count'")
    return f"""wb0 AS (SELECT *, list_transform(list_sort([{drawn}])[1:(CASE WHEN {count} >= 0.5 THEN 3 ELSE 2 END)], lambda s: s.t) AS src, ({PIECES})[1:5] AS pc FROM {source}),
 wb AS (SELECT *, array_to_string(list_transform(pc, lambda s, i: src[floor((('0x' || substr(md5({key} || ':credit:' || (i - 1)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE) * len(src))::INT + 1]
   || '{C.CREDIT[0]}' || lower(s) || replace('{C.CREDIT[1]}', '{{area}}', area)), ' ') AS content FROM wb0)"""


@query("web_content", f"WITH {TOPICS}, {web_sql('sample_id::VARCHAR', 'tp')} SELECT sample_id, content FROM wb")
def _(spark, d):
    return topics(spark, d).select("sample_id", C.web_content(F.col("answer"), F.col("area"), F.col("sample_id")).alias("content"))


PROMPT = "You answer with the help of web search."


_K = "(sample_id || ':42')"
_POINTS = {
    "sentences": f"array_to_string(list_transform(({PIECES})[1:3], lambda s: replace('{C.TAKEAWAY[0]}', '{{topic}}', topic) || lower(s) || '{C.TAKEAWAY[1]}'), ' ')",
    "bullets": f"array_to_string(list_transform(({PIECES})[1:4], lambda s: '- ' || lower(s)), chr(10))",
}


def _lines(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


_FORMS = " ".join(f"WHEN {i} THEN replace({_lines(head)}, '{{topic}}', topic) || answer || {_lines(joint)} || {_POINTS[form]}" for i, (head, joint, form) in enumerate(C.SUMMARY_FORMS))
_ASK = "[" + ", ".join(f"'{t}'" for t in C.QUERY_TEMPLATES) + "]"
SAMPLES = f"""{TOPICS}, yr AS (SELECT *, {_draw(_K, 'year', "['2024', '2025', '2026']", 3)} AS y, replace(area, '_', ' ') AS topic FROM tp),
 fl AS (SELECT sample_id, area, topic, replace(query, '{{year}}', y) AS query, replace(answer, '{{year}}', y) AS answer FROM yr), {web_sql(_K, 'fl')},
 sm AS (SELECT sample_id, area, '<|system|>' || chr(10) || '{PROMPT}</s>' || chr(10) || '<|user|>' || chr(10) || replace({_draw(_K, 'ask', _ASK, len(C.QUERY_TEMPLATES))}, '{{topic}}', topic) || '</s>' || chr(10)
   || '<|assistant|>' || chr(10) || '<tool_calls>' || chr(10) || '[{{"name":"web_search","arguments":{{"query":' || to_json(query)::VARCHAR || '}}}}]' || chr(10) || '</tool_calls></s>' || chr(10)
   || '<|tool|>' || chr(10) || '<tool_results>' || chr(10) || '{{"result":' || to_json(content)::VARCHAR || '}}' || chr(10) || '</tool_results></s>' || chr(10) || '<|assistant|>' || chr(10)
   || CASE floor({_uni(_K, "'style'")} * {len(C.SUMMARY_FORMS)})::INT {_FORMS} END || '</s>' AS text FROM wb)"""
TOKENS = "len(list_filter(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12)), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))::INT"


@query("generate_samples", f"WITH {SAMPLES} SELECT sample_id, area, text FROM sm")
def _(spark, d):
    return C.generate_samples(topics(spark, d), PROMPT)


@query("validate_samples", f"WITH {SAMPLES}, n AS (SELECT sample_id, {TOKENS} AS n_tokens FROM sm) SELECT sample_id, []::VARCHAR[] AS missing, n_tokens, n_tokens < 4000 AS valid FROM n")
def _(spark, d):
    return C.validate_samples(C.generate_samples(topics(spark, d), PROMPT)).select("sample_id", "missing", "n_tokens", "valid")


@query("validate_documents", f"""SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12)), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))::INT AS n_tokens, contains(text, '@') AS has_marker FROM documents""")
def _(spark, d):
    out = C.validate_samples(load(spark, d, "documents"), ["@"], 4000)
    return out.select("doc_id", "n_tokens", (F.size("missing") == 0).alias("has_marker"))


@query("area_distribution", f"WITH {TOPICS} SELECT area, count(*) AS n FROM tp GROUP BY area")
def _(spark, d):
    return C.area_distribution(topics(spark, d))


@query("render_turns", "SELECT conv_id, turn, '<|' || role || '|>' || chr(10) || coalesce(text, '') || '</s>' AS text FROM conversations")
def _(spark, d):
    return C.render_turns(load(spark, d, "conversations"))


@query("render_chat", "SELECT conv_id, count(*) AS n_turns, string_agg('<|' || role || '|>' || chr(10) || coalesce(text, '') || '</s>', chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def _(spark, d):
    return C.render_chat(load(spark, d, "conversations"))


@query("structured_chat", "SELECT conv_id, count(*)::INT AS n, string_agg(role || '=' || length(text), ',' ORDER BY turn) AS shape FROM conversations GROUP BY conv_id")
def _(spark, d):
    out = C.structured_chat(load(spark, d, "conversations"))
    return out.select("conv_id", F.size("messages").alias("n"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), F.length(m["content"]).cast("string"))), ",").alias("shape"))


def calling_turns(spark, d):
    """Assistant turns whose key says so carry a tool call, some broken, some with two calls."""
    c = load(spark, d, "conversations")
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "conv_id", "turn")), 1, 2), 16, 10).cast("int")
    q = F.concat(F.lit('{"name": "web_search", "arguments": {"query": "q'), F.col("turn").cast("string"), F.lit('"}}'))
    call = (F.when(h % 4 == 0, F.concat(F.lit("ok <tool_calls>\n["), q, F.lit("]\n</tool_calls> rest"))).when(h % 4 == 1, F.concat(F.lit("<tool_calls>["), q, F.lit(', {"name": "other"}]</tool_calls>')))
            .when(h % 4 == 2, F.lit("<tool_calls>[{broken]</tool_calls>")))
    return c.withColumn("text", F.when((F.col("role") == "assistant") & call.isNotNull(), call).otherwise(F.col("text")))


CALLS = """ct0 AS (SELECT *, ('0x' || substr(md5(conv_id || ':' || turn), 1, 2))::INT % 4 AS h FROM conversations),
 ct AS (SELECT conv_id, turn, role, h, CASE WHEN role <> 'assistant' OR h = 3 THEN text WHEN h = 0 THEN 'ok <tool_calls>' || chr(10) || '[{"name": "web_search", "arguments": {"query": "q' || turn || '"}}]' || chr(10) || '</tool_calls> rest'
   WHEN h = 1 THEN '<tool_calls>[{"name": "web_search", "arguments": {"query": "q' || turn || '"}}, {"name": "other"}]</tool_calls>' ELSE '<tool_calls>[{broken]</tool_calls>' END AS text FROM ct0)"""


@query("extract_tool_call", f"WITH {CALLS} SELECT conv_id, turn, CASE WHEN role = 'assistant' AND h IN (0, 1) THEN 'web_search' END AS name, CASE WHEN role = 'assistant' AND h IN (0, 1) THEN 'q' || turn END AS query FROM ct")
def _(spark, d):
    call = C.extract_tool_call(F.col("text"))
    return calling_turns(spark, d).select("conv_id", "turn", call["name"].alias("name"), call["arguments"]["query"].alias("query"))


@query("assemble_dialogue", f"""WITH {CALLS}, a AS (SELECT *, role = 'assistant' AND h IN (0, 1) AS c FROM ct), b AS (SELECT *, coalesce(sum(c::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM a),
 e AS (SELECT *, coalesce(sum((role = 'assistant' AND (NOT c OR r >= 1))::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM b),
 k AS (SELECT *, c AND r < 1 AS used FROM e WHERE done = 0)
SELECT conv_id, turn, 0 AS part, role, CASE WHEN used THEN split_part(text, '</tool_calls>', 1) || '</tool_calls>' ELSE text END AS text FROM k UNION ALL SELECT conv_id, turn, 1, 'tool', '{{"result":"found ' || turn || '"}}' FROM k WHERE used""")
def _(spark, d):
    turns = calling_turns(spark, d)
    results = turns.select("conv_id", "turn", F.concat(F.lit("found "), F.col("turn").cast("string")).alias("content"))
    return C.assemble_dialogue(turns, results, max_rounds=1)
