import pytest
from pyspark.sql import functions as F

from tidemark.operators import corpus as C, listings as L

JOB = ("id string, portal string, job_id string, title string, company string, location string, url string, description string, posted string, scraped_at string, match_score int, "
       "reasoning string, skill_overlap array<string>, gaps array<string>, recommended boolean, created_at string, updated_at string, deleted_at string")


def job(id_, desc="old", posted="p", score=10, deleted=None, title="t"):
    return (id_, "linkedin", id_, title, "c", "l", "u", desc, posted, "s", score, "r", ["a"], [], False, "c0", "u0", deleted)


def match(id_, order, desc="new", posted=None, score=90):
    return (id_, "linkedin", id_, f"t{order}", "c", "l", "u", desc, posted, "s", score, "r", ["b"], ["g"], True, order)


BATCH = JOB.split(", created_at")[0] + ", o int"


@pytest.mark.parametrize("portal,job_id,url,want", [
    ("linkedin", "x", "https://a/jobs/view/1234567?trk=1", "linkedin:1234567"),
    ("linkedin", "currentJobId=99", "https://a/jobs/view/engineer/", "linkedin:99"),
    ("linkedin", "x", "https://a/jobs/view/engineer-at/", "linkedin:engineer-at"),
    ("naukri", "x", "https://n/job-listings-55-x?src=1", "naukri:55"),
    ("naukri", "x", "https://n/abc/7654321", "naukri:7654321"),
    ("indeed", "abc123", "https://i/viewjob?jk=abc123&from=x", "indeed:abc123"),
    ("indeed", "deadbeef", "https://i/rc/clk", "indeed:deadbeef"),
    ("other", "a b/c", "https://o/", "other:o"),
])
def test_keys(spark, portal, job_id, url, want):
    row = spark.createDataFrame([(portal, job_id, url)], "p string, j string, u string")
    assert row.select(L.job_key(F.col("p"), F.col("j"), F.col("u"))).first()[0] == want


def test_upsert(spark):
    jobs = spark.createDataFrame([job("1", "a long description"), job("2", "x", deleted="d0"), job("3")], JOB)
    batch = spark.createDataFrame([match("1", 1, "short"), match("2", 2, "longer text", "q"), match("2", 3, "tiny", None, 5), match("9", 4)], BATCH)
    out = {r["id"]: r for r in L.upsert_matches(jobs, batch, F.lit("now"), "o").collect()}
    assert out["1"]["description"] == "a long description" and out["1"]["posted"] == "p" and out["1"]["created_at"] == "c0" and out["1"]["updated_at"] == "now"
    assert out["2"]["description"] == "longer text" and out["2"]["match_score"] == 5 and out["2"]["posted"] == "q" and out["2"]["title"] == "t3" and out["2"]["deleted_at"] == "d0"
    assert out["3"]["updated_at"] == "u0" and out["9"]["created_at"] == "now" and out["9"]["deleted_at"] is None and len(out) == 4
    plain = {r["id"]: r for r in L.upsert_listings(jobs, batch, F.lit("now"), "o").collect()}
    assert plain["1"]["match_score"] == 10 and plain["9"]["match_score"] == 0 and plain["9"]["skill_overlap"] == [] and plain["2"]["posted"] == "p"


def test_applications(spark):
    cols = "job_pk string, status string, message string, applied_at string"
    have = spark.createDataFrame([("1", "submitted", "m", "t")], cols)
    new = spark.createDataFrame([("1", "failed", "n", "t2", 1), ("2", "skipped", "n", "t2", 2), ("3", "assisted", "n", "t2", 3), ("3", "manual", "z", "t3", 4)], cols + ", o int")
    out = {r["job_pk"]: r["status"] for r in L.record_applications(have, new, "o").collect()}
    assert out == {"1": "submitted", "3": "manual"}
    jobs = spark.createDataFrame([job("1", "d" * 60, score=85), job("3", "s", score=60), job("4", "s", deleted="x"), job("5", "s", title="SQL 100% fun")], JOB)
    ap = L.record_applications(have, new, "o")
    assert [r["id"] for r in L.list_jobs(jobs, ap, applied=True).collect()] == ["1", "3"]
    assert [r["id"] for r in L.list_jobs(jobs, ap, applied=False).collect()] == ["5"]
    assert [r["id"] for r in L.list_jobs(jobs, ap, search="sql").collect()] == ["5"]
    assert [r["id"] for r in L.list_jobs(jobs, ap, limit=1, offset=1).collect()] == ["3"]
    assert L.job_stats(jobs, ap).first().asDict() == {"total": 3, "deleted": 1, "applied": 2, "recommended": 0, "with_description": 1}
    row = L.decorate_jobs(L.get_job(jobs, ap, "1")).first()
    assert row["is_applied"] and row["has_description"] and row["score_band"] == "score-high" and not row["is_deleted"]
    assert [r["id"] for r in L.drop_deleted(jobs.select("id"), jobs).orderBy("id").collect()] == ["1", "3", "5"]


def test_replies(spark):
    replies = [("1", 'Sure ```json\n{"score": 140, "recommended": false}\n```'), ("2", 'x {"score": 50, "recommended": true} y'), ("3", "broken {"), ("4", '{"score": "88", "gaps": ["g"]}'), ("5", None)]
    rows = spark.createDataFrame([(i, "Acme" if i == "4" else "B", "t", "d") for i, _ in replies], "id string, company string, title string, description string")
    got = {r["id"]: r for r in L.apply_match_replies(rows, spark.createDataFrame(replies, "id string, reply string"), 70, ["acme"]).collect()}
    assert [got[i]["match_score"] for i in "12345"] == [100, 50, 0, 0, 0]
    assert [got[i]["recommended"] for i in "12345"] == [True, True, False, False, False]
    assert got["4"]["reasoning"].startswith("Excluded") and got["4"]["gaps"] == []


def test_page_text(spark):
    html = '<html><div class="x"><p>no</p></div><div class="a description__text b"><p>Hello</p><script>z()</script> <b>wor<br>ld</b></div><p>after</p></html>'
    out = L.page_descriptions(spark.createDataFrame([("1", "linkedin", html), ("2", "indeed", '<div id="jobDescriptionText"> ok </div>'), ("3", "none", html)], "id string, portal string, html string"))
    assert {r["id"]: r["text"] for r in out.collect()} == {"1": "Hello world", "2": "ok", "3": ""}


def test_posted_days(spark):
    df = spark.createDataFrame([("3 days ago",), ("Today",), ("5 hours ago",), ("yesterday",), ("",), (None,), ("1 Day Ago",)], "p string")
    assert [r[0] for r in df.select(L.posted_days(F.col("p"))).collect()] == [3, 0, 0, 1, None, None, 1]


def test_generated_samples_are_valid(spark):
    topics = spark.createDataFrame([(i, "solar_power", "solar news {year}", "Panels got cheaper in {year}. Output \"rose\" 5 percent. Grids adapt. More to come. And on. And on again.") for i in range(40)],
                                   "sample_id long, area string, query string, answer string")
    out = C.validate_samples(C.generate_samples(topics, "You search the web."))
    assert out.filter("valid").count() == 40
    assert C.generate_samples(topics.repartition(3), "You search the web.").orderBy("sample_id").collect() == C.generate_samples(topics, "You search the web.").orderBy("sample_id").collect()
    call = out.select(C.extract_tool_call(F.col("text")).alias("c")).first()["c"]
    assert call["name"] == "web_search" and call["arguments"]["query"].startswith("solar news 202")
    assert "{year}" not in out.first()["text"]


def test_tool_calls(spark):
    texts = ['a<tool_calls>\n[{"name": "web_search", "arguments": {"query": "q"}}]\n</tool_calls>', '<tool_calls>[{"name": "a"}, {"name": "b"}]</tool_calls>', "<tool_calls>[{bad]</tool_calls>", "none", "<tool_calls>[]</tool_calls>"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.extract_tool_call(F.col("t"))["name"]).collect()]
    assert got == ["web_search", "a", None, None, None]


@pytest.mark.parametrize("chunks", [1, 3])
def test_dialogue(spark, chunks):
    call = '<tool_calls>[{"name": "web_search", "arguments": {"query": "q"}}]</tool_calls> trailing'
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", call), (1, 2, "assistant", call), (1, 3, "assistant", "answer"), (1, 4, "assistant", "extra")], "conv_id long, turn long, role string, text string")
    results = turns.select("conv_id", "turn", F.lit("r").alias("content"))
    out = C.assemble_dialogue(turns, results, chunks=chunks).orderBy("turn", "part").collect()
    assert [(r["turn"], r["role"]) for r in out] == [(0, "user"), (1, "assistant"), (1, "tool"), (2, "assistant"), (2, "tool"), (3, "assistant")]
    assert out[1]["text"].endswith("</tool_calls>") and out[2]["text"] == '{"result":"r"}'
    capped = C.assemble_dialogue(turns, max_rounds=1, chunks=chunks).orderBy("turn").collect()
    assert [r["turn"] for r in capped] == [0, 1, 2] and capped[2]["text"] == call


def test_long_conversations_stay_whole(spark):
    turns = spark.createDataFrame([(1, i, "user", str(i)) for i in range(25_000)], "conv_id long, turn long, role string, text string").repartition(4)
    whole = C.render_chat(turns).first()
    rows = C.render_turns(turns).orderBy("turn").collect()
    assert whole["n_turns"] == 25_000 and whole["text"] == "\n".join(r["text"] for r in rows)


def test_every_form_is_drawn(spark):
    topics = spark.range(400).select(F.col("id").alias("sample_id"), F.lit("a_b").alias("area"), F.lit("q").alias("query"), F.lit("One. Two. Three. Four.").alias("answer"))
    text = [r["text"] for r in C.generate_samples(topics, "p").collect()]
    assert all(any(q.replace("{topic}", "a b") in t for t in text) for q in C.QUERY_TEMPLATES)
    assert all(any(head.replace("{topic}", "a b") in t for t in text) for head, _, _ in C.SUMMARY_FORMS)
