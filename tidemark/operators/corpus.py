"""Chat samples: filling, rendering, tool-call extraction, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.sampling import uniform
from tidemark.plans.checkpoints import stable
from tidemark.plans.ordered import chunk_by_value, running

# Role markers, end token and envelopes of the chat format.
END = "</s>"
REQUIRED_MARKERS = ("<|system|>", "<|user|>", "<|assistant|>", "<|tool|>", "<tool_calls>", "<tool_results>", "web_search")
MAX_TOKENS = 4000
# Attributions a filled source sentence can open with ({} takes one of the names).
SOURCES = (
    ("According to a {} publication", ("Nature", "Science", "Cell")),
    ("A report from {} states", ("Reuters", "Bloomberg", "AP News")),
    ("Research published in {} indicates", ("arXiv", "PNAS", "Nature Communications")),
    ("Analysis by {} shows", ("McKinsey", "Gartner", "Forrester")),
    ("Experts at {} have found", ("MIT", "Stanford", "Oxford", "Cambridge")),
)
# Own wording: ten ways to ask, four ways to sum up (opening, joint before the takeaways, their form).
QUERY_TEMPLATES = (
    "What should I know about {topic}?", "Where does {topic} stand today?", "Please look into {topic} and report back", "Find out what is new in {topic}",
    "Can you put together a short brief on {topic}?", "Which facts about {topic} matter most?", "Help me make sense of {topic}", "Collect current findings on {topic}",
    "How is {topic} developing at the moment?", "Write up the main points on {topic}",
)
SUMMARY_FORMS = (
    ("This is what the search on {topic} turned up.\n\n", "\n\nWorth keeping in mind: ", "sentences"),
    ("The pages on {topic} agree on the following.\n\n", "\n\nIn short\n", "bullets"),
    ("Findings on {topic}\n\n", "\n\nPoint by point\n", "bullets"),
    ("Several pages on {topic} give this picture.\n\n", "\n\nTo sum up: ", "sentences"),
)
TAKEAWAY = ("For {topic} this means: ", ".")
CREDIT = (": ", ". It bears on {area}.")
YEARS = ("2024", "2025", "2026")


def sentences(text: Column) -> Column:
    """Non-empty trimmed pieces between full stops."""
    return F.filter(F.transform(F.split(text, r"\."), lambda s: F.trim(s, F.lit(" \n\r\t"))), lambda s: s != "")


def key_takeaways(answer: Column, topic: Column, n: int = 3) -> Column:
    """One sentence per leading statement of the answer."""
    return F.array_join(F.transform(F.slice(sentences(answer), 1, n), lambda s: F.concat(
        F.replace(F.lit(TAKEAWAY[0]), F.lit("{topic}"), topic), F.lower(s), F.lit(TAKEAWAY[1]))), " ")


def bullet_takeaways(answer: Column, n: int = 4) -> Column:
    """A bullet per leading statement."""
    return F.array_join(F.transform(F.slice(sentences(answer), 1, n), lambda s: F.concat(F.lit("- "), F.lower(s))), "\n")


def _pick(items: Column, key: Column, *salt: object) -> Column:
    """A hash-chosen element: the same for a key in any partitioning."""
    return F.element_at(items, (F.floor(uniform(key, *salt) * F.size(items)) + 1).cast("int"))


def _sources(key: Column) -> Column:
    """Two or three distinct attributions for a sample, in hash order."""
    drawn = [F.struct(F.md5(F.concat_ws(":", key.cast("string"), F.lit(f"source{i}"))).alias("o"),
                      F.format_string(text.replace("{}", "%s"), _pick(F.array(*map(F.lit, names)), key, f"name{i}")).alias("t"))
             for i, (text, names) in enumerate(SOURCES)]
    count = F.lit(2) + F.when(uniform(key, "count") >= 0.5, 1).otherwise(0)
    return F.transform(F.slice(F.array_sort(F.array(*drawn)), F.lit(1), count), lambda s: s["t"])


def web_content(answer: Column, area: Column, key: Column, limit: int = 5) -> Column:
    """Up to five restyled sentences, each credited to one of the sample's sources."""
    chosen = _sources(key)
    styled = F.transform(F.slice(sentences(answer), 1, limit), lambda s, i: F.concat(
        F.element_at(chosen, (F.floor(F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit("credit"), i.cast("string"))), 1, 13), 16, 10).cast("double")
                                      / F.lit(float(2 ** 52)) * F.size(chosen)) + 1).cast("int")),
        F.lit(CREDIT[0]), F.lower(s), F.replace(F.lit(CREDIT[1]), F.lit("{area}"), area)))
    return F.array_join(styled, " ")


def tool_call(query: Column) -> Column:
    body = F.to_json(F.struct(F.lit("web_search").alias("name"), F.struct(query.alias("query")).alias("arguments")))
    return F.concat(F.lit("<tool_calls>\n["), body, F.lit("]\n</tool_calls>"))


def tool_result(content: Column) -> Column:
    return F.concat(F.lit("<tool_results>\n"), F.to_json(F.struct(content.alias("result"))), F.lit("\n</tool_results>"))


def turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit(END))


def generate_samples(topics: DataFrame, system_prompt: str, key: str = "sample_id", seed: int = 42) -> DataFrame:
    """One chat sample per row of ``topics`` (key, area, query, answer with {year}); choices are hashes of the key.

    Every sample is a function of its own row, so the work has no shuffle.
    """
    k = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))
    year = _pick(F.array(*map(F.lit, YEARS)), k, "year")
    df = topics.withColumn("_topic", F.replace(F.col("area"), F.lit("_"), F.lit(" ")))
    df = df.withColumn("_answer", F.replace(F.col("answer"), F.lit("{year}"), year)).withColumn("_query", F.replace(F.col("query"), F.lit("{year}"), year))
    ask = F.replace(_pick(F.array(*map(F.lit, QUERY_TEMPLATES)), k, "ask"), F.lit("{topic}"), F.col("_topic"))
    t, a = F.col("_topic"), F.col("_answer")
    points = {"sentences": key_takeaways(a, t), "bullets": bullet_takeaways(a)}
    styles = F.array(*[F.concat(F.replace(F.lit(head), F.lit("{topic}"), t), a, F.lit(joint), points[form]) for head, joint, form in SUMMARY_FORMS])
    summary = _pick(styles, k, "style")
    roles = [("system", F.lit(system_prompt)), ("user", ask), ("assistant", tool_call(F.col("_query"))),
             ("tool", tool_result(web_content(a, F.col("area"), k))), ("assistant", summary)]
    text = F.concat_ws("\n", *[turn(F.lit(r), x) for r, x in roles])
    return df.select(key, "area", text.alias("text"))


def render_turns(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conv, order, text): every rendered turn as a row of its own, so that no dialogue is ever gathered."""
    return turns.select(conv, order, turn(F.col("role"), F.coalesce("text", F.lit(""))).alias("text"))


def render_chat(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conv, n_turns, text): the whole dialogue as one value, turns in order; ``render_turns`` gives it in rows."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    return render_turns(turns, conv, order).groupBy(conv).agg(ordered.alias("_t"), F.count(F.lit(1)).alias("n_turns")).select(
        conv, "n_turns", F.array_join(F.transform("_t", lambda x: x["t"]), "\n").alias("text"))


def structured_chat(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """The same as an array of (role, content)."""
    piece = F.struct(F.col(order).alias("o"), F.struct("role", F.col("text").alias("content")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["m"])
    return turns.groupBy(conv).agg(ordered.alias("messages"))


CALLS = r"(?s)<tool_calls>\s*(\[.*?\])\s*</tool_calls>"
CALL_SCHEMA = "array<struct<name:string,arguments:struct<query:string>>>"


def extract_tool_call(text: Column) -> Column:
    """First call inside the tag as (name, arguments.query); null without a tag or with broken JSON."""
    return F.get(F.from_json(F.nullif(F.regexp_extract(text, CALLS, 1), F.lit("")), CALL_SCHEMA), 0)


def area_distribution(samples: DataFrame, col: str = "area") -> DataFrame:
    return samples.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(col)


def token_count(text: Column) -> Column:
    """Whitespace-separated tokens."""
    body = F.trim(text, F.lit(" \n\r\t\f"))
    return F.when(body == "", 0).otherwise(F.size(F.split(body, r"\s+")))


def validate_samples(samples: DataFrame, markers: Sequence[str] = REQUIRED_MARKERS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds the missing markers, the token count and ``valid``."""
    missing = F.array_compact(F.array(*[F.when(~F.col("text").contains(m), F.lit(m)) for m in markers]))
    return (samples.withColumn("missing", missing).withColumn("n_tokens", token_count(F.col("text")))
            .withColumn("valid", (F.size("missing") == 0) & (F.col("n_tokens") < max_tokens)))


def assemble_dialogue(turns: DataFrame, results: DataFrame | None = None, max_rounds: int = 3,
                      conv: str = "conv_id", order: str = "turn", chunks: int | None = None) -> DataFrame:
    """Stored assistant turns -> dialogue rows: a tool-calling turn is cut after its closing tag and followed by
    its tool row; the first turn without a call, or the one after ``max_rounds`` calls, is the answer and ends it.

    ``results`` is (conv, turn, content). Both conditions are running counts over the earlier turns.
    """
    call = extract_tool_call(F.col("text"))
    is_assistant = F.col("role") == "assistant"
    marked = turns.withColumn("_call", (is_assistant & F.coalesce(call["name"] == "web_search", F.lit(False))).cast("int"))
    data = running(chunk_by_value(marked, order, chunks), [conv], [order], {"_upto": ("sum", F.col("_call"))})
    rounds = F.col("_upto") - F.col("_call")
    answer = (is_assistant & ((F.col("_call") == 0) | (rounds >= max_rounds))).cast("int")
    data = data.with_df(data.df.withColumn("_rounds", rounds).withColumn("_answer", answer))
    data = data.with_df(stable(data.df))
    data = running(data, [conv], [order], {"_answers": ("sum", F.col("_answer"))})
    kept = data.df.filter(F.col("_answers") - F.col("_answer") == 0)
    kept = kept.withColumn("_used", (F.col("_call") == 1) & (F.col("_rounds") < max_rounds))
    cut = F.concat(F.substring_index("text", "</tool_calls>", 1), F.lit("</tool_calls>"))
    base = kept.select(conv, F.col(order), F.lit(0).alias("part"), "role", F.when(F.col("_used"), cut).otherwise(F.col("text")).alias("text"))
    if results is None:
        return base
    tool = (kept.filter("_used").select(conv, order).join(results, [conv, order])
            .select(conv, F.col(order), F.lit(1).alias("part"), F.lit("tool").alias("role"), F.to_json(F.struct(F.col("content").alias("result"))).alias("text")))
    return base.unionByName(tool)
