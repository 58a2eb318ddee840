"""Judging addresses by rules and by a long list of canonical addresses.

A few rules decide by host and path. Every other address is brought to its canonical form and looked up in a blocked Bloom
filter of the listed ones: eight words of 64 bits a block, one bit in each, so one small row answers. The filter's blocks
are broadcast; their number is bounded, and a fuller filter only lets more addresses through. What passes goes to an exact
hash join with the list, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.batches import only
from tidemark.plans.checkpoints import stable

WORDS = 8  # of 64 bits in a block
BITS_PER_URL = 12
MAX_BLOCKS = 1 << 17  # 8 MB of bits
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNWANTED = ("ads", "adult", "bets", "casino", "pills", "poker", "porn", "spam")  # words in names of hosts
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"

Rule = tuple[str, str, str]  # allow or block, host, beginning of the path


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null or where it is missing."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.call_function("substring", url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One form for addresses that name the same page; null where there is no host.

    Scheme, fragment, a leading ``www.``, slashes at the end and tracking parameters go; other parameters are sorted.
    """
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    asked = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule as text, its action) of the longest rule that fits, both null where none does.

    A rule fits its host and all subdomains where the path begins with the rule's. Of equally long ones that with the
    longer host wins, and ``block`` before ``allow``.
    """
    found = action = F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        found, action = F.when(fits, F.lit(rule_host + rule_path)).otherwise(found), F.when(fits, F.lit(act)).otherwise(action)
    return found, action


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """One bit in each word of the block, from six bits each of a second hash."""
    second = F.xxhash64(F.lit(7), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(second, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the filter of the column ``canonical``; blocks without any address are left out."""
    placed = listed.select(_block(F.col("canonical"), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("canonical")))])
    return placed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), *, page_id: str = "page_id", url: str = "url", listed_url: str = "url",
          bits_per_url: int = BITS_PER_URL, max_blocks: int = MAX_BLOCKS, salts: int = SALTS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row: the rule's verdict, else ``block`` if the canonical address is listed.

    Null and malformed addresses have an empty host, fit no rule and are allowed; nulls in the list name nothing. Repeated rows are
    judged each, repeated list entries count once. Other columns of either table don't matter; an empty list blocks nothing, an empty
    table gives no rows. Only rows that pass the filter are shuffled, under a salt, so one address may hold any share of them.
    """
    listed = stable(listed.select(canonical(F.col(f"`{listed_url}`")).alias("canonical")).filter("canonical is not null").distinct())
    blocks = max(1, min(max_blocks, -(-listed.count() * bits_per_url // (64 * WORDS))))
    rows = only(pages, page_id=page_id, url=url).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    ruled = rows.select("page_id", "host", "path", rule.alias("rule"), action.alias("verdict"), F.when(rule.isNull(), F.col("canonical")).alias("canonical"))
    placed = ruled.withColumn("block", _block(F.col("canonical"), blocks))
    tested = placed.join(F.broadcast(bloom(listed, blocks)), "block", "left")
    hit = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(b) != 0 for i, b in enumerate(_bits(F.col("canonical")))])
    known = tested.select("page_id", "host", "path", "rule", "verdict", "canonical", (F.col("canonical").isNotNull() & F.coalesce(hit, F.lit(False))).alias("_maybe"))
    settled = known.filter(~F.col("_maybe")).select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    maybe = stable(known.filter("_maybe").select("page_id", "host", "path", "rule", "canonical", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(salts)).alias("_salt")))
    sure = maybe.select("canonical").distinct().join(listed, "canonical").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    judged = maybe.join(sure.withColumn("_listed", F.lit(True)), ["canonical", "_salt"], "left")
    return settled.unionByName(judged.select("page_id", "host", "path", "rule", F.when(F.col("_listed"), "block").otherwise("allow").alias("verdict")))


def unwanted(pages: DataFrame, words: Sequence[str] = UNWANTED, *, url: str = "url") -> DataFrame:
    """(url): the addresses of a crawl on hosts whose name holds one of ``words`` between dots and hyphens; a list for ``judge``."""
    parts = F.split(host_of(F.col(f"`{url}`")), "[.-]")
    return pages.filter(F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words]))).select(F.col(f"`{url}`").alias("url"))


SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS asked FROM p),
 k AS (SELECT *, array_to_string(list_sort(list_filter(string_split(asked, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS kept FROM h),
 c AS (SELECT *, CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN
              concat(regexp_replace(host, '^www\.', ''), regexp_replace(path, '/+$', ''), CASE WHEN kept <> '' THEN concat('?', kept) ELSE '' END) END AS canon FROM k),
 rules(act, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
 r AS (SELECT c.*, (SELECT max(length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS longest FROM c),
 n AS (SELECT DISTINCT canon FROM c WHERE list_has_any(string_split_regex(host, '[.-]'), ['ads', 'adult', 'bets', 'casino', 'pills', 'poker', 'porn', 'spam']))
SELECT r.page_id, r.host, r.path, x.rh || x.rp AS rule, CASE WHEN x.act IS NOT NULL THEN x.act WHEN n.canon IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN rules x ON length(x.rh || x.rp) = r.longest AND (r.host = x.rh OR ends_with(r.host, '.' || x.rh)) AND starts_with(r.path, x.rp) LEFT JOIN n ON r.canon = n.canon
"""
