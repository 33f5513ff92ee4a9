"""URL filters: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.storage import durable

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict); the longest that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Labels of hosts whose pages the query lists as unwanted.
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: Bits a listed URL, and the most blocks of 64 bits that are sent to all tasks (16 MiB); a larger filter is dealt by block.
BITS_PER_URL, MAX_BLOCKS, PROBES = 16, 1 << 20, 5


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWERED), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column, same_site: Sequence[str] = ("www",)) -> Column:
    """One form of a URL's spellings: no scheme, no leading label of ``same_site``, no trailing slash or ``.html``, query or fragment; null without a host."""
    bare = F.regexp_replace(host(url), r"^(" + "|".join(same_site) + r")\.", "") if same_site else host(url)
    return F.when(bare != "", F.concat(bare, F.regexp_replace(path(url), r"(\.html|/+)$", "")))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in order]
    made = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in order]
    return F.coalesce(*[F.when(f, m) for f, m in zip(fits, made, strict=True)])


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for i in range(PROBES):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def bloom_filter(listed: DataFrame) -> tuple[DataFrame, int]:
    """(block, word) rows of a blocked Bloom filter of column ``key``, and the number of its blocks.

    All bits of a key lie in one block of 64, so that a probe is one lookup. There are about as many
    blocks as it takes for ``BITS_PER_URL`` bits a key, however long the list is.
    """
    n = listed.count()
    blocks = 64
    while blocks * 64 < n * BITS_PER_URL:
        blocks *= 2
    key = F.col("key")
    return listed.select(_block(key, blocks).alias("block"), _bits(key).alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("word")), blocks


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """A verdict on every page: the rule's if one fits, else block if the canonical URL is listed, else allow.

    ``listed`` has a column ``url``; nulls and repeats in it count for nothing. Only pages without a rule and
    with a host are held against the list: possible hits of the Bloom filter go to an exact join on the
    canonical URL. A filter of at most ``MAX_BLOCKS`` blocks is sent to all tasks, so that all other
    pages are settled without a shuffle; a larger one is dealt by block and meets the pages in question there.
    Pages are read once, and what the filter says is written. Returns page_id, host, path, rule, verdict; a null url has
    an empty host and path, no rule, and is allowed. Repeated rows stay; other columns are dropped.
    """
    keys = durable(listed.select(canonical(F.col("url")).alias("key")).where("key is not null").distinct(), "url-list")
    bloom, blocks = bloom_filter(keys)
    url = F.col("url")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("key"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    asked = F.col("key").isNotNull() & F.col("fit").isNull()
    if blocks <= MAX_BLOCKS:
        # one pass, as no row moves: what is not asked has no block, and finds none
        probed = rows.withColumn("block", F.when(asked, _block(F.col("key"), blocks))).join(F.broadcast(bloom), "block", "left")
    else:
        rows = durable(rows, "url-rows")
        probed = rows.where(asked).withColumn("block", _block(F.col("key"), blocks)).join(bloom, "block", "left")
        probed = probed.unionByName(rows.where(~asked).withColumns({"block": F.lit(None).cast("long"), "word": F.lit(None).cast("long")}))
    bits = _bits(F.col("key"))
    probed = durable(probed.withColumn("possible", F.coalesce(F.col("word").bitwiseAND(bits) == bits, F.lit(False))).drop("block", "word"), "url-probed")
    hits = probed.where("possible").join(keys.withColumn("listed", F.lit(True)), "key", "left")
    rest = probed.where("not possible").withColumn("listed", F.lit(None).cast("boolean"))
    return hits.unionByName(rest).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )


def unwanted_urls(pages: DataFrame, labels: Sequence[str] = LISTED_LABELS) -> DataFrame:
    """(url): pages of hosts with one of the labels, and one spelling of each address that several pages share, which is a mirror or a trap whatever its host."""
    rows = pages.select("url", canonical(F.col("url")).alias("key")).where("key is not null")
    named = rows.where(host(F.col("url")).rlike(r"(^|\.)(" + "|".join(labels) + r")\.")).select("url")
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("url").alias("url")).where("n > 1").select("url")
    return named.unionByName(shared)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is ``unwanted_urls`` of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, unwanted_urls(pages))


OP8_SQL = r"""
WITH split AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split),
keyed AS (
  SELECT *, CASE WHEN regexp_replace(host, '^(www)\.', '') <> '' THEN regexp_replace(host, '^(www)\.', '') || regexp_replace(path, '(\.html|/+)$', '') END AS key
  FROM parts),
listed AS (
  SELECT key FROM keyed WHERE key IS NOT NULL AND regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.')
  UNION SELECT key FROM keyed WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1),
rules(rule_host, rule_path, says) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fitted AS (
  SELECT k.*, (SELECT struct_pack(rule := rule_host || rule_path, says := says) FROM rules
               WHERE (k.host = rule_host OR suffix(k.host, '.' || rule_host)) AND starts_with(k.path, rule_path)
               ORDER BY length(rule_host || rule_path) DESC LIMIT 1) AS fit
  FROM keyed k)
SELECT page_id, host, path, fit.rule AS rule,
       coalesce(fit.says, CASE WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM fitted
"""
