"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join. DataFrame functions only.

The filter is a table (block, 64-bit mask), built by ``bit_or`` with map-side combining. A page's canonical URL picks
one block and sets ``k`` bits in it; only pages whose bits are all set reach the exact join on the URL itself, which
removes the false positives. Both joins are plain equi-joins. The list is written once and its rows and bytes are counted;
the masks are broadcast up to ``broadcast_blocks`` blocks, the list up to ``broadcast_bytes``, otherwise Spark shuffles
them. Pages that cannot meet anything get a key of their own in both joins, so they are no hot key and pages are read once.

Cases: a null url or one without ``://`` has an empty host and path, fits no rule and is on no list (allow). Empty
pages give an empty result, an empty list lets everything pass. Repeated rows stay repeated. Other columns of the
input are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rules of the contract: action, host, path. The longest that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BITS_PER_URL, BITS_SET = 16, 5


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty for null or without one."""
    return F.coalesce(F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def rule_fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def decide(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; nulls if none does. The rules are a short parameter."""
    rule = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # later, longer ones override
        fits = rule_fits(host, path, h, p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.``/``m.`` and port, path without ``index.html``, ``.html`` and a closing slash."""
    h = F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"^(www|m)\.", "")
    p = F.regexp_replace(path, r"(/index)?(\.html?)?/?$", "")
    return F.when(host != "", F.concat(h, p))


def bloom_bits(key: Column) -> Column:
    """The bits of one URL in its 64-bit block, from one hash: five six-bit slices."""
    h, mask = F.xxhash64(F.lit(1), key), F.lit(0).cast("long")
    for i in range(BITS_SET):
        mask = mask.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        )
    return mask


def build_bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, mask) of the listed canonical URLs in column ``canon``."""
    return (
        listed.select(F.pmod(F.xxhash64("canon"), F.lit(blocks)).alias("block"), bloom_bits(F.col("canon")).alias("m"))
        .groupBy("block")
        .agg(F.bit_or("m").alias("mask"))
    )


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    broadcast_blocks: int = 1 << 20,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """page_id, host, path, rule, verdict, canon, maybe_listed, listed: the rule's action, else block if listed.

    listed: canonical URLs in a column ``canon``; nulls and repeats are ignored.
    """
    listed = cut(listed.select("canon").where("canon is not null").distinct())
    stats = listed.agg(F.count("*").alias("n"), F.sum(F.octet_length("canon") + 16).alias("bytes")).first()
    blocks = max(1, -(-stats["n"] * BITS_PER_URL // 64))
    bloom = build_bloom(listed, blocks)
    if blocks <= broadcast_blocks:  # 16 bytes a block
        bloom = F.broadcast(bloom)
    url = F.col(url_col)
    df = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64(F.lit(3), id_col, url_col).alias("spread"))
    rule, action = decide(F.col("host"), F.col("path"), rules)
    df = df.select("*", rule.alias("rule"), action.alias("action"), canonical(F.col("host"), F.col("path")).alias("canon"))
    block = F.pmod(F.when(F.col("canon").isNull(), F.col("spread")).otherwise(F.xxhash64("canon")), F.lit(blocks))
    df = df.withColumn("block", block).withColumn("bits", bloom_bits(F.col("canon")))
    df = df.join(bloom, "block", "left").withColumn(
        "maybe_listed", F.col("canon").isNotNull() & F.coalesce(F.col("mask").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False))
    )
    # a page that the filter turned away gets a key that no listed URL has
    probe = df.withColumn("probe", F.when(F.col("maybe_listed"), F.col("canon")).otherwise(F.concat(F.lit("\x00"), F.hex("spread"))))
    hits = listed.select(F.col("canon").alias("probe"), F.lit(True).alias("hit"))
    if (stats["bytes"] or 0) <= broadcast_bytes:
        hits = F.broadcast(hits)
    out = probe.join(hits, "probe", "left")
    on_list = F.coalesce(F.col("hit"), F.lit(False))
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce(F.col("action"), F.when(on_list, "block").otherwise("allow")).alias("verdict"),
        "canon", "maybe_listed", on_list.alias("listed"),
    )
