"""URL verdicts: host and path rules first, then a blocked Bloom filter of listed URLs and an exact join.

A rule fits its host and all subdomains where the path starts with the rule's; the longest that fits
decides. Other URLs are reduced to a canonical form. The filter is a table of blocks of eight 32-bit
words; a URL's hash names one block and one bit in each word, so the filter is built by one bit-or
aggregate and asked by one join on the block. Only possible hits go on to a hash join on the canonical
URL itself, which removes false positives: the verdict is exact.

All in DataFrame functions. A null URL, or one without ``://``, has an empty host and path, fits no
rule and is not listed. Repeated rows are judged alike; an empty table or list works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parameters that name a visit, not a page.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid|sessionid)(=|$)"
#: 32-bit words in a block of the filter.
WORDS_IN_BLOCK = 8
#: Bits a filter spends on a listed URL: about one false hit in two hundred.
BITS_PER_KEY = 16


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), _A, _Z), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without user, default port or leading ``www.``, path without last slash, sorted parameters.

    The scheme, the fragment and tracking parameters are dropped. Null where there is no host.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^.*@|:(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest ``(action, rule)`` that fits, as a struct; null if none does."""
    out = None
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r)):
        name, _, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{start}"))
        found = F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<action:string,rule:string>")


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), blocks)


def _bits(hash_: str) -> list[Column]:
    """One bit in each word of a block, as a long: five bits of the hash say which."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned({hash_}, {5 * i}) & 31 as int))") for i in range(WORDS_IN_BLOCK)]


def bloom_blocks(listed: DataFrame, key: str) -> DataFrame:
    """``(block, blocks, w0..w7)``: the filter of the distinct keys, sized by their count."""
    keys = listed.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct()
    size = keys.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * BITS_PER_KEY / (32 * WORDS_IN_BLOCK))).alias("blocks"))
    placed = keys.crossJoin(F.broadcast(size)).select("blocks", _block(F.col("k"), F.col("blocks")).alias("block"), F.xxhash64("k").alias("h"))  # one row of size
    bits = placed.select("block", "blocks", *[b.alias(f"w{i}") for i, b in enumerate(_bits("h"))])
    return bits.groupBy("block", "blocks").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS_IN_BLOCK)])


def possible_hits(asked: DataFrame, key: str, filter_: DataFrame) -> DataFrame:
    """Distinct keys of ``asked`` that the filter does not rule out."""
    size = filter_.agg(F.coalesce(F.max("blocks"), F.lit(1)).alias("blocks"))
    keys = asked.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct()
    placed = keys.crossJoin(F.broadcast(size)).select("k", _block(F.col("k"), F.col("blocks")).alias("block"), F.xxhash64("k").alias("h"))
    hit = F.lit(True)
    for i, bit in enumerate(_bits("h")):
        hit = hit & (F.col(f"w{i}").bitwiseAND(bit) == bit)
    return placed.join(filter_.drop("blocks"), "block").where(hit).select(F.col("k").alias(key))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``page_id, host, path, rule, verdict``; ``listed`` has a column ``url`` of URLs to block."""
    url = F.col("url")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    ruled = parsed.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    keys = listed.select(canonical(F.col("url")).alias("canonical")).where("canonical IS NOT NULL").distinct()
    open_ = ruled.where("_r IS NULL")
    possible = possible_hits(open_, "canonical", bloom_blocks(keys, "canonical"))
    blocked = possible.join(keys, "canonical", "left_semi").withColumn("listed", F.lit(True))
    return ruled.join(blocked, "canonical", "left").select(
        "page_id", "host", "path", F.col("_r.rule").alias("rule"),
        F.coalesce("_r.action", F.when(F.col("listed"), "block"), F.lit("allow")).alias("verdict"),
    )
