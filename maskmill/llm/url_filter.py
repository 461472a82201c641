"""URL rules: a blocked Bloom filter of the listed canonical URLs, then an exact hash join (operator 2).

All of it is DataFrame functions. A rule is a host and the start of a path. A url's candidates are its host's suffixes at dots,
each with its path cut to each length that some rule's path has. The filter is an array of 64-bit blocks: one hash of a
candidate chooses its block, three more its bits. The array never has more than MAX_BLOCKS blocks, however long the list: a fuller
filter lets more candidates through, and the join that follows sorts them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

MAX_BLOCKS = 1 << 13
BITS_FOR_EACH = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host is what follows the first ://, up to /, ? or #, A-Z lower-cased; path goes on up to ? or #."""
    after = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    one = F.lit(1).cast("long")
    a, b, c = (F.call_function("shiftleft", one, F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(64)).cast("int")) for salt in "abc")
    return a.bitwiseOR(b).bitwiseOR(c)


def _key(host: Column, path: Column) -> Column:
    return F.concat_ws(" ", host, path)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """pages with url_host, url_path, url_rule (host and path of the rule that decides, else null) and url_verdict.

    rules: host, path, verdict (allow or block); host lower-case. A rule fits its host and all hosts below it, if the url's
    path starts with the rule's; of several the one with the longest text decides, then the longer host, then block before
    allow. A url without a rule is not listed: `otherwise`. Null urls and those without :// have an empty host and path.
    Rules with a null part are left out, repeated ones count once; no rules: all urls `otherwise`. Rows and other columns stay
    as they are; columns by the new names are replaced.
    """
    new = ("url_host", "url_path", "url_rule", "url_verdict")
    listed = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    # the distinct lengths of paths are few, whatever the list's size
    facts = listed.agg(F.count("*").alias("n"), F.collect_set(F.length("path")).alias("lengths"), F.max(F.size(F.split("host", r"\."))).alias("labels")).first()
    host, path = url_parts(F.col("url"))
    base = pages.select(F.struct(*[c for c in pages.columns if c not in new]).alias("page"), F.col(url_col).alias("url"))
    base = base.select("page", host.alias("host"), path.alias("path"))
    if facts["n"]:
        blocks = 1
        while blocks < min(facts["n"] * BITS_FOR_EACH / 64, MAX_BLOCKS):
            blocks *= 2
        key = _key(F.col("host"), F.col("path"))
        filled = listed.groupBy(_block(key, blocks).alias("block")).agg(F.bit_or(_mask(key)).alias("mask")).collect()
        words = dict((r["block"], r["mask"]) for r in filled)
        bloom = F.lit([words.get(i, 0) for i in range(blocks)]).cast("array<bigint>")
        labels = F.split("host", r"\.")
        suffixes = F.transform(
            F.sequence(F.greatest(F.lit(1), F.size(labels) - F.lit(facts["labels"] - 1)), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        )
        lengths = F.filter(F.lit(sorted(facts["lengths"])), lambda n: n <= F.length("path"))
        candidates = F.flatten(F.transform(suffixes, lambda h: F.transform(lengths, lambda n: F.struct(h.alias("host"), F.substring(F.col("path"), F.lit(1), n).alias("path")))))
        passes = lambda c: F.get(bloom, _block(_key(c["host"], c["path"]), blocks)).bitwiseAND(_mask(_key(c["host"], c["path"]))) == _mask(_key(c["host"], c["path"]))
        possible = base.select("host", "path").distinct().withColumn("c", F.explode(F.filter(candidates, passes)))
        hits = possible.join(listed.select(F.struct("host", "path").alias("c"), "verdict"), "c")
        text = F.concat("c.host", "c.path")
        best = F.max(F.struct(F.length(text), F.length("c.host"), "verdict", text.alias("rule")))
        decided = hits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")
        decided = cut(decided)  # so that the join's sides are dealt for it alone, and a hot url's rows can be split
        base = base.join(decided, ["host", "path"], "left")
    else:
        base = base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    return base.select("page.*", F.col("host").alias("url_host"), F.col("path").alias("url_path"), F.col("rule").alias("url_rule"), F.coalesce("verdict", F.lit(otherwise)).alias("url_verdict"))
