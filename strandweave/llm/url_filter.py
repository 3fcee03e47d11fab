"""URL rules by host-suffix and path-prefix expressions, short hash prefixes and full digests.

Every url is expanded into (host suffix, path prefix) expressions, path prefixes ending at slashes. A rule is
filed under the expression of its host and the longest slash-ended part of its path. Expressions and rules meet
in an equi-join on the first 32 bits of their SHA-256; the full digest and the rest of the rule's path are then
confirmed. Precedence is one number (length of the rule, length of its host, action), so the best rule of a page
is a maximum of longs that is combined inside the task that expanded the url.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; equal rules with
both actions block; repeated page rows each give a row; a url that no rule fits is allowed; an empty rule set
allows everything; rules with a null host or path fit nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are broadcast (32-bit prefix, digest, path: some 200 bytes each), more are shuffled.
BROADCAST_RULES = 100_000
#: Copies of each rule when rules are shuffled, so that an expression most urls have is spread over tasks.
SALTS = 64


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _slashed(path: str) -> str:
    """SQL of a path up to and with its last slash; empty without one."""
    return f"substring({path}, 1, length({path}) - length(substring_index({path}, '/', -1)))"


def _expressions(labels: int, slashes: int) -> Column:
    """Array of (suffix, prefix) pairs of columns ``host`` and ``path``, no deeper than any rule is."""
    hosts = f"""transform(sequence(1, least({labels}, length(host) - length(replace(host, '.', '')) + 1)),
        k -> substring_index(host, '.', -k))"""
    paths = f"""transform(sequence(0, least({slashes}, length(path) - length(replace(path, '/', '')))),
        k -> if(k = 0, '', concat(substring_index(path, '/', k), '/')))"""
    return F.expr(f"flatten(transform({hosts}, h -> transform({paths}, p -> struct(h AS h, p AS p))))")


def _digest(host: str, path: str) -> Column:
    return F.sha2(F.concat(F.col(host), F.lit("\n"), F.col(path)), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: ``<id_col>, host, path, rule, verdict``.

    ``rules`` has ``host, path, action`` (allow or block). A rule fits its host and all subdomains if the url's
    path starts with the rule's; the longest rule (host and path) wins, of equally long ones that with the
    longer host.
    """
    rules = rules.select(F.col("host").alias("_rh"), F.col("path").alias("_rp"), (F.col("action") == "block").cast("long").alias("_block"))
    rules = rules.where("_rh is not null and _rp is not null").withColumn("_rs", F.expr(_slashed("_rp")))
    depth = rules.agg(F.count("*"), F.max(F.expr("length(_rh) - length(replace(_rh, '.', '')) + 1")),
                      F.max(F.expr("length(_rs) - length(replace(_rs, '/', ''))"))).first()
    count, labels, slashes = depth[0], depth[1] or 1, depth[2] or 0
    rules = rules.select(
        _digest("_rh", "_rs").alias("_rule_digest"), "_rp",
        F.expr("shiftleft(cast(length(_rh) + length(_rp) as bigint), 32) + shiftleft(cast(length(_rh) as bigint), 1) + _block").alias("_rank"))
    rules = rules.withColumn("_prefix", F.substring("_rule_digest", 1, 8))

    # a number per row keeps repeated rows apart; all expressions of a row are aggregated where they were made
    rows = pages.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"),
        host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    opened = rows.withColumn("_e", F.explode(_expressions(labels, slashes))).withColumn("_digest", _digest("_e.h", "_e.p")).drop("_e")
    opened = opened.withColumn("_prefix", F.substring("_digest", 1, 8))
    if count <= BROADCAST_RULES:
        met = opened.join(F.broadcast(rules), "_prefix", "left")
    else:
        salted = rules.withColumn("_salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
        met = opened.withColumn("_salt", F.expr(f"cast(pmod(_row, {SALTS}) as int)")).join(salted, ["_prefix", "_salt"], "left")
    fits = (F.col("_digest") == F.col("_rule_digest")) & F.expr("startswith(path, _rp)")
    best = met.groupBy("_row", "_id", "host", "path").agg(F.max(F.when(fits, F.col("_rank"))).alias("_best"))
    return best.select(
        F.col("_id").alias(id_col), "host", "path",
        F.expr("""concat(right(host, cast(shiftright(_best, 1) & 2147483647 as int)),
            left(path, cast(shiftright(_best, 32) - (shiftright(_best, 1) & 2147483647) as int)))""").alias("rule"),
        F.expr("if(_best & 1 = 1, 'block', 'allow')").alias("verdict"))
