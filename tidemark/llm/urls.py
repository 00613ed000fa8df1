r"""URL rules by host-suffix and path-prefix expressions.

A rule (host, path, verdict) fits the URLs of its host and of all subdomains whose path starts with the rule's path; the longest
rule wins. A URL is expanded into the expressions that a rule could have: the last labels of its host followed by a prefix
of its path, in those shapes (labels, length of path) only that some rule has. Expressions and rules are equi-joined on the first 32 bits
of a SHA-256, and a pair counts only if the full digests are equal.

A shape is cut at ``LABELS`` labels and ``PATH`` characters, so there are at most ``LABELS * (PATH + 1)`` of them whatever the rules are. A longer rule is
found by its cut expression, and its full digest is compared with that of the URL in the rule's own shape. So no rule is lost to the cut.

Rules of at most ``BROADCAST_BYTES`` in all (counted) are broadcast. More are joined by a shuffle in which the URLs of an expression are
dealt over ``SALTS`` tasks and each rule is sent to all of them, so that ``com/``, which a third of all rows may have, isn't one task's work.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end. A null
URL, or one without ``://``, has an empty host and path, and no rule fits it. Rules without a host or verdict are left out; a null path is
empty. Of two rules of equal host and path ``block`` wins; of two rules of equal length the one of the longer host. Repeated rows are judged
each by itself; columns of the pages stay, and those that are named as a result are replaced. Empty tables give an empty result, or the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise

from .texts import table

LABELS, PATH = 127, 256
BROADCAST_BYTES, SALTS = 4_000_000, 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host, path and verdict of the query's rules.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _suffix(labels: Column, n: Column) -> Column:
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def _expression(host: Column, path: Column) -> Column:
    """A host may not hold a slash and a path begins with one or is empty, so the two can't be taken for another pair."""
    return F.concat(host, F.lit("\n"), path)


def _short(expression: Column) -> Column:
    return F.conv(F.substring(F.sha2(expression, 256), 1, 8), 16, 10).cast("long")


def compiled(rules: DataFrame) -> DataFrame:
    """A row for each host and path of ``rules`` (host, path, verdict): rule, verdict, labels, path_chars, short (hash prefix of the cut expression), digest, and its cut shape k, m."""
    host = F.translate("host", _UPPER, _LOWER)
    known = rules.where("host <> '' and verdict is not null").select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    one = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is after allow
    labels = F.split("host", r"\.")
    k, m = F.least(F.size(labels), F.lit(LABELS)), F.least(F.length("path"), F.lit(PATH))
    return one.select(
        F.concat("host", "path").alias("rule"), "verdict", F.size(labels).alias("labels"), F.length("path").alias("path_chars"), F.length("host").alias("host_chars"), k.alias("k"), m.alias("m"),
        _short(_expression(_suffix(labels, k), F.substring("path", F.lit(1), m))).alias("short"), F.sha2(_expression(F.col("host"), F.col("path")), 256).alias("digest"),
    )


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` without ``url`` and html, with host, path, rule (null where none fits) and verdict (``default`` there)."""
    host, path = host_and_path(F.col(url))
    names = [c for c in pages.columns if c not in (url, "html", "host", "path", "rule", "verdict")]
    rows = materialise(pages.select(*(f"`{c}`" for c in names), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("__row")))
    known = materialise(compiled(rules))
    size = known.agg(F.coalesce(F.sum(F.length("rule") + 200), F.lit(0))).first()[0]
    shapes = known.select("k", "m").distinct().collect()  # at most LABELS * (PATH + 1)
    labels = F.split("host", r"\.")
    can = F.array(*(F.struct(F.lit(r.k).alias("k"), F.lit(r.m).alias("m")) for r in shapes)) if shapes else F.expr("cast(array() as array<struct<k: int, m: int>>)")
    fits = F.filter(can, lambda s: (F.size(labels) >= s["k"]) & (F.length("path") >= s["m"]) & (F.col("host") != ""))
    shorts = F.array_distinct(F.transform(fits, lambda s: _short(_expression(_suffix(labels, s["k"]), F.substring(F.col("path"), F.lit(1), s["m"])))))
    expanded = rows.select("__row", "host", "path", F.explode(shorts).alias("short"))
    if size <= broadcast_bytes:
        pairs = expanded.join(F.broadcast(known), "short")
    else:
        salted = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = expanded.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int")).join(salted, ["short", "__salt"])
    inside = (F.size(F.split("host", r"\.")) >= F.col("labels")) & (F.length("path") >= F.col("path_chars"))
    own = F.sha2(_expression(_suffix(F.split("host", r"\."), F.col("labels")), F.substring("path", F.lit(1), F.col("path_chars"))), 256)
    held = pairs.where(inside).where(own == F.col("digest"))
    longest = F.struct(F.length("rule"), "host_chars")
    best = held.groupBy("__row").agg(F.max_by(F.struct("rule", "verdict"), longest).alias("__best"))
    out = rows.join(best, "__row", "left")
    return out.select(*(f"`{c}`" for c in names), "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP13_SQL = """
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as h from a),
u as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from h),
r(host, path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
j as (select u.page_id, u.host, u.path, (select arg_max(row(r.host || r.path, r.verdict), length(r.host || r.path)) from r where (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path)) as best from u)
select page_id, host, path, best[1] as rule, coalesce(best[2], 'allow') as verdict from j
"""
