"""2. URL filters by a sort-merge range join.

A URL's canonical key is its host's labels in reverse, each with a dot behind it, then path and query:
``https://www.Blog.example.org/a?b#c`` -> ``org.example.blog./a?b``. A rule for a domain with its subdomains, or for a path
prefix of one host, is a prefix of such keys, so it covers one interval of the sorted keys, and the intervals of two rules
are nested or apart.

Plan: keys and rules are range-partitioned by the same bounds, a rule going to every partition that its interval meets;
inside a partition one sorted sweep keeps the stack of active nested rules. The top of the stack is the most specific rule
and decides. One shuffle of short keys; neither rules nor pages are broadcast, however many there are. The bounds come
from a sample of keys and change the balance only, never a result.

Defined results: a null URL, or one without a host, has no key, matches no rule and is kept. Of rules with one prefix
"block" beats "allow", then the smaller rule_id wins. Rules whose pattern or action is null or empty don't count.
Repeated rows are each decided; extra columns aren't looked at, and stay in :func:`accepted`.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoflow.plans.register import source
from phonoflow.session import cut_lineage

#: (pattern, action): a domain, with its subdomains, or host/path-prefix.
DEFAULT_RULES = [
    ("ads-track.example.com", "block"), ("spam-farm.example.org", "block"), ("casino-win.example.net", "block"),
    ("adult-x.example.com", "block"), ("cheap-pills.example.net", "block"), ("free-bets.example.net", "block"),
    ("blog.cheap-pills.example.net", "allow"), ("blog.cheap-pills.example.net/de/", "block"), ("blog.cheap-pills.example.net/de/1", "allow"),
    ("tionsh.example.net/es/", "block"), ("tionsh.example.net/es/2", "allow"), ("m.example.org", "block"), ("example.org", "allow"),
    ("net", "allow"), ("tracker.example.com", "block"), ("tionble.example.com", "block"), ("blog.tionble.example.com/en/", "allow"),
]
#: keys that reach the driver for the bounds
_SAMPLE_PER_PARTITION, _SAMPLE_AT_MOST = 200, 500_000


def url_key(url: Column) -> Column:
    """The canonical key of a URL; null without a host."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, scheme + r"(?:[^/?#@]*@)?([^/?#:@]*)", 1)), r"^www\.|\.$", "")
    path = F.regexp_extract(url, scheme + r"[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)))
    return F.when(host != "", key)


def rule_prefix(pattern: Column) -> Column:
    """The key prefix of a rule's pattern."""
    host = F.regexp_replace(F.lower(F.regexp_extract(pattern, "^([^/]*)", 1)), r"^www\.|\.$", "")
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."), F.regexp_extract(pattern, "^[^/]*(.*)$", 1)))


def _bounds(keys: DataFrame, parts: int) -> list[str]:
    """Ascending keys at which partitions start."""
    total = keys.count()
    if not total or parts < 2:
        return []
    got = sorted(r[0] for r in keys.select("key").where("key is not null").sample(min(1.0, min(parts * _SAMPLE_PER_PARTITION, _SAMPLE_AT_MOST) / total), seed=5).collect())
    return sorted({got[len(got) * i // parts] for i in range(1, parts)}) if got else []


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, key, kind, action, id) in order; rules have kind 0 and come before the URLs that start with them."""
    stack: list[tuple[str, int, str]] = []
    part = None
    for b in batches:
        ids, rules, actions = [], [], []
        for p, key, kind, action, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if p != part:
                part, stack = p, []
            while stack and not (key or "").startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, i, action))
            else:
                ids.append(i)
                rules.append(stack[-1][1] if stack else None)
                actions.append(stack[-1][2] if stack else None)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rules, pa.int64()), pa.array(actions, pa.string())], ["id", "rule_id", "action"])


def decided(keys: DataFrame, rules: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, rule_id, action) of every row of ``keys`` (id, key); rule_id and action are null where no rule matches."""
    parts = parts or max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(keys, parts)

    @F.arrow_udf("int")
    def part_of(key: pa.Array) -> pa.Array:
        return pa.array([0 if k is None else bisect_right(bounds, k) for k in key.to_pylist()], pa.int32())

    prefixes = rules.select(F.col("rule_id").cast("long").alias("id"), rule_prefix(F.col("pattern")).alias("key"), "action").where("id is not null and key is not null and action in ('allow', 'block')")
    spread = prefixes.withColumns({"lo": part_of("key"), "hi": part_of(F.concat("key", F.lit("\U0010ffff")))})
    left = spread.select(F.explode(F.sequence("lo", "hi")).alias("part"), "key", F.lit(0).alias("kind"), "action", "id")
    right = keys.select(part_of("key").alias("part"), F.col("key"), F.lit(1).alias("kind"), F.lit("").alias("action"), F.col("id").cast("long").alias("id"))
    merged = left.unionByName(right).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "kind", "action", F.col("id").desc())
    return merged.mapInArrow(_sweep, "id long, rule_id long, action string")


def decisions(pages: DataFrame, rules: DataFrame, parts: int | None = None) -> DataFrame:
    """(page_id, rule_id, keep) of every row of ``pages``; rule_id is -1 where no rule matches."""
    out = decided(pages.select(pages["page_id"].alias("id"), url_key(pages["url"]).alias("key")), rules, parts)
    return out.select(F.col("id").alias("page_id"), F.coalesce("rule_id", F.lit(-1)).alias("rule_id"), (F.coalesce("action", F.lit("allow")) != "block").alias("keep"))


def accepted(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``pages`` that aren't blocked; columns as they were."""
    urls = cut_lineage(pages.select(pages["url"].alias("_url")).where("_url is not null").distinct().withColumn("_id", F.monotonically_increasing_id()))
    out = decided(urls.select(F.col("_id").alias("id"), url_key(F.col("_url")).alias("key")), rules).where("action = 'block'").select(F.col("id").alias("_blocked"))
    blocked = urls.join(out, F.col("_id") == F.col("_blocked")).select("_url")
    return pages.join(blocked, pages["url"] == blocked["_url"], "left_anti")


def default_rules(spark: SparkSession) -> DataFrame:
    """DEFAULT_RULES as (rule_id, pattern, action)."""
    return spark.createDataFrame([(i, p, a) for i, (p, a) in enumerate(DEFAULT_RULES)], "rule_id long, pattern string, action string")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision for every page."""
    return decisions(source(spark, sf_dir, "pages"), default_rules(spark))


_VALUES = ", ".join(f"({i}, '{p}', '{a}')" for i, (p, a) in enumerate(DEFAULT_RULES))
_REVERSED = "array_to_string(list_reverse(string_split({h}, '.')), '.') || '.'"
ORACLE = f"""
WITH u AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '^www\\.|\\.$', '') AS host,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS path,
                  row_number() OVER (ORDER BY page_id, url) AS r FROM pages),
k AS (SELECT page_id, r, CASE WHEN host <> '' THEN {_REVERSED.format(h="host")} || CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END END AS key FROM u),
rules(rule_id, pattern, action) AS (VALUES {_VALUES}),
p AS (SELECT CAST(rule_id AS BIGINT) AS rule_id, action, {_REVERSED.format(h="regexp_extract(pattern, '^([^/]*)', 1)")} || regexp_extract(pattern, '^[^/]*(.*)$', 1) AS prefix FROM rules),
m AS (SELECT k.page_id, k.r, p.rule_id, p.action, row_number() OVER (PARTITION BY k.r ORDER BY length(p.prefix) DESC, p.action DESC, p.rule_id) AS pick
      FROM k LEFT JOIN p ON starts_with(k.key, p.prefix))
SELECT page_id, coalesce(rule_id, -1) AS rule_id, coalesce(action, 'allow') <> 'block' AS keep FROM m WHERE pick = 1
"""
