"""URL filter: rules first, else a path-template tree whose templates are judged by purity.

Method. Each URL is a host and path segments. Per host, variable segments are
generalised into wildcards: numbers and long mixed identifiers at once, other
segments, at every level of the path, where a branch has more different children
than `max_children`. Branches with the same template after that are pooled across
hosts under one merged branch, if their shares of blocked URLs are statistically alike. A template's labelled
purity is the share of blocked URLs among those that a rule judges, smoothed
towards its parents: host template <- merged template <- all labelled URLs. URLs that no rule
judges are blocked where the smoothed purity exceeds `reject_above`.

Defined results. Null URL or no "://": empty host and path, no
rule, template "", allowed.
No labelled URL at all: every URL without a rule is allowed. Repeated rows count
as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracestrata import materialize
from tracestrata.llm.joins import sized
from tracestrata.llm.text import lower_ascii

# (verdict, host, path) as the contract states them.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

MAX_CHILDREN = 32
PRIOR = 8.0
REJECT_ABOVE = 0.6
# Difference of two branches' shares, in standard errors, up to which they are alike.
ALIKE = 2.0


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), else null."""
    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    found = F
    for verdict, name, prefix in longest_first:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = found.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict")))
    return found


def generalised(path: Column) -> Column:
    """Path segments with variable ones as wildcards; a file ending stays."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")

    def wild(s: Column) -> Column:
        stem = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "")
        variable = stem.rlike(r"^[0-9]+$") | stem.rlike(r"^(?=.*[0-9])[0-9A-Za-z_-]{6,}$")
        return F.when(variable, F.concat(F.lit("*"), F.substr(s, F.length(stem) + 1))).otherwise(s)

    return F.transform(segments, wild)


def templates(
    urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_children: int = MAX_CHILDREN
) -> DataFrame:
    """page_id, host, path, rule, rule_verdict, template of each URL."""
    parsed = urls.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    # A segment holds no "/", so the joined text stands for the list.
    seen = materialize(
        parsed.select(
            "page_id", "host", "path", F.col("fit.rule").alias("rule"),
            F.col("fit.verdict").alias("rule_verdict"), F.array_join(generalised(F.col("path")), "/").alias("whole"),
        )
    )
    merged = path_tree(seen.select("host", "whole").distinct(), max_children)
    return seen.join(sized(merged), ["host", "whole"], "left").select(
        "page_id", "host", "path", "rule", "rule_verdict", F.coalesce("template", "whole").alias("template")
    )


def path_tree(paths: DataFrame, max_children: int = MAX_CHILDREN) -> DataFrame:
    """host, whole, template of the distinct paths (host, whole) whose template differs from them; stored.

    Level by level, a branch (host and template so far) with more than
    `max_children` different children, its own end included, has one wildcard
    instead of them; the next level counts what is below that wildcard together.
    Only paths of branches with more than `max_children` paths go on to the next
    level, since no other branch can be wide, there or below.
    """
    live = materialize(
        paths.select("host", "whole", F.filter(F.split("whole", "/"), lambda s: s != "").alias("parts"), F.lit("").alias("prefix"))
    )
    ended, level = [], 0
    while True:
        child = F.coalesce(F.get("parts", F.lit(level)), F.lit(""))
        # Children are aggregated before they are counted per branch: a host with a
        # third of all rows costs no more than its branches.
        branches = materialize(
            live.groupBy("host", "prefix", child.alias("child")).agg(F.count("*").alias("n"))
            .groupBy("host", "prefix").agg(F.count("*").alias("children"), F.sum("n").alias("n"))
            .where(F.col("n") > max_children).select("host", "prefix", (F.col("children") > max_children).alias("wide"))
        )
        if branches.isEmpty():
            break
        named = F.concat("prefix", F.lit("/"), F.when(F.col("wide"), F.lit("*")).otherwise(child))
        stepped = materialize(
            live.join(sized(branches), ["host", "prefix"], "left").select(
                "host", "whole", "parts", F.when(F.col("wide").isNull() | (child == ""), F.col("prefix")).otherwise(named).alias("prefix"),
                (F.col("wide").isNotNull() & (child != "")).alias("on"),
            )
        )
        ended.append(_ended(stepped.where("not on"), level))
        live, level = stepped.where("on"), level + 1
    found = _ended(live, level)
    for rows in ended:
        found = found.unionAll(rows)
    return materialize(found.where("template <> whole"))


def _ended(rows: DataFrame, level: int) -> DataFrame:
    """host, whole, template of paths whose segments from `level` on stay."""
    rest = F.slice("parts", level + 1, 1 << 30)
    template = F.concat("prefix", F.when(F.size(rest) > 0, F.concat(F.lit("/"), F.array_join(rest, "/"))).otherwise(""))
    return rows.select("host", "whole", F.substr(template, F.lit(2)).alias("template"))


def purity(judged: DataFrame, prior: float = PRIOR, alike: float = ALIKE) -> DataFrame:
    """host, template, smoothed share of blocked among labelled URLs.

    A host's branch whose share is within `alike` standard errors of the merged
    branch (same template, all hosts) is merged with it: it takes the merged
    share. Other branches are smoothed towards it with the weight `prior`.
    """
    blocked = F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0)
    own = materialize(
        judged.groupBy("host", "template").agg(
            F.count(blocked).alias("n"), F.coalesce(F.sum(blocked), F.lit(0)).alias("k")
        )
    )
    # The number of branches shrinks level by level: rows, branches, templates.
    merged = own.groupBy("template").agg(F.sum("n").alias("mn"), F.sum("k").alias("mk"))
    total = own.agg(F.sum("n").alias("an"), F.sum("k").alias("ak"))  # one row
    base = F.when(F.col("an") > 0, F.col("ak") / F.col("an")).otherwise(F.lit(0.0))
    merged = merged.join(F.broadcast(total)).select(
        "template", "mn", ((F.col("mk") + prior * base) / (F.col("mn") + prior)).alias("mp")
    )
    error = F.sqrt(F.col("mp") * (1 - F.col("mp")) / F.greatest(F.col("n"), F.lit(1)))
    near = F.abs(F.col("k") / F.greatest(F.col("n"), F.lit(1)) - F.col("mp")) <= alike * error
    smooth = (F.col("k") + prior * F.col("mp")) / (F.col("n") + prior)
    return own.join(merged, "template").select(
        "host", "template", F.col("n").alias("labelled"),
        F.when((F.col("n") == 0) | near, F.col("mp")).otherwise(smooth).alias("purity"),
    )


def judge(
    urls: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    max_children: int = MAX_CHILDREN,
    prior: float = PRIOR,
    reject_above: float = REJECT_ABOVE,
    alike: float = ALIKE,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of `urls` (page_id, url)."""
    seen = materialize(templates(urls, rules, max_children))
    scores = purity(seen, prior, alike)
    verdict = F.coalesce(
        F.col("rule_verdict"), F.when((F.col("host") != "") & (F.col("purity") > reject_above), F.lit("block")), F.lit("allow")
    )
    return seen.join(scores, ["host", "template"], "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "template",
        F.round("purity", 9).alias("purity"),
    )
