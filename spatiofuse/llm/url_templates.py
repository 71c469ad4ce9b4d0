"""URL filters: declared rules, then a path-template tree judged by labelled purity.

Every host has a tree of path segments. Level by level, as deep as the paths go, a
segment stays a literal branch when it holds at least ``MIN_SHARE`` of its node's urls
and ``MIN_URLS`` of them; all others fall into wildcards by shape (digits ``#`` or
other ``*``, with the extension). Sibling branches with labels are taken in the order of
their shares of good ones; a branch joins the cluster before it unless a two-proportion
test tells it from the cluster's pooled counts or from its first member (|z| >=
``MERGE_Z``), so that neither a chain of small steps nor a branch without labels, which
stays by itself, can tie opposite branches. A template is rejected when its good share,
smoothed towards its host's and that towards the whole table's, is under ``MIN_PURITY``.

Rules come first: a rule ``host/path`` fits its host and all subdomains where the url's
path starts with the rule's; the longest that fits decides.

Defined results: a null url, or one without ``://``, has empty host and path and is
judged like any other host; an url without labels counts with its template's and
host's; an url of any length is judged by its whole path, and each further segment of
the deepest path is one more pass over the rows that are that deep; ties of shares are
taken by branch name; repeated rows are counted and judged each; null or repeated labels of an id
count as given; other columns play no part; an empty table gives an empty table.

Scale: only sums per (host, branch) are shuffled; literals of a node are at most
1 / ``MIN_SHARE``, and wildcards one for each extension of up to five characters. The
labelled branches of one node are clustered in one list: literals and wildcards, never
segments. Segments meet their node's size only where they have ``MIN_URLS`` urls; branch
tables join by AQE's measure of them; the url rows of a hot host are never grouped, and
a row whose path has ended is written once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatiofuse.llm.staging import staged

MIN_SHARE, MIN_URLS = 0.02, 20
MERGE_Z, SMOOTHING, MIN_PURITY = 1.96, 10.0, 0.5


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s).*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s).*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, list[str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. Rules are a declared list, tried longest first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(((r, v) for v, rs in rules.items() for r in rs), key=lambda x: len(x[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    stem = F.regexp_replace(segment, "\\.[A-Za-z0-9]{1,5}$", "")
    extension = F.regexp_extract(segment, "(\\.[A-Za-z0-9]{1,5})$", 1)
    return F.when(segment == "", "").otherwise(F.concat(F.when(stem.rlike("^[0-9]+$"), "#").otherwise("*"), extension))


def _differ(g: Column, n: Column, g0: Column, n0: Column) -> Column:
    """Two-proportion test of g good of n against g0 of n0, both with labels."""
    pooled = (g + g0) / (n + n0)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / n0))
    return (spread > 0) & (F.abs(g / n - g0 / n0) >= MERGE_Z * spread)


def _merged(branches: DataFrame) -> DataFrame:
    """(host, prefix, branch, group) of the branches with labels; siblings that no test tells apart share a group."""
    total = F.col("good") + F.col("bad")
    item = F.struct(((F.col("good") + 1) / (total + 2)).alias("share"), "branch", F.col("good").cast("double").alias("g"), total.cast("double").alias("n"))
    nodes = branches.filter(total > 0).groupBy("host", "prefix").agg(F.sort_array(F.collect_list(item)).alias("items"))
    # the open cluster's pooled counts, its first member's counts, its number, and the numbers given so far
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("g", "n", "g1", "n1")], F.lit(0).alias("k"), F.array().cast("array<int>").alias("all"))

    def step(a, x):
        new = (a["n"] == 0) | _differ(x["g"], x["n"], a["g"], a["n"]) | _differ(x["g"], x["n"], a["g1"], a["n1"])
        k = a["k"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, x["g"]).otherwise(a["g"] + x["g"]).alias("g"), F.when(new, x["n"]).otherwise(a["n"] + x["n"]).alias("n"),
                        F.when(new, x["g"]).otherwise(a["g1"]).alias("g1"), F.when(new, x["n"]).otherwise(a["n1"]).alias("n1"),
                        k.alias("k"), F.concat(a["all"], F.array(k)).alias("all"))

    nodes = nodes.withColumn("clusters", F.aggregate("items", start, step)["all"])
    rows = nodes.select("host", "prefix", F.explode(F.arrays_zip(F.col("items.branch").alias("branch"), F.col("clusters").alias("cluster"))).alias("x")).select("host", "prefix", "x.*")
    cluster = W.partitionBy("host", "prefix", "cluster")
    many = F.count(F.lit(1)).over(cluster)
    # a merged branch is named by its first member and how many it joined
    return rows.withColumn("group", F.when(many == 1, F.col("branch")).otherwise(F.concat(F.lit("{"), F.min("branch").over(cluster), F.lit("+"), (many - 1).cast("string"), F.lit("}")))) \
               .select("host", "prefix", "branch", "group")


def templates(urls: DataFrame) -> DataFrame:
    """From (row, host, path, good, bad): the same with ``template``. good and bad: numbers of the url's labels."""
    tree = staged(urls.withColumns({"parts": F.split(F.regexp_replace("path", "^/", ""), "/"), "prefix": F.lit("")}), "url-rows")
    done, depth = [], 0
    while True:
        open_rows = tree.filter(F.size("parts") > depth)
        if depth and open_rows.isEmpty():
            break
        done.append(tree.filter(F.size("parts") <= depth))
        tree = open_rows.withColumn("segment", F.get("parts", F.lit(depth)))
        children = staged(tree.groupBy("host", "prefix", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-children")
        nodes = children.groupBy("host", "prefix").agg(F.sum("n").alias("total"))
        held = children.filter(F.col("n") >= MIN_URLS).select("host", "prefix", "segment", "n").join(nodes, ["host", "prefix"])
        held = staged(held.filter(F.col("n") >= F.col("total") * MIN_SHARE).select("host", "prefix", "segment", F.lit(True).alias("literal")), "url-literals")
        branch = F.when(F.col("literal"), F.col("segment")).otherwise(_shape(F.col("segment")))
        sums = children.join(held, ["host", "prefix", "segment"], "left").groupBy("host", "prefix", branch.alias("branch")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        groups = staged(_merged(sums), "url-groups")
        tree = tree.join(held, ["host", "prefix", "segment"], "left").withColumn("branch", branch).join(groups, ["host", "prefix", "branch"], "left")
        tree = tree.withColumn("prefix", F.concat("prefix", F.lit("/"), F.coalesce("group", "branch"))).drop("segment", "literal", "branch", "group")
        tree, depth = staged(tree, "url-level"), depth + 1
    done.append(tree)
    return staged(reduce(DataFrame.unionByName, done).drop("parts").withColumnRenamed("prefix", "template"), "url-templates")


def judged(pages: DataFrame, labels: DataFrame, rules: dict[str, list[str]], id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, template, purity, rule, verdict) of every page. ``labels``: (id, good boolean)."""
    good = labels.select(F.col("id").alias("_id"), F.when(F.col("good"), 1).otherwise(0).alias("g")).groupBy("_id").agg(F.sum("g").alias("good"), (F.count(F.lit(1)) - F.sum("g")).alias("bad"))
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    none = F.lit(0).cast("long")
    rows = rows.join(good, F.col("id") == F.col("_id"), "left").drop("_id").withColumns({"good": F.coalesce("good", none), "bad": F.coalesce("bad", none)})
    tree = templates(rows)
    per = tree.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    hosts = per.groupBy("host").agg(F.sum("g").alias("hg"), F.sum("b").alias("hb"))
    whole = hosts.agg(((F.coalesce(F.sum("hg"), none) + 1) / (F.coalesce(F.sum("hg") + F.sum("hb"), none) + 2)).alias("prior"))  # one row
    host_share = (F.col("hg") + SMOOTHING * F.col("prior")) / (F.col("hg") + F.col("hb") + SMOOTHING)
    purity = (F.col("g") + SMOOTHING * host_share) / (F.col("g") + F.col("b") + SMOOTHING)
    share = whole.first()["prior"]
    scores = staged(per.join(hosts, "host").withColumn("prior", F.lit(share)).select("host", "template", purity.alias("purity")), "url-purity")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (tree.join(scores, ["host", "template"]).withColumns({"rule": rule, "said": verdict})
            .select("id", "host", "path", "template", "purity", "rule",
                    F.coalesce("said", F.when(F.col("purity") < MIN_PURITY, "block").otherwise("allow")).alias("verdict")))
