import math
import re
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatiofuse.llm import url_templates as ut
from spatiofuse.llm.catalog import QUERIES, RULES
from tests.llm.conftest import table


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host):])[0]


def rule(host, path):
    best = None
    for says, rules in RULES.items():
        for r in rules:
            name, _, rest = r.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(r) > len(best[0])):
                best = (r, says)
    return best or (None, None)


def test_fixture(spark, folder):
    got = {r["page_id"]: r for r in QUERIES["op5_url_filters"](spark, folder).collect()}
    pages = table(folder, "pages")
    assert len(got) == len(pages)
    for p in pages:
        r = got[p["page_id"]]
        host, path = parts(p["url"])
        name, says = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, name)
        assert r["verdict"] == (says or ("block" if r["purity"] < ut.MIN_PURITY else "allow"))


def judged(spark, urls, labels):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, n int")
    return ut.judged(pages, spark.createDataFrame(labels, "id long, good boolean"), RULES)


def test_parsing(spark):
    urls = [None, "", "no scheme/en/", "http://", "https://A.Example.COM", "http://www.example.com/en/1", "http://a.www.example.com/en/", "http://example.com/en/x?y#z", "http://m.example.com/en", "http://x.net/es/#t",
            "http://net/fr/", "http://notexample.com/en/", "http://u@h:80/p//q/?a://b", "http://h?x/y", "ftp://É.com/é?", "http://xnet/es/", "http://a\nb/c\nd?e", "x://y://z/w", "http://h.org/a/b/c/d/e/f/g"]
    for r in judged(spark, urls, []).collect():
        host, path = parts(urls[r["id"]])
        assert (r["host"], r["path"]) == (host, path), urls[r["id"]]
        name, says = rule(host, path)
        assert r["rule"] == name and r["verdict"] == (says or "allow")


def test_templates_by_purity(spark):
    """Good articles, bad listings on one hot host; a host with good pages only; variable segments go."""
    urls, labels = [], []
    for i in range(600):
        kind = ("news", "tag", "blog")[i % 3]
        urls.append(f"http://hot.org/{kind}/{i * 7 + 1}")
        if i % 2:
            labels.append((i, kind != "tag"))
    urls += [f"http://calm.org/p/{w}-{i}.html" for i, w in enumerate("abcdefgh" * 10)]
    labels += [(600 + i, True) for i in range(0, 80, 4)]
    rows = judged(spark, urls, labels).collect()
    seen = Counter((urls[r["id"]].split("/")[3], r["template"], r["verdict"]) for r in rows)
    assert {k[2] for k in seen if k[0] == "tag"} == {"block"} and {k[2] for k in seen if k[0] != "tag"} == {"allow"}
    assert {k[1] for k in seen if k[0] == "tag"} == {"/tag/#"}
    assert {k[1] for k in seen if k[0] in ("news", "blog")} == {"/{blog+1}/#"}  # alike, so one branch
    assert {k[1] for k in seen if k[0] == "p"} == {"/p/*.html"}
    assert len(rows) == len(urls)


def test_branches_without_labels_tie_nothing(spark):
    """An unlabelled sibling stays by itself; a bad branch stays bad beside it."""
    kinds = ("news", "tag", "blog")
    urls = [f"http://hot.org/{kinds[i % 3]}/{i * 7 + 1}" for i in range(600)] + [f"http://hot.org/misc/{i}" for i in range(100)]
    rows = judged(spark, urls, [(i, kinds[i % 3] != "tag") for i in range(1, 600, 2)]).collect()
    seen = {(urls[r["id"]].split("/")[3], r["template"], r["verdict"]) for r in rows}
    assert seen == {("tag", "/tag/#", "block"), ("news", "/{blog+1}/#", "allow"), ("blog", "/{blog+1}/#", "allow"), ("misc", "/misc/#", "allow")}


def test_chains_of_small_steps_are_cut(spark):
    """Branches at good shares 0, 0.1 ... 1: neighbours are alike, ends are not."""
    urls, labels = [], []
    for k in range(11):
        for i in range(50):
            labels.append((len(urls), i < 5 * k))
            urls.append(f"http://steps.org/b{k:02d}/{i}")
    template = {urls[r["id"]].split("/")[3]: r["template"] for r in judged(spark, urls, labels).collect()}
    assert template == brute_clusters([(f"b{k:02d}", 5 * k, 50) for k in range(11)])
    assert len(set(template.values())) > 2


def brute_clusters(branches):
    """Template of each branch by the definition: pooled counts and first member."""
    def differ(g, n, g0, n0):
        p = (g + g0) / (n + n0)
        s = math.sqrt(p * (1 - p) * (1 / n + 1 / n0))
        return s > 0 and abs(g / n - g0 / n0) >= ut.MERGE_Z * s
    clusters = []
    for name, g, n in sorted(branches, key=lambda x: ((x[1] + 1) / (x[2] + 2), x[0])):
        last = clusters[-1] if clusters else None
        if last and not differ(g, n, sum(x[1] for x in last), sum(x[2] for x in last)) and not differ(g, n, *last[0][1:]):
            last.append((name, g, n))
        else:
            clusters.append([(name, g, n)])
    return {x[0]: f"/{x[0] if len(c) == 1 else '{%s+%d}' % (min(y[0] for y in c), len(c) - 1)}/#" for c in clusters for x in c}


def test_deep_paths_are_told_apart(spark):
    """What differs in the seventh segment only."""
    urls = [f"http://deep.org/a/b/c/d/e/f/{('good', 'bad')[i % 2]}/{i}" for i in range(200)]
    rows = judged(spark, urls, [(i, i % 2 == 0) for i in range(100)]).collect()
    assert {(urls[r["id"]].split("/")[9], r["template"], r["verdict"]) for r in rows} == {("good", "/a/b/c/d/e/f/good/#", "allow"), ("bad", "/a/b/c/d/e/f/bad/#", "block")}


def test_edges(spark):
    assert judged(spark, [], []).count() == 0
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://a.org/y"), (2, None)], T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType())]))
    labels = spark.createDataFrame([(1, True), (1, False), (None, True), (9, True)], "id long, good boolean").filter("id is not null")
    got = ut.judged(pages.withColumns({"good": F.lit(1), "prefix": F.lit("p"), "template": F.lit("t")}), labels, RULES).collect()
    assert Counter(r["id"] for r in got) == {1: 2, None: 1, 2: 1} and all(r["verdict"] == "allow" for r in got)
