import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from spatiofuse.llm import quality
from tests.llm.conftest import table

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w)}


def normal(line):
    return re.sub("[0-9]+", "0", line.strip(" \t\n\x0b\x0c\r").lower())


def brute(rows, min_docs=quality.MIN_DOCS, max_share=quality.MAX_SHARE):
    hosts = defaultdict(set)
    for _, text, host in rows:
        hosts[host].add(text)
    frequent = {}
    for host, texts in hosts.items():
        n = Counter(h for t in texts for h in {normal(x) for x in (t or "").split("\n") if WORD.search(x)})
        frequent[host] = {h for h, c in n.items() if c > min_docs and c > max_share * len(texts)}
    for i, text, host in rows:
        b = base(text)
        lost = [x for x in (text or "").split("\n") if WORD.search(x) and normal(x) in frequent[host]]
        removed = sum(len(WORD.findall(x)) for x in lost)
        left = b["n_words"] - removed
        depleted = removed > 0 and (left < quality.MIN_WORDS or left < quality.MIN_LEFT * b["n_words"])
        yield {"doc_id": i, **b, "removed_words": removed, "kept": not b["base_failed"] and not depleted}


def same(got, want):
    key = lambda r: tuple(str(r[k]) for k in sorted(r))
    assert sorted((r.asDict() for r in got), key=key) == sorted(want, key=key)


def test_fixture_matches_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table(folder, "documents")]
    same(quality.judged(docs).collect(), list(brute(rows)))


DIGITS = str.maketrans("0123456789", "abcdefghij")  # digits are compared as one


def long_text(seed, n=80):
    return " ".join(f"w{seed}x{k}".translate(DIGITS) for k in range(n))


def planted():
    rows = [(i, f"Home | About 7{i}\n{long_text(i)}", "a") for i in range(30)]
    rows += [(100 + i, f"Home | About {i}\n" + long_text("nav", 60), "b") for i in range(3)]
    rows += [(200 + i, "home | about 5 \nshort tail here", "a") for i in range(2)]
    rows += [(300, None, "a"), (301, "", None), (302, " \n\t ", "a"), (303, long_text(1) + "\n" + long_text(1), None)]
    rows += [(None, long_text(9), "a"), (304, long_text(9), "a"), (304, long_text(9), "a"), (305, long_text("big", 20_000), "a")]
    rows += [(400 + i, f"home | about {i}\n" + long_text("x", 8) + f" {i}\n" + "\n".join(f"HOME | about {k}" for k in range(15)), "a") for i in range(4)]
    return rows


def test_edges_and_depleted(spark, make_docs):
    rows = planted()
    got = quality.judged(make_docs(rows)).collect()
    want = list(brute(rows))
    same(got, want)
    assert all(r["kept"] for r in want if r["doc_id"] is not None and r["doc_id"] < 30) and not any(r["kept"] for r in want if r["doc_id"] in (400, 401))


def test_apply_takes_lines_out_and_keeps_clean(spark, make_docs):
    rows = planted()
    docs = make_docs(rows).withColumn("removed", F.lit(1)).withColumn("h", F.lit("x")).withColumn("key", F.lit("k"))
    out = quality.apply_rules(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(got) == {r["doc_id"] for r in brute(rows) if r["kept"]}
    assert got[3] == long_text(3) and got[100].startswith("Home")


def test_empty(spark, make_docs):
    assert quality.judged(make_docs([])).count() == 0 and quality.apply_rules(make_docs([])).count() == 0
