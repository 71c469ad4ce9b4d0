import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from spatiofuse.llm import lines
from tests.llm.conftest import table

T, G = lines.RUN_WORDS, lines.GRAM_WORDS


def pieces(text):
    if not text or not text.split():
        return []
    out = [x for x in re.split(r"(?<=\n)|(?<=[.!?] )", text) if x]
    done = []
    for x in out:  # blanks go with the piece before, or after at the start
        if done and (not x.strip(" \t\n\x0b\x0c\r") or not done[-1].strip(" \t\n\x0b\x0c\r")):
            done[-1] += x
        else:
            done.append(x)
    return done


def fingerprints(h, n):
    """Selected (gram, start, end) of one document, by the definition."""
    def end(i, words):
        total = 0
        for j in range(i, len(h)):
            total += n[j]
            if total >= words:
                return j
        return None
    out = set()
    for i in range(len(h)):
        stop = end(i, T)
        if stop is None:
            continue
        grams = [(tuple(h[j:end(j, G) + 1]), j, end(j, G)) for j in range(i, stop + 1) if end(j, G) is not None and end(j, G) <= stop]
        out.add(("w", i, stop, tuple(g[0] for g in grams)))
    return out


def test_units_join_to_the_text(spark, folder):
    texts = [r["text"] for r in table(folder, "documents")] + ["a. b! c? d\n\n e.\n  \nf", "\n\n x. y", "a\x01b. c\nd", "x.  y.   ", "", "one", "a.\n\n\nb \x01 c. d "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lines.units(F.col("t")).alias("u"), F.array_join(lines.units(F.col("t")), "").alias("j"))
    for r in df.collect():
        assert r["j"] == r["t"]
        assert len(r["u"]) == max(1, len(pieces(r["t"]))) or "\x01" in r["t"], r["t"]


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n)).capitalize() + ". "


def test_shared_passages_go_from_later_documents(spark, make_docs):
    rng = random.Random(5)
    passage = "".join(sentence(rng, n) for n in (9, 12, 20, 7, 11))
    one_line = sentence(rng, 60).strip()
    short = sentence(rng, 20)
    fill = lambda k: "".join(sentence(rng, rng.randint(4, 14)) for _ in range(k))
    rows, own = [], {}
    for i in range(40):
        a, b = fill(6), fill(5)
        own[i] = (a, b)
        body = a + (passage if i % 2 == 0 else short) + b + ("\n" + one_line + "\n" if i % 3 == 0 else "")
        rows.append((i, body, "s"))
    got = {r["doc_id"]: r["text"] for r in lines.deduplicated(make_docs(rows)).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 40):
        assert passage[:40] not in got[i] and passage[-40:] not in got[i]
        assert one_line[:40] not in got[i]
        assert own[i][0] in got[i] and own[i][1].strip() in got[i], i  # what is the document's own stays
        assert i % 2 == 0 or short in got[i]  # 20 words are too few


def test_copies_edges_and_clashing_columns(spark, make_docs):
    rng = random.Random(6)
    body = "\n".join(sentence(rng, 15).strip() for _ in range(10))
    near = body.replace(body.split("\n")[4], "Quite another line in the middle of it all.")
    loop = "\n".join(["Again and again the very same line of words comes up here."] * 20)
    rows = [(5, body, "a"), (2, body, "a"), (9, near, "a"), (9, near, "a"), (None, None, "a"), (3, "", "b"), (4, " \n ", "b"), (7, loop, "a"),
            (None, sentence(rng, 70), None), (8, sentence(rng, 30_000), "a")]
    docs = make_docs(rows).withColumn("h", F.lit(1)).withColumn("p", F.lit(2)).withColumn("first", F.lit("x")).withColumn("gone", F.lit(0))
    out = lines.deduplicated(docs)
    assert out.columns == [*docs.columns, "_w_units", "_w_gone"]
    got = defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r["text"])
    assert got[2] == [body] and got[5] == [""]
    assert got[9] == ["Quite another line in the middle of it all.\n"] * 2
    assert sorted(got[None], key=str)[0] is None or None in got[None]
    assert got[3] == [""] and got[4] == [" \n "]
    kept = got[7][0].split("\n")
    assert 1 <= len(kept) <= 6 and "\n".join(kept) in loop  # the first run stays
    assert len(got[8][0]) > 100_000


def test_guarantee_on_random_runs(spark, make_docs):
    """Every run of RUN_WORDS words that two random documents share loses its later copy's fingerprint at least."""
    rng = random.Random(7)
    pool = [sentence(rng, rng.randint(3, 30)) for _ in range(60)]
    rows = []
    for i in range(30):
        k, m = rng.randrange(50), rng.randint(3, 10)
        rows.append((i, "".join(sentence(rng, 8) for _ in range(3)) + "".join(pool[k:k + m]) + "".join(sentence(rng, 8) for _ in range(3)), "s"))
    got = {r["doc_id"]: r["text"] for r in lines.deduplicated(make_docs(rows)).collect()}
    split = {i: pieces(t) for i, t, _ in rows}
    left = {i: set(pieces(t)) for i, t in got.items()}
    for i in range(30):
        for j in range(i):
            run = []
            for u in [*split[i], None]:
                if u is not None and u.strip() in {x.strip() for x in split[j]}:
                    run.append(u)
                    continue
                if sum(len(x.split()) for x in run) >= T:
                    assert any(x not in left[i] for x in run)
                run = []


def test_empty(spark, make_docs):
    assert lines.deduplicated(make_docs([])).count() == 0
