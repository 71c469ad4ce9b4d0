import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from spatiofuse.llm import lattice
from tests.llm.conftest import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def all_cuts(tool, text):
    """Every segmentation of a short text with its probability, by trying all cuts."""
    sets = []
    for unit in tool.units_of(text):
        edges, done = tool.edges(unit), []

        def walk(i, ids, w):
            if i == len(unit):
                done.append((ids, w))
                return
            for j, v, s in edges[i]:
                walk(j, ids + s, w * v)

        walk(0, b"", 1.0)
        total = sum(w for _, w in done)
        sets.append([(i, w / total) for i, w in done])
    return {b"".join(c[0] for c in combo): math.prod(c[1] for c in combo) for combo in itertools.product(*sets)}


def test_samples_follow_the_distribution():
    tool = lattice.Sampler(MODEL, 0.4)
    text = "then it"
    want = all_cuts(tool, text)
    n, k = 6000, 3
    first, pairs, weight = Counter(), Counter(), Counter()
    for i in range(n):
        found = tool.sample(text, f"key {i}", k)
        assert len({f[0] for f in found}) == k and [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        for ids, log_p, _, _ in found:
            assert math.isclose(math.exp(log_p), want[ids], rel_tol=1e-9)
        first[found[0][0]] += 1
        pairs[found[0][0], found[1][0]] += 1
        for ids, log_p, _, inclusion in found:
            weight[ids] += math.exp(log_p - inclusion) / n  # unbiased for each segmentation's probability
    for ids, p in want.items():
        assert abs(first[ids] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 2e-3
    for (a, b), seen in pairs.most_common(6):  # without replacement: the second follows p / (1 - p of the first)
        p = want[a] * want[b] / (1 - want[a])
        assert abs(seen / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 2e-3
    for ids, p in sorted(want.items(), key=lambda x: -x[1])[:4]:
        assert abs(weight[ids] - p) < 0.08 * p + 0.01


def test_few_segmentations_are_all_found():
    tool = lattice.Sampler(MODEL, 0.3)
    for text in ("it", "a b", "\n", "é", "▁x", " "):
        want = all_cuts(tool, text)
        found = tool.sample(text, "k", len(want) + 3)
        assert {f[0] for f in found} == set(want) and all(f[3] == 0.0 for f in found), text
        assert math.isclose(sum(math.exp(f[1]) for f in found), 1.0, rel_tol=1e-6)


def test_best_cut_matches_all_cuts():
    tool = lattice.Sampler(MODEL, lattice.THETA)
    for text in ("▁the", "▁wonderful", "xqz", "▁▁▁", "naïve"):
        cuts = {}
        for ids, p in all_cuts(tool, text.lstrip("▁") or "  ").items():
            cuts[ids] = p
        assert math.isclose(sum(cuts.values()), 1.0, rel_tol=1e-9)
    rng = random.Random(1)
    for n in (3, 8, 61, 200):  # plain numbers and logarithms agree
        unit = "▁" + "".join(rng.choices("thernoi", k=n))
        ids, p = tool.solve(unit)
        assert math.isclose(p, tool.probability(unit, ids), rel_tol=1e-6)


TEXTS = [None, "", " ", "one", "  a  b\n c ", "日本語 текст 🙂 ▁ \ue000 x", "<s> </s> <0x0A> <unk>", "\t\r\n\n", "w" * 5000, " " * 300, "the quick " * 4000, "é́ Ⅷ ﬁ　"]


def test_round_trip_and_edges(spark, make_docs):
    docs = make_docs([(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "null id", "s"), (3, "one", "s")]).withColumns({"ids": F.lit(1), "sample": F.lit("x")})
    made = lattice.encoded(docs, MODEL)
    back = lattice.decoded(made, MODEL).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = dict(enumerate(TEXTS)) | {None: "null id"}
    seen = Counter()
    for r in back:
        assert r["text"] == (want[r["id"]] or "")
        seen[r["id"]] += 1
    assert set(seen) == set(want) and seen[0] == seen[1] == 1 and seen[3] == 4 and seen[10] == 2
    for r in made.collect():
        assert r["log_inclusion"] <= 0 and r["log_prob"] <= 0 and r["n_pieces"] == len(r["ids"]) // 4
        if want[r["id"]] and "▁" not in want[r["id"]]:
            assert sp.decode(np.frombuffer(r["ids"], "<u4").tolist()) == want[r["id"]]
    assert lattice.encoded(make_docs([]), MODEL).count() == 0


def test_fixture_round_trip_and_seeding(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = lattice.encoded(docs, MODEL)
    a = {(r["id"], r["sample"]): (r["ids"], r["log_prob"]) for r in made.collect()}
    b = {(r["id"], r["sample"]): (r["ids"], r["log_prob"]) for r in lattice.encoded(docs.repartition(7), MODEL).collect()}
    assert a == b
    texts = {r["doc_id"]: r["text"] for r in table(folder, "documents")}
    assert all(r["text"] == texts[r["id"]] for r in lattice.decoded(made, MODEL).collect())
    assert all(a[i, 0][0] != a[i, 1][0] for i in texts if (i, 1) in a)
