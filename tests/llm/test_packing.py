import itertools
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spatiofuse.llm import packing
from tests.llm.conftest import table

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids + [1]


def fewest(sizes, capacity):
    """Fewest bins by trying all placements."""
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity and bins[i] not in bins[:i]:
                go(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1:]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best


def check_plan(histogram, capacity):
    plan = packing.plan(histogram, capacity)
    used = Counter()
    for whole, times in plan:
        assert sum(whole) <= capacity and times > 0
        for x in whole:
            used[x] += times
    assert used == Counter(histogram)
    return sum(n for _, n in plan)


def test_plan_is_optimal_on_small_cases():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 20, 37, 100])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 11))), reverse=True)
        assert check_plan(Counter(sizes), capacity) == fewest(sizes, capacity), (capacity, sizes)


def test_plan_of_large_histograms_is_near_the_bound():
    rng = random.Random(4)
    for top in (40, 900, 4096):
        histogram = Counter(min(4096, int(rng.paretovariate(0.7))) if top == 4096 else rng.randint(1, top) for _ in range(30_000))
        bins, bound = check_plan(histogram, 4096), -(-sum(x * n for x, n in histogram.items()) // 4096)
        long = sum(n for x, n in histogram.items() if x > 2048)
        assert bins <= max(bound, long) * 1.01 + 1
    assert check_plan({1: 100_000}, 4096) == 25 and check_plan({}, 4096) == 0 and check_plan({3000: 50}, 4096) == 50


def judge(rows, docs):
    """Contract of the packed pieces against the tokenizer run on whole texts."""
    tok = Tokenizer.from_file(PATH)
    want = []
    for i, text in docs:
        ids = ids_of(tok, text)
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want.append((str(i), k, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert sorted((str(r["id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins)


def test_fixture(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = packing.packed_documents(docs, PATH, with_ids=False).collect()
    n = judge(rows, [(r["doc_id"], r["text"]) for r in table(folder, "documents")])
    assert n == -(-sum(r["length"] for r in rows) // 4096)  # the bound is met


ODD = ["<|endoftext|> x <|startoftext|>y", "don't I'LL we've", "ÉTÉ été Straße ŒUVRE İstanbul ΣΑΣ", "é composed", "a b c\u0085d\x1ce\tf\vg", "...,, x., 12,000. ª º µ ÿ", "日本語 текст 🙂 a🙂b", "\n\n  \n", " ́x", "a,b.c", "x" * 3000, ",",
       "<|endoftext|>. foo<|endoftext|>. <|x|> (word)—x ##word## ##Word a.b... ÀÉ, x'%% '%x %%'s %S' -É- (été)!? @ \\a\\ |b|"]


def test_edges(spark, make_docs):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(50, None, "s"), (51, "", "s"), (None, "null id", "s"), (52, "again", "s"), (52, "again", "s"), (53, "word " * 20_000, "s")]
    docs = make_docs(rows).withColumn("length", F.lit("x")).withColumn("piece", F.lit(0)).withColumn("offset", F.lit(0))
    judge(packing.packed_documents(docs, PATH).collect(), [(i, t) for i, t, _ in rows])
    assert packing.packed_documents(make_docs([]), PATH).count() == 0


def test_fillings_are_undominated():
    for lengths in itertools.combinations(range(1, 9), 3):
        counts = dict.fromkeys(lengths, 2)
        for f in packing.fillings(list(lengths), counts, 11, 11, 10_000):
            left = 11 - sum(f)
            assert left >= 0 and all(x > left for x in lengths if counts[x] > f.count(x))
