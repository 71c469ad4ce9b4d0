import os
import random
import subprocess
import sys
from collections import Counter

from pyspark import cloudpickle

import corpus_pipeline as pipeline
from spatiofuse.llm import jaccard, simhash
from spatiofuse.llm.staging import staged
from tests.llm import test_lines, test_packing, test_quality
from tests.llm.conftest import table


def groups(rows, k):
    """Groups of rows linked by a Jaccard similarity of 0.8 or more of their k-word shingle sets, by all pairs."""
    sets = [set(jaccard.shingle_set(t, k).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = {}
    for i, row in enumerate(rows):
        out.setdefault(find(i), []).append(row)
    return list(out.values())


def stages(spark, docs):
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], "unused"), name))
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def check(spark, docs, source_rows):
    given, clean, cut, single, packed = stages(spark, docs)
    kept = Counter(r["doc_id"] for r in test_quality.brute(source_rows) if r["kept"])
    assert Counter(i for i, _ in texts(clean)) == kept
    for before, after in ((given, clean), (clean, cut), (cut, single)):
        assert after.columns == before.columns and Counter(i for i, _ in texts(after)) <= Counter(i for i, _ in texts(before))
    pieces = {i: t for i, t in texts(clean)}
    for i, t in texts(cut):
        assert set(test_lines.pieces(t)) <= set(test_lines.pieces(pieces[i])) or t == pieces[i]
    rows = texts(cut)
    left = texts(single)
    assert len(left) == len(groups(rows, pipeline.SHINGLE))
    for group in groups(rows, pipeline.SHINGLE):
        assert sum((Counter(left) & Counter(group)).values()) == 1
    test_packing.judge([r.asDict() | {"id": r["doc_id"]} for r in packed.collect()], left)
    return left


def test_stages_on_the_fixture(spark, folder):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table(folder, "documents")]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = check(spark, docs, rows)
    assert len(pipeline.STAGES) == 4 and len({i for i, _ in left}) > 50
    done = pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in done} == {i for i, _ in left}


def test_copies_nulls_and_empty(spark, make_docs):
    words = lambda seed, n=70: test_quality.long_text(seed, n)
    rows = [(5, words("a"), "s"), (3, words("a"), "s"), (4, words("b"), "s"), (4, words("b"), "s"), (None, words("c"), None), (8, None, "s"), (9, "", "s"), (10, words("d", 9_000), "s")]
    left = check(spark, make_docs(rows), rows)
    assert sorted((i for i, _ in left), key=str) == [10, 3, 4, None]
    assert [df.count() for df in stages(spark, make_docs([]))] == [0] * 5


def test_near_copies_leave_no_stubs(spark, make_docs):
    """Copies with one word in a hundred changed go, whole or as what line dedup leaves of them; originals stay whole."""
    rng, rows = random.Random(1), []
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    for i in range(40):
        text = [[word() for _ in range(12)] for _ in range(25)]
        copy = [[word() if rng.random() < 0.01 else w for w in s] for s in text]
        rows += [(i, ". ".join(map(" ".join, text)), "s"), (1_000 + i, ". ".join(map(" ".join, copy)), "t")]
    given, clean, cut, single, _ = stages(spark, make_docs(rows))
    assert clean.count() == 80
    left = dict(texts(single))
    assert {i: t for i, t in left.items() if i < 1_000} == {i: t for i, t, _ in rows if i < 1_000}
    assert sum(i >= 1_000 for i in left) <= 4, left.keys()


def test_near_dedup_proposes_by_simhash(spark, make_docs, monkeypatch):
    """Without a shared MinHash key, texts of the same SimHash group still meet, and the sets decide."""
    monkeypatch.setattr(jaccard, "band_keys", lambda values: values[:1].astype("int64").tolist())
    words = [f"w{i}" for i in range(2_000)]
    rows = [(3, " ".join(words), "s"), (7, " ".join(["q798", *words]), "s"), (5, " ".join(["y", *words[::-1]]), "s"),
            (8, "again " * 600 + " ".join(words[:90]), "s"), (9, "again " * 600 + " ".join(words[100:190]), "s")]
    lowest = [int(jaccard.shingle_set(t, pipeline.SHINGLE)[0]) for _, t, _ in rows]
    bits = [int.from_bytes(simhash.fingerprint(t)) for _, t, _ in rows]
    assert (bits[0] ^ bits[1]).bit_count() <= 3 and (bits[3] ^ bits[4]).bit_count() <= 3
    left = pipeline.near_dedup(spark, make_docs(rows), "unused")
    assert lowest[0] != lowest[1] and sorted(r["doc_id"] for r in left.collect()) == [3, 5, 8, 9]


def test_shingles_need_no_package_on_the_worker(tmp_path):
    """Functions of the stage travel by value."""
    (tmp_path / "f").write_bytes(cloudpickle.dumps(jaccard.shingle_set))
    code = "import pickle; print(len(pickle.load(open('f', 'rb'))('a b c d e f', 5)))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": os.environ["PATH"]}, capture_output=True, text=True)
    assert done.stdout.strip() == "2", done.stderr
