"""SimHash near-duplicate groups with pigeonring candidate filtering.

Fingerprint: 64 bits from the XXH64 (seed 42) of every word shingle of the whole
text, A-Z lower-cased; a bit is 1 if it is set in over half of the hashes. Texts
with fewer words than a shingle count as one shingle; texts without words have
fingerprint zero.

Two fingerprints link when at most 3 bits differ. With the 64 bits as a ring of
eight segments, the pigeonring principle gives every such pair a start from which
each chain of l segments differs in at most 3 * l / 8 bits: the first two segments
are equal, and of the next three at least two are. Those four segments (32 bits)
are the join key: 8 starts x 3 choices. The longer chains prune what shares a key
before the full Hamming check. The filter loses no link.

Keys join distinct fingerprints, so exact copies cost one row. A key held by more
than ``BLOCK`` fingerprints is cut into blocks, and each pair of blocks is one small
group that gives a spanning forest of its links, not its pairs; components over
these are the components over all links.

Defined results: null and empty texts have fingerprint zero and are linked like any
other; repeated rows give a row each; null ids are passed over in the smallest id
(null if a group has no other); other columns play no part; an empty table gives
an empty table.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatiofuse.llm.components import components
from spatiofuse.llm.staging import dealt, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 3
#: Fingerprints of one key compared in one group.
BLOCK = 1024
SEGMENTS, WIDTH, BITS = 8, 8, 3


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray | None:
    """The XXH64 of every shingle as rows of 8 bytes, high byte first; None for a text without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not parts:
        return None
    line = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    if len(parts) < shingle:
        spans = [(0, len(line))]
    else:
        spans = zip(starts[:len(parts) - shingle + 1].tolist(), stops[shingle - 1:].tolist())
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[a:b], 42) for a, b in spans]), np.uint8).reshape(-1, 8)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    """The 8 bytes of one text's fingerprint, high bit first."""
    hashes = shingle_hashes(text, shingle)
    if hashes is None:
        return bytes(8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at:at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): every row's fingerprint as a long."""
    def run(batches):
        for batch in batches:
            made = b"".join([fingerprint(t.as_py(), shingle) for t in batch.column(1)])
            yield pa.record_batch([batch.column(0), pa.array(np.frombuffer(made, ">i8").astype(np.int64))], names=["id", "fp"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, fp bigint")


def _chain_keys(fp: Column) -> Column:
    """(start, key) for each start and choice of two out of the three segments after the first two."""
    entries = []
    for start in range(SEGMENTS):
        for left_out in (2, 3, 4):
            mask = 0
            for step in {0, 1, 2, 3, 4} - {left_out}:
                mask |= 0xFF << (8 * (7 - (start + step) % SEGMENTS))
            signed = mask - (1 << 64) if mask >> 63 else mask
            entries.append(F.struct(F.lit(start).alias("start"), F.xxhash64(F.lit(start * 8 + left_out), fp.bitwiseAND(F.lit(signed))).alias("key")))
    return F.array(*entries)


#: Longest chains first to last after the key: (segments, most differing bits), 3 * l / 8 rounded down.
CHAINS = [(n, BITS * n // SEGMENTS) for n in (3, 4, 5, 6, 7, 8)]


def forest(values: list[int], start: int) -> list[tuple[int, int]]:
    """(fingerprint, root) links that connect what is linked among ``values`` (signed 64-bit, one key)."""
    turned = [((v << (8 * start)) | ((v % (1 << 64)) >> (64 - 8 * start))) % (1 << 64) if start else v % (1 << 64) for v in values]
    if len(values) == 2:
        x = turned[0] ^ turned[1]
        return [(values[1], values[0])] if all((x >> (64 - 8 * n)).bit_count() <= most for n, most in CHAINS) else []
    ring = np.array(turned, np.uint64)
    differ = ring[:, None] ^ ring[None, :]
    alive = np.ones(differ.shape, bool)
    for n, most in CHAINS:
        alive &= np.bitwise_count(differ >> np.uint64(64 - 8 * n)) <= most
        if alive.sum() == len(ring):
            return []
    labels = np.arange(len(ring))
    while True:
        least = np.where(alive, labels[None, :], len(ring)).min(axis=1)
        least = least[least]
        if (least == labels).all():
            break
        labels = least
    return [(values[i], values[int(k)]) for i, k in enumerate(labels.tolist()) if i != k]


def _forests(batches):
    """Groups of equal (cell, start), which arrive sorted; a group is at most two blocks."""
    cell, start, held = None, 0, set()

    def out(pairs):
        return pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    for batch in batches:
        found = []
        for c, s, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if c != cell:
                if len(held) > 1:
                    found += forest(sorted(held), start)
                cell, start, held = c, s, set()
            held.add(v)
        yield out(found)
    if len(held) > 1:
        yield out(forest(sorted(held), start))


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect the same groups as all links among the distinct ``fp``."""
    keyed = distinct.select("fp", F.explode(_chain_keys(F.col("fp"))).alias("k")).select("fp", "k.start", "k.key")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = keyed.join(dealt(shared), "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    members = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = members.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "start", "fp")
    cells = cells.repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(_forests, "a bigint, b bigint")


def grouped(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(id, fp, component_id): every row with its fingerprint and the smallest id its links reach."""
    prints = staged(fingerprints(docs, id_col, text, shingle), "simhash")
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = components(links(distinct, block)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    # smallest id of each component; its root node is one of its fingerprints
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    nodes = staged(nodes.join(dealt(distinct), F.col("node") == F.col("fp")).select("fp", "root", "least"), "simhash-nodes")
    smallest = nodes.groupBy("root").agg(F.min("least").alias("smallest"))
    linked = nodes.select("fp", "root").join(dealt(smallest), "root").select("fp", "smallest")
    known = distinct.join(dealt(linked), "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"))
    return prints.join(dealt(staged(known, "simhash-known")), "fp").select("id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
