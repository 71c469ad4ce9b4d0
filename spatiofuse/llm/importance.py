"""Importance resampling of documents towards a target text collection.

Features of a text are its runs of 1 .. ``longest`` consecutive words. Separators
are collapsed to single spaces; for each length one pattern with look-arounds at
word borders is scanned with ``finditer(..., overlapped=True)``, so every run is a
span of the collapsed text and is counted by the CRC-32 of its bytes, in buckets.

The gain of a bucket is the log ratio of its smoothed shares in the target and in
the documents, in thousandths, rounded down; a document's weight is the sum of
its features' gains. Weight plus Gumbel noise from a hash of the id is its score,
and the highest scores are a draw without replacement with odds exp(weight/1000).

Defined results: null and empty texts have no features and weight 0; very long
texts are scanned whole, as one string and two or four bytes a feature; a null id
is hashed as an empty string and comes first among ties; repeated rows count each
in the statistics and hold a place each; other columns play no part; without
documents the result is empty, and without target texts all T and t are 0.

Scale: every text is scanned once, and its buckets are staged (two bytes a feature
for 65,536 buckets or fewer). Counts are summed in the tasks before they are
shuffled: at most ``buckets`` rows a task, and ``buckets`` numbers for the driver.
Ranks come from range partitions.
"""

from __future__ import annotations

import math
import sys
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatiofuse.llm.ranks import placed
from spatiofuse.llm.staging import staged
from spatiofuse.llm.terms import collapsed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Production parameters: words of the longest feature, buckets, words of a document that can be drawn, percent drawn, seed.
LONGEST, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Spans whose bucket is remembered in a task.
_REMEMBERED = 200_000


class Buckets(dict):
    """Bucket of a span; forgets all when it holds too many."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, span: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        bucket = self[span] = zlib.crc32(span) % self.buckets
        return bucket


def patterns(longest: int) -> list:
    """One pattern for each length: whole words only, from one border to another."""
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}" % (n - 1)) for n in range(1, longest + 1)]


def width(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def features(texts: DataFrame, keep: list[str], longest: int, buckets: int) -> DataFrame:
    """``keep``, n_words, n_features and the bucket of every feature, from the binary column ``_i_text``."""
    kind, kept = width(buckets), texts.select(keep)

    def run(batches):
        known, scans = Buckets(buckets), patterns(longest)
        for batch in batches:
            words, counts, found = [], [], []
            for raw in batch.column(len(keep)):
                line = collapsed(raw.as_py())
                spans = [np.fromiter((known[m.group()] for m in scan.finditer(line, overlapped=True)), kind) for scan in scans]
                words.append(len(spans[0]))
                counts.append(sum(map(len, spans)))
                found.append(np.concatenate(spans).tobytes())
            yield pa.record_batch([*batch.columns[:-1], pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(found, pa.binary())],
                                  names=[*keep, "n_words", "n_features", "features"])

    extra = "n_words bigint, n_features bigint, features binary"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [extra])
    return texts.select(*keep, "_i_text").mapInArrow(run, schema)


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows of the column ``features``."""
    kind = width(buckets)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for one in batch.column(0):
                total += np.bincount(np.frombuffer(one.as_py(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    rows = found.select("features").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(ours: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths, from the features counted in the documents and in the target."""
    n = len(ours)
    s_all, t_all = float(ours.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(ours.tolist(), target.tolist())], np.int64)


def weighed(found: DataFrame, gain: np.ndarray, buckets: int) -> DataFrame:
    """id, n_words, n_features and weight of every document."""
    kind = width(buckets)

    def run(batches):
        for batch in batches:
            weight = [int(gain[np.frombuffer(one.as_py(), kind)].sum()) for one in batch.column(3)]
            yield pa.record_batch([*batch.columns[:3], pa.array(weight, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    kind_of_id = found.schema["id"].dataType.simpleString()
    return found.select("id", "n_words", "n_features", "features").mapInArrow(run, f"id {kind_of_id}, n_words bigint, n_features bigint, weight bigint")


def gumbel(id_col: str, seed: int):
    """Standard Gumbel noise of an id in thousandths, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
              min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row; ``rank`` is null for rows that are not drawn."""
    body = F.col(text).cast("binary").alias("_i_text")
    found = staged(features(docs.select(F.col(id_col).alias("id"), body), ["id"], longest, buckets), "importance-features")
    aim = features(target.select(body), [], longest, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(aim, buckets))
    scored = staged(weighed(found, gain, buckets).withColumn("score", F.col("weight") + gumbel("id", seed)), "importance-scores")
    able = F.col("n_words") >= min_words
    most = scored.filter(able).count() * percent // 100
    places = placed(scored.filter(able), [F.col("score").desc(), F.col("id").asc_nulls_first()])
    drawn = places.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return drawn.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs``, all columns; rows of a drawn id come together."""
    ranks = resampled(docs, target, id_col, text, **options).filter("rank is not null").select(F.col("id").alias("_i_id")).distinct()
    return docs.join(ranks, docs[id_col].eqNullSafe(F.col("_i_id")), "left_semi")
