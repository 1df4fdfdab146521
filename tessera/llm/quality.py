"""Quality classifier: votes of the nearest labelled latent-semantic vectors.

A text's terms are its hashed byte trigrams (case and signs kept) and shape terms: how many of its
words are distinct, repeat the word before, are capitals or carry signs, how long words and text
are. Counts are damped and weighted by inverse document frequency; a truncated SVD of the labelled
sample gives the latent space. The sample's vectors and labels are broadcast (their number is a
bound, not the data's), every document is compared with all of them by blocked matrix products, and
its NEIGHBOURS nearest vote with their similarity as weight. Terms, basis and vectors are rounded to
whole numbers before they are multiplied, so that products are exact and a text scores alike
whatever texts stand beside it; of equally near vectors the first in the sample's order votes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, slices, utf8_view
from .ngrams import drop_tails, gram_hashes, row_sums
from .minhash import word_hashes

BITS, DIM, NEIGHBOURS, SHARPNESS = 11, 48, 15, 8
#: Bounds of the labelled sample: rows of each label, bytes of one text.
PER_LABEL, MOST_BYTES = 1500, 1 << 16
#: Shape terms: measures, each with STEPS + 1 levels, and the weight of their block.
STEPS, SHAPE_WEIGHT = 10, 1.0
_SHAPES = 7
#: Steps of 1 that terms and basis, and latent vectors, are rounded to: sums of so many products of
#: such numbers stay below 2**53.
_TERM_STEPS, _STEPS = float(1 << 20), float(1 << 23)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _levels(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x * STEPS), 0, STEPS).astype(np.int64)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Damped trigram counts (row x bucket) and shape levels (row x measure), -1 for empty rows."""
    rows, buckets = len(offsets) - 1, 1 << BITS
    lengths = np.diff(offsets)
    h = gram_hashes(data, 3, BITS)
    drop_tails(h, offsets, 3, 0)
    counts = np.zeros((rows, buckets), np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b > a:
            counts[i] = np.bincount(h[a:b], minlength=buckets)
    counts[:, 0] = 0
    np.log1p(counts, out=counts)
    words, at = word_hashes(data, offsets)
    n = np.diff(at)
    distinct = np.zeros(rows)
    again = np.zeros(rows)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if b > a:
            distinct[i] = len(np.unique(words[a:b])) / (b - a)
            again[i] = np.count_nonzero(words[a + 1 : b] == words[a : b - 1]) / (b - a)
    per = np.maximum(lengths, 1)
    upper = row_sums(((data >= 65) & (data <= 90)).astype(np.int64), offsets)
    lower = row_sums(((data >= 97) & (data <= 122)).astype(np.int64), offsets)
    signs = row_sums((((data > 32) & (data < 48)) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 128))).astype(np.int64), offsets)
    # a long text repeats words anyway: its distinct share is judged against its length
    expected = np.minimum(1.0, 40.0 / np.sqrt(np.maximum(n, 1)))
    shape = np.stack([
        _levels(distinct), _levels(np.minimum(1, distinct / (2 * expected))), _levels(np.sqrt(again)), _levels(upper / np.maximum(upper + lower, 1)),
        _levels(np.minimum(1, 4 * signs / per)), _levels(np.minimum(1, (lengths - n) / np.maximum(n, 1) / 16)), _levels(np.minimum(1, np.log1p(n) / 10)),
    ], 1)
    shape[n == 0] = -1
    return counts, shape


@dataclass
class QualityModel:
    idf: np.ndarray
    shape_idf: np.ndarray  # measure x level
    basis: np.ndarray  # all terms x DIM
    vectors: np.ndarray  # labelled x DIM, unit length, in whole steps
    labels: np.ndarray
    prior: float

    def weighted(self, counts: np.ndarray, shape: np.ndarray) -> np.ndarray:
        rows = counts.shape[0]
        counts = counts * self.idf
        counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)
        hot = np.zeros((rows, _SHAPES, STEPS + 1), np.float32)
        r, m = np.nonzero(shape >= 0)
        for step, part in ((0, 1.0), (-1, 0.5), (1, 0.5)):  # neighbouring levels are alike
            level = np.clip(shape[r, m] + step, 0, STEPS)
            np.maximum.at(hot, (r, m, level), np.float32(part))
        hot = (hot * self.shape_idf).reshape(rows, -1)
        hot *= SHAPE_WEIGHT / np.maximum(np.linalg.norm(hot, axis=1, keepdims=True), 1e-12)
        return np.concatenate([counts, hot], 1)

    def project(self, counts: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Latent vectors of unit length, in whole steps."""
        latent = np.rint(self.weighted(counts, shape).astype(np.float64) * _TERM_STEPS) @ np.rint(self.basis * _TERM_STEPS)
        return np.rint(latent * (_STEPS / np.maximum(np.sqrt((latent * latent).sum(1, keepdims=True)), 1e-12)))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Label 1's share of the similarity-weighted vote; the prior where there is nothing to go by."""
        rows = len(offsets) - 1
        if not len(self.labels):
            return np.full(rows, self.prior)
        similar = self.project(*terms(data, offsets)) @ self.vectors.T
        near = nearest(similar, min(NEIGHBOURS, similar.shape[1]))
        weight = np.maximum(np.take_along_axis(similar, near, 1) / (_STEPS * _STEPS), 0) ** SHARPNESS
        total = weight.sum(1)
        vote = (weight * self.labels[near]).sum(1)
        return np.where(total > 1e-9, vote / np.maximum(total, 1e-9), self.prior)


def nearest(similar: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` highest values of each row, the first of equals, in their own order."""
    least = -np.partition(-similar, k - 1, axis=1)[:, k - 1 : k]
    above, level = similar > least, similar == least
    room = k - above.sum(1, keepdims=True)
    crowded = np.flatnonzero(level.sum(1) > room[:, 0])
    level[crowded] &= np.cumsum(level[crowded], axis=1) <= room[crowded]
    return np.nonzero(above | level)[1].reshape(len(similar), k)


def train(texts: list[str], labels: list[int], prior: float, seed: int = 11) -> QualityModel:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    width = (1 << BITS) + _SHAPES * (STEPS + 1)
    empty = np.zeros((0, width))
    model = QualityModel(np.ones(1 << BITS, np.float32), np.ones((_SHAPES, STEPS + 1), np.float32), np.zeros((width, 0), np.float32), empty, np.zeros(0), prior)
    if not raw:
        return model
    data, parts = np.frombuffer(b"".join(raw), np.uint8), []
    for a, b in slices(offsets):
        parts.append(terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
    counts, shape = np.concatenate([c for c, _ in parts]), np.concatenate([s for _, s in parts])
    n = len(raw)
    model.idf = np.log1p(n / (1.0 + (counts > 0).sum(0))).astype(np.float32)
    seen = np.stack([np.bincount(shape[shape[:, m] >= 0, m], minlength=STEPS + 1) for m in range(_SHAPES)])
    model.shape_idf = np.log1p(n / (1.0 + seen)).astype(np.float32)
    x = model.weighted(counts, shape)
    rng = np.random.default_rng(seed)
    q = x.T @ (x @ rng.standard_normal((width, min(DIM + 16, n))).astype(np.float32))
    for _ in range(3):
        q, _ = np.linalg.qr(q)
        q = x.T @ (x @ q)
    q, _ = np.linalg.qr(q)
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    model.basis = np.ascontiguousarray((q @ vt.T)[:, :DIM], np.float64)
    model.vectors, model.labels = np.concatenate([model.project(counts[i : i + 512], shape[i : i + 512]) for i in range(0, n, 512)]), np.array(labels, float)
    return model


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, int]], float]:
    """At most PER_LABEL (text, quality) of each label, chosen by a hash of the row among labelled
    rows whose fold is not 0 and whose text has 1 to MOST_BYTES bytes; and the share of label 1
    among all labelled rows whose fold is not 0."""
    known = labels.select("doc_id", F.col("quality").alias("quality")).filter((fold(F.col("doc_id")) != 0) & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if not total:
        return [], prior
    share = F.when(F.col("quality") == 1, min(1.0, 1.2 * PER_LABEL / counts.get(1, 1))).otherwise(min(1.0, 1.2 * PER_LABEL / counts.get(0, 1)))
    known = known.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)).filter(F.col("draw") < share)
    known = known.withColumn("place", F.col("draw") / share)
    # at most 2.4 PER_LABEL short rows, so the texts come to them
    rows = docs.select("doc_id", "text").filter(F.octet_length("text").between(1, MOST_BYTES)).join(F.broadcast(known), "doc_id")
    out = []
    for label in (0, 1):
        chosen = rows.filter(F.col("quality") == label).orderBy("place", "doc_id", "text").select("text", "quality").limit(PER_LABEL).collect()
        out += [(r["text"], r["quality"]) for r in chosen]
    return out, prior


def score(docs: DataFrame, model: QualityModel, bar: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, label 1) and ``predicted`` (1 if the score reaches ``bar``),
    from whole texts alone. Null and empty texts have no terms and get the share of label 1 in the
    labelled rows. Columns of these names are replaced; an empty table stays empty."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    at = [c.lower() for c in kept].index("text")
    docs = docs.select(*kept)

    def run(batches):
        model = shared.value
        for batch in batches:
            data, offsets = utf8_view(batch.column(at))
            out = np.full(batch.num_rows, model.prior)
            for start, stop in slices(offsets, 1 << 19):
                for a in range(start, stop, 512):
                    b = min(stop, a + 512)
                    out[a:b] = model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out = np.clip(out, 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array((out >= bar).astype(np.int32))], [*kept, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op3(spark, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, prior = training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = train([t for t, _ in rows], [y for _, y in rows], prior)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return score(docs.select("doc_id", "text", held), model).select("doc_id", "held_out", "score", "predicted")
