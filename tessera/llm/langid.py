"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is its lower-cased byte n-grams (2 to 4 bytes, words marked by the spaces around them). Each
gram has an embedding; a text's vector is their mean; a linear layer and softmax give the languages.
Embeddings and layer are trained by stochastic gradient descent in numpy on a bounded sample; then
a temperature is fitted on rows kept out of training, and a rejection bar is set on the calibrated
score. Since mean and layer are linear, scoring uses one logit table per language where languages
are no more than dimensions, and else the embeddings themselves, averaged and multiplied once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, slices, tidied, utf8_view
from .ngrams import drop_tails, gram_counts, gram_hashes, letters_only, row_sums

BITS, DIM, GRAMS = 17, 16, (2, 3, 4)
#: Bounds of the training sample: rows per language, rows in all, bytes of one text.
PER_LANGUAGE, MOST_ROWS, MOST_BYTES = 600, 4000, 1 << 16
#: One count per language reaches the driver; more languages raise.
MOST_LANGUAGES = 4000
UNKNOWN = "und"
#: A row is rejected if its calibrated score says that the prediction is likelier wrong than right
#: (BAR) and lies well below those of all calibration rows that are right (BAR_SHARE), or if training
#: saw less than this part of the grams that the poorest hundredth of the calibration rows had seen
#: (text of no learned language).
BAR, BAR_SHARE, KNOWN_SHARE = 0.5, 0.8, 0.75


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # language or dimension x bucket: what a gram adds; bucket 0 is empty
    bias: np.ndarray
    temperature: float
    bar: float  # least calibrated score
    known: np.ndarray  # bucket: 1.0 where training saw a gram of it
    known_bar: float  # least share of grams that training saw
    layer: np.ndarray | None = None  # dimension x language, where the table has dimensions

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each framed row, and the share of its grams that training saw."""
        rows = [*self.table, self.known]
        total, grams = np.zeros((len(rows), len(offsets) - 1)), np.zeros(len(offsets) - 1)
        text = letters_only(data)
        for n in GRAMS:
            h = gram_hashes(text, n, BITS)
            drop_tails(h, offsets, n, 0)
            grams += gram_counts(np.diff(offsets), n)
            for i, row in enumerate(rows):
                total[i] += row_sums(row[h], offsets)
        mean = (total / np.maximum(grams, 1)).T
        if self.layer is None:
            return mean[:, :-1] + self.bias, mean[:, -1]
        # one dimension after the other, so that a row's sum does not depend on its neighbours
        return sum((mean[:, j, None] * self.layer[j] for j in range(len(self.layer))), self.bias), mean[:, -1]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, known = self.logits(data, offsets)
        return softmax(raw / self.temperature), known


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def framed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a space before and after, so that their first and last words are marked too."""
    wide = offsets + 2 * np.arange(len(offsets))
    out = np.full(wide[-1], 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[wide[:-1]] = inside[wide[1:] - 1] = False
    out[inside] = data
    return out, wide


def _framed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return framed(np.frombuffer(b"".join(raw), np.uint8), offsets)


def _bags(texts: list[str], step: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text with their share of its grams; a few texts at a time, since
    the driver's memory is small."""
    out = []
    for first in range(0, len(texts), step):
        data, offsets = _framed(texts[first : first + step])
        text = letters_only(data)
        hashes = []
        for n in GRAMS:
            h = gram_hashes(text, n, BITS)
            drop_tails(h, offsets, n, 0)
            hashes.append(h)
        for a, b in zip(offsets[:-1], offsets[1:]):
            counts = np.bincount(np.concatenate([h[a:b] for h in hashes]), minlength=1)
            counts[0] = 0
            at = np.flatnonzero(counts)
            out.append((at.astype(np.int32), (counts[at] / max(1, counts.sum())).astype(np.float32)))
    return out


def train(texts: list[str], langs: list[str], seed: int = 7, epochs: int = 6, rate: float = 4.0) -> LanguageModel:
    """The model of these rows. A fifth of them only calibrates. No rows: a model without languages."""
    languages = sorted(set(langs))
    k = len(languages)
    if not k:
        return LanguageModel([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0), 1.0, 1.0, np.zeros(1 << BITS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in langs])
    bags = _bags(texts)
    order = rng.permutation(len(y))
    kept_out = order[: len(y) // 5] if len(y) >= 50 else order[:0]
    fit = order[len(kept_out) :]
    seen = np.zeros(1 << BITS, bool)
    for i in fit:
        seen[bags[i][0]] = True
    embedding = (rng.standard_normal((1 << BITS, DIM)) * 0.5 * seen[:, None]).astype(np.float32)
    layer, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    weight = len(fit) / (k * np.maximum(np.bincount(y[fit], minlength=k), 1))
    steps = max(1, epochs * len(fit) // 32)
    for step in range(steps):
        if step % max(1, len(fit) // 32) == 0:
            rng.shuffle(fit)
        at = (step * 32) % len(fit)
        some = fit[at : at + 32]
        some = some[[len(bags[i][0]) > 0 for i in some]]
        if not len(some):
            continue
        buckets = np.concatenate([bags[i][0] for i in some])
        share = np.concatenate([bags[i][1] for i in some])
        starts = np.concatenate([[0], np.cumsum([len(bags[i][0]) for i in some])])
        mean = np.add.reduceat(embedding[buckets] * share[:, None], starts[:-1], axis=0)
        error = softmax(mean @ layer + bias)
        error[np.arange(len(some)), y[some]] -= 1
        error *= (weight[y[some]] / len(some))[:, None]
        now = rate * (1 - step / steps)
        back = error @ layer.T
        layer -= now * (mean.T @ error)
        bias -= now * 0.1 * error.sum(0)
        push = np.repeat(back, np.diff(starts), axis=0) * (share * -now)[:, None]
        for j in range(DIM):
            embedding[:, j] += np.bincount(buckets, push[:, j], 1 << BITS)
    few = k <= DIM
    table = np.ascontiguousarray((embedding @ layer if few else embedding).T, dtype=np.float32)
    table[:, 0] = 0
    known = seen.astype(np.float32)
    known[0] = 0
    model = LanguageModel(languages, table, bias.astype(float), 1.0, BAR if k > 1 else 0.0, known, 0.0, None if few else layer.astype(float))
    if len(kept_out):
        parts = [model.logits(*_framed([texts[i] for i in kept_out[k : k + 64]])) for k in range(0, len(kept_out), 64)]
        raw, share = np.concatenate([p for p, _ in parts]), np.concatenate([p for _, p in parts])
        truth = y[kept_out]
        loss = lambda t: -np.log(softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        model.temperature = min((float(t) for t in np.geomspace(0.05, 10, 60)), key=loss)
        score = softmax(raw / model.temperature)
        right = score.argmax(1) == truth
        if k > 1 and right.any():  # clean text that calibration rows resemble stays
            model.bar = min(BAR, BAR_SHARE * float(score.max(1)[right].min()))
        model.known_bar = KNOWN_SHARE * float(np.quantile(share, 0.01))
    return model


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """At most MOST_ROWS (text, lang), about as many of each language, chosen by a hash of the row
    among those whose fold is not 0, whose lang is not null and whose text has 1 to MOST_BYTES bytes."""
    rows = docs.select("doc_id", "text", "lang").filter((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return []
    each = min(PER_LANGUAGE, max(1, MOST_ROWS // len(counts)))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * each / n))])
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40)) / float(1 << 40)).alias("draw")
    rows = rows.withColumn("draw", draw).filter(F.col("draw") < share[F.col("lang")])
    rows = rows.filter(F.octet_length("text").between(1, MOST_BYTES))
    place = (F.col("draw") / share[F.col("lang")]).alias("place")
    chosen = rows.select("text", "lang", "doc_id", place).orderBy("place", "doc_id", "text").limit(MOST_ROWS)
    return sorted((r["text"], r["lang"]) for r in chosen.collect())


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``, from whole texts alone. Null texts
    and texts without a letter are ``und``, score 0, rejected; so is all if nothing was learned.
    Rejection: the calibrated score or the share of known grams is under its bar. Columns of these
    names are replaced. Texts of any length are read whole, long ones in a batch of their own; rows
    that repeat score alike; an empty table stays empty."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    new = ("lang_pred", "score", "rejected")
    kept = [c for c in docs.columns if c.lower() not in new]
    at = [c.lower() for c in kept].index("text")
    docs = docs.select(*kept)

    def run(batches):
        model = shared.value
        for batch in batches:
            column = batch.column(at)
            data, offsets = utf8_view(column)
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            letters, known_share = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows)
            for start, stop in slices(offsets):
                off = offsets[start : stop + 1] - offsets[start]
                part = data[offsets[start] : offsets[stop]]
                ascii_letters = row_sums((((part | 32) >= 97) & ((part | 32) <= 122)).astype(np.int64), off)
                letters[start:stop] = ascii_letters > 0
                if model.languages:
                    p, known_share[start:stop] = model.scores(*framed(part, off))
                    best[start:stop], score[start:stop] = p.argmax(1), p.max(1)
            for row in np.flatnonzero(~letters):
                text = column[row].as_py()
                letters[row] = bool(text) and any(map(str.isalpha, text))
            known = letters & bool(model.languages)
            names = np.array([*model.languages, UNKNOWN], object)
            lang = names[np.where(known, best, len(model.languages))]
            score = np.where(known, score, 0.0)
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(~known | (score < model.bar) | (known_share < model.known_bar))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*kept, *new])

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.mapInArrow(tidied(run), T.StructType([*docs.schema.fields, *fields]))


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns as they were."""
    made = {"lang_pred", "score", "rejected"}
    away = {c: f"_{c}_of_row" for c in docs.columns if c.lower() in made}
    out = predict(docs.withColumnsRenamed(away), model).filter(~F.col("rejected"))
    return out.select(*[F.col(away.get(c, c)).alias(c) for c in docs.columns])


def fit(docs: DataFrame) -> LanguageModel:
    rows = training_rows(docs)
    return train([t for t, _ in rows], [x for _, x in rows])


def op4(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    facts = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(facts, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
