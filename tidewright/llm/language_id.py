"""Language ID by nearest centroids of TF-IDF n-gram vectors.

A text becomes a normalised vector of hashed letter n-grams (one to three UTF-8 bytes of the
lower-cased text, with everything but letters as one separator), weighted by log(1 + tf) and by
inverse document frequencies counted over all training rows. Each language has several centroids, clustered on the
executors by spherical k-means on a bounded sample of its rows; only they come to the driver. A text gets the language of the centroid of the
greatest cosine; it is rejected if that cosine is far less than almost every training text of that
language has, as far as a text of its length can reach it.

Defined results: a null text, or one without a letter, gets ``und``, score 0 and is rejected, and
so does every text if there is no training row; ties go to the language that sorts first; repeated
rows give repeated rows; whole texts count; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import bounded_batches, sliced, utf8

#: Buckets of hashed n-grams, centroids of a language, sampled rows of a language, about.
DIMENSIONS = 4096
CENTROIDS = 4
SAMPLE_ROWS = 400
#: A text is rejected under this share of the cosine that all but this quantile of the sample reach;
#: texts of fewer distinct n-grams than the third can reach less, in proportion to the root.
REJECT_SHARE, REJECT_QUANTILE, FULL_GRAMS = 0.5, 0.01, 2000
UNKNOWN = "und"

#: Bytes that are no part of a letter: ASCII but letters. Other bytes are kept, as letters of all scripts have them.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def vectors(texts: pa.Array) -> np.ndarray:
    """Term frequencies: a row of ``DIMENSIONS`` log(1 + tf) for each text."""
    n = len(texts)
    raw, offsets = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    # two separators before each text and one at its end keep n-grams apart
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    at = np.arange(len(raw)) + 3 * owner + 2
    padded = np.full(len(raw) + 3 * n + 2, 32, np.uint8)
    padded[at] = _FOLD[raw]
    b = padded.astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64), sizes + 3)
    keep = (b[2:] != 32) | (b[1:-1] != 32)
    total = np.zeros(n * DIMENSIONS, np.float32)
    one, two, three = b[2:], b[1:-1], b[:-2]
    for gram, salt in ((one, 1), (one + two * 257, 2), (one + two * 257 + three * 66049, 3)):
        h = (gram * np.uint32(2654435761) + np.uint32(salt * 40503)) >> np.uint32(16)
        total += np.bincount(row[keep] * DIMENSIONS + (h[keep] % DIMENSIONS), minlength=n * DIMENSIONS)
    return np.log1p(total, dtype=np.float32).reshape(n, DIMENSIONS)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


@dataclass
class CentroidModel:
    languages: list[str]
    idf: np.ndarray
    owners: np.ndarray  # index of its language for each centroid
    centroids: np.ndarray
    least: np.ndarray  # cosine under which a language rejects

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, cosine, rejected) of each text."""
        x = vectors(texts)
        reach = np.sqrt(np.minimum(1.0, np.count_nonzero(x, axis=1) / FULL_GRAMS))
        cos = _unit(x * self.idf) @ self.centroids.T
        best = cos.argmax(1)
        score = np.clip(cos[np.arange(len(best)), best], 0, 1).astype(float)
        lang = self.owners[best]
        return lang, score, score < self.least[lang] * reach


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, begun from the farthest points."""
    centers = [_unit(x.mean(0, keepdims=True))[0]]
    near = x @ centers[0]
    while len(centers) < min(k, len(x)):
        centers.append(x[near.argmin()])
        near = np.maximum(near, x @ centers[-1])
    c = np.array(centers)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = _unit(np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


def train(docs: DataFrame, sample: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> CentroidModel | None:
    """Fit on rows that are not held out and have a language and a letter; None if there is none."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & has_letter(F.col("text"))).select("text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row per n-gram and task; the last bucket counts the texts
        df = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in sliced(batches):
            df[:-1] += (vectors(batch.column("text")) > 0).sum(0)
            df[-1] += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["bucket", "n"])

    df = np.zeros(DIMENSIONS + 1)
    for r in rows.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r.bucket] = r.n
    if not df[-1]:
        return None
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = _unit(vectors(batch.column("text")) * idf).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "v"])

    def clustered(group: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(sorted(group["v"].to_pylist())), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
        c = _clusters(x, centroids)
        least = REJECT_SHARE * float(np.quantile((x @ c.T).max(1), REJECT_QUANTILE))
        return pa.table({"lang": pa.array([group["lang"][0].as_py()] * len(c), pa.string()), "place": pa.array(range(len(c)), pa.int32()), "least": pa.array([least] * len(c)), "v": pa.array([v.tobytes() for v in c.astype(np.float32)], pa.binary())})

    # a language's share of hashes is that of its distinct texts, so copies of one text do not fill it
    h = F.xxhash64("text")
    sizes = rows.select("lang", h.alias("h")).distinct().groupBy("lang").count().collect()  # a row for a language, as the model has
    known = spark.createDataFrame([(r.lang, min(1.0, sample / r["count"]) * 2**30) for r in sizes], "lang string, share double")
    # the driver holds these rows already, and the model that goes to every task is far larger
    some = rows.join(F.broadcast(known), "lang").where(F.pmod(h, F.lit(2**30)) < F.col("share")).dropDuplicates(["lang", "text"]).select("lang", "text")
    fitted = some.mapInArrow(sampled, "lang string, v binary").groupBy("lang").applyInArrow(clustered, "lang string, place int, least double, v binary")
    found = sorted(fitted.collect(), key=lambda r: (r.lang, r.place))
    languages = sorted({r.lang for r in found})
    place = {lang: i for i, lang in enumerate(languages)}
    least = {r.lang: r.least for r in found}
    centers = np.frombuffer(b"".join(bytes(r.v) for r in found), np.float32).reshape(-1, DIMENSIONS)
    return CentroidModel(languages, idf, np.array([place[r.lang] for r in found]), centers, np.array([least[lang] for lang in languages]))


def identify(docs: DataFrame, model: CentroidModel | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected."""
    model = model or train(docs)
    schema = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), has_letter(F.col("text")).alias("letters"), "text")
    return rows.mapInArrow(lambda batches: ((pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *_predicted(b, model)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])) for b in sliced(batches)), schema)


def accepted(docs: DataFrame, model: CentroidModel | None = None) -> DataFrame:
    """The documents whose language is told and not rejected, with their own columns."""
    model = model or train(docs)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(text)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)
            yield batch.filter(pc.invert(_predicted(pa.RecordBatch.from_arrays([texts, letters], names=["text", "letters"]), model)[2]))

    return docs.mapInArrow(run, docs.schema)


def _predicted(batch: pa.RecordBatch, model: CentroidModel | None) -> list[pa.Array]:
    n = batch.num_rows
    letters = np.asarray(batch.column("letters"), dtype=bool)
    if model is None or not n:
        return [pa.array([UNKNOWN] * n, pa.string()), pa.array([0.0] * n, pa.float64()), pa.array([True] * n, pa.bool_())]
    lang, score, rejected = model.predict(batch.column("text"))
    names = [model.languages[i] if ok else UNKNOWN for i, ok in zip(lang, letters)]
    return [pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(rejected | ~letters)]
