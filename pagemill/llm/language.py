"""Language identification by nearest centroid: TF-IDF n-gram vectors, a few clustered centroids a language, cosine."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches, stored, trimmed

#: Hashed n-gram space, and the n of its n-grams.
DIM, NGRAMS = 1 << 12, (1, 2, 3)
#: A classifier is fitted on about SAMPLE different texts a language; each language gets CENTROIDS.
SAMPLE, CENTROIDS, ROUNDS = 400, 4, 8
#: A document is rejected below this share of the cosine that all but the LOWEST part of sampled documents of its length reach.
REJECT_BELOW, LOWEST = 0.8, 0.005
#: Lengths with fewer sampled documents than ENOUGH take the floor of shorter ones, and those below all that have as many SHORTER times the least.
ENOUGH, SHORTER = 20, 0.5
UNDETERMINED = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def _folding() -> np.ndarray:
    """Code points below 128: letters lowered, all else a space."""
    return np.array([ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(128)], np.uint32)


_FOLD = _folding()


def counts(text: str) -> np.ndarray:
    """n-gram counts of a whole text, hashed to DIM places."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    a = np.where(a < 128, _FOLD[np.minimum(a, 127)], a)
    out = np.zeros(DIM, np.int64)
    for n in NGRAMS:
        if len(a) < n:
            break
        h = a[: len(a) - n + 1] * np.uint32(0x9E3779B1)
        for k in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + a[k : len(a) - n + 1 + k] * np.uint32(0x9E3779B1)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out += np.bincount(h >> np.uint32(20), minlength=DIM)
    return out


def normalised(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    vectors: np.ndarray
    idf: np.ndarray
    floors: np.ndarray  # least cosine accepted, by bit length of the text's length

    def nearest(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest centroid and its cosine, for rows of counts."""
        cos = normalised(tf, self.idf) @ self.vectors.T
        best = cos.argmax(1)
        return best, cos[np.arange(len(best)), best]


def clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-point seeds; rows of x have length 1."""
    seeds = [x.mean(0)]
    near = x @ seeds[0]
    for _ in range(min(k, len(x)) - 1):
        seeds.append(x[near.argmin()])
        near = np.maximum(near, x @ seeds[-1])
    c = np.stack(seeds)
    for _ in range(ROUNDS):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def fit(docs: DataFrame, train: Column, *, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Centroids | None:
    """Centroids of the languages of docs(doc_id, text, lang) where train holds; None without any.

    About `sample` different texts of each language are drawn by a hash of the text alone, at a
    rate from an estimate of how many there are, so copies and repeated rows are drawn once;
    they are merged before anything is dealt out. Each language is clustered in a task of its
    own, which holds about `sample` vectors. The driver and each worker hold the model:
    centroids * DIM floats a language (64 KB).
    """
    rows = pick(docs, doc_id="doc_id", text="text", lang="lang").where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "text", F.xxhash64("text", F.lit("language")).alias("draw"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("texts"))
    place = F.pmod("draw", F.lit(1 << 30)) / F.lit(float(1 << 30))
    rates = {r["lang"]: min(1.0, sample / r["texts"]) for r in sizes.collect()}
    if not rates:
        return None
    least = F.create_map(*[F.lit(x) for lang, rate in sorted(rates.items()) for x in (lang, rate)])
    drawn = rows.where(place < F.element_at(least, F.col("lang"))).groupBy("lang", "draw").agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            tf = [counts(t) for t in texts]
            at = [np.flatnonzero(v) for v in tf]
            yield pa.RecordBatch.from_arrays([b.column("draw"), b.column("lang").cast(pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array([v[i] for v, i in zip(tf, at, strict=True)], pa.list_(pa.int32()))], ["draw", "lang", "n", "at", "tf"])

    found = stored(drawn.mapInArrow(vectors, "draw long, lang string, n long, at array<int>, tf array<int>"), "language")
    n = found.count()
    df = {r["i"]: r["count"] for r in found.select(F.explode("at").alias("i")).groupBy("i").count().collect()}
    idf = np.log((1 + n) / (1 + np.array([df.get(i, 0) for i in range(DIM)]))).astype(np.float32) + 1

    def dense(pdf: pd.DataFrame) -> np.ndarray:
        x = np.zeros((len(pdf), DIM), np.int64)
        for row, (at, tf) in enumerate(zip(pdf["at"], pdf["tf"], strict=True)):
            x[row, np.asarray(at, np.int64)] = tf
        return x

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        c = clustered(normalised(dense(pdf.sort_values("draw")), idf), centroids)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(c), "v": [v.tobytes() for v in c]})

    got = sorted((r["lang"], bytes(r["v"])) for r in found.groupBy("lang").applyInPandas(cluster, "lang string, v binary").collect())
    model = Centroids([lang for lang, _ in got], np.stack([np.frombuffer(v, np.float32) for _, v in got]), idf, np.zeros(64))

    def cosines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                yield pd.DataFrame({"bits": [int(x).bit_length() for x in part["n"]], "cos": model.nearest(dense(part))[1].astype(float)})

    low = {r["bits"]: (r["low"], r["n"]) for r in found.mapInPandas(cosines, "bits int, cos double").groupBy("bits").agg(F.percentile("cos", LOWEST).alias("low"), F.count("*").alias("n")).collect()}
    floor = SHORTER * min([v for v, k in low.values() if k >= ENOUGH], default=0.0)
    for bits in range(64):
        if bits in low and low[bits][1] >= ENOUGH:
            floor = low[bits][0]
        model.floors[bits] = REJECT_BELOW * min(floor, low.get(bits, (1.0, 0))[0])
    return model


PREDICTED = "lang_pred string, score double, accepted boolean"


def identify(docs: DataFrame, model: Centroids | None, keep: dict[str, str]) -> DataFrame:
    """For each row of docs(text, ...): the kept columns (name -> type), lang_pred, score, accepted.

    Only the text is looked at. A null text and one without a letter are `und` with score 0,
    not accepted; all others get the nearest centroid's language with its cosine as score (of
    equal cosines, the first language in order), and are accepted unless they lie much further
    off than sampled documents of their length. Without a model all are `und`, and those with a
    letter are accepted: nothing tells against them. Very long texts are counted whole. Repeated
    rows, null ids and other columns change nothing; an empty table gives no rows.
    """

    small_batches(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 128):
                b = whole.slice(i, 128)
                texts = b.column("text").to_pylist()
                lang, score, ok = [UNDETERMINED] * len(texts), [0.0] * len(texts), [False] * len(texts)
                at = [j for j, t in enumerate(texts) if t and has_letter(t)]
                if model is None:
                    for j in at:
                        ok[j] = True
                elif at:
                    best, cos = model.nearest(np.stack([counts(texts[j]) for j in at]))
                    for j, k, c in zip(at, best, cos, strict=True):
                        lang[j], score[j] = model.languages[k], float(min(1.0, max(0.0, c)))
                        ok[j] = bool(c >= model.floors[len(texts[j]).bit_length()])
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], [*keep, "lang_pred", "score", "accepted"])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in keep.items()], PREDICTED])
    return docs.mapInArrow(trimmed(predict), schema)


def crc_fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def language_rows(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted: learns where the fold of 4 isn't 2, predicts for all rows."""
    model = fit(docs, crc_fold(4) != 2, **options)
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_fold(4) == 2).alias("held_out"))
    return identify(rows, model, {"doc_id": "long", "held_out": "boolean"})
