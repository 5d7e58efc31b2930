"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of orders 1 to ``max_n`` per language; smoothed log-probabilities form a
matrix of ``2**bits`` rows and one column per language, broadcast to the executors (its size is
``2**bits * languages * 4`` bytes and does not depend on the corpus). Scoring adds, for each text, the
matrix rows of its n-grams in numpy, batch by batch.

Defined results: a null text, an empty text or a text without any letter is ``und`` with score 0. Ties
go to the language that sorts first. Repeated rows are scored one by one alike. Without any usable
training row every text is ``und``. An empty table gives an empty result. Very long texts are scored whole, in pieces that overlap by
``max_n - 1`` characters. Columns other than the ones named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import map_arrow, pick

UNDETERMINED = "und"
#: Characters handled at once, which bounds the memory of scoring.
PIECE = 1 << 18
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F), np.uint32(0x165667B1))


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; what is no letter becomes a space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    low = codes < 128
    letter = ~low | ((codes >= 97) & (codes <= 122))
    return np.where(letter, codes, np.uint32(32))


def _hashes(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of each n-gram of order n."""
    size = len(codes) - n + 1
    h = np.full(size, n, np.uint32)
    for k in range(n):
        h = (h ^ codes[k : k + size]) * _MIX[k]
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def joined_pieces(texts: list[str], max_n: int):
    """Yields (codes, owner of each code); texts are set apart by ``max_n`` zeros, long ones are cut with overlap."""
    codes, owner, size = [], [], 0
    gap = np.zeros(max_n, np.uint32)
    for i, text in enumerate(texts):
        whole = _codes(text)
        for start in range(0, max(1, len(whole)), PIECE):
            part = whole[max(0, start - max_n + 1) : start + PIECE]
            # the overlap's inner n-grams were counted before: a cut marks them by a shorter owner range
            codes.append(part)
            owner.append((i, len(part), min(start, max_n - 1)))
            codes.append(gap)
            size += len(part) + max_n
            if size >= PIECE:
                yield np.concatenate(codes), owner
                codes, owner, size = [], [], 0
    if codes:
        yield np.concatenate(codes), owner


def ngram_buckets(texts: list[str], max_n: int, bits: int):
    """Yields (index of the text, buckets of n-grams) over orders and texts, in arrays of equal length.

    An n-gram never spans two texts, and every n-gram of every text comes exactly once.
    """
    for codes, owner in joined_pieces(texts, max_n):
        lengths = np.array([x[1] for x in owner])
        starts = np.concatenate([[0], np.cumsum(lengths + max_n)[:-1]])
        overlap = np.array([x[2] for x in owner])
        text_of = np.array([x[0] for x in owner])
        which = np.repeat(np.arange(len(owner)), lengths + max_n)
        offset = np.arange(len(codes)) - starts[which]
        for n in range(1, max_n + 1):
            if len(codes) < n:
                continue
            h = _hashes(codes, n, bits)
            w, o = which[: len(h)], offset[: len(h)]
            keep = (o + n <= lengths[w]) & (o + n > overlap[w])
            yield text_of[w[keep]], h[keep]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray  # [2**bits, languages], float32
    bits: int
    max_n: int

    def scores(self, texts: list[str]) -> np.ndarray:
        """Joint log-probability of each text (row) and language (column)."""
        total = np.tile(self.log_prior, (len(texts), 1))
        for owner, buckets in ngram_buckets(texts, self.max_n, self.bits):
            if not len(owner):
                continue
            step = max(1 << 10, (1 << 20) // len(self.languages))  # bounds the gathered rows
            for i in range(0, len(owner), step):
                own = owner[i : i + step]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                sums = np.add.reduceat(self.log_prob[buckets[i : i + step]], first, axis=0, dtype=np.float64)
                np.add.at(total, own[first], sums)
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        total = self.scores([t or "" for t in texts])
        best = total.argmax(axis=1)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p = p[np.arange(len(texts)), best] / p.sum(axis=1) if len(texts) else np.zeros(0)
        known = [bool(t) and has_letter(t) for t in texts]
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known)], [float(x) if k else 0.0 for x, k in zip(p, known)]


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", row_id: str = "doc_id", max_rows_per_language: int = 4000, max_languages: int = 1000, bits: int = 16, max_n: int = 4, smoothing: float = 0.5) -> LanguageModel:
    """Fit on rows with a language and a text.

    The fit uses a bounded sample: of each language about ``max_rows_per_language`` rows, chosen by a
    hash of the id and the same at every run; a language with fewer rows gives all. More than
    ``max_languages`` languages is an error.
    """
    rows = pick(labelled, row_id, text, lang).toDF("row_id", "text", "lang").where("lang is not null and text is not null")
    per_lang = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(per_lang) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not per_lang:
        return LanguageModel((), np.zeros(0), np.zeros((1 << bits, 0), np.float32), bits, max_n)
    languages = tuple(sorted(per_lang))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, max_rows_per_language / per_lang[k]))])
    place = F.xxhash64("row_id").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    sample = rows.where(place < share[F.col("lang")]).select("text", "lang")

    def count(batches):
        totals = {k: np.zeros(1 << bits, np.int64) for k in languages}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(k, []).append(t)
            for k, texts in by_lang.items():
                for _, buckets in ngram_buckets(texts, max_n, bits):
                    totals[k] += np.bincount(buckets, minlength=1 << bits)
        for k, v in totals.items():
            if v.any():
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([k] * len(at)), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(v[at])})

    counted = map_arrow(sample, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((1 << bits, len(languages)))
    got = counted.toPandas()  # at most 2**bits rows a language
    counts[got["bucket"].to_numpy(), got["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy()] = got["n"].to_numpy()
    log_prob = np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * (1 << bits))
    prior = np.array([per_lang[k] for k in languages], float)
    return LanguageModel(languages, np.log(prior / prior.sum()), log_prob.astype(np.float32), bits, max_n)


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``lang_pred`` and ``score`` (posterior of the predicted language) of each row."""
    rows = pick(docs, *keep, text).toDF(*keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            lang, p = shared.value.predict(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(p, pa.float64())], [*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_arrow(rows, score, f"{schema}, lang_pred string, score double")
