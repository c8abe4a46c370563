"""Language identification by mixture inference.

Each language has letter-trigram log-likelihoods, learned from labelled documents. A document is cut into
segments of a few words; expectation-maximisation over the segments' likelihoods estimates what share of it
each language has. The set of languages is chosen by penalised likelihood: a further language must raise the
log-likelihood by more than `penalty` times the log of the number of segments. Sets of every size are tried,
each size with the languages of the largest shares, until a larger one can't do better.

Texts are read whole, in batches bounded by their characters; one very long text is a batch of its own.

Defined results: null texts and texts without a letter are `und` with score 0 and no languages; ties between
languages go to the first in alphabetical order; equal texts have equal results; nothing but the text enters
a prediction. Without any labelled document every result is `und`; an empty table gives an empty table;
repeated rows are predicted alike; a column that has the name of the result is kept as <name>_input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm.shared import begin_task, set_aside

_BITS = 16
_RESULT = "struct<lang:string,score:double,languages:array<struct<lang:string,share:double>>>"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, count=0x110000)


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts' code points in a row, each text followed by a line end; the ends."""
    parts = [(t.lower() if t else "") + "\n" for t in texts]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, count=len(parts)))
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def trigrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the letters are, and for each the hash of it and its neighbours (0 beyond a word)."""
    is_letter = _letters()[points]
    own = np.where(is_letter, points, 0).astype(np.uint32)
    padded = np.concatenate([[0], own, [0]]).astype(np.uint32)
    at = np.flatnonzero(is_letter)
    h = padded[at] * np.uint32(0x9E3779B1) + padded[at + 1] * np.uint32(0x85EBCA77) + padded[at + 2] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return at, h >> np.uint32(32 - _BITS)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_likelihood: np.ndarray  # trigram hash x language
    words: int = 8  # in a segment
    penalty: float = 4.0
    settled: float = 1e-3  # EM ends where no share moves by more
    rounds: int = 200  # or, if it never settles, here

    def mixtures(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: has it letters; the shares of the languages; how sure the strongest is."""
        docs, kinds = len(texts), len(self.languages)
        points, ends = _points(texts)
        at, grams = trigrams(points)
        share, sure = np.zeros((docs, kinds)), np.zeros(docs)
        doc = np.searchsorted(ends, at, "right")
        has = np.bincount(doc, minlength=docs) > 0
        if not len(at) or not kinds:
            return has & (kinds > 0), share, sure
        opens = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])])
        word_doc = doc[opens]
        word_no = np.arange(len(word_doc)) - np.searchsorted(word_doc, word_doc, "left")
        begins = np.flatnonzero(opens)[word_no % self.words == 0]
        scores = np.add.reduceat(self.log_likelihood[grams], begins, axis=0).astype(np.float64)
        seg_doc, weight = doc[begins], np.diff(np.append(begins, len(at))).astype(np.float64)
        heads = np.flatnonzero(np.concatenate([[True], seg_doc[1:] != seg_doc[:-1]]))
        index = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(seg_doc))))
        share[seg_doc[heads]], sure[seg_doc[heads]] = self._select(scores, weight, heads, index)
        return has, share, sure

    def _select(self, scores: np.ndarray, weight: np.ndarray, heads: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.add.reduceat(scores, heads, axis=0)
        docs, kinds = total.shape
        rows = np.arange(docs)
        single = total.argmax(axis=1)
        best = np.zeros((docs, kinds))
        best[rows, single] = 1.0
        cost = self.penalty * np.log1p(np.diff(np.append(heads, len(scores))))
        best_value = total[rows, single] - cost
        posterior = np.exp(total - total[rows, single][:, None])
        sure = 1.0 / posterior.sum(axis=1)
        if kinds == 1:
            return best, sure
        top = scores.max(axis=1, keepdims=True)
        like = np.exp(scores - top)
        mass = np.add.reduceat(weight, heads)
        base = np.add.reduceat(top[:, 0], heads)
        # a mixture can't beat taking each segment's best language: most documents are settled by this bound
        open_ = np.flatnonzero(base - 2 * cost > best_value)
        if not len(open_):
            return best, sure
        keep = np.isin(index, open_)
        renamed = np.searchsorted(open_, index[keep])
        like, weight, mass, base, cost = like[keep], weight[keep], mass[open_], base[open_], cost[open_]
        heads = np.flatnonzero(np.concatenate([[True], renamed[1:] != renamed[:-1]]))

        def settle(pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            moving, own, first, each, heavy, total = np.arange(len(pi)), renamed, heads, like, weight, mass
            for _ in range(self.rounds):
                part = pi[moving][own] * each
                part *= (heavy / np.maximum(part.sum(axis=1), 1e-300))[:, None]
                new = np.add.reduceat(part, first, axis=0) / total[:, None]
                still = np.abs(new - pi[moving]).max(axis=1) > self.settled
                pi[moving] = new
                if not still.any():
                    break
                if not still.all():  # documents that have settled are left out
                    kept = still[own]
                    each, heavy = each[kept], heavy[kept]
                    own = (np.cumsum(still) - 1)[own[kept]]
                    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    moving, total = moving[still], total[still]
            mixed = np.log(np.maximum((pi[renamed] * like).sum(axis=1), 1e-300))
            return pi, np.add.reduceat(mixed, heads) + base

        full, _ = settle(np.full((len(open_), kinds), 1.0 / kinds))
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
        for size in range(2, kinds + 1):
            chosen = np.where(rank < size, full + 1e-6, 0.0)
            pi, value = settle(chosen / chosen.sum(axis=1, keepdims=True))
            value -= size * cost
            better = value > best_value[open_]
            best[open_[better]] = pi[better]
            sure[open_[better]] = 1.0
            best_value[open_[better]] = value[better]
            if (base - (size + 1) * cost <= best_value[open_]).all():
                break  # no larger set can do better
        return best, sure

    def results(self, texts: list[str | None]) -> Iterator[dict]:
        has, share, sure = self.mixtures(texts)
        for known, own, certain in zip(has.tolist(), share, sure.tolist()):
            if not known:
                yield {"lang": "und", "score": 0.0, "languages": []}
                continue
            order = [k for k in np.argsort(-own, kind="stable").tolist() if own[k] > 0.01]
            languages = [{"lang": self.languages[k], "share": float(own[k])} for k in order]
            yield {"lang": languages[0]["lang"], "score": min(1.0, languages[0]["share"] * certain), "languages": languages}


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 4000, **settings) -> LanguageModel:
    """A model from rows with text and language; rows without either are skipped.

    per_language bounds the sample: of each language, documents are taken by a hash of their id at the rate
    that gives about so many. Only counts by language and trigram hash reach the driver.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.dropna(subset=["text", "lang"])
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros((1 << _BITS, 0), np.float32), **settings)
    taken = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, per_language / sizes[name]))])
    number = F.create_map(*[F.lit(x) for k, name in enumerate(languages) for x in (name, k)])
    sample = rows.filter(taken < rate[F.col("lang")]).select(number[F.col("lang")].alias("k"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                points, ends = _points(part.column("text").to_pylist())
                at, grams = trigrams(points)
                kind = part.column("k").to_numpy().astype(np.int64)[np.searchsorted(ends, at, "right")]
                cell, n = np.unique(kind << _BITS | grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], names=["cell", "n"])

    counted = sample.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), 1 << _BITS))
    cell = counted["cell"].to_numpy()
    counts[cell >> _BITS, cell & ((1 << _BITS) - 1)] = counted["n"].to_numpy()
    smooth = counts + 0.1
    log_likelihood = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)
    return LanguageModel(languages, np.ascontiguousarray(log_likelihood), **settings)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with a column out: struct of lang, score (0 to 1) and the languages with their shares; a column of that name becomes out_input."""
    docs, (text_col,) = set_aside(docs, out, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 numbers for each language

    @F.arrow_udf(_RESULT)
    def language_of(texts: pa.Array) -> pa.Array:
        begin_task()
        model = shared.value
        size = np.cumsum([len(t) if t else 0 for t in texts.to_pylist()])
        limit = max(250_000, 6_000_000 // max(1, len(model.languages)))
        out: list[dict] = []
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
            out += model.results(texts[at:end].to_pylist())
            at = end
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])
        return pa.array(out, kind)

    return docs.withColumn(out, language_of(F.col(text_col).cast("string")))


def fold(id_col: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 if isinstance(id_col, str) else F.crc32(id_col.cast("string").cast("binary")) % 3
