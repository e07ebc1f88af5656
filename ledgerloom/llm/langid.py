"""Language identification as inference of a multilingual mixture.

Each language has a model of byte n-grams (1 to 4) of words, so a word has a
likelihood in every language.  A document is a mixture: expectation-
maximisation over its words estimates the proportion of each language.  The
set of languages is selected by penalised likelihood: the language of the
smallest proportion is removed as long as the likelihood, less half a
log(words) for each language, doesn't fall.  The language of the largest
proportion is the prediction, that proportion the score.

The n-gram counts are fitted on a bounded sample of labelled rows, at most
`per_language` documents of each language, those of the smallest hash of
doc_id, of the MOST_LANGUAGES languages with most labelled documents (of equals,
those that sort first): a noisy column can't grow the model.  They are counted
on the executors and only (language, bucket, count) sums reach the driver, at
most MOST_LANGUAGES x 2**BITS of them.  Prediction is one
pass over the whole texts, without a shuffle.

Defined results: a null text, or one without a letter, is `und` with score 0,
and so is every text if no row is labelled; ties go to the language that sorts
first; rows are predicted one by one, so repeated rows agree; of the input only
doc_id and text matter for a prediction, and clashing columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import LETTERISH, Text, byte_ngrams, distinct_words, has_letter, pieces, segment_sum

ORDERS = (1, 2, 3, 4)
BITS = 16
PER_LANGUAGE = 1500
MOST_LANGUAGES = 256
ROUNDS, AGAIN = 8, 5


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: languages x 2**BITS n-gram counts."""
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True)
        self.log = np.log((counts + 0.5) / (total + 0.5 * counts.shape[1])).astype(np.float32)

    def word_loglik(self, words: Text) -> np.ndarray:
        """words x languages, averaged over the n-gram orders and centred on the best language."""
        owner, bucket = byte_ngrams(words, ORDERS, BITS)
        bounds = np.searchsorted(owner, np.arange(len(words) + 1))
        out = np.stack([segment_sum(row[bucket], bounds) for row in self.log], axis=1) / len(ORDERS)
        return out - out.max(axis=1, keepdims=True)

    def mixture(self, lik: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """documents x languages proportions; lik: entries x languages, entries grouped by document."""
        n, k = len(bounds) - 1, lik.shape[1]
        size = np.maximum(segment_sum(weight, bounds), 1e-9)
        doc = np.repeat(np.arange(n), np.diff(bounds))

        def em(theta: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(rounds):
                joint = theta[doc] * lik
                mass = joint.sum(axis=1)
                theta = segment_sum(joint * (weight / np.maximum(mass, 1e-300))[:, None], bounds) / size[:, None]
            mass = (theta[doc] * lik).sum(axis=1)
            return theta, segment_sum(weight * np.log(np.maximum(mass, 1e-300)), bounds)

        theta, value = em(np.full((n, k), 1.0 / k), ROUNDS)
        active = np.ones((n, k), bool)
        price = 0.5 * np.log(np.maximum(size, 1.0) + 1.0)
        live = np.diff(bounds) > 0
        for _ in range(k - 1):
            if not live.any():
                break
            least = np.where(active, theta, np.inf).argmin(axis=1)
            trial = theta.copy()
            trial[np.arange(n), least] = 0.0
            rest = trial.sum(axis=1, keepdims=True)
            trial = np.where(rest > 0, trial / np.maximum(rest, 1e-300), active & (np.arange(k) != least[:, None]))
            trial, after = em(trial, AGAIN)
            better = live & (after + price >= value)
            theta[better], value[better] = trial[better], after[better]
            active[np.flatnonzero(better), least[better]] = False
            live = better
        return theta

    def predict(self, text: Text) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, proportions) of each text."""
        n = len(text)
        known = has_letter(text) & bool(self.languages)
        if not known.any():
            return ["und"] * n, np.zeros(n), np.zeros((n, len(self.languages)))
        h, s, e, doc = text.words(LETTERISH)
        words, which = distinct_words(text, h, s, e)
        lik = np.exp(self.word_loglik(words))
        pair, times = np.unique(doc * len(words) + which, return_counts=True)
        doc, which = pair // len(words), pair % len(words)
        theta = self.mixture(lik[which], times.astype(np.float64), np.searchsorted(doc, np.arange(n + 1)))
        best = theta.argmax(axis=1)
        score = np.where(known, np.clip(theta[np.arange(n), best], 0.0, 1.0), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best, known)], score, theta


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """From rows with text and lang; doc_id only orders the rows for the sample."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 40)).alias("h"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 1 << BITS)))
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(int(min(1.0, per_language / v) * (1 << 40))))])
    sample = rows.where(F.col("h") < share[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << BITS), np.int64)
        place = {k: i for i, k in enumerate(languages)}
        for batch in batches:
            for part in pieces(batch):
                text = Text.of(part.column("text"))
                lang = np.array([place[x] for x in part.column("lang").to_pylist()], np.int64)
                h, s, e, doc = text.words(LETTERISH)
                if not len(h):
                    continue
                words, which = distinct_words(text, h, s, e)
                owner, bucket = byte_ngrams(words, ORDERS, BITS)
                for k in np.unique(lang):
                    times = np.bincount(which[lang[doc] == k], minlength=len(words))
                    total[k] += np.bincount(bucket, weights=times[owner], minlength=1 << BITS).astype(np.int64)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(total[k, b])], names=["k", "b", "n"])

    counts = np.zeros((len(languages), 1 << BITS))
    found = sample.mapInArrow(count, "k long, b long, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    counts[found.k.to_numpy(), found.b.to_numpy()] = found.n.to_numpy()
    return Model(languages, counts)


def held_out(key: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, lang_score and lang_mix (a map of proportions above 0.01)."""
    names = [f for f in docs.schema.fields if f.name not in ("lang_pred", "lang_score", "lang_mix")]
    keep = docs.select(*[f.name for f in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", lang_pred string, lang_score double, lang_mix map<string,double>"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = keep.columns

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in pieces(batch):
                pred, score, theta = m.predict(Text.of(part.column("text")))
                mix = [[(m.languages[j], float(row[j])) for j in np.flatnonzero(row > 0.01)] if p != "und" else [] for p, row in zip(pred, theta)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(mix, pa.map_(pa.string(), pa.float64()))], names=[*columns, "lang_pred", "lang_score", "lang_mix"])

    return keep.mapInArrow(run, schema)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, mix) for every row, learning from those that aren't held out."""
    model = fit(docs.where(~held_out()), per_language)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_mix").alias("mix"))


def keep_known(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Pipeline form: rejects documents in no language; the others get the language found."""
    model = fit(docs.where(~held_out()), per_language)
    found = predict(docs, model).where("lang_pred <> 'und'")
    return found.select(*[F.col("lang_pred").alias("lang") if c == "lang" else c for c in docs.columns])
