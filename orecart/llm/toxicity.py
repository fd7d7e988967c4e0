"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017), in numpy.

Confirmed toxic texts are positives. All other training texts, labelled harmless or not labelled at all, are unlabelled. With
class prior p the risk is p R+(f) + max(0, R-u(f) - p R-p(f)): the loss of unlabelled texts as negatives, less what positives among
them account for, kept from turning negative. Where the second term is negative, the risk is the first one and steps follow its
slope alone. (The paper's algorithm for small batches goes up the second term's slope there. On check_s that finds 0.983 of the held-out
toxic texts and calls 0.7 % of the others toxic, against 0.997 and 0.14 %.) Slopes are of the whole risk over all fitted texts.

Before fitting, features are screened for those that positives have clearly more often than unlabelled texts do.

The score is linear in how many of a text's distinct words have each feature. Features of a word are itself and its starts of four to
six characters. So at scoring time a word has one weight, which a memo keeps, and a text costs one lookup a distinct word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orecart.llm.common import fold, per_worker

BITS, STARTS, MARKS = 20, (4, 5, 6), ".,;:!?\"'()[]{}<>*#$%&-_/\\|"
#: Rows the classifier is fitted on, at most about: confirmed toxic ones and others. Defaults of parameters of `fit`.
POSITIVES, UNLABELLED = 3000, 6000
#: Screening: a feature gets a weight only if this many positives have it, its share is this much larger among positives, and the
#: difference of shares is this many standard errors. Long texts hold thousands of chance features that would otherwise add up.
LEAST, LIFT, ERRORS = 5, 4.0, 5.0
STEPS, RATE, DECAY = 250, 0.3, 1e-4
MEMO = 400_000
THRESHOLD = 0.7


def word_of(raw: str) -> str:
    return raw.lower().strip(MARKS)


def features(word: str) -> list[int]:
    import xxhash

    names = [f"={word}", *(word[:n] for n in STARTS if len(word) >= n)] if word else []
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) & ((1 << BITS) - 1) for x in names]


def distinct_words(text: str | None) -> set[str]:
    return {w for w in map(word_of, set(text.split())) if w} if text else set()


@dataclass
class Model:
    weights: np.ndarray
    bias: float


class WordWeights(dict):
    def __init__(self, model: Model) -> None:
        self.weights = model.weights

    def __missing__(self, raw: str) -> float:
        if len(self) > MEMO:
            self.clear()
        w = self[raw] = float(self.weights[features(word_of(raw))].sum()) if word_of(raw) else 0.0
        return w


def raw_score(text: str | None, words: WordWeights, bias: float) -> float:
    """Probability-like score from the distinct words; spellings of a word that differ in case or marks count once."""
    total = bias
    if text:
        found: dict[str, float] = {}
        for raw in set(text.split()):
            if weight := words[raw]:
                found[word_of(raw)] = weight
        total += sum(found[w] for w in sorted(found))
    return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def train(rows: list[np.ndarray], positive: np.ndarray, prior: float) -> Model:
    """Fit on each text's feature indices (repeats count); `positive` marks confirmed texts, the others are unlabelled."""
    size = 1 << BITS
    weights = np.zeros(size)
    if not positive.any() or positive.all():
        return Model(weights, -5.0)
    has = [np.zeros(size, np.int32), np.zeros(size, np.int32)]
    for r, p in zip(rows, positive, strict=True):
        has[int(p)][np.unique(r)] += 1
    n_p, n_u = positive.sum(), (~positive).sum()
    in_p, in_u = has[1] / n_p, (has[0] + 1) / n_u
    use = (has[1] >= LEAST) & (in_p >= LIFT * in_u) & (in_p - in_u >= ERRORS * np.sqrt(in_u / n_p + in_u / n_u))
    names = np.flatnonzero(use)
    at = np.full(size, -1)
    at[names] = np.arange(len(names))
    kept = [at[r][use[r]] for r in rows]
    w, b = np.zeros(len(names)), -1.0
    grow_w, grow_b = np.full(len(names), 1e-6), 1e-6
    sizes = np.array([len(k) for k in kept])
    flat, owner = np.concatenate(kept), np.repeat(np.arange(len(kept)), sizes)
    share = np.where(positive, 1 / n_p, 1 / n_u)

    def slopes(each: np.ndarray) -> tuple[np.ndarray, float]:
        return np.bincount(flat, each[owner], len(w)), float(each.sum())

    for _ in range(STEPS):
        z = np.clip(b + np.bincount(owner, w[flat], len(kept)), -30, 30)
        as_positive, as_negative = -share / (1 + np.exp(z)), share / (1 + np.exp(-z))
        loss = np.log1p(np.exp(z)) * share
        second = np.where(positive, -prior * as_negative, as_negative)
        if loss[~positive].sum() >= prior * loss[positive].sum():
            each = np.where(positive, prior * as_positive, 0.0) + second
        else:
            each = np.where(positive, prior * as_positive, 0.0)
        g_w, g_b = slopes(each)
        g_w = g_w + DECAY * w
        grow_w, grow_b = grow_w + g_w**2, grow_b + g_b**2
        w, b = w - RATE * g_w / np.sqrt(grow_w), b - RATE * g_b / np.sqrt(grow_b)
    weights[names] = w
    return Model(weights, float(b))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from rows of `docs` outside fold `held`; `labels` has (doc_id, toxic), of which only toxic = 1 is used as a label.

    The class prior is the toxic share of labelled training rows unless given. Rows are drawn by a hash at rates from exact counts, so that
    about `positives` confirmed and `unlabelled` other rows remain, whatever the corpus; rows without an id are drawn by where they
    stand in the table. Repeated rows are rows of their own. Null and empty texts have no features. Of repeated labels of an id the
    largest holds. Without positives, or with an empty table, every text scores near 0. Other columns are ignored, whatever their names.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold("doc_id", folds) != held)
    pool = docs.select("doc_id", "text").filter(fold("doc_id", folds) != held)
    toxic_ids = marks.filter("toxic = 1").select(F.col("doc_id").alias("p_id"))
    seen = marks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    rest = pool.select("doc_id").count()
    if prior is None:
        prior = seen["toxic"] / seen["n"] if seen["n"] else 0.0
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    pool = pool.withColumn("dice", F.pmod(F.xxhash64("doc_id", "text", place, F.lit("toxicity sample")), F.lit(1 << 30)))
    cut = [int((1 << 30) * min(1.0, most / max(1, n))) for most, n in ((positives, seen["toxic"]), (unlabelled, rest - seen["toxic"]))]
    near = pool.filter(F.col("dice") < max(cut)).join(toxic_ids, F.col("doc_id") == F.col("p_id"), "left").select("doc_id", "text", "dice", F.col("p_id").isNotNull().alias("positive"))
    drawn = near.filter(F.when(F.col("positive"), F.col("dice") < cut[0]).otherwise(F.col("dice") < cut[1])).drop("dice")

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, list[int]] = {}
        for batch in batches:
            out = []
            for text in batch["text"]:
                own: list[int] = []
                for w in sorted(distinct_words(text)):
                    if w not in memo:
                        if len(memo) > MEMO:
                            memo.clear()
                        memo[w] = features(w)
                    own += memo[w]
                out.append(np.array(own, "<i4").tobytes())
            yield pd.DataFrame({"positive": batch["positive"], "features": out})

    # in an order that doesn't depend on how rows were dealt to tasks
    got = drawn.mapInPandas(featurise, "positive boolean, features binary").toPandas().sort_values(["positive", "features"])
    return train([np.frombuffer(x, "<i4").astype(np.int64) for x in got["features"]], got["positive"].to_numpy(bool), float(prior))


def score(docs: DataFrame, model: Model, folds: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of (doc_id, text).

    Null and empty texts score by the bias alone; a text of any length is read whole. Rows are independent: repeated rows and null ids
    get their own results, and an empty table gives none. The model sent out has a fixed size; labels, lang, source and ids are not
    read, nor are other columns, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    key = ("toxicity", uuid.uuid4().hex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = per_worker(key, lambda: WordWeights(Model(*shared.value)))
        for batch in batches:
            batch["score"] = [raw_score(t, words, shared.value[1]) for t in batch.pop("text")]
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch

    scored = docs.select(F.col("doc_id").cast("long"), (fold("doc_id", folds) == held).alias("held_out"), "text").mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, unchanged, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    key = ("toxicity", uuid.uuid4().hex)

    @F.pandas_udf("boolean")
    def harmless(texts: pd.Series) -> pd.Series:
        words = per_worker(key, lambda: WordWeights(Model(*shared.value)))
        return pd.Series([raw_score(t, words, shared.value[1]) < threshold for t in texts])

    return docs.filter(harmless("text"))
