"""Language-model scores by deleted interpolation of word n-grams.

P_n(w | context) = L_n f_n + (1 - L_n) P_n-1, down to 1 / (V + 1): f_n are maximum-likelihood estimates from training counts, and the weights
L_n depend on the bucket (binary logarithm) of the context's frequency. Weights are learned by expectation-maximisation on training
documents whose counts are deleted from the estimates meanwhile (one fold); scores then use all training counts. A context that was never
seen has weight 0, so all of the mass goes to the shorter context.

Counts meet texts without a table of counts on any one machine. Documents are cut into chunks of bounded size, written once. Each chunk
sends each of its distinct n-grams once, packed with its neighbours by bucket of hash. A bucket adds up what all chunks sent and answers
each chunk with the totals of its n-grams, in order. So a frequent word is one entry a chunk, and a row holds thousands of n-grams.
Answers then meet their chunks: first those of the deleted fold, for the weights, then all, for the scores. Documents of the deleted fold
have chunks of their own, so learning the weights reads no others.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orecart.llm.common import Scratch, fold, lowered_words, per_worker, streamed
from orecart.llm.minhash import WordHashes, mix

#: Tokens in a chunk, text bytes for each bucket of counts, buckets of context frequency, bins of an octave in EM's table.
CHUNK, BUCKET_BYTES, LEVELS, BINS = 1 << 20, 24_000_000, 48, 32
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x2545F4914F6CDD1D)
TRAIN, DELETED, HELD = 0, 1, 2
SENT = "key long, src long, part int, blob binary"
ANSWERS = "src long, part int, b long, blob binary, v long, n long, m long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: byte planes of each, compressed."""
    import zstandard

    planes = [(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()) for a in arrays]
    return zstandard.compress(pickle.dumps(planes), 1)


def expand(blob: bytes) -> list[np.ndarray]:
    import zstandard

    out = []
    for kind, data in pickle.loads(zstandard.decompress(blob)):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel())
    return out


def ngrams(words: np.ndarray, lengths: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Hash, of `bits` bits, of the n-gram that ends at each token; before a document's first token there are start marks."""
    if order == 1:
        return words
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.arange(len(words))
    out = np.full(len(words), order, np.uint64)
    for back in range(order - 1, -1, -1):
        i = at - back
        out = mix(out ^ np.where(i < first, START, words[np.maximum(i, 0)]))
    return out >> np.uint64(64 - bits)


def _bucket(h: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Equal ranges of hashes, so that sorted hashes of a bucket lie close."""
    return ((h >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)


def _cut(bits: int):
    """Chunks of documents: ids, folds, lengths, the hashes of the distinct words and, for each token, which of these it is.

    The last bit of a chunk's number tells whether it holds documents of the deleted fold.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, task, made = per_worker(("shingles",), WordHashes), TaskContext.get().partitionId(), 0
        waiting = {False: ([], [], []), True: ([], [], [])}
        tokens = {False: 0, True: 0}

        def flush(deleted: bool) -> pd.DataFrame:
            nonlocal made
            docs, kinds, words = waiting[deleted]
            seen, where = np.unique(np.concatenate(words), return_inverse=True)
            ids = np.array([d if d is not None else -1 for d in docs], np.int64)
            null = np.array([d is None for d in docs], np.uint8)
            lengths = np.array([len(w) for w in words], np.int64)
            blob = squeeze(ids, null, np.array(kinds, np.uint8), lengths, np.diff(seen, prepend=np.uint64(0)), where.astype(np.uint32))
            src = (task << 24 | made) << 1 | deleted
            made, tokens[deleted], waiting[deleted] = made + 1, 0, ([], [], [])
            return pd.DataFrame({"src": [src], "blob": [blob]})

        for batch in batches:
            for doc, kind, data in zip(batch["doc_id"].astype("object"), batch["kind"], batch["data"], strict=True):
                split, own = lowered_words(data), kind == DELETED
                docs, kinds, words = waiting[own]
                docs.append(None if doc is None or doc != doc else int(doc))
                kinds.append(kind)
                words.append(np.append(np.fromiter(map(hashes.__getitem__, split), np.uint64, len(split)), END) >> np.uint64(64 - bits))
                tokens[own] += len(split) + 1
                if tokens[own] >= CHUNK:
                    yield flush(own)
        for own in (False, True):
            if waiting[own][0]:
                yield flush(own)

    return run


def _opened(blob: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A chunk's ids, nulls, folds and lengths; its distinct words; and which of them each token is."""
    ids, null, kinds, lengths, gaps, where = expand(blob)
    return [ids, null, kinds, lengths], np.cumsum(gaps, dtype=np.uint64), where


def _grams(words: np.ndarray, where: np.ndarray, lengths: np.ndarray, order: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n the chunk's distinct n-grams and which of them ends at each token."""
    yield 1, words, where
    flat = words[where]
    for n in range(2, order + 1):
        yield n, *np.unique(ngrams(flat, lengths, n, bits), return_inverse=True)


def _send(order: int, buckets: int, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for src, blob in zip(batch["src"], batch["blob"], strict=True):
                (_, _, kinds, lengths), words, where = _opened(blob)
                kind, rows = np.repeat(kinds, lengths), []
                for n, seen, at in _grams(words, where, lengths, order, bits):
                    train = np.bincount(at, kind != HELD, len(seen)).astype(np.uint32)
                    deleted = np.bincount(at, kind == DELETED, len(seen)).astype(np.uint32)
                    for b, own in zip(*_runs(_bucket(seen, buckets, bits)), strict=True):
                        rows.append((n * buckets + int(b), src, n, squeeze(np.diff(seen[own], prepend=np.uint64(0)), train[own], deleted[own])))
                yield pd.DataFrame(rows, columns=["key", "src", "part", "blob"])

    return run


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    values, starts = np.unique(ordered, return_index=True)
    ends = np.append(starts[1:], len(ordered))
    return values, [slice(a, b) for a, b in zip(starts, ends, strict=True)]


def _add_up(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Totals of each bucket's n-grams, in the order that each chunk sent them; v, n and m are a bucket's distinct training words, training
    tokens and deleted tokens, in one row of it."""
    for key, own in b.groupby("key", sort=False):
        got = [expand(x) for x in own["blob"]]
        seen, where = np.unique(np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got]), return_inverse=True)
        train, deleted = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
        np.add.at(train, where, np.concatenate([g[1] for g in got]))
        np.add.at(deleted, where, np.concatenate([g[2] for g in got]))
        ends = np.cumsum([len(g[0]) for g in got])
        out = own[["src", "part"]].assign(b=key, blob=[squeeze(train[w], deleted[w]) for w in np.split(where, ends[:-1])], v=0, n=0, m=0)
        if own["part"].iloc[0] == 1:
            out.iloc[0, -3:] = [int((train > 0).sum()), int(train.sum()), int(deleted.sum())]
        yield out


def _met(chunks: DataFrame, answers: DataFrame, tasks: int, order: int, bits: int, each, schema: str) -> DataFrame:
    """`each` on the arrays of every chunk: ids, nulls, folds, lengths and, for each n, the training and deleted totals of the n-gram that
    ends at each token."""
    both = chunks.select("src", F.lit(0).alias("part"), F.lit(0).cast("long").alias("b"), "blob").unionByName(answers.select("src", "part", "b", "blob"))

    def assemble(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, own in b.groupby("src", sort=False):
            arrays, words, where = _opened(own["blob"].iloc[0])  # the chunk itself is part 0
            for n, seen, at in _grams(words, where, arrays[3], order, bits):
                got = [expand(x) for x in own.loc[own["part"] == n, "blob"]]  # in the order of the buckets, as the n-grams are
                for k in (0, 1):
                    total = np.concatenate([g[k] for g in got])
                    if len(total) != len(seen):
                        raise ValueError("a chunk and its answers do not match")
                    arrays.append(total[at])
            yield from each(arrays)

    return both.repartition(tasks, "src").sortWithinPartitions("src", "part", "b").mapInPandas(streamed(["src"], assemble), schema)


def _estimates(arrays: list[np.ndarray], order: int, size: tuple[int, int, int, int], deleted: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(f_n, bucket of the context's frequency) of each token, for n = 1 up to the order. size: V, N, deleted tokens, documents counted."""
    lengths = arrays[3]
    first = np.cumsum(lengths) - lengths
    counts = [arrays[4 + 2 * k] - arrays[5 + 2 * k] if deleted else arrays[4 + 2 * k] for k in range(order)]
    out = []
    for n in range(1, order + 1):
        if n == 1:
            total = max(1, size[1] - (size[2] if deleted else 0))
            out.append((counts[0] / total, np.ones(len(counts[0]), np.int64)))
            continue
        context = np.empty(len(counts[0]), np.int64)
        context[1:] = counts[n - 2][:-1]
        context[first] = size[3]
        f = np.where(context > 0, np.minimum(1, counts[n - 1] / np.maximum(context, 1)), 0.0)
        out.append((f, np.minimum(np.ceil(np.log2(np.maximum(context, 0) + 1)), LEVELS - 1).astype(np.int64)))
    return out


def _mixed(estimates: list[tuple[np.ndarray, np.ndarray]], weights: list[np.ndarray], v: int) -> np.ndarray:
    """Probabilities of each token by as many orders as there are weights."""
    p = np.full(len(estimates[0][0]), 1 / (v + 1))
    for (f, bucket), w in zip(estimates, weights, strict=False):
        p = w[bucket] * f + (1 - w[bucket]) * p
    return p


def learn_weights(ratios: np.ndarray, counts: np.ndarray, rounds: int = 100) -> float | None:
    """EM for one weight: of f against the lower order, given how often each ratio f / P occurs among deleted tokens. None without any."""
    if not counts.sum():
        return None
    w = 0.5
    for _ in range(rounds):
        w = float((counts * (w * ratios / (w * ratios + 1 - w))).sum() / counts.sum())
        w = min(max(w, 1e-6), 1 - 1e-6)
    return w


def filled(weights: list[float | None]) -> np.ndarray:
    """Weights by bucket: 0 for contexts never seen (bucket 0); a bucket without deleted tokens takes the nearest one's, the lower of two."""
    known = [b for b, w in enumerate(weights) if b and w is not None]
    near = lambda b: weights[min(known, key=lambda k: (abs(k - b), k))] if known else 0.5
    return np.array([0.0 if not b else near(b) for b in range(len(weights))])


def score(docs: DataFrame, order: int = 2, folds: int = 7, held: int = 2, deleted_fold: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of (doc_id, text).

    Training rows are those outside fold `held`; those of `deleted_fold` also teach the weights. Null and empty texts are one end mark.
    Null ids are in fold 0; repeated rows count and are scored each. Without training rows probabilities come from 1 / (V + 1) = 1.
    An empty table gives no rows; a text of any length is scored whole. Other columns are ignored, whatever their names. The driver gets
    sums and a table of EM counts of fixed size.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    number = fold("doc_id", folds)
    kind = F.when(number == held, HELD).when(number == deleted_fold, DELETED).otherwise(TRAIN)
    text = docs.select(F.col("doc_id").cast("long"), kind.alias("kind"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    size = text.agg(F.sum(F.length("data")), F.sum((F.col("kind") != HELD).cast("long")), F.sum((F.col("kind") == DELETED).cast("long"))).first()
    if size[0] is None:
        return spark.createDataFrame([], SCORES)
    buckets = max(1, -(-int(size[0]) // BUCKET_BYTES))
    bits = min(64, max(40, 2 * int(size[0]).bit_length() - 3))  # fewer n-grams than bytes / 2, so their pairs are fewer than 2 ** bits
    chunks = scratch.write(text.mapInPandas(_cut(bits), "src long, blob binary"), "chunks")
    sent = chunks.mapInPandas(_send(order, buckets, bits), SENT).repartition(max(buckets * order, 1), "key").sortWithinPartitions("key", "src")
    answers = scratch.write(sent.mapInPandas(streamed(["key"], _add_up), ANSWERS), "answers")
    v, n, n_deleted = (int(x or 0) for x in answers.agg(F.sum("v"), F.sum("n"), F.sum("m")).first())
    odd = F.col("src") % 2 == 1
    own = _met(chunks.filter(odd), answers.filter(odd), buckets, order, bits, lambda arrays: [pd.DataFrame({"blob": [squeeze(*arrays)]})], "blob binary")
    deleted = scratch.write(own, "deleted")
    weights: list[np.ndarray] = []
    for level in range(order):
        chosen = list(weights)

        def table(batches: Iterator[pd.DataFrame], level=level, chosen=chosen) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for blob in batch["blob"]:
                    est = _estimates(expand(blob), order, (v, n, n_deleted, size[1] - size[2]), True)
                    below = _mixed(est, chosen, v)
                    f, bucket = est[level]
                    with np.errstate(divide="ignore"):
                        bin_ = np.where(f > 0, np.clip(np.round(BINS * np.log2(f / below)), -40 * BINS, 80 * BINS), -41 * BINS).astype(np.int64)
                    cells, c = np.unique(bucket << 32 | (bin_ + (41 * BINS)), return_counts=True)
                    yield pd.DataFrame({"bucket": cells >> 32, "bin": (cells & 0xFFFFFFFF) - 41 * BINS, "c": c})

        got = deleted.mapInPandas(table, "bucket long, bin long, c long").groupBy("bucket", "bin").agg(F.sum("c").alias("c")).toPandas()
        ratio = np.where(got["bin"] > -41 * BINS, 2.0 ** (got["bin"] / BINS), 0.0)
        weights.append(filled([learn_weights(ratio[got["bucket"] == b], got["c"].to_numpy()[got["bucket"] == b]) for b in range(LEVELS)]))
    if not n:  # nothing to mix in
        weights = [np.zeros(LEVELS)] * order

    def scored(arrays: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        lengths, c = arrays[3], arrays[4]
        first = np.cumsum(lengths) - lengths
        p = _mixed(_estimates(arrays, order, (v, n, n_deleted, size[1]), False), weights, v)
        yield pd.DataFrame(
            {
                "doc_id": pd.Series(arrays[0]).astype("Int64").mask(arrays[1] == 1),
                "held_out": arrays[2] == HELD,
                "n_tokens": lengths,
                "n_known": np.add.reduceat((c > 0).astype(np.int64), first),
                "train_tokens": n,
                "base_score": np.add.reduceat(np.log10((c + 1) / (n + v + 1)), first),
                "score": np.add.reduceat(np.log10(p), first),
            }
        )

    return _met(chunks, answers, buckets, order, bits, scored, SCORES)
