"""Language identification by bit-sliced Bloom filters over character n-grams.

All languages share one table of slots; a slot is a mask with a bit a language, in as many 64-bit words as the languages need. Adding an n-gram for a language sets its bit in
the n-gram's slots; a lookup is the AND of those slots, so it gives all languages that hold the n-gram at once. Each language's share
of n-grams found is corrected for the rate at which its filter says yes to anything; the largest share decides.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orecart.llm.common import Scratch, fold, per_worker

GRAMS = (2, 3, 4)
#: Rows of each language that are learned from (None: all; else an expected number, drawn by a hash of id and text), n-grams kept for each language,
#: and how frequent an n-gram must be in a language, as a share of its largest frequency in any, to be in the language's filter.
SAMPLE_ROWS, KEEP, SHARE, LEAST = None, 40_000, 0.4, 3
SLOTS, HASHES = 1 << 20, 3
MEMO = 300_000
#: Different words that a task counts before it hands on their n-grams.
COUNTED = 500_000
#: One drawn row in HELD_BACK is not learned from, in languages with LEAST_ROWS rows or more. A text is accepted whose share, with SLACK
#: standard errors in its favour, reaches FLOOR times the median share of such rows in the language it is given.
HELD_BACK, LEAST_ROWS, FLOOR, SLACK = 8, 64, 0.5, 2.0


def letters_only(word: str) -> str:
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def grams(word: str) -> list[str]:
    """n-grams of a word's letters between marks of its start and end."""
    w = f"^{letters_only(word)}$"
    return [w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)] if len(w) > 2 else []


def slots(gram: str) -> list[int]:
    import xxhash

    h = xxhash.xxh3_64_intdigest(gram.encode("utf-8", "replace"))
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % SLOTS for i in range(HASHES)]


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray  # of uint64 masks, a row for each 64 languages
    false: np.ndarray  # a language's chance to hold an n-gram that was not added


def build(counts: pd.DataFrame, keep: int = KEEP, languages: list[str] | None = None) -> Filters:
    """Filters from (lang, gram, n) of the n-grams to take, languages by name; each language's `keep` most frequent n-grams, ties by n-gram."""
    languages = sorted(set(counts["lang"])) if languages is None else languages
    table = np.zeros((-(-len(languages) // 64), SLOTS), np.uint64)
    for bit, lang in enumerate(languages):
        own = counts[counts["lang"] == lang].sort_values(["n", "gram"], ascending=[False, True]).head(keep)
        at = np.array([s for g in own["gram"] for s in slots(g)], np.int64)
        table[bit // 64, at] |= np.uint64(1) << np.uint64(bit % 64)
    share = np.array([((table[b // 64] >> np.uint64(b % 64)) & np.uint64(1)).mean() for b in range(len(languages))])
    return Filters(languages, table, share**HASHES)


class GramMasks(dict):
    """n-gram -> 1 and, in fields of 32 bits after that, 1 for each language that holds it."""

    def __init__(self, model: Filters) -> None:
        self.table = model.table.tolist()

    def __missing__(self, gram: str) -> int:
        if len(self) > MEMO:
            self.clear()
        a, b, c = slots(gram)
        mask, out = 0, 1
        for k, words in enumerate(self.table):
            mask |= (words[a] & words[b] & words[c]) << 64 * k
        while mask:
            low = mask & -mask
            out |= 1 << 32 * low.bit_length()
            mask ^= low
        self[gram] = out
        return out


class WordCounts(dict):
    """Word -> its number of n-grams and, in fields of 32 bits after that, how many of them each language holds."""

    def __init__(self, model: Filters) -> None:
        self.masks = GramMasks(model)

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        out = self[word] = sum(map(self.masks.__getitem__, grams(word)))
        return out


def judge(text: str | None, words: WordCounts, model: Filters) -> tuple[str, float, int]:
    """Language, score and number of n-grams of a text: `und` and 0 without letters; ties go to the language first by name."""
    total = sum(map(words.__getitem__, text.split())) if text else 0
    n = total & 0xFFFFFFFF
    if not n:
        return ("und", 0.0, n)
    if not model.languages:
        return ("und", 0.0, n)
    held = np.array([total >> 32 * (k + 1) & 0xFFFFFFFF for k in range(len(model.languages))])
    share = np.clip((held / n - model.false) / (1 - model.false), 0, 1)
    best = int(share.argmax())
    return model.languages[best], float(share[best]), n


def decide(text: str | None, words: WordCounts, model: Filters) -> tuple[str, float]:
    """Language and score of a text."""
    return judge(text, words, model)[:2]


def _drawn(docs: DataFrame, folds: int, held: int, sample_rows: int | None) -> DataFrame | None:
    """text, lang and held_back of drawn training rows: fold other than `held`, lang not null; None if there are no such rows."""
    train = docs.select(F.col("doc_id"), "text", "lang").filter((fold("doc_id", folds) != held) & F.col("lang").isNotNull())
    # copies of a text are rows of their own: by their ids or, without one, by where they stand in the table
    train = train.withColumn("row", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    at = lambda name, n: F.pmod(F.xxhash64("doc_id", "row", "text", F.lit(name)), F.lit(n))
    train = train.withColumn("dice", at("lang sample", 1 << 30))
    # the least dice of each of 64 parts of a language: so many of them are drawn whatever the rate
    parts: dict[str, list] = {}
    for r in train.groupBy("lang", at("part", LEAST_ROWS).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("dice").alias("least")).collect():
        parts.setdefault(r["lang"], []).append((r["least"], r["n"]))
    if not parts:
        return None
    below, lowest, large = [], [], []
    for lang, own in sorted(parts.items()):
        n, least = sum(n for _, n in own), sorted(d for d, _ in own)
        sample = n if sample_rows is None else sample_rows * HELD_BACK / (HELD_BACK - 1) if n >= LEAST_ROWS else sample_rows
        below += [F.lit(lang), F.lit(int(max(min(1.0, sample / n) * (1 << 30), least[min(len(least), LEAST_ROWS // 2) - 1] + 1)))]
        lowest += [F.lit(lang), F.lit(least[0])]
        large += [lang] if n >= LEAST_ROWS else []
    drawn = train.filter(F.col("dice") < F.create_map(*below)[F.col("lang")])
    back = F.col("lang").isin(large) & (at("held back", HELD_BACK) == 0) & (F.col("dice") != F.create_map(*lowest)[F.col("lang")])
    return drawn.select("text", "lang", back.alias("held_back"))


def fit(docs: DataFrame, folds: int = 4, held: int = 2, sample_rows: int | None = SAMPLE_ROWS, keep: int = KEEP) -> Filters:
    """Filters from training rows of (doc_id, text, lang): fold other than `held`, lang not null. Null and empty texts teach nothing.

    All rows that are not held back are counted. With `sample_rows` each language gives about as many, drawn by a hash of id and text at a
    rate from an exact count, and half of LEAST_ROWS at least where it has as many different rows. n-grams are counted per task first, then summed
    by n-gram; only those that may enter a filter come to the driver, and `keep` bounds a filter's size: rarer ones say little, and a larger
    bound takes all. Rows that are held back serve `floors`. Other columns are ignored, whatever their names.
    """
    drawn = _drawn(docs, folds, held, sample_rows)
    if drawn is None:
        return Filters([], np.zeros((0, SLOTS), np.uint64), np.zeros(0))
    drawn = drawn.filter("not held_back").select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        words: dict[str, Counter] = {}

        def handed_on() -> Iterator[pd.DataFrame]:
            for lang, own in words.items():
                found: Counter = Counter()
                for w, n in own.items():
                    for g in grams(w):
                        found[g] += n
                yield pd.DataFrame({"lang": lang, "gram": list(found), "n": list(found.values())})
            words.clear()

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if text:
                    words.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, words.values())) > COUNTED:
                yield from handed_on()
        yield from handed_on()

    summed = drawn.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # what is too rare, in itself or beside another language, is left out before it comes to the driver
    summed = Scratch(docs.sparkSession, "langid").write(summed.filter(F.col("n") >= LEAST), "grams")
    sizes = {r["lang"]: r["n"] for r in summed.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return build(pd.DataFrame({"lang": [], "gram": [], "n": []}), keep)
    freq = F.col("n") / F.create_map(*[F.lit(x) for pair in sorted(sizes.items()) for x in (pair[0], float(pair[1]))])[F.col("lang")]
    top = F.max("freq").over(Window.partitionBy("gram"))
    kept = summed.withColumn("freq", freq).withColumn("top", top).filter(F.col("freq") >= SHARE * F.col("top"))
    return build(kept.select("lang", "gram", "n", "freq").toPandas(), keep, sorted(sizes))


def predict(docs: DataFrame, model: Filters, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of (doc_id, text).

    A null or empty text, or one without a letter, is `und` with score 0, as is every text if nothing was learned. A text with letters but
    without a known n-gram gets the language first by name, with score 0, as ties do. Texts of any length are read whole. Rows are
    independent: repeated rows and null ids get their own results, and an empty table gives none. The filters sent out have a fixed size
    for each 64 languages. Other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.false))
    key = ("langid", uuid.uuid4().hex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = per_worker(key, lambda: WordCounts(Filters(*shared.value)))
        model = Filters(*shared.value)
        for batch in batches:
            got = [decide(t, words, model) for t in batch.pop("text")]
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            batch["lang_pred"], batch["score"] = [x[0] for x in got], [x[1] for x in got]
            yield batch

    return docs.select(F.col("doc_id").cast("long"), (fold("doc_id", folds) == held).alias("held_out"), "text").mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def floors(docs: DataFrame, model: Filters, folds: int = 4, held: int = 2, sample_rows: int | None = SAMPLE_ROWS) -> dict[str, float]:
    """The share that a text of each language must reach, from training rows that `fit` with the same arguments held back.

    A language without such rows takes the least floor of the others.
    """
    drawn = _drawn(docs, folds, held, sample_rows)
    if drawn is None or not model.languages:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.false))
    key = ("langid", uuid.uuid4().hex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = per_worker(key, lambda: WordCounts(Filters(*shared.value)))
        model = Filters(*shared.value)
        for batch in batches:
            got = [judge(t, words, model) for t in batch["text"]]
            own = [n > 0 and lang == true for (lang, _, n), true in zip(got, batch["lang"], strict=True)]
            yield pd.DataFrame({"lang": batch["lang"], "score": [g[1] for g in got]})[own]

    scores = drawn.filter("held_back").select("text", "lang").mapInPandas(run, "lang string, score double")
    found = {r["lang"]: FLOOR * r["m"] for r in scores.groupBy("lang").agg(F.percentile_approx("score", 0.5).alias("m")).collect()}
    return {lang: found.get(lang, min(found.values(), default=0.0)) for lang in model.languages}


def accepted(docs: DataFrame, model: Filters, least: dict[str, float] | None = None) -> DataFrame:
    """The rows of `docs`, unchanged, whose text has a language: letters, n-grams that it holds, and as many as `least` asks for.

    Null and empty texts, and those without a known n-gram, go. Rows are judged one by one, repeated ones alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.false))
    key = ("langid", uuid.uuid4().hex)

    def is_kept(lang: str, score: float, n: int) -> bool:
        floor = (least or {}).get(lang, 0.0)
        return score > 0 and score >= floor - SLACK * (floor * (1 - floor) / n) ** 0.5

    @F.pandas_udf("boolean")
    def has_language(texts: pd.Series) -> pd.Series:
        words = per_worker(key, lambda: WordCounts(Filters(*shared.value)))
        model = Filters(*shared.value)
        return pd.Series([is_kept(*judge(t, words, model)) for t in texts], dtype=bool)

    return docs.filter(has_language("text"))
