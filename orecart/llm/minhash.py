"""Near-duplicate documents by HyperMinHash sketches over word shingles.

A sketch has one register for each bucket of shingle hashes: the count of leading zeros of the bucket's least hash and the mantissa
bits after them, so 14 bits stand for 57 (Yu and Weber, 2017). Empty buckets take the register of another bucket, found by a probe order
that is fixed for each bucket, so small sets have full sketches (as in optimal densification, Shrivastava 2017). Bands of
registers propose pairs; the share of equal registers, less what chance equality accounts for, estimates Jaccard similarity; pairs that pass
are confirmed on whole shingle sets.

Documents with equal sets are one class. Each class of a band's bucket is first compared with the bucket's least class, so a bucket of
true copies costs as many comparisons as it has members. Buckets whose classes are then in one component are finished. In the others
classes of different components are compared in blocks of bounded size. A block first looks at sketches and names the classes that
have a likely partner there; then the sets of these meet in the same block, which intersects all of them at once and answers with links
that join components, fewer than it has classes. So whatever a group looks like, no table of pairs is made. No pair that shares a
bucket is left out unless its classes are already in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orecart.llm.common import Scratch, connected_components, lowered_words, per_worker, streamed

BUCKET_BITS, MANTISSA, BANDS, ROWS = 9, 8, 20, 4
BUCKETS = 1 << BUCKET_BITS
MEMO = 400_000
#: Classes, and shingles, in a block when the members of a bucket that stayed apart are compared; tasks that may share a pivot's classes.
BLOCK, BLOCK_SHINGLES, SALTS = 256, 1 << 20, 256
#: Shingles whose columns are multiplied at a time.
STRIP = 2048
#: Registers that are compared first; only pairs that these leave likely are estimated from all.
FIRST = 128
#: Standard errors of the estimate that a pair may fall short of the threshold by and still be confirmed on whole sets.
SLACK = 5.0
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters (murmur's finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * M1
    x = x ^ (x >> np.uint64(33))
    x = x * M2
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(data: bytes | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; with fewer words than `size` the whole sequence is the only one."""
    split = lowered_words(data)
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    n = min(size, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total = mix(total ^ h[i : len(h) - n + 1 + i])
    return np.unique(total)


#: For each bucket the order in which it looks at others when it is empty.
PROBES = np.array([np.random.default_rng([1729, k]).permutation(BUCKETS) for k in range(BUCKETS)])


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set: leading zeros (6 bits) and MANTISSA bits of each bucket's least hash."""
    h = mix(shingles ^ np.uint64(0x9E3779B97F4A7C15))
    bucket, rest = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), h << np.uint64(BUCKET_BITS)
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bucket, rest)
    full = np.zeros(BUCKETS, bool)
    full[bucket] = True
    if not full.all():
        order = PROBES[~full]
        least[~full] = least[order[np.arange(len(order)), full[order].argmax(1)]]
    least |= np.uint64(1)
    # frexp gives the exponent exactly only up to 53 bits, so the upper half is tested first
    high = (least >> np.uint64(32)).astype(np.float64)
    low = (least & np.uint64(0xFFFFFFFF)).astype(np.float64)
    zeros = np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1]).astype(np.uint64)
    after = (least << zeros) << np.uint64(1) >> np.uint64(64 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | after).astype(np.uint16)


def chance_equal(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of unrelated sets of n and m shingles are equal.

    A bucket of k hashes has its least in [a, b) with probability (1-a)^k - (1-b)^k; registers split (0, 1) into binades of
    2^MANTISSA equal parts. Buckets of sets with fewer shingles than buckets stand for one shingle each.
    """
    zeros = np.arange(0, 40)[:, None]
    a = 2.0 ** -(zeros + 1)
    mid = a * (1.5)
    width = a / 2**MANTISSA
    out = np.zeros(np.broadcast(n, m).shape)
    k, j = np.maximum(np.asarray(n, float) / BUCKETS, 1), np.maximum(np.asarray(m, float) / BUCKETS, 1)
    density = lambda c: c * np.exp((c - 1) * np.log1p(-mid))
    out = (density(k) * density(j) * width**2 * 2**MANTISSA).sum(0)
    return np.minimum(out, 0.5)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from rows of registers: equal share, less chance equality."""
    chance = chance_equal(n, m)
    return ((a == b).mean(1) - chance) / (1 - chance)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Keys of the bands, rows x BANDS, of rows of registers; a key differs from those of other bands."""
    groups = regs[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    keys, band = np.zeros((len(regs), BANDS), np.uint64), np.arange(BANDS, dtype=np.uint64) << np.uint64(32)
    for i in range(ROWS):
        keys = mix(keys ^ groups[:, :, i] ^ band)
    return keys


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, md5 of the text, n_shingles, the set's digest (two longs), registers and band keys; the last three null for empty sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = per_worker(("shingles",), WordHashes)
        for batch in batches:
            rows = []
            for data in batch["data"]:
                s = shingle_set(data, size, words)
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                regs = sketch(s)
                with np.errstate(over="ignore"):
                    rows.append((len(s), int(s.sum(dtype=np.uint64).astype(np.int64)), int(mix(s).sum(dtype=np.uint64).astype(np.int64)), regs.tobytes(), band_keys(regs[None])[0].astype(np.int64)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            out = pd.DataFrame({"n_shingles": columns[0], "regs": columns[3], "bands": columns[4]})
            out["d1"], out["d2"] = (pd.array(c, dtype="Int64") for c in columns[1:3])  # never through floats, whatever nulls there are
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64"))
            out.insert(1, "md5", batch["md5"])
            yield out[["doc_id", "md5", "n_shingles", "d1", "d2", "regs", "bands"]]

    data = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long"), F.md5(data).alias("md5"), data.alias("data")).mapInPandas(
        run, "doc_id long, md5 string, n_shingles long, d1 long, d2 long, regs binary, bands array<long>"
    )


def likely_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the estimates of rows of registers come within SLACK standard errors of the threshold."""
    a, b = np.broadcast_arrays(a, b)
    n, m = np.broadcast_arrays(n, m)
    ok = np.ones(len(a), bool)
    for count in (FIRST, BUCKETS):
        at = np.flatnonzero(ok)
        if len(at):
            ok[at] = estimate(a[at, :count], b[at, :count], n[at], m[at]) >= threshold - SLACK * np.sqrt(threshold * (1 - threshold) / count)
    return ok


def _likely(pairs: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                a_regs, b_regs = (np.frombuffer(b"".join(b[c]), np.uint16).reshape(len(b), -1) for c in ("a_regs", "b_regs"))
                yield b.loc[likely_pairs(a_regs, b_regs, b["a_n"].to_numpy(), b["b_n"].to_numpy(), threshold), ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def _components(docs: DataFrame, size: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, md5, n_shingles, d1, d2), and of every class of equal sets (n_shingles, d1, d2, doc, component): its least id and
    a number that the classes which links reach share."""
    all_ = scratch.write(sketches(docs, size), "sketches")
    named = all_.filter("n_shingles > 0 and doc_id is not null")
    # classes of equal sets, by a digest of 128 bits and the size; equal sets have equal sketches, so any row gives them. They are numbered
    # once, when they are written: one id may have several texts
    one = named.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("doc"), F.first("regs").alias("regs"), F.first("bands").alias("bands"))
    classes = scratch.write(one.select(F.monotonically_increasing_id().alias("cid"), "doc", F.col("n_shingles").alias("n"), "d1", "d2", "regs", "bands"), "classes")
    all_ = scratch.write(all_.drop("regs", "bands"), "rows")
    scratch.drop("sketches")
    exploded = classes.select("cid", "n", F.posexplode("bands").alias("band", "bucket"))
    first = exploded.groupBy("bucket").agg(F.min(F.struct("cid", "n")).alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    active = scratch.write(exploded.join(first, "bucket").select("band", "bucket", "cid", "n", F.col("p.cid").alias("p_cid"), F.col("p.n").alias("p_n")), "active")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("data"))
    digests, ratio = classes.select("cid", "doc", "n", "d1"), percent / 100

    star = active.filter((F.col("cid") != F.col("p_cid")) & (100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n")))
    star = star.select(F.col("p_cid").alias("a"), F.col("cid").alias("b")).distinct()
    a, b = (classes.select(F.col("cid").alias(c), F.col("n").alias(f"{c}_n"), F.col("regs").alias(f"{c}_regs")) for c in ("a", "b"))
    likely = scratch.write(_likely(star.join(a, "a").join(b, "b"), ratio), "likely")
    wanted = likely.select(F.col("a").alias("cid")).unionByName(likely.select(F.col("b").alias("cid"))).distinct()
    wanted = scratch.write(wanted.join(digests, "cid"), "wanted-star")
    sets = scratch.write(_sets(wanted, texts, size), "sets-star")
    links = scratch.write(_confirmed(likely, sets, percent), "links-star")
    parts = scratch.write(connected_components(links, scratch, "star"), "parts-star").select(F.col("node").alias("cid"), F.col("component").alias("part"))

    now = active.select("band", "bucket", "cid", "p_cid", "n").join(parts, "cid", "left").withColumn("part", F.coalesce("part", "cid"))
    spread = now.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    open_ = spread.filter("lo < hi and members > 2").select("bucket", blocks.alias("blocks"))
    apart = now.join(open_, "bucket").filter("cid <> p_cid").join(classes.select("cid", "regs"), "cid")
    flagged = scratch.write(_flagged(apart, ratio, percent), "flagged")
    wanted = flagged.select("cid").distinct().join(sets.select("cid"), "cid", "left_anti")
    wanted = scratch.write(wanted.join(digests, "cid"), "wanted-apart")
    sets = sets.unionByName(scratch.write(_sets(wanted, texts, size), "sets-apart"))
    joins = scratch.write(_joins(flagged, sets, percent), "links-apart")
    whole = scratch.write(connected_components(joins, scratch, "apart"), "parts-apart").select(F.col("node").alias("part"), F.col("component").alias("joined"))
    for name in ("active", "likely", "wanted-star", "sets-star", "flagged", "wanted-apart", "sets-apart"):
        scratch.drop(name)
    at = classes.select("cid", "doc", F.col("n").alias("n_shingles"), "d1", "d2").join(parts, "cid", "left").withColumn("part", F.coalesce("part", "cid"))
    return all_, at.join(whole, "part", "left").select("n_shingles", "d1", "d2", "doc", F.coalesce("joined", "part").alias("component"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of (doc_id, text).

    Documents are linked where 100 * intersection >= percent * union of their shingle sets; component_id is the least doc_id that links
    reach, kept marks it. Texts that are null, empty or only white space have no shingles and no links. Repeated rows have equal
    results; a row with a null doc_id has n_shingles and nulls. An id with several texts has a result for each. An empty table gives no
    rows. Other columns are ignored, whatever their names. Whole texts are used, of any length.
    """
    all_, classes = _components(docs, size, percent, scratch or Scratch(docs.sparkSession, "minhash"))
    least = classes.groupBy("component").agg(F.min("doc").alias("class_component"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    by_class = classes.join(least, "component", "left").select("n_shingles", "d1", "d2", F.coalesce("class_component", "doc").alias("class_component"))
    out = all_.select("doc_id", "n_shingles", "d1", "d2").join(by_class, ["n_shingles", "d1", "d2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """The rows of `docs`, unchanged, without near-duplicates: of each group the row of least (doc_id, md5 of the text).

    Repeated rows of an id and text count as one, which stays where its group keeps it; an id with several texts is a row for each. Texts
    without shingles and rows with a null id have no group and stay.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    all_, classes = _components(docs, size, percent, scratch)
    rows = all_.filter("doc_id is not null").join(classes.drop("doc"), ["n_shingles", "d1", "d2"], "left").groupBy("doc_id", F.coalesce("md5", F.lit("")).alias("md5")).agg(F.first("component").alias("component"), F.count(F.lit(1)).alias("times"))
    first = rows.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "md5")).alias("f")).select("component", "f.*").withColumn("first", F.lit(True))
    gone = F.col("component").isNotNull() & F.col("first").isNull()
    # narrow rows: an id that has one text needs no digest. The texts are read once more and move at most once
    texts_of = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    marked = rows.withColumn("several_texts", texts_of > 1).join(first, ["component", "doc_id", "md5"], "left").filter(gone | (F.col("times") > 1))
    marks = scratch.write(marked.select(F.col("doc_id").alias("_id"), F.when(F.col("several_texts"), F.col("md5")).alias("_md5"), gone.alias("_gone")), "marks")
    same = F.col("_md5").isNull() | (F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")) == F.col("_md5"))
    met = (F.col("doc_id").cast("long") == F.col("_id")) & same
    # marks grow with the corpus, so both sides move, at any size
    out, several = docs.join(marks.hint("merge"), met, "left_anti"), marks.filter("not _gone")
    if several.limit(1).count():
        out = out.unionByName(docs.join(several.hint("merge"), met).dropDuplicates(["_id", "_md5"]).select(*[docs[c] for c in docs.columns]))
    return out


def _sets(wanted: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Whole shingle sets, as sorted hashes, of the wanted classes (cid, doc, n, d1), from the texts of their least ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = per_worker(("shingles",), WordHashes)
        for b in batches:
            rows = []
            for cid, n, d1, data in zip(b["cid"], b["n"], b["d1"], b["data"], strict=True):
                s = shingle_set(data, size, words)
                if len(s) == n and int(s.sum(dtype=np.uint64).astype(np.int64)) == d1:  # not another text of the same id
                    rows.append((cid, s.tobytes()))
            yield pd.DataFrame(rows, columns=["cid", "shingles"])

    # as many as there are copies in the corpus, so never sent to every task: both sides move, at any size
    return texts.join(wanted.hint("merge"), "doc").dropDuplicates(["cid", "data"]).mapInPandas(run, "cid long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), as (src, dst), that whole sets confirm. A pivot's pairs are dealt to SALTS tasks, each of which holds no set but the
    pivot's, however many classes meet it."""
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt")
    members = pairs.select("a", salt, "b").join(sets.withColumnRenamed("cid", "b"), "b").select("a", "salt", "b", "shingles")
    pivots = pairs.select("a", salt).distinct().join(sets.withColumnRenamed("cid", "a"), "a").select("a", "salt", F.lit(-1).cast("long").alias("b"), "shingles")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivot = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, b, data in zip(batch["a"], batch["b"], batch["shingles"], strict=True):
                own = np.frombuffer(data, np.uint64)
                if b < 0:  # comes first
                    pivot = own
                    continue
                same = len(np.intersect1d(pivot, own, assume_unique=True))
                if 100 * same >= percent * (len(pivot) + len(own) - same):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["src", "dst"]).astype("int64")

    return members.unionByName(pivots).repartition("a", "salt").sortWithinPartitions("a", "salt", "b").mapInPandas(run, "src long, dst long")


def _flagged(members: DataFrame, threshold: float, percent: int) -> DataFrame:
    """(bucket, i, j, cid, part, own): the members of a bucket dealt to the pairs (i, j) of its blocks, i <= j, that there have a likely
    partner in another component with which they share no earlier band."""
    dealt = members.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "part", "n", "regs")
    key = ["bucket", "i", "j"]

    def compare(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out = []
        for (_, i, j), own in rows.groupby(key, sort=False):
            if len(own) < 2:
                continue
            regs = np.frombuffer(b"".join(own["regs"]), np.uint16).reshape(len(own), -1)
            keys, n, part, side, band = band_keys(regs), own["n"].to_numpy(), own["part"].to_numpy(), own["own"].to_numpy(), int(own["band"].iloc[0])
            second, hit = np.flatnonzero(side == j), np.zeros(len(own), bool)
            for x in np.flatnonzero(side == i):
                y = second[second > x] if i == j else second
                y = y[(part[y] != part[x]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))]
                y = y[~(keys[x, :band] == keys[y, :band]).any(1)]
                if len(y):
                    y = y[likely_pairs(regs[x][None], regs[y], n[x], n[y], threshold)]
                    hit[y] = True
                    hit[x] |= len(y) > 0
            if hit.any():
                out.append(own.loc[hit, [*key, "cid", "part", "own"]])
        if out:
            yield pd.concat(out)

    dealt = dealt.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInPandas(streamed(key, compare), "bucket long, i int, j int, cid long, part long, own int")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right, as products of their columns of common shingles."""
    a, b = np.concatenate(left), np.concatenate(right)
    common, out = np.intersect1d(a, b), np.zeros((len(left), len(right)), np.float32)

    def cells(values: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(common, values)
        at = np.minimum(at, len(common) - 1)
        held = common[at] == values
        order = np.argsort(at[held], kind="stable")
        return owner[held][order], at[held][order], np.searchsorted(at[held][order], np.arange(0, len(common) + STRIP, STRIP))

    if len(common):
        (x, c, p), (y, d, q) = cells(a, left), cells(b, right)
        for k, start in enumerate(range(0, len(common), STRIP)):
            u, v = (np.zeros((len(sets), STRIP), np.float32) for sets in (left, right))
            u[x[p[k] : p[k + 1]], c[p[k] : p[k + 1]] - start] = 1
            v[y[q[k] : q[k + 1]], d[q[k] : q[k + 1]] - start] = 1
            out += u @ v.T
    return out.astype(np.int64)


def spanning(pairs: np.ndarray) -> np.ndarray:
    """Those of the pairs (rows of two nodes), in order, that join what earlier ones left apart."""
    above: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := above.get(v, v)) != v:
            above[v] = v = above.get(up, up)
        return v

    out = []
    for a, b in pairs.tolist():
        a, b = root(a), root(b)
        if a != b:
            above[b] = a
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _joins(flagged: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst): components that confirmed pairs join, from each block no more than make a forest of its components."""
    key = ["bucket", "i", "j"]

    def compare(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for (_, i, j), own in rows.groupby(key, sort=False):
            held, side, part = [np.frombuffer(s, np.uint64) for s in own["shingles"]], own["own"].to_numpy(), own["part"].to_numpy()
            first, second = np.flatnonzero(side == i), np.flatnonzero(side == j)
            if not len(first) or not len(second):
                continue
            same, n = overlaps([held[k] for k in first], [held[k] for k in second]), np.array([len(s) for s in held])
            ok = (100 * same >= percent * (n[first][:, None] + n[second][None] - same)) & (part[first][:, None] != part[second][None])
            x, y = np.nonzero(np.triu(ok) if i == j else ok)
            if len(x):
                yield pd.DataFrame(spanning(np.unique(np.sort(np.stack([part[first][x], part[second][y]], 1), 1), axis=0)), columns=["src", "dst"])

    dealt = flagged.join(sets, "cid").repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInPandas(streamed(key, compare), "src long, dst long")
