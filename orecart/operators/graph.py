"""What operators on pairs and graphs share: runs of keys in a task, rows dealt to pairs of blocks, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orecart.sources.scratch import Scratch


def streamed(key: list[str], each) -> object:
    """A mapInPandas function over rows sorted by `key`: `each` gets whole runs of keys, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            b = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if b.empty:
                continue
            same = np.ones(len(b), bool)
            for c in key:
                same &= (b[c] == b[c].iloc[-1]).to_numpy()
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield from each(b.iloc[:cut].reset_index(drop=True))
            held = b.iloc[cut:]
        if held is not None and len(held):
            yield from each(held.reset_index(drop=True))

    return run


def dealt(rows: DataFrame, id_: str, blocks: Column, key: list[str]) -> DataFrame:
    """Rows with the block `own` that their id falls into, once for each pair (i, j) of blocks, i <= j, that holds it; tasks get whole pairs."""
    out = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64(id_), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = out.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")
    return out.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")


#: Pairs of rows that a task expands before it drops repeated ones.
PAIRS = 1 << 24


def packed(ids: np.ndarray) -> bytes:
    """Rising ids as one value: the size of a step, the first id, and the steps in as many bytes as the largest needs."""
    steps = np.diff(ids)
    width = next(w for w in (1, 2, 4, 8) if not len(steps) or w == 8 or int(steps.max()) < 1 << 8 * w)
    return bytes([width]) + ids[:1].astype("<i8").tobytes() + steps.astype(f"<u{width}").tobytes()


def unpacked(blobs: list[bytes]) -> np.ndarray:
    """The rising ids of several packed values, each once."""
    found = []
    for b in blobs:
        steps = np.frombuffer(b, f"<u{b[0]}", offset=9).astype(np.int64)
        found.append(np.cumsum(np.concatenate([np.frombuffer(b, "<i8", 1, 1), steps])))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def co_members(rows: DataFrame, group: str, member: str) -> DataFrame:
    """(k, met) of each member (a whole number) that shares a group with others: those others, as packed values that `unpacked` joins.

    Exact. The pairs of a group are expanded in a task, a bounded number at a time, and repeated ones dropped there; what is shuffled is
    one packed value for a member and such a run, so groups that are near each other and share members cost little more than the result.
    """
    both = rows.select(F.col(group).cast("long").alias("g"), F.col(member).cast("long").alias("k")).filter("g is not null and k is not null")

    def expanded(k: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
        """`k` lists the groups, one after the other, of so many members each."""
        ids, code = np.unique(k, return_inverse=True)
        ends, n = np.cumsum(sizes), len(ids)
        seen = np.zeros(n * n, bool) if n * n <= 4 * PAIRS else None
        parts, reps = [], np.repeat(sizes, sizes)  # the size of the group of each row
        begin = np.repeat(ends - sizes, sizes)
        at = np.concatenate([[0], np.cumsum(reps)])
        lo = 0
        while lo < len(k):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PAIRS // 4, "right")) - 1)
            own = reps[lo:hi]
            other = np.arange(at[hi] - at[lo]) - np.repeat(at[lo:hi] - at[lo] - begin[lo:hi], own)
            pairs = np.repeat(code[lo:hi] * n, own) + code[other]
            if seen is not None:
                seen[pairs] = True
            else:
                parts.append(np.unique(pairs))
            lo = hi
        pairs = np.flatnonzero(seen) if seen is not None else np.unique(np.concatenate(parts))
        a, b = pairs // n, pairs % n
        a, b = a[a != b], b[a != b]
        cuts = np.flatnonzero(np.diff(a)) + 1
        first = np.concatenate([[0], cuts]) if len(a) else np.zeros(0, np.int64)
        return pd.DataFrame({"k": ids[a[first]], "met": [packed(x) for x in np.split(ids[b], cuts)] if len(a) else []})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting = [], 0

        def each(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal held, waiting
            b = b.drop_duplicates()
            sizes = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(b["g"].to_numpy())) + 1, [len(b)]]))
            held.append((b["k"].to_numpy(), sizes))
            waiting += int((sizes * sizes).sum())
            if waiting >= PAIRS:
                yield expanded(*map(np.concatenate, zip(*held, strict=True)))
                held, waiting = [], 0

        yield from streamed(["g"], each)(batches)
        if held:
            yield expanded(*map(np.concatenate, zip(*held, strict=True)))

    # as many tasks as shuffles have: packed values are small beside the work on them
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartitionByRange(n, "g").sortWithinPartitions("g").mapInPandas(run, "k long, met binary")
    return found.repartition(n, "k").groupBy("k").agg(F.collect_list("met").alias("met"))


def connected_components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 40) -> DataFrame:
    """(node, component) of every node of an edge list (src, dst); component is the least node that is reachable.

    Alternating large-star and small-star (Kiveris et al., 2014). Each round is one grouped minimum (combined before the
    shuffle) and one join on the node, which Spark can split when a node is a hub. Rounds grow with the logarithm of the longest
    path. Tables of links only; nothing is collected.
    """
    now = scratch.write(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct(),
        f"{name}-0",
    )
    signature = None
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            # a node that has smaller neighbours keeps its own link to the least of them
            least.filter("m < u").select("u", F.col("m").alias("v"))
        ).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        now = scratch.write(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        said = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(said) == signature:
            break
        signature = tuple(said)
    else:
        raise RuntimeError("components did not settle; raise rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
