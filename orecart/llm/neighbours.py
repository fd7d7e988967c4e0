"""Near-duplicate vectors by an exact join within labels.

Large labels are split into the cells of pivots, which are rows drawn by hash: a row is at home in the cell of its nearest pivot. Of two
linked rows at home in different cells each lies within the link's length of the plane between the two pivots, so a row visits just the
cells that it lies so near to, one of each two cells being the visitor. Cells are compared in blocks of bounded size, home rows with home
rows and with visitors, so each pair that may be linked is compared once, in double precision where single precision leaves it open.
A block emits what it adds to each row's links and a spanning forest of its links, not the links themselves.

Pivots prune only where rows form groups; without groups all pairs of a label are compared. Equal vectors are one class with a
multiplicity. Vectors meet only within their label and dimension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orecart.llm.common import Scratch, connected_components, streamed

#: Rows a pivot is drawn for, and pivots in all. Both steer the cost only.
CELL, PIVOTS = 8192, 2048
#: Blocks a cell is cut into, rows a block has at least, and components of vectors it holds at most.
BLOCKS, LEAST, VALUES = 8, 256, 1 << 18
#: Rows compared at a time with a block, and pairs at a time in double precision.
STRIP, PAIRS = 512, 50_000


def _packed(w: np.ndarray) -> bytes:
    """A vector's components, in single precision where that is exact."""
    w = np.asarray(w, float)
    with np.errstate(over="ignore", under="ignore"):
        short = w.astype(np.float32)
    return short.tobytes() if (short == w).all() else w.tobytes()


def _units(column: pd.Series, size: int) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * size else np.float64) for b in column]).astype(float)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _pivots(vectors: DataFrame, cell: int, pivots: int) -> dict[str, np.ndarray]:
    """Pivots of the labels with two cells or more, in single precision, no two within a small angle of each other."""
    sizes = {r["g"]: r["n"] for r in vectors.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2 * cell).orderBy(F.desc("n"), "g").limit(pivots // 2).collect()}
    if not sizes:
        return {}
    share = min(1 / cell, pivots / sum(sizes.values()))
    dice = F.pmod(F.xxhash64("d", F.lit("pivot")), F.lit(1 << 30)) < int(share * (1 << 30))
    drawn: dict[str, list] = {}
    for r in vectors.filter(dice).select("g", "d", "size", "x").orderBy("d").collect():
        if r["g"] in sizes:
            own, p = drawn.setdefault(r["g"], []), _units(pd.Series([r["x"]]), r["size"])[0]
            if not own or (np.stack(own) @ p).max() < 0.9:
                own.append(p)
    return {g: np.stack(own).astype(np.float32) for g, own in drawn.items() if len(own) > 1}


def _cells(vectors: DataFrame, pivots: dict[str, np.ndarray], threshold: float) -> DataFrame:
    """(g, cell, home, node, mult, size, x): each row where it is at home and where it visits."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, own in batch.groupby("g", sort=False):
                p = shared.value.get(g)
                if p is None:
                    yield own.assign(cell=0, home=True)
                    continue
                apart = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
                for at in range(0, len(own), STRIP):
                    part = own.iloc[at : at + STRIP]
                    near = _units(part["x"], int(part["size"].iloc[0])).astype(np.float32) @ p.T
                    home = near.argmax(1)
                    yield part.assign(cell=home, home=True)
                    # what single precision may be off by is far below 1e-3
                    visits = near.max(1)[:, None] - near <= reach * apart[home] + 1e-3
                    other = np.arange(len(p))[None]
                    visits &= np.where((home[:, None] + other) % 2, home[:, None] < other, home[:, None] > other)
                    row, cell = np.nonzero(visits)
                    yield part.iloc[row].assign(cell=cell, home=False)

    columns = ["g", "cell", "home", "node", "mult", "size", "x"]
    ordered = lambda batches: (b[columns] for b in run(batches))
    return vectors.select("g", "node", "mult", "size", "x").mapInPandas(ordered, "g string, cell int, home boolean, node long, mult long, size int, x binary")


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether cosines of rows of unit vectors reach the threshold, in double precision."""
    a, b = x.astype(np.float32), y.astype(np.float32)
    margin, out = (x.shape[1] + 8) * 2.0**-22, np.zeros((len(x), len(y)), bool)
    for at in range(0, len(a), STRIP):
        sim = a[at : at + STRIP] @ b.T
        out[at : at + STRIP] = sim >= threshold
        i, j = np.nonzero(np.abs(sim - threshold) <= margin)
        for k in range(0, len(i), PAIRS):
            r, c = i[k : k + PAIRS], j[k : k + PAIRS]
            out[at + r, c] = (x[at + r] * y[c]).sum(1) >= threshold
    return out


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a matrix of links the row that stands for its component, -1 without a link."""
    rows, columns = np.full(linked.shape[0], -1), np.full(linked.shape[1], -1)
    for seed in np.flatnonzero(linked.any(1)):
        new = np.array([seed]) if rows[seed] < 0 else np.zeros(0, int)
        while len(new):
            rows[new] = seed
            met = np.flatnonzero(linked[new].any(0) & (columns < 0))
            columns[met] = seed
            new = np.flatnonzero(linked[:, met].any(1) & (rows < 0))
    return rows, columns


def _links(cells: DataFrame, threshold: float) -> DataFrame:
    """(node, root, others): for each block and row with links there, a row that they reach and the multiplicities of its linked classes."""
    visitors = F.sum((~F.col("home")).cast("long"))
    sizes = cells.groupBy("g", "cell").agg(F.sum(F.col("home").cast("long")).alias("own_rows"), visitors.alias("visits"), F.first("size").alias("s"))
    most = F.greatest(F.lit(64), F.floor(F.lit(VALUES) / F.col("s")))
    block = F.least(most, F.greatest(F.lit(LEAST), F.ceil((F.col("own_rows") + F.col("visits")) / BLOCKS)))
    sizes = sizes.select("g", "cell", F.ceil(F.col("own_rows") / block).cast("int").alias("n"), F.ceil(F.col("visits") / block).cast("int").alias("m"))
    at = lambda count: F.pmod(F.xxhash64("node", F.lit("block")), count).cast("int")
    held = cells.join(sizes, ["g", "cell"]).filter("n > 0").withColumn("own", F.when(F.col("home"), at(F.col("n"))).otherwise(F.col("n") + at(F.greatest("m", F.lit(1)))))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("n") + F.col("m")).otherwise(F.col("n")) - 1)))
    key = ["g", "cell", "i", "j"]
    dealt = held.select("g", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "mult", "size", "x")
    dealt = dealt.repartition(*key).sortWithinPartitions(*key)

    def compare(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for (_, _, i, j), own in b.groupby(key, sort=False):
            mult, side, ids = own["mult"].to_numpy(), own["own"].to_numpy(), own["node"].to_numpy()
            first, second = np.flatnonzero(side == i), np.flatnonzero(side == j)
            if not len(first) or not len(second):
                continue
            x = _units(own["x"], int(own["size"].iloc[0]))
            linked = _linked(x[first], x[second], threshold)
            if i == j:
                np.fill_diagonal(linked, False)
            others, back = linked @ mult[second], mult[first] @ linked
            if i == j:
                np.fill_diagonal(linked, others > 0)
            rows, columns = _forest(linked)
            a, c = others > 0, back > 0
            yield pd.DataFrame({"node": ids[first][a], "root": ids[first][rows[a]], "others": others[a]})
            if i != j:
                yield pd.DataFrame({"node": ids[second][c], "root": ids[first][columns[c]], "others": back[c]})

    return dealt.mapInPandas(streamed(key, compare), "node long, root long, others long")


def near_vectors(rows: DataFrame, threshold: float = 0.98, id_: str = "vec_id", label: str = "label", vector: str = "embedding", scratch: Scratch | None = None, cell: int = CELL, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, embedding, label).

    Rows are linked where labels are equal and not null and cosine, in double precision, is at least `threshold`. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, nor do vectors of different dimension, null labels or null ids.
    A repeated row counts as another vector of the same id, linked with the first. Other columns are ignored. `cell` and `pivots` steer
    the cost only.
    """
    scratch = scratch or Scratch(rows.sparkSession, "neighbours")
    # the id only names rows here; labels ride along with it
    numbered = rows.select(F.col(id_).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    usable = numbered.filter("vec_id is not null and label is not null")
    tagged = usable.withColumn("w", F.transform("vector", lambda x: x.cast("double"))).filter(_is_valid("w"))
    tagged = tagged.withColumns({"g": F.concat_ws("/", F.col("label").cast("string"), F.size("w").cast("string")), "d": F.sha2(F.to_json("w"), 256)})
    classes = tagged.groupBy("g", "d").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("mult"), F.first("w").alias("w"))

    def shortened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["size"], b["x"] = b["w"].str.len().astype("int32"), [_packed(w) for w in b.pop("w")]
            yield b

    # classes are numbered once, when they are written: one id may have several vectors
    packed = classes.select("cid", "g", "d", "mult", "w").mapInPandas(shortened, "cid long, g string, d string, mult long, size int, x binary")
    vectors = scratch.write(packed.withColumn("node", F.monotonically_increasing_id()), "vectors")
    links = scratch.write(_links(_cells(vectors, _pivots(vectors, cell, pivots), threshold), threshold), "links")
    parts = scratch.write(connected_components(links.select(F.col("root").alias("src"), F.col("node").alias("dst")), scratch, "parts"), "parts")
    found = links.groupBy("node").agg(F.sum("others").alias("others")).join(parts, "node")
    least = found.join(vectors.select("node", "cid"), "node").groupBy("component").agg(F.min("cid").alias("least"))
    by_class = vectors.select("g", "d", "cid", "mult", "node").join(found.join(least, "component"), "node", "left")
    by_class = by_class.select("g", "d", (F.coalesce("others", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("least", "cid").alias("component"))
    linked = tagged.select("vec_id", "g", "d").join(by_class, ["g", "d"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    lone = numbered.filter(F.col("vec_id").isNull() | F.col("label").isNull() | F.coalesce(~_is_valid(F.transform("vector", lambda x: x.cast("double"))), F.lit(True)))
    out = linked.unionByName(lone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _is_valid(v):
    v = F.col(v) if isinstance(v, str) else v
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
