"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

Only lengths decide a packing, and there are at most `capacity` of them. So the plan is made on the driver from a histogram of lengths
(bounded by the capacity, whatever the corpus), and pieces find their place by their rank among pieces of equal length. Ranks come from
per-task counters plus prefix sums of the counts of earlier tasks: no sort, no window over pieces, no hot length in one task.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orecart.llm.common import Scratch, per_worker

END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, idx long"
#: Words in a worker's memo before it becomes the older one.
MEMO = 400_000
#: Other white space than these is left to the tokenizer, in whole texts.
ODD_SPACE = b"\x0b\x0c\x1c\x1d\x1e\x1f"
#: What stands between words that are encoded together. A word that holds it gives a part too many.
MARK = b" \x01 "


class WordMemo:
    """Ids, as little-endian unsigned 32-bit, of a word between ASCII white space.

    Where the tokenizer's normaliser and pre-tokeniser never join text across white space, which a few texts show, words are encoded one
    by one; else whole texts are. A full memo becomes the older one, whose words come back when they are met again, so frequent words are
    never encoded anew.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores; threads on short batches only wait for each other
        from tokenizers import Tokenizer

        self.tokenizer, self.now, self.older = Tokenizer.from_file(path), {}, {}
        self.mark = self.ids(MARK.decode())
        lines = ["the cat's 12 mats", "Über 3,5 Straßen\n\tno.", "a  b \n c"]
        self.by_word = all(self.ids(t) == array("I", [i for w in t.split() for i in self.ids(w)]) for t in lines)

    def ids(self, text: str) -> array:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def each(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. All go through the tokenizer as one text with a mark between words, and are cut at the mark's id; where that
        doesn't give one part a word, one by one."""
        if len(words) > 1 and len(self.mark) == 1:
            got = np.frombuffer(self.ids(MARK.join(words).decode("utf-8", "replace")), np.uint32)
            at = np.flatnonzero(got == self.mark[0])
            if len(at) == len(words) - 1:
                data, cuts = got.tobytes(), (4 * at).tolist()
                return [data[i:j] for i, j in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)]
        return [self.ids(w.decode("utf-8", "replace")).tobytes() for w in words]

    def encode(self, data: bytes | None) -> bytes:
        """Ids of a text in UTF-8."""
        if not data:
            return b""
        if not self.by_word or any(c in data for c in ODD_SPACE):
            return self.ids(data.decode("utf-8", "replace")).tobytes()
        words = data.split()
        if unmet := set(words).difference(self.now):
            if len(self.now) + len(unmet) > MEMO:
                self.older, self.now = self.now, {}
                unmet = set(words)
            older = self.older
            self.now.update((w, older[w]) for w in unmet if w in older)
            new = [w for w in unmet if w not in older]
            self.now.update(zip(new, self.each(new), strict=True))
        return b"".join(map(self.now.__getitem__, words))


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """Pieces of at most `capacity` ids of each row of (doc_id, text), with their task and their rank among its pieces of that length.

    A document is its ids and then END_ID, so an empty or null text is the one id END_ID. Only longer ones are cut.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, part = per_worker(("words", tokenizer), lambda: WordMemo(tokenizer)), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["data"], strict=True):
                ids = memo.encode(text) + END_ID.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc, piece, at // 4, n, zlib.crc32(own), part, seen.get(n, 0)))
                    seen[n] = seen.get(n, 0) + 1
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("data")).mapInPandas(cut, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, how many sequences) that use up `counts`.

    A sequence takes the longest piece left, then again and again the longest that still fits. If a gap stays, its smallest piece is
    replaced by two unpacked pieces whose sum is larger and fits the gap expanded by that piece, the largest such sum. Each pattern
    is repeated as often as its lengths last.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    mask = sum(1 << n for n in left)
    out: list[tuple[list[int], int]] = []

    def longest(most: int, used: dict[int, int]) -> int:
        m = mask & ((1 << (most + 1)) - 1)
        while m:
            n = m.bit_length() - 1
            if left[n] > used.get(n, 0):
                return n
            m ^= 1 << n
        return 0

    while mask:
        bin_, used, gap = [], {}, capacity
        while gap and (n := longest(gap, used)):
            bin_.append(n)
            used[n] = used.get(n, 0) + 1
            gap -= n
        if gap and len(bin_) > 1:
            small, best = bin_[-1], (bin_[-1], 0, 0)
            room = gap + small
            used[small] -= 1
            first = longest(room - 1, used)
            while first and 2 * first > best[0]:
                used[first] = used.get(first, 0) + 1
                second = longest(min(first, room - first), used)
                used[first] -= 1
                if second and first + second > best[0]:
                    best = (first + second, first, second)
                    if best[0] == room:
                        break
                first = longest(first - 1, used) if first > 1 else 0
            bin_[-1:] = best[1:] if best[1] else [small]
            used = {n: bin_.count(n) for n in bin_}
        times = min(left[n] // c for n, c in used.items())
        out.append((bin_, times))
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                mask ^= 1 << n
    return out


def intervals(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each slot of each pattern: the ranks of its length that go there, the first sequence and the offset in it."""
    rows, taken, sequence = [], {}, 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            at = taken.get(n, 0)
            rows.append((n, at, sequence, offset))
            taken[n] = at + times
            offset += n
        sequence += times
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T, strict=True))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of `docs` (doc_id, text).

    Null or empty text: a piece of the end id alone. Null ids, repeated rows and repeated ids are packed as rows of their own. An empty
    table gives no rows. Texts of any length are packed whole; of equal lengths it does not matter which goes where. Other columns are
    ignored, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(tokenised_pieces(docs, tokenizer, capacity), "pieces")  # ranks are fixed from here on
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = intervals(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    keys = table["length"] << 44 | table["rank"]
    shared = docs.sparkSession.sparkContext.broadcast((keys, table))
    fields = [x for x in PIECES.split(", ")[:5]] + ["sequence_id long", "offset long"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, table = shared.value
        for b in batches:
            rank = (b["base"] + b["idx"]).to_numpy(np.int64)
            k = np.searchsorted(keys, b["length"].to_numpy(np.int64) << 44 | rank, side="right") - 1
            b["sequence_id"] = table["sequence"][k] + rank - table["rank"][k]
            b["offset"] = table["offset"][k]
            b["doc_id"] = b["doc_id"].astype("Int64")
            yield b[[x.split()[0] for x in fields]]

    return pieces.join(base, ["part", "length"]).mapInPandas(place, ", ".join(fields))
