"""Byte-level BPE as a lazily determinised finite-state transducer, and an incremental decoder.

Theory: with rank-ordered merges, a sequence of tokens is BPE's result exactly if each neighbouring pair (s, t) is the result for the
bytes of s + t, and every token is the result for its own bytes. So the last token of each prefix of a word is known from the
prefix alone. Which of the prefix's boundaries can still matter is known from the vocabulary's trie: only those from which the bytes
read so far are the start of some token. All such boundaries share a common past, which is emitted; what is left of the past, seen
from there, is the state. States and arcs are made when first met.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orecart.llm.common import per_worker

#: Units kept by a worker's memo, and states kept by its transducer; each starts afresh beyond that.
MEMO, STATES = 500_000, 300_000
UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space besides blank and line feed; in a text that holds any, the pattern runs over the whole text.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition: join the leftmost neighbouring pair of least rank until none has a rank."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        found = [(ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in ranks]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Transducer:
    """A state is the open boundaries of a prefix, oldest first, each as (bytes since it, token that ends at it).

    The arc for a byte gives the token that ends there. Tokens leave once the pasts of all open boundaries agree on them, which
    is looked for every LOOKAHEAD bytes and at the end of a word; no open boundary is older than the longest token.
    """

    LOOKAHEAD = 256

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.starts = {t[:i] for t in ranks for i in range(1, len(t))}  # proper prefixes: the trie's inner nodes
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[bytes, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.count = 1
        self.ids: dict[tuple, dict] = {}
        self.start = {-1: ((b"", b""),)}  # arcs by byte; -1 has the boundaries

    def reached(self, token: bytes) -> bool:
        """Whether merging makes this entry; one that it does not make stands for whole words only."""
        if (known := self.known.get(token)) is None:
            known = self.known[token] = len(merge(token, self.ranks)) == 1
        return known

    def fits(self, s: bytes, t: bytes) -> bool:
        if (known := self.pairs.get((s, t))) is None:
            if len(self.pairs) > 4 * STATES:
                self.pairs.clear()
            known = self.pairs[s, t] = merge(s + t, self.ranks) == [s, t]
        return known

    def arc(self, state: dict, byte: int) -> tuple[dict, bytes]:
        """Make the arc of a state for a byte: the next state, and the token that ends there."""
        b, ranks, starts = bytes((byte,)), self.ranks, self.starts
        new, token = [], b""
        for since, last in state[-1]:
            longer = since + b
            if not token and longer in ranks and (not last or self.fits(last, longer)) and self.reached(longer):
                token = longer
            if longer in starts:
                new.append((longer, last))
        if not token:
            raise ValueError("the vocabulary does not hold every byte")
        new.append((b"", token))
        key = tuple(new)
        if (to := self.ids.get(key)) is None:
            to = self.ids[key] = {-1: key}
            self.count += 1
        state[byte] = (to, token)
        return to, token

    def encode(self, word: bytes) -> list[bytes]:
        if word in self.ranks and not self.reached(word):
            return [word]
        if self.count > STATES:
            self.reset()
        state, ends, out = self.start, [], []
        for byte in word:
            state, token = state.get(byte) or self.arc(state, byte)
            ends.append(token)
            if len(ends) >= self.LOOKAHEAD + 256:
                n = self.agreed(ends, state)
                out += back(ends, n)
                del ends[:n]
        return out + back(ends, len(ends))

    def agreed(self, ends: list[bytes], state: dict) -> int:
        """Where the pasts of all open boundaries first meet."""
        open_ = {len(ends) - len(since) for since, _ in state[-1]}
        while len(open_) > 1:
            last = max(open_)
            open_ = open_ - {last} | {last - len(ends[last - 1])}
        return open_.pop()


def back(ends: list[bytes], at: int) -> list[bytes]:
    """The tokens up to a position, given the token that ends at each."""
    out = []
    while at:
        out.append(ends[at - 1])
        at -= len(ends[at - 1])
    return out[::-1]


class Encoder(dict):
    """Ids, as little-endian unsigned 32-bit, of each unit (white space and the run of other characters after it).

    No match of the pattern goes from other characters on to white space, so units are matched one by one; a memo keeps them.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.transducer, self.pattern, self.ranks = Transducer(ranks), regex.compile(pattern), ranks
        self.packed = {t: int(i).to_bytes(4, "little") for t, i in ranks.items()}

    def pieces(self, text: str) -> bytes:
        encode, packed = self.transducer.encode, self.packed
        return b"".join([packed[t] for m in self.pattern.findall(text) for t in encode(m.encode("utf-8"))])

    def __missing__(self, unit: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        out = self.pieces(unit)
        if len(unit) < 64:
            self[unit] = out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if OTHER_SPACE.search(text):
            return self.pieces(text)
        return b"".join(map(self.__getitem__, UNIT.findall(text)))


def transitions() -> list[list[int]]:
    """State after a byte, by state and byte, of well-formed UTF-8; -1 where a byte cannot follow.

    0: between characters. 1 to 3: so many continuation bytes due. 4 to 7: after E0, ED, F0 and F4, whose next byte has a narrower range.
    """
    table = [[-1] * 256 for _ in range(8)]
    for first, last, to in ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE1, 0xEF, 2), (0xF1, 0xF3, 3), (0xE0, 0xE0, 4), (0xED, 0xED, 5), (0xF0, 0xF0, 6), (0xF4, 0xF4, 7)):
        table[0][first : last + 1] = [to] * (last + 1 - first)
    for state, first, last, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        table[state][first : last + 1] = [to] * (last + 1 - first)
    return table


NEXT = transitions()


class StreamDecoder:
    """Incremental UTF-8 state machine over tokens: give ids, get segments (bytes, whether they are whole characters).

    Bytes of an unfinished character wait for the next ids. Bytes that no character can hold are segments of their own, as long as the
    longest start of a character there, so that `text_of` has one U+FFFD for each. Tokens that are whole characters by themselves, which
    lead from state 0 to state 0, are taken together; the bytes of all others go through the machine one by one.
    """

    def __init__(self, tokens: list[bytes], whole: np.ndarray | None = None) -> None:
        self.tokens, self.whole, self.state, self.waiting = tokens, is_whole(tokens) if whole is None else whole, 0, bytearray()

    def _step(self, byte: int, out: list[tuple[bytes, bool]]) -> None:
        to = NEXT[self.state][byte]
        if to < 0 and self.state:
            out.append((bytes(self.waiting), False))
            self.waiting.clear()
            to = NEXT[0][byte]
        if to < 0:
            out.append((bytes((byte,)), False))
            self.state = 0
            return
        self.state = to
        self.waiting.append(byte)
        if not to:
            out.append((bytes(self.waiting), True))
            self.waiting.clear()

    def feed(self, ids: np.ndarray) -> list[tuple[bytes, bool]]:
        """The segments that these ids complete."""
        out: list[tuple[bytes, bool]] = []
        ids = np.asarray(ids, np.int64)
        listed, start = ids.tolist(), 0
        for stop in [*np.flatnonzero(~self.whole[ids]).tolist(), len(listed)]:
            if start < stop:
                out += self.close()  # a whole character ends any that was open
                out.append((b"".join(map(self.tokens.__getitem__, listed[start:stop])), True))
            if stop < len(listed):
                for byte in self.tokens[listed[stop]]:
                    self._step(byte, out)
            start = stop + 1
        return out

    def close(self) -> list[tuple[bytes, bool]]:
        """What is still open, which no character completes."""
        out = [(bytes(self.waiting), False)] if self.waiting else []
        self.waiting.clear()
        self.state = 0
        return out


def is_whole(tokens: list[bytes]) -> np.ndarray:
    """Whether the machine goes from state 0 to state 0 over each token."""

    def whole(token: bytes) -> bool:
        state = 0
        for byte in token:
            state = NEXT[state][byte]
            if state < 0:
                return False
        return not state

    return np.array([t.isascii() or whole(t) for t in tokens], bool)


def text_of(segments: list[tuple[bytes, bool]]) -> str:
    return "".join(data.decode("utf-8") if ok else "\ufffd" for data, ok in segments)


def vocabulary(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        out[i] = t
    return out


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, window: int = 65_536) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of (doc_id, text): encoded, then decoded from its ids in windows.

    Null or empty text: no ids. Ids of rows, repeated rows and nulls are kept as they are; an empty table gives no rows; other columns are
    ignored, whatever their names; a text of any length is encoded whole. decoded_sha256 is of the bytes that the decoder's state machine
    gives out, window by window. One pass, no shuffle. `ids_of` gives the ids themselves.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = per_worker(("bpe", ranks_path, pattern), lambda: Encoder(load_ranks(ranks_path), pattern))
        tokens = vocabulary(encoder.ranks)
        whole = is_whole(tokens)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = encoder.encode(text)
                decoder, digest = StreamDecoder(tokens, whole), hashlib.sha256()
                numbers = np.frombuffer(ids, "<u4")
                for at in range(0, len(numbers), window):
                    for data, _ in decoder.feed(numbers[at : at + window]):
                        digest.update(data)
                for data, _ in decoder.close():
                    digest.update(data)
                rows.append((len(numbers), hashlib.sha256(ids).hexdigest(), digest.hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64"))
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def ids_of(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each row of (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = per_worker(("bpe", ranks_path, pattern), lambda: Encoder(load_ranks(ranks_path), pattern))
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": [np.frombuffer(encoder.encode(t), "<u4").astype(np.int32) for t in batch["text"]]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, ids array<int>")
