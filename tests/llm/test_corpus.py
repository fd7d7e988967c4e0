"""Corpus operators against plain versions, on small tables with the awkward cases: nulls, empty and repeated rows, ties, clashing columns."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from orecart.llm import ann, bpe, langid, lm, minhash, neighbours, packing, toxicity, urls, warc
from orecart.llm.common import Scratch

WORDS = "the cat sat on mat while dog ran far away from old house near river bank under bright moon".split()


def texts(n=30, seed=3):
    r = random.Random(seed)
    return [" ".join(r.choices(WORDS, k=r.randint(5, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    t = texts()
    rows = [(i, x) for i, x in enumerate(t)] + [(100, None), (101, ""), (102, " \n"), (None, t[0]), (3, t[3]), (200, t[5] + " tail"), (201, t[7]), (202, " ".join(WORDS * 900))]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, piece int, score string")


def test_packing(spark, docs):
    path, cap = P.path("word_bpe_49k.json"), 64
    got = packing.pack(docs, path, cap).toPandas()
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(path), []
    for d, t in docs.select("doc_id", "text").collect():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, k, s, zlib.crc32(np.array(ids[s : s + cap], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), cap))]
    have = [(None if r.doc_id is None or r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.ids_crc32) for r in got.astype({"doc_id": object}).itertuples()]
    assert sorted(map(str, have)) == sorted(map(str, want))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= cap
    assert packing.pack(docs.limit(0), path, cap).count() == 0


def test_words_encoded_together_keep_their_ids():
    """Also with the mark itself in a word, odd white space, letters that change in lower case, and a memo that is renewed."""
    memo, rng = packing.WordMemo(P.path("word_bpe_49k.json")), random.Random(3)
    letters = "ab \x01 \x00\u0301é\u0130Σσ'sdon't.,9\n\t\x0b\x85\u00a0\u2003 中\ufb01🙂\u01c4<|endoftext|>"
    for k in range(2000):
        text = "".join(rng.choices(letters, k=rng.randrange(60)))
        if k % 100 == 0:
            memo.older, memo.now = memo.now, {}
        assert memo.encode(text.encode()) == memo.ids(text).tobytes()


def test_best_two_fit_replaces():
    # greedy takes 6 then 3 and leaves 1; two pieces of 2 fill the expanded gap of 4
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0][0] == [6, 2, 2]


def test_bpe_equals_library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    e, lib, r = bpe.Encoder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), random.Random(5)
    vocabulary = bpe.vocabulary(ranks)
    whole = bpe.is_whole(vocabulary)
    for _ in range(300):
        s = "".join(r.choice("abcdeting  \n\t'sé漢😀ñ09.,\r\x85") for _ in range(r.choice([1, 5, 40]))) + r.choice(["", "a" * 700, "  "])
        ids = np.frombuffer(e.encode(s), "<u4").tolist()
        assert ids == lib.encode_ordinary(s)
        d, out = bpe.StreamDecoder(vocabulary, whole), []
        for i in ids:
            out += d.feed([i])
        assert bpe.text_of(out) == s and d.close() == [] and b"".join(x for x, _ in out) == s.encode()


def test_stream_decoder_on_any_bytes():
    """Single bytes as tokens, in windows of any size: all bytes come out, and the text is what a decoder of the whole gives."""
    r, tokens = random.Random(6), [bytes((i,)) for i in range(256)] + ["é".encode(), "漢😀".encode(), b"a", b"\xe6\xbc", b"\xa2z"]
    whole = bpe.is_whole(tokens)
    assert whole.tolist() == [i < 128 for i in range(256)] + [True, True, True, False, False]
    for k in range(3000):
        pieces = [r.choice(["é漢😀ñ\u07ff\ud7ff\ue000\U0010ffff"[r.randrange(8)].encode("utf-8"), bytes(r.choices(range(256), k=r.randrange(4))), b"ab", b"\xf0\x9f", b"\xed\xa0\x80", b"\xe0\x80", b"\xf4\x90\x80\x80"]) for _ in range(r.randrange(8))]
        data = b"".join(pieces)
        ids = list(data) if k % 2 else [i for p in pieces for i in ([256] if p == "é".encode() else list(p))] + [257, 259, 260]
        expect = b"".join(tokens[i] for i in ids)
        d, out, at = bpe.StreamDecoder(tokens, whole), [], 0
        while at < len(ids):
            n = r.randrange(1, 5)
            out += d.feed(np.array(ids[at : at + n]))
            at += n
        out += d.close()
        assert b"".join(x for x, _ in out) == expect and bpe.text_of(out) == expect.decode("utf-8", "replace")


def test_bpe_table(spark, docs):
    """Every row against the library: nulls, empty and very long texts, repeated rows, null ids, columns of clashing names."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = docs.select("doc_id", "text", docs["score"].alias("n_tokens"), docs["score"].alias("decoded_sha256"))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_decode(more, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, window=7).collect()]
    want = []
    for d, t in docs.select("doc_id", "text").collect():
        ids = lib.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert bpe.encode_decode(docs.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def plain_lm(rows, order, folds=7, held=2, deleted_fold=3):
    """Deleted interpolation by its definition, on counts in dicts: {(id, text): (n_tokens, n_known, base, score)}."""
    import math
    from collections import Counter

    number = lambda d: zlib.crc32(str(d).encode()) % folds if d is not None else 0
    split = lambda t: [*(t or "").encode().lower().split(), b"</s>"]
    train = [split(t) for d, t in rows if number(d) != held]
    own = [split(t) for d, t in rows if number(d) == deleted_fold]

    def counted(texts, n):
        padded = [[None] * (n - 1) + t for t in texts]
        return Counter(tuple(p[i : i + n]) for p in padded for i in range(len(p) - n + 1))

    full, gone = [counted(train, n) for n in range(1, order + 1)], [counted(own, n) for n in range(1, order + 1)]
    tokens, docs = sum(full[0].values()), len(train)
    v, deleted = len(full[0]), sum(gone[0].values())

    def parts(t, delete):
        """For each token of a text and each n: f_n and the bucket of its context."""
        for i in range(len(t)):
            out = []
            for n in range(1, order + 1):
                gram = tuple((([None] * (n - 1)) + t)[i : i + n])
                c = full[n - 1][gram] - (gone[n - 1][gram] if delete else 0)
                if n == 1:
                    out.append((c / max(1, tokens - deleted * delete), 1))
                    continue
                if i == 0:
                    context = docs - len(own) * delete
                else:
                    before = tuple((([None] * (n - 2)) + t)[i - 1 : i + n - 2])
                    context = full[n - 2][before] - (gone[n - 2][before] if delete else 0)
                out.append((c / context if context > 0 else 0.0, math.ceil(math.log2(max(context, 0) + 1))))
            yield out

    weights = []
    for level in range(order):
        seen = {}
        for t in own:
            for x in parts(t, True):
                p = 1 / (v + 1)
                for (f, b), w in zip(x, weights, strict=False):
                    p = w[b] * f + (1 - w[b]) * p
                seen.setdefault(x[level][1], []).append(x[level][0] / p)
        learned = []
        for b in range(lm.LEVELS):
            w = 0.5
            for _ in range(100):
                w = sum(w * r / (w * r + 1 - w) for r in seen[b]) / len(seen[b]) if b in seen else None
                if w is None:
                    break
                w = min(max(w, 1e-6), 1 - 1e-6)
            learned.append(w)
        weights.append(lm.filled(learned))
    out = []
    for d, t in rows:
        t = split(t)
        base = sum(math.log10((full[0][(w,)] + 1) / (tokens + v + 1)) for w in t)
        total = 0.0
        for x in parts(t, False):
            p = 1 / (v + 1)
            for (f, b), w in zip(x, weights, strict=True):
                p = w[b] * f + (1 - w[b]) * p
            total += math.log10(p)
        out.append((d, len(t), sum(full[0][(w,)] > 0 for w in t), tokens, base, total))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm(spark, docs, order, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 200)  # several chunks a task
    monkeypatch.setattr(lm, "BUCKET_BYTES", 4000)
    got = lm.score(docs, order=order).collect()
    want = plain_lm([tuple(r) for r in docs.select("doc_id", "text").collect()], order)
    key = lambda r: (str(r[0]), r[1], r[4])
    have = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got]
    assert len(have) == len(want)
    for h, w in zip(sorted(have, key=key), sorted(want, key=key), strict=True):
        assert h[:4] == w[:4] and abs(h[4] - w[4]) < 1e-6 and abs(h[5] - w[5]) < 0.01 * abs(w[5])  # EM reads ratios in bins of a 32nd octave
    assert {r["doc_id"] for r in got if r["held_out"]} == {r[0] for r in want if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2}


def test_lm_backs_off_and_empty(spark, docs):
    assert lm.filled([0.3, None, 0.2, None, None, 0.4]).tolist() == [0.0, 0.2, 0.2, 0.2, 0.4, 0.4]
    assert lm.score(docs.limit(0)).count() == 0
    ids = [d for d in range(50) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    only_held = spark.createDataFrame([(d, "a b") for d in ids], "doc_id long, text string")
    assert [(r["train_tokens"], r["n_known"], r["score"]) for r in lm.score(only_held).collect()] == [(0, 0, 0.0)] * 2


def plain_components(rows, size, percent):
    """doc_id -> least id that links reach, by comparing all pairs of shingle sets of words."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets))


def test_minhash(spark, docs):
    got = minhash.near_duplicates(docs, size=4, percent=80).collect()
    at = {r["doc_id"]: r for r in got}
    assert at[201]["component_id"] == 7 and not at[201]["kept"] and at[102]["n_shingles"] == 0 and at[102]["kept"]
    assert at[None]["component_id"] is None and at[None]["n_shingles"] > 0
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == plain_components(docs.select("doc_id", "text").collect(), 4, 80)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def near_group(n, words, edits, seed, vocabulary=3000):
    """Copies of a text, each with some words replaced."""
    r = random.Random(seed)
    base = [f"w{r.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(edits):
            t[r.randrange(words)] = f"x{r.randrange(10**9)}"
        out.append(" ".join(t))
    return out


def test_minhash_large_group_around_the_threshold(spark):
    """A group larger than two blocks whose pairs lie on both sides of 0.8, one far below it, and one of true copies."""
    texts_ = near_group(620, 150, 3, 21) + near_group(150, 60, 5, 22) + near_group(40, 30, 0, 23) + near_group(30, 400, 4, 24)
    rows = list(enumerate(texts_))
    random.Random(25).shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=80).collect()
    want = plain_components(rows, 4, 80)
    assert len({c for _, _, c in want}) > 100
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_blocks_answer_with_few_links(spark):
    """No table of pairs is made: classes meet a pivot once a bucket, and a block answers with fewer links than it has classes."""
    n, scratch = 600, Scratch(spark, "linear")
    scratch.drop = lambda name: None  # keep the tables
    minhash.near_duplicates(spark.createDataFrame(list(enumerate(near_group(n, 150, 3, 26))), "doc_id long, text string"), size=4, scratch=scratch).count()
    table = lambda name: spark.read.parquet(scratch.path(name))
    assert table("likely").count() <= n * minhash.BANDS
    assert table("links-apart").count() < table("flagged").count() <= n * minhash.BANDS * -(-n // minhash.BLOCK)


def test_overlaps_and_spanning():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 9000, r.integers(1, 5000)).astype(np.uint64)) for _ in range(12)]
    assert minhash.overlaps(sets[:5], sets[5:]).tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
    assert minhash.overlaps([np.array([1], np.uint64)], [np.array([2], np.uint64)]).tolist() == [[0]]
    assert minhash.spanning(np.array([[1, 2], [2, 3], [1, 3], [4, 5]])).shape == (3, 2)


def test_one_of_each(spark):
    """Of each group the least (id, md5): an id may have another text that is no copy, repeated rows count once, null ids stay."""
    a, b = (" ".join(f"{x}{i}" for i in range(200)) for x in "ab")
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (6, b + " tail", 5), (None, a, 6), (None, a, 7), (8, None, 8), (9, "", 9), (9, "", 10), (2, a + " x", 11), (2, a + " y", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, md5 int")
    got = minhash.one_of_each(df)
    assert got.columns == df.columns
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect())
    first = min((a + " x", a + " y"), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert kept == sorted([("2", first), ("5", b), ("None", a), ("None", a), ("8", ""), ("9", "")])
    assert minhash.one_of_each(df.limit(0)).count() == 0


def test_minhash_keeps_both_texts_of_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, c), (5, c + " tail"), (0, b + " end")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((q["doc_id"], q["component_id"], q["kept"]) for q in got) == [(0, 0, True), (1, 0, False), (1, 1, True), (2, 1, False), (3, 0, False), (4, 4, True), (5, 4, False)]


def test_sketch_gates_miss_few_pairs():
    """Both gates together reject a pair at exactly the threshold less often than the bands miss it (3e-5)."""
    import math

    missed = 0.0
    for count in (minhash.FIRST, minhash.BUCKETS):
        floor = 0.8 - minhash.SLACK * math.sqrt(0.8 * 0.2 / count)
        missed += sum(math.comb(count, k) * 0.8**k * 0.2 ** (count - k) for k in range(math.ceil(floor * count)))
    assert missed < 3e-5, missed


def test_chance_equality_is_small():
    assert minhash.chance_equal(np.array([1000]), np.array([1000]))[0] < 0.01
    s = np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(s[:2700]), np.unique(s[300:])
    e = minhash.estimate(minhash.sketch(a)[None], minhash.sketch(b)[None], len(a), len(b))[0]
    assert abs(e - 0.8) < 0.15


def test_neighbours(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((60, 8))
    rows = [(i, x.tolist(), 0) for i, x in enumerate(base)] + [(100 + i, (base[0] + 0.01 * r.standard_normal(8)).tolist(), 0) for i in range(40)]
    rows += [(200, base[5].tolist(), 0), (201, base[5].tolist(), 1), (202, [0.0] * 8, 0), (203, None, 0), (204, [float("nan")] * 8, 0), (205, base[0].tolist(), None)]
    df = spark.createDataFrame([(*x, 9) for x in rows], "vec_id long, embedding array<float>, label int, n_links int")
    ok = [x for x in rows if x[2] == 0 and x[1] and any(x[1]) and not np.isnan(x[1]).any()]
    m = np.array([x[1] for x in ok], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    want = dict(zip([x[0] for x in ok], ((m @ m.T >= 0.98).sum(1) - 1).tolist(), strict=True))
    got = {r["vec_id"]: r for r in neighbours.near_vectors(df).collect()}
    assert {k: got[k]["n_links"] for k in want} == want
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (201, 202, 203, 204, 205))


def links_of(vectors, threshold=0.98):
    m = np.asarray(vectors, np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    return dict(enumerate(((m @ m.T >= threshold).sum(1) - 1).tolist()))


def vector_rows(spark, vectors):
    return spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")


def test_neighbours_finds_isolated_pairs(spark):
    """Pairs that no order by sign codes brings together, as all rows have nearly the same code."""
    r = np.random.default_rng(7)
    x = 3 * r.standard_normal(32) + r.standard_normal((3000, 32))
    for k in range(40):
        x[2999 - k] = x[k] + 0.12 * r.standard_normal(32)
    want = links_of(x)
    assert sum(want.values()) >= 70
    assert {q["vec_id"]: q["n_links"] for q in neighbours.near_vectors(vector_rows(spark, x)).collect()} == want


def test_neighbours_with_pivots_and_small_blocks(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = np.repeat(r.standard_normal((150, 16)), 8, 0) + 0.11 * r.standard_normal((1200, 16))
    want, ids = links_of(x), np.arange(1200)
    monkeypatch.setattr(neighbours, "VALUES", 1)
    monkeypatch.setattr(neighbours, "LEAST", 1)
    got = neighbours.near_vectors(vector_rows(spark, x), cell=30).toPandas().set_index("vec_id").loc[ids]
    m = x.astype(np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    near, least = m @ m.T >= 0.98, ids.copy()
    for _ in range(30):
        least = np.where(near, least[None], 1200).min(1)
    assert got["n_links"].to_dict() == want and got["component_id"].tolist() == least.tolist() and 100 < sum(want.values())


def test_neighbours_links_dense_groups(spark):
    """Two groups of 60 near-equal vectors: each vector has far more links in its own group than lists used to hold, and 60 across."""
    r = np.random.default_rng(9)
    a, b = np.linalg.qr(r.standard_normal((32, 2)))[0].T
    x = np.repeat([a, 0.984 * a + np.sqrt(1 - 0.984**2) * b], 60, 0) + 0.002 * r.standard_normal((120, 32))
    got = neighbours.near_vectors(vector_rows(spark, x)).collect()
    assert set(links_of(x).values()) == {119} == {q["n_links"] for q in got} and {q["component_id"] for q in got} == {0}


def test_ann(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((600, 32)).astype(np.float32)
    x[7] = x[9]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [0.0] * 32)], "vec_id long, embedding array<float>")
    got = ann.search(df, df.filter("vec_id % 20 = 0"), 20).toPandas()
    ids = np.arange(600)
    want = {(q, v) for q, _, v in ann.brute_force(ids, x.astype(float), ids[ids % 20 == 0], 20)}
    assert len(want & set(zip(got["query_id"], got["vec_id"], strict=True))) >= 0.9 * len(want)
    assert set(got.groupby("query_id").size()) == {20} and 920 not in set(got["query_id"])
    assert ann.search(df.limit(0), df, 5).count() == 0


def test_urls(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("Example.com", "/en/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://A.EXAMPLE.com/en/x?y", "k"), (2, None, "k"), (3, "mailto:x", "k"), (4, "http://b.com/", "k"), (4, "http://b.com/", "k"), (5, "http://c.org#x", "k")], "page_id long, url string, rule string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, rules).fillna("-", ["rule"]).collect())
    assert got == [(1, "a.example.com", "/en/x", "example.com/en/", "block"), (2, "", "", "-", "allow"), (3, "", "", "-", "allow"), (4, "b.com", "/", "com/", "allow"), (4, "b.com", "/", "com/", "allow"), (5, "c.org", "", "-", "allow")]


def test_warc(spark):
    big = "é\r\n\r\n" * 400
    rows = [(1, "http://a/", big), (2, None, big), (3, "x\r\ny", "small"), (4, "z", "small"), (5, "n", None), (None, "q", big)]
    path = Scratch(spark, "test").path("w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r["page_id"]: r for r in warc.read_warc(spark, path).collect()}
    assert {k: (v["record_type"], v["refers_to"]) for k, v in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 2)}
    assert got[1]["payload_bytes"] == len(big.encode()) and got[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() and got[5]["payload_bytes"] == 0


def test_warc_in_bounded_archives(spark, tmp_path):
    """Many archives, repeated rows, null ids, clashing columns: every record comes back, with an id of its own."""
    import os

    big, long = "x" * 1500, "y" * 400_000
    rows = [(i, f"u{i}", f"{i % 50} {big}" if i % 3 else f"s{i}", "a") for i in range(600)] + [(7, "u7", f"7 {big}", "a")] * 2 + [(597, "u", f"47 {big}", "b")] * 2 + [(None, "n", f"{4} {big}", "c")] * 2 + [(9000 + i, "l", long + str(i), "d") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string").withColumn("place", F.lit(1)).withColumn("refers_to", F.lit("z"))
    warc.write_warc(df, f"file://{tmp_path}/w", archive_bytes=100_000)
    got = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert sum(f.startswith("part-") for f in os.listdir(tmp_path / "w")) >= 15
    sha = lambda h: hashlib.sha1(h.encode()).hexdigest()
    first = {}
    for p, _, h, _ in rows:
        if p is not None:
            first[h] = max(p, first.get(h, p))
    want = sorted(str((p, len(h), sha(h), "revisit" if len(h) >= 1000 and p != first[h] else "response", first[h] if len(h) >= 1000 and p != first[h] else None)) for p, _, h, _ in rows)
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == want
    assert len({r["record_id"] for r in got}) == len(rows)
    warc.write_warc(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_langid(spark, docs):
    other = [(1000 + i, " ".join("der hund lief über straße und brücke".split() * (i % 5 + 1)), "de") for i in range(40)]
    df = docs.selectExpr("doc_id", "text", "'en' as lang").unionByName(spark.createDataFrame(other, "doc_id long, text string, lang string"))
    model = langid.fit(df)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(df, model).collect()]
    assert all(p == "de" for d, p in got if d and d >= 1000) and dict(got)[100] == "und" and dict(got)[1] == "en"
    assert langid.accepted(df, model).filter("doc_id between 100 and 102").count() == 0


def test_language_stage_rejects_junk(spark):
    """Junk made of letters and a language that was not learned go; clean texts stay, also short ones and those of the held-out fold."""
    import corpus_pipeline

    r = random.Random(11)
    clean = [(i, x, "en") for i, x in enumerate(texts(300, 12))] + [(300 + i, " ".join(r.choices("der hund lief über straße und brücke durch nacht".split(), k=r.randint(3, 60))), "de") for i in range(300)]
    bad = [" ".join("".join(r.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(40)) for _ in range(20)] + ["кошка сидела на старом ковре у реки " * 5, "wszyscy ludzie rodzą się wolni i równi " * 8, "123 456", "", None]
    df = spark.createDataFrame(clean + [(1000 + i, x, None) for i, x in enumerate(bad)], "doc_id long, text string, lang string")
    assert sorted(q["doc_id"] for q in corpus_pipeline.in_a_language(spark, df, "").collect()) == [x[0] for x in clean]


def test_langid_learns_more_than_64_languages(spark):
    r = random.Random(13)
    rows = []
    for k in range(70):
        words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)]
        rows += [(100 * k + i, " ".join(r.choices(words, k=30)), f"l{k:02}") for i in range(12 if k else 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    got = {q["doc_id"]: q["lang_pred"] for q in langid.predict(df, langid.fit(df)).collect()}
    assert got == {d: lang for d, _, lang in rows}


def test_langid_learns_from_copies(spark):
    """A language that consists of copies of three texts is learned, from about as many rows as are asked for, with ids and without."""
    t = texts(3, 14)
    for ids in (True, False):
        rows = [(i if ids else None, t[i % 3], "en") for i in range(20_000)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert langid.fit(df, held=3, sample_rows=5).languages == ["en"]
        assert 32 <= langid._drawn(df, 4, 3, 5).count() < 200
        assert 250 < langid._drawn(df, 4, 3, 300).count() < 450


def test_toxicity():
    r = random.Random(4)
    bad = [w.split() for w in texts(200, 8)]
    for w in bad:
        w.insert(r.randrange(len(w)), r.choice(["nastyword", "vileterm"]))
    good = texts(400, 9)
    mixed = [" ".join(b) for b in bad]
    rows = [np.array([f for w in sorted(toxicity.distinct_words(t)) for f in toxicity.features(w)], np.int64) for t in mixed[:100] + good + mixed[100:130]]
    model = toxicity.train(rows, np.array([True] * 100 + [False] * 430), 0.1)
    words = toxicity.WordWeights(model)
    assert all(toxicity.raw_score(t, words, model.bias) >= 0.7 for t in mixed[130:]) and all(toxicity.raw_score(t, words, model.bias) < 0.7 for t in good)
    assert 0 <= toxicity.raw_score(None, words, model.bias) < 0.7


def test_toxicity_on_tables(spark):
    """Fitted and scored by Spark: held-out toxic texts are found, harmless ones and awkward rows are left alone."""
    r = random.Random(15)
    bad = {2000 + i: " ".join([*r.choices(WORDS, k=r.randint(4, 40)), r.choice(["nastyword", "Vileterm!"]), *r.choices(WORDS, k=5)]) for i in range(300)}
    good = dict(enumerate(texts(900, 16)))
    rows = [*good.items(), *bad.items(), (5000, None), (5001, ""), (5002, " ".join(WORDS * 5000)), (None, "nastyword here"), (None, None), (3, good[3]), (3, good[3])]
    docs = spark.createDataFrame([(*x, 0.5, 1, "q") for x in rows], "doc_id long, text string, score double, predicted int, p_id string").repartition(3)
    labels = spark.createDataFrame([(d, int(d >= 2000), 1) for d in [*good, *bad] if d % 2 == 0] + [(None, 1, 0), (4, None, 0), (2000, 0, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held(r["doc_id"]) for r in got)
    at = {r["doc_id"]: r for r in got}
    caught = [at[d]["predicted"] for d in bad if held(d)]
    assert sum(caught) >= 0.95 * len(caught) > 50 and not any(at[d]["predicted"] for d in [*good, 5000, 5001, 5002])
    assert at[5000]["score"] == at[5001]["score"] and [r["score"] for r in got if r["doc_id"] == 3] == [at[3]["score"]] * 3
    words = toxicity.WordWeights(model)
    assert all(abs(r["score"] - toxicity.raw_score(dict(rows).get(r["doc_id"]), words, model.bias)) < 1e-12 for r in got if r["doc_id"] is not None)
    stay = toxicity.accepted(docs, model)
    assert stay.columns == docs.columns and stay.count() == sum(not r["predicted"] for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    blank = toxicity.fit(docs.limit(0), labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(docs, blank).collect()} == {0}


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """Rows without ids are drawn one by one; bounds are parameters."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows, positive, prior: seen.append((len(rows), int(positive.sum()), prior)) or toxicity.Model(np.zeros(1 << toxicity.BITS), -5.0))
    docs = spark.createDataFrame([(None, "same text")] * 4000 + [(i, f"text {i}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(3000)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, positives=200, unlabelled=400, prior=0.25)
    (n, p, prior), = seen
    assert 140 < p < 270 and 320 < n - p < 480 and prior == 0.25


def test_packing_by_whole_texts():
    """A tokenizer that joins words to the space before them is asked for whole texts."""
    import json

    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"[UNK]": 0, "Ġb": 1, "a": 2}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
        f.write(tok.to_str())
        f.flush()
        memo = packing.WordMemo(f.name)
        assert json.loads(tok.to_str()) and not memo.by_word and memo.encode(b"a b") == memo.ids("a b").tobytes() == np.array([2, 1], np.uint32).tobytes()
    assert packing.WordMemo(P.path("word_bpe_49k.json")).by_word


def test_packing_is_tight():
    """Against the least number of sequences that the lengths allow, on mixed lengths."""
    r = random.Random(17)
    for capacity in (64, 512):
        counts = {}
        for _ in range(4000):
            n = min(capacity, max(1, int(r.lognormvariate(3, 1.2))))
            counts[n] = counts.get(n, 0) + 1
        patterns = packing.plan(counts, capacity)
        used = {}
        for lengths, times in patterns:
            assert sum(lengths) <= capacity
            for n in lengths:
                used[n] = used.get(n, 0) + times
        assert used == counts
        bound = -(-sum(n * c for n, c in counts.items()) // capacity)
        assert sum(t for _, t in patterns) <= max(bound, sum(c for n, c in counts.items() if 2 * n > capacity)) * 1.02 + 1


def test_neighbours_awkward_rows(spark):
    """Repeated rows, ids with several vectors, equal vectors of different labels and dimensions, clashing columns, an empty table."""
    rows = [(5, [1.0, 0.0], 0), (5, [0.0, 1.0], 1), (6, [1.0, 0.01], 0), (7, [0.01, 1.0], 1), (8, [0.0, 1.0], 1), (9, [1.0, 0.0, 0.0], 0), (10, [2.0, 0.0], 0), (10, [2.0, 0.0], 0), (None, [1.0, 0.0], 0), (11, [], 0)]
    df = spark.createDataFrame([(*x, 3, "z") for x in rows], "vec_id long, embedding array<double>, label int, component_id int, node string")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), str(r["kept"])) for r in neighbours.near_vectors(df).collect())
    assert got == sorted([("5", 3, "5", "True"), ("5", 2, "5", "True"), ("6", 3, "5", "False"), ("7", 2, "5", "False"), ("8", 2, "5", "False"), ("9", 0, "9", "True"), ("10", 3, "5", "False"), ("10", 3, "5", "False"), ("None", 0, "None", "None"), ("11", 0, "11", "True")])
    assert neighbours.near_vectors(df.limit(0)).count() == 0


def test_ann_over_blocks(spark, monkeypatch):
    """Several blocks of rows and queries, other dimensions, repeated rows and clashing columns; recall against brute force."""
    monkeypatch.setattr(ann, "ROW_BLOCK", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    r = np.random.default_rng(6)
    x = r.standard_normal((1500, 16)).astype(np.float32)
    x[40], x[1200] = x[41], x[1201]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(40, x[40].tolist()), (2000, [1.0, 2.0]), (2020, [1.0, 1.0]), (2021, [3.0, 0.0]), (2040, [float("inf")] * 16), (None, x[0].tolist())]
    df = spark.createDataFrame([(*v, 7, "q") for v in rows], "vec_id long, embedding array<float>, score int, d string")
    got = ann.search(df, df.filter("vec_id % 20 = 0"), 20).toPandas()
    ids = np.arange(1500)
    want = {(q, v) for q, _, v in ann.brute_force(ids, x.astype(float), ids[ids % 20 == 0], 20)}
    own = got[got["query_id"] < 2000]
    assert len(want & set(zip(own["query_id"], own["vec_id"], strict=True))) >= 0.95 * len(want)
    assert set(own.groupby("query_id").size()) == {20} and not (own["query_id"] == own["vec_id"]).any()
    for q, g in own.sort_values("rank").groupby("query_id"):
        exact = x[g["vec_id"]].astype(float) * x[q].astype(float)
        assert np.allclose(g["score"], exact.sum(1), atol=1e-12) and g["rank"].tolist() == list(range(1, 21))
        assert all(a > b or (a == b and i < j) for a, b, i, j in zip(g["score"], g["score"][1:], g["vec_id"], g["vec_id"][1:], strict=False))
    assert [tuple(t) for t in got[got["query_id"] >= 2000].sort_values(["query_id", "rank"])[["query_id", "vec_id", "score"]].to_numpy()] == [(2000, 2020, 3.0), (2000, 2021, 3.0), (2020, 2000, 3.0), (2020, 2021, 3.0)]
    assert ann.search(df, df.limit(0), 5).count() == 0


def test_urls_ties_and_large_rule_sets(spark, monkeypatch):
    """Equal rules, rules met by shuffle, a very common url, null and empty ones, an empty table."""
    rules = spark.createDataFrame([("a.com", "/x", "allow"), ("a.com", "/x", "block"), ("a.com", "/", "allow"), ("com", "/", "allow"), ("", "/", "block"), ("b.com", None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, "http://a.com/xyz") for i in range(40)] + [(100, None), (101, ""), (102, "://"), (103, "http://q.a.com/y"), (104, "ftp://b.com"), (105, "http://ba.com/x" + "z" * 50_000)], "page_id long, url string")
    want = [(i, "a.com", "a.com/x", "block") for i in range(40)] + [(100, "", None, "allow"), (101, "", None, "allow"), (102, "", None, "allow"), (103, "q.a.com", "a.com/", "allow"), (104, "b.com", "b.com", "block"), (105, "ba.com", "com/", "allow")]
    for rows in (50_000, 0):
        monkeypatch.setattr(urls, "BROADCAST_ROWS", rows)
        assert sorted((r["page_id"], r["host"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, rules).collect()) == want
    assert urls.judge_urls(pages.limit(0), rules).count() == 0 and {r["verdict"] for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_langid_awkward_rows(spark):
    """Against a plain count of n-grams in sets; long, empty and letterless texts, ties, null ids and languages, clashing columns, an empty table."""
    r = random.Random(18)
    german = "der hund lief über straße und brücke durch nacht am alten fluss".split()
    rows = [(i, " ".join(r.choices(WORDS, k=20)), "en") for i in range(200)] + [(300 + i, " ".join(r.choices(german, k=20)), "de") for i in range(200)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 . 34", None), (903, " ".join(german * 4000), None), (None, " ".join(german), None), (904, "ωψξ", None), (5, rows[5][1], "en")]
    df = spark.createDataFrame([(*x, 1.5, "x") for x in rows], "doc_id long, text string, lang string, score double, gram string").repartition(3)
    model = langid.fit(df)
    got = langid.predict(df, model).collect()
    at = {q["doc_id"]: (q["lang_pred"], q["score"]) for q in got}
    assert len(got) == len(rows) and all(at[d][0] == lang for d, t, lang in rows if lang and t and d is not None)
    assert at[900] == at[901] == at[902] == ("und", 0.0) and at[903][0] == "de" and at[None][0] == "de" and at[904] == ("de", 0.0)
    # the filters hold what plain counting holds, and little else
    from collections import Counter

    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    assert all(q["held_out"] == held(q["doc_id"]) for q in got)
    drawn = [tuple(q) for q in langid._drawn(df, 4, 2, langid.SAMPLE_ROWS).filter("not held_back").select("text", "lang").collect()]
    counts = {lang: Counter(g for t, own in drawn if own == lang and t for w in t.split() for g in langid.grams(w)) for lang in ("de", "en")}
    counts = {lang: Counter({g: n for g, n in c.items() if n >= langid.LEAST}) for lang, c in counts.items()}
    freq = lambda lang, g: counts[lang][g] / sum(counts[lang].values())
    masks = langid.GramMasks(model)
    for bit, lang in enumerate(model.languages):
        taken = {g for g, n in counts[lang].items() if n >= langid.LEAST and freq(lang, g) >= langid.SHARE * max(freq("de", g), freq("en", g))}
        assert all(masks[g] >> 32 * (bit + 1) & 1 for g in taken)
        others = [g for c in counts.values() for g in c if g not in taken]
        assert sum(masks[g] >> 32 * (bit + 1) & 1 for g in others) <= 0.05 * len(others)
    assert langid.predict(df.limit(0), model).count() == 0 and langid.fit(df.limit(0)).languages == []
    assert langid.fit(df, keep=5).table.any() and langid.accepted(df, model).columns == df.columns


def test_langid_learns_from_all_rows(spark):
    """Without a number of rows all training rows are counted or held back, also those of a large language, and what few rows hold is learned."""
    rows = [(i, "of the and" if i % 1500 else "zqx zqx zqx zqx", "en") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert langid._drawn(df, 4, 2, langid.SAMPLE_ROWS).count() == len(train)
    assert langid.GramMasks(langid.fit(df))["zqx"] >> 32 & 1
