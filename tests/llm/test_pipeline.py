"""The pipeline's stages, one by one and in a row, against plain versions on a small corpus."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orecart.llm import langid, packing, toxicity

EN = "the cat sat on mat while dog ran far away from old house near river bank under bright moon and then slept".split()
DE = "der hund lief über straße und brücke durch nacht am alten fluss wo katzen schlafen bis morgen kommt".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with toxic ones, junk, exact and near copies, a long one, nulls, and ids that occur twice; their labels."""
    r, root = random.Random(31), tmp_path_factory.mktemp("corpus")
    text = lambda words, n: " ".join(r.choices(words, k=n))
    rows = [(i, text(EN, r.randint(20, 80)), "en") for i in range(500)] + [(500 + i, text(DE, r.randint(20, 80)), "de") for i in range(300)]
    toxic = [(1000 + i, f"{text(EN, 12)} {r.choice(['vileterm', 'nastyword'])} {text(EN, 8)}", "en") for i in range(200)]
    junk = [(2000 + i, " ".join("".join(r.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(40)), None) for i in range(10)] + [(2100, None, "en"), (2101, "", "en"), (2102, "1 2 3", "en")]
    copies = [(3000 + i, rows[i][1], "en") for i in range(0, 60, 3)]
    base = [text(EN, 70).split() for _ in range(12)]
    near = [(3200 + 10 * k + j, " ".join([*b[: 5 * j], "word", *b[5 * j + 1 :]]), "en") for k, b in enumerate(base) for j in range(4)]
    long = [(4000, text(EN, 9000), "en"), (7, text(EN, 50), "en"), (8, rows[8][1], "en"), (None, rows[9][1], "en")]
    rows += toxic + junk + copies + near + long
    r.shuffle(rows)
    docs = spark.createDataFrame([(*x, f"s{k % 3}", len(x[1] or "")) for k, x in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(d, 1, int(1000 <= d < 1200)) for d, _, _ in rows if d is not None and d % 2 == 0 and d < 2000], "doc_id long, quality int, toxic int")
    docs.repartition(3).write.parquet(f"file://{root}/documents.parquet")
    labels.write.parquet(f"file://{root}/labels.parquet")
    return f"file://{root}"


def pairs(df):
    return sorted((str(r["doc_id"]), r["text"] or "") for r in df.select("doc_id", "text").collect())


def test_toxic_rows_go(spark, corpus):
    docs, labels = spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet")
    got = corpus_pipeline.harmless(spark, docs, corpus)
    assert got.columns == docs.columns
    model = toxicity.fit(docs, labels)
    words = toxicity.WordWeights(model)
    rows = docs.collect()
    assert pairs(got) == sorted((str(r["doc_id"]), r["text"] or "") for r in rows if toxicity.raw_score(r["text"], words, model.bias) < toxicity.THRESHOLD)
    gone = {r["doc_id"] for r in rows} - {r["doc_id"] for r in got.collect()}
    assert gone == set(range(1000, 1200))


def test_rows_without_a_language_go(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    got = corpus_pipeline.in_a_language(spark, docs, corpus)
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in got.collect()}
    assert got.columns == docs.columns and gone == {*range(2000, 2010), 2100, 2101, 2102}
    model = langid.fit(docs)
    floors, words = langid.floors(docs, model), langid.WordCounts(model)

    def stays(text):
        lang, score, n = langid.judge(text, words, model)
        floor = floors.get(lang, 0.0)
        return score > 0 and score >= floor - langid.SLACK * (floor * (1 - floor) / n) ** 0.5

    assert pairs(got) == sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect() if stays(r["text"]))


def plain_one_of_each(rows):
    """Rows (doc_id, text) that stay, by comparing all pairs."""
    import hashlib

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    named = sorted({(d, t or "") for d, t in rows if d is not None}, key=lambda x: (x[0], hashlib.md5(x[1].encode()).hexdigest()))
    sets = [shingles(t) for _, t in named]
    group = list(range(len(named)))
    for i in range(len(named)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return sorted([(str(d), t) for k, (d, t) in enumerate(named) if group[k] == k] + [("None", t or "") for d, t in rows if d is None])


def test_one_of_each_group_stays(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").filter("doc_id is null or doc_id < 300 or doc_id >= 2000")
    got = corpus_pipeline.one_of_each(spark, docs, corpus)
    assert got.columns == docs.columns and pairs(got) == plain_one_of_each([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_whole_run(spark, corpus):
    """Every stage works on all that the one before kept; the last packs them whole."""
    import public_tokenizers
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, corpus).collect(), docs.schema)
    rows, tok = docs.collect(), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in rows:
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID]
        want += [(str(r["doc_id"]), k, s, zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, corpus)
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["ids_crc32"]) for r in got.collect()) == sorted(want)
    full = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 4096 for r in full) and len(full) <= -(-sum(r["n"] for r in full) // 4096) + 1
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), corpus).count() == 0


def test_entry_without_the_corpus_operators(tmp_path):
    """With the folders and the pipeline deleted the other queries stay."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    os.makedirs(tmp_path / "copy/orecart/llm/__pycache__")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"], cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
    assert said.stdout.split()[0] > "40" and said.stdout.split()[1] == "False"
