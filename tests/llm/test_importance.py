"""Importance resampling against plain Python, on small tables with nulls, ties and odd words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stagewise.llm import importance
from stagewise.llm.queries import op11_importance

SCHEMA = "doc_id long, text string, weight string, n_words int, row int, part int, place string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def buckets_of(text, buckets):
    words = words_of(text)
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(docs, target, percent, least, buckets, seed):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets_of(text, buckets))
    for text in target:
        t.update(buckets_of(text, buckets))
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets)
                                       / ((s[b] + 1.0) * (all_t + buckets))))
            for b in range(buckets)]
    rows = []
    for doc, text in docs:
        found = buckets_of(text, buckets)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, len(found), weight, score, len(words_of(text)) >= least))
    able = sorted((r for r in rows if r[4]),
                  key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[:percent * len(able) // 100]
    ranked = [r[:4] + (i,) for i, r in enumerate(drawn, 1)]
    return ranked + [r[:4] + (None,) for r in able[len(drawn):] + [r for r in rows if not r[4]]]


def text(rng, n):
    pool = ["the", "The", "of", "Größe", "naïve", "x1", "été", "日本", "Z" * 40, "q" * 300]
    marks = [" ", ", ", "-", "\n", "\x00", "~", "’ "]
    return "".join(rng.choice(pool) + rng.choice(marks) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    docs = [(d, text(rng, rng.randint(0, 60))) for d in range(120)]
    return docs + [docs[7], docs[7], (7, docs[8][1]), (200, None), (201, ""), (None, docs[9][1]),
                   (202, "!!! ... \n"), (203, text(rng, 40_000)), (204, "w" * 200_000 + " a")]


def as_rows(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()),
                  key=repr)


@pytest.mark.parametrize("buckets, least", [(10_000, 20), (7, 1)])
def test_against_brute_force(spark, rows, buckets, least):
    target = [text(random.Random(3), 50), None, "the of, THE été", ""]
    docs = spark.createDataFrame([(d, t, "x", 1, 1, 1, "x") for d, t in rows], SCHEMA).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = as_rows(importance.resample(docs, goal, 25, least, buckets, 7))
    want = sorted(brute(rows, target, 25, least, buckets, 7), key=repr)
    assert got == want


def test_crcs_are_those_of_zlib():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts = rng.integers(0, 4000, 700)
    sizes = rng.integers(0, 300, 700)
    want = [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(starts, sizes)]
    assert importance.crcs(data, starts, sizes).tolist() == want


def test_slabs_do_not_change_counts(monkeypatch):
    rng = random.Random(5)
    texts = [text(rng, rng.randint(0, 30)).encode() for _ in range(50)]
    whole, sizes, words = importance.features(texts, 1000)
    monkeypatch.setattr(importance, "SLAB", 100)
    parts = [importance.features(texts[a:b], 1000) for a, b in importance._slabs(texts)]
    assert len(parts) > 5
    assert Counter(np.concatenate([p[0] for p in parts]).tolist()) == Counter(whole.tolist())
    assert np.concatenate([p[1] for p in parts]).tolist() == sizes.tolist()
    assert np.concatenate([p[2] for p in parts]).tolist() == words.tolist()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    got = importance.resample(some, none).collect()
    assert [(r.n_features, r["rank"]) for r in got] == [(5, None)]


def test_query_on_the_test_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    goal = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert as_rows(op11_importance(spark, folder)) == sorted(
        brute(docs, goal, 25, 20, 10_000, 7), key=repr)
