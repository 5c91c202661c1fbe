"""Repeated spans against a plain search of all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ringwatch.llm import repeated_spans as rs

SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_cut(rows, k=20):
    """(doc_id, n_words, n_removed, kept_sha256) by looking at every window in order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.sha256(" ".join(words(rows[i][1])).encode()).hexdigest()))
    seen, out = set(), []
    for i in order:
        w = words(rows[i][1])
        stay = [True] * len(w)
        for p in range(len(w) - k + 1):
            window = tuple(w[p : p + k])
            if window in seen:
                stay[p : p + k] = [False] * k
            seen.add(window)
        kept = " ".join(x for x, s in zip(w, stay) if s)
        out.append((rows[i][0], len(w), stay.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def texts(rng):
    vocabulary = [f"W{i}" for i in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [prose(n) for n in (20, 21, 25, 60, 140)]
    out = []
    for k in range(120):
        parts = prose(rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            lo = rng.randrange(0, 10)
            parts += p[lo : lo + rng.randrange(15, 150)] + prose(rng.randrange(0, 15))
        out.append(parts)
    base = prose(200)
    for k in range(30):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(200)] = f"new{k}"
        out.append(copy)
    out += [["a"] * 19, ["a"] * 20, ["a"] * 21, ["a"] * 100, ["a", "b"] * 60, ["a", "b", "c"] * 40 + ["a"] * 30]
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("seed, block", [(1, 1_000_000), (2, 300)])
def test_spans_equal_all_windows(spark, seed, block, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_ROWS", block)
    monkeypatch.setattr(rs, "BROADCAST_BYTES", 0 if block == 300 else rs.BROADCAST_BYTES)
    rng = random.Random(seed)
    found = texts(rng)
    rows = [(i * 7 % 1000, t) for i, t in enumerate(found)]
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, found[3].replace(" ", " \n\t")), (5004, found[3]), (-9, found[40]), (None, found[5]), (None, found[6] + " x")]
    rows += [(7, found[0] + " same id"), (6000, found[50]), (6000, found[50]), (6001, "é ü " * 30), (6001, "é ü " * 30)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for c in ("num", "key", "row", "rank", "n"):
        df = df.withColumn(c, F.lit("clash"))
    assert Counter(map(tuple, rs.without_repeats(df).collect())) == plain_cut(rows)


def test_small_windows_equal_all_windows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))) for i in range(200)]
    for window, width in ((4, 2), (6, 1), (5, 4)):
        out = rs.without_repeats(spark.createDataFrame(rows, SCHEMA), window, width).collect()
        assert Counter(map(tuple, out)) == plain_cut(rows, window)


def test_listed_spans_are_in_their_sources(spark):
    rng = random.Random(4)
    rows = list(enumerate(texts(rng)))
    out = rs.repeated_spans(spark.createDataFrame(rows, SCHEMA)).collect()
    w = {i: words(t) for i, t in rows}
    assert len(out) > 50
    for r in out:
        assert (r["source_doc_id"], r["source_start"]) < (r["doc_id"], r["start"]) and r["n_words"] >= 20
        assert w[r["doc_id"]][r["start"] : r["start"] + r["n_words"]] == w[r["source_doc_id"]][r["source_start"] : r["source_start"] + r["n_words"]]


def test_long_passages_are_one_path(spark):
    passage = " ".join(f"p{i}" for i in range(200))
    rows = [(i, f"own{i} " * 25 + passage + f" end{i}" * 25) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    docs, _, firsts, _ = rs.prepared(df, 20, 8)
    named = firsts.select("num", "doc_id", "key", rs.text_mark(F.col("key")).alias("mark"))
    marks = named.join(rs.repeated_anchors(docs, 20, 8), "mark").drop("mark")
    found = rs.stretches(rs.repeated_windows(rs.windows(rs.texts_with(docs, marks, "places", 4), 20, 8)))
    paths = rs.compact(found.where("kind = 0").select("place", "nodes")).collect()
    assert max(r["n"] for r in paths) == 181
    listed = rs.repeated_spans(df).where("source_doc_id <> doc_id").groupBy("doc_id").agg(F.min("start").alias("s"), F.max(F.col("start") + F.col("n_words")).alias("e")).collect()
    assert len(listed) == 39 and all((r["s"], r["e"]) == (25, 225) for r in listed)


def test_empty_table(spark):
    assert rs.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert rs.repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0
