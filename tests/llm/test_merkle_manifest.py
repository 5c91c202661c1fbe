"""The manifest against a plain tree in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ringwatch.llm import merkle_manifest
from ringwatch.llm.queries import LLM_QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return digest(*map(field, (*row[:4], text)))


def levels_of(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def plain_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[4]), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by_source[s].sort(key=lambda x: x[:3])
    trees = {s: levels_of([x[2] for x in by_source[s]]) for s in order}
    top, out = levels_of([trees[s][-1][0] for s in order]), []
    for k, s in enumerate(order):
        for p, (_, _, leaf, row) in enumerate(by_source[s]):
            siblings, doc_id, text = [], row[0], row[4]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            at = leaf_of(row, text)
            for levels, pos in ((trees[s], p), (top, k)):
                for level in levels[:-1]:
                    first = pos // 16 * 16
                    left, right = level[first:pos], level[pos + 1 : first + 16]
                    siblings += left + right
                    at, pos = digest(*left, at, *right), pos // 16
            root = top[-1][0]
            out.append((doc_id, leaf, trees[s][-1][0], root, digest(*siblings), at, at == root))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_manifest_of_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    got = LLM_QUERIES["op11_merkle_manifest"](spark, sf_dir).collect()
    assert ordered(got) == ordered(plain_manifest([tuple(r) for r in docs.collect()]))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_nulls_repeats_lone_leaves_and_clashing_columns(spark):
    rows = [
        (i, f"s{i % 40}" if i % 3 else None, None if i % 7 == 0 else "x", i if i % 5 else None, None if i % 11 == 0 else "Aé" * i)
        for i in range(700)
    ]
    rows += [(None, "s1", "e", 1, "Q")] * 2 + [(5, "s5", "e", 1, "Q")] * 20 + [(5, "s5", "e", 1, "R"), (9, "lone", "", 0, ""), (10, "", "", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("rank", "n", "leaf", "tree", "children", "digest"):
        df = df.withColumn(c, F.lit("clash"))
    assert ordered(merkle_manifest.audited_manifest(df).collect()) == ordered(plain_manifest(rows))


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "a", "e", 1, f"T{i}") for i in range(n)]
    got = merkle_manifest.audited_manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert ordered(got) == ordered(plain_manifest(rows) if n else [])


def test_proofs_of_a_few_leaves_visit_their_runs_only(spark):
    docs = spark.range(3000).select("id", F.lit("a").alias("source"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    manifest = merkle_manifest.build_manifest(docs.select("source", "doc_id", "leaf"))
    asked = manifest.leaves.where("doc_id in (5, 6, 2999)").select("tree", "rank", "leaf")
    assert merkle_manifest.descend(manifest, asked).count() == 2
    out = merkle_manifest.prove(manifest, asked).select(merkle_manifest.folded_up(F.col("leaf"), F.col("proof")).alias("up")).collect()
    assert [r["up"] for r in out] == [manifest.root] * 3
