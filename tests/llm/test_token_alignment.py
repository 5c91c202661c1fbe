"""The alignment of two tokenizers against a plain count of all links."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwatch.llm import token_alignment as ta
from ringwatch.llm.queries import LLM_QUERIES

pytestmark = pytest.mark.skipif(not os.path.exists(f"{ta.FOLDER}/{ta.BYTE_MODEL}"), reason="no vocabulary files")


def plain_alignment(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) by nested loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{ta.FOLDER}/{ta.BYTE_MODEL}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{ta.FOLDER}/{ta.PIECE_MODEL}")
    letters = ta.byte_letters()

    def bytes_a(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    held, docs, best = Counter(), [], defaultdict(int)
    for doc_id, text in rows:
        ids = ([], [])
        if text:
            raw = (" " + text).encode()
            ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
            if b"".join(map(bytes_a, ids[0])) != raw or b"".join(map(bytes_b, ids[1])) != raw:
                ids = ([], [])
        ends = [list(np.cumsum([len(f(i)) for i in x])) for f, x in zip((bytes_a, bytes_b), ids)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side in (0, 1):
            k = 0
            for i, end in zip(ids[side], ends[side]):
                while end > cuts[k]:
                    k += 1
                groups[k][side].append(i)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(links.keys())
        docs.append((doc_id, ids, groups, links))
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, ids, groups, links in docs:
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append(
            (doc_id, len(ids[0]), len(ids[1]), len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]),
             sum(n * held[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest() if shown else "")
        )
    return out, held, docs


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_alignment_of_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = LLM_QUERIES["op13_token_alignment"](spark, sf_dir)
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(got.collect()) == ordered(plain_alignment([tuple(r) for r in docs.collect()])[0])


ODD = [
    None, "", " ", "a", "<|endoftext|> <s></s> <unk>", "tab\tline\n\r\n  two  spaces ", "▁x ▁", "日本語のテキスト", "Привет, мир! ١٢٣", "👩‍👩‍👧 é é  x　y",
    "<0x41> \x00\x01\x7f", "don't we'll I'M 12345.678", "x" * 3000, "日" * 2000, "ﬁ ① �", "ſ Ǆ ƿ \u0085   ​",
]


def test_alignment_of_odd_texts_nulls_repeats_and_clashing_columns(spark):
    rng = random.Random(5)
    letters = "ab é\t\n.,'<|>1▁日Ж "
    rows = list(enumerate(ODD)) + [(None, "twice"), (None, "twice"), (3, "a"), (3, "b")]
    rows += [(100 + k, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 200)))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash")).withColumn("pair", F.lit(1.5))
    want, held, docs = plain_alignment(rows)
    found = ta.align(df)
    assert ordered(ta.scored_documents(found).collect()) == ordered(want)
    total = Counter()
    for d in docs:
        total.update(d[3])
    got = {(r["id_a"], r["id_b"]): (r["docs"], r["links"]) for r in ta.pair_counts(found).collect()}
    assert got == {p: (n, total[p]) for p, n in held.items()}
    assert ta.scored_documents(ta.align(df.limit(0))).count() == 0


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    rows = [(k, f"word{k % 7} and thenti onent{k % 3} " * (k % 5)) for k in range(60)]
    a, b = ta.byte_tokenizer(f"{ta.FOLDER}/{ta.BYTE_MODEL}"), ta.piece_tokenizer(f"{ta.FOLDER}/{ta.PIECE_MODEL}")
    in_a, in_b = a.encode([" " + t for _, t in rows]), b.encode([t for _, t in rows])
    in_a = [x if t else [] for x, (_, t) in zip(in_a, rows)]
    found = ta.Aligned(in_a, in_b, *(np.array([len(p) for p in t.pieces]) for t in (a, b)))
    whole = [np.concatenate(x) for x in zip(*found.links(32000))]
    monkeypatch.setattr(ta, "SLICE_LINKS", 5)
    cut = list(found.links(32000))
    assert len(cut) > 20 and all((x == np.concatenate(y)).all() for x, y in zip(whole, zip(*cut)))
    block = ta.Block()
    block.n = 60
    for pair, text in cut:
        block.add(pair, text)
    seen = Counter()
    for pair, docs, links, planes in block.postings():
        parts = list(ta.planes_of(planes, 60))
        assert len(ta.merged(parts)) == docs and sum(len(p) << j for j, p in enumerate(parts)) == links
        for j, p in enumerate(parts):
            for doc in p.tolist():
                seen[pair, doc] += 1 << j
    assert seen == Counter(zip(whole[0].tolist(), whole[1].tolist()))


def test_planes_in_both_forms():
    rng = np.random.default_rng(1)
    for n in (1, 8, 9, 9000):
        for share in (0.001, 0.5, 1):
            docs = np.flatnonzero(rng.random(n) < share)
            if len(docs):
                links = rng.integers(1, 9, len(docs))
                back = list(ta.planes_of(ta.packed_posting(docs, links, n), n))
                assert (ta.merged(back) == docs).all() and sum(len(p) << j for j, p in enumerate(back)) == links.sum()


def test_ranks_give_the_ids_of_the_file():
    rng = random.Random(2)
    tokenizer = ta.byte_tokenizer(f"{ta.FOLDER}/{ta.BYTE_MODEL}")
    assert tokenizer.ranks is not None
    letters = [chr(c) for c in range(1, 0x180)]
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(4000)]
    texts += ["".join(rng.choices("ab '\t\n \u0085stvrelmd1.", k=rng.randrange(1, 40))) for _ in range(4000)]
    assert [e.ids for e in tokenizer.whole.encode_batch(texts, add_special_tokens=False)] == tokenizer.encode(texts)
