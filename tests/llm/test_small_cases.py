"""Hand-written cases of the text operators: nulls, empty tables, ties, repeats, clashing columns, brute force."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwatch.llm import (
    chat_snapshots,
    decontamination,
    language_id,
    line_dedup,
    mixing,
    n_gram_quality,
    near_duplicates,
    pii,
    url_reputation,
    vector_duplicates,
)

DOC = "doc_id long, text string"
RNG = random.Random(3)
WORDS = ["w%d" % i for i in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# line dedup


def test_lines_shared_by_enough_documents_go(spark):
    rows = [(i, f"  Same LINE\t\nown {i}\n\nÉté") for i in range(10)] + [(10, None), (11, ""), (12, "same line\n" * 3 + "rest")]
    out = by_id(line_dedup.drop_shared_lines(spark.createDataFrame(rows, DOC)))
    assert out[0]["kept_text"] == "own 0\n" and (out[0]["n_lines"], out[0]["n_dropped"]) == (4, 2)
    assert (out[10]["kept_text"], out[10]["n_lines"], out[10]["n_dropped"]) == ("", 1, 0)
    assert (out[11]["kept_text"], out[11]["n_lines"]) == ("", 1)
    assert out[12]["kept_text"] == "rest" and out[12]["n_dropped"] == 3


def test_lines_count_documents_not_rows(spark):
    rows = [(1, "x\ny")] * 12 + [(None, "z\nq")] * 12
    out = line_dedup.drop_shared_lines(spark.createDataFrame(rows, DOC)).collect()
    assert len(out) == 24 and all(r["n_dropped"] == 0 for r in out)


def test_lines_other_letters_keep_their_case(spark):
    rows = [(i, "ÉA") for i in range(5)] + [(i, "éa") for i in range(5, 10)]
    assert all(r["n_dropped"] == 0 for r in line_dedup.drop_shared_lines(spark.createDataFrame(rows, DOC)).collect())


def test_lines_empty_table_and_clashing_columns(spark):
    assert line_dedup.drop_shared_lines(spark.createDataFrame([], DOC)).count() == 0
    rows = spark.createDataFrame([(1, "a", 7, "k")], DOC + ", n_lines int, kept_text string")
    out = line_dedup.drop_shared_lines(rows).first()
    assert (out["n_lines"], out["kept_text"]) == (1, "a")


# urls


def test_url_parts_and_rules(spark):
    urls = [
        (1, "http://Example.NET/en/x?q"), (2, "https://a.b.net"), (3, "http://a.b.net/x#y"), (4, "nothing"), (5, None),
        (6, "http://x.org/fr/1"), (7, "http://myexample.com/de/"), (8, "http://www.example.com/de/a"), (9, "ftp://é.ORG?x://y/"),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([], "page_id long, bad int")
    out = by_id(url_reputation.judge_urls(pages, labels), "page_id")
    assert (out[1]["host"], out[1]["path"], out[1]["rule"], out[1]["verdict"]) == ("example.net", "/en/x", "example.net/en/", "allow")
    assert out[2]["rule"] is None and out[3]["rule"] == "net/" and out[3]["verdict"] == "block"
    assert (out[4]["host"], out[4]["path"], out[5]["host"]) == ("", "", "")
    assert out[6]["verdict"] == "allow" and out[7]["rule"] is None and out[8]["verdict"] == "block"
    assert (out[9]["host"], out[9]["path"]) == ("é.org", "")


def test_bad_hosts_are_blocked_only_with_evidence(spark):
    pages = [(i, f"http://bad.one.com/{i}") for i in range(40)] + [(100 + i, f"http://good.two.com/{i}") for i in range(60)]
    pages += [(200, "http://rare.three.com/1")]
    labels = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(60)] + [(200, 1), (200, 1), (None, 1), (5, None)]
    out = by_id(
        url_reputation.judge_urls(
            spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")
        ),
        "page_id",
    )
    assert out[0]["verdict"] == "block" and out[100]["verdict"] == "allow" and len(out) == 101
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_reputation.judge_urls(empty, spark.createDataFrame(labels, "page_id long, bad int")).count() == 0


# chats


def test_prefixes_collapse_into_the_longest(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (3, 2, "user", None)]
    turns += [(4, 0, "user", "a"), (4, 1, "bot", "c"), (5, 0, "user", "a"), (5, 1, "bot", "c"), (None, 0, "user", "z"), (6, None, None, "q")]
    turns += [(1, 0, "user", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1))
    for span in (1, 256):
        out = by_id(chat_snapshots.format_chats(df, span), "conv_id")
        assert set(out) == {3, 4, 6}
        assert out[4]["n_equal"] == 2 and out[3]["n_turns"] == 3
        assert out[3]["rendered"] == "<|user|>\na<|end|>\n<|bot|>\nb<|end|>\n<|user|>\n<|end|>\n"
    assert chat_snapshots.format_chats(df.limit(0)).count() == 0


def test_null_text_is_no_empty_text(spark):
    turns = [(1, 0, "user", None), (2, 0, "user", ""), (2, 1, "bot", "x")]
    out = by_id(chat_snapshots.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")), "conv_id")
    assert set(out) == {1, 2}


# mixing


def targets(sizes, most=3):
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {k: i % 3 + 1 for i, k in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        rest = [k for k in names if k not in held]
        left = total - sum(held.values())
        share = {k: left * weight[k] / sum(weight[j] for j in rest) for k in rest}
        over = [k for k in rest if share[k] > most * sizes[k]]
        if not over:
            return {**share, **held}
        held.update({k: most * sizes[k] for k in over})


@pytest.mark.parametrize("block", [7, 2000])
def test_mix_meets_its_targets(spark, block):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "é", "Z", None] + ["hot"] * 6)) for i in range(900)]
    rows += [(9000, "x y", "tiny"), (9001, None, "none"), (9000, "x y", "tiny")]
    df = spark.createDataFrame(rows, DOC + ", source string").withColumn("sid", F.lit(3)).withColumn("target", F.lit("clash"))
    out = mixing.mix_sources(df, block_rows=block).collect()
    again = mixing.mix_sources(df.repartition(5), block_rows=block).collect()
    key = lambda r: (r["doc_id"], r["size"], r["source"] or "", r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(rows)
    sizes, taken = {}, {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = targets(sizes)
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in want:
        assert abs(taken[s] - want[s]) <= 41


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(spark.createDataFrame([], DOC + ", source string")).count() == 0
    out = mixing.mix_sources(spark.createDataFrame([(1, None, None), (2, " ", "a")], DOC + ", source string")).collect()
    assert [r["taken"] for r in out] == [0, 0] and [r["target"] for r in out] == [0.0, 0.0]


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size, pi = rng.integers(1, 500, 300), np.full(300, 0.37)
    out = mixing.flight(size, pi, 4)
    assert ((out > 1e-6) & (out < 1 - 1e-6)).sum() <= 2
    assert out.sum() == pytest.approx(pi.sum()) and out @ size == pytest.approx(pi @ size)


# language


def test_language_profiles(spark):
    rng = random.Random(8)
    alphabets = {"aa": "abcdef", "bb": "uvwxyz", "cc": "äöüßéè"}
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(30)), lang) for i, (lang, a) in enumerate(list(alphabets.items()) * 20)]
    df = spark.createDataFrame(rows, DOC + ", lang string")
    names, matrix = language_id.prototype_matrix(language_id.learn_prototypes(df))
    odd = [(900, None, "aa"), (901, "12 34 !!", "aa"), (902, "", None), (903, "abc fed " * 60_000, None), (904, "wxu", None)]
    out = by_id(language_id.identify(spark.createDataFrame(rows + odd, DOC + ", lang string").withColumn("score", F.lit("x")), names, matrix))
    assert names == ["aa", "bb", "cc"] and all(out[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [out[i]["lang_pred"] for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    names, matrix = language_id.prototype_matrix(language_id.learn_prototypes(df.limit(0)))
    assert names == [] and language_id.identify(df, names, matrix).first()["lang_pred"] == "und"


def test_pieces_of_a_long_text_add_up(monkeypatch):
    text = prose(500) + " ÉÀ  12 x"
    whole = language_id.gram_counts(text, 64, 3)
    monkeypatch.setattr(language_id, "PIECE", 101)
    parts = language_id.gram_counts(text, 64, 3)
    assert dict(zip(*map(list, whole))) == dict(zip(*map(list, parts)))


# personal data

BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, digits[::-1])))
    return {
        "email": True,
        "ip": all(int(p) <= 255 for p in found.split(".")) if kind == "ip" else None,
        "card": 13 <= len(digits) <= 19 and luhn % 10 == 0,
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def test_base_spans_equal_plain_search(spark):
    rng = random.Random(2)
    marks = list("019.@+- ()aZ_é\n😀") + ["4111 1111 1111 1111", "a@b.c", "1.2.3.4", "+49 (30) 1234567", "a@b.c_x@d.e"]
    texts = ["".join(rng.choice(marks) for _ in range(60)) for _ in range(300)]
    texts += [None, "", "9" * 30_000, "a" * 30_000 + "@", "+1" + " " * 20_000, "1-" * 9_000, "x@y." * 500]
    df = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("base", F.lit("clash"))
    out = by_id(pii.find_pii(df).withColumn("s", pii.span_text(F.col("base"))))
    for i, text in enumerate(texts):
        want = [f"{k}:{m.start()}:{m.end()}" for k, r in BASE for m in r.finditer(text or "") if valid(k, m.group())] if len(text or "") < 20_000 else None
        if want is not None:
            assert out[i]["s"] == ",".join(want), text
    assert pii.find_pii(df.limit(0)).count() == 0


def test_contexts_find_what_patterns_miss(spark):
    rows = [(i, f"hello my ip is 10.0.0.{i} and so on") for i in range(40)] + [(99, "hello my ip is 10.0.0.999 and so on"), (98, "pay 10.0.0.999 now")]
    out = by_id(pii.find_pii(spark.createDataFrame(rows, DOC)))
    assert [tuple(s) for s in out[99]["found"]] == [(1, 15, 25)] and out[98]["found"] == [] and out[0]["found"] == []


# near duplicates


def brute_groups(texts, width, percent):
    sets = {}
    for i, t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    texts = []
    common = prose(60, rng)
    for g in range(25):
        words = prose(rng.randint(30, 120), rng).split()
        for _ in range(rng.randint(1, 8)):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy) + (" " + common if g % 2 else ""))
    hub = prose(150, rng).split()
    for k in range(80):
        copy = list(hub)
        copy[rng.randrange(150)] = f"u{k}"
        texts.append(" ".join(copy))
    texts += ["a b", "A  B\n", "a", None, "", " \t", "x y z w v", "X y z w v"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOC).withColumn("sig", F.lit(1)).withColumn("rid", F.lit("clash"))
    for leaf in (4, 48):
        out = by_id(near_duplicates.near_duplicate_groups(df, width=4, percent=80, leaf=leaf))
        want = brute_groups(rows, 4, 80)
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == want
        assert all(r["kept"] == (i == r["component_id"]) for i, r in out.items())


def matrix_groups(rows, width, percent):
    """As brute_groups, for thousands of texts of one-space words: one matrix product over the shared shingles."""
    sets = [{tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for w in (t.split() for _, t in rows)]
    seen = collections.Counter(itertools.chain.from_iterable(sets))
    column = {x: k for k, x in enumerate(x for x, n in seen.items() if n > 1)}
    held = np.zeros((len(sets), len(column)), dtype=np.float32)
    for i, own in enumerate(sets):
        held[i, [column[x] for x in own if x in column]] = 1
    both, size = held @ held.T, np.array([len(x) for x in sets])
    near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(near, True)
    name = np.array([i for i, _ in rows])
    while True:
        least = np.where(near, name[None, :], name.max()).min(axis=1)
        if (least == name).all():
            return {i: int(c) for (i, _), c in zip(rows, name)}
        name = least


def test_pairs_at_the_limit_pass_large_levels():
    places, similarity, found, pairs = 96, 0.8, 0, 200
    rng = np.random.default_rng(5)
    for _ in range(pairs):
        sig = rng.integers(0, 2**32, (2, places), dtype=np.uint32)
        same = rng.permutation(places)[:77]
        sig[1, same] = sig[0, same]
        for tree in range(10):
            root = near_duplicates.mixed(np.array([tree + 1], dtype=np.uint64) * near_duplicates._MIX)
            nodes = []
            for place in near_duplicates.picks(int(root[0]), places, similarity):
                if sig[0, place] == sig[1, place]:
                    nodes.append(int(near_duplicates.child_names(root, place, sig[:1, place])[0]))
            for _ in range(3):
                ends = []
                for node in nodes:
                    for j, path in enumerate(near_duplicates.paths(node, places, similarity)):
                        a, b = near_duplicates.path_ends(node, path, j, sig)
                        ends += [int(a)] if a == b else []
                nodes = ends
            if nodes:
                found += 1
                break
    assert found >= 0.99 * pairs


def test_pairs_under_a_shared_template_equal_brute_force(spark):
    rng = random.Random(12)
    fresh = (f"w{k}" for k in itertools.count())
    template = list(itertools.islice(fresh, 75))
    texts = []
    for k in range(2_000):
        own = list(itertools.islice(fresh, 25))
        texts.append(template + own)
        if k < 60:
            new = 8 + k % 3  # of 97 shingles so many differ: 0.848, 0.830, 0.813
            texts.append(template + own[:-new] + list(itertools.islice(fresh, new)))
    rows = list(enumerate(map(" ".join, texts)))
    rng.shuffle(rows)
    out = by_id(near_duplicates.near_duplicate_groups(spark.createDataFrame(rows, DOC), width=4, percent=80, leaf=16))
    assert {i: r["component_id"] for i, r in out.items()} == matrix_groups(rows, 4, 80)


@pytest.mark.parametrize("leaf", [4, 48])
def test_a_tail_on_one_member_of_a_large_group(spark, leaf):
    """Texts that are near one of a thousand near copies only, and a chain of texts behind it."""
    rng = random.Random(21)
    fresh = (f"n{k}" for k in itertools.count())

    def changed(words, n):
        out = list(words)
        for at in rng.sample(range(0, len(words), 5), n):
            out[at] = next(fresh)
        return out

    base = [f"b{k}" for k in range(150)]
    texts = [changed(base, rng.randrange(0, 2)) for _ in range(1_000)]
    for _ in range(6):
        member = changed(base, 3)
        texts += [member, tail := changed(member, 3), changed(tail, 3)]
    texts += [[f"x{j}-{k}" for k in range(60)] for j in range(30)]
    rows = list(enumerate(map(" ".join, texts)))
    rng.shuffle(rows)
    out = by_id(near_duplicates.near_duplicate_groups(spark.createDataFrame(rows, DOC), width=4, percent=80, leaf=leaf))
    want = matrix_groups(rows, 4, 80)
    assert len(set(want.values())) < 45
    assert {i: r["component_id"] for i, r in out.items()} == want


def test_nodes_of_some_hundred_classes_are_compared_at_once(spark, monkeypatch):
    rng = random.Random(31)
    fresh = (f"h{k}" for k in itertools.count())
    template = list(itertools.islice(fresh, 75))
    texts = []
    for k in range(300):
        own = list(itertools.islice(fresh, 25))
        texts.append(template + own)
        if k < 20:
            texts.append(template + own[:-8] + list(itertools.islice(fresh, 8)))
    texts += [[f"y{j}-{k}" for k in range(60)] for j in range(200)]
    rows = list(enumerate(map(" ".join, texts)))
    rng.shuffle(rows)

    def no_branches(*_):
        raise AssertionError("a node of some hundred classes branched")

    monkeypatch.setattr(near_duplicates, "branches", no_branches)
    out = by_id(near_duplicates.near_duplicate_groups(spark.createDataFrame(rows, DOC), width=4, percent=80))
    want = matrix_groups(rows, 4, 80)
    assert len(set(want.values())) == 500
    assert {i: r["component_id"] for i, r in out.items()} == want


def test_near_duplicates_edge_tables(spark):
    assert near_duplicates.near_duplicate_groups(spark.createDataFrame([], DOC)).count() == 0
    text = prose(40)
    rows = [(5, text), (3, text), (3, text), (None, text), (8, prose(40))]
    df = spark.createDataFrame(rows, DOC)
    out = near_duplicates.near_duplicate_groups(df).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in out) == [(0, 0, True), (3, 3, True), (3, 3, True), (5, 3, False), (8, 8, True)]
    left = near_duplicates.keep_representatives(df).collect()
    assert sorted((r["doc_id"] or 0) for r in left) == [0, 3, 8]


# vectors


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (0, 1, None):
        centres = rng.standard_normal((12, 16))
        for c in centres:
            for _ in range(rng.integers(1, 9)):
                rows.append((n, [float(x) for x in c + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.25])], label))
                n += 1
    dense = rng.standard_normal(16)
    for _ in range(60):
        rows.append((n, [float(x) for x in dense + rng.standard_normal(16) * 0.05], 1))
        n += 1
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [None] + [1.0] * 15, 1), (n + 4, [], 1), (n + 5, [1.0], 1)]
    good = {i: (label, np.array(v)) for i, v, label in rows[:n] if label is not None}
    linked = {i: {j for j, (m, w) in good.items() if j != i and m == l and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93} for i, (l, v) in good.items()}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("m", F.lit(1))
    out = by_id(vector_duplicates.vector_duplicates(df, tile=16), "vec_id")
    found = sum(r["n_links"] for r in out.values()) / sum(map(len, linked.values()))
    assert 0.97 <= found <= 1 and all(out[i]["n_links"] <= len(linked.get(i, ())) for i in out)
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in range(n, n + 6)) and len(out) == n + 6
    big = [i for i in range(n - 60, n)]
    assert {out[i]["component_id"] for i in big} == {n - 60}
    assert vector_duplicates.vector_duplicates(df.limit(0)).count() == 0


def test_a_pair_found_from_one_side_counts_for_both_ends(spark):
    """Pairs that link with nothing else, at a margin so small that many are met at one home only or at none."""
    rng = np.random.default_rng(14)
    rows = []
    for k in range(400):
        v = rng.standard_normal(24)
        v /= np.linalg.norm(v)
        w = rng.standard_normal(24)
        w -= (w @ v) * v
        for x in (v, 0.94 * v + np.sqrt(1 - 0.94**2) * w / np.linalg.norm(w)):
            rows.append((len(rows), [float(t) for t in x], 0))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = by_id(vector_duplicates.vector_duplicates(df, recall=0.05), "vec_id")
    met = [(out[i], out[i + 1]) for i in range(0, 800, 2)]
    assert all(a["n_links"] == b["n_links"] == int(a["component_id"] == b["component_id"]) for a, b in met)
    assert 0.05 < sum(a["n_links"] for a, _ in met) / 400 < 0.999


def test_the_traversal_visits_all_cells_within_the_margin():
    rng = np.random.default_rng(15)
    rows = rng.standard_normal((500, 12))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    grid = vector_duplicates.Grid(rows, 16, 0.93, 0.9)
    home, visits = grid.visits(rows[:60])
    first, second = grid.halves(rows[:60])
    cost = (first[:, :, None] + second[:, None, :]).reshape(60, -1)
    assert (home == cost.argmin(axis=1)).all()
    for k in range(60):
        assert sorted(visits[k]) == np.flatnonzero(cost[k] <= cost[k].min() + grid.margin).tolist()
        assert (np.diff(first[k][visits[k] // 16]) >= 0).all()


def test_equal_vectors_count_each_other(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in (4, 2, 9)] + [(1, [1.0, 2.0, 3.0], 2), (None, [1.0, 2.0, 3.0], 1), (7, [2.0, 4.0, 6.0], 1)]
    out = by_id(vector_duplicates.vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")), "vec_id")
    assert [(out[i]["n_links"], out[i]["component_id"]) for i in (4, 2, 9, 7, 1)] == [(3, 2)] * 4 + [(0, 1)]


# quality


def labelled(spark, n=240):
    rng = random.Random(6)
    syllables = ["ta", "ri", "mo", "len", "dis", "ka"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(60)) + ".", "xx") for i in range(n)]
    junk = [(1000 + i, "".join(rng.choice("#$%&QZ7!|") for _ in range(300)), "xx") for i in range(20)]
    odd = [(2000, None, "xx"), (2001, "", "xx"), (2002, "anything ### at all", "yy"), (2003, "no language", None), (None, rows[0][1], "xx")]
    docs = spark.createDataFrame(rows + junk + odd + [rows[0]], DOC + ", lang string")
    labels = [(i, 1, 0) for i in range(0, n, 2)] + [(1000, 0, 0), (1, 1, 1), (3, None, None), (4, 0, 0), (None, 1, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_junk_has_high_perplexity(spark):
    docs, labels = labelled(spark)
    for order in (3, 4):
        out = n_gram_quality.score_quality(docs.withColumn("kept", F.lit("clash")), labels, order=order).collect()
        assert len(out) == 240 + 20 + 5 + 1
        kept = {r["doc_id"]: r["kept"] for r in out}
        assert not any(kept[1000 + i] for i in range(20)) and sum(kept[i] for i in range(240)) >= 232
        assert all(kept[i] for i in (2000, 2001, 2002, 2003))
        assert {r["perplexity"] for r in out if r["doc_id"] in (2000, 2001, 2002, 2003)} == {None}
        assert len({r["perplexity"] for r in out if r["doc_id"] == 0}) == 1
    left = n_gram_quality.keep_good(docs, labels)
    assert left.columns == docs.columns and left.where("doc_id = 0").count() == 2
    assert n_gram_quality.score_quality(docs.limit(0), labels).count() == 0
    assert n_gram_quality.score_quality(docs, labels.limit(0)).where("not kept").count() == 0


def test_model_is_a_distribution_and_scores_match_a_plain_walk(spark):
    docs, labels = labelled(spark, 30)
    order, bits = 3, n_gram_quality.BITS
    rows = docs.where("doc_id < 30").select(F.lit("x").alias("lang"), "text", "doc_id")
    model = n_gram_quality.kneser_ney(n_gram_quality.gram_counts(rows, order), order)
    seen = [{r["gram"]: r["lp"] for r in m[0].collect()} for m in model]
    back = [{r["ctx"]: r["lb"] for r in m[1].collect()} for m in model]

    def lp(key, k):
        if k == 0:
            return -bits * np.log(2)
        part = key & ((1 << bits * k) - 1)
        return seen[k - 1][part] if part in seen[k - 1] else back[k - 1].get(part >> bits, 0.0) + lp(key, k - 1)

    for ctx in list(back[2])[:5]:
        assert sum(np.exp(lp(ctx << bits | s, 3)) for s in range(1 << bits)) == pytest.approx(1.0, abs=1e-9)
    text = "tamo rika ### Q"
    one = spark.createDataFrame([(1, 2, "x", text)], "_k1 long, _k2 long, lang string, text string")
    got = n_gram_quality.sharded_scores(one, n_gram_quality.model_rows(model, order, 4), order, 4, 2).first()["lp"]
    keys, _ = n_gram_quality.grams([text], order)
    assert got == pytest.approx(sum(lp(int(k), 3) for k in keys))


# decontamination


def test_passages_with_items_are_found(spark):
    rng = random.Random(9)
    items = [(i, prose(rng.randint(20, 50), rng)) for i in range(60)] + [(60, None), (61, " "), (62, "two words")]
    docs = [(i, prose(rng.randint(1, 900), rng)) for i in range(120)]
    held = {}
    for i in range(0, 120, 7):
        k = rng.randrange(60)
        words = docs[i][1].split()
        at = rng.randrange(len(words))
        docs[i] = (i, " ".join(words[:at] + [items[k][1].upper()] + words[at:]))
        held[i] = k
    half = items[5][1].split()
    docs += [(500, None), (501, ""), (502, " ".join(half[: len(half) // 2])), (503, "so two words here"), (None, items[3][1])]
    df = spark.createDataFrame(docs, DOC).withColumn("item_id", F.lit("clash"))
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, table).collect()}
    assert found == {*held.items(), (None, 3), (503, 62)}
    clean = decontamination.clean_documents(df, table)
    assert clean.columns == df.columns and clean.count() == len(docs) - len(held) - 2
    assert decontamination.contaminated(df, table.limit(0)).count() == 0
    assert decontamination.contaminated(df.limit(0), table).count() == 0


@pytest.mark.parametrize("size", [24, 60, 128, 300, 1_000])
def test_items_of_any_length_are_found(spark, size):
    """Held word for word, with question and answer far apart, and in part, as a plain count of shingles says."""
    rng = random.Random(size)
    many = [f"v{k}" for k in range(5_000)]
    text = lambda n: [rng.choice(many) for _ in range(n)]
    items = [text(size) for _ in range(12)]
    docs = []
    for k, item in enumerate(items):
        half = size // 2
        docs.append(text(100) + item + text(300))
        docs.append(item[half:] + text(700) + item[:half])
        docs.append(item[:half] + text(200))
        docs.append(text(50) + item[: -size // 20] + text(60))
        docs.append(text(400))

    def shingle_set(words):
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}

    want = set()
    for d, words in enumerate(docs):
        have = shingle_set(words)
        for k, item in enumerate(items):
            parts = [shingle_set(item[: size // 2]), shingle_set(item[size // 2 :])]
            if all(len(p & have) >= 0.8 * len(p) for p in parts):
                want.add((d, k))
    assert len(want) >= 24
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], f"{name} long, text string")
    found = decontamination.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want


def test_ten_thousand_items_are_one_scan(spark):
    rng = random.Random(8)
    many = [f"v{k}" for k in range(20_000)]
    items = [[rng.choice(many) for _ in range(20)] for _ in range(10_000)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = list(decontamination.indexes(table, 5))
    assert len(found) == 1
    docs = [(k, " ".join([rng.choice(many) for _ in range(300)] + items[k * 97])) for k in range(40)]
    hits = decontamination.contaminated(spark.createDataFrame(docs, DOC), table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in hits} == {(k, k * 97) for k in range(40)}


def test_wand_loses_nothing_and_several_indexes_agree(spark, monkeypatch):
    rng = random.Random(10)
    items = [(i, [w.encode() for w in prose(rng.randint(5, 40), rng).split()]) for i in range(90)]
    df = {}
    for _, w in items:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    index = decontamination.Index(items, df, 90, 20.0, 5)
    dense = np.zeros((len(index.terms), 90))
    for t in range(len(index.terms)):
        run = slice(index.post_start[t], index.post_start[t + 1])
        dense[t, index.post_item[run]] = index.post_weight[run]
    for _ in range(200):
        terms = np.unique(rng.choices(range(len(index.terms)), k=60))
        want = np.flatnonzero(dense[terms].sum(axis=0) >= 0.3).tolist()
        assert index.retrieve(np.zeros(len(terms), dtype=np.int64), terms, 1, 0.3) == set(want)
    table = spark.createDataFrame([(i, b" ".join(w).decode()) for i, w in items], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(50, rng) + " " + b" ".join(items[i][1]).decode()) for i in range(30)], DOC)
    pairs = lambda: {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, table).collect()}
    one = pairs()
    monkeypatch.setattr(decontamination, "INDEX_WORDS", 600)
    assert pairs() == one >= {(i, i) for i in range(30)}
