"""Find documents that hold benchmark items, with BM25 and block-max WAND.

The question (first half of an item's words) and the answer (second half), each cut into pieces of
at most PIECE words, are the entries of an index: for every term a posting list of entries with
its BM25 weight, divided by the weight that the entry gives itself, so one threshold serves entries
of all lengths. Postings are cut in blocks of entries, and the largest weight of each block is
kept per term.

Every passage (a window of words, twice as long as a piece and overlapping the next by half, so any
piece lies whole in one) of every document is a query. A passage whose terms' largest weights add
up to less than the threshold is passed over; then the same with the largest weights of each
block; only entries of blocks that may reach the threshold are scored. Nothing above the
threshold is lost. An item is retrieved when a piece of its question and one of its answer are,
in whatever passages of the document. Hits are verified on the whole document: question and
answer must both share the given part of their word shingles with it.

One index holds all items up to INDEX_WORDS words, its bound as it goes to the tasks; documents are
scanned once for each such index. Document frequencies are those of all items together.

Edge cases: items without words are no items; an item of fewer than two shingles' words is one
entry, question and answer at once. Documents without text hold nothing. Repeated items are
items of their own. Rows of documents are told apart by content (doc_id and text).
"""

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch.llm.common import SPACE, counted, lower_ascii, replacing, two_hashes, with_missing
from ringwatch.session import cut_lineage

WIDTH = 5
OVERLAP = 0.8
RETRIEVE = 0.5
PASSAGE = 128
BLOCK = 8
K1, B = 1.2, 0.75
PIECE = PASSAGE // 2
INDEX_WORDS = 1_000_000
CELLS = 500_000


def parts_of(words: list[bytes], width: int) -> list[set[bytes]]:
    """The shingles of question and answer."""
    half = len(words) // 2
    cut = lambda w: {b" ".join(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))}
    return [cut(words[:half]), cut(words[half:])] if half >= width else [cut(words)] * 2


def entries_of(words: list[bytes], width: int, piece: int = PIECE) -> list[tuple[int, list[bytes]]]:
    """The pieces of question (side 1) and answer (side 2); both sides at once (3) if they are too short to part."""
    half = len(words) // 2
    sides = [(1, words[:half]), (2, words[half:])] if half >= width else [(3, words)]
    out = []
    for side, own in sides:
        n = -(-len(own) // piece)
        out += [(side, own[len(own) * k // n : len(own) * (k + 1) // n]) for k in range(n)]
    return out


class Index:
    """BM25 weights of entries: term maxima, block maxima and postings, all relative to the entry's own score."""

    def __init__(self, items: list[tuple[int, list[bytes]]], df: dict[bytes, int], n_items: int, mean_words: float, width: int):
        self.ids = [i for i, _ in items]
        self.n_blocks = -(-len(items) // BLOCK)
        self.terms: dict[bytes, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for at, (_, words) in enumerate(items):
            counts = Counter(words)
            norm = K1 * (1 - B + B * len(words) / mean_words)
            weight = {t: math.log1p((n_items - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in counts.items()}
            own = sum(weight.values())
            for term, w in weight.items():
                k = self.terms.setdefault(term, len(self.terms))
                if k == len(postings):
                    postings.append([])
                postings[k].append((at, w / own))
        self.post_item = np.array([i for p in postings for i, _ in p], dtype=np.int64)
        self.post_weight = np.array([w for p in postings for _, w in p])
        self.post_start = np.cumsum([0, *map(len, postings)])
        term = np.repeat(np.arange(len(postings)), np.diff(self.post_start))
        # the largest weight per term and block, kept as sorted runs like the postings themselves
        pair, back = np.unique(term * self.n_blocks + self.post_item // BLOCK, return_inverse=True)
        top = np.zeros(len(pair))
        np.maximum.at(top, back, self.post_weight)
        self.block_at, self.block_top = pair % self.n_blocks, top
        self.block_start = np.searchsorted(pair // self.n_blocks, np.arange(len(postings) + 1))
        self.term_top = np.zeros(len(postings))
        np.maximum.at(self.term_top, term, self.post_weight)

    def _runs(self, start: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each term's run of entries: the number of the term in `terms`, and the places of the entries."""
        size = start[terms + 1] - start[terms]
        which = np.repeat(np.arange(len(terms)), size)
        return which, np.arange(len(which)) + np.repeat(start[terms] - np.cumsum(size) + size, size)

    def retrieve(self, window: np.ndarray, term: np.ndarray, n: int, least: float) -> set[int]:
        """Entries whose score against one of `n` passages, given as distinct (window, term), reaches `least`."""
        # a passage whose terms' largest weights do not reach the threshold needs no further look
        wide = np.bincount(window, weights=self.term_top[term], minlength=n) >= least
        window, term = window[wide[window]], term[wide[window]]
        which, at = self._runs(self.block_start, term)
        cell = window[which] * self.n_blocks + self.block_at[at]
        wide = np.bincount(cell, weights=self.block_top[at], minlength=n * self.n_blocks) >= least
        some = wide.reshape(n, self.n_blocks).any(axis=1)
        window, term = window[some[window]], term[some[window]]
        which, at = self._runs(self.post_start, term)
        window, item = window[which], self.post_item[at]
        mine = wide[window * self.n_blocks + item // BLOCK]
        pair, back = np.unique(window[mine] * len(self.ids) + item[mine], return_inverse=True)
        score = np.bincount(back, weights=self.post_weight[at][mine], minlength=len(pair))
        return set((pair[score >= least] % len(self.ids)).tolist())

    def search(self, words: list[bytes], passage: int, least: float) -> set[int]:
        """Entries that some passage of a document retrieves."""
        found = np.fromiter(map(self.terms.get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))
        at = np.flatnonzero(found >= 0)
        if not len(at):
            return set()
        step = passage // 2
        n = max(-(-(len(words) - step) // step), 1)
        # a word lies in the window that starts at its stride and in the one before
        stride, term = at // step, found[at]
        window = np.concatenate([np.minimum(stride, n - 1), np.maximum(stride - 1, 0)])
        pair = np.unique(window * len(self.term_top) + np.concatenate([term, term]))
        window, term = pair // len(self.term_top), pair % len(self.term_top)
        out: set[int] = set()
        # passages that cannot reach the threshold make no cells
        wide = np.bincount(window, weights=self.term_top[term], minlength=n) >= least
        term, window = term[wide[window]], (np.cumsum(wide) - 1)[window[wide[window]]]
        n, some = int(wide.sum()), max(CELLS // self.n_blocks, 1)
        cuts = [*np.searchsorted(window, np.arange(0, n, some)).tolist(), len(window)]
        for k, (lo, hi) in enumerate(itertools.pairwise(cuts)):
            if lo < hi:
                out |= self.retrieve(window[lo:hi] - k * some, term[lo:hi], min(some, n - k * some), least)
        return out


class Items:
    """The index of the pieces of items, and what verifies a hit."""

    def __init__(self, items: list[tuple[int, list[bytes]]], df: dict[bytes, int], n_items: int, mean_words: float, width: int):
        self.ids, self.words, self.width = [i for i, _ in items], [w for _, w in items], width
        entries = [(k, side, piece) for k, (_, w) in enumerate(items) for side, piece in entries_of(w, width)]
        self.index = Index([(k, piece) for k, _, piece in entries], df, n_items, mean_words, width)
        self.side = [side for _, side, _ in entries]
        self.parts: dict[int, list[set[bytes]]] = {}

    def search(self, words: list[bytes], passage: int, least: float) -> list[int]:
        """Items of which the passages retrieve a piece of either side."""
        sides: dict[int, int] = {}
        for entry in self.index.search(words, passage, least):
            item = self.index.ids[entry]
            sides[item] = sides.get(item, 0) | self.side[entry]
        return sorted(item for item, both in sides.items() if both == 3)

    def verify(self, words: list[bytes], item: int) -> list[float]:
        """The shares of the question's and the answer's shingles that the document has."""
        if item not in self.parts:
            self.parts[item] = parts_of(self.words[item], self.width)
        wanted = self.parts[item][0] | self.parts[item][1]
        size = max(len(next(iter(wanted)).split()), 1)
        first = {s.split(b" ", 1)[0] for s in wanted}
        have = {b" ".join(words[i : i + size]) for i, w in enumerate(words) if w in first}
        return [len(p & have) / len(p) for p in self.parts[item]]


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII spaces, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words): items with at least one word."""
    words = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"[^{SPACE}]+"), F.lit(0))
    return with_missing(items, item_id="long", text="string").select(F.col("item_id").cast("long").alias("item_id"), words.alias("words")).where("size(words) > 0")


def indexes(items: DataFrame, width: int) -> Iterator[Items]:
    """Indexes of bounded size over all items, one after the other."""
    whole = cut_lineage(item_words(items).withColumn("n", F.size("words").cast("long")))
    total = whole.agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("words")).first()
    if not total["items"]:
        return
    runs = -(-total["words"] // INDEX_WORDS)
    mean = total["words"] / total["items"]
    for run in range(runs):
        own = whole.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(runs)) == run)
        rows = sorted(
            (r["item_id"] if r["item_id"] is not None else -1, [w.encode() for w in r["words"]]) for r in own.select("item_id", "words").collect()
        )
        if rows:
            terms = own.select(F.explode(F.array_distinct("words")).alias("t")).distinct()
            df = whole.select(F.explode(F.array_distinct("words")).alias("t")).join(terms, "t", "left_semi").groupBy("t").count()
            yield Items(rows, {r["t"].encode(): r["count"] for r in df.collect()}, total["items"], mean, width)


def search_documents(docs: DataFrame, index: Items, passage: int, least: float, overlap: float) -> DataFrame:
    """(_k1, _k2, doc_id, item_id, question, answer): verified hits of one index."""
    schema = pa.schema(
        [("_k1", pa.int64()), ("_k2", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("question", pa.float64()), ("answer", pa.float64())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows, item, question, answer = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                words = words_of(text.as_py())
                for hit in index.search(words, passage, least) if words else ():
                    q, a = index.verify(words, hit)
                    if q >= overlap and a >= overlap:
                        rows.append(i)
                        item.append(index.ids[hit])
                        question.append(q)
                        answer.append(a)
            keys = batch.select(["_k1", "_k2", "doc_id"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*keys.columns, pa.array(item, pa.int64()), pa.array(question, pa.float64()), pa.array(answer, pa.float64())], schema=schema
            )

    return docs.mapInArrow(search, "_k1 long, _k2 long, doc_id long, item_id long, question double, answer double")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    width: int = WIDTH,
    overlap: float = OVERLAP,
    retrieve: float = RETRIEVE,
    passage: int = PASSAGE,
) -> DataFrame:
    """(_k1, _k2, doc_id, item_id, question, answer): every item found in a document, rows named by content."""
    k1, k2 = two_hashes(F.col("doc_id"), F.col("text"))
    docs = with_missing(docs, doc_id="long", text="string").select(
        k1.alias("_k1"), k2.alias("_k2"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    found = [cut_lineage(search_documents(docs, index, passage, retrieve, overlap)) for index in indexes(items, width)]
    if not found:
        return docs.sparkSession.createDataFrame([], "_k1 long, _k2 long, doc_id long, item_id long, question double, answer double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that hold no item, as they are."""
    docs = replacing(with_missing(docs, doc_id="long", text="string"), "_k1", "_k2")
    hit = counted(contaminated(docs, items, **options).select("_k1", "_k2").distinct())
    k1, k2 = two_hashes(F.col("doc_id"), F.col("text"))
    return docs.withColumns({"_k1": k1, "_k2": k2}).join(hit, ["_k1", "_k2"], "left_anti").drop("_k1", "_k2")
