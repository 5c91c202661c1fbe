"""Repeated spans of words across and within documents, by a compacted De Bruijn graph.

A window of k words is an edge from the node of its first k - 1 words to that of its last k - 1;
the two 64-bit node names together name the window. Only windows that can repeat become edges:
every window selects the smallest hash among its runs of ANCHOR words, equal windows select equal
runs, so a window whose run is selected nowhere else occurs once. Documents of the same words are
one text from the start.

Anchors and windows are compared in blocks of texts first. A block sends an anchor, or a window,
that it has seen more than once only from its first place (and, of an anchor, its last), so a
passage that many documents share has a row per block and not one per document; the other places in
the block are known to repeat. One shuffle then finds the first place of every window.

The first places of repeated windows are runs of edges in their documents. A join on nodes cuts
them where more than one repeated edge leads in or out: what is left are nonbranching paths with
one source each. The other places of a document that lie in step with their sources are spans; a
join by source place lays them along the paths. Spans are removed, the source of a path stays.

Edge cases: null and empty texts have no words. Texts shorter than a window are kept whole. The
order of documents is that of doc_id, rows without one last; different texts of one doc_id are
ordered by a digest of their words. Rows that repeat doc_id and words keep one of them. An empty
table gives no rows; other columns are not read. A text may hold 2^26 words.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwatch.llm.common import counted, ranked, with_missing
from ringwatch.session import cut_lineage

WINDOW = 20
ANCHOR = 8
PLACE_BITS = 26
#: flags above the 61 bits of a place: the block holds more of this window; a later place in its block
TWICE, LATER = 1 << 62, 1 << 61
BLOCK_ROWS = 1_000_000
BROADCAST_BYTES = 32_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordNames(dict):
    """64-bit hashes of words seen so far; starts anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; bytes split at the ASCII spaces only."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if len(words) >> PLACE_BITS:
        raise ValueError(f"a text of {len(words)} words; at most 2^{PLACE_BITS} can be numbered")
    return words


def names_of(words: list[bytes], known: WordNames) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def runs(names: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of `width` words."""
    n = len(names) - width + 1
    out = np.full(max(n, 0), width, dtype=np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * _ODD + names[k : k + n]
        out = (out ^ (out >> np.uint64(29))) * _MIX
    return out ^ (out >> np.uint64(32))


def anchors(grams: np.ndarray, window: int, width: int) -> np.ndarray:
    """For each window the place of the smallest of its runs, the leftmost of equal ones."""
    inside = window - width + 1
    if len(grams) < inside:
        return np.empty(0, dtype=np.int64)
    return np.arange(len(grams) - inside + 1) + np.lib.stride_tricks.sliding_window_view(grams, inside).argmin(axis=1)


def text_key() -> Column:
    return F.xxhash64(F.lit(29), F.col("text"))


def text_mark(key: Column | None = None) -> Column:
    """The part of a text's key that leaves room for a place."""
    return F.shiftrightunsigned(text_key() if key is None else key, PLACE_BITS + 1)


def word_sequences(docs: DataFrame) -> DataFrame:
    """(row, doc_id, key, n_words, words_sha256): every row, named by number and by a hash of its text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "key", "n_words", "words_sha256"]
            )

    rows = docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(read, "doc_id long, key long, n_words long, words_sha256 string")
    return cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))


def first_texts(rows: DataFrame, window: int) -> DataFrame:
    """(num, row, doc_id, key, words_sha256): the first row of each sequence of words, numbered in order from 0."""
    late = F.col("doc_id").isNull()
    firsts = rows.where(F.col("n_words") >= window).groupBy("words_sha256").agg(
        F.min(F.struct(late.alias("late"), "doc_id", "key", "row")).alias("r")
    )
    firsts = firsts.select("words_sha256", "r.late", "r.doc_id", "r.key", "r.row")
    return cut_lineage(ranked(firsts, [], ["late", "doc_id", "words_sha256"]).select(F.col("rank").alias("num"), "row", "doc_id", "key", "words_sha256"))


def repeated_anchors(docs: DataFrame, window: int, width: int) -> DataFrame:
    """(mark, places): places of anchors that are selected at other places too, per mark of a text.

    A mark is short, so texts may share one; they then have places marked in vain. Equal texts have
    the same mark and places and do not count as two.
    """

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = WordNames(), [], 0

        def block() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(held), axis=0)  # by gram, then by code
            gram, code = pairs[:, 0], pairs[:, 1]
            start = np.append(True, gram[1:] != gram[:-1])
            end = np.append(start[1:], True)
            again = ~(start & end)
            # the first and the last place speak for the block, all places of such a gram are known (a negative code)
            name = np.concatenate([gram[start | end], runs((gram ^ code)[again], 1)])
            both = np.concatenate([code[start | end], code[again] | np.uint64(1 << 63)])
            return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(both.view(np.int64))], ["gram", "code"])

        for batch in batches:
            for mark, text in zip(batch.column("mark").to_pylist(), batch.column("text")):
                words = words_of(text.as_py())
                if len(words) < window:
                    continue
                grams = runs(names_of(words, known), width)
                places = np.unique(anchors(grams, window, width))
                held.append(np.column_stack([grams[places], np.uint64(mark << PLACE_BITS) | places.astype(np.uint64)]))
                size += len(places)
                if size >= BLOCK_ROWS:
                    yield block()
                    held, size = [], 0
        if size:
            yield block()

    found = docs.select(text_mark().alias("mark"), "text").mapInArrow(select, "gram long, code long")
    of_gram = Window.partitionBy("gram")
    found = found.withColumn("n", F.max("code").over(of_gram) != F.min("code").over(of_gram)).where("code < 0 or n")
    place = F.col("code").bitwiseAND((1 << PLACE_BITS) - 1).cast("int")
    mark = F.shiftright(F.col("code").bitwiseAND(2**63 - 1), PLACE_BITS)
    return found.groupBy(mark.alias("mark")).agg(F.collect_set(place).alias("places"))


def texts_with(docs: DataFrame, facts: DataFrame, listed: str, item_bytes: int) -> DataFrame:
    """Facts (doc_id, key and others) with the texts they belong to.

    `facts` is a written table. It goes to the texts if its size, by the items it lists, is within the
    bound; else the texts it names are shuffled to it.
    """
    size = facts.agg(F.sum(F.size(listed) * item_bytes + 64)).first()[0] or 0
    texts = docs.select("doc_id", text_key().alias("key"), "text")
    named = facts.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    if size <= BROADCAST_BYTES:
        named = F.broadcast(named)
    else:
        texts = texts.join(counted(facts.select("key").distinct()), "key", "left_semi")
    return texts.join(named, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id", "_key")


def windows(texts: DataFrame, window: int, width: int) -> DataFrame:
    """(u, v, place): the windows that select a repeated anchor, those of a block at their first place there,
    flagged TWICE if the block holds more of them. These are flagged LATER, and u is the first place.
    """

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_known, held, size = WordNames(), [], 0

        def block() -> pa.RecordBatch:
            u, v, place = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((place, v, u))
            u, v, place = u[order], v[order], place[order]
            new = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))
            first = place[np.flatnonzero(new)][np.cumsum(new) - 1]
            again = ~new & (place != first)
            keep = new | again
            twice = new & (np.bincount(np.cumsum(new) - 1, weights=again) > 0)[np.cumsum(new) - 1]
            u, v = np.where(again, first.astype(np.uint64), u), np.where(again, np.uint64(0), v)
            place = place | np.where(twice, TWICE, 0) | np.where(again, LATER, 0)
            return pa.RecordBatch.from_arrays([pa.array(c[keep].view(np.int64)) for c in (u, v, place)], ["u", "v", "place"])

        for batch in batches:
            for num, text, places in zip(batch.column("num").to_pylist(), batch.column("text"), batch.column("places")):
                names = names_of(words_of(text.as_py()), names_known)
                marked = np.zeros(len(names) + 1, dtype=bool)
                at = places.values.to_numpy()
                marked[at[at < len(names)]] = True
                at = np.flatnonzero(marked[anchors(runs(names, width), window, width)])
                nodes = runs(names, window - 1)
                held.append((nodes[at], nodes[at + 1], at + (num << PLACE_BITS)))
                size += len(at)
                if size >= BLOCK_ROWS:
                    yield block()
                    held, size = [], 0
        if size:
            yield block()

    return texts.select("num", "text", "places").mapInArrow(follow, "u long, v long, place long")


def repeated_windows(found: DataFrame) -> DataFrame:
    """(place, a, b, kind): all places of windows that occur more than once. The first of all (kind 0) has its
    nodes as a and b, the others have an earlier place as a: the first of all (1) or of their block (2)."""
    of_window = Window.partitionBy("u", "v")
    place, later = F.col("place").bitwiseAND(LATER - 1), F.col("place").bitwiseAND(LATER) != 0
    first, last, flags = F.min("at").over(of_window), F.max("at").over(of_window), F.max("place").over(of_window)
    marked = found.withColumns({"at": place, "later": later}).withColumns({"first": first, "again": (last > first) | (flags >= TWICE)})
    kind = F.when(F.col("later"), 2).when(F.col("at") == F.col("first"), 0).otherwise(1)
    return marked.where("later or again").select(
        F.col("at").alias("place"), F.when(kind == 1, F.col("first")).otherwise(F.col("u")).alias("a"), F.when(kind == 0, F.col("v")).otherwise(F.lit(0)).alias("b"), kind.alias("kind")
    )


def stretches(marked: DataFrame) -> DataFrame:
    """(kind, place, n, source, nodes): neighbouring windows of one kind, a text at a time.

    Later windows go together while their sources follow each other as they do; first windows are
    runs of edges, kept as their n + 1 nodes.
    """
    ordered = marked.withColumn("num", F.shiftright("place", PLACE_BITS)).repartition("num").sortWithinPartitions("num", "place", "kind").drop("num")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(place, a, b, kind) -> pa.RecordBatch:
            # rows that repeat doc_id and text give a place twice
            new = np.append(True, np.diff(place) != 0)
            place, a, b, kind = place[new], a[new], b[new], kind[new]
            step = (np.diff(place) == 1) & (np.diff(kind) == 0) & ((kind[1:] == 0) | (np.diff(a) == 1))
            at = np.flatnonzero(np.append(True, ~step))
            n = np.diff(np.append(at, len(place)))
            first = kind[at] == 0
            lengths = np.where(first, n + 1, 0)
            ends = np.cumsum(lengths)
            nodes = np.empty(int(lengths.sum()), dtype=np.int64)
            own = kind == 0
            run = np.repeat(np.arange(len(at)), n)[own]
            nodes[(np.arange(len(place)) - np.repeat(at, n))[own] + (ends - lengths)[run]] = a[own]
            nodes[ends[first] - 1] = b[(at + n - 1)[first]]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(nodes))
            columns = [pa.array(kind[at]), pa.array(place[at]), pa.array(n), pa.array(np.where(first, place[at], a[at])), lists]
            return pa.RecordBatch.from_arrays(columns, ["kind", "place", "n", "source", "nodes"])

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(batch.column(c).to_numpy() for c in ("place", "a", "b", "kind"))
            if rest is not None:
                now = tuple(np.concatenate(x) for x in zip(rest, now))
            text = now[0] >> PLACE_BITS
            whole = int(np.searchsorted(text, text[-1]))
            if whole:
                yield out(*(x[:whole] for x in now))
            rest = tuple(x[whole:] for x in now)
        if rest is not None:
            yield out(*rest)

    return ordered.select("place", "a", "b", F.col("kind").cast("int").alias("kind")).mapInArrow(collect, "kind int, place long, n long, source long, nodes array<long>")


def compact(runs_of_edges: DataFrame) -> DataFrame:
    """(place, n): nonbranching paths of n repeated edges, at their first place.

    `runs_of_edges` (place, nodes) holds every repeated edge once, at its first place. A path goes on
    over a node if one repeated edge leads in and one out; it also ends where first places do.
    """
    last = F.size("nodes") - 1
    each = runs_of_edges.select("place", last.alias("last"), F.posexplode("nodes").alias("i", "node"))
    degrees = each.groupBy("node").agg(F.count_if(F.col("i") > 0).alias("n_in"), F.count_if(F.col("i") < F.col("last")).alias("n_out"))
    branching = degrees.where("n_in > 1 or n_out > 1").select("node")
    cuts = each.where("i > 0 and i < last").join(branching, "node").groupBy("place").agg(F.array_sort(F.collect_set("i")).alias("cuts"))
    none = F.array().cast("array<int>")
    ends = F.concat(F.array(F.lit(0)), F.coalesce("cuts", none), F.array(last))
    parts = runs_of_edges.join(cuts, "place", "left").select("place", ends.alias("ends"))
    part = F.explode(F.zip_with(F.slice("ends", 1, F.size("ends") - 1), F.slice("ends", 2, F.size("ends") - 1), lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))))
    return parts.select("place", part.alias("p")).select((F.col("place") + F.col("p.lo")).alias("place"), (F.col("p.hi") - F.col("p.lo")).cast("long").alias("n"))


def on_paths(spans: DataFrame, paths: DataFrame) -> DataFrame:
    """(place, n, source): spans cut at the ends of the paths that their sources lie on.

    Both are listed under stretches of 1,024 places; an overlap counts under the one it begins in.
    """
    bucket = lambda c: F.explode(F.sequence(F.shiftright(c, 10), F.shiftright(F.col(c) + F.col("n") - 1, 10)))
    left = spans.select("place", "n", "source", bucket("source").alias("bucket"))
    right = paths.select(F.col("place").alias("path"), F.col("n").alias("length"), bucket("place").alias("bucket"))
    lo, hi = F.greatest("source", "path"), F.least(F.col("source") + F.col("n"), F.col("path") + F.col("length"))
    met = left.join(right, "bucket").where((lo < hi) & (F.shiftright(lo, 10) == F.col("bucket")))
    return met.select((F.col("place") + lo - F.col("source")).alias("place"), (hi - lo).alias("n"), lo.alias("source"))


def found_spans(docs: DataFrame, firsts: DataFrame, window: int, width: int) -> DataFrame:
    """(num, at): per text that has any the sorted stretches (start, n, source) to remove."""
    named = firsts.select("num", "doc_id", "key", text_mark(F.col("key")).alias("mark"))
    marks = cut_lineage(named.join(repeated_anchors(docs, window, width), "mark").drop("mark"))
    found = cut_lineage(stretches(repeated_windows(windows(texts_with(docs, marks, "places", 4), window, width))))
    paths = compact(found.where("kind = 0").select("place", "nodes"))
    # the first place in a block is no source of a path, but an earlier place of the same words
    spans = on_paths(found.where("kind = 1"), paths).unionByName(found.where("kind = 2").select("place", "n", "source"))
    num = F.shiftright("place", PLACE_BITS)
    one = F.struct((F.col("place") - F.shiftleft(num, PLACE_BITS)).alias("start"), "n", "source")
    return cut_lineage(spans.groupBy(num.alias("num")).agg(F.array_sort(F.collect_list(one)).alias("at")))


def cut_texts(texts: DataFrame, window: int) -> DataFrame:
    """(num, n_removed, kept_sha256, kept): texts without the words of their stretches."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, sha, kept = [], [], []
            for text, at in zip(batch.column("text"), batch.column("at").to_pylist()):
                words = words_of(text.as_py())
                change = np.zeros(len(words) + 1, dtype=np.int64)
                for s in at:
                    change[s["start"]] += 1
                    change[s["start"] + s["n"] + window - 1] -= 1
                stay = np.cumsum(change[:-1]) == 0
                rest = b" ".join(w for w, k in zip(words, stay.tolist()) if k)
                gone.append(len(words) - int(stay.sum()))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("num"), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], ["num", "n_removed", "kept_sha256", "kept"])

    return texts.select("num", "text", "at").mapInArrow(cut, "num long, n_removed long, kept_sha256 string, kept string")


def prepared(docs: DataFrame, window: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = with_missing(docs, doc_id="long", text="string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = word_sequences(docs)
    firsts = first_texts(rows, window)
    return docs, rows, firsts, found_spans(docs, firsts, window, width)


def repeated_spans(docs: DataFrame, window: int = WINDOW, width: int = ANCHOR) -> DataFrame:
    """(doc_id, start, n_words, source_doc_id, source_start): stretches of words that also start earlier.

    Documents of the same words as an earlier one are not listed: all of their words go.
    """
    _, _, firsts, found = prepared(docs, window, width)
    listed = found.select("num", F.explode("at").alias("s"))
    listed = listed.withColumn("source_num", F.shiftright("s.source", PLACE_BITS))
    ids = lambda num, name: firsts.select(F.col("num").alias(num), F.col("doc_id").alias(name))
    return listed.join(ids("num", "doc_id"), "num").join(ids("source_num", "source_doc_id"), "source_num").select(
        "doc_id", F.col("s.start").alias("start"), (F.col("s.n") + (window - 1)).cast("long").alias("n_words"), "source_doc_id",
        (F.col("s.source") - F.shiftleft("source_num", PLACE_BITS)).alias("source_start"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, width: int = ANCHOR) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 of the words kept, joined by one space."""
    docs, rows, firsts, found = prepared(docs, window, width)
    marked = found.join(firsts.select("num", "doc_id", "key"), "num")
    parts = cut_texts(texts_with(docs, cut_lineage(marked), "at", 40), window).select("num", "n_removed", "kept_sha256")
    # rows that repeat doc_id and text are cut alike, and one of them is the first
    parts = parts.dropDuplicates(["num"])
    named = cut_lineage(firsts.select("words_sha256", "num", F.col("row").alias("first_row")).join(parts, "num", "left"))
    nothing = F.sha2(F.lit(""), 256)
    copy = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    return rows.join(named, "words_sha256", "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
    )
