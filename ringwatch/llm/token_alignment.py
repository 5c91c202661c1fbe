"""Which tokens of two tokenizers stand for the same stretches of text, counted over all documents.

Both tokenizers cut the same bytes. Offsets where tokens of both end cut a text into groups; every
token of A in a group is linked with every token of B there. A pair of ids is worth the number of
documents that hold it linked anywhere.

Documents are numbered in blocks of a task. Per block and pair there is one posting: bit planes
over the document numbers, where plane j holds the documents whose number of links has bit j set.
The planes OR-merged are the documents of the pair and their popcount its count; popcounts
weighted by plane are its links. A plane is a sorted list of numbers or a bitmap, whichever is
shorter. Blocks share no document, so counts of a pair add up over its postings, and only these
counts meet in a shuffle by pair. The postings then take the count of their pair back to their
block, where every plane adds it to the documents it holds.

The byte tokenizer is read from its JSON. Where its ids follow its merges and a text has only
characters below U+0180, an encoder that merges by rank gives the same ids in a quarter of the
time; other texts go through the tokenizer itself. Groups are expanded into links in slices, so a
group of any length takes bounded memory.

Edge cases: null and empty texts, and texts whose joined token bytes differ from space and text,
have no tokens: zeros and an empty digest. Every row is a document of its own, also where doc_id
is null or repeated. An empty table gives no rows. Other columns are not read.
"""

import functools
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch.llm.common import with_missing
from ringwatch.session import cut_lineage

FOLDER = "/opt/tokenizers"
BYTE_MODEL = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
CHUNK_CHARS = 1_000_000
SLICE_LINKS = 2_000_000
BLOCK_DOCS = 8_192
BLOCK_POSTINGS = 2_000_000
#: how the byte tokenizer cuts a text before it merges; a fixed value of that kind of tokenizer
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteTokenizer:
    """Encodes with a byte-level BPE file; `pieces` has the bytes of every id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        self.pieces = [b""] * self.whole.get_vocab_size()
        for token, i in vocabulary.items():
            self.pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.ranks = None
        merged = [m if isinstance(m, list) else m.split(" ") for m in merges]
        if all(vocabulary.get(a + b) == 256 + k for k, (a, b) in enumerate(merged)):
            import tiktoken

            known = {self.pieces[i]: i for i in range(256 + len(merged))}
            self.ranks = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=known, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranks is None:
            return [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]
        return [
            self.ranks.encode_ordinary(t) if t.isascii() or max(t) < "ƀ" else self.whole.encode(t, add_special_tokens=False).ids
            for t in texts
        ]


class PieceTokenizer:
    """Encodes with a sentence-piece file, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.whole.get_piece_size()
        names = [self.whole.id_to_piece(i) for i in range(size)]
        self.pieces = [
            bytes([int(n[3:5], 16)]) if self.whole.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.whole.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=2)
def byte_tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


@functools.lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


def offsets(counts: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs of these lengths begins, and the end of the last."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def written(ids: np.ndarray, seps: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The decimal ids, each followed by its separator, and the length of each with it."""
    width = len(str(int(ids.max()))) if len(ids) else 1
    cells = np.empty((len(ids), width + 1), dtype=np.uint8)
    shown = np.ones((len(ids), width + 1), dtype=bool)
    for k in range(width):
        power = 10 ** (width - 1 - k)
        cells[:, k] = ids // power % 10 + ord("0")
        if power > 1:
            shown[:, k] = ids >= power
    cells[:, width] = seps
    return cells[shown].tobytes(), shown.sum(axis=1)


class Aligned:
    """The groups of several texts at once: texts follow each other, and each ends with a cut."""

    def __init__(self, a: list[list[int]], b: list[list[int]], len_a: np.ndarray, len_b: np.ndarray):
        self.a, self.b = (np.fromiter((i for ids in x for i in ids), dtype=np.int64, count=sum(map(len, x))) for x in (a, b))
        self.n_a, self.n_b = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (a, b))
        end_a, end_b = np.cumsum(len_a[self.a]), np.cumsum(len_b[self.b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=len(cuts)), np.bincount(self.group_b, minlength=len(cuts))
        self.text_of_a = np.repeat(np.arange(len(a)), self.n_a)
        self.text_of_group = self.text_of_a[offsets(self.in_a)[:-1]] if len(cuts) else np.empty(0, dtype=np.int64)
        self.n_groups = np.bincount(self.text_of_group, minlength=len(a))
        self.n_links = np.zeros(len(a), dtype=np.int64)
        np.add.at(self.n_links, self.text_of_group, self.in_a * self.in_b)

    def digests(self) -> list[str]:
        """SHA-256 per text of its groups, written `a1,a2|b1;a3|b2,b3`; empty without tokens."""
        last_a = np.append(np.diff(self.group_a) > 0, True)
        last_b = np.append(np.diff(self.group_b) > 0, True)
        before_b, before_a = offsets(self.in_b), offsets(self.in_a)
        place_a = np.arange(len(self.a)) + before_b[self.group_a]
        place_b = np.arange(len(self.b)) + before_a[self.group_b + 1]
        n = len(self.a) + len(self.b)
        ids, seps = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        seps[place_a] = np.where(last_a[: len(self.a)], ord("|"), ord(","))
        seps[place_b] = np.where(last_b[: len(self.b)], ord(";"), ord(","))
        text, lengths = written(ids, seps)
        ends = offsets(lengths)[offsets(self.n_a + self.n_b)]
        return [hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def links(self, n_ids_b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slices of all links: the pair (id of A * n_ids_b + id of B) and the number of the text."""
        each, first_b = self.in_b[self.group_a], offsets(self.in_b)
        ends = np.cumsum(each)
        lo = 0
        while lo < len(self.a):
            done = int(ends[lo - 1]) if lo else 0
            hi = max(int(np.searchsorted(ends, done + SLICE_LINKS, "right")), lo + 1)
            n = each[lo:hi]
            inside = np.arange(int(n.sum())) - np.repeat(offsets(n)[:-1], n)
            b = self.b[np.repeat(first_b[self.group_a[lo:hi]], n) + inside]
            yield np.repeat(self.a[lo:hi], n) * n_ids_b + b, np.repeat(self.text_of_a[lo:hi], n)
            lo = hi


def packed_plane(docs: np.ndarray, n_docs: int) -> bytes:
    """A set of document numbers: their count in two bytes, then the sorted numbers or, if shorter, a bitmap."""
    head = np.uint16(len(docs)).tobytes()
    if 2 * len(docs) <= (n_docs + 7) // 8:
        return head + docs.astype(np.uint16).tobytes()
    bits = np.zeros(n_docs, dtype=np.uint8)
    bits[docs] = 1
    return head + np.packbits(bits, bitorder="little").tobytes()


def packed_posting(docs: np.ndarray, links: np.ndarray, n_docs: int) -> bytes:
    """The planes of the numbers of links of these documents, lowest bit first."""
    top = int(links.max()).bit_length()
    return b"".join(packed_plane(docs[(links >> j) & 1 == 1], n_docs) for j in range(top))


def planes_of(posting: bytes, n_docs: int) -> Iterator[np.ndarray]:
    """The document numbers of each plane."""
    at, width = 0, (n_docs + 7) // 8
    while at < len(posting):
        n = posting[at] | posting[at + 1] << 8
        size = min(2 * n, width)
        body = posting[at + 2 : at + 2 + size]
        yield np.frombuffer(body, dtype=np.uint16) if 2 * n <= width else np.flatnonzero(np.unpackbits(np.frombuffer(body, dtype=np.uint8), bitorder="little"))
        at += 2 + size


def merged(planes: list[np.ndarray]) -> np.ndarray:
    """The documents in any of the planes."""
    return functools.reduce(np.union1d, planes) if planes else np.empty(0, dtype=np.uint16)


ROW = "block long, n_docs int, doc_no int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, docs long, links long, planes binary"
_DOC = ["doc_no", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_POSTING = ["pair", "docs", "links", "planes"]


@dataclass
class Alignment:
    """`docs`: block, doc_no, doc_id and the document's own numbers; `postings`: block, n_docs, pair,
    docs, links, planes. A pair is id of A * n_ids_b + id of B."""

    docs: DataFrame
    postings: DataFrame
    n_ids_b: int


class Block:
    """Postings of the documents numbered so far."""

    def __init__(self):
        self.n, self.keys, self.links, self.size = 0, [], [], 0

    def add(self, pair: np.ndarray, doc: np.ndarray) -> None:
        key, links = np.unique(pair << 16 | doc, return_counts=True)
        self.keys.append(key)
        self.links.append(links)
        self.size += len(key)

    def postings(self) -> Iterator[tuple[int, int, int, bytes]]:
        if not self.size:
            return
        key, links = np.concatenate(self.keys), np.concatenate(self.links)
        order = np.argsort(key, kind="stable")
        key, links = key[order], links[order]
        first = np.flatnonzero(np.append(True, np.diff(key) != 0))
        key, links = key[first], np.add.reduceat(links, first)
        pair, doc = key >> 16, key & 0xFFFF
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(pair) != 0)), len(pair)).tolist()
        sums = np.add.reduceat(links, cuts[:-1]).tolist()
        for lo, hi, total in zip(cuts[:-1], cuts[1:], sums):
            yield int(pair[lo]), hi - lo, total, packed_posting(doc[lo:hi], links[lo:hi], self.n)


def align(docs: DataFrame, folder: str = FOLDER, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> Alignment:
    """Tokenise every text with both tokenizers and write the documents' numbers and the postings."""
    path_a, path_b = f"{folder}/{byte_model}", f"{folder}/{piece_model}"
    n_ids_b = len(piece_tokenizer(path_b).pieces)
    names = [c.split()[0] for c in ROW.split(", ")]
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    types = {c.split()[0]: kinds[c.split()[1]] for c in ROW.split(", ")}

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], types[c]) if c in columns else pa.nulls(n, types[c]) for c in names], names)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_tokenizer(path_a), piece_tokenizer(path_b)
        len_a, len_b = (np.fromiter(map(len, t.pieces), dtype=np.int64, count=len(t.pieces)) for t in (a, b))
        number, block = TaskContext.get().partitionId() << 32, Block()

        def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
            ids, texts, chars = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                ids.append(doc_id)
                texts.append(text)
                chars += len(text)
                if chars >= CHUNK_CHARS or len(texts) >= 1024:
                    yield ids, texts
                    ids, texts, chars = [], [], 0
            if texts:
                yield ids, texts

        def finished() -> Iterator[pa.RecordBatch]:
            out, size = [], 0
            for posting in block.postings():
                out.append(posting)
                size += len(posting[3]) + 40
                if size > 8_000_000:
                    yield of_block(out)
                    out, size = [], 0
            if out:
                yield of_block(out)

        def of_block(out: list) -> pa.RecordBatch:
            return rows(len(out), block=[number] * len(out), n_docs=[block.n] * len(out), **dict(zip(_POSTING, zip(*out))))

        for batch in batches:
            for ids, texts in chunks(batch):
                with_space = [" " + t for t in texts]
                in_a, in_b = a.encode(with_space), b.encode(texts)
                for k, text in enumerate(with_space):
                    raw = text.encode()
                    same = len(raw) > 1 and all(b"".join(map(t.pieces.__getitem__, x)) == raw for t, x in ((a, in_a[k]), (b, in_b[k])))
                    if not same:
                        in_a[k], in_b[k] = [], []
                found = Aligned(in_a, in_b, len_a, len_b)
                for pair, text in found.links(n_ids_b):
                    block.add(pair, text + block.n)
                yield rows(
                    len(ids), block=[number] * len(ids), doc_no=np.arange(block.n, block.n + len(ids)), doc_id=ids, n_a=found.n_a, n_b=found.n_b,
                    n_groups=found.n_groups, n_links=found.n_links, groups_sha256=found.digests(),
                )
                block.n += len(ids)
                if block.n >= BLOCK_DOCS or block.size >= BLOCK_POSTINGS:
                    yield from finished()
                    number, block = number + 1, Block()
        yield from finished()

    docs = with_missing(docs, doc_id="long", text="string")
    made = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tokenise, ROW))
    return Alignment(
        made.where("pair is null").select("block", *_DOC), made.where("pair is not null").select("block", "n_docs", *_POSTING), n_ids_b
    )


def pair_counts(found: Alignment) -> DataFrame:
    """(pair, id_a, id_b, docs, links): in how many documents the ids are linked, and how often."""
    counts = found.postings.groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    pair, n = F.col("pair"), F.lit(found.n_ids_b)
    return counts.select("pair", F.floor(pair / n).cast("long").alias("id_a"), F.pmod(pair, n).cast("long").alias("id_b"), "docs", "links")


def scored_documents(found: Alignment) -> DataFrame:
    """The documents with n_best (links whose pair has the highest count of its id of A) and
    count_sum (the counts of all links added up)."""
    counts = cut_lineage(pair_counts(found))
    # one row for each id of A: no more than its vocabulary has
    best = counts.groupBy("id_a").agg(F.max("docs").alias("most"))
    worth = counts.join(F.broadcast(best), "id_a").select("pair", F.col("docs").alias("worth"), (F.col("docs") == F.col("most")).alias("top"))
    back = found.postings.select("pair", "block", "n_docs", "planes").join(worth, "pair")
    back = back.repartition("block").sortWithinPartitions("block").select("block", "n_docs", "planes", "worth", "top")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, best = None, None, None

        def finished() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), now)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(total[at])], ["block", "doc_no", "n_best", "count_sum"]
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "n_docs", "planes", "worth", "top")]
            for block, n_docs, planes, worth, top in zip(*columns):
                if block != now:
                    if now is not None:
                        yield finished()
                    now, total, best = block, np.zeros(n_docs, dtype=np.int64), np.zeros(n_docs, dtype=np.int64)
                for j, docs in enumerate(planes_of(planes, n_docs)):
                    total[docs] += worth << j
                    if top:
                        best[docs] += 1 << j
        if now is not None:
            yield finished()

    scores = back.mapInArrow(add_up, "block long, doc_no int, n_best long, count_sum long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    own = [c for c in _DOC if c != "doc_no"]
    return found.docs.join(scores, ["block", "doc_no"], "left").select(*own[:-1], zero("n_best"), zero("count_sum"), own[-1])
