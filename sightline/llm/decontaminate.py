"""Benchmark decontamination: n-gram seeds, then local alignment.

Texts and benchmark items become words (lower case, ASCII punctuation between them) and words become 64-bit hashes. One pass over
all documents looks up every SEED-word shingle among the items' shingles and cuts out the passages around the hits; so texts are
read once and never shuffled. Every item that shares a seed with a passage is a candidate, whichever seed it is: the rarest one
that the two share finds the pair, and no frequency rules a seed out, as an edited copy may keep common ones only. An item goes
before alignment only if too few of its words occur in the passage for any alignment to reach the similarity. Smith-Waterman
alignment over words decides: similarity is the share of the item's words that the best local alignment matches.

Defined results: null or wordless texts and items match nothing. Items of fewer than SEED words
are too short to tell a copy from common speech and match nothing. Repeated
rows give one row per (doc_id, item_id), the best; rows of a null doc_id count as one document. Extra columns are ignored, empty tables give an empty
table. The items are broadcast up to MAX_SEEDS words of them (at most 32 bytes each), and passages are aligned where they are read;
beyond that every shingle of the documents is joined instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.windows import Hasher
from sightline.sources.shared import written

SEED, SIMILARITY, MAX_SEEDS = 5, 0.8, 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = np.array([chr(b).isalnum() or b > 127 for b in range(256)])
_PUNCTUATION = re.compile(rb"\xe2\x80[\x90-\xaf]|\xc2[\xa0-\xbf]")  # general punctuation and Latin-1 signs
_BLOCK = 1 << 20


def word_hashes(text: str | None, hasher: Hasher) -> np.ndarray:
    """A 64-bit hash for each word of a text; a very long text is hashed in blocks that end between words."""
    if not text:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(_PUNCTUATION.sub(lambda m: b" " * len(m[0]), text.lower().encode()), np.uint8)
    word = _WORD[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    out, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
        hasher.load(raw[start[i] : end[j - 1]])
        out[i:j] = hasher.span(start[i:j] - start[i], end[i:j] - start[i])
        i = j
    return out.view(np.int64)


def shingles(words: np.ndarray, n: int = SEED) -> np.ndarray:
    """Hash of each n neighbouring words; fewer words are one shingle."""
    if not len(words):
        return words
    w, out = words.view(np.uint64), None
    k = max(1, len(w) - n + 1)
    for i in range(min(n, len(w))):
        part = w[i : i + k] * np.uint64(0x9E3779B97F4A7C15 + 2 * i) ^ (w[i : i + k] >> np.uint64(29 - i))
        out = part if out is None else (out * np.uint64(0xD6E8FEB86659FD93)) ^ part
    return (out ^ (out >> np.uint64(31))).view(np.int64)


def _row(above: np.ndarray, same: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The next row of the Smith-Waterman matrix."""
    t = np.zeros(len(above), np.int32)
    np.maximum(above[1:] + GAP, above[:-1] + np.where(same, MATCH, MISMATCH), out=t[1:])
    np.maximum(t, 0, out=t)
    return np.maximum.accumulate(t - GAP * at) + GAP * at  # gaps along the row at once


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over words: (score, matched words, first and last + 1 word of the passage) of the best local alignment.

    One row is held while the end is looked for. An alignment that ends there with a positive score has no more gaps than its matches pay for,
    so it lies in the last (1 + MATCH / -GAP) * item words before the end, and only those are traced back: memory is in proportion to the passage,
    however long a text quotes an item for.
    """
    m, n = len(item), len(passage)
    h, at = np.zeros(n + 1, np.int32), np.arange(n + 1, dtype=np.int32)
    score, last, end = 0, 0, 0
    for i in range(m):
        h = _row(h, item[i] == passage, at)
        j = int(h.argmax())
        if h[j] > score:
            score, last, end = int(h[j]), i + 1, j
    first = max(0, end - last * (1 + MATCH // -GAP))
    part = passage[first:end]
    near, at = np.zeros((last + 1, len(part) + 1), np.int32), np.arange(len(part) + 1, dtype=np.int32)
    for i in range(last):
        near[i + 1] = _row(near[i], item[i] == part, at)
    i, j, matched = last, len(part), 0
    while i and j and near[i, j] > 0:
        same = item[i - 1] == part[j - 1]
        if near[i, j] == near[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matched += bool(same)
            i, j = i - 1, j - 1
        elif near[i, j] == near[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, matched, first + j, end


def _passages(hits: np.ndarray, n_words: int, reach: int) -> list[tuple[int, int]]:
    """Stretches of words within reach of a hit, merged."""
    out: list[tuple[int, int]] = []
    for p in hits.tolist():
        lo, hi = max(0, p - reach), min(n_words, p + reach)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _items(bench: DataFrame, item: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(3)
        for b in batches:
            words = [word_hashes(t, hasher) for t in b.column(1).to_pylist()]
            seeds = [np.unique(shingles(w)) for w in words]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, kind), pa.array(seeds, kind)], names=["item_id", "words", "seeds"])

    return bench.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(run, "item_id long, words array<long>, seeds array<long>")


class _Index:
    """Items by their seeds, to be broadcast."""

    def __init__(self, ids: np.ndarray, words: list[np.ndarray], seeds: list[np.ndarray]) -> None:
        self.ids, self.size = ids, np.array([len(w) for w in words], np.int64)
        self.words = np.concatenate([np.zeros(0, np.int64), *words])
        self.start = np.cumsum(self.size) - self.size
        flat = np.concatenate([np.zeros(0, np.int64), *seeds])
        order = np.argsort(flat, kind="stable")
        self.keys, first = np.unique(flat[order], return_index=True)
        self.owner = np.repeat(np.arange(len(ids)), [len(x) for x in seeds])[order]
        self.first = np.append(first, len(flat))

    def item(self, i: int) -> np.ndarray:
        return self.words[self.start[i] : self.start[i] + self.size[i]]

    def candidates(self, at: np.ndarray, passage: np.ndarray, similarity: float) -> list[int]:
        """Items that hold one of the keys at the given places, but for those with too few words in the passage."""
        own = np.unique(np.concatenate([self.owner[self.first[k] : self.first[k + 1]] for k in at.tolist()]))
        known, out = np.unique(passage), []
        for some in np.array_split(own, 1 + int(self.size[own].sum()) // _BLOCK):
            if len(some):
                n = self.size[some]
                to = np.cumsum(n)
                w = self.words[np.repeat(self.start[some] - (to - n), n) + np.arange(to[-1])]
                there = known[np.minimum(np.searchsorted(known, w), len(known) - 1)] == w
                out += some[np.add.reduceat(there, to - n, dtype=np.int64) / n >= similarity].tolist()
        return out


def _scored(doc: int | None, item: int, first: int, words: np.ndarray, passage: np.ndarray) -> tuple:
    got = align(words, passage)
    return doc, item, got[1] / len(words), got[0], got[1], first + got[2], first + got[3]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["doc_id", "item_id", "similarity", "score", "matched", "first_word", "last_word"])


_SCORED = "doc_id long, item_id long, similarity double, score long, matched long, first_word long, last_word long"


def _looked_up(texts: DataFrame, items: DataFrame, reach: int, similarity: float) -> DataFrame:
    """Alignments by the broadcast index of the items."""
    t = items.toArrow()
    words, seeds = ([np.asarray(x.values) for x in t.column(c)] for c in ("words", "seeds"))
    known = items.sparkSession.sparkContext.broadcast(_Index(t.column("item_id").to_numpy(), words, seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, index = Hasher(3), known.value
        keys = index.keys
        maybe = np.zeros(1 << 20, bool)
        maybe[keys.view(np.uint64) >> np.uint64(44)] = True
        for b in batches:
            rows: list[tuple] = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = word_hashes(t, hasher)
                s = shingles(w)
                hits = np.flatnonzero(maybe[s.view(np.uint64) >> np.uint64(44)])
                if not len(hits):
                    continue
                at = np.minimum(np.searchsorted(keys, s[hits]), len(keys) - 1)
                true = keys[at] == s[hits]
                hits, at = hits[true], at[true]
                for lo, hi in _passages(hits, len(w), reach):
                    for i in index.candidates(np.unique(at[(hits >= lo) & (hits < hi)]), w[lo:hi], similarity):
                        rows.append(_scored(d, int(index.ids[i]), lo, index.item(i), w[lo:hi]))
            yield _rows(rows)

    return texts.mapInArrow(run, _SCORED)


def _joined(texts: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """Alignments of whole documents that a join on all their shingles finds, for items too many to broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, kind = Hasher(3), pa.list_(pa.int64())
        for b in batches:
            words = [word_hashes(t, hasher) for t in b.column(1).to_pylist()]
            seeds = [np.unique(shingles(w)) for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, kind), pa.array(seeds, kind)], names=["doc_id", "passage", "seeds"])

    found = texts.mapInArrow(run, "doc_id long, passage array<long>, seeds array<long>").where(F.size("passage") > 0)
    found = written(found.withColumn("ph", F.xxhash64("passage")), "passages")
    items = items.withColumn("ih", F.xxhash64("words"))
    own = items.select("item_id", "ih", F.explode("seeds").alias("seed"))
    pairs = found.select("ph", F.explode("seeds").alias("seed")).distinct().join(own, "seed").select("ph", "item_id", "ih").distinct()
    pairs = pairs.join(items.select("item_id", "ih", "words"), ["item_id", "ih"]).join(found.select("ph", "doc_id", "passage").distinct(), "ph")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, i, passage, words in zip(*(b.column(c) for c in range(4)), strict=True):
                x, y = (v.values.to_numpy(zero_copy_only=False) for v in (words, passage))
                if np.isin(x, y).sum() / len(x) >= similarity:
                    rows.append(_scored(d.as_py(), i.as_py(), 0, x, y))
            yield _rows(rows)

    return pairs.select("doc_id", "item_id", "passage", "words").mapInArrow(score, _SCORED)


def contaminated(docs: DataFrame, bench: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, score, matched, first_word, last_word) of every document and item at or above the similarity."""
    items = written(_items(bench, item, item_text).where((F.size("words") >= SEED) & F.col("item_id").isNotNull()), "items")
    size = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)), F.coalesce(F.max(F.size("words")), F.lit(0))).first()
    texts = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if size[0] <= MAX_SEEDS:
        scored = _looked_up(texts, items, int(size[1]) * 3 // 2 + SEED, similarity)
    else:
        scored = _joined(texts, items, similarity)
    best = F.max(F.struct("similarity", "score", "matched", -F.col("first_word"), -F.col("last_word")))
    out = scored.where(F.col("similarity") >= similarity).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "item_id", "b.similarity", "b.score", "b.matched", (-F.col("b.col4")).alias("first_word"), (-F.col("b.col5")).alias("last_word"))


def decontaminate(docs: DataFrame, bench: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that hold an item; rows of a null id go if any of them does."""
    bad = contaminated(docs, bench, doc, text).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col(doc).cast("long").eqNullSafe(F.col("_bad")), "left_anti")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    from sightline.sources.tables import table

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
