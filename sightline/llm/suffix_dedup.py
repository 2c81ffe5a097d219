"""Removal of repeated byte strings by longest-previous-factor arrays, cut into groups that Spark can shuffle.

A byte goes when a MIN_LEN-byte string that covers it also starts earlier: in a smaller doc_id, or earlier in the same text. In
terms of the longest-previous-factor array, those are the windows with LPF[start] >= MIN_LEN. lpf() computes that array as Crochemore and Ilie do:
suffixes are sorted, neighbours' longest common prefixes taken, and for each suffix the nearest ones in suffix order with a smaller place, the
previous and the next, give its longest earlier match. One suffix array over the whole corpus cannot be built in pieces, but only suffixes that
agree in MIN_LEN bytes need to meet, and a suffix is compared no deeper than that:

1. every window has the smallest hash of its K-byte strings; equal windows have equal minima. Neighbouring windows whose leftmost
   minimum is the same string form a run (about 43 windows), and runs are what is shuffled: (minimum, place, windows);
2. before that, each task takes the LPF of its own runs that look alike: LPF[i + 1] >= LPF[i] - 1, so a run whose first suffix has an earlier match
   as long as the run with its last window is repeated as a whole, and does not travel;
3. runs under a minimum that occurs once are done. For the others the bytes are fetched by a join with the documents, grouped by minimum, and
   the LPF of the runs, then of the windows of those not repeated as a whole, decides;
4. a minimum that a task meets in LOCAL_HOT runs, or that has more than HOT in all, is hot (a short line that thousands of texts share): its runs are
   spread by document from the start, and dealt out by the hash of each window instead, once more after the LPF of each task's own windows.
   The LPF of the windows that share a hash decides;
5. repeated windows are joined back to their documents and the union of them is cut out.

Hashes (64 bits) choose what is compared; bytes decide. A group holds at most HOT runs, or one window from each batch.

Defined results: a null text is empty; texts under MIN_LEN bytes stay whole. A null doc_id comes before all others. Rows with one
doc_id are one document given several times: equal texts are not each other's earlier copy, and each row loses what is repeated at
its places. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.windows import Hasher, mix, segments, sliding_min, text_bytes
from sightline.sources.shared import written

MIN_LEN, K, HOT, LOCAL_HOT, SALTS, CHUNK = 100, 16, 4096, 64, 256, 1 << 19
NO_ID = -(1 << 63)
_ROWS = "g long, salt int, doc long, p long, n long"


def _nearest_smaller(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix in order: the longest common prefix with the nearest one before it of a smaller place (0 where there is none).

    lcp[i] belongs to suffixes i - 1 and i. Minima over 1, 2, 4... neighbours let all suffixes step back at once.
    """
    n = len(place)
    tables = [(place, lcp)]
    while 1 << len(tables) <= n:
        p, m = tables[-1]
        half = 1 << len(tables) - 1
        tables.append((np.concatenate([p[:half], np.minimum(p[half:], p[:-half])]), np.concatenate([m[:half], np.minimum(m[half:], m[:-half])])))
    at, best = np.arange(n), np.full(n, np.iinfo(np.int64).max)
    for level in range(len(tables) - 1, -1, -1):
        p, m = tables[level]
        step = 1 << level
        can = np.flatnonzero(at >= step)
        can = can[p[at[can] - 1] >= place[can]]  # none of the step suffixes before at has a smaller place
        best[can] = np.minimum(best[can], m[at[can]])
        at[can] -= step
    return np.where(at > 0, np.minimum(best, lcp[at]), 0)


def lpf(buf: np.ndarray, starts: np.ndarray, depth: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Longest previous factors of suffixes, each cut at its depth: the longest match with a suffix of a smaller place."""
    if len(starts) < 2:
        return np.zeros(len(starts), np.int64)
    width = int(depth.max())
    if starts.max() + width > len(buf):
        buf = np.concatenate([buf, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(buf, width)[starts]
    if depth.min() < width:
        rows[np.arange(width) >= depth[:, None]] = 0
    order = np.lexsort((place, depth, rows.view(f"S{width}").ravel()))  # NULs sort as a shorter suffix's padding
    rows, cut = rows[order], depth[order]
    same = rows[1:] == rows[:-1]
    lcp = np.zeros(len(rows), np.int64)
    lcp[1:] = np.minimum(np.where(same.all(axis=1), width, same.argmin(axis=1)), np.minimum(cut[1:], cut[:-1]))
    place = place[order]
    before = _nearest_smaller(place, lcp)
    after = _nearest_smaller(place[::-1], np.concatenate([[0], lcp[:0:-1]]))[::-1]
    out = np.empty(len(rows), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _places(doc: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (np.unique(doc, return_inverse=True)[1].astype(np.int64) << 40) + p


def runs(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, hasher: Hasher, min_len: int, k: int) -> list[np.ndarray]:
    """(g, h, doc, p, n, at) of every run of a batch of texts: minimum, bytes' hash, place of the first window, windows, place in data."""
    out = [[np.zeros(0, np.int64)] for _ in range(6)]
    for i, j, lo, hi in segments(offsets, min_len - 1):
        buf = data[lo:hi]
        if len(buf) < min_len:
            continue
        hasher.load(buf)
        grams = np.arange(len(buf) - k + 1)
        hashes = hasher.span(grams, grams + k)
        low = sliding_min(hashes, min_len - k + 1)
        n = len(low)
        start, end = np.clip(offsets[i:j] - lo, 0, len(buf)), np.clip(offsets[i + 1 : j + 1] - lo, 0, len(buf))
        cut = np.ones(n + 1, bool)
        # a run ends behind its leftmost minimum, so that no run repeats itself inside
        cut[1:n] = (low[1:] != low[:-1]) | (low[:-1] == hashes[: n - 1])
        cut[np.minimum(start, n)] = True
        cut[np.clip(end - min_len + 1, start, n)] = True
        at = np.flatnonzero(cut)
        a, b = at[:-1], at[1:]
        d = np.minimum(np.searchsorted(end, a, "right"), len(end) - 1)
        good = (a >= start[d]) & (a <= end[d] - min_len)
        a, b, d = a[good], b[good], d[good]
        h = hasher.span(a, b - 1 + min_len) + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rows = (low[a].view(np.int64), h.view(np.int64), ids[i:j][d], a + lo - offsets[i:j][d], b - a, a + lo)
        for o, x in zip(out, rows, strict=True):
            o.append(x)
    return [np.concatenate(x) for x in out]


def _alike(key: np.ndarray) -> np.ndarray:
    """Whether a value occurs more than once."""
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[back] > 1


def _chunks(key: np.ndarray, size: np.ndarray, chunk: int):
    """Index arrays of whole groups of equal keys, of about chunk bytes each."""
    order = np.argsort(key, kind="stable")
    if not len(order):
        return
    k, total = key[order], np.cumsum(size[order])
    ends = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(k))
    at = 0
    for e, nxt in zip(ends.tolist(), [*ends[1:].tolist(), -1], strict=True):
        if nxt < 0 or total[nxt - 1] - (total[at - 1] if at else 0) > chunk:
            yield order[at:e]
            at = e


def merged(doc, p, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows of the same document that touch or overlap, joined."""
    if not len(doc):
        return doc, p, n
    o = np.lexsort((p, doc))
    doc, p, e = doc[o], p[o], (p + n)[o]
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    # running end within a document: ends are shifted by document so that one accumulate serves all
    rank = np.cumsum(new) - 1
    step = int(e.max()) + 1
    reach = np.maximum.accumulate(e + rank * step) - rank * step
    new[1:] |= p[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], p[at], np.maximum.reduceat(e, at) - p[at]


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32 if name == "salt" else np.int64)) for name, x in zip(names, columns, strict=True)], names=names)


def _travelling(g, doc, p, n, repeated) -> pa.RecordBatch:
    """Rows that are not repeated, hot ones spread (salt > 0) and announced (n = 0), and the repeated stretches (salt = -1)."""
    d, q, m = merged(doc[repeated], p[repeated], n[repeated])
    g, doc, p, n = (x[~repeated] for x in (g, doc, p, n))
    low, back, count = np.unique(g, return_inverse=True, return_counts=True)
    spread = mix(doc.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SALTS)
    salt = np.where(count[back] >= LOCAL_HOT, 1 + spread.astype(np.int64), 0)
    hot = low[count >= LOCAL_HOT]
    none = np.zeros(len(hot), np.int64)
    return _batch(
        ["g", "salt", "doc", "p", "n"], np.concatenate([g, hot, d * 31 + q]), np.concatenate([salt, none, np.full(len(d), -1)]), np.concatenate([doc, none, d]),
        np.concatenate([p, none, q]), np.concatenate([n, none, m]),
    )


def _rows(docs: DataFrame, min_len: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            g, h, doc, p, n, at = runs(data, offsets, b.column(0).to_numpy(), hasher, min_len, k)
            depth, place, repeated = n - 1 + min_len, _places(doc, p), np.zeros(len(g), bool)
            alike = np.flatnonzero(_alike(h))
            for part in _chunks(h[alike], depth[alike], CHUNK):
                part = alike[part]
                repeated[part] = lpf(data, at[part], depth[part], place[part]) >= depth[part]
            yield _travelling(g, doc, p, n, repeated)

    return docs.select("doc", "text").mapInArrow(run, _ROWS)


def _judged(rows: DataFrame) -> DataFrame:
    """Repeated stretches (kind 1), and runs whose minimum others have too (kind 0, with whether it is hot)."""
    by = Window.partitionBy("g", "salt")
    r = rows.withColumns({"c": F.count("*").over(by), "told": F.min("n").over(by) == 0})
    r = r.withColumns({"kind": F.when(F.col("salt") < 0, 1).otherwise(0), "hot": F.col("told") | (F.col("salt") > 0) | (F.col("c") > HOT)})
    return r.where("n > 0 and (kind = 1 or hot or c > 1)").select("kind", "g", "hot", "doc", "p", "n")


def _contexts(docs: DataFrame, asked: DataFrame, min_len: int) -> DataFrame:
    """(g, hot, doc, p, x): the bytes under the windows of each run asked for."""
    lists = asked.groupBy("doc").agg(F.collect_list(F.struct("g", "hot", "p", "n")).alias("runs")).withColumnRenamed("doc", "_d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            ask = b.column(2)
            where = np.repeat(np.arange(len(ask)), np.diff(ask.offsets.to_numpy()))
            flat = ask.flatten()
            g, hot, p, n = (flat.field(x).to_numpy(zero_copy_only=False) for x in range(4))
            lo = offsets[where] + p
            fits = lo + n - 1 + min_len <= offsets[where + 1]  # else a run of another text under the same doc_id
            g, hot, p, n, lo, where = (x[fits] for x in (g, hot, p, n, lo, where))
            raw = data.tobytes()
            doc = b.column(0).to_numpy()[where]
            for at in range(0, len(lo), 20_000):
                s = slice(at, at + 20_000)
                x = [raw[i:j] for i, j in zip(lo[s].tolist(), (lo + n - 1 + min_len)[s].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(g[s]), pa.array(hot[s]), pa.array(doc[s]), pa.array(p[s]), pa.array(x, pa.binary())], names=["g", "hot", "doc", "p", "x"])

    joined = docs.join(lists.hint("shuffle_hash"), F.col("doc") == F.col("_d"))
    return joined.select("doc", "text", "runs").mapInArrow(run, "g long, hot boolean, doc long, p long, x binary")


def _windows(doc, p, size, min_len: int) -> tuple[np.ndarray, ...]:
    """(start in the joined bytes, doc, p, run) of every window of runs given by their bytes' sizes."""
    n = size - min_len + 1
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.cumsum(size) - size, n) + inner, np.repeat(doc, n), np.repeat(p, n) + inner, np.repeat(np.arange(len(n)), n)


def repeated_windows(texts: list[bytes], doc: np.ndarray, p: np.ndarray, min_len: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, p, n): stretches of windows with LPF >= min_len among the windows of all texts; a text starts at a place (doc, p)."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = lpf(buf, np.cumsum(size) - size, size, _places(doc, p)) >= size
    # a window that first occurs in a run repeated as a whole occurs before in the run that it repeats
    start, d, q, run = _windows(doc, p, size, min_len)
    hasher.load(buf)
    keep = ~whole[run]
    start, d, q = start[keep], d[keep], q[keep]
    alike = _alike(hasher.span(start, start + min_len))
    start, d, q = start[alike], d[alike], q[alike]
    again = np.zeros(len(start), bool)
    if len(start):
        again = lpf(buf, start, np.full(len(start), min_len), _places(d, q)) >= min_len
    n = np.concatenate([size[whole] - min_len + 1, np.ones(int(again.sum()), np.int64)])
    return merged(np.concatenate([doc[whole], d[again]]), np.concatenate([p[whole], q[again]]), n)


def _compared(contexts: DataFrame, min_len: int) -> DataFrame:
    """(doc, p, n) of repeated windows among (g, doc, p, x); whole groups of equal g are gathered, CHUNK bytes or one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(2)

        def out(held: list[tuple]) -> pa.RecordBatch:
            doc, p = (np.fromiter((x[c] for x in held), np.int64, len(held)) for c in (1, 2))
            return _batch(["doc", "p", "n"], *repeated_windows([x[3] for x in held], doc, p, min_len, hasher))

        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > CHUNK and row[0] != held[-1][0]:
                    yield out(held)
                    held, size = [], 0
                if held and row == held[-1]:
                    continue  # a document given several times is one place
                held.append(row)
                size += len(row[3])
        if held:
            yield out(held)

    c = contexts.select("g", "doc", "p", "x").repartition("g").sortWithinPartitions("g", "doc", "p", "x")
    return c.mapInArrow(run, "doc long, p long, n long")


def _dealt(contexts: DataFrame, min_len: int) -> tuple[DataFrame, DataFrame]:
    """Runs of hot minima dealt out by window hash: (repeated stretches, (g, doc, p, x) with a row for each window still to compare)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(3)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                texts = part.column(2).to_pylist()
                buf = np.frombuffer(b"".join(texts), np.uint8)
                hasher.load(buf)
                p0 = part.column(1).to_numpy()
                start, doc, p, run = _windows(part.column(0).to_numpy(), p0, np.fromiter(map(len, texts), np.int64, len(texts)), min_len)
                h = hasher.span(start, start + min_len).view(np.int64)
                repeated = np.zeros(len(h), bool)
                alike = np.flatnonzero(_alike(h))
                if len(alike):
                    repeated[alike] = lpf(buf, start[alike], np.full(len(alike), min_len), _places(doc[alike], p[alike])) >= min_len
                d, q, m = merged(doc[repeated], p[repeated], np.ones(int(repeated.sum()), np.int64))
                s = ~repeated
                yield _batch(
                    ["g", "salt", "doc", "p", "n", "p0"], np.concatenate([h[s], d * 31 + q]), np.concatenate([np.zeros(int(s.sum())), np.full(len(d), -1)]),
                    np.concatenate([doc[s], d]), np.concatenate([p[s], q]), np.concatenate([np.ones(int(s.sum())), m]), np.concatenate([p0[run[s]], q]),
                )

    c = F.count("*").over(Window.partitionBy("g", "salt"))
    rows = contexts.select("doc", "p", "x").mapInArrow(deal, _ROWS + ", p0 long").withColumn("c", c).where("salt < 0 or c > 1")
    rows = written(rows, "dealt", free=True)
    lists = rows.where("salt = 0").groupBy("doc", "p0").agg(F.collect_list(F.struct("g", "p")).alias("w"))
    hot = contexts.select("doc", F.col("p").alias("p0"), "x").join(lists, ["doc", "p0"]).select("doc", "p0", "x", F.explode("w").alias("w"))
    # a text of another row under the same doc_id may be shorter
    bytes_ = F.expr(f"substring(x, cast(w.p - p0 as int) + 1, {min_len})")
    left = hot.select("w.g", "doc", "w.p", bytes_.alias("x")).where(F.octet_length("x") == min_len)
    return rows.where("salt < 0").select("doc", "p", "n"), left


def remove_repeats(df: DataFrame, doc: str = "doc_id", text: str = "text", min_len: int = MIN_LEN, k: int = K) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every row."""
    docs = df.select(F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    judged = written(_judged(_rows(docs, min_len, k)), "runs", free=True)
    contexts = written(_contexts(docs, judged.where("kind = 0"), min_len), "contexts", free=True)
    settled, dealt = _dealt(contexts.where("hot"), min_len)
    again = judged.where("kind = 1").select("doc", "p", "n").unionByName(settled)
    again = again.unionByName(_compared(contexts.where("not hot"), min_len)).unionByName(_compared(dealt, min_len))
    again = written(again, "again", free=True)  # else the bytes of runs lie in shuffle files beside those of the texts
    spans = again.groupBy("doc").agg(F.collect_list(F.struct("p", "n")).alias("runs")).withColumnRenamed("doc", "_d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, found in zip(b.column(1).cast(pa.large_binary()), b.column(2), strict=True):
                raw, found = text.as_py(), found.values
                kept, n = [], 0
                if found is None:
                    p = e = np.zeros(0, np.int64)
                else:
                    p, m = found.field(0).to_numpy(), found.field(1).to_numpy()
                    _, p, m = merged(np.zeros(len(p), np.int64), p, m + min_len - 1)
                    p, e = np.minimum(p, len(raw)), np.minimum(p + m, len(raw))
                at = 0
                for s, t in zip(p.tolist(), e.tolist(), strict=True):
                    if t > s:
                        kept.append(raw[at:s])
                        n, at = n + 1, t
                rest = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = [pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = docs.join(spans.hint("shuffle_hash"), F.col("doc") == F.col("_d"), "left").select("doc", "text", "runs")
    got = joined.mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return got.withColumn("doc_id", F.when(F.col("doc") != NO_ID, F.col("doc"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    from sightline.sources.tables import table

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
