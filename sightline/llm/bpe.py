"""Byte-level BPE: texts to token ids and back, by longest matches and backtracking instead of merging.

A text is split by the vocabulary's pattern; each match is encoded alone. A match that is a token is that token. Any other is encoded
from left to right: an Aho-Corasick automaton over the reversed tokens, their bytes read as Latin-1, gives the longest token that starts
at each place in one pass. The encoder takes it, or the next shorter token that begins alike, provided that it is compatible with the
token before, that is, that merging the bytes of the two gives these two tokens again; where none is, the place is marked dead and the
token before is shortened. A sequence of which all neighbours are compatible is what merging the whole gives, so ids are those of the
merges; every place dies at most once, so work is linear in the text. Compatibility is worked out by merging two tokens and memoised.

A place between a character that is no white space and a single space before another such character always ends a match of the pattern,
and what follows does not depend on what came before. Texts are cut there first, and the ids of short parts are memoised too.

Defined results: a null or empty text has no ids, null ids no bytes. An id that is not in the vocabulary is an error, a null id is left
out. Repeated rows are encoded as often as they come; texts are never cut or shortened; other columns are kept, and one with the name
of the result is replaced. An empty table gives an empty table. Memos hold a stated number of entries and forget the rest.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The single spaces at which every text may be cut. Python's white space has all of the pattern's.
_CUT = re.compile(r" (?<=\S )(?=\S)")
#: White space beside a space: where there is none, every space is such a cut, but for one at either end, which is a part by itself.
_BY_SPACE = ["  ", *(x for c in map(chr, range(1, 0x3001)) if c.isspace() and c != " " for x in (c + " ", " " + c))]
#: Characters taken at once, entries of a memo, and characters of the longest part that is memoised.
_STRETCH, MEMO, _SHORT = 1 << 18, 1 << 18, 48
_NONE: dict[int, bool] = {}
#: Texts handed back in one record batch, at most.
_ROWS = 256


def vocabulary_file(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """The bytes of a rank file of the installed public vocabularies, and the pattern that goes with them."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class _Memo(dict):
    """Packed ids of short parts by a function of them. When there are MEMO, those that are not asked for again before the next MEMO are forgotten."""

    def __init__(self, of):
        super().__init__()
        self.of, self.older = of, {}

    def __missing__(self, x: str) -> bytes:
        got = self.older.get(x)
        if got is None:
            got = self.of(x)
        if len(x) <= _SHORT:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[x] = got
        return got


class Codec:
    """Encoder and decoder of one vocabulary, {token bytes: rank}; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        n = max(ranks.values()) + 1
        self.token: list[bytes | None] = [None] * n
        self.size, self.shorter = [0] * n, [None] * n
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.token[i], self.size[i], self.shorter[i] = t, len(t), self._shorter(t)
            self.automaton.add_word(t[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.whole = {t: _packed([i]) for t, i in ranks.items()}
        self.pairs: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self.matches = _Memo(self.encode_match)
        self.begins, self.goes_on = _Memo(self._part), _Memo(lambda part: self._part(" " + part))

    def _merged(self, data: bytes) -> list[int]:
        """Ids of a few bytes by the merges themselves: the pair of lowest rank first, the leftmost among equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _compatible(self, before: int, token: int) -> bool:
        """Whether a token may follow another; with none before (-1), whether merging its bytes gives it at all. Memoised."""
        if self.n_pairs >= MEMO:
            self.pairs.clear()
            self.n_pairs = 0
        got = self._merged(self.token[token]) == [token] if before < 0 else self._merged(self.token[before] + self.token[token]) == [before, token]
        self.pairs.setdefault(before, {})[token] = got
        self.n_pairs += 1
        return got

    def _shorter(self, t: bytes) -> int | None:
        """The longest other token that a token begins with."""
        return next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ranks), None)

    def encode_match(self, match: str) -> bytes:
        """Packed ids of one match of the pattern."""
        data = match.encode()
        if data in self.whole:
            return self.whole[data]
        size, shorter, pairs, last = self.size, self.shorter, self.pairs, len(data) - 1
        longest: list[int | None] = [None] * (last + 2)
        for end, token in self.automaton.iter(data[::-1].decode("latin-1")):  # of the tokens with one end, the longest comes first
            if longest[last - end] is None:
                longest[last - end] = token
        ids: list[int] = []
        dead, at, token, before = bytearray(last + 2), 0, longest[0], -1
        while at <= last:
            known = pairs.get(before, _NONE)
            while token is not None:
                if not dead[at + size[token]]:
                    fits = known.get(token)
                    if fits is None:
                        fits = self._compatible(before, token)
                    if fits:
                        break
                token = shorter[token]
            if token is not None:
                ids.append(token)
                at, before = at + size[token], token
                token = longest[at]
            else:
                dead[at] = 1
                token = ids.pop()
                at, before = at - size[token], ids[-1] if ids else -1
        return _packed(ids)

    def _part(self, text: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids of a whole text, a stretch of it at a time."""
        lo = 0
        while lo < len(text):
            cut = _CUT.search(text, lo + _STRETCH) if len(text) - lo > _STRETCH else None
            hi = cut.start() if cut else len(text)
            stretch = text[lo:hi] if lo or cut else text
            first, *rest = _CUT.split(stretch) if any(x in stretch for x in _BY_SPACE) else stretch.split(" ")
            yield self.begins[first]
            yield b"".join(map(self.goes_on.__getitem__, rest))
            lo = hi

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(4)
def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary and worker. ranks: lines of a token in base64 and its rank."""
    return Codec({base64.b64decode(t): int(i) for t, i in (line.split() for line in ranks.splitlines() if line.strip())}, pattern)


def _with(df: DataFrame, source: str, to: list[T.StructField], run) -> DataFrame:
    """df with columns more, made batch by batch from another; run gives their Arrow arrays for its array."""
    names = [f.name for f in to]
    kept = [f for f in df.schema.fields if f.name not in names]
    # Spark's Arrow maps take no dots in names
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)] + [T.StructField(f"made{i}", f.dataType) for i, f in enumerate(to)])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, _ROWS):
                part = b.slice(lo, _ROWS)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *run(part.column(len(kept)))], names=schema.names)

    columns = [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)]
    return df.select(*columns, F.col(f"`{source}`").alias("source")).mapInArrow(batches, schema).toDF(*(f.name for f in kept), *names)


def _decoded(c: Codec, rows: pa.ListArray) -> pa.Array:
    ends, given = rows.offsets.to_numpy(), rows.is_valid().to_pylist()
    flat = rows.values.slice(ends[0], ends[-1] - ends[0])
    all_ids = flat.to_pylist() if flat.null_count else flat.to_numpy().tolist()
    ends = (ends - ends[0]).tolist()
    parts = (all_ids[a:b] for a, b in zip(ends, ends[1:], strict=False))
    return pa.array([c.decode([i for i in p if i is not None] if flat.null_count else p) if ok else None for p, ok in zip(parts, given, strict=True)], pa.binary())


def encode(df: DataFrame, text: str = "text", ids: str = "ids", ranks: bytes | None = None, pattern: str | None = None, data: str | None = None) -> DataFrame:
    """df with ids array<int>, the token ids of its text; with data, also the bytes that these ids decode to, in the same pass.

    ranks: the bytes of a rank file, a few MB at most; they are broadcast.
    """
    if ranks is None:
        ranks, pattern = vocabulary_file()
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(texts: pa.Array) -> list[pa.Array]:
        c, got, ends = codec(shared.value, pattern), [], [0]
        for t in texts.to_pylist():
            got += c.encode(t or "")
            ends.append(len(got))
        at = np.cumsum([0, *map(len, got)])[ends] // 4
        rows = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(got), np.int32)))
        return [rows, _decoded(c, rows)] if data else [rows]

    return _with(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(data, T.BinaryType())] if data else [])], run)


def decode(df: DataFrame, ids: str = "ids", data: str = "data", ranks: bytes | None = None, pattern: str | None = None) -> DataFrame:
    """df with data binary, the bytes that its ids stand for."""
    if ranks is None:
        ranks, pattern = vocabulary_file()
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    return _with(df, ids, [T.StructField(data, T.BinaryType())], lambda rows: [_decoded(codec(shared.value, pattern), rows)])


def op11_bpe_roundtrip(spark, sf_dir: str) -> DataFrame:
    from sightline.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, data="data")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
