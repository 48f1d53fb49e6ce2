"""Byte-level BPE encoding and decoding with padded numpy matrices.

Texts are cut into units at single spaces between non-space characters; no
match of the pre-tokenizer's pattern crosses such a place, so units can be
encoded alone and remembered (see units). The matches of new units are gathered
over many texts, sorted into buckets of similar length and put into padded
matrices, one match a row. In each round every row merges its leftmost pair
of minimum rank. Pairs are found in an open-addressing hash table; rows that
are done leave the matrix, and merged cells are squeezed out of it.

Defined results: a null text is an empty text (no ids); null ``doc_id`` and
repeated rows are passed through, a row of output for each row of input; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from basalt.llm.common import Memory, small_batches
from basalt.llm.units import UnitTable

INF = np.int32(2**31 - 1)
#: Cells in one matrix; widths from which minima are kept by block; cells in such a block.
CELLS, WIDE, BLOCK = 1 << 19, 1024, 64
#: Matches remembered by a Python worker.
CACHE = 150_000
#: Texts whose new units are encoded together.
GROUP = 250
#: A vocabulary file is sent to the executors; larger ones are refused.
MAX_FILE_BYTES = 64 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class PairTable:
    """Open addressing hash table from a pair of ids to the id they merge to."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        size = 1 << max(4, int(len(pairs) * 3).bit_length())
        self.mask, self.shift = np.int64(size - 1), np.uint64(64 - size.bit_length() + 1)
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, INF, np.int32)
        left = np.fromiter((a for a, _ in pairs), np.int64, len(pairs)) << 32
        keys = left | np.fromiter((b for _, b in pairs), np.int64, len(pairs))
        values, at = np.fromiter(pairs.values(), np.int32, len(pairs)), self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several, the last stays
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each merged pair; INF where a pair does not merge or has an id below 0."""
        shape = left.shape
        keys = ((left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        out, at, todo = np.full(len(keys), INF, np.int32), self._slot(keys), None
        bad = (left.ravel() < 0) | (right.ravel() < 0)
        todo = np.flatnonzero(~bad)
        at = at[todo]
        while len(todo):
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found != -1)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out.reshape(shape)


class ByteBpe:
    """Encoder and decoder for one vocabulary of ranks and one pre-tokenizer pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.latin = r"| ?\p{L}+|" in pattern and r"| ?[^\s\p{L}\p{N}]+|" in pattern
        self.vocab = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.decimal = [str(i) for i in range(len(self.vocab))]
        self.byte_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = PairTable(pairs)
        self.known, self.table = Memory(CACHE), UnitTable(self._encode_units, "<i4")

    # -- matrices ---------------------------------------------------------

    def encode_matches(self, matches: list[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian 32-bit) of each distinct match."""
        out, by_width = {}, {}
        for m in dict.fromkeys(matches):
            whole = self.ranks.get(m)
            if whole is not None:
                out[m] = whole.to_bytes(4, "little")
            elif len(m) > 1:
                by_width.setdefault((len(m) - 1).bit_length(), []).append(m)
            else:
                out[m] = self.byte_id[list(m)].astype("<i4").tobytes()
        for width, group in by_width.items():
            group.sort(key=len)
            step = max(1, CELLS >> width)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                out.update(zip(part, self._merge(part), strict=True))
        return out

    def _merge(self, rows: list[bytes]) -> list[bytes]:
        width, done = max(map(len, rows)), [b""] * len(rows)
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        length = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.where(np.arange(width) < length[:, None], self.byte_id[raw], -1).astype(np.int32)
        index = np.arange(len(rows))
        while len(index):
            ids, index = self._rounds(ids, index, done)
        return done

    def _rounds(self, ids: np.ndarray, index: np.ndarray, done: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Merge until half of the rows are done or half of the cells are merged; what is left, squeezed."""
        n, width = ids.shape
        wide = width >= WIDE
        padded = -(-(width + 1) // BLOCK) * BLOCK if wide else width + 1
        rank = np.full((n, padded), INF, np.int32)
        rank[:, : width - 1] = self.pairs.get(ids[:, :-1], ids[:, 1:]) if width > 1 else INF
        tok = np.full((n, width + 2), -1, np.int32)  # the two last cells stand for "none"
        tok[:, :width] = ids
        after = np.broadcast_to(np.minimum(np.arange(1, width + 3), width), (n, width + 2)).copy()
        before = np.broadcast_to(np.arange(-1, width + 1), (n, width + 2)).copy()
        before[:, 0] = width + 1
        low = rank.reshape(n, -1, BLOCK).min(2) if wide else None
        rows, live = np.arange(n), n
        for _ in range(max(1, width // 2)):
            if wide:
                b = low.argmin(1)
                p = b * BLOCK + rank.reshape(n, -1, BLOCK)[rows, b].argmin(1)
            else:
                p = rank.argmin(1)
            best = rank[rows, p]
            r = np.flatnonzero(best != INF)
            live = len(r)
            if live * 2 < n or not live:
                break
            p, best = p[r], best[r]
            q = after[r, p]
            k, o = after[r, q], before[r, p]
            tok[r, p], tok[r, q], rank[r, q] = best, -1, INF
            after[r, p], before[r, k] = k, p
            rank[r, p] = self.pairs.get(best, tok[r, k])
            has = o <= width
            ro, oo = r[has], o[has]
            rank[ro, oo] = self.pairs.get(tok[ro, oo], best[has])
            if wide:
                for rr, cc in ((r, p), (r, q), (ro, oo)):
                    low[rr, cc // BLOCK] = rank.reshape(n, -1, BLOCK)[rr, cc // BLOCK].min(1)
        tok = tok[:, :width]
        open_ = (rank != INF).any(1)
        for i in np.flatnonzero(~open_):
            done[index[i]] = tok[i][tok[i] >= 0].astype("<i4").tobytes()
        tok, index = tok[open_], index[open_]
        if len(index):
            tok = np.take_along_axis(tok, np.argsort(tok < 0, axis=1, kind="stable"), 1)
            tok = tok[:, : int((tok >= 0).sum(1).max())]
        return np.ascontiguousarray(tok), index

    # -- texts ------------------------------------------------------------

    def _encode_units(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are encoded together."""
        found = [self._matches(t) for t in texts]
        self.known.learn(set(chain.from_iterable(found)), self._encode_strings)
        known = self.known.data
        return [known[ms[0]] if len(ms) == 1 else b"".join([known[m] for m in ms]) for ms in found]

    def _encode_strings(self, matches: list[str]) -> list[bytes]:
        raw = [m.encode() for m in matches]
        ids = self.encode_matches(raw)
        return [ids[m] for m in raw]

    def _matches(self, text: str) -> list[str]:
        """Matches of the pattern. A word of Latin letters is one, and so is a mark after it, whatever the pattern's other branches."""
        word = text[1:]
        if self.latin and text[:1] == " " and word and max(word) < "\u0250":
            if word.isalpha():
                return [text]
            if word[-1] in ".," and word[:-1].isalpha():
                return [text[:-1], text[-1]]
        return self.find(text)

    def encode_batch(self, texts: list[str | None] | pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text."""
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        for i in range(0, len(col), GROUP):
            ids, n = self.table.ids(col.slice(i, GROUP))
            stop = np.cumsum(n)
            for a, b in zip((stop - n).tolist(), stop.tolist(), strict=True):
                yield ids[a:b]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids."""
        return b"".join(map(self.vocab.__getitem__, ids))


@lru_cache(2)
def encoder(data: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(data), pattern)


def read_vocab(path: str) -> bytes:
    """The vocabulary file, read by the driver and sent to the executors; its size is checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_FILE_BYTES + 1)
    if len(data) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    return data


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded (binary): each text encoded, then decoded again."""
    spark, schema = docs.sparkSession, "doc_id long, ids array<int>, decoded binary"
    small_batches(spark)
    data = spark.sparkContext.broadcast(read_vocab(path))

    def run(batches):
        bpe = encoder(data.value, pattern)
        for b in batches:
            ids = list(bpe.encode_batch(b.column(1)))
            at = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            out = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, "<i4"), *ids]))), pa.array([bpe.decode(x.tolist()) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *out], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what :func:`encode` gives, made in the
    same pass so that ids never leave the Python worker."""
    spark, schema = docs.sparkSession, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    small_batches(spark)
    data = spark.sparkContext.broadcast(read_vocab(path))

    def run(batches):
        bpe, sha = encoder(data.value, pattern), lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for x in bpe.encode_batch(b.column(1)):
                ids = x.tolist()
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(bpe.decimal.__getitem__, ids)).encode()))
                text_sha.append(sha(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every text by the multilingual ranks, encoded and decoded."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
