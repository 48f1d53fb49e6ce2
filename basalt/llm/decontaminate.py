"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

An item's windows are its runs of :data:`WINDOW` words, or the whole item if
it has fewer. A window is a set of shingles of :data:`SHINGLE` words. First
the corpus is counted: how often does each benchmark shingle occur in it?
Shingles are then ordered by rarity. As a window must be contained whole, its
necessary prefix is its one rarest shingle, and a window with a shingle that
never occurs is left out. Documents are joined on these prefix shingles; a
match must leave room for the window before and after it within the document
(positions and lengths); then all of the window's words are compared.

Items are cut into pieces of at most :data:`PIECE_WORDS` windows (neighbours
overlap by a window less one word), and the pieces are handled in blocks of
about :data:`BLOCK_CHARS` characters, one block after the other. So what the
driver holds and sends to the executors is bounded, however large the benchmark
or an item is; each block is one pass over the documents in the same job, with
no shuffle. Only shingle counts are shuffled.

Defined results: null and empty texts have no words and are clean; items that
are null, empty or without words have no windows; an item with a null item_id
marks words but is not listed; repeated items count once; each row of a
repeated document is judged by its own text, and so is a null doc_id; empty
tables give no hits; other columns are ignored by ``mark`` and unchanged,
whatever their names, in ``clean``.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.bpe import INF, PairTable
from basalt.llm.common import materialise, small_batches

WINDOW, SHINGLE = 10, 5
BLOCK_CHARS, PIECE_WORDS = 8 << 20, 1 << 16
#: ASCII letters to lower case, digits kept, other ASCII to spaces; bytes above ASCII are kept.
_MAP = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of anything above ASCII."""
    return text.encode().translate(_MAP).split() if text else []


class Block:
    """Windows of some items, with a trie over their shingles."""

    def __init__(self, items: list[tuple[str | None, str]]):
        self.vocab: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item_id, text in items:
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in words_of(text)]
            for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
                windows[tuple(w[i : i + WINDOW])].update([] if item_id is None else [item_id])
        self.windows, self.items = list(windows), [sorted(x) for x in windows.values()]
        edges: dict[tuple[int, int], int] = {}
        node = len(self.vocab)  # single words are the nodes of the first level
        self.shingles: list[list[int]] = []  # of each window, in order
        self.depth: dict[int, int] = {}
        for w in self.windows:
            n, mine = min(SHINGLE, len(w)), []
            for i in range(len(w) - n + 1):
                at = w[i]
                for x in w[i + 1 : i + n]:
                    if (at, x) not in edges:
                        node += 1
                        edges[at, x] = node
                    at = edges[at, x]
                self.depth[at] = n
                mine.append(at)
            self.shingles.append(mine)
        self.nodes, self.pairs = node + 1, PairTable(edges)
        self.depths = sorted(set(self.depth.values()))
        self.ends = np.zeros(self.nodes, np.int8)
        self.ends[list(self.depth)] = list(self.depth.values())

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, each followed by a 0, and where each text begins."""
        flat, starts, get = [], [0], self.vocab.get
        for t in texts:
            flat += [get(w, 0) for w in words_of(t)]
            flat.append(0)
            starts.append(len(flat))
        return np.array(flat, np.int32), np.array(starts)

    def find(self, ids: np.ndarray):
        """(positions, shingles) for each length of shingle."""
        pos = np.flatnonzero(ids)
        at = ids[pos]
        for depth in range(1, SHINGLE + 1):
            if depth in self.depths:
                full = self.ends[at] == depth
                yield pos[full], at[full]
            ok = pos + depth < len(ids)
            pos, at = pos[ok], at[ok]
            follow = ids[pos + depth]
            at = self.pairs.get(at, np.where(follow > 0, follow, -1).astype(np.int32))
            pos, at = pos[at != INF], at[at != INF]

    def index(self, counts: dict[int, int]) -> Index:
        return Index(self, counts)


class Index:
    """The rarest shingle of each window that can occur, with what is needed to verify the window."""

    def __init__(self, block: Block, counts: dict[int, int]):
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, mine in enumerate(block.shingles):
            if all(counts.get(s, 0) for s in mine):
                offset = min(range(len(mine)), key=lambda i: (counts[mine[i]], i))
                by[mine[offset]].append((k, offset))
        self.items = block.items
        self.length = np.array([len(w) for w in block.windows], np.int64)
        self.words = np.zeros((len(block.windows), WINDOW), np.int32)
        for k, w in enumerate(block.windows):
            self.words[k, : len(w)] = w
        self.first, self.number = np.zeros(block.nodes, np.int64), np.zeros(block.nodes, np.int64)
        flat: list[tuple[int, int]] = []
        for node, rows in by.items():
            self.first[node], self.number[node] = len(flat), len(rows)
            flat += rows
        self.window = np.array([x[0] for x in flat], np.int64)
        self.offset = np.array([x[1] for x in flat], np.int64)

    def hits(self, block: Block, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and windows of all occurrences."""
        at, found = [], []
        for pos, node in block.find(ids):
            n = self.number[node]
            pos, first, n = pos[n > 0], self.first[node[n > 0]], n[n > 0]
            slot = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            window = self.window[slot]
            begin = np.repeat(pos, n) - self.offset[slot]
            doc = np.searchsorted(starts, np.repeat(pos, n), "right") - 1
            fits = (begin >= starts[doc]) & (begin + self.length[window] < starts[doc + 1])
            begin, window = begin[fits], window[fits]
            same = np.ones(len(begin), bool)
            for j in range(WINDOW):
                inside = np.flatnonzero(same & (j < self.length[window]))
                same[inside] = ids[begin[inside] + j] == self.words[window[inside], j]
            at.append(begin[same])
            found.append(window[same])
        return (np.concatenate(at), np.concatenate(found)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _blocks(benchmark: DataFrame):
    """The items in blocks of bounded size, one at a time."""

    def pieces(batches):
        for b in batches:
            for item_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words_of(text)
                for i in range(0, max(1, len(w) - WINDOW + 1) if w else 0, PIECE_WORDS):
                    yield pa.RecordBatch.from_arrays([pa.array([item_id], pa.string()), pa.array([b" ".join(w[i : i + PIECE_WORDS + WINDOW - 1]).decode()], pa.string())], ["item_id", "text"])

    cut = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null").mapInArrow(pieces, "item_id string, text string")
    cut = materialise(cut, "pieces", fewer_files=True)
    chars = cut.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    for k in range(n):
        part = cut.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else cut
        yield Block([(r[0], r[1]) for r in part.distinct().collect()])


def _indexed(docs: DataFrame, benchmark: DataFrame):
    """Each block and its index of windows, sent to the executors."""
    spark = docs.sparkSession
    small_batches(spark)
    for block in _blocks(benchmark):
        if not block.windows:
            continue
        sent = spark.sparkContext.broadcast(block)

        def count(batches, sent=sent):
            total = np.zeros(sent.value.nodes, np.int64)
            for b in batches:
                ids, _ = sent.value.read(b.column(0).to_pylist())
                for _, node in sent.value.find(ids):
                    total += np.bincount(node, minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["node", "n"])

        # One row for each shingle of this bounded block comes back.
        rows = docs.select("text").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()
        yield sent, spark.sparkContext.broadcast(block.index({r[0]: r[1] for r in rows}))


def mark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, hit_words (array<int>, positions), items (array<string>) of each document."""
    base = docs.select("doc_id", "text")
    schema = "doc_id long, text string, n_words long, hit_words array<int>, items array<string>"

    def joined(sent, index):
        def join(batches):
            for b in batches:
                ids, starts = sent.value.read(b.column(1).to_pylist())
                begin, window = index.value.hits(sent.value, ids, starts)
                doc = np.searchsorted(starts, begin, "right") - 1
                change = np.zeros(len(ids) + 1, np.int32)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + index.value.length[window], -1)
                hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                of = np.searchsorted(starts, hit, "right") - 1
                cut = np.searchsorted(of, np.arange(len(starts)))
                found: dict[int, set[str]] = defaultdict(set)
                for d, w in np.unique(np.stack([doc, window]), axis=1).T.tolist():
                    found[d].update(index.value.items[w])
                old_hits, old_items = b.column(3).to_pylist(), b.column(4).to_pylist()
                hits = [np.union1d(old_hits[d] or [], hit[cut[d] : cut[d + 1]] - starts[d]).astype(np.int32) for d in range(b.num_rows)]
                items = [sorted(found[d].union(old_items[d] or [])) if d in found else old_items[d] for d in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(starts) - 1, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], b.schema.names)

        return join

    marked = base.selectExpr("doc_id", "text", "0L as n_words", "array_repeat(0, 0) as hit_words", "array_repeat('', 0) as items")
    blocks = 0
    for sent, index in _indexed(base, benchmark):
        marked, blocks = marked.mapInArrow(joined(sent, index), schema), blocks + 1
    if not blocks:
        none = base.sparkSession.sparkContext.broadcast(Block([]))
        marked = marked.mapInArrow(joined(none, base.sparkSession.sparkContext.broadcast(Block([]).index({}))), schema)
    return marked.drop("text")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text holds no benchmark window, unchanged; in one pass without a shuffle."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    out = docs.toDF(*names)

    def without(sent, index):
        def keep(batches):
            for b in batches:
                ids, starts = sent.value.read(b.column(at).to_pylist())
                begin, _ = index.value.hits(sent.value, ids, starts)
                stay = np.ones(b.num_rows, bool)
                stay[np.searchsorted(starts, begin, "right") - 1] = False
                yield b.filter(pa.array(stay))

        return keep

    schema = out.schema
    for sent, index in _indexed(docs.select("text"), benchmark):
        out = out.mapInArrow(without(sent, index), schema)
    return out.toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all items against all documents."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    sha = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return mark(docs, items).select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


SQL = """
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), d AS (
  SELECT doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM lowered
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS p FROM b WHERE len(w) > 0)
), pos AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0
), cand AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s, len(w) AS m FROM pos, (SELECT DISTINCT n FROM win)
  WHERE p + n - 1 <= len(w)
), occ AS (
  SELECT DISTINCT c.doc_id, c.p, c.n, win.item_id FROM cand c JOIN win ON win.n = c.n AND win.s = c.s
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM occ)) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
