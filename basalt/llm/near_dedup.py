"""Near-duplicate documents by bottom-k sketches.

A document's set is its distinct shingles of :data:`WORDS` words, hashed once
to 63 bits. Its sketch is the :data:`K` least hashes. Two sets as similar as
asked for share at least ``need`` of the values of their sketches (the chance
to share fewer is below :data:`MISS`), so they share one of the values that
come first when each sketch is put in order of rarity; only these values get
inverted lists. Documents with equal sets are one class from the start.

A list is compared in blocks of about :data:`BLOCK` sets, a task each, so no
list is gathered whole. Within a block the overlap of the sketches up to the
lower of their thresholds estimates similarity for all pairs at once (the union
sketch); pairs that may be similar are verified on their full sets; only the
links of a spanning forest leave the task. Of a list of several blocks some
:data:`PIVOTS` sets are compared with the members of every block. That puts a
cluster of near copies, however large, into one component by a number of
comparisons that grows with its members alone. What a component holds need not
be compared again: of a list, only the members outside its largest component
are then compared with those of the other blocks. A pair that meets in several
lists is compared in the first of them, or with a pivot. Components are then
found on all links.

Defined results: null or empty texts, or texts without words, have an empty
set and are linked with nothing; with fewer words than a shingle the whole
text is one; documents with equal sets are linked; rows that repeat a doc_id
are one node; a null doc_id is never linked, has a null component and is kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import Memory, materialise, small_batches
from basalt.llm.components import components

WORDS, PERCENT, K, MISS = 5, 85, 64, 1e-8
#: Sets, and shingles, of a block of a list; about how many sets of a list of several blocks are compared with all.
BLOCK, BLOCK_SHINGLES, PIVOTS = 1024, 2_000_000, 32


def need(percent: int, k: int = K, miss: float = MISS) -> float:
    """Share of the sketch that two sets of the asked similarity share but with a chance below ``miss``."""
    t, tail, c = percent / 100, 0.0, 0
    while tail + comb(k, c) * t**c * (1 - t) ** (k - c) < miss:
        tail += comb(k, c) * t**c * (1 - t) ** (k - c)
        c += 1
    return c / k


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Shingler:
    """Hashed shingle sets of texts; hashes of words are remembered by a Python worker."""

    def __init__(self, words: int = WORDS):
        self.n, self.cache = words, Memory(150_000)

    def set_of(self, text: str | None) -> np.ndarray:
        """Ascending distinct 63-bit hashes. bytes.lower() and bytes.split() know ASCII only, as asked for."""
        import xxhash

        words = text.encode().lower().split() if text else []
        if not words:
            return np.zeros(0, np.int64)
        self.cache.learn(set(words), lambda ws: [xxhash.xxh3_64_intdigest(w) for w in ws])
        a = np.fromiter(map(self.cache.data.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(a))
        h = np.full(len(a) - n + 1, n, np.uint64)
        for i in range(n):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + a[i : i + len(h)])
        return np.unique(h >> np.uint64(1)).astype(np.int64)


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n (size of the set), s1 and s2 (128 bits of the whole set, null if empty), sketch."""

    def run(batches):
        shingler = Shingler()
        for b in batches:
            sets = [shingler.set_of(t) for t in b.column(1).to_pylist()]
            sig = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist() if len(s) else (None, None) for s in sets]
            cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in sig], pa.int64()), pa.array([x[1] for x in sig], pa.int64()), pa.array([s[:k] for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n", "s1", "s2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sketch array<long>")


def _lists(classes: DataFrame, share: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(value, rep) of the prefixes and (value, size, blocks) of the lists to compare."""
    values = classes.select(F.col("doc_id").alias("rep"), "n", F.explode("sketch").alias("value"))
    often = materialise(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "often", fewer_files=True)
    shared = values.join(often, "value").groupBy("rep", "n").agg(F.collect_set(F.struct("df", "value")).alias("vs"))
    least = F.ceil(F.least("n", F.lit(k)) * share)  # values found once come first, so what is left of the prefix is cut from the end
    prefix = F.slice(F.array_sort("vs"), 1, F.greatest(F.size("vs") - least + 1, F.lit(0)).cast("int"))
    rows = materialise(shared.select("rep", "n", F.explode(prefix).alias("v")).select("rep", "n", F.col("v.value").alias("value")), "lists", fewer_files=True)
    same = rows.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("x2")).filter("size > 1")
    lists = same.groupBy("size", "shingles", "x1", "x2").agg(F.min("value").alias("value"))  # lists of the same members count once
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    lists = lists.select("value", "size", blocks.alias("blocks"))
    return rows.select("value", "rep"), materialise(lists, "list-sizes", fewer_files=True)


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _incidence(parts: list[np.ndarray], chunk: int = 4096):
    """Matrices of rows by the values that at least two rows have, some columns at a time; and the number of these values."""
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    values, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    some = count > 1
    number = np.cumsum(some) - 1
    keep = some[col]
    row, col, total = row[keep], number[col[keep]], int(some.sum())

    def matrices():
        order = np.argsort(col, kind="stable")
        r, c = row[order], col[order]
        for start in range(0, total, chunk):
            a, b = np.searchsorted(c, [start, start + chunk])
            m = np.zeros((len(parts), min(chunk, total - start)), np.float32)
            m[r[a:b], c[a:b] - start] = 1
            yield m

    return matrices, total


def _overlaps(parts: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common values of each row of ``left`` with each row of ``right``."""
    out = np.zeros((len(left), len(right)), np.float32)
    for m in _incidence(parts)[0]():
        out += m[left] @ m[right].T
    return out


def link_blocks(value: int | None, sets: list[np.ndarray], lists: list[np.ndarray], names: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, share: float, k: int, forest: _Forest | None = None) -> list[tuple[int, int]]:
    """Spanning links (row, row) among the similar pairs of ``left`` x ``right`` whose first common list is ``value``
    (None: any); rows of the same name are one set."""
    n = np.array([len(s) for s in sets])
    small, large = np.minimum(n[left][:, None], n[right]), np.maximum(n[left][:, None], n[right])
    ok = 100 * small >= percent * large
    if value is not None:
        ok &= _overlaps([x[x < value] for x in lists], left, right) == 0
    ok &= np.arange(len(left))[:, None] < np.arange(len(right)) if left is right else names[left][:, None] != names[right]
    if not ok.any():
        return []
    sk = [s[:k] for s in sets]
    top = np.array([s[-1] if m > k else np.iinfo(np.int64).max for s, m in zip(sk, n, strict=True)])
    both = _overlaps(sk, left, right)
    seen_l = np.array([np.searchsorted(sk[a], np.minimum(top[right], top[a]), "right") for a in left])
    seen_r = np.array([np.searchsorted(sk[b], np.minimum(top[left], top[b]), "right") for b in right]).T
    ok &= both >= share * (seen_l + seen_r - both)
    a, b = np.nonzero(ok)
    if not len(a):
        return []
    pairs_cost = len(a) * 1e-5 + (n[left[a]] + n[right[b]]).sum() * 2e-8
    rows = np.unique(np.concatenate([left[a], right[b]]))
    total = _incidence([sets[r] for r in rows])[1] if len(a) > 1000 else 1 << 40
    forest, out = forest or _Forest(len(sets)), []
    if pairs_cost > len(np.unique(a)) * len(np.unique(b)) * total / 2e10 + 0.01:
        at = np.zeros(len(sets), np.int64)
        at[rows] = np.arange(len(rows))
        ua, ub = np.unique(a), np.unique(b)
        full = _overlaps([sets[r] for r in rows], at[left[ua]], at[right[ub]])
        inter = full[np.searchsorted(ua, a), np.searchsorted(ub, b)].astype(np.int64)
        link = 100 * inter >= percent * (n[left[a]] + n[right[b]] - inter)
        for x, y in zip(left[a[link]].tolist(), right[b[link]].tolist(), strict=True):
            if forest.join(x, y):
                out.append((x, y))
        return out
    for x, y in zip(left[a].tolist(), right[b].tolist(), strict=True):
        if forest.find(x) != forest.find(y):
            s, t = (sets[x], sets[y]) if n[x] <= n[y] else (sets[y], sets[x])
            place = np.searchsorted(t, s)
            inter = int((t[np.minimum(place, len(t) - 1)] == s).sum())
            if 100 * inter >= percent * (len(s) + len(t) - inter):
                forest.join(x, y)
                out.append((x, y))
    return out


def _roots(docs: DataFrame, rows: DataFrame, lists: DataFrame, percent: int, share: float, k: int) -> DataFrame:
    """node, root: components of the classes."""
    members = materialise(rows.join(lists, "value"), "members", fewer_files=True)
    mine = members.groupBy("rep").agg(F.collect_list("value").alias("lists"))
    # Always a sort-merge join: the candidates grow with the documents, so they are never broadcast.
    texts = docs.select("doc_id", "text").join(mine.hint("merge"), F.col("doc_id") == F.col("rep")).select("rep", "lists", "text")

    def full(batches):
        shingler = Shingler()
        for b in batches:
            sets = [shingler.set_of(t).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], ["rep", "lists", "hashes"])

    sets = materialise(texts.mapInArrow(full, "rep long, lists array<long>, hashes binary"), "sets")

    def read(t):
        return t["rep"].to_numpy(), [np.frombuffer(x.as_buffer(), np.int64) for x in t["hashes"]], [np.array(x, np.int64) for x in t["lists"].to_pylist()]

    def found(reps, links):
        return pa.table({"a": pa.array([reps[x] for x, _ in links], pa.int64()), "b": pa.array([reps[y] for _, y in links], pa.int64())})

    def inside(key, t):
        """The members of a block with one another, and with the list's pivots."""
        reps, full_sets, of = read(t)
        pivot = t["pivot"].to_numpy(zero_copy_only=False)
        own, pivots, forest = np.flatnonzero(~pivot), np.flatnonzero(pivot), _Forest(len(reps))
        links = link_blocks(None, full_sets, of, reps, pivots, own, percent, share, k, forest) if len(pivots) and len(own) else []
        return found(reps, links + (link_blocks(key[0].as_py(), full_sets, of, reps, own, own, percent, share, k, forest) if len(own) else []))

    def across(key, t):
        """Some members outside the largest component with the members of a block."""
        reps, full_sets, of = read(t)
        odd = t["odd"].to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(odd), np.flatnonzero(~odd)
        return found(reps, link_blocks(key[0].as_py(), full_sets, of, reps, left, right, percent, share, k) if len(left) and len(right) else [])

    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    hot = members.filter("blocks > 1")
    pivots = hot.filter(F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("size")) < PIVOTS).select("value", "rep", each("blocks").alias("block"), F.lit(True).alias("pivot"))
    placed = members.select("value", "rep", block.alias("block"), F.lit(False).alias("pivot")).union(pivots)
    roots = components(placed.join(sets, "rep").groupBy("value", "block").applyInArrow(inside, "a long, b long"))
    if hot.isEmpty():
        return roots
    now = hot.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("value", "rep", "size", "blocks", F.coalesce("root", "rep").alias("root"))
    now = materialise(now, "hot-members", fewer_files=True)
    most = now.groupBy("value", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("value").agg(F.max_by("root", F.struct("c", "root")).alias("main"), (F.sum("c") - F.max("c")).alias("others")).filter("others > 0")
    most = materialise(most, "largest", fewer_files=True)
    if most.isEmpty():
        return roots
    now = now.join(most, "value").withColumn("parts", F.ceil(F.col("others") * F.col("blocks") / F.col("size")).cast("int"))
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    odd = now.filter("root <> main").select("value", "rep", part.alias("i"), each("blocks").alias("j"), F.lit(True).alias("odd"))
    rest = now.select("value", "rep", each("parts").alias("i"), block.alias("j"), F.lit(False).alias("odd"))
    more = odd.union(rest).join(sets, "rep").groupBy("value", "i", "j").applyInArrow(across, "a long, b long")
    return components(roots.union(more))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document; ``percent``: least similarity of linked documents."""
    small_batches(docs.sparkSession)
    share = need(percent, k)
    base = materialise(sketches(docs, k), "sketches")
    same = base.filter("s1 is not null and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c"))
    same = materialise(same.filter("c > 1").drop("c"), "equal-sets", fewer_files=True)
    ids = base.filter("s1 is not null and doc_id is not null")
    classes = ids.join(same, ["s1", "s2"], "left").filter("rep is null or rep = doc_id").select("doc_id", "n", "sketch")
    rows, lists = _lists(classes, share, k)
    roots = _roots(docs, rows, lists, percent, share, k)
    of_class = same.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("root", "rep").alias("of_class"))
    out = base.drop("sketch").join(of_class, ["s1", "s2"], "left").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the least doc_id, unchanged."""
    gone = near_duplicates(docs, percent).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents, whole texts."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS p FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.i >= 85 * (x.n + y.n - i.i)
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT e.b, r.root FROM r JOIN e ON e.a = r.node
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""
