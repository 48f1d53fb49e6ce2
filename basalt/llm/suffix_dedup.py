"""Repeated passages by a sparse suffix array.

Only suffixes that begin at minimisers are retained: of the :data:`STEP` places
at which a window of :data:`PASSAGE` words can begin its second half, the one
whose next :data:`PREFIX` words have the least hash (the first of equals). The
choice depends on the words alone, so two documents that share a window retain
the same suffix in it, and that suffix goes on for :data:`PREFIX` words within
the window at least.

The array holds each retained suffix of a document once, sorted by its first
words (their hash) and by document over ranges of the whole corpus; a suffix
whose neighbours both begin otherwise is left. The others are extended, up to
``STEP - 1`` words to the left and as far to the right, over all windows that
belong to them. The windows are sorted in the same way and compared with their
neighbours: a window that two documents hold is a repeat in both, and
removable in all of them but the one with the smallest doc_id. So each window
that two documents share is found, whatever stands around it and however many
hold it.

Both sorts are by range, over the document too: a passage that a third of all
documents hold is dealt over many tasks. Where a run of equal windows reaches
an edge of a range (two runs of each range at most) its rows are settled by the
least and the greatest doc_id of all its parts. Documents of the same words are
one text throughout, that of the smallest doc_id; the others are repeats as a
whole. Hashes have 64 bits: of n windows, a share of about n / 2**64 could be
taken for a repeat by chance.

Defined results: null and empty texts and texts shorter than a passage have no
repeats; repeats within one document do not count; rows that repeat a doc_id
are one document; a null doc_id has no repeats; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import Memory, materialise, small_batches

PASSAGE, PREFIX = 50, 25
STEP = PASSAGE - PREFIX + 1  # places of a window at which its retained suffix can begin
#: Equal windows of one document that wait for a neighbour of another one; more are settled like those at an edge.
WAIT = 1_000_000
#: Words that are hashed at once.
WORDS = 1 << 18
SPANS = "doc_id long, begin long, stop long, later boolean"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words: of runs of 1, 2, 4, ... words, then of those that make it up."""
    n = max(0, len(words) - length + 1)
    run, size, out, at = _mixed(words), 1, np.zeros(n, np.uint64), 0
    while n:
        if length & size:
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + run[at : at + n])
            at += size
        if size * 2 > length:
            break
        run = _mixed(run[:-size] * np.uint64(0x9E3779B97F4A7C15) + run[size:])
        size *= 2
    return out


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` neighbours, the first of equals."""

    def better(a, b):
        return np.where(h[b] < h[a], b, a)

    at, size = np.arange(len(h)), 1
    while size * 2 <= width:
        at = better(at[:-size], at[size:])
        size *= 2
    n = len(h) - width + 1
    return better(at[:n], at[width - size : width - size + n])


class Reader:
    """Word hashes of texts, A-Z in lower case, words parted by ASCII white space."""

    def __init__(self):
        self.memory = Memory(150_000)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, one text after the other, and where each begins (and the last ends)."""
        import xxhash

        parts, n = [], []
        for t in texts:
            words = t.encode().lower().split() if t else []
            self.memory.learn(set(words), lambda ws: [xxhash.xxh3_64_intdigest(w) for w in ws])
            parts.append(np.fromiter(map(self.memory.data.__getitem__, words), np.uint64, len(words)))
            n.append(len(words))
        return np.concatenate([np.zeros(0, np.uint64), *parts]), np.cumsum([0, *n])

    def windows(self, texts: list[str | None]):
        """For texts some at a time: their first number and word hashes, their beginnings, and of each window its
        text, first word, hash, and the hash of the suffix that it belongs to."""
        step, size = [], 0
        for i, t in enumerate(texts):
            step.append(t)
            size += len(t or "") // 6
            if size >= WORDS or i + 1 == len(texts):
                words, at = self.words(step)
                first = i + 1 - len(step)
                step, size = [], 0
                prefix = _runs(words, PREFIX)
                doc = np.repeat(np.arange(len(at) - 1), np.maximum(0, np.diff(at) - PASSAGE + 1))
                if not len(doc):
                    yield first, words, at, doc, doc, np.zeros(0, np.int64), np.zeros(0, np.int64)
                    continue
                many = np.bincount(doc, minlength=len(at) - 1)
                begin = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                place = at[doc] + begin
                suffix = prefix[_least(prefix, STEP)[place]]
                window = _mixed(prefix[place] * np.uint64(0x9E3779B97F4A7C15) + prefix[place + PREFIX])
                yield first, words, at, doc, begin, window.view(np.int64), suffix.view(np.int64)


def _retained(batches):
    """doc_id, s1, s2 (128 bits of all words), n (words), suffixes (distinct, of the document's windows)."""
    reader = Reader()
    for b in batches:
        sig, n, found = [], [], []
        for _, words, at, doc, _, _, suffix in reader.windows(b.column(1).to_pylist()):
            new = np.ones(len(doc), bool)  # windows that are neighbours mostly share their suffix
            new[1:] = (suffix[1:] != suffix[:-1]) | (doc[1:] != doc[:-1])
            cut = np.searchsorted(doc[new], np.arange(len(at)))
            for k, s in enumerate(np.split(suffix[new], cut[1:-1])):
                sig.append(np.frombuffer(hashlib.blake2b(words[at[k] : at[k + 1]].tobytes(), digest_size=16).digest(), "<i8").tolist())
                n.append(int(at[k + 1] - at[k]))
                found.append(np.unique(s))
        cols = [pa.array([x[j] for x in sig], pa.int64()) for j in range(2)]
        out = pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "s1", "s2", "n", "suffixes"])
        yield out.filter(pa.array([x >= PASSAGE for x in n], pa.bool_()))


def _neighbours(batches):
    """doc_id, suffix: of the sorted rows those that begin as a neighbour does, and the two at the range's edges."""
    doc, suffix, keep = np.zeros(0, np.int64), np.zeros(0, np.int64), True  # the last row, and whether it stays
    for b in batches:
        if not b.num_rows:
            continue
        doc, suffix = (np.concatenate([old, b.column(j).to_numpy()]) for j, old in enumerate((doc, suffix)))
        same, stay = suffix[1:] == suffix[:-1], np.zeros(len(doc), bool)
        stay[0] = keep
        stay[1:] |= same
        stay[:-1] |= same
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][stay[:-1]]) for x in (doc, suffix)], b.schema.names)
        doc, suffix, keep = doc[-1:], suffix[-1:], bool(stay[-1])
    if len(doc):
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(suffix)], ["doc_id", "suffix"])


#: What is known of a window: its document has it first, an earlier one has it, its run may go on in another range.
FIRST, LATER, OPEN = 0, 1, 2


def _rows(parts: list[list[np.ndarray]], whole: bool):
    """window, doc_id, begin, state: the repeats among whole runs, or all rows of an open one."""
    if not sum(len(p[0]) for p in parts):
        return
    w, d, g = (np.concatenate([p[j] for p in parts]) for j in range(3))
    state = np.full(len(w), OPEN, np.int8)
    if whole:
        new = np.concatenate([[True], w[1:] != w[:-1]])
        starts, run = np.flatnonzero(new), np.cumsum(new) - 1
        low, high = d[starts][run], d[np.append(starts[1:], len(d)) - 1][run]
        state = np.where(d > low, LATER, FIRST).astype(np.int8)
        w, d, g, state = (x[low < high] for x in (w, d, g, state))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w, d, g, state)], ["window", "doc_id", "begin", "state"])


def _compared(batches):
    """window, doc_id, begin, state: of the sorted windows those that two documents hold, or whose run is open."""
    held, run, open_ = [], None, True  # rows of the run that goes on; the range's first run is open
    for b in batches:
        if not b.num_rows:
            continue
        part = [b.column(j).to_numpy() for j in range(3)]
        w = part[0]
        run = w[0] if run is None else run
        head = int(np.searchsorted(w, run, "right"))
        held.append([x[:head] for x in part])
        if head == len(w):
            if open_ or sum(len(p[0]) for p in held) > WAIT:
                yield from _rows(held, False)
                held, open_ = [], True
            continue
        yield from _rows(held, not open_)
        tail = int(np.searchsorted(w, w[-1]))
        yield from _rows([[x[head:tail] for x in part]], True)
        held, run, open_ = [[x[tail:] for x in part]], w[-1], False
    yield from _rows(held, False)


def _settled(batches, window: np.ndarray, low: np.ndarray):
    """doc_id, begin, stop, later: open rows whose window is in ``window`` (sorted, with the least doc_id of each) are repeats."""
    for b in batches:
        w, d, g, state = (b.column(j).to_numpy() for j in range(4))
        at = np.searchsorted(window, w)
        known = (at < len(window)) & (np.append(window, 0)[at] == w)
        use = (state != OPEN) | known
        later = np.where(state == OPEN, d > np.append(low, 0)[at], state == LATER)
        yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (d, g, g + PASSAGE, later)], ["doc_id", "begin", "stop", "later"])


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, begin, stop, later: passages (words begin..stop-1) whose windows another document has too, all of
    them a document with a smaller doc_id where ``later``. Together the rows cover all repeats."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    texts = materialise(docs.mapInArrow(_retained, "doc_id long, s1 long, s2 long, n long, suffixes array<long>"), "suffixes")
    equal = texts.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("high"), F.max("n").alias("n")).filter("rep < high")
    equal = materialise(equal.select("s1", "s2", "rep"), "equal-texts", fewer_files=True)
    texts = texts.join(equal.hint("merge"), ["s1", "s2"], "left")
    copies = texts.filter("rep is not null").select("doc_id", F.lit(0).cast("long").alias("begin"), F.col("n").alias("stop"), (F.col("doc_id") > F.col("rep")).alias("later"))

    array = texts.filter("rep is null or rep = doc_id").select("doc_id", F.explode("suffixes").alias("suffix"))
    array = array.repartitionByRange("suffix", "doc_id").sortWithinPartitions("suffix", "doc_id")
    kept = array.mapInArrow(_neighbours, "doc_id long, suffix long")
    wanted = materialise(kept.groupBy("doc_id").agg(F.collect_set("suffix").alias("suffixes")), "wanted")

    def extended(batches):
        """window, doc_id, begin: the windows of the suffixes asked for."""
        reader = Reader()
        for b in batches:
            ids, asked = b.column(0).to_numpy(), b.column(1)
            asked, place = asked.flatten().to_numpy(), np.asarray(asked.offsets) - asked.offsets[0].as_py()
            for first, _, _, doc, begin, window, suffix in reader.windows(b.column(2).to_pylist()):
                use = np.zeros(len(doc), bool)
                cut = np.searchsorted(doc, np.arange(doc[-1] + 2)) if len(doc) else [0]
                for k in range(len(cut) - 1):
                    if cut[k] < cut[k + 1]:
                        use[cut[k] : cut[k + 1]] = np.isin(suffix[cut[k] : cut[k + 1]], asked[place[first + k] : place[first + k + 1]])
                yield pa.RecordBatch.from_arrays([pa.array(window[use]), pa.array(ids[first + doc[use]]), pa.array(begin[use])], ["window", "doc_id", "begin"])

    # a sort-merge join at every size: what is asked for grows with the input
    rows = docs.join(wanted.hint("merge"), "doc_id").select("doc_id", "suffixes", "text").mapInArrow(extended, "window long, doc_id long, begin long")
    rows = materialise(rows, "windows")
    rows = rows.repartitionByRange("window", "doc_id").sortWithinPartitions("window", "doc_id")
    found = materialise(rows.mapInArrow(_compared, "window long, doc_id long, begin long, state byte"), "compared")
    # two runs of each range at most, and those longer than WAIT: small at every size
    ends = found.filter(F.col("state") == OPEN).groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    ends = ends.select("window", "low").toArrow().sort_by("window")
    sent = spark.sparkContext.broadcast(tuple(ends[c].to_numpy() for c in ("window", "low")))

    def settled(batches):
        return _settled(batches, *sent.value)

    return found.mapInArrow(settled, SPANS).union(copies)


def _merged(begin: np.ndarray, stop: np.ndarray) -> list[dict[str, int]]:
    """Union of spans that touch; ``begin`` ascends."""
    if not len(begin):
        return []
    top = np.maximum.accumulate(stop)
    new = np.concatenate([[True], begin[1:] > top[:-1]])
    ends = top[np.concatenate([np.flatnonzero(new)[1:], [len(top)]]) - 1]
    return [{"begin": a, "stop": b} for a, b in zip(begin[new].tolist(), ends.tolist(), strict=True)]


def _of_documents(batches):
    """doc_id, spans, removable: from spans sorted by doc_id and begin."""
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))

    def made(parts):
        d, a, b, later = (np.concatenate([p[j] for p in parts]) for j in range(4))
        cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])).tolist()
        rows = [(int(d[i]), _merged(a[i:j], b[i:j]), _merged(a[i:j][later[i:j]], b[i:j][later[i:j]])) for i, j in zip(cut, [*cut[1:], len(d)], strict=True)]
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], kind), pa.array(cols[2], kind)], ["doc_id", "spans", "removable"])

    held = []
    for b in batches:
        if not b.num_rows:
            continue
        part = [b.column(j).to_numpy(zero_copy_only=False) for j in range(4)]
        if held and held[-1][0][-1] == part[0][-1]:
            held.append(part)
            continue
        cut = int(np.searchsorted(part[0], part[0][-1]))
        held.append([x[:cut] for x in part])
        if sum(len(p[0]) for p in held):
            yield made(held)
        held = [[x[cut:] for x in part]]
    if held:
        yield made(held)


def mark(docs: DataFrame) -> DataFrame:
    """doc_id, n_repeated (words in repeats), spans (array of begin, stop), removable (those that a document
    with a smaller doc_id has too) of each document."""
    span = "array<struct<begin: bigint, stop: bigint>>"
    rows = repeats(docs).repartition("doc_id").sortWithinPartitions("doc_id", "begin")
    by = rows.mapInArrow(_of_documents, f"doc_id long, spans {span}, removable {span}")
    out = docs.select("doc_id").join(by, "doc_id", "left")
    none = F.expr("array_repeat(named_struct('begin', 0L, 'stop', 0L), 0)")
    words = lambda c: F.aggregate(F.coalesce(c, none), F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["begin"])
    return out.select("doc_id", words(F.col("spans")).alias("n_repeated"), words(F.col("removable")).alias("n_removable"), F.coalesce("spans", none).alias("spans"), F.coalesce("removable", none).alias("removable"))


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, text without its removable passages (words joined by spaces where something is removed)."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").join(mark(docs).select("doc_id", "removable").dropDuplicates(["doc_id"]), "doc_id", "left")

    def cut(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if spans:
                    words = text.encode().split()
                    for s in reversed(spans):
                        del words[s["begin"] : s["stop"]]
                    text = b" ".join(words).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "text", "removable").mapInArrow(cut, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: passages that all documents repeat; spans as text, ``begin-stop`` parted by commas."""
    m = mark(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",")
    return m.select("doc_id", "n_repeated", "n_removable", F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("repeated"), spans.alias("spans"))


_islands = """SELECT doc_id, min(p) AS a, max(p) + {0} AS b FROM (
    SELECT doc_id, p, sum(CASE WHEN p - before <= {0} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM {1}) t
  ) u GROUP BY doc_id, island"""
SQL = f"""
WITH w AS (
  SELECT DISTINCT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), win AS (
  SELECT doc_id, p, array_to_string(w[p + 1:p + {PASSAGE}], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - {PASSAGE})) AS p FROM w WHERE len(w) >= {PASSAGE})
), own AS (
  SELECT s, min(doc_id) AS low FROM win GROUP BY s HAVING min(doc_id) <> max(doc_id)
), hit AS (
  SELECT DISTINCT doc_id, p, low < doc_id AS later FROM win JOIN own USING (s)
), hit_later AS (SELECT DISTINCT doc_id, p FROM hit WHERE later), hit_all AS (SELECT DISTINCT doc_id, p FROM hit), spans AS ({_islands.format(PASSAGE, "hit_all")}), gone AS ({_islands.format(PASSAGE, "hit_later")}), n AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS k, string_agg(a || '-' || b, ',' ORDER BY a) AS t FROM spans GROUP BY 1
), g AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_repeated, coalesce(g.n, 0) AS n_removable, coalesce(n.k, 0) AS n_spans, n.n IS NOT NULL AS repeated, coalesce(n.t, '') AS spans
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
"""
