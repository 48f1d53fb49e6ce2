"""Content-addressed store of token ids.

Layout under one root: ``staged`` holds each distinct chunk of ids once, named
by its SHA-256, and the recipes as they came; ``index`` holds a recipe for each
document, in ascending doc_id order, with the names of its chunks and the root
of the Merkle tree over them, and a manifest for each segment of recipes with
its totals and the root of the tree over its documents; ``manifest`` is one row
with the totals of the store and the root over its segments. A column tells the
kinds of the index apart; as files are columnar, readers of one kind skip the
other's columns. Chunks are cut where a rolling hash of the last ids has its
low bits zero, so equal passages give equal chunks wherever they stand.

Only names and lengths are shuffled more than once; a chunk's ids cross the
network one time, to meet their copies. Each task sends a name seldom more than
once, so a chunk that a third of all documents hold reaches its reducer about
once a task; there the rows are sorted by name and neighbours with the same
name are one.

Reading recomputes everything that was written: names from ids, roots of
documents from names, roots and totals of segments from documents, and those of
the store from segments. A lost, changed or displaced chunk, recipe or segment
ends the reading with an error that names it.

Defined results: a null text is an empty text, so its document is the end id
alone; a null doc_id comes first; repeated doc_ids keep a recipe each, ordered
by length and content; an empty table gives an empty store; other columns of
the input are ignored. Strings of special tokens in a text become their ids,
as the library does by itself.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.bpe import read_vocab
from basalt.llm.common import new_path, quiet_threads, small_batches
from basalt.llm.units import UnitTable

#: Ids in a chunk: least, usual and most; ids that the rolling hash sees (a power of two).
CHUNK_MIN, CHUNK_BITS, CHUNK_MAX, WINDOW = 256, 10, 4096, 8
#: Chunk names that a task remembers to have sent; those it forgets may be sent again.
CACHE = 100_000
INDEX = "kind string, segment int, doc_id long, at long, n_tokens long, chunks binary, root binary"
INDEX_NAMES = ["kind", "segment", "doc_id", "at", "n_tokens", "chunks", "root"]
STORE = "segments long, n_docs long, n_tokens long, id_bytes int, root binary"
ROW = "kind string, name binary, payload binary, doc_id long, n_tokens long, chunks binary"
_TABLE = np.random.Generator(np.random.PCG64(1)).integers(1, 1 << 62, 1 << 16, dtype=np.uint64)


class Encoder:
    """A tokenizer file of the tokenizers library, with a table of the units it has met."""

    def __init__(self, data: bytes):
        quiet_threads()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(data.decode())
        added = self.tok.get_added_tokens_decoder()
        #: Whether texts may be cut into units: no added token takes in white space or looks at what is beside it.
        self.by_unit = not any(set(t.content) & set(" \t\n\r") or t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.wide = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.leads = np.zeros(max([-1, *vocab.values(), *added]) + 2, bool)  # ids whose bytes begin with a space
        self.leads[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.table = UnitTable(self.encode, self.wide, self.joined, 2)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each string, each encoded alone."""
        out = []
        for i in range(0, len(texts), 250):
            out += [np.array(e.ids, self.wide).tobytes() for e in self.tok.encode_batch_fast(texts[i : i + 250], add_special_tokens=False)]
        return out

    def joined(self, raw: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings of so many bytes that follow one another in ``raw``, each with one space, at its beginning. Many
        are encoded at a time: no id crosses that space, so the ids are parted again where one begins with a space."""
        first = range(0, len(size), 256)
        at = np.concatenate([[0], np.cumsum(size)])
        texts, ids, counts = [raw[at[i] : at[min(i + 256, len(size))]].decode() for i in first], [], []
        for j in range(0, len(texts), 8):  # the library's results are large
            for i, e in zip(first[j : j + 8], self.tok.encode_batch_fast(texts[j : j + 8], add_special_tokens=False), strict=True):
                some, n = np.array(e.ids, np.int64), min(256, len(size) - i)
                lead = np.flatnonzero(self.leads[some])
                if len(lead) == n and lead[0] == 0:
                    ids.append(some.astype(self.wide))
                    counts.append(np.diff(lead, append=len(some)))
                    continue
                for one in self.encode([raw[a:b].decode() for a, b in zip(at[i : i + n].tolist(), at[i + 1 : i + n + 1].tolist(), strict=True)]):
                    ids.append(np.frombuffer(one, self.wide))
                    counts.append(np.array([len(ids[-1])]))
        return np.concatenate(ids), np.concatenate(counts)

    def documents(self, col: pa.Array, end: int):
        """Ids of each text and the end id, in the store's id type."""
        tail = np.array([end], self.wide)
        if not self.by_unit:
            for e in self.tok.encode_batch_fast([t or "" for t in col.to_pylist()], add_special_tokens=False):
                yield np.array([*e.ids, end], self.wide)
            return
        for i in range(0, len(col), 250):
            ids, n = self.table.ids(col.slice(i, 250))
            stop = np.cumsum(n)
            for a, b in zip((stop - n).tolist(), stop.tolist(), strict=True):
                yield np.concatenate([ids[a:b], tail])


@lru_cache(2)
def tokenizer(data: bytes) -> Encoder:
    return Encoder(data)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids, the last being their number."""
    n = len(ids)
    if n <= CHUNK_MIN:
        return [n]
    h, span = _TABLE[ids] if ids.dtype.itemsize == 2 else _TABLE[ids & 0xFFFF] ^ (ids.astype(np.uint64) >> np.uint64(16)), 1
    while span < WINDOW:  # the sum over twice as many ids, from two sums over as many
        h = h[span:] + h[:-span] * np.uint64(0x9E3779B97F4A7C15 ** span & (1 << 64) - 1)
        span *= 2
    at = np.flatnonzero((h >> np.uint64(64 - CHUNK_BITS)) == 0) + WINDOW
    out, start = [], 0
    for c in [*at.tolist(), n]:
        while c - start > CHUNK_MAX:
            start += CHUNK_MAX
            out.append(start)
        if c - start >= CHUNK_MIN or (c == n and c > start):
            out.append(c)
            start = c
    return out


class Merkle:
    """The root over leaves that come one by one; only the roots of whole subtrees are held, one for each height."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height, node = 0, hashlib.sha256(b"\0" + leaf).digest()
        while self.peaks and self.peaks[-1][0] == height:
            node = hashlib.sha256(b"\1" + self.peaks.pop()[1] + node).digest()
            height += 1
        self.peaks.append((height, node))

    def root(self) -> bytes:
        node = self.peaks[-1][1] if self.peaks else hashlib.sha256().digest()
        for _, left in reversed(self.peaks[:-1]):
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


def merkle_root(leaves) -> bytes:
    """The root over all ``leaves``."""
    tree = Merkle()
    for x in leaves:
        tree.add(x)
    return tree.root()


def _chunk_names(joined: bytes) -> list[bytes]:
    return [joined[i : i + 32] for i in range(0, len(joined), 32)]


def _document(doc_id: int | None, n_tokens: int, root: bytes) -> bytes:
    """A document as a leaf of its segment's tree."""
    return b"%s %d " % (b"-" if doc_id is None else b"%d" % doc_id, n_tokens) + root


def _segment(segment: int, n_docs: int, n_tokens: int, root: bytes) -> bytes:
    """A segment as a leaf of the store's tree."""
    return b"%d %d %d " % (segment, n_docs, n_tokens) + root


def write(docs: DataFrame, tokenizer_path: str, root: str, end_id: int = 0) -> None:
    """Encode ``docs`` (doc_id, text) and write the store under ``root``."""
    spark = docs.sparkSession
    small_batches(spark)
    data = spark.sparkContext.broadcast(read_vocab(tokenizer_path))

    def split(batches):
        enc, sent = tokenizer(data.value), set()
        for b in batches:
            rows = {c: [] for c in ("kind", "name", "payload", "doc_id", "n_tokens", "chunks")}
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.documents(b.column(1), end_id), strict=True):
                names, start = [], 0
                for stop in cuts(ids):
                    payload = ids[start:stop].tobytes()
                    name, start = hashlib.sha256(payload).digest(), stop
                    names.append(name)
                    if name not in sent:
                        if len(sent) > CACHE:
                            sent.clear()
                        sent.add(name)
                        for c, v in zip(rows, ("chunk", name, payload, None, None, None), strict=True):
                            rows[c].append(v)
                joined = b"".join(names)
                for c, v in zip(rows, ("recipe", hashlib.sha256(joined + str(doc_id).encode()).digest(), None, doc_id, len(ids), joined), strict=True):
                    rows[c].append(v)
            types = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in zip(rows, types, strict=True)], list(rows))

    def once(batches):
        last = None
        for b in batches:
            name = b.column(1)
            new = pc.not_equal(name[1:], name[:-1]).to_pylist() if len(name) else []
            keep = [last is None or bool(len(name)) and name[0].as_py() != last, *new][: len(name)]
            last = name[-1].as_py() if len(name) else last
            yield b.filter(pc.or_(pc.equal(b.column(0), "recipe"), pa.array(keep, pa.bool_())))

    # What a name's copies need is the same reducer; recipes travel along and stay spread out.
    rows = docs.select("doc_id", "text").mapInArrow(split, ROW).repartition("name").sortWithinPartitions("name")
    files = max(24, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)  # names of several partitions differ, so they may follow one another
    rows = rows.coalesce(files).mapInArrow(once, ROW)
    rows.write.option("compression", "zstd").parquet(f"{root}/staged")
    staged = spark.read.schema(ROW).parquet(f"{root}/staged")
    recipes = staged.filter("kind = 'recipe'").select("doc_id", "n_tokens", "chunks")
    ordered = recipes.repartitionByRange("doc_id", "n_tokens", "chunks").sortWithinPartitions("doc_id", "n_tokens", "chunks")

    def segments(batches):
        from pyspark import TaskContext

        segment, at, n, tree = TaskContext.get().partitionId(), 0, 0, Merkle()
        for b in batches:
            names = b.column(2).to_pylist()
            doc_roots = [merkle_root(_chunk_names(x)) for x in names]
            tokens = b.column(1).to_numpy()
            starts = at + np.cumsum(tokens) - tokens
            at, n = at + int(tokens.sum()), n + len(names)
            for doc_id, t, r in zip(b.column(0).to_pylist(), tokens.tolist(), doc_roots, strict=True):
                tree.add(_document(doc_id, t, r))
            m = len(names)
            yield pa.RecordBatch.from_arrays([pa.array(["recipe"] * m, pa.string()), pa.array([segment] * m, pa.int32()), b.column(0), pa.array(starts, pa.int64()), b.column(1), b.column(2), pa.array(doc_roots, pa.binary())], INDEX_NAMES)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(["manifest"]), pa.array([segment], pa.int32()), pa.array([None], pa.int64()), pa.array([n], pa.int64()), pa.array([at], pa.int64()), pa.array([None], pa.binary()), pa.array([tree.root()], pa.binary())], INDEX_NAMES)

    ordered.mapInArrow(segments, INDEX).write.parquet(f"{root}/index")
    got = _segments(spark, root)
    total = (len(got), sum(r["at"] for r in got), sum(r["n_tokens"] for r in got), np.dtype(tokenizer(data.value).wide).itemsize, _store_root(got))
    spark.createDataFrame([total], STORE).coalesce(1).write.parquet(f"{root}/manifest")


def _index(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{root}/index").filter(F.col("kind") == kind)


def _segments(spark: SparkSession, root: str) -> list:
    """The segments' manifests in order: one row for each partition that was written."""
    return sorted(_index(spark, root, "manifest").select("segment", "at", "n_tokens", "root").collect(), key=lambda r: r["segment"])


def _store_root(segments: list) -> bytes:
    return merkle_root(_segment(r["segment"], r["at"], r["n_tokens"], bytes(r["root"])) for r in segments)


def manifest(spark: SparkSession, root: str) -> tuple[list, str]:
    """The segments' manifests, checked against that of the store, and the type of its ids."""
    store = spark.read.schema(STORE).parquet(f"{root}/manifest").first()
    segments = _segments(spark, root)
    if len(segments) != store["segments"]:
        raise ValueError(f"{store['segments'] - len(segments)} of {store['segments']} segments are lost")
    if _store_root(segments) != bytes(store["root"]) or (sum(r["at"] for r in segments), sum(r["n_tokens"] for r in segments)) != (store["n_docs"], store["n_tokens"]):
        raise ValueError("a segment's manifest is damaged")
    return segments, f"<u{store['id_bytes']}"


def check_recipes(spark: SparkSession, root: str) -> None:
    """Recompute roots and totals of all segments from their recipes; only places, lengths and roots are shuffled."""

    def totals(batches):
        segment, n, at, tree = None, 0, 0, Merkle()
        names = ["segment", "n_docs", "n_tokens", "root"]
        made = lambda: pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([n], pa.int64()), pa.array([at], pa.int64()), pa.array([tree.root()], pa.binary())], names)
        for b in batches:
            for s, place, doc_id, t, r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if s != segment:
                    if segment is not None:
                        yield made()
                    segment, n, at, tree = s, 0, 0, Merkle()
                at = at + t if place == at else -1 << 62  # a recipe is gone or displaced
                n += 1
                tree.add(_document(doc_id, t, r))
        if segment is not None:
            yield made()

    small_batches(spark)
    rows = _index(spark, root, "recipe").select("segment", "at", "doc_id", "n_tokens", "root").repartition("segment").sortWithinPartitions("segment", "at")
    got = {r["segment"]: r for r in rows.mapInArrow(totals, "segment int, n_docs long, n_tokens long, root binary").collect()}  # a row for each segment
    for m in manifest(spark, root)[0]:
        g = got.pop(m["segment"], None)
        if g is None or g["n_docs"] != m["at"]:
            raise ValueError(f"segment {m['segment']}: {m['at'] - (g['n_docs'] if g else 0)} of {m['at']} recipes are lost")
        if (g["n_tokens"], bytes(g["root"])) != (m["n_tokens"], bytes(m["root"])):
            raise ValueError(f"segment {m['segment']}: a recipe is damaged or displaced")
    if got:
        raise ValueError(f"segment {min(got)}: its manifest is lost")


def chunks(spark: SparkSession, root: str) -> DataFrame:
    """name, payload of the stored chunks."""
    return spark.read.schema(ROW).parquet(f"{root}/staged").filter("kind = 'chunk'").select("name", "payload")


def recipes(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens, chunks, root of each document. ``start`` counts all ids before it:
    those of earlier segments, by the manifests, and those of its own."""
    segments = manifest(spark, root)[0]
    before = np.cumsum([0, *(r["n_tokens"] for r in segments)]).tolist()
    rows = [(r["segment"], b) for r, b in zip(segments, before, strict=False)]
    r = _index(spark, root, "recipe").join(F.broadcast(spark.createDataFrame(rows, "segment int, before long")), "segment")
    return r.select("segment", "at", "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "chunks", "root")


def _parts(r: DataFrame) -> DataFrame:
    """A row for each chunk of each document, with its place."""
    n = (F.octet_length("chunks") / 32).cast("int")
    return r.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("name", F.expr("substring(chunks, i * 32 + 1, 32)"))


def read_ids(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, ids (array<long>): the documents put together from their chunks."""
    wide = manifest(spark, root)[1]

    def join(batches):
        for b in batches:
            ids = [np.frombuffer(b"".join(p["payload"] for p in sorted(ps, key=lambda p: p["i"])), wide).astype("<i8") for ps in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    small_batches(spark)
    parts = _parts(recipes(spark, root)).join(chunks(spark, root), "name")
    docs = parts.groupBy("doc_id", "start").agg(F.collect_list(F.struct("i", "payload")).alias("parts"))
    return docs.mapInArrow(join, "doc_id long, start long, ids array<long>")


@lru_cache(1)
def _crc_steps() -> np.ndarray:
    """Matrices over GF(2) that append 2**k zero bytes to a CRC-32, for k = 0..39."""

    def times(m, v):
        out = np.zeros_like(v)
        for bit in range(32):
            out ^= np.where((v >> np.uint32(bit)) & np.uint32(1), m[bit], np.uint32(0))
        return out

    m = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint32)  # one zero bit
    for _ in range(3):
        m = times(m, m)
    steps = []
    for _ in range(40):
        steps.append(m)
        m = times(m, m)
    return np.array(steps)


def crc32_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What CRC-32s contribute when so many bytes follow. The CRC-32 of joined strings is the
    exclusive or of their CRC-32s, each shifted by the bytes after it."""
    out = crc.astype(np.uint32)
    for k, m in enumerate(_crc_steps()):
        on = np.flatnonzero((n_bytes >> k) & 1)
        if len(on):
            v, new = out[on], np.zeros(len(on), np.uint32)
            for bit in range(32):
                new ^= np.where((v >> np.uint32(bit)) & np.uint32(1), m[bit], np.uint32(0))
            out[on] = new
    return out


def verify(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read from the files and checked against names, roots and totals.

    Each stored chunk is read once: its name is recomputed, its ids are counted
    and summed into a CRC-32 of 32-bit ids. A document's figures are then made
    from those of its chunks, without moving ids again.
    """

    def measure(batches):
        for b in batches:
            names, n, crc = b.column(0).to_pylist(), [], []
            for name, payload in zip(names, b.column(1).to_pylist(), strict=True):
                if hashlib.sha256(payload).digest() != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                ids = np.frombuffer(payload, wide).astype("<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["name", "n", "crc"])

    def combine(batches):
        for b in batches:
            t = b.to_pydict()
            for names, doc_root in zip(t["chunks"], t["root"], strict=True):
                if merkle_root(_chunk_names(names)) != doc_root:
                    raise ValueError("a recipe is damaged")
            for doc_id, names, ps in zip(t["doc_id"], t["chunks"], t["parts"], strict=True):
                for p in ps:
                    if p["n"] is None:
                        raise ValueError(f"chunk {names[32 * p['i'] : 32 * p['i'] + 32].hex()} of document {doc_id} is lost")
            parts = [sorted((p["i"], p["n"], p["crc"]) for p in ps) for ps in t["parts"]]
            total = np.array([sum(p[1] for p in ps) for ps in parts], np.int64)
            if (total != np.array(t["n_tokens"], np.int64)).any():
                raise ValueError("a document has lost ids")
            flat = np.array([p for ps in parts for p in ps], np.int64).reshape(-1, 3)
            of = np.repeat(np.arange(len(parts)), list(map(len, parts)))
            end, upto = np.cumsum(total), np.cumsum(flat[:, 1])
            crc = np.zeros(len(parts), np.uint32)
            np.bitwise_xor.at(crc, of, crc32_shift(flat[:, 2], (end[of] - upto) * 4))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total), pa.array(crc.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    wide = manifest(spark, root)[1]
    check_recipes(spark, root)
    measured = chunks(spark, root).mapInArrow(measure, "name binary, n long, crc long")
    parts = _parts(recipes(spark, root)).join(measured, "name", "left")
    docs = parts.groupBy("doc_id", "start", "n_tokens", "chunks", "root").agg(F.collect_list(F.struct("i", "n", "crc")).alias("parts"))
    return docs.select("doc_id", "start", "n_tokens", "chunks", "root", "parts").mapInArrow(combine, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the store is written into the shared folder and read back."""
    import public_tokenizers as P

    root = new_path(spark, "token-store")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.json"), root)
    return verify(spark, root)
