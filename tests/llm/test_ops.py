"""Operators against brute force on a small corpus with nulls, ties, repeats, long texts and clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("basalt.llm.queries")

from basalt.llm import bpe, components, decontaminate, language_id, line_dedup, near_dedup, quality, quotation, suffix_dedup, token_store, units, warc
from basalt.llm.common import new_path

P = pytest.importorskip("public_tokenizers")
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, drop array<int>, kept string, value long"


def prose(n, r=rng):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def corpus():
    base, passage, line = prose(300), prose(70), "This Is A Common Line of text"
    docs = {
        1: base, 2: base, 3: base.replace(base.split()[150], "changed", 1), 4: " ".join(base.split()[:297]), 5: None, 6: "", 7: " \t\n ", 8: "one two", 9: "ONE  two", 10: "alone",
        11: f"{prose(40)} {passage} {prose(30)}", 12: f"{prose(80)} {passage} {prose(10)}", 13: f"{line}\n{prose(20)}\n  {line.upper()} \nshort", 14: f"{prose(10)}\n{line}\nshort", 15: f"\n\n{line}\n", 16: "x" * 4000, 17: "漢字" * 900 + "   end", 18: "a  b   c\n\n\nd <|endoftext|> 'll 12345 \x1c z　",
        19: " ".join(["word"] * 200), 20: prose(5000), 21: "!!! ### $$$ " * 30,
    }
    rows = [(k, t) for k, t in docs.items()] + [(1, base), (None, base), (None, None)]
    return rows + [(100 + i, prose(60) if i % 3 else base.replace(base.split()[i], f"w{i}", 1)) for i in range(60)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i is None or i % 5 == 0 else "en", "s", None, 0.5, [1], "k", 7) for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# -- byte-level BPE and the store ------------------------------------------


def test_bpe_equals_the_library_and_round_trips(docs, none):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in ROWS:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert table(bpe.digests(docs, path, P.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert bpe.digests(none, path, P.PATTERN).count() == 0
    got = {(r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in bpe.encode(docs, path, P.PATTERN).collect()}
    assert got == {(i, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t in ROWS}


def test_bpe_matrix_on_odd_strings():
    import tiktoken

    data = bpe.read_vocab(P.path("byte_bpe_50k.tiktoken"))
    own = bpe.encoder(data, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(1)
    texts = ["".join(r.choice("ab \n\t'sé漢　\x1c!1😀") for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["ab" * 5000, " " * 999, "漢字" * 700]
    for t, got in zip(texts, own.encode_batch(texts), strict=True):
        assert got.tolist() == enc.encode_ordinary(t) and own.decode(got.tolist()) == t.encode()


def test_token_store_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    special = [(900, "a <|endoftext|> b"), (901, "x<|endoftext|>y z <|endoftext|><|endoftext|>  <|endoftext|>"), (902, "<|endoftext|>"), (903, "<|endof text|> <|endoftext|")]
    all_rows = ROWS + special
    assert tok.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    root = new_path(spark, "store")
    token_store.write(docs.select("doc_id", "text", "value").union(spark.createDataFrame([(*x, 7) for x in special], "doc_id long, text string, value long")), path, root)
    per = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in all_rows]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    got = token_store.verify(spark, root).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(((i, len(x), crc(x)) for i, x in per), key=str)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((i for i, _ in all_rows), key=lambda i: -1 if i is None else i)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered[:-1])]).tolist()
    back = token_store.read_ids(spark, root).collect()
    assert sorted(((r.doc_id, tuple(r.ids)) for r in back), key=str) == sorted(((i, tuple(x)) for i, x in per), key=str)
    assert {(r.doc_id, r.start) for r in back} == {(r.doc_id, r.start) for r in got}
    stored = token_store.chunks(spark, root)
    assert stored.count() == stored.select("name").distinct().count()
    assert stored.agg({"payload": "count"}).first()[0] < len(all_rows) + 30  # copies share chunks
    empty = new_path(spark, "store")
    token_store.write(none, path, empty)
    assert token_store.verify(spark, empty).count() == 0 and token_store.read_ids(spark, empty).count() == 0


@pytest.mark.parametrize("full, ids", [(600_000, 4_000_000), (300, 2000)])
def test_new_units_are_encoded_without_a_string_each(monkeypatch, full, ids):
    """Ids are the library's, also where the table of units is cleared; only odd, long and first units become strings of their own."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(units, "FULL", full)
    monkeypatch.setattr(units, "FULL_IDS", ids)
    path = P.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), token_store.Encoder(bpe.read_vocab(path))
    odd = ["a<|endoftext|>b", "<|endoftext|>", "\u00a0x", "x\u2003y", "\x00z", "z\x00", "ab\ncd", "\tq", "q\t", "x" * 24, "x" * 40, "\u6f22\u5b57", "\u0085", "\U0001f600", "'s", "1234567", "%%%", "\u00e0\u00e9", "", "y"]
    words = [f"w{i}v{i * 7919 % 1000}" for i in range(2000)]
    columns = [[" ".join(words[i : i + 100] + odd), " ".join(odd), None, "", " ", "a  b \n c d"] for i in range(0, 2000, 100)] + [[" ".join(words)]]
    seen, alone = [], enc.table.encode
    enc.table.encode = lambda texts: (seen.extend(texts), alone(texts))[1]
    for texts in columns:
        got = [x.tolist() for x in enc.documents(pa.array(texts, pa.string()), 0)]
        assert got == [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert full == 300 or len(seen) < 100


def test_merkle_tree():
    h = lambda x: hashlib.sha256(x).digest()
    a, b, c = (h(b"\0" + x) for x in (b"a", b"b", b"c"))
    assert token_store.merkle_root([]) == h(b"") and token_store.merkle_root([b"a"]) == a
    assert token_store.merkle_root([b"a", b"b", b"c"]) == h(b"\1" + h(b"\1" + a + b) + c)
    roots = {token_store.merkle_root([b"%d" % i for i in range(n)]) for n in range(40)}
    assert len(roots) == 40 and token_store.merkle_root([b"a", b"b"]) != token_store.merkle_root([b"b", b"a"])


@pytest.mark.parametrize("part, change, says", [
    ("staged", "select * from t union all select 'chunk', name, concat(payload, unhex('0000')), null, null, null from (select * from t where kind = 'chunk' limit 1)", "damaged"),
    ("staged", "select * from t where name <> (select max(name) from t where kind = 'chunk')", "is lost"),
    ("index", "select * from t where not (kind = 'recipe' and doc_id <=> 11)", "recipes are lost"),
    ("index", "select kind, segment, case when kind = 'recipe' and doc_id = 11 then 12 when kind = 'recipe' and doc_id = 12 then 11 else doc_id end as doc_id, at, n_tokens, chunks, root from t", "displaced"),
    ("index", "select kind, segment, doc_id, at, n_tokens, case when doc_id = 3 then (select max(chunks) from t where doc_id = 2) else chunks end as chunks, root from t", "recipe is damaged"),
    ("index", "select * from t where not (kind = 'manifest' and segment = (select max(segment) from t))", "segments are lost"),
    ("index", "select kind, segment, doc_id, at + case when kind = 'manifest' then 1 else 0 end as at, n_tokens, chunks, root from t", "manifest is damaged"),
])
def test_store_notices_damage(spark, docs, part, change, says):
    """Each loss or change is named; the rest of the store is as written."""
    root = new_path(spark, "store")
    token_store.write(docs, P.path("byte_bpe_50k.json"), root)
    whole = spark.read.schema(token_store.ROW if part == "staged" else token_store.INDEX).parquet(f"{root}/{part}")
    whole.createOrReplaceTempView("t")
    rows = spark.createDataFrame(spark.sql(change).collect(), whole.schema)
    rows.write.mode("overwrite").parquet(f"{root}/{part}")
    with pytest.raises(Exception, match=says):
        token_store.verify(spark, root).collect()


# -- duplicates --------------------------------------------------------------


def brute_sets():
    sets = {}
    for i, t in ROWS:
        w = t.encode().lower().split() if t else []
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return sets


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, none, percent):
    sets = brute_sets()
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(docs, percent).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (find(r.doc_id), find(r.doc_id) == r.doc_id), r
            assert r.n_shingles in [len(s) for s in sets[r.doc_id]]
    assert near_dedup.near_duplicates(none).count() == 0
    stay = {r.doc_id for r in near_dedup.deduplicated(docs, percent).collect()}
    assert stay == {None} | {i for i in ids if find(i) == i}


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A group larger than a block: near copies that are only linked through others."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    r = random.Random(2)
    base = prose(120, r).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in rows]
    comp = list(range(90))
    for a in range(90):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                lo, hi = sorted((comp[a], comp[b]))
                comp = [lo if c == hi else c for c in comp]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(comp)) and 1 < len(set(comp)) < 90


@pytest.mark.parametrize("pivots", [0, 2, 32])
def test_near_duplicates_of_a_hot_list(spark, monkeypatch, pivots):
    """Several clusters and single sets that share most of their text, over many blocks: every link of each, nothing else."""
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    r = random.Random(21)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for cluster in range(6):
        mine = [f"c{cluster}x{i}" for i in range(40 if cluster else 8)]
        for _ in range((30, 14, 9, 3, 2, 1)[cluster]):
            w = base + mine
            for _ in range(r.randint(0, 2)):
                w = [*w[:-4], f"e{r.randrange(10**6)}", *w[-4:]] if r.random() < 0.5 else [f"s{r.randrange(10**6)}", *w]
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    r.shuffle(rows)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                lo, hi = sorted((comp[a], comp[b]))
                comp = {i: lo if c == hi else c for i, c in comp.items()}
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == comp and len(set(comp.values())) >= 6


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (41, 50), (60, 60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {50: 40, 41: 40}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def key(line):
    k = line.encode().strip(b" \t\n\v\f\r").lower().decode()
    return k if len(k) >= 10 else None


@pytest.mark.parametrize("batches", [1, 3, 9])
def test_line_dedup(docs, none, batches):
    owner, many = {}, {}
    for i, t in ROWS:
        for line in (t or "").split("\n"):
            if i is not None and key(line):
                owner[key(line)] = min(i, owner.get(key(line), i))
                many.setdefault(key(line), set()).add(i)
    want = []
    for i, t in ROWS:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or not key(x) or len(many[key(x)]) < 2 or owner[key(x)] == i]
        want.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    got = line_dedup.dedup(docs, batches)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept or "") for r in got.collect()), key=str) == sorted(want, key=str)
    assert line_dedup.dedup(none, batches).count() == 0


def brute_repeats():
    words = {i: [w for w in t.encode().lower().split()] for i, t in ROWS if t and i is not None}
    where = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add(i)
    hit = {i: set() for i in words}
    for i, w in words.items():
        for k in range(len(w) - 49):
            if len(where[tuple(w[k : k + 50])]) > 1:
                hit[i].update(range(k, k + 50))
    return hit


def test_suffix_dedup(docs, none):
    hit = brute_repeats()
    for r in suffix_dedup.mark(docs).collect():
        covered = {w for s in r.spans for w in range(s.begin, s.stop)}
        assert covered <= hit.get(r.doc_id, set())  # nothing that is not repeated
        assert r.n_repeated == len(covered)
        if r.doc_id in (1, 2, 3, 4, 11, 12):
            assert covered == hit[r.doc_id], r.doc_id
    total = sum(r.n_repeated for r in suffix_dedup.mark(docs).dropDuplicates(["doc_id"]).collect())
    assert total >= 0.98 * sum(map(len, hit.values()))
    assert suffix_dedup.mark(none).count() == 0
    clean = {r.doc_id: r.text for r in suffix_dedup.cleaned(docs).collect()}
    assert clean[11] == dict(ROWS)[11] and len(clean[12].split()) == 90 and clean[5] is None


# -- benchmark ---------------------------------------------------------------


def test_decontaminate(spark, docs, none):
    texts = dict(ROWS)
    w = decontaminate.words_of(texts[20])
    item = lambda a, b: b" ".join(w[a:b]).upper().decode()
    items = [(1, item(10, 40)), (2, item(35, 47)), (10, "one TWO"), (3, "not there at all in any of these texts here today"), (4, None), (5, ""), (6, "!!"), (7, item(100, 109)), (7, item(100, 109)), (None, item(200, 212)), (8, "two"), (9, item(4990, 5000))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("x", "x")
    windows = []
    for i, t in items:
        x = decontaminate.words_of(t)
        windows += [(i, x[k : k + 10]) for k in range(max(1, len(x) - 9))] if x else []
    want = []
    for i, t in ROWS:
        d = decontaminate.words_of(t)
        hit, found = set(), set()
        for it, x in windows:
            for k in range(len(d) - len(x) + 1):
                if d[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    found |= {str(it)} if it is not None else set()
        want.append((i, len(d), sorted(hit), sorted(found)))
    for size in (decontaminate.BLOCK_CHARS, 60):
        decontaminate.BLOCK_CHARS = size
        got = [(r.doc_id, r.n_words, sorted(r.hit_words), sorted(r["items"])) for r in decontaminate.mark(docs, bench).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    decontaminate.BLOCK_CHARS, decontaminate.PIECE_WORDS = 200, 7  # items in pieces
    got = [(r.doc_id, r.n_words, sorted(r.hit_words), sorted(r["items"])) for r in decontaminate.mark(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    decontaminate.BLOCK_CHARS, decontaminate.PIECE_WORDS = 8 << 20, 1 << 16
    assert decontaminate.mark(none, bench).count() == 0 and decontaminate.clean(none, bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(ROWS)
    assert {tuple(r.hit_words) for r in decontaminate.mark(docs, bench.limit(0)).collect()} == {()}
    other = spark.createDataFrame([(500, texts[20]), (500, "a clean text"), (None, texts[20])], "doc_id long, text string").selectExpr("doc_id", "text", "1 as n_words", "'x' as items", "array(2) as hit_words")
    assert [tuple(r) for r in decontaminate.clean(other, bench).collect()] == [(500, "a clean text", 1, "x", [2])]
    assert sorted(((r.doc_id, r.text) for r in decontaminate.clean(docs, bench).collect()), key=str) == sorted(((i, t) for (i, t), (_, _, h, _) in zip(ROWS, want, strict=True) if not h), key=str)


# -- language, quality -------------------------------------------------------


def test_language(spark, none):
    r = random.Random(3)
    sets = {"xx": ["alpha", "beta", "gamma", "delta"], "yy": ["uno", "dos", "tres", "cuatro"], "zz": ["ett", "två", "tre", "fyra"]}
    rows = [(i, " ".join(r.choice(sets[lang]) + r.choice(["", "s", "r"]) for _ in range(r.randint(3, 40))), lang) for i in range(600) for lang in [r.choice(list(sets))]]
    odd = [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 456 !!", "yy"), (1003, "alphabetagamma", None), (None, "uno dos", "yy"), (1004, "uno " * 3000, None), (1004, "uno " * 3000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "'clash' as lang_pred", "1 as gram")
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.97 * len(held)
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[1003].lang_pred == "xx" and got[1004].lang_pred == "yy" and got[None].lang_pred == "yy"
    assert all(0 <= x.score <= 1 for x in got.values())
    # held-out texts and labels change nothing
    other = docs.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'uno uno' else text end as text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'xx' else lang end as lang")
    again = language_id.fit(other)
    assert again.langs == model.langs and again.index == model.index and (again.logs == model.logs).all()
    blank = language_id.fit(none)
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs, blank).collect()} == {("und", 0.0)}
    assert language_id.identify(none, model).count() == 0 and language_id.accepted(docs, model).columns == docs.columns
    assert language_id.accepted(docs, blank).count() == docs.count() and language_id.accepted(none, model).count() == 0


def brute_language(rows, texts):
    """lang_pred and score of each text by the rule itself, counted and scored without numpy."""
    import math
    import unicodedata
    from collections import Counter

    def words(t):
        return "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (t or "").lower()).split()

    grams = lambda w, n: [w] if n == 0 else [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]
    learned = [(t, lang) for i, t, lang in rows if None not in (i, t, lang) and zlib.crc32(str(i).encode()) % 4 != 2]
    count = [{lang: Counter() for _, lang in learned} for _ in range(6)]
    for t, lang in learned:
        for w in words(t):
            for n in range(6):
                count[n][lang].update(grams(w, n))
    langs = sorted(count[0])
    vocab = [set().union(*c.values()) for c in count]
    log = lambda n, lang, g: math.log((count[n][lang][g] + 0.5) / (sum(count[n][lang].values()) + 0.5 * len(vocab[n])))
    out = []
    for t in texts:
        total, familiar, ws = dict.fromkeys(langs, 0.0), 0.0, words(t)
        if not ws or not langs:
            out.append(("und", 0.0))
            continue
        for w, c in Counter(ws).items():
            if w in vocab[0]:
                found, n, part = [w], 0, 1
            else:
                n = next((n for n in range(5, 0, -1) if any(g in vocab[n] for g in grams(w, n))), 5)
                found = [g for g in grams(w, n) if g in vocab[n]]
                part = sum(g in vocab[4] for g in grams(w, 4)) / max(1, len(grams(w, 4)))
            familiar += c * part
            for lang in langs:
                total[lang] += c * sum(log(n, lang, g) for g in found) / max(1, len(found))
        best = max(langs, key=lambda k: (total[k], [-ord(x) for x in k]))
        share = 1 / sum(math.exp((total[k] - total[best]) / math.sqrt(len(ws))) for k in langs)
        out.append((best, share if familiar / len(ws) >= 0.6 else share * 0.4 * familiar / len(ws) / 0.6))
    return out


def test_language_by_brute_force(spark):
    """Every prediction and score, with numerals, unseen words, a tie of two languages with the same words, and long texts."""
    r = random.Random(12)
    words = {k: ["".join(r.choice(k * 3 + "aeiost") for _ in range(r.randint(2, 8))) for _ in range(60)] for k in ("bcd", "fgh", "ñçé")}
    rows = [(i, " ".join(r.choices(words[k], k=r.randint(1, 50))), k) for i in range(160) for k in [r.choice(list(words))]]
    rows += [(i, "same words here", lang) for i, lang in ((400, "t1"), (401, "t2"), (408, "t1"), (409, "t2"))]
    tied = {lang: sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _, x in rows if x == lang) for lang in ("t1", "t2")}
    rows += [(i, "same words here", lang) for lang, n in tied.items() for i in [j for j in range(500 if lang == "t1" else 600, 700) if zlib.crc32(str(j).encode()) % 4 != 2][: 5 - n]]
    odd = ["½ ②", "Ⅷ ⅷ", "a½b x²y", None, "", "123 _ __", "same words", "WORDS Same", "zzzz qqqq", "漢字 かな", "İstanbul", "x" * 500, "bcd " * 4000, " ".join(r.choices(sum(words.values(), []), k=3000))]
    docs = spark.createDataFrame([*rows, *((1000 + i, t, None) for i, t in enumerate(odd))], "doc_id long, text string, lang string").repartition(3)
    got = {x.doc_id: x for x in language_id.identify(docs, language_id.fit(docs)).collect()}
    ids = [i for i, _, _ in rows] + [1000 + i for i in range(len(odd))]
    for i, (lang, score) in zip(ids, brute_language(rows, [t for _, t, _ in rows] + odd), strict=True):
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-4, (i, lang, score, got[i])
    assert [got[1000 + i].lang_pred for i in (0, 1, 3, 4, 5)] == ["und"] * 5 and got[1006].lang_pred == "t1"


def brute_quality(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    windows = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    hit = {k + j for ks in windows.values() if len(ks) > 1 for k in ks for j in range(3)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs, none):
    r = random.Random(4)
    good = [(2000 + i, prose(80, r)) for i in range(150)]
    bad = [(3000 + i, " ".join(f"{w.upper()}!!" for w in prose(80, r).split())) for i in range(60)]
    train = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:100]] + [(i, 0, 0) for i, _ in bad[:40]] + [(None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(train, labels)
    got = {x.doc_id: x for x in quality.score(train, model).collect()}
    assert all(got[i].kept for i, _ in good[100:]) and not any(got[i].kept for i, _ in bad[40:])
    assert all(0 <= x.probability <= 1 for x in got.values())
    want = []
    for i, t in ROWS:
        n, *rest = brute_quality(t)
        want.append((i, n, *rest, n < 50 or 100 * rest[3] > 50 * n))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert table(quality.score(docs, model), *cols) == sorted(want, key=str)
    assert quality.score(none, model).count() == 0
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).filter("not base_failed and not kept").count() == 0


# -- archives, conversations -------------------------------------------------


def test_quality_by_brute_force(spark, docs):
    """Probability and verdict of each document, scored one feature at a time from the model's weights; contradicting and repeated labels."""
    import math

    r = random.Random(14)
    good, bad = [(2000 + i, prose(60, r)) for i in range(60)], [(3000 + i, " ".join(f"{w}#" for w in prose(60, r).split())) for i in range(40)]
    train = spark.createDataFrame(good + bad + good[:3], "doc_id long, text string")
    rows = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    label = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    model = quality.fit(train, label(rows + rows[:20] + [(2005, 0, 0), (3005, 1, 0)]))
    again = quality.fit(train, label([x for x in rows if x[0] not in (2005, 3005)]))
    assert (model.weights == again.weights).all() and (model.bias, model.slope, model.offset) == (again.bias, again.slope, again.offset)
    few = quality.fit(train, label(rows), per_class=10)
    assert not (few.weights == model.weights).all()
    slot = lambda h, seed: ((h + seed) * 0x9E3779B97F4A7C15 % 2**64) >> 48

    def brute(text):
        raw = (text or "").encode()
        h = [zlib.crc32(w) | zlib.adler32(w) << 32 for w in raw.split()]
        words = [slot(x, 1) for x in h] + [slot((a * 31 + b) % 2**64, 2) for a, b in zip(h, h[1:], strict=False)]
        chars = [slot(int.from_bytes(raw[i : i + 3], "little"), 3) for i in range(len(raw) - 2)] + [slot(int.from_bytes(raw[i : i + 4], "little"), 4) for i in range(len(raw) - 3)]
        z = model.bias + sum(sum(float(model.weights[k][f]) for f in fam) / len(fam) for k, fam in enumerate((words, chars)) if fam)
        return 1 / (1 + math.exp(-max(-500, min(500, model.slope * z + model.offset))))

    texts = dict(good + bad) | {i: t for i, t in ROWS if i is not None and i != 20}
    for x in quality.score(train.union(docs.select("doc_id", "text")).filter("doc_id <> 20"), model).collect():
        p = brute(texts[x.doc_id])
        assert abs(x.probability - p) < 1e-4, x
        if abs(p - 0.5) > 1e-3:
            assert x.kept == (p >= 0.5 and not x.base_failed)


def test_warc_files_are_bounded(spark, monkeypatch):
    """Many repeats and some large payloads: no file holds more records than it should; all is read back."""
    import glob
    import gzip

    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "LARGE", 5_000)
    rows = [(i, f"u{i}", "same page" if i % 3 else f"{i} " * (400 if i % 50 else 4000)) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write(warc.resolve(warc.records(pages.coalesce(1))), path, warc.sizes(pages))
    held = sum(len(h) for _, _, h in rows)
    most = max(1, 20_000 * 600 // held)
    for f in glob.glob(path.removeprefix("file://") + "/*.gz"):
        blocks = [b for _, b in warc.parse(gzip.open(f))]
        assert len(blocks) <= most and (len(blocks) == 1 or max(map(len, blocks)) < 5_200)
    assert {(r.page_id, bytes(r.payload).decode()) for r in warc.restore(warc.read(spark, path)).collect()} == {(i, h) for i, _, h in rows}


def test_warc(spark):
    rows = [(1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (5, "u5", "<p>é</p>"), (3, "u3", None), (4, "u4", ""), (None, "n", "<p>é</p>"), (7, "u7", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (7, "u7", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (8, "u8", "x" * 300_000), (9, "u9", "<p>É</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "'x' as refers_to")
    for least in (0, 5):
        path = new_path(spark, "warc")
        warc.write(warc.resolve(warc.records(pages), least), path)
        got = warc.read(spark, path)
        want = []
        for i, _, h in rows:
            b = (h or "").encode()
            ids = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
            to = max(ids) if len(b) >= least and max(ids) != i else None
            want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if to is not None else "response", to))
        assert table(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)
        back = {(r.page_id, bytes(r.payload)) for r in warc.restore(got).collect()}
        assert back == {(i, (h or "").encode()) for i, _, h in rows}
    path = new_path(spark, "warc")
    warc.write(warc.resolve(warc.records(pages.limit(0))), path)
    assert warc.read(spark, path).count() == 0


def test_quotation(spark):
    rows = [
        (1, 0, "u", "Hello there, what is the plan?\nSecond line."), (1, 1, "a", "> Hello there,   what is THE plan?\nWe leave at nine."), (1, 2, "u", "> > hello there, what is the plan?\n> We leave at nine.\nFine, thanks."), (1, 3, "a", None), (1, 4, "u", "> never said\n>\nok > not a quote"),
        (2, 0, "u", "> We leave at nine.\nFrom elsewhere."), (2, 1, "a", "> From elsewhere.\n> "), (None, 0, "u", "> Fine, thanks."), (3, None, "u", "x"), (2, 1, "a", "> From elsewhere.\n> "),
    ]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as mid", "2 as level")
    got = {(r.conv_id, r.turn): r for r in quotation.conversations(m).collect()}
    see = lambda c, t: (got[c, t].n_quotes, got[c, t].n_linked, got[c, t].max_level, got[c, t].reply_conv, got[c, t].reply_turn, got[c, t].body)
    assert see(1, 0) == (0, 0, 0, None, None, rows[0][3])
    assert see(1, 1) == (1, 1, 1, 1, 0, "We leave at nine.")
    assert see(1, 2) == (2, 2, 2, 1, 1, "Fine, thanks.")
    assert see(1, 3) == (0, 0, 0, None, None, "") and see(1, 4)[:5] == (1, 0, 1, None, None) and see(1, 4)[5] == "ok > not a quote"
    assert see(2, 0)[3:5] == (1, 1) and see(2, 1)[3:5] == (2, 0) and see(None, 0)[:2] == (1, 0)
    assert [got[1, t].position for t in range(5)] == [1, 2, 3, 4, 5] and got[None, 0].position is None
    assert sorted(r.position for r in quotation.conversations(m).filter("conv_id = 2").collect()) == [1, 2, 2]
    same_as_sql(rows, quotation.digests(m))
    assert quotation.conversations(m.limit(0)).count() == 0
    plan = quotation.conversations(m)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def same_as_sql(rows, ours):
    import duckdb
    import pandas as pd

    c = duckdb.connect()
    c.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    flat = lambda d: sorted((tuple(None if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in d[sorted(d.columns)].itertuples(index=False)), key=str)
    assert flat(ours.toPandas()) == flat(c.sql(quotation.SQL).df())


def preorder(parents):
    """Turns in reply order, by brute force."""
    out, stack = [], sorted((t for t in parents if parents[t] is None), reverse=True)
    while stack:
        t = stack.pop()
        out.append(t)
        stack += sorted((c for c in parents if parents[c] == t), reverse=True)
    return out


def test_quotation_order_by_reply(spark):
    """A reply comes right after what it answers, before later turns; long chains, many replies, siblings of several parts."""
    say = lambda t: f"This is what turn {t} says."
    r = random.Random(13)
    parents = {1: {0: None, 1: None, 2: 0, 3: 1, 4: 0, 5: 2, 6: None, 7: 2}}
    parents[2] = {t: (t - 1 if t else None) for t in range(90)}  # one chain
    parents[3] = {t * 700: (0 if t else None) for t in range(40)}  # one turn that all others answer
    parents[4] = {t: (None if r.random() < 0.3 or not t else r.randrange(t)) for t in range(120)}
    parents[5] = {7: None}
    rows = [(c, t, "u", (f"> {say(p)}\n" if p is not None else "") + say(t) + f" In {c}.\n{say(t)}") for c, ts in parents.items() for t, p in ts.items()]
    rows += [(1, 3, "b", "an other message of this turn"), (None, 3, "u", "x"), (None, 3, "u", "x"), (6, None, "u", "y")]
    r.shuffle(rows)
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as position", "2 as parent", "3 as step")
    got = {(x.conv_id, x.turn): x.position for x in quotation.conversations(m).collect()}
    for c, ts in parents.items():
        assert sorted(ts, key=lambda t: got[c, t]) == preorder(ts), c
        assert sorted(got[c, t] for t in ts) == list(range(1, len(ts) + 1))
    assert preorder(parents[1]) == [0, 2, 5, 7, 4, 1, 3, 6] and got[None, 3] is None
    same_as_sql(rows, quotation.digests(m))


def test_quotation_of_a_very_long_text(spark):
    rows = [(1, 0, "u", "word " * 60_000 + "\n" + "line\n" * 3000), (1, 1, "a", "> " + "word " * 60_000 + "\nyes"), (1, 2, "u", ">" * 500 + " line\nno")]
    got = {x.turn: x for x in quotation.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].reply_turn, got[1].body, got[2].max_level, got[2].reply_turn) == (0, "yes", 500, 0)
    assert [got[t].position for t in range(3)] == [1, 2, 3]


def exact_spans(texts):
    """Words in repeats, and those that an earlier document has too, by brute force."""
    where, words = {}, {i: t.encode().lower().split() for i, t in texts.items()}
    for i, w in words.items():
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add(i)
    out = {}
    for i, w in words.items():
        hit, later = set(), set()
        for k in range(len(w) - 49):
            have = where[tuple(w[k : k + 50])]
            hit.update(range(k, k + 50) if len(have) > 1 else ())
            later.update(range(k, k + 50) if min(have) < i else ())
        out[i] = (hit, later)
    return out


def check_spans(spark, ranges, texts):
    """Exact spans, with the sorted rows in so many ranges: of the many, most hold a part of one run."""
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(3)
    want = exact_spans(texts)
    flat = lambda spans: {w for s in spans for w in range(s.begin, s.stop)}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r for r in suffix_dedup.mark(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, r in got.items():
        assert (flat(r.spans), flat(r.removable)) == want[i], i
        assert (r.n_repeated, r.n_removable) == tuple(map(len, want[i]))
    return got


@pytest.mark.parametrize("ranges", [4, 61])
def test_suffix_dedup_passage_of_many_documents(spark, ranges):
    """Each document but the first loses the passage, whatever stands around it."""
    r = random.Random(7)
    passage = prose(57, r)
    got = check_spans(spark, ranges, {i: f"{prose(r.randint(60, 90), r)} {passage} {prose(r.randint(60, 90), r)}" for i in range(120)})
    assert got[0].n_removable == 0 and all(got[i].n_removable >= 57 for i in range(1, 120))


@pytest.mark.parametrize("ranges", [4, 61])
def test_suffix_dedup_one_word_many_times(spark, ranges):
    """Thousands of equal windows in each of two documents."""
    r = random.Random(8)
    got = check_spans(spark, ranges, {i: f"{prose(60, r)} {'word ' * (3000 + 500 * i)} {prose(60, r)}" for i in range(2)})
    assert got[0].n_repeated >= 3000 and got[1].n_removable >= 3500


@pytest.mark.parametrize("ranges", [4, 61])
def test_suffix_dedup_beside_a_frequent_phrase(spark, ranges):
    """Pairs share a few words of their own before a phrase that many documents hold."""
    r = random.Random(9)
    phrase, own = prose(35, r), [prose(25, r) for _ in range(40)]
    texts = {i: f"{prose(40, r)} {phrase} {prose(40, r)}" for i in range(600)}
    got = check_spans(spark, ranges, texts | {1000 + i: f"{prose(40, r)} {own[i % 40]} {phrase} {prose(40, r)}" for i in range(80)})
    assert all((got[1000 + i].n_repeated >= 60) and (got[1000 + i].n_removable >= 60) == (i >= 40) for i in range(80))


@pytest.mark.parametrize("wait", [2, 7, 1_000_000])
def test_suffix_runs_over_ranges_and_batches(monkeypatch, wait):
    """Runs of equal windows cut anywhere, by ranges and by batches, and longer than what may wait."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "WAIT", wait)
    r = random.Random(wait)
    for _ in range(60):
        rows = sorted({(r.choice([-5, 0, 3, r.randrange(50)]), r.randrange(r.choice([1, 2, 9])), k) for k in range(r.randrange(1, 80))})
        batch = lambda part: pa.RecordBatch.from_arrays([pa.array([x[j] for x in part], pa.int64()) for j in range(3)], ["window", "doc_id", "begin"])
        cuts = lambda n: sorted({0, n, *(r.randrange(n + 1) for _ in range(r.randrange(5)))})
        found, at = [], cuts(len(rows))
        for a, b in zip(at, at[1:], strict=False):
            part = rows[a:b]
            inner = cuts(len(part))
            found += suffix_dedup._compared([batch(part[c:d]) for c, d in zip(inner, inner[1:], strict=False)] + [batch([])])
        open_ = [(w, d) for b in found for w, d, s in zip(b["window"].to_pylist(), b["doc_id"].to_pylist(), b["state"].to_pylist(), strict=True) if s == suffix_dedup.OPEN]
        ends = sorted((w, min(d for x, d in open_ if x == w)) for w in {w for w, _ in open_} if len({d for x, d in open_ if x == w}) > 1)
        got = suffix_dedup._settled(found, np.array([w for w, _ in ends], np.int64), np.array([d for _, d in ends], np.int64))
        have = sorted((x["doc_id"], x["begin"], x["later"]) for b in got for x in b.to_pylist())
        docs_of = {w: {d for x, d, _ in rows if x == w} for w, _, _ in rows}
        assert have == sorted((d, g, d > min(docs_of[w])) for w, d, g in rows if len(docs_of[w]) > 1)


def test_suffix_neighbours_over_batches():
    """Rows that share their suffix with a neighbour stay, wherever batches are cut; the range's edges stay too."""
    import pyarrow as pa

    r = random.Random(15)
    for _ in range(60):
        rows = sorted((r.randrange(12), k) for k in range(r.randrange(1, 30)))
        cuts = sorted({0, len(rows), *(r.randrange(len(rows) + 1) for _ in range(4))})
        batches = [pa.RecordBatch.from_arrays([pa.array([x[1] for x in rows[a:b]], pa.int64()), pa.array([x[0] for x in rows[a:b]], pa.int64())], ["doc_id", "suffix"]) for a, b in zip(cuts, cuts[1:], strict=False)]
        got = [(x["suffix"], x["doc_id"]) for b in suffix_dedup._neighbours(batches) for x in b.to_pylist()]
        many = {s for s, _ in rows if sum(x == s for x, _ in rows) > 1}
        assert got == [x for i, x in enumerate(rows) if x[0] in many or i in (0, len(rows) - 1)]


def test_language_of_few_labels(spark):
    """A language with a few labelled documents does not take the texts of the others."""
    r = random.Random(6)
    words = {lang: ["".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(n)] for lang, letters, n in (("aa", "abcdeghi", 300), ("bb", "efghijkl", 300), ("cc", "ijklmnop", 300))}
    rows = [(i, " ".join(r.choices(words[lang], k=60)), lang) for i in range(400) for lang in [r.choice(["bb", "cc"])]]
    rows += [(1000 + i, " ".join(r.choices(words["aa"][:20], k=15)), "aa") for i in range(8)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    held = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert "aa" in model.langs and all(model.predict(t)[0] == lang for t, lang in held)


def test_language_of_foreign_text(spark):
    """Foreign and random texts are not accepted, held-out ones in a learned language are."""
    r = random.Random(10)
    stems = {"xx": ["water", "house", "street", "people"], "yy": ["agua", "casa", "calle", "gente"]}
    ends = [a + b for a in ("", "ne", "ta") for b in ("s", "r", "lo")]
    rows = [(i, " ".join(r.choice(stems[lang]) + r.choice(ends) for _ in range(20)), lang) for i in range(200) for lang in [r.choice(["xx", "yy"])]]
    odd = [(2000, "talvella järvi jäätyy ja lumi peittää metsän", None), (2001, " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(300)), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    assert {x.doc_id for x in language_id.accepted(docs, language_id.fit(docs)).collect()} == {i for i, _, _ in rows}


def test_language_keeps_words_of_a_small_one(spark):
    """The bound on words and n-grams holds for each language and length, also for words seen once."""
    r = random.Random(11)
    rows = [(i, " ".join(f"{a}{b}" for a, b in (r.choices("abcdefghijklm", k=2) for _ in range(40))), "big") for i in range(300)]
    docs = spark.createDataFrame([*rows, (2001, "uno dos tres", "small")], "doc_id long, text string, lang string")
    assert zlib.crc32(b"2001") % 4 != 2
    model = language_id.fit(docs, max_grams=60)
    assert {"uno", "dos", "tres"} <= set(model.index[0])
    assert all(len(model.index[n]) <= 2 * 60 + 20 for n in range(language_id.LONGEST + 1))
