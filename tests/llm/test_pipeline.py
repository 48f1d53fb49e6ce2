"""The stages one after the other, and each query against its SQL, on the smallest tables."""

import glob
import hashlib
import os

import pytest

pytest.importorskip("basalt.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from basalt.llm import decontaminate, language_id
from basalt.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    import duckdb
    import pandas

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), c.sql(ORACLE_SQL[name]).df()
    columns = sorted(theirs.columns)
    cell = lambda v: None if v is None or v is pandas.NA or v != v else float(v) if not isinstance(v, (str, bool)) and str(v) not in ("True", "False") else str(v)
    rows = lambda d: sorted((tuple(cell(v) for v in r) for r in d[columns].astype(object).itertuples(index=False, name=None)), key=str)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_covers_the_table(spark, name):
    """Each query that SQL cannot express gives a row for each document; its operator's tests hold the values to brute force."""
    rows = QUERIES[name](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())


ODD = [
    (1, "The house by the river is old and the garden is green.\nA line that is shared by two documents.", "en"),
    (2, "The house by the river is old and the garden is green.\nA line that is shared by two documents.", "en"),
    (2, "The house by the river is old and the garden is green.\nA line that is shared by two documents.", None),
    (3, "All the people of the village walk to the market in the morning.\nA line that is shared by two documents.", "en"),
    (4, None, "en"), (5, "", None), (6, "123 !!", "en"), (None, "The old people of the house walk to the river.", "en"), (None, None, None),
    (7, "the market " * 20_000, "en"), (9, "das haus am fluss ist alt und der garten ist gr\u00fcn", "de"), (10, "das haus am fluss ist alt und der garten ist gr\u00fcn", "de"),
    (11, "The people walk in the green garden of the old house and by the river in the morning to the market.", None),
]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeats, ties, a very long text, an empty table, and columns with the names that the operators use."""
    clash = "doc_id long, text string, lang string, kept string, n_lines int, n_dropped string, lang_pred string, score string, hit_words int, items string, c0 long, c1 string, row int, drop string"
    docs = spark.createDataFrame([(*x, "k", 1, "d", "lp", "s", 5, "i", 7, "c", 3, "dr") for x in ODD], clash)
    spark.createDataFrame([("b1", "people walk in the green garden of the old house and by the river")], "item_id string, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    want = {
        "language": [i for i, t, _ in ODD if t and any(c.isalpha() for c in t)],
        "lines": [1, 2, 2, 3, None, 7, 9, 10, 11], "near": [1, 2, 2, 3, None, 7, 9, 10, 11], "leaks": [1, 2, 2, 3, None, 7, 9, 10],
    }
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "lang")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), f"file://{tmp_path}")
        assert empty.columns == docs.columns and empty.count() == 0
        got = stage(spark, docs, f"file://{tmp_path}")
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        got.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        rows = docs.collect()
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, want[name])), name
        assert {tuple(r[c] for c in extra) for r in rows} == {("k", 1, "d", "lp", "s", 5, "i", 7, "c", 3, "dr")}
    texts = {r.doc_id: r.text for r in rows}
    assert texts[1] == ODD[0][1] and texts[2] == texts[10] == "" and texts[3] == ODD[3][1].split("\n")[0]
    out = corpus_pipeline.tokens(spark, docs, "").collect()
    assert {(r.doc_id, r.decoded_sha256) for r in out} == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts.items()}
    assert corpus_pipeline.tokens(spark, docs.limit(0), "").count() == 0


def test_stages(spark):
    """Each stage's own rule, by brute force, on what the stage before it kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    start, lang, lines, near, clean = seen
    model = language_id.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert set(lang) == {i for i, t in start.items() if model.predict(t)[1] >= language_id.ACCEPT}
    key = lambda x: x.encode().strip(b" \t\n\v\f\r").lower().decode()
    owner = {}
    for i in sorted(lang):
        for x in lang[i].split("\n"):
            owner.setdefault(key(x), i)
    assert lines == {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == i) for i, t in lang.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in lines.items() for w in [t.encode().lower().split()] if w}
    parent = {i: i for i in lines}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            if a < b and len(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert set(near) == {i for i in lines if find(i) == i}
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = decontaminate.words_of(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    lengths = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in lengths for k in range(len(w) - n + 1))
    assert set(clean) == {i for i, t in near.items() if not hit(decontaminate.words_of(t))}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {(r.doc_id, r.decoded_sha256) for r in out} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in clean.items()}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, DATA).collect()} == {r.doc_id: r.n_tokens for r in out}
