"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language.
An unseen word falls back to its character n-grams, the longest first: at the
first length with known n-grams their log frequencies are averaged. A text's
score for a language is the sum over its words.

The model is fitted on a bounded sample, at most ``docs_per_lang`` labelled
documents of each language chosen by a hash of doc_id, and keeps of each
language at most ``max_grams`` words and as many n-grams of each length, the
most frequent ones; so what is sent to the executors is bounded by the number
of languages.
Every text is scored whole.

Words are runs of letters (Unicode category L) in lower case.

Defined results: a text that is null, empty or without a letter is ``und``
with score 0, and so is every text where nothing is labelled; null languages
and null texts are not learned from; ties between languages go to the first
in alphabetical order; a null doc_id is never learned from and its ``held_out``
is false; repeated rows give repeated rows; where nothing is labelled no
document is rejected; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import materialise, small_batches

#: Fitting: labelled documents of a language, and its words, and its n-grams of each length, that are kept.
DOCS_PER_LANG, MAX_GRAMS = 4000, 50_000
#: Longest n-grams that an unseen word falls back to.
LONGEST = 5
#: Smallest share of the score with which a document is accepted.
ACCEPT = 0.4
#: Smallest part of a text that is familiar in any language: a known word counts 1, another one its share of
#: known n-grams of length FAMILIAR_N. Held-out texts of the test data have 0.87 or more.
FAMILIAR, FAMILIAR_N = 0.6, 4
#: Words and unseen words that a Python worker remembers with their scores; words that are scored at once.
CACHE, STEP = 200_000, 1 << 17
_RUN = re.compile(r"[^\W\d_]+")  # letters, and number signs that are neither letters nor digits
UNKNOWN = "und"


def _letters(run: str) -> list[str]:
    """The words of a run: all of it, but for number signs."""
    return [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return [w for run in _RUN.findall(text.lower()) for w in _letters(run)] if text else []


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between boundary marks."""
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    """Log frequencies by language. langs in order; by length, n-gram (0: word) to its row of ``logs``."""

    def __init__(self, langs: list[str], index: list[dict[str, int]], logs: np.ndarray):
        self.langs, self.index, self.logs = langs, index, logs
        self._forget()

    @staticmethod
    def of(counts: list[tuple[str, int, str, int]]) -> Model:
        """From rows (lang, n, gram, count)."""
        langs = sorted({r[0] for r in counts})
        at = {lang: i for i, lang in enumerate(langs)}
        index: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        rows = 0
        for _, n, gram, _ in counts:
            if gram not in index[n]:
                index[n][gram] = rows
                rows += 1
        seen = np.zeros((rows, len(at)))
        for lang, n, gram, c in counts:
            seen[index[n][gram], at[lang]] += c
        for table in index:
            mine = np.fromiter(table.values(), np.int64, len(table))
            # one vocabulary for all languages: what is unseen is not likelier where little is labelled
            seen[mine] = np.log((seen[mine] + 0.5) / (seen[mine].sum(0) + 0.5 * len(mine)))
        return Model(langs, index, seen.astype(np.float32))

    def _forget(self) -> None:
        """Empty the memory of runs: what each adds to a text's scores, its familiar words and its words."""
        self.place: dict[str, int] = {}
        self.rows = np.zeros((CACHE + STEP, len(self.langs) + 2))

    def score(self, runs: list[str]) -> np.ndarray:
        """Of each run of letters the scores by language, how much is familiar, and the number of its words."""
        out = np.zeros((len(runs), len(self.langs) + 2))
        known, familiar = self.index[0].get, self.index[FAMILIAR_N]
        flat, sizes, owner = [], [], []  # rows of ``logs`` whose mean counts for a run
        for i, run in enumerate(runs):
            for w in _letters(run):
                out[i, -1] += 1
                row = known(w)
                if row is not None:
                    out[i, -2] += 1
                    found = [row]
                else:
                    grams = grams_of(w, FAMILIAR_N)
                    out[i, -2] += sum(map(familiar.__contains__, grams)) / max(1, len(grams))
                    for n in range(LONGEST, 0, -1):
                        found = [r for r in map(self.index[n].get, grams_of(w, n)) if r is not None]
                        if found:
                            break
                if found:
                    flat += found
                    sizes.append(len(found))
                    owner.append(i)
        if flat:
            stops = np.cumsum(sizes)
            means = np.add.reduceat(self.logs[flat].astype(float), stops - sizes, axis=0) / np.array(sizes)[:, None]
            np.add.at(out[:, :-2], owner, means)
        return out

    def _sums(self, runs: list[str], ends: list[int]) -> np.ndarray:
        """Sums over the runs of each text; the runs of the k-th end at ``ends[k]``."""
        out, starts = np.zeros((len(ends), len(self.langs) + 2)), np.array([0, *ends[:-1]])
        for a in range(0, len(runs), STEP):
            part = runs[a : a + STEP]
            new = set(part).difference(self.place)
            if len(self.place) + len(new) > CACHE:
                self._forget()
                new = set(part)
            new = list(new)
            first = len(self.place)
            self.place.update(zip(new, range(first, first + len(new)), strict=True))
            if new:
                self.rows[first : first + len(new)] = self.score(new)
            at = np.fromiter(map(self.place.__getitem__, part), np.int64, len(part))
            use = np.flatnonzero((starts < a + len(part)) & (np.array(ends) > np.maximum(a, starts)))
            out[use] += np.add.reduceat(self.rows[at], np.maximum(starts[use], a) - a, axis=0)
        return out

    def predict_all(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language of each text and its share of the score, which is flattened by the square root of the words'
        number. The share is scaled to below :data:`ACCEPT` where less than :data:`FAMILIAR` of the text is familiar."""
        runs, ends = [], []
        for t in texts:
            runs += _RUN.findall(t.lower()) if t else []
            ends.append(len(runs))
        if not self.langs or not runs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums = self._sums(runs, ends)
        total, words = sums[:, :-2], np.maximum(sums[:, -1], 1)
        p = np.exp((total - total.max(1, keepdims=True)) / np.sqrt(words)[:, None])
        best, familiar = total.argmax(1), sums[:, -2] / words
        share = p[np.arange(len(p)), best] / p.sum(1)
        share = np.where(familiar >= FAMILIAR, share, share * ACCEPT * familiar / FAMILIAR)
        some = sums[:, -1] > 0
        return [self.langs[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, share, 0.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """:meth:`predict_all` of one text."""
        lang, share = self.predict_all([text])
        return lang[0], float(share[0])


def held_out():
    """The fold that is never learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, max_grams: int = MAX_GRAMS) -> Model:
    """Count words and n-grams over the sample; the most frequent ones of each language and length come to the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.select("doc_id", "lang", "text").filter("doc_id is not null and lang is not null and text is not null").filter(~held_out())
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return Model.of([])
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, docs_per_lang / n))]), F.col("lang"))
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches):
        for b in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):  # bounds the tables
            by_lang: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_lang[lang].update(words_of(text))
            rows = []
            for lang, seen in by_lang.items():
                tables = [seen, *(Counter() for _ in range(LONGEST))]
                for w, c in seen.items():
                    for n in range(1, LONGEST + 1):
                        for g in grams_of(w, n):
                            tables[n][g] += c
                rows += [(lang, n, g, c) for n, t in enumerate(tables) for g, c in t.items()]
            cols = zip(*rows, strict=True) if rows else [[], [], [], []]
            types = (pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["lang", "n", "gram", "c"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, n int, gram string, c long")
    total = materialise(counts.groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")), "grams")
    # for each language and length the least count that is kept, and the share of the grams with just that count
    held, least = Counter(), {}
    for lang, n, c, many in sorted((tuple(r) for r in total.groupBy("lang", "n", "c").count().collect()), key=lambda r: -r[2]):
        if held[lang, n] < max_grams:
            least[lang, n] = (lang, n, c, min(1.0, (max_grams - held[lang, n]) / many))
            held[lang, n] += many
    if not least:
        return Model.of([])
    bounds = spark.createDataFrame(list(least.values()), "lang string, n int, least long, share double")
    some = (F.col("c") == F.col("least")) & (F.pmod(F.xxhash64("gram"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    top = total.join(F.broadcast(bounds), ["lang", "n"]).filter((F.col("c") > F.col("least")) | some).select("lang", "n", "gram", "c").toArrow()
    top = top.sort_by([("lang", "ascending"), ("n", "ascending"), ("gram", "ascending")])
    return Model.of(list(zip(*(top[c].to_pylist() for c in ("lang", "n", "gram", "c")), strict=True)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score; columns of these names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    rest = docs.drop("lang_pred", "score")
    sent = spark.sparkContext.broadcast((model.langs, model.index, model.logs))
    at = rest.columns.index("text")

    def run(batches):
        m = Model(*sent.value)
        for b in batches:
            langs, shares = m.predict_all(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(shares, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is found with a score of at least :data:`ACCEPT`, unchanged, whatever the names
    of their columns; all of them where no language was learned."""
    if not model.langs:
        return docs
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names).withColumnRenamed(names[docs.columns.index("text")], "text")
    found = identify(inner, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= ACCEPT))
    return found.select(inner.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: learn outside the held-out fold, predict every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
