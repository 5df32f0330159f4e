"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Two models, toxic and ordinary, share one thing: the lower-order counts. An
n-gram's probability in a class is its discounted count there plus a share of the
next shorter n-gram's Kneser-Ney probability, whose continuation counts are taken
over both classes together. A rare expression therefore gets nearly the same
probability from both models, and only what one class says markedly more often
moves the ratio.

Per document the two log-likelihoods are compared: per character over the whole text
(length-normalised), and for its strongest words, so that a few toxic words in a very
long text still count. A logistic curve turns these into a score; it is fitted on the
labelled rows, each seen by a model that did not count its words (cross-fitting in
three parts).

Counts are Spark aggregates and grow with the input: the class counts are taken over all
labelled rows outside the held-out fold, the shared continuation counts over the n-grams of
all documents, labelled or not. Spark joins them into one table of log ratios. Up to
``MODEL_GRAMS`` n-grams that table is broadcast to the scoring tasks; beyond, distinct words
are joined with it and their ratios with the documents. Only the three weights of the curve
come from a bounded draw (``curve_rows``, half of them of each class, weighted back to the
classes' true shares). Scoring reads every whole text.

Defined cases: a null text is empty; a text without words has the features 0; labels
that are null are not used, of several labels of a document the largest holds; without
training rows of both classes every score is 0; repeated rows are scored alike; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringlens.llm.common import Scratch, drawn, prepare

ORDER, DISCOUNT, CURVE_ROWS, TOP_WORDS = 5, 0.75, 20_000, 3
FOLDS, CROSS_PARTS = 5, 3
#: Largest tables that are broadcast: n-grams of the model, labelled ids.
MODEL_GRAMS, BROADCAST_LABELS = 1_000_000, 1_000_000
#: A counting task hands on what it holds at so many distinct words or read characters.
HELD_WORDS, HELD_CHARS = 200_000, 1 << 25
CACHE_WORDS, CACHED_LEN = 300_000, 64
_WORD = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    return _WORD((text or "").lower())


def grams_of(word: str, order: int = ORDER) -> list[str]:
    padded = "^" * (order - 1) + word + "$"
    return [padded[i:i + order] for i in range(len(padded) - order + 1)]


class LogRatio:
    """log P(word | toxic) - log P(word | ordinary), from n-gram counts of both classes.

    ``corpus``: the n-grams that the shared counts are taken from, those of both classes if not
    given. The constructor is the model's plain statement for small counts; ``of`` takes the
    ratios that ``ratio_tables`` has made of large ones.
    """

    @classmethod
    def of(cls, gram: dict[str, float], context: dict[str, float], order: int = ORDER) -> LogRatio:
        model = cls.__new__(cls)
        model.order, model.gram, model.context, model.cache = order, gram, context, {}
        return model

    def __init__(self, counts: list[dict[str, int]], order: int = ORDER, discount: float = DISCOUNT, corpus: set[str] | None = None):
        self.order = order
        pooled = set(counts[0]) | set(counts[1])
        # shared continuation counts: n-grams of each lower order with their number of distinct left neighbours
        cont: list[Counter] = [Counter()] * order
        grams = pooled | (corpus or set())
        for m in range(order - 1, 0, -1):
            cont[m] = Counter(g[1:] for g in grams)
            grams = set(cont[m])
        total, kinds = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
        for m in range(1, order):
            for g, n in cont[m].items():
                total[m][g[:-1]] += n
                kinds[m][g[:-1]] += 1
        uniform = 1 / (len(cont[1]) + 1)
        memo: dict[str, float] = {"": uniform}

        def shared(g: str) -> float:
            if g not in memo:
                m, h = len(g), g[:-1]
                memo[g] = (max(cont[m][g] - discount, 0) + discount * kinds[m][h] * shared(g[1:])) / total[m][h]
            return memo[g]

        seen, follow = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)]
        for k in (0, 1):
            for g, n in counts[k].items():
                seen[k][g[:-1]] += n
                follow[k][g[:-1]] += 1

        def weight(k: int, h: str) -> float:
            """Share of the shared model after context h."""
            return discount * follow[k][h] / seen[k][h] if h in seen[k] else 1.0

        def prob(k: int, g: str) -> float:
            h = g[:-1]
            own = max(counts[k].get(g, 0) - discount, 0) / seen[k][h] if h in seen[k] else 0.0
            return own + weight(k, h) * shared(g[1:])

        self.gram = {g: math.log(prob(1, g) / prob(0, g)) for g in pooled}
        # an n-gram that neither class has: the shared model cancels out
        self.context = {h: math.log(weight(1, h) / weight(0, h)) for h in {g[:-1] for g in pooled}}
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def word(self, w: str) -> float:
        found = self.cache.get(w)
        if found is None:
            gram, context = self.gram, self.context
            found = 0.0
            for g in grams_of(w, self.order):
                x = gram.get(g)
                found += context.get(g[:-1], 0.0) if x is None else x
            if len(w) <= CACHED_LEN:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[w] = found
        return found

    def features(self, text: str | None) -> tuple[float, float, float]:
        """(log ratio per character, largest of a word, mean of the strongest words)."""
        words = words_of(text)
        if not words:
            return 0.0, 0.0, 0.0
        get, word = self.cache.get, self.word
        ratios = np.array([x if (x := get(w)) is not None else word(w) for w in words])
        top = np.sort(np.partition(ratios, len(ratios) - TOP_WORDS)[-TOP_WORDS:] if len(ratios) > TOP_WORDS else ratios)
        return float(ratios.sum() / (sum(map(len, words)) + len(words))), float(top[-1]), float(np.maximum(top, 0).sum() / TOP_WORDS)


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression by Newton steps; ``share``: how much each row counts."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(a.shape[1]), a.T @ (share * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == 0


class Fitted(NamedTuple):
    weights: np.ndarray
    #: one model for all rows; None where the tables are too large to broadcast
    model: Broadcast | None
    grams: DataFrame
    contexts: DataFrame
    scratch: Scratch


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, n-gram, occurrences) of texts with (toxic, part); class -1 and 0 for n-grams of unlabelled texts alone."""
    labelled: dict[int, Counter] = defaultdict(Counter)
    others: set[str] = set()
    chars = 0

    def batch(cls: int, grams: list[str], counts: list[int]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([cls] * len(grams), pa.int32()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], ["cls", "gram", "n"])

    def hand_on() -> Iterator[pa.RecordBatch]:
        every: set[str] = set()
        for cls, own in labelled.items():
            grams: Counter = Counter()
            for w, n in own.items():
                for g in grams_of(w):
                    grams[g] += n
            every.update(grams)
            yield batch(cls, list(grams), list(grams.values()))
        rest: set[str] = set()
        for w in others:
            rest.update(grams_of(w))
        rest -= every
        yield batch(-1, list(rest), [0] * len(rest))

    for b in batches:
        for t, toxic, part in zip(*(c.to_pylist() for c in b.columns)):
            words = words_of(t)
            if toxic is None:
                others.update(words)
            else:
                labelled[2 * part + toxic].update(words)
            chars += len(t or "")
            if chars > HELD_CHARS or len(others) + sum(map(len, labelled.values())) > HELD_WORDS:
                yield from hand_on()
                labelled.clear()
                others.clear()
                chars = 0
    yield from hand_on()


def shared_probabilities(grams: DataFrame, scratch: Scratch, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """(gram, shared): Kneser-Ney probability of every n-gram of ``order - 1`` inside the distinct ``grams``."""
    cont: dict[int, DataFrame] = {}
    longer = grams
    for m in range(order - 1, 0, -1):
        longer = cont[m] = scratch.table(longer.groupBy(F.substring("gram", 2, m).alias("gram")).agg(F.count("*").alias("n")))
    # the shortest n-grams are single characters
    below, uniform = None, 1 / (cont[1].count() + 1)
    for m in range(1, order):
        # at most one row for each character of the alphabet in a window
        after = Window.partitionBy(F.substring("gram", 1, m - 1))
        rows = cont[m].select("gram", "n", F.sum("n").over(after).alias("total"), F.count("*").over(after).alias("kinds"),
                              F.substring("gram", 2, m - 1).alias("tail"))
        rows = (rows.withColumn("lower", F.lit(uniform)) if below is None
                else rows.join(below.select(F.col("gram").alias("tail"), F.col("shared").alias("lower")), "tail"))
        below = scratch.table(rows.select("gram", ((F.greatest(F.col("n") - discount, F.lit(0.0)) + discount * F.col("kinds") * F.col("lower")) / F.col("total")).alias("shared")))
    return below


def ratio_tables(counted: DataFrame, scratch: Scratch, order: int = ORDER, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """(gram, r0..) and (context, x0..): log ratios of n-grams, and of contexts before an unseen n-gram.

    ``counted`` holds every n-gram of all documents with its counts c0, c1, ... (ordinary and toxic
    of each part). Model 0 counts all parts, model i all but part i - 1; null where a model has no such n-gram.
    """
    models = range(CROSS_PARTS + 1)
    count = {(i, k): sum((F.col(f"c{2 * p + k}") for p in range(CROSS_PARTS) if p != i - 1), F.lit(0)).alias(f"n{i}{k}") for i in models for k in (0, 1)}
    own = (counted.where(sum((F.col(f"c{j}") for j in range(2 * CROSS_PARTS)), F.lit(0)) > 0)
           .select("gram", F.substring("gram", 1, order - 1).alias("context"), F.substring("gram", 2, order - 1).alias("tail"), *count.values()))
    contexts = scratch.table(own.groupBy("context").agg(*[f for i, k in count for f in (
        F.sum(f"n{i}{k}").alias(f"seen{i}{k}"), F.count_if(F.col(f"n{i}{k}") > 0).alias(f"follow{i}{k}"))]))

    def weight(i: int, k: int) -> Column:
        seen = F.col(f"seen{i}{k}")
        return F.when(seen > 0, discount * F.col(f"follow{i}{k}") / seen).otherwise(1.0)

    def prob(i: int, k: int) -> Column:
        seen = F.col(f"seen{i}{k}")
        return F.when(seen > 0, F.greatest(F.col(f"n{i}{k}") - discount, F.lit(0.0)) / seen).otherwise(0.0) + weight(i, k) * F.col("shared")

    shared = shared_probabilities(counted.select("gram"), scratch, order, discount).withColumnRenamed("gram", "tail")
    grams = own.join(contexts, "context").join(shared, "tail").select(
        "gram", *[F.when(F.col(f"n{i}0") + F.col(f"n{i}1") > 0, F.log(prob(i, 1) / prob(i, 0))).alias(f"r{i}") for i in models])
    return scratch.table(grams), contexts.select("context", *[F.log(weight(i, 1) / weight(i, 0)).alias(f"x{i}") for i in models])


def joined_features(rows: DataFrame, grams: DataFrame, contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, a, b, c): ``LogRatio.features`` of ``rows`` (row, model, text) by joins; texts without words have no row."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, model, text in zip(*(c.to_pylist() for c in b.columns)):
                found = Counter(words_of(text))
                yield pa.record_batch([pa.array([row] * len(found), pa.int64()), pa.array([model] * len(found), pa.int32()),
                                       pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["row", "model", "word", "n"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, word in zip(*(c.to_pylist() for c in b.columns)):
                found = Counter(grams_of(word))
                yield pa.record_batch([pa.array([key] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["key", "gram", "n"])

    models = range(CROSS_PARTS + 1)
    tokens = scratch.table(rows.select("row", "model", "text").mapInArrow(words, "row long, model int, word string, n long"))
    parts = (tokens.select("word").distinct().select(F.md5("word").alias("key"), "word").mapInArrow(spelled, "key string, gram string, n long")
             .withColumn("context", F.substring("gram", 1, ORDER - 1)))
    ratios = (parts.join(grams, "gram", "left").join(contexts, "context", "left").groupBy("key")
              .agg(*[F.sum(F.coalesce(f"r{i}", f"x{i}", F.lit(0.0)) * F.col("n")).alias(f"s{i}") for i in models]))
    each = tokens.withColumn("key", F.md5("word")).join(ratios, "key").select(
        "row", "n", F.char_length("word").alias("chars"), F.get(F.array(*[f"s{i}" for i in models]), F.col("model")).alias("ratio"))
    # the words of one text, which was one row already
    per_row = each.groupBy("row").agg(
        (F.sum(F.col("ratio") * F.col("n")) / F.sum((F.col("chars") + 1) * F.col("n"))).alias("a"),
        F.slice(F.sort_array(F.flatten(F.collect_list(F.array_repeat("ratio", F.least("n", F.lit(TOP_WORDS)).cast("int")))), False), 1, TOP_WORDS).alias("top"))
    return per_row.select("row", "a", F.get("top", F.lit(0)).alias("b"),
                          (F.aggregate("top", F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0))) / TOP_WORDS).alias("c"))


def fit(docs: DataFrame, labels: DataFrame, curve_rows: int = CURVE_ROWS, key: str = "doc_id", text: str = "text",
        model_grams: int = MODEL_GRAMS) -> Fitted | None:
    """The fitted scores, or None without training rows of both classes."""
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "toxicity")
    known = scratch.table(labels.select(F.col(key).alias("id"), F.col("toxic").alias("toxic")).where("id is not null and toxic is not null")
                          .where(~held_out(F.col("id"))).groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
                          .withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(CROSS_PARTS)).cast("int")))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    counted = scratch.table(
        texts.join(F.broadcast(known) if sum(sizes.values()) <= BROADCAST_LABELS else known, "id", "left").select("text", "toxic", "part")
        .mapInArrow(_count_grams, "cls int, gram string, n long")
        .groupBy("gram").agg(*[F.coalesce(F.sum(F.when(F.col("cls") == j, F.col("n"))), F.lit(0)).alias(f"c{j}") for j in range(2 * CROSS_PARTS)]))
    totals = counted.agg(*[F.coalesce(F.sum(f"c{j}"), F.lit(0)) for j in range(2 * CROSS_PARTS)]).first()
    usable = [all(sum(totals[2 * p + k] for p in range(CROSS_PARTS) if p != i - 1) > 0 for k in (0, 1)) for i in range(CROSS_PARTS + 1)]
    if not usable[0]:
        return None
    grams, contexts = ratio_tables(counted, scratch)

    # the curve's rows: bounded, so broadcast
    share = {k: min(1.0, curve_rows / 2 / n) for k, n in sizes.items()}
    draw = F.xxhash64("id", F.lit("train"))
    picked = known.where(F.when(F.col("toxic") == 1, drawn(draw, curve_rows // 2, sizes[1])).otherwise(drawn(draw, curve_rows // 2, sizes[0])))
    rows = (texts.join(F.broadcast(picked), "id").select("text", "toxic", (F.col("part") + 1).alias("model"))
            .where(F.col("model").isin([i for i in range(1, CROSS_PARTS + 1) if usable[i]])))
    model = None
    if grams.count() <= model_grams:
        grams_at, contexts_at = ([c.to_pylist() for c in t.toArrow().columns] for t in (grams, contexts))
        models = [LogRatio.of({g: r for g, r in zip(grams_at[0], grams_at[1 + i]) if r is not None}, dict(zip(contexts_at[0], contexts_at[1 + i])))
                  for i in range(CROSS_PARTS + 1)]
        model, crossed = spark.sparkContext.broadcast(models[0]), spark.sparkContext.broadcast(models)

        def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen = [(*crossed.value[i].features(t), float(toxic)) for t, toxic, i in zip(*(c.to_pylist() for c in batch.columns))]
                yield pa.record_batch([pa.array(c, pa.float64()) for c in zip(*seen)] or [pa.array([], pa.float64())] * 4, ["a", "b", "c", "y"])

        curve = rows.mapInArrow(feature_rows, "a double, b double, c double, y double")
    else:
        keyed = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()))
        curve = (keyed.join(joined_features(keyed, grams, contexts, scratch), "row", "left").na.fill(0.0, ["a", "b", "c"])
                 .select("a", "b", "c", F.col("toxic").cast("double").alias("y")))
    # three features and the label of each of the curve's rows
    data = np.array([c.to_numpy() for c in curve.toArrow().columns]).T.reshape(-1, 4)
    if len(data) == 0 or data[:, 3].min() == data[:, 3].max():
        # too few labels for a curve: even odds at a ratio of e^6 for one word
        weights = np.array([0.0, 1.0, 0.0, -6.0])
    else:
        counts_for = np.where(data[:, 3] > 0, 1 / share[1], 1 / share[0])
        weights = _logistic(data[:, :3], data[:, 3], counts_for / counts_for.mean())
    return Fitted(weights, model, grams, contexts, scratch)


def with_score(docs: DataFrame, fitted: Fitted | None, text: str, name: str) -> DataFrame:
    """``docs`` and the score of the column ``text`` as column ``name``."""
    if fitted is None:
        return docs.withColumn(name, F.lit(0.0))
    weights, shared = fitted.weights, fitted.model
    if shared is not None:
        @F.pandas_udf(T.DoubleType())
        def score(texts: pd.Series) -> pd.Series:
            m = shared.value
            x = np.array([(*m.features(t), 1.0) for t in texts]).reshape(-1, 4)
            return pd.Series(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))

        return docs.withColumn(name, score(F.col(text).cast("string")))
    # written with a row key first, which a lost executor must not draw anew
    names = docs.columns
    keyed = fitted.scratch.table(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.monotonically_increasing_id().alias("row")))
    features = joined_features(keyed.select("row", F.lit(0).alias("model"), keyed["doc"][text].cast("string").alias("text")), fitted.grams, fitted.contexts, fitted.scratch)
    odds = sum((F.coalesce(c, F.lit(0.0)) * float(w) for c, w in zip("abc", weights)), F.lit(float(weights[3])))
    scored = 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))
    return keyed.join(features, "row", "left").select("doc.*", scored.alias(name))


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; ``kw`` as for ``fit``."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"))
    scored = with_score(rows, fit(docs, labels, key=key, text=text, **kw), "text", "score").drop("text")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns; ``kw`` as for ``fit``."""
    mark = "_toxicity"
    while mark in docs.columns:
        mark += "_"
    return with_score(docs, fit(docs, labels, **kw), kw.get("text", "text"), mark).where(F.col(mark) < threshold).drop(mark)
