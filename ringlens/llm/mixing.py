"""Mixing sources to target weights with soft domain membership.

A classifier trained on the labelled table predicts, for every document, the posterior of
each domain. A document then contributes ``rate * tokens * posterior`` to every domain. The
nonnegative rates that bring the domains' expected token totals to their targets are found by
projected-gradient least squares, starting from 1 for every document, with momentum. Distances
are taken in the metric of the inverse Gram matrix of the posteriors, so that a rare domain moves as
fast as a common one, and the steps go on until the targets are met, the projected gradient is
zero, or ten steps bring the totals no nearer to targets that no rates can meet; a fit that does
none of these warns with the totals it reached.

The gradient of a document needs only its own posteriors and the domains' residuals, a
handful of numbers. So each step is one distributed sum over a narrow table, and a
document's rate is recomputed from the list of residuals so far: nothing per document
reaches the driver and no lineage grows.

The classifier is fitted on at most about ``train_rows`` labelled rows, chosen by a hash of
the id; everything else covers every document.

Defined cases: a null or empty text has no tokens and the prior as posterior; labels that are
null are not used, of several labels of a document the smallest (quality) and largest
(toxic) hold; a domain without training rows has posterior 0 and its target is left out;
without labels, or without tokens, every rate is 1; repeated rows get equal rates; an empty table
gives an empty result.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlens.llm.common import Scratch, drawn, prepare

#: Domains in the order of the posterior: the condition on the labelled table and the target share of tokens.
DOMAINS = {"good": "quality = 1 AND toxic = 0", "low": "quality = 0 AND toxic = 0", "toxic": "toxic = 1"}
TARGETS = {"good": 0.85, "low": 0.1, "toxic": 0.05}
TRAIN_ROWS, WORD_SLOTS = 6_000, 512
#: A fit that is not done after STEPS warns; TOLERANCE and STILL are relative to each domain's own target and total.
STEPS, TOLERANCE, STILL = 300, 1e-4, 1e-6
#: A fit has settled, too, when PROGRESS_STEPS steps bring the squared distance to the targets down by less than PROGRESS of it.
PROGRESS_STEPS, PROGRESS = 10, 0.02


def features(text: str | None) -> np.ndarray:
    """Byte shares, hashed word shares and a few measures of form (float32)."""
    raw = (text or "").encode()
    words = raw.split()
    out = np.zeros(256 + WORD_SLOTS + 6, np.float32)
    if not words:
        return out
    out[:256] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[:256] = np.sqrt(out[:256] / len(raw))
    kinds = set(words)
    slots = np.bincount(np.array([zlib.crc32(w.lower()) for w in kinds], np.int64) % WORD_SLOTS, minlength=WORD_SLOTS)
    out[256:256 + WORD_SLOTS] = np.sqrt(slots / len(kinds))
    lines = raw.split(b"\n")
    out[256 + WORD_SLOTS:] = (len(kinds) / len(words), np.log1p(len(words)) / 10, len(raw) / len(words) / 20, len(set(lines)) / len(lines),
                              sum(map(bytes.isupper, kinds)) / len(kinds), sum(map(bytes.isalpha, kinds)) / len(kinds))
    return out


class Softmax:
    """Multinomial logistic regression on standardised features, by full-batch gradient steps with momentum."""

    def __init__(self, x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 150, ridge: float = 1e-3):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.shares = np.bincount(y, minlength=classes) / len(y)
        self.has = self.shares > 0
        a = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))]).astype(np.float32)
        target = np.eye(classes, dtype=np.float32)[y]
        w = v = np.zeros((a.shape[1], classes), np.float32)
        # a step below the inverse of the loss's curvature, estimated by power steps
        z = np.ones(a.shape[1], np.float32)
        for _ in range(12):
            z = a.T @ (a @ (z / np.linalg.norm(z)))
        step = 1 / (0.5 * np.linalg.norm(z) / len(a) + ridge)
        for i in range(rounds):
            ahead = w + (i / (i + 3)) * (w - v)
            v, w = w, ahead - step * (a.T @ (self._probs(a @ ahead) - target) / len(a) + ridge * ahead)
        self.w = w

    def _probs(self, scores: np.ndarray) -> np.ndarray:
        e = np.exp(scores - scores.max(axis=1, keepdims=True)) * self.has
        return e / e.sum(axis=1, keepdims=True)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return self._probs(np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))]) @ self.w)


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: dict[str, str] = DOMAINS, train_rows: int = TRAIN_ROWS,
                   key: str = "doc_id", text: str = "text") -> Softmax | None:
    prepare(docs.sparkSession)
    domain = F.coalesce(*[F.when(F.expr(rule), F.lit(i)) for i, rule in enumerate(domains.values())])
    known = (labels.select(F.col(key).alias("id"), F.col("quality"), F.col("toxic")).where("id is not null")
             .groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
             .select("id", domain.alias("domain")).where("domain is not null"))
    n = known.count()
    picked = known.where(drawn(F.xxhash64("id", F.lit("mixing")), train_rows, n))  # about train_rows rows at any size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(x, pa.binary()), batch.column(1)], ["x", "domain"])

    rows = (docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "id")
            .select("text", "domain").mapInArrow(run, "x binary, domain int").toArrow())
    if rows.num_rows == 0:
        return None
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(rows.num_rows, -1)
    return Softmax(x, rows["domain"].to_numpy(), len(domains))


def posteriors(docs: DataFrame, model: Softmax, domains: dict[str, str] = DOMAINS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, p, th): tokens are words, th is a hash of the text; ``p`` is the posterior in the order of ``domains``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            p = shared.value.posterior(np.array([features(t) for t in texts]).reshape(len(texts), -1)) if texts else np.zeros((0, len(domains)))
            tokens = np.array([len((t or "").encode().split()) for t in texts], np.int64)
            p[tokens == 0] = shared.value.shares  # nothing to go by: the prior
            yield pa.record_batch([batch.column(0), pa.array(tokens), pa.array(p.astype(np.float64).tolist(), pa.list_(pa.float64())), batch.column(2)],
                                  ["doc_id", "n_tokens", "p", "th"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("th")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, p array<double>, th long")


def _points(p: np.ndarray, residuals: list[np.ndarray], step: float, most: float | None, momentum: list[float] | None = None):
    """(rate, last rate, point of the last residual, point of the next residual): accelerated projected gradient from 1."""
    rate = last = at = ahead = np.ones(len(p))
    for i, g in enumerate(residuals):
        at, last, rate = ahead, rate, np.clip(ahead - step * (p @ g), 0, most)
        ahead = rate + (i / (i + 3) if momentum is None else momentum[i]) * (rate - last)
    return rate, last, at, ahead


def rates_of(p: np.ndarray, residuals: list[np.ndarray], step: float, most: float | None, momentum: list[float] | None = None) -> np.ndarray:
    """Rates after the steps whose domain residuals are given."""
    return _points(p, residuals, step, most, momentum)[0]


def _ahead_of(p: np.ndarray, residuals: list[np.ndarray], step: float, most: float | None, momentum: list[float] | None = None) -> np.ndarray:
    """The point at which the next residual is taken."""
    return _points(p, residuals, step, most, momentum)[3]


def _summed(table: DataFrame, per_batch, size: int) -> np.ndarray:
    """Sum of a vector that ``per_batch(n_tokens, p)`` makes of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += per_batch(batch.column(0).to_numpy().astype(np.float64), np.array(batch.column(1).to_pylist()))
        yield pa.record_batch([pa.array(range(size), pa.int32()), pa.array(total)], ["i", "x"])

    rows = table.select("n_tokens", "p").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["x"]
    return out


def solve(table: DataFrame, weights: np.ndarray, keep: int | None = 0, most: float | None = None, steps: int = STEPS,
          tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], list[float], np.ndarray, np.ndarray, bool]:
    """(residuals, momentum, targets, totals, converged) for ``weights`` over the domains.

    The token budget keeps domain ``keep`` whole (its total stays what it is), or with None keeps the
    corpus' total. The residuals are scaled by the inverse Gram matrix, so their step is 1.
    """
    d = len(weights)
    moments = _summed(table, lambda n, p: np.concatenate([[n.sum()], n @ p, ((p * n[:, None]).T @ p).ravel()]), 1 + d + d * d)
    total, have, gram = moments[0], moments[1:1 + d], moments[1 + d:].reshape(d, d)
    if total == 0:
        return [], [], np.zeros(d), have, True
    weights = np.where(have > 0, weights, 0)
    weights = weights / weights.sum() if weights.sum() > 0 else have / total
    budget = have[keep] / weights[keep] if keep is not None and weights[keep] > 0 else total
    targets = weights * budget
    # unit diagonal first: a rare domain must not look like a singular direction
    unit = 1 / np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1))
    inverse = np.linalg.pinv(gram * unit[:, None] * unit[None, :], rcond=1e-10, hermitian=True) * unit[:, None] * unit[None, :]
    residuals: list[np.ndarray] = []
    momentum: list[float] = []
    apart: list[float] = []  # squared distance to the targets, step by step
    run = 0
    while True:
        now, moved = list(residuals), list(momentum)
        run += 1

        def sums(n: np.ndarray, p: np.ndarray) -> np.ndarray:
            # the momentum of the step at hand is the one that holds without a restart
            rate, last, at, ahead = _points(p, now, 1.0, most, moved)
            return np.concatenate([(n * rate) @ p, (n * ahead) @ p, (n * np.abs(rate - at)) @ p, [n @ ((at - rate) * (rate - last))]])

        found = _summed(table, sums, 3 * d + 1)
        totals, ahead, gradient, turn = found[:d], found[d:2 * d], found[2 * d:3 * d], found[3 * d]
        met = (np.abs(totals - targets) <= tolerance * targets).all()
        if met or residuals and (gradient <= STILL * np.maximum(totals, np.minimum(have, targets))).all():
            return residuals, momentum, targets, totals, True  # at the targets, or as near as nonnegative rates come
        apart.append(float((totals - targets) @ inverse @ (totals - targets)))
        if len(apart) > PROGRESS_STEPS and min(apart[-PROGRESS_STEPS:]) > (1 - PROGRESS) * min(apart[:-PROGRESS_STEPS]):
            return residuals, momentum, targets, totals, True  # targets that no rates meet: no nearer any more
        if len(residuals) == steps:
            return residuals, momentum, targets, totals, False
        if turn > 0:  # the momentum leads uphill: start it anew
            momentum[-1], run, ahead = 0.0, 1, totals
        residuals.append(inverse @ (ahead - targets))
        momentum.append((run - 1) / (run + 2))


def mix_documents(docs: DataFrame, *args, **kw) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate, copies) for every row; arguments as in ``rated_rows``."""
    return rated_rows(docs, *args, **kw).drop("th")


def rated_rows(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domains: dict[str, str] = DOMAINS,
                  keep: str | None = "good", most: float | None = None, train_rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``mix_documents`` with th, a hash of the row's text.

    Rates depend on the text alone. ``copies`` realises the rate: its whole part, and one more where the id's own draw is below the rest.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    names = list(domains)
    model = fit_classifier(docs, labels, domains, train_rows, key, text)
    if model is None:
        plain = docs.select(F.col(key).alias("doc_id"), F.size(F.filter(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long").alias("n_tokens"),
                            F.xxhash64(F.col(text).cast("string")).alias("th"))
        return plain.select("doc_id", "n_tokens", "th", *[F.lit(0.0).alias(f"p_{n}") for n in names], F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    table = scratch.table(posteriors(docs, model, domains, key, text))
    weights = np.array([targets[n] for n in names], float)
    residuals, momentum, wanted, totals, converged = solve(table, weights, names.index(keep) if keep else None, most)
    if not converged:
        warnings.warn(f"mixing rates did not settle in {STEPS} steps: token totals {totals.tolist()}, targets {wanted.tolist()}")
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array(batch.column(2).to_pylist()).reshape(batch.num_rows, len(names))
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), *[pa.array(p[:, i]) for i in range(len(names))],
                                   pa.array(rates_of(p, residuals, 1.0, most, momentum))], ["doc_id", "n_tokens", "th", *[f"p_{n}" for n in names], "rate"])

    rated = table.mapInArrow(run, f"doc_id {kind}, n_tokens long, th long, " + ", ".join(f"p_{n} double" for n in names) + ", rate double")
    return rated.withColumn("copies", copies(F.col("doc_id"), F.col("rate")))


def copies(key: Column, rate: Column) -> Column:
    draw = F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def apply_mix(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` with their columns, each as many times as its copies say."""
    mixed = rated_rows(docs, labels, key=key, text=text, **kw)
    # rows of one id and text have one rate; texts that share an id keep their own
    picked = mixed.groupBy("doc_id", "th").agg(F.min("copies").alias("copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("hash"))
    met = rows.join(picked, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("th"))).where("copies > 0")
    return met.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
