"""Embedding near-dedup with an inverted multi-index.

A vector is cut into two halves, and each half has its own codebook of ``k`` centres. The pair
of nearest centres is the vector's cell in the k x k product grid. Every vector is also a
query: the multi-sequence traversal walks the cells in ascending sum of the two half
distances, visits as many as the target recall needs, and the members of the visited
cells are verified by cosine in double precision.

How many cells that is is measured, not set: a bounded sample of queries is compared with
all rows by brute force, and the rank of the cell that holds each true neighbour gives
the share found after 1, 2, 3, ... cells. The target must hold for the pairs and for the mean over
queries of their own share, so that one large group does not speak for all others; a label
that needs more cells than the whole gets them.

Equal vectors are one class before anything is compared. A cell with many members or
queries is cut into blocks of at most ``BLOCK`` each, so no task holds a whole cell; a block
returns a count per query and the edges of a spanning forest, never the pairs.

Defined cases: null labels and vectors that are null, zero, empty or hold null or non-finite
components link with nothing; vectors of different lengths never link; repeated rows are
vectors of their own and link with each other; an empty table gives an empty result. A null id
links like any other row; it is never the smallest of its component, whose id is null, and its
rows kept, only where no row of it has an id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens.llm.common import Scratch, connected_components, drawn, prepare

MIN_COSINE, TARGET_RECALL = 0.93, 0.999
#: Bounds of the samples for the codebooks and for the measured recall.
TRAIN_ROWS, RECALL_QUERIES = 20_000, 2_000
CELL_ROWS, MOST_CENTRES, LEAST_VISITS = 64, 128, 6
BLOCK = 2_048
_SEED = 11


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, initial=0)[:, None]  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _centres(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(_SEED)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(axis=1)
        for j in range(len(c)):
            if (own := near == j).any():
                c[j] = x[own].mean(axis=0)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :], 0)


def multi_sequence(a: np.ndarray, b: np.ndarray, visits: int) -> list[int]:
    """The first ``visits`` cells i * len(b) + j in ascending a[i] + b[j]."""
    left, right, k = np.argsort(a, kind="stable"), np.argsort(b, kind="stable"), len(b)
    heap, pushed, out = [(a[left[0]] + b[right[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append(int(left[i]) * k + int(right[j]))
        for m, n in ((i + 1, j), (i, j + 1)):
            if m < len(left) and n < len(right) and (m, n) not in pushed:
                pushed.add((m, n))
                heapq.heappush(heap, (a[left[m]] + b[right[n]], m, n))
    return out


class Grid:
    """Codebooks of both halves for one vector length."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = max(1, sample.shape[1] // 2)
        self.books = [_centres(sample[:, :self.half], k), _centres(sample[:, self.half:], k) if sample.shape[1] > 1 else np.zeros((1, 0))]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, :self.half], self.books[0]), _distances(x[:, self.half:], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * b.shape[1] + b.argmin(axis=1)


def _forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of the queries (rows) and members (columns) of a block of verified pairs."""
    nq, nm = hit.shape
    q, m = np.arange(nq), np.full(nm, nq + nm)
    i, j = np.nonzero(hit)
    while True:
        np.minimum.at(m, j, q[i])
        q2 = q.copy()
        np.minimum.at(q2, i, m[j])
        if (q2 == q).all():
            return q, m
        q = q2


def near_duplicates(df: DataFrame, min_cosine: float = MIN_COSINE, target_recall: float = TARGET_RECALL,
                    key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = prepare(df.sparkSession)
    scratch = Scratch(spark, "embed")
    src = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = src.where(F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad).where(F.exists("v", lambda x: x != 0))
    # classes of equal vectors go by a number of their own: ids may be null or of any type, and never enter Python
    classes = scratch.table(valid.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
                            .withColumn("dim", F.size("v")).withColumn("rep", F.monotonically_increasing_id()))
    sizes = {r["dim"]: (r["n"], r["labels"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).collect()}
    alone = src.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not sizes:
        return alone

    # codebooks and visits for each vector length
    plans: dict[int, tuple[Grid, dict, int]] = {}
    for dim, (n, labels) in sizes.items():
        rows = classes.where(F.col("dim") == dim)
        sample = rows.where(drawn(F.xxhash64("label", "v", F.lit("codebook")), TRAIN_ROWS, n)).select("v").toArrow()["v"].to_pylist()
        if not sample:
            sample = rows.select("v").limit(1).toArrow()["v"].to_pylist()
        k = int(np.clip(round((n / max(labels, 1) / CELL_ROWS) ** 0.5), 1, MOST_CENTRES))
        grid = Grid(_unit(sample), min(k, len(sample)))
        plans[dim] = (grid, *_visits(rows, grid, n, min_cosine, target_recall))
    shared = spark.sparkContext.broadcast(plans)
    label_type = classes.schema["label"].dataType

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                grid, by_label, visits = shared.value[dim]
                x = _unit(part["v"].tolist())
                a, b = grid.distances(x)
                own = a.argmin(axis=1) * b.shape[1] + b.argmin(axis=1)
                walks = [multi_sequence(p, q, by_label.get(own_label, visits)) for p, q, own_label in zip(a, b, part["label"])]
                rep, lab, n, v = part["rep"].to_numpy(), part["label"].to_numpy(), part["n"].to_numpy(), part["v"].to_numpy()
                times = np.array([len(w) for w in walks])
                at = np.repeat(np.arange(len(part)), times)
                # a member has its walk with it, a query its own cell: a pair that only one side walks to is counted for both
                walked = pd.Series([np.array(w, "int32") for w in walks] + [None] * len(at), dtype=object)
                yield pd.DataFrame({"label": np.concatenate([lab, lab[at]]), "dim": dim, "cell": np.concatenate([own, np.concatenate(walks)]).astype("int32"),
                                    "query": np.concatenate([np.zeros(len(part), bool), np.ones(len(at), bool)]),
                                    "rep": np.concatenate([rep, rep[at]]), "n": np.concatenate([n, n[at]]), "v": np.concatenate([v, v[at]]),
                                    "home": np.concatenate([own, own[at]]).astype("int32"), "walk": walked})

    filed = scratch.table(classes.select("label", "rep", "n", "v").mapInPandas(
        place, f"label {label_type.simpleString()}, dim int, cell int, query boolean, rep long, n long, v {classes.schema['v'].dataType.simpleString()}, home int, walk array<int>"))
    # blocks of a cell: both sides are cut into parts of about BLOCK rows, and every part meets every part
    counts = filed.groupBy("label", "dim", "cell").agg(
        F.ceil(F.count_if("query") / BLOCK).cast("int").alias("q_parts"), F.ceil(F.count_if(~F.col("query")) / BLOCK).cast("int").alias("m_parts")
    ).where("q_parts > 0 and m_parts > 0")
    part = lambda n: F.pmod(F.xxhash64("rep", F.lit("part")), n).cast("int")
    series = lambda n: F.sequence(F.lit(0), n - 1)
    blocks = (filed.join(counts, ["label", "dim", "cell"])
              .withColumn("qs", F.when(F.col("query"), F.array(part(F.col("q_parts")))).otherwise(series(F.col("q_parts"))))
              .withColumn("ms", F.when(F.col("query"), series(F.col("m_parts"))).otherwise(F.array(part(F.col("m_parts")))))
              .withColumn("qp", F.explode("qs")).withColumn("mp", F.explode("ms"))
              .select("label", "dim", "cell", "qp", "mp", "query", "rep", "n", "v", "home", "walk"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["query"].to_numpy()
        q, m = pdf[is_query], pdf[~is_query]
        if q.empty or m.empty:
            return pd.DataFrame({"rep": [], "links": [], "root": []})
        hit = _unit(q["v"].tolist()) @ _unit(m["v"].tolist()).T >= min_cosine
        q_rep, m_rep, weight = q["rep"].to_numpy(), m["rep"].to_numpy(), m["n"].to_numpy()
        hit &= q_rep[:, None] != m_rep[None, :]
        links = hit @ weight
        comp_q, comp_m = _forest(hit)
        homes, home = np.unique(q["home"].to_numpy(), return_inverse=True)
        visited = np.array([np.isin(homes, w) for w in m["walk"]]).reshape(len(m), len(homes))
        back = (hit & ~visited[:, home].T).T @ q["n"].to_numpy()
        some_q, some_m = hit.any(axis=1), hit.any(axis=0)
        # a query's label is the index of a query of its component: that one is the root of the edges
        reps = np.concatenate([q_rep[some_q], m_rep[some_m]])
        roots = q_rep[np.concatenate([comp_q[some_q], comp_m[some_m]])] if len(reps) else reps
        return pd.DataFrame({"rep": reps, "links": np.concatenate([links[some_q], back[some_m]]), "root": roots})

    found = scratch.table(blocks.groupBy("label", "dim", "cell", "qp", "mp").applyInPandas(verify, f"rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch).withColumnRenamed("node", "rep")
    placed = classes.join(links, "rep", "left").join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = scratch.table(placed.join(smallest, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    scratch.drop(filed)
    linked = valid.join(named, ["label", "v"]).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    ok = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    return linked.unionByName(alone_rows(src.where(~ok)))


def alone_rows(src: DataFrame) -> DataFrame:
    return src.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))


def _visits(rows: DataFrame, grid: Grid, n: int, min_cosine: float, target: float) -> tuple[dict, int]:
    """Cells to visit, for labels of their own number and for all others: a bounded sample of queries
    against all rows, in blocks; only sums by label and cell rank come back."""
    queries = rows.where(drawn(F.xxhash64("label", "v", F.lit("recall")), RECALL_QUERIES, n)).select("rep", "label", "v").toArrow().to_pydict()
    most = len(grid.books[0]) * len(grid.books[1])
    least = min(LEAST_VISITS, most)
    if not queries["rep"] or most == 1:
        return {}, least
    x, reps, labels = _unit(queries["v"]), np.array(queries["rep"]), np.array(queries["label"])
    a, b = grid.distances(x)
    order = np.argsort((a[:, :, None] + b[:, None, :]).reshape(len(x), -1), axis=1, kind="stable")
    rank = np.empty_like(order, dtype=np.int32)
    np.put_along_axis(rank, order, np.arange(most, dtype=np.int32)[None, :].repeat(len(x), 0), axis=1)
    shared = rows.sparkSession.sparkContext.broadcast((grid, x, reps, labels, rank))

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, qx, qr, ql, rk = shared.value
        for pdf in batches:
            y = _unit(pdf["v"].tolist())
            cells = g.cells(y)
            hit = (y @ qx.T >= min_cosine) & (pdf["label"].to_numpy()[:, None] == ql[None, :]) & (pdf["rep"].to_numpy()[:, None] != qr[None, :])
            i, j = np.nonzero(hit)
            at, times = np.unique(j * most + rk[j, cells[i]], return_counts=True)
            yield pd.DataFrame({"query": (at // most).astype("int32"), "rank": (at % most).astype("int32"), "n": times})

    found = rows.select("rep", "label", "v").mapInPandas(ranks, "query int, rank int, n long").groupBy("query", "rank").agg(F.sum("n").alias("n"))
    seen = found.toPandas()  # at most a row for each sampled query and rank
    if seen.empty:
        return {}, least
    seen["share"] = seen["n"] / seen.groupby("query")["n"].transform("sum")

    def enough(part: pd.DataFrame) -> int:
        """Smallest number of visits that meets the target over the pairs and in the mean over the queries."""
        by_rank = part.groupby("rank")[["n", "share"]].sum()
        met = (by_rank.cumsum() / by_rank.sum() >= target - 1e-12).all(axis=1)
        return int(min(most, max(least, met.idxmax() + 1)))

    general = enough(seen)
    own = {label: enough(part) for label, part in seen.groupby(labels[seen["query"]])}
    return {label: k for label, k in own.items() if k > general}, general
