"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Rows become unit vectors whose angles to a query order as the inner products do: rows are put into classes of like norms, divided by the
largest norm of their class and lifted by one component.  A table hashes by ``k`` random Gaussian projections, each cut into cells
of ``width``.  Given a query's projections, those of a row at some inner product are normal around the query's own, shrunk, so the chance
that the row lies in a bucket is known.  Each query visits buckets in the order of that chance, less for buckets that many rows share, over all tables, until a row at the
expected inner product of its last neighbour is found with the chance ``success``; where no such number of buckets does it, the query is
compared with all rows of the class, in blocks.  What the tables give is merged and ranked by the exact products.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import dealt, shared_dir, staged


@dataclass(frozen=True)
class ProbeRule:
    """neighbours: wanted of each query; success: chance to find a row as far as the last of them; tables, width (in standard deviations), bucket (rows of
    a bucket, sets the number of functions); probes: buckets of a table that are put in order before all rows are taken; thrift: how much a bucket's
    load counts against its chance in that order (0: not at all, 1: in full); chunk: rows and queries of a
    task's block; sample: rows from which the inner product of the last neighbour is estimated (collected, whatever the input)."""

    neighbours: int = 20
    success: float = 0.95
    tables: int = 6
    width: float = 2.5
    bucket: float = 16.0
    probes: int = 2048
    thrift: float = 0.6
    chunk: int = 32768
    sample: int = 4096
    seed: int = 17


@dataclass(frozen=True)
class Group:
    """A class of rows: their length, binary order of norms, number and largest norm."""

    dims: int
    octave: int
    n: int
    top: float


#: Functions whose cells are combined at once.
STEP = 6
CELLS = 3
_GRID = np.linspace(-8, 8, 32_769)
_CDF = np.asarray([0.5 * math.erfc(-x / math.sqrt(2)) for x in _GRID.tolist()])


def cdf(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, from a table (error below 1e-7)."""
    return np.interp(x, _GRID, _CDF)


class Tables:
    """The hash functions of a class."""

    def __init__(self, group: Group, rule: ProbeRule):
        self.rule, self.group = rule, group
        self.k = max(0, round(math.log2(max(1.0, group.n / rule.bucket))) - 1) if group.n > min(1024, rule.chunk) else 0
        #: Functions whose cells make a block: enough that a block is about a chunk of rows.
        self.m = min(self.k, max(0, math.ceil(math.log2(max(1.0, group.n / rule.chunk)))))
        rng = np.random.default_rng([rule.seed, group.dims, self.k])
        shape = (rule.tables if self.k else 1, self.k)
        self.planes = rng.standard_normal((group.dims + 1, math.prod(shape)))
        self.shift = rng.uniform(0, rule.width, shape)
        self.odd = rng.integers(1, 1 << 63, shape, np.uint64) * np.uint64(2) + np.uint64(1)

    def project(self, unit: np.ndarray) -> np.ndarray:
        """Projections by row, table and function."""
        return (unit @ self.planes).reshape(len(unit), *self.shift.shape)

    def codes(self, cells: np.ndarray, functions: slice = slice(None)) -> np.ndarray:
        """The sums of cells times odd numbers over the last axis."""
        return (cells.astype(np.int64).view(np.uint64) * self.odd[:, functions]).sum(-1, dtype=np.uint64)

    def buckets(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket and block codes of rows, by table."""
        x = x / self.group.top
        lift = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1, keepdims=True)))
        cells = np.floor((self.project(np.hstack([x, lift])) + self.shift) / self.rule.width)
        return self.codes(cells), self.codes(cells[:, :, : self.m], slice(0, self.m))

    def visits(self, q: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The best buckets of every query (unit vectors) and table, best first: their log chances, codes and block codes, for a row at
        ``cosine``; and how many of each table, over all tables, reach the success: 0 where they don't."""
        rule, (tables, k) = self.rule, self.shift.shape
        n = len(q)
        u = self.project(np.hstack([q, np.zeros((n, 1))]))
        mean, spread = cosine[:, None, None] * u, np.sqrt(1 - cosine * cosine)[:, None, None]
        cells = np.floor((mean + self.shift) / rule.width)[..., None] + np.arange(CELLS) - CELLS // 2
        low = (cells * rule.width - self.shift[..., None] - mean[..., None]) / spread[..., None]
        chance = np.log(np.maximum(cdf(low + rule.width / spread[..., None]) - cdf(low), 1e-12))
        # A bucket's load: the share of all rows that it holds, if rows have any direction.
        edge = cells * rule.width - self.shift[..., None]
        worth = chance - rule.thrift * np.log(np.maximum(cdf(edge + rule.width) - cdf(edge), 1e-6))
        part = cells.astype(np.int64).view(np.uint64) * self.odd[..., None]
        worths, logs = np.zeros((2, n, tables, 1))
        codes, blocks = np.zeros((2, n, tables, 1), np.uint64)
        for at in range(0, k, STEP):
            width = min(STEP, k - at)
            choice = np.asarray(list(itertools.product(range(CELLS), repeat=width)))
            value = sum(worth[:, :, at + j, choice[:, j]] for j in range(width))
            more = sum(chance[:, :, at + j, choice[:, j]] for j in range(width))
            code = sum(part[:, :, at + j, choice[:, j]] for j in range(width))
            block = sum((part[:, :, at + j, choice[:, j]] for j in range(width) if at + j < self.m), np.zeros_like(code))
            worths, logs, codes, blocks = best_sums((worths, logs, codes, blocks), sorted_by(value, more, code, block), rule.probes)
        # What each bucket adds to the chance that one of the tables has the row.
        found = np.minimum(np.cumsum(np.exp(logs), 2), 1 - 1e-12)
        gain = -np.diff(np.log1p(-found), axis=2, prepend=0)
        order = np.argsort(-worths.reshape(n, -1), 1, kind="stable")
        reached = np.cumsum(np.take_along_axis(gain.reshape(n, -1), order, 1), 1) >= -math.log(1 - rule.success)
        least = np.take_along_axis(worths.reshape(n, -1), order, 1)[np.arange(n), reached.argmax(1)]
        counts = (worths >= least[:, None, None]).sum(2)
        return logs, codes, blocks, np.where(reached.any(1)[:, None], counts, 0)


def sorted_by(values: np.ndarray, *others: np.ndarray) -> tuple:
    order = np.argsort(-values, 2, kind="stable")
    return tuple(np.take_along_axis(x, order, 2) for x in (values, *others))


def best_sums(one: tuple, other: tuple, most: int) -> tuple:
    """The ``most`` largest sums of a value of each of two descending lists (the first arrays), and the sums of the other arrays there.

    The sum at ranks i and j has (i + 1)(j + 1) sums that are no smaller, so only those with a product up to ``most`` are looked at.
    """
    n, m = one[0].shape[2], other[0].shape[2]
    ranks = np.asarray([(i, j) for i in range(n) for j in range(min(m, most // (i + 1)))])
    total = one[0][:, :, ranks[:, 0]] + other[0][:, :, ranks[:, 1]]
    if total.shape[2] > most:
        keep = np.argpartition(-total, most - 1, 2)[:, :, :most]
    else:
        keep = np.broadcast_to(np.arange(total.shape[2]), total.shape)
    top, at = sorted_by(np.take_along_axis(total, keep, 2), keep)
    i, j = ranks[at, 0], ranks[at, 1]
    return top, *[np.take_along_axis(x, i, 2) + np.take_along_axis(y, j, 2) for x, y in zip(one[1:], other[1:], strict=True)]


def last_products(q: np.ndarray, sample: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query, a product that the ``k``-th nearest of ``n`` rows has at least (the sample's own), and the one it is expected to have:
    the sample's largest products are carried on by a normal tail."""
    m = len(sample)
    if m <= k:
        return np.full(len(q), -np.inf), np.full(len(q), -np.inf)
    products = -np.sort(-(q @ sample.T), 1)
    low = products[:, k - 1]
    if n <= m:
        return low, low
    z = [NormalDist().inv_cdf(1 - p) for p in (k / n, k / m, min(0.4, 10 * k / m))]
    slope = (low - products[:, min(m - 1, int(min(0.4, 10 * k / m) * m))]) / (z[1] - z[2])
    return low, low + slope * (z[0] - z[1])


def usable() -> Column:
    """A vector takes part if it is not null, not zero, and all its components are finite."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))


def length(vector: str) -> Column:
    """The norm of a column of vectors, scaled first so that no square overflows."""
    return F.expr(f"transform(array(array_max(transform({vector}, v -> abs(v)))), m -> least(1e308D, m * sqrt(aggregate({vector}, 0D, (s, v) -> s + (v / m) * (v / m)))))[0]")


ROW_SCHEMA = "vec_id long, grp int, codes array<long>, blocks array<long>, vector binary"
VISIT_SCHEMA = "grp int, tab int, block long, query string, vector binary, codes binary, whole boolean"
FOUND_SCHEMA = "query string, vec_id long, score double"
#: Bytes of rows and visits that a task reads, about.
TASK_BYTES = 8 << 20


def neighbours(rows: DataFrame, queries: DataFrame, rule: ProbeRule, directory: str) -> DataFrame:
    """query, vec_id, score: the nearest rows found (``rule.neighbours``, and more if products tie) of each of ``queries`` (query, vector) among ``rows`` (vec_id, vector).

    ``vector`` is an array of finite doubles, not all zero; vectors of different lengths are not compared.
    """
    spark = rows.sparkSession
    sized = rows.withColumns({"dims": F.size("vector"), "norm": length("vector")}).withColumn("octave", F.floor(F.log2("norm") + 0.5).cast("int"))
    sized = staged(sized, directory, "sized")
    # A row for each length and power of two.
    groups = [Group(*r) for r in sized.groupBy("dims", "octave").agg(F.count("*"), F.max("norm")).sort("dims", "octave").collect()]
    tables = [Tables(g, rule) for g in groups]
    place = {(g.dims, g.octave): k for k, g in enumerate(groups)}
    taken = sized.select("vector", F.xxhash64("vec_id").alias("h")).sort("h").limit(rule.sample).collect()
    sample: dict[int, list] = {}
    for r in taken:
        sample.setdefault(len(r.vector), []).append(r.vector)
    sample = {d: np.asarray(v) for d, v in sample.items()}

    def hashed(batches):
        for pdf in batches:
            for key, part in pdf.groupby(["dims", "octave"]):
                grp = place[key]
                x = np.stack(part["vector"].to_numpy())
                codes, blocks = tables[grp].buckets(x)
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "grp": grp, "codes": list(codes.view(np.int64)), "blocks": list(blocks.view(np.int64)), "vector": [v.tobytes() for v in x]})

    def visits(batches):
        for pdf in batches:
            for d, same in pdf.groupby(pdf["vector"].map(len)):
                mine = [k for k, g in enumerate(groups) if g.dims == d]
                total = sum(groups[k].n for k in mine)
                for at in range(0, len(same), 32):
                    part = same.iloc[at : at + 32]
                    q = np.stack(part["vector"].to_numpy())
                    norms = np.abs(q).max(1) * np.linalg.norm(q / np.abs(q).max(1, keepdims=True), axis=1)
                    low, expected = last_products(q, sample.get(d, np.zeros((0, d))), total, rule.neighbours + 1)
                    names, raw = part["query"].tolist(), [v.tobytes() for v in q]
                    out = []
                    for grp in mine:
                        # No row of a class can have a larger product than its largest norm gives.
                        cosine = np.minimum(expected / norms / groups[grp].top, 0.999)
                        possible = low <= norms * groups[grp].top * (1 + 1e-9)
                        near = possible & (cosine > 0) & (tables[grp].k > 0)
                        out += [(grp, 0, 0, names[r], raw[r], b"", True) for r in np.flatnonzero(possible & ~near)]
                        some = np.flatnonzero(near)
                        if not len(some):
                            continue
                        _, codes, blocks, counts = tables[grp].visits(q[some] / norms[some, None], cosine[some])
                        for at_row, r in enumerate(some):
                            if not counts[at_row].any():
                                out.append((grp, 0, 0, names[r], raw[r], b"", True))
                            for t, n in enumerate(counts[at_row].tolist()):
                                order = np.argsort(blocks[at_row, t, :n], kind="stable")
                                held, firsts = np.unique(blocks[at_row, t, :n][order], return_index=True)
                                for b, c in zip(held.view(np.int64).tolist(), np.split(codes[at_row, t, :n][order], firsts[1:]), strict=False):
                                    out.append((grp, t, b, names[r], raw[r], np.sort(c).tobytes(), False))
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in VISIT_SCHEMA.split(", ")])

    lists = staged(sized.select("vec_id", "vector", "dims", "octave").mapInPandas(hashed, ROW_SCHEMA), directory, "rows")
    asked = staged(dealt(queries.select("query", "vector")).mapInPandas(visits, VISIT_SCHEMA), directory, "visits")
    spots = ["grp", "tab", "block"]
    held = lists.select("vec_id", "grp", "vector", F.posexplode(F.arrays_zip("codes", "blocks")).alias("tab", "x")).select("grp", "tab", F.col("x.blocks").alias("block"), "vec_id", "vector", F.col("x.codes").alias("code"))
    members = staged(held.groupBy(*spots).agg(F.count("*").alias("n")), directory, "members")
    # Queries that tables can't answer go to every block of one table.
    everywhere = asked.filter("whole").drop("block").join(members.select("grp", "tab", "block"), ["grp", "tab"])
    asked = asked.filter("NOT whole").unionByName(everywhere)
    # Only large blocks are joined, which are few: their rows and their queries are dealt over parts, and every pair of parts is a task.
    callers = asked.groupBy(*spots).agg(F.count("*").alias("q"))
    large = members.join(callers, spots).select(*spots, F.ceil(F.col("n") / rule.chunk).cast("int").alias("row_parts"), F.ceil(F.col("q") / rule.chunk).cast("int").alias("query_parts")).filter("row_parts > 1 OR query_parts > 1")
    large = staged(large, directory, "large")

    def parted(df: DataFrame, own: str, other: str, by: str) -> DataFrame:
        df = df.join(large, spots, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("row_parts", "query_parts")})
        df = df.withColumn(own, F.pmod(F.xxhash64(by, F.lit(5)), F.col(f"{own}_parts")).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1))).drop("row_parts", "query_parts")

    rows_side = parted(held, "row", "query", "vec_id").select(*spots, "row", F.col("query").alias("ask"), F.lit("").alias("query"), "vec_id", "vector", F.col("code"), F.lit(b"").alias("codes"), F.lit(False).alias("whole"))
    query_side = asked.withColumnRenamed("query", "name")
    query_side = parted(query_side, "query", "row", "name").select(*spots, "row", F.col("query").alias("ask"), F.col("name").alias("query"), F.lit(0).cast("long").alias("vec_id"), "vector", F.lit(0).cast("long").alias("code"), "codes", "whole")
    n, width = sum(g.n for g in groups), 8 * max((g.dims for g in groups), default=1) + 64
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(2 * n * rule.tables * width / TASK_BYTES) + 1)
    met = rows_side.unionByName(query_side).repartition(tasks, *spots, "row", "ask")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        is_row = (pdf["query"] == "").to_numpy()
        held, ask = pdf[is_row], pdf[~is_row]
        found = []
        if len(held) and len(ask):
            ids = held["vec_id"].to_numpy()
            order = np.argsort(held["code"].to_numpy().view(np.uint64), kind="stable")
            codes = held["code"].to_numpy().view(np.uint64)[order]
            x = np.frombuffer(b"".join(held["vector"]), np.float64).reshape(len(held), -1)[order]
            q = np.frombuffer(b"".join(ask["vector"]), np.float64).reshape(len(ask), -1)
            ids, names = ids[order], ask["query"].to_numpy(object)
            spans = []
            for c, whole in zip(ask["codes"], ask["whole"], strict=True):
                c = np.frombuffer(c, np.uint64)
                spans.append((np.asarray([0]), np.asarray([len(ids)])) if whole else (np.searchsorted(codes, c, "left"), np.searchsorted(codes, c, "right")))
            sizes = np.asarray([int((b - a).sum()) for a, b in spans])
            at = 0
            while at < len(ask):
                end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 15, "right")))
                of = np.repeat(np.arange(at, end), sizes[at:end])
                if len(of):
                    row = np.concatenate([np.arange(a, b) for s in spans[at:end] for a, b in zip(*s, strict=True) if b > a])
                    score = (x[row] * q[of]).sum(1)
                    sort = np.lexsort((ids[row], -score, of))
                    of, row, score = of[sort], row[sort], score[sort]
                    rank = np.arange(len(of)) - np.searchsorted(of, of, "left")
                    best = rank <= rule.neighbours
                    found.append((names[of[best]], ids[row[best]], score[best]))
                at = end
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query", "vec_id", "score"), columns, strict=True)))

    found = met.groupBy(*spots, "row", "ask").applyInPandas(search, FOUND_SCHEMA)
    merged = found.repartition("query").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return merged.withColumn("rank", rank).filter(F.col("rank") <= rule.neighbours + 1).drop("rank")


def search_digest(vectors: DataFrame, rule: ProbeRule = ProbeRule(), every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found of each row of ``vectors`` (vec_id, embedding) whose vec_id is divisible by ``every``.

    Nearness is the inner product in double precision, ties go to the smaller vec_id, and a query's own vec_id is left out.  Vectors that are
    null, zero or not finite, and rows without vec_id, take no part.  Equal rows count once; a vec_id with several vectors asks with
    each, comes once in a result, by its nearest, and its results are ranked together with those of the same vector only.
    An empty table gives no rows.  Copies: of equal vectors the ``neighbours + 1`` smallest vec_ids are indexed, as no query can want more, and
    equal queries are asked once, so a large group of copies is neither a large bucket nor many searches.
    """
    spark, directory = vectors.sparkSession, shared_dir(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(usable())
    # A zero has a sign that equality ignores.
    rows = rows.select("vec_id", F.transform("embedding", lambda v: v + F.lit(0.0)).alias("vector"))
    rows = rows.withColumn("query", F.md5(F.array_join(F.transform("vector", lambda v: v.cast("string")), ",").cast("binary")))
    rows = staged(rows.groupBy("query", "vec_id").agg(F.first("vector").alias("vector")), directory, "distinct")
    copy = F.row_number().over(Window.partitionBy("query").orderBy("vec_id"))
    held = rows.withColumn("copy", copy).filter(F.col("copy") <= rule.neighbours + 1).select("vec_id", "vector")
    asking = rows.filter(F.col("vec_id") % every == 0)
    found = neighbours(held, asking.groupBy("query").agg(F.first("vector").alias("vector")), rule, directory)
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near"))
    lists = staged(lists, directory, "lists")
    mine = asking.select(F.col("vec_id").alias("query_id"), "query").join(lists, "query")
    mine = mine.select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, rule.neighbours).alias("near"))
    return mine.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))
