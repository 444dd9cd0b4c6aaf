"""Near-duplicate embeddings by spherical-cap filters.

The directions of the filters are several independent product codes: the space is rotated at random and cut into
blocks, each with a small random code, and a filter is one code vector of each block.  A vector passes the filters whose
inner product with it reaches a threshold of its own, the score of its ``each`` best filters, so no vector is without
filters in any code.  They are found by list decoding, block by block with a bound on the rest, without visiting the
others.  Vectors meet in filters, and links are verified by the exact cosine.

A rotation makes the chance that a pair meets depend on its angle alone, so ``covering`` measures it on random pairs
just at the similarity, where it is least, and adds codes until all but ``1 - recall`` of them meet.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, shared_dir, staged
from .components import Forest, components


@dataclass(frozen=True)
class CapFilters:
    """load: filters that a vector passes at least; bucket: expected vectors of a filter (sets their number); chunk: rows of a task's block;
    each: filters that a vector passes in one code; recall: share of pairs just at the threshold that meet, on random ones.

    Codes are added until ``recall`` is met, so ``load`` is only the fewest filters to start from; each filter costs a copy of the vector."""

    threshold: float = 0.95
    load: float = 8.0
    bucket: float = 200.0
    blocks: int = 3
    chunk: int = 2048
    seed: int = 11
    each: int = 4
    recall: float = 0.999


def code(dims: int, n: int, options: CapFilters) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """Block bounds, block codes and the threshold for ``n`` vectors of ``dims`` components."""
    rng = np.random.default_rng(options.seed + dims)
    m = min(options.blocks, dims)
    filters = max(8.0, options.load * n / options.bucket)
    size = max(2, round(filters ** (1 / m)))
    cuts = np.array_split(rng.permutation(dims), m)
    codes = []
    for cut in cuts:
        c = rng.standard_normal((size, len(cut)))
        c = c / np.linalg.norm(c, axis=1, keepdims=True)
        codes.append(c if len(cut) > 1 else np.asarray([[-1.0], [1.0]]))
    share = min(0.5, options.load / size**m)
    return cuts, codes, NormalDist().inv_cdf(1 - share) * float(np.sqrt(m / dims))


def decode(x: np.ndarray, cuts, codes, threshold: float | np.ndarray) -> list[np.ndarray]:
    """The filters that each unit vector passes, by list decoding with a bound on the blocks still to come; one threshold or one for each vector."""
    threshold = np.broadcast_to(threshold, len(x))
    scores = [x[:, cut] @ c.T for cut, c in zip(cuts, codes, strict=True)]
    most = [s.max(1) for s in scores]
    rest = [sum(most[k + 1 :], np.zeros(len(x))) for k in range(len(scores))]
    row, name, total = np.repeat(np.arange(len(x)), 1), np.zeros(len(x), np.int64), np.zeros(len(x))
    for s, bound in zip(scores, rest, strict=True):
        size = s.shape[1]
        total = total[:, None] + s[row]
        keep = total + bound[row][:, None] > threshold[row][:, None]
        at, c = np.nonzero(keep)
        row, name, total = row[at], name[at] * size + c, total[at, c]
    order = np.lexsort((name, row))
    return np.split(name[order], np.cumsum(np.bincount(row, minlength=len(x)))[:-1])


def reach(x: np.ndarray, cuts, codes, each: int) -> np.ndarray:
    """The score of the ``each``-th best filter of each vector.

    A filter with code vectors of ranks i, j, k in their blocks has (i + 1)(j + 1)(k + 1) filters that are no worse, itself among
    them, so only those with a product up to ``each`` are looked at.
    """
    best = [-np.sort(-(x[:, cut] @ c.T), 1)[:, :each] for cut, c in zip(cuts, codes, strict=True)]
    ranks = [r for r in itertools.product(*[range(b.shape[1]) for b in best]) if math.prod(k + 1 for k in r) <= each]
    scores = sum(b[:, list(k)] for b, k in zip(best, zip(*ranks, strict=True), strict=True))
    return np.sort(scores, 1)[:, -min(each, scores.shape[1])]


def turned(dims: int, n: int, options: CapFilters, k: int) -> tuple:
    """The ``k``-th code, after a rotation of its own."""
    cuts, codes, _ = code(dims, n, replace(options, load=options.each, seed=options.seed + 100_003 * k))
    q, r = np.linalg.qr(np.random.default_rng([options.seed, dims, k]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r)), cuts, codes


def passed(x: np.ndarray, one: tuple, each: int) -> list[np.ndarray]:
    """The ``each`` best filters of one code for every vector; more where scores tie."""
    rotation, cuts, codes = one
    x = x @ rotation
    return decode(x, cuts, codes, reach(x, cuts, codes, each) - 1e-12)


#: Random pairs by which recall is measured.
PAIRS = 10_000


def pairs_at(dims: int, n: int, cosine: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` random pairs of unit vectors with the given cosine."""
    rng = np.random.default_rng([seed, dims])
    x, z = rng.standard_normal((2, n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    length = np.linalg.norm(z, axis=1, keepdims=True)
    return x, x if dims == 1 else cosine * x + math.sqrt(1 - cosine * cosine) * z / length


def covering(dims: int, n: int, options: CapFilters) -> tuple[list[tuple], float]:
    """Codes for ``n`` vectors, and the share of random pairs at the threshold that meet in them.

    ``load / each`` codes, and more until the share is ``recall``; where three times as many don't do (few dimensions), there are
    half as many filters, so that each is wider.
    """
    x, y = pairs_at(dims, PAIRS, options.threshold, options.seed)
    least = math.ceil(options.load / options.each)
    while True:
        codes, left = [], np.arange(len(x))
        while len(codes) < 3 * least:
            codes.append(turned(dims, n, options, len(codes)))
            if len(left):
                a, b = passed(x[left], codes[-1], options.each), passed(y[left], codes[-1], options.each)
                left = left[[not np.isin(p, q).any() for p, q in zip(a, b, strict=True)]]
            met = 1 - len(left) / len(x)
            if len(codes) >= least and met >= options.recall:
                return codes, met
        if n < 2:
            return codes, met
        n //= 2


def filter_lists(x: np.ndarray, codes: list[tuple], each: int) -> list[np.ndarray]:
    """The filters of all codes that each vector passes, ascending; no list is empty."""
    lists = [[f + (k << 48) for f in passed(x, one, each)] for k, one in enumerate(codes)]
    return [np.concatenate(fs) for fs in zip(*lists, strict=True)]


def can_link() -> Column:
    """A vector can link if it is not null, not zero, and all its components are finite."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision, scaled first so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


LIST_SCHEMA = "vec_id long, copies long, dims int, filters array<long>, vector binary"
#: Bytes of members that a task reads, about.
TASK_BYTES = 8 << 20
FOUND_SCHEMA = "vec_id long, other long, links long"


def met_before(lists: list[np.ndarray], name: int) -> np.ndarray:
    """A row for each list and a column for each filter below ``name`` that two of the lists have: 1 where the list has it."""
    earlier = [f[f < name] for f in lists]
    flat, of = np.concatenate(earlier), np.repeat(np.arange(len(lists)), [len(f) for f in earlier])
    names, back, counts = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    keep = counts[back] > 1
    out = np.zeros((len(lists), int((counts > 1).sum())), np.float32)
    out[of[keep], column[back[keep]]] = 1
    return out


def near_links(reps: DataFrame, options: CapFilters, directory: str) -> DataFrame:
    """vec_id, other, links from distinct vectors ``reps`` (vec_id, copies, embedding).

    Rows with ``other`` are links that span what a task found; rows with ``links`` count copies linked to a vector.  A pair that
    meets in several filters counts in the first.  A filter with more than ``chunk`` vectors is split into blocks, and
    each pair of blocks is a task of its own, so no task holds more than about two blocks.
    """
    spark, n = reps.sparkSession, reps.count()
    sizes = [r[0] for r in reps.select(F.size("embedding").alias("n")).distinct().limit(64).collect()]
    kind = "<f4" if reps.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    made = {d: covering(d, n, options)[0] for d in sizes}
    load = options.each * max(map(len, made.values()), default=0)

    def listed(batches):
        for pdf in batches:
            for d, part in pdf.groupby(pdf["embedding"].map(len)):
                if d not in made:
                    made[d] = covering(d, n, options)[0]
                x = unit(np.stack(part["embedding"].to_numpy()))
                for at in range(0, len(x), 512):
                    rows = part.iloc[at : at + 512]
                    raw = [np.asarray(v, kind).tobytes() for v in rows["embedding"]]
                    yield pd.DataFrame({"vec_id": rows["vec_id"].to_numpy(), "copies": rows["copies"].to_numpy(), "dims": d, "filters": filter_lists(x[at : at + 512], made[d], options.each), "vector": raw})

    lists = staged(reps.mapInPandas(listed, LIST_SCHEMA), directory, "lists")
    # Only the filters that have to be split are joined, which are few: as a finished table Spark sees their size before members move.
    split = lists.select(F.explode("filters").alias("filter"), "dims").groupBy("filter", "dims").agg(F.ceil(F.count("*") / options.chunk).cast("int").alias("k")).filter("k > 1")
    split = staged(split, directory, "split")
    parts = lists.select(F.explode("filters").alias("filter"), "*").join(split, ["filter", "dims"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    parts = parts.withColumn("own", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("k")).cast("int")).withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    parts = parts.withColumn("lo", F.least("own", "peer")).withColumn("hi", F.greatest("own", "peer")).drop("k", "peer")

    def verify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, _, lo, hi = key
        ids, copies, own = pdf["vec_id"].to_numpy(), pdf["copies"].to_numpy(), pdf["own"].to_numpy()
        found, spans = np.zeros(len(ids), np.int64), []
        if len(ids) > 1:
            x = unit(np.frombuffer(b"".join(pdf["vector"]), kind).reshape(len(pdf), -1))
            before, forest = None, Forest(len(ids))
            for at in range(0, len(ids), 512):
                a, b = np.nonzero(x[at : at + 512] @ x.T >= options.threshold - 1e-12)
                keep = (a + at < b) & ((own[a + at] != own[b]) if lo != hi else True)
                a, b = a[keep], b[keep]
                if not len(a):
                    continue
                if before is None:
                    before = met_before(list(pdf["filters"]), name)
                first = (before[at : at + 512] @ before.T)[a, b] == 0
                a, b = a[first] + at, b[first]
                exact = np.einsum("ij,ij->i", x[a], x[b]) >= options.threshold
                a, b = a[exact], b[exact]
                np.add.at(found, a, copies[b])
                np.add.at(found, b, copies[a])
                spans += [(ids[i], ids[j], 0) for i, j in zip(a.tolist(), b.tolist(), strict=True) if forest.join(i, j)]
        some = found > 0
        counted = pd.DataFrame({"vec_id": ids[some], "other": None, "links": found[some]})
        out = pd.concat([counted, pd.DataFrame(spans, columns=["vec_id", "other", "links"])], ignore_index=True)
        out["other"] = out["other"].astype("Int64")
        return out

    # A member is small but there are many: enough tasks that each holds a few megabytes of them.
    width = max(sizes, default=1) * int(kind[-1]) + 8 * load + 64
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n * load * width / TASK_BYTES) + 1)
    parts = parts.repartition(tasks, "filter", "dims", "lo", "hi")
    return parts.groupBy("filter", "dims", "lo", "hi").applyInPandas(verify, FOUND_SCHEMA)


def embedding_digest(vectors: DataFrame, options: CapFilters = CapFilters()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Equal vectors are one representative with a number of copies, so groups of copies never form pairs.  Vectors that
    are null, zero or not finite, and rows without vec_id, link with nothing and are their own component.  Vectors of
    different lengths don't link.  A repeated vec_id is a row each time; it counts as another vector.
    """
    directory = shared_dir(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding")
    if rows.schema["embedding"].dataType.elementType.typeName() not in ("float", "double"):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    # Rows that can't link get a key that no other row has, so they gather nowhere and are lost nowhere.
    joined = F.array_join(F.transform("embedding", lambda v: (v + F.lit(0.0)).cast("string")), ",")
    keyed = staged(rows.select("vec_id", F.when(can_link(), F.md5(joined.cast("binary"))).otherwise(F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))).alias("key"), "embedding"), directory, "keyed")
    same = keyed.filter(~F.col("key").startswith("#")).groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    same = staged(same, directory, "distinct")
    found = staged(near_links(same.select(F.col("rep").alias("vec_id"), "copies", "embedding"), options, directory), directory, "found")
    discard(vectors.sparkSession, directory, "lists")
    linked = components(found.filter("other IS NOT NULL").select(F.col("vec_id").alias("a"), F.col("other").alias("b")), f"{directory}/components")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    reps = same.select("key", "rep", "copies").join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    done = keyed.select("vec_id", "key").join(reps, "key", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return done.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
