"""N-gram Jaccard join by prefix trees.

A document is the set of its distinct word n-grams (64-bit hashes).  Keys that no other document holds can't be common, so a
document goes on only while enough of its keys are held elsewhere: first by the least keys of its set, then by all of them.  The keys left
are put in one global order, rarest first.  Linked sets share a key of their prefixes, and a key is looked after by one
of the documents that hold it, the one that meets most others: a document goes once to each centre of its prefix keys, so work follows
paths of the tree and not pairs of documents.  At a centre the sets are put into a trie, most common keys first, that a probe walks once,
sharing the partial overlap of common paths and leaving subtrees whose remaining lengths can't reach the bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import packs
from ._shared import discard, shared_dir, staged
from .components import Forest, components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class JoinRule:
    """words in an n-gram; percent: 100 * intersection >= percent * union links.

    slack_percent: keys of a set, in percent, that the first look takes beyond the fewest possible; links share at least
    so many of them.  group_keys: keys in a task's sets, about; a centre with more is dealt into bands of sizes and parts.
    hubs: documents of such a centre that every part compares with, so that most of a large group is one component at once.
    """

    words: int = 5
    percent: int = 80
    slack_percent: int = 10
    group_keys: int = 150_000
    hubs: int = 8

    def least_overlap(self, n: int) -> int:
        """Fewest common keys that a set of n keys has with any set that it links to."""
        return -(-self.percent * n // 100)

    def slack(self, n: int) -> int:
        return max(1, self.slack_percent * n // 100)

    def first_keys(self, n: int) -> int:
        return min(n, n - self.least_overlap(n) + self.slack(n))

    def needed(self, n: int) -> int:
        """Fewest common first keys of a set of n keys with any set that it links to: the slack of the smallest one."""
        return min(self.first_keys(n), self.slack(self.least_overlap(n)))

    def band_width(self) -> float:
        """Logarithm of the size at which a band of sizes ends; sets that link are at most one band apart."""
        return 1.0001 * math.log(max(100 / self.percent, 1.01))


def word_digest(data: bytes) -> bytes:
    """16 bytes of the lower-case words of a text; equal for texts that differ in white space alone.  Zeros without words."""
    import xxhash

    words = data.translate(LOWER).split()
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else bytes(16)


#: Bytes that are hashed at once; a longer word is taken whole.
SLICE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are white space, and a random value of each other byte, the same for A-Z as for a-z."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    value = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
    value[space] = 0
    return space, value


class Shingler:
    """Sets of n-gram keys of whole texts.

    A word's hash is the sum of its bytes' values times powers of an odd base, modulo 2^64, divided by the power at its start, so that all
    words of many texts come from running sums.
    """

    def __init__(self, words: int):
        self.n, (self.space, self.value) = words, _tables()
        self.up, self.down = self._powers(SLICE)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, inverse))

    def words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word; words end at white space and before each of ``starts``."""
        space = self.space[data]
        first = ~space
        first[1:] &= space[:-1]
        begins = starts[starts < len(data)]
        first[begins] = ~space[begins]
        first = np.flatnonzero(first)
        last = ~space
        last[:-1] &= space[1:]
        before = begins[begins > 0] - 1
        last[before] = ~space[before]
        last = np.flatnonzero(last)
        out, at = [np.zeros(0, np.uint64)], 0
        while at < len(first):
            base = int(first[at])
            to = max(at + 1, int(np.searchsorted(last, base + SLICE, side="left")))
            part = data[base : int(last[to - 1]) + 1]
            if len(part) >= len(self.up):
                self.up, self.down = self._powers(len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.value[part] * self.up[: len(part)], out=sums[1:])
            a, b = first[at:to] - base, last[at:to] - base + 1
            out.append(packs.mix((sums[b] - sums[a]) * self.down[a] ^ (b - a).astype(np.uint64)))
            at = to
        return np.concatenate(out), first

    def fold(self, parts) -> np.ndarray:
        key = np.zeros(len(parts[0]), np.uint64)
        for h in parts:
            key = (key ^ h) * _BASE
            key ^= key >> np.uint64(29)
        return packs.mix(key ^ np.uint64(len(parts)))

    def sets(self, data: bytes, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Sorted distinct keys of each text of ``data``, which has ``starts`` of its texts and its end; a text with fewer words than n is
        one key, without words none."""
        h, first = self.words(np.frombuffer(data, np.uint8), starts)
        cuts = np.searchsorted(first, starts).tolist()
        m = len(h) - self.n + 1
        key = self.fold([h[k : k + m] for k in range(self.n)]) if m > 0 else None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= self.n:
                yield np.unique(key[a : b - self.n + 1])
            else:
                yield self.fold([h[k : k + 1] for k in range(a, b)]) if b > a else np.zeros(0, np.uint64)

    def keys(self, data: bytes) -> np.ndarray:
        return next(self.sets(data, np.asarray([0, len(data)])))


@dataclass
class Node:
    """A path of keys that the sets below share.

    reach: the greatest (100 + percent) * keys - percent * size of the sets below; fewest: the least of their sizes.
    """

    path: np.ndarray
    reach: int
    fewest: int
    items: list[tuple[int, int]] = field(default_factory=list)
    children: dict[int, Node] = field(default_factory=dict)


class PrefixTree:
    """Sets of small integers in ascending order, compressed to paths.  A set's size also counts keys that no other set has."""

    def __init__(self, percent: int, universe: int):
        self.percent, self.root = percent, Node(np.zeros(0, np.int32), -(1 << 60), 1 << 60)
        self.inside = np.zeros(universe + 1, bool)

    def add(self, item: int, ranks: np.ndarray, size: int) -> None:
        node, at, n = self.root, 0, len(ranks)
        reach = (100 + self.percent) * n - self.percent * size
        while True:
            node.reach, node.fewest = max(node.reach, reach), min(node.fewest, size)
            if at == n:
                node.items.append((item, size))
                return
            child = node.children.get(int(ranks[at]))
            if child is None:
                node.children[int(ranks[at])] = Node(ranks[at:], reach, size, [(item, size)])
                return
            path = child.path
            m = min(len(path), n - at)
            apart = np.flatnonzero(path[:m] != ranks[at : at + m])
            same = int(apart[0]) if len(apart) else m
            if same < len(path):
                upper = Node(path[:same], child.reach, child.fewest, [], {int(path[same]): child})
                child.path = path[same:]
                node.children[int(ranks[at])] = child = upper
            node, at = child, at + same

    def links(self, ranks: np.ndarray, size: int) -> list[int]:
        """Items whose sets reach the similarity with the probe.

        On a walk, ``common`` keys of the path are the probe's and ``missed`` are not.  A set below has at most all its keys but the missed
        ones in common, and at most ``common`` and the probe's keys after the path; it links if
        (100 + percent) * common >= percent * (both sizes).
        """
        t, found, inside = self.percent, [], self.inside
        inside[ranks] = True
        stack = [(c, 0, 0) for c in self.root.children.values()]
        while stack:
            node, common, missed = stack.pop()
            if node.reach - (100 + t) * missed < t * size or (100 + t) * len(ranks) < t * (size + node.fewest):
                continue
            hits = int(np.count_nonzero(inside[node.path]))
            common, missed = common + hits, missed + len(node.path) - hits
            rest = len(ranks) - int(np.searchsorted(ranks, node.path[-1], side="right"))
            if node.reach - (100 + t) * missed < t * size or (100 + t) * (common + rest) < t * (size + node.fewest):
                continue
            found += [i for i, n in node.items if (100 + t) * common >= t * (size + n)]
            stack += [(c, common, missed) for c in node.children.values()]
        inside[ranks] = False
        return found


def ordered_alike(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets as ascending ranks: keys of many sets first, ties by key."""
    keys, back, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(keys), np.int32)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(keys), dtype=np.int32)
    ranks, cuts = rank[back.ravel()], np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(r) for r in np.split(ranks, cuts)], len(keys)


def links_among(ids: list[int], sets: list[np.ndarray], sizes: list[int], percent: int, old: int = 0) -> list[tuple[int, int]]:
    """Links that span those among a group's sets, or only those between the first ``old`` sets and the others.

    Each set is looked up among those before it.  One that has the keys and size of an earlier set has the same links: it isn't looked
    up again if the two link, which their other keys, that no set shares, may prevent.
    """
    ranks, universe = ordered_alike(sets)
    tree, forest, out, known = PrefixTree(percent, universe), Forest(len(ids)), [], {}
    order = np.argsort([len(r) for r in ranks], kind="stable").tolist() if not old else range(len(ids))
    for k in order:
        equal = known.setdefault((k < old, sizes[k], ranks[k].tobytes()), k)
        if equal != k and (100 + percent) * len(ranks[k]) >= 2 * percent * sizes[k]:
            if forest.join(equal, k):
                out.append((ids[equal], ids[k]))
            continue
        if k >= old:
            out += [(ids[j], ids[k]) for j in tree.links(ranks[k], sizes[k]) if forest.join(j, k)]
        if not old or k < old:
            tree.add(k, ranks[k], sizes[k])
    return out


SET_SCHEMA = "pack long, doc_ids binary, known binary, sizes binary, rows binary, row_docs binary, row_sizes binary, keys binary"
KEPT_SCHEMA = "row long, doc_id long, size long, n_keys long, rank long, prefix array<long>, keys binary"
LINK_SCHEMA = "a long, b long"


def copies(table: DataFrame, directory: str) -> DataFrame:
    """pack, row, doc_id, owner, first of documents whose words equal those of another one: the least doc_id and the first row of the group.

    Groups are a finished table before the join, so that Spark can split the rows of a very large one.
    """

    def emit(batches):
        for pdf in batches:
            for p, at, n, ids, known, digests in zip(pdf["pack"], pdf["first_row"], pdf["n_docs"], pdf["doc_ids"], pdf["known"], pdf["digests"], strict=True):
                d = np.frombuffer(digests, "<i8").reshape(-1, 2)
                out = pd.DataFrame({"pack": p, "row": at + np.arange(n), "doc_id": np.frombuffer(ids, "<i8"), "high": d[:, 0], "low": d[:, 1]})
                yield out[np.frombuffer(known, np.uint8).astype(bool) & (d != 0).any(1)]

    rows = table.select("pack", "first_row", "n_docs", "doc_ids", "known", "digests").mapInPandas(emit, "pack long, row long, doc_id long, high long, low long")
    same = rows.groupBy("high", "low").agg(F.min("doc_id").alias("owner"), F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1")
    same = staged(same.drop("n"), directory, "owners")
    return rows.join(same, ["high", "low"]).select("pack", "row", "doc_id", "owner", "first")


def candidate_sets(table: DataFrame, again: DataFrame, rule: JoinRule) -> DataFrame:
    """A row for each pack: the number of keys of each document, and the keys of those of which enough first keys
    occur in another document.  ``again`` (pack, row) has the documents that only repeat another's words."""

    def emit(batches):
        shingler = Shingler(rule.words)
        for pdf in batches:
            for row in pdf.itertuples():
                pack, seen, first = packs.Pack(row), set(), []
                for k, keys in enumerate(shingler.sets(pack.data, pack.starts)):
                    d = row.digests[16 * k : 16 * k + 16]
                    if pack.known[k] and d not in seen:
                        seen.add(d)
                        first.append(keys[: rule.first_keys(len(keys))])
                keys, counts = np.unique(np.concatenate([*first, np.zeros(0, np.uint64)]), return_counts=True)
                yield pd.DataFrame(list(packs.split_keys(pack.id, keys, counts > 1, ranges)), columns=["key_range", "pack", "keys", "twice"])

    def decide(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shingler, out = Shingler(rule.words), []
        shared, gone = packs.keys_of(right[right["keys"].notna()]), right["rows"].dropna()
        gone = np.sort(np.concatenate([np.asarray(x, np.int64) for x in gone])) if len(gone) else np.zeros(0, np.int64)
        for row in left.itertuples():
            pack, sizes, kept, sets = packs.Pack(row), [], [], []
            repeats = packs.member(row.first_row + np.arange(pack.n), gone)
            for k, keys in enumerate(shingler.sets(pack.data, pack.starts)):
                n = len(keys)
                sizes.append(n)
                if n and pack.known[k] and not repeats[k] and np.count_nonzero(packs.member(keys[: rule.first_keys(n)], shared)) >= rule.needed(n):
                    kept.append(k)
                    sets.append(keys)
            sizes, kept = np.asarray(sizes, "<i8"), np.asarray(kept, np.int64)
            out.append((pack.id, row.doc_ids, row.known, sizes.tobytes(), (row.first_row + kept).astype("<i8").tobytes(), pack.doc_ids[kept].tobytes(), sizes[kept].tobytes(), np.concatenate([*sets, np.zeros(0, np.uint64)]).astype("<u8").tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SET_SCHEMA.split(", ")])

    size = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    # A key for about every five bytes of text, and a part of them first.
    share = (100 - rule.percent + rule.slack_percent) / 100
    ranges = packs.ranges_for(size / 5 * share * 8, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = packs.shared_keys(table.mapInPandas(emit, packs.KEY_SCHEMA)).withColumn("rows", F.lit(None).cast("array<long>"))
    drops = again.groupBy("pack").agg(F.collect_list("row").alias("rows")).select("pack", F.lit(None).cast("binary").alias("keys"), "rows")
    return table.groupBy("pack").cogroup(found.unionByName(drops).groupBy("pack")).applyInPandas(decide, SET_SCHEMA)


def _cut(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row numbers, doc_ids, sizes and keys of the sets of a row of SET_SCHEMA."""
    sizes = np.frombuffer(row.row_sizes, "<i8")
    sets = np.split(np.frombuffer(row.keys, "<u8"), np.cumsum(sizes)[:-1]) if len(sizes) else []
    return np.frombuffer(row.rows, "<i8"), np.frombuffer(row.row_docs, "<i8"), sizes, sets


def kept_sets(sets: DataFrame, rule: JoinRule) -> DataFrame:
    """A row for each document of which enough keys are held by another one: those keys in the global order, rarest first.

    prefix: its first keys, of which it shares one with each set that it links to.  rank: how many documents it meets by
    them, with its row number's hash for ties.
    """

    def emit(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                keys, counts = np.unique(np.frombuffer(row.keys, "<u8"), return_counts=True)
                yield pd.DataFrame(list(packs.split_counts(row.pack, keys, counts, ranges)), columns=["key_range", "pack", "keys", "counts"])

    def decide(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = np.concatenate([packs.from_blob(b) for b in right["keys"]]) if len(right) else np.zeros(0, np.uint64)
        counts = np.frombuffer(b"".join(right["counts"]), "<u4").astype(np.int64)
        order, rows = np.argsort(held), []
        held, counts = held[order], counts[order]
        for one in left.itertuples():
            for row, doc_id, n, keys in zip(*_cut(one), strict=True):
                keys = keys[packs.member(keys, held)]
                over = len(keys) - rule.least_overlap(int(n))
                if over < 0:
                    continue
                times = counts[np.searchsorted(held, keys)]
                order = np.lexsort((keys, times))
                keys, prefix = keys[order], keys[order][: over + 1]
                meets = min(int(times[order][: over + 1].sum()), (1 << 22) - 1)
                rank = meets << 40 | int(packs.mix(np.asarray([row], np.uint64))[0] >> np.uint64(24))
                rows.append((row, doc_id, n, len(keys), rank, prefix.view(np.int64), keys.tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in KEPT_SCHEMA.split(", ")])

    size = sets.agg(F.coalesce(F.sum(F.length("keys")), F.lit(0))).first()[0]
    ranges = packs.ranges_for(size, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = sets.select("pack", "keys").filter(F.length("keys") > 0).mapInPandas(emit, packs.COUNT_SCHEMA)
    some = sets.select("pack", "rows", "row_docs", "row_sizes", "keys").filter(F.length("keys") > 0)
    return some.groupBy("pack").cogroup(packs.counted_keys(asked).groupBy("pack")).applyInPandas(decide, KEPT_SCHEMA)


def _group(pdf: pd.DataFrame) -> tuple[list[int], list[np.ndarray], list[int]]:
    return pdf["doc_id"].tolist(), [np.frombuffer(b, "<u8") for b in pdf["keys"]], pdf["size"].tolist()


def links(kept: DataFrame, rule: JoinRule, directory: str) -> DataFrame:
    """a, b: links that connect what the rule connects, from rows of KEPT_SCHEMA."""
    tokens = kept.select("row", "rank", F.explode("prefix").alias("key"))
    centres = tokens.groupBy("key").agg(F.max("rank").alias("centre"), F.count("*").alias("n")).filter("n > 1").select("key", "centre")
    members = tokens.join(centres, "key").select("row", "centre").distinct().join(kept.select("row", "doc_id", "size", "n_keys", "rank"), "row")
    members = staged(members, directory, "members")
    loads = members.groupBy("centre").agg(F.count("*").alias("n"), F.sum("n_keys").alias("load")).filter("n > 1").select("centre", (F.col("load") > rule.group_keys).alias("large"))
    placed = members.join(loads, "centre").withColumn("band", F.when(F.col("large"), F.floor(F.log("size") / rule.band_width())).otherwise(0).cast("int"))
    bands = placed.filter("large").groupBy("centre", "band").agg(F.ceil(F.sum("n_keys") / rule.group_keys).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("row", F.lit(9)), F.col("parts")), F.lit(0)).cast("int").alias("part")
    placed = staged(placed.join(bands, ["centre", "band"], "left").select("centre", "band", part, "large", "row", "doc_id", "rank"), directory, "placed")

    by, sets = ["centre", "band", "part"], kept.select("row", "size", "keys")
    large = placed.filter("large")
    cells = large.select(*by).distinct()
    hubs = large.withColumn("k", F.row_number().over(Window.partitionBy("centre").orderBy(F.desc("rank")))).filter(F.col("k") <= rule.hubs).select("centre", "row", "doc_id")
    everywhere = placed.select(*by, "row", "doc_id").unionByName(hubs.join(cells, "centre").select(*by, "row", "doc_id"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("row")
        return pd.DataFrame(links_among(*_group(pdf), rule.percent) if len(pdf) > 1 else [], columns=["a", "b"]).astype("int64")

    near = staged(everywhere.join(sets, "row").groupBy(*by).applyInPandas(inside, LINK_SCHEMA), directory, "near")
    if large.isEmpty():
        return near

    # Parts of a large centre: documents outside its largest component probe the parts of their band and the next ones.
    comp = components(near, f"{directory}/near-components").withColumnRenamed("node", "doc_id")
    mine = large.join(comp, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    top = mine.groupBy("centre", "component").agg(F.count("*").alias("n")).groupBy("centre").agg(F.max_by("component", F.struct("n", "component")).alias("top"))
    odd = staged(mine.join(top, "centre").filter("component <> top").select("centre", "band", "part", "row", "doc_id"), directory, "odd")
    there = cells.select("centre", F.col("band").alias("to_band"), F.col("part").alias("to_part"))
    other = (F.abs(F.col("band") - F.col("to_band")) <= 1) & ((F.col("band") != F.col("to_band")) | (F.col("part") != F.col("to_part")))
    probes = odd.join(there, "centre").filter(other).select("centre", F.col("to_band").alias("band"), F.col("to_part").alias("part"), "row", "doc_id").join(sets, "row")
    # A part's probes are dealt into blocks, each with a copy of the part.
    blocks = probes.groupBy(*by).agg(F.ceil(F.sum(F.length("keys")) / (8 * rule.group_keys)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("row", F.lit(4)), F.col("blocks")).cast("int").alias("block")
    dealt = probes.join(blocks, by).select(*by, block, "doc_id", "size", "keys")
    held = large.join(blocks, by).select(*by, "row", "doc_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(sets, "row")

    def between(key, group: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        both = pd.concat([group, asking], ignore_index=True)
        found = links_among(*_group(both), rule.percent, len(group)) if len(group) and len(asking) else []
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    far = held.groupBy(*by, "block").cogroup(dealt.groupBy(*by, "block")).applyInPandas(between, LINK_SCHEMA)
    return near.unionByName(staged(far, directory, "far"))


def sizes_of(sets: DataFrame) -> DataFrame:
    """doc_id, n_shingles of every document."""

    def emit(batches):
        for pdf in batches:
            for ids, known, sizes in zip(pdf["doc_ids"], pdf["known"], pdf["sizes"], strict=True):
                out = pd.DataFrame({"doc_id": pd.array(np.frombuffer(ids, "<i8"), "Int64"), "n_shingles": np.frombuffer(sizes, "<i8")})
                out.loc[~np.frombuffer(known, np.uint8).astype(bool), "doc_id"] = pd.NA
                yield out

    return sets.select("doc_ids", "known", "sizes").mapInPandas(emit, "doc_id long, n_shingles long")


def join_digest(docs: DataFrame, rule: JoinRule = JoinRule()) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Documents with equal words are one set before anything is compared.  Null and blank texts have an empty set,
    link with nothing and are their own component; so do rows without doc_id.  Rows that repeat a doc_id get its component, also where
    their texts differ: each text is compared, and all its links are the doc_id's.  Other columns are ignored; an empty table gives no rows.
    """
    spark, directory = docs.sparkSession, shared_dir(docs.sparkSession)
    table = packs.staged_packs(docs, directory, digest=word_digest)
    same = staged(copies(table, directory), directory, "copies")
    sets = staged(candidate_sets(table, same.filter("row <> first").select("pack", "row"), rule), directory, "sets", codec="none")
    counts = staged(sizes_of(sets), directory, "sizes")
    discard(spark, directory, "packs")
    kept = staged(kept_sets(sets, rule), directory, "kept", codec="none")
    discard(spark, directory, "sets")
    found = links(kept, rule, directory).unionByName(same.filter("doc_id <> owner").select(F.col("doc_id").alias("a"), F.col("owner").alias("b")))
    comp = staged(components(found, f"{directory}/components"), directory, "components-done").withColumnRenamed("node", "doc_id")
    discard(spark, directory, "kept", "members", "placed", "odd", "near", "far", "near-components", "components", "copies", "owners")
    return counts.join(comp, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, rule: JoinRule = JoinRule()) -> DataFrame:
    """The documents that are the first of their component, with all columns; rows without doc_id stay, and so does every row of a kept doc_id that repeats."""
    others = join_digest(docs.select("doc_id", "text"), rule).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
