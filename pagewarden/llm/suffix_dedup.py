"""Removal of byte strings that an earlier document holds, by deep-shallow suffix sorting.

Every window of ``length`` bytes has a key: the least hash of the short strings in it.  Windows that are equal have equal
keys, so only windows whose key occurs in two documents can repeat.  Those travel as runs of text (a run holds the
windows in a row that have one key), equal runs of a pack once, to the range of their key.  There the suffixes that
start the windows are sorted: multikey quicksort by 8-byte characters to a shallow depth, then a blind trie for each
group that is still equal.  Windows that end up in one place are equal, and take the smallest doc_id of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import masked
from . import packs
from ._shared import shared_dir, staged

GRAM = 24
SLICE = 1 << 20
NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class DedupRule:
    """length: bytes of a repeated string; shallow: bytes sorted by multikey quicksort before the blind tries; a key of which
    more than ``hot_packs`` packs hold ``many`` texts or more with different surroundings is split by whole windows."""

    length: int = 50
    shallow: int = 32
    hot_packs: int = 128
    many: int = 128


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place."""
    n = len(data) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        word = np.lib.stride_tricks.as_strided(data[k:].view(np.uint8), (n, 8), (1, 1)).copy().view("<u8").ravel()
        out = (out ^ word) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def window_keys(data: np.ndarray, length: int) -> np.ndarray:
    """The key of each window of ``length`` bytes: the least hash of the GRAM-byte strings in it."""
    low, span, have = gram_hashes(data), length - GRAM + 1, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    return low


def runs(pack: packs.Pack, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows in a row with one key: key, first window, number of windows, document; by slices of the pack.

    A run ends at the end of a document, of a slice, or after 64 windows.
    """
    data, starts = np.frombuffer(pack.data, np.uint8), pack.starts
    for at in range(0, max(0, len(data) - length + 1), SLICE):
        part = data[at : at + SLICE + length - 1]
        keys = packs.mix(window_keys(part, length))
        place = np.arange(at, at + len(keys))
        doc = np.searchsorted(starts, place, side="right") - 1
        fits = place + length <= starts[doc + 1]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new & fits)
        if not len(first):
            continue
        # Windows that fit are the first ones of each document, so a run's end is the next run's start or the last fit.
        bounds = np.append(np.flatnonzero(new), len(keys))
        ends = bounds[np.searchsorted(bounds, first, side="right")]
        ends = np.minimum(ends, np.maximum(first + 1, starts[doc[first] + 1] - length + 1 - at))
        size = ends - first
        times = -(-size // 64)
        again = np.repeat(np.arange(len(first)), times)
        step = (np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)) * 64
        yield keys[first][again], place[first][again] + step, np.minimum(size[again] - step, 64), doc[first][again]


def all_runs(pack: packs.Pack, length: int) -> tuple[np.ndarray, ...]:
    parts = list(runs(pack, length))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def distinct_keys(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and whether two documents hold each; ``doc`` never falls."""
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    other = np.zeros(len(keys), bool)
    other[1:] = ~new[1:] & (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(other, at) > 0 if len(at) else np.zeros(0, bool)


def varied_keys(data: bytes, keys: np.ndarray, first: np.ndarray, size: np.ndarray, length: int, many: int) -> np.ndarray:
    """The keys, sorted, whose runs have ``many`` different texts or more, by their first and last bytes: what repeats with its surroundings has few."""
    if not len(keys):
        return keys
    flat = np.frombuffer(data, np.uint8)
    words = np.lib.stride_tricks.as_strided(flat, (len(flat) - 7, 8), (1, 1))
    ends = np.zeros(len(keys), np.uint64)
    for at in (first, first + 8, first + size + length - 17, first + size + length - 9):
        ends = (ends ^ np.ascontiguousarray(words[at]).view("<u8").ravel()) * np.uint64(0x9E3779B97F4A7C15)
        ends ^= ends >> np.uint64(31)
    order = np.lexsort((ends, keys))
    keys, ends = keys[order], ends[order]
    other = np.append(True, (keys[1:] != keys[:-1]) | (ends[1:] != ends[:-1]))
    distinct, counts = np.unique(keys[other], return_counts=True)
    return distinct[counts >= many]


def window_hashes(data: bytes, first: np.ndarray, length: int) -> np.ndarray:
    """A key for each window that depends on all of its bytes."""
    windows, out = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length), np.zeros(len(first), np.uint64)
    for at in range(0, len(first), SLICE // 8):
        part = windows[first[at : at + SLICE // 8]]
        key = np.full(len(part), 0x51_7C_C1_B7_27_22_0A_95, np.uint64)
        for k in [*range(0, length - 7, 8), length - 8]:
            key = (key ^ np.ascontiguousarray(part[:, k : k + 8]).view("<u8").ravel()) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[at : at + len(part)] = packs.mix(key)
    return out


def split_hot(data: bytes, keys, first, size, doc, hot: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs, those with a hot key cut into single windows, each with a key of its own: equal windows still meet, but what stands around a
    string that very many documents hold no longer gathers with it."""
    cut = packs.member(keys, hot)
    if not cut.any():
        return keys, first, size, doc
    n = size[cut]
    each = np.repeat(first[cut], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    rest = ~cut
    return (
        np.concatenate([keys[rest], window_hashes(data, each, length)]), np.concatenate([first[rest], each]),
        np.concatenate([size[rest], np.ones(len(each), size.dtype)]), np.concatenate([doc[rest], np.repeat(doc[cut], n)]),
    )


class Runs:
    """A pack's runs whose keys are shared, and the distinct texts among them in a fixed order."""

    def __init__(self, pack: packs.Pack, shared: np.ndarray, hot: np.ndarray, length: int):
        keys, first, size, doc = all_runs(pack, length)
        keep = packs.member(keys, shared) & pack.known[doc]
        keys, self.first, self.size, self.doc = split_hot(pack.data, keys[keep], first[keep], size[keep], doc[keep], hot, length)
        data, index, self.of, owner = pack.data, {}, np.zeros(len(keys), np.int64), []
        texts: list[tuple[int, bytes]] = []
        ids = pack.doc_ids[self.doc].tolist()
        for k, (key, a, n, i) in enumerate(zip(keys.tolist(), self.first.tolist(), self.size.tolist(), ids, strict=True)):
            text = data[a : a + n + length - 1]
            at = index.setdefault((key, text), len(texts))
            if at == len(texts):
                texts.append((key, text))
                owner.append(i)
            elif i < owner[at]:
                owner[at] = i
            self.of[k] = at
        order = sorted(range(len(texts)), key=lambda t: texts[t])
        back = np.empty(len(texts), np.int64)
        back[order] = np.arange(len(texts))
        self.of = back[self.of]
        self.keys = np.asarray([texts[t][0] for t in order], np.uint64)
        self.texts = [texts[t][1] for t in order]
        self.owner = np.asarray([owner[t] for t in order], np.int64)


# --- deep-shallow sorting -------------------------------------------------------------------------------------------


def multikey_groups(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes within their groups to ``depth`` bytes and, in that order, the refined group of each.

    Multikey quicksort with characters of 8 bytes: each round sorts only the suffixes whose group still has several, by
    their next character, and splits the groups where it differs.
    """
    order = np.argsort(group, kind="stable")
    group = group[order]
    for at in range(0, depth, 8):
        open_ = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        open_[1:] |= same
        open_[:-1] |= same
        spots = np.flatnonzero(open_)
        if not len(spots):
            break
        items = order[spots]
        base = starts[items] + at
        char = np.zeros(len(items), np.uint64)
        for k in range(8):
            char = char << np.uint64(8) | data[base + k]
        sort = np.lexsort((char, group[spots]))
        order[spots] = items[sort]
        inner, char = group[spots], char[sort]
        split = np.zeros(len(order), np.int64)
        split[spots[1:]] = (inner[1:] == inner[:-1]) & (char[1:] != char[:-1])
        edge = np.zeros(len(order), np.int64)
        edge[1:] = group[1:] != group[:-1]
        group = np.cumsum(edge | split)
    return order, group


class BlindTrie:
    """A Patricia trie of equally long strings: nodes hold only the place of a branching byte, leaves a string.

    A string goes down blindly by its branching bytes to some leaf, is compared with that leaf once, and is put
    in where they part.  Leaves in order of the trie are the strings in order.
    """

    __slots__ = ("data", "length", "root")

    def __init__(self, data: bytes, length: int):
        self.data, self.length, self.root = data, length, None

    def add(self, start: int, item: int) -> None:
        data, n = self.data, self.length
        if self.root is None:
            self.root = [start, [item]]
            return
        node = self.root
        while len(node) == 3:  # [place, children, any start below]
            node = node[1].get(data[start + node[0]]) or node
            if len(node) == 3 and data[start + node[0]] not in node[1]:
                break
        other = node[0] if len(node) == 2 else node[2]
        a, b = data[start : start + n], data[other : other + n]
        if a == b:
            node[1].append(item)
            return
        lo, hi = 0, n  # bytes before lo are equal
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if a[lo:mid] == b[lo:mid]:
                lo = mid
            else:
                hi = mid
        place, leaf, node, above = lo, [start, [item]], self.root, None
        while len(node) == 3 and node[0] < place:
            above, node = node, node[1][data[start + node[0]]]
        if len(node) == 3 and node[0] == place:
            node[1][data[start + place]] = leaf
            return
        new = [place, {b[place]: node, a[place]: leaf}, other]
        if above is None:
            self.root = new
        else:
            above[1][data[start + above[0]]] = new

    def leaves(self) -> Iterator[list[int]]:
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 2:
                yield node[1]
            else:
                stack += [c for _, c in sorted(node[1].items(), reverse=True)]


def least_owner(keys: np.ndarray, texts: list[bytes], owners: np.ndarray, rule: DedupRule) -> list[np.ndarray]:
    """For each run and each of its windows, the smallest owner of any run that has the same window."""
    flat, start = least_windows(keys, texts, owners, rule)
    return np.split(flat, start[1:-1]) if len(texts) else []


def least_windows(keys: np.ndarray, texts: list[bytes], owners: np.ndarray, rule: DedupRule) -> tuple[np.ndarray, np.ndarray]:
    """The same for all runs' windows in a row, and where each run's windows start, with the end.

    Runs must be distinct by (key, text).  Runs that are alone with their key need no sorting.
    """
    n = rule.length
    sizes = np.asarray([len(t) for t in texts], np.int64) - n + 1
    out_start = np.concatenate([[0], np.cumsum(sizes)])
    out = np.repeat(owners, sizes)
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    several = np.flatnonzero(counts[back] > 1)
    if len(several):
        joined = b"".join([texts[k] for k in several])
        data = np.frombuffer(joined, np.uint8)
        lengths = sizes[several] + n - 1
        base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        run = np.repeat(np.arange(len(several)), sizes[several])
        inner = np.arange(len(run)) - np.repeat(np.cumsum(sizes[several]) - sizes[several], sizes[several])
        starts = base[run] + inner
        order, group = multikey_groups(data, starts, back[several][run], rule.shallow)
        owner = owners[several][run]
        spot = out_start[several][run] + inner
        edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = np.append(edges[1:], len(group))
        for a, b in zip(edges[ends - edges > 1].tolist(), ends[ends - edges > 1].tolist(), strict=True):
            trie, items = BlindTrie(joined, n), order[a:b].tolist()
            for i in items:
                trie.add(int(starts[i]), i)
            for same in trie.leaves():
                if len(same) > 1:
                    out[spot[same]] = owner[same].min()
    return out, out_start


# --- the jobs -------------------------------------------------------------------------------------------------------

RUN_SCHEMA = "key_range int, pack long, n_runs long, keys binary, owners binary, sizes binary, texts binary"
BACK_SCHEMA = "key_range int, pack long, n_runs long, least binary"
SPAN_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _packed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def removed_bytes(runs_: Runs, flat: np.ndarray, sizes: np.ndarray, pack: packs.Pack, length: int) -> np.ndarray:
    """Marks the bytes of a pack that a window covers which an earlier document has; ``flat`` has the least owners of the windows of each
    distinct text, ``sizes`` how many windows each has."""
    edge = np.zeros(len(pack.data) + 1, np.int32)
    if len(runs_.of):
        at = np.cumsum(sizes) - sizes
        n = runs_.size
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hit = flat[np.repeat(at[runs_.of], n) + inner] < np.repeat(pack.doc_ids[runs_.doc], n)
        place = (np.repeat(runs_.first, n) + inner)[hit]
        np.add.at(edge, place, 1)
        np.add.at(edge, place + length, -1)
    return np.cumsum(edge[:-1]) > 0


def marks(table: DataFrame, rule: DedupRule, finish, schema: str) -> DataFrame:
    """``finish(pack, removed)`` rows for each pack of ``table``; ``removed`` marks the pack's bytes that go."""
    n = rule.length

    def keys_out(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                pack = packs.Pack(row)
                keys, first, size, doc = all_runs(pack, n)
                known = pack.known[doc]
                distinct, twice = distinct_keys(keys[known], doc[known])
                many = packs.member(distinct, varied_keys(pack.data, keys[known], first[known], size[known], n, rule.many))
                yield pd.DataFrame(list(packs.split_marks(pack.id, distinct, twice, many, ranges)), columns=["key_range", "pack", "keys", "twice", "many"])

    def runs_out(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows, shared, hot = [], packs.keys_of(right), packs.hot_keys_of(right)
        for row in left.itertuples():
            pack = packs.Pack(row)
            r = Runs(pack, shared, hot, n) if len(shared) else None
            held, cuts = packs.range_cuts(r.keys, ranges) if r else ([], [0])
            for k, a, b in zip(held, cuts[:-1], cuts[1:], strict=True):
                sizes = np.asarray([len(t) for t in r.texts[a:b]], "<i4").tobytes()
                rows.append((k, pack.id, b - a, packs.to_blob(r.keys[a:b]), r.owner[a:b].astype("<i8").tobytes(), sizes, _packed(b"".join(r.texts[a:b]))))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RUN_SCHEMA.split(", ")])

    def sort_range(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, owners, texts, cuts = [], [], [], [0]
        for row in pdf.itertuples():
            body, sizes = _unpacked(row.texts), np.frombuffer(row.sizes, "<i4")
            ends = np.cumsum(sizes)
            texts += [body[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            keys.append(packs.from_blob(row.keys))
            owners.append(np.frombuffer(row.owners, "<i8"))
            cuts.append(len(texts))
        keys, owners, index, of, first, low = np.concatenate(keys), np.concatenate(owners), {}, [], [], []
        for k, (key, text, owner) in enumerate(zip(keys.tolist(), texts, owners.tolist(), strict=True)):
            at = index.setdefault((key, text), len(first))
            if at == len(first):
                first.append(k)
                low.append(owner)
            elif owner < low[at]:
                low[at] = owner
            of.append(at)
        least, start = least_windows(keys[first], [texts[k] for k in first], np.asarray(low, np.int64), rule)
        of, rows = np.asarray(of, np.int64), []
        for row, a, b in zip(pdf.itertuples(), cuts[:-1], cuts[1:], strict=True):
            sizes = start[of[a:b] + 1] - start[of[a:b]]
            place = np.repeat(start[of[a:b]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            rows.append((row.key_range, row.pack, row.n_runs, _packed(least[place].astype("<i8").tobytes())))
        return pd.DataFrame(rows, columns=["key_range", "pack", "n_runs", "least"])

    def apply(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        own = right[right["keys"].notna()]
        shared, hot = packs.keys_of(own), packs.hot_keys_of(own)
        answers = right[right["least"].notna()].sort_values("key_range")
        for row in left.itertuples():
            pack = packs.Pack(row)
            gone = np.zeros(len(pack.data), bool)
            if len(answers):
                r = Runs(pack, shared, hot, n)
                flat = np.frombuffer(b"".join(_unpacked(x) for x in answers["least"]), "<i8")
                sizes = np.asarray([len(t) - n + 1 for t in r.texts], np.int64)
                gone = removed_bytes(r, flat, sizes, pack, n)
            out.append(finish(pack, gone))
        return pd.concat(out, ignore_index=True)

    spark = table.sparkSession
    size = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    ranges = packs.ranges_for(size / ((n - GRAM + 2) / 2) * 8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = staged(packs.shared_keys(table.mapInPandas(keys_out, packs.MANY_SCHEMA), rule.hot_packs), table_dir(table), "shared", codec="lz4")
    sent = table.groupBy("pack").cogroup(shared.groupBy("pack")).applyInPandas(runs_out, RUN_SCHEMA)
    back = sent.groupBy("key_range").applyInPandas(sort_range, BACK_SCHEMA)
    answers = back.select("pack", "key_range", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("hot"), "least").unionByName(shared.select("pack", F.lit(None).cast("int").alias("key_range"), "keys", "hot", F.lit(None).cast("binary").alias("least")))
    return table.groupBy("pack").cogroup(answers.groupBy("pack")).applyInPandas(apply, schema)


def table_dir(table: DataFrame) -> str:
    return f"{shared_dir(table.sparkSession)}"


def _digest(pack: packs.Pack, gone: np.ndarray) -> pd.DataFrame:
    rows, data = [], np.frombuffer(pack.data, np.uint8)
    for a, b in zip(pack.starts[:-1].tolist(), pack.starts[1:].tolist(), strict=True):
        cut, part = gone[a:b], data[a:b]
        n = int(cut.sum())
        spans = int((cut[1:] & ~cut[:-1]).sum() + cut[0]) if n else 0
        rows.append((b - a, n, spans, hashlib.sha256((part[~cut] if n else part).tobytes()).hexdigest()))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in SPAN_SCHEMA.split(", ")][1:])
    out.insert(0, "doc_id", masked(pack.doc_ids, pack.known))
    return out


def _spans(pack: packs.Pack, gone: np.ndarray) -> pd.DataFrame:
    rows, data = [], np.frombuffer(pack.data, np.uint8)
    for a, b in zip(pack.starts[:-1].tolist(), pack.starts[1:].tolist(), strict=True):
        cut = np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))
        spans = [[x, y] for x, y in zip(np.flatnonzero(cut == 1).tolist(), np.flatnonzero(cut == -1).tolist(), strict=True)]
        rows.append((data[a:b][~gone[a:b]].tobytes(), spans))
    out = pd.DataFrame(rows, columns=["kept", "spans"])
    out.insert(0, "doc_id", masked(pack.doc_ids, pack.known))
    return out


def dedup_digest(docs: DataFrame, rule: DedupRule = DedupRule()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text).

    Null text is empty.  A row without doc_id removes nothing and loses nothing.  Rows with one doc_id are one document for
    the comparison: neither is smaller.  Texts shorter than the length stay whole.  Other columns are ignored.
    """
    table = packs.staged_packs(docs, shared_dir(docs.sparkSession))
    return marks(table, rule, _digest, SPAN_SCHEMA)


def dedup(docs: DataFrame, rule: DedupRule = DedupRule()) -> DataFrame:
    """doc_id, the bytes kept, and the spans removed ([start, end) in bytes) for every row of ``docs``."""
    table = packs.staged_packs(docs, shared_dir(docs.sparkSession))
    return marks(table, rule, _spans, "doc_id long, kept binary, spans array<array<long>>")
