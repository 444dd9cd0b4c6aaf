"""Packs of documents, and the keys of packs that more than one document holds.

A pack is a row with a few megabytes of compressed texts.  Keys are 64-bit hashes that travel as sorted binary
blobs, one for each pack and key range, so a key that very many documents share costs 8 bytes a pack, and
no task ever holds more than a key range, whose number follows the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import exact, ids_of
from ._shared import staged

PACK_BYTES = 2 << 20
#: Mean bytes of keys in a range.
RANGE_BYTES = 8 << 20
PACK_SCHEMA = "pack long, n_docs long, n_bytes long, first_row long, doc_ids binary, known binary, lengths binary, digests binary, body binary"
KEY_SCHEMA = "key_range int, pack long, keys binary, twice binary"
MANY_SCHEMA = f"{KEY_SCHEMA}, many binary"
SHARED_SCHEMA = "pack long, keys binary"
MARKED_SCHEMA = "pack long, keys binary, hot binary"
COUNT_SCHEMA = "key_range int, pack long, keys binary, counts binary"
COUNTED_SCHEMA = "pack long, keys binary, counts binary"


def staged_packs(docs: DataFrame, directory: str, pack_bytes: int = PACK_BYTES, digest: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """A table of packs in the shared folder, written by one narrow pass over ``docs`` (doc_id, text).

    Null texts are empty; null doc_ids are marked as unknown.  A text longer than a pack is a pack of its own.  ``digest``
    gives 16 bytes of each text, kept beside the texts.  A row's number (``first_row`` and its place in the pack) is its own.
    """

    def pack(batches):
        import zstandard
        from pyspark import TaskContext

        codec, base, seq = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        ids, texts, size, row_number = [], [], 0, base << 40

        def close():
            nonlocal ids, texts, size, seq, row_number
            row = ((base << 32) + seq, len(ids), size, row_number, np.asarray([0 if i is None else i for i in ids], "<i8").tobytes(), np.asarray([i is not None for i in ids], np.uint8).tobytes(), np.asarray([len(t) for t in texts], "<i8").tobytes(), b"".join(map(digest, texts)) if digest else b"", codec.compress(b"".join(texts)))
            ids, texts, size, seq, row_number = [], [], 0, seq + 1, row_number + len(ids)
            return pd.DataFrame([row], columns=[c.split()[0] for c in PACK_SCHEMA.split(", ")])

        for pdf in batches:
            for i, text in zip(ids_of(pdf, "doc_id"), pdf["text"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if ids and size + len(data) > pack_bytes:
                    yield close()
                ids.append(None if pd.isna(i) else int(i))
                texts.append(data)
                size += len(data)
        if ids:
            yield close()

    rows = docs.select(*exact("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return staged(rows.mapInPandas(pack, PACK_SCHEMA), directory, "packs", codec="none")


class Pack:
    """One pack's documents."""

    def __init__(self, row):
        import zstandard

        self.id, self.n = int(row.pack), int(row.n_docs)
        self.doc_ids, self.known = np.frombuffer(row.doc_ids, "<i8"), np.frombuffer(row.known, np.uint8).astype(bool)
        self.lengths = np.frombuffer(row.lengths, "<i8")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = zstandard.ZstdDecompressor().decompress(row.body, max_output_size=max(1, int(row.n_bytes)))

    def texts(self) -> Iterator[bytes]:
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            yield self.data[a:b]


def mix(keys: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose high bits depend on all others."""
    k = keys.astype(np.uint64)
    k ^= k >> np.uint64(32)
    k *= np.uint64(0xD6E8FEB86659FD93)
    k ^= k >> np.uint64(32)
    k *= np.uint64(0xD6E8FEB86659FD93)
    return k ^ (k >> np.uint64(32))


def to_blob(keys: np.ndarray) -> bytes:
    """Sorted keys by byte planes: the high planes change slowly and compress well in the shuffle."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_blob(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def ranges_for(n_keys_bytes: float, least: int) -> int:
    """How many key ranges the input needs."""
    return max(least, int(n_keys_bytes / RANGE_BYTES) + 1)


def range_cuts(keys: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """The key ranges (of ``n``) that sorted keys fall in, and where each of them starts, with the end: work by keys, not by ranges."""
    if not len(keys):
        return [], [0]
    high, low = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    at = (high * np.uint64(n) + (low * np.uint64(n) >> np.uint64(32))) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first].tolist(), [*first.tolist(), len(keys)]


def split_keys(pack: int, keys: np.ndarray, twice: np.ndarray, n: int) -> Iterator[tuple]:
    """Rows of KEY_SCHEMA from a pack's sorted distinct keys; ``twice`` marks those in two of its documents."""
    ranges, cuts = range_cuts(keys, n)
    for k, a, b in zip(ranges, cuts[:-1], cuts[1:], strict=True):
        yield k, pack, to_blob(keys[a:b]), np.packbits(twice[a:b]).tobytes()


def split_marks(pack: int, keys: np.ndarray, twice: np.ndarray, many: np.ndarray, n: int) -> Iterator[tuple]:
    """Rows of MANY_SCHEMA: the same with a second mark for each key."""
    ranges, cuts = range_cuts(keys, n)
    for k, a, b in zip(ranges, cuts[:-1], cuts[1:], strict=True):
        yield k, pack, to_blob(keys[a:b]), np.packbits(twice[a:b]).tobytes(), np.packbits(many[a:b]).tobytes()


def split_counts(pack: int, keys: np.ndarray, counts: np.ndarray, n: int) -> Iterator[tuple]:
    """Rows of COUNT_SCHEMA from a pack's sorted distinct keys and the number of its documents that hold each."""
    ranges, cuts = range_cuts(keys, n)
    for k, a, b in zip(ranges, cuts[:-1], cuts[1:], strict=True):
        yield k, pack, to_blob(keys[a:b]), counts[a:b].astype("<u4").tobytes()


def shared_keys(rows: DataFrame, hot_packs: int | None = None) -> DataFrame:
    """For each pack and range, the keys that at least two documents hold, from rows of KEY_SCHEMA; with ``hot_packs``, also which of them
    more packs than that have marked as ``many`` (``hot``, a bit a key), from rows of MANY_SCHEMA."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [from_blob(b) for b in pdf["keys"]]
        twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(p)).astype(bool) for t, p in zip(pdf["twice"], parts, strict=True)]
        keys = np.sort(np.concatenate(parts))
        again = keys[1:][keys[1:] == keys[:-1]]
        marked = [p[t] for p, t in zip(parts, twice, strict=True)]
        shared = np.unique(np.concatenate([again, *marked]))
        out = [(i, p[np.isin(p, shared, assume_unique=True)]) for i, p in zip(pdf["pack"], parts, strict=True)] if len(shared) else []
        out = [(i, p) for i, p in out if len(p)]
        if hot_packs is None:
            return pd.DataFrame([(i, to_blob(p)) for i, p in out], columns=["pack", "keys"])
        found = np.sort(np.concatenate([p[np.unpackbits(np.frombuffer(m, np.uint8), count=len(p)).astype(bool)] for m, p in zip(pdf["many"], parts, strict=True)]))
        # A key that n packs have marked stands n times in a row.
        often = np.unique(found[hot_packs:][found[hot_packs:] == found[: len(found) - hot_packs]]) if len(found) > hot_packs else found[:0]
        return pd.DataFrame([(i, to_blob(p), np.packbits(member(p, often)).tobytes()) for i, p in out], columns=["pack", "keys", "hot"])

    return rows.groupBy("key_range").applyInPandas(find, SHARED_SCHEMA if hot_packs is None else MARKED_SCHEMA)


def counted_keys(rows: DataFrame) -> DataFrame:
    """For each pack and range, its keys that at least two documents hold and in how many, from rows of COUNT_SCHEMA."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, counts = [from_blob(b) for b in pdf["keys"]], [np.frombuffer(c, "<u4") for c in pdf["counts"]]
        keys, back = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(back.ravel(), np.concatenate(counts), len(keys)).astype(np.int64)
        out = []
        for i, p in zip(pdf["pack"], parts, strict=True):
            n = total[np.searchsorted(keys, p)]
            if (n > 1).any():
                out.append((i, to_blob(p[n > 1]), np.minimum(n[n > 1], 0xFFFFFFFF).astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["pack", "keys", "counts"])

    return rows.groupBy("key_range").applyInPandas(find, COUNTED_SCHEMA)


def keys_of(pdf: pd.DataFrame) -> np.ndarray:
    """The sorted keys of all of a pack's answers."""
    return np.sort(np.concatenate([from_blob(b) for b in pdf["keys"]])) if len(pdf) else np.zeros(0, np.uint64)


def hot_keys_of(pdf: pd.DataFrame) -> np.ndarray:
    """Those of a pack's keys that ``shared_keys`` marked, sorted."""
    keys = [from_blob(b) for b in pdf["keys"]]
    return np.sort(np.concatenate([k[np.unpackbits(np.frombuffer(h, np.uint8), count=len(k)).astype(bool)] for k, h in zip(keys, pdf["hot"], strict=True)])) if len(pdf) else np.zeros(0, np.uint64)


def member(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(of, keys)
    return of[np.minimum(at, len(of) - 1)] == keys
