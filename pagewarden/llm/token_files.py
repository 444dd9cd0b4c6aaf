"""Token ids in directly addressable code files.

Each id is cut into 8-bit chunks.  Level k holds the k-th chunk of every id that has one, a bitmap says
which of them continue on the next level, and a rank directory counts the set bits before each 512-bit
block, so the chunks of any token are found by two additions a level and no block is decoded.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import exact, ids_of
from ._shared import dealt, reading, shared_dir, staged, writing

# Fixed values of the file format.
MAGIC = b"DACTOK01"
BLOCK_BITS = 512

END_ID = 2
FILE_TOKENS = 4_000_000
#: Tokens of documents that are read back at once.
STEP_TOKENS = 1 << 18
CACHE_WORDS = 600_000
MANIFEST_SCHEMA = "path string, first_doc long, n_docs long, n_tokens long, part int, seq int"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, path string"


#: A space before another white-space character, or at the end of a text: there a cut at each space is not a cut between words.
ODD_SPACE = re.compile(r" (?=\s|$)")
#: A non-space character before a space and another non-space character.
CUT = re.compile(r"\S(?= \S)")
#: What a word is made of where its parts are plain: each part is pre-tokenised alone.  Others are encoded whole.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
SIGNS = r"!-&(-/:-@\[-`{-~"
RUN = rf" ?[{LETTERS}]++|[0-9]++|[{SIGNS}]++|\n(?!\n)"
#: Signs are those of ASCII but the apostrophe, which may begin a contraction.
#: A word without its space; one that begins with a digit or a sign would take the space into that run.
PLAIN_WORD = re.compile(rf"(?=[{LETTERS}])(?:{RUN[2:]}){{1,20}}")
#: Between the words that are cut together: a character that no plain word has, and 32 bits that are no id.
MARK, MARK_IDS = "\x01", b"\xff" * 4
RUNS = re.compile(f"{RUN}|{MARK}")


class WordCache(dict):
    """Ids of a word with the space before it, as little-endian unsigned 32-bit bytes, by the word without that space.

    Byte-level pre-tokenising starts a new word at every space before a non-space character, and merges do
    not cross words, so a text's ids are those of its words.  A new word is cut further into runs of letters, digits and
    punctuation, which are pre-tokens of their own; only new runs are merged by the library.
    Both tables are emptied when they are full.
    """

    def __init__(self, tokenizer, limit: int = CACHE_WORDS):
        super().__init__()
        self.tokenizer, self.model, self.limit, self.parts = tokenizer, tokenizer.model, limit, {}
        self.specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        #: The library's own letters for the bytes of each character of a plain run.
        self.letters = {c: "".join(x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))) for c in range(256) if c in b" \n" or PLAIN_WORD.fullmatch("a" + chr(c))}

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, words: set[str]) -> None:
        """Ids of new words.  A plain run is one pre-token, so the library's model alone has to merge it."""
        if len(self.parts) > self.limit:
            self.parts.clear()
        parts, tokenize, plain = self.parts, self.model.tokenize, [w for w in words if PLAIN_WORD.fullmatch(w)]
        if plain:
            parts[MARK] = MARK_IDS
            runs = RUNS.findall(" " + f"{MARK} ".join(plain))
            new = list(set(runs) - parts.keys())
            letters = MARK.join(new).translate(self.letters).split(MARK) if new else []
            parts.update(zip(new, [array("I", [t.id for t in tokenize(x)]).tobytes() for x in letters], strict=True))
            self.update(zip(plain, b"".join(map(parts.__getitem__, runs)).split(MARK_IDS), strict=True))
        for w in words.difference(plain):
            self[w] = self.encode(" " + w)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        cut, heads, new = {}, {}, set()
        for k, text in enumerate(texts):
            if ODD_SPACE.search(text) is not None or any(s in text for s in self.specials):
                out[k] = self.odd(text)
            elif text:
                words = cut[k] = text.split(" ")
                heads[k] = words.pop(0)
                new.update(words)
        if len(self) > self.limit:
            self.clear()
        new -= self.keys()
        self.learn(new)
        for k, words in cut.items():
            out[k] = self.head(heads[k]) + b"".join(map(self.__getitem__, words))
        for w in new:
            if len(w) >= 64:
                del self[w]
        return out

    def head(self, word: str) -> bytes:
        """Ids of a text's first word, which has no space before it."""
        return self.encode(word) if word else b""

    def odd(self, text: str) -> bytes:
        """Ids of a text with runs of spaces or special tokens, cut before each space that a non-space character follows."""
        return b"".join(map(self.encode, whole_segments(text))) if len(text) > 1 << 16 else self.encode(text)


def whole_segments(text: str, size: int = 1 << 14) -> Iterator[str]:
    """Long texts in pieces of about ``size`` characters, cut before a space that stands between two non-space characters."""
    at = 0
    while at < len(text):
        cut = CUT.search(text, at + size)
        end = cut.start() + 1 if cut else len(text)
        yield text[at:end]
        at = end


_caches: dict[str, WordCache] = {}


def segment_cache(path: str) -> WordCache:
    """One tokenizer and cache for each worker process."""
    if path not in _caches:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _caches[path] = WordCache(Tokenizer.from_file(path))
    return _caches[path]


def pack(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """The file's bytes.  ``starts`` has each document's first token and, at its end, the number of tokens."""
    levels, parts, at = [], [], 0

    def put(a: np.ndarray) -> int:
        nonlocal at
        parts.append(a.tobytes())
        at += len(parts[-1])
        return at - len(parts[-1])

    docs = {"n": len(doc_ids), "ids": put(doc_ids.astype("<i8")), "starts": put(starts.astype("<i8"))}
    value = ids.astype("<u4")
    while len(value):
        more = value > 255
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK_BITS), dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4")
        levels.append({"n": len(value), "chunks": put((value & 255).astype(np.uint8)), "bits": put(bits), "ranks": put(ranks)})
        value = value[more] >> 8
    head = json.dumps({"n_tokens": len(ids), "levels": levels, "docs": docs}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


class TokenFile:
    """Reads a file by ranges: the header, then for any tokens only their chunks, continuation bits and one rank a level.

    ``source`` is an open file with ``read_at(bytes, offset)``.
    """

    def __init__(self, source):
        start = source.read_at(12, 0)
        if start[:8] != MAGIC:
            raise ValueError("not a token file")
        n = struct.unpack_from("<I", start, 8)[0]
        self.source, self.head, self.base = source, json.loads(source.read_at(n, 12)), 12 + n
        self.n_tokens, d = self.head["n_tokens"], self.head["docs"]
        self.doc_ids, self.starts = self._read("<i8", d["ids"], 0, d["n"]), self._read("<i8", d["starts"], 0, d["n"] + 1)

    def _read(self, kind: str, place: int, a: int, b: int) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.frombuffer(self.source.read_at(width * (b - a), self.base + place + width * a), kind)

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids of tokens a up to b.  On each level the tokens that go on are found from the rank of the first one's block."""
        levels = []
        for level in self.head["levels"]:
            if a >= b:
                break
            block = a // BLOCK_BITS
            first = block * BLOCK_BITS
            bits = np.unpackbits(self._read("u1", level["bits"], first >> 3, (b + 7) >> 3), bitorder="little")
            more = bits[a - first : b - first].astype(bool)
            levels.append((self._read("u1", level["chunks"], a, b), more))
            a = int(self._read("<u4", level["ranks"], block, block + 1)[0]) + int(bits[: a - first].sum())
            b = a + int(more.sum())
        above = np.zeros(0, "<u4")
        for chunks, more in reversed(levels):
            value = chunks.astype("<u4")
            value[more] |= above << 8
            above = value
        return above

    def token(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


def write_token_files(docs: DataFrame, directory: str, tokenizer: str, *, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write files in ascending doc_id order; returns the manifest of files.

    Documents are range-partitioned by doc_id, each partition writes its own files and holds one file's ids
    at a time.  Null text is empty (its only id is the end id); null doc_ids come first; repeated rows are
    documents of their own; other columns are ignored.
    """

    def write(batches):
        from pyspark import TaskContext

        cache, part, seq = segment_cache(tokenizer), TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], "<u4").tobytes()
        held, doc_ids, filled = [], [], 0

        def close():
            nonlocal held, doc_ids, filled, seq
            lengths = np.asarray([len(x) // 4 for x in held], np.int64)
            known = np.asarray([np.iinfo(np.int64).min if d is None else d for d in doc_ids], np.int64)
            path = f"{directory}/{uuid.uuid4().hex}.dac"
            with writing(path) as out:
                out.write(pack(np.frombuffer(b"".join(held), "<u4"), known, np.concatenate([[0], np.cumsum(lengths)])))
            row = pd.DataFrame([(path, doc_ids[0], len(held), int(lengths.sum()), part, seq)], columns=["path", "first_doc", "n_docs", "n_tokens", "part", "seq"])
            row["first_doc"] = row["first_doc"].astype("Int64")
            held, doc_ids, filled, seq = [], [], 0, seq + 1
            return row

        for pdf in batches:
            texts, batch_ids = pdf["text"].tolist(), ids_of(pdf, "doc_id")
            for k in range(0, len(texts), 500):
                for doc_id, ids in zip(batch_ids[k : k + 500], cache.ids(texts[k : k + 500]), strict=True):
                    held.append(ids + end)
                    doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                    filled += len(held[-1]) // 4
                    if filled >= file_tokens:
                        yield close()
        if held:
            yield close()

    rows = docs.select(*exact("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # Rows without doc_id, and those that repeat one, are spread over ranges of a hash.
    order = ["doc_id_known", "doc_id", F.xxhash64("text")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInPandas(write, MANIFEST_SCHEMA)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """A row for each stored document of the files that ``manifest`` names (path, and base: the tokens of all files before, 0 where it has none), from
    its file alone: start, length and CRC-32 of its ids."""
    missing = np.iinfo(np.int64).min

    def read(batches):
        for pdf in batches:
            for path, base in zip(pdf["path"], pdf["base"], strict=True):
                with reading(path) as source:
                    file = TokenFile(source)
                    starts = file.starts
                    # Documents in steps of about STEP_TOKENS, each step addressed through the rank directories.
                    steps = np.unique(np.searchsorted(starts, np.arange(0, file.n_tokens + STEP_TOKENS, STEP_TOKENS), side="left"))
                    crc = []
                    for x, y in zip(steps[:-1].tolist(), np.minimum(steps[1:], len(starts) - 1).tolist(), strict=True):
                        data, at = memoryview(file.slice(int(starts[x]), int(starts[y])).tobytes()), (4 * (starts[x : y + 1] - starts[x])).tolist()
                        crc += [zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                out = pd.DataFrame({"doc_id": pd.array(file.doc_ids, "Int64"), "start": starts[:-1] + int(base), "n_tokens": np.diff(starts), "ids_crc32": crc, "path": path})
                out.loc[out["doc_id"] == missing, "doc_id"] = pd.NA
                yield out

    base = F.col("base") if "base" in manifest.columns else F.lit(0).cast("long").alias("base")
    return dealt(manifest.select("path", base)).mapInPandas(read, READ_SCHEMA)


def token_digest(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the token files in the shared folder, read them back, and place each document in the whole.

    The running sum is over the manifest: one small row for each file of millions of tokens.  Null texts are only the end id, nulls among
    doc_ids come first, rows that repeat a doc_id are documents of their own in the order of their texts' hashes; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    directory = shared_dir(spark)
    manifest = staged(write_token_files(docs, f"{directory}/tokens", tokenizer, **options), directory, "manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return read_token_files(placed).select("doc_id", "start", "n_tokens", "ids_crc32")
