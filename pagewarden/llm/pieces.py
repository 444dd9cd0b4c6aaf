"""SentencePiece encoding that keeps source positions, and decoding.

Texts are normalised by the model's own compiled character map: at each position the longest key of its
double-array trie that is a prefix of the rest is replaced, other characters stay, and the source bytes
that each normalised byte came from are recorded.  Pieces are then projected to spans of original bytes.
"""

from __future__ import annotations

import hashlib
import struct
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import exact, ids_of

SPACE = "▁"
CACHE_WORDS = 400_000
#: Characters of texts whose pieces a task holds at once; a longer text is alone.
STEP_CHARS = 1 << 20
PIECES_SCHEMA = "doc_id long, ids array<int>, starts array<long>, ends array<long>"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_ok boolean, ids array<int>"


class CharsMap:
    """The compiled character map: a double-array trie over UTF-8 keys, then replacements ended by zero bytes."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if n else []
        self.values = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Length of the longest key at ``at`` and its replacement's place; 0 if there is none."""
        units, best = self.units, (0, 0)
        if not units:
            return best
        node = _offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                best = (k + 1 - at, units[node] & 0x7FFFFFFF)
        return best

    def replacement(self, at: int) -> bytes:
        return self.values[at : self.values.index(b"\0", at)]


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class Model:
    """One model in a worker process: normaliser, library processor and a bounded cache of segments."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.map = CharsMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        # Merges can't cross the start of a run of spaces if no piece has a space mark after another character.
        self.splits = all(set(p.piece) == {SPACE} or SPACE not in p.piece[1:] for p in proto.pieces) and not proto.trainer_spec.treat_whitespace_as_suffix
        self.simple = not self.map.units and self.dummy and not self.squeeze and self.splits
        #: Normalised bytes of each piece.
        self.widths = np.asarray([1 if p.type == p.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.words: dict[str, tuple] = {}

    def normalised(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and for the end, its place in the source bytes."""
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        units: list[tuple[bytes, int]] = []
        at = 0
        while at < len(data):
            n, value = self.map.longest(data, at)
            if n:
                units.append((self.map.replacement(value), at))
            else:
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                units.append((data[at : at + n], at))
            at += n
        end = len(data)
        if self.squeeze:
            while units and units[0][0] in (b" ", b""):
                units.pop(0)
            while units and units[-1][0].rstrip(b" ") == b"":
                end = units.pop()[1]
        mark, out, places, blank = SPACE.encode(), bytearray(), [], False
        if self.dummy and units:
            out += mark
            places += [units[0][1]] * len(mark)
            blank = True
        for piece, place in units:
            for c in _chars(piece):
                space = c == b" "
                if space and blank and self.squeeze:
                    continue
                c = mark if space else c
                out += c
                places += [place] * len(c)
                blank = space
        return bytes(out), np.asarray([*places, end], np.int64)

    def places(self, text: str) -> np.ndarray:
        """The second part of ``normalised``: where each normalised byte, and the end, comes from.

        Without a key in the map each character stays, so the walk is one step for the whole text: a space becomes the bytes of its mark.
        """
        if self.map.units or self.squeeze or not text:
            return self.normalised(text)[1]
        data = np.frombuffer(text.encode(), np.uint8)
        mark = len(SPACE.encode())
        lead = np.zeros(mark if self.dummy else 0, np.int64)
        first = np.maximum.accumulate(np.where(data & 0xC0 != 0x80, np.arange(len(data)), 0))  # of each byte's character
        return np.concatenate([lead, np.repeat(first, np.where(data == 0x20, mark, 1)), [len(data)]])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and the source bytes [start, end) of each piece; by segments where the model allows it."""
        entries = self.entries(text)
        return self.whole(text) if entries is None else self.spans(text, entries)

    def spans(self, text: str, entries: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of a text's segments, each projected through the normaliser's alignment."""
        ids = np.frombuffer(b"".join([e[0] for e in entries]), "<i4")
        width, places = self.widths[ids], self.places(text)
        ends = np.cumsum(width)
        return ids, places[ends - width], places[ends]

    def entries(self, text: str) -> list[tuple] | None:
        """Ids (bytes) and decimal ids of the text's segments; None if the model or the text needs it whole.

        A segment is a run of spaces and the word after it, without its first space: the dummy prefix stands
        for that.  New segments of a text are encoded by the library in one call.
        """
        if not self.simple or SPACE in text:
            return None
        if not text:
            return []
        head, *rest = text.split(" ")
        if head and "" not in rest:
            keys = [head, *rest]
        else:
            keys, run = [head] if head else [], 0 if head else 1
            for p in rest:
                if p:
                    keys.append(" " * run + p)
                    run = 0
                else:
                    run += 1
            if run:
                keys.append(" " * (run - 1))
        return self.cached(keys)

    def cached(self, keys: list[str]) -> list[tuple]:
        words = self.words
        out = list(map(words.get, keys))
        if None not in out:
            return out
        if len(words) > CACHE_WORDS:
            words.clear()
        new = list({k for k in keys if k not in words})
        for k, ids in zip(new, self.lib.encode(new, num_threads=1), strict=True):
            ids = ids or [self.lib.piece_to_id(SPACE)]  # a single space at the end of a text
            words[k] = (array("i", ids).tobytes(), ",".join(map(str, ids)))
        out = [words[k] for k in keys]
        for k in new:
            if len(k) > 64:
                del words[k]
        return out

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A text's ids from the library, each piece projected through the normaliser's alignment."""
        ids = np.asarray(self.lib.encode(text), "<i4")
        plain, places = self.normalised(text)
        widths = np.asarray([self.piece_bytes(i) for i in ids.tolist()], np.int64)
        if (widths < 0).any() or widths.sum() != len(plain):  # an unknown piece has no fixed width
            proto = self.lib.encode(text, return_type="proto")
            widths = np.asarray([len(p.piece.encode()) if not self.lib.is_byte(p.id) else 1 for p in proto.pieces], np.int64)
        ends = np.cumsum(widths)
        return ids, places[ends - widths], places[ends]

    def piece_bytes(self, i: int) -> int:
        if self.lib.is_unknown(i):
            return -1
        return 1 if self.lib.is_byte(i) else len(self.lib.id_to_piece(i).encode())


def _chars(data: bytes) -> list[bytes]:
    return [c.encode() for c in data.decode()]


_models: dict[str, Model] = {}


def model_of(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, starts, ends: every piece of every text with its span of original UTF-8 bytes.

    Narrow: no shuffle, one batch of texts in memory.  Null text is empty and has no piece; null and repeated
    doc_ids stay as they are; other columns are ignored.
    """

    def encode(batches):
        m = model_of(model)
        for pdf in _steps(batches):
            found = [m.encode(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": ids_of(pdf, "doc_id"), "ids": [f[0].tolist() for f in found], "starts": [f[1].tolist() for f in found], "ends": [f[2].tolist() for f in found]})

    return _texts(docs).mapInPandas(encode, PIECES_SCHEMA)


def decode_pieces(pieces: DataFrame, model: str) -> DataFrame:
    """doc_id, text: the library's decoding of each list of ids; null or empty lists give an empty text."""

    def decode(batches):
        lib = model_of(model).lib
        for pdf in _steps(batches):
            yield pd.DataFrame({"doc_id": ids_of(pdf, "doc_id"), "text": [lib.decode([] if x is None else [int(i) for i in x]) for x in pdf["ids"]]})

    return pieces.select("ids", *exact("doc_id")).mapInPandas(decode, "doc_id long, text string")


def piece_digest(docs: DataFrame, model: str, *, with_ids: bool = False) -> DataFrame:
    """Digests of the ids and of their decoding for every text, and whether the spans cover its bytes in order; the ids if asked for.

    Null text is empty; rows without doc_id and repeated rows give one each; an empty table gives none; other columns are ignored.
    """

    def digest(batches):
        m = model_of(model)
        for pdf in _steps(batches):
            rows = []
            for text in pdf["text"]:
                entries = m.entries(text)
                ids, starts, ends = m.encode(text) if entries is None else m.spans(text, entries)
                plain = ",".join(map(str, ids.tolist()) if entries is None else [e[1] for e in entries])
                covered = bool((starts <= ends).all() and (starts[1:] >= starts[:-1]).all()) and (int(ends[-1]) if len(ends) else 0) == len(text.encode())
                ids = ids.tolist()
                decoded = m.lib.decode(ids) if ids else ""
                rows.append((len(ids), hashlib.sha256(plain.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), covered, ids if with_ids else None))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "spans_ok", "ids"])
            out.insert(0, "doc_id", ids_of(pdf, "doc_id"))
            yield out

    found = _texts(docs).mapInPandas(digest, DIGEST_SCHEMA)
    return found if with_ids else found.drop("ids")


def _steps(batches):
    """The batches in slices of about STEP_CHARS of text or ids: a text's ids as Python numbers take many times its bytes."""
    for pdf in batches:
        sizes = pdf.iloc[:, 0].map(lambda x: 0 if x is None else len(x)).to_numpy()
        step = (np.cumsum(sizes) - sizes) // STEP_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield pdf.iloc[a:b].reset_index(drop=True)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), *exact("doc_id"))
