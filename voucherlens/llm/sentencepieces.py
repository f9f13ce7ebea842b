"""SentencePiece encoding of merge-type (BPE) models by backtracking, and decoding.

1. The library's own normalizer makes each text the string that it would encode.
2. That string is cut between two characters that no piece holds side by side, as
   no merge can reach across. The distinct segments of a slice are encoded once; a
   bounded cache keeps the ids of short ones.
3. A segment is encoded from left to right. An Aho-Corasick automaton over the
   pieces gives the longest piece that begins at each place. A piece is taken if
   it is compatible with the one before: merging both their characters anew gives
   just these two. Otherwise its next shorter prefix that is a piece is tried, and
   when none is left the piece before is taken back and the place it ended at is
   marked in a bitfield, so that no place fails twice. A string has one sequence
   whose neighbours are all compatible, and that is what merging gives, so the
   ids are those of the library.
4. Characters that are no piece become their UTF-8 bytes' pieces. Begin and end
   ids are put around.

Work is linear in the text but for the fixed length of pieces, and every text is
encoded whole. Models need byte pieces and must hold no user-defined ones.

NULL and empty texts are the begin and the end id, decoded as an empty text.
Repeated rows and ids are encoded as often as they occur, NULL ids stay NULL. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voucherlens.llm.text import slices, table

# Fixed value: how pieces write a space.
SPACE_MARK = "▁"
SLICE_BYTES = 1 << 19
#: Segments that a Python worker remembers, the longest in bytes, and pairs of tokens.
CACHED_SEGMENTS, CACHED_BYTES, CACHED_PAIRS = 240_000, 48, 250_000

_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.large_binary())])
_DECODED = pa.schema([*_ENCODED, ("decoded", pa.large_string())])


class Encoder:
    """Ids of texts by one model file.

    A token is a piece, by its id, or a character that occurs in pieces and is none.
    """

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library = model = SentencePieceProcessor(model_file=path)
        kinds = model.is_control, model.is_unknown, model.is_byte, model.is_unused
        plain = [i for i in range(model.get_piece_size()) if not any(kind(i) for kind in kinds)]
        pieces = {model.id_to_piece(i): i for i in plain}
        self._bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(model.is_byte, self._bytes)):
            raise ValueError(f"{path} has no pieces for bytes")
        self._begin, self._end, self._count = model.bos_id(), model.eos_id(), model.get_piece_size()
        self._score = {piece: model.get_score(i) for piece, i in pieces.items()}
        extra = sorted(set("".join(pieces)) - set(pieces))
        self._tokens = {**pieces, **{c: self._count + k for k, c in enumerate(extra)}}
        self._said = [""] * (self._count + len(extra))
        self._automaton = ahocorasick.Automaton()
        for said, token in self._tokens.items():
            self._said[token] = said
            self._automaton.add_word(said, token)
        self._automaton.make_automaton()
        self._sizes = [len(said) for said in self._said]
        # The next shorter token that a token begins with, or -1.
        cuts = lambda said: (said[:k] for k in range(len(said) - 1, 0, -1))
        self._shorter = [next((self._tokens[t] for t in cuts(said) if t in self._tokens), -1) for said in self._said]
        pairs = {a << 21 | b for said in pieces for a, b in zip(*(map(ord, said.replace(SPACE_MARK, " ")[k:]) for k in (0, 1)))}
        self._inside = np.array(sorted(pairs), np.int64)
        self._pairs: dict[int, bool] = {}
        self._segments: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Characters merged by falling score, the leftmost of equals first."""
        parts = list(text)
        while True:
            scores = [self._score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            best = max(scores, default=-np.inf)
            if best == -np.inf:
                return parts
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, last: int, token: int) -> bool:
        """Whether both stay as they are next to each other; with no last, whether a token comes to be."""
        sides = [self._said[t] for t in (last, token) if t >= 0]
        known = self.merged("".join(sides)) == sides
        if len(self._pairs) >= CACHED_PAIRS:
            self._pairs.clear()
        self._pairs[last << 32 | token] = known
        return known

    def split(self, text: str) -> list[int]:
        """The tokens of a normalised text whose characters all occur in pieces, by backtracking."""
        sizes, shorter, pairs = self._sizes, self._shorter, self._pairs
        longest = [-1] * len(text)
        for end, token in self._automaton.iter(text):
            # Tokens arrive by their end, so the longest of a place comes last.
            longest[end + 1 - sizes[token]] = token
        failed, out, at, last, token = bytearray(len(text) + 1), [], 0, -1, longest[0]
        while True:
            while token >= 0:
                end = at + sizes[token]
                if not failed[end]:
                    good = pairs.get(last << 32 | token)
                    if good or good is None and self._compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == len(text):
                    return out
                at, last, token = end, token, longest[end]
            else:
                failed[at] = 1
                token = out.pop()  # some split exists, so the first place never fails
                at -= sizes[token]
                last = out[-1] if out else -1

    def _ids(self, segment: bytes) -> bytes:
        text = segment.decode().replace(" ", SPACE_MARK)
        ids = array("i")
        if len(text) == 1 and text not in self._tokens:
            ids.extend(self._bytes[b] for b in segment)
            return ids.tobytes()
        for token in self.split(text):
            if token < self._count:
                ids.append(token)
            else:
                ids.extend(self._bytes[b] for b in self._said[token].encode())
        return ids.tobytes()

    def _segment_ids(self, segments: list[bytes]) -> list[bytes]:
        """Ids of distinct segments; of those remembered, the less recent half goes when there are too many."""
        found = []
        for segment in segments:
            ids = self._segments.get(segment)
            if ids is None:
                ids = self._older.get(segment)
                if ids is None:
                    ids = self._ids(segment)
                if len(segment) <= CACHED_BYTES:
                    if 2 * len(self._segments) >= CACHED_SEGMENTS:
                        self._older, self._segments = self._segments, {}
                    self._segments[segment] = ids
            found.append(ids)
        return found

    def _begins(self, text: str) -> np.ndarray:
        """For each character, whether no piece holds it together with the one before."""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        pair = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self._inside, pair), len(self._inside) - 1)
        begins = np.ones(len(codes), bool)
        begins[1:] = self._inside[at] != pair
        return begins

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, with the begin and end ids."""
        # Marks are written as spaces, one byte each; the normalizer leaves no others.
        normal = [self.library.normalize(t).replace(SPACE_MARK, " ") for t in texts]
        joined = "".join(normal)
        raw = joined.encode()
        data = np.frombuffer(raw, np.uint8)
        first = np.flatnonzero((data & 0xC0) != 0x80)
        places = np.r_[first, len(data)]
        at = places[np.cumsum([0, *map(len, normal)])]
        begins = np.zeros(len(data) + 1, bool)
        begins[at] = True
        begins[first[self._begins(joined)]] = True
        begins[-1] = True
        edges = np.flatnonzero(begins)
        column = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw)]
        ).dictionary_encode()
        ids = self._segment_ids(column.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<i4")
        place = column.indices.to_numpy()
        sizes, begin = size[place], (np.cumsum(size) - size)[place]
        past = np.r_[0, np.cumsum(sizes)]
        every = flat[np.repeat(begin - past[:-1], sizes) + np.arange(past[-1])]
        bounds = past[np.searchsorted(edges, at)].tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield np.concatenate([[self._begin], every[a:b], [self._end]]).astype("<u4")


_loaded: dict[tuple[object, str], object] = {}


def loaded(kind: Callable, path: str):
    """One object for each Python worker, so that its caches serve many tasks."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def encode(documents: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of every text, ids as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(Encoder, model)
        for rows, data, at in slices(batches, limit=SLICE_BYTES):
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield table(_ENCODED, doc_id=rows.column("doc_id"), ids=[ids.tobytes() for ids in tokens.encode(texts)])

    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, ids binary")


def _library(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with ``decoded``, what the library makes of the ids again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = loaded(_library, model)
        for rows in batches:
            ids = rows.column("ids")
            said = [library.decode(np.frombuffer(x.as_buffer(), "<u4").tolist()) for x in ids]
            yield table(_DECODED, doc_id=rows.column("doc_id"), ids=ids.cast(pa.large_binary()), decoded=said)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digest(decoded: DataFrame) -> DataFrame:
    """Number of ids, and digests of ids and decoded text."""
    return decoded.select(
        "doc_id", F.expr("CAST(length(ids) DIV 4 AS LONG)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
