"""SentencePiece encoding and decoding (operator 4).

One Aho-Corasick automaton over all pieces drives a single-pass Viterbi: the automaton
reads a text once; at each position its output links give every piece that ends there,
longest first, and each relaxes the best score of its end. A character that no piece
holds becomes its UTF-8 byte pieces. Blanks are the piece alphabet's U+2581; one is put
before the text; nothing else is normalised, so decoding gives back the text exactly.

No piece goes on past a blank or holds a line feed (checked when the model is loaded), so
a best path splits there and the path of a word can be kept: a bounded cache of word
paths saves repeated work and changes no result. Models for which that is not so are
parsed whole.

Scale: map-only; the vocabulary (tens of thousands of pieces, fixed by its file) is
broadcast. Defined cases: null text gives null pieces and null text back; empty text gives
no pieces; U+2581 in a text is kept apart from a blank (byte pieces).
"""

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quadrille.llm.textops import give_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Word paths kept by a worker; the cache starts anew beyond.
CACHE = 300_000
#: Rows that a worker holds as Python objects at a time.
ROWS = 250


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    bytes_at: list[int]  # the id of each byte's piece
    special: frozenset[int] = field(default_factory=frozenset)

    @cached_property
    def digest(self) -> str:
        """Equal for equal vocabularies."""
        return hashlib.sha256(repr((self.pieces, self.scores, self.bytes_at, sorted(self.special))).encode()).hexdigest()

    @classmethod
    def load(cls, path: str = MODEL) -> "Vocabulary":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        bytes_at = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = frozenset(i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], bytes_at, special)


class Codec:
    def __init__(self, vocabulary: Vocabulary, encodes: bool = True):
        self.bytes_at = vocabulary.bytes_at
        self.out = [p.replace(BLANK, " ").encode() for p in vocabulary.pieces]
        for b, i in enumerate(self.bytes_at):
            self.out[i] = bytes([b])
        if encodes:
            self._learn(vocabulary)

    def _learn(self, vocabulary: Vocabulary) -> None:
        self.automaton = ahocorasick.Automaton()
        self.single = set()
        plain = [(i, p.replace(BLANK, " ")) for i, p in enumerate(vocabulary.pieces) if i not in vocabulary.special and p]
        scores = [vocabulary.scores[i] for i, _ in plain]
        self.lost = min(scores, default=0.0) - 10.0
        for (i, piece), score in zip(plain, scores, strict=True):
            self.automaton.add_word(piece, (i, len(piece), score))
            if len(piece) == 1:
                self.single.add(piece)
        self.automaton.make_automaton()
        whole = any(" " in p.lstrip(" ") or "\n" in p for _, p in plain)
        self.units = (lambda text: [text]) if whole else re.compile(r" *[^ \n]+| +|\n").findall
        self.kept: dict[str, bytes] = {}

    def path(self, text: str) -> list[int]:
        """Ids of the best path over ``text`` (blanks as blanks). Of equal scores, the path
        whose last piece is longest wins, position by position."""
        n = len(text)
        best, back, done = [0.0] + [-np.inf] * n, [None] * (n + 1), 0
        single, lost = self.single, self.lost
        for end, (i, size, score) in self.automaton.iter(text):
            while done <= end:
                if text[done] not in single:
                    best[done + 1], back[done + 1] = best[done] + lost, (-1, 1)
                done += 1
            end += 1
            s = best[end - size] + score
            if s > best[end]:
                best[end], back[end] = s, (i, size)
        while done < n:
            best[done + 1], back[done + 1] = best[done] + lost, (-1, 1)
            done += 1
        ids: list[int] = []
        while n:
            i, size = back[n]
            if i < 0:
                ids.extend(self.bytes_at[b] for b in reversed(text[n - 1].encode()))
            else:
                ids.append(i)
            n -= size
        ids.reverse()
        return ids

    def _new(self, unit: str) -> bytes:
        got = array("i", self.path(unit)).tobytes()
        if len(unit) <= 64:
            if len(self.kept) >= CACHE:
                self.kept.clear()
            self.kept[unit] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        get, new = self.kept.get, self._new
        return np.frombuffer(b"".join([get(u) or new(u) for u in self.units(" " + text)]), np.int32)

    def decode(self, ids) -> str:
        return b"".join(map(self.out.__getitem__, ids))[1:].decode()


_codecs: dict[tuple[str, bool], Codec] = {}


def _codec(broadcast, digest: str, encodes: bool) -> Codec:
    """One codec a worker process, kept between its tasks; digest: the vocabulary's."""
    key = digest, encodes
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(broadcast.value, encodes)
    return _codecs[key]


def encode_pieces(docs: DataFrame, carry: tuple[str, ...] = (), model: str = MODEL) -> DataFrame:
    """doc_id, ``carry`` columns, n_tokens, token_ids of every row of ``docs``."""
    src = docs.select("doc_id", *carry, "text")
    loaded = Vocabulary.load(model)
    digest, vocabulary = loaded.digest, docs.sparkSession.sparkContext.broadcast(loaded)
    kept = ["doc_id", *carry]
    schema = T.StructType([*(src.schema[c] for c in kept), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, digest, True)
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                texts = batch.column(len(kept)).to_pylist()
                ids = [codec.encode(t or "") for t in texts]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                none = np.array([t is None for t in texts], bool)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(none, False))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sizes, mask=none), lists], names=[*kept, "n_tokens", "token_ids"])
        codec.kept.clear()
        give_back()

    return src.mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, carry: tuple[str, ...] = (), model: str = MODEL) -> DataFrame:
    """doc_id, ``carry`` columns, text of every row of ``encoded`` (doc_id, token_ids)."""
    src = encoded.select("doc_id", *carry, "token_ids")
    loaded = Vocabulary.load(model)
    digest, vocabulary = loaded.digest, encoded.sparkSession.sparkContext.broadcast(loaded)
    kept = ["doc_id", *carry]
    schema = T.StructType([*(src.schema[c] for c in kept), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, digest, False)
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                lists = batch.column(len(kept))
                flat = lists.flatten().to_numpy(zero_copy_only=False).tolist()
                sizes = np.diff(np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]))
                ends = np.cumsum(sizes).tolist()
                known = lists.is_valid().to_pylist()
                texts = [codec.decode(flat[e - s : e]) if k else None for e, s, k in zip(ends, sizes.tolist(), known, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, "text"])
        give_back()

    return src.mapInArrow(run, schema)
