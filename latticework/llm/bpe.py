"""Byte-level BPE by a sentencepiece model that is serialised from a rank file."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_frames, numbered, table

#: Words and ids kept by a Python worker, and the longest word that is kept.
CACHE_WORDS, CACHE_LENGTH = 400_000, 64


def byte_letters() -> list[str]:
    """A printable letter for each byte, as byte-level vocabularies spell them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(n: int, value) -> bytes:
    """A protobuf field: bytes and text by length, int and bool as varint, float as 32 bits."""
    import struct

    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytes):
        return _varint(n << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(n << 3 | 5) + struct.pack("<f", value)
    return _varint(n << 3) + _varint(int(value))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece i spells the token of rank i, scored -i; the unknown piece is last."""
    letters = byte_letters()
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    out = b"".join(_field(1, _field(1, "".join(letters[b] for b in t)) + _field(2, float(-i))) for i, t in enumerate(tokens))
    out += _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(24, False) + _field(40, len(tokens))
    trainer += b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))  # no bos, eos, pad: -1
    normal = _field(1, "identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return out + _field(2, trainer) + _field(3, normal)


class ByteBPE:
    """Encodes and decodes by ranks; nothing is trained.

    A text is split by the pattern, each match is spelt in byte letters and
    encoded on its own; special tokens have no meaning. A match that is a token
    gets that token at once. Decoding maps ids to bytes.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.split = regex.compile(pattern).findall
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.byte = {c: b for b, c in self.letters.items()}
        self.bytes = [t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def ids(self, pieces: list[str]) -> list[list[int]]:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        found = self.model.encode([r.decode("latin-1").translate(self.letters) for r in raw], out_type=int, num_threads=1)
        return [[self.ranks[r]] if r in self.ranks else ids for r, ids in zip(raw, found)]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.ids(self.split(text)) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes[i] for i in ids)

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the bytes they decode to."""
        pieces, known = self.split(text), self.known
        new = list(set(pieces).difference(known))
        if new:
            if len(known) > CACHE_WORDS:
                known.clear()
                new = list(set(pieces))
            known.update((p, (" ".join(map(str, ids)), len(ids), self.decode(ids))) for p, ids in zip(new, self.ids(new)))
        ids, count, data = zip(*map(known.__getitem__, pieces)) if pieces else ((), (), ())
        for p in new:
            if len(p) > CACHE_LENGTH:
                del known[p]
        return sum(count), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(data)).hexdigest()


@lru_cache(2)
def _coder(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode_documents(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken", pattern: str = public_tokenizers.PATTERN, keep_ids: bool = False) -> DataFrame:
    """A row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    A null text counts as empty and has no ids. Repeated rows give repeated
    rows, an empty table an empty one; other columns of docs are ignored.
    """

    def run(batches):
        coder = _coder(public_tokenizers.path(name), pattern)
        for b in batches:
            got = [coder.digests(t) for t in b["text"]]
            out = pd.DataFrame(got, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].array)
            if keep_ids:
                out["ids"] = [coder.encode(t) for t in b["text"]]
            yield out

    return map_frames(numbered(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
