"""Packing of tokenized documents into windows by deficit round-robin over source queues."""

from __future__ import annotations

import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size, cut, map_frames, scratch, table

WINDOW, END, TOKENIZER = 2048, 1, "word_bpe_49k.json"
#: Ids that a task holds at once; beyond it, it packs full windows of what it has.
HELD = 1 << 21
#: Ids of a packing task.
TASK = 1 << 21
#: Sequences that end partitions: so many partitions' tails are packed together.
TAILS = 64
#: Characters that are encoded in one go.
CHUNK = 1 << 23
#: Bytes of pieces and their ids that a worker keeps for later chunks and tasks.
KNOWN = 1 << 25


def _spread(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows at the places, one after the other; their sizes), of a flat array of rows of those sizes."""
    own = sizes[at]
    ends, first = np.cumsum(own), np.cumsum(sizes) - sizes
    return flat[np.repeat(first[at] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)], own


class WordBPE:
    """Ids of the tokenizers library for word_bpe_49k.json, no special tokens added.

    As in the library, the strings of special tokens in a text are those tokens unless plain is set.
    The file's own normaliser and split are applied here, so that each distinct piece
    of CHUNK characters goes to the library once, and not at all if its ids are known from an earlier chunk.
    """

    #: Letters, perhaps, and the ASCII punctuation that ends a word: that is one piece, whatever it holds.
    ENDED = r"^(?P<stem>[^\x00-@\[-`{-\x7F]+)(?P<tail>[!-/:-@\[-`{-~]+)$"

    def __init__(self, name: str, plain: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(public_tokenizers.path(name))
        self.lib.encode_special_tokens = plain
        # Fixed value: the split of word_bpe_49k.json.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # What isn't the same word by word: lower-casing by place, special tokens' strings, controls that only Python calls white space.
        self.odd = ("\u0130", "\u03a3", "\x1c", "\x1d", "\x1e", "\x1f", "<|")
        self.last = np.zeros(self.lib.get_vocab_size(), bool)
        self.last[[i for t, i in self.lib.get_vocab().items() if t.endswith("</w>")]] = True
        # The same model for pieces that are split and normalised already.
        self.bare = Tokenizer(self.lib.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()

    def _forget(self) -> None:
        """Known pieces, the ids of all of them, and how many each has."""
        self.known, self.flat, self.sizes = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has), by one call: the last token of each piece, and no other, has the mark of an end."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(pieces):
            return ids, np.diff(ends, prepend=0)
        each = [self._whole(p) for p in pieces]
        return np.concatenate([np.zeros(0, np.uint32), *each]), np.array(list(map(len, each)), np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Texts go CHUNK characters at a time, so that their new words are encoded in one call."""
        for some in by_size(texts, CHUNK):
            yield from self._chunk(some)

    def _chunk(self, texts: list[str]) -> Iterator[np.ndarray]:
        odd = [any(x in t for x in self.odd) for t in texts]
        split = pc.utf8_split_whitespace(pa.array(["" if o else unicodedata.normalize("NFC", t).lower() for t, o in zip(texts, odd)], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        by_word, sizes = self._words(coded.dictionary)
        ids, sizes = _spread(by_word, sizes, coded.indices.to_numpy())
        cuts = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy()].tolist()
        for i, t in enumerate(texts):
            yield self._whole(t) if odd[i] else ids[cuts[i] : cuts[i + 1]]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has)."""
        # A word of letters alone is one piece, one of letters and punctuation two.
        one = pc.utf8_is_alpha(words)
        rest = words.filter(pc.invert(one))
        parted = pc.extract_regex(rest, self.ENDED)
        stem, tail = pc.struct_field(parted, "stem"), pc.struct_field(parted, "tail")
        two = pc.utf8_is_alpha(stem).fill_null(False)
        parts = list(map(self.split, rest.filter(pc.invert(two)).to_pylist()))
        pieces = pa.concat_arrays([words.filter(one), stem.filter(two), tail.filter(two), pa.array(list(chain.from_iterable(parts)), words.type)]).dictionary_encode()
        # Pieces stand by kind of word, a word's own in order; by word, they are:
        one, two = (x.to_numpy(zero_copy_only=False) for x in (one, two))
        other, count = np.flatnonzero(~one), np.ones(len(words), np.int64)
        count[other[two]], count[other[~two]] = 2, list(map(len, parts))
        place = np.argsort(np.concatenate([np.flatnonzero(one), other[two], other[two], np.repeat(other[~two], count[other[~two]])]), kind="stable")
        by_piece, sizes = _spread(*self._learned(pieces.dictionary), pieces.indices.to_numpy()[place])
        reach = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(count)]
        return by_piece, np.diff(reach, prepend=0)

    def _learned(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all of the distinct pieces, how many each has). Pieces that are new become known; beyond KNOWN bytes all are forgotten first."""
        if self.known.nbytes + self.flat.nbytes + self.sizes.nbytes > KNOWN:
            self._forget()
        at = pc.index_in(pieces, value_set=self.known)
        fresh, before = pieces.filter(at.is_null()), len(self.known)
        if len(fresh):
            flat, sizes = self._pieces(fresh.to_pylist())
            self.known, self.flat, self.sizes = pa.concat_arrays([self.known, fresh]), np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = before + np.arange(len(fresh))
        return _spread(self.flat, self.sizes, place)


@lru_cache(1)
def _coder(name: str, plain: bool = False) -> WordBPE:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordBPE(name, plain)


class Packer:
    """Fills windows from queues, one per source.

    Each window adds window * share to a source's deficit. Sources are served in
    turn, from where the last window ended: each gives up to its deficit, cutting
    a document where need be; what is served is taken off the deficit. What room
    is left then goes to the source with the largest deficit that has anything,
    so that a window is always filled. Deficits carry over to later windows.
    """

    def __init__(self, shares: dict, window: int, deficit: dict | None = None):
        self.shares, self.window = shares, window
        self.queues: dict = {}
        self.deficit: dict = dict(deficit or {})
        self.held = 0

    def add(self, source, item) -> None:
        self.queues.setdefault(source, deque()).append(item)
        self.deficit.setdefault(source, 0.0)
        self.held += item[3]

    def _serve(self, source, room: int, out: list) -> int:
        q, given = self.queues[source], 0
        while room and q:
            doc, start, ids, n, total = q[0]
            k = n if n < room else room
            out.append((doc, start, k, zlib.crc32(ids[:k]), total, source))
            if k == n:
                q.popleft()
            else:
                q[0] = (doc, start + k, ids[k:], n - k, total)
            room, given = room - k, given + k
        if not q:
            del self.queues[source]
        self.held -= given
        self.deficit[source] -= given
        return given

    def fill(self) -> list:
        """The pieces of the next window."""
        out, room, deficit = [], min(self.window, self.held), self.deficit
        live = list(self.queues)
        total = sum(self.shares.get(s, 0.0) for s in live)
        for s in live:
            deficit[s] += self.window * (self.shares.get(s, 0.0) / total if total > 0 else 1 / len(live))
        for s in sorted(live, key=deficit.__getitem__, reverse=True):
            owed = round(deficit[s])
            if not room or owed <= 0:
                break
            room -= self._serve(s, min(room, owed), out)
        while room:
            s = max(self.queues, key=deficit.__getitem__)
            room -= self._serve(s, room, out)
        return out


    def rest(self) -> Iterator[tuple]:
        """(source, item) of all that is queued."""
        for s, q in self.queues.items():
            for item in q:
                yield s, item


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, plain: bool = False) -> DataFrame:
    """A row per document of (doc_id, text, source): doc_id, source, n and its ids, the end last.

    turn numbers each source's documents of a partition, from a place that differs by partition and source: turn modulo n
    deals every source evenly over n tasks.
    """

    def encode(batches):
        from pyspark import TaskContext

        coder, part, turns = _coder(tokenizer, plain), TaskContext.get().partitionId(), {}

        def turn(source):
            turns[source] = turns[source] + 1 if source in turns else zlib.crc32(f"{part} {source}".encode("utf-8", "surrogatepass"))
            return turns[source]

        kind = np.uint16 if coder.lib.get_vocab_size() <= 1 << 16 else np.uint32
        for b in batches:
            ids = [np.append(x, np.uint32(END)).astype(kind) for x in coder.ids(b["text"].tolist())]
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "source": b["source"].array, "turn": [turn(x) for x in b["source"]], "n": [len(x) for x in ids], "wide": kind is np.uint32, "ids": [x.tobytes() for x in ids]})

    return map_frames(docs, encode, "doc_id long, source string, turn long, n long, wide boolean, ids binary", CHUNK)


def _laid(window: list, sequence: int) -> list[tuple]:
    """Rows of a window's pieces."""
    out, at = [], 0
    for doc, start, n, crc, total, source in window:
        out.append((doc, start, n, crc, total, sequence, at, source))
        at += n
    return out


def targets(coded: DataFrame) -> DataFrame:
    """(source, share): each source's ids, of all sources."""
    return coded.groupBy("source").agg(F.sum("n").cast("double").alias("share"))


def pack(docs: DataFrame, shares: dict | None = None, window: int = WINDOW, tokenizer: str = TOKENIZER, source_col: str = "source", plain: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    shares: target proportions of sources by name; sources without one get none
    of the target but are packed all the same. Without shares, each source's
    share of all ids, however many sources there are. Documents are tokenized first and then dealt
    evenly over tasks of about TASK ids, so that each task has its part of every source whatever the
    table's layout; a task carries deficits from window to window and holds at most HELD ids. What is left
    at a task's end, less than a window, goes on with its deficits: those of TAILS tasks meet, deficits are
    summed, and the same round-robin fills windows with them. Only the last window of such a group is not full.

    plain: strings of special tokens are ordinary text; otherwise they are those tokens, as the library has it.
    A null text counts as empty; its piece is the end id alone. A null source is
    a source of its own. Repeated rows are packed as often as they occur. Other
    columns are ignored; a table without the source column has one source. An
    empty table gives an empty result.
    """
    if source_col not in docs.columns:
        docs = docs.withColumn(source_col, F.lit("all"))
    src = F.coalesce(F.col(source_col).cast("string"), F.lit("\u0000null")).alias("source")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), src)
    with scratch() as keep:
        coded = cut(encoded(docs, tokenizer, plain))
        if shares is None:
            whole = cut(targets(coded))
            dealt, total = coded.join(whole, "source"), whole.agg(F.sum("share")).first()[0]
        else:
            given = docs.sparkSession.sparkContext.broadcast(shares)
            dealt, total = coded.withColumn("share", F.lit(None).cast("double")), coded.agg(F.sum("n")).first()[0]
        tasks = max(1, -(-int(total or 0) // TASK))
        names = [c.split()[0] for c in PIECE.split(", ")]
        dealt = dealt.repartitionById(tasks, (F.col("turn") % tasks).cast("int"))

        def run(batches):
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            packer, done = Packer({} if shares is None else given.value, window), 0

            def frame(windows):
                nonlocal done
                out = []
                for w in windows:
                    out += _laid(w, (part << 32) + done)
                    done += 1
                return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"}).assign(part=None, share=None, deficit=None, ids=None)

            for b in batches:
                out = []
                for doc, ids, wide, source, share in zip(b["doc_id"].astype(object).where(b["doc_id"].notna(), None), b["ids"], b["wide"], b["source"], b["share"]):
                    ids = np.frombuffer(ids, np.uint32 if wide else np.uint16).astype(np.uint32)
                    if shares is None:
                        packer.shares[source] = share
                    packer.add(source, (doc, 0, ids, len(ids), len(ids)))
                    if packer.held > HELD:
                        while packer.held > HELD // 2:
                            out.append(packer.fill())
                if out:
                    yield frame(out)
            out = []
            while packer.held >= window:
                out.append(packer.fill())
            if out:
                yield frame(out)
            # The rest, in order, and the deficits of sources that have none.
            rest = [(doc, start, n, 0, total, None, i, s, ids.tobytes()) for i, (s, (doc, start, ids, n, total)) in enumerate(packer.rest())]
            rest += [(None, 0, 0, 0, 0, None, -1, s, None) for s, d in packer.deficit.items() if s not in packer.queues and abs(d) >= 1]
            if packer.held:
                pdf = pd.DataFrame(rest, columns=[*names, "ids"]).astype({"doc_id": "Int64", "sequence_id": "Int64"})
                yield pdf.assign(part=part, share=pdf["source"].map(lambda s: packer.shares.get(s, 0.0)), deficit=pdf["source"].map(packer.deficit))

        laid = keep(cut(map_frames(dealt, run, PIECE + ", part long, share double, deficit double, ids binary")))

    def join_tails(key, pdf):
        own = pdf.drop_duplicates(["part", "source"])
        packer = Packer(dict(zip(own["source"], own["share"])) if shares is None else given.value, window, own.groupby("source")["deficit"].sum().to_dict())
        pdf = pdf[pdf["length"] > 0].sort_values(["part", "offset"])
        for doc, start, n, total, source, ids in zip(pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None), pdf["start"], pdf["length"], pdf["doc_tokens"], pdf["source"], pdf["ids"]):
            packer.add(source, (doc, start, np.frombuffer(ids, np.uint32), n, total))
        out, at = [], (1 << 62) + (int(key[0]) << 32)
        while packer.held:
            out += _laid(packer.fill(), at)
            at += 1
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    tails = laid.where("part is not null").withColumn("g", F.expr(f"part div {TAILS}")).groupBy("g").applyInPandas(join_tails, PIECE)
    return laid.where("part is null").select(*names).union(tails)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
