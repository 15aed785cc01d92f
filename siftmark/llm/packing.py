"""Packing: the token stream of the documents, in order, cut into sequences by dynamic programming.

Cuts may fall at document ends, at sentence ends (for a small penalty) and, inside sentences longer than
``FORCED`` tokens, at fixed steps (for a large one). The best cost of a stream that ends at boundary j is

    f[j] = penalty[j] + min over i with p[j] - p[i] <= size of  f[i] + size - (p[j] - p[i]),

a sliding-window minimum of f[i] + p[i], which a monotone queue gives in constant time per boundary. Each
scan task packs its own split in file order, holding at most ``HELD`` tokens and one document; cuts that lie
before the last sequences of what it holds are final. The last sequence of a task is cut into powers of two,
which need no padding. A lost task packs the same split again, with the same sequence ids.

Tokens: ids of the ``word_bpe_49k.json`` vocabulary. Words repeat, so each is encoded once and remembered up to a
bound. The merges of that file are run by a byte-pair encoder over the bytes of a word with an end mark, which gives the ids of the
tokenizer library (``tests/llm`` holds them against each other); words with unusual characters go to that library.

Defined results: null and empty texts are one piece that holds the end id; every row, repeated or without id,
is packed; texts longer than a sequence span several; an empty table gives no piece; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import arrow_rows, resource

SIZE = 2048
END_ID = 1
SENTENCE_CUT = 24
FORCED_CUT = 600
FORCED = 256
HELD = 262_144
MOST_WORDS = 350_000

# White space for the tokenizer but not for str.split, and the other way round.
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
_SPACE_RUNS = re.compile(r"[^\t-\r \x85\xa0  -     　]+")


class WordEncoder(dict):
    """Ids of words (runs without white space) as bytes of 16-bit ranks, remembered up to a bound."""

    def __init__(self, path: str):
        super().__init__()
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        # Byte-level vocabularies write each byte as one printable character.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        mark = b"\xff"  # no byte of UTF-8

        def raw(token: str) -> bytes:
            ends = token.endswith("</w>")
            return bytes(letters[c] for c in (token[:-4] if ends else token)) + mark * ends

        ranks = {bytes([b]): b for b in range(256)}
        for b in range(255):  # the end mark joins the last byte before any other merge
            ranks[bytes([b]) + mark] = len(ranks)
        for merge in model["merges"]:
            ranks.setdefault(raw("".join(merge if isinstance(merge, list) else merge.split(" "))), len(ranks))
        self.ids = np.zeros(len(ranks), np.uint32)
        self.ends = np.zeros(len(ranks), bool)
        for token, i in model["vocab"].items():
            if (key := raw(token)) in ranks:
                self.ids[ranks[key]] = i
                self.ends[ranks[key]] = token.endswith((".</w>", "!</w>", "?</w>"))
        self.rank_of = {int(i): r for r, i in enumerate(self.ids)}
        self.pieces = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        text = word if word.isascii() else unicodedata.normalize("NFC", word)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        parts = [text] if text.isalpha() else self.split(text)
        ranks: list[int] = []
        for part in parts:
            ranks += self.pieces(part.encode() + b"\xff")
        value = self[word] = array("H", ranks).tobytes()
        return value

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text, and whether each ends a sentence."""
        if "<|" in text or any("\ud800" <= c <= "\udfff" for c in text if c > "퟿"):
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
            return ids, np.array([self.ends[self.rank_of[i]] if i in self.rank_of else False for i in ids.tolist()], bool)
        words = _SPACE_RUNS.findall(text) if _ODD_SPACE.search(text) else text.split()
        ranks = np.frombuffer(b"".join([self[w] for w in words]), np.uint16)
        return self.ids[ranks], self.ends[ranks]


def boundaries(ends: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, ascending from 0, and their penalties.

    ``ends`` marks sentence ends in the stream, ``lengths`` are those of the documents.
    """
    total = len(ends)
    cost = np.full(total + 1, -1, np.int64)
    cost[1:][ends] = SENTENCE_CUT
    cost[np.cumsum([0, *lengths])] = 0
    places = np.flatnonzero(cost >= 0)
    for i in np.flatnonzero(np.diff(places) > 2 * FORCED):
        inner = np.arange(places[i] + FORCED, places[i + 1], FORCED)
        cost[inner] = FORCED_CUT
    places = np.flatnonzero(cost >= 0)
    return places, cost[places]


def best_cuts(places: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Indexes into ``places`` of the cheapest cuts, from 0 to the last."""
    p, c = places.tolist(), penalty.tolist()
    f, back = [0] * len(p), [0] * len(p)
    queue: deque[int] = deque([0])
    for j in range(1, len(p)):
        while p[j] - p[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        f[j], back[j] = c[j] + f[i] + size - p[j] + p[i], i
        value = f[j] + p[j]
        while queue and f[queue[-1]] + p[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts = [len(p) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def _powers(start: int, stop: int) -> list[int]:
    """Ends of pieces whose lengths are powers of two, the largest first."""
    out = []
    while start < stop:
        start += 1 << ((stop - start).bit_length() - 1)
        out.append(start)
    return out


class Packer:
    """Packs one task's documents; ``feed`` and ``finish`` return pieces (document, start, length, sequence, offset)."""

    def __init__(self, size: int = SIZE):
        self.size, self.sequence = size, 0
        self.held: list[list] = []  # [document, tokens of it that are packed already, sentence ends of the rest]
        self.tokens = 0

    def feed(self, document, ends: np.ndarray) -> list[tuple]:
        self.held.append([document, 0, ends])
        self.tokens += len(ends)
        return self._pack(False) if self.tokens >= HELD else []

    def finish(self) -> list[tuple]:
        return self._pack(True) if self.tokens else []

    def _pack(self, last: bool) -> list[tuple]:
        places, penalty = boundaries(np.concatenate([h[2] for h in self.held]), [len(h[2]) for h in self.held])
        cuts = [int(places[i]) for i in best_cuts(places, penalty, self.size)][1:]
        if last:
            begin = cuts[-2] if len(cuts) > 1 else 0
            cuts = cuts[:-1] + _powers(begin, cuts[-1])
        else:
            cuts = cuts[: max(1, len(cuts) - 8)]
        out, begin, d = [], 0, 0
        left = 0  # tokens of the current document that this call has given out
        for end in cuts:
            offset = 0
            while begin + offset < end:
                document, done, ends = self.held[d]
                take = min(len(ends) - left, end - begin - offset)
                out.append((document, done + left, take, self.sequence, offset))
                offset += take
                left += take
                if left == len(ends):
                    d, left = d + 1, 0
            begin, self.sequence = end, self.sequence + 1
        self.held = self.held[d:]
        if left:
            document, done, ends = self.held[0]
            self.held[0] = [document, done + left, ends[left:]]
        self.tokens -= begin
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, size: int = SIZE, with_ids: bool = False, path: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if wanted."""
    path = path or resource("word_bpe_49k.json")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = WordEncoder(path), Packer(size)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = [[], [], [], [], [], [], []]
            ids = []
            for (doc, all_ids), start, length, sequence, offset in pieces:
                part = all_ids[start : start + length]
                for column, value in zip(columns, (doc, start, length, zlib.crc32(part.astype("<u4").tobytes()), len(all_ids), first + sequence, offset)):
                    column.append(value)
                if with_ids:
                    ids.append(part.astype(np.int32))
            arrays = [pa.array(c, pa.int64()) for c in columns] + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

        for names, texts in arrow_rows(batches, ["doc_id", "text"], 64):
            for name, text in zip(names, texts):
                ids, ends = encoder.encode(text or "")
                pieces = packer.feed((name, np.append(ids, np.uint32(END_ID))), np.append(ends, True))
                if pieces:
                    yield rows(pieces)
        pieces = packer.finish()
        if pieces:
            yield rows(pieces)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(packed, PIECES + ", ids array<int>" * with_ids)
