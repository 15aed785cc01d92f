"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

Equal strings must meet, and only strings that may repeat should be sorted, so the text is dealt by content:

1. Every 100-byte window has a key, the least hash among its 24-byte runs. Neighbouring windows mostly share it; the stretch of
   windows that have their key from one place is a row (key, digest of the stretch, place). Equal windows have equal keys, wherever they stand. A
   scan task sends equal stretches once, marking the others at once, so no key brings more rows than tasks times different stretches.
   Where one key still has very many rows (counted first; such keys are at most a million), each window becomes a stretch and key of its own.
2. Rows meet by key. Of equal stretches all but the earliest are marked. Where a key has different stretches, the earliest of
   each is asked for its text.
3. These texts are dealt by key into shards, whose suffixes are put in order with their common prefixes by external induced
   sorting (``induced.py``), less the ends that hold no window whose hash occurs twice: neighbours that share 100 bytes or more are equal windows, and all but the earliest are marked.
4. Marks are merged for each document and its bytes are kept or removed, all judged on the input.

Defined results: null and empty texts have no bytes; texts under 100 bytes keep all; rows equal in id and text are one document
and get equal results; different texts of one id are different documents, in the order of a digest; documents without id come first;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import checkpointed
from siftmark.llm.induced import suffixes_with_shared

LENGTH = 100
KEY_BYTES = 24
HEAVY_ROWS = 20_000
MOST_HEAVY = 1_000_000
FLUSH_ROWS = 2_000_000
SHARD_BYTES = 4_000_000
CHUNK = 1 << 17

ROW = "key long, digest long, doc long, version long, start int, size int, marked boolean"
MARK = "doc long, version long, start int, stop int"
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93)]


def scattered(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= FACTORS[5]
    x ^= x >> np.uint64(29)
    return x


def run_hashes(data: np.ndarray, lengths: Iterable[int]) -> list[np.ndarray]:
    """For each length the 64-bit hashes of all runs of so many bytes; runs are joined from ones of doubling length."""
    lengths = list(lengths)
    out, used = [None] * len(lengths), [0] * len(lengths)
    doubled, width = (data.astype(np.uint64) + np.uint64(1)) * FACTORS[6], 1
    while True:
        for i, length in enumerate(lengths):
            if length & width:
                part = doubled[used[i] : used[i] + len(data) - length + 1]
                out[i] = part.copy() if out[i] is None else out[i] * FACTORS[4] + part
                used[i] += width
        if 2 * width > max(lengths):
            return [scattered(x) for x in out]
        joined = doubled[:-width] * FACTORS[width.bit_length() % 4]
        joined += doubled[width:]
        doubled, width = joined, 2 * width
        if width == 16:
            doubled = scattered(doubled)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    least, size = values, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - size :]) if size < width else least


def stretches(data: np.ndarray, ends: np.ndarray, heavy: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(key, digest, start, size) of the stretches of all texts, which lie in ``data`` one after the other up to ``ends``.

    A stretch of ``size`` windows covers ``size + LENGTH - 1`` bytes. Windows with a heavy key are stretches of their own.
    """
    parts = []
    for a in range(0, len(data) - LENGTH + 1, CHUNK):
        piece = data[a : a + CHUNK + LENGTH - 1]
        runs, whole = run_hashes(piece, (KEY_BYTES, LENGTH))
        keys = window_minima(runs, LENGTH - KEY_BYTES + 1)
        n = len(keys)
        ok = np.ones(n + 1, bool)  # windows inside one text
        new = np.ones(n + 1, bool)
        # a stretch also ends where the run that gave its key does, so none of its windows are equal
        new[1:n] = (keys[1:] != keys[:-1]) | (runs[: n - 1] == keys[:-1])
        for end in ends[np.searchsorted(ends, a) : np.searchsorted(ends, a + n + LENGTH)]:
            b = int(end) - a
            ok[max(b - LENGTH + 1, 0) : max(min(b, n), 0)] = False
            if 0 <= b <= n:
                new[b] = True
        new[1:] |= ok[1:] != ok[:-1]
        if heavy is not None and len(heavy):
            at = np.searchsorted(heavy, keys).clip(max=len(heavy) - 1)
            many = heavy[at] == keys
            keys = np.where(many, whole, keys)
            new[:n] |= many
            new[1:] |= np.append(many[1:], True) | many
        starts = np.flatnonzero(new[:n])
        sizes = np.diff(np.append(starts, n))
        inside = ok[starts]
        starts, sizes = starts[inside], sizes[inside]
        digest = scattered(whole[starts] * FACTORS[1] + whole[starts + sizes - 1] * FACTORS[2] + sizes.astype(np.uint64) * FACTORS[7])
        parts.append((keys[starts], digest, starts + a, sizes))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _texts(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column one after the other, and where each value ends."""
    column = batch.column(name).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def joined(doc: np.ndarray, version: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of windows of one document, where they touch or overlap, made one."""
    order = np.lexsort((start, version, doc))
    doc, version, start, stop = doc[order], version[order], start[order], stop[order]
    if not len(doc):
        return doc, version, start, stop
    other = np.append(True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]))
    # stretches of one document do not overlap, so the one before reaches furthest
    new = other | np.append(True, start[1:] > stop[:-1])
    first = np.flatnonzero(new)
    return doc[first], version[first], start[first], stop[np.append(first[1:], len(doc)) - 1]


class Seen:
    """Rows of one scan task, sent with equal stretches combined."""

    def __init__(self, heavy: np.ndarray | None):
        self.heavy, self.parts, self.rows = heavy, [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        data, ends = _texts(batch, "text")
        key, digest, start, size = stretches(data, ends, self.heavy)
        row = np.searchsorted(ends, start, side="right")
        begin = np.append(0, ends[:-1])
        ids = [batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "version")]
        self.parts.append((key, digest, *ids, (start - begin[row]).astype(np.int32), size.astype(np.int32)))
        self.rows += len(key)

    def flush(self) -> tuple[np.ndarray, ...]:
        """The columns of ``ROW``: the earliest of equal stretches, and the others joined to marked ones with keys that spread them."""
        key, digest, doc, version, start, size = (np.concatenate(p) for p in zip(*self.parts))
        self.parts, self.rows = [], 0
        order = np.lexsort((start, version, doc, digest, key))
        key, digest, doc, version, start, size = (x[order] for x in (key, digest, doc, version, start, size))
        other = np.append(True, (key[1:] != key[:-1]) | (digest[1:] != digest[:-1]))[: len(key)]
        sent = [x[other] for x in (key, digest, doc, version, start, size)]
        earliest = np.flatnonzero(other)[np.cumsum(other) - 1]
        again = (doc != doc[earliest]) | (version != version[earliest]) | (start != start[earliest])  # not a repeated row
        doc, version, start, stop = joined(*(x[again] for x in (doc, version, start)), start[again] + size[again])
        spread = scattered(doc.view(np.uint64) * FACTORS[1] + version.view(np.uint64) * FACTORS[2] + start.astype(np.uint64) * FACTORS[7])
        marks = [spread, spread, doc, version, start, (stop - start).astype(np.int32)]
        columns = [np.concatenate(pair) for pair in zip(sent, marks)]
        return _signed(columns[0]), _signed(columns[1]), *columns[2:], np.arange(len(columns[0])) >= len(sent[0])


def _rows(heavy) -> object:
    """The scan task: rows of stretches; ``heavy`` is a broadcast, sorted array of heavy keys."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(heavy.value)
        names = [c.split()[0] for c in ROW.split(", ")]
        for batch in batches:
            seen.add(batch)
            if seen.rows >= FLUSH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in seen.flush()], names)
        if seen.rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in seen.flush()], names)

    return scan


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): how many different stretches each key has in one scan task."""
    seen = Seen(None)

    def counted() -> pa.RecordBatch:
        key, *_, marked = seen.flush()
        keys, n = np.unique(key[~marked], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int32))], ["key", "n"])

    for batch in batches:
        seen.add(batch)
        if seen.rows >= FLUSH_ROWS:
            yield counted()
    if seen.rows:
        yield counted()


def heavy_keys(texts: DataFrame, least: int = HEAVY_ROWS) -> np.ndarray:
    """Keys with more rows than ``least`` and than a millionth of all rows; so they are a million at most."""
    counts = texts.mapInArrow(_key_counts, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))
    # one more row in each group of the sum: the total, and the keys that may be heavy
    large = checkpointed(counts.groupBy(F.when(F.col("n") > least, F.col("key")).alias("key")).agg(F.sum("n").alias("n")), "substring-keys")
    total = large.agg(F.sum("n")).first()[0] or 0
    found = large.where(F.col("key").isNotNull() & (F.col("n") > total / MOST_HEAVY)).select("key").toPandas()
    return np.sort(found["key"].to_numpy(np.int64).view(np.uint64))


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, digest and place: marks all but the first of equal stretches, keeps the first where its key has several.

    Stretches marked already pass. Streams: of a key only its last row is remembered, until a second stretch shows.
    """
    held = None  # the first stretch of the key last seen, while it is alone
    last_key = last_digest = last_place = None
    for batch in batches:
        key, digest, *place = (batch.column(c).to_numpy() for c in ("key", "digest", "doc", "version", "start"))
        marked = batch.column("marked").to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        before_key = np.append(key[0] if last_key is None else last_key, key[:-1])
        before_digest = np.append(digest[0] if last_digest is None else last_digest, digest[:-1])
        same_key = key == before_key
        same = same_key & (digest == before_digest)
        if last_key is None:
            same_key[0] = same[0] = False
        first = ~same  # of a stretch; a marked row never is, as its first one comes before it
        another = first & same_key  # one more stretch of its key
        keep = another.copy()
        # the first stretch of a key is kept once another one follows, perhaps in the next batch
        opening = np.flatnonzero(first & ~same_key)
        later = np.flatnonzero(another)
        if held is not None and len(later) and (not len(opening) or later[0] < opening[0]):
            yield held
            held = None
        if len(opening):
            nexts = np.searchsorted(later, opening)
            ends = np.append(opening[1:], len(key))
            followed = (nexts < len(later)) & (np.append(later, len(key))[np.minimum(nexts, len(later))] < ends)
            keep[opening[followed]] = True
            held = None if followed[-1] else _asked(batch, [opening[-1]], False)
        # a repeated row stands at the place of the earliest one
        earliest = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
        repeated = same.copy()
        for i, column in enumerate(place):
            of_earliest = np.where(earliest < 0, column[0] if last_place is None else last_place[i], column[earliest])
            repeated &= column == of_earliest
        last_key, last_digest = key[-1], digest[-1]
        last_place = last_place if earliest[-1] < 0 else [c[earliest[-1]] for c in place]
        if keep.any():
            yield _asked(batch, np.flatnonzero(keep), False)
        again = marked | (same & ~repeated)
        if again.any():
            yield _asked(batch, np.flatnonzero(again), True)


def _asked(batch: pa.RecordBatch, rows: object, marked: bool) -> pa.RecordBatch:
    part = batch.take(pa.array(rows))
    return part.set_column(part.schema.get_field_index("marked"), "marked", pa.array([marked] * part.num_rows))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the stretches that were asked for."""
    for batch in batches:
        texts, asked = batch.column("text"), batch.column("asked")
        out = [[], [], [], [], []]
        for text, doc, version, wants in zip(texts, batch.column("doc"), batch.column("version"), asked):
            data = text.as_py()
            for want in wants.as_py():
                start = want["start"]
                for column, value in zip(out, (want["key"], doc.as_py(), version.as_py(), start, data[start : start + want["size"] + LENGTH - 1])):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["key", "doc", "version", "start", "text"])


def may_repeat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(row, offset, text): what of each text the windows cover whose hash occurs again; other windows cannot repeat."""
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    hashes = np.concatenate([run_hashes(data[a : a + CHUNK + LENGTH - 1], (LENGTH,))[0] for a in range(0, len(data) - LENGTH + 1, CHUNK)])
    places = np.arange(len(hashes))
    row = np.searchsorted(ends, places, side="right")
    inside = places + LENGTH <= ends[row]
    places, row, hashes = places[inside], row[inside], hashes[inside]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    again = np.zeros(len(hashes), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    places, row = places[again], row[again]
    if not len(row):
        return row, row, []
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    last = np.append(first[1:], len(row)) - 1
    kept, begin = row[first], np.append(0, ends[:-1])[row[first]]
    offset, stop = places[first] - begin, places[last] - begin + LENGTH
    return kept, offset, [texts[r][a:b] for r, a, b in zip(kept.tolist(), offset.tolist(), stop.tolist())]


def repeats(texts: list[bytes], doc: np.ndarray, version: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last): runs of windows, by place in their text, that are equal to earlier ones of the shard.

    The texts are the shard: a separator smaller than all bytes ends each, and the smallest symbol ends the whole.
    """
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8).astype(np.uint16) + np.uint16(2)
    data[ends - 1], data[-1] = 1, 0
    order, shared = suffixes_with_shared(data, 258)
    # only suffixes in a run of neighbours that share the length
    equal = shared >= LENGTH
    opens = np.append(equal[1:], False) & ~equal
    members = np.flatnonzero(equal | opens)
    place = order[members]
    group = np.cumsum(opens[members])
    row = np.searchsorted(ends, place, side="right")
    offset = place - np.append(0, ends[:-1])[row]
    inside = place + LENGTH < ends[row]  # others reach over a separator
    group, row, offset = group[inside], row[inside], offset[inside]
    earliest = np.lexsort((start[row] + offset, version[row], doc[row], group))
    group, row, offset = group[earliest], row[earliest], offset[earliest]
    opening = np.append(True, group[1:] != group[:-1])[: len(group)]
    head = np.flatnonzero(opening)[np.cumsum(opening) - 1]
    places = (start[row] + offset, version[row], doc[row])
    again = np.any([p != p[head] for p in places], axis=0)  # a repeated row stands at the place of the earliest one
    row, offset = row[again], offset[again]
    by_row = np.lexsort((offset, row))
    row, offset = row[by_row], offset[by_row]
    new = np.append(True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1))[: len(row)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], offset[first], offset[last[: len(first)]]


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: whole keys are gathered to a shard, and its repeated windows are marked."""

    def sorted_shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        doc, version, start = (table.column(c).to_numpy() for c in ("doc", "version", "start"))
        whole, offset, texts = may_repeat(table.column("text").to_pylist())
        doc, version, start = doc[whole], version[whole], start[whole] + offset
        row, first, last = repeats(texts, doc, version, start)
        marks = [doc[row], version[row], (start[row] + first).astype(np.int32), (start[row] + last + LENGTH).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(m) for m in marks], ["doc", "version", "start", "stop"])

    parts, size, last_key = [], 0, None
    for batch in batches:
        key = batch.column("key").to_numpy()
        if not len(key):
            continue
        length = np.diff(np.append(0, _texts(batch, "text")[1]))
        begin = 0
        changes = np.flatnonzero(np.append(key[0] != (key[0] if last_key is None else last_key), key[1:] != key[:-1]))
        sums = np.append(0, np.cumsum(length))
        for at in changes:
            if size + sums[at] - sums[begin] >= SHARD_BYTES:
                parts.append(batch.slice(begin, at - begin))
                yield sorted_shard(parts)
                parts, size, begin = [], 0, at
        parts.append(batch.slice(begin))
        size += int(sums[-1] - sums[begin])
        last_key = key[-1]
    if parts:
        yield sorted_shard(parts)


def _merged(marks: list | None) -> list[tuple[int, int]]:
    """Disjoint runs, in order, of marks that may touch or overlap."""
    out = []
    for mark in sorted((m["start"], m["stop"]) for m in marks or []):
        if out and mark[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], mark[1])
        else:
            out.append(list(mark))
    return [tuple(m) for m in out]


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        kept, spans = [], []
        for text, marks in zip(batch.column("text"), batch.column("marks")):
            data = text.as_py()
            runs = _merged(marks.as_py())
            kept.append(b"".join(data[a:b] for a, b in zip([0, *[r[1] for r in runs]], [*[r[0] for r in runs], len(data)])))
            spans.append([{"start": a, "stop": b} for a, b in runs])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["doc_id", "n_bytes", "kept", "spans"])


def marks(texts: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(doc, version, start, stop): byte ranges to remove, which may overlap, of texts (doc, version, text)."""
    spark = texts.sparkSession
    heavy = spark.sparkContext.broadcast(heavy_keys(texts, heavy_rows))
    rows = texts.mapInArrow(_rows(heavy), ROW)
    met = rows.repartition("key").sortWithinPartitions("key", "digest", "doc", "version", "start")
    found = checkpointed(met.mapInArrow(_resolve, ROW), "substring-rows")
    asked = found.where("not marked").groupBy("doc", "version").agg(F.collect_list(F.struct("key", "start", "size")).alias("asked"))
    pieces = texts.join(asked, ["doc", "version"]).mapInArrow(_cut, "key long, doc long, version long, start int, text binary")
    shards = pieces.repartition("key").sortWithinPartitions("key")
    sorted_marks = shards.mapInArrow(_sort_shards, MARK)
    whole = found.where("marked").select("doc", "version", "start", (F.col("start") + F.col("size") + LENGTH - 1).alias("stop"))
    return checkpointed(whole.union(sorted_marks), "substring-marks")


def without_repeats(docs: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(doc_id, n_bytes, kept, spans): what is left of each text as bytes, and the maximal runs removed from it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # documents without id are told apart by 64 bits of their text, others of one id by 32
    version = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.shiftrightunsigned(F.xxhash64("text"), 32))
    keyed = plain.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), version.alias("version"), "text")
    long_enough = keyed.where(F.octet_length("text") >= LENGTH).select("doc", "version", "text")
    merged = marks(long_enough, heavy_rows).groupBy("doc", "version").agg(F.collect_list(F.struct("start", "stop")).alias("marks"))
    joined = keyed.join(merged, ["doc", "version"], "left").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text", "marks")
    return joined.mapInArrow(_keep, "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, stop: long>>")
