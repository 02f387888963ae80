"""Substring dedup by level-wise doubling.

A window is ``window`` consecutive words of a document. A word goes if a window
that covers it also starts in a document with a smaller doc_id.

Lengths double from level to level and end with ``window`` (``levels``: 7, 13 or 7, 13,
25, 50, 100). A level counts windows of its length that may repeat; those repeated at
that length alone are extended to the next one, until no candidates survive or the
window is reached. Not all windows of a length are counted: a window of the next
length holds several of them, and the one with the smallest hash (the leftmost of
equals) is its anchor, the same one wherever it occurs. So a level looks only at
anchors of the next level's windows, and of these only at those whose own anchor
repeated at the level before: whatever repeats has an anchor that does. Windows of the last
level whose sequence starts in a smaller document are what goes.

Copies come first: documents with the same words are one content, stood for by the
one with the smallest doc_id. Only contents are compared, and a copy of a smaller
document goes whole, as each of its windows starts there too.

Counts are aggregates that combine map-side: the smallest and largest content or
doc_id of a hash. They go back to the positions by a sort-merge join of tables in the shared
folder, which Spark splits where one passage holds a large share of all rows.
Anchors are compared by 64 bits (a collision only costs work), full windows by 96,
contents by 128.

Defined cases
    * null text: no words. Texts with fewer words than a window: nothing goes.
    * null doc_id: never a source, and nothing is removed from it.
    * repeated doc_ids are one document: its rows remove nothing from each other, and
      each row, also one that has the same words as another, gets its own result.
    * empty table: an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, row_key, small_batches, trimmed

#: Odd multipliers that combine word hashes to window hashes.
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
#: Anchors are sent on in batches of about this many.
FLUSH = 200_000
#: The first level's length is at most this.
FIRST = 8


def levels(window: int) -> list[int]:
    """The windows' lengths, level by level: each at most twice the one before."""
    found = [window]
    while found[0] > FIRST:
        found.insert(0, (found[0] + 1) // 2)
    return found


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh3_64_digest(w) for w in words]), dtype=">u8").astype(np.uint64)


def windows(hashes: np.ndarray, length: int, multiplier: np.uint64) -> np.ndarray:
    """A hash of every window of that length."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out *= multiplier
        out += hashes[i : i + n]
    out ^= out >> np.uint64(29)
    out *= MULTIPLIERS[2]
    out ^= out >> np.uint64(32)
    return out


def anchors(hashes: np.ndarray, window: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The short windows' hashes, and for each full window where its anchor begins."""
    short = windows(hashes, half, MULTIPLIERS[0])
    n = len(hashes) - window + 1
    if n <= 0:
        return short, np.empty(0, np.int64)
    least, at = short[:n].copy(), np.arange(n)
    for i in range(1, window - half + 1):
        other = short[i : i + n]
        lower = other < least
        least[lower] = other[lower]
        at[lower] = np.flatnonzero(lower) + i
    return short, at


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return own.withColumn("row_key", row_key("doc_id", "text"))


def content(words: list[bytes]) -> tuple[int, int]:
    """Two signed 64-bit halves of a hash of the words."""
    raw = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def anchor_rows(own: DataFrame, window: int, length: int, after: int | None) -> DataFrame:
    """The first level: h, c, pos of every distinct anchor position (every position without
    a next level), c the content's first half; and for each row with a full window one row
    with pos -1, h the second half, doc_id and row_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "c", "pos", "doc_id", "row_key"]
        for b in trimmed(batches):
            texts, ids, keys = b.column("text").cast(pa.large_binary()), b.column("doc_id").to_pylist(), b.column("row_key").to_pylist()
            hs, cs, ps, heads, size = [], [], [], [], 0

            def flush():
                n = len(heads)
                one, two, doc, key = zip(*heads)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(cs)), pa.array(np.concatenate(ps)), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64())], names=names)
                yield pa.RecordBatch.from_arrays([pa.array(two, pa.int64()), pa.array(one, pa.int64()), pa.array(np.full(n, -1, np.int32)), pa.array(doc, pa.int64()), pa.array(key, pa.int64())], names=names)

            for i in range(len(texts)):
                words = texts[i].as_py().split()
                if len(words) < window:
                    continue
                one, two = content(words)
                if after:
                    short, at = anchors(word_hashes(words), after, length)
                    at = np.unique(at)
                else:  # the only level counts full windows, below
                    short, at = np.empty(0, np.uint64), np.empty(0, np.int64)
                hs.append(short[at].view(np.int64))
                cs.append(np.full(len(at), one, np.int64))
                ps.append(at.astype(np.int32))
                heads.append((one, two, ids[i], keys[i]))
                size += len(at)
                if size >= FLUSH:
                    yield from flush()
                    hs, cs, ps, heads, size = [], [], [], [], 0
            if heads:
                yield from flush()

    return own.where("doc_id is not null and text is not null").mapInArrow(run, "h long, c long, pos int, doc_id long, row_key long")


def window_rows(own: DataFrame, alive: DataFrame, before: int | None, length: int, after: int | None) -> DataFrame:
    """A later level: the hash (h, h2) of each window of ``length`` whose anchor of the level
    before is alive (of all, if there is none) and that is an anchor for the next
    level (any, at the last), with where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            texts, ids, keys, alives = b.column("text").cast(pa.large_binary()), b.column("doc_id").to_pylist(), b.column("row_key").to_pylist(), b.column("alive")
            held: list[tuple[np.ndarray, ...]] = []
            size = 0

            def flush():
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["h", "h2", "doc_id", "row_key", "pos"])

            for i in range(len(texts)):
                hashes = word_hashes(texts[i].as_py().split())
                if before:
                    _, at = anchors(hashes, length, before)
                    living = np.zeros(len(hashes) + 1, bool)
                    living[alives[i].values.to_numpy(zero_copy_only=False)] = True
                    positions = np.flatnonzero(living[at])
                else:
                    positions = np.arange(len(hashes) - length + 1)
                if after:
                    positions = np.intersect1d(positions, anchors(hashes, after, length)[1])
                n = len(positions)
                one = windows(hashes, length, MULTIPLIERS[0])[positions].view(np.int64)
                two = (windows(hashes, length, MULTIPLIERS[1])[positions] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                held.append((one, two, np.full(n, ids[i], np.int64), np.full(n, keys[i], np.int64), positions.astype(np.int32)))
                size += n
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
            if held:
                yield flush()

    return own.join(alive, "row_key").select("doc_id", "row_key", "text", "alive").mapInArrow(run, "h long, h2 int, doc_id long, row_key long, pos int")


def repeated(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The keys that occur under two values of ``by`` or more, with the smallest of these."""
    return rows.groupBy(*keys).agg(F.min(by).alias("first"), F.max(by).alias("last")).where("first < last").drop("last")


def covered(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_key, starts: where windows begin that also start in a smaller document; null
    starts: the row is a copy of a smaller document."""
    small_batches(docs.sparkSession)
    own = keyed(docs, id_col, text_col)
    lengths = levels(window)
    following = dict(zip(lengths, lengths[1:]))
    level = materialize(anchor_rows(own, window, lengths[0], following.get(lengths[0])), "substring-anchors")
    heads = level.where("pos = -1").select("c", F.col("h").alias("c2"), "doc_id", "row_key")
    chosen = materialize(heads.groupBy("c", "c2").agg(F.min(F.struct("doc_id", "row_key")).alias("rep")).select("c", "c2", F.col("rep.doc_id").alias("rep_id"), F.col("rep.row_key").alias("rep_key")), "substring-contents")
    others = materialize(heads.join(chosen, ["c", "c2"]).where("row_key <> rep_key").select("row_key", "rep_key", (F.col("doc_id") > F.col("rep_id")).alias("copy")).distinct(), "substring-copies")

    if len(lengths) == 1:
        alive = chosen.select(F.col("rep_key").alias("row_key"), F.lit(None).cast("array<int>").alias("alive"))
    else:
        places = level.where("pos >= 0").select("h", "c", "pos")
        again = materialize(repeated(places, ["h"], "c").select("h"), "substring-repeated")
        alive = places.join(again, "h").groupBy("c").agg(F.collect_set("pos").alias("alive"))
        alive = chosen.join(alive, "c").select(F.col("rep_key").alias("row_key"), "alive")
    alive = materialize(alive, "substring-alive")
    discard(level)

    before = lengths[0] if len(lengths) > 1 else None
    for length in lengths[1:] or lengths:
        full = materialize(window_rows(own, alive, before, length, following.get(length)), "substring-windows")
        last = length == window
        again = materialize(repeated(full, ["h", "h2"], "doc_id"), "substring-repeated")
        hits = full.join(again, ["h", "h2"]).where("doc_id > first" if last else "true").groupBy("row_key").agg(F.collect_set("pos").alias("alive"))
        hits = materialize(hits, "substring-hits")
        discard(full, again, alive)
        alive, before = hits, length
        if not last and hits.isEmpty():
            break  # no candidates survive; nothing repeats at the full length either
    hits = alive.withColumnRenamed("alive", "starts")
    twins = others.where("not copy").join(hits.withColumnRenamed("row_key", "rep_key"), "rep_key").select("row_key", "starts")
    copies = others.where("copy").select("row_key", F.lit(None).cast("array<int>").alias("starts"))
    return hits.unionByName(twins).unionByName(copies)


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    found = covered(docs, window, id_col, text_col).withColumn("hit", F.lit(True))
    own = keyed(docs, id_col, text_col).join(found, "row_key", "left")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            total, gone, digests, kepts = [], [], [], []
            texts, starts, hit = b.column("text").cast(pa.large_binary()), b.column("starts"), b.column("hit").to_pylist()
            for i in range(len(texts)):
                words = (texts[i].as_py() or b"").split()
                total.append(len(words))
                if hit[i] and starts[i].is_valid:
                    steps = np.zeros(len(words) + 1, np.int64)
                    at = starts[i].values.to_numpy(zero_copy_only=False)
                    steps[at] += 1
                    steps[at + window] -= 1
                    words = [words[j] for j in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
                elif hit[i]:
                    words = []
                kept = b" ".join(words)
                gone.append(total[-1] - len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    kepts.append(kept)
            arrays = [b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            if keep_text:
                arrays.append(pa.array(kepts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return own.select("doc_id", "text", "starts", "hit").mapInArrow(run, schema)
