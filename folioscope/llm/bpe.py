"""Byte-level BPE by recursive queries, one DuckDB engine in each Python worker.

``encode``: a text is cut by the tokenizer's pattern. Words that are tokens are
looked up; each other distinct word becomes rows (word, position, token), one for
every byte. The recursive query joins neighbouring tokens with the merge table,
takes each word's leftmost pair of minimum rank and contracts it, until no pair of
the word can merge. The merge table is every cut of a token into two tokens; the
rank of the pair is the token's.

Words of any length take this way, in bounded memory. Between two bytes that stand
side by side in no token nothing ever merges, so a word is cut there first. A query
goes so many steps that its rows stay bounded, and what isn't done is the next
query's start. Words that are not done after the first query are long; their
queries contract in one step all occurrences of the minimum pair that the leftmost
rule would contract one after another: non-overlapping ones from left to right,
unless one of them would make a pair of lower rank beside it (``traps``), when only
the leftmost one is contracted.

``decode``: rows (sequence, position, token) join the vocabulary and an ordered
aggregation puts the bytes together. Decoding a concatenation is the concatenation
of the decodings, so a text's ids are decoded piece by piece, each distinct piece
once.

Only words that a worker doesn't remember reach the engine. It remembers ``CACHE``
words at most, and forgets those least used. A text is handled in pieces of about
``PIECE`` characters, cut between words, with incremental digests.

Defined cases
    * null text: the empty text, no ids. Ids that the vocabulary lacks or null ids
      among ids to decode: ``KeyError`` as the input is not of this tokenizer.
    * null or repeated doc_ids: every row is encoded for itself.
    * the result doesn't depend on other rows; an empty table gives an empty one.
    * extra columns are ignored by ``encode`` and ``round_trip``.
    * a text of any length and words of any length are encoded by the same queries.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches, trimmed

#: Words sent to the engine at a time, words remembered, characters of a piece (of long texts,
#: or of short ones together), and rows that the steps of a query may leave behind.
BATCH = 40_000
CACHE = 500_000
PIECE = 1 << 21
ROWS = 8_000_000
#: Bits of a merge's key: token length, and position below it.
SIZE_BITS, POS_BITS = 11, 31

#: best: key of the word's minimum pair | leftmost position of it; null once none can merge.
FIRST = """
WITH RECURSIVE bpe(n, word, pos, tok, best) AS (
  SELECT 0, word, pos, tok, min(m.key | pos) OVER (PARTITION BY word)
  FROM (SELECT *, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS next FROM start)
  LEFT JOIN merges m ON m.pair = (tok::BIGINT << 32) | next
  UNION ALL
  SELECT n, word, pos, tok, min(m.key | pos) OVER (PARTITION BY word)
  FROM (
    SELECT n + 1 AS n, word, pos,
      CASE WHEN pos = least THEN made ELSE tok END AS tok,
      CASE WHEN pos = least THEN after WHEN next_pos = least THEN made ELSE next END AS next
    FROM (
      SELECT *, (best & 2147483647)::INT AS least, (best >> 42)::INT AS made,
        lead(tok) OVER w AS next, lead(tok, 2) OVER w AS after, lead(pos) OVER w AS next_pos, lag(pos) OVER w AS before
      FROM bpe WHERE best IS NOT NULL AND n < $steps WINDOW w AS (PARTITION BY word ORDER BY pos)
    ) WHERE before IS DISTINCT FROM least
  ) LEFT JOIN merges m ON m.pair = (tok::BIGINT << 32) | next
)
SELECT word, pos, tok, best IS NOT NULL AS more FROM bpe WHERE best IS NULL OR n = $steps ORDER BY more, word, pos
"""
#: The same with all occurrences at once. first: where the run of touching occurrences that ends
#: here begins; of a run every other pair is contracted, which are those a multiple of the token's
#: length from its beginning. alone: only the leftmost occurrence may be contracted in this step.
LATER = """
WITH RECURSIVE bpe(n, word, pos, fin, tok, r, best) AS (
  SELECT 0, word, pos, fin, tok, m.key, min(m.key | pos) OVER (PARTITION BY word)
  FROM (SELECT *, lead(tok) OVER w AS next, coalesce(lead(pos) OVER w, pos + 1) AS fin FROM start WINDOW w AS (PARTITION BY word ORDER BY pos))
  LEFT JOIN merges m ON m.pair = (tok::BIGINT << 32) | next
  UNION ALL
  SELECT n, word, pos, fin, tok, m.key, min(m.key | pos) OVER (PARTITION BY word)
  FROM (
    SELECT n + 1 AS n, word, pos, CASE WHEN own THEN coalesce(fin1, fin) ELSE fin END AS fin, CASE WHEN own THEN made ELSE tok END AS tok,
      CASE WHEN own THEN CASE WHEN own2 THEN made ELSE tok2 END WHEN own1 THEN made ELSE tok1 END AS next
    FROM (
      SELECT *, lag(own) OVER w AS own0, lead(own) OVER w AS own1, lead(own, 2) OVER w AS own2
      FROM (
        SELECT *, coalesce(hit AND CASE WHEN max(trapped) OVER (PARTITION BY word) THEN pos = least ELSE (pos - first) % size = 0 END, false) AS own
        FROM (
          SELECT s.*, hit AND (a.pair IS NOT NULL OR b.pair IS NOT NULL OR c.pair IS NOT NULL) AS trapped
          FROM (
            SELECT *, lead(tok) OVER w AS tok1, lead(tok, 2) OVER w AS tok2, lag(tok) OVER w AS tok0, lead(fin) OVER w AS fin1,
              coalesce(max(CASE WHEN hit THEN NULL ELSE fin END) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
            FROM (
              SELECT *, coalesce(r = best & ~2147483647, false) AS hit, (best & 2147483647)::INT AS least, ((best >> 31) & 2047)::INT AS size, (best >> 42)::INT AS made
              FROM bpe WHERE best IS NOT NULL AND n < $steps
            ) WINDOW w AS (PARTITION BY word ORDER BY pos)
          ) s
          LEFT JOIN traps a ON a.pair = CASE WHEN hit THEN (tok0::BIGINT << 32) | made END
          LEFT JOIN traps b ON b.pair = CASE WHEN hit THEN (made::BIGINT << 32) | tok2 END
          LEFT JOIN traps c ON c.pair = CASE WHEN hit THEN (made::BIGINT << 32) | made END
        )
      ) WINDOW w AS (PARTITION BY word ORDER BY pos)
    ) WHERE own0 IS NOT TRUE
  ) LEFT JOIN merges m ON m.pair = (tok::BIGINT << 32) | next
)
SELECT word, pos, tok, best IS NOT NULL AS more FROM bpe WHERE best IS NULL OR n = $steps ORDER BY more, word, pos
"""
DECODING = "SELECT seq, string_agg(v.hex, '' ORDER BY pos) AS hex FROM pieces JOIN vocabulary v USING (tok) GROUP BY seq ORDER BY seq"


def read_ranks(path: str) -> bytes:
    """The rank file as it is; one token and its rank a line."""
    with open(path, "rb") as f:
        return f.read()


class Codes(dict):
    """Words to numbers; an unknown word gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Tokenizer:
    def __init__(self, raw: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        if max(map(len, self.ranks), default=0) >> SIZE_BITS or max(self.ranks.values(), default=0) >> 20:
            raise ValueError("tokens of over 2047 bytes or ranks of over 20 bits don't fit a merge's key")
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        pairs, keys, traps = [], [], []
        self.bond = np.zeros((256, 256), bool)
        for t, r in self.ranks.items():
            seen = np.frombuffer(t, np.uint8)
            self.bond[seen[:-1], seen[1:]] = True
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs.append((a << 32) | b)
                    keys.append((r << SIZE_BITS | len(t)) << POS_BITS)
                    if r < max(a, b):
                        traps.append(pairs[-1])
        for name, columns in (
            ("merges", {"pair": pa.array(pairs, pa.int64()), "key": pa.array(keys, pa.int64())}),
            ("traps", {"pair": pa.array(traps, pa.int64())}),
            ("vocabulary", {"tok": pa.array(list(self.ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in self.ranks], pa.string())}),
        ):
            self.db.register("given", pa.table(columns))
            self.db.execute(f"CREATE TABLE {name} AS FROM given")
            self.db.unregister("given")
        self.known_ids = np.zeros(max(self.ranks.values(), default=0) + 1, bool)
        self.known_ids[list(self.ranks.values())] = True
        self.bytes_of = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self._forget()

    def _forget(self) -> None:
        self.codes = Codes()
        self.ids = pa.array([], pa.list_(pa.int32()))
        self.decoded = pa.array([], pa.large_binary())
        self.uses = np.zeros(0, np.int64)

    def _query(self, sql: str, name: str, table: pa.Table, **values) -> pa.Table:
        self.db.register(name, table)
        try:
            return self.db.sql(sql, params=values or None).to_arrow_table()
        finally:
            self.db.unregister(name)

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of words, by the recursive queries."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        whole = np.zeros(len(flat), bool)
        whole[np.cumsum(lengths) - lengths] = True
        cut = whole.copy()
        cut[1:] |= ~self.bond[flat[:-1], flat[1:]]
        begin = np.flatnonzero(cut)
        owner = (np.cumsum(whole) - 1)[begin]
        part = np.cumsum(cut) - 1
        start = pa.table({"word": part.astype(np.int32), "pos": (np.arange(len(flat)) - begin[part]).astype(np.int32), "tok": self.bytes_of[flat]})
        sql, part_of, toks = FIRST, [], []
        while start.num_rows:
            steps = max(2, ROWS // start.num_rows) if sql is LATER else max(2, min(24, ROWS // start.num_rows))
            got = self._query(sql, "start", start, steps=steps)
            done = int(np.searchsorted(got["more"].to_numpy(), True))
            part_of.append(got["word"].slice(0, done).to_numpy())
            toks.append(got["tok"].slice(0, done).to_numpy())
            start, sql = got.slice(done).select(["word", "pos", "tok"]), LATER
        word, tok = np.concatenate(part_of or [np.empty(0, np.int32)]), np.concatenate(toks or [np.empty(0, np.int32)])
        if len(part_of) > 1:
            order = np.argsort(word, kind="stable")
            word, tok = word[order], tok[order]
        return np.split(tok, np.cumsum(np.bincount(owner[word], minlength=len(words)))[:-1]) if words else []

    def decode_lists(self, lists: pa.ListArray) -> pa.LargeBinaryArray:
        """The bytes of each sequence of ids, by the ordered aggregation."""
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        if len(flat) and not (flat.min() >= 0 and flat.max() < len(self.known_ids) and self.known_ids[flat].all()):
            raise KeyError("an id that the vocabulary lacks")
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        got = self._query(DECODING, "pieces", pa.table({"seq": np.repeat(np.arange(len(lists), dtype=np.int32), lengths), "pos": np.arange(len(flat)) - starts, "tok": flat}))
        raw = got["hex"].to_pylist()
        ends = np.zeros(len(lists) + 1, np.int64)
        ends[got["seq"].to_numpy() + 1] = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.cumsum(ends)), pa.py_buffer(bytes.fromhex("".join(raw)))])

    def _learn(self, words: list[str]) -> None:
        """Append the ids of new words, and what they decode to, in their order."""
        for at in range(0, len(words), BATCH):
            raws = [w.encode() for w in words[at : at + BATCH]]
            found = [self.ranks.get(r) for r in raws]
            merged = iter(self.contract([r for r, f in zip(raws, found) if f is None]))
            made = [next(merged) if f is None else np.array([f], np.int32) for f in found]
            ends = np.zeros(len(made) + 1, np.int32)
            np.cumsum([len(m) for m in made], out=ends[1:])
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made).astype(np.int32, copy=False)))
            self.ids = pa.concat_arrays([self.ids, ids])
            self.decoded = pa.concat_arrays([self.decoded, self.decode_lists(ids)])

    def words(self, lists: list[list[str]]) -> Iterator[tuple[memoryview, memoryview]]:
        """For each list of words its packed ids, little-endian 32-bit integers, and what
        they decode to."""
        known = len(self.codes)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(lists)), np.int64, int(n.sum()))
        self._learn(list(islice(self.codes, known, None)))
        at = np.concatenate(([0], np.cumsum(n)))
        ids, back = self.ids.take(pa.array(codes)), self.decoded.take(pa.array(codes))
        id_at = (ids.offsets.to_numpy()[at].astype(np.int64) * 4).tolist()
        packed = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
        back_at = np.frombuffer(back.buffers()[1], np.int64)[: len(codes) + 1][at].tolist()
        plain = memoryview(back.buffers()[2] or b"")
        self._remember(codes)
        for i in range(len(lists)):
            yield packed[id_at[i] : id_at[i + 1]], plain[back_at[i] : back_at[i + 1]]

    def _remember(self, codes: np.ndarray) -> None:
        """Count uses; forget half of what is remembered once that is too much."""
        uses = np.bincount(codes, minlength=len(self.codes))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        if len(self.codes) > CACHE:
            keep = np.sort(np.argpartition(-uses, CACHE // 2)[: CACHE // 2])
            every = list(self.codes)
            self.codes = Codes(zip([every[i] for i in keep.tolist()], range(len(keep))))
            self.ids, self.decoded, self.uses = self.ids.take(pa.array(keep)), self.decoded.take(pa.array(keep)), uses[keep] // 2

    def cut(self, text: str) -> Iterator[list[str]]:
        """The words of a text, piece by piece. A word that touches the end of a piece may be
        longer, so it starts the next one; a piece of one word alone is taken wider."""
        at, width = 0, PIECE
        while at < len(text):
            if len(text) - at <= width:
                yield self.pattern.findall(text, at)
                return
            found = self.pattern.findall(text, at, at + width)
            size = sum(map(len, found[:-1]))
            if size:
                yield found[:-1]
                at, width = at + size, PIECE
            else:
                width *= 2

    def texts(self, texts: list[str], with_ids: bool = False) -> Iterator[tuple]:
        """For each text: number of ids, their digest, the digest of what they decode to,
        whether that is the text, and the ids if asked for."""
        short: list[str] = []

        def flush() -> Iterator[tuple]:
            if short:
                for text, (ids, back) in zip(short, self.words([self.pattern.findall(t) for t in short])):
                    yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), bytes(back) == text.encode(), np.frombuffer(ids, "<i4") if with_ids else None
                short.clear()

        held = 0
        for text in texts:
            if len(text) <= PIECE:
                short.append(text)
                held += len(text)
                if held >= PIECE:
                    yield from flush()
                    held = 0
                continue
            yield from flush()
            held = n = at = 0
            one, two, intact, kept = hashlib.sha256(), hashlib.sha256(), True, []
            for words in self.cut(text):
                size = sum(map(len, words))
                for ids, back in self.words([words]):
                    one.update(ids)
                    two.update(back)
                    n += len(ids) // 4
                    intact &= bytes(back) == text[at : at + size].encode()
                    if with_ids:
                        kept.append(np.frombuffer(ids, "<i4").copy())
                at += size
            yield n, one.hexdigest(), two.hexdigest(), intact and at == len(text), np.concatenate(kept) if with_ids else None
        yield from flush()


#: One tokenizer for each worker process and vocabulary.
_LOADED: dict[tuple[bytes, str], Tokenizer] = {}


def loaded(raw: bytes, pattern: str) -> Tokenizer:
    key = (hashlib.sha256(raw).digest(), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(raw, pattern)
    return _LOADED[key]


def _vocabulary(df: DataFrame, path: str):
    """The rank file for the executors. It is part of a model and doesn't grow with the data;
    the check proves the bound that a broadcast needs."""
    raw = read_ranks(path)
    if len(raw) > 64 << 20:
        raise ValueError("a rank file of over 64 MiB isn't sent to the executors")
    return df.sparkSession.sparkContext.broadcast(raw)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, intact and, if asked for, ids."""
    raw = _vocabulary(docs, path)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "intact"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(raw.value, pattern)
        for whole in trimmed(batches):
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                rows = list(tokenizer.texts([t.as_py() or "" for t in b.column("text")], with_ids))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]], names=names)

    small_batches(docs.sparkSession)
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, intact boolean" + ", ids array<int>" * with_ids)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every row."""
    return round_trip(docs, path, pattern, id_col, text_col, with_ids=True).select("doc_id", "ids")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded bytes of every row's ids; null ids are empty."""
    raw = _vocabulary(encoded, path)
    own = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(raw.value, pattern)
        for whole in trimmed(batches):
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                ids = pa.array([[-1 if i is None else i for i in x or ()] for x in b.column("ids").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), tokenizer.decode_lists(ids).cast(pa.binary())], names=["doc_id", "bytes"])

    small_batches(encoded.sparkSession)
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, bytes binary")
