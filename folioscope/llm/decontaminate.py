"""Benchmark decontamination by template canonicalisation.

Texts become templates: words are lower-cased and lose the marks around them;
numbers, names (capitalised words inside a sentence) and units (after a number)
become typed placeholders. A capitalised word at the start of a sentence or line may be
a name or not: a text has a template with all of them as words, one with all of them as
names, and one with those as names that the text also has inside a sentence. Windows of
``window`` template tokens of the benchmark items are looked up in every document, and
hits are checked slot by slot: along one alignment of document and item, an item's
number, name or unit must stand for one and the same value of the document wherever it
returns; windows with one that doesn't are dropped. So a question asked again with other
numbers is found, and an accidental match of placeholders isn't. A window with fewer than
``PLAIN`` plain words says nothing without its values: it is looked up with them, so an
item of numbers alone matches only the same numbers.

A document is contaminated by an item if consistent hits cover at least ``share`` of
the item's windows. Items shorter than a window are one window of their length.

The benchmark is the stated query set. Its window hashes are looked up in blocks of
``BLOCK``, each a sorted array of fixed size that is broadcast, one after another; so the documents'
windows stay where they are and only hits are shuffled. Items with one template
are looked up once.

Defined cases
    * null or empty texts and items: no template; never contaminated, never a match.
    * items under ``least`` template tokens carry too little to tell and match nothing.
    * null doc_id: judged like any other. Repeated rows: each judged alike.
    * an empty benchmark: nothing is contaminated. An empty table: an empty result.
    * item ids of any type that has an order; the smallest of equally good ones is named.
    * extra columns are ignored by ``find`` and stay as they are in ``clean`` and ``judge``,
      but for one named like a result of ``judge``, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, discard, free_names, materialize, quoted, row_key, small_batches, trimmed
from .substring import MULTIPLIERS, windows

WINDOW = 8
LEAST = 5
SHARE = 0.5
PLAIN = 3
BLOCK = 1_000_000
#: Distinct words whose canonical form a worker remembers.
CACHE = 300_000
#: Marks that stand around words, and units.
MARKS = ".,;:!?\"'()[]{}<>«»„“”‘’…"
ENDS = (".", "!", "?", ":", "…")
UNITS = frozenset("mm cm m km in inch inches ft feet yd yards mile miles mg g kg t ton tons lb lbs oz ml l litre litres liter liters s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz b kb mb gb tb w kw mw v a j kj cal kcal c f k pa kpa bar mph km/h kph m/s % percent usd eur gbp dollar dollars euro euros cent cents degree degrees".split())
NUMBER, NAME, UNIT, BY_VALUE = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\0number", b"\0name", b"\0unit", b"\0value"))
KINDS = {1: "number:", 2: "name:", 3: "unit:"}


class Words(dict):
    """Words to numbers, and what is known of each word, in arrays by that number. Number 0
    is the end of a line. flags: kind (0 word, 1 number, 3 unit), 4 for a capital, 8 for an end."""

    def __init__(self):
        self.bare: list[str] = []
        self.hash, self.flags = np.zeros(1024, np.uint64), np.zeros(1024, np.int8)
        self._hashes: list[int] = []
        self._flags: list[int] = []
        self["\0"]  # noqa: B018

    def __missing__(self, raw: str) -> int:
        self[raw] = n = len(self)
        if raw.islower() and raw.isalpha():
            low, flags = raw, 3 if raw in UNITS else 0
        else:
            bare = raw.strip(MARKS)
            low = bare.lower()
            number = low.replace(",", "").replace(".", "").lstrip("+-$€£").rstrip("%").isdecimal()
            flags = 1 if number else 3 if low in UNITS else 0
            flags |= 4 * (bare[:1].isupper() and bare[1:2].islower()) | 8 * raw.rstrip("\"')]}»”’").endswith(ENDS)
        self.bare.append(low)
        self._hashes.append(xxhash.xxh3_64_intdigest(low or raw))
        self._flags.append(flags)
        return n

    def numbered(self, raws: list[str]) -> np.ndarray:
        """The words' numbers; what is known of new ones is in the arrays afterwards."""
        codes = np.fromiter(map(self.__getitem__, raws), np.int64, len(raws))
        if self._hashes:
            begin = len(self) - len(self._hashes)
            while len(self) > len(self.hash):
                self.hash, self.flags = (np.concatenate((x, np.zeros_like(x))) for x in (self.hash, self.flags))
            self.hash[begin : len(self)] = np.array(self._hashes, np.uint64)
            self.flags[begin : len(self)] = self._flags
            self._hashes.clear()
            self._flags.clear()
        return codes


class Template:
    """A text's tokens: hashes of the words and of the template, and the kind of each slot (0
    none, 1 number, 2 name, 3 unit). starts: capitalised words at the start of a sentence or
    line, which are no slots yet."""

    def __init__(self, text: str, words: Words):
        codes = words.numbered(text.replace("\n", " \0 ").split())
        fresh = np.concatenate(([True], codes == 0))[:-1]
        inside = codes != 0
        codes, fresh = codes[inside], fresh[inside]
        self.words, self.codes = words, codes
        flags = words.flags[codes]
        kind, capital, ends = flags & 3, (flags & 4) > 0, (flags & 8) > 0
        number = kind == 1
        unit = (kind == 3) & ~fresh & np.concatenate(([False], number))[:-1]
        ended = fresh | np.concatenate(([True], ends))[:-1]
        capital &= ~number & ~unit
        self.kinds = np.where(number, 1, np.where(unit, 3, np.where(capital & ~ended, 2, 0))).astype(np.int8)
        self.starts = np.flatnonzero(capital & ended)
        self.literal = words.hash[codes]
        self.hashes = self.filled(self.kinds)

    def __len__(self) -> int:
        return len(self.codes)

    def filled(self, kinds: np.ndarray) -> np.ndarray:
        out = self.literal.copy()
        for k, placeholder in ((1, NUMBER), (2, NAME), (3, UNIT)):
            out[kinds == k] = placeholder
        return out

    def value(self, at: int, kinds: np.ndarray) -> str:
        return KINDS[int(kinds[at])] + self.words.bare[self.codes[at]]

    def slots(self, begin: int, length: int, kinds: np.ndarray) -> list[dict]:
        return [{"at": int(a), "value": self.value(begin + int(a), kinds)} for a in np.flatnonzero(kinds[begin : begin + length])]

    def windows(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions and hashes of the windows of each template, with its slots' kinds: all of
        the first one's, of the others those that differ from it."""
        if len(self) < length:
            return
        plainly = windows(self.literal, length, MULTIPLIERS[1]) ^ BY_VALUE

        def hashed(hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
            slots = np.cumsum(np.concatenate(([0], kinds != 0)))
            few = length - (slots[length:] - slots[:-length]) < PLAIN
            return np.where(few, plainly, windows(hashes, length, MULTIPLIERS[1]))

        yield np.arange(len(plainly)), hashed(self.hashes, self.kinds), self.kinds
        if not len(self.starts):
            return
        bare, codes = self.words.bare, self.codes
        names = {bare[c] for c in codes[self.kinds == 2].tolist()}
        known = self.starts[[bare[c] in names for c in codes[self.starts].tolist()]]
        for at in [self.starts] + [known] * (0 < len(known) < len(self.starts)):
            kinds = self.kinds.copy()
            kinds[at] = 2
            steps = np.zeros(len(self) + 1, np.int64)
            np.add.at(steps, np.maximum(at - length + 1, 0), 1)
            np.add.at(steps, at + 1, -1)
            places = np.flatnonzero(np.cumsum(steps)[: len(plainly)])
            yield places, hashed(self.filled(kinds), kinds)[places], kinds


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int, least: int) -> DataFrame:
    """template, h, length, item_pos, n_windows and slots of each window of each distinct
    template; items says which items have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in trimmed(batches):
            rows = []
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                made = Template(text or "", words)
                if len(made) < least:
                    continue
                length = min(window, len(made))
                name = xxhash.xxh3_64_intdigest(made.hashes.tobytes() + made.literal.tobytes()) - 2**63
                for places, found, kinds in made.windows(length):
                    for p, h in zip(places.tolist(), found.view(np.int64).tolist()):
                        rows.append((item, name, h, length, p, len(made) - length + 1, made.slots(p, length, kinds)))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [b.schema.field("item_id").type, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.struct([("at", pa.int32()), ("value", pa.string())]))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["item_id", "template", "h", "length", "item_pos", "n_windows", "item_slots"])

    own = benchmark.select(benchmark[id_col].alias("item_id"), benchmark[text_col].alias("text"))
    kind = own.schema["item_id"].dataType.simpleString()
    return own.mapInArrow(run, f"item_id {kind}, template long, h long, length int, item_pos int, n_windows int, item_slots array<struct<at:int,value:string>>")


def _blocks(keys: DataFrame) -> Iterator[dict[int, np.ndarray]]:
    """The distinct (length, h), in blocks of a fixed number of hashes."""
    held: dict[int, list[int]] = {}
    n = 0
    for r in keys.select("length", "h").distinct().toLocalIterator():
        held.setdefault(r["length"], []).append(r["h"])
        n += 1
        if n == BLOCK:
            yield {k: np.sort(np.array(v, np.int64)) for k, v in held.items()}
            held, n = {}, 0
    if n:
        yield {k: np.sort(np.array(v, np.int64)) for k, v in held.items()}


def document_hits(docs: DataFrame, sent, id_col: str, text_col: str) -> DataFrame:
    """row_key, doc_id, h, length, doc_pos, doc_slots of the windows that are in the broadcast block."""
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("row_key", row_key("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in trimmed(batches):
            ids, keys, rows = b.column("doc_id").to_pylist(), b.column("row_key").to_pylist(), []
            for i, text in enumerate(b.column("text")):
                if len(words) > CACHE:
                    words = Words()
                made = Template(text.as_py() or "", words)
                for length, wanted in sent.value.items():
                    for places, found, kinds in made.windows(length):
                        found = found.view(np.int64)
                        at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                        for j in np.flatnonzero(wanted[at] == found).tolist():
                            p = int(places[j])
                            rows.append((keys[i], ids[i], int(found[j]), length, p, made.slots(p, length, kinds)))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), b.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("at", pa.int32()), ("value", pa.string())]))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["row_key", "doc_id", "h", "length", "doc_pos", "doc_slots"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"row_key long, doc_id {kind}, h long, length int, doc_pos int, doc_slots array<struct<at:int,value:string>>")


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """row_key, doc_id, template, item_id, n_items, share: the contaminated rows of ``docs``, with
    each template that contaminates them, the smallest item that has it, and how many do."""
    small_batches(docs.sparkSession)
    items = materialize(item_windows(benchmark, item_col, item_text_col, window, least), "bench-windows")
    whole = items.groupBy("template").agg(F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("n_items"))
    asked = items.groupBy("template", "h", "length", "item_pos", "n_windows").agg(F.min("item_slots").alias("item_slots"))
    asked = materialize(asked.join(whole, "template"), "bench-templates")
    hits = None
    for block in _blocks(asked):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        more = materialize(document_hits(docs, sent, id_col, text_col).distinct(), "bench-hits")
        sent.destroy()
        hits = more if hits is None else hits.unionByName(more)
    if hits is None:
        kind = docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"row_key long, doc_id {kind}, template long, item_id {items.schema['item_id'].dataType.simpleString()}, n_items long, share double")
    met = hits.join(asked, ["length", "h"]).withColumn("diagonal", F.col("doc_pos") - F.col("item_pos"))
    lined = ["row_key", "doc_id", "template", "item_id", "n_items", "n_windows", "diagonal"]
    # slots along one alignment: a value of the item that stands for two of the document speaks against it
    pairs = met.select(*lined, F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("s")).select(*lined, F.col("s.item_slots.value").alias("theirs"), F.col("s.doc_slots.value").alias("ours"))
    torn = pairs.groupBy(*lined, "theirs").agg(F.min("ours").alias("a"), F.max("ours").alias("b")).where("a <> b or split_part(a, ':', 1) <> split_part(theirs, ':', 1)").groupBy("row_key", "template", "diagonal").agg(F.collect_set("theirs").alias("torn"))
    torn = materialize(torn, "bench-torn")
    # only the windows that hold such a value are dropped
    good = met.join(torn, ["row_key", "template", "diagonal"], "left").where("torn is null or not arrays_overlap(torn, item_slots.value)")
    covered = good.groupBy("row_key", "doc_id", "template", "item_id", "n_items", "n_windows").agg(F.count_distinct("item_pos").alias("n"))
    found = covered.withColumn("share", F.col("n") / F.col("n_windows")).where(F.col("share") >= share).select("row_key", "doc_id", "template", "item_id", "n_items", "share")
    found = materialize(found, "bench-found")
    discard(items, asked, hits, torn)
    return found


RESULTS = ["_contaminated", "_items", "_item_id", "_share"]


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` with ``_contaminated``, ``_items`` (how many items) and the
    item that covers most (``_item_id``, the smallest of equals) with its ``_share``."""
    found = find(docs, benchmark, id_col, text_col, **more)
    key, at, n, top = free_names(docs, "key", "at", "n", "top")
    best = found.groupBy(F.col("row_key").alias(key), F.col("doc_id").alias(at)).agg(F.sum("n_items").alias(n), F.min(F.struct((-F.col("share")).alias("s"), "item_id")).alias(top))
    best = materialize(best, "bench-rows")
    own = docs.withColumn(key, row_key(docs[quoted(id_col)], docs[quoted(text_col)]))
    joined = own.join(best, (own[key] == best[key]) & own[quoted(id_col)].eqNullSafe(best[at]), "left").drop(best[key])
    results = (F.col(n).isNotNull(), F.coalesce(n, F.lit(0)), F.col(top)["item_id"], -F.col(top)["s"])
    return joined.select(*carried(docs, RESULTS), *[c.alias(name) for name, c in zip(RESULTS, results)])


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    found = find(docs, benchmark, id_col, text_col, **more)
    key, at = free_names(docs, "key", "at")
    gone = materialize(found.select(F.col("row_key").alias(key), F.col("doc_id").alias(at)).distinct(), "bench-gone")
    own = docs.withColumn(key, row_key(docs[quoted(id_col)], docs[quoted(text_col)]))
    kept = own.join(gone, (own[key] == gone[key]) & own[quoted(id_col)].eqNullSafe(gone[at]), "left_anti")
    return kept.select(*[F.col(quoted(c)) for c in docs.columns])
