"""SimHash near-dedup by deletion-variant signatures.

Fingerprints of 64 bits link at ``2`` differing bits or fewer. The fingerprint is
cut into two segments of 32 bits, so that of any two that link, one segment differs
by at most one bit. Each segment is indexed under its 32 one-wildcard variants (the
segment with one bit cleared, and which bit); fingerprints that link are equal in
some variant, and are found by equality.

Only distinct fingerprints are indexed: copies have been counted before. The pairs of
a variant are verified. Where a variant holds more than ``FEW`` fingerprints the same
is done once more inside it: what the variant doesn't fix is cut into two segments,
of which one differs by at most one bit, too, and the members are indexed under its
one-wildcard variants. Segments halve from 32 to 4 bits, after which a variant can't
hold more than a few hundred fingerprints. No link is lost, no candidate is capped,
and no unbounded group is compared pair by pair.

Defined cases
    * null text: no words, fingerprint zero, linked like any other.
    * fewer words than a shingle has: the whole sequence is the shingle.
    * null doc_id: gets the component of its fingerprint; never names one unless
      every member is null, when component_id is null.
    * repeated rows stay repeated. An empty table gives an empty one.
    * extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, discard, files_for, free_names, in_bitmap, materialize, quoted, row_key, small_batches, trimmed
from .graph import components
from .substring import MULTIPLIERS, windows, word_hashes

SEED = 42
#: Shingles whose bits are counted at a time, whatever the length of the text.
BLOCK = 1 << 16
#: Fingerprints of a variant whose pairs are verified at once.
FEW = 48


def shingles(text: bytes, k: int) -> list[bytes]:
    """Lower-cased A-Z; words between ASCII white space; k-word shingles with repeats."""
    words = text.lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-k] + 1)).tolist()
    return [line[a:b] for a, b in zip(starts, ends[k - 1 :].tolist())]


def fingerprint(text: bytes, k: int, seed: int = SEED) -> int:
    """As a signed 64-bit integer."""
    parts = shingles(text, k)
    if not parts:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(parts), BLOCK):
        raw = b"".join([xxhash.xxh64_digest(x, seed) for x in parts[at : at + BLOCK]])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(parts)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            texts = b.column("text").cast(pa.large_binary())
            made = [fingerprint(t.as_py() or b"", shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.int64())], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, fp long")


def variants(rows: DataFrame, key: str, low: str, bits: int) -> DataFrame:
    """fp, key, free: each row under its one-wildcard variants of two segments of ``bits``
    bits, the lower one beginning at bit ``low``. key is a hash of the key so far, of
    segment and wildcard, and of the segment with that bit cleared; free: where the
    other segment begins. Equal keys by chance cost a comparison and nothing else."""
    made = f"""transform(sequence(0, {2 * bits - 1}), j -> named_struct(
        'key', xxhash64({key}, j, shiftrightunsigned(fp, {low} + {bits} * cast(j div {bits} as int)) & {(1 << bits) - 1} & ~shiftleft(cast(1 as bigint), j % {bits})),
        'free', cast({low} + {bits} * (1 - cast(j div {bits} as int)) as int)))"""
    return rows.select("fp", F.explode(F.expr(made)).alias("v")).select("fp", "v.key", "v.free")


def links(fps: DataFrame, max_distance: int = 2) -> DataFrame:
    """a, b: all links among distinct fingerprints (column fp): the pairs that differ by
    ``max_distance`` (at most 3) bits or fewer."""
    if not 0 < max_distance <= 3:
        raise ValueError("two segments find links of at most three differing bits")
    few = files_for(fps.sparkSession, 64 * fps.count())
    # a fingerprint becomes 64 rows: dealt out first, so that no task holds many of them
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index, bits, found = variants(fps.repartition(tasks, "fp"), "0", "0", 32), 32, None
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    while True:
        keys = materialize(index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "simhash-keys", few)
        members = materialize(index.join(keys.where("n > 2").select("key", "n").hint("merge"), "key"), "simhash-members", few)
        small = members if bits == 4 else members.where(F.col("n") <= FEW)
        pairs = small.select("key", F.col("fp").alias("a")).join(small.select("key", F.col("fp").alias("b")), "key").where("a < b").select("a", "b").where(near)
        level = materialize(keys.where("n = 2").select("a", "b").where(near).unionByName(pairs).distinct(), "simhash-links", few)
        found = level if found is None else found.unionByName(level)
        discard(keys)
        if bits == 4 or members.where(F.col("n") > FEW).isEmpty():
            return found.distinct()
        bits //= 2
        index = variants(members.where(F.col("n") > FEW), "key", "free", bits)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable by links."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    few = files_for(docs.sparkSession, rows.count())
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-fps", few)
    edges = links(fps, max_distance)
    roots = components(edges)
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "simhash-roots", few)
    discard(edges, roots, fps)
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    lookup = materialize(named.join(smallest, "root").select("fp", "component_id"), "simhash-lookup", few)
    discard(named)
    return rows.join(lookup, "fp").select("doc_id", "fp", "component_id")


#: Of similar_groups: the share of all shingle hashes, from the smallest on, in which keys are
#: looked for first; members from which on a key is crowded; passes in which shingles are counted,
#: which bounds the disk; rounds of comparing with some members of a key before all that is left
#: is compared, and how many members; the block size in which members of a key outside its main
#: group are dealt out; shingle sets sent on at a time.
ZONE, CROWD, PASSES, ROUNDS, HEADS, DEAL, SENT = 0.4, 64, 2, 4, 8, 1000, 250


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """A 64-bit hash of every shingle, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    return windows(hashes, min(k, len(words)), MULTIPLIERS[0])


def simhash_of(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of shingle hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def least_shared(n: int, similarity: float) -> int:
    """How many shingles a set of n shares with any that is similar, at least."""
    return int(np.ceil(similarity * n - 1e-6))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, row_key, the text's content (c1, c2) and its fingerprint fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            rows = []
            for t in b.column("text").cast(pa.large_binary()):
                text = t.as_py() or b""
                raw = xxhash.xxh3_128_digest(b" ".join(text.lower().split()))
                rows.append((int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True), simhash_of(shingle_hashes(text, shingle))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), *[pa.array(c, pa.int64()) for c in zip(*rows)]], names=["doc_id", "row_key", "c1", "c2", "fp"])

    return docs.mapInArrow(run, "doc_id long, row_key long, c1 long, c2 long, fp long")


def key_rows(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """row_key, the number n of distinct shingles, and those (own) that can be keys, see
    ``prefixes``. Worked out a second time, as only texts that aren't copies need them and
    they are larger than the texts."""
    zone = np.uint64(int(ZONE * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in trimmed(batches):
            for start in range(0, whole.num_rows, SENT):
                b = whole.slice(start, SENT)
                sets = [np.unique(shingle_hashes(t.as_py() or b"", shingle)) for t in b.column("text").cast(pa.large_binary())]
                owns = [own[: max(int(np.searchsorted(own, zone)), len(own) - least_shared(len(own), similarity) + 1) if len(own) else 0].view(np.int64) for own in sets]
                yield pa.RecordBatch.from_arrays([b.column("row_key"), pa.array(list(map(len, sets)), pa.int64()), pa.array(owns, pa.list_(pa.int64()))], names=["row_key", "n", "own"])

    return docs.select("row_key", "text").mapInArrow(run, "row_key long, n long, own array<long>")


def shingle_rows(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """row_key and the shingle set of the wanted rows, repeated ones once. A bitmap of fixed
    size rules most of the others out where the texts are, before anything is moved."""
    bits = bitmap(wanted, "row_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in trimmed(batches):
            keys = whole.column("row_key").to_numpy()
            whole = whole.filter(pa.array(in_bitmap(bits.value, keys)))
            for at in range(0, whole.num_rows, SENT):
                b = whole.slice(at, SENT)
                sets = [np.unique(shingle_hashes(t.as_py() or b"", shingle)).view(np.int64) for t in b.column("text").cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([b.column("row_key"), pa.array(sets, pa.list_(pa.int64()))], names=["row_key", "own"])

    made = docs.select("row_key", "text").mapInArrow(run, "row_key long, own array<long>")
    return made.join(wanted, "row_key", "left_semi").dropDuplicates(["row_key"])


def prefixes(every: DataFrame, similarity: float, files: int | None = None) -> DataFrame:
    """h, row_key, n, pos, share: the rarest shingles of each set, so many that any two sets
    of that similarity have one of them in common.

    Such sets share ``least = ceil(similarity * n)`` shingles or more of either's n; so
    in one order of all shingles the first n - least + 1 of both meet. The order: those
    of the zone (the smallest hashes) from rare to common, then the others by hash.
    ``own`` holds a set's share of the zone or, where that is less, its first n - least + 1
    shingles, all of which are filed then. Shingles of one set alone are counted in but
    not filed. pos: the shingle's place in that order (1, where shingles outside the zone
    make it unknown); share: the share of ``own`` that others have too.
    """
    each = every.select("row_key", "n", F.size("own").alias("e"), F.explode("own").alias("h"))
    shared = None
    for k in range(PASSES):
        part = each.where(F.pmod("h", F.lit(PASSES)) == k)
        common = materialize(part.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "similar-common", files)
        done = materialize(part.join(common, "h"), "similar-shared", files)
        discard(common)
        shared = done if shared is None else shared.unionByName(done)
    mine = Window.partitionBy("row_key")
    least = F.ceil(F.col("n") * similarity - 1e-6)
    counted = shared.withColumn("s", F.count(F.lit(1)).over(mine))
    placed = counted.withColumn("at", F.row_number().over(mine.orderBy("df", "h")))
    alone, prefix = F.col("e") - F.col("s"), F.col("n") - least + 1
    pos = F.when((F.col("e") > prefix) | (F.col("e") == F.col("n")), alone + F.col("at")).otherwise(1)
    return placed.where(F.col("at") <= prefix - alone).select("h", "row_key", "n", pos.cast("long").alias("pos"), (F.col("s") / F.col("e")).alias("share"))


def without_crowds(filed: DataFrame, sets: DataFrame, similarity: float, files: int | None = None) -> DataFrame:
    """``filed`` without its crowded keys. Two sets that meet only there both have a crowded key;
    such sets are filed once more by all their shingles, counted among themselves, so that
    a passage which many texts hold is no key of a text that has enough else. Keys of the
    second filing are told apart from those of the first."""
    crowded = materialize(filed.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CROWD).select("h"), "similar-crowded", files)
    again = materialize(filed.join(crowded, "h", "left_semi").select("row_key").distinct(), "similar-again", files)
    every = sets.join(again, "row_key", "left_semi").select("row_key", F.size("own").cast("long").alias("n"), "own")
    second = prefixes(every, similarity, files).withColumn("h", F.xxhash64("h", F.lit(2)))
    return filed.join(crowded, "h", "left_anti").select("h", "row_key", "n", "pos", "share").unionByName(second)


def side(k: str) -> list[Column]:
    """A member of a key as one side of a pair."""
    return [F.col("row_key").alias(k), F.col("n").alias("n" + k), F.col("pos").alias("p" + k)]


def possible(similarity: float) -> Column:
    """Whether two sides can be similar, as their sizes (n) and the key's places (p) tell: what
    two sets share begins with the first key that they have in common, so after that key
    enough must be left of either."""
    close = F.least("na", "nb") >= similarity * F.greatest("na", "nb")
    shared = F.ceil(similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-6)
    return close & (1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= shared)


def across(filed: DataFrame, similarity: float, files: int | None = None) -> DataFrame:
    """x, y: all pairs under a key (h) of members of two roots that are ``possible``. The members
    of a key's largest root are not compared with each other."""
    parts = filed.groupBy("h", "root").agg(F.count(F.lit(1)).alias("m"))
    mains = parts.groupBy("h").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("all"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    mains = materialize(mains.select("h", F.col("main.root").alias("main"), F.ceil((F.col("all") - F.col("main.m")) / DEAL).alias("blocks")), "similar-mains", files)
    met = filed.join(mains, "h")
    few = met.where("root <> main").select("h", F.pmod("row_key", "blocks").alias("block"), F.col("root").alias("ra"), *side("a"))
    all_ = met.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("root").alias("rb"), *side("b"))
    return few.join(all_, ["h", "block"]).where((F.col("ra") != F.col("rb")) & possible(similarity)).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 2) -> DataFrame:
    """doc_id, row_key, component_id: the groups that links between all texts whose sets of
    ``shingle``-word shingles have a Jaccard similarity of ``similarity`` or more make.
    row_key is ``row_key()`` of the row.

    At 0.8 the fingerprints of two texts differ in 5 to 14 bits, more than segments
    that are still selective allow. So the links of the fingerprint index are joined by
    candidates that share a key, one of their rarest shingles (``prefixes`` and
    ``without_crowds``: no similar pair is without one), and every link is verified on
    the shingle sets. Under a key of at most ``HEADS`` members all pairs are compared, of which
    sizes and places rule most out (``possible``). Under a larger one all are first compared
    with ``HEADS`` of them: the one that has most in common with others, which the original of a group is, and some by
    chance; those similar to none go on to a next round with others. After
    ``ROUNDS`` such rounds all pairs under a key that no link has joined so far
    are compared (``across``), so that no link between two groups is lost.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumn("row_key", row_key("doc_id", "text"))
    rows = materialize(signatures(texts, shingle), "similar-rows")
    few = files_for(docs.sparkSession, rows.count())
    # ids of contents: the row_key of the representative
    chosen = materialize(rows.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "row_key", "fp")).alias("r")).select("c1", "c2", "r.*"), "similar-contents", few)
    prints = materialize(chosen.groupBy("fp").agg(F.min("row_key").alias("row_key")), "similar-prints", few)
    edges = links(prints.select("fp"), max_distance)
    left, right = prints.select(F.col("fp").alias("a"), F.col("row_key").alias("x")), prints.select(F.col("fp").alias("b"), F.col("row_key").alias("y"))
    near = edges.join(left, "a").join(right, "b").select("x", "y")
    same = chosen.select("fp", F.col("row_key").alias("y")).join(prints.select("fp", F.col("row_key").alias("x")), "fp").where("x <> y").select("x", "y")
    near = materialize(near.unionByName(same).distinct(), "similar-near", few)
    discard(edges, prints)
    every = key_rows(texts, similarity, shingle).join(chosen.select("row_key").hint("merge"), "row_key", "left_semi").dropDuplicates(["row_key"])
    every = materialize(every, "similar-every")
    many = files_for(docs.sparkSession, every.agg(F.sum(F.size("own"))).first()[0] or 0, 500_000)
    first = materialize(prefixes(every, similarity, many), "similar-keys", many)
    discard(every)
    # a text without a key has no partner
    wanted = materialize(first.select("row_key", "n").distinct(), "similar-sizes", few)
    sets = materialize(shingle_rows(texts, wanted.select("row_key"), shingle), "similar-sets")
    filed = materialize(without_crowds(first, sets, similarity, many), "similar-keys", many)
    discard(first)

    def verified(pairs: DataFrame) -> DataFrame:
        """x, y of the pairs that are similar; sizes rule most of the others out first."""
        sized = pairs.join(wanted.select(F.col("row_key").alias("x"), F.col("n").alias("nx")), "x").join(wanted.select(F.col("row_key").alias("y"), F.col("n").alias("ny")), "y")
        close = F.least("nx", "ny") >= similarity * F.greatest("nx", "ny")
        met = sized.where(close).join(sets.select(F.col("row_key").alias("x"), F.col("own").alias("ox")), "x").join(sets.select(F.col("row_key").alias("y"), F.col("own").alias("oy")), "y")
        both = F.size(F.array_intersect("ox", "oy"))
        return met.where(both >= similarity * (F.col("nx") + F.col("ny") - both) - 1e-9).select("x", "y")

    found = materialize(verified(near), "similar-links", many)
    counted = materialize(filed.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "similar-counts", many)
    known = materialize(filed.join(counted, "h"), "similar-filed", many)
    discard(filed, counted)
    small, large = known.where(F.col("m") <= HEADS), known.where(F.col("m") > HEADS)
    pairs = small.select("h", *side("a")).join(small.select("h", *side("b")), "h").where((F.col("a") < F.col("b")) & possible(similarity))
    found = found.unionByName(materialize(verified(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()), "similar-links", many))
    rest, spent = large, [near]
    for turn in range(ROUNDS):
        by_chance = [F.min(F.struct(F.xxhash64("row_key", F.lit(turn * HEADS + i)).alias("o"), "row_key")).alias(f"c{i}") for i in range(1, HEADS)]
        most = large.groupBy("h").agg(F.max(F.struct("share", "row_key")).alias("c0"), *by_chance)
        heads = materialize(most.select("h", F.explode(F.array_distinct(F.array(*[f"c{i}.row_key" for i in range(HEADS)]))).alias("x")), "similar-heads", many)
        met = rest.join(heads, "h").where("row_key <> x").select(F.least("x", "row_key").alias("x"), F.greatest("x", "row_key").alias("y")).distinct()
        true = materialize(verified(met), "similar-links", many)
        found = found.unionByName(true)
        linked = materialize(true.select("x").unionByName(true.select(F.col("y").alias("x"))).distinct(), "similar-linked", many)
        rest = materialize(rest.join(linked, F.col("row_key") == F.col("x"), "left_anti"), "similar-rest", many)
        spent += [heads, linked, rest]
        if rest.isEmpty():
            break
    discard(*spent)
    joined = components(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    placed = materialize(large.join(joined, F.col("row_key") == F.col("node"), "left").select("h", "row_key", "n", "pos", F.coalesce("root", "row_key").alias("root")), "similar-placed", many)
    discard(known, joined)
    pairs = materialize(across(placed, similarity, many), "similar-pairs", many)
    discard(placed)
    found = found.unionByName(materialize(verified(pairs), "similar-links", many))
    discard(pairs, sets, wanted)
    roots = components(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = materialize(chosen.join(roots, F.col("row_key") == F.col("node"), "left").select("c1", "c2", "doc_id", F.coalesce("root", "row_key").alias("root")), "similar-roots", few)
    discard(found, roots, chosen)
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    lookup = materialize(named.join(smallest, "root").select("c1", "c2", "component_id"), "similar-lookup", few)
    discard(named)
    return rows.join(lookup, ["c1", "c2"]).select("doc_id", "row_key", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for near-duplicates: of each group the one with the
    smallest doc_id stays (repeated rows of it stay together; of rows with that id and
    another text, all stay). A null doc_id stays only in a group without any other.
    Extra columns, whatever their names, stay as they are."""
    groups = similar_groups(docs, similarity, shingle, id_col, text_col)
    gone = materialize(groups.where("component_id is not null and not (doc_id <=> component_id)").select("doc_id", "row_key").distinct(), "similar-gone")
    own = docs.withColumns({k: c for k, c in zip(free_names(docs, "id", "key"), (docs[id_col].cast("long"), row_key(docs[id_col].cast("long"), docs[text_col])))})
    kept = own.join(gone, own[own.columns[-2]].eqNullSafe(gone["doc_id"]) & (own[own.columns[-1]] == gone["row_key"]), "left_anti")
    return kept.select(*[own[quoted(c)] for c in docs.columns])
