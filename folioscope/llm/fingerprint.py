"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs are its lines, cut after ``PIECE`` characters where longer. Each
distinct paragraph's 64-bit digest goes to one cell of each of three tables; a cell
holds a count, the XOR of its digests and the XOR of their checks. The fingerprint
is the cells in order, in base64. Sketches of two versions subtract cell by cell;
what is left is peeled: a cell of count +1 or -1 whose check fits its digest gives a
digest that one version alone has, and takes it out of the other tables. If cells
are left, the pair is tried again with four times the cells and other hashes, until
none are. A pair whose numbers of paragraphs alone differ by more than a sketch has cells
can't be peeled and waits for a larger one.

The likeness of two texts is the Jaccard similarity that the recovered digests
imply: (a + b - d) / (a + b + d) of a and b paragraphs with d recovered. Fingerprints have
one size; pairs that needed larger sketches say so in ``cells_edited`` and ``cells_next``.

The version compared with is an edit that takes its second half from the next
document in descending order of doc_id, so each text is shuffled once, to its place
in that order: by ranges of doc_id, within which a window looks ahead; the last row of
a range gets its neighbour by a join of range ends. Ranges lie between percentiles of the
ids, so ids far apart or crowded don't matter; an id that many rows share, null included,
is a range of its own, which is split by the hash that orders its rows. DataFrame
functions only. All rounds of peeling group by document first, and the sketches
come partitioned so: peeling moves nothing.

Defined cases
    * null text: the empty text, without paragraphs; two empty texts have likeness 1.
    * blank lines are no paragraphs; repeated paragraphs count once.
    * null doc_id: after all others. Equal doc_ids: in order of a hash of the text;
      each row's next one is the row that follows.
    * a single row is its own next document. An empty table gives an empty one.
    * extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, files_for, materialize

PIECE = 200
#: Cells of each of the three tables in a fingerprint; what a retry multiplies them by.
WIDTH, GROW = 16, 4
TABLES = 3
#: Sweeps over the three tables before a pair counts as failed.
SWEEPS = 4
#: Rows of a range, percentiles that are asked for at most, and ranges of a range of ranges.
RANGE, CUTS, FAN = 256, 4096, 1024


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    pieces = F.regexp_extract_all(text, F.lit(f"([^\\n]{{1,{PIECE}}})"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(pieces, lambda p: F.trim(p) != ""), lambda p: F.xxhash64(p)))


def cell(digest: Column, table: int, width: int, attempt: int) -> Column:
    return (F.pmod(F.xxhash64(digest, F.lit(table * 100 + attempt)), F.lit(width)) + table * width).cast("int")


def check(digest: Column) -> Column:
    return F.hash(digest, F.lit(7919))


def _next_range(ranges: DataFrame) -> DataFrame:
    """b, next: for each range number the next lower one that has rows. Level by level,
    so that no task sees more than FAN ranges at a time."""
    edge = ranges.select(F.col("b"), F.col("b").alias("top"))
    levels = []
    for _ in range(7):
        g = F.floor(F.col("b") / FAN)
        w = Window.partitionBy("g").orderBy(F.desc("b"))
        ahead = edge.withColumn("g", g).withColumn("next", F.lead("top").over(w))
        levels.append(ahead)
        edge = ahead.groupBy("g").agg(F.max("top").alias("top")).select(F.col("g").alias("b"), "top")
    found = levels[-1].select("b", "next")
    for level in reversed(levels[:-1]):
        up = found.select(F.col("b").alias("g"), F.col("next").alias("up"))
        found = level.join(up, "g", "left").select("b", F.coalesce("next", "up").alias("next"))
    return found


def range_number(own: DataFrame) -> Column:
    """A number for each row, from its doc_id and the hash ``tie`` of its text: rows in order of
    (doc_id descending, nulls last, tie) have falling numbers, each for some RANGE rows.

    The percentiles (at most CUTS, so their list is bounded) are searched by halving; between
    two of them ids are dealt out evenly, and rows of an id that is a percentile twice
    or more, by their hash."""
    total = own.count()
    asked = max(1, min(CUTS, -(-total // RANGE)))
    cuts = own.agg(F.percentile_approx("doc_id", [i / asked for i in range(asked + 1)], 20 * CUTS)).first()[0] or [0]
    subs = max(1, -(-total // (asked * RANGE)))  # ranges between two percentiles
    ties = max(1, -(-total // RANGE))  # ranges of one hot id, at most
    array = "cast(split('" + ",".join(map(str, cuts)) + "', ',') as array<bigint>)"
    steps, step = [], 1
    while step <= len(cuts):
        steps.insert(0, step)
        step *= 2
    # how many percentiles are at most doc_id
    at = f"aggregate(array({', '.join(map(str, steps))}), 0, (n, s) -> if(n + s <= {len(cuts)} and get({array}, n + s - 1) <= doc_id, n + s, n))"
    low, high = f"cast(coalesce(get({array}, cut - 1), doc_id) as double)", f"cast(coalesce(get({array}, cut), doc_id) as double)"
    sub = f"cast(least({subs - 1}, greatest(0, floor((cast(doc_id as double) - {low}) / greatest(1, {high} - {low}) * {subs}))) as bigint)"
    hot = f"(doc_id is null or (get({array}, cut - 1) = doc_id and get({array}, cut - 2) = doc_id))"
    tie = f"cast(least({ties - 1}, greatest(0, floor((cast(tie as double) / 18446744073709551616 + 0.5) * {ties}))) as bigint)"
    within = f"if({hot}, {ties - 1} - {tie}, {ties})"
    made = f"if(doc_id is null, cast(-1 as bigint), cut * {subs} + {sub}) * {ties + 1} + {within}"
    return F.expr(f"transform(array(cast(coalesce({at}, 0) as bigint)), whole -> transform(array(cast(whole as int)), cut -> {made})[0])[0]")


def versions(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """b, rn, doc_id, n_chars, edited_sha256, and the paragraph digests of the text (own),
    its edited version (edit) and the next document (next); and the tables it rests on."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    numbered = own.withColumn("tie", F.xxhash64("text"))
    rows = numbered.withColumns({"b": range_number(own), "own": digests(F.col("text"))}).drop("tie")
    order = Window.partitionBy("b").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    placed = rows.withColumns({"rn": F.row_number().over(order), "ahead": F.lead("text").over(order), "next": F.lead("own").over(order)})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = lambda ahead: F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr(ahead, F.lit(1), half))
    inner = F.col("ahead").isNotNull()

    def finished(df: DataFrame, ahead: Column) -> DataFrame:
        return df.withColumn("changed", edited(ahead)).withColumns({"edited_sha256": F.sha2("changed", 256), "edit": digests(F.col("changed"))}).drop("changed")

    kept = finished(placed, F.col("ahead")).select(
        "b", "rn", "doc_id", F.length("text").cast("long").alias("n_chars"), "own", "next", "edit", "edited_sha256",
        F.when((F.col("rn") == 1) | ~inner, F.col("text")).alias("text"), (~inner).alias("last"),
    )
    kept = materialize(kept, "fingerprint-versions")
    first = kept.where("rn = 1").select(F.col("b").alias("next_b"), F.col("text").alias("ahead"), F.col("own").alias("next"))
    after = _next_range(kept.where("rn = 1").select("b"))
    top = kept.agg(F.max("b")).first()[0]
    ends = kept.where("last").drop("next", "edit", "edited_sha256").join(after, "b").withColumn("next_b", F.coalesce(F.col("next").cast("long"), F.lit(top).cast("long"))).drop("next")
    ends = materialize(finished(ends.join(first, "next_b"), F.col("ahead")).drop("text", "last", "ahead", "next_b"), "fingerprint-ends")
    return kept.where("not last").drop("text", "last").unionByName(ends), [kept, ends]


def _expanded(pairs: DataFrame, width: int, attempt: int, versions_: dict[str, str]) -> DataFrame:
    """b, rn, v, cell, digest: each version's digests in their cells."""
    each = F.array(*[F.struct(F.lit(v).alias("v"), F.col(c).alias("d")) for v, c in versions_.items()])
    rows = pairs.select("b", "rn", F.explode(each).alias("x")).select("b", "rn", "x.v", F.explode("x.d").alias("digest"))
    return rows.select("b", "rn", "v", "digest", F.explode(F.array(*[cell(F.col("digest"), t, width, attempt) for t in range(TABLES)])).alias("cell"))


def cells(rows: DataFrame, width: int, attempt: int, versions_: dict[str, str]) -> DataFrame:
    """b, rn, cell, and for each version n_v, key_v, check_v."""
    has = lambda v, c: F.when(F.col("v") == v, c)
    aggs = []
    for v in versions_:
        aggs += [F.coalesce(F.sum(has(v, F.lit(1))), F.lit(0)).cast("int").alias(f"n_{v}"), F.coalesce(F.bit_xor(has(v, F.col("digest"))), F.lit(0)).alias(f"key_{v}"), F.coalesce(F.bit_xor(has(v, check(F.col("digest")))), F.lit(0)).cast("int").alias(f"check_{v}")]
    return _expanded(rows, width, attempt, versions_).groupBy("b", "rn", "cell").agg(*aggs)


def packed(n: Column, key: Column, chk: Column) -> Column:
    """A cell as hexadecimal digits of fixed width."""
    return F.concat(F.lpad(F.hex(F.pmod(n, F.lit(65536))), 4, "0"), F.lpad(F.hex(key), 16, "0"), F.lpad(F.hex(chk.cast("long").bitwiseAND(F.lit(4294967295))), 8, "0"))


def sketches(table: DataFrame, versions_: list[str], width: int) -> DataFrame:
    """b, rn and each version's fingerprint."""
    empty = "0" * 28
    one = lambda v: F.map_from_entries(F.collect_list(F.struct("cell", packed(F.col(f"n_{v}"), F.col(f"key_{v}"), F.col(f"check_{v}")).alias("x"))))
    made = table.groupBy("b", "rn").agg(*[one(v).alias(v) for v in versions_])
    slots = F.sequence(F.lit(0), F.lit(TABLES * width - 1))
    text = lambda v: F.base64(F.unhex(F.array_join(F.transform(slots, lambda i: F.coalesce(F.try_element_at(F.col(v), i), F.lit(empty))), "")))
    return made.select("b", "rn", *[text(v).alias(f"fp_{v}") for v in versions_])


def peel(table: DataFrame, pairs: dict[str, tuple[str, str]], width: int, attempt: int) -> DataFrame:
    """b, rn, pair, d (how many digests were recovered), left (cells that stay): the difference
    of the two versions of each pair, peeled table by table. Recovered digests gather in
    cell -1, which counts them and holds their XOR."""
    minus = [F.struct(F.lit(p).alias("pair"), F.col("cell"), (F.col(f"n_{x}") - F.col(f"n_{y}")).alias("n"), F.col(f"key_{x}").bitwiseXOR(F.col(f"key_{y}")).alias("key"), F.col(f"check_{x}").bitwiseXOR(F.col(f"check_{y}")).alias("chk")) for p, (x, y) in pairs.items()]
    filled = "cell < 0 or n <> 0 or key <> 0 or chk <> 0"
    now = table.select("b", "rn", F.explode(F.array(*minus)).alias("x")).select("b", "rn", "x.*").where(filled)
    for sweep in range(SWEEPS * TABLES):
        t = sweep % TABLES
        pure = (F.col("cell") >= t * width) & (F.col("cell") < (t + 1) * width) & F.col("n").isin(1, -1) & (F.col("chk") == check(F.col("key"))) & (cell(F.col("key"), t, width, attempt) == F.col("cell"))
        row = lambda c, n: F.struct(c.cast("int").alias("cell"), n.cast("int").alias("n"), F.col("key"), F.col("chk"))
        stay = F.array(row(F.col("cell"), F.col("n")))
        taken = F.array(row(F.lit(-1), F.lit(1)), *[row(cell(F.col("key"), o, width, attempt), -F.col("n")) for o in range(TABLES) if o != t])
        spread = now.select("b", "rn", "pair", F.explode(F.when(pure, taken).otherwise(stay)).alias("x")).select("b", "rn", "pair", "x.*")
        now = spread.groupBy("b", "rn", "pair", "cell").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").cast("int").alias("chk")).where(filled)
    return now.groupBy("b", "rn", "pair").agg(F.coalesce(F.max(F.when(F.col("cell") < 0, F.col("n"))), F.lit(0)).alias("d"), F.count_if(F.col("cell") >= 0).alias("left"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, differs_edited and differs_next (how many paragraphs were recovered), and
    cells_edited and cells_next (of the sketches that it took)."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: peeling is far more work than its bytes tell
    made, spent = versions(docs, id_col, text_col)
    sizes = {c: F.size(c.removeprefix("s_")) for c in ("s_own", "s_edit", "s_next")}
    placed = materialize(made.withColumns(sizes).repartition(tasks, "b", "rn"), "fingerprint-rows")
    discard(*spent)
    rows = placed.count()
    few, some = files_for(spark, rows), files_for(spark, rows, 2000)  # rows of peeling are dear
    everything = ["own", "edit", "next"]
    base = cells(placed.repartition(tasks, "b", "rn"), width, 0, dict(zip(everything, everything)))
    prints = materialize(sketches(base, ["own", "edit"], width), "fingerprint-sketches", some)
    pairs = {"edited": ("own", "edit"), "next": ("own", "next")}
    # the pairs still to do, as rows with empty versions where a pair is done
    todo = placed.select("b", "rn", "own", F.col("edit"), F.col("next"), F.lit(True).alias("p_edited"), F.lit(True).alias("p_next"))
    solved, attempt, wide = None, 0, width
    while True:
        hopeful = {p: F.col(f"p_{p}") & (F.abs(F.size("own") - F.size(v[1])) <= TABLES * wide) for p, v in pairs.items()}
        tried = todo.withColumns({f"t_{p}": h for p, h in hopeful.items()}).where("t_edited or t_next")
        # a pair that isn't tried is compared with the text itself: nothing differs, nothing is peeled
        one = tried.select("b", "rn", "own", *[F.when(F.col(f"t_{p}"), F.col(v[1])).otherwise(F.col("own")).alias(v[1]) for p, v in pairs.items()])
        found = materialize(peel(cells(one.repartition(tasks, "b", "rn"), wide, attempt, dict(zip(everything, everything))), pairs, wide, attempt), "fingerprint-peeled", some)
        by_row = found.groupBy("b", "rn").agg(*[f(F.when(F.col("pair") == p, F.col(c))).alias(f"{c}_{p}") for p in pairs for f, c in ((F.max, "d"), (F.max, "left"))])
        after = todo.join(by_row.hint("merge"), ["b", "rn"], "left").withColumns({f"t_{p}": h for p, h in hopeful.items()})
        done = {p: F.col(f"t_{p}") & (F.coalesce(f"left_{p}", F.lit(0)) == 0) for p in pairs}
        now = materialize(after.select("b", "rn", *[F.when(done[p], F.coalesce(f"d_{p}", F.lit(0))).alias(f"d_{p}") for p in pairs], *[(F.col(f"p_{p}") & ~done[p]).alias(f"p_{p}") for p in pairs]), "fingerprint-tried", few)
        results = now.select("b", "rn", *[c for p in pairs for c in (F.col(f"d_{p}"), F.when(F.col(f"d_{p}").isNotNull(), F.lit(TABLES * wide)).alias(f"cells_{p}"))]).where("d_edited is not null or d_next is not null")
        solved = results if solved is None else solved.unionByName(results)
        left = now.where("p_edited or p_next").select("b", "rn", "p_edited", "p_next")
        if left.isEmpty():
            break
        before, todo = todo, materialize(todo.drop("p_edited", "p_next").join(left.hint("merge"), ["b", "rn"]), "fingerprint-retry", some)
        if attempt:
            discard(before)
        attempt, wide = attempt + 1, wide * GROW
    by_row = solved.groupBy("b", "rn").agg(F.max("d_edited").alias("de"), F.max("d_next").alias("dn"), F.max("cells_edited").alias("ce"), F.max("cells_next").alias("cn"))
    empty = F.base64(F.unhex(F.lit("0" * (28 * TABLES * width))))
    out = placed.drop("own", "edit", "next").join(prints.hint("merge"), ["b", "rn"], "left").join(by_row.hint("merge"), ["b", "rn"], "left")

    def likeness(a: str, c: str, d: str) -> Column:
        whole = F.col(a) + F.col(c) + F.col(d)
        return F.when(whole == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (F.col(a) + F.col(c) - F.col(d)) / whole))

    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.coalesce("fp_own", empty).alias("fingerprint"), F.coalesce("fp_edit", empty).alias("edited_fingerprint"),
        likeness("s_own", "s_edit", "de").alias("near_edited"), likeness("s_own", "s_next", "dn").alias("near_next"), F.col("de").alias("differs_edited"), F.col("dn").alias("differs_next"), F.col("ce").alias("cells_edited"), F.col("cn").alias("cells_next"),
    )
