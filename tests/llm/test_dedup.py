"""Substring, line and SimHash dedup against brute force, and the defined cases."""

import hashlib
import re
import sys
from collections import defaultdict
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import DOCS, documents, random_texts

from folioscope.llm import graph, lines, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substring(rows, window):
    first = {}
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in docs:
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in docs:
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [1, 3, 4, 13])
def test_substring_brute_force(spark, window):
    texts = random_texts(120, seed=window, words=60, vocabulary=30 if window < 5 else 300)
    texts += [None, "", "one two", texts[0], texts[0] + " x\n" + texts[3], "a " * 400, "a " * 300]
    got = [tuple(r) for r in substring.remove_repeats(documents(spark, texts), window).collect()]
    assert sorted(got, key=str) == brute_substring(list(enumerate(texts)), window)


def test_substring_cases(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = documents(spark, [text, text, text, text], ids=[3, 3, None, 5]).withColumn("row_key", F.lit(1)).withColumn("h", F.lit("x"))
    got = sorted([tuple(r)[:3] for r in substring.remove_repeats(docs).collect()], key=str)
    assert got == [(3, 30, 0), (3, 30, 0), (5, 30, 30), (None, 30, 0)]
    assert substring.remove_repeats(docs.limit(0)).collect() == []
    kept = substring.remove_repeats(docs, keep_text=True).where("doc_id = 5").first()
    assert kept["kept_text"] == ""


def test_lines(spark):
    texts = [f"common line\nown {i}\n\n common line " for i in range(12)] + [None, "", "rare\nrare"]
    sources = [f"s{i}" for i in range(12)] + ["a", "b", None]
    docs = documents(spark, texts, sources).withColumn("k1", F.lit(1)).withColumn("first", F.lit("x"))
    rows = {r["doc_id"]: r for r in lines.dedup_lines(docs, 10).collect()}
    assert rows[0]["text"] == "common line\nown 0\n" and rows[0]["_removed"] == 1
    assert rows[5]["text"] == "own 5\n" and (rows[5]["_lines"], rows[5]["_removed"]) == (4, 2)
    assert rows[12]["text"] is None and rows[12]["_lines"] == 0
    assert rows[13]["text"] == "" and rows[14]["text"] == "rare\nrare"
    assert rows[0]["k1"] == 1 and "first" in lines.dedup_lines(docs, 10).columns
    assert lines.dedup_lines(docs.limit(0), 10).collect() == []
    few = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs, 13).collect()}
    assert few[5] == texts[5]


def test_lines_near_threshold_is_exact(spark):
    n = 400
    texts = [("a\n" if i < 300 else "") + ("b\n" if i < 299 else "") + f"own {i}" for i in range(n)]
    docs = documents(spark, texts, [f"site{i}" for i in range(n)])
    rows = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs, 300, lg_k=6).collect()}
    assert rows[7] == "b\nown 7" and rows[0] == "a\nb\nown 0"


def brute_fingerprint(text, k):
    w = [x for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, distance):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_brute_force(spark):
    texts = random_texts(300, seed=5, words=120) + [None, "", "X", "x", "a b", "Ä ä", "a  b\tc d"]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    fps = [brute_fingerprint(t, 3) for t in texts]
    assert [got[i]["fp"] & (2**64 - 1) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(fps, 2)


@pytest.mark.parametrize("distance", [1, 2])
def test_links_of_dense_fingerprints(spark, distance):
    """Many fingerprints a few bits apart crowd the variants; none of the links is lost."""
    import random

    r = random.Random(distance)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = {b for b in base}
    for b in base:
        for _ in range(60):
            x = b
            for _ in range(r.randint(1, 5)):
                x ^= 1 << r.choice([0, 1, 2, 3, 30, 31, 32, 33, 62, 63])
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance)
    assert edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > distance).count() == 0
    roots = {row["node"]: row["root"] for row in graph.components(edges).collect()}
    groups = defaultdict(set)
    for x, root in zip(signed, brute_components(fps, distance)):
        groups[root].add(x)
    found = defaultdict(set)
    for x in signed:
        found[roots.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_simhash_cases(spark):
    docs = documents(spark, ["a b c d"] * 3 + [None], ids=[7, 7, None, 9]).withColumn("fp", F.lit("clash"))
    got = sorted([(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()], key=str)
    assert got == [(7, 7), (7, 7), (9, 9), (None, 7)]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (200, None)]
    rows = graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in rows} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def brute_groups(texts, least=0.8, k=5):
    """A set of positions for each group of texts that links of Jaccard similarity join."""
    sets = [set(simhash.shingles(t.encode(), k)) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both >= least * (len(a) + len(b) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(set)
    for i in range(len(texts)):
        groups[find(i)].add(i)
    return sorted(map(sorted, groups.values()))


def edited(r, words, n):
    """The words with n of them replaced, far from each other."""
    out = list(words)
    step = len(words) // n
    for i in range(n):
        out[i * step + r.randrange(step - 5)] = f"e{r.randrange(10**9)}"
    return out


def spark_groups(spark, texts, ids):
    found = defaultdict(set)
    at = {x: i for i, x in enumerate(ids)}
    for row in simhash.similar_groups(documents(spark, texts, ids=ids)).collect():
        found[row["component_id"]].add(at[row["doc_id"]])
    assert all(min(ids[i] for i in g) == c for c, g in found.items())
    return sorted(map(sorted, found.values()))


def test_groups_around_an_original_that_is_not_the_smallest(spark):
    """Copies at 0.8 to 0.9 of an original, below 0.8 of each other; ids shuffled."""
    import random

    r = random.Random(31)
    texts = []
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(304)]
        texts += [" ".join(base), *[" ".join(edited(r, base, r.choice([4, 5, 6]))) for _ in range(r.randint(2, 6))]]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    want = brute_groups(texts)
    assert len(want) == 30
    assert spark_groups(spark, texts, ids) == want


def test_groups_that_share_passages(spark, monkeypatch):
    """Passages that many unrelated texts hold crowd the keys; chains and links between
    copies alone stay, also when only the last comparison finds them."""
    import random

    r = random.Random(32)
    passages = [[f"p{k}w{i}" for i in range(60)] for k in range(4)]
    texts = []
    for g in range(25):
        base = sum(r.sample(passages, 3), []) + [f"g{g}w{i}" for i in range(r.randint(40, 60))]
        group = [base]
        for _ in range(r.randint(1, 5)):
            group.append(edited(r, r.choice(group), r.choice([1, 2, 3])))
        texts += map(" ".join, group)
    for k in range(12):  # of passages alone
        texts.append(" ".join(sum(r.sample(passages, 3), [])))
    ids = list(range(len(texts)))
    r.shuffle(ids)
    want = brute_groups(texts)
    assert 12 < len(want) < len(texts)
    assert spark_groups(spark, texts, ids) == want
    monkeypatch.setattr(simhash, "ROUNDS", 0)
    monkeypatch.setattr(simhash, "DEAL", 3)
    assert spark_groups(spark, texts, ids) == want
