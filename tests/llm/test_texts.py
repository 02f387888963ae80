"""Tokens, quality, decontamination and the pipeline."""

import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import DOCS, documents, random_texts

from folioscope.llm import bpe, decontaminate, quality, simhash

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer(bpe.read_ranks(PATH), PATTERN)


def odd_texts():
    r = random.Random(4)
    alpha = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x1F600, 0x4E00, 0x85, 0xA0, 0xFEFF, 0x661]]
    return ["".join(r.choice(alpha) if r.random() < 0.5 else r.choice(" \n\t'sab=") for _ in range(r.randint(0, 200))) for _ in range(150)] + ["", "=" * 500, "a" * 3000, "ab" * 300 + " " * 400, " the" * 50, "<|endoftext|>"]


def test_bpe_is_tiktoken(spark, tokenizer):
    texts = [*odd_texts(), None]
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=tokenizer.ranks, special_tokens={})
    docs = documents(spark, texts).withColumn("ids", F.lit(1))
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, PATH, PATTERN).collect()}
    assert [got[i] for i in range(len(texts))] == [own.encode_ordinary(t or "") for t in texts]
    assert bpe.round_trip(docs, PATH, PATTERN).where("not intact").count() == 0
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()}
    assert [back[i] for i in range(len(texts))] == [(t or "").encode() for t in texts]
    assert bpe.round_trip(docs.limit(0), PATH, PATTERN).collect() == []


def test_long_words_in_one_text(spark, tokenizer):
    """Words of any length take the recursive queries; tiktoken says what they come to."""
    r = random.Random(2)
    texts = ["a" * 40000, "aab" * 9000, "=" * 30000, "e" * 77 + "th" * 3000, "我是中国人你好世界" * 900, "".join(r.choice("aeth") for _ in range(9000)), "".join(r.choice("ACGT") for _ in range(9000))]
    texts += ["".join(r.choice("abet hn") for _ in range(r.randint(1, 300))) for _ in range(200)]
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=tokenizer.ranks, special_tokens={})
    for text, (_, _, _, intact, ids) in zip(texts, tokenizer.texts(texts, with_ids=True)):
        assert intact and ids.tolist() == own.encode_ordinary(text)


def test_queries_go_on_where_their_steps_end(tokenizer, monkeypatch):
    words = [w.encode() for w in ("internationalisation" * 5, "aaaaaaaaaaaaaaaaaaaaaaa", "étéétéété", "b")] * 3
    want = [w.tolist() for w in tokenizer.contract(words)]
    monkeypatch.setattr(bpe, "ROWS", 1)
    assert [w.tolist() for w in tokenizer.contract(words)] == want


def test_bpe_caches_and_pieces(tokenizer, monkeypatch):
    texts = random_texts(60, seed=1, words=30) + odd_texts() + [" ".join(random_texts(40, seed=2)), "x" * 5000 + " y"]
    want = list(tokenizer.texts(texts))
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "BATCH", 7)
    monkeypatch.setattr(bpe, "PIECE", 100)
    small = bpe.Tokenizer(bpe.read_ranks(PATH), PATTERN)
    for _ in range(3):
        assert list(small.texts(texts)) == want
        assert len(small.codes) < 150


def test_unknown_ids_are_refused(tokenizer):
    import pyarrow as pa

    for ids in ([10**6], [-1], [5, 10**9]):
        with pytest.raises(KeyError):
            tokenizer.decode_lists(pa.array([ids], pa.list_(pa.int32())))


def good(r):
    return " ".join(r.choice("the of and to river stone winter letter market garden".split()) for _ in range(r.randint(20, 80))).capitalize() + "."


def bad(r):
    return r.choice([lambda: "BUY!! NOW!! " * r.randint(5, 30), lambda: " | ".join("abc def ghi".split() * r.randint(3, 9)), lambda: "spam " * r.randint(20, 90)])()


def test_quality_held_out(spark):
    r = random.Random(3)
    texts = [bad(r) if i % 4 == 0 else good(r) for i in range(400)] + [None, ""]
    docs = documents(spark, texts).withColumn("label", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    scored = quality.classify(docs, quality.fit(docs, labels)).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    assert len(scored) == 402 and all(0 <= x["_score"] <= 1 for x in scored)
    held = [x for x in scored if x["held"] and x["doc_id"] < 400]
    assert np.mean([x["_predicted"] == int(x["doc_id"] % 4 != 0) for x in held]) > 0.95
    empty = {x["_score"] for x in scored if x["doc_id"] >= 400}
    assert len(empty) == 1
    none = quality.classify(docs, quality.fit(docs, labels.limit(0)))
    assert {x["_score"] for x in none.collect()} == {0.5}
    assert quality.classify(docs.limit(0), quality.fit(docs.limit(0), labels)).collect() == []


def test_quality_is_exact_nearest():
    r = np.random.default_rng(1)
    sparse = [(np.flatnonzero(x).tolist(), x[np.flatnonzero(x)].tolist()) for x in (r.random((200, quality.DIM)) < 0.002).astype(np.float32)]
    labels = r.integers(0, 2, 200).tolist()
    model = quality.Model(sparse, labels)
    raw = (r.random((40, quality.DIM)) < 0.002).astype(np.float32)
    cosine = np.round(model.unit(model.terms(raw.copy()) @ model.projection) @ model.vectors.T, 6)
    want = []
    for row in cosine:
        near = sorted(range(200), key=lambda j: (-row[j], j))[: quality.NEIGHBOURS]
        w = np.maximum(row[near], 0)
        want.append((w * np.array(labels)[near]).sum() / w.sum())
    assert np.allclose(model.score(raw.copy()), want, atol=1e-3)


ITEM = "A train leaves Paris at 9 with 120 passengers and travels 300 km before Anna counts 120 bags"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "one two three four five six seven eight nine ten"), (3, None), (4, "too short"), (5, "")], "item_id long, text string")
    same = ITEM.replace("120", "77").replace("300", "450").replace("Paris", "Rome").replace("Anna", "Bela").replace("km", "miles")
    torn = ITEM.replace("with 120", "with 77").replace("counts 120", "counts 88")
    texts = ["Before it. " + ITEM + " after", "Intro words here. " + same, "nothing of that kind at all", None, "", "so ONE two, three four five six seven eight nine ten more", "one two three four five", torn.replace("A train leaves", "Some train left")]
    docs = documents(spark, texts).withColumn("template", F.lit("x")).withColumn("h", F.lit(2))
    got = {r["doc_id"]: r for r in decontaminate.judge(docs, bench).collect()}
    assert [got[i]["_contaminated"] for i in range(7)] == [True, True, False, False, False, True, False]
    assert got[0]["_item_id"] == 1 and got[5]["_item_id"] == 2 and got[7]["_contaminated"] is False
    kept = decontaminate.clean(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 6, 7] and kept.columns == docs.columns
    assert decontaminate.judge(docs, bench.limit(0)).where("_contaminated").count() == 0
    assert decontaminate.judge(docs.limit(0), bench).collect() == []


def test_decontamination_of_names_at_sentence_starts(spark):
    one = "Tom has 12 red apples in a basket. Anna gives Tom 5 more apples. Tom then eats 3 of them. How many apples are left?"
    two = "In a school 2 boys have 2 apples each and they put all of them into the big basket that their teacher brought"
    bench = spark.createDataFrame([(1, one), (2, two)], "item_id long, text string")
    asked = one.replace("Tom", "Luke").replace("Anna", "Maria").replace("12", "40").replace("5", "9").replace("3", "7")
    inside = "Yesterday " + asked
    torn = asked.replace("gives Luke", "gives Peter").replace("Luke then eats 7 of them", "Paul now takes 7 of those")
    texts = [asked, "Before.\n" + asked + " After", two.replace("2 boys have 2", "3 boys have 4"), inside, torn, "How many pears are left? Nobody knows it yet. Tom has 12 red pears in a bag."]
    got = {r["doc_id"]: r for r in decontaminate.judge(documents(spark, texts), bench).collect()}
    assert [got[i]["_contaminated"] for i in range(6)] == [True, True, True, True, False, False]
    assert got[0]["_share"] == 1.0 and got[2]["_item_id"] == 2


def test_decontamination_in_blocks(spark, monkeypatch):
    texts = random_texts(60, seed=9, words=60, near=0)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:20])], "item_id long, text string")
    docs = documents(spark, [f"x{i} y {t} z" for i, t in enumerate(texts)])
    want = [(r["doc_id"], r["_contaminated"]) for r in decontaminate.judge(docs, bench).orderBy("doc_id").collect()]
    monkeypatch.setattr(decontaminate, "BLOCK", 100)
    assert want == [(r["doc_id"], r["_contaminated"]) for r in decontaminate.judge(docs, bench).orderBy("doc_id").collect()]
    long = [len(t.split()) >= decontaminate.LEAST for t in texts]
    assert [c for _, c in want] == [i < 20 and long[i] for i in range(60)]


def jaccard(a, b, k=5):
    x, y = set(simhash.shingles(a.encode(), k)), set(simhash.shingles(b.encode(), k))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_similar_groups(spark):
    """Every text joins a smaller one that it is similar to, and no group is wider than
    the links between its texts allow."""
    r = random.Random(8)
    texts, base = [], []
    for _ in range(40):
        w = [f"w{r.randrange(3000)}" for _ in range(r.randint(60, 120))]
        first = len(texts)
        texts.append(" ".join(w))
        base.append(first)
        for _ in range(r.randint(0, 5)):
            v = list(w)
            for _ in range(r.randint(0, 2)):
                v[r.randrange(len(v))] = f"w{r.randrange(3000)}"
            texts.append(" ".join(v))
            base.append(first)
    texts += [None, "", "A b", "a b"]
    base += [len(base), len(base), len(base) + 2, len(base) + 2]
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(documents(spark, texts)).collect()}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i] or "", texts[j] or "") >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert all(find(i) == find(got[i]) for i in got)
    missed = [i for i in range(len(texts)) if jaccard(texts[i] or "", texts[base[i]] or "") >= 0.8 and got[i] != got[base[i]]]
    assert len(missed) <= 1
    kept = {x["doc_id"] for x in simhash.keep_one(documents(spark, texts)).collect()}
    assert kept == set(got.values())
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).collect() == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(5)
    body = ["\n".join(good(r) for _ in range(4)) for _ in range(40)]
    texts = [*body, *[bad(r) for _ in range(40)], body[0], body[1] + " Indeed.", "Word here. " + ITEM + "\n" + good(r)]
    texts = [t + "\nShared footer line." if i < 40 else t for i, t in enumerate(texts)]
    documents(spark, texts, [f"s{i % 13}" for i in range(len(texts))]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) == set(range(40)) and all(x["intact"] for x in rows.values())
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
