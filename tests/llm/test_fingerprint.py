"""Fingerprints against exact sets, and the defined cases."""

import hashlib
import re
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import DOCS, documents, random_texts

from folioscope.llm import fingerprint


def pieces(text):
    return {p for p in re.findall(r"[^\n]{1,%d}" % fingerprint.PIECE, text) if p.strip(" ")}


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        ahead = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + ahead[:half]
        j = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), j(pieces(t), pieces(edited)), j(pieces(t), pieces(ahead)))
    return out


def texts():
    made = ["\n".join(t.split(" ")) for t in random_texts(60, seed=3, words=30)]
    return [*made, None, "", " \n \n", "é" * 501, "🦊\nab" * 60, made[0], "\n".join(f"line {i}" for i in range(900)), "\n".join(f"line {i}" for i in range(0, 1800, 2))]


def test_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(documents(spark, [t for _, t in rows])).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i, (n, sha, edited, ahead) in want.items():
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert abs(r["near_edited"] - edited) < 1e-9 and abs(r["near_next"] - ahead) < 1e-9
    assert got[0]["fingerprint"] == got[65]["fingerprint"]
    assert got[60]["fingerprint"] == got[61]["fingerprint"]


def test_far_apart_ids_and_small_sketches(spark):
    rows = [(i * 10**12 if i % 3 else i, t) for i, t in enumerate(texts()[:40])]
    rows = list({i: t for i, t in rows}.items())
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(documents(spark, [t for _, t in rows], ids=[i for i, _ in rows]), width=2).collect()}
    for i, (n, sha, edited, ahead) in brute(rows).items():
        assert got[i]["edited_sha256"] == sha and abs(got[i]["near_next"] - ahead) < 1e-9


def test_cases(spark):
    one = documents(spark, ["a\nb"], ids=[7]).withColumn("rn", F.lit("x")).withColumn("own", F.lit(1))
    r = fingerprint.fingerprints(one).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"a\na").hexdigest()
    twins = fingerprint.fingerprints(documents(spark, ["ab", "ab", "xyz", None], ids=[1, 1, None, None])).collect()
    assert sorted(str(r["doc_id"]) for r in twins) == ["1", "1", "None", "None"]
    assert fingerprint.fingerprints(spark.createDataFrame([], DOCS)).collect() == []
