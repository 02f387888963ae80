"""Selection and budget fit against plain loops, judged responses, lookups, and the whole job."""

import json
import random
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import KEY, chosen

from folioscope import config, job
from folioscope.functions import judged, prompts
from folioscope.functions.claims import GROUP_ORDER, SINGLE_ORDER
from folioscope.operators import balance, judging, sampling
from folioscope.sources import layout, manuscripts


def sequential_choice(claims, records, papers, multi):
    """The selection as a plain loop that sorts the whole pool anew for every pick."""
    bank, taken, sections, bins, per_paper = set(), [], Counter(), Counter(), Counter()
    others = 0
    size_bin = lambda n: str(n) if n <= 4 else "5-8" if n <= 8 else "9-15" if n <= 15 else "16+"
    over = lambda c: c["claim_type"] == "other" and others >= max(20, records // 4)

    def consider(c):
        nonlocal others
        if c["tier_rank"] >= 4 or len(bank | set(c["papers"])) > papers:
            return False
        taken.append(c["claim_id"])
        bank.update(c["papers"])
        sections[c["section_title"]] += 1
        bins[size_bin(c["n"])] += 1
        others += c["claim_type"] == "other"
        if c["mode"] == "single":
            per_paper[c["papers"][0]] += 1
        return True

    pool = [c for c in claims if c["mode"] == "group" and 2 <= c["n"] <= 8]
    picked = 0
    while pool and picked < multi and len(taken) < records:
        pool.sort(key=lambda c: (c["tier_rank"], bins[size_bin(c["n"])], sections[c["section_title"]], over(c), c["frame"], GROUP_ORDER.index(c["claim_type"]), len(set(c["papers"]) - bank), c["position"]))
        picked += consider(pool.pop(0))
    target, singles, got = records - picked, [c for c in claims if c["mode"] == "single"], 0
    for known in (True, False):
        while got < target and len(taken) < records:
            fit = sorted((c for c in singles if (set(c["papers"]) <= bank) == known), key=lambda c: (c["tier_rank"], over(c), per_paper[c["papers"][0]], sections[c["section_title"]], SINGLE_ORDER.index(c["claim_type"]), len(set(c["papers"]) - bank), c["position"]))
            if not fit:
                break
            singles.remove(fit[0])
            got += consider(fit[0])
    return taken


def test_selection_is_the_plain_loop(spark):
    found, tiers, _, _ = chosen(spark)
    pool = sampling.candidates(found, tiers, KEY).persist()
    rows = [{"claim_id": r["claim_id"], "mode": r["citation_mode"], "section_title": r["section_title"], "n": r["citation_group_size"], "claim_type": r["claim_type"], "position": r["position"], "tier_rank": r["tier_rank"], "papers": r["papers"], "frame": r["frame"], "doc_id": r["doc_id"]} for r in pool.collect()]
    for records, papers, multi in ((30, 12, 10), (100, 100, 50), (7, 3, 7), (50, 25, 0)):
        got = {}
        for r in sampling.select_claims(pool, KEY, sampling.Budget(records, papers, multi)).orderBy("doc_id", "pick").collect():
            got.setdefault(r["doc_id"], []).append(r["claim_id"])
        for d in (1, 2):
            own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["position"])
            assert got.get(d, []) == sequential_choice(own, records, papers, multi)


def plain_fit(rows, cards, meta, balance_, limit):
    """Serialise everything anew for every claim that goes."""
    left, cut = list(rows), False
    while True:
        papers = sorted({p for r in left for p in r["papers"]})
        ids = {p: f"E{i:03d}" for i, p in enumerate(papers, 1)}
        multi = sum(r["citation_mode"] == "group" for r in left)
        numbers = {"selected": len(left), "single": len(left) - multi, "multi": multi, "ratio": round(multi / max(1, len(left)), 4)}
        head = meta | {"num_selected_claims": numbers["selected"], "num_selected_single_claims": numbers["single"], "num_selected_multi_claims": multi, "multi_citation_claim_ratio_selected": numbers["ratio"], "num_selected_papers": len(papers), "truncated_to_char_limit": cut}
        tail = balance_ | {"selected_claims": len(left), "selected_single_citation_claims": numbers["single"], "selected_multi_citation_claims": multi, "multi_citation_claim_ratio_selected": numbers["ratio"], "num_unique_selected_papers": len(papers)}
        if cut:
            others = sum(r["claim_type"] == "other" for r in left)
            tail |= {"citation_group_size_distribution_selected": dict(Counter(r["bin"] for r in left)), "claim_type_distribution_selected": dict(Counter(r["claim_type"] for r in left)), "selected_other_claims": others, "selected_other_claim_ratio": round(others / max(1, len(left)), 4), "contexts_per_section_selected": dict(Counter(r["section_title"] for r in left))}
        bank = {"record_type": "evidence_card_bank", "num_papers": len(papers), "papers": [{"evidence_ref_id": ids[p], "paper_id": p, "evidence_card": cards[p]} for p in papers]}
        claims = [r["body"] | {"citation_group": [m | {"evidence_ref_id": ids[m["paper_id"]]} for m in r["body"]["citation_group"]]} for r in left]
        text = "".join(json.dumps(x, ensure_ascii=False, separators=(",", ":")) + "\n" for x in [head, bank, *claims, tail])
        if len(text) <= limit or not left:
            return text if len(text) <= limit else None
        worst = max(left, key=lambda r: (r["tier_rank"], r["citation_group_size"], r["claim_type"] in ("background", "other"), r["position"]))
        left.remove(worst)
        cut = True


def test_fit_is_the_plain_loop(spark):
    r = random.Random(3)
    rows, cards = [], {f"p{i:02d}": {"t": "é" * r.randint(0, 30)} for i in range(20)}
    for i in range(30):
        papers = r.sample(sorted(cards), r.randint(1, 6))
        rows.append({"claim_id": f"C{i}", "tier_rank": r.randint(0, 3), "citation_group_size": len(papers), "citation_mode": "single" if len(papers) == 1 else "group", "claim_type": r.choice(["other", "limitation"]), "section_title": r.choice("AB"), "position": i + 1, "papers": papers, "body": {"claim_id": f"C{i}", "citation_group": [{"paper_id": p} for p in papers]}, "bin": str(len(papers)) if len(papers) <= 4 else "5-8"})
    meta, tail = {"record_type": "survey_meta", "method": "m", "num_selected_claims": 0}, {"record_type": "balance_summary", "stale": 1}
    schema = "doc_id long, claim_id string, tier_rank int, citation_group_size int, citation_mode string, claim_type string, section_title string, position int, papers array<string>, body string, cards map<string,string>, meta string, balance string"
    made = [(d, x["claim_id"], x["tier_rank"], x["citation_group_size"], x["citation_mode"], x["claim_type"], x["section_title"], x["position"], x["papers"], "{broken" if d == 2 and i == 0 else json.dumps(x["body"]), {p: json.dumps(cards[p]) for p in x["papers"]}, json.dumps(meta), json.dumps(tail)) for d in (1, 2) for i, x in enumerate(rows)]
    df = spark.createDataFrame(made, schema).persist()
    for limit in (10**6, 5000, 3000, 1500, 700, 100):
        got = {x["doc_id"]: x for x in sampling.fit_budget(df, KEY, limit).collect()}
        assert got[1]["jsonl"] == plain_fit(rows, cards, meta, tail, limit)
        assert got[1]["status"] == ("ok" if got[1]["jsonl"] else "cannot_fit") and got[2]["status"] == "malformed"
        assert got[1]["jsonl"] is None or got[1]["n_chars"] == len(got[1]["jsonl"])


def test_judged_shapes(spark):
    item = lambda s: {"score": s, "rationale": "r"}
    names = judged.CRITERIA["BSC"]
    old = {n: item(i + 1) for i, n in enumerate(names[:3])} | {judged.FORMER_NAMES[names[3]]: item(5)}
    mar = json.dumps({"MAR": {n: item(4) for n in judged.CRITERIA["MAR"]}, "mar_raw_20": 12, "diagnostics": {judged.DIAGNOSTICS[0]: " Severe ", judged.DIAGNOSTICS[1]: "awful"}, "overall_assessment": "fine"})
    both = {f: {n: item("4 of 5") for n in judged.CRITERIA[f]} for f in ("TSQ", "HDQ")}
    rows = [
        ("a", "BSC", json.dumps({"scores": {n: item(2) for n in names}, "BSC": {n: item(5) for n in names}})), ("b", "BSC", json.dumps({"BSC": old})), ("c", "BSC", "no json"), ("d", "BSC", "{}"),
        ("a", "MAR", mar), ("b", "MAR", json.dumps({"x": 1})), ("c", "MAR", mar[:-2]), ("d", "MAR", None), ("a", "TSQ", json.dumps(both)), ("b", "TSQ", "nothing"), ("c", "TSQ", json.dumps(both | {"TSQ": 3})),
        ("d", "TSQ", json.dumps({"output_text": json.dumps(both)})),
    ]
    df = spark.createDataFrame(rows, "s string, family string, raw_response string")
    got = {}
    for r in judging.scores(df, ["s"]).collect():
        got.setdefault((r["s"], r["family"]), {})[r["criterion"]] = (r["score"], r["status"])
    values = {k: sorted({x for x, _ in v.values()}, key=str) for k, v in got.items()}
    assert values[("a", "BSC")] == [2] and [got[("b", "BSC")][n][0] for n in names] == [1, 2, 3, 5]
    assert values[("c", "BSC")] == [None] and values[("d", "BSC")] == [1] and values[("a", "MAR")] == [4] == values[("c", "MAR")]
    assert {v for _, v in got[("b", "MAR")].values()} == {"missing_group"} and {v for _, v in got[("d", "MAR")].values()} == {"no_response"}
    assert values[("a", "TSQ")] == [4] == values[("d", "TSQ")] and values[("b", "TSQ")] == [3] == values[("c", "TSQ")]
    states = {(r["s"], r["family"]): (r["status"], r["raw_20"]) for r in judging.statuses(judging.scores(df, ["s"]), ["s"]).collect()}
    assert states[("a", "BSC")] == ("ok", 8) and states[("c", "BSC")] == ("unparsed", None) and states[("b", "TSQ")] == ("defaulted", 12)
    said = judged.diagnostics(df.where("family = 'MAR' and s = 'a'"), ["s"]).first()
    assert said["diagnostics"][judged.DIAGNOSTICS[0]] == "severe" and said["diagnostics"][judged.DIAGNOSTICS[1]] == "none" and (said["overall"], said["stated_20"]) == ("fine", 12)


def test_config_and_layout(spark, tmp_path):
    given = {"llm_api": {"api_mode": "on", "api_on": {"provider": "p", "retries": 3, "retry_sleep_base_seconds": 2, "odd": 1}, "api_off": {"model_name": "local", "max_tokens": 9}}}
    (tmp_path / "c.json").write_text(json.dumps(given))
    read = config.read_config(spark, str(tmp_path / "c.json"))
    on = config.judge_settings(read, "config")
    assert (on.api_mode, on.provider, on.waits(), on.more) == ("on", "p", [2, 4], {"odd": 1})
    off = config.judge_settings(read, "off", "other")
    assert (off.model_name, off.max_output_tokens, off.api_mode) == ("other", 9, "off")
    assert config.judge_settings({}, "config").api_mode == "off"
    with pytest.raises(ValueError):
        config.judge_settings(read, "maybe")
    assert layout.resolve("/r", "a/b") == "/r/a/b" and layout.resolve("/r", "s3://x") == "s3://x" and layout.Layout("/r").results("BSC", "off") == "/r/results/bsc/api_off"


def test_pages_in_both_orders(spark, tmp_path):
    for n in ("p10.png", "p2.PNG", "p1.jpg", "cover.webp", "x.txt"):
        (tmp_path / n).write_bytes(b"1")
    names = lambda natural: [Path(r["path"]).name for r in manuscripts.page_images(spark, str(tmp_path), natural=natural).orderBy("page_no").collect()]
    assert names(True) == ["p1.jpg", "p2.PNG", "p10.png", "cover.webp"] and names(False) == ["p10.png", "p2.PNG"]


def test_prompts(spark):
    row = spark.createDataFrame([("Agents", "Be strict.", '{"a": 1}'), (None, None, None)], "topic string, rubric string, jsonl string")
    made = [r[0] for r in row.select(prompts.prompt(["TSQ", "HDQ"], F.col("rubric"), F.col("topic"), F.col("jsonl"))).collect()]
    assert "Be strict." in made[0] and '{"a": 1}' in made[0] and all(c in made[1] for f in ("TSQ", "HDQ") for c in judged.CRITERIA[f])


def test_whole_job(spark, tmp_path):
    """Malformed and missing inputs stand in the status, and the other samples are scored."""
    body = "# Intro\n" + " ".join(f"The method number {i} improves the retrieval accuracy of long agents a lot [{i % 5 + 1}]." for i in range(12)) + "\n\n# More\nBoth approaches reduce the latency of planning in every setting we know [1, 2].\n"
    refs = json.dumps({str(i): f"21{i:02d}.0000{i}" for i in range(1, 6)})
    samples = {"001": (refs, body), "002": ("{broken", body), "003": (None, body), "004": (refs, None), "005": (refs, "# Only text\nNothing is cited here.")}
    references = spark.createDataFrame([("m", t, r) for t, (r, _) in samples.items() if r is not None], "method string, topic_id string, text string")
    texts = spark.createDataFrame([("m", t, b) for t, (_, b) in samples.items() if b is not None], "method string, topic_id string, md string")
    cards = spark.createDataFrame([(f"21{i:02d}.0000{i}", i % 2, json.dumps({"title": f"T{i}"})) for i in range(1, 6)], "paper_id string, tier_rank int, card string")
    topics = spark.createDataFrame([("001", "Agents")], "topic_id string, topic string")
    full = lambda fs: json.dumps({f: {c: {"score": 4, "rationale": ""} for c in judged.CRITERIA[f]} for f in fs})
    recorded = spark.createDataFrame([("m", t, f, full(fs)) for t in ("001", "002", "005") for fs in judging.CALLS.values() for f in fs if not (t == "002" and f == "MAR")], "method string, topic_id string, family string, raw_response string")
    inputs = job.Inputs(references, texts, cards, topics)
    done = job.evaluate(inputs, judging.RecordedJudge(recorded, job.KEY))
    states = {r["topic_id"]: r["status"] for r in done.records.collect()}
    assert states == {"001": "ok", "002": "malformed_references", "003": "missing_references", "004": "missing_manuscript", "005": "no_claims"}
    lines = [json.loads(x) for x in done.records.where("topic_id = '001'").first()["jsonl"].splitlines()]
    assert [x["record_type"] for x in (lines[0], lines[1], lines[-1])] == ["survey_meta", "evidence_card_bank", "balance_summary"]
    assert lines[0]["num_selected_claims"] == len(lines) - 3 == lines[-1]["selected_claims"] and lines[1]["papers"][0]["evidence_card"] == {"title": "T1"}
    assert lines[-1]["selection_notes"] == balance.NOTES and lines[-1]["claim_type_distribution_all"]
    by = {(r["topic_id"], r["family"]): (r["status"], r["raw_20"]) for r in done.statuses.collect()}
    assert len(by) == 20 and by[("001", "BSC")] == ("ok", 16) and by[("002", "BSC")][0] == "malformed_references" and by[("002", "MAR")] == ("no_response", None) and by[("004", "MAR")][0] == "missing_manuscript"
    # thin manuscripts: what the audit says caps the other families
    assert by[("001", "TSQ")] == ("ok", 12) and by[("005", "HDQ")][0] == "ok"


def test_command_line(spark, tmp_path):
    root = tmp_path / "root"
    (root / "eval_inputs" / "m").mkdir(parents=True)
    (root / "eval_cache" / "md" / "m").mkdir(parents=True)
    (root / "eval_inputs" / "m" / "ref_001.json").write_text('{"1": "2101.00001"}')
    (root / "eval_cache" / "md" / "m" / "001.md").write_text("# A\nThe method improves the retrieval accuracy of all known agents [1].")
    spark.createDataFrame([("2101.00001", 0, "{}")], "paper_id string, tier_rank int, card string").write.parquet(str(tmp_path / "cards"))
    (tmp_path / "topics.json").write_text('[{"topic_id": "001", "topic": "Agents"}]')
    answers = [{"method": "m", "topic_id": "001", "family": f, "raw_response": json.dumps({g: {c: {"score": 3, "rationale": ""} for c in judged.CRITERIA[g]} for g in fs})} for fs in judging.CALLS.values() for f in fs]
    (tmp_path / "answers.jsonl").write_text("\n".join(map(json.dumps, answers)))
    call = ["--root", str(root), "--responses", str(tmp_path / "answers.jsonl"), "--cards", str(tmp_path / "cards"), "--topics", str(tmp_path / "topics.json")]
    assert job.main([*call, "--build-only"]) == 0
    assert job.main(call) == 0
    rows = spark.read.csv(str(root / "results" / "score_table"), header=True).collect()
    assert sorted(r["family"] for r in rows) == ["BSC", "HDQ", "MAR", "TSQ"] and {r["status"] for r in rows} == {"ok"}
    assert job.main([*call, "--method", "other"]) == 0
    with pytest.raises(SystemExit):
        job.main([*call, "--api-mode", "maybe"])
