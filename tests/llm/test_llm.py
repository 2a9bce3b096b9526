import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from marlspike.functions.cells import micros
from marlspike.llm.consensus import counted_labels, fit_consensus
from marlspike.llm.mixing import fill_shares, mix
from marlspike.llm.nearest import nearest_in_time
from marlspike.llm.packing import _fill_greedily, pack, plan_patterns
from marlspike.llm.tokens import VOCABULARY, with_tokens
from marlspike.llm.top_items import top_per_group
from marlspike.llm.truncation import truncated_texts, truncation_rates
from tests.conftest import rows

START = dt.datetime(2026, 1, 1)


def at(s):
    return None if s is None else START + dt.timedelta(seconds=s)


# consensus ---------------------------------------------------------------------


def test_counted_labels(spark):
    data = [
        (1, "w", " An-1 ", 1, at(5)), (2, "w", "an-1", 0, at(9)), (3, "w", "an-1", 7, at(99)), (4, None, "an-1", 1, at(1)),
        (5, "w", " ", 1, at(1)), (6, "w", None, 1, at(1)), (7, "v", "an-1", 1, at(3)), (8, "v", "AN-1", 0, at(3)), (9, "u", "an-2", None, at(3)),
    ]
    df = spark.createDataFrame(data, "id long, wallet string, who string, label int, at timestamp_ntz")
    assert rows(counted_labels(df, "wallet", "who", "label", "at", "id")) == [("v", "an-1", 0), ("w", "an-1", 0)]
    assert counted_labels(df.limit(0), "wallet", "who", "label", "at", "id").count() == 0


def test_consensus_finds_truth_and_liar(spark):
    rng = random.Random(1)
    skill = {"good1": 0.95, "good2": 0.9, "good3": 0.9, "coin": 0.5, "liar": 0.08}
    truth = {f"i{k}": int(rng.random() < 0.4) for k in range(300)}
    labels = [(i, a, y if rng.random() < p else 1 - y) for i, y in truth.items() for a, p in skill.items() if rng.random() < 0.8]
    df = spark.createDataFrame(labels, "item string, annotator string, label int")
    feats = spark.createDataFrame([(i, y + rng.gauss(0, 1), None if rng.random() < 0.2 else float("nan")) for i, y in truth.items()], "item string, p double, probability double")
    items, people = fit_consensus(df, feats)
    found = {r["item"]: r["consensus"] for r in items.collect()}
    assert sum(found[i] == truth[i] for i in found) / len(found) > 0.95
    share = {r["annotator"]: r["reliability"] for r in people.collect()}
    assert share["liar"] < 0.3 < share["coin"] < 0.7 < share["good1"]
    again = {r["item"]: r["consensus"] for r in fit_consensus(df, feats)[0].collect()}
    assert again == found


def test_consensus_of_many_annotators_is_the_same(spark, monkeypatch):
    rng = random.Random(8)
    skill = {f"a{k}": rng.choice([0.9, 0.8, 0.5, 0.1]) for k in range(6)}
    truth = {f"i{k}": int(rng.random() < 0.4) for k in range(60)}
    labels = [(i, a, y if rng.random() < p else 1 - y) for i, y in truth.items() for a, p in skill.items() if rng.random() < 0.7]
    df = spark.createDataFrame(labels, "item string, annotator string, label int")
    feats = spark.createDataFrame([(i, y + rng.gauss(0, 1)) for i, y in list(truth.items())[:50]], "item string, f double")
    want = [{r[0]: r for r in x.collect()} for x in fit_consensus(df, feats, iterations=6)]
    monkeypatch.setattr("marlspike.llm.consensus.MAX_ANNOTATORS", 3)
    got = [{r[0]: r for r in x.collect()} for x in fit_consensus(df, feats, iterations=6)]
    for g, w in zip(got, want):
        assert g.keys() == w.keys()
        for key in w:
            assert np.allclose([float(v) for v in g[key][1:]], [float(v) for v in w[key][1:]], atol=1e-6)


def test_consensus_empty_and_tie(spark):
    empty = spark.createDataFrame([], "item string, annotator string, label int")
    items, people = fit_consensus(empty)
    assert items.count() == 0 and people.count() == 0
    one = spark.createDataFrame([("x", "a", 1)], "item string, annotator string, label int")
    assert fit_consensus(one)[0].first()["agreement"] in (0.0, 1.0)


# top items ---------------------------------------------------------------------


def test_top_against_sort(spark):
    rng = random.Random(2)
    data = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, *[f"w{rng.randrange(40)}" for _ in range(9)]]), rng.choice([None, *range(6)]), "x", 1) for _ in range(600)]
    df = spark.createDataFrame(data, "g string, w string, s int, p string, place int")
    best = {}
    for g, w, s, *_ in data:
        if None not in (g, w, s):
            best[g, w] = max(best.get((g, w), -1), s)
    want = []
    for g in {g for g, _ in best}:
        ranked = sorted(((-s, w) for (h, w), s in best.items() if h == g))[:5]
        want += [(g, k, w, -s) for k, (s, w) in enumerate(ranked, 1)]
    assert rows(top_per_group(df, "g", "w", "s", 5)) == sorted(want, key=repr)
    assert top_per_group(df.limit(0), "g", "w", "s", 5).count() == 0


# nearest -----------------------------------------------------------------------


def test_nearest_against_brute_force(spark):
    rng = random.Random(3)
    left = [(k, rng.choice(["hot"] * 5 + ["b", None]), rng.choice([None, *[rng.randrange(90_000) for _ in range(9)]])) for k in range(300)]
    right = [(rng.choice([None, *[f"t{rng.randrange(400):03}" for _ in range(9)]]), rng.choice(["hot"] * 5 + ["b", None]), rng.choice([None, *[rng.randrange(90_000) for _ in range(9)]])) for _ in range(500)]
    right += [("t-tie-b", "hot", left[0][2]), ("t-tie-a", "hot", left[0][2])]
    a = spark.createDataFrame([(k, e, at(s), "c") for k, e, s in left], "k long, e string, t timestamp_ntz, v string")
    b = spark.createDataFrame([(v, e, at(s), "c") for v, e, s in right], "v string, e string, t timestamp_ntz, k string")
    want = []
    for k, e, s in left:
        near = [(abs(u - s), u, v) for v, f, u in right if e and f == e and v and s is not None and u is not None and abs(u - s) <= 300]
        if near:
            want.append((k, min(near)[2]))
    for groups in (1, 7):
        got = nearest_in_time(a, b, "k", "e", micros("t"), "v", "e", micros("t"), 300, groups, block_s=1000)
        assert rows(got.select("k", "v")) == sorted(want, key=repr)
    assert nearest_in_time(a.limit(0), b, "k", "e", micros("t"), "v", "e", micros("t"), 300, 2).count() == 0
    assert nearest_in_time(a, b.limit(0), "k", "e", micros("t"), "v", "e", micros("t"), 300, 2).count() == 0


def test_nearest_tie_round_a_block_edge(spark):
    # equally near, on the two sides of a block's edge: the earlier time counts, not the lower id
    edge = 21_600 * 3
    a = spark.createDataFrame([(1, "e", at(edge)), (2, "e", at(edge + 250)), (3, "f", at(edge - 7))], "k long, e string, t timestamp_ntz")
    b = spark.createDataFrame(
        [("zz", "e", at(edge - 100)), ("aa", "e", at(edge + 100)), ("mm", "e", at(edge + 400)), ("q", "f", at(edge - 307)), ("p", "f", at(edge + 293))],
        "v string, e string, t timestamp_ntz",
    )
    for groups in (1, 5):
        got = nearest_in_time(a, b, "k", "e", micros("t"), "v", "e", micros("t"), 300, groups)
        assert rows(got.select("k", "v")) == [(1, "zz"), (2, "aa"), (3, "q")]


# tokens and packing ------------------------------------------------------------


def test_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    texts = ["hello world", None, "", "長い文" * 3000, "<|endoftext|>", "a" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r["i"]: r["tokens"] for r in with_tokens(df, "text", ["i"]).collect()}
    t.encode_special_tokens = True
    assert got == {i: len(t.encode(x, add_special_tokens=False)) if x else 0 for i, x in enumerate(texts)}
    assert with_tokens(df.limit(0), "text", ["i"]).count() == 0


def by_size(histogram, capacity):
    sizes = np.array(sorted(histogram))
    return _fill_greedily(sizes, np.array([histogram[s] for s in sizes]), capacity)


def test_plan_holds_everything():
    rng = random.Random(4)
    for _ in range(10):
        histogram = {rng.randrange(1, 101): rng.randrange(1, 200) for _ in range(rng.randrange(1, 30))}
        plan = plan_patterns(dict(histogram), 100)
        assert plan.items == sum(histogram.values())
        used, volume = sum(t for _, t in plan.patterns), -(-sum(s * n for s, n in histogram.items()) // 100)
        assert volume <= plan.bound <= used <= min(1.15 * plan.bound, sum(t for _, t in by_size(histogram, 100)) * 1.01 + 1)
        held = {}
        for pattern, times in plan.patterns:
            assert sum(s * n for s, n in pattern.items()) <= 100
            for s, n in pattern.items():
                held[s] = held.get(s, 0) + n * times
        assert held == histogram
    # sizes as texts have them: nearly all lie in patterns of the LP, and nearly no space is lost
    sizes = [max(1, min(511, int(rng.lognormvariate(5.3, 0.8)))) for _ in range(4000)]
    histogram = {s: sizes.count(s) for s in set(sizes)}
    plan = plan_patterns(histogram, 512)
    assert plan.by_lp > 0.9 * 4000 and sum(t for _, t in plan.patterns) <= 1.01 * plan.bound + 1
    # thirds fill containers exactly, where largest-first leaves room
    plan = plan_patterns({35: 300, 30: 300}, 100)
    assert sum(t for _, t in plan.patterns) <= 200 and plan.by_lp == 600
    # items over half the capacity: the LP's bound is above the volume's
    assert plan_patterns({60: 50}, 100).bound == 50
    assert plan_patterns({}, 10).patterns == []
    assert plan_patterns({1: 1}, 1).patterns == [({1: 1}, 1)]


def test_pack(spark):
    rng = random.Random(5)
    data = [(k, rng.choice([None, 0, 7, 7, 7, 50, 99, 100, 250, 1000])) for k in range(500)]
    df = spark.createDataFrame([(k, n, 0) for k, n in data], "k long, n long, container int")
    got = pack(df, "k", "n", 100)[0].collect()
    size, parts = {}, {}
    for r in got:
        size[r["container"]] = size.get(r["container"], 0) + r["n"]
        parts.setdefault(r["k"], []).append(r["n"])
    assert max(size.values()) <= 100
    assert {k: sum(v) for k, v in parts.items()} == {k: n for k, n in data if n}
    assert all(len(v) == max(1, -(-sum(v) // 100)) for v in parts.values())
    total = sum(n or 0 for _, n in data)
    assert len(size) <= 1.02 * total / 100 + 1
    assert rows(pack(df, "k", "n", 100)[0]) == rows(spark.createDataFrame(got))
    assert pack(df.limit(0), "k", "n", 100)[0].count() == 0


# mixing ------------------------------------------------------------------------


def test_fill_shares():
    got = fill_shares({"a": 100, "b": 1000, "c": 0}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 2, "b": 3, "c": 9}, 1000)
    assert got == {"a": 200.0, "b": 800.0, "c": 0.0}
    assert fill_shares({"a": 10}, {"a": 1.0}, {"a": 3}, 1000) == {"a": 30.0}
    assert fill_shares({}, {}, {}, 10) == {}


def test_mix(spark):
    rng = random.Random(6)
    docs = [(k, rng.choice(["big"] * 6 + ["small", "other", None]), rng.choice([None, 0, 5, 20, 80])) for k in range(3000)]
    df = spark.createDataFrame(docs, "doc long, source string, n long").withColumn("mix", F.lit("clash"))
    targets = spark.createDataFrame([("m", "big", 0.5, 2), ("m", "small", 0.4, 3), ("m", "none", 0.1, 5), ("z", "none", 1.0, 1)], "mix string, source string, target_share double, max_repeats int")
    chosen, report = mix(df, targets, "doc", "source", "n")
    got = {(r["mix"], r["source"]): r for r in report.collect()}
    total = {s: sum(n or 0 for _, t, n in docs if t == s) for s in ("big", "small")}
    budget = sum(total.values())
    want = fill_shares(total, {"big": 0.5, "small": 0.4, "none": 0.1}, {"big": 2, "small": 3, "none": 5}, budget)
    for s in ("big", "small"):
        assert abs(got["m", s]["tokens"] - want[s]) <= 80
    assert got["m", "none"]["tokens"] == 0 and got["z", "none"]["actual_share"] == 0
    most = {r["doc"]: r["repeats"] for r in chosen.filter("mix = 'm'").collect()}
    assert max(most.values()) <= 3 and all(docs[k][1] in ("big", "small") for k in most)
    assert rows(chosen) == rows(mix(df, targets, "doc", "source", "n")[0])
    chosen, report = mix(df.limit(0), targets, "doc", "source", "n")
    assert chosen.count() == 0 and report.count() == 4


# truncation --------------------------------------------------------------------

SENTENCE = "The night desk compared the funding trace before the weekly review, although no fee was paid. "


def test_truncation(spark):
    rng = random.Random(7)
    docs, cut = [], set()

    def add(text, source="alerts", is_cut=False):
        docs.append((len(docs), source, text, "c"))
        if is_cut:
            cut.add(docs[-1][0])

    for k in range(60):
        body = f"Case {k} was opened. " + SENTENCE * rng.randrange(1, 4)
        add(body.strip())
        add(body.strip() + "\n\nNext steps:\n- compare both replays\n- tell the second reader")
        add(body.strip() + "\n- tell the second reader\n- compare both replays")
        add(body.strip() + " Nothing further for now...")
        add(f"[10:{k:02}] a1: {SENTENCE.strip()}\n[10:{k:02}] a2: will do\n[10:{k:02}] a1: thanks", "chats")
        add((f"Alert {k} came first. " + SENTENCE * 9)[:280], is_cut=True)
        add((f"Alert {k} came first. " + SENTENCE * 9)[:280] + "...", is_cut=True)
    add("x", "notes")
    add("", "notes")
    add("   \n", "notes")
    add(None, "notes")
    add(f"Intro. {SENTENCE}" * 3000, "notes")
    add("It broke off. The desk will compar", "notes", True)
    add('Look.\n{"wallet": "G", "score": 1', "notes", True)
    add('Look.\n{"wallet": "G", "score": 1}', "notes")
    add("Look.\n```\ncode", "notes", True)
    add("Look.\n```\ncode\n```", "notes")
    add("Half a character�", None, True)
    add("It goes on. Between the first and\n\n-- forwarded by relay 3", None, True)
    add("It is over.\n\n-- forwarded by relay 3", None)
    add('"Quoted as it stands!"', None)
    add("Score: 61 | Confidence: 4 | Pair: AB/XLM", None)
    df = spark.createDataFrame(docs, "doc long, source string, text string, id string")
    found, spikes = truncated_texts(df, "doc", "source", "text")
    got = {r["id"] for r in found.collect()}
    assert got == cut, [docs[k] for k in got ^ cut]
    assert ("alerts", "chars", 280) in [(r["source"], r["unit"], r["spike"]) for r in spikes.collect()]
    where = {r["id"]: (r["reason"], r["limit_length"], r["limit_unit"]) for r in found.collect()}
    at_limit = {k for k in cut if docs[k][1] == "alerts"}
    assert {where[k] for k in at_limit} == {("limit", 280, "chars")} and {where[k][0] for k in cut - at_limit} == {"transfer"}
    rates = {r["source"]: (r["documents"], r["truncated"]) for r in truncation_rates(df, found, "source").collect()}
    assert rates["alerts"] == (360, 120) and rates["chats"] == (60, 0) and rates[None][1] == 2
    assert {(r["source"], r["unit"], r["spike"], r["at_maximum"]) for r in spikes.collect()} == {("alerts", "chars", 280, True)}
    none, _ = truncated_texts(df.limit(0), "doc", "source", "text")
    assert none.count() == 0


def test_limits_of_two_sources_and_bytes(spark):
    rng = random.Random(9)
    docs = []
    words = "der Prüfer öffnete den Fall über die Brücke und schloß ihn später wieder ".split()
    for k in range(200):
        text = f"Fall {k}. " + " ".join(rng.choice(words) for _ in range(120))
        docs.append((len(docs), "chars", text[:300]))
        docs.append((len(docs), "bytes", text.encode()[:300].decode("utf-8", "ignore")))
        docs.append((len(docs), "free", " ".join(rng.choice(words) for _ in range(rng.randrange(3, 80))).capitalize() + "."))
    df = spark.createDataFrame(docs, "doc long, source string, text string")
    found, spikes = truncated_texts(df, "doc", "source", "text")
    limits = {(r["source"], r["unit"], r["at_maximum"]) for r in spikes.collect() if r["n"] > 30}
    assert ("chars", "chars", True) in limits and ("bytes", "bytes", True) in limits and not [s for s, _, _ in limits if s == "free"]
    assert {r["source"] for r in found.collect()} == {"chars", "bytes"} and found.count() == 400
