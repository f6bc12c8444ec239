"""Operators on small fixtures, against literal expectations and plain models."""

import datetime
import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import tokens as TK
from plumbline.functions.text import key
from plumbline.operators import catalogue, changelog, curation, evaluation, folds, graph, orphans, repair, retrieval, textops, units
from plumbline.sources import files


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


# ---- units (problem 4)

CHECK = "array<struct<label: string, operator: string, value: double, unit: string, note: string>>"


def rules(spark, checks, topic="栏杆高度"):
    return spark.createDataFrame([(f"r{k}", topic, [c]) for k, c in enumerate(checks)], f"id string, topic string, checks {CHECK}")


FAMILY = [("length", "mm"), ("pressure", "MPa"), ("duration", "h"), ("temperature", "℃"), ("ratio", "%"), ("area", "m²"), ("concentration", "mg/m³"), ("activity", "Bq/m³")]


def family(spark):
    return spark.createDataFrame(FAMILY, "quantity string, common_unit string")


def limits(spark, checks, topic="t", vote=("x", "<=", 1.0, "mm", None)):
    df = rules(spark, [vote, vote, vote, *checks], topic)
    got = {r.id: r for r in units.common_limits(df, family(spark)).collect()}
    return [got.get(f"r{k + 3}") for k in range(len(checks))]


def test_units_convert_and_read_text(spark):
    checks = [
        ("a", "<=", 1.5, "英寸", None), ("a(cm)", "<=", 12.0, None, None), ("a", "<=", None, None, "≤１，２００ μm"), ("a", "<=", None, None, "limit 3.5ft"), ("a", "<=", 7.0, "", "单位：公分"),
        ("a", "<=", 7.0, "mm", None), ("a", "<=", 7.0, " MM", None), ("a", "<=", 7.0, None, None), ("a", "<=", None, "mm", "完工 7 天后复测"), ("a", "<=", None, None, None), ("天井m线", "<=", 5.0, "-", "抽检 3 处"),
    ]
    got = limits(spark, checks)
    assert [r and r.value_milli for r in got] == [38100, 120000, 1200, 1066800, 70000, 7000, 7000, None, None, None, None]
    assert [r.as_common for r in got if r][-2:] == [True, False]


@pytest.mark.parametrize("vote, check, milli", [
    (("x", "<", 1.0, "MPa", None), ("a", "<", 145.038, "psi", None), 1000), (("x", "<", 1.0, "h", None), ("a", "<", None, None, "取 2天"), 48000),
    (("x", "<", 1.0, "℃", None), ("a", "<", 50.0, "华氏度", "见附录"), 10000), (("x", "<", 1.0, "℃", None), ("a", "<", 273.15, "K", None), 0), (("x", "<", 1.0, "%", None), ("a", "<", None, None, "百分之5以内"), 5000),
    (("x", "<", 1.0, "%", None), ("a", "<", 0.5, "比值(0-1)", None), 50000), (("x", "<", 1.0, "m²", None), ("a", "<", 1.0, "ft²", None), 93), (("x", "<", 1.0, "mg/m³", None), ("a", "<", 1.0, "mg·m⁻³", None), 1000),
    (("x", "<", 1.0, "Bq/m³", None), ("a", "<", 4.0, "pCi/L", None), 148000), (("x", "<", 1.0, "h", None), ("a", "<", 3.0, None, "完工 7 天后复测"), None),
])
def test_units_by_quantity(spark, vote, check, milli):
    (r,) = limits(spark, [check], vote=vote)
    assert (r and r.value_milli) == milli


def test_topics_without_majority_keep_their_checks(spark):
    df = rules(spark, [("a", "<", 2.0, "cm", None), ("a", "<", 1.0, "MPa", None), ("a", "<", 2.0, "h", None), ("a", "<", 5.0, "%", None), ("a", "<", 3.0, "m2", None), ("a", "<", None, "cm", None)])
    assert rows(units.common_limits(df, family(spark)), "id", "value_milli") == [("r0", 20000), ("r1", 1000), ("r2", 2000), ("r3", 5000), ("r4", 3000)]


def test_units_odd_tables(spark):
    none = spark.createDataFrame([], f"id string, topic string, checks {CHECK}")
    assert units.common_limits(none, family(spark)).count() == 0
    odd = spark.createDataFrame([("a", None, None, 1), ("b", None, [], 2), ("c", None, [("l", None, 2.0, "cm", "x" * 50_000)], 3), ("c", None, [("l", None, 2.0, "cm", "x" * 50_000)], 4)], f"id string, topic string, checks {CHECK}, unit int")
    assert rows(units.common_limits(odd, family(spark)), "id", "value_milli") == [("c", 20000)]
    assert units.common_limits(odd, family(spark).where("false")).count() == 0


# ---- orphans (problem 6)


def day(n):
    return datetime.datetime(2026, 1, n)


def test_orphans(spark):
    lib = spark.createDataFrame(
        [("A1", day(1), day(1), None), ("A1", day(1), day(5), day(4)), ("b2 ", day(3), day(3), None), ("C3", day(1), day(2), day(2)), ("C3", day(1), day(6), None), (None, day(1), day(1), None), ("D4", day(1), None, None)],
        "ku_id string, created_at timestamp, updated_at timestamp, removed_at timestamp",
    )
    edges = spark.createDataFrame(
        [(1, "a1", "ｂ２", day(3)), (2, "A1", "B2", day(4)), (3, " a1 ", "B2", day(2)), (4, "zz", "C3", day(3)), (5, None, "　", day(3)), (6, "", "D4", day(3)), (1, "a1", "ｂ２", day(3)), (7, "A1", "zz", None)],
        "rel_id bigint, source_ku_id string, target_ku_id string, created_at timestamp",
    ).withColumn("key", F.lit("clash")).withColumn("side", F.lit("clash"))
    assert rows(orphans.orphan_ends(edges, lib), "rel_id", "side", "reason") == [(2, "source", "deleted"), (3, "target", "late"), (4, "source", "missing"), (7, "target", "missing")]
    counts = orphans.orphan_counts(orphans.orphan_ends(edges, lib))
    assert (("ku_relations_v1", None, "target", "missing", 1)) in rows(counts)
    assert orphans.orphan_ends(edges.where("false"), lib).count() == 0
    assert {r.reason for r in orphans.orphan_ends(edges, lib.where("false")).collect()} == {"missing"}


def test_orphans_with_a_hot_key(spark):
    lib = spark.createDataFrame([("HOT", day(9), day(9), None)], "ku_id string, created_at timestamp, updated_at timestamp, removed_at timestamp")
    edges = spark.range(3000).select(F.col("id").alias("rel_id"), F.lit("hot").alias("source_ku_id"), F.lit(None).cast("string").alias("target_ku_id"), F.lit(day(3)).alias("created_at"))
    assert rows(orphans.orphan_ends(edges, lib).groupBy("reason").count()) == [("late", 3000)]


def test_key(spark):
    df = spark.createDataFrame([(" ａb　",), ("﻿x\n",), ("  ",), (None,)], "k string")
    assert [r[0] for r in df.select(key(F.col("k"))).collect()] == ["AB", "X", None, None]


# ---- graph


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + k, 301 + k) for k in range(60)] + [(500, 500 + k) for k in range(80)] + [(7, 7)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = dict(rows(graph.connected_components(spark.createDataFrame([*edges, *edges[:20], (None, 5)], "a bigint, b bigint"))))
    assert got == {x: top(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- retrieval, tokens


def test_tokens(spark):
    df = spark.createDataFrame([("瓷砖胶 25mm厚，AB9 缝",), ("",), (None,)], "t string")
    got = [list(r[0]) for r in df.select(TK.tokens(F.col("t"), F.array(F.lit("胶")))).collect()]
    assert got[0] == ["胶", "胶", "瓷砖胶", "25mm厚", "25mm厚", "9", "9", "瓷砖", "砖胶", "胶厚", "厚缝", "25", "mm", "ab", "9"][:3] + got[0][3:]
    assert got[0].count("25mm厚") == 2 and "胶厚" in got[0] and got[1] == got[2] == ["胶", "胶"]


def test_bm25_prefers_rare_terms_and_keeps_statistics(spark):
    docs = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "x"]), ("c", ["x", "z"]), ("d", [])], "id string, tokens array<string>")
    q = spark.createDataFrame([("q", "x", 1), ("q", "z", 1), ("q", "unknown", 1)], "qid string, term string, qm bigint")
    index = retrieval.build_index(docs, F.col("tokens"))
    all_ = dict(rows(retrieval.bm25(index, q), "id", "score"))
    assert max(all_, key=all_.get) == "c" and "d" not in all_
    some = dict(rows(retrieval.bm25(index, q, docs.where("id = 'a'")), "id", "score"))
    assert some == {"a": all_["a"]}
    assert max(r.score for r in retrieval.tfidf(index, q).collect()) <= 1


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "qid string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "qid string, id string, rank int")
    one, two = (dict(rows(f, "id", "rrf")) for f in (retrieval.fuse(a, b), retrieval.fuse(b, a)))
    assert one == two and max(one, key=one.get) == "y"


# ---- curation


def test_segments(spark):
    df = spark.createDataFrame([(1, "first part, long enough to stay\n---\nshort\n---\nanother part that is long enough"), (2, "no separator here, but long enough"), (3, None), (4, "---")], "id int, t string")
    got = rows(curation.split_segments(df, "id", "t"), "id", "seg_no", "skipped")
    assert got == [(1, 0, False), (1, 1, True), (1, 2, False), (2, 0, False)]


def test_numbering(spark):
    old = spark.createDataFrame([("GZ-SY-00003",), ("GZ-SY-00010",), ("bad",), (None,)], "ku_id string")
    new = spark.createDataFrame([(f"n{k:03d}",) for k in range(50)], "name string").repartition(5)
    got = rows(curation.numbered(new, old, "ku_id", F.col("name")), "name", "new_id")
    assert [x for _, x in got] == [f"GZ-SY-{k:05d}" for k in range(11, 61)]
    assert rows(curation.numbered(new.limit(1), old.where("false"), "ku_id", F.col("name")), "new_id") == [("GZ-SY-00001",)]


def test_merge(spark):
    a = spark.createDataFrame([("1", "old"), ("2", "old"), ("", "x"), (None, "y")], "k string, v string")
    b = spark.createDataFrame([("2", "new"), ("3", "new"), ("3", "newer")], "k string, v string")
    assert rows(curation.upsert(a, b, "k", F.col("v"))) == [("1", "old"), ("2", "new"), ("3", "newer")]
    assert rows(curation.append_new(a, b, "k", F.col("v"))) == [("3", "new")]


def test_coerce(spark):
    df = spark.createDataFrame([("STAGE_04 (x)",), ("STAGE_01",), ("none",), (None,)], "s string")
    assert [r[0] for r in df.select(curation.coerce(F.col("s"), catalogue.STAGES)).collect()] == ["STAGE_04", "STAGE_01", None, None]


def test_similar_titles_equals_all_pairs(spark):
    r = random.Random(1)
    base = ["".join(r.choice("瓷砖空鼓渗水开裂墙面地漏防水吊顶") for _ in range(r.randint(4, 14))) for _ in range(60)]
    titles = base + [t[: len(t) // 2] + r.choice("大小") + t[len(t) // 2 :] for t in base[:30]] + ["", ""]
    data = [(k, t, "same" if k % 20 == 3 else f"text {k}") for k, t in enumerate(titles)]
    want = set()
    for i, t, x in data:
        for j, u, y in data:
            if i < j and t and u and difflib.SequenceMatcher(None, t, u).ratio() >= 0.8:
                want.add((i, j))
    got = {(r.id_a, r.id_b) for r in curation.similar_titles(spark.createDataFrame(data, "id int, title string, body string"), "id", "title", "body").where("title_ratio >= 0.8").collect()}
    assert got == want
    equal = {(r.id_a, r.id_b) for r in curation.similar_titles(spark.createDataFrame(data, "id int, title string, body string"), "id", "title", "body").where("text_ratio = 1").collect()}
    assert {(3, 23), (3, 43), (3, 63), (3, 83)} <= equal


def test_similar_texts_equal_all_pairs(spark):
    r = random.Random(2)
    han = "瓷砖空鼓渗水开裂墙面地漏防水吊顶木门窗帘灯带插座水槽花洒橱柜马桶"
    base = ["".join(r.choice(han) for _ in range(r.choice((3, 10, 40, 150, 260)))) for _ in range(40)]
    texts = list(base)
    for t in base:
        for share in (0.05, 0.15, 0.25, 0.3):
            u = [ch if r.random() > share else r.choice(["", r.choice(han), ch + r.choice(han)]) for ch in t]
            texts.append("".join(u))
    texts += [base[0], base[0], "", None]
    data = [(k, f"{k:05d}{chr(0x4E00 + 7 * k)}", t) for k, t in enumerate(texts)]
    want = {}
    for i, _, x in data:
        for j, _, y in data:
            if i < j and x and y and (v := difflib.SequenceMatcher(None, x, y).ratio()) >= 0.7:
                want[i, j] = round(v, 3)
    assert sum(v < 1 for v in want.values()) > 60
    df = spark.createDataFrame(data, "id int, title string, body string")
    got = {(x.id_a, x.id_b): x.text_ratio for x in curation.similar_titles(df, "id", "title", "body").where("text_ratio >= 0.7").collect()}
    assert got == want
    texts_ = spark.createDataFrame([(k, t) for k, t in enumerate(dict.fromkeys(t for t in texts if t))], "k int, x string")
    whole = {tuple(sorted(x)) for x in curation.similar_texts(texts_, 0.7).collect()}
    assert {tuple(sorted(x)) for x in curation.similar_texts(texts_, 0.7, block=30).collect()} == whole


def test_similar_titles_at_the_threshold(spark):
    df = spark.createDataFrame([(1, "瓷砖缝", "a"), (2, "瓷砖", "b"), (3, "砖瓷", "c"), (4, "砖缝大", "d")], "id int, title string, body string")
    assert rows(curation.similar_titles(df, "id", "title", "body"), "id_a", "id_b", "title_ratio") == [(1, 2, 0.8)]


def test_blocks_with_bonus_against_loops(spark):
    from plumbline.plans.q_retrieval import WEAK, blocks_with_bonus

    r = random.Random(6)
    bits = ["瓷砖", "空鼓", "地漏", "怎么", "处理", "墙", "厨房", "重新", "，", "a1", "第三章", "渗水"]
    text = lambda n: "".join(r.choice(bits) for _ in range(n))
    units = [(f"u{k:02d}", text(r.randint(1, 4)) if k % 9 else None, text(r.randint(2, 9)) if k % 7 else None) for k in range(50)]
    searches = [(f"q{k}", text(r.randint(1, 7))) for k in range(25)]
    want, plain = set(), 0
    for qid, q in searches:
        core = {w for w in re.findall(TK.alternation(TK.DICTIONARY), q)} - set(WEAK)
        parts = {s[i:j] for s in re.findall(f"[{TK.HAN}]{{2,}}", q) for i in range(len(s)) for j in range(i + 2, min(i + 6, len(s)) + 1)} - set(WEAK) - core
        found = []
        for i, t, d in units:
            t, d = t or "", d or ""
            a, b = sum(w in t for w in core), sum(w in d for w in core)
            if a + b:
                extra = sum(w in t or w in d for w in parts)
                plain += extra > 0
                found.append((-(6 * a + 3 * b + extra), -(a + b), not re.search("第[0-9一二三四五六七八九十百零两]+章", t), i))
        want |= {(qid, i, -sc, -n, k + 1) for k, (sc, n, _, i) in enumerate(sorted(found)[:3])}
    assert plain > 20
    got = blocks_with_bonus(spark.createDataFrame(units, "ku_id string, title string, description string"), spark.createDataFrame(searches, "qid string, question string"))
    assert {tuple(x) for x in got.select("qid", "ku_id", "score", "core_count", "rank").collect()} == want


def checked(text, rules, names):
    """The same by loops."""
    vals = [(float(m[1]), u, text[m.end() : m.end() + 4]) for u, ss in names.items() for m in re.finditer(rf"([0-9]+(?:\.[0-9]+)?)\s*(?:{'|'.join(ss)})", text)]
    vals = [(v, u) for v, u, f in vals if not any(h in f for h in curation.CONDITIONAL)]
    anywhere = {(v, u) for _, _, cs in rules for c in cs for v, u in vals if u == c[3] and abs(v - c[2]) <= 0.005}
    out = set()
    for rid, words, cs in rules:
        if not any(w in text for w in words):
            continue
        if not cs:
            out.add((rid, None, "no checks", None, None))
        active = strict = False
        for n, (_, op, target, unit, _) in enumerate(cs):
            same = [v for v, u in vals if u == unit]
            if any(abs(v - target) <= 0.005 for v in same):
                active = True
                out.add((rid, n, "paired", unit, target))
            elif same and (op in (">=", ">") and all(v > target for v in same) or op in ("<=", "<") and all(v < target for v in same)):
                active = strict = True
                out.add((rid, n, "stricter", unit, target))
        if active and not strict:
            out |= {(rid, None, "unpaired", u, v) for v, u in vals if u in {c[3] for c in cs} and (v, u) not in anywhere and not any(abs(v - c[2]) <= 0.005 for c in cs)}
    return out


def test_checked_rules_against_loops(spark):
    r = random.Random(4)
    names = {"mm": ["mm", "毫米"], "h": ["小时"], "%": ["%"]}
    words = ["栏杆", "净高", "养护", "含水率"]
    number = lambda: r.choice([1.0, 1.004, 1.005, 2.5, 3.0, 8.0, 24.0, 48.0])
    rule = [(f"r{k}", r.sample(words, r.randint(0, 2)), [("x", r.choice([">=", "<=", ">", "<", "=="]), number(), r.choice(list(names)), None) for _ in range(r.randint(0, 3))]) for k in range(30)]
    texts = ["".join(r.choice(words) + r.choice(["", "，"]) + f"{number():g} " + r.choice(["mm", "毫米", "小时", "%"]) + r.choice(["。", "以上", "时", "，约"]) for _ in range(r.randint(0, 5))) for _ in range(60)]
    data = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string")
    df = curation.checked_rules(data, "k", "t", spark.createDataFrame(rule + rule[:3], f"id string, keywords array<string>, checks {CHECK}"), names)
    want = {(k, *x) for k, t in enumerate(texts) for x in checked(t, rule, names)}
    assert {x[2 + 1] for x in want} == {"no checks", "paired", "stricter", "unpaired"}
    got = [tuple(x) for x in df.select("id", "rule_id", "check_no", "status", "unit_name", "number").collect()]
    assert set(got) == want and len(got) == len(want)


# ---- change log


def test_state_against_a_stack(spark):
    r = random.Random(5)
    state, stack, effects, undos = {}, [], [], []
    for seq in range(200):
        if stack and r.random() < 0.15:
            target = r.choice(stack)[0]
            undos.append((1, seq, target))
            while stack and stack[-1][0] >= target:
                _, k, before = stack.pop()
                state[k] = before
        else:
            k, after = f"k{r.randrange(8)}", None if r.random() < 0.2 else f"v{seq}"
            effects.append((1, seq, k, state.get(k), after))
            stack.append((seq, k, state.get(k)))
            state[k] = after
    e = spark.createDataFrame(effects, "registry int, seq bigint, key string, before string, after string")
    u = spark.createDataFrame(undos, "registry int, undo_seq bigint, target_seq bigint")
    assert dict(rows(changelog.state(e, u), "key", "value")) == {k: v for k, v in state.items() if v is not None}
    assert changelog.undone(e, u).where("undo_seq is null").count() == len(stack)


# ---- folds


def test_folds_against_models(spark):
    r = random.Random(2)
    data = [(k, r.randrange(4), datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=r.randrange(4000)), r.random() < 0.4) for k in range(400)] + [(900, None, day(1), False), (901, 1, None, False)]
    df = spark.createDataFrame(data, "n int, user int, ts timestamp, bad boolean")
    want = {}
    for u in range(4):
        seen = []
        for n, _, t, _ in sorted((d for d in data if d[1] == u and d[2]), key=lambda d: (d[2], d[0])):
            seen = [s for s in seen if (t - s).total_seconds() <= 60]
            want[n] = len(seen) < 2
            seen += [t] * want[n]
    got = {x.n: x.accepted for x in folds.rate_limit(df, "user", "ts", "n", 2, 60).collect()}
    assert got == want and 900 not in got and 901 not in got
    assert {x.outcome for x in folds.breaker(df, "user", "ts", "n", "bad", 2, 300).collect()} == {"ok", "failed", "blocked"}
    assert folds.ttl_cache(df, "user", "ts", "n", 10_000).where("not hit").count() == 4
    assert folds.ttl_cache(df.where("false"), "user", "ts", "n", 5).count() == 0


# ---- repair, evaluation, text


def test_repair(spark):
    t = spark.createDataFrame([(1, "aXbXc"), (2, "none"), (3, None)], "id int, text string")
    ops = spark.createDataFrame([(1, 2, "X", "Y"), (1, 1, "aX", "X"), (2, 1, "one", None), (9, 1, "q", "r")], "id int, op_no int, old string, new string")
    assert rows(repair.check_anchors(t, ops, "id")) == [(1, 1, 1, True), (1, 2, 2, False), (2, 1, 1, True), (9, 1, 0, False)]
    assert rows(repair.apply_ops(t, ops, "id"), "id", "text") == [(1, "YbYc"), (2, "n"), (3, None)]
    p = spark.createDataFrame([("d", 1), ("d", 40), ("d", 90), ("e", 5)], "d string, p int")
    assert rows(repair.clusters(p, "d", "p", 45), "d", "first", "last", "n") == [("d", 1, 40, 2), ("d", 90, 90, 1), ("e", 5, 5, 1)]
    assert t.select(repair.find_all(F.lit("aaa"), F.lit("aa"))).first()[0] == [1, 2]
    text = "同一句话。" * 30 + "只此一处。" + "同一句话。" * 30
    w = spark.createDataFrame([(text,)], "t string").select(repair.unique_window(F.col("t"), F.lit(text.index("只") + 1))).first()[0]
    assert text.count(w) == 1 and "只此" in w


def test_substitutions_and_census(spark):
    d = spark.createDataFrame([("abca", "xbcx"), ("ab", "abc"), (None, "x")], "a string, b string")
    assert rows(repair.substitutions(d, "a", "b")) == [("a", "x", 2)]


def test_greedy_match_is_the_sorted_greedy(spark):
    r = random.Random(4)
    pairs = [(g, a, b, r.randrange(5)) for g in range(12) for a in range(6) for b in range(6) if r.random() < 0.6]
    want = set()
    for g in range(12):
        used_a, used_b = set(), set()
        for _, a, b, c in sorted((p for p in pairs if p[0] == g), key=lambda p: (p[3], p[1], p[2])):
            if a not in used_a and b not in used_b:
                used_a.add(a), used_b.add(b), want.add((g, a, b, c))
    assert {tuple(x) for x in evaluation.greedy_match(spark.createDataFrame(pairs, "g int, a int, b int, cost int"), "g", "a", "b", "cost").collect()} == want


def test_ids_and_measures(spark):
    w = spark.createDataFrame([("a",), ("a#r2",), ("b",), ("zz",), (None,)], "sample string")
    k = spark.createDataFrame([("a",), ("b#r1",)], "id string")
    assert dict(rows(evaluation.resolve_ids(w, k), "sample", "resolved")) == {"a": "a", "a#r2": "a", "b": "b#r1", "zz": None, None: None}
    c = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "t boolean, s boolean")
    assert tuple(evaluation.confusion(c, F.col("t"), F.col("s")).first()) == (1, 1, 1, 0.5, 0.5)


def test_text(spark):
    d = spark.createDataFrame([(1, "x" * 101), (2, ""), (3, None), (4, "y" * 50)], "id int, t string")
    assert rows(textops.chunks(d, "id", "t").groupBy("id").agg(F.count("*"), F.count_if("completed"))) == [(1, 3, 1), (2, 1, 1), (4, 1, 1)]
    j = spark.createDataFrame([('x ```json\n{"k": 3}\n``` y',), ("no",), (None,)], "t string").select(textops.json_in(F.col("t"), "k int")["k"]).collect()
    assert [r[0] for r in j] == [3, None, None]
    p = spark.createDataFrame([("忽 略​以上的话",), ("导出 數據庫",), ("你好",), (None,)], "t string").select(textops.probe(F.col("t"))).collect()
    assert [r[0] for r in p] == ["A", "B", None, None]


# ---- files, streams


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('[{"ku_id": "A", "title": "t"}, {"ku_id": "B", "role": ["x"]}]', encoding="utf-8")
    (tmp_path / "in" / "b.json").write_text('{"ku_id": "C"}', encoding="utf-8")
    (tmp_path / "in" / "c.json").write_text("{broken", encoding="utf-8")
    j = files.read_json(spark, str(tmp_path / "in"))
    read = j.select("ku_id", "source_file", "corrupt").collect()
    assert sorted((r.ku_id, r.source_file) for r in read if r.corrupt is None) == [("A", "a.json"), ("B", "a.json"), ("C", "b.json")] and [r.source_file for r in read if r.corrupt] == ["c.json"]
    (tmp_path / "x.csv").write_text('﻿id,text\n1,"a ""b"",\nc"\n,\n2,\n', encoding="utf-8")
    assert rows(files.read_csv(spark, str(tmp_path / "x.csv"), ["id", "text"])) == [("1", 'a "b",\nc'), ("2", None)]
    (tmp_path / "words").write_text("承重 5 n\n\n地漏\n", encoding="utf-8")
    assert rows(files.read_words(spark, str(tmp_path / "words"))) == [("地漏", 2), ("承重", 2)]
    (tmp_path / "m").mkdir()
    for n in ("contract_a__p2.png", "contract_a__p1.png", "quote_b.pdf", "other.txt"):
        (tmp_path / "m" / n).write_text("x")
    got = {(r.stem, r.kind): [p.rpartition("/")[2] for p in r.pages] for r in files.read_material(spark, str(tmp_path / "m")).collect()}
    assert got == {("contract_a", "contract"): ["contract_a__p1.png", "contract_a__p2.png"], ("quote_b", "quote"): ["quote_b.pdf"]}
    df = spark.createDataFrame([("s1", ["a", "b"]), ("s2", None), ("s9", [])], "stage string, tags array<string>")
    files.write_shards(df, str(tmp_path / "shards"), "stage", ["s1", "s2"])
    assert sorted(r.stage for r in spark.read.parquet(str(tmp_path / "shards")).collect()) == ["s1", "s2"]
    one, two = files.write_version(df, str(tmp_path / "v")), files.write_version(df, str(tmp_path / "v"))
    assert one != two and spark.read.parquet(one).count() == 3
    files.write_csv(df, str(tmp_path / "csv"))
    assert rows(files.read_csv(spark, str(tmp_path / "csv"), ["stage", "tags"]), "stage", "tags")[0] == ("s1", "a,b")
    files.append(df, str(tmp_path / "log")), files.append(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6


def _run_once(writer):
    """Takes what is there and ends; a query with timeouts would go on for ever."""
    q = writer.trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()


def test_streams(spark, sf, tmp_path):
    from plumbline.streaming import usage

    log = spark.read.parquet(f"{sf}/usage_log_entry.parquet")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    s = usage.daily_counts(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), "400 days")
    _run_once(s.writeStream.outputMode("update").format("memory").queryName("days"))
    assert spark.sql("select sum(n) from days").first()[0] == log.select("log_id").distinct().count()
    ev = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).limit(300)
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    r = usage.rate_limited(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")), 2, 6 * 3600)
    _run_once(r.writeStream.outputMode("append").format("memory").queryName("limited"))
    saved = spark.read.parquet(str(tmp_path / "ev"))
    assert rows(spark.table("limited"), "event_id", "accepted") == rows(folds.rate_limit(saved, "user_id", "ts", "event_id", 2, 6 * 3600), "event_id", "accepted")
    ev = ev.withColumn("failed", F.col("event_id") % 3 != 0)
    ev.coalesce(1).write.parquet(str(tmp_path / "calls"))
    calls, saved = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "calls")), spark.read.parquet(str(tmp_path / "calls"))
    _run_once(usage.broken(calls, 2, 3 * 3600).writeStream.outputMode("append").format("memory").queryName("broken"))
    assert rows(spark.table("broken"), "event_id", "outcome") == rows(folds.breaker(saved, "user_id", "ts", "event_id", "failed", 2, 3 * 3600), "event_id", "outcome")
    _run_once(usage.cached(calls, 6 * 3600).writeStream.outputMode("append").format("memory").queryName("cached"))
    assert rows(spark.table("cached"), "event_id", "hit") == rows(folds.ttl_cache(saved, "user_id", "ts", "event_id", 6 * 3600), "event_id", "hit")


def test_rule_pairs_are_not_shuffled(spark):
    """A text and a rule with two common keywords meet once, without a step that makes pairs distinct: nothing is exchanged after the join that gives most rows."""
    names = {"mm": ["mm"]}
    rule = [("r", ["栏杆", "净高"], [("x", ">=", 1.0, "mm", None)]), ("s", ["净高", "栏杆"], [])]
    df = curation.checked_rules(spark.createDataFrame([(1, "栏杆净高 5 mm")], "k int, t string"), "k", "t", spark.createDataFrame(rule, f"id string, keywords array<string>, checks {CHECK}"), names)
    assert rows(df, "rule_id", "status") == [("r", "stricter"), ("s", "no checks")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    strict = plan[: plan.index("paired AS")]
    assert "Aggregate [id" not in strict
