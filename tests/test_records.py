"""Logs of effects, matching, measures and verification of records against small models written as loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import catalogue, changelog, evaluation, retrieval, verification


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


# ---- change log


def test_undone_equals_all_pairs(spark):
    r = random.Random(4)
    effects = [(reg, s) for reg in "ab" for s in sorted(r.sample(range(5000), 150))] + [("c", 0), ("c", 1)]
    undos = [(reg, u, r.randint(-5, u)) for reg in "ab" for u in sorted(r.sample(range(5000), 40))] + [("c", 1, 0), ("d", 9, 1)]
    want = sorted((reg, s, min([u for g, u, t in undos if g == reg and u > s and t <= s], default=None)) for reg, s in effects)
    e, u = spark.createDataFrame(effects, "registry string, seq bigint"), spark.createDataFrame(undos, "registry string, undo_seq bigint, target_seq bigint")
    assert sorted(map(tuple, changelog.undone(e, u).collect()), key=str) == sorted(want, key=str)
    assert {x.undo_seq for x in changelog.undone(e, u.where("false")).collect()} == {None} and changelog.undone(e.where("false"), u).count() == 0


LOG = "registry string, seq bigint, op string, effect_id string, batch_id string, guard boolean, undo_guard boolean, protected boolean, forced boolean, guarded boolean, fails boolean"


def op(registry, seq, name, effect=None, batch=None, **flags):
    return (registry, seq, name, effect, batch, *(flags.get(k) for k in ("guard", "undo_guard", "protected", "forced", "guarded", "fails")))


def states(spark, log):
    return {(x.registry, x.seq): (x.state, x.undo_seq) for x in changelog.replay(spark.createDataFrame(log, LOG)).collect()}


def test_replay_cascades_and_guards(spark):
    log = [
        op("r", 1, "apply", "a", "x"), op("r", 2, "apply", "b", "y"), op("r", 3, "apply", "c", "x"), op("r", 4, "rollback", "b"), op("r", 5, "rollback", "b"), op("r", 6, "rollback", "none"), op("r", 7, "apply", "b"),
        op("r", 8, "apply", "d", "y", guard=False), op("r", 9, "apply", "d", "y", guard=False, forced=True), op("r", 10, "apply", "e", "z", fails=True), op("r", 11, "apply", "e", "z"), op("r", 12, "rollback_batch", None, "y"), op("r", 13, "apply", "f", protected=True),
        op("r", 14, "apply", "g", undo_guard=False), op("r", 15, "apply", "h"), op("r", 16, "rollback_all", guarded=True), op("r", 17, "rollback", "f"), op("r", 18, "unload"), op("r", 19, "apply", "i"), op("r", 20, "load"), op("r", 21, "apply", "i"),
        op("s", 1, "apply", "a", protected=True), op("s", 2, "rollback_all", forced=True), op("t", 5, "apply", None),
    ]
    got = states(spark, log)
    assert {k[1]: v for k, v in got.items() if k[0] == "r"} == {
        1: ("ROLLED_BACK", 16), 2: ("ROLLED_BACK", 4), 3: ("ROLLED_BACK", 4), 7: ("DUPLICATE", None), 8: ("SKIPPED", None), 9: ("ROLLED_BACK", 12), 10: ("FAILED", None), 11: ("ROLLED_BACK", 12), 13: ("ROLLED_BACK", 17), 14: ("SKIPPED", 16), 15: ("ROLLED_BACK", 16),
        19: ("SKIPPED", None), 21: ("APPLIED", None),
    }
    assert got["s", 1] == ("ROLLED_BACK", 2) and got["t", 5] == ("APPLIED", None) and states(spark, [op(None, 1, "apply", "a")]) == {}


def test_replay_equals_undone_where_only_effects_are_rolled_back(spark):
    r = random.Random(8)
    log, effects, undos = [], [], []
    for s in range(600):
        reg = r.choice("abc")
        if s > 20 and r.random() < 0.2:
            target = r.randint(s - 20, s - 1)
            alive = [e for g, e in effects if g == reg and not any(u[0] == reg and u[2] <= e < u[1] for u in undos) and e >= target]
            if alive:
                log.append(op(reg, s, "rollback", f"e{min(alive)}"))
                undos.append((reg, s, min(alive)))
        else:
            log.append(op(reg, s, "apply", f"e{s}"))
            effects.append((reg, s))
    e, u = spark.createDataFrame(effects, "registry string, seq bigint"), spark.createDataFrame(undos, "registry string, undo_seq bigint, target_seq bigint")
    want = {(x.registry, x.seq): ("APPLIED" if x.undo_seq is None else "ROLLED_BACK", x.undo_seq) for x in changelog.undone(e, u).collect()}
    assert len(undos) > 40 and states(spark, log) == want


def test_patches(spark):
    log = [("k", 1, "update", {"a": "0"}), ("k", 2, "add", {"a": "1", "b": "2"}), ("k", 3, "update", {"b": "3", "c": "4"}), ("k", 4, "update", {"a": None}), ("m", 1, "add", {"a": "1"}), ("m", 2, "remove", None), ("m", 3, "update", {"a": "2"}), ("n", 1, "add", {})]
    df = spark.createDataFrame(log, "key string, seq bigint, op string, patch map<string, string>")
    assert rows(changelog.patched(df)) == [("k", "b", "3", 2), ("k", "c", "4", 2)] and changelog.patched(df.where("false")).count() == 0


# ---- matching


def test_either_contains_equals_nested_loops(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("砖墙a") for _ in range(r.randint(0, n)))
    left = [(r.choice("xy"), k, word(3)) for k in range(40)] + [("x", 90, None), (None, 91, "砖")]
    right = [(r.choice("xyz"), k, word(6)) for k in range(40)] + [("x", 90, None)]
    want = sorted((a, b) for g, a, s in left for h, b, t in right if g and g == h and s is not None and t is not None and (s in t or t in s))
    l, q = spark.createDataFrame(left, "g string, i int, s string"), spark.createDataFrame(right, "g string, j int, t string")
    assert sorted(map(tuple, evaluation.either_contains(l, q, "g", "s", "t").select("i", "j").collect())) == want
    assert evaluation.either_contains(l.where("false"), q, "g", "s", "t").count() == 0


def test_prefixes_and_ranges(spark):
    df = spark.createDataFrame([("a_b_c",), ("a",), ("ab",), ("",), (None,)], "s string")
    known = spark.createDataFrame([("a",), ("a_b",), ("",), ("c",)], "k string")
    assert rows(evaluation.prefix_join(df, "s", known, "k")) == [("", ""), ("a", "a"), ("a_b_c", "a"), ("a_b_c", "a_b")]
    v = spark.createDataFrame([(50.0, 100.0, 200.0), (250.0, 100.0, 200.0), (100.0, 100.0, 200.0), (None, 1.0, 2.0), (-1.0, 0.0, 2.0)], "v double, lo double, hi double")
    off, side = evaluation.from_range(F.col("v"), F.col("lo"), F.col("hi"))
    assert [tuple(x) for x in v.select(off, side).collect()] == [(50.0, "low"), (25.0, "high"), (0.0, None), (None, None), (None, "low")]
    w = evaluation.in_window(F.col("v"), [("a", 50, 100), ("b", 90, 200)], "rest")
    assert [x[0] for x in v.select(w).collect()] == ["a", "rest", "b", None, "rest"]


def test_quote_measures_equal_loops(spark):
    r = random.Random(3)
    names = ["瓷砖", "瓷砖地砖", "门套", "门", "防水", ""]
    truth = [(f"s{r.randint(0, 4)}", k, r.choice(names[:5]), r.choice(["100", "90.5", "", None]), r.choice(["1", "0", None]), r.choice(["missing", "price", None])) for k in range(40)]
    items = [(f"s{r.randint(0, 5)}", k, r.choice([*names, None]), r.choice(["100", "90", "x", None]), r.choice(["warning: a", "ok", None])) for k in range(30)]
    missing = [("s1", "门"), ("s2", "防水层"), ("s2", "防水层")]
    close = lambda a, b, t: abs(a - b) <= t * abs(b)
    num = lambda x: float(x) if x not in (None, "", "x") else None
    want = dict.fromkeys(("n_truth", "recalled", "n_price", "price_right", "pits", "pits_hit", "false_alarms"), 0)
    for s in {t[0] for t in truth} | {i[0] for i in items}:
        ts, its = [t for t in truth if t[0] == s], [i for i in items if i[0] == s]
        pairs = []
        for t in ts:
            for i in its:
                if t[2] in (i[2] or "") or (i[2] or "") in t[2]:
                    d = 100.0 if not t[3] else 9.9 if num(i[3]) is None else abs(num(i[3]) - float(t[3])) / float(t[3])
                    pairs.append((d, t[1], i[1]))
        given, used = {}, set()
        for _, a, b in sorted(pairs):
            if a not in given and b not in used:
                given[a] = b
                used.add(b)
        for t in ts:
            first = next((i for i in its if t[2] in (i[2] or "") or (i[2] or "") in t[2]), None)
            want["n_truth"] += 1
            want["recalled"] += first is not None
            if first is not None and t[3]:
                said = num(next((i[3] for i in its if i[1] == given.get(t[1])), first[3]))
                want["n_price"] += 1
                want["price_right"] += said is not None and close(said, float(t[3]), 0.01)
            if t[4] == "1":
                want["pits"] += 1
                want["pits_hit"] += bool(first and (first[4] or "").startswith("warning") or t[5] == "missing" and any(m[0] == s and (t[2] in m[1] or m[1] in t[2]) for m in missing))
        want["false_alarms"] += sum((i[4] or "").startswith("warning") and not any(t[4] == "1" and t[2] in (i[2] or "") for t in ts) for i in its)
    got = evaluation.quote_measures(
        spark.createDataFrame(truth, "sample string, row_no int, entry string, price string, is_pit string, pit_type string"), spark.createDataFrame(items, "sample string, item_no int, item string, unit_price string, status string"), spark.createDataFrame(missing, "sample string, name string")
    )
    assert got.first().asDict() == want


def test_accuracy_and_providers(spark):
    df = spark.createDataFrame([("10.4", "10", "a", "a "), ("x", "10", "b", "a"), ("1", "", None, "a"), ("0", "0", "a", None)], "s string, t string, c string, d string")
    assert rows(evaluation.accuracy(df, {"n": (F.col("s"), F.col("t"), "number"), "c": (F.col("c"), F.col("d"), "code")})) == [("c", 3, 1, 0.333333), ("n", 3, 2, 0.666667)]
    truth = spark.createDataFrame([("a", "砖"), ("a", "砖"), ("a", "墙"), ("b", "门"), ("a", "")], "sample string, entry string")
    items = spark.createDataFrame([("p", "a_1", "瓷砖"), ("p", "a_1", ""), ("q", "c", "门"), ("q", "b", "木")], "provider string, sample string, name string")
    cells = evaluation.recall_by_provider(truth, items)
    assert rows(cells) == [("p", "a_1", 2, 4), ("q", "b", 0, 1)] and rows(evaluation.micro_recall(cells)) == [("p", 2, 4, 0.5, 0.5), ("q", 0, 1, 0.0, 0.5)]
    avg = evaluation.provider_averages(items.withColumn("n", F.length("name")), spark.createDataFrame([("p",), ("z",)], "provider string"), F.col("n") > 0, ["n"])
    assert rows(avg) == [("p", 1, 2.0), ("z", 0, None)]


# ---- verification


@pytest.mark.parametrize("question, title, reason", [("", None, "empty"), (None, "", "empty"), ("  短问题  ", "x", "short:3"), (None, "卫生间的地漏返水怎么办", None), ("务必注意厨房的安全通道", None, "broad:注意"), ("厨房水管接头滴水怎么修", "注意", None)])
def test_narrow_rule(spark, question, title, reason):
    assert spark.createDataFrame([(question, title)], "q string, t string").select(verification.too_broad(F.col("q"), F.col("t"))).first()[0] == reason


def test_schema_and_truth_rows(spark):
    df = spark.createDataFrame([("a", "t", None, None), ("", "", "law", "x"), ("b", "t", "standard", "")], "id string, title string, kind string, body string")
    assert [x[0] for x in df.select(verification.schema_errors(df, "id", "title", "kind", {"standard": ["body"]})).collect()] == [[], ["missing:id", "type", "missing:title"], ["standard:body"]]
    t = spark.createDataFrame([("1,200.5", "", "半包"), ("", None, "x"), ("abc", "R", "x"), (" 7 ", None, None)], "total string, rules string, kind string")
    bad = verification.contract_errors([F.col("total"), F.col("rules")], {"total": F.col("total")}, {"kind": (F.col("kind"), ["半包", "全包"])})
    assert [x[0] for x in t.select(bad).collect()] == [[], ["missing:any"], ["number:total", "enum:kind"], []]
    q = spark.createDataFrame([("", "1"), ("5", "2"), ("5", ""), ("5", " 0")], "p string, x string")
    assert [x[0] for x in q.select(verification.quote_error(F.col("p"), F.col("x"))).collect()] == ["missing:price", "form:is_pit", None, None]


def test_obsolete_clauses_are_bounded_by_digits(spark):
    df = spark.createDataFrame([("GB 50210 第 3.1.4 条",), ("GB 50210 第 13.1.4 条",), ("GB 50210 第 3.1.45 条 6.1.11",), ("GB 50210 3.1.4，见 GB 55032",), ("3.1.4",), (None,)], "t string")
    assert [x[0] for x in df.select(verification.obsolete(F.col("t"), "GB 50210", ["3.1.4", "6.1.11"], "55032")).collect()] == ["3.1.4", None, "6.1.11", None, None, None]


def test_batches_and_proofs(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "bad"), (3, "b", None), (4, None, None)], "k int, batch string, error string")
    assert rows(verification.whole_batches(df, "batch", F.col("error")), "k") == [(3,), (4,)]
    assert rows(verification.append_truth(df.where("k = 1"), df.unionByName(df), "k"), "k") == [(2,), (2,), (3,), (3,), (4,), (4,)]
    c = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (9, "y"), (2, "x"), (None, "x")], "k int, name string")
    assert tuple(verification.coverage_proof(c, df, "k", "name").first()) == (4, 3, 1, 1, 2, False)
    assert verification.coverage_proof(c.where("k = 1"), df, "k", "name", 3).first().proven and not verification.coverage_proof(c.where("k = 1"), df, "k", "name", 2).first().proven
    assert tuple(verification.unchanged(df, df.where("k <> 2").unionByName(df.where("k = 3")), df.where("k = 2"), "k").first()) == (0, 1)


def test_lists_metadata_and_picks(spark):
    df = spark.createDataFrame([("a", "x", ["m"]), ("b", "", None)], "ku_id string, s string, l array<string>")
    assert rows(verification.as_lists(df, "s", "l")) == [("a", ["x"], ["m"]), ("b", [], [])]
    m = verification.enriched(df, "2026-01-01").where("ku_id = 'a'").first()
    assert m.scope == "universal" and m.related_ku_ids == [] and m.metadata.quality_level == "DRAFT" and m.metadata.verified is False
    assert rows(verification.picked(df, "ku_id", ["b", "z"]), "ku_id") == [("b",)] and rows(verification.picked(df, "ku_id", limit=1), "ku_id") == [("a",)]
    codes = catalogue.universe(spark, {"d": ["x", "y", "z"]})
    counts = spark.createDataFrame([("d", "x", 3), ("d", "z", 50)], "dim string, key string, n bigint")
    assert rows(catalogue.recommendations(counts, codes)) == [("d", "x", 3, "P1"), ("d", "y", 0, "P0")]


def test_batches_are_compared_with_what_is_before(spark):
    import difflib

    from plumbline.operators import curation

    r = random.Random(5)
    han = "瓷砖空鼓渗水开裂墙面地漏防水"
    text = lambda: "".join(r.choice(han) for _ in range(r.randint(4, 10)))
    pool = [(f"e{k:02d}", text(), text()) for k in range(12)]
    batch = [(f"n{k:02d}", r.choice([text(), pool[k][1], pool[k][1] + "水"]), r.choice([text(), pool[11 - k][2][:-1]]), k) for k in range(12)] + [("n90", None, "", 12)]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0
    want = []
    for n, (i, t, x, _) in enumerate(batch):
        best = None
        for j, u, y, *_ in [*pool, *batch[:n]]:
            a, b = ratio(t, u), ratio(x, y)
            if (a >= 0.8 or b >= 0.7) and (best is None or round(max(a if a >= 0.8 else a, b), 3) > best[1]):
                best = (j, round(max(a, b), 3))
        if best:
            want.append((i, *best))
    old, new = spark.createDataFrame(pool, "id string, t string, x string"), spark.createDataFrame(batch, "id string, t string, x string, n int")
    got = rows(curation.first_similar(old, new, "id", "t", "x", "n"))
    assert len(want) > 6 and {g[0] for g in got} == {w[0] for w in want}
    assert [g for g in got if g[2] >= 0.8] == [w for w in sorted(want) if w[2] >= 0.8]


# ---- index


def test_index_is_saved_and_loaded(spark, tmp_path):
    docs = spark.createDataFrame([("a", ["x", "x", "y"]), ("b", ["y"]), ("c", [])], "id string, t array<string>")
    index = retrieval.build_index(docs, F.col("t"))
    retrieval.save_index(index, f"file://{tmp_path}/index")
    again = retrieval.load_index(spark, f"file://{tmp_path}/index")
    q = retrieval.query_terms(spark.createDataFrame([("q", ["x", "y", "none"])], "qid string, t array<string>"), F.col("t"))
    for arm in (retrieval.bm25, retrieval.tfidf):
        assert rows(arm(again, q)) == rows(arm(index, q)) and len(rows(arm(index, q))) == 2


# ---- texts, caches, files


def test_question_and_answer_blocks(spark):
    from plumbline.operators import textops

    a = "先把基层清理干净，再刷界面剂，等三天以后贴砖"
    texts = [
        f"Q：卫生间的瓷砖空鼓怎么办\nA：{a}。\n问题：短\n回答：{a}\n问题：厨房的水槽堵塞了怎么办\n回答：{a}，不要着急\n", f"以下：\n1. 卫生间的瓷砖空鼓怎么办 回答：{a}\n* 太短 答：{a}\n2. 没有答案的一段很长很长很长很长很长很长很长很长很长的话", "无", None, "",
        "".join(f"\nQ：第{k}个问题是什么样的\nA：{a}" for k in range(30)) + "\n", f"Q: what about the tiles\nA: {'x' * 25}\n",
    ]
    got = [[(e.question, e.answer, e.tags) for e in x[0]] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(textops.qa_entries(F.col("t"))).collect()]
    assert [(q, s) for q, s, _ in got[0]] == [("卫生间的瓷砖空鼓怎么办", a), ("厨房的水槽堵塞了怎么办", f"{a}，不要着急")] and got[0][0][2] == ["卫生间的", "瓷砖空鼓", "怎么办", "先把基层", "清理干净"]
    assert [(q, s) for q, s, _ in got[1]] == [("卫生间的瓷砖空鼓怎么办", a)] and got[2:5] == [[], [], []] and len(got[5]) == 20 and got[6][0][2] == ["装修", "知识"]


def test_marks_folds_and_profiles(spark):
    from plumbline.operators import textops

    df = spark.createDataFrame([(1, "a\nA \n a\nb\nb\n\n"), (2, None), (3, "")], "id int, t string")
    m = "\n--end"
    assert [x[0] for x in df.select(textops.marked(textops.marked(F.col("t"), m), m)).collect()] == ["a\nA \n a\nb\nb\n\n\n--end", None, ""]
    assert rows(textops.folded_lines(df, "id", "t")) == [(1, 0, "a", 3), (1, 3, "b", 1), (1, 4, "b", 1), (1, 5, "", 1), (1, 6, "", 1), (3, 0, "", 1)]
    p = textops.profile(F.col("t"))
    said = spark.createDataFrame([("120平 3室，预算30 万，半包还是全包，新中式，有小孩和狗",), (None,), ("平 万",)], "t string").select(*(c.alias(n) for n, c in p.items()))
    assert [tuple(x) for x in said.collect()] == [(120, 300000, 3, "全包", "新中式", True, True), (None, None, None, None, None, False, False), (None, None, None, None, None, False, False)]


def test_lru_cache_and_sessions(spark):
    import datetime

    from plumbline.operators import folds

    r = random.Random(6)
    start = datetime.datetime(2026, 1, 1)
    data = [(r.choice("xy"), r.choice("abcdef"), start + datetime.timedelta(seconds=r.randint(0, 4000)), k) for k in range(300)] + [(None, "a", start, 900), ("x", "a", None, 901)]
    got = {x.n: x.hit for x in folds.lru_cache(spark.createDataFrame(data, "s string, k string, at timestamp, n int"), "s", "k", "at", "n", 600, 3).collect()}
    want = {}
    for scope in "xy":
        held: dict = {}
        for _, k, at, n in sorted((d for d in data if d[0] == scope and d[2]), key=lambda d: (d[2], d[3])):
            want[n] = k in held and (at - held[k]).total_seconds() < 600
            put = held.pop(k, None)
            held[k] = put if want[n] else at
            if len(held) > 3:
                del held[next(iter(held))]
    assert got == want and any(want.values())
    df = spark.createDataFrame([("u", start, 1, "a"), ("u", start, 2, "b"), ("u", start + datetime.timedelta(1), 3, None), ("v", start, 1, None), (None, start, 1, "x")], "u string, at timestamp, n int, v string")
    assert [tuple(x)[3:] for x in folds.sessions(df, "u", "at", "n", "v", 1).orderBy("user").collect()] == [(3, "b", ["b"]), (1, None, [])]


def test_state_and_marked_files(spark, tmp_path):
    from plumbline.sources import files

    folder = f"file://{tmp_path}/state"
    schema = "id string, n int"
    assert files.read_state(spark, folder, schema).count() == 0
    for k in (1, 2):
        files.write_state(spark.createDataFrame([("a", k)], schema), folder)
        assert rows(files.read_state(spark, folder, schema)) == [("a", k)]
    (tmp_path / "state" / "part-x.json").write_text("{broken")
    assert files.read_state(spark, folder, schema).count() == 0 and (tmp_path / "state.bak").is_dir() and not (tmp_path / "state").exists()
    files.write_csv(spark.createDataFrame([(["x", "y"], 'say "a"')], "tags array<string>, t string").coalesce(1), f"file://{tmp_path}/csv", mark=True)
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    assert part.read_bytes() == b'\xef\xbb\xbftags,t\n"x,y","say ""a"""\n' and rows(files.read_csv(spark, f"file://{tmp_path}/csv", ["tags", "t"])) == [("x,y", 'say "a"')]


def test_blocks_find_what_joins_find(spark, monkeypatch):
    """Many blocks and groups; equal documents, whose ties go to the least ids; rows that leave the tasks are few."""
    from plumbline.operators import blocks

    r = random.Random(8)
    word = lambda: r.choice("abcdefghij")
    texts = [[word() for _ in range(r.randint(0, 9))] for _ in range(40)]
    docs = spark.createDataFrame([(f"d{k:03d}", texts[k % 40]) for k in range(200)], "id string, t array<string>")
    q = retrieval.query_terms(spark.createDataFrame([(f"q{k}", [word() for _ in range(k % 6)] + ["none"]) for k in range(30)], "qid string, t array<string>"), F.col("t"))
    monkeypatch.setattr(blocks, "BLOCK", 100)
    monkeypatch.setattr(blocks, "ASKED", 20)
    index = retrieval.build_index(docs, F.col("t"))
    for allowed in (None, docs.where("id like 'd0%'"), docs.where("false")):
        found = blocks.search(docs, F.col("t"), q, 4, ("bm25", "tfidf"), retrieval.K1, retrieval.B, allowed=allowed)
        for arm, got in zip((retrieval.bm25, retrieval.tfidf), found, strict=True):
            want = rows(retrieval.top_k(arm(index, q, allowed), 4), "qid", "id", "rank", "score")
            assert rows(got, "qid", "id", "rank", "score") == want
    assert set(blocks.best_of(np.full(5000, 0.5), 4, np.arange(5000)[::-1])) == {4996, 4997, 4998, 4999}


def test_best_scores_by_columns_are_those_of_all(monkeypatch):
    from plumbline.operators import blocks

    rng = np.random.default_rng(4)
    cases = [np.round(rng.random(n) * (rng.random(n) < share), digits) for n in (1, 3, 255, 256, 700, 4096, 5001, 5063) for share in (0.002, 0.1, 1) for digits in (1, 6, 9)]
    for score in cases:
        found = set(blocks._at_least_kth(score, 4, 1e-6).tolist())
        v = np.sort(score)[::-1][min(4, len(score)) - 1]
        assert found == set(np.flatnonzero((score >= v - 1e-6) & (score > 0) if v > 1e-6 else score > 0).tolist())


def test_hybrid_search_reads_each_table_once(spark, sf, monkeypatch):
    """The result hangs on tables already written; vocabulary rows have empty lists, not null ones."""
    from plumbline.operators import blocks
    from plumbline.plans import q_retrieval

    own = []
    meet = blocks.meet
    monkeypatch.setattr(blocks, "meet", lambda *args: (own.append(args[-1]), own.append(args[-1].where("terms is null or times is null").count()), meet(*args))[-1])
    found = q_retrieval.hybrid_search_expanded(spark, sf)
    assert found.count() and own[1:] == [0]
    assert found.inputFiles() and not any("/knowledge_" in f for f in found.inputFiles())


def test_weighted_words_in_blocks(spark, monkeypatch):
    """Against loops: equal sets of words, ties by id, entries and searches without any word, nulls, words within words."""
    from plumbline.operators import blocks

    r = random.Random(9)
    words = ["瓷砖", "瓷砖胶", "砖", "胶水"]
    text = lambda: None if r.random() < 0.1 else "".join(r.choice(["瓷砖", "胶", "水", "墙"]) for _ in range(r.randint(0, 4)))
    entries, searches = [(f"e{k:02d}", text(), text()) for k in range(90)], [(f"q{k}", text()) for k in range(30)]
    want = []
    for qid, q in searches:
        held = [w for w in words if w in (q or "")]
        found = sorted((-sum(3 * (w in (a or "")) + (w in (b or "")) for w in held), i) for i, a, b in entries)
        want += [(qid, i, -s, n + 1) for n, (s, i) in enumerate(found[:3]) if s]
    monkeypatch.setattr(blocks, "BLOCK", 40)
    df = spark.createDataFrame(entries, "id string, a string, b string")
    got = blocks.weighted(df, spark.createDataFrame(searches, "qid string, question string"), "question", words, {"a": 3, "b": 1}, 3)
    assert rows(got, "qid", "id", "score", "rank") == sorted(want, key=str) and len(want) > 20
    assert max(blocks._best_small(np.ones(9000, np.int16), 3)) == 2


def test_windows_are_numbered_exactly():
    from plumbline.operators.blocks import Windows

    r = random.Random(3)
    text = lambda: "".join(r.choice("一丁鿿，a😀") for _ in range(r.randint(0, 9)))
    cut = lambda t: {t[i:j] for i in range(len(t)) for j in range(i + 2, min(i + 6, len(t)) + 1) if set(t[i:j]) <= set("一丁鿿")}
    texts, others = [text() for _ in range(40)], [text() for _ in range(40)]
    known = Windows(texts)
    words = sorted(set().union(*map(cut, texts)))
    number = dict(zip(words, known.number(words).tolist(), strict=True))
    assert sorted(number.values()) == list(range(known.n)) and known.number(["鿿" * 7, "丁a"]).tolist() == [-1, -1]
    got = {(t, n) for t, n in zip(*map(list, map(np.ndarray.tolist, known.found(others))), strict=True)}
    assert got == {(k, number[w]) for k, t in enumerate(others) for w in cut(t) if w in number}
