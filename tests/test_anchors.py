"""Anchored edits: literal cases of each way, assignments, checks of a batch."""

from pyspark.sql import functions as F

from plumbline.operators import anchors

BODY = "先把基层清\n理干净再刷界面剂，等三天以后再贴砖。再贴砖之前要检查平整度。"
RECORD = "rec_id int, id string, field string, context string, old string, new string"


def found(spark, *recs, body=BODY, **ladder):
    texts = spark.createDataFrame([("k", "answer", body)], "id string, field string, body string")
    df = spark.createDataFrame([(n, "k", "answer", *r) for n, r in enumerate(recs)], RECORD)
    return sorted((x.rec_id, x.mode, x.pos) for x in anchors.sites(df, texts, **ladder).collect())


def test_ladder(spark):
    at = lambda s, n=0: BODY.index(s, n) + 1
    later = at("贴砖", at("贴砖"))
    assert found(spark, ("等三天以后再贴砖", "贴砖", "铺砖")) == [(0, "exact", at("贴砖"))]
    assert found(spark, ("基层清理干净", "清理", "处理"), ("基层清⏎理干净", "理", "里")) == [(0, "stripped", at("清")), (1, "exact", at("理"))]
    assert found(spark, ("先把...以后再贴砖。", "贴砖", "铺砖"), ("…检查平整度", "平整", "平直")) == [(0, "ellipsis", at("贴砖")), (1, "ellipsis", at("平整"))]
    assert found(spark, ("先把...以后再贴砖。", "贴砖", "铺砖"), gap=3) == []
    assert found(spark, ("同字段第二处", "贴砖", "铺砖")) == [(0, "note", at("贴砖")), (0, "note", later)] and found(spark, ("同字段第二处", "贴砖", "铺砖"), most_noted=1) == []
    assert found(spark, ("干净再刷界面剂，等五天以后再贴砖。再贴", "贴砖", "铺砖")) == [(0, "fuzzy", at("贴砖"))]
    assert found(spark, ("完全不同的内容贴砖", "贴砖", "铺砖"), (None, "贴砖", "x"), ("贴砖", "", "x"), ("没有", "没有", "x")) == []
    assert found(spark, ("", "x", "y"), body="") == []


def test_find_all_equals_loops(spark, monkeypatch):
    from plumbline.operators import repair

    cases = [("aaaa", "aa"), ("a.b.a.b", "."), ("x", "xx"), ("", "a"), (None, "a"), ("a", None), ("abc", ""), ("瓷🙂砖🙂", "🙂"), ("q\\Ez\\E", "\\E"), ("a\nb\na", "\na"), ("aba" * 40, "aba"), ("\\Q", "\\Q")]
    want = [[k + 1 for k in range(len(t)) if t.startswith(n, k)] if t and n else [] for t, n in cases]
    df = spark.createDataFrame(cases, "t string, n string").coalesce(1)
    for few in (1000, 0):
        monkeypatch.setattr(repair, "FEW", few)
        assert [x[0] for x in df.select(repair.find_all(F.col("t"), F.col("n"))).collect()] == want


def resolved(spark, recs, body, **k):
    texts = spark.createDataFrame([("k", "f", body)], "id string, field string, body string")
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(recs)], RECORD)
    return {x.rec_id: (x.status, x.pos) for x in anchors.resolve(df, texts, **k).collect()}


def test_assignment(spark):
    two = [("k", "f", "同字段", "ab", "xb"), ("k", "f", "同字段", "ab", "xb")]
    assert resolved(spark, two, "ab-ab") in ({0: ("assigned", 1), 1: ("assigned", 4)}, {0: ("assigned", 4), 1: ("assigned", 1)})
    assert resolved(spark, two, "ab") == {0: ("conflict", None), 1: ("conflict", None)}
    assert resolved(spark, two[:1], "ab-ab") == {0: ("ambiguous", None)}
    assert resolved(spark, [("k", "f", "ab-", "ab", "xb"), ("k", "f", "-ab", "ab", "aby")], "ab-ab") == {0: ("assigned", 1), 1: ("assigned", 4)}
    assert resolved(spark, [("k", "f", "zz", "zz", "y"), ("none", "f", "ab", "ab", "y")], "ab") == {0: ("no place", None), 1: ("no place", None)}
    assert resolved(spark, two, "ab-ab", most_solutions=1) == {0: ("ambiguous", None), 1: ("ambiguous", None)}


def test_assertions(spark):
    before = spark.createDataFrame([("a", "一二三"), ("b", "四五"), ("c", None)], "id string, text string")
    ops = spark.createDataFrame([("a", 1, "二", "贰贰")], "id string, op_no int, old string, new string")
    after = before.withColumn("text", F.replace("text", F.lit("二"), F.lit("贰贰")))
    spots = spark.createDataFrame([("a", "贰", True), ("b", "贰", False)], "id string, part string, wanted boolean")
    assert {x.name: x.n_failed for x in anchors.assertions(before, after, ops, "id", spots).collect()} == dict.fromkeys(("anchors", "replay", "untouched", "rows", "balance", "spots"), 0)
    wrong = after.withColumn("text", F.when(F.col("id") == "b", "四").otherwise(F.col("text"))).where("id <> 'c'")
    bad = {x.name: x.n_failed for x in anchors.assertions(before, wrong, ops.withColumn("old", F.lit("零")), "id", spots.withColumn("wanted", ~F.col("wanted")), 3).collect()}
    assert bad == {"anchors": 1, "replay": 2, "untouched": 1, "rows": 1, "balance": 0, "spots": 2}
