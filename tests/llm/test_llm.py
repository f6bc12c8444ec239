"""Operators of the llm subpackage: literal cases, brute force on small fixtures, exact round trips, held-out accuracy, odd tables."""

import datetime
import random
import string
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import boosting, language, mixing, neardup, normalise, pairs, pii, tokenise, toxicity


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


# ---- problem 1


@pytest.mark.parametrize("text, form", [
    ("ａｂｃ　１２㎡", "abc 12m²"), ("é", "é"), ("e​́", "é"), ("⽔⼯", "水工"), ("理", "理"), ("Νρ6270", "Np6270"), ("pаy", "pay"), ("a\r\nb\rc", "a\nb\nc"), ("\xa0x ​", "x"), ("㎜", "mm"), ("m²", "m²"),
    ("Москва", "Москва"), ("", ""), (None, None), ("A a", "A a"), ("a  b", "a  b"), ("가", "가"), ("🙂", "🙂"), ("́", "́"),
    ("Ӧlbad", "Ölbad"), ("О\u0308lbad", "Ölbad"), ("tὸp", "tòp"), ("моё", "моё"), ("sӏow cօde ɡood", "slow code good"), ("3∶1", "3:1"), ("x\U000e0100y\U000e0041\u206a\ufff9z", "xyz"), ("\U0001fbf22", "22"), ("⺠宅", "民宅"),
])
def test_canonical(text, form):
    assert normalise.canonical(text) == form


def test_canonical_is_stable_and_spliced():
    r = random.Random(1)
    alphabet = "中文，。abcＡＢ１２ 　\xa0​́̈eаο㎡㎜⽔²\n\r가ᅡ🙂"
    for _ in range(3000):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))
        c = normalise.canonical(t)
        assert normalise.canonical(c) == c
        plain = "".join(normalise._single(ch) for ch in t.replace("\r\n", "\n"))
        whole = unicodedata.normalize("NFC", plain)
        assert unicodedata.normalize("NFC", normalise._WORD.sub(normalise._latin, whole)).strip(" \n") == c


def entries(spark, data):
    return spark.createDataFrame([(*d, "clash") for d in data], "id string, question string, answer string, form string")


def test_same_looking(spark):
    q = "这是一个足够长的问题文本ab"
    data = [("1", q, None), ("2", q.replace("a", "а"), ""), ("3", q, "x"), ("4", q.upper(), None), ("1", q, None), ("5", "短", "短"), (None, q + "​", None), ("6", q + "​", "x" * 60_000)]
    df = entries(spark, data)
    want = {("question", a, b) for a, b in (("1", "2"), ("2", "3"), ("1", "6"), ("2", "6"), ("3", "6"))}
    assert set(rows(normalise.same_looking(df))) == want
    star = set(rows(normalise.same_looking(df, full_class=1)))
    assert star <= want and {x for _, a, b in star for x in (a, b)} == {"1", "2", "3", "6"}
    assert normalise.same_looking(df.where("false")).count() == 0
    assert rows(normalise.normalise_fields(df, ["question"]).where("id = '2'"), "question", "answer", "form") == [(q, "", "clash")]


def test_same_looking_yields_all_pairs_of_large_classes(spark):
    q = "这是一个足够长的问题文本ab"
    spelled = [q, q + "​", q.replace("a", "а"), q.replace("b", "ｂ"), "　" + q]
    data = [(f"{k:03d}", spelled[k % 7 % 5], None) for k in range(60)] + [("x", "另一个足够长的问题文本cd", None), ("y", "另一个足够长的问题文本ｃd", None)]
    want = {("question", i, j) for i, t, _ in data for j, u, _ in data if i < j and t != u and normalise.canonical(t) == normalise.canonical(u)}
    df = entries(spark, data)
    for bound in (512, 8, 1):
        assert set(rows(normalise.same_looking(df, full_class=bound))) == want


# ---- problem 2


def test_near_duplicates_equal_all_pairs(spark):
    r = random.Random(7)
    han = "瓷砖空鼓渗水开裂墙面地漏防水吊顶木门窗帘灯带插座水槽花洒橱柜马桶"
    base = ["".join(r.choice(han) for _ in range(r.randint(20, 120))) for _ in range(40)]
    data = []
    for k, t in enumerate(base):
        data.append((f"a{k}", t, None))
        for c in range(r.randint(0, 3)):
            u = list(t)
            for _ in range(r.randint(0, 8)):
                u[r.randrange(len(u))] = r.choice(han)
            data.append((f"b{k}{c}", None, "".join(u)))
    data += [("e1", None, None), ("e2", "", " "), ("s1", "ab", None), ("s2", "AB", ""), ("dup", base[0], None), ("dup", base[0], None), (None, base[0], None)]
    key = {i: normalise.letters_and_digits(normalise.canonical((q or "") + (a or ""))) for i, q, a in data if i}
    ids = sorted(key)
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if key[a] and key[b] and neardup.jaccard(key[a], key[b]) >= 0.6}
    df = entries(spark, data)
    assert set(rows(neardup.pairs(df))) == want
    star = set(rows(neardup.pairs(df, full_class=1)))
    assert star <= want
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = {i: g for i, g, _ in rows(neardup.groups(df), "id", "group_id", "n_links") if key[i]}
    assert got == {i: top(i) for i in ids if key[i]}
    assert neardup.pairs(df.where("false")).count() == 0


def test_near_duplicates_of_large_classes_give_all_pairs(spark):
    t = "卫生间的瓷砖空鼓了应该怎么处理比较好先把基层清理干净再刷界面剂"
    data = [(f"{k:02d}", t + ("。" if k % 2 else "") + ("等三天" if k % 3 == 0 else ""), None) for k in range(24)]
    want = {(a[0], b[0]) for a in data for b in data if a[0] < b[0]}
    for bound in (512, 5, 1):
        assert set(rows(neardup.pairs(entries(spark, data), full_class=bound))) == want


def test_texts_repeated_in_every_partition_are_signed_once(spark):
    t = "卫生间的瓷砖空鼓了应该怎么处理比较好先把基层清理干净再刷界面剂"
    data = [(f"{k:03d}", t + ("等三天再贴" if k % 2 else ""), "。" if k % 3 else None) for k in range(160)] + [("e1", None, None), ("e2", " ", "？"), ("e2", None, None)]
    df = entries(spark, data).repartition(8)
    members, texts = neardup.signed(df)
    assert texts.count() == 2 == texts.select("h").distinct().count() and members.count() == 162 and members.where("h is null").count() == 2
    assert neardup.class_links(texts).count() == 1
    got = {i: (g, n) for i, g, n in rows(neardup.groups(df), "id", "group_id", "n_links")}
    assert got == {f"{k:03d}": ("000", 1) for k in range(160)} | {"e1": ("e1", 0), "e2": ("e2", 0)}


def test_pairs_that_only_meet_are_not_written(spark, monkeypatch):
    r = random.Random(5)
    han = [chr(c) for c in range(0x4E00, 0x5600)]
    common = "".join(r.choice(han) for _ in range(80))
    data = [(f"{k:03d}", common + "".join(r.choice(han) for _ in range(100)), None) for k in range(200)]
    data.append(("like", data[0][1][:-3], None))
    written = []
    kept = neardup.materialise
    monkeypatch.setattr(neardup, "materialise", lambda df, label: (x := kept(df, label), label.startswith("round") and written.append(x.count()))[0])
    monkeypatch.setattr(neardup, "LIST", 50)
    monkeypatch.setattr(neardup, "PAIRS", 100)
    assert rows(neardup.pairs(entries(spark, data))) == [("000", "like")]
    posted, _ = neardup.signatures([t for _, t, _ in data])
    met = sum(int((n * (n - 1) // 2).sum()) for c in posted.T for n in [np.unique(c, return_counts=True)[1]])
    assert met > 1000 and sum(written) < met / 5


def test_batches_of_long_texts_are_cut():
    import pyarrow as pa

    c = pa.array(["x" * 10, None, "y" * 50, "", "z" * 5, "瓷" * 20])
    assert list(normalise.cuts([c], 2, 1000)) == [(0, 2), (2, 2), (4, 2)] and list(normalise.cuts([c, c], 10, 60)) == [(0, 2), (2, 1), (3, 2), (5, 1)] and list(normalise.cuts([c.slice(0, 0)], 5)) == []


def test_signatures_agree_as_often_as_they_should():
    r = random.Random(3)
    a = "".join(r.choice(string.ascii_lowercase) for _ in range(400))
    b = a[:300] + "".join(r.choice(string.ascii_lowercase) for _ in range(100))
    s = neardup.jaccard(a, b)
    _, words = neardup.signatures([a, b])
    agree = 320 - sum(bin(int(x) & (2**64 - 1)).count("1") for x in words[0] ^ words[1])
    assert abs(agree / 320 - (1 + s) / 2) < 0.08


# ---- problem 3


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/documents.parquet").where("lang in ('zh', 'en', 'es', 'ja') and length(text) > 80").select("text", "lang").collect()
    m = language.LanguageModel()
    said = [m.languages[k] for k in m.shares([normalise.canonical(d.text) for d in docs]).argmax(axis=1)]
    assert np.mean([a == d.lang for a, d in zip(said, docs, strict=True)]) > 0.97


def test_defects(spark):
    good = "先把基层清理干净，再刷界面剂。等三天以后用靠尺检查平整度，没有问题就可以贴砖。"
    q = "卫生间的瓷砖空鼓了，应该怎么处理比较好？"
    data = [(f"g{k}", q, good + f"第{k}户也是这样处理的。") for k in range(60)]
    data += [("e1", q, None), ("e2", q, "　"), ("e3", q, "暂无"), ("e4", None, "N/A"), ("c1", q, q), ("c2", q, "您问的是：" + q + "​"), ("r1", q, "很抱歉，这个问题我无法回答。"), ("r2", q, "Sorry, I cannot help with that."),
             ("l1", q, "You should ask the contractor to clean the wall first and then check it with a level before the tiles are laid again."), ("t1", q, good + "如果还有空"), ("ok", q, "抱歉让您久等，" + good), ("ok2", q, good + "包装上印着 keep the box dry at all times。"), ("c1", q, q), ("long", q, good * 2000), (None, q, None)]
    got = dict(rows(pairs.defective(entries(spark, data)), "id", "defect"))
    assert got == {"e1": "empty", "e2": "empty", "e3": "empty", "e4": "empty", "c1": "copy", "c2": "copy", "r1": "refusal", "r2": "refusal", "l1": "language", "t1": "truncated"}
    assert pairs.defective(entries(spark, data).where("false")).count() == 0


def test_every_phrase_of_refusal_holds_a_stem():
    said = "无法提供 不能回答 没办法帮 无从判断 难以处理 拒绝透露 恕不奉告 暂不支持 没有权限 超出我的范围 帮不上 处理不了 并不清楚 没找到 查不到相关 未检索到 选择不答 不作评价 换个说法 人工智能 系统繁忙 敬请谅解 请您先换个话题 重新提问 稍后再试".split()
    said += ["I CANNOT answer", "can not help", "couldn't find", "unable to assist", "Won't discuss", "must decline to answer", "choosing not to", "did not find", "No results", "no matching", "as an AI", "Beyond my", "outside the scope", "no permission", "not authorised", "failed to generate", "no puedo", "lo siento", "申し訳", "お答えできません"]
    for s in said:
        assert pairs._REFUSAL.search(s) and next(pairs._AUTOMATON.iter(s.lower()), None) is not None, s


def truncated_by_counts(answers, least=0.012):
    """The ids of ``answers`` (canonical, without another defect) that end where texts seldom do, from dictionaries of n-grams."""
    seen, ends, last = {}, {}, {}
    for i, a in answers.items():
        c = "".join(map(chr, pairs._points(*language.codes([a])).tolist()))
        last[i] = [c[-n:] if len(c) >= n else None for n in (1, 2, 3)]
        for n in (1, 2, 3):
            for k in range(len(c) - n + 1):
                seen[c[k : k + n]] = seen.get(c[k : k + n], 0) + 1
            if len(c) >= n:
                ends[c[-n:]] = ends.get(c[-n:], 0) + 1
    out = set()
    for i, a in answers.items():
        marked = a[-1] in pairs._END_MARK or ord(a[-1]) >= 0x1F300
        p = 0.05 if marked else pairs.PRIOR
        for g in last[i][: 1 if marked else 3]:
            e, inside = (ends[g] - 1, seen[g] - ends[g]) if g else (0, 0)
            p = (e + pairs.WEIGHT * p) / (e + inside + pairs.WEIGHT)
        if p < least:
            out.add(i)
    return out


def test_truncation_counts_exact_ngrams(spark):
    r = random.Random(9)
    han = [chr(0x4E00 + k) for k in range(900)]
    close = ["".join(r.choice(han) for _ in range(3)) for _ in range(150)]
    data = [(f"{k:04d}", "卫生间的瓷砖空鼓了，应该怎么处理比较好？", "".join(r.choice(han) for _ in range(r.randint(60, 120))) + (r.choice(close) if k % 4 else "")) for k in range(2500)]
    data += [("s1", "怎么办", "可"), ("s2", "怎么办", "可以")]
    df = entries(spark, data)
    got = dict(rows(pairs.defective(df), "id", "defect"))
    want = truncated_by_counts({i: normalise.canonical(a) for i, _, a in data if got.get(i) in (None, "truncated")})
    assert len(want) > 100 and len(data) - len(want) > 1000
    assert {i for i, d in got.items() if d == "truncated"} == want
    a = [(np.array(g), np.array(n), np.array(e)) for g, n, e in (([1, 3], [5, 6], [0, 1]), ([3, 4], [1, 1], [1, 0]))]
    assert [x.tolist() for x in pairs._merged(a)] == [[1, 3, 4], [5, 7, 1], [0, 2, 0]]


# ---- problem 5


@pytest.mark.parametrize("text, address", [("I live at 5 Maple Road", "5 Maple Road"), ("Flat 2, 1 Linden Street", "1 Linden Street")])
def test_addresses_with_single_digits_are_candidates(text, address):
    assert any(x.kind == "address" and address in text[x.start : x.end] for x in pii.candidates(text))


# Texts that the templates of the training don't make.
HELD_OUT = [
    ("业主诸葛亮反映漏水", "业主[NAME]反映漏水"),
    ("业主慕容建国", "业主[NAME]"),
    ("业主：上官婉清，厨房返水", "业主：[NAME]，厨房返水"),
    ("联系人蔺志强，电话13912345678", "联系人[NAME]，电话[PHONE]"),
    ("姓名：桓子轩 身份证110105194912310021", "姓名：[NAME] 身份证[ID_NUMBER]"),
    ("收货人 展云飞 13700001111", "收货人 [NAME] [PHONE]"),
    ("身份证11010519491231002113800138000", "身份证[ID_NUMBER][PHONE]"),
    ("电话138 0013 8000 139 0013 9000", "电话[PHONE] [PHONE]"),
    ("电话13800138000 13900139000都行", "电话[PHONE] [PHONE]都行"),
    ("打1380013800013900139000", "打[PHONE][PHONE]"),
    ("My name is john smith, the tap drips", "My name is [NAME], the tap drips"),
    ("Name: MARY JONES", "Name: [NAME]"),
    ("I am happy to wait", "I am happy to wait"),
    ("业主反映客厅的插座没电", "业主反映客厅的插座没电"),
    ("业主同意延期，下周再来", "业主同意延期，下周再来"),
    ("快递单号7733445566778899001122查不到", "快递单号7733445566778899001122查不到"),
    ("合同编号202605120034，尾款没付", "合同编号202605120034，尾款没付"),
    ("PVC PIPE 20mm多少钱", "PVC PIPE 20mm多少钱"),
    ("麻烦发到 zhang.wei@example.com 谢谢", "麻烦发到 [EMAIL] 谢谢"),
    ("我住在人民路128号3单元502室，窗户漏风", "我住在[ADDRESS]，窗户漏风"),
    ("I live at 22 Baker Street, near the park", "I live at [ADDRESS], near the park"),
    ("找欧阳娜签字，别找端木", "找[NAME]签字，别找端木"),
    ("南宫雪家的门关不上", "[NAME]家的门关不上"),
    ("手机一三八零零一三八零零零打不通", "手机[PHONE]打不通"),
    ("Ship it to 5 Maple Road, thanks", "Ship it to [ADDRESS], thanks"),
    ("业主觉得瓷砖颜色不对", "业主觉得瓷砖颜色不对"),
]


@pytest.mark.parametrize("text, redacted", HELD_OUT)
def test_held_out_texts_are_redacted(text, redacted):
    assert pii.redact(text, pii.find([text], pii.models())[0]) == redacted


def test_boosting_learns_a_rule():
    r = np.random.default_rng(1)
    x = r.integers(0, 10, (2000, 4))
    y = ((x[:, 0] > 4) & (x[:, 2] < 6)).astype(float)
    m = boosting.Boosted(x[:1000], y[:1000])
    assert ((m.probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.97


def test_personal_information(spark):
    data = [
        ("1", "业主王建国，身份证11010519491231002X，电话138-0013-8000", None), ("2", "寄到沈阳市和平区文化路３８号2栋1单元301室，邮件li.wen@sample.test", ""), ("3", "订单号881234567890123456到哪了", "李工说不行"), ("4", None, "x" * 20_000),
        ("1", "业主王建国，身份证11010519491231002X，电话138-0013-8000", None), (None, "电话13800138000", None), ("5", "", "请回电一三八零零一三八零零零"),
    ]
    df = spark.createDataFrame([(*d, "clash") for d in data], "log_id string, user_query string, response_snippet string, kind string")
    got = set(rows(pii.kinds_found(df)))
    assert got == {("1", "user_query", "name"), ("1", "user_query", "id_number"), ("1", "user_query", "phone"), ("2", "user_query", "address"), ("2", "user_query", "email"), ("5", "response_snippet", "phone")}
    r = {x.log_id: x for x in pii.redacted(df).collect()}
    assert r["1"].user_query == "业主[NAME]，身份证[ID_NUMBER]，电话[PHONE]" and r["3"].user_query == data[2][1] and r["4"].user_query is None and r["4"].response_snippet == data[3][2]
    assert pii.redacted(df).count() == len(data) and pii.kinds_found(df.where("false")).count() == 0


def test_candidate_models_held_out():
    fitted = pii.models()
    for kind, (x, y) in pii._labelled(3000, 4321).items():
        model, threshold = fitted[kind]
        p = model.probability(x) >= threshold
        assert (p & (y > 0)).sum() / max(1, p.sum()) > 0.93 and (p & (y > 0)).sum() / max(1, y.sum()) > 0.93, kind


# ---- problem 7


def test_ids_equal_the_library(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = random.Random(2)
    odd = ["", " ", "\n\n\n  x", "<|endoftext|>", "a" * 3000, "中" * 2000, "​́e", "it's we'll", "１２３ 456", "🙂🙏"]
    odd += ["".join(chr(r.choice([r.randrange(1, 0x300), r.randrange(0x4E00, 0x9FFF), 32, 10])) for _ in range(r.randint(1, 60))) for _ in range(500)]
    data = [(k, x, "clash") for k, x in enumerate(odd)] + [(9001, None, None), (9001, None, None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    got = {x.doc_id: list(x.ids) for x in tokenise.token_ids(df).collect()}
    assert got == {k: (t.encode(x, add_special_tokens=False).ids if x else []) for k, x, _ in data}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {x.doc_id: x.text for x in docs.collect()}
    for x in tokenise.token_ids(docs).collect():
        assert t.decode(x.ids, skip_special_tokens=False) == (text[x.doc_id] or "")
    assert tokenise.token_ids(df.where("false")).count() == 0


# ---- problem 8


def test_min_cost_flow_prefers_fresh_texts():
    total, taken = mixing.plan({("1", "a"): 100, ("2", "b"): 50, ("3", "a"): 40, ("3", "b"): 40}, {"1": 100, "2": 50, "3": 40}, {"a": mixing.Quota(0.5, 1), "b": mixing.Quota(0.5, 3)}, 200)
    assert total == 200 and sum(v for (_, s), v in taken.items() if s == "a") == 100 == sum(v for (_, s), v in taken.items() if s == "b")
    assert taken["3", "b"] == 40 or taken["2", "b"] > 50


def test_flow_costs_least():
    """Against the cheapest of all integer flows of a small graph."""
    import itertools

    r = random.Random(5)
    for _ in range(60):
        edges = [(0, 2, r.randint(0, 3), 0), (0, 2, r.randint(0, 2), 1), (0, 3, r.randint(0, 3), r.randint(0, 4)), (2, 4, r.randint(0, 3), 0), (2, 5, r.randint(0, 3), 0), (3, 4, r.randint(0, 2), 0), (3, 5, r.randint(0, 3), 0), (4, 1, r.randint(0, 4), 0), (5, 1, r.randint(0, 3), 0)]
        best = (0, 0)
        for f in itertools.product(*(range(c + 1) for _, _, c, _ in edges)):
            if all(sum(x for x, e in zip(f, edges, strict=True) if e[1] == v) == sum(x for x, e in zip(f, edges, strict=True) if e[0] == v) for v in (2, 3, 4, 5)):
                best = min(best, (-f[7] - f[8], sum(x * e[3] for x, e in zip(f, edges, strict=True))))
        flow = mixing.min_cost_flow(edges, 0, 1)
        assert (-flow[7] - flow[8], sum(x * e[3] for x, e in zip(flow, edges, strict=True))) == best


def test_plan_at_its_bound():
    import time

    r = random.Random(6)
    names = [f"s{k:02d}" for k in range(62)]
    quotas = {s: mixing.Quota(1 / 62, r.randint(1, 5)) for s in names}
    capacity, supply = {}, {}
    for p in range(4096):
        inside = r.sample(names, r.randint(1, 8))
        for s in inside:
            capacity[str(p), s] = r.randint(100, 10_000)
        supply[str(p)] = max(capacity[str(p), s] for s in inside)
    began = time.process_time()
    total, taken = mixing.plan(capacity, supply, quotas, None)
    assert time.process_time() - began < 60
    got = dict.fromkeys(names, 0)
    for (p, s), t in taken.items():
        got[s] += t
        assert 0 <= t <= capacity[p, s] * quotas[s].repeats
    assert all(abs(t - total / 62) <= 1 for t in got.values())


def test_copies_of_one_text_are_cut_between_records(spark):
    docs = spark.createDataFrame([(k, "tile wall floor" if k % 3 else f"pipe {k} grout", "ab"[k % 2]) for k in range(3000)], "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("a", 0.75, 1), ("b", 0.25, 1)], "source string, target_share double, max_repeats int")
    m, shares = mixing.mix(docs, weights)
    assert {x.source: round(x.actual_share, 2) for x in shares.collect()} == {"a": 0.75, "b": 0.25}
    assert m.count() == m.select("doc_id").distinct().count()

def test_mixture(spark):
    r = random.Random(1)
    data = [(k, " ".join(r.choice("tile wall floor pipe grout paint".split()) for _ in range(r.randint(5, 60))), r.choice(["a"] * 8 + ["b"] * 2 + ["x"])) for k in range(600)]
    data += [(900 + k, data[k][1], "b") for k in range(20)] + [(1000, None, "a"), (1001, "", "b"), (1002, "text", None)]
    docs = spark.createDataFrame([(*d, "clash") for d in data], "doc_id bigint, text string, source string, tokens string")
    weights = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixture, shares = mixing.mix(docs, weights)
    s = {x.source: x for x in shares.collect()}
    assert abs(s["a"].actual_share - 0.5 / 0.9) < 0.01 and abs(s["b"].actual_share - 0.4 / 0.9) < 0.01 and s["none"].actual_share == 0
    m = mixture.collect()
    assert len({x.doc_id for x in m}) == len(m) and all(1 <= x.uses <= {"a": 1, "b": 3}[x.source] for x in m)
    again, _ = mixing.mix(docs, weights)
    assert rows(again) == rows(mixture)
    more, short = mixing.mix(docs, weights, total=10**7)
    assert {x.source: x.uses for x in more.collect()} == {"a": 1, "b": 3}
    for d, w in ((docs.where("false"), weights), (docs, weights.where("false"))):
        assert mixing.mix(d, w)[0].count() == 0


# ---- problem 9


def _labelled_texts(n, seed):
    r = random.Random(seed)
    plain = ["瓷砖要先泡水再贴", "The primer cost 90 yuan", "木地板下面铺防潮膜", "胶把缝粘得死死的拆不动", "老年人的卫生间要装扶手", "女儿墙要做防水", "A naked brick wall needs sealing", "插座回路配三路"]
    bad = ["你这个傻逼滚远点", "什么废物也敢出来接活", "南方人都是蛀虫天生低等", "drop dead you scumbag", "加我看全裸直播", "我弄死你全家"]
    texts, labels = [], []
    for _ in range(n):
        s = [r.choice(plain) + str(r.randrange(99)) for _ in range(5)]
        b = r.random() < 0.3
        if b:
            s.insert(r.randrange(6), r.choice(bad))
        texts.append("。".join(s))
        labels.append(b)
    return texts, labels


def test_classifier_held_out_and_fair():
    m = toxicity.fit(*_labelled_texts(300, 1))
    texts, labels = _labelled_texts(200, 2)
    assert np.mean((m.scores(texts) >= m.threshold) == np.array(labels)) > 0.97
    groups = m.scores([f"{g}的卫生间要装扶手。" for g in toxicity.GROUPS_ZH])
    assert (groups < m.threshold).all() and groups.max() - groups.min() < 0.25
    s = m.scores([None, "", "你这个傻​逼滚远点", "你 这 个 傻 逼 滚远点", "瓷砖" * 20_000])
    assert s[0] == s[1] == 0 and (s[2:4] >= m.threshold).all() and s[4] < m.threshold


def test_mentions_to_swap_are_chosen_by_chance(monkeypatch):
    said = []

    def note(sents, y, weight, pairs, **k):
        said.append([a for a, _ in pairs])
        return np.zeros(toxicity.DIM, np.float32), 0.0

    monkeypatch.setattr(toxicity, "_fit_logistic", note)
    texts = [f"{c}区的女司机也来看了{'木地板' * (80 if c == 'z' else 1)}" for c in string.ascii_lowercase for _ in range(2)]
    toxicity.fit(texts, [False] * len(texts), most_mentions=1000)
    assert {s[0] for s in said[-1]} >= set(string.ascii_lowercase)  # the long one too
    toxicity.fit(texts, [False] * len(texts), most_mentions=12)
    assert len(set(said[-1])) == 12 and max(s[0] for s in said[-1] if s[0].isascii()) > "m"


def test_score_tables(spark):
    texts, labels = _labelled_texts(150, 3)
    docs = spark.createDataFrame([(k, t, "s", "clash") for k, t in enumerate(texts)] + [(900, None, None, ""), (901, "", "s", "")], "doc_id bigint, text string, source string, label string")
    marks = spark.createDataFrame([(k, "abusive" if b else "clean", "r", datetime.datetime(2026, 1, 1)) for k, b in enumerate(labels)] + [(None, "clean", "r", None), (5, None, "r", None)], "doc_id bigint, label string, reviewer string, labelled_at timestamp")
    s = toxicity.score(docs, marks)
    got = {x.doc_id: x.flagged for x in s.collect()}
    assert got[900] is False and got[901] is False and np.mean([got[k] == b for k, b in enumerate(labels)]) > 0.97
    assert {x.source: x.n_documents for x in toxicity.rates(s).collect()} == {"s": 151, None: 1}
    assert toxicity.score(docs.where("false"), marks).count() == 0
    assert toxicity.score(docs, marks.where("false")).count() == docs.count()


def test_registered(spark):
    from plumbline.llm.queries import queries

    assert {f"p{n}_found" for n in (1, 2, 3, 5, 9)} | {"p7_ids", "p8_mix", "p8_shares"} <= set(queries())
