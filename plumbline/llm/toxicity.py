"""Problem 9: abusive, hateful and sexual content.

A logistic classifier of sentences over hashed character n-grams; a document's score is that of its worst sentence. It is
fitted on labelled documents (a bounded sample, see ``most_labelled``) by multiple-instance learning: which sentences of a
document labelled bad are bad is worked out in rounds, so that neither its neutral sentences nor single wrong labels are
learnt. A short list of labelled sentences is added, so that few labels suffice for a start.

Counterfactual regularisation: in the training sentences that mention a group, the term is swapped for others, and half the
squared difference of scores is added to the loss, so that the mention of a group by itself doesn't move the score.

Before that, spelling is evened out: canonical form (see normalise), traditional characters that occur in the listed
sentences, no blanks or marks between East Asian characters or single spelt-out letters, common digits for letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.normalise import canonical, cuts
from plumbline.session import drop, materialise

DIM = 1 << 18
ORDERS = (1, 2, 3, 4)

# Groups that texts mention; in training they are swapped for each other.
GROUPS_ZH = "南方人 北方人 外地人 本地人 乡下人 农村人 农民工 女司机 女人 男人 残疾人 老年人 老人 黑皮肤的 黑人 白人 同性恋 穆斯林 信教的 少数民族 河南人 东北人 上海人 外国人 移民 聋哑人 盲人 胖子".split()
GROUPS_EN = ["migrants", "immigrants", "foreigners", "women", "women fitters", "men", "village people", "old folks", "old people", "disabled people", "black people", "white people", "gay people", "muslims", "jews", "christians", "people of that faith", "northerners", "southerners", "rural workers"]
# Sentences by which training starts. They are quoted to be recognised.
SEED_BAD = """你这个傻逼
脑残东西给我滚
去死吧人渣
你全家都是畜生
不得好死的王八蛋
我弄死你
砍你全家
打断你的腿
见一次打一次
什么废物也敢出来接活
臭不要脸的贱人
他妈的混蛋
南方人都是骗子天生低等
外地人骨子里就坏都该被赶出去
女人就是蠢没脑子
农民工脏得像牲口
残疾人都是社会的垃圾
约炮找我随叫随到
全裸直播加我看
裸聊做爱视频
床上服务包你爽
色情激情视频
you stupid bastard
you worthless fucking moron
what a piece of shit
go to hell you idiot
i will break your legs
i hope you die
drop dead you scumbag
shut your filthy mouth
immigrants are vermin throw them out
women are too stupid to do this work
those people are subhuman animals
hot naked pics and sex tonight
message me for a blowjob
horny singles want rough sex""".split("\n")
SEED_CLEAN = """老年人的卫生间要装扶手
残疾人坡道的坡度要合适
农民工工资应按时支付
女司机停车的车位要宽一些
南方人家里更要注意防潮
北方人习惯装暖气
外地人来装修要办临时证件
女儿墙要做防水
公母榫头要对齐
死角要清理干净
胶粘得死死的拆不下来
膨胀螺丝打断了要换
裸露的电线要包好
床上用品最后进场
上下床的护栏要装稳
混凝土骨料要分级
处女座的业主很细心
migrants and local workers share the site canteen
women and men need separate changing rooms
old folks need a handrail in the bath
a naked brick wall needs sealing
use a stud finder before drilling
the male and female connectors fit
kill the power before you start
strip the bare wire carefully
the caulk gun is next to the cock valve
screw the panel tight""".split("\n")
# Traditional characters and their simplified forms, where abuse uses them; digits and signs for letters.
_TRADITIONAL = str.maketrans("廢貨賤豬腦殘媽滾殺幹雞婊騙體裸愛視頻騷約聊淫亂蕩壞髒蠢東廣農殘黃個這種們來從給說話錢門開關還過進為與無對", "废货贱猪脑残妈滚杀干鸡婊骗体裸爱视频骚约聊淫乱荡坏脏蠢东广农残黄个这种们来从给说话钱门开关还过进为与无对")
_HAS_TRADITIONAL = re.compile(f"[{''.join(map(chr, _TRADITIONAL))}]")
_LEET = str.maketrans("013457@$", "oleastas")

_SENTENCE_END = re.compile(r"[。!?;\n；！？]+|\.(?=\s|$)")
_NOT_WORD = re.compile(r"[^\w\n]*(?:_+[^\w\n]*)+|[^\w\n]+")
_BY_HAN = re.compile(r"(?<=[぀-ヿ㐀-鿿]) | (?=[぀-ヿ㐀-鿿])")
_SPELT = re.compile(r"\b[a-z](?: [a-z]){2,}\b")
_MIXED = re.compile(r"[a-z@$]+[0134578@$][a-z@$0-9]*")
_MASKED = re.compile(r"(?<=[a-z])[*#](?=[a-z])")


def sentences(text: str | None) -> list[str]:
    """The evened-out sentences of a text."""
    if not text:
        return []
    t = canonical(text).lower()
    if _HAS_TRADITIONAL.search(t):
        t = t.translate(_TRADITIONAL)
    t = _SENTENCE_END.sub("\n", t)
    if "*" in t or "#" in t:
        t = _MASKED.sub("", t)
    t = _MIXED.sub(lambda m: m.group().translate(_LEET), t)
    t = _BY_HAN.sub("", _NOT_WORD.sub(" ", t))
    t = _SPELT.sub(lambda m: m.group().replace(" ", ""), t)
    return [s for s in map(str.strip, t.split("\n")) if s]


def _features(sents: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the sentences (each with a blank at both ends), sentence by sentence, and the number of n-grams of each."""
    texts = [f" {s} " for s in sents]
    length = np.array([len(t) for t in texts], np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.cumsum(length) - length
    each = [np.maximum(length - k + 1, 0) for k in ORDERS]
    n = np.sum(each, axis=0)
    out = np.empty(n.sum(), np.intp)
    place = np.cumsum(n) - n  # where the next order's n-grams of each sentence go
    for k, count in zip(ORDERS, each, strict=True):
        before = np.cumsum(count) - count
        at = np.arange(count.sum())
        source = at + np.repeat(begin - before, count)
        h = np.full(len(at), 1469598103934665603 + k, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                h = (h ^ c[source + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        out[at + np.repeat(place - before, count)] = (h >> np.uint64(20)) & np.uint64(DIM - 1)
        place = place + count
    return out, n


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    threshold: float

    def logits(self, sents: list[str]) -> np.ndarray:
        if not sents:
            return np.zeros(0)
        f, n = _features(sents)
        return np.add.reduceat(self.weights[f].astype(np.float64), np.r_[0, np.cumsum(n)[:-1]]) + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of the worst sentence; 0 for a text without any."""
        each = [sentences(t) for t in texts]
        out = np.full(len(texts), -np.inf)
        index = {s: k for k, s in enumerate(dict.fromkeys(s for ss in each for s in ss))}  # equal sentences are weighed once
        z = self.logits(list(index))
        np.maximum.at(out, np.repeat(np.arange(len(texts)), [len(s) for s in each]), z[[index[s] for ss in each for s in ss]] if index else z)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30))) * np.isfinite(out)


_GROUP = re.compile("|".join(map(re.escape, sorted(GROUPS_ZH + GROUPS_EN, key=len, reverse=True))))


def swaps(sentence: str, rng: np.random.Generator, copies: int = 2) -> list[str]:
    """The sentence with the groups that it mentions swapped for others of the same language."""
    out = []
    for groups in (GROUPS_ZH, GROUPS_EN):
        here = next((g for g in sorted(groups, key=len, reverse=True) if g in sentence), None)
        if here:
            others = [g for g in groups if g != here]
            out += [sentence.replace(here, others[k]) for k in rng.choice(len(others), copies, replace=False)]
    return out


def _fit_logistic(sents: list[str], y: np.ndarray, weight: np.ndarray, pairs: list[tuple[str, str]], epochs: int = 40, l2: float = 1e-5, fairness: float = 0.5) -> tuple[np.ndarray, float]:
    """Adam on the weighted log loss plus ``fairness`` times the squared difference of the scores of each swapped pair."""
    f, n = _features(sents)
    starts = np.r_[0, np.cumsum(n)[:-1]]
    w, b = np.zeros(DIM), -3.0
    m, v, mb, vb = np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
    total = weight.sum()
    if pairs:
        fp, np_ = _features([a for a, _ in pairs])
        fq, nq = _features([c for _, c in pairs])
        sp, sq = np.r_[0, np.cumsum(np_)[:-1]], np.r_[0, np.cumsum(nq)[:-1]]
    for step in range(1, epochs + 1):
        light = w.astype(np.float32)  # half the memory to gather from
        z = np.add.reduceat(light[f], starts) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        grad = np.bincount(f, np.repeat(g, n), minlength=DIM) + l2 * w
        if pairs:
            d = fairness * (np.add.reduceat(light[fp], sp) - np.add.reduceat(light[fq], sq)) / len(pairs)
            grad += np.bincount(fp, np.repeat(d, np_), minlength=DIM) - np.bincount(fq, np.repeat(d, nq), minlength=DIM)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        rate = 0.1 * (1 - step / (epochs + 20))
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        gb = g.sum()
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return w.astype(np.float32), float(b)


def _first_guess(docs: list[list[str]], bad: np.ndarray) -> np.ndarray:
    """For each sentence, the share of its n-grams that occur in two bad documents or more and hardly in clean ones."""
    flat = [s for d in docs for s in d]
    f, n = _features(flat)
    owner = np.repeat(np.repeat(np.arange(len(docs)), [len(d) for d in docs]), n)
    seen = np.sort(owner.astype(np.int64) * DIM + f)
    seen = seen[np.r_[True, seen[1:] != seen[:-1]]]
    doc, bucket = seen // DIM, seen % DIM
    in_bad = np.bincount(bucket, bad[doc].astype(float), minlength=DIM)
    in_clean = np.bincount(bucket, (~bad[doc]).astype(float), minlength=DIM)
    telling = (in_bad >= 2) & (in_bad > 8 * in_clean * max(1, bad.sum()) / max(1, (~bad).sum()))
    return np.add.reduceat(telling[f].astype(float), np.r_[0, np.cumsum(n)[:-1]]) / n


def fit(texts: list[str], bad: list[bool], seed: int = 9, rounds: int = 2, most_negative: int = 40_000, most_mentions: int = 4_000) -> Model:
    """Fits the classifier on labelled documents; ``most_negative`` sentences of clean ones at most, the hardest and others by chance; ``most_mentions`` sentences of all that mention a group, by chance, are swapped. The threshold has the best F1 on a quarter of the documents that a first fit leaves out."""
    rng = np.random.default_rng(seed)
    votes: dict[tuple[str, ...], int] = {}
    for t, b in zip(texts, bad, strict=True):  # copies of a text are one document
        d = tuple(sentences(t))
        votes[d] = votes.get(d, 0) + (1 if b else -1)
    kept = sorted((d, v > 0) for d, v in votes.items() if d and v)
    docs, y = [list(d) for d, _ in kept], np.array([b for _, b in kept], bool)

    def train(rows: np.ndarray) -> tuple[np.ndarray, float]:
        some, mark = [docs[k] for k in rows], y[rows]
        start_bad, start_clean = [x for s in SEED_BAD for x in sentences(s)], [x for s in SEED_CLEAN for x in sentences(s)]
        flat = [s for d in some for s in d]
        own = np.repeat(np.arange(len(some)), [len(d) for d in some])
        guess = _first_guess(some, mark) if flat else np.zeros(0)
        p = np.clip(guess * 1.6, 0, 1)
        model = None
        for r in range(rounds + 1):
            pos, neg = [], []
            if flat:
                best = np.zeros(len(some))
                np.maximum.at(best, own, p)
                is_pos = mark[own] & ((p > 0.5) | ((p == best[own]) & (p > 0.4)))
                in_clean = Counter(flat[k] for k in np.flatnonzero(~mark[own]))
                in_bad = Counter(flat[k] for k in np.flatnonzero(is_pos))
                pos = sorted(s for s, n in in_bad.items() if n >= 4 * in_clean[s])
                neg = sorted(set(in_clean) - set(pos))
                if len(neg) > most_negative:  # those that look bad, and others by chance
                    worst = {}
                    for k in np.flatnonzero(~mark[own] & (p > 0.01)):
                        worst[flat[k]] = max(worst.get(flat[k], 0), p[k])
                    hard = sorted(sorted(set(neg) & set(worst), key=lambda x: (-worst[x], x))[: most_negative // 2])
                    rest = sorted(set(neg) - set(hard))
                    neg = hard + [rest[k] for k in np.sort(rng.choice(len(rest), most_negative - len(hard), replace=False))]
            train_s = pos + start_bad + neg + start_clean
            target = np.r_[np.ones(len(pos) + len(start_bad)), np.zeros(len(neg) + len(start_clean))]
            heavy = max(1.0, 0.15 * (target == 0).sum() / max(1, (target == 1).sum()))
            weight = np.where(target == 1, heavy, 1.0)
            weight[len(train_s) - len(start_clean) :] = 3.0
            mention = [s for s in train_s if _GROUP.search(s)]
            if len(mention) > most_mentions:
                mention = [mention[k] for k in np.sort(rng.choice(len(mention), most_mentions, replace=False))]
            pairs = [(s, x) for s in mention for x in swaps(s, rng)]
            w, b = _fit_logistic(train_s, target, weight, pairs)
            model = Model(w, b, 0.5)
            if flat and r < rounds:
                p = 1 / (1 + np.exp(-np.clip(model.logits(flat), -30, 30)))
        return model.weights, model.bias

    everything = np.arange(len(docs))
    held = rng.random(len(docs)) < 0.25
    threshold = 0.5
    if held.sum() >= 40 and y[held].sum() >= 8:
        w, b = train(everything[~held])
        m = Model(w, b, 0.5)
        z = np.array([m.logits(docs[k]).max() for k in everything[held]])
        s, t = 1 / (1 + np.exp(-np.clip(z, -30, 30))), y[held]
        grid = np.arange(0.2, 0.91, 0.05)
        f1 = np.array([2 * (t & (s >= g)).sum() / max(1, t.sum() + (s >= g).sum()) for g in grid])
        best = grid[f1 >= f1.max() - 1e-9]
        threshold = float(best[np.abs(best - 0.5).argmin()])
    w, b = train(everything)
    return Model(w, b, threshold)


def labelled(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> DataFrame:
    """``doc_id, text, bad``: whether most of its labels aren't ``clean`` (ties are left out), of ``most_labelled`` labelled documents at most, chosen by hash."""
    votes = labels.where("doc_id is not null and label is not null").select("doc_id", "label", "reviewer", "labelled_at").distinct()
    votes = votes.groupBy("doc_id").agg(F.sum(F.when(F.col("label") == "clean", -1).otherwise(1)).alias("vote")).where("vote <> 0")
    some = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first(F.col("vote") > 0).alias("bad"))


_fitted: dict[tuple, Model] = {}


def fitted(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> Model:
    """The classifier of a set of labelled documents. It is fitted in one task, so that no text comes to the driver, and kept by the documents' checksum for the queries that follow."""
    some = materialise(labelled(docs, labels, most_labelled), "labelled")
    key = tuple(some.agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "text", "bad").cast("decimal(38,0)"))).first())
    if key in _fitted:
        return _fitted[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["text"], r["bad"]) for b in batches for r in b.to_pylist())
        m = fit([t for _, t, _ in rows], [b for _, _, b in rows])
        yield pa.RecordBatch.from_pydict({"weights": [m.weights.tobytes()], "bias": [m.bias], "threshold": [m.threshold]})

    row = some.repartition(1).mapInArrow(run, "weights binary, bias double, threshold double").first() if key[0] else None
    drop(some)
    if len(_fitted) >= 4:
        _fitted.clear()
    _fitted[key] = Model(np.frombuffer(row.weights, np.float32), row.bias, row.threshold) if row else fit([], [])
    return _fitted[key]


def score(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> DataFrame:
    """``doc_id, source, score, flagged`` of each document. Null and empty texts score 0; repeated rows count once; without labels, only the listed sentences are learnt."""
    model = fitted(docs, labels, most_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in cuts([b.column(2)], 2000):
                part = b.slice(at, n)
                s = model.scores(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array(s >= model.threshold)], names=["doc_id", "source", "score", "flagged"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {kind}, source string, score double, flagged boolean").distinct()


def rates(scored: DataFrame) -> DataFrame:
    """``source, n_documents, n_flagged, rate, mean_score`` by source; documents without source form one of their own (null)."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if("flagged").alias("n_flagged"), F.round(F.avg(F.col("flagged").cast("double")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score")
    )
