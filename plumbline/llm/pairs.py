"""Problem 3: question and answer pairs of which the answer doesn't serve.

An entry has one defect at most; the first that holds, in this order:

* ``empty``: null, blank, no letter or digit, or one of a list of fillers;
* ``copy``: the answer's letters and digits are the question's, apart from a short lead-in or ending;
* ``refusal``: phrases of inability make up most of the answer, so that no advice is left;
* ``language``: by naive Bayes over character n-grams, nearly no piece of the answer is in the question's language;
* ``truncated``: by the likelihood that a text ends after the answer's last one to three characters. Inside and end counts of
  n-grams, by their exact code points, are taken over all answers, backed off from three to one, each answer's own end left out. After a mark
  that ends sentences, that mark alone counts. Decimal points and the points of numbered lists are characters of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.language import LanguageModel, codes
from plumbline.llm.normalise import canonical, cuts, letters_and_digits
from plumbline.session import materialise

# What stands for no answer, as letters and digits in lower case.
FILLERS = frozenset("略 无 空 暂无 没有 未填写 未填 待补充 待补 待定 待完善 不详 暂缺 同上 答 回答 如题 nan na none null nil tbd todo tba empty blank unknown x xx xxx test 测试 无答案 暂无答案 暂无回答 无内容 answer a".split())
# Phrases of inability or refusal.
REFUSALS = (
    "无法(?:给出|提供|处理|回答|解答|判断|回复|答复|帮|协助|作答|确认|为您|满足|完成|生成)|(?:不能|没法|没办法|无从|未能|难以|不便|不予|不宜|拒绝)(?:给|提供|处理|回答|解答|判断|回复|答复|帮|协助|作答|透露|生成|评论|为您|置评)"
    "|恕(?:不|难)|(?:暂|尚)?不支持|没有?权限|无权|超出了?(?:我|本|系统)?的?(?:能力|范围|权限|职责)|(?:帮不了|帮不上|答不了|回答不了|处理不了)|并?不(?:掌握|清楚|了解|知道|方便)|没有?(?:找到|查到|检索到|搜到)|(?:找|查|搜)不到(?:与|相关|结果)|未(?:找到|查到|检索到)|选择不|不作(?:说明|评价|评论|答)|换个(?:关键词|问法|说法)|(?:语言模型|智能助手|人工智能|机器人)|系统(?:繁忙|错误|异常|维护)|敬请谅解|请.{0,6}换个话题|重新提问|稍后再试|再试一次"
)
REFUSALS_LATIN = r"(?:can ?not|can't|could not|couldn't|unable to|not able to|not allowed to|won't|will not|must decline(?: to)?|have to decline(?: to)?) (?:help|answer|assist|give|provide|advise|comment|respond|say|discuss|share|process)|(?:prefer|choose|chose|choosing) not to|(?:could not|couldn't|did not|didn't) find|no (?:results?|matching|related)|as an ai|language model|beyond my|outside (?:my|the) (?:scope|ability)|no permission|not authori[sz]ed|failed to generate|no puedo|lo siento|申し訳|お答えでき"
_REFUSAL = re.compile(f"{REFUSALS}|{REFUSALS_LATIN}", re.I)
# Pieces of which every phrase above holds one, in lower case; texts without any need no search for the phrases.
_STEMS = "无法 不能 没法 没办法 无从 未能 难以 不便 不予 不宜 拒绝 恕 不支持 权限 无权 超出 帮不 答不 处理不 不掌握 不清楚 不了解 不知道 不方便 找到 查到 检索到 搜到 不到 选择不 不作 换个 语言模型 智能助手 人工智能 机器人 系统 敬请谅解 重新提问 稍后再试 再试一次 申し訳 お答え".split()
_STEMS_LATIN = ("cannot", "can not", "can't", "could not", "couldn't", "unable to", "not able to", "not allowed to", "won't", "will not", "decline", "not to", "did not find", "didn't find", "no result", "no matching", "no related", "as an ai", "language model", "beyond my", "outside my", "outside the", "permission", "not authori", "failed to generate", "no puedo", "lo siento")
_AUTOMATON = ahocorasick.Automaton()
for _stem in (*_STEMS, *_STEMS_LATIN):
    _AUTOMATON.add_word(_stem, None)
_AUTOMATON.make_automaton()
_SENTENCE = re.compile(r"[^。!?\n;~]+?(?:\.(?=\s|$)|[。!?\n;~]|$)")
# Greetings and closing phrases, which are no advice.
_POLITE = re.compile(r"^(?:您好|你好|收到|感谢(?:提问|咨询|您的提问)?|谢谢(?:提问|您)?|答|好的|亲|hello|hi|thanks?(?: you)?(?: for asking)?|祝(?:您|你)?(?:装修)?顺利|回复完毕|仅供参考|以上(?:仅供参考|供您参考)?|有变化随时再问|数据会浮动|等等|具体以现场为准|给您添麻烦了)$", re.I)
_END_MARK = frozenset(".。!?…~)」』”\"】]")

#: Different n-grams that a task holds before it passes their counts on.
HELD = 1 << 21
#: Rows whose arrays are made at once, so that they stay in the processor's caches.
AT_ONCE = 2000
#: Likelihood of an end anywhere, and the weight of a shorter n-gram against a longer one's counts.
PRIOR, WEIGHT = 0.004, 5.0


def is_empty(answer: str | None) -> bool:
    return _nothing(letters_and_digits(canonical(answer or "")))


def _nothing(a: str) -> bool:
    return not a or a in FILLERS


def is_copy(question: str, answer: str, most: int = 14) -> bool:
    """Both canonical. ``most``: letters and digits that the answer may have besides the question."""
    return _copies(letters_and_digits(question), letters_and_digits(answer), most)


def _copies(q: str, a: str, most: int = 14) -> bool:
    if len(q) < 6:
        return bool(q) and q == a
    return q in a and len(a.replace(q, "")) <= most or a in q and len(a) >= 0.75 * len(q)


def is_refusal(answer: str) -> bool:
    """Of the canonical answer's sentences, greetings left out, those with a phrase of inability hold seven tenths of the letters, counted with the questions of whom to ask instead."""
    if next(_AUTOMATON.iter(answer.lower()), None) is None:
        return False
    no = rest = 0
    for m in _SENTENCE.finditer(answer):
        s = m.group()
        n = len(letters_and_digits(s))
        if not n or _POLITE.match(s.strip(" ,.。!?~;")):
            continue
        if _REFUSAL.search(s):
            no += n
        else:
            rest += n
    return no > 0 and no >= 0.7 * (no + rest)


def _exact(c: np.ndarray, n: int) -> np.ndarray:
    """Each n-gram as a number of its own, of up to three code points of 21 bits."""
    h = np.zeros(max(0, len(c) - n + 1), np.int64)
    for k in range(n):
        h = h << 21 | c[k : len(c) - n + 1 + k].astype(np.int64) + 1
    return h


def _merged(counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by n-gram of several ``gram, inside, ends``."""
    gram, inside, ends = (np.concatenate(x) for x in zip(*counts, strict=True))
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    return gram[first], np.add.reduceat(inside[order], first), np.add.reduceat(ends[order], first)


def _points(c: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The codes with points in numbers and after the numbers of a list replaced, so that they aren't taken for full stops."""
    x = np.concatenate([np.zeros(3, np.uint32), c, np.zeros(1, np.uint32)])
    d = np.concatenate([np.full(3, -1), doc, np.full(1, -1)])
    digit = (x >= 48) & (x <= 57)
    blank = (x == 32) | (x == 10)
    same = [d[3 - k : 3 - k + len(c)] == doc for k in range(4)]
    prev = [(digit[3 - k : 3 - k + len(c)] & same[k], blank[3 - k : 3 - k + len(c)] | ~same[k]) for k in range(4)]
    after = digit[4 : 4 + len(c)] & (d[4 : 4 + len(c)] == doc)
    listed = prev[1][0] & (prev[2][1] | prev[2][0] & prev[3][1])
    return np.where((c == 46) & (prev[1][0] & after | listed), np.uint32(0xE000), c)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with ``id, defect, grams, marked`` for each entry; besides, rows with ``gram, inside, ends`` for each n-gram that was seen, to be summed up."""
    model = LanguageModel()
    names = ["id", "defect", "grams", "marked", "gram", "inside", "ends"]
    kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def counts() -> pa.RecordBatch:
        none = [None] * len(held[0][0])
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((none, none, none, none, *held.pop()), kinds, strict=True)], names=names)

    for b in (whole.slice(at, n) for whole in batches for at, n in cuts(whole.columns[1:3], AT_ONCE)):
        ids = b.column(0).to_pylist()
        qs = [canonical(x or "") for x in b.column(1).to_pylist()]
        ans = [canonical(x or "") for x in b.column(2).to_pylist()]
        defects: list[str | None] = []
        for q, a in zip(qs, ans, strict=True):
            k = letters_and_digits(a)
            defects.append("empty" if _nothing(k) else "copy" if _copies(letters_and_digits(q), k) else "refusal" if is_refusal(a) else None)
        rest = [k for k, d in enumerate(defects) if d is None]
        different = {q: k for k, q in enumerate(dict.fromkeys(qs[k] for k in rest))}
        ql, al = model.shares(list(different)), model.shares([ans[k] for k in rest])
        for k, y in zip(rest, al, strict=True):
            x = ql[different[qs[k]]]
            if x.max() > 0 and y.max() > 0 and y[x.argmax()] < 0.2:
                defects[k] = "language"
        kept = [a for a, d in zip(ans, defects, strict=True) if d is None]
        c, doc = codes(kept)
        c = _points(c, doc)
        shown_: list[list[int | None]] = [[None] * len(kept) for _ in range(3)]
        last = np.cumsum([len(a) for a in kept]) - 1
        for n in (1, 2, 3):
            h = _exact(c, n)
            ok = doc[: len(h)] == doc[n - 1 :] if len(h) else np.zeros(0, bool)
            seen, times = np.unique(h[ok], return_counts=True)
            fits = np.flatnonzero(np.array([len(a) >= n for a in kept], bool))
            end = h[last[fits] - n + 1]
            ended, often = np.unique(end, return_counts=True)
            of_seen = np.zeros(len(seen), np.int64)
            of_seen[np.searchsorted(seen, ended)] = often
            held.append((seen, times - of_seen, of_seen))
            for k, g in zip(fits.tolist(), end.tolist(), strict=True):
                shown_[n - 1][k] = g
        each = iter(zip(*shown_, strict=True))
        shown = [list(next(each)) if d is None else None for d in defects]
        marked = [None if d is not None else (a[-1] in _END_MARK or ord(a[-1]) >= 0x1F300) for a, d in zip(ans, defects, strict=True)]
        none = [None] * len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, defects, shown, marked, none, none, none), kinds, strict=True)], names=names)
        if sum(len(x[0]) for x in held) > HELD:
            held[:] = [_merged(held)]
            if len(held[0][0]) > HELD // 2:
                yield counts()
    if held:
        held[:] = [_merged(held)] if sum(len(x[0]) for x in held) else held[:1]
        yield counts()


def defective(df: DataFrame, id_col: str = "id", question: str = "question", answer: str = "answer", least: float = 0.012) -> DataFrame:
    """``id, defect`` of each defective entry.

    ``least``: likelihood of an end below which an answer counts as truncated. Rows without id have none; repeated rows
    count once. A null question is an empty one, which no answer copies and which has no language.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{question}`").cast("string").alias("q"), F.col(f"`{answer}`").cast("string").alias("a")).where("id is not null").distinct()
    found = materialise(rows.mapInArrow(_scan, "id string, defect string, grams array<bigint>, marked boolean, gram bigint, inside bigint, ends bigint"), "pairs")
    # after a mark, the shorter n-gram alone counts; answers that end alike are judged once, so that no end is a hot key
    open_ = found.where("id is not null and defect is null").select("id", "marked", F.when(F.col("marked"), F.slice("grams", 1, 1)).otherwise(F.col("grams")).alias("grams"))
    each = open_.select("marked", "grams").distinct().select("marked", "grams", F.posexplode("grams").alias("k", "gram"))
    asked = each.select("gram").where("gram is not null").distinct()
    counts = found.where("gram is not null").select("gram", "inside", "ends").join(asked, "gram", "left_semi").groupBy("gram").agg(F.sum("inside").alias("inside"), F.sum("ends").alias("ends"))
    side = [F.max(F.when(F.col("k") == n - 1, F.col(c))).alias(f"{c[0]}{n}") for n in (1, 2, 3) for c in ("inside", "ends")]
    judged = each.join(counts, "gram", "left").groupBy("marked", "grams").agg(*side)
    p = F.when(F.col("marked"), F.lit(0.05)).otherwise(F.lit(PRIOR))
    for n in (1, 2, 3):
        e, i = F.greatest(F.coalesce(F.col(f"e{n}"), F.lit(0)) - 1, F.lit(0)), F.coalesce(F.col(f"i{n}"), F.lit(0))
        longer = (e + WEIGHT * p) / (e + i + WEIGHT)
        p = longer if n == 1 else F.when(F.col("marked"), p).otherwise(longer)
    cut = open_.alias("o").join(judged.where(p < least).select("marked", "grams").alias("j"), (F.col("o.marked") == F.col("j.marked")) & F.col("o.grams").eqNullSafe(F.col("j.grams")), "left_semi")
    return found.where("defect is not null").select("id", "defect").unionByName(cut.select("id", F.lit("truncated").alias("defect"))).distinct()
