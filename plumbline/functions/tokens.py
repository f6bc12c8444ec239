"""Tokens of mixed Chinese and Latin text, as expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that the maximal-matching tokenizer knows unless others are given.
DICTIONARY = "吊柜 地漏 瓷砖 石膏线 踢脚线 窗帘盒 暖气片 乳胶漆 木地板 配电箱 弱电箱 花洒 橱柜 马桶 灯带 岩板 铝扣板 空调孔 水槽 门套 推拉门 淋浴房 浴室柜 百叶窗 止逆阀 角阀 检修口 挡水条 榻榻米 楼梯踏步 门槛石 窗台石 集成吊顶 护墙板 玻璃门 开关面板 插座 防水涂料 瓷砖胶 美缝剂 填缝砂 腻子 界面剂 轻钢龙骨 石膏板 闭水 防水 找平 渗水 空鼓 开裂 起皮 返潮 松动 色差 变形 堵塞 异响 漏风 翘边 泛碱 发霉 掉粉 起泡 跳闸 验收 保修 合同 付款 预算 报价 人工费 拆除费 设计费 管理费".split()
HAN = "一-鿿"
# Patterns of tokens that begin with a number, and of Latin words and numbers.
MIXED = f"[0-9]+[.]?[0-9]*[{HAN}A-Za-z]+[0-9{HAN}A-Za-z]*"
ALNUM = "[a-zA-Z]+|[0-9]+"


def no_strings() -> Column:
    return F.array().cast("array<string>")


def alternation(words: list[str]) -> str:
    """Longest first, so that leftmost-first matching is forward maximal matching."""
    return "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def dictionary_words(c: Column, words: list[str] | None = None) -> Column:
    """Forward maximal matching: at each place the longest known word; characters that begin none are passed over."""
    return F.regexp_extract_all(c, F.lit(f"({alternation(words or DICTIONARY)})"), 1)


def vocabulary_words(c: Column, words: list[str] | None = None) -> Column:
    """Every known word that the text holds, also those within or across others; the vocabulary's size is fixed."""
    return F.filter(F.array(*map(F.lit, words or DICTIONARY)), lambda w: F.contains(F.coalesce(c, F.lit("")), w))


def mixed_words(c: Column) -> Column:
    """Tokens that begin with a number and go on with letters."""
    return F.regexp_extract_all(c, F.lit(f"({MIXED})"), 1)


def every(c: Column, n: int | Column, of: str = ".") -> Column:
    """All substrings of ``n`` characters, overlapping ones too, by one pass; ``of``: which characters they may hold."""
    if isinstance(n, int):
        return F.regexp_extract_all(c, F.lit(f"(?s)(?=({of}{{{n}}}))"), 1)
    return F.regexp_extract_all(c, F.concat(F.lit(f"(?s)(?=({of}{{"), n.cast("string"), F.lit("}))")), 1)


def bigrams(c: Column) -> Column:
    """Pairs of neighbouring Chinese characters, everything else taken out before."""
    han = F.regexp_replace(c, f"[^{HAN}]", "")
    return every(han, 2)


def latin(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(f"({ALNUM})"), 1), F.lower)


def tokens(c: Column, keywords: Column | None = None, words: list[str] | None = None) -> Column:
    """All tokens of a text in order, with repeats: keywords twice, dictionary words, mixed words twice, bigrams, Latin words and numbers. Null counts as empty."""
    c = F.coalesce(c, F.lit(""))
    k = F.coalesce(keywords, no_strings()) if keywords is not None else no_strings()
    m = mixed_words(c)
    return F.concat(F.flatten(F.transform(k, lambda w: F.array(w, w))), dictionary_words(c, words), F.flatten(F.transform(m, lambda w: F.array(w, w))), bigrams(c), latin(c))


def windows(c: Column, least: int = 2, most: int = 6) -> Column:
    """Different substrings of ``least`` to ``most`` characters of each Chinese run."""
    return F.array_distinct(F.flatten(F.array(*(every(F.coalesce(c, F.lit("")), n, f"[{HAN}]") for n in range(least, most + 1)))))


def tokens_sql(text: str, keywords: str = "[]", words: list[str] | None = None) -> str:
    """``tokens`` as SQL text for another engine."""
    t = f"coalesce({text}, '')"
    han = f"regexp_replace({t}, '[^{HAN}]', '', 'g')"
    m = f"regexp_extract_all({t}, '({MIXED})', 1)"
    return (
        f"list_concat(flatten(list_transform(coalesce({keywords}, []), lambda w: [w, w])), regexp_extract_all({t}, '({alternation(words or DICTIONARY)})', 1), "
        f"flatten(list_transform({m}, lambda w: [w, w])), list_transform(range(1, length({han})), lambda i: substr({han}, i, 2)), list_transform(regexp_extract_all({t}, '({ALNUM})', 1), lambda w: lower(w)))"
    )
