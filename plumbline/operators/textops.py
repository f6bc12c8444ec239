"""Text to structure and guards, as expressions: normalisation, chunks, patterns, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import half_width

# Traditional characters that probes use, and their simplified forms.
TRADITIONAL, SIMPLIFIED = "個們來對時會這裡說國學開關門車問題還後點錢過進應該無體電話號碼數據庫規則統設計圖紙報價簡單複雜總結輸出系統指令", "个们来对时会这里说国学开关门车问题还后点钱过进应该无体电话号码数据库规则统设计图纸报价简单复杂总结输出系统指令"


def name_key(c: Column) -> Column:
    """Lower-cased Latin letters, digits and Chinese characters only."""
    return F.regexp_replace(F.lower(c), "[^0-9a-z一-鿿]", "")


def probe_key(c: Column) -> Column:
    """Without control and zero-width characters, half width, without blanks and separators, simplified, lower case."""
    t = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{00AD}]", "")
    t = F.regexp_replace(half_width(t), r"[\s\x{3000}\-_.,;:|/\\*·、，。；：]", "")
    return F.lower(F.translate(t, TRADITIONAL, SIMPLIFIED))


# Patterns of requests for a prompt or for all data, over ``probe_key``.
PROBE_A = "系统提示词|systemprompt|你的指令|初始指令|忽略(之前|以上|上面)|ignoreprevious|开发者模式|jailbreak"
PROBE_B = "所有数据|全部数据|导出数据库|数据库结构|dumpall|全部规则|列出所有"


def probe(c: Column) -> Column:
    """``A``, ``B`` or null."""
    k = probe_key(c)
    return F.when(k.rlike(PROBE_A), "A").when(k.rlike(PROBE_B), "B")


def chunks(df: DataFrame, id_col: str, text_col: str, size: int = 50) -> DataFrame:
    """``id, chunk_no, chunk, completed``: runs of ``size`` characters; the last is completed. An empty text is one empty chunk, a null text none."""
    last = F.greatest(F.ceil(F.length(text_col) / size).cast("int") - 1, F.lit(0))
    cut = F.when(F.col(text_col) == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text_col, F.lit(f"(?s)(.{{1,{size}}})"), 1))
    each = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), last.alias("last"), F.posexplode(cut).alias("chunk_no", "chunk"))
    return each.select("id", "chunk_no", "chunk", (F.col("chunk_no") == F.col("last")).alias("completed"))


def pattern_counts(c: Column, patterns: dict[str, str]) -> list[Column]:
    """A count for each pattern, as columns ``n_<name>``; null counts as empty."""
    return [F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({p})"), 1)).cast("bigint").alias(f"n_{k}") for k, p in patterns.items()]


def number_after(c: Column, pattern: str) -> Column:
    """The first group of a pattern as a number, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1), F.lit("")).try_cast("double")


def json_in(c: Column, schema: str) -> Column:
    """The JSON object or array in a model's answer: without fences, from the first bracket to the last; null if it can't be read."""
    plain = F.regexp_replace(c, r"(?m)^\s*```(?:json)?\s*$", "")
    found = F.regexp_extract(plain, r"(?s)([\[{].*[\]}])", 1)
    return F.from_json(F.nullif(found, F.lit("")), schema, {"mode": "PERMISSIVE"})


def hits(df: DataFrame, id_col: str, text: Column, words: list[tuple[str, str, str]]) -> DataFrame:
    """``id, category, level, word`` of each listed word (``category, level, word``; a list of known size) that a text holds."""
    found = F.filter(F.array(*(F.when(F.contains(F.coalesce(text, F.lit("")), F.lit(w)), F.struct(F.lit(c).alias("category"), F.lit(l).alias("level"), F.lit(w).alias("word"))) for c, l, w in words)), lambda x: x.isNotNull())
    return df.select(F.col(id_col).alias("id"), F.explode(found).alias("x")).select("id", "x.category", "x.level", "x.word")


# How question and answer blocks are written, and the tags of an entry without any.
_QA = r"(?s)(?:Q[：:]\s*|问题[：:]\s*)(.+?)(?:\n|。)(?:A[：:]\s*|回答[：:]\s*)(.+?)(?=\n\s*(?:Q[：:]|问题[：:]|[0-9]+[.．]|\z))"
_BLOCK, _ANSWER = r"\n\s*(?:[0-9]+[.．]\s*|\*\s*)", "回答[：:]|答[：:]|答案[：:]"
DEFAULT_TAGS = ("装修", "知识")


def _bare(c: Column) -> Column:
    """Without blanks at the ends, then without full stops at the end, then without blanks again."""
    edges = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, edges, ""), "。+$", ""), edges, "")


def first_tags(c: Column, most: int = 5) -> Column:
    """The first different runs of two to four Chinese characters; default tags where there are none."""
    found = F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit("([一-鿿]{2,4})"), 1)), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, DEFAULT_TAGS)))


def qa_entries(c: Column, question: int = 8, answer: int = 20, most: int = 20) -> Column:
    """List of ``question, answer, tags`` that a model's plain answer holds: pairs marked as question and answer, else numbered blocks parted by an answer mark.

    Pairs with a shorter question or answer are passed over; of the rest the first ``most`` count (the feature of the format).
    A null text has none.
    """
    c = F.coalesce(c, F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(_QA), 1).alias("q"), F.regexp_extract_all(c, F.lit(_QA), 2).alias("a"))
    blocks = F.filter(F.transform(F.split(c, _BLOCK), lambda b: F.split(F.regexp_replace(b, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), _ANSWER, 2)), lambda x: (F.size(x) == 2) & (F.length(F.array_join(x, "答案：")) >= 30))
    split = F.transform(blocks, lambda x: F.struct(x[0].alias("q"), x[1].alias("a")))
    clean = lambda xs: F.filter(F.transform(xs, lambda x: F.struct(_bare(x["q"]).alias("question"), _bare(x["a"]).alias("answer"))), lambda x: (F.length(x["question"]) >= question) & (F.length(x["answer"]) >= answer))
    kept = F.when(F.size(clean(pairs)) > 0, clean(pairs)).otherwise(clean(split))
    return F.transform(F.slice(kept, 1, most), lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer"), first_tags(F.concat_ws(" ", x["question"], x["answer"])).alias("tags")))


def marked(c: Column, mark: str) -> Column:
    """The text with a closing mark, once however often it is applied; null and empty text stay."""
    return F.when(F.coalesce(c, F.lit("")) == "", c).when(F.contains(c, F.lit(mark.strip())), c).otherwise(F.concat(c, F.lit(mark)))


def folded_lines(df: DataFrame, id_col: str, text_col: str, least: int = 3) -> DataFrame:
    """``id, line_no, line, times``: the lines of each text, where ``least`` and more neighbouring lines that are the same, apart from case and blanks, stand as their first with their number."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"\r\n|\n|\r")).alias("line_no", "line")).withColumn("_k", F.lower(F.regexp_replace("line", r"\s+", "")))
    w = Window.partitionBy("id").orderBy("line_no")
    runs = lines.withColumn("_new", F.when(F.lag("_k").over(w).eqNullSafe(F.col("_k")) & (F.col("line_no") > 0), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    sized = runs.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("id", "_run"))).withColumn("_first", F.min("line_no").over(Window.partitionBy("id", "_run")))
    kept = sized.where((F.col("times") < least) | (F.col("line_no") == F.col("_first")))
    return kept.select("id", "line_no", "line", F.when(F.col("times") >= least, F.col("times")).otherwise(F.lit(1).cast("bigint")).alias("times"))


# Kinds of contract and styles, in the order in which they are looked for; words for children and pets.
PACKAGES, STYLES = ("全包", "大包", "半包"), ("现代简约", "北欧", "新中式", "日式", "美式", "轻奢", "极简")
CHILD, PET = ("孩子", "小孩", "宝宝", "儿童"), ("猫", "狗", "宠物")


def profile(c: Column) -> dict[str, Column]:
    """Columns ``area, budget, rooms, package, style, has_child, has_pet`` of what a client says; null where nothing is said."""
    c = F.coalesce(c, F.lit(""))
    one = lambda words: F.coalesce(*(F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in words))
    some = lambda words: one(words).isNotNull()
    number = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast("bigint")
    return {"area": number(r"([0-9]+)\s*平(?:方米)?"), "budget": number(r"([0-9]+)\s*万") * 10_000, "rooms": number(r"([0-9])\s*室"), "package": one(PACKAGES), "style": one(STYLES), "has_child": some(CHILD), "has_pet": some(PET)}
