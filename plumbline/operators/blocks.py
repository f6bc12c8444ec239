"""The best documents of each query, scored in blocks of documents that meet all queries as arrays.

A join of postings with queries makes a row for every common term of every pair, which is shuffled to be summed. Here a block's
postings stand in one task, and a query's scores of all its documents are one array, of which only the best leave the task. Nothing is
left out: every pair with a common term is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType, StructField, StructType
from pyspark.sql.window import Window

from plumbline.session import drop, materialise

#: Documents and queries that meet in one task.
BLOCK, ASKED = 1 << 14, 1 << 15
#: Blocks that even few documents are put in, so that several tasks share the work, and documents that make a block worthwhile.
LEAST_BLOCKS, LEAST = 12, 1 << 10
#: Scores of a column, of which only the greatest is looked at first.
DEEP = 64
#: By how much sums may differ that are equal after rounding to six digits.
NEAR = 1.1e-6

Run = Callable[[pa.Table, pa.Table], pa.Table]


def block_counts(docs: int, queries: int) -> tuple[int, int]:
    """Blocks of documents, and groups of queries."""
    return max(1, -(-docs // BLOCK), min(LEAST_BLOCKS, -(-docs // LEAST))), max(1, -(-queries // ASKED))


def place(col: str, n: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def meet(docs: DataFrame, queries: DataFrame, run: Run, schema: str, blocks: int, groups: int, own: DataFrame | None = None) -> DataFrame:
    """``run`` for each block of ``docs`` (with ``block``) and each group of ``queries`` (with ``qid``); the rows of ``own`` (with ``block``) come to their block among the queries."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("part", place("qid", groups)).withColumn("block", every(blocks))
    if own is not None:
        asked = asked.unionByName(own.withColumn("part", every(groups)), allowMissingColumns=True)
    tasks = 3 * blocks * groups  # a number given is kept: partitions of few bytes and much work aren't put together
    sides = [x.repartition(tasks, "block", "part").groupBy("block", "part") for x in (docs.withColumn("part", every(groups)), asked)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, schema)


def _at_least_kth(score: np.ndarray, k: int, near: float) -> np.ndarray:
    """Indices of the positive scores that aren't more than ``near`` under the ``k``-th best."""
    width = len(score) // DEEP
    if width >= 4 * k:
        # k columns whose best is v or more have k scores of v or more, so the k-th best isn't less, and other columns needn't be looked through
        head = score[: DEEP * width].reshape(DEEP, width)
        most = head.max(axis=0)
        least = np.partition(most, width - k)[width - k] - near
        if least > 0:
            cols = np.flatnonzero(most >= least)
            row, col = np.nonzero(head[:, cols] >= least)
            found = np.concatenate([row * width + cols[col], DEEP * width + np.flatnonzero(score[DEEP * width :] >= least)])
            own = score[found]
            return found[own >= np.partition(own, len(own) - k)[len(own) - k] - near]
    if len(score) > k:
        v = np.partition(score, len(score) - k)[len(score) - k]
        if v > near:
            return np.flatnonzero(score >= v - near)
    return np.flatnonzero(score > 0)


def best_of(score: np.ndarray, k: int, place_of: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Indices of all that may be among the best ``k`` of the positive scores, divided by ``scale`` and rounded half up to six digits, ties by ``place_of``; hardly more than ``k``."""
    found = _at_least_kth(score, k, NEAR * scale)
    if len(found) <= 2 * k:
        return found
    x = score[found] / scale * 1e6
    whole = np.floor(x + 0.5)
    unsure = np.abs(x - np.floor(x) - 0.5) < 1e-3  # where the rounding of a double may go either way
    order = np.lexsort((place_of[found], -whole))
    order = order[~unsure[order]][:k]
    return np.concatenate([found[order], found[unsure]])


def _ids(t: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    """The ids, and each one's place in their order."""
    ids = t.column(name).combine_chunks()
    place_of = np.empty(len(ids), np.int64)
    place_of[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return ids, place_of


def _table(names: list[str], parts: list[list[np.ndarray]], kinds: list[type], takes: list[pa.Array | None]) -> pa.Table:
    cols = [np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, kinds, strict=True)]
    return pa.table({n: pa.array(c) if t is None else t.take(pa.array(c)) for n, c, t in zip(names, cols, takes, strict=True)})


def _lexical(n: int, avgdl: float, k: int, arms: tuple[str, ...], k1: float, b: float) -> Run:
    def run(docs: pa.Table, other: pa.Table) -> pa.Table:
        ids, place_of = _ids(docs, "id")
        asked = other.filter(pc.is_valid(other.column("qid")))
        own = other.filter(pc.is_valid(other.column("df")))
        words, df = own.column("term").combine_chunks(), own.column("df").to_numpy().astype(float)
        nd, qids = len(ids), asked.column("qid").combine_chunks()
        out: list[list[np.ndarray]] = [[], [], [], []]
        if nd and len(qids):
            tokens = docs.column("tokens").combine_chunks()
            dl = pc.list_value_length(tokens).to_numpy()
            term = pc.index_in(tokens.flatten(), value_set=words).to_numpy()
            key, tf = np.unique(term.astype(np.int64) * nd + np.repeat(np.arange(nd), dl), return_counts=True)
            term, doc = np.divmod(key, nd)
            starts = np.searchsorted(term, np.arange(len(words) + 1)).tolist()
            tf = tf.astype(float)
            weights = []
            for arm in arms:
                if arm == "bm25":
                    idf = np.log((n - df + 0.5) / (df + 0.5) + 1.0)
                    weights.append(idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / avgdl)))
                else:
                    idf = np.log((n + 1.0) / (df + 1.0)) + 1.0
                    w = (1.0 + np.log(tf)) * idf[term]
                    norm = np.sqrt(np.bincount(doc, w * w, nd))
                    weights.append(w * idf[term] / norm[doc])
            terms = asked.column("terms").combine_chunks()
            sizes = np.cumsum([0, *pc.list_value_length(terms).to_pylist()]).tolist()
            of = pc.fill_null(pc.index_in(terms.flatten(), value_set=words), -1).to_pylist()
            times = asked.column("times").combine_chunks().flatten().to_pylist()
            qnorm = asked.column("qnorm").to_pylist()
            for q in range(len(qids)):
                met = [(starts[t], starts[t + 1], m) for t, m in zip(of[sizes[q] : sizes[q + 1]], times[sizes[q] : sizes[q + 1]], strict=True) if t >= 0]
                if not met:
                    continue
                at = np.concatenate([doc[i:j] for i, j, _ in met])
                for a, (arm, w) in enumerate(zip(arms, weights, strict=True)):
                    factor = (lambda m: m) if arm == "bm25" else (lambda m: 1.0 + np.log(m))
                    score = np.bincount(at, np.concatenate([w[i:j] if m == 1 else w[i:j] * factor(m) for i, j, m in met]), nd)
                    scale = 1.0 if arm == "bm25" else qnorm[q]
                    found = best_of(score, k, place_of, scale)
                    for x, y in zip(out, (np.full(len(found), a, np.int32), np.full(len(found), q), found, score[found] / scale), strict=True):
                        x.append(y)
        return _table(["arm", "qid", "id", "score"], out, [np.int32, np.int64, np.int64, float], [None, qids, ids, None])

    return run


def search(docs: DataFrame, tokens: Column, q: DataFrame, k: int, arms: tuple[str, ...], k1: float, b: float, id_col: str = "id", allowed: DataFrame | None = None) -> list[DataFrame]:
    """For each of ``arms`` (``bm25``, ``tfidf``) the best ``k`` documents ``qid, id, score, rank`` of each query, ties by id; runs jobs.

    ``q``: ``qid, term, qm``, see ``query_terms``. ``allowed``: ids that may be found, with statistics unchanged. Null ids aren't allowed; ids are unique.
    """
    kinds = docs.schema[id_col].dataType.simpleString(), q.schema["qid"].dataType.simpleString()
    each = materialise(docs.select(F.col(id_col).alias("id"), tokens.alias("tokens")), "tokens")
    n, avgdl = each.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("tokens")), F.lit(1.0))).first()
    avgdl = avgdl or 1.0  # no document has a token, so none is scored
    asked = q.groupBy("qid").agg(F.count(F.lit(1)))
    blocks, groups = block_counts(n, asked.count())
    each_in = each.withColumn("block", place("id", blocks))
    own = materialise(each_in.select("block", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("block", "term").agg(F.count(F.lit(1)).alias("c")), "own")
    terms = own.groupBy("term").agg(F.sum("c").alias("df"))
    qw = (1.0 + F.log("qm")) * (F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0)
    known = q.join(terms, "term").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "qm"))).alias("t"), F.sqrt(F.sum(qw * qw)).alias("qnorm"))
    known = materialise(known.select("qid", F.col("t.term").alias("terms"), F.col("t.qm").alias("times"), "qnorm"), "asked")
    # lists that are null would be gone through again for each further row when Spark measures the batch; empty ones aren't
    vocabulary = own.join(terms, "term").select("block", "term", "df", *(F.array().cast(known.schema[c].dataType).alias(c) for c in ("terms", "times")))
    may = each_in if allowed is None else each_in.join(allowed.select("id").distinct(), "id", "left_semi")
    met = meet(may.select("block", "id", "tokens"), known, _lexical(n, avgdl, k, arms, k1, b), f"arm int, qid {kinds[1]}, id {kinds[0]}, score double", blocks, groups, vocabulary)
    met = met.withColumn("score", F.round("score", 6))
    positive = met.where((F.col("score") > 0) | (F.col("arm") != F.lit(arms.index("bm25") if "bm25" in arms else -1)))
    w = Window.partitionBy("arm", "qid").orderBy(F.desc("score"), F.asc("id"))
    top = materialise(positive.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "best")
    for x in (each, own, known):
        drop(x)
    return [top.where(F.col("arm") == a).select("qid", "id", "score", "rank") for a in range(len(arms))]


def _best_whole(score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the best ``k`` of the positive whole scores, ties by index."""
    v = max(1, np.partition(score, len(score) - k)[len(score) - k]) if len(score) > k else 1
    found = np.flatnonzero(score >= v)
    return found if len(found) <= k else found[np.argsort(-score[found], kind="stable")[:k]]


def _best_small(score: np.ndarray, k: int) -> np.ndarray:
    """The same for few different scores, from the greatest down."""
    v = int(score.max()) if len(score) else 0
    while v > 1 and np.count_nonzero(score >= v) < k:
        v -= 1
    found = np.flatnonzero(score >= max(v, 1))
    return found if len(found) <= k else found[np.argsort(-score[found], kind="stable")[:k]]


def pointed(df: DataFrame, vocabulary: list[str], columns: dict[str, int]) -> DataFrame:
    """``df`` with ``points``: for each word of a vocabulary of known size, the sum of the points of the columns that hold it. Rows without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            have = np.zeros((len(vocabulary), b.num_rows), np.int16)
            for c, p in columns.items():
                texts = [x or "" for x in b.column(c).to_pylist()]
                for row, w in zip(have, vocabulary, strict=True):
                    row += p * np.fromiter((w in x for x in texts), np.int16, len(texts))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(have.T.ravel()), len(vocabulary)).cast(pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "points"]).filter(pa.array(have.any(axis=0)))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("points", ArrayType(ShortType()))]))


def _matrix(docs: pa.Table, width: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The ids, their order, and the points (words, documents) of the documents in that order."""
    ids, place_of = _ids(docs, "id")
    order = np.argsort(place_of)
    flat = docs.column("points").combine_chunks().flatten().to_numpy()
    return ids.take(pa.array(order)), order, np.ascontiguousarray(flat.reshape(len(ids), width)[order].T)


def weighted(entries: DataFrame, searches: DataFrame, text: str, vocabulary: list[str], columns: dict[str, int], k: int) -> DataFrame:
    """``qid, id, score, rank``: the best ``k`` entries of each search by the points of the known words that its ``text`` holds, ties by id; runs jobs.

    Searches that hold the same words are one. Null ids aren't allowed; ids are unique.
    """
    held = F.filter(F.array(*(F.when(F.contains(F.coalesce(text, F.lit("")), F.lit(w)), F.lit(n)) for n, w in enumerate(vocabulary))), lambda x: x.isNotNull())
    want = materialise(searches.select("qid", held.alias("words")).where(F.size("words") > 0).select("qid", "words", F.array_join(F.col("words").cast("array<string>"), ",").alias("set")), "want")
    each = materialise(pointed(entries.select("id", *columns), vocabulary, columns).select("id", "points"), "points")
    sets = want.select(F.col("set").alias("qid"), "words").distinct()
    blocks, groups = block_counts(each.count(), sets.count())

    def run(docs: pa.Table, other: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        ids, _, have = _matrix(docs, len(vocabulary))
        if len(ids):
            have = have if len(vocabulary) * sum(columns.values()) < 1 << 15 else have.astype(np.int64)
            for q, words in enumerate(other.column("words").to_pylist()):
                score = have[words[0]].copy()
                for w in words[1:]:
                    score += have[w]
                found = _best_small(score, k)
                for x, y in zip(out, (np.full(len(found), q), found, score[found].astype(np.int64)), strict=True):
                    x.append(y)
        return _table(["qid", "id", "score"], out, [np.int64] * 3, [other.column("qid").combine_chunks(), ids, None])

    kind = entries.schema["id"].dataType.simpleString()
    met = meet(each.withColumn("block", place("id", blocks)), sets, run, f"qid string, id {kind}, score bigint", blocks, groups)
    w = Window.partitionBy("set").orderBy(F.desc("score"), F.asc("id"))
    best = met.withColumnRenamed("qid", "set").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return want.select("qid", "set").join(best, "set").select("qid", "id", "score", "rank")


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Chinese characters from 0 on, anything else -1; the text that each is from. A mark stands after each text."""
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) - 0x4E00
    codes[(codes < 0) | (codes > 0x9FFF - 0x4E00)] = -1
    return np.concatenate([codes, np.full(8, -1)]), np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])


class Windows:
    """Numbers of the substrings of two to six characters that Chinese runs of some texts have, exact: each is known by the number of its beginning and its last character."""

    def __init__(self, texts: list[str], most: int = 6) -> None:
        self.tables: list[np.ndarray] = []
        self.most = most
        self.n = 0
        self.starts: list[int] = []
        self.of_text = self._walk(texts, True)

    def _walk(self, texts: list[str], new: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        code, text = _runs(texts)
        at = np.flatnonzero(code >= 0)
        number = code[at]
        out = []
        for n in range(2, self.most + 1):
            on = code[at + n - 1] >= 0
            at, number = at[on], number[on]
            key = number << 15 | code[at + n - 1]
            if new:
                table, number = np.unique(key, return_inverse=True)
                self.tables.append(table)
                self.starts.append(self.n)
                self.n += len(table)
            else:
                table = self.tables[n - 2]
                number = np.searchsorted(table, key)
                number[number == len(table)] = 0
                on = table[number] == key if len(table) else np.zeros(len(key), bool)
                at, number = at[on], number[on]
            out.append((text[at], number + self.starts[n - 2]))
        return out

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text and number of each known substring that a text holds, as often as it does."""
        x = self._walk(texts, False)
        return np.concatenate([t for t, _ in x]), np.concatenate([n for _, n in x])

    def number(self, words: list[str]) -> np.ndarray:
        """The number of each word of Chinese characters, -1 for those that no text holds."""
        out = np.full(len(words), -1)
        for size, (text, number) in enumerate(self._walk(words, False), 2):
            whole = np.array([len(words[t]) == size for t in text.tolist()], bool)
            out[text[whole]] = number[whole]
        return out


def with_bonus(units: DataFrame, searches: DataFrame, vocabulary: list[str], weak: list[str], k: int) -> DataFrame:
    """``qid, id, score, core_count, chapter``, the best ``k`` and hardly any others of each search; runs jobs.

    ``units``: ``id, title, description, chapter, points`` (see ``pointed``: 6 for a core word in the title, 3 in the description); ``searches``:
    ``qid, question, core`` (places in the vocabulary). A point is given for each substring of the question, neither weak nor a core word, that a unit holds.
    """
    each, asked = materialise(units, "units"), materialise(searches, "searches")
    blocks, groups = block_counts(each.count(), asked.count())

    def run(docs: pa.Table, other: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        ids, order, have = _matrix(docs, len(vocabulary))
        nd, qs = len(ids), other.column("question").to_pylist()
        if nd and qs:
            hits = np.where(have == 9, 2, have > 0).astype(np.int16)
            chapter = docs.column("chapter").to_numpy(zero_copy_only=False)[order].astype(np.int64)
            known = Windows(qs)
            text, term = (np.concatenate(x) for x in zip(*known.of_text, strict=True))
            pair = np.unique(text * known.n + term)
            text, term = np.divmod(pair, max(1, known.n))
            plain = ~np.isin(term, known.number(weak))
            text, term = text[plain], term[plain]
            begins = np.searchsorted(text, np.arange(len(qs) + 1)).tolist()
            place_of = np.argsort(order)
            key = [n * nd + place_of[d] for c in ("title", "description") for d, n in [known.found(docs.column(c).to_pylist())]]
            held, doc = np.divmod(np.unique(np.concatenate(key)), nd)
            starts = np.searchsorted(held, np.arange(known.n + 1))
            words = known.number(vocabulary)
            for q, core in enumerate(other.column("core").to_pylist()):
                cores = hits[core].sum(axis=0, dtype=np.int64)
                some = np.flatnonzero(cores)
                if not len(some):
                    continue
                t = term[begins[q] : begins[q + 1]]
                t = t[~np.isin(t, words[core])]
                i, j = starts[t], starts[t + 1]
                full = j > i
                parts = [doc[x:y] for x, y in zip(i[full].tolist(), j[full].tolist(), strict=True)]
                extra = np.bincount(np.concatenate(parts), minlength=nd)[some] if parts else 0
                total, cores = have[core].sum(axis=0, dtype=np.int64)[some] + extra, cores[some]
                best = _best_whole((total * 512 + cores) * 2 + chapter[some], k)  # fewer than 512 core words in all
                for x, y in zip(out, (np.full(len(best), q), some[best], total[best], cores[best], chapter[some][best]), strict=True):
                    x.append(y)
        return _table(["qid", "id", "score", "core_count", "chapter"], out, [np.int64] * 5, [other.column("qid").combine_chunks(), ids, None, None, None])

    kinds = searches.schema["qid"].dataType.simpleString(), units.schema["id"].dataType.simpleString()
    return meet(each.withColumn("block", place("id", blocks)), asked, run, f"qid {kinds[0]}, id {kinds[1]}, score bigint, core_count bigint, chapter bigint", blocks, groups)
