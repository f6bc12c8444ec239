"""Problem 8: mixing sources to target weights.

Min-cost flow for overlapping sources. Equal texts may occur in several sources, so documents are aggregated by membership
pattern: the set of listed sources that hold their text. A pattern supplies its texts' tokens a first time at cost 0, a second
at cost 1, a third at cost 4 and so on (convex, so no text is repeated while fresh ones are left); an edge from pattern to
source holds the tokens of the source's own records times its cap of repeats; a source takes its share of the total. The flow
is solved over patterns, whose number is bounded by ``most_patterns``; documents are then selected in a seeded order until the
flow of their pattern and source is used up, with prefix sums over hash buckets, so that no group is sorted in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.normalise import key128
from plumbline.llm.tokenise import FOLDER, VOCABULARY, encoder, pieces, shared_path
from plumbline.session import materialise

BUCKETS = 4096


def min_cost_flow(edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge ``(from, to, capacity, cost)`` of a maximum flow of least cost. Costs aren't negative.

    Primal-dual: a search for the cheapest paths, with potentials, is followed by blocking flows over all paths of that cost,
    so the number of searches is that of the different costs, not that of the paths.
    """
    n = 1 + max((max(a, b) for a, b, _, _ in edges), default=1)
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in edges:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(z)
            cost.append(v)
    height = [0] * n
    while True:
        far = [float("inf")] * n
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out[x]:
                y = to[e]
                if cap[e] and d + cost[e] + height[x] - height[y] < far[y]:
                    far[y] = d + cost[e] + height[x] - height[y]
                    heapq.heappush(heap, (far[y], y))
        if far[sink] == float("inf"):
            return [cap[2 * k + 1] for k in range(len(edges))]
        height = [h + min(f, far[sink]) for h, f in zip(height, far, strict=True)]
        while _blocking_flow(to, cap, cost, out, height, source, sink):
            pass


def _blocking_flow(to: list[int], cap: list[int], cost: list[int], out: list[list[int]], height: list[int], source: int, sink: int) -> bool:
    """Fills all shortest paths, by number of edges, that cost nothing beyond the potentials; whether there was one."""
    level = [-1] * len(out)
    level[source] = 0
    row = [source]
    while row and level[sink] < 0:
        new = []
        for x in row:
            for e in out[x]:
                y = to[e]
                if cap[e] and level[y] < 0 and cost[e] + height[x] == height[y]:
                    level[y] = level[x] + 1
                    new.append(y)
        row = new
    if level[sink] < 0:
        return False
    at = [0] * len(out)
    path: list[int] = []
    x = source
    while True:
        if x == sink:
            push = min(cap[e] for e in path)
            for e in path:
                cap[e] -= push
                cap[e ^ 1] += push
            k = next(k for k, e in enumerate(path) if not cap[e])
            x = to[path[k] ^ 1]
            del path[k:]
            continue
        while at[x] < len(out[x]):
            e = out[x][at[x]]
            if cap[e] and level[to[e]] == level[x] + 1 and cost[e] + height[x] == height[to[e]]:
                break
            at[x] += 1
        else:
            if not path:
                return True
            x = to[path.pop() ^ 1]
            at[x] += 1
            continue
        path.append(e)
        x = to[e]


@dataclass
class Quota:
    share: float
    repeats: int


def plan(capacity: dict[tuple[str, str], int], supply: dict[str, int], quotas: dict[str, Quota], total: int | None) -> tuple[int, dict[tuple[str, str], int]]:
    """The total in tokens, and the tokens to take for each (pattern, source).

    ``capacity``: tokens of the records of a pattern in a source; ``supply``: tokens of the pattern's different texts. Without
    ``total``, it is the largest of which every source with documents can fill its share.
    """
    have, usable = dict.fromkeys(quotas, 0), dict.fromkeys(supply, 0)
    for (p, s), t in capacity.items():
        have[s] += t
        usable[p] += t * quotas[s].repeats
    fit = [have[s] * q.repeats / q.share for s, q in quotas.items() if q.share > 0 and have[s]]
    if total is None:
        total = int(min(fit)) if fit else 0
    names, patterns = sorted(quotas), sorted(supply)
    at = {("source", s): 2 + k for k, s in enumerate(names)} | {("pattern", p): 2 + len(names) + k for k, p in enumerate(patterns)}
    edges = [(at["source", s], 1, min(int(quotas[s].share * total), have[s] * quotas[s].repeats), 0) for s in names]
    used = sorted(capacity)
    edges += [(at["pattern", p], at["source", s], capacity[p, s] * quotas[s].repeats, 0) for p, s in used]
    for p in patterns:
        edges += [(0, at["pattern", p], supply[p], k * k) for k in range(max(1, -(-usable[p] // max(1, supply[p]))))]
    flow = min_cost_flow(edges, 0, 1)
    return total, {ps: flow[len(names) + k] for k, ps in enumerate(used)}


def _counted(df: DataFrame, vocabulary: str, folder: str) -> DataFrame:
    """``doc_id, source, bit, h, tokens``: 128 bits of each text's hash and its number of tokens, by one pass over the texts."""
    path = shared_path(df.sparkSession, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path())
        for b in batches:
            texts = b.column(3).to_pylist()
            tokens = [len(x) for part in pieces(texts) for x in e.encode(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(map(key128, texts), pa.binary()), pa.array(tokens, pa.int64())], names=["doc_id", "source", "bit", "h", "tokens"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "source", "bit", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, source string, bit int, h binary, tokens bigint")


def _cut(rows: DataFrame, bucket: str, rest: str) -> tuple[DataFrame, DataFrame]:
    """For each pattern and source: the bucket in which the ``rest`` of its tokens is used up, with the tokens before it (``edge, left``), and the number of buckets wholly used (``full``)."""
    sums = rows.groupBy("mask", "source", bucket, rest).agg(F.sum("tokens").alias("t"))
    before = sums.withColumn("upto", F.sum("t").over(Window.partitionBy("mask", "source").orderBy(bucket))).withColumn("before", F.col("upto") - F.col("t"))
    edge = before.where((F.col("before") < F.col(rest)) & (F.col("upto") > F.col(rest))).select("mask", "source", F.col(bucket).alias("edge"), (F.col(rest) - F.col("before")).alias("left"))
    full = before.where(F.col("upto") <= F.col(rest)).groupBy("mask", "source").agg((F.max(bucket) + 1).alias("full"))
    return edge, full


def mix(docs: DataFrame, weights: DataFrame, total: int | None = None, seed: int = 20, vocabulary: str = VOCABULARY, folder: str = FOLDER, most_patterns: int = 4096, most_sources: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The mixture ``doc_id, source, tokens, uses``, and ``source, target_share, available_tokens, tokens, actual_share, records`` of each listed source.

    No record is used more than its source's ``max_repeats`` times. Documents of sources without a share, and those without
    tokens (null or empty text), aren't used; repeated rows count once. A listed source without documents, or with too few
    for a given ``total``, falls short; its actual share says so. Within each pattern and source the tokens taken differ from
    the flow by less than one document. Equal ``seed`` gives an equal mixture.

    ``weights`` is a configuration of at most ``most_sources`` different sources (checked). The flow is planned over the
    ``most_patterns`` most frequent sets of sources. Texts of rarer sets keep all their records: each record then counts
    for its own source alone, so shares and caps hold as before, and only a text held by several sources may be used in two of
    them while fresh texts are left.
    """
    spark = docs.sparkSession
    rows = weights.select("source", "target_share", "max_repeats").where("source is not null").distinct().limit(most_sources + 1).collect()
    quotas = {r.source: Quota(float(r.target_share or 0), int(r.max_repeats if r.max_repeats is not None else 1)) for r in rows}
    if len(rows) > most_sources or len(quotas) != len(rows):
        raise ValueError(f"weights must list at most {most_sources} different sources")
    index = spark.createDataFrame([(s, k) for k, s in enumerate(sorted(quotas))] or [("", 0)], "source string, bit int")
    listed = docs.select("doc_id", "source", "text").join(F.broadcast(index), "source").where("text is not null and text <> ''")
    records = materialise(_counted(listed, vocabulary, folder).where("tokens > 0").distinct(), "records")
    alone = F.col("bit").cast("string")
    shared = records.groupBy("h").agg(F.array_sort(F.collect_set("bit")).alias("bits")).where(F.size("bits") > 1).select("h", F.concat_ws(",", F.col("bits").cast("array<string>")).alias("mask"))
    common = shared.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "mask").limit(most_patterns).select("mask")
    named = records.join(shared.join(F.broadcast(common), "mask"), "h", "left").withColumn("mask", F.coalesce("mask", alone))
    named = materialise(named.select("doc_id", "source", "h", "tokens", "mask"), "patterns")
    held = named.groupBy("mask", "source").agg(F.sum("tokens").alias("t")).collect()  # most_patterns × sources at most
    different = named.groupBy("mask", "h").agg(F.min("tokens").alias("t")).groupBy("mask").agg(F.sum("t").alias("t")).collect()
    _, taken = plan({(r.mask, r.source): r.t for r in held}, {r.mask: r.t for r in different}, quotas, total)

    by_pattern: dict[str, list[str]] = {}
    for p, s in sorted(taken):
        by_pattern.setdefault(p, []).append(s)
    capacity, start = {(r.mask, r.source): r.t for r in held}, {}
    for p, sources in by_pattern.items():  # sources that share texts begin at different places of the same order
        done, whole = 0, sum(taken[p, s] for s in sources)
        for s in sources:
            start[p, s] = done / whole if done else 0.0
            done += taken[p, s]
    steps = [(p, s, f // capacity[p, s], f % capacity[p, s], start[p, s]) for (p, s), f in taken.items() if f]
    flows = spark.createDataFrame(steps or [("", "", 0, 0, 0.0)], "mask string, source string, whole bigint, rest bigint, start double")
    # the order: by the text's hash in buckets; in the bucket where the flow ends, by the record's hash in smaller ones, since
    # one text may have many records; in the small one where it ends, one by one
    place = F.pmod((F.xxhash64("h", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))) - F.col("start"), F.lit(1.0))
    placed = named.join(F.broadcast(flows), ["mask", "source"]).withColumn("bucket", F.floor(place * BUCKETS).cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BUCKETS)).cast("int"))
    edge, full = _cut(placed, "bucket", "rest")
    at = placed.join(F.broadcast(edge), ["mask", "source"], "left").join(F.broadcast(full), ["mask", "source"], "left")
    cols = ["doc_id", "source", "tokens", "whole", "extra"]
    outer = at.where("edge is null or bucket <> edge").withColumn("extra", (F.col("bucket") < F.coalesce("full", F.lit(0))).cast("int"))
    inner = at.where("bucket = edge").drop("edge", "full", "rest").withColumnRenamed("left", "rest")
    edge, full = _cut(inner, "part", "rest")
    at = inner.join(F.broadcast(edge), ["mask", "source"], "left").join(F.broadcast(full), ["mask", "source"], "left")
    passed = at.where("edge is null or part <> edge").withColumn("extra", (F.col("part") < F.coalesce("full", F.lit(0))).cast("int"))
    each = at.where("part = edge").withColumn("upto", F.sum("tokens").over(Window.partitionBy("mask", "source").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0)))
    partly = each.withColumn("extra", (F.col("upto") - F.col("tokens") / 2 <= F.col("left")).cast("int"))
    mixture = outer.select(*cols).unionByName(passed.select(*cols)).unionByName(partly.select(*cols))
    mixture = materialise(mixture.withColumn("uses", F.col("whole") + F.col("extra")).where("uses > 0").select("doc_id", "source", "tokens", "uses"), "mixture")

    target = spark.createDataFrame([(s, q.share) for s, q in sorted(quotas.items())] or [("", 0.0)], "source string, target_share double").where("source <> ''")
    sizes = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("records"))
    available = named.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    shares = target.join(sizes, "source", "left").join(available, "source", "left").na.fill(0, ["tokens", "records", "available_tokens"])
    everything = F.greatest(F.sum("tokens").over(Window.partitionBy(F.lit(0))), F.lit(1))  # over most_sources rows
    shares = shares.select("source", "target_share", "available_tokens", "tokens", (F.col("tokens") / everything).alias("actual_share"), "records")
    return mixture, shares.withColumn("actual_share", F.round("actual_share", 6))
