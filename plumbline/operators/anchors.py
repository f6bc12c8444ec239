"""Where an edit belongs in a text, from the context that was noted with it: a ladder of looser and looser ways, then an assignment without conflicts."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.repair import find_all

# Notes that stand in place of a context.
NOTES = ("同字段", "第二处", "第三处")
_MARK = "⏎"


def stripped(text: Column) -> Column:
    """The text without line feeds."""
    return F.replace(text, F.lit("\n"), F.lit(""))


def offsets(text: Column) -> Column:
    """For each character of the stripped text, its place (from 1) in the text itself."""
    split = F.array(F.split(text, ""))
    return F.transform(split, lambda cs: F.filter(F.sequence(F.lit(1), F.greatest(F.size(cs), F.lit(1))), lambda i: F.get(cs, i - 1) != "\n"))[0]


def sites(records: DataFrame, texts: DataFrame, gap: int = 300, most_noted: int = 20, ratio: float = 0.85, most_fuzzy: int = 10) -> DataFrame:
    """``rec_id, id, field, old, new, mode, pos`` (from 1): the places that each record's edit may mean.

    ``records``: ``rec_id, id, field, context, old, new``; ``texts``: ``id, field, body``. Modes, the first of which counts for a place:
    ``exact``: the context stands in the text, and ``old`` in it; ``stripped``: the same without line feeds; ``ellipsis``: the parts
    before and after an ellipsis stand in this order, at most ``gap`` characters apart; ``note``: the context is only a note, and
    ``old`` occurs ``most_noted`` times at most. A record without any place gets those (``fuzzy``) of the first ``most_noted`` occurrences
    of ``old`` whose surroundings are at least ``ratio`` alike the context, the best ``most_fuzzy``. Records of unknown texts, null
    contexts and empty ``old`` have none.
    """
    c = F.replace("context", F.lit(_MARK), F.lit("\n"))
    r = records.join(texts, ["id", "field"]).where("context is not null and old <> '' and body is not null").withColumns({"c": c, "sc": stripped(c), "sb": stripped(F.col("body")), "at": offsets(F.col("body"))})
    no = F.array().cast("array<int>")
    first = F.instr(F.col("sc"), F.col("old"))
    back = lambda ps, shift: F.transform(ps, lambda p: F.get(F.col("at"), (p + shift - 2).cast("int")))
    inner = find_all(F.col("c"), F.col("old"))
    exact = F.flatten(F.transform(find_all(F.col("body"), F.col("c")), lambda p: F.transform(F.col("inner"), lambda q: (p + q - 1).cast("int"))))
    strip = F.when(first > 0, back(find_all(F.col("sb"), F.col("sc")), first)).otherwise(no)
    parts = F.split(F.col("c"), r"\.\.\.|…")
    head, tail = stripped(parts[0]), stripped(F.element_at(parts, -1))
    in_head, in_tail = F.instr(F.col("head"), F.col("old")), F.instr(F.col("tail"), F.col("old"))
    heads, tails = find_all(F.col("sb"), F.col("head")), find_all(F.col("sb"), F.col("tail"))
    near = F.filter(F.col("tails"), lambda t: F.exists(F.col("heads"), lambda h: (h < t) & (t - h - F.length("head") <= gap)))
    dots = F.size("parts") > 1
    from_head = F.when(dots & (F.length("head") > 0) & (in_head > 0), back(F.col("heads"), in_head)).otherwise(no)
    from_tail = F.when(dots & (F.length("tail") > 0) & (in_tail > 0), back(F.when(F.length("head") > 0, near).otherwise(F.col("tails")), in_tail)).otherwise(no)
    noted = find_all(F.col("sb"), F.col("old"))
    is_note = (F.length("sc") <= 20) & F.col("sc").rlike("|".join(NOTES))
    note = F.when(is_note & F.size("noted").between(1, most_noted), back(F.col("noted"), F.lit(1))).otherwise(no)
    r = r.withColumns({"inner": inner, "parts": parts, "noted": noted}).withColumns({"head": head, "tail": tail}).withColumns({"heads": heads, "tails": tails})

    def ranked(rank: int, mode: str, places: Column) -> Column:
        return F.transform(places, lambda p: F.struct(F.lit(rank).alias("rank"), F.lit(mode).alias("mode"), p.alias("pos")))

    found = F.concat(*(ranked(n, m, x) for n, (m, x) in enumerate((("exact", exact), ("stripped", strip), ("ellipsis", F.concat(from_head, from_tail)), ("note", note)))))
    keys = ["rec_id", "id", "field", "old", "new"]
    r = r.withColumn("found", found)
    sure = r.select(*keys, F.explode("found").alias("x")).where("x.pos is not null").groupBy(*keys, F.col("x.pos").alias("pos")).agg(F.min_by("x.mode", "x.rank").alias("mode"))
    rest = r.where((F.size("found") == 0) & (first > 0)).select(*keys, "sc", "sb", first.alias("shift"), F.slice("noted", 1, most_noted).alias("noted"), "at")

    def alike(batches):
        for b in batches:
            rows = {k: [] for k in (*keys, "pos", "mode")}
            for x in b.to_pylist():
                got = []
                for p in x["noted"]:
                    start = max(0, p - x["shift"])
                    window = x["sb"][start : start + len(x["sc"])]
                    got.append((difflib.SequenceMatcher(None, x["sc"], window).ratio(), p))
                for q, p in sorted(got, key=lambda g: -g[0])[:most_fuzzy]:
                    if q >= ratio:
                        for k, v in zip(rows, (*(x[k] for k in keys), x["at"][p - 1], "fuzzy"), strict=True):
                            rows[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=list(rows))

    types = dict(records.dtypes)
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    kinds = [*(arrow[types[k]] for k in keys), pa.int32(), pa.string()]
    fuzzy = rest.mapInArrow(alike, ", ".join(f"{k} {types[k]}" for k in keys) + ", pos int, mode string")
    return sure.select(*keys, "mode", "pos").unionByName(fuzzy.select(*keys, "mode", "pos"))


def changes(old: str, new: str, pos: int) -> frozenset[tuple[int, str]]:
    """What an edit does, place by place; an edit that changes the length takes its whole span."""
    if len(old) == len(new):
        return frozenset((pos + k, b) for k, (a, b) in enumerate(zip(old, new, strict=True)) if a != b)
    return frozenset((pos + k, f"{new}/{k}") for k in range(len(old)))


def _assign(options: list[list[tuple]], most: int) -> tuple[list[tuple] | None, str]:
    """One option for each record, so that no two touch a place; accepted if all such choices change the same."""
    solutions: list[list[tuple]] = []
    chosen: list[tuple] = []
    order = sorted(range(len(options)), key=lambda k: len(options[k]))
    steps = [0]

    def go(k: int) -> None:
        if len(solutions) >= most or steps[0] > 50 * most:
            return
        steps[0] += 1
        if k == len(order):
            solutions.append([chosen[order.index(i)] for i in range(len(order))])
            return
        for option in options[order[k]]:
            places = {p for p, _ in option[1]}
            if not any(places & {p for p, _ in c[1]} for c in chosen):
                chosen.append(option)
                go(k + 1)
                chosen.pop()

    go(0)
    if not solutions:
        return None, "conflict"
    done = {frozenset().union(*(o[1] for o in s)) for s in solutions}
    if len(done) > 1 or len(solutions) >= most or steps[0] > 50 * most:
        return None, "ambiguous"
    return solutions[0], "assigned"


def resolve(records: DataFrame, texts: DataFrame, most_solutions: int = 20_000, **ladder) -> DataFrame:
    """``rec_id, id, field, status, mode, pos``: each record's place, if there is one choice for all records of a text.

    ``status``: ``assigned``; ``no place``; ``conflict`` (no choice without two edits at one place); ``ambiguous`` (choices that change
    different things, or ``most_solutions`` and more of them). Edits of one text are weighed together in one task, others apart.
    """
    found = sites(records, texts, **ladder)
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    types = dict(records.dtypes)
    names = ["rec_id", "id", "field"]
    schema = pa.schema([(n, kinds[types[n]]) for n in names] + [("status", pa.string()), ("mode", pa.string()), ("pos", pa.int32())])

    def run(t: pa.Table) -> pa.Table:
        options: dict[object, list[tuple]] = {}
        for x in sorted(t.to_pylist(), key=lambda x: (str(x["rec_id"]), x["pos"], x["old"], x["new"])):
            options.setdefault(x["rec_id"], []).append((x, changes(x["old"], x["new"], x["pos"])))
        got, status = _assign(list(options.values()), most_solutions)
        x = t.slice(0, 1).to_pylist()[0]
        rows = [{"rec_id": k, "id": x["id"], "field": x["field"], "status": status, "mode": got[n][0]["mode"] if got else None, "pos": got[n][0]["pos"] if got else None} for n, k in enumerate(options)]
        return pa.Table.from_pylist(rows, schema)

    each = found.groupBy("id", "field").applyInArrow(run, ", ".join(f"{n} {types[n]}" for n in names) + ", status string, mode string, pos int")
    lost = records.select(*names).distinct().join(found.select("rec_id").distinct(), "rec_id", "left_anti")
    return each.unionByName(lost.select(*names, F.lit("no place").alias("status"), F.lit(None).cast("string").alias("mode"), F.lit(None).cast("int").alias("pos")))


def assertions(before: DataFrame, after: DataFrame, ops: DataFrame, key: str, spots: DataFrame | None = None, expected_rows: int | None = None) -> DataFrame:
    """``name, n_failed, passed`` of the checks of a batch of edits ``key, op_no, old, new`` on ``key, text``.

    ``anchors``: every op's anchor stands in its text once before; ``replay``: the ops turn the texts before into those after;
    ``untouched``: texts without ops are the same; ``rows``: the number of rows is unchanged, or ``expected_rows``; ``balance``: no
    character is lost or gained but by ops; ``spots`` (``key, part, wanted``): parts that must stand in a text after, or must not.
    """
    from plumbline.operators.repair import apply_ops, check_anchors, count_of

    b, a = before.select(key, "text"), after.select(key, F.col("text").alias("_after"))
    anchors = check_anchors(b, ops, key).where(~F.col("valid")).agg(F.count(F.lit(1)).alias("n"))
    replayed = apply_ops(b, ops, key).join(a, key, "full_outer").where(~F.col("text").eqNullSafe(F.col("_after"))).agg(F.count(F.lit(1)).alias("n"))
    calm = b.join(ops.select(key).distinct(), key, "left_anti").join(a, key, "left").where(~F.col("text").eqNullSafe(F.col("_after"))).agg(F.count(F.lit(1)).alias("n"))
    had = b.agg(F.count(F.lit(1)).alias("x"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("y"))
    has = a.agg(F.count(F.lit(1)).alias("z"), F.coalesce(F.sum(F.length("_after")), F.lit(0)).alias("w"))
    both = had.join(F.broadcast(has))  # one row each
    moved = ops.join(b, key).agg(F.coalesce(F.sum(count_of(F.col("text"), F.col("old")) * (F.length(F.coalesce("new", F.lit(""))) - F.length("old"))), F.lit(0)).alias("m"))
    size = both.select(F.abs(F.col("z") - (F.lit(expected_rows) if expected_rows is not None else F.col("x"))).alias("n"))
    balance = both.join(F.broadcast(moved)).select(F.abs(F.col("w") - F.col("y") - F.col("m")).alias("n"))
    checks = [("anchors", anchors), ("replay", replayed), ("untouched", calm), ("rows", size), ("balance", balance)]
    if spots is not None:
        wrong = spots.join(a, key, "left").where(F.coalesce(F.contains("_after", F.col("part")), F.lit(False)) != F.col("wanted"))
        checks.append(("spots", wrong.agg(F.count(F.lit(1)).alias("n"))))
    out = None
    for name, n in checks:
        one = n.select(F.lit(name).alias("name"), F.col("n").cast("bigint").alias("n_failed"), (F.col("n") == 0).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out
