"""A reversible change log: state after last-in-first-out undos, and what each undo took back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window


# The dyadic intervals of which [lo, hi) is made, as in a segment tree: at most two of each length.
_NODES = """flatten(transform(sequence(0, 62), k -> filter(array(
    if(_lo(k) % 2 = 1 and _lo(k) < shiftright(hi, k), named_struct('level', k, 'node', _lo(k)), null),
    if(shiftright(hi, k) % 2 = 1 and _lo(k) + _lo(k) % 2 < shiftright(hi, k), named_struct('level', k, 'node', shiftright(hi, k) - 1), null)), x -> x is not null)))""".replace("_lo(k)", "shiftright(lo + shiftleft(1L, k) - 1, k)")


def undone(effects: DataFrame, undos: DataFrame) -> DataFrame:
    """``effects`` with ``undo_seq``, the undo that took each one back (null if none did).

    ``effects``: ``registry, seq, ...``; ``undos``: ``registry, undo_seq, target_seq``; sequence numbers aren't negative. An undo pops
    everything from the top of its registry's stack down to its target, so the first undo after an effect whose target isn't
    above it takes it back. The interval of each undo is cut into dyadic pieces, of which an effect lies in one of each length;
    they are equi-joined by piece, so that the work grows with the rows and the logarithm of the longest interval only.
    """
    u = undos.select("registry", F.greatest(F.col("target_seq").cast("bigint"), F.lit(0).cast("bigint")).alias("lo"), F.col("undo_seq").cast("bigint").alias("hi")).where("lo < hi")
    nodes = u.select("registry", "hi", F.explode(F.expr(_NODES)).alias("x")).groupBy("registry", "x.level", "x.node").agg(F.min("hi").alias("undo_seq"))
    levels = nodes.select("level").distinct()  # 63 rows at most
    met = effects.select("registry", "seq").distinct().join(F.broadcast(levels)).withColumn("node", F.expr("shiftright(cast(seq as bigint), level)"))
    first = met.join(nodes, ["registry", "level", "node"]).groupBy("registry", "seq").agg(F.min("undo_seq").alias("undo_seq"))
    return effects.join(first, ["registry", "seq"], "left")


def replay(log: DataFrame) -> DataFrame:
    """``registry, seq, effect_id, state, undo_seq`` of each application in a log of applications and rollbacks.

    ``log``: ``registry, seq, op, effect_id, batch_id, guard, undo_guard, protected, forced, guarded, fails``, in order of ``seq``.
    ``op``: ``apply``; ``rollback`` of an effect with all above it; ``rollback_batch``, that of a batch's lowest effect;
    ``rollback_all``, from the top: protected effects stay unless ``forced``, with ``guarded`` those whose ``undo_guard`` is false leave
    the stack undone by none; ``unload`` and ``load``, between which applications are refused unless forced. States: ``APPLIED``,
    ``ROLLED_BACK``, ``SKIPPED`` (refused or left by a guard), ``FAILED``, ``DUPLICATE`` (an id that was applied before). Null flags
    are false, null guards true. A registry's rows pass in order through one task, which keeps its stack and ids.
    """
    cols = ["registry", "seq", "op", "effect_id", "batch_id", "guard", "undo_guard", "protected", "forced", "guarded", "fails"]
    types = dict(log.dtypes)
    ordered = log.select(*cols).where("registry is not null and seq is not null").repartition(F.col("registry")).sortWithinPartitions("registry", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = object()
        stack: list[tuple] = []
        place: dict[object, int] = {}
        out: list[tuple] = []
        unloading = False

        def leave(entry: tuple, state: str, at: int | None) -> None:
            place.pop(entry[1], None)
            out.append((now, entry[0], entry[1], state, at))

        for b in batches:
            for registry, seq, op, effect, batch, guard, undo_guard, protected, forced, guarded, fails in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if registry != now:
                    out += [(now, s[0], s[1], "APPLIED", None) for s in stack]
                    now, stack, place, known, unloading = registry, [], {}, set(), False
                if op == "apply":
                    if unloading and not forced:
                        out.append((now, seq, effect, "SKIPPED", None))
                    elif effect in known:
                        out.append((now, seq, effect, "DUPLICATE", None))
                    elif guard is False and not forced:
                        out.append((now, seq, effect, "SKIPPED", None))
                    elif fails:
                        out.append((now, seq, effect, "FAILED", None))
                    else:
                        known.add(effect)
                        place[effect] = len(stack)
                        stack.append((seq, effect, batch, undo_guard, protected))
                elif op in ("unload", "load"):
                    unloading = op == "unload"
                elif op == "rollback_all":
                    kept = []
                    for entry in reversed(stack):
                        if entry[4] and not forced:
                            kept.append(entry)
                        elif guarded and entry[3] is False:
                            leave(entry, "SKIPPED", seq)
                        else:
                            leave(entry, "ROLLED_BACK", seq)
                    stack = kept[::-1]
                    place = {x[1]: k for k, x in enumerate(stack)}
                else:
                    low = place.get(effect) if op == "rollback" else next((k for k, x in enumerate(stack) if x[2] == batch), None)
                    while low is not None and len(stack) > low:
                        leave(stack.pop(), "ROLLED_BACK", seq)
            if len(out) > 10_000:
                yield _applications(out, schema)
                out = []
        out += [(now, s[0], s[1], "APPLIED", None) for s in stack]
        if out:
            yield _applications(out, schema)

    kinds = {"registry": types["registry"], "seq": types["seq"], "effect_id": types["effect_id"], "state": "string", "undo_seq": types["seq"]}
    ddl = ", ".join(f"{k} {t}" for k, t in kinds.items())
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    return ordered.mapInArrow(run, ddl)


def _applications(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names=schema.names)


def patched(log: DataFrame) -> DataFrame:
    """``key, field, value, position`` of the records that a log leaves; ``position``: the ``seq`` of the addition that a record stands by.

    ``log``: ``key, seq, op, patch`` (map of strings): ``add`` starts a record anew, ``update`` changes the fields of its patch, ``remove``
    takes it away; updates of a record that isn't there do nothing. Fields set to null have no row. No history is collected: of
    each field the last write since the last addition counts.
    """
    base = log.where("op in ('add', 'remove')").groupBy("key").agg(F.max_by(F.struct("op", "seq"), "seq").alias("b")).where("b.op = 'add'").select("key", F.col("b.seq").alias("position"))
    writes = log.where("op in ('add', 'update')").select("key", "seq", F.explode("patch").alias("field", "value")).join(base, "key").where("seq >= position")
    return writes.groupBy("key", "field").agg(F.max_by(F.struct("value"), "seq").alias("v"), F.max("position").alias("position")).select("key", "field", "v.value", "position").where("value is not null")


def state(effects: DataFrame, undos: DataFrame) -> DataFrame:
    """``registry, key, value`` after the whole log; null values are absent keys and have no row.

    ``effects``: ``registry, seq, key, before, after``. Each application writes its after-image; each undo writes the before-images
    of what it takes back, from the top down. The latest write of a key is its value.
    """
    e = undone(effects, undos)
    applied = e.select("registry", "key", F.struct(F.col("seq").alias("at"), F.lit(0).cast("bigint").alias("pos")).alias("ord"), F.col("after").alias("value"))
    back = e.where("undo_seq is not null").select("registry", "key", F.struct(F.col("undo_seq").alias("at"), (-F.col("seq")).alias("pos")).alias("ord"), F.col("before").alias("value"))
    last = applied.unionByName(back).groupBy("registry", "key").agg(F.max_by(F.struct("value"), "ord").alias("v"))
    return last.select("registry", "key", "v.value").where("value is not null")


def recent(log: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last ``n`` entries of each registry, newest first."""
    return log.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("rank") <= n)
