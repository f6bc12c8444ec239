"""Every core query against its SQL on the smallest tables."""

import datetime
import decimal
import math

import pytest

from plumbline.plans import registry

QUERIES, SQL = registry.load()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    ours = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=str)
    theirs = sorted((tuple(map(norm, r)) for r in duck.sql(f"select {', '.join(f'"{c}"' for c in cols)} from ({SQL[name]})").fetchall()), key=str)
    assert ours == theirs


# What must hold of each row of the queries without SQL, whose results the other tests compare with loops; and of all rows.
HOLDS = {
    "anchor_resolve": lambda r: (r.status == "assigned") == (r.pos is not None), "effect_replay": lambda r: (r.undo_seq is None or r.undo_seq > r.seq) and (r.state != "ROLLED_BACK" or r.undo_seq is not None),
    "batch_dup": lambda r: r.ratio >= 0.7 and r.id != r.similar_to,
    "greedy_match": lambda r: r.a % 2 == 1 and r.b % 2 == 0 and r.cost >= 0, "kb_block_search_bonus": lambda r: r.core_count > 0 and r.score >= 3 and r.rank <= 3, "lru_cache": lambda r: r.hit is not None,
    "near_dup": lambda r: r.id_a < r.id_b and (r.title_ratio >= 0.8 or r.text_ratio >= 0.7), "p4_found": lambda r: r.check_no >= 0 and r.value_milli is not None, "p4_limits": lambda r: r.common_unit is not None and r.value_milli is not None,
    "qa_blocks": lambda r: len(r.question) >= 8 and len(r.answer) >= 20 and 1 <= len(r.tags) <= 5, "quote_metrics": lambda r: r.n_truth >= r.recalled >= r.n_price >= r.price_right and r.pits >= r.pits_hit, "rule_check_paired": lambda r: r.status in ("no checks", "paired", "stricter", "unpaired"),
}
ONCE = {"batch_dup": [("id",)], "greedy_match": [("l_orderkey", "a"), ("l_orderkey", "b")], "near_dup": [("id_a", "id_b")], "p4_limits": [("id", "check_no")], "effect_replay": [("registry", "seq")], "anchor_resolve": [("rec_id",)], "kb_block_search_bonus": [("qid", "rank")], "lru_cache": [("event_type", "event_id")]}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_hold(spark, sf, name):
    got = QUERIES[name](spark, sf).collect()
    assert got and all(map(HOLDS[name], got))
    for key in ONCE.get(name, []):
        assert len({tuple(r[c] for c in key) for r in got}) == len(got)


def test_entry_and_all_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "hybrid_search" in e.queries()
