"""The complete turn record: every branch of the combo choice occurs, and its trace says so."""

import re
from collections import Counter

import pytest

from parlance.operators import scoring as S
from parlance.plans import turn_record_queries as TR

from conftest import SF_CHECK


@pytest.fixture(scope="module")
def record(spark):
    return TR.turn_record(spark, SF_CHECK).collect()


def branch(r):
    """How the combo was chosen, by the turn's own inputs."""
    demo = r.shop_id == TR.EMPTY_SHOP
    if r.selected_combo and r.final_combo == r.selected_combo and TR.FALLBACK not in r.phase_trace:
        return "selected"
    if not r.price_intent:
        return "no intent"
    if r.final_combo is None:
        return "nothing found"
    if demo:
        return "demo"
    return "name" if r.content.startswith("giá") else "keyword"


def test_one_record_per_turn_with_many_traces(spark, record):
    events = spark.read.parquet(f"{SF_CHECK}/events.parquet").count()
    assert len(record) == events == len({r.event_id for r in record})
    assert len({r.phase_trace for r in record}) > 20
    assert len({r.task for r in record}) == 2 and len({r.service_type for r in record}) > 2


def test_every_branch_of_the_combo_choice_occurs(record):
    seen = Counter(map(branch, record))
    assert all(seen[b] > 20 for b in ("selected", "no intent", "nothing found", "name", "keyword")), seen
    asked = Counter(r.selected_combo if r.selected_combo in (None, "", "UNKNOWN", "DEMO-02") else "own" for r in record)
    assert all(asked[x] > 20 for x in (None, "", "UNKNOWN", "DEMO-02", "own"))
    # an unknown, empty or missing selection falls back, a demo id is known in shops without products only
    for r in record:
        if r.selected_combo in (None, "", "UNKNOWN") and not r.price_intent:
            assert r.final_combo is None
        if r.selected_combo == "DEMO-02":
            assert (r.final_combo == "DEMO-02") == (r.shop_id == TR.EMPTY_SHOP) or r.price_intent


def test_traces_tell_the_choice(record):
    for r in record:
        lines = r.phase_trace.split(" | ")
        assert lines[lines.index(TR.UPSELL) + 1] == TR.LOAD
        assert (TR.EMPTY in lines) == (r.shop_id == TR.EMPTY_SHOP)
        chosen = [x for x in lines if x.startswith(TR.SELECTED)]
        if branch(r) in ("name", "keyword", "demo"):
            assert chosen == [f"{TR.SELECTED}{r.final_combo} (price={r.final_price})"] and TR.FALLBACK in lines
        else:
            assert not chosen
    assert {(r.final_price is None) == (r.final_combo is None) for r in record} == {True}


def test_requirements_are_part_of_the_match(record):
    assert sum(bool(r.explicit_requirements) for r in record) > 100
    assert sum(bool(r.implicit_requirements) for r in record) > 100


def test_requirement_frames_are_numbers_and_not_lists(spark):
    said = ["size and color", "PRICE? cheap", "hello", None, "quality, quality!", "help error buy"] + ["hi"] * 3
    rows = [(s, 100 * s + i, 60 * i, said[(i + s) % len(said)]) for s in range(3) for i in range(9)]
    df = spark.createDataFrame(rows, "session_id long, msg_id long, ts long, content string")
    out = S.requirement_terms(df, history=4, ttl=100)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or(_said" in plan
    words = lambda x: [w for w in re.split(r"[^\w]+", (x or "").lower()) if w]
    for r in out.collect():
        own = {w for w in words(r.content) if w in S.REQUIREMENT_TERMS}
        near = [w for s, m, _, c in rows if s == r.session_id and r.msg_id - 4 < m < r.msg_id for w in words(c)]
        earlier = {w for w in near if w in S.REQUIREMENT_TERMS}
        implied = {n for n, trig in S.IMPLIED_RULES.items() if (own | earlier) & set(trig)}
        assert r.explicit_requirements == sorted(own)
        assert r.implicit_requirements == sorted((earlier - own) | implied)
        hits = {k: sum(w in terms for w in words(r.content)) for k, terms in S.SERVICE_RULES.items()}
        assert r.service_type == (max(hits, key=hits.get) if any(hits.values()) else "information")


def test_turns_are_matched_from_a_written_frame(spark, monkeypatch):
    written, stored = [], TR.stored
    monkeypatch.setattr(TR, "stored", lambda df, label: written.append(label) or stored(df, label))
    TR.turn_record_frame(spark, SF_CHECK)
    assert "asked-turns" in written
