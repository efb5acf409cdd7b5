"""Titles resolved in rounds against a pass over the rows in order."""

from __future__ import annotations

import random

import pytest

from tidewire.operators import resolve

SCHEMA = "pos int, title string, outlet string, domain string, curated boolean, aggregated boolean, text string, terms array<string>"


def in_order(rows: list[tuple]) -> dict[int, list[int]]:
    """Slots by the position that opened them: positions in the order in which they fill the slot."""
    slots: list[list[int]] = []
    opened: list[int] = []
    leads: list[tuple[bool, bool]] = []
    by_domain: dict = {}
    by_outlet: dict = {}
    newest: dict = {}

    for pos, title, outlet, domain, curated, aggregated, *_ in sorted(rows):
        key = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (title or "").lower()).split())
        d = (key, domain, outlet or "" if aggregated else "") if key and domain else None
        o = (key, outlet) if key and outlet else None

        def lead(slot: int) -> None:
            slots[slot].insert(0, pos)
            leads[slot] = (curated, aggregated)
            if d:
                by_domain[d] = slot

        if d in by_domain and d and not curated:
            slots[by_domain[d]].append(pos)
            continue
        if key in newest and key:
            slot = newest[key]
            if curated and not leads[slot][0] and leads[slot][1]:
                lead(slot)
                if o:
                    by_outlet[o] = slot
                continue
            if leads[slot][0] and not curated and aggregated:
                slots[slot].append(pos)
                continue
        if o and o in by_outlet:
            slot = by_outlet[o]
            if curated and not leads[slot][0]:
                lead(slot)
                continue
            if leads[slot][1] or aggregated:
                if leads[slot][1] and not aggregated:
                    lead(slot)
                else:
                    slots[slot].append(pos)
                continue
        slots.append([pos])
        opened.append(pos)
        leads.append((curated, aggregated))
        if d:
            by_domain[d] = len(slots) - 1
        if o:
            by_outlet[o] = len(slots) - 1
        if key:
            newest[key] = len(slots) - 1
    return dict(zip(opened, slots, strict=True))


@pytest.mark.parametrize("seed", range(4))
def test_resolution_is_that_of_a_pass_in_order(spark, seed):
    draw = random.Random(seed)
    rows = []
    for pos in range(1, 400):
        aggregated = draw.random() < 0.3 * (seed > 0)
        domain = "news.agg.example" if aggregated else draw.choice(["a.org", "b.org", "c.org", "", None])
        rows.append((pos, draw.choice([f"Title {i}" for i in range(30 if seed else 60)] + ["", None, "TITLE, 1!"]), draw.choice(["x", "y", "z", "", None]), domain, draw.random() < 0.2 * (seed > 0), aggregated, draw.choice(["", f"t{pos}"]), [draw.choice("pqr")]))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = resolve.resolve_titles(frame, "pos")
    got: dict[int, list[int]] = {}
    for r in found.orderBy("slot", "rank").collect():
        got.setdefault(r["slot"], []).append(r["pos"])
    want = in_order(rows)
    assert got == want
    by_pos = {r[0]: r for r in rows}
    merged = {r["pos"]: r for r in resolve.resolved(frame, found, "pos", fill=["text"], union=["terms"]).collect()}
    assert merged.keys() == {members[0] for members in want.values()}
    for members in want.values():
        row = merged[members[0]]
        assert row["title"] == by_pos[members[0]][1]
        assert (row["text"] or "") == next((by_pos[p][6] for p in members if by_pos[p][6]), "")
        assert row["terms"] == list(dict.fromkeys(t for p in members for t in by_pos[p][7]))


def test_empty(spark):
    assert resolve.resolve_titles(spark.createDataFrame([], SCHEMA), "pos").count() == 0
