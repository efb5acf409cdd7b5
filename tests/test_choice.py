"""Chosen examples against a plain loop over random libraries."""

from __future__ import annotations

import random

import pytest

from tidewire.functions.text import SENTIMENTS
from tidewire.operators import choice

STORY = "link: string, title: string, terms: array<string>, group: string"
SCHEMA = f"query int, example_id string, score double, item struct<{STORY}>, example struct<{STORY}, include: boolean, label: string>"


def one_story(a: dict, b: dict) -> bool:
    shared = len(set(a["terms"]) & set(b["terms"]))
    small = min(len(a["terms"]), len(b["terms"]))
    return a["link"] == b["link"] or a["title"] == b["title"] or (small >= 5 and shared / max(1, small) >= 0.85)


def plain(item: dict, examples: list[tuple[str, float, dict]], task: str, limit: int) -> list[str]:
    allowed = [e for e in examples if not (item["group"] and item["group"] == e[2]["group"]) and not one_story(item, e[2])]
    if task == "sentiment":
        allowed = [e for e in allowed if e[2]["include"] is not False and e[2]["label"] in SENTIMENTS]
    ranked = sorted(allowed, key=lambda e: (-e[1], e[0]))
    chosen: list[tuple[str, float, dict]] = []
    free = lambda e: all(not one_story(c[2], e[2]) for c in chosen)
    if task == "sentiment":
        for label in reversed(SENTIMENTS):
            first = next((e for e in ranked if e[2]["label"] == label), None)
            if first and len(chosen) < limit and free(first):
                chosen.append(first)
    else:
        for e in [e for e in ranked if e[2]["include"] is False][: min(2, limit // 4)]:
            if free(e):
                chosen.append(e)
    for e in ranked:
        if len(chosen) < limit and e not in chosen and free(e):
            chosen.append(e)
    return [e[0] for e in chosen]


@pytest.mark.parametrize(("task", "limit"), [("sentiment", 7), ("sentiment", 3), ("inclusion", 9), ("inclusion", 3)])
def test_choice_is_that_of_a_loop(spark, task, limit):
    draw = random.Random(limit)
    words = [f"w{i}" for i in range(14)]

    def story(i: int) -> dict:
        return {"link": f"l{draw.randrange(40)}", "title": f"t{draw.randrange(40)}", "terms": draw.sample(words, draw.randrange(1, 7)), "group": draw.choice([None, None, "g1", "g2"])}

    library = [(f"e{i:03}", {**story(i), "include": draw.choice([True, True, False]), "label": draw.choice([*SENTIMENTS, None, "odd"])}) for i in range(70)]
    rows, want = [], {}
    for query in range(12):
        item = story(query)
        near = [(id_, round(draw.choice([0.1, 0.25, 0.5, 1.0]), 2), e) for id_, e in library if draw.random() < 0.6]
        rows += [(query, id_, score, item, e) for id_, score, e in near]
        want[query] = plain(item, near, task, limit)
    pairs = choice.eligible(spark.createDataFrame(rows, SCHEMA).repartition(3), task)
    found: dict[int, list[str]] = {q: [] for q in want}
    for r in choice.choose(pairs, task, limit).orderBy("query", "turn").collect():
        found[r["query"]].append(r["example_id"])
    assert found == want and any(len(x) == limit for x in want.values())


def test_no_pairs(spark):
    assert choice.choose(choice.eligible(spark.createDataFrame([], SCHEMA), "sentiment"), "sentiment", 4).count() == 0
