"""Attribution of words to people."""

from __future__ import annotations

from datetime import date, datetime

import pytest

from pyspark.sql import functions as F

from tidewire.operators import quotes

BRAND = r"(?i)\b(?:acme\s+(?:health|mutual)(?:\s+of\s+Northland)?)(?:['’]s)?"
PEOPLE = [
    ("Ada Lovell", ["Ada B. Lovell"], "President", date(2026, 1, 10), None),
    ("Ron Gadd", [], "Former president", None, date(2026, 1, 10)),
    ("Mia Torres", ["Mia Torrez"], "Spokesperson", None, None),
]
SCHEMA = "name string, aliases array<string>, title string, since date, until date"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, SCHEMA).cache()


CASES = {
    "Ada Lovell said premiums would fall.": ["Ada Lovell"],
    "Mia Torres, a spokesperson for Acme Health of Northland, wrote on Thursday that it pays.": ["Mia Torres"],
    "“It worked,” Mia Torres, the insurer’s press officer, told the board.": ["Mia Torres"],
    "Prices go up, according to Ada Lovell.": ["Ada Lovell"],
    "“We will recover,” said Mia Torres, the press officer.": ["Mia Torres"],
    "It is late. Acme Health spokesperson Mia Torrez declined to answer.": ["Mia Torres"],
    "It helps everyone.” Ada Lovell, President and CEO of Acme Health of Northland, described the law.": ["Ada Lovell"],
    "Ada B. Lovell later said the plan holds.": ["Ada Lovell"],
    "Ada Lovell leads the insurer. Lovell said costs must fall.": ["Ada Lovell"],
    "Lovell said costs must fall.": [],
    "Ada Lovell leads the insurer. Jane Lovell said costs must fall.": [],
    "Ada Lovell, President of Acme Health, took over on Saturday.": [],
    "The board said Mia Torres was hired in 2019.": [],
    "Lawmakers told Ada Lovell they were worried.": [],
    "Fairview Mayor Ada Lovell said the budget passed.": [],
    "Ada Lovell, a nurse at Fairview Hospital, said staff is short.": [],
    "“We are short,” said Mia Torres of the Northland Nurses.": [],
    "“We are short,” said Ada Lovell, mayor of Fairview.": [],
    "": [],
}


def test_attribution(spark, people):
    rows = [(i, text, None, datetime(2026, 3, 1)) for i, text in enumerate(CASES)]
    found = quotes.quoted_people(spark.createDataFrame(rows, "id int, a string, b string, at timestamp"), people, "id", ["a", "b"], "at", BRAND).collect()
    got = {text: sorted(r["name"] for r in found if r["id"] == i) for i, text in enumerate(CASES)}
    assert got == CASES


def test_roles_and_stored_names(spark, people):
    rows = [(1, "Ron Gadd said so.", datetime(2025, 6, 1), []), (2, "Ron Gadd said so.", datetime(2026, 2, 1), []), (3, "Ada Lovell said so.", None, []), (4, "Mia Torres said so.", None, []), (5, None, datetime(2026, 2, 1), ["Ada Lovell", "Ron Gadd"])]
    frame = spark.createDataFrame(rows, "id int, a string, at timestamp, kept array<string>")
    found = quotes.quoted_people(frame, people, "id", ["a"], "at", stored="kept")
    assert sorted((r["id"], r["name"]) for r in found.collect()) == [(1, "Ron Gadd"), (4, "Mia Torres"), (5, "Ada Lovell")]
    assert {r["name"] for r in quotes.titles(found).collect()} == {"Ron Gadd", "Mia Torres", "Ada Lovell"}


def test_patterns_are_matched_on_held_names_alone(spark):
    """Only where a text holds a name is a pattern matched, and rows of one file are spread before that."""
    rows = spark.createDataFrame([(1, "Ann Lee said so.")], "id int, text string").withColumn("at", F.lit(None).cast("timestamp"))
    people = spark.createDataFrame([("Ann Lee", [], "Head")], "name string, aliases array<string>, title string").select("*", F.lit(None).cast("date").alias("since"), F.lit(None).cast("date").alias("until"))
    found = quotes.quoted_people(rows, people, "id", ["text"], "at")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    condition = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert condition.index("Contains(") < condition.index("RLIKE")
    assert "RepartitionByExpression" in plan
    assert [tuple(r) for r in found.collect()] == [(1, "Ann Lee", "Head")]
