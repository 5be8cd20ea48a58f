"""What stands around a request: limits, checks of a model's questions, a model's JSON, the library page.  All native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.search import filtered, parse_search
from quire.plans.views import Views

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?\s*$"
NAME = "^[A-Za-z0-9_.-]{1,100}$"
MOST_QUESTIONS, MOST_OPTIONS = 64, 255
LIBRARY_LIMIT, PALETTE_LIMIT = 200, 8


def clamped(value: Column, default: int, most: int = 100) -> Column:
    """A limit as a request gives it: a positive whole number, at most ``most``; anything else is the default."""
    n = F.when(value.rlike(NUMBER), F.trim(value).try_cast("double"))
    return F.when((n > 0) & (n == F.floor(n)), F.least(n, F.lit(float(most))).cast("long")).otherwise(F.lit(default).cast("long"))


def question_problems(questions: DataFrame) -> DataFrame:
    """(request_id, questions, problem): the first thing wrong with a request's questions in their order, or null.

    ``questions`` has (request_id, place, question_id, kind, instructions, options); only a choice has options.
    One partial aggregation by request: a request that asks too much is counted, not gathered.
    """
    options = F.coalesce("options", F.array().cast("array<string>"))
    choice = F.col("kind") == "choice"
    problem = (
        F.when(~F.coalesce(F.col("question_id").rlike(NAME), F.lit(False)), "question id")
        .when(~F.coalesce(F.col("instructions").rlike(r"\S"), F.lit(False)), "instructions")
        .when(choice & ~F.size(options).between(2, MOST_OPTIONS), "options")
        .when(choice & F.exists(options, lambda o: ~F.coalesce(o.rlike(NAME), F.lit(False))), "option id")
    )
    checked = questions.select("request_id", "place", problem.alias("problem"))
    asked = checked.groupBy("request_id").agg(F.count("*").alias("questions"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("place"))).alias("first"))
    return asked.select("request_id", "questions", F.when(F.col("questions") > MOST_QUESTIONS, "count").otherwise(F.col("first")).alias("problem"))


def unfenced(reply: Column) -> Column:
    """The JSON of a model's reply, which may stand in a code fence; null if it is none."""
    blank = r"[\s ﻿]"
    bare = F.regexp_replace(F.regexp_replace(reply, f"^{blank}+|{blank}+$", ""), r"^```(?:json)?\s*|\s*```$", "")
    return F.try_parse_json(bare)


def library(v: Views, text: str, limit: int = LIBRARY_LIMIT) -> DataFrame:
    """The library page of every user at once, for a search by filters: starred links only, newest starred first."""
    q = parse_search(text)
    q.states = list(dict.fromkeys([*q.states, "ref"]))
    return newest(filtered(v, q), F.coalesce("starred_at", "saved_at"), limit)


def palette(v: Views, text: str, limit: int = PALETTE_LIMIT) -> DataFrame:
    """The few newest links of every user that pass a search by filters."""
    return newest(filtered(v, parse_search(text)), F.col("saved_at"), limit)


def newest(links: DataFrame, stamp: Column, limit: int) -> DataFrame:
    """(user_id, place, link_id) of each user's newest; ties by the greater id."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(stamp.desc(), F.desc("link_id"))).cast("long")
    return links.select("user_id", "link_id", place.alias("place")).where(F.col("place") <= limit)


def categorized_users(v: Views) -> DataFrame:
    """Users who have categories."""
    return v.item_categories.select("user_id").distinct()
