"""Searches for one common term open only the classes of equal score that they need."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from haltline.operators import search
from haltline.operators.search import search_stops
from haltline.schema import Timetable


def test_a_common_term_scores_what_it_answers(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for n in range(1500):
        words = ["halt"] * rng.choice([1, 1, 1, 2]) + [rng.choice(["oost", "west", "dorp"]) for _ in range(rng.randrange(3))]
        rng.shuffle(words)
        rows.append((f"s{n:04d}", None, " ".join(words) + rng.choice(["", f" {n % 7}"]), 1.0, 1.0, 0, None, None))
    stops = spark.createDataFrame(
        rows,
        "stop_id string, code string, name string, latitude double, longitude double, location_type int, "
        "parent_stop_id string, platform_code string",
    )
    empty = spark.createDataFrame([], "x int")
    timetable = Timetable(empty, stops, *[empty] * 8)
    asked = [(1, "halt", 5), (2, "halt", 40), (3, "oost", 7), (4, "hal", 3), (5, "halt oost", 6), (6, "nowhere", 5)]
    opened = []
    whole = search._single_term_scores

    def counted(*args):
        opened.append(whole(*args))
        return opened[-1]

    monkeypatch.setattr(search, "_single_term_scores", counted)
    requests = spark.createDataFrame(asked, "request_id long, query string, limit int")
    got = {}
    for row in search_stops(timetable, requests).collect():
        got.setdefault(row.request_id, []).append((row["rank"], row.stop_id, row.score))
    tokens = {row[0]: row[2].split() for row in rows}
    average = sum(map(len, tokens.values())) / len(rows)
    for number, query, limit in asked:
        scores = dict.fromkeys(tokens, 0.0)
        for term in query.split():
            tf = {i: sum(word.startswith(term) for word in words) for i, words in tokens.items()}
            df = sum(n > 0 for n in tf.values())
            idf = max(math.log((len(rows) - df + 0.5) / (df + 0.5)), 1e-6)
            for i, n in tf.items():
                norm = 1.2 * (1 - 0.75 + 0.75 * len(tokens[i]) / average)
                scores[i] = scores[i] + idf * n * 2.2 / (n + norm) if n and scores[i] is not None else None
        names = {row[0]: row[2] for row in rows}
        hits = [(-round(score, 9), names[i], i) for i, score in scores.items() if score is not None]
        want = [(place + 1, i) for place, (_, _, i) in enumerate(sorted(hits)[:limit])]
        assert [one[:2] for one in sorted(got.get(number, []))] == want, query
    counts = {row["query"]: row["count"] for row in opened[0].groupBy("query").count().collect()}
    # A class gives no more than the limit, and the last class is the only one with more than needed.
    assert counts["halt"] <= 2 * 40 and counts["hal"] <= 2 * 3 and counts["oost"] <= 2 * 7


def test_phrases_are_found_by_their_rarest_token(spark):
    rows = [(f"s{n}", f"Halt {n}-{n % 5}") for n in range(400)] + [("x", "Pier 7-1 7-12 halt"), ("y", "7 Quay 1")]
    stops = spark.createDataFrame(rows, "stop_id string, name string").withColumn("code", F.lit(None).cast("string"))
    terms = spark.createDataFrame(
        [(f"{n}-1", [str(n), "1"]) for n in range(400)] + [("7-1-7", ["7", "1", "7"]), ("no-1", ["no", "1"])],
        "term string, tokens array<string>",
    )
    tokens = search.stop_tokens(stops)
    found = {(row.term, row.stop_id): row.tf for row in search._term_hits(terms, tokens).collect()}
    phrases = {(f"{n}-1", f"s{n}"): 1 for n in range(400) if n % 5 == 1}
    assert found == phrases | {("7-1", "x"): 2, ("7-1-7", "x"): 1}


def test_common_tokens_of_phrases_are_not_listed_for_every_phrase(spark, monkeypatch):
    stops = spark.range(300).select(
        F.concat(F.lit("s"), "id").alias("stop_id"),
        F.concat(F.lit("Halt "), "id", F.lit("-1")).alias("name"),
        F.lit(None).cast("string").alias("code"),
    )
    terms = spark.range(300).select(
        F.concat("id", F.lit("-1")).alias("term"), F.array(F.col("id").cast("string"), F.lit("1")).alias("tokens")
    )
    kept, cut = [], search.cut_lineage
    monkeypatch.setattr(search, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    assert search._term_hits(terms, search.stop_tokens(stops)).count() == 300
    # Each phrase starts from its number, which occurs once, and not from the 1 of all stops.
    assert {row.nth for row in kept[0].collect()} == {0}
