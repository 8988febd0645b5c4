"""Full-text search over stop names and codes with BM25 scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haltline.functions import fold_text, search_terms
from haltline.operators.ranking import first_per_group, with_limits
from haltline.operators.requests import valid_requests
from haltline.operators.stops import stop_view
from haltline.schema import STOP_COLUMNS, Timetable
from haltline.session import cut_lineage

K1, B = 1.2, 0.75
MIN_IDF = 1e-6
SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(fold_text(text), SEPARATORS), lambda token: token != "")


def stop_tokens(stops: DataFrame) -> DataFrame:
    """(stop_id, field, position, token) for name and code."""
    fields = F.explode(
        F.array(
            F.struct(F.lit("name").alias("field"), _tokens(F.col("name")).alias("tokens")),
            F.struct(
                F.lit("code").alias("field"),
                _tokens(F.coalesce("code", F.lit(""))).alias("tokens"),
            ),
        )
    )
    return stops.select("stop_id", fields.alias("f")).select(
        "stop_id",
        F.col("f.field").alias("field"),
        F.posexplode("f.tokens").alias("position", "token"),
    )


def _query_terms(queries: DataFrame) -> DataFrame:
    """(query, term, times, tokens): each distinct term of a query with its tokens."""
    return (
        queries.select("query", F.explode(search_terms(fold_text(F.col("query")))).alias("term"))
        .groupBy("query", "term")
        .agg(F.count(F.lit(1)).alias("times"))
        .withColumn("tokens", _tokens(F.col("term")))
    )


def _term_hits(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """(term, stop_id, tf): how often each term occurs in each stop.

    A term is a run of consecutive tokens in one field, the last one a prefix. Prefixes are
    listed for the vocabulary, not for every occurrence, and met by equality. Of a longer term only the token that
    occurs least is looked for; the others are looked up where they would have to stand, since thousands of terms
    may share a token that a third of all stops have.
    """
    at = F.posexplode("tokens").alias("nth", "piece")
    distinct = terms.select("term", "tokens").distinct()
    wanted = distinct.select("term", "tokens", at)
    is_last = F.col("nth") == F.size("tokens") - 1
    vocabulary = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    prefixes = vocabulary.withColumn(
        "piece",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("token")),
                lambda n: F.substring(F.col("token"), F.lit(1), n),
            )
        ),
    )
    whole_sizes = vocabulary.select(F.col("token").alias("piece"), F.lit(False).alias("last"), "n")
    last_sizes = prefixes.groupBy("piece").agg(F.sum("n").alias("n")).select("piece", F.lit(True).alias("last"), "n")
    sized = wanted.withColumn("last", is_last).join(
        whole_sizes.unionByName(last_sizes).hint("merge"), ["piece", "last"], "left"
    )
    # A token that occurs nowhere counts 0 and is the rarest, so its term is not looked for at all.
    rarest = sized.groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "nth")).alias("rarest"))
    anchors = cut_lineage(
        rarest.filter(F.col("rarest.n") > 0)
        .select("term", F.col("rarest.nth").alias("nth"))
        .join(distinct, "term")
        .withColumn("piece", F.element_at("tokens", F.col("nth") + 1))
    )
    whole = anchors.filter(~is_last).withColumn("token", F.col("piece"))
    last = anchors.filter(is_last).join(prefixes.drop("n").hint("merge"), "piece")
    columns = ["term", "tokens", "nth", "token"]
    starts = tokens.join(whole.select(*columns).unionByName(last.select(*columns)), "token").select(
        "term", "tokens", "nth", "stop_id", "field", (F.col("position") - F.col("nth")).alias("start")
    )
    others = (
        starts.filter((F.size("tokens") > 1) & (F.col("start") >= 0))
        .withColumnRenamed("nth", "anchor")
        .select("term", "tokens", "stop_id", "field", "start", "anchor", at)
        .filter(F.col("nth") != F.col("anchor"))
        .withColumn("position", F.col("start") + F.col("nth"))
        .join(tokens.hint("merge"), ["stop_id", "field", "position"])
        .filter(F.when(is_last, F.startswith("token", "piece")).otherwise(F.col("token") == F.col("piece")))
        .groupBy("term", "stop_id", "field", "start")
        .agg(F.count(F.lit(1)).alias("matched"), F.first(F.size("tokens")).alias("length"))
        .filter(F.col("matched") == F.col("length") - 1)
    )
    alone = starts.filter(F.size("tokens") == 1)
    found = alone.select("term", "stop_id").unionByName(others.select("term", "stop_id"))
    return found.groupBy("term", "stop_id").agg(F.count(F.lit(1)).alias("tf"))


def _gain() -> Column:
    """BM25 of one term in one stop."""
    tf, length = F.col("tf"), F.col("length") / F.col("average")
    return F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))


def _single_term_scores(
    asked: DataFrame, postings: DataFrame, limits: DataFrame, largest: int
) -> DataFrame:
    """(query, stop_id, score) that hold the first `limit` stops of queries of one term.

    Stops with the same (tf, length) have the same score, so only these classes are scored. They are opened from the
    best score down until they hold enough stops, and a class gives no more than its first stops by name.
    postings(term, stop_id, tf, length, name), asked(query, term, times, idf, average).
    """
    kind = ["term", "tf", "length"]
    classes = postings.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"))
    scored = (
        asked.join(classes, "term")
        .withColumn("score", F.round(_gain(), 9))
        .join(limits, "query")
    )
    levels = scored.groupBy("query", "limit", "score").agg(F.sum("n").alias("n"))
    better = Window.partitionBy("query").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    opened = levels.withColumn("before", F.coalesce(F.sum("n").over(better), F.lit(0))).filter(
        F.col("before") < F.col("limit")
    )
    wanted = scored.join(opened.select("query", "score"), ["query", "score"]).select("query", "limit", "score", *kind)
    members = first_per_group(
        postings.join(wanted.select(*kind).distinct(), kind, "left_semi"), kind, ["name", "stop_id"], largest
    )
    found = wanted.join(members.select(*kind, "stop_id", "rank"), kind).filter(F.col("rank") <= F.col("limit"))
    return found.select("query", "stop_id", "score")


def search_stops(timetable: Timetable, requests: DataFrame) -> DataFrame:
    """requests(request_id, query, limit): stops where every term of the query occurs.

    Ordered by BM25, then name, then id. Each distinct query is answered once: of one term, classes of equal
    score are opened from the best down; of several terms, the rarest lists the candidates and the others
    are looked up for those only.
    """
    requests, largest = with_limits(valid_requests(requests, "search_stops"))
    stops = stop_view(timetable.stops)
    tokens = stop_tokens(stops)
    queries = requests.select("query").distinct()
    terms = _query_terms(queries)
    # Counted, scanned for candidates and looked up below: found once, written once.
    hits = cut_lineage(_term_hits(terms, tokens))
    document_frequency = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n_stops = stops.agg(F.count(F.lit(1))).scalar()
    n_tokens = tokens.agg(F.count(F.lit(1))).scalar()
    idf = F.log((n_stops - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = (
        terms.select("query", "term", "times")
        .join(document_frequency, "term", "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .withColumn("idf", F.greatest(idf, F.lit(MIN_IDF)))
        .withColumn("average", n_tokens / n_stops)
    )
    plans = weighted.groupBy("query").agg(
        F.count(F.lit(1)).alias("n_terms"), F.min(F.struct("df", "term")).alias("rarest")
    )
    plans = plans.filter(F.col("rarest.df") > 0).select(
        "query", "n_terms", F.col("rarest.term").alias("term")
    )
    lengths = tokens.groupBy("stop_id").agg(F.count(F.lit(1)).alias("length"))
    alone = _single_term_scores(
        plans.filter("n_terms = 1").select("query", "term").join(weighted, ["query", "term"]),
        hits.join(lengths.hint("merge"), "stop_id").join(stops.select("stop_id", "name").hint("merge"), "stop_id"),
        requests.groupBy("query").agg(F.max("limit").alias("limit")),
        largest,
    )
    candidates = plans.filter("n_terms > 1").join(hits.select("term", "stop_id"), "term").select(
        "query", "n_terms", "stop_id"
    )
    together = (
        candidates.join(weighted.select("query", "term", "times", "idf", "average"), "query")
        .join(hits, ["term", "stop_id"])
        .join(lengths.hint("merge"), "stop_id")
        .withColumn("gain", _gain())
        .groupBy("query", "stop_id")
        .agg(
            F.sum("gain").alias("score"),
            F.count(F.lit(1)).alias("found"),
            F.first("n_terms").alias("n_terms"),
        )
        .filter(F.col("found") == F.col("n_terms"))
        .select("query", "stop_id", F.round("score", 9).alias("score"))
    )
    scores = together.unionByName(alone)
    best = first_per_group(
        scores.join(stops.hint("merge"), "stop_id"), ["query"], [F.desc("score"), "name", "stop_id"], largest
    )
    return (
        requests.join(best, "query")
        .filter(F.col("rank") <= F.col("limit"))
        .select("request_id", "rank", *STOP_COLUMNS, "score")
    )
