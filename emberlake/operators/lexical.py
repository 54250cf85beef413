"""Full-text retrieval: all query tokens must occur; the best-scoring entry wins.

A query's candidates are the entries that hold its rarest token, found by one
equi-join on that token; the other tokens are checked on the candidates alone.
So a frequent word never brings its whole posting list into a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlake.functions.text import tokens
from emberlake.sources.tables import fits_broadcast, staged
from emberlake.sources.text_index import DISTANCE, TextIndex, left_out

SCORERS = ("BM25", "BM25STD", "TFIDF", "TFIDF.DOCNORM", "DISMAX", "DOCSCORE")
K1, B = 1.2, 0.75


def lexical_index(entries: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """Entries as (id, words, kept columns): lower-cased tokens in order."""
    return entries.select(F.col(id_col).alias("entry_id"), F.transform(tokens(F.col(text_col)), F.lower).alias("words"), *keep)


def query_words(queries: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    return queries.select(F.col(id_col).alias("query_id"), F.array_distinct(F.transform(tokens(F.col(text_col)), F.lower)).alias("asked"), *keep)


def document_frequency(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(token, df) of the asked tokens over the whole index."""
    wanted = asked.select(F.explode("asked").alias("token")).distinct()
    held = index.select(F.explode(F.array_distinct("words")).alias("token")).join(wanted, "token", "left_semi")
    return held.groupBy("token").agg(F.count("*").alias("df"))


def term_score(scorer: str, tf: Column, df: Column, n: Column, length: Column, mean: Column) -> Column:
    """The published Okapi form for BM25; plain tf-idf sums for the others."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    forms = {
        "BM25": idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)),
        "TFIDF": tf * idf,
        "TFIDF.DOCNORM": tf * idf / length,
        "DISMAX": tf.cast("double"),
        "DOCSCORE": F.lit(0.0),
    }
    forms["BM25STD"] = forms["BM25"]
    if scorer not in forms:
        raise ValueError(f"scorer must be one of {SCORERS}, not {scorer!r}")
    return forms[scorer]


def lexical_matches(index: DataFrame, asked: DataFrame, scorer: str = "BM25", on: tuple[str, ...] = ()) -> DataFrame:
    """All (query_id, entry_id, score) where the entry holds every query token.

    ``on`` names scope columns both sides share. Queries without tokens match nothing.
    """
    if scorer not in SCORERS:
        raise ValueError(f"scorer must be one of {SCORERS}, not {scorer!r}")
    df = document_frequency(index, asked)
    terms = asked.select("query_id", "asked", *on, F.explode("asked").alias("token")).join(df, "token")
    own = terms.groupBy("query_id", "asked", *on).agg(F.collect_list(F.struct("token", "df")).alias("terms"), F.min(F.struct("df", "token"))["token"].alias("token"))
    own = own.where(F.size("terms") == F.size("asked"))  # a token that no entry holds rules the query out
    rare = own.select("token").distinct()
    postings = index.select("entry_id", "words", *on, F.explode(F.array_distinct("words")).alias("token")).join(rare, "token", "left_semi")
    stats = index.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    found = postings.join(own, ["token", *on]).where(F.size(F.array_except("asked", "words")) == 0).crossJoin(F.broadcast(stats))  # one row
    tf = lambda t: F.size(F.filter("words", lambda w: w == t["token"]))
    parts = F.transform("terms", lambda t: term_score(scorer, tf(t), t["df"], F.col("n"), F.size("words"), F.col("mean")))
    total = F.lit(1.0) if scorer == "DOCSCORE" else F.aggregate(F.array_sort(parts), F.lit(0.0), lambda s, x: s + x)
    return found.select("query_id", "entry_id", F.round(total, 6).alias("score"))


def best_match(matches: DataFrame, min_score: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """The best entry of each query (of each value of ``by`` too) at or above ``min_score``; ties go to the smaller id."""
    turn = F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "entry_id"))
    return matches.withColumn("turn", turn).where((F.col("turn") == 1) & (F.col("score") >= min_score)).drop("turn")


def _once(asked: DataFrame, scoped: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Queries of the same tokens (and scope) as one, under the least of their ids; and each query's id with that one's as ``asker``."""
    named = staged(asked.select("query_id", F.array_sort("asked").alias("asked"), *scoped))
    ones = named.groupBy("asked", *scoped).agg(F.min("query_id").alias("asker"))
    same = [named[c].eqNullSafe(ones[c]) for c in ("asked", *scoped)]
    members = staged(named.join(ones, same).select(named["query_id"], "asker"))
    firsts = members.where("query_id = asker").select("query_id")
    return named.join(firsts, "query_id", "left_semi"), members


def _each(found: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of the queries that were asked, for every query that is the same."""
    columns = found.columns
    return members.join(found.withColumnRenamed("query_id", "asker"), "asker").select(*columns)


def indexed_best(index: TextIndex, asked: DataFrame, scorer: str = "BM25", min_score: float = 0.0, by: tuple[str, ...] = (), scoped: tuple[str, ...] = (), live: DataFrame | None = None) -> DataFrame:
    """The best entry of each query (query_id, asked) that holds all its tokens, read off a stored index.

    A query's candidates are the blocks of its rarest token. Its best block is
    scored first; of the others only those are read whose bound (what the
    block, and the other tokens at their best, can add) reaches the score found.
    ``by`` gives the best of each value of columns that the index keeps;
    ``scoped`` names such columns that queries have too and must share;
    ``live`` has the ids of the entries that count (all, if not given).
    Equal queries are searched for once. Between tasks go ids, and each entry's
    words once; a pair of query and entry is put together where it is scored.
    """
    if scorer not in SCORERS:
        raise ValueError(f"scorer must be one of {SCORERS}, not {scorer!r}")
    asked, members = _once(asked, scoped)
    forward = index.table("forward") if live is None else index.table("forward").join(live.select("entry_id"), "entry_id", "left_semi")
    stats = forward.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    n, mean = F.lit(int(stats["n"])), F.lit(float(stats["mean"] or 0.0))
    vocabulary = index.vocabulary()
    if live is not None:  # counts of the stored tokens hold for all entries ever written
        words = asked.select(F.explode("asked").alias("token")).distinct().join(vocabulary, "token").select("word")
        held = forward.select(F.explode("words").alias("word")).join(words, "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
        vocabulary = vocabulary.drop("df").join(held, "word")
    terms = asked.select("query_id", F.size("asked").alias("wanted"), F.explode("asked").alias("token")).join(vocabulary, "token")
    bound = F.lit(1.0) if scorer == "DOCSCORE" else term_score(scorer, F.col("max_tf"), F.col("df"), n, F.col("min_length"), mean)
    own = terms.withColumn("bound", bound).groupBy("query_id", "wanted").agg(
        F.collect_list(F.struct("word", "df")).alias("terms"), F.min(F.struct("df", "word"))["word"].alias("word"),
        F.min(F.struct("df", "word"))["df"].alias("rare_df"), F.sum("bound").alias("most"), F.min_by("bound", F.struct("df", "word")).alias("rare_bound"),
    )
    own = staged(own.where(F.size("terms") == F.col("wanted")).join(asked.select("query_id", *scoped), "query_id"))  # a token that no entry holds rules a query out
    blocks = index.table("postings").join(own.select("query_id", "word", "rare_df", "most", "rare_bound"), "word")
    if scorer == "DOCSCORE":
        reach = F.lit(1.0)
    else:
        reach = F.col("most") - F.col("rare_bound") + term_score(scorer, F.col("max_tf"), F.col("rare_df"), n, F.col("min_length"), mean)
    blocks = staged(blocks.select("query_id", "ids", "block", "spot", (reach + 1e-6).alias("reach")))

    terms_of = own.select("query_id", "terms", *[F.col(c).alias(f"own_{c}") for c in scoped])
    facts = forward.select("entry_id", "length", "words", "tfs", *by, *[c for c in scoped if c not in by])
    small = fits_broadcast(own)

    def scored(chosen: DataFrame) -> DataFrame:
        # A query's terms come last where they are broadcast, else with its blocks: never with each pair's words through a shuffle.
        chosen = chosen.select("query_id", "ids") if small else chosen.select("query_id", "ids").join(terms_of, "query_id")
        held = chosen.withColumn("entry_id", F.explode("ids")).drop("ids").join(facts, "entry_id")
        if small:
            held = held.join(F.broadcast(terms_of), "query_id")
        for c in scoped:
            held = held.where(F.col(c) == F.col(f"own_{c}"))
        numbers = F.col("terms.word")
        held = held.where(F.size(F.array_intersect(numbers, "words")) == F.size("terms"))
        tf = lambda t: F.get("tfs", F.array_position("words", t["word"]).cast("int") - 1)
        parts = F.transform("terms", lambda t: term_score(scorer, tf(t), t["df"], n, F.col("length"), mean))
        total = F.lit(1.0) if scorer == "DOCSCORE" else F.aggregate(F.array_sort(parts), F.lit(0.0), lambda s, x: s + x)
        return held.select("query_id", "entry_id", *by, F.round(total, 6).alias("score"))

    if by:  # every value of ``by`` has a best of its own: no bound of one query rules a block out
        return _each(best_match(scored(blocks), min_score, by), members)
    first = staged(best_match(scored(blocks.where("block = 0")), min_score))
    more = blocks.where("block > 0").join(first.select("query_id", F.col("score").alias("reached")), "query_id", "left")
    more = scored(more.where((F.col("reach") >= min_score) & (F.col("reached").isNull() | (F.col("reach") >= F.col("reached")))))
    return _each(best_match(first.unionByName(more.select(*first.columns)), min_score), members)


def indexed_fuzzy(index: TextIndex, asked: DataFrame, distance: int = 1, scoped: tuple[str, ...] = (), live: DataFrame | None = None) -> DataFrame:
    """(query_id, entry_id, score) as ``fuzzy_matches`` gives them, read off a stored index.

    Near tokens meet in the stored spelling index; numbers alone go through
    the joins. For a distance over the stored one the spelling table is made here.
    """
    if distance not in (1, 2, 3):
        raise ValueError("distance must be 1, 2 or 3")
    asked, members = _once(asked, scoped)
    deletes = index.table("deletes")
    if distance > DISTANCE:
        deletes = index.vocabulary().select("token", "word", "df", F.explode(left_out(F.col("token"), distance)).alias("variant"))
    wanted = asked.select(F.explode("asked").alias("t")).distinct().select("t", F.explode(left_out(F.col("t"), distance)).alias("variant"))
    close = deletes.join(wanted, "variant").groupBy("t", "token", "word").agg(F.max("df").alias("df"))
    close = close.withColumn("edits", F.levenshtein("t", "token", distance)).where(F.col("edits") >= 0)
    spelled = close.groupBy("t").agg(F.sum("df").alias("spread"), F.collect_list(F.struct("word", "edits")).alias("near"))
    terms = asked.select("query_id", F.size("asked").alias("n"), F.explode("asked").alias("t")).join(spelled, "t")
    whole = terms.groupBy("query_id", "n").agg(F.collect_list("near").alias("groups"), F.min_by("near", F.struct("spread", "t")).alias("rare"))
    whole = staged(whole.where(F.size("groups") == F.col("n")).join(asked.select("query_id", *scoped), "query_id"))
    keys = whole.select("query_id", F.explode("rare.word").alias("word"))
    found = index.table("postings").join(keys, "word").select("query_id", F.explode("ids").alias("entry_id")).distinct()
    forward = index.table("forward").select("entry_id", "words", *scoped)
    if live is not None:
        forward = forward.join(live.select("entry_id"), "entry_id", "left_semi")
    groups = whole.select("query_id", "groups", *[F.col(c).alias(f"own_{c}") for c in scoped])
    found = found.join(forward, "entry_id").join(groups, "query_id")
    for c in scoped:
        found = found.where(F.col(c) == F.col(f"own_{c}"))
    # The few near words that an entry holds, found once by hash; groups are checked against them alone.
    near = F.flatten(F.transform("groups", lambda g: F.transform(g, lambda x: x["word"])))
    least = lambda held: F.transform("groups", lambda g: F.array_min(F.transform(F.filter(g, lambda x: F.array_contains(held, x["word"])), lambda x: x["edits"])))
    bound = F.transform(F.array(F.array_intersect(near, F.col("words"))), least)[0]  # in a lambda's variable: not once for each near word
    scored = found.select("query_id", "entry_id", bound.alias("least")).where(~F.exists("least", lambda x: x.isNull()))
    total = F.aggregate("least", F.lit(0.0), lambda s, x: s + 1 / (1 + x))
    return _each(scored.select("query_id", "entry_id", F.round(total, 6).alias("score")), members)


def _variants(token: Column, distance: int) -> Column:
    """The token and all it becomes by leaving out up to ``distance`` characters."""
    shorter = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    out = F.array(token)
    for _ in range(distance):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, shorter))))
    return out


def fuzzy_matches(index: DataFrame, asked: DataFrame, distance: int = 1) -> DataFrame:
    """(query_id, entry_id, score) where every query token is within ``distance`` edits of one of the entry's.

    Near tokens are found by an equi-join on deletion variants, then checked
    with the edit distance. The score is the sum over query tokens of
    1 / (1 + least distance).
    """
    if distance not in (1, 2, 3):
        raise ValueError("distance must be 1, 2 or 3")
    vocabulary = index.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    words = asked.select(F.explode("asked").alias("token")).distinct()
    left = words.select("token", F.explode(_variants(F.col("token"), distance)).alias("variant"))
    right = vocabulary.select("word", "df", F.explode(_variants(F.col("word"), distance)).alias("variant"))
    close = left.join(right, "variant").select("token", "word", "df").distinct()
    close = close.withColumn("edits", F.levenshtein("token", "word")).where(F.col("edits") <= distance)
    spelled = close.groupBy("token").agg(F.sum("df").alias("spread"), F.collect_list(F.struct("word", "edits")).alias("near"))
    terms = asked.select("query_id", F.size("asked").alias("n"), F.explode("asked").alias("token")).join(spelled, "token")
    whole = terms.groupBy("query_id", "n").agg(F.collect_list("near").alias("groups"), F.min_by("near", F.struct("spread", "token")).alias("rare"))
    whole = whole.where(F.size("groups") == F.col("n"))
    keys = whole.select("query_id", "groups", F.explode("rare").alias("r")).select("query_id", "groups", F.col("r.word").alias("word"))
    wanted = keys.select("word").distinct()
    postings = index.select("entry_id", "words", F.explode(F.array_distinct("words")).alias("word")).join(wanted, "word", "left_semi")
    found = postings.join(keys, "word").dropDuplicates(["query_id", "entry_id"])
    # The few near words that an entry holds, found once by hash; groups are checked against them alone.
    near = F.flatten(F.transform("groups", lambda g: F.transform(g, lambda x: x["word"])))
    found = found.withColumn("held", F.array_intersect(near, "words"))
    least = F.transform("groups", lambda g: F.array_min(F.transform(F.filter(g, lambda x: F.array_contains("held", x["word"])), lambda x: x["edits"])))
    scored = found.where(F.size("held") > 0).withColumn("least", least).where(~F.exists("least", lambda x: x.isNull()))
    total = F.aggregate("least", F.lit(0.0), lambda s, x: s + 1 / (1 + x))
    return scored.select("query_id", "entry_id", F.round(total, 6).alias("score"))
