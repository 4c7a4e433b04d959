"""Full-text articles: maps fit for the public, neighbours with their reason, cards against texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import vectors as V
from folioscope.operators.graphs import cut
from folioscope.operators.ranking import ranked

#: From this cosine on, two articles count as one text.
SHARED_TEXT = 0.99


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def one_corpus_counts(rows: DataFrame) -> DataFrame:
    """(corpus, fetched, public, low_signal, truncated) of rows (item_id, corpus, is_public, low_signal, truncated); an item in two corpora is an error."""
    per = rows.groupBy("item_id").agg(F.min("corpus").alias("corpus"), F.max("corpus").alias("_other"), *[F.max(c).alias(c) for c in ("is_public", "low_signal", "truncated")])
    twice = F.concat(F.lit("in two corpora: "), F.col("item_id").cast("string"))
    sole = per.withColumn("corpus", F.when(F.col("corpus") == F.col("_other"), F.col("corpus")).otherwise(F.raise_error(twice).cast(rows.schema["corpus"].dataType)))
    flags = [F.count_if(c).alias(n) for c, n in (("is_public", "public"), ("low_signal", "low_signal"), ("truncated", "truncated"))]
    return sole.groupBy("corpus").agg(F.count(F.lit(1)).alias("fetched"), *flags)


def shared_texts(rows: DataFrame, hashes: DataFrame, least: float = SHARED_TEXT) -> DataFrame:
    """(item_id) of articles (item_id, vector) that share their text (item_id, hash), vector or nearly all of it with another."""
    unit = V.normalised(rows)
    twice = [_repeated(hashes), _repeated(unit)]
    near = V.similar_items(rows, top=1).where(F.col("score") >= least).select(F.col("src").alias("item_id"))
    return near.unionByName(twice[0]).unionByName(twice[1]).distinct()


def _repeated(hashes: DataFrame) -> DataFrame:
    more = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return hashes.join(more, "hash", "left_semi").select("item_id")


def centred(rows: DataFrame) -> DataFrame:
    """(item_id, vector): vectors less their mean, of length 1 again; one at the mean itself is an error, as for any zero vector."""
    unit = V.normalised(rows).select("item_id", "vector")
    at = unit.select(F.posexplode("vector").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("x"))
    mean = at.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("mean"))
    less = F.zip_with("vector", "mean", lambda x, m: x - m)
    return V.normalised(unit.join(F.broadcast(mean)).select("item_id", less.alias("vector"))).select("item_id", "vector")  # one row


def exclusions(texts: DataFrame, rows: DataFrame, furniture: str, min_words: int = 300) -> DataFrame:
    """(item_id, shared, furniture, short, private) of articles (item_id, title, text, is_public) with vectors (item_id, vector)."""
    hashes = texts.select("item_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    shared = shared_texts(rows, hashes).withColumn("shared", F.lit(True))
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), 1))
    flags = texts.select(
        "item_id", F.coalesce(F.trim("title").rlike(furniture), F.lit(False)).alias("furniture"),
        (words < min_words).alias("short"), (~F.coalesce("is_public", F.lit(False))).alias("private"),
    )
    return flags.join(shared, "item_id", "left").select("item_id", F.coalesce("shared", F.lit(False)).alias("shared"), "furniture", "short", "private")


def public_map(found: DataFrame, rows: DataFrame, top: int = 8) -> tuple[DataFrame, DataFrame]:
    """Points (item_id, x, y) and neighbours (src, dst, score, rank) of the articles that ``exclusions`` leaves.

    Points use vectors less their mean, as all articles of a journal point one way; scores are plain cosines, four digits.
    """
    kept = rows.join(found.where("not (shared or furniture or short or private)"), "item_id", "left_semi")
    near = V.similar_items(kept, top=top).withColumn("score", F.round("score", 4))
    return V.layout(centred(kept)), near


def content_map(points: DataFrame, near: DataFrame, public: DataFrame, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Points and neighbours (src, dst, rank) between public items (item_id), without scores; both empty under ``least`` points."""
    shown = points.join(public.select("item_id"), "item_id", "left_semi")
    enough = shown.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    shown = shown.join(F.broadcast(enough)).drop("_n")  # one row, or none
    kept = V.restricted(near.where("src != dst"), shown.select("item_id")).select("src", "dst", "rank")
    return shown, kept


def corpus_layouts(rows: DataFrame, corpus: str, least: int = 3) -> DataFrame:
    """(corpus, item_id, x, y): one layout for each corpus of ``least`` items or more. Corpora are few: each is a job."""
    names = [r[0] for r in rows.groupBy(corpus).count().where(F.col("count") >= least).orderBy(corpus).select(corpus).collect()]
    out = None
    for name in names:
        one = V.layout(rows.where(F.col(corpus).eqNullSafe(F.lit(name)))).select(F.lit(name).alias(corpus), "item_id", "x", "y")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else rows.select(corpus, "item_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).where("false")


def _match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The best pair of two blocks of passages, the earliest of equal ones."""
    names = ("src", "dst", "source_passage", "neighbour_passage", "s")
    if not len(left) or not len(right):
        return pd.DataFrame({n: [] for n in names})
    left, right = left.sort_values("passage"), right.sort_values("passage")
    a, b, best = left["vector"].to_numpy(), np.stack(right["vector"].to_numpy()), None
    for rows in V.strips(len(left), len(right)):
        score = np.round(np.stack(a[rows]) @ b.T, 4)
        r, c = np.unravel_index(score.argmax(), score.shape)
        if best is None or score[r, c] > best[2]:
            best = (left["passage"].iloc[rows.start + r], right["passage"].iloc[c], score[r, c])
    return pd.DataFrame([(left["src"].iloc[0], left["dst"].iloc[0], *best)], columns=names)


def passage_reasons(near: DataFrame, passages: DataFrame, terms: int = 6) -> DataFrame:
    """(src, dst, passage_score, source_passage, neighbour_passage, shared_terms): for each pair of neighbours the passages that match best and the rarest terms that both hold.

    ``near`` (src, dst), ``passages`` (item_id, passage, vector, terms array).
    Only passages of neighbouring articles are compared. Ties go to the
    earlier passage, and terms by rarity, then spelling.
    """
    unit = V.normalised(passages.select(F.struct("item_id", "passage").alias("item_id"), "vector"))
    unit = cut(unit.select("item_id.item_id", "item_id.passage", "vector"))
    size = unit.groupBy("item_id").agg(F.ceil(F.count(F.lit(1)) / V.BLOCK).alias("blocks"))
    sides = near.select("src", "dst").join(size.select(F.col("item_id").alias("src"), F.col("blocks").alias("a")), "src").join(size.select(F.col("item_id").alias("dst"), F.col("blocks").alias("b")), "dst")
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    at = lambda k: F.pmod(F.xxhash64("passage"), F.col(k))
    keys = ["src", "dst", "mine", "theirs"]
    left = unit.join(sides, F.col("item_id") == F.col("src")).select("src", "dst", at("a").alias("mine"), every("b").alias("theirs"), "passage", "vector")
    fresh = unit.select(*[F.col(c).alias(c) for c in ("item_id", "passage", "vector")])
    right = fresh.join(sides, F.col("item_id") == F.col("dst")).select(F.col("src").alias("src"), F.col("dst").alias("dst"), every("a").alias("mine"), at("b").alias("theirs"), "passage", "vector")
    columns = "src long, dst long, source_passage long, neighbour_passage long, s double"
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_match, columns)
    best = F.max_by(F.struct("source_passage", "neighbour_passage", "s"), F.struct("s", -F.col("source_passage"), -F.col("neighbour_passage")))
    found = cut(scored.groupBy("src", "dst").agg(best.alias("p")).select("src", "dst", F.col("p.s").alias("passage_score"), "p.source_passage", "p.neighbour_passage"))
    words = passages.select("item_id", "passage", F.explode(F.array_distinct("terms")).alias("term"))
    df = words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    mine = words.select(F.col("item_id").alias("src"), F.col("passage").alias("source_passage"), "term")
    theirs = words.select(F.col("item_id").alias("dst"), F.col("passage").alias("neighbour_passage"), "term")
    common = found.join(mine, ["src", "source_passage"]).join(theirs, ["dst", "neighbour_passage", "term"]).join(df, "term")
    rare = ranked(common.select("src", "dst", "term", "df"), ["src", "dst"], [F.col("df").asc(), F.col("term").asc()], terms)
    listed = rare.groupBy("src", "dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("shared_terms"))
    return found.join(listed, ["src", "dst"], "left").withColumn("shared_terms", F.coalesce("shared_terms", F.array().cast("array<string>")))


def own_card_ranks(articles: DataFrame, cards: DataFrame) -> DataFrame:
    """(item_id, score, rank): how an article's own card does among all cards, by cosine with the text, six digits; 1 is best.

    Cards that score the same rank the same. Blocks of articles meet blocks of cards; only counts leave a task.
    """
    a, b = V.normalised(articles), V.normalised(cards)
    own = a.join(b.select("item_id", F.col("vector").alias("card")), "item_id").select("item_id", F.round(_dot("vector", "card"), 6).alias("score"))
    scored = a.join(own, "item_id")
    # The own score rides along in the hash column.
    carried = scored.select("item_id", "vector", F.col("score").cast("string").alias("hash"))

    def better(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"item_id": left["item_id"], "n": 0})
        cards, names = np.stack(right["vector"].to_numpy()), right["item_id"].to_numpy()
        n = []
        for rows in V.strips(len(left), len(right)):
            part = left.iloc[rows]
            score = np.round(np.stack(part["vector"].to_numpy()) @ cards.T, 6)
            other = part["item_id"].to_numpy()[:, None] != names[None, :]
            n.append(((score > part["hash"].astype(float).to_numpy()[:, None]) & other).sum(1))
        return pd.DataFrame({"item_id": left["item_id"], "n": np.concatenate(n)})

    counts = V.blocked(carried, b).applyInPandas(better, "item_id long, n long").groupBy("item_id").agg((F.sum("n") + 1).alias("rank"))
    return own.join(counts, "item_id")


def bridges(articles: DataFrame, others: DataFrame, top: int = 3) -> DataFrame:
    """(src, dst, score, rank): an article's nearest items of other corpora, four digits; ties go by id."""

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"src": [], "dst": [], "score": []})
        right = right.sort_values("item_id")
        ids, others, out = right["item_id"].to_numpy(), np.stack(right["vector"].to_numpy()), []
        for rows in V.strips(len(left), len(right)):
            score = np.round(np.stack(left["vector"].to_numpy()[rows]) @ others.T, 4)
            best = np.argsort(-score, axis=1, kind="stable")[:, :top]
            out.append((np.repeat(left["item_id"].to_numpy()[rows], best.shape[1]), ids[best].ravel(), np.take_along_axis(score, best, 1).ravel()))
        return pd.DataFrame(dict(zip(("src", "dst", "score"), map(np.concatenate, zip(*out)))))

    near = V.blocked(V.normalised(articles), V.normalised(others)).applyInPandas(nearest, "src long, dst long, score double")
    return ranked(near, ["src"], [F.desc("score"), F.col("dst").asc()], top)
