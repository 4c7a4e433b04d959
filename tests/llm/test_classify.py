import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import quality, toxicity
from folioscope.llm.logistic import fit
from tests.llm.cases import TEXTS, docs, empty

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def big(spark):
    import os

    if not os.path.isdir(BIG):
        pytest.skip("no test tables here")
    return spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")


@pytest.fixture(scope="module")
def restorer(big):
    return toxicity.Restorer(toxicity.language_model(big[0]))


def held(df):
    return df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def test_logistic_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    assert ((fit(x, y)(x) > 0.5) == y).mean() > 0.97
    assert abs(fit(x[:0], y[:0])(x)[0] - 0.5) < 1e-6
    assert fit(x, np.ones(500))(x).min() > 0.9


def test_quality_on_held_out_labels(big):
    df, labels = big
    out = held(quality.quality(df, labels).join(labels, "doc_id")).groupBy("quality", "accepted").count().collect()
    n = {(r.quality, r.accepted): r["count"] for r in out}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.98
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.95


def test_views_that_know_nothing_do_not_teach():
    rng = np.random.default_rng(2)
    y = (rng.random(600) < 0.85).astype(float)
    content = np.zeros((600, quality.N_CONTENT))
    content[:, 0] = y + rng.normal(scale=0.2, size=600)
    meta = rng.normal(size=(600, quality.N_META))
    model = quality.co_train((content, meta, y), quality.ArrayPool(content[:300], meta[:300]))
    assert ((model(content, meta)[0] >= 0.5) == y).mean() > 0.97


def test_each_view_teaches_the_other():
    """Few labels, many unlabelled rows: a view that is good alone pulls the other up."""
    rng = np.random.default_rng(3)
    y = (rng.random(3000) < 0.5).astype(float)
    content = np.zeros((3000, quality.N_CONTENT))
    content[:, 0] = y * 2 + rng.normal(scale=0.3, size=3000)
    meta = np.zeros((3000, quality.N_META))
    meta[:, :60] = y[:, None] * 0.5 + rng.normal(size=(3000, 60))
    taught = quality.co_train((content[:45], meta[:45], y[:45]), quality.ArrayPool(content[45:2000], meta[45:2000]))
    alone = quality.co_train((content[:45], meta[:45], y[:45]), quality.ArrayPool(content[:0], meta[:0]))
    good = lambda m: ((m.meta(meta[2000:]) > 0.5) == y[2000:]).mean()
    assert good(taught) > good(alone) + 0.02


def test_one_round_by_hand():
    """Pseudo-labels, calibration and combination, written out step by step with a logistic regression by plain gradient steps."""
    rng = np.random.default_rng(5)
    n, pool = 90, 400
    y = (rng.random(n) < 0.5).astype(float)
    truth = (rng.random(pool) < 0.5).astype(float)

    def view(t, width, strong):
        x = np.zeros((len(t), width))
        x[:, :2] = t[:, None] * strong + rng.normal(size=(len(t), 2))
        return x

    content, content_pool = view(y, quality.N_CONTENT, 3.0), view(truth, quality.N_CONTENT, 3.0)
    meta, meta_pool = view(y, quality.N_META, 1.5), view(truth, quality.N_META, 1.5)

    def learn(x, t):
        mean, scale = x.mean(0), x.std(0)
        scale[scale <= 1e-9] = 1
        z, w, b = (x - mean) / scale, np.zeros(x.shape[1]), 0.0
        for _ in range(40_000):
            p = 1 / (1 + np.exp(-(z @ w + b)))
            w, b = w - 0.02 * (z.T @ (p - t) + w) / len(t) * 10, b - 0.2 * (p - t).mean()
        return lambda new: ((new - mean) / scale) @ w + b

    chance = lambda logit: 1 / (1 + np.exp(-logit))
    held = [k for k in range(n) if k % 3 == 2]
    rest = [k for k in range(n) if k % 3 != 2]
    first = {"content": learn(content[rest], y[rest]), "meta": learn(meta[rest], y[rest])}
    teach = {"content": [content[rest]], "meta": [meta[rest]]}
    answer = {"content": [y[rest]], "meta": [y[rest]]}
    pools = {"content": content_pool, "meta": meta_pool}
    given = {}
    for name, other in (("content", "meta"), ("meta", "content")):
        p = chance(first[name](pools[name]))
        free = list(range(pool))
        for label, sure in ((1.0, p), (0.0, 1 - p)):
            best = sorted((k for k in free if sure[k] >= 0.97), key=lambda k: (-sure[k], k))[: pool // 10]
            free = [k for k in free if k not in best]
            given[name, label] = best
            teach[other].append(pools[other][best])
            answer[other].append(np.full(len(best), label))
    assert given["content", 1.0] and given["content", 0.0]
    last = {v: learn(np.vstack(teach[v]), np.concatenate(answer[v])) for v in ("content", "meta")}
    calibrated = {v: learn(last[v](x[held])[:, None], y[held]) for v, x in (("content", content), ("meta", meta))}
    both = lambda a, b: np.stack([calibrated["content"](last["content"](a)[:, None]), calibrated["meta"](last["meta"](b)[:, None])], 1)
    combine = learn(both(content[held], meta[held]), y[held])
    want = chance(combine(both(content_pool, meta_pool)))
    made = quality.co_train((content, meta, y), quality.ArrayPool(content_pool, meta_pool), rounds=1)
    got = made(content_pool, meta_pool)[0]
    assert np.abs(got - want).max() < 0.02, np.abs(got - want).max()
    assert ((got >= 0.5) == truth).mean() > 0.9


def test_quality_cases(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (3, None), (99, 1)], "doc_id long, quality int")
    df = docs(spark).withColumn("quality_score", F.lit("clash"))
    out = quality.quality(df, labels).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.quality_score_ <= 1 and r.quality_score == "clash" for r in out)
    assert quality.quality(empty(spark).withColumns({"lang": F.lit("x"), "n_chars": F.lit(None).cast("long")}), labels).count() == 0
    same = quality.quality(df, labels.limit(0)).select("quality_score_").distinct()
    assert same.count() == 1


def test_toxicity_on_held_out_labels(big):
    df, labels = big
    out = toxicity.toxicity(df, labels).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in out}
    assert n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.99
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85


def test_deobfuscation(big):
    """Held against every reading of a token, scored one by one."""
    df, _ = big
    model = toxicity.language_model(df)
    restore = toxicity.Restorer(model)
    for odd, plain in [("1d10t", "idiot"), ("m0r0n", "moron"), ("cl0wn", "clown"), ("l0ser", "loser"), ("stup1d", "stupid"), ("idiiiiot", "idiot"), ("tra$h", "trash"), ("wor+hless", "worthless"), ("id_iot", "idiot")]:
        assert restore(odd) == plain, (odd, restore(odd))
    found = restore.words(b"the I D I O T and a s-t-u-p-i-d m.o.r.o.n; Plain w0rthl3ss!! id*ot p@th3tic$$$")
    for w in (b"idiot", b"stupid", b"moron", b"plain", b"worthless", b"pathetic"):
        assert w in found, w

    def brute(token):
        def cost(s):
            a = b = 0
            total = 0.0
            for c in s:
                z = ord(c) - 96
                total += model[a][b][z]
                a, b = b, z
            return total + model[a][b][0]

        readings = [("", 0.0)]
        for options in restore._readings(token):
            readings = [(t + x, k - y) for t, k in readings for x, y in options]
        return max(readings, key=lambda r: r[1] + cost(r[0]))[0]

    for token in ("1d10t", "th3r3", "b00k", "ss3llll", "4n0n", "l1|e", "he*t", "a2b3c"):
        assert restore(token) == brute(token)


def written_oddly(words, seed):
    """(way, odd, plain): each word written in one of five ways."""
    rng = random.Random(seed)
    marks = {}
    for mark, letters in toxicity.LEET.items():
        for c in letters:
            marks.setdefault(c, []).append(mark)

    def leet(w):
        return "".join(rng.choice(marks[c]) if c in marks and rng.random() < 0.5 else c for c in w)

    def alike(w):
        chosen = {c: rng.choice(marks[c]) if c in marks and rng.random() < 0.6 else c for c in sorted(set(w))}
        return "".join(chosen[c] for c in w)

    def inserted(w):
        k = rng.randrange(1, len(w))
        return w[:k] + rng.choice("_*.-") + w[k:]

    def stretched(w):
        k = rng.randrange(len(w))
        return w[:k] + w[k] * rng.randint(3, 5) + w[k + 1 :]

    def numbered(w):
        return w + rng.choice(["12", "3", "99", "7", "2024"])

    doubled = [w for w in words if re.search(r"(.)\1", w)]
    for way, some in ((leet, words), (alike, doubled), (inserted, words), (stretched, words), (numbered, words)):
        for w in rng.sample(some, min(500, len(some))):
            odd = way(w)
            if odd != w:
                yield way.__name__, odd, w


def test_deobfuscation_of_the_corpus_own_words(big, restorer):
    """Not tokens chosen by hand: words of the documents, written oddly. The seed isn't the one that the costs were chosen by."""
    df, _ = big
    texts = [r.text or "" for r in df.select("text").collect()]
    often = Counter(w for t in texts for w in re.findall(r"[a-z]+", t.lower()) if 3 <= len(w) <= 14)
    words = sorted(w for w, n in often.items() if n >= 20)
    right, of = Counter(), Counter()
    for way, odd, plain in written_oddly(words, 99):
        of[way] += 1
        right[way] += restorer(odd) == plain
    assert len(of) == 5 and all(right[way] >= 0.9 * n for way, n in of.items()), {way: right[way] / n for way, n in of.items()}


@pytest.mark.parametrize("odd, plain", [("c@ll", "call"), ("b00k", "book"), ("w0rthl3ss", "worthless"), ("w0rthle$$", "worthless"), ("sc@m", "scam")])
def test_short_readings_are_not_favoured(restorer, odd, plain):
    assert restorer(odd) == plain


@pytest.mark.xfail(reason="letters that these documents hardly ever have side by side; README says so", strict=True)
@pytest.mark.parametrize("odd, plain", [("bu11y", "bully"), ("a$$", "ass"), ("ki11", "kill"), ("us3le55", "useless")])
def test_known_misreadings(restorer, odd, plain):
    assert restorer(odd) == plain


def test_planted_obfuscated_texts_are_found(spark, big):
    df, labels = big
    clean = df.join(labels.where("toxic = 0 and quality = 1"), "doc_id", "left_semi").where("lang = 'en'").limit(30).collect()
    swaps = ["1d10t", "s c u m", "stuuupid", "m0r0n", "pa+hetic"]
    rows = [(10**7 + i, f"{r.text[:200]} {swaps[i % 5]} {r.text[200:400]} {swaps[(i + 1) % 5]} {swaps[(i + 2) % 5]}.", "s") for i, r in enumerate(clean)]
    planted = spark.createDataFrame(rows, "doc_id long, text string, source string")
    model = toxicity.train(df, labels)
    restore = toxicity.Restorer(model.language)
    hits = sum(model.score(restore.words(t.encode())) >= 0.5 for _, t, _ in rows)
    misses = sum(model.score(restore.words(r.text.encode())) >= 0.5 for r in clean)
    assert planted.count() == 30 and hits >= 28 and misses <= 1


def test_toxicity_cases(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs(spark), labels).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [True, True]
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    assert toxicity.toxicity(docs(spark), labels.limit(0)).select("score").distinct().count() == 1


def test_the_pool_as_a_table_gives_what_one_in_memory_gives(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, quality.N_CONTENT + quality.N_META)).astype(np.float32).astype(float)
    model = fit(x[:200, : quality.N_CONTENT], (x[:200, 0] > 0).astype(float))
    table = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "key long, x array<float>").repartition(3)
    one, other = quality.ArrayPool(x[:, : quality.N_CONTENT], x[:, quality.N_CONTENT :], share=0.05), quality.TablePool(table, 20)
    for label in (1.0, 0.0, 1.0, 1.0):  # what was taken isn't taken again
        a, b = (pool.surest(0, model, label, 0.8) for pool in (one, other))
        assert len(a) and np.allclose(a, b)


def test_rows_that_repeat_a_labelled_id_count_once(spark, sf):
    docs_df, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    key = labels.join(docs_df, "doc_id").where(quality.training_rows("doc_id")).first().doc_id
    again = docs_df.where(F.col("doc_id") == key).withColumn("text", F.concat(F.lit("zz "), "text"))
    more = docs_df
    for _ in range(3):
        more = more.unionByName(again)
    a, b = (quality.train(d, labels) for d in (docs_df, docs_df.unionByName(docs_df.where(F.col("doc_id") == key))))
    assert np.allclose(a.content.weights, b.content.weights)  # equal rows change nothing
    assert quality.score(more, quality.train(more, labels)).count() == docs_df.count() + 3
    assert len(toxicity.toxicity(more, labels).collect()) == docs_df.count() + 3


def test_own_columns_stay(spark, sf):
    docs_df, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    own = docs_df.withColumns({c: F.lit("own") for c in ("quality_score", "accepted", "content_score", "meta_score", "score", "words", "half", "y", "x", "key", "h", "k")})
    out = quality.quality(own, labels)
    assert out.where("quality_score = 'own' and accepted = 'own' and meta_score = 'own'").count() == docs_df.count()
    assert dict(out.dtypes)["quality_score_"] == "double" and dict(out.dtypes)["accepted_"] == "boolean"
    assert len(toxicity.toxicity(own, labels).collect()) == docs_df.count()
