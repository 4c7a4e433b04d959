"""Queries of text, vectors, comparison, galleries, selection rules and graph algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import columns as C
from folioscope.functions import tables
from folioscope.operators import compare, dist, gallery, graphs, network, text, vectors
from folioscope.plans.registry import corpus_query, table_query
from folioscope.sources import eav


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("item_id"), "text")


def _transcripts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("item_id"), "text")


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _tokens(column: str) -> str:
    low = f"regexp_replace(lower(coalesce({column}, '')), '\\[[^\\]]*\\]', ' ', 'g')"
    low = f"regexp_replace({low}, 'speakers? \\d+:', ' ', 'g')"
    return f"list_filter(string_split_regex({low}, '[^\\p{{L}}]+'), lambda w: w <> '')"


_LEMMA = "CASE word " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.LEMMAS.items()) + " ELSE word END"


@table_query("word_cloud", f"""
WITH w AS (SELECT unnest({_tokens('text')}) AS word FROM conversations), l AS (SELECT {_LEMMA} AS word FROM w),
c AS (SELECT word, count(*) AS n FROM l WHERE length(word) >= 3 AND word NOT IN ({_list(text.STOP_WORDS)}) GROUP BY 1 HAVING count(*) >= 2)
SELECT word, n, rank FROM (SELECT *, row_number() OVER (ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 150
""")
def word_cloud(spark, sf_dir):
    return text.word_cloud(_transcripts(spark, sf_dir))


_LANG = "WITH t AS (SELECT doc_id AS item_id, text, " + _tokens("text") + " AS w FROM documents), k AS (" + " UNION ALL ".join(
    f"SELECT item_id, '{k}' AS lang, len(list_filter(w, lambda x: x IN ({_list(m)}))) AS n FROM t" for k, m in text.MARKERS.items()
) + """), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, lang DESC) AS k, lead(n) OVER (PARTITION BY item_id ORDER BY n DESC, lang DESC) AS second FROM k),
dl AS (SELECT item_id, CASE WHEN n >= 3 AND second * 2 <= n THEN lang END AS lang FROM r WHERE k = 1)
"""


@table_query("detect_language", _LANG + "SELECT item_id, lang FROM dl")
def detect_language(spark, sf_dir):
    return text.detect_language(_docs(spark, sf_dir))


_GENERIC = {"en": ("anding", "other", "thing"), "de": ("einer",)}


@table_query("language_clouds", _LANG + f"""
, w AS (SELECT dl.lang, unnest(t.w) AS word FROM t JOIN dl ON dl.item_id = t.item_id WHERE dl.lang IS NOT NULL AND dl.lang <> 'es'), l AS (SELECT lang, {_LEMMA} AS word FROM w),
c AS (SELECT lang, word, count(*) AS n FROM l WHERE length(word) >= 3 AND word NOT IN ({_list(text.STOP_WORDS)}) GROUP BY 1, 2 HAVING count(*) >= 2),
b AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, list_position(['en', 'fr', 'de', 'pt'], lang)) AS bucket FROM dl WHERE lang IS NOT NULL AND lang <> 'es' GROUP BY 1)
SELECT b.bucket, c.lang, c.word, c.n, (c.lang = 'en' AND c.word IN ('anding', 'other', 'thing')) OR (c.lang = 'de' AND c.word = 'einer') AS generic, c.rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c) c JOIN b ON b.lang = c.lang WHERE c.rank <= 150 + CASE c.lang WHEN 'en' THEN 3 WHEN 'de' THEN 1 ELSE 0 END
""")
def language_clouds(spark, sf_dir):
    return text.language_clouds(_docs(spark, sf_dir), generic=_GENERIC)


_YEARS = """
WITH w AS (SELECT doc_id, CAST(2000 + doc_id % 7 AS INTEGER) AS year, unnest(regexp_extract_all(lower(text), '(\\p{L}[\\p{L}''’-]*)', 1)) AS word FROM documents),
c AS (SELECT word, year, doc_id, count(*) AS k FROM w WHERE length(word) >= 2 GROUP BY 1, 2, 3),
o AS (SELECT word FROM c GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10),
y AS (SELECT word, year, CAST(sum(k) AS BIGINT) AS n FROM c WHERE word IN (SELECT word FROM o) GROUP BY 1, 2)
"""


def _dated(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("year", (2000 + F.col("item_id") % 7).cast("int"))


@table_query("words_by_year", _YEARS + "SELECT word, year, n FROM y")
def words_by_year(spark, sf_dir):
    return text.words_by_year(_dated(spark, sf_dir))


@table_query("suggested_words", _YEARS + f"""
, t AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM y WHERE word NOT IN ({_list(text.STOP_WORDS)}) AND NOT regexp_matches(word, '[''’-]') GROUP BY 1),
u AS (SELECT word, n FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(word, 's$', '') ORDER BY n DESC, word) AS k FROM t) WHERE k = 1)
SELECT word, n, rank FROM (SELECT *, row_number() OVER (ORDER BY n DESC, word) AS rank FROM u) WHERE rank <= 40
""")
def suggested_words(spark, sf_dir):
    return text.suggested_words(text.words_by_year(_dated(spark, sf_dir)))


@table_query("word_search", _YEARS + """
SELECT word, n, rank FROM (SELECT *, row_number() OVER (ORDER BY n DESC, word) AS rank FROM (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM y WHERE word LIKE 'th%' GROUP BY 1)) WHERE rank <= 8
""")
def word_search(spark, sf_dir):
    counts = text.words_by_year(_dated(spark, sf_dir)).groupBy("word").agg(F.sum("n").alias("n"))
    return compare.search_words(counts, "th")


_KINDS = """
WITH t AS (SELECT doc_id AS item_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS t FROM documents),
c AS (SELECT item_id, t, list_transform(t, lambda w: trim(w, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~')) AS cores FROM t WHERE len(t) > 0),
r AS (SELECT item_id, len(t) AS words,
  len(list_filter(cores, lambda w: regexp_full_match(translate(w, '-''’', ''), '\\p{L}+'))) / CAST(len(t) AS DOUBLE) AS share,
  len(list_filter(cores, lambda w: regexp_full_match(translate(w, '.,:/-', ''), '[0-9]+'))) / CAST(len(t) AS DOUBLE) AS numbers,
  len(list_filter(cores, lambda w: len(list_filter(string_split(replace(w, '/', '-'), '-'), lambda x: regexp_full_match(x, '[0-9]{4}') AND x BETWEEN '1800' AND '2099')) > 0)) / CAST(len(t) AS DOUBLE) AS years,
  len(list_filter(t, lambda w: regexp_full_match(translate(w, '.,', ''), '\\p{Lu}{1,3}') AND length(w) - length(replace(w, '.', '')) = length(translate(w, '.,', '')))) / CAST(len(t) AS DOUBLE) AS initials FROM c)
"""


@table_query("list_like_flags", _KINDS + """
SELECT item_id, words, round(share, 6) AS word_share, round(numbers, 6) AS number_density, share < 0.8 AS low_quality, years + numbers + initials > 0.12 OR years > 0.05 AS list_like FROM r
""")
def list_like_flags(spark, sf_dir):
    return text.list_like(_docs(spark, sf_dir))


@table_query("article_flags", _KINDS + """
SELECT d.doc_id AS item_id, array_to_string(list_filter([CASE WHEN d.doc_id % 7 = 0 THEN 'furniture' END, CASE WHEN coalesce(words, 0) < 300 THEN 'short' END, CASE WHEN coalesce(share, 0) < 0.8 THEN 'ocr' END], lambda f: f IS NOT NULL), ' ') AS flags
FROM documents d LEFT JOIN r ON r.item_id = d.doc_id
""")
def article_flags(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    title = F.concat(F.when(F.col("item_id") % 7 == 0, F.lit("Minutes of the Yearly Meeting, ")).otherwise(F.lit("Document ")), F.col("item_id").cast("string"))
    return text.article_flags(docs, docs.select("item_id", title.alias("title")), ["yearly meeting"]).select("item_id", F.array_join("flags", " ").alias("flags"))


@table_query("cards", """
WITH o AS (SELECT doc_id AS item_id, trim('Document ' || doc_id || ' ' || text) AS own FROM documents),
w AS (SELECT item_id, own, string_split_regex(own, '[ \\t\\n\\x0B\\f\\r]+') AS words FROM o)
SELECT item_id, sha256(array_to_string(words[1:900], ' ')) AS hash, CAST(least(len(words), 900) AS BIGINT) AS words, len(words) > 900 AS truncated, length(own) < 100 AS low_signal FROM w
""")
def cards(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    titles = docs.select("item_id", F.concat(F.lit("Document "), F.col("item_id").cast("string")).alias("title"))
    return text.semantic_cards(docs, titles)


@table_query("html_text", """
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</(p|div|h[1-6]|li|tr|article)>', chr(10) || chr(10), 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&amp;', chr(1)), '&amp', chr(1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), chr(1), '&') AS t FROM b)
SELECT page_id, sha256(trim(regexp_replace(t, '[ \\t]+', ' ', 'g'))) AS text_sha256 FROM c
""")
def html_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.sha2(text.strip_html(F.col("html")), 256).alias("text_sha256"))


_NAMES = [("This", "this", 1), ("Est", "est", 1), ("Und", "und", 1), ("Und", "und die", 0), ("Est", "est de", 2), ("The", "the of", 1)]


@table_query("place_mentions", """
WITH g AS (SELECT place, weight, string_split(name, ' ') AS of FROM (VALUES """ + ", ".join(map(str, _NAMES)) + """) v(place, name, weight)),
p AS (SELECT item_id, piece, row_number() OVER () AS pid FROM (SELECT doc_id AS item_id, unnest(regexp_split_to_array(regexp_replace(text, 'http[^ ]*', ' . ', 'g'), '[^\\p{L}\\p{M}\\p{N}''’\\s-]+')) AS piece FROM documents)),
w AS (SELECT item_id, pid, list_filter(regexp_split_to_array(piece, '\\s+'), lambda x: x <> '') AS words FROM p),
s AS (SELECT item_id, pid, words, unnest(range(1, len(words) + 1)) AS k FROM w),
m AS (SELECT s.item_id, s.pid, g.place, g.weight, s.k AS a, s.k + len(g.of) AS b FROM s JOIN g ON g.of[1] = s.words[s.k] WHERE s.words[s.k : s.k + len(g.of) - 1] = g.of),
u AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.pid = m.pid AND o.a <= m.a AND o.b >= m.b AND o.b - o.a > m.b - m.a))
SELECT item_id, place, CAST(sum(weight) AS BIGINT) AS n FROM u GROUP BY 1, 2 HAVING sum(weight) >= 3
""")
def place_mentions(spark, sf_dir):
    from folioscope.operators import geo

    return geo.mentions(_docs(spark, sf_dir), spark.createDataFrame(_NAMES, "place string, name string, weight int"), "http[^ ]*")


@table_query("passages")
def passages(spark, sf_dir):
    return text.passages(_docs(spark, sf_dir))


#: The table function gives the rows of ``passages``; tests/test_tables.py holds it against them.
@table_query("passages_sql")
def passages_sql(spark, sf_dir):
    tables.register(spark)
    query = "SELECT * FROM passages(TABLE(SELECT * FROM {pieces}) PARTITION BY item_id ORDER BY (pos, k), 300, 400, 100)"
    return spark.sql(query, pieces=text.pieces(_docs(spark, sf_dir)))


@table_query("keywords")
def keywords(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("item_id"), "text", "lang")
    return text.keywords(docs, "lang")


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")


def _low(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").select(F.col("doc_id").alias("item_id"))


_KNN = """
WITH r AS (SELECT vec_id AS item_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT item_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM r WHERE item_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
u AS (SELECT item_id, label, v, s, list_transform(v, lambda x: x / s) AS q FROM n),
p AS (SELECT a.item_id AS src, b.item_id AS dst, round(list_dot_product(a.q, b.q), 6) AS score, b.v FROM u a JOIN u b ON a.v <> b.v),
o AS (SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src, v ORDER BY score DESC, dst) AS k FROM p WHERE score > 0) WHERE k = 1),
knn AS (SELECT src, dst, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM o) WHERE rank <= 12)
"""


def _knn(spark, sf_dir):
    return vectors.similar_items(_vectors(spark, sf_dir), _low(spark, sf_dir))


@table_query("knn_top12", _KNN + "SELECT src, dst, score, rank FROM knn")
def knn_top12(spark, sf_dir):
    return _knn(spark, sf_dir)


#: Candidates can't be said in SQL; tests/test_vectors.py holds their recall against the exact neighbours.
@table_query("knn_near")
def knn_near(spark, sf_dir):
    return vectors.near_items(_vectors(spark, sf_dir))


@table_query("knn_shown", _KNN + "SELECT src, dst, CAST(round(score * 100) AS BIGINT) AS percent FROM knn WHERE rank <= 6")
def knn_shown(spark, sf_dir):
    return _knn(spark, sf_dir).where("rank <= 6").select("src", "dst", F.round(F.col("score") * 100).cast("long").alias("percent"))


@table_query("knn_quality", _KNN + """
, pr AS (SELECT k.src, bool_or(a.label <> b.label) AS x, sum(k.score) AS s, count(*) AS n FROM knn k JOIN u a ON a.item_id = k.src JOIN u b ON b.item_id = k.dst GROUP BY 1)
SELECT count(*) AS sources, count(*) FILTER (x) AS "cross", round(sum(s) / sum(n), 6) AS mean_score FROM pr
""")
def knn_quality(spark, sf_dir):
    return vectors.quality(_knn(spark, sf_dir), _vectors(spark, sf_dir).select("item_id", F.col("label").alias("kind")))


@table_query("knn_score_quantiles", _KNN + ", q AS (SELECT " + ", ".join(f"quantile_cont(score, {v}) AS {n}" for n, v in (("min", 0.0), ("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("max", 1.0))) + " FROM knn) " + " UNION ALL ".join(
    f"SELECT '{n}' AS name, round({n}, 6) AS value FROM q" for n in ("min", "p05", "p25", "median", "p75", "p95", "max")
))
def knn_score_quantiles(spark, sf_dir):
    return dist.score_quantiles(_knn(spark, sf_dir), "score")


@table_query("knn_percentiles", _KNN + """
SELECT src, dst, score, rank, round((rank() OVER (ORDER BY score) - 1) / CAST(count(*) OVER () AS DOUBLE), 6) AS percentile FROM knn
""")
def knn_percentiles(spark, sf_dir):
    return vectors.with_percentile(_knn(spark, sf_dir))


@table_query("knn_public", _KNN + """
SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY rank) AS rank FROM knn WHERE src % 3 <> 0 AND dst % 3 <> 0 AND src % 10 <> 4 AND dst % 10 <> 4
""")
def knn_public(spark, sf_dir):
    """Carried to a corpus from which every third item was never public and some have been hidden since."""
    items = _vectors(spark, sf_dir).select("item_id")
    return vectors.restricted(_knn(spark, sf_dir), items.where("item_id % 3 != 0"), items.where("item_id % 10 = 4"))


@table_query("similarity_groups", """
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), b AS (SELECT label FROM (SELECT label, row_number() OVER (ORDER BY n DESC, label) AS k FROM c) WHERE k <= 8)
SELECT e.vec_id AS item_id, CASE WHEN e.label IS NULL THEN '' WHEN b.label IS NOT NULL THEN CAST(e.label AS VARCHAR) ELSE 'Other' END AS panel FROM embeddings e LEFT JOIN b ON b.label = e.label
""")
def similarity_groups(spark, sf_dir):
    return vectors.similarity_groups(_vectors(spark, sf_dir).select("item_id", "label"))


@table_query("group_vectors", """
WITH x AS (SELECT label, k, avg(CAST(embedding[k] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(k) GROUP BY 1, 2), s AS (SELECT label, sqrt(sum(m * m)) AS s FROM x GROUP BY 1)
SELECT CAST(x.label AS INTEGER) AS label, CAST(k - 1 AS INTEGER) AS k, round(m / s.s, 6) AS value FROM x JOIN s ON s.label = x.label
""")
def group_vectors(spark, sf_dir):
    mean = vectors.mean_vectors(_vectors(spark, sf_dir), "label")
    return mean.select("label", F.posexplode("vector").alias("k", "x")).select("label", "k", F.round("x", 6).alias("value"))


@table_query("pca_map")
def pca_map(spark, sf_dir):
    return vectors.layout(_vectors(spark, sf_dir))


@table_query("kmeans")
def kmeans(spark, sf_dir):
    return vectors.clusters(_vectors(spark, sf_dir))


_SETS = ", st AS (SELECT DISTINCT m.dst AS entity, i.title AS name FROM rlinks m JOIN rlinks l ON l.src = m.src JOIN items i ON i.item_id = l.dst WHERE m.term = 'dcterms:isPartOf' AND l.credit)"


@corpus_query("overlap", _SETS + """
, sz AS (SELECT entity, count(*) AS n FROM st GROUP BY 1), bo AS (SELECT x.entity AS a, y.entity AS b, count(*) AS n FROM st x JOIN st y ON x.name = y.name AND x.entity < y.entity GROUP BY 1, 2)
SELECT bo.a, bo.b, bo.n AS both, p.n + q.n - bo.n AS either, CAST(round(100 * bo.n / (p.n + q.n - bo.n)) AS BIGINT) AS percent FROM bo JOIN sz p ON p.entity = bo.a JOIN sz q ON q.entity = bo.b
""")
def overlap(c):
    members = c.linking_to(C.IS_PART_OF).join(c.records, "item_id", "left_semi")
    return compare.overlap(dist.counted(c, "contributors", members.select("entity", "item_id"))[0].select("entity", F.col("title").alias("name")))


@corpus_query("unified_order", """
, n AS (SELECT m.dst AS e, i.title AS name, count(DISTINCT l.src) AS n FROM rlinks m JOIN rlinks l ON l.src = m.src JOIN items i ON i.item_id = l.dst
  WHERE m.term = 'dcterms:isPartOf' AND m.dst IN (200000001, 200000002) AND l.term = 'dcterms:subject' GROUP BY 1, 2),
j AS (SELECT coalesce(x.name, y.name) AS name, coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS b FROM (SELECT * FROM n WHERE e = 200000001) x FULL JOIN (SELECT * FROM n WHERE e = 200000002) y ON x.name = y.name)
SELECT name, a, b, row_number() OVER (ORDER BY a + b DESC, name) AS rank FROM j
""")
def unified_order(c):
    members = c.linking_to(C.IS_PART_OF).where(F.col("entity").isin(200_000_001, 200_000_002)).join(c.records, "item_id", "left_semi").select("entity", "item_id")
    rows = dist.counted(c, "subjects", members)[0].select("entity", F.col("title").alias("name"), "n")
    return compare.unified(rows.where("entity = 200000001"), rows.where("entity = 200000002"))


@corpus_query("title_search", "SELECT item_id, title, rank FROM (SELECT item_id, title, row_number() OVER (ORDER BY title, item_id) AS rank FROM items WHERE contains(lower(title), 'an')) WHERE rank <= 8")
def title_search(c):
    return compare.search(c.items, "AN")


_MEDIA = """
WITH md AS (SELECT DISTINCT l_orderkey * 10000000 + l_partkey AS media_id, l_orderkey AS item_id, 's' || l_partkey AS storage, 'jpg' AS ext, l_partkey % 5 AS position,
  p_size % 4 <> 0 AS pub, p_size % 3 <> 0 AS thumb, p_size % 2 = 0 AS orig FROM lineitem JOIN part ON p_partkey = l_partkey),
it AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 7 = 0 THEN (SELECT min(media_id) FROM md WHERE md.item_id = o_orderkey) END AS prim FROM orders),
ok AS (SELECT md.* FROM md JOIN it ON it.item_id = md.item_id WHERE md.pub AND (it.prim IS NULL OR it.prim = md.media_id)),
im AS (SELECT item_id, media_id, storage, CASE WHEN orig THEN ext ELSE '' END AS ext FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY position, media_id) AS k FROM ok) WHERE k = 1 AND thumb)
"""


def _images(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().join(part, F.col("p_partkey") == F.col("l_partkey"))
    size = F.col("p_size")
    media = lines.select(
        (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey")).alias("media_id"), F.col("l_orderkey").alias("item_id"),
        F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("storage"), F.lit("jpg").alias("ext"), (F.col("l_partkey") % 5).alias("position"),
        (size % 4 != 0).alias("is_public"), (size % 3 != 0).alias("has_thumbnails"), (size % 2 == 0).alias("has_original"),
    )
    first = media.where("item_id % 7 = 0").groupBy("item_id").agg(F.min("media_id").alias("primary_media_id"))
    items = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("item_id")).join(first, "item_id", "left")
    return gallery.primary_media(items, media)


@table_query("primary_media", _MEDIA + "SELECT item_id, media_id, storage, ext FROM im")
def primary_media(spark, sf_dir):
    return _images(spark, sf_dir)


def _status_members(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.ascii("o_orderstatus").cast("long").alias("entity"), F.col("o_orderkey").alias("item_id"))


@table_query("gallery_records", _MEDIA + """
SELECT CAST(ascii(o_orderstatus) AS BIGINT) AS entity, im.item_id, im.storage, n_name AS place, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS DOUBLE) END AS lat, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS DOUBLE) END AS lon,
       count(*) OVER (PARTITION BY o_orderstatus) AS total, row_number() OVER (PARTITION BY o_orderstatus ORDER BY im.item_id) AS rank
FROM im JOIN orders ON o_orderkey = im.item_id JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey QUALIFY rank <= 600
""")
def gallery_records(spark, sf_dir):
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer", "nation")}
    rows = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    where = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("double"))
    places = rows.select(F.col("o_orderkey").alias("item_id"), F.col("n_name").alias("place_title"), where.alias("lat"), where.alias("lon"), F.lit(1).alias("ord"))
    literals = rows.select(F.col("o_orderkey").alias("item_id"), F.lit("nowhere").alias("value"), F.lit(1).alias("ord"))
    return gallery.records(_status_members(spark, sf_dir), _images(spark, sf_dir), places, literals)


@table_query("collection_index", _MEDIA + """
, m AS (SELECT CAST(ascii(o_orderstatus) AS BIGINT) AS entity, o_orderkey AS item_id FROM orders)
SELECT m.entity, count(DISTINCT m.item_id) AS items, count(im.storage) AS photos, array_to_string((list(im.storage ORDER BY m.item_id) FILTER (im.storage IS NOT NULL))[1:4], ',') AS covers FROM m LEFT JOIN im ON im.item_id = m.item_id GROUP BY 1
""")
def collection_index(spark, sf_dir):
    return gallery.collection_index(_status_members(spark, sf_dir), _images(spark, sf_dir))


@table_query("issue_groups", """
WITH a AS (SELECT o_orderkey AS item_id, 'Order ' || o_orderkey AS title, CAST(year(o_orderdate) - 1990 AS INTEGER) AS volume, CAST(month(o_orderdate) AS INTEGER) AS issue,
  CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey % 300 AS INTEGER) END AS page, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS yr FROM orders WHERE o_orderstatus = 'F')
SELECT a.volume, a.issue, y.issue_year, a.item_id, a.page, row_number() OVER (PARTITION BY a.volume, a.issue ORDER BY a.page NULLS LAST, a.title, a.item_id) AS place
FROM a JOIN (SELECT volume, issue, arg_min(yr, item_id) FILTER (yr IS NOT NULL) AS issue_year FROM a GROUP BY 1, 2) y ON y.volume = a.volume AND y.issue = a.issue
""")
def issue_groups(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'")
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    doi = F.format_string("10.1/v%di%d", F.year(day) - 1990, F.month(day))
    pages = F.when(key % 9 != 0, F.concat(F.lit("pp. "), (key % 300).cast("string"), F.lit("-9999")))
    return gallery.issue_contents(o.select(key.alias("item_id"), F.concat(F.lit("Order "), key.cast("string")).alias("title"), doi.alias("doi"), pages.alias("pages"), F.when(key % 5 != 0, F.year(day)).alias("year")))


_DATES = ("dcterms:issued", "dcterms:created", "dcterms:date", "local:hasDateCollected")


@table_query("preferred_dates", """
WITH r AS (
  SELECT o_orderkey AS item_id, o_orderkey % 4 + 1 AS kind, CASE WHEN o_orderkey % 6 = 0 THEN 'undated' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS value, 2 AS ord FROM orders
  UNION ALL SELECT o_orderkey, (o_orderkey // 4) % 4 + 1, 'about ' || (1900 + o_orderkey % 90), 1 FROM orders),
d AS (SELECT *, regexp_extract(value, '(\\d{4})', 1) AS y FROM r)
SELECT item_id, CAST(y AS INTEGER) AS year, value AS date_raw FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY kind, ord) AS k FROM d WHERE y <> '') WHERE k = 1
""")
def preferred_dates(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    terms = F.array(*[F.lit(t) for t in _DATES])
    a = o.select(key.alias("item_id"), F.get(terms, (key % 4).cast("int")).alias("term"), F.when(key % 6 == 0, "undated").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("value"), F.lit(2).alias("ord"))
    b = o.select(key.alias("item_id"), F.get(terms, (F.floor(key / 4) % 4).cast("int")).alias("term"), F.concat(F.lit("about "), (1900 + key % 90).cast("string")).alias("value"), F.lit(1).alias("ord"))
    return eav.preferred_dates(a.unionByName(b))


@table_query("coherent_coordinates", """
WITH p AS (SELECT o_orderkey AS item_id, n, CASE WHEN (o_orderkey + n) % 5 = 0 THEN NULL ELSE CAST((o_orderkey * 7 + n * 31) % 240 - 120 AS DOUBLE) END AS lat, CAST((o_orderkey * 11 + n * 17) % 400 - 200 AS DOUBLE) AS lon FROM orders, range(1, 4) r(n))
SELECT item_id, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n) AS k FROM p WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) WHERE k = 1
""")
def coherent_coordinates(spark, sf_dir):
    """Three pairs an item, some no numbers, some off the globe."""
    key, n = F.col("o_orderkey"), F.col("n")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    lat = F.when((key + n) % 5 == 0, "n/a").otherwise(((key * 7 + n * 31) % 240 - 120).cast("string"))
    lon = ((key * 11 + n * 17) % 400 - 200).cast("string")
    row = lambda term, value, at: rows.select(key.alias("item_id"), F.lit(term).alias("term"), value.alias("value"), at.alias("ord"))
    return eav.coherent_coordinates(row(C.LATITUDE, lat, n * 2).unionByName(row(C.LONGITUDE, lon, n * 2 + 1)))


#: Rounds of the SQL, by which ranks have settled; the operator stops by itself.
_ROUNDS = 40


@corpus_query("pagerank", ", e AS (SELECT a.dst AS a, b.dst AS b, count(*) AS n FROM (SELECT DISTINCT l.src, l.dst FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE l.credit AND i.class_term = 'foaf:Person') a JOIN (SELECT DISTINCT l.src, l.dst FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE l.credit AND i.class_term = 'foaf:Person') b ON a.src = b.src AND a.dst < b.dst GROUP BY 1, 2 HAVING count(*) >= 2), s AS MATERIALIZED (SELECT a, b, CAST(n AS DOUBLE) AS w FROM e UNION ALL SELECT b, a, n FROM e), dg AS (SELECT a, sum(w) AS d FROM s GROUP BY 1), fl AS MATERIALIZED (SELECT s.a, s.b, s.w / dg.d AS f FROM s JOIN dg ON dg.a = s.a), r0 AS (SELECT a AS node, 1.0::DOUBLE / count(*) OVER () AS r FROM dg)" + "".join(
    f", r{i + 1} AS MATERIALIZED (SELECT fl.b AS node, sum(fl.f * r.r) * 0.85 + 0.15 / (SELECT count(*) FROM r0) AS r FROM fl JOIN r{i} r ON r.node = fl.a GROUP BY 1)" for i in range(_ROUNDS)
) + f" SELECT node, round(r / (SELECT sum(r) FROM r{_ROUNDS}), 5) AS rank FROM r{_ROUNDS}")
def pagerank(c):
    ranks = graphs.pagerank(network.collaboration(c))
    return ranks.select("node", F.round("rank", 5).alias("rank"))


def _shown(c):
    """Ties of persons with two records in common or more, as in the other networks."""
    return network.collaboration(c)


@corpus_query("louvain")
def louvain(c):
    return graphs.communities(_shown(c), "one-level")


@corpus_query("louvain_multilevel")
def louvain_multilevel(c):
    return graphs.communities(_shown(c), "louvain")


@corpus_query("label_propagation")
def label_propagation(c):
    return graphs.communities(_shown(c), "propagation")


@corpus_query("connected_top_n")
def connected_top_n(c):
    edges = _shown(c)
    return graphs.connected_top_n(edges, graphs.pagerank(edges), 40)


@corpus_query("force_layout")
def force_layout(c):
    return graphs.layout(_shown(c))


@corpus_query("unique_names", """
SELECT item_id, CASE WHEN count(*) OVER (PARTITION BY title) > 1 THEN title || ' (#' || item_id || ')' ELSE title END AS title FROM items WHERE title IS NOT NULL
""")
def unique_names(c):
    return graphs.unique_names(c.items.where("title is not null").select("item_id", "title"))
