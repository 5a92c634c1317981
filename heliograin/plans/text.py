"""Text queries over benchmark items, part names and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograin.operators import text
from heliograin.plans.base import query, rounded, table
from heliograin.plans.graph import ranked

TOKENS = r"list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
COUNTS = "counts AS (SELECT item_id AS id, term, count(*) AS n, any_value(length) AS length FROM (SELECT item_id, unnest(w) AS term, len(w) AS length FROM (SELECT item_id, " + TOKENS.format(c="text") + " AS w FROM benchmark)) GROUP BY ALL)"
DOC_COUNTS = COUNTS.replace("counts AS", "dcounts AS", 1).replace("item_id", "doc_id").replace("FROM benchmark", "FROM documents")


def _counts(spark, d):
    return text.term_counts(table(spark, d, "benchmark"), "item_id", text.alphanumeric_tokens(F.col("text")))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang")


def _n(df):
    return df.agg(F.count(F.lit(1)).alias("docs"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda w: w <> ''))::BIGINT AS n FROM documents")
def text_token_counts(spark, d):
    return _docs(spark, d).select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"))


@query(
    r"WITH w AS (SELECT lang, unnest(list_transform(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda w: w <> ''), lambda w: regexp_replace(regexp_replace(lower(w), '^[.,;:!?" + '"' + r"''()\[\]{}]+', ''), '[.,;:!?" + '"' + r"''()\[\]{}]+$', ''))) AS term FROM documents) "
    "SELECT lang, term, count(*) AS n FROM w WHERE term <> '' GROUP BY ALL"
)
def text_normal_token_counts(spark, d):
    t = _docs(spark, d).select("lang", F.explode(text.normal_tokens(F.col("text"))).alias("term"))
    return t.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DOC_COUNTS} SELECT term, sum(n)::BIGINT AS total, count(*) AS df FROM dcounts GROUP BY ALL")
def text_vocabulary(spark, d):
    return text.vocabulary(text.term_counts(_docs(spark, d), "doc_id", text.alphanumeric_tokens(F.col("text"))))


@query(f"WITH {COUNTS}, f AS (SELECT term, count(*) AS df FROM counts GROUP BY ALL) SELECT id, term, round(n / length * (ln(((SELECT count(*) FROM benchmark) + 1) / (df + 1)) + 1), 6) AS weight FROM counts JOIN f USING (term)")
def text_tf_idf(spark, d):
    return rounded(text.tf_idf(_counts(spark, d), _n(table(spark, d, "benchmark"))), 6)


@query(f"WITH {COUNTS}, f AS (SELECT term, count(*) AS df FROM counts GROUP BY ALL) SELECT id, term, round(n / length * ln((SELECT count(*) FROM benchmark) / df), 6) + 0.0 AS weight FROM counts JOIN f USING (term)")
def text_plain_tf_idf(spark, d):
    return rounded(text.tf_idf(_counts(spark, d), _n(table(spark, d, "benchmark")), smooth=False), 6)


@query(
    f"WITH {DOC_COUNTS}, f AS (SELECT term, count(*) AS df FROM dcounts GROUP BY ALL), w AS (SELECT id, term, round(n / length * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1), 9) AS weight FROM dcounts JOIN f USING (term)) "
    "SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY weight DESC, term)::INT AS rank FROM w QUALIFY rank <= 5"
)
def text_top_keywords(spark, d):
    docs = _docs(spark, d)
    w = text.tf_idf(text.term_counts(docs, "doc_id", text.alphanumeric_tokens(F.col("text"))), _n(docs))
    return text.top_keywords(rounded(w, 9), 5).select("id", "term", "rank")


def _pairs(value):
    return (
        f"WITH {COUNTS}, o AS (SELECT id, count(*) AS terms, sum(n) AS words, sqrt(sum(n * n)) AS norm FROM counts GROUP BY ALL), b AS (SELECT x.id AS query, y.id AS id, count(*) AS common, sum(least(x.n, y.n)) AS least, sum(x.n * y.n) AS dot FROM counts x JOIN counts y USING (term) WHERE x.id % 20 = 0 AND x.id <> y.id GROUP BY ALL) "
        f"SELECT query, b.id, round({value}, 6) AS similarity FROM b JOIN o ON b.id = o.id JOIN o q ON b.query = q.id"
    )


def _similar(spark, d, kind):
    c = _counts(spark, d)
    return text.pair_similarity(c, c.filter("id % 20 = 0"), kind)


@query(_pairs("common / (o.terms + q.terms - common)"))
def text_jaccard(spark, d):
    return rounded(_similar(spark, d, "jaccard"), 6)


@query(
    f"WITH {DOC_COUNTS}, o AS (SELECT id, count(*) AS terms FROM dcounts GROUP BY ALL), b AS (SELECT x.id AS query, y.id AS id, count(*) AS common FROM dcounts x JOIN dcounts y USING (term) WHERE x.id % 20 = 0 AND x.id <> y.id GROUP BY ALL), "
    "s AS (SELECT query, b.id, common / (o.terms + q.terms - common) AS similarity FROM b JOIN o ON b.id = o.id JOIN o q ON b.query = q.id) SELECT query, id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.5"
)
def text_jaccard_above(spark, d):
    c = text.term_counts(_docs(spark, d), "doc_id", text.alphanumeric_tokens(F.col("text")))
    return rounded(text.jaccard_above(c, c.filter("id % 20 = 0"), 0.5), 6)


@query(_pairs("least / (o.words + q.words - least)"))
def text_weighted_jaccard(spark, d):
    return rounded(_similar(spark, d, "weighted"), 6)


@query(_pairs("dot / (o.norm * q.norm)"))
def text_cosine(spark, d):
    return rounded(_similar(spark, d, "cosine"), 6)


@query("WITH p AS (" + _pairs("common / (o.terms + q.terms - common)") + ") SELECT query, arg_min(id, (-similarity, id)) AS id, max(similarity) AS similarity FROM p GROUP BY ALL")
def text_most_similar(spark, d):
    return text.most_similar(rounded(_similar(spark, d, "jaccard"), 6))


@query(
    f"WITH {DOC_COUNTS}, t AS (SELECT lang, term, sum(n) AS n FROM dcounts JOIN documents ON doc_id = id WHERE doc_id % 2 = 0 GROUP BY ALL), c AS (SELECT lang, sum(n) AS words, (SELECT count(*) FROM documents x WHERE x.lang = t.lang AND doc_id % 2 = 0) AS docs FROM t GROUP BY ALL), v AS (SELECT count(DISTINCT term) AS v FROM t), "
    "k AS (SELECT id, lang, sum(dcounts.n * (ln(coalesce(t.n, 0) + 1) - ln(words + v))) AS s FROM dcounts JOIN c ON true JOIN v ON true LEFT JOIN t USING (lang, term) WHERE id % 2 = 1 AND term IN (SELECT term FROM t) GROUP BY ALL), "
    "a AS (SELECT doc_id AS id, c.lang, ln(docs / (SELECT sum(docs) FROM c)) + coalesce(k.s, 0) AS s FROM documents JOIN c ON true LEFT JOIN k ON k.id = doc_id AND k.lang = c.lang WHERE doc_id % 2 = 1) "
    "SELECT id, arg_min(lang, (-s, lang)) AS predicted FROM a GROUP BY ALL"
)
def text_naive_bayes(spark, d):
    docs = _docs(spark, d)
    words = text.alphanumeric_tokens(F.col("text"))
    return text.naive_bayes(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), "doc_id", "lang", words).select("id", "predicted")


@query()
def text_minhash_links(spark, d):
    return text.near_links(_docs(spark, d), "doc_id", text.alphanumeric_tokens(F.col("text")), 0.8)


@query(
    r"WITH s AS (SELECT p_partkey AS id, string_split_regex(lower(p_name), '[^\p{L}\p{N}\s''-]+') AS parts FROM part), c AS (SELECT id, unnest(parts) AS chunk, unnest(range(len(parts))) AS part FROM s), "
    r"w AS (SELECT id, part, list_filter(string_split_regex(chunk, '[ \t\n\r\f\v]+'), lambda q: q <> '') AS ws FROM c), t AS (SELECT id, part, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w), "
    "r AS (SELECT *, word IN ('the', 'of', 'red', 'blue') AS stop, sum((word IN ('the', 'of', 'red', 'blue'))::INT) OVER (PARTITION BY id, part ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM t), "
    "p AS (SELECT id, part, run, list(word ORDER BY pos) AS words FROM r WHERE NOT stop GROUP BY ALL), e AS (SELECT id, word, (sum(size - 1) + count(*)) / count(*) AS score FROM (SELECT id, len(words) AS size, unnest(words) AS word FROM p) GROUP BY ALL), "
    "u AS (SELECT DISTINCT id, words FROM p), x AS (SELECT id, array_to_string(words, ' ') AS phrase, len(words) AS size, unnest(words) AS word FROM u) SELECT id, phrase, round(sum(score) / max(size), 4) AS score FROM x JOIN e USING (id, word) GROUP BY ALL"
)
def text_rake(spark, d):
    return rounded(text.rake(table(spark, d, "part"), "p_partkey", "p_name", ["the", "of", "red", "blue"]))


GAZETTE = "('the of', 'function'), ('the', 'article'), ('is', 'verb'), ('this is', 'phrase'), ('de la', 'function')"


@query(
    "WITH g(name, kind) AS (VALUES " + GAZETTE + "), d AS (SELECT doc_id AS id, " + TOKENS.format(c="text") + " AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM d), "
    "h AS (SELECT id, i - 1 AS start, n, name, kind FROM s JOIN (SELECT *, len(string_split(name, ' ')) AS n FROM g) ON i + n - 1 <= len(w) AND array_to_string(w[i:i + n - 1], ' ') = name QUALIFY row_number() OVER (PARTITION BY id, i ORDER BY n DESC, kind) = 1) SELECT id, kind, count(*) AS n, min(start)::INT AS first FROM h GROUP BY ALL"
)
def text_gazetteer(spark, d):
    entries = spark.createDataFrame([("the of", "function"), ("the", "article"), ("is", "verb"), ("this is", "phrase"), ("de la", "function")], "name string, kind string")
    g = text.gazetteer(_docs(spark, d), "doc_id", text.alphanumeric_tokens(F.col("text")), entries, 2)
    return g.groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"))


@query(
    "WITH t AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'B-c' WHEN 'view' THEN 'I-c' WHEN 'purchase' THEN 'I-p' WHEN 'error' THEN 'O' ELSE 'x' END AS tag FROM events), k AS (SELECT *, CASE WHEN tag IN ('B-c') THEN 'B' WHEN tag LIKE 'I-%' THEN 'I' ELSE 'O' END AS k FROM t), "
    "o AS (SELECT *, CASE WHEN k = 'B' OR (k = 'I' AND coalesce(lag(k) OVER w, 'O') = 'O') THEN 1 ELSE 0 END AS opens FROM k WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS span FROM o) "
    "SELECT user_id, min(event_id) AS start, max(event_id) + 1 AS \"end\", arg_min(substr(tag, 3), event_id) AS label FROM s WHERE k <> 'O' GROUP BY user_id, span"
)
def text_bio_spans(spark, d):
    e = F.col("event_type")
    t = table(spark, d, "events").withColumn("tag", F.when(e == "click", "B-c").when(e == "view", "I-c").when(e == "purchase", "I-p").when(e == "error", "O").otherwise("x"))
    return text.bio_spans(t, ["user_id"], "event_id", "tag")


@query("WITH w AS (SELECT DISTINCT p_type AS word FROM part), x(p) AS (VALUES ('A'), ('EC'), ('ECONOMY'), ('ST'), ('STANDARD A'), ('PROMO')) SELECT word, arg_max(p, length(p)) AS prefix FROM w JOIN x ON starts_with(word, p) GROUP BY ALL")
def text_prefix_lookup(spark, d):
    dictionary = spark.createDataFrame([(p,) for p in ("A", "EC", "ECONOMY", "ST", "STANDARD A", "PROMO")], "p string")
    return text.prefix_lookup(table(spark, d, "part").select(F.col("p_type").alias("word")).distinct(), "word", dictionary, "p")


@query(r"SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '\p{Lu}', 'X', 'g'), '\p{Ll}', 'x', 'g'), '\p{N}', 'd', 'g') AS shape FROM customer")
def text_word_shape(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.word_shape(F.col("c_name")).alias("shape"))


@query("SELECT item_id, len(list_filter(range(length(text) - 1), lambda i: substr(text, i + 1, 2) = 'th'))::BIGINT AS n, coalesce(list_min(list_filter(range(length(text) - 1), lambda i: substr(text, i + 1, 2) = 'th')), -1) AS first FROM benchmark")
def text_match_offsets(spark, d):
    t = table(spark, d, "benchmark").withColumn("at", text.match_offsets(F.col("text"), "th"))
    return t.select("item_id", F.size("at").cast("long").alias("n"), F.coalesce(F.array_min("at").cast("long"), F.lit(-1).cast("long")).alias("first"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_type, b.p_type)::INT AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def text_edit_distance(spark, d):
    p = table(spark, d, "part")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("b"), F.col("p_type").alias("t"))
    return p.join(b, "p_partkey").select(F.col("p_partkey").alias("a"), "b", F.levenshtein("p_type", "t").alias("distance"))


# places of an item's bits, as the operator's hashes of the item's digest
BLOOM_AT = "unnest(list_transform(range(7), lambda k: ((('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT + k * ('0x' || substr(md5(id::VARCHAR), 9, 8))::BIGINT) % 16384)::BIGINT)) AS bit"


@query(
    f"WITH s AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 3 = 0), p AS (SELECT c_custkey AS id FROM customer), bits AS (SELECT DISTINCT bit FROM (SELECT {BLOOM_AT} FROM s)) "
    f"SELECT id, bool_and(bits.bit IS NOT NULL) AS maybe FROM (SELECT id, {BLOOM_AT} FROM p) q LEFT JOIN bits USING (bit) GROUP BY ALL"
)
def text_bloom_members(spark, d):
    held = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id"))
    probes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return text.bloom_contains(probes, F.col("id"), "maybe", text.bloom_filter(held, F.col("id"), 1 << 14, 7), 1 << 14, 7)


@query(
    f"WITH b AS (SELECT item_id, {TOKENS.format(c='text')} AS w FROM benchmark), i AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM b), e AS (SELECT w[i] AS src, unnest(w[i + 1:i + 3]) AS dst FROM i), x AS (SELECT * FROM e WHERE src <> dst), u AS (SELECT src, dst FROM x UNION ALL SELECT dst, src FROM x) SELECT src, dst, count(*) AS n FROM u GROUP BY ALL"
)
def text_cooccurrences(spark, d):
    return text.cooccurrences(table(spark, d, "benchmark"), "item_id", text.alphanumeric_tokens(F.col("text")), 3)


RANK_EDGES = f"b AS (SELECT item_id, {TOKENS.format(c='text')} AS w FROM benchmark), i AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM b), e AS (SELECT w[i] AS src, unnest(w[i + 1:i + 3]) AS dst FROM i), x AS (SELECT * FROM e WHERE src <> dst), edges AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM x UNION ALL SELECT dst, src FROM x))"


@query(f"WITH {RANK_EDGES}, {ranked('edges', 15)} SELECT node, round(rank, 8) AS rank FROM k15")
def text_rank(spark, d):
    from heliograin.operators import graph

    edges = text.cooccurrences(table(spark, d, "benchmark"), "item_id", text.alphanumeric_tokens(F.col("text")), 3).select("src", "dst")
    return rounded(graph.page_rank(edges, rounds=15), 8)


@query(
    f"WITH {COUNTS}, f0 AS (SELECT term, count(*) AS df FROM counts GROUP BY ALL), f AS (SELECT term, df, row_number() OVER (ORDER BY df DESC, term) AS place FROM f0 QUALIFY place <= 12), t AS (SELECT (place % 3)::INT AS topic, place, term, df FROM f), p AS (SELECT id, topic, place, t.term, df FROM counts JOIN t USING (term)), "
    "co AS (SELECT a.topic, a.term AS ta, b.term AS tb, b.df AS df, count(*) AS co FROM p a JOIN p b ON a.id = b.id AND a.topic = b.topic AND a.place < b.place GROUP BY ALL) SELECT topic, round(avg(ln((co + 1) / df)), 6) + 0.0 AS coherence FROM co GROUP BY ALL"
)
def text_coherence(spark, d):
    from pyspark.sql import Window as W

    c = _counts(spark, d)
    v = text.vocabulary(c).orderBy(F.col("df").desc(), "term").limit(12).withColumn("place", F.row_number().over(W.orderBy(F.col("df").desc(), "term")))  # twelve rows
    return rounded(text.coherence(c, v.select((F.col("place") % 3).alias("topic"), "term", "place")), 6)


@query(
    r"WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?\n]+')) AS sentence FROM documents), w AS (SELECT doc_id, list_filter(string_split_regex(sentence, '[ \t\n\r\f\v]+'), lambda w: w <> '') AS w FROM s), "
    "m AS (SELECT doc_id, w, list_min(list_filter(range(1, len(w) - 2), lambda i: lower(w[i + 1]) = 'of' AND lower(w[i + 2]) = 'the')) AS i FROM w) "
    "SELECT doc_id, array_to_string(w[:i], ' ') AS subject, array_to_string(w[i + 3:], ' ') AS object, count(*) AS n FROM m WHERE i IS NOT NULL GROUP BY ALL"
)
def text_relations(spark, d):
    s = _docs(spark, d).select("doc_id", F.explode(F.split("text", r"[.!?\n]+")).alias("sentence"))
    s = s.filter(F.col("sentence").rlike(r"(?i)of[ \t\n\r\f\x0B]+the"))  # no other sentence can match
    # each made once, not once for every use
    w = s.select("doc_id", text._once(text.tokens(F.col("sentence")), "w"))
    found = w.select("doc_id", text._once(text.relation(F.col("w"), "{SUBJ} of the {OBJ}"), "r"))
    return found.filter("r is not null").groupBy("doc_id", "r.subject", "r.object").agg(F.count(F.lit(1)).alias("n"))
