"""The registered queries of the library, and their SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire import shop_queries  # noqa: F401  registers its queries
from quire.functions import text as T
from quire.functions import vectors as V
from quire.operators import chat, consistency, etl, evaluation, qa_pairs, retrieval
from quire.plans import qa
from quire.plans.storage import durable
from quire.registry import ORACLE_SQL, QUERIES, query
from quire.sources import fixtures as X
from quire.sources.fixtures import table
from quire.streaming import trace


def _rounded(c: str | Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


# Self-consistency


def _weights_sql(n: int, weighted: bool, own: bool, rows: str = X.RESPONSES) -> str:
    lp = "list_sum(logprobs[p:p + k - 1])" if weighted else "0.0"
    factor = "* max(L) / coalesce(nullif(max(L) - k - 1, 0), 1)" if n > 1 else ""
    scale = "* exp(max(own))" if own else ""
    return f"""WITH {rows},
grams AS (
  SELECT group_id, resp_id, k, tokens[p:p + k - 1] AS g, {lp}::DOUBLE AS lp, len(tokens)::DOUBLE AS L, list_avg(logprobs) AS own
  FROM (SELECT *, unnest(range(1, len(tokens) - k + 2)) AS p FROM responses, range(1, {n + 1}) t(k) WHERE len(tokens) >= k)),
weights AS (SELECT group_id, resp_id, k, g, avg(exp(lp)) {factor} {scale} AS w FROM grams GROUP BY group_id, resp_id, k, g),
totals AS (SELECT group_id, g, sum(w) AS s FROM weights GROUP BY group_id, g),
vocabulary AS (SELECT group_id, count(*) AS v FROM totals GROUP BY group_id),
scores AS (
  SELECT w.group_id, w.resp_id, sum(w.w * (t.s - w.w)) / (max(v.v) * (max(r.n) - 1)) AS score
  FROM weights w JOIN totals t USING (group_id, g) JOIN vocabulary v USING (group_id) JOIN responses r ON r.group_id = w.group_id AND r.resp_id = w.resp_id
  GROUP BY w.group_id, w.resp_id)"""


def _scores(n: int, weighted: bool, own: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return consistency.consistency_scores(X.responses(spark, sf_dir), n, weighted, own).select("group_id", "resp_id", _rounded("score", "score"))

    return run


for _name, _args in {
    "ngram_consistency_1": (1, False, False), "ngram_consistency_2": (2, False, False), "weighted_ngram_consistency": (2, True, False), "consensus_weighted_ngram": (2, True, True),
}.items():
    QUERIES[_name] = _scores(*_args)
    ORACLE_SQL[_name] = _weights_sql(*_args) + " SELECT group_id, resp_id, round(score, 6) AS score FROM scores"


@query(_weights_sql(1, False, False) + " SELECT group_id, resp_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY group_id ORDER BY round(score, 9) DESC, resp_id DESC) AS INT) AS rank FROM scores")
def self_consistency_rank(spark, sf_dir):
    scores = consistency.consistency_scores(X.responses(spark, sf_dir)).withColumn("score", F.round("score", 9))
    return consistency.ranked(scores).select("group_id", "resp_id", _rounded("score", "score"), "rank")


@query(_weights_sql(2, True, True) + """ SELECT group_id, resp_id, text, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY round(score, 9) DESC, resp_id DESC) AS rank FROM scores) JOIN responses USING (group_id, resp_id) WHERE rank = 1""")
def self_consistency_pick(spark, sf_dir):
    rows = X.responses(spark, sf_dir)
    scores = consistency.consistency_scores(rows, 2, True, True).withColumn("score", F.round("score", 9))
    best = consistency.ranked(scores).where("rank = 1")
    return best.join(rows.select("group_id", "resp_id", "text"), ["group_id", "resp_id"]).select("group_id", "resp_id", "text", _rounded("score", "score"))


@query(_weights_sql(2, False, False) + " SELECT group_id, CAST(v AS BIGINT) AS vocabulary FROM vocabulary")
def ngram_vocab_size(spark, sf_dir):
    return consistency.vocabulary_sizes(X.responses(spark, sf_dir), 2)


_PAIRS = """, pairs AS (SELECT a.group_id, a.resp_id AS i, b.resp_id AS j, sum(a.w * b.w) AS p, count(*) AS common FROM weights a JOIN weights b USING (group_id, g) GROUP BY ALL),
own_size AS (SELECT group_id, resp_id, count(*) AS n FROM weights GROUP BY ALL)"""


@query(_weights_sql(1, True, False) + _PAIRS + " SELECT group_id, i, j, round(p / v, 6) AS score FROM pairs JOIN vocabulary USING (group_id)")
def pair_similarity_matrix(spark, sf_dir):
    return consistency.similarity_matrix(X.responses(spark, sf_dir), 1, True).select("group_id", "i", "j", _rounded("score", "score"))


@query(_weights_sql(1, True, False) + _PAIRS + """ SELECT p.group_id, i, j, round(p / (a.n + b.n - common), 6) AS score
FROM pairs p JOIN own_size a ON a.group_id = p.group_id AND a.resp_id = i JOIN own_size b ON b.group_id = p.group_id AND b.resp_id = j""")
def pair_vocab_similarity(spark, sf_dir):
    return consistency.similarity_matrix(X.responses(spark, sf_dir), 1, True, per_pair=True).select("group_id", "i", "j", _rounded("score", "score"))


@query(f"WITH {X.RESPONSES} SELECT group_id, resp_id, round(exp(list_sum(logprobs) / len(logprobs)), 6) AS probability FROM responses")
def highest_probability(spark, sf_dir):
    return X.responses(spark, sf_dir).select("group_id", "resp_id", _rounded(consistency.mean_probability(F.col("logprobs")), "probability"))


@query(f"""WITH {X.RESPONSES}, docs AS (SELECT group_id, list(text ORDER BY resp_id) AS d FROM responses GROUP BY group_id), s AS (SELECT group_id, d, len(d) // 2 AS m, CAST(i AS INT) AS sample FROM docs, range(9) t(i))
SELECT group_id, sample, array_to_string(CASE WHEN len(d) < 2 OR sample % 3 = 0 THEN d WHEN sample % 3 = 1 THEN list_concat(list_reverse(d[1:m]), list_reverse(d[m + 1:])) ELSE list_reverse(d) END, '|') AS ordered FROM s""")
def alternate_ordering(spark, sf_dir):
    rows = X.responses(spark, sf_dir).groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("resp_id", "text"))), lambda r: r["text"]).alias("d"))
    sampled = consistency.repeat(rows, 9)
    return sampled.select("group_id", "sample", F.array_join(consistency.alternate_ordering(F.col("d"), F.col("sample")), "|").alias("ordered"))


@query(f"""WITH {X.RESPONSES}, g AS (SELECT group_id, list(text ORDER BY resp_id) AS d FROM responses GROUP BY group_id),
said AS (SELECT group_id, d, CASE group_id % 3 WHEN 0 THEN 'So: The most consistent response is Response 1.' WHEN 1 THEN 'The most consistent response is Response 9' ELSE 'none' END AS s FROM g)
SELECT group_id, coalesce(d[TRY_CAST(nullif(regexp_extract(s, 'The most consistent response is Response (\\d+)', 1), '') AS INT) + 1], d[1]) AS answer,
       array_to_string([('Response ' || (i - 1) || ': ' || d[i]) FOR i IN range(1, len(d) + 1)], chr(10) || chr(10)) AS prompt FROM said""")
def select_by_marker(spark, sf_dir):
    rows = X.responses(spark, sf_dir).groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("resp_id", "text"))), lambda r: r["text"]).alias("d"))
    said = F.when(F.col("group_id") % 3 == 0, "So: The most consistent response is Response 1.").when(F.col("group_id") % 3 == 1, "The most consistent response is Response 9").otherwise("none")
    return rows.withColumn("s", said).select("group_id", T.choose("d", T.chosen_index("s")).alias("answer"), T.format_responses("d").alias("prompt"))


@query(f"""{_weights_sql(2, True, True)}, best AS (SELECT group_id, arg_max(resp_id, (round(score, 9), resp_id)) AS resp_id FROM scores GROUP BY group_id)
SELECT group_id AS question_id, text AS answer FROM best JOIN responses USING (group_id, resp_id)""")
def bigram_pick(spark, sf_dir):
    """The answer that agrees most with the others by the bigrams of its tokens; short answers take part."""
    rows = X.responses(spark, sf_dir).select(F.col("group_id").alias("question_id"), F.col("resp_id").alias("sample"), F.lit("").alias("question"), F.col("text").alias("answer"), F.col("text").alias("cot_response"), F.lit("").alias("context"), F.col("tokens").alias("token_ids"), F.col("logprobs").alias("token_logprobs"))
    return qa.pick(rows, "bigram_consistency", None, chat.HashingEmbedder()).select("question_id", "answer")


@query("""SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, max(turn) AS last FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def join_pieces(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return rows.groupBy("conv_id").agg(T.join_pieces("turn", "text").alias("text"), F.max("turn").alias("last"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN NULL ELSE 'none' END AS lang FROM documents""")
def get_or(spark, sf_dir):
    k = F.col("doc_id") % 3
    values = F.when(k == 0, F.create_map(F.lit("lang"), "lang")).when(k == 1, F.create_map(F.lit("lang"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("source"), "source"))
    return table(spark, sf_dir, "documents").select("doc_id", T.get_or(values, "lang", F.lit("none")).alias("lang"))


# Vectors and retrieval

_UNIT = """unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
mean AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS x FROM unit, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)"""
_NEAR = """near AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_sum([(q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE) ** 2 FOR i IN range(1, len(e.embedding) + 1)]), 6) AS distance
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INT) AS rank FROM near) WHERE rank <= 10)"""


def _hits(spark, sf_dir, k: int = 10) -> DataFrame:
    corpus = X.vectors(spark, sf_dir)
    return retrieval.nearest(corpus.where("id % 100 = 0"), corpus, k)


@query(f"WITH {_NEAR} SELECT * FROM hits")
def knn_topk(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(f"""WITH {_NEAR}, parents AS (SELECT query_id, id // 4 AS parent_id, min(rank) AS f FROM hits GROUP BY ALL)
SELECT query_id, parent_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f, parent_id) AS INT) AS rank FROM parents""")
def parent_document_topk(spark, sf_dir):
    corpus = X.vectors(spark, sf_dir).withColumn("parent_id", F.floor(F.col("id") / 4))
    return retrieval.parent_documents(corpus.where("id % 100 = 0"), corpus, 10)


@query(f"""WITH {_NEAR}, first AS (SELECT query_id, id // 4 AS doc_id, min(rank) AS f FROM hits GROUP BY ALL)
SELECT query_id, doc_id, f AS first_rank, length(text) AS n_chars FROM first JOIN documents USING (doc_id)""")
def docstore_lookup(spark, sf_dir):
    first = _hits(spark, sf_dir).groupBy("query_id", F.floor(F.col("id") / 4).alias("doc_id")).agg(F.min("rank").alias("first_rank"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"))
    return retrieval.look_up(first, docs, "doc_id").select("query_id", "doc_id", "first_rank", "n_chars")


@query(f"WITH {_NEAR} SELECT query_id, array_to_string([x FOR x IN list(id ORDER BY rank)[1:5] IF x % 2 = 0], ',') AS kept FROM hits GROUP BY query_id")
def limit_then_filter(spark, sf_dir):
    rows = _hits(spark, sf_dir).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"]).alias("ids"))
    return rows.select("query_id", F.array_join(retrieval.limit_then_filter(F.col("ids"), 5, lambda x: x % 2 == 0), ",").alias("kept"))


@query(f"WITH {_UNIT} SELECT label AS group_id, vec_id AS resp_id, round(list_dot_product(v, c), 6) AS score FROM unit JOIN mean USING (label)")
def avg_similarity_rank(spark, sf_dir):
    return consistency.average_similarity(X.vectors(spark, sf_dir)).select("group_id", "resp_id", _rounded("score", "score"))


@query("""SELECT label AS group_id, CAST(i - 1 AS INT) AS pos, round(avg(embedding[i]::DOUBLE), 6) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i""")
def centroid(spark, sf_dir):
    return V.centroids(X.vectors(spark, sf_dir), "group_id", "vector").select("group_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("""WITH m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)
SELECT label AS group_id, vec_id AS resp_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS score FROM embeddings JOIN m USING (label)""")
def cosine_to_centroid(spark, sf_dir):
    return consistency.cosine_to_centroid(X.vectors(spark, sf_dir)).select("group_id", "resp_id", _rounded("score", "score"))


_TEXT_VECTORS = f"""WITH {X.RESPONSES}, tv AS (SELECT group_id, resp_id, text, exp(list_avg(logprobs)) AS p, embedding::DOUBLE[] AS v FROM responses, (SELECT count(*) AS m FROM embeddings) c, embeddings WHERE vec_id = (group_id * 7 + length(text)) % c.m)"""


def _with_vectors(spark, sf_dir, rows: DataFrame) -> DataFrame:
    """Rows with one of the embeddings each, chosen by their group and their text's length."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return rows.withColumn("vec_id", (F.col("group_id") * 7 + F.length("text")) % e.count()).join(e, "vec_id").drop("vec_id")


def _text_vectors(spark, sf_dir) -> DataFrame:
    return _with_vectors(spark, sf_dir, X.responses(spark, sf_dir))


@query(_TEXT_VECTORS + """, sc AS (SELECT a.group_id, a.resp_id, any_value(a.text) AS text, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS score FROM tv a JOIN tv b USING (group_id) GROUP BY a.group_id, a.resp_id),
best AS (SELECT group_id, (list(text ORDER BY score DESC, text))[1] AS text FROM sc GROUP BY group_id)
SELECT group_id, text, min(resp_id) AS resp_id FROM sc JOIN best USING (group_id, text) GROUP BY ALL""")
def majority_consensus_pick(spark, sf_dir):
    return consistency.majority_consensus(_text_vectors(spark, sf_dir))


@query(_TEXT_VECTORS + """ SELECT a.group_id, a.resp_id AS i, b.resp_id AS j, round(list_dot_product(a.v, b.v) * a.p * b.p, 6) AS score FROM tv a JOIN tv b USING (group_id)""")
def weighted_embedding_similarity(spark, sf_dir):
    return consistency.embedding_matrix(_text_vectors(spark, sf_dir), weighted=True).select("group_id", "i", "j", _rounded("score", "score"))


# Document ETL

_FIXED = X.ELEMENTS + r""",
flags AS (SELECT *, category = 'NarrativeText' AS nt, regexp_matches(text, '[.?!]\)?\s*$') AS se FROM elements),
merges AS (SELECT *, coalesce((nt OR se) AND lag(nt AND NOT se) OVER (PARTITION BY source ORDER BY seq), false) AS merged FROM flags),
runs AS (SELECT *, sum(CASE WHEN merged THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY seq) AS run FROM merges),
fixed AS (SELECT source, min(seq) AS seq, arg_min(category, seq) AS category, arg_min(page_number, seq) AS page_number, string_agg(text, ' ' ORDER BY seq) AS text FROM runs GROUP BY source, run)"""
_SECTIONS = """,
opened AS (SELECT *, coalesce(NOT lag(category = 'Title') OVER w, true) AS after_text, lag(seq) OVER w IS NULL AS head FROM {0} WINDOW w AS (PARTITION BY source ORDER BY seq)),
sectioned AS (SELECT *, CAST(sum(CASE WHEN head OR (category = 'Title' AND {1}) THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY seq) - 1 AS BIGINT) AS section FROM opened)"""
_PAGES = """,
paged AS (SELECT *, first(page_number) OVER (PARTITION BY source, section ORDER BY seq) AS sp FROM sectioned),
page_runs AS (SELECT *, CAST(sum(CASE WHEN sp = before THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY seq) - 1 AS BIGINT) AS page_run FROM (SELECT *, lag(sp) OVER (PARTITION BY source ORDER BY seq) AS before FROM paged))"""


@query(f"WITH {_FIXED} SELECT source, seq, category, page_number, md5(text) AS text_md5 FROM fixed")
def fix_dangling(spark, sf_dir):
    return etl.fix_dangling_sentences(X.elements(spark, sf_dir)).select("source", "seq", "category", "page_number", F.md5("text").alias("text_md5"))


@query(f"WITH {_FIXED}{_SECTIONS.format('fixed', 'after_text')} SELECT source, seq, section FROM sectioned")
def sections(spark, sf_dir):
    return X.elements(spark, sf_dir).transform(etl.fix_dangling_sentences).transform(etl.sections).select("source", "seq", "section")


@query(f"WITH {X.ELEMENTS}{_SECTIONS.format('elements', 'true')} SELECT source, seq, section FROM sectioned")
def sections_every_title(spark, sf_dir):
    return etl.sections(X.elements(spark, sf_dir), every_title=True).select("source", "seq", "section")


@query(f"WITH {X.ELEMENTS}{_SECTIONS.format('elements', 'after_text')}{_PAGES} SELECT source, seq, section, page_run FROM page_runs")
def page_runs(spark, sf_dir):
    return X.elements(spark, sf_dir).transform(etl.sections).transform(etl.page_runs).select("source", "seq", "section", "page_run")


@query(f"""WITH {_FIXED}{_SECTIONS.format('fixed', 'after_text')}{_PAGES},
by_section AS (SELECT source, page_run, section, string_agg(text, chr(10) ORDER BY seq) AS text, arg_min(page_number, seq) AS page_number, min(seq) AS seq FROM page_runs GROUP BY ALL)
SELECT source, page_run, coalesce(arg_min(page_number, seq), -1) AS page_number, md5(string_agg(text, chr(10) || chr(10) ORDER BY section)) AS text_md5 FROM by_section GROUP BY source, page_run""")
def page_documents(spark, sf_dir):
    return etl.elements_to_documents(X.elements(spark, sf_dir)).select("source", "page_run", "page_number", F.md5("text").alias("text_md5"))


@query(f"WITH {X.ELEMENTS} SELECT source, md5(string_agg(text, chr(10) || chr(10) ORDER BY seq)) AS text_md5 FROM elements GROUP BY source")
def combine_documents(spark, sf_dir):
    return etl.file_documents(X.elements(spark, sf_dir)).select("source", F.md5("text").alias("text_md5"))


@query(r"""WITH t AS (SELECT doc_id, string_split_regex(trim(text), '\s+') AS w FROM documents WHERE trim(text) <> '')
SELECT doc_id, CAST(i AS INT) AS chunk_index, md5(array_to_string(w[i * 40 + 1:i * 40 + 50], ' ')) AS chunk_md5
FROM (SELECT doc_id, w, unnest(range(greatest(1, CAST(ceil((len(w) - 10) / 40.0) AS BIGINT)))) AS i FROM t)""")
def token_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("trim(text) <> ''").select("doc_id", "text")
    return etl.token_chunks(docs, F.split(F.trim("text"), r"\s+"), 50, 10).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


@query("""WITH o AS (SELECT doc_id, source, lang, CASE WHEN lag(source) OVER (PARTITION BY lang ORDER BY doc_id) IS NOT DISTINCT FROM source AND lag(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) IS NOT NULL THEN 0 ELSE 1 END AS new FROM documents),
r AS (SELECT *, sum(new) OVER (PARTITION BY lang ORDER BY doc_id) AS run FROM o)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY lang, run ORDER BY doc_id) - 1 AS INT) AS chunk_index FROM r""")
def chunk_index(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("part"))
    return etl.chunk_index(rows, "doc_id").select("doc_id", "chunk_index")


@query("""SELECT doc_id, 'source=' || coalesce(source, 'None') || ';n_chars=' || coalesce(CAST(n_chars AS VARCHAR), 'None') || ';lang=None' AS metadata FROM documents""")
def fix_metadata(spark, sf_dir):
    m = F.create_map(F.lit("source"), F.col("source"), F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("lang"), F.lit(None).cast("string"))
    rows = etl.fix_metadata(table(spark, sf_dir, "documents").select("doc_id", m.alias("metadata")))
    value = lambda k: F.concat(F.lit(f"{k}="), F.col("metadata")[k])
    return rows.select("doc_id", F.concat_ws(";", *[value(k) for k in ("source", "n_chars", "lang")]).alias("metadata"))


# Parsing


@query(f"""WITH {X.QA_TEXTS}, l AS (SELECT doc_id, i, trim(s[i]) AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM qa_texts)) WHERE trim(s[i]) <> ''),
p AS (SELECT *, suffix(line, '?') AS q, sum(CASE WHEN suffix(line, '?') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS pair FROM l),
g AS (SELECT doc_id, CAST(pair AS BIGINT) AS pair, max(CASE WHEN q THEN line END) AS question, coalesce(string_agg(line, ' ' ORDER BY i) FILTER (NOT q), '') AS answer FROM p GROUP BY ALL),
ok AS (SELECT doc_id FROM g GROUP BY doc_id HAVING bool_and(pair > 0 AND answer <> '') AND count(*) = 2)
SELECT doc_id, pair, trim(regexp_replace(trim(regexp_replace(question, '^Q:', '')), '^[0-9]+[.]', '')) AS question,
       trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(answer, '^A:', '')), '^answer:', '')), '^- ', '')) AS answer
FROM g JOIN ok USING (doc_id)""")
def parse_qa_pairs(spark, sf_dir):
    return qa_pairs.parse_qa_pairs(X.qa_texts(spark, sf_dir), "doc_id", 2)


@query(r"""WITH t AS (SELECT doc_id, string_split_regex(trim(text), '\s+') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5('x' || array_to_string(w[1:3], ' ') || '|x' || array_to_string(w[4:], ' ') || '||x' || array_to_string(w, ' ')) AS questions, CAST(4 AS INT) AS n FROM t""")
def parse_questions(spark, sf_dir):
    w = F.split(F.trim("text"), r"\s+")
    join = lambda a, n: F.concat(F.lit("x"), F.array_join(F.slice(w, a, n), " \u00a0 "))
    text = F.concat(F.lit("Here they are:\nQ1: "), join(1, 3), F.lit("\n2. 3: "), join(4, 1 << 30), F.lit(" \n  4. indented\n5. \nnone\n\u0667.\u00a0"), join(1, 1 << 30), F.lit("\u00a0"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.parse_questions(text).alias("q"))
    return rows.select("doc_id", F.md5(F.array_join("q", "|")).alias("questions"), F.size("q").alias("n"))


@query(r"""WITH t AS (SELECT doc_id, md5('x' || rtrim(text, ' ' || chr(9) || chr(10) || chr(13))) AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id, h AS plain, CASE doc_id % 4 WHEN 0 THEN md5('1.') ELSE h END AS stripped FROM t""")
def strip_qa_prefix(spark, sf_dir):
    head = F.concat(F.lit("x"), "text", F.lit("\u00a0"))
    k = F.col("doc_id") % 4
    made = F.when(k == 0, F.lit("1.")).when(k == 1, F.concat(F.lit("Q: 12. "), head)).when(k == 2, F.concat(F.lit("- 3."), head)).otherwise(F.concat(F.lit(" question: answer: "), head))
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.md5(T.strip(head)).alias("plain"), F.md5(T.strip_qa_prefix(made)).alias("stripped"))


@query(r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 12 WHEN 1 THEN 3 END::INT AS i, doc_id % 4 < 3 AS ended FROM documents""")
def any_choice(spark, sf_dir):
    """The first response that a text names, whatever its case, and whether a text ends a sentence before white space of any kind."""
    k = F.col("doc_id") % 4
    said = F.when(k == 0, "None but RESPONSE 12, or response 3.\u00a0").when(k == 1, "The best is Response\u00a03!)\u2003\n").when(k == 2, "Response: none?").otherwise("no response (1) ...:")
    return table(spark, sf_dir, "documents").select("doc_id", T.chosen_index(said, T.ANY_CHOICE_PATTERN).alias("i"), T.has_sentence_end(said).alias("ended"))


@query(r"""SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN trim(text) WHEN 1 THEN trim(text) WHEN 2 THEN 'Answer: ' || trim(text) ELSE text END AS answer FROM conversations WHERE text IS NOT NULL""")
def remove_answer_prefix(spark, sf_dir):
    k = (F.col("conv_id") + F.col("turn")) % 4
    made = F.when(k == 0, F.concat(F.lit("> Answer: "), "text")).when(k == 1, F.concat(F.lit("a:"), "text", F.lit(" "))).when(k == 2, F.concat(F.lit("A: Answer: "), F.trim("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", T.remove_answer_prefix(made).alias("answer"))


@query(r"""SELECT conv_id, turn, string_split(string_split(text, '. ')[1], 'the')[1] AS cut FROM conversations WHERE text IS NOT NULL""")
def stop_truncate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", T.truncate_at_stops("text", [". ", "the"]).alias("cut"))


# Chat

_MESSAGES = "m AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn) AS l FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)"


def _messages(spark, sf_dir) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


@query(f"WITH {_MESSAGES} SELECT conv_id, array_to_string([(upper(x.role[1:1]) || x.role[2:] || ': ' || x.text) FOR x IN l], chr(10)) || chr(10) || 'Assistant:' AS prompt FROM m WHERE l[-1].role = 'user'")
def chat_prompt(spark, sf_dir):
    rows = _messages(spark, sf_dir).where(F.element_at("messages", -1)["role"] == "user")
    return rows.select("conv_id", chat.chat_prompt(F.col("messages")).alias("prompt"))


@query(f"""WITH {_MESSAGES} SELECT conv_id, CASE WHEN l[1].role = 'system' THEN coalesce(l[2].role, 'user') || ':' || l[1].text || CASE WHEN len(l) > 1 THEN chr(10) || chr(10) || l[2].text ELSE '' END ELSE l[1].role || ':' || l[1].text END AS first,
CAST(CASE WHEN l[1].role = 'system' THEN greatest(len(l) - 1, 1) ELSE len(l) END AS INT) AS n FROM m""")
def merge_system(spark, sf_dir):
    merged = _messages(spark, sf_dir).select("conv_id", chat.merge_system(F.col("messages")).alias("m"))
    return merged.select("conv_id", F.concat(F.col("m")[0]["role"], F.lit(":"), F.col("m")[0]["text"]).alias("first"), F.size("m").alias("n"))


@query(f"""WITH {X.RESPONSES}, t AS (SELECT group_id, resp_id, unnest(range(1, len(tokens) + 1)) AS i, tokens, logprobs FROM responses)
SELECT group_id, resp_id, string_agg(tokens[i], ' ' ORDER BY i) AS token_texts, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS token_ids, round(sum(logprobs[i]), 6) AS logprob FROM t WHERE length(tokens[i]) > 2 GROUP BY ALL""")
def token_details(spark, sf_dir):
    detail = F.zip_with("tokens", "logprobs", lambda t, p: F.struct(t.alias("text"), p.alias("logprob")))
    named = F.transform(detail, lambda t, i: F.struct((i + 1).alias("id"), t["text"].alias("text"), t["logprob"].alias("logprob"), (F.length(t["text"]) <= 2).alias("special")))
    rows = X.responses(spark, sf_dir).select("group_id", "resp_id", chat.token_details(named).alias("d")).where(F.size("d.token_ids") > 0)
    total = F.aggregate("d.token_logprobs", F.lit(0.0), lambda s, x: s + x)
    return rows.select("group_id", "resp_id", F.array_join("d.token_texts", " ").alias("token_texts"), F.array_join(F.transform("d.token_ids", lambda x: x.cast("string")), ",").alias("token_ids"), _rounded(total, "logprob"))


@query(f"""WITH {_MESSAGES}, t AS (SELECT conv_id, unnest(range(0, (len(l) + 1) // 2)) AS i, l FROM m)
SELECT conv_id, CAST(i AS INT) AS input, array_to_string([x.text FOR x IN l[i * 2 + 1:i * 2 + 2]], '|') AS generations FROM t""")
def regroup_generations(spark, sf_dir):
    rows = _messages(spark, sf_dir).select("conv_id", chat.regroup(F.transform("messages", lambda m: m["text"]), 2).alias("g"))
    return rows.select("conv_id", F.posexplode("g").alias("input", "x")).select("conv_id", "input", F.array_join("x", "|").alias("generations"))


# Evaluation


def _grades(spark, sf_dir) -> DataFrame:
    return X.grades(spark, sf_dir).withColumn("grade", T.grade("text"))


@query(f"WITH {X.GRADES} SELECT case_id, sample, score, value, reasoning FROM parsed")
def grade_parse(spark, sf_dir):
    return _grades(spark, sf_dir).select("case_id", "sample", F.col("grade.score").alias("score"), F.col("grade.value").alias("value"), F.col("grade.reasoning").alias("reasoning"))


_CONSENSUS = f"""WITH {X.GRADES}, c AS (
  SELECT case_id, coalesce(avg(score), 0.0) AS ratio_correct, arg_min(reasoning, sample) FILTER (score = 1) AS r1, arg_min(reasoning, sample) FILTER (score = 0) AS r0, count(score) AS n FROM parsed GROUP BY case_id),
consensus AS (SELECT case_id, CASE WHEN ratio_correct > 0.5 THEN 1 ELSE 0 END AS score, CASE WHEN ratio_correct > 0.5 THEN 'CORRECT' ELSE 'INCORRECT' END AS value,
  CASE WHEN n = 0 THEN 'No consensus' WHEN ratio_correct > 0.5 THEN r1 ELSE r0 END AS reasoning, round(ratio_correct, 6) AS ratio_correct FROM c)"""


@query(_CONSENSUS + " SELECT * FROM consensus")
def consensus_grade(spark, sf_dir):
    return evaluation.consensus(_grades(spark, sf_dir), "case_id", "sample").withColumn("ratio_correct", F.round("ratio_correct", 6))


@query(_CONSENSUS + " SELECT round(avg(score), 6) AS accuracy, count(*) AS n FROM consensus")
def accuracy(spark, sf_dir):
    return evaluation.accuracy(evaluation.consensus(_grades(spark, sf_dir), "case_id", "sample")).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {X.GRADES} SELECT case_id, array_to_string(['Answer ' || CAST(i AS VARCHAR) || ': ' || l[i] FOR i IN range(1, 6)], chr(10)) AS answers FROM (SELECT case_id, list(text ORDER BY sample) AS l FROM grades GROUP BY case_id)")
def format_answers(spark, sf_dir):
    rows = X.grades(spark, sf_dir).groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "text"))), lambda g: g["text"]).alias("l"))
    return rows.select("case_id", T.format_answers("l").alias("answers"))


@query(f"""WITH {X.GRADES}, e AS (SELECT case_id, CASE WHEN score IS NULL THEN 0 WHEN score = 0 THEN 1 ELSE 2 END AS kind, sample, score FROM parsed)
SELECT case_id, string_agg(sample || ':' || coalesce(CAST(score AS VARCHAR), '-'), ',' ORDER BY kind, sample) AS examples FROM e GROUP BY case_id""")
def preprocess_examples(spark, sf_dir):
    rows = _grades(spark, sf_dir).select("case_id", "sample", F.col("grade.score").alias("s"))
    pick = lambda ok: F.array_sort(F.collect_list(F.when(ok, F.struct("sample", F.lit(None).cast("int").alias("score"), F.lit(None).cast("string").alias("value")))))
    got = rows.groupBy("case_id").agg(pick(F.col("s").isNull()).alias("given"), pick(F.col("s") == 0).alias("wrong"), pick(F.col("s") == 1).alias("right"))
    merged = evaluation.examples_of(F.col("given"), F.col("wrong"), F.col("right"))
    text = F.transform(merged, lambda x: F.concat(x["sample"].cast("string"), F.lit(":"), F.coalesce(x["score"].cast("string"), F.lit("-"))))
    return got.select("case_id", F.array_join(text, ",").alias("examples"))


@query(f"""WITH {_NEAR}, h AS (SELECT query_id AS case_id, rank, (SELECT label FROM embeddings WHERE vec_id = id) = (SELECT label FROM embeddings WHERE vec_id = query_id) AS hit FROM hits),
p AS (SELECT *, sum(hit::INT) OVER (PARTITION BY case_id ORDER BY rank) / rank::DOUBLE AS p FROM h)
SELECT case_id, round(coalesce(sum(p) FILTER (hit) / nullif(sum(hit::INT), 0), 0.0), 6) AS ap FROM p GROUP BY case_id""")
def average_precision(spark, sf_dir):
    label = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = _hits(spark, sf_dir).join(label.withColumnsRenamed({"vec_id": "id", "label": "l"}), "id").join(label.withColumnsRenamed({"vec_id": "query_id", "label": "ql"}), "query_id")
    ranks = hits.select(F.col("query_id").alias("case"), "rank", (F.col("l") == F.col("ql")).alias("hit"))
    return evaluation.average_precision(ranks, "case").select(F.col("case").alias("case_id"), _rounded("ap", "ap"))


_SCORED = f"""WITH {X.LABELLED},
tv AS (SELECT r.*, list_transform(e.embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(e.embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM responses r, (SELECT count(*) AS m FROM embeddings) c, embeddings e WHERE e.vec_id = (r.group_id * 7 + length(r.text)) % c.m),
scaled AS (SELECT group_id, resp_id, n, v, exp(list_avg(logprobs)) AS p FROM tv),
pairs AS (SELECT a.group_id, a.resp_id, any_value(a.n) AS n, sum(list_dot_product(a.v, b.v)) AS plain, sum(list_dot_product(a.v, b.v) * a.p * b.p) AS weighted FROM scaled a JOIN scaled b ON a.group_id = b.group_id AND a.resp_id <> b.resp_id GROUP BY a.group_id, a.resp_id)"""


def _map_sql() -> str:
    parts = [f"SELECT '{name}' AS method, group_id, resp_id, round(score, 9) AS score FROM ({_weights_sql(*args, rows=X.LABELLED)} SELECT * FROM scores)" for name, *args in consistency.METHODS]
    parts.append("SELECT 'probability' AS method, group_id, resp_id, round(exp(list_avg(logprobs)), 9) AS score FROM responses")
    parts += [f"SELECT '{name}' AS method, group_id, resp_id, round({column} / (n - 1), 9) AS score FROM pairs" for name, column in (("embeddings", "plain"), ("weighted_embeddings", "weighted"))]
    return f"""{_SCORED}, every AS ({' UNION ALL '.join(parts)}),
ranks AS (SELECT method, e.group_id, row_number() OVER (PARTITION BY method, e.group_id ORDER BY score DESC, e.resp_id DESC) AS rank, hit FROM every e JOIN responses r ON r.group_id = e.group_id AND r.resp_id = e.resp_id),
p AS (SELECT *, sum(hit::INT) OVER (PARTITION BY method, group_id ORDER BY rank) / rank::DOUBLE AS p FROM ranks),
ap AS (SELECT method, group_id, coalesce(sum(p) FILTER (hit) / nullif(sum(hit::INT), 0), 0.0) AS ap, max(CASE WHEN rank = 1 AND hit THEN 1.0 ELSE 0.0 END)::DOUBLE AS top FROM p GROUP BY ALL)
SELECT method, round(avg(ap), 2) AS map, round(avg(top), 2) AS top_correct FROM ap GROUP BY method"""


def _labelled(spark, sf_dir) -> DataFrame:
    return _with_vectors(spark, sf_dir, evaluation.labelled_answers(X.cases(spark, sf_dir)))


@query(_map_sql())
def map_by_method(spark, sf_dir):
    """The seven ways of ranking, over cases whose answers are labelled good or bad."""
    rows = durable(_labelled(spark, sf_dir), "scored-responses")
    every = consistency.scores_of_all_methods(rows).withColumn("score", F.round("score", 9))
    rank = F.row_number().over(W.partitionBy("method", "group_id").orderBy(F.desc("score"), F.desc("resp_id")))
    hits = rows.select("group_id", "resp_id", "hit")
    return evaluation.mean_average_precision(every.withColumn("rank", rank).join(hits, ["group_id", "resp_id"]).select("method", F.col("group_id").alias("case"), "rank", "hit"))


@query(_SCORED + " SELECT group_id, resp_id, round(plain / (n - 1), 6) AS plain, round(weighted / (n - 1), 6) AS weighted FROM pairs")
def embedding_consistency(spark, sf_dir):
    """How well each labelled answer's vector agrees with the others of its case, by sums; the SQL makes all pairs."""
    rows = _labelled(spark, sf_dir)
    return consistency.embedding_scores_of_both(rows).select("group_id", "resp_id", _rounded("plain", "plain"), _rounded("weighted", "weighted"))


@query("""SELECT CAST(doc_id % 3 AS INT) AS parent_chunk_size, CAST(doc_id % 2 AS INT) AS number_of_docs, count(*) AS runs, round(avg((doc_id % 20) / 20.0::DOUBLE), 6) AS mean_score, max((doc_id % 20) / 20.0::DOUBLE) AS max_score FROM documents GROUP BY ALL""")
def grid_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.format_string('[%s, {"parent_chunk_size": %d, "parent_chunk_overlap": 0, "child_chunk_size": 0, "child_chunk_overlap": 0, "number_of_docs": %d}]', ((F.col("doc_id") % 20) / F.lit(20.0)).cast("string"), F.col("doc_id") % 3, F.col("doc_id") % 2).alias("value"))
    got = evaluation.grid_summary(evaluation.parse_grid_log(lines))
    return got.select("parent_chunk_size", "number_of_docs", "runs", _rounded("mean_score", "mean_score"), "max_score")


# Trace

_RUNS = "runs AS (SELECT event_id AS run_id, CASE WHEN event_id % 6 <> 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS parent_id FROM events)"


@query(f"""WITH RECURSIVE {_RUNS}, walk AS (SELECT run_id, parent_id AS top, CASE WHEN parent_id IS NULL THEN '' ELSE CAST(parent_id AS VARCHAR) END AS path FROM runs
UNION ALL SELECT w.run_id, r.parent_id, CAST(r.parent_id AS VARCHAR) || '/' || w.path FROM walk w JOIN runs r ON w.top = r.run_id WHERE r.parent_id IS NOT NULL)
SELECT run_id, path AS parent_ids FROM (SELECT run_id, path, row_number() OVER (PARTITION BY run_id ORDER BY length(path) DESC) AS n FROM walk) WHERE n = 1""")
def trace_parents(spark, sf_dir):
    before = F.lag("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.when(F.col("event_id") % 6 != 0, before).alias("parent_id"))
    return trace.parent_ids(runs).select("run_id", F.array_join(F.transform("parent_ids", lambda x: x.cast("string")), "/").alias("parent_ids"))


@query("""WITH e AS (SELECT user_id * 1000 + event_id // 500 AS run_id, ts, CASE event_id % 2 WHEN 0 THEN 'start' ELSE 'end' END AS event FROM events),
g AS (SELECT run_id, min(ts) FILTER (event = 'start') AS s, max(ts) FILTER (event = 'end') AS e FROM e GROUP BY run_id)
SELECT run_id, (epoch_us(e) - epoch_us(s)) / 1e6::DOUBLE AS elapsed FROM g WHERE s IS NOT NULL AND e IS NOT NULL""")
def trace_elapsed(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("user_id") * 1000 + F.floor(F.col("event_id") / 500)).alias("run_id"), "ts", F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("event"))
    return trace.elapsed(events)


@query("""SELECT '{"event":"' || event_type || '","run_id":"' || event_id || '","level":"' || CASE event_id % 3 WHEN 1 THEN 'info' ELSE 'error' END || '","user_id":' || user_id || '}' AS value FROM events WHERE event_id % 3 <> 0""")
def trace_render(spark, sf_dir):
    level = F.when(F.col("event_id") % 3 == 0, "debug").when(F.col("event_id") % 3 == 1, "info").otherwise("error")
    return trace.render(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("run_id"), level.alias("level")))


# Not for SQL


@query()
def recursive_chunks(spark, sf_dir):
    return etl.recursive_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), 1000, 200).select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"))


@query()
def kmeans_largest_centroid(spark, sf_dir):
    return consistency.largest_cluster_similarity(X.vectors(spark, sf_dir)).select("group_id", "resp_id", _rounded("score", "score"))


@query()
def kmeans_clusters(spark, sf_dir):
    found = consistency.cluster_centroids(X.vectors(spark, sf_dir)).select("cluster", "size", F.posexplode("centroid").alias("pos", "x"))
    return found.withColumn("x", F.round("x", 6))


@query()
def eliminate_furthest(spark, sf_dir):
    found = consistency.eliminate_furthest(_text_vectors(spark, sf_dir)).select("group_id", F.posexplode("centroid").alias("pos", "x"))
    return found.withColumn("x", F.round("x", 6))


@query()
def multi_vector_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    embedder, model = chat.HashingEmbedder(), chat.EchoModel("Q1: {}")
    chunks, index = qa.build_index(docs, "hypothetical_queries", embedder, model=model, parent_size=200, parent_overlap=20)
    queries = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("id"), chat.embed(embedder, F.col("text")).alias("vector"))
    return retrieval.parent_documents(queries, index, 10)


def _judged(line: str) -> str:
    return "no" if len(line) % 5 == 0 else "yes"


#: A stand-in whose answers show which documents were found, kept and put first, and that they were reworded before they were cut down.
SPEAKER = chat.QuotingModel((("Is this of use", _judged), ("Say this", "> {}".format), ("Extract", "< {}".format), ("Use the rules", str)))
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_VECTOR = f"[(length(t) - length(replace(t, c, '')))::DOUBLE FOR c IN string_split('{','.join(_LETTERS)}', ',')]"
_UNIT_OF = "list_transform(v, lambda x: x / coalesce(nullif(sqrt(list_sum(list_transform(v, lambda y: y * y))), 0), 1))"


@query(rf"""WITH asked AS (SELECT conv_id AS question_id, arg_min(translate(text, chr(10), ' '), turn) AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id),
docs AS MATERIALIZED (SELECT doc_id, regexp_extract(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)), '^[^
]*') AS line, text AS t FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) <> ''),
corpus AS MATERIALIZED (SELECT doc_id || '-0-0' AS id, line, {_UNIT_OF} AS v FROM (SELECT doc_id, line, {_VECTOR} AS v FROM docs)),
posed AS MATERIALIZED (SELECT question_id, {_UNIT_OF} AS q FROM (SELECT question_id, {_VECTOR} AS v FROM (SELECT question_id, question AS t FROM asked))),
near AS (SELECT question_id, id, line, row_number() OVER (PARTITION BY question_id ORDER BY round(list_sum([(q[i] - v[i]) ** 2 FOR i IN range(1, 27)]), 6), id) AS rank FROM posed, corpus),
kept AS (SELECT question_id, list(line ORDER BY rank) AS d FROM near WHERE rank <= 5 AND length(line) % 5 <> 0 GROUP BY question_id),
samples AS (SELECT question_id, question, CAST(s AS INT) AS sample, coalesce(d, []) AS d, len(coalesce(d, [])) // 2 AS m FROM asked LEFT JOIN kept USING (question_id), range(3) t(s)),
ordered AS (SELECT *, CASE WHEN len(d) < 2 OR sample = 0 THEN d WHEN sample = 1 THEN list_concat(list_reverse(d[1:m]), list_reverse(d[m + 1:])) ELSE list_reverse(d) END AS o FROM samples),
answers AS MATERIALIZED (SELECT question_id, question, sample, coalesce('< > ' || o[1], '') AS t FROM ordered),
vectors AS MATERIALIZED (SELECT question_id, question, sample, t, {_UNIT_OF} AS v FROM (SELECT *, {_VECTOR} AS v FROM answers)),
scores AS (SELECT a.question_id, any_value(a.question) AS question, a.t, a.sample, round(avg(list_dot_product(a.v, b.v)), 6) AS score FROM vectors a JOIN vectors b USING (question_id) GROUP BY a.question_id, a.sample, a.t)
SELECT question_id, any_value(question) AS question, arg_min(t, (-score, t)) AS answer FROM scores GROUP BY question_id""")
def qa_pipeline(spark, sf_dir):
    """The whole chain by stand-ins that SQL can follow: retrieval, limit, filter, orders, rewording, then extraction, answers and the pick among them."""
    docs, embedder = table(spark, sf_dir, "documents").where("text is not null"), chat.LetterEmbedder(_LETTERS)
    chunks, index = qa.build_index(docs, "parent_document", embedder, parent_size=1 << 30, parent_overlap=0, child_size=0)
    asked = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").groupBy(F.col("conv_id").alias("question_id")).agg(F.translate(F.min_by("text", "turn"), "\n", " ").alias("question"))
    return qa.answer(asked, chunks, index, SPEAKER, embedder, qa.QaOptions(samples=3, compress=True))
