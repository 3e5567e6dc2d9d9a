"""Retrieval queries: documents and embeddings as chunks, benchmark items as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import retrieval as R
from skein.operators.ann import VectorIndex
from skein.operators.segments import TextIndex
from skein.plans.registry import query
from skein.session import load, new_folder, spread
from skein.sources.store import Files, Store

TOP = 10

# Pieces that the oracles share. q: the questions; t, d: token tables of documents.
_TOKENS = """
q as (select item_id as query_id, text from benchmark),
dt as (select doc_id as id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents),
size as (select id, count(*) as size from dt group by 1),
p as (select id, term, count(*) as n from dt group by 1, 2),
tf as (select p.id, p.term, p.n, size.size, p.n / size.size as tf from p join size using (id)),
total as (select count(*) as total from documents),
idf as (select term, ln((total + 1.0) / (count(*) + 1)) + 1 as idf from p, total group by term, total),
qt as (select query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from q),
qtf as (select query_id, term, count(*) / any_value(s) as tf from qt join (select query_id, count(*) as s from qt group by 1) using (query_id) group by 1, 2),
qw as (select query_id, term, tf * idf as q from qtf join idf using (term)),
ql as (select query_id, sqrt(sum(q * q)) as q_length from qw group by 1),
"""
_SPARSE = (
    _TOKENS
    + """
w as (select id, term, tf * idf as w from tf join idf using (term)),
l as (select id, sqrt(sum(w * w)) as length from w group by 1),
sparse as (select query_id, id as chunk_id, round(sum(w * q) / (any_value(length) * any_value(q_length)), 6) as score
    from w join qw using (term) join l using (id) join ql using (query_id) group by 1, 2 having round(sum(w * q) / (any_value(length) * any_value(q_length)), 6) > 0)
"""
)
_DENSE = """
qv as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id in (select item_id from benchmark)),
dense as (select query_id, vec_id as chunk_id, round(greatest(0, least(1, list_cosine_similarity(q, embedding::double[]))), 6) as score from embeddings, qv
    where round(greatest(0, least(1, list_cosine_similarity(q, embedding::double[]))), 6) > 0)
"""
_TOPPED = "ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from {leg})"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item."""
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with the id of a benchmark item."""
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.join(questions(spark, sf_dir), "query_id", "left_semi")


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """What the documents table looks like from outside: its files with their times, and its size. A table that is written anew looks different."""
    files, path = Files(spark, sf_dir), f"{sf_dir}/documents.parquet"
    return tuple(sorted(files.names(path))), files.size(path)


def _held(spark: SparkSession, sf_dir: str, kind: str, make):
    """An index of a folder's documents, made by the session's first search in them and again once the table has changed."""
    held, state = spark.__dict__.setdefault("_skein_indexes", {}), _state(spark, sf_dir)
    if held.get((kind, sf_dir), (None,))[0] != state:
        held[kind, sf_dir] = (state, make(spread(load(spark, sf_dir, "documents").select("doc_id", "text"))))
    return held[kind, sf_dir][1]


def index(spark: SparkSession, sf_dir: str) -> R.SparseIndex:
    """The stored weights of a folder's documents."""
    return _held(spark, sf_dir, "weights", lambda docs: R.SparseIndex.build(docs, new_folder(spark, "index"), "doc_id"))


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The stored postings of a folder's documents."""

    def make(docs: DataFrame) -> TextIndex:
        made = TextIndex(Store(spark, new_folder(spark, "postings")))
        made.add(docs, "doc_id")
        return made

    return _held(spark, sf_dir, "postings", make)


def sparse(spark: SparkSession, sf_dir: str, among: DataFrame | None = None, limit: int | None = None, best: bool = False) -> DataFrame:
    return index(spark, sf_dir).search(questions(spark, sf_dir), among, limit=limit, best=best)


@query("sparse_index", """with dt as (select doc_id as id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents),
tf as (select id, term, count(*) / any_value(size) as tf from dt join (select id, count(*) as size from dt group by 1) using (id) group by 1, 2),
w as (select id, term, tf, tf * (ln(((select count(*) from documents) + 1.0) / (count(*) over (partition by term) + 1)) + 1) as w from tf)
select id, term, round(w / sqrt(sum(w * w) over (partition by id)), 9) as unit, round(tf / sqrt(sum(tf * tf) over (partition by id)), 9) as raw from w""")
def sparse_index(spark, sf_dir):
    """The postings of an index that is built anew."""
    built = R.SparseIndex.build(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), new_folder(spark, "index"), "doc_id")
    return built.postings.select("id", "term", F.round("unit", 9).alias("unit"), F.round("raw", 9).alias("raw"))


def dense(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    return R.dense_search(query_vectors(spark, sf_dir), load(spark, sf_dir, "embeddings"), "vec_id", limit=limit)


@query("sparse_tfidf_topk", f"with {_SPARSE}, {_TOPPED.format(leg='sparse')} select query_id, chunk_id, score, rank from ranked where rank <= {TOP}")
def sparse_tfidf_topk(spark, sf_dir):
    return R.top_k(sparse(spark, sf_dir, limit=TOP), TOP)


@query("sparse_raw_tf_topk", f"""with {_TOKENS} l as (select id, sqrt(sum(tf * tf)) as length from tf group by 1),
s as (select query_id, id as chunk_id, round(sum(tf.tf * q) / (any_value(length) * any_value(q_length)), 6) as score from tf join qw using (term) join l using (id) join ql using (query_id) group by 1, 2),
ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s where score > 0)
select query_id, chunk_id, score, rank from ranked where rank <= {TOP}""")  # fmt: skip
def sparse_raw_tf_topk(spark, sf_dir):
    return R.top_k(index(spark, sf_dir).search(questions(spark, sf_dir), raw_document_tf=True, limit=TOP), TOP)


@query("term_frequency", """with dt as (select doc_id as id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents),
s as (select id, count(*) as size from dt group by 1) select id, term, count(*) as n, any_value(size) as size, round(count(*) / any_value(size), 9) as tf from dt join s using (id) group by 1, 2""")  # fmt: skip
def term_frequency(spark, sf_dir):
    return R.postings(load(spark, sf_dir, "documents"), "doc_id").withColumn("tf", F.round("tf", 9)).withColumn("size", F.col("size").cast("long"))


@query("inverse_document_frequency", """with p as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents)
select term, count(*) as df, round(ln(((select count(*) from documents) + 1.0) / (count(*) + 1)) + 1, 6) as idf from p group by 1""")  # fmt: skip
def inverse_document_frequency(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return R.inverse_frequency(R.postings(docs, "doc_id"), docs.count()).withColumn("idf", F.round("idf", 6))


@query("chunk_share_idf", """with c as (select doc_id * 10 + 0 as id, source, text from documents), p as (select distinct id, source, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from c),
s as (select source, count(*) as chunks from c group by 1), f as (select source, term, count(*) / any_value(chunks) as share from p join s using (source) group by 1, 2)
select term, round(ln(((select count(*) from s) + 1.0) / (sum(share) + 1)) + 1, 6) as idf from f group by 1""")  # fmt: skip
def chunk_share_idf(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select((F.col("doc_id") * 10).alias("id"), F.col("source").alias("doc_id"), "text")
    return R.chunk_share_idf(R.postings(docs, "id"), docs.select("id", "doc_id")).withColumn("idf", F.round("idf", 6))


@query("dense_cosine_topk", f"with {_DENSE}, {_TOPPED.format(leg='dense')} select query_id, chunk_id, score, rank from ranked where rank <= {TOP}")
def dense_cosine_topk(spark, sf_dir):
    return R.top_k(dense(spark, sf_dir, TOP), TOP)


@query("vector_index_recall", "select count(*) as queries, least(10, (select count(*) from embeddings)) * count(*) as wanted, true as recall_is_enough, true as cells_are_left_out from embeddings where vec_id % 50 = 0")
def vector_index_recall(spark, sf_dir):
    """The ten nearest of every vector whose id is divisible by 50, by the stored index and by the exact scan: whether nine in ten are found without asking all cells."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = VectorIndex.build(spread(vectors), new_folder(spark, "vectors"), "vec_id", parts=32)  # codes of fewer parts need a longer short list, the more vectors there are
    cells = len(index.quantiser.cells)
    probes = max(1, int(0.7 * cells))  # these vectors lie nearly evenly around their centres: fewer cells find less than nine in ten
    exact = R.top_k(R.dense_search(asked, vectors, "vec_id", limit=10), 10).select("query_id", "chunk_id")
    found = index.search(asked, 10, probes, 200).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "chunk_id"], "left").agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("hits"))
    return both.select("queries", "wanted", (F.col("hits") >= 0.9 * F.col("wanted")).alias("recall_is_enough"), F.lit(probes < cells).alias("cells_are_left_out"))


@query("vector_distance_by_label", """with q as (select embedding::double[] as q from embeddings where vec_id = 0),
d as (select vec_id, label, round(1 - list_cosine_similarity(q, embedding::double[]), 6) as distance from embeddings, q where label = 3 and embedding is not null)
select vec_id, label, distance, round(greatest(0, 1 - distance), 6) as score from d order by distance, vec_id limit 10""")  # fmt: skip
def vector_distance_by_label(spark, sf_dir):
    from skein.functions.scores import distance_score
    from skein.functions.vectors import cosine

    vectors = load(spark, sf_dir, "embeddings")
    q = vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))
    near = vectors.where("label = 3 and embedding is not null").crossJoin(F.broadcast(q)).select("vec_id", "label", F.round(1 - cosine(F.col("q"), F.col("embedding")), 6).alias("distance"))
    return near.orderBy("distance", "vec_id").limit(10).withColumn("score", F.round(distance_score(F.col("distance")), 6))


_HYBRID = f"""{_SPARSE}, {_DENSE},
h as (select query_id, chunk_id, round(case when d.score is not null and s.score is not null then d.score * 0.7 + s.score * 0.3 else coalesce(d.score, s.score) end, 7) as score,
    case when d.score is not null and s.score is not null then 'hybrid' when d.score is not null then 'embedding' else 'tfidf' end as method from dense d full join sparse s using (query_id, chunk_id))"""


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both legs have six digits, so their weighted sum has seven and no rounding falls between two values."""
    return R.hybrid(dense(spark, sf_dir), sparse(spark, sf_dir)).withColumn("score", F.round("score", 7))


@query("hybrid_merge", f"with {_HYBRID}, {_TOPPED.format(leg='h')} select query_id, chunk_id, score, method, rank from ranked where rank <= {TOP}")
def hybrid_merge(spark, sf_dir):
    return R.top_k(hybrid(spark, sf_dir), TOP)


@query("min_score_filter", f"with {_HYBRID} select query_id, chunk_id, score, method from h where score >= 0.2")
def min_score_filter(spark, sf_dir):
    return hybrid(spark, sf_dir).where("score >= 0.2")


@query("mqe_max_merge", f"""with {_SPARSE}, m as (select chunk_id, max(score) as best, count(*) as hits from sparse group by 1)
select chunk_id, round(best * least(1.5::double, 1::double + 0.15::double * (hits - 1)), 8) as score, hits from m""")  # fmt: skip
def mqe_max_merge(spark, sf_dir):
    got = R.multi_query_merge(sparse(spark, sf_dir).withColumn("method", F.lit("tfidf")))
    return got.select("chunk_id", F.round("score", 8).alias("score"), "hits")


@query("expanded_search", f"""with {_SPARSE}, {_TOPPED.format(leg='sparse')}, b as (select chunk_id, max(score) as score from ranked where rank <= greatest(1, {4 * TOP} // (select count(*) from benchmark)) group by 1)
select chunk_id, score from b order by score desc, chunk_id limit {TOP}""")  # fmt: skip
def expanded_search(spark, sf_dir):
    return R.expanded_merge(sparse(spark, sf_dir, limit=4 * TOP), TOP, questions(spark, sf_dir).count())


@query("rrf_fusion", f"""with {_SPARSE}, {_TOPPED.format(leg='sparse')}, f as (select chunk_id, round(sum(1.0::double / (rank - 1 + 60)), 9) as score from ranked where rank <= 50 group by 1)
select chunk_id, score from f""")  # fmt: skip
def rrf_fusion(spark, sf_dir):
    return R.rank_fusion(R.top_k(sparse(spark, sf_dir, limit=50), 50).drop("rank")).withColumn("score", F.round("score", 9))


@query("hybrid_rank_fusion", f"""with {_SPARSE}, {_DENSE}, legs as (select query_id, chunk_id, score, 'd' as leg from dense union all select query_id, chunk_id, score, 's' from sparse),
r as (select *, row_number() over (partition by query_id, leg order by score desc, chunk_id) as rank from legs)
select query_id, chunk_id, round(sum(1.0::double / (rank - 1 + 60)), 9) as score from r where rank <= 20 group by 1, 2""")  # fmt: skip
def hybrid_rank_fusion(spark, sf_dir):
    tagged = lambda df, leg: R.top_k(df, 20).drop("rank").withColumn("leg", F.lit(leg))
    legs = tagged(dense(spark, sf_dir, 20), "d").unionByName(tagged(sparse(spark, sf_dir, limit=20), "s"))
    from pyspark.sql import Window

    ranked = legs.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "leg").orderBy(F.col("score").desc(), "chunk_id")) - 1)
    return ranked.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.lit(1.0) / (F.col("r") + 60.0)), 9).alias("score"))


@query("hyde_union", f"""with {_SPARSE}, {_TOPPED.format(leg='sparse')}, legs as (select chunk_id, score, case when query_id = 1 then 0 else 1 end as leg from ranked where query_id in (0, 1) and rank <= {TOP}),
f as (select *, row_number() over (partition by chunk_id order by leg, score desc) as r from legs)
select chunk_id, score, leg, row_number() over (order by leg, score desc, chunk_id) as position from f where r = 1""")  # fmt: skip
def hyde_union(spark, sf_dir):
    top = R.top_k(index(spark, sf_dir).search(questions(spark, sf_dir).where("query_id in (0, 1)"), limit=TOP), TOP)
    return R.hypothetical_union(top.where("query_id = 1").select("chunk_id", "score"), top.where("query_id = 0").select("chunk_id", "score"))


@query("node_dedup", f"with {_SPARSE} select chunk_id, max(score) as score from sparse group by 1")
def node_dedup(spark, sf_dir):
    return R.best_of_each(sparse(spark, sf_dir, best=True)).select("chunk_id", "score")


@query("bm25_topk", f"""with {_TOKENS} f as (select count(*) as n, (select avg(coalesce(size, 0)) from documents left join size on id = doc_id) as mean from documents),
i as (select term, ln(1 + (f.n - count(*) + 0.5) / (count(*) + 0.5)) as idf from p, f group by term, f.n),
s as (select query_id, tf.id as chunk_id, round(sum(idf * tf.n * 2.5 / (tf.n + 1.5 * (0.25 + 0.75 * size / mean))), 6) as score from tf join i using (term) join (select distinct query_id, term from qt) using (term), f group by 1, 2),
ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s where score > 0)
select query_id, chunk_id, score, rank from ranked where rank <= {TOP}""")  # fmt: skip
def bm25_topk(spark, sf_dir):
    return text_index(spark, sf_dir).bm25_top(questions(spark, sf_dir), TOP)


@query("keyword_score", """with q as (select text as q from benchmark where item_id = 3), c as (select doc_id, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as c, list_distinct(regexp_extract_all(lower(q), '[a-z0-9]+')) as k, q from documents, q)
select doc_id, round(case when len(c) = 0 or len(k) = 0 then 0 else least(1.0, len(list_intersect(c, k)) / len(list_distinct(list_concat(c, k))) + case when contains(lower(text), lower(q)) then 0.15 else 0 end) end, 6) as score from c""")  # fmt: skip
def keyword_score(spark, sf_dir):
    q = F.broadcast(load(spark, sf_dir, "benchmark").where("item_id = 3").select(F.col("text").alias("q")))
    return load(spark, sf_dir, "documents").crossJoin(q).select("doc_id", F.round(T.keyword_score(F.col("q"), F.col("text")), 6).alias("score"))


@query("memory_relevance", """with q as (select text as q from benchmark where item_id = 5), c as (select doc_id, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as c, list_distinct(regexp_extract_all(lower(q), '[a-z0-9]+')) as k, q from documents, q)
select doc_id, round(case when len(c) = 0 or len(k) = 0 then 0 else least(1.0, len(list_intersect(c, k)) / len(list_distinct(list_concat(c, k))) + case when contains(lower(text), lower(q)) then 0.1 else 0 end) end, 6) as score from c""")  # fmt: skip
def memory_relevance(spark, sf_dir):
    q = F.broadcast(load(spark, sf_dir, "benchmark").where("item_id = 5").select(F.col("text").alias("q")))
    return load(spark, sf_dir, "documents").crossJoin(q).select("doc_id", F.round(T.memory_relevance(F.col("q"), F.col("text")), 6).alias("score"))


@query("coverage_relevance", """with q as (select regexp_extract_all(lower(text), '[a-z0-9]+') as k from benchmark where item_id = 3), c as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as c, k from documents, q)
select doc_id, round(len(list_filter(k, lambda t: list_contains(c, t))) / len(k), 6) as score from c""")  # fmt: skip
def coverage_relevance(spark, sf_dir):
    q = F.broadcast(load(spark, sf_dir, "benchmark").where("item_id = 3").select(F.col("text").alias("q")))
    return load(spark, sf_dir, "documents").crossJoin(q).select("doc_id", F.round(T.coverage(F.col("q"), F.col("text")), 6).alias("score"))


@query("filter_then_search", f"with {_SPARSE}, {_TOPPED.format(leg='f')[:-1].replace('from f', 'from (select s.* from sparse s join documents d on d.doc_id = s.chunk_id where d.lang = ' + chr(39) + 'en' + chr(39) + ' and d.source in (' + chr(39) + 'src1' + chr(39) + ',' + chr(39) + 'src2' + chr(39) + ',' + chr(39) + 'src3' + chr(39) + ')) f')}) select query_id, chunk_id, score, rank from ranked where rank <= {TOP}")
def filter_then_search(spark, sf_dir):
    chosen = load(spark, sf_dir, "documents").where("lang = 'en' and source in ('src1', 'src2', 'src3')").select(F.col("doc_id").alias("chunk_id"))
    return R.top_k(sparse(spark, sf_dir, chosen, TOP), TOP)


@query("citation_context", f"""with {_SPARSE}, {_TOPPED.format(leg='sparse')}
select query_id, string_agg('[' || rank || '] ' || substr(text, 1, 120) || case when length(text) > 120 then '...' else '' end, chr(10) order by rank) as context from ranked join documents on doc_id = chunk_id where rank <= 3 group by 1""")  # fmt: skip
def citation_context(spark, sf_dir):
    best = R.top_k(sparse(spark, sf_dir, limit=3), 3)
    best = F.broadcast(best) if R.few(questions(spark, sf_dir), R.BROADCAST_ROWS // 3) else best  # three rows a question at most
    top = best.join(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), T.clip(F.col("text"), 120).alias("text")), "chunk_id")  # no whole text is moved
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return top.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("context"))
