"""Retrieval, evaluation and index queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.config import DEFAULT
from cairn.operators import dense, evaluate, ranking, sparse
from cairn.plans.retrieval import Pipeline, blocks, chunks, pipeline, with_terms
from cairn.runtime import settle, table


#: What a code in a text looks like.
CODE = "[A-Z0-9]{2,6}-[0-9]{3,5}"


def _visible(spark: SparkSession, sf_dir: str) -> tuple[Pipeline, DataFrame]:
    p = pipeline(spark, sf_dir)
    return p, settle(p.candidates())  # several steps read it; some 60 rows a question


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.term_stats(sparse.tokenized(blocks(spark, sf_dir), "id", "text"))


def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_stats(spark, sf_dir).orderBy(F.desc("df"), "term").limit(20)


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.tokenized(blocks(spark, sf_dir), "id", "text").select("id", "len")


def doc_length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lengths(spark, sf_dir).groupBy((F.floor(F.col("len") / 100) * 100).cast("bigint").alias("bin")).agg(F.count("*").alias("chunks"), F.min("len").alias("least"), F.max("len").alias("most"))


def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sparse.tokenized(blocks(spark, sf_dir), "id", "text")
    frequencies = settle(sparse.document_frequencies(docs))
    return sparse.idf(frequencies, docs.select("id").count()).select("term", F.round("idf", 6).alias("idf"))


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pipeline(spark, sf_dir)
    return p.sparse(p.candidates(acl=False)).select("q_id", "id", "score", "rank")


def sparse_acl_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = _visible(spark, sf_dir)
    return p.sparse(s).select("q_id", "id", "score", "rank")


def overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = _visible(spark, sf_dir)
    return p.overlap(s).select("q_id", "id", "overlap", "rank")


def rrf_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = _visible(spark, sf_dir)
    return p.fused(s)


def rrf_k_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = _visible(spark, sf_dir)
    a, b = (p.fused(s, k).select("q_id", "id", F.col("rank").alias(f"rank_{k}")) for k in (10, 60))
    return a.join(b, ["q_id", "id"], "full_outer")


def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = _visible(spark, sf_dir)
    return p.reranked(s).select("q_id", "id", "relevance", "rank")


def diverse_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = _visible(spark, sf_dir)
    return p.selected(s).select("q_id", "id", "source", "relevance", "rank")


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = _visible(spark, sf_dir)
    return p.expanded(s, table(spark, sf_dir, "documents"))


def parent_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir).select("q_id", "id", "doc_id", "rank", "chars")


def char_pack_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.pack_skipping(_expanded(spark, sf_dir), DEFAULT.context_chars)


def token_pack_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.pack_prefix(_expanded(spark, sf_dir), DEFAULT.context_tokens)


def context_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.render(_expanded(spark, sf_dir))


def sparse_only_degrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = _visible(spark, sf_dir)
    return ranking.fuse([p.sparse(s)], DEFAULT.rrf_k, DEFAULT.pool)


def rerank_degrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = _visible(spark, sf_dir)
    return p.fused(s).filter(F.col("rank") <= DEFAULT.selected)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return dense.nearest(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 10).withColumn("score", F.round("score", 4))


def dense_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    near = dense.nearest(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)
    return near.join(e.select(F.col("vec_id").alias("id"), "label"), "id").groupBy("q_id", "label").agg(F.count("*").alias("votes"))


def dense_in_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors within one label's, as in a search of one document, of which only visible ones count."""
    e = table(spark, sf_dir, "embeddings").withColumn("shown", F.col("vec_id") % 3 != 1)
    return dense.nearest(e.filter("vec_id % 20 = 0"), e.filter("shown"), "vec_id", "embedding", 5, within="label").withColumn("score", F.round("score", 4))


def intent_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best label of each query vector by its nearest example, with the lead over the next label."""
    e = table(spark, sf_dir, "embeddings")
    return dense.label_margin(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", "label").select("q_id", "label", F.round("score", 4).alias("score"), F.round("margin", 4).alias("margin"))


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden questions: of the blocks of every document whose number is divisible by 20, the first code that the block
    holds and the heading it stands under, each with the block's file and that code as anchor; and the first code of
    the document's own text, which was typed at intake and need not be in the file."""
    code = F.regexp_extract("text", CODE, 0)
    d = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0")
    held = table(spark, sf_dir, "parents").filter("parent_id is not null").join(d.select(F.col("doc_ref").alias("doc_id")), "doc_id", "left_semi")
    held = held.groupBy("parent_id").agg(F.min(F.struct("text", "source", "breadcrumb")).alias("r")).select("parent_id", "r.*").withColumn("anchor", code).filter("anchor <> ''")
    heading = F.element_at(F.split("breadcrumb", " > "), -1)
    both = F.array(F.struct(F.lit("code").alias("bucket"), F.col("anchor").alias("question")), F.struct(F.lit("heading").alias("bucket"), heading.alias("question")))
    rows = held.select("parent_id", F.col("source").alias("file"), "anchor", F.inline(both))
    rows = rows.select(F.concat("parent_id", F.lit("/"), "bucket").alias("q_id"), "bucket", "question", "file", "anchor")
    typed = d.withColumn("anchor", code).filter("anchor <> ''")
    typed = typed.select(F.concat("doc_ref", F.lit("/intake")).alias("q_id"), F.lit("intake").alias("bucket"), F.col("anchor").alias("question"), F.col("filename").alias("file"), "anchor")
    return rows.filter("question <> ''").unionByName(typed).withColumn("also_files", F.lit(None).cast("array<string>"))


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Golden questions, their answers, and the chunks found for them."""
    golden = settle(_golden(spark, sf_dir))
    asked = with_terms(golden.select("q_id", "question", F.lit(None).cast("string").alias("tenant_id"), F.lit(None).cast("string").alias("user_id")))
    found = settle(Pipeline(chunks(spark, sf_dir), asked).candidates(acl=False))
    return golden, settle(evaluate.answers(golden, blocks(spark, sf_dir))), found


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rank of an answer in each mode."""
    golden, truth, s = _evaluated(spark, sf_dir)
    p = pipeline(spark, sf_dir)
    modes = {"sparse": p.sparse(s), "overlap": p.overlap(s), "rrf": p.fused(s)}
    return evaluate.first_ranks(golden.select("q_id", "bucket"), truth, modes)


def first_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir).select("q_id", "mode", "positive", "rank")


def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall(_ranks(spark, sf_dir), ["mode"])


def recall_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall_sets(_ranks(spark, sf_dir))


def rerank_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gain(evaluate.recall(_ranks(spark, sf_dir), ["mode"]), "sparse", "rrf")


def misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir).filter("positive and rank is null").select("q_id", "mode")


def score_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden, truth, s = _evaluated(spark, sf_dir)
    best = s.groupBy("q_id").agg(F.max("score").alias("best")).join(truth.select("q_id").distinct().withColumn("positive", F.lit(True)), "q_id", "left")
    return evaluate.separation(best.withColumn("positive", F.coalesce("positive", F.lit(False))))


def anchor_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with golden questions, by bucket."""
    golden = settle(_golden(spark, sf_dir))
    verdicts = evaluate.anchor_verdicts(golden, blocks(spark, sf_dir)).join(golden.select("q_id", "bucket"), "q_id")
    return verdicts.groupBy("bucket", "verdict").agg(F.count("*").alias("questions"))


def golden_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("questions"), F.countDistinct("file").alias("files"))


def intake_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest against results: what was expected of each file, what came of it, and how often that agrees. Expected is
    an error where the file cannot be split (its extension), nothing where it has no text, else blocks or sections."""
    d = table(spark, sf_dir, "documents").select("doc_ref", "filename", "parsed_status", "error_msg", "text")
    made = table(spark, sf_dir, "parents").filter("parent_id is not null").select("doc_id", F.col("parent_id").alias("unit"))
    made = made.unionByName(table(spark, sf_dir, "sections").filter("section_id is not null").select("doc_id", F.col("section_id").alias("unit"))).distinct()
    made = made.groupBy("doc_id").agg(F.count("*").alias("made"))
    expect = F.when(F.lower("filename").rlike(r"\.(txt|md|docx|xlsx|xlsm|pdf)$"), F.when(F.trim("text") == "", "empty").otherwise("ok")).otherwise("fail")
    j = d.join(made, d.doc_ref == made.doc_id, "left").withColumn("expect", expect)
    met = evaluate.expectation_met(F.col("expect"), F.col("parsed_status"), F.col("made"), F.col("error_msg"))
    j = j.withColumn("ok", met)
    totals = F.count("*").alias("files"), F.sum(F.coalesce("made", F.lit(0))).alias("units"), F.sum(F.col("ok").cast("bigint")).alias("as_expected"), F.count("error_msg").alias("errors")
    return j.groupBy("expect", F.col("parsed_status").alias("status")).agg(*totals)


QUERIES = {
    f.__name__: f
    for f in (
        term_stats, top_terms, doc_lengths, doc_length_hist, term_idf, sparse_topk, sparse_acl_topk, overlap_topk, rrf_fused, rrf_k_ablation, rerank_scores, diverse_select, parent_expand,
        char_pack_skip, token_pack_prefix, context_render, sparse_only_degrade, rerank_degrade, dense_topk, dense_label_vote,
        dense_in_document, intent_margin, first_ranks, recall_mrr, recall_by_group, rerank_gain, misses, score_separation, anchor_check, golden_kinds, intake_verdicts,
    )
}


def _tokens(x: str) -> str:
    return f"""list_concat(regexp_extract_all(lower({x}), '[a-z0-9äöüßé]+'), flatten(list_transform(regexp_extract_all({x}, '[一-鿿]+'),
        lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_concat(regexp_extract_all(r, '[一-鿿]{{2}}'), regexp_extract_all(substr(r, 2), '[一-鿿]{{2}}')) END)))"""


_CHUNKS = f"""
c AS (SELECT parent_id AS id, min(doc_id) AS doc_id, min(text) AS text FROM parents WHERE parent_id IS NOT NULL GROUP BY 1),
ch AS (SELECT c.*, d.source, d.status, d.visibility, d.tenant_id, d.owner_id FROM c LEFT JOIN documents d ON d.doc_ref = c.doc_id),
tok AS (SELECT id, {_tokens("text")} AS terms FROM c),
ln AS (SELECT id, coalesce(len(terms), 0)::bigint AS len FROM tok),
post AS (SELECT id, term, count(*)::bigint AS tf FROM (SELECT id, unnest(terms) AS term FROM tok) GROUP BY 1, 2),
st AS (SELECT term, count(*)::bigint AS df, sum(tf)::bigint AS cf FROM post GROUP BY 1),
raw AS (SELECT term, ln((SELECT count(*) FROM c) - df + 0.5) - ln(df + 0.5) AS raw FROM st),
w AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_SCORES = f"""{_CHUNKS},
qq AS (SELECT DISTINCT request_id AS q_id, question, tenant_id AS q_tenant, user_id AS q_user FROM chat_requests WHERE try_cast(substr(request_id, 3) AS bigint) % 20 = 0),
q AS (SELECT *, {_tokens("question")} AS terms FROM qq WHERE len({_tokens("question")}) > 0),
qt AS (SELECT q_id, term, count(*) AS qtf FROM (SELECT q_id, unnest(terms) AS term FROM q) GROUP BY 1, 2),
qn AS (SELECT q_id, count(*) AS n FROM qt GROUP BY 1),
part AS (SELECT post.id, post.term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM ln))) AS part FROM post JOIN w USING (term) JOIN ln ON ln.id = post.id WHERE post.term IN (SELECT term FROM qt)),
sc0 AS (SELECT q_id, id, sum(part * qtf) AS s, count(*) AS hits FROM qt JOIN part USING (term) GROUP BY 1, 2),
sc AS (SELECT q_id, id, round(s, 6) AS score, round(hits / n, 6) AS overlap FROM sc0 JOIN qn USING (q_id))"""
_ACL = """CASE WHEN status = 'published' AND (visibility = 'public' OR (visibility = 'tenant' AND tenant_id = q_tenant) OR (visibility = 'private' AND owner_id = q_user)) THEN true ELSE false END"""


def _channels(acl: bool) -> str:
    source = f"SELECT sc.*, doc_id, source FROM sc JOIN q USING (q_id) JOIN ch USING (id) WHERE {_ACL}" if acl else "SELECT * FROM sc"
    return f"""{_SCORES},
v AS ({source}),
sp AS (SELECT * FROM (SELECT q_id, id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM v) WHERE rank <= 30 AND score > 0),
ov AS (SELECT * FROM (SELECT q_id, id, overlap, row_number() OVER (PARTITION BY q_id ORDER BY overlap DESC, id) AS rank FROM v) WHERE rank <= 30)"""


def _fuse(k: int, lists: str = "SELECT q_id, id, rank FROM sp UNION ALL SELECT q_id, id, rank FROM ov") -> str:
    return f"SELECT * FROM (SELECT q_id, id, rrf, row_number() OVER (PARTITION BY q_id ORDER BY rrf DESC, id)::int AS rank FROM (SELECT q_id, id, round(sum(1.0::double / ({k} + rank)), 9) AS rrf FROM ({lists}) GROUP BY 1, 2)) WHERE rank <= 30"


_RERANK = f"""{_channels(True)},
fu AS ({_fuse(10)}),
rr AS (SELECT q_id, id, doc_id, source, round(10 * overlap, 6) AS relevance, row_number() OVER (PARTITION BY q_id ORDER BY round(10 * overlap, 6) DESC, id)::int AS rank FROM fu JOIN v USING (q_id, id)),
fl AS (SELECT *, max(relevance) OVER (PARTITION BY q_id) AS best FROM rr),
nth AS (SELECT *, row_number() OVER (PARTITION BY q_id, source ORDER BY relevance DESC, id) AS nth FROM fl WHERE best <= 0 OR relevance >= 0.12 * best),
sel0 AS (SELECT q_id, id, doc_id, source, relevance, row_number() OVER (PARTITION BY q_id ORDER BY relevance DESC, id)::int AS rank FROM nth WHERE nth <= 3),
sel AS (SELECT * FROM sel0 WHERE rank <= 10),
fp AS (SELECT *, row_number() OVER (PARTITION BY q_id, doc_id ORDER BY rank) AS f FROM sel WHERE doc_id IS NOT NULL),
ex0 AS (SELECT q_id, id, doc_id, source, row_number() OVER (PARTITION BY q_id ORDER BY rank)::int AS rank FROM fp WHERE f = 1),
ex AS (SELECT ex0.*, coalesce(d.text, c.text) AS context FROM ex0 JOIN c USING (id) LEFT JOIN documents d ON d.doc_ref = ex0.doc_id WHERE rank <= 8)"""
_CODE_SQL = "'[A-Z0-9]{2,6}-[0-9]{3,5}'"
_GOLDEN = f"""
gb AS (SELECT DISTINCT parent_id, text, source, breadcrumb, regexp_extract(text, {_CODE_SQL}, 0) AS anchor FROM parents WHERE doc_id IN (SELECT doc_ref FROM documents WHERE doc_id % 20 = 0) AND parent_id IS NOT NULL),
golden AS (SELECT parent_id || '/code' AS q_id, 'code' AS bucket, anchor AS question, source AS file, anchor FROM gb WHERE anchor <> ''
  UNION ALL SELECT parent_id || '/heading', 'heading', list_last(string_split(breadcrumb, ' > ')), source, anchor FROM gb WHERE anchor <> '' AND breadcrumb <> '' AND list_last(string_split(breadcrumb, ' > ')) <> ''
  UNION ALL SELECT doc_ref || '/intake', 'intake', regexp_extract(text, {_CODE_SQL}, 0), filename, regexp_extract(text, {_CODE_SQL}, 0) FROM documents WHERE doc_id % 20 = 0 AND regexp_extract(text, {_CODE_SQL}, 0) <> ''),
fb AS (SELECT DISTINCT parent_id AS id, text, lower(list_last(string_split(source, '/'))) AS name FROM parents WHERE parent_id IS NOT NULL),
truth AS (SELECT DISTINCT q_id, id FROM golden JOIN fb ON fb.name = lower(list_last(string_split(file, '/'))) AND contains(fb.text, anchor))"""
_FOUND = (
    _CHUNKS
    + f""",{_GOLDEN},
q AS (SELECT q_id, {_tokens("question")} AS terms FROM golden WHERE len({_tokens("question")}) > 0),
qt AS (SELECT q_id, term, count(*) AS qtf FROM (SELECT q_id, unnest(terms) AS term FROM q) GROUP BY 1, 2),
qn AS (SELECT q_id, count(*) AS n FROM qt GROUP BY 1),
part AS (SELECT post.id, post.term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM ln))) AS part FROM post JOIN w USING (term) JOIN ln ON ln.id = post.id WHERE post.term IN (SELECT term FROM qt)),
sc AS (SELECT q_id, id, round(s, 6) AS score, round(hits / n, 6) AS overlap FROM (SELECT q_id, id, sum(part * qtf) AS s, count(*) AS hits FROM qt JOIN part USING (term) GROUP BY 1, 2) JOIN qn USING (q_id)),
sp AS (SELECT * FROM (SELECT q_id, id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 30 AND score > 0),
ov AS (SELECT * FROM (SELECT q_id, id, overlap, row_number() OVER (PARTITION BY q_id ORDER BY overlap DESC, id) AS rank FROM sc) WHERE rank <= 30)"""
)
_RANKS = f"""{_FOUND},
fu AS ({_fuse(10)}),
lists AS (SELECT 'sparse' AS mode, q_id, id, rank FROM sp UNION ALL SELECT 'overlap', q_id, id, rank FROM ov UNION ALL SELECT 'rrf', q_id, id, rank FROM fu),
fr0 AS (SELECT mode, q_id, min(rank) AS rank FROM lists JOIN truth USING (q_id, id) GROUP BY 1, 2),
fr AS (SELECT g.q_id, bucket, m.mode, g.q_id IN (SELECT q_id FROM truth) AS positive, fr0.rank::int AS rank FROM golden g CROSS JOIN (SELECT unnest(['sparse', 'overlap', 'rrf']) AS mode) m LEFT JOIN fr0 ON fr0.q_id = g.q_id AND fr0.mode = m.mode)"""
_AT = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::double ELSE 0 END), 6) AS r_at_{k}" for k in (1, 3, 5, 10, 20))
_METRICS = f"count(*)::bigint AS questions, {_AT}, round(avg(coalesce(1.0::double / rank, 0)), 6) AS mrr, sum(CASE WHEN rank IS NULL THEN 1 ELSE 0 END)::bigint AS misses"
_TOKENS_EST = r"ceil((12 * (length(context) - length(regexp_replace(context, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]', '', 'g'))) + 6 * length(regexp_replace(context, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]', '', 'g'))) / 10)::bigint"
_DENSE_U = """
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v, label FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n, label FROM e)"""
_DENSE = f"""{_DENSE_U},
pr AS (SELECT a.vec_id AS q_id, b.vec_id AS id, b.label, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS score FROM u a, u b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id)::int AS rank FROM pr) WHERE rank <= 10)"""

SQL = {
    "term_stats": f"WITH {_CHUNKS} SELECT term, df, cf FROM st",
    "top_terms": f"WITH {_CHUNKS} SELECT term, df, cf FROM st ORDER BY df DESC, term LIMIT 20",
    "doc_lengths": f"WITH {_CHUNKS} SELECT id, len FROM ln",
    "doc_length_hist": f"WITH {_CHUNKS} SELECT (len // 100 * 100)::bigint AS bin, count(*)::bigint AS chunks, min(len)::bigint AS least, max(len)::bigint AS most FROM ln GROUP BY 1",
    "term_idf": f"WITH {_CHUNKS} SELECT term, round(idf, 6) AS idf FROM w",
    "sparse_topk": f"WITH {_channels(False)} SELECT q_id, id, score, rank::int AS rank FROM sp",
    "sparse_acl_topk": f"WITH {_channels(True)} SELECT q_id, id, score, rank::int AS rank FROM sp",
    "overlap_topk": f"WITH {_channels(True)} SELECT q_id, id, overlap, rank::int AS rank FROM ov",
    "rrf_fused": f"WITH {_channels(True)} {_fuse(10)}",
    "rrf_k_ablation": f"WITH {_channels(True)}, a AS ({_fuse(10)}), b AS ({_fuse(60)}) SELECT coalesce(a.q_id, b.q_id) AS q_id, coalesce(a.id, b.id) AS id, a.rank AS rank_10, b.rank AS rank_60 FROM a FULL JOIN b ON a.q_id = b.q_id AND a.id = b.id",
    "rerank_scores": f"WITH {_RERANK} SELECT q_id, id, relevance, rank FROM rr",
    "diverse_select": f"WITH {_RERANK} SELECT q_id, id, source, relevance, rank FROM sel",
    "parent_expand": f"WITH {_RERANK} SELECT q_id, id, doc_id, rank, length(context)::bigint AS chars FROM ex",
    "char_pack_skip": f"""WITH RECURSIVE {_RERANK},
        f AS (SELECT q_id, 0::bigint AS used, 0 AS rank, NULL::varchar AS id, 0 AS at FROM (SELECT DISTINCT q_id FROM ex)
              UNION ALL
              SELECT f.q_id, CASE WHEN f.used + length(context) <= 6000 THEN f.used + length(context) ELSE f.used END::bigint, CASE WHEN f.used + length(context) <= 6000 THEN ex.rank ELSE 0 END, ex.id, ex.rank
              FROM f JOIN ex ON ex.q_id = f.q_id AND ex.rank = f.at + 1)
        SELECT q_id, id, rank::int AS rank, used FROM f WHERE rank > 0""",
    "token_pack_prefix": f"WITH {_RERANK}, t AS (SELECT q_id, id, rank, {_TOKENS_EST} AS tokens FROM ex), u AS (SELECT *, sum(tokens) OVER (PARTITION BY q_id ORDER BY rank)::bigint AS used FROM t) SELECT * FROM u WHERE used <= 2000",
    "context_render": f"WITH {_RERANK} SELECT q_id, string_agg('[' || rank || '] ' || coalesce(source, '-') || chr(10) || coalesce(context, ''), chr(10) || chr(10) ORDER BY rank) AS context FROM ex GROUP BY 1",
    "sparse_only_degrade": f"WITH {_channels(True)} {_fuse(10, 'SELECT q_id, id, rank FROM sp')}",
    "rerank_degrade": f"WITH {_channels(True)} SELECT * FROM ({_fuse(10)}) WHERE rank <= 10",
    "dense_topk": f"WITH {_DENSE} SELECT q_id, id, round(score, 4) AS score, rank FROM tk",
    "dense_label_vote": f"WITH {_DENSE} SELECT q_id, label, count(*)::bigint AS votes FROM tk GROUP BY 1, 2",
    "first_ranks": f"WITH {_RANKS} SELECT q_id, mode, positive, rank FROM fr",
    "recall_mrr": f"WITH {_RANKS} SELECT mode, {_METRICS} FROM fr WHERE positive GROUP BY mode",
    "recall_by_group": f"WITH {_RANKS} SELECT mode, bucket, {_METRICS} FROM fr WHERE positive GROUP BY GROUPING SETS ((mode, bucket), (mode), ())",
    "rerank_gain": f"""WITH {_RANKS}, m AS (SELECT mode, {_METRICS} FROM fr WHERE positive GROUP BY mode)
        SELECT b.k, b.r AS sparse, a.r AS rrf, round(a.r - b.r, 6) AS gain FROM (SELECT unnest([1, 3, 5, 10, 20])::int AS k, unnest([r_at_1, r_at_3, r_at_5, r_at_10, r_at_20]) AS r FROM m WHERE mode = 'rrf') a
        JOIN (SELECT unnest([1, 3, 5, 10, 20])::int AS k, unnest([r_at_1, r_at_3, r_at_5, r_at_10, r_at_20]) AS r FROM m WHERE mode = 'sparse') b USING (k)""",
    "misses": f"WITH {_RANKS} SELECT q_id, mode FROM fr WHERE positive AND rank IS NULL",
    "score_separation": f"""WITH {_FOUND}, b AS (SELECT q_id, max(score) AS best, q_id IN (SELECT q_id FROM truth) AS positive FROM sc GROUP BY 1)
        SELECT positive, count(*)::bigint AS questions, min(best) AS least, max(best) AS most, list_sort(list(best))[count(*) // 2 + 1] AS upper_median FROM b GROUP BY 1""",
    "anchor_check": f"""WITH {_GOLDEN} SELECT bucket, CASE WHEN q_id IN (SELECT q_id FROM truth) THEN 'ok' WHEN lower(list_last(string_split(file, '/'))) IN (SELECT name FROM fb WHERE name IS NOT NULL) THEN 'no anchor' ELSE 'no file' END AS verdict, count(*)::bigint AS questions
        FROM golden GROUP BY 1, 2""",
    "golden_kinds": f"WITH {_GOLDEN} SELECT bucket, count(*)::bigint AS questions, count(DISTINCT file)::bigint AS files FROM golden GROUP BY 1",
    "intake_verdicts": r"""WITH m AS (SELECT doc_id, count(*) AS made FROM (SELECT doc_id, parent_id FROM parents WHERE parent_id IS NOT NULL UNION SELECT doc_id, section_id FROM sections WHERE section_id IS NOT NULL) GROUP BY 1),
        j AS (SELECT CASE WHEN regexp_matches(lower(filename), '\.(txt|md|docx|xlsx|xlsm|pdf)$') THEN CASE WHEN trim(text, ' ') = '' THEN 'empty' ELSE 'ok' END ELSE 'fail' END AS expect, parsed_status AS status, error_msg, coalesce(made, 0) AS made FROM documents LEFT JOIN m ON m.doc_id = doc_ref)
        SELECT expect, status, count(*)::bigint AS files, sum(made)::bigint AS units, sum(CASE expect WHEN 'ok' THEN (status = 'ok' AND made > 0)::int WHEN 'empty' THEN (status = 'ok' AND made = 0)::int ELSE (status = 'failed' AND error_msg IS NOT NULL)::int END)::bigint AS as_expected, count(error_msg)::bigint AS errors FROM j GROUP BY 1, 2""",
    "dense_in_document": f"""WITH {_DENSE_U}, pr AS (SELECT a.vec_id AS q_id, b.vec_id AS id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS score FROM u a JOIN u b ON a.label = b.label WHERE a.vec_id % 20 = 0 AND b.vec_id % 3 <> 1 AND a.vec_id <> b.vec_id)
        SELECT q_id, id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id)::int AS rank FROM pr) WHERE rank <= 5""",
    "intent_margin": f"""WITH {_DENSE}, l AS (SELECT q_id, label, max(score) AS score FROM pr GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, label) AS n, lead(score) OVER (PARTITION BY q_id ORDER BY score DESC, label) AS next FROM l)
        SELECT q_id, label, round(score, 4) AS score, round(score - coalesce(next, 0), 4) AS margin FROM r WHERE n = 1""",
}
