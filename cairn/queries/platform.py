"""Replies, accounts, catalogue upkeep, section assembly and packing over rows derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import replies
from cairn.functions import text as tx
from cairn.operators import accounts, catalog, ranking, screening, structure
from cairn.runtime import table

DAY = 86_400_000_000


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, request_id, question): every request once, with its number."""
    c = table(spark, sf_dir, "chat_requests").select("request_id", "question").distinct()
    return c.withColumn("n", F.expr("try_cast(substr(request_id, 3) as bigint)")).filter("n is not null")


def reply_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scores out of replies in four shapes: JSON objects, JSON numbers, words, and nothing usable."""
    n = F.col("n")
    a, b = n % 11, n % 100
    said = F.when(n % 4 == 0, F.format_string('```json\n{"scores": [{"index": 2, "score": %d}, {"id": 1, "relevance": %d}]}\n```', a, b))
    said = said.when(n % 4 == 1, F.format_string('{"results": [%d, -1, %d.5]}', b, a)).when(n % 4 == 2, F.format_string("index: 3, score: %d\nindex：1， score：%d", a, b))
    s = replies.scores(said.otherwise("sorry"), 3)
    return _questions(spark, sf_dir).select("request_id", *(F.round(s[i], 4).alias(f"score_{i + 1}") for i in range(3)))


def reply_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.regexp_replace(F.coalesce("question", F.lit("")), '[\\s"\'“”‘’《》「」:：]', "")
    said = F.when(F.col("n") % 3 == 0, F.concat(F.lit("\n  改写后：“"), q, F.lit("”\nmore"))).when(F.col("n") % 3 == 1, F.concat(F.lit("Question: "), q)).otherwise(q)
    return _questions(spark, sf_dir).select("request_id", replies.first_line(said).alias("line"))


def reply_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a message out of a reply, at most two of them, and how many were left out."""
    n = F.col("n")
    said = F.when(n % 4 == 0, F.format_string('```json\n["part %d", " ", "b", "c"]\n```', n)).when(n % 4 == 1, F.format_string("the parts are “one %d” and “two”", n))
    said = said.when(n % 4 == 2, F.lit("[]")).otherwise(F.lit(None))
    c = replies.capped(replies.sub_questions(said), 2)
    return _questions(spark, sf_dir).select("request_id", F.array_join(c["kept"], "|").alias("parts"), c["dropped"].alias("dropped"))


def call_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of calls with the limit asked for, kept between 1 and 10; no call where they are no JSON."""
    n = F.col("n")
    said = F.when(n % 3 == 0, F.format_string('{"query": "q%d", "top_k": %d}', n, n % 25 - 3)).when(n % 3 == 1, F.format_string('{"query": "q%d", "top_k": "many"}', n)).otherwise("{broken")
    m = replies.arguments(said)
    return _questions(spark, sf_dir).select("request_id", m["query"].alias("query"), replies.clamped(m["top_k"], 1, 10, 5).alias("top_k"))


def question_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that say something, ids from outside that are safe, and errors about length, by channel-like group."""
    n = F.col("n")
    raw = F.when(n % 3 == 0, F.concat(F.lit("id "), F.col("request_id"))).otherwise(F.concat(F.lit("id."), F.col("request_id")))
    error = F.when(n % 5 == 0, "Maximum context length is 8192").when(n % 5 == 1, "token limit").otherwise("bad key")
    q = _questions(spark, sf_dir).select(
        (n % 5).alias("kind"), replies.says_something(F.col("question")).alias("says"), replies.request_id(raw).isNotNull().alias("safe"), replies.is_overflow(error, F.when(n % 2 == 0, 400).otherwise(500)).alias("over")
    )
    return q.groupBy("kind").agg(*(F.sum(F.col(c).cast("bigint")).alias(c) for c in ("says", "safe", "over")))


def image_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that blocks refer to and their links cut to base names; and which blocks with a picture are scans. Links are put into the blocks, which have none."""
    p = table(spark, sf_dir, "parents").filter("parent_id is not null").groupBy("parent_id").agg(F.min(F.struct("source", "order_idx", "text")).alias("r")).select("parent_id", "r.*")
    text = F.concat(F.lit("see ![a]("), F.regexp_replace("source", "[()]", ""), F.lit("/p"), F.col("order_idx").cast("string"), F.lit(".png) and ![](x.jpg)"))
    scan = replies.is_scanned_page(F.col("text"), F.col("order_idx") % 2 == 0)
    return p.filter("order_idx is not null and source is not null").select("parent_id", F.array_join(replies.image_names(text), "|").alias("names"), replies.image_links(text).alias("links"), scan.alias("scan"))


def masked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers masked, routes and roles of the users."""
    u = table(spark, sf_dir, "users").filter("user_id is not null").select("user_id", "username", "customer_id", "role").distinct()
    return u.select(
        "user_id", replies.phone_masked(F.col("username")).alias("masked"), replies.route_label(F.col("customer_id"), F.col("username")).alias("label"), accounts.has_role(F.col("role"), "operator").alias("may_operate")
    )


def account_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = accounts.lockouts(e, "user_id", "ts", "event_id", ~F.col("event_type").isin("purchase", "signup"), 5, 300_000_000)
    return a.select("event_id", "failures", (F.col("locked_until") - F.unix_micros(F.col("ts").cast("timestamp"))).alias("locked_for_us"))


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of tokens: one token of a user for each four days, good for three."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    begin = F.floor(us / (4 * DAY)) * (4 * DAY)
    e = table(spark, sf_dir, "events").filter("event_type <> 'view'")
    return e.select(
        "user_id", "event_id", "ts", F.concat_ws("/", "user_id", begin.cast("string")).alias("token"), F.timestamp_micros(begin).cast("timestamp_ntz").alias("issued"), F.timestamp_micros(begin + 3 * DAY).cast("timestamp_ntz").alias("expires")
    )


def token_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.rotations(_uses(spark, sf_dir), "user_id", "token", "ts", "event_id", "issued", "expires")


def token_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.consumers(_uses(spark, sf_dir), "token", "ts", "event_id", "expires").select("token", "event_id")


def token_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _uses(spark, sf_dir).select("token", "expires").distinct()
    return accounts.purged(t, "expires", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 2)


def publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document archived, every other third published by its owner, the rest as it is."""
    d = table(spark, sf_dir, "documents").select("doc_id", "status", "published_at", "published_by", "owner_id")
    to = F.when(F.col("doc_id") % 3 == 0, "archived").when(F.col("doc_id") % 3 == 1, "published")
    out = catalog.with_status(d, to, F.coalesce("owner_id", F.lit("system")), F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    return out.select("doc_id", "status", "published_by", "published_at")


def access_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access entries of published documents put into the metadata of their files' blocks."""
    p = table(spark, sf_dir, "parents").filter("parent_id is not null").select("parent_id", "doc_id").distinct()
    p = p.withColumn("meta", F.create_map(F.lit("status"), F.lit("draft"), F.lit("doc"), F.col("doc_id")))
    d = table(spark, sf_dir, "documents").filter("status = 'published' and visibility is not null")
    a = catalog.checked_access(F.col("status"), F.col("visibility"))
    c = d.select(F.col("doc_ref").alias("doc_id"), F.create_map(F.lit("status"), a["status"], F.lit("visibility"), a["visibility"]).alias("meta"))
    m = catalog.merged_meta(p, c, "doc_id")
    return m.select("parent_id", *(F.col("meta")[k].alias(k) for k in ("doc", "status", "visibility")))


def listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.listed(table(spark, sf_dir, "documents"), status="published", tenant="t_main", limit=100).select("doc_id", "uploaded_at")


def resume_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return catalog.still_to_do(d.select("filename").filter("filename is not null").distinct(), d.select("filename", F.col("parsed_status").alias("status")), "filename")


def assembled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "parents").filter("parent_id is not null").groupBy("parent_id").agg(F.min("text").alias("text"))
    return structure.assembled(b, "parent_id").withColumn("nth", F.col("nth").cast("bigint"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of a file as a ranked list, the largest page first."""
    p = table(spark, sf_dir, "parents").filter("parent_id is not null and doc_id is not null")
    p = p.groupBy("parent_id").agg(F.min(F.struct("doc_id", "order_idx", "text", "breadcrumb", "source", "page_start")).alias("r")).select("parent_id", "r.*")
    w = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("order_idx"), "parent_id")
    return p.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").withColumnRenamed("doc_id", "q_id")


def pack_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 700 tokens hold of the first ten blocks of every file."""
    return ranking.pack_whole(_ranked(spark, sf_dir), 700, "text")


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranked(spark, sf_dir)
    return r.select("parent_id", replies.source_label(F.col("breadcrumb"), F.col("source"), F.col("page_start")).alias("label"), tx.estimated_tokens(F.col("text")).alias("tokens"))


def knowledge_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of what the knowledge base has, by tenant of the document."""
    d = table(spark, sf_dir, "documents").select("doc_ref", "tenant_id", "status", "parsed_status")
    p = table(spark, sf_dir, "parents").filter("parent_id is not null").groupBy("doc_id").agg(F.countDistinct("parent_id").alias("blocks"))
    j = d.join(p, d.doc_ref == p.doc_id, "left")
    shown, failed = (F.sum(F.coalesce(c, F.lit(False)).cast("bigint")) for c in (F.col("status") == "published", F.col("parsed_status") == "failed"))
    return j.groupBy("tenant_id").agg(F.count("*").alias("documents"), shown.alias("published"), failed.alias("failed"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"))


def document_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of every document beside its name and access columns."""
    p = table(spark, sf_dir, "parents").filter("parent_id is not null").select("doc_id", "breadcrumb", "order_idx").distinct()
    d = table(spark, sf_dir, "documents").select(F.col("doc_ref").alias("doc_id"), "filename", "status", "visibility")
    return structure.outline(p, "doc_id", "breadcrumb", "order_idx").join(d, "doc_id").select("doc_id", "filename", "status", "visibility", "nth", F.col("breadcrumb").alias("path"))


def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads refused by reason; sizes are the characters of the text, with 5000 as the most."""
    d = table(spark, sf_dir, "documents").select(F.explode(screening.upload_refusals(F.col("filename"), F.col("n_chars"), 5000)).alias("reason"))
    return d.groupBy("reason").agg(F.count("*").alias("files"))


QUERIES = {
    f.__name__: f
    for f in (
        reply_scores, reply_lines, reply_questions, call_arguments, question_guards, image_references, masked_names, account_locks, token_rotation, token_winners, token_purge, publication, access_merge,
        listed_documents, resume_list, assembled_sections, pack_notices, source_labels, knowledge_status, document_outline, upload_checks,
    )
}

_Q = "q AS (SELECT DISTINCT request_id, question, try_cast(substr(request_id, 3) AS bigint) AS n FROM chat_requests WHERE try_cast(substr(request_id, 3) AS bigint) IS NOT NULL)"
_P = "b AS (SELECT DISTINCT parent_id, doc_id, source, breadcrumb, page_start, order_idx, text FROM parents WHERE parent_id IS NOT NULL)"
_USES = f"""u AS (SELECT user_id, event_id, ts, epoch_us(ts) AS us, epoch_us(ts) // {4 * DAY} * {4 * DAY} AS issued, user_id::varchar || '/' || (epoch_us(ts) // {4 * DAY} * {4 * DAY})::varchar AS token FROM events WHERE event_type <> 'view')"""
_W = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"


def _estimate(x: str) -> str:
    other = f"length(regexp_replace({x}, '{_W}', '', 'g'))"
    return f"ceil((12 * (length({x}) - {other}) + 6 * {other}) / 10)::bigint"


_AS = r"'^\s+|\s+$'"
_ASSEMBLED = rf"""l AS (SELECT parent_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM (SELECT parent_id, min(text) AS text FROM parents WHERE parent_id IS NOT NULL GROUP BY 1)),
s AS (SELECT parent_id, no, line, regexp_replace(line, {_AS}, '', 'g') AS t, trim(line, ' ') AS s FROM l),
h0 AS (SELECT *, regexp_extract(s, '^(#{{1,6}})\s+(.+?)\s*#*$', 1) AS signs, trim(regexp_extract(s, '^(#{{1,6}})\s+(.+?)\s*#*$', 2), ' ') AS mt, regexp_extract(s, '^(\d+(?:\.\d+)+)[\s、.]', 1) AS num FROM s),
h1 AS (SELECT *, CASE WHEN length(s) = 0 OR length(s) > 80 THEN NULL WHEN signs <> '' AND mt <> '' THEN length(signs) WHEN regexp_matches(s, '[。！？；，]$') THEN NULL
  WHEN regexp_matches(s, '^第\s*[一二三四五六七八九十百零〇\d]+\s*[章篇部]') OR regexp_matches(s, '^[一二三四五六七八九十]+\s*、') THEN 1 WHEN num <> '' THEN least(length(num) - length(replace(num, '.', '')) + 1, 4) END AS level, CASE WHEN signs <> '' AND mt <> '' THEN mt ELSE s END AS title FROM h0),
r AS (SELECT *, level IS NULL AND starts_with(t, '|') AS is_row, lead(t) OVER (PARTITION BY parent_id ORDER BY no) AS nxt FROM h1),
i AS (SELECT *, sum((NOT is_row)::int) OVER (PARTITION BY parent_id ORDER BY no) AS island, is_row AND coalesce(regexp_matches(nxt, '^\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?$') AND contains(nxt, '|'), false) AS starts FROM r),
k AS (SELECT *, CASE WHEN level IS NOT NULL THEN 'heading' WHEN is_row AND max(starts::int) OVER (PARTITION BY parent_id, island ORDER BY no) = 1 THEN 'table' ELSE 'text' END AS kind FROM i),
n AS (SELECT *, sum(CASE WHEN kind = 'heading' OR kind IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY parent_id ORDER BY no) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY parent_id ORDER BY no) AS prev FROM k)),
g AS (SELECT parent_id, run, kind, min(no) AS no, string_agg(line, chr(10) ORDER BY no) AS body, min(level) AS level, min(title) AS title FROM n GROUP BY 1, 2, 3),
g1 AS (SELECT * REPLACE (CASE WHEN kind = 'text' THEN regexp_replace(body, {_AS}, '', 'g') ELSE body END AS body) FROM g),
g2 AS (SELECT *, lag(kind) OVER w AS pk, lag(level) OVER w AS pl, lag(title) OVER w AS pt FROM g1 WHERE kind = 'heading' OR body <> '' WINDOW w AS (PARTITION BY parent_id ORDER BY no)),
pa AS (SELECT b.parent_id, b.no, string_agg(h.title, ' > ' ORDER BY h.level) AS path FROM g2 b JOIN (SELECT * FROM g1 WHERE kind = 'heading') h ON h.parent_id = b.parent_id AND h.no < b.no
  WHERE b.kind <> 'heading' AND NOT EXISTS (SELECT 1 FROM g1 x WHERE x.kind = 'heading' AND x.parent_id = b.parent_id AND x.no > h.no AND x.no < b.no AND x.level <= h.level) GROUP BY 1, 2)"""

SQL = {
    "knowledge_status": "SELECT tenant_id, count(*)::bigint AS documents, sum(CASE WHEN status = 'published' THEN 1 ELSE 0 END)::bigint AS published, sum(CASE WHEN parsed_status = 'failed' THEN 1 ELSE 0 END)::bigint AS failed, coalesce(sum(blocks), 0)::bigint AS blocks FROM documents LEFT JOIN (SELECT doc_id, count(DISTINCT parent_id) AS blocks FROM parents WHERE parent_id IS NOT NULL GROUP BY 1) p ON p.doc_id = doc_ref GROUP BY 1",
    "document_outline": f"WITH {_P}, g AS (SELECT doc_id, breadcrumb AS path, min(order_idx) AS first FROM b WHERE breadcrumb <> '' GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first, path)::int AS nth FROM g) SELECT n.doc_id, filename, status, visibility, nth, n.path FROM n JOIN documents ON doc_ref = n.doc_id WHERE nth <= 20",
    "upload_checks": r"""WITH r AS (SELECT unnest([CASE WHEN filename IS NULL OR trim(filename) = '' THEN 'empty' END, CASE WHEN regexp_matches(filename, '[/\\]') THEN 'separator' END, CASE WHEN contains(filename, ':') THEN 'colon' END, CASE WHEN regexp_matches(filename, '[. ]$') THEN 'edge' END,
        CASE WHEN regexp_matches(regexp_replace(filename, '\.[^.]*$', ''), '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$') THEN 'device' END, CASE WHEN regexp_matches(filename, '[\x00-\x1f<>"|?*]') THEN 'character' END, CASE WHEN strlen(filename) > 255 THEN 'length' END, CASE WHEN coalesce(n_chars BETWEEN 1 AND 5000, false) THEN NULL ELSE 'size' END]) AS reason FROM documents)
        SELECT reason, count(*)::bigint AS files FROM r WHERE reason IS NOT NULL GROUP BY 1""",
    "assembled_sections": f"WITH {_ASSEMBLED} SELECT parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY no) - 1 AS nth, kind, coalesce(path, '') AS path, CASE WHEN pk = 'heading' THEN repeat('#', pl::int) || ' ' || pt || chr(10) || body ELSE body END AS body FROM g2 LEFT JOIN pa USING (parent_id, no) WHERE kind <> 'heading'",
    "reply_scores": f"""WITH {_Q}, s AS (SELECT request_id, CASE n % 4 WHEN 0 THEN [n % 100, n % 11, NULL] WHEN 1 THEN [n % 100, -1, n % 11 + 0.5] WHEN 2 THEN [n % 100, NULL, n % 11] ELSE [NULL, NULL, NULL] END::double[] AS x FROM q)
        SELECT request_id, """
    + ", ".join(f"round(CASE WHEN x[{i}] IS NOT NULL THEN greatest(0, least(10, CASE WHEN x[{i}] > 10 THEN x[{i}] / 10 ELSE x[{i}] END)) END, 4)::double AS score_{i}" for i in (1, 2, 3))
    + " FROM s",
    "reply_lines": f"""WITH {_Q} SELECT request_id, CASE WHEN n % 3 = 0 AND w = '' THEN 'more' ELSE w END AS line FROM (SELECT *, regexp_replace(coalesce(question, ''), '[\\s"''“”‘’《》「」:：]', '', 'g') AS w FROM q)""",
    "reply_questions": f"WITH {_Q} SELECT request_id, CASE n % 4 WHEN 0 THEN 'part ' || n || '|b' WHEN 1 THEN 'one ' || n || '|two' END AS parts, CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END::int AS dropped FROM q",
    "call_arguments": f"WITH {_Q} SELECT request_id, CASE WHEN n % 3 < 2 THEN 'q' || n END AS query, CASE WHEN n % 3 = 0 THEN greatest(1, least(10, n % 25 - 3)) ELSE 5 END::int AS top_k FROM q",
    "question_guards": f"WITH {_Q} SELECT n % 5 AS kind, sum(CASE WHEN regexp_matches(question, '[一-鿿A-Za-z0-9]') THEN 1 ELSE 0 END)::bigint AS says, sum(CASE WHEN n % 3 <> 0 THEN 1 ELSE 0 END)::bigint AS safe, sum(CASE WHEN n % 5 = 0 OR (n % 5 = 1 AND n % 2 = 0) THEN 1 ELSE 0 END)::bigint AS over FROM q GROUP BY 1",
    "image_references": f"WITH {_P} SELECT parent_id, 'p' || order_idx || '.png|x.jpg' AS names, 'see ![a](p' || order_idx || '.png) and ![](x.jpg)' AS links, length(trim(coalesce(text, ''), ' ')) < 20 AND order_idx % 2 = 0 AS scan FROM b WHERE order_idx IS NOT NULL AND source IS NOT NULL",
    "masked_names": "SELECT DISTINCT user_id, CASE WHEN length(username) >= 7 THEN left(username, 3) || '****' || right(username, 4) ELSE '***' END AS masked, CASE WHEN customer_id <> '' THEN customer_id WHEN username IS NULL THEN '?' ELSE 'unmatched' END AS label, coalesce(role IN ('admin', 'kb_admin', 'operator'), false) AS may_operate FROM users WHERE user_id IS NOT NULL",
    "account_locks": """WITH e AS (SELECT *, event_type NOT IN ('purchase', 'signup') AS bad, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
        f AS (SELECT *, CASE WHEN bad THEN sum(bad::int) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) ELSE 0 END::bigint AS failures FROM e) SELECT event_id, failures, CASE WHEN bad AND failures >= 5 THEN 300000000::bigint END AS locked_for_us FROM f""",
    "token_rotation": f"""WITH RECURSIVE {_USES}, k AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY ts, event_id) > 1 AND min(us) OVER (PARTITION BY token) < issued + {3 * DAY} AS again, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM u),
        f AS (SELECT user_id, event_id, n, CASE WHEN again THEN us END AS replayed, CASE WHEN again THEN 'replay' WHEN us < issued + {3 * DAY} THEN 'ok' ELSE 'expired' END AS verdict FROM k WHERE n = 1
              UNION ALL
              SELECT k.user_id, k.event_id, k.n, CASE WHEN k.again OR k.issued < f.replayed THEN k.us ELSE f.replayed END, CASE WHEN k.again OR coalesce(k.issued < f.replayed, false) THEN 'replay' WHEN k.us < k.issued + {3 * DAY} THEN 'ok' ELSE 'expired' END FROM f JOIN k ON k.user_id = f.user_id AND k.n = f.n + 1)
        SELECT event_id, verdict FROM f""",
    "token_winners": f"WITH {_USES} SELECT token, event_id FROM (SELECT token, event_id, row_number() OVER (PARTITION BY token ORDER BY us, event_id) AS k FROM u WHERE us < issued + {3 * DAY}) WHERE k = 1",
    "token_purge": f"WITH {_USES} SELECT DISTINCT token, make_timestamp(issued + {3 * DAY}) AS expires FROM u WHERE make_timestamp(issued + {3 * DAY}) >= TIMESTAMP '2024-01-18 00:00:00'",
    "publication": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'archived' WHEN 1 THEN 'published' ELSE status END AS status, CASE WHEN doc_id % 3 = 1 THEN coalesce(owner_id, 'system') ELSE published_by END AS published_by, CASE WHEN doc_id % 3 = 1 THEN TIMESTAMP '2025-01-01 00:00:00' ELSE published_at END AS published_at FROM documents",
    "access_merge": "SELECT DISTINCT parent_id, p.doc_id AS doc, coalesce(d.status, 'draft') AS status, d.visibility FROM parents p LEFT JOIN (SELECT * FROM documents WHERE status = 'published' AND visibility IS NOT NULL) d ON d.doc_ref = p.doc_id WHERE parent_id IS NOT NULL",
    "listed_documents": "SELECT doc_id, uploaded_at FROM documents WHERE status = 'published' AND tenant_id = 't_main' ORDER BY uploaded_at DESC NULLS LAST, doc_id LIMIT 100",
    "resume_list": "SELECT DISTINCT filename FROM documents WHERE filename IS NOT NULL AND filename NOT IN (SELECT filename FROM documents WHERE parsed_status = 'ok' AND filename IS NOT NULL)",
    "pack_notices": f"""WITH RECURSIVE {_P}, r AS (SELECT * FROM (SELECT doc_id AS q_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY order_idx ASC NULLS LAST, parent_id) AS rank FROM b WHERE doc_id IS NOT NULL) WHERE rank <= 10),
        s AS (SELECT *, sum({_estimate("t")}) OVER (PARTITION BY q_id ORDER BY rank)::bigint AS used FROM r),
        g AS (SELECT q_id, count(*)::bigint AS total, sum(CASE WHEN used <= 700 THEN 1 ELSE 0 END)::bigint AS kept, coalesce(max(CASE WHEN used <= 700 THEN used END), 0)::bigint AS used, arg_min(t, rank) AS t FROM s GROUP BY 1),
        c AS (SELECT q_id, t, list_filter(regexp_extract_all(t, '[^。！？!?；;\\n]*(?:[。！？!?；;\\n]+|$)'), lambda x: x <> '') AS l FROM g WHERE kept = 0 AND t <> ''),
        h AS (SELECT q_id, t, 0 AS k, '' AS head, l FROM c UNION ALL SELECT q_id, t, k + 1, head || l[k + 1], l FROM h WHERE k < len(l) AND {_estimate("(head || l[k + 1])")} <= 700),
        x AS (SELECT q_id, CASE WHEN max(k) = 0 THEN left(any_value(t), 583) ELSE arg_max(head, k) END AS part FROM h GROUP BY 1)
        SELECT q_id, CASE WHEN part IS NULL THEN kept ELSE 1 END AS kept, total, part IS NOT NULL AS truncated, CASE WHEN part IS NULL THEN used ELSE {_estimate("part")} END AS used,
        CASE WHEN part IS NOT NULL THEN '1 of ' || total || ' blocks' || CASE WHEN total > 1 THEN '; ' || (total - 1) || ' dropped' ELSE '' END || '; 1 cut' WHEN total > kept THEN kept || ' of ' || total || ' blocks; ' || (total - kept) || ' dropped' ELSE '' END AS notice FROM g LEFT JOIN x USING (q_id)""",
    "source_labels": f"""WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY order_idx ASC NULLS LAST, parent_id) AS rank FROM b WHERE doc_id IS NOT NULL)
        SELECT parent_id, CASE WHEN place <> '' AND page_start > 0 THEN place || ' (p.' || page_start || ')' ELSE place END AS label, CASE WHEN text IS NULL THEN 0 ELSE {_estimate("text")} END AS tokens FROM (SELECT *, trim(coalesce(CASE WHEN breadcrumb <> '' THEN breadcrumb END, source, ''), ' ') AS place FROM r WHERE rank <= 10)""",
}
