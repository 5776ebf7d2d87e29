"""Structure, catalogue, screening and dialogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import catalog, screening, structure
from cairn.operators.acl import lacks_acl
from cairn.runtime import table


def _blocks(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "parents").select("parent_id", *cols).dropDuplicates(["parent_id"])


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repeated_page_lines(_blocks(spark, sf_dir, "doc_id", "page_start", "text"), "doc_id", "page_start")


def table_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sections").filter("kind = 'table'").select("section_id", "text").dropDuplicates(["section_id"])
    return structure.table_windows(s, "section_id", chars=400)


def table_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.table_extents(_blocks(spark, sf_dir, "text"), "parent_id")


def sentence_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir, "text")
    return b.select("parent_id", tx.cut_at_sentence(F.col("text"), 300, " [...]").alias("cut"))


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.heading_lines(_blocks(spark, sf_dir, "text"), "parent_id").withColumn("line_no", F.col("line_no").cast("bigint"))


def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.heading_paths(_blocks(spark, sf_dir, "text"), "parent_id").withColumn("line_no", F.col("line_no").cast("bigint"))


def outline_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.outline(_blocks(spark, sf_dir, "doc_id", "breadcrumb", "order_idx"), "doc_id", "breadcrumb", "order_idx")


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _blocks(spark, sf_dir, "source", "order_idx")
    return p.select("parent_id", tx.deterministic_id("p_", F.col("source"), F.col("order_idx").cast("string")).alias("made_id"))


def two_level_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.two_level_split(table(spark, sf_dir, "documents"), "doc_id")


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(tx.estimated_tokens(F.col("text"))).alias("tokens"), F.count("text").alias("texts"))


def section_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sections").select("section_id", "kind", "text").dropDuplicates(["section_id"])
    return s.groupBy("kind").agg(F.count("*").alias("sections"), F.sum(F.length("text").cast("bigint")).alias("chars"))


def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1))
    reader = F.when(ext.isin("txt", "md"), "text").when(ext.isin("docx", "xlsx", "xlsm", "pdf"), ext).otherwise("none")
    return table(spark, sf_dir, "documents").groupBy(ext.alias("ext"), reader.alias("reader")).agg(F.count("*").alias("files"))


def search_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "chat_requests").select("request_id", "question").distinct()
    return q.select("request_id", tx.search_form(F.col("question")).alias("form"), tx.cut(F.col("question"), 12).alias("snippet"))


def acl_visible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.visible_counts(table(spark, sf_dir, "users"), table(spark, sf_dir, "documents"))


def acl_legacy_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(lacks_acl().cast("bigint")).alias("legacy"), F.count("*").alias("documents"))


def stale_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(~F.col("chunk_schema_ver").eqNullSafe("s3")).select("doc_id", "chunk_schema_ver")


def stale_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that a new split would not keep: their document is not published or was split by another version."""
    current = table(spark, sf_dir, "documents").filter("status = 'published' and chunk_schema_ver = 's3'").select(F.col("doc_ref").alias("doc_id"))
    return catalog.stale(_blocks(spark, sf_dir, "doc_id"), current, "doc_id").select("parent_id", "doc_id")


def consistency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.counts_agree(table(spark, sf_dir, "documents"), table(spark, sf_dir, "parents"))


def doc_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    names = d.filter("doc_id % 20 = 0").select(F.when(F.col("doc_id") % 40 == 0, F.upper("filename")).otherwise(F.regexp_extract("filename", "^([^_]+)_", 1)).alias("name"))
    return catalog.resolve(names, d, "name", "filename")


def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.listing(table(spark, sf_dir, "documents"), "pro")


def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with what the blocks say now: files with blocks are drafts again with their number of blocks, and of
    the sections' files those not known yet are new."""
    d = table(spark, sf_dir, "documents").filter("doc_ref is not null and parsed_status <> 'pending'").select(F.col("doc_ref").alias("doc_id"), "source", "chunk_count", "owner_id", "status")
    blocks = table(spark, sf_dir, "parents").select("doc_id", F.col("parent_id").alias("unit")).unionByName(table(spark, sf_dir, "sections").select("doc_id", F.col("section_id").alias("unit")))
    held = blocks.filter("doc_id is not null and unit is not null").distinct().groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
    changes = held.select("doc_id", "chunk_count", F.lit(None).cast("string").alias("owner_id"))
    return catalog.upsert(d, changes, "doc_id", kept=("owner_id", "source"), reset={"status": "draft"})


def schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _blocks(spark, sf_dir, "doc_id", "order_idx").select(F.col("parent_id").alias("id"), "doc_id", "order_idx")
    b = table(spark, sf_dir, "sections").select(F.col("section_id").alias("id"), "doc_id", "kind").dropDuplicates(["id"])
    return a.unionByName(b, allowMissingColumns=True)


def unsafe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons to refuse file names, of which five in seven are made bad here, each in another way."""
    n, name = F.col("doc_id") % 7, F.col("filename")
    bad = F.when(n == 0, F.concat(F.lit("a/"), name)).when(n == 1, F.concat(F.lit("C:"), name)).when(n == 2, F.concat(name, F.lit(" "))).when(n == 3, "LPT1.txt").when(n == 4, F.repeat(name, 9)).otherwise(name)
    r = table(spark, sf_dir, "documents").select(F.explode(screening.unsafe_reasons(bad)).alias("reason"))
    return r.groupBy("reason").agg(F.count("*").alias("files"))


def _with_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with numbers and addresses of persons put in, which the tables do not have."""
    n = F.col("doc_id")
    number = F.format_string("%017d", n * 7919)
    put = F.when(n % 6 == 0, F.concat(number, F.lit("X"))).when(n % 6 == 1, F.concat(F.lit("62"), F.right(number, F.lit(14)))).when(n % 6 == 2, F.concat(F.lit("138"), F.right(number, F.lit(8))))
    put = put.when(n % 6 == 3, F.format_string("agent.%d@example.org", n)).when(n % 6 == 4, F.concat(number, F.lit("12"))).otherwise("1234567890")
    return table(spark, sf_dir, "documents").withColumn("text", F.concat(put, F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" ("), put, F.lit(")")))


def pii_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_pii(spark, sf_dir).select("doc_id", F.md5(tx.pii_masked(F.col("text"))).alias("masked"))


def pii_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _with_pii(spark, sf_dir).select("source", F.explode(tx.pii_kinds(F.col("text"))).alias("kind"))
    return k.groupBy("source", "kind").agg(F.count("*").alias("documents"))


#: Terms and patterns for which texts are refused here, and what tells messages apart.
TERMS, PLANTED = ("密封圈", "door sensor", "Schwimmerventil"), (r"请(立即|务必)[^。]{0,12}(复位|屏蔽)", r"(?i)before you (shield|unbind)")
REFERS, JOINS = ("这个|那个|上次|刚才", "(?i)^(and|then|so) "), ("另外|还有|顺便|以及", "(?i) and also | sowie ")
KINDS = {"order": "(?i)(ORD|WO|SN)[- ]?[0-9A-F]", "repair": "坏了|(?i)broken|defekt"}
GREETING, IDLE = "(?i)^(你好|您好|hello|hi|hallo)[,，。!！\\s]*", "(?i)^(谢谢|thanks|danke|ok|好的)+[!！。]*$"


def _refused(text: str = "text"):  # noqa: ANN202
    return screening.verdict(F.col(text), TERMS, PLANTED)


def moderation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", _refused().alias("category"))
    return d.groupBy("category").agg(F.count("*").alias("documents"))


def doc_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _blocks(spark, sf_dir, "doc_id", "order_idx", "text")
    bad = screening.first_refusals(p, "doc_id", "order_idx", _refused())
    return p.select("doc_id").distinct().join(bad, "doc_id", "left").select("doc_id", F.col("category").isNotNull().alias("rejected"))


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Window]:
    c = table(spark, sf_dir, "chat_requests").select("request_id", "session_id", "question", "asked_at").distinct().filter("session_id is not null and question is not null")
    return c, Window.partitionBy("session_id").orderBy(F.asc_nulls_first("asked_at"), "request_id")


def rewrite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, w = _asked(spark, sf_dir)
    c = c.withColumn("nth", F.row_number().over(w))
    return c.select("request_id", screening.leans_on_history(F.col("question"), F.col("nth") > 1, REFERS).alias("gate"))


def rewrite_accepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, w = _asked(spark, sf_dir)
    c = c.withColumn("candidate", F.lead("question").over(w)).filter("candidate is not null")
    return c.select("request_id", screening.accepts_rewrite(F.col("question"), F.col("candidate")).alias("accepted"))


def divide_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _ = _asked(spark, sf_dir)
    return c.select("request_id", screening.asks_several(F.col("question"), JOINS).alias("several"))


def history_last8(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, w = _asked(spark, sf_dir)
    back = Window.partitionBy("session_id").orderBy(F.desc_nulls_last("asked_at"), F.desc("request_id"))
    kept = c.withColumn("back", F.row_number().over(back)).filter("back <= 8")
    h = kept.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("o"), tx.cut(F.col("question"), 30).alias("t")))).alias("m"))
    return h.select("session_id", F.array_join(F.transform("m", lambda x: x["t"]), "\n").alias("history"))


def intent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chat_requests").select("request_id", "question").distinct()
    return c.groupBy(screening.kind_by_rule(F.col("question"), KINDS, GREETING, IDLE).alias("kind")).agg(F.count("*").alias("requests"))


def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, w = _asked(spark, sf_dir)
    gap = F.unix_micros(F.col("asked_at").cast("timestamp")) - F.unix_micros(F.lag("asked_at").over(w).cast("timestamp"))
    return c.select("request_id", gap.alias("gap_us"))


QUERIES = {
    f.__name__: f
    for f in (
        repeated_lines, table_windows, table_extents, sentence_cuts, heading_levels, heading_paths, outline_paths, chunk_ids, two_level_split, token_totals, section_kinds, file_types, search_forms, acl_visible_counts, acl_legacy_sources,
        stale_schema, stale_chunks, consistency_report, doc_resolve, list_documents, upsert_documents, schema_union, unsafe_names, pii_masked, pii_kinds, moderation_verdicts, doc_reject,
        rewrite_gate, rewrite_accepts, divide_gate, history_last8, intent_rules, session_gaps,
    )
}

_B = "b AS (SELECT DISTINCT parent_id, doc_id, source, breadcrumb, page_start, order_idx, text FROM parents)"
_S = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
_LINES = f"{_B}, l AS (SELECT parent_id, doc_id, page_start, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM b)"
_T = "trim(line)"
_HEAD = rf"""{_LINES},
h0 AS (SELECT parent_id, line_no, {_T} AS s, regexp_extract({_T}, '^(#{{1,6}})\s+(.+?)\s*#*$', 1) AS signs, trim(regexp_extract({_T}, '^(#{{1,6}})\s+(.+?)\s*#*$', 2)) AS title, regexp_extract({_T}, '^(\d+(?:\.\d+)+)[\s、.]', 1) AS num FROM l),
h1 AS (SELECT parent_id, line_no, s, title, CASE WHEN length(s) = 0 OR length(s) > 80 THEN NULL WHEN signs <> '' AND title <> '' THEN length(signs) WHEN regexp_matches(s, '[。！？；，]$') THEN NULL
  WHEN regexp_matches(s, '^第\s*[一二三四五六七八九十百零〇\d]+\s*[章篇部]') OR regexp_matches(s, '^[一二三四五六七八九十]+\s*、') THEN 1 WHEN num <> '' THEN least(length(num) - length(replace(num, '.', '')) + 1, 4) END AS level,
  signs <> '' AND title <> '' AS marked FROM h0),
h AS (SELECT parent_id, line_no::bigint AS line_no, level::int AS level, CASE WHEN marked THEN title ELSE s END AS title FROM h1 WHERE level IS NOT NULL)"""
_AT = ", ".join(f"coalesce(max(CASE WHEN level = {k} THEN line_no END) OVER w, -1) AS at{k}, last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER w AS t{k}" for k in range(1, 7))
_PARTS = ", ".join(f"CASE WHEN at{k} >= 0 AND level >= {k}" + "".join(f" AND at{k} > at{j}" for j in range(1, k)) + f" THEN t{k} END" for k in range(1, 7))
_W = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}"
_OTHER = f"length(regexp_replace(text, '[{_W}]', '', 'g'))"
_C = "c AS (SELECT DISTINCT request_id, session_id, question, asked_at FROM chat_requests WHERE session_id IS NOT NULL AND question IS NOT NULL)"
_ORDER = "PARTITION BY session_id ORDER BY asked_at ASC NULLS FIRST, request_id"


def _twice(x: str, pattern: str, to: str) -> str:
    """Without lookaround a match takes its neighbours with it, so the replacement is done twice."""
    return f"regexp_replace(regexp_replace({x}, '{pattern}', '{to}', 'g'), '{pattern}', '{to}', 'g')"


_MASK = _twice("text", r"(^|[^0-9])([0-9]{6})[0-9]{11}([0-9Xx])($|[^0-9])", r"\1\2***********\3\4")
for _n in range(19, 14, -1):
    _MASK = _twice(_MASK, rf"(^|[^0-9*])[0-9]{{{_n - 4}}}([0-9]{{4}})($|[^0-9])", r"\1" + "*" * (_n - 4) + r"\2\3")
_MASK = _twice(_MASK, r"(^|[^0-9])(1[3-9][0-9])[0-9]{4}([0-9]{4})($|[^0-9])", r"\1\2****\3\4")
_MASK = f"regexp_replace({_MASK}, '([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*(@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}})', '\\1***\\2', 'g')"
_KINDS = {
    "id_card": r"(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9])",
    "bank_card": r"(^|[^0-9])[0-9]{15,19}($|[^0-9])",
    "phone": r"(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])",
    "email": r"[A-Za-z0-9._%+-][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}
_REFUSED = r"CASE WHEN contains(text, '密封圈') OR contains(text, 'door sensor') OR contains(text, 'Schwimmerventil') THEN 'blocklist' WHEN regexp_matches(text, '请(立即|务必)[^。]{0,12}(复位|屏蔽)') OR regexp_matches(text, '(?i)before you (shield|unbind)') THEN 'prompt_injection' END"
_PUT = """CASE doc_id % 6 WHEN 0 THEN lpad((doc_id * 7919)::varchar, 17, '0') || 'X' WHEN 1 THEN '62' || right(lpad((doc_id * 7919)::varchar, 17, '0'), 14) WHEN 2 THEN '138' || right(lpad((doc_id * 7919)::varchar, 17, '0'), 8)
  WHEN 3 THEN 'agent.' || doc_id || '@example.org' WHEN 4 THEN lpad((doc_id * 7919)::varchar, 17, '0') || '12' ELSE '1234567890' END"""
_PII = f"pd AS (SELECT doc_id, source, {_PUT} || ' ' || coalesce(text, '') || ' (' || {_PUT} || ')' AS text FROM documents)"
_BAD = "CASE doc_id % 7 WHEN 0 THEN 'a/' || filename WHEN 1 THEN 'C:' || filename WHEN 2 THEN filename || ' ' WHEN 3 THEN 'LPT1.txt' WHEN 4 THEN repeat(filename, 9) ELSE filename END"
_CONTENT = "list_distinct(list_filter(string_split(regexp_replace({}, '" + r"[它他她这那哪些么的呢吗吧啊呀哦嗯?？!！。，,、;；:：\s]+" + "', '', 'g'), ''), lambda x: x <> ''))"

SQL = {
    "repeated_lines": f"""WITH {_LINES}, t AS (SELECT doc_id, count(DISTINCT page_start) AS total FROM b WHERE page_start IS NOT NULL GROUP BY 1 HAVING count(DISTINCT page_start) >= 4),
        f AS (SELECT doc_id, page_start, CASE WHEN {_S} <> '' AND length({_S}) <= 60 AND NOT starts_with({_S}, '|') THEN regexp_replace({_S}, '\\d+', '#', 'g') END AS form FROM l WHERE page_start IS NOT NULL),
        n AS (SELECT doc_id, form, count(DISTINCT page_start)::bigint AS pages FROM f WHERE form IS NOT NULL GROUP BY 1, 2)
        SELECT n.* FROM n JOIN t USING (doc_id) WHERE pages >= greatest(2, total * 6 // 10)""",
    "table_windows": """WITH RECURSIVE s AS (SELECT DISTINCT section_id, list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')) AS l FROM sections WHERE kind = 'table'),
        p AS (SELECT section_id, length(l[1]) + 1 + length(l[2]) AS head, l[3:] AS r FROM s WHERE len(l) > 2),
        f AS (SELECT section_id, head, r, 1 AS i, 0 AS window_no, 0 AS first, head + length(r[1]) + 1 AS size FROM p
              UNION ALL
              SELECT section_id, head, r, i + 1, CASE WHEN brk THEN window_no + 1 ELSE window_no END, CASE WHEN brk THEN i ELSE first END, CASE WHEN brk THEN head + c ELSE size + c END
              FROM (SELECT *, length(r[i + 1]) + 1 AS c, (i - first >= 50 OR size + length(r[i + 1]) + 1 > 400) AS brk FROM f WHERE i < len(r)))
        SELECT section_id, window_no::int AS "window", min(first)::bigint AS first_row, max(i - 1)::bigint AS last_row, max(size)::bigint AS chars FROM f GROUP BY 1, 2""",
    "heading_levels": f"WITH {_HEAD} SELECT * FROM h",
    "table_extents": f"WITH {_LINES}, r AS (SELECT parent_id, line_no, line_no - row_number() OVER (PARTITION BY parent_id ORDER BY line_no) AS island FROM l WHERE starts_with({_S}, '|')) SELECT parent_id, min(line_no)::bigint AS first_line, max(line_no)::bigint AS last_line, count(*)::bigint AS line_count FROM r GROUP BY parent_id, island HAVING count(*) > 1",
    "sentence_cuts": rf"WITH {_B}, c AS (SELECT parent_id, text, left(text, 294) AS head, regexp_extract(left(text, 294), '(?s)^.*[。！？!?；;\n]', 0) AS whole FROM b) SELECT parent_id, CASE WHEN length(text) <= 300 THEN text WHEN whole <> '' THEN whole || ' [...]' ELSE head || ' [...]' END AS cut FROM c",
    "heading_paths": f"WITH {_HEAD}, p AS (SELECT parent_id, line_no, level, {_AT} FROM h WINDOW w AS (PARTITION BY parent_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)) SELECT parent_id, line_no, concat_ws(' > ', {_PARTS}) AS path FROM p",
    "outline_paths": f"WITH {_B}, g AS (SELECT doc_id, breadcrumb, min(order_idx) AS first FROM b WHERE breadcrumb <> '' GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first, breadcrumb)::int AS nth FROM g) WHERE nth <= 20",
    "chunk_ids": f"WITH {_B} SELECT parent_id, 'p_' || substr(sha1(concat_ws('|', source, order_idx::varchar)), 1, 30) AS made_id FROM b",
    "token_totals": f"SELECT source, sum(CASE WHEN text IS NULL THEN 0 ELSE ceil((12 * (length(text) - {_OTHER}) + 6 * {_OTHER}) / 10) END)::bigint AS tokens, count(text)::bigint AS texts FROM documents GROUP BY 1",
    "section_kinds": "SELECT kind, count(*)::bigint AS sections, sum(length(text))::bigint AS chars FROM (SELECT DISTINCT section_id, kind, text FROM sections) GROUP BY 1",
    "file_types": r"SELECT ext, CASE WHEN ext IN ('txt', 'md') THEN 'text' WHEN ext IN ('docx', 'xlsx', 'xlsm', 'pdf') THEN ext ELSE 'none' END AS reader, count(*)::bigint AS files FROM (SELECT lower(regexp_extract(filename, '\.([A-Za-z0-9]+)$', 1)) AS ext FROM documents) GROUP BY 1, 2",
    "search_forms": r"SELECT DISTINCT request_id, regexp_replace(question, '[\s，。！？；：、（）《》【】“”‘’]+', '', 'g') AS form, CASE WHEN length(question) > 12 THEN substr(question, 1, 12) || '…' ELSE question END AS snippet FROM (SELECT DISTINCT request_id, question FROM chat_requests)",
    "acl_visible_counts": "SELECT u.user_id, count(d.doc_id)::bigint AS documents FROM (SELECT DISTINCT user_id, tenant_id FROM users WHERE user_id IS NOT NULL) u LEFT JOIN documents d ON d.status = 'published' AND (d.visibility = 'public' OR (d.visibility = 'tenant' AND d.tenant_id = u.tenant_id) OR (d.visibility = 'private' AND d.owner_id = u.user_id)) GROUP BY 1",
    "acl_legacy_sources": "SELECT source, sum(CASE WHEN status IS NULL OR visibility IS NULL OR tenant_id IS NULL THEN 1 ELSE 0 END)::bigint AS legacy, count(*)::bigint AS documents FROM documents GROUP BY 1",
    "stale_schema": "SELECT doc_id, chunk_schema_ver FROM documents WHERE chunk_schema_ver IS DISTINCT FROM 's3'",
    "stale_chunks": f"WITH {_B} SELECT parent_id, doc_id FROM b WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_ref FROM documents WHERE status = 'published' AND chunk_schema_ver = 's3' AND doc_ref IS NOT NULL)",
    "consistency_report": "SELECT coalesce(d.doc_ref, p.doc_id) AS doc_id, d.parent_count::bigint AS said, p.held FROM documents d FULL JOIN (SELECT doc_id, count(DISTINCT parent_id)::bigint AS held FROM parents WHERE doc_id IS NOT NULL GROUP BY 1) p ON p.doc_id = d.doc_ref WHERE coalesce(parent_count, 0) <> coalesce(held, 0)",
    "doc_resolve": """WITH n AS (SELECT DISTINCT CASE WHEN doc_id % 40 = 0 THEN upper(filename) ELSE regexp_extract(filename, '^([^_]+)_', 1) END AS name FROM documents WHERE doc_id % 20 = 0),
        p AS (SELECT DISTINCT name, filename AS file, CASE WHEN lower(filename) = lower(name) THEN 0 ELSE 1 END::int AS tier FROM n JOIN documents ON contains(lower(filename), lower(name)) WHERE name <> '')
        SELECT name, file, tier FROM (SELECT *, min(tier) OVER (PARTITION BY name) AS best FROM p) WHERE tier = best""",
    "list_documents": "SELECT parsed, nth, doc_id, filename FROM (SELECT *, row_number() OVER (PARTITION BY parsed ORDER BY filename, doc_id)::int AS nth FROM (SELECT coalesce(parsed_status = 'ok', false) AS parsed, doc_id, filename FROM documents WHERE contains(lower(filename), 'pro'))) WHERE nth <= 50",
    "upsert_documents": """WITH h AS (SELECT doc_id, count(DISTINCT unit)::int AS n FROM (SELECT doc_id, parent_id AS unit FROM parents UNION ALL SELECT doc_id, section_id FROM sections) WHERE doc_id IS NOT NULL AND unit IS NOT NULL GROUP BY 1)
        SELECT coalesce(h.doc_id, d.doc_ref) AS doc_id, d.source, CASE WHEN h.doc_id IS NULL THEN d.chunk_count ELSE n END::int AS chunk_count, d.owner_id, CASE WHEN h.doc_id IS NULL THEN d.status ELSE 'draft' END AS status
        FROM (SELECT * FROM documents WHERE doc_ref IS NOT NULL AND parsed_status <> 'pending') d FULL JOIN h ON h.doc_id = d.doc_ref""",
    "schema_union": f"WITH {_B} SELECT parent_id AS id, doc_id, order_idx, NULL::varchar AS kind FROM b UNION ALL SELECT section_id, doc_id, NULL, kind FROM (SELECT DISTINCT section_id, doc_id, kind FROM sections)",
    "unsafe_names": "WITH nm AS (SELECT " + _BAD + r""" AS filename FROM documents), r AS (SELECT unnest([CASE WHEN filename IS NULL OR trim(filename) = '' THEN 'empty' END, CASE WHEN regexp_matches(filename, '[/\\]') THEN 'separator' END, CASE WHEN contains(filename, ':') THEN 'colon' END, CASE WHEN regexp_matches(filename, '[. ]$') THEN 'edge' END,
        CASE WHEN regexp_matches(regexp_replace(filename, '\.[^.]*$', ''), '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$') THEN 'device' END, CASE WHEN regexp_matches(filename, '[\x00-\x1f<>"|?*]') THEN 'character' END, CASE WHEN strlen(filename) > 255 THEN 'length' END]) AS reason FROM nm)
        SELECT reason, count(*)::bigint AS files FROM r WHERE reason IS NOT NULL GROUP BY 1""",
    "pii_masked": f"WITH {_PII} SELECT doc_id, md5({_MASK}) AS masked FROM pd",
    "pii_kinds": f"WITH {_PII} SELECT source, kind, count(*)::bigint AS documents FROM (SELECT source, unnest([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in _KINDS.items()) + "]) AS kind FROM pd) WHERE kind IS NOT NULL GROUP BY 1, 2",
    "moderation_verdicts": f"SELECT {_REFUSED} AS category, count(*)::bigint AS documents FROM documents GROUP BY 1",
    "doc_reject": f"WITH {_B} SELECT doc_id, max(CASE WHEN ({_REFUSED}) IS NULL THEN 0 ELSE 1 END) = 1 AS rejected FROM b GROUP BY 1",
    "rewrite_gate": f"WITH {_C}, n AS (SELECT *, trim(question) AS q, row_number() OVER ({_ORDER}) AS nth FROM c) SELECT request_id, q <> '' AND nth > 1 AND (length(q) <= 8 OR regexp_matches(q, '这个|那个|上次|刚才') OR regexp_matches(q, '(?i)^(and|then|so) ')) AS gate FROM n",
    "rewrite_accepts": f"""WITH {_C}, n AS (SELECT *, lead(question) OVER ({_ORDER}) AS candidate FROM c), m AS (SELECT *, {_CONTENT.format("question")} AS src, {_CONTENT.format("candidate")} AS dst FROM n WHERE candidate IS NOT NULL)
        SELECT request_id, candidate <> '' AND length(candidate) <= 3 * length(question) + 50 AND len(list_filter(regexp_extract_all(question, '[A-Za-z0-9]+'), lambda t: NOT contains(lower(candidate), lower(t)))) = 0
        AND (len(src) = 0 OR len(list_intersect(src, dst)) >= 0.6::double * len(src)) AS accepted FROM m""",
    "divide_gate": f"WITH {_C} SELECT request_id, length(question) - length(regexp_replace(question, '[?？]', '', 'g')) >= 2 OR regexp_matches(question, '另外|还有|顺便|以及') OR regexp_matches(question, '(?i) and also | sowie ') OR length(question) > 50 AS several FROM c",
    "history_last8": f"WITH {_C}, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY asked_at DESC NULLS LAST, request_id DESC) AS back FROM c) SELECT session_id, string_agg(CASE WHEN length(question) > 30 THEN substr(question, 1, 30) || '…' ELSE question END, chr(10) ORDER BY back DESC) AS history FROM k WHERE back <= 8 GROUP BY 1",
    "intent_rules": r"""WITH c AS (SELECT DISTINCT request_id, question, trim(question) AS q FROM chat_requests), r AS (SELECT *, trim(regexp_replace(q, '(?i)^(你好|您好|hello|hi|hallo)[,，。!！\s]*', '')) AS rest FROM c)
        SELECT CASE WHEN regexp_matches(q, '(?i)(ORD|WO|SN)[- ]?[0-9A-F]') THEN 'order' WHEN regexp_matches(q, '坏了|(?i)broken|defekt') THEN 'repair' WHEN rest = '' OR regexp_matches(rest, '(?i)^(谢谢|thanks|danke|ok|好的)+[!！。]*$') THEN 'chitchat' END AS kind, count(*)::bigint AS requests FROM r GROUP BY 1""",
    "session_gaps": f"WITH {_C} SELECT request_id, epoch_us(asked_at) - epoch_us(lag(asked_at) OVER ({_ORDER})) AS gap_us FROM c",
}
