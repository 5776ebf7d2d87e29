"""Document catalogue: merging, matching names, listing, and checks between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.runtime import settle


def upsert(base: DataFrame, changes: DataFrame, key: str, kept: tuple[str, ...] = (), reset: dict[str, object] | None = None) -> DataFrame:
    """``base`` with the rows of ``changes`` put in by key; columns ``kept`` keep their old value where the new one is null,
    and columns of ``reset`` get its value wherever a row is changed or new. Both have one row per key; columns only one
    side has are null on the other."""
    cols, reset = list(dict.fromkeys([*base.columns, *changes.columns])), reset or {}
    kind = {f.name: f.dataType for df in (changes, base) for f in df.schema}
    b = base.select(F.col(key).alias("__kb"), F.struct(*(base[c] if c in base.columns else F.lit(None).cast(kind[c]).alias(c) for c in cols)).alias("b"))
    c = changes.select(F.col(key).alias("__kc"), F.struct(*(changes[c] if c in changes.columns else F.lit(None).cast(kind[c]).alias(c) for c in cols)).alias("c"))
    j = b.join(c, F.col("__kb") == F.col("__kc"), "full_outer")

    def value(x: str):  # noqa: ANN202
        new = F.coalesce(F.col(f"c.{x}"), F.col(f"b.{x}")) if x in kept else F.col(f"c.{x}")
        new = F.lit(reset[x]).cast(kind[x]) if x in reset else new
        return F.when(F.col("__kc").isNotNull(), new).otherwise(F.col(f"b.{x}")).alias(x)

    return j.select(*map(value, cols))


def stale(existing: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Rows of ``existing`` whose key is not among ``current``; none if ``current`` is empty."""
    some = current.select(F.lit(1).alias("__some")).limit(1)
    return existing.join(current.select(key).distinct(), key, "left_anti").join(F.broadcast(some), how="left_semi", on=F.lit(True))


def resolve(names: DataFrame, files: DataFrame, name: str, file: str, gram: int = 4) -> DataFrame:
    """(name, file, tier): files of exactly that name (tier 0), or if there are none, holding it (tier 1).

    Letter case is ignored. Exact names are found by equality. A file can hold a name only if it holds each of its runs
    of ``gram`` characters (of its own length if that is less), so the others meet the files by the run of theirs that
    the fewest files hold: a beginning that all names share brings no pairs.
    """
    n = names.select(F.col(name).alias("name")).distinct().filter(F.length("name") > 0).withColumn("ln", F.lower("name"))
    f = files.select(F.col(file).alias("file")).distinct().filter("file is not null").withColumn("lf", F.lower("file"))
    exact = settle(n.join(f, n.ln == f.lf).select("name", "file"))
    rest = settle(n.join(exact.select("name").distinct(), "name", "left_anti"))

    def runs(x: Column, k: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - k + 1, F.lit(1))), lambda i: F.substr(x, i, k)))

    mine = rest.select("name", "ln", F.explode(runs(F.col("ln"), F.least(F.length("ln"), F.lit(gram)))).alias("g"))
    every = f.select("file", "lf", F.explode(F.array_distinct(F.flatten(F.array(*(runs(F.col("lf"), F.lit(k)) for k in range(1, gram + 1)))))).alias("g"))
    every = settle(every.join(mine.select("g").distinct(), "g", "left_semi"))
    held = every.groupBy("g").agg(F.count("*").alias("files"))
    rarest = mine.join(held, "g", "left").groupBy("name", "ln").agg(F.min_by("g", F.struct(F.coalesce("files", F.lit(0)), "g")).alias("g"))
    inner = rarest.join(every, "g").filter(F.contains("lf", "ln")).select("name", "file", F.lit(1).alias("tier"))
    return exact.select("name", "file", F.lit(0).alias("tier")).unionByName(inner)


def listing(documents: DataFrame, keyword: str | None, limit: int = 50) -> DataFrame:
    """(parsed, nth, doc_id, filename): files that hold the keyword, parsed and failed apart, at most ``limit`` of each."""
    rows = documents if not keyword else documents.filter(F.contains(F.lower("filename"), F.lit(keyword.lower())))
    rows = rows.withColumn("parsed", F.coalesce(F.col("parsed_status") == "ok", F.lit(False)))
    w = Window.partitionBy("parsed").orderBy("filename", "doc_id")
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= limit).select("parsed", "nth", "doc_id", "filename")


def counts_agree(documents: DataFrame, parents: DataFrame) -> DataFrame:
    """(doc_id, said, held): documents and block files whose stated and held numbers of blocks differ."""
    held = parents.filter("doc_id is not null and parent_id is not null").select("doc_id", "parent_id").distinct().groupBy("doc_id").agg(F.count("*").alias("held"))
    said = documents.select(F.col("doc_ref").alias("doc_id"), F.col("parent_count").cast("bigint").alias("said"))
    return said.join(held, "doc_id", "full_outer").filter(~F.coalesce("said", F.lit(0)).eqNullSafe(F.coalesce("held", F.lit(0)))).select("doc_id", "said", "held")


def visible_counts(users: DataFrame, documents: DataFrame) -> DataFrame:
    """(user_id, documents): how many documents each user may see; counted per audience, no pairs are formed."""
    p = documents.filter(F.col("status") == "published")
    public = p.filter(F.col("visibility") == "public").agg(F.count("*").alias("n_public"))
    tenant = p.filter(F.col("visibility") == "tenant").groupBy("tenant_id").agg(F.count("*").alias("n_tenant"))
    own = p.filter(F.col("visibility") == "private").groupBy(F.col("owner_id").alias("user_id")).agg(F.count("*").alias("n_own"))
    u = users.select("user_id", "tenant_id").filter("user_id is not null").distinct()
    j = u.join(tenant, "tenant_id", "left").join(own, "user_id", "left").crossJoin(F.broadcast(public))  # a single row
    zero = F.lit(0).cast("bigint")
    return j.select("user_id", (F.col("n_public") + F.coalesce("n_tenant", zero) + F.coalesce("n_own", zero)).alias("documents"))


# What the two access columns may hold.
STATUSES, VISIBILITIES = ("draft", "published", "archived"), ("private", "tenant", "public")


def with_status(documents: DataFrame, to: Column, by: Column, at: Column) -> DataFrame:
    """``documents`` with a new ``status``; those that become published are stamped, others keep their stamps. A null
    status changes nothing."""
    published = F.coalesce(to == "published", F.lit(False))
    stamped = documents.withColumn("published_at", F.when(published, at).otherwise(F.col("published_at"))).withColumn("published_by", F.when(published, by).otherwise(F.col("published_by")))
    return stamped.withColumn("status", F.coalesce(to, F.col("status")))


def checked_access(status: Column, visibility: Column) -> Column:
    """struct(status, visibility); the query fails on a value that is none of those known."""

    def one(x: Column, known: tuple[str, ...], what: str) -> Column:
        return F.when(x.isin(*known), x).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(x, F.lit("null")))))

    return F.struct(one(status, STATUSES, "status").alias("status"), one(visibility, VISIBILITIES, "visibility").alias("visibility"))


def merged_meta(chunks: DataFrame, changes: DataFrame, source: str, meta: str = "meta") -> DataFrame:
    """``chunks`` with the entries of their source's ``changes`` (source, meta) put into their map: other entries stay, and
    sources without changes stay as they are. ``changes`` has one row per source."""
    c = changes.select(F.col(source).alias("__s"), F.col(meta).alias("__m"))
    j = chunks.join(c, F.col(source) == F.col("__s"), "left")
    old = F.coalesce(F.col(meta), F.create_map().cast("map<string,string>"))
    both = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(F.col("__m"), k)), F.col("__m"))
    return j.withColumn(meta, F.when(F.col("__m").isNull(), F.col(meta)).otherwise(both)).drop("__s", "__m")


def listed(documents: DataFrame, status: str | None = None, tenant: str | None = None, limit: int = 200) -> DataFrame:
    """The latest uploads, of a status and of a tenant if given; at least 1 and at most 1000 of them."""
    rows = documents if not status else documents.filter(F.col("status") == status)
    rows = rows if not tenant else rows.filter(F.col("tenant_id") == tenant)
    return rows.orderBy(F.desc_nulls_last("uploaded_at"), "doc_id").limit(max(1, min(limit, 1000)))


def still_to_do(wanted: DataFrame, done: DataFrame, key: str, status: str = "status") -> DataFrame:
    """What of ``wanted`` has not been done with status ``ok``: a run goes on where the last one stopped."""
    return wanted.join(done.filter(F.col(status) == "ok").select(key).distinct(), key, "left_anti")
