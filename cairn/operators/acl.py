"""Row-level access control: one predicate, applied before any ranking."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def visible(tenant: Column | str | None, user: Column | str | None, enabled: bool = True) -> Column:
    """Whether a row (status, visibility, tenant_id, owner_id) may be seen; anything missing or unknown denies.

    Published rows are seen by all (public), by their tenant (tenant) or by their owner (private).
    """
    if not enabled:
        return F.lit(True)
    tenant, user = (x if isinstance(x, Column) else F.lit(x).cast("string") for x in (tenant, user))
    who = (F.col("visibility") == "public") | ((F.col("visibility") == "tenant") & (F.col("tenant_id") == tenant)) | ((F.col("visibility") == "private") & (F.col("owner_id") == user))
    return F.coalesce((F.col("status") == "published") & who, F.lit(False))


def lacks_acl() -> Column:
    """Rows written before access control: any of the three columns is missing."""
    return F.col("status").isNull() | F.col("visibility").isNull() | F.col("tenant_id").isNull()


def conjunction(filters: Iterable[Column | None]) -> Column | None:
    """All of the filters at once; those that are None say nothing, and if none says anything, so does the result."""
    given = [f for f in filters if f is not None]
    return reduce(and_, given) if given else None
