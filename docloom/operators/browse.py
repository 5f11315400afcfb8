"""Filtered, sorted and paged document search; access rules; previews and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORTS = ("created_at", "file_size", "filename")
#: Permissions of collaborator levels and of roles.
LEVELS = {"viewer": ["read"], "editor": ["read", "write", "comment"], "owner": ["read", "write", "comment", "admin"]}
ROLES = {"user": ["read", "write"], "admin": ["read", "write", "delete", "manage_users"], "super_admin": ["read", "write", "delete", "manage_users", "manage_system"]}


def acl(user_id: int, role: str, admins: tuple[str, ...] = ("admin", "super_admin")) -> Column:
    """Own rows only, unless the role sees all."""
    return F.lit(True) if role in admins else F.col("user_id") == user_id


def contains_text(text: str) -> Column:
    """Case-insensitive substring (with SQL wildcards) of file name, content or type."""
    pattern = F.lit(f"%{text.strip()}%")
    return F.ilike("filename", pattern) | F.ilike("content", pattern) | F.ilike("mime_type", pattern)


def filters(
    status: str | None = None, file_type: str | None = None, date_from: str | None = None, date_to: str | None = None, min_size: str | None = None, max_size: str | None = None
) -> Column:
    """The conjunction of the given filters; a date or size that cannot be read filters nothing."""
    out = F.lit(True)
    if status:
        out &= F.col("status") == status
    if file_type:
        out &= F.ilike("mime_type", F.lit(f"%{file_type}%"))
    for text, test in ((date_from, lambda c: F.col("created_at") >= c), (date_to, lambda c: F.col("created_at") <= c)):
        if text:
            out &= F.coalesce(test(F.try_to_timestamp(F.lit(text.replace("Z", "+00:00")))), F.lit(True))
    for text, test in ((min_size, lambda c: F.col("file_size") >= c), (max_size, lambda c: F.col("file_size") <= c)):
        if text:
            out &= F.coalesce(test(F.lit(text).try_cast("long")), F.lit(True))
    return out


def page(df: DataFrame, number: int, per_page: int, sort_by: str = "created_at", descending: bool = True, key: str = "id") -> DataFrame:
    """One page, sorted with the key as tie-break; an unknown sort key sorts by the key alone."""
    order = [] if sort_by not in SORTS else [F.col(sort_by).desc() if descending else F.col(sort_by).asc()]
    return df.orderBy(*order, key).offset((number - 1) * per_page).limit(per_page)


def page_meta(df: DataFrame, number: int, per_page: int) -> DataFrame:
    """One row: total, total_pages, has_next, has_prev."""
    total = df.agg(F.count("*").alias("total"))
    return total.select(
        "total", F.ceil(F.col("total") / per_page).cast("long").alias("total_pages"),
        (F.lit((number - 1) * per_page + per_page) < F.col("total")).alias("has_next"), F.lit(number > 1).alias("has_prev"),
    )


def preview(text: Column, size: int = 200, dots: bool = True) -> Column:
    cut = F.substring(text, 1, size)
    return F.when(F.length(text) > size, F.concat(cut, F.lit("..."))).otherwise(text) if dots else cut


def suggestions(documents: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Distinct file names and first five words of contents that contain ``text``; nothing below two characters."""
    pattern = F.lit(f"%{text}%")
    names = documents.where(F.ilike("filename", pattern)).select(F.col("filename").alias("suggestion"))
    words = F.slice(F.filter(F.split("content", r"\s+"), lambda w: w != ""), 1, 5)
    lines = documents.where(F.ilike("content", pattern)).select(F.concat(F.array_join(words, " "), F.lit("...")).alias("suggestion"))
    out = names.unionByName(lines).distinct().orderBy("suggestion").limit(limit)
    return out if len(text.strip()) >= 2 else out.limit(0)


def permitted(required: list[str], granted: Column) -> Column:
    """Whether all required permissions are granted."""
    return F.size(F.array_except(F.array(*map(F.lit, required)), granted)) == 0


def level_permissions(level: Column, levels: dict[str, list[str]] = LEVELS) -> Column:
    known = F.create_map(*[x for k, v in levels.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(known[level], F.array().cast("array<string>"))


def visible_users(role: str) -> Column:
    """Users that a role may see: an admin sees no super_admin."""
    return F.lit(True) if role == "super_admin" else F.col("role") != "super_admin"
