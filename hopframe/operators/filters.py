"""Row filters: token limit, allow-lists, answer verification, duplicates, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopframe.functions.text import extract_answer
from hopframe.operators.examples import DEFAULT_TOKEN_LIMIT

# What counts as a birthday, date, age or birth/death word.
DATE_PATTERNS = {
    "birthday": r"\b(?:0?[1-9]|[12]\d|3[01])[- /.](?:0?[1-9]|1[0-2])[- /.](?:19|20)?\d{2}\b",
    "worded": (
        r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)"
        r"\s(?:0?[1-9]|[12]\d|3[01])(?:st|nd|rd|th)?,?\s(?:19|20)?\d{2}\b"
    ),
    "date": r"\b(?:0?[1-9]|[12]\d|3[01])[- /.](?:0?[1-9]|1[0-2])[- /.](?:\d{2}|\d{4})\b",
    "age": r"\b(?:1[89]|2\d|3[0-9])\b",
    "word": r"\b(?:died|death|born|birth)",
}


def filter_tokens(df: DataFrame, limit: int = DEFAULT_TOKEN_LIMIT, col: str = "num_prompt_tokens") -> DataFrame:
    """Rows within the token limit; on a stored column the scan itself skips the rest."""
    return df.where(F.col(col) <= limit)


def verify_answer(df: DataFrame, mode: str = "default") -> tuple[DataFrame, DataFrame]:
    """Rows whose announced answer occurs in the prompt, or is yes/no.

    ``default`` takes the whole target where nothing is announced and wants
    yes/no in lower case; ``strict`` rejects rows without an announced answer
    and takes Yes/No too.
    """
    if mode not in ("default", "strict"):
        raise ValueError(f"unknown verification mode {mode!r}")
    found = extract_answer("target", "target" if mode == "default" else "strict")
    passed = F.contains(F.lower("prompt"), F.lower(found)) | found.isin("yes", "no")
    checked = df.withColumn("found_answer", found).withColumn("__ok", F.coalesce(passed, F.lit(False)))
    return checked.where("__ok").drop("__ok"), checked.where(~F.col("__ok")).drop("__ok")


def keep_allowed(df: DataFrame, ids: DataFrame, on: str | list[str] = "id") -> DataFrame:
    """Rows whose id is on the allow-list."""
    on = [on] if isinstance(on, str) else on
    return df.join(ids.select(*on).distinct(), on, "left_semi")


def merge_ids(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Distinct union of an id list with new ids; no existing list counts as empty."""
    if existing is None:
        return new.distinct()
    return existing.unionByName(new).distinct()


def build_allow_list(df: DataFrame, limit: int = DEFAULT_TOKEN_LIMIT) -> DataFrame:
    """Ids that pass the token limit and the answer check, taken from direct examples."""
    kept, _ = verify_answer(filter_tokens(df, limit))
    return kept.select("id").distinct()


def dedup_prompts(df: DataFrame, order_col: str = "pos", text_col: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """First row of every distinct prompt, and the repeats.

    Only digests meet in the shuffle and they are pre-aggregated, so a prompt
    shared by a third of all rows costs one small record per task.  ``order_col``
    is unique; both outputs come from joins on it.
    """
    first = (
        df.select(F.sha2(text_col, 256).alias("digest"), order_col)
        .groupBy("digest")
        .agg(F.min(order_col).alias(order_col))
        .select(order_col)
    )
    return df.join(first, order_col, "left_semi"), df.join(first, order_col, "left_anti")


def date_category(df: DataFrame, col: str = "prompt") -> DataFrame:
    """One flag per date pattern and ``any_date`` for any of them."""
    flags: dict[str, Column] = {
        f"has_{name}": F.col(col).rlike("(?U)" + pattern) for name, pattern in DATE_PATTERNS.items()
    }
    out = df.withColumns(flags)
    any_flag = F.lit(False)
    for name in flags:
        any_flag = any_flag | F.col(name)
    return out.withColumn("any_date", any_flag)


def coverage(df: DataFrame, col: str = "num_prompt_tokens", limit: int = 450, by: list[str] | None = None) -> DataFrame:
    """Share of rows under a limit."""
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((F.col(col) < limit).cast("double")).alias("share_under"),
    )
