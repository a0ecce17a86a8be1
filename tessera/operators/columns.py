"""Column management (COL*): renames, selection, reordering, splitting, merging.

Pure projections - no data movement."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.common import as_list, c
from tessera.operators.profile import kind_of


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def _case(name: str, how: str) -> str:
    if how == "lower":
        return name.lower()
    if how == "upper":
        return name.upper()
    if how == "title":
        return name.title()
    words = [w for w in re.split(r"[^0-9A-Za-z]+|(?<=[a-z0-9])(?=[A-Z])", name) if w]
    if how == "snake":
        return "_".join(w.lower() for w in words)
    if how == "camel":
        return (words[0].lower() + "".join(w[:1].upper() + w[1:].lower() for w in words[1:])) if words else name
    raise ValueError(how)


def bulk_rename(df: DataFrame, rule: str, arg=None, cols: Sequence[str] | None = None) -> DataFrame:
    """prefix | suffix | remove | replace (arg=(old, new)) | case (arg=lower|upper|title|snake|camel) | strip."""
    chosen = set(cols) if cols else set(df.columns)

    def new(n):
        if n not in chosen:
            return n
        if rule == "prefix":
            return f"{arg}{n}"
        if rule == "suffix":
            return f"{n}{arg}"
        if rule == "remove":
            return n.replace(arg, "")
        if rule == "replace":
            return n.replace(arg[0], arg[1])
        if rule == "case":
            return _case(n, arg)
        if rule == "strip":
            return n.strip()
        raise ValueError(rule)
    return df.toDF(*[new(n) for n in df.columns])


def _select_by(df: DataFrame, by: str, arg, case: bool = True) -> list[str]:
    if by == "list":
        return [x for x in df.columns if x in set(as_list(arg))]
    if by == "contains":
        return [x for x in df.columns if (arg in x if case else arg.lower() in x.lower())]
    if by == "kind":
        return [f.name for f in df.schema.fields if kind_of(f.dataType) == arg]
    raise ValueError(by)


def keep_columns(df: DataFrame, by: str, arg, case: bool = True) -> DataFrame:
    return df.select(*[c(x) for x in _select_by(df, by, arg, case)])


def drop_columns(df: DataFrame, by: str, arg, case: bool = True) -> DataFrame:
    return df.drop(*_select_by(df, by, arg, case))


def reorder(df: DataFrame, how: str, cols: Sequence[str] | None = None) -> DataFrame:
    """manual (rest appended) | alpha | alpha_desc | front | back."""
    cols = list(cols or [])
    rest = [x for x in df.columns if x not in cols]
    order = {"manual": cols + rest, "front": cols + rest, "back": rest + cols,
             "alpha": sorted(df.columns), "alpha_desc": sorted(df.columns, reverse=True)}[how]
    return df.select(*[c(x) for x in order])


def split_column(df: DataFrame, col: str, how: str, arg, prefix: str | None = None,
                 max_splits: int = -1) -> DataFrame:
    """delimiter (to columns; width = widest row) | array | positions | regex (match + groups)."""
    prefix = f"{col}_" if prefix is None else prefix
    x = c(col)
    if how in ("delimiter", "array"):
        parts = F.split(x, "\\Q" + arg + "\\E", max_splits + 1 if max_splits >= 0 else -1)
        if how == "array":
            return df.withColumn(prefix.rstrip("_") or f"{col}_split", parts)
        width = df.agg(F.max(F.size(parts))).first()[0] or 0  # one integer
        return df.withColumns({f"{prefix}{i}": F.get(parts, i) for i in range(width)})
    if how == "positions":
        pos = sorted(arg)
        bounds = [0] + pos
        cols = {}
        for i, start in enumerate(bounds):
            end = pos[i] if i < len(pos) else None
            length = (end - start) if end is not None else 1 << 30
            cols[f"{prefix}{i}"] = F.when(x.isNotNull(), F.substring(x, start + 1, length))
        return df.withColumns(cols)
    if how == "regex":
        ngroups = re.compile(arg).groups
        matched = x.rlike(arg)
        return df.withColumns({f"{prefix}{i}": F.when(matched, F.regexp_extract(x, arg, i)) for i in range(ngroups + 1)})
    raise ValueError(how)


def merge_columns(df: DataFrame, cols: Sequence[str], sep: str = " ", out: str = "merged",
                  null_as: str | None = None) -> DataFrame:
    """Concatenate with a separator; nulls are skipped (or printed as ``null_as``)."""
    xs = [c(x).cast("string") for x in cols]
    if null_as is not None:
        xs = [F.coalesce(x, F.lit(null_as)) for x in xs]
    return df.withColumn(out, F.concat_ws(sep, *xs))


def join_words(df: DataFrame, cols: Sequence[str], space: bool = True, dedup: bool = False,
               out: str = "joined") -> DataFrame:
    """Words of several text columns joined; optional de-dup keeping first occurrences."""
    words = F.filter(F.split(F.concat_ws(" ", *[c(x).cast("string") for x in cols]), r"\s+"), lambda w: w != "")
    if dedup:
        words = F.array_distinct(words)
    return df.withColumn(out, F.array_join(words, " " if space else ""))
