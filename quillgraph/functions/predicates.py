"""The colour-group query language compiled to Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import fold, property_value


def parse_groups(text: str) -> list[tuple[str, str]]:
    """(query, colour) of each line; the last = parts them; // starts a comment."""
    out = []
    for line in map(str.strip, text.split("\n")):
        query, eq, color = line.rpartition("=")
        if eq and not line.startswith("//") and query.strip() and color.strip():
            out.append((query.strip(), color.strip()))
    return out


def format_groups(groups: list[tuple[str, str]], previous: str = "") -> str:
    """The groups as text, below the comments of the previous text."""
    comments = [x.strip() for x in previous.split("\n") if x.strip().startswith("//")]
    return "\n".join([*comments, *(f"{q.strip()} = {c.strip()}" for q, c in groups if q.strip() and c.strip())])


def compile_query(query: str, *, path: Column, name: Column, title: Column, tags: Column, properties: Column) -> Column:
    """tag:x (nested tags match), path:x, file:x, [property], [property:value], or a part
    of the name or title; case never matters."""
    q = query.strip()
    low = q.lower()
    if low.startswith("tag:"):
        tag = "#" + low[4:].removeprefix("#")
        return F.exists(tags, lambda t: (F.lower(t) == tag) | F.lower(t).startswith(f"{tag}/"))
    if low.startswith("path:"):
        return F.lower(path).contains(low[5:])
    if low.startswith("file:"):
        return F.lower(name).contains(low[5:])
    if m := re.fullmatch(r"\[([^:\]]+)(?::([^\]]*))?\]", q):
        text = F.lower(F.coalesce(property_value(properties, m[1].strip()), F.lit("")))
        return text != "" if m[2] is None else text.contains(m[2].strip().lower())
    return F.lower(name).contains(low) | F.coalesce(F.lower(title), F.lit("")).contains(low)


def color_for(groups: list[tuple[str, str]], **fields: Column) -> Column:
    """The colour of the first group that matches, or null."""
    out = F.lit(None).cast("string")
    for query, color in reversed(groups):
        out = F.when(compile_query(query, **fields), F.lit(color)).otherwise(out)
    return out


def search(works: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Works(id, label, title, depth, cited_by) with every typed word in label or title:
    those whose label starts with the text first, then the collection's, then the most
    cited; ties by label and id. A top-k."""
    words = F.filter(F.split(fold(F.lit(query)), r"[\s,;]+"), lambda w: w != "")
    text = fold(F.concat_ws(" ", "label", "title"))
    found = works.where((F.size(words) > 0) & F.forall(words, lambda w: F.contains(text, w)))
    starts = fold(F.col("label")).startswith(fold(F.lit(query.strip())))
    return found.orderBy(F.desc(starts), (F.col("depth") != 0), F.desc("cited_by"), "label", "id").limit(limit)


def autocomplete(values: DataFrame, typed: str, limit: int = 50) -> DataFrame:
    """(value, rank) of distinct values that start with, then that contain what is typed."""
    low = fold(F.lit(typed))
    v = values.select("value").distinct().withColumn("_f", fold(F.col("value"))).where(F.contains("_f", low))
    return v.select("value", F.when(F.col("_f").startswith(low), 0).otherwise(1).alias("rank")).orderBy("rank", "value").limit(limit)


def folders(paths: DataFrame) -> DataFrame:
    """(folder): all distinct ancestor folders of paths."""
    parts = F.split("path", "/")
    return paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder"), F.size(parts).alias("n")).where("n > 1").select("folder").distinct()


def property_catalog(properties: DataFrame) -> DataFrame:
    """(key, value) of distinct one-line values of at most 60 characters."""
    return properties.where((F.length("value") <= 60) & ~F.contains("value", F.lit("\n"))).select("key", "value").distinct()


def out_of_time(year: Column, limit: int) -> Column:
    """Whether a work shows at a year: unknown years always do."""
    return year.isNull() | (year <= limit)


def plausible_year(year: Column) -> Column:
    return F.when((year > 1000) & (year < 3000), year)
