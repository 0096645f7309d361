"""Structured search: predicates, ranges, tags, relevance, order and pages; trees; plans of merging and moving."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.functions import text as T
from stacklight.session import cut

MAX_PATTERN, MAX_INPUT = 128, 10_000
# Field weights of the simple relevance; named colours of annotations.
RELEVANCE = (("title", 3.0), ("creator", 2.0), ("abstract", 1.5), ("publicationTitle", 1.2), ("tags", 1.0), ("extra", 0.5))
COLOURS = (
    ("#ffd400", ("yellow", "question", "黄色")), ("#ff6666", ("red", "error", "important", "红色")), ("#5fb236", ("green", "agree", "绿色")),
    ("#2ea8e5", ("blue", "info", "蓝色")), ("#a28ae5", ("purple", "definition", "紫色")), ("#e56eee", ("magenta", "pink", "粉色")),
    ("#f19837", ("orange", "todo", "橙色")), ("#aaaaaa", ("gray", "grey", "灰色")),
)


def safe_pattern(pattern: str) -> str:
    """The pattern, if it can't run away: short, no back-reference, no repeated group with a choice or a repeat inside."""
    if len(pattern) > MAX_PATTERN or re.search(r"\\[1-9]", pattern) or re.search(r"\([^()]*[|*+{][^()]*\)\s*[*+{]", pattern):
        raise ValueError("unsafe pattern")
    re.compile(pattern)
    return pattern


def matches(value: Column, query: str, op: str = "contains") -> Column:
    """Case-insensitive; null is empty; two empty sides match, one doesn't."""
    v, q = F.lower(F.coalesce(value, F.lit(""))), query.lower()
    if not q:
        return v == ""
    test = {
        "exact": lambda: v == q,
        "startsWith": lambda: v.startswith(q),
        "endsWith": lambda: v.endswith(q),
        "regex": lambda: F.rlike(F.substring(v, 1, MAX_INPUT), F.lit("(?i)" + safe_pattern(query))),
    }.get(op, lambda: v.contains(q))
    return (v != "") & test()


def year_range(year: Column, spec: str) -> Column:
    """"2010-2015", "2010-", "-2015", "2010"; a row without a year passes."""
    m = re.fullmatch(r"\s*(\d{4})?\s*(-)?\s*(\d{4})?\s*", spec)
    if not m or not (m[1] or m[3]):
        raise ValueError(f"not a range of years: {spec}")
    lo, hi = m[1], m[3] if m[2] else m[1]
    ok = F.lit(True)
    if lo:
        ok = ok & (year >= int(lo))
    if hi:
        ok = ok & (year <= int(hi))
    return year.isNull() | ok


def instant_range(ts: Column, start: str | None, end: str | None) -> Column:
    ok = F.lit(True)
    if start:
        ok = ok & (ts >= F.lit(start).cast("timestamp"))
    if end:
        ok = ok & (ts <= F.lit(end).cast("timestamp"))
    return ok


def numeric_range(value: Column, low: float, high: float) -> Column:
    """0 leaves a side open; a missing value is 0."""
    v = F.coalesce(value.cast("double"), F.lit(0.0))
    return (v >= low if low else F.lit(True)) & (v <= high if high else F.lit(True))


def any_contains(fields: list[Column], words: list[str]) -> Column:
    """The scan for candidates: any word in any field."""
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(f, F.lit(""))).contains(w.lower()) for f in fields for w in words])


def tag_hits(tags: Column, asked: list[str], match: str = "exact") -> Column:
    """The asked tags that a row's tags satisfy, in the order asked."""
    rule = {"exact": lambda t, q: t == q, "contains": lambda t, q: t.contains(q), "startsWith": lambda t, q: t.startswith(q)}[match]
    have = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    return F.filter(F.array(*[F.lit(a) for a in asked]), lambda a: F.exists(have, lambda t: rule(t, F.lower(a))))


def tag_filter(tags: Column, asked: list[str], mode: str = "any", match: str = "exact") -> Column:
    n = F.size(tag_hits(tags, asked, match))
    return {"any": n > 0, "all": n == len(asked), "none": n == 0}[mode]


def query_words(q: str) -> list[str]:
    import unicodedata

    words = re.findall(r"[^\W_]+", unicodedata.normalize("NFC", q.lower()))
    return [w for w in words if len(w) > 1 or re.search(f"[{T.HAN}]", w)][:12]


def relevance(fields: dict[str, Column], q: str, boosted: tuple[str, ...] = (), title: str | None = None, creator: str | None = None) -> Column:
    """Field weights times the words of the query that the field contains; an asked title or creator adds its weight."""
    total = F.lit(0.0)
    for name, weight in RELEVANCE:
        if name in fields:
            low = F.lower(F.coalesce(fields[name], F.lit("")))
            w = weight * (2 if name in boosted else 1)
            for word in query_words(q):
                total = total + F.when(low.contains(word), F.lit(w)).otherwise(F.lit(0.0))
            asked = {"title": title, "creator": creator}.get(name)
            if asked:
                total = total + F.when(low.contains(asked.lower()), F.lit(w)).otherwise(F.lit(0.0))
    return total


def colour_matches(colour: Column, asked: str) -> Column:
    a = asked.lower()
    names = [h for h, ns in COLOURS if any(a in n or n in a for n in ns)]
    return (F.lower(colour) == a) | F.lower(colour).isin(*names) if names else F.lower(colour) == a


def colour_name(colour: Column) -> Column:
    return F.coalesce(F.create_map(*[x for h, ns in COLOURS for x in (F.lit(h), F.lit(ns[0]))])[F.lower(colour)], colour)


def importance(content: Column, kind: Column, comment: Column, age_days: Column) -> Column:
    """Length up to .3, kind .1 to .4, a comment .2, recency up to .1."""
    k = F.create_map(*[x for n, v in (("note", 0.4), ("highlight", 0.3), ("annotation", 0.3), ("text", 0.25), ("ink", 0.2), ("image", 0.2)) for x in (F.lit(n), F.lit(v))])
    recent = F.greatest(F.lit(0.0), F.lit(0.1) * (1 - F.least(age_days, F.lit(365.0)) / 365.0))
    return F.least(F.lit(1.0), F.least(F.length(content) / 500.0, F.lit(1.0)) * 0.3 + F.coalesce(k[kind], F.lit(0.1)) + F.when(F.length(comment) > 0, 0.2).otherwise(0.0) + recent)


def annotation_relevance(content: Column, comment: Column, q: str) -> Column:
    """.6 for the content, .4 for the comment, .3 for the share of the query's words; at most 1."""
    c, m, words = F.lower(F.coalesce(content, F.lit(""))), F.lower(F.coalesce(comment, F.lit(""))), query_words(q)
    hit = lambda x: F.when(x.contains(q.lower()), 1.0).otherwise(0.0)
    share = sum((F.when(c.contains(w) | m.contains(w), 1.0).otherwise(0.0) for w in words), F.lit(0.0)) / max(1, len(words))
    return F.least(F.lit(1.0), 0.6 * hit(c) + 0.4 * hit(m) + 0.3 * share)


# --- trees ---


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): every node below each root, itself included, once, to any depth; cycles end. edges(node, parent).

    One join per level over the frontier only, which is written so that no plan grows with the depth."""
    seen = frontier = cut(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct())
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.select("root", F.col("node").alias("parent")).join(edges.select("node", "parent"), "parent").select("root", "node", F.lit(depth).alias("depth")).distinct()
        frontier = cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        seen = seen.unionByName(frontier) if depth % 16 else cut(seen.unionByName(frontier))
    return seen


def paths(nodes: DataFrame) -> DataFrame:
    """(node, path): names from the root down joined by "/", to any depth; nodes(node, parent, name). Stops at a cycle."""
    p = nodes.select("node", F.col("parent").alias("up"), F.col("name").alias("path"), F.array("node").alias("seen"))
    above = nodes.select(F.col("node").alias("up"), F.col("parent").alias("next"), F.col("name").alias("n"))
    while not p.filter("up is not null").isEmpty():
        j = p.join(above, "up", "left")
        go = ~F.coalesce(F.array_contains("seen", F.col("up")), F.lit(False)) & F.col("n").isNotNull()
        p = cut(j.select("node", F.when(go, F.col("next")).alias("up"), F.when(go, F.concat_ws("/", "n", "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("up").isNotNull(), F.array_append("seen", F.col("up"))).otherwise(F.col("seen")).alias("seen")))
    return p.select("node", "path")


def resolved(paths_: DataFrame, asked: str) -> list:
    """The nodes of a path, case aside: one, none, or an error where several have it."""
    found = [r["node"] for r in paths_.filter(F.lower("path") == asked.strip("/ ").lower()).orderBy("node").limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"several collections have the path {asked}")
    return found


def scope(below: DataFrame, items: DataFrame, library: DataFrame, most: int = 5000) -> DataFrame:
    """The items below some collections, once each; of the whole library where there are none or more than ``most``."""
    mine = below.join(items, "node").select("item").distinct()
    n = mine.limit(most + 1).count()
    return mine if 0 < n <= most else library.select("item").distinct()


# --- plans ---


def completeness(filled: dict[str, Column], creators: Column | None = None, attachments: Column | None = None) -> Column:
    """5 for the DOI, 3 for abstract and publication, 2 for the date, 1 for other fields; 2 for creators, up to 3 for attachments."""
    weight = {"doi": 5, "abstract": 3, "publicationTitle": 3, "date": 2}
    total = F.lit(0)
    for name, c in filled.items():
        total = total + F.when(F.length(c.cast("string")) > 0, weight.get(name, 1)).otherwise(0)
    if creators is not None:
        total = total + F.when(creators > 0, 2).otherwise(0)
    if attachments is not None:
        total = total + F.least(attachments, F.lit(3))
    return total


def merge_plan(rows: DataFrame, group: list[str], key: list) -> DataFrame:
    """Of each group with two or more rows the master: most complete, in most collections, oldest, first by key.
    rows: group columns, ``complete``, ``collections``, ``added``."""
    w = Window.partitionBy(*group).orderBy(F.desc("complete"), F.desc("collections"), F.asc_nulls_last("added"), *key)
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return rows.withColumn("n", n).withColumn("r", F.row_number().over(w)).filter("n > 1").withColumn("master", F.col("r") == 1)


def move_plan(asked: DataFrame, existing: DataFrame, membership: DataFrame, target: int, keys: list[str]) -> DataFrame:
    """What moving does to each asked row, once each: missing, already in the target, or moved, and what it leaves."""
    one = asked.select(*keys).distinct()
    found = existing.select(*keys).distinct().withColumn("found", F.lit(True))
    m = membership.groupBy(*keys).agg(F.bool_or(F.col("collection") == target).alias("inside"), F.count_if(F.col("collection") != target).alias("leaves"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("inside"), "already").otherwise("moves")
    return one.join(found, keys, "left").join(m, keys, "left").select(*keys, state.alias("state"), F.coalesce("leaves", F.lit(0)).alias("leaves"))


def merge_gains(plan: DataFrame, attachments: DataFrame, group: list[str]) -> DataFrame:
    """plan(group, row, master, tags array), attachments(group, row) -> (group, trashed, moved, gained): rows that go, attachments that move
    to the master, and tags that the master gains. Groups with several masters or none raise."""
    g = plan.groupBy(*group).agg(F.count_if("master").alias("masters"), F.count_if(~F.col("master")).alias("trashed"))
    g = g.withColumn("trashed", F.when(F.col("masters") == 1, F.col("trashed")).otherwise(F.raise_error(F.lit("a group needs one master"))))
    moved = attachments.join(plan.filter(~F.col("master")).select(*group, "row"), [*group, "row"], "left_semi").groupBy(*group).agg(F.count(F.lit(1)).alias("moved"))
    tags = plan.select(*group, "master", F.explode("tags").alias("t")).groupBy(*group, "t").agg(F.bool_or("master").alias("has"))
    gained = tags.filter(~F.col("has")).groupBy(*group).agg(F.count(F.lit(1)).alias("gained"))
    return g.join(moved, group, "left").join(gained, group, "left").select(*group, "trashed", F.coalesce("moved", F.lit(0)).alias("moved"), F.coalesce("gained", F.lit(0)).alias("gained"))
