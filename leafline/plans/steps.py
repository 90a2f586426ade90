"""Tools by name, chains of them, and chains kept as rows: operators from DataFrame to DataFrame with parameters.

A step names a tool and its values; a chain is folded over a table with DataFrame.transform, so Catalyst sees
one plan. Saved chains are JSON texts in a table.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.functions import text as T
from leafline.operators import pages, pii
from leafline.plans.registry import register
from leafline.plans.tables import load


@dataclass(frozen=True)
class Tool:
    """What a tool is called, says of itself and does; options are its values where none are given."""

    slug: str
    name: str
    blurb: str
    run: Callable[..., DataFrame]
    options: dict = field(default_factory=dict)
    keywords: str = ""


def keep(df: DataFrame, pages_: str, key: str, page: str) -> DataFrame:
    last = int(df.agg(F.max(page)).first()[0] or 0)
    return pages.keep_pages(df, key, page, pages_, last).withColumn(page, F.col("position").cast("long")).drop("position")


def mask_terms(df: DataFrame, kinds: str, text: str) -> DataFrame:
    return pii.with_hits(df, text, kinds=[k for k in kinds.split(",") if k]).withColumn(text, pii.redacted(F.col(text), F.col("hits"))).drop("hits")


TOOLS = {
    t.slug: t
    for t in (
        Tool("keep-pages", "Keep pages", "Only the pages of a list, in its order", keep, {"pages_": "all", "key": "conv_id", "page": "page"}, "extract select order"),
        Tool("drop-pages", "Remove pages", "All pages but those of a list", lambda df, pages_, page: pages.drop_pages(df, page, pages_, 1 << 20 if not pages_ else max(map(int, pages_.split(",")), default=0) + 1), {"pages_": "", "page": "page"}, "delete"),
        Tool("mask", "Mask personal data", "Personal data as dots", mask_terms, {"kinds": "email,card,ip", "text": "text"}, "redact privacy hide"),
        Tool("lower", "Lower case", "Texts in lower case", lambda df, text: df.withColumn(text, F.lower(text)), {"text": "text"}),
        Tool("stamp", "Number pages", "A line of text with the page's number", lambda df, format_, text, page: df.withColumn(text, F.concat(F.col(text), F.lit("\n"), F.replace(F.lit(format_), F.lit("{n}"), F.col(page).cast("string")))), {"format_": "Page {n}", "text": "text", "page": "page"}, "numbers footer"),
    )
}


def run_tool(df: DataFrame, slug: str, **values: object) -> DataFrame:
    """df under one tool; values beside its own are refused."""
    if slug not in TOOLS:
        raise ValueError(f"no such tool: {slug}")
    tool = TOOLS[slug]
    if extra := set(values) - set(tool.options):
        raise ValueError(f"{tool.name} has no {', '.join(sorted(extra))}")
    return tool.run(df, **{**tool.options, **values})


def run_steps(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Each step's result is the next one's input; steps: dicts of slug and values."""
    if not steps:
        raise ValueError("a chain needs a step")
    return reduce(lambda d, s: d.transform(run_tool, s["slug"], **s.get("values", {})), steps, df)


def saved_steps(spark: SparkSession, chains: dict[str, list[dict]]) -> DataFrame:
    """Chains as rows: name and steps (JSON); values that JSON can't hold are left out."""

    def plain(values: dict) -> dict:
        return {k: v for k, v in values.items() if isinstance(v, str | int | float | bool | None)}

    rows = [(name, json.dumps([{"slug": s["slug"], "values": plain(s.get("values", {}))} for s in steps])) for name, steps in chains.items()]
    return spark.createDataFrame(rows, "name string, steps string")


def load_steps(saved: DataFrame, name: str) -> list[dict]:
    """The newest chain of a name (a table of a few chains)."""
    found = saved.where(F.col("name") == name).select("steps").head()
    if found is None:
        raise ValueError(f"no chain named {name}")
    return json.loads(found["steps"])


def accepts(accept: str | None, name: Column, kind: Column) -> Column:
    """Whether a file's name or kind fits a list of endings and kinds such as .pdf, image/*."""
    parts = [p.strip().lower() for p in (accept or "").split(",") if p.strip()]
    if not accept or accept in ("*", "*/*"):
        return F.lit(True)
    n, k = F.lower(name), F.lower(F.coalesce(kind, F.lit("")))
    return reduce(lambda a, b: a | b, (n.endswith(p) if p.startswith(".") else k.startswith(p[:-1]) if p.endswith("/*") else k == p for p in parts), F.lit(False))


def option(values: Column, key: str, kind: str, default: object) -> Column:
    """A value of a map of texts as string, double or boolean; the default for what is missing or can't be read."""
    v = F.element_at(values, key)
    read = {"string": F.when(v != "", v), "double": F.when(~F.isnan(v.try_cast("double")) & (F.abs(v.try_cast("double")) < float("inf")), v.try_cast("double")), "boolean": F.when(v == "true", True).when(v == "false", False)}[kind]
    return F.coalesce(read, F.lit(default))


def merged(state: Column, defaults: Column) -> Column:
    """A stored map over the defaults."""
    return F.when(state.isNull(), defaults).otherwise(F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(state, k)), state))


def stored_state(json_text: Column, schema: str, fallback: Column) -> Column:
    """What a JSON text holds, the fallback if it can't be read."""
    return F.coalesce(F.from_json(json_text, schema, {"mode": "PERMISSIVE"}), fallback)


def search_score(query: str, name: Column, hay: Column) -> Column:
    """Points for a name that begins with or holds the query, and for each of its words anywhere; 0 below what counts as found."""
    q = query.strip().lower()
    words = q.split()
    low = F.lower(name)
    score = F.when(low.startswith(q), 10).otherwise(0) + F.when(F.contains(low, F.lit(q)), 6).otherwise(0)
    for w in words:
        score = score + F.when(F.contains(F.lower(F.concat_ws(" ", name, hay)), F.lit(w)), 2).otherwise(0)
    return F.when(score >= max(2, 2 * len(words)), score).otherwise(0)


def search_tools(spark: SparkSession, query: str) -> DataFrame:
    """slug, name and score of the tools found, best first by score and place in the catalogue."""
    rows = [(i, t.slug, t.name, f"{t.blurb} {t.keywords} {t.slug.replace('-', ' ')}") for i, t in enumerate(TOOLS.values())]
    df = spark.createDataFrame(rows, "place int, slug string, name string, hay string")
    return df.withColumn("score", search_score(query, F.col("name"), F.col("hay"))).where("score > 0").orderBy(F.desc("score"), "place").select("slug", "name", "score")


@register(
    "part_search",
    """SELECT p_partkey, CASE WHEN lower(p_name) LIKE 'pa%' THEN 10 ELSE 0 END + CASE WHEN lower(p_name) LIKE '%pa%' THEN 6 ELSE 0 END + CASE WHEN lower(p_name || ' ' || p_type) LIKE '%pa%' THEN 2 ELSE 0 END AS score
    FROM part WHERE lower(p_name || ' ' || p_type) LIKE '%pa%'""",
)
def part_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy search over names and kinds."""
    df = load(spark, sf_dir, "part")
    return df.select("p_partkey", search_score("pa", F.col("p_name"), F.col("p_type")).alias("score")).where("score > 0")


@register(
    "tool_chain",
    """SELECT conv_id, page, lower(text) || chr(10) || 'Side ' || page AS text FROM (SELECT conv_id, s.position AS page, text FROM (SELECT conv_id, turn + 1 AS p, text FROM conversations) c JOIN (SELECT unnest([2, 1]) AS p, unnest([1, 2]) AS position) s ON s.p = c.p)""",
)
def tool_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tools in a chain: two pages by position, in lower case, with their numbers."""
    steps = [{"slug": "keep-pages", "values": {"pages_": "2,1"}}, {"slug": "lower"}, {"slug": "stamp", "values": {"format_": "Side {n}"}}]
    return run_steps(pages.pages(spark, sf_dir).select("conv_id", "page", "text"), steps).select("conv_id", "page", "text")


@register("accepted_files", "SELECT p_partkey, lower(p_name) LIKE '%e' OR p_type = 'x' OR lower(p_type) LIKE 's%' AS ok FROM part")
def accepted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("f."), F.right("p_name", F.lit(1))).alias("name"), F.concat(F.left(F.lower("p_type"), F.lit(1)), F.lit("/"), F.col("p_type")).alias("kind"))
    return df.select("p_partkey", accepts(".e, s/*", F.col("name"), F.col("kind")).alias("ok"))


@register("read_options", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 7.5 WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey AS DOUBLE) ELSE 7.5 END AS size, o_orderkey % 2 = 0 AS mirror, CASE WHEN o_orderkey % 3 = 2 THEN 'none' ELSE 'n' || o_orderkey END AS label FROM orders")
def read_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options as texts: numbers that can't be read, blanks and missing ones take the default."""
    k = F.col("o_orderkey")
    size = F.when(k % 3 == 0, "wide").when(k % 3 == 1, k.cast("string"))
    values = F.create_map(F.lit("size"), size, F.lit("mirror"), (k % 2 == 0).cast("string"), F.lit("label"), F.when(k % 3 == 2, "").otherwise(F.concat(F.lit("n"), k.cast("string"))))
    df = load(spark, sf_dir, "orders").select("o_orderkey", values.alias("v"))
    return df.select("o_orderkey", option(F.col("v"), "size", "double", 7.5).alias("size"), option(F.col("v"), "mirror", "boolean", False).alias("mirror"), option(F.col("v"), "label", "string", "none").alias("label"))


@register("merged_state", """SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, 'light' AS theme FROM events""")
def merged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values over defaults, read from JSON."""
    stored = stored_state(F.col("props"), "map<string,string>", F.create_map().cast("map<string,string>"))
    df = load(spark, sf_dir, "events").select("event_id", merged(stored, F.create_map(F.lit("k"), F.lit("0"), F.lit("theme"), F.lit("light"))).alias("s"))
    return df.select("event_id", F.element_at("s", "k").cast("long").alias("k"), F.element_at("s", "theme").alias("theme"))


@register("labels_for_tool", "SELECT conv_id, list_position(roles, 'assistant') AS place FROM (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1) WHERE list_contains(roles, 'assistant')")
def labels_for_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose list holds a name, with its place there, which orders them."""
    lists = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return lists.where(F.array_contains("roles", "assistant")).select("conv_id", F.array_position("roles", "assistant").cast("int").alias("place"))


@register("keyword_lists", "SELECT p_partkey, list_filter(list_transform(string_split_regex(p_name || ', ' || p_type || ';;' || p_brand, '[,;]'), lambda x: trim(x)), lambda x: x <> '') AS words, round(0.2126 * (p_partkey % 256) / 255 + 0.7152 * (p_size % 256) / 255, 9) AS light FROM part")
def keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that people type, and the luminance of a colour made of two numbers."""
    colour = F.format_string("#%02x%02x00", (F.col("p_partkey") % 256).cast("int"), (F.col("p_size") % 256).cast("int"))
    typed = F.concat("p_name", F.lit(", "), "p_type", F.lit(";;"), "p_brand")
    return load(spark, sf_dir, "part").select("p_partkey", T.keyword_list(typed).alias("words"), F.round(T.luminance(colour), 9).alias("light"))
