"""Scans, sinks, id minting, column resolution and predicates over the domain tables."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.dedup import number_in_order
from .scratch import overwrite, scratch


def write_csv(df: DataFrame, columns: list[str], path: str) -> str:
    """The chosen columns with a header; other columns of df are ignored."""
    df.select(*columns).write.csv(path, header=True)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.json(path)
    return path


def append(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_catalogue_csv(spark: SparkSession, path: str, brand: str | None = None) -> DataFrame:
    """All columns as strings, blanks kept as empty strings, optionally tagged with a brand."""
    df = spark.read.csv(path, header=True, inferSchema=False).na.fill("")
    return df if brand is None else df.withColumn("brand", F.lit(brand))


def read_articles_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Canonical columns as strings; of each list the first name that df has (in any case) is taken, else null."""
    have = {c.lower(): c for c in df.columns}
    pick = lambda names: next((F.col(have[n.lower()]) for n in names if n.lower() in have), F.lit(None))
    return df.select(*(pick([k, *v]).cast("string").alias(k) for k, v in aliases.items()))


def one_shape(maps: list[tuple[str, DataFrame, dict[str, str]]]) -> DataFrame:
    """Sources of different column names as one record shape with a source tag."""
    out = None
    for source, df, columns in maps:
        part = df.select(F.lit(source).alias("source"), *(F.col(c).cast("string").alias(k) for k, c in columns.items()))
        out = part if out is None else out.unionByName(part)
    return out


def mint_ids(df: DataFrame, last: DataFrame, order: list[str], width: int = 5) -> DataFrame:
    """finding_id CI-YYYY-MM-NNNNN, continuing each month (column month) after last(month, last); a month is numbered by
    many tasks."""
    numbered = number_in_order(df, "month", order, "seq").join(last, "month", "left")
    n = (F.col("seq") + F.coalesce("last", F.lit(0))).cast("string")
    return numbered.withColumn("finding_id", F.concat(F.lit("CI-"), "month", F.lit("-"), F.lpad(n, width, "0"))).drop("seq", "last")


def split_header_children(df: DataFrame, last: DataFrame, children: dict[str, list[str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Header rows of new observations under minted ids, and the child rows of each finding_type with its own columns. The
    observations are numbered once and written; header and children are read from that table."""
    dated = df.withColumn("month", F.date_format("observed_date", "yyyy-MM"))
    named = overwrite(mint_ids(dated, last, ["observation_id", "model", "price_kes"], 6), scratch(df.sparkSession, "minted"))
    head = named.select("finding_id", "observation_id", "competitor_id", "brand", "observed_date", "finding_type")
    return head, {k: named.where(F.col("finding_type") == k).select("finding_id", *v) for k, v in children.items()}


def ledger(runs: DataFrame) -> DataFrame:
    done = lambda s: F.count_if(F.col("status") == s)
    return runs.groupBy("scan_week").agg(F.count("*").alias("runs"), done("completed").alias("completed"), done("failed").alias("failed"), F.sum("declared").alias("findings"))


def price_type(label: Column) -> Column:
    """Promotion terms first, then regular terms."""
    low = F.lower(label)
    return T.first_rule([(T.contains_any(low, ["sale", "offer", "promo", "now only", "discount"]), "promotion"),
                         (T.contains_any(low, ["regular", "was", "rrp", "list price"]), "regular")], "unspecified")


def domain_class(host: Column, lists: dict[str, list[str]], otherwise: str = "other") -> Column:
    """The first list with the host or a parent domain of it."""
    within = lambda d: (host == d) | F.endswith(host, F.lit("." + d))
    rules = []
    for name, domains in lists.items():
        cond = F.lit(False)
        for d in domains:
            cond = cond | within(d)
        rules.append((cond, name))
    return T.first_rule(rules, otherwise)


def looks_like_article(url: Column, blocked: list[str]) -> Column:
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    return (T.host_of(url) != "") & ~path.isin("", "/") & ~F.lower(path).rlike(rf"[.]({'|'.join(blocked)})$")


def active_on(day: Column) -> Column:
    """An undated campaign is not active; a null bound is open."""
    s, e = F.col("start_date"), F.col("end_date")
    return ~(s.isNull() & e.isNull()) & (s.isNull() | (s <= day)) & (e.isNull() | (e >= day))


def list_sources(df: DataFrame, verified_only: bool = False, active_only: bool = False, urls_only: str | None = None) -> DataFrame:
    if verified_only:
        df = df.where("verified")
    if active_only:
        df = df.where("active")
    return df.where(F.col(urls_only).isNotNull()) if urls_only else df


def search(df: DataFrame, terms: dict[str, str]) -> DataFrame:
    """Rows with any column containing its term in any case."""
    cond = F.lit(False)
    for c, term in terms.items():
        cond = cond | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(term.lower()))
    return df.where(cond)


def provider_posts(df: DataFrame, column: str = "payload") -> DataFrame:
    """Posts of nested provider payloads; alternative paths are coalesced."""
    post = (
        "struct<details:struct<post_link:string,post_id:string,comments_count:long,share_count:long,play_count:long>,"
        "values:struct<text:string,publish_time:string>,reactions:struct<total_reaction_count:long>,url:string,text:string,likes:long>"
    )
    parsed = F.from_json(column, f"struct<data:array<{post}>,posts:array<{post}>,results:array<{post}>>")
    rows = df.withColumn("p", parsed).withColumn("post", F.explode(F.coalesce("p.data", "p.posts", "p.results")))
    return rows.select(
        *(F.col(c) for c in df.columns if c != column),
        F.coalesce("post.details.post_link", "post.url").alias("post_url"),
        F.coalesce("post.values.text", "post.text").alias("post_text"),
        F.coalesce("post.reactions.total_reaction_count", "post.likes").alias("likes"),
        F.col("post.details.comments_count").alias("comments"),
        F.col("post.details.share_count").alias("shares"),
    )


def embedded_items(pages: DataFrame) -> DataFrame:
    """Catalogue items of a script array: objects with id, name and model; exact repeats once."""
    found = F.explode(F.regexp_extract_all("html", F.lit(r"\{[^{}]*\}"), F.lit(0)))
    item = F.from_json("item", "id long, name string, model string")
    rows = pages.select(found.alias("item")).select(item.alias("i"))
    return rows.select(F.col("i.id").alias("product_id"), F.col("i.name").alias("item_name"), F.col("i.model").alias("model_no")).distinct()
