"""Domain tables bound to the generic test tables, as DataFrames and as the same SQL for DuckDB.

competitors <- supplier, nation; prices (observation with its header) <- lineitem, part; runs, campaigns <- orders;
catalogue (first and last seen) <- lineitem, part; canonical <- part; social <- events; news <- documents;
questions <- conversations. A production user passes tables of these schemas instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import half_up, iso_week

__all__ = ["half_up", "iso_week"]

#: Fixed values of the binding.
AS_OF = "1998-06-01"
BASELINE = "1995-06-01"
OWN_BRAND = "Brand#1"

VIEWS = {
    "competitors": """select s_suppkey as competitor_id, s_name as competitor_name, n_name as brand_name,
        'https://www.' || lower(replace(s_name, '#', '-')) || '.example.com/' as official_url,
        case when s_suppkey % 4 = 0 then null else 'https://shop' || s_suppkey || '.example.net/x' end as secondary_url
        from supplier join nation on s_nationkey = n_nationkey""",
    "prices": """select l_orderkey * 10 + l_linenumber as observation_id, l_suppkey as competitor_id, p_brand as brand,
        cast(p_partkey as varchar) as model, p_name as product_name, p_type as category,
        floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 as price_kes, l_discount as discount,
        cast(l_shipdate as date) as observed_date, l_returnflag as return_flag, l_linestatus as line_status
        from lineitem join part on l_partkey = p_partkey""",
    "findings": """select 'F' || observation_id as finding_id, observation_id, competitor_id, brand, category,
        case when discount >= 0.08 then 'promotion' when return_flag = 'R' then 'news' else 'price' end as finding_type,
        product_name as summary, 'https://m' || model || '.example.com/p' as source_url,
        case when line_status = 'F' then 'OFFICIAL' else 'RETAIL' end as source_type, observed_date,
        case return_flag when 'A' then 'VERIFIED' when 'N' then 'PENDING' else 'REJECTED' end as verification_status,
        case when line_status = 'F' then 'HIGH' else 'MEDIUM' end as confidence,
        isoyear(observed_date) || '-W' || lpad(cast(weekofyear(observed_date) as varchar), 2, '0') as scan_week
        from prices""",
    "runs": """select o_orderkey as run_id, isoyear(o_orderdate) || '-W' || lpad(cast(weekofyear(o_orderdate) as varchar), 2, '0') as scan_week,
        cast(o_orderdate as date) as started_on, case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end as status,
        o_custkey % 100 as competitor_id, cast(o_orderkey % 7 as bigint) as declared from orders""",
    "campaigns": """select o_orderkey as campaign_id, o_custkey % 100 as competitor_id, 'Campaign ' || (o_custkey % 50) as campaign_name,
        o_orderstatus as campaign_type, 'Category ' || (o_orderkey % 6) as category, o_totalprice as offer_value,
        case when o_orderkey % 11 = 0 then null else cast(o_orderdate as date) end as start_date,
        case when o_orderkey % 7 = 0 then null else cast(o_orderdate as date) + 7 end as end_date,
        case when o_orderkey % 3 = 0 then 'PENDING' else 'VERIFIED' end as verification_status,
        case when o_orderkey % 5 = 0 then 'MEDIUM' else 'HIGH' end as confidence, cast(o_orderdate as date) as observed_date,
        case when o_orderkey % 11 = 0 and o_orderkey % 7 = 0 then null
            when o_orderkey % 7 <> 0 and cast(o_orderdate as date) + 7 < date '1998-06-01' then 'ended'
            when o_orderkey % 11 <> 0 and cast(o_orderdate as date) > date '1998-06-01' then 'upcoming' else 'active' end as status
        from orders where o_orderpriority = '1-URGENT'""",
    "catalogue": """select competitor_id, brand, model as identifier, case when cast(model as bigint) % 10 = 0 then '' else model end as model,
        product_name, category, min(observed_date) as first_seen_date, max(observed_date) as last_seen_date, count(*) as observations
        from prices group by competitor_id, brand, model, product_name, category""",
    "canonical": """select p_partkey as product_id, p_brand as brand, p_name as item_name,
        case when p_partkey % 9 = 0 then '' when p_partkey % 50 = 1 then 'DUP-1' else 'M' || p_partkey end as model_no, p_type as raw_category,
        p_type as category, regexp_extract(p_name, '([^ ]+)$', 1) as sub_category,
        case when p_size > 45 then 'REVIEW' else 'MAPPED' end as mapping_status,
        case when p_size % 3 = 0 then 'LOW' when p_size % 3 = 1 then 'MEDIUM' else 'HIGH' end as mapping_confidence,
        case when p_size % 5 = 0 then 'accessory' else 'core' end as product_scope,
        'https://shop.example.com/p/' || p_partkey as product_url, p_retailprice as price, p_size as size from part""",
    "social": """select event_id as observation_id, user_id % 100 as competitor_id,
        case user_id % 3 when 0 then 'facebook' when 1 then 'instagram' else 'x' end as platform, 'account' || user_id as account_name,
        'https://social.example.com/' || (event_id % 5000) as post_url, event_type as social_type,
        event_type || ' offer ' || props as post_text, cast(ts as date) as published_date, cast(ts as date) + 1 as observed_date,
        cast(json_extract_string(props, '$.k') as bigint) as likes, cast(floor(value) as bigint) as views,
        case when event_id % 4 = 0 then 'PENDING' else 'VERIFIED' end as verification_status, event_id, user_id, ts from events""",
    "news": """select doc_id as news_id, text as body, string_split(coalesce(text, ''), chr(10))[1] as headline, source as publisher,
        lang, 'HTTP://News.' || source || '.example.com/a/' || (doc_id % 700) || '/?id=' || (doc_id % 700) || '#top' as source_url,
        date '2024-01-01' + cast(doc_id % 60 as integer) as published_date,
        case when doc_id % 5 = 0 then 'REVIEW' when doc_id % 7 = 0 then 'OUT_OF_SCOPE' else 'IN_SCOPE' end as scope_status from documents""",
    "questions": "select conv_id, turn, text as question from conversations where role = 'user'",
}


class Tables:
    """The bound tables of one data folder; every property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def competitors(self) -> DataFrame:
        s = self.raw("supplier").join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select(
            F.col("s_suppkey").alias("competitor_id"),
            F.col("s_name").alias("competitor_name"),
            F.col("n_name").alias("brand_name"),
            F.expr("'https://www.' || lower(replace(s_name, '#', '-')) || '.example.com/'").alias("official_url"),
            F.expr("case when s_suppkey % 4 = 0 then null else 'https://shop' || s_suppkey || '.example.net/x' end").alias("secondary_url"),
        )

    @property
    def prices(self) -> DataFrame:
        j = self.raw("lineitem").join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        return j.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("observation_id"),
            F.col("l_suppkey").alias("competitor_id"),
            F.col("p_brand").alias("brand"),
            F.col("p_partkey").cast("string").alias("model"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            half_up(F.col("l_extendedprice") / F.col("l_quantity")).alias("price_kes"),
            F.col("l_discount").alias("discount"),
            F.col("l_shipdate").cast("date").alias("observed_date"),
            F.col("l_returnflag").alias("return_flag"),
            F.col("l_linestatus").alias("line_status"),
        )

    @property
    def findings(self) -> DataFrame:
        return self.prices.select(
            F.concat(F.lit("F"), "observation_id").alias("finding_id"), "observation_id", "competitor_id", "brand", "category",
            F.expr("case when discount >= 0.08 then 'promotion' when return_flag = 'R' then 'news' else 'price' end").alias("finding_type"),
            F.col("product_name").alias("summary"),
            F.expr("'https://m' || model || '.example.com/p'").alias("source_url"),
            F.expr("case when line_status = 'F' then 'OFFICIAL' else 'RETAIL' end").alias("source_type"), "observed_date",
            F.expr("case return_flag when 'A' then 'VERIFIED' when 'N' then 'PENDING' else 'REJECTED' end").alias("verification_status"),
            F.expr("case when line_status = 'F' then 'HIGH' else 'MEDIUM' end").alias("confidence"),
            iso_week(F.col("observed_date")).alias("scan_week"),
        )

    @property
    def runs(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("run_id"), iso_week(F.col("o_orderdate")).alias("scan_week"),
            F.col("o_orderdate").cast("date").alias("started_on"),
            F.expr("case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end").alias("status"),
            F.expr("o_custkey % 100").alias("competitor_id"), F.expr("o_orderkey % 7").alias("declared"),
        )

    @property
    def campaigns(self) -> DataFrame:
        day, k = "cast(o_orderdate as date)", "o_orderkey"
        return self.raw("orders").where("o_orderpriority = '1-URGENT'").select(
            F.col(k).alias("campaign_id"), F.expr("o_custkey % 100").alias("competitor_id"),
            F.expr("'Campaign ' || (o_custkey % 50)").alias("campaign_name"), F.col("o_orderstatus").alias("campaign_type"),
            F.expr(f"'Category ' || ({k} % 6)").alias("category"), F.col("o_totalprice").alias("offer_value"),
            F.expr(f"case when {k} % 11 = 0 then null else {day} end").alias("start_date"),
            F.expr(f"case when {k} % 7 = 0 then null else date_add({day}, 7) end").alias("end_date"),
            F.expr(f"case when {k} % 3 = 0 then 'PENDING' else 'VERIFIED' end").alias("verification_status"),
            F.expr(f"case when {k} % 5 = 0 then 'MEDIUM' else 'HIGH' end").alias("confidence"), F.expr(day).alias("observed_date"),
            F.expr(f"case when {k} % 11 = 0 and {k} % 7 = 0 then null when {k} % 7 <> 0 and date_add({day}, 7) < date '{AS_OF}' then 'ended'"
                   f" when {k} % 11 <> 0 and {day} > date '{AS_OF}' then 'upcoming' else 'active' end").alias("status"),
        )

    @property
    def catalogue(self) -> DataFrame:
        return (
            self.prices.groupBy("competitor_id", "brand", F.col("model").alias("identifier"), "product_name", "category")
            .agg(F.min("observed_date").alias("first_seen_date"), F.max("observed_date").alias("last_seen_date"), F.count("*").alias("observations"))
            .withColumn("model", F.when(F.col("identifier").cast("long") % 10 == 0, "").otherwise(F.col("identifier")))
        )

    @property
    def canonical(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("item_name"),
            F.expr("case when p_partkey % 9 = 0 then '' when p_partkey % 50 = 1 then 'DUP-1' else 'M' || p_partkey end").alias("model_no"),
            F.col("p_type").alias("raw_category"), F.col("p_type").alias("category"), F.regexp_extract("p_name", "([^ ]+)$", 1).alias("sub_category"),
            F.expr("case when p_size > 45 then 'REVIEW' else 'MAPPED' end").alias("mapping_status"),
            F.expr("case when p_size % 3 = 0 then 'LOW' when p_size % 3 = 1 then 'MEDIUM' else 'HIGH' end").alias("mapping_confidence"),
            F.expr("case when p_size % 5 = 0 then 'accessory' else 'core' end").alias("product_scope"),
            F.expr("'https://shop.example.com/p/' || p_partkey").alias("product_url"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"),
        )

    @property
    def social(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("observation_id"), F.expr("user_id % 100").alias("competitor_id"),
            F.expr("case user_id % 3 when 0 then 'facebook' when 1 then 'instagram' else 'x' end").alias("platform"),
            F.expr("'account' || user_id").alias("account_name"), F.expr("'https://social.example.com/' || (event_id % 5000)").alias("post_url"),
            F.col("event_type").alias("social_type"), F.expr("event_type || ' offer ' || props").alias("post_text"),
            F.col("ts").cast("date").alias("published_date"), F.date_add(F.col("ts").cast("date"), 1).alias("observed_date"),
            F.get_json_object("props", "$.k").cast("long").alias("likes"), F.floor("value").alias("views"),
            F.expr("case when event_id % 4 = 0 then 'PENDING' else 'VERIFIED' end").alias("verification_status"), "event_id", "user_id", "ts",
        )

    @property
    def news(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("doc_id").alias("news_id"), F.col("text").alias("body"), F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("headline"),
            F.col("source").alias("publisher"), "lang",
            F.expr("'HTTP://News.' || source || '.example.com/a/' || (doc_id % 700) || '/?id=' || (doc_id % 700) || '#top'").alias("source_url"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("published_date"),
            F.expr("case when doc_id % 5 = 0 then 'REVIEW' when doc_id % 7 = 0 then 'OUT_OF_SCOPE' else 'IN_SCOPE' end").alias("scope_status"),
        )

    @property
    def questions(self) -> DataFrame:
        return self.raw("conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
