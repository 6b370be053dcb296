"""Adapter from a retail star schema to the three source tables.

A supplier's month is one event, a customer's part family is one person, a line item is one
result. Every rule is an expression on the given tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.sources.tables import Sources

# The columns in use, declared so that no footer has to be read to plan a query.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "part": "p_partkey bigint, p_type string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


# The text keys of an event and of a person.
COMPETITION_ID = "concat(l_suppkey, '-', month_key)"
FAMILY = "cast(l_partkey % 8 as int)"
PERSON_ID = "concat('P', o_custkey, '-', family)"

# How the attributes of an event follow from its supplier, month and nation.
COMPETITION_COLUMNS = (
    f"{COMPETITION_ID} as id",
    """case when l_suppkey % 5 = 0 then concat_ws(' ', s_name, 'Edition', month_key)
            when l_suppkey % 5 in (1, 2) then concat_ws(' ', s_name, year(start_date))
            else concat_ws(' ', s_name, month(start_date), year(start_date)) end as name""",
    "concat_ws(' ', n_name, l_suppkey % 10) as cell_name",
    "n_name as city_name",
    "r_name as country_id",
    "year(start_date) as year",
    "month(start_date) as month",
    "day(start_date) as day",
    "start_date",
    "end_date",
    "if((l_suppkey * 31 + month_key) % 17 = 0, 1, 0) as cancelled",
    """case when l_suppkey % 11 <> 0 then cast(
         49000000 + s_nationkey % 5 * 1200000 + l_suppkey % 3 * 50000 as bigint)
       end as latitude_microdegrees""",
    """case when l_suppkey % 11 <> 0 then cast(
         14000000 + case s_nationkey div 5 when 0 then 0 when 1 then 900000
                    else s_nationkey div 5 * 2000000 end + l_suppkey % 4 * 150000 as bigint)
       end as longitude_microdegrees""",
    "case when l_suppkey % 13 <> 0 then specs end as event_specs",
)


def _line_items(tables: dict[str, DataFrame]) -> DataFrame:
    """With all that is needed of a row made before it is shuffled."""
    return tables["lineitem"].selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", f"{FAMILY} as family",
        "cast(l_shipdate as date) as day",
        "year(l_shipdate) * 100 + month(l_shipdate) as month_key",
    )


def _nations(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["nation"].join(tables["region"], F.expr("n_regionkey = r_regionkey"))


def _event_specs(tables: dict[str, DataFrame]) -> DataFrame:
    """Sorted distinct part types sold in a supplier's month, as one space-separated text.

    Deduplicated before the list is built; a part type comes from a short fixed vocabulary.
    """
    return (
        _line_items(tables)
        .join(tables["part"], F.expr("l_partkey = p_partkey"))
        .selectExpr("l_suppkey", "month_key", "lower(p_type) as spec")
        .distinct()
        .groupBy("l_suppkey", "month_key")
        .agg(F.expr("array_join(sort_array(collect_list(spec)), ' ') as specs"))
    )


def _competitions(tables: dict[str, DataFrame]) -> DataFrame:
    """The left join on the grouping keys is dropped by the optimizer when event_specs is unused."""
    return (
        _line_items(tables)
        .groupBy("l_suppkey", "month_key")
        .agg(F.min("day").alias("start_date"), F.max("day").alias("end_date"))
        .join(_event_specs(tables), ["l_suppkey", "month_key"], "left")
        .join(tables["supplier"], F.expr("l_suppkey = s_suppkey"))
        .join(_nations(tables), F.expr("s_nationkey = n_nationkey"))
        .selectExpr(*COMPETITION_COLUMNS)
    )


def _results(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per customer on the right, so that an unused country costs no join.

    Countries go to the orders, which are fewer than the line items.
    """
    countries = (
        tables["customer"]
        .join(_nations(tables), F.expr("c_nationkey = n_nationkey"))
        .groupBy("c_custkey")
        .agg(F.max("r_name").alias("person_country_id"))
    )
    orders = tables["orders"].join(countries, F.expr("o_custkey = c_custkey"), "left")
    return (
        _line_items(tables)
        .join(orders, F.expr("l_orderkey = o_orderkey"))
        .selectExpr(
            f"{COMPETITION_ID} as competition_id", f"{PERSON_ID} as person_id", "person_country_id"
        )
    )


def _persons(tables: dict[str, DataFrame]) -> DataFrame:
    """A current record per person; every tenth customer's persons have an outdated one too."""
    return (
        tables["lineitem"]
        .selectExpr("l_orderkey", f"{FAMILY} as family")
        .join(tables["orders"], F.expr("l_orderkey = o_orderkey"))
        .select("o_custkey", "family")
        .distinct()
        .join(tables["customer"], F.expr("o_custkey = c_custkey"))
        .join(_nations(tables), F.expr("c_nationkey = n_nationkey"))
        .selectExpr(
            f"{PERSON_ID} as person_id",
            "explode(if(o_custkey % 10 = 0, array(1, 2), array(1))) as sub_id",
            "c_name",
            "r_name as country_id",
        )
        .selectExpr("person_id", "sub_id", "if(sub_id = 1, c_name, 'old') as name", "country_id")
    )


def star_schema_sources(spark: SparkSession, directory: str) -> Sources:
    """Sources over ``<directory>/{lineitem,orders,...}.parquet``."""
    tables = {
        name: spark.read.schema(schema).parquet(f"{directory}/{name}.parquet")
        for name, schema in SCHEMAS.items()
    }
    return Sources(_competitions(tables), _results(tables), _persons(tables))
