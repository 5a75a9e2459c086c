"""Profiles of all given tables in one union, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from tessera.catalog import register
from tessera.operators.aggregate import table_profile
from tessera.sources.readers import table

#: Columns of the given tables, for the SQL (the query reads them from the files).
TABLES = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
#: Aliases of a field, and whether only numbers above 0 count.
FIELDS = {
    "release_date_coverage": (["o_orderdate", "l_shipdate"], False),
    "price_coverage": (["o_totalprice", "l_extendedprice", "p_retailprice", "c_acctbal", "s_acctbal", "quality"], True),
    "text_coverage": (["TEXT", "html", "url"], False),
    "organization_coverage": (["p_brand", "c_name", "s_name", "n_name", "r_name", "lang"], False),
}


def q_table_profile(spark, d):
    """Rows, columns, latest date, coverage of fields by alias and column names of every table."""
    return reduce(DataFrame.unionByName, [table_profile(table(spark, d, name), name, FIELDS) for name in TABLES])


def _sql(name: str) -> str:
    columns = TABLES[name].split()
    days = [f"max({c})::DATE" for c in columns if "date" in c]
    latest = f"coalesce(greatest({', '.join(days)}, NULL)::VARCHAR, '')" if days else "''"
    shares = []
    for field, (aliases, positive) in FIELDS.items():
        known = [f"coalesce({a} > 0, false)" if positive else f"coalesce(trim({a}::VARCHAR) <> '', false)" for a in map(str.lower, aliases) if a in columns]
        shares.append(f"round(coalesce(avg(CASE WHEN {' OR '.join(known) or 'false'} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0), 4) AS {field}")
    return f"SELECT '{name}' AS \"table\", count(*) AS rows, {len(columns)}::BIGINT AS columns, {latest} AS latest_source_date, {', '.join(shares)}, '{','.join(columns)}' AS columns_present FROM {name}"


register("q_table_profile", q_table_profile, " UNION ALL ".join(map(_sql, TABLES)))
