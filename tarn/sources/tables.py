"""The relational tables of a data folder as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tarn.sources.graphs import MappedGraph, TableMap

NS = "urn:data:"

#: table: (name in IRIs, key, columns, references as predicate: (column, table))
TABLES = {
    "region": ("region", "r_regionkey", ["r_regionkey", "r_name"], {}),
    "nation": ("nation", "n_nationkey", ["n_nationkey", "n_name"], {"n_region": ("n_regionkey", "region")}),
    "customer": ("customer", "c_custkey", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"], {"c_nation": ("c_nationkey", "nation")}),
    "supplier": ("supplier", "s_suppkey", ["s_suppkey", "s_name", "s_acctbal"], {"s_nation": ("s_nationkey", "nation")}),
    "part": ("part", "p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], {}),
    "orders": ("order", "o_orderkey", ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], {"o_customer": ("o_custkey", "customer")}),
    "lineitem": ("lineitem", None, ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"], {"l_order": ("l_orderkey", "orders"), "l_part": ("l_partkey", "part"), "l_supplier": ("l_suppkey", "supplier")}),
    "events": ("event", "event_id", ["event_id", "ts", "event_type", "value", "props"], {"e_user": ("user_id", "user")}),
    "documents": ("doc", "doc_id", ["doc_id", "text", "lang", "source", "n_chars"], {}),
    "labels": ("doc", "doc_id", ["quality", "toxic"], {}),
    "benchmark": ("item", "item_id", ["item_id", "item_text"], {}),
    "pages": ("page", "page_id", ["page_id", "url", "html"], {}),
    "conversations": ("turn", None, ["conv_id", "turn", "role", "turn_text"], {}),
    "embeddings": ("vec", "vec_id", ["vec_id", "label"], {}),
}

#: Predicates that don't have their column's name.
COLUMN_OF = {"item_text": "text", "turn_text": "text"}


def table_maps(names: list[str] | None = None) -> list[TableMap]:
    out = []
    for table, (iri, key, columns, references) in TABLES.items():
        if names is None or table in names:
            to = lambda t: f"{NS}{TABLES[t][0] if t in TABLES else t}/"
            cols = {NS + c: COLUMN_OF.get(c, c) for c in columns}
            out.append(TableMap(table, f"{NS}{iri}/", key, cols, {NS + p: (c, to(t)) for p, (c, t) in references.items()}, f"{NS}{table.capitalize()}"))
    return out


#: Schemas of Parquet tables by path, time of change and length: a later query needs no job to find them.
_SCHEMAS: dict[tuple[str, int, int], StructType] = {}
#: DataFrames of single files by session and the same: a later query needn't list them again. Folders may change inside.
_FILES: dict[tuple, DataFrame] = {}
MOST_FILES = 1000


def read_table(spark: SparkSession, path: str) -> DataFrame:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath)
    key = path, status.getModificationTime(), status.getLen()
    whole = spark._jsparkSession.sessionUUID(), *key
    if whole in _FILES:
        return _FILES[whole]
    df = spark.read.schema(_SCHEMAS[key]).parquet(path) if key in _SCHEMAS else spark.read.parquet(path)
    _SCHEMAS[key] = df.schema
    if status.isFile():
        if len(_FILES) >= MOST_FILES:
            _FILES.clear()
        _FILES[whole] = df
    return df


def data_graph(spark: SparkSession, folder: str, names: list[str] | None = None) -> MappedGraph:
    """The graph of the Parquet tables of a folder; names: of some of them only."""
    return MappedGraph(spark, table_maps(names), lambda t: read_table(spark, f"{folder}/{t}.parquet"))
