"""Exports written out of the star schema, so that scans, catalog and links can be run over as many records as there is data."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import load


def _id(prefix: str, key: str) -> str:
    return f"concat('{prefix}', CAST({key} AS STRING))"


def _ref(prefix: str, key: str, name: str = "'n'", when: str = "true") -> str:
    """A reference element; null, and so not written, where the condition doesn't hold."""
    return f"CASE WHEN {when} THEN named_struct('@id', CAST({key} AS BIGINT), '@name', {name}, '@UUID', {_id(prefix, key)}) END"


def _step(kind: str, uuid: str, enabled: str, values: str) -> str:
    return f"named_struct('@index', 0, '@id', {kind}, '@name', 'Step', '@enable', CASE WHEN {enabled} THEN 'True' ELSE 'False' END, 'UUID', {uuid}, 'ParameterValues', {values})"


ODD = "'a & <b> \"c\"'"  # a name that needs character references


def _parts(spark: SparkSession, d: str) -> DataFrame:
    looked = f"named_struct('FieldReference', named_struct('@id', p_partkey + 1, '@name', 'n', '@UUID', {_id('FLD', 'p_partkey + 1')}, 'TableOccurrenceReference', {_ref('TO', 'p_partkey % 25')}))"
    field = (
        f"named_struct('@id', p_partkey, '@name', p_name, 'UUID', {_id('FLD', 'p_partkey')}, 'Calculation', CASE WHEN p_partkey % 3 = 0 THEN named_struct('DDRREF', named_struct('@hash', {_id('H', 'p_partkey')}, '_VALUE', 'z')) END, "
        f"'AutoEnter', CASE WHEN p_partkey % 7 = 0 THEN named_struct('@type', 'Looked_up', 'Looked_up', {looked}) END, 'Validation', CASE WHEN p_partkey % 9 = 0 THEN named_struct('ValueListReference', {_ref('VL', 'p_partkey % 12')}) END, "
        f"'SummaryInfo', CASE WHEN p_partkey % 5 = 0 THEN named_struct('SummaryField', named_struct('FieldReference', {_ref('FLD', 'p_partkey % 50')})) END)"
    )
    chunk = lambda kind, text, ref: f"named_struct('@type', '{kind}', '_VALUE', {text}, 'FieldReference', {ref})"
    none = "CAST(NULL AS STRUCT<`@id`: BIGINT, `@name`: STRING, `@UUID`: STRING>)"
    tokens = f"array({chunk('FieldRef', 'CAST(NULL AS STRING)', _ref('FLD', 'p_partkey + 2'))}, {chunk('FunctionRef', chr(39) + 'Abs' + chr(39), none)}, {chunk('VariableReference', _id('$$$v', 'p_partkey % 10'), none)})"
    return load(spark, d, "part").select(
        F.expr(f"named_struct('BaseTableReference', {_ref('BT', 'p_size % 25', _id('T', 'p_size % 25'))}, 'ObjectList', named_struct('Field', array({field})))").alias("FieldCatalog"),
        F.expr(f"CASE WHEN p_partkey % 3 = 0 THEN named_struct('@hash', {_id('H', 'p_partkey')}, 'ChunkList', named_struct('Chunk', {tokens})) END").alias("_C_0"),
    )


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select(
        F.expr(f"named_struct('@id', n_nationkey, '@name', n_name, 'UUID', {_id('BT', 'n_nationkey')})").alias("BaseTable"),
        F.expr(f"named_struct('@id', n_nationkey, '@name', {ODD}, 'UUID', {_id('TO', 'n_nationkey')}, 'BaseTableSourceReference', named_struct('BaseTableReference', {_ref('BT', 'n_nationkey', 'n_name')}, 'DataSourceReference', {_ref('DS', 'n_nationkey % 3', when='n_regionkey = 1')}))").alias("TableOccurrence"),
    )


def _customers(spark: SparkSession, d: str) -> DataFrame:
    predicate = lambda k: f"named_struct('@type', 'Equal', 'LeftField', named_struct('FieldReference', {_ref('FLD', f'c_custkey % {k}')}), 'RightField', named_struct('FieldReference', {_ref('FLD', f'(c_custkey * 7) % {k}')}))"
    sort = f"named_struct('PrimaryField', named_struct('FieldReference', {_ref('FLD', 'c_custkey % 31')}), 'ValueListReference', {_ref('VL', 'c_custkey % 10', when='c_custkey % 2 = 0')})"
    sorts = f"named_struct('@value', c_custkey % 5 = 0, 'SortList', named_struct('Sort', array({sort})))"
    side = lambda key, sorts_: f"named_struct('TableOccurrenceReference', {_ref('TO', key)}{sorts_})"
    left, right = side("c_nationkey", f", 'SortSpecification', {sorts}"), side("(c_nationkey + c_custkey) % 25", "")
    rows = f"CASE WHEN c_custkey % 4 = 0 THEN array({predicate(200)}, {predicate(90)}) ELSE array({predicate(200)}) END"
    return load(spark, d, "customer").select(F.expr(f"named_struct('@id', c_custkey, 'UUID', {_id('REL', 'c_custkey')}, 'LeftTable', {left}, 'RightTable', {right}, 'JoinPredicateList', named_struct('JoinPredicate', {rows}))").alias("Relationship"))


#: The type of an order's step, by its number; what a step refers to follows from it.
STEP_KIND = "element_at(array(1, 164, 76, 74, 39, 142, 138, 141, 28, 999), CAST(o_orderkey % 10 + 1 AS INT))"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    at = "o_orderkey % 10"
    values = (
        f"named_struct('ScriptReference', {_ref('SCR', 'o_custkey', ODD, f'{at} IN (0, 1)')}, 'FieldReference', {_ref('FLD', 'o_custkey % 200', ODD, f'{at} IN (2, 4, 8, 9)')}, 'TableOccurrenceReference', {_ref('TO', 'o_custkey % 25', when=f'{at} = 3')}, "
        f"'LayoutReference', {_ref('LAY', 'o_custkey % 90', when=f'{at} IN (3, 9)')}, 'ValueListReference', {_ref('VL', 'o_custkey % 12', when=f'{at} = 4')}, 'CustomMenuSetReference', {_ref('MS', 'o_custkey % 2', when=f'{at} = 5')}, "
        f"'DataSourceReference', {_ref('DS', 'o_custkey % 3', when=f'{at} = 6')}, 'Name', CASE WHEN {at} = 7 THEN named_struct('@value', {_id('$$$v', 'o_custkey % 10')}) END)"
    )
    step = _step(STEP_KIND, _id("ST", "o_orderkey"), "o_orderstatus <> 'P'", values)
    return load(spark, d, "orders").select(F.expr(f"array(named_struct('@id', o_orderkey, '@name', 'Script', 'UUID', {_id('SCR', 'o_orderkey')}, 'ScriptReference', NULL, 'ObjectList', NULL), named_struct('@id', NULL, '@name', NULL, 'UUID', NULL, 'ScriptReference', {_ref('SCR', 'o_orderkey', ODD)}, 'ObjectList', named_struct('Step', array({step}))))").alias("Script"))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Layouts with a portal, a button in it that says what needs character references, and a field."""
    trigger = f"named_struct('ScriptTrigger', array(named_struct('@id', 1, '@action', 'OnEnter', 'ScriptReference', {_ref('SCR', 's_suppkey')})))"
    step = f"named_struct('@id', 76, 'ScriptReference', {_ref('SCR', 's_suppkey + 1')}, 'ParameterValues', named_struct('FieldReference', {_ref('FLD', 's_suppkey % 40')}))"
    button = f"named_struct('@id', 2, '@type', 'Button', '@name', {ODD}, 'UUID', {_id('BUT', 's_suppkey')}, 'Button', named_struct('action', named_struct('Step', {step})), 'Label', named_struct('Data', {ODD}), 'ScriptTriggers', {trigger})"
    portal = f"named_struct('@id', 1, '@type', 'Portal', '@name', 'p', 'UUID', {_id('POR', 's_suppkey')}, 'Portal', named_struct('TableOccurrenceReference', {_ref('TO', 's_suppkey % 25')}, 'ObjectList', named_struct('LayoutObject', array({button}))), 'Field', NULL)"
    field = f"named_struct('@id', 3, '@type', 'Edit Box', '@name', 'f', 'UUID', {_id('BOX', 's_suppkey')}, 'Portal', NULL, 'Field', named_struct('FieldReference', {_ref('FLD', 's_suppkey % 300')}, 'Display', named_struct('ValueListReference', {_ref('VL', 's_suppkey % 7')})))"
    return load(spark, d, "supplier").select(F.expr(f"named_struct('@id', s_suppkey, '@name', s_name, 'UUID', {_id('LAY', 's_suppkey')}, 'TableOccurrenceReference', {_ref('TO', 's_nationkey')}, 'PartsList', named_struct('Part', array(named_struct('@type', 'Body', '@kind', 4, 'ObjectList', named_struct('LayoutObject', array({portal}, {field}))))))").alias("Layout"))


#: Most records of an export file, so that many tasks share the scans, as the XML source doesn't split files.
RECORDS = 50_000


def write_exports(spark: SparkSession, d: str) -> str:
    """Exports with records of all six tables, written into a new folder below the checkpoint folder; returns the folder, which is the caller's to delete."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        raise ValueError("spark.checkpoint.dir is unset: exports are written into a folder that the driver and all executors share")
    path = f"{folder.get()}/exports-{uuid4().hex}"
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f(spark, d) for f in (_nations, _parts, _customers, _orders, _suppliers)])
    rows.write.format("xml").option("rootTag", "Export").option("rowTag", "AddAction").option("attributePrefix", "@").option("valueTag", "_VALUE").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).save(path)
    return path
