"""The operators' input tables as projections of the given tables, in SQL that Spark and DuckDB read alike.

Names in braces are tables. `spark_table` runs a block on Spark; `duck` gives the block's text for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_SERIES = "CAST(floor(vec_id / 100) AS INT)"

CONTRACTS = {
    "files": """
SELECT concat('/arch/c', CAST(o_custkey AS STRING)) AS folder,
       concat(CASE WHEN o_orderkey % 10 = 0 THEN '.' WHEN o_orderkey % 10 = 1 THEN '_' ELSE '' END, 'IM', lpad(CAST(o_orderkey AS STRING), 8, '0'),
              CASE WHEN o_orderkey % 6 = 2 THEN '.mat' ELSE '' END) AS name,
       o_orderkey AS file_id
FROM {orders}""",
    "headers": """
SELECT o_orderkey AS file_id,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 9 AS STRING) END AS SeriesNumber,
       CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE o_orderpriority END AS SeriesDescription,
       CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat(CAST(year(o_orderdate) AS STRING), lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), lpad(CAST(day(o_orderdate) AS STRING), 2, '0')) END AS StudyDate,
       CASE WHEN o_orderkey % 8 = 3 THEN NULL ELSE concat('P', CAST(o_custkey AS STRING)) END AS PatientID,
       CASE WHEN o_orderkey % 9 = 4 THEN '' ELSE concat('Name^', CAST(o_custkey % 100 AS STRING)) END AS PatientName,
       CASE WHEN o_orderkey % 4 = 1 THEN 'F' WHEN o_orderkey % 4 = 2 THEN 'M' ELSE NULL END AS PatientSex,
       o_orderstatus AS Modality,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 500 AS DOUBLE) END AS ww,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 80 AS DOUBLE) END AS wl,
       CAST(o_custkey % 4 AS DOUBLE) * 0.625 AS thickness,
       CASE WHEN o_orderkey % 6 = 1 THEN NULL ELSE CAST(o_orderkey % 17 AS DOUBLE) * 0.125 END AS pixel_spacing,
       CASE WHEN o_orderkey % 7 = 2 THEN NULL ELSE CAST(o_orderkey % 40 AS DOUBLE) * 2.675 END AS location,
       CASE WHEN o_orderkey % 6 = 4 THEN NULL ELSE CAST(256 + o_custkey % 3 * 128 AS STRING) END AS n_rows
FROM {orders}""",
    "series_geom": f"""
SELECT DISTINCT {_SERIES} AS series_id, 64 AS nx, 10 AS ny, 10 AS nz,
       0.5 + 0.25 * CAST({_SERIES} % 4 AS DOUBLE) AS sx, 0.5 + 0.25 * CAST({_SERIES} % 4 AS DOUBLE) AS sy, 1.0 + 0.5 * CAST({_SERIES} % 3 AS DOUBLE) AS sz,
       CAST(0 AS DOUBLE) AS ox, CAST(-4 AS DOUBLE) AS oy, CAST(8 AS DOUBLE) AS oz
FROM {{embeddings}}""",
    "scanlines": f"""
SELECT {_SERIES} AS series_id, CAST(floor((vec_id % 100) / 10) AS INT) AS k, CAST(vec_id % 10 AS INT) AS j, CAST(embedding AS DOUBLES) AS vals
FROM {{embeddings}}""",
    "roi_vertices": """
SELECT l_orderkey AS roi_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_tax, l_discount) - 1 AS vertex_idx,
       CAST(l_quantity AS DOUBLE) AS x, CAST(l_partkey % 101 AS DOUBLE) AS y, CAST(l_orderkey % 10 AS DOUBLE) AS z,
       l_orderkey % 10 AS slice_index, CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 2 END AS orientation
FROM {lineitem}""",
    "roi_log": """
SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
       CASE WHEN event_id % 97 = 0 THEN 'clear' WHEN event_type = 'signup' THEN 'add' WHEN event_type = 'error' THEN 'remove'
            WHEN event_type = 'view' THEN CASE WHEN event_id % 11 = 0 THEN 'tool' ELSE 'select' END
            WHEN event_type = 'click' THEN CASE CAST(floor(event_id / 12) AS BIGINT) % 4 WHEN 0 THEN 'translate' WHEN 1 THEN 'update' WHEN 2 THEN 'insert' ELSE 'delete' END
            ELSE 'rename' END AS op,
       1 + event_id % 12 AS roi_id,
       CASE WHEN event_id % 4 = 0 THEN 'rectangle' WHEN event_id % 4 = 1 THEN 'ellipse' WHEN event_id % 4 = 2 THEN 'polygon' ELSE 'freehand' END AS roi_type,
       CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END AS has_color,
       CASE WHEN event_id % 2 = 0 THEN 'edit' ELSE 'polygon' END AS tool,
       CASE WHEN event_id % 5 = 0 THEN '  ' ELSE concat(' r', CAST(event_id AS STRING), ' ') END AS name,
       CAST(event_id % 7 AS INT) - 1 AS idx, CAST(event_id % 16 AS DOUBLE) / 4 AS ex, CAST(event_id % 8 AS DOUBLE) / 4 AS ey, CAST(3 + event_id % 3 AS INT) AS n_points
FROM {events}""",
    "roi_edits": """
SELECT l_orderkey AS roi_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_tax, l_discount) AS seq,
       CASE WHEN l_partkey % 4 = 0 THEN 'update' WHEN l_partkey % 4 = 1 THEN 'translate' WHEN l_partkey % 4 = 2 THEN 'insert' ELSE 'delete' END AS op,
       CAST(l_suppkey % 6 AS INT) - 1 AS idx, CAST(l_partkey % 16 AS DOUBLE) / 4 AS ex, CAST(l_suppkey % 8 AS DOUBLE) / 4 AS ey
FROM {lineitem}""",
    "clicks": """
SELECT event_id AS click_id, event_id % 10 AS slice_index, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS orientation,
       CAST(event_id % 53 AS DOUBLE) AS px, CAST(user_id % 101 AS DOUBLE) AS py
FROM {events} WHERE event_type = 'click'""",
    "gestures": """
SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
       CASE WHEN event_id % 31 = 0 THEN 'escape' WHEN event_type = 'click' THEN 'left_press' WHEN event_type = 'view' THEN 'move'
            WHEN event_type = 'purchase' THEN 'left_release' WHEN event_type = 'error' THEN 'right_press' ELSE 'tool' END AS kind,
       CASE WHEN event_id % 4 = 0 THEN 'rectangle' WHEN event_id % 4 = 1 THEN 'ellipse' WHEN event_id % 4 = 2 THEN 'polygon' ELSE 'freehand' END AS tool,
       CAST(event_id % 64 AS DOUBLE) AS x, CAST(event_id % 37 AS DOUBLE) AS y, CAST(event_id % 10 AS DOUBLE) AS z, event_id % 10 AS slice_index, 2 AS orientation
FROM {events}""",
    "sessions": """
SELECT c_custkey AS session_id,
       CASE WHEN c_custkey % 6 = 0 THEN '{{bad'
            WHEN c_custkey % 6 = 1 THEN concat('{{"last_dicom_folder":"/arch/c', CAST(c_custkey AS STRING), '"}}')
            WHEN c_custkey % 6 = 2 THEN '{{"use_dicom_spacing":null,"rois":null}}'
            WHEN c_custkey % 6 = 3 THEN concat('{{"use_dicom_spacing":false,"custom_spacing":[0.5,0.5,', CAST(c_custkey % 5 + 1 AS STRING), ']}}')
            WHEN c_custkey % 6 = 4 THEN '{{"unknown":1,"last_dicom_folders":["/arch/c1","/arch/c1","/arch/c2"]}}'
            ELSE '{{"rois":[{{"name":"Rectangle 1","roi_type":"rectangle","slice_index":3,"orientation":2,"points":[[0,0,3],[4,0,3],[4,4,3],[0,4,3]],"color":[1.0,0.2,0.2]}}]}}' END AS raw
FROM {customer}""",
    "loads": """
SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
       CASE WHEN event_type = 'signup' THEN 'load' ELSE 'add' END AS op, concat('/arch/c', CAST(event_id % 9 AS STRING)) AS folder,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 300 AS DOUBLE) END AS ww, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 90 AS DOUBLE) END AS wl
FROM {events} WHERE event_type IN ('signup', 'click', 'view')""",
    "decoded": """
SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_tax, l_discount) AS pos,
       concat(CASE WHEN l_partkey % 3 = 0 THEN '_' ELSE '' END, l_returnflag, CAST(l_linenumber AS STRING)) AS key, CAST(1 + l_partkey % 3 AS INT) AS ndim,
       l_linenumber = 1 AND l_orderkey % 4 <> 0 AS is_nested, l_orderkey % 9 <> 5 AS readable
FROM {lineitem}""",
}


def duck(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", CONTRACTS[name]).replace("{{", "{").replace("}}", "}").replace("DOUBLES", "DOUBLE[]")


def with_duck(*names: str) -> str:
    """A WITH clause of the named contracts."""
    return "WITH " + ",\n".join(f"{n} AS ({duck(n)})" for n in names)


def spark_table(spark: SparkSession, sf_dir: str, name: str, dealt_by: str | None = None) -> DataFrame:
    """dealt_by: a column of the given table that its rows are dealt by first, before the contract widens them; windows and
    groups by it, under its new name too, need no other shuffle."""
    table = re.search(r"\{(\w+)\}", CONTRACTS[name].replace("{{", "").replace("}}", ""))[1]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(CONTRACTS[name].replace("DOUBLES", "ARRAY<DOUBLE>"), **{table: rows.repartition(dealt_by) if dealt_by else rows})
