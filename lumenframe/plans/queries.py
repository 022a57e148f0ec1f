"""The registered queries of the imaging operators on tables derived from the given ones, with the same in DuckDB SQL."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions.ranks import ranked
from lumenframe.functions.shared import delete, shared_dir
from lumenframe.operators import catalog, rois, surface, volume
from lumenframe.plans.contracts import spark_table as table
from lumenframe.plans.contracts import duck, with_duck
from lumenframe.sources import files, sessions
from lumenframe.streaming import gestures, roi_log, series_log, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name, with its DuckDB twin."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


#: Every series and region by its place in order, 0, 1, ...: lookups reach all of them, however many there are.
_SERIES_RANK = "sr AS (SELECT series_id, row_number() OVER (ORDER BY series_id) - 1 AS rank, count(*) OVER () AS n FROM series_geom)"
_REGION_RANK = "rr AS (SELECT roi_id, row_number() OVER (ORDER BY roi_id) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT roi_id FROM roi_vertices))"
MISSES = 2  # places beyond the last series: lookups that find none


def _with_series(spark: SparkSession, d: str, rows: DataFrame, number: str, misses: int = 0) -> DataFrame:
    """rows with series_id: the series at the place that the number has modulo their count; null at one of the misses."""
    series, n = ranked(table(spark, d, "series_geom").select("series_id"), "series_id")
    return rows.withColumn("rank", F.col(number) % (n + misses)).join(volume.known(series), "rank", "left").drop("rank")


# ---- sources and the catalogue ----

_VISIBLE = "SELECT folder, name, folder || '/' || name AS path, file_id FROM files WHERE name NOT LIKE '.%'"


@query(f"{with_duck('files')} {_VISIBLE}")
def series_files(spark: SparkSession, d: str) -> DataFrame:
    return catalog.visible(table(spark, d, "files")).select("folder", "name", "path", "file_id")


@query(f"{with_duck('files')} SELECT path, file_id FROM ({_VISIBLE}) WHERE name LIKE '%.mat'")
def mask_files(spark: SparkSession, d: str) -> DataFrame:
    return catalog.masks(table(spark, d, "files")).select("path", "file_id")


WAVE = 250_000  # files, about, that are on disk at once: gone again before the system writes their blocks


def _in_folder(spark: SparkSession, rows: DataFrame, after: Callable[[str], DataFrame], wave: int = WAVE) -> DataFrame:
    """rows(path, content) written as files below new folders of the shared one; what `after` makes of each such root, in one.
    Each file takes a block of the disk, so whole folders are dealt into waves: a wave's files go before the next one's come.
    All waves share a root: a file system that goes on from where its last folder went doesn't search what was just freed."""
    top = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    root, folder, cores = f"{top}/files", F.substring_index("path", "/", 1), max(1, spark.sparkContext.defaultParallelism)
    n = -(-rows.count() // wave)
    try:
        if n > 1:
            dealt = rows.withColumn("wave", F.pmod(F.xxhash64(folder), F.lit(n)))
            dealt.repartition("wave", F.pmod(F.xxhash64("path"), F.lit(8))).write.partitionBy("wave").parquet(f"{top}/_rows")
            dealt = spark.read.parquet(f"{top}/_rows")
        for i in range(n):
            due = rows if n == 1 else dealt.filter(F.col("wave") == i).drop("wave")  # may have none
            files.drop(due.repartition(cores, folder).sortWithinPartitions("path"), root)
            after(root).coalesce(2 * cores).write.parquet(f"{top}/_found/wave={i}")
            files.clear(spark, root)
        return (spark.read.parquet(f"{top}/_found").drop("wave") if n else after(f"{top}/none")).checkpoint()
    finally:
        delete(spark, top)


def _archive(spark: SparkSession, d: str) -> DataFrame:
    """A file for each row of the file table, hidden ones too; what it holds is its number."""
    f = table(spark, d, "files")
    return f.select(F.concat(F.regexp_replace("folder", "^/arch/", ""), F.lit("/"), "name").alias("path"), F.encode(F.col("file_id").cast("string"), "UTF-8").alias("content"))


def _listed(root: str, found: DataFrame) -> DataFrame:
    return found.select(F.concat(F.lit("/arch/"), F.substring_index("folder", "/", -1)).alias("folder"), "name", "length")


@query(f"{with_duck('files')} SELECT folder, name, CAST(length(CAST(file_id AS VARCHAR)) AS BIGINT) AS length FROM ({_VISIBLE})")
def series_listing(spark: SparkSession, d: str) -> DataFrame:
    """The file table as real folders, listed by the data source."""
    return _in_folder(spark, _archive(spark, d), lambda root: _listed(root, files.listing(spark, root=root)))


@query(f"{with_duck('files')} SELECT folder, name, CAST(length(CAST(file_id AS VARCHAR)) AS BIGINT) AS length FROM ({_VISIBLE}) WHERE name LIKE '%.mat'")
def mask_listing(spark: SparkSession, d: str) -> DataFrame:
    """The mask files among them; the reader itself leaves out the others."""
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        return _in_folder(spark, _archive(spark, d), lambda root: _listed(root, files.listing(spark, root=root).filter("name LIKE '%.mat'")))
    finally:
        spark.conf.set(key, before)


def _key_values(content: bytes) -> dict[str, str]:
    """A toy header codec: keyword=value lines; a file that starts with ! is broken."""
    text = content.decode()
    if text.startswith("!"):
        raise ValueError("bad header")
    return dict(line.split("=", 1) for line in text.split("\n") if line)


def _header_blobs(spark: SparkSession, d: str) -> DataFrame:
    h = catalog.visible(table(spark, d, "files")).join(table(spark, d, "headers"), "file_id")
    lines = F.concat_ws("\n", F.concat(F.lit("Modality="), "Modality"), F.concat(F.lit("SeriesNumber="), "SeriesNumber"), F.concat(F.lit("PatientID="), "PatientID"))
    return h.select("folder", "path", "file_id", F.encode(F.when(F.col("file_id") % 13 == 5, "!").otherwise(lines), "UTF-8").alias("content"))


_FIRST = f"""{with_duck('files', 'headers')}, v AS ({_VISIBLE}), f AS (SELECT min(path) AS path FROM v GROUP BY folder),
h AS (SELECT v.path, headers.* FROM f JOIN v USING (path) JOIN headers USING (file_id))"""


@query(f"""{_FIRST}, kv AS (SELECT path, file_id, 'Modality' AS keyword, Modality AS value FROM h UNION ALL SELECT path, file_id, 'SeriesNumber', SeriesNumber FROM h UNION ALL SELECT path, file_id, 'PatientID', PatientID FROM h)
SELECT path, keyword, value, CAST(NULL AS VARCHAR) AS error FROM kv WHERE file_id % 13 <> 5 AND value IS NOT NULL
UNION ALL SELECT path, NULL, NULL, 'bad header' FROM h WHERE file_id % 13 = 5""")
def header_ingest(spark: SparkSession, d: str) -> DataFrame:
    first = catalog.first_files(table(spark, d, "files"))
    return catalog.header_rows(_header_blobs(spark, d).join(first.select("path"), "path"), _key_values)


@query(f"""{_FIRST} SELECT path, CASE WHEN file_id % 13 <> 5 THEN Modality END AS Modality, CASE WHEN file_id % 13 <> 5 THEN PatientID END AS PatientID, CASE WHEN file_id % 13 <> 5 THEN SeriesNumber END AS SeriesNumber,
{", ".join(f"CAST(NULL AS VARCHAR) AS {t}" for t in catalog.TAGS if t not in ("Modality", "PatientID", "SeriesNumber"))} FROM h""")
def header_pivot(spark: SparkSession, d: str) -> DataFrame:
    return catalog.pivot_headers(header_ingest(spark, d))


@query(f"""{_FIRST}, c AS (SELECT folder, count(*) FILTER (name NOT LIKE '.%') AS n_files, min(CASE WHEN name NOT LIKE '.%' THEN folder || '/' || name END) AS first_path FROM files GROUP BY folder)
SELECT c.folder, n_files, first_path, CASE WHEN n_files = 0 THEN 'No files found' WHEN h.file_id % 13 = 5 THEN 'Error: bad header' ELSE CAST(n_files AS VARCHAR) END AS status FROM c LEFT JOIN h ON c.first_path = h.path""")
def series_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog.catalog(table(spark, d, "files"), header_ingest(spark, d).filter("error IS NOT NULL"))


def _floats(content: bytes):
    """A toy volume codec: runs of rows of one slice and length, each nx, k, the number of rows, their js, a byte for each value
    (0: null), and doubles, x fastest; a run at a time."""
    at = 0
    while at < len(content):
        nx, k, n = struct.unpack_from("<3i", content, at)
        js = np.frombuffer(content, "<i4", n, at + 12)
        there = np.frombuffer(content, "u1", n * nx, at + 12 + 4 * n)
        rows = np.frombuffer(content, "<f8", n * nx, at + 12 + (4 + nx) * n).reshape(n, nx)
        yield k, rows if there.all() else np.ma.array(rows, mask=there.reshape(n, nx) == 0), js
        at += 12 + (4 + 9 * nx) * n


def _volume_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Whole volumes as bytes: what a folder of one series decodes from. Slices and rows may be lacking, as in the last series."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("k", "ascending"), ("j", "ascending")]).combine_chunks()
        k, j, vals = table["k"].to_numpy(), table["j"].to_numpy(), table["vals"].combine_chunks()
        nx, flat = vals.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), vals.flatten()
        there, data = flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(nx)])
        first = np.flatnonzero(np.r_[True, (np.diff(k) != 0) | (np.diff(nx) != 0)])
        runs = []
        for a, b in zip(first, [*first[1:], len(k)]):
            own = slice(ends[a], ends[b])
            runs += [struct.pack("<3i", nx[a], k[a], b - a), j[a:b].astype("<i4").tobytes(), there[own].astype("u1").tobytes(), data[own].astype("<f8").tobytes()]
        return pa.table({"series_id": pa.array([key[0].as_py()], pa.int32()), "content": pa.array([b"".join(runs)], pa.binary())})

    return table(spark, d, "scanlines").groupBy("series_id").applyInArrow(pack, "series_id int, content binary")


_LONG = "SELECT series_id, k, j, generate_subscripts(vals, 1) - 1 AS i, unnest(vals) AS v FROM scanlines"


def _long(lines: DataFrame) -> DataFrame:
    return lines.select("series_id", "k", "j", F.posexplode("vals").alias("i", "v")).select("series_id", "k", "j", F.col("i").cast("long").alias("i"), "v")


def _kept(spark: SparkSession, d: str, after: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The decoded volumes, written by series to the shared folder; what `after` makes of them there."""
    root = f"{shared_dir(spark)}/volumes-{uuid.uuid4().hex}"
    try:
        volume.write(volume.ingest(_volume_blobs(spark, d), _floats).filter("error IS NULL").drop("error"), root)
        return after(volume.stored(spark, root)).checkpoint()
    finally:
        delete(spark, root)


@query(f"{with_duck('scanlines')}, n AS (SELECT max(series_id) // 2 AS s FROM scanlines) SELECT series_id, k, j, i, v FROM ({_LONG}), n WHERE series_id <= s AND k = 4")
def volume_slice(spark: SparkSession, d: str) -> DataFrame:
    """One slice of the first half of the series, from the stored volumes: other folders and row groups are not read."""
    half = (table(spark, d, "scanlines").agg(F.max("series_id")).first()[0] or 0) // 2
    return _kept(spark, d, lambda lines: _long(volume.axial_slice(lines, 4).filter(F.col("series_id") <= half)))


@query(f"{with_duck('scanlines')} {_LONG}")
def volume_ingest(spark: SparkSession, d: str) -> DataFrame:
    return _long(volume.ingest(_volume_blobs(spark, d), _floats).filter("error IS NULL"))


@query(f"""{with_duck('decoded')}, g AS (SELECT file_id, bool_and(readable) AS ok, min(pos) FILTER (is_nested) AS n, min(pos) FILTER (ndim = 3 AND key NOT LIKE '\\_%' ESCAPE '\\' AND NOT is_nested) AS t FROM decoded GROUP BY file_id)
SELECT g.file_id, CASE WHEN NOT ok THEN 'read_error' WHEN n IS NULL THEN 'no_patient' WHEN t IS NOT NULL THEN 'top_level' ELSE 'nested' END AS status, CASE WHEN ok AND n IS NOT NULL THEN x.key END AS key
FROM g LEFT JOIN decoded x ON x.file_id = g.file_id AND x.pos = coalesce(t, n)""")
def mask_select(spark: SparkSession, d: str) -> DataFrame:
    return catalog.select_mask(table(spark, d, "decoded"))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(f"""{with_duck('files', 'headers')} SELECT file_id, coalesce(nullif(concat_ws(' – ', nullif({_STRIP.format('SeriesNumber')}, ''), nullif({_STRIP.format('SeriesDescription')}, '')), ''), split_part(folder, '/', 3)) AS label
FROM files JOIN headers USING (file_id)""")
def series_label(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "files").join(table(spark, d, "headers"), "file_id")
    return h.select("file_id", catalog.label(F.col("SeriesNumber"), F.col("SeriesDescription"), F.col("folder")).alias("label"))


@query(f"""{with_duck('loads')}, f AS (SELECT session_id, ww, wl FROM loads WHERE seq = 1)
SELECT l.session_id, l.seq, CASE WHEN f.ww IS NOT NULL AND f.wl IS NOT NULL THEN f.ww ELSE 400.0 END AS "window", CASE WHEN f.ww IS NOT NULL AND f.wl IS NOT NULL THEN f.wl ELSE 40.0 END AS level FROM loads l JOIN f USING (session_id)""")
def window_level_default(spark: SparkSession, d: str) -> DataFrame:
    return catalog.session_window_level(table(spark, d, "loads")).select("session_id", "seq", "window", "level")


@query(f"""{with_duck('headers')} SELECT file_id, CASE WHEN file_id % 5 = 4 THEN 'Patient: --' ELSE concat_ws(chr(10), coalesce(nullif(PatientName, ''), 'Unknown'), nullif(concat_ws('  ', nullif(PatientID, ''), nullif(StudyDate, ''), nullif(PatientSex, '')), '')) END AS caption FROM headers""")
def caption_patient(spark: SparkSession, d: str) -> DataFrame:
    c = catalog.patient_caption(F.col("file_id") % 5 != 4, *map(F.col, ("PatientName", "PatientID", "StudyDate", "PatientSex")))
    return table(spark, d, "headers").select("file_id", c.alias("caption"))


@query(f"""{with_duck('headers')} SELECT file_id, CASE WHEN file_id % 5 = 4 THEN '--' ELSE concat_ws(chr(10),
CASE WHEN regexp_full_match(StudyDate, '[0-9]{{8}}') THEN StudyDate[1:4] || '-' || StudyDate[5:6] || '-' || StudyDate[7:8] ELSE coalesce(nullif(StudyDate, ''), '--') END,
nullif(Modality, ''), nullif(PatientID, ''), nullif(SeriesNumber, ''), nullif(SeriesDescription, '')) END AS caption FROM headers""")
def caption_study(spark: SparkSession, d: str) -> DataFrame:
    c = catalog.study_caption(F.col("file_id") % 5 != 4, *map(F.col, ("StudyDate", "Modality", "PatientID", "SeriesNumber", "SeriesDescription")))
    return table(spark, d, "headers").select("file_id", c.alias("caption"))


@query(f"""{with_duck('headers')} SELECT file_id, concat_ws(chr(10), 'Series: ' || coalesce(SeriesNumber, '--'), 'Image: ' || (file_id % 40 + 1) || ' / ' || coalesce(CAST(nullif(file_id % 50, 0) AS VARCHAR), '--'),
'Size: ' || coalesce(n_rows, '--') || ' × ' || coalesce(n_rows, '--') || ' px', coalesce('Spacing: ' || printf('%.2f', pixel_spacing) || ' × ' || printf('%.2f', pixel_spacing) || ' mm', 'Spacing: -- × -- mm'),
coalesce('Loc: ' || printf('%.2f', location) || ' mm', 'Loc: -- mm'), coalesce('Thick: ' || printf('%.2f', nullif(thickness, 0)) || ' mm', 'Thick: -- mm')) AS caption FROM headers""")
def caption_geometry(spark: SparkSession, d: str) -> DataFrame:
    n, p = F.col("n_rows"), F.col("pixel_spacing")
    c = catalog.geometry_caption(F.col("SeriesNumber"), F.col("file_id") % 40, F.col("file_id") % 50, n, n, (p, p), F.col("location"), F.col("thickness"))
    return table(spark, d, "headers").select("file_id", c.alias("caption"))


_EPOCH = f"{with_duck('loads')}, e AS (SELECT *, count(*) FILTER (op = 'load') OVER (PARTITION BY session_id ORDER BY seq) AS epoch FROM loads)"


@query(f"{_EPOCH} SELECT session_id, epoch, folder, min(seq) AS seq FROM e GROUP BY ALL")
def series_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return catalog.deduped(table(spark, d, "loads")).select("session_id", "epoch", "folder", "seq")


@query(f"{_EPOCH} SELECT session_id, seq, folder FROM e QUALIFY epoch = max(epoch) OVER (PARTITION BY session_id)")
def series_replace(spark: SparkSession, d: str) -> DataFrame:
    return catalog.replaced(table(spark, d, "loads")).select("session_id", "seq", "folder")


@query(f"""{_EPOCH}, files AS ({duck('files')}), headers AS ({duck('headers')}), v AS ({_VISIBLE}), f AS (SELECT folder, min(path) AS path FROM v GROUP BY folder),
h AS (SELECT f.folder, headers.* FROM f JOIN v USING (path) JOIN headers USING (file_id)),
l AS (SELECT session_id, folder, min(seq) AS seq FROM (SELECT * FROM e QUALIFY epoch = max(epoch) OVER (PARTITION BY session_id)) GROUP BY ALL)
SELECT session_id, pos, '[' || pos || ']  ' || coalesce(nullif(concat_ws(' – ', nullif({_STRIP.format('SeriesNumber')}, ''), nullif({_STRIP.format('SeriesDescription')}, '')), ''), split_part(l.folder, '/', 3)) AS entry
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS pos FROM l) l LEFT JOIN h ON h.folder = l.folder""")
def series_menu(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    named = catalog.visible(files).join(catalog.first_files(files).select("path"), "path").join(table(spark, d, "headers"), "file_id").select("folder", "SeriesNumber", "SeriesDescription")
    return catalog.menu(catalog.loaded(table(spark, d, "loads")), named).select("session_id", "pos", "entry")


# ---- sessions ----

_SESSION = f"""{with_duck('sessions')}, p AS (SELECT session_id, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS v FROM sessions),
r AS (SELECT session_id, v IS NULL AS corrupt, CASE WHEN v IS NULL OR NOT json_exists(v, '$.last_dicom_folder') THEN '' ELSE v->>'last_dicom_folder' END AS legacy_folder,
CASE WHEN v IS NULL OR NOT json_exists(v, '$.last_dicom_folders') THEN []::VARCHAR[] ELSE CAST(v->'last_dicom_folders' AS VARCHAR[]) END AS stored,
CASE WHEN v IS NULL OR NOT json_exists(v, '$.custom_spacing') THEN [1.0, 1.0, 1.0]::DOUBLE[] ELSE CAST(v->'custom_spacing' AS DOUBLE[]) END AS custom,
CASE WHEN v IS NULL OR NOT json_exists(v, '$.use_dicom_spacing') THEN true ELSE CAST(v->>'use_dicom_spacing' AS BOOLEAN) END AS use_series, v FROM p),
s AS (SELECT *, CASE WHEN coalesce(len(stored), 0) = 0 AND coalesce(legacy_folder, '') <> '' THEN [legacy_folder] ELSE stored END AS folders FROM r)"""


@query(f"""{_SESSION} SELECT session_id, CASE WHEN corrupt THEN 'corrupt' ELSE 'ok' END AS status, legacy_folder, array_to_string(folders, ',') AS folders, custom[1] AS s0, custom[2] AS s1, custom[3] AS s2, use_series,
CASE WHEN v IS NULL OR NOT json_exists(v, '$.rois') THEN 0 WHEN v->>'rois' IS NULL THEN NULL ELSE json_array_length(v, '$.rois') END AS n_rois FROM s""")
def session_read(spark: SparkSession, d: str) -> DataFrame:
    s = sessions.read(table(spark, d, "sessions"))
    spacing = (F.get("custom_spacing", i).alias(f"s{i}") for i in range(3))
    return s.select("session_id", "status", "legacy_folder", F.array_join("folders", ",").alias("folders"), *spacing, "use_series", F.when(F.col("rois").isNotNull(), F.size("rois")).cast("long").alias("n_rois"))


_ROI_TEXT = """list_transform(from_json(v->'rois', '[{"name":"VARCHAR","roi_type":"VARCHAR","slice_index":"INTEGER","orientation":"INTEGER","points":["DOUBLE[]"],"color":["DOUBLE"]}]'),
lambda r: '{"name":"' || r.name || '","roi_type":"' || r.roi_type || '","slice_index":' || r.slice_index || ',"orientation":' || r.orientation || ',"points":' || replace(CAST(r.points AS VARCHAR), ' ', '') || ',"color":' || replace(CAST(r.color AS VARCHAR), ' ', '') || '}')"""


@query(f"""{_SESSION} SELECT session_id, '{{"lesion_library_dir":"","last_dicom_folder":"' || legacy_folder || '","last_dicom_folders":[' || coalesce(array_to_string(list_transform(folders, lambda f: '"' || f || '"'), ','), '') ||
'],"custom_spacing":[' || array_to_string(list_transform(custom, lambda x: CAST(x AS VARCHAR)), ',') || '],"use_dicom_spacing":' || coalesce(CAST(use_series AS VARCHAR), 'null') || ',"rois":' ||
CASE WHEN v IS NULL OR NOT json_exists(v, '$.rois') THEN '[]' WHEN v->>'rois' IS NULL THEN 'null' ELSE '[' || array_to_string({_ROI_TEXT}, ',') || ']' END || '}}' AS raw FROM s""")
def session_write(spark: SparkSession, d: str) -> DataFrame:
    return sessions.write(sessions.read(table(spark, d, "sessions")))


@query(f"""{_SESSION}, u AS (SELECT session_id, unnest(folders) AS folder, generate_subscripts(folders, 1) AS pos FROM s), f AS ({with_duck('files').removeprefix('WITH files AS (').removesuffix(')')}),
x AS (SELECT session_id, folder, min(pos) AS pos FROM u WHERE folder IN (SELECT folder FROM f) GROUP BY ALL)
SELECT session_id, folder, CAST(row_number() OVER (PARTITION BY session_id ORDER BY pos) AS INT) AS rank, row_number() OVER (PARTITION BY session_id ORDER BY pos) = 1 AS is_primary FROM x""")
def session_restore(spark: SparkSession, d: str) -> DataFrame:
    return sessions.restored_folders(sessions.read(table(spark, d, "sessions")), table(spark, d, "files").select("folder").distinct())


_WRITTEN = ORACLES["session_write"]
SHARDS = 2_000  # folders that the documents are dealt into, so that tasks list, read and remove them


@query(f"SELECT session_id, CASE WHEN session_id % 97 <> 5 THEN raw END AS raw, session_id % 97 = 5 AS warned FROM ({_WRITTEN})")
def session_files(spark: SparkSession, d: str) -> DataFrame:
    """The documents written as files and read again. Some have a file where their folder should be: a warning each."""
    docs = sessions.write(sessions.read(table(spark, d, "sessions")))
    blocked = F.col("session_id") % 97 == 5
    shard = F.concat(F.lit("s"), F.pmod(F.xxhash64("session_id"), F.lit(SHARDS)).cast("string"), F.lit("/"))
    path = F.concat(F.when(blocked, "blocked/").otherwise(shard), F.col("session_id").cast("string"), F.lit(".settings.json"))
    number = lambda p: F.substring_index(F.substring_index(p, "/", -1), ".", 1).cast("long").alias("session_id")

    def back(root: str, warnings: DataFrame) -> DataFrame:
        read = files.contents(files.listing(spark, root=root)).select(number("path"), F.decode("content", "UTF-8").alias("raw"), F.lit(False).alias("warned"))
        return read.union(warnings.select(number("path"), F.lit(None).cast("string"), F.lit(True)))

    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    try:
        files.drop(spark.createDataFrame([("blocked", b"no folder")], "path string, content binary"), root)
        out = back(root, files.drop(docs.select(path.alias("path"), F.encode("raw", "UTF-8").alias("content")), root)).checkpoint()
        files.remove(spark, root)
        return out
    finally:
        delete(spark, root)


def _rois(spark: SparkSession, d: str) -> DataFrame:
    r = rois.nested(table(spark, d, "roi_vertices"))
    return r.withColumn("session_id", F.floor(F.col("roi_id") / 40)).withColumn("name", F.concat(F.lit("Roi "), F.col("roi_id").cast("string"))).withColumn("roi_type", F.lit("polygon")).withColumn("color", rois.palette(F.col("roi_id") + 1))


_POINT = "'[' || CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR) || ',' || CAST(z AS VARCHAR) || ']'"
_COLORS = "[" + ", ".join("'" + ",".join(map(str, c)) + "'" for c in rois.PALETTE) + "]"


@query(f"""{with_duck('roi_vertices')}, r AS (SELECT roi_id, slice_index, orientation, string_agg({_POINT}, ',' ORDER BY vertex_idx) AS points FROM roi_vertices GROUP BY ALL)
SELECT roi_id // 40 AS session_id, '[' || string_agg('{{"name":"Roi ' || roi_id || '","roi_type":"polygon","slice_index":' || slice_index || ',"orientation":' || orientation || ',"points":[' || points || '],"color":[' || {_COLORS}[roi_id % 8 + 1] || ']}}', ',' ORDER BY roi_id) || ']' AS rois
FROM r GROUP BY 1""")
def roi_serialise(spark: SparkSession, d: str) -> DataFrame:
    return sessions.serialise(_rois(spark, d))


@query(f"""{with_duck('roi_vertices')} SELECT roi_id // 40 AS session_id, CAST(dense_rank() OVER (PARTITION BY roi_id // 40 ORDER BY roi_id) AS INT) AS roi_id, 'Roi ' || roi_id AS name, vertex_idx, x, y, z FROM roi_vertices""")
def roi_deserialise(spark: SparkSession, d: str) -> DataFrame:
    back = roi_serialise(spark, d).withColumn("rois", F.from_json("rois", sessions.ROI))
    r = sessions.deserialise(back).select("session_id", "roi_id", "name", F.posexplode("points").alias("vertex_idx", "p"))
    return r.select("session_id", "roi_id", "name", F.col("vertex_idx").cast("long").alias("vertex_idx"), "p.x", "p.y", "p.z")


@query(f"""{with_duck('roi_vertices')} SELECT DISTINCT roi_id // 40 AS session_id, CAST(roi_id // 40 % 7 + dense_rank() OVER (PARTITION BY roi_id // 40 ORDER BY roi_id) AS INT) AS roi_id, 'Roi ' || roi_id AS name FROM roi_vertices""")
def roi_restore(spark: SparkSession, d: str) -> DataFrame:
    """Stored regions appended to the regions that a session has already: their ids go on."""
    back = roi_serialise(spark, d).withColumn("rois", F.from_json("rois", sessions.ROI))
    return sessions.deserialise(back, existing=(F.col("session_id") % 7).cast("int")).select("session_id", "roi_id", "name")


@query(f"""{_SESSION}, g AS ({with_duck('series_geom').removeprefix('WITH series_geom AS (').removesuffix(')')}), sr AS (SELECT *, row_number() OVER (ORDER BY series_id) - 1 AS rank, count(*) OVER () AS n FROM g), j AS (SELECT s.*, g.sx, g.sy, g.sz FROM s LEFT JOIN sr g ON g.rank = s.session_id % ((SELECT count(*) FROM g) + 2)),
t AS (SELECT session_id, CASE WHEN use_series THEN coalesce(sx, 1.0) ELSE custom[1] END AS a, CASE WHEN use_series THEN coalesce(sy, 1.0) ELSE custom[2] END AS b, CASE WHEN use_series THEN coalesce(sz, 1.0) ELSE custom[3] END AS c FROM j)
SELECT session_id, a AS s0, b AS s1, c AS s2, '(' || printf('%.4f', a) || ', ' || printf('%.4f', b) || ', ' || printf('%.4f', c) || ')' AS shown FROM t""")
def spacing_resolve(spark: SparkSession, d: str) -> DataFrame:
    s = sessions.read(table(spark, d, "sessions")).select("session_id", F.coalesce("use_series", F.lit(False)).alias("use_series"), F.col("custom_spacing").alias("custom"))
    r = catalog.resolve_spacing(_with_series(spark, d, s, "session_id", MISSES), volume.known(table(spark, d, "series_geom")))
    return r.select("session_id", *(F.get("spacing", i).alias(f"s{i}") for i in range(3)), "shown")


@query(f"""{_SESSION}, g AS ({duck('series_geom')}), sr AS (SELECT *, row_number() OVER (ORDER BY series_id) - 1 AS rank FROM g), j AS (SELECT s.*, sr.sx, sr.sy, sr.sz, NOT coalesce(use_series, false) AS now FROM s LEFT JOIN sr ON sr.rank = s.session_id % ((SELECT count(*) FROM g) + 2))
SELECT session_id, now AS use_series, CASE WHEN now AND sx IS NOT NULL THEN sx ELSE custom[1] END AS s0, CASE WHEN now AND sx IS NOT NULL THEN sy ELSE custom[2] END AS s1, CASE WHEN now AND sx IS NOT NULL THEN sz ELSE custom[3] END AS s2 FROM j""")
def spacing_toggle(spark: SparkSession, d: str) -> DataFrame:
    """Each session's flag switched: what would be saved then."""
    s = sessions.read(table(spark, d, "sessions")).select("session_id", "use_series", F.col("custom_spacing").alias("custom"))
    r = catalog.toggled(_with_series(spark, d, s, "session_id", MISSES), volume.known(table(spark, d, "series_geom")))
    return r.select("session_id", "use_series", *(F.get("custom", F.lit(i)).alias(f"s{i}") for i in range(3)))


@query("SELECT event_id, round(least(greatest(CAST(event_id % 1000 AS DOUBLE) / 16 - 1, 0.01), 50.0), 4) AS spacing FROM events")
def spacing_custom(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", catalog.custom_spacing((F.col("event_id") % 1000).cast("double") / 16 - 1).alias("spacing"))


# ---- volumes ----

_V = with_duck("series_geom", "scanlines")


@query(f"{_V}, l AS ({_LONG}) SELECT l.series_id, ny - 1 - j AS k, k AS j, i, v FROM l JOIN series_geom g USING (series_id)")
def reslice_coronal(spark: SparkSession, d: str) -> DataFrame:
    return _long(volume.coronal(table(spark, d, "scanlines"), table(spark, d, "series_geom")))


@query(f"{_V}, l AS ({_LONG}) SELECT series_id, CAST(i AS INT) AS k, k AS j, CAST(j AS BIGINT) AS i, v FROM l")
def reslice_sagittal(spark: SparkSession, d: str) -> DataFrame:
    return _long(volume.sagittal(table(spark, d, "scanlines")))


@query(f"{_V}, l AS ({_LONG}) SELECT series_id, k, j, i, v FROM l WHERE k = 3")
def slice_axial(spark: SparkSession, d: str) -> DataFrame:
    return _long(volume.axial_slice(table(spark, d, "scanlines"), 3))


@query(f"{_V}, l AS ({_LONG}) SELECT series_id, k, j, i, v FROM l WHERE j = 4")
def slice_coronal(spark: SparkSession, d: str) -> DataFrame:
    return _long(volume.coronal_slice(table(spark, d, "scanlines"), 4))


@query(f"{_V} SELECT series_id, k, j, vals[18] AS v FROM scanlines")
def slice_sagittal(spark: SparkSession, d: str) -> DataFrame:
    return volume.sagittal_slice(table(spark, d, "scanlines"), 17)


@query(f"{_V}, l AS ({_LONG}) SELECT series_id, k, j, i, least(255.0, greatest(0.0, (v - (0.0625 - 0.5 / 2)) / 0.5 * 255)) AS v FROM l")
def window_level_map(spark: SparkSession, d: str) -> DataFrame:
    return _long(table(spark, d, "scanlines").withColumn("vals", volume.grey(F.col("vals"), F.lit(0.5), F.lit(0.0625))))


@query(f"{_V}, l AS ({_LONG}) SELECT series_id, k, j, i, v * (1.0 + series_id % 3) + (series_id % 5 - 2.0) AS v FROM l")
def rescale_hu(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("series_id").cast("double")
    return _long(table(spark, d, "scanlines").withColumn("vals", volume.rescaled(F.col("vals"), 1.0 + s % 3, s % 5 - 2.0)))


@query(f"""{with_duck('series_geom', 'clicks')}, {_SERIES_RANK} SELECT click_id, CASE orientation WHEN 2 THEN oz + slice_index * sz WHEN 1 THEN oy + slice_index * sy ELSE ox + slice_index * sx END AS location
FROM clicks LEFT JOIN (SELECT g.*, rank FROM series_geom g JOIN sr USING (series_id)) ON rank = click_id % ((SELECT count(*) FROM sr) + 2) UNION ALL SELECT -1 - file_id, location FROM ({with_duck('headers').removeprefix('WITH headers AS (').removesuffix(')')})""")
def slice_location(spark: SparkSession, d: str) -> DataFrame:
    c = _with_series(spark, d, table(spark, d, "clicks"), "click_id", MISSES).join(volume.known(table(spark, d, "series_geom")), "series_id", "left")
    here = c.select("click_id", volume.location(F.col("orientation"), F.col("slice_index")).alias("location"))
    none = table(spark, d, "headers").select((-1 - F.col("file_id")).alias("click_id"), F.lit(2).alias("orientation"), *(F.lit(None).cast("double").alias(x) for x in ("ox", "oy", "oz", "sx", "sy", "sz")), F.col("location").alias("header"))
    return here.union(none.select("click_id", volume.location(F.col("orientation"), F.lit(0), F.col("header"))))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return _with_series(spark, d, table(spark, d, "clicks"), "click_id").select("click_id", "series_id", "orientation", F.col("slice_index").cast("int").alias("slice_index"), F.col("px").alias("x"), (F.col("py") / 8 - 5).alias("y"), (F.col("px") / 4 + 6).alias("z"))


@query(f"""{with_duck('series_geom', 'scanlines', 'clicks')}, {_SERIES_RANK}, q AS (SELECT click_id, series_id, orientation, slice_index, px AS x, py / 8 - 5 AS y, px / 4 + 6 AS z FROM clicks JOIN sr ON rank = click_id % n),
x AS (SELECT q.click_id, g.*, round_even((x - ox) / sx, 0) AS i, CASE WHEN orientation = 1 THEN slice_index ELSE round_even((y - oy) / sy, 0) END AS j, CASE WHEN orientation = 2 THEN slice_index ELSE round_even((z - oz) / sz, 0) END AS k FROM q JOIN series_geom g USING (series_id))
SELECT click_id, CAST(x.j AS INT) AS row, CAST(x.i AS INT) AS col, s.vals[CAST(x.i AS INT) + 1] AS value FROM x JOIN scanlines s ON s.series_id = x.series_id AND s.k = x.k AND s.j = x.j WHERE x.i >= 0 AND x.i < nx""")
def point_sample(spark: SparkSession, d: str) -> DataFrame:
    return volume.sample(_points(spark, d), table(spark, d, "series_geom"), table(spark, d, "scanlines")).select("click_id", "row", "col", "value")


@query(f"""{with_duck('series_geom', 'clicks')}, {_SERIES_RANK} SELECT click_id, px AS x, CASE WHEN orientation = 1 THEN oy + slice_index * sy ELSE py / 8 - 5 END AS y, CASE WHEN orientation = 2 THEN oz + slice_index * sz ELSE px / 4 + 6 END AS z
FROM clicks JOIN sr ON rank = click_id % n JOIN series_geom USING (series_id)""")
def snap_to_plane(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).join(volume.known(table(spark, d, "series_geom")), "series_id")
    x, y, z = volume.snap(F.col("orientation"), F.col("slice_index"), F.col("x"), F.col("y"), F.col("z"))
    return p.select("click_id", x.alias("x"), y.alias("y"), z.alias("z"))


@query(f"{_V} SELECT series_id, min(k) AS k0, max(k) AS k1, min(j) AS j0, max(j) AS j1, 0 AS i0, max(len(vals)) - 1 AS i1 FROM scanlines GROUP BY 1")
def slice_extent(spark: SparkSession, d: str) -> DataFrame:
    e = volume.extents(table(spark, d, "scanlines"))
    low = lambda o: F.max(F.when(F.col("orientation") == o, F.col("low")))
    high = lambda o: F.max(F.when(F.col("orientation") == o, F.col("high")))
    return e.groupBy("series_id").agg(low(2).alias("k0"), high(2).alias("k1"), low(1).alias("j0"), high(1).alias("j1"), low(0).alias("i0"), high(0).cast("long").alias("i1"))


@query("""WITH RECURSIVE m AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS step FROM events),
w AS (SELECT session_id, CAST(0 AS BIGINT) AS seq, 4 AS s FROM (SELECT DISTINCT session_id FROM m) UNION ALL SELECT m.session_id, m.seq, greatest(0, least(w.s + m.step, 9)) FROM w JOIN m ON m.session_id = w.session_id AND m.seq = w.seq + 1)
SELECT session_id, arg_max(s, seq) AS slice FROM w GROUP BY 1""")
def slice_clamp(spark: SparkSession, d: str) -> DataFrame:
    """Where each user's wheel log leaves a slice of 0..9 that starts at 4."""
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("session_id"), F.row_number().over(by_time).alias("seq"), F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("step"))
    return volume.wheels(e, 4, 0, 9, block=64)


@query(f"""{with_duck('series_geom', 'scanlines', 'clicks')}, {_SERIES_RANK}, x AS (SELECT series_id, 2 AS o, min(k) AS low, max(k) AS high FROM scanlines GROUP BY 1 UNION ALL SELECT series_id, 1, min(j), max(j) FROM scanlines GROUP BY 1 UNION ALL SELECT series_id, 0, 0, max(len(vals)) - 1 FROM scanlines GROUP BY 1)
SELECT click_id, sr.series_id, CAST(o AS INT) AS orientation, CAST(low AS INT) AS slice, CAST(high AS INT) AS high FROM clicks JOIN sr ON rank = click_id % n JOIN x ON x.series_id = sr.series_id AND x.o = (clicks.orientation + 1) % 3""")
def slice_turn(spark: SparkSession, d: str) -> DataFrame:
    """What each view shows after a change of orientation: the next one's lowest slice, and its highest."""
    c = _with_series(spark, d, table(spark, d, "clicks"), "click_id").select("click_id", "series_id", volume.turned(F.col("orientation")).alias("orientation"))
    return c.join(volume.extents(table(spark, d, "scanlines")), ["series_id", "orientation"]).select("click_id", "series_id", F.col("orientation").cast("int").alias("orientation"), F.col("low").cast("int").alias("slice"), F.col("high").cast("int").alias("high"))


@query(f"{_V}, l AS ({_LONG}) SELECT l.series_id, k, j, i, i + nx * (j + ny * k) AS at, v FROM l JOIN series_geom g USING (series_id)")
def linear_index(spark: SparkSession, d: str) -> DataFrame:
    """Volumes flattened, cut into scanlines again, and each voxel's place in the flat array."""
    g = volume.known(table(spark, d, "series_geom").select("series_id", "nx", "ny", "nz"))
    flat = table(spark, d, "scanlines").groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("k", "j", "vals"))).alias("r"))
    flat = flat.select("series_id", F.flatten(F.transform("r", lambda x: x["vals"])).alias("vals")).join(g, "series_id")
    return _long(volume.unflatten(flat)).join(g, "series_id").select("series_id", "k", "j", "i", volume.linear(F.col("i"), F.col("j"), F.col("k")).alias("at"), "v")


@query(f"{_V}, l AS ({_LONG}) SELECT l.series_id, k, j, i, i * sx AS x, j * sy AS y, k * sz AS z FROM l JOIN series_geom g USING (series_id)")
def voxel_world(spark: SparkSession, d: str) -> DataFrame:
    g = volume.known(table(spark, d, "series_geom"))
    return _long(table(spark, d, "scanlines")).join(g, "series_id").select("series_id", "k", "j", "i", (F.col("i") * F.col("sx")).alias("x"), (F.col("j") * F.col("sy")).alias("y"), (F.col("k") * F.col("sz")).alias("z"))


# ---- surfaces ----

_MASK = f"{_V}, l AS ({_LONG}), m AS (SELECT series_id, k, j, i, CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END AS v FROM l)"


def _mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scanlines").withColumn("vals", F.transform("vals", lambda v: F.when(v > 0, 1.0).otherwise(0.0)))


@query(f"{_MASK} SELECT series_id, k, j, i, CAST(v >= 0.5 AS INT) AS v FROM m")
def mask_inside(spark: SparkSession, d: str) -> DataFrame:
    return _long(_mask(spark, d).withColumn("vals", surface.inside(F.col("vals"))))


_CROSS = "SELECT a.series_id, {} AS axis, CAST(a.i AS INT) AS i, a.j, a.k, (0.5 - a.v) / (b.v - a.v) AS t FROM l a JOIN l b ON a.series_id = b.series_id AND a.i + {} = b.i AND a.j + {} = b.j AND a.k + {} = b.k WHERE (a.v >= 0.5) <> (b.v >= 0.5)"


@query(f"{_V}, l AS (SELECT series_id, k, j, i, v + 0.375 AS v FROM ({_LONG})) {_CROSS.format(0, 1, 0, 0)} UNION ALL {_CROSS.format(1, 0, 1, 0)} UNION ALL {_CROSS.format(2, 0, 0, 1)}")
def surface_vertices(spark: SparkSession, d: str) -> DataFrame:
    return surface.vertices(table(spark, d, "scanlines").withColumn("vals", F.transform("vals", lambda v: v + 0.375)))


@query(f"""{_MASK}, c AS (SELECT series_id, i - di AS i, j - dj AS j, k - dk AS k, sum(CAST(v >= 0.5 AS INT) << (di + 2 * dj + 4 * dk)) AS code, count(*) AS n
FROM m, (VALUES (0), (1)) x(di), (VALUES (0), (1)) y(dj), (VALUES (0), (1)) z(dk) GROUP BY ALL) SELECT series_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k, CAST(code AS INT) AS code FROM c WHERE n = 8 AND code NOT IN (0, 255)""")
def surface_cells(spark: SparkSession, d: str) -> DataFrame:
    return surface.cells(_mask(spark, d))


@query()
def surface_triangles(spark: SparkSession, d: str) -> DataFrame:
    return surface.triangles(surface.cells(_mask(spark, d)))


@query()
def mesh_smooth(spark: SparkSession, d: str) -> DataFrame:
    m = _mask(spark, d)
    points = surface.positions(surface.vertices(m), table(spark, d, "series_geom"))
    return surface.smooth(points, surface.triangles(surface.cells(m)), iterations=20)


# ---- regions of interest ----

_LOG = f"""{with_duck('roi_log')}, e AS (SELECT *, count(*) FILTER (op = 'add') OVER w AS id, count(*) FILTER (op = 'clear') OVER w AS epoch, count(*) FILTER (op = 'add' AND has_color = 0) OVER w AS c FROM roi_log WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
a AS (SELECT session_id, seq, id AS roi_id, epoch, roi_type, CASE WHEN has_color = 0 THEN c END AS color_no FROM e WHERE op = 'add'),
x AS (SELECT a.*, (SELECT min(seq) FROM e r WHERE r.session_id = a.session_id AND r.op = 'remove' AND r.roi_id = a.roi_id AND r.seq > a.seq AND r.epoch = a.epoch) AS removed, (SELECT min(seq) FROM e r WHERE r.session_id = a.session_id AND r.op = 'clear' AND r.seq > a.seq) AS cleared FROM a),
life AS (SELECT *, coalesce(removed, cleared) AS ends FROM x)"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The edit log, its adds with three to five points."""
    p = lambda x, y: F.struct((F.col("ex") + x).alias("x"), (F.col("ey") + y).alias("y"), F.lit(0.0).alias("z"))
    points = F.slice(F.array(p(0, 0), p(4, 0), p(4, 3), p(0, 3), p(-1, 1)), F.lit(1), F.col("n_points"))
    return table(spark, d, "roi_log").withColumn("points", F.when(F.col("op") == "add", points))


@query(f"{_LOG} SELECT session_id, seq, roi_id, roi_type FROM a")
def roi_ids(spark: SparkSession, d: str) -> DataFrame:
    return rois.adds(table(spark, d, "roi_log")).select("session_id", "seq", "roi_id", "roi_type")


_RGB = "[" + ", ".join("[" + ", ".join(map(str, c)) + "]" for c in rois.PALETTE) + "]"


@query(f"{_LOG} SELECT session_id, roi_id, CAST({_RGB}[(color_no - 1) % 8 + 1][1] AS DOUBLE) AS r, CAST({_RGB}[(color_no - 1) % 8 + 1][2] AS DOUBLE) AS g, CAST({_RGB}[(color_no - 1) % 8 + 1][3] AS DOUBLE) AS b FROM a")
def roi_colors(spark: SparkSession, d: str) -> DataFrame:
    c = rois.palette(F.col("color_no"))
    return rois.adds(table(spark, d, "roi_log")).select("session_id", "roi_id", *(F.get(c, F.lit(i)).alias(n) for i, n in enumerate("rgb")))


_NAMES = f"""{_LOG}, named AS (SELECT session_id, roi_id, seq, roi_type, upper(roi_type[1]) || roi_type[2:] || ' ' ||
(SELECT count(*) + 1 FROM life o WHERE o.session_id = life.session_id AND o.roi_type = life.roi_type AND o.seq < life.seq AND (o.ends IS NULL OR o.ends > life.seq)) AS name FROM life)"""


@query(f"{_NAMES} SELECT * FROM named")
def roi_auto_name(spark: SparkSession, d: str) -> DataFrame:
    return rois.named(table(spark, d, "roi_log"))


@query(f"{_LOG} SELECT session_id, roi_id, roi_type FROM life WHERE ends IS NULL")
def roi_live(spark: SparkSession, d: str) -> DataFrame:
    return rois.live(table(spark, d, "roi_log")).select("session_id", "roi_id", "roi_type")


@query(f"""{_NAMES} SELECT l.session_id, l.roi_id, coalesce((SELECT arg_max(trim(r.name), r.seq) FROM roi_log r WHERE r.session_id = l.session_id AND r.op = 'rename' AND r.roi_id = l.roi_id AND r.seq > l.seq AND trim(r.name) <> ''), n.name) AS name
FROM life l JOIN named n ON n.session_id = l.session_id AND n.roi_id = l.roi_id WHERE l.ends IS NULL""")
def roi_rename(spark: SparkSession, d: str) -> DataFrame:
    return rois.renamed(table(spark, d, "roi_log"), "name").select("session_id", "roi_id", "name")


_EMPTY = "[]::STRUCT(x DOUBLE, y DOUBLE, z DOUBLE)[]"
_INSIDE = "e.idx >= 0 AND e.idx < len(a.p)"
_AT = "struct_pack(x := e.ex, y := e.ey, z := 0.0::DOUBLE)"
#: Edits as a list, folded: p the points, told the seqs at which vertices came or went. {0}: the points at first, {1}: the edits.
_FOLD = f"""list_reduce(list_prepend(struct_pack(seq := 0::BIGINT, op := '', idx := 0, ex := 0.0::DOUBLE, ey := 0.0::DOUBLE, p := {{0}}, told := []::BIGINT[]),
list_transform(coalesce({{1}}, []), lambda e: struct_pack(seq := e.seq, op := e.op, idx := e.idx, ex := e.ex, ey := e.ey, p := {_EMPTY}, told := []::BIGINT[]))),
lambda a, e: struct_pack(seq := e.seq, op := e.op, idx := e.idx, ex := e.ex, ey := e.ey,
p := CASE WHEN e.op = 'translate' THEN list_transform(a.p, lambda q: struct_pack(x := q.x + e.ex, y := q.y + e.ey, z := q.z)) WHEN e.op = 'update' AND {_INSIDE} THEN list_concat(a.p[:e.idx], [{_AT}], a.p[e.idx + 2:])
WHEN e.op = 'insert' THEN list_concat(a.p[:e.idx + 1], [{_AT}], a.p[e.idx + 2:]) WHEN e.op = 'delete' AND {_INSIDE} AND len(a.p) > 3 THEN list_concat(a.p[:e.idx], a.p[e.idx + 2:]) ELSE a.p END,
told := CASE WHEN e.op = 'insert' OR e.op = 'delete' AND {_INSIDE} AND len(a.p) > 3 THEN list_append(a.told, e.seq) ELSE a.told END))"""
_EDITS = "list(struct_pack(seq := r.seq, op := r.op, idx := r.idx, ex := r.ex, ey := r.ey) ORDER BY r.seq)"
_CORNERS = ", ".join(f"struct_pack(x := CAST(o.ex + {x} AS DOUBLE), y := CAST(o.ey + {y} AS DOUBLE), z := 0.0::DOUBLE)" for x, y in ((0, 0), (4, 0), (4, 3), (0, 3), (-1, 1)))
_SHAPED = f"""{_NAMES}, ed AS (SELECT life.session_id, life.roi_id, {_EDITS} AS l FROM life JOIN roi_log r ON r.session_id = life.session_id AND r.roi_id = life.roi_id AND r.op IN ('update', 'translate', 'insert', 'delete')
AND r.seq > life.seq AND (life.ends IS NULL OR r.seq < life.ends) GROUP BY ALL),
shaped AS (SELECT life.*, {_FOLD.format(f"([{_CORNERS}])[:o.n_points]", "ed.l")} AS f FROM life JOIN roi_log o ON o.session_id = life.session_id AND o.seq = life.seq LEFT JOIN ed ON ed.session_id = life.session_id AND ed.roi_id = life.roi_id)"""
_OFF = "(p.op = 'clear' OR p.op = 'tool' AND p.tool <> 'edit')"
_CHOSEN = f"""s AS (SELECT session_id, arg_max(op, seq) AS op, arg_max(roi_id, seq) AS id, max(seq) AS at FROM roi_log p WHERE op = 'select' OR {_OFF} GROUP BY 1),
chosen AS (SELECT u.session_id, CASE WHEN s.op = 'select' AND NOT EXISTS (SELECT 1 FROM roi_log r WHERE r.session_id = s.session_id AND r.op = 'remove' AND r.roi_id = s.id AND r.seq > s.at) THEN s.id END AS selected FROM (SELECT DISTINCT session_id FROM roi_log) u LEFT JOIN s USING (session_id))"""


@query(f"{with_duck('roi_log')}, {_CHOSEN} SELECT session_id, selected FROM chosen")
def roi_selected(spark: SparkSession, d: str) -> DataFrame:
    return rois.selected(table(spark, d, "roi_log"))


@query(f"""{_SHAPED}, told AS (SELECT session_id, unnest(f.told) AS seq FROM shaped), sel AS (SELECT e.*, (SELECT struct_pack(op := arg_max(p.op, p.seq), id := arg_max(p.roi_id, p.seq), at := max(p.seq)) FROM e p WHERE p.session_id = e.session_id AND p.seq < e.seq AND (p.op = 'select' OR {_OFF})) AS s FROM e),
f AS (SELECT sel.*, coalesce(s.op = 'select' AND s.id = roi_id AND NOT EXISTS (SELECT 1 FROM e p WHERE p.session_id = sel.session_id AND p.op = 'remove' AND p.roi_id = sel.roi_id AND p.seq > s.at AND p.seq < sel.seq), false) AS drops,
EXISTS (SELECT 1 FROM life l WHERE l.session_id = sel.session_id AND l.removed = sel.seq AND l.roi_id = sel.roi_id) AS hits, EXISTS (SELECT 1 FROM life l WHERE l.session_id = sel.session_id AND l.roi_id = sel.roi_id AND l.seq < sel.seq AND (l.ends IS NULL OR l.ends > sel.seq)) AS there FROM sel)
SELECT session_id, seq, 0 AS no, 'added' AS event, id AS roi_id FROM f WHERE op = 'add' UNION ALL SELECT session_id, seq, 1, 'changed', NULL FROM f WHERE op IN ('add', 'clear') UNION ALL SELECT session_id, seq, 0, 'selection', CASE WHEN op = 'select' THEN roi_id END FROM f WHERE op IN ('select', 'clear')
UNION ALL SELECT session_id, seq, 0, 'selection', NULL FROM f WHERE op = 'tool' AND tool <> 'edit' UNION ALL SELECT session_id, seq, 0, 'changed', NULL FROM told
UNION ALL SELECT session_id, seq, 0, 'changed', NULL FROM f WHERE op = 'rename' AND there AND trim(name) <> '' UNION ALL SELECT session_id, seq, 0, 'selection', NULL FROM f WHERE op = 'remove' AND drops
UNION ALL SELECT session_id, seq, CAST(drops AS INT), 'removed', roi_id FROM f WHERE op = 'remove' AND hits UNION ALL SELECT session_id, seq, CAST(drops AS INT) + 1, 'changed', NULL FROM f WHERE op = 'remove' AND hits""")
def roi_changes(spark: SparkSession, d: str) -> DataFrame:
    return rois.changes(_log(spark, d))


@query(f"""{with_duck('roi_vertices', 'roi_edits')}, v AS (SELECT roi_id, slice_index, orientation, list(struct_pack(x := x, y := y, z := z) ORDER BY vertex_idx) AS p FROM roi_vertices GROUP BY ALL), ed AS (SELECT roi_id, {_EDITS} AS l FROM roi_edits r GROUP BY 1),
g AS (SELECT v.*, {_FOLD.format("v.p", "ed.l")}.p AS q FROM v LEFT JOIN ed USING (roi_id))
SELECT roi_id, slice_index, orientation, CAST(generate_subscripts(q, 1) - 1 AS INT) AS vertex_idx, unnest(list_transform(q, lambda t: t.x)) AS x, unnest(list_transform(q, lambda t: t.y)) AS y, unnest(list_transform(q, lambda t: t.z)) AS z FROM g""")
def roi_fold(spark: SparkSession, d: str) -> DataFrame:
    return rois.vertex_rows(rois.fold(rois.nested(table(spark, d, "roi_vertices")), table(spark, d, "roi_edits")))


@query(f"""{with_duck('roi_vertices', 'clicks')}, r AS (SELECT DISTINCT roi_id, slice_index, orientation FROM roi_vertices), {_REGION_RANK}, w AS (SELECT slice_index, orientation, rr.roi_id AS selected FROM (SELECT slice_index, orientation, max(click_id) AS last FROM clicks GROUP BY ALL) JOIN rr ON rank = last % n)
SELECT slice_index, orientation, roi_id, selected = roi_id AS handles FROM w JOIN r USING (slice_index, orientation)""")
def roi_visible(spark: SparkSession, d: str) -> DataFrame:
    """What each view shows after its last click."""
    last = table(spark, d, "clicks").groupBy("slice_index", "orientation").agg(F.max("click_id").alias("click_id"))
    views = last.join(_picks(spark, d).select("click_id", F.col("roi_id").alias("selected")), "click_id").drop("click_id")
    shapes = table(spark, d, "roi_vertices").select("roi_id", "slice_index", "orientation").distinct()
    return rois.visible(views, shapes).select("slice_index", "orientation", "roi_id", "handles")


_EDGES = f"""{with_duck('roi_vertices', 'clicks')}, n AS (SELECT *, count(*) OVER (PARTITION BY roi_id) AS n FROM roi_vertices),
edges AS (SELECT a.roi_id, a.slice_index, a.orientation, a.vertex_idx AS edge_idx, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS yb FROM n a JOIN n b ON a.roi_id = b.roi_id AND b.vertex_idx = (a.vertex_idx + 1) % a.n WHERE a.n >= 2),
{_REGION_RANK}, picks AS (SELECT clicks.*, roi_id FROM clicks JOIN rr ON rank = click_id % n)"""
_DIST = """sqrt(qx * qx + qy * qy) AS d FROM (SELECT *, CASE WHEN l2 < 1e-12 THEN px - ax ELSE px - (ax + t * dx) END AS qx, CASE WHEN l2 < 1e-12 THEN py - ay ELSE py - (ay + t * dy) END AS qy FROM
(SELECT *, greatest(0.0, least(1.0, ((px - ax) * dx + (py - ay) * dy) / nullif(l2, 0))) AS t FROM (SELECT *, dx * dx + dy * dy AS l2 FROM (SELECT *, bx - ax AS dx, yb - ay AS dy FROM {}))))"""


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """Each region with its points: one shuffle of the given rows."""
    return rois.nested(table(spark, d, "roi_vertices", "l_orderkey"))


def _outline(spark: SparkSession, d: str) -> DataFrame:
    return rois.edges(_regions(spark, d))


def _picks(spark: SparkSession, d: str, regions: DataFrame | None = None) -> DataFrame:
    """Each click with the region at the place that its number has modulo their count."""
    regions, n = ranked((table(spark, d, "roi_vertices") if regions is None else regions).select("roi_id").distinct(), "roi_id")
    return table(spark, d, "clicks").withColumn("rank", F.col("click_id") % max(1, n)).join(regions, "rank").drop("rank")


@query(f"""{_EDGES} SELECT roi_id, slice_index, orientation, CAST(edge_idx AS INT) AS edge_idx, ax, ay, bx, yb AS "by" FROM edges""")
def roi_edges(spark: SparkSession, d: str) -> DataFrame:
    return _outline(spark, d)


@query(f"{with_duck('roi_vertices')} SELECT roi_id, slice_index, orientation, CAST(vertex_idx AS INT) AS vertex_idx, x, y, z FROM roi_vertices")
def roi_vertices(spark: SparkSession, d: str) -> DataFrame:
    return rois.vertex_rows(rois.nested(table(spark, d, "roi_vertices")))


_MOVES = f"{with_duck('gestures')}, m AS (SELECT session_id, seq, x, y, z, lag(x) OVER w AS x1, lag(y) OVER w AS y1, lag(z) OVER w AS z1 FROM gestures WINDOW w AS (PARTITION BY session_id ORDER BY seq))"


def _corners(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("seq")
    return table(spark, d, "gestures").select("session_id", "seq", "x", "y", "z", *(F.lag(c).over(w).alias(f"{c}1") for c in "xyz")).filter("x1 IS NOT NULL")


@query(f"""{_MOVES}, s AS (SELECT *, least(abs(x - x1), abs(y - y1)) AS side FROM m WHERE x1 IS NOT NULL), q AS (SELECT *, x1 + CASE WHEN x - x1 >= 0 THEN side ELSE -side END AS x2, y1 + CASE WHEN y - y1 >= 0 THEN side ELSE -side END AS y2 FROM s)
SELECT session_id, seq, 0 AS pos, x1 AS x, y1 AS y, z1 AS z FROM q UNION ALL SELECT session_id, seq, 1, x2, y1, z1 FROM q UNION ALL SELECT session_id, seq, 2, x2, y2, z1 FROM q UNION ALL SELECT session_id, seq, 3, x1, y2, z1 FROM q""")
def shape_rect(spark: SparkSession, d: str) -> DataFrame:
    pts = rois.rectangle(*map(F.col, ("x1", "y1", "x", "y", "z1")))
    return _corners(spark, d).select("session_id", "seq", F.posexplode(pts).alias("pos", "p")).select("session_id", "seq", "pos", "p.x", "p.y", "p.z")


@query(f"""{_MOVES}, p AS (SELECT *, unnest(range(64)) AS pos FROM m WHERE x1 IS NOT NULL) SELECT session_id, seq, CAST(pos AS INT) AS pos, round((x1 + x) / 2 + abs(x - x1) / 2 * cos(6.283185307179586 * pos / 64), 6) + 0.0 AS x,
round((y1 + y) / 2 + abs(y - y1) / 2 * sin(6.283185307179586 * pos / 64), 6) + 0.0 AS y, (z1 + z) / 2 AS z FROM p""")
def shape_ellipse(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of corners' 64 points."""
    p = _corners(spark, d).select("session_id", "seq", F.posexplode(rois.ellipse(*map(F.col, ("x1", "y1", "z1", "x", "y", "z")))).alias("pos", "p"))
    return p.select("session_id", "seq", "pos", *((rois.rounded(F.col(f"p.{c}"), 6) + 0.0).alias(c) for c in "xy"), "p.z")


@query(f"""{_EDGES}, h AS (SELECT click_id, vertex_idx, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS d FROM picks JOIN roi_vertices USING (roi_id)), b AS (SELECT click_id, vertex_idx FROM h WHERE d < 10 QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY d, vertex_idx) = 1)
SELECT p.click_id, p.roi_id, CAST(b.vertex_idx AS BIGINT) AS vertex_idx FROM picks p LEFT JOIN b USING (click_id)""")
def nearest_vertex(spark: SparkSession, d: str) -> DataFrame:
    return rois.nearest_vertex(_picks(spark, d), table(spark, d, "roi_vertices")).select("click_id", "roi_id", F.col("vertex_idx").cast("long").alias("vertex_idx"))


_EDGE_HIT = f"h AS (SELECT *, {_DIST.format('(SELECT click_id, px, py, roi_id, edge_idx, ax, ay, bx, yb FROM picks JOIN edges USING (roi_id))')})"


@query(f"""{_EDGES}, {_EDGE_HIT}, b AS (SELECT click_id, edge_idx FROM h WHERE d < 8 QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY d, edge_idx) = 1)
SELECT p.click_id, p.roi_id, CAST(b.edge_idx AS INT) AS edge_idx FROM picks p LEFT JOIN b USING (click_id)""")
def nearest_edge(spark: SparkSession, d: str) -> DataFrame:
    return rois.nearest_edge(_picks(spark, d), _outline(spark, d)).select("click_id", "roi_id", "edge_idx")


def _among_regions(spark: SparkSession, d: str, find: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame]) -> DataFrame:
    """find(regions, keep) with the regions gathered once, as files of the shared folder that its jobs read in place of the given
    rows; so are the rows that it gives to keep. The files go when all is found."""
    root = f"{shared_dir(spark)}/regions-{uuid.uuid4().hex}"

    def keep(rows: DataFrame) -> DataFrame:
        rows.write.parquet(at := f"{root}/{uuid.uuid4().hex}")
        return spark.read.schema(rows.schema).parquet(at)

    try:
        return find(keep(_regions(spark, d)), keep).checkpoint()
    finally:
        delete(spark, root)


_NEAR = f"near AS (SELECT click_id, roi_id FROM (SELECT *, {_DIST.format('(SELECT click_id, px, py, e.roi_id, edge_idx, ax, ay, bx, yb FROM clicks c JOIN edges e USING (slice_index, orientation))')}) WHERE d < 8 QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY d, roi_id) = 1)"


@query(f"{_EDGES}, {_NEAR} SELECT c.click_id, n.roi_id AS nearest FROM clicks c LEFT JOIN near n USING (click_id)")
def nearest_roi(spark: SparkSession, d: str) -> DataFrame:
    return _among_regions(spark, d, lambda regions, _: rois.nearest_roi(table(spark, d, "clicks"), rois.edges(regions)).select("click_id", "nearest"))


@query(f"""{_EDGES}, {_NEAR}, own AS (SELECT DISTINCT p.* FROM picks p JOIN roi_vertices v ON v.roi_id = p.roi_id AND v.slice_index = p.slice_index),
v AS (SELECT click_id, vertex_idx FROM (SELECT click_id, vertex_idx, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS d FROM own JOIN roi_vertices USING (roi_id)) WHERE d < 10 QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY d, vertex_idx) = 1),
e AS (SELECT DISTINCT click_id FROM (SELECT *, {_DIST.format('(SELECT click_id, px, py, roi_id, edge_idx, ax, ay, bx, yb FROM own JOIN edges USING (roi_id))')}) WHERE d < 8)
SELECT p.click_id, CASE WHEN v.click_id IS NOT NULL THEN 'vertex' WHEN e.click_id IS NOT NULL THEN 'whole' ELSE 'select' END AS action, CAST(CASE WHEN v.click_id IS NOT NULL THEN v.vertex_idx WHEN e.click_id IS NOT NULL THEN p.roi_id ELSE near.roi_id END AS BIGINT) AS target
FROM picks p LEFT JOIN v USING (click_id) LEFT JOIN e USING (click_id) LEFT JOIN near USING (click_id)""")
def edit_hit(spark: SparkSession, d: str) -> DataFrame:
    def hits(regions: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        picks = keep(_picks(spark, d, regions))
        picked = keep(regions.join(picks.select("roi_id").distinct(), "roi_id", "left_semi"))
        return rois.edit_hit(picks, rois.vertex_rows(picked), rois.edges(picked), rois.edges(regions))

    return _among_regions(spark, d, hits)


@query(f"""{_EDGES}, {_EDGE_HIT} SELECT click_id, roi_id, 'insert' AS op, CAST(edge_idx AS INT) AS idx, px AS ex, py AS ey FROM h WHERE d < 15 QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY d, edge_idx) = 1""")
def edit_insert(spark: SparkSession, d: str) -> DataFrame:
    return rois.double_click(_picks(spark, d), _outline(spark, d))


@query(f"""{_EDGES}, h AS (SELECT click_id, roi_id, vertex_idx, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS d FROM picks JOIN roi_vertices USING (roi_id))
SELECT click_id, roi_id, 'delete' AS op, CAST(vertex_idx AS INT) AS idx FROM h WHERE d < 15 QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY d, vertex_idx) = 1""")
def edit_delete(spark: SparkSession, d: str) -> DataFrame:
    return rois.hovered_delete(_picks(spark, d), table(spark, d, "roi_vertices"))


@query(f"{with_duck('gestures')} SELECT session_id AS drag_id, arg_max(x, seq) AS x, arg_max(y, seq) AS y, arg_max(x, seq) - arg_min(x, seq) AS dx, arg_max(y, seq) - arg_min(y, seq) AS dy FROM gestures GROUP BY 1")
def edit_drag(spark: SparkSession, d: str) -> DataFrame:
    return rois.drags(table(spark, d, "gestures").select(F.col("session_id").alias("drag_id"), "seq", "x", "y"))


@query(f"""{with_duck('roi_vertices')}, r AS (SELECT DISTINCT roi_id, slice_index FROM roi_vertices) SELECT roi_id, '[' || roi_id || '] Roi ' || roi_id || '  (slice ' || (slice_index + 1) || ')' AS entry,
CAST(trunc(CAST({_RGB}[roi_id % 8 + 1][1] AS DOUBLE) * 255) AS INT) AS red, CAST(trunc(CAST({_RGB}[roi_id % 8 + 1][2] AS DOUBLE) * 255) AS INT) AS green FROM r""")
def roi_list(spark: SparkSession, d: str) -> DataFrame:
    r = _rois(spark, d)
    c = rois.rgb(F.col("color"))
    return r.select("roi_id", rois.listing(F.col("roi_id"), F.col("name"), F.col("slice_index")).alias("entry"), F.get(c, F.lit(0)).alias("red"), F.get(c, F.lit(1)).alias("green"))


@query(f"""{with_duck('roi_vertices', 'scanlines', 'series_geom')}, {_SERIES_RANK}, r AS (SELECT DISTINCT roi_id, slice_index, orientation FROM roi_vertices), x AS (SELECT series_id, 2 AS orientation, min(k) AS low, max(k) AS high FROM scanlines GROUP BY 1 UNION ALL SELECT series_id, 1, min(j), max(j) FROM scanlines GROUP BY 1)
SELECT roi_id, r.orientation, slice_index, low, high FROM r LEFT JOIN sr ON sr.rank = r.roi_id % ((SELECT count(*) FROM sr) + 2) LEFT JOIN x ON x.series_id = sr.series_id AND x.orientation = r.orientation""")
def roi_goto(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "roi_vertices").select("roi_id", "slice_index", "orientation").distinct()
    return rois.goto(_with_series(spark, d, r, "roi_id", MISSES), volume.extents(table(spark, d, "scanlines")))


# ---- streams ----

_BUILDS = "tool IN ('rectangle', 'ellipse')"
_SIDE = "least(abs(here.x - a.x), abs(here.y - a.y))"
_FAR_X, _FAR_Y = (f"a.{c} + CASE WHEN here.{c} >= a.{c} THEN {_SIDE} ELSE -{_SIDE} END" for c in "xy")
_SHAPE = f"""CASE tool WHEN 'rectangle' THEN [a, struct_pack(x := {_FAR_X}, y := a.y, z := a.z), struct_pack(x := {_FAR_X}, y := {_FAR_Y}, z := a.z), struct_pack(x := a.x, y := {_FAR_Y}, z := a.z)]
ELSE list_transform(range(64), lambda i: struct_pack(x := (a.x + here.x) / 2 + abs(here.x - a.x) / 2 * cos(6.283185307179586 * i / 64), y := (a.y + here.y) / 2 + abs(here.y - a.y) / 2 * sin(6.283185307179586 * i / 64), z := (a.z + here.z) / 2)) END"""
_POINT = "STRUCT(x DOUBLE, y DOUBLE, z DOUBLE)"
#: The drawings of each session, row by row: what the row does to the state before it, then the state after it.
_DRAWN = f"""{with_duck('gestures').replace('WITH ', 'WITH RECURSIVE ', 1)},
st AS (SELECT DISTINCT session_id, 0::BIGINT AS seq, 'none' AS tool, false AS drawing, []::{_POINT}[] AS p, NULL::{_POINT} AS a, NULL::VARCHAR AS event, ''::VARCHAR AS roi_type, []::{_POINT}[] AS told, 0::BIGINT AS slice_index, 0 AS orientation FROM gestures
UNION ALL SELECT session_id, seq, CASE act WHEN 'cancel' THEN 'none' WHEN 'tool' THEN chosen ELSE tool END, CASE WHEN act IN ('start', 'append', 'anchor') THEN true WHEN act IN ('end', 'shape_end', 'cancel') THEN false ELSE drawing END,
  CASE WHEN act IN ('end', 'shape_end', 'cancel') THEN [] ELSE q END, CASE WHEN act = 'anchor' THEN here WHEN act NOT IN ('end', 'shape_end', 'cancel') THEN a END,
  CASE WHEN act = 'cancel' THEN 'cancelled' WHEN act IN ('end', 'shape_end') AND len(q) >= 2 THEN 'roi' END, tool, CASE WHEN act = 'cancel' THEN [] ELSE q END, slice_index, orientation
FROM (SELECT *, CASE WHEN act IN ('start', 'anchor') THEN [here] WHEN act = 'append' THEN list_append(p, here) WHEN act IN ('shape', 'shape_end') THEN {_SHAPE} ELSE p END AS q
FROM (SELECT *, CASE WHEN kind = 'tool' THEN 'tool' WHEN kind = 'escape' THEN 'cancel' WHEN kind = 'left_press' AND tool = 'freehand' THEN 'start' WHEN kind = 'left_press' AND tool = 'polygon' THEN CASE WHEN drawing THEN 'append' ELSE 'start' END
  WHEN kind = 'left_press' AND {_BUILDS} THEN 'anchor' WHEN NOT drawing THEN '' WHEN kind = 'move' AND tool = 'freehand' THEN 'append' WHEN kind = 'move' AND {_BUILDS} AND a IS NOT NULL THEN 'shape'
  WHEN kind = 'left_release' AND tool = 'freehand' THEN 'end' WHEN kind = 'left_release' AND {_BUILDS} THEN CASE WHEN a IS NULL OR a = here THEN 'cancel' ELSE 'shape_end' END
  WHEN kind = 'right_press' AND tool = 'polygon' THEN CASE WHEN len(p) >= 3 THEN 'end' ELSE 'cancel' END ELSE '' END AS act
FROM (SELECT st.session_id, g.seq, g.kind, g.tool AS chosen, struct_pack(x := g.x, y := g.y, z := g.z) AS here, g.slice_index, g.orientation, st.tool, st.drawing, st.p, st.a FROM st JOIN gestures g ON g.session_id = st.session_id AND g.seq = st.seq + 1))))
SELECT session_id, seq, event, roi_type, slice_index, orientation, len(told) AS n_points, array_to_string(list_transform(told, lambda q: CAST(round(q.x * 1e6) AS BIGINT) || ':' || CAST(round(q.y * 1e6) AS BIGINT) || ':' || CAST(round(q.z * 1e6) AS BIGINT)), ' ') AS points FROM st WHERE event IS NOT NULL"""


def _told(out: DataFrame) -> DataFrame:
    """Points as text, in millionths."""
    at = lambda p, c: F.round(p[c] * 1e6).cast("long").cast("string")
    points = F.transform(F.arrays_zip("xs", "ys", "zs"), lambda p: F.concat_ws(":", at(p, "xs"), at(p, "ys"), at(p, "zs")))
    return out.select("session_id", "seq", "event", "roi_type", "slice_index", "orientation", F.col("n_points").cast("long").alias("n_points"), F.array_join(points, " ").alias("points"))


@query(_DRAWN)
def gesture_rois(spark: SparkSession, d: str) -> DataFrame:
    return _told(gestures.batch(table(spark, d, "gestures")))


def _played(spark: SparkSession, waves: list[DataFrame], job: Callable[[DataFrame], DataFrame], on_time: Callable[[str], Callable], after: Callable[[str], DataFrame]) -> DataFrame:
    """Each wave's rows written and read as a stream to their end, the next wave by the same query taken up again; then what
    `after` reads below the folder, which goes."""
    root, provider = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        keep = on_time(root)
        for rows in waves:
            rows.write.mode("append").parquet(f"{root}/in")
            source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(f"{root}/in")
            sinks.routed(job(source), f"{root}/late", keep, f"{root}/state").awaitTermination()
        return after(root).checkpoint()
    finally:
        spark.conf.set(provider, before)
        delete(spark, root)


@query(_DRAWN)
def gesture_stream(spark: SparkSession, d: str) -> DataFrame:
    """The gestures as a stream, to its end."""
    return _played(spark, [table(spark, d, "gestures")], gestures.stream, lambda root: sinks.folder(f"{root}/out"), lambda root: _told(spark.read.schema(gestures.OUT).parquet(f"{root}/out")))


def _in_waves(rows: DataFrame) -> list[DataFrame]:
    """Every third row of a session comes after all others."""
    return [rows.filter("seq % 3 <> 0"), rows.filter("seq % 3 = 0")]


_LATE = "SELECT session_id, seq FROM (SELECT *, max(seq) FILTER (seq % 3 <> 0) OVER (PARTITION BY session_id) AS seen FROM {0}) WHERE seq % 3 = 0 AND seq <= seen"


@query(f"{with_duck('gestures')} {_LATE.format('gestures')}")
def gesture_late(spark: SparkSession, d: str) -> DataFrame:
    """Gestures that come after later ones of their session, from the late rows' own sink."""
    late = lambda root: spark.read.schema(gestures.OUT).parquet(f"{root}/late").select("session_id", "seq")
    return _played(spark, _in_waves(table(spark, d, "gestures")), gestures.stream, lambda root: sinks.folder(f"{root}/out"), late)


@query(f"{_EPOCH} SELECT session_id, epoch, folder, min(seq) AS seq FROM e GROUP BY ALL")
def series_stream(spark: SparkSession, d: str) -> DataFrame:
    """The loads as a stream in two waves, the second after a restart: what each session takes in."""
    loads = table(spark, d, "loads").select("session_id", "seq", "op", "folder")
    waves = [loads.filter("seq <= 4"), loads.filter("seq > 4")]
    read = lambda root: spark.read.schema(series_log.OUT).parquet(f"{root}/out").select("session_id", "epoch", "folder", "seq")
    return _played(spark, waves, series_log.stream, lambda root: sinks.folder(f"{root}/out"), read)


@query(f"{with_duck('roi_log')} {_LATE.format('roi_log')}")
def roi_late(spark: SparkSession, d: str) -> DataFrame:
    """Edits that come after later ones of their session, from the late rows' own sink."""
    late = lambda root: spark.read.schema(roi_log.OUT).parquet(f"{root}/late").select("session_id", "seq")
    return _played(spark, _in_waves(_log(spark, d)), roi_log.changes, lambda root: sinks.RoiTable(spark, f"{root}/table").merge, late)


_TABLE = f"""{_SHAPED}, {_CHOSEN}, t AS (SELECT l.session_id, l.roi_id, l.roi_type, l.color_no, l.f, coalesce((SELECT arg_max(trim(r.name), r.seq) FROM roi_log r WHERE r.session_id = l.session_id AND r.op = 'rename' AND r.roi_id = l.roi_id AND r.seq > l.seq AND trim(r.name) <> ''), n.name) AS name
FROM shaped l JOIN named n ON n.session_id = l.session_id AND n.roi_id = l.roi_id WHERE l.ends IS NULL)
SELECT t.session_id, roi_id, roi_type, name, CAST({_RGB}[(color_no - 1) % 8 + 1][1] AS DOUBLE) AS r, CAST({_RGB}[(color_no - 1) % 8 + 1][2] AS DOUBLE) AS g, CAST({_RGB}[(color_no - 1) % 8 + 1][3] AS DOUBLE) AS b, coalesce(selected = roi_id, false) AS selected,
CAST(generate_subscripts(f.p, 1) - 1 AS INT) AS vertex_idx, unnest(list_transform(f.p, lambda q: q.x)) AS x, unnest(list_transform(f.p, lambda q: q.y)) AS y FROM t JOIN chosen USING (session_id)"""


def _table_rows(t: DataFrame) -> DataFrame:
    """A ROI table with a row for each vertex."""
    rgb = (F.get("color", F.lit(i)).alias(c) for i, c in enumerate("rgb"))
    v = t.select("session_id", "roi_id", "roi_type", "name", *rgb, "selected", F.posexplode("points").alias("vertex_idx", "p"))
    return v.select(*v.columns[:-1], "p.x", "p.y")


@query(_TABLE)
def roi_table(spark: SparkSession, d: str) -> DataFrame:
    return _table_rows(rois.table(_log(spark, d)))


@query(_TABLE)
def roi_stream(spark: SparkSession, d: str) -> DataFrame:
    """The log as a stream, to its end, merged batch by batch into the versioned table; then that table."""
    read = lambda root: _table_rows(roi_log.shaped(sinks.RoiTable(spark, f"{root}/table").read()))
    return _played(spark, [_log(spark, d)], roi_log.changes, lambda root: sinks.RoiTable(spark, f"{root}/table").merge, read)
