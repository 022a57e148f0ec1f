"""Session documents: JSON text in bulk, with defaults, migration and regions of interest.

A stored value counts if its key exists, even as null; unknown keys go; text that is no JSON object gives all defaults.
Stricter than other readers: duplicate keys and NaN make a document corrupt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROI = "array<struct<name:string,roi_type:string,slice_index:int,orientation:int,points:array<array<double>>,color:array<double>>>"
DEFAULT_SPACING = [1.0, 1.0, 1.0]


def _stored(kind: str, key: str, default: Column) -> Column:
    """The key's value, null if stored as null or of another type, the default if missing."""
    value = F.try_variant_get("_v", f"$.{key}", "variant")
    return F.when(value.isNull(), default).otherwise(F.try_variant_get("_v", f"$.{key}", kind))


def read(sessions: DataFrame) -> DataFrame:
    """sessions(session_id, raw) -> session_id, status, library_dir, legacy_folder, folders, custom_spacing, use_series, rois."""
    no_text, spacing = F.array().cast("array<string>"), F.array(*map(F.lit, DEFAULT_SPACING))
    d = sessions.withColumn("_v", F.try_parse_json("raw"))
    known = F.schema_of_variant("_v").startswith("OBJECT")
    d = d.withColumn("_v", F.when(known, F.col("_v")))
    d = d.select(
        "session_id",
        F.when(F.col("_v").isNull(), "corrupt").otherwise("ok").alias("status"),
        _stored("string", "lesion_library_dir", F.lit("")).alias("library_dir"),
        _stored("string", "last_dicom_folder", F.lit("")).alias("legacy_folder"),
        _stored("array<string>", "last_dicom_folders", no_text).alias("folders"),
        _stored("array<double>", "custom_spacing", spacing).alias("custom_spacing"),
        _stored("boolean", "use_dicom_spacing", F.lit(True)).alias("use_series"),
        _stored(ROI, "rois", F.array().cast(ROI)).alias("rois"),
    )
    empty = F.coalesce(F.size("folders"), F.lit(0)) <= 0
    return d.withColumn("folders", F.when(empty & (F.coalesce("legacy_folder", F.lit("")) != ""), F.array("legacy_folder")).otherwise(F.col("folders")))


def write(rows: DataFrame) -> DataFrame:
    """session_id, raw: the JSON of the six keys."""
    doc = F.struct(
        F.col("library_dir").alias("lesion_library_dir"),
        F.col("legacy_folder").alias("last_dicom_folder"),
        F.col("folders").alias("last_dicom_folders"),
        "custom_spacing",
        F.col("use_series").alias("use_dicom_spacing"),
        "rois",
    )
    return rows.select("session_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("raw"))


def restored_folders(rows: DataFrame, directories: DataFrame) -> DataFrame:
    """rows(session_id, folders) -> the existing ones, once each, in order; the first is primary."""
    f = rows.select("session_id", F.posexplode("folders").alias("pos", "folder")).join(directories.select("folder"), "folder", "left_semi")
    first = f.groupBy("session_id", "folder").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("pos"))
    return first.select("session_id", "folder", rank.alias("rank")).withColumn("is_primary", F.col("rank") == 1)


def serialise(rois: DataFrame) -> DataFrame:
    """rois(session_id, roi_id, ...) -> session_id, rois as JSON in id order, without the ids."""
    one = F.struct(
        "roi_id",
        F.struct("name", "roi_type", "slice_index", "orientation", F.transform("points", lambda p: F.array(p["x"], p["y"], p["z"])).alias("points"), "color").alias("r"),
    )
    g = rois.groupBy("session_id").agg(F.sort_array(F.collect_list(one)).alias("_l"))
    return g.select("session_id", F.to_json(F.transform("_l", lambda x: x["r"])).alias("rois"))


def deserialise(rows: DataFrame, existing: Column | None = None) -> DataFrame:
    """rows(session_id, rois) -> one row for each ROI, numbered on from the existing ones. A missing key is an error in
    the whole list: its session gives no rows here and is found by `broken`."""
    whole = F.forall("rois", _complete)
    r = rows.filter(F.coalesce(whole, F.lit(False))).select("session_id", (existing if existing is not None else F.lit(0)).alias("_n"), F.posexplode("rois").alias("_pos", "r"))
    points = F.transform("r.points", lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"), F.get(p, 2).alias("z")))
    return r.select("session_id", (F.col("_n") + F.col("_pos") + 1).alias("roi_id"), "r.name", "r.roi_type", "r.slice_index", "r.orientation", points.alias("points"), "r.color")


def _complete(r: Column) -> Column:
    out = F.lit(True)
    for k in ("name", "roi_type", "slice_index", "orientation", "points", "color"):
        out = out & r[k].isNotNull()
    return out


def broken(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.coalesce(F.forall("rois", _complete), F.lit(True))).select("session_id")
