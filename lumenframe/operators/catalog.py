"""The series catalogue: file listings, headers, labels, captions, window/level, load order, spacing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.text import basename, filled, fixed, strip

#: The displayed header tags.
TAGS = (
    "PatientName PatientID PatientBirthDate PatientSex StudyDate StudyDescription StudyID AccessionNumber SeriesDate SeriesDescription SeriesNumber Modality Manufacturer "
    "ManufacturerModelName StationName InstitutionName BodyPartExamined SliceThickness SpacingBetweenSlices PixelSpacing KVP Exposure ConvolutionKernel Rows Columns "
    "BitsAllocated BitsStored WindowCenter WindowWidth RescaleIntercept RescaleSlope"
).split()
DEFAULT_WW, DEFAULT_WL = 400.0, 40.0


def visible(files: DataFrame) -> DataFrame:
    """Files whose name does not start with a dot, with their path; names starting with _ count."""
    return files.filter(~F.col("name").startswith(".")).withColumn("path", F.concat_ws("/", "folder", "name"))


def masks(files: DataFrame) -> DataFrame:
    return visible(files).filter(F.col("name").endswith(".mat"))


def catalog(files: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row for each folder: files, the first path, and a status. Folders without visible files have none of either.
    errors(path, error): decoding failures of first files."""
    seen = F.when(~F.col("name").startswith("."), F.concat_ws("/", "folder", "name"))
    out = files.groupBy("folder").agg(F.count(seen).alias("n_files"), F.min(seen).alias("first_path"))
    status = F.when(F.col("n_files") == 0, "No files found")
    if errors is not None:
        out = out.join(errors.select(F.col("path").alias("first_path"), "error"), "first_path", "left")
        status = status.when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), "error"))
    return out.withColumn("status", status.otherwise(F.col("n_files").cast("string"))).select("folder", "n_files", "first_path", "status")


def header_rows(blobs: DataFrame, decode: Callable[[bytes], dict[str, str]]) -> DataFrame:
    """blobs(path, content) -> path, keyword, value, error. decode is the caller's; what it raises becomes error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out += [(path, k, None if v is None else str(v), None) for k, v in decode(bytes(content)).items()]
                except Exception as e:  # noqa: BLE001  a decoder's own failure is data here
                    out.append((path, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "keyword", "value", "error"])

    return blobs.select("path", "content").mapInPandas(run, "path string, keyword string, value string, error string")


def first_files(files: DataFrame) -> DataFrame:
    """The first visible path of each folder: headers are decoded for these only."""
    return visible(files).groupBy("folder").agg(F.min("path").alias("path"))


def pivot_headers(rows: DataFrame, tags: list[str] = TAGS) -> DataFrame:
    return rows.groupBy("path").pivot("keyword", tags).agg(F.first("value", ignorenulls=True))


def label(number: Column, description: Column, folder: Column) -> Column:
    parts = F.concat_ws(" – ", filled(strip(number)), filled(strip(description)))
    return F.coalesce(filled(parts), basename(folder))


def window_level(ww: Column, wl: Column) -> tuple[Column, Column]:
    both = ww.isNotNull() & wl.isNotNull()
    return F.when(both, ww).otherwise(F.lit(DEFAULT_WW)), F.when(both, wl).otherwise(F.lit(DEFAULT_WL))


def session_window_level(loads: DataFrame) -> DataFrame:
    """loads(session_id, seq, op, ww, wl) with the session's window and level after each: only the first row, which
    finds an empty list, sets them, and only with both values; every other row inherits."""
    by_seq = Window.partitionBy("session_id").orderBy("seq")
    sets = (F.row_number().over(by_seq) == 1) & F.col("ww").isNotNull() & F.col("wl").isNotNull()
    last = F.last(F.when(sets, F.struct("ww", "wl")), ignorenulls=True).over(by_seq)
    return loads.withColumn("window", F.coalesce(last["ww"], F.lit(DEFAULT_WW))).withColumn("level", F.coalesce(last["wl"], F.lit(DEFAULT_WL)))


def patient_caption(present: Column, name: Column, pid: Column, birth: Column, sex: Column) -> Column:
    line = filled(F.concat_ws("  ", filled(pid), filled(birth), filled(sex)))
    return F.when(present, F.concat_ws("\n", F.coalesce(filled(name), F.lit("Unknown")), line)).otherwise(F.lit("Patient: --"))


def study_caption(present: Column, date: Column, modality: Column, institution: Column, study: Column, series: Column) -> Column:
    day = F.when(date.rlike("^[0-9]{8}$"), F.concat_ws("-", date.substr(1, 4), date.substr(5, 2), date.substr(7, 2))).otherwise(F.coalesce(filled(date), F.lit("--")))
    return F.when(present, F.concat_ws("\n", day, *map(filled, (modality, institution, study, series)))).otherwise(F.lit("--"))


def geometry_caption(number: Column, index: Column, total: Column, columns: Column, rows: Column, spacing: tuple[Column, Column], location: Column, thickness: Column) -> Column:
    """Zero or null totals, null spacings and zero or null thicknesses show as --."""
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("--"))
    mm = lambda head, c, none: F.coalesce(F.concat(F.lit(head), c, F.lit(" mm")), F.lit(f"{head}{none} mm"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Series: "), dash(number)),
        F.concat(F.lit("Image: "), (index + 1).cast("string"), F.lit(" / "), dash(F.nullif(total, F.lit(0)))),
        F.concat(F.lit("Size: "), dash(columns), F.lit(" × "), dash(rows), F.lit(" px")),
        mm("Spacing: ", F.concat(fixed(spacing[0], 2), F.lit(" × "), fixed(spacing[1], 2)), "-- × --"),
        mm("Loc: ", fixed(location, 2), "--"),
        mm("Thick: ", fixed(F.nullif(thickness, F.lit(0.0)), 2), "--"),
    )


def loaded(loads: DataFrame) -> DataFrame:
    """What each session holds after its log: a load replaces everything, adding a folder twice does nothing. With pos
    (from 1, in load order) and epoch (loads so far)."""
    by_seq = Window.partitionBy("session_id").orderBy("seq")
    rows = loads.withColumn("epoch", F.sum((F.col("op") == "load").cast("int")).over(by_seq))
    rows = rows.withColumn("_last", F.max("epoch").over(Window.partitionBy("session_id"))).filter("epoch = _last").drop("_last")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("session_id", "folder").orderBy("seq"))).filter("_n = 1").drop("_n")
    return rows.withColumn("pos", F.row_number().over(by_seq))


def deduped(loads: DataFrame) -> DataFrame:
    """Each folder's first row since the load before it."""
    by_seq = Window.partitionBy("session_id").orderBy("seq")
    rows = loads.withColumn("epoch", F.sum((F.col("op") == "load").cast("int")).over(by_seq))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("session_id", "epoch", "folder").orderBy("seq"))).filter("_n = 1").drop("_n")


def replaced(loads: DataFrame) -> DataFrame:
    """Rows since each session's last load, itself included."""
    last = F.max(F.when(F.col("op") == "load", F.col("seq"))).over(Window.partitionBy("session_id"))
    return loads.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col("seq") >= F.col("_last"))).drop("_last")


def menu(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """rows(folder, pos) with their entry: the place in load order and the series' label. headers(folder, SeriesNumber,
    SeriesDescription) are those of the first files; a folder without one goes by its name."""
    j = rows.join(headers.select("folder", F.col("SeriesNumber").alias("_n"), F.col("SeriesDescription").alias("_d")), "folder", "left")
    return j.withColumn("entry", F.format_string("[%d]  %s", "pos", label(F.col("_n"), F.col("_d"), F.col("folder")))).drop("_n", "_d")


def resolve_spacing(sessions: DataFrame, series: DataFrame) -> DataFrame:
    """sessions(session_id, use_series, custom, series_id) with spacing: the series' if the flag is set and it is known,
    (1, 1, 1) if it isn't, the custom one if the flag is off; shown to 4 decimals."""
    joined = sessions.join(series.select("series_id", F.array("sx", "sy", "sz").alias("_own")), "series_id", "left")
    ones = F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))
    out = joined.withColumn("spacing", F.when(F.col("use_series"), F.coalesce("_own", ones)).otherwise(F.col("custom"))).drop("_own")
    text = F.concat(F.lit("("), fixed(F.get("spacing", F.lit(0)), 4), F.lit(", "), fixed(F.get("spacing", F.lit(1)), 4), F.lit(", "), fixed(F.get("spacing", F.lit(2)), 4), F.lit(")"))
    return out.withColumn("shown", text)


def toggled(sessions: DataFrame, series: DataFrame) -> DataFrame:
    """sessions(session_id, use_series, custom, series_id) after the flag is switched: switched on, a known series' spacing
    is copied into the custom values; switched off, those count as they are."""
    joined = sessions.join(series.select("series_id", F.array("sx", "sy", "sz").alias("_own")), "series_id", "left")
    now = joined.withColumn("use_series", ~F.coalesce("use_series", F.lit(False)))
    return now.withColumn("custom", F.when(F.col("use_series") & F.col("_own").isNotNull(), F.col("_own")).otherwise(F.col("custom"))).drop("_own")


def custom_spacing(c: Column) -> Column:
    return F.round(F.least(F.greatest(c, F.lit(0.01)), F.lit(50.0)), 4)


def select_mask(arrays: DataFrame) -> DataFrame:
    """arrays(file_id, pos, key, ndim, is_nested, readable): for each file the array that counts. A file that cannot be
    read, or has no nested array, fails; else the first 3-D array whose key does not start with _ wins, then the nested one."""
    ok = (F.col("ndim") == 3) & ~F.col("key").startswith("_") & ~F.col("is_nested")
    g = arrays.groupBy("file_id").agg(
        F.bool_and("readable").alias("_readable"),
        F.min(F.when(F.col("is_nested"), F.struct("pos", "key"))).alias("_nested"),
        F.min(F.when(ok, F.struct("pos", "key"))).alias("_top"),
    )
    status = F.when(~F.col("_readable"), "read_error").when(F.col("_nested").isNull(), "no_patient").when(F.col("_top").isNotNull(), "top_level").otherwise("nested")
    key = F.when(F.col("_readable") & F.col("_nested").isNotNull(), F.coalesce(F.col("_top.key"), F.col("_nested.key")))
    return g.select("file_id", status.alias("status"), key.alias("key"))
