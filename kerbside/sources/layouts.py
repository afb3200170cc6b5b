"""Scene layouts (zones, lines and lamp boxes drawn by hand) and priors, as tables.

A layout is a JSON document; each of its members may be absent. `zones` and `lines` turn any number of layouts into rows, one for
each polygon or line, and `placed` maps them into videos by the videos' affine maps, so that many scenes go through one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.rules import Layout

POLYGON = "array<array<double>>"
#: Members of a layout document (fixed values).
DOCUMENT = (
    f"crossings array<{POLYGON}>, refuges array<{POLYGON}>, road_areas array<{POLYGON}>, solid_lines array<{POLYGON}>, u_turn_allowed array<{POLYGON}>, no_u_turn array<{POLYGON}>, "
    f"intersection {POLYGON}, carriageways array<struct<name:string, poly:{POLYGON}>>, prohibited_turns array<struct<`from`:{POLYGON}, `to`:{POLYGON}>>, "
    f"stop_lines array<struct<name:string, line:{POLYGON}, approach_sign:int, signal:string>>, signals map<string, map<string, array<double>>>"
)
#: Zone type by member, of members that are lists of polygons.
PLAIN = {"crossings": "crossing", "refuges": "refuge", "road_areas": "road_area", "u_turn_allowed": "u_turn_allowed", "no_u_turn": "no_u_turn"}
POINTS = "array<struct<x:double,y:double>>"


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """layout_id (the file's name without its ending) and the members, of one document, a folder or a pattern."""
    rows = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    return rows.select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("layout_id"), "*")


def points(poly: Column) -> Column:
    return F.transform(poly, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def zones(layouts: DataFrame) -> DataFrame:
    """layout_id, zone_type, zone_no (from 0, in the document's order), name and poly, one row for each polygon."""
    none = F.lit(None).cast("string")

    def rows(member: Column, kind: str, poly: str | None = None, name: str | None = None) -> Column:
        """A member's elements as zones; absent ones are none."""

        def zone(e: Column, i: Column) -> Column:
            return F.struct(F.lit(kind).alias("zone_type"), i.alias("zone_no"), (e[name] if name else none).alias("name"), points(e[poly] if poly else e).alias("poly"))

        return F.coalesce(F.transform(member, zone), F.array())

    found = [rows(F.col(member), kind) for member, kind in PLAIN.items()] + [rows(F.array_compact(F.array("intersection")), "intersection"), rows(F.col("carriageways"), "carriageway", "poly", "name")]
    found += [rows(F.col("prohibited_turns"), f"turn_{end}", end) for end in ("from", "to")]
    return layouts.select("layout_id", F.inline(F.concat(*found)))


def lines(layouts: DataFrame) -> DataFrame:
    """layout_id, line_type (stop_line or solid_line), line_no, name, approach_sign, signal and poly (two or more points)."""
    stops = F.transform(F.coalesce("stop_lines", F.array().cast(f"array<struct<name:string, line:{POLYGON}, approach_sign:int, signal:string>>")), lambda s, i: F.struct(F.lit("stop_line").alias("line_type"), i.alias("line_no"), s["name"].alias("name"), s["approach_sign"].alias("approach_sign"), s["signal"].alias("signal"), points(s["line"]).alias("poly")))
    solid = F.transform(F.coalesce("solid_lines", F.array().cast(f"array<{POLYGON}>")), lambda p, i: F.struct(F.lit("solid_line").alias("line_type"), i.alias("line_no"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("approach_sign"), F.lit(None).cast("string").alias("signal"), points(p).alias("poly")))
    return layouts.select("layout_id", F.inline(F.concat(stops, solid)))


def lamp_boxes(layouts: DataFrame) -> DataFrame:
    """layout_id, signal, lamp and its box in working pixels."""
    rows = layouts.select("layout_id", F.explode("signals").alias("signal", "lamps")).select("layout_id", "signal", F.explode("lamps").alias("lamp", "b"))
    return rows.select("layout_id", "signal", "lamp", *[F.col("b")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def moved(poly: Column, m: Column) -> Column:
    """Points under a video's map (six numbers, row by row), in single precision as drawings are kept."""
    at = lambda p, k: (m[k] * p["x"] + m[k + 1] * p["y"] + m[k + 2]).cast("float").cast("double")
    return F.transform(poly, lambda p: F.struct(at(p, 0).alias("x"), at(p, 3).alias("y")))


def placed(shapes: DataFrame, videos: DataFrame) -> DataFrame:
    """Zones or lines of the videos' layouts, in the videos' pixels. videos: video_id, layout_id, m (the map; null: as drawn)."""
    rows = videos.select("video_id", "layout_id", "m").join(shapes, "layout_id")
    return rows.withColumn("poly", F.when(F.col("m").isNull(), F.col("poly")).otherwise(moved(F.col("poly"), F.col("m")))).drop("m")


def placed_lamps(boxes: DataFrame, videos: DataFrame, scale: float = 1.0) -> DataFrame:
    """Lamp boxes in the videos' pixels: the centre is mapped, the half sizes scaled, corners rounded (half to even); `scale` leads on to full resolution."""
    rows = videos.select("video_id", "layout_id", F.coalesce("m", F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)])).alias("m")).join(boxes, "layout_id")
    m, x, y = F.col("m"), (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    grown = F.hypot(m[0], m[3])
    half = [(F.col("x2") - F.col("x1")) * grown / 2, (F.col("y2") - F.col("y1")) * grown / 2]
    at = [(m[k] * x + m[k + 1] * y + m[k + 2]).cast("float").cast("double") for k in (0, 3)]
    corner = lambda v: F.bround(F.bround(v) / scale).cast("int")
    return rows.select("video_id", "layout_id", "signal", "lamp", *[corner(v).alias(c) for c, v in (("x1", at[0] - half[0]), ("y1", at[1] - half[1]), ("x2", at[0] + half[0]), ("y2", at[1] + half[1]))])


def literal_layout(layouts: DataFrame, layout_id: str) -> Layout:
    """One layout as literals for the rules' expressions; a drawing's size."""
    [row] = layouts.where(F.col("layout_id") == layout_id).collect()
    poly = lambda p: [tuple(x) for x in p]
    polys = lambda name: [poly(p) for p in row[name] or []]
    return Layout(
        crossings=polys("crossings"), refuges=polys("refuges"), solid_lines=polys("solid_lines"), u_turn_allowed=polys("u_turn_allowed"), road_areas=polys("road_areas"),
        intersection=poly(row["intersection"]) if row["intersection"] else None,
        stop_lines=[{"name": s["name"], "a": tuple(s["line"][0]), "b": tuple(s["line"][1]), "approach_sign": s["approach_sign"], "signal": s["signal"]} for s in row["stop_lines"] or []],
        prohibited_turns=[{"from": poly(t["from"]), "to": poly(t["to"])} for t in row["prohibited_turns"] or []],
        carriageways=[{"name": c["name"], "poly": poly(c["poly"])} for c in row["carriageways"] or []],
    )


def write_prior(grid: DataFrame, votes: DataFrame, path: str) -> None:
    """A prior: cells (scene_id, r, c, visits, dwell) and votes (scene_id, r, c, b, votes), as two Parquet tables."""
    grid.write.mode("errorifexists").parquet(f"{path}/grid")
    votes.write.mode("errorifexists").parquet(f"{path}/votes")


def read_prior(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A written prior; where there is none, an empty one."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], "scene_id string, r int, c int, visits double, dwell double"), spark.createDataFrame([], "scene_id string, r int, c int, b int, votes double")
    return spark.read.parquet(f"{path}/grid"), spark.read.parquet(f"{path}/votes")
