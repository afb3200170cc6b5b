"""Event rules: each takes a Context of DataFrames and gives raw events (video_id, start, end, label, tids)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import scene as S
from kerbside.operators.sequences import finalize
from kerbside.session import settled

Polygon = list[tuple[float, float]]
EVENT = "video_id string, start double, end double, label string, tids array<bigint>"


@dataclass(frozen=True)
class Layout:
    """Zones drawn by hand on the scene; each may be absent. Its size is a drawing's, so zones are literals in plans."""

    crossings: list[Polygon] = field(default_factory=list)
    refuges: list[Polygon] = field(default_factory=list)
    stop_lines: list[dict] = field(default_factory=list)  # name, a, b, approach_sign, signal
    solid_lines: list[Polygon] = field(default_factory=list)
    u_turn_allowed: list[Polygon] = field(default_factory=list)
    intersection: Polygon | None = None
    prohibited_turns: list[dict] = field(default_factory=list)  # from, to
    carriageways: list[dict] = field(default_factory=list)  # name, poly
    road_areas: list[Polygon] = field(default_factory=list)


@dataclass(frozen=True)
class Context:
    """What rules see: observations, videos, and tables derived from them once."""

    obs: DataFrame  # of operators.kinematics.observations, usable tracks
    videos: DataFrame  # video_id, duration
    layout: Layout = Layout()
    prior: tuple[DataFrame, DataFrame] | None = None  # grid and heading votes in place of the video's own
    signals: DataFrame | None = None  # video_id, signal, t, red
    fire: tuple[DataFrame, DataFrame] | None = None  # samples (video_id, t), boxes (video_id, t, x1, y1, x2, y2, conf, cls)
    pixels: tuple[DataFrame, int, int] | None = None  # thumbnails (video_id, t, px, py, gray) at 1 Hz, their width and height
    width: float = 1280.0
    height: float = 720.0

    @property
    def spark(self) -> SparkSession:
        return self.obs.sparkSession

    @cached_property
    def cells(self) -> DataFrame:
        return S.with_cells(self.obs, self.width, self.height)

    @cached_property
    def vehicles(self) -> DataFrame:
        return self.cells.where("is_vehicle")

    @cached_property
    def people(self) -> DataFrame:
        return self.cells.where("kind = 'person'")

    @cached_property
    def grid(self) -> DataFrame:
        return self.prior[0] if self.prior else S.grid(self.vehicles)

    @cached_property
    def votes(self) -> DataFrame:
        return self.prior[1] if self.prior else S.heading_votes(self.vehicles)

    @cached_property
    def conflicts(self) -> DataFrame:
        """Aligned samples of the pairs that come near each other: made once for the rules on pairs, and written to the checkpoint folder."""
        from kerbside.rules.conflicts import conflict_series

        return settled(conflict_series(self))

    def release(self) -> None:
        if "conflicts" in self.__dict__:
            self.__dict__.pop("conflicts")

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], EVENT)


Rule = Callable[[Context], DataFrame]
RULES: dict[str, Rule] = {}


def rule(label: str) -> Callable[[Rule], Rule]:
    def register(f: Rule) -> Rule:
        RULES[label] = f
        return f

    return register


def events(df: DataFrame, label: str, tids=None) -> DataFrame:
    tids = tids if tids is not None else F.array(F.col("tid").cast("bigint"))
    return df.select("video_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.lit(label).alias("label"), tids.alias("tids"))


def run_rules(ctx: Context, enabled: list[str] | None = None, failed: dict[str, Exception] | None = None) -> DataFrame:
    """Final events of the enabled rules; only their plans are built. A rule whose plan can't be built is left out and noted in `failed`."""
    from kerbside.rules import conflicts, crossing, flow, junction, pedestrians, stationary  # noqa: F401  they register their rules

    parts = []
    for label in enabled if enabled is not None else sorted(RULES):
        try:
            parts.append(RULES[label](ctx))
        except Exception as error:  # one rule's failure must not cost the others
            if failed is None:
                raise
            failed[label] = error
    raw = reduce(DataFrame.unionByName, parts) if parts else ctx.empty()
    return finalize(raw, ctx.videos)
