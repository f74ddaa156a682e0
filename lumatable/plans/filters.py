"""The filter language: timeline filters, prefixed search text, and saved JSON queries, turned into predicates and semi-joins."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumatable.functions import scalars as S

TEXT_COLUMNS = ["filename", "camera_make", "camera_model", "lens_model", "title", "description"]


@dataclass(frozen=True)
class Tables:
    """What filters look at besides the images; tables not needed may stay None."""

    tags: DataFrame | None = None
    image_tags: DataFrame | None = None
    album_images: DataFrame | None = None
    ranges: DataFrame | None = None
    quality: DataFrame | None = None
    smart_collections: DataFrame | None = None


@dataclass
class SmartQuery:
    """A saved query. Unknown keys in its JSON are ignored, missing ones mean no restriction."""

    text: str | None = None
    min_rating: int | None = None
    flag: int | None = None
    exclude_rejected: bool = False
    color: int | None = None
    date_range: tuple[int, int] | None = None
    camera: str | None = None
    lens: str | None = None
    tags: list[str] = field(default_factory=list)
    not_tags: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> SmartQuery:
        """Raises ValueError where the text is no JSON object."""
        raw = json.loads(text)
        if not isinstance(raw, dict):
            raise ValueError("a saved query must be an object")
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in raw.items() if k in known and v is not None})

    def describe(self) -> str:
        parts = [f"“{self.text}”" if self.text else "", f"≥ {self.min_rating} stars" if self.min_rating else "", {1: "picks", -1: "rejects"}.get(self.flag or 0, ""), "not rejected" if self.exclude_rejected else "", S.COLORS[self.color] if self.color else "", self.camera or "", self.lens or "", *self.tags, *(f"not {t}" for t in self.not_tags)]
        return " · ".join(p for p in parts if p)

    def condition(self) -> Column:
        """Whether an image is visible and meets the parts that need no other table, all but tags and text."""
        c = S.visible()
        if self.min_rating:
            c &= F.coalesce("rating", F.lit(0)) >= self.min_rating
        if self.flag is not None:
            c &= F.col("flagged") == self.flag
        if self.exclude_rejected:
            c &= F.coalesce("flagged", F.lit(0)) != -1
        if self.color:
            c &= F.col("color_label") == self.color
        if self.date_range:
            c &= F.col("created_at").between(*self.date_range)
        if self.camera:
            c &= F.col("camera_model").ilike(f"%{self.camera}%") | F.col("camera_make").ilike(f"%{self.camera}%")
        if self.lens:
            c &= F.col("lens_model").ilike(f"%{self.lens}%")
        return c

    def apply(self, images: DataFrame, t: Tables) -> DataFrame:
        """Visible images that meet every part; tags match whole names without regard to case, and not their descendants."""
        out = images.where(self.condition())
        for name in self.tags:
            out = out.join(tagged(t, F.lower("name") == name.lower()), "id", "left_semi")
        for name in self.not_tags:
            out = out.join(tagged(t, F.lower("name") == name.lower()), "id", "left_anti")
        return free_text(out, self.text, t) if self.text else out


def tagged(t: Tables, condition: Column) -> DataFrame:
    """Ids of images with a tag that meets the condition."""
    return t.image_tags.join(t.tags.where(condition).select(F.col("id").alias("tag_id")), "tag_id", "left_semi").select(F.col("image_id").alias("id")).distinct()


def free_text(images: DataFrame, text: str, t: Tables) -> DataFrame:
    """Images whose text columns hold every word as a prefix, or that have a tag whose name holds the text."""
    by_tag = tagged(t, F.col("name").ilike(f"%{text}%")).withColumn("__tagged", F.lit(True))
    return images.join(by_tag, "id", "left").where(S.matches_text(text, TEXT_COLUMNS) | F.coalesce("__tagged", F.lit(False))).drop("__tagged")


def search(images: DataFrame, text: str, t: Tables) -> DataFrame:
    """Prefixed search: tag:, camera:, make:, lens:, is:, label:, color:, else free text."""
    prefix, _, rest = text.partition(":")
    rest = rest.strip()
    match prefix.lower():
        case "tag":
            return images.join(tagged(t, F.col("name").ilike(f"%{rest}%")), "id", "left_semi")
        case "camera" | "make":
            return images.where(F.col("camera_make").ilike(f"%{rest}%") | F.col("camera_model").ilike(f"%{rest}%"))
        case "lens":
            return images.where(F.col("lens_model").ilike(f"%{rest}%"))
        case "is":
            return images.where(F.coalesce("flagged", F.lit(0)) == {"pick": 1, "picked": 1, "reject": -1, "rejected": -1}.get(rest.lower(), 0))
        case "label" | "color":
            return images.where(F.coalesce("color_label", F.lit(0)) == (S.COLORS.index(rest.lower()) if rest.lower() in S.COLORS else 0))
    return free_text(images, text, t)


@dataclass(frozen=True)
class View:
    """What a timeline shows: one kind of filter with its value, and extra conditions. Rating: an int for at least, 0 for unrated."""

    kind: str = "all"
    value: object = None
    rating: int | None = None
    flag: int | None = None
    color: int | None = None

    def apply(self, images: DataFrame, t: Tables = Tables()) -> DataFrame:
        out = images.where(S.visible())
        if self.rating is not None:
            out = out.where(F.col("rating") >= self.rating if self.rating > 0 else F.col("rating").isNull() | (F.col("rating") == 0))
        if self.flag is not None:
            out = out.where(F.col("flagged") == self.flag)
        if self.color:  # no colour chosen means no filter
            out = out.where(F.col("color_label") == self.color)
        match self.kind:
            case "all":
                return out
            case "day":
                y, m, d = self.value
                return out.where((F.col("year") == y) & (F.col("month") == m) & (F.col("day") == d))
            case "search":
                return search(out, self.value, t)
            case "tag":
                from lumatable.operators.tags import images_under

                return out.join(images_under(t.tags, t.image_tags, self.value).withColumnRenamed("image_id", "id"), "id", "left_semi")
            case "album":
                return out.join(t.album_images.where(F.col("album_id") == self.value).select(F.col("image_id").alias("id")), "id", "left_semi")
            case "range":
                one = F.broadcast(t.ranges.where(F.col("range_id") == self.value).select("start_date", "end_date").limit(1))  # one row
                return out.join(one, F.col("created_at").between(F.col("start_date"), F.col("end_date")), "left_semi")
            case "smart":
                saved = t.smart_collections.where(F.col("id") == self.value).select("query_json").limit(1).collect()  # one row
                return SmartQuery.parse(saved[0].query_json).apply(out, t) if saved else out.where(F.lit(False))
            case "color":
                return out.where(F.col("color_label") == self.value if self.value else F.col("color_label").isNull() | (F.col("color_label") == 0))
            case "missing":
                return out.where("missing")
            case "blurred":
                return out.join(t.quality.where(F.col("sharpness") <= self.value).select(F.col("image_id").alias("id")), "id", "left_semi")
        raise ValueError(f"unknown filter {self.kind}")
