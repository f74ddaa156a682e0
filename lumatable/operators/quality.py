"""Quality readings: references of the library and of sessions, shot scores, and explainable suggestions of what to reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatable.functions import scalars as S
from lumatable.operators.bursts import find_bursts
from lumatable.runtime import materialize

# Cut points of the rules.
BURST_BLUR, FRAME_BLUR, EYE_BLUR, DEFAULT_BLUR = 0.60, 0.08, 0.5, 60.0
HIGHLIGHTS, SHADOWS, SESSION_S, SESSION_LEAST = 0.25, 0.35, 1_800, 3
WEAK_SHARE, WEAK_LEAST, TASTE_GAP, CROP_COST = 0.10, 30, 0.5, 0.2


def upper_median(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The element at n div 2 of the ascending values: exact, from counts of values rather than a collected list."""
    return nth(df, value, lambda n: F.call_function("div", n, F.lit(2)), by, "median")


def nearest_percentile(df: DataFrame, value: str, p: float, by: list[str] | None = None, least: int = 1) -> DataFrame:
    """The element at round((n - 1) p) of the ascending values, rounding halves up; none where fewer than `least`."""
    return nth(df, value, lambda n: F.floor((n - 1) * p + 0.5), by, "percentile", least)


def nth(df: DataFrame, value: str, index, by: list[str] | None, out: str, least: int = 1) -> DataFrame:
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # values are cut at powers of two, so that a running sum over one group need not gather in one task
    part = F.when(F.col("v") > 0, F.floor(F.log2("v") * 8)).otherwise(-10_000)
    placed = counts.withColumn("part", part)
    run = placed.withColumn("upto", F.sum("n").over(Window.partitionBy(*by, "part").orderBy("v")))
    sums = placed.groupBy(*by, "part").agg(F.sum("n").alias("pn"))
    offs = sums.select(*by, "part", (F.sum("pn").over(Window.partitionBy(*by).orderBy("part")) - F.col("pn")).alias("before"), F.sum("pn").over(Window.partitionBy(*by)).alias("total"))
    ranked = run.join(offs, [*by, "part"])
    reach = F.col("before") + F.col("upto") > index(F.col("total"))
    return ranked.where(reach & (F.col("total") >= least)).groupBy(*by).agg(F.min("v").alias(out))


REFERENCE = "median_sharpness", "eye_p80", "weak_below"


def library_reference(quality: DataFrame) -> DataFrame:
    """One row: median sharpness (the upper one), p80 of eye sharpness, p10 of aesthetic where at least 30 files have it; no row of no readings."""
    long = quality.select(F.posexplode(F.array("sharpness", "eye_sharpness", "aesthetic")).alias("which", "value"))
    found = nth(long, "value", lambda n: F.when(F.col("which") == 0, F.floor(n / 2)).otherwise(F.floor((n - 1) * F.when(F.col("which") == 1, 0.8).otherwise(WEAK_SHARE) + 0.5)), ["which"], "v")
    # a value counts only where enough readings have it
    n = long.where("value is not null").groupBy("which").agg(F.count(F.lit(1)).alias("n"))
    enough = found.join(n, "which").where(f"which < 2 or n >= {WEAK_LEAST}")
    one = enough.agg(*(F.max(F.when(F.col("which") == i, F.col("v"))).alias(c) for i, c in enumerate(REFERENCE)), F.count(F.lit(1)).alias("n"))
    return one.where("n > 0").select(*REFERENCE)


def with_reference(df: DataFrame, reference: DataFrame) -> DataFrame:
    """`df` with the values of the one-row reference as constants; null where it has no row."""
    row = reference.select(*REFERENCE).first()
    return df.withColumns({c: F.lit(None if row is None else row[c]).cast("double") for c in REFERENCE})


def scores(quality: DataFrame, value: str) -> DataFrame:
    """(image_id, value) of the files that have it."""
    return quality.where(F.col(value).isNotNull()).select("image_id", F.col(value).alias("value"))


def aesthetic_rank(quality: DataFrame, value: float) -> DataFrame:
    return quality.agg(F.count_if(F.col("aesthetic") < value).alias("n_below"), F.count("aesthetic").alias("n_total"))


def potential(aesthetic: Column, crop: Column, has_crop: Column) -> Column:
    """What a photo can score: its own score, or that of its best crop less the cost of cropping."""
    return F.when(has_crop & crop.isNotNull(), F.greatest(aesthetic, crop - CROP_COST)).otherwise(aesthetic)


def crop_helps(aesthetic: Column, crop: Column, has_crop: Column) -> Column:
    return F.coalesce(has_crop & (crop - CROP_COST > aesthetic), F.lit(False))


VALUES = ["sharpness", "eye_sharpness", "clip_highlights", "clip_shadows", "aesthetic", "aesthetic_crop", "has_crop"]


def shot_scores(files: DataFrame, quality: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row for each shot (or other grouping `by`): its earliest file's moment, id and camera, whether any file is flagged, and the
    reading of its sharpest file, the last of equally sharp ones."""
    by = by or ["shot_key"]
    joined = files.join(quality.withColumnRenamed("image_id", "id"), "id", "left")
    best = F.max_by(F.struct(*VALUES), F.when(F.col("sharpness").isNotNull(), F.struct("sharpness", "created_at", "id"))).alias("q")
    first = F.min_by(F.struct("created_at", "id", "camera"), F.struct(F.col("created_at").isNull(), "created_at", "id")).alias("f")
    flagged = F.bool_or(F.coalesce("flagged", F.lit(0)) != 0).alias("is_flagged")
    return joined.groupBy(*by).agg(first, flagged, best).select(*by, "f.created_at", F.col("f.id").alias("first_id"), "f.camera", "is_flagged", *(f"q.{v}" for v in VALUES))


def session_eyes(asked: DataFrame, shots: DataFrame, key: str) -> DataFrame:
    """(key, session_eye) of rows asked (key, created_at, camera): the p80 of eye sharpness of the camera's shots within half an hour,
    where at least three have it. Rows meet the shots of their own and the neighbouring half hours only, so one camera's shots
    spread over many tasks; what is collected is bounded by a camera's shots in a half hour."""
    cam = F.coalesce("camera", F.lit(""))
    near = shots.where("eye_sharpness is not null and created_at is not null").select(cam.alias("cam"), F.floor(F.col("created_at") / SESSION_S).alias("slot"), F.col("created_at").alias("t2"), "eye_sharpness")
    slots = near.groupBy("cam", "slot").agg(F.collect_list(F.struct("t2", "eye_sharpness")).alias("seen"))
    rows = asked.where("created_at is not null").select(key, cam.alias("cam"), F.col("created_at").alias("t1"))
    spread = rows.withColumn("slot", F.explode(F.array(*(F.floor(F.col("t1") / SESSION_S) + k for k in (-1, 0, 1)))))
    hits = spread.join(slots, ["cam", "slot"]).select(key, F.transform(F.filter("seen", lambda x: F.abs(x["t2"] - F.col("t1")) <= SESSION_S), lambda x: x["eye_sharpness"]).alias("e"))
    values = hits.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("e"))).alias("e"))
    at = F.floor((F.size("e") - 1) * 0.8 + 0.5).cast("int") + 1
    return values.select(key, F.when(F.size("e") >= SESSION_LEAST, F.element_at("e", at)).alias("session_eye"))


def suggestions(files: DataFrame, quality: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """(id, reason, ticked) of every file of each shot to reject; `files` have id, created_at, camera, shot_key, flagged.

    In bursts: blurred beside the best, else burnt highlights, else less liked than the keeper by half a point (not ticked). Outside:
    eyes against the session's or the library's, sharpness against the library's, highlights, shadows, then weak taste (not
    ticked). Shots with any flag are never suggested, but still count as a burst's reference. An undated shot has no eye reference.
    """
    files, quality = materialize(files, "files"), materialize(quality, "quality")
    reference = library_reference(quality) if reference is None else reference
    bursts = materialize(find_bursts(files.select("id", "created_at", "camera", "shot_key")), "bursts")
    parts_of = files.join(bursts, "id", "left").withColumn("part", F.concat_ws("#", "shot_key", F.col("burst_id").cast("string")))
    s = materialize(shot_scores(parts_of, quality, ["part", "burst_id"]).where("sharpness is not null"), "parts")
    s = with_reference(s.join(session_eyes(s, shot_scores(files, quality), "part"), "part", "left"), reference)
    s = s.withColumn("potential", potential(F.col("aesthetic"), F.col("aesthetic_crop"), F.coalesce("has_crop", F.lit(False))))
    s = materialize(s, "scored")
    b = Window.partitionBy("burst_id")  # the shots of one burst; rows outside bursts are judged apart
    inside = s.where("burst_id is not null").withColumn("value", F.when(F.bool_and(F.col("eye_sharpness").isNotNull()).over(b), F.col("eye_sharpness")).otherwise(F.col("sharpness")))
    inside = inside.withColumn("best", F.max("value").over(b))
    not_best = F.col("value") < F.col("best")
    inside = inside.withColumn("fault", F.when(not_best & (F.col("value") < BURST_BLUR * F.col("best")), "blurred").when(not_best & (F.col("clip_highlights") > HIGHLIGHTS), "highlights"))
    sound = F.col("fault").isNull()
    liked = (F.count_if(sound).over(b) >= 2) & (F.count_if(sound & F.col("aesthetic").isNull()).over(b) == 0)
    top = F.max(F.when(sound, F.struct("aesthetic", "created_at", "first_id"))).over(b)
    inside = inside.withColumns({"liked": liked, "top": top})
    less = F.col("liked") & sound & (F.col("first_id") != F.col("top.first_id")) & (F.col("potential") < F.col("top.aesthetic") - TASTE_GAP)
    inside = inside.withColumn("reason", F.coalesce("fault", F.when(less, "less liked")))
    eye_ref = F.when(F.col("created_at").isNotNull(), F.coalesce("session_eye", "eye_p80"))
    blur_below = F.coalesce(FRAME_BLUR * F.col("median_sharpness"), F.lit(DEFAULT_BLUR))
    outside = s.where("burst_id is null").withColumn(
        "reason",
        F.when((eye_ref > 0) & (F.col("eye_sharpness") < EYE_BLUR * eye_ref), "eyes blurred")
        .when(F.col("sharpness") < blur_below, "blurred")
        .when(F.col("clip_highlights") > HIGHLIGHTS, "highlights")
        .when(F.col("clip_shadows") > SHADOWS, "shadows")
        .when(F.col("potential") < F.col("weak_below"), "weak"),
    )
    judged = inside.select("part", "reason", "is_flagged").unionByName(outside.select("part", "reason", "is_flagged")).where("reason is not null and not is_flagged")
    return parts_of.select("id", "part").join(judged, "part").select("id", "reason", (~F.col("reason").isin("less liked", "weak")).alias("ticked"))


def keepers(files: DataFrame, quality: DataFrame) -> DataFrame:
    """(burst_id, first_id) of each burst's shot to keep: the best liked of at least two sound ones that all have a score, else the first sharpest."""
    files = materialize(files, "files")
    bursts = materialize(find_bursts(files.select("id", "created_at", "camera", "shot_key")), "bursts")
    s = shot_scores(files.join(bursts, "id"), quality, ["burst_id", "shot_key"]).where("sharpness is not null")
    b = Window.partitionBy("burst_id")
    s = s.withColumn("value", F.when(F.bool_and(F.col("eye_sharpness").isNotNull()).over(b), F.col("eye_sharpness")).otherwise(F.col("sharpness"))).withColumn("best", F.max("value").over(b))
    not_best = F.col("value") < F.col("best")
    s = s.withColumn("sound", ~(not_best & ((F.col("value") < BURST_BLUR * F.col("best")) | F.coalesce(F.col("clip_highlights") > HIGHLIGHTS, F.lit(False)))))
    g = s.groupBy("burst_id").agg(
        F.count_if("sound").alias("n"), F.count_if(F.col("sound") & F.col("aesthetic").isNull()).alias("unscored"), F.max_by("first_id", F.when(F.col("sound"), F.struct("aesthetic", "created_at", "first_id"))).alias("liked"), F.min_by("first_id", F.struct(-F.col("value"), "created_at", "first_id")).alias("sharpest")
    )
    return g.select("burst_id", F.when((F.col("n") >= 2) & (F.col("unscored") == 0), F.col("liked")).otherwise(F.col("sharpest")).alias("first_id"))


def files_to_score(files: DataFrame) -> DataFrame:
    """One file of each shot: the first that is not raw, else the first."""
    return files.groupBy("shot_key").agg(F.min(F.struct(S.is_raw(F.col("format")).alias("raw"), F.col("id").alias("id"))).alias("f")).select("shot_key", F.col("f.id").alias("id"))


def needs_crop_check(files: DataFrame, quality: DataFrame, suggested: DataFrame) -> DataFrame:
    """Ids of the files to check for a better crop: those suggested by taste whose best file has no crop reading yet."""
    taste = suggested.where(~F.col("ticked")).join(files.select("id", "shot_key"), "id").select("shot_key").distinct()
    best = files.join(quality.withColumnRenamed("image_id", "id"), "id").groupBy("shot_key").agg(F.max_by(F.struct("id", "aesthetic_crop"), F.struct("sharpness", "created_at", "id")).alias("b"))
    return best.join(taste, "shot_key", "left_semi").where("b.aesthetic_crop is null").select("b.id")


def readings(files: DataFrame, quality: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, percent, grade): each file's sharpness against the library's median, taken from another file of the shot if it has none."""
    q = quality.select(F.col("image_id").alias("id"), "sharpness")
    of_shot = F.first("sharpness", ignorenulls=True).over(Window.partitionBy("shot_key").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = files.select("id", "shot_key").join(q, "id", "left").withColumn("value", F.coalesce(F.col("sharpness"), of_shot))
    percent = S.percent_of(F.col("value"), F.col("median_sharpness"))
    return with_reference(own, reference).select("id", percent.alias("percent"), S.grade(percent, eyes=False).alias("grade"))


def session_readings(files: DataFrame, quality: DataFrame, reference: DataFrame, suggested: DataFrame | None = None) -> DataFrame:
    """(id, percent, by_eyes, in_session, grade) of each scored file: its eyes against the session's sharp shots, else the library's, and
    without eyes its frame against the library's median.

    The session is the camera's files within half an hour; each shot counts once, with its best eyes, and at least three must have
    them. `suggested` (id, ticked) makes a file with a ticked suggestion Bad, at 5 percent where there is nothing to compare with.
    """
    q = quality.select(F.col("image_id").alias("id"), "sharpness", "eye_sharpness")
    own = materialize(files.select("id", "created_at", "camera", "shot_key").join(q, "id"), "scored-files")
    cam = F.coalesce("camera", F.lit(""))
    near = own.where("eye_sharpness is not null and created_at is not null").groupBy(cam.alias("cam"), "shot_key", "created_at").agg(F.max("eye_sharpness").alias("eye"))
    slots = near.groupBy("cam", F.floor(F.col("created_at") / SESSION_S).alias("slot")).agg(F.collect_list(F.struct(F.col("created_at").alias("t2"), "shot_key", "eye")).alias("seen"))
    asked = own.where("created_at is not null").select(cam.alias("cam"), F.col("created_at").alias("t1")).distinct()
    spread = asked.withColumn("slot", F.explode(F.array(*(F.floor(F.col("t1") / SESSION_S) + k for k in (-1, 0, 1)))))
    hits = spread.join(slots, ["cam", "slot"]).select("cam", "t1", F.explode(F.filter("seen", lambda x: F.abs(x["t2"] - F.col("t1")) <= SESSION_S)).alias("x"))
    eyes = hits.groupBy("cam", "t1", "x.shot_key").agg(F.max("x.eye").alias("eye")).groupBy("cam", "t1").agg(F.sort_array(F.collect_list("eye")).alias("e"))
    at = F.floor((F.size("e") - 1) * 0.8 + 0.5).cast("int") + 1
    refs = eyes.select("cam", F.col("t1").alias("created_at"), F.when(F.size("e") >= SESSION_LEAST, F.element_at("e", at)).alias("session_eye"))
    j = with_reference(own.withColumn("cam", cam).join(refs, ["cam", "created_at"], "left"), reference)
    eye_ref = F.coalesce("session_eye", "eye_p80")
    by_eyes = F.col("eye_sharpness").isNotNull() & F.coalesce(eye_ref > 0, F.lit(False))
    percent = F.when(by_eyes, F.col("eye_sharpness") / eye_ref * 100).when(F.col("median_sharpness") > 0, F.col("sharpness") / F.col("median_sharpness") * 100)
    out = j.select("id", percent.alias("percent"), by_eyes.alias("by_eyes"), (by_eyes & F.col("session_eye").isNotNull()).alias("in_session"))
    graded = F.when(F.col("by_eyes"), S.grade(F.col("percent"))).otherwise(S.grade(F.col("percent"), eyes=False))
    if suggested is None:
        return out.withColumn("grade", graded)
    bad = suggested.where("ticked").select("id", F.lit(True).alias("bad")).distinct()
    return out.join(bad, "id", "left").withColumns({"grade": F.when(F.col("bad"), "Bad").otherwise(graded), "percent": F.coalesce("percent", F.when(F.col("bad"), 5.0))}).drop("bad")


def rejects_view(files: DataFrame, quality: DataFrame) -> DataFrame:
    """(id, reason, ticked): why each rejected file would have been suggested, had nothing been rejected yet."""
    before = files.withColumn("flagged", F.when(F.col("flagged") == -1, 0).otherwise(F.col("flagged")))
    rejected = files.where("flagged = -1").select("id").distinct()
    return suggestions(before, quality).join(rejected, "id", "left_semi")


def review_rejects(files: DataFrame, scores: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, reason) of files not yet imported that look like faults: the same rules without model outputs, ticked ones only."""
    found = suggestions(files, new_rows(scores, 0).select("image_id", *(c for c in VALUES if c != "has_crop"), F.lit(False).alias("has_crop")), reference)
    return found.where("ticked").select("id", "reason")


def reject_count(suggested: DataFrame) -> DataFrame:
    return suggested.agg(F.countDistinct("id").alias("n"))


def new_rows(scores: DataFrame, computed_at: int) -> DataFrame:
    """Rows of the quality table from computed scores (id and its readings); what models add is null."""
    values = ["sharpness", "sharpness_global", "clip_shadows", "clip_highlights", "mean_luma", "quality_version"]
    models = {"faces": "int", "eye_sharpness": "double", "aesthetic": "double", "aesthetic_crop": "double", "crop_x": "double", "crop_y": "double", "crop_w": "double", "crop_h": "double"}
    return scores.select(F.col("id").alias("image_id"), *values, F.lit(computed_at).cast("bigint").alias("computed_at"), *(F.lit(None).cast(t).alias(c) for c, t in models.items()))


def final_rejects(rejected: DataFrame, restored: DataFrame, chosen: DataFrame) -> DataFrame:
    """Ids rejected once the choices are saved: those rejected before without the restored ones, and the chosen, each once, in order."""
    ids = lambda df: df.select("id")
    return ids(rejected).subtract(ids(restored)).union(ids(chosen)).distinct().orderBy("id")


def apply_choices(images: DataFrame, reject: DataFrame, restore: DataFrame) -> DataFrame:
    """Images after saving the choices: rejects are flagged -1, restored ones lose their flag; a file in both is rejected."""
    mark = lambda df, name: df.select("id", F.lit(True).alias(name)).distinct()
    j = images.join(mark(reject, "__reject"), "id", "left").join(mark(restore, "__restore"), "id", "left")
    return j.withColumn("flagged", F.when(F.col("__reject"), -1).when(F.col("__restore"), 0).otherwise(F.col("flagged"))).select(*images.columns)
