"""Queries of the core operators by name, and their SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatable.functions import scalars as S
from lumatable.operators import arrays, bursts, edits, hierarchy, ingest, quality, ranges, records, sessions, sidecars, spatial, tags, timeline, timestamps
from lumatable.plans import catalog as C
from lumatable.plans.filters import SmartQuery, Tables, View, tagged
from lumatable.runtime import table

QUERIES: dict = {
    "p1_found": timestamps.found,
    "p1_status": timestamps.status,
    "p3_found": sessions.found,
    "p3_replayed": sessions.replayed,
    "p4_found": hierarchy.found,
    "p4_descendants": hierarchy.descendant_pairs,
    "p7_found": spatial.found,
    "p7_by_cells": spatial.by_cells,
    "p7_near": spatial.near_counts,
}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ("img",)):
    """Register a query, with its SQL over the relations it uses (img, q, tg, it, rg, al)."""
    preludes = {"img": C.IMAGES_SQL, "q": C.QUALITY_SQL, "tg": C.TAGS_SQL, "it": C.IMAGE_TAGS_SQL, "rg": C.RANGES_SQL, "al": C.ALBUMS_SQL}

    def register(f):
        QUERIES[name] = f
        if sql:
            # relations of its own follow those it uses
            head, own = ", ".join(preludes[u] for u in uses), sql.lstrip().upper().startswith("SELECT")
            SQL[name] = f"WITH RECURSIVE {head}{', ' if head and not own else ''} {sql}" if head or not own else sql
        return f

    return register


SAVED = ((1, '{"min_rating": 4, "exclude_rejected": true}'), (2, '{"camera": "corvane", "flag": 1, "unknown": 3}'))


def tables(spark: SparkSession, d: str, kind: str = "") -> Tables:
    """What a kind of view looks at besides the images."""
    need = {"tag": "t", "search": "t", "album": "a", "range": "r", "blurred": "q", "smart": "ts"}.get(kind, "")
    saved = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}L, '{j}')" for i, j in SAVED) + " t(id, query_json)") if "s" in need else None
    return Tables(
        C.tags(spark, d) if "t" in need else None, C.image_tags(spark, d) if "t" in need else None, C.album_images(C.image_rows(spark, d)).distinct() if "a" in need else None,
        C.ranges(spark) if "r" in need else None, C.quality(spark, d) if "q" in need else None, saved,
    )


TILE = ["id", "filename", "format", "rating", "flagged", "color_label", "moment", "first_id", "versions", "has_raw_version", "is_edited", "has_xcf"]


def tiles(view: View):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return timeline.in_order(timeline.collapse(view.apply(C.image_rows(spark, d), tables(spark, d, view.kind)))).select(*TILE)

    return run


def tiles_sql(condition: str = "true", extra: str = "") -> str:
    return f"""
f AS (SELECT *, coalesce(created_at, imported_at) AS moment, coalesce(format LIKE 'RAW%', false) AS raw FROM img WHERE NOT coalesce(hidden, false) AND {condition}),
r AS (SELECT *, row_number() OVER (PARTITION BY shot_key ORDER BY raw, moment DESC NULLS LAST, id DESC) AS cover, row_number() OVER (PARTITION BY shot_key ORDER BY moment DESC NULLS LAST, id DESC) AS place,
  count(*) OVER (PARTITION BY shot_key) AS versions, bool_or(raw) OVER (PARTITION BY shot_key) AS any_raw, bool_or(coalesce(edited, false)) OVER (PARTITION BY shot_key) AS is_edited, bool_or(coalesce(has_xcf, false)) OVER (PARTITION BY shot_key) AS any_xcf FROM f)
SELECT c.id, c.filename, c.format, c.rating, c.flagged, c.color_label, p.moment, p.id AS first_id, c.versions, c.any_raw AND NOT c.raw AS has_raw_version, c.is_edited, c.any_xcf AS has_xcf
FROM r c JOIN r p ON c.shot_key = p.shot_key WHERE c.cover = 1 AND p.place = 1"""


_LIKE = lambda c, x: f"lower({c}) LIKE '%{x}%'"
_TAGGED = lambda cond: f"id IN (SELECT image_id FROM it JOIN tg ON tg.id = it.tag_id WHERE {cond})"
for _name, _view, _cond, _uses in (
    ("timeline_all", View(), "true", ("img",)),
    ("timeline_picks", View(rating=3, flag=1), "rating >= 3 AND flagged = 1", ("img",)),
    ("timeline_unrated", View(rating=0), "coalesce(rating, 0) = 0", ("img",)),
    ("timeline_color", View("color", 2), "coalesce(color_label, 0) = 2", ("img",)),
    ("timeline_day", View("day", (2012, 2, 6)), "year = 2012 AND month = 2 AND day = 6", ("img",)),
    ("timeline_missing", View("missing"), "missing", ("img",)),
    ("timeline_album", View("album", 2), "id IN (SELECT image_id FROM ai WHERE album_id = 2)", ("img", "al")),
    ("timeline_range", View("range", 3), "created_at BETWEEN 1451606400 AND 1483228799", ("img",)),
    ("timeline_blurred", View("blurred", 60.0), "id IN (SELECT image_id FROM q WHERE sharpness <= 60)", ("img", "q")),
    ("timeline_smart", View("smart", 1), "coalesce(rating, 0) >= 4 AND coalesce(flagged, 0) <> -1", ("img",)),
    ("search_tag", View("search", "tag:portraits"), _TAGGED(_LIKE("name", "portraits")), ("img", "tg", "it")),
    ("search_camera", View("search", "camera:corvane"), f"({_LIKE('camera_make', 'corvane')} OR {_LIKE('camera_model', 'corvane')})", ("img",)),
    ("search_lens", View("search", "lens:macro"), _LIKE("lens_model", "macro"), ("img",)),
    ("search_is", View("search", "is:pick"), "coalesce(flagged, 0) = 1", ("img",)),
    ("search_label", View("search", "label:green"), "coalesce(color_label, 0) = 3", ("img",)),
    ("search_text", View("search", "harbour wind"), "true", ("img", "tg", "it")),
    ("timeline_tag", View("tag", "Places|Amber bridges"), "true", ("img", "tg", "it")),
):
    _sql = tiles_sql(_cond)
    if _name == "timeline_tag":
        _sql = "below(id) AS (SELECT id FROM tg WHERE lower(name) = 'amber bridges' UNION SELECT tg.id FROM tg JOIN below ON tg.parent_id = below.id), " + tiles_sql("id IN (SELECT image_id FROM it WHERE tag_id IN (SELECT id FROM below))")
    if _name == "search_text":
        _norm = lambda c: f"(' ' || regexp_replace(lower(strip_accents(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        _words = " AND ".join("(" + " OR ".join(f"contains({_norm(c)}, ' {w}')" for c in ("filename", "camera_make", "camera_model", "lens_model", "title", "description")) + ")" for w in ("harbour", "wind"))
        _sql = tiles_sql(f"(({_words}) OR {_TAGGED(_LIKE('name', 'harbour wind'))})")
    query(_name, _sql, _uses)(tiles(_view))


@query("date_tree", "SELECT year, month, day, count(DISTINCT shot_key) AS n_shots FROM img WHERE NOT coalesce(hidden, false) AND year > 0 GROUP BY year, month, day")
def _(s, d):
    return timeline.date_tree(C.image_rows(s, d))


@query("years", "SELECT year, count(DISTINCT shot_key) AS n_shots FROM img WHERE year IS NOT NULL GROUP BY year")
def _(s, d):
    return timeline.calendar(C.image_rows(s, d), ["year"])


@query("months", "SELECT year, month, count(DISTINCT shot_key) AS n_shots FROM img WHERE year IS NOT NULL GROUP BY year, month")
def _(s, d):
    return timeline.calendar(C.image_rows(s, d), ["year", "month"])


@query("sidebar_totals", "dt AS (SELECT year, month, day, count(DISTINCT shot_key) AS n FROM img WHERE NOT coalesce(hidden, false) AND year > 0 GROUP BY year, month, day) SELECT year, month, sum(n)::BIGINT AS n_shots FROM dt GROUP BY year, month UNION ALL SELECT year, NULL, sum(n)::BIGINT FROM dt GROUP BY year")
def _(s, d):
    return timeline.sidebar_totals(C.image_rows(s, d))


@query("month_covers", "SELECT year, month, count(*) AS n_files, first(id ORDER BY created_at, id) AS cover_id FROM img WHERE created_at IS NOT NULL GROUP BY year, month")
def _(s, d):
    return timeline.covers(C.images(s, d), ["year", "month"])


@query("day_covers", "SELECT year, month, day, count(*) AS n_files, first(id ORDER BY created_at, id) AS cover_id FROM img WHERE created_at IS NOT NULL GROUP BY year, month, day")
def _(s, d):
    return timeline.covers(C.images(s, d), ["year", "month", "day"])


@query("sections", "t AS (SELECT shot_key, max(coalesce(created_at, imported_at)) AS moment FROM img WHERE NOT coalesce(hidden, false) GROUP BY shot_key) SELECT CAST(floor(moment / 86400) AS BIGINT) AS day_number, count(*) AS n_tiles FROM t GROUP BY 1")
def _(s, d):
    return timeline.sections(timeline.collapse(View().apply(C.image_rows(s, d))))


@query("justified_rows")
def _(s, d):
    return timeline.justify(timeline.collapse(View().apply(C.image_rows(s, d))), 1600.0, 220.0)


@query("image_count", "SELECT count(*) AS n FROM img")
def _(s, d):
    return C.images(s, d).agg(F.count(F.lit(1)).alias("n"))


@query("disagreeing_shots", "SELECT group_hash FROM img WHERE group_hash IS NOT NULL GROUP BY group_hash HAVING count(DISTINCT rating) > 1 OR count(DISTINCT flagged) > 1 OR count(DISTINCT color_label) > 1")
def _(s, d):
    return timeline.disagreeing_shots(C.image_rows(s, d))


@query("in_session", "SELECT id, created_at FROM img WHERE camera_model IS NOT DISTINCT FROM 'Corvane X20' AND created_at BETWEEN 1325376000 AND 1420070400")
def _(s, d):
    return timeline.in_session(C.images(s, d), "Corvane X20", 1_325_376_000, 1_420_070_400).select("id", "created_at")


@query("unscored", "z AS (SELECT DISTINCT image_id FROM q WHERE faces IS NOT NULL AND aesthetic IS NOT NULL) SELECT id FROM img WHERE NOT coalesce(format LIKE 'VIDEO%', false) AND NOT coalesce(missing, false) AND NOT coalesce(hidden, false) AND id NOT IN (SELECT image_id FROM z)", ("img", "q"))
def _(s, d):
    return timeline.unscored(C.images(s, d), C.quality(s, d).withColumn("quality_version", F.lit(2)), 2, True, True).select("id")


@query("picked_versions", "m AS (SELECT *, coalesce(flagged = 1, false) AS selected, coalesce(format LIKE 'RAW%', false) AS fits FROM img), w AS (SELECT *, bool_or(selected) OVER (PARTITION BY shot_key) AS a, bool_or(fits) OVER (PARTITION BY shot_key) AS b FROM m) SELECT id FROM w WHERE a AND CASE WHEN b THEN fits ELSE selected END")
def _(s, d):
    return timeline.pick_versions(C.images(s, d).withColumn("selected", F.coalesce(F.col("flagged") == 1, F.lit(False))), "raw").select("id")


@query("smart_counts", "SELECT 1::BIGINT AS query_id, count(DISTINCT shot_key) AS n_shots FROM img WHERE NOT coalesce(hidden, false) AND coalesce(rating, 0) >= 4 AND coalesce(flagged, 0) <> -1 UNION ALL SELECT 2, count(DISTINCT shot_key) FROM img WHERE NOT coalesce(hidden, false) AND flagged = 1 AND (lower(camera_model) LIKE '%corvane%' OR lower(camera_make) LIKE '%corvane%')")
def _(s, d):
    saved = s.sql("SELECT * FROM VALUES " + ", ".join(f"({i}L, '{j}')" for i, j in SAVED) + " t(id, query_json)")
    return records.counts_of_saved(saved, C.image_rows(s, d), Tables())


@query("smart_tags", "SELECT id FROM img WHERE NOT coalesce(hidden, false) AND coalesce(rating, 0) >= 1 AND id IN (SELECT image_id FROM it JOIN tg ON tg.id = it.tag_id WHERE lower(name) LIKE 'snow walk%') AND id NOT IN (SELECT image_id FROM it JOIN tg ON tg.id = it.tag_id WHERE lower(name) LIKE 'red%')", ("img", "tg", "it"))
def _(s, d):
    t = tables(s, d, "smart")
    base = SmartQuery(min_rating=1).apply(C.image_rows(s, d), t)
    return C.once(base.join(tagged(t, F.lower("name").startswith("snow walk")), "id", "left_semi").join(tagged(t, F.lower("name").startswith("red")), "id", "left_anti").select("id"))


@query("tags_with_counts", "SELECT tag_id, any_value(name) AS name, count(DISTINCT shot_key) AS n_shots FROM it JOIN img ON img.id = it.image_id JOIN tg ON tg.id = it.tag_id WHERE NOT coalesce(hidden, false) GROUP BY tag_id", ("img", "tg", "it"))
def _(s, d):
    return tags.with_counts(C.tags(s, d), C.image_tags(s, d), C.image_rows(s, d))


@query("tag_tree_counts", "d AS (SELECT tag_id, count(DISTINCT shot_key) AS n FROM it JOIN img ON img.id = it.image_id WHERE NOT coalesce(hidden, false) GROUP BY tag_id), up(tag_id, node, n, steps) AS (SELECT tag_id, tag_id, n, 0 FROM d UNION ALL SELECT up.tag_id, tg.parent_id, up.n, steps + 1 FROM up JOIN tg ON tg.id = up.node WHERE tg.parent_id IS NOT NULL AND steps < 2000 AND tg.parent_id IN (SELECT id FROM tg)), ok AS (SELECT tag_id FROM up GROUP BY tag_id HAVING max(steps) < 2000), r AS (SELECT node AS tag_id, sum(n) AS n FROM up WHERE tag_id IN (SELECT tag_id FROM ok) GROUP BY node) SELECT t.id AS tag_id, coalesce(d.n, 0) AS direct_count, coalesce(r.n, d.n, 0)::BIGINT AS recursive_count FROM (SELECT DISTINCT id FROM tg) t LEFT JOIN d ON d.tag_id = t.id LEFT JOIN r ON r.tag_id = t.id", ("img", "tg", "it"))
def _(s, d):
    return tags.tree_counts(C.tags(s, d), C.image_tags(s, d), C.image_rows(s, d))


@query("tags_of_images", "sel AS (SELECT DISTINCT shot_key FROM img WHERE flagged = 1), m AS (SELECT id, shot_key FROM img WHERE shot_key IN (SELECT shot_key FROM sel)) SELECT tag_id, any_value(name) AS name, count(DISTINCT shot_key) AS n_shots FROM it JOIN m ON m.id = it.image_id JOIN tg ON tg.id = it.tag_id GROUP BY tag_id", ("img", "tg", "it"))
def _(s, d):
    imgs = C.image_rows(s, d)
    return tags.of_images(imgs.where("flagged = 1").select("id"), C.tags(s, d), C.image_tags(s, d), imgs)


@query("expanded_shots", "SELECT id FROM img WHERE shot_key IN (SELECT shot_key FROM img WHERE rating = 5)")
def _(s, d):
    imgs = C.images(s, d)
    return tags.expand_shots(imgs.where("rating = 5").select("id"), imgs)


@query("album_counts", "SELECT al.album_id, al.name, count(v.id) AS n_files FROM al LEFT JOIN (SELECT album_id, id FROM ai JOIN img ON img.id = ai.image_id WHERE NOT coalesce(hidden, false)) v ON v.album_id = al.album_id GROUP BY al.album_id, al.name", ("img", "al"))
def _(s, d):
    imgs = C.images(s, d)
    seen = C.album_images(imgs).join(imgs.where(S.visible()).select(F.col("id").alias("image_id")), "image_id", "left_semi").groupBy("album_id").agg(F.count(F.lit(1)).alias("n"))
    return C.albums(s).join(seen, "album_id", "left").select("album_id", "name", F.coalesce("n", F.lit(0)).alias("n_files"))


@query("album_covers", "SELECT album_id, first(image_id ORDER BY position, image_id) AS cover_image_id FROM ai GROUP BY album_id", ("img", "al"))
def _(s, d):
    return edits.album_covers(C.album_images(C.images(s, d)))


@query("range_counts", "SELECT range_id, name, start_date, count(img.id) AS n_files FROM rg LEFT JOIN img ON created_at BETWEEN start_date AND end_date GROUP BY range_id, name, start_date", ("img", "rg"))
def _(s, d):
    return ranges.with_counts(C.images(s, d), C.ranges(s))


@query("narrowest_range", "SELECT img.id, first(range_id ORDER BY end_date - start_date, range_id) AS range_id FROM img JOIN rg ON created_at BETWEEN start_date AND end_date GROUP BY img.id", ("img", "rg"))
def _(s, d):
    return ranges.narrowest(C.images(s, d), C.ranges(s))


@query("ranges_of_days", "dy AS (SELECT DISTINCT created_at // 86400 * 86400 AS day_start FROM img WHERE created_at IS NOT NULL) SELECT day_start, first(range_id ORDER BY end_date - start_date, range_id) AS range_id FROM dy JOIN rg ON start_date < day_start + 86400 AND end_date >= day_start GROUP BY day_start", ("img", "rg"))
def _(s, d):
    days = C.images(s, d).where("created_at is not null").select((S.day_of(F.col("created_at")) * 86_400).alias("day_start")).distinct()
    return ranges.of_days(days, C.ranges(s))


def files_of(s, d) -> DataFrame:
    return C.images(s, d).select("id", "created_at", F.col("camera_model").alias("camera"), "shot_key", "flagged", "format")


@query("bursts")
def _(s, d):
    return bursts.find_bursts(files_of(s, d))


@query("burst_keepers")
def _(s, d):
    return quality.keepers(files_of(s, d), C.quality(s, d))


@query("reject_suggestions")
def _(s, d):
    return quality.suggestions(files_of(s, d), C.quality(s, d))


@query("shot_scores", "j AS (SELECT img.*, q.sharpness, q.eye_sharpness, q.aesthetic FROM img LEFT JOIN q ON q.image_id = img.id) SELECT shot_key, bool_or(coalesce(flagged, 0) <> 0) AS is_flagged, first(sharpness ORDER BY sharpness DESC, created_at DESC, id DESC) FILTER (WHERE sharpness IS NOT NULL) AS sharpness, first(eye_sharpness ORDER BY sharpness DESC, created_at DESC, id DESC) FILTER (WHERE sharpness IS NOT NULL) AS eye_sharpness FROM (SELECT * REPLACE (coalesce(created_at, -1) AS created_at) FROM j) GROUP BY shot_key", ("img", "q"))
def _(s, d):
    return quality.shot_scores(files_of(s, d), C.quality(s, d)).select("shot_key", "is_flagged", "sharpness", "eye_sharpness")


_NEAREST = lambda c, p: f"(SELECT v FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS k, count(*) OVER () AS n FROM q WHERE {c} IS NOT NULL) WHERE k = CAST(floor((n - 1) * {p}::DOUBLE + 0.5) AS BIGINT))"


@query("library_reference", f"SELECT (SELECT v FROM (SELECT sharpness AS v, row_number() OVER (ORDER BY sharpness) - 1 AS k, count(*) OVER () AS n FROM q WHERE sharpness IS NOT NULL) WHERE k = n // 2) AS median_sharpness, {_NEAREST('eye_sharpness', 0.8)} AS eye_p80, CASE WHEN (SELECT count(aesthetic) FROM q) >= 30 THEN {_NEAREST('aesthetic', 0.1)} END AS weak_below", ("q",))
def _(s, d):
    return quality.library_reference(C.quality(s, d))


@query("aesthetic_rank", "SELECT count(*) FILTER (WHERE aesthetic < 5.0) AS n_below, count(aesthetic) AS n_total FROM q", ("q",))
def _(s, d):
    return quality.aesthetic_rank(C.quality(s, d), 5.0)


@query("files_to_score", "SELECT shot_key, first(id ORDER BY coalesce(format LIKE 'RAW%', false), id) AS id FROM img GROUP BY shot_key")
def _(s, d):
    return quality.files_to_score(files_of(s, d))


@query("quality_readings")
def _(s, d):
    q = C.quality(s, d)
    return quality.readings(files_of(s, d), q, quality.library_reference(q))


def candidates(s, d) -> DataFrame:
    from lumatable.functions.instants import number_us

    return table(s, d, "import_candidates").select(F.col("candidate_id").alias("id"), "path", "filename", "size_bytes", F.floor(number_us("created_at") / 1_000_000).cast("bigint").alias("created_at"), "hash").distinct()


_CAND = f"ca AS (SELECT DISTINCT candidate_id AS id, path, filename, size_bytes, CAST({C._seconds_sql('created_at')} AS BIGINT) AS created_at, hash FROM import_candidates)"


@query("pre_scan", _CAND + ", k AS (SELECT DISTINCT lower(coalesce(original_filename, filename)) AS n, size_bytes AS z, created_at AS t FROM img WHERE created_at IS NOT NULL) SELECT id, EXISTS (SELECT 1 FROM k WHERE n = lower(filename) AND z = size_bytes AND t = ca.created_at) OR path IN (SELECT path FROM img) AS known FROM ca")
def _(s, d):
    return ingest.pre_scan(candidates(s, d), C.images(s, d)).select("id", "known")


@query("new_by_hash", _CAND + ", f AS (SELECT min(id) AS id FROM ca WHERE hash IS NOT NULL AND lower(hash) NOT IN (SELECT lower(hash) FROM img WHERE hash IS NOT NULL) GROUP BY lower(hash)) SELECT id FROM f UNION ALL SELECT id FROM ca WHERE hash IS NULL")
def _(s, d):
    return ingest.new_by_hash(candidates(s, d), C.images(s, d)).select("id")


@query("group_map", "p AS (SELECT DISTINCT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_replace(regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', ''), '(_modified|_edit|_edited|-edit)$', '') AS stem FROM img), g AS (SELECT dir, stem FROM p GROUP BY dir, stem HAVING count(*) > 1) SELECT path, CASE WHEN g.dir IS NOT NULL THEN substr(sha256(p.dir || chr(1) || p.stem), 1, 16) END AS group_key FROM p LEFT JOIN g ON g.dir = p.dir AND g.stem = p.stem")
def _(s, d):
    return ingest.group_map(C.images(s, d))


@query("planned_destinations")
def _(s, d):
    taken = s.createDataFrame([("Unsorted/IMG_0001.jpg",)], "destination string")
    return ingest.plan_destinations(candidates(s, d), taken)


@query("relinked", _CAND + ", m AS (SELECT id, lower(filename) AS n, size_bytes, hash, row_number() OVER (PARTITION BY lower(filename), size_bytes, hash ORDER BY id) AS rn FROM img WHERE missing), f AS (SELECT DISTINCT path, lower(regexp_replace(path, '^.*/', '')) AS n, size_bytes, hash FROM ca), fr AS (SELECT *, row_number() OVER (PARTITION BY n, size_bytes, hash ORDER BY path) AS rn FROM f) SELECT m.id, fr.path FROM m JOIN fr USING (n, size_bytes, hash, rn)")
def _(s, d):
    return ingest.relink(C.images(s, d).where("missing"), candidates(s, d))


@query("library_check", _CAND + ", r AS (SELECT path, bool_and(coalesce(missing, false)) AS marked FROM img GROUP BY path), l AS (SELECT path FROM img WHERE has_sidecar UNION SELECT path FROM ca), b AS (SELECT coalesce(r.path, l.path) AS path, CASE WHEN r.path IS NULL THEN 'new' WHEN l.path IS NULL AND NOT marked THEN 'missing' WHEN l.path IS NOT NULL AND marked THEN 'found' END AS state FROM r FULL JOIN l ON l.path = r.path) SELECT path, state FROM b WHERE state IS NOT NULL")
def _(s, d):
    imgs = C.images(s, d)
    return ingest.library_check(imgs, imgs.where("has_sidecar").select("path").unionByName(candidates(s, d).select("path")))


@query("review_days", _CAND + ", k AS (SELECT *, CAST(floor(min(created_at) OVER (PARTITION BY filename) / 86400) AS BIGINT) AS day_number FROM ca) SELECT day_number, count(*) AS n_files, sum(size_bytes)::BIGINT AS bytes FROM k GROUP BY day_number")
def _(s, d):
    return ingest.review_days(candidates(s, d).withColumn("shot_key", F.col("filename")))


@query("sidecar_fields", "SELECT doc_id, try_cast(regexp_extract(text, 'xmp:Rating=\"(-?\\d+)\"', 1) AS INTEGER) AS raw_rating, nullif(regexp_extract(text, 'tiff:Model=\"([^\"]*)\"', 1), '') AS model FROM documents WHERE doc_kind = 'sidecar' AND text LIKE '%</x:xmpmeta>%'", ())
def _(s, d):
    docs = table(s, d, "documents").where("doc_kind = 'sidecar' and text like '%</x:xmpmeta>%'")
    r = sidecars.read_sidecars(docs)
    return r.select("doc_id", F.when(F.col("rejected"), -1).otherwise(F.col("rating")).cast("int").alias("raw_rating"), "model")


@query("sidecars_read")
def _(s, d):
    return sidecars.read_sidecars(table(s, d, "documents").where("doc_kind = 'sidecar' and doc_id is not null"))


@query("sidecar_update", "s AS (SELECT image_id AS id, max(try_cast(regexp_extract(text, 'xmp:Rating=\"(-?\\d+)\"', 1) AS INTEGER)) AS r FROM documents WHERE doc_kind = 'sidecar' AND text LIKE '%</x:xmpmeta>%' AND image_id IS NOT NULL GROUP BY image_id) SELECT img.id, CASE WHEN s.r BETWEEN 0 AND 5 THEN s.r ELSE img.rating END AS rating, CASE WHEN s.r = -1 THEN -1 WHEN s.r BETWEEN 0 AND 5 AND flagged = -1 THEN 0 ELSE flagged END AS flagged FROM img LEFT JOIN s ON s.id = img.id")
def _(s, d):
    docs = table(s, d, "documents").where("doc_kind = 'sidecar' and image_id is not null")
    r = sidecars.read_sidecars(docs).join(docs.select("doc_id", F.col("image_id").alias("id")), "doc_id")
    raw = F.when(F.col("rejected"), -1).otherwise(F.col("rating"))
    one = r.groupBy("id").agg(F.max(raw).alias("raw")).select("id", F.when(F.col("raw") >= 0, F.col("raw")).alias("rating"), F.when(F.col("raw").isNotNull(), F.col("raw") == -1).alias("rejected"), *(F.lit(None).cast(t).alias(c) for c, t in (("title", "string"), ("description", "string"), ("orientation", "int"), ("color_label", "int"))), F.lit(4_000_000_000).cast("bigint").alias("mtime"))
    return sidecars.update_from_sidecars(C.images(s, d), one).select("id", "rating", "flagged")


@query("reconciled_shots", "m AS (SELECT group_hash, max(rating) AS r, min(flagged) FILTER (WHERE flagged <> 0) AS f1, max(flagged) FILTER (WHERE flagged <> 0) AS f2, min(color_label) FILTER (WHERE color_label <> 0) AS c1, max(color_label) FILTER (WHERE color_label <> 0) AS c2 FROM img WHERE group_hash IS NOT NULL GROUP BY group_hash) SELECT id, coalesce(r, rating) AS rating, CASE WHEN f1 = f2 THEN f2 ELSE flagged END AS flagged, CASE WHEN c1 = c2 THEN c2 ELSE color_label END AS color_label FROM img LEFT JOIN m ON m.group_hash = img.group_hash")
def _(s, d):
    return sidecars.reconcile_shots(C.images(s, d))


@query("batch_rating", "SELECT id, CASE WHEN flagged = 1 THEN 5 ELSE rating END AS rating FROM img")
def _(s, d):
    imgs = C.images(s, d)
    return edits.set_for(imgs, imgs.where("flagged = 1"), rating=9).select("id", "rating")


@query("shifted_times", "SELECT id, CASE WHEN shot_key IN (SELECT shot_key FROM img WHERE camera_model = 'Corvane X20') THEN created_at + 3600 ELSE created_at END AS created_at FROM img")
def _(s, d):
    imgs = C.images(s, d)
    return edits.shift_time(imgs, imgs.where("camera_model = 'Corvane X20'").select("id"), 3_600).select("id", "created_at")


@query("deleted_children", "SELECT image_id, tag_id FROM it WHERE image_id NOT IN (SELECT id FROM img WHERE rating = 1)", ("img", "it"))
def _(s, d):
    imgs = C.images(s, d)
    return edits.delete_with_children(imgs, {"t": C.image_tags(s, d)}, imgs.where("rating = 1").select("id"))[1]["t"].select("image_id", "tag_id")


@query("merged_quality", "o AS (SELECT image_id, max(aesthetic) AS a, max(sharpness) AS z FROM (SELECT image_id, CASE WHEN NOT isnan(aesthetic) THEN aesthetic END AS aesthetic, CASE WHEN NOT isnan(sharpness) THEN sharpness END AS sharpness FROM image_quality WHERE quality_version = 1) GROUP BY image_id), n AS (SELECT image_id, aesthetic AS a, sharpness AS z FROM q) SELECT coalesce(n.image_id, o.image_id) AS image_id, coalesce(n.a, o.a) AS aesthetic, CASE WHEN n.image_id IS NOT NULL THEN n.z ELSE o.z END AS sharpness FROM o FULL JOIN n ON n.image_id = o.image_id", ("q",))
def _(s, d):
    real = lambda c: F.max(F.when(~F.isnan(c), F.col(c))).alias(c)
    old = table(s, d, "image_quality").where("quality_version = 1").groupBy("image_id").agg(real("aesthetic"), real("sharpness"))
    return edits.upsert_quality(old, C.quality(s, d).select("image_id", "aesthetic", "sharpness"))


@query("video_durations", "SELECT id, CASE WHEN try_cast(json_extract_string(metadata_json, '$.duration') AS DOUBLE) IS NULL THEN json_extract_string(metadata_json, '$.duration') END AS duration FROM img WHERE format LIKE 'VIDEO%' AND json_valid(metadata_json)")
def _(s, d):
    return C.images(s, d).where(S.is_video(F.col("format")) & F.expr("try_parse_json(metadata_json) is not null")).select("id", S.duration_of_metadata(F.col("metadata_json")).alias("duration"))


@query("rotations", "SELECT id, CASE WHEN orientation BETWEEN 1 AND 8 THEN [6, 7, 8, 5, 2, 3, 4, 1][orientation] ELSE 6 END AS clockwise, round(CASE WHEN orientation BETWEEN 5 AND 8 THEN 1 / a ELSE a END, 6) AS aspect FROM (SELECT *, CASE WHEN width > 0 AND height > 0 THEN width / height ELSE 1.5 END AS a FROM img)")
def _(s, d):
    return C.images(s, d).select("id", S.rotate(F.col("orientation")).alias("clockwise"), F.round(S.display_aspect(F.col("width"), F.col("height"), F.col("orientation")), 6).alias("aspect"))


@query("template_names", "SELECT id, coalesce(strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y%m%d'), '') || '_' || regexp_replace(filename, '\\.[^.]*$', '') || '.' || lower(regexp_extract(filename, '\\.([^./]+)$', 1)) AS name FROM img")
def _(s, d):
    return C.images(s, d).select("id", S.filename_from_template("{date:%Y%m%d}_{name}.{ext}", S.stem(F.col("filename")), F.col("created_at"), S.extension(F.col("filename"))).alias("name"))


WEIGHTS = [((i * 37) % 19 - 9) / 10 for i in range(64)]


@query("embedding_scores", f"w AS (SELECT {WEIGHTS} AS w) SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * w[i])) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) + 0.25, 6) AS score FROM embeddings, w", ())
def _(s, d):
    e = table(s, d, "embeddings")
    return e.select("vec_id", F.round(arrays.head_score(F.col("embedding"), WEIGHTS, 0.25), 6).alias("score"))


@query("crop_candidates")
def _(s, d):
    return arrays.crop_candidates(C.images(s, d).select("id", "width", "height"))


SQL["p3_found"] = f"WITH {C.IMAGES_SQL}, e AS (SELECT DISTINCT id, created_at AS t, nullif(lower(trim(camera_model, ' ' || chr(9) || chr(10) || chr(13) || chr(0) || '''\"')), '') AS camera FROM img WHERE created_at IS NOT NULL), g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 1800 THEN 0 ELSE 1 END AS opens FROM e WHERE camera IS NOT NULL WINDOW w AS (PARTITION BY camera ORDER BY t, id)), r AS (SELECT *, sum(opens) OVER (PARTITION BY camera ORDER BY t, id) AS run FROM g) SELECT camera AS camera_model, min(t) AS session_start, max(t) AS session_end, count(DISTINCT id) AS n_images FROM r GROUP BY camera, run"
SQL["p3_replayed"] = SQL["p3_found"]
SQL["p4_found"] = f"""WITH RECURSIVE tg AS (SELECT id, min(trim(name)) AS name, min(parent_id) AS parent_id FROM tags WHERE id IS NOT NULL GROUP BY id),
n AS (SELECT id, name, CASE WHEN parent_id IN (SELECT id FROM tg) THEN parent_id END AS parent FROM tg),
down(id, root_id, depth, full_path) AS (SELECT id, id, 0, name FROM n WHERE parent IS NULL UNION ALL SELECT n.id, root_id, depth + 1, full_path || '|' || n.name FROM n JOIN down ON n.parent = down.id),
up(id, node) AS (SELECT id, parent FROM n WHERE parent IS NOT NULL AND id IN (SELECT id FROM down) UNION ALL SELECT up.id, n.parent FROM up JOIN n ON n.id = up.node WHERE n.parent IS NOT NULL),
nd AS (SELECT node AS id, count(*) AS c FROM up GROUP BY node),
reach(id, node) AS (SELECT id, parent FROM n WHERE id NOT IN (SELECT id FROM down) UNION SELECT reach.id, n.parent FROM reach JOIN n ON n.id = reach.node),
cyc AS (SELECT id FROM reach WHERE id = node), m AS (SELECT reach.id, min(node) AS root_id FROM reach WHERE node IN (SELECT id FROM cyc) GROUP BY reach.id),
every AS (SELECT down.id, root_id, depth, full_path, coalesce(c, 0) AS n_descendants FROM down LEFT JOIN nd ON nd.id = down.id UNION ALL SELECT id, root_id, -1, '', -1 FROM m),
st AS (SELECT id, min(full_path) AS stored FROM hierarchical_tag_items WHERE id IS NOT NULL GROUP BY id)
SELECT every.id AS tag_id, root_id, depth, full_path, n_descendants, CASE WHEN st.id IS NULL THEN -1 WHEN list_filter(list_transform(string_split_regex(lower(coalesce(stored, '')), '[|/]'), lambda x: trim(x)), lambda x: x <> '') = list_filter(list_transform(string_split_regex(lower(full_path), '[|/]'), lambda x: trim(x)), lambda x: x <> '') THEN 1 ELSE 0 END AS stored_ok
FROM every LEFT JOIN st ON st.id = every.id"""
SQL["p4_descendants"] = """WITH RECURSIVE tg AS (SELECT id, min(parent_id) AS parent_id FROM tags WHERE id IS NOT NULL GROUP BY id), n AS (SELECT id, CASE WHEN parent_id IN (SELECT id FROM tg) THEN parent_id END AS parent FROM tg),
down(id) AS (SELECT id FROM n WHERE parent IS NULL UNION ALL SELECT n.id FROM n JOIN down ON n.parent = down.id),
up(id, node, distance) AS (SELECT id, parent, 1 FROM n WHERE parent IS NOT NULL AND id IN (SELECT id FROM down) UNION ALL SELECT up.id, n.parent, distance + 1 FROM up JOIN n ON n.id = up.node WHERE n.parent IS NOT NULL)
SELECT node AS ancestor_id, id AS descendant_id, distance FROM up"""
SQL["p7_found"] = f"""WITH p AS (SELECT DISTINCT id, radians(latitude) AS a, radians(longitude) AS o FROM images WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0) AND NOT isnan(latitude) AND NOT isnan(longitude)),
r AS (SELECT DISTINCT place_id, radians(latitude) AS a, radians(longitude) AS o, radius_m FROM places)
SELECT DISTINCT id AS image_id, place_id FROM p JOIN r ON 2 * {spatial.EARTH_M} * asin(least(1.0, sqrt(pow(sin((r.a - p.a) / 2), 2) + cos(p.a) * cos(r.a) * pow(sin((r.o - p.o) / 2), 2)))) <= radius_m"""
SQL["p7_by_cells"] = SQL["p7_found"]
SQL["p7_near"] = f"""WITH p AS (SELECT DISTINCT id, latitude, longitude FROM images WHERE id IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0) AND NOT isnan(latitude) AND NOT isnan(longitude)),
r AS (SELECT latitude, longitude, count(*) AS n FROM p GROUP BY latitude, longitude), a AS (SELECT * FROM p WHERE id % 20 = 0)
SELECT a.id AS image_id, count(*) AS n_positions, (sum(n) - 1)::BIGINT AS n_images FROM a JOIN r ON abs(r.latitude - a.latitude) < 0.01
  AND 2 * {spatial.EARTH_M} * asin(least(1.0, sqrt(pow(sin(radians(r.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(r.latitude)) * pow(sin(radians(r.longitude - a.longitude) / 2), 2)))) <= {spatial.NEAR_M} GROUP BY a.id HAVING sum(n) > 1"""
