"""Queries of catalogue reads, of rules over bursts, and of changes to small tables, and their SQL; registered beside the core queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumatable.functions import scalars as S
from lumatable.operators import edits, quality, reads, records, sidecars, timeline
from lumatable.plans import catalog as C
from lumatable.plans.core_queries import QUERIES, SQL, candidates, files_of, query, tables
from lumatable.plans.filters import SmartQuery, Tables
from lumatable.runtime import table

_NORM = lambda c: f"(' ' || regexp_replace(lower(strip_accents(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_TEXT = ("filename", "camera_make", "camera_model", "lens_model", "title", "description")
_MATCHES = lambda w: "(" + " OR ".join(f"contains({_NORM(c)}, ' {w}')" for c in _TEXT) + ")"
_MOMENT = "coalesce(created_at, imported_at)"


@query("page_of_images", f"SELECT id, {_MOMENT} AS moment FROM img ORDER BY moment DESC NULLS LAST, id DESC LIMIT 100 OFFSET 50")
def _(s, d):
    return reads.moment_of(reads.page(C.images(s, d), 100, 50))


@query("image_by_id", "SELECT id, path, filename, rating FROM img WHERE id = 100")
def _(s, d):
    return C.once(reads.by_id(C.image_rows(s, d), 100)).select("id", "path", "filename", "rating")


@query("images_of_month", "SELECT id FROM img WHERE year = 2014 AND month = 5")
def _(s, d):
    return reads.of_calendar(C.images(s, d), 2014, 5).select("id")


@query("missing_thumbhash", "SELECT id FROM img WHERE NOT has_thumbhash")
def _(s, d):
    return C.once(reads.without_thumbhash(C.image_rows(s, d))).select("id")


@query("integrity_listing", "SELECT id, path, missing, has_sidecar, has_xcf, xmp_mtime FROM img WHERE NOT coalesce(hidden, false)")
def _(s, d):
    return C.once(reads.integrity_listing(C.image_rows(s, d)))


@query("group_listing", "SELECT id, format, filename FROM img WHERE group_hash = (SELECT min(group_hash) FROM img)")
def _(s, d):
    rows = C.image_rows(s, d)
    first = rows.agg(F.min("group_hash")).first()[0] or ""  # one row
    return reads.group_listing(C.once(rows.where(F.col("group_hash") == first)), first).select("id", "format", "filename")


@query("selected_shots", "c AS (SELECT shot_key, min(id) AS place, string_agg(id::VARCHAR, ',' ORDER BY id) AS selected FROM img WHERE rating = 4 GROUP BY shot_key), v AS (SELECT shot_key, string_agg(id::VARCHAR, ',' ORDER BY format NULLS FIRST, filename NULLS FIRST, id) AS versions FROM img GROUP BY shot_key) SELECT shot_key, place, versions, selected FROM c JOIN v USING (shot_key)")
def _(s, d):
    imgs = C.images(s, d)
    shots = reads.shots_of(imgs.where("rating = 4").select("id", F.col("id").alias("place")), imgs)
    return shots.select("shot_key", "place", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("versions", "selected")))


@query("distinct_shots", "SELECT count(DISTINCT shot_key) AS n_shots FROM img WHERE flagged = 1")
def _(s, d):
    rows = C.image_rows(s, d)
    return reads.distinct_shots(rows.where("flagged = 1"), rows)


@query("first_seen_tags", "SELECT tag_id, min(added_at) AS added_at FROM image_tags WHERE tag_id IS NOT NULL GROUP BY tag_id", ())
def _(s, d):
    return reads.first_seen(table(s, d, "image_tags").where("tag_id is not null"), "tag_id", "added_at")


@query("ids_of_json", "SELECT id, path FROM img WHERE id IN (3, 5, 8)")
def _(s, d):
    ids = reads.ids_of_json(s.sql("SELECT * FROM VALUES ('[3, 5]'), ('[8, null]'), ('none') t(j)"), "j")
    return C.once(C.image_rows(s, d).join(F.broadcast(ids.limit(1_000)), "id", "left_semi")).select("id", "path")


@query("library_search", f"SELECT id FROM img WHERE {_MATCHES('harbour')} AND year = 2016")
def _(s, d):
    return reads.library_search(C.images(s, d), "Harbour", year=2016, limit=10_000_000).select("id")


_TOKENS = f"list_filter(string_split(lower(strip_accents(regexp_replace(concat_ws(' ', {', '.join(_TEXT)}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), ' '), lambda t: t <> '')"
_IDF = lambda i: f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5)))"
_PART = lambda i: f"{_IDF(i)} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * l / m))"


@query("search_ranked", f"k AS (SELECT id, {_TOKENS} AS ts FROM img), h AS (SELECT id, len(ts) AS l, len(list_filter(ts, lambda t: starts_with(t, 'harbour'))) AS tf0, len(list_filter(ts, lambda t: starts_with(t, 'win'))) AS tf1 FROM k), z AS (SELECT count(*)::DOUBLE AS n, avg(l) AS m, count(*) FILTER (WHERE tf0 > 0) AS d0, count(*) FILTER (WHERE tf1 > 0) AS d1 FROM h) SELECT id, round({_PART(0)} + {_PART(1)}, 6) AS score FROM h, z WHERE tf0 > 0 AND tf1 > 0 ORDER BY score DESC, id DESC LIMIT 20")
def _(s, d):
    return reads.ranked_search(C.images(s, d), "Harbour win", 20)


@query("images_at_paths", "SELECT id FROM img WHERE path IN (SELECT path FROM img WHERE has_sidecar)")
def _(s, d):
    rows = C.image_rows(s, d)
    return C.once(reads.at_paths(rows, rows.where("has_sidecar"))).select("id")


@query("trash_plan", "x AS (SELECT *, coalesce(format LIKE 'RAW%', false) AS fits, coalesce(rating = 1, false) AS chosen FROM img), w AS (SELECT *, bool_or(chosen) OVER (PARTITION BY shot_key) AS a, bool_or(fits) OVER (PARTITION BY shot_key) AS b FROM x) SELECT id, path, CASE WHEN b THEN fits ELSE chosen END AS trashed FROM w WHERE a")
def _(s, d):
    imgs = C.images(s, d)
    return reads.trash_plan(imgs, imgs.where("rating = 1").select("id"), "raw")


_PATHS_SQL = "n1 AS (SELECT id, min(coalesce(name, '')) AS name, min(parent_id) AS parent_id FROM tg WHERE id IS NOT NULL GROUP BY id), dn(id, path) AS (SELECT id, name FROM n1 WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM n1) UNION ALL SELECT n1.id, dn.path || '|' || n1.name FROM n1 JOIN dn ON n1.parent_id = dn.id), tp AS (SELECT n1.id, coalesce(dn.path, n1.name) AS path FROM n1 LEFT JOIN dn ON dn.id = n1.id)"


@query("tag_paths", _PATHS_SQL + " SELECT id, path FROM tp", ("tg",))
def _(s, d):
    return reads.tag_paths(C.tags(s, d).where("id is not null"))


@query("tags_of_one_image", _PATHS_SQL + " SELECT id AS tag_id, path FROM tp WHERE id IN (SELECT tag_id FROM it WHERE image_id = (SELECT min(image_id) FROM it))", ("tg", "it"))
def _(s, d):
    it = C.image_tags(s, d)
    return reads.tags_of_image(C.tags(s, d).where("id is not null"), it, it.agg(F.min("image_id")).first()[0] or 0)


@query("images_with_tag", "below(id) AS (SELECT id FROM tg WHERE lower(name) = 'amber bridges' UNION SELECT tg.id FROM tg JOIN below ON tg.parent_id = below.id) SELECT id, path FROM img WHERE id IN (SELECT image_id FROM it WHERE tag_id IN (SELECT id FROM below))", ("img", "tg", "it"))
def _(s, d):
    return C.once(reads.images_with_tag(C.tags(s, d), C.image_tags(s, d), C.image_rows(s, d), "AMBER BRIDGES"))


@query("tags_by_name", "SELECT id, name FROM tg WHERE name IS NOT NULL", ("tg",))
def _(s, d):
    return reads.by_name(C.tags(s, d).where("name is not null").select("id", "name"))


@query("row_tops", "t AS (SELECT shot_key, max(coalesce(created_at, imported_at)) AS moment FROM img WHERE NOT coalesce(hidden, false) GROUP BY shot_key), n AS (SELECT CAST(floor(moment / 86400) AS BIGINT) AS day_number, count(*) AS c FROM t GROUP BY 1), r AS (SELECT day_number, unnest(range(0, (c + 4) // 5)) AS row FROM n), b AS (SELECT day_number, count(*) * 220.0 + 40.0 AS tall FROM r GROUP BY 1), a AS (SELECT day_number, coalesce(sum(tall) OVER (ORDER BY day_number DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM b) SELECT r.day_number, r.row::INTEGER AS row, 0 AS header_row, (above + 40.0 + r.row * 220.0)::DOUBLE AS top FROM r JOIN a ON r.day_number IS NOT DISTINCT FROM a.day_number")
def _(s, d):
    days = timeline.sections(timeline.collapse(timeline_view(s, d)))
    rows = days.select("day_number", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tiles") + 4) / 5).cast("int") - 1)).alias("row"), F.lit(220.0).alias("height"))
    return reads.row_tops(rows, 40.0)


def timeline_view(s, d):
    return C.image_rows(s, d).where(S.visible())


@query("smart_exact_tags", "SELECT id FROM img WHERE NOT coalesce(hidden, false) AND id IN (SELECT image_id FROM it JOIN tg ON tg.id = it.tag_id WHERE lower(name) = 'snow portraits') AND id NOT IN (SELECT image_id FROM it JOIN tg ON tg.id = it.tag_id WHERE lower(name) = 'amber bridges')", ("img", "tg", "it"))
def _(s, d):
    q = SmartQuery.parse('{"tags": ["Snow Portraits"], "not_tags": ["AMBER bridges"], "other": 1}')
    return C.once(q.apply(C.image_rows(s, d), tables(s, d, "tag"))).select("id")


@query("saved_counts", "SELECT 1::BIGINT AS query_id, count(DISTINCT shot_key) AS n_shots FROM img WHERE NOT coalesce(hidden, false) AND coalesce(rating, 0) >= 3 AND color_label = 2 UNION ALL SELECT 2, 0 UNION ALL SELECT 3, count(DISTINCT shot_key) FROM img WHERE NOT coalesce(hidden, false) AND created_at BETWEEN 1451606400 AND 1483228799 AND lower(lens_model) LIKE '%macro%'")
def _(s, d):
    saved = s.sql("""SELECT * FROM VALUES (1L, '{"min_rating": 3, "color": 2}'), (2L, '{broken'), (3L, '{"date_range": [1451606400, 1483228799], "lens": "macro"}') t(id, query_json)""")
    return records.counts_of_saved(saved, C.image_rows(s, d), Tables())


# display texts and moments


@query("display_texts", "SELECT id, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN format('{:.1f} KB', size_bytes / 1024.0) ELSE format('{:.1f} MB', size_bytes / 1048576.0) END AS size_text, CASE WHEN created_at IS NULL THEN 'Unknown Date' ELSE strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%A, %B %-d, %Y') END || '  ·  1 photo' AS title, strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS clock, created_at // 60 * 60 AS minute, CASE WHEN z < 0 THEN '-' ELSE '+' END || CASE WHEN abs(z) >= 86400 THEN abs(z) // 86400 || 'd ' ELSE '' END || printf('%02d:%02d:%02d', abs(z) % 86400 // 3600, abs(z) % 3600 // 60, abs(z) % 60) AS shift FROM (SELECT *, created_at - imported_at AS z FROM img)")
def _(s, d):
    at = F.col("created_at")
    return C.images(s, d).select("id", S.format_bytes(F.col("size_bytes")).alias("size_text"), S.section_title(at, F.lit(1)).alias("title"), S.format_wall_clock(at).alias("clock"), S.parse_wall_clock(F.substring(S.format_wall_clock(at), 1, 16)).alias("minute"), S.describe_shift(at - F.col("imported_at")).alias("shift"))


@query("day_bounds", "SELECT id, coalesce(epoch(b)::BIGINT, 0) AS day_start, coalesce(epoch(b)::BIGINT + 86399, 0) AS day_end FROM (SELECT id, try_cast(printf('%04d-%02d-%02d', 2010 + id % 10, 1 + id % 14, 1 + id % 33) AS DATE) AS b FROM img)")
def _(s, d):
    i = F.col("id")
    return C.images(s, d).select("id", S.day_bounds((2010 + i % 10).cast("int"), (1 + i % 14).cast("int"), (1 + i % 33).cast("int")).alias("b")).select("id", F.col("b.start").alias("day_start"), F.col("b.end").alias("day_end"))


@query("capture_moments", "SELECT id, coalesce(created_at, CASE WHEN format LIKE 'VIDEO%' THEN imported_at END, xmp_mtime, imported_at) AS moment FROM img")
def _(s, d):
    container = F.when(S.is_video(F.col("format")), F.col("imported_at"))
    return C.images(s, d).select("id", S.capture_moment(original=F.col("created_at"), container=container, modified=F.col("xmp_mtime"), mtime=F.col("imported_at")).alias("moment"))


@query("step_indexes", "SELECT id, ((id % 7 - 9) % 7 + 7) % 7 AS at FROM img")
def _(s, d):
    return C.images(s, d).select("id", S.step_index(F.col("id") % 7, F.lit(-9), F.lit(7)).alias("at"))


# rules over bursts and sessions

_BURSTS_SQL = """
d AS (SELECT id, created_at AS t, camera_model AS camera, shot_key, row_number() OVER (ORDER BY created_at, id) AS rn FROM img WHERE created_at IS NOT NULL),
ln AS (SELECT *, coalesce(lag(rn) OVER (PARTITION BY shot_key ORDER BY rn), -1) AS pv, coalesce(t - lag(t) OVER (ORDER BY rn) <= 2 AND coalesce(camera, '') = coalesce(lag(camera) OVER (ORDER BY rn), ''), false) AS near FROM d),
ac AS (SELECT list_reduce(list([near::BIGINT, pv, rn] ORDER BY rn), lambda acc, x: list_append(acc, CASE WHEN len(acc) > 0 AND (x[1] = 1 OR x[2] >= acc[-1]) THEN acc[-1] ELSE x[3] END), []::BIGINT[]) AS starts FROM ln),
st AS (SELECT unnest(starts) AS start_rn, generate_subscripts(starts, 1) AS rn FROM ac),
mm AS (SELECT d.*, st.start_rn FROM d JOIN st ON st.rn = d.rn),
bu AS (SELECT mm.id, f.id AS burst_id FROM mm JOIN d f ON f.rn = mm.start_rn WHERE mm.start_rn IN (SELECT start_rn FROM mm GROUP BY start_rn HAVING count(DISTINCT shot_key) > 1))"""


def _register_sql(name: str, sql: str, uses: tuple[str, ...]) -> None:
    preludes = {"img": C.IMAGES_SQL, "q": C.QUALITY_SQL}
    SQL[name] = f"WITH RECURSIVE {', '.join(preludes[u] for u in uses)}, {sql}"


_register_sql("bursts", _BURSTS_SQL + " SELECT id, burst_id FROM bu", ("img",))

_Q = "struct_pack(sharpness := sharpness, eye := eye_sharpness, high := clip_highlights, shadows := clip_shadows, aesthetic := aesthetic, crop := aesthetic_crop, has_crop := has_crop)"
_SCORED = lambda by: f"first(created_at ORDER BY created_at NULLS LAST, img.id) AS created_at, first(img.id ORDER BY created_at NULLS LAST, img.id) AS first_id, first(camera_model ORDER BY created_at NULLS LAST, img.id) AS camera, bool_or(coalesce(flagged, 0) <> 0) AS is_flagged, first({_Q} ORDER BY sharpness DESC, created_at DESC NULLS LAST, img.id DESC) FILTER (WHERE sharpness IS NOT NULL) AS q FROM img LEFT JOIN q ON q.image_id = img.id {by}"
_VALUED = "CASE WHEN bool_and(q.eye IS NOT NULL) OVER (PARTITION BY burst_id) THEN q.eye ELSE q.sharpness END"

_register_sql(
    "burst_keepers",
    _BURSTS_SQL + f""", s0 AS (SELECT burst_id, shot_key, {_SCORED('JOIN bu ON bu.id = img.id GROUP BY burst_id, shot_key')}),
s1 AS (SELECT *, {_VALUED} AS v FROM s0 WHERE q IS NOT NULL), s2 AS (SELECT *, max(v) OVER (PARTITION BY burst_id) AS best FROM s1),
s3 AS (SELECT *, NOT (v < best AND (v < 0.6 * best OR coalesce(q.high > 0.25, false))) AS sound FROM s2),
g AS (SELECT burst_id, count(*) FILTER (WHERE sound) AS n, count(*) FILTER (WHERE sound AND q.aesthetic IS NULL) AS un, first(first_id ORDER BY q.aesthetic DESC, created_at DESC, first_id DESC) FILTER (WHERE sound AND q.aesthetic IS NOT NULL) AS liked, first(first_id ORDER BY v DESC, created_at, first_id) AS sharpest FROM s3 GROUP BY burst_id)
SELECT burst_id, CASE WHEN n >= 2 AND un = 0 THEN liked ELSE sharpest END AS first_id FROM g""",
    ("img", "q"),
)

_NTH = lambda c, at: f"(SELECT v FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS k, count(*) OVER () AS n FROM q WHERE {c} IS NOT NULL) WHERE k = {at})"
_REF = f"ref AS (SELECT {_NTH('sharpness', 'n // 2')} AS med, {_NTH('eye_sharpness', 'CAST(floor((n - 1) * 0.8::DOUBLE + 0.5) AS BIGINT)')} AS eye80, CASE WHEN (SELECT count(aesthetic) FROM q) >= 30 THEN {_NTH('aesthetic', 'CAST(floor((n - 1) * 0.1::DOUBLE + 0.5) AS BIGINT)')} END AS weak)"


def _suggestions_sql(flagged: str, final: str) -> str:
    """The rules over all shots, with an expression for the flag, and the select over sg (id, reason, ticked)."""
    return (
        f"img9 AS (SELECT * EXCLUDE (flagged), {flagged} AS flagged FROM img), " + _BURSTS_SQL.strip()
        + f""", {_REF}, pa AS (SELECT img9.*, bu.burst_id, shot_key || coalesce('#' || bu.burst_id, '') AS part FROM img9 LEFT JOIN bu ON bu.id = img9.id),
s0 AS (SELECT part, any_value(burst_id) AS burst_id, {_SCORED('GROUP BY part').replace('FROM img LEFT', 'FROM pa img LEFT')}),
sh AS (SELECT shot_key, {_SCORED('GROUP BY shot_key')}),
s1 AS (SELECT * FROM s0 WHERE q IS NOT NULL),
se AS (SELECT part, CASE WHEN count(*) >= 3 THEN list_sort(list(sh.q.eye))[CAST(floor((count(*) - 1) * 0.8 + 0.5) AS BIGINT) + 1] END AS session_eye FROM s1 JOIN sh ON coalesce(sh.camera, '') = coalesce(s1.camera, '') AND abs(sh.created_at - s1.created_at) <= 1800 WHERE sh.q.eye IS NOT NULL GROUP BY part),
s2 AS (SELECT s1.*, session_eye, med, eye80, weak, CASE WHEN coalesce(q.has_crop, false) AND q.crop IS NOT NULL THEN CASE WHEN q.aesthetic IS NULL OR q.crop - 0.2 > q.aesthetic THEN q.crop - 0.2 ELSE q.aesthetic END ELSE q.aesthetic END AS pot FROM s1 LEFT JOIN se ON se.part = s1.part LEFT JOIN ref ON true),
i1 AS (SELECT *, {_VALUED} AS v FROM s2 WHERE burst_id IS NOT NULL), i2 AS (SELECT *, max(v) OVER (PARTITION BY burst_id) AS best FROM i1),
i3 AS (SELECT *, CASE WHEN v < best AND v < 0.6 * best THEN 'blurred' WHEN v < best AND q.high > 0.25 THEN 'highlights' END AS fault FROM i2),
i4 AS (SELECT *, count(*) FILTER (WHERE fault IS NULL) OVER b >= 2 AND count(*) FILTER (WHERE fault IS NULL AND q.aesthetic IS NULL) OVER b = 0 AS liked, first_value(CASE WHEN fault IS NULL THEN first_id END) OVER w AS top_id, first_value(CASE WHEN fault IS NULL THEN q.aesthetic END) OVER w AS top_a FROM i3
  WINDOW b AS (PARTITION BY burst_id), w AS (PARTITION BY burst_id ORDER BY (fault IS NULL) DESC, q.aesthetic DESC NULLS LAST, created_at DESC, first_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
j AS (SELECT part, is_flagged, coalesce(fault, CASE WHEN liked AND fault IS NULL AND first_id <> top_id AND pot < top_a - 0.5 THEN 'less liked' END) AS reason FROM i4
  UNION ALL SELECT part, is_flagged, CASE WHEN er > 0 AND q.eye < 0.5 * er THEN 'eyes blurred' WHEN q.sharpness < coalesce(0.08 * med, 60.0) THEN 'blurred' WHEN q.high > 0.25 THEN 'highlights' WHEN q.shadows > 0.35 THEN 'shadows' WHEN pot < weak THEN 'weak' END FROM (SELECT *, CASE WHEN created_at IS NOT NULL THEN coalesce(session_eye, eye80) END AS er FROM s2 WHERE burst_id IS NULL)),
sg AS (SELECT pa.id, reason, reason NOT IN ('less liked', 'weak') AS ticked FROM pa JOIN j ON j.part = pa.part WHERE reason IS NOT NULL AND NOT is_flagged) """ + final
    )


_register_sql("reject_suggestions", _suggestions_sql("flagged", "SELECT id, reason, ticked FROM sg"), ("img", "q"))


@query("rejects_view")
def _(s, d):
    return quality.rejects_view(files_of(s, d), C.quality(s, d))


_register_sql("rejects_view", _suggestions_sql("CASE WHEN flagged = -1 THEN 0 ELSE flagged END", "SELECT sg.id, reason, ticked FROM sg JOIN img ON img.id = sg.id WHERE img.flagged = -1"), ("img", "q"))


@query("final_rejects", "SELECT id FROM img WHERE (flagged = -1 AND NOT coalesce(rating >= 3, false)) OR rating = 1")
def _(s, d):
    imgs = C.image_rows(s, d)
    return quality.final_rejects(imgs.where("flagged = -1"), imgs.where("flagged = -1 and rating >= 3"), imgs.where("rating = 1"))


@query("applied_choices", "SELECT id, CASE WHEN rating = 1 THEN -1 WHEN flagged = -1 AND rating >= 3 THEN 0 ELSE flagged END AS flagged FROM img")
def _(s, d):
    imgs = C.images(s, d)
    return quality.apply_choices(imgs, imgs.where("rating = 1"), imgs.where("flagged = -1 and rating >= 3")).select("id", "flagged")


@query("session_readings", _REF + """, e AS (SELECT img.id, created_at, coalesce(camera_model, '') AS cam, shot_key, q.eye_sharpness AS eye, q.sharpness FROM img JOIN q ON q.image_id = img.id),
ns AS (SELECT a.id, b.shot_key, max(b.eye) AS eye FROM e a JOIN e b ON a.cam = b.cam AND abs(a.created_at - b.created_at) <= 1800 WHERE b.eye IS NOT NULL GROUP BY a.id, b.shot_key),
sr AS (SELECT id, CASE WHEN count(*) >= 3 THEN list_sort(list(eye))[CAST(floor((count(*) - 1) * 0.8 + 0.5) AS BIGINT) + 1] END AS sref FROM ns GROUP BY id),
rr AS (SELECT e.*, sref, coalesce(sref, eye80) AS er, med FROM e LEFT JOIN sr ON sr.id = e.id LEFT JOIN ref ON true)
SELECT id, round(CASE WHEN eye IS NOT NULL AND er > 0 THEN eye / er * 100 WHEN med > 0 THEN sharpness / med * 100 END, 6) AS percent, eye IS NOT NULL AND coalesce(er > 0, false) AS by_eyes, eye IS NOT NULL AND coalesce(er > 0, false) AND sref IS NOT NULL AS in_session FROM rr""", ("img", "q"))
def _(s, d):
    q = C.quality(s, d)
    return quality.session_readings(files_of(s, d), q, quality.library_reference(q)).select("id", F.round("percent", 6).alias("percent"), "by_eyes", "in_session")


_register_sql("quality_readings", _REF + ", o AS (SELECT shot_key, first(sharpness ORDER BY img.id) AS other FROM img JOIN q ON q.image_id = img.id WHERE sharpness IS NOT NULL GROUP BY shot_key), w AS (SELECT img.id, sharpness, other FROM img LEFT JOIN q ON q.image_id = img.id LEFT JOIN o ON o.shot_key = img.shot_key), v AS (SELECT id, CAST(round(coalesce(sharpness, other) / med * 100) AS INTEGER) AS p FROM w LEFT JOIN ref ON med > 0) SELECT id, p AS percent, CASE WHEN p < 8 THEN 'Bad' WHEN p < 20 THEN 'Poor' WHEN p < 50 THEN 'Fair' WHEN p IS NOT NULL THEN 'Good' END AS grade FROM v", ("img", "q"))

SQL["crop_candidates"] = f"WITH RECURSIVE {C.IMAGES_SQL}, z AS (SELECT id, greatest(width, 1)::DOUBLE AS w0, greatest(height, 1)::DOUBLE AS h0 FROM img), u AS (SELECT id, side * least(w0, h0) / w0 AS w, side * least(w0, h0) / h0 AS h FROM z, (VALUES (1.0::DOUBLE), (0.85), (0.7)) s(side)) SELECT DISTINCT id, round((1 - w) * fx, 9) AS x, round((1 - h) * fy, 9) AS y, round(w, 9) AS w, round(h, 9) AS h FROM u, (VALUES (0.0::DOUBLE), (0.5), (1.0)) a(fx), (VALUES (0.0::DOUBLE), (0.5), (1.0)) b(fy)"

SQL["planned_destinations"] = f"""WITH ca AS (SELECT DISTINCT candidate_id AS id, filename, CAST({C._seconds_sql('created_at')} AS BIGINT) AS created_at FROM import_candidates WHERE candidate_id IS NOT NULL AND filename IS NOT NULL),
w AS (SELECT DISTINCT id, coalesce(strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y/%m/%d'), 'Unsorted') || '/' || CASE WHEN regexp_matches(filename, '.\\.[^.]*$') THEN regexp_replace(filename, '\\.[^.]*$', '') ELSE filename END AS head, regexp_extract(filename, '(\\.[^.]*)$', 1) AS ext FROM ca),
tk AS (SELECT 'Unsorted/IMG_0001.jpg' AS dest), al AS (SELECT dest FROM tk UNION SELECT head || ext FROM w),
g AS (SELECT head, ext, count(*) AS n, (head || ext IN (SELECT dest FROM tk))::INTEGER AS f FROM w GROUP BY head, ext),
k AS (SELECT head, ext, unnest(range(1, n + 50)) AS k FROM g WHERE n + f > 1),
fr AS (SELECT head, ext, k, row_number() OVER (PARTITION BY head, ext ORDER BY k) AS pos FROM k WHERE head || '_' || k || ext NOT IN (SELECT dest FROM al)),
r AS (SELECT w.id, w.head, w.ext, row_number() OVER (PARTITION BY w.head, w.ext ORDER BY w.id) - 1 + g.f AS pos FROM w JOIN g ON g.head = w.head AND g.ext = w.ext)
SELECT r.id, CASE WHEN r.pos = 0 THEN r.head || r.ext ELSE r.head || '_' || fr.k || r.ext END AS destination FROM r LEFT JOIN fr ON fr.head = r.head AND fr.ext = r.ext AND fr.pos = r.pos"""

# changes to small tables


@query("titled_images", "SELECT id, CASE WHEN flagged = 1 THEN 'Pick ' || id ELSE title END AS title, CASE WHEN flagged = 1 THEN true ELSE edited END AS edited FROM img")
def _(s, d):
    imgs = C.images(s, d)
    titles = imgs.where("flagged = 1").select(F.col("id").alias("image_id"), F.concat(F.lit("Pick "), F.col("id").cast("string")).alias("title"))
    return records.put_rows(imgs, titles, edited=True).select("id", "title", "edited")


@query("repaired_covers", "m2 AS (SELECT ai.* FROM ai WHERE NOT (album_id = 2 AND image_id IN (SELECT id FROM img WHERE coalesce(rating, 0) < 2))), f AS (SELECT album_id, first(image_id ORDER BY position, image_id) AS c FROM m2 GROUP BY album_id), o AS (SELECT album_id, first(image_id ORDER BY position, image_id) AS c FROM ai GROUP BY album_id) SELECT al.album_id, CASE WHEN o.c IN (SELECT image_id FROM m2 WHERE m2.album_id = al.album_id) THEN o.c ELSE f.c END AS cover_image_id FROM al LEFT JOIN o ON o.album_id = al.album_id LEFT JOIN f ON f.album_id = al.album_id", ("img", "al"))
def _(s, d):
    imgs = C.images(s, d)
    members = C.album_images(imgs)
    albums = C.albums(s).join(edits.album_covers(members), "album_id", "left").select("album_id", "cover_image_id")
    return records.remove_from_album(albums, members, 2, imgs.where("coalesce(rating, 0) < 2").select("id"))[0]


@query("untagged", "SELECT image_id, tag_id FROM it WHERE NOT (image_id = (SELECT min(image_id) FROM it) AND tag_id IN (SELECT id FROM tg WHERE lower(name) LIKE '%a%'))", ("tg", "it"))
def _(s, d):
    it, tg = C.image_tags(s, d), C.tags(s, d)
    image = it.agg(F.min("image_id")).first()[0] or 0
    names = [r.name for r in tg.join(it.where(F.col("image_id") == image), F.col("id") == F.col("tag_id"), "left_semi").where(F.lower("name").contains("a")).select("name").distinct().collect()]  # one image's tags
    return records.untag_by_names(it, tg, image, names)


@query("xcf_projects", "x AS (SELECT DISTINCT regexp_replace(path, '\\.[^./]*$', '') || '.XCF' AS p FROM img WHERE has_xcf), j AS (SELECT img.id, min(x.p) AS project FROM img JOIN x ON lower(x.p) = lower(regexp_replace(img.path, '\\.[^./]*$', '')) || '.xcf' AND regexp_replace(x.p, '/[^/]*$', '') = regexp_replace(img.path, '/[^/]*$', '') GROUP BY img.id) SELECT id, project FROM j")
def _(s, d):
    imgs = C.images(s, d)
    listing = C.image_rows(s, d).where("has_xcf").select(F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(".XCF")).alias("path"))
    return sidecars.find_project(imgs, listing)


@query("sidecar_places", "SELECT id, CASE WHEN has_sidecar THEN 'lib/' || filename || '.xmp' ELSE 'lib/' || regexp_replace(filename, '\\.[^.]*$', '') || '.xmp' END AS destination FROM img WHERE filename IS NOT NULL AND path IS NOT NULL")
def _(s, d):
    path = F.col("path")
    xmp = F.when(F.col("has_sidecar"), F.concat(path, F.lit(".xmp"))).otherwise(F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".xmp")))
    return C.images(s, d).where("filename is not null and path is not null").select("id", sidecars.sidecar_destination(path, xmp, F.concat(F.lit("lib/"), F.col("filename"))).alias("destination"))


# windows over the event stream's table, as the streams have them


@query("sliding_counts", "w AS (SELECT DISTINCT event_id, epoch_us(ts) AS t FROM events), x AS (SELECT event_id, (t // 600000000 - unnest(range(0, 3))) * 600000000 AS b FROM w) SELECT b // 1000000 AS window_start, count(*) AS n FROM x GROUP BY b", ())
def _(s, d):
    from lumatable.streaming.ingest import sliding_counts

    return sliding_counts(table(s, d, "events").dropDuplicates(["event_id"]), "ts", "30 minutes", "10 minutes").select(F.unix_seconds(F.col("window.start").cast("timestamp")).alias("window_start"), "n")


@query("relinked_paths", "m AS (SELECT id, lower(filename) AS n, size_bytes, hash, row_number() OVER (PARTITION BY lower(filename), size_bytes, hash ORDER BY id) AS rn FROM img WHERE missing), f AS (SELECT DISTINCT '/moved' || path AS path, lower(regexp_replace(path, '^.*/', '')) AS n, size_bytes, hash FROM img), fr AS (SELECT *, row_number() OVER (PARTITION BY n, size_bytes, hash ORDER BY path) AS rn FROM f) SELECT m.id, fr.path FROM m JOIN fr USING (n, size_bytes, hash, rn)")
def _(s, d):
    from lumatable.operators import ingest

    imgs = C.images(s, d)
    moved = imgs.select(F.concat(F.lit("/moved"), F.col("path")).alias("path"), "size_bytes", "hash")
    return ingest.relink(imgs.where("missing"), moved)


_CAND = f"ca AS (SELECT DISTINCT candidate_id AS id, path, filename, size_bytes, CAST({C._seconds_sql('created_at')} AS BIGINT) AS created_at, lower(hash) AS h FROM import_candidates WHERE candidate_id IS NOT NULL)"


@query("import_outcomes", _CAND + ", k AS (SELECT DISTINCT lower(coalesce(original_filename, filename)) AS n, size_bytes AS z, created_at AS t FROM img WHERE created_at IS NOT NULL), o AS (SELECT ca.id, h, CASE WHEN size_bytes <= 0 THEN 'empty' WHEN path IN (SELECT path FROM img WHERE path IS NOT NULL) THEN 'known' WHEN EXISTS (SELECT 1 FROM k WHERE n = lower(filename) AND z = size_bytes AND t = ca.created_at) THEN 'suspected' END AS o FROM ca), f AS (SELECT min(id) AS id FROM o WHERE o IS NULL AND h IS NOT NULL AND h NOT IN (SELECT lower(hash) FROM img WHERE hash IS NOT NULL) GROUP BY h) SELECT id, coalesce(o, CASE WHEN h IS NULL OR id IN (SELECT id FROM f) THEN 'new' ELSE 'duplicate' END) AS outcome FROM o")
def _(s, d):
    from lumatable.operators import ingest

    return ingest.accept(candidates(s, d), C.images(s, d), in_place=True)


@query("thumbnail_gaps", "SELECT hash, min(id) AS id FROM img WHERE hash IS NOT NULL AND NOT coalesce(missing, false) AND hash NOT IN (SELECT hash FROM img WHERE has_thumbhash AND hash IS NOT NULL) GROUP BY hash")
def _(s, d):
    from lumatable.operators import ingest

    rows = C.image_rows(s, d)
    return ingest.thumbnail_gaps(rows, rows.where("has_thumbhash"))


@query("eye_scores", "SELECT image_id, eye_sharpness AS value FROM q WHERE eye_sharpness IS NOT NULL", ("q",))
def _(s, d):
    return quality.scores(C.quality(s, d), "eye_sharpness")


@query("aesthetic_scores", "SELECT image_id, aesthetic AS value FROM q WHERE aesthetic IS NOT NULL", ("q",))
def _(s, d):
    return quality.scores(C.quality(s, d), "aesthetic")


__all__ = ["QUERIES", "SQL"]
