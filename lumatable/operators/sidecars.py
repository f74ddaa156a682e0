"""Sidecar documents: metadata read from XML, merged into the catalogue field by field, and spread over the files of a shot."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumatable.functions import scalars as S
from lumatable.runtime import ship

FIELDS = "rating int, rejected boolean, title string, description string, orientation int, color_label int, tags array<string>, hierarchical_tags array<string>, edited boolean, creator string, model string"

# The editor's own keyword root, the modules whose use counts as an edit, and the names in the documents.
EDITOR_ROOT = "darktable"
USER_MODULES = ("crop", "clipping", "ashift", "retouch", "vignette", "monochrome", "watermark", "grain", "toneequal", "colorequal", "bilat", "diffuse")
XMP, TIFF, DC, DT, LR, RDF = "http://ns.adobe.com/xap/1.0/", "http://ns.adobe.com/tiff/1.0/", "http://purl.org/dc/elements/1.1/", "http://darktable.sf.net/", "http://ns.adobe.com/lightroom/1.0/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_PREFIXES = {"xmp": XMP, "tiff": TIFF, "dc": DC, "darktable": DT, "lr": LR, "rdf": RDF, "x": "adobe:ns:meta/"}


def _tree(text: str) -> ET.Element | None:
    """The document, with prefixes it uses but does not declare bound to their usual meaning; None where it cannot be read."""
    body = re.sub(r"<\?xpacket.*?\?>", "", text.replace("\x00", "").lstrip("﻿ \r\n\t"), flags=re.S).strip()
    whole = re.search(r"<([A-Za-z]\w*:?\w*)[\s>].*</\1>", body, flags=re.S)  # what stands before or after the document does not matter
    body = whole.group(0) if whole else body
    used, declared = set(re.findall(r"[<\s/]([A-Za-z][\w]*):[A-Za-z]", body)), set(re.findall(r"xmlns:(\w+)=", body))
    extra = " ".join(f'xmlns:{p}="{_PREFIXES.get(p, "urn:" + p)}"' for p in sorted(used - declared - {"xml", "xmlns"}))
    try:
        return ET.fromstring(re.sub(r"^(\s*(?:<\?xml[^>]*\?>\s*)?<[\w:]+)", lambda m: f"{m.group(1)} {extra} ", body, count=1) if extra else body)
    except ET.ParseError:
        return None


def _value(root: ET.Element, ns: str, name: str) -> str | None:
    """A property in attribute or element form."""
    tag = f"{{{ns}}}{name}"
    for e in root.iter():
        if tag in e.attrib:
            return e.attrib[tag]
        if e.tag == tag:
            items = [i.text or "" for i in e.iter(f"{{{RDF}}}li")]
            return items[0] if items else (e.text or "").strip()
    return None


def _list(root: ET.Element, ns: str, name: str) -> list[str] | None:
    for e in root.iter(f"{{{ns}}}{name}"):
        return [i.text or "" for i in e.iter(f"{{{RDF}}}li")]
    return None


def _number(text: str | None) -> int | None:
    try:
        return int(text.strip()) if text is not None else None
    except ValueError:
        return None


def parse_one(text: str | None) -> dict | None:
    """The fields of one sidecar; None where the document is missing or cannot be read. A rating of -1 means rejected, 0 to 5 not
    rejected, others are ignored. Keywords of the editor itself are left out."""
    root = _tree(text) if text else None
    if root is None:
        return None
    rating = _number(_value(root, XMP, "Rating"))
    subjects, paths = _list(root, DC, "subject"), _list(root, LR, "hierarchicalSubject")
    own = {p for s in paths or [] if s.split("|")[0] == EDITOR_ROOT for p in s.split("|")} | {EDITOR_ROOT}
    kept = {p for s in paths or [] if s.split("|")[0] != EDITOR_ROOT for p in s.split("|")}
    label = _value(root, XMP, "Label")
    color = next((i for i, c in enumerate(S.COLORS) if label and c == label.lower()), None)
    if color is None:
        dark = [_number(v) for v in _list(root, DT, "colorlabels") or []]
        color = dark[0] + 1 if dark and dark[0] is not None and 0 <= dark[0] <= 4 else None
    history = [e.attrib.get(f"{{{DT}}}operation") for e in root.iter() if f"{{{DT}}}operation" in e.attrib]
    current, base = _value(root, DT, "history_current_hash"), _value(root, DT, "history_auto_hash")
    edited = None if not history else current != base if current and base else any(h in USER_MODULES for h in history)
    creator = _list(root, DC, "creator")
    return {
        "rating": rating if rating is not None and 0 <= rating <= 5 else None, "rejected": True if rating == -1 else False if rating is not None and 0 <= rating <= 5 else None,
        "title": _value(root, DC, "title"), "description": _value(root, DC, "description"), "orientation": _number(_value(root, TIFF, "Orientation")), "color_label": color,
        "tags": None if subjects is None else [s for s in subjects if s.split("|")[0] != EDITOR_ROOT and (s not in own or s in kept)],
        "hierarchical_tags": None if paths is None else [s for s in paths if s.split("|")[0] != EDITOR_ROOT], "edited": edited, "creator": creator[0] if creator else None, "model": _value(root, TIFF, "Model"),
    }


def read_sidecars(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fields of the sidecar, readable) of XML texts. A document that is no XML gives nulls and readable false, and never fails the job."""
    ship(docs.sparkSession)
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [parse_one(t) for t in b["t"]]
            frame = {n: pd.Series([g.get(n) if g else None for g in got], dtype=object) for n in names}
            yield pd.DataFrame({"k": b["k"]} | frame | {"readable": [g is not None for g in got]})

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k bigint, {FIELDS}, readable boolean").withColumnRenamed("k", key)


def find_sidecar(images: DataFrame, files: DataFrame) -> DataFrame:
    """(id, sidecar) of images (id, path): name.ext.xmp first, then name.xmp."""
    full, short = F.concat("path", F.lit(".xmp")), F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(".xmp"))
    f1, f2 = files.select(F.col("path").alias("a"), F.col("path").alias("a2")), files.select(F.col("path").alias("b"), F.col("path").alias("b2"))
    return images.withColumns({"a": full, "b": short}).join(f1, "a", "left").join(f2, "b", "left").select("id", F.coalesce("a2", "b2").alias("sidecar")).where("sidecar is not null")


def find_project(images: DataFrame, files: DataFrame) -> DataFrame:
    """(id, project) of images (id, path): the editor's project of the same stem beside it, in any case; the smallest of several."""
    key = lambda c: F.lower(F.regexp_replace(c, r"\.[^./]*$", ""))
    there = files.where(S.extension(F.col("path")) == "xcf").groupBy(S.directory(F.col("path")).alias("dir"), key(F.col("path")).alias("key")).agg(F.min("path").alias("project"))
    return images.select("id", S.directory(F.col("path")).alias("dir"), key(F.col("path")).alias("key")).join(there, ["dir", "key"]).select("id", "project")


def sidecar_destination(source: Column, sidecar: Column, destination: Column) -> Column:
    """Where a sidecar goes with its file, in its own way of naming: name.ext.xmp or name.xmp."""
    appended = F.regexp_replace(sidecar, r"^.*/|\.[^./]*$", "") == F.regexp_replace(source, r"^.*/", "")
    return F.concat(F.when(appended, destination).otherwise(F.regexp_replace(destination, r"\.[^./]*$", "")), F.lit(".xmp"))


def stale(images: DataFrame, files: DataFrame) -> DataFrame:
    """(id, sidecar, mtime) of images (id, path, xmp_mtime) whose sidecar among the files (path, mtime) is newer than the one read last;
    a write of one's own is not read again, as its time is recorded."""
    there = find_sidecar(images.select("id", "path"), files.select("path")).join(files.select(F.col("path").alias("sidecar"), "mtime"), "sidecar")
    return images.select("id", "xmp_mtime").join(there, "id").where(is_newer(F.col("xmp_mtime"), F.col("mtime"))).select("id", "sidecar", "mtime")


def after_write(images: DataFrame, written: DataFrame) -> DataFrame:
    """Images after sidecars were written (id, mtime): they have one, and its time."""
    w = written.groupBy("id").agg(F.max("mtime").alias("__mtime"))
    j = images.join(w, "id", "left")
    return j.withColumns({"xmp_mtime": F.coalesce("__mtime", "xmp_mtime"), "has_sidecar": F.when(F.col("__mtime").isNotNull(), True).otherwise(F.col("has_sidecar"))}).select(*images.columns)


def repair_keyword_tags(tags: DataFrame, image_tags: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags and their use without the editor's own keywords, which had become tags of images: of each image with the editor's root as
    a tag, those that its sidecar (documents: image_id, paths) has only below that root. Tags then left on no image and without
    children go. Running it again changes nothing."""
    root = tags.where(F.lower("name") == EDITOR_ROOT).select(F.col("id").alias("tag_id"))
    hit = image_tags.join(root, "tag_id", "left_semi").select("image_id").distinct()
    own = lambda keep: F.filter("paths", lambda p: F.contains(p, F.lit("|")) & (F.lower(p).startswith(EDITOR_ROOT + "|") == F.lit(keep)))
    words = lambda keep: F.transform(F.flatten(F.transform(own(keep), lambda p: F.split(p, r"\|"))), lambda p: F.lower(F.trim(p)))
    internal = documents.join(hit, "image_id", "left_semi").where("paths is not null").select("image_id", F.explode(F.array_union(F.array_except(words(True), words(False)), F.array(F.lit(EDITOR_ROOT)))).alias("key"))
    named = tags.select(F.col("id").alias("tag_id"), F.lower(F.trim("name")).alias("key"))
    gone = internal.join(named, "key").select("image_id", "tag_id").distinct()
    used = image_tags.join(gone, ["image_id", "tag_id"], "left_anti").select(*image_tags.columns)
    unused = gone.select(F.col("tag_id").alias("id")).distinct().join(used.select(F.col("tag_id").alias("id")), "id", "left_anti").join(tags.select(F.col("parent_id").alias("id")), "id", "left_anti")
    return tags.join(unused, "id", "left_anti"), used


def is_newer(stored: Column, mtime: Column) -> Column:
    return stored.isNull() | (mtime > stored)


def update_from_sidecars(images: DataFrame, read: DataFrame) -> DataFrame:
    """Images (id, rating, flagged, title, description, orientation, color_label, xmp_mtime) after applying newer sidecars (id, the
    fields, mtime): a field the sidecar is silent about is kept; not rejected clears only a reject."""
    s = read.select("id", *(F.col(c).alias(f"s_{c}") for c in ("rating", "rejected", "title", "description", "orientation", "color_label", "mtime")))
    j = images.join(s, "id", "left").withColumn("go", F.col("s_mtime").isNotNull() & is_newer(F.col("xmp_mtime"), F.col("s_mtime")))
    new = lambda c: F.when(F.col("go"), F.coalesce(f"s_{c}", c)).otherwise(F.col(c)).alias(c)
    flag = F.when(F.col("go") & F.col("s_rejected"), -1).when(F.col("go") & (F.col("s_rejected") == F.lit(False)) & (F.col("flagged") == -1), 0).otherwise(F.col("flagged")).cast("int").alias("flagged")
    return j.select("id", new("rating"), flag, new("title"), new("description"), new("orientation"), new("color_label"), F.when(F.col("go"), F.col("s_mtime")).otherwise(F.col("xmp_mtime")).alias("xmp_mtime"))


def replace_keywords(image_tag_names: DataFrame, read: DataFrame) -> DataFrame:
    """(id, name) after sidecars (id, tags, hierarchical_tags): a keyword set replaces an image's tags only if present; flat tags that are
    ancestors in a hierarchical one are skipped."""
    spoken = read.where("tags is not null or hierarchical_tags is not null")
    paths = F.coalesce("hierarchical_tags", F.array().cast("array<string>"))
    ancestors = F.flatten(F.transform(paths, lambda p: F.slice(F.split(p, r"\|"), 1, F.size(F.split(p, r"\|")) - 1)))
    leaves = F.transform(paths, lambda p: F.element_at(F.split(p, r"\|"), -1))
    names = F.array_union(F.array_except(F.coalesce("tags", F.array().cast("array<string>")), ancestors), leaves)
    fresh = spoken.select("id", F.explode(names).alias("name"))
    return image_tag_names.join(spoken.select("id"), "id", "left_anti").unionByName(fresh).distinct()


def merge_keywords(document: Column, known: Column, wanted: Column) -> Column:
    """A document's keywords after writing: those the library does not know stay, known ones follow the library."""
    return F.array_union(F.array_except(document, known), wanted)


def fill_copyright(document: Column, value: Column) -> Column:
    return F.when(F.coalesce(F.trim(document), F.lit("")) == "", value).otherwise(document)


def reconcile_shots(images: DataFrame) -> DataFrame:
    """(id, rating, flagged, color_label) after agreement within shots: the highest rating; a flag or colour spreads where all that
    are set agree, and conflicts are left alone."""
    one = lambda c: F.when(F.min(F.when(F.col(c) != 0, F.col(c))) == F.max(F.when(F.col(c) != 0, F.col(c))), F.max(F.when(F.col(c) != 0, F.col(c)))).alias(f"m_{c}")
    m = images.where("group_hash is not null").groupBy("group_hash").agg(F.max("rating").alias("m_rating"), one("flagged"), one("color_label"))
    j = images.join(m, "group_hash", "left")
    return j.select("id", *(F.coalesce(f"m_{c}", c).alias(c) for c in ("rating", "flagged", "color_label")))


def spread_cull(images: DataFrame, spoken: DataFrame) -> DataFrame:
    """(id, rating, flagged, color_label): fields one file's sidecar spoke about (spoken: id, rating, flagged, color_label, null where
    silent) are copied to all files of its shot; of several sidecars of a shot, the one of the largest id counts."""
    fields = ("rating", "flagged", "color_label")
    said = images.select("id", "shot_key").join(spoken, "id").groupBy("shot_key").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"s_{c}") for c in fields))
    return images.join(said, "shot_key", "left").select("id", *(F.coalesce(f"s_{c}", c).alias(c) for c in fields))
