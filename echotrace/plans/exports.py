"""Report tables, as DataFrames, and their sinks."""

from __future__ import annotations

import html as _html
import json
import math
import os
import re
from collections.abc import Callable, Iterable
from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echotrace.functions.expr import risk_order
from echotrace.plans import evidence, quality, review
from echotrace.plans.project import Project
from echotrace.sources.sheets import letters

#: Findings an HTML report shows at most.
HTML_LIMIT = 120
REPORT_VERSION = 1


def overview(findings: DataFrame) -> DataFrame:
    return findings.agg(
        F.count("*").alias("findings"), *(F.count_if(F.col("risk") == r).alias(r) for r in ("high", "medium", "low")),
        F.count_if(F.col("review_status") != "pending").alias("reviewed"), F.count_if(F.col("finding_type") == "normal_relation").alias("normal"),
    )


def numeric_evidence(findings: DataFrame) -> DataFrame:
    """One row for each location of a spreadsheet finding."""
    some = findings.where(F.col("rule_id").startswith("excel."))
    return some.select("finding_id", "rule_id", F.posexplode("locations").alias("position", "l")).select("finding_id", "rule_id", (F.col("position") + 1).alias("position"), "l.source_path", "l.sheet", "l.coordinate", "l.hidden_sheet")


#: The columns of image evidence that are fields of the details under one of these names.
IMAGE_FIELDS = {
    "first_band_count": ("first_bands",), "second_band_count": ("second_bands",), "matched_band_count": ("matched_bands",), "structure_similarity": ("structure",), "geometry_similarity": ("geometry",),
    "background_similarity": ("background",), "mask_iou": ("mask_iou",), "transform": ("transform",), "single_band_mode": ("single_band_mode",), "evidence_kind": ("evidence_kind",), "relationship_class": ("relationship_class",),
    "first_channel": ("first_channel",), "second_channel": ("second_channel",), "normalized_mutual_information": ("mutual_information",), "alignment_shift": ("alignment_shift",), "first_magnification": ("first_magnification",),
    "second_magnification": ("second_magnification",), "estimated_scale_ratio": ("magnification_ratio", "window_ratio"), "first_tissue_fraction": ("first_score",), "second_tissue_fraction": ("second_score",), "first_spot_count": ("first_spots",), "second_spot_count": ("second_spots",),
    "matched_spot_count": ("matched_spots",), "layout_similarity": ("layout",), "profile_similarity": ("profile",), "layout_error": ("layout_error",), "appearance_similarity": ("appearance",), "minimum_spot_similarity": ("least_spot",),
    "scale_second_to_first": ("spot_scale",), "rotation_degrees_second_to_first": ("spot_rotation",), "mirrored": ("mirrored",),
}


def image_evidence(findings: DataFrame) -> DataFrame:
    """One row for each finding of the blot, dot, fluorescence and tissue rules: both pages, both regions, and what was measured; null where a rule doesn't measure it."""
    some = findings.where(F.col("rule_id").rlike(r"^image\.(western_blot|dot_blot|fluorescence|pathology)\."))
    page = lambda i, f: F.get(F.col("locations"), i)[f]
    found = {k: F.coalesce(*(F.get_json_object("details", f"$.{n}") for n in names)) for k, names in IMAGE_FIELDS.items()}
    found["evidence_kind"] = F.regexp_extract("rule_id", r"^image\.([a-z_]+)\.", 1)
    found["relationship_class"] = F.regexp_extract("rule_id", r"([a-z_]+)$", 1)
    found["single_band_mode"] = F.col("rule_id").endswith(".single_band")
    found["mirrored"] = F.coalesce(found["mirrored"].cast("boolean"), F.lit(False))
    ends = {}
    for i, s in enumerate(("first", "second")):
        ends |= {f"{s}_source": page(i, "source_path"), f"{s}_page": page(i, "coordinate"), f"{s}_region": F.get_json_object("details", f"$.{s}_region"), f"{s}_band_count": found.pop(f"{s}_band_count")}
    return some.select("finding_id", "rule_id", *(v.alias(k) for k, v in (ends | found).items()))


def _other_than(name: str) -> Callable[[Column, Column], Column]:
    return lambda k, _: k != name


def _summary(most: int = 32_000) -> Column:
    """The details as text that fits a cell: long lists as their number of entries, then cut at `most` characters."""
    short = F.col("details")
    for name, field in (("cells", evidence.CELL), ("paired_values", evidence.PAIR)):
        n = F.size(F.get(F.array(F.from_json("details", f"{name} array<struct<{field}>>")), 0)[name])
        plain = F.from_json(short, "map<string,string>")
        short = F.when(n >= 0, F.to_json(F.map_concat(F.map_filter(plain, _other_than(name)), F.create_map(F.lit(name), F.concat(n.cast("string"), F.lit(" rows, see the numeric evidence")))))).otherwise(short)
    return F.when(F.length(short) <= most, short).otherwise(F.concat(F.substring(short, 1, most - 20), F.lit("... (cut)")))


def details_summary(findings: DataFrame, most: int = 32_000) -> DataFrame:
    return findings.select("finding_id", _summary(most).alias("details"))


def feedback(findings: DataFrame) -> DataFrame:
    """Findings with a review mark; ValueError if there are none."""
    out = review.marked(findings).select("finding_id", "review_status", "rule_id", "risk", "finding_type", "title", "description", "confidence", "locations", "details")
    if out.isEmpty():
        raise ValueError("no finding has been reviewed")
    return out


def feedback_summary(findings: DataFrame) -> DataFrame:
    marks = {"marked": F.count("*"), **{s: F.count_if(F.col("review_status") == s) for s in review.STATUSES[1:]}}
    return review.marked(findings).agg(*(v.alias(k) for k, v in marks.items()))


def _items(pairs: dict[str, object], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in pairs.items()], "item string, content string")


def _about(project: Project | None, version: str) -> dict[str, object]:
    now = datetime.now(UTC).isoformat()
    return {"schema_version": REPORT_VERSION, "rules_version": version, "generated_at": now, "project": project.name if project else None}


def save_feedback(findings: DataFrame, path: str, project: Project | None = None, version: str = "") -> str:
    """The marked findings with their counts, as JSON or else as a workbook, row by row in the driver; written beside the path and renamed. Returns the path."""
    rows, about = feedback(findings), _about(project, version)
    counts = feedback_summary(findings).first().asDict()
    path = path if path.endswith((".json", ".xlsx")) else f"{path}.xlsx"
    if path.endswith(".xlsx"):
        flat = rows.withColumn("places", F.array_join(F.transform("locations", lambda x: F.concat_ws(" ", x.source_path, x.sheet, x.coordinate)), "\n"))
        flat = flat.select("finding_id", "review_status", "risk", "finding_type", "rule_id", "title", "description", "confidence", "places", F.to_json("locations").alias("locations"), "details")
        write_xlsx({"Overview": _items(about | counts, findings.sparkSession), "Feedback": flat}, path)
        return path
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as out:
        head = json.dumps({**about, "summary": counts, "raw_files_included": False}, ensure_ascii=False)
        out.write(head[:-1] + ', "feedback": [')
        for i, r in enumerate(rows.toLocalIterator()):
            one = r.asDict(recursive=True)
            one["evidence"] = json.loads(one.pop("details"))
            out.write(("," if i else "") + "\n" + json.dumps(one, ensure_ascii=False))
        out.write("]}\n")
    os.replace(part, path)
    return path


def report(findings: DataFrame, issues: DataFrame, project: Project | None = None, version: str = "") -> dict[str, DataFrame]:
    """The six sheets of a report: overview, findings, image and numeric evidence, issues, sources."""
    spark, order = findings.sparkSession, quality.result_order() if "matched_count" in findings.columns else [risk_order(F.col("risk")), F.col("finding_id")]
    settings = asdict(project.settings) if project else {}
    about = _items(_about(project, version) | settings, spark)
    items = lambda df: df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("content")) for c in df.columns))))
    counts = items(overview(findings)).unionByName(items(issues.agg(F.count("*").alias("issues"))))
    place = lambda x: F.concat_ws(" ", x.source_path, x.sheet, x.coordinate)
    tier = F.col("attention_tier") if "attention_tier" in findings.columns else F.lit(None).cast("string")
    listed = findings.orderBy(*order).select(
        "finding_id", "risk", "finding_type", "rule_id", "title", "description", "confidence", F.get(F.transform("locations", place), 0).alias("place_1"), F.get(F.transform("locations", place), 1).alias("place_2"),
        F.array_join(F.slice(F.transform("locations", place), 3, F.greatest(F.size("locations"), F.lit(1))), "\n").alias("more_places"), _summary().alias("details"), "review_status", tier.alias("attention_tier"),
    )
    return {
        "Overview": about.unionByName(counts), "Findings": listed, "Image evidence": image_evidence(findings), "Numeric evidence": evidence.rows(findings).orderBy("finding_id", "place"),
        "Issues": issues.select("severity", "source_path", "message"), "Sources": spark.createDataFrame(list(enumerate(project.sources if project else (), 1)), "place int, path string"),
    }


def stage_ranking(stages: DataFrame) -> DataFrame:
    """stage_id, duration_seconds, calls, items with rank and share of all time. Input rows may repeat a stage."""
    summed = stages.groupBy("stage_id").agg(F.sum("duration_seconds").alias("duration_seconds"), F.sum("calls").alias("calls"), F.sum("items").alias("items"))
    whole = F.sum("duration_seconds").over(Window.partitionBy())
    return summed.withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("duration_seconds"), "stage_id")), "share": F.round(F.coalesce(F.try_divide("duration_seconds", whole), F.lit(0.0)), 6)})


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet below the folder, each committed as a whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def save_json(findings: DataFrame, folder: str) -> None:
    findings.write.mode("overwrite").json(folder)


def html_report(findings: DataFrame, order: list) -> str:
    """One page with the first HTML_LIMIT findings and the counts of all."""
    counts = overview(findings).first().asDict()
    rows = findings.orderBy(*order).limit(HTML_LIMIT).select("finding_id", "rule_id", "risk", "title", "description").collect()
    cell = lambda x: f"<td>{_html.escape(str(x))}</td>"
    body = "".join(f'<tr data-risk="{r.risk}">' + "".join(cell(x) for x in r) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Findings</title></head><body><p>{_html.escape(str(counts))}</p><table>{body}</table></body></html>"


def write_xlsx(tables: dict[str, DataFrame], path: str, most: int = 1_048_575) -> None:
    """A workbook with a sheet for each table, written in the driver row by row; a sheet ends at the format's last row. Renamed over the path when whole."""
    import zipfile
    from xml.sax.saxutils import escape, quoteattr

    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(x: object, at: str) -> str:
        if x is None:
            return ""
        if isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x):
            return f'<c r="{at}"><v>{x}</v></c>'
        text = re.sub("[^\\t\\n\\r -\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "", str(x)[:32_000])
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    def line(n: int, values: Iterable[object]) -> bytes:
        return f'<row r="{n}">{"".join(cell(x, f"{letters(c)}{n}") for c, x in enumerate(values, 1))}</row>'.encode()

    with zipfile.ZipFile(f"{path}.part", "w", zipfile.ZIP_DEFLATED) as book:
        names = list(tables)
        kinds = "".join(f'<Override PartName="/xl/worksheets/s{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names)))
        book.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, name in enumerate(names):
            df = tables[name]
            with book.open(f"xl/worksheets/s{i}.xml", "w") as out:
                out.write(f'<worksheet xmlns="{ns}"><sheetData>'.encode() + line(1, df.columns))
                for n, r in enumerate(df.limit(most).toLocalIterator(), 2):
                    out.write(line(n, r))
                out.write(b"</sheetData></worksheet>")
    os.replace(f"{path}.part", path)
