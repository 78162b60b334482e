"""A project: sources, settings and the last result's place, as one JSON document that a new version replaces as a whole."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import SparkSession

from echotrace.model import Settings

SCHEMA = 7
#: Settings that documents before a schema version lack; their defaults stand in.
ADDED = {2: ("custom_relative_tolerance_percent", "absolute_tolerance"), 3: ("operation_targets",), 4: ("medium_run_length", "high_run_length"), 5: ("image_analysis_mode",), 6: ("western_single_band_enabled",), 7: ("scan_mode",)}


@dataclass(frozen=True)
class Project:
    name: str
    sources: tuple[str, ...] = ()
    settings: Settings = field(default_factory=Settings)
    result: str | None = None  #: the folder of the last result's tables
    version: str | None = None  #: of the rules that made it

    def with_sources(self, *paths: str) -> Project:
        sources = tuple(sorted({*self.sources, *paths}))
        return self if sources == self.sources else replace(self, sources=sources, result=None)

    def without_source(self, path: str) -> Project:
        return replace(self, sources=tuple(s for s in self.sources if s != path), result=None)

    def with_settings(self, settings: Settings) -> Project:
        return self if settings == self.settings else replace(self, settings=settings, result=None)

    def with_result(self, folder: str, version: str) -> Project:
        return replace(self, result=folder, version=version)


def dumps(project: Project) -> str:
    return json.dumps({"schema": SCHEMA, **asdict(project)}, ensure_ascii=False)


def loads(text: str) -> Project:
    """Of schema versions 1 to 7; ValueError for others."""
    found = json.loads(text)
    version = found.pop("schema", None)
    if not isinstance(version, int) or not 1 <= version <= SCHEMA:
        raise ValueError(f"unknown schema version {version}")
    settings = dict(found.pop("settings", {}) or {})
    for since, names in ADDED.items():
        if version < since:
            settings = {k: v for k, v in settings.items() if k not in names}
    if "operation_targets" in settings:
        settings["operation_targets"] = tuple(settings["operation_targets"])
    return Project(found["name"], tuple(found.get("sources", ())), Settings(**settings), found.get("result"), found.get("version"))


def save(spark: SparkSession, project: Project, path: str) -> None:
    """Written beside the target and renamed over it."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    system = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    draft = place(path + ".draft")
    out = system.create(draft, True)
    out.write(bytearray(dumps(project).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place(path).toUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(draft, place(path), options)


def load(spark: SparkSession, path: str) -> Project:
    return loads("".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()))  # one document
