"""Per-language steps of an analysis: find units, collect their files, parse them, add the unit itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources import items as it
from graphloom.sources import manifests as mf


@dataclass(frozen=True)
class Orchestrator:
    language: str

    def discover(self, files: DataFrame) -> DataFrame:
        """root, manifest, name, dependencies of the units."""
        return mf.read_manifests(mf.discover_units(files, self.language))

    def files(self, files: DataFrame) -> DataFrame:
        """root, path, content of the units' source files."""
        picked = mf.collect_files(files, mf.discover_units(files, self.language), self.language)
        return picked.join(files.select("path", "content"), "path").select("root", "path", "content")

    def analyse(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        return it.parse_files(self.files(files))

    def extra_items(self, files: DataFrame) -> DataFrame:
        """One item for each unit."""
        return self.discover(files).select(F.col("name").alias("qualified_name"), F.lit("service").alias("kind"), F.lit(self.language).alias("sub_kind"), "root")

    def package_files(self, files: DataFrame) -> DataFrame:
        """The older choice of files: those under src if the unit has any there, tests left out."""
        f = self.files(files)
        inside = F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
        f = f.withColumn("in_src", inside.startswith("src/")).filter(~F.col("path").rlike(r"(^|/)tests?/|[._]test\.|\.spec\.|(^|/)test_[^/]*$"))
        any_src = f.filter("in_src").select("root", F.lit(True).alias("has_src")).distinct()
        return f.join(any_src, "root", "left").filter(F.col("in_src") | F.col("has_src").isNull()).select("root", "path")


ORCHESTRATORS = {lang: Orchestrator(lang) for lang in mf.LANGUAGES}
