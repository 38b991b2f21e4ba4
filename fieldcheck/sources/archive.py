"""What kind of archive a manifest describes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def archive_class(archives: DataFrame, manifest: DataFrame) -> DataFrame:
    """(archive, archive_class) of every archive; ``manifest`` has archive, filename, type ("file" or "directory").

    dta_files: only .dta files, none in a folder. folders: besides the export's readme and the questionnaire's folder only
    folders and .dta files in folders. zips: only .zip files, none in a folder. The first that holds
    counts; an archive without entries is of the first kind, one of no kind has null.
    """
    name = F.col("filename")
    in_folder = F.regexp_replace(name, "/+$", "").contains("/")
    dta, zipped = name.rlike(r"\.dta$"), name.rlike(r"\.zip$")
    aside = name.rlike("export__readme|Questionnaire/")
    found = manifest.groupBy("archive").agg(
        F.bool_and(dta & ~in_folder).alias("all_dta"),
        F.bool_and((F.col("type") == "directory") | (dta & in_folder) | aside).alias("all_folders"),
        F.bool_and(zipped & ~in_folder).alias("all_zips"),
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(True))
    kind = F.when(yes("all_dta"), "dta_files").when(yes("all_folders"), "folders").when(yes("all_zips"), "zips")
    return archives.select("archive").distinct().join(found, "archive", "left").select("archive", kind.alias("archive_class"))
