"""Path arithmetic on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A suffix needs a name in front of it: ".json" alone is a hidden file.
_SUFFIX = r"([^/])(\.[^./]+)$"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Last suffix in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(path, _SUFFIX, 2))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), _SUFFIX, "$1")


def with_suffix(path: Column, new: str) -> Column:
    """Replace the last suffix, or append one if there is none."""
    return F.concat(F.regexp_replace(path, _SUFFIX, "$1"), F.lit(new))


def parent(path: Column) -> Column:
    """Folder part without a trailing slash; "." for a bare name, "/" at the root."""
    return F.when(~F.contains(path, F.lit("/")), F.lit(".")).when(
        F.rlike(path, F.lit(r"^/+[^/]*$")), F.lit("/")
    ).otherwise(F.regexp_replace(path, r"/+[^/]*$", ""))


def in_folder(folder: Column, name: Column | str) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return (
        F.when(folder.isin("", "."), name)
        .when(F.endswith(folder, F.lit("/")), F.concat(folder, name))
        .otherwise(F.concat(folder, F.lit("/"), name))
    )


def output_path(path: Column, explicit: Column | None = None) -> Column:
    """Explicit target if given, else the input with a .docx suffix."""
    derived = with_suffix(path, ".docx")
    return derived if explicit is None else F.coalesce(explicit, derived)


def batch_output_path(path: Column, output_dir: str) -> Column:
    """The document's stem as .docx in the output folder."""
    return in_folder(F.lit(output_dir), F.concat(stem(path), F.lit(".docx")))


def dump_path(path: Column) -> Column:
    """Where the text of a rejected document goes."""
    return in_folder(parent(path), F.concat(stem(path), F.lit("_extracted.txt")))
