"""Functions on record paths ``<category>/<split>/<type>/<stem>.<ext>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The folder layout and the label words of the inventories.
GOOD_FOLDER = "good"
NORMAL_WORD = "normal"
LAYOUT_FOLDERS = ["train", "test", "ground_truth"]
RECORD_LAYOUT = r"[^/]/(train|test)/[^/]+/[^/]+$"
MASK_RULE = r"/test/([^/]+)/([^/]+)\.[^./]+$"
MASK_TARGET = "/ground_truth/$1/$2_mask.png"
STEM_NUMBER = r"(\d+)(?:_mask)?\.[^./]+$"


def _layout_part(path: Column, place: int) -> Column:
    """One of the last four components (counted from the end), or an empty text outside the layout."""
    parts = F.split(path, "/")
    inside = F.try_element_at(parts, F.lit(-3)).isin(LAYOUT_FOLDERS) & (F.size(parts) >= 4)
    return F.when(inside, F.try_element_at(parts, F.lit(place))).otherwise(F.lit(""))


def path_category(path: Column) -> Column:
    return _layout_part(path, -4)


def path_split(path: Column) -> Column:
    return _layout_part(path, -3)


def path_type(path: Column) -> Column:
    return _layout_part(path, -2)


def folder_label(kind: Column) -> Column:
    """0 for the folder of good items, 1 for any defect folder."""
    return F.when(kind == GOOD_FOLDER, 0).otherwise(1)


def word_label(word: Column) -> Column:
    """0 for the word ``normal``, 1 for any other."""
    return F.when(word == NORMAL_WORD, 0).otherwise(1)


def from_test_folder(path: Column) -> Column:
    return F.concat(F.lit("/"), path).contains("/test/")


def is_test_good(path: Column) -> Column:
    return F.concat(F.lit("/"), path).contains("/test/good/")


def relative_to(path: Column, root: str) -> Column:
    """The path below ``root``; unchanged if it is not below it."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def last_parts(path: Column, k: int = 3) -> Column:
    """The last ``k`` components, joined again (all of them if there are fewer)."""
    parts = F.split(path, "/")
    start = F.greatest(F.size(parts) - F.lit(k), F.lit(0)) + F.lit(1)
    return F.concat_ws("/", F.slice(parts, start, F.lit(k)))


def mask_path(path: Column) -> Column:
    """Where the ground-truth mask of a defect image lies."""
    return F.regexp_replace(path, MASK_RULE, MASK_TARGET)


def file_index(path: Column) -> Column:
    """The number in the file name, or NULL."""
    return F.nullif(F.regexp_extract(path, STEM_NUMBER, 1), F.lit("")).cast("bigint")


def group_label(path: Column) -> Column:
    """train_good, test_good or defect; NULL for ground truth and anything outside the layout."""
    split, kind = path_split(path), path_type(path)
    good = kind == GOOD_FOLDER
    return (
        F.when((split == "train") & good, "train_good")
        .when((split == "test") & good, "test_good")
        .when((split == "test") & ~good, "defect")
    )
