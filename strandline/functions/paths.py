"""Path and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_scheme(path: Column) -> Column:
    """file:/a and file:///a become /a; other schemes stay."""
    return F.regexp_replace(path, r"^file:(//)?(?=/)", "")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def name_prefix(name: Column, delimiter: str = ".", cut: int = 2) -> Column:
    """The name before its `cut`-th last delimiter; null for names with fewer delimiters."""
    d = "\\" + delimiter
    pattern = "^(.*)" + f"{d}[^{d}]*" * cut + "$"
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1))


def group_id(path: Column, delimiter: str = ".", cut: int = 2) -> Column:
    """Directory and name prefix, with a final '*'; null for names that have no prefix."""
    return F.concat(parent(path), F.lit("/"), name_prefix(basename(path), delimiter, cut), F.lit("*"))


def output_template(group: Column, head: str, output: str | None = None, swaps: dict[str, str] | None = None) -> Column:
    """The group's path below `head`, with whole directory components swapped, below `output`."""
    swaps = {"hist": "tseries"} if swaps is None else swaps
    rest = F.regexp_replace(F.substring(group, len(head.rstrip("/")) + 2, 1 << 20), r"\*$", "")
    parts = F.split(rest, "/")

    def swap(x: Column, i: Column) -> Column:
        out = x
        for old, new in swaps.items():
            out = F.when((x == old) & (i < F.size(parts) - 1), F.lit(new)).otherwise(out)
        return out

    return F.concat(F.lit((output or head).rstrip("/") + "/"), F.array_join(F.transform(parts, swap), "/"))
