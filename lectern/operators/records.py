"""Predicates and rules over stored rows: matches by name and text, row look-ups, soft deletes, cascades, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import cell_escape


def holds_any(text: Column, terms: list[str]) -> Column:
    """Whether a text holds one of the terms as it stands; their wildcards mean nothing (P4, F15). Without terms nothing holds."""
    return F.exists(F.array(*map(F.lit, terms)), lambda t: text.contains(t)) if terms else F.lit(False)


def names_like(nodes: DataFrame, terms: list[str], most: int, name: str = "name_normalized") -> DataFrame:
    """Distinct names that hold a term, the shortest first."""
    return nodes.filter(holds_any(F.col(name), terms)).select(name).distinct().orderBy(F.length(name), name).limit(most)


def holds_row(chunk: Column, rows: list[int]) -> Column:
    """Whether a chunk of a sheet has one of the numbered rows (P5)."""
    return holds_any(chunk, [f"\nrow {r}:" for r in rows])


def active(rows: DataFrame, deleted: str = "is_delete") -> DataFrame:
    """Rows that are not marked as deleted (P8, K20); a mark that is not set counts as no."""
    return rows.filter(~F.coalesce(F.col(deleted), F.lit(False)))


def without(rows: DataFrame, gone: DataFrame, by: dict[str, str]) -> DataFrame:
    """Rows of which the parents are not among ``gone``; ``by`` is own column -> parents' column (K9)."""
    keys = gone.select(*[F.col(parent).alias(f"_{own}") for own, parent in by.items()]).distinct()
    same = None
    for own in by:
        same = (F.col(own) == F.col(f"_{own}")) if same is None else same & (F.col(own) == F.col(f"_{own}"))
    return rows.join(keys, same, "left_anti")


def updated(new: Column, old: Column, empty: str = "") -> Column:
    """The new value, or the old one where none is given."""
    return F.coalesce(F.nullif(new, F.lit(empty)), old)


def settings(text: Column, schema: str) -> Column:
    """Stored JSON settings as a struct; what does not parse is null."""
    return F.from_json(text, schema)


#: Fixed value: colours of the groups of a graph page, in turn; the last is for all others.
COLOURS = ("red", "blue", "grey")


def page_nodes(nodes: DataFrame, files: DataFrame, key: str, file_key: str, name: str, file_name: str) -> DataFrame:
    """``label, file, colour`` of a graph page's nodes; a node of an unknown file has ``-``."""
    out = nodes.join(files, nodes[key] == files[file_key], "left")
    colour = F.lit(COLOURS[-1])
    for k in reversed(range(len(COLOURS) - 1)):
        colour = F.when(F.col(key) == k, COLOURS[k]).otherwise(colour)
    return out.select(F.col(name).alias("label"), F.coalesce(F.col(file_name), F.lit("-")).alias("file"), colour.alias("colour"))


def sheet_markdown(rows: DataFrame, by: list[str], row: str, cells: list[str], letters: list[str], title: Column) -> DataFrame:
    """``by, text``: the rows of a sheet (``cells`` as text, null for none) as a Markdown table under a title, as a spreadsheet's is."""
    told = F.concat(F.lit("| "), F.col(row).cast("string"), F.lit(" | "), F.concat_ws(" | ", *[cell_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cells]), F.lit(" |"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), told.alias("t")))), lambda x: x["t"]), "\n")
    head = f"| row | {' | '.join(letters)} |\n| --- |{' --- |' * len(letters)}\n"
    return rows.groupBy(*by).agg(lines.alias("_body")).select(*by, F.concat(F.lit("# "), title, F.lit("\n\n" + head), F.col("_body")).alias("text"))
