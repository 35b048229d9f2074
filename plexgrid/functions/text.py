"""Names: genes, cell ids, channels, repeated names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Genes that are left out of counts, by the beginning of their name. Fixed value.
EXCLUDED = "nan|<NA>|.*control.*|blank.*|antisense.*|unassigned.*|deprecated.*|intergenic.*|false.*|neg.*"
_letters = "abcdefghijklmnop"


def excluded(gene: str = "gene", pattern: str | None = EXCLUDED) -> Column:
    """True for genes whose name begins with a match, letter case aside; null genes too."""
    if pattern is None:
        return F.lit(False)
    return F.coalesce(F.col(gene).rlike(f"(?i)^(?:{pattern})"), F.lit(True))


def gene_category(gene: str = "gene") -> Column:
    """``negative_control``, ``blank``, ``deprecated`` or ``gene``: the first that fits; null names are genes."""
    g = F.lower(F.col(gene))
    return (  # fixed values
        F.when(g.rlike("negcontrol|negprobe"), "negative_control")
        .when(g.contains("blank"), "blank")
        .when(g.rlike("systemcontrol|falsecode"), "deprecated")
        .otherwise("gene")
    )


# The viewer's categories of genes, in the order of their columns.
GENE_FLAGS = (
    "is_gene",
    "is_negative_control_probe",
    "is_negative_control_codeword",
    "is_deprecated",
    "is_predicted_false_positive",
    "is_unassigned_codeword",
    "is_blank_codeword",
    "is_anti_sense",
    "is_genomic_control",
)


def gene_flags(gene: str = "gene") -> dict[str, Column]:
    """Nine columns of which one is true: that of the gene's category. Categories that no name tells of are false."""
    column = {"gene": "is_gene", "negative_control": "is_negative_control_probe", "deprecated": "is_deprecated", "blank": "is_blank_codeword"}
    own = {flag: gene_category(gene) == kind for kind, flag in column.items()}
    return {flag: own.get(flag, F.lit(False)) for flag in GENE_FLAGS}


def cell_name(number: str) -> Column:
    """Eight letters a..p, base 16, and a suffix."""
    digits = F.lpad(F.lower(F.hex(F.col(number))), 8, "0")
    return F.concat(F.translate(digits, "0123456789abcdef", _letters), F.lit("-1"))


def cell_number(name: str) -> Column:
    return F.conv(F.translate(F.substring(F.col(name), 1, 8), _letters, "0123456789abcdef"), 16, 10).cast("long")


def is_cell_name(name: str) -> Column:
    return F.coalesce(F.col(name).rlike("^[A-Za-z]{8}(-.)?$"), F.lit(False))


def channel_name(name: str, n_channels: Column | int | None = None) -> Column:
    """Slashes become underscores; the number of a lone channel becomes DAPI."""
    c = F.regexp_replace(F.col(name).cast("string"), "/", "_")
    if n_channels is None:
        return c
    one = (F.lit(n_channels) if isinstance(n_channels, int) else n_channels) == 1
    return F.when(one & c.rlike("^[0-9]+$"), "DAPI").otherwise(c)


def wavelength(name: str) -> Column:
    """The three digits that stand alone in a channel's name, or null."""
    found = F.regexp_extract(F.col(name), r"(?<![0-9])([0-9]{3})(?![0-9])", 1)
    return F.when(found != "", found.cast("int"))


def dedup_names(df: DataFrame, name: str, position: str, partition: list[str] | None = None) -> DataFrame:
    """The k-th repeat of a name gets the suffix `` (k)``, from the second occurrence on."""
    k = F.row_number().over(Window.partitionBy(*(partition or []), name).orderBy(position)) - 1
    return df.withColumn(name, F.when(k > 0, F.concat(F.col(name), F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(F.col(name)))
