"""Bounded, repeatable samples of labelled rows to fit a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import column


def stratified(rows: DataFrame, class_col: str, id_col: str, per_class: int) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each class, chosen by a hash of the id; and the classes' counts.

    The counts cover all rows. Rows without a class are left out. The table of counts
    has a row per class, as has the model to be fitted.
    """
    rows = rows.where(column(class_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(column(class_col)).count().collect()}
    draw = F.pmod(F.xxhash64(F.lit(17), column(id_col)), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.lit(False)
    for value, count in sorted(counts.items()):
        chosen = chosen | ((column(class_col) == F.lit(value)) & (draw < per_class / count))
    # Rows repeated with one id are drawn together; the limit keeps the bound for those too.
    return rows.where(chosen).limit(2 * per_class * max(1, len(counts))), counts
