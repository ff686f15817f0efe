"""Connected components of an edge table, without any collection of edges or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import paths


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges`` (a, b of one ordered type) to (node, root): the smallest node of each component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each
    written to the shared folder; the number of rounds grows with the logarithm
    of the longest chain.  A star's centre meets its leaves only in an
    aggregation with a map-side minimum and in joins with one row a centre.
    """
    return paths.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
