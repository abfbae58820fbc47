"""The smallest ids of linked classes, by :func:`eddystream.operators.components.components`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddystream.llm.common import stored
from eddystream.operators.components import components


def smallest_ids(members: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """(id, first): the smallest id reachable from each id of ``members`` (id, cls), rows of a class and linked classes hanging together.

    ``links`` are pairs of classes. An id that is in several classes ties them.
    """
    found = components(links, f"{label}-classes")
    named = members.join(found, members["cls"] == found["node"], "left").select("id", F.coalesce("component", "cls").alias("cls"))
    named = stored(named.distinct(), f"{label}-members")
    least = stored(named.groupBy("cls").agg(F.min("id").alias("first")), f"{label}-least")
    joined = named.join(least, "cls").select("id", "first").distinct()
    if joined.groupBy("id").count().where("count > 1").limit(1).count():
        tied = components(joined, f"{label}-tied")
        joined = joined.select("id").distinct().join(tied, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("first"))
    return joined
