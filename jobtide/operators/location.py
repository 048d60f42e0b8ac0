"""Places to metros, as an equi-join of n-grams with the alias table.

Each distinct place is normalised once. Canonical text has only words of a-z and 0-9,
so "alias occurs as whole words" is the same as "alias is one of the word n-grams";
the longest alias of the first candidate wins unless a state code rules it out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T


def alias_table(spark) -> DataFrame:
    """(alias, metro, states, rank): longer aliases first, then in table order."""
    rows = [(a, m, R.METRO_STATES.get(m)) for m, names in R.METROS.items() for a in names]
    rows = [(a, m, s, -len(a) * 1000 + i) for i, (a, m, s) in enumerate(rows)]
    return spark.createDataFrame(rows, "alias string, metro string, states array<string>, rank int")


MOST_WORDS = max(len(a.split()) for names in R.METROS.values() for a in names)


def _grams_of(text, k: int):
    words = F.split(text, " ")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(F.size(words) >= k, grams).otherwise(F.array().cast("array<string>"))


def location_dimension(places: DataFrame) -> DataFrame:
    """places(location, remote_hint) -> the distinct pairs with ``location_norm`` and ``remote``."""
    distinct = places.select("location", "remote_hint").distinct()
    named = distinct.withColumn("primary", T.with_state_codes(T.basic_text(T.primary_location("location"))))
    core, country = T.split_country(F.col("primary"))
    named = named.withColumn("core", core).withColumn("country", country)
    named = named.withColumn("state", T.state_of(F.col("core")))
    candidates = F.array(F.struct(F.lit(0).alias("no"), F.col("primary").alias("text")), F.struct(F.lit(1).alias("no"), F.col("core").alias("text")))
    rows = named.select("location", "remote_hint", "state", F.explode(candidates).alias("c"))
    grams = F.concat(*[_grams_of(F.col("c.text"), k) for k in range(1, MOST_WORDS + 1)])
    rows = rows.select("location", "remote_hint", "state", F.col("c.no").alias("no"), F.explode(F.array_distinct(grams)).alias("alias"))
    # the alias table has a fixed size of a few kB
    hits = rows.join(F.broadcast(alias_table(places.sparkSession)), "alias")
    hits = hits.where(F.col("state").isNull() | F.col("states").isNull() | F.array_contains("states", F.col("state")))
    best = hits.groupBy(F.col("location").alias("_place"), F.col("remote_hint").alias("_hint")).agg(F.min_by("metro", F.struct("no", "rank")).alias("metro"))
    out = named.withColumn("remote", T.is_remote("location", "remote_hint")).join(best, F.expr("location <=> _place and remote_hint <=> _hint"), "left")
    first = T.basic_text(T.primary_location("location"))
    norm = (
        F.when((T.basic_text("location") == "") | (F.col("primary") == "") | first.isin(R.PLACELESS), "unknown")
        .when(F.col("core") == "", F.coalesce("country", F.lit("unknown")))
        .when(F.col("metro").isNotNull(), F.col("metro"))
        .when(F.col("state").isNotNull(), F.concat(F.lit("us-"), F.col("state")))
        .when(F.col("remote") | T.has_marker(F.col("core")), "remote")
        .when(F.col("core").rlike(R.PLACEHOLDER), "unknown")
        .otherwise(F.concat_ws("-", F.replace(F.col("core"), F.lit(" "), F.lit("-")), F.col("country")))
    )
    return out.select("location", "remote_hint", norm.alias("location_norm"), "remote")


def with_places(df: DataFrame, places: DataFrame) -> DataFrame:
    """Add ``location_norm`` and ``remote`` to df(location, remote_hint, ...), all of whose places are in ``places``."""
    dimension = location_dimension(places).withColumnsRenamed({"location": "_place", "remote_hint": "_hint"})
    return df.join(dimension, F.expr("location <=> _place and remote_hint <=> _hint"), "left").drop("_place", "_hint")


def normalize_locations(df: DataFrame) -> DataFrame:
    """Add ``location_norm`` to df(location, remote_hint, ...). The dimension holds distinct strings only; Spark broadcasts it while it is small."""
    return with_places(df, df).drop("remote")
