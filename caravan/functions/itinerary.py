"""itinerary JSON text -> one row per day.

The trips table stores the itinerary as JSON text (day number -> {title,
content}); the reference only checks that it parses. Here it becomes a table
(trip_id, day, day_no, title, content) plus a reject table of texts that do
not parse. Strict mode follows ``JSON.parse`` (double-quoted names only, no
single quotes, no NaN, nothing after the closing brace); ``lenient=True``
also reads unquoted field names, as in the seed texts. A day repeated in one
text keeps its last value, as ``JSON.parse`` does; the "last" is found with a
partial aggregate (max_by over the entry position).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravan.functions.columns import json_text_ok, js_trim

ITINERARY_SCHEMA = "map<string, struct<title:string, content:string>>"
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
          "allowUnquotedFieldNames": "false"}
LENIENT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
           "allowUnquotedFieldNames": "true"}


def itinerary_table(trips: DataFrame, lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """(days, rejects): days = (trip_id, day, day_no, title, content);
    rejects = (trip_id, itinerary) whose text is not a valid itinerary object."""
    text = F.col("itinerary")
    options = LENIENT if lenient else STRICT
    m = F.from_json(text, ITINERARY_SCHEMA, options)
    closed = js_trim(text).endswith("}") & json_text_ok(text, options)
    parsed = trips.select(F.col("id").alias("trip_id"), "itinerary",
                          F.when(closed, m).alias("_m"))
    rejects = parsed.where(F.col("_m").isNull() & text.isNotNull()).select("trip_id", "itinerary")
    entries = parsed.where(F.col("_m").isNotNull()).select(
        "trip_id", F.posexplode(F.map_entries("_m")).alias("_pos", "_e"))
    last = (entries.groupBy("trip_id", F.col("_e.key").alias("day"))
            .agg(F.max_by(F.col("_e.value"), F.col("_pos")).alias("_v")))
    days = last.select("trip_id", "day", F.col("day").try_cast("int").alias("day_no"),
                       F.col("_v.title").alias("title"), F.col("_v.content").alias("content"))
    return days, rejects
