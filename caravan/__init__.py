"""caravan: Spark-first analytics for group-travel commerce tables.

Trips run in dated batches (departures); users book seats in batches; coupons,
leads, banners and media objects complete the data model. Every operator is a
set-oriented DataFrame job (one call handles all trips / requests / attempts).
"""

__version__ = "0.1.0"
