"""Constraint report over the domain tables.

Each table is scanned once: a row gives its own key, the keys it refers to and
one entry for every required column that is null. All entries are counted by
(table referred to, key) in one partial aggregate, so a hot key is reduced
map-side and no table is joined with another: a key that is stored more than once is a
duplicate, one that is referred to but not stored an orphan. Output rows:
(table, constraint, kind, violations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravan import schemas


def _entries(name: str, df: DataFrame, pk: str | None, refs: list[tuple[int, str, str]], required: list[str]) -> DataFrame:
    """(domain, key, stored, ref): keys stored in a domain, keys referred to by
    foreign key number ``ref``, and nulls (domain ``name.column``, counted as stored)."""
    def entry(domain: str, key: Column, stored: int, ref: int) -> Column:
        return F.struct(F.lit(domain).alias("domain"), key.alias("key"), F.lit(stored).alias("stored"), F.lit(ref).alias("ref"))
    items = [entry(name, F.col(pk).cast("string"), 1, -1)] if pk else []
    items += [entry(parent, F.col(col).cast("string"), 0, k) for k, col, parent in refs]
    items += [entry(f"{name}.{c}", F.when(F.col(c).isNull(), F.lit("")), 1, -1) for c in required]
    rows = df.select(F.explode(F.filter(F.array(*items), lambda e: e["key"].isNotNull())).alias("e"))
    return rows.select("e.*")


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """NOT NULL, primary key and foreign key violations of the given tables."""
    known = {n: df for n, df in tables.items() if n in schemas.TABLES}
    foreign = [(c, col, p) for c, col, p in schemas.FOREIGN_KEYS if c in known and p in known and col in known[c].columns]
    report, parts = [], []  # (table, constraint, kind, column of the counts)
    for name, df in known.items():
        required = [f.name for f in schemas.TABLES[name].fields if not f.nullable and f.name in df.columns]
        pk = schemas.PRIMARY_KEYS.get(name)
        pk = pk if pk in df.columns else None
        refs = [(k, col, p) for k, (c, col, p) in enumerate(foreign) if c == name]
        if pk or refs or required:
            parts.append(_entries(name, df, pk, refs, required))
        report += [(name, f"{c} NOT NULL", "not_null", F.sum(F.when(F.col("domain") == f"{name}.{c}", F.col("stored"))))
                   for c in required]
        if pk:
            report.append((name, f"{pk} PRIMARY KEY", "duplicate_key",
                           F.sum(F.when((F.col("domain") == name) & (F.col("stored") > 0), F.col("stored") - 1))))
    for k, (child, col, parent) in enumerate(foreign):
        report.append((child, f"{col} REFERENCES {parent}(id)", "orphan_fk",
                       F.sum(F.when((F.col("domain") == parent) & (F.col("stored") == 0), F.col(f"ref{k}")))))
    keys = reduce(DataFrame.unionAll, parts).groupBy("domain", "key").agg(
        F.sum("stored").alias("stored"), *[F.count_if(F.col("ref") == k).alias(f"ref{k}") for k in range(len(foreign))])
    wide = keys.agg(*[v.alias(f"v{i}") for i, (_, _, _, v) in enumerate(report)])
    # every row of the report from the one aggregate row
    stack = ", ".join(f"'{t}', '{c}', '{k}', CAST(coalesce(v{i}, 0) AS BIGINT)" for i, (t, c, k, _) in enumerate(report))
    return wide.selectExpr(f"stack({len(report)}, {stack}) AS (table, constraint, kind, violations)")
