"""Rounding and registration shared by the query modules."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Half-way values go up, and so do values a few units in the last place under them: sums in another order round alike.
HALF = 0.5001


def rounded(df, digits=6):
    """Doubles rounded, counts as 64-bit: two engines' results compare equal. Infinite values and those that are no number stay as they are."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            down = F.floor(F.col(name) * 10.0**digits + HALF) / 10.0**digits
            out.append(F.when(F.abs(name) < float("inf"), down).otherwise(F.col(name)).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(out)


def same_rounding(sql: str) -> str:
    """The SQL with every round(x, k) spelled out as :func:`rounded` does it."""
    while (at := sql.find("round(")) >= 0:
        depth, end, comma = 1, at + 6, -1
        while depth:
            c = sql[end]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = end
            end += 1
        x, k = sql[at + 6 : comma], int(sql[comma + 1 : end - 1])
        sql = f"{sql[:at]}(floor(({x}) * 1e{k} + {HALF}) / 1e{k}){sql[end:]}"
    return sql


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name, query, sql=None):
        self.queries[name] = query
        if sql:
            self.oracles[name] = same_rounding(sql)
