"""Registry of named queries (one per SURVEY §2 operator) and their SQL oracles.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the Spark plan over the whole
driver tables; ``ORACLES[name]`` is an independent DuckDB SQL text over the same
parquet views. Column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skuflow.sources import bases

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn`` under ``name`` with an optional oracle SQL text."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


# DuckDB common-table expressions for the test bases, in dependency order.
_CTE = {
    "B": lambda: bases.duck(bases.B_SQL),
    "P11": lambda: bases.P11_SQL.replace("({B}) b", "B b"),
    "P": lambda: bases.P_SQL.replace("({P11}) p11", "P11 p11"),
    "T": lambda: bases.T_SQL.replace("({B}) b", "B b"),
    "E": lambda: bases.duck(bases.E_SQL),
    "L": lambda: bases.duck(bases.L_SQL),
    "C": lambda: bases.duck(bases.C_SQL),
    "H": lambda: bases.duck(bases.H_SQL),
    "G": lambda: bases.duck(bases.G_SQL),
}
_DEPS = {"P11": ["B"], "P": ["B", "P11"], "T": ["B"]}


def with_bases(*names: str) -> str:
    """``WITH`` clause defining the named bases (and what they depend on) for DuckDB."""
    ordered: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []) + [n]:
            if d not in ordered:
                ordered.append(d)
    return "WITH " + ",\n".join(f"{n} AS ({_CTE[n]()})" for n in ordered) + "\n"
