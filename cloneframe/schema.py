"""Column contract of clone tables, and the checks of arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Chain name to the letter in its column names.
CHAINS = {"alpha": "a", "beta": "b", "gamma": "g", "delta": "d"}
ORGANISMS = ("human", "mouse")
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
#: Columns that never take part in what makes a clone.
NOT_KEYS = ("count", "cell_id", "clone_id", "clone_ix")


def columns_of(chain: str) -> dict[str, str]:
    x = CHAINS[chain]
    return {
        "cdr3": f"cdr3_{x}_aa", "cdr1": f"cdr1_{x}_aa", "cdr2": f"cdr2_{x}_aa", "pmhc": f"pmhc_{x}_aa",
        "v": f"v_{x}_gene", "j": f"j_{x}_gene", "nucseq": f"cdr3_{x}_nucseq",
    }


def check_organism(organism: str) -> None:
    if organism not in ORGANISMS:
        raise ValueError(f"organism must be one of {', '.join(ORGANISMS)}, not {organism!r}")


def check_chains(chains: list[str]) -> None:
    if not chains or any(c not in CHAINS for c in chains):
        raise ValueError(f"chains must be among {', '.join(CHAINS)}, not {chains!r}")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, or ValueError naming the columns that it lacks."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df
