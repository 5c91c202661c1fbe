"""Find the columns of a feed by the names banks give them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch import constants as K


def trimmed(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns]) if any(c != c.strip() for c in df.columns) else df


def find_roles(columns: list[str], roles: dict[str, list[str]]) -> dict[str, str]:
    """Role -> column name of the feed, for the roles the feed has."""
    by_lower = {c.strip().lower(): c for c in columns}
    return {
        role: next(by_lower[a] for a in aliases if a in by_lower)
        for role, aliases in roles.items()
        if any(a in by_lower for a in aliases)
    }


def canonicalise(
    df: DataFrame, roles: dict[str, list[str]], required: tuple[str, ...] = (), keep: bool = True
) -> DataFrame:
    """Rename role columns to their role; other columns stay when `keep`."""
    df = trimmed(df)
    found = find_roles(df.columns, roles)
    absent = [r for r in required if r not in found]
    if absent:
        wanted = "; ".join(f"{r}: one of {', '.join(roles[r])}" for r in absent)
        raise ValueError(f"feed has no column for {wanted}")
    taken = {column: role for role, column in found.items()}
    out = []
    for column in df.columns:
        if column in taken:
            out.append(F.col(f"`{column}`").alias(taken[column]))
        elif keep and column not in found:
            out.append(F.col(f"`{column}`"))
    return df.select(*out)


def transactions(df: DataFrame) -> DataFrame:
    return canonicalise(df, K.TRANSACTION_ROLES, required=("amount",))


def rails(df: DataFrame) -> DataFrame:
    return canonicalise(df, K.RAIL_ROLES, required=("account", "channel"), keep=False)


def alerts(df: DataFrame) -> DataFrame:
    return canonicalise(df, K.ALERT_ROLES, required=("account",))


def regulator_tickets(df: DataFrame) -> DataFrame:
    return canonicalise(df, K.REGULATOR_ROLES, required=("account",), keep=False)
