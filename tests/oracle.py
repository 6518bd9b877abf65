"""Side by side: a query in Spark and its SQL in DuckDB over one dataset folder."""

import re
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def connect(folder: Path):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in folder.glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path if path.is_file() else str(path) + '/*.parquet'}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(6)
    text = df.astype(object).where(df.notna(), None).values.tolist()
    return sorted(re.sub(r"(\d)\.0\b", r"\1", str(r)) for r in text)
