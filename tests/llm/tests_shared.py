import math
import os

FOLDER = "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else None


def connect():
    import duckdb

    connection = duckdb.connect()
    for f in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {f[: -len('.parquet')]} AS SELECT * FROM '{FOLDER}/{f}'")
    return connection


def canonical(rows, columns):
    def value(v):
        if isinstance(v, float):
            return "null" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([value(row[i]) for i in order] for row in rows)
