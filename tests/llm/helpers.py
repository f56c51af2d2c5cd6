"""Small inputs shared by the operator tests."""

import duckdb

DOC_SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def docs(spark, rows, extra=False):
    """``rows``: (doc_id, text[, lang, source]); with ``extra`` the table has
    more columns whose names operators might use themselves."""
    full = [(r[0], r[1], *(r[2:] or ("en", "src1")), None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOC_SCHEMA)
    if extra:
        for c in ("id", "n", "k", "kept", "copies", "label", "votes", "rank", "part", "gone_id", "row_sha", "m_domain", "domain", "p_lang"):
            df = df.selectExpr("*", f"'x' AS {c}")
    return df


def duck(sf, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.sql(sql)
    cols = list(rel.columns)
    return cols, rel.fetchall()


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def parquet_rows(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")
