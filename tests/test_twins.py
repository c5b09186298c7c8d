"""Queries against their SQL on small tables of odd rows."""

from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def differ(spark, folder, name, **tables):
    """Rows of the query that its SQL doesn't have, and the other way round."""
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = Counter(tuple(r) for r in entry.queries()[name](spark, str(folder)).select(*names).collect())
    want = Counter(map(tuple, want.fetchall()))
    assert want
    return got - want, want - got


def test_images_that_share_a_path(spark, tmp_path):
    urls = ["https://a.org/1", "https://a.org/1", "https://b.org", "https://a.org/1", "https://b.org", "https://c.org", "https://d.org"]
    pages = {"page_id": list(range(6, 13)), "url": urls, "html": [""] * 7}
    assert not any(differ(spark, tmp_path, "image_rejections", pages=pages))


def test_tags_beyond_the_usual_most(spark, tmp_path):
    """More than 5,000 tags are compared, all of them."""
    x = np.random.default_rng(2).normal(size=(8600, 24)).astype(np.float32)
    x[8000:8600:7] = x[1:602:7] + 0.01
    embeddings = {"vec_id": list(range(8600)), "label": [0] * 8600, "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))}
    assert not any(differ(spark, tmp_path, "semantic_tags", embeddings=embeddings))


def test_excerpt_keeps_a_line_s_digits(spark, tmp_path):
    texts = ["at 10\n101 or 11\n\n 22 and 2 \nmore", "0", "", " \n ", "3" * 300 + " 1\n1"]
    n = len(texts)
    documents = {"doc_id": list(range(n)), "text": texts, "lang": ["en"] * n, "source": ["a"] * n, "n_chars": [len(t) for t in texts]}
    assert not any(differ(spark, tmp_path, "fn_body_excerpt", documents=documents))
