"""The top-k query and its SQL on rows that the given tables do not hold."""

import duckdb
import numpy as np

from ridgeline.llm import topk as K
from tests.test_oracles import _norm


def test_wide_vectors_and_repeated_queries(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(1, 160)]
    rows += [(i, (rng.normal(0, 1, 6) * 1e7).tolist()) for i in range(160, 171)]
    rows += [rows[49], rows[49], (50, rng.normal(0, 1, 6).tolist()), (100, [1e7, 0.0, 0.0, 0.0, 0.0, 1.0]), (7, rows[6][1]), (150, None), (8, [1.0, None] * 3), (0, [float("nan")] * 6)]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, label int").repartition(3).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/*.parquet'")
    cur = con.execute(K.OP8_SQL)
    cols, df = [d[0] for d in cur.description], K.op8_bit_sliced_top_k(spark, str(tmp_path))
    got = _norm([tuple(r) for r in df.collect()], df.columns)
    assert got == _norm(cur.fetchall(), cols) and len(got) == 5 * (2 + 2 + 1)
