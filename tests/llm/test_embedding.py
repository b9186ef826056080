import numpy as np
from millrace.llm import embedding
from millrace.llm.queries import op8_embedding
from pyspark.sql import functions as F


def brute(rows, least=0.93):
    ok = lambda e, lab: lab is not None and e is not None and len(e) and all(v is not None and np.isfinite(v) for v in e) and any(e)
    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            (_, a, s), (_, b, t) = rows[i], rows[j]
            if s == t and ok(a, s) and ok(b, t) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least or (a == b):
                    links[i].append(j)
                    links[j].append(i)
    out = []
    for i, (v, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min(rows[j][0] for j in seen)
        out.append((v, len(links[i]), c, v == c))
    return sorted(out)


def test_small(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8))
    rows = [(i * 37 % 1009, (base[i % 30] + rng.normal(size=8) * 0.15).astype("f4").tolist(), int(i % 2)) for i in range(150)]
    rows += [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [float("nan")] + [1.0] * 7, 1), (2003, [float("inf")] + [1.0] * 7, 1), (2004, [None] + [1.0] * 7, 1), (2005, [1.0] * 8, None), (2006, [], 1), (2007, [1.0] * 7, 1), (2008, [1.0] * 7, 1), (2009, rows[3][1], rows[3][2]), (2010, [1e-30] * 8, 0), (2011, [1e30] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("node", "n", "class", "e", "tiles")})
    monkeypatch.setattr(embedding, "TILE", 20)
    assert sorted(map(tuple, embedding.near_vectors(df).collect())) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert embedding.near_vectors(df.limit(0)).collect() == []


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op8_embedding(spark, sf).collect())) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(200, 64)), rng.normal(size=(50, 64)) ** 9, np.eye(64)[:20] + 1e-9])
    u, q, s, e = embedding.quantised(x)
    near, true = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s, u @ u.T
    assert (np.abs(near - true) <= e + e[:, None] * (1 + e)).all()
