from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from phylospark.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, source string, n_chars long, good string, A int, digest string"


def tables(spark, tmp_path, docs, labels):
    spark.createDataFrame([(*d, "src", 0, "x", 1, "y") for d in docs], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def brute(docs, labels):
    """Every order of every part, filters applied one after the other to lists."""
    known = [(d, t or "", p or "") for d, t, p in docs]
    spaces = " \t\n\x0b\f\r"
    fails = []
    for d, t, _ in known:
        words = [w for w in t.translate({ord(c): " " for c in spaces}).split(" ") if w]
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t)}
        bad["E"] = any(e is not None and d is not None and e < d and u == t for e, u, _ in known)
        fails.append({k for k, v in bad.items() if v})
    good, toxic = ({d for d, *m in labels if m[i] == 1} for i in (0, 1))
    out = []
    for part in {p for *_, p in known}:
        own = [i for i, k in enumerate(known) if k[2] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in fails[i]]
                left = [i for i in left if f not in fails[i]]
                removed_by[f] += len(gone)
                all_f = [i for i in own if f in fails[i]]
                rows.append((part, "".join(order), step, len(left), len(gone), len(all_f) - len(gone), sum(fails[i] == {f} for i in own), sum(known[i][0] in good for i in gone), sum(known[i][0] in toxic for i in gone), f))
        out += [(*r[:-1], removed_by[r[-1]]) for r in rows]
    return sorted(out)


def odd_rows():
    plain = " ".join(f"w{i}" for i in range(250))
    docs = [(1, plain, "en"), (2, plain, "fr"), (2, plain, "fr"), (None, plain, "en"), (3, None, None), (4, "", ""), (5, "A B C", "en"), (6, "a # b", "de"), (7, "x\u00a0y \u2003z\tx\n", "en")]
    docs += [(8, "word " * 300, "en"), (9, "\U0001f600 " * 10, "en"), (10, plain + " #", "en"), (11, plain.upper(), "en"), (12, plain.upper() + "|", "en"), (13, "É" * 300, "de"), (14, "w" * 3_000_000 + " v" * 200_000, "long"), (15, plain, "en"), (15, "a b", None)]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (5, None, 1), (11, 1, 1), (None, 1, 1), (99, 1, 1), (15, 1, 0), (12, 0, 1)]
    return docs, labels


def test_equals_brute_force_and_sql(spark, tmp_path):
    docs, labels = odd_rows()
    path = tables(spark, tmp_path, docs, labels)
    out = A.op11_filter_audit(spark, path)
    got = sorted(tuple(r) for r in out.collect())
    assert got == brute(docs, labels)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    assert sorted(con.execute(A.OP11_SQL).fetchall()) == got
    assert out.columns == [c[0] for c in con.description]


def test_empty_tables(spark, tmp_path):
    assert A.op11_filter_audit(spark, tables(spark, tmp_path, [], [])).collect() == []


def test_every_set_is_entered_once(spark, tmp_path):
    """80 edges for five filters, and what an edge removes is what really fails among the survivors."""
    rows = spark.range(200).select(F.lit("p").alias("part"), *((F.col("id") % m == 0).alias(k) for k, m in zip("ABCDE", (2, 3, 5, 7, 11), strict=True)), (F.col("id") % 4 == 0).alias("good"), F.lit(False).alias("toxic"))
    A.count_edges(rows, "ABCDE", f"{tmp_path}/edges")
    found = spark.read.parquet(f"{tmp_path}/edges").collect()
    assert len(found) == len({r["state"] for r in found}) == 31 and sum(len(r["edges"]) for r in found) == 80
    prime = dict(zip("ABCDE", (2, 3, 5, 7, 11), strict=True))
    for r in found:
        left = [i for i in range(200) if all(i % prime[f] for f in r["state"])]
        assert r["n"] == len(left) and {f: e["removed"] for f, e in r["edges"].items()} == {f: sum(i % m == 0 for i in left) for f, m in prime.items() if f not in r["state"]}


def test_other_filters(spark):
    rows = spark.createDataFrame([("p", True, False, True, False), ("p", True, True, False, True), ("q", False, False, False, False)], "part string, X boolean, Y boolean, good boolean, toxic boolean")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in A.audit(rows, "YX").collect()}
    assert len(got) == 8 and got["p", "XY", 1] == (0, 2, 0, 1, 3) and got["p", "XY", 2] == (0, 0, 1, 0, 1) and got["p", "YX", 2] == (0, 1, 1, 1, 3) and got["q", "YX", 2] == (1, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        A.audit(rows, "XX")
