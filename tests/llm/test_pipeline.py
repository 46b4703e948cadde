"""The pipeline against its stages done by hand, and the registration of the queries."""

import hashlib
from collections import Counter

from pyspark.sql import Row

import corpus_pipeline
from eventloom.llm import mixing, queries

from .test_dedup import Sets, brute_fingerprint


def test_stages(spark, docs, tmp_path, model):
    import sentencepiece

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    table, seen = plain, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = table.collect()
        stage(spark, table, str(tmp_path)).write.parquet(str(tmp_path / str(i)))
        table = spark.read.parquet(str(tmp_path / str(i)))
        after = table.collect()
        seen.append(name)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert table.columns == plain.columns
        if name == "language":
            assert {r.doc_id for r in after} == {r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text)}
        elif name == "exact_dedup":
            last = {r.text: r.doc_id for r in sorted(before, key=lambda r: r.doc_id)}
            assert Counter(after) == Counter(r for r in before if last[r.text] == r.doc_id)
        elif name == "near_dedup":
            fps, sets = {r.doc_id: brute_fingerprint(r.text) for r in before}, Sets([r.doc_id for r in before])
            for a in fps:
                for b in fps:
                    if (fps[a] ^ fps[b]).bit_count() <= 4:
                        sets.join(a, b)
            assert Counter(after) == Counter(r for r in before if sets.find(r.doc_id) == r.doc_id)
        elif name == "mix":
            taken = {r.doc_id: round(r.taken / max(1, r["size"]) + 1e-9) for r in mixing.mix(spark.createDataFrame(before, plain.schema)).collect()}
            assert Counter(r.doc_id for r in after) == Counter({i: n for i, n in taken.items() if n})
        else:
            p = sentencepiece.SentencePieceProcessor(model_file=model)
            assert Counter((r.doc_id, tuple(r.ids)) for r in after) == Counter((r.doc_id, tuple(p.encode(r.text, add_eos=True))) for r in before)
            texts = {r.doc_id: r.text for r in before}
            assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in after)
    assert seen == ["language", "exact_dedup", "near_dedup", "mix", "encode"]


def test_empty(spark, none, tmp_path):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert "pipeline" in found and set(queries.QUERIES) <= set(found) and set(queries.SQL) <= set(__spark_entry__.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_oracle(spark):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"create view {table} as from '/root/testdata/sf0.001/{table}.parquet'")
    for name, sql in queries.SQL.items():
        mine = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        theirs = con.sql(sql)
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert sorted(map(repr, mine.collect())) == sorted(repr(Row(*mine.columns)(*[r[theirs.columns.index(c)] for c in mine.columns])) for r in theirs.fetchall())


def test_columns_named_like_the_stages_own(spark):
    """Columns that clash with those a stage works with, and a map, come through untouched."""
    from eventloom.llm import exact_dedup, mixing

    own = ["_key", "_id", "_sha", "_row", "_doc", "_words", "_size", "_times", "_again", "_taken", "_source", "_doc_id", "a.b"]
    kind = "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in own) + ", tags map<string,int>"
    row = lambda i, text, n=0: (i, text, "ab"[i % 2], *(n + k for k in range(len(own))), {"t": n})
    docs = spark.createDataFrame([row(i, f"words of text {i}", i) for i in range(12)] + [row(20, "words of text 1", 7), row(20, "words of text 1", 3), row(3, "another text", 4)], kind).repartition(3)
    given = {tuple(map(str, r)) for r in docs.collect()}
    kept = exact_dedup.distinct_texts(docs)
    assert kept.columns == docs.columns and {tuple(map(str, r)) for r in kept.collect()} <= given
    assert kept.count() == 13 and kept.where("doc_id = 20").first()["_key"] == 3
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    found = [tuple(map(str, r)) for r in mixed.collect()]
    assert found and set(found) <= given and max(map(found.count, found)) <= 4


def test_many_invalid_bytes_decode(model):
    from eventloom.llm import pieces

    assert pieces._utf8(b"\xff" * 3000) == "\ufffd" * 3000
    assert pieces._utf8(b"a\xe3\x81b\xe3\x81\x82\xff") == "a\ufffd\ufffdb\u3042\ufffd"
