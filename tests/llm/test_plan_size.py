"""Plans that repeated steps give the driver stay small."""

from coinfold.llm import common, op3_minhash


def test_nested_attaches_are_cut(spark, monkeypatch):
    scans, real = [], common._cut

    def counted(df):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return real(df)

    monkeypatch.setattr(common, "_cut", counted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long")
    got = {(r.node, r.component) for r in common.connected_components(common.stored(edges)).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    docs = common.stored(spark.createDataFrame([(i, " ".join(f"w{i // 2}x{j}" for j in range(30))) for i in range(20)], "doc_id long, text string"))
    kept = op3_minhash.minhash_dedup(docs).where("kept")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 20, 2))
    assert max(scans) <= 8
