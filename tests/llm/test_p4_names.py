import __spark_entry__ as entry


def test_links_and_clusters_are_registered(spark, tmp_path):
    filings = [(1, "Beirlospaum & Kurhajur LLC", 2022), (2, "Kurhajur and Beirlospaum, L.L.C.", 2022), (3, "Beirlospaum & Kurhajur LLC", 2023), (4, "Unknown", 2022), (5, "Somebody Else Inc.", 2022)]
    records = [(10, "Beirlospaum & Kurhajur LLC", 2022), (11, "BEIRLOSPAUM & KURHAJUR LLC", 2023), (12, "Prirziast Foods Corp.", 2022)]
    spark.createDataFrame(filings, "filing_id bigint, company string, fiscal_year int").write.parquet(f"{tmp_path}/filings.parquet")
    spark.createDataFrame(records, "gt_id bigint, company string, fiscal_year int").write.parquet(f"{tmp_path}/gt_records.parquet")
    q = entry.queries()
    assert {tuple(r) for r in q["p4_found"](spark, str(tmp_path)).collect()} == {(2, 10), (3, 11)}
    cluster = {r.company: r.cluster for r in q["p4_clusters"](spark, str(tmp_path)).collect()}
    assert len({cluster[n] for _, n, _ in (*filings[:3], *records[:2])}) == 1
    assert len(set(cluster.values())) == 3 and "Unknown" not in cluster


def test_a_long_chain_of_rising_ranks_loses_no_node(spark):
    from docmetrics.llm.names import star_clusters

    names = [f"n{i:03}" for i in range(90)]  # two nodes a round, from the upper end
    nodes = spark.createDataFrame([(n,) for n in names], "sig string")
    edges = spark.createDataFrame([(a, b, 0.9) for a, b in zip(names, names[1:])], "a string, b string, sim double")
    assert sorted(r.sig for r in star_clusters(nodes, edges).collect()) == names
