"""Literal expectations of the operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphkiln.functions import markdown
from graphkiln.functions import text as t
from graphkiln.operators import documents, evaluation, graph, resolution, search, vectors


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def texts(spark, values, column):
    return one(spark, [(v,) for v in values], "x string", column)


def test_canonical_ids(spark):
    names = ["Xuân Thủy", "Đảng ủy", "Đồ họa máy tính", "144 Xuân Thủy, Cầu Giấy, Hà Nội", "Test-Name", "Test & Name", "!!!", "", None]
    want = ["node_xuan_thuy", "node_dang_uy", "node_do_hoa_may_tinh", "node_144_xuan_thuy_cau_giay_ha_noi", "node_test-name", "node_test_name", "node_unknown", "node_unknown", "node_unknown"]
    assert texts(spark, names, t.canonical_id(F.col("x"))) == want
    assert len(texts(spark, ["A" * 250], t.canonical_id(F.col("x")))[0]) == 205


def test_normalisers(spark):
    assert texts(spark, ["Đại học Công nghệ", "  Trường--ĐH_Công.Nghệ  "], t.query_text(F.col("x"))) == ["dai hoc cong nghe", "truong dh cong nghe"]
    assert texts(spark, ["Đại"], t.strip_diacritics(F.col("x"))) == ["Đai"]
    assert texts(spark, ["Đại"], t.strip_accents(F.col("x"))) == ["Dai"]
    assert texts(spark, [" a \n b c ", None], t.normalize_text(F.col("x"))) == ["a b c", ""]


def test_variants_and_aliases(spark):
    assert texts(spark, ["abc_uet_xyz", "uet-123"], t.identifier_variants(F.col("x"))) == [["abc_uet_xyz", "abc uet xyz", "abc", "uet", "xyz"], ["uet-123", "uet 123", "uet", "123"]]
    assert one(spark, [(["UET", " UET ", "uet", "", None],)], "x array<string>", t.aliases(F.col("x"))) == [["UET"]]


def test_person_names(spark):
    assert texts(spark, ["TS. Nguyễn Văn An", "PGS.TS Lê B", "Tsang Lee"], t.person_name(F.col("x"))) == ["Nguyễn Văn An", "Lê B", "Tsang Lee"]
    labels = [(["School", "Person"],), (["Organization", "X"],), (["dept"],), ([],), (None,)]
    assert one(spark, labels, "x array<string>", t.primary_type(F.col("x"))) == ["PERSON", "ORGANIZATION", "DEPT", "UNKNOWN", "UNKNOWN"]


def test_id_suffixing(spark):
    df = spark.createDataFrame([("node_test", 1)], "base string, pos int")
    assert resolution.unique_ids(df, "base", "pos", ["node_test_3"]).first()["unique_id"] == "node_test"
    three = spark.createDataFrame([("t", k) for k in range(3)] + [("t_2", 9)], "base string, pos int")
    assert sorted(r.unique_id for r in resolution.unique_ids(three, "base", "pos").collect()) == ["t", "t_2", "t_3", "t_4"]


def test_canonical_names(spark):
    uses = ["UET", "Trường ĐHCN", "Trường Đại học Công nghệ", "Trường Đại học Công nghệ", "Trường Đại học Công nghệ, Đại học Quốc gia Hà Nội", "University of Engineering and Technology"]
    people = ["TS. Nguyễn Văn An", "Nguyễn Văn An", "Nguyễn Văn An", "Dr. Nguyễn Văn An", "NVA", "N. V. An"]
    df = spark.createDataFrame([("u", x) for x in uses] + [("p", x) for x in people] + [("e", "")], "id string, name string")
    assert {r.id: r.name for r in resolution.canonical_names(df).collect()} == {"u": "Trường Đại học Công nghệ", "p": "Nguyễn Văn An"}


def test_dedupe_edges(spark):
    df = spark.createDataFrame([("r1", "KNOWS", "n1", "n2"), ("r2", "KNOWS", "n1", "n2"), ("r3", "KNOWS", "n1", "n2"), ("r4", "KNOWS", "n2", "n1"), ("r5", "LIKES", "n1", "n2")], "id string, type string, source string, target string")
    rows = {r.id: (r.merge_count, r.merged_from_ids) for r in graph.dedupe_edges(df).collect()}
    assert rows == {"r1": (3, ["r1", "r2", "r3"]), "r4": (1, None), "r5": (1, None)}
    remap = spark.createDataFrame([("n2", "n1")], "node_id string, canonical_id string")
    assert graph.canonicalize_edges(df, remap).count() == 0


def test_flatten_map(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "node_id string, canonical_id string")
    assert {(r.node_id, r.canonical_id) for r in graph.flatten_map(df).collect()} == {("a", "d"), ("b", "d"), ("c", "d"), ("x", "y")}


def test_merge_entities(spark):
    nodes = spark.createDataFrame([("a", ["KgNode", "P"], None, ["x"], 0), ("b", ["Q"], "Bob", ["y", "x"], 1), ("c", ["R"], "Cy", [], 2)], "id string, labels array<string>, name string, aliases array<string>, pos int")
    edges = spark.createDataFrame([("1", "k", "b", "c"), ("2", "k", "a", "c"), ("3", "k", "a", "b")], "id string, type string, source string, target string")
    after, moved = graph.merge_entities(nodes, edges, "a", ["b", "missing"])
    row = after.filter("id = 'a'").first()
    assert (row.labels, row.name, row.aliases, after.count()) == (["P", "Q"], "Bob", ["x", "y"], 2)
    assert [(r.source, r.target, r.merge_count) for r in moved.collect()] == [("a", "c", 2)]
    with pytest.raises(ValueError, match="no such"):
        graph.merge_entities(nodes, edges, "zz", ["b"])


def test_entity_score(spark):
    df = spark.createDataFrame([("Trường Đại học Công nghệ", ["UET"], ""), ("Other", ["x"], "about uet here")], "name string, aliases array<string>, d string")
    score = search.entity_score(F.array(F.lit("UET")), F.col("name"), F.col("aliases"), F.lit(""), F.array("d"), F.lit(0.0))
    assert [r[0] for r in df.select(score).collect()] == [95.0, 0.0]
    lexical = search.lexical_score("Cong nghe", F.col("name"), F.col("aliases"))
    assert [r[0] for r in df.select(lexical).collect()] == [0.9, 0.0]


def test_triplet_summary(spark):
    rows = [("p", "supported", 0.9, True), ("p", "not_enough_info", 0.5, True), ("q", "contradicted", 2.0, True), ("q", "invalid", None, False)]
    out = {r.predicate: r for r in evaluation.triplet_summary(spark.createDataFrame(rows, "predicate string, label string, confidence double, valid boolean")).collect()}
    total = out[None]
    assert (total.total, total.valid_total, total.invalid, total.contradicted) == (4, 3, 1, 1)
    assert total.supported_rate == pytest.approx(1 / 3) and total.mean_confidence == pytest.approx(0.7)
    assert 0 <= total.low < 1 / 3 < total.high <= 1


def test_vectors(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.1]), (3, "a", [0.0, 1.0]), (4, "b", [1.0, 0.0]), (5, "b", [0.0, 0.0])], "id long, block string, v array<double>")
    pairs = vectors.threshold_pairs(df, "id", "v", "block", 0.72)
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]
    roots = vectors.components(pairs, df.select("id")).join(df.select("id", "block"), "id")
    assert {r.id: r.cluster_id for r in vectors.number_clusters(roots).collect()} == {1: "a_0000", 2: "a_0000", 3: "noise", 4: "noise", 5: "noise"}
    sim = {r.cluster: r.similarity for r in vectors.intra_similarity(df.filter("id < 4"), "id", "v", "block").collect()}
    assert sim["a"] == pytest.approx((1 / 1.01**0.5 + 0 + 0.1 / 1.01**0.5) / 3)


def test_conservative_groups(spark):
    rows = [(1, 0, "x", ["Bob Lee"], [1.0, 0.0]), (1, 1, "y", ["bob lee"], [1.0, 0.01]), (1, 2, "z", ["Ann"], [1.0, 0.0]), (1, 3, "w", ["Lee"], [1.0, 0.02])]
    df = spark.createDataFrame(rows, "cluster int, pos int, node_id string, names array<string>, vector array<double>")
    assert {r.node_id: r.seed for r in resolution.conservative_groups(df).collect()} == {"x": "x", "y": "x", "z": "z", "w": "x"}


def test_chunks(spark):
    text = "# Title\n\n## A\n\nFirst words here. " + "word " * 120 + "\n\n### B\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- x\n- y"
    rows = documents.chunks(spark.createDataFrame([("d", text), ("e", "# Only"), ("f", None)], "doc_id string, text string")).collect()
    assert {r.doc_id for r in rows} == {"d"} and [r.chunk_index for r in rows] == list(range(len(rows)))
    assert {r.section for r in rows} == {"A", "A > B"} and any("| 1 | 2 |" in r.text and "- y" in r.text for r in rows)
    assert all(markdown.count(r.text) <= 120 for r in rows)
    assert markdown.sentences("Hi TS. An went. Then he left! ok") == ["Hi TS. An went.", "Then he left! ok"]
    assert markdown.token_windows("a b c d e", 3, 1) == ["a b c", "c d e", "e"]
    assert all(len(p) <= 700 for p in markdown.split_by_chars("word " * 900, 700))


def test_markdown():
    made = markdown.html_to_markdown("<h2>T</h2><p>a <b>b</b></p><ul><li>x<ul><li>y</li></ul></li></ul><table><tr><td>1</td><td>2</td></tr></table><script>z</script>")
    assert made == "## T\n\na **b**\n\n- x\n  - y\n\n| Col1 | Col2 |\n| --- | --- |\n| 1 | 2 |"


def test_partition_repair(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "cluster int, node_id string")
    asked = spark.createDataFrame([(1, "g", 0, "a"), (1, "g", 1, "b"), (1, "h", 0, "a"), (1, "h", 1, "zz")], "cluster int, grp string, pos int, node_id string")
    assert sorted((r.grp, r.node_id) for r in resolution.repair_partition(members, asked).collect()) == [("g", "a"), ("g", "b"), ("single_c", "c")]


def test_quota_and_packing(spark):
    rows = [(k, "g" if k % 2 else "h", float(k), k, f"f{k // 2}") for k in range(10)]
    out = documents.quota_select(spark.createDataFrame(rows, "id int, grp string, score double, words int, fingerprint string"), {"g": 2}, 4).collect()
    assert [(r.id, r.reason) for r in out] == [(9, "quota"), (7, "quota"), (5, "fill"), (3, "fill")]
    df = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate([50, 3, 40, 1])], "g int, r int, x string")
    assert [r.r for r in evaluation.pack(df, "g", "r", "x", 3, 60).collect()] == [0, 1]
