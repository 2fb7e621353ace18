"""Every query with SQL against DuckDB; the others against plain Python."""

import hashlib
import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from offermill.functions import identity
from offermill.operators import entity
from offermill.plans import registry
from oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, name, registry.queries()[name], registry.oracle_sql()[name], SF) == ""


def test_entry_works_without_the_corpus_operators(spark, monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "corpus", None)
    assert set(e.queries()) == set(registry.queries())
    assert e.entry(spark).count() > 0


def test_clusters_keep_every_record(spark):
    got = registry.queries()["cluster_dedupe_exact"](spark, SF).toPandas()
    assert got["merged_from"].sum() == spark.read.parquet(f"{SF}/part.parquet").count()


def test_all_documents_are_folded(spark):
    want = {}
    for i, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False):
        plain = "".join(x for x in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(x)).replace("ß", "ss")
        folded = re.sub("[^A-Za-z0-9]+", " ", plain).strip()
        want[i] = hashlib.md5(folded.encode()).hexdigest(), folded.replace(" ", "-")[:140].rstrip("-")
    got = registry.queries()["text_fold_slug_all"](spark, SF).toPandas()
    assert {r.doc_id: (r.folded_md5, r.slug) for r in got.itertuples()} == want and len(got) == len(want)


def test_related_products_meet_across_shelves(spark):
    """Equal article numbers and names are found far apart, also across types."""
    got = registry.queries()["relation_pairs_all"](spark, SF).toPandas()
    part = spark.read.parquet(f"{SF}/part.parquet").toPandas().set_index("p_partkey")
    pairs = set(zip(got["a"], got["b"]))
    coded = [k for k in sorted(part.index) if k % 11 == 0]
    assert {(a, b) for a in coded for b in coded if a < b} <= pairs and len(pairs) == len(got)
    assert (got["a"] // 50 != got["b"] // 50).any() and set(registry.queries()["set_diff_brands_all"](spark, SF).toPandas()["p_brand"]) == set(part["p_brand"])


def test_repeated_turns_and_long_texts_are_kept(spark, tmp_path):
    """Rows that repeat a turn stay, and texts that differ only late or far away give other windows."""
    rows = [(1, t, "user" if t % 2 else "bot", f"{'x' * 30} {t}") for t in range(1, 12)] + [(1, 5, "bot", "a second row"), (2, 1, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    ordered = sorted(r for r in rows if r[0] == 1)
    want = [(t, role, hashlib.md5("\n".join(x[3] for x in ordered[max(0, i - 9) : i + 6]).encode()).hexdigest()) for i, (_, t, role, _) in enumerate(ordered)]
    got = registry.queries()["context_window_turns"](spark, str(tmp_path)).collect()
    assert sorted((r.turn, r.role, r.around_md5) for r in got if r.conv_id == 1) == sorted(want) and len(got) == len(rows)


def test_products_at_any_node(spark, tmp_path):
    trees = {1: {"k": 1}, 2: {"a": [{"name": "Milch", "price": 1}, {"b": {"title": "Brot", "offerPrice": "2", "c": [{"displayName": "Ei", "currentPrice": 0.5}]}}]}, 3: [[{"productName": "x", "price": "9"}]]}

    def found(node):
        if isinstance(node, list):
            return [x for n in node for x in found(n)]
        if not isinstance(node, dict):
            return []
        name, price = (next((node[k] for k in keys if k in node), None) for keys in (("name", "title", "productName", "displayName"), ("currentPrice", "offerPrice", "price")))
        return ([(name, str(price))] if name and price is not None else []) + found(list(node.values()))

    rows = [(i, json.dumps(t)) for i, t in trees.items()] + [(4, "{"), (5, None)]
    spark.createDataFrame(rows, "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = registry.queries()["json_tree_products"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((i, *x) for i, t in trees.items() for x in found(t)) and len(got) == 4


def test_clusters_of_a_hot_brand(spark, tmp_path, monkeypatch):
    """Clusters are those of one pass over the brand, though no task grows all of it."""
    rng = random.Random(4)
    rows = [(i, "hot", " ".join(rng.sample("a b c d e f g h i j k l m n".split(), rng.choice((2, 6, 7, 8, 9)))), rng.randint(1, 4), float(rng.randint(1, 99))) for i in range(400)]
    rows += [(400 + i, "hot", "same old name", 3, 5.0 + i) for i in range(50)] + [(500, "hot", None, 1, 1.0), (501, "hot", "", 1, 2.0), (502, "hot", "a b", None, 3.0), (503, "hot", "a b", None, 4.0)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    clusters, by_block = [], {}
    for key, _, name, size, price in rows:
        w = (name or "").split()
        for k in (k for x in w for k in by_block.get((size, x), []) if size is not None):
            o = clusters[k][3]
            n = len(o & set(w))
            if max(n / len(o | set(w)), 0.94 * n / min(len(o), len(set(w)))) >= 0.82:
                clusters[k][1:3] = clusters[k][1] + 1, min(clusters[k][2], price)
                break
        else:
            k = len(clusters)
            clusters.append([key, 1, price, set(w)])
        for x in [*w, *clusters[k][3]]:
            if k not in by_block.setdefault((size, x), []):
                by_block[size, x].append(k)
    most, grow = [], entity.greedy_clusters
    monkeypatch.setattr(entity, "greedy_clusters", lambda df, scope, *a: (most.append(df.groupBy(scope).count().agg({"count": "max"}).first()[0]), grow(df, scope, *a))[1])
    got = registry.queries()["cluster_dedupe_exact"](spark, str(tmp_path)).collect()
    assert sorted((r.p_partkey, r.merged_from, r.least_price) for r in got) == sorted(tuple(c[:3]) for c in clusters)
    assert most[0] < len(rows) / 2


def test_pages_have_titles_and_blocks(spark):
    got = registry.queries()["html_title_text"](spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert (got["n_blocks"] > 0).all()


def test_relations_of_a_hot_brand(spark, tmp_path):
    """The relations are those that any two products have, also where columns are null; rows meet arrays and no pair is joined."""
    rng = random.Random(5)
    pick = lambda *v: rng.choice(v)
    rows = [(i, pick("a", "b", "a|1", "", None), pick("hot", "hot", "hot", "cold", None), pick("X", "x", "Y", None), pick(1, 2, 6, 11, None)) for i in range(150)]
    df = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    df.write.parquet(str(tmp_path / "part.parquet"))
    keys = df.select(
        "*", F.when(F.col("p_partkey") % 11 == 0, F.lit("4006381333931")).alias("gtin"), F.concat_ws("|", "p_name", "p_size").alias("exact_key"), F.concat_ws("|", "p_type", "p_size").alias("comparison_key"),
        F.col("p_name").alias("similarity_key"), F.col("p_brand").alias("group"), (F.col("p_size") % 2 == 0).alias("organic"),
    )
    side = lambda s: {k: F.col(f"{s}.{k}") for k in ("gtin", "exact_key", "comparison_key", "similarity_key", "group", "organic")}
    fine = identity.compatible(F.col("a.p_type"), F.col("b.p_type"), [(F.col("a.p_size") % 5, F.col("b.p_size") % 5)])
    every = keys.alias("a").join(keys.alias("b"), F.col("a.p_partkey") < F.col("b.p_partkey")).withColumn("shelf", F.coalesce((F.col("a.p_type") == F.col("b.p_type")) & (F.col("a.p_brand") == F.col("b.p_brand")), F.lit(False)))
    want = [tuple(r) for r in every.select(F.col("a.p_partkey"), F.col("b.p_partkey"), identity.relation(side("a"), side("b"), fine), "shelf").collect()]
    for name, rest in (("relation_pairs_all", [r[:3] for r in want if r[2] != "none"]), ("relation_pair_kind", [r[:3] for r in want if r[3]])):
        got = registry.queries()[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(rest) and len({r[2] for r in rest}) > 3
        assert "explode(_rows" in got._jdf.queryExecution().optimizedPlan().toString()
