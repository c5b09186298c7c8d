from pyspark.sql import functions as F

from tessera.operators import clusters, dedup, learn, links, reports, search, tags, vectors, writes
from tessera.operators.graph import connected_components


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_components(spark):
    e = frame(spark, "a long, b long", (1, 2), (2, 3), (9, 8), (5, 5), *((i, i + 1) for i in range(100, 160)))
    got = {r.node: r.root for r in connected_components(e, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5} | {i: 100 for i in range(100, 161)}
    assert connected_components(e.where("false"), "a", "b").count() == 0


LINKS = "canonical_id long, duplicate_id long, match_key string, state string"


def test_links_stay_one_hop_deep(spark):
    held = frame(spark, LINKS, (1, 2, "url", "merged"), (7, 8, "doi", "merged"), (4, 5, "url", "rejected"))
    asked = frame(spark, "canonical_id long, duplicate_id long, match_key string", (2, 3, "doi"), (10, 7, "url"), (11, 10, "url"), (6, 6, "url"))
    once = links.link(held, asked)
    state = {(r.canonical_id, r.duplicate_id): r.state for r in once.collect()}
    assert state[(1, 3)] == "merged" and state[(11, 7)] == state[(11, 8)] == state[(11, 10)] == "merged"
    assert state[(4, 5)] == "rejected" and state[(7, 8)] == "rejected" and (6, 6) not in state
    m = [(c, d) for (c, d), s in state.items() if s == "merged"]
    assert not {c for c, _ in m} & {d for _, d in m} and len({d for _, d in m}) == len(m)
    assert {tuple(r)[:2] for r in links.merged(links.link(once, asked)).select("canonical_id", "duplicate_id").collect()} == set(m)


def test_linked_copies_and_sources(spark):
    docs = frame(spark, "id long, source string, title string", (1, "a", "x"), (2, "b", "y"), (3, "b", "z"))
    held = frame(spark, LINKS, (1, 2, "url", "merged"))
    assert values(links.linked_copies(docs, held).select("document_id", "copy_id")) == [(1, 2), (2, 1)]
    assert values(links.source_in(docs, held, ["b"]).select("id")) == [(1,), (2,), (3,)]


def hits(spark, *rows):
    return frame(spark, "doc_id long, similarity double, rank long", *rows)


def test_fusion(spark):
    sem = hits(spark, (1, 0.9, 1), (2, 0.8, 2))
    key = hits(spark, (2, None, 1), (3, None, 2), (4, None, 3))
    fused = search.hybrid(sem, key)
    assert [tuple(r) for r in fused.orderBy("rank").collect()] == [(1, 0.9, 1), (2, 0.8, 2), (3, None, 3), (4, None, 4)]
    assert values(search.hybrid(sem, key, "semantic")) == [(1, 0.9, 1), (2, 0.8, 2)]
    assert search.hybrid(sem.where("false"), key, "semantic").count() == 3
    held = frame(spark, LINKS, (9, 1, "url", "merged"), (2, 4, "url", "merged"))
    assert [tuple(r) for r in search.fold_duplicates(fused, held).orderBy("rank").collect()] == [(9, 0.9, 1), (2, 0.8, 2), (3, None, 3)]
    page = search.paginate(fused, 2, 1).orderBy("rank").collect()
    assert [(r.doc_id, r.total) for r in page] == [(2, 4), (3, 4)]
    clip = hits(spark, (3, 0.95, 1), (5, 0.1, 2))
    assert [r.doc_id for r in search.merge_clip(fused, clip).orderBy("rank").collect()] == [3, 1, 2, 5, 4]


def test_keywords_rank_titles_first(spark):
    docs = frame(spark, "id long, title string, card_summary string, source string", (1, "about Étude x", None, "a"), (2, "none", "an étude", "b"), (3, "none", None, "a"), (4, "etude", None, "a"))
    chunks = frame(spark, "document_id long, text string", (3, "ÉTUDE étude étude"), (1, "étude"), (4, "nothing"))
    got = search.keyword_hits(docs, chunks, "étude").orderBy("rank").collect()
    assert {r.doc_id for r in got[:2]} == {1, 2} and [r.doc_id for r in got[2:]] == [3]
    assert [r.doc_id for r in search.keyword_hits(docs, chunks, "étude", ["a"]).orderBy("rank").collect()] == [1, 3]
    assert [r.doc_id for r in search.keyword_hits(docs, chunks, "n_").orderBy("rank").collect()] == [2, 3]


def test_folds_and_counts(spark):
    used = frame(spark, "document_id long, tag string, origin string", (1, "Café", "source"), (1, "cafe", "source"), (2, "cafe", "source"), (3, "coffee", "source"), (4, "cafe", "inferred"))
    aliases = frame(spark, "alias string, canonical string, state string", ("coffee", "cafe", "active"))
    folds = tags.fold_table(used, aliases)
    held = frame(spark, LINKS, (2, 3, "url", "merged"))
    got = {(r.origin, r.tag): (r["count"], r.variants) for r in tags.tag_counts(used, folds, held).collect()}
    assert got == {("source", "cafe"): (2, ["cafe", "Café", "coffee"]), ("inferred", "cafe"): (1, ["cafe"])}
    assert values(tags.inventory(folds, aliases)) == [("cafe", 3)]


def test_fold_candidates(spark):
    inv = frame(spark, "key string, n long", ("cats", 1), ("cat", 5), ("query", 2), ("queries", 2), ("news", 9), ("new", 1), ("class", 1), ("clas", 1), ("machine-learnings", 1), ("machine-learning", 1), ("ml", 4), ("boxes", 1), ("box", 1))
    assert values(tags.morphology_pairs(inv)) == [("boxes", "box"), ("cats", "cat"), ("machine-learnings", "machine-learning"), ("query", "queries")]
    assert values(tags.initialism_pairs(inv)) == [("ml", "machine-learning"), ("ml", "machine-learnings")]
    known = frame(spark, "alias string, canonical string, state string", ("cat", "cats", "rejected"))
    got = tags.scan([("morphology", tags.morphology_pairs(inv)), ("initialism", tags.initialism_pairs(inv))], known)
    assert ("cats", "cat", "morphology") not in values(got) and got.count() == 5


def test_similar_pairs_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k long, e array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = sorted((i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.6)
    for block in (1024, 7):
        assert sorted((r.a, r.b) for r in vectors.similar_pairs(v, "k", "e", 0.6, block).collect()) == want


def test_exact_links(spark):
    docs = frame(spark, "id long, doi string, arxiv_id string, isbn string, url_or_path string, fetch_status string, ingested_at long",
                 (1, "10.1/X", None, None, "https://a.org/1", "pending", 5), (2, "doi:10.1/x", None, None, "https://b.org", "fetched", 6), (3, None, None, None, "http://www.b.org/", "fetched", 1), (4, None, None, "0306406152", None, "fetched", 1), (5, None, None, "9780306406157", None, "unfetchable", 0))
    none = frame(spark, LINKS, (4, 5, "isbn", "rejected"))
    keys = dedup.match_keys(docs)
    ranks = dedup.canonical_rank(docs, frame(spark, "document_id long, n_chunks long", (2, 3)))
    got = values(dedup.propose_links(dedup.groups(keys, none), ranks, keys, none))
    assert got == [(2, 1, "doi"), (2, 3, "url")]


def test_repeated_chunks(spark):
    c = frame(spark, "id long, document_id long, chunk_index long, text string, chunk_pass string, page_start long",
              *((i, 1, i, "ab"[i % 2], "fulltext", 1) for i in range(6)), *((10 + i, 2, i, t, "fulltext", 1) for i, t in enumerate("abc")), (20, 3, 0, "s", "summary", None), (21, 3, 1, "s", "summary", None))
    summary, full = reports.repeated_chunks(c)
    assert values(summary) == [(21,)] and values(full) == [(2,), (3,), (4,), (5,)]


def test_writers(spark):
    stored = frame(spark, "id long, title string, doi string, ingested_at long", (1, "a", "d1", 5), (2, "b", None, None))
    new = frame(spark, "id long, title string, doi string, ingested_at long", (1, "A", None, 9), (2, None, "d2", 7), (3, "c", "d3", 8))
    assert values(writes.upsert(stored, new, ["id"])) == [(1, "A", "d1", 5), (2, None, "d2", 7), (3, "c", "d3", 8)]
    assert values(writes.insert_new(stored, new, ["id"]).select("id", "title")) == [(1, "a"), (2, "b"), (3, "c")]
    al = frame(spark, "alias string, canonical string, state string", ("x", "a", "active"), ("a", "b", "candidate"), ("c", "d", "active"))
    got = values(writes.decide_alias(al, "a", "b", "active"))
    assert ("a", "b", "active") in got and ("x", "b", "active") in got
    assert ("q", "d", "active") in values(writes.decide_alias(al, "q", "c", "active"))
    assert ("c", "d", "rejected") in values(writes.decide_alias(al, "c", "d", "rejected"))
    runs = frame(spark, "run_id long, started_at long, finished_at long, status string", (1, 0, None, "running"), (2, 99_000, None, "running"))
    assert [r.status for r in writes.close_stale_runs(runs, 100_000).orderBy("run_id").collect()] == ["aborted", "running"]


def test_purge_of_a_source(spark):
    docs = frame(spark, "id long, source string", (1, "a"), (2, "b"))
    o = frame(spark, "document_id long, tag string, origin string", (1, "t", "manual"), (1, "t", "llm"), (2, "t", "llm"))
    items = frame(spark, "list_id long, document_id long", (1, 1), (1, 2))
    out = reports.purge_source({"documents": docs, "overlay_tags": o, "reading_list_items": items}, "a")
    assert values(out["overlay_tags"]) == [(1, "t", "manual"), (2, "t", "llm")] and out["reading_list_items"].count() == 2
    assert reports.purge_source({"documents": docs, "overlay_tags": o}, "a", False)["overlay_tags"].count() == 1


def test_clusters_and_assignment(spark):
    v = spark.createDataFrame([(i, [1.0, i / 100, 0.0] if i % 2 else [0.0, i / 100, 1.0]) for i in range(1, 41)], "document_id long, embedding array<double>")
    one = clusters.cluster(v, 2)
    assert sorted(r["n"] for r in one.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()) == [20, 20]
    c, a = clusters.run_tables(one, v, 3, 0)
    assert c.count() == 2 and a.count() == 40 and c.where("is_noise").count() == 0
    cents = c.select("cluster_id", F.col("centroid").alias("embedding"))
    placed = clusters.assign_new(v, a.where("document_id > 10"), cents, cents.where("false").withColumn("parent_id", F.lit(1)), None)
    assert placed.count() == 10
    both = placed.join(a.select("document_id", F.col("cluster_id").alias("was")), "document_id")
    assert both.where("was <> cluster_id").count() == 0
    assert clusters.needs_full_run(False, True, 0, 0) and not clusters.needs_full_run(True, True, 1, 100)
    plane = clusters.reduce_pca(v, 2)
    assert plane.select(F.size("embedding").alias("n")).distinct().collect()[0].n == 2


def test_learning(spark):
    v = spark.createDataFrame([(i, [1.0, 0.1] if i % 2 else [0.1, 1.0]) for i in range(40)], "document_id long, embedding array<double>")
    labels = spark.createDataFrame([(i, i % 2, "manual") for i in range(20)], "document_id long, label int, source string")
    w, b, stat = learn.train(learn.label_matrix(labels, v), c=100.0)
    p = learn.probability(F.col("embedding"), w, b)
    assert stat == {"n": 20, "positive": 10}
    scored = {r.document_id: r.p for r in v.select("document_id", p.alias("p")).collect()}
    assert all((scored[i] > 0.5) == (i % 2 == 1) for i in range(40))
    assert learn.uncertainty_queue(v, labels, p, 3).count() == 3
    assert {r.document_id % 2 for r in learn.pseudo_labels(v, labels, p, 0.9, 0.1).where("label = 1").collect()} == {1}
    overlay = frame(spark, "document_id long, tag string, origin string", (20, "t", "learned"), (1, "t", "learned"))
    got = values(learn.apply_learned(overlay, v, labels, p, "t"))
    assert (20, "t", "learned") not in got and (1, "t", "learned") in got and len(got) == 11
    s = frame(spark, "session_id long, tag string, status string, accepted_at long", (1, "t", "accepted", 1), (2, "t", "open", None), (3, "u", "accepted", 1))
    assert [r.status for r in learn.accept_session(s, 2, 9).orderBy("session_id").collect()] == ["archived", "accepted", "accepted"]


def test_similar_pairs_prune_regions(spark):
    """Far clusters aren't compared, pairs are those of brute force, broken vectors have none."""
    import numpy as np

    rng = np.random.default_rng(3)
    hubs = np.eye(6)
    x = np.concatenate([h * 5 + rng.normal(size=(20, 6)) * 0.3 for h in hubs])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 6), (902, [1.0, None] + [0.0] * 4), (903, [1.0])]
    v = spark.createDataFrame(rows, "k long, e array<double>").repartition(3)
    want = sorted((i, j) for i in range(120) for j in range(i + 1, 120) if u[i] @ u[j] >= 0.97)
    assert sorted((r.a, r.b) for r in vectors.similar_pairs(v, "k", "e", 0.97, 8).collect()) == want and want
    near = np.array([u[20 * i] for i in range(6)])
    assert vectors._apart(near, np.full(6, 0.2), 0.97) == [(i, i) for i in range(6)]
    assert vectors.similar_pairs(v.where("k >= 900"), "k", "e", 0.5).count() <= 1


def test_hubs_of_components(spark):
    """A hub of many neighbours, joined by broadcast, and chains around it come out as one component each."""
    from tessera.operators.graph import CROWDED, connected_components

    n = CROWDED + 300
    edges = [(5, 1000 + i) for i in range(n)] + [(1000 + i, 5000 + i) for i in range(0, n, 3)] + [(9001, 9002), (9002, 9003), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got[9003] == 9001 and got[7] == 7
    assert {r for k, r in got.items() if k < 9000 and k != 7} == {5} and len(got) == n + 1 + -(-n // 3) + 4


def test_ranks_without_one_window(spark):
    """Ranks that come from sorted ranges are those of the whole order, and the plan sorts nothing in one task."""
    hits = spark.range(0, 5000).selectExpr("id AS doc_id", "cast(null as double) AS similarity", "(id * 7919) % 1000 AS s").repartition(5)
    out = search._ranked_widely(hits, "s", "doc_id")
    got = [(r.s, r.doc_id) for r in out.orderBy("rank").collect()]
    assert got == sorted(((i * 7919) % 1000, i) for i in range(5000))
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 5001))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_similar_pairs_without_copies_of_rows(spark):
    """Blocks meet in a product, a vector isn't dealt to all of them; columns of both sides come along."""
    import numpy as np

    x = np.random.default_rng(6).normal(size=(90, 5))
    v = spark.createDataFrame([(f"k{i}", r.tolist(), -i) for i, r in enumerate(x)], "k string, e array<double>, w long")
    got = vectors.similar_pairs(v, "k", "e", 0.6, 8, 1, extra=("w",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate explode" not in plan
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {tuple(sorted((f"k{i}", f"k{j}"))) for i in range(90) for j in range(i) if u[i] @ u[j] >= 0.6}
    rows = got.collect()
    assert len(rows) == len(want) and {(r.a, r.b) for r in rows} == want
    assert all((f"k{-r.a_w}", f"k{-r.b_w}") == (r.a, r.b) for r in rows)
