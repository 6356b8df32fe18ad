"""Operators against brute force on small inputs."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from veritrace.operators import chunking, entities, nearest, reasoning

SEP = re.compile(r"\n\s*\n+")


def tokens(text):
    return max(1, round(len(text.split()) * 1.3))


def model_units(pages):
    full = "\n\n".join(p for _, p in sorted(pages))
    out, base = [], 0
    for number, page in sorted(pages):
        at = 0
        for part in [*SEP.finditer(page), None]:
            end = part.start() if part else len(page)
            piece = page[at:end]
            if piece.strip():
                out.append((number, piece, base + at, base + end))
            at = part.end() if part else end
        base += len(page) + 2
    assert all(full[s:e] == t for _, t, s, e in out)
    return out


def model_pack(sizes, budget):
    """Greedy packing, one unit at a time."""
    ranges, first, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > first - 1 and total and total + size > budget:
            ranges.append((first, i - 1))
            first, total = i - 1, sizes[i - 1]
        total += size
    return ranges + [(first, len(sizes) - 1)] if sizes else ranges


def random_pages(rng, n_docs):
    rows = []
    for d in range(n_docs):
        for page in range(1, rng.randrange(1, 7) + 1):
            parts = []
            for _ in range(rng.randrange(0, 6)):
                parts.append(" ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 30))))
                parts.append(rng.choice(["\n\n", "\n \t\n\n", "\n", "\n\n  ", " \n\n"]))
            rows.append((f"d{d}", page, "".join(parts)))
    return rows


def test_chunks_follow_model_on_both_ways(spark):
    rng = random.Random(3)
    rows = random_pages(rng, 40)
    pages = spark.createDataFrame(rows, "document_id string, page_number int, text string")
    budget = 40
    want = set()
    for doc in {r[0] for r in rows}:
        units = model_units([(n, t) for d, n, t in rows if d == doc])
        for no, (a, b) in enumerate(model_pack([tokens(u[1]) for u in units], budget)):
            part = units[a:b + 1]
            text = "\n\n".join(u[1] for u in part)
            want.add((doc, no, part[0][0], part[-1][0], text, part[0][2], part[-1][3], tokens(text)))
    cols = ["document_id", "chunk_no", "page_start", "page_end", "text", "char_start", "char_end", "token_count"]
    for options in ({}, {"block": 7}):
        got = chunking.build_chunks(pages, budget=budget, **options).select(*cols).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want, options


def test_every_unit_is_in_one_or_two_chunks(spark):
    rng = random.Random(4)
    units = [("d", i, rng.randrange(1, 30)) for i in range(500)]
    df = spark.createDataFrame(units, "document_id string, unit_no long, tokens int")
    for options in ({}, {"block": 11}):
        ranges = sorted((r.first_unit, r.last_unit) for r in chunking.pack_units(df, 60, **options).collect())
        assert ranges == model_pack([u[2] for u in units], 60)
        count = np.zeros(500)
        for a, b in ranges:
            count[a:b + 1] += 1
        assert count.min() >= 1 and count.max() <= 2


def vector_rows(rng, n, copies):
    base = [rng.normal(size=6).round(2).tolist() for _ in range(max(1, n // 4))]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.1:
            v = None
        elif kind < 0.15:
            v = [0.0] * 6
        else:
            # A third of the rows are copies of one vector.
            v = base[0] if rng.random() < copies else base[rng.integers(len(base))]
        rows.append((int(i), "p" + str(rng.integers(3)), "d" + str(rng.integers(5)), v))
    return rows


def brute_nearest(asked, pool, k, owned=True, grouped=True):
    out = {}
    for i, g, o, v in asked:
        found = []
        for j, h, p, w in pool:
            if (grouped and g != h) or (owned and o == p):
                continue
            if v is None or w is None:
                d = (2, 0.0)
            elif not np.any(v) or not np.any(w):
                d = (1, 0.0)
            else:
                a, b = np.float32(v).astype(float), np.float32(w).astype(float)
                d = (0, round(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), 9))
            found.append((d, j))
        for rank, (_, j) in enumerate(sorted(found)[:k], 1):
            out[i, rank] = j
    return out


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = vector_rows(rng, 160, 0.34)
    schema = "id int, g string, owner string, embedding array<float>"
    df = spark.createDataFrame(rows, schema)
    asked, pool = df.withColumnRenamed("id", "anchor_id"), df.withColumnRenamed("id", "candidate_id")
    want = brute_nearest(rows, rows, 5)
    for tile in (4096, 7):
        got = nearest.nearest(asked, pool, 5, group=["g"], tile_rows=tile).collect()
        assert {(r.anchor_id, r.rank): r.candidate_id for r in got} == want
    want = brute_nearest(rows, rows, 4, owned=False, grouped=False)
    got = nearest.nearest_to_questions(asked, pool, 4).collect()
    assert {(r.anchor_id, r.rank): r.candidate_id for r in got} == want


def test_bucketed_search_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16))
    rows = [(i, (centres[i % 8] + 0.2 * rng.normal(size=16)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    asked, pool = df.withColumnRenamed("id", "anchor_id"), df.withColumnRenamed("id", "candidate_id")
    extra = spark.createDataFrame([(1000, None)], df.schema)
    asked = asked.union(extra)
    exact = {(r.anchor_id, r.candidate_id) for r in nearest.nearest(asked, pool, 4).collect()}
    close = {(r.anchor_id, r.candidate_id) for r in nearest.nearest_by_bucket(asked, pool, 4, 16, tables=6, bits=4).collect()}
    assert len(exact & close) / len(exact) > 0.9
    # Rows without a vector are answered too.
    assert sum(a == 1000 for a, _ in close) == 4 and len(close) == len(exact)


def test_cells_find_neighbours(spark):
    from veritrace.operators.cells import nearest_by_cells, train_cells

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.2 * rng.normal(size=16)).tolist()) for i in range(400)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, rows[0][1])]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    asked, pool = df.withColumnRenamed("id", "anchor_id"), df.withColumnRenamed("id", "candidate_id")
    cells = train_cells(pool, 4)
    # Vectors that cluster need few of the cells.
    assert cells.probes <= len(cells.centres) // 4
    exact = {(r.anchor_id, r["rank"]): r.candidate_id for r in nearest.nearest(asked, pool, 4).collect()}
    close = {(r.anchor_id, r["rank"]): r.candidate_id for r in nearest_by_cells(asked, pool, 4, cells).collect()}
    assert close.keys() == exact.keys()
    assert sum(exact[key] == close[key] for key in exact) / len(exact) > 0.9
    assert all(exact[i, n] == close[i, n] for i in (1000, 1001) for n in range(1, 5))
    none = pool.filter("candidate_id in (1000, 1001)")
    assert train_cells(none, 4) is None and nearest_by_cells(asked.filter("anchor_id < 5"), none, 4).count() == 10


def test_block_search_of_cells_is_exact_and_sends_each_candidate_once_a_block(spark, monkeypatch):
    from veritrace.operators import inverted

    monkeypatch.setattr(inverted, "LEAST_ROWS", 40)
    monkeypatch.setattr(inverted, "CHUNK_ROWS", 64)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 8)).astype(np.float32).tolist()
    rows = [(f"c{i:03d}", v) for i, v in enumerate(vectors + vectors[:60] + vectors[:9] * 6)] + [("x", None), ("y", [0.0] * 8)]
    pool = spark.createDataFrame(rows, "candidate_id string, embedding array<float>")
    asked = pool.withColumnRenamed("candidate_id", "anchor_id")
    # All vectors are in cell 1 and in one or two of the others.
    shared = lambda v: np.stack([np.ones(len(v), dtype=int), 2 + (v[:, 0] > 0), 4 + (v[:, 1] > 0.3)], axis=1)
    got = {(r.anchor_id, r["rank"]): (r.candidate_id, r.distance) for r in inverted.nearest_in_cells(asked, pool, 5, shared, shared).collect()}
    want = {(r.anchor_id, r["rank"]): (r.candidate_id, r.distance) for r in nearest.nearest(asked, pool, 5).collect() if r.anchor_id not in "xy"}
    assert got == want
    few = nearest.distinct_candidates(pool.filter("candidate_id < 'x'"), 5, [], False).drop("vkey")
    wanted = spark.createDataFrame([(b, c) for b in range(7) for c in (1, 2, 3, 4, 5)], "block int, cell int")
    assert inverted._sent(few, wanted, 7, shared).count() == 7 * few.count()
    half = spark.createDataFrame([(b, 2 + b % 2) for b in range(6)], "block int, cell int")
    assert inverted._sent(few, half, 6, lambda v: shared(v)[:, 1:2]).count() == 3 * few.count()


def test_rows_once_by_one_sort(spark, capsys):
    from veritrace.operators import graph

    rows = [(i % 7 if i % 5 else None, f"e{i % 11}", i % 2 or None) for i in range(300)]
    df = spark.createDataFrame(rows, "fact_id int, evidence_id string, page int")
    once = graph.once(df, "fact_id")
    assert sorted(map(repr, map(tuple, once.collect()))) == sorted(map(repr, set(rows))) and once.columns == df.columns
    graph.once(df.repartition("fact_id"), "fact_id").repartition("fact_id").explain()
    plan = capsys.readouterr().out
    assert plan.count("Sort [") == 1 and "HashAggregate" not in plan


def test_chunks_read_their_pages_twice_at_most(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        seen.add(1)
        return "\n\n".join(f"unit {j} " + "word " * (j % 7) for j in range(i % 9)) + "\n \n"

    ids = spark.range(40).select((F.col("id") % 5).alias("document_id"), F.floor(F.col("id") / 5).alias("page_number"), "id")
    pages = ids.withColumn("text", text.asNondeterministic()("id"))
    chunks = chunking.build_chunks(pages, budget=20, block=8).collect()
    assert seen.value <= 2 * 40
    plain = spark.createDataFrame(pages.collect(), pages.schema)
    want = chunking.build_chunks(plain, budget=20).collect()
    assert sorted(map(repr, chunks)) == sorted(map(repr, want)) and len(want) > 20
    for c in chunks:
        assert c.unit_pages[0]["at"] == 0 and c.unit_pages[0].page_number == c.page_start and c.unit_pages[-1].page_number == c.page_end
        assert c.token_count == max(1, round(len(c.text.split()) * 1.3))


def grams(name):
    out = set()
    for word in re.findall(r"[^\W_]+", (name or "").lower()):
        word = "  " + word + " "
        out |= {word[i:i + 3] for i in range(len(word) - 2)}
    return out


def alike(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def random_names(rng, n):
    parts = ["acme", "retail", "holdings", "ltd", "north", "foods", "group", "limited", "1", "22"]
    return sorted({" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n)})


def test_candidates_are_exact(spark):
    rng = random.Random(8)
    known = [(i, n, rng.choice(["org", "place"])) for i, n in enumerate(random_names(rng, 60) + ["foods acme", "acme foods", None, ""])]
    asked = [(i, n, rng.choice(["org", "place"])) for i, n in enumerate(random_names(rng, 50) + ["", "acme", "acme", None, "zq"])]
    mentions = spark.createDataFrame(asked, "mention_id int, name string, entity_type string")
    stored = spark.createDataFrame(known, "entity_id int, canonical_name string, entity_type string")
    want = set()
    for i, n, kind in asked:
        best = sorted((-alike(n, m), j) for j, m, k in known if k == kind)[:8]
        want |= {(i, j, rank) for rank, (_, j) in enumerate(best, 1)}
    for options in ({}, {"first_read": 0, "part": 4}, {"first_read": 12}):
        got = entities.candidate_entities(mentions, stored, **options).collect()
        assert {(r.mention_id, r.entity_id, r["rank"]) for r in got} == want, options


def test_similar_names_read_no_long_lists(spark):
    """Names that share most trigrams with all entities meet only those that share rare ones, too."""
    from unittest import mock

    known = [(i, f"Supplier#{i:09d}", "org") for i in range(600)]
    asked = [(i, f"Supplier {i * 7:09d}", "org") for i in range(60)]
    mentions = spark.createDataFrame(asked, "mention_id int, name string, entity_type string")
    stored = spark.createDataFrame(known, "entity_id int, canonical_name string, entity_type string")
    visits, visit = [], entities._visit

    def seen(*given):
        visits.append(visit(*given).count())
        return visit(*given)

    with mock.patch.object(entities, "_visit", seen):
        got = entities.candidate_entities(mentions, stored).collect()
    want = set()
    for i, n, _ in asked:
        best = sorted((-alike(n, m), j) for j, m, _ in known)[:8]
        want |= {(i, j, rank) for rank, (_, j) in enumerate(best, 1)}
    assert {(r.mention_id, r.entity_id, r["rank"]) for r in got} == want
    assert sum(visits) < len(asked) * 20


def test_batch_resolution_goes_one_by_one(spark):
    rng = random.Random(9)
    names = random_names(rng, 80)
    rng.shuffle(names)
    rows = [(i, n, "org", i) for i, n in enumerate(names)]
    seeds, want = [], {}
    for i, n in enumerate(names):
        near = [(-alike(n, names[s]), s) for s in seeds if np.float32(alike(n, names[s])) >= np.float32(0.75)]
        want[i] = min(near)[1] if near else i
        if not near:
            seeds.append(i)
    df = spark.createDataFrame(rows, "mention_id int, name string, entity_type string, seq int")
    for options in ({}, {"small": 0, "tile": 5}):
        got = entities.resolve_batch(df, **options).collect()
        assert {r.mention_id: r.seed_id for r in got} == want, options


def test_batch_resolution_of_a_chain(spark):
    """Each name is like its neighbours only, so every decision waits for the one before."""
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(40)]
    names = [" ".join(words[i:i + 10]) for i in range(30)]
    seeds, want = [], {}
    for i, n in enumerate(names):
        near = [(-alike(n, names[s]), s) for s in seeds if np.float32(alike(n, names[s])) >= np.float32(0.75)]
        want[i] = min(near)[1] if near else i
        if not near:
            seeds.append(i)
    assert len(seeds) < len(names)
    df = spark.createDataFrame([(i, n, "org", i) for i, n in enumerate(names)], "mention_id int, name string, entity_type string, seq int")
    assert {r.mention_id: r.seed_id for r in entities.resolve_batch(df).collect()} == want


def test_facts_of_long_texts_keep_their_numbers(spark):
    from veritrace.operators import extraction

    plain = " ".join(f"Sentence number {i} says nothing." for i in range(2500))
    many = ", ".join(f"revenue of Rs. {i} crore" for i in range(1, 2001))
    df = spark.createDataFrame([("a", plain + " Acme reported revenue of Rs. 10 crore."), ("b", "Acme reported " + many + ".")], "chunk_id string, text string")
    got = extraction.extract_by_rule(df).groupBy("chunk_id").agg(F.count("fact_no").alias("n"), F.countDistinct("fact_no").alias("d")).collect()
    assert {(r.chunk_id, r.n, r.d) for r in got} == {("a", 1, 1), ("b", 2000, 2000)}


def test_neighbours_store_each_frontier(spark):
    """Edges may repeat and lead back; the frontier has a known size when it joins them."""
    from veritrace.operators import graph

    edges = [("a", "b"), ("a", "b"), ("c", "a"), ("b", "a"), ("b", "d"), ("d", "e"), ("x", "y"), ("c", "c")]
    found = graph.neighbours(spark.createDataFrame(edges, "src string, dst string"), "a", 2)
    assert {(r.node, r.hops) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)} and found.count() == 4
    assert any("frontier-" in f for f in found.inputFiles())


def test_groups_that_share_vectors(spark):
    """Zero, missing and tied vectors, owners with most of the near rows, and groups with too few."""
    rng = np.random.default_rng(5)
    vectors = [None, [0.0] * 4, *[[float(x) for x in v] for v in rng.integers(-3, 4, (30, 4)).astype(float) if v.any()]]
    rows = [(i, vectors[rng.integers(len(vectors))], int(rng.integers(6)) if i < 900 else 6, int(rng.choice([0, 0, 0, 1, 2, 3]))) for i in range(904)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>, g int, owner int")
    anchors = df.select(F.col("id").alias("anchor_id"), "embedding", "g", "owner")
    candidates = df.filter("id % 3 > 0").select(F.col("id").alias("candidate_id"), "embedding", "g", "owner")
    pairs = nearest.nearest_in_groups(anchors, candidates, 5, ["g"])
    # The vectors are compared once for all groups, not only group by group.
    assert "posexplode" in pairs._jdf.queryExecution().toString()
    want = {(r.anchor_id, r.candidate_id, r["rank"], str(r.distance)) for r in nearest.nearest(anchors, candidates, 5, ["g"]).collect()}
    assert {(r.anchor_id, r.candidate_id, r["rank"], str(r.distance)) for r in pairs.collect()} == want and len(want) > 4000


def test_groups_without_a_distance_meet_the_smallest_ids(spark):
    """Anchors with a zero or missing vector do not send all vectors of their groups again."""
    from unittest import mock

    rng = np.random.default_rng(6)
    vectors = [None, [0.0] * 4, *[[float(x) for x in v] for v in rng.normal(size=(40, 4))]]
    rows = [(i, vectors[i % 42], i % 5, i % 97) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>, g int, owner int")
    anchors = df.select(F.col("id").alias("anchor_id"), "embedding", "g", "owner")
    candidates = df.select(F.col("id").alias("candidate_id"), "embedding", "g", "owner")
    want = {(r.anchor_id, r.candidate_id, r["rank"], str(r.distance)) for r in nearest.nearest(anchors, candidates, 5, ["g"]).collect()}
    sizes, nearest_of = [], nearest.nearest

    def seen(a, c, k, group=None, **more):
        if group:
            sizes.append(c.count())
        return nearest_of(a, c, k, group, **more)

    with mock.patch.object(nearest, "nearest", seen):
        found = nearest.nearest_in_groups(anchors, candidates, 5, ["g"])
    assert {(r.anchor_id, r.candidate_id, r["rank"], str(r.distance)) for r in found.collect()} == want
    assert sum(sizes) <= 5 * 2 * 10


def test_questions_meet_each_vector_once(spark):
    from unittest import mock

    vectors = [None, [0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [-1.0, 1.0], [1.0, -1.0]]
    rows = [(i, vectors[i * i % 7 if i > 30 else i % 7]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    questions = df.limit(14).select(F.col("id").alias("anchor_id"), "embedding")
    candidates = df.select(F.col("id").alias("candidate_id"), "embedding")
    want = {(r.anchor_id, r.candidate_id, r["rank"], str(r.distance)) for r in nearest.nearest(questions, candidates, 6).collect()}
    sizes, nearest_of = [], nearest.nearest

    def counted(anchors, offered, k, group=None, **other):
        sizes.append(offered.count())
        return nearest_of(anchors, offered, k, group, **other)

    with mock.patch.object(nearest, "nearest", counted):
        got = nearest.nearest_to_questions(questions, candidates, 6).collect()
    assert {(r.anchor_id, r.candidate_id, r["rank"], str(r.distance)) for r in got} == want and sizes == [len(vectors)]


def test_vectors_are_not_copied_per_group(spark):
    """As many groups as it takes for the vectors to weigh: they cross a shuffle once, whatever the number of groups."""
    from unittest import mock

    from veritrace.operators import reasoning as r

    facts = spark.range(6000).select(
        F.col("id").alias("fact_id"), (F.col("id") % 20).alias("predicate_id"), (F.col("id") % 613).alias("document_id"), F.lit("active").alias("status"),
        F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: F.sin(j * (1 + F.col("id") % 37)).cast("float")).alias("embedding"),
    )
    sizes = []

    def counted(anchors, candidates, k, group=None, **other):
        sizes.append(anchors.count())
        return nearest_of(anchors, candidates, k, group, **other)

    nearest_of = nearest.nearest
    with mock.patch.object(nearest, "nearest", counted):
        found = r.related_facts(facts).count()
    # 37 vectors among themselves, and no fact is left for its own comparison.
    assert found == 30000 and sizes == [37, 0]


def test_numbers_of_names_and_values_are_no_periods(spark):
    from veritrace.operators import extraction

    texts = {
        "Supplier 2049 reported revenue of Rs. 1 crore for FY99.": ["FY99"],
        "Supplier 2049 reported revenue of Rs. 1 crore.": [None],
        "Mill 7 reported turnover of Rs. 1945 crore for FY2019.": ["FY2019"],
        "Mill 1944 reported ebitda of 2050 units, revenue of Rs. 2 crore.": [None, None],
        "Q3 FY2025 recorded revenue of Rs. 5 crore, as in 2024.": ["Q3 FY2025"],
        "In financial year 2024 employees were 2030 people.": ["financial year 2024", "financial year 2024"],
        "Mill 1999 reported revenue of Rs. 5 crore in 2021, headcount of 20 people.": ["2021", "2021"],
    }
    df = spark.createDataFrame([(t, t) for t in texts], "chunk_id string, text string")
    got = {}
    for r in extraction.extract_by_rule(df).orderBy("fact_no").collect():
        got.setdefault(r.chunk_id, []).append(r.time_value)
    assert got == texts


def test_decisions_and_guard(spark):
    rows = [(1, "a", 0.96), (2, "a", 0.95), (3, "a", 0.9), (4, "a", 0.75), (5, "a", 0.74), (6, "x", 0.99), (7, None, None)]
    choices = spark.createDataFrame(rows, "mention_id int, match_entity_id string, confidence float")
    offered = spark.createDataFrame([(i, "a") for i in range(1, 8)], "mention_id int, entity_id string")
    mentions = spark.createDataFrame([(i, "n") for i in range(1, 9)], "mention_id int, name string")
    out = entities.resolve(mentions, entities.guard_choice(choices, offered)).orderBy("mention_id").collect()
    assert [r.decision for r in out] == ["link", "link", "alias", "alias", "new", "new", "new", "new"]


def judged(spark, **sides):
    base = dict(
        a_subject="X", b_subject="x", a_predicate="revenue", b_predicate="revenue", a_value_raw="Rs. 10 crore", b_value_raw="Rs. 10 crore",
        a_time_value="FY2025", b_time_value="FY25", a_scope=None, b_scope=None, a_quote="q", b_quote="q", a_filename="f", b_filename="g",
    ) | sides
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} string" for k in base))
    from veritrace.functions.values import normalize_period, normalize_value

    for s in "ab":
        df = df.withColumn(f"{s}_value", normalize_value(F.col(f"{s}_value_raw"))).withColumn(
            f"{s}_period", normalize_period(F.col(f"{s}_time_value"))
        )
    return reasoning.classify_pairs(df).first().relationship_type


def test_classifier_rules(spark):
    assert judged(spark) == "CORROBORATES"
    assert judged(spark, b_subject="Y") == "UNRELATED"
    assert judged(spark, b_value_raw="soon") == "UNCERTAIN"
    assert judged(spark, b_value_raw="10%") == "UNCERTAIN"
    assert judged(spark, b_value_raw="INR 0.1 billion") == "UNIT_DIFFERENCE"
    assert judged(spark, b_value_raw="Rs. 11 crore") == "CONTRADICTS"
    assert judged(spark, b_value_raw="Rs. 11 crore", b_quote="restated revenue") == "TEMPORAL_UPDATE"
    assert judged(spark, b_value_raw="Rs. 11 crore", a_scope="standalone", b_scope="consolidated") == "SCOPE_DIFFERENCE"
    assert judged(spark, b_value_raw="Rs. 3 crore", b_time_value="Q1 FY2025") == "RECONCILES"
    assert judged(spark, b_value_raw="Rs. 9 crore", b_time_value="FY2024") == "RECONCILES"
    assert judged(spark, b_value_raw="Rs. 9 crore", b_time_value=None) == "POTENTIAL_CONTRADICTION"


def test_pairs_are_idempotent(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (2, 2)], "fact_a_id int, fact_b_id int")
    once = reasoning.dedupe_pairs(pairs)
    assert {tuple(r) for r in once.collect()} == {(1, 2), (3, 1)}
    assert {tuple(r) for r in reasoning.dedupe_pairs(once).collect()} == {(1, 2), (3, 1)}
    assert {tuple(r) for r in reasoning.new_pairs(once, spark.createDataFrame([(1, 3)], pairs.schema)).collect()} == {(1, 2)}


def test_timeline_of_hot_keys(spark):
    """A subject without a name, events without a period and a day with very many events, over few rows a range."""
    from veritrace.operators import views

    rng = random.Random(12)
    days = [None, None, "2024-03-01", "2024-03-01", "2023-01-31", "2025-12-31"]
    rows = [(i, rng.choice([None, None, "a", "b"]), rng.choice(["p", None]), rng.choice(days), rng.choice([None, 1.0, 2.5, 7.0])) for i in range(400)]
    schema = "fact_id int, subject_entity_id string, predicate_id string, period_start string, amount double"
    df = spark.createDataFrame(rows, schema).withColumn("period_start", F.col("period_start").cast("date"))
    want, last = {}, {}
    for i, s, p, day, amount in sorted(rows, key=lambda r: (r[3] is None, r[3] or "", r[0])):
        no, before = last.get((s, p), (0, None))
        want[i] = (no + 1, None if before is None or amount is None else amount - before)
        last[s, p] = no + 1, amount
    got = views.timeline(df)
    assert {r.fact_id: (r.event_no, r.change) for r in got.collect()} == want
    assert views.timeline(df.limit(0)).count() == 0
