"""The whole flow on a small corpus: batch, replay and stream."""

import pytest
from pyspark.sql import functions as F

from veritrace.operators import graph
from veritrace.operators.runlog import job_state
from veritrace.plans import flows
from veritrace.plans.flows import ask, ingest_documents, recompute
from veritrace.session import scratch_path
from veritrace.sources.store import Store
from veritrace.sources.tables import scan_files
from veritrace.streaming.ingest import landing_stream, start_ingest

CORPUS = [
    ("1-report.txt", "Nordwind Mills\n\nNordwind Mills reported consolidated revenue of Rs. 840 crore for FY2025."),
    ("2-deck.txt", "Deck\n\nNordwind Mills announced turnover of INR 8.4 billion for FY25, a record."),
    ("3-release.txt", "Nordwind Mills announced consolidated revenue of Rs. 910 crore for FY2025."),
    ("4-quarter.txt", "Nordwind Mills reported revenue of Rs. 80 crore for Q1 FY2025.\fSecond page."),
    ("5-growth.txt", "Nordwind Mills reported that total income increased by 14.1% to Rs. 950 crore for FY2025."),
    ("6-copy.txt", "Nordwind Mills announced consolidated revenue of Rs. 910 crore for FY2025."),
]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """The corpus is tiny and the flow has many steps."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def arrivals(spark, rows=CORPUS):
    return spark.createDataFrame(rows, "filename string, text string")


def contents(store):
    keys = {
        "documents": ["filename", "page_count"], "chunks": ["chunk_id", "text"], "facts": ["fact_id", "value_raw", "time_value"],
        "entities": ["canonical_name"], "evidence": ["evidence_id", "quote"], "predicates": ["canonical_name"],
        "relationships": ["fact_a_id", "fact_b_id", "relationship_type"], "jobs": ["document_id", "stage", "metrics"],
    }
    return {t: sorted(map(tuple, store.read(t).select(*c).collect()), key=repr) for t, c in keys.items()}


def assert_one_of_each(store):
    """No row is there twice, and every pair once in either direction."""
    for table, key in (("documents", "document_id"), ("pages", ["document_id", "page_number"]), ("chunks", "chunk_id"), ("facts", "fact_id"),
                       ("evidence", "evidence_id"), ("entities", "entity_id"), ("predicates", "predicate_id"), ("nodes", ["label", "node_id"])):
        rows = store.read(table)
        assert rows.count() == rows.dropDuplicates([key] if isinstance(key, str) else key).count(), table
    pairs = [frozenset(r) for r in store.read("relationships").select("fact_a_id", "fact_b_id").collect()]
    assert len(pairs) == len(set(pairs))


def assert_graph_is_that_of_the_store(store):
    t = {name: store.read(name) for name in ("documents", "facts", "entities", "evidence", "relationships")}
    nodes = graph.nodes(t["documents"], t["facts"], t["entities"], t["evidence"])
    stored = store.read("nodes")
    assert sorted(map(repr, stored.select(*nodes.columns).collect())) == sorted(map(repr, nodes.collect()))
    edges = graph.edges(*t.values())
    assert sorted(map(tuple, store.read("edges").collect())) == sorted(map(tuple, edges.collect()))


def test_flow(spark):
    store = Store(spark, scratch_path(spark, "flow"))
    ingest_documents(store, arrivals(spark))
    names = [r.filename for r in store.read("documents").orderBy("filename").collect()]
    assert names == [n for n, _ in CORPUS if n != "6-copy.txt"]
    found = store.read("facts").join(store.read("predicates"), "predicate_id").select("canonical_name", "value_raw", "time_value", "scope")
    assert {tuple(r) for r in found.collect()} == {
        ("revenue", "Rs. 840 crore", "FY2025", "consolidated"), ("revenue", "INR 8.4 billion", "FY25", None),
        ("revenue", "Rs. 910 crore", "FY2025", "consolidated"), ("revenue", "Rs. 80 crore", "Q1 FY2025", None),
        ("total income growth", "14.1%", "FY2025", None), ("total income", "Rs. 950 crore", "FY2025", None),
    }
    assert [r.canonical_name for r in store.read("entities").collect()] == ["Nordwind Mills"]

    value = store.read("facts").select("fact_id", "value_raw")
    rel = (
        store.read("relationships")
        .join(value.select(F.col("fact_id").alias("fact_a_id"), F.col("value_raw").alias("a")), "fact_a_id")
        .join(value.select(F.col("fact_id").alias("fact_b_id"), F.col("value_raw").alias("b")), "fact_b_id")
    )
    labels = {frozenset((r.a, r.b)): r.relationship_type for r in rel.collect()}
    assert labels[frozenset(("Rs. 840 crore", "INR 8.4 billion"))] == "UNIT_DIFFERENCE"
    assert labels[frozenset(("Rs. 840 crore", "Rs. 910 crore"))] == "CONTRADICTS"
    assert labels[frozenset(("Rs. 840 crore", "Rs. 80 crore"))] == "RECONCILES"

    # Every stored quote is cut from its chunk by the stored offsets.
    cut = store.read("evidence").join(store.read("chunks").select("chunk_id", "text"), "chunk_id")
    for r in cut.collect():
        assert r.text[r.char_start:r.char_end] == r.quote

    # Replaying the batch stores nothing twice, and a recomputation finds nothing new.
    before = contents(store)
    ingest_documents(store, arrivals(spark))
    assert contents(store) == before
    summary, _ = recompute(*[store.read(t) for t in ("facts", "evidence", "documents", "entities", "predicates", "relationships")])
    assert tuple(summary.first()) == (6, 0)

    # The same content arriving later is a duplicate.
    ingest_documents(store, arrivals(spark, [("9-again.txt", CORPUS[0][1])]), batch=1)
    assert store.read("documents").count() == 5

    asked = spark.createDataFrame([(1, "revenue of Nordwind Mills FY2025"), (2, " ")], "question_id int, question string")
    parts = ask(store, asked).collect()
    assert {r.question_id for r in parts} == {1}
    kinds = [r.component_type for r in sorted(parts, key=lambda r: (r.section, r["rank"]))]
    assert kinds[-1] == "SourcePreview" and all(r.quote for r in parts if r.component_type == "SourcePreview")
    assert all(r.confidence is not None and r.explanation for r in parts if r.component_type == "ConflictCard")
    assert kinds[0] == "AnswerText" and kinds.count("FactCard") == 6 and "ConflictCard" in kinds


def test_stream_equals_batch(spark):
    root = scratch_path(spark, "landing")
    batch = Store(spark, f"{root}/batch")
    ingest_documents(batch, arrivals(spark))
    arrivals(spark).coalesce(1).write.parquet(f"{root}/in")
    stream = Store(spark, f"{root}/stream")
    for _ in range(2):
        start_ingest(landing_stream(spark, f"{root}/in"), stream, f"{root}/checkpoint", available_now=True).awaitTermination()
    assert contents(stream) == contents(batch)


def test_stream_reads_a_table_in_a_folder(spark):
    from veritrace.plans.queries_stream import stream_ingest

    root = scratch_path(spark, "folder")
    rows = [(1, "One text."), (2, "Another text."), (3, "One text.")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(9, "Of another table.")], "doc_id long, text string").write.parquet(f"{root}/pages.parquet")
    got = stream_ingest(spark, root).collect()
    assert {(r.filename, r.n_chunks, r.n_chars) for r in got} == {("000000000001.txt", 1, 9), ("000000000002.txt", 1, 13)}


def test_documents_arriving_later_are_compared_with_stored_ones(spark):
    store = Store(spark, scratch_path(spark, "steps"))
    for n, row in enumerate(CORPUS[:3]):
        ingest_documents(store, arrivals(spark, [row]), batch=n)
    kinds = sorted(r.relationship_type for r in store.read("relationships").collect())
    assert kinds == ["CONTRADICTS", "CONTRADICTS", "UNIT_DIFFERENCE"]
    assert store.read("entities").count() == 1


def test_one_document_per_content(spark):
    store = Store(spark, scratch_path(spark, "copies"))
    rows = [("a.pdf", CORPUS[0][1]), ("a.pdf", CORPUS[0][1]), ("b.pdf", CORPUS[0][1]), ("a.pdf", CORPUS[2][1])]
    ingest_documents(store, arrivals(spark, rows))
    assert sorted(r.filename for r in store.read("documents").collect()) == ["a.pdf", "a.pdf"]
    assert store.read("chunks").count() == store.read("chunks").dropDuplicates(["chunk_id"]).count() == 2
    assert store.read("facts").count() == 2
    ingest_documents(store, arrivals(spark, rows[1:3]), batch=1)
    assert store.read("documents").count() == 2


def test_provider_errors_stay_with_their_texts(spark):
    def load(known):
        def answer(texts):
            if any("broken" in t for t in texts):
                raise ValueError("model refused")
            return ['{"facts": [{"subject": "Acme", "subject_type": "org", "predicate": "revenue", "value_raw": "Rs. 5 crore", "quote": "Rs. 5 crore"}]}' for _ in texts]
        return answer

    store = Store(spark, scratch_path(spark, "provider"))
    ingest_documents(store, arrivals(spark, [("good.txt", "Revenue was Rs. 5 crore."), ("bad.txt", "This one is broken.")]), provider=load)
    names = {r.document_id: r.filename for r in store.read("documents").collect()}
    assert store.read("facts").count() == 1
    states = {(names[r.document_id], r.status): r.error for r in job_state(store.read("jobs")).collect() if r.stage == "extract_facts"}
    assert states == {("good.txt", "done"): None, ("bad.txt", "failed"): "model refused"}


def test_failed_stage_is_logged_and_may_be_tried_again(spark):
    store = Store(spark, scratch_path(spark, "failed"))

    def broken(chunks):
        raise RuntimeError("no extractor today")

    with pytest.raises(RuntimeError):
        ingest_documents(store, arrivals(spark, CORPUS[:1]), extract=broken)
    assert [r.status for r in store.read("documents").collect()] == ["failed"]
    states = {r.stage: (r.status, r.error) for r in job_state(store.read("jobs")).collect()}
    assert states["extract_facts"] == ("failed", "no extractor today") and states["chunk"] == ("done", None)
    assert "reason_relationships" not in states
    ingest_documents(store, arrivals(spark, CORPUS[:1]), batch=1)
    assert [r.status for r in store.read("documents").collect()] == ["ready"]
    assert store.read("facts").count() == 1


def _failing(spark, monkeypatch, stage):
    """Arguments of an ingest in which one stage fails, when Spark gets to it."""
    def late(df, *_):
        return df.withColumn(df.columns[0], F.when(F.raise_error(F.lit("stopped")).isNull(), df[df.columns[0]]))

    if stage == "extract_text":
        own = flows.text_pages
        monkeypatch.setattr(flows, "text_pages", lambda docs: late(own(docs)))
    elif stage == "chunk":
        own = flows.chunking.build_chunks
        monkeypatch.setattr(flows.chunking, "build_chunks", lambda pages: late(own(pages)))
    elif stage == "embed":
        return {"embed": lambda text: F.when(F.raise_error(F.lit("stopped")).isNull(), flows.embed_hash(text))}
    elif stage == "extract_facts":
        return {"extract": lambda chunks: late(flows.extraction.extract_by_rule(chunks))}
    else:
        return {"classify": lambda context: late(flows.reasoning.classify_pairs(context))}
    return {}


def test_batches_that_fail_leave_nothing_and_can_be_repeated(spark, monkeypatch):
    """Each of the five stages stops once; then the batch goes through, is compacted, and its remains are deleted."""
    store = Store(spark, scratch_path(spark, "kill"))
    ingest_documents(store, arrivals(spark, CORPUS[1:2]))
    before = contents(store)
    kept = ("chunks", "facts", "entities", "evidence", "predicates", "relationships")
    for batch, stage in enumerate(flows.runlog.STAGES, 1):
        # The classifier is only asked if there is a pair.
        with monkeypatch.context() as patch, pytest.raises(Exception, match="stopped"):
            ingest_documents(store, arrivals(spark, CORPUS[:1]), batch=batch, **_failing(spark, patch, stage))
        assert {t: r for t, r in contents(store).items() if t in kept} == {t: before[t] for t in kept}
        assert sorted(r.status for r in store.read("documents").collect()) == ["failed", "ready"]
        last = [r for r in store.read("jobs").filter("status = 'failed'").collect() if r.seq // 2 // 5 == batch]
        assert [(r.stage, "stopped" in r.error) for r in last] == [(stage, True)]
    for _ in range(2):
        ingest_documents(store, arrivals(spark, CORPUS[:1]), batch=6)
        assert {r.status for r in store.read("documents").collect()} == {"ready"}
        assert store.read("facts").count() == 2 and store.read("relationships").count() == 1
    assert_one_of_each(store)
    assert_graph_is_that_of_the_store(store)

    before = contents(store)
    gone = store.vacuum()
    assert gone and contents(store) == before
    assert store.compact() and not store.compact()
    assert [e.batch for e in store.visible()] == [5, 6] and contents(store) == before
    assert store.vacuum() and contents(store) == before
    ingest_documents(store, arrivals(spark, CORPUS[2:3]), batch=7)
    assert_one_of_each(store)
    assert_graph_is_that_of_the_store(store)
    assert store.read("relationships").count() == 3


def test_a_provider_knows_the_predicates_of_earlier_batches(spark):
    def load(known):
        def answer(texts):
            fact = '{"facts": [{"subject": "Acme", "subject_type": "org", "predicate": "%s", "value_raw": "Rs. 5 crore", "quote": "Rs. 5 crore"}]}'
            return [fact % (known[0] + " again" if known else "turnover of mills") for _ in texts]
        return answer

    store = Store(spark, scratch_path(spark, "known"))
    ingest_documents(store, arrivals(spark, [("a.txt", "One had Rs. 5 crore.")]), provider=load)
    ingest_documents(store, arrivals(spark, [("b.txt", "Two had Rs. 5 crore.")]), batch=1, provider=load)
    assert sorted(r.canonical_name for r in store.read("predicates").collect()) == ["turnover of mills", "turnover of mills again"]
    with pytest.raises(ValueError):
        flows.extraction.known_predicates(store.read("predicates"), most=10)


def test_pages_with_layout_and_exact_pages_of_quotes(spark):
    rows = [("scan.txt", "Cover.\fx\fAcme Mills reported revenue of Rs. 70 crore for FY2025.", [
        (1.0, None, None), (1e6, "Acme Mills reported revenue of Rs. 60 crore for FY2024.", [90.0, -1.0, 80.0]), (1.0, "not used", None)])]
    docs = spark.createDataFrame(rows, f"filename string, text string, layout {flows.LAYOUT}")
    for exact, want in ((False, [1, 1]), (True, [2, 3])):
        store = Store(spark, scratch_path(spark, "layout"))
        ingest_documents(store, docs, exact_pages=exact)
        pages = store.read("pages").orderBy("page_number").collect()
        assert [p.extraction_method for p in pages] == ["native", "ocr", "native"] and abs(pages[1].confidence - 0.85) < 1e-6
        assert store.read("chunks").count() == 1
        assert [r.page_number for r in store.read("evidence").orderBy("page_number").collect()] == want


def test_pages_that_are_there_twice_stop_the_batch(spark, monkeypatch):
    own = flows.text_pages
    monkeypatch.setattr(flows, "text_pages", lambda docs: own(docs).union(own(docs)))
    store = Store(spark, scratch_path(spark, "twice"))
    with pytest.raises(ValueError, match="more than once"):
        ingest_documents(store, arrivals(spark, CORPUS[:1]))
    assert [r.status for r in store.read("documents").collect()] == ["failed"]


def test_scan_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "b.txt").write_bytes(b"no")
    rows = scan_files(spark, str(tmp_path)).collect()
    assert [(r.filename, bytes(r.content), r.n_bytes) for r in rows] == [("a.pdf", b"%PDF-1", 6)]
