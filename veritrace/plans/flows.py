"""Whole flows: ingest of documents, recomputation, and asking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from veritrace import schemas
from veritrace.functions import text as tx
from veritrace.functions.vectors import embed_hash
from veritrace.operators import answers, chunking, entities, extraction, graph, ingest, ontology, reasoning, retrieval, runlog, views
from veritrace.session import materialize
from veritrace.sources.store import Batch, Store

# Pages of a plain-text document are separated by form feeds.
PAGE_BREAK = "\f"
# What is known of a page besides its text.
LAYOUT = "array<struct<area:double,ocr_text:string,ocr_words:array<double>>>"
#: Batches since the last compaction that lead to the next.
COMPACT_AFTER = 64


def fresh_documents(batch: Batch, arrivals: DataFrame) -> DataFrame:
    """Arrivals (filename, text, and maybe pages) with content that is not stored, or whose
    processing failed: one per content, under its first file name. The document id is the content's hash,
    so names may repeat, and several names may stand for one content. ``known`` tells of documents that failed before."""
    docs = ingest.fingerprint_documents(arrivals, "text", mime="text/plain")
    first = docs.groupBy("sha256").agg(F.min_by(F.struct(*[c for c in docs.columns if c != "sha256"]), "filename").alias("d"))
    stored = batch.stored("documents").select("sha256", (F.col("status") == "failed").alias("known"))
    return first.join(stored, "sha256", "left").filter(F.coalesce("known", F.lit(True))).select(
        "sha256", "d.*", F.col("known").isNotNull().alias("known")
    ).withColumn("document_id", schemas.natural_id(F.lit("document"), "sha256"))


def text_pages(docs: DataFrame, repair: bool = True) -> DataFrame:
    """Pages of documents, numbered from 1. They are the parts of the text between form feeds; where
    there is a column ``layout``, an array with an element per page, it gives area, ocr_text and ocr_words of each."""
    text = tx.repair_encoding(F.col("text")) if repair else F.col("text")
    layout = F.col("layout") if "layout" in docs.columns else F.lit(None).cast(LAYOUT)
    split = docs.select("document_id", F.posexplode(F.split(text, PAGE_BREAK, -1)).alias("at", "native_text"), layout.alias("layout"))
    page = F.try_element_at("layout", F.col("at") + 1)
    pages = ingest.extract_pages(split.select(
        "document_id", (F.col("at") + 1).alias("page_number"), "native_text",
        # Text has no layout; an area of one square unit never looks like a scan.
        F.coalesce(page["area"], F.lit(1.0)).alias("area"), page["ocr_text"].alias("ocr_text"), page["ocr_words"].alias("ocr_words"),
    ))
    return pages


def checked_pages(pages: DataFrame) -> DataFrame:
    """The pages as stored; an error if a page number is there twice in a document."""
    pages = materialize(pages, "pages")
    twice = ingest.duplicate_pages(pages).first()
    if twice is not None:
        raise ValueError(f"document {twice['document_id']} has page {twice['page_number']} more than once")
    return pages


def _resolve_subjects(batch: Batch, proposed: DataFrame, choose: Callable) -> DataFrame:
    """Entity for each distinct (normalized name, type), storing what is new.
    Returns subject_key, subject_type, entity_id."""
    stored = batch.stored("entities")
    mentions = materialize(
        proposed.groupBy(tx.normalized_key(F.col("subject")).alias("key"), F.col("subject_type").alias("entity_type")).agg(
            F.min(F.struct("chunk_id", "fact_no", "subject")).alias("m")
        ).select(
            schemas.natural_id("entity_type", "key").alias("mention_id"), "key", "entity_type",
            F.col("m.subject").alias("name"), F.col("m.chunk_id").alias("chunk_id"),
            F.concat_ws("/", "m.chunk_id", "m.fact_no").alias("seq"),
        ), "mentions",
    )
    found = entities.candidate_entities(mentions, stored)
    choices = entities.guard_choice(choose(mentions, stored, found), found)
    resolved = materialize(entities.resolve(mentions, choices), "resolved")
    new = resolved.filter(F.col("decision") == "new")
    among = entities.resolve_batch(new.select("mention_id", "name", "entity_type", "seq"))
    seeds = materialize(
        new.join(among, "mention_id").select(
            "mention_id", "seed_id", "key", "entity_type", "name", "chunk_id", F.col("similarity").cast("float").alias("similarity")
        ), "seeds",
    )
    created = seeds.filter(F.col("mention_id") == F.col("seed_id")).select(
        F.col("mention_id").alias("seed_id"), schemas.natural_id(F.lit("entity"), "entity_type", "key").alias("entity_id"),
        F.col("name").alias("canonical_name"), "entity_type", F.col("key").alias("normalized_key"),
    )
    batch.write("entities", created)
    linked = seeds.join(created.select("seed_id", "entity_id"), "seed_id")
    weak = linked.filter(
        (F.col("mention_id") != F.col("seed_id")) & (F.col("similarity") < F.lit(entities.LINK).cast("float"))
    ).select("entity_id", F.col("name").alias("alias_text"), F.col("similarity").alias("confidence"), F.col("chunk_id").alias("source_chunk_id"))
    batch.write("aliases", entities.alias_rows(resolved).unionByName(weak))
    old = resolved.filter(F.col("decision") != "new").select("key", "entity_type", "entity_id")
    return old.unionByName(linked.select("key", "entity_type", "entity_id"))


def ingest_documents(
    store: Store,
    arrivals: DataFrame,
    batch: int = 0,
    embed: Callable = embed_hash,
    extract: Callable[[DataFrame], DataFrame] = extraction.extract_by_rule,
    classify: Callable[[DataFrame], DataFrame] = reasoning.classify_pairs,
    choose: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = entities.choose_by_similarity,
    provider: Callable[[list[str]], extraction.Provider] | None = None,
    exact_pages: bool = False,
) -> None:
    """Runs every stage for the new documents among ``arrivals`` and compares
    their facts with everything stored.

    Facts come from ``extract``, or from the responses of a model if ``provider``
    is given, which is loaded with the names of the predicates known from earlier batches; ``choose`` picks an entity among the candidates. Evidence has the first
    page of its chunk, or with ``exact_pages`` the page its quote starts on. Stage results are
    written before they are used again, so a provider is called once per row.
    ``batch`` numbers must grow; repeating the last one replaces what it stored.

    All tables of the batch become visible at once, when its last stage is done. If a stage fails, nothing of what the
    stages wrote does: the stages are logged, the one that failed with its error, the documents of the
    batch count as failed and may be sent again, and the error goes on to the caller. A text on
    which only the provider fails does not stop the batch.
    """
    attempt = store.begin(batch)
    docs = materialize(fresh_documents(attempt, arrivals), "docs")
    started: list[str] = []
    try:
        _run_stages(attempt, docs, embed, extract, classify, choose, provider, exact_pages, started)
    except Exception as error:
        _record_failure(store.begin(batch), docs, started, error)
        raise
    attempt.commit()
    if len(store.visible()) > COMPACT_AFTER:
        store.compact()


def _run_stages(batch: Batch, docs: DataFrame, embed, extract, classify, choose, provider, exact_pages: bool, started: list[str]) -> None:
    started.append("extract_text")
    pages = checked_pages(text_pages(docs))
    batch.write("pages", pages)

    # Each stage is run to its end before the next is said to have started.
    started.append("chunk")
    chunks = materialize(chunking.build_chunks(pages).withColumn("chunk_id", schemas.natural_id("document_id", "chunk_no")), "cut")
    started.append("embed")
    chunks = materialize(chunking.embed_chunks(chunks, embed), "chunks")
    batch.write("chunks", chunks)

    started.append("extract_facts")
    outcome = None
    if provider is None:
        proposed = materialize(extraction.ground(extract(chunks)), "proposed")
    else:
        known = extraction.known_predicates(batch.stored("predicates"))
        answered = materialize(extraction.extract_by_provider(chunks, provider, known), "answered")
        proposed = materialize(extraction.ground(extraction.provider_facts(answered)), "proposed")
        outcome = extraction.extraction_outcome(extraction.grounding_metrics(extraction.provider_attempts(answered, proposed)))
    grounded = extraction.keep_grounded(proposed)
    batch.write("predicates", ontology.grow_ontology(grounded, batch.stored("predicates")))
    subjects = _resolve_subjects(batch, grounded, choose)
    named = ontology.lookup_predicates(grounded, batch.read("predicates")).withColumn(
        "key", tx.normalized_key(F.col("subject"))
    ).join(
        subjects.select("key", F.col("entity_type").alias("subject_type"), F.col("entity_id").alias("subject_entity_id")),
        ["key", "subject_type"], "left",
    )
    facts = materialize(extraction.build_facts(named), "facts")
    batch.write("facts", facts)
    batch.write("evidence", extraction.build_evidence(facts, extraction.quote_page(F.col("unit_pages"), F.col("char_start")) if exact_pages else None))

    counts = pages.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
    _write_documents(batch, docs, "ready", counts)

    started.append("reason_relationships")
    related = reasoning.reason(
        batch.read("facts"), batch.read("evidence"), batch.read("documents"), batch.read("entities"),
        batch.read("predicates"), batch.stored("relationships"), anchors=facts, classify=classify,
    )
    batch.write("relationships", related)
    _project(batch, docs)
    events = _events(docs, pages, chunks, proposed, batch.own("relationships"), facts, batch.number, outcome)
    batch.write("jobs", _started(docs, batch.number, started).unionByName(events))


def _write_documents(batch: Batch, docs: DataFrame, status: str, counts: DataFrame | None = None) -> None:
    """Rows of new documents, and the states that all of the batch went through."""
    batch.write("document_rows", ingest.document_rows(docs.filter(~F.col("known"))))
    pages = docs.select("document_id", F.lit(None).cast("int").alias("page_count")) if counts is None else docs.select(
        "document_id").join(counts, "document_id", "left")
    went = F.array(*[
        F.struct(F.lit(2 * batch.number + i).cast("long").alias("seq"), F.lit(s).alias("status")) for i, s in enumerate(("processing", status))
    ])
    changes = pages.select("document_id", "page_count", F.inline(went))
    batch.write("document_changes", changes.withColumn("at", F.current_timestamp()))


def _project(batch: Batch, docs: DataFrame) -> None:
    """Nodes and edges of the batch, as the last step: with those stored, the graph is that of the whole store."""
    own = docs.select("document_id")
    documents = batch.read("documents").join(own, "document_id", "left_semi")
    facts, evidence, relationships = (batch.own(t) for t in ("facts", "evidence", "relationships"))
    nodes = graph.nodes(documents, facts, batch.read("entities"), evidence)
    batch.write("node_versions", nodes.withColumn("batch", F.lit(batch.number)))
    batch.write("edge_versions", graph.edges(documents, facts, batch.read("entities"), evidence, relationships, batch.read("facts")))


def _seq(batch: int, stage: str, closing: bool):
    """Events of a batch in order: each stage starts, then closes."""
    return F.lit(2 * (batch * len(runlog.STAGES) + runlog.STAGES.index(stage)) + int(closing))


def _started(docs: DataFrame, batch: int, stages: list[str]) -> DataFrame:
    rows = [runlog.stage_events(docs, stage, "running", _seq(batch, stage, False)) for stage in stages]
    return reduce(DataFrame.unionByName, rows)


def _record_failure(batch: Batch, docs: DataFrame, started: list[str], error: Exception) -> None:
    """Closes the stages of a batch that stopped, and marks its documents. Nothing else of it is kept."""
    running = _started(docs, batch.number, started)
    last = runlog.job_state(running.filter(F.col("stage") == started[-1]))
    failures = docs.select("document_id", F.lit(str(error)).alias("failure"))
    closed = [
        runlog.stage_events(runlog.fail_running(last, failures), started[-1], "failed", _seq(batch.number, started[-1], True), error=F.col("error")),
        *(runlog.stage_events(docs, stage, "done", _seq(batch.number, stage, True)) for stage in started[:-1]),
    ]
    batch.write("jobs", reduce(DataFrame.unionByName, closed, running))
    _write_documents(batch, docs, "failed")
    _project(batch, docs)
    batch.commit()


def _events(
    docs: DataFrame, pages: DataFrame, chunks: DataFrame, proposed: DataFrame, related: DataFrame, facts: DataFrame, batch: int,
    outcome: DataFrame | None = None,
) -> DataFrame:
    """One closing event per document and stage, with the stage's metrics. Extraction
    by a provider failed where every chunk of the document did (``outcome``)."""
    def closing(counts: DataFrame, stage: str, **metrics) -> DataFrame:
        seq = _seq(batch, stage, True)
        joined = docs.select("document_id").join(counts, "document_id", "left")
        packed = F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(name) for name, c in metrics.items()])
        return runlog.stage_events(joined.withColumn("packed", packed), stage, "done", seq, metrics=F.col("packed"))

    def count(df: DataFrame) -> DataFrame:
        return df.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))

    drops = proposed.groupBy("document_id").agg(
        F.count_if(F.col("grounding") == "exact").alias("kept"), F.count_if(F.col("grounding") == "none").alias("dropped"),
        F.count_if(F.col("grounding") == "normalized").alias("not_verbatim"),
    )
    owners = facts.select(F.col("fact_id").alias("fact_a_id"), "document_id")
    extracted = closing(drops, "extract_facts", facts="kept", dropped_ungrounded="dropped", dropped_not_verbatim="not_verbatim")
    if outcome is not None:
        told = outcome.select("document_id", "job_status", "job_error", "sample_error")
        extracted = extracted.join(told, "document_id", "left").withColumns({
            "status": F.coalesce("job_status", "status"), "error": F.coalesce("job_error", "sample_error"),
        }).drop("job_status", "job_error", "sample_error")
    return (
        closing(count(pages), "extract_text", pages="n")
        .unionByName(closing(count(chunks), "chunk", chunks="n"))
        .unionByName(closing(count(chunks.filter(F.col("embedding").isNotNull())), "embed", embedded="n"))
        .unionByName(extracted)
        .unionByName(closing(count(related.join(owners, "fact_a_id")), "reason_relationships", relationships_created="n"))
    )


def recompute(
    facts: DataFrame, evidence: DataFrame, documents: DataFrame, entity_rows: DataFrame, predicates: DataFrame,
    relationships: DataFrame, classify: Callable[[DataFrame], DataFrame] = reasoning.classify_pairs,
) -> tuple[DataFrame, DataFrame]:
    """Compares every active fact again: a one-row summary (facts_considered,
    relationships_created), and the relationships to append."""
    created = materialize(
        reasoning.reason(facts, evidence, documents, entity_rows, predicates, relationships, classify=classify), "recompute"
    )
    counts = facts.filter(F.col("status") == "active").agg(
        F.count(F.lit(1)).alias("facts_considered"), F.lit(0).cast("long").alias("relationships_created")
    ).unionByName(created.agg(
        F.lit(0).cast("long").alias("facts_considered"), F.count(F.lit(1)).alias("relationships_created")
    ))
    summary = counts.agg(
        F.sum("facts_considered").alias("facts_considered"), F.sum("relationships_created").alias("relationships_created")
    )
    return summary, created


def ask(store: Store, questions: DataFrame, embed: Callable = embed_hash) -> DataFrame:
    """Answer components for (question_id, question) rows; blank questions are
    rejected. Cards have their explanation and confidence, and a preview of each
    retrieved chunk follows them."""
    asked = materialize(
        retrieval.valid_questions(questions).withColumn("embedding", embed(F.col("question"))), "questions"
    )
    facts = store.read("facts")
    named = views.named_facts(facts, store.read("documents"), store.read("entities"), store.read("predicates"))
    relationships = store.read("relationships").withColumn("relationship_id", F.xxhash64("fact_a_id", "fact_b_id"))
    fact_rows, relation_rows, chunk_rows = retrieval.evidence_bundle(asked, store.read("chunks"), facts, named, relationships)
    parts = answers.card_details(answers.assemble(asked, fact_rows, relation_rows), fact_rows, relation_rows)
    return parts.unionByName(answers.source_previews(chunk_rows), allowMissingColumns=True)
