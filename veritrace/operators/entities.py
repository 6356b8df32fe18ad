"""Entities: upsert, candidates by trigram similarity, match decisions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from veritrace.functions import text as tx
from veritrace.functions.trigrams import set_similarity, trigrams
from veritrace.operators.nearest import spread_tiles
from veritrace.schemas import natural_id
from veritrace.session import materialize

# Candidates per mention, and the two confidence limits.
CANDIDATES = 8
LINK = 0.95
ALIAS = 0.75

# Names of a tile of the batch resolution.
TILE_NAMES = 2048

# Entries read per mention before a bound is known (one trigram's lists at
# least), and entries and visitors of a part of a list. No result depends on them.
FIRST_READ = 512
LIST_PART = 4096
VISITS_PART = 65536
# Similarities, in per cent, down to which mentions are looked up by pairs of
# trigrams; all above 50. No result depends on them.
LEVELS = (90, 80, 70, 65, 60)


def upsert_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities to insert for (name, entity_type, seq) mentions: one per
    (normalized key, type) that is not stored, with its first spelling."""
    keyed = mentions.withColumn("normalized_key", tx.normalized_key(F.col("name")))
    first = keyed.groupBy("normalized_key", "entity_type").agg(
        F.min(F.struct("seq", "name"))["name"].alias("canonical_name")
    )
    return first.join(entities.select("normalized_key", "entity_type"), ["normalized_key", "entity_type"], "left_anti").select(
        natural_id(F.lit("entity"), "entity_type", "normalized_key").alias("entity_id"),
        "canonical_name", "entity_type", "normalized_key",
    )


def _top(pairs: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("mention_id").orderBy(F.col("similarity").desc(), "entity_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _scored(met: DataFrame, asked: DataFrame, known: DataFrame) -> DataFrame:
    """Exact similarity of the (mention_id, entity_id) pairs, each once."""
    return (
        met.distinct().join(asked.select("mention_id", F.col("grams").alias("m")), "mention_id")
        .join(known.select("entity_id", F.col("grams").alias("e")), "entity_id")
        .select("mention_id", "entity_id", set_similarity(F.col("m"), F.col("e")).alias("similarity"))
    )


def _visit(visits: DataFrame, postings: DataFrame, part: int) -> DataFrame:
    """The entities of the lists (entity_type, gram, n_e) that mentions visit.
    A long list and one with many visitors is cut on both sides, so that its
    entries and its visitors meet part by part."""
    key = ["entity_type", "gram", "n_e"]
    parts = visits.groupBy(*key).agg(
        F.ceil(F.first("entries") / part).cast("int").alias("n_list"),
        F.ceil(F.count(F.lit(1)) / VISITS_PART).cast("int").alias("n_visit"),
    )

    def cut(df: DataFrame, own: str, mine: str, other: str) -> DataFrame:
        return df.join(parts, key).select(
            *key, own, F.pmod(F.xxhash64(own), F.col(f"n_{mine}")).cast("int").alias(f"at_{mine}"),
            F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(f"at_{other}"),
        )

    left = cut(visits.select(*key, "mention_id"), "mention_id", "visit", "list")
    right = cut(postings, "entity_id", "list", "visit")
    return left.join(right, [*key, "at_visit", "at_list"]).select("mention_id", "entity_id")


def _pair_keys(names: DataFrame, own: str, sizes: DataFrame, level: int) -> DataFrame:
    """Keys (key, id) under which a name meets all of at least ``level`` per cent similarity: the pairs
    of its rarest trigrams, for each size that such a name of the other side may have.

    Sets of ``n`` and ``o`` trigrams that are as similar share at least ``t``, and the first two
    shared ones are among the first ``n - t + 2`` of a set by rarity. ``sizes`` has the
    sizes (entity_type, o) of the other side; ``names`` has n and, rarest first, the numbers of the trigrams that entities have."""
    n, o = F.col("n"), F.col("o")
    shared = F.ceil((level * (n + o)) / F.lit(100 + level) - F.lit(1e-9))
    # Trigrams that no entity has are the rarest.
    first = F.greatest(F.least(n - shared + 2 - (n - F.size("codes")), F.size("codes")), F.lit(0)).cast("int")
    met = names.join(sizes, "entity_type").filter((n * 100 >= o * level) & (o * 100 >= n * level)).withColumn("front", F.slice("codes", 1, first))
    pairs = F.flatten(F.transform("front", lambda a, i: F.transform(
        F.slice("front", i + 2, F.size("front")), lambda b: F.struct(a.alias("a"), b.alias("b"))
    )))
    both = ("n", "o") if own == "mention_id" else ("o", "n")
    return met.select(F.col(own), "entity_type", *both, F.explode(pairs).alias("p")).select(
        F.xxhash64("entity_type", *both, "p.a", "p.b").alias("key"), own
    )


def _near_by_pairs(asked: DataFrame, known: DataFrame, lists: DataFrame, k: int, levels: tuple[int, ...]) -> DataFrame | None:
    """The ``k`` best entities (mention_id, entity_id, similarity, rank) of the mentions that have ``k`` at or above
    one of the falling ``levels``. All entities from a level on are met there, so such a result is exact."""
    vocabulary = materialize(
        lists.groupBy("entity_type", "gram").agg(F.sum("entries").alias("df")).withColumn("code", F.monotonically_increasing_id()), "vocabulary"
    )

    def coded(df: DataFrame, own: str) -> DataFrame:
        code = F.sort_array(F.collect_list(F.struct("df", "gram", "code"))).getField("code")
        rows = df.select(own, "entity_type", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
        return rows.join(vocabulary, ["entity_type", "gram"]).groupBy(own, "entity_type", "n").agg(code.alias("codes"))

    open_ = materialize(coded(asked, "mention_id"), "mention-codes")
    rows = materialize(coded(known, "entity_id"), "entity-codes")
    sizes = rows.select("entity_type", F.col("n").alias("o")).distinct()
    found = []
    for level in levels:
        asked_sizes = open_.select("entity_type", F.col("n").alias("o")).distinct()
        met = _pair_keys(open_, "mention_id", sizes, level).join(_pair_keys(rows, "entity_id", asked_sizes, level), "key")
        m, e = F.col("m.codes"), F.col("e.codes")
        shared = F.size(F.array_intersect(m, e))
        similar = (
            met.select("mention_id", "entity_id").distinct()
            .join(open_.alias("m"), "mention_id").join(rows.alias("e"), "entity_id")
            .filter(F.col("m.entity_type") == F.col("e.entity_type"))
            .select("mention_id", "entity_id", shared.alias("shared"), (F.col("m.n") + F.col("e.n")).alias("sizes"))
            .filter(F.col("shared") * (100 + level) >= F.col("sizes") * level)
            .select("mention_id", "entity_id", (F.col("shared").cast("double") / (F.col("sizes") - F.col("shared"))).alias("similarity"))
        )
        best = materialize(_top(similar, k), "similar")
        served = best.filter(F.col("rank") == k).select("mention_id")
        found.append(best.join(served, "mention_id", "left_semi"))
        open_ = materialize(open_.join(served, "mention_id", "left_anti"), "mention-codes")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, found) if found else None


def candidate_entities(
    mentions: DataFrame, entities: DataFrame, k: int = CANDIDATES, first_read: int = FIRST_READ, part: int = LIST_PART,
    levels: tuple[int, ...] = LEVELS,
) -> DataFrame:
    """The ``k`` most similar entities of the same type for each mention, with
    no lower limit; ties go to the smaller id.

    ``mentions``: mention_id, name, entity_type. ``entities``: entity_id,
    canonical_name, entity_type. Returns mention_id, entity_id, similarity, rank.

    Mentions with ``k`` similar entities find them by pairs of rare trigrams
    that both have, at falling ``levels`` of similarity. The others go through
    a threshold algorithm over inverted lists, one per trigram and size of the
    entity's trigram set. A mention reads the lists of its rarest trigrams
    first. An entity of ``s`` trigrams that it first meets at a later one
    shares at most the ``x`` trigrams from there on, so its similarity is at
    most ``x / (n + s - x)`` with ``x <= s``; a list is read only if that
    reaches the ``k``-th find so far. Who finds fewer than ``k`` reads every
    list, and gets the smallest ids among the entities that share nothing.
    A name without trigrams shares nothing with any.
    """
    none = F.array().cast("array<string>")
    grams = lambda name: F.coalesce(trigrams(F.col(name)), none).alias("grams")
    # A name that many mentions share is looked up once.
    named = mentions.select("mention_id", "entity_type", F.col("name").alias("name"))
    every = materialize(
        named.groupBy("entity_type", "name").agg(F.min("mention_id").alias("mention_id"))
        .select("mention_id", "entity_type", "name", grams("name")), "mention-grams",
    )
    # Entities with equal trigrams tie, so only the smallest ids among them can be results.
    equal = Window.partitionBy("entity_type", "grams").orderBy("entity_id")
    known = materialize(
        entities.select("entity_id", "entity_type", F.array_sort(grams("canonical_name")).alias("grams"))
        .withColumn("_n", F.row_number().over(equal)).filter(F.col("_n") <= k).drop("_n"), "entity-grams",
    )
    postings = known.select("entity_type", "entity_id", F.size("grams").alias("n_e"), F.explode("grams").alias("gram"))
    lists = postings.groupBy("entity_type", "gram", "n_e").agg(F.count(F.lit(1)).alias("entries"))
    near = _near_by_pairs(every, known, lists, k, levels)
    asked = every if near is None else materialize(every.join(near.select("mention_id").distinct(), "mention_id", "left_anti"), "mention-open")
    rarity = lists.groupBy("entity_type", "gram").agg(F.sum("entries").alias("df"))

    # Trigrams that no entity has are in no list, but count in the mention's size.
    by_rarity = Window.partitionBy("mention_id").orderBy("df", "gram")
    reads = materialize(
        asked.select("mention_id", "entity_type", F.size("grams").alias("n_m"), F.explode("grams").alias("gram"))
        .join(rarity, ["entity_type", "gram"])
        .withColumns({
            "before": F.coalesce(F.sum("df").over(by_rarity.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "left": F.count(F.lit(1)).over(by_rarity.rowsBetween(0, Window.unboundedFollowing)),
        }), "mention-reads",
    )
    at_once = (F.col("before") == 0) | (F.col("before") + F.col("df") <= first_read)
    visits = reads.filter(at_once).join(lists, ["entity_type", "gram"])
    first = materialize(_top(_scored(_visit(visits, postings, part), asked, known), k), "first-finds")
    limit = first.filter(F.col("rank") == k).select("mention_id", F.col("similarity").alias("limit"))
    most = F.least("left", F.col("n_e").cast("long"))
    reach = most.cast("double") / (F.col("n_m") + F.col("n_e") - most)
    more = (
        reads.filter(~at_once).join(limit, "mention_id", "left").join(lists, ["entity_type", "gram"])
        .filter(reach >= F.coalesce("limit", F.lit(0.0)))
    )
    later = _scored(_visit(more, postings, part), asked, known)
    found = materialize(
        _top(first.select("mention_id", "entity_id", "similarity").unionByName(later).distinct(), k), "finds"
    )

    # Fewer than k finds: among the 2k smallest ids of the type are enough that share nothing.
    full = found.filter(F.col("rank") == k).select("mention_id")
    by_id = Window.partitionBy("entity_type").orderBy("entity_id")
    least = known.select("entity_type", "entity_id", F.row_number().over(by_id).alias("_n")).filter(F.col("_n") <= 2 * k).drop("_n")
    short = asked.join(full, "mention_id", "left_anti").select("mention_id", "entity_type").join(least, "entity_type")
    filled = short.select("mention_id", "entity_id").join(found, ["mention_id", "entity_id"], "left_anti").withColumn("similarity", F.lit(0.0))
    best = _top(found.select("mention_id", "entity_id", "similarity").unionByName(filled), k)
    if near is not None:
        best = best.unionByName(near)
    answered = best.join(every.select("mention_id", "entity_type", "name"), "mention_id").drop("mention_id")
    left, right = named.alias("l"), answered.alias("r")
    same = (F.col("l.entity_type") == F.col("r.entity_type")) & F.col("l.name").eqNullSafe(F.col("r.name"))
    return left.join(right, same).select("l.mention_id", "r.entity_id", "r.similarity", "r.rank")


def decide(confidence: Column, matched: Column) -> Column:
    """'link', 'alias' (link and record the spelling) or 'new'. Confidences
    are single precision and so are the limits."""
    value = confidence.cast("float")
    return (
        F.when(matched.isNull(), "new").when(value >= F.lit(LINK).cast("float"), "link")
        .when(value >= F.lit(ALIAS).cast("float"), "alias").otherwise("new")
    )


def guard_choice(choices: DataFrame, candidates: DataFrame) -> DataFrame:
    """A chosen entity must be among the candidates of its mention; otherwise
    there is no match and the confidence is 0.

    ``choices``: mention_id, match_entity_id, confidence, as a provider gives them.
    """
    offered = candidates.select("mention_id", F.col("entity_id").alias("match_entity_id"), F.lit(True).alias("offered"))
    checked = choices.join(offered, ["mention_id", "match_entity_id"], "left")
    ok = F.coalesce("offered", F.lit(False))
    return checked.select(
        "mention_id", F.when(ok, F.col("match_entity_id")).alias("match_entity_id"),
        F.when(ok, F.coalesce("confidence", F.lit(0.0))).otherwise(0.0).cast("float").alias("confidence"),
    )


def choose_by_similarity(mentions: DataFrame, entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """Default provider: the best candidate, with its similarity as confidence,
    or 1 when the normalized names are equal."""
    key = tx.normalized_key
    scored = (
        candidates.join(mentions.select("mention_id", key(F.col("name")).alias("mk")), "mention_id")
        .join(entities.select("entity_id", key(F.col("canonical_name")).alias("ek")), "entity_id")
        .withColumn("confidence", F.when(F.col("mk") == F.col("ek"), 1.0).otherwise(F.col("similarity")))
    )
    best = F.min(F.struct((-F.col("confidence")).alias("c"), F.col("entity_id").alias("id")))
    return scored.groupBy("mention_id").agg(best.alias("b")).select(
        "mention_id", F.col("b.id").alias("match_entity_id"), (-F.col("b.c")).cast("float").alias("confidence")
    )


def resolve(mentions: DataFrame, choices: DataFrame) -> DataFrame:
    """Mentions with their decision. A mention without a choice (no candidates,
    or the provider failed) is new."""
    out = mentions.join(choices, "mention_id", "left").withColumn(
        "decision", decide(F.col("confidence"), F.col("match_entity_id"))
    )
    return out.withColumn("entity_id", F.when(F.col("decision") != "new", F.col("match_entity_id")))


def alias_rows(resolved: DataFrame) -> DataFrame:
    """Spellings to append: links in the lower confidence band."""
    return resolved.filter(F.col("decision") == "alias").select(
        "entity_id", F.col("name").alias("alias_text"), "confidence",
        *([F.col("chunk_id").alias("source_chunk_id")] if "chunk_id" in resolved.columns else []),
    )


def _prefixes(names: DataFrame, threshold: float) -> DataFrame:
    """The rarest trigrams of each (mention_id, entity_type, grams) row, as
    rows (mention_id, entity_type, gram). Two names at or above ``threshold``
    share at least one of them."""
    grams = names.select("mention_id", "entity_type", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    freq = grams.groupBy("entity_type", "gram").agg(F.count(F.lit(1)).alias("df"))
    by_rarity = Window.partitionBy("mention_id").orderBy("df", "gram")
    return (
        grams.join(freq, ["entity_type", "gram"]).withColumn("at", F.row_number().over(by_rarity))
        .filter(F.col("at") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
        .select("mention_id", "entity_type", "gram")
    )


def _near(grams_a: list, grams_b: list) -> np.ndarray:
    """Similarity of every set of one block with every set of another."""
    codes, vocabulary = pd.factorize(np.concatenate([*grams_a, *grams_b]))
    sizes = np.array([len(g) for g in [*grams_a, *grams_b]])
    marks = np.zeros((len(sizes), len(vocabulary)), dtype=np.float32)
    marks[np.repeat(np.arange(len(sizes)), sizes), codes] = 1
    n = len(grams_a)
    shared = marks[:n] @ marks[n:].T
    return shared.astype(np.float64) / (sizes[:n, None] + sizes[None, n:] - shared)


def _earlier_in_tiles(asked: DataFrame, others: DataFrame, threshold: float, tile: int = TILE_NAMES) -> DataFrame:
    """For (mention_id, seq, grams, entity_type, gram) rows in ``asked``: what
    the earlier, similar ones in ``others`` (with ``seed`` in addition) of the
    same trigram are. A trigram may be in any number of names, so its names are
    compared block by block, and a tile says for each asked name only whether
    an undecided neighbour precedes it and which seed is the most similar."""
    key = dict(asked.dtypes)["mention_id"]
    group = ["entity_type", "gram"]
    counted = asked.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / tile).alias("na")).join(
        others.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / tile).alias("nb")), group
    )

    def spread(df: DataFrame, mine: str, other: str) -> DataFrame:
        cols = [F.col(c).alias(c) for c in df.columns]
        blocks = df.join(counted, group).select(
            *cols, F.pmod(F.xxhash64("mention_id"), F.col(f"n{mine}")).cast("int").alias(f"b{mine}"),
            F.explode(F.sequence(F.lit(0), (F.col(f"n{other}") - 1).cast("int"))).alias(f"b{other}"),
        )
        return spread_tiles(blocks, [*group, "ba", "bb"])

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"mention_id": a["mention_id"].iloc[:0], "blocked": [], "seed_id": a["mention_id"].iloc[:0], "similarity": []})
        b = b.sort_values("mention_id")
        near = _near(list(a["grams"]), list(b["grams"]))
        close = (near.astype(np.float32) >= np.float32(threshold)) & (b["seq"].to_numpy()[None, :] < a["seq"].to_numpy()[:, None])
        seed = b["seed"].to_numpy(dtype=bool)
        best = np.where(close & seed, near, -1.0)
        at = best.argmax(axis=1)
        top = best[np.arange(len(a)), at]
        return pd.DataFrame({
            "mention_id": a["mention_id"].to_numpy(), "blocked": (close & ~seed).any(axis=1),
            "seed_id": pd.Series(b["mention_id"].to_numpy()[at]).where(top >= 0, None), "similarity": np.where(top >= 0, top, np.nan),
        })

    return spread(asked, "a", "b").groupBy(*group, "ba", "bb").cogroup(
        spread(others, "b", "a").groupBy(*group, "ba", "bb")
    ).applyInPandas(compare, f"mention_id {key}, blocked boolean, seed_id {key}, similarity double")


def resolve_batch(
    new: DataFrame, threshold: float = ALIAS, small: int = 64, tile: int = TILE_NAMES
) -> DataFrame:
    """Resolution among mentions that match no stored entity, as if they came
    one by one in the order of ``seq``: a mention joins the most similar
    earlier one that became an entity, or becomes an entity itself.

    ``new``: mention_id, name, entity_type, seq; distinct by normalized name.
    Similar names share one of their rarest trigrams. Trigrams with few names
    are joined once; the others are compared in tiles. In each round an open
    mention with an entity among its earlier neighbours joins, and one without
    open or entity neighbours becomes an entity; that is the outcome of going
    one by one. The first open mention is always decided, so the rounds end;
    there are as many as the longest chain of names that wait for the one before.

    Returns mention_id, seed_id, similarity.
    """
    names = materialize(
        new.select("mention_id", "entity_type", "seq", trigrams(F.col("name")).alias("grams")), "batch-names"
    )
    prefixes = materialize(_prefixes(names, threshold), "batch-prefixes")
    size = prefixes.groupBy("entity_type", "gram").agg(F.count(F.lit(1)).alias("n"))
    few = prefixes.join(size.filter(F.col("n") <= small).drop("n"), ["entity_type", "gram"])
    many = materialize(
        prefixes.join(size.filter(F.col("n") > small).drop("n"), ["entity_type", "gram"])
        .join(names.drop("entity_type"), "mention_id"), "batch-common",
    )
    left, right = few.alias("a"), few.alias("b")
    met = left.join(right, ["entity_type", "gram"]).select(
        F.col("a.mention_id").alias("mention_id"), F.col("b.mention_id").alias("earlier")
    ).filter(F.col("mention_id") != F.col("earlier")).distinct()
    pairs = materialize(
        met.join(names.select("mention_id", "seq", F.col("grams").alias("a")), "mention_id")
        .join(names.select(F.col("mention_id").alias("earlier"), F.col("seq").alias("e_seq"), F.col("grams").alias("b")), "earlier")
        .filter(F.col("e_seq") < F.col("seq"))
        .withColumn("similarity", set_similarity(F.col("a"), F.col("b")))
        .filter(F.col("similarity").cast("float") >= F.lit(threshold).cast("float"))
        .select("mention_id", "earlier", "similarity"), "batch-pairs",
    )

    def look_back(asked: DataFrame, others: DataFrame) -> DataFrame:
        """Per asked mention: blocked, and the best seed before it. ``others``
        has mention_id and seed."""
        by_pair = pairs.join(asked, "mention_id", "left_semi").join(
            others.select(F.col("mention_id").alias("earlier"), "seed"), "earlier"
        ).select(
            "mention_id", (~F.col("seed")).alias("blocked"), F.when(F.col("seed"), F.col("earlier")).alias("seed_id"),
            F.when(F.col("seed"), F.col("similarity")).alias("similarity"),
        )
        by_tile = _earlier_in_tiles(many.join(asked, "mention_id", "left_semi"), many.join(others, "mention_id"), threshold, tile)
        return by_pair.unionByName(by_tile).groupBy("mention_id").agg(
            F.max("blocked").alias("blocked"),
            F.min(F.when(F.col("seed_id").isNotNull(), F.struct((-F.col("similarity")).alias("s"), "seed_id"))).alias("best"),
        )

    state = names.select("mention_id", F.lit("open").alias("status"))
    while not state.filter(F.col("status") == "open").isEmpty():
        seen = look_back(
            state.filter(F.col("status") == "open").select("mention_id"),
            state.filter(F.col("status") != "joined").select("mention_id", (F.col("status") == "seed").alias("seed")),
        )
        status = (
            F.when(F.col("status") != "open", F.col("status")).when(F.col("best").isNotNull(), "joined")
            .when(~F.coalesce("blocked", F.lit(False)), "seed").otherwise("open")
        )
        state = materialize(state.join(seen, "mention_id", "left").select("mention_id", status.alias("status")), "batch-state")
    final = state.select("mention_id", (F.col("status") == "seed").alias("seed"))
    best = look_back(
        final.filter(~F.col("seed")).select("mention_id"), final.filter("seed").select("mention_id", "seed")
    ).select("mention_id", "best")
    return final.join(best, "mention_id", "left").select(
        "mention_id",
        F.when(F.col("seed"), F.col("mention_id")).otherwise(F.col("best.seed_id")).alias("seed_id"),
        F.when(F.col("seed"), 1.0).otherwise(-F.col("best.s")).alias("similarity"),
    )
