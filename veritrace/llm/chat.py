"""Chat formatting in relational steps.

Turns of a conversation are collected as structs and sorted; neighbours of the
same role are merged by one array aggregation; the rendered conversation is
one concatenation. A conversation is one unit of training text, so it is gathered; a
conversation id shared by a very large number of rows gives one very long text.

Template, with control strings in angle brackets:

    <|conv|> <|role|>ROLE<|body|>TEXT<|next|>TEXT ... <|end|> <|done|>

``<|next|>`` parts the texts of merged turns. In roles and texts every ``\\`` is
doubled and every ``<|`` becomes ``<\\|``, so no control string can occur there and
the way back is exact. The loss mask is the list of [start, length] spans of the
assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veritrace.llm.base import NO_ID, id_or_null, table

HEAD, ROLE, BODY, NEXT, END, TAIL = "<|conv|>", "<|role|>", "<|body|>", "<|next|>", "<|end|>", "<|done|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: in an escaped text a single backslash stands only before ``|``."""
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("<\\|"), F.lit("<|"))), "\\")


def _merged(turns: Column) -> Column:
    """Runs of one role: array of (role, texts). Built by position, so the list
    is not copied at each step."""
    starts = F.filter(
        F.sequence(F.lit(0), F.size(turns) - 1),
        lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]),
    )
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(turns)))
    return F.zip_with(
        starts, ends,
        lambda a, b: F.struct(
            F.get(turns, a)["role"].alias("role"), F.transform(F.slice(turns, a + 1, b - a), lambda t: t["text"]).alias("texts")
        ),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) for rows (conv_id, turn, role, text).

    Turns are ordered by turn (null first), then role and text; null texts and
    roles are empty; rows with a null conv_id form one conversation. Repeated
    rows are kept as turns. An empty table gives no rows.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    gathered = turns.groupBy(F.coalesce(F.col("conv_id"), F.lit(NO_ID)).alias("_id")).agg(
        F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("_turns")
    )
    merged = gathered.select("_id", _merged(F.col("_turns")).alias("_runs"))
    # Pieces in order, with a flag for those under the loss mask.
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    fixed = lambda text: piece(text, F.lit(False))

    def run_pieces(run: Column) -> Column:
        texts = F.transform(
            run["texts"],
            lambda t, i: F.array(fixed(F.when(i == 0, F.lit("")).otherwise(F.lit(NEXT))), piece(escape(t), run["role"] == "assistant")),
        )
        head = F.array(fixed(F.concat(F.lit(ROLE), escape(run["role"]), F.lit(BODY))))
        return F.concat(head, F.flatten(texts), F.array(fixed(F.lit(END))))

    pieces = F.concat(F.array(fixed(F.lit(HEAD))), F.flatten(F.transform("_runs", run_pieces)), F.array(fixed(F.lit(TAIL))))
    rows = merged.select("_id", F.posexplode(pieces).alias("_i", "_p"))
    before = Window.partitionBy("_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_at", F.coalesce(F.sum(F.length("_p.text")).over(before), F.lit(0)))
    listed = placed.groupBy("_id").agg(
        F.sort_array(F.collect_list(F.struct("_i", F.col("_p.text").alias("text"), F.col("_p.loss").alias("loss"), "_at"))).alias("_all")
    )
    span = lambda p: F.struct(p["_at"].alias("start"), F.length(p["text"]).cast("long").alias("length"))
    return listed.select(
        id_or_null().alias("conv_id"), F.array_join(F.transform("_all", lambda p: p["text"]), "").alias("formatted"),
        F.transform(F.filter("_all", lambda p: p["loss"]), span).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) turns, as they were before merging."""
    runs = F.split(formatted, r"<\|role\|>", -1)
    runs = F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0)))

    def turns(run: Column) -> Column:
        role_body = F.split(run, r"<\|body\|>", -1)
        body = F.split(F.get(role_body, F.lit(1)), r"<\|end\|>", -1)
        texts = F.split(F.get(body, F.lit(0)), r"<\|next\|>", -1)
        return F.transform(texts, lambda t: F.struct(unescape(F.get(role_body, F.lit(0))).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(runs, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask."""
    parts = F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(parts, "")


def digest(chats: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted texts hold."""
    read = chats.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
        read_turns(F.col("formatted")).alias("_turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("_loss"),
    )
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.encode(F.col("_loss"), "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(format_chats(turns.unionByName(probe)))


SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS erole, replace(replace(text, '\', '\\'), '<|', '<\|') AS etext,
           coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS same
    FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(length('<|conv|>') + length('<|done|>') + sum(length(etext) + CASE WHEN same THEN length('<|next|>')
           ELSE length('<|role|>') + length(erole) + length('<|body|>') + length('<|end|>') END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
