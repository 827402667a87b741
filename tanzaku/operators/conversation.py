"""Questions in a conversation: which scope holds, which earlier turns count, what the answer's context is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanzaku.checkpoints import stored
from tanzaku.functions import vectors as V
from tanzaku.operators.retrieval import FINAL, FLOOR, MAX_PINNED, choose, keep_first, mentions, pinned, recall, resolve, songs_seat

TURNS, TURN_CHARS = 3, 300


def last_turns(history: Column, turns: int = TURNS, chars: int = TURN_CHARS) -> Column:
    """The last turns of array<struct<q, a>>, each message cut to ``chars``; a null answer is empty."""
    kept = F.slice(history, F.greatest(F.lit(1), F.size(history) - turns + 1), turns)
    cut = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(chars))
    return F.transform(kept, lambda t: F.struct(cut(t["q"]).alias("q"), cut(t["a"]).alias("a")))


def scope_of(turns: DataFrame) -> DataFrame:
    """(qid, state, root, characters, source): the scope of each question of a conversation.

    ``turns``: qid, pinned_scope, own_state, own_root, own_roots (candidates), own_subjects (whether works are
    among them), own_characters (by root), previous_root, previous_characters. A scope that the client pins
    holds. Otherwise a question's own resolution does; where it is UNKNOWN, or AMBIGUOUS with the previous root
    among the candidates or without any work named, the previous root is inherited. Where the own root is the
    previous one, the characters of both turns count.
    """
    known = F.col("previous_root").isNotNull()
    inherits = known & (
        (F.col("own_state") == "UNKNOWN")
        | ((F.col("own_state") == "AMBIGUOUS") & (F.coalesce(F.array_contains("own_roots", F.col("previous_root")), F.lit(False)) | ~F.coalesce("own_subjects", F.lit(False))))
    )
    root = F.coalesce("pinned_scope", F.when(inherits, F.col("previous_root")).otherwise(F.col("own_root")))
    source = F.when(F.col("pinned_scope").isNotNull(), "pinned").when(inherits, "history").otherwise("own")
    none = F.array().cast("array<int>")
    mine = F.coalesce(F.try_element_at("own_characters", root), none)
    both = F.array_sort(F.array_union(mine, F.coalesce("previous_characters", none)))
    follows = F.col("pinned_scope").isNull() & known & (root == F.col("previous_root"))
    characters = F.when(follows, F.slice(both, 1, MAX_PINNED)).otherwise(F.array_sort(mine))
    return turns.select("qid", F.when(source == "own", F.col("own_state")).otherwise("OK").alias("state"), root.alias("root"), characters.alias("characters"), source.alias("source"))


def reply(state: Column, labels: Column) -> Column:
    """What is said without any text of the corpus; null where the context decides."""
    asked = F.concat(F.lit("你是指哪一部？"), F.array_join(F.slice(labels, 1, 5), " / "))
    return F.when(state == "AMBIGUOUS", asked).when(state == "UNKNOWN", "没认出你问的是哪部作品或哪个角色。")


def reranked(pool: DataFrame, scores: DataFrame | None, most: int = 100) -> DataFrame:
    """``pool`` (qid, chunk_id, position) with the scores of a reranker (qid, chunk_id, score) for its first ``most`` places.

    Without scores the pool's own order stands in, so that a failed reranker costs quality but no answer.
    """
    first = pool.where(F.col("position") <= most)
    if scores is None:
        return first.withColumn("score", 1.0 / F.col("position"))
    return first.join(scores, ["qid", "chunk_id"], "left")


def chase(titles: DataFrame, redirects: DataFrame, hops: int = 3) -> DataFrame:
    """(title, target): where a title leads over at most ``hops`` redirects (source, target); a loop ends where the hops do."""
    at = titles.select("title", F.col("title").alias("target"))
    step = redirects.groupBy(F.col("source").alias("_s")).agg(F.min("target").alias("_t"))
    for _ in range(hops):
        at = at.join(step, F.col("target") == F.col("_s"), "left").select("title", F.coalesce("_t", "target").alias("target"))
    return at


def answer_context(questions: DataFrame, names: DataFrame, chunks: DataFrame, quotas: dict[str, int] | None = None, final: int = FINAL, floor: float = FLOOR) -> DataFrame:
    """(qid, state, root, position, chunk_id, score, pinned): from questions to what their answers rest on.

    ``questions``: qid, question, key, qvec; ``names``: name, entity_type, root, character_id; ``chunks``: chunk_id, root, layer,
    spoiler_level, vec, character_id, chunk_no. Mentions settle the scope; within it the chunks of named characters come
    first, then those that the quotas recall; questions about songs keep a seat for one. A question without a scope,
    or whose scope gives nothing, has one row without a chunk.
    """
    questions, names = questions.select("qid", "question", "key", "qvec"), names.select("name", "entity_type", "root", "character_id")
    chunks = chunks.select("chunk_id", "root", "layer", "spoiler_level", "vec", "character_id", "chunk_no")
    said = stored(mentions(questions, names).select("qid", "name").distinct().join(names, "name"), "said")
    states = stored(resolve(questions, said.select("qid", "name", "entity_type", "root"), chunks.select("root")), "states")
    asked = questions.join(states.where("state = 'OK'").select("qid", "root"), "qid")
    found = stored(recall(asked.where("qvec is not null").select("qid", "root", "qvec"), chunks, quotas), "recalled")
    who = said.where("character_id is not null").join(asked.select("qid", "root"), ["qid", "root"]).select("qid", "character_id").distinct()
    first = pinned(who, chunks.where("spoiler_level = 0 and character_id is not null").select("chunk_id", "character_id", "chunk_no"))
    pool = keep_first([first, found.select("qid", "chunk_id", F.col("rn").alias("position"))], "qid", "chunk_id", "position")
    seat = songs_seat(asked, found).withColumn("seat", F.lit(True))
    near = F.round(V.dot(F.col("qvec"), F.col("vec")), 9)
    scored = pool.join(asked.select("qid", "qvec"), "qid").join(chunks.select("chunk_id", "vec"), "chunk_id").select("qid", "chunk_id", F.coalesce(near, F.lit(0.0)).alias("score"))
    marked = scored.join(first.select("qid", "chunk_id", F.lit(True).alias("pinned")), ["qid", "chunk_id"], "left").join(seat, ["qid", "chunk_id"], "left")
    marked = marked.select("qid", "chunk_id", "score", F.coalesce("pinned", F.lit(False)).alias("pinned"), F.coalesce("seat", F.lit(False)).alias("seat"))
    kept = choose(marked, ["qid"], final, floor).select("qid", "position", "chunk_id", "score", "pinned")
    return states.join(kept, "qid", "left").select("qid", "state", "root", "position", "chunk_id", "score", "pinned")
