"""Query intent, follow-ups, routing and bounded session context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import text as tx

# Words and patterns of the intent rules.
PRONOUNS = ["it", "this", "that", "they", "them", "those", "these", "它", "这个", "那个"]
REFERENCES = PRONOUNS + ["above", "previous", "earlier", "上述"]
COMPARISON_PATTERNS = [
    r"\bcompare\b",
    r"\bdifference\b",
    r"\bdifferences\b",
    r"\bversus\b",
    r"\bvs\.?\b",
    r"\bpros and cons\b",
    r"\btrade-?offs?\b",
    r"\bwhich is better\b",
]
CURRENT_PATTERNS = [
    r"\bweather\b",
    r"\bstock price\b",
    r"\bsports score\b",
    r"\blatest news\b",
    r"\btoday'?s news\b",
    r"\bflight status\b",
]
#: One expression a rule.
COMPARISON, CURRENT = "|".join(COMPARISON_PATTERNS), "|".join(CURRENT_PATTERNS)
STARTER = r"^((what|how) about\b|(and|also|then)\b|那|那么|还有|另外)"


def _has(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def intents(questions: DataFrame) -> DataFrame:
    """Intent and confidence of each question: an unresolved short follow-up, current data, comparison, else knowledge."""
    q = F.lower(tx.collapse(F.coalesce("text", F.lit(""))))
    t = tx.token_list(q)
    short = (F.size(t) <= 4) & (_has(t, PRONOUNS) | q.isin("what about it?", "how about it?"))
    intent = F.when(short, "clarification_needed").when(F.regexp_like(q, F.lit(CURRENT)), "out_of_scope").when(F.regexp_like(q, F.lit(COMPARISON)), "comparison").otherwise("knowledge_query")
    conf = F.when(short, 0.72).when(F.regexp_like(q, F.lit(CURRENT + "|" + COMPARISON)), 0.82).otherwise(0.78)
    return questions.withColumn("intent", intent).withColumn("confidence", conf)


def follow_ups(questions: DataFrame) -> DataFrame:
    """Whether a question needs the turns before it."""
    q = F.lower(tx.collapse(F.coalesce("text", F.lit(""))))
    n, t = F.size(tx.token_list(q)), tx.token_list(q)
    refers = _has(t, REFERENCES) | q.contains("above") | q.contains("previous") | q.contains("earlier")
    starts = F.regexp_like(q, F.lit(STARTER))
    return questions.withColumn("needs_context", ((n <= 6) & (refers | starts)) | (starts & (n <= 8)))


def session_tokens(text: Column) -> Column:
    """CJK characters plus latin tokens, one at least for a text that is not empty."""
    n = tx.cjk_count(text) + F.regexp_count(text, F.lit("[A-Za-z0-9_]+"))
    return F.when(F.trim(text) == "", 0).otherwise(F.greatest(F.lit(1), n)).cast("long")


def bounded_context(turns: DataFrame, max_turns: int = 8, max_tokens: int = 400) -> DataFrame:
    """The last turns of each conversation whose running cost from the end fits the budget.

    One window per conversation; a newest turn over the budget leaves nothing.
    """
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = turns.withColumn("cost", session_tokens(F.coalesce("text", F.lit(""))))
    t = t.withColumn("back", F.row_number().over(w)).withColumn("running", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.where((F.col("back") <= max_turns) & (F.col("running") <= max_tokens)).select("conv_id", "turn", "role", "cost", "running")


def anchor_turns(turns: DataFrame) -> DataFrame:
    """The latest user turn of each conversation, else its latest turn."""
    return turns.groupBy("conv_id").agg(F.coalesce(F.max(F.when(F.col("role") == "user", F.col("turn"))), F.max("turn")).alias("turn"))


def route(questions: DataFrame, bases: DataFrame, default: str | None = None) -> DataFrame:
    """The knowledge base (name, hints, description) of each question (query_id, question).

    Score: 10 for each hint inside the question, else its shared tokens (blank hints count nothing); 0.5 where the name's
    tokens meet; up to 1 of 0.25 for each token of the description. Highest score, then name;
    at 0 the default. The table of bases is a configuration, folded to one row's array, so
    questions never shuffle.
    """
    b = bases.agg(F.collect_list(F.struct("name", "hints", tx.route_tokens(F.col("name")).alias("nt"), tx.route_tokens(F.col("description")).alias("dt"))).alias("bases"))
    q = F.lower(F.col("question"))
    t = tx.route_tokens(F.col("question"))
    hint = lambda h: F.when(F.contains(q, F.lower(h)), F.lit(10.0)).otherwise(F.size(F.array_intersect(t, tx.route_tokens(h))).cast("double"))
    score = lambda k: (F.aggregate(F.filter(k["hints"], lambda h: F.trim(h) != ""), F.lit(0.0), lambda s, h: s + hint(h)) + F.when(F.arrays_overlap(t, k["nt"]), 0.5).otherwise(0.0) + F.least(F.lit(1.0), 0.25 * F.size(F.array_intersect(t, k["dt"]))))
    ranked = F.array_sort(F.transform("bases", lambda k: F.struct((-score(k)).alias("m"), k["name"].alias("name"))))
    out = questions.crossJoin(F.broadcast(b)).select("query_id", ranked.alias("r")).select("query_id", (-F.col("r")[0]["m"]).alias("score"), F.col("r")[0]["name"].alias("name"))
    return out.select("query_id", F.abs("score").alias("score"), F.when(F.col("score") > 0, F.col("name")).otherwise(F.lit(default)).alias("selected"), (F.col("score") < 2).alias("low_confidence"))


# What follows from an intent.
ROUTES = {
    "clarification_needed": ("clarification", "ask_clarifying_question"),
    "out_of_scope": ("rejected", "reject_or_redirect"),
    "comparison": ("retrieval_planned", "retrieve_and_compare"),
    "knowledge_query": ("retrieval_planned", "retrieve"),
}


def intent_routes(questions: DataFrame) -> DataFrame:
    """:func:`intents` with the status and action that follow, and whether to retrieve."""
    out = intents(questions)
    pick = lambda i: F.coalesce(*(F.when(F.col("intent") == k, F.lit(v[i])) for k, v in ROUTES.items()))
    return out.withColumn("status", pick(0)).withColumn("action", pick(1)).withColumn("should_retrieve", F.col("status") == "retrieval_planned")


def enriched(turns: DataFrame, max_turns: int = 8, max_tokens: int = 400) -> DataFrame:
    """Each user turn as a question to the session before it (conv_id, turn, role, text).

    A question that needs context gets the last user turn of the bounded context before it, else
    its last turn; without one it must be clarified. The bounded context is a frame of ``max_turns``
    rows of the conversation's window, whose costs are summed inside the row.
    """
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-max_turns, -1)
    t = turns.select("conv_id", "turn", "role", tx.collapse(F.coalesce("text", F.lit(""))).alias("text"), session_tokens(F.coalesce("text", F.lit(""))).alias("cost"))
    t = t.withColumn("past", F.reverse(F.collect_list(F.struct("role", "text", "cost")).over(before)))
    costs = lambda p, i: F.aggregate(F.slice(p, 1, i + 1), F.lit(0).cast("long"), lambda s, x: s + x["cost"])
    kept = tx.let(F.col("past"), lambda p: F.filter(p, lambda x, i: costs(p, i) <= max_tokens))
    t = t.withColumn("kept", kept).where("role = 'user'")
    anchor = F.coalesce(F.get(F.filter("kept", lambda x: x["role"] == "user"), F.lit(0)), F.get("kept", F.lit(0)))["text"]
    f = follow_ups(t.withColumn("anchor", anchor))
    applied = F.col("needs_context") & F.col("anchor").isNotNull()
    question = F.when(applied, F.concat("text", F.lit(" Context: "), "anchor")).otherwise(F.col("text"))
    return f.select("conv_id", "turn", "needs_context", applied.alias("context_applied"), (F.col("needs_context") & F.col("anchor").isNull()).alias("requires_clarification"), question.alias("question"))
