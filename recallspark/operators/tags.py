"""The tag graph: activation, edges that strengthen by co-occurrence, decay, neighbours, consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from recallspark.operators.ranges import numbered, running
from recallspark.sources.scratch import saved

CATEGORIES = ("PERSON", "PROJECT", "TOOL", "CONCEPT", "EVENT", "PLACE", "EMOTION", "DECISION")
RATE, FLOOR = 0.05, 0.1


def activate(tags: DataFrame, events: DataFrame) -> DataFrame:
    """Tags after mention events (tag_id, ts, manual): storage grows by 0.01 (manual 0.02) to at most 1, retrieval nears 1 by a tenth each."""
    step = events.groupBy("tag_id").agg(F.count("*").alias("_n"), F.sum(F.when(F.col("manual"), 0.02).otherwise(0.01)).alias("_s"), F.max("ts").alias("_t"))
    hit = F.col("_n").isNotNull()
    r = 1 - (1 - F.col("retrieval_strength")) * F.pow(F.lit(0.9), F.col("_n"))
    new = {
        "storage_strength": F.when(hit, F.least(F.col("storage_strength") + F.col("_s"), F.lit(1.0))).otherwise(F.col("storage_strength")),
        "retrieval_strength": F.when(hit, r).otherwise(F.col("retrieval_strength")),
        "total_activations": F.col("total_activations") + F.coalesce("_n", F.lit(0)),
        "last_activated_at": F.greatest("last_activated_at", "_t"),
        "cooldown_days": F.when(hit, 0).otherwise(F.col("cooldown_days")),
        "is_dormant": F.when(hit, False).otherwise(F.col("is_dormant")),
    }
    return tags.join(step, "tag_id", "left").withColumns(new).drop("_n", "_s", "_t")


def cooccurrences(memories: DataFrame, tags: str = "tags") -> DataFrame:
    """Directed pairs of the tags of each memory, in their order; a tag is never paired with itself.  No self-join."""
    own = memories.withColumn("_t", F.array_distinct(tags))
    pairs = F.flatten(F.transform("_t", lambda x, i: F.transform(F.slice(F.col("_t"), i + 2, F.size("_t")), lambda y: F.struct(x.alias("source_tag"), y.alias("target_tag")))))
    return own.select("*", F.explode(pairs).alias("_p")).select(*[c for c in memories.columns if c != tags], "_p.source_tag", "_p.target_tag")


def explicit_relations(memories: DataFrame) -> DataFrame:
    """Relations (from, to, type, sim) of each memory whose ends are both among its tags; similarity 0.5 if none is given."""
    r = memories.select("*", F.explode("relations").alias("_r"))
    r = r.where(F.array_contains("tags", F.col("_r.from")) & F.array_contains("tags", F.col("_r.to")))
    return r.select("memory_id", F.col("_r.from").alias("source_tag"), F.col("_r.to").alias("target_tag"), F.upper("_r.type").alias("relation_type"), F.coalesce("_r.sim", F.lit(0.5)).alias("sim"))


def hebbian(events: DataFrame, edges: DataFrame | None = None, keys: tuple[str, ...] = ("source_tag", "target_tag", "relation_type")) -> DataFrame:
    """Edge weights after co-activation events (keys, ts, id, session_id, sim), in the closed form of the step-by-step rule.

    The first event sets 0.05 * max(sim, 0.1); the k-th adds 0.05 * (1 - w) * max(sim, 0.1) * min(k / 10, 2) * b, where b is
    1 + 0.5 * min(k / 5, 1) if the event before was of the same session.  So 1 - w is a product, which is pre-aggregated
    for each edge, and numbers of events come from ranges, so an edge with very many events is no task's own.  contexts are the
    ids of its first three events.  edges (keys, hebbian_weight, co_activation_count, last_session_id, contexts) are continued.
    """
    own = numbered(events.select(*keys, "ts", "id", F.col("session_id").cast("string").alias("session"), "session_id", F.greatest("sim", F.lit(FLOOR)).alias("s")), list(keys), ["ts", "id"], "session")
    if edges is None:
        own = own.withColumns({"w0": F.lit(None).cast("double"), "k0": F.lit(0), "s0": F.lit(None).cast("string"), "c0": F.array().cast(T.ArrayType(events.schema["id"].dataType))})
    else:
        old = edges.select(*keys, F.col("hebbian_weight").alias("w0"), F.col("co_activation_count").alias("k0"), F.col("last_session_id").cast("string").alias("s0"), F.col("contexts").alias("c0"))
        own = own.join(old, list(keys), "left").fillna(0, ["k0"]).withColumn("c0", F.coalesce("c0", F.array().cast(T.ArrayType(events.schema["id"].dataType))))
    last = F.when(F.col("k") == 1, F.col("s0")).otherwise(F.col("before"))
    own = own.withColumn("same", (F.col("session") != "") & (F.col("session") == last)).withColumn("k", F.col("k") + F.col("k0"))
    bonus = F.when(F.coalesce("same", F.lit(False)), 1 + 0.5 * F.least(F.col("k") / 5, F.lit(1.0))).otherwise(1.0)
    gain = F.when(F.col("k") == 1, RATE * F.col("s")).otherwise(RATE * F.col("s") * F.least(F.col("k") / 10, F.lit(2.0)) * bonus)
    first = F.array_sort(F.array_compact(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "id")))))
    return own.withColumn("f", 1 - gain).groupBy(*keys).agg(
        F.least(F.lit(1.0), 1 - (1 - F.coalesce(F.first("w0"), F.lit(0.0))) * F.product("f")).alias("hebbian_weight"),
        F.max("k").cast("long").alias("co_activation_count"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max_by("session_id", F.struct("ts", "id")).alias("last_session_id"),
        F.concat(F.first("c0"), F.transform(first, lambda x: x["id"])).alias("contexts"),
    )


def upsert_tags(tags: DataFrame, seen: DataFrame) -> DataFrame:
    """New tags of seen (name, category, ts) that are not in tags: the earliest row of each name, categories in capitals, unknown ones CONCEPT."""
    kind = F.upper(F.trim("category"))
    first = seen.groupBy("name").agg(F.min_by(F.when(kind.isin(*CATEGORIES), kind).otherwise("CONCEPT"), F.struct("ts", "category")).alias("category"), F.min("ts").alias("first_seen_at"))
    return first.join(tags.select("name"), "name", "left_anti")


def forget(tags: DataFrame, protected: DataFrame, as_of: Column, days: int = 1) -> DataFrame:
    """Tags after `days` daily ticks: retrieval decays by 0.02 for each day without activation, to 0.01; weak ones fall dormant.

    protected (tag_id) are tags of memories that are to last; they and dormant tags stay as they are.
    """
    own = tags.join(protected.select("tag_id").distinct().withColumn("_keep", F.lit(True)), "tag_id", "left")
    idle = F.coalesce("_keep", F.lit(False)) | F.col("is_dormant")
    tick = lambda r, i: F.greatest(r * (1 - 0.02 * F.greatest(F.col("cooldown_days") + i, F.lit(1))), F.lit(0.01))
    r = F.when(idle, F.col("retrieval_strength")).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(days)), F.col("retrieval_strength"), tick))
    own = own.withColumn("retrieval_strength", r).withColumn("cooldown_days", F.when(idle, F.col("cooldown_days")).otherwise(F.col("cooldown_days") + days))
    old = F.col("last_activated_at").isNull() | (F.col("last_activated_at") < as_of - F.expr("INTERVAL 90 DAYS"))
    weak = ~idle & (F.col("storage_strength") * F.col("retrieval_strength") < 0.05) & old & (F.col("total_activations") < 2)
    return own.withColumn("is_dormant", F.col("is_dormant") | weak).drop("_keep")


def hot(tags: DataFrame, n: int = 10) -> DataFrame:
    heat = F.col("storage_strength") * F.col("retrieval_strength")
    return tags.where(~F.col("is_dormant")).select("*", heat.alias("heat")).orderBy(F.desc("heat"), "name").limit(n)


def neighbors(edges: DataFrame, tags: DataFrame, least: float = 0.05) -> DataFrame:
    """tag, neighbor, relation_type, weight in both directions, of edges that are strong enough and neighbours that are awake."""
    strong = edges.where(F.col("hebbian_weight") >= least)
    both = strong.select(F.col("source_tag").alias("tag"), F.col("target_tag").alias("neighbor"), "relation_type", "hebbian_weight").union(strong.select("target_tag", "source_tag", "relation_type", "hebbian_weight"))
    return both.join(tags.where(~F.col("is_dormant")).select(F.col("name").alias("neighbor")), "neighbor").select("tag", "neighbor", "relation_type", "hebbian_weight")


def activity(tags: DataFrame) -> DataFrame:
    """How many tags are active, dormant, and there at all."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return tags.agg(count(~F.col("is_dormant")).alias("active"), count(F.col("is_dormant")).alias("dormant"), F.count("*").alias("total"))


def export_nodes(tags: DataFrame, edges: DataFrame, mentions: DataFrame, memories: DataFrame, least: float = 0.005, n: int = 8) -> DataFrame:
    """name, heat, degree, n_mentions and titles of every tag: its neighbours by edges that are strong enough, and its newest n memories (memory_id, title, created_at)."""
    strong = edges.where(F.col("hebbian_weight") >= least)
    ends = strong.select(F.col("source_tag").alias("name"), F.col("target_tag").alias("other")).union(strong.select("target_tag", "source_tag"))
    degree = ends.groupBy("name").agg(F.count_distinct("other").alias("degree"))
    own = mentions.select(F.col("tag").alias("name"), "memory_id")
    total = own.groupBy("name").agg(F.count("*").alias("n_mentions"))
    newest = W.Window.partitionBy("name").orderBy(F.desc("created_at"), F.desc("memory_id"))
    told = own.join(memories, "memory_id").withColumn("r", F.row_number().over(newest)).where(F.col("r") <= n)
    titles = told.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("r", "title"))).alias("t")).select("name", F.transform("t", lambda x: x["title"]).alias("titles"))
    out = tags.select("name", (F.col("storage_strength") * F.col("retrieval_strength")).alias("heat")).join(degree, "name", "left").join(total, "name", "left").join(titles, "name", "left")
    return out.fillna(0, ["degree", "n_mentions"]).withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))


def export_edges(edges: DataFrame, least: float = 0.005, n: int = 200) -> DataFrame:
    """The n heaviest edges, one for each pair of tags."""
    pair = edges.where(F.col("hebbian_weight") >= least).select(F.least("source_tag", "target_tag").alias("a"), F.greatest("source_tag", "target_tag").alias("b"), "relation_type", "hebbian_weight")
    best = pair.groupBy("a", "b").agg(F.max("hebbian_weight").alias("weight"))
    return best.orderBy(F.desc("weight"), "a", "b").limit(n)


def keyword_tags(docs: DataFrame, id_col: str = "id", text: str = "text", n: int = 6, least: float = 0.2, stop: tuple[str, ...] = ()) -> DataFrame:
    """The n keywords of each document with the largest TF-IDF (tf / words * ln(N / df)) in its whole text."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    own = docs.select(F.col(id_col).alias("doc"), F.explode(words).alias("term")).where((F.length("term") > 1) & ~F.col("term").isin(*stop))
    tf = saved(own.groupBy("doc", "term").agg(F.count("*").alias("tf")), "terms")  # texts are taken apart once
    size = tf.groupBy("doc").agg(F.sum("tf").alias("size"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("total"))
    most = F.col("tf") / F.col("size") * F.log(F.col("total"))  # of a term that no other document has; what stays below need not meet its document frequency
    able = tf.join(size, "doc").join(F.broadcast(total)).where(most > least - 1e-9)
    weighed = able.join(df, "term").select("doc", "term", (F.col("tf") / F.col("size") * F.log(F.col("total") / F.col("df"))).alias("weight"))
    best = W.Window.partitionBy("doc").orderBy(F.desc(F.round("weight", 9)), "term")
    return weighed.where(F.col("weight") > least).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def merge_chains(memories: DataFrame, mentions: DataFrame, refines: DataFrame, least: int = 5) -> DataFrame:
    """memory_id, superseded_by: memories of a session that follow each other and whose tags a REFINES edge joins form a chain; older ones give way to the newest.

    memories: memory_id, session_id, created_at; mentions: memory_id, tag; refines: source_tag, target_tag.  A session of any length is dealt by ranges of time.
    """
    big = memories.groupBy("session_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("session_id")
    own = numbered(memories.select("memory_id", "session_id", "created_at").join(big, "session_id"), ["session_id"], ["created_at", "memory_id"], "memory_id").drop("k")
    own = saved(own, "followed")
    both = refines.select("source_tag", "target_tag").union(refines.select("target_tag", "source_tag")).distinct()
    mine = mentions.select(F.col("memory_id"), F.col("tag").alias("source_tag"))
    other = mentions.select(F.col("memory_id").alias("before"), F.col("tag").alias("target_tag"))
    joined = own.where("before is not null").select("memory_id", "before").join(mine, "memory_id").join(both, "source_tag").join(other, ["before", "target_tag"]).select("memory_id").distinct().withColumn("_joined", F.lit(True))
    own = running(own.join(joined, "memory_id", "left"), ["session_id"], ["created_at", "memory_id"], F.when(F.coalesce("_joined", F.lit(False)), 0).otherwise(1), "island")
    own = saved(own.select("memory_id", "session_id", "created_at", "island"), "islands")
    last = own.groupBy("session_id", "island").agg(F.max_by("memory_id", F.struct("created_at", "memory_id")).alias("superseded_by"), F.count("*").alias("_m")).where("_m > 1")
    return own.join(last, ["session_id", "island"]).where("memory_id <> superseded_by").select("memory_id", "superseded_by")


def copied_tags(merged: DataFrame, mentions: DataFrame, relevance: float = 0.6) -> DataFrame:
    """memory_id, tag, relevance: tags of memories that gave way (merged: memory_id, superseded_by) which the newest of their chain lacks."""
    old = merged.join(mentions.select("memory_id", "tag"), "memory_id").select(F.col("superseded_by").alias("memory_id"), "tag").distinct()
    return old.join(mentions.select("memory_id", "tag"), ["memory_id", "tag"], "left_anti").withColumn("relevance", F.lit(relevance))
