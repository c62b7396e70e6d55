"""Context around hits: neighbours, relations, hierarchy, expansion, and greedy removal of look-alikes.

Chunks are rows (chunk_id, document_id, chunk_index, content); hits are (qid, chunk_id, score); edges are (src, dst, type,
strength).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, relevance, space_tokens

GROUP = 4


def word_set(c: Column) -> Column:
    return F.array_distinct(space_tokens(F.lower(c)))


def neighbours(hits: DataFrame, chunks: DataFrame, reach: int = 1, factor: float = 0.8) -> DataFrame:
    """(qid, chunk_id, score): chunks up to `reach` places from a hit, at a share of its score. An equi-join for each distance."""
    at = hits.join(chunks.select("chunk_id", "document_id", "chunk_index"), "chunk_id")
    places = F.explode(F.array(*(F.lit(i) for i in range(-reach, reach + 1) if i))).alias("d")
    wanted = at.select("qid", "document_id", "chunk_index", (F.col("score") * factor).alias("score"), places)
    wanted = wanted.select("qid", "document_id", (F.col("chunk_index") + F.col("d")).alias("chunk_index"), "score")
    return wanted.join(chunks.select("chunk_id", "document_id", "chunk_index"), ["document_id", "chunk_index"]).select("qid", "chunk_id", "score")


def related(hits: DataFrame, edges: DataFrame, types: list[str], top: int = 3, factor: float = 0.7) -> DataFrame:
    """(qid, chunk_id, score): the other ends of each hit's strongest edges."""
    ends = edges.where(F.col("type").isin(types)).select(F.explode(F.array(F.struct(F.col("src").alias("chunk_id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("chunk_id"), F.col("src").alias("other")))).alias("x"), "strength").select("x.*", "strength")
    w = Window.partitionBy("qid", "chunk_id").orderBy(F.desc("strength"), "other")
    best = hits.join(ends, "chunk_id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    return best.select("qid", F.col("other").alias("chunk_id"), (F.col("score") * F.col("strength") * factor).alias("score"))


def rebalance(hits: DataFrame, k: int = 10) -> DataFrame:
    """Keeps each chunk's best score, then the k best, and stretches these to 0..1 where they differ."""
    best = hits.groupBy("qid", "chunk_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    w = Window.partitionBy("qid")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return best.withColumn("score", F.when(high > low, (F.col("score") - low) / F.when(high > low, high - low)).otherwise(F.col("score")))


def contextual(hits: DataFrame, chunks: DataFrame, k: int = 10, types: list[str] | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank): hits, their neighbours and related chunks; each chunk once, the k best, stretched to 0..1."""
    near = related(hits, near_edges(hits, chunks), types or ["Semantic", "Reference"])
    rows = hits.select("qid", "chunk_id", "score").unionByName(neighbours(hits, chunks)).unionByName(near)
    return rebalance(rows, k)


def duplicates(ranked: DataFrame, least: float = 0.8) -> DataFrame:
    """(qid, kept, duplicate): of each search's ranked list (qid, rank, doc_id, text) the pairs that are too alike."""
    s = ranked.select("qid", "rank", "doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("s")).withColumn("n", F.size("s"))
    a, b = s.alias("a"), s.alias("b")
    # sets of unlike sizes cannot be alike. A condition of its own would be tested after the costly one
    near = (F.col("a.rank") < F.col("b.rank")) & (F.least("a.n", "b.n") > least * F.greatest("a.n", "b.n"))
    pairs = a.join(b, (F.col("a.qid") == F.col("b.qid")) & F.when(near, jaccard(F.col("a.s"), F.col("b.s")) > least).otherwise(F.lit(False)))
    return pairs.select(F.col("a.qid").alias("qid"), F.col("a.doc_id").alias("kept"), F.col("b.doc_id").alias("duplicate"))


def semantic_edges(chunks: DataFrame, least: float = 0.7) -> DataFrame:
    """(src, dst, type, strength): pairs within a document whose words are alike. Chunks that share no word are never paired.

    Candidates are found by ids and numbers that stand for words; only then each pair, once, meets its two sets of words.
    """
    sets = chunks.select("document_id", "chunk_index", "chunk_id", word_set(F.col("content")).alias("s"))
    # of two sets with Jaccard > t, the first words of one in any fixed order hold a word of the other: prefix filter. Long words
    # come first, as they are rarer: their length stands in the upper bits. Words of one number only make a candidate more
    number = lambda x: F.shiftleft((F.lit(32767) - F.least(F.length(x), F.lit(32767))).cast("long"), 48).bitwiseOR(F.xxhash64(x).bitwiseAND(F.lit((1 << 48) - 1)))
    size = F.size("s")
    prefix = F.slice(F.sort_array(F.transform("s", number)), 1, F.greatest(F.lit(1), size - F.ceil(size * least) + 1).cast("int"))
    word = sets.select("document_id", "chunk_index", size.alias("n"), F.explode(prefix).alias("w"))
    a, b = word.alias("a"), word.alias("b")
    alike = (F.col("a.chunk_index") < F.col("b.chunk_index")) & (F.least("a.n", "b.n") > least * F.greatest("a.n", "b.n"))
    pairs = a.join(b, (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.w") == F.col("b.w")) & alike)
    pairs = pairs.select(F.col("a.document_id").alias("document_id"), F.col("a.chunk_index").alias("i"), F.col("b.chunk_index").alias("j")).distinct()
    of = lambda place, name, s: sets.select("document_id", F.col("chunk_index").alias(place), F.col("chunk_id").alias(name), F.col("s").alias(s))
    both = pairs.join(of("i", "src", "x"), ["document_id", "i"]).join(of("j", "dst", "y"), ["document_id", "j"])
    return both.select("src", "dst", F.lit("Semantic").alias("type"), jaccard(F.col("x"), F.col("y")).alias("strength")).where(F.col("strength") > least)


def sequential_edges(chunks: DataFrame) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    return chunks.select(F.col("chunk_id").alias("src"), F.lead("chunk_id").over(w).alias("dst"), F.lit("Sequential").alias("type"), F.lit(0.8).alias("strength")).where("dst is not null")


def hierarchy(chunks: DataFrame) -> DataFrame:
    """Each chunk as a leaf (level 1) with the group of four it belongs to, and its place in the running text."""
    w = Window.partitionBy("document_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("content")).over(w), F.lit(0))
    return chunks.select("chunk_id", "document_id", "chunk_index", F.concat_ws("#", "document_id", F.concat(F.lit("g"), F.floor(F.col("chunk_index") / GROUP))).alias("parent_id"), F.lit(1).alias("level"), start.alias("start"), (start + F.length("content")).alias("stop"))


def level(nodes: DataFrame, which: int) -> DataFrame:
    """Nodes (document_id, level, start) of a level, with their place in the document."""
    return nodes.where(F.col("level") == which).withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("start")))


def with_groups(leaves: DataFrame) -> DataFrame:
    """(node_id, parent_id, level, n_children): leaves, their groups, and a root for each document."""
    groups = leaves.groupBy("document_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children"))
    roots = groups.groupBy("document_id").agg(F.count("*").alias("n_children"))
    up = groups.select("node_id", F.col("document_id").cast("string").alias("parent_id"), F.lit(1).alias("level"), "n_children")
    return leaves.select(F.col("chunk_id").alias("node_id"), "parent_id", F.lit(2).alias("level"), F.lit(0).cast("long").alias("n_children")).unionByName(up).unionByName(roots.select(F.col("document_id").cast("string").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("level"), "n_children"))


def hierarchy_stats(nodes: DataFrame) -> DataFrame:
    """One row on the tree: nodes, depth, roots, orphans (a parent that is no node), leaves, and children of those that have any."""
    inner = F.when(F.col("n_children") > 0, F.col("n_children"))
    known = nodes.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    x = nodes.join(known, "parent_id", "left")
    orphan = F.col("parent_id").isNotNull() & F.col("known").isNull()
    return x.agg(
        F.count("*").alias("nodes"), F.max("level").alias("depth"), F.count_if(F.col("parent_id").isNull()).alias("roots"), F.count_if(orphan).alias("orphans"),
        F.count_if(F.col("n_children") == 0).alias("leaves"), F.avg(inner).alias("branching"),
    )


def level_distribution(nodes: DataFrame) -> DataFrame:
    """(level, n)."""
    return nodes.groupBy("level").agg(F.count("*").alias("n"))


def edge_stats(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(type, n, mean, low, high) of the edges that touch one of the chunks."""
    ids = chunks.select("chunk_id").distinct()
    own = lambda c: ids.select(F.col("chunk_id").alias(c), F.lit(True).alias(f"own_{c}"))
    touched = edges.join(own("src"), "src", "left").join(own("dst"), "dst", "left").where("own_src or own_dst")  # the edges are found once
    return touched.groupBy("type").agg(F.count("*").alias("n"), F.avg("strength").alias("mean"), F.min("strength").alias("low"), F.max("strength").alias("high"))


def hierarchy_quality(nodes: Column, edges: Column) -> Column:
    """Edges for each node of the hierarchy, two are best."""
    return F.when(nodes > 0, F.least(F.lit(1.0), edges / F.when(nodes > 0, nodes) / 2)).otherwise(0.0)


def children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """The nodes whose parent is one of (node_id)."""
    return nodes.join(parents.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi")


def relationships(edges: DataFrame, chunks: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(chunk_id, other, type, strength): edges at either end of the chunks, of those types, with their place by strength."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("chunk_id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("chunk_id"), F.col("src").alias("other")))).alias("x"), "type", "strength")
    ends = ends.select("x.*", "type", "strength").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    ends = ends.where(F.col("type").isin(types)) if types else ends
    return ends.withColumn("place", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("strength"), "other", "type")))


def expansion_quality(content: Column, primary: Column, age_days: Column) -> Column:
    return 0.5 * jaccard(word_set(content), word_set(primary)) + 0.3 * F.least(F.lit(1.0), F.length(content) / 500) + 0.2 * F.greatest(F.lit(0.1), 1 - age_days / 365)


def near_edges(hits: DataFrame, chunks: DataFrame, least: float = 0.7) -> DataFrame:
    """Semantic edges of the documents that have a hit, and of no others."""
    own = hits.select("chunk_id").distinct().join(chunks.select("chunk_id", "document_id"), "chunk_id").select("document_id").distinct()
    return semantic_edges(chunks.join(own, "document_id", "left_semi"), least)


def expand(hits: DataFrame, chunks: DataFrame, edges: DataFrame, window: int = 6, least: float = 0.5) -> DataFrame:
    """(qid, primary, chunk_id, method, quality, content): siblings of the group, neighbours and related chunks of each hit.

    Budgets are window div 3, div 2 and div 4; what is below the quality goes, and the best `window` of each hit stay. Siblings
    and neighbours are places that a hit names, so they meet the chunks by an equi-join, however long the document is.
    """
    c = chunks.select("chunk_id", "document_id", "chunk_index", "content")
    at = hits.join(c, "chunk_id").select("qid", F.col("chunk_id").alias("primary"), "document_id", "chunk_index", F.col("content").alias("own"))
    group, reach = F.floor(F.col("chunk_index") / GROUP) * GROUP, window // 2
    places = F.sequence(F.greatest(F.lit(0), F.least(group, F.col("chunk_index") - reach)), F.greatest(group + GROUP - 1, F.col("chunk_index") + reach))
    wanted = at.select("qid", "primary", "document_id", "own", F.col("chunk_index").alias("ci"), F.explode(places.cast("array<int>")).alias("chunk_index"))
    same = wanted.where("ci <> chunk_index").join(c, ["document_id", "chunk_index"])
    gap, sibling = F.abs(F.col("chunk_index") - F.col("ci")), F.floor(F.col("chunk_index") / GROUP) == F.floor(F.col("ci") / GROUP)
    w = lambda *order: Window.partitionBy("qid", "primary").orderBy(*order)
    same = same.withColumns({"g": F.row_number().over(w(~sibling, "chunk_index")), "n": F.row_number().over(w(gap, "chunk_index")), "sibling": sibling, "gap": gap})
    methods = F.array_compact(F.array(
        F.when(F.col("sibling") & (F.col("g") <= window // 3), "Hierarchical"), F.when((F.col("gap") <= reach) & (F.col("n") <= window // 2), "Sequential"),
    ))
    near = same.select("qid", "primary", "own", "chunk_id", "content", F.explode(methods).alias("method"))
    ends = edges.select("src", "dst", "strength").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "strength"))
    best = at.join(ends, F.col("primary") == F.col("src")).withColumn("r", F.row_number().over(w(F.desc("strength"), "dst"))).where(F.col("r") <= window // 4)
    semantic = best.select("qid", "primary", "own", F.col("dst").alias("chunk_id")).join(c.select("chunk_id", "content"), "chunk_id")
    found = near.unionByName(semantic.withColumn("method", F.lit("Semantic")))
    found = found.withColumn("quality", expansion_quality(F.col("content"), F.col("own"), F.lit(0))).where(F.round("quality", 9) >= least)
    first = Window.partitionBy("qid", "primary", "chunk_id").orderBy("method")
    found = found.withColumn("f", F.row_number().over(first)).where("f = 1").withColumn("r", F.row_number().over(w(F.desc(F.round("quality", 9)), "chunk_id")))
    return found.where(F.col("r") <= window).select("qid", "primary", "chunk_id", "method", "quality", "content")


def set_quality(expanded: DataFrame, seconds: Column | None = None) -> DataFrame:
    """(qid, primary, n, quality, efficiency): 0.7 of the mean quality and 0.3 of the diversity of a hit's context; quality a second."""
    mean = expanded.groupBy("qid", "primary").agg(F.count("*").alias("n"), F.avg("quality").alias("mean"))
    x = mean.join(diversity(expanded, ["qid", "primary"]).select("qid", "primary", "diversity"), ["qid", "primary"])
    x = x.withColumn("quality", 0.7 * F.col("mean") + 0.3 * F.col("diversity"))
    return x.select("qid", "primary", "n", "quality", (F.col("quality") / (F.lit(1.0) if seconds is None else seconds)).alias("efficiency"))


def combined(expanded: DataFrame, hits: DataFrame, chunks: DataFrame, between: str = "\n\n") -> DataFrame:
    """(qid, primary, text): a hit's content and that of its context, in order of chunk id. A context has `window` rows at most."""
    own = hits.join(chunks.select("chunk_id", "content"), "chunk_id").select("qid", F.col("chunk_id").alias("primary"), F.lit(0).alias("o"), "chunk_id", "content")
    rows = own.unionByName(expanded.select("qid", "primary", F.lit(1).alias("o"), "chunk_id", "content"))
    lists = rows.groupBy("qid", "primary").agg(F.sort_array(F.collect_list(F.struct("o", "chunk_id", "content"))).alias("c"))
    return lists.select("qid", "primary", F.array_join(F.transform("c", lambda x: x.content), between).alias("text"))


def small_to_big(expanded: DataFrame, hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, primary, context_size, relevance): 0.7 of the hit's relevance and 0.3 of its context's mean."""
    q = queries.select("qid", F.col("text").alias("asked"))
    own = hits.join(chunks.select("chunk_id", "content"), "chunk_id").join(q, "qid").select("qid", F.col("chunk_id").alias("primary"), relevance(F.col("content"), F.col("asked")).alias("own"))
    around = expanded.join(q, "qid").groupBy("qid", "primary").agg(F.count("*").alias("context_size"), F.avg(relevance(F.col("content"), F.col("asked"))).alias("around"))
    x = own.join(around, ["qid", "primary"], "left")
    return x.select("qid", "primary", F.coalesce("context_size", F.lit(0)).alias("context_size"), (0.7 * F.col("own") + 0.3 * F.coalesce("around", F.lit(0.0))).alias("relevance"))


def diversity(rows: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """1 - mean pairwise Jaccard of the first `most` contents of a group by chunk id, and the share of repeated words among them."""
    w = Window.partitionBy(*by).orderBy("chunk_id")
    few = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    sets = few.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("chunk_id", "content"))).alias("c"))
    s = F.transform("c", lambda x: word_set(x.content))
    sets = sets.withColumn("s", s).withColumn("all", F.flatten(F.transform("c", lambda x: space_tokens(F.lower(x.content)))))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda y: jaccard(x, y))))
    sets = sets.withColumn("p", pairs)
    mean = F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.lit(1), F.size("p"))
    return sets.select(*by, F.size("s").alias("n"), F.when(F.size("s") > 1, 1 - mean).otherwise(0.0).alias("diversity"), F.when(F.size("all") > 0, 1 - F.size(F.array_distinct("all")) / F.size("all")).otherwise(0.0).alias("redundancy"))


def greedy_distinct(rows: DataFrame, by: list[str], threshold: float = 0.9) -> DataFrame:
    """Contents of a group in order of rank, without those too like one kept before. A group is a search's ranked list, as long as its k."""
    lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", word_set(F.col("content")).alias("s")))).alias("c"))
    start = F.slice("c", 1, 0)
    kept = F.aggregate("c", start, lambda acc, x: F.when(F.exists(acc, lambda y: jaccard(x.s, y.s) >= threshold), acc).otherwise(F.array_append(acc, x)))
    return lists.select(*by, F.explode(kept).alias("k")).select(*by, "k.rank", "k.chunk_id")


def diversified(rows: DataFrame, by: list[str], k: int, balance: float = 0.7) -> DataFrame:
    """(by, rank, chunk_id): ranked lists (rank, chunk_id, score, content) in another order: what comes next has the largest
    balance * score - (1 - balance) * (largest Jaccard with one that came before). A group is a search's ranked list."""
    row = F.struct("rank", "chunk_id", "score", word_set(F.col("content")).alias("s"))
    lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("c"))
    state = F.struct(F.slice("c", 1, 0).alias("out"), F.col("c").alias("left"))

    def step(a: Column, _: Column) -> Column:
        like = lambda x: F.coalesce(F.array_max(F.transform(a["out"], lambda y: jaccard(x.s, y.s))), F.lit(0.0))
        gain = F.transform(a["left"], lambda x: F.struct(F.round(balance * x.score - (1 - balance) * like(x), 9).alias("g"), (-x["rank"]).alias("r"), x.alias("x")))
        # an array of one holds the choice, so that it is made once
        moved = F.transform(F.array(F.array_max(gain).x), lambda t: F.struct(F.array_append(a["out"], t).alias("out"), F.filter(a["left"], lambda x: x["rank"] != t["rank"]).alias("left")))
        return F.when(F.size(a["left"]) > 0, moved[0]).otherwise(a)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(k)), state, step, lambda a: a["out"])
    return lists.select(*by, F.posexplode(done).alias("p", "x")).select(*by, (F.col("p") + 1).alias("rank"), "x.chunk_id")
