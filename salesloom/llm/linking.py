"""Links and connected groups from buckets, without all pairs of a bucket.

Members of a bucket may be alike. First each member is tested against one leader only, so a bucket of any size costs as
many tests as it has members. What that joins needs no further test. Afterwards every pair of a bucket whose two members
still lie in different groups is tested: no link that joins groups is lost, and a bucket that is one group costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from salesloom.session import stored

#: Rounds in which members are tested against leaders, each with other leaders.
ROUNDS = 2
#: What is open after the leaders in buckets of more members than this is crowded and can be indexed anew.
CROWD = 16


def components(links: DataFrame) -> DataFrame:
    """id and comp, the smallest id that links (a, b) reach, for every id that has a link.

    Large and small stars in turn until every id but a centre has one edge, to a centre. The smallest neighbour of each
    id is written before the edges meet it, so that the rows of an id with very many edges can be split among tasks.
    """
    edges = stored(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                   "edges")
    while not stars_only(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        met = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = met.select("u", F.col("m").alias("v")).unionByName(
            met.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = stored(small.distinct(), "edges")
    own = edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(own)


def stars_only(edges: DataFrame) -> bool:
    """Every u has one edge, and no u is a v."""
    ends = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).select(F.col("u").alias("id"), "n", F.lit(0).alias("side"))
    ends = ends.unionByName(edges.select(F.col("v").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("side")))
    return ends.groupBy("id").agg(F.max("n").alias("n"), F.max("side").alias("v")).filter("n > 1 OR n = 1 AND v = 1").isEmpty()


def open_buckets(posts: DataFrame, comp: DataFrame | None) -> DataFrame:
    """posts with comp (the id itself if it has none), of buckets with members of different groups."""
    if comp is None:
        posts = posts.withColumn("comp", F.col("id"))
    else:
        posts = posts.drop("comp").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    posts = stored(posts.select("sig", "id", "size", "comp"), "posts")
    mixed = posts.groupBy("sig").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least != most")
    return stored(posts.join(stored(mixed.select("sig"), "mixed"), "sig", "left_semi"), "open-buckets")


def ordered(left: DataFrame) -> DataFrame:
    """Pairs with a < b."""
    turned = F.col("x") > F.col("y")
    pick = lambda one, other: F.when(turned, F.col(other)).otherwise(F.col(one))
    return left.select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("size_x", "size_y").alias("size_a"),
                       pick("size_y", "size_x").alias("size_b"), "shared")


def grouped(posts: DataFrame, verify: Callable[[DataFrame], DataFrame], fits: Callable[[DataFrame], DataFrame],
            alike: Callable[[DataFrame], DataFrame] = lambda pairs: pairs, rounds: int = ROUNDS,
            promising: Callable[[DataFrame], DataFrame] | None = None,
            crowded: tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame], str] | None = None) -> DataFrame:
    """id and comp of all ids with a link.

    posts: distinct (sig, id, size), size being whatever fits and alike look at; verify: keeps of pairs (a, b) those that
    are linked; fits: drops pairs (size_a, size_b) that cannot be linked, where they meet and before they are shuffled;
    alike: drops pairs (a, b, size_a, size_b, shared) that cannot be linked if `shared` is the number of all buckets that
    the two have in common; promising: drops those not worth a test against a leader, alike if not given; crowded: instead
    of the large buckets of what is open after all leaders, posts (sig, id, size) of all ids (id) in them such that linked
    ones meet, fits for their sizes, and an expression that is least for the best leaders.
    """
    comp = links = tried = None
    for turn in range(rounds):
        posts = open_buckets(posts, comp)
        if posts.isEmpty():
            return none_or(comp, posts)
        rank = F.col("id") if turn == 0 else F.xxhash64(F.lit(turn), "id")
        comp, links, tried = joined(led(posts, rank, fits, promising or alike), verify, comp, links, tried)
    posts = open_buckets(posts, comp)
    if posts.isEmpty():
        return none_or(comp, posts)
    crowd = None
    if crowded is not None:
        large = posts.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("sig")
        large = stored(large, "large-buckets")
        crowd = stored(posts.join(large, "sig", "left_semi").select("id").distinct(), "crowd")
        posts = posts.join(large, "sig", "left_anti")
    comp, links, tried = joined(alike(met_in(posts, fits)).select("a", "b"), verify, comp, links, tried)
    if crowd is not None and not crowd.isEmpty():
        again, near, rank = crowded
        posts = open_buckets(again(crowd), comp)
        if not posts.isEmpty():
            pairs = led(posts, F.struct(F.expr(rank), "id"), near, lambda pairs: pairs)
            comp, links, tried = joined(pairs, verify, comp, links, tried)
            posts = open_buckets(posts, comp)
        comp, links, tried = joined(met_in(posts, near).select("a", "b"), verify, comp, links, tried)
    return none_or(comp, posts)


def led(posts: DataFrame, rank: Column, fits: Callable[[DataFrame], DataFrame],
        promising: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of each member and, of the leaders of its buckets, which are the members of least rank, the one with
    which it shares most, if that looks promising. What is left out here is tested later."""
    leaders = posts.groupBy("sig").agg(F.min_by(F.struct("id", "size", "comp"), rank).alias("l"))
    leaders = stored(leaders.select("sig", F.col("l.id").alias("y"), F.col("l.size").alias("size_y"),
                                    F.col("l.comp").alias("comp_y")), "leaders")
    met = posts.join(leaders, "sig").filter("comp != comp_y").select(
        F.col("id").alias("a"), F.col("y").alias("b"), F.col("size").alias("size_a"), F.col("size_y").alias("size_b"))
    met = fits(met).groupBy("a", "b").agg(
        F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"), F.count(F.lit(1)).alias("shared"))
    best = promising(met).groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def met_in(posts: DataFrame, fits: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b, size_a, size_b, shared) of members of one bucket that are of different groups."""
    # Most members of a bucket may be one group by now: only the others meet all.
    counts = posts.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = stored(counts.groupBy("sig").agg(F.max_by("comp", F.struct("n", "comp")).alias("main")), "main-groups")
    tagged = stored(posts.join(main, "sig"), "tagged")
    one = tagged.filter("comp != main").select("sig", F.col("id").alias("x"), F.col("size").alias("size_x"),
                                               F.col("comp").alias("comp_x"))
    other = tagged.select("sig", F.col("id").alias("y"), F.col("size").alias("size_y"), F.col("comp").alias("comp_y"),
                          (F.col("comp") == F.col("main")).alias("in_main"))
    pairs = one.join(other, "sig").filter("comp_x != comp_y AND (in_main OR x < y)")
    return fits(ordered(pairs.withColumn("shared", F.lit(1)))).groupBy("a", "b").agg(
        F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"), F.sum("shared").alias("shared"))


def joined(pairs: DataFrame, verify, comp: DataFrame | None, links: DataFrame | None, tried: DataFrame | None):
    """Test new pairs; groups by all links so far, these links, and all pairs tested so far."""
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    pairs = stored(pairs, "pairs")
    if pairs.isEmpty():
        return comp, links, tried
    found = stored(verify(pairs).select("a", "b"), "links")
    links = found if links is None else links.unionByName(found)
    tried = pairs if tried is None else tried.unionByName(pairs)
    return stored(components(links), "groups"), links, tried


def none_or(comp: DataFrame | None, posts: DataFrame) -> DataFrame:
    return comp if comp is not None else posts.select("id", "comp").filter("false")
