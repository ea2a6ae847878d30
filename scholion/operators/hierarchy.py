"""Parent-child links to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.operators.skew import skew_safe_lookup
from scholion.session import cut


def all_links(relationships: DataFrame, organizations: DataFrame) -> DataFrame:
    """(id, parent) of ``ror_relationships``: Parent rows as stated, Child rows reversed; sides not held are left out.

    Types are compared ignoring case and outer blanks. An organisation may have several parents.
    """
    kind = F.lower(F.trim("type"))
    held = organizations.where("id is not null and ror_path is not null").select("id", "ror_path").distinct()
    links = relationships.where(kind.isin("parent", "child")).select(kind.alias("kind"), "ror_id", "ror_path").distinct()
    other = held.select(F.col("id").alias("other"), "ror_path")
    own = held.select(F.col("id").alias("ror_id")).distinct()
    both = links.join(other, "ror_path").join(own, "ror_id", "left_semi")
    is_parent = F.col("kind") == "parent"
    return both.select(F.when(is_parent, F.col("ror_id")).otherwise(F.col("other")).alias("id"), F.when(is_parent, F.col("other")).otherwise(F.col("ror_id")).alias("parent")).distinct()


def parent_links(relationships: DataFrame, organizations: DataFrame) -> DataFrame:
    """One (id, parent) an organisation, for its path: of several parents that of smallest id, so that every run gives the same
    forest. ``closure`` keeps all of them."""
    return all_links(relationships, organizations).groupBy("id").agg(F.min("parent").alias("parent"))


def resolve(links: DataFrame) -> DataFrame:
    """Root and chain of every node that has a parent: id, status, root, chain (ids from the root to the parent).

    ``links`` has one (id, parent) row per child. Each round joins the open nodes with the state of the
    node they point at, which doubles the jump and joins the chains, so a tree of depth d takes
    log2(d) + 1 rounds. status: ``tree``; ``cycle`` for a node that meets itself on its own chain;
    ``below`` for one whose chain runs into such a node. An empty input gives no row.
    """
    up = links.where("id is not null and parent is not null")
    ids = up.select(F.col("id").alias("parent")).withColumn("inner", F.lit(True))
    status = F.when(F.col("id") == F.col("parent"), "cycle").when(F.col("inner"), "open").otherwise("tree")
    state = cut(up.join(ids, "parent", "left").select("id", F.col("parent").alias("top"), F.array("parent").alias("chain"), status.alias("status")))
    rounds = 0
    while not state.where("status = 'open'").isEmpty():
        rounds += 1
        if rounds > 62:
            raise RuntimeError("pointer doubling did not end")
        at = state.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("chain").alias("more"), F.col("status").alias("there"))
        on = state.where("status = 'open'").join(at, "top")
        meets = F.array_contains("more", F.col("id"))
        now = F.when(F.col("there").isin("cycle", "below"), "below").when(meets, "cycle").otherwise(F.col("there"))
        settled = now.isin("below", "cycle")
        moved = on.select(
            "id", F.col("next").alias("top"), F.when(settled, F.array().cast("array<bigint>")).otherwise(F.concat("more", "chain")).alias("chain"), now.alias("status")
        )
        state = cut(state.where("status <> 'open'").unionByName(moved))
    return state.select("id", "status", F.when(F.col("status") == "tree", F.col("top")).alias("root"), "chain")


def organisation_paths(relationships: DataFrame, organizations: DataFrame) -> DataFrame:
    """ror_id, root_id, depth, path of every organisation that has a parent; see ``resolve`` for loops (-1, -1, ``cycle`` or ``below``)."""
    nodes = resolve(parent_links(relationships, organizations))
    tree = F.col("status") == "tree"
    path = F.concat_ws("/", F.transform(F.concat("chain", F.array("id")), lambda x: x.cast("string")))
    return nodes.select(
        F.col("id").alias("ror_id"),
        F.when(tree, F.col("root")).otherwise(F.lit(-1)).cast("bigint").alias("root_id"),
        F.when(tree, F.size("chain")).otherwise(F.lit(-1)).cast("int").alias("depth"),
        F.when(tree, path).otherwise(F.col("status")).alias("path"),
    )


def closure(links: DataFrame) -> DataFrame:
    """(id, ancestor, distance): everything above a node over all its parents, by the shortest way.

    Each round joins the ancestors found with theirs, which doubles the distance reached, and keeps one row a pair, so
    neither several ways to an ancestor nor loops multiply rows. A node on a loop is its own ancestor.
    """
    state = cut(links.where("id is not null and parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct())
    before = (-1, -1)
    while True:
        seen = state.agg(F.count("*"), F.coalesce(F.sum("distance"), F.lit(0))).first()
        if tuple(seen) == before:
            return state
        before = tuple(seen)
        above = state.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("top"), F.col("distance").alias("more"))
        further = state.join(above, "ancestor").select("id", F.col("top").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        state = cut(state.unionByName(further).groupBy("id", "ancestor").agg(F.min("distance").alias("distance")))


def descendants(links: DataFrame) -> DataFrame:
    """(ror_id, descendant_id, distance) for every node above another, over all parents; nodes on and below loops are left out."""
    pairs = closure(links)
    loops = pairs.where("id = ancestor").select("id")
    below = pairs.join(loops.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").select("id")
    kept = pairs.join(loops.unionByName(below).distinct(), "id", "left_anti")
    return kept.select(F.col("ancestor").alias("ror_id"), F.col("id").alias("descendant_id"), F.col("distance").cast("int").alias("distance"))


def raise_to_root(links: DataFrame, paths: DataFrame, organizations: DataFrame) -> DataFrame:
    """Links to organisations raised to the root: distinct (ror_id, work_author_id).

    Organisations without a parent and those on or below a loop stay as they are; links to
    organisations that are not held, and links with nulls, are left out.
    """
    held = organizations.where("id is not null").select(F.col("id").alias("ror_id")).distinct()
    roots = held.join(paths.where("root_id >= 0").select("ror_id", "root_id"), "ror_id", "left")
    keyed = links.select("ror_id", "work_author_id").where("ror_id is not null and work_author_id is not null").distinct().withColumn("_id", F.col("ror_id").cast("string"))
    # few organisations hold most links
    found = skew_safe_lookup(keyed, roots.select(F.col("ror_id").cast("string").alias("_id"), F.coalesce("root_id", "ror_id").alias("root")), "_id")
    return found.where("root is not null").select(F.col("root").alias("ror_id"), "work_author_id").distinct()
