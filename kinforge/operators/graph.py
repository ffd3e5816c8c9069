"""Family graphs: reach, components, generations, kinship, cycles. Links are rows; each step is a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions.text import ordinal
from kinforge.operators._lineage import cut


#: Rounds after which what has been reached before is taken out of the frontier.
SETTLE = 8


def _reach(roots: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """(root, id, depth): everything that links (here, there) lead to, at its least depth; roots at 0.

    A frontier goes on one link a round. Lines that meet again are rare, so what was reached before is left
    out every ``SETTLE`` rounds only, which is enough for rings to end; least depths are taken at the end.
    Tables are merged and never broadcast, here and in the other rounds of this module: all broadcasts of all
    rounds would go through the driver, and grow with the input.
    """
    links = cut(links.select("here", "there").distinct())
    seen = frontier = cut(roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth")).distinct())
    for depth in range(1, most + 1):
        step = frontier.join(links.hint("merge"), frontier["id"] == links["here"]).select("root", F.col("there").alias("id")).distinct()
        if depth % SETTLE == 0:
            seen = cut(seen.groupBy("root", "id").agg(F.min("depth").alias("depth")))
            step = step.join(seen.select("root", "id").hint("merge"), ["root", "id"], "left_anti")
        frontier = cut(step.withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return cut(seen.groupBy("root", "id").agg(F.min("depth").alias("depth")))


def ancestors(roots: DataFrame, parents: DataFrame, most: int = 50) -> DataFrame:
    return _reach(roots, parents.select(F.col("child").alias("here"), F.col("parent").alias("there")), most)


def descendants(roots: DataFrame, parents: DataFrame, most: int = 50) -> DataFrame:
    return _reach(roots, parents.select(F.col("parent").alias("here"), F.col("child").alias("there")), most)


def truncated(reach: DataFrame, parents: DataFrame, most: int) -> DataFrame:
    """Roots some of whose ancestors at the greatest depth have parents."""
    return reach.filter(F.col("depth") == most).join(parents, F.col("id") == F.col("child"), "left_semi").select("root").distinct()


def components(nodes: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the least id within reach. Labels go along links, then labels of labels are followed."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = cut(nodes.select("id", F.col("id").alias("component")))
    for _ in range(rounds):
        sent = both.join(labels.hint("merge"), both["a"] == labels["id"]).select(F.col("b").alias("id"), "component")
        near = cut(labels.join(sent.groupBy("id").agg(F.min("component").alias("least")).hint("merge"), "id", "left").select("id", "component", F.least("component", F.coalesce("least", "component")).alias("near")))
        far = near.select(F.col("id").alias("near"), F.col("near").alias("next"))
        new = cut(near.join(far.hint("merge"), "near", "left").select("id", F.coalesce("next", "near").alias("component"), (F.coalesce("next", "near") != F.col("component")).alias("changed")))
        labels = new.select("id", "component")
        if not new.filter("changed").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")


def family_links(families: DataFrame, children: DataFrame) -> DataFrame:
    """Links between the members of each family and one of them."""
    members = families.select(F.col("id").alias("fam"), F.expr("stack(2, husb, wife) as member")).union(children.select("fam", "child")).filter("member IS NOT NULL")
    head = members.groupBy("fam").agg(F.min("member").alias("a"))
    return members.join(head, "fam").select("a", F.col("member").alias("b"))


def isolated(labels: DataFrame) -> DataFrame:
    """Single people and pairs: (component, size, first, last)."""
    return labels.groupBy("component").agg(F.count("*").alias("size"), F.min("id").alias("first"), F.max("id").alias("last")).filter("size <= 2")


def generation_depth(people: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, depth): links of the longest line of ancestors.

    Round by round those are settled all of whose parents are; the round is the depth. On a ring of
    ancestors nobody is ever settled: its members' links to each other are left out then.
    """
    links = cut(parents.select("child", "parent").distinct())
    while True:
        left, depth = links, 0
        out = front = cut(people.select("id").union(links.select("parent")).distinct().join(links.hint("merge"), F.col("id") == F.col("child"), "left_anti").select("id", F.lit(0).alias("depth")))
        while front.limit(1).count():
            depth += 1
            touched = left.join(front.hint("merge"), left["parent"] == front["id"], "left_semi").select(F.col("child").alias("id")).distinct()
            left = cut(left.join(front.hint("merge"), left["parent"] == front["id"], "left_anti"))
            front = cut(touched.join(left.hint("merge"), F.col("id") == F.col("child"), "left_anti").select("id", F.lit(depth).alias("depth")))
            out = out.union(front)
        if not left.limit(1).count():
            return out.join(people.select("id").hint("merge"), "id", "left_semi")
        ring = cut(cycle_members(left))
        inner = left.join(ring.withColumnRenamed("id", "child").hint("merge"), "child", "left_semi").join(ring.withColumnRenamed("id", "parent").hint("merge"), "parent", "left_semi")
        links = cut(links.join(inner.hint("merge"), ["child", "parent"], "left_anti"))


def cycle_members(parents: DataFrame, rounds: int = 500) -> DataFrame:
    """(id): people on a ring of ancestors. Those without a parent or a child among the rest are trimmed first."""
    links = cut(parents.select("child", "parent").distinct())
    size = links.count()
    for _ in range(rounds):
        up, down = links.select(F.col("child").alias("id")).distinct(), links.select(F.col("parent").alias("id")).distinct()
        left = cut(links.join(up.hint("merge"), links["parent"] == up["id"], "left_semi").join(down.hint("merge"), links["child"] == down["id"], "left_semi"))
        now = left.count()
        links = left
        if now == size or not now:
            break
        size = now
    core = links.select(F.col("child").alias("root")).distinct()
    reach = _reach(core, links.select(F.col("child").alias("here"), F.col("parent").alias("there")), rounds)
    back = reach.join(links.hint("merge"), F.col("id") == F.col("child")).filter(F.col("parent") == F.col("root"))
    return back.select(F.col("root").alias("id")).distinct()


def _prefix(word: str, gens: Column) -> Column:
    many = F.when(gens > 1, F.concat(gens.cast("string"), F.lit("x great-"))).when(gens == 1, "great-").otherwise("")
    return F.concat(many, F.lit(word)) if word else many


def kinship(gp: Column, gt: Column, sex: Column) -> Column:
    """What the target is to the primary: generations from each up to the common ancestor, and the target's sex."""
    term = lambda m, f, x: F.when(sex == "M", m).when(sex == "F", f).otherwise(x)
    grand = F.lit("grand")
    removed = F.abs(gp - gt)
    label = F.when(removed == 0, "").when(removed == 1, " once removed").when(removed == 2, " twice removed").otherwise(F.concat(F.lit(" "), removed.cast("string"), F.lit(" times removed")))
    return (
        F.when((gp == 0) & (gt == 0), "same individual")
        .when((gt == 0) & (gp == 1), term("father", "mother", "parent"))
        .when(gt == 0, F.concat(_prefix("", gp - 2), grand, term("father", "mother", "parent")))
        .when((gp == 0) & (gt == 1), term("son", "daughter", "child"))
        .when(gp == 0, F.concat(_prefix("", gt - 2), grand, term("son", "daughter", "child")))
        .when((gp == 1) & (gt == 1), term("brother", "sister", "sibling"))
        .when(gt == 1, F.concat(_prefix("", gp - 2), term("uncle", "aunt", "uncle/aunt")))
        .when(gp == 1, F.concat(_prefix("", gt - 2), term("nephew", "niece", "nephew/niece")))
        .otherwise(F.concat(ordinal(F.least(gp, gt) - 1), F.lit(" cousin"), label))
    )


def relationships(primary: DataFrame, people: DataFrame, parents: DataFrame, most: int = 30) -> DataFrame:
    """(target, gp, gt, ancestors, is_half, relation) of everyone who shares an ancestor with ``primary`` (root)."""
    up = ancestors(primary, parents, most).select(F.col("id").alias("ancestor"), F.col("depth").alias("gp"))
    down = descendants(up.select(F.col("ancestor").alias("root")), parents, most).select(F.col("root").alias("ancestor"), F.col("id").alias("target"), F.col("depth").alias("gt"))
    shared = up.join(down, "ancestor")
    first = Window.partitionBy("target").orderBy(F.col("gp") + F.col("gt"), "gp")
    best = shared.withColumn("r", F.rank().over(first)).filter("r = 1")
    grouped = best.groupBy("target", "gp", "gt").agg(F.array_sort(F.collect_set("ancestor")).alias("ancestors"))
    out = grouped.join(people.select(F.col("id").alias("target"), "sex"), "target")
    half = (F.col("gp") > 0) & (F.col("gt") > 0) & (F.size("ancestors") < 2)
    return out.select("target", "gp", "gt", "ancestors", half.alias("is_half"), kinship(F.col("gp"), F.col("gt"), F.col("sex")).alias("relation"))


def sentence(target: Column, primary: Column, relation: Column, is_half: Column, show_half: bool) -> Column:
    """What the target is to the primary, in words: "the" for direct lines, "a" or "an" for all others."""
    shown = F.when(is_half, F.concat(F.lit("half-"), relation)).otherwise(relation) if show_half else relation
    direct = relation.rlike(r"(?:father|mother|parent|son|daughter|child)\z")
    article = F.when(direct, "the").when(F.lower(F.substring(shown, 1, 1)).isin(*"aeiou"), "an").otherwise("a")
    return F.when(relation == "same individual", F.concat(target, F.lit(" and "), primary, F.lit(" are the same individual."))).otherwise(F.concat(target, F.lit(" is "), article, F.lit(" "), shown, F.lit(" of "), primary, F.lit(".")))


def relation_paths(primary: DataFrame, people: DataFrame, parents: DataFrame, families: DataFrame, most: int = 30) -> DataFrame:
    """(target, rank, relation, gp, gt, ancestors, is_half): every kind of relation of ``primary`` (root) to each other person.

    Paths of equal generations are one. Direct lines are never half; siblings are with fewer than two
    shared parents; any other path is unless one of its ancestors has a partner among all common ones.
    Of paths with the same name the shortest counts, with the ancestors of all. Shorter paths come first,
    then full before half, then those with more male ancestors.
    """
    up = ancestors(primary, parents, most).select(F.col("id").alias("ancestor"), F.col("depth").alias("gp"))
    down = descendants(up.select(F.col("ancestor").alias("root")), parents, most).select(F.col("root").alias("ancestor"), F.col("id").alias("target"), F.col("depth").alias("gt"))
    shared = cut(up.join(down, "ancestor"))
    sides = families.filter("husb IS NOT NULL AND wife IS NOT NULL").select(F.expr("stack(2, husb, wife, wife, husb) as (ancestor, partner)")).distinct()
    paired = shared.join(sides, "ancestor").join(shared.select(F.col("ancestor").alias("partner"), "target"), ["partner", "target"], "left_semi").select("target", "gp", "gt").distinct().withColumn("paired", F.lit(True))
    males = people.filter("sex = 'M'").select(F.col("id").alias("ancestor"), F.lit(1).alias("male"))
    groups = shared.groupBy("target", "gp", "gt").agg(F.collect_set("ancestor").alias("ancestors")).join(paired, ["target", "gp", "gt"], "left")
    half = F.when((F.col("gp") == 0) | (F.col("gt") == 0), False).when((F.col("gp") == 1) & (F.col("gt") == 1), F.size("ancestors") < 2).otherwise(F.col("paired").isNull())
    named = groups.join(people.select(F.col("id").alias("target"), "sex"), "target").select("target", "gp", "gt", "ancestors", half.alias("is_half"), kinship(F.col("gp"), F.col("gt"), F.col("sex")).alias("relation"))
    best = F.min(F.struct((F.col("gp") + F.col("gt")).alias("gens"), "gp", "gt")).alias("best")
    kinds = named.groupBy("target", "relation", "is_half").agg(best, F.array_sort(F.array_distinct(F.flatten(F.collect_list("ancestors")))).alias("ancestors"))
    counted = kinds.select("target", "relation", "is_half", F.explode("ancestors").alias("ancestor")).join(males, "ancestor").groupBy("target", "relation", "is_half").agg(F.sum("male").alias("males"))
    kinds = kinds.join(counted, ["target", "relation", "is_half"], "left").withColumn("males", F.coalesce("males", F.lit(0)))
    order = Window.partitionBy("target").orderBy("best.gens", "is_half", F.desc("males"), "best.gp", "relation")
    return kinds.select("target", F.row_number().over(order).alias("rank"), "relation", "best.gp", "best.gt", "ancestors", "is_half")
