"""Record linkage: blocking, scores, classes and one-to-one matching of people."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions.dates import decade, year_closeness
from kinforge.functions.metaphone import metaphone
from kinforge.functions.text import best_similarity, fold, place_similarity, similarity, soundex
from kinforge.operators._lineage import cut

WEIGHTS = {"surname": 0.30, "given": 0.20, "birth_year": 0.20, "death_year": 0.10, "birth_place": 0.10, "death_place": 0.05, "sex": 0.05}
CORROBORATING = ("birth_year", "death_year", "birth_place", "death_place")
CERTAIN, PROBABLE, BLOCK_CAP, SEX_PENALTY = 0.85, 0.65, 500, 0.7


def prepared(people: DataFrame, phonetic: str = "soundex") -> DataFrame:
    """id with folded names and places, phonetic codes and years.

    ``alternates`` (array of given, surname), where there is one, has a person's further names; those that
    differ from the first count in scores, never in codes. Double Metaphone has a second code for each name.
    """
    has = "alternates" in people.columns
    death = fold("death_place") if "death_place" in people.columns else F.lit("")
    p = people.select("id", fold("given").alias("given"), fold("surname").alias("surname"), "sex", "birth_year", "death_year", fold("birth_place").alias("birth_place"), death.alias("death_place"), *([F.col("alternates")] if has else []))
    if phonetic == "metaphone":
        p = p.withColumn("g", metaphone(F.col("given"))).withColumn("s", metaphone(F.col("surname")))
        p = p.withColumn("given_code", F.col("g.first")).withColumn("surname_code", F.col("s.first")).withColumn("surname_code_2", F.col("s.second")).drop("g", "s")
    else:
        p = p.withColumn("given_code", soundex(F.col("given"))).withColumn("surname_code", soundex(F.col("surname"))).withColumn("surname_code_2", F.lit(""))
    if has:
        for c in ("given", "surname"):
            # one text for all, taken apart again: pandas functions don't go inside arrays
            texts = F.split(fold(F.array_join(F.transform(F.col(f"alternates.{c}"), lambda x: F.coalesce(x, F.lit(""))), "\x1f")), "\x1f")
            p = p.withColumn(f"{c}s", F.array_distinct(F.filter(F.concat(F.array(c), F.coalesce(texts, F.array().cast("array<string>"))), lambda x: x != "")))
        p = p.drop("alternates")
    return p


def block_keys(p: DataFrame, phonetic: str = "soundex") -> DataFrame:
    """(id, pass, key) of five passes, of Double Metaphone seven; a pass gives no key where a part is missing."""
    s, g = F.nullif(F.col("surname_code"), F.lit("")), F.nullif(F.col("given_code"), F.lit(""))
    year = F.concat(F.col("birth_year").cast("string"), F.lit("|"), F.col("death_year").cast("string"))
    keys = [F.concat(s, F.lit("|"), decade(F.col("birth_year"))), F.concat(s, F.lit("|"), decade(F.col("death_year"))), F.concat(g, F.lit("|"), decade(F.col("birth_year"))), year, F.concat(s, F.lit("|"), g)]
    out = p.select("id", F.posexplode(F.array(*keys)).alias("pass", "key"))
    if phonetic == "metaphone":
        # either code of the surname, with the decade of birth and with the given name
        both = F.explode(F.array_distinct(F.array(s, F.nullif(F.col("surname_code_2"), F.lit(""))))).alias("code")
        more = p.select("id", both, decade(F.col("birth_year")).alias("born"), g.alias("g"))
        for k, part in ((5, "born"), (6, "g")):
            out = out.union(more.select("id", F.lit(k).alias("pass"), F.concat("code", F.lit("|"), part).alias("key")))
    return out.filter("key IS NOT NULL")


def block_sizes(keys: DataFrame) -> DataFrame:
    return keys.groupBy("pass", "key").agg(F.count("*").alias("n"))


def checked(certain: float, probable: float, cap: int) -> None:
    """Refuses thresholds and caps that make no sense."""
    if not (0 <= probable < certain <= 1):
        raise ValueError("thresholds must be within 0 and 1, certain above probable")
    if cap < 1:
        raise ValueError("a block holds one person at least")


def _in_blocks(keys: DataFrame, small: DataFrame, rows: DataFrame | None, name: str) -> DataFrame:
    """One row for each person and block, with the person's ``rows`` and blocks that come before this one."""
    own = keys.join(small.select("pass", "key"), ["pass", "key"]).groupBy("id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "pass", "key"))).alias("blocks"))
    own = own if rows is None else own.join(rows, "id")
    each = own.select("*", F.posexplode("blocks").alias("k", "block")).withColumn("before", F.slice("blocks", F.lit(1), F.col("k"))).drop("blocks", "k")
    # as many parts as asked for here: what pairs come of a part is far more than the part, by which Spark would join small ones
    spark = keys.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    each = each.repartition(parts, "block")
    return each.select("block", F.col("id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in each.columns if c not in ("block", "id")))


def candidates(left: DataFrame, right: DataFrame, cap: int = BLOCK_CAP, same: bool = False, left_rows: DataFrame | None = None, right_rows: DataFrame | None = None) -> DataFrame:
    """(a, b) that share a key of some pass whose block on the right side is within ``cap``; within one file, a < b.

    A pair is found in the first block that both are in, so that pairs are never gathered to be told apart. With
    ``left_rows`` and ``right_rows`` (id and more) they bring both sides' columns along, as ``c_a`` and ``c_b``.
    """
    small = block_sizes(right).filter(F.col("n") <= cap)
    a, b = _in_blocks(left, small, left_rows, "a"), _in_blocks(right, small, right_rows, "b")
    pairs = a.join(b.hint("merge"), "block").filter(~F.arrays_overlap("before_a", "before_b"))
    return pairs.filter("a < b" if same else "true").drop("block", "before_a", "before_b")


def skipped_keys(left: DataFrame, right: DataFrame, cap: int = BLOCK_CAP) -> DataFrame:
    """Keys of blocks beyond ``cap`` that the left side looks up."""
    return block_sizes(right).filter(F.col("n") > cap).join(left, ["pass", "key"], "left_semi").select("key").distinct()


def with_sides(pairs: DataFrame, left: DataFrame | None, right: DataFrame | None) -> DataFrame:
    """Pairs with both sides' columns; without ``left`` and ``right`` they have them."""
    side = lambda p, x: p.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in p.columns if c != "id"))
    return pairs if left is None or right is None else pairs.select("a", "b").join(side(left, "a"), "a").join(side(right, "b"), "b")


def rounded(value: Column, places: int) -> Column:
    """To the nearest of the scaled double, halves up: what SQL engines do, where Spark rounds the shortest decimal that reads back."""
    scaled = value * float(10**places)
    low = F.floor(scaled).cast("double")
    return F.when(scaled - low >= 0.5, low + 1.0).otherwise(low) / float(10**places)


def scores(pairs: DataFrame, left: DataFrame | None = None, right: DataFrame | None = None, reject_sex_mismatch: bool = False) -> DataFrame:
    """Field scores, weighted total and class of each pair; a field counts if both sides have it."""
    j = with_sides(pairs, left, right)
    text = lambda c, f: F.when((F.col(f"{c}_a") != "") & (F.col(f"{c}_b") != ""), f(F.col(f"{c}_a"), F.col(f"{c}_b")))
    name = (lambda c: best_similarity(F.col(f"{c}s_a"), F.col(f"{c}s_b"))) if "surnames_a" in j.columns else (lambda c: text(c, similarity))
    sexes = F.col("sex_a").isin("M", "F") & F.col("sex_b").isin("M", "F")
    codes = lambda x: F.filter(F.array(f"surname_code_{x}", f"surname_code_2_{x}"), lambda c: c != "")
    j = j.select(
        "a", "b", name("surname").alias("surname"), name("given").alias("given"),
        year_closeness(F.col("birth_year_a"), F.col("birth_year_b")).alias("birth_year"), year_closeness(F.col("death_year_a"), F.col("death_year_b")).alias("death_year"),
        text("birth_place", place_similarity).alias("birth_place"), text("death_place", place_similarity).alias("death_place"), F.when(sexes & (F.col("sex_a") == F.col("sex_b")), 1.0).alias("sex"),
        (sexes & (F.col("sex_a") != F.col("sex_b"))).alias("sex_mismatch"), F.arrays_overlap(codes("a"), codes("b")).alias("codes_match"),
    )
    fields = list(WEIGHTS)
    weight = sum((F.when(F.col(c).isNotNull(), WEIGHTS[c]).otherwise(0.0) for c in fields), F.lit(0.0))
    total = sum((F.coalesce(F.col(c) * WEIGHTS[c], F.lit(0.0)) for c in fields), F.lit(0.0)) / F.nullif(weight, F.lit(0.0))
    total = F.when(F.col("codes_match") & F.col("surname").between(0.5, 0.85), F.least(total + 0.05, F.lit(1.0))).otherwise(total)
    total = F.when(F.col("sex_mismatch"), 0.0 if reject_sex_mismatch else total * SEX_PENALTY).otherwise(total)
    present = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    others = sum((F.col(c).isNotNull().cast("int") for c in CORROBORATING), F.lit(0))
    return j.withColumn("fields", present).withColumn("name_only", (others == 0) & (present > 0)).withColumn("insufficient_data", (present < 3) | (others == 0)).withColumn("total", F.coalesce(total, F.lit(0.0)))


def classified(scored: DataFrame, certain: float = CERTAIN, probable: float = PROBABLE) -> DataFrame:
    checked(certain, probable, 1)
    t = F.col("total")
    kind = F.when(F.col("fields") < 3, "non_match").when((F.col("name_only") | (F.col("fields") == 3)) & (t >= probable), "probable")
    return scored.withColumn("class", kind.when((F.col("fields") > 3) & ~F.col("name_only") & (t >= certain), "certain").when((F.col("fields") > 3) & (t >= probable), "probable").otherwise("non_match"))


#: Pairs that are gone through one after the other in one task at a time.
SLAB = 2_000_000


def _first_pairs(left: DataFrame, most: int) -> Column | None:
    """What holds for the first pairs in order, ``most`` of them or somewhat more; null where there are none."""
    levels = sorted(((r["total"], r["n"]) for r in left.groupBy("total").agg(F.count("*").alias("n")).collect()), reverse=True)
    if not levels:
        return None
    (best, n), seen, last = levels[0], 0, None
    if n > most:
        upto = left.filter(F.col("total") == best).agg(F.percentile_approx("a", most / n, 10_000).alias("a")).first()["a"] if dict(left.dtypes)["a"] != "string" else None
        return (F.col("total") == best) & (F.col("a") <= upto) if upto is not None else F.col("total") == best
    for total, n in levels:
        seen += n
        if seen > most:
            break
        last = total
    return F.col("total") >= last


def greedy(scored: DataFrame, same: bool, slab: int = SLAB) -> DataFrame:
    """One-to-one matches, best total (four places) first, ties by ids.

    About ``slab`` first pairs are gone through one after the other; what their people's other pairs are is left
    out of the rest then, and so on: the rounds grow with the number of pairs, not with the length of chains.

    ``same``: both ids are of one file, so that each person is used once.
    """
    left = cut(scored.select("a", "b", rounded(F.col("total"), 4).alias("total")))
    out = left.limit(0)
    schema = left.schema

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: set = set()
        two = one if same else set()
        for batch in batches:
            keep = []
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
                new = a not in one and b not in two
                if new:
                    one.add(a)
                    two.add(b)
                keep.append(new)
            yield batch.filter(pa.array(keep, pa.bool_()))

    while (first := _first_pairs(left, slab)) is not None:
        taken = cut(left.filter(first).repartition(1).sortWithinPartitions(F.desc("total"), "a", "b").mapInArrow(walk, schema))
        out = out.union(taken)
        a, b = taken.select(F.col("a").alias("u")), taken.select(F.col("b").alias("u"))
        rest = left.filter(~first)
        for c, used in (("a", a.union(b) if same else a), ("b", a.union(b) if same else b)):
            rest = rest.join(used.hint("shuffle_hash"), F.col(c) == F.col("u"), "left_anti")
        left = cut(rest)
    return out


def unmatched(people: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    return people.join(matches, people["id"] == matches[side], "left_anti").select("id")


def field_differences(pairs: DataFrame, left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
    """(a, b, field, value_a, value_b) of what differs; missing years as ``?``."""
    fields = ["given", "surname", "sex", "birth_year", "death_year", "birth_place", "death_place"]
    j = with_sides(pairs, left, right)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    all_ = F.array(*(F.struct(F.lit(c).alias("field"), said(f"{c}_a").alias("value_a"), said(f"{c}_b").alias("value_b")) for c in fields))
    return j.select("a", "b", F.explode(F.filter(all_, lambda x: x["value_a"] != x["value_b"])).alias("d")).select("a", "b", "d.*")


