"""Balanced choices by group and stratum, and the nine named splits made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.relations import settled
from quillon.operators.selection import cut_by_hash


def balanced(df: DataFrame, key: str, group: Column, strata: list[str], quotas: DataFrame, salt: str) -> DataFrame:
    """Keys chosen in each group: its quota, shared over strata by largest remainder, least hashes first.

    quotas: (grp, quota). A quota beyond its group takes all of it; groups without one give nothing.
    All groups are served at once; what is ranked is hashes, salted by the group's name.
    """
    d = df.select(F.col(key), group.cast("string").alias("grp"), F.concat_ws("\x1f", *strata).alias("__s"))
    each = Window.partitionBy("grp")
    sizes = d.groupBy("grp", "__s").agg(F.count("*").alias("c")).join(quotas, "grp")
    total = F.least(F.greatest(F.col("quota"), F.lit(0)), F.sum("c").over(each))
    q = sizes.withColumn("q", total).withColumn("x", F.col("c") * F.col("q") / F.sum("c").over(each)).withColumn("base", F.floor("x"))
    place = F.row_number().over(each.orderBy(F.round(F.col("x") - F.col("base"), 9).desc(), "__s"))
    q = q.select("grp", "__s", (F.col("base") + (place <= F.col("q") - F.sum("base").over(each)).cast("long")).alias("take"))
    digest = F.sha2(F.concat_ws("\x1f", F.concat(F.lit(salt), F.col("grp")), F.col(key).cast("string")), 256)
    cuts = q.select("grp", "__s", F.lit(1).alias("cut"), F.col("take").alias("k"))
    return cut_by_hash(d, key, ["grp", "__s"], digest, cuts).filter("cut IS NOT NULL").select(key)


def _mark(df: DataFrame, chosen: DataFrame, key: str, name: str) -> DataFrame:
    """df with the chosen rows marked, written: later choices read it more than once."""
    return settled(df.join(chosen.withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False))))


def nine_splits(df: DataFrame, key: str, tier: str, template: str, domain: str, ood: dict[str, int], working: dict[str, int], validation: int, id_test: int, debug: tuple[int, int]) -> DataFrame:
    """(split, key) of nine named sets that overlap by design; key is unique and not null.

    Held-out templates give the test of new templates. Each tier's working quota, less what that
    test took of the tier, comes from the other templates. Validation and test are taken from it and
    leave train, out of which come the larger debug set of each tier and, out of that, the smaller.
    Rows outside of working are locked. Rows with a null tier are never chosen for working.
    """
    table = lambda quotas: df.sparkSession.createDataFrame(list(quotas.items()), "grp string, quota long")
    by_tier = lambda n: table(dict.fromkeys(working, n))
    whole, per_tier = F.lit(""), F.col(tier)
    held = F.coalesce(F.col(template).isin(*ood), F.lit(False))
    d = df.select(key, tier, template, domain)
    d = _mark(d, balanced(d.filter(held), key, F.col(template), [domain], table(ood), "ood:"), key, "template_ood_test")
    taken = d.filter("template_ood_test").groupBy(F.col(tier).alias("grp")).agg(F.count("*").alias("__t"))
    left = table(working).join(taken, "grp", "left").select("grp", (F.col("quota") - F.coalesce("__t", F.lit(0))).alias("quota"))
    d = _mark(d, balanced(d.filter(~held), key, per_tier, [template, domain], left, "working:"), key, "__w")
    strata = [tier, template, domain]
    d = _mark(d, balanced(d.filter("__w"), key, whole, strata, table({"": validation}), "validation"), key, "validation")
    d = _mark(d, balanced(d.filter("__w AND NOT validation"), key, whole, strata, table({"": id_test}), "id_test"), key, "id_test")
    d = d.withColumn("train", F.expr("__w AND NOT validation AND NOT id_test"))
    d = _mark(d, balanced(d.filter("train"), key, per_tier, [template, domain], by_tier(debug[1]), "debug250:"), key, "debug_250")
    d = _mark(d, balanced(d.filter("debug_250"), key, per_tier, [template, domain], by_tier(debug[0]), "debug50:"), key, "debug_50")
    d = d.withColumns({"completed": F.lit(True), "working": F.expr("__w OR template_ood_test"), "locked_confirmation": F.expr("NOT __w AND NOT template_ood_test")})
    names = ("completed", "working", "locked_confirmation", "train", "validation", "id_test", "template_ood_test", "debug_50", "debug_250")
    return d.select(key, F.explode(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))).alias("split")).select("split", key)


# --- validation of written splits ---

PRIMARY = ("train", "validation", "id_test", "template_ood_test")
NAMES = ("completed", "working", "locked_confirmation", *PRIMARY, "debug_50", "debug_250")


def read_splits(spark, folder: str, schema: str, key: str, names=NAMES) -> tuple[DataFrame, DataFrame]:
    """(split, schema's columns) of the JSON lines files <name>.jsonl of a folder, and (issue, part, n) of those that can't be used.

    Each file is read by itself: a missing one is an issue, one with lines that are no objects of the
    schema with a key another, and neither has rows; the rest are read all the same.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    issues, rows = [], spark.createDataFrame([], schema).select(F.lit("").alias("split"), "*")
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.jsonl")
        if not path.getFileSystem(conf).exists(path):
            issues.append(("missing_file", name, 1))
            continue
        lines = spark.read.text(path.toString()).filter(F.trim("value") != "")
        read = lines.select("value", F.from_json("value", schema).alias("r"))
        whole = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)) & F.col(f"r.{key}").isNotNull()
        broken = read.filter(~whole).count()
        if broken:
            issues.append(("corrupt_file", name, broken))
        else:
            rows = rows.unionByName(read.select(F.lit(name).alias("split"), "r.*"))
    return rows, spark.createDataFrame(issues, "issue string, part string, n bigint")


def validate_splits(rows: DataFrame, key: str, tier: str, template: str, sizes: dict[str, int] | None = None, tiers: dict[str, int] | None = None, ood: dict[str, int] | None = None) -> DataFrame:
    """issue, part, n of nine splits (split, key, tier, template): sizes, overlaps, partitions, subsets, held-out templates and quotas.

    One row a key tells which splits have it, so all rules on keys are counts over one shuffle.
    """
    d = rows.select("split", F.col(key).alias("key"), F.col(tier).alias("tier"), F.col(template).alias("template"))
    per = settled(d.groupBy("key").agg(F.collect_set("split").alias("s"), F.collect_set("template").alias("templates")))  # nine names at most
    has = lambda n: F.array_contains("s", n)
    any_of = lambda names: F.arrays_overlap("s", F.array(*[F.lit(n) for n in names]))
    rules = {("overlap", "working+locked_confirmation"): has("working") & has("locked_confirmation")}
    rules |= {("overlap", f"{a}+{b}"): has(a) & has(b) for i, a in enumerate(PRIMARY) for b in PRIMARY[i + 1 :]}
    rules[("not_partitioned", "completed")] = has("completed") != any_of(("working", "locked_confirmation"))
    rules[("not_partitioned", "working")] = has("working") != any_of(PRIMARY)
    rules |= {("not_subset", n): has(n) & ~has("train") for n in ("debug_50", "debug_250")}
    if ood:
        held = F.arrays_overlap("templates", F.array(*[F.lit(x) for x in ood]))
        rules |= {("held_out_template", n): has(n) & F.coalesce(held, F.lit(False)) for n in PRIMARY[:3]}
    counted = per.agg(*[F.count_if(c).alias(f"{issue}\x1f{part}") for (issue, part), c in rules.items()])
    each = F.array(*[F.struct(F.lit(issue).alias("issue"), F.lit(part).alias("part"), F.col(f"`{issue}\x1f{part}`").alias("n")) for issue, part in rules])
    found = counted.select(F.explode(each).alias("x")).select("x.*").filter("n > 0")
    table = lambda what: d.sparkSession.createDataFrame(list((what or {}).items()), "part string, want bigint")

    def unequal(issue: str, have: DataFrame, want: dict[str, int] | None) -> DataFrame:
        both = have.join(table(want), "part", "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
        return both.filter(F.col("n") != F.coalesce("want", F.lit(0))).select(F.lit(issue).alias("issue"), "part", "n") if want is not None else found.limit(0)

    count = lambda split, by: d.filter(F.col("split") == split).groupBy(F.col(by).alias("part")).agg(F.count("*").alias("n"))
    sized = d.groupBy(F.col("split").alias("part")).agg(F.count("*").alias("n"))
    return found.unionByName(unequal("size", sized, sizes)).unionByName(unequal("tier_quota", count("working", "tier"), tiers)).unionByName(unequal("template_quota", count("template_ood_test", "template"), ood))
